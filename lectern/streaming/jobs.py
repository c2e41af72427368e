"""Folds of job progress and model activity.

Both are plain aggregates, so the same function serves a table and a stream (update mode,
upserted by key in ``foreachBatch``).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lectern.skew import assemble_text, exploded
from lectern.streaming import WATERMARK

# Stage of each job status, and the order of the stages.
STAGE_OF = {
    "HASHING": "hash", "QUEUED": "hash", "RENDERING": "render", "PARSING_LAYOUT": "layout", "RECOGNIZING_TEXT": "vision_text", "EXTRACTING_FIGURES": "figures",
    "CHECKING_FORMULAS": "formulas", "CLEANING_DOCUMENT": "cleanup", "VERIFYING_DOCUMENT": "verification", "PARSING_REFERENCES": "tables",
    "RESOLVING_METADATA": "ocr", "INDEXING": "index", "READY": "index", "PARTIAL": "index",
}
STAGES = ["hash", "render", "layout", "vision_text", "figures", "formulas", "cleanup", "tables", "ocr", "verification", "index"]
# Phase that each stream event puts a request in.
PHASE_OF = {
    "started": "sending", "connected": "connected", "thinking": "thinking", "delta": "streaming", "tool_calls": "completed", "done": "completed",
    "cancelled": "cancelled", "error": "error",
}
ENDINGS = ["tool_calls", "done", "cancelled", "error"]


def lookup(values: dict[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(v) for pair in values.items() for v in pair])[key]


def job_state(events: DataFrame) -> DataFrame:
    """Latest status, progress and message per job."""
    position = F.struct("ts", "event_id")
    g = events.groupBy("job_id").agg(F.max_by(F.struct("status", "progress", "message"), position).alias("s"), F.max("ts").alias("updated_at"))
    return g.select("job_id", "s.status", "s.progress", "s.message", "updated_at")


def stage_state(events: DataFrame) -> DataFrame:
    """Last event and first start of every (job, stage)."""
    position = F.struct("ts", "event_id")
    staged = events.withColumn("stage", lookup(STAGE_OF, F.col("status"))).where("stage is not null")
    g = staged.groupBy("job_id", "stage").agg(F.max_by(F.struct("status", "progress"), position).alias("s"), F.max(position).alias("at"), F.min("ts").alias("started_at"))
    return g.select("job_id", "stage", "s.status", "s.progress", F.col("at.ts").alias("ts"), F.col("at.event_id").alias("event_id"), "started_at")


def finish_stages(stages: DataFrame) -> DataFrame:
    """Stage rows of each job: a stage passed by a later one is completed unless partial.

    A job has at most eleven stages, so the window is tiny whatever the number of events.
    """
    rank = F.array_position(F.array(*[F.lit(s) for s in STAGES]), F.col("stage"))
    at = F.struct("ts", "event_id")
    later = Window.partitionBy("job_id").orderBy("_rank").rowsBetween(1, Window.unboundedFollowing)
    marked = stages.withColumn("_rank", rank).withColumn("_later", F.max(at).over(later))
    own = F.when(F.col("status") == "PARTIAL", "partial").when(F.col("status") == "READY", "completed").otherwise("running")
    passed = (F.col("_later") > at) & (own != "partial")
    done = F.when(F.col("status").isin("READY", "PARTIAL"), F.lit(1.0)).otherwise(F.col("progress"))
    return marked.select(
        "job_id", "stage", F.when(passed, "completed").otherwise(own).alias("stage_status"), F.when(passed, F.lit(1.0)).otherwise(done).alias("stage_progress"), "started_at")


def stage_finishes(events: DataFrame) -> DataFrame:
    """``job_id, stage, finished_at``: the moment of the first event of a later stage after the stage's own first event.

    What comes after that moment, even events of the stage itself, does not move it; a stage that no later one
    followed has none.  The starts of a job are one row of eleven, which its events meet; both sides of that join are
    folded inside the map tasks, so a job with any share of the events costs one row per partition.
    """
    at, ranks = F.struct("ts", "event_id"), range(1, len(STAGES) + 1)
    rank = F.array_position(F.array(*[F.lit(s) for s in STAGES]), lookup(STAGE_OF, F.col("status")))
    staged = events.select("job_id", "ts", "event_id", rank.alias("_rank")).where("_rank > 0")
    starts = staged.groupBy("job_id").agg(*[F.min(F.when(F.col("_rank") == k, at)).alias(f"_s{k}") for k in ranks])
    met = staged.join(starts, "job_id")
    ends = met.groupBy("job_id").agg(*[F.min(F.when((F.col("_rank") > k) & (at > F.col(f"_s{k}")), at)).alias(f"_e{k}") for k in ranks])
    listed = F.array(*[F.struct(F.lit(s).alias("stage"), F.col(f"_e{k}.ts").alias("finished_at")) for k, s in zip(ranks, STAGES, strict=True)])
    return ends.select("job_id", F.inline(listed)).where("finished_at is not null")


def job_stages(events: DataFrame) -> DataFrame:
    """``finish_stages`` with the time each stage was finished."""
    return finish_stages(stage_state(events)).join(stage_finishes(events), ["job_id", "stage"], "left")


JOB_STAGE = "job_id string, stage string, stage_status string, stage_progress double, started_at timestamp, finished_at timestamp"


class StageFold(StatefulProcessor):
    """Per job the rows of its stages, changed by every event in turn; a change is told by the job's rows anew.

    A job without an event for ``forget`` seconds of event time leaves the state.
    """

    def __init__(self, forget: float = 86400.0):
        self.forget = forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.stages = handle.getMapState("stages", "rank int", "status string, progress double, started_at timestamp, finished_at timestamp")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["ts", "event_id"], kind="stable")
        held = {int(k[0]): [v[0], v[1], v[2], v[3]] for k, v in self.stages.iterator()}
        for row in batch.itertuples(index=False):
            stage = STAGE_OF.get(row.status)
            if stage is None:
                continue
            rank, now = STAGES.index(stage), pd.Timestamp(row.ts).to_pydatetime()
            for earlier, state in held.items():
                if earlier < rank and state[0] != "partial":
                    state[0], state[1], state[3] = "completed", 1.0, state[3] or now
            whole = row.status in ("READY", "PARTIAL")
            status = "partial" if row.status == "PARTIAL" else "completed" if whole else "running"
            before = held.get(rank)
            held[rank] = [status, 1.0 if whole else None if pd.isna(row.progress) else float(row.progress), before[2] if before else now, before[3] if before else None]
        for rank, state in held.items():
            self.stages.updateValue((rank,), tuple(state))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(int((pd.Timestamp(batch["ts"].iloc[-1]).timestamp() + self.forget) * 1000))
        yield pd.DataFrame([(key[0], STAGES[r], *s) for r, s in sorted(held.items())], columns=[c.split()[0] for c in JOB_STAGE.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.stages.clear()
        yield pd.DataFrame([], columns=[c.split()[0] for c in JOB_STAGE.split(", ")])

    def close(self) -> None:
        pass


def stage_stream(events: DataFrame, watermark: str = WATERMARK, forget: float = 86400.0) -> DataFrame:
    """``job_stages`` over a stream of events: rows to upsert by (job_id, stage), in the order in which they come out.

    Needs the RocksDB state store.  Events are taken in order of time within a micro-batch, and batch after batch.
    """
    return events.withWatermark("ts", watermark).groupBy("job_id").transformWithStateInPandas(
        statefulProcessor=StageFold(forget), outputStructType=JOB_STAGE, outputMode="Update", timeMode="EventTime")


def fold_activity(events: DataFrame, deferred: bool = False) -> DataFrame:
    """One row per request: phase, first contact and token, characters, usage, end.

    ``events(request_id, seq, ts, kind, text, reasoning_characters, input_tokens,
    output_tokens, error)``.  ``deferred`` requests stay in ``saving`` after their last token.
    """
    kind, position = F.col("kind"), F.struct("ts", "seq")
    in_contact, tokens = kind.isin("connected", "thinking", "delta", "tool_calls"), kind.isin("thinking", "delta")
    ends = kind.isin("cancelled", "error") if deferred else kind.isin(*ENDINGS)
    g = events.groupBy("request_id").agg(
        F.max_by("kind", position).alias("_kind"), F.min("ts").alias("started_at"), F.min(F.when(in_contact, F.col("ts"))).alias("connected_at"),
        F.min(F.when(tokens, F.col("ts"))).alias("first_token_at"), F.max(F.when(ends, F.col("ts"))).alias("completed_at"),
        F.sum(F.when(kind == "delta", F.length(F.coalesce("text", F.lit("")))).otherwise(0)).alias("received_characters"),
        F.sum(F.when(kind == "thinking", F.coalesce("reasoning_characters", F.lit(0))).otherwise(0)).alias("reasoning_characters"),
        F.max_by(F.struct("input_tokens", "output_tokens"), F.when(F.col("input_tokens").isNotNull(), position)).alias("_usage"),
        F.max_by("error", F.when(kind == "error", position)).alias("error"))
    phase = lookup(PHASE_OF, F.col("_kind"))
    if deferred:
        phase = F.when(phase == "completed", "saving").otherwise(phase)
    return g.select("request_id", phase.alias("phase"), "started_at", "connected_at", "first_token_at", "completed_at", "received_characters", "reasoning_characters",
                    F.col("_usage.input_tokens").alias("input_tokens"), F.col("_usage.output_tokens").alias("output_tokens"), "error")


def host_groups(events: DataFrame) -> DataFrame:
    """Calls made by the host, grouped by source and model: items sent and finished, usage.

    ``events(source, model_name, label, phase, ts, event_id, input_tokens, output_tokens, error)``.
    """
    position, phase = F.struct("ts", "event_id"), F.col("phase")
    g = events.groupBy("source", "model_name").agg(
        F.max_by("phase", position).alias("last_phase"), F.count_if(phase == "sending").alias("total_items"), F.count_if(phase.isin("completed", "error")).alias("completed_items"),
        F.min(F.when(phase == "connected", F.col("ts"))).alias("connected_at"), F.max("ts").alias("updated_at"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"),
        F.max_by("error", position).alias("error"))
    finished = (F.col("total_items") > 0) & (F.col("completed_items") >= F.col("total_items"))
    shown = F.when(F.col("last_phase") == "error", "error").when(finished, "completed").when(F.col("last_phase") == "completed", "streaming").otherwise(F.col("last_phase"))
    return g.select("source", "model_name", shown.alias("phase"), "total_items", "completed_items", "connected_at", F.when(finished | (F.col("last_phase") == "error"), F.col("updated_at")).alias("completed_at"), "input_tokens", "output_tokens", "error")


def delta_columns(fmt: Column, body: Column) -> dict[str, Column]:
    """Text, reasoning and usage of one streamed message in either wire format."""
    get = lambda path: F.get_json_object(body, path)
    block = fmt == "anthropic"
    return {
        "text": F.when(block, get("$.delta.text")).otherwise(get("$.choices[0].delta.content")),
        "reasoning": F.when(fmt == "openai", F.coalesce(get("$.choices[0].delta.reasoning_content"), get("$.choices[0].delta.reasoning"))),
        "input_tokens": F.when(block, get("$.usage.input_tokens")).otherwise(get("$.usage.prompt_tokens")).cast("long"),
        "output_tokens": F.when(block, get("$.usage.output_tokens")).otherwise(get("$.usage.completion_tokens")).cast("long"),
    }


def with_deltas(messages: DataFrame) -> DataFrame:
    """``messages(request_id, seq, format, json)`` with their delta columns."""
    return messages.select("*", *[c.alias(n) for n, c in delta_columns(F.col("format"), F.col("json")).items()])


def assembled(deltas: DataFrame, column: str = "text") -> DataFrame:
    """Text of each request in order: one row per request."""
    rows = deltas.where(F.col(column).isNotNull()).select("request_id", "seq", F.col(column).alias("_t"))
    return assemble_text(rows, ["request_id"], ["seq"], "_t", "")


def usage(deltas: DataFrame) -> DataFrame:
    """Last usage reported per request; a missing half counts zero."""
    told = deltas.where(F.col("input_tokens").isNotNull() | F.col("output_tokens").isNotNull())
    g = told.groupBy("request_id").agg(F.max_by(F.struct("input_tokens", "output_tokens"), "seq").alias("u"))
    zero = F.lit(0).cast("long")
    return g.select("request_id", F.coalesce("u.input_tokens", zero).alias("input_tokens"), F.coalesce("u.output_tokens", zero).alias("output_tokens"))


def tool_calls(messages: DataFrame) -> DataFrame:
    """Tool calls put together from their fragments, per request and index."""
    body, block = F.col("json"), F.col("format") == "anthropic"
    get = lambda path: F.get_json_object(body, path)
    opens = (get("$.type") == "content_block_start") & (get("$.content_block.type") == "tool_use")
    one = F.array(F.struct(
        F.coalesce(get("$.index").cast("int"), F.lit(0)).alias("index"), F.when(opens, get("$.content_block.id")).alias("id"), F.when(opens, get("$.content_block.name")).alias("name"), get("$.delta.partial_json").alias("arguments")))
    shape = "array<struct<index:int,id:string,function:struct<name:string,arguments:string>>>"
    many = F.transform(F.from_json(get("$.choices[0].delta.tool_calls"), shape), lambda t: F.struct(
        F.coalesce(t["index"], F.lit(0)).alias("index"), t["id"].alias("id"), t["function"]["name"].alias("name"), t["function"]["arguments"].alias("arguments")))
    parts = exploded(messages, F.when(block, one).otherwise(many), "f", "request_id", "seq").select("request_id", "seq", "f.*")
    parts = parts.where("id is not null or name is not null or arguments is not null")
    # Every message is read once, and its call gathers all it needs of it in one grouping.
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("seq", c)))), lambda r: r[c]), "")
    return parts.groupBy("request_id", "index").agg(
        F.max_by("id", F.when(F.col("id").isNotNull(), F.col("seq"))).alias("call_id"), joined("name").alias("name"),
        F.when(F.count("arguments") > 0, joined("arguments")).alias("arguments"))
