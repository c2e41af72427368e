"""Event folds: bursts, coalescing, stability, job progress, model activity, deltas."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import metrics
from lectern.queries import query
from lectern.queries.tables import EVENT_BLOCKS, event_blocks, table
from lectern.session import spread
from lectern.streaming import events as E
from lectern.streaming import jobs as J
from lectern.streaming import stability as S


def _file_events(spark, sf_dir):
    e = event_blocks(table(spark, sf_dir, "events"))
    path = F.concat(F.lit("/library/"), F.col("user_id").cast("string"), F.lit(".pdf"))
    before = F.when(F.col("event_type") == "view", F.concat(F.lit("/library/old-"), F.col("event_id").cast("string"), F.lit(".pdf")))
    return e.select("event_id", "event_type", path.alias("path"), before.alias("previous_path"), "ts", F.to_date("ts").alias("day"), "_hour")


@query("coalesce_events", """WITH b AS (SELECT *, row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY ts DESC, event_id DESC) AS r FROM events)
SELECT '/library/' || user_id || '.pdf' AS path, arg_max(event_type, (ts, event_id)) AS event_type, arg_max('/library/old-' || event_id || '.pdf', (ts, event_id)) FILTER (WHERE event_type = 'view') AS previous_path, max(ts) AS ts FROM b WHERE r = 1 GROUP BY user_id""")
def coalesce_events(spark, sf_dir):
    return E.coalesce_history(_file_events(spark, sf_dir), "day")


@query("event_quarantine", "SELECT event_id FROM events WHERE event_type = 'error' OR user_id % 3 = 0")
def event_quarantine(spark, sf_dir):
    e = _file_events(spark, sf_dir)
    user = F.regexp_extract("path", r"(\d+)", 1).cast("long")
    path = F.when(F.col("event_type") == "error", F.lit("/elsewhere/a.pdf")).when(user % 3 == 0, F.lit("/library/a.txt")).otherwise(F.col("path"))
    _, bad = E.valid_events(e.withColumn("path", path), "/library")
    return bad.select("event_id")


@query("burst_sessions", """WITH p AS (SELECT *, lag(ts) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS b FROM events), s AS (SELECT *, sum(CASE WHEN b IS NULL OR epoch_us(ts) - epoch_us(b) >= 600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS burst FROM p)
SELECT event_type, burst::BIGINT AS burst, min(ts) AS burst_start, max(ts) AS burst_last, count(*) AS n_events FROM s GROUP BY 1, 2""")
def burst_sessions(spark, sf_dir):
    return E.bursts(event_blocks(table(spark, sf_dir, "events")), "event_type", EVENT_BLOCKS, 600.0)


@query("stable_files", """WITH p AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events), s AS (SELECT *, sum(CASE WHEN b IS NULL OR b <> event_type THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM p),
t AS (SELECT *, min(ts) OVER (PARTITION BY user_id, run) AS since FROM s) SELECT user_id::VARCHAR AS path, run::BIGINT AS run, min(ts) AS accepted_at FROM t WHERE epoch_us(ts) - epoch_us(since) >= 2000000 GROUP BY 1, 2""")
def stable_files(spark, sf_dir):
    e = event_blocks(table(spark, sf_dir, "events"))
    s = e.select(F.col("user_id").cast("string").alias("path"), F.length("event_type").cast("long").alias("size_bytes"), F.xxhash64("event_type").alias("modified_at_ns"), "ts", "event_id", "_hour")
    return S.stable_files(s, EVENT_BLOCKS).select("path", "run", "accepted_at")


def _job_events(spark, sf_dir):
    kind = F.col("event_type")
    status = F.when(kind == "signup", "HASHING").when(kind == "view", "PARSING_LAYOUT").when(kind == "click", "RECOGNIZING_TEXT").when(kind == "purchase", F.when(F.col("event_id") % 2 == 0, "READY").otherwise("PARTIAL")).otherwise("FAILED")
    return table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("job_id"), status.alias("status"), F.round(F.col("value") / 1000, 6).alias("progress"), F.col("props").alias("message"), "ts")


JOBS = """WITH e AS (SELECT *, CASE event_type WHEN 'signup' THEN 'HASHING' WHEN 'view' THEN 'PARSING_LAYOUT' WHEN 'click' THEN 'RECOGNIZING_TEXT' WHEN 'purchase' THEN (CASE WHEN event_id % 2 = 0 THEN 'READY' ELSE 'PARTIAL' END) ELSE 'FAILED' END AS status, round(value / 1000, 6) AS progress FROM events),
s AS (SELECT user_id, CASE event_type WHEN 'signup' THEN 'hash' WHEN 'view' THEN 'layout' WHEN 'click' THEN 'vision_text' ELSE 'index' END AS stage, CASE event_type WHEN 'signup' THEN 1 WHEN 'view' THEN 3 WHEN 'click' THEN 4 ELSE 11 END AS rk, arg_max(status, (ts, event_id)) AS status, arg_max(progress, (ts, event_id)) AS progress, max((ts, event_id)) AS pos, min(ts) AS started_at FROM e WHERE event_type <> 'error' GROUP BY ALL)"""


@query("job_state", JOBS + " SELECT user_id AS job_id, arg_max(status, (ts, event_id)) AS status, arg_max(progress, (ts, event_id)) AS progress, max(ts) AS updated_at FROM e GROUP BY 1")
def job_state(spark, sf_dir):
    return J.job_state(_job_events(spark, sf_dir)).drop("message")


@query("progress_fold", JOBS + """, a AS (SELECT e.user_id, ts, event_id, CASE event_type WHEN 'signup' THEN 1 WHEN 'view' THEN 3 WHEN 'click' THEN 4 ELSE 11 END AS rk FROM e WHERE event_type <> 'error'),
b AS (SELECT user_id, rk, min((ts, event_id)) AS first FROM a GROUP BY 1, 2), f AS (SELECT b.user_id, b.rk, min(a.ts) AS finished_at FROM b JOIN a ON a.user_id = b.user_id AND a.rk > b.rk AND (a.ts, a.event_id) > b.first GROUP BY 1, 2),
m AS (SELECT *, max(pos) OVER (PARTITION BY user_id ORDER BY rk ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later FROM s)
SELECT user_id AS job_id, stage, CASE WHEN later > pos AND status <> 'PARTIAL' THEN 'completed' WHEN status = 'PARTIAL' THEN 'partial' WHEN status = 'READY' THEN 'completed' ELSE 'running' END AS stage_status,
  CASE WHEN (later > pos AND status <> 'PARTIAL') OR status IN ('READY', 'PARTIAL') THEN 1.0 ELSE progress END::DOUBLE AS stage_progress, started_at, finished_at FROM m LEFT JOIN f USING (user_id, rk)""")
def progress_fold(spark, sf_dir):
    return J.job_stages(_job_events(spark, sf_dir))


def _model_events(spark, sf_dir):
    t = F.col("event_type")
    kind = F.when(t == "signup", "connected").when(t == "view", "thinking").when(t == "click", "delta").when(t == "purchase", "done").otherwise("error")
    return table(spark, sf_dir, "events").select(
        (F.col("user_id") * 1000 + F.col("event_id") % 3).alias("request_id"), F.col("event_id").alias("seq"), "ts", kind.alias("kind"), F.col("props").alias("text"), F.lit(3).alias("reasoning_characters"),
        F.when(t == "purchase", F.col("event_id")).alias("input_tokens"), F.when(t == "purchase", F.lit(5).cast("long")).alias("output_tokens"), F.when(t == "error", F.col("props")).alias("error"))


ACTIVITY = """WITH e AS (SELECT user_id * 1000 + event_id % 3 AS request_id, event_id, ts, event_type, props FROM events)
SELECT request_id, CASE arg_max(event_type, (ts, event_id)) WHEN 'signup' THEN 'connected' WHEN 'view' THEN 'thinking' WHEN 'click' THEN 'streaming' WHEN 'purchase' THEN 'completed' ELSE 'error' END AS phase, min(ts) AS started_at,
  min(ts) FILTER (WHERE event_type IN ('signup', 'view', 'click')) AS connected_at, min(ts) FILTER (WHERE event_type IN ('view', 'click')) AS first_token_at, max(ts) FILTER (WHERE event_type IN ('purchase', 'error')) AS completed_at,
  coalesce(sum(length(props)) FILTER (WHERE event_type = 'click'), 0)::BIGINT AS received_characters, (3 * count(*) FILTER (WHERE event_type = 'view'))::BIGINT AS reasoning_characters,
  arg_max(event_id, (ts, event_id)) FILTER (WHERE event_type = 'purchase') AS input_tokens, CASE WHEN count(*) FILTER (WHERE event_type = 'purchase') > 0 THEN 5::BIGINT END AS output_tokens, arg_max(props, (ts, event_id)) FILTER (WHERE event_type = 'error') AS error FROM e GROUP BY 1"""


@query("activity_fold", ACTIVITY)
def activity_fold(spark, sf_dir):
    return J.fold_activity(_model_events(spark, sf_dir))


@query("group_activity", f"""WITH a AS ({ACTIVITY}), b AS (SELECT *, request_id // 10000 AS g, phase IN ('completed', 'cancelled', 'error') AS fin FROM a),
c AS (SELECT g, count(*) AS members, arg_max('r' || request_id, (started_at, request_id)) AS label, arg_max(phase, (started_at, request_id)) AS op, arg_min(phase, (started_at, request_id)) FILTER (WHERE NOT fin) AS ap, bool_or(phase = 'error') AS f, count(*) FILTER (WHERE fin) AS completed_items,
  min(started_at) AS started_at, max(coalesce(completed_at, started_at)) AS ca, sum(received_characters)::BIGINT AS received_characters FROM b GROUP BY 1)
SELECT g AS group_key, members, label, CASE WHEN members = 1 THEN op WHEN ap IS NOT NULL THEN ap WHEN f THEN 'error' WHEN completed_items < greatest(members, 12) THEN 'sending' ELSE 'completed' END AS phase, completed_items, greatest(members, 12)::BIGINT AS total_items, started_at, CASE WHEN ap IS NULL THEN ca END AS completed_at, received_characters FROM c""")
def group_activity(spark, sf_dir):
    a = J.fold_activity(_model_events(spark, sf_dir))
    rows = a.select("*", F.floor(F.col("request_id") / 10000).alias("group_key"), F.concat(F.lit("r"), F.col("request_id").cast("string")).alias("label"), F.lit(12).alias("total_items"))
    return metrics.group_activity(rows).drop("input_tokens", "output_tokens")


@query("host_groups", """WITH e AS (SELECT event_id, ts, (user_id % 10)::VARCHAR AS source, CASE event_type WHEN 'signup' THEN 'sending' WHEN 'view' THEN 'connected' WHEN 'error' THEN 'error' ELSE 'completed' END AS phase FROM events),
g AS (SELECT source, arg_max(phase, (ts, event_id)) AS lp, count(*) FILTER (WHERE phase = 'sending') AS total_items, count(*) FILTER (WHERE phase IN ('completed', 'error')) AS completed_items FROM e GROUP BY 1)
SELECT source, CASE WHEN lp = 'error' THEN 'error' WHEN total_items > 0 AND completed_items >= total_items THEN 'completed' WHEN lp = 'completed' THEN 'streaming' ELSE lp END AS phase, total_items, completed_items FROM g""")
def host_groups(spark, sf_dir):
    t = F.col("event_type")
    e = table(spark, sf_dir, "events").select("event_id", "ts", (F.col("user_id") % 10).cast("string").alias("source"), F.lit("m").alias("model_name"), F.lit("x").alias("label"),
        F.when(t == "signup", "sending").when(t == "view", "connected").when(t == "error", "error").otherwise("completed").alias("phase"), F.lit(1).alias("input_tokens"), F.lit(1).alias("output_tokens"), F.lit(None).cast("string").alias("error"))
    return J.host_groups(e).select("source", "phase", "total_items", "completed_items")


def _messages(spark, sf_dir):
    """Conversation turns as streamed messages: words become deltas in two wire formats."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", " ")).alias("i", "w"))
    fmt = F.when(F.col("conv_id") % 2 == 0, "anthropic").otherwise("openai")
    word = F.concat("w", F.lit(" "))
    block = F.to_json(F.struct(F.struct(word.alias("text")).alias("delta"), F.struct(F.lit(7).alias("input_tokens"), F.col("i").alias("output_tokens")).alias("usage")))
    flat = F.to_json(F.struct(F.array(F.struct(F.struct(word.alias("content")).alias("delta"))).alias("choices"), F.struct(F.lit(7).alias("prompt_tokens"), F.col("i").alias("completion_tokens")).alias("usage")))
    return c.select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("request_id"), F.col("i").cast("long").alias("seq"), fmt.alias("format"), F.when(fmt == "anthropic", block).otherwise(flat).alias("json"))


@query("delta_assembly", "SELECT conv_id || '-' || turn AS request_id, sha256(text || ' ') AS digest FROM conversations")
def delta_assembly(spark, sf_dir):
    return J.assembled(J.with_deltas(_messages(spark, sf_dir))).select("request_id", F.sha2("body", 256).alias("digest"))


@query("delta_usage", "SELECT conv_id || '-' || turn AS request_id, 7::BIGINT AS input_tokens, (len(string_split(text, ' ')) - 1)::BIGINT AS output_tokens FROM conversations")
def delta_usage(spark, sf_dir):
    return J.usage(J.with_deltas(_messages(spark, sf_dir)))


@query("tool_calls", """WITH n AS (SELECT l_orderkey, l_linenumber, string_agg(l_partkey || ';', '' ORDER BY l_partkey, l_suppkey, l_quantity) AS args, count(*) AS n FROM lineitem GROUP BY 1, 2)
SELECT l_orderkey::VARCHAR AS request_id, l_linenumber AS index, 'call' || l_linenumber AS call_id, 'tool' || l_linenumber AS name, args AS arguments FROM n""")
def tool_calls(spark, sf_dir):
    """Lines of an order as argument fragments of its calls, a call per line number."""
    li = spread(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))
    k, i = F.col("l_orderkey"), F.col("l_linenumber")
    seq = F.col("l_partkey") * 10_000_000 + F.col("l_suppkey") * 100 + F.col("l_quantity").cast("long")
    fmt = F.when(k % 2 == 0, "anthropic").otherwise("openai")
    name = lambda p: F.concat(F.lit(p), i.cast("string"))
    arg = F.concat(F.col("l_partkey").cast("string"), F.lit(";"))
    call = lambda a, n, c: F.array(F.struct(i.alias("index"), c.alias("id"), F.struct(n.alias("name"), a.alias("arguments")).alias("function")))
    none = F.lit(None).cast("string")
    flat = lambda a, n, c: F.to_json(F.struct(F.array(F.struct(F.struct(call(a, n, c).alias("tool_calls")).alias("delta"))).alias("choices")))
    starts = li.select("l_orderkey", "l_linenumber").distinct().select(k.cast("string").alias("request_id"), F.lit(-1).cast("long").alias("seq"), fmt.alias("format"), F.when(fmt == "anthropic", F.to_json(F.struct(
        F.lit("content_block_start").alias("type"), i.alias("index"), F.struct(F.lit("tool_use").alias("type"), name("call").alias("id"), name("tool").alias("name")).alias("content_block")))).otherwise(flat(none, name("tool"), name("call"))).alias("json"))
    parts = li.select(k.cast("string").alias("request_id"), seq.alias("seq"), fmt.alias("format"), F.when(fmt == "anthropic", F.to_json(F.struct(i.alias("index"), F.struct(arg.alias("partial_json")).alias("delta")))).otherwise(flat(arg, none, none)).alias("json"))
    return J.tool_calls(starts.unionByName(parts)).select("request_id", "index", "call_id", "name", "arguments")
