"""Latest-per-key, change application and stage queries over events, orders and lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import metrics, retrieval, revisions
from lectern.queries import query
from lectern.queries.tables import EVENT_BLOCKS, event_blocks, table

ORD = ["ts", "event_id"]


def _events(spark, sf_dir):
    return event_blocks(table(spark, sf_dir, "events"))


@query("latest_state", "SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def latest_state(spark, sf_dir):
    return revisions.latest(table(spark, sf_dir, "events"), ["user_id", "event_type"], ORD).select("user_id", "event_type", "event_id", "value")


@query("latest_usable", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE event_type IN ('view', 'click')) WHERE r = 1")
def latest_usable(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("status", F.when(F.col("event_type") == "view", "completed").when(F.col("event_type") == "click", "partial").otherwise("failed"))
    return revisions.keep_published(e, "user_id", ORD).select("user_id", "event_id", "event_type")


@query("response_history", """WITH q AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'user'), a AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations WHERE role = 'assistant')
SELECT q.conv_id, q.turn, a.turn AS response_revision, sha256(a.text) AS digest FROM q LEFT JOIN a ON a.conv_id = q.conv_id AND r = 1""")
def response_history(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    answers = c.where("role = 'assistant'").select("conv_id", F.col("turn").alias("revision"), F.col("text").alias("answer"))
    rows = revisions.latest_with_history(answers, c.where("role = 'user'").select("conv_id", "turn"), ["conv_id"])
    return rows.select("conv_id", "turn", "response_revision", F.sha2("answer", 256).alias("digest"))


@query("next_revision", """WITH ex AS (SELECT user_id, count(*) AS top FROM events WHERE event_type = 'signup' GROUP BY 1)
SELECT event_id, user_id, (coalesce(top, 0) + row_number() OVER (PARTITION BY e.user_id ORDER BY ts, event_id))::BIGINT AS revision FROM events e LEFT JOIN ex USING (user_id) WHERE event_type <> 'signup'""")
def next_revision(spark, sf_dir):
    e = _events(spark, sf_dir)
    existing = e.where("event_type = 'signup'").groupBy("user_id").agg(F.count(F.lit(1)).alias("revision"))
    return revisions.next_revision(existing, e.where("event_type <> 'signup'"), ["user_id"], ORD, blocks=EVENT_BLOCKS).select("event_id", "user_id", "revision")


@query("next_revision_ranged", "SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey)::BIGINT AS revision FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)")
def next_revision_ranged(spark, sf_dir):
    """The same numbering without natural blocks: over range partitions."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").distinct()
    none = rows.where("false").select("l_partkey", F.lit(0).alias("revision"))
    return revisions.next_revision(none, rows, ["l_partkey"], ["l_orderkey"]).select("l_orderkey", "l_partkey", "revision")


@query("upsert_orders", """WITH c AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) AS r FROM lineitem WHERE l_returnflag = 'R')
SELECT o_orderkey AS id, CASE WHEN r = 1 THEN 'part ' || l_partkey ELSE o_orderpriority END AS title, o_orderdate AS created_at FROM orders LEFT JOIN c ON l_orderkey = o_orderkey AND r = 1""")
def upsert_orders(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("title"), F.col("o_orderdate").alias("created_at"))
    li = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'")
    changes = li.select(F.col("l_orderkey").alias("id"), F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("title"), F.col("l_shipdate").alias("created_at"), "l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice")
    return revisions.upsert(o, changes, ["id"], ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice"], keep=["created_at"])


@query("insert_missing", """WITH t AS (SELECT o_custkey AS k, o_orderstatus AS r, o_orderkey AS id FROM orders WHERE o_orderkey % 2 = 0), n AS (SELECT o_custkey AS k, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderstatus END AS r, o_orderkey AS id FROM orders WHERE o_orderkey % 2 = 1)
SELECT * FROM t UNION ALL SELECT * FROM n WHERE r IS NULL UNION ALL SELECT k, r, min(id) FROM n WHERE r IS NOT NULL AND (k, r) NOT IN (SELECT (k, r) FROM t) GROUP BY k, r""")
def insert_missing(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderstatus").alias("r"), F.col("o_orderkey").alias("id"))
    fresh = o.where("id % 2 = 1").withColumn("r", F.when(F.col("r") != "P", F.col("r")))
    return revisions.insert_missing(o.where("id % 2 = 0"), fresh, ["k", "r"], ["id"], null_distinct=["r"])


@query("carry_forward", """SELECT event_id, last_value(CASE WHEN event_type = 'view' THEN value END IGNORE NULLS) OVER w AS current_page, last_value(CASE WHEN event_type = 'click' THEN value END IGNORE NULLS) OVER w AS current_section
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def carry_forward(spark, sf_dir):
    e = _events(spark, sf_dir).withColumn("page", F.when(F.col("event_type") == "view", F.col("value"))).withColumn("section", F.when(F.col("event_type") == "click", F.col("value")))
    return revisions.carry_forward(e, ["user_id"], ORD, EVENT_BLOCKS, ["page", "section"]).select("event_id", "current_page", "current_section")


@query("favorite_since", """WITH e AS (SELECT *, value > 20 AS fav FROM events), p AS (SELECT *, coalesce(lag(fav) OVER (PARTITION BY user_id ORDER BY ts, event_id), false) AS was FROM e)
SELECT event_id, CASE WHEN fav THEN last_value(CASE WHEN fav AND NOT was THEN ts END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) END AS favorited_at FROM p""")
def favorite_since(spark, sf_dir):
    e = _events(spark, sf_dir).withColumn("fav", F.col("value") > 20)
    return revisions.favorite_since(e, ["user_id"], ORD, EVENT_BLOCKS, "fav", "ts").select("event_id", "favorited_at")


@query("cascade_delete", """WITH d AS (SELECT c_custkey FROM customer WHERE c_acctbal < 0) SELECT 'papers' AS t, c_custkey::VARCHAR AS id FROM customer WHERE c_custkey NOT IN (SELECT * FROM d)
UNION ALL SELECT 'turns', o_orderkey::VARCHAR FROM orders WHERE o_custkey NOT IN (SELECT * FROM d)
UNION ALL SELECT 'notes', l_orderkey || '/' || l_partkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT * FROM d))""")
def cascade_delete(spark, sf_dir):
    c, o, li = (table(spark, sf_dir, n) for n in ("customer", "orders", "lineitem"))
    text = lambda k: F.col(k).cast("string")
    tables = {
        "papers": (c.select(text("c_custkey").alias("id")), "", ""),
        "turns": (o.select(text("o_orderkey").alias("id"), text("o_custkey").alias("paper_id")), "papers", "paper_id"),
        "notes": (li.select(F.concat_ws("/", text("l_orderkey"), text("l_partkey")).alias("id"), text("l_orderkey").alias("turn_id")), "turns", "turn_id"),
    }
    left = revisions.cascade_delete(tables, "papers", c.where("c_acctbal < 0").select(text("c_custkey").alias("id")))
    parts = [df.select(F.lit(n).alias("t"), "id") for n, df in left.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("refuse_referenced", "SELECT c_custkey AS id, c_custkey IN (SELECT o_custkey FROM orders) AS refused FROM customer")
def refuse_referenced(spark, sf_dir):
    wanted = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    allowed, refused = revisions.refuse_referenced(wanted, table(spark, sf_dir, "orders"), "o_custkey")
    return allowed.withColumn("refused", F.lit(False)).unionByName(refused.withColumn("refused", F.lit(True)))


@query("replace_children", "SELECT l_orderkey, l_partkey, 'old' AS v FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') UNION ALL SELECT o_orderkey, 0, 'new' FROM orders WHERE o_orderstatus = 'P'")
def replace_children(spark, sf_dir):
    old = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", F.lit("old").alias("v"))
    fresh = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(0).cast("long").alias("l_partkey"), F.lit("new").alias("v"))
    return revisions.replace_children(old, fresh, "l_orderkey")


@query("terminal_guard", """WITH t AS (SELECT user_id, min((ts, event_id)) AS at, arg_min(event_type, (ts, event_id)) AS f FROM events WHERE event_type IN ('purchase', 'error') GROUP BY 1)
SELECT event_id FROM events e LEFT JOIN t USING (user_id) WHERE t.at IS NULL OR (ts, event_id) <= t.at OR event_type = f""")
def terminal_guard(spark, sf_dir):
    return revisions.terminal_guard(table(spark, sf_dir, "events"), "user_id", ORD, "event_type", ["purchase", "error"]).select("event_id")


@query("move_membership", """WITH m AS (SELECT user_id, arg_max(CASE WHEN event_type = 'error' THEN -1 ELSE event_id % 7 END, (ts, event_id)) AS c FROM events WHERE event_type IN ('click', 'error') GROUP BY 1)
SELECT user_id AS paper_id, c AS collection_id FROM m WHERE c >= 0 UNION ALL SELECT c_custkey, c_nationkey FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM m)""")
def move_membership(spark, sf_dir):
    current = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("paper_id"), F.col("c_nationkey").cast("long").alias("collection_id"))
    moves = table(spark, sf_dir, "events").where("event_type in ('click', 'error')").select(F.col("user_id").alias("paper_id"), F.when(F.col("event_type") == "click", F.col("event_id") % 7).alias("collection_id"), "ts", "event_id")
    return revisions.move_membership(current, moves, ORD)


@query("activate_compressions", "SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 'compressed' ELSE 'raw' END AS mode, CASE WHEN p_partkey % 3 = 0 THEN p_size ELSE 100 END AS estimated_tokens FROM part")
def activate_compressions(spark, sf_dir):
    part, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    items = part.select(k.alias("id"), F.lit("raw").alias("mode"), F.lit(100).alias("estimated_tokens"), F.sha2("p_name", 256).alias("source_hash"), F.lit(None).cast("long").alias("active_compression_id"))
    comp = part.select(k.alias("id"), k.alias("context_item_id"), F.when(k % 3 == 0, F.sha2("p_name", 256)).otherwise(F.lit("old")).alias("source_hash"), F.col("p_size").alias("estimated_tokens"))
    done, _ = revisions.activate_compressions(items, part.select(k.alias("compression_id"), F.lit(1).alias("requested_at")), comp)
    return done.select("id", "mode", "estimated_tokens")


@query("append_revisions", """WITH r AS (SELECT p_partkey, 1 + (l.n > 0)::INT * l.n AS x FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) l ON l_partkey = p_partkey)
SELECT p_partkey AS block_id, max(1 + coalesce(n, 0))::BIGINT AS top, (CASE WHEN max(coalesce(n, 0)) > 0 THEN 'new' ELSE 'old' END) AS points_to FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) l ON l_partkey = p_partkey GROUP BY 1""")
def append_revisions(spark, sf_dir):
    """Every returned line saves a new revision of its part's record; annotations follow."""
    part, li = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'")
    k = F.col("p_partkey")
    records = part.select(F.concat(F.lit("old"), k.cast("string")).alias("id"), k.alias("block_id"), F.lit(1).cast("long").alias("revision"))
    saved = li.select(F.concat_ws("/", F.lit("new"), F.col("l_orderkey").cast("string"), F.xxhash64(*li.columns).cast("string")).alias("id"), F.col("l_partkey").alias("block_id"))
    notes = part.select(k.alias("block_id"), F.concat(F.lit("old"), k.cast("string")).alias("related_id"))
    merged, pointed = revisions.append_and_repoint(records, saved, notes, ["block_id"], ["id"])
    top = merged.groupBy("block_id").agg(F.max("revision").alias("top"))
    return top.join(pointed, "block_id").select("block_id", "top", F.left("related_id", F.lit(3)).alias("points_to"))


@query("runs_per_profile", "WITH t AS (SELECT o_custkey, max(o_orderdate) AS d FROM orders GROUP BY 1) SELECT o.o_custkey AS profile_id, max(o_orderkey) AS id, count(*) AS ties FROM orders o JOIN t ON t.o_custkey = o.o_custkey AND o.o_orderdate = t.d GROUP BY 1")
def runs_per_profile(spark, sf_dir):
    runs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("profile_id"), F.col("o_orderdate").alias("created_at"))
    tied, one = revisions.runs_per_profile(runs)
    return one.select("profile_id", "id").join(tied.groupBy("profile_id").agg(F.count(F.lit(1)).alias("ties")), "profile_id")


@query("question_revisions", """WITH p AS (SELECT *, lag(event_type || '|' || (event_id % 2)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events)
SELECT event_id, sum(CASE WHEN b IS NULL OR b <> event_type || '|' || (event_id % 2) THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS question_revision FROM p""")
def question_revisions(spark, sf_dir):
    e = _events(spark, sf_dir).withColumn("snap", (F.col("event_id") % 2).cast("string"))
    return revisions.question_revisions(e, "user_id", ORD, EVENT_BLOCKS, "event_type", "snap").select("event_id", "question_revision")


@query("merge_manual", "SELECT o_orderkey AS paper_id, CASE WHEN o_orderkey % 3 = 0 THEN 'mine' ELSE o_orderpriority END AS title, CASE WHEN o_orderkey % 3 = 1 THEN NULL ELSE o_orderstatus END AS venue FROM orders")
def merge_manual(spark, sf_dir):
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    parsed = o.select(k.alias("paper_id"), F.col("o_orderpriority").alias("title"), F.col("o_orderstatus").alias("venue"))
    old = o.where(k % 3 != 2).select(k.alias("paper_id"), F.when(k % 3 == 0, F.lit('{"title": "mine"}')).otherwise(F.lit('{"venue": null}')).alias("manual"))
    return revisions.merge_manual(old, parsed, ["title", "venue"]).drop("manual")


@query("recover_interrupted", "SELECT event_id, CASE WHEN event_type IN ('view', 'click') THEN 'QUEUED' ELSE event_type END AS status, CASE WHEN event_type = 'view' THEN 'Recovered' ELSE props END AS message FROM events")
def recover_interrupted(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("status"), F.when(F.col("event_type") != "view", F.col("props")).alias("message"))
    return revisions.recover_interrupted(e, "status", ["view", "click"], "QUEUED", "Recovered", "message", keep_first=True)


@query("backfill_annotations", """WITH l AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id DESC) AS r FROM events)
SELECT user_id AS paper_id, event_type AS block_id, event_id AS related_id, 'translation' AS annotation_type FROM l WHERE r = 1""")
def backfill_annotations(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("paper_id"), F.col("event_type").alias("block_id"), F.lit(0).alias("source_start"), F.lit(1).alias("source_end"), F.col("value").alias("revision"))
    return revisions.backfill_annotations(e, ["paper_id", "block_id"], "translation").select("paper_id", "block_id", "related_id", "annotation_type")


@query("backfill_collections", "SELECT o_orderkey AS paper_id, 'collection-' || sha256(lower(o_orderpriority))[1:16] AS collection_id, min(o_orderdate) AS assigned_at FROM orders GROUP BY 1, 2")
def backfill_collections(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    name = F.when(F.col("o_orderkey") % 2 == 0, F.upper("o_orderpriority")).otherwise(F.concat(F.lit(" "), F.lower("o_orderpriority")))
    _, members = revisions.backfill_collections(o.select(F.col("o_orderkey").alias("paper_id"), name.alias("collection_name"), F.col("o_orderdate").alias("created_at")))
    return members


# --------------------------------------------------------------------- stages and calls


def _stages(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("position")).agg(F.min("l_returnflag").alias("f"))
    return li.select("run_id", "position", F.when(F.col("f") == "R", "failed").otherwise("completed").alias("status"))


@query("stage_gate", """WITH s AS (SELECT l_orderkey AS run_id, l_linenumber AS position, CASE WHEN min(l_returnflag) = 'R' THEN 'failed' ELSE 'completed' END AS status FROM lineitem GROUP BY 1, 2),
r AS (SELECT run_id, min(position) FILTER (WHERE status <> 'completed') AS resume_at, min(position) AS f FROM s GROUP BY 1)
SELECT s.run_id, s.position, s.status, s.position = r.f OR coalesce(b.status, '') = 'completed' AS may_run, r.resume_at, CASE WHEN s.position >= r.resume_at THEN 'pending' ELSE s.status END AS status_on_retry
FROM s JOIN r USING (run_id) LEFT JOIN s b ON b.run_id = s.run_id AND b.position = s.position - 1""")
def stage_gate(spark, sf_dir):
    return metrics.stage_gate(_stages(spark, sf_dir))


@query("last_region_artifact", "SELECT l_orderkey AS job_id, max(l_linenumber) AS position FROM lineitem WHERE l_discount > 0.05 GROUP BY 1")
def last_region_artifact(spark, sf_dir):
    a = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").alias("position"), F.when(F.col("l_discount") > 0.05, 3).otherwise(0).alias("total_regions"))
    return metrics.last_region_artifact(a).select("job_id", "position")


@query("judge_calls", """SELECT l_orderkey AS run_id, l_partkey AS part, l_suppkey AS supp, l_linenumber AS line, 'tool' || (l_partkey % 6) AS tool_name,
  CASE WHEN l_partkey % 6 IN (SELECT n_nationkey FROM nation WHERE n_nationkey < 4) AND l_partkey % 6 <= l_orderkey % 5 AND (l_orderkey % 2 = 0 OR l_partkey % 6 = 1) THEN 'allowed' ELSE 'denied' END AS decision FROM lineitem""")
def judge_calls(spark, sf_dir):
    li, o, n = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "nation"))
    k = F.col("o_orderkey")
    tool = lambda c: F.concat(F.lit("tool"), c.cast("string"))
    registry = n.where("n_nationkey < 4").select(tool(F.col("n_nationkey")).alias("tool_name"))
    runs = o.select(k.alias("run_id"), (k % 5).alias("profile_id"), F.when(k % 2 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("tool1"))).alias("snapshot_tools"))
    profiles = n.where("n_nationkey < 5").select(F.col("n_nationkey").cast("long").alias("profile_id"), F.transform(F.sequence(F.lit(0), F.col("n_nationkey")), tool).alias("allowed"))
    calls = li.select(F.col("l_orderkey").alias("run_id"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"), F.col("l_linenumber").alias("line"), tool(F.col("l_partkey") % 6).alias("tool_name"))
    return retrieval.judge_calls(calls, runs, profiles, registry).select("run_id", "part", "supp", "line", "tool_name", "decision")


@query("visible_tools", "SELECT c_custkey AS profile_id, i AS pos, 'NATION_' || (c_custkey % 20 + i * 3) AS tool_name FROM customer, (VALUES (0), (1), (2)) t(i) WHERE c_custkey % 20 + i * 3 < 25")
def visible_tools(spark, sf_dir):
    k = F.col("c_custkey") % 20
    profiles = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("profile_id"), F.array(*[F.concat(F.lit("NATION_"), (k + i * 3).cast("string")) for i in range(3)]).alias("allowed"))
    return retrieval.visible_tools(profiles, table(spark, sf_dir, "nation").select(F.col("n_name").alias("tool_name"))).select("profile_id", "pos", "tool_name")


@query("replay_safe", """WITH o AS (SELECT user_id AS run_id, event_id // 3 AS tool_call_id, min(event_id) AS event_id FROM events GROUP BY 1, 2), u AS (SELECT *, event_id % 9 AS iteration FROM o WHERE event_id % 9 BETWEEN 1 AND 6),
r AS (SELECT *, row_number() OVER (PARTITION BY run_id, iteration ORDER BY event_id) AS call_no FROM u) SELECT run_id, event_id, iteration, call_no::INT AS call_no FROM r WHERE call_no <= 8""")
def replay_safe(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.floor(F.col("event_id") / 3).alias("tool_call_id"), "event_id", (F.col("event_id") % 9).alias("iteration"))
    return metrics.call_answers(e, ["event_id"]).where("not replayed").select("run_id", "event_id", "iteration", "call_no")
