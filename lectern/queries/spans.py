"""Span joins, run cutting, reprojection, term placement and response alignment."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import segments as S
from lectern.operators import spans
from lectern.queries import query
from lectern.queries.tables import table
from lectern.queries.text import SENTENCES
from lectern.session import checkpointed, spread
from lectern.skew import exploded


def _texts(spark, sf_dir):
    return S.with_sentences(spread(table(spark, sf_dir, "documents")).select("doc_id", "text"), "text")


def _runs(spark, sf_dir):
    return exploded(_texts(spark, sf_dir), "sentences", "s", F.col("doc_id").alias("block_id"), pos="run_id").select("block_id", "run_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"))


def _marks(spark, sf_dir):
    """A 60-character mark every 150 characters."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("block_id"), F.posexplode(F.sequence(F.lit(0), F.length("text"), F.lit(150))).alias("range_id", "r_start"))
    return d.withColumn("r_end", F.col("r_start") + 60)


MARKS = "marks AS (SELECT doc_id, unnest(range(0, length(text) + 1, 150)) AS r_start FROM documents)"


@query("span_overlap", f"WITH {SENTENCES}, {MARKS} SELECT s.doc_id AS block_id, n AS run_id, (r_start / 150)::INT AS range_id FROM sent s JOIN marks m ON s.doc_id = m.doc_id AND s_start < r_start + 60 AND s_end > r_start")
def span_overlap(spark, sf_dir):
    return spans.overlap_join(_runs(spark, sf_dir), _marks(spark, sf_dir)).select("block_id", "run_id", "range_id")


CUTS = f"""WITH {SENTENCES}, {MARKS},
tr AS (SELECT doc_id, s_start AS a, s_end AS b, n % 2 = 0 AS active FROM sent),
pts AS (SELECT m.doc_id, unnest([r_start, r_start + 60]) AS p, length(text) AS n FROM marks m JOIN documents d ON d.doc_id = m.doc_id WHERE r_start < length(text)),
free AS (SELECT DISTINCT doc_id, least(p, n) AS cut FROM pts ANTI JOIN (SELECT * FROM tr WHERE active) x ON pts.doc_id = x.doc_id AND pts.p > x.a AND pts.p < x.b),
cuts AS (SELECT doc_id, 0 AS cut FROM documents WHERE text <> '' UNION SELECT doc_id, length(text) // 2 FROM documents WHERE text <> '' UNION SELECT doc_id, length(text) FROM documents WHERE text <> '' UNION SELECT doc_id, unnest([a, b]) FROM tr UNION SELECT doc_id, cut FROM free),
runs AS (SELECT doc_id, cut AS s_start, lead(cut) OVER (PARTITION BY doc_id ORDER BY cut) AS s_end FROM cuts)"""


def _cut(spark, sf_dir):
    """Two text nodes in each document; sentences are its (stored) translations."""
    half = F.floor(F.length("text") / 2).cast("int")
    ends = F.array(F.struct(F.lit(0).alias("start"), half.alias("end")), F.struct(half.alias("start"), F.length("text").alias("end")))
    nodes = table(spark, sf_dir, "documents").where("text <> ''").select(F.col("doc_id").alias("block_id"), F.posexplode(ends).alias("node_id", "n")).select("block_id", "node_id", "n.start", "n.end")
    t = checkpointed(_runs(spark, sf_dir)).select("block_id", F.col("run_id").alias("range_id"), F.col("start").alias("r_start"), F.col("end").alias("r_end"), (F.col("run_id") % 2 == 0).alias("active"))
    return nodes, t, _marks(spark, sf_dir)


@query("cut_runs", CUTS + " SELECT doc_id AS block_id, s_start::INT AS s_start, s_end::INT AS s_end FROM runs WHERE s_end IS NOT NULL")
def cut_runs(spark, sf_dir):
    return spans.cut_runs(*_cut(spark, sf_dir)).select("block_id", F.col("start").alias("s_start"), F.col("end").alias("s_end"))


@query("run_markers", CUTS + """, r AS (SELECT * FROM runs WHERE s_end IS NOT NULL),
rs AS (SELECT *, unnest(range(s_start // 512, (greatest(s_end - 1, s_start)) // 512 + 1)) AS w FROM r), ss AS MATERIALIZED (SELECT *, unnest(range(s_start // 512, (greatest(s_end - 1, s_start)) // 512 + 1)) AS w FROM sent),
ms AS (SELECT *, unnest(range(r_start // 512, (r_start + 59) // 512 + 1)) AS w FROM marks),
m AS (SELECT r.doc_id, r.s_start, arg_min(s.n, (NOT (s.s_start = r.s_start AND s.s_end = r.s_end), s.s_start, s.n)) AS translation_id, bool_or(s.n % 2 = 0 AND s.s_start = r.s_start AND s.s_end = r.s_end) AS translated FROM rs r JOIN ss s ON s.doc_id = r.doc_id AND s.w = r.w AND r.s_start < s.s_end AND r.s_end > s.s_start GROUP BY 1, 2),
c AS (SELECT r.doc_id, r.s_start, count(DISTINCT k.r_start) AS n_chats FROM rs r JOIN ms k ON k.doc_id = r.doc_id AND k.w = r.w AND r.s_start < k.r_start + 60 AND r.s_end > k.r_start GROUP BY 1, 2)
SELECT r.doc_id AS block_id, r.s_start::INT AS s_start, coalesce(translation_id, -1)::INT AS translation_id, coalesce(translated, false) AS translated, coalesce(n_chats, 0) AS n_chats FROM r LEFT JOIN m ON m.doc_id = r.doc_id AND m.s_start = r.s_start LEFT JOIN c ON c.doc_id = r.doc_id AND c.s_start = r.s_start""")
def run_markers(spark, sf_dir):
    nodes, t, a = _cut(spark, sf_dir)
    return spans.run_markers(checkpointed(spans.cut_runs(nodes, t, a)), t, a).select("block_id", F.col("start").alias("s_start"), F.coalesce("translation_id", F.lit(-1)).alias("translation_id"), "translated", "n_chats")


def _records(spark, sf_dir):
    segments = F.transform("sentences", lambda s, i: F.struct(F.concat(F.lit("sentence-"), (i + 1).cast("string")).alias("segment_id"), s["start"].alias("start"), s["end"].alias("end")))
    return _texts(spark, sf_dir).select(F.col("doc_id").alias("record_id"), F.col("text").alias("old_text"), segments.alias("segments"))


@query("reproject_spans", f"""WITH {SENTENCES} SELECT s.doc_id AS record_id, 'sentence-' || (n + 1) AS segment_id,
  (s_start + CASE WHEN s.doc_id % 2 = 1 THEN length(regexp_replace(text[1:s_start], '[^ ]', '', 'g')) ELSE 0 END)::INT AS s_start,
  (s_end + CASE WHEN s.doc_id % 2 = 1 THEN length(regexp_replace(text[1:s_end], '[^ ]', '', 'g')) ELSE 0 END)::INT AS s_end,
  CASE WHEN s.doc_id % 2 = 1 AND contains(text, ' ') THEN 'whitespace-remapped' ELSE 'exact' END AS status FROM sent s JOIN documents d ON d.doc_id = s.doc_id""")
def reproject_spans(spark, sf_dir):
    """Half of the texts get every space doubled; all segments must be found again."""
    r = _records(spark, sf_dir)
    new = F.when(F.col("record_id") % 2 == 1, F.replace("old_text", F.lit(" "), F.lit("  "))).otherwise(F.col("old_text"))
    return spans.reproject(r.withColumn("new_text", new)).select("record_id", "segment_id", F.col("start").alias("s_start"), F.col("end").alias("s_end"), "status")


@query("reproject_edited", rf"""WITH RECURSIVE {SENTENCES},
wd AS MATERIALIZED (SELECT s.doc_id, s.n, regexp_replace(trim(text[s_start + 1:s_end], chr(10) || ' '), '\s', ' ', 'g') AS needle FROM documents d JOIN sent s ON d.doc_id = s.doc_id),
nb AS MATERIALIZED (SELECT doc_id, regexp_replace('New opening. ' || regexp_replace(text, '(?s)^(.{{40}}\w*)\w', '\1x'), '\s', ' ', 'g') AS body FROM documents),
rr AS (SELECT doc_id, -1 AS n, 0 AS cur, 0 AS start, false AS alone FROM documents UNION ALL
  SELECT doc_id, n, CASE WHEN ok THEN cur + p - 1 + length(needle) ELSE cur END, CASE WHEN ok THEN cur + p - 1 ELSE 0 END, ok
  FROM (SELECT *, needle <> '' AND p > 0 AND instr(body[cur + p + length(needle):], needle) = 0 AS ok FROM (SELECT wd.doc_id, wd.n, rr.cur, needle, body, instr(body[cur + 1:], needle) AS p FROM rr JOIN wd ON wd.doc_id = rr.doc_id AND wd.n = rr.n + 1 JOIN nb ON nb.doc_id = rr.doc_id)))
SELECT doc_id AS record_id, CASE WHEN alone THEN 'whitespace-remapped' ELSE 'stale' END AS status, count(*) AS n, sum(start)::BIGINT AS starts FROM rr WHERE n >= 0 GROUP BY 1, 2""")
def reproject_edited(spark, sf_dir):
    """Texts with a new opening and one word changed: unique segments move, others go stale."""
    r = _records(spark, sf_dir)
    new = F.concat(F.lit("New opening. "), F.regexp_replace("old_text", r"(?s)^(.{40}\w*)\w", "$1x"))
    out = spans.reproject(r.withColumn("new_text", new))
    return out.groupBy("record_id", "status").agg(F.count(F.lit(1)).alias("n"), F.sum("start").alias("starts"))


@query("reproject_blocks", f"""WITH {SENTENCES}, pp AS (SELECT s.doc_id, n, s_start, s_end, text[1:s_start] AS pre, text[s_start + 1:s_end] AS piece, contains(text, chr(10)) AS lines FROM sent s JOIN documents d ON d.doc_id = s.doc_id),
kk AS (SELECT *, length(pre) - length(replace(pre, chr(10), '')) AS ord, length(pre) - length(regexp_extract(pre, '[^\\n]*$')) AS base, contains(piece, chr(10)) AS lost FROM pp)
SELECT doc_id AS record_id, 'sentence-' || (n + 1) AS segment_id, CASE WHEN NOT lost THEN doc_id || '-' || ord END AS block_id, CASE WHEN lost THEN 0 ELSE s_start - base END::INT AS s_start, CASE WHEN lost THEN 0 ELSE s_end - base END::INT AS s_end,
  CASE WHEN lost THEN 'stale' WHEN lines THEN 'whitespace-remapped' ELSE 'exact' END AS status FROM kk""")
def reproject_blocks(spark, sf_dir):
    """Texts split into a block per line: segments land in blocks, those over two are stale."""
    d = table(spark, sf_dir, "documents")
    blocks = d.select(F.col("doc_id").alias("section_id"), F.posexplode(F.split("text", "\n")).alias("ord", "text"))
    blocks = blocks.withColumn("block_id", F.concat_ws("-", F.col("section_id").cast("string"), F.col("ord").cast("string")))
    r = _records(spark, sf_dir).withColumn("section_id", F.col("record_id"))
    return spans.reproject_across(r, blocks).select("record_id", "segment_id", "block_id", F.col("start").alias("s_start"), F.col("end").alias("s_end"), "status")


@query("pending_blocks", "SELECT doc_id AS block_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def pending_blocks(spark, sf_dir):
    p = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("block_id"), F.when(F.col("quality") == 1, "exact").otherwise("stale").alias("status"))
    return spans.pending_blocks(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("block_id")), p)


@query("passages", "SELECT l_partkey AS block_id, min(l_orderkey) AS record_id FROM lineitem WHERE l_returnflag <> 'R' AND l_linestatus = 'O' GROUP BY 1")
def passages(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    records = li.select(
        F.col("l_partkey").alias("block_id"), F.col("l_orderkey").alias("record_id"), F.col("l_orderkey").alias("created_at"), F.lit(0).alias("start"), F.when(F.col("l_linestatus") == "O", 5000).otherwise(1).alias("end"),
        F.lit("exact").alias("status"), F.when(F.col("l_returnflag") == "R", "word-lookup-v1").otherwise("translate-v1").alias("prompt_version"))
    blocks = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("block_id"), F.col("p_name").alias("text"))
    whole, _ = spans.passages(records, blocks)
    return whole.select("block_id", "record_id")


@query("special_terms", """SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN p_size >= 36 WHEN 1 THEN true WHEN 2 THEN true WHEN 3 THEN length('about ' || p_name) >= 12 WHEN 4 THEN false ELSE false END AS shown FROM part""")
def special_terms(spark, sf_dir):
    part, k = table(spark, sf_dir, "part"), F.col("p_partkey") % 6
    term = F.when(k == 1, F.lit("CNN-2")).when(k == 2, F.lit("any")).when(k == 4, F.lit("existing method")).when(k == 5, F.lit("widget")).otherwise(F.col("p_name"))
    score = F.when(k == 0, F.col("p_size") / 50)
    return part.select("p_partkey", spans.is_special(term, score, F.when(k == 2, F.lit("method")), F.concat(F.lit("about "), "p_name")).alias("shown"))


@query("term_places", r"""WITH w AS (SELECT doc_id, text, trim(regexp_extract(text, '^\S+ (\S+)', 1)) AS needle FROM documents), f AS (SELECT *, instr(text, needle) AS p FROM w WHERE needle <> '')
SELECT doc_id, (p - 1)::INT AS s_start, (p - 1 + length(needle))::INT AS s_end FROM f WHERE instr(text[p + length(needle):], needle) = 0""")
def term_places(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text", F.regexp_extract("text", r"^\S+ (\S+)", 1).alias("needle")).where("needle <> ''")
    none = F.lit(None).cast("int")
    spot = spans.locate_term(F.col("text"), F.col("needle"), none, none)
    return d.select("doc_id", spot.alias("s")).where("s is not null").select("doc_id", F.col("s.start").alias("s_start"), F.col("s.end").alias("s_end"))


@query("free_spans", """WITH RECURSIVE s AS (SELECT l_orderkey, l_partkey % 100 AS a, l_partkey % 100 + l_quantity::INT AS b FROM lineitem), o AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY a, b) AS n FROM s),
r AS (SELECT l_orderkey, n, a, b, b AS cur, true AS keep FROM o WHERE n = 1 UNION ALL SELECT o.l_orderkey, o.n, o.a, o.b, CASE WHEN o.a >= r.cur THEN o.b ELSE r.cur END, o.a >= r.cur FROM r JOIN o ON o.l_orderkey = r.l_orderkey AND o.n = r.n + 1)
SELECT l_orderkey, a::INT AS s_start, b::INT AS s_end FROM r WHERE keep""")
def free_spans(spark, sf_dir):
    """Overlapping spans skipped from left to right."""
    a = (F.col("l_partkey") % 100).cast("int")
    g = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(a.alias("start"), (a + F.col("l_quantity").cast("int")).alias("end"))).alias("s"))
    return g.select("l_orderkey", F.explode(spans.without_overlaps(F.col("s"))).alias("x")).select("l_orderkey", F.col("x.start").alias("s_start"), F.col("x.end").alias("s_end"))


@query("aligned_responses", f"""WITH {SENTENCES} SELECT doc_id AS unit_id, 'sentence-' || (n + 1) AS segment_id, s_start AS a, s_end AS b, CASE WHEN n % 3 <> 2 THEN 'T' || n END AS translated, true AS structured FROM sent WHERE doc_id % 4 <> 0
UNION ALL SELECT doc_id, 'legacy', 0, length(text)::INT, 'plain answer', false FROM documents WHERE doc_id % 4 = 0""")
def aligned_responses(spark, sf_dir):
    t = _texts(spark, sf_dir)
    answered = F.filter(F.transform("sentences", lambda _, i: F.struct(F.concat(F.lit("sentence-"), (i + 1).cast("string")).alias("id"), F.concat(F.lit(" T"), i.cast("string")).alias("translatedText"), i.alias("i"))), lambda s: s["i"] % 3 != 2)
    body = F.concat(F.lit("```json\n"), F.to_json(F.struct(answered.alias("segments"))), F.lit("\n```"))
    rows = t.select(F.col("doc_id").alias("unit_id"), F.col("text").alias("source"), F.when(F.col("doc_id") % 4 == 0, F.lit("plain answer ")).otherwise(body).alias("response"))
    # Responses are stored data, so they are written once like any cache of answers.
    return spans.align_response(checkpointed(rows)).select("unit_id", "segment_id", F.col("start").alias("a"), F.col("end").alias("b"), "translated", "structured")


@query("aligned_terms", f"""WITH {SENTENCES}, w AS (SELECT s.doc_id, n, s_start, text[s_start + 1:s_end] AS piece, regexp_extract(text[s_start + 1:s_end], '[^ ,.]+') AS word FROM sent s JOIN documents d ON d.doc_id = s.doc_id WHERE s.doc_id % 4 <> 0)
SELECT doc_id AS unit_id, 'sentence-' || (n + 1) AS segment_id, word, s_start + instr(piece, word) - 1 AS a, s_start + instr(piece, word) - 1 + length(word) AS b, 0 AS ta, length('T' || n)::INT AS tb FROM w WHERE n % 3 <> 2 AND word <> ''""")
def aligned_terms(spark, sf_dir):
    """The first word of every sentence as a term; a third of the sentences have no translation, and every fourth
    unit has a plain answer, which holds no terms."""
    t = _texts(spark, sf_dir)
    names = F.transform("sentences", lambda s, i: F.struct(F.concat(F.lit("sentence-"), (i + 1).cast("string")).alias("id"), F.concat(F.lit("T"), i.cast("string")).alias("translatedText"), i.alias("i"), s["start"].alias("a"), s["end"].alias("b")))
    answered = F.filter("names", lambda s: s["i"] % 3 != 2)
    word = lambda s: F.regexp_extract(F.substring(F.col("text"), s["a"] + 1, s["b"] - s["a"]), r"[^ ,.]+", 0)
    terms = F.transform("names", lambda s: F.struct(word(s).alias("text"), s["translatedText"].alias("translation"), s["id"].alias("segmentId"), F.lit(-1).alias("sourceStart")))
    body = F.to_json(F.struct(answered.alias("segments"), terms.alias("terms")))
    rows = t.withColumn("names", names).select(F.col("doc_id").alias("unit_id"), F.col("text").alias("source"), F.when(F.col("doc_id") % 4 == 0, F.lit("plain answer ")).otherwise(body).alias("response"))
    out = spans.align_terms(checkpointed(rows))
    return out.select("unit_id", "segment_id", F.col("text").alias("word"), F.col("source_start").alias("a"), F.col("source_end").alias("b"), F.col("translated_start").alias("ta"), F.col("translated_end").alias("tb"))
