"""The registered queries of this folder and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import audit, binary, exact, language, lines, mixing, near, packing, pii, quality, toxicity, urls, whitening

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op2_packing")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


@query("op3_exact", """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
""")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.decide(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


@query("op4_mixing", r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
    -ln((('0x' || substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0)
      / greatest(coalesce(CASE WHEN length(text) > 0 THEN length(regexp_replace(text, '[^\p{L}]', '', 'g')) / length(text) END, 0.0), 0.05) AS key
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS n FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][(n - 1) % 3 + 1] AS w, 2 * source_size AS cap FROM s),
l AS (SELECT *, (1.5::DOUBLE * CAST(sum(source_size) OVER () AS DOUBLE) - CAST(coalesce(sum(cap) OVER o, 0) AS DOUBLE)) / CAST(sum(w) OVER () - coalesce(sum(w) OVER o, 0) AS DOUBLE) AS level
  FROM w WINDOW o AS (ORDER BY cap / w, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(CAST(cap AS DOUBLE), w * (SELECT max(level) FROM l WHERE level <= cap / w)) AS target FROM l),
g AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS turns FROM t),
r AS (SELECT d.doc_id, d.size, g.source_size, g.target, g.turns, CAST(floor(g.target) AS BIGINT) - g.turns * g.source_size AS left_over,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(turns * size + least(size, greatest(0, left_over - before)) AS BIGINT) AS taken FROM r
""")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


QUALITY_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
f AS (SELECT doc_id, unnest(range(1, CAST(len(words) AS BIGINT) - 3)) AS i, words FROM d WHERE len(words) >= 5),
x AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, words[i], words[i + 1], words[i + 2], words[i + 3], words[i + 4]) AS c FROM f),
p AS (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM x WHERE c > 1),
r AS (SELECT doc_id, CAST(sum(least(5, coalesce(nxt - i, 5))) AS BIGINT) AS n FROM p GROUP BY doc_id),
s AS (SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(words) AS w FROM d) WHERE lower(w) IN ({stops}) GROUP BY doc_id),
m AS (SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(list_aggregate(words, 'string_agg', '')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(r.n, 0) AS n_repeat_words,
    list_filter(string_split(text, chr(10)), lambda s: regexp_matches(s, '[^\x20\x09-\x0D]')) AS lines,
    coalesce(s.n, 0) AS stops
  FROM d LEFT JOIN r ON d.doc_id = r.doc_id LEFT JOIN s ON d.doc_id = s.doc_id),
n AS (SELECT doc_id, n_words, coalesce(word_chars, 0) AS word_chars, n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, n_repeat_words, len(lines) AS n_lines, stops,
    n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND word_chars / n_words BETWEEN 1.5 AND 25 AND n_symbols / n_words <= 0.5 AND (n_words < 50 OR stops / n_words >= 0.005) AND (n_lines < 3 OR n_dup_lines / n_lines <= 0.5) AS kept
FROM n
""".replace("{stops}", ", ".join(f"'{w}'" for w in sorted(set(quality.STOP_WORDS.split()))))


@query("op8_quality", QUALITY_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op6_url_filter")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", "p_block")


@query("op7_language")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language.predict(docs.select("doc_id", "text"), language.fit(language.learning_rows(docs)))
    return found.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score")


@query("op1_toxicity")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("grade")))
    return toxicity.score(docs, model)


@query("op9_surrogates")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The key of this query over made-up documents; a user passes a secret one.
    done = pii.pseudonymised(table(spark, sf_dir, "documents"), b"key of the test tables")
    kinds = F.array_sort(F.array_distinct(F.col("entities.kind")))
    return done.select("doc_id", F.size("entities").cast("long").alias("n_entities"), kinds.alias("kinds"), F.col("entities.surrogate").alias("surrogates"), "text")


@query("op5_near")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.groups(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "group_size", "kept")


@query("op10_binary_ids")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binary.round_trip(table(spark, sf_dir, "documents"))


@query("op11_lines", r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
x AS (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS pos, unnest(ls) AS line FROM d),
k AS (SELECT doc_id, pos, line, translate(trim(line, chr(32) || chr(9) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM x),
f AS (SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.doc_id, k.pos, k.line, coalesce(k.doc_id <> f.top, false) AS lost FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE lost) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT lost), '')) AS kept_sha256
FROM m GROUP BY doc_id
""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = lines.drop_lines(table(spark, sf_dir, "documents"))
    return done.select("_doc.doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


@query("op12_whitening")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.by_component(whitening.whiten(table(spark, sf_dir, "embeddings")))


@query("op13_audit", r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
j AS (SELECT d.part, coalesce(l.good, false) AS good, coalesce(l.toxic, false) AS toxic,
    CASE WHEN len(words) < 100 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 2 ELSE 0 END
    + CASE WHEN 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 10 * length(text) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN d.doc_id > min(d.doc_id) OVER (PARTITION BY text) THEN 16 ELSE 0 END AS f
  FROM d LEFT JOIN l ON d.doc_id = l.doc_id),
g AS (SELECT part, good, toxic, f, count(*) AS n FROM j GROUP BY ALL),
b AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c, unnest([1, 2, 4, 8, 16]) AS v),
o AS (SELECT a.c || b.c || c.c || d.c || e.c AS filter_order, [a.v, b.v, c.v, d.v, e.v] AS vs FROM b a, b, b c, b d, b e WHERE a.v + b.v + c.v + d.v + e.v = 31 AND a.v | b.v | c.v | d.v | e.v = 31),
s AS (SELECT filter_order, step, vs[step] AS own, CAST(coalesce(list_sum(vs[1:step - 1]), 0) AS BIGINT) AS earlier FROM o, (SELECT CAST(unnest(range(1, 6)) AS INTEGER) AS step)),
x AS (SELECT g.*, s.*, f & own > 0 AS fails, f & earlier > 0 AS gone FROM g, s)
SELECT part, filter_order, step, CAST(sum(CASE WHEN NOT fails AND NOT gone THEN n ELSE 0 END) AS BIGINT) AS kept, CAST(sum(CASE WHEN fails AND NOT gone THEN n ELSE 0 END) AS BIGINT) AS removed,
  CAST(sum(CASE WHEN fails AND gone THEN n ELSE 0 END) AS BIGINT) AS redundant, CAST(sum(CASE WHEN f = own THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
  CAST(sum(CASE WHEN fails AND NOT gone AND good THEN n ELSE 0 END) AS BIGINT) AS good_lost, CAST(sum(CASE WHEN fails AND NOT gone AND toxic THEN n ELSE 0 END) AS BIGINT) AS toxic_lost,
  CAST(sum(CASE WHEN fails THEN n * (120 // bit_count(f)) ELSE 0 END) AS BIGINT) AS shapley
FROM x GROUP BY part, filter_order, step
""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
