"""Text, corpus and context queries over documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import markup as M
from lectern.functions import segments as S
from lectern.functions import text as T
from lectern.operators import context, corpus, retrieval
from lectern.operators.corpus import coarse
from lectern.queries import query
from lectern.queries.tables import SOURCE_PAGES, WS, paragraphs, source_pages, sql_norm, sql_strip, table
from lectern.session import spread
from lectern.skew import assemble_text, exploded, first_rows, placed_text

# ------------------------------------------------------------------ duplicates, budgets


@query("dedup_exact", "SELECT sha256(text) AS digest, min(doc_id) AS canonical_id, count(*) AS n_files FROM documents GROUP BY 1")
def dedup_exact(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    return corpus.exact_duplicates(d, "digest", "doc_id", "doc_id")


BUDGET = """
WITH d AS (SELECT source, greatest(1, ceil(strlen(text) / 4.0))::BIGINT AS tokens FROM documents),
s AS (SELECT source, sum(tokens)::BIGINT AS papers, count(*) AS n_items FROM d GROUP BY 1)
SELECT source, n_items, papers, 4200 AS system_prompt, 7800 AS tools, 0 AS conversation, 0 AS figures, 16000 AS output_reserve, 8000 AS safety_buffer,
  papers + 36000 AS total_tokens, least(100.0, round((papers + 36000) * 100.0 / 128000, 2))::DOUBLE AS percent FROM s"""


@query("token_budget", BUDGET)
def token_budget(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("source", T.token_estimate(F.col("text")).alias("tokens"))
    return context.token_budget(d, "source")


@query("source_fits", "SELECT doc_id, greatest(1, ceil(strlen(text) / 4.0))::BIGINT AS tokens, greatest(1, ceil(strlen(text) / 4.0)) <= 16000 - 1000 - 12000 AS fits FROM documents")
def source_fits(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))
    return d.withColumn("fits", context.source_fits(F.col("tokens"), 16000, 1000))


@query("chat_budget", """
WITH d AS (SELECT source, greatest(1, ceil(strlen(text) / 4.0))::BIGINT AS tokens, lang = 'en' AS packed FROM documents),
s AS (SELECT source, sum(tokens)::BIGINT AS tokens, count(*) FILTER (WHERE NOT packed) AS w FROM d GROUP BY 1)
SELECT source, tokens, 24000 AS budget, tokens > 24000 AS over_budget, CASE WHEN tokens > 24000 THEN w ELSE 0 END AS must_compress FROM s""")
def chat_budget(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(
        F.col("source").alias("scope_id"), T.token_estimate(F.col("text")).alias("tokens"), F.lit("").alias("section_id"),
        F.when(F.col("lang") == "en", "compressed").otherwise("raw").alias("mode"))
    return context.chat_budget(d, 48000, 4000).withColumnRenamed("scope_id", "source")


# --------------------------------------------------------------------- margins, headings

MARGINS = rf"""
WITH p AS ({SOURCE_PAGES}),
l AS (SELECT paper_id, page, unnest(string_split_regex(text, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]')) AS line,
  generate_subscripts(string_split_regex(text, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]'), 1) AS i FROM p),
s AS (SELECT *, {sql_strip('line')} AS st FROM l),
f AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY i) AS a, row_number() OVER (PARTITION BY page ORDER BY i DESC) AS b FROM s WHERE st <> ''),
e AS (SELECT *, regexp_replace(regexp_replace(replace(lower(regexp_replace(st, '^#{{1,6}}\s+', '')), 'ß', 'ss'), '\d+', '#', 'g'), '\s+', ' ', 'g') AS k FROM f
  WHERE (a <= 2 OR b <= 2) AND length(st) <= 160 AND NOT contains(st, '$') AND NOT regexp_matches(st, '^(\||!\[|>|```|<)') AND NOT regexp_matches(st, '\[[^\]]+\]\([^)]+\)')),
n AS (SELECT paper_id, count(*) AS np FROM p GROUP BY 1),
rep AS (SELECT paper_id, k FROM e JOIN n USING (paper_id) WHERE k <> '' GROUP BY paper_id, k, np HAVING count(DISTINCT page) >= greatest(2, floor(np * 0.4 + 0.999))),
gone AS (SELECT e.page, e.i FROM e LEFT JOIN rep ON e.paper_id = rep.paper_id AND e.k = rep.k
  WHERE rep.k IS NOT NULL OR regexp_matches(regexp_replace(st, '^#{{1,6}}\s+', ''), '(?i)^(?:page\s*)?\d{{1,4}}$')),
kept AS (SELECT s.paper_id, s.page, s.i, CASE WHEN regexp_matches(st, '^#{{1,6}}\s+\d{{1,4}}\s*$') THEN regexp_replace(st, '^#{{1,6}}\s+', '') ELSE line END AS line
  FROM s ANTI JOIN gone ON s.page = gone.page AND s.i = gone.i),
t AS (SELECT page, string_agg(line, chr(10) ORDER BY i) AS body FROM kept GROUP BY 1),
r AS (SELECT page, count(*) AS removed FROM gone GROUP BY 1)
SELECT p.paper_id, p.page, coalesce(removed, 0)::INT AS removed, sha256({sql_strip("coalesce(body, '')")}) AS digest FROM p LEFT JOIN t USING (page) LEFT JOIN r USING (page)"""


@query("boilerplate_lines", MARGINS)
def boilerplate_lines(spark, sf_dir):
    cleaned = corpus.remove_margins(source_pages(spark, sf_dir))
    return cleaned.select("paper_id", "page", "removed", F.sha2("text", 256).alias("digest"))


def _web_pages(spark, sf_dir):
    """Web pages of a host as the pages of one paper, block tags read as markdown lines."""
    p = table(spark, sf_dir, "pages")
    body = F.regexp_extract("html", r"(?s)<body>(.*)</body>", 1)
    text = F.regexp_replace(body, r"<h1>", "\n# ")
    text = F.regexp_replace(text, r"</h1>|</?p>|<br>|</li>|</div>|</nav>|</article>|</footer>", "\n")
    text = F.concat(T.capital(F.regexp_extract("html", r"<a href=\"[^\"]*\">([^<]*)</a>", 1)), F.lit(" INDEX\n"), F.regexp_replace(text, r"<[^>]*>", ""))
    host = F.regexp_extract("url", r"^https?://([^/]+)", 1)
    return p.select(F.regexp_replace(host, r"^.*\.(\w+)$", "$1").alias("paper_id"), F.col("page_id").alias("page"), text.alias("text"))


WEB = r"""SELECT regexp_replace(regexp_extract(url, '^https?://([^/]+)', 1), '^.*\.(\w+)$', '\1') AS paper_id, page_id AS page,
  upper(regexp_extract(html, '<a href="[^"]*">([^<]*)</a>', 1)) || ' INDEX' || chr(10) ||
  regexp_replace(regexp_replace(regexp_replace(regexp_extract(html, '(?s)<body>(.*)</body>', 1), '<h1>', chr(10) || '# ', 'g'), '</h1>|</?p>|<br>|</li>|</div>|</nav>|</article>|</footer>', chr(10), 'g'), '<[^>]*>', '', 'g') AS text FROM pages"""


def sql_clean(value: str) -> str:
    return f"trim(regexp_replace(rtrim(trim({sql_strip(value)}, '#*_` '), ':'), '{WS}+', ' ', 'g'))"


KNOWN = ", ".join(f"'{n}'" for n in T.SECTION_NAMES)
LINES = rf"""
w AS ({WEB}),
l AS (SELECT paper_id, page, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM w),
a AS (SELECT *, {sql_strip('line')} AS st FROM l),
b AS (SELECT *, {sql_clean('st')} AS ti, {sql_clean("regexp_extract(st, '^(#{1,6})\\s+(.+?)\\s*$', 2)")} AS mt, length(regexp_extract(st, '^(#{{1,6}})\s+(.+?)\s*$', 1)) AS ml,
  regexp_extract({sql_clean('st')}, '(?i)^((?:\d+(?:\.\d+)*|[IVXLC]+)[.)]?)\s+([A-Za-z][^\n]{{1,100}})$', 1) AS num,
  {sql_clean("regexp_extract(" + sql_clean('st') + ", '(?i)^((?:\\d+(?:\\.\\d+)*|[IVXLC]+)[.)]?)\\s+([A-Za-z][^\\n]{1,100})$', 2)")} AS rest,
  st <> '' AND length(st) <= 120 AND NOT regexp_matches(st, '^(\||>|- |\* |\+ |```|\$\$)') AS usable FROM a),
c AS (SELECT *, len(list_filter(string_split_regex(ti, '{WS}+'), lambda x: x <> '')) AS nw,
  CASE WHEN NOT usable THEN 0 WHEN ml > 0 THEN (CASE WHEN mt <> '' AND NOT regexp_matches(mt, '(?i)^page\s+\d+$') THEN 1 ELSE 0 END)
    WHEN replace(lower(ti), 'ß', 'ss') IN ({KNOWN}) THEN 2
    WHEN num <> '' THEN (CASE WHEN NOT ends_with(rest, '.') AND len(list_filter(string_split_regex(rest, '{WS}+'), lambda x: x <> '')) <= 12 THEN 3 ELSE 0 END)
    WHEN len(list_filter(string_split_regex(ti, '{WS}+'), lambda x: x <> '')) BETWEEN 2 AND 8 AND length(ti) >= 4 AND upper(ti) = ti AND regexp_matches(ti, '\p{{L}}') THEN 4 ELSE 0 END AS kind FROM b),
h AS (SELECT paper_id, page, i, line, kind,
  CASE kind WHEN 1 THEN mt WHEN 4 THEN list_aggregate(list_transform(regexp_extract_all(lower(ti), '\p{{L}}+|[^\p{{L}}]+'), lambda r: upper(r[1]) || r[2:]), 'string_agg', '') ELSE ti END AS title,
  CASE kind WHEN 1 THEN least(ml, 3) WHEN 3 THEN least(length(num) - length(replace(num, '.', '')) + 1, 3) ELSE 1 END AS level FROM c)"""


@query("headings", f"WITH {LINES} SELECT paper_id, page, (i - 1)::INT AS line_no, title, level::INT AS level, kind < 4 AS strong FROM h WHERE kind > 0")
def headings(spark, sf_dir):
    w = _web_pages(spark, sf_dir)
    lines = w.select("paper_id", "page", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).withColumn("h", T.heading(F.col("line")))
    return lines.where("h is not null").select("paper_id", "page", "line_no", "h.title", "h.level", "h.strong")


SECTIONS = f"""
WITH {LINES},
rep AS (SELECT paper_id, replace(lower(title), 'ß', 'ss') AS k FROM h WHERE kind = 4 GROUP BY 1, 2 HAVING count(DISTINCT page) > 1),
g AS (SELECT h.* FROM h LEFT JOIN rep ON h.paper_id = rep.paper_id AND replace(lower(h.title), 'ß', 'ss') = rep.k WHERE kind <> 4 OR rep.k IS NULL),
o AS (SELECT paper_id, page, i, title, level, CASE WHEN replace(lower(title), 'ß', 'ss') = replace(lower(coalesce(lag(title) OVER (PARTITION BY paper_id ORDER BY page, i), 'Overview')), 'ß', 'ss') THEN 0 ELSE 1 END AS opens FROM g WHERE kind > 0),
x AS (SELECT g.*, coalesce(o.opens, 0) AS opens FROM g LEFT JOIN o ON g.paper_id = o.paper_id AND g.page = o.page AND g.i = o.i),
y AS (SELECT *, sum(opens) OVER (PARTITION BY paper_id ORDER BY page, i)::BIGINT AS section_no, sum(CASE WHEN kind > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY paper_id ORDER BY page, i) AS piece FROM x),
pc AS (SELECT paper_id, section_no, page, piece, {sql_strip("string_agg(line, chr(10) ORDER BY i)")} AS body FROM y WHERE kind = 0 GROUP BY ALL),
ch AS (SELECT paper_id, section_no, page, string_agg(body, chr(10) ORDER BY piece) AS body FROM pc WHERE body <> '' GROUP BY ALL),
st AS (SELECT paper_id, section_no, title, level FROM y WHERE opens = 1),
hd AS (SELECT DISTINCT paper_id FROM st),
chunks AS (SELECT ch.paper_id, ch.section_no, ch.page, coalesce(st.title, CASE WHEN hd.paper_id IS NULL THEN 'Document' ELSE 'Overview' END) AS title, coalesce(st.level, 1)::INT AS level, ch.body
  FROM ch LEFT JOIN st ON ch.paper_id = st.paper_id AND ch.section_no = st.section_no LEFT JOIN hd ON ch.paper_id = hd.paper_id),
sec AS (SELECT paper_id, section_no, min(title) AS title, min(level) AS level, min(page) AS page_start, max(page) AS page_end, count(*) AS n_chunks FROM chunks GROUP BY 1, 2),
ord AS (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY section_no) - 1 AS ord,
  CASE WHEN trim(regexp_replace(replace(lower(title), 'ß', 'ss'), '[^a-z0-9]+', '-', 'g'), '-') = '' THEN 'section' ELSE trim(regexp_replace(replace(lower(title), 'ß', 'ss'), '[^a-z0-9]+', '-', 'g'), '-') END AS base FROM sec),
ids AS (SELECT *, base || CASE WHEN row_number() OVER (PARTITION BY paper_id, base ORDER BY ord) = 1 THEN '' ELSE '-' || row_number() OVER (PARTITION BY paper_id, base ORDER BY ord) END AS section_id FROM ord)"""


@query("sections", SECTIONS + " SELECT paper_id, section_id, title, level, ord, page_start, page_end, n_chunks FROM ids")
def sections(spark, sf_dir):
    rows = corpus.sections(corpus.section_chunks(_web_pages(spark, sf_dir)))
    return rows.select("paper_id", "section_id", "title", "level", "ord", "page_start", "page_end", "n_chunks")


@query("section_anchors", SECTIONS + """, k AS (SELECT c.*, ids.section_id, row_number() OVER (PARTITION BY c.paper_id, c.section_no ORDER BY c.page) AS chunk_no FROM chunks c JOIN ids ON c.paper_id = ids.paper_id AND c.section_no = ids.section_no)
SELECT paper_id, section_id, page, section_id || '-page-' || page || '-' || chunk_no AS block_id, left(body, 500) AS source_text, sha256(body) AS digest FROM k""")
def section_anchors(spark, sf_dir):
    chunks = corpus.section_chunks(_web_pages(spark, sf_dir))
    rows = corpus.anchors(chunks, corpus.sections(chunks))
    return rows.select("paper_id", "section_id", "page", "block_id", "source_text", F.sha2("body", 256).alias("digest"))


@query("reader_sections")
def reader_sections(spark, sf_dir):
    """Page sections regrouped by strong headings only."""
    chunks = corpus.section_chunks(_web_pages(spark, sf_dir), reader=True)
    return chunks.groupBy("paper_id", "section_no", "title").agg(F.count(F.lit(1)).alias("n_pages"), F.sum(F.length("body")).alias("n_chars"))


@query("slugs", f"""WITH t AS (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang FROM pages),
b AS (SELECT *, trim(regexp_replace(replace(lower(title), 'ß', 'ss'), '[^a-z0-9]+', '-', 'g'), '-') AS base0 FROM t),
c AS (SELECT *, CASE WHEN base0 = '' THEN 'section' ELSE base0 END AS base FROM b),
d AS (SELECT *, row_number() OVER (PARTITION BY lang, base ORDER BY page_id) AS n FROM c)
SELECT page_id, base || CASE WHEN n = 1 THEN '' ELSE '-' || n END AS section_id FROM d""")
def slugs(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    t = p.select(F.col("page_id"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract("html", r'<html lang="([^"]*)"', 1).alias("paper_id"))
    return corpus.with_unique_slugs(t, "title", "page_id").select("page_id", "section_id")


# ------------------------------------------------------------------ sentences and blocks

PROTECTED = S.PROTECTED
SENTENCES = rf"""
d AS (SELECT doc_id, text, string_split(regexp_replace(text, '{PROTECTED}', chr(64976) || '\1' || chr(64976), 'g'), chr(64976)) AS tiles FROM documents),
t AS (SELECT doc_id, unnest(tiles) AS tile, generate_subscripts(tiles, 1) AS ti FROM d),
q AS (SELECT doc_id, ti, CASE WHEN ti % 2 = 0 THEN [tile] ELSE string_split(regexp_replace(tile, '([.!?。！？])({WS})', '\1' || chr(64977) || '\2', 'g'), chr(64977)) END AS ps FROM t),
p AS (SELECT doc_id, ti, unnest(ps) AS piece, generate_subscripts(ps, 1) AS pi FROM q),
o AS (SELECT *, coalesce(sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY ti, pi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM p),
z AS (SELECT doc_id, ti, pi, (off + length(piece) - length(regexp_replace(piece, '^{WS}+', '')))::INT AS s_start, {sql_strip('piece')} AS body FROM o WHERE ti % 2 = 1),
sent AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY ti, pi) - 1)::INT AS n, s_start, (s_start + length(body))::INT AS s_end, body FROM z WHERE body <> '')"""


def _sentences(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return S.with_sentences(d, "text")


@query("sentences", f"WITH {SENTENCES} SELECT doc_id, n, s_start, s_end, body FROM sent")
def sentences(spark, sf_dir):
    rows = exploded(_sentences(spark, sf_dir), "sentences", "s", "doc_id", pos="n")
    return rows.select("doc_id", "n", F.col("s.start").alias("s_start"), F.col("s.end").alias("s_end"), F.col("s.text").alias("body"))


@query("sentence_chunks", f"""WITH RECURSIVE {SENTENCES},
nx AS (SELECT doc_id, n, s_start, s_end, CASE
  WHEN lead(s_end, 1) OVER w IS NULL OR lead(s_end, 1) OVER w - s_start > 1200 THEN n + 1
  WHEN lead(s_end, 2) OVER w IS NULL OR lead(s_end, 2) OVER w - s_start > 1200 THEN n + 2
  WHEN lead(s_end, 3) OVER w IS NULL OR lead(s_end, 3) OVER w - s_start > 1200 THEN n + 3 ELSE n + 4 END AS nxt FROM sent WINDOW w AS (PARTITION BY doc_id ORDER BY n)),
r AS (SELECT doc_id, n, nxt, s_start FROM nx WHERE n = 0 UNION ALL SELECT nx.doc_id, nx.n, nx.nxt, nx.s_start FROM r JOIN nx ON nx.doc_id = r.doc_id AND nx.n = r.nxt)
SELECT r.doc_id, r.s_start AS c_start, e.s_end AS c_end FROM r JOIN sent e ON e.doc_id = r.doc_id AND e.n = r.nxt - 1
UNION ALL SELECT doc_id, 0, length(text)::INT FROM documents WHERE {sql_strip('text')} <> '' AND doc_id NOT IN (SELECT doc_id FROM sent)""")
def sentence_chunks(spark, sf_dir):
    rows = exploded(_sentences(spark, sf_dir), S.chunk_spans(F.col("sentences"), F.col("text")), "c", "doc_id")
    return rows.select("doc_id", F.col("c.start").alias("c_start"), F.col("c.end").alias("c_end"))


@query("sentence_at", rf"""WITH d AS (SELECT doc_id, text, least(length(text) // 2, greatest(length(text) - 1, 0)) AS pos FROM documents),
e AS (SELECT doc_id, pos, regexp_extract(text[1:pos], '[^.!?。！？\n]*$', 0) AS b, regexp_extract(text[pos + 1:], '^[^.!?。！？\n]*[.!?。！？]?', 0) AS a FROM d WHERE {sql_strip('text')} <> ''),
f AS (SELECT doc_id, (pos - length(b) + length(b || a) - length(regexp_replace(b || a, '^{WS}+', '')))::INT AS s_start, {sql_strip('b || a')} AS body FROM e)
SELECT doc_id, s_start, (s_start + length(body))::INT AS s_end, body FROM f WHERE body <> ''""")
def sentence_at(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    rows = d.select("doc_id", S.sentence_at(F.col("text"), F.floor(F.length("text") / 2).cast("int")).alias("s")).where("s is not null")
    return rows.select("doc_id", F.col("s.start").alias("s_start"), F.col("s.end").alias("s_end"), F.col("s.text").alias("body"))


# The driver's texts are composed already, so the oracle leaves composition out.
CLEAN = r"""regexp_replace(regexp_replace(regexp_replace(translate(text, chr(1) || chr(16) || chr(17), ')()'), '[\x01-\x08\x0b\x0c\x0e-\x1f]', ' ', 'g'),
  '\b((?i:cross|feed|high|large|low|real|self|small|spatio|state|task))-\r?\n([a-z]{2,})\b', '\1-\2', 'g'), '\b([A-Za-z]{2,})-\r?\n([a-z]{2,})\b', '\1\2', 'g')"""


@query("clean_text", r"SELECT doc_id, sha256(nfc_normalize(regexp_replace(text, '( [a-z]{2,}) ([a-z]{2,} )', '\1\2', 'g'))) AS digest FROM documents")
def clean_text(spark, sf_dir):
    """Words wrapped at line ends (derived by joining pairs of lower-case words so) are rejoined."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", "( [a-z]{2,}) ([a-z]{2,} )", "$1-\n$2").alias("broken"))
    return d.select("doc_id", F.sha2(T.clean_extracted(F.col("broken")), 256).alias("digest"))


BLOCKS = rf"""
d AS (SELECT doc_id, {CLEAN.replace('translate(text,', "translate(replace(text, chr(10), chr(10) || chr(10)),")} AS md FROM documents),
u AS (SELECT doc_id, unnest(string_split_regex(md, '\n{{2,}}')) AS raw, generate_subscripts(string_split_regex(md, '\n{{2,}}'), 1) AS i FROM d),
v AS (SELECT doc_id, i, {sql_strip('raw')} AS text FROM u),
blk AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INT AS ord, text FROM v WHERE text <> '' AND NOT regexp_matches(text, '^#{{1,6}}\s'))"""


@query("reader_blocks", f"WITH {BLOCKS} SELECT doc_id::VARCHAR AS section_id, doc_id || ':block-' || (ord + 1) AS block_id, ord, text FROM blk")
def reader_blocks(spark, sf_dir):
    return corpus.reader_blocks(paragraphs(spark, sf_dir)).drop("paper_id")


@query("compact_blocks", rf"""WITH RECURSIVE {BLOCKS},
f AS (SELECT *, length(text) <= 96 AND NOT regexp_matches(text, '(?m)(?:^|\n)(?:#{{1,6}}\s|[-*+]\s|\d+[.)]\s|>\s|```|\|)|!\[[^\]]*\]\(|\$\$|\\\[|\\begin\{{') AND len(string_split_regex(text, '{WS}+')) <= 16 AS short FROM blk),
r AS (SELECT doc_id, ord, text, short, CASE WHEN short THEN length(text) + 2 ELSE 0 END AS chars, ord AS run FROM f WHERE ord = 0
  UNION ALL SELECT f.doc_id, f.ord, f.text, f.short,
    CASE WHEN NOT f.short THEN 0 WHEN r.short AND r.chars + length(f.text) <= 720 THEN r.chars + length(f.text) + 2 ELSE length(f.text) + 2 END,
    CASE WHEN f.short AND r.short AND r.chars + length(f.text) <= 720 THEN r.run ELSE f.ord END FROM r JOIN f ON f.doc_id = r.doc_id AND f.ord = r.ord + 1),
g AS (SELECT *, count(*) OVER (PARTITION BY doc_id, run) AS n FROM r)
SELECT doc_id::VARCHAR AS section_id, doc_id || ':block-' || (run + 1) AS block_id, string_agg(text, '; ' ORDER BY ord) AS text, true AS compacted, n::INT AS n_blocks FROM g WHERE n >= 4 GROUP BY doc_id, run, n
UNION ALL SELECT doc_id::VARCHAR, doc_id || ':block-' || (ord + 1), text, false, 1 FROM g WHERE n < 4""")
def compact_blocks(spark, sf_dir):
    return corpus.reader_blocks(paragraphs(spark, sf_dir), compact=True).drop("paper_id", "ord")


@query("neighbour_context", """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ord FROM documents),
c AS (SELECT doc_id, ord, concat_ws(chr(10) || chr(10), lag(t) OVER w, t, lead(t) OVER w) AS context FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY ord))
SELECT doc_id, ord::INT AS ord, sha256(left(context, 8000)) AS digest FROM c""")
def neighbour_context(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("ord", "text"))
    return corpus.neighbours(lines, ["doc_id"], "ord", "text", 1, 1, 8000).select("doc_id", "ord", F.sha2("context", 256).alias("digest"))


@query("long_text_chunks", rf"""WITH RECURSIVE c AS (SELECT doc_id, -1 AS n, '' AS chunk, {sql_strip("text")} AS rest FROM documents UNION ALL
SELECT doc_id, n + 1, {sql_strip("rest[1:cut]")}, {sql_strip("rest[cut + 1:]")} FROM (SELECT *, CASE WHEN length(rest) <= 2000 THEN length(rest) WHEN 2000 - length(regexp_extract(rest[1:2000], '[^ \n]*$')) > 1100 THEN 2000 - length(regexp_extract(rest[1:2000], '[^ \n]*$')) ELSE 2000 END AS cut FROM c WHERE rest <> ''))
SELECT doc_id, n, length(chunk)::INT AS n_chars, sha256(chunk) AS digest FROM c WHERE n >= 0""")
def long_text_chunks(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.posexplode(S.long_text_chunks(F.col("text"), 2000)).alias("n", "chunk")).select("doc_id", "n", F.length("chunk").alias("n_chars"), F.sha2("chunk", 256).alias("digest"))


@query("document_text", """WITH b AS (SELECT source, doc_id, text, sum(length(text) + 2) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS s FROM documents WHERE trim(text) <> '')
SELECT source, doc_id, coalesce(s, 0)::BIGINT AS start, sha256(text) AS digest FROM b""")
def document_text(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where(F.trim("text") != "").select("source", "doc_id", "text", *coarse("doc_id"))
    return placed_text(d, ["source"], ["doc_id"], ["_block"], "text").select("source", "doc_id", "start", F.sha2("text", 256).alias("digest"))


@query("title_norm", f"SELECT page_id, {sql_norm('title')} AS norm, sha256(title)[1:20] AS id20 FROM (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages)")
def title_norm(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))
    return p.select("page_id", T.normalize_title(F.col("title")).alias("norm"), F.substring(T.reference_id(F.col("title")), 5, 20).alias("id20"))


# ------------------------------------------------------------------------ markdown tables


def _order_tables(spark, sf_dir):
    """Lines of an order as a markdown table."""
    li = table(spark, sf_dir, "lineitem")
    row = F.concat(F.lit("| "), F.col("l_linenumber").cast("string"), F.lit(" | "), F.col("l_partkey").cast("string"), F.lit(" | "), F.col("l_suppkey").cast("string"), F.lit(" |"))
    rows = F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", row.alias("row"))))
    g = li.groupBy("l_orderkey").agg(F.array_join(F.transform(rows, lambda r: r["row"]), "\n").alias("body"))
    return g.select(F.col("l_orderkey").alias("table_id"), F.concat(F.lit("Table 1: lines\n\n| line | part | supplier |\n| --- | :---: | --- |\n"), "body", F.lit("\n\nend")).alias("markdown"))


@query("table_cells", """WITH s AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS rn FROM lineitem),
o AS (SELECT DISTINCT l_orderkey FROM lineitem)
SELECT l_orderkey AS table_id, 0 AS row_no, c AS col_no, v AS value FROM o, (VALUES (0, 'line'), (1, 'part'), (2, 'supplier')) AS t(c, v)
UNION ALL SELECT l_orderkey, rn::INT, 0, l_linenumber::VARCHAR FROM s UNION ALL SELECT l_orderkey, rn::INT, 1, l_partkey::VARCHAR FROM s UNION ALL SELECT l_orderkey, rn::INT, 2, l_suppkey::VARCHAR FROM s""")
def table_cells(spark, sf_dir):
    from lectern.sources.sinks import table_cells as cells

    return cells(_order_tables(spark, sf_dir))


@query("table_render", """WITH s AS (SELECT l_orderkey, string_agg('| ' || l_linenumber || ' | ' || l_partkey || ' | ' || l_suppkey || ' |', chr(10) ORDER BY l_linenumber, l_partkey, l_suppkey) AS body FROM lineitem GROUP BY 1)
SELECT l_orderkey AS table_id, sha256('Lines' || chr(10) || chr(10) || '| line | part | supplier |' || chr(10) || '| --- | --- | --- |' || chr(10) || body || chr(10) || chr(10) || '> checked') AS digest FROM s""")
def table_render(spark, sf_dir):
    t = _order_tables(spark, sf_dir).withColumn("rows", M.table_rows(F.col("markdown")))
    text = M.render_table(F.lit("Lines"), F.get("rows", F.lit(0)), F.slice("rows", F.lit(2), F.size("rows")), F.array(F.lit("checked")))
    return t.select("table_id", F.sha2(text, 256).alias("digest"))


@query("quality_issues", """WITH s AS (SELECT l_orderkey, string_agg(l_linenumber || ' ' || l_partkey || ' ' || l_suppkey, chr(10) ORDER BY l_linenumber, l_partkey, l_suppkey) AS body, count(*) AS n FROM lineitem GROUP BY 1)
SELECT l_orderkey AS paper_id, 'table' AS kind, left('Table 1: lines' || chr(10) || body || chr(10), 1200) AS source_text, 0.35::DOUBLE AS confidence FROM s WHERE 1 + 3 * n >= 6
UNION ALL SELECT l_orderkey, 'formula', '{x_' || l_orderkey || ' = ' || n || '}', 0.45 FROM s WHERE l_orderkey % 3 = 0
UNION ALL SELECT l_orderkey, 'reading_order', '[1] a' || n || ' [2] b', 0.45 FROM s WHERE l_orderkey % 2 = 0""")
def quality_issues(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    row = F.concat_ws(" ", F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"))
    rows = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", row.alias("row"))))
    g = li.groupBy("l_orderkey").agg(F.array_join(F.transform(rows, lambda r: r["row"]), "\n").alias("body"), F.count(F.lit(1)).alias("n"))
    key, n = F.col("l_orderkey"), F.col("n").cast("string")
    formula = F.when(key % 3 == 0, F.concat(F.lit("{x_"), key.cast("string"), F.lit(" = "), n, F.lit("}"))).otherwise(F.lit("plain"))
    refs = F.when(key % 2 == 0, F.concat(F.lit("[1] a"), n, F.lit(" [2] b"))).otherwise(F.lit("[1] a\n[2] b"))
    md = F.concat(F.lit("Table 1: lines\n"), "body", F.lit("\n# Next\n"), formula, F.lit("\n# References\n"), refs)
    issues = g.select(key.alias("paper_id"), F.explode(M.quality_issues(md)).alias("i"))
    return issues.select("paper_id", "i.kind", "i.source_text", "i.confidence")


@query("formula_checks", r"""SELECT p_partkey, p_partkey % 4 <> 3 AS valid, CASE WHEN p_partkey % 5 = 0 THEN 1 ELSE 0 END::BIGINT AS suspicious, (CASE WHEN p_partkey % 4 = 1 THEN 1 ELSE 0 END)::INT AS structural, (p_partkey % 100)::INT AS number FROM part""")
def formula_checks(spark, sf_dir):
    k = F.col("p_partkey")
    glyph = F.when(k % 5 == 0, F.lit("□")).otherwise(F.lit("y"))
    span = F.concat(F.lit("$$x + "), glyph, F.lit("$$"), F.when(k % 4 == 1, F.lit(" $$")).otherwise(F.lit("")))
    latex = F.concat(F.lit("\\frac{a}{b"), F.when(k % 4 == 3, F.lit("")).otherwise(F.lit("}")))
    label = F.concat(F.lit("see (7) and ("), (k % 100).cast("string"), F.lit(")"))
    return table(spark, sf_dir, "part").select(
        "p_partkey", M.formula_valid(latex).alias("valid"), F.size(M.formula_spans(span)).cast("long").alias("suspicious"), M.structural_issues(span).alias("structural"), M.formula_number(label).alias("number"))


@query("anchor_masking", r"""SELECT page_id, sha256('a <a data-block-id="b' || page_id || '"></a> ' || title || ' <a data-block-id="c"></a>') AS restored, CASE WHEN page_id % 3 = 0 THEN 'lost_anchor' ELSE 'none' END AS problem,
  'a [[EVIDENCE_ANCHOR_0]] ' || title || ' [[EVIDENCE_ANCHOR_1]]' AS masked FROM (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages)""")
def anchor_masking(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))
    md = F.concat(F.lit('a <a data-block-id="b'), F.col("page_id").cast("string"), F.lit('"></a> '), "title", F.lit(' <a data-block-id="c"></a>'))
    m = p.withColumn("m", M.mask_anchors(md)).withColumn("good", M.restore_anchors(F.concat(F.lit("```md\n"), "m.text", F.lit("\n```")), F.col("m.anchors")))
    lossy = F.when(F.col("page_id") % 3 == 0, F.replace("m.text", F.lit("[[EVIDENCE_ANCHOR_0]]"), F.lit(""))).otherwise(F.col("m.text"))
    return m.select("page_id", F.sha2("good.markdown", 256).alias("restored"), F.coalesce(M.restore_anchors(lossy, F.col("m.anchors"))["problem"], F.lit("none")).alias("problem"), F.col("m.text").alias("masked"))


@query("page_parts", """SELECT source, doc_id AS page, sha256(t) AS digest FROM (SELECT source, doc_id, trim(text, chr(10) || ' ' || chr(13) || chr(9) || chr(160)) AS t FROM documents) WHERE t <> ''""")
def page_parts(spark, sf_dir):
    """Documents joined as anchored pages of a section, then split back."""
    d = table(spark, sf_dir, "documents")
    page = F.col("doc_id").cast("string")
    body = F.concat(F.lit('<a data-page="'), page, F.lit('"></a>\n'), "text", F.lit('\n<a data-page="'), page, F.lit('"></a>'))
    parts = d.select("source", F.explode(M.page_parts(body, F.lit(1))).alias("p"))
    return parts.select("source", F.col("p.page").cast("long").alias("page"), F.sha2("p.body", 256).alias("digest"))


@query("math_delimiters", r"SELECT doc_id, sha256('$$' || t || '$$ `\[' || t || '\]` $ ' || t || ' $') AS digest, true AS same_length FROM (SELECT doc_id, regexp_replace(text, '[$`()\[\]\\\n]', '', 'g') AS t FROM documents)")
def math_delimiters(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", r"[$`()\[\]\\\n]", "").alias("t"))
    md = F.concat(F.lit("\\["), "t", F.lit("\\] `\\["), "t", F.lit("\\]` \\("), "t", F.lit("\\)"))
    fixed = M.normalize_math(md)
    return d.select("doc_id", F.sha2(fixed, 256).alias("digest"), (F.length(fixed) == F.length(md)).alias("same_length"))


# ----------------------------------------------------------------------- conversations


@query("recent_turns", "SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS age FROM conversations) WHERE age <= 6")
def recent_turns(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return retrieval.recent_turns(c, "conv_id", "turn", 6).drop("age")


@query("chat_messages", """WITH t AS (SELECT conv_id, turn, text AS question FROM conversations WHERE role = 'user'), a AS (SELECT conv_id, turn - 1 AS turn, text AS answer FROM conversations WHERE role = 'assistant'),
j AS (SELECT t.conv_id, t.turn, question, answer, row_number() OVER (PARTITION BY t.conv_id ORDER BY t.turn DESC) AS age FROM t LEFT JOIN a USING (conv_id, turn))
SELECT conv_id AS conversation_id, turn, 0 AS side, 'user' AS role, question AS text FROM j WHERE age <= 6 UNION ALL SELECT conv_id, turn, 1, 'assistant', answer FROM j WHERE age <= 6 AND answer IS NOT NULL""")
def chat_messages(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    asked = c.where("role = 'user'").select(F.col("conv_id").alias("conversation_id"), "turn", F.col("text").alias("question"))
    told = c.where("role = 'assistant'").select(F.col("conv_id").alias("conversation_id"), (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    turns = asked.join(told, ["conversation_id", "turn"], "left")
    return retrieval.as_messages(retrieval.recent_turns(turns, "conversation_id", "turn", 6))


@query("chat_context", """SELECT conv_id, count(*) AS n_pieces, sha256(string_agg('## ' || role || ' / ' || turn || chr(10) || chr(10) || text, chr(10) || chr(10) ORDER BY turn)) AS digest FROM conversations GROUP BY 1""")
def chat_context(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    rows = c.select("conv_id", "turn", F.concat(context.context_heading(F.col("role"), F.col("turn").cast("string")), F.lit("\n\n"), "text").alias("text"))
    out = assemble_text(rows, ["conv_id"], ["turn"], "text")
    return out.select("conv_id", "n_pieces", F.sha2("body", 256).alias("digest"))


@query("first_lines", "SELECT source, digest, min(doc_id) AS doc_id FROM (SELECT source, doc_id, sha256(string_split(text, chr(10))[1]) AS digest FROM documents) GROUP BY 1, 2")
def first_lines(spark, sf_dir):
    """Order-preserving distinct of opening lines per source."""
    d = table(spark, sf_dir, "documents").select("source", "doc_id", F.sha2(F.get(F.split("text", "\n"), F.lit(0)), 256).alias("digest"))
    return first_rows(d, ["source", "digest"], [F.col("doc_id")])


# ------------------------------------------------------------------------------ retrieval


@query("evidence", f"""WITH q AS (SELECT item_id, list_filter(string_split_regex(text, '{WS}+'), lambda w: length(w) > 1)[1:8] AS terms0 FROM benchmark),
t AS (SELECT item_id, lower(unnest(terms0)) AS term FROM q), d AS (SELECT doc_id, text, lower(text) AS low FROM documents),
h AS (SELECT item_id, doc_id, min(instr(low, term)) - 1 AS position FROM t JOIN d ON contains(low, term) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY doc_id) AS rank FROM h)
SELECT item_id, rank::INT AS rank, r.doc_id, position::INT AS position, {sql_strip("substr(text, greatest(0, position - 180) + 1, position + 420 - greatest(0, position - 180))")} AS snippet FROM r JOIN documents d ON d.doc_id = r.doc_id WHERE rank <= 10""")
def evidence(spark, sf_dir):
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    s = spread(table(spark, sf_dir, "documents")).select(F.col("doc_id").alias("section_key"), F.col("doc_id").alias("ord"), "text")
    return retrieval.find_evidence(q, s).select(F.col("query_id").alias("item_id"), "rank", F.col("section_key").alias("doc_id"), "position", "snippet")


@query("evidence_in_paper", f"""WITH q AS (SELECT item_id, 'src' || (item_id % 20) AS paper_id, 3 + item_id % 4 AS lim, list_filter(string_split_regex(text, '{WS}+'), lambda w: length(w) > 1)[1:8] AS terms0 FROM benchmark),
t AS (SELECT item_id, paper_id, lower(unnest(terms0)) AS term FROM q), d AS (SELECT doc_id, source, text, lower(text) AS low FROM documents),
h AS (SELECT item_id, doc_id, source, min(instr(low, term)) - 1 AS position FROM t JOIN d ON source = paper_id AND contains(low, term) GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY doc_id) AS rank FROM h)
SELECT r.item_id, rank::INT AS rank, r.doc_id, r.source AS paper_title, lang AS section_title, position::INT AS position FROM r JOIN q ON q.item_id = r.item_id JOIN documents d ON d.doc_id = r.doc_id WHERE rank <= lim""")
def evidence_in_paper(spark, sf_dir):
    """Evidence in one source for each benchmark passage, with a limit of its own."""
    k = F.col("item_id")
    q = table(spark, sf_dir, "benchmark").select(k.alias("query_id"), F.col("text").alias("query"), F.concat(F.lit("src"), (k % 20).cast("string")).alias("paper_id"), (3 + k % 4).alias("limit"))
    s = spread(table(spark, sf_dir, "documents")).select(F.col("doc_id").alias("section_key"), F.col("doc_id").alias("ord"), F.col("source").alias("paper_id"), F.col("source").alias("paper_title"), F.col("lang").alias("section_title"), "text")
    return retrieval.find_evidence(q, s, carry=("paper_title", "section_title")).select(F.col("query_id").alias("item_id"), "rank", F.col("section_key").alias("doc_id"), "paper_title", "section_title", "position")


@query("title_search", """WITH q AS (SELECT DISTINCT p_name AS query FROM part), t AS (SELECT l_orderkey, l_linenumber, lower(p_name || ' ' || p_type) AS title FROM lineitem JOIN part ON l_partkey = p_partkey),
p AS (SELECT l_orderkey AS paper_id, min(title) AS title FROM t GROUP BY 1),
m AS (SELECT query, p.paper_id, o_orderdate, title FROM q JOIN p ON contains(p.title, lower(query)) JOIN orders ON o_orderkey = p.paper_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY o_orderdate DESC, paper_id) AS rank FROM m)
SELECT query AS call_id, rank::INT AS rank, paper_id, title FROM r WHERE rank <= 15""")
def title_search(spark, sf_dir):
    part, li, o = (table(spark, sf_dir, n) for n in ("part", "lineitem", "orders"))
    calls = part.select(F.col("p_name").alias("call_id"), F.col("p_name").alias("query"), F.lit(15).alias("limit")).distinct()
    titles = li.join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy("l_orderkey").agg(F.min(F.lower(F.concat_ws(" ", "p_name", "p_type"))).alias("title"))
    papers = titles.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_orderkey").alias("id"), "title", F.col("o_orderdate").alias("updated_at"))
    return retrieval.search_titles(calls, papers)


@query("read_document", "SELECT doc_id, left(text, 1000 + (doc_id % 5) * 1000) AS markdown, length(text) > 1000 + (doc_id % 5) * 1000 AS truncated FROM documents")
def read_document(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("paper_id"), F.col("text").alias("markdown"))
    calls = d.select(F.col("paper_id").alias("call_id"), "paper_id", F.when(F.col("paper_id") % 5 == 0, 10).otherwise(1000 + (F.col("paper_id") % 5) * 1000).alias("max_chars"))
    return retrieval.read_document(calls, d).select(F.col("call_id").alias("doc_id"), "markdown", "truncated")


@query("read_section", "SELECT doc_id AS call_id, source AS paper_id, doc_id::VARCHAR AS section_id, left(text, 80000) AS markdown FROM documents")
def read_section(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    rows = d.select(F.col("source").alias("paper_id"), F.col("doc_id").cast("string").alias("section_id"), F.concat(F.lit("Titel "), F.col("doc_id").cast("string")).alias("title"), F.col("doc_id").alias("ord"), F.col("text").alias("markdown"))
    wanted = F.when(F.col("doc_id") % 2 == 0, F.col("doc_id").cast("string")).otherwise(F.concat(F.lit("TITEL "), F.col("doc_id").cast("string")))
    calls = d.select(F.col("doc_id").alias("call_id"), F.col("source").alias("paper_id"), wanted.alias("section_id"))
    return retrieval.read_section(calls, rows).select("call_id", "paper_id", "section_id", "markdown")
