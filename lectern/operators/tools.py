"""The declared read tools: arguments checked against their schema, run for a table of calls or called from SQL.

``run_calls`` answers any number of calls with the joins of ``retrieval``.  ``register_tools`` makes six table
functions of a session: ``SELECT * FROM read_paper('{"paperId": "p1"}')``.  They are SQL functions over the library's
views, so Catalyst sees the literal arguments and pushes them into the scans.  A refused call is a row with its error.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import retrieval

# The tools' names and declared arguments as (type, required, least, most).
TOOLS: dict[str, dict[str, tuple[str, bool, int | None, int | None]]] = {
    "search_library": {"query": ("string", True, None, None), "limit": ("integer", False, 1, 20)},
    "read_paper": {"paperId": ("string", True, None, None), "maxCharacters": ("integer", False, 1000, 100000)},
    "read_section": {"paperId": ("string", True, None, None), "sectionId": ("string", True, None, None)},
    "read_figure": {"paperId": ("string", True, None, None), "figureId": ("string", False, None, None)},
    "find_evidence": {"query": ("string", True, None, None), "paperId": ("string", False, None, None), "limit": ("integer", False, 1, 20)},
    "get_references": {"paperId": ("string", True, None, None), "limit": ("integer", False, 1, 200)},
}
LARGEST = 128 * 1024


@dataclass
class Library:
    """``papers(id, title, status, page_count, updated_at)``, ``documents(paper_id, markdown)``, ``sections(paper_id, section_id, title,
    ord, page, markdown)`` with one total order ``ord``, ``figures(paper_id, figure_id, page, caption)``, ``references(paper_id, pos, ref_id, title)``; ids are strings."""

    papers: DataFrame
    documents: DataFrame
    sections: DataFrame
    figures: DataFrame
    references: DataFrame


def error_sql(tool: str, arguments: str = "arguments") -> str:
    """SQL that is null for arguments the tool accepts, else says what is wrong with them."""
    parsed = f"try_parse_json({arguments})"
    allowed = ", ".join(f"'{name}'" for name in TOOLS[tool])
    cases = [
        f"WHEN octet_length({arguments}) > {LARGEST} THEN 'arguments exceed {LARGEST} bytes'",
        f"WHEN NOT coalesce(schema_of_variant({parsed}) LIKE 'OBJECT%', false) THEN 'arguments must be an object'",
        f"WHEN size(array_except(json_object_keys({arguments}), array({allowed}))) > 0 THEN concat('unknown argument ', array_except(json_object_keys({arguments}), array({allowed}))[0])",
    ]
    for name, (kind, required, least, most) in TOOLS[tool].items():
        value = f"try_variant_get({parsed}, '$.{name}', 'string')"
        given = f"schema_of_variant(try_variant_get({parsed}, '$.{name}', 'variant'))"
        if required:
            cases.append(f"WHEN coalesce({given}, 'VOID') = 'VOID' THEN '{name} is required'")
        cases.append(f"WHEN {given} NOT IN ('{'STRING' if kind == 'string' else 'BIGINT'}', 'VOID') THEN '{name} must be {'a string' if kind == 'string' else 'an integer'}'")
        if required:
            cases.append(f"WHEN trim({value}) = '' THEN '{name} is required'")
        if kind == "integer":
            cases.append(f"WHEN try_variant_get({parsed}, '$.{name}', 'bigint') NOT BETWEEN {least} AND {most} THEN '{name} must be between {least} and {most}'")
    return "CASE " + " ".join(cases) + " END"


def checked_calls(calls: DataFrame) -> DataFrame:
    """``calls(call_id, tool_name, arguments)`` with ``error`` (null: accepted) and the arguments as columns."""
    error = F.lit("unknown tool")
    for tool in TOOLS:
        error = F.when(F.col("tool_name") == tool, F.expr(error_sql(tool))).otherwise(error)
    parsed = F.try_parse_json("arguments")
    value = lambda name, kind: F.try_variant_get(parsed, f"$.{name}", kind)
    return calls.select(
        "call_id", "tool_name", error.alias("error"), F.trim(value("query", "string")).alias("query"), F.trim(value("paperId", "string")).alias("paper_id"),
        F.trim(value("sectionId", "string")).alias("section_id"), F.trim(value("figureId", "string")).alias("figure_id"), value("limit", "int").alias("limit"), value("maxCharacters", "int").alias("max_chars"))


def run_calls(calls: DataFrame, library: Library) -> DataFrame:
    """``call_id, tool_name, error, place, paper_id, part, title, body``: the answer rows of every call, in their place.

    A call that is refused, names no known paper, or whose section or figure is not there, is one row with its error; a search
    that finds nothing has no row.
    """
    checked = checked_calls(calls)
    known = library.papers.select(F.col("id").alias("paper_id"), F.lit(True).alias("_known"))
    judged = checked.join(known, "paper_id", "left")
    missing = F.col("paper_id").isNotNull() & F.col("_known").isNull() & (F.col("tool_name") != "find_evidence")
    judged = judged.withColumn("error", F.coalesce("error", F.when(missing, F.concat(F.lit("unknown paper "), "paper_id")))).drop("_known")
    good = judged.where("error is null")
    mine = lambda tool: good.where(F.col("tool_name") == tool)

    def shaped(rows: DataFrame, tool: str, place: Column | str, part: Column | str | None, title: Column | str, body: Column | str | None) -> DataFrame:
        column = lambda c: F.lit(None) if c is None else F.col(c) if isinstance(c, str) else c
        return rows.select("call_id", F.lit(tool).alias("tool_name"), F.lit(None).cast("string").alias("error"), column(place).cast("int").alias("place"), F.col("paper_id").cast("string").alias("paper_id"),
                           column(part).cast("string").alias("part"), column(title).cast("string").alias("title"), column(body).cast("string").alias("body"))

    one = F.lit(1)
    found = retrieval.search_titles(mine("search_library"), library.papers)
    read = retrieval.read_document(mine("read_paper"), library.documents)
    wanted_sections = mine("read_section")
    section = retrieval.read_section(wanted_sections, library.sections)
    wanted_figures = mine("read_figure")
    figure = retrieval.read_figures(wanted_figures, library.figures)
    asked = mine("find_evidence").select(F.col("call_id").alias("query_id"), "query", F.coalesce("paper_id", F.lit("")).alias("paper_id"), "limit")
    texts = library.sections.select(F.struct("paper_id", "section_id").alias("section_key"), "ord", F.col("markdown").alias("text"), "paper_id", "section_id", "title")
    evidence = retrieval.find_evidence(asked, texts, carry=("paper_id", "section_id", "title")).withColumnRenamed("query_id", "call_id")
    references = retrieval.read_references(mine("get_references"), library.references)
    unseen = [
        wanted_sections.join(section.select("call_id"), "call_id", "left_anti").withColumn("error", F.concat(F.lit("unknown section "), "section_id")),
        wanted_figures.where(F.coalesce("figure_id", F.lit("")) != "").join(figure.select("call_id"), "call_id", "left_anti").withColumn("error", F.concat(F.lit("unknown figure "), "figure_id")),
    ]
    refused = [judged.where("error is not null"), *unseen]
    answers = [
        shaped(found, "search_library", "rank", None, "title", None), shaped(read, "read_paper", one, None, F.lit(None), "markdown"), shaped(section, "read_section", one, "section_id", "title", "markdown"),
        shaped(figure, "read_figure", "figure_no", "figure_id", "caption", None), shaped(evidence, "find_evidence", "rank", "section_id", "title", "snippet"), shaped(references, "get_references", "ref_no", "ref_id", "title", None),
        *[r.select("call_id", "tool_name", "error", one.alias("place"), *[F.lit(None).cast("string").alias(c) for c in ("paper_id", "part", "title", "body")]) for r in refused],
    ]
    return reduce(DataFrame.unionByName, answers)


# Bodies of the SQL functions; {error} is the check of ``arguments``, {x:name} an argument.
_FUNCTIONS = {
    "search_library": ("rank INT, paper_id STRING, title STRING, status STRING, page_count INT", """
        SELECT {error}, rank, id, title, status, page_count FROM (
          SELECT *, row_number() OVER (ORDER BY updated_at DESC, id) AS rank FROM (
            SELECT id, title, status, page_count, updated_at FROM {v}papers
            WHERE {error} IS NULL AND contains(replace(lower(title), 'ß', 'ss'), replace(lower(trim({query})), 'ß', 'ss')) ORDER BY updated_at DESC, id LIMIT 20))
        WHERE rank <= coalesce({limit}, 10)"""),
    "read_paper": ("paper_id STRING, markdown STRING, truncated BOOLEAN", """
        SELECT {error}, paper_id, left(markdown, coalesce({maxCharacters}, 60000)), length(markdown) > coalesce({maxCharacters}, 60000)
        FROM {v}documents WHERE {error} IS NULL AND paper_id = trim({paperId})"""),
    "read_section": ("paper_id STRING, section_id STRING, title STRING, page INT, markdown STRING", """
        SELECT {error}, paper_id, section_id, title, page, left(markdown, 80000) FROM {v}sections
        WHERE {error} IS NULL AND paper_id = trim({paperId}) AND (section_id = trim({sectionId}) OR replace(lower(title), 'ß', 'ss') = replace(lower(trim({sectionId})), 'ß', 'ss'))
        ORDER BY ord LIMIT 1"""),
    "read_figure": ("figure_id STRING, page INT, caption STRING", """
        SELECT {error}, figure_id, page, caption FROM {v}figures
        WHERE {error} IS NULL AND paper_id = trim({paperId}) AND (coalesce(trim({figureId}), '') IN ('', figure_id)) ORDER BY page, figure_id LIMIT 50"""),
    "find_evidence": ("rank INT, paper_id STRING, section_id STRING, title STRING, position INT, snippet STRING", """
        SELECT {error}, rank, paper_id, section_id, title, at, btrim(substring(markdown, greatest(0, at - 180) + 1, at + 420 - greatest(0, at - 180))) FROM (
          SELECT *, row_number() OVER (ORDER BY ord) AS rank, array_min(filter(transform(terms, t -> instr(lower(markdown), t)), p -> p > 0)) - 1 AS at FROM (
            SELECT * FROM (SELECT *, slice(transform(filter(split(trim({query}), '\\\\s+'), t -> length(t) > 1), t -> lower(t)), 1, 8) AS terms FROM {v}sections)
            WHERE {error} IS NULL AND coalesce(trim({paperId}), '') IN ('', paper_id) AND exists(terms, t -> contains(lower(markdown), t)) ORDER BY ord LIMIT 20))
        WHERE rank <= coalesce({limit}, 10)"""),
    "get_references": ("ref_no INT, ref_id STRING, title STRING", """
        SELECT {error}, ref_no, ref_id, title FROM (
          SELECT *, row_number() OVER (ORDER BY pos) AS ref_no FROM (SELECT * FROM {v}references WHERE {error} IS NULL AND paper_id = trim({paperId}) ORDER BY pos LIMIT 200))
        WHERE ref_no <= coalesce({limit}, 100)"""),
}


def register_tools(spark: SparkSession, library: Library, prefix: str = "") -> list[str]:
    """Make the six tools table functions of this session over views of ``library``; gives their names.

    Every function takes one JSON object and returns ``error`` before its columns: null in answers, set in the one row
    of refused arguments, of an unknown paper, and of a section or figure that is not there.
    """
    view = f"{prefix}library_"
    for name in ("papers", "documents", "sections", "figures", "references"):
        getattr(library, name).createOrReplaceTempView(f"{view}{name}")
    for tool, (columns, body) in _FUNCTIONS.items():
        parsed = "try_parse_json(arguments)"
        values = {name: f"try_variant_get({parsed}, '$.{name}', '{'string' if kind == 'string' else 'int'}')" for name, (kind, *_) in TOOLS[tool].items()}
        error = error_sql(tool)
        filled = body.replace("{v}", view).replace("{error}", f"({error})")
        for name, value in values.items():
            filled = filled.replace(f"{{{name}}}", value)
        names = ", ".join(c.split()[0] for c in columns.split(", "))
        empty = ", ".join(f"CAST(NULL AS {c.split()[1]})" for c in columns.split(", "))
        said = [f"SELECT {error} AS error, {empty} WHERE ({error}) IS NOT NULL"]
        if "paperId" in TOOLS[tool] and tool != "find_evidence":
            told = f"trim({values['paperId']})"
            seen = [f"SELECT 1 AS paper, 0 AS part FROM {view}papers WHERE id = {told}"]
            cases = [f"WHEN coalesce(sum(paper), 0) = 0 THEN concat('unknown paper ', {told})"]
            for part, table, test in (("section", "sections", "(section_id = {0} OR lower(title) = lower({0}))"), ("figure", "figures", "figure_id = {0}")):
                if f"{part}Id" in values:
                    asked = f"trim({values[f'{part}Id']})"
                    seen.append(f"SELECT 0, 1 FROM {view}{table} WHERE paper_id = {told} AND {test.format(asked)}")
                    cases.append(f"WHEN coalesce({asked}, '') <> '' AND coalesce(sum(part), 0) = 0 THEN concat('unknown {part} ', {asked})")
            missing = f"SELECT CASE {' '.join(cases)} END AS missing FROM ({' UNION ALL '.join(seen)})"
            said.append(f"SELECT missing, {empty} FROM ({missing}) WHERE ({error}) IS NULL AND missing IS NOT NULL")
        text = " UNION ALL ".join([f"SELECT * FROM ({filled}) AS answer(error, {names})", *said])
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{tool}(arguments STRING) RETURNS TABLE (error STRING, {columns}) RETURN {text}")
    return [f"{prefix}{tool}" for tool in _FUNCTIONS]
