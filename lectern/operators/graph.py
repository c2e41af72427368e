"""Citation graphs for many roots at once, and collection trees."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import normalize_title, reference_key, words
from lectern.operators.corpus import running_by
from lectern.session import checkpointed
from lectern.skew import LARGE, PAIR_CHUNK, exploded, number_rows, pairs_within

SIMILAR = 0.25
VISITS = 250_000


@dataclass
class CitationGraph:
    """Nodes, edges and summary, each computed when it is asked for.

    ``gathered`` holds the visits of the usual roots, dealt by root; ``spread`` the graphs of the others, if there are any.
    """

    gathered: DataFrame
    spread: SpreadGraph | None
    papers: DataFrame
    max_depth: int

    @cached_property
    def edges(self) -> DataFrame:
        edges = _gathered_edges(self.gathered).select("root_id", "source", "target", "weight", "relation")
        if self.spread:
            edges = edges.unionByName(self.spread.edges)
        return edges.withColumn("edge_id", F.concat_ws(":", "relation", "source", "target"))

    @cached_property
    def nodes(self) -> DataFrame:
        nodes = _gathered_nodes(self.gathered, self.papers)
        return nodes.unionByName(self.spread.nodes) if self.spread else nodes

    @property
    def summary(self) -> DataFrame:
        has_refs = (F.count_if(F.col("level") == 1) > 0).alias("has_refs")
        shown = _is_node()
        counts = _counted(self.gathered, F.when(shown, F.col("level")), F.when(shown, F.col("resolved")), has_refs, F.count_if(shown).alias("_nodes")).where("_nodes > 0").drop("_nodes")
        if self.spread:
            counts = counts.unionByName(self.spread.counts)
        return graph_summary(counts, self.max_depth)


@dataclass
class SpreadGraph:
    """The graphs of roots too large for one task: every join and grouping is dealt by the finest key there is."""

    members: DataFrame
    relations: list[DataFrame]
    counts: DataFrame

    @cached_property
    def edges(self) -> DataFrame:
        return checkpointed(reduce(DataFrame.unionByName, self.relations))

    @cached_property
    def nodes(self) -> DataFrame:
        return self.members.join(degrees(self.edges), ["root_id", "node_id"], "left").withColumn("degree", F.coalesce("degree", F.lit(0).cast("long")))


def _key() -> Column:
    """Keys are kept as 16 bytes of their SHA-256."""
    return F.unhex(F.left(F.sha2(reference_key(F.col("doi"), F.col("arxiv"), F.col("title")), 256), F.lit(32)))


# ------------------------------------------------------------------- usual roots: one deal by root

def _is_node() -> Column:
    """The row that stands for its node: the root's own, and the first visit of any other."""
    return (F.col("_nth") == 1) & ((F.col("level") == 0) | (F.col("node_id") != F.col("root_id")))


def _gathered(requests: DataFrame, papers: DataFrame, refs: DataFrame, ref_id: Column, max_depth: int, tasks: int) -> DataFrame:
    """The visits of every root, dealt once by root; everything after that is a window or a grouping within a root.

    ``requests(root_id, source, dord, depth)``: the papers whose references a root visits.  A paper itself travels like one of its
    references.  ``level``: 0 the root itself, 1 its references, 2 those of its direct papers, 3 a direct paper itself.  Node of a visit:
    its paper, else the paper its key had before, else the id of the first visit of its key.  Keys, ids and names
    follow from what was dealt, so they do not travel, and what a result doesn't ask for does not travel either.
    """
    shown = {c: F.col(c) if c in papers.columns else F.lit(None).cast(kind) for c, kind in (("authors", "array<string>"), ("year", "int"))}
    own = papers.select(F.col("id").alias("paper_id"), "title", *[v.alias(c) for c, v in shown.items()], F.lit(True).alias("own"))
    all_rows = refs.withColumns({"pos": F.col("pos").cast("long"), "own": F.lit(False)}).unionByName(own, allowMissingColumns=True)
    met = requests.join(all_rows, F.col("source") == F.col("paper_id")).where(F.col("own") | (F.col("depth") <= max_depth))
    dealt = met.drop("source").repartition(tasks, "root_id").withColumn("source", F.col("paper_id"))
    level = F.when(~F.col("own"), F.col("depth")).when(F.col("depth") == 1, 0).otherwise(3)
    rows = dealt.withColumns({"level": level, "key": F.when(~F.col("own"), _key()), "ref_id": ref_id})
    order = ["level", "dord", "pos", "source", "ref_id"]
    so_far = Window.partitionBy("root_id", "key").orderBy(*order)
    until, earlier = so_far.rowsBetween(Window.unboundedPreceding, 0), so_far.rowsBetween(Window.unboundedPreceding, -1)
    before = F.last("resolved_id", ignorenulls=True).over(until)
    rows = rows.withColumns({
        "node_id": F.when(F.col("own"), F.col("source")).otherwise(F.coalesce(before, F.first("ref_id").over(until))),
        "resolved": F.col("own") | F.coalesce(F.last("is_paper", ignorenulls=True).over(until), F.lit(False)),
        "sharing": F.collect_set(F.when(F.col("level") == 2, F.struct(F.col("dord").alias("at"), F.col("source").alias("node")))).over(earlier)})
    of_node = Window.partitionBy("root_id", "node_id").orderBy(*order)
    named = F.max(F.when(F.col("level") == 3, F.col("title"))).over(of_node.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return rows.withColumns({"_nth": F.row_number().over(of_node), "shown_title": F.coalesce(named, F.col("title"))})


def _gathered_edges(rows: DataFrame, info: Column | None = None) -> DataFrame:
    """Every edge once with its weight.  With ``info`` there is also a row without target for every node, which carries it."""
    none = F.lit(None).cast("long")

    def edge(relation: str, source: Column, target: Column, weight: Column | int = 1, up: Column = none, down: Column = none, what: Column | None = None) -> Column:
        more = [] if info is None else [(what if what is not None else F.when(F.lit(False), info)).alias("info")]
        return F.struct(source.alias("source"), target.alias("target"), F.lit(relation).alias("relation"), (F.lit(weight) if isinstance(weight, int) else weight).cast("long").alias("weight"),
                        up.alias("up_at"), down.alias("down_at"), *more)

    source, node, cited, dord, level = (F.col(c) for c in ("source", "node_id", "resolved_id", "dord", "level"))
    visit = level.isin(1, 2)
    # Both directions of a pair of direct papers that cite each other meet in one group.
    mutual = edge("mutual_citation", F.least(source, cited), F.greatest(source, cited), 1, F.when(source < cited, dord), F.when(source > cited, dord))
    single = [F.when(visit & (node != source), edge("cites", source, node)), F.when((level == 2) & (source != cited), mutual)]
    if info is not None:
        single.append(F.when(_is_node(), edge("", node, F.lit(None).cast("string"), 0, what=info)))
    fresh = (level == 2) & ~F.exists("sharing", lambda s: s["node"] == source)
    shared = F.transform(F.filter("sharing", lambda s: fresh & (s["at"] < dord)), lambda s: edge("shared_reference", s["node"], source))

    # Direct nodes of a root, each with those before it.
    direct = (level == 1) & _is_node()
    names = F.array_distinct(F.array_compact(F.transform("authors", normalize_title)))
    bag = F.array_distinct(words(normalize_title(F.coalesce(F.col("shown_title"), F.lit("")))))
    rows = rows.withColumn("_direct", direct)
    rows = rows.withColumns({"names": F.when(F.col("_direct"), F.coalesce(names, F.array().cast("array<string>"))), "bag": F.when(F.col("_direct"), bag)})
    others = Window.partitionBy("root_id", "_direct").orderBy("pos", "node_id").rowsBetween(Window.unboundedPreceding, -1)
    met = F.when(F.col("_direct"), F.struct(F.col("pos").alias("at"), node.alias("node"), "names", "bag"))
    rows = rows.withColumn("others", F.collect_list(met).over(others))
    pairs = F.transform(F.filter("others", lambda o: o["at"] < F.col("pos")), lambda o: F.struct(
        o["node"].alias("node"), F.size(F.array_intersect(o["names"], F.col("names"))).alias("c"), F.size(F.array_intersect(o["bag"], F.col("bag"))).alias("w"), (F.size(o["bag"]) + F.size("bag")).alias("n")))
    coauthor = F.transform(F.filter(pairs, lambda p: p["c"] > 0), lambda p: edge("coauthor", p["node"], node, p["c"]))
    alike = F.transform(F.filter(pairs, lambda p: (p["w"] > 0) & (F.when(p["w"] > 0, p["w"] / (p["n"] - p["w"])) >= SIMILAR)), lambda p: edge("topic_similarity", p["node"], node, _tenths(p["w"] / (p["n"] - p["w"]))))

    each = exploded(rows, F.concat(F.array_compact(F.array(*single)), shared, coauthor, alike), "e", "root_id").select("root_id", "e.*")
    carried = [] if info is None else [F.first("info", ignorenulls=True).alias("info")]
    met = each.groupBy("root_id", "source", "target", "relation").agg(F.sum("weight").alias("weight"), F.min("up_at").alias("up_at"), F.min("down_at").alias("down_at"), *carried)
    is_mutual, first = F.col("relation") == "mutual_citation", F.col("up_at") < F.col("down_at")
    met = met.where(~is_mutual | (F.col("up_at").isNotNull() & F.col("down_at").isNotNull()))
    turned = is_mutual & ~first
    return met.select("root_id", F.when(turned, F.col("target")).otherwise(F.col("source")).alias("source"), F.when(turned, F.col("source")).otherwise(F.col("target")).alias("target"),
                      F.when(is_mutual, F.lit(1).cast("long")).otherwise(F.col("weight")).alias("weight"), "relation", *(["info"] if carried else []))


def _gathered_nodes(rows: DataFrame, papers: DataFrame) -> DataFrame:
    """Nodes with their degrees, stored once; only papers of the second level are looked up for their titles."""
    info = F.struct(F.col("level").alias("depth"), F.col("shown_title").alias("title"), "authors", "year", "resolved")
    edges = _gathered_edges(rows, info)
    ends = edges.select("root_id", (F.col("relation") != "").cast("long").alias("n"), "info", F.explode(F.array_compact(F.array("source", "target"))).alias("node_id"))
    nodes = ends.groupBy("root_id", "node_id").agg(F.sum("n").alias("degree"), F.first("info", ignorenulls=True).alias("info")).where("info is not null")
    columns = ["root_id", "node_id", "title", "authors", "year", "resolved", "depth", "degree"]
    nodes = checkpointed(nodes.select("root_id", "node_id", "degree", "info.*").select(*columns))
    looked = (F.col("depth") == 2) & F.col("resolved")
    far = nodes.where(looked).join(papers.select(F.col("id").alias("node_id"), F.col("title").alias("paper_title")), "node_id", "left")
    return nodes.where(~looked).unionByName(far.withColumn("title", F.coalesce("paper_title", "title")).select(*columns))


# ---------------------------------------------------------- roots of any size: dealt by root and key

def _visits(roots: DataFrame, refs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """References in visiting order: the root's own, then those of its direct nodes.

    Keys are kept as 16 bytes of their SHA-256, and every reference has a stored number ``ref`` by which a node's title
    and authors are looked up at the end, so that texts do not travel with the visits.
    """
    keyed = checkpointed(refs.select(F.monotonically_increasing_id().alias("ref"), "paper_id", "pos", "ref_id", "title", "authors", "year", _key().alias("key"), "resolved_id"))
    first = roots.select("root_id").join(keyed, roots["root_id"] == keyed["paper_id"]).drop("paper_id")
    return keyed, first.withColumn("depth", F.lit(1))


def _node_ids(visits: DataFrame) -> DataFrame:
    """Node of each visit: its paper, else the node its key had before, else its own id.

    The visits meet the totals of their keys once; the result is stored, and only keys seen both resolved and
    unresolved need the order-dependent rule.  ``repeated`` tells keys with more than one visit.
    """
    grouped = visits.groupBy("root_id", "key").agg(
        F.min_by("ref_id", F.struct("depth", "dord", "pos")).alias("_first"),
        F.max(F.col("resolved_id").isNotNull().cast("int")).alias("_some"), F.min(F.col("resolved_id").isNotNull().cast("int")).alias("_all"),
        (F.count(F.lit(1)) > 1).alias("repeated"),
    )
    is_mixed = F.col("_some") != F.col("_all")
    known = visits.join(grouped, ["root_id", "key"]).withColumn("node_id", F.when(is_mixed, F.col("_first")).otherwise(F.coalesce("resolved_id", "_first")))
    known = checkpointed(known.withColumn("_mixed", is_mixed).drop("_first", "_some", "_all", "ref_id"))
    mixed = known.where("_mixed").withColumn("_v", F.col("depth") * F.lit(1 << 40) + F.col("dord"))
    mixed = running_by(mixed, ["root_id", "key"], ["_v", "pos"], {"_last": ("last", F.col("resolved_id"))})
    mixed = checkpointed(mixed.withColumn("node_id", F.coalesce("_last", "node_id")).drop("_v", "_last"))
    return known.where("not _mixed").unionByName(mixed).drop("_mixed")


def _spread_graph(roots: DataFrame, papers: DataFrame, refs: DataFrame, max_depth: int) -> SpreadGraph:
    keyed, first = _visits(roots, refs)
    direct_visits = _node_ids(first.withColumn("dord", F.lit(0).cast("long")))
    direct_all = direct_visits.where(F.col("node_id") != F.col("root_id"))
    direct = direct_all.groupBy("root_id", "node_id").agg(
        F.min_by(F.struct("title", "authors", "year", "resolved_id"), "pos").alias("a"), F.min("pos").cast("long").alias("dord")
    )
    title_of = papers.select(F.col("id").alias("node_id"), F.col("title").alias("paper_title"))
    direct = direct.join(title_of, "node_id", "left").select(
        "root_id", "node_id", "dord", F.coalesce("paper_title", "a.title").alias("title"), F.col("a.authors").alias("authors"),
        F.col("a.year").alias("year"), F.col("paper_title").isNotNull().alias("resolved"),
    )
    direct = checkpointed(direct)

    cites = direct_all.select("root_id", F.col("root_id").alias("source"), F.col("node_id").alias("target"))
    nodes = [direct.select("root_id", "node_id", "title", "authors", "year", "resolved", F.lit(1).alias("depth"))]
    bare = ["root_id", "depth", "resolved"]
    counted = [nodes[0].select(*bare)]
    relations: list[DataFrame] = []
    if max_depth == 2:
        steps = ["root_id", "source", "dord", "depth", "ref", "pos", "ref_id", "key", "resolved_id"]
        second = (
            direct.where("resolved").select("root_id", F.col("node_id").alias("source"), "dord")
            .join(keyed, F.col("source") == F.col("paper_id")).withColumn("depth", F.lit(2)).select(*steps)
        )
        both = second.unionByName(first.withColumn("dord", F.lit(0).cast("long")).withColumn("source", F.col("root_id")).select(*steps))
        visited = _node_ids(both).where("depth = 2")
        second_all = visited.where(F.col("node_id") != F.col("source"))
        cites = cites.unionByName(second_all.select("root_id", "source", F.col("node_id").alias("target")))
        fresh = visited.where(F.col("node_id") != F.col("root_id"))
        reached = fresh.groupBy("root_id", "node_id").agg(F.min(F.struct("dord", "pos", "ref")).alias("at"))
        reached = reached.join(direct.select("root_id", "node_id"), ["root_id", "node_id"], "left_anti").join(title_of, "node_id", "left")
        reached = reached.select("root_id", "node_id", "at.ref", "paper_title", F.col("paper_title").isNotNull().alias("resolved"), F.lit(2).alias("depth"))
        counted.append(reached.select(*bare))
        described = reached.join(keyed.select("ref", "title", "authors", "year"), "ref")
        nodes.append(described.select("root_id", "node_id", F.coalesce("paper_title", "title").alias("title"), "authors", "year", "resolved", "depth"))
        keys = visited.where("repeated").select("root_id", "source", "dord", "key").distinct()
        relations.append(_weighted(pairs_within(keys, ["root_id", "key"], "source", "dord"), "source", "shared_reference"))
        relations.append(_mutual(visited))
    relations.append(coauthor_edges(direct))
    relations.append(topic_edges(direct))

    weighted = cites.groupBy("root_id", "source", "target").agg(F.count(F.lit(1)).alias("weight")).withColumn("relation", F.lit("cites"))

    shown = {c: F.col(c) if c in papers.columns else F.lit(None).cast(kind) for c, kind in (("authors", "array<string>"), ("year", "int"))}
    root_nodes = papers.select(F.col("id").alias("root_id"), F.col("id").alias("node_id"), "title", *[v.alias(c) for c, v in shown.items()], F.lit(True).alias("resolved"), F.lit(0).alias("depth")).join(roots.select("root_id"), "root_id", "left_semi")
    members = reduce(DataFrame.unionByName, nodes, root_nodes)
    with_refs = first.select("root_id").distinct().withColumn("has_refs", F.lit(True))
    counts = _counted(reduce(DataFrame.unionByName, counted, root_nodes.select(*bare)), F.col("depth"), F.col("resolved"))
    counts = counts.join(with_refs, "root_id", "left").withColumn("has_refs", F.coalesce("has_refs", F.lit(False)))
    return SpreadGraph(members, [weighted, *relations], counts)


def _spread_roots(requests: DataFrame, lengths: DataFrame, wide: int, large: int) -> DataFrame | None:
    """Roots of more than ``wide`` references or ``large`` visits."""
    loads = requests.join(lengths, F.col("source") == F.col("paper_id")).groupBy("root_id").agg(F.max(F.when(F.col("depth") == 1, F.col("n"))).alias("own"), F.sum("n").alias("visits"))
    many = checkpointed(loads.where((F.col("own") > wide) | (F.col("visits") > large)).select("root_id"))
    return None if many.isEmpty() else many


def build_graphs(roots: DataFrame, papers: DataFrame, refs: DataFrame, max_depth: int = 2, ref_id: Column | None = None, wide: int = PAIR_CHUNK, large: int = LARGE) -> CitationGraph:
    """The citation graph of every root.

    ``papers(id, title)`` with optional ``authors`` and ``year``, shown at the root; ``refs(paper_id, pos, ref_id, title,
    authors, year, doi, arxiv, resolved_id)``, resolved once for the whole corpus: another node shows the authors
    and year of the reference that first led to it.  An id that follows from the other columns may be given
    as ``ref_id`` instead of a column.  Five edge relations; ids are strings.

    References are written once.  The visits of a root are dealt once by root, by each result that is asked for.  Roots of more than ``wide`` references or ``large`` visits, if there are any, go
    through joins dealt by root and key, so that no task holds one of them.
    """
    if max_depth not in (1, 2):
        raise ValueError("max_depth must be 1 or 2")
    columns = ["paper_id", "pos", "title", "authors", "year", "doi", "arxiv", "resolved_id", *([] if ref_id is not None else ["ref_id"])]
    ids = F.col("ref_id") if ref_id is None else ref_id
    refs = checkpointed(refs.select(*columns))
    known = papers.select(F.col("id").alias("resolved_id"))
    named = refs.select("resolved_id").where("resolved_id is not null").distinct()
    stray = checkpointed(named.join(known, "resolved_id", "left_anti"))
    refs = refs.withColumn("is_paper", F.when(F.col("resolved_id").isNotNull(), F.lit(True)))
    if not stray.isEmpty():
        refs = refs.join(stray.withColumn("_stray", F.lit(False)), "resolved_id", "left").withColumn("is_paper", F.coalesce("_stray", "is_paper")).drop("_stray")

    hops = refs.where("is_paper and resolved_id <> paper_id").select("paper_id", "resolved_id", "pos")
    direct = roots.select("root_id").join(hops, F.col("root_id") == F.col("paper_id")).groupBy("root_id", F.col("resolved_id").alias("source")).agg(F.min("pos").cast("long").alias("dord"))
    at_root = roots.select("root_id", F.col("root_id").alias("source"), F.lit(0).cast("long").alias("dord"))
    requests = checkpointed(direct.withColumn("depth", F.lit(2)).unionByName(at_root.withColumn("depth", F.lit(1))))
    lengths = refs.groupBy("paper_id").agg(F.count(F.lit(1)).alias("n"))
    longest, usual = lengths.agg(F.coalesce(F.max("n"), F.lit(0)), F.coalesce(F.avg("n"), F.lit(0.0))).first()
    # The visits are dealt into tasks of about as many each, more of them as the tables grow.
    tasks = max(roots.sparkSession.sparkContext.defaultParallelism, int(requests.count() * (usual + 1) / VISITS) + 1)
    spread = None
    # A root visits no more than its references and theirs, so without a long list no root is too large.
    if (longest > wide or longest * (longest + 1) > large) and (many := _spread_roots(requests, lengths, wide, large)) is not None:
        requests = requests.join(many, "root_id", "left_anti")
        spread = _spread_graph(many, papers, refs.withColumn("ref_id", ids), max_depth)
    return CitationGraph(_gathered(requests, papers, refs, ids, max_depth, tasks), spread, papers, max_depth)


def _weighted(pairs: DataFrame, item: str, relation: str) -> DataFrame:
    counted = pairs.groupBy("root_id", F.col(f"left_{item}").alias("source"), F.col(f"right_{item}").alias("target")).agg(F.count(F.lit(1)).alias("weight"))
    return counted.withColumn("relation", F.lit(relation))


def _mutual(second: DataFrame) -> DataFrame:
    """Direct papers that cite each other: both directions of a pair meet in one aggregate."""
    a, b = F.col("source"), F.col("resolved_id")
    cites = second.where(b.isNotNull() & (a != b)).select("root_id", F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"), (a < b).alias("up"), "dord")
    pairs = cites.groupBy("root_id", "lo", "hi").agg(F.min(F.when(F.col("up"), F.col("dord"))).alias("lo_at"), F.min(F.when(~F.col("up"), F.col("dord"))).alias("hi_at"))
    first = F.col("lo_at") < F.col("hi_at")
    both = pairs.where("lo_at is not null and hi_at is not null")
    return both.select(
        "root_id", F.when(first, F.col("lo")).otherwise(F.col("hi")).alias("source"), F.when(first, F.col("hi")).otherwise(F.col("lo")).alias("target"),
        F.lit(1).cast("long").alias("weight"), F.lit("mutual_citation").alias("relation"))


def coauthor_edges(direct: DataFrame) -> DataFrame:
    names = direct.select("root_id", "node_id", "dord", F.explode(F.array_distinct(F.transform("authors", normalize_title))).alias("name"))
    return _weighted(pairs_within(names, ["root_id", "name"], "node_id", "dord"), "node_id", "coauthor")


def _tenths(similarity: Column) -> Column:
    return F.greatest(F.lit(1), F.bround(similarity * 10, 0).cast("long"))


def topic_edges(direct: DataFrame, threshold: float = SIMILAR, chunk: int = PAIR_CHUNK) -> DataFrame:
    """Word-set Jaccard of titles at or above the threshold.

    Words of a root are ranked from rare to frequent.  A word that one title alone has can meet nothing, so it is only
    counted; the others keep their rank, and a title is listed under a word while enough of its words are left for
    the threshold.  Two titles are compared under the first word they share: there both their sizes and the
    ranks bound the overlap, and the lists that travel with them give it, so nothing is joined again.  A word of many titles is dealt into buckets.
    """
    sets = direct.select("root_id", "node_id", "dord", F.array_distinct(words(normalize_title(F.coalesce(F.col("title"), F.lit(""))))).alias("set"))
    exploded = sets.select("root_id", "node_id", "dord", F.size("set").alias("n"), F.explode("set").alias("word"))
    frequency = exploded.groupBy("root_id", "word").agg(F.count(F.lit(1)).alias("f")).where("f > 1")
    ranked = exploded.join(frequency, ["root_id", "word"]).groupBy("root_id", "node_id", "dord", "n").agg(F.array_sort(F.collect_list(F.struct("f", "word"))).alias("ranked"))
    lists = ranked.select("root_id", "node_id", "dord", "n", F.transform("ranked", lambda r: r["word"]).alias("shared"), "ranked")
    # ``left``: how many words of the title stand at this word or behind it.
    at = lists.select("root_id", "node_id", "dord", "n", "shared", F.posexplode("ranked").alias("i", "r"))
    listed = at.select("root_id", "node_id", "dord", "n", "shared", "r.word", F.ceil(F.col("r.f") / F.lit(chunk)).cast("int").alias("buckets"), (F.size("shared") - F.col("i")).alias("left"))
    listed = listed.where(F.col("left") >= F.ceil(F.col("n") * threshold))

    def side(name: str, bucket: Column) -> DataFrame:
        return listed.select("root_id", "word", bucket.alias("bucket"), *[F.col(c).alias(f"{name}_{c}") for c in ("node_id", "dord", "n", "shared", "left")])

    left = side("a", F.pmod(F.hash("node_id"), F.col("buckets")))
    right = side("b", F.explode(F.sequence(F.lit(0), F.col("buckets") - 1)))
    total = F.col("a_n") + F.col("b_n")
    met = left.join(right, ["root_id", "word", "bucket"]).where((F.col("a_dord") < F.col("b_dord")) & (F.least("a_left", "b_left") * (1 + threshold) >= threshold * total - 1e-9))
    common = F.array_intersect("a_shared", "b_shared")
    counted = met.select("root_id", "a_node_id", "b_node_id", "word", total.alias("total"), common.alias("common")).where(F.get("common", F.lit(0)) == F.col("word"))
    similarity = F.size("common") / (F.col("total") - F.size("common"))
    rated = counted.select("root_id", F.col("a_node_id").alias("source"), F.col("b_node_id").alias("target"), similarity.alias("similarity")).where(F.col("similarity") >= threshold)
    return rated.select("root_id", "source", "target", _tenths(F.col("similarity")).alias("weight"), F.lit("topic_similarity").alias("relation"))


def degrees(edges: DataFrame) -> DataFrame:
    """Edges at each node, every edge once per end."""
    ends = edges.select("root_id", F.explode(F.array("source", "target")).alias("node_id"))
    return ends.groupBy("root_id", "node_id").agg(F.count(F.lit(1)).alias("degree"))


def _counted(nodes: DataFrame, depth: Column, resolved: Column, *more: Column) -> DataFrame:
    return nodes.groupBy("root_id").agg(
        F.count_if(depth == 1).alias("direct_count"), F.count_if(depth == 2).alias("second_level_count"),
        F.count_if(~resolved).alias("unresolved_count"), F.count_if((depth == 1) & ~resolved).alias("_d"), *more)


def graph_summary(counts: DataFrame, max_depth: int) -> DataFrame:
    counts = counts.withColumn("warnings", F.col("_d") if max_depth == 2 else F.lit(0).cast("long")).drop("_d")
    ready = F.col("has_refs") & (F.col("warnings") == 0)
    return counts.withColumn("status", F.when(ready, "ready").otherwise("partial")).drop("has_refs")


def visible_nodes(nodes: DataFrame, depth: int | None = None, resolved: bool | None = None, query: str = "") -> DataFrame:
    """Filtered nodes without the root, with their ``place`` in the root's list: most connected first."""
    found = nodes.where(F.col("node_id") != F.col("root_id"))
    if depth is not None:
        found = found.where(F.col("depth") == depth)
    if resolved is not None:
        found = found.where(F.col("resolved") == resolved)
    if query.strip():
        hay = F.lower(F.concat_ws(" ", "title", F.coalesce(F.array_join("authors", " "), F.lit("")), F.coalesce(F.col("year").cast("string"), F.lit(""))))
        found = found.where(F.contains(hay, F.lower(F.lit(query.strip()))))
    order = found.withColumn("_less", -F.col("degree"))
    return number_rows(order, ["root_id"], ["_less", "title", "node_id"], "place").drop("_less")


def mutual_pairs(edges: DataFrame, source: str, target: str) -> DataFrame:
    """Pairs that point at each other, lower id first."""
    distinct = edges.select(F.col(source).alias("a"), F.col(target).alias("b")).where("a <> b").distinct()
    back = distinct.select(F.col("a").alias("b"), F.col("b").alias("a"))
    return distinct.join(back, ["a", "b"]).where("a < b")


# -------------------------------------------------------------------------------- trees

def closure(nodes: DataFrame) -> DataFrame:
    """``(ancestor, id)`` for every node and all its descendants, itself included.

    ``nodes(id, parent_id)``.  Paths double each round, so a tree of depth d takes log2(d)
    rounds; set semantics make cycles harmless.  Each round is checkpointed.
    """
    own = nodes.select(F.col("id").alias("ancestor"), "id")
    step = nodes.where("parent_id is not null").join(nodes.select(F.col("id").alias("_p")), F.col("parent_id") == F.col("_p"), "left_semi")
    reach = checkpointed(own.unionByName(step.select(F.col("parent_id").alias("ancestor"), "id")).distinct())
    size = reach.count()
    while True:
        further = reach.alias("a").join(reach.alias("b"), F.col("a.id") == F.col("b.ancestor")).select(F.col("a.ancestor"), F.col("b.id"))
        reach = checkpointed(further.distinct())
        grown = reach.count()
        if grown == size:
            return reach
        size = grown


def cyclic_nodes(nodes: DataFrame, reach: DataFrame) -> DataFrame:
    """Nodes that are their own proper ancestor."""
    up = nodes.where("parent_id is not null").select("id", "parent_id")
    return up.join(reach, (up["id"] == reach["ancestor"]) & (up["parent_id"] == reach["id"]), "left_semi").select("id")


def direct_counts(nodes: DataFrame, members: DataFrame) -> DataFrame:
    counts = members.groupBy("collection_id").agg(F.count("paper_id").alias("n_papers"))
    return nodes.select("id").join(counts, F.col("id") == F.col("collection_id"), "left").select("id", F.coalesce("n_papers", F.lit(0).cast("long")).alias("n_papers"))


def subtree_counts(nodes: DataFrame, reach: DataFrame, members: DataFrame) -> DataFrame:
    """Distinct papers below each node; papers are made distinct per node before counting."""
    below = reach.join(members, F.col("id") == F.col("collection_id")).select(F.col("ancestor").alias("id"), "paper_id").distinct()
    counts = below.groupBy("id").agg(F.count(F.lit(1)).alias("total_papers"))
    return nodes.select("id").join(counts, "id", "left").select("id", F.coalesce("total_papers", F.lit(0).cast("long")).alias("total_papers"))


def in_collection(papers: DataFrame, members: DataFrame, reach: DataFrame, collection: Column | None) -> DataFrame:
    """Papers of a collection and everything below it; ``None`` gives the uncategorized."""
    if collection is None:
        return papers.join(members, papers["id"] == members["paper_id"], "left_anti")
    inside = members.join(reach.where(F.col("ancestor") == collection), F.col("collection_id") == reach["id"], "left_semi")
    return papers.join(inside, papers["id"] == inside["paper_id"], "left_semi")


def tree_order(nodes: DataFrame, locale: str = "zh") -> DataFrame:
    """Nodes with their ``place`` in the flat listing: roots first, then sort order, then name under the collation of
    ``locale``, then id.

    Rows are range-partitioned by the collated name like any other key, so nothing is sorted as a whole.
    """
    keyed = nodes.withColumns({"_below": F.col("parent_id").isNotNull(), "_collated": F.collate(F.col("name"), locale)})
    return number_rows(keyed, [], ["_below", "sort_order", "_collated", "id"], "place").drop("_below", "_collated")


def library_fingerprint(papers: DataFrame) -> DataFrame:
    """A digest of the library's state that does not depend on row order.

    Rows are hashed where they lie and added up as two independent sums with the count, so
    the library is never gathered in one place.
    """
    digest = F.sha2(F.concat_ws("|", F.col("id").cast("string"), "sha256", F.col("updated_at").cast("string")), 256)
    part = lambda i: F.conv(F.substring(digest, i, 12), 16, 10).cast("decimal(38,0)")
    sums = papers.select(part(1).alias("a"), part(13).alias("b"), part(25).alias("c")).agg(
        F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("c").alias("c"), F.count(F.lit(1)).alias("n"))
    return sums.select(F.sha2(F.concat_ws(":", "n", "a", "b", "c"), 256).alias("fingerprint"))


def stale_graphs(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    """(root, depth, fingerprint, schema) combinations with no cached artifact."""
    return wanted.join(cache, ["root_id", "max_depth", "fingerprint", "schema_version"], "left_anti")


GRAPH_SCHEMA_VERSION = 2
CACHE_BUCKETS = 64


@dataclass
class CachedGraphs:
    """Stored nodes, edges and summaries of the roots asked for, and how many of them were computed now."""

    nodes: DataFrame
    edges: DataFrame
    summary: DataFrame
    computed: int


def cached_graphs(roots: DataFrame, papers: DataFrame, refs: DataFrame, fingerprint: str, path: str, max_depth: int = 2, buckets: int = CACHE_BUCKETS) -> CachedGraphs:
    """The graphs of ``roots(root_id)``, read from the cache at ``path`` where it has them for this state of the library.

    ``fingerprint`` is that of ``library_fingerprint``.  Entries are kept by root and depth in ``buckets`` partitions of three tables; roots
    without an entry of this fingerprint and schema are computed together, and only the partitions they fall in are
    written again.  The summary is written last: a root counts as cached once it is there.
    """
    spark = roots.sparkSession
    bucket = F.pmod(F.xxhash64("root_id"), F.lit(buckets)).cast("int")
    wanted = roots.select("root_id").distinct().select("root_id", F.lit(max_depth).alias("max_depth"), F.lit(fingerprint).alias("fingerprint"), F.lit(GRAPH_SCHEMA_VERSION).alias("schema_version"))

    def stored(table: str) -> DataFrame | None:
        try:
            return spark.read.parquet(f"{path}/{table}")
        except AnalysisException:  # nothing was cached yet
            return None

    entries = stored("summary")
    missing = checkpointed(wanted if entries is None else stale_graphs(wanted, entries.select("root_id", "max_depth", "fingerprint", "schema_version")))
    count = missing.count()
    if count:
        built = build_graphs(missing.select("root_id"), papers, refs, max_depth)
        touched = checkpointed(missing.select(bucket.alias("bucket")).distinct())
        for table, rows in (("nodes", built.nodes), ("edges", built.edges), ("summary", built.summary)):
            fresh = rows.join(missing, "root_id").withColumn("bucket", bucket)
            before = stored(table)
            if before is not None:
                kept = before.join(touched, "bucket", "left_semi").join(missing.select("root_id", "max_depth"), ["root_id", "max_depth"], "left_anti")
                fresh = kept.unionByName(fresh)
            # Stored before the partitions it was read from are replaced.
            checkpointed(fresh).repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{path}/{table}")
    key = ["root_id", "max_depth", "fingerprint", "schema_version"]
    read = {t: spark.read.parquet(f"{path}/{t}").join(wanted, key, "left_semi").drop("max_depth", "fingerprint", "schema_version", "bucket") for t in ("nodes", "edges", "summary")}
    return CachedGraphs(read["nodes"], read["edges"], read["summary"], count)
