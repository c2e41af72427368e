"""Figure boxes on pages with graphics, and on scanned pages where only text blocks lie above a caption."""

import duckdb
import pytest
from pyspark.sql import functions as F

from lectern import queries as q
from lectern.operators import layout
from tests.compare import DATA, rows_of

q.load_all()

SHAPE = "paper_id string, page int, page_w double, page_h double, block_id string, rect struct<x0:double,y0:double,x1:double,y1:double>, text string"


def boxes(spark, blocks, graphics=()):
    row = lambda k, b: ("p", 1, 600.0, 800.0, f"b{k}", tuple(map(float, b[:4])), b[4] if len(b) > 4 else "")
    page = spark.createDataFrame([row(k, b) for k, b in enumerate(blocks)], SHAPE)
    shapes = spark.createDataFrame([row(k, b) for k, b in enumerate(graphics)], SHAPE)
    found = layout.figure_boxes(page, shapes).orderBy("box.y0").collect()
    return [tuple(r["box"]) for r in found]


def test_graphics_give_the_box_and_blocks_widen_it(spark):
    caption = (60, 500, 540, 520, "Figure 1: a plot")
    assert boxes(spark, [caption], [(100, 300, 300, 480)]) == [(94.0, 294.0, 306.0, 486.0)]
    # A label that reaches into the box widens it, and then the one beside that label fits too.
    labels = [(280, 470, 400, 490, "axis"), (390, 492, 460, 498, "unit")]
    assert boxes(spark, [caption, *labels], [(100, 300, 300, 480)]) == [(94.0, 294.0, 466.0, 504.0)]
    assert boxes(spark, [caption, *labels[1:]], [(100, 300, 300, 480)]) == [(94.0, 294.0, 306.0, 486.0)]


def test_scanned_page_walks_up(spark):
    caption = (40, 500, 250, 520, "Figure 2: scanned")
    near = [(50, 470, 200, 490, "label"), (60, 440, 210, 460, "label")]
    far = [(50, 300, 200, 320, "too far above the others")]
    other_column = [(350, 470, 500, 490, "right column")]
    page = (0, 0, 600, 800)
    assert boxes(spark, [caption, *near, *far, *other_column], [page]) == [(44.0, 434.0, 216.0, 496.0)]
    prose = [(40, 455, 290, 468, "running text " * 30)]
    assert boxes(spark, [caption, near[0], *prose, (60, 420, 210, 440, "beyond")], [page]) == []  # one label alone is too small
    assert boxes(spark, [caption]) == []


def test_captions_keep_to_themselves(spark):
    """Graphics above the caption before belong to that one; empty tables give nothing."""
    blocks = [(40, 200, 250, 220, "Figure 1: first"), (40, 500, 250, 520, "Figure 2: second")]
    graphics = [(50, 60, 200, 190), (50, 250, 200, 480)]
    assert boxes(spark, blocks, graphics) == [(44.0, 54.0, 206.0, 196.0), (44.0, 244.0, 206.0, 486.0)]
    empty = spark.createDataFrame([], SHAPE)
    assert layout.figure_boxes(empty, empty).agg(F.count("*")).first()[0] == 0


def test_bare_numbers_of_any_length(spark):
    """A page number has at most five digits; where longer numbers stand on a page, ``digits`` says so."""
    texts = ["12345", "page 7", "123456", "x 123456"]
    rows = [("p", 1, 600.0, 800.0, t, (100.0, 100.0, 300.0, 120.0), t) for t in texts]
    page = spark.createDataFrame(rows, SHAPE)
    assert {r["text"] for r in layout.body_blocks(page).collect()} == {"123456", "x 123456"}
    assert {r["text"] for r in layout.body_blocks(page, digits=None).collect()} == {"x 123456"}


@pytest.mark.parametrize("name", ["body_blocks", "gap_islands", "lane_clusters", "lanes"])
def test_part_keys_of_six_digits(spark, tmp_path, name):
    """Keys of a larger table, on which the layout queries differed from their SQL."""
    lines = spark.read.parquet(f"{DATA}/sf0.001/lineitem.parquet")
    lines.withColumn("l_partkey", F.col("l_partkey") + 120000).coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    df = q.QUERIES[name](spark, str(tmp_path))
    con.execute(q.ORACLES[name])
    want = rows_of([d[0] for d in con.description], con.fetchall())
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == want
