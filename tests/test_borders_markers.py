"""Word borders beside letters that are not ASCII, and markers of many images."""

import time

import duckdb
import pytest
from lectern.functions import relations
from lectern.plans import registry
from pyspark.sql import functions as F

TEXTS = ["caf\u00e9tip and tip\u00e9", "\u00fc12 kWh, \u00df99 Elm Street", "moreau more\u00e9 \u00f1less", "\u00e9kWh \u00e9energy \u00e9123456", "mail \u00e9a.b@example.com\u00e9 now", "plain tip, 7 kWh, less"]


@pytest.mark.parametrize("name", ["energy_report_validation", "energy_report_flag", "structured_data", "importance_score"])
def test_borders_are_those_of_the_sql(spark, tmp_path, name):
    rows = [(i, t, "en", "src0", len(t)) for i, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    found = con.execute(registry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    wanted = sorted(repr(r) for r in found.fetchall())
    assert sorted(repr(tuple(r)) for r in registry.queries()[name](spark, str(tmp_path)).select(*names).collect()) == wanted


def folded(text, images):
    """Image after image, as the text grows."""
    for name, kind, x, y in images:
        mark = f"\n\n[IMAGE: {name} - {kind} at ({x}, {y})]\n\n"
        inside = "tip" in text.lower() and kind in ("photo", "illustration")
        text = text.replace("Monthly savings tip:", "Monthly savings tip:" + mark) if inside else text + mark
    return text


def marked(spark, text, images):
    frame = spark.createDataFrame([(text, images)], "text string, images array<struct<filename:string,type:string,x:int,y:int>>")
    return frame.select(relations.with_references(F.col("text"), F.col("images")).alias("t")).first().t


def test_markers_are_those_of_one_after_another(spark):
    kinds = ["photo", "chart", "illustration", "logo"]
    images = [(f"f{i}", kinds[i % 4], i, -i) for i in range(9)]
    late = [*images[:3], ("Tipped.png", "chart", 1, 2), *images[3:]]
    for text in ("", "no hint", "a TIP without label", "Monthly savings tip: x Monthly savings tip: y"):
        for own in ([], images, late):
            assert marked(spark, text, own) == folded(text, own)
    assert marked(spark, None, images) is None
    assert marked(spark, "a", [("f", None, 1, 2), ("g", "logo", 1, 2)]) == folded("a", [("g", "logo", 1, 2)])


def test_markers_of_many_images(spark):
    """One after another, 60,000 markers copied 75 GB of text."""
    images = [(f"img{i}", "photo" if i % 2 else "logo", i, i) for i in range(60_000)]
    began = time.time()
    text = marked(spark, "Monthly savings tip: z", images)
    assert time.time() - began < 30
    assert text.count("[IMAGE: ") == 60_000 and text.startswith("Monthly savings tip:\n\n[IMAGE: img59999 ") and text.endswith("[IMAGE: img59998 - logo at (59998, 59998)]\n\n")
