"""The stages of the pipeline on odd rows and on an empty table."""

import corpus_pipeline as cp
import pytest
from pyspark.sql import functions as F

KIND = "doc_id long, text string, lang string, source string, n_chars long"
LATER = [s for s in cp.STAGES if s[0] != "language_id"]


@pytest.mark.parametrize(("name", "stage"), cp.STAGES)
def test_empty_tables(spark, name, stage):
    out = stage(spark, spark.createDataFrame([], KIND), "")
    assert out.count() == 0
    if name != "encode":
        assert out.columns == cp.COLUMNS


def test_odd_rows_through_the_later_stages(spark):
    long = " ".join(f"word{i}" for i in range(30_000))
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (None, "some words of a text", "en", "a", 20), (3, long, "de", None, len(long)), (3, "another text of that id", None, "a", 9), (4, "\n \n", "en", "b", 3)]
    docs = spark.createDataFrame(rows, KIND).withColumn("size", F.lit("x")).withColumn("line", F.lit(1)).withColumn("h1", F.lit(2.5)).withColumn("n", F.lit(0))
    want = {
        "line_dedup": [None, "", "\n \n", "another text of that id", "some words of a text", long],
        "near_duplicates": [None, "", "\n \n", "another text of that id", "some words of a text", long],
    }
    for name, stage in LATER:
        out = stage(spark, docs, "").collect()
        if name in want:
            assert sorted([r.text for r in out], key=lambda t: (t is not None, t)) == want[name], name
        elif name == "mix":
            assert {r.text for r in out} <= {r[1] for r in rows if r[1] and r[1].strip()}
        else:
            assert len(out) == len(rows) and {r.n_tokens for r in out if r.doc_id in (1, 2)} == {2}
