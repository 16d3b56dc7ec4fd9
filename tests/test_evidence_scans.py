"""Evidence of line items: even tasks, and folds that move no long text."""

import contextlib
import io

from pyspark.sql import functions as F

from eligora.operators.extraction import distinct_evidence
from eligora.plans import verdict_queries as VQ
from tests.conftest import SMALL


def _plan(df):
    with contextlib.redirect_stdout(io.StringIO()) as out:
        df.explain()
    return out.getvalue()


def test_pieces_of_line_items_are_cut(spark, tmp_path):
    """A table of as many pieces as there are cores is cut too, so that the last wave of tasks is short."""
    spark.read.parquet(f"{SMALL}/lineitem.parquet").repartition(4).write.parquet(f"{tmp_path}/lineitem.parquet")
    pieces = spark.read.parquet(f"{tmp_path}/lineitem.parquet").rdd.getNumPartitions()
    assert VQ.evidence_numbers(spark, str(tmp_path)).rdd.getNumPartitions() >= 4 * pieces


def test_narrow_fold_equals_the_whole_one_without_its_texts(spark):
    rows = [(1, 1, "d", " v", "t ", 9), (1, 1, "d", "v ", "t", 3), (1, 1, "d", "v", "u", 1), (1, 1, "d", None, None, 5),
            (1, 1, "d", "", "", 4), (1, 1, None, "v", "t", 2), (2, 1, "d", "v", "t", 8), (1, 1, "e", "v", "t", 7)]
    df = spark.createDataFrame(rows, "b long, c long, source_document string, extracted_value string, source_text string, ordinal long")
    columns = ["b", "c", "source_document", F.trim(F.coalesce("extracted_value", F.lit(""))).alias("v"), "ordinal"]
    narrow = distinct_evidence(df, ["b", "c"], whole=False)
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, narrow.select(*columns).collect()), key=key) == sorted(map(tuple, distinct_evidence(df, ["b", "c"]).select(*columns).collect()), key=key)
    assert narrow.count() == 6
    assert "SortAggregate" not in _plan(narrow)
