"""What must not grow with the input faster than it does: tasks, groups, batches."""

import pytest
from pyspark.sql import functions as F
from pyspark.util import PythonEvalType

from curalake.catalog import QUERIES
from curalake.functions import articles
from curalake.operators import merge, ordering, reports, sync

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["article_records", "citation_records"])
def test_costly_rows_are_dealt(spark, name):
    """Rows of few bytes that cost much are one file, but not one task."""
    df = QUERIES[name](spark, SF)
    assert df.rdd.getNumPartitions() >= int(spark.conf.get("spark.sql.shuffle.partitions")) > 1


def test_merged_lists(spark):
    """Lists keep the order of first positions, a null position first; a key's rows are reduced to distinct values before they meet."""
    rows = [("a", 2, 0.9, "t1", 7, "x", True), ("a", 1, 0.9, "t2", 8, "y", False), ("a", 3, 0.9, "t2", 7, "z", None), ("a", None, 0.1, "t3", 9, " ", True), (None, 1, 0.2, "t1", None, None, None)]
    df = spark.createDataFrame(rows, "k string, pos int, confidence double, trait string, pmid int, protein string, mr boolean")
    out = reports.merged_entries(df, "k", "pos", "confidence", 0.5, ["trait"], ["pmid"], ["protein"], ["mr"])
    assert {r.k: tuple(r)[1:] for r in out.collect()} == {"a": (["t2", "t1"], [9, 8, 7], "y", True, 0.9, 4), None: ([], [], None, False, 0.2, 1)}
    lists = out._jdf.queryExecution().optimizedPlan().toString().split("collect_list", 1)[1]
    assert "min(" in lists.split("Relation")[0].split("LogicalRDD")[0]


def test_rows_without_id_stay_apart(spark):
    """Rows without an id are skipped where they are, not gathered in one task by a join; of several last rows one is the refresh."""
    rows = spark.range(0, 1000, 1, 4).selectExpr("CASE WHEN id % 2 = 0 THEN NULL ELSE id % 10 END AS id", "id div 2 AS pos", "id AS other")
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        for k, v in zip(before, ("false", "-1")):
            spark.conf.set(k, v)
        out = sync.routed(spark.createDataFrame([(1,), (None,), (3,), (77,)], "id long"), rows, "id", "pos")
        assert out.where("route = 'skip'").select(F.spark_partition_id()).distinct().count() == 4
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {r.route: r["count"] for r in out.groupBy("route").count().collect()} == {"skip": 500, "refresh": 2, "insert": 300}
    assert {tuple(r) for r in out.where("route = 'refresh'").collect()} == {(1, 495, 991, "refresh"), (3, 496, 993, "refresh")}


def test_appended_values_are_not_broadcast(spark):
    """What is there has a row for each parent at least, so it isn't sent through the driver."""
    existing = spark.createDataFrame([("a", 1, "x")], "parent string, ordinal int, value string")
    incoming = spark.createDataFrame([("a", 1, "y"), ("a", 0, "x"), ("b", 3, "z")], "parent string, pos int, value string")
    out = merge.append_ordered(existing, incoming, "parent")
    assert "Broadcast" not in out._jdf.queryExecution().sparkPlan().toString()
    assert {tuple(r) for r in out.collect()} == {("a", 1, "x", False), ("a", 2, "y", True), ("b", 1, "z", True)}
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()


def test_pairs_of_a_frequent_text_are_dealt(spark, monkeypatch):
    """The pairs of one text are blocks of several tasks; each pair comes once, nulls match nothing."""
    monkeypatch.setattr(ordering, "BLOCK", 50, raising=False)
    left = spark.range(0, 300, 1, 1).selectExpr("id AS a", "CASE id % 3 WHEN 0 THEN 'Zoé' WHEN 1 THEN 'zoe' END AS x")
    right = spark.range(0, 120, 1, 1).selectExpr("id AS b", "CASE WHEN id % 2 = 0 THEN 'ZOE' WHEN id < 20 THEN 'no' END AS y")
    out = ordering.locale_join(left, right, "x", "y").select("a", "b")
    assert {tuple(r) for r in out.collect()} == {(a, b) for a in range(300) if a % 3 < 2 for b in range(0, 120, 2)} and out.count() == 12_000
    assert out.select(F.spark_partition_id()).distinct().count() > 1


def test_full_texts_stay_in_arrow(spark):
    """A batch of records isn't a series of Python texts; slices keep order and nulls."""
    assert articles.full_text.evalType == PythonEvalType.SQL_SCALAR_ARROW_UDF
    df = spark.range(0, 500, 1, 1).selectExpr("id", "CASE WHEN id % 7 > 0 THEN concat('<a><body><p>', id, '</p></body></a>') WHEN id % 2 = 0 THEN '<a' END AS xml")
    assert [r.t for r in df.select("id", articles.full_text("xml").alias("t")).orderBy("id").collect()] == [str(i) if i % 7 else None for i in range(500)]
