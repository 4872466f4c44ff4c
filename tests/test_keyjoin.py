"""Joins on keys that may hold any share of the rows."""

from pyspark.sql import functions as F

from voxelspark.operators import components, keyjoin


def test_rows_of_hot_keys_are_dealt_at_random(spark, monkeypatch):
    monkeypatch.setattr(keyjoin, "LEAST", 10)
    rows = spark.range(4000).select(F.when(F.col("id") < 3000, 0).otherwise(F.col("id") % 500).cast("long").alias("k"), "id")
    table = rows.where("k <> 7").groupBy("k").agg(F.count("*").alias("m"), F.min("id").alias("least"))
    got = keyjoin.join_counted(rows, table, ["k"], 4000)
    assert got.columns == ["k", "id", "m", "least"]
    want = rows.join(table, "k").select(got.columns)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = keyjoin.join_counted(rows, table, ["k"], 4000)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("hashpartitioning(k") and "_spread" in plan.split("hashpartitioning(k", 1)[1].split(")")[0]


def test_components_in_many_tasks(spark, monkeypatch):
    """More edges than a task contracts: a star with a hot centre, a long path, repeated edges, loops and nulls."""
    monkeypatch.setattr(components, "CONTRACT", 100)
    monkeypatch.setattr(keyjoin, "LEAST", 20)
    edges = [(5, 1000 + k) for k in range(300)] + [(k, k + 1) for k in range(2000, 2400)] + [(5, 1001), (4, 4), (None, 3), (2200, 7)]
    got = dict(map(tuple, components.connected_components(spark.createDataFrame(edges, "u long, v long").repartition(6)).collect()))
    assert got == {5: 5, 7: 7} | {1000 + k: 5 for k in range(300)} | {k: 7 for k in range(2000, 2401)}
