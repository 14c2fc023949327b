from pyspark.sql import functions as F

from gridloom.operators import skew


def data(spark):
    rows = [("hot", i) for i in range(6000)] + [("warm", i) for i in range(1500)] + [(f"k{i % 900}", i) for i in range(4500)] + [(None, i) for i in range(3000)]
    return spark.createDataFrame(rows, "key string, x int")


def test_loads_are_even_and_placed_as_planned(spark):
    df = data(spark)
    plan = skew.plan_loads(df, "key", tasks=16)
    assert plan.rows == 15000 and plan.total == 12000
    assert {k for k, _, _ in plan.heavy} == {"hot", "warm"}
    assert plan.imbalance < 1.5
    f = skew.fragment(df.where("key is not null"), "key", plan, "slot")
    loads = [r.n for r in f.groupBy(F.pmod(F.hash("slot", "key"), F.lit(16)).alias("t")).agg(F.count("*").alias("n")).collect()]
    assert max(loads) < 1.6 * sum(loads) / 16
    by_task = f.where("key = 'hot'").groupBy("slot").count().collect()
    assert len(by_task) > 4


def test_join_equals_plain_join(spark):
    df = data(spark)
    right = spark.createDataFrame([("hot", 1, "a"), ("hot", 2, "b"), ("k1", 3, "c"), ("none", 4, "d"), (None, 5, "e")], "key string, x int, label string")
    for how in ("inner", "left", "left_semi", "left_anti"):
        got = skew.fragment_replicate_join(df, right, "key", how)
        plain = df.join(right.withColumnRenamed("x", "x_right"), "key", how)
        assert sorted(map(str, got.select(*plain.columns).collect())) == sorted(map(str, plain.collect())), how


def test_per_key_equals_group_by(spark):
    df = data(spark).withColumn("m", F.create_map(F.lit("a"), F.col("x")))
    got = {r.key: (r.n, r.s) for r in skew.per_key(df, "key", [F.count("*").alias("n"), F.sum("x").alias("s")], [F.sum("n").alias("n"), F.sum("s").alias("s")]).collect()}
    want = {r.key: (r.n, r.s) for r in df.groupBy("key").agg(F.count("*").alias("n"), F.sum("x").alias("s")).collect()}
    assert got == want


def test_empty_and_clashing_names(spark):
    df = spark.createDataFrame([], "key string, __slot int, slot int, __slots int")
    assert skew.per_key(df, "key", [F.count("*").alias("n")], [F.sum("n").alias("n")]).count() == 0
    some = spark.createDataFrame([("a", 1, 2, 3)] * 50, df.schema)
    assert skew.per_key(some, "key", [F.count("*").alias("n")], [F.sum("n").alias("n")]).collect()[0].n == 50
    assert skew.fragment_replicate_join(some, some.limit(1), "key").count() == 50


def test_equal_rows_of_a_heavy_key_use_all_its_slots(spark):
    rows = data(spark).select("key").repartition(3).sortWithinPartitions("key")
    plan = skew.plan_loads(rows, "key", tasks=16)
    f = skew.fragment(rows.where("key is not null"), "key", plan, "slot")
    for key, _, slots in plan.heavy:
        assert {r.slot for r in f.where(F.col("key") == key).select("slot").distinct().collect()} == set(slots)
    loads = [r.n for r in f.groupBy(F.pmod(F.hash("slot", "key"), F.lit(16)).alias("t")).agg(F.count("*").alias("n")).collect()]
    assert max(loads) < 1.5 * sum(loads) / 16


def test_shuffled_join_is_even_without_broadcast_and_under_adaptive_execution(spark):
    df = data(spark).where("key is not null")
    right = df.select("key").distinct().withColumn("label", F.upper("key"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.minPartitionSize", "1b")
    try:
        plan = skew.plan_loads(df, "key")
        joined = skew.fragment_replicate_join(df, right, "key", "inner", plan, ["x"])
        loads = [r.n for r in joined.groupBy(F.spark_partition_id().alias("t")).agg(F.count("*").alias("n")).collect()]
        assert "SortMergeJoin" in joined._jdf.queryExecution().executedPlan().toString()
        assert sum(loads) == 12000 and max(loads) < 1.5 * 12000 / len(loads) and joined.where("label <> upper(key)").isEmpty()
    finally:
        for c in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.coalescePartitions.minPartitionSize"):
            spark.conf.unset(c)
        spark.conf.set("spark.sql.shuffle.partitions", "4")
