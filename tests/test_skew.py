"""Hot keys: results stay exact when one key holds a third of all rows."""

import pandas as pd
from pyspark.sql import functions as F

from polyrisk.operators import contingency as C
from polyrisk.operators import patterns as PT
from polyrisk.sources import tables


def _write_tables(spark, root, n_orders=3000):
    """Star tables where order 1 has a third of all line items (repeated
    parts), orders has copies of order 1, and combination {B0} covers a third
    of all orders."""
    parts = spark.createDataFrame([(p, f"B{p % 5}", "T") for p in range(50)], "p_partkey long, p_brand string, p_type string")
    orders = spark.range(n_orders).select(
        F.col("id").alias("o_orderkey"),
        (F.col("id") % 97).alias("o_custkey"),
        F.when(F.col("id") % 3 == 0, "F").otherwise("O").alias("o_orderstatus"),
    )
    copies = spark.range(500).select(F.lit(1).cast("long").alias("o_orderkey"), F.lit(1).cast("long").alias("o_custkey"), F.lit("O").alias("o_orderstatus"))
    normal = spark.range(n_orders * 2).select(
        (F.col("id") % n_orders).alias("l_orderkey"),
        F.when((F.col("id") % n_orders) < n_orders // 3, F.lit(0)).otherwise(F.col("id") % 50).cast("long").alias("l_partkey"),
    )
    hot = spark.range(n_orders).select(F.lit(1).cast("long").alias("l_orderkey"), (F.col("id") % 50).alias("l_partkey"))
    parts.write.parquet(f"{root}/part.parquet")
    orders.unionByName(copies).write.parquet(f"{root}/orders.parquet")
    normal.unionByName(hot).write.parquet(f"{root}/lineitem.parquet")


def test_hot_keys_exact(spark, tmp_path):
    root = str(tmp_path)
    _write_tables(spark, root)
    eps = tables.episodes(spark, root, "brand")
    # pandas reference of the same definition (distinct join rows, grouped)
    li = pd.read_parquet(f"{root}/lineitem.parquet")
    od = pd.read_parquet(f"{root}/orders.parquet")
    pt = pd.read_parquet(f"{root}/part.parquet")
    ex = li.merge(pt, left_on="l_partkey", right_on="p_partkey").merge(od, left_on="l_orderkey", right_on="o_orderkey")
    ex = ex.assign(outcome=(ex.o_orderstatus == "F").astype(int))[["o_custkey", "o_orderkey", "p_brand", "outcome"]].drop_duplicates()
    want = ex.groupby(["o_custkey", "o_orderkey", "outcome"])["p_brand"].apply(lambda s: tuple(sorted(s))).value_counts().to_dict()
    got = {tuple(r.combo): r.n for r in PT.combo_patterns(eps).collect()}
    assert got == want
    assert max(got.values()) >= len(ex.o_orderkey.unique()) // 3  # the hot combination is there
    stats = {r.code: r.count_outcome_0 + r.count_outcome_1 for r in C.code_contingency(eps).collect()}
    assert stats == ex.groupby("p_brand").size().to_dict()


def test_raw_row_count_with_copies(spark, tmp_path):
    root = str(tmp_path)
    _write_tables(spark, root, n_orders=600)
    assert tables.raw_row_count(spark, root).first().n_rows_raw == tables.exposure_rows(spark, root, "brand").count()


def test_hot_part_key_is_split(spark, tmp_path):
    """Two thirds of the line items on one part, no broadcasts: the part join is a split skew join."""
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k",
        "spark.sql.shuffle.partitions": "16",
        "spark.sql.files.maxPartitionBytes": "64k",
        "spark.sql.files.openCostInBytes": "4k",
    }
    root = str(tmp_path)
    spark.range(300).selectExpr("id AS p_partkey", "concat('B', id % 5) AS p_brand", "'T' AS p_type").write.parquet(f"{root}/part.parquet")
    spark.range(20000).selectExpr("id AS o_orderkey", "id % 97 AS o_custkey", "'F' AS o_orderstatus").write.parquet(f"{root}/orders.parquet")
    lines = spark.range(120000).selectExpr("id % 20000 AS l_orderkey", "IF(id % 3 < 2, 7, id % 300) AS l_partkey")
    lines.repartition(8).write.parquet(f"{root}/lineitem.parquet")
    want = {(r.o_orderkey, r.c) for r in lines.join(spark.read.parquet(f"{root}/part.parquet"), F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_join(F.sort_array(F.collect_set("p_brand")), "|").alias("c")).collect()}
    old = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        for df in (tables.episodes(spark, root, "brand"), tables.raw_row_count(spark, root)):
            rows = df.collect()
            assert "SortMergeJoin(skew=true)" in df._jdf.queryExecution().executedPlan().toString()
            if "combo" in df.columns:
                assert {(r.episode_id, "|".join(r.combo)) for r in rows} == want
            else:
                assert rows[0].n_rows_raw == 120000
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
