"""Exposure tables derived from the star-schema parquet tables.

Mapping (FIXTURES.md §3):

    subject_id  <- o_custkey
    episode_id  <- o_orderkey
    code        <- p_brand (25 values) or p_type (6 values)
    outcome     <- 1 when o_orderstatus = 'F' else 0 (null for a null status)

``exposure_rows`` is the literal three-way join, ``exposures`` its distinct
rows.  ``episodes`` builds the same episodes as
``operators.episodes.build_episodes(exposures(...))`` with fewer and smaller
shuffles (see the function docstring).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CODE_COLUMNS = {"brand": "p_brand", "type": "p_type"}

# The outcome is a 0/1 integer, as the reference's diagnosis column.
POSITIVE_STATUS = "F"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def code_column(code: str) -> str:
    try:
        return CODE_COLUMNS[code]
    except KeyError:
        raise ValueError(f"code must be one of {sorted(CODE_COLUMNS)}, got {code!r}") from None


def _outcome(status_col: str = "o_orderstatus"):
    return (F.col(status_col) == POSITIVE_STATUS).cast("int")


def exposure_rows(spark: SparkSession, sf_dir: str, code: str = "brand") -> DataFrame:
    """Raw long table, one row per line item (duplicates included): A1 + C1."""
    line = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    part = read_table(spark, sf_dir, "part").select("p_partkey", F.col(code_column(code)).alias("code"))
    joined = line.join(part, line.l_partkey == part.p_partkey).join(
        orders, line.l_orderkey == orders.o_orderkey
    )
    return joined.select(
        F.col("o_custkey").alias("subject_id"),
        F.col("o_orderkey").alias("episode_id"),
        F.col("code"),
        _outcome().alias("outcome"),
    )


def raw_row_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row, ``n_rows_raw``: the number of rows of ``exposure_rows``.

    Counted without materialising the join: sum over line items of (part
    rows with that key) x (order rows with that key).  Line items cross the
    order-key shuffle only as partial sums, so this costs what the episode
    build costs, not a raw three-way join.
    """
    line = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    # Grouped by code too, so that the join gets an exchange of its own, which AQE can split.
    part_rows = read_table(spark, sf_dir, "part").groupBy("p_partkey", "p_brand").agg(F.count(F.lit(1)).alias("p_rows"))
    per_order = (
        line.join(part_rows, line.l_partkey == part_rows.p_partkey)
        .groupBy("l_orderkey")
        .agg(F.sum("p_rows").alias("lines"))
    )
    order_rows = read_table(spark, sf_dir, "orders").groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("o_rows"))
    joined = order_rows.join(per_order, order_rows.o_orderkey == per_order.l_orderkey)
    total = F.sum(F.col("lines") * F.col("o_rows")).cast("bigint")
    return joined.agg(F.coalesce(total, F.lit(0).cast("bigint")).alias("n_rows_raw"))


def exposures(spark: SparkSession, sf_dir: str, code: str = "brand") -> DataFrame:
    """Distinct (subject_id, episode_id, code, outcome): E1.

    Equal to ``exposure_rows(...).distinct()``, but derived from the per-order
    code sets of ``episodes`` (same shuffles: the line items move twice, as
    partial sets the second time) instead of a distinct over the raw join,
    which would shuffle line-item-sized data a third time.  A NULL code,
    subject or outcome is kept, as a distinct over the raw rows keeps it;
    rows with a null key go when episodes are built.
    """
    ep = _episode_rows(spark, sf_dir, code)
    codes = F.when(F.col("has_null"), F.concat(F.col("codes"), F.array(F.lit(None).cast("string")))).otherwise(
        F.col("codes")
    )
    return ep.select("subject_id", "episode_id", F.explode(codes).alias("code"), "outcome")


def distinct_row_count(spark: SparkSession, sf_dir: str, code: str = "brand") -> DataFrame:
    """One row, ``n_exposures``: the number of rows of ``exposures``, before the key filter."""
    rows = F.size("codes") + F.col("has_null").cast("int")
    total = _episode_rows(spark, sf_dir, code).agg(F.sum(rows).alias("n"))
    return total.select(F.coalesce("n", F.lit(0)).cast("bigint").alias("n_exposures"))


def episodes(spark: SparkSession, sf_dir: str, code: str = "brand") -> DataFrame:
    """One row per (subject_id, episode_id, outcome) with its sorted code set.

    Plan shape, chosen for a lineitem table far larger than the others:

    1. ``part`` is reduced to distinct (key, code) rows: copies of a part
       collapse map-side.  The join then has an exchange of its own on each
       side, so AQE splits the partition of a hot part key (or broadcasts the
       part side when its measured size is small).
    2. Line items are grouped per order *before* meeting ``orders``: the
       partial ``collect_set`` runs map-side, so a hot order (even a third of
       all line items) reaches the shuffle as one small set per map task.
    3. ``orders`` is grouped by order key into its distinct (subject,
       outcome) variants (copies collapse map-side).  Both sides of the
       order join are then partitioned on the order key: no further shuffle.
       Conflicting variants of one order become separate episodes, as the
       reference's grouping by (subject, episode, outcome) makes them.

    Null keys are dropped (the reference's group-by drops them); a null code
    leaves an episode with an empty combination.
    """
    ep = _episode_rows(spark, sf_dir, code).where(F.col("subject_id").isNotNull() & F.col("outcome").isNotNull())
    combo = F.sort_array(F.col("codes"))
    return ep.select("subject_id", "episode_id", "outcome", combo.alias("combo"), F.size(combo).alias("n_codes"))


def _episode_rows(spark: SparkSession, sf_dir: str, code: str) -> DataFrame:
    """(subject_id, episode_id, outcome, codes, has_null) per episode, built
    as described in ``episodes``; a null subject or outcome is still there."""
    line = (
        read_table(spark, sf_dir, "lineitem")
        .select("l_orderkey", "l_partkey")
        .where(F.col("l_orderkey").isNotNull())
    )
    part = (
        read_table(spark, sf_dir, "part")
        .select("p_partkey", F.col(code_column(code)).alias("code"))
        .distinct()
    )
    # a part whose code is NULL still exposes its line items (empty code set)
    coded = line.join(part, line.l_partkey == part.p_partkey).select("l_orderkey", "code")
    per_order = coded.groupBy("l_orderkey").agg(
        F.collect_set("code").alias("codes"), F.max(F.col("code").isNull()).alias("has_null")
    )
    variants = (
        read_table(spark, sf_dir, "orders")
        .where(F.col("o_orderkey").isNotNull())
        .groupBy("o_orderkey")
        .agg(F.collect_set(F.struct(F.col("o_custkey").alias("subject_id"), _outcome().alias("outcome"))).alias("v"))
    )
    joined = variants.join(per_order, variants.o_orderkey == per_order.l_orderkey)
    return joined.select(
        F.col("o_orderkey").alias("episode_id"), F.explode("v").alias("_v"), "codes", "has_null"
    ).select(
        F.col("_v.subject_id").alias("subject_id"),
        "episode_id",
        F.col("_v.outcome").alias("outcome"),
        "codes",
        "has_null",
    )


_MATERIALISED: dict = {}


def materialised_episodes(spark: SparkSession, sf_dir: str, code: str = "brand") -> DataFrame:
    """Episodes written once per session to the shared checkpoint folder and
    read back by every later query.

    The reference builds its multi-hot table once and every later step reads
    that file; this is the same data flow.  A written table also cuts the
    lineage: a lost executor re-reads Parquet instead of re-running the
    build.  Keyed by session, input folder and code mapping (the inputs are
    read-only).
    """
    from polyrisk.session import ensure_checkpoint_dir

    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"), code)
    path = _MATERIALISED.get(key)
    if path is None:
        folder = ensure_checkpoint_dir(spark)
        path = f"{folder.rstrip('/')}/episodes-{code}-{uuid.uuid4().hex}"
        episodes(spark, sf_dir, code).write.parquet(path)
        _MATERIALISED[key] = path
    return spark.read.parquet(path)
