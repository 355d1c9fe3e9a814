"""Distribution summaries and ranked curves (the tables behind each figure).

Box statistics and kernel densities are grouped summaries; neither collects
a group's values anywhere: quartiles are read off counts inside sketched
brackets, and the density is accumulated as per-partition partial sums on a fixed grid.
"""

from __future__ import annotations

import bisect
import math

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from polyrisk.functions import round_half_even
from polyrisk.operators.scan import ranked, running_min
from polyrisk.session import materialise

WHISKER = 1.5
KDE_GRID = 200
KDE_CUT = 3.0


HISTOGRAM_BINS = 1024
#: Values fetched by ``order_statistics``, all ranks together.
ORDER_FETCH_BUDGET = 1_000_000
#: Relative precision of the sketch that brackets a quantile: a bracket has about 4 / SKETCH of a group's values.
SKETCH = 10_000


def exact_quantiles(values: DataFrame, value_col: str, group_col: str, probs, sketch: int = SKETCH) -> DataFrame:
    """Exact quantiles (linear interpolation between order statistics) per group: (group, prob, value).

    Two passes over the values.  The first makes a mergeable sketch a group,
    whose rank error is known, and so a bracket of values around each quantile
    (a group of up to ten times ``sketch`` values is its own bracket).  The
    second counts each distinct value inside the brackets, and the others
    between them; running sums of these counts name the values at the wanted
    ranks.  No group is gathered in one task and any number of groups will do.

    Null and NaN are not values; an infinite value is an error.
    """
    base = _numbers(values, value_col, group_col).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return materialise(_bracketed_quantiles(base, probs, sketch).withColumnRenamed("_g", group_col), "quantiles")
    finally:
        base.unpersist()


def _numbers(values: DataFrame, value_col: str, group_col: str) -> DataFrame:
    base = values.select(F.col(group_col).alias("_g"), F.col(value_col).cast("double").alias("_v"))
    return base.where(F.col("_v").isNotNull() & ~F.isnan("_v"))


def _bracketed_quantiles(base: DataFrame, probs, sketch: int) -> DataFrame:
    probs = sorted({float(p) for p in probs})
    edges = [[min(1.0, max(0.0, p + side * 2 / sketch)) for p in probs] for side in (-1, 1)]
    low, high = (F.percentile_approx("_v", F.array(*map(F.lit, e)), sketch) for e in edges)
    groups = base.groupBy("_g").agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"), low.alias("_lo"), high.alias("_hi"))
    groups = materialise(groups, "brackets")
    if groups.where("_min = double('-infinity') OR _max = double('infinity')").limit(1).count():
        raise ValueError("quantiles need finite values")

    def end(i: int, side: str, limit: str, edge: float):
        whole = F.lit(edge in (0.0, 1.0)) | (F.col("_n") <= 10 * sketch)
        return F.when(whole, F.col(limit)).otherwise(F.col(side)[i])

    ends = [(end(i, "_lo", "_min", edges[0][i]), end(i, "_hi", "_max", edges[1][i])) for i in range(len(probs))]
    inside, after = F.lit(False), F.lit(0)
    for lo, hi in ends:
        inside, after = inside | F.col("_v").between(lo, hi), after + (F.col("_v") < lo).cast("int")
    joined = base.join(groups.withColumnRenamed("_g", "_bg"), F.col("_g").eqNullSafe(F.col("_bg")))
    # The brackets that begin after a value order the counts; values outside of brackets follow those inside.
    counts = joined.groupBy("_g", "_n", after.alias("_after"), F.when(inside, F.col("_v")).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy("_g").orderBy(F.desc("_after"), F.asc_nulls_last("_v")))
    counts = counts.withColumn("_upto", upto)

    def at(rank):
        return F.max(F.when((rank >= F.col("_upto") - F.col("_c")) & (rank < F.col("_upto")), F.col("_v")))

    found = []
    for p in probs:
        place = F.lit(p) * (F.col("_n") - 1)
        found.append(F.struct(F.lit(p).alias("prob"), F.max(place).alias("place"), at(F.floor(place)).alias("v0"), at(F.ceil(place)).alias("v1")))
    rows = counts.groupBy("_g").agg(F.array(*found).alias("_q")).select("_g", F.inline("_q"))
    value = F.col("v0") + (F.col("v1") - F.col("v0")) * (F.col("place") - F.floor("place"))
    return rows.select("_g", "prob", F.coalesce(value, F.raise_error(F.lit("a rank outside of its bracket")).cast("double")).alias("value"))


def group_bounds(base) -> list:
    """(_g, n, lo, hi) of each group; for callers that made the groups themselves."""
    return base.groupBy("_g").agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi")).collect()


def order_statistics(spark, base, g_type, groups, ranks: dict, bins: int = HISTOGRAM_BINS,
                     exact_limit: int | None = None) -> dict:
    """Exact order statistics of ``base`` (columns ``_g``, ``_v`` double).

    ``groups``: rows (_g, n, lo, hi); ``ranks``: group -> 0-based ranks.
    Returns (group, rank) -> (value, number of values strictly below it),
    for a few ranks of a few groups: the state is on the driver.  Each rank's
    interval starts as [lo, hi] of its group; a round histograms the values in
    the open intervals and narrows each to the bin that holds its rank, until
    its values can be fetched or are all equal.
    """
    if exact_limit is None:
        n_targets = max(1, sum(len(set(r)) for r in ranks.values()))
        exact_limit = max(1, ORDER_FETCH_BUDGET // n_targets)

    # state per (group, rank): [lo, hi, below, count]; targets share intervals
    state: dict = {}
    for row in groups:
        for r in ranks.get(row._g, ()):
            state.setdefault((row._g, r), [row.lo, row.hi, 0, row.n])

    interval_schema = T.StructType(
        [T.StructField("_g", g_type), T.StructField("_lo", T.DoubleType()), T.StructField("_hi", T.DoubleType())]
    )

    def in_interval(keys):
        ints = spark.createDataFrame(sorted({(g, lo, hi) for (g, lo, hi) in keys}, key=repr), interval_schema)
        joined = base.join(F.broadcast(ints), "_g")  # one row per group and open interval: bounded
        return joined.where((F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi")))

    while True:
        open_ = {k: st for k, st in state.items() if st[3] > exact_limit and st[0] < st[1]}
        if not open_:
            break
        width = F.col("_hi") - F.col("_lo")
        b = F.least(F.floor((F.col("_v") - F.col("_lo")) / width * bins).cast("int"), F.lit(bins - 1))
        hist = (
            in_interval((g, st[0], st[1]) for (g, _), st in open_.items())
            .groupBy("_g", "_lo", "_hi", b.alias("_b"))
            .agg(F.count(F.lit(1)).alias("c"), F.min("_v").alias("mn"), F.max("_v").alias("mx"))
            .collect()
        )
        by_interval: dict = {}
        for h in hist:
            by_interval.setdefault((h._g, h._lo, h._hi), []).append(h)
        for (g, r), st in open_.items():
            below = st[2]
            for h in sorted(by_interval[(g, st[0], st[1])], key=lambda x: x._b):
                if below + h.c > r:
                    state[(g, r)] = [h.mn, h.mx, below, h.c]
                    break
                below += h.c

    fetch = {(g, st[0], st[1]) for (g, _), st in state.items() if st[0] < st[1]}
    pools: dict = {}
    if fetch:
        for row in in_interval(fetch).select("_g", "_lo", "_hi", "_v").collect():
            pools.setdefault((row._g, row._lo, row._hi), []).append(row._v)
        for key in pools:
            pools[key].sort()

    out = {}
    for (g, r), (lo, hi, below, _) in state.items():
        if lo == hi:
            out[(g, r)] = (lo, below)
        else:
            pool = pools[(g, lo, hi)]
            value = pool[r - below]
            out[(g, r)] = (value, below + bisect.bisect_left(pool, value))
    return out


def box_stats(values: DataFrame, value_col: str, group_col: str, whis: float = WHISKER) -> DataFrame:
    """Quartiles (linear interpolation), 1.5 IQR whiskers and outlier count: E19.

    Quartiles are those of ``exact_quantiles`` (no group gathered in one task);
    whiskers are the most extreme values inside the fences and outliers the
    values beyond them, one aggregation over the values joined with the
    per-group quartile row.  Null and NaN are not values.
    """
    base = _numbers(values, value_col, group_col).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        q = _bracketed_quantiles(base, (0.25, 0.5, 0.75), SKETCH).withColumnRenamed("_g", "_qg")
        quart = q.groupBy("_qg").agg(
            *[F.max(F.when(F.col("prob") == p, F.col("value"))).alias(name) for p, name in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))]
        )
        fenced = base.join(quart, F.col("_g").eqNullSafe(F.col("_qg"))).withColumn("_iqr", F.col("q3") - F.col("q1"))
        lo_fence = F.col("q1") - F.col("_iqr") * whis
        hi_fence = F.col("q3") + F.col("_iqr") * whis
        v = F.col("_v")
        box = fenced.groupBy(F.col("_g").alias(group_col), "q1", "median", "q3").agg(
            F.count(v).alias("n"),
            F.min(F.when(v >= lo_fence, v)).alias("whisker_lo"),
            F.max(F.when(v <= hi_fence, v)).alias("whisker_hi"),
            F.count_if((v < lo_fence) | (v > hi_fence)).alias("n_outliers"),
        )
        return materialise(box, "box")
    finally:
        base.unpersist()


def _kde_partials(grid_size: int):
    def fn(batches):
        for pdf in batches:
            if pdf.empty:
                continue
            for group, part in pdf.groupby("_g", sort=False):
                lo = part["_lo"].iloc[0]
                hi = part["_hi"].iloc[0]
                bw = part["_bw"].iloc[0]
                grid = np.linspace(lo, hi, grid_size)
                x = part["_x"].to_numpy(dtype=np.float64)
                # (grid points x rows) in chunks bounded to ~8 MB.
                total = np.zeros(grid_size)
                step = max(1, 1_000_000 // grid_size)
                for start in range(0, len(x), step):
                    z = (grid[:, None] - x[None, start : start + step]) / bw
                    total += np.exp(-0.5 * z * z).sum(axis=1)
                yield pd.DataFrame({"_g": group, "grid_index": np.arange(grid_size), "_s": total})

    return fn


def kernel_density(
    values: DataFrame,
    value_col: str,
    group_col: str,
    grid_size: int = KDE_GRID,
    cut: float = KDE_CUT,
    decimals: int | None = None,
) -> DataFrame:
    """Gaussian kernel density on an evenly spaced grid per group: E18.

    Scott's rule: bandwidth = sample stddev * n^(-1/5); the grid spans
    [min - cut*bw, max + cut*bw] with ``grid_size`` points, the usual default
    of density plots.  Zero-variance groups (e.g. fraction 1, where every
    error is 0) have no density and get no rows.

    Each task sums kernel values of its rows at every grid point (Arrow
    batches, numpy), partial sums are added by a group-by, so work and memory
    are bounded per task whatever the group size.
    """
    group_type = values.schema[group_col].dataType.simpleString()
    stats = (
        values.groupBy(group_col)
        .agg(
            F.count(value_col).alias("_n"),
            F.stddev_samp(value_col).alias("_sd"),
            F.min(value_col).alias("_min"),
            F.max(value_col).alias("_max"),
        )
        .withColumn("_bw", F.col("_sd") * F.pow(F.col("_n"), F.lit(-0.2)))
        .where(F.col("_bw") > 0)
        .withColumn("_lo", F.col("_min") - F.col("_bw") * cut)
        .withColumn("_hi", F.col("_max") + F.col("_bw") * cut)
    )
    rows = values.select(F.col(group_col).alias("_g"), F.col(value_col).cast("double").alias("_x")).join(
        stats.select(F.col(group_col).alias("_g"), "_lo", "_hi", "_bw"), "_g"
    )
    partial = rows.mapInPandas(
        _kde_partials(grid_size), schema=f"_g {group_type}, grid_index int, _s double"
    )
    summed = partial.groupBy("_g", "grid_index").agg(F.sum("_s").alias("_s"))
    joined = summed.join(stats.select(F.col(group_col).alias("_g"), "_n", "_bw", "_lo", "_hi"), "_g")
    step = (F.col("_hi") - F.col("_lo")) / (grid_size - 1)
    x = F.when(F.col("grid_index") == grid_size - 1, F.col("_hi")).otherwise(
        F.col("_lo") + F.col("grid_index") * step
    )
    density = F.col("_s") / (F.col("_n") * F.col("_bw") * F.lit(math.sqrt(2.0 * math.pi)))
    if decimals is not None:
        x, density = round_half_even(x, decimals), round_half_even(density, decimals)
    return joined.select(
        F.col("_g").alias(group_col), "grid_index", x.alias("x"), density.alias("density")
    )


def rank_codes(code_stats: DataFrame, order_cols: list) -> DataFrame:
    """0-based rank of each code under ``order_cols`` (ties by code): F1."""
    return ranked(code_stats, [*order_cols, F.asc("code")])


def ranked_probability_curve(code_stats: DataFrame) -> DataFrame:
    """P(pos | code) with and without the code, codes by P(neg | code) ascending: L2."""
    curve = rank_codes(code_stats, [F.asc_nulls_last("p_neg_drug")])
    return curve.select("rank", "code", "p_pos_nodrug", "p_pos_drug")


def ranked_count_curve(code_stats: DataFrame) -> DataFrame:
    """Exposed counts by class in the same order: L3."""
    curve = rank_codes(code_stats, [F.asc_nulls_last("p_neg_drug")])
    return curve.select("rank", "code", "count_outcome_0", "count_outcome_1")


def running_best(trials: DataFrame) -> DataFrame:
    """Objective per trial and the best so far, in trial order: L7."""
    return running_min(trials.select("trial_id", "value"), [F.asc("trial_id")], "value", "best_value")


def calibration_table(scores: DataFrame, count_cap: int = 20) -> DataFrame:
    """True vs predicted risk with the colour scale value: L8 + E20."""
    return scores.select(
        "combo",
        "n",
        "risk_true",
        "risk_predicted",
        F.log(F.least(F.col("n"), F.lit(count_cap)).cast("double")).alias("log_count"),
    )
