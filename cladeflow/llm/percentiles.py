"""Problem 2: percentiles per group of very large numeric columns."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeflow.operators.prefix_sums import running_sums


def value_counts(df: DataFrame, group: str, value: str, rel_error: float = 0.0) -> DataFrame:
    """The mergeable summary: grp, val, n - how often each value occurs in each group.

    With rel_error = 0 values are kept as they are and percentiles are exact. With
    rel_error = a > 0 a value is replaced by the middle of its cell on a logarithmic
    grid, off by at most a times its size, which bounds the summary's size per group
    whatever the number of rows. Rows with null group and null or NaN values are left
    out; infinities are values; -0.0 counts as 0.0.
    """
    v = F.col(value).cast("double") + F.lit(0.0)
    if rel_error:
        gamma = (1 + rel_error) / (1 - rel_error)
        cell = F.round(F.log(F.abs(v)) / F.lit(math.log(gamma)) + F.lit(0.5))
        grid = F.signum(v) * F.pow(F.lit(gamma), cell) * F.lit(2 / (gamma + 1))
        v = F.when((v == 0) | (F.abs(v) == float("inf")), v).otherwise(grid)
    rows = df.select(F.col(group).alias("grp"), v.alias("val")).where("grp is not null and val is not null and not isnan(val)")
    return rows.groupBy("grp", "val").agg(F.count("*").alias("n"))


def merge_counts(counts: DataFrame) -> DataFrame:
    """Summaries of separate partitions or days as one: counts of equal values add up."""
    return counts.groupBy("grp", "val").agg(F.sum("n").alias("n"))


def percentiles(counts: DataFrame, qs: list[float], parts: int | None = None) -> DataFrame:
    """grp, q, n, lower_value, value for each group and each q of qs.

    lower_value is the first value whose cumulative frequency reaches ceil(q n);
    value interpolates linearly at (n - 1) q. Group-value counts are range-sorted,
    summed inside range partitions and shifted by the totals of the partitions before
    (running_sums), so no group is gathered anywhere; a row is picked if a target rank
    falls into its stretch of ranks, which needs no further sort.
    """
    cum = running_sums(counts, ["grp"], ["val"], {"n": F.col("n")}, parts)
    ranks = []
    for k, q in enumerate(qs):
        at = (F.col("n_all") - 1) * F.lit(float(q))
        ranks += [
            (k, "d", F.greatest(F.lit(1), F.ceil(F.lit(float(q)) * F.col("n_all") - 1e-9)).cast("long")),
            (k, "l", F.floor(at).cast("long") + 1),
            (k, "h", F.ceil(at).cast("long") + 1),
        ]
    inside = lambda r: (r > F.col("n_run") - F.col("n")) & (r <= F.col("n_run"))
    wanted = F.lit(False)
    for _, _, r in ranks:
        wanted = wanted | inside(r)
    hits = F.explode(F.filter(F.array(*(F.when(inside(r), F.struct(F.lit(k).alias("k"), F.lit(role).alias("role"))) for k, role, r in ranks)), lambda x: x.isNotNull()))
    picked = cum.where(wanted).select("grp", F.col("n_all").alias("n"), "val", hits.alias("hit"))
    role = lambda x: F.max(F.when(F.col("hit.role") == x, F.col("val")))
    q = F.element_at(F.array(*(F.lit(float(q)) for q in qs)), F.col("hit.k") + 1)
    out = picked.groupBy("grp", q.alias("q"), "n").agg(role("d").alias("d"), role("l").alias("l"), role("h").alias("h"))
    at = (F.col("n") - 1) * F.col("q")
    frac = at - F.floor(at)
    # equal neighbours stay as they are, so that infinities do not become NaN
    value = F.when(F.col("l") == F.col("h"), F.col("l")).otherwise(F.col("l") + (F.col("h") - F.col("l")) * frac)
    return out.select("grp", "q", "n", F.col("d").alias("lower_value"), value.alias("value"))
