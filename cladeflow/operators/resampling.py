"""Replicates and subsets that come out the same on every run: drawn by a digest of replicate and key, never by a
generator's state, so that they do not depend on partitions, retries or the order of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cladeflow.operators.prefix_sums import running_sums


def draw_key(*parts: Column | str) -> Column:
    """31 hexadecimal-digest bits of the parts, as a number."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *(F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts))), 1, 8), 16, 10).cast("long")


def _replicates(df: DataFrame, times: int) -> DataFrame:
    return df.select("*", F.explode(F.sequence(F.lit(1), F.lit(times))).alias("rep"))


def shuffled(df: DataFrame, key: str, value: str, times: int) -> DataFrame:
    """rep, key, value: the values of the table dealt out again, once per replicate. The row at place k by key gets the value of the row
    at place k by the replicate's digests. No replicate is gathered in a task."""
    at = running_sums(df.select(key, value), [], [key], {"at": F.lit(1)}).select(key, value, F.col("at_run").alias("at"))
    reps = _replicates(at.select(F.col(value).alias("v"), F.col(key).alias("k")), times)
    dealt = running_sums(reps.withColumn("d", draw_key("rep", "k")), ["rep"], ["d", "k"], {"at": F.lit(1)})
    return dealt.select("rep", F.col("at_run").alias("at"), "v").join(at.select(key, "at"), "at").select("rep", key, F.col("v").alias(value))


def subsets(df: DataFrame, key: str, size: int, times: int) -> DataFrame:
    """rep, key: `size` different keys per replicate, those with the least digests. A window's rank limit keeps the least of
    every partition before rows move."""
    x = _replicates(df.select(key), times).withColumn("d", draw_key("rep", key))
    return x.withColumn("r", F.row_number().over(Window.partitionBy("rep").orderBy("d", key))).where(F.col("r") <= size).select("rep", key)


def bootstrap_counts(df: DataFrame, key: str, times: int) -> DataFrame:
    """rep, key, copies: how often each row is drawn in a resample with replacement of as many rows; undrawn rows are left out."""
    at = running_sums(df.select(key), [], [key], {"at": F.lit(1)}).select(key, F.col("at_run").alias("at"), F.col("at_all").alias("n"))
    draws = _replicates(at, times).select("rep", (draw_key("rep", "at") % F.col("n") + 1).alias("drawn"))
    counts = draws.groupBy("rep", "drawn").agg(F.count("*").alias("copies"))
    return counts.join(at.select(key, "at"), F.col("drawn") == F.col("at")).select("rep", key, "copies")


def stratified(df: DataFrame, stratum: str, key: str, size: int) -> DataFrame:
    """The rows of a sample of about `size`: every stratum gives its share of the table, at least one row, those with the least
    digests. Null strata are one of their own."""
    counts = df.groupBy(F.col(stratum).alias("__s")).agg(F.count("*").alias("__n"))
    whole = counts.agg(F.sum("__n").alias("__all"))
    quota = counts.join(F.broadcast(whole)).select("__s", F.greatest(F.lit(1), F.round(F.lit(float(size)) * F.col("__n") / F.col("__all"))).alias("__q"))
    x = df.withColumn("__d", draw_key(key)).withColumn("__r", F.row_number().over(Window.partitionBy(stratum).orderBy("__d", key))).where(F.col("__r") <= size)
    return x.join(quota, F.col(stratum).eqNullSafe(F.col("__s"))).where(F.col("__r") <= F.col("__q")).select(*df.columns)


def strided(df: DataFrame, order: str, most: int) -> DataFrame:
    """Every k-th row along `order`, k the least that leaves at most `most` rows."""
    x = running_sums(df, [], [order], {"__at": F.lit(1)})
    return x.where((F.col("__at_run") - 1) % F.ceil(F.col("__at_all") / most) == 0).select(*df.columns)
