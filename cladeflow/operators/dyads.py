"""Pairs sampled at about the same time that are near enough for direct links, and the clusters they form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladeflow.operators.graphs import components

#: fixed values: upper 95 % point of the normal distribution, days of a year
Z95, YEAR = 1.6448536269514722, 365.25


def within_envelope(d: Column, days: Column, rate: float, length: int, window: float = 0.5, most_days: float = YEAR) -> Column:
    """Whether a distance is not more than a clock explains: over the time between two samples and `window` years
    before either, as many substitutions are expected as rate * length tells, and up to the upper bound of their
    Poisson spread are allowed."""
    expected = F.lit(length * rate) * (days / YEAR + 2 * window)
    return (days <= most_days) & (d >= 0) & (d <= (expected + Z95 * F.sqrt(expected) + 0.5) / length)


def within_box(d: Column, days: Column, most: float = 0.010, most_days: float = YEAR) -> Column:
    return (days <= most_days) & (d >= 0) & (d <= most)


def dyads(pairs: DataFrame, dates: DataFrame, distance: str, admissible) -> DataFrame:
    """cluster (its least taxon), kind, size, taxa, earliest, latest, timespan_days, mean_, min_ and max_distance.

    pairs: i, j, distance; dates: taxon, date. admissible(distance, days) says which pairs count; a null or NaN distance
    or date never does. The taxa of a cluster are listed in order; clusters are as large as the links make them."""
    a, b = dates.select(F.col("taxon").alias("i"), F.col("date").alias("di")), dates.select(F.col("taxon").alias("j"), F.col("date").alias("dj"))
    near = pairs.where(~F.isnan(distance)).join(a, "i").join(b, "j")
    near = near.where(admissible(F.col(distance), F.abs(F.col("di") - F.col("dj")) * YEAR)).select("i", "j", F.col(distance).alias("d"))
    label = components(near)
    links = near.join(label, near["i"] == label["node"]).groupBy("component").agg(F.avg("d").alias("mean_distance"), F.min("d").alias("min_distance"), F.max("d").alias("max_distance"))
    members = label.join(dates, label["node"] == dates["taxon"]).groupBy("component").agg(F.count("*").alias("size"), F.array_join(F.transform(F.array_sort(F.collect_list("node")), lambda x: x.cast("string")), ";").alias("taxa"), F.min("date").alias("earliest"), F.max("date").alias("latest"))
    kind = F.when(F.col("size") == 2, "Dyad (Pair)").otherwise(F.concat(F.lit("Point-Source Cluster (N="), F.col("size"), F.lit(")")))
    return members.join(links, "component").select(F.col("component").alias("cluster"), kind.alias("kind"), "size", "taxa", "earliest", "latest", ((F.col("latest") - F.col("earliest")) * YEAR).alias("timespan_days"), "mean_distance", "min_distance", "max_distance")
