"""Matching of names in stages, merging of re-runs, and choices by fixed rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def match_taxa(tree: DataFrame, name: str, records: DataFrame, key: str) -> DataFrame:
    """taxon, key, stage: tree tips and record names that are equal; if none is, equal without quotes; if none is, equal in lower
    case too. The first stage with a match decides for all, so that a loose match never mixes with exact ones.
    Null names match nothing; of several records with one loose name the greatest key counts."""
    bare = lambda c: F.btrim(F.col(c), F.lit("'\""))
    stages = [("exact", bare(name), F.col(key)), ("unquoted", bare(name), bare(key)), ("any case", F.lower(bare(name)), F.lower(bare(key)))]
    found = []
    for n, (stage, a, b) in enumerate(stages):
        held = records.where(F.col(key).isNotNull()).groupBy(b.alias("__k")).agg(F.max(key).alias("key"))
        x = tree.where(F.col(name).isNotNull()).select(F.col(name).alias("taxon"), a.alias("__t")).distinct()
        found.append(x.join(held, F.col("__t") == F.col("__k")).select("taxon", "key", F.lit(stage).alias("stage"), F.lit(n).alias("__n")))
    every = reduce(DataFrame.unionByName, found)
    first = every.agg(F.min("__n").alias("__first"))
    return every.join(F.broadcast(first)).where(F.col("__n") == F.col("__first")).select("taxon", "key", "stage")


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The old rows with those of `new` put in place of the ones with their keys, and added where there are none. Keys are compared null-safe."""
    on = reduce(lambda p, q: p & q, (F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys))
    kept = old.alias("o").join(new.select(*keys).distinct().alias("n"), on, "left_anti")
    return kept.unionByName(new.select(*old.columns))


#: fixed values: generation intervals of pathogens, mean and standard deviation
PRESETS = (
    ("influenza_h1n1", 2.8, 1.3, "days"),
    ("h1n1", 2.8, 1.3, "days"),
    ("ebola", 14.5, 6.7, "days"),
    ("ebov", 14.5, 6.7, "days"),
    ("sars_cov_2", 5.2, 2.8, "days"),
    ("covid", 5.2, 2.8, "days"),
    ("measles", 11.7, 3.0, "days"),
    ("hiv_early", 2.5, 1.2, "years"),
)


def presets(spark: SparkSession) -> DataFrame:
    """preset, mean, sd, unit, mean_years, sd_years."""
    years = lambda c: F.when(F.col("unit") == "days", F.col(c) / 365.25).otherwise(F.col(c))
    return spark.createDataFrame(list(PRESETS), "preset string, mean double, sd double, unit string").withColumn("mean_years", years("mean")).withColumn("sd_years", years("sd"))


def chosen_clock(asked: str, ols_ok: Column, gls_ok: Column, spline_ok: Column, power_ok: Column, ols_bounded: Column, gls_bounded: Column, attenuated: Column, nonlinear: Column) -> Column:
    """Which clock counts: `ols`, `gls`, `spline` or `power`, for what is asked (auto, linear, spline, power).

    Asked for by name, the spline or the power law counts if it could be fitted. A line by ancestry (gls) counts if its rate is positive and
    not deflated by clade structure, unless only the plain line has a bounded origin. Auto takes the spline first where it
    is clearly better. With neither line usable the one by ancestry stays."""
    auto = (
        F.when(spline_ok & nonlinear, "spline")
        .when(gls_ok & ~gls_bounded & ols_bounded, "ols")
        .when(gls_ok & attenuated, "ols")
        .when(gls_ok & gls_bounded, "gls")
        .when(ols_ok & ols_bounded, "ols")
        .when(gls_ok, "gls")
        .when(ols_ok, "ols")
        .otherwise("gls")
    )
    linear = F.when(gls_ok & ~attenuated & (gls_bounded | ~ols_bounded), "gls").when(ols_ok, "ols").otherwise("gls")
    if asked == "linear":
        return linear
    return {"spline": F.when(spline_ok, "spline").otherwise(auto), "power": F.when(power_ok, "power").otherwise(auto)}.get(asked, auto)
