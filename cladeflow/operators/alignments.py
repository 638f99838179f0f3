"""Per-site operators over aligned sequences in long form (taxon, site, state)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def long_form(seqs: DataFrame, taxon: str, seq: str, *keep: str) -> DataFrame:
    """One row per letter: taxon, kept columns, site (from 0), state."""
    return seqs.where(F.length(seq) > 0).select(F.col(taxon).alias("taxon"), *keep, F.posexplode(F.split(seq, "")).alias("site", "state"))


def padded(seqs: DataFrame, seq: str, fill: str = "-") -> DataFrame:
    """Sequences brought to the longest one's length by padding on the right."""
    longest = seqs.agg(F.max(F.length(seq)).alias("__n"))
    # one row
    return seqs.join(F.broadcast(longest)).withColumn(seq, F.rpad(F.coalesce(seq, F.lit("")), F.col("__n"), fill)).drop("__n")


def strict_length(seqs: DataFrame, seq: str) -> DataFrame:
    """The sequences, or an error when the plan runs if their lengths differ."""
    n = seqs.agg(F.min(F.length(seq)).alias("__a"), F.max(F.length(seq)).alias("__b"))
    checked = F.when(F.col("__a") == F.col("__b"), F.col(seq)).otherwise(F.raise_error(F.lit("sequences differ in length")))
    return seqs.join(F.broadcast(n)).withColumn(seq, checked).drop("__a", "__b")


def consensus(sites: DataFrame, valid: Column, tie: str = "smallest", weight: Column | None = None) -> DataFrame:
    """Most frequent valid state per site: site, state, n. Ties go to the smallest state
    or, with tie = "first", to the one of the first taxon; weight sums instead of counting."""
    w = weight if weight is not None else F.lit(1)
    counts = sites.where(valid).groupBy("site", "state").agg(F.sum(w).alias("n"), F.min("taxon").alias("first"))
    by = F.struct((-F.col("n")).alias("a"), F.col("first" if tie == "first" else "state").alias("b"), F.col("state").alias("c"))
    return counts.groupBy("site").agg(F.min(by).alias("m")).select("site", F.col("m.c").alias("state"), (-F.col("m.a")).alias("n"))


def allele_frequencies(sites: DataFrame, floor: float = 1e-4) -> DataFrame:
    """Frequencies of A, C, G, T per site, at least `floor`, and the consensus (A < C < G < T)."""
    n = {b: F.sum(F.when(F.col("state") == b, 1).otherwise(0)) for b in "ACGT"}
    c = sites.groupBy("site").agg(*(n[b].alias(f"n{b}") for b in "ACGT"))
    total = F.col("nA") + F.col("nC") + F.col("nG") + F.col("nT")
    most = F.greatest(*(F.col(f"n{b}") for b in "ACGT"))
    top = F.when(F.col("nA") == most, "A").when(F.col("nC") == most, "C").when(F.col("nG") == most, "G").otherwise("T")
    return c.select("site", *(F.greatest(F.coalesce(F.try_divide(f"n{b}", total), F.lit(0.0)), F.lit(floor)).alias(f"f{b}") for b in "ACGT"), top.alias("consensus"), total.alias("n"))


def column_distance(sites: DataFrame) -> DataFrame:
    """Per taxon the mean share of the others that differ from it at its valid sites."""
    v = sites.where(F.col("state").isin(*"ACGT"))
    per_state = v.groupBy("site", "state").agg(F.count("*").alias("same"))
    per_site = per_state.groupBy("site").agg(F.sum("same").alias("n"))
    r = v.join(per_state, ["site", "state"]).join(per_site, "site")
    return r.groupBy("taxon").agg(F.avg(F.try_divide(F.col("n") - F.col("same"), F.col("n") - 1)).alias("distance"))


def informative_sites(sites: DataFrame) -> DataFrame:
    """Sites with two or more states that each occur at least twice."""
    c = sites.where(F.col("state").isin(*"ACGT")).groupBy("site", "state").agg(F.count("*").alias("n"))
    return c.where("n >= 2").groupBy("site").agg(F.count("*").alias("states")).where("states >= 2")


def variable_sites(sites: DataFrame) -> DataFrame:
    return sites.where(F.col("state").isin(*"ACGT")).groupBy("site").agg(F.countDistinct("state").alias("states")).where("states >= 2")


def coverage_envelope(sites: DataFrame, least: int = 3) -> DataFrame:
    """First and last site with at least min(least, taxa) valid states."""
    n = sites.agg(F.countDistinct("taxon").alias("taxa"))
    c = sites.where(F.col("state").isin(*"ACGT")).groupBy("site").agg(F.count("*").alias("n"))
    return c.join(F.broadcast(n)).where(F.col("n") >= F.least(F.lit(least), F.col("taxa"))).agg(F.min("site").alias("first"), F.max("site").alias("last"))


def collapse_identical(seqs: DataFrame, order: str, name: str, seq: str) -> DataFrame:
    """One row per distinct sequence: the first record and how many there are. Names of
    duplicates stay in the table, they are not gathered."""
    return seqs.groupBy(seq).agg(F.min(order).alias("first"), F.min_by(name, order).alias("representative"), F.count("*").alias("copies"))


def mismatch_runs(sites: DataFrame, cons: DataFrame, least: int) -> DataFrame:
    """Runs of consecutive sites where a taxon differs from the consensus."""
    from cladeflow.operators.statistics import gaps_and_islands

    c = cons.select("site", F.col("state").alias("c"))
    m = sites.join(c, "site").withColumn("bad", F.col("state").isin(*"ACGT") & (F.col("state") != F.col("c")))
    return gaps_and_islands(m.select("taxon", "site", "bad"), ["taxon"], "site", "bad").where(F.col("length") >= least)


def masked(seqs: DataFrame, taxon: str, seq: str, runs: DataFrame, fill: str = "N") -> DataFrame:
    """Sequences with the sites of the runs replaced by `fill`."""
    r = runs.groupBy("taxon").agg(F.collect_list(F.struct("first", "length")).alias("r"))
    d = seqs.join(r, seqs[taxon] == r["taxon"], "left").drop(r["taxon"])
    fixed = F.aggregate(F.coalesce("r", F.array().cast("array<struct<first:int,length:bigint>>")), F.col(seq), lambda s, x: F.overlay(s, F.repeat(F.lit(fill), x["length"].cast("int")), x["first"] + 1, x["length"].cast("int")))
    return d.withColumn(seq, fixed).drop("r")


def merge_intervals(df: DataFrame, group: list[str], start: str, end: str) -> DataFrame:
    """Overlapping or touching intervals of a group merged."""
    w = Window.partitionBy(*group).orderBy(start, end)
    d = df.withColumn("__e", F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    d = d.withColumn("__new", F.when(F.col("__e").isNull() | (F.col(start) > F.col("__e") + 1), 1).otherwise(0)).withColumn("__i", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.groupBy(*group, "__i").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("parts")).drop("__i")
