"""Tables as files that other tools read, and tables of predictions that are checked as they are read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_json(df: DataFrame, path: str) -> None:
    """One JSON document a row, nulls kept, dates as ISO text; files in `path`, written by the executors."""
    df.write.option("ignoreNullFields", "false").mode("errorifexists").json(path)


def write_csv(df: DataFrame, path: str, decimals: int | None = None) -> None:
    """CSV with a header; doubles with a fixed number of decimals, if given; null as empty."""
    shown = [F.when(F.col(c).isNotNull(), F.format_string(f"%.{decimals}f", c)).alias(c) if decimals is not None and t == "double" else F.col(c) for c, t in df.dtypes]
    df.select(*shown).write.mode("errorifexists").csv(path, header=True)


#: fixed values: the columns of the three tables of a transmission report
REPORT = {
    "edges": ("id1", "id2", "distance", "delta_t", "bayes_factor", "q_value"),
    "nodes": ("taxon_id", "date", "degree", "cluster", "community_id", "operational_tier"),
    "communities": ("community_id", "size", "n_eff", "rate", "origin", "state", "operational_tier"),
}


def write_transmission(path: str, **tables: DataFrame) -> None:
    """edges, nodes and communities as CSV under `path`, the columns of REPORT in its order, six decimals; absent columns are empty."""
    for name, df in tables.items():
        cols = [F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in REPORT[name]]
        write_csv(df.select(*cols), f"{path}/{name}", 6)


PREDICTION = "site int, lrt double, p_value double, is_invariable boolean"


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """site, lrt, p_value, is_invariable of a prediction CSV (columns by name, others ignored).

    A missing column, a site that is no positive whole number or comes twice, a negative or non-finite statistic, a p-value
    outside 0 to 1, another truth value than true, false, 1, 0 and a file without sites raise an error when they are read."""
    raw = spark.read.csv(path, header=True)
    at = {c.strip().lstrip("﻿").lower(): c for c in raw.columns}
    missing = sorted({"site", "lrt", "p_value", "is_invariable"} - at.keys())
    if missing:
        raise ValueError(f"{path}: missing columns: {', '.join(missing)}")
    text = lambda c: F.trim(F.col(f"`{at[c]}`"))
    site = F.when(text("site").rlike("^[0-9]+$"), text("site").try_cast("int"))
    lrt, p = text("lrt").try_cast("double"), text("p_value").try_cast("double")
    flag = F.lower(text("is_invariable"))
    checks = [
        (site >= 1, "site is no positive whole number"),
        (lrt.isNotNull() & ~F.isnan(lrt) & (lrt >= 0) & (lrt < float("inf")), "lrt is negative or not finite"),
        (p.between(0, 1), "p_value is outside 0 to 1"),
        (flag.isin("true", "false", "1", "0"), "is_invariable is no truth value"),
    ]
    bad = F.concat_ws("; ", *(F.when(F.coalesce(ok, F.lit(False)), None).otherwise(F.lit(why)) for ok, why in checks))
    rows = raw.select(site.alias("site"), lrt.alias("lrt"), p.alias("p_value"), flag.isin("true", "1").alias("is_invariable"), bad.alias("bad"))
    once = rows.groupBy("site").agg(F.count("*").alias("n"), *(F.first(c).alias(c) for c in ("lrt", "p_value", "is_invariable")), F.max("bad").alias("bad"))
    wrong = F.when(F.col("bad") != "", F.col("bad")).when(F.col("n") > 1, "duplicate site")
    stop = F.raise_error(F.concat(F.lit(f"{path}: site "), F.coalesce(F.col("site").cast("string"), F.lit("?")), F.lit(": "), wrong))
    return once.select(F.when(wrong.isNotNull(), stop.cast("int")).otherwise(F.col("site")).alias("site"), "lrt", "p_value", "is_invariable")


def pair_gene_files(spark: SparkSession, left: str, right: str, left_suffix: str = ".csv", right_suffix: str = ".MEME.json", allow_unmatched: bool = False) -> DataFrame:
    """gene, left, right: the files of two folders with one gene's name before their suffix; one side is null where the other has no partner.

    Without allow_unmatched a gene on one side only is an error, as is a pairing without any gene or a name that is only a
    suffix. Only names are listed; files are read by whoever uses the paths."""

    def listed(path: str, suffix: str, side: str) -> DataFrame:
        files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(path).select("path")
        name = F.element_at(F.split("path", "/"), -1)
        return files.select(F.regexp_replace(name, rf"\Q{suffix}\E$", "").alias("gene"), F.col("path").alias(side))

    both = listed(left, left_suffix, "left").join(listed(right, right_suffix, "right"), "gene", "full")
    n = both.agg(F.count_if(F.col("left").isNull() | F.col("right").isNull()).alias("single"), F.count_if(F.col("left").isNotNull() & F.col("right").isNotNull()).alias("paired"), F.count_if(F.col("gene") == "").alias("nameless")).first()
    if n["nameless"]:
        raise ValueError("a file has no gene before its suffix")
    if n["single"] and not allow_unmatched:
        raise ValueError(f"{n['single']} genes have a file on one side only")
    if not n["paired"]:
        raise ValueError("no gene has a file on both sides")
    return both.select("gene", "left", "right")
