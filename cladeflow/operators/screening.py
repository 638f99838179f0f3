"""Screening of records against a calibrated clock: the same rules for tables and streams."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cladeflow.operators.resampling import draw_key
from cladeflow.operators.statistics import linear_percentiles


@dataclass(frozen=True)
class ClockModel:
    """A calibrated clock: divergence = d0 + rate (t - t_ref), residual spread sigma."""

    rate: float
    d0: float
    t_ref: float
    sigma: float
    origin: float
    span: float
    median_distance: float
    most_missing: float = 0.05
    tolerance_days: float = 60.0
    z_limit: float = 2.0

    @classmethod
    def interactive(cls, **kw) -> ClockModel:
        return cls(tolerance_days=90.0, z_limit=2.5, **kw)


def predicted_date(d: Column, m: ClockModel) -> Column:
    """Null for a clock that does not tick: a rate of 1e-7 or less, also a falling one, predicts nothing."""
    return m.t_ref + (d - m.d0) / m.rate if m.rate > 1e-7 else F.lit(None).cast("double")


def divergence_z(d: Column, t: Column, m: ClockModel) -> Column:
    return (d - (m.d0 + m.rate * (t - m.t_ref))) / max(m.sigma, 1e-12)


# the thresholds in status are fixed values


def status(m: ClockModel, t: Column, missing: Column, n_missing: Column, d: Column, nn: Column, nn_date: Column, left_d: Column, right_d: Column, halves_differ: Column, halves_gap: Column, length: Column) -> Column:
    """The first rule that applies. Order matters: excess divergence comes before chimeras, and a
    date is doubted only where nothing else is wrong."""
    z = divergence_z(d, t, m)
    # without a prediction no date is off
    err_days = F.coalesce((predicted_date(d, m) - t) * 365.25, F.lit(0.0))
    med = m.median_distance
    contaminant = nn > F.greatest(F.lit(0.08), F.lit(3.5 * med))
    archival = (d <= 0.0002) & (t >= m.origin + 0.6 * m.span) & (z <= -2.5)
    excess = (z > 2.5) & ((nn > 1.25 * med) | (F.abs(nn_date - t) <= 1.5))
    chimera = (length >= 1000) & halves_differ & (left_d >= 0.0015) & (right_d >= 0.0015) & (halves_gap >= 0.25 * m.span)
    off = (((F.abs(err_days) > m.tolerance_days) & (F.abs(z) >= m.z_limit)) | (F.abs(err_days) > max(365.25, 0.75 * m.span * 365.25))) & (nn <= 2.5 * max(med, 0.001))
    return (
        F.when(t.isNull(), "FLAG_MISSING_DATE")
        .when(missing > m.most_missing, "SUS_LOW_QUALITY")
        .when(contaminant, "SUS_CONTAMINANT")
        .when(archival, "SUS_ARCHIVAL")
        .when(excess & ((n_missing > 10) | (missing > 0.02)), "SUS_LOW_QUALITY")
        .when(excess, "SUS_HYPERMUTATED")
        .when(chimera, "SUS_CHIMERIC")
        .when(off, "SUS_DATE_MISMATCH")
        .otherwise("PASS")
    )


def draw_anchors(records: DataFrame, taxon: str, t: str, most: int = 1024, bins: int = 32) -> DataFrame:
    """The dated records that calibrate a clock: an equal number from each of `bins` spans of time, in the order of
    their digests, at most `most` in all."""
    x = records.where(F.col(t).isNotNull())
    ends = x.agg(F.min(t).alias("lo"), F.max(t).alias("hi"))
    span = F.col("hi") - F.col("lo")
    x = x.join(F.broadcast(ends)).withColumn("__bin", F.when(span > 0, F.least(F.floor((F.col(t) - F.col("lo")) / span * bins), F.lit(bins - 1))).otherwise(0))
    # the limit on the rank cuts every partition to its own least keys before rows move
    w = Window.partitionBy("__bin").orderBy(draw_key(taxon), taxon)
    return x.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= max(1, most // bins)).select(*records.columns)


def calibrate(anchors: DataFrame, t: str, d: str, **kw) -> ClockModel:
    """A clock from dated anchors by least squares: one aggregate row comes to the driver."""
    r = anchors.where(F.col(t).isNotNull() & F.col(d).isNotNull()).agg(F.regr_slope(d, t).alias("b"), F.avg(t).alias("t"), F.avg(d).alias("d"), F.regr_syy(d, t).alias("yy"), F.regr_sxy(d, t).alias("xy"), F.count("*").alias("n"), F.min(t).alias("lo"), F.max(t).alias("hi")).first()
    if r["b"] is None:
        raise ValueError("the anchors' dates do not differ")
    sigma = (max(r["yy"] - r["b"] * r["xy"], 0.0) / max(r["n"], 1)) ** 0.5
    median = linear_percentiles(anchors.where(F.col(t).isNotNull()), [], d, {"med": 0.5}).first()["med"]
    origin = min(r["t"] - r["d"] / r["b"], r["lo"]) if r["b"] > 1e-12 else r["lo"]
    return ClockModel(r["b"], r["d"], r["t"], sigma, origin, r["hi"] - r["lo"], median, **kw)
