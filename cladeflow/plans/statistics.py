"""Queries of the statistical operators, on events and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cladeflow.functions.times import micros, month
from cladeflow.operators import statistics as st
from cladeflow.session import table

def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.lit(1.0) / (F.lit(1.0) + F.abs("value"))
    return table(spark, sf_dir, "events").withColumn("p", p).withColumn("day", (micros("ts") - F.lit(1704067200000000)) / F.lit(86400e6))


def r6(*names: str):
    return [F.round(n, 6).alias(n) for n in names]


def bh_qvalues(s, d):
    return st.bh_qvalues(_events(s, d).select("event_id", "p"), "p", "event_id").select("event_id", *r6("q_value"))


def bayes_fdr(s, d):
    return st.bayes_fdr(_events(s, d).select("event_id", "p"), "p", ["event_id"]).select("event_id", *r6("q_value"))


def bayes_fdr_rerank(s, d):
    return st.bayes_fdr(_events(s, d).select("event_id", "p"), "p", ["event_id"], monotone=False).select("event_id", *r6("q_value"))


def cauchy_simes(s, d):
    e = _events(s, d).select("event_id", "event_type", "p")
    return e.groupBy("event_type").agg(st.cauchy_combination("p").alias("cauchy")).join(st.simes(e, "event_type", "p", "event_id"), "event_type").select("event_type", *r6("cauchy", "simes"))


def percentile_linear(s, d):
    names = {f"p{int(q * 100)}": q for q in (0.15, 0.5, 0.75, 0.99)}
    return st.linear_percentiles(_events(s, d), ["event_type"], "value", names).select("event_type", *r6(*names))


def ols_by_group(s, d):
    f = st.ols(_events(s, d), ["event_type"], "day", "value")
    return f.select("event_type", "n", *r6("slope", "intercept", "r2", "se_slope", "s2"))


def clock_origin(s, d):
    """Origin of the rising line of cumulative counts, per type."""
    e = _events(s, d).groupBy("event_type", F.floor("day").cast("double").alias("x")).agg(F.count("*").cast("double").alias("c"))
    w = Window.partitionBy("event_type").orderBy("x")
    e = e.withColumn("y", F.sum("c").over(w))
    return st.ols(e, ["event_type"], "x", "y").select("event_type", *r6("slope", "origin"))


def fieller_open(s, d):
    f = st.fieller_open(st.ols(_events(s, d), ["event_type"], "day", "value"), 1.96)
    big = lambda c: F.when(F.abs(c) == float("inf"), None).otherwise(F.round(c, 4)).alias(c)
    return f.select("event_type", big("low"), big("high"), (F.col("g") >= 1).alias("is_open"))


def fieller_cases(s, d):
    f = st.fieller_cases(st.ols(_events(s, d), ["event_type"], "day", "value"), 1.96)
    return f.select("event_type", "kind", F.round("low", 4).alias("low"), F.round("high", 4).alias("high"))


def studentized_outliers(s, d):
    r = st.with_residuals(_events(s, d).select("event_id", "event_type", "day", "value"), ["event_type"], "day", "value")
    return r.where(F.abs("student") >= 2.5).select("event_id", "event_type", *r6("student", "leverage", "deleted"))


def loo_ols(s, d):
    r = st.with_residuals(_events(s, d).select("event_id", "event_type", "day", "value"), ["event_type"], "day", "value")
    return r.select("event_id", *r6("loo_slope"))


def background_moments(s, d):
    """Mean and variance of integer distances, and the negative binomial of those moments."""
    e = _events(s, d).withColumn("k", F.floor("value")).groupBy("event_type").agg(F.avg("k").alias("m"), F.var_pop("k").alias("v"))
    p, r = st.negative_binomial_fit(F.col("m"), F.col("v"))
    return e.withColumn("p_bg", p).withColumn("r_bg", r).select("event_type", *r6("m", "v", "p_bg", "r_bg"))


def confusion(s, d):
    o = table(s, d, "orders").select("o_orderpriority", (F.lit(1.0) / (1 + F.col("o_totalprice") / 20000)).alias("p"), (F.col("o_orderstatus") == "F").alias("truth"))
    return st.confusion(o, ["o_orderpriority"], "p", "truth", 0.1).select("o_orderpriority", "tp", "fp", "fn", "tn", *r6("ppv", "fpr"))


def roc_auc(s, d):
    o = table(s, d, "orders").select("o_orderpriority", F.floor(F.col("o_totalprice") / 1000).alias("score"), (F.col("o_orderstatus") == "F").alias("truth"))
    return st.roc_auc(o, ["o_orderpriority"], "score", "truth").select("o_orderpriority", *r6("auc"))


def rank_correlation(s, d):
    l = table(s, d, "lineitem").select("l_returnflag", "l_quantity", F.floor(F.col("l_extendedprice") / 100).alias("price"))
    r = st.average_ranks(st.average_ranks(l, ["l_returnflag"], "l_quantity", "rx"), ["l_returnflag"], "price", "ry")
    return r.groupBy("l_returnflag").agg(F.round(F.corr("rx", "ry"), 6).alias("spearman"), F.round(F.corr("l_quantity", "price"), 6).alias("pearson"))


def mad_outliers(s, d):
    z = st.mad_z(_events(s, d).select("event_id", "event_type", "value"), ["event_type"], "value")
    return z.where(F.abs("z") >= 3).select("event_id", *r6("z"))


def size_histogram_fit(s, d):
    """Log-count regression over the sizes 2 to 12 of the users' daily bursts."""
    sizes = _events(s, d).groupBy("user_id", F.to_date("ts").alias("dt")).agg(F.count("*").alias("size"))
    h = sizes.where("size between 2 and 12").groupBy("size").agg(F.count("*").alias("n"))
    return h.agg(F.round(F.regr_slope(F.log("n"), F.col("size")), 6).alias("decay"), F.round(F.regr_r2(F.log("n"), F.col("size")), 6).alias("r2"), F.sum("n").alias("groups"))


def group_report(s, d):
    x = table(s, d, "orthomam_site_selection").where("gene_id is not null and lrt is not null and not isnan(lrt)")
    return x.groupBy("gene_id").agg(F.count("*").alias("rows"), F.countDistinct("site_1idx").alias("sites"), F.sum("is_sig_p05").alias("sig"), F.round(F.avg("lrt"), 6).alias("mean_lrt"))


def audit_right_join(s, d):
    """All genes of the summary with the site counts, zero where there are none."""
    sites = table(s, d, "orthomam_site_selection").groupBy("gene_id").agg(F.count("*").alias("delivered"))
    genes = table(s, d, "orthomam_gene_selection").select("gene_id", "num_codons")
    return sites.join(genes, "gene_id", "right").select("gene_id", "num_codons", F.coalesce("delivered", F.lit(0)).alias("delivered"))


def anomaly_census(s, d):
    return table(s, d, "fasta_record").where("defline is not null").groupBy(F.split("defline", "[ |_]").getItem(0).alias("kind")).agg(F.count("*").alias("n"))


def quantization_audit(s, d):
    """Share of decimal dates that lie on whole or half years, by month of arrival."""
    y = F.expr("try_cast(trim(date) as double)")
    m = table(s, d, "h5n1_ha_metadata").withColumn("y", y).where("y is not null and y >= 1900 and y < 2100 and loaded_at is not null")
    f = F.col("y") - F.floor("y")
    near = (F.abs(F.col("y") - F.round("y")) < 0.005) | (F.abs(f - 0.5) < 0.005)
    return m.groupBy(month("loaded_at").alias("month")).agg(F.count("*").alias("n"), F.round(F.avg(near.cast("double")), 6).alias("share"), (F.avg(near.cast("double")) > 0.8).alias("quantized"))


def lrt_pvalues(s, d):
    x = table(s, d, "orthomam_site_selection").select("gene_id", "site_1idx", "lrt")
    return x.select("gene_id", "site_1idx", F.round(st.lrt_site_p("lrt"), 9).alias("p_site"), F.round(st.lrt_gene_p("lrt"), 9).alias("p_gene"))


def precision_ensemble(s, d):
    """Model rows (a slope per type) combined by their precision."""
    f = st.ols(_events(s, d), ["event_type"], "day", "value")
    w = 1 / (F.col("se_slope") * F.col("se_slope"))
    return f.agg(F.round(F.sum(w * F.col("slope")) / F.sum(w), 6).alias("slope"), F.round(F.sqrt(1 / F.sum(w)), 6).alias("se"), F.count("*").alias("models"))


def quadratic_vs_line(s, d):
    """Residual sums of a line and a parabola from power sums; AICc picks one."""
    e = _events(s, d).select("event_type", (F.col("day") / 30 - 0.5).alias("x"), F.col("value").alias("y"))
    a = e.groupBy("event_type").agg(F.count("*").alias("n"), *(F.sum(F.pow("x", F.lit(k))).alias(f"s{k}") for k in (1, 2, 3, 4)), *(F.sum(F.pow("x", F.lit(k)) * F.col("y")).alias(f"t{k}") for k in (0, 1, 2)), F.sum(F.col("y") * F.col("y")).alias("yy"))
    n, s1, s2, s3, s4, t0, t1, t2 = (F.col(c) for c in ("n", "s1", "s2", "s3", "s4", "t0", "t1", "t2"))
    det = n * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s3 * s2) + s2 * (s1 * s3 - s2 * s2)
    c0 = (t0 * (s2 * s4 - s3 * s3) - s1 * (t1 * s4 - s3 * t2) + s2 * (t1 * s3 - s2 * t2)) / det
    c1 = (n * (t1 * s4 - s3 * t2) - t0 * (s1 * s4 - s3 * s2) + s2 * (s1 * t2 - t1 * s2)) / det
    c2 = (n * (s2 * t2 - t1 * s3) - s1 * (s1 * t2 - t1 * s2) + t0 * (s1 * s3 - s2 * s2)) / det
    rss2 = F.col("yy") - c0 * t0 - c1 * t1 - c2 * t2
    b = (n * t1 - s1 * t0) / (n * s2 - s1 * s1)
    rss1 = F.col("yy") - t0 * t0 / n - b * (t1 - s1 * t0 / n)
    aicc = lambda rss, k: n * F.log(rss / n) + 2 * k + 2 * k * (k + 1) / (n - k - 1)
    return a.select("event_type", F.round(rss1, 3).alias("rss_line"), F.round(rss2, 3).alias("rss_parabola"), F.round(c2, 4).alias("curvature"), (aicc(rss2, 4) < aicc(rss1, 3)).alias("prefers_parabola"))


QUERIES = {f.__name__: f for f in (bh_qvalues, bayes_fdr, bayes_fdr_rerank, cauchy_simes, percentile_linear, ols_by_group, clock_origin, fieller_open, fieller_cases, studentized_outliers, loo_ols, background_moments, confusion, roc_auc, rank_correlation, mad_outliers, size_histogram_fit, group_report, audit_right_join, anomaly_census, quantization_audit, lrt_pvalues, precision_ensemble, quadratic_vs_line)}

_E = "e as (select *, 1.0e0 / (1.0e0 + abs(value)) p, (epoch_us(ts) - 1704067200000000) / 86400e6 as day from events)"
_FIT = f"{_E}, m as (select event_type, count(*) n, avg(day) xm, avg(value) ym, regr_sxx(value, day) sxx, regr_syy(value, day) syy, regr_sxy(value, day) sxy from e group by all), f as (select *, sxy / sxx slope, ym - sxy / sxx * xm icpt, (syy - sxy * sxy / sxx) / (n - 2) s2 from m), g as (select *, sqrt(s2 / sxx) se_slope, sqrt(s2 / n) se_mean from f)"
_CASES = "select *, slope * slope - power(1.96e0 * se_slope, 2) a, -2 * slope * ym b, ym * ym - power(1.96e0 * se_mean, 2) c from g"
_R = f"{_FIT}, r as (select event_id, e.event_type, day - xm dx, value - ym dy, value - icpt - slope * day res, 1e0 / n + (day - xm) * (day - xm) / sxx lev, g.* exclude (event_type) from e join g using (event_type))"

ORACLE = {
    "bh_qvalues": f"with {_E}, r as (select event_id, p, row_number() over (order by p, event_id) k, count(*) over () n from e) select event_id, round(least(1e0, min(p * n / k) over (order by p, event_id rows between current row and unbounded following)), 6) q_value from r",
    "bayes_fdr": f"with {_E}, r as (select event_id, p, avg(p) over (order by p, event_id rows unbounded preceding) m from e) select event_id, round(min(m) over (order by p, event_id rows between current row and unbounded following), 6) q_value from r",
    "bayes_fdr_rerank": f"with {_E} select event_id, round(avg(p) over (order by p, event_id rows unbounded preceding), 6) q_value from e",
    "cauchy_simes": f"with {_E}, r as (select event_type, p, row_number() over (partition by event_type order by p, event_id) k, count(*) over (partition by event_type) n from e) select event_type, round(0.5e0 - atan(avg(tan((0.5e0 - p) * pi()))) / pi(), 6) cauchy, round(least(1e0, min(p * n / k)), 6) simes from r group by event_type",
    "percentile_linear": "select event_type, " + ", ".join(f"round(quantile_cont(value, {q}), 6) p{int(q * 100)}" for q in (0.15, 0.5, 0.75, 0.99)) + " from events group by all",
    "ols_by_group": f"with {_FIT} select event_type, n, round(slope, 6) slope, round(icpt, 6) intercept, round(sxy * sxy / (sxx * syy), 6) r2, round(se_slope, 6) se_slope, round(s2, 6) s2 from g",
    "clock_origin": f"with {_E}, c as (select event_type, floor(day)::double x, count(*)::double c from e group by all), y as (select event_type, x, sum(c) over (partition by event_type order by x) y from c) select event_type, round(regr_slope(y, x), 6) slope, round(avg(x) - avg(y) / regr_slope(y, x), 6) origin from y group by event_type",
    "fieller_open": f"with {_FIT}, h as (select *, power(1.96e0 * se_slope / slope, 2) gg, ym / slope cc from g), i as (select *, cc * cc - (1 - gg) * (ym * ym - power(1.96e0 * se_mean, 2)) / (slope * slope) disc from h) select event_type, case when gg >= 1 or disc < 0 then null else round(xm - (cc + sqrt(greatest(disc, 0e0))) / (1 - gg), 4) end low, case when gg >= 1 or disc < 0 then null else round(xm - (cc - sqrt(greatest(disc, 0e0))) / (1 - gg), 4) end high, gg >= 1 is_open from i",
    "fieller_cases": f"with {_FIT}, h as ({_CASES}), i as (select *, b * b - 4 * a * c disc from h), j as (select *, case when a > 0 then 'BOUNDED' when disc > 0 then 'COMPLEMENT' else 'ALL_REALS' end kind, (-b - sqrt(greatest(disc, 0e0))) / (2 * a) z1, (-b + sqrt(greatest(disc, 0e0))) / (2 * a) z2 from i) select event_type, kind, case when kind <> 'ALL_REALS' then round(xm - greatest(z1, z2), 4) end low, case when kind <> 'ALL_REALS' then round(xm - least(z1, z2), 4) end high from j",
    "studentized_outliers": f"with {_R}, t as (select *, res / sqrt(s2 * (1 - lev)) st, (s2 * (n - 2) - res * res / (1 - lev)) / (n - 3) so from r) select event_id, event_type, round(st, 6) student, round(lev, 6) leverage, round(res / sqrt(so * (1 - lev)), 6) deleted from t where abs(st) >= 2.5",
    "loo_ols": f"with {_R} select event_id, round((sxy - n / (n - 1) * dx * dy) / (sxx - n / (n - 1) * dx * dx), 6) loo_slope from r",
    "background_moments": "with a as (select event_type, avg(floor(value)) m, var_pop(floor(value)) v from events group by all), b as (select *, case when v > m and m > 0 then 1 - m / v else 0.95e0 end p from a) select event_type, round(m, 6) m, round(v, 6) v, round(p, 6) p_bg, round(case when v > m and m > 0 then m * (1 - p) / p else 5e0 end, 6) r_bg from b",
    "confusion": "with o as (select o_orderpriority, 1e0 / (1 + o_totalprice / 20000) <= 0.1e0 c, o_orderstatus = 'F' t from orders), k as (select o_orderpriority, count(*) filter (c and t) tp, count(*) filter (c and not t) fp, count(*) filter (not c and t) fn, count(*) filter (not c and not t) tn from o group by all) select *, round(tp / nullif(tp + fp, 0), 6) ppv, round(fp / nullif(fp + tn, 0), 6) fpr from k",
    "roc_auc": "with o as (select o_orderpriority g, floor(o_totalprice / 1000) s, o_orderstatus = 'F' t from orders), r as (select *, rank() over (partition by g order by s) + (count(*) over (partition by g, s) - 1) / 2e0 r from o) select g o_orderpriority, round((sum(r) filter (t) - count(*) filter (t) * (count(*) filter (t) + 1) / 2e0) / (count(*) filter (t) * count(*) filter (not t)), 6) auc from r group by g",
    "rank_correlation": "with l as (select l_returnflag f, l_quantity a, floor(l_extendedprice / 100) b from lineitem), r as (select *, rank() over (partition by f order by a) + (count(*) over (partition by f, a) - 1) / 2e0 ra, rank() over (partition by f order by b) + (count(*) over (partition by f, b) - 1) / 2e0 rb from l) select f l_returnflag, round(corr(ra, rb), 6) spearman, round(corr(a, b), 6) pearson from r group by f",
    "mad_outliers": "with a as (select event_id, value, event_type, median(value) over (partition by event_type) m from events), b as (select *, median(abs(value - m)) over (partition by event_type) d from a), c as (select event_id, (value - m) / greatest(1.4826e0 * d, 1e-9) z from b) select event_id, round(z, 6) z from c where abs(z) >= 3",
    "size_histogram_fit": "with s as (select user_id, ts::date d, count(*) size from events group by all), h as (select size, count(*) n from s where size between 2 and 12 group by all) select round(regr_slope(ln(n), size), 6) decay, round(regr_r2(ln(n), size), 6) r2, sum(n)::bigint \"groups\" from h",
    "group_report": "select gene_id, count(*) \"rows\", count(distinct site_1idx) sites, sum(is_sig_p05)::bigint sig, round(avg(lrt), 6) mean_lrt from orthomam_site_selection where gene_id is not null and lrt is not null and not isnan(lrt) group by gene_id",
    "audit_right_join": "select g.gene_id, num_codons, coalesce(n, 0) delivered from (select gene_id, count(*) n from orthomam_site_selection group by all) s right join orthomam_gene_selection g using (gene_id)",
    "anomaly_census": "select regexp_split_to_array(defline, '[ |_]')[1] kind, count(*) n from fasta_record where defline is not null group by 1",
    "quantization_audit": "with m as (select try_cast(trim(date) as double) y, loaded_at from h5n1_ha_metadata), k as (select strftime(loaded_at, '%Y-%m') \"month\", (abs(y - round(y)) < 0.005e0 or abs(y - floor(y) - 0.5e0) < 0.005e0)::int::double q from m where y >= 1900 and y < 2100 and loaded_at is not null) select \"month\", count(*) n, round(avg(q), 6) share, avg(q) > 0.8 quantized from k group by all",
    "lrt_pvalues": "with l as (select gene_id, site_1idx, case when lrt > 0 and not isnan(lrt) then lrt end x from orthomam_site_selection), u as (select x, case when x > 80 then 0e0 else 1 - (select sum(exp((0.5e0 + j) * ln(x / 2) - x / 2 - lgamma(1.5e0 + j))) from range(0, 300) g(j)) end t from (select distinct x from l where x is not null)) select gene_id, site_1idx, round(case when l.x is null then 2 / 3e0 else 2 / 3e0 * (0.45e0 * t + 0.55e0 * exp(-l.x / 2)) end, 9) + 0e0 p_site, round(case when l.x is null then 1e0 else 0.5e0 * t end, 9) + 0e0 p_gene from l left join u on l.x = u.x",
    "quadratic_vs_line": "with e as (select event_type, ((epoch_us(ts) - 1704067200000000) / 86400e6) / 30 - 0.5e0 x, value y from events), a as (select event_type, count(*)::double n, sum(x) s1, sum(power(x, 2)) s2, sum(power(x, 3)) s3, sum(power(x, 4)) s4, sum(y) t0, sum(x * y) t1, sum(x * x * y) t2, sum(y * y) yy from e group by 1), b as (select *, n * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s3 * s2) + s2 * (s1 * s3 - s2 * s2) det from a), c as (select *, (t0 * (s2 * s4 - s3 * s3) - s1 * (t1 * s4 - s3 * t2) + s2 * (t1 * s3 - s2 * t2)) / det c0, (n * (t1 * s4 - s3 * t2) - t0 * (s1 * s4 - s3 * s2) + s2 * (s1 * t2 - t1 * s2)) / det c1, (n * (s2 * t2 - t1 * s3) - s1 * (s1 * t2 - t1 * s2) + t0 * (s1 * s3 - s2 * s2)) / det c2, (n * t1 - s1 * t0) / (n * s2 - s1 * s1) b from b), r as (select *, yy - c0 * t0 - c1 * t1 - c2 * t2 r2, yy - t0 * t0 / n - b * (t1 - s1 * t0 / n) r1 from c) select event_type, round(r1, 3) rss_line, round(r2, 3) rss_parabola, round(c2, 4) curvature, n * ln(r2 / n) + 8 + 40 / (n - 5) < n * ln(r1 / n) + 6 + 24 / (n - 4) prefers_parabola from r",
    "precision_ensemble": f"with {_FIT} select round(sum(slope / (se_slope * se_slope)) / sum(1 / (se_slope * se_slope)), 6) slope, round(sqrt(1 / sum(1 / (se_slope * se_slope))), 6) se, count(*) models from g",
}
