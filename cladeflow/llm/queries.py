"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeflow.llm import components, langid, mixing, neardup, packing, percentiles, tokens, topn
from cladeflow.session import spread, stored, table

PERCENTS = [0.05, 0.25, 0.5, 0.75, 0.95, 0.99]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.linked_groups(table(spark, sf_dir, "supported_edges").select("id1", "id2", "bayes_factor"))


def p1_group_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_found(spark, sf_dir).groupBy("group_id").agg(F.count("*").alias("members"))


def _percentiles(counts: DataFrame) -> DataFrame:
    got = percentiles.percentiles(counts, PERCENTS)
    return got.select(F.col("grp").alias("gene_id"), "q", "n", F.round("lower_value", 6).alias("lower_value"), F.round("value", 6).alias("value"), F.lit(0.0).alias("rel_error"))


def p2_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _percentiles(percentiles.value_counts(table(spark, sf_dir, "orthomam_site_selection").select("gene_id", "lrt"), "gene_id", "lrt"))


def p2_days_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries of the single days, stored, then combined."""
    sites = table(spark, sf_dir, "orthomam_site_selection").select(F.to_date("loaded_at").alias("day"), "gene_id", "lrt")
    rows = sites.where("gene_id is not null and lrt is not null and not isnan(lrt)")
    by_day = stored(rows.groupBy("day", F.col("gene_id").alias("grp"), F.col("lrt").alias("val")).agg(F.count("*").alias("n")))
    return _percentiles(percentiles.merge_counts(by_day))


def p2_bounded_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with summaries of bounded size: values are off by at most 1 %."""
    counts = percentiles.value_counts(table(spark, sf_dir, "orthomam_site_selection").select("gene_id", "lrt"), "gene_id", "lrt", rel_error=0.01)
    return percentiles.percentiles(counts, PERCENTS).select(F.col("grp").alias("gene_id"), "q", "n", "lower_value", "value", F.lit(0.01).alias("rel_error"))


def _top_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites = table(spark, sf_dir, "orthomam_site_selection").select("gene_id", "site_1idx", "lrt", "p_value", "loaded_at").where("gene_id is not null")
    last = topn.latest(sites, ["gene_id", "site_1idx"], "loaded_at", ["lrt", "p_value"])
    return topn.top_n(last, "gene_id", "lrt", "p_value", "site_1idx", 10)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _top_sites(spark, sf_dir).select(F.col("grp").cast("int").alias("gene_id"), F.col("item").cast("int").alias("site_1idx"))


def p3_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _top_sites(spark, sf_dir).select(F.col("grp").cast("int").alias("gene_id"), "rank", F.col("item").cast("int").alias("site_1idx"), F.col("score").alias("lrt"), F.col("tie").alias("p_value"))


def _near_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(spread(table(spark, sf_dir, "fasta_record").select("row_ord", "seq")), "row_ord", "seq")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _near_pairs(spark, sf_dir).select("row_a", "row_b")


def p5_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.same_record_classes(spread(table(spark, sf_dir, "fasta_record").select("row_ord", "seq")), "row_ord", "seq")


def _sized_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.with_tokens(spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text")), "text")


def p7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_sized_docs(spark, sf_dir), table(spark, sf_dir, "container_spec"))


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bins per capacity, against the fewest that the sizes allow."""
    bins = p7_packing(spark, sf_dir).groupBy("spec_id", "bin_id").agg(F.sum("tokens").alias("held"), F.count("*").alias("pieces"))
    spec = table(spark, sf_dir, "container_spec")
    out = bins.groupBy("spec_id").agg(F.count("*").alias("bins"), F.sum("held").alias("tokens"), F.max("held").alias("fullest"), F.sum("pieces").alias("pieces")).join(spec, "spec_id")
    return out.select("spec_id", "capacity_tokens", "bins", "pieces", "tokens", "fullest", F.ceil(F.col("tokens") / F.col("capacity_tokens")).alias("fewest"), F.round(F.col("tokens") / (F.col("bins") * F.col("capacity_tokens")), 5).alias("fill"))


FRACTIONS = [0.25, 0.5, 1.0]


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, plans = mixing.plan_mix(_sized_docs(spark, sf_dir), table(spark, sf_dir, "mix_targets"), "doc_id", "source", "tokens", [1.0])
    return mixing.draw(rows, plans[0]).select(F.col("id").alias("doc_id"), "source", F.col("size").alias("tokens"), "copies")


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares reached at nested budgets: fractions of the largest total the targets allow."""
    rows, plans = mixing.plan_mix(_sized_docs(spark, sf_dir), table(spark, sf_dir, "mix_targets"), "doc_id", "source", "tokens", FRACTIONS)
    parts = [mixing.mix_report(mixing.draw(rows, p), p).select(F.lit(f).alias("fraction"), "*") for f, p in zip(FRACTIONS, plans, strict=True)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "study_id"))
    return langid.languages(docs, "doc_id", "text", "lang", "source", "study_id")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.foreign_lines(_languages(spark, sf_dir))


def p9_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _languages(spark, sf_dir).select("doc_id", "declared", "words", "lang", F.round("confidence", 6).alias("confidence"))


def p9_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.segments(_languages(spark, sf_dir))


QUERIES = {
    "p1_found": p1_found,
    "p1_group_sizes": p1_group_sizes,
    "p2_percentiles": p2_percentiles,
    "p2_days_combined": p2_days_combined,
    "p2_bounded_error": p2_bounded_error,
    "p3_found": p3_found,
    "p3_ranked": p3_ranked,
    "p5_found": p5_found,
    "p5_classes": p5_classes,
    "p7_packing": p7_packing,
    "p7_fill": p7_fill,
    "p8_mix": p8_mix,
    "p8_shares": p8_shares,
    "p9_found": p9_found,
    "p9_documents": p9_documents,
    "p9_segments": p9_segments,
}

_P1 = """
with recursive e as (select distinct id1 a, id2 b from supported_edges where id1 is not null and id2 is not null and id1 <> id2 and bayes_factor >= 3 and not isnan(bayes_factor)),
d as (select a, b from e union select b, a from e),
r(s, t) as (select a, a from d union select r.s, d.b from r join d on r.t = d.a)
select s record_id, min(t) group_id from r group by s"""
_Q = ", ".join(map(str, PERCENTS))
_P2 = f"""
with v as (select gene_id, lrt from orthomam_site_selection where gene_id is not null and lrt is not null and not isnan(lrt)),
a as (select gene_id, count(*) n, quantile_disc(lrt, [{_Q}]) d, quantile_cont(lrt, [{_Q}]) c from v group by gene_id)
select gene_id, unnest([{_Q}])::double q, n, round(unnest(d), 6) lower_value, round(unnest(c), 6) "value", 0.0::double rel_error from a"""
_P3 = """
with l as (select *, row_number() over (partition by gene_id, site_1idx order by loaded_at desc nulls last, lrt desc nulls last, p_value desc nulls last) k from orthomam_site_selection where gene_id is not null),
r as (select gene_id, site_1idx, lrt, p_value, row_number() over (partition by gene_id order by lrt desc, p_value asc nulls last, site_1idx) "rank" from l where k = 1 and lrt is not null and not isnan(lrt))
select {} from r where "rank" <= 10"""

ORACLE = {
    "p1_found": _P1,
    "p1_group_sizes": f"select group_id, count(*) members from ({_P1}) group by all",
    "p2_percentiles": _P2,
    "p2_days_combined": _P2,
    "p3_found": _P3.format("gene_id, site_1idx"),
    "p3_ranked": _P3.format('gene_id, "rank"::int "rank", site_1idx, lrt, p_value'),
}
