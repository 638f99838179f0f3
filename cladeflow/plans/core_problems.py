"""Queries of the general operators: orphaned references (p4) and timestamps (p6)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeflow.operators.orphans import ForeignKey, loose_name, orphan_cascade
from cladeflow.operators.timestamps import known_times, normalise_times
from cladeflow.session import spread, stored, table


def _orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata rows without a record in order when they were loaded, and the pair links that hang on
    them. A record's metadata is in meta or in h5n1_ha_metadata, so a link is in order if
    either holds a row of its id. Repeated rows count each."""
    tables = {
        "fasta_record": table(spark, sf_dir, "fasta_record").select("row_ord", "name", "loaded_at", "withdrawn_at"),
        "meta": table(spark, sf_dir, "meta").select("meta_row", "id", "loaded_at"),
        "h5n1_ha_metadata": table(spark, sf_dir, "h5n1_ha_metadata").select("h5_row", "taxon", "loaded_at"),
        # the numbers of the rows are fixed by the stored table
        "supported_edges": stored(table(spark, sf_dir, "supported_edges").select(F.monotonically_increasing_id().alias("edge_row"), "id1", "id2", "loaded_at")),
    }
    either = (("h5n1_ha_metadata", "taxon"),)
    fks = [ForeignKey("meta", "id", "fasta_record", "name"), ForeignKey("h5n1_ha_metadata", "taxon", "fasta_record", "name"), ForeignKey("supported_edges", "id1", "meta", "id", either), ForeignKey("supported_edges", "id2", "meta", "id", either)]
    times = {"fasta_record": ("loaded_at", "withdrawn_at"), **dict.fromkeys(("meta", "h5n1_ha_metadata", "supported_edges"), ("loaded_at", None))}
    return orphan_cascade(tables, {"fasta_record": "row_ord", "meta": "meta_row", "h5n1_ha_metadata": "h5_row", "supported_edges": "edge_row"}, fks, compare=loose_name, times=times)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The direct orphans of the cascade in the two metadata tables."""
    direct = _orphans(spark, sf_dir).where("kind = 'direct' and tab in ('meta', 'h5n1_ha_metadata')")
    return direct.select("tab", "load_month", F.col("row_id").cast("long").alias("row_id"), "reason")


def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4_found(spark, sf_dir).groupBy("tab", "load_month", "reason").agg(F.count("*").alias("cases"))


def p4_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Direct and inherited orphans by table and month."""
    return _orphans(spark, sf_dir).groupBy("tab", "load_month", "fk", "kind", "depth", "reason").agg(F.count("*").alias("orphans"))


def _written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All written dates. The source of a row, whose clock its local times share, is what the
    tables tell of it: the kind of input, the style of the id, the place of sampling."""
    one = lambda name, row, value, source, header: table(spark, sf_dir, name).select(F.lit(name).alias("tab"), F.col(row).alias("row_id"), F.col(value).alias("value"), "zone_name", "loaded_at", source.alias("source"), header.alias("is_header"))
    parts = [
        one("date_oracle", "oracle_row", "input", F.col("kind"), F.col("kind") == "header"),
        one("meta", "meta_row", "date", F.regexp_extract(F.trim("id"), "^[A-Za-z]+", 0), F.lit(False)),
        one("h5n1_ha_metadata", "h5_row", "date", F.col("location"), F.lit(False)),
    ]
    return spread(reduce(DataFrame.unionByName, parts))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values that are determined: a moment, or a local time with a zone's history. What an
    estimated history gives is by definition undetermined, so none is estimated here; see p6_estimated."""
    rows = _written(spark, sf_dir).drop("source", "loaded_at")
    return known_times(rows, "value", "zone_name", F.col("is_header")).where("utc_us is not null").select("tab", "row_id", "utc_us")


def p6_estimated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All values, with the estimated UTC time of those that lack a zone."""
    times = normalise_times(_written(spark, sf_dir), "value", "loaded_at", ["tab", "source"], "zone_name", F.col("is_header"), order="row_id")
    return times.select("tab", "row_id", "how", "utc_us", "local_us", "est_utc_us", "est_margin")


QUERIES = {"p4_found": p4_found, "p4_report": p4_report, "p4_cascade": p4_cascade, "p6_found": p6_found, "p6_estimated": p6_estimated}

_NAME = "nullif(lower(replace(replace(trim({}, ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12) || chr(160)), '/', '_'), ' ', '_')), '')"
_FK = "case tab when 'meta' then 'meta.id->fasta_record' else 'h5n1_ha_metadata.taxon->fasta_record' end"
_DIRECT = f"""
f as (select {_NAME.format('name')} k, loaded_at, withdrawn_at from fasta_record),
r as (select 'meta' tab, meta_row row_id, {_NAME.format('id')} k, loaded_at t from meta
      union all select 'h5n1_ha_metadata', h5_row, {_NAME.format('taxon')}, loaded_at from h5n1_ha_metadata),
j as (select r.tab, r.row_id, r.k, r.t, count(f.k) n, coalesce(bool_or(f.loaded_at <= r.t and (f.withdrawn_at is null or f.withdrawn_at > r.t)), false) ok,
             coalesce(bool_or(f.loaded_at > r.t), false) late
      from r left join f on r.k = f.k where r.k is not null group by all),
d as (select tab, strftime(t, '%Y-%m') load_month, row_id, case when n = 0 then 'missing' when late then 'late' else 'withdrawn' end reason from j where not ok)"""
_P4 = f"with {_DIRECT} select * from d"
# an edge's reference is direct if no metadata row of its id had arrived, inherited if all that had are orphans
_CASCADE = f"""
with {_DIRECT},
p as (select r.k, r.t, d.row_id is null as alive from r left join d on r.tab = d.tab and r.row_id = d.row_id where r.k is not null),
n as (select row_number() over () edge_row, * from supported_edges),
e as (select edge_row, 'id1' c, {_NAME.format('id1')} k, loaded_at t from n union all select edge_row, 'id2', {_NAME.format('id2')}, loaded_at from n),
h as (select e.edge_row, e.c, e.t, count(p.k) n, coalesce(bool_or(p.t <= e.t), false) any_ok, coalesce(bool_or(p.alive and p.t <= e.t), false) alive_ok,
             coalesce(bool_or(not p.alive), false) hurt
      from e left join p on e.k = p.k where e.k is not null group by all),
x as (select tab, load_month, {_FK} fk, 'direct' kind, 0 depth, reason from d
      union all
      select 'supported_edges', strftime(t, '%Y-%m'), 'supported_edges.' || c || '->meta|h5n1_ha_metadata', case when any_ok then 'inherited' else 'direct' end,
             case when any_ok then 1 else 0 end, case when any_ok then null when n = 0 then 'missing' else 'late' end
      from h where not alive_ok and (not any_ok or hurt))
select tab, load_month, fk, kind, depth, reason, count(*) orphans from x group by all"""

ORACLE = {
    "p4_found": _P4,
    "p4_report": f"select tab, load_month, reason, count(*) cases from ({_P4}) group by all",
    "p4_cascade": _CASCADE,
}
