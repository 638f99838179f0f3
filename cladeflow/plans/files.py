"""Queries that write tables in a file format and read them back with its parser."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladeflow.functions import dates as dt
from cladeflow.plans.alignments import aligned
from cladeflow.session import shared_dir, table
from cladeflow.sources import formats as fm
from cladeflow.sources import tables as tb
from cladeflow.streaming import screen as ss

#: taxa to a file, which a parser holds in one task
PER_FILE = 50


def _folder(s) -> str:
    return f"{shared_dir(s)}/files-{uuid.uuid4().hex}"


def _taxa(s, d) -> DataFrame:
    return aligned(s, d).select(F.concat(F.lit("t"), "taxon").alias("name"), "clade", F.round("date", 4).alias("date"), "seq", F.floor(F.col("taxon") / PER_FILE).alias("file"))


def _documents(s, rows: DataFrame, line: Column, head: Column, sep: str, tail: str) -> str:
    """A folder with one file per `file`: the head, the lines in the order of names, the tail."""
    path = _folder(s)
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", line.alias("line")))), lambda x: x["line"]), sep)
    rows.groupBy("file").agg(F.concat(head, lines, F.lit(tail)).alias("value")).write.partitionBy("file").text(path)
    return path


def fasta_files(s, d):
    """All records, empty ones too, as FASTA."""
    path = _folder(s)
    tb.write_fasta(table(s, d, "fasta_record").select(F.concat(F.lit("r"), "row_ord").alias("name"), "seq"), path, "name", "seq")
    return tb.read_fasta(s, path).select("name", F.length("seq").alias("letters"), F.md5("seq").alias("digest"))


def phylip_files(s, d):
    path = _documents(s, _taxa(s, d), F.concat_ws(" ", "name", "seq"), F.format_string("%d 64\n", F.count("*")), "\n", "\n")
    return fm.read_files(s, path, fm.phylip, "name string, seq string").select("name", "seq")


def nexus_files(s, d):
    path = _documents(s, _taxa(s, d), F.concat_ws(" ", "name", "seq"), F.lit("#NEXUS\nbegin data;\nformat datatype=dna gap=-;\nmatrix\n"), "\n", "\n;\nend;\n")
    return fm.read_files(s, path, fm.nexus, "name string, seq string").select("name", "seq")


def xml_files(s, d):
    """Taxa with dates and sequences as the XML of a sampler."""
    x = _taxa(s, d)
    line = F.format_string('<sequence taxon="%s" value="%s"/>', "name", "seq")
    days = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", "date"))), lambda r: F.concat(r["name"], F.lit("="), r["date"].cast("string"))), ",")
    path = _documents(s, x, line, F.concat(F.lit('<beast version="2"><trait traitname="date" value="'), days, F.lit('"/><data>')), "", "</data></beast>")
    return fm.read_files(s, path, fm.beast_xml, "name string, seq string, date double").select("name", "seq", F.round("date", 4).alias("date"))


def auspice_files(s, d):
    line = F.to_json(F.struct("name", F.struct(F.struct(F.col("date").alias("value")).alias("num_date"), F.struct(F.concat(F.lit("c"), "clade").alias("value")).alias("country")).alias("node_attrs")))
    path = _documents(s, _taxa(s, d), line, F.lit('{"tree":{"name":"root","children":['), ",", "]}}")
    return fm.read_files(s, path, fm.auspice, "name string, num_date double, date string, place string").select("name", F.round("num_date", 4).alias("date"), "place")


def newick_files(s, d):
    """A bush per file, the branches as long as the years since 2000: tips, and the sum of their lengths, as read."""
    line = F.concat(F.col("name"), F.lit(":"), F.round(F.col("date") - 2000, 4).cast("string"))
    path = _documents(s, _taxa(s, d), line, F.lit("("), ",", ");")
    x = fm.read_files(s, path, fm.newick, "node long, parent long, length double, name string")
    return x.where("name is not null").select("name", F.round("length", 4).alias("length"))


def site_test_files(s, d):
    """Gene statistics in the layout of a site-test report, the genes' numbers as its coverage."""
    g = table(s, d, "orthomam_gene_selection").select("gene_id", "max_lrt").where("max_lrt is not null and not isnan(max_lrt)")
    g = g.select(F.lpad(F.col("gene_id").cast("string"), 12, "0").alias("name"), "gene_id", "max_lrt", F.floor(F.col("gene_id") / PER_FILE).alias("file"))
    line = F.concat(F.lit("[0,"), F.col("max_lrt").cast("string"), F.lit(",0.25]"))
    cover = F.array_join(F.transform(F.array_sort(F.collect_list("gene_id")), lambda x: x.cast("string")), ",")
    path = _documents(s, g, line, F.concat(F.lit('{"data partitions":{"0":{"coverage":[['), cover, F.lit(']]}},"MLE":{"headers":[["alpha",""],["LRT",""],["p-value",""]],"content":{"0":[')), ",", "]}}}")
    x = fm.read_files(s, path, fm.site_tests, "site long, lrt double, p double")
    return x.select((F.col("site") - 1).cast("int").alias("gene_id"), F.round("lrt", 6).alias("lrt"), "p")


def metadata_files(s, d):
    """Place and date table through CSV: counts by place."""
    path = f"{_folder(s)}.csv"
    table(s, d, "h5n1_ha_metadata").select("taxon", F.trim("date").alias("collection_date"), "location", F.col("lat").alias("Latitude"), F.col("lon").alias("lng")).write.csv(path, header=True)
    x = tb.read_metadata(s, path)
    return x.groupBy(F.coalesce(F.trim("location"), F.lit("")).alias("place")).agg(F.count("*").alias("n"), F.count("lat").alias("located"), F.round(F.sum("lat"), 3).alias("lat"), F.round(F.sum("lon"), 3).alias("lon"))


def unparsed_dates(s, d):
    """How many metadata dates are blank, read as a decimal year, and left unread."""
    m = table(s, d, "meta").select(F.coalesce(F.trim("date"), F.lit("")).alias("t"), dt.text_start_of_day(F.col("date")).alias("y"))
    kind = F.when(F.col("t") == "", "blank").when(F.col("y").isNotNull(), "read").otherwise("unread")
    return m.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def distance_files(s, d):
    """Edge distances through CSV, those between names of records."""
    e = table(s, d, "supported_edges").where("id1 is not null and id2 is not null")
    path = f"{_folder(s)}.csv"
    e.select(F.col("id1").alias("ID1"), F.col("id2").alias("ID2"), F.col("distance").alias("Distance")).write.csv(path, header=True)
    got, unknown = tb.read_distances(s, path, table(s, d, "fasta_record").where("name <> ''"), "name")
    known = got.agg(F.lit("known").alias("kind"), F.count("*").alias("n"), F.round(F.sum("distance"), 4).alias("total"))
    return known.unionByName(unknown.agg(F.lit("unknown").alias("kind"), F.count("*").alias("n"), F.lit(None).cast("double").alias("total")))


def projected_reads(s, d):
    """Records placed on 40 reference sites by an alignment string that depends on their number."""
    f = table(s, d, "fasta_record").where("length(seq) >= 40").select("row_ord", "seq", F.concat((F.col("row_ord") % 5 + 1).cast("string"), F.lit("S10M3D12M2I7=")).alias("cigar"), F.lit(2).alias("start"))
    return tb.projected(f, "row_ord", "seq", "cigar", "start", 40).select(F.col("query").alias("row_ord"), F.col("seq").alias("placed"))


def stream_tally(s, d):
    """Running totals of the event stream by type, those over 200 counted as flagged; the last state of each."""
    e = s.readStream.schema(table(s, d, "events").schema).parquet(f"{d}/events.parque[t]")
    e = e.select("event_type", F.when(F.col("value") > 200, "HIGH").otherwise("PASS").alias("status"))
    out = ss.run_to_table(ss.running_tally(e, "event_type"), _folder(s), "update")
    return out.groupBy(F.col("key").alias("event_type")).agg(F.max("seen").alias("seen"), F.max("flagged").alias("flagged"))


QUERIES = {f.__name__: f for f in (fasta_files, phylip_files, nexus_files, xml_files, auspice_files, newick_files, site_test_files, metadata_files, unparsed_dates, distance_files, projected_reads, stream_tally)}

_SEQS = "select 't' || taxon name, string_agg(state, '' order by site) seq"
_ALIGNED = "with {} " + _SEQS + " from sites group by taxon"


def _oracle() -> dict[str, str]:
    from cladeflow.plans.alignments import ORACLE as others
    from cladeflow.plans.alignments import SITES

    named = "'t' || vec_id name"
    date = "round(2000 + (vec_id * 37 % 240) / 12e0, 4)"
    return {
        "fasta_files": r"with f as (select 'r' || row_ord name, replace(upper(regexp_replace(coalesce(seq, ''), '\s', '', 'g')), 'U', 'T') s from fasta_record) select name, length(s)::int letters, md5(s) digest from f",
        "phylip_files": _ALIGNED.format(SITES),
        "nexus_files": _ALIGNED.format(SITES),
        "xml_files": f"with {SITES}, q as ({_SEQS} from sites group by taxon) select q.name, seq, date from q join (select {named}, {date} date from embeddings) using (name)",
        "auspice_files": f"select {named}, {date} date, 'c' || label place from embeddings",
        "newick_files": f"select {named}, round({date} - 2000, 4) length from embeddings",
        "site_test_files": "select gene_id, round(greatest(max_lrt, 0), 6) lrt, 0.25e0 p from orthomam_gene_selection where max_lrt is not null and not isnan(max_lrt)",
        "metadata_files": "select coalesce(trim(location), '') place, count(*) n, count(lat) located, round(sum(lat), 3) lat, round(sum(lon), 3) lon from h5n1_ha_metadata group by 1",
        "unparsed_dates": f"with r as ({others['start_of_day_text']}) select case when coalesce(trim(m.date), '') = '' then 'blank' when r.y is not null then 'read' else 'unread' end kind, count(*) n from meta m left join r using (meta_row) group by 1",
        "distance_files": "with e as (select id1, id2, distance from supported_edges where id1 is not null and id2 is not null), k as (select distinct name from fasta_record where name <> '') select 'known' kind, count(*) n, round(sum(distance) filter (not isnan(distance)), 4) total from e where id1 in (select name from k) and id2 in (select name from k) union all select 'unknown', count(*), null from (select distinct unnest([id1, id2]) x from e) where x not in (select name from k)",
        "projected_reads": "select row_ord, '--' || substr(seq, (row_ord % 5 + 2)::int, 10) || '---' || substr(seq, (row_ord % 5 + 12)::int, 12) || substr(seq, (row_ord % 5 + 26)::int, 7) || '------' placed from fasta_record where length(seq) >= 40",
        "stream_tally": "select event_type, count(*) seen, count(*) filter (value > 200) flagged from events group by 1",
    }


ORACLE = _oracle()
