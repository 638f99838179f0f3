"""Line-wise and tabular sources and the sinks that go with them."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: fixed values: names under which metadata columns are looked for, in this order
CANDIDATES = {
    "id": ("taxon", "id", "name", "strain", "sequence", "accession", "seq_id", "sample"),
    "date": ("date", "num_date", "collection_date", "sampling_date", "year", "time"),
    "location": ("location", "country", "region", "division", "state", "place"),
    "lat": ("lat", "latitude"),
    "lon": ("lon", "long", "lng", "longitude"),
}


def read_fasta(spark: SparkSession, path: str, preamble: bool = True) -> DataFrame:
    """row_ord, name, defline, seq: the name is the first word without quotes, letters are upper case without white
    space, U as T; a record ends before a line that begins with a parenthesis, an appended tree; text before a file's first header is ignored, empty sequences stay. Split at record
    starts by the text source, so a large file is read by many tasks; .gz is read as one.
    With preamble = False files are known to begin with a header, which saves looking for
    each file's first piece."""
    raw = spark.read.option("lineSep", "\n>").text(path).select(F.monotonically_increasing_id().alias("row_ord"), F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", "\r", "").alias("v"))
    # only a file's first piece still has its `>`
    headed = F.col("v").startswith(">")
    if preamble:
        first = raw.groupBy("path").agg(F.min("row_ord").alias("row_ord")).select("row_ord", F.lit(True).alias("is_first"))
        raw = raw.join(first, "row_ord", "left").where(F.col("is_first").isNull() | headed)
    parts = raw.select("row_ord", F.when(headed, F.expr("substring(v, 2)")).otherwise(F.col("v")).alias("b"))
    line = F.trim(F.substring_index("b", "\n", 1))
    rest = F.when(F.instr("b", "\n") > 0, F.expr("substring(b, instr(b, '\n') + 1)")).otherwise("")
    letters = F.regexp_replace(F.regexp_replace(rest, r"(?s)(^|\n)[ \t]*\(.*", ""), r"\s", "")
    name = F.btrim(F.regexp_extract(line, r"^(\S*)", 1), F.lit("'\""))
    return parts.select("row_ord", name.alias("name"), line.alias("defline"), F.translate(F.upper(letters), "U", "T").alias("seq"))


def write_fasta(df: DataFrame, path: str, name: str, seq: str, by: str | None = None) -> None:
    """FASTA text files, one folder per value of `by`."""
    text = df.select(*([F.col(by)] if by else []), F.concat(F.lit(">"), F.col(name), F.lit("\n"), F.coalesce(seq, F.lit(""))).alias("value"))
    (text.write.partitionBy(by) if by else text.write).text(path)


def resolve_columns(columns: list[str], wanted: tuple[str, ...] = tuple(CANDIDATES)) -> dict[str, str]:
    """What each wanted role is called in a table; roles without a column are left out."""
    lower = {c.strip().lower(): c for c in reversed(columns)}
    return {w: lower[n] for w in wanted for n in [next((x for x in CANDIDATES[w] if x in lower), None)] if n}


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """CSV or TSV (by suffix) as id, date, location, lat, lon; what is missing is null."""
    sep = "\t" if re.search(r"\.(tsv|txt|tab)(\.gz)?$", path) else ","
    df = spark.read.csv(path, header=True, sep=sep)
    at = resolve_columns(df.columns)
    kinds = {"lat": "double", "lon": "double"}
    return df.select(*((F.expr(f"try_cast(`{at[w]}` as {kinds[w]})") if w in kinds else F.col(f"`{at[w]}`")).alias(w) if w in at else F.lit(None).cast(kinds.get(w, "string")).alias(w) for w in CANDIDATES))


def read_distances(spark: SparkSession, path: str, ids: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(i, j, distance) of known ids from a CSV `ID1,ID2,Distance`, and the unknown ids; a distance
    that cannot be read is null."""
    raw = spark.read.csv(path, header=True).toDF("a", "b", "d").select("a", "b", F.expr("try_cast(d as double)").alias("distance"))
    known = ids.select(F.col(key).alias("k")).distinct()
    both = raw.join(known.withColumnRenamed("k", "a"), "a", "left_semi").join(known.withColumnRenamed("k", "b"), "b", "left_semi")
    unknown = raw.select(F.explode(F.array("a", "b")).alias("k")).distinct().join(known, "k", "left_anti")
    good = F.when(~F.isnan("distance"), F.col("distance"))
    return both.select(F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j"), good.alias("distance")), unknown


def mutation(c: Column) -> Column:
    """struct(ref, position, alt) of `R175H`; null for other text."""
    p = r"^\s*(?:p\.)?([A-Za-z*])(\d+)([A-Za-z*])\s*$"
    return F.when(c.rlike(p), F.struct(F.upper(F.regexp_extract(c, p, 1)).alias("ref"), F.regexp_extract(c, p, 2).cast("int").alias("position"), F.upper(F.regexp_extract(c, p, 3)).alias("alt")))


def cigar_projection(df: DataFrame, query: str, cigar: str, start: str) -> DataFrame:
    """Aligned blocks: query, op, length, ref_from, query_from (from 0). = X M use both, D N the
    reference, I S the query."""
    ops = F.regexp_extract_all(cigar, F.lit(r"(\d+)[=XMDISNH]"), F.lit(1))
    kinds = F.regexp_extract_all(cigar, F.lit(r"\d+([=XMDISNH])"), F.lit(1))
    steps = F.zip_with(ops, kinds, lambda n, k: F.struct(n.cast("int").alias("n"), k.alias("k")))
    grow = lambda acc, x: F.struct(F.concat(acc["blocks"], F.array(F.struct(x["k"].alias("op"), x["n"].alias("length"), acc["r"].alias("ref_from"), acc["q"].alias("query_from")))).alias("blocks"), (acc["r"] + F.when(x["k"].isin("=", "X", "M", "D", "N"), x["n"]).otherwise(0)).alias("r"), (acc["q"] + F.when(x["k"].isin("=", "X", "M", "I", "S"), x["n"]).otherwise(0)).alias("q"))
    none = F.array().cast("array<struct<op:string,length:int,ref_from:int,query_from:int>>")
    all_ = F.aggregate(steps, F.struct(none.alias("blocks"), F.col(start).cast("int").alias("r"), F.lit(0).alias("q")), grow)
    return df.select(F.col(query).alias("query"), F.explode(all_["blocks"]).alias("x")).select("query", "x.*")


def projected(df: DataFrame, query: str, seq: str, cigar: str, start: str, length: int) -> DataFrame:
    """query, seq: each query's letters placed on `length` reference sites, gaps elsewhere; insertions are dropped."""
    b = cigar_projection(df, query, cigar, start).where(F.col("op").isin("=", "X", "M"))
    blocks = b.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("ref_from", "query_from", "length"))).alias("b"))
    x = df.select(F.col(query).alias("query"), F.col(seq).alias("s")).join(blocks, "query", "left")
    blank = F.lit("-" * length)
    put = lambda acc, k: F.overlay(acc, F.substring(F.col("s"), k["query_from"] + 1, k["length"]), k["ref_from"] + 1, k["length"])
    out = F.aggregate(F.coalesce("b", F.array().cast("array<struct<ref_from:int,query_from:int,length:int>>")), blank, put)
    return x.select("query", F.substring(out, 1, length).alias("seq"))


def geojson_points(df: DataFrame, lat: str, lon: str, *properties: str) -> DataFrame:
    """One GeoJSON feature per row as text; rows without coordinates have a null geometry."""
    point = F.when(F.col(lat).isNotNull() & F.col(lon).isNotNull(), F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates")))
    return df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), point.alias("geometry"), F.struct(*properties).alias("properties")), {"ignoreNullFields": "false"}).alias("value"))


def graphml(edges: DataFrame, weight: str) -> DataFrame:
    """GraphML lines of an edge table (i, j): nodes, then edges, each a row of text with a sort key."""
    nodes = edges.select(F.explode(F.array(F.col("i").cast("string"), F.col("j").cast("string"))).alias("n")).distinct()
    esc = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    n = nodes.select(F.lit(1).alias("k"), F.format_string('<node id="%s"/>', esc(F.col("n"))).alias("value"))
    e = edges.select(F.lit(2).alias("k"), F.format_string('<edge source="%s" target="%s"><data key="w">%s</data></edge>', esc(F.col("i").cast("string")), esc(F.col("j").cast("string")), F.col(weight).cast("string")).alias("value"))
    return n.unionByName(e)
