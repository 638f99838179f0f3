"""Queries over sequences: the records' own letters, and an alignment made of the vectors.

The vectors stand in for aligned taxa: each label is a clade with its own base per site,
which a large component replaces and a tiny one turns into a gap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeflow.functions import dates as dt
from cladeflow.functions import kmers as km
from cladeflow.functions import sequences as sq
from cladeflow.functions.times import micros
from cladeflow.operators import alignments as al
from cladeflow.session import spread, stored, table


def aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """taxon, clade, date, seq of 64 letters."""
    e = table(spark, sf_dir, "embeddings")

    def letter(x, i):
        x = x.cast("double")
        base = (F.col("label") * 7 + i * 3 + F.col("label") * i) % 4
        n = F.when(F.abs(x) > 0.2, (base + 1 + F.when(x > 0, 1).otherwise(0)) % 4).otherwise(base)
        return F.when(F.abs(x) < 0.004, "-").otherwise(F.substring(F.lit("ACGT"), n + 1, F.lit(1)))

    return e.select(F.col("vec_id").alias("taxon"), F.col("label").alias("clade"), (2000 + (F.col("vec_id") * 37 % 240) / 12).alias("date"), F.concat_ws("", F.transform("embedding", letter)).alias("seq"))


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return al.long_form(aligned(spark, sf_dir), "taxon", "seq", "clade", "date")


def plain_base() -> Column:
    return F.col("state").isin(*"ACGT")


def consensus_smallest(s, d):
    return al.consensus(sites(s, d), plain_base()).select("site", "state", "n")


def consensus_first_seen(s, d):
    return al.consensus(sites(s, d), plain_base(), "first").select("site", "state", "n")


def consensus_decayed(s, d):
    return al.consensus(sites(s, d), plain_base(), weight=F.exp(-0.1 * (F.col("date") - 2000))).select("site", "state", F.round("n", 6).alias("n"))


def allele_freq(s, d):
    a = al.allele_frequencies(sites(s, d))
    return a.select("site", *(F.round(f"f{b}", 6).alias(f"f{b}") for b in "ACGT"), "consensus", "n")


def column_distance(s, d):
    return al.column_distance(sites(s, d)).select("taxon", F.round("distance", 6).alias("distance"))


def informative_sites(s, d):
    return al.informative_sites(sites(s, d))


def variable_sites(s, d):
    return al.variable_sites(sites(s, d))


def coverage_envelope(s, d):
    x = al.coverage_envelope(sites(s, d))
    n = aligned(s, d).agg(F.greatest(F.lit(6), F.ceil(2.5 * F.log(F.count("*")))).alias("least_informative"))
    return x.join(F.broadcast(n))


def haplotype_collapse(s, d):
    f = table(s, d, "fasta_record").where("seq is not null")
    return al.collapse_identical(f.select("row_ord", "name", sq.ungapped(F.col("seq")).alias("seq")), "row_ord", "name", "seq").select("first", "copies")


def effective_length(s, d):
    f = table(s, d, "fasta_record").where("seq is not null")
    return f.agg(F.floor(F.median(F.length(sq.ungapped(F.col("seq"))))).alias("effective_length"), F.max(F.length("seq")).alias("width"))


def missing_ratio(s, d):
    return table(s, d, "fasta_record").where("length(seq) > 0").select("row_ord", F.round(sq.missing_ratio(F.col("seq")), 6).alias("ratio"))


def completeness_filter(s, d):
    """Records with at most 5 % unusable letters; all of them if fewer than ten would stay."""
    f = table(s, d, "fasta_record").where("length(seq) > 0").select("row_ord", sq.missing_ratio(F.col("seq")).alias("r"))
    enough = f.agg((F.count_if(F.col("r") <= 0.05) >= 10).alias("enough"))
    return f.join(F.broadcast(enough)).where(~F.col("enough") | (F.col("r") <= 0.05)).select("row_ord")


def letter_codes(s, d):
    """Masks, numbers and distance codes of all letters in the records."""
    x = table(s, d, "fasta_record").where("length(seq) > 0").select(F.explode(F.split("seq", "")).alias("c"))
    x = x.groupBy("c").agg(F.count("*").alias("n"))
    return x.select("c", "n", sq.base_mask(F.col("c")).alias("mask"), sq.base_number(F.col("c")).alias("number"), sq.base_code(F.col("c")).alias("one_based"), sq.distance_code(F.col("c")).alias("code"))


def _codon_rows(s, d):
    """row_ord, last (whether the codon is the last whole one), codon."""
    x = spread(table(s, d, "fasta_record").select("row_ord", sq.ungapped(F.col("seq")).alias("s")).where("length(s) > 2"))
    n = F.floor(F.length("s") / 3).cast("int")
    x = x.select("row_ord", "s", n.alias("n"), F.explode(F.sequence(F.lit(0), n - 1)).alias("i"))
    return x.select("row_ord", (F.col("i") == F.col("n") - 1).alias("last"), F.substring(F.col("s"), F.col("i") * 3 + 1, F.lit(3)).alias("codon"))


def codon_usage(s, d):
    x = _codon_rows(s, d).groupBy("codon").agg(F.count("*").alias("n"))
    return x.select("codon", "n", sq.codon_token(F.col("codon")).alias("codon_tok"), sq.amino_token(F.col("codon")).alias("aa_tok"))


def internal_stops(s, d):
    """Stop codons before the last codon, per record."""
    x = _codon_rows(s, d).where(~F.col("last") & F.col("codon").isin("TAA", "TAG", "TGA"))
    return x.groupBy("row_ord").agg(F.count("*").cast("int").alias("stops"))


def reverse_complements(s, d):
    return table(s, d, "fasta_record").where("seq is not null").select("row_ord", F.md5(sq.reverse_complement(F.col("seq"))).alias("digest"))


def canonical_kmers(s, d):
    """Canonical 15-mers that occur at least twenty times in all records."""
    x = spread(table(s, d, "fasta_record").select("seq")).mapInArrow(km.kmer_counts(15), "code long, n long")
    x = x.groupBy("code").agg(F.sum("n").alias("n")).where("n >= 20")
    letter = lambda i: F.substring(F.lit("ACGT"), (F.shiftright("code", 2 * (14 - i)).bitwiseAND(F.lit(3)) + 1).cast("int"), F.lit(1))
    return x.select(F.concat(*(letter(i) for i in range(15))).alias("kmer"), "n")


#: fixed value: hashes in a sketch
SKETCH = 1024


def _sketches(s, d):
    """row_ord, h: the least hashes of a record's canonical 15-mers, ascending."""
    x = spread(table(s, d, "fasta_record").select("row_ord", "seq"))
    return x.mapInArrow(km.bottom_sketches(SKETCH), "row_ord long, h array<long>")


def kmer_sketch(s, d):
    """Bottom sketches: how many of the 1024 least hashes of a record, and their sum."""
    low = F.col("h")
    return _sketches(s, d).select("row_ord", F.size(low).alias("size"), F.aggregate(low, F.lit(0).cast("long"), lambda a, b: a + b).alias("total"))


def _six(x: Column) -> Column:
    """F.round(x, 6) of a small x >= 0. F.round makes a decimal number of every row; here it does so only near a tie."""
    y = x * 1e6
    return F.when(F.abs(y - F.floor(y) - 0.5) < 1e-6, F.round(x, 6)).otherwise(F.floor(y + 0.5) / 1e6)


def sketch_distances(s, d):
    """Mash distances of records that share any of their 1024 least hashes: exact through the shared hashes, no filter.

    Of the joint hashes as many of the least count as the larger sketch holds. A task takes two blocks of records, makes
    their sketches and meets them there: neither hashes nor shared hashes are shuffled, which are many times the input,
    only the letters are written once. Every two blocks meet, as the pairs grow with the square of the records."""
    x = spread(table(s, d, "fasta_record").select("row_ord", "seq"))
    blocks = stored(x.mapInArrow(km.record_blocks(), "block long, keys array<long>, seqs binary"))
    a, b = (blocks.select(*(F.col(c).alias(f"{c}_{side}") for c in blocks.columns)) for side in "ab")
    met = a.hint("shuffle_replicate_nl").join(b, F.col("block_a") <= F.col("block_b"))
    g = met.mapInArrow(km.sketch_pairs(SKETCH), "a long, b long, inside int, whole int")
    j = F.col("inside") / F.col("whole")
    return g.select("a", "b", _six(j).alias("jaccard"), _six(sq.mash_distance(j, 15)).alias("distance"))


def order_midpoints(s, d):
    o = table(s, d, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("n"))
    return o.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "n", F.round(dt.day_midpoint(F.col("day")), 8).alias("mid"), F.round(dt.month_midpoint(F.year("day"), F.month("day")), 8).alias("month_mid"), F.round(dt.year_start_of_day(F.year("day"), F.month("day"), F.day("day")), 8).alias("start"))


def start_of_day_text(s, d):
    m = table(s, d, "meta").select("meta_row", dt.text_start_of_day(F.col("date")).alias("y"))
    return m.where("y is not null").select("meta_row", F.round("y", 6).alias("y"))


def header_years(s, d):
    f = table(s, d, "fasta_record").select("row_ord", dt.header_token(F.col("defline"), False).alias("first_year"), dt.header_token(F.col("defline"), True).alias("last_year"))
    return f.where("first_year is not null")


def mismatch_runs(s, d):
    x = sites(s, d)
    return al.mismatch_runs(x, al.consensus(x, plain_base()), 4).select("taxon", "first", "last", "length")


def masked_sequences(s, d):
    x = sites(s, d)
    runs = al.mismatch_runs(x, al.consensus(x, plain_base()), 4)
    return al.masked(aligned(s, d).select("taxon", "seq"), "taxon", "seq", runs).select("taxon", F.md5("seq").alias("digest"))


def merged_tracts(s, d):
    e = table(s, d, "events").select("user_id", (F.floor(micros("ts") / 60e6)).alias("a"))
    return al.merge_intervals(e.withColumn("b", F.col("a") + 240), ["user_id"], "a", "b").select("user_id", "a", "b", "parts")


QUERIES = {f.__name__: f for f in (consensus_smallest, consensus_first_seen, consensus_decayed, allele_freq, column_distance, informative_sites, variable_sites, coverage_envelope, haplotype_collapse, effective_length, missing_ratio, completeness_filter, letter_codes, codon_usage, internal_stops, reverse_complements, canonical_kmers, kmer_sketch, sketch_distances, order_midpoints, start_of_day_text, header_years, mismatch_runs, masked_sequences, merged_tracts)}

#: the alignment in SQL: taxon, clade, date, site, state
SITES = """u as (select vec_id taxon, label clade, 2000 + (vec_id * 37 % 240) / 12e0 date, unnest(embedding)::double x, generate_subscripts(embedding, 1) - 1 site from embeddings),
w as (select *, (clade * 7 + site * 3 + clade * site) % 4 base from u),
sites as (select taxon, clade, date, site::int site, case when abs(x) < 0.004e0 then '-' else substr('ACGT', ((case when abs(x) > 0.2e0 then (base + 1 + (case when x > 0 then 1 else 0 end)) % 4 else base end) + 1)::int, 1) end state from w),
v as (select * from sites where state <> '-')"""
_UNGAPPED = "upper(replace(seq, '-', ''))"
_CONS = "c as (select site, state, count(*) n, min(taxon) f from v group by all), k as (select *, row_number() over (partition by site order by n desc, {}) r from c)"
_RUNS = f"with {SITES}, {_CONS.format('state')}, m as (select taxon, v.site from v join k on v.site = k.site and r = 1 and v.state <> k.state), g as (select *, site - row_number() over (partition by taxon order by site) i from m), runs as (select taxon, min(site) \"first\", max(site) \"last\", count(*) length from g group by taxon, i having count(*) >= 4)"
_AMBIG = "(values " + ", ".join(f"('{c}', {sum(1 << 'ACGT'.index(b) for b in v) if len(v) < 4 else 0})" for c, v in sq.IUPAC.items()) + ") t(c, mask)"
_CODONS = "(values " + ", ".join(f"('{c}', {i}, {sq.AMINO_ORDER.index(sq.CODON_AMINO[c])})" for i, c in enumerate(sq.SENSE)) + ") t(codon, a, b)"
_SPLIT = f"(select row_ord, s, unnest(range(0, length(s) // 3)) i from (select row_ord, {_UNGAPPED} s from fasta_record where length(seq) > 2))"
_LEAP = "(case when (y % 4 = 0 and y % 100 <> 0) or y % 400 = 0 then 366 else 365 end)"

ORACLE = {
    "consensus_smallest": f"with {SITES}, {_CONS.format('state')} select site, state, n from k where r = 1",
    "consensus_first_seen": f"with {SITES}, {_CONS.format('f')} select site, state, n from k where r = 1",
    "consensus_decayed": f"with {SITES}, c as (select site, state, sum(exp(-0.1e0 * (date - 2000))) n from v group by all), k as (select *, row_number() over (partition by site order by n desc, state) r from c) select site, state, round(n, 6) n from k where r = 1",
    "allele_freq": f"with {SITES}, c as (select site, " + ", ".join(f"count(*) filter (state = '{b}') n{b}" for b in "ACGT") + " from sites group by site) select site, " + ", ".join(f"round(greatest(n{b} / (nA + nC + nG + nT), 1e-4), 6) f{b}" for b in "ACGT") + ", case greatest(nA, nC, nG, nT) when nA then 'A' when nC then 'C' when nG then 'G' else 'T' end consensus, nA + nC + nG + nT n from c",
    "column_distance": f"with {SITES}, q as (select taxon, count(*) over (partition by site) n, count(*) over (partition by site, state) k from v) select taxon, round(avg((n - k) / (n - 1)), 6) distance from q group by taxon",
    "informative_sites": f"with {SITES} select site, count(*) states from (select site, state from v group by all having count(*) >= 2) group by site having count(*) >= 2",
    "variable_sites": f"with {SITES} select site, count(distinct state) states from v group by site having count(distinct state) >= 2",
    "coverage_envelope": f"with {SITES} select min(site) \"first\", max(site) \"last\", (select greatest(6, ceil(2.5e0 * ln(count(*))))::bigint from embeddings) least_informative from (select site from v group by site having count(*) >= 3)",
    "haplotype_collapse": f"select min(row_ord) \"first\", count(*) copies from fasta_record where seq is not null group by {_UNGAPPED}",
    "effective_length": "select floor(median(length(replace(seq, '-', ''))))::bigint effective_length, max(length(seq))::int width from fasta_record where seq is not null",
    "missing_ratio": "select row_ord, round(length(regexp_replace(upper(seq), '[ACGTU]', '', 'g')) / length(seq), 6) ratio from fasta_record where length(seq) > 0",
    "completeness_filter": "select row_ord from fasta_record where length(seq) > 0 and length(regexp_replace(upper(seq), '[ACGTU]', '', 'g')) / length(seq) <= 0.05e0",
    "letter_codes": f"select x.c, count(*) n, coalesce(any_value(mask), 0)::int mask, instr('ACGT', replace(upper(x.c), 'U', 'T'))::int - 1 \"number\", instr('ACGT', replace(upper(x.c), 'U', 'T'))::int one_based, case when instr('{sq.CODE_ORDER}', upper(x.c)) > 0 then instr('{sq.CODE_ORDER}', upper(x.c))::int - 1 else {len(sq.CODE_ORDER) - 1} end code from (select unnest(string_split(seq, '')) c from fasta_record where length(seq) > 0) x left join {_AMBIG} on upper(x.c) = t.c group by x.c",
    "codon_usage": f"select x.codon, count(*) n, coalesce(any_value(a), 64)::int codon_tok, coalesce(any_value(b), 20)::int aa_tok from (select substr(s, (3 * i + 1)::int, 3) codon from {_SPLIT}) x left join {_CODONS} using (codon) group by x.codon",
    "internal_stops": f"select row_ord, count(*)::int stops from {_SPLIT} where i < length(s) // 3 - 1 and substr(s, (3 * i + 1)::int, 3) in ('TAA', 'TAG', 'TGA') group by row_ord",
    "reverse_complements": "select row_ord, md5(reverse(translate(upper(seq), 'ACGTURYSWKMBDHVN', 'TGCAAYRSWMKVHDBN'))) digest from fasta_record where seq is not null",
    "canonical_kmers": f"with s as (select {_UNGAPPED} s from fasta_record), k as (select substr(s, i::int, 15) k from (select s, unnest(range(1, length(s) - 13)) i from s where length(s) >= 15)) select least(k, reverse(translate(k, 'ACGT', 'TGCA'))) kmer, count(*) n from k where not regexp_matches(k, '[^ACGT]') group by 1 having count(*) >= 20",
    "order_midpoints": f"with o as (select o_orderdate::date \"day\", count(*) n from orders group by 1), p as (select *, year(\"day\") y, {_LEAP} len from o) select strftime(\"day\", '%Y-%m-%d') \"day\", n, round(y + (dayofyear(\"day\") - 0.5e0) / len, 8) mid, round(y + (dayofyear(date_trunc('month', \"day\")) - 1 + day(last_day(\"day\")) / 2e0) / len, 8) month_mid, round(y + (dayofyear(\"day\") - 1) / len, 8) \"start\" from p",
    "start_of_day_text": r"with m as (select meta_row, replace(trim(date), '/', '-') s from meta), p as (select meta_row, s, try_cast(nullif(regexp_extract(s, '^([0-9]{4})(?:-([0-9]{1,2}))?(?:-([0-9]{1,2}))?$', 1), '') as int) y, try_cast(nullif(regexp_extract(s, '^([0-9]{4})(?:-([0-9]{1,2}))?(?:-([0-9]{1,2}))?$', 2), '') as int) m, try_cast(nullif(regexp_extract(s, '^([0-9]{4})(?:-([0-9]{1,2}))?(?:-([0-9]{1,2}))?$', 3), '') as int) d from m), q as (select *, (m is null or m between 1 and 12) and (d is null or d between 1 and 31) and y between 1 and 9999 ok from p), r as (select *, make_date(y, m, greatest(1, least(coalesce(d, 15), day(last_day(make_date(y, m, 1)))))) dd from q where ok and m is not null), z as (select meta_row, y + (dayofyear(dd) - 1) / (case when (y % 4 = 0 and y % 100 <> 0) or y % 400 = 0 then 366e0 else 365e0 end) v from r union all select meta_row, y + 0.5e0 from q where ok and m is null union all select meta_row, s::double from q where regexp_full_match(s, '[0-9]{4}[.][0-9]+')) select meta_row, round(v, 6) y from z",
    "header_years": r"with h as (select row_ord, list_filter(regexp_split_to_array(defline, '[|_. ]'), lambda t: regexp_full_match(t, '(19|20)\d\d')) y from fasta_record) select row_ord, y[1]::int first_year, y[len(y)]::int last_year from h where len(y) > 0",
    "mismatch_runs": f"{_RUNS} select taxon, \"first\", \"last\", length from runs",
    "masked_sequences": f"{_RUNS}, s as (select s.taxon, s.site, case when r.taxon is not null then 'N' else state end state from sites s left join runs r on s.taxon = r.taxon and s.site between \"first\" and \"last\") select taxon, md5(string_agg(state, '' order by site)) digest from s group by taxon",
    "merged_tracts": "with e as (select user_id, floor(epoch_us(ts) / 60e6)::bigint a from events), f as (select *, a + 240 b from e), g as (select *, max(b) over (partition by user_id order by a, b rows between unbounded preceding and 1 preceding) pe from f), h as (select *, sum(case when pe is null or a > pe + 1 then 1 else 0 end) over (partition by user_id order by a, b rows unbounded preceding) i from g) select user_id, min(a) a, max(b) b, count(*) parts from h group by user_id, i",
}
