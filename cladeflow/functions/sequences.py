"""Letters, codons, k-mers and sequence distances as Column expressions."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: fixed values: nucleotide ambiguity codes and the bases they stand for
IUPAC = {"A": "A", "C": "C", "G": "G", "T": "T", "U": "T", "R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC", "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT", "?": "ACGT"}
#: fixed value: order in which distance kernels number the codes
CODE_ORDER = "ACGTURYSWKMBDHVN?-"
#: fixed values: standard genetic code, codons in TCAG order
_AMINO = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
AMINO_ORDER = "ACDEFGHIKLMNPQRSTVWY"
CODON_AMINO = dict(zip(("".join(c) for c in product("TCAG", repeat=3)), _AMINO, strict=True))
SENSE = sorted(c for c, a in CODON_AMINO.items() if a != "*")
COMPLEMENT = ("ACGTURYSWKMBDHVN", "TGCAAYRSWMKVHDBN")


def _map(pairs: dict[str, int]) -> Column:
    return F.create_map(*(F.lit(x) for kv in pairs.items() for x in kv))


def base_mask(letter: Column) -> Column:
    """Four-bit set of bases (A 1, C 2, G 4, T 8); 0 for gap, N and anything else."""
    masks = {c: sum(1 << "ACGT".index(b) for b in s) for c, s in IUPAC.items() if len(s) < 4}
    return F.coalesce(F.try_element_at(_map(masks), F.upper(letter)), F.lit(0))


def base_number(letter: Column) -> Column:
    """0 to 3 for A, C, G, T (U as T), -1 otherwise."""
    return F.when(F.length(letter) == 1, F.instr(F.lit("ACGT"), F.translate(F.upper(letter), "U", "T")) - 1).otherwise(-1)


def base_code(letter: Column) -> Column:
    """1 to 4 for A, C, G, T (U as T), 0 otherwise."""
    return base_number(letter) + 1


def distance_code(letter: Column) -> Column:
    """Number in CODE_ORDER; unknown letters count as gap."""
    n = F.instr(F.lit(CODE_ORDER), F.upper(letter))
    return F.when(n > 0, n - 1).otherwise(len(CODE_ORDER) - 1)


def letters(seq: Column) -> Column:
    """The letters of a sequence as an array; empty for null and empty ones."""
    return F.when(F.length(seq) > 0, F.split(seq, "")).otherwise(F.array().cast("array<string>"))


def codons(seq: Column) -> Column:
    """Whole codons in frame one; a trailing one or two letters are left out."""
    n = F.floor(F.length(seq) / 3).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(seq, i * 3 + 1, F.lit(3)))).otherwise(F.array().cast("array<string>"))


def codon_token(codon: Column) -> Column:
    """0 to 60 for sense codons in alphabetical order; 64 for stop, gap and unknown."""
    return F.coalesce(F.try_element_at(_map({c: i for i, c in enumerate(SENSE)}), F.translate(F.upper(codon), "U", "T")), F.lit(64))


def amino_token(codon: Column) -> Column:
    """0 to 19 for amino acids in alphabetical order of their letters; 20 if missing."""
    return F.coalesce(F.try_element_at(_map({c: AMINO_ORDER.index(a) for c, a in CODON_AMINO.items() if a != "*"}), F.translate(F.upper(codon), "U", "T")), F.lit(20))


def missing_ratio(seq: Column) -> Column:
    """Share of letters other than A, C, G, T, U; null for an empty sequence."""
    return F.try_divide(F.length(F.regexp_replace(F.upper(seq), "[ACGTU]", "")), F.length(seq))


def ungapped(seq: Column) -> Column:
    return F.upper(F.replace(seq, F.lit("-"), F.lit("")))


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(F.upper(seq), *COMPLEMENT))


def kmers(seq: Column, k: int) -> Column:
    """All substrings of k letters of the ungapped sequence that hold only A, C, G, T. The
    sequence is first cut at other letters, so that no substring needs a check."""
    pieces = F.filter(F.split(ungapped(seq), "[^ACGT]+"), lambda x: F.length(x) >= k)
    return F.flatten(F.transform(pieces, lambda s: F.transform(F.sequence(F.lit(1), F.length(s) - k + 1), lambda i: F.substring(s, i, F.lit(k)))))


def kmer_rows(df: DataFrame, seq: str, k: int, *keep: str) -> DataFrame:
    """keep and kmer, one row per substring as in kmers(): explodes instead of nested lambdas, so
    that every step runs in generated code."""
    pieces = df.select(*keep, F.explode(F.split(ungapped(F.col(seq)), "[^ACGT]+")).alias("__s")).where(F.length("__s") >= k)
    at = pieces.select(*keep, "__s", F.explode(F.sequence(F.lit(1), F.length("__s") - k + 1)).alias("__i"))
    return at.select(*keep, F.substring(F.col("__s"), F.col("__i"), F.lit(k)).alias("kmer"))


def canonical(kmer: Column) -> Column:
    return F.least(kmer, reverse_complement(kmer))


#: fixed value: seeding a CRC of 15 bytes is the same as this exclusive-or of the plain one
CRC_SEED_15 = 0x31FF62DA


def kmer_hash(kmer: Column) -> Column:
    """Seeded CRC of a 15-letter k-mer, as one JVM expression."""
    return F.crc32(kmer.cast("binary")).bitwiseXOR(F.lit(CRC_SEED_15))


def jukes_cantor(p: Column) -> Column:
    """Corrected distance of a share of differing sites, which is held below 3/4."""
    return -0.75 * F.log(1 - F.least(p, F.lit(0.7499)) * 4 / 3)


def mash_distance(j: Column, k: int) -> Column:
    """Distance of a k-mer Jaccard similarity; 1 where there is no overlap."""
    return F.when(j > 0, F.greatest(F.lit(0.0), -F.log(2 * j / (1 + j)) / k)).otherwise(1.0)
