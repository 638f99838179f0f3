"""Problem 9: languages of documents and of their lines, with confidence."""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladeflow.session import spread, stored

#: fixed values: the languages told apart, with the codes and English names that name them
LANGUAGES = ("de", "en", "es", "fr", "nl", "pt")
NAMES = {
    "de": ("de", "deu", "ger", "german"),
    "en": ("en", "eng", "english"),
    "es": ("es", "spa", "spanish", "castilian"),
    "fr": ("fr", "fra", "fre", "french"),
    "nl": ("nl", "nld", "dut", "dutch", "flemish"),
    "pt": ("pt", "por", "portuguese"),
}
#: features are hashed into so many cells; at most so many labelled documents fit the model
CELLS = 1 << 16
FIT_DOCS = 6000
_EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "“”„«»‘’‚‹›…–—¿¡·•"
_WORD = re.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*")
_BASES = re.compile(r"[ACGTUNRYKMSWBDHV\-]{4,}|[acgtun\-]{8,}")


def declared_language(c: Column) -> Column:
    """The language that a label names: any case, trimmed, with or without region, a two-
    or three-letter code or an English name; null if it names none of LANGUAGES."""
    head = F.lower(F.regexp_extract(F.trim(c), r"^([A-Za-z]+)(?:[-_].*)?$", 1))
    out = F.lit(None).cast("string")
    for lang, names in NAMES.items():
        out = F.when(head.isin(*names), lang).otherwise(out)
    return out


def word_of(token: str) -> str | None:
    """A white-space token as a natural-language word: no record names, numbers, sequences, trees."""
    t = token.strip(_EDGE)
    return t if t and _WORD.fullmatch(t) and not _BASES.fullmatch(t) else None


def words_of(line: str) -> list[str]:
    return [w for w in map(word_of, line.split()) if w]


def features(word: str) -> list[int]:
    """Cells of a word: the word itself, twice, and its trigrams, in lower case, composed."""
    w = unicodedata.normalize("NFC", word).lower()
    edged = f"^{w}$"
    got = [f"={w}"] * 2 + [edged[i : i + 3] for i in range(len(edged) - 2)]
    return [zlib.crc32(x.encode()) % CELLS for x in got]


class Scorer:
    """Log likelihood of a line per language: the sum over its words. What a token is and
    weighs is worked out once and kept; the store is emptied when it has grown large."""

    def __init__(self, table: np.ndarray):
        self.table = table
        self.clear()

    def clear(self) -> None:
        self.row: dict[str, int] = {}
        self.used = 0
        self.weights = np.zeros((1024, len(LANGUAGES)), np.float32)

    def _add(self, token: str) -> int:
        w = word_of(token)
        if w is None:
            self.row[token] = -1
            return -1
        if self.used == len(self.weights):
            self.weights = np.concatenate([self.weights, np.zeros_like(self.weights)])
        k = self.row[token] = self.used
        self.weights[k] = self.table[features(w)].sum(axis=0)
        self.used += 1
        return k

    def line(self, line: str) -> tuple[int, np.ndarray | None]:
        """(words, log likelihoods), (0, None) for a line without words."""
        if len(self.row) > 200_000:
            self.clear()
        at = []
        for t in line.split():
            k = self.row.get(t)
            if k is None:
                k = self._add(t)
            if k >= 0:
                at.append(k)
        return (len(at), self.weights[at].sum(axis=0)) if at else (0, None)


def _count(counted: np.ndarray) -> np.ndarray:
    """Counts (cells x languages) -> log probabilities, centred per cell."""
    p = np.log((counted + 0.1) / (counted.sum(axis=0) + 0.1 * len(counted)))
    return (p - p.mean(axis=1, keepdims=True)).astype(np.float32)


def fit(docs: DataFrame, key: str, text: str, label: str, bound: int = FIT_DOCS, rounds: int = 2) -> np.ndarray:
    """Naive Bayes table (CELLS x languages) from about `bound` documents at most whose label
    names a language, those with a key hash below a threshold, whole texts. After the first
    round each line of the sample counts for the language that the table finds, so that wrong
    labels and lines in other languages drop out. Features are counted on the executors;
    the driver gets at most CELLS rows of sums."""
    lang = declared_language(F.col(label))
    sample = docs.select(F.col(key).alias("k"), F.col(text).alias("text"), lang.alias("lang")).where("lang is not null and text is not null")
    # a threshold needs no sort and leaves the sample spread over the cluster
    labelled = sample.count()
    share = min(1.0, bound / max(labelled, 1))
    if share < 1:
        sample = sample.where(F.shiftrightunsigned(F.xxhash64("k"), 1) < F.lit(int(share * (2**63 - 1))))
    sample = spread(sample.select("lang", "text"))
    table: np.ndarray | None = None
    for _ in range(rounds):
        given = table

        def count(batches: Iterator[pa.RecordBatch], given=given) -> Iterator[pa.RecordBatch]:
            seen: dict[str, list[int]] = {}
            scorer = Scorer(given) if given is not None else None
            for b in batches:
                for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    for line in text.split("\n"):
                        k = LANGUAGES.index(lang)
                        if scorer is not None:
                            found, scores = scorer.line(line)
                            if not found:
                                continue
                            k = int(scores.argmax())
                        for w in words_of(line):
                            seen.setdefault(w, [0] * len(LANGUAGES))[k] += 1
            n = np.zeros((CELLS, len(LANGUAGES)))
            for w, c in seen.items():
                np.add.at(n, features(w), c)
            used = np.flatnonzero(n.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), *(pa.array(n[used, k]) for k in range(len(LANGUAGES)))], names=["cell", *LANGUAGES])

        schema = "cell int, " + ", ".join(f"{x} double" for x in LANGUAGES)
        got = sample.mapInArrow(count, schema).groupBy("cell").agg(*(F.sum(x).alias(x) for x in LANGUAGES)).toPandas()
        sums = np.zeros((CELLS, len(LANGUAGES)))
        sums[got["cell"].to_numpy()] = got[list(LANGUAGES)].to_numpy()
        table = _count(sums)
    return table


SCORED = "doc_id long, label string, source string, host string, words int, best string, scores array<float>, lines array<struct<line_no:int,words:int,scores:array<float>>>"


def score(docs: DataFrame, table: np.ndarray) -> DataFrame:
    """One row per document: its own scores and those of every line with words.
    docs: doc_id, text, label, source, host. One pass over whole texts."""
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(shared.value)
        for f in frames:
            rows = []
            for text in f["text"]:
                total, n, lines = np.zeros(len(LANGUAGES), np.float32), 0, []
                if isinstance(text, str):
                    for i, line in enumerate(text.split("\n")):
                        found, s = scorer.line(line)
                        if found:
                            total, n = total + s, n + found
                            lines.append({"line_no": i, "words": found, "scores": s.tolist()})
                rows.append((n, LANGUAGES[int(total.argmax())] if n else None, total.tolist(), lines))
            out = pd.DataFrame(rows, columns=["words", "best", "scores", "lines"])
            yield pd.concat([f[["doc_id", "label", "source", "host"]].reset_index(drop=True), out], axis=1)

    return docs.select("doc_id", "text", "label", "source", "host").mapInPandas(work, SCORED)


def _counts(scored: DataFrame, by: list[str]) -> DataFrame:
    """Documents by language found in the text, one row per group; partial aggregation
    keeps a host with a third of all documents cheap."""
    return scored.where("best is not null").groupBy(*by).agg(*(F.sum(F.when(F.col("best") == x, 1.0).otherwise(0.0)).alias(f"{x}_n") for x in LANGUAGES), F.count("*").cast("double").alias("all_n"))


def with_priors(scored: DataFrame, host_strength: float = 20.0, label_strength: float = 5.0) -> DataFrame:
    """scored plus prior: per language log p(label | lang) p(lang | host), up to a constant.

    The host's prior is smoothed by its source's, that by the prior of all documents, that by
    a uniform one; the label's evidence is smoothed by all documents. All come from
    grouped counts over all documents; groups with a null name form one of their own.
    """
    langs = list(LANGUAGES)
    whole = _counts(scored, []).select(*(F.col(f"{x}_n").alias(f"w_{x}") for x in langs), F.col("all_n").alias("w_n"))
    p_all = [(F.coalesce(F.col(f"w_{x}"), F.lit(0.0)) + 1) / (F.coalesce(F.col("w_n"), F.lit(0.0)) + len(langs)) for x in langs]
    by_source = _counts(scored, ["source"]).select("source", *(F.col(f"{x}_n").alias(f"s_{x}") for x in langs), F.col("all_n").alias("s_n"))
    by_host = _counts(scored, ["source", "host"]).select("source", "host", *(F.col(f"{x}_n").alias(f"h_{x}") for x in langs), F.col("all_n").alias("h_n"))
    # one row holds the counts of all documents
    host = by_host.join(by_source, by_host["source"].eqNullSafe(by_source["source"])).drop(by_source["source"]).join(F.broadcast(whole))
    p_source = [(F.col(f"s_{x}") + F.lit(host_strength) * p) / (F.col("s_n") + F.lit(host_strength)) for x, p in zip(langs, p_all, strict=True)]
    p_host = [(F.col(f"h_{x}") + F.lit(host_strength) * p) / (F.col("h_n") + F.lit(host_strength)) for x, p in zip(langs, p_source, strict=True)]
    host = host.select(F.col("source").alias("hs"), F.col("host").alias("hh"), F.array(*(F.log(p) for p in p_host)).alias("host_prior"))
    # p(label | lang) by Bayes from p(lang | label): divided by p(lang)
    label = _counts(scored, ["label"]).join(F.broadcast(whole))
    seen = [(F.col(f"{x}_n") + F.lit(label_strength) * p) / (F.col("all_n") + F.lit(label_strength)) for x, p in zip(langs, p_all, strict=True)]
    label = label.select(F.col("label").alias("ll"), F.array(*(F.log(s / p) for s, p in zip(seen, p_all, strict=True))).alias("label_prior"))
    out = scored.join(host, scored["source"].eqNullSafe(host["hs"]) & scored["host"].eqNullSafe(host["hh"]), "left").join(label, scored["label"].eqNullSafe(label["ll"]), "left")
    zero = F.array(*(F.lit(0.0) for _ in langs))
    prior = F.zip_with(F.coalesce("host_prior", zero), F.coalesce("label_prior", zero), lambda a, b: a + b)
    return out.select(*scored.columns, prior.alias("prior"))


#: a word counts in several overlapping features; its log likelihood is brought down by this
TEMPER = 0.25


def decide(scores: Column, prior: Column, weight: float) -> Column:
    """struct(lang, confidence): the language with the highest posterior. The text's log
    likelihood counts by TEMPER, the evidence around it by `weight`."""
    post = F.zip_with(scores, prior, lambda s, p: s.cast("double") * F.lit(TEMPER) + F.lit(weight) * p)
    top = F.array_max(post)
    at = F.array_position(post, top)
    conf = F.lit(1.0) / F.aggregate(post, F.lit(0.0), lambda acc, x: acc + F.exp(x - top))
    return F.struct(F.element_at(F.array(*(F.lit(x) for x in LANGUAGES)), at.cast("int")).alias("lang"), conf.alias("confidence"))


def languages(docs: DataFrame, doc_id: str, text: str, label: str, source: str, host: str, weight: float = 0.5, least_confidence: float = 0.0) -> DataFrame:
    """doc_id, declared, words, lang, confidence and lines (line_no, words, lang, confidence).

    Naive Bayes likelihoods of the words are fused with the declared label and with
    smoothed priors of the document's source and host. Lines count from 0 over all newlines;
    only lines with natural words are listed. A document without words (null, empty,
    data only) has null lang and confidence and no lines. The languages told apart are LANGUAGES; a text in another one
    gets the nearest of them, unless its confidence is under least_confidence: then lang is null.
    The label's evidence bears on
    the document; for a line it is weighed down by its text soon."""
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), F.col(label).cast("string").alias("label"), F.lower(F.trim(source)).alias("source"), F.col(host).cast("string").alias("host"))
    table = fit(d, "doc_id", "text", "label")
    scored = with_priors(stored(score(d.withColumn("label", declared_language(F.col("label"))), table)))
    def sure(d: Column) -> Column:
        return F.struct(F.when(d["confidence"] >= least_confidence, d["lang"]).alias("lang"), d["confidence"].alias("confidence")) if least_confidence > 0 else d

    line = lambda x: F.struct(x["line_no"].alias("line_no"), x["words"].alias("words"), sure(decide(x["scores"], F.col("prior"), weight)).alias("d"))
    whole = F.when(F.col("words") > 0, sure(decide(F.col("scores"), F.col("prior"), weight)))
    return scored.select("doc_id", F.col("label").alias("declared"), "words", whole["lang"].alias("lang"), whole["confidence"].alias("confidence"), F.transform("lines", line).alias("lines"))


def foreign_lines(found: DataFrame) -> DataFrame:
    """doc_id, line_no, lang: lines whose language is not the declared one, or none is."""
    each = found.select("doc_id", "declared", F.explode("lines").alias("x")).select("doc_id", "declared", "x.line_no", "x.d.lang")
    return each.where("lang is not null and (declared is null or declared <> lang)").select("doc_id", "line_no", "lang")


def segments(found: DataFrame) -> DataFrame:
    """Stretches of lines of one language in a document: doc_id, first_line, last_line, words,
    lang, confidence (the least of its lines). Lines without words join no stretch and end none.
    Built inside each document's row, without a shuffle."""
    fresh = lambda x: F.array(F.struct(x["line_no"].alias("first_line"), x["line_no"].alias("last_line"), x["words"].alias("words"), x["d"]["lang"].alias("lang"), x["d"]["confidence"].alias("confidence")))

    def grow(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        longer = F.struct(last["first_line"].alias("first_line"), x["line_no"].alias("last_line"), (last["words"] + x["words"]).alias("words"), last["lang"].alias("lang"), F.least(last["confidence"], x["d"]["confidence"]).alias("confidence"))
        return F.when(F.size(acc) == 0, fresh(x)).when(last["lang"] == x["d"]["lang"], F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(longer))).otherwise(F.concat(acc, fresh(x)))

    none = F.array().cast("array<struct<first_line:int,last_line:int,words:int,lang:string,confidence:double>>")
    return found.select("doc_id", F.explode(F.aggregate("lines", none, grow)).alias("s")).select("doc_id", "s.*")
