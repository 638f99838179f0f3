"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

#: where the ranks lie by default; every operator takes another path
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: fixed value: the public splitting pattern of this vocabulary
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def with_tokens(df: DataFrame, text: str, out: str = "tokens", path: str = RANKS) -> DataFrame:
    """df without its text column, with the number of tokens of the whole text (0 if null
    or empty); a column named `out` is replaced."""
    kept = [c for c in df.columns if c not in (text, out)]
    schema = StructType([*(df.schema[c] for c in kept), StructField(out, LongType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path)
        for b in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in b.column(len(kept)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], pa.array(n, pa.int64())], names=[*kept, out])

    return df.select(*kept, F.col(text).cast("string")).mapInArrow(work, schema)
