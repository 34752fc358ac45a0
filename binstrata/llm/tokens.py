"""The public tokenizer: loading it once per worker, encoding batches, counting tokens."""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Folder of the vocabulary files; a parameter of every operator.
TOKENIZERS = os.environ.get("BINSTRATA_TOKENIZERS", "/opt/tokenizers")
MODEL = "byte_bpe_50k"
#: Characters given to the tokenizer at once, so that a batch of very long texts stays small.
SLICE_CHARS = 1 << 20


@lru_cache(maxsize=2)
def tokenizer(folder: str = TOKENIZERS, model: str = MODEL):
    """The tokenizer, loaded once in each Python worker. Strings that look like special tokens are
    ordinary text."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{folder}/{model}.json")
    t.encode_special_tokens = True
    return t


def slices(texts: list[str]) -> Iterator[list[str]]:
    """Runs of texts of bounded total length, in order."""
    out: list[str] = []
    n = 0
    for x in texts:
        if out and n + len(x) > SLICE_CHARS:
            yield out
            out, n = [], 0
        out.append(x)
        n += len(x)
    if out:
        yield out


def token_counts(df: DataFrame, text: str = "text", out: str = "n_tokens", folder: str = TOKENIZERS) -> DataFrame:
    """``df`` without its text, with the number of tokens of it; null and empty texts have none."""
    keep = [f for f in df.schema if f.name != text]
    schema = T.StructType([*keep, T.StructField(out, T.IntegerType())])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(folder)
        for b in batches:
            texts = [x or "" for x in b.column(0).to_pylist()]
            counts = [len(e) for s in slices(texts) for e in t.encode_batch_fast(s, add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(counts, pa.int32())], schema=arrow)

    return df.select(text, *[F.col(f.name) for f in keep]).mapInArrow(run, schema)
