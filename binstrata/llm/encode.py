"""Encoding of the corpus, each shared chunk once.

Texts are cut at content-defined positions (where a rolling hash of the last characters has a given
form), so that equal passages of different documents give equal chunks. Distinct chunks are encoded
once and joined back to their places. A cut may fall where the tokenizer would not split the whole
text, so each join of two chunks is repaired: the stretch from the last word that is certain on the
left is encoded anew across the join, further and further, until one of its word boundaries agrees
with one inside the right chunk. From such a boundary on both encodings are the same, because the
splitting into words looks only to the right.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from binstrata.llm.tokens import TOKENIZERS, slices, tokenizer
from binstrata.session import Scratch, hot_keys

#: Characters of the rolling hash's window; bits that must be zero at a cut; least and greatest chunk.
WINDOW, BITS, LEAST, GREATEST = 16, 9, 256, 4096
#: A word is certain if the splitter saw no end of text while it decided: one character beyond the
#: word, and three from its start for the longest contraction of the splitting pattern.
BEYOND, CONTRACTION = 1, 3


def cuts(text: str, least: int = LEAST, greatest: int = GREATEST, bits: int = BITS, window: int = WINDOW) -> list[int]:
    """End positions of the chunks of a text, the last being its length; none for an empty text.

    A chunk has at least ``least`` characters, unless the text ends, and at most ``greatest``.
    """
    n = len(text)
    if n <= least:
        return [n] if n else []
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    with np.errstate(over="ignore"):
        # polynomial rolling hash of each window, as a difference of weighted prefix sums mod 2^64
        base = np.uint64(0x9E3779B97F4A7C15)
        roll = np.zeros(n, np.uint64)
        power = np.uint64(1)
        for k in range(min(window, n)):
            roll[k:] += (codes[: n - k] + np.uint64(1)) * power
            power = power * base
        mixed = (roll ^ (roll >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    marks = np.nonzero((mixed >> np.uint64(64 - bits)) == 0)[0] + 1
    out, at = [], 0
    while n - at > least:
        k = int(np.searchsorted(marks, at + least))
        end = int(marks[k]) if k < len(marks) else n
        end = min(end, at + greatest, n)
        out.append(end)
        at = end
    if at < n:
        out.append(n)
    return out


def boundaries(text: str, t) -> tuple[list[int], list[int], list[int]]:
    """``(ids, ends, counts)`` of a text: its ids, where each of the splitter's words ends, white space
    included, and the number of ids up to there."""
    enc = t.encode(text, add_special_tokens=False)
    ends = [e for _, (_, e) in t.pre_tokenizer.pre_tokenize_str(text)]
    counts: list[int] = []
    last = None
    for k, w in enumerate(enc.word_ids):
        if w == last:
            counts[-1] = k + 1
        else:
            counts.append(k + 1)
            last = w
    if len(counts) != len(ends):  # the splitter and the encoder disagree on words: no boundary but the end
        return enc.ids, [len(text)], [len(enc.ids)]
    return enc.ids, ends, counts


class Chunk:
    """A chunk with its ids and the first and last few word boundaries, as ``(end, count)``; the others
    are found by encoding it again, should they be needed."""

    def __init__(self, text: str, ids: list[int], head: list[tuple[int, int]] = (), tail: list[tuple[int, int]] = (), encode=None):
        self.text, self.ids, self.head, self.tail = text, ids, head, tail
        self._encode, self._all = encode, None

    def all(self) -> list[tuple[int, int]]:
        if self._all is None:
            _, ends, counts = self._encode(self.text)
            self._all = list(zip(ends, counts))
        return self._all


def _certain(marks: list[tuple[int, int]], first_start: int | None, length: int, skip: int) -> tuple[int, int] | None:
    """The last boundary ``(end, count)`` that the end of the known text, at ``length``, had no part in."""
    best, start = None, first_start
    for e, c in marks:
        if start is not None:
            if e + BEYOND > length or start + CONTRACTION > length:
                break
            if c >= skip:
                best = (e, c)
        start = e
    return best


def join_chunks(chunks: list[Chunk], encode) -> list[int]:
    """Ids of the concatenated text from the chunks' own ids.

    ``encode(text)`` gives ``(ids, ends, counts)``. For each join, the result is certain up to a word
    near the end of what is known; from there the text is encoded across the join, with as much of the
    next chunk as it takes until one of its own boundaries is met.
    """
    out: list[int] = []
    cur, skip, emitted = chunks[0], 0, 0  # the stretch, its tokens and characters that are out already
    for nxt in chunks[1:]:
        n = len(cur.text)
        sure = _certain(cur.tail, None, n, skip) or _certain(cur.all(), 0, n, skip) or (emitted, skip)
        out += cur.ids[skip : sure[1]]
        rest = cur.text[sure[0] :]
        at, step, complete = dict(nxt.head), 64, False
        while True:
            if not complete and step > max(at, default=0):
                at, complete = (dict(nxt.all()), True) if step > 64 or not at else (at, False)
            window = rest + nxt.text[:step]
            w_ids, w_ends, w_counts = encode(window)
            whole = step >= len(nxt.text)
            met, start = None, 0
            for e, c in zip(w_ends, w_counts):
                if e + BEYOND > len(window) or start + CONTRACTION > len(window):
                    break
                if e - len(rest) in at:
                    met = (c, at[e - len(rest)], e - len(rest))
                    break
                start = e
            if met or (whole and complete):
                break
            if whole:
                at, complete = dict(nxt.all()), True
            else:
                step *= 4
        if met:
            out += w_ids[: met[0]]
            cur, skip, emitted = nxt, met[1], met[2]
        else:  # no boundary of the chunk is one of the text's: the stretch goes on, encoded anew
            cur, skip, emitted = Chunk(window, w_ids, (), (), encode), 0, 0
            cur._all = list(zip(w_ends, w_counts))
    return out + list(cur.ids[skip:])


def chunk_table(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, n, pos, chunk)`` of all texts that are not empty, whole; ``n`` is the text's number of chunks."""
    kind = docs.schema[key].dataType
    schema = T.StructType([T.StructField(key, kind), T.StructField("n", T.IntegerType()), T.StructField("pos", T.IntegerType()), T.StructField("chunk", T.StringType())])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            take: list[int] = []
            count: list[int] = []
            pos: list[int] = []
            chunk: list[str] = []
            for i, x in enumerate(b.column(1).to_pylist()):
                at = 0
                ends = cuts(x)
                for p, e in enumerate(ends):
                    take.append(i)
                    count.append(len(ends))
                    pos.append(p)
                    chunk.append(x[at:e])
                    at = e
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(take, pa.int32())), pa.array(count, pa.int32()), pa.array(pos, pa.int32()), pa.array(chunk, pa.string())], schema=arrow)

    return docs.where(F.length(text) > 0).select(key, text).mapInArrow(run, schema)


#: Word boundaries kept of each end of a chunk.
KEPT = 8


def encode_chunks(chunks: DataFrame, folder: str) -> DataFrame:
    """``(chunk, ids, head, tail)`` of distinct chunks; ``head`` and ``tail`` hold ends and counts of the first
    and last words, by turns, and are empty for chunks that are mostly whole texts."""
    numbers = T.ArrayType(T.IntegerType())
    schema = T.StructType([T.StructField("chunk", T.StringType()), *[T.StructField(c, numbers) for c in ("ids", "head", "tail")]])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(folder)
        for b in batches:
            texts = b.column(0).to_pylist()
            short = iter([e.ids for s in slices([x for x in texts if len(x) < LEAST]) for e in t.encode_batch_fast(s, add_special_tokens=False)])
            ids, head, tail = [], [], []
            for x in texts:
                if len(x) < LEAST:
                    ids.append(next(short))
                    head.append([])
                    tail.append([])
                    continue
                i, ends, counts = boundaries(x, t)
                ids.append(i)
                marks = [v for m in zip(ends, counts) for v in m]
                head.append(marks[: 2 * KEPT])
                tail.append(marks[-2 * KEPT :])
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, arrow.field(1).type) for c in (ids, head, tail)]], schema=arrow)

    return chunks.select("chunk").mapInArrow(run, schema)


def encode_corpus(docs: DataFrame, key: str, text: str, scratch: Scratch, folder: str = TOKENIZERS, salts: int = 16) -> DataFrame:
    """``(key, ids)``: the ids of every text, without special tokens; empty and null texts give an empty list.

    ``key`` must be unique and not null. Chunks are told apart by a 128-bit hash and their length.
    Copies of a chunk are combined before they are shuffled; of chunks that occur very often, at most
    a thousand by their share of all rows, the encoding is spread over ``salts`` partitions.
    """
    hashed = lambda df: df.withColumn("h", F.concat(F.md5("chunk"), F.length("chunk").cast("string")))
    pieces = hashed(chunk_table(docs, key, text))
    encoded = scratch.write(hashed(encode_chunks(pieces.select("chunk").distinct(), folder)), "encoded")
    pieces = scratch.write(pieces.drop("chunk"), "places")

    hot = F.broadcast(scratch.write(hot_keys(pieces, "h").withColumnRenamed("h", "__hot"), "hot"))
    salted = lambda df: df.join(hot, F.col("h") == F.col("__hot"), "left")
    refs = salted(pieces).withColumn("salt", F.when(F.col("__hot").isNull(), 0).otherwise(F.pmod(F.xxhash64(key), F.lit(salts)))).drop("__hot")
    spread = salted(encoded).withColumn("salt", F.explode(F.when(F.col("__hot").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(salts - 1)))))
    spread = spread.select(F.col("h").alias("__h"), F.col("salt").alias("__salt"), "chunk", "ids", "head", "tail")
    placed = refs.join(spread, (F.col("h") == F.col("__h")) & (F.col("salt") == F.col("__salt"))).select(key, "n", "pos", "chunk", "ids", "head", "tail")

    by_doc = placed.where("n > 1").groupBy(key).agg(F.sort_array(F.collect_list(F.struct("pos", "chunk", "ids", "head", "tail"))).alias("parts"))
    kind = docs.schema[key].dataType
    schema = T.StructType([T.StructField(key, kind), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(folder)
        encode = lambda x: boundaries(x, t)
        pairs = lambda m: list(zip(m[::2], m[1::2]))
        for b in batches:
            ids = [join_chunks([Chunk(p["chunk"], p["ids"], pairs(p["head"]), pairs(p["tail"]), encode) for p in parts.as_py()], encode) for parts in b.column(1)]  # one text at a time
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, arrow.field(1).type)], schema=arrow)

    single = placed.where("n = 1").select(key, "ids")
    joined = by_doc.mapInArrow(run, schema)
    empty = docs.where(F.coalesce(F.length(text), F.lit(0)) == 0).select(key, F.array().cast("array<int>").alias("ids"))
    return single.unionByName(joined).unionByName(empty)
