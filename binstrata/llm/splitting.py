"""Splitting of long texts at natural boundaries, by lexical cohesion.

Around every boundary that a cut may use (paragraph, line, sentence, clause, word) two blocks of words
are compared; where their similarity has a valley, the topic changes. Within the window in which a
piece must end, the deepest valley decides among the ends of sentences, lines and paragraphs; only where
none of these fits, it decides among clauses and words. The next piece starts up to ``overlap`` tokens
before, at a boundary of its own.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from binstrata.llm.tokens import TOKENIZERS, tokenizer

LIMIT, OVERLAP, BLOCK = 512, 64, 20
#: Kinds of boundaries, the more natural the greater.
PARAGRAPH, LINE, SENTENCE, CLAUSE, WORD, TOKEN = 5, 4, 3, 2, 1, 0
_BREAK = re.compile(r"(?P<p>\n\s*\n\s*)|(?P<l>\n\s*)|(?P<s>[.!?。！？…]+[\"'”’)\]]*\s+|[。！？]+)|(?P<c>[,;:，、；：]\s*)|(?P<w>\s+)")
_WORD = re.compile(r"\w+")
#: Scripts that put no spaces between words: Thai to Myanmar, Khmer, kana, ideographs; and runs too long for a word.
_UNSPACED = re.compile(r"[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff]")
LONGEST, SCRIPT_GRAM, DUMP_GRAM = 40, 2, 4
#: Parts of a window are tried by whether they end a sentence at least.
NATURAL = SENTENCE


def boundaries(text: str) -> dict[int, int]:
    """Character positions after a natural break, with their kind."""
    out: dict[int, int] = {}
    kinds = {"p": PARAGRAPH, "l": LINE, "s": SENTENCE, "c": CLAUSE, "w": WORD}
    for m in _BREAK.finditer(text):
        if 0 < m.end() < len(text):
            out[m.end()] = kinds[m.lastgroup]
    return out


class _Block:
    """Counts of the words of a sliding block, with the sum of their squares."""

    def __init__(self, words: list[str]):
        self.n = Counter(words)
        self.squares = sum(x * x for x in self.n.values())

    def change(self, word: str, by: int) -> None:
        old = self.n[word]
        self.n[word] = old + by
        self.squares += (old + by) ** 2 - old * old


def terms(text: str) -> list[tuple[int, str]]:
    """The words of a text, in lower case, with their positions; where no spaces tell words apart, the
    character n-grams of a run instead."""
    out: list[tuple[int, str]] = []
    for m in _WORD.finditer(text):
        run = m.group()
        size = SCRIPT_GRAM if _UNSPACED.search(run) else DUMP_GRAM if len(run) > LONGEST else 0
        if size and len(run) > size:
            out += [(m.start() + i, run[i : i + size].lower()) for i in range(len(run) - size + 1)]
        else:
            out.append((m.start(), run.lower()))
    return out


def depths(text: str, at: list[int], block: int = BLOCK) -> dict[int, float]:
    """How deep the valley of similarity is at each position (ascending): the rise to the highest
    neighbour on either side, summed, of the cosine between the blocks of words (see :func:`terms`)
    before and after."""
    found = terms(text)
    starts, vocab = [s for s, _ in found], [w for _, w in found]
    left, right = _Block([]), _Block(vocab[:block])
    dot, k, sims = 0, 0, []

    def move(mine: _Block, other: _Block, word: str, by: int) -> int:
        mine.change(word, by)
        return by * other.n.get(word, 0)

    for p in at:
        while k < len(starts) and starts[k] < p:  # both blocks slide one word on
            w = vocab[k]
            dot += move(right, left, w, -1)
            if k + block < len(vocab):
                dot += move(right, left, vocab[k + block], 1)
            dot += move(left, right, w, 1)
            if k >= block:
                dot += move(left, right, vocab[k - block], -1)
            k += 1
        norm = math.sqrt(left.squares * right.squares)
        sims.append(dot / norm if norm else 0.0)
    # the highest value reached by climbing without a step down, from either side
    n = len(sims)
    climb_l, climb_r = sims[:], sims[:]
    for i in range(1, n):
        if sims[i - 1] >= sims[i]:
            climb_l[i] = climb_l[i - 1]
    for i in range(n - 2, -1, -1):
        if sims[i + 1] >= sims[i]:
            climb_r[i] = climb_r[i + 1]
    return {p: climb_l[i] + climb_r[i] - 2 * sims[i] for i, p in enumerate(at)}


def split(text: str, encode, limit: int = LIMIT, overlap: int = OVERLAP, block: int = BLOCK, measure=None, spans=None) -> list[tuple[int, int, int, int]]:
    """``(start, end, n_tokens, kind)`` of the pieces of a text, as character positions.

    ``encode(text)`` gives the character spans of its tokens, ``measure(text)`` their number, if that is
    cheaper; ``spans`` are those of the whole text, if known. A piece, encoded alone, has at most
    ``limit`` tokens; pieces cover the whole text in order, and a piece begins at most ``overlap``
    tokens before the end of the one before. A text within the limit is one piece; an empty one none.

    Places are judged by the tokens of the whole text; each piece and each overlap is then encoded
    alone, and where that gives too many tokens the next place is tried, through all of them: those of the
    window by valley, then the shorter ones, then tokens. So a piece ends within a word only where no
    natural place after its overlap fits. Ties of depth go to the more natural, then to the later place.
    """
    if not 0 <= overlap <= limit // 2:
        raise ValueError("the overlap may be half the limit at most")
    spans = encode(text) if spans is None else spans
    n = len(spans)
    if not text:
        return []
    if n <= limit:
        return [(0, len(text), n, PARAGRAPH)]
    kinds = boundaries(text)
    places = sorted(kinds)
    valley = depths(text, places, block)
    ends, starts = [e for _, e in spans], [s for s, _ in spans]
    out: list[tuple[int, int, int, int]] = []
    start, prev_end = 0, 0

    def count(a: int, b: int) -> int:
        return measure(text[a:b]) if measure else len(encode(text[a:b]))

    while True:
        first = bisect.bisect_left(starts, start)
        if n - first <= limit and (m := count(start, len(text))) <= limit:
            out.append((start, len(text), m, PARAGRAPH))
            return out
        low = max(prev_end, start) + 1
        near = max(low, ends[min(n - 1, first + limit // 2)])
        far = max(low, ends[min(n - 1, first + limit - 1)])
        choice = None
        inside = places[bisect.bisect_left(places, near) : bisect.bisect_right(places, far)]
        ranked = sorted(inside, key=lambda p: (kinds[p] >= NATURAL, valley[p], kinds[p], p), reverse=True)
        # a window without a place that fits: the last natural place before it, if there is one
        shorter = reversed(places[bisect.bisect_left(places, low) : bisect.bisect_left(places, near)])
        for p in chain(ranked, shorter):
            if (m := count(start, p)) <= limit:
                choice, kind = p, kinds[p]
                break
        room = limit
        while choice is None:  # no natural place fits: the last token that does
            at = max(low, ends[min(n - 1, max(first, first + room - 1))])
            m = count(start, at)
            if m <= limit or at == low:
                choice, kind = at, TOKEN
            else:
                room -= max(1, m - limit)
        out.append((start, choice, m, kind))
        prev_end = choice
        # overlap: from the most natural boundary within the last tokens of the piece, the earliest of its kind
        earliest = starts[max(0, bisect.bisect_left(ends, choice) - overlap + 1)] if overlap else choice
        options = places[bisect.bisect_left(places, max(earliest, start + 1)) : bisect.bisect_left(places, choice)] if overlap else []
        # if none fits, from the earliest token that does
        tokens = starts[bisect.bisect_left(starts, max(earliest, start + 1)) : bisect.bisect_left(starts, choice)] if overlap else []
        start = next((p for p in [*sorted(options, key=lambda p: (-kinds[p], p)), *tokens] if count(p, choice) <= overlap), choice)


def split_documents(docs: DataFrame, key: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP, folder: str = TOKENIZERS) -> DataFrame:
    """``(key, piece, start, end, n_tokens, kind, text)`` of every text of more than ``limit`` tokens.

    ``start`` and ``end`` are character positions, ``kind`` names the boundary at which a piece ends
    (5 paragraph or end of text, 4 line, 3 sentence, 2 clause, 1 word, 0 none). Null, empty and shorter
    texts give no rows. A text is split in one task, whatever its length; nothing is shuffled.
    """
    kind = docs.schema[key].dataType
    fields = [("piece", T.IntegerType()), ("start", T.IntegerType()), ("end", T.IntegerType()), ("n_tokens", T.IntegerType()), ("kind", T.IntegerType()), ("text", T.StringType())]
    schema = T.StructType([T.StructField(key, kind), *[T.StructField(a, b) for a, b in fields]])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(folder)
        encode = lambda x: t.encode(x, add_special_tokens=False).offsets
        measure = lambda x: len(t.encode_batch_fast([x], add_special_tokens=False)[0])
        for b in batches:
            rows: list[tuple] = []
            for i, x in enumerate(b.column(1).to_pylist()):
                if len(x.encode("utf-8", "replace")) <= limit:  # a token has at least one byte
                    continue
                if measure(x) <= limit:
                    continue
                rows += [(i, p, s, e, n, k, x[s:e]) for p, (s, e, n, k) in enumerate(split(x, encode, limit, overlap, measure=measure))]
            cols = list(zip(*rows)) if rows else [[] for _ in range(7)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(cols[0], pa.int32())), *[pa.array(c, f.type) for c, f in zip(cols[1:], list(arrow)[1:])]], schema=arrow
            )

    return docs.where(F.length(text) > 0).select(key, text).mapInArrow(run, schema)
