"""Encoding, packing and splitting: exact round trips and brute force, with odd texts."""

import random

import pytest
from pyspark.sql import functions as F

from binstrata.llm import encode, packing, splitting
from binstrata.llm.tokens import token_counts, tokenizer

ODD = [
    None, "", " ", "\t\n  ", "a", "it's they're we'll I'd 've", "don't'", "'" * 60, "日本語テキスト。次の文。" * 30, "x" * 5000, "a   b" * 400, " " * 3000,
    "<|endoftext|> plain <|startoftext|>", "é́‍👩‍👩‍👧 emoji", "퟿ private", "\x00\x01 control \x7f", "line\r\n\r\nline\n\n\nend", "1234567890" * 200, "Straße groß ẞ ſ" * 50,
    "word " * 3000, "The quick brown fox. " * 200, "<td>x</td>" * 300, "xxxxxxxx'" * 90 + "'" * 40,
]


def ids_of(text):
    return tokenizer().encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("least,greatest,bits", [(1, 3, 1), (2, 9, 2), (16, 40, 3), (64, 200, 5), (256, 4096, 9)])
def test_joined_chunks_give_the_ids_of_the_whole(least, greatest, bits):
    t = tokenizer()
    enc = lambda x: encode.boundaries(x, t)
    rng = random.Random(1)
    texts = [x for x in ODD if x] + ["".join(rng.choice(["a", "b ", "  ", "'s", "'", "re", "\n", "1", "é", "日", ".", "ll"]) for _ in range(rng.randrange(1, 300))) for _ in range(60)]
    for x in texts:
        if least < 16 and len(x) > 1500:
            x = x[:1500]
        at, chunks = 0, []
        for e in encode.cuts(x, least, greatest, bits):
            chunks.append(x[at:e])
            at = e
        assert "".join(chunks) == x
        assert all(least <= len(c) <= greatest or k == len(chunks) - 1 for k, c in enumerate(chunks)) or len(chunks) == 1
        for kept in (0, 1, 2, 8):
            made = []
            for c in chunks:
                i, ends, counts = enc(c)
                marks = list(zip(ends, counts))
                made.append(encode.Chunk(c, i, marks[:kept], marks[len(marks) - min(kept, len(marks)) :], enc))
            assert encode.join_chunks(made, enc) == ids_of(x), (kept, x[:60])


def test_cuts_depend_on_content_alone():
    rng = random.Random(2)
    shared = "".join(rng.choice("abcdefgh ") for _ in range(20_000))
    a, b = "prefix " * 3 + shared, "another start, longer than that " * 9 + shared
    pieces = lambda x: {x[s:e] for s, e in zip([0, *encode.cuts(x)], encode.cuts(x))}
    assert len(pieces(a) & pieces(b)) > 0.8 * len(pieces(a))


def test_corpus_ids(spark, scratch):
    base = [x for x in ODD if x is None or "퟿" not in x]
    texts = base + base[:9] + ["hot copy of one text"] * 300 + ["The quick brown fox. " * 200 + str(k) for k in range(5)]
    docs = spark.createDataFrame([(k, x, "clash", 1) for k, x in enumerate(texts)], "doc_id bigint, text string, h string, n int").repartition(3)
    got = {r.doc_id: list(r.ids) for r in encode.encode_corpus(docs, "doc_id", "text", scratch).collect()}
    assert got == {k: ids_of(x) for k, x in enumerate(texts)}
    assert encode.encode_corpus(docs.where("false"), "doc_id", "text", scratch).count() == 0


def test_counts(spark):
    docs = spark.createDataFrame([(k, x, None) for k, x in enumerate(ODD)], "doc_id bigint, text string, __x string")
    got = {r.doc_id: r.n_tokens for r in token_counts(docs).collect()}
    assert got == {k: len(ids_of(x)) for k, x in enumerate(ODD)}


def test_packer_is_best_fit_with_bounded_space():
    rng = random.Random(3)
    for capacity, bins in ((50, 4), (2048, 64), (10, 1)):
        p = packing.Packer(capacity, bins)
        used, open_ = {}, {}
        for _ in range(3000):
            s = rng.choice([0, capacity, rng.randrange(capacity + 1), rng.randrange(capacity // 3 + 1)])
            fits = [f for f in open_.values() if f >= s]
            full = min(open_.values()) if len(open_) == bins else None
            b = p.place(s)
            if fits:
                assert open_[b] == min(fits)
            else:
                assert b not in used
                if full is not None:
                    gone = [k for k, f in open_.items() if f == full]
                    left = {k for x in p.free.values() for k in x}
                    closed = [k for k in gone if k not in left]
                    assert len(closed) == 1
                    del open_[closed[0]]
                open_[b] = capacity
            used[b] = used.get(b, 0) + s
            open_[b] -= s
            if open_[b] == 0:
                del open_[b]
            assert used[b] <= capacity and len(open_) <= bins
    with pytest.raises(ValueError):
        packing.Packer(10).place(11)


def test_packing_of_a_table(spark):
    rng = random.Random(4)
    sizes = [rng.choice([0, 5, 2048, 2049, 4096, 5000, rng.randrange(2049)]) for _ in range(2000)] + [None]
    df = spark.createDataFrame([(k, s, "x") for k, s in enumerate(sizes)], "doc_id bigint, n_tokens int, container string")
    got = packing.pack(df, "doc_id", "n_tokens", partitions=3).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append((r.piece, r.n))
    assert all(sum(n for _, n in by[k]) == (s or 0) and [p for p, _ in sorted(by[k])] == list(range(len(by[k]))) for k, s in enumerate(sizes))
    assert all(len(by[k]) == 1 or s > 2048 for k, s in enumerate(sizes))
    fill = {}
    for r in got:
        fill[r.container] = fill.get(r.container, 0) + r.n
    assert max(fill.values()) <= 2048
    assert sum(fill.values()) / (2048 * len(fill)) > 0.9
    again = packing.pack(df.repartition(5), "doc_id", "n_tokens", partitions=3).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    assert packing.pack(df.where("false"), "doc_id", "n_tokens").count() == 0


def spans(x):
    return tokenizer().encode(x, add_special_tokens=False).offsets


@pytest.mark.parametrize("limit,overlap", [(512, 64), (40, 8), (16, 0), (8, 4)])
def test_pieces_fit_cover_and_overlap(limit, overlap):
    for x in ODD:
        if not x or "퟿" in x:
            continue
        x = x if limit > 100 else x[:1200]
        ps = splitting.split(x, spans, limit, overlap)
        assert ps[0][0] == 0 and ps[-1][1] == len(x)
        for s, e, n, _ in ps:
            assert n == len(spans(x[s:e])) <= limit or e - s == 1
        for p, q in zip(ps, ps[1:]):
            assert p[0] < q[0] <= p[1] < q[1]
            assert len(spans(x[q[0] : p[1]])) <= overlap


def test_cuts_prefer_natural_boundaries_and_deep_valleys():
    a, b = "cats purr and sleep on warm mats all day", "stocks fell while bond yields rose in trading"
    text = ". ".join([a] * 14) + ". " + ". ".join([b] * 14) + "."
    turn = text.index("stocks")
    valley = splitting.depths(text, sorted(splitting.boundaries(text)))
    assert max(valley, key=valley.get) == turn
    ps = splitting.split(text, spans, 200, 0)
    assert all(k >= splitting.SENTENCE for _, _, _, k in ps) and turn in {e for _, e, _, _ in ps}
    with pytest.raises(ValueError):
        splitting.split(text, spans, 10, 6)


def test_splitting_of_a_table(spark):
    docs = spark.createDataFrame([(k, x, 0) for k, x in enumerate(ODD)], "doc_id bigint, text string, start int")
    got = splitting.split_documents(docs, "doc_id", "text").collect()
    assert {r.doc_id for r in got} == {k for k, x in enumerate(ODD) if len(ids_of(x)) > 512}
    assert all(r.text == ODD[r.doc_id][r.start : r.end] and r.n_tokens <= 512 for r in got)
    assert splitting.split_documents(docs.where("false"), "doc_id", "text").count() == 0


def test_queries_agree_with_plain_encoding(spark):
    import os

    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no test data")
    from binstrata.llm import queries as q

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    n = {k: len(ids_of(x)) for k, x in texts.items()}
    ids = q.p7_ids(spark, d).collect()
    assert {r.doc_id: list(r.ids) for r in ids} == {k: ids_of(x) for k, x in texts.items()} and len(ids) == len(texts)
    assert sorted(r.doc_id for r in q.p8_found(spark, d).collect()) == sorted(k for k in n if n[k] > 2048)
    assert sorted(r.doc_id for r in q.p9_found(spark, d).collect()) == sorted(k for k in n if n[k] > 512)
    packed = q.p8_packed(spark, d).groupBy("doc_id").agg(F.sum("n").alias("n")).collect()
    assert {r.doc_id: r.n for r in packed} == n
