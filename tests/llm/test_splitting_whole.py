"""Every place of a window and every overlap is tried, and words are found in any script."""

from binstrata.llm import splitting


def spans(x):
    return [(k, k + 1) for k in range(len(x))]


def test_all_places_are_tried_before_a_cut_inside_a_word():
    text = "ab " * 100
    measure = lambda x: len(x) + 15  # noqa: E731  alone, a piece has 15 tokens more: the five last places do not fit
    first = splitting.split(text, spans, 60, 0, measure=measure)[0]
    assert first[3] == splitting.WORD and first[1] % 3 == 0 and first[2] <= 60


def test_all_overlaps_are_tried():
    text = "ab " * 100
    measure = lambda x: len(x) + 15
    ps = splitting.split(text, spans, 90, 40, measure=measure)
    assert all(0 < p[1] - q[0] <= 25 for p, q in zip(ps, ps[1:]))
    assert all(q[0] % 3 == 0 for q in ps)


def test_an_overlap_falls_back_to_a_token():
    ps = splitting.split("x" * 300, spans, 60, 10)
    assert all(p[1] - q[0] == 10 for p, q in zip(ps, ps[1:]))


def test_a_turn_of_topic_is_found_in_japanese():
    # no clause comes twice
    text = "".join(f"{n}匹の猫は暖かい畳の上で眠る。" for n in "一二三四五六七八九") + "".join(f"株価は{n}円急落し債券が上昇した。" for n in "一二三四五六七八九")
    turn = text.index("株価")
    valley = splitting.depths(text, sorted(splitting.boundaries(text)))
    assert max(valley, key=valley.get) == turn


def test_terms():
    assert splitting.terms("The Cat") == [(0, "the"), (4, "cat")]
    assert [w for _, w in splitting.terms("日本語")] == ["日本", "本語"]
    x, y = "a" * 30 + "b", "a" * 30 + "c"
    assert [w for _, w in splitting.terms(f"{x} {y}")] == [x, y]
    assert len(splitting.terms("ab" * 100)) == 197


def test_the_deepest_valley_decides_before_the_kind_of_boundary():
    cats = "The cat sleeps on the warm mat. " * 12
    text = cats + "Bond prices fell after rates rose. " * 6 + "\n\n" + "Bond prices fell after rates rose. " * 12
    turn, paragraph = len(cats), text.index("\n\n") + 2
    limit = paragraph + 10
    valley = splitting.depths(text, sorted(splitting.boundaries(text)))
    assert limit // 2 < turn < paragraph < limit and valley[turn] > valley[paragraph]
    assert splitting.split(text, spans, limit, 0)[0][1] == turn


def test_words_are_taken_only_where_no_sentence_ends_in_the_window():
    text = "aa bb cc. " + "dd ee ff gg hh ii jj kk ll " * 20
    kinds = [k for *_, k in splitting.split(text, spans, 60, 0)]
    assert set(kinds[:-1]) == {splitting.WORD}
    text = "aa bb cc, dd ee ff. " * 20
    assert {k for *_, k in splitting.split(text, spans, 60, 0)[:-1]} == {splitting.SENTENCE}


def test_a_shorter_natural_place_comes_before_a_cut_inside_a_word():
    text = "ab " * 3 + "x" * 200
    first = splitting.split(text, spans, 60, 0)[0]
    assert first[1] == 9 and first[3] == splitting.WORD


def test_no_cut_inside_a_word_where_a_natural_place_fits():
    import random

    rng = random.Random(5)
    for _ in range(60):
        text = "".join("x" * rng.choice([1, 3, 8, 30, 90]) + rng.choice([" ", ". ", "\n", "\n\n", ", "]) for _ in range(60))
        limit, lap = 50, rng.choice([0, 10, 25])
        places, pieces, prev = splitting.boundaries(text), splitting.split(text, spans, limit, lap), 0
        for s, e, n, k in pieces:
            assert n <= limit
            if k == splitting.TOKEN:
                assert not [p for p in places if max(prev, s) < p <= s + limit]
            prev = e
        for p, q in zip(pieces, pieces[1:]):
            assert q[0] <= p[1] and (not lap or q[0] < p[1] or p[1] - p[0] == 1)
