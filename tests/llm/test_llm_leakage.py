import random

import numpy as np

from tickloom.llm.leakage import _AT, Matching, _Block, _in_order, _Passages, alike, build_index, leaks, words

RNG = random.Random(8)
VOCABULARY = ["".join(RNG.choice("bdfgklmprst") + RNG.choice("aeiou") for _ in range(3)) for _ in range(300)]


def passage(n, seed):
    rng = random.Random(seed)
    return [rng.choice(VOCABULARY) for _ in range(n)]


def lines(tokens, width=6):
    return "\n".join(" ".join(tokens[k : k + width]) for k in range(0, len(tokens), width))


def found(spark, texts, items, matching=Matching()):
    docs = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "id bigint, body string, terms int")
    tests = spark.createDataFrame(items, "item bigint, text string")
    return {(r.doc, r.item) for r in leaks(docs, "id", "body", tests, "item", "text", matching).collect()}


def misread(tokens, seed):
    rng = random.Random(seed)
    swap = {"o": "0", "s": "5", "l": "1", "e": "c", "r": "v", "t": "f", "i": "j", "a": "o", "d": "cl", "m": "rn", "g": "q"}
    return ["".join(swap.get(c, c) if rng.random() < 0.1 else c for c in w) for w in tokens]


def test_words_are_brought_to_one_form():
    assert words("Har-\nbour") == words("harbour") == words("ＨАRBOUR!") == ["harbour"]
    assert words("") == [] and alike("harbour") == alike("hav8our") and [*map(alike, words("the barn"))] == [*map(alike, words("fhe bam"))]


def test_leaks_through_dirt(spark):
    p, q = passage(80, 1), passage(60, 2)
    noise = lambda s, n=200: passage(n, s)
    other = noise(40, 80)
    across = [w for k in range(0, 80, 4) for w in (*p[k : k + 4], *other[k : k + 4])]
    texts = [
        lines(noise(10) + p + noise(11)),  # whole
        lines(noise(12) + p[:48] + noise(13)),  # six tenths
        lines(noise(14) + p[:24] + noise(15)),  # three tenths
        lines(p[:22] + noise(16, 150) + p[40:64]),  # two pieces
        lines(noise(17) + misread(p, 5) + noise(18)),
        lines(across),  # read across columns
        lines(noise(19, 4000)),
        lines(random.Random(3).sample(p, 80)),  # the words, but not their order
        "",
        None,
        lines(q),
        lines(q),
        "word " * 300_000 + lines(q),
    ]
    items = [(1, " ".join(p)), (2, " ".join(p)), (3, " ".join(q).upper()), (4, None), (5, ""), (6, "one two"), (None, " ".join(p))]
    want = {(d, i) for d in (0, 1, 3, 4, 5) for i in (1, 2)} | {(d, 3) for d in (10, 11, 12)}
    assert found(spark, texts, items) == want
    assert found(spark, texts, items, Matching(most=100)) == want  # in blocks of items


def test_many_copies_and_standing_notices(spark):
    p, notice = passage(60, 31), passage(14, 32)
    q = notice + passage(50, 33)
    third = [lines(p[:22] + passage(30, 40) + p[27:50])] * 40  # two pieces, in a third of all documents
    noted = [lines(passage(30, 100 + k) + notice) for k in range(75)]
    partly = [lines(q[20:n] + passage(60, 34) + notice) for n in (37, 38, 40)]  # a piece of the passage, and a notice that many have
    texts = [*third, *noted, *partly]
    assert found(spark, texts, [(1, " ".join(p)), (2, " ".join(q))]) == {*((k, 1) for k in range(40)), (116, 2), (117, 2)}  # 32 and 34 of 64 words


def test_half_is_enough_and_less_is_not(spark):
    p = passage(100, 61)
    noise = lambda s, n=120: passage(n, 1000 + s)
    one = [lines(noise(n) + p[20 : 20 + n] + noise(n + 200)) for n in (40, 45, 48, 50, 52)]
    two = [lines(p[60 : 60 + n - 20] + noise(n + 400) + p[10:30]) for n in (40, 45, 48, 50, 52)]
    assert found(spark, one + two, [(1, " ".join(p))]) == {(k, 1) for k in (3, 4, 8, 9)}


def test_passages_of_few_words(spark):
    texts = ["one more thing: the grey heron waded off at dusk", "a grey heron", "heron grey the waded", "dusk", "the grey heron flew"]
    items = [(1, "The grey heron waded"), (2, "dusk"), (3, "the grey heron waded off")]
    assert found(spark, texts, items) == {(0, 1), (0, 2), (0, 3), (1, 1), (3, 2), (4, 1), (4, 3)}


def test_words_like_others_are_not_the_words(spark):
    page = "the bat at the tax on the rug of the ban bid at naan and fat"
    item = "the hat of the fox on the rug at the bar hid at noon and eat"
    assert [*map(alike, words("hat fox hid noon"))] == [*map(alike, words("bat tax bid naan"))]
    assert found(spark, [page, item], [(1, "hat fox hid noon hat hid fox noon"), (2, item)]) == {(1, 2)}
    p = passage(60, 71)
    assert found(spark, [lines(misread(p, 7))], [(1, " ".join(p))]) == {(0, 1)}
    every = [w.translate(str.maketrans("aeo", "oca")) for w in p]  # no word is right
    assert found(spark, [lines(every)], [(1, " ".join(p))]) == set()


def test_copies_do_not_make_their_own_leak_common(spark):
    p, q = passage(70, 51), passage(60, 52)
    apart = [lines(p[2:21] + passage(100, 53) + p[40:59])] * 40  # two pieces of 19 words, far apart, in most documents
    against = [lines(q[40:59] + passage(100, 54) + q[2:21])] * 25  # the later one first
    once = lines(passage(30, 55) + p[2:21] + passage(90, 56) + p[40:59])
    texts = [*apart, *against, once, *[lines(passage(100, 200 + k)) for k in range(14)]]
    assert found(spark, texts, [(1, " ".join(p)), (2, " ".join(q))]) == {*((k, 1) for k in range(40)), *((k, 2) for k in range(40, 65)), (65, 1)}


def test_lists_are_intersected_from_the_rarest_term_on(spark):
    rng = random.Random(6)
    few = VOCABULARY[:12]
    passages = _Passages([(k, [rng.choice(few) for _ in range(40)]) for k in range(5)], 3)
    [(distinct, first, of, place)] = passages.phrases
    assert all((passages.ids[of[i]][place[i] : place[i] + 3] == distinct[k]).all() for k in range(len(distinct)) for i in range(first[k], first[k + 1]))
    assert first[-1] == 5 * 38
    texts = [" ".join(rng.choice(few + ["other"]) for _ in range(n)) for n in (0, 1, 2, 3, 400, 90)]
    df = spark.createDataFrame([(10 + k, t, 1) for k, t in enumerate(texts)], "id bigint, body string, ids int").coalesce(1)
    rows = build_index(df, "id", "body", 300).collect()  # several blocks
    assert len(rows) > 1 and sum((list(r.ids) for r in rows), []) == [10, 11, 12, 13, 14, 15]
    frequency = np.array([rng.randrange(100) for _ in passages.terms])
    want = {(10 + k, i, tuple(passages.terms.get(alike(w), -1) for w in t.split()[i : i + 3])) for k, t in enumerate(texts) for i in range(len(t.split()) - 2)}
    known = {tuple(d) for d in distinct.tolist()}
    for order in (np.argsort(frequency[distinct], axis=1), np.argsort(-frequency[distinct], axis=1)):
        got = set()
        for r in rows:
            which, where = _Block(list(r.terms), bytes(r.first), bytes(r.pages), bytes(r.positions), passages).phrases(distinct, order)
            got |= {(r.ids[w >> _AT], int(w & (1 << _AT) - 1), tuple(distinct[k].tolist())) for k, w in zip(which.tolist(), where.tolist())}
        assert got == {x for x in want if x[2] in known}


def test_most_in_order():
    assert _in_order([]) == [] and _in_order([[], []]) == [] and _in_order([[5], [3], [7]]) in ([0, 2], [1, 2])
    assert _in_order([[9, 1], [2, 8], [], [3]]) == [0, 1, 3] and _in_order([[4, 4], [4]]) in ([0], [1])


def test_empty_tables(spark):
    p = " ".join(passage(50, 9))
    assert found(spark, [], [(1, p)]) == set() and found(spark, [p], []) == set()
    assert found(spark, [p, p], [(1, p)]) == {(0, 1), (1, 1)}
    unnamed = spark.createDataFrame([(None, p)], "id bigint, body string")
    tests = spark.createDataFrame([(1, p)], "item bigint, text string")
    assert [(r.doc, r.item) for r in leaks(unnamed, "id", "body", tests, "item", "text").collect()] == [(None, 1)]
