import random

import numpy as np

from panelforge.llm import leaks as L
from panelforge.llm.words import Hasher, grams, winnow, words

NAMES = ["Tarvel", "Ossim", "Quenlo", "Brakdu", "Fimolar", "Jestup", "Norwix", "Gelban", "Hurpo", "Zindal", "Merrow", "Calyx"]


def _passage(seed):
    r = random.Random(seed)
    return " ".join(f"{r.choice(NAMES)} {r.choice(NAMES)}{seed} counted {r.randrange(9999)} {r.choice(['amber', 'linen', 'copper'])} slips before {r.choice(NAMES)} left for house {r.randrange(99)}." for _ in range(7))


FILL = "the quarterly figures were revised once more and nobody asked for a longer version of the note "


def test_words_see_through_form():
    plain = words("The amber slips, 1234 of them, were re-counted")
    assert words("THE  <b>amber</b> slips,​ 1,234 of\nthem — were re-counted") == plain
    assert words("Тhе аmbеr ｓｌｉｐｓ, 1234 of them, were re-counted") == plain  # look-alike and wide letters
    assert words("The am­ber slips, 1234 of th-\nem, were re-counted") == plain
    assert words(None) == words("") == words(" \n") == []


def test_winnowing_keeps_a_fingerprint_of_every_window():
    g = grams(Hasher()([str(i % 17) for i in range(200)]), 4)
    kept = set(winnow(g, 3).tolist())
    assert all(kept & {i, i + 1, i + 2} for i in range(len(g) - 2))
    assert len(winnow(g[:0], 3)) == 0 and len(winnow(g[:2], 3)) == 1
    a, b = Hasher()(list("abcdefgh")), Hasher()(list("xxabcdefghyy"))
    assert set(grams(a, 4)) <= set(grams(b, 4))


def test_alike_words():
    assert L.alike("counted", "conted") and L.alike("counted", "cuonted") and L.alike("reconstitution", "recnstitutoin")
    assert not L.alike("amber", "ember2x") and not L.alike("1234", "1235") and not L.alike("cat", "cut")


def test_leaks_are_found_whole_in_part_and_altered(spark):
    own = {i: _passage(i) for i in range(1, 6)}
    heading = "Read the passage with care before you answer.\n\n"
    items = [(i, heading + p if i % 2 else p, "clash") for i, p in own.items()] + [(9, None, ""), (10, "", ""), (11, "one two", "")]
    w = own[2].split()
    altered = own[3].split()
    for k in range(4, len(altered), 11):
        altered[k] = altered[k][:2] + altered[k][3:] if len(altered[k]) > 5 else "changed"
    for k in range(9, len(altered) - 12, 17):
        del altered[k]
    docs = {
        1: (FILL + own[1] + FILL, {1}),
        2: (FILL + " ".join(w[10:45]) + FILL, {2}),
        3: (FILL + " ".join(altered).upper() + FILL, {3}),
        4: (FILL + " ".join(w[:18]) + FILL * 3 + " ".join(w[40:58]), {2}),
        5: (heading + FILL, set()),
        6: (FILL + " ".join(w[:9]) + FILL, set()),
        7: (_passage(77), set()),
        8: (None, set()),
        9: ("", set()),
        10: (FILL * 4000 + own[5] + FILL * 4000, {5}),
        11: (own[1] + own[4], {1, 4}),
    }
    rows = [(d, t, "x") for d, (t, _) in docs.items()] + [(12, docs[1][0], "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, item_id string")
    it = spark.createDataFrame(items, "item_id bigint, passage string, share string")
    want = {(d, i) for d, (_, found) in docs.items() for i in found} | {(12, 1)}
    for held in (L.BROADCAST_WORDS, 0):  # broadcast, or joined
        got = [(r["doc_id"], r["item_id"]) for r in L.leaks(df, it, held).collect()]
        assert set(got) == want and len(got) == len(want)
        assert L.leaks(df.limit(0), it, held).collect() == []
    assert L.leaks(df.limit(0), it).collect() == [] and L.leaks(df, it.limit(0)).collect() == []


def test_block_positions():
    b = L.Block([(1, "a b c d e".split()), (2, "b c d e f".split())])
    assert len(b.hashes) == 4 and (np.diff(b.hashes.astype(object)) >= 0).all()


def test_a_repeated_stretch_does_not_hide_a_second_one():
    item = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}{i}" for i in range(100)]
    for times in (1, 8, 40):
        doc: list[str] = []
        for k in range(times):
            doc += [f"{FILL.split()[j]}{k}" for j in range(6)] + item[:20]
        doc += ["and", "then", "again"] + item[60:75]
        block = L.Block([(7, item)])
        assert list(block.found(doc, Hasher()(doc))) == [(7, 0.35)]


def test_the_best_pair_is_the_best_of_all_pairs(monkeypatch):
    r = random.Random(5)
    for _ in range(60):
        covers = [set(range(a, a + r.randrange(8, 20))) for a in (r.randrange(80) for _ in range(r.randrange(1, 20)))]
        each = iter([[(i, y) for y in sorted(c)] for i, c in enumerate(covers)])
        monkeypatch.setattr(L, "extend", lambda doc, item, p, q, way: next(each) if way == 1 else [])
        got = L.leaked_words([], [], [(1000 + i, 1000) for i in range(len(covers))])
        assert got == max(len(a | b) for a in covers for b in covers)


def test_only_the_heading_of_a_suite_is_taken_off(spark):
    own = [_passage(i) for i in range(1, 5)]
    heading = "Read the passage with care before you answer."
    rows = [(1, "a", f"{heading}\r\n\r\n{own[0]}"), (2, "a", f"{heading}\n \n{own[1]}"), (3, "b", f"{own[2]}\n\n{own[3]}"), (4, None, "one paragraph only"), (5, "c", None), (6, "c", "title\n\n"), (7, "d", "same\n\nrest"), (8, "d", "same\n\nrest")]
    got = {r["item_id"]: r["passage"] for r in L.own_passages(spark.createDataFrame(rows, "item_id bigint, suite string, passage string")).collect()}
    assert got == {1: own[0], 2: own[1], 3: f"{own[2]}\n\n{own[3]}", 4: "one paragraph only", 6: "title", 7: "same\n\nrest", 8: "same\n\nrest"}


def test_a_first_paragraph_that_is_no_heading_leaks_as_well(spark):
    """Half of a passage of two paragraphs is reproduced, whichever half it is."""
    first, second = _passage(21), _passage(22)
    items = spark.createDataFrame([(1, "a", f"{first}\n\n{second}"), (2, "a", _passage(23))], "item_id bigint, suite string, passage string")
    df = spark.createDataFrame([(1, FILL + first), (2, FILL + second + FILL), (None, first)], "doc_id bigint, text string")
    for held in (L.BROADCAST_WORDS, 0):
        assert sorted((r["doc_id"], r["item_id"]) for r in L.leaks(df, items, held).collect()) == [(1, 1), (2, 1)]


def test_repeated_parts_leak(spark):
    """A passage of 48 words of which one part is repeated often, and a second part is there once."""
    item = [f"word{chr(97 + i // 26)}{chr(97 + i % 26)}{i}" for i in range(48)]
    for times in (7, 8, 30):
        text = " ".join(" ".join([*item[:9], f"and{k} so on it went for a while"]) for k in range(times)) + " then at last " + " ".join(item[30:38])
        df = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
        it = spark.createDataFrame([(5, " ".join(item))], "item_id bigint, passage string")
        for held in (L.BROADCAST_WORDS, 0):
            assert [(r["doc_id"], r["item_id"], round(r["share"], 3)) for r in L.leaks(df, it, held).collect()] == [(1, 5, 0.354)]
