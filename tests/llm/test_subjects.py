import random

import numpy as np

from panelforge.llm import subjects as S

TOPICS = {
    "gardens": ["rose hedges", "garden beds", "compost heaps", "pruning shears"],
    "rivers": ["river floods", "tidal weirs", "salmon ladders", "ferry crossings"],
    "clocks": ["pendulum clocks", "escapement wheels", "tower chimes", "watch springs"],
}
UNSEEN = {"gardens": "orchard ladders", "rivers": "estuary dredgers", "clocks": "hourglass frames"}
FRAMES = ["We found that {} were repaired before the second visit.", "It is not obvious why {} were left out of the yearly report.", "This section deals with {} and briefly with {}.", "What remains open is the state of {} in autumn."]
NEUTRAL = ["Figures are preliminary and may change soon.", "Thanks to everyone for the careful reading.", "Page nine was printed upside down again."]


def _text(r, subjects, n, new=False):
    out = []
    for i in range(n):
        s = subjects[i % len(subjects)]
        pool = [*TOPICS[s], UNSEEN[s]] if new else TOPICS[s]
        out.append(r.choice(FRAMES).format(r.choice(pool), r.choice(pool)))
        if r.random() < 0.3:
            out.append(r.choice(NEUTRAL))
    return " ".join(out)


def _corpus(n=240):
    r = random.Random(0)
    docs, truth = [], {}
    for d in range(n):
        mine = r.sample(list(TOPICS), r.choice([1, 1, 2]))
        docs.append((d, _text(r, mine, 8, new=True), "clash"))
        truth[d] = set(mine)
    return docs, truth


def test_held_out_accuracy_and_edge_cases(spark):
    r = random.Random(9)
    examples = [(i, s, _text(r, [s], 5)) for i, s in enumerate(list(TOPICS) * 12)] + [(900, None, "x"), (901, "gardens", None), (902, "other", "some words of no known subject")]
    docs, truth = _corpus()
    extra = [(1000, None, ""), (1001, "", ""), (1002, " \n ", ""), (1003, " ".join(NEUTRAL), ""), (1004, "| a | b |\n{x = 1}", ""), (1005, docs[0][1] * 400, "")]
    df = spark.createDataFrame(docs + extra, "doc_id bigint, text string, subject string")
    ef = spark.createDataFrame(examples, "example_id bigint, subject string, text string")
    found = {}
    for row in S.assign(df, ef, sorted(TOPICS)).collect():
        found.setdefault(row["doc_id"], set()).add(row["subject"])
    right = sum(found.get(d) == t for d, t in truth.items())
    assert right >= 0.95 * len(truth)
    assert not any(found.get(d) for d in (1000, 1001, 1002, 1004))
    assert found[1005] == truth[0]


def test_no_documents_or_examples(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    ef = spark.createDataFrame([], "example_id bigint, subject string, text string")
    assert S.assign(df, ef, ["a", "b"]).collect() == []


def test_sentences_leave_out_code_and_tables():
    assert S.sentences("| key | n |\nx = {1}\nThis line here is prose enough. Too short.") == [["this", "line", "here", "is", "prose", "enough"]]
    assert S.sentences(None) == []


def test_shares():
    p = np.array([[0.9, 0.1], [0.9, 0.1], [0.9, 0.1], [0.1, 0.8], [0.1, 0.2]])
    assert S.subjects_of(p) == [0]
    assert S.subjects_of(p[1:]) == [0, 1] and S.subjects_of(p[4:]) == [] and S.subjects_of(p[:0]) == []


def test_prose_with_notes_links_and_markup_counts():
    note = "The river floods were severe in the whole valley [see note 4]. Salmon ladders were repaired, see https://x.org/a_b?c=1 for the plan."
    assert [" ".join(x) for x in S.sentences(note)] == ["the river floods were severe in the whole valley", "salmon ladders were repaired see for the plan"]
    assert [" ".join(x) for x in S.sentences(r"Old \emph{tidal} weirs were \textbf{closed} again.")] == ["old tidal weirs were closed again"]
    assert [" ".join(x) for x in S.sentences("> | the ferry_id_9 ferry crossings were closed |\nσ = λ·x while tower chimes were silent")] == ["the ferry crossings were closed", "while tower chimes were silent"]
    for code in ('{"alpha": 26, "beta": "gamma", "delta": [1, 2], "omega": true}', "total = count(alpha) + other(beta)", "alpha | beta | gamma | delta", "for (item = start; item < final;) total[item] = value;"):
        assert S.sentences(code) == []


def test_a_sentence_on_two_subjects_counts_for_both():
    p = np.array([[0.9, 0.8, 0.0], [0.9, 0.7, 0.1], [0.9, 0.1, 0.1]])
    assert S.subjects_of(p) == [0, 1]


def test_examples_are_bounded_per_subject_whatever_their_order(spark):
    rows = [(i, "gardens", f"text {i}") for i in range(50)] + [(1000 + i, "rivers", f"text {i}") for i in range(3)] + [(1, None, "x"), (2, "rivers", None)]
    frame = spark.createDataFrame(rows, "example_id bigint, subject string, text string")
    got = [tuple(r) for r in S.bounded(frame, 10).select("subject", "example_id").collect()]
    assert sorted(s for s, _ in got) == ["gardens"] * 10 + ["rivers"] * 3
    assert sorted(got) == sorted(tuple(r) for r in S.bounded(frame.repartition(3), 10).select("subject", "example_id").collect())
