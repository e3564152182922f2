import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from loomgraph.llm import leakage as L


def brute(docs, items, n):
    out = set()
    for d, text in docs:
        w = L.words(text)
        grams = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
        for k, t in items:
            v = L.words(t)
            if any(tuple(v[i : i + n]) in grams for i in range(len(v) - n + 1)):
                out.add((d, k))
    return out


DOC, ITEM = "doc_id long, text string, item_id long, covered_words int", "item_id long, text string, doc_id long, suite string"


def frames(spark, docs, items):
    return spark.createDataFrame([(*d, 1, 2) for d in docs], DOC), spark.createDataFrame([(*i, 9, "s") for i in items], ITEM)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=12), min_size=1, max_size=4), st.lists(st.sampled_from("abcd"), max_size=40), st.integers(1, 4))
def test_automaton_equals_brute_force(items, doc, n):
    a = L.Automaton([(i, t) for i, t in enumerate(items) if len(t) >= n], n)
    got = {item for _, _, e in a.hits(doc) for item in a.items[e]}
    assert got == {i for i, t in enumerate(items) if any(doc[x : x + n] == t[y : y + n] for x in range(len(doc) - n + 1) for y in range(len(t) - n + 1))}


def test_longest_matching_length():
    a = L.Automaton([(1, list("abcde")), (2, list("zcdey"))], 2)
    assert [n for _, n, _ in a.hits(list("xabcdey"))] == [2, 3, 4, 5, 4]


def test_leaks_and_report(spark):
    rnd = random.Random(5)
    vocab = [f"w{i}" for i in range(30)]
    items = [(i, " ".join(rnd.choices(vocab, k=30))) for i in range(6)] + [(6, "short"), (7, None), (8, items_dup := " ".join(vocab)), (9, items_dup)]
    docs = []
    for i in range(40):
        w = rnd.choices(vocab, k=20)
        if i % 3 == 0:
            src = L.words(items[i % 6][1])
            w[5:5] = src[i % 10 : i % 10 + rnd.randrange(8, 16)]
        docs.append((i, rnd.choice([", ", " - ", "\n", " «» "]).join(x.upper() if rnd.random() < 0.5 else x for x in w)))
    docs += [(100, None), (101, ""), (102, items_dup), (102, items_dup), (103, items_dup * 400)]
    d, t = frames(spark, docs, items)
    got = {(r.doc_id, r.item_id) for r in L.leaks(d, t).collect()}
    assert got == brute(docs, [(k, x) for k, x in items if x], 12)
    rep = {r.item_id: r.n_docs for r in L.item_report(L.leaks(d, t), t).collect()}
    assert rep[6] == 0 and rep[8] >= 1 and len(rep) == len(items)


def test_blocks_give_the_same(spark, monkeypatch):
    items = [(i, " ".join(f"q{i}x{j}" for j in range(14))) for i in range(5)]
    d, t = frames(spark, [(i, x) for i, x in items], items)
    monkeypatch.setattr(L, "MAX_ITEM_WORDS", 20)
    assert len(L.build(t)) == 5
    assert {(r.doc_id, r.item_id) for r in L.leaks(d, t).collect()} == {(i, i) for i in range(5)}


def test_remove_spans(spark):
    leak = " ".join(f"k{i}" for i in range(12))
    filler = " ".join(f"f{i}" for i in range(30))
    d, t = frames(spark, [(1, f"{filler} {leak.upper()}! end"), (2, leak), (3, "clean text"), (4, None)], [(1, leak)])
    got = {r.doc_id: r for r in L.remove_spans(d, t).collect()}
    assert re.sub(r"\s+", " ", got[1].text) == f"{filler} ! end" and got[1].removed_words == 12
    assert got[2].dropped and got[2].text is None and got[3].text == "clean text" and got[4].text is None


def test_empty(spark):
    d, t = frames(spark, [], [])
    assert L.leaks(d, t).count() == 0 and L.item_report(L.leaks(d, t), t).count() == 0
