import math

import pytest
from pyspark.sql import functions as F

from loomgraph.llm import mixing as M

DOC = "doc_id long, text string, source string, tokens long, key string"


def docs(spark, spec):
    """spec: source -> number of texts; sizes vary."""
    rows, n = [], 0
    for source, k in spec.items():
        for i in range(k):
            n += 1
            rows.append((n, f"{source} text number {n} " + "word " * (i % 17), source, -1, "x"))
    return rows


def run(spark, rows, targets, **kw):
    t = spark.createDataFrame(targets, "source string, target_share double, max_repeats int")
    chosen, shares = M.mix(spark.createDataFrame(rows, DOC), t, **kw)
    return chosen.collect(), {r.source: r for r in shares.collect()}


def test_shares_and_caps(spark):
    rows = docs(spark, {"a": 400, "Big-One": 900, "big_one": 100, "small": 40, "other": 50})
    chosen, shares = run(spark, rows, [("a", 0.5, 1), ("BIG_ONE", 0.3, 2), ("small", 0.1, 3), ("absent", 0.1, 2)])
    assert set(shares) == {"a", "big_one", "small", "absent"}
    assert shares["absent"].actual_share == 0 and shares["absent"].feasible_share == 0
    for s in ("a", "big_one", "small"):
        assert abs(shares[s].actual_share - shares[s].feasible_share) < 0.01
        assert shares[s].most_repeats <= shares[s].max_repeats
    assert len({r.doc_id for r in chosen}) == len(chosen) and all(r.repeats >= 1 for r in chosen)
    # the size is the largest possible: some source is used up
    assert any(shares[s].mix_tokens >= 0.99 * shares[s].source_tokens * shares[s].max_repeats for s in ("a", "big_one", "small"))


def test_one_source_holds_nearly_all_and_seed(spark):
    rows = docs(spark, {"a": 1500, "b": 20})
    one = run(spark, rows, [("a", 0.5, 1), ("b", 0.5, 2)])
    two = run(spark, rows, [("a", 0.5, 1), ("b", 0.5, 2)])
    other = run(spark, rows, [("a", 0.5, 1), ("b", 0.5, 2)], seed=2)
    assert sorted(one[0]) == sorted(two[0]) and sorted(one[0]) != sorted(other[0])
    assert abs(one[1]["a"].actual_share - 0.5) < 0.02


def test_same_text_counts_once(spark):
    rows = [(1, "hello world", "a", 0, "k"), (2, "\ufeffhello world  \r\n", "a", 0, "k"), (3, "hello world", "b", 0, "k"), (4, None, "a", 0, "k"), (5, "", "a", 0, "k"), (6, "x y", None, 0, "k")]
    chosen, shares = run(spark, rows, [("a", 1.0, 1)])
    assert [(r.doc_id, r.repeats) for r in chosen] == [(1, 1)] and shares["a"].source_texts == 1


def test_inclusion_follows_weights(spark):
    rows = docs(spark, {"a": 600})
    texts = spark.createDataFrame(rows, DOC)
    weight = F.when(F.col("doc_id") % 2 == 0, 4.0).otherwise(1.0)
    n = {0: 0, 1: 0}
    for seed in range(4):
        chosen, _ = M.mix(texts, spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int"), total_tokens=900, seed=seed, weight=weight)
        for r in chosen.collect():
            n[r.doc_id % 2] += 1
    assert 3 < n[0] / n[1] < 5.5


def test_inclusion_frequencies_of_the_queries_weight(spark):
    """Over many seeds every class of equal texts is taken as often as its probability says."""
    rows = [(i, f"number {i:04d} " + "word " * (4 if i % 2 else 79), "a", -1, "x") for i in range(300)]
    texts, targets = spark.createDataFrame(rows, DOC), spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    tokens, taken = {}, {0: 0, 1: 0}
    for seed in range(6):
        chosen, shares = M.mix(texts, targets, total_tokens=4000, seed=seed, weight=M.size_weight())
        for r in chosen.collect():
            taken[r.doc_id % 2] += 1
            tokens[r.doc_id % 2] = r.tokens
    length = {0: len(rows[0][1]), 1: len(rows[1][1])}
    rate = 4000 / sum(150 * tokens[k] * length[k] ** 0.5 for k in (0, 1))
    for k in (0, 1):
        expected = 6 * 150 * rate * length[k] ** 0.5
        assert abs(taken[k] - expected) < 4 * expected**0.5, (k, taken[k], expected)


def test_given_size_and_whole_copies(spark):
    rows = docs(spark, {"a": 50, "b": 50})
    chosen, shares = run(spark, rows, [("a", 0.8, 9), ("b", 0.2, 9)], total_tokens=3000)
    assert math.isclose(sum(r.tokens * r.repeats for r in chosen), 3000, rel_tol=0.03)
    assert shares["a"].most_repeats >= 3


@pytest.mark.parametrize("targets", [[], [("a", None, 1), ("b", 0.0, 1), (None, 0.5, 1)]])
def test_empty(spark, targets):
    chosen, shares = run(spark, [], targets)
    assert chosen == [] and all(r.actual_share == 0 for r in shares.values())
