import random
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from loomgraph.operators import skew as S

REF = "target_id string, reference_type string, source_id string, n_rows long, id string"
SYM = "id string, type string, n_rows long"


def frames(spark, refs, syms):
    return spark.createDataFrame([(*r, 5, "x") for r in refs], REF), spark.createDataFrame([(*s, 5) for s in syms], SYM)


def test_states_equal_plain_join(spark):
    rnd = random.Random(1)
    refs = [(rnd.choice(["hot"] * 6 + ["a", "b", None]), rnd.choice(["CALLS", "calls", "CALLS-STATIC", "calls_static", None]), rnd.choice(["s1", "s2", None])) for _ in range(300)]
    syms = [("hot", "method"), ("hot", "method"), ("a", "class"), (None, "class"), ("hot", "class")]
    r, s = frames(spark, refs, syms)
    norm = lambda t: t.upper().replace("-", "_") if t else t
    got = {(x.target_id, x.reference_type): x for x in S.per_key(r, s, 0.2).collect()}
    n = Counter((t, norm(k)) for t, k, _ in refs)
    assert {k: x.n_rows for k, x in got.items()} == n
    for (t, k), x in got.items():
        assert x.n_sources == len({c for a, b, c in refs if (a, norm(b)) == (t, k) and c})
        stored = sum(1 for i, _ in syms if i == t and t is not None)
        assert (x.stored_rows, x.joined_rows) == (stored, stored * x.n_rows)
        assert x.is_heavy == (x.n_rows >= 0.2 * len(refs))
    want = Counter((ty, norm(k)) for t, k, _ in refs for i, ty in syms if i == t and t)
    assert {(x.target_type, x.reference_type): x.joined_rows for x in S.per_target_type(r, s).collect()} == want


def test_empty(spark):
    r, s = frames(spark, [], [])
    assert S.per_key(r, s).count() == 0 and S.per_target_type(r, s).count() == 0


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("abc"), st.sampled_from("xyz")), max_size=30))
def test_key_states_property(spark, pairs):
    df = spark.createDataFrame(pairs, "k string, m string")
    got = {r.k: (r.n_rows, r.n_members) for r in S.key_states(df, ["k"], "m").collect()}
    assert got == {k: (sum(1 for a, _ in pairs if a == k), len({b for a, b in pairs if a == k})) for k in {a for a, _ in pairs}}
