import pytest

from loomgraph.llm import queries
from tests.oracle import agree, connect

SF = "/root/testdata/sf0.001"
#: Too few rows for a peak of lengths.
MAY_BE_EMPTY = {"p8_limits"}
KEYS = {
    "p2_found": ["file_path"], "p2_reasons": ["file_path"], "p2_rules": ["rule"], "p5_found": ["file_path"], "p5_causes": ["file_path"], "p5_rates": ["repo", "language"], "p6_cleaned": ["doc_id"],
    "p7_mix": ["doc_id"], "p7_shares": ["source"], "p8_found": ["doc_id"], "p8_reasons": ["doc_id"], "p8_rates": ["source"], "p8_limits": ["source", "unit", "length"],
}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, con, name):
    agree(queries.QUERIES[name](spark, SF), con, queries.ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE)))
def test_query_without_sql_runs(spark, name):
    rows = [r.asDict() for r in queries.QUERIES[name](spark, SF).collect()]
    assert rows or name in MAY_BE_EMPTY
    key = KEYS[name]
    assert len({tuple(r[k] for k in key) for r in rows}) == len(rows)
    assert all(r[k] is not None for r in rows for k in key if k not in ("repo", "source"))


def test_reports_hold_what_was_found(spark):
    ids = lambda name, key: sorted(r[key] for r in queries.QUERIES[name](spark, SF).collect())
    for found, reasons, key in (("p2_found", "p2_reasons", "file_path"), ("p5_found", "p5_causes", "file_path"), ("p8_found", "p8_reasons", "doc_id")):
        assert ids(found, key) == ids(reasons, key)


def test_cleaned_texts_leak_nothing(spark):
    """No item has twelve words in a row left in a cleaned document, and other documents are unchanged."""
    from loomgraph.llm import leakage
    from loomgraph.session import load

    docs, items = load(spark, SF, "documents"), load(spark, SF, "eval_items")
    cleaned = queries.QUERIES["p6_cleaned"](spark, SF)
    whole = docs.drop("text").join(cleaned.select("doc_id", "text"), "doc_id")
    assert leakage.leaks(docs, items).count() > 0 and leakage.leaks(whole, items).count() == 0
