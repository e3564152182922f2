"""Queries of the training-text problems 2, 5, 6, 7 and 8, and SQL where it can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import handwritten, leakage, mixing, syntax, truncation
from loomgraph.session import load


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return handwritten.not_handwritten(load(spark, d, "symbols"), load(spark, d, "source_files")).select("file_path")


def p2_reasons(spark: SparkSession, d: str) -> DataFrame:
    return handwritten.not_handwritten(load(spark, d, "symbols"), load(spark, d, "source_files"))


def p2_rules(spark: SparkSession, d: str) -> DataFrame:
    return handwritten.rules(load(spark, d, "symbols"), load(spark, d, "source_files"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return syntax.verdicts(load(spark, d, "source_files"), with_cause=False).where("not valid").select("file_path")


def p5_causes(spark: SparkSession, d: str) -> DataFrame:
    return syntax.verdicts(load(spark, d, "source_files")).where("not valid").select("file_path", "repo", "lang", "cause", "why")


def p5_rates(spark: SparkSession, d: str) -> DataFrame:
    return syntax.rates(syntax.verdicts(load(spark, d, "source_files"), with_cause=False))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(load(spark, d, "documents"), load(spark, d, "eval_items")).select("doc_id", "item_id")


def p6_items(spark: SparkSession, d: str) -> DataFrame:
    items = load(spark, d, "eval_items")
    return leakage.item_report(leakage.leaks(load(spark, d, "documents"), items), items).select("item_id", "suite", "n_docs")


def p6_cleaned(spark: SparkSession, d: str) -> DataFrame:
    return leakage.remove_spans(load(spark, d, "documents"), load(spark, d, "eval_items"))


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(load(spark, d, "documents"), load(spark, d, "mix_targets"), weight=mixing.size_weight())[0]


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(load(spark, d, "documents"), load(spark, d, "mix_targets"), weight=mixing.size_weight())[1]


def p7_sources(spark: SparkSession, d: str) -> DataFrame:
    """What the mix is made from: texts of each target source (repeats once, at their first document)."""
    shares = mixing.mix(load(spark, d, "documents"), load(spark, d, "mix_targets"), weight=mixing.size_weight())[1]
    return shares.select("source", F.round("target_share", 6).alias("target_share"), "max_repeats", "source_texts", (F.col("most_repeats") <= F.col("max_repeats")).alias("within_cap"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.cuts(load(spark, d, "documents")).select("doc_id")


def p8_reasons(spark: SparkSession, d: str) -> DataFrame:
    return truncation.cuts(load(spark, d, "documents"))


def p8_rates(spark: SparkSession, d: str) -> DataFrame:
    return truncation.rates(load(spark, d, "documents"))


def p8_documents(spark: SparkSession, d: str) -> DataFrame:
    return truncation.rates(load(spark, d, "documents")).select("source", "documents")


def p8_limits(spark: SparkSession, d: str) -> DataFrame:
    return truncation.limits(load(spark, d, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p2_found, p2_reasons, p2_rules, p5_found, p5_causes, p5_rates, p6_found, p6_items, p6_cleaned, p7_mix, p7_shares, p7_sources, p8_found, p8_reasons, p8_rates, p8_documents, p8_limits)}

_LEAKS = """
iw as (select item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') as w from eval_items where text is not null),
grams as (select distinct item_id, array_to_string(w[i:i + 11], ' ') as g from (select item_id, w, unnest(range(1, len(w) - 10)) as i from iw where len(w) >= 12)),
dw as (select doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') as w from documents where text is not null),
dg as (select doc_id, array_to_string(w[i:i + 11], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 10)) as i from dw where len(w) >= 12)),
leaks as (select distinct doc_id, item_id from dg join grams using (g))"""

_SOURCE = "nullif(regexp_replace(lower(trim(source)), '[-\\s]+', '_', 'g'), '')"

ORACLE: dict[str, str] = {
    "p7_sources": f"""with t as (select {_SOURCE} as source, sum(target_share) as target_share, min(coalesce(max_repeats, 1)) as max_repeats from mix_targets where {_SOURCE} is not null group by 1),
d as (select doc_id, {_SOURCE} as source, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '^' || chr(65279) || '+', ''), '\\r\\n?', chr(10), 'g'), '[ \\t]+\\n', chr(10), 'g'), '\\s+$', '')) as k from documents where text <> ''),
u as (select k, min_by(source, doc_id) as source from d where source in (select source from t) group by k)
select t.source, round(target_share, 6) as target_share, cast(max_repeats as integer) as max_repeats, count(u.k) as source_texts, true as within_cap from t left join u using (source) group by 1, 2, 3""",
    "p8_documents": f"select {_SOURCE} as source, count(*) as documents from documents where length(text) > 0 group by 1",
    "p6_found": f"with {_LEAKS} select doc_id, item_id from leaks",
    "p6_items": f"with {_LEAKS} select e.item_id, e.suite, count(l.doc_id) as n_docs from eval_items e left join leaks l using (item_id) group by 1, 2",
}
