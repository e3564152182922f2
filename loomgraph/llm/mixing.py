"""Mixing sources to target weights (problem 7): whole copies and a Pareto order sample.

Every source of the target table is to hold its share of the tokens of the mix, no text more often
than ``max_repeats``. Texts, not rows, are the units: a text collected again under further doc_ids
counts once, by its smallest doc_id among the target sources.

1. Tokens per document (public byte-level BPE), then one row per text. Both are narrow from here on.
2. Size of the mix: ``total_tokens``, or the most that keeps all shares: the least, over the sources,
   of tokens x max_repeats / share. A target source without documents cannot take part; its share is
   spread over the others in proportion (``feasible_share``) and it is reported with 0.
3. A source needs c = share x size / tokens copies of each of its texts. All texts get floor(c)
   whole copies; the rest is a sample with inclusion probabilities p_i: proportional to ``weight``
   (equal by default; the queries use ``size_weight``), capped at 1, and such that the expected tokens
   are the missing ones.
4. Pareto order sampling: a text's rank is [u/(1-u)] / [p/(1-p)], u being a hash of the seed and the
   text. The texts of smallest rank are taken up to the missing tokens. The sum along the ranks is
   made in two levels, bins of ranks and then inside the one bin where the sum is reached, so no
   task orders a source.

Without ``max_repeats`` (null) a source counts as 1. Null or empty texts, null sources and sources
that are not targets are never used; targets with null, zero or negative share get no documents.
Repeated target rows of a spelling are one source (shares added, smallest max_repeats).
Results depend on data and seed only, not on partitioning. The per-source figures (one row per
target source, a configuration table) are the only rows that reach the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loomgraph.llm.text import count_tokens, norm_source, text_key
from loomgraph.session import Cuts, ship

#: Bins of ranks; the last step orders one bin per source.
RANK_BINS = 10_000


def _unit(seed: int, key: Column) -> Column:
    """Uniform in (0, 1) from 52 bits of a digest."""
    return (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key)), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(2**52))


def size_weight() -> Column:
    """Weight of a text: the square root of its length, so that fragments do not crowd out whole documents
    while every text keeps a chance."""
    return F.sqrt(F.length("text"))


def unique_texts(documents: DataFrame, targets: DataFrame, tokenizer: str | None, weight: Column | None) -> DataFrame:
    """(doc_id, source, key, tokens, weight): one row per text of a target source."""
    wanted = targets.select(norm_source().alias("source")).where("source is not null").distinct()
    docs = (
        documents.where(F.col("text").isNotNull() & F.col("doc_id").isNotNull())
        .select("doc_id", norm_source().alias("source"), "text", (F.lit(1.0) if weight is None else weight.cast("double")).alias("weight"))
        .join(wanted, "source", "left_semi")
        .select("doc_id", "source", text_key().alias("key"), "weight", count_tokens(F.col("text"), tokenizer).alias("tokens"))
        .where("tokens > 0")
    )
    first = docs.groupBy("key").agg(F.min(F.struct("doc_id", "source", "tokens", "weight")).alias("d"))
    return first.select("key", "d.doc_id", "d.source", "d.tokens", "d.weight")


def _plan(texts: DataFrame, targets: DataFrame, total_tokens: int | None) -> list[dict]:
    """Per target source: tokens there are, tokens wanted, whole copies, tokens to sample, rate."""
    have = texts.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("texts"), F.sum(F.col("tokens") * F.greatest("weight", F.lit(0.0))).alias("mass"))
    spec = targets.select(norm_source().alias("source"), "target_share", F.coalesce("max_repeats", F.lit(1)).alias("max_repeats")).where("source is not null")
    spec = spec.groupBy("source").agg(F.sum("target_share").alias("target_share"), F.min("max_repeats").alias("max_repeats"))
    rows = [r.asDict() for r in spec.join(have, "source", "left").orderBy("source").collect()]
    live = [r for r in rows if (r["tokens"] or 0) > 0 and (r["target_share"] or 0) > 0 and r["max_repeats"] > 0]
    share_sum = sum(r["target_share"] for r in live)
    size = total_tokens
    if size is None:
        size = min((r["tokens"] * r["max_repeats"] * share_sum / r["target_share"] for r in live), default=0)
    for r in rows:
        r |= {"tokens": r["tokens"] or 0, "texts": r["texts"] or 0, "feasible_share": 0.0, "wanted": 0.0, "whole": 0, "sampled": 0.0, "mass": r["mass"] or 0.0}
        if r in live:
            r["feasible_share"] = r["target_share"] / share_sum
            r["wanted"] = float(min(r["feasible_share"] * size, r["tokens"] * r["max_repeats"]))
            copies = r["wanted"] / r["tokens"]
            r["whole"] = math.floor(copies + 1e-9)
            r["sampled"] = float(max(0.0, r["wanted"] - r["whole"] * r["tokens"]))
            if r["whole"] >= r["max_repeats"]:
                r["whole"], r["sampled"] = r["max_repeats"], 0.0
    return rows


_PLAN = "source string, target_share double, max_repeats int, tokens long, texts long, feasible_share double, wanted double, whole int, sampled double, rate double"


def _rates(texts: DataFrame, plan: list[dict]) -> None:
    """Rate so that the capped probabilities min(1, rate x weight) sum to the wanted tokens."""
    for r in plan:
        r["rate"] = r["sampled"] / r["mass"] if r["mass"] > 0 else 0.0
    while True:  # a round caps at least one more text, or ends
        rate = F.create_map(*[x for r in plan for x in (F.lit(r["source"]), F.lit(r["rate"]))])[F.col("source")] if plan else F.lit(0.0)
        full = F.col("weight") * rate >= 1
        over = {x["source"]: x for x in texts.groupBy("source").agg(F.sum(F.when(full, F.col("tokens"))).alias("full"), F.sum(F.when(~full, F.col("tokens") * F.col("weight"))).alias("rest")).collect()}
        moved = False
        for r in plan:
            o = over.get(r["source"])
            if o and o["full"] and o["rest"]:
                better = max(0.0, r["sampled"] - o["full"]) / o["rest"]
                moved |= better > r["rate"] * (1 + 1e-9)
                r["rate"] = max(r["rate"], better)
        if not moved:
            return


def mix(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 1, tokenizer: str | None = None, weight: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(chosen, shares): chosen (doc_id, source, tokens, repeats >= 1), and the report per source."""
    spark = documents.sparkSession
    ship(spark)
    cuts = Cuts(spark, "mix")
    texts = cuts.write(unique_texts(documents, targets, tokenizer, weight))
    plan = _plan(texts, targets, total_tokens)
    if weight is None:
        for r in plan:
            r["rate"] = r["sampled"] / r["tokens"] if r["tokens"] else 0.0
    else:
        _rates(texts, plan)
    spec = spark.createDataFrame([tuple(r[c.split()[0]] for c in _PLAN.split(", ")) for r in plan], _PLAN)
    ranked = texts.join(F.broadcast(spec.select("source", "whole", "sampled", "rate")), "source")
    u, p = _unit(seed, F.col("key")), F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("weight") * F.col("rate")))
    # rank / (1 + rank) orders like the rank and lies in [0, 1]; certain texts come first, excluded ones never
    odds = F.when(p >= 1, F.lit(0.0)).when(p <= 0, F.lit(None)).otherwise((u / (1 - u)) / (p / (1 - p)))
    ranked = ranked.withColumn("rank", odds / (1 + odds)).withColumn("bin", F.least(F.floor(F.col("rank") * RANK_BINS), F.lit(RANK_BINS - 1)).cast("int"))
    bins = ranked.where("bin is not null").groupBy("source", "bin").agg(F.sum("tokens").alias("in_bin"))
    bins = bins.select("source", "bin", "in_bin", (F.sum("in_bin").over(W.partitionBy("source").orderBy("bin")) - F.col("in_bin")).alias("before"))
    placed = ranked.join(bins, ["source", "bin"], "left")
    edge = (F.col("before") < F.col("sampled")) & (F.col("before") + F.col("in_bin") > F.col("sampled"))
    low = placed.where(~F.coalesce(edge, F.lit(False))).select("doc_id", "source", "tokens", "whole", (F.col("before") + F.col("in_bin") <= F.col("sampled")).alias("taken"))
    inside = F.sum("tokens").over(W.partitionBy("source").orderBy("rank", "key")) - F.col("tokens")
    border = placed.where(edge).withColumn("at", F.col("before") + inside).select("doc_id", "source", "tokens", "whole", (F.col("at") + F.col("tokens") / 2 <= F.col("sampled")).alias("taken"))
    chosen = cuts.write(
        low.unionByName(border).select("doc_id", "source", "tokens", (F.col("whole") + F.coalesce("taken", F.lit(False)).cast("int")).alias("repeats")).where("repeats > 0")
    )
    used = chosen.groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("mix_tokens"), F.count("*").alias("mix_texts"), F.max("repeats").alias("most_repeats"))
    total = chosen.agg(F.sum(F.col("tokens") * F.col("repeats"))).scalar()
    shares = spec.join(used, "source", "left").select(
        "source", "target_share", "feasible_share", F.coalesce(F.col("mix_tokens") / total, F.lit(0.0)).alias("actual_share"), "max_repeats",
        F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"), F.col("tokens").alias("source_tokens"), F.col("texts").alias("source_texts"),
        F.coalesce("mix_tokens", F.lit(0)).alias("mix_tokens"), F.coalesce("mix_texts", F.lit(0)).alias("mix_texts"),
    )
    return chosen, cuts.finish(shares)
