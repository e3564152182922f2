"""A few keys holding most records (problem 4): eager aggregation through joins.

``select k, count(*), sum(..) from L join R on L.k = R.k group by g`` makes every row of a hot key
meet in one task. Here both inputs are first reduced to one *state* per join key (rows, distinct
members, sums), the compact states are joined, and the algebra is finished on them: the joined count
is the product of the counts, a sum over L is its state times the count of R. Then they are rolled
up. The first reduction has map-side partial aggregation, so a key that holds a third of all rows
arrives at its reducer as one row per map task.

``heavy`` takes its keys from the joined states of both inputs, so what is heavy, stored and joined comes
out of one pass over compact rows.

Distinct members are counted in two steps, on (key, member) first, which spreads a hot key over all
tasks by its members, and then on the key over rows that are already partial.

Nulls: a null key forms a group of its own in the states, and never joins. Null members do not count
as distinct members. Empty inputs give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def norm_type(c: str = "reference_type") -> Column:
    """Spellings of a relationship type as one: upper case, ``-`` as ``_``."""
    return F.upper(F.regexp_replace(F.col(c), "-", "_"))


def key_states(df: DataFrame, keys: list[str], member: str | None = None) -> DataFrame:
    """One row per key: ``n_rows`` and, with ``member``, ``n_members`` (distinct non-null)."""
    if member is None:
        return df.groupBy(*keys).agg(F.count("*").alias("n_rows"))
    fine = df.groupBy(*keys, F.col(member).alias("_member")).agg(F.count("*").alias("_n"))
    return fine.groupBy(*keys).agg(F.sum("_n").alias("n_rows"), F.count("_member").alias("n_members"))


def eager_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, how: str = "left") -> DataFrame:
    """Join two state tables; ``joined_rows`` is what the plain join of the raw inputs would count.

    ``left`` and ``right`` carry ``n_rows``. A state without partner keeps its rows (``how`` left or full)
    and gets ``joined_rows`` 0; with ``full``, a key of the right side alone has ``n_rows`` 0.
    """
    r = right.select(F.col(right_key).alias("_rk"), F.col("n_rows").alias("right_rows"), *[c for c in right.columns if c not in (right_key, "n_rows")])
    j = left.join(r, F.col(left_key) == F.col("_rk"), how)
    if how == "full":
        j = j.withColumn(left_key, F.coalesce(left_key, "_rk")).withColumn("n_rows", F.coalesce("n_rows", F.lit(0)))
    return j.drop("_rk").withColumn("joined_rows", F.col("n_rows") * F.coalesce("right_rows", F.lit(0))).withColumn("right_rows", F.coalesce("right_rows", F.lit(0)))


def heavy(references: DataFrame, symbols: DataFrame, share: float = 0.01) -> DataFrame:
    """(target_id, reference_type, n_rows, stored_rows, joined_rows) of the pairs that hold at least ``share`` of
    all rows as delivered, whether their target is stored or not. Both inputs are reduced to rows per key, the
    states are joined in full, and no row is shuffled beyond its partial count."""
    states = key_states(references.select("target_id", norm_type().alias("reference_type")), ["target_id", "reference_type"])
    joined = eager_join(states, key_states(symbols.select("id"), ["id"]), "target_id", "id", "full")
    total = references.agg(F.count("*").alias("n")).scalar()
    return joined.where((F.col("n_rows") >= F.lit(share) * total) & (F.col("n_rows") > 0)).select("target_id", "reference_type", "n_rows", F.col("right_rows").alias("stored_rows"), "joined_rows")


def per_key(references: DataFrame, symbols: DataFrame, share: float = 0.01) -> DataFrame:
    """Per (target_id, reference_type): rows, distinct sources, stored rows of the target, the size of
    the raw join, and whether the pair holds at least ``share`` of all rows (as delivered)."""
    refs = references.select("target_id", norm_type().alias("reference_type"), "source_id")
    states = key_states(refs, ["target_id", "reference_type"], "source_id").withColumnRenamed("n_members", "n_sources")
    stored = key_states(symbols.select("id"), ["id"])
    total = references.agg(F.count("*").alias("n")).scalar()
    return eager_join(states, stored, "target_id", "id").select(
        "target_id", "reference_type", "n_rows", "n_sources", F.col("right_rows").alias("stored_rows"), "joined_rows",
        (F.col("n_rows") >= F.lit(share) * total).alias("is_heavy"),
    )


def per_target_type(references: DataFrame, symbols: DataFrame) -> DataFrame:
    """Roll-up of the raw join references x stored rows: per type of target row and reference type,
    the joined rows and the distinct targets, from states only."""
    refs = key_states(references.select("target_id", norm_type().alias("reference_type")), ["target_id", "reference_type"])
    stored = key_states(symbols.select("id", F.col("type").alias("target_type")), ["id", "target_type"])
    j = eager_join(refs, stored, "target_id", "id", "inner")
    return j.groupBy("target_type", "reference_type").agg(F.sum("joined_rows").alias("joined_rows"), F.countDistinct("target_id").alias("n_targets"))
