"""Evaluation texts leaking into training text (problem 6): a generalised suffix automaton.

The items (a stated, fixed set) are cut into words, and one automaton over all of them is built: its
states are the distinct classes of word sequences that occur in items, with the set of items each
occurs in. Documents are streamed through it. At every word the automaton holds the longest ending
that occurs in some item; wherever that is at least ``min_words`` long, the items of that ending (cut
to ``min_words``) share that many consecutive words with the document.

The automaton is sent to the executors, so its size is checked first: ``MAX_ITEM_WORDS`` words over
all items bound it (at most two states a word). Larger item sets are worked off in blocks of whole
items, one pass each. Documents are never shuffled, only pairs leave the scan.

A word is a maximal run of letters or digits, in lower case (``str.lower``); everything else between
words is ignored. Null or empty texts, items shorter than ``min_words`` and empty tables give no
rows. Repeated documents give their own rows; repeated items count as separate items. A pair is
reported once, with the number of document words covered and the longest covered span.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.session import ship

WORD = re.compile(r"[^\W_]+")
#: Words of all items that one automaton may hold.
MAX_ITEM_WORDS = 400_000


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


class Automaton:
    """Suffix automaton of several word lists; ``runs`` streams a word list through it."""

    def __init__(self, items: list[tuple[int, list[str]]], min_words: int):
        self.min_words = min_words
        self.next: list[dict[str, int]] = [{}]
        self.link, self.len = [-1], [0]
        owners: list[set[int]] = [set()]
        for item, tokens in items:
            last = 0
            for w in tokens:
                last = self._extend(last, w, owners)
                owners[last].add(item)
        # an ending occurs wherever any longer one does: hand items down the suffix links
        for s in sorted(range(1, len(self.len)), key=self.len.__getitem__, reverse=True):
            if self.len[self.link[s]] >= min_words:  # shorter endings are never asked
                owners[self.link[s]] |= owners[s]
        self.items = [tuple(sorted(o)) if n >= min_words else () for o, n in zip(owners, self.len)]

    def _clone(self, p: int, q: int, w: str, owners: list[set[int]]) -> int:
        c = len(self.len)
        self.next.append(dict(self.next[q]))
        self.len.append(self.len[p] + 1)
        self.link.append(self.link[q])
        owners.append(set())
        self.link[q] = c
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = c
            p = self.link[p]
        return c

    def _extend(self, last: int, w: str, owners: list[set[int]]) -> int:
        q = self.next[last].get(w)
        if q is not None:  # this sequence is known from an earlier item
            return q if self.len[q] == self.len[last] + 1 else self._clone(last, q, w, owners)
        cur = len(self.len)
        self.next.append({})
        self.len.append(self.len[last] + 1)
        self.link.append(0)
        owners.append(set())
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[cur] = q if self.len[q] == self.len[p] + 1 else self._clone(p, q, w, owners)
        return cur

    def hits(self, tokens: list[str]) -> Iterator[tuple[int, int, int]]:
        """(position of the last word, matching length, state of the ending of ``min_words`` words)."""
        nxt, link, length, least = self.next, self.link, self.len, self.min_words
        s = n = 0
        start = nxt[0]
        for i, w in enumerate(tokens):
            if s == 0 and w not in start:
                continue
            while s and w not in nxt[s]:
                s = link[s]
                n = length[s]
            t = nxt[s].get(w)
            if t is None:
                s = n = 0
                continue
            s, n = t, n + 1
            if n >= least:
                e = s
                while length[link[e]] >= least:
                    e = link[e]
                yield i, n, e


def build(items: DataFrame, min_words: int = 12, id_col: str = "item_id", text_col: str = "text") -> list[Automaton]:
    """Automata over all items, in blocks of at most ``MAX_ITEM_WORDS`` words."""
    ship(items.sparkSession)
    rows = items.where(F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).select(id_col, text_col)
    out, block, size = [], [], 0
    for item, text in rows.toLocalIterator():
        tokens = words(text)
        if len(tokens) < min_words:
            continue
        if block and size + len(tokens) > MAX_ITEM_WORDS:
            out.append(Automaton(block, min_words))
            block, size = [], 0
        block.append((item, tokens))
        size += len(tokens)
    return out + ([Automaton(block, min_words)] if block else [])


def _spans(positions: list[int], least: int) -> list[tuple[int, int]]:
    """Word spans [from, to) covered by runs that end at ``positions`` (ascending)."""
    out: list[list[int]] = []
    for p in positions:
        if out and p - least + 1 <= out[-1][1]:
            out[-1][1] = p + 1
        else:
            out.append([p - least + 1, p + 1])
    return [(a, b) for a, b in out]


#: Columns of ``leaks``.
_LEAKS = "doc_id long, item_id long, covered_words int, longest_span int, doc_words int"


def leaks(documents: DataFrame, items: DataFrame, min_words: int = 12) -> DataFrame:
    """One row per (doc_id, item_id) that share at least ``min_words`` consecutive words."""
    spark = documents.sparkSession
    docs = documents.where(F.col("doc_id").isNotNull() & (F.length("text") >= 2 * min_words - 1)).select("doc_id", "text")
    parts = []
    for automaton in build(items, min_words):
        shared = spark.sparkContext.broadcast(automaton)

        def scan(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            a = shared.value
            for batch in batches:
                out = []
                for doc, text in zip(batch["doc_id"], batch["text"]):
                    tokens = words(text)
                    ends: dict[int, list[int]] = {}
                    for i, _, e in a.hits(tokens):
                        for item in a.items[e]:
                            ends.setdefault(item, []).append(i)
                    for item, at in ends.items():
                        spans = _spans(at, a.min_words)
                        out.append((doc, item, sum(y - x for x, y in spans), max(y - x for x, y in spans), len(tokens)))
                yield pd.DataFrame(out, columns=["doc_id", "item_id", "covered_words", "longest_span", "doc_words"])

        parts.append(docs.mapInPandas(scan, _LEAKS))
    if not parts:
        return spark.createDataFrame([], _LEAKS)
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return found


def item_report(found: DataFrame, items: DataFrame) -> DataFrame:
    """Per item: documents that give it away and the most of its words found in one; 0 when none."""
    per = found.groupBy("item_id").agg(F.count("*").alias("n_docs"), F.max("longest_span").alias("longest_span"))
    return items.select("item_id", "suite").join(per, "item_id", "left").select(
        "item_id", "suite", F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.coalesce("longest_span", F.lit(0)).alias("longest_span")
    )


def remove_spans(documents: DataFrame, items: DataFrame, min_words: int = 12, max_coverage: float = 0.5) -> DataFrame:
    """Documents with leaked spans cut out: (doc_id, text, removed_words, dropped).

    Spans are removed with the text between their words. A document of which more than
    ``max_coverage`` is leaked is dropped whole (text null). Documents without leaks keep their text.
    """
    spark = documents.sparkSession
    shared = [spark.sparkContext.broadcast(a) for a in build(items, min_words)]

    def clean(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc, text in zip(batch["doc_id"], batch["text"]):
                marks = [] if text is None else list(WORD.finditer(text))
                tokens = [m.group().lower() for m in marks]
                ends = sorted({i for a in shared for i, _, _ in a.value.hits(tokens)})
                spans = _spans(ends, min_words)
                gone = sum(b - a for a, b in spans)
                if spans and gone > max_coverage * len(tokens):
                    out.append((doc, None, gone, True))
                    continue
                kept, at = [], 0
                for a, b in spans:
                    kept.append(text[at : marks[a].start()])
                    at = marks[b - 1].end()
                out.append((doc, None if text is None else "".join(kept) + text[at:], gone, False))
            yield pd.DataFrame(out, columns=["doc_id", "text", "removed_words", "dropped"])

    return documents.select("doc_id", "text").mapInPandas(clean, "doc_id long, text string, removed_words int, dropped boolean")
