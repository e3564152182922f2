"""Small shared pieces: source spellings, text identity, token counts."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Directory of the public tokenizer files; a parameter everywhere, this is only the default.
TOKENIZERS = os.environ.get("LOOMGRAPH_TOKENIZERS", "/opt/tokenizers")
#: Word pattern that belongs to the byte_bpe_50k vocabulary (a fixed value of that vocabulary).
BYTE_BPE_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_ENCODINGS: dict[str, object] = {}


def encoding(path: str):
    """The tokenizer of a ``.tiktoken`` rank file, built once per Python worker."""
    if path not in _ENCODINGS:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
        _ENCODINGS[path] = tiktoken.Encoding("own", pat_str=BYTE_BPE_PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[path]


def count_tokens(text: Column, tokenizer: str | None = None) -> Column:
    """Tokens of a text in a public byte-level BPE; null stays null."""
    path = tokenizer or f"{TOKENIZERS}/byte_bpe_50k.tiktoken"

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoding(path)
        for s in batches:
            yield pd.Series([None if t is None else len(enc.encode_ordinary(t)) for t in s], dtype="Int64")

    return count(text)


def norm_source(c: str = "source") -> Column:
    """Spellings of a source as one: lower case, trimmed, ``-`` and blanks as ``_``; empty is null."""
    s = F.regexp_replace(F.lower(F.trim(F.col(c))), r"[-\s]+", "_")
    return F.when(s != "", s)


def text_key(c: str = "text") -> Column:
    """Identity of a text that was collected again: without byte-order mark, CR and trailing blanks."""
    t = F.regexp_replace(F.col(c), "^\ufeff+", "")
    t = F.regexp_replace(t, "\r\n?", "\n")
    t = F.regexp_replace(t, r"[ \t]+(?=\n)|\s+$", "")
    return F.md5(t)
