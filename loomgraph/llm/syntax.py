"""Source files that do not parse (problem 5).

1. The current content of a file is its fetch of greatest ``fetched_at``; its extension names the
   language (PHP, Python 3, JavaScript as script or module, TypeScript, TSX).
2. Contents are cut into chunks of whole lines of some ``CHUNK`` characters; each chunk, wherever it
   lies, is reduced to a lexer-state map with bracket summary and possible cuts.
3. The maps compose associatively (``lexmap.compose``): aggregations reduce them by ranges of ``RANGE``
   chunks and then by file. That gives the file its balance and every chunk its entry state and depth,
   and with them the cuts that lie at statement starts outside all brackets.
4. A balance that is off in a text whose brackets the lexer surely sees (``lexmap.DOUBT``) makes the
   file invalid; nothing of it is parsed. All other files are parsed by their pieces of balanced
   statements with the local grammar of the language, and are valid when all their pieces are. A piece
   that fails is tried once more with its neighbours, as the lexer may have cut it wrongly. Files with
   an odd summary or with a rule of the file as a whole (``lexmap.FILE_RULE``, as a late
   ``__future__`` import) are not cut, so they are one piece.

Python pieces go to the interpreter's own parser, so "current Python 3" is the version that runs the
tasks; the other grammars are in ``grammar_js`` and ``grammar_php``.

Null content or an extension of no known language gives no row in the verdicts; empty files are
valid. A piece nested beyond ``grammar_js.MAX_DEPTH`` levels in balanced brackets is undecided: the
verdict is null. A null ``fetched_at`` sorts before all times. Rows delivered twice and older fetches
never matter.
"""

from __future__ import annotations

import json
import re
import sys
import warnings
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm import grammar_js, grammar_php, lexmap
from loomgraph.session import ship

#: Characters of a chunk (small enough that most files have several), and chunks composed together.
CHUNK, RANGE = 768, 256

# Languages by extension.
LANGUAGES = {"php": "php", "py": "py", "js": "js", "mjs": "js", "cjs": "js", "ts": "ts", "mts": "ts", "cts": "ts", "tsx": "tsx"}

_CONFLICT = re.compile(r"(?m)^(?:<{7}|>{7}) ?.*$")


def language(path: str = "file_path") -> Column:
    """Language that the extension of a path names, or null."""
    ext = F.lower(F.regexp_extract(F.col(path), r"\.([A-Za-z0-9]+)$", 1))
    return F.create_map(*[x for k, v in LANGUAGES.items() for x in (F.lit(k), F.lit(v))])[ext]


def current_files(source_files: DataFrame) -> DataFrame:
    """(file_path, repo, lang, content): the current row of each file; content can be null.

    The number of partitions is fixed, as the work that follows costs far more a byte than the shuffle
    whose size would have them merged.
    """
    parts = int(source_files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        source_files.where(F.col("file_path").isNotNull()).repartition(parts, "file_path").groupBy("file_path").agg(F.max(F.struct("fetched_at", "content", "repo")).alias("v"))
        .select("file_path", F.col("v.repo").alias("repo"), language().alias("lang"), F.col("v.content").alias("content"))
    )


def fault(lang: str, text: str, php_open: bool = False) -> str | None:
    """Why a piece does not parse, or None. ``php_open``: the piece starts inside PHP code."""
    with _roomy():
        return _parse(lang, text, php_open)[0]


@contextmanager
def _roomy():
    """Deep enough a stack for the parsers, and no warnings of the interpreter's own."""
    limit = sys.getrecursionlimit()
    sys.setrecursionlimit(max(limit, 60 * grammar_js.MAX_DEPTH))
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            yield
    finally:
        sys.setrecursionlimit(limit)


def _parse(lang: str, text: str, php_open: bool = False) -> tuple[str | None, bool]:
    """Why a piece does not parse, and whether it is too deep to say."""
    try:
        if lang == "py":
            compile(text.lstrip("\ufeff"), "piece", "exec", dont_inherit=True)
        elif lang == "php":
            grammar_php.check("<?php\n" + text if php_open else text)
        else:
            grammar_js.check(text, lang)
    except grammar_js.Bad as e:
        return str(e), False
    except SyntaxError as e:
        return f"{e.msg} at line {e.lineno}", False
    except ValueError as e:
        return str(e), False
    except (grammar_js.Deep, RecursionError, MemoryError):
        return None, True
    return None, False


def cause(lang: str, text: str, why: str) -> str:
    """Likely cause of a fault, for reports."""
    if len(_CONFLICT.findall(text)) >= 2:
        return "merge conflict"
    if re.search("[\x00-\x08\x0e-\x1f]", text):
        return "binary data"
    head = text.lstrip()[:200].lower()
    if head.startswith(("<!doctype", "<html")) or (lang != "php" and head.startswith("<?php")):
        return "other language"
    if any(_parse(o, text) == (None, False) for o in ("py", "js", "ts", "tsx") if o != lang) and lang != "php":
        return "other language"
    where = re.search(r"at (\d+): ''$", why)
    if where or "was never closed" in why or "unterminated" in why or "expected an indented block" in why or "EOF" in why:
        return "truncated or unclosed"
    return "syntax"


_VERDICT = "file_path string, repo string, lang string, valid boolean, why string, cause string"


def _dump(m: dict[str, lexmap.Summary], cuts: bool = False) -> str:
    return json.dumps({s: (x.out, x.closers, x.openers, x.odd, x.last, x.cuts if cuts else ()) for s, x in m.items()})


def _read(m: str) -> dict[str, lexmap.Summary]:
    return {s: lexmap.Summary(*x) for s, x in json.loads(m).items()}


def _start(lang: str) -> str:
    return "h" if lang == "php" else "c"


def _maps(size: int):
    """Map of every chunk with its offset, as a line that sorts by the chunk's number; a file's first chunk
    is entered in one state only."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path, lang, text in zip(b["file_path"], b["lang"], b["content"]):
                labels = sorted(set(lexmap.LABEL.findall(text))) if lang == "php" else []
                rule, doubt, at = lexmap.file_rule(lang, text), lexmap.doubtful(lang, text), 0
                for no, part in enumerate(lexmap.lines(text, size)):
                    m = lexmap.chunk_map(lang, part, labels) if no else {_start(lang): lexmap.scan(lang, part, _start(lang))}
                    out.append((path, lang, no // RANGE, f"{no:012d} {at} {_dump(m, True)}", rule, doubt))
                    at += len(part)
            yield pd.DataFrame(out, columns=["file_path", "lang", "run", "line", "rule", "doubt"])

    return run


def _lines(run: str) -> list[tuple[int, dict[str, lexmap.Summary]]]:
    """(offset, map) of the chunks of a run."""
    return [(int(at), _read(m)) for _, at, m in (x.split(" ", 2) for x in run.split("\n"))]


def _composed(runs: pd.Series) -> pd.Series:
    """One map of a run of neighbouring chunks."""
    return pd.Series([_dump(reduce(lexmap.compose, (m for _, m in _lines(r)))) for r in runs])


def _placed(lang: pd.Series, composed: pd.Series, runs: pd.Series) -> pd.DataFrame:
    """Balance of a file from its composed runs (null, or what is left open; ``odd`` apart), and its cuts."""
    opens, odds, cuts = [], [], []
    for la, maps, texts in zip(lang, composed, runs):
        x, at = lexmap.Summary(_start(la)), [0]
        for m, text in zip(maps, texts):
            y = x
            for offset, chunk in _lines(text):
                z, depth = chunk[y.out], len(y.openers) - len(y.closers)
                free = y.last != "@" if la == "py" else y.last in (";", "}")
                at += [offset + o for o, rel, asks in z.cuts if rel + depth == 0 and offset + o and (free or not asks)]
                y = lexmap.join(y, z)
            x = lexmap.join(x, _read(m)[x.out])
        left = x.openers[-1:] if x.openers else "" if x.out in ("c", "h") else x.out
        opens.append(f"unmatched '{x.closers[0]}'" if x.closers else f"'{left}' was never closed" if left else None)
        odds.append(x.odd)
        cuts.append(at)
    return pd.DataFrame({"open": opens, "odd": odds, "cuts": cuts})


def _by_pieces(lang: str, text: str, cuts: list[int]) -> tuple[str | None, bool]:
    """First fault of the pieces between ``cuts``, and whether one is too deep to say."""
    ends, deep = [*cuts[1:], len(text)], False

    def piece(i: int, j: int) -> tuple[str | None, bool]:
        return _parse(lang, text[cuts[i] : ends[j]], lang == "php" and cuts[i] > 0)

    last = len(cuts) - 1
    for i in range(last + 1):
        why, too_deep = piece(i, i)
        around = [(i, i + 1), (i - 1, i), (i - 1, i + 1)] if why else []
        if why and not any(piece(j, k) == (None, False) for j, k in around if j >= 0 and k <= last):
            return why, False
        deep |= too_deep
    return None, deep


def _judge(with_cause: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            valid, whys, causes = [], [], []
            with _roomy():
                for lang, text, unbalanced, sure, cuts in zip(b["lang"], b["content"], b["open"], b["sure"], b["cuts"]):
                    why, deep = (unbalanced, False) if sure and unbalanced else _by_pieces(lang, text, [int(x) for x in cuts])
                    valid.append(None if deep and not why else not why)
                    whys.append(why or ("nested too deeply to say" if deep else None))
                    causes.append(cause(lang, text, why) if why and with_cause else None)
            yield pd.DataFrame({"file_path": b["file_path"], "repo": b["repo"], "lang": b["lang"], "valid": pd.array(valid, "boolean"), "why": whys, "cause": causes})

    return run


def verdicts(source_files: DataFrame, chunk: int = CHUNK, with_cause: bool = True) -> DataFrame:
    """(file_path, repo, lang, valid, why, cause) for every file with a known language and content; without
    ``with_cause`` the cause is null."""
    ship(source_files.sparkSession)
    files = current_files(source_files).where(F.col("lang").isNotNull() & F.col("content").isNotNull())
    composed, placed = F.pandas_udf(_composed, "string"), F.pandas_udf(_placed, "open string, odd boolean, cuts array<int>")
    flags = [F.max("rule").alias("rule"), F.max("doubt").alias("doubt")]
    maps = files.select("file_path", "lang", "content").mapInPandas(_maps(chunk), "file_path string, lang string, run int, line string, rule boolean, doubt boolean")
    runs = maps.groupBy("file_path", "lang", "run").agg(F.array_join(F.sort_array(F.collect_list("line")), "\n").alias("lines"), *flags).withColumn("map", composed("lines"))
    whole = runs.groupBy("file_path", "lang").agg(F.sort_array(F.collect_list(F.struct("run", "map", "lines"))).alias("r"), *flags)
    whole = whole.select("file_path", "rule", "doubt", placed("lang", F.col("r.map"), F.col("r.lines")).alias("p"))
    uncut = F.col("rule") | F.col("p.odd") | F.col("p.open").isNotNull()
    whole = whole.select("file_path", F.col("p.open").alias("open"), (~F.col("doubt") & ~F.col("p.odd")).alias("sure"), F.when(uncut, F.array(F.lit(0))).otherwise(F.col("p.cuts")).alias("cuts"))
    return files.join(whole, "file_path").mapInPandas(_judge(with_cause), _VERDICT)


def rates(judged: DataFrame) -> DataFrame:
    """Files, invalid and undecided files and the rate of invalid ones per repository and language."""
    invalid = F.count(F.when(~F.col("valid"), 1))
    return judged.groupBy("repo", F.col("lang").alias("language")).agg(
        F.count("*").alias("files"), invalid.alias("invalid"), F.count(F.when(F.col("valid").isNull(), 1)).alias("undecided"), F.round(invalid / F.count("*"), 6).alias("rate")
    )
