"""Generated, minified, vendored files and data blobs among source files (problem 2).

Character trigram models of names decide, in three rules; a fourth tells data:

* ``mangled`` (minified). Per language a trigram model is trained on the names in all contents (strings
  and comments left out; a name counts once per content). A file whose names cost clearly more bits a
  character than the names of any language's corpus do is mangled.
* ``template`` (generated). Names that differ in digits only, or that are put together from a few words
  over and over, have a low diversity: few distinct forms, or few distinct parts, for many names.
* ``style`` (vendored). Every repository gets a trigram model of the names its files give themselves
  (namespace root, holder and title in comments, prefix that most declarations share). A file that
  calls itself by a name which is improbable under its own repository's model follows a foreign naming
  style. An exact check follows: the name occurs in several repositories, or the file says under which
  licence it is passed on. The counts and the entropies of names are Spark aggregations and joins.
* ``literals`` (data). Literals hold most of the text. Short settings files have literals, but names
  too, and are no data blobs.

Exact checks then only add files: ``mark`` (what tools write into comments) and ``path`` (package
directories, names of delivered bundles and of generated files). ``rule`` is the first that holds in
this order, ``score`` what it measured (bits, diversity, share; null for marks and paths), ``reason``
the kind. Files without any are hand-written and not returned.

A file whose content is null, or that has no source row, is judged by its path alone; a null ``repo``
has no style. Null paths are ignored; spellings of the separator do not matter; rows delivered twice
count once. Whole texts are read: a mark or a licence counts wherever its comment stands. The language
models (at most 27,000 cells a language) are all that is gathered and sent to the executors.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.syntax import current_files, language
from loomgraph.session import Cuts, ship

SYMBOLS = "abcdefghijklmnopqrstuvwxyz0_?^"
CODE = {c: i for i, c in enumerate(SYMBOLS)}

#: Mangled: so many bits a character above the mean of a language's names, in at least so many distinct names.
MANGLED_EXCESS, MANGLED_NAMES = 0.9, 20
#: Templates: at most so many distinct forms or parts a name, in at least so many distinct names.
TEMPLATE_DIVERSITY, TEMPLATE_NAMES = 0.5, 40
#: Style: so many bits a character under the own repository's model.
FOREIGN_BITS = 0.8
#: A prefix names its file when this share of at least so many declarations bear it.
PREFIX_SHARE, PREFIX_DECLARED = 0.6, 5
#: A foreign name without a licence text must occur in so many repositories.
FOREIGN_REPOS = 3
#: Data: literals hold this share of the text, which has at least so many characters other than blanks.
DATA_SHARE, DATA_CHARS = 0.6, 200

# Directories and names that tools and package managers use.
PACKAGE_DIRS = ["node_modules", "bower_components", "jspm_packages", "site-packages", "third_party", "third-party", "thirdparty", "3rdparty", "Godeps", "Pods", ".venv"]
GENERATED_DIRS = ["generated", "_generated", "__generated__", "gen", "codegen", "autogen", "generated-sources", "Proxies"]
GENERATED_NAMES = r"(_pb2(_grpc)?\.pyi?|[._]pb\.(js|ts|php)|\.pb\.go|\.g\.\w+|\.generated\.\w+|\.gen\.\w+|\.designer\.\w+|^__CG__.*|_generated\.\w+)$"
DELIVERED_NAMES = r"([.-]min(\.\w+)*\.(js|mjs|css|php|ts)|\.(bundle|chunk|packed)\.(js|mjs)|\.[0-9a-f]{8,}\.(js|mjs))$"
DELIVERED_DIRS = r"(^|/)(dist|build/static|public/build)/"

_MARK = re.compile(
    r"@generated\b|<auto-?generated\b|code generated (by|from)\b|\bauto-?generated (by|from|file|code|-)|AUTO-?GENERATED\b|automatically (created|generated|produced) (from|by)|(this|the) file (is|was) (auto-?)?generated\b|generated by .{0,80}(do not|don't) (edit|modify)",
    re.I,
)
_LICENCE = re.compile(r"\(c\) the (?P<a>[\w.-]+) (?:contributors|authors|developers)|copyright (?:\(c\) )?[\d, -]* ?(?:the )?(?P<b>[\w.-]+) (?:contributors|authors|team|project)|\bpart of (?:the )?(?P<c>[\w-]+)\b(?= (?:library|package|project)|\.)", re.I)
_PASSED_ON = re.compile(r"released under|licen[cs]ed under|SPDX-License-Identifier|distributed with permission|upstream( copy)?\s*[:;,]|see (the )?LICEN[CS]E|^/\*!\s*[\w.-]+\s+v?\d+(?:\.\d+)+", re.I)
_TITLE = re.compile(r"^/\*![\s*]*([A-Za-z][\w.-]*)\s+v?\d+(?:\.\d+)+")
_NAMESPACE = re.compile(r"^\s*namespace\s+([A-Za-z_]\w*)", re.M)
_DECLARED = re.compile(r"\b(?:class|interface|trait|function|def)\s+([A-Za-z_$][\w$]*)")
_NUMBER = re.compile(r"(?<![\w.])-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?(?!\w)")
_NAME = re.compile(r"[A-Za-z_$][\w$]*")
_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
_DIGITS = re.compile(r"\d+")
_BLANK = re.compile(r"\s+")

# Strings and comments, in forms that do not recurse on long ones; ``#`` opens comments in some languages only.
_STRINGS = r"'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'|\"[^\"\\\n]*+(?:\\.[^\"\\\n]*+)*+\""
_QUIET = {True: r"(?s)/\*.*?\*/|(?://|#(?!\[))[^\n]*+|" + _STRINGS, False: r"(?s)/\*.*?\*/|//[^\n]*+|" + _STRINGS}
_HASH = ["php", "py"]
_QUIET_RX = {k: re.compile(('(?s)"""' + '.*?"""|' if k else "(?s)") + v[4:]) for k, v in _QUIET.items()}

_SCORES = "file_path string, repo string, excess double, names int, diversity double, literals double, chars int, called array<string>, passed_on boolean, marked boolean"


def fold(name: Column) -> Column:
    """A name in the models' alphabet, with two starts and an end."""
    low = F.regexp_replace(F.regexp_replace(F.lower(name), r"[0-9]", "0"), r"[^a-z0_]", "?")
    return F.concat(F.lit("^^"), low, F.lit("^"))


def train(source_files: DataFrame) -> tuple[dict[str, np.ndarray], dict[str, float]]:
    """Per language the bits of every symbol after every two, from the names of all contents, and their mean;
    a name counts once for each content it occurs in."""
    quiet = F.when(language().isin(_HASH), F.regexp_replace("content", _QUIET[True], " ")).otherwise(F.regexp_replace("content", _QUIET[False], " "))
    used = F.array_distinct(F.regexp_extract_all(quiet, F.lit(r"([A-Za-z_$][A-Za-z0-9_$]*)"), F.lit(1)))
    names = source_files.where(F.col("content").isNotNull()).select(language().alias("lang"), F.explode(used).alias("name")).where("lang is not null")
    names = names.groupBy("lang", "name").agg(F.count("*").alias("n")).select("lang", "n", fold(F.col("name")).alias("w"))
    grams = names.select("lang", "n", F.explode(F.expr("transform(sequence(1, length(w) - 2), i -> substring(w, i, 3))")).alias("g")).groupBy("lang", "g").agg(F.sum("n").alias("n"))
    cubes: dict[str, np.ndarray] = {}
    for lang, g, n in grams.collect():
        cubes.setdefault(lang, np.zeros((30, 30, 30)))[tuple(CODE[c] for c in g)] += n
    out = {}
    for lang, tri in cubes.items():
        two = tri.sum(axis=0)
        one = two.sum(axis=0) + 1
        back = (two + 5 * one / one.sum()) / (two.sum(axis=1, keepdims=True) + 5)
        out[lang] = -np.log2((tri + 5 * back[None]) / (tri.sum(axis=2, keepdims=True) + 5))
    return out, {lang: float((tri * out[lang]).sum() / tri.sum()) for lang, tri in cubes.items()}


def _bits(cube: np.ndarray, name: str) -> float:
    """Mean bits a character of a name."""
    a = b = CODE["^"]
    total = 0.0
    for c in name.lower():
        k = CODE.get(c, CODE["0"] if c.isdigit() else CODE["?"])
        total += cube[a, b, k]
        a, b = b, k
    return (total + cube[a, b, CODE["^"]]) / (len(name) + 1)


def _called(lang: str | None, comments: list[str], plain: str) -> set[str]:
    """Names that a file gives itself, in lower case."""
    out = {g for c in comments for m in _LICENCE.finditer(c) for g in m.groups() if g} | {m.group(1) for c in comments for m in [_TITLE.match(c)] if m}
    if lang == "php":
        out |= set(_NAMESPACE.findall(plain))
    declared = [_PART.findall(n) for n in set(_DECLARED.findall(plain))]
    if len(declared) >= PREFIX_DECLARED:
        prefix, n = Counter(p[0].lower() for p in declared if len(p) > 1).most_common(1)[0] if any(len(p) > 1 for p in declared) else ("", 0)
        out |= {prefix} if n >= PREFIX_SHARE * len(declared) else set()
    return {n.lower() for n in out}


def _diversity(names: set[str]) -> float:
    """Distinct forms or distinct parts a name, whichever is fewer (forms: names without their digits)."""
    parts = {p.lower() for n in names for p in _PART.findall(n) if not p.isdigit()}
    return min(len({_DIGITS.sub("0", n) for n in names}), len(parts)) / max(1, len(names))


def _scores(models) -> object:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        (cubes, means), known = models.value, {}

        def excess(lang: str | None, names: set[str]) -> float:
            """Bits a character above the mean of the language's names; of another language's, if that is less."""
            best = None
            for k in sorted(cubes, key=lambda k: k != lang):
                total = 0.0
                for n in names:
                    if (k, n) not in known:
                        if len(known) > 400_000:
                            known.clear()
                        known[k, n] = _bits(cubes[k], n)
                    total += known[k, n]
                mine = total / len(names) - means[k]
                best = mine if best is None else min(best, mine)
                if best < MANGLED_EXCESS:
                    break
            return 0.0 if best is None else best

        for b in batches:
            out = []
            for path, repo, lang, text in zip(b["file_path"], b["repo"], b["lang"], b["content"]):
                quiet = _QUIET_RX[lang in _HASH]
                spans = quiet.findall(text)
                comments = [x for x in spans if x[0] in "/#" or x.startswith('"' * 3)]
                strings = sum(len(_BLANK.sub("", x)) - 2 for x in spans if x[0] in "'\"" and not x.startswith('"' * 3))
                plain = quiet.sub(" ", text)
                names, chars = set(_NAME.findall(plain)), len(_BLANK.sub("", text))
                literal = strings + sum(map(len, _NUMBER.findall(plain)))
                out.append(
                    (
                        path, repo, excess(lang, names) if names else 0.0, len(names), _diversity(names), literal / max(1, chars), chars, sorted(_called(lang, comments, plain)),
                        any(map(_PASSED_ON.search, comments)), any(map(_MARK.search, comments)),
                    )
                )
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _SCORES.split(", ")])

    return run


def _path_reason(path: Column) -> Column:
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    name = F.substring_index(p, "/", -1)
    inside = lambda words: p.rlike("/(" + "|".join(w.replace(".", "\\.") for w in words) + ")/")
    return (
        F.when(inside(PACKAGE_DIRS) | (p.rlike("/vendor/[^/]+/.") & ~p.rlike("/src/(.*/)?vendor/")), "vendored")
        .when(name.rlike(DELIVERED_NAMES) | p.rlike(DELIVERED_DIRS), "minified")
        .when(inside(GENERATED_DIRS) | name.rlike(GENERATED_NAMES), "generated")
    )


def scores(symbols: DataFrame, source_files: DataFrame) -> DataFrame:
    """One row per file of ``symbols`` (type file) with its scores; null scores without content."""
    ship(symbols.sparkSession)
    files = symbols.where("type = 'file'").where(F.col("file_path").isNotNull()).select("file_path").distinct()
    models = symbols.sparkSession.sparkContext.broadcast(train(source_files))
    judged = current_files(source_files).where(F.col("content").isNotNull()).join(files, "file_path", "left_semi").mapInPandas(_scores(models), _SCORES)
    return files.join(judged, "file_path", "left")


def style_bits(called: DataFrame) -> DataFrame:
    """called (repo, name, n files) -> (repo, name, bits): bits a character of the name under the trigram model
    of the names in its own repository."""
    w = called.select("repo", "name", "n", fold(F.col("name")).alias("w"))
    spots = w.select("repo", "name", "n", F.explode(F.expr("transform(sequence(1, length(w) - 2), i -> substring(w, i, 3))")).alias("g"))
    tri = spots.groupBy("repo", "g").agg(F.sum("n").alias("of3"))
    two = tri.groupBy("repo", F.substring("g", 1, 2).alias("h")).agg(F.sum("of3").alias("of2"))
    cost = tri.withColumn("h", F.substring("g", 1, 2)).join(two, ["repo", "h"]).select("repo", "g", (-F.log2((F.col("of3") + 0.1) / (F.col("of2") + 3))).alias("cost"))
    return spots.join(cost, ["repo", "g"]).groupBy("repo", "name").agg(F.avg("cost").alias("bits"))


def judged(symbols: DataFrame, source_files: DataFrame) -> DataFrame:
    """Every file with its scores and what each rule says (``mangled``, ``template``, ``style``, ``literal``,
    ``marked``, ``by_path``); the rules do not look at each other."""
    cuts = Cuts(symbols.sparkSession, "handwritten")
    s = cuts.write(scores(symbols, source_files))
    names = s.where("repo is not null").select("file_path", "repo", "passed_on", F.explode("called").alias("name"))
    called = names.groupBy("repo", "name").agg(F.count("*").alias("n"))
    spread = called.groupBy("name").agg(F.count("*").alias("repos"))
    foreign = style_bits(called).where(F.col("bits") >= FOREIGN_BITS).where(F.col("name") != F.lower("repo")).join(spread, "name")
    hit = names.join(foreign, ["repo", "name"]).where(F.col("passed_on") | (F.col("repos") >= FOREIGN_REPOS))
    hit = hit.groupBy("file_path").agg(F.max(F.struct("bits", "name")).alias("h")).select("file_path", F.col("h.bits").alias("style_bits"), F.col("h.name").alias("foreign_name"))
    out = s.join(hit, "file_path", "left").select(
        "file_path", "repo", "excess", "diversity", "literals", "style_bits", "foreign_name",
        ((F.col("excess") >= MANGLED_EXCESS) & (F.col("names") >= MANGLED_NAMES)).alias("mangled"),
        ((F.col("diversity") <= TEMPLATE_DIVERSITY) & (F.col("names") >= TEMPLATE_NAMES)).alias("template"),
        F.col("style_bits").isNotNull().alias("style"),
        ((F.col("literals") >= DATA_SHARE) & (F.col("chars") >= DATA_CHARS)).alias("literal"),
        F.coalesce("marked", F.lit(False)).alias("marked"), _path_reason(F.col("file_path")).alias("by_path"),
    )
    return cuts.finish(out)


def not_handwritten(symbols: DataFrame, source_files: DataFrame) -> DataFrame:
    """(file_path, repo, reason, rule, score, and the scores of all rules) of every file that is not hand-written."""
    j = judged(symbols, source_files)
    one = lambda reason, rule, score: F.struct(reason.alias("reason"), F.lit(rule).alias("rule"), score.alias("score"))
    none = F.lit(None).cast("double")
    first = (
        F.when(F.col("mangled"), one(F.lit("minified"), "mangled", F.col("excess")))
        .when(F.col("style"), one(F.lit("vendored"), "style", F.col("style_bits")))
        .when(F.col("template"), one(F.lit("generated"), "template", F.col("diversity")))
        .when(F.col("literal") & F.col("by_path").isNull() & ~F.col("marked"), one(F.lit("data"), "literals", F.col("literals")))
        .when(F.col("marked"), one(F.lit("generated"), "mark", none))
        .when(F.col("by_path").isNotNull(), one(F.col("by_path"), "path", none))
    )
    j = j.withColumn("f", first).where("f is not null")
    return j.select("file_path", "repo", "f.reason", "f.rule", "f.score", "excess", "diversity", "literals", "style_bits", "foreign_name")


def rules(symbols: DataFrame, source_files: DataFrame) -> DataFrame:
    """(rule, files, alone): how many files each rule finds, and how many of them no other rule does."""
    held = ["mangled", "style", "template", "literal", "marked", "path"]
    j = judged(symbols, source_files).withColumn("path", F.col("by_path").isNotNull())
    flags = [F.coalesce(c, F.lit(False)) for c in held]
    found = j.select(F.inline(F.array(*[F.struct(F.lit(c).alias("rule"), f.alias("holds")) for c, f in zip(held, flags)])), sum((f.cast("int") for f in flags), F.lit(0)).alias("n")).where("holds")
    return found.groupBy("rule").agg(F.count("*").alias("files"), F.count(F.when(F.col("n") == 1, 1)).alias("alone"))
