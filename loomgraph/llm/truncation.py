"""Text cut off by field limits (problem 8).

Two kinds of evidence are joined.

*Storage limits.* The length of every text is recomputed in each unit a field might have been
measured in (characters, UTF-8 bytes, UTF-16 units, with entities escaped, JSON-escaped, with CRLF
line ends, without a closing ellipsis). Per source and unit the lengths are counted; a limit is a
length that occurs far more often than its neighbours. A limit
leaves weaker echoes in other units: a peak is dropped when most of its texts also form a stronger
peak in another unit. Several limits of a source are kept, whatever their units.

*Endings.* The last line is judged by JVM expressions:

* ``open``: stops inside a sentence, code fence, comment block, inline code, table row or tag, or with
  an ellipsis put after the cut (but not one that closes an enumeration, "and so on ...");
* ``weak``: ends like a whole text without punctuation (list entry, link, signature, reference);
* ``whole``: everything else, in any case at the end of a sentence, block, table or tag.

Limits are judged first: a text of exactly the length of a limit of its source is a cut unless its
ending is whole, and a whole ending is tested more strictly there (below). Elsewhere an open ending is a
cut, and a weak ending is one if it stops inside a word (its last word hardly occurs inside texts and begins known ones), or
inside a customary closing line (it, or its shape, is a proper prefix of a far more frequent one). A list
entry is open when the entry before it ends with a stop, when it is one word below longer entries, or
when it breaks off after a sentence. A whole ending is a cut only at exactly the length of a limit, and
there by a stricter test: a bracket, quote, tag or semicolon that closes no sentence of prose, or a dot
of an abbreviation or of a token that goes on behind it more often than not.

Null and empty texts are never cut; null sources form one source. Texts are judged row by row, so
repeated rows get the same result. All counts run over all documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loomgraph.llm.text import norm_source
from loomgraph.session import Cuts, maybe_broadcast

# Phrases that close an enumeration before an ellipsis.
ENUMERATION_ENDS = ["and so on", "and so forth", "and more", "etc", "et cetera", "usw", "und so weiter", "etcétera", "y así sucesivamente", "et ainsi de suite"]
# Words that open a reference line.
REFERENCE_WORDS = ["Refs", "Ref", "Fixes", "Closes", "Resolves", "See", "Related", "Signed-off-by", "Reviewed-by", "Cc"]

# Abbreviations that no sentence ends with.
ABBREVIATIONS = ["e.g", "i.e", "cf", "vs", "viz", "bzw", "z.B", "d.h", "p. ej"]

#: What ``\\s`` means to a regular expression, as characters to strip.
BLANKS = " \t\n\x0b\f\r"
ENTRY = r"^([-*+•]|\d+[.)])\s+\S"
_DOTS = r"\s*(?:\[\s*(?:\.\.\.|…)\s*\]|\.\.\.|…)$"
#: A limit has at least this many texts, and this many times the mean of the lengths around it.
MIN_PEAK, PEAK_FACTOR, NEIGHBOURS = 5, 5, 10
#: A peak is an echo when this share of its texts lies in a stronger one of another unit.
ECHO_SHARE = 0.6
#: A known word occurs in so many texts before their last word; a last word is broken when it occurs so
#: many times less often than a known word that it begins.
KNOWN_TEXTS, BROKEN_FACTOR = 30, 100
#: A closing line or its shape is broken when a longer one that it begins is so many times as frequent.
LINE_FACTOR = 10
#: A dot lies inside a known token when so many texts go on behind it, and more than end the token there.
KNOWN_TOKENS = 2
_TOKEN = r"[\p{L}\p{N}_][\p{L}\p{N}_./-]*"


def _count(c: Column, piece: str) -> Column:
    """Occurrences of an ASCII piece; byte lengths are known without a walk over the text."""
    return (F.octet_length(c) - F.octet_length(F.replace(c, F.lit(piece), F.lit("")))) / len(piece)


def units(text: Column) -> Column:
    """Map of unit -> length of the text in it."""
    lf = F.replace(text, F.lit("\r\n"), F.lit("\n"))
    chars, size = F.length(text), F.length(text) - _count(text, "\r\n")
    breaks, quotes = _count(lf, "\n"), _count(text, '"') + _count(text, "\\")
    entities = 4 * _count(text, "&") + 3 * (_count(text, "<") + _count(text, ">"))
    end = F.rtrim(text, F.lit(BLANKS))
    dotted = end.endswith("...") | end.endswith("…") | end.endswith("]")
    pairs = {
        "chars": chars,
        "utf8": F.octet_length(text),
        "utf16": F.octet_length(F.encode(text, "UTF-16BE")) / 2,
        "entities": chars + entities,
        "json": size + quotes + breaks,
        "crlf": size + breaks,
        "lf": size,
        "before_dots": F.when(dotted, F.length(F.regexp_replace(text, _DOTS, ""))).otherwise(chars),
    }
    return F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), v.cast("int"))])


def endings(documents: DataFrame) -> DataFrame:
    """(doc_id, source, ending, last_line, last_word, closed, dotted, units) of every text, in one pass; the
    ending is null for empty texts. Tests of the whole text stand behind cheap ones of its end."""
    t = F.rtrim(F.replace(F.replace(F.ltrim(F.col("text"), F.lit("\ufeff")), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")), F.lit(BLANKS))
    d = documents.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", F.coalesce(norm_source(), F.lit("")).alias("source"), t.alias("t"), units(F.col("text")).alias("units"))
    d = d.withColumn("last_line", F.trim(F.substring_index("t", "\n", -1)))
    c, line = F.col("t"), F.col("last_line")
    dots = line.rlike(_DOTS)
    listing = F.regexp_replace(c, _DOTS, "").rlike("(?i)\\b(" + "|".join(ENUMERATION_ENDS) + r")\.?\s*$")
    in_fence = c.contains("```") & ((_count(c, "```") % 2) == 1)
    block = F.ltrim(c).startswith("/*")
    block_open = block & ~c.endswith("*/")
    tick_open = line.contains("`") & ((_count(F.replace(line, F.lit("```"), F.lit("")), "`") % 2) == 1)
    para_open = c.contains("</p>") & (_count(c, "<p>") > _count(c, "</p>"))
    row = line.startswith("|")
    entry = line.rlike(ENTRY) & ~block
    before = F.trim(F.substring_index(F.substring_index(c, "\n", -2), "\n", 1))
    words = lambda x: F.size(F.regexp_extract_all(x, F.lit(r"(\S+)"), F.lit(1))) - 1
    siblings = before.rlike(ENTRY) & (before != line)
    entry_open = (siblings & before.rlike(r"[.!?]$")) | (siblings & (words(line) <= 1) & (words(before) >= 3)) | line.rlike(ENTRY + r".*[.!?]\s+\p{L}")
    reference = line.rlike("^(" + "|".join(REFERENCE_WORDS) + r")\b:?\s") | line.rlike(r"https?://\S+$")
    signature = line.rlike(r"^(--|—)\s*\S")
    heading = line.rlike(r"^#{1,6}\s")
    stop = line.rlike(r"""[.!?。！？]["'”’)\]»*_`]*$""")
    kind = (
        F.when(c == "", None)
        .when(in_fence | block_open | tick_open | para_open, "open")
        .when(dots, F.when(listing, "whole").otherwise("open"))
        .when(row, F.when(line.endswith("|") & (F.length(line) > 1), "whole").otherwise("open"))
        .when(stop & ~reference, "whole")
        .when(line.rlike(r"(```|\*/|>|[;}\])\"”»])$") & ~reference, "whole")
        .when(line.rlike(r"^`[^`]+`$"), "whole")
        .when(entry & entry_open, "open")
        .when(entry | reference | signature, F.when(stop, "whole").otherwise("weak"))
        .when(heading & (F.instr(c, "\n") == 0), "weak")
        .otherwise("open")
    )
    # what only whole endings at a limit are asked
    prose = line.rlike(r"(?<!\p{L})(?:\p{L}{2,}+,? ){3}") & ~entry & ~row & ~block & ~in_fence
    closed = prose & line.rlike(r"[;}\])\"”»>]$") & ~stop & ~line.rlike(r"(</[\w.:-]+>|/>|-->)$")
    closed = closed | line.rlike(r"(?i)\b(" + "|".join(x.replace(".", r"\.") for x in ABBREVIATIONS) + r")\.$")
    dotted = F.regexp_extract(line, r"(?<![\p{L}\p{N}_./-])(" + _TOKEN + r"(?<!\.)\.)$", 1)
    d = d.select("doc_id", "source", kind.alias("ending"), "last_line", closed.alias("_c"), dotted.alias("_d"), "units")
    weak, whole = F.col("ending") == "weak", F.col("ending") == "whole"
    return d.select(
        "doc_id", "source", "ending", F.when(weak, F.col("last_line")).alias("last_line"), F.when(weak, F.regexp_extract("last_line", r"([\p{L}]+)$", 1)).alias("last_word"),
        (whole & F.col("_c")).alias("closed"), F.when(whole, F.col("_d")).otherwise("").alias("dotted"), "units",
    )


def _limits(store: Cuts, ends: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """The limits of ``ends`` (source, unit, length, n, around, open_share, strength), the texts that lie at one
    (doc_id, limit: its strongest) and the number of limits."""
    lengths = (
        ends.select("source", "ending", F.explode("units").alias("unit", "length"))
        .groupBy("source", "unit", "length").agg(F.count("*").alias("n"), F.count(F.when(F.col("ending") == "open", 1)).alias("n_open"))
    )
    near = W.partitionBy("source", "unit").orderBy("length").rangeBetween(-NEIGHBOURS, NEIGHBOURS)
    peaks = lengths.withColumn("around", (F.sum("n").over(near) - F.col("n")) / (2 * NEIGHBOURS)).where(
        (F.col("n") >= MIN_PEAK) & (F.col("n") >= PEAK_FACTOR * F.col("around") + 2) & (4 * F.col("n_open") >= F.col("n"))
    )
    strength = F.struct((F.col("n") - F.col("around")).alias("excess"), F.expr("unit = 'chars'").alias("plain"), "unit", "length")
    peaks, count = store.write_counted(peaks.withColumn("strength", strength))
    keys = maybe_broadcast(peaks.select("source", "unit", "length", "strength"), count)
    at = store.write(ends.select("doc_id", "source", F.explode("units").alias("unit", "length")).join(keys, ["source", "unit", "length"]).select("doc_id", "source", "strength").distinct())
    own = at.groupBy("source", "strength").agg(F.count("*").alias("docs"))
    pairs = at.join(at.select("doc_id", "source", F.col("strength").alias("other")), ["doc_id", "source"]).where("other > strength and other.unit <> strength.unit")
    echoes = pairs.groupBy("source", "strength", "other").agg(F.count("*").alias("both")).join(own, ["source", "strength"]).where(F.col("both") >= ECHO_SHARE * F.col("docs")).select("source", "strength").distinct()
    found = store.write(peaks.join(echoes, ["source", "strength"], "left_anti"))
    held = at.join(maybe_broadcast(found.select("source", "strength"), count), ["source", "strength"], "left_semi").groupBy("doc_id").agg(F.max("strength").alias("limit"))
    return found, held, count


def _ends(store: Cuts, documents: DataFrame) -> DataFrame:
    return store.write(endings(documents)).where("ending is not null")


def limits(documents: DataFrame) -> DataFrame:
    """(source, unit, length, n, around, open_share): limits exposed by length peaks, each in its best
    unit. At a limit many texts (a quarter at least) must also end open: a length that is merely frequent, as of one
    text collected many times, is none."""
    store = Cuts(documents.sparkSession, "limits")
    found = _limits(store, _ends(store, documents))[0]
    return store.finish(found.select("source", "unit", "length", "n", F.round("around", 6).alias("around"), F.round(F.col("n_open") / F.col("n"), 6).alias("open_share")))


def _cut_words(documents: DataFrame, weak: DataFrame) -> DataFrame:
    """Last words of weak endings that hardly occur inside texts and begin known words."""
    inside = F.regexp_replace(F.rtrim("text", F.lit(BLANKS)), r"(?<!\p{L})\p{L}++$", "")
    words = F.array_distinct(F.regexp_extract_all(inside, F.lit(r"(?<![\p{L}\p{N}_./-])(\p{L}++)(?![\p{N}_/-])"), F.lit(1)))
    vocab = documents.where(F.col("text").isNotNull()).select(F.explode(words).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    last = weak.where("last_word != ''").select(F.col("last_word").alias("w")).distinct()
    # prefixes of known words and the words themselves in one table, so that the texts are read once
    begun = vocab.select(
        F.inline(F.expr(f"""concat(array(struct(w, n as own, cast(0 as bigint) as of)),
            transform(if(n >= {KNOWN_TEXTS} and length(w) > 1, sequence(1, length(w) - 1), array()), i -> struct(substring(w, 1, i) as w, cast(0 as bigint) as own, n as of)))"""))
    )
    begun = begun.join(last, "w", "left_semi").groupBy("w").agg(F.sum("own").alias("own"), F.max("of").alias("of"))
    return begun.where((F.col("of") > 0) & (F.col("own") * BROKEN_FACTOR <= F.col("of"))).select(F.col("w").alias("last_word"))


def _cut_tokens(documents: DataFrame, ends: DataFrame) -> DataFrame:
    """Last tokens with a dot (``foo.`` of ``foo.py``) behind which the texts go on more often than not."""
    last = ends.where("dotted != ''").select("dotted").distinct()
    if last.isEmpty():  # nobody asks: the texts need not be read
        return last
    inside = F.regexp_replace("text", r"(?<![\p{L}\p{N}_./-])" + _TOKEN + r"+\s*$", "")
    tokens = documents.where(F.col("text").isNotNull()).select(F.explode(F.array_distinct(F.regexp_extract_all(inside, F.lit("(" + _TOKEN + ")"), F.lit(1)))).alias("t")).where("contains(t, '.')")
    tokens = tokens.groupBy("t").agg(F.count("*").alias("n"))
    parts = tokens.select("t", "n", F.explode(F.expr(r"transform(sequence(1, size(split(t, '[.]')) - 1), i -> substring_index(t, '.', i) || '.')")).alias("dotted"))
    parts = parts.join(last, "dotted", "left_semi").groupBy("dotted").agg(F.sum(F.when(F.col("t") == F.col("dotted"), 0).otherwise(F.col("n"))).alias("on"), F.sum(F.when(F.col("t") == F.col("dotted"), F.col("n")).otherwise(0)).alias("off"))
    return parts.where((F.col("on") >= KNOWN_TOKENS) & (F.col("on") > F.col("off"))).select("dotted")


def _shape(line: str = "last_line"):
    """Form of a closing line: words as ``a``, numbers as ``9``, marks as they are."""
    return F.regexp_replace(F.regexp_replace(line, r"\p{L}+", "a"), r"\d+", "9")


def _begun(lines: DataFrame, col: str) -> DataFrame:
    """Values of ``col`` (with counts ``n``) that are a proper prefix of a far more frequent value."""
    often = lines.where((F.col("n") >= LINE_FACTOR) & (F.length(col) > 1))
    sizes = lines.agg(F.collect_set(F.length(col))).scalar()
    parts = often.withColumn("sizes", sizes).select("n", col, F.explode(F.expr(f"filter(sizes, i -> i < length({col}))")).alias("i")).select("n", F.expr(f"substring({col}, 1, i)").alias(col))
    parts = parts.groupBy(col).agg(F.max("n").alias("of"))
    return lines.join(parts, col).where(F.col("of") >= LINE_FACTOR * F.col("n")).select(col)


def _cut_lines(weak: DataFrame) -> DataFrame:
    """Closing lines (signatures, references) that are cut, by themselves or by their shape."""
    lines = weak.where(~F.col("last_line").rlike(ENTRY)).groupBy("last_line").agg(F.count("*").alias("n"))
    shaped = lines.withColumn("shape", _shape())
    shapes = shaped.groupBy("shape").agg(F.sum("n").alias("n"))
    return _begun(lines, "last_line").unionByName(shaped.join(_begun(shapes, "shape"), "shape", "left_semi").select("last_line")).distinct()


def cuts(documents: DataFrame) -> DataFrame:
    """(doc_id, source, reason, unit, length) of every text that was cut; unit and length are those of the limit
    that exposed it, null where the ending alone did."""
    store = Cuts(documents.sparkSession, "truncation")
    ends = _ends(store, documents)
    held = store.write(_limits(store, ends)[1])
    asked = ends.drop("units").where("ending != 'whole' or closed or dotted != ''").join(held, "doc_id", "left")
    asked = store.write(asked.where("ending != 'whole' or limit is not null"))
    judged = (
        asked.join(_cut_words(documents, asked.where("ending = 'weak' and limit is null")).withColumn("in_word", F.lit(True)), "last_word", "left")
        .join(_cut_lines(asked.where("ending = 'weak'")).withColumn("in_line", F.lit(True)), "last_line", "left")
        .join(_cut_tokens(documents, asked.where("ending = 'whole'")).withColumn("in_token", F.lit(True)), "dotted", "left")
    )
    reason = (
        F.when(F.col("limit").isNotNull(), F.when(F.col("ending") == "open", "open at a limit").when(F.col("ending") == "weak", "entry at a limit").when(F.col("closed"), "inside a sentence at a limit").when(F.col("in_token"), "inside a token at a limit"))
        .when(F.col("ending") == "open", "open ending")
        .when(F.col("in_line"), "inside a closing line")
        .when(F.col("in_word"), "inside a word")
    )
    return store.finish(judged.select("doc_id", "source", reason.alias("reason"), F.col("limit.unit").alias("unit"), F.col("limit.length").alias("length")).where("reason is not null"))


def rates(documents: DataFrame) -> DataFrame:
    """(source, documents, cut, rate): how often each source truncates; null source as null."""
    all_docs = documents.where(F.length("text") > 0).groupBy(F.coalesce(norm_source(), F.lit("")).alias("source")).agg(F.count("*").alias("documents"))
    cut = cuts(documents).groupBy("source").agg(F.count("*").alias("cut"))
    j = all_docs.join(cut, "source", "left").withColumn("cut", F.coalesce("cut", F.lit(0)))
    return j.select(F.nullif("source", F.lit("")).alias("source"), "documents", "cut", F.round(F.col("cut") / F.col("documents"), 6).alias("rate"))
