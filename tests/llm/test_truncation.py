import pytest

from loomgraph.llm import truncation as T

DOC = "doc_id long, text string, source string, ending string, n long"
WHOLE = [
    "A sentence that ends.", "Is it?", "- entry one\n- entry two", "1. first\n2. second in `code`", "See https://docs.example.invalid/page/12", "text.\n\n-- the build desk", "text.\n\nRefs: AB-12",
    "```\ncode()\n```", "| a | b |\n| 1 | 2 |", "<p>para</p>", "/**\n * All said.\n */", "and links, names, and so on...", "nodes, edges usw. …", "Quoted \"end.\"", "text.\r\n  \t",
]
CUT = ["A sentence that sto", "A sentence that stops", "We copy it beca...", "We copy it [...]", "```\ncode(", "/**\n * We say", "| a | b |\n| 1 |\n| 2", "- entry with `cod", "<p>one</p>\n<p>two is", "and then,", "Calling `x` and"]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "whole", 1) for r in rows], DOC)


def test_endings(spark):
    df = frame(spark, [(i, t, "s") for i, t in enumerate(WHOLE + CUT)])
    got = {r.doc_id for r in T.cuts(df).collect()}
    assert got == set(range(len(WHOLE), len(WHOLE) + len(CUT)))


def test_nulls_empty_and_repeats(spark):
    df = frame(spark, [(1, None, "s"), (2, "", None), (3, "  \n", None), (4, "cut he", None), (4, "cut he", None), (5, "x" * 200_000, "s"), (None, "cut", "s")])
    assert sorted(r.doc_id for r in T.cuts(df).collect()) == [4, 4, 5]
    assert T.cuts(frame(spark, [])).count() == 0 and T.rates(frame(spark, [])).count() == 0
    rate = {r.source: (r.documents, r.cut) for r in T.rates(df).collect()}
    assert rate[None] == (3, 2) or rate[None] == (2, 2)


SIZE = {
    "chars": len, "utf8": lambda s: len(s.encode()), "utf16": lambda s: len(s.encode("utf-16-be")) // 2, "entities": lambda s: len(s) + 4 * s.count("&") + 3 * (s.count("<") + s.count(">")),
    "json": lambda s: len(s) + s.count('"') + s.count("\\") + s.count("\n"), "crlf": lambda s: len(s) + s.count("\n"),
}
MARK = {"utf16": "\U0001f600", "json": '"', "crlf": "\n"}


@pytest.mark.parametrize("unit,length", [("chars", 120), ("utf8", 130), ("utf16", 140), ("entities", 150), ("json", 160), ("crlf", 170)])
def test_hidden_limit_in_its_unit(spark, unit, length):
    """Texts stored in a field of ``length`` units: the limit and its unit come out. One that ends in a list
    entry is a cut by nothing but its length in that unit."""
    size, rows = SIZE[unit], []
    for i in range(200):
        text = "".join((MARK.get(unit, "é") if (i + j) % (5 + i % 7) == 0 else ('"' if unit == "crlf" else "&") if (i * j) % 11 == 3 else "w") + ("ord " if j % 2 else "a") for j in range(80))
        n = length if i % 2 else 40 + i
        while size(text) > n:
            text = text[:-1]
        rows.append((i, text.rstrip() + ("" if size(text.rstrip()) == length else "."), "Src-A"))
    entry = "We keep.\n\n- " + MARK.get(unit, "&").strip() + " one\n- two "
    entry += "w" * (length - size(entry))
    rows += [(999, entry, "src_a"), (998, entry + "w" * 7, "src_a"), (997, entry, "src_b")]
    assert size(entry) == length
    assert [(r.source, r.unit, r.length) for r in T.limits(frame(spark, rows)).collect()] == [("src_a", unit, length)]
    got = {r.doc_id: (r.reason, r.unit, r.length) for r in T.cuts(frame(spark, rows)).collect()}
    assert got[999] == ("entry at a limit", unit, length) and 998 not in got and 997 not in got
    assert got[1] == ("open at a limit", unit, length)


def test_cut_inside_word_and_closing_line(spark):
    rows = [(i, f"- removed registry {i}\n- kept registry", "s") for i in range(40)] + [(100, "- removed\n- kept regis", "s")]
    rows += [(200 + i, f"Text {i}.\n\n-- the indexing crew", "s") for i in range(40)] + [(300, "Text.\n\n-- the index", "s")]
    got = {r.doc_id: r.reason for r in T.cuts(frame(spark, rows)).collect()}
    assert set(got) == {100, 300} and set(got.values()) <= {"inside a word", "inside a closing line"}


def test_two_limits_of_one_source_in_two_units(spark):
    rows = [(i, ("word " * 60)[: 10 + i * 3 if i % 2 else 200].rstrip() + "z" * (0 if i % 2 else 200 - len(("word " * 60)[:200].rstrip())), "s") for i in range(90)]
    for i in range(40):
        t = "é" * (5 + i) + "word " * 80
        while len(t.encode()) > 300:
            t = t[:-1]
        rows.append((500 + i, t if not t.endswith(" ") else t[:-1] + "q", "s"))
    got = {(r.unit, r.length) for r in T.limits(frame(spark, rows)).collect()}
    assert got == {("chars", 200), ("utf8", 300)}


def test_long_closing_lines(spark):
    line = "See https://docs.example.invalid/" + "handbook/" * 9 + "page"
    rows = [(i, f"Text {i}.\n\n{line}", "s") for i in range(40)] + [(100, f"Text.\n\n{line[:90]}", "s")]
    assert {r.doc_id: r.reason for r in T.cuts(frame(spark, rows)).collect()} == {100: "inside a closing line"}


def test_whole_endings_at_a_limit(spark):
    fill = lambda end: ("We keep the words " * 20)[: 200 - len(end)].rstrip().ljust(200 - len(end), "w") + end
    rows = [(i, fill(f" sto{i}x"), "s") for i in range(30)] + [(100 + i, f"The file foo.py is read {i} times.", "s") for i in range(5)]
    ends = [" in the list (of names)", ' the name "a"', " list; of;", " in foo.", " as e.g."]
    rows += [(200 + i, fill(x), "s") for i, x in enumerate(ends)] + [(300, fill(" that ends."), "s"), (301, fill(" (that ends.)"), "s")]
    rows += [(400 + i, "w" + fill(x), "s") for i, x in enumerate(ends)]
    got = {r.doc_id for r in T.cuts(frame(spark, rows)).collect()}
    assert got == {*range(30), *range(200, 205)}
