"""Lexer-state maps and bracket summaries of file chunks, with an associative composition.

A chunk is a run of whole lines. Its *map* says, for every state the lexer can be in at its start,
the state at its end and which brackets stay open or unmatched, so that the maps of neighbouring
chunks compose without looking at the text again: ``compose(a, compose(b, c)) ==
compose(compose(a, b), c)``. States are ``c`` code, ``*`` block comment, `` ` `` template text, ``h``
inline text before PHP code, ``s``/``d`` PHP strings over lines, ``'``/``"`` Python triple quotes and
``H:label`` a PHP heredoc (labels are the ones the file opens).

Inside a chunk, ``cuts`` are line starts that begin a statement on their own wherever no bracket is
open, with the bracket depth relative to the chunk's start. Whether a line begins a statement also
depends on what stands before it (a stop or a closing brace; for Python no decorator); where that lies
in an earlier chunk, the cut is *conditional* on the summary's ``last``, which composes like the rest.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

LABEL = re.compile(r"<<<[ \t]*['\"]?([^\W\d]\w*)")
PAIRS = {")": "(", "]": "[", "}": "{", "`": "`"}

_WORDS = {
    "js": r"(?:export|import|class|function|const|let|var|interface|type|enum|abstract|declare|async function)\b",
    "php": r"(?:namespace|use|abstract|final|class|interface|trait|enum|function)\b",
    "py": r"[^\s#)\]}]",
}
_JS = re.compile(r"//[^\n]*|(?P<o>/\*)|'(?:[^'\\\n]|\\[\s\S])*'|\"(?:[^\"\\\n]|\\[\s\S])*\"|(?P<t>`)|(?P<b>[{}()\[\]])|(?P<r>(?<![\w)\]}$.\s])\s*/(?![*/])(?:[^\\/\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/)|(?P<n>\n(?=" + _WORDS["js"] + "))")
_PHP = re.compile(r"(?://|#(?!\[))(?:(?!\?>)[^\n])*|(?P<o>/\*)|(?P<q>['\"])|(?P<h><<<[ \t]*(['\"]?)(?P<l>[^\W\d]\w*)\4\r?\n)|(?P<e>\?>)|(?P<b>[{}()\[\]])|(?P<n>\n(?=" + _WORDS["php"] + "))")
_PY = re.compile(r"#[^\n]*|(?P<m>'''|\"\"\")|'(?:[^'\\\n]|\\[\s\S])*'|\"(?:[^\"\\\n]|\\[\s\S])*\"|(?P<b>[{}()\[\]])|(?P<n>\n(?=" + _WORDS["py"] + "))")
_START = {
    "js": re.compile(_WORDS["js"]),
    "php": re.compile(_WORDS["php"]),
    "py": re.compile(r"(?:def|class|import|from|async def)\b|[A-Z_]+\s*="),
}
_ENTER = re.compile(r"<\?(?:php\b|=)", re.I)
_TEMPLATE = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*(`|\$\{)?")
_UNTIL = {q: re.compile(r"(?:[^\\]|\\[\s\S])*?" + q) for q in ("'", '"', "'" * 3, '"' * 3)}


#: Words of rules that hold for a file as a whole, so that its pieces cannot be judged alone: imports that
#: must come first, names used before ``global``, comments that only scripts have.
FILE_RULE = {"js": re.compile(r"<!--|-->"), "php": re.compile(r"__halt_compiler|\bend(?:if|for|foreach|while|switch|declare)\b", re.I), "py": re.compile(r"__future__|\bglobal\b|\\\r?\n")}
#: Text whose brackets this lexer may see wrongly: regular expressions and JSX, strings that hold code or go
#: on over lines, unusual line ends. Without it a valid text has a balanced summary.
DOUBT = {
    "js": re.compile(r"(?<![/*])/(?![/*])|\*/[ \t]*[^\s]|\\\r?\n|<!--|-->|^#!|\r(?!\n)|[\u2028\u2029]"),
    "php": re.compile(r"\{\$|\$\{|`|<<<|__halt_compiler|<\?(?!php\b|=)|\r(?!\n)", re.I),
    "py": re.compile(r"\b(?:[ft]r?|r[ft])['\"]|\\\r?\n|\r(?!\n)", re.I),
}


@dataclass(frozen=True)
class Summary:
    """From one entry state: exit state, unmatched closers, open openers, whether the text is odd, and the
    last significant character (``@`` for Python: a decorator waits) or nothing if the text has none."""

    out: str
    closers: str = ""
    openers: str = ""
    odd: bool = False
    last: str = ""
    cuts: tuple[tuple[int, int, bool], ...] = field(default=(), compare=False)


def family(lang: str) -> str:
    return lang if lang in ("php", "py") else "js"


def file_rule(lang: str, text: str) -> bool:
    return bool(FILE_RULE[family(lang)].search(text))


def doubtful(lang: str, text: str) -> bool:
    return lang == "tsx" or bool(DOUBT[family(lang)].search(text))


def states(lang: str, labels: list[str]) -> list[str]:
    return {"js": ["c", "*", "`"], "py": ["c", "'", '"'], "php": ["h", "c", "*", "s", "d", *("H:" + x for x in labels)]}[family(lang)]


def _match(closers: str, openers: str, b: str) -> tuple[str, str, bool]:
    """Add one closing bracket to a reduced bracket word."""
    if not openers:
        return closers + b, openers, False
    want = "$" if b == "}" and openers[-1] == "$" else PAIRS[b]
    return closers, openers[:-1], openers[-1] != want


def scan(lang: str, text: str, state: str) -> Summary:
    kind = family(lang)
    rx = {"js": _JS, "php": _PHP, "py": _PY}[kind]
    at, closers, openers, odd, cuts, size = 0, "", "", False, [], len(text)
    starts, notes = _START[kind], {}  # notes: end of a comment -> its start
    opened, decorator, seen = 0, None, False

    def before(i: int) -> str:
        """The last significant character before ``i``, or nothing."""
        while True:
            while i and text[i - 1].isspace():
                i -= 1
            if not i or i not in notes:
                return text[i - 1 : i]
            i = notes[i]

    def line(i: int) -> None:
        nonlocal decorator, seen
        if kind != "py":
            if starts.match(text, i):
                c = before(i)
                if not c or c in ";}":
                    cuts.append((i, len(openers) - len(closers), not c))
            return
        c = text[i : i + 1]
        if not c or c in " \t\r\n\f#)]}":
            return
        depth = len(openers) - len(closers)
        if decorator is not None:
            decorator = None if depth == decorator and c != "@" else decorator
        elif c == "@":
            decorator = depth
            cuts.append((i, depth, not seen))
        elif starts.match(text, i):
            cuts.append((i, depth, not seen))
        seen = True

    if state == "c":
        line(0)
    while at < size:
        if state == "h":
            m = _ENTER.search(text, at)
            if not m:
                break
            at, state = m.end(), "c"
        elif state == "*":
            e = text.find("*/", at)
            if e < 0:
                break
            at, state = e + 2, "c"
            notes[at] = opened
        elif state in ("'", '"') and kind == "py":
            m = _UNTIL[state * 3].match(text, at)
            if not m:
                break
            at, state = m.end(), "c"
        elif state in ("s", "d"):
            m = _UNTIL["'" if state == "s" else '"'].match(text, at)
            if not m:
                break
            at, state = m.end(), "c"
        elif state.startswith("H:"):
            m = re.compile(rf"^[ \t]*{re.escape(state[2:])}\b", re.M).search(text, at)
            if not m:
                break
            at, state = m.end(), "c"
        elif state == "`":
            m = _TEMPLATE.match(text, at)
            at = m.end()
            if m.group(1) == "`":
                closers, openers, bad = _match(closers, openers, "`")
                odd, state = odd or bad, "c"
            elif m.group(1):
                openers, state = openers + "$", "c"
            elif at >= size:
                break
            else:
                at += 1
        else:
            m = rx.search(text, at)
            if not m:
                break
            at, g = m.end(), m.lastgroup
            if g is None:
                if text[m.start()] in "/#":
                    notes[at] = m.start()
            elif g == "o":
                state, opened = "*", m.start()
            elif g == "t":
                openers, state = openers + "`", "`"
            elif g == "m":
                state = m.group()[0]
            elif g == "q":
                state = "s" if m.group() == "'" else "d"
            elif g == "e":
                state = "h"
            elif g == "h":
                state = "H:" + m.group("l")
            elif g == "n":
                line(at)
            elif g == "b":
                b = m.group()
                if b in "([{":
                    openers += b
                else:
                    resume = b == "}" and openers.endswith("$")
                    closers, openers, bad = _match(closers, openers, b)
                    odd |= bad
                    state = "`" if resume else state
    if kind == "py":
        last = "@" if decorator is not None else ";" if seen else ""
    else:
        last = before(size if state != "*" else opened)
    return Summary(state, closers, openers, odd, last, tuple(cuts))


def chunk_map(lang: str, text: str, labels: list[str]) -> dict[str, Summary]:
    return {s: scan(lang, text, s) for s in states(lang, labels)}


def join(a: Summary, b: Summary) -> Summary:
    closers, openers, odd = a.closers, a.openers, a.odd or b.odd
    for c in b.closers:
        odd |= c == "}" and openers.endswith("$")  # a template resumed: b's map did not know
        closers, openers, bad = _match(closers, openers, c)
        odd |= bad
    return Summary(b.out, closers, openers + b.openers, odd, b.last or a.last)


def compose(a: dict[str, Summary], b: dict[str, Summary]) -> dict[str, Summary]:
    return {s: join(x, b[x.out]) for s, x in a.items()}


def lines(text: str, size: int) -> list[str]:
    """Runs of whole lines of at least ``size`` characters (the last may be shorter)."""
    out, at = [], 0
    while len(text) - at > size:
        e = text.find("\n", at + size - 1)
        if e < 0:
            break
        out.append(text[at : e + 1])
        at = e + 1
    return [*out, text[at:]] if at < len(text) or not out else out
