"""Extraction: source text to symbol and reference rows, one table-valued function a language.

Python is read with the interpreter's own ``ast``; PHP, JavaScript and TypeScript by declarations and
uses found in text whose comments and strings are blanked out, with owners from matching brackets.
These readers are approximate by design: a file that does not parse still yields what can be read.
Each file is one row in and a few rows out of ``mapInPandas``; nothing is kept across files, names are
resolved afterwards by joins.
"""

from __future__ import annotations

import ast
import bisect
import hashlib
import re
import warnings
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.schema import EXTRACTED
from loomgraph.session import ship

Row = tuple[str, str, str | None, str | None, str | None, int, int, str | None, str | None, str | None]

# Names that are no dependency.
PY_BUILTINS = {"print", "len", "range", "str", "int", "list", "dict", "set", "tuple"}
PHP_PRIMITIVES = {"string", "int", "float", "bool", "array", "object", "mixed", "void", "null", "callable", "iterable", "self", "static", "parent", "never", "false", "true"}
PHP_WORDS = {"if", "for", "foreach", "while", "switch", "match", "catch", "array", "list", "isset", "empty", "unset", "exit", "die", "echo", "print", "return", "function", "fn", "use", "new", "declare", "elseif"}
JS_WORDS = {"if", "for", "while", "switch", "catch", "return", "function", "super", "typeof", "new", "await", "import", "require", "define"}
HTTP_VERBS = {"GET", "POST", "PUT", "PATCH", "DELETE", "HEAD", "OPTIONS"}

_NOISE = re.compile(r"/\*[\s\S]*?\*/|//[^\n]*|'(?:[^'\\\n]|\\.)*'|\"(?:[^\"\\\n]|\\.)*\"|`(?:[^`\\]|\\[\s\S])*`")
_NOISE_PHP = re.compile(r"/\*[\s\S]*?\*/|(?://|#(?!\[))[^\n]*|'(?:[^'\\]|\\[\s\S])*'|\"(?:[^\"\\]|\\[\s\S])*\"")


class Text:
    """A source text, its blanked copy, line starts and bracket pairs."""

    def __init__(self, path: str, text: str, noise: re.Pattern):
        self.path, self.raw = path, text
        self.code = noise.sub(lambda m: re.sub(r"[^\n]", " ", m.group()), text)
        self.starts = [0, *(m.end() for m in re.finditer("\n", text))]
        self.pair, stack = {}, []
        for m in re.finditer(r"[{}]", self.code):
            if m.group() == "{":
                stack.append(m.start())
            elif stack:
                self.pair[stack.pop()] = m.start()
        self.owners: list[tuple[int, int, str, str, str]] = []

    def at(self, offset: int) -> tuple[int, int]:
        line = bisect.bisect_right(self.starts, offset)
        return line, offset - self.starts[line - 1]

    def body(self, offset: int) -> tuple[int, int]:
        """Range of the block that opens next, before any statement end."""
        m = re.compile(r"[{;]").search(self.code, offset)
        if not m or m.group() == ";":
            return offset, offset
        return m.start(), self.pair.get(m.start(), len(self.code))

    def expression(self, offset: int) -> tuple[int, int]:
        """Range of the expression that starts at an offset: to its ``;``, an unmatched closing bracket, or a line
        end after which no operator goes on."""
        depth = 0
        for m in re.compile(r"[()\[\]{};,]|\n(?!\s*(?:[.?:&|+*/=<>)\]}]|\n))").finditer(self.code, offset):
            c = m.group()
            if c in "([{":
                depth += 1
            elif c in ")]}":
                depth -= 1
                if depth < 0:
                    return offset, m.start()
            elif not depth and (c in ";," or self.code[offset : m.start()].strip()):
                return offset, m.start()
        return offset, len(self.code)

    def own(self, offset: int, kinds: tuple[str, ...] = ()) -> tuple[str | None, str | None]:
        """Id and name of the innermost declaration around an offset."""
        best = None
        for a, b, i, name, kind in self.owners:
            if a < offset < b and (not kinds or kind in kinds) and (best is None or a > best[0]):
                best = (a, i, name)
        return (best[1], best[2]) if best else (None, None)

    def symbol(self, prefix: str, kind: str, name: str, offset: int, parent: str | None, detail: str | None = None, block: bool = False) -> Row:
        line, col = self.at(offset)
        i = f"{prefix}_{kind}_{hashlib.md5(f'{self.path}:{line - 1}:{col}:{kind}'.encode()).hexdigest()}"
        if block:
            a, b = self.body(offset)
            if b > a:
                self.owners.append((a, b, i, name, kind))
        return self.path, "symbol", i, name, kind, line, col, parent, None, detail

    def edge(self, kind: str, target: str, offset: int, source: str | None, detail: str | None = None) -> Row:
        line, col = self.at(offset)
        return self.path, "reference", None, None, kind, line, col, source, target, detail


def python(path: str, text: str) -> list[Row]:
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        module = ast.parse(text)
    out: list[Row] = []

    def sid(kind: str, node: ast.AST) -> str:
        return f"py_{kind}_" + hashlib.md5(f"{path}:{node.lineno}:{node.col_offset}".encode()).hexdigest()[:16]

    def add(kind: str, name: str, node: ast.AST, parent: str | None, detail: str | None = None) -> str:
        out.append((path, "symbol", sid(kind, node), name, kind, node.lineno, node.col_offset, parent, None, detail))
        return sid(kind, node)

    def dotted(node: ast.AST) -> str | None:
        if isinstance(node, ast.Name):
            return node.id
        if isinstance(node, ast.Attribute):
            base = dotted(node.value)
            return f"{base}.{node.attr}" if base else node.attr
        return None

    def ref(kind: str, target: str | None, node: ast.AST, source: str | None) -> None:
        if target:
            out.append((path, "reference", None, None, kind, node.lineno, node.col_offset, source, target, None))

    stack: list[tuple[ast.AST, str | None, str]] = [(module, None, "module")]
    while stack:
        node, owner, scope = stack.pop()
        for kid in ast.iter_child_nodes(node):
            inner, where = owner, scope
            if isinstance(kid, ast.ClassDef):
                inner, where = add("class", kid.name, kid, owner), "class"
                for b in kid.bases:
                    ref("EXTENDS", dotted(b), kid, inner)
            elif isinstance(kid, (ast.FunctionDef, ast.AsyncFunctionDef)):
                inner, where = add("method" if scope == "class" else "function", kid.name, kid, owner, ",".join(a.arg for a in kid.args.args)), "function"
            elif isinstance(kid, (ast.Assign, ast.AnnAssign)) and scope != "function":
                for t in kid.targets if isinstance(kid, ast.Assign) else [kid.target]:
                    if isinstance(t, ast.Name) and not (scope == "module" and t.id.startswith("_")):
                        add("variable", t.id, kid, owner)
            elif isinstance(kid, ast.Import):
                for a in kid.names:
                    add("import", a.name, kid, owner, a.asname)
                    ref("IMPORTS", a.name, kid, owner)
            elif isinstance(kid, ast.ImportFrom):
                for a in kid.names:
                    full = f"{'.' * kid.level}{kid.module or ''}.{a.name}"
                    add("import", full, kid, owner, a.asname)
                    ref("IMPORTS", full, kid, owner)
            elif isinstance(kid, ast.Call):
                name = dotted(kid.func)
                if name and name not in PY_BUILTINS:
                    ref("CALLS", name, kid, owner)
            stack.append((kid, inner, where))
    return out


def _types(hint: str) -> list[str]:
    return [t for t in re.split(r"[|&?()\s]+", hint or "") if t and t.lower() not in PHP_PRIMITIVES]


def php(path: str, text: str) -> list[Row]:
    t, out = Text(path, text, _NOISE_PHP), []
    code = t.code
    ns = re.search(r"\bnamespace\s+([\w\\]+)\s*[;{]", code)
    space = ns.group(1) if ns else None
    full = lambda n: f"{space}\\{n}" if space else n
    if ns:
        out.append(t.symbol("php", "namespace", space, ns.start(), None))
    for m in re.finditer(r"^\s*use\s+(?:function\s+|const\s+)?([\w\\]+)(?:\s+as\s+(\w+))?\s*;", code, re.M):
        if not t.own(m.start(1))[0]:
            out.append(t.symbol("php", "import", m.group(1), m.start(1), None, m.group(2)))
    for m in re.finditer(r"\b((?:abstract\s+|final\s+|readonly\s+)*)(class|interface|trait|enum)\s+(\w+)(?:\s*:\s*\w+)?(?:\s+extends\s+([\w\\,\s]+?))?(?:\s+implements\s+([\w\\,\s]+?))?\s*\{", code):
        row = t.symbol("php", m.group(2), full(m.group(3)), m.start(2), None, m.group(1).strip() or None, True)
        out.append(row)
        for kind, names in (("EXTENDS", m.group(4)), ("IMPLEMENTS", m.group(5))):
            out += [t.edge(kind, n.strip(), m.start(), row[2]) for n in (names or "").split(",") if n.strip()]
    owners = ("class", "interface", "trait", "enum")
    for m in re.finditer(r"((?:\b(?:public|protected|private|static|abstract|final)\s+)*)\bfunction\s+&?(\w+)\s*\(([^)]*)\)\s*(?::\s*([?\w\\|&() ]+?))?\s*(?=[{;])", code):
        cls, _ = t.own(m.start(2), owners)
        row = t.symbol("php", "method" if cls else "function", m.group(2) if cls else full(m.group(2)), m.start(2), cls, m.group(1).strip() or None, True)
        out.append(row)
        out += [t.edge("RETURNS", x, m.start(), row[2]) for x in _types(m.group(4))]
        for p in re.finditer(r"([?\w\\|&]+)\s+&?(?:\.\.\.)?\$\w+", m.group(3)):
            out += [t.edge("PARAMETER_TYPE", x, m.start(3) + p.start(), row[2]) for x in _types(p.group(1))]
    for m in re.finditer(r"\b((?:(?:public|protected|private|static|readonly|var)\s+)+)([?\w\\|&]+\s+)?\$(\w+)", code):
        cls, _ = t.own(m.start(3), (*owners, "method"))
        if cls and "_method_" not in cls:
            out.append(t.symbol("php", "property", m.group(3), m.start(3), cls, (m.group(2) or "").strip() or None))
    for m in re.finditer(r"\bconst\s+(?:[\w\\|?]+\s+)?(\w+)\s*=", code):
        out.append(t.symbol("php", "constant", m.group(1), m.start(1), t.own(m.start(1), owners)[0]))
    for m in re.finditer(r"^\s*use\s+([\w\\,\s]+?)\s*[;{]", code, re.M):
        cls, _ = t.own(m.start(1), owners)
        out += [t.edge("USES_TRAIT" if cls else "IMPORTS", re.split(r"\s+as\s+", n.strip())[0], m.start(1), cls) for n in m.group(1).split(",") if n.strip()]
    for m in re.finditer(r"\bnew\s+([\w\\]+)", code):
        if m.group(1) != "class":
            thrown = re.search(r"\bthrow\s+$", code[max(0, m.start() - 8) : m.start()])
            out.append(t.edge("THROWS" if thrown else "INSTANTIATES", m.group(1), m.start(), t.own(m.start())[0]))
    for m in re.finditer(r"\binstanceof\s+([\w\\]+)", code):
        out.append(t.edge("INSTANCEOF", m.group(1), m.start(), t.own(m.start())[0]))
    for m in re.finditer(r"([\w\\]+)::(\$?\w+)\s*(\()?", code):
        if m.group(2) != "class" and not m.group(2).startswith("$"):
            out.append(t.edge("CALLS_STATIC" if m.group(3) else "USES_CONSTANT", f"{m.group(1)}::{m.group(2)}", m.start(), t.own(m.start())[0]))
    for m in re.finditer(r"\$this->(\w+)\s*(\()?", code):
        out.append(t.edge("CALLS" if m.group(2) else "ACCESSES", f"this.{m.group(1)}", m.start(), t.own(m.start())[0]))
    for m in re.finditer(r"(?<![>:$\w\\])(?<!function )(?<!new )([a-z_]\w*)\s*\(", code):
        if m.group(1) not in PHP_WORDS:
            out.append(t.edge("CALLS", m.group(1), m.start(), t.own(m.start())[0]))
    return out


_PAGE, _GROUP = re.compile(r"(page|layout|route)\.tsx?$"), re.compile(r"\(.*\)$")


def route(path: str) -> tuple[str | None, bool]:
    """Route that a file under ``app`` or ``pages/api`` serves, from its path, and whether it is an API."""
    p = path.replace("\\", "/")
    m = re.search(r"(?:^|/)app/(.+)$", p)
    if m:
        steps = [s for s in m.group(1).split("/") if not _GROUP.match(s)]
        api = steps[:1] == ["api"]
        steps = [s for s in steps[api:] if not _PAGE.match(s)]
        return ("/" + "/".join(steps) if steps else None), api
    m = re.search(r"(?:^|/)pages/api/(.+)$", p)
    return ("/" + "/".join(re.sub(r"\.[^.]*$", "", s) for s in m.group(1).split("/")), True) if m else (None, False)


def script(path: str, text: str) -> list[Row]:
    """JavaScript, TypeScript and TSX."""
    typed = bool(re.search(r"\.(tsx?|mts|cts)$", path))
    pre = "next" if typed else "js"
    t, out = Text(path, text, _NOISE), []
    code, raw = t.code, text
    serves, api = route(path)
    client = re.match(r"\s*['\"]use client['\"]", raw) is not None
    for m in re.finditer(r"\bimport\b\s*(type\s+)?([^;'\"()]*?)\s*(?:from\s*)?(?=[ ]*(['\"]))['\"]([^'\"\n]+)['\"]|\brequire\(\s*['\"]([^'\"\n]+)['\"]\s*\)", raw):
        module = m.group(4) or m.group(5)
        if code[m.start()] == " " and raw[m.start()] != " ":
            continue  # inside a comment or string
        names = re.findall(r"(\w+)\s+as\s+(\w+)|(\*)\s+as\s+(\w+)|(\w+)", m.group(2) or "")
        for a, b, star, c, d in names or [("", "", "", "", "")]:
            local = b or c or d or module
            if local == "type":
                continue
            out.append(t.symbol(pre, "import", local, m.start(), None, module))
        out.append(t.edge("IMPORTS", module, m.start(), None, "type" if m.group(1) else None))
    for m in re.finditer(r"\bdefine\(\s*(?:['\"][^'\"]*['\"]\s*,\s*)?\[([^\]]*)\]", raw):
        out += [t.edge("IMPORTS", n, m.start(), None, "amd") for n in re.findall(r"['\"]([^'\"]+)['\"]", m.group(1))]
    for m in re.finditer(r"\b(\w+)\s*=\s*[\w.]*\b(View|Model|Collection|Router)\.extend\(\s*\{", code):
        out.append(t.symbol(pre, "TSClass" if typed else "class", m.group(1), m.start(), None, m.group(2), True))
        out.append(t.edge("EXTENDS", m.group(2), m.start(), out[-1][2]))
    for m in re.finditer(r"(\bexport\s+(?:default\s+)?)?\b(?:abstract\s+)?class\s+(\w+)(?:<[^{]*?>)?(?:\s+extends\s+([\w.]+))?[^{]*\{", code):
        row = t.symbol(pre, "TSClass" if typed else "class", m.group(2), m.start(2), None, "export" if m.group(1) else None, True)
        out.append(row)
        if m.group(3):
            out.append(t.edge("EXTENDS", m.group(3), m.start(), row[2]))
        imp = re.search(r"\bimplements\s+([\w.,\s]+)", m.group())
        out += [t.edge("IMPLEMENTS", n.strip(), m.start(), row[2]) for n in (imp.group(1).split(",") if imp and typed else []) if n.strip()]
    if typed:
        for m in re.finditer(r"\binterface\s+(\w+)(?:<[^{]*?>)?(?:\s+extends\s+([\w.,\s<>]+?))?\s*\{", code):
            row = t.symbol(pre, "TSInterface", m.group(1), m.start(1), None, None, True)
            out.append(row)
            out += [t.edge("EXTENDS", n.strip(), m.start(), row[2]) for n in (m.group(2) or "").split(",") if n.strip()]
        for m in re.finditer(r"\btype\s+(\w+)(?:<[^=]*?>)?\s*=", code):
            out.append(t.symbol(pre, "TSType", m.group(1), m.start(1), None))
    functions = r"(\bexport\s+(?:default\s+)?)?(?:\b(?:async\s+)?function\s*\*?\s*(\w+)\s*(?:<[^(]*?>)?\(([^)]*)\)(?:\s*:\s*([\w<>\[\]|. ]+?))?\s*\{|\b(?:const|let|var)\s+(\w+)\s*(?::[^=]+)?=\s*(?:\w+\()?(?:async\s*)?(?:\(([^)]*)\)|\w+)\s*(?::\s*([\w<>\[\]|. ]+?))?\s*=>)"
    for m in re.finditer(functions, code):
        name, params, result = m.group(2) or m.group(5), m.group(3) or m.group(6) or "", m.group(4) or m.group(7)
        a, b = t.body(m.end() - 1)
        if b <= a:  # an arrow function without a block
            a, b = t.expression(m.end())
        body = code[a:b]
        markup = re.search(r"(?:return|=>|\()\s*\(?\s*<[A-Za-z>]", body) is not None and path.endswith("x")
        hooks = sorted(set(re.findall(r"\b(use[A-Z]\w*)\s*\(", body)))
        verb = name.upper() in HTTP_VERBS and api
        upper = name[0].isupper() and not (len(name) <= 3 and name.isupper())
        kind = "APIRoute" if verb else "ReactComponent" if typed and (markup or hooks or (upper and path.endswith("x"))) else "TSFunction" if typed else "function"
        row = t.symbol(pre, kind, name, m.start(), None, serves if verb else "client" if client and kind == "ReactComponent" else ",".join(hooks) or None, True)
        out.append(row)
        if m.group(1):
            out.append(t.edge("EXPORTS", name, m.start(), None))
        if typed and result:
            out += [t.edge("RETURNS", x, m.start(), row[2]) for x in re.findall(r"\b[A-Z]\w+", result)]
        prop = re.search(r":\s*([A-Z]\w*)", params)
        if kind == "ReactComponent" and prop:
            out.append(t.edge("HAS_PROP", prop.group(1), m.start(), row[2]))
        seen: set[tuple[str, str]] = set()
        for kind2, rx in (("RENDERS", r"<([A-Z][\w.]*)"), ("USES", r"\b(use[A-Z]\w*)\s*\("), ("HAS_STATE", r"const\s+\[\s*(\w+)[^\]]*\]\s*=\s*use(?:State|Reducer)\b"), ("CALLS", r"(?<![.\w])([a-z_$]\w*)\s*\(")):
            for x in re.finditer(rx, body):
                # first place of every name counts
                if (kind2, x.group(1)) not in seen and x.group(1) not in JS_WORDS and not (kind2 == "CALLS" and re.match(r"use[A-Z]", x.group(1))):
                    seen.add((kind2, x.group(1)))
                    out.append(t.edge(kind2, x.group(1), a + x.start(), row[2]))
    classes = ("class", "TSClass")
    for m in re.finditer(r"^[ \t]+(?:(?:public|private|protected|static|async|override|get|set)\s+)*([A-Za-z_$]\w*)\s*(?:<[^(]*?>)?\(([^)]*)\)\s*(?::\s*[^{;]+?)?\s*\{", code, re.M):
        cls, _ = t.own(m.start(1), classes)
        if cls and m.group(1) not in JS_WORDS and t.own(m.start(1), ("method", "function", "TSFunction"))[0] is None:
            out.append(t.symbol(pre, "method" if typed else "function", m.group(1), m.start(1), cls, m.group(2) or None, True))
    if not typed:
        for m in re.finditer(r"\b(?:const|let|var)\s+(\w+)\s*=(?!\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*=>)", code):
            out.append(t.symbol(pre, "variable", m.group(1), m.start(1), t.own(m.start(1))[0]))
    for m in re.finditer(r"(?:\b(?:[Aa]jax|axios|\$)\s*\.\s*(get|post|put|patch|delete)\w*Request|\b(?:[Aa]jax|axios|\$)\s*\.\s*(get|post|put|patch|delete)|\b(fetch))\s*\(\s*['\"`]([^'\"`\n]+)", raw):
        verb = (m.group(1) or m.group(2) or "get").upper()
        out.append(t.edge("CALLS_API", m.group(4), m.start(), t.own(m.start())[0], verb))
    return out


# Readers by extension.
READERS = {"php": php, "py": python, "js": script, "jsx": script, "mjs": script, "cjs": script, "ts": script, "tsx": script, "mts": script, "cts": script}


def extract(files: DataFrame, *extensions: str) -> DataFrame:
    """(file_path, content) -> rows of ``EXTRACTED``; ``extensions`` limits the languages read. A null
    content or an unknown extension gives no rows. A file that cannot be read gives one row of kind ``error``
    and no other."""
    ship(files.sparkSession)
    readers = {k: v for k, v in READERS.items() if not extensions or k in extensions}
    ext = F.lower(F.regexp_extract("file_path", r"\.([A-Za-z0-9]+)$", 1))
    names = EXTRACTED.fieldNames()

    def read(path: str, text: str) -> list[Row]:
        try:
            return readers[path.rsplit(".", 1)[-1].lower()](path, text)
        except (SyntaxError, ValueError, RecursionError) as e:
            return [(path, "error", None, None, type(e).__name__, getattr(e, "lineno", None), None, None, None, str(e))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [r for path, text in zip(b["file_path"], b["content"]) for r in read(path, text)]
            yield pd.DataFrame(rows, columns=names)

    return files.where(F.col("content").isNotNull() & ext.isin(list(readers))).select("file_path", "content").mapInPandas(run, EXTRACTED)


def errors_of(rows: DataFrame) -> DataFrame:
    """Files that could not be read, with the kind of error."""
    return rows.where("kind = 'error'").select("file_path", F.col("type").alias("error"), "line_number", F.col("detail").alias("message"))


def symbols_of(rows: DataFrame) -> DataFrame:
    return rows.where("kind = 'symbol'").select("file_path", "id", "name", "type", "line_number", "column_number", F.col("parent").alias("parent_id"), "detail")


def references_of(rows: DataFrame) -> DataFrame:
    """References as written; ``target`` is a name still to be resolved."""
    return rows.where("kind = 'reference'").select("file_path", F.col("parent").alias("source_id"), F.col("type").alias("reference_type"), "target", "line_number", "column_number", "detail")
