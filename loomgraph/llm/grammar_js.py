"""Local grammar of JavaScript, TypeScript and TSX statements: says whether a balanced piece parses.

Used per piece inside Spark tasks; it builds no tree. ``check(text, dialect)`` raises ``Bad``.
"""

from __future__ import annotations

import re


class Bad(Exception):
    """The text does not parse; carries the offset."""


class Deep(Exception):
    """Nesting beyond ``MAX_DEPTH``: nothing is said about the text."""


#: Nesting that a piece may have; memory for the parser's frames bounds it, and what is deeper stays undecided.
MAX_DEPTH = 2_000

_ID = r"(?:[^\W\d]|[$\\]|(?<=\\)u)[\w$\u200c\u200d\\]*"
_TOKEN = rf"""(?P<num>0[xX][\da-fA-F_]+n?|0[oO][0-7_]+n?|0[bB][01_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?n?(?![\w$]))
    |(?P<id>\#?{_ID})
    |(?P<str>"(?:[^"\\\n\r]|\\(?:\r\n|[\s\S]))*"|'(?:[^'\\\n\r]|\\(?:\r\n|[\s\S]))*')
    |(?P<p>>>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|\*\*|[{{}}()\[\];,<>+\-*/%&|^!~?:=.@`])"""
_SKIP = re.compile(r"(?:[\s\ufeff]+|//[^\n\r\u2028\u2029]*|/\*[\s\S]*?\*/)*")
#: Blanks and comments, then a token if there is one.
_NEXT = re.compile(_SKIP.pattern + "(?:" + _TOKEN + ")?", re.X)
_REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\n\r]|\\[^\n\r]|\[(?:[^\]\\\n\r]|\\[^\n\r])*\])+/[a-zA-Z]*")
_TEXT = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*")
_JSX_NAME = re.compile(r"[^\W\d][\w$.:-]*")

# Words of the language.
RESERVED = set(
    "break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with".split()
)
ASSIGN = set("= += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??=".split())
BINARY = set("|| && ?? | ^ & == != === !== < > <= >= << >> >>> + - * / % ** in instanceof".split())
PREFIX = set("+ - ! ~ typeof void delete".split())
MODIFIERS = set("public private protected static readonly abstract override declare async get set accessor".split())


class Grammar:
    def __init__(self, text: str, dialect: str):
        self.s, self.ts, self.jsx = text, dialect in ("ts", "tsx"), dialect == "tsx"
        self.pos = self.end = 0
        self.depth = self.fn = self.loop = self.switch = 0
        self.gen = self.asyn = False
        self.ahead: dict[int, bool] = {}
        self.rare = any(c in text for c in "\r\u2028\u2029")
        if text.startswith("#!"):
            self.end = (text + "\n").index("\n")
        self.step()

    # tokens ---------------------------------------------------------------------------------
    def bad(self, why: str = "unexpected") -> Bad:
        return Bad(f"{why} at {self.pos}: {self.s[self.pos:self.pos + 20]!r}")

    def step(self) -> None:
        from_ = self.last_end = self.end
        s = self.s
        m = _NEXT.match(s, from_)
        kind, self.end = m.lastgroup, m.end()
        v = m[kind] if kind else ""
        self.pos = at = self.end - len(v)
        self.nl = at == 0 if at == from_ else at == 0 or s.find("\n", from_, at) >= 0 or (self.rare and any(c in s[from_:at] for c in "\r\u2028\u2029"))
        if not kind:
            if at < len(s):
                raise self.bad("no token")
            self.kind, self.v = "eof", ""
            return
        if v == "/" and s.startswith("*", at + 1):
            raise self.bad("no token")
        self.kind, self.v = kind, v
        if kind == "id" and "\\" in v and not re.fullmatch(r"(?:[^\\]|\\u[\da-fA-F]{4}|\\u\{[\da-fA-F]+\})+", v):
            if "\\u{" not in s[at : at + len(v) + 1]:
                raise self.bad("escape")

    def save(self):
        return self.pos, self.end, self.kind, self.v, self.nl, self.last_end

    def load(self, st) -> None:
        self.pos, self.end, self.kind, self.v, self.nl, self.last_end = st

    def attempt(self, f):
        """Run ``f``; on failure go back and return None."""
        st, flags = self.save(), (self.fn, self.loop, self.switch, self.gen, self.asyn, self.depth)
        try:
            return f() or True
        except Bad:
            self.load(st)
            self.fn, self.loop, self.switch, self.gen, self.asyn, self.depth = flags
            return None

    def at(self, *vs: str) -> bool:
        return self.v in vs and self.kind in ("p", "id")

    def eat(self, *vs: str) -> bool:
        if self.at(*vs):
            self.step()
            return True
        return False

    def need(self, v: str) -> None:
        if not self.eat(v):
            raise self.bad(f"expected {v}")

    def peek(self) -> tuple[str, str, bool]:
        st = self.save()
        self.step()
        out = self.kind, self.v, self.nl
        self.load(st)
        return out

    def close_angle(self) -> None:
        """One ``>``, also where the lexer saw several."""
        if self.kind == "p" and self.v.startswith(">"):
            self.end = self.pos + 1
            self.step()
        else:
            raise self.bad("expected >")

    def name(self, any_word: bool = False) -> str:
        if self.kind != "id" or (not any_word and (self.v in RESERVED or self.v.startswith("#"))):
            raise self.bad("name")
        v = self.v
        self.step()
        return v

    def semi(self) -> None:
        if self.eat(";") or self.at("}") or self.kind == "eof" or self.nl:
            return
        raise self.bad("expected ;")

    # statements -----------------------------------------------------------------------------
    def program(self) -> None:
        while self.kind != "eof":
            self.statement(True)

    def block(self) -> None:
        self.need("{")
        while not self.at("}"):
            if self.kind == "eof":
                raise self.bad("open block")
            self.statement(True)
        self.step()

    def body(self, gen: bool = False, asyn: bool = False) -> None:
        keep = self.fn, self.loop, self.switch, self.gen, self.asyn
        self.fn, self.loop, self.switch, self.gen, self.asyn = 1, 0, 0, gen, asyn
        self.block()
        self.fn, self.loop, self.switch, self.gen, self.asyn = keep

    def statement(self, declares: bool = False) -> None:
        self.depth += 1
        if self.depth > MAX_DEPTH:
            raise Deep
        self._statement(declares)
        self.depth -= 1

    def _statement(self, declares: bool) -> None:
        v = self.v if self.kind in ("p", "id") else None
        if v == "{":
            return self.block()
        if v == ";":
            return self.step()
        if v == "@":
            self.decorators()
            if not self.at("class", "export", "abstract"):
                raise self.bad("decorator")
            return self.statement(True)
        if self.kind == "id":
            f = getattr(self, "s_" + v, None) if v.isascii() else None
            if f and (v not in self.SOFT or self.soft(v)):
                if v in ("class", "const", "let", "import", "export", "enum", "interface", "type") and not declares:
                    raise self.bad("declaration as body")
                return f()
            if v not in RESERVED and self.peek()[1] == ":":
                self.step()
                self.step()
                return self.statement(declares)
        self.expr()
        self.semi()

    SOFT = {"let", "async", "interface", "type", "enum", "declare", "namespace", "module", "abstract", "import", "global"}

    def soft(self, v: str) -> bool:
        k, w, nl = self.peek()
        if v == "let":
            return k == "id" and w not in ("in", "instanceof", "of") or w in ("[", "{")
        if v == "async":
            return w == "function" and not nl
        if v == "import":
            return w not in ("(", ".")
        if v == "enum":
            return True
        if not self.ts or nl:
            return False
        if v in ("namespace", "module"):
            return k in ("id", "str")
        if v == "global":
            return w == "{"
        return k == "id" and w not in ("in", "instanceof", "of", "as", "satisfies")

    def s_var(self) -> None:
        self.step()
        self.declarations(False)
        self.semi()

    s_let = s_var

    def s_const(self) -> None:
        self.step()
        if self.ts and self.at("enum"):
            return self.s_enum()
        self.declarations(True)
        self.semi()

    def declarations(self, const: bool, for_head: bool = False) -> None:
        while True:
            plain = self.kind == "id"
            self.binding()
            if self.ts and self.eat("!"):
                pass
            if self.ts and self.eat(":"):
                self.type()
            if self.eat("="):
                self.assign(not for_head)
            elif not (for_head and self.at("in", "of")) and (not plain or (const and not self.ambient)):
                raise self.bad("initialiser")
            if not self.eat(","):
                return

    ambient = False

    def binding(self) -> None:
        if self.eat("["):
            while not self.at("]"):
                if self.eat(","):
                    continue
                self.eat("...")
                self.binding()
                if self.eat("="):
                    self.assign()
                if not self.at("]"):
                    self.need(",")
            self.step()
        elif self.eat("{"):
            while not self.at("}"):
                if self.eat("..."):
                    self.binding()
                else:
                    short = self.kind == "id" and self.v not in RESERVED
                    self.prop_name()
                    if self.eat(":"):
                        self.binding()
                    elif not short:
                        raise self.bad("pattern")
                    if self.eat("="):
                        self.assign()
                if not self.at("}"):
                    self.need(",")
            self.step()
        else:
            self.name()

    def s_function(self) -> None:
        self.step()
        gen = self.eat("*")
        self.name()
        self.function_rest(gen, False, True)

    def s_async(self) -> None:
        self.step()
        self.step()
        gen = self.eat("*")
        self.name()
        self.function_rest(gen, True, True)

    def function_rest(self, gen: bool, asyn: bool, overload: bool = False) -> None:
        self.params()
        if self.ts and self.eat(":"):
            self.type(True)
        if overload and self.ts and not self.at("{"):
            return self.semi()
        self.body(gen, asyn)

    def params(self) -> None:
        if self.ts and self.at("<"):
            self.type_params()
        self.need("(")
        while not self.at(")"):
            self.decorators()
            while self.ts and self.at("public", "private", "protected", "readonly", "override") and (self.peek()[0] == "id" or self.peek()[1] in "[{"):
                self.step()
            rest = self.eat("...")
            if self.ts and self.at("this"):
                self.step()
            else:
                self.binding()
            if self.ts and self.eat("?"):
                pass
            if self.ts and self.eat(":"):
                self.type()
            if self.eat("="):
                self.assign()
            if not self.at(")"):
                self.need(",")
                if rest:
                    raise self.bad("rest")
        self.step()

    def decorators(self) -> None:
        while self.eat("@"):
            if self.eat("("):
                self.expr()
                self.need(")")
                continue
            self.name(True)
            while self.eat("."):
                self.name(True)
            if self.at("("):
                self.args()

    def s_abstract(self) -> None:
        self.step()
        self.s_class()

    def s_class(self) -> None:
        self.need("class")
        self.name()
        self.class_rest()

    def class_rest(self) -> None:
        if self.ts and self.at("<"):
            self.type_params()
        if self.eat("extends"):
            self.unary()
            if self.ts and self.at("<"):
                self.type_args()
        if self.ts and self.eat("implements"):
            self.type()
            while self.eat(","):
                self.type()
        self.need("{")
        while not self.at("}"):
            if self.kind == "eof":
                raise self.bad("open class")
            if not self.eat(";"):
                self.member()
        self.step()

    def member(self) -> None:
        self.decorators()
        if self.at("static") and self.peek()[1] == "{":
            self.step()
            return self.body()
        asyn, words = False, MODIFIERS if self.ts else {"static", "async", "get", "set", "accessor"}
        while self.kind == "id" and self.v in words:
            k, w, nl = self.peek()
            if w in ("(", "=", ";", "}", ":", "?", "!", "<", ",") or (nl and self.v in ("async", "get", "set") and self.v == "async"):
                break
            asyn |= self.v == "async"
            self.step()
        gen = self.eat("*")
        if self.ts and self.at("[") and self.attempt(self.index_signature):
            return self.semi()
        self.prop_name()
        if self.ts and self.at("?", "!"):
            self.step()
        if self.at("(", "<"):
            return self.function_rest(gen, asyn, True)
        if gen:
            raise self.bad("generator")
        if self.ts and self.eat(":"):
            self.type()
        if self.eat("="):
            keep, self.fn = self.fn, 0
            self.assign()
            self.fn = keep
        self.semi()

    def prop_name(self) -> None:
        if self.eat("["):
            self.assign()
            self.need("]")
        elif self.kind in ("id", "str", "num"):
            self.step()
        else:
            raise self.bad("property")

    def s_if(self) -> None:
        self.step()
        self.paren()
        self.statement()
        if self.eat("else"):
            self.statement()

    def paren(self) -> None:
        self.need("(")
        self.expr()
        self.need(")")

    def looped(self) -> None:
        self.loop += 1
        self.statement()
        self.loop -= 1

    def s_while(self) -> None:
        self.step()
        self.paren()
        self.looped()

    def s_with(self) -> None:
        self.step()
        self.paren()
        self.statement()

    def s_do(self) -> None:
        self.step()
        self.looped()
        self.need("while")
        self.paren()
        self.eat(";")

    def s_for(self) -> None:
        self.step()
        self.eat("await")
        self.need("(")
        if self.at("var", "const") or (self.at("let") and self.soft("let")):
            const = self.v == "const"
            self.step()
            self.declarations(const, True)
        elif not self.at(";"):
            self.expr(False)
        if self.eat("of"):
            self.assign()
        elif self.eat("in"):
            self.expr()
        else:
            self.need(";")
            if not self.at(";"):
                self.expr()
            self.need(";")
            if not self.at(")"):
                self.expr()
        self.need(")")
        self.looped()

    def s_return(self) -> None:
        if not self.fn:
            raise self.bad("return outside")
        self.step()
        if not (self.nl or self.at(";", "}") or self.kind == "eof"):
            self.expr()
        self.semi()

    def s_throw(self) -> None:
        self.step()
        if self.nl:
            raise self.bad("throw")
        self.expr()
        self.semi()

    def s_break(self) -> None:
        word = self.v
        self.step()
        if self.kind == "id" and not self.nl and self.v not in RESERVED:
            self.step()
        elif not (self.loop or (word == "break" and self.switch)):
            raise self.bad(word)
        self.semi()

    s_continue = s_break

    def s_debugger(self) -> None:
        self.step()
        self.semi()

    def s_try(self) -> None:
        self.step()
        self.block()
        some = False
        if self.eat("catch"):
            some = True
            if self.eat("("):
                self.binding()
                if self.ts and self.eat(":"):
                    self.type()
                self.need(")")
            self.block()
        if self.eat("finally"):
            some = True
            self.block()
        if not some:
            raise self.bad("try")

    def s_switch(self) -> None:
        self.step()
        self.paren()
        self.need("{")
        self.switch += 1
        while not self.at("}"):
            if self.eat("case"):
                self.expr()
            else:
                self.need("default")
            self.need(":")
            while not self.at("case", "default", "}"):
                if self.kind == "eof":
                    raise self.bad("open switch")
                self.statement(True)
        self.step()
        self.switch -= 1

    def s_else(self) -> None:
        raise self.bad("else")

    s_case = s_default = s_catch = s_finally = s_extends = s_in = s_instanceof = s_else

    def specifiers(self) -> None:
        self.need("{")
        while not self.at("}"):
            if self.ts and self.at("type") and self.peek()[1] not in (",", "}", "as"):
                self.step()
            if self.kind not in ("id", "str"):
                raise self.bad("specifier")
            self.step()
            if self.eat("as"):
                if self.kind not in ("id", "str"):
                    raise self.bad("alias")
                self.step()
            if not self.at("}"):
                self.need(",")
        self.step()

    def source(self) -> None:
        if self.kind != "str":
            raise self.bad("module name")
        self.step()
        if self.at("with", "assert") and not self.nl:
            self.step()
            self.primary()

    def top(self) -> None:
        if self.fn or self.loop or self.switch:
            raise self.bad("not at top level")

    def s_import(self) -> None:
        self.top()
        self.step()
        if self.kind == "str":
            self.source()
            return self.semi()
        if self.ts and self.at("type") and self.peek()[1] not in (",", "from", "="):
            self.step()
        if self.kind == "id":
            self.name()
            if self.ts and self.eat("="):
                self.expr()
                return self.semi()
            if not self.eat(","):
                self.need("from")
                self.source()
                return self.semi()
        if self.eat("*"):
            self.need("as")
            self.name()
        else:
            self.specifiers()
        self.need("from")
        self.source()
        self.semi()

    def s_export(self) -> None:
        self.top()
        self.step()
        if self.eat("*"):
            if self.eat("as"):
                self.step()
            self.need("from")
            self.source()
            return self.semi()
        if self.ts and self.at("type") and self.peek()[1] in ("{", "*"):
            self.step()
            if self.at("*"):
                self.v = "*"
                self.step()
                if self.eat("as"):
                    self.name()
                self.need("from")
                self.source()
                return self.semi()
        if self.at("{"):
            self.specifiers()
            if self.eat("from"):
                self.source()
            return self.semi()
        if self.eat("default"):
            self.decorators()
            if self.at("function") or (self.at("async") and self.soft("async")):
                asyn = self.eat("async")
                self.need("function")
                gen = self.eat("*")
                if self.kind == "id":
                    self.name()
                return self.function_rest(gen, asyn, True)
            if self.ts and self.at("abstract"):
                self.step()
            if self.eat("class"):
                if self.kind == "id" and not self.at("extends", "implements"):
                    self.name()
                return self.class_rest()
            if self.ts and self.at("interface") and self.soft("interface"):
                return self.s_interface()
            self.assign()
            return self.semi()
        if self.ts and self.eat("="):
            self.expr()
            return self.semi()
        if self.ts and self.at("as") and self.peek()[1] == "namespace":
            self.step()
            self.step()
            self.name()
            return self.semi()
        words = {"var", "let", "const", "function", "class", "async", "@"} | ({"interface", "type", "enum", "declare", "namespace", "module", "abstract", "import"} if self.ts else set())
        if self.v not in words or self.kind not in ("id", "p"):
            raise self.bad("export")
        self.statement(True)

    # TypeScript declarations
    def s_interface(self) -> None:
        self.step()
        self.name()
        if self.at("<"):
            self.type_params()
        if self.eat("extends"):
            self.type()
            while self.eat(","):
                self.type()
        self.object_type()

    def s_type(self) -> None:
        self.step()
        self.name()
        if self.at("<"):
            self.type_params()
        self.need("=")
        self.type()
        self.semi()

    def s_enum(self) -> None:
        if not self.ts:
            raise self.bad("enum")
        self.need("enum")
        self.name()
        self.need("{")
        while not self.at("}"):
            self.prop_name()
            if self.eat("="):
                self.assign()
            if not self.at("}"):
                self.need(",")
        self.step()

    def s_declare(self) -> None:
        self.step()
        keep, self.ambient = self.ambient, True
        self.statement(True)
        self.ambient = keep

    def s_namespace(self) -> None:
        self.step()
        if self.kind == "str":
            self.step()
        else:
            self.name()
            while self.eat("."):
                self.name()
        if self.at("{"):
            self.block()
        else:
            self.semi()

    s_module = s_namespace

    def s_global(self) -> None:
        self.step()
        self.block()

    # types ----------------------------------------------------------------------------------
    def type_params(self) -> None:
        self.need("<")
        while not self.at(">"):
            while self.at("const", "in", "out") and self.peek()[0] == "id" and self.peek()[1] != "extends":
                self.step()
            self.name()
            if self.eat("extends"):
                self.type()
            if self.eat("="):
                self.type()
            if not self.at(">"):
                self.need(",")
        self.step()

    def type_args(self) -> None:
        self.need("<")
        while True:
            self.type()
            if not self.eat(","):
                break
        self.close_angle()

    def type(self, result: bool = False) -> None:
        self.depth += 1
        if self.depth > MAX_DEPTH:
            raise Deep
        if result and self.at("asserts") and self.peek()[0] == "id" and not self.peek()[2]:
            self.step()
            self.step()
            if self.eat("is"):
                self.type()
        elif self.kind == "id" and self.peek()[1] == "is" and not self.peek()[2]:
            self.step()
            self.step()
            self.type()
        elif self.at("new", "abstract") and self.peek()[1] in ("(", "<", "new"):
            self.eat("abstract")
            self.step()
            self.function_type()
        elif self.at("<") or (self.at("(") and self.attempt_function_type()):
            if self.at("<"):
                self.function_type()
        else:
            self.union()
            if self.at("extends") and not self.nl and not self.no_conditional:
                self.step()
                keep, self.no_conditional = self.no_conditional, True
                self.type()
                self.no_conditional = keep
                self.need("?")
                self.type()
                self.need(":")
                self.type()
        self.depth -= 1

    no_conditional = False

    def attempt_function_type(self) -> bool:
        return bool(self.attempt(self.function_type))

    def function_type(self) -> None:
        self.params()
        self.need("=>")
        self.type(True)

    def union(self) -> None:
        self.eat("|", "&")
        self.postfix_type()
        while self.at("|", "&"):
            self.step()
            if self.at("(") and self.attempt_function_type():
                continue
            self.postfix_type()

    def postfix_type(self) -> None:
        while self.at("keyof", "unique", "readonly", "infer") and (self.peek()[0] in ("id", "str") or self.peek()[1] in ("(", "[", "{")):
            infer = self.v == "infer"
            self.step()
            if infer:
                self.name()
                if self.at("extends"):
                    self.attempt(self.infer_bound)
                return
        self.primary_type()
        while True:
            if self.at("[") and not self.nl:
                self.step()
                if not self.at("]"):
                    self.type()
                self.need("]")
            elif self.at("!") and not self.nl:
                self.step()
            else:
                return

    def infer_bound(self) -> None:
        self.step()
        self.union()
        if self.at("?"):
            raise self.bad("conditional")

    def primary_type(self) -> None:
        if self.eat("("):
            keep, self.no_conditional = self.no_conditional, False
            self.type()
            self.no_conditional = keep
            self.need(")")
        elif self.at("{"):
            self.object_type()
        elif self.eat("["):
            while not self.at("]"):
                self.eat("...")
                if self.kind == "id" and self.peek()[1] in (":", "?") and self.attempt(self.tuple_label):
                    pass
                self.type()
                self.eat("?")
                if not self.at("]"):
                    self.need(",")
            self.step()
        elif self.at("`"):
            self.template(True)
        elif self.at("-"):
            self.step()
            if self.kind != "num":
                raise self.bad("type")
            self.step()
        elif self.kind in ("str", "num"):
            self.step()
        elif self.at("typeof"):
            self.step()
            if self.at("import"):
                return self.primary_type()
            self.entity()
        elif self.at("import"):
            self.step()
            self.need("(")
            self.type()
            if self.eat(","):
                self.primary()
            self.need(")")
            while self.eat("."):
                self.name(True)
            if self.at("<") and not self.nl:
                self.type_args()
        elif self.at("this", "null", "void", "true", "false"):
            self.step()
        else:
            self.name()
            self.entity_rest()

    def tuple_label(self) -> None:
        self.step()
        self.eat("?")
        self.need(":")

    def entity(self) -> None:
        self.name(True)
        self.entity_rest()

    def entity_rest(self) -> None:
        while self.eat("."):
            self.name(True)
        if self.at("<", "<<") and not self.nl:
            self.type_args()

    def index_signature(self) -> None:
        self.need("[")
        self.name()
        self.need(":")
        self.type()
        self.need("]")
        self.eat("?")
        self.need(":")
        self.type()

    def mapped(self) -> None:
        if self.at("+", "-"):
            self.step()
        self.eat("readonly")
        self.need("[")
        self.name()
        self.need("in")
        self.type()
        if self.eat("as"):
            self.type()
        self.need("]")
        if self.at("+", "-"):
            self.step()
        self.eat("?")
        if self.eat(":"):
            self.type()
        self.eat(";", ",")
        self.need("}")

    def object_type(self) -> None:
        self.need("{")
        if self.at("[", "readonly", "+", "-") and self.attempt(self.mapped):
            return
        while not self.at("}"):
            if self.kind == "eof":
                raise self.bad("open type")
            if self.at("(", "<"):
                self.signature()
            elif self.at("new") and self.peek()[1] in ("(", "<"):
                self.step()
                self.signature()
            elif self.at("[") and self.attempt(self.index_signature):
                pass
            else:
                while self.at("readonly", "get", "set") and self.peek()[1] not in (":", "?", "(", ";", ",", "}", "<") and not self.peek()[2]:
                    self.step()
                if self.at("[") and self.attempt(self.index_signature):
                    pass
                else:
                    self.prop_name()
                    self.eat("?")
                    if self.at("(", "<"):
                        self.signature()
                    elif self.eat(":"):
                        self.type()
            if not (self.eat(";", ",") or self.at("}") or self.nl):
                raise self.bad("type member")
        self.step()

    def signature(self) -> None:
        self.params()
        if self.eat(":"):
            self.type(True)

    # expressions ----------------------------------------------------------------------------
    def expr(self, has_in: bool = True) -> str:
        k = self.assign(has_in)
        while self.eat(","):
            self.assign(has_in)
            k = "seq"
        return k

    def assign(self, has_in: bool = True) -> str:
        self.depth += 1
        if self.depth > MAX_DEPTH:
            raise Deep
        k = self._assign(has_in)
        self.depth -= 1
        return k

    def _assign(self, has_in: bool) -> str:
        if self.at("yield") and self.gen:
            self.step()
            if not self.nl and not (self.at(")", "]", "}", ",", ";", ":") or self.kind == "eof"):
                self.eat("*")
                self.assign(has_in)
            return "yield"
        if self.kind == "id" and (self.v not in RESERVED) or self.at("(", "<"):
            if self.maybe_arrow() and self.attempt(lambda: self.arrow(has_in)):
                return "arrow"
        k = self.binary(has_in)
        if self.at("?"):
            self.step()
            self.assign()
            self.need(":")
            self.assign(has_in)
            return "cond"
        if self.kind == "p" and self.v in ASSIGN:
            if k not in ("id", "member") and not (self.v == "=" and k in ("array", "object")):
                raise self.bad("target")
            self.step()
            self.assign(has_in)
            return "assign"
        if k == "cover":
            raise self.bad("shorthand initialiser")
        return k

    def maybe_arrow(self) -> bool:
        if self.at("("):
            return self.arrow_ahead()
        if self.at("<"):
            return self.ts
        k, w, nl = self.peek()
        return w == "=>" or (self.v == "async" and not nl and (k == "id" and w != "function" and w not in RESERVED or w in ("(", "<")))

    def arrow_ahead(self) -> bool:
        """From ``(``: does the matching ``)`` come before ``=>`` (or ``:`` in TypeScript)?"""
        if self.pos in self.ahead:
            return self.ahead[self.pos]
        st, open_ = self.save(), []
        try:
            while True:  # what the pass tells of brackets inside is kept, so nesting costs no more
                if self.kind == "eof":
                    self.ahead |= dict.fromkeys(open_, False)
                    return False
                if self.kind == "p":
                    if self.v == "`":
                        return True  # a template inside: let the attempt decide
                    if self.v in "([{":
                        open_.append(self.pos)
                    elif self.v in ")]}":
                        at = open_.pop()
                        self.step()
                        self.ahead[at] = self.v == "=>" or (self.ts and self.v == ":")
                        if not open_:
                            return self.ahead[at]
                        continue
                self.step()
        except Bad:
            return True
        finally:
            self.load(st)

    def arrow(self, has_in: bool) -> None:
        asyn = False
        if self.at("async") and self.peek()[1] != "=>":
            self.step()
            asyn = True
        if self.kind == "id":
            self.name()
        else:
            if self.jsx and self.at("<") and not re.match(r"<\s*(const\s+)?[\w$]+\s*(,|extends\b)", self.s[self.pos :]):
                raise self.bad("jsx")
            self.params()
            if self.ts and self.eat(":"):
                self.type(True)
        if not self.at("=>") or self.nl:
            raise self.bad("arrow")
        self.step()
        if self.at("{"):
            self.body(False, asyn)
        else:
            keep = self.asyn, self.gen
            self.asyn, self.gen = asyn, False
            self.assign(has_in)
            self.asyn, self.gen = keep

    def binary(self, has_in: bool) -> str:
        k = self.unary()
        while True:
            if self.ts and self.at("as", "satisfies") and not self.nl:
                self.step()
                if not self.eat("const"):
                    self.type()
                continue
            v = self.v
            if self.kind == "p" and v.startswith(">") and v not in (">", ">="):
                m = re.match(r">>>=?|>>=?", self.s[self.pos :])
                v = m.group() if m else v
                if v in ASSIGN:
                    self.v, self.end = v, self.pos + len(v)
                    return k
                self.end = self.pos + len(v)
            elif self.kind == "p" and v == ">":
                m = re.match(r">>>=|>>=|>>>|>>|>=|>", self.s[self.pos :])
                v = m.group()
                self.v, self.end = v, self.pos + len(v)
                if v in ASSIGN:
                    return k
            if self.kind not in ("p", "id") or v not in BINARY or (v == "in" and not has_in):
                return k
            if k == "cover":
                raise self.bad("shorthand initialiser")
            self.step()
            if self.unary() == "cover":
                raise self.bad("shorthand initialiser")
            k = "binary"

    def unary(self) -> str:
        if self.kind in ("p", "id"):
            if self.v in PREFIX:
                self.step()
                self.unary()
                return "unary"
            if self.v in ("++", "--"):
                self.step()
                if self.unary() not in ("id", "member"):
                    raise self.bad("++")
                return "unary"
            if self.v == "await" and self.kind == "id" and (self.asyn or not self.fn):
                k, w, nl = self.peek()
                if self.asyn or (k in ("id", "str", "num") and w not in BINARY and w not in ("of", "as")) or w in ("(", "[", "{", "`") and not nl:
                    self.step()
                    self.unary()
                    return "unary"
            if self.v == "<" and self.ts and not self.jsx:
                self.step()
                if not self.eat("const"):
                    self.type()
                self.close_angle()
                self.unary()
                return "unary"
        k = self.postfix()
        if self.at("++", "--") and not self.nl:
            if k not in ("id", "member"):
                raise self.bad("++")
            self.step()
            return "unary"
        return k

    def args(self) -> None:
        self.need("(")
        while not self.at(")"):
            self.eat("...")
            self.assign()
            if not self.at(")"):
                self.need(",")
        self.step()

    def call_types(self) -> None:
        self.type_args()
        if not (self.at("(", "`", ")", "]", ":", ";", ",", ".", "?.", "==", "===", "!=", "!==", "&&", "||", "??", "}") or self.kind == "eof" or self.nl):
            raise self.bad("type arguments")

    def postfix(self) -> str:
        if self.at("new"):
            self.step()
            if self.eat("."):
                self.need("target")
                k = "other"
            else:
                self.callee()
                if self.ts and self.at("<"):
                    self.attempt(self.call_types)
                if self.at("("):
                    self.args()
                k = "call"
        else:
            k = self.primary()
        while True:
            if self.at(".", "?."):
                chain = self.v == "?."
                self.step()
                if chain and self.at("("):
                    self.args()
                    k = "call"
                elif chain and self.at("["):
                    continue
                elif chain and self.at("`"):
                    raise self.bad("template")
                else:
                    self.name(True)
                    k = "chain" if chain else "member"
            elif self.at("["):
                self.step()
                self.expr()
                self.need("]")
                k = "member"
            elif self.at("("):
                if k == "arrow":
                    return k
                self.args()
                k = "call"
            elif self.at("`"):
                self.template(False)
                k = "call"
            elif self.ts and self.at("!") and not self.nl:
                self.step()
            elif self.ts and self.at("<", "<<") and k in ("id", "member", "call", "chain") and self.attempt(self.call_types):
                k = "call"
            else:
                return k

    def callee(self) -> None:
        if self.at("new"):
            self.postfix()
            return
        if self.at("import"):
            raise self.bad("new import")
        self.primary()
        while True:
            if self.eat("."):
                self.name(True)
            elif self.eat("["):
                self.expr()
                self.need("]")
            elif self.ts and self.at("!"):
                self.step()
            else:
                return

    def primary(self) -> str:
        v, kind = self.v, self.kind
        if kind in ("num", "str"):
            self.step()
            return "literal"
        if kind == "id":
            if v == "function":
                self.step()
                gen = self.eat("*")
                if self.kind == "id":
                    self.name()
                self.function_rest(gen, False)
                return "other"
            if v == "async" and self.peek()[1] == "function" and not self.peek()[2]:
                self.step()
                self.step()
                gen = self.eat("*")
                if self.kind == "id":
                    self.name()
                self.function_rest(gen, True)
                return "other"
            if v == "class":
                self.step()
                if self.kind == "id" and not self.at("extends", "implements"):
                    self.name()
                self.class_rest()
                return "other"
            if v == "import":
                self.step()
                if self.eat("."):
                    self.name(True)
                else:
                    if not self.at("("):
                        raise self.bad("import")
                    self.args()
                return "call"
            if v == "super":
                self.step()
                if not self.at("(", ".", "["):
                    raise self.bad("super")
                return "other"
            if v in ("this", "null", "true", "false"):
                self.step()
                return "literal"
            if v in RESERVED:
                raise self.bad("reserved word")
            self.step()
            if v.startswith("#") and not self.at("in"):
                raise self.bad("private name")
            return "id"
        if v == "(":
            self.step()
            k = self.expr()
            self.need(")")
            return k if k in ("id", "member") else "paren"
        if v == "[":
            self.step()
            while not self.at("]"):
                if self.eat(","):
                    continue
                self.eat("...")
                self.assign()
                if not self.at("]"):
                    self.need(",")
            self.step()
            return "array"
        if v == "{":
            return self.object()
        if v == "`":
            self.template(False)
            return "literal"
        if v in ("/", "/="):
            m = _REGEX.match(self.s, self.pos)
            if not m:
                raise self.bad("regex")
            self.end = m.end()
            self.step()
            return "literal"
        if v == "@":
            self.decorators()
            return self.primary()
        if v == "<" and self.jsx:
            self.end = self.element(self.pos)
            self.step()
            return "other"
        raise self.bad()

    def object(self) -> str:
        self.step()
        cover = False
        while not self.at("}"):
            if self.eat("..."):
                self.assign()
            else:
                asyn = False
                while self.at("get", "set", "async") and self.peek()[1] not in (",", ":", "(", "}", "=", "<"):
                    asyn |= self.v == "async"
                    self.step()
                gen = self.eat("*")
                short = self.kind == "id" and self.v not in RESERVED and not self.v.startswith("#")
                self.prop_name()
                if self.at("(", "<"):
                    self.function_rest(gen, asyn)
                elif self.eat(":"):
                    self.assign()
                elif short and self.at("="):
                    self.step()
                    self.assign()
                    cover = True
                elif not short:
                    raise self.bad("member")
            if not self.at("}"):
                self.need(",")
        self.step()
        if cover and not self.at("="):
            return "cover" if not self.at(",", "]", "}", "of", "in", ":") else "object"
        return "object"

    def template(self, types: bool) -> None:
        at = self.pos + 1
        while True:
            at = _TEXT.match(self.s, at).end()
            if self.s.startswith("`", at):
                self.end = at + 1
                return self.step()
            if not self.s.startswith("${", at):
                raise self.bad("open template")
            self.end = at + 2
            self.step()
            self.type() if types else self.expr()
            if not self.at("}"):
                raise self.bad("template")
            at = self.end

    # JSX: works on offsets, embedded expressions go back to tokens
    def ws(self, at: int) -> int:
        return _SKIP.match(self.s, at).end()

    def jsx_name(self, at: int) -> tuple[str, int]:
        m = _JSX_NAME.match(self.s, at)
        if not m:
            raise Bad(f"jsx name at {at}")
        return m.group(), self.ws(m.end())

    def embedded(self, at: int, empty: bool) -> int:
        """Expression container from ``{`` at ``at``; returns the offset behind ``}``."""
        self.end = at + 1
        self.step()
        if not (empty and self.at("}")):
            self.eat("...")
            self.expr()
        if not self.at("}"):
            raise self.bad("jsx expression")
        return self.end

    def element(self, at: int) -> int:
        self.depth += 1
        if self.depth > MAX_DEPTH:
            raise Deep
        s, at = self.s, self.ws(at + 1)
        tag = ""
        if not s.startswith(">", at):
            tag, at = self.jsx_name(at)
            if self.ts and s.startswith("<", at):
                self.end = at
                self.step()
                self.type_args()
                at = self.pos
            while not s.startswith((">", "/"), at):
                if s.startswith("{", at):
                    at = self.ws(self.embedded(at, False))
                    continue
                _, at = self.jsx_name(at)
                if s.startswith("=", at):
                    at = self.ws(at + 1)
                    q = s[at : at + 1]
                    if q in ("'", '"') and q:
                        e = s.find(q, at + 1)
                        if e < 0:
                            raise Bad("jsx string")
                        at = self.ws(e + 1)
                    elif q == "{":
                        at = self.ws(self.embedded(at, False))
                    elif q == "<":
                        at = self.ws(self.element(at))
                    else:
                        raise Bad("jsx attribute")
            if s.startswith("/", at):
                at = self.ws(at + 1)
                if not s.startswith(">", at):
                    raise Bad("jsx end")
                self.depth -= 1
                return at + 1
        at += 1
        while True:
            c = s[at : at + 1]
            if not c:
                raise Bad("open jsx")
            if c == "{":
                at = self.embedded(at, True)
            elif c == "<":
                inner = self.ws(at + 1)
                if s.startswith("/", inner):
                    at = self.ws(inner + 1)
                    close = ""
                    if not s.startswith(">", at):
                        close, at = self.jsx_name(at)
                    if close != tag or not s.startswith(">", at):
                        raise Bad(f"jsx tag {tag} closed by {close}")
                    self.depth -= 1
                    return at + 1
                at = self.element(at)
            elif c in ">}":
                raise Bad("jsx text")
            else:
                at += 1


def check(text: str, dialect: str) -> None:
    if dialect == "js" and ("<!--" in text or "-->" in text):
        # line comments of scripts only; a module must parse without them
        script = re.sub(r"(?m)<!--[^\n]*|^\s*-->[^\n]*", "", text)
        if not re.search(r"(?m)^\s*(import|export)\b", script):
            text = script
    Grammar(text, dialect).program()
