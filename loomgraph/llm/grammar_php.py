"""Local grammar of current PHP: says whether a balanced piece parses. Builds no tree.

Used per piece inside Spark tasks. ``check(text)`` raises ``Bad``.
"""

from __future__ import annotations

import re

from loomgraph.llm.grammar_js import MAX_DEPTH, Bad, Deep

_TOKEN = r"""(?P<shut>\?>)
    |(?P<num>0[xX][\da-fA-F]+(?:_[\da-fA-F]+)*|0[bB][01]+(?:_[01]+)*|0[oO][0-7]+(?:_[0-7]+)*|(?:\d+(?:_\d+)*)?\.\d+(?:_\d+)*(?:[eE][+-]?\d+)?|\d+(?:_\d+)*\.?(?:[eE][+-]?\d+)?)
    |(?P<var>\$[^\W\d]\w*)
    |(?P<id>\\?[^\W\d]\w*(?:\\[^\W\d]\w*)*(?:\\(?=\s*\{))?)
    |(?P<str>[bB]?'(?:[^'\\]|\\[\s\S])*')
    |(?P<cast>\(\s*(?i:int|integer|bool|boolean|float|double|real|string|binary|array|object|unset)\s*\))
    |(?P<p><<<|\?->|\?\?=|\.\.\.|<=>|===|!==|\*\*=|<<=|>>=|=>|->|::|==|!=|<>|<=|>=|&&|\|\||\?\?|\+\+|--|\+=|-=|\*=|/=|\.=|%=|&=|\|=|\^=|<<|>>|\*\*|\#\[|[{}()\[\];,<>+\-*/%&|^!~?:=.@$`"])"""
_SKIP = re.compile(r"(?:\s+|(?://|#(?!\[))(?:(?!\?>)[^\n\r])*|/\*[\s\S]*?\*/)*")
#: Blanks and comments, then a token if there is one.
_NEXT = re.compile(_SKIP.pattern.replace("#", r"\#") + "(?:" + _TOKEN + ")?", re.X)
_OPEN = re.compile(r"<\?(?:php(?=\s|$)|=)", re.I)
_HEREDOC = re.compile(r"<<<[ \t]*(?:(['\"]?)([^\W\d]\w*)\1)\r?\n")

# Words of the language.
RESERVED = set(
    "abstract and array as break callable case catch class clone const continue declare default do echo else elseif empty enddeclare endfor endforeach endif endswitch endwhile exit extends final finally fn for foreach function global goto if implements include include_once instanceof insteadof interface isset list match namespace new or print private protected public readonly require require_once return static switch throw trait try unset use var while xor yield die eval".split()
)
ASSIGN = set("= += -= *= /= .= %= **= ??= &= |= ^= <<= >>=".split())
BINARY = set("|| && ?? | ^ & == != <> === !== < > <= >= <=> << >> + - . * / % ** and or xor instanceof".split())
MODIFIERS = set("public protected private static abstract final readonly var".split())
TYPE_WORDS = {"array", "callable", "static"}


class Grammar:
    def __init__(self, text: str):
        self.s, self.pos, self.end, self.depth = text, 0, 0, 0
        self.html()
        self.step()

    def bad(self, why: str = "unexpected") -> Bad:
        return Bad(f"{why} at {self.pos}: {self.s[self.pos:self.pos + 20]!r}")

    def html(self) -> None:
        """Skip inline text up to the next opening tag."""
        m = _OPEN.search(self.s, self.end)
        self.end = m.end() if m else len(self.s)
        self.echo = bool(m and m.group() == "<?=")

    def step(self) -> None:
        m = _NEXT.match(self.s, self.end)
        kind, self.end = m.lastgroup, m.end()
        v = m[kind] if kind else ""
        self.pos = at = self.end - len(v)
        if not kind:
            if at < len(self.s):
                raise self.bad("no token")
            self.kind, self.v, self.w = "eof", "", ""
            return
        if v == "/" and self.s.startswith("*", at + 1):
            raise self.bad("no token")
        self.kind, self.v = ("p" if kind == "shut" else kind), v
        self.w = v.lower() if kind == "id" else v

    w = ""
    echo = False

    def at(self, *vs: str) -> bool:
        return (self.kind == "p" and self.v in vs) or (self.kind == "id" and self.w in vs)

    def eat(self, *vs: str) -> bool:
        if self.at(*vs):
            self.step()
            return True
        return False

    def need(self, v: str) -> None:
        if not self.eat(v):
            raise self.bad(f"expected {v}")

    def peek(self) -> tuple[str, str]:
        st = self.pos, self.end, self.kind, self.v, self.w
        self.step()
        out = self.kind, self.w if self.kind == "id" else self.v
        self.pos, self.end, self.kind, self.v, self.w = st
        return out

    def semi(self) -> None:
        if self.at("?>"):
            return self.close_tag()
        self.need(";")

    def close_tag(self) -> None:
        self.html()
        echo = self.echo
        self.step()
        if echo:
            self.expr()
            while self.eat(","):
                self.expr()
            self.semi() if self.kind != "eof" else None

    def word(self) -> None:
        """A name that may be a reserved word (member, constant)."""
        if self.kind != "id" or "\\" in self.v:
            raise self.bad("name")
        self.step()

    def name(self, qualified: bool = False) -> None:
        if self.kind != "id" or ("\\" in self.v and not qualified) or self.w in RESERVED - {"enum"}:
            raise self.bad("name")
        self.step()

    # statements
    def program(self) -> None:
        if self.echo:
            self.expr()
            self.semi() if self.kind != "eof" else None
        while self.kind != "eof":
            if self.eat("__halt_compiler"):
                return
            self.statement()

    def block(self) -> None:
        self.need("{")
        while not self.at("}"):
            if self.kind == "eof":
                raise self.bad("open block")
            self.statement()
        self.step()

    def until(self, *words: str) -> None:
        while not self.at(*words):
            if self.kind == "eof":
                raise self.bad("open block")
            self.statement()

    def statement(self) -> None:
        self.depth += 1
        if self.depth > MAX_DEPTH:
            raise Deep
        self._statement()
        self.depth -= 1

    def _statement(self) -> None:
        if self.at("?>"):
            return self.close_tag()
        if self.at("{"):
            return self.block()
        if self.eat(";"):
            return
        if self.at("#["):
            self.attributes()
            return self._statement()
        if self.kind == "id" and self.w in self.WORDS:
            k, v = self.peek()
            if not (self.w in ("static", "function", "fn", "enum", "readonly", "abstract", "final", "namespace") and self.expression_word(k, v)):
                return getattr(self, "s_" + self.w)()
        if self.kind == "id" and "\\" not in self.v and self.w not in RESERVED and self.peek() == ("p", ":"):
            self.step()
            self.step()
            return
        self.expr()
        self.semi()

    def expression_word(self, k: str, v: str) -> bool:
        if self.w == "static":
            return k != "var"
        if self.w == "function":
            return v in ("(", "&") and not (v == "&" and self.named_after_amp())
        if self.w == "enum":
            return k != "id"
        if self.w == "readonly":
            return v == "("
        return self.w == "fn"

    def named_after_amp(self) -> bool:
        m = _SKIP.match(self.s, self.s.index("&", self.end) + 1)
        return bool(re.match(r"[^\W\d]", self.s[m.end() : m.end() + 1]))

    WORDS = set(
        "namespace use const function abstract final readonly class interface trait enum if while do for foreach switch try return break continue echo global static unset declare goto".split()
    )

    def s_namespace(self) -> None:
        self.step()
        if self.kind == "id":
            self.step()
        if self.at("{"):
            self.block()
        else:
            self.semi()

    def s_use(self) -> None:
        self.step()
        self.eat("function", "const")
        while True:
            if self.kind != "id":
                raise self.bad("use")
            self.step()
            if self.eat("as"):
                self.word()
            if self.at("{"):
                self.step()
                while not self.at("}"):
                    self.eat("function", "const")
                    self.name(True)
                    if self.eat("as"):
                        self.word()
                    if not self.at("}"):
                        self.need(",")
                self.step()
            if not self.eat(","):
                break
        self.semi()

    def s_const(self) -> None:
        self.step()
        while True:
            self.word()
            self.need("=")
            self.expr()
            if not self.eat(","):
                break
        self.semi()

    def s_function(self) -> None:
        self.step()
        self.eat("&")
        self.name()
        self.params()
        if self.eat(":"):
            self.type()
        self.block()

    def params(self) -> None:
        self.need("(")
        while not self.at(")"):
            if self.at("#["):
                self.attributes()
            while self.at("public", "protected", "private", "readonly") or (self.at("static") and False):
                self.step()
                if self.eat("("):
                    self.need("set")
                    self.need(")")
            if self.kind != "var" and not self.at("&", "..."):
                self.type()
            self.eat("&")
            self.eat("...")
            if self.kind != "var":
                raise self.bad("parameter")
            self.step()
            if self.eat("="):
                self.expr()
            if self.at("{"):
                self.hooks()
            if not self.at(")"):
                self.need(",")
        self.step()

    def type(self) -> None:
        self.eat("?")
        while True:
            if self.eat("("):
                self.type()
                self.need(")")
            elif self.kind == "id" and (self.w not in RESERVED or self.w in TYPE_WORDS):
                self.step()
            else:
                raise self.bad("type")
            if self.at("&"):
                k, v = self.peek()
                if k == "var" or v in ("&", "..."):
                    return
                self.step()
            elif not self.eat("|"):
                return

    def s_abstract(self) -> None:
        while self.at("abstract", "final", "readonly"):
            self.step()
        if not self.at("class"):
            raise self.bad("class")
        self.s_class()

    s_final = s_readonly = s_abstract

    def s_class(self) -> None:
        self.step()
        self.name()
        self.class_rest()

    def names(self) -> None:
        self.name(True)
        while self.eat(","):
            self.name(True)

    def class_rest(self) -> None:
        if self.eat("extends"):
            self.names()
        if self.eat("implements"):
            self.names()
        self.members()

    def s_interface(self) -> None:
        self.step()
        self.name()
        if self.eat("extends"):
            self.names()
        self.members()

    def s_trait(self) -> None:
        self.step()
        self.name()
        self.members()

    def s_enum(self) -> None:
        self.step()
        self.name()
        if self.eat(":"):
            self.type()
        if self.eat("implements"):
            self.names()
        self.members()

    def members(self) -> None:
        self.need("{")
        while not self.at("}"):
            if self.kind == "eof":
                raise self.bad("open class")
            self.member()
        self.step()

    def member(self) -> None:
        if self.at("#["):
            self.attributes()
        if self.at("use"):
            self.step()
            self.names()
            if self.eat("{"):
                while not self.at("}"):
                    if self.kind != "id":
                        raise self.bad("trait rule")
                    self.step()
                    if self.eat("::"):
                        self.word()
                    if self.eat("insteadof"):
                        self.names()
                    else:
                        self.need("as")
                        while self.at("public", "protected", "private"):
                            self.step()
                        if not self.at(";"):
                            self.word()
                    self.semi()
                self.step()
                return
            return self.semi()
        if self.eat("case"):
            self.word()
            if self.eat("="):
                self.expr()
            return self.semi()
        some = False
        while self.kind == "id" and self.w in MODIFIERS:
            some = True
            self.step()
            if self.at("(") and self.s.startswith("set", _SKIP.match(self.s, self.end).end()):
                self.step()
                self.step()
                self.need(")")
        if self.eat("const"):
            if self.peek()[1] != "=":
                self.type()
            while True:
                self.word()
                self.need("=")
                self.expr()
                if not self.eat(","):
                    break
            return self.semi()
        if self.eat("function"):
            self.eat("&")
            self.word()
            self.params()
            if self.eat(":"):
                self.type()
            if self.at("{"):
                return self.block()
            return self.semi()
        if not some:
            raise self.bad("member")
        if self.kind != "var":
            self.type()
        while True:
            if self.kind != "var":
                raise self.bad("property")
            self.step()
            if self.eat("="):
                self.expr()
            if self.at("{"):
                return self.hooks()
            if not self.eat(","):
                break
        self.semi()

    def hooks(self) -> None:
        self.need("{")
        while not self.at("}"):
            self.eat("final")
            self.eat("&")
            if not self.eat("get", "set"):
                raise self.bad("hook")
            if self.at("("):
                self.params()
            if self.eat("=>"):
                self.expr()
                self.semi()
            elif self.at("{"):
                self.block()
            else:
                self.semi()
        self.step()

    def attributes(self) -> None:
        self.need("#[")
        while not self.at("]"):
            self.name(True)
            if self.at("("):
                self.args()
            if not self.at("]"):
                self.need(",")
        self.step()

    def paren(self) -> None:
        self.need("(")
        self.expr()
        self.need(")")

    def s_if(self) -> None:
        self.step()
        self.paren()
        if self.eat(":"):
            self.until("elseif", "else", "endif")
            while self.eat("elseif"):
                self.paren()
                self.need(":")
                self.until("elseif", "else", "endif")
            if self.eat("else"):
                self.need(":")
                self.until("endif")
            self.step()
            return self.semi()
        self.statement()
        while self.eat("elseif"):
            self.paren()
            self.statement()
        if self.eat("else"):
            self.statement()

    def tail(self, word: str) -> None:
        if self.eat(":"):
            self.until(word)
            self.step()
            return self.semi()
        self.statement()

    def s_while(self) -> None:
        self.step()
        self.paren()
        self.tail("endwhile")

    def s_do(self) -> None:
        self.step()
        self.statement()
        self.need("while")
        self.paren()
        self.semi()

    def s_for(self) -> None:
        self.step()
        self.need("(")
        for stop in (";", ";", ")"):
            while not self.at(stop):
                self.expr()
                if not self.at(stop):
                    self.need(",")
            self.step()
        self.tail("endfor")

    def s_foreach(self) -> None:
        self.step()
        self.need("(")
        self.expr()
        self.need("as")
        self.eat("&")
        self.expr()
        if self.eat("=>"):
            self.eat("&")
            self.expr()
        self.need(")")
        self.tail("endforeach")

    def s_switch(self) -> None:
        self.step()
        self.paren()
        end = "}"
        if self.eat(":"):
            end = "endswitch"
        else:
            self.need("{")
        while not self.at(end):
            if self.at("?>"):
                self.close_tag()
                continue
            if self.eat("case"):
                self.expr()
            else:
                self.need("default")
            if not self.eat(":", ";"):
                raise self.bad("case")
            self.until("case", "default", end)
        self.step()
        if end != "}":
            self.semi()

    def s_try(self) -> None:
        self.step()
        self.block()
        some = False
        while self.eat("catch"):
            some = True
            self.need("(")
            self.type()
            if self.kind == "var":
                self.step()
            self.need(")")
            self.block()
        if self.eat("finally"):
            some = True
            self.block()
        if not some:
            raise self.bad("try")

    def s_return(self) -> None:
        self.step()
        if not self.at(";", "?>"):
            self.expr()
        self.semi()

    def s_break(self) -> None:
        self.step()
        if self.kind == "num":
            self.step()
        self.semi()

    s_continue = s_break

    def s_echo(self) -> None:
        self.step()
        self.expr()
        while self.eat(","):
            self.expr()
        self.semi()

    s_global = s_echo

    def s_static(self) -> None:
        self.step()
        while True:
            if self.kind != "var":
                raise self.bad("static")
            self.step()
            if self.eat("="):
                self.expr()
            if not self.eat(","):
                break
        self.semi()

    def s_unset(self) -> None:
        self.step()
        self.args()
        self.semi()

    def s_goto(self) -> None:
        self.step()
        self.name()
        self.semi()

    def s_declare(self) -> None:
        self.step()
        self.need("(")
        while True:
            self.word()
            self.need("=")
            self.expr()
            if not self.eat(","):
                break
        self.need(")")
        if self.eat(";"):
            return
        self.tail("enddeclare")

    # expressions
    def expr(self) -> str:
        self.depth += 1
        if self.depth > MAX_DEPTH:
            raise Deep
        k = self.operand()
        while True:
            v = self.w if self.kind == "id" else self.v
            if self.kind == "p" and v in ASSIGN:
                if k not in ("lval", "list"):
                    raise self.bad("target")
                self.step()
                if v == "=":
                    self.eat("&")
                self.operand()
                k = "value"
            elif self.kind in ("p", "id") and v in BINARY:
                self.step()
                k = self.operand()
            elif self.kind == "p" and v == "?":
                self.step()
                if not self.eat(":"):
                    self.expr()
                    self.need(":")
                k = self.operand()
            else:
                break
        self.depth -= 1
        return k

    def operand(self) -> str:
        if self.kind == "cast":
            self.step()
            return self.operand()
        if self.at("!", "~", "+", "-", "@", "&"):
            if self.v == "&":
                raise self.bad()
            self.step()
            k = self.operand()
            return k if k == "lval" else "value"
        if self.at("++", "--"):
            self.step()
            if self.operand() != "lval":
                raise self.bad("++")
            return "value"
        if self.kind == "id" and self.w in ("new", "clone", "print", "throw", "include", "include_once", "require", "require_once", "yield"):
            return getattr(self, "x_" + self.w.split("_")[0])()
        k = self.postfix(self.primary())
        if self.at("++", "--"):
            if k != "lval":
                raise self.bad("++")
            self.step()
            return "value"
        return k

    def x_new(self) -> str:
        self.step()
        if self.at("#["):
            self.attributes()
        self.eat("readonly")
        if self.eat("class"):
            if self.at("("):
                self.args()
            self.class_rest()
            return self.postfix("value")
        if self.at("("):
            self.paren()
        elif self.kind == "id" and (self.w not in RESERVED or self.w == "static"):
            self.step()
        elif self.kind == "var" or self.at("$"):
            self.primary()
            while True:
                if self.eat("->", "?->", "::"):
                    if self.kind == "var":
                        self.step()
                    else:
                        self.word()
                elif self.eat("["):
                    self.expr()
                    self.need("]")
                else:
                    break
        else:
            raise self.bad("new")
        if self.at("("):
            self.args()
        return self.postfix("value")

    def x_clone(self) -> str:
        self.step()
        self.operand()
        return "value"

    def x_print(self) -> str:
        self.step()
        self.expr()
        return "value"

    x_throw = x_include = x_require = x_print

    def x_yield(self) -> str:
        self.step()
        if self.eat("from"):
            self.expr()
        elif not self.at(";", ")", ",", "]", "?>"):
            self.expr()
            if self.eat("=>"):
                self.expr()
        return "value"

    def args(self) -> None:
        self.need("(")
        if self.at("...") and self.peek()[1] == ")":
            self.step()
            return self.step()
        while not self.at(")"):
            if self.kind == "id" and "\\" not in self.v and self.peek() == ("p", ":"):
                self.step()
                self.step()
            self.eat("...")
            self.expr()
            if not self.at(")"):
                self.need(",")
        self.step()

    def postfix(self, k: str) -> str:
        while True:
            if self.at("["):
                self.step()
                if not self.at("]"):
                    self.expr()
                self.need("]")
                k = "lval"
            elif self.at("{") and k == "never":
                return k
            elif self.at("->", "?->"):
                self.step()
                if self.kind == "var":
                    self.step()
                elif self.eat("{"):
                    self.expr()
                    self.need("}")
                elif self.at("$"):
                    self.primary()
                else:
                    self.word()
                k = "lval"
            elif self.at("::"):
                self.step()
                if self.kind == "var":
                    self.step()
                    k = "lval"
                elif self.at("$"):
                    self.primary()
                    k = "lval"
                elif self.eat("{"):
                    self.expr()
                    self.need("}")
                    k = "value"
                else:
                    self.word()
                    k = "value"
            elif self.at("("):
                if k == "literal":
                    return k
                self.args()
                k = "call"
            else:
                return "lval" if k == "call" else k

    def primary(self) -> str:
        if self.kind == "var":
            self.step()
            return "lval"
        if self.kind == "num":
            self.step()
            return "literal"
        if self.kind == "str":
            self.step()
            return "value"
        if self.kind == "p":
            v = self.v
            if v == "$":
                self.step()
                if self.eat("{"):
                    self.expr()
                    self.need("}")
                elif self.kind == "var":
                    self.step()
                else:
                    self.primary()
                return "lval"
            if v == "(":
                self.step()
                self.expr()
                self.need(")")
                return "paren"
            if v == "[":
                self.step()
                self.items("]")
                return "list"
            if v in ('"', "`"):
                self.end = self.interpolated(self.pos + 1, v)
                self.step()
                return "value"
            if v == "<<<":
                return self.heredoc()
            if v == "#[":
                self.attributes()
                return self.primary()
            raise self.bad()
        if self.kind != "id":
            raise self.bad()
        w = self.w
        if w in ("array", "list") and self.peek()[1] == "(":
            self.step()
            self.step()
            self.items(")")
            return "list" if w == "list" else "value"
        if w in ("isset", "empty", "exit", "die", "eval"):
            self.step()
            if self.at("("):
                self.args()
            elif w in ("isset", "empty", "eval"):
                raise self.bad(w)
            return "value"
        if w == "static" and self.peek()[1] in ("function", "fn"):
            self.step()
            w = self.w
        if w == "function":
            self.step()
            self.eat("&")
            self.params()
            if self.eat("use"):
                self.need("(")
                while not self.at(")"):
                    self.eat("&")
                    if self.kind != "var":
                        raise self.bad("use")
                    self.step()
                    if not self.at(")"):
                        self.need(",")
                self.step()
            if self.eat(":"):
                self.type()
            self.block()
            return "literal"
        if w == "fn":
            self.step()
            self.eat("&")
            self.params()
            if self.eat(":"):
                self.type()
            self.need("=>")
            self.expr()
            return "literal"
        if w == "match" and self.peek()[1] == "(":
            self.step()
            self.paren()
            self.need("{")
            while not self.at("}"):
                if not self.eat("default"):
                    while True:
                        self.expr()
                        if not self.eat(",") or self.at("=>"):
                            break
                else:
                    self.eat(",")
                self.need("=>")
                self.expr()
                if not self.at("}"):
                    self.need(",")
            self.step()
            return "value"
        if w in RESERVED and w not in ("static", "enum", "readonly"):
            raise self.bad("reserved word")
        self.step()
        if w == "static" and not self.at("::"):
            raise self.bad("static")
        return "name"

    def items(self, close: str) -> None:
        while not self.at(close):
            if self.eat(","):
                continue
            if not self.eat("..."):
                self.eat("&")
            self.expr()
            if self.eat("=>"):
                self.eat("&")
                self.expr()
            if not self.at(close):
                self.need(",")
        self.step()

    def interpolated(self, at: int, close: str) -> int:
        """Offset behind the closing quote; ``{$...}`` and ``${...}`` are parsed as expressions."""
        s = self.s
        while True:
            c = s[at : at + 1]
            if not c:
                raise Bad(f"open string {close}")
            if c == "\\":
                at += 2
            elif c == close:
                return at + 1
            elif s.startswith(("{$", "${"), at):
                at = self.inner(at)
            else:
                at += 1

    def inner(self, at: int) -> int:
        self.end = at + (2 if self.s.startswith("${", at) else 1)
        self.step()
        self.expr()
        if not self.at("}"):
            raise self.bad("interpolation")
        return self.end

    def heredoc(self) -> str:
        m = _HEREDOC.match(self.s, self.pos)
        if not m:
            raise self.bad("heredoc")
        close = re.compile(rf"^[ \t]*{m.group(2)}\b", re.M)
        end = close.search(self.s, m.end())
        if not end:
            raise self.bad("open heredoc")
        if m.group(1) != "'":
            at = m.end()
            while at < end.start():
                if self.s[at] == "\\":
                    at += 2
                elif self.s.startswith(("{$", "${"), at):
                    at = self.inner(at)
                else:
                    at += 1
        self.end = end.end()
        self.step()
        return "value"


def check(text: str) -> None:
    Grammar(text).program()
