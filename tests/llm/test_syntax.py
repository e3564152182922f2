import json
from datetime import datetime
from functools import reduce

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomgraph.llm import lexmap as M
from loomgraph.llm import syntax as S

GOOD = {
    "js": [
        "", "#!/usr/bin/env node\nlet a = 1", "const {a, b: [c = 1], ...d} = x, e = /[/}]\\/(/g.test(y) ? 1 : 2", "a = b\n/c/g.d", "x = y / z / 2", "`a${b + `c${d}`}e`", "async () => { for await (const x of y) await z }",
        "class A extends B { #p = 1; static { this.q = 2 } get x() { return this.#p } async *g() { yield* 1 } static async m() {} 'k'() {} [z]() {} }", "label: for (;;) { continue label }", "if (a) b; else c\ndo x(); while (y) z()",
        "export default class {}", "export * as ns from 'm'; import d, { e as f } from \"g\"; import('x')", "var let_ = 1; with (a) b", "a?.b?.[c]?.(d) ?? e", "({ async f() {}, get a() { return 1 }, set a(v) {}, b, 'c': 1, [d]: 2, ...e })",
        "({ a = 1 } = b)", "([x, y] = [y, x])", "<!-- html comment\nvar a = 1\n--> end", "new (foo())(1), new a.b.C, new.target", "x = async a => a, y = (a, b = 1, ...c) => ({}), z = a => b => c", "switch (a) { case 1: b; break; default: }",
        "try { a } catch { b } finally { c }", "// <<<<<<< only text\nconst s = '=======';", "0x1F + 1_000n + .5e-3 + 0b11", "throw new Error('a')", "for (const k in o) if (k in p) delete o[k]", "'use strict'\nvar \\u0061b = \"\\u{1F600}\"", "a\n++b", "yield_: 1", "return_ = 1",
    ],
    "ts": [
        "interface A<T extends B = C> extends D, E<F> { readonly a?: string; [k: string]: any; (x: number): void; new (y): Z; m<T>(a: T): a is string; get x(): number }", "type A = { [K in keyof T]?: T[K] } | readonly string[] | [a: number, b?: string, ...c: X[]]",
        "type F = (a: number, ...b: string[]) => void; type G = abstract new () => A; type H = T extends (infer U)[] ? U : never", "let x = <Foo>y; let z = y as const; let w = a!.b!; let v = x satisfies Y", "function f(this: A, a?: number, b = 1): asserts a is number {}",
        "function o(a: string): void; function o(a: any) {}", "abstract class A<T> extends B<T> implements C, D { private readonly a: number = 1; declare b: string; constructor(private x: number, public y?: string) { super() } abstract m(): void; static #z?: T; override n() {} }",
        "enum E { A = 1, B = 'x' } const enum F { A } declare module 'm' { export function f(): void } namespace N.M { export const a = 1 }", "import type { A } from 'a'; import { type B, C } from 'b'; export type { A }; import x = require('y'); export = x;",
        "const f = <T,>(a: T): T => a; const g = async <T>(x: T) => x; f<string>('a'); new Map<string, Array<number>>()", "a < b && c > d; if (a < b || c >= (d >> 2)) {}", "@Comp({ a: 1 }) class A { @Input() b: string; @Out c }", "let t: typeof import('x').y; let u: `a${string}`; let k: unique symbol",
        "for (const x of y as Z[]) {}", "type A = B['c'][number]", "let f: { (a: number): string }['x']", "declare global { interface W { a: 1 } }", "x = y ? (z) : w", "x = a ? (b): number => c : d",
    ],
    "tsx": ["const a = <A b='c' {...d} e={<F />} g:h=\"i\">text {x} {/* c */}<></><B.C>it's > no</B.C></A>".replace(" > ", " "), "function A<T,>(p: T) { return (<div>{p.x.map((y) => <li key={y}>{`a${y}`}</li>)}</div>) }", "const x = a < b"],
    "php": [
        "plain text <b>", "<?php", "<?= $a ?> html <?php if ($x): ?> y <?php elseif ($z): ?> w <?php endif; ?>", "<?php namespace A\\B { use C\\{D, E as F}; const G = 1; function h() {} }", "<?php\nabstract class A extends B implements C, D { use T, U { a as protected b; T::x insteadof U; } public const int X = 1; private ?int $a = 1, $b; public function __construct(private readonly array $x = [], protected ?self $y = null) {} abstract protected function m(int|string $a, A&B ...$c): static; }",
        "<?php enum S: string implements I { case A = 'a'; const B = self::A; public static function f(): self { return self::A; } }", "<?php $a = fn(int $x): int => $x * 2; $b = static function () use (&$c, $d): void {}; $e = $f?->g()?->h ?? $i['j'][0]->{$k}::$l;", "<?php echo match(true) { $a, $b => 1, default => throw new E() }, \"x {$a['b']} ${c} $d[0] \\\" { \";",
        "<?php $x = <<<EOT\n  text {$a->b()} ' \"\n  EOT . 'z'; $y = <<<'N'\n} ) ]\nN;", "<?php #[Attr(1, name: 'x')] function f(#[A] int $a) {} f(...); g(...$a, b: 1);", "<?php [$a, 'k' => [$b]] = $c; list(, $d) = $e; foreach ($f as ['x' => $y]) {} foreach ($g as $k => &$v):\n endforeach;",
        "<?php declare(strict_types=1); goto a; a: while (1): break 2; endwhile; do {} while (0); for (;;) {} switch ($a) { case 1; default: }", "<?php try { a(); } catch (A | B) {} finally {} $o = new class(1) extends B {}; $p = (string) $q . -1 ** 2; $r = $s instanceof T; @$u[] = &$v; print 'a' and 1;",
        "<?php function &f() { yield; $x = yield $a => $b; yield from g(); return; } static fn() => 1; $z = new ($a . 'B')(1); echo $a::class, A::{$b}(); // } ) ]\n# {\n/* ( */", "<?php class P { public string $n { get => $this->n; set(string $v) { $this->n = $v; } } public private(set) int $q; }", "<?php interface I extends J { const A = 1; public function m(); } trait T { abstract function x(); static $y; }", "<?php `ls {$a}`; __halt_compiler(); <<<<<<< anything",
    ],
    "py": ["", "match x:\n    case [1, *r] if r: pass\n", "def f(a, /, b, *, c): return (y := 1)\n", "\ufeffx = f'{a!r:>{w}}'\n", "async def g():\n    async with a as b, c: await d\n", "class A[T]: pass\ntype X = int\n", "s = '''\n} ) ]\n'''\r\n"],
}
BAD = {
    "js": ["<?php echo 1;", "interface A { a: string }", "const a: number = 1", "function f( {", "class A { m() { }", "a b", "x = ;", "`a${b", "'abc", "/* open", "<!DOCTYPE html>\n<html></html>", "<<<<<<< HEAD\na\n=======\nb\n>>>>>>> c", "\x01\x02", "return 1", "let x = (1, ];", "a = <B/>", "import { a } from './b;\n", "const q;", "1 = 2", "if (a) { } } ", "for (a b c) {}", "else {}", "({ a = 1 })", "export interface X {}", "def f(x):\n    return x", "x => { ) }", "break"],
    "ts": ["const a = <div id='x'>t</div>", "interface A { a: }", "type = 3 4", "class A { a: number b: string }", "function f(a: ) {}", "let x: Array<string = 1;", "enum E { A = }", "import a from", "abstract clas A {}"],
    "tsx": ["const a = <A></B>;", "const a = <A>", "const a = <A b=>x</A>", "const x = <A>{</A>", "from a import b\n\n\nclass C:\n    pass", "const a = <p>a } b</p>"],
    "php": ["<?php class A {", "<?php function f( { }", "<?php $a = ;", "<?php echo 'abc", "<?php if ($a) { } }", "<?php $a = [1, 2;", "<?php class { }", "<?php foreach ($a) {}", "<?php <<<<<<< HEAD\n$a;\n=======\n$b;\n>>>>>>> x", "<?php \x01", "<?php function list() {}", "<?php use A\\;", "<?php $x = <<<E\nabc", "<?php public function f() {}", "<?php 1 = $a;", "<?php import a from 'b';", "<?php \"x {$a[\";", "<?php return [1 => 2 3];", "<?php class A { $x; }"],
    "py": ["print 'a'", "def f(:\n  pass", "x = (1,\n", "class A:\n", "<?php", "'''open", "if x:\npass", "return 1", "a = 1\n<<<<<<< x\n"],
}


@pytest.mark.parametrize("lang,text", [(k, t) for k, v in GOOD.items() for t in v])
def test_valid(lang, text):
    assert S.fault(lang, text) is None


@pytest.mark.parametrize("lang,text", [(k, t) for k, v in BAD.items() for t in v])
def test_invalid(lang, text):
    assert S.fault(lang, text) is not None


def test_typescript_takes_javascript():
    for t in GOOD["js"]:
        if "<!--" not in t:
            assert S.fault("ts", t) is None, t


def test_truncations_of_a_balanced_file_are_invalid():
    text = "class A {\n  m(a, b) {\n    return [a, (b)];\n  }\n}\n"
    assert all(S.fault("js", text[:i]) for i in range(9, len(text) - 2))


def test_nesting():
    """Beyond the old bound of 400 levels texts are judged; beyond the bound of now they are undecided."""
    with S._roomy():
        _nesting()


def _nesting():
    assert S._parse("js", "(" * 900 + "1" + ")" * 900) == (None, False) and S._parse("php", "<?php " + "[" * 900 + "]" * 900 + ";") == (None, False)
    assert S.fault("js", "(" * 900 + "1 2" + ")" * 900) and S.fault("php", "<?php " + "[" * 900 + "1 2" + "]" * 900 + ";")
    assert S._parse("js", "(" * 5000 + "1" + ")" * 5000) == (None, True) and S._parse("php", "<?php " + "[" * 5000 + "]" * 5000 + ";") == (None, True)


SOURCE = {
    "js": "function a() { return `x${ {b: 1}.b } } ${`y`}`; }\n/* c { \n } */ const d = '{';\nexport class E {\n  m() { return [1, (2)]; } // }\n}\nlet f = 1;\n",
    "py": "import a\n\n@dec\ndef f():\n    '''} ) '''\n    return {1: [2]}\n\nclass B:\n    x = \"\"\"\n(\n\"\"\"\n# ]\nC = 1\n",
    "php": "<?php\nnamespace A;\nclass B {\n  function c() { return \"{ {$x}\n ]\"; }\n}\n$d = <<<EOT\n } ) EOTX\nEOT;\nfunction e() {}\n?>\n{ html\n<?php\nfinal class F {}\n",
}


@settings(max_examples=80, deadline=None)
@given(st.sampled_from(sorted(SOURCE)), st.lists(st.integers(1, 60), min_size=1, max_size=6))
def test_chunk_maps_compose_associatively(lang, sizes):
    text, labels, parts = SOURCE[lang], ["EOT"], []
    for n in sizes:
        p = M.lines(text, n)
        parts.append(p[0])
        text = text[len(p[0]):]
        if not text:
            break
    parts = [p for p in [*parts, text] if p]
    maps = [M.chunk_map(lang, p, labels) for p in parts]
    left = reduce(M.compose, maps)
    right = reduce(lambda a, b: M.compose(b, a), reversed(maps))
    assert left == right
    start = "h" if lang == "php" else "c"
    whole = M.scan(lang, SOURCE[lang], start)
    assert (left[start].out, left[start].closers, left[start].openers, left[start].odd) == (whole.out, "", "", False) or left[start].odd


SRC = "file_path string, repo string, language string, content string, n_bytes long, fetched_at timestamp_ntz, valid boolean, no int"


def frame(spark, rows):
    return spark.createDataFrame([(p, "r", None, c, 1, t, True, 0) for p, c, t in rows], SRC)


T0, T1 = datetime(2025, 1, 1), datetime(2025, 2, 1)


def test_current_content_counts(spark):
    rows = [("/a.js", "a b", T0), ("/a.js", "ok()", T1), ("/a.js", "ok()", T1), ("/b.py", "x = 1", T0), ("/b.py", "x =", T1), ("/c.php", None, T1), ("/d.ts", "", T0), ("/e.txt", "((", T0), (None, "((", T0), ("\\w\\f.TSX", "<a", None)]
    got = {r.file_path: r.valid for r in S.verdicts(frame(spark, rows)).collect()}
    assert got == {"/a.js": True, "/b.py": False, "/d.ts": True, "\\w\\f.TSX": False}
    assert S.verdicts(frame(spark, [])).count() == 0


@pytest.mark.parametrize("chunk", [30, 90])
def test_chunks_change_no_verdict(spark, chunk):
    rows = [(f"/{lang}{i}.{lang}", t, T0) for lang, ts in (*GOOD.items(), *BAD.items()) for i, t in enumerate(ts)]
    rows = [(p.replace("/", f"/{k}"), c, t) for k, (p, c, t) in enumerate(rows)]
    rows += [(f"/big{i}.{lang}", SOURCE[lang] * 3 + tail, T0) for lang in SOURCE for i, tail in enumerate(("", "\n(", "\n" + "x" * 100))]
    df = frame(spark, rows)
    verdict = lambda c: {r.file_path: r.valid for r in S.verdicts(df, c).collect()}
    assert verdict(chunk) == verdict(10**6)


def test_rates_and_causes(spark):
    rows = [("/a.js", "<<<<<<< x\na\n=======\nb\n>>>>>>> y\n", T0), ("/b.js", "class A {", T0), ("/c.js", "<?php\n$a;", T0), ("/d.js", "ok()", T0), ("/e.js", "x\x01", T0)]
    v = S.verdicts(frame(spark, rows))
    assert {r.file_path: r.cause for r in v.collect()} == {"/a.js": "merge conflict", "/b.js": "truncated or unclosed", "/c.js": "other language", "/d.js": None, "/e.js": "binary data"}
    r = S.rates(v).collect()[0]
    assert (r.files, r.invalid, r.rate) == (5, 4, 0.8)
    json.dumps([x.asDict() for x in S.rates(v).collect()])


def test_rules_of_the_whole_file_hold_over_pieces(spark):
    rows = [("/a.py", "x = 1\n" * 20 + "from __future__ import annotations\n", T0), ("/b.py", "x = 1\n" * 20 + "import a\nglobal x\n", T0), ("/c.py", "from __future__ import annotations\n" + "import a\n" * 20, T0)]
    for chunk in (30, 10**6):
        assert {r.file_path: r.valid for r in S.verdicts(frame(spark, rows), chunk).collect()} == {"/a.py": False, "/b.py": False, "/c.py": True}


def test_the_summary_decides_without_parsing(spark, monkeypatch):
    """A balance that is surely off is invalid; what is too deep is undecided, where the summary may err too."""
    rows = [("/a.js", "(" * 5000, T0), ("/b.php", "<?php " + "[" * 5000 + "]" * 4999 + ";", T0), ("/c.js", "(" * 5000 + "1" + ")" * 5000, T0), ("/d.js", "a = /x/;" + "(" * 5000, T0)]
    got = {r.file_path: (r.valid, r.cause) for r in S.verdicts(frame(spark, rows)).collect()}
    assert got == {"/a.js": (False, "truncated or unclosed"), "/b.php": (False, "truncated or unclosed"), "/c.js": (None, None), "/d.js": (None, None)}
    r = S.rates(S.verdicts(frame(spark, rows))).where("language = 'js'").collect()[0]
    assert (r.files, r.invalid, r.undecided) == (3, 1, 2)


def placed(lang, text, size):
    """Summary row and pieces of a text, by the operator's own steps."""
    import pandas as pd

    rows = next(S._maps(size)(iter([pd.DataFrame({"file_path": ["p"], "lang": [lang], "content": [text]})])))
    lines = pd.Series(["\n".join(sorted(rows["line"]))])
    p = S._placed(pd.Series([lang]), pd.Series([[S._composed(lines)[0]]]), pd.Series([[lines[0]]])).iloc[0]
    return p["open"], p["odd"], [text[i:j] for i, j in zip(p["cuts"], [*p["cuts"][1:], len(text)])]


@pytest.mark.parametrize("size", [30, 64, 200, 512])
def test_pieces_do_not_depend_on_chunks(size):
    for lang, text in SOURCE.items():
        assert placed(lang, text * 5, size) == placed(lang, text * 5, 10**6)
        assert len(placed(lang, text * 5, size)[2]) > 3


def test_pieces_begin_at_statements():
    js = "const a = 1;\nexport default\nclass A {}\n// note;\nfunction f() {}\nlet b = f\nconst c = 2;\n"
    for size in (8, 20, 10**6):
        assert [p.split("\n")[0] for p in placed("js", js, size)[2]] == ["const a = 1;", "export default", "function f() {}", "let b = f"]
    py = "import a\n@d(\n  1,\n)\n# note\n@e\ndef f():\n    pass\nclass B:\n    x = 1\n"
    for size in (8, 20, 10**6):
        assert [p.split("\n")[0] for p in placed("py", py, size)[2]] == ["import a", "@d(", "class B:"]


def test_most_files_have_several_chunks_and_short_ranges_change_nothing(spark, monkeypatch):
    df = frame(spark, [(f"/big{i}.{lang}", SOURCE[lang] * 9 + tail, T0) for lang in SOURCE for i, tail in enumerate(("", "\n(", "\n" + "x" * 100))])
    verdict = lambda *a: {r.file_path: r.valid for r in S.verdicts(df, *a).collect()}
    want = verdict(10**6)
    assert verdict() == verdict(30) == want and len(set(want.values())) == 2
    monkeypatch.setattr(S, "RANGE", 3)
    assert verdict(30) == want


def test_a_wrong_cut_is_mended_by_the_neighbours():
    text = "const a = <p>;\nfunction x\n</p>;\nlet b = 1;\n"
    assert S._by_pieces("tsx", text, [0, 15, 32]) == (None, False)
    assert S._by_pieces("js", "let a = 1;\nlet b = ;\nlet c = 1;\n", [0, 11, 21])[0]


def test_no_whole_parse_in_the_plan(spark):
    plan = S.verdicts(frame(spark, []), with_cause=False)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInPandas") == 2 and plan.count("_composed") >= 1 and plan.count("_placed") >= 1
