import random
from datetime import datetime

import numpy as np

from loomgraph.llm import handwritten as H

SYM = "id string, name string, type string, file_path string, reason string, owner string"
SRC = "file_path string, repo string, language string, content string, n_bytes long, fetched_at timestamp_ntz, bits double"
WORDS = "order invoice ledger parcel basket tenant voucher report budget gate channel".split()


def code(rnd, repo, n=12):
    body = "\n".join(f"  {rnd.choice(WORDS)}{rnd.choice(WORDS).title()}(value) {{\n    return this.{rnd.choice(WORDS)}.find((row) => row.id === {i});\n  }}" for i in range(n))
    return f"// Copyright 2025 the {repo} team. All rights reserved.\nexport class {rnd.choice(WORDS).title()}Store {{\n{body}\n}}\n"


def minified(rnd, n=90):
    return "".join(f"var {rnd.choice('abcdefg')}{rnd.choice('xyzuvw_$')}={{{rnd.choice('abc')}:{i},k:!0}};!function(e){{e.z&&e.q({i})}}(this);" for i in range(n))


def corpus():
    rnd = random.Random(4)
    files = {f"/srv/trees/{r}/src/{rnd.choice(WORDS)}/File{i}.js": code(rnd, r) for r in ("alpha", "beta", "gamma", "delta") for i in range(25)}
    lib = "/*!\n * fastlib 1.2.3\n * (c) the fastlib contributors, released under the terms in LICENSE-FASTLIB\n */\n"
    bad = {
        "/srv/trees/alpha/src/web/app.js": ("minified", minified(rnd)), "/srv/trees/alpha/node_modules/x/index.js": ("vendored", code(rnd, "x")), "/srv/trees/beta/vendor/lib/src/A.php": ("vendored", "<?php\nnamespace Lib;\nclass A {}\n"),
        "/srv/trees/gamma/src/order/fastlib-1.2.3.js": ("vendored", lib + code(rnd, "fastlib")), "/srv/trees/beta/src/gen/Order.js": ("generated", code(rnd, "beta")), "/srv/trees/beta/src/a/Order9.js": ("generated", "// Code generated by tool. DO NOT EDIT.\n" + code(rnd, "beta")),
        "/srv/trees/beta/src/a/rows.js": ("data", "export const ROWS = [\n" + "".join(f"  [{i * 7919}, 'gate', {i}.5],\n" for i in range(80)) + "];\n"), "/srv/trees/beta/src/a/lib.min.js": ("minified", None), "\\srv\\trees\\beta\\third_party\\q.py": ("vendored", None),
        "/srv/trees/delta/src/a/blob.py": ("data", "X = bytes.fromhex(\n    '" + "0a1b2c" * 90 + "')\n"),
    }
    good = {
        "/srv/trees/beta/src/vendor/Order.js": "// Part of beta. Please edit with care: the build is generated from this file.\n" + code(rnd, "beta"), "/srv/trees/beta/src/generators/GeneratedOrder.js": code(rnd, "beta"),
        "/srv/trees/beta/src/a/settings.js": "export default {\n" + "".join(f"  {w}: {{ limit: {i * 37}, mode: 'auto' }},\n" for i, w in enumerate(WORDS)) + "};\n", "/srv/trees/beta/src/a/none.js": None, "/srv/trees/beta/src/a/empty.js": "",
    }
    return files, bad, good


def frames(spark):
    files, bad, good = corpus()
    every = files | {p: c for p, (_, c) in bad.items()} | good
    t = datetime(2025, 1, 1)
    repo = lambda p: p.replace("\\", "/").split("/")[3]
    src = [(p, repo(p), None, c, 1, t, 0.0) for p, c in every.items() if c is not None or "none" in p]
    sym = [(p, "n", "file", p, "r", "o") for p in every] * 2 + [("m", "name", "method", "/srv/trees/alpha/x.js", "r", "o"), ("q", None, "file", None, None, None)]
    return spark.createDataFrame(sym, SYM), spark.createDataFrame(src + src[:3], SRC), bad


def test_kinds(spark):
    sym, src, bad = frames(spark)
    got = {r.file_path: r.reason for r in H.not_handwritten(sym, src).collect()}
    assert got == {p: k for p, (k, _) in bad.items()}


def test_models_tell_mangled_names(spark):
    _, src, _ = frames(spark)
    m, means = H.train(src)
    assert m["js"].shape == (30, 30, 30) and np.allclose((2 ** -m["js"]).sum(axis=2), 1)
    assert H._bits(m["js"], "orderBasket") < H._bits(m["js"], "q_z$x") and 0 < means["js"] < 4


def planted():
    """Files that neither a path nor a mark nor a licence gives away: reason -> path -> content."""
    rnd = random.Random(9)
    mangled = "\n".join(minified(rnd, 1) for _ in range(90))
    pairs = [(a, b) for a in WORDS for b in WORDS[:6]]
    parts = "export class OrderMessage {\n" + "".join(f"  get{a.title()}{b.title()}() {{\n    return this.{a}_{b};\n  }}\n" for a, b in pairs) + "}\n"
    forms = "export class Rows {\n" + "".join(f"  field{i}() {{\n    return this.cell{i};\n  }}\n" for i in range(60)) + "}\n"
    style = {f"/srv/trees/{r}/src/{r}lib/base.js": "".join(f"export function tnd{w.title()}(x) {{\n  return x.{w};\n}}\n" for w in WORDS[i : i + 7]) for i, r in enumerate(("alpha", "beta", "gamma"))}
    return {"minified": {"/srv/trees/alpha/src/web/q.js": mangled}, "generated": {"/srv/trees/beta/src/a/msg.js": parts, "/srv/trees/gamma/src/a/rows.js": forms}, "vendored": style}


def test_each_model_rule_finds_planted_files_alone(spark):
    files, _, good = corpus()
    bad = planted()
    every = files | {p: c for v in bad.values() for p, c in v.items()} | {p: c for p, c in good.items() if c}
    src = spark.createDataFrame([(p, p.split("/")[3], None, c, 1, datetime(2025, 1, 1), 0.0) for p, c in every.items()], SRC)
    sym = spark.createDataFrame([(p, "n", "file", p, "r", "o") for p in every], SYM)
    j = H.judged(sym, src).collect()
    rule = {"minified": "mangled", "generated": "template", "vendored": "style"}
    for reason, paths in bad.items():
        assert {r.file_path for r in j if r[rule[reason]]} == set(paths), reason
    assert not [r for r in j if r.marked or r.by_path]
    got = {r.file_path: (r.reason, r.rule) for r in H.not_handwritten(sym, src).collect()}
    assert got == {p: (k, rule[k]) for k, v in bad.items() for p in v}
    assert {(r.rule, r.files, r.alone) for r in H.rules(sym, src).collect()} == {("mangled", 1, 1), ("template", 2, 2), ("style", 3, 3)}


def test_marks_and_licences_anywhere(spark):
    files, _, _ = corpus()
    rnd = random.Random(5)
    late = {
        "/srv/trees/alpha/src/a/late.js": code(rnd, "alpha", 5) + "// We keep the orders here for a while.\n" * 90 + "// Code generated by tool. DO NOT EDIT.\n",
        "/srv/trees/beta/src/a/copy.js": code(rnd, "beta", 5) + "// We keep the orders here for a while.\n" * 90 + "/* (c) the fastlib contributors, released under the terms in LICENSE-FASTLIB */\n",
        "/srv/trees/gamma/src/a/tool.js": code(rnd, "gamma", 5) + "const head = '// Code generated by tool. DO NOT EDIT.';\n",
    }
    every = files | late
    assert min(len(c) for c in late.values()) > 500 and len(late["/srv/trees/alpha/src/a/late.js"]) > 3000
    src = spark.createDataFrame([(p, p.split("/")[3], None, c, 1, datetime(2025, 1, 1), 0.0) for p, c in every.items()], SRC)
    sym = spark.createDataFrame([(p, "n", "file", p, "r", "o") for p in every], SYM)
    assert {r.file_path: (r.reason, r.rule) for r in H.not_handwritten(sym, src).collect()} == {"/srv/trees/alpha/src/a/late.js": ("generated", "mark"), "/srv/trees/beta/src/a/copy.js": ("vendored", "style")}


def test_style_bits_against_brute_force(spark, rows):
    called = [("a", "alpha", 20), ("a", "alphabet", 3), ("a", "zed", 1), ("b", "zed", 9)]
    got = {(r.repo, r.name): r.bits for r in H.style_bits(spark.createDataFrame(called, "repo string, name string, n long")).collect()}
    for repo, name, _ in called:
        grams = lambda w: [("^^" + w + "^")[i : i + 3] for i in range(len(w) + 1)]
        of = [(g, n) for r, w, n in called if r == repo for g in grams(w)]
        n3, n2 = (lambda g: sum(n for x, n in of if x == g)), (lambda h: sum(n for x, n in of if x[:2] == h))
        want = np.mean([-np.log2((n3(g) + 0.1) / (n2(g[:2]) + 3)) for g in grams(name)])
        assert abs(got[repo, name] - want) < 1e-9


def test_empty(spark):
    assert H.not_handwritten(spark.createDataFrame([], SYM), spark.createDataFrame([], SRC)).count() == 0
    assert H.rules(spark.createDataFrame([], SYM), spark.createDataFrame([], SRC)).count() == 0
