import json

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import paths
from loomgraph.operators import resolve as R
from loomgraph.plans import nlq, pipeline
from loomgraph.sources import extract as X
from loomgraph.sources import files, metadata, sinks
from loomgraph.streaming import ingest

PHP = r"""<?php
namespace App\Shop;
use Lib\Base;
use Lib\Log as Logger;
abstract class Cart extends Base implements Countable {
    use Cachable;
    const LIMIT = 5;
    private ?Item $first = null;
    public function __construct(private Repo $repo) {}
    public function add(Item $item, int $n): ?Total {
        if ($item instanceof Gift) { throw new BadGift('x { y'); }
        $this->check($n); // $this->never()
        $this->first = new Line($item);
        return Price::of(self::LIMIT) ?? strtolower('new Fake');
    }
}
function top() { return 1; }
"""
TSX = """'use client';
import React, { useState } from 'react';
import { Button as Btn } from './button';
interface Props extends Base { title: string }
type Kind = 'a' | 'b';
export function Card(props: Props) {
  const [open, setOpen] = useState(false);
  track('x');
  return (<Panel><Btn onClick={() => setOpen(!open)} /></Panel>);
}
"""


def pairs(rows, kind):
    return {(r[4], r[3] if kind == "symbol" else r[8]) for r in rows if r[1] == kind}


def test_php_reader():
    rows = X.php("/a/Cart.php", PHP)
    s, e = pairs(rows, "symbol"), pairs(rows, "reference")
    assert {("namespace", r"App\Shop"), ("class", r"App\Shop\Cart"), ("method", "add"), ("property", "first"), ("constant", "LIMIT"), ("function", r"App\Shop\top"), ("import", r"Lib\Base")} <= s
    kinds = {k for k, _ in e}
    assert {"EXTENDS", "IMPLEMENTS", "USES_TRAIT", "IMPORTS", "THROWS", "USES_CONSTANT", "CALLS", "CALLS_STATIC", "INSTANTIATES", "ACCESSES", "PARAMETER_TYPE", "RETURNS", "INSTANCEOF"} <= kinds
    assert ("INSTANTIATES", "Fake") not in e and ("CALLS", "this.never") not in e


def test_python_reader():
    rows = X.python("/a/m.py", "import os\nfrom a import b as c\n_x = 1\nY = 2\nclass A(B):\n    def f(self):\n        print(os.path.join('a'))\n        return g()\n")
    assert {("class", "A"), ("method", "f"), ("variable", "Y"), ("import", "os"), ("import", "a.b")} <= pairs(rows, "symbol")
    assert ("variable", "_x") not in pairs(rows, "symbol")
    assert {("EXTENDS", "B"), ("CALLS", "os.path.join"), ("CALLS", "g")} <= pairs(rows, "reference") and ("CALLS", "print") not in pairs(rows, "reference")
    with pytest.raises(SyntaxError):
        X.python("/a/m.py", "def (:")


def test_script_reader():
    rows = X.script("/a/Card.tsx", TSX)
    assert {("ReactComponent", "Card"), ("TSInterface", "Props"), ("TSType", "Kind"), ("import", "Btn")} <= pairs(rows, "symbol")
    assert {("RENDERS", "Panel"), ("RENDERS", "Btn"), ("USES", "useState"), ("HAS_STATE", "open"), ("CALLS", "track"), ("EXTENDS", "Base"), ("HAS_PROP", "Props"), ("EXPORTS", "Card")} <= pairs(rows, "reference")
    js = X.script("/a/v.js", "define(['x/y'], function (Y) {});\nconst View = Backbone.View.extend({ render() { return 1; } });\nAjax.getRequest('Account/1');\nfetch('/api/z');\nvar q = 1;")
    assert {("CALLS_API", "Account/1"), ("CALLS_API", "/api/z"), ("IMPORTS", "x/y"), ("EXTENDS", "View")} <= pairs(js, "reference") and ("variable", "q") in pairs(js, "symbol")
    assert X.route("/r/app/(shop)/cart/page.tsx") == ("/cart", False) and X.route("/r/pages/api/user/index.ts") == ("/user/index", True)
    assert X.route("/r/app/(x)/api/a/route.ts") == ("/a", True) and X.route("/r/src/a.ts") == (None, False)
    assert ("APIRoute", "GET") in pairs(X.script("/r/app/api/user/route.ts", "export async function GET(req: Request) { return 1; }"), "symbol")


def test_paths(spark):
    r = spark.createDataFrame([(r"\srv\a\b.py",), ("x.php",)], "p string").select(*[f(paths.norm("p")).alias(n) for n, f in (("b", paths.basename), ("u", paths.parent), ("e", paths.extension), ("pre", paths.prefixes))]).collect()
    assert [tuple(x) for x in r] == [("b.py", "/srv/a", "py", ["/srv", "/srv/a"]), ("x.php", None, "php", ["x.php"])] or r[1].u is None


def test_script_round_trip(spark, tmp_path, rows):
    edges = spark.createDataFrame([("a'b", "c\\d", "CALLS"), ("x", "y", "USES")], "src string, dst string, type string")
    sinks.script_edges(edges).write.text(f"{tmp_path}/s")
    assert rows(sinks.read_relationships(spark, f"{tmp_path}/s")) == rows(edges)


def test_metadata(spark, rows):
    doc = json.dumps({"onLoginHookClassNameList": ["__APPEND__", "App\\Hook\\A"], "x": {"y": ["App\\B", "plain", 3]}})
    d = spark.createDataFrame([("f", doc), ("g", "{bad"), ("h", None)], "config_file string, json string")
    assert rows(metadata.hooks(d)) == [("f", "onLoginHookClassNameList", "App\\Hook\\A")]
    assert rows(metadata.class_references(d)) == [("f", "onLoginHookClassNameList::1", "App\\Hook\\A"), ("f", "x::y::0", "App\\B")]


def test_resolution_priorities(spark):
    nodes = spark.createDataFrame([("1", "A\\C", "class"), ("2", "B\\C", "class"), ("3", "C", "class"), ("4", "X\\Only", "interface"), ("5", "X\\m", "method")], "id string, name string, type string")
    refs = spark.createDataFrame(
        [("abs", "\\A\\C", None, None), ("imp", "C", "Z", ["B\\C"]), ("ns", "C", "A", None), ("glob", "C", "Z", None), ("suf", "only", None, None), ("none", "m", None, None), ("path", "/a/b.php", None, None), ("nul", None, None, None)],
        "ref_id string, name string, namespace string, imports array<string>",
    )
    got = {r.ref_id: (r.target_id, r.prio) for r in R.resolve(refs, nodes).collect()}
    assert got == {"abs": ("1", 1), "imp": ("2", 2), "ns": ("1", 3), "glob": ("3", 4), "suf": ("4", 5)}
    deep = spark.createDataFrame([("fb", "Only", None, None)], "ref_id string, name string, namespace string, imports array<string>")
    assert [tuple(r) for r in R.resolve(deep, nodes, ["Q", "X"]).collect()] == [("fb", "4", 6)]
    ext = {r.name: r.type for r in R.externals(refs.select("ref_id", "name"), R.resolve(refs, nodes)).collect()}
    assert ext == {"m": "class", "/a/b.php": "class"}


def test_question_routing():
    order = [nlq.TEMPLATES.index(t) + 1 if t else None for t in (nlq.route(q)[0] for q in nlq.QUESTIONS)]
    assert order == [1, 2, 3, 4, 5, 6, 7, None, 9, 2]
    assert nlq.route(nlq.QUESTIONS[6])[1] == "baseentity" and nlq.route(nlq.QUESTIONS[8])[1] == "defined"
    assert nlq.keywords("What calls the save method?") == sorted(nlq.keywords("What calls the save method?"))[:5]


def test_project_pipeline(spark, tmp_path):
    src = tmp_path / "proj" / "src"
    (src / "node_modules").mkdir(parents=True)
    (src / "Cart.php").write_text(PHP)
    (src / "m.py").write_text("class A:\n    pass\n\n\nclass B(A):\n    pass\n")
    (src / "node_modules" / "x.js").write_text("function no() {}")
    (tmp_path / "c.json").write_text(json.dumps({"project": {"name": "p", "root": "proj", "languages": ["php", "python", "javascript"]}, "plugins": ["known", "nope"]}))
    seen = []
    reg = pipeline.Registry()
    hook = lambda n: lambda s: seen.append(n) or s
    reg.register("known", lambda: pipeline.Plugin("known", hook("before"), hook("after"), hook("resolved")))
    state = pipeline.run(spark, files.read_config(str(tmp_path / "c.json")), reg, str(tmp_path / "out"))
    assert seen == ["before", "after", "resolved"] and reg.unknown == ["nope"]
    names = {r.name for r in state.graph.nodes.collect()}
    assert {"A", "B", "m.py", "src", r"App\Shop\Cart"} <= names and "no" not in names
    g = state.graph
    ids = {r.name: r.id for r in g.nodes.where("type = 'class'").collect()}
    assert g.edges.where((F.col("type") == "EXTENDS") & (F.col("src") == ids["B"]) & (F.col("dst") == ids["A"])).count() == 1
    assert spark.read.parquet(f"{tmp_path}/out/graph/edges").count() == g.edges.count()
    assert spark.read.option("header", True).csv(f"{tmp_path}/out/csv/edges").count() == g.edges.count()


def test_stream_ingests_changed_files_only(spark, tmp_path):
    schema = "file_path string, content string, fetched_at timestamp_ntz"
    put = lambda n, r: spark.createDataFrame(r, "file_path string, content string").selectExpr("*", "timestamp_ntz'2025-01-01' as fetched_at").coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    run = lambda: ingest.start(spark, f"{tmp_path}/in/*", schema, f"{tmp_path}/t", f"{tmp_path}/c").awaitTermination()
    put("1", [("/a.py", "class A: pass"), ("/b.py", "class B: pass"), ("/n.py", None)])
    run()
    put("2", [("/a.py", "class A2: pass"), ("/b.py", "class B: pass")])
    run()
    got = {(r.file_path, r.name, r.batch) for r in ingest.latest_rows(spark, f"{tmp_path}/t").collect()}
    assert got == {("/a.py", "A2", 1), ("/b.py", "B", 0)}


def test_metadata_documents_of_a_tree(spark, tmp_path, rows):
    at = tmp_path / "app" / "Resources" / "metadata" / "hooks"
    at.mkdir(parents=True)
    (at / "a.json").write_text('{"onLoginHookClassNameList": ["__APPEND__", "App\\\\Hook\\\\A"], "x": "App\\\\B"}')
    (tmp_path / "app" / "other.json").write_text('{"onLoginHookClassNameList": ["App\\\\Hook\\\\Z"]}')
    docs = metadata.read_metadata(spark, str(tmp_path))
    assert [x[0].endswith("/Resources/metadata/hooks/a.json") for x in rows(docs, "config_file")] == [True]
    assert rows(metadata.hooks(docs), "config_key", "class_name") == [("onLoginHookClassNameList", "App\\Hook\\A")]


def test_a_file_that_cannot_be_read_gives_one_error_row(spark, rows):
    from loomgraph.sources import extract

    body = " + ".join(f"part{i}(x)" for i in range(90))
    df = spark.createDataFrame([("/a.py", "x = (", 1), ("/b.py", "def f(): pass", 1), ("/c.js", f"const g = (x) =>\n  {body} + last(x);\nother(y);", 1)], "file_path string, content string, type int")
    got = extract.extract(df)
    assert rows(extract.errors_of(got), "file_path", "error", "line_number") == [("/a.py", "SyntaxError", 1)]
    assert [r.file_path for r in extract.symbols_of(got).collect()].count("/a.py") == 0 and len(body) > 900
    calls = {r.target for r in extract.references_of(got).where("file_path = '/c.js' and reference_type = 'CALLS'").collect()}
    assert "last" in calls and "other" not in calls
