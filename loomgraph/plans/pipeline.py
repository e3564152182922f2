"""From a source tree to a graph: language modules, plugins, resolution, export.

A language module turns a DataFrame of files into extracted rows; a plugin has hooks that take and
return the pipeline's ``State``. Both are plain Python objects that build DataFrame plans, so a project
is one job up to the barrier "all symbols before any resolution".
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import paths
from loomgraph.functions.labels import label
from loomgraph.operators import resolve
from loomgraph.operators.graph import EDGE_COLUMNS, PropertyGraph
from loomgraph.sources import extract, files, sinks


class LanguageModule(Protocol):
    def collect(self, files: DataFrame) -> DataFrame: ...


@dataclass(frozen=True)
class Language:
    """A language read by the built-in extractors."""

    name: str
    extensions: tuple[str, ...]

    def collect(self, source: DataFrame) -> DataFrame:
        found = source.where(paths.discovered(F.col("file_path"), self.name))
        return extract.extract(found, *self.extensions)


# Language names of a configuration.
LANGUAGES = {
    "php": Language("php", ("php",)), "javascript": Language("js", ("js", "jsx", "mjs", "cjs")), "python": Language("py", ("py",)), "typescript": Language("ts", ("ts", "tsx")),
}


@dataclass(frozen=True)
class State:
    files: DataFrame
    symbols: DataFrame | None = None
    references: DataFrame | None = None
    graph: PropertyGraph | None = None


@dataclass
class Plugin:
    """Hooks of a plugin; each may be left out."""

    name: str
    before_collect: Callable[[State], State] | None = None
    after_collect: Callable[[State], State] | None = None
    after_resolve: Callable[[State], State] | None = None


@dataclass
class Registry:
    """Plugins by name; an unknown name is remembered and passed over."""

    known: dict[str, Callable[[], Plugin]] = field(default_factory=dict)
    unknown: list[str] = field(default_factory=list)

    def register(self, name: str, factory: Callable[[], Plugin]) -> None:
        self.known[name] = factory

    def load(self, names: list[str]) -> list[Plugin]:
        out = []
        for n in names:
            if n in self.known:
                out.append(self.known[n]())
            else:
                self.unknown.append(n)
        return out


def _hook(plugins: list[Plugin], name: str, state: State) -> State:
    for p in plugins:
        f = getattr(p, name)
        state = f(state) if f else state
    return state


def build(state: State, languages: list[str], plugins: list[Plugin]) -> State:
    """Collect, resolve and assemble the graph of ``state.files`` (file_path, content)."""
    state = _hook(plugins, "before_collect", state)
    rows = [LANGUAGES[n].collect(state.files) for n in languages if n in LANGUAGES]
    every = rows[0]
    for r in rows[1:]:
        every = every.unionByName(r)
    state = replace(state, symbols=extract.symbols_of(every), references=extract.references_of(every))
    state = _hook(plugins, "after_collect", state)

    # Python files get rows too, so that their symbols hang in the tree
    tree = files.structure(state.files, extensions=[*paths.INDEXABLE, "py"])
    own = state.symbols.select("id", "name", "type", "file_path", F.coalesce("parent_id", F.concat(F.lit("file_"), F.md5(paths.norm("file_path")))).alias("parent_id"))
    space = state.symbols.where("type = 'namespace'").groupBy("file_path").agg(F.min("name").alias("namespace"))
    imports = state.symbols.where("type = 'import'").groupBy("file_path").agg(F.collect_set("name").alias("imports"))
    refs = state.references.withColumn("ref_id", F.md5(F.concat_ws(":", "file_path", "reference_type", "target", "line_number", "column_number"))).dropDuplicates(["ref_id"])
    named = refs.withColumn("name", F.substring_index("target", "::", 1)).join(space, "file_path", "left").join(imports, "file_path", "left")
    internal = resolve.resolve(named.select("ref_id", "name", "namespace", "imports"), own)
    outside = resolve.externals(named.select("ref_id", "name"), internal)
    nodes = own.unionByName(tree).unionByName(outside.withColumn("parent_id", F.lit(None).cast("string"))).withColumn("label", label())
    targets = internal.select("ref_id", "target_id").unionByName(
        named.select("ref_id", "name").join(internal.select("ref_id"), "ref_id", "left_anti").select("ref_id", F.concat(F.lit("external_"), F.md5(F.ltrim("name", F.lit("\\")))).alias("target_id"))
    )
    edges = refs.join(targets, "ref_id").select(
        F.xxhash64("ref_id").alias("eid"), F.coalesce("source_id", F.concat(F.lit("file_"), F.md5(paths.norm("file_path")))).alias("src"), F.col("target_id").alias("dst"), F.col("reference_type").alias("type"), "line_number", "column_number"
    )
    state = replace(state, graph=PropertyGraph(nodes, edges.select(*EDGE_COLUMNS)))
    return _hook(plugins, "after_resolve", state)


def run(spark: SparkSession, config: dict, registry: Registry | None = None, out: str | None = None) -> State:
    """Index the project of a configuration; with ``out`` write the graph, the script and the CSV."""
    source = files.read_tree(spark, config["project"]["root"])
    source = source.where(paths.extension(F.col("file_path")).isin(sorted({e for x in paths.EXTENSIONS.values() for e in x})))
    state = build(State(source), config["project"]["languages"], (registry or Registry()).load(config["plugins"]))
    if out:
        state.graph.write(f"{out}/graph")
        stored = spark.read.parquet(f"{out}/graph/nodes"), spark.read.parquet(f"{out}/graph/edges")
        full = stored[0].select("*", *[F.lit(None).cast("string").alias(c) for c in ("namespace", "visibility")], F.lit(None).cast("int").alias("line_number"))
        sinks.write_script(full, stored[1], f"{out}/script")
        sinks.write_csv(full, stored[1], f"{out}/csv")
    return state
