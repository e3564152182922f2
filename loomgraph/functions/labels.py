"""Label projections: seven ways in which node labels are derived from type and id."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Label names.
CODE_LABELS = {"class": "Class", "interface": "Interface", "trait": "Trait", "function": "Function", "method": "Method", "property": "Property", "constant": "Constant", "namespace": "Namespace", "file": "File", "directory": "Directory", "variable": "Variable", "import": "Import"}
CSV_GROUPS = {"class": "PHPClass", "interface": "PHPInterface", "trait": "PHPTrait", "method": "PHPMethod", "property": "PHPProperty", "function": "PHPFunction", "constant": "PHPConstant", "namespace": "PHPNamespace", "file": "File", "directory": "Directory"}


def _map(values: dict[str, str], key: Column) -> Column:
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.lit(v))])[key]


def labels(rule: str = "typed", type_: str = "type", id_: str = "id") -> Column:
    """Array of labels. Rules: ``symbol`` (Symbol plus a title), ``typed`` (Symbol plus the type as
    it is, the default), ``csv`` (fixed groups, null when not exported), ``single`` (one label, PHP by
    default), ``prefix`` (by id prefix), ``plain`` (one label, Symbol by default), ``mixed`` (type, then
    id prefix)."""
    t, i = F.col(type_), F.col(id_)
    title = F.concat(F.upper(F.substring(t, 1, 1)), F.expr(f"substring({type_}, 2)"))
    if rule == "symbol":
        js = F.array(F.lit("JavaScript"), F.initcap(F.expr(f"substring({type_}, 4)")))
        return F.when(t.startswith("js_"), js).otherwise(F.array_compact(F.array(F.lit("Symbol"), _map(CODE_LABELS, t))))
    if rule == "typed":
        return F.when(t == "file", F.array(F.lit("File"))).when(t == "directory", F.array(F.lit("Directory"))).when(F.coalesce(t, F.lit("")) == "", F.array(F.lit("Symbol"))).otherwise(F.array(F.lit("Symbol"), t))
    if rule == "csv":
        g = _map(CSV_GROUPS, t)
        return F.when(g.isNotNull(), F.array(F.lit("Symbol"), g))
    if rule == "single":
        return F.array(F.coalesce(_map(CSV_GROUPS, t), F.when(i.startswith("js_"), "JSSymbol"), F.lit("PHPSymbol")))
    if rule == "prefix":
        return F.array(F.when(i.startswith("dir_"), "Directory").when(i.startswith("file_"), "File").when(i.startswith("js_"), "JSSymbol").otherwise(F.concat(F.lit("PHP"), title)))
    if rule == "plain":
        return F.array(F.coalesce(_map(CODE_LABELS, t), F.lit("Symbol")))
    if rule == "mixed":
        return F.array(F.coalesce(_map(CSV_GROUPS, t), F.when(i.startswith("js_"), "JSSymbol").otherwise("PHPSymbol")))
    raise ValueError(rule)


def label(type_: str = "type") -> Column:
    """Primary label of the default rule."""
    t = F.col(type_)
    return F.when(t == "file", "File").when(t == "directory", "Directory").when(F.coalesce(t, F.lit("")) == "", "Symbol").otherwise(t)
