"""Paths as columns: prefixes, parents, names, extensions, discovery predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions and directories of source discovery.
INDEXABLE = ["php", "js", "jsx", "ts", "tsx", "json", "yml", "yaml", "xml", "html", "css", "scss"]
SKIPPED = {"php": [], "js": ["node_modules", "vendor"], "py": ["__pycache__", "venv", "env", ".venv", "node_modules", "vendor"], "ts": ["node_modules", ".next", "dist", "build", "out"]}
EXTENSIONS = {"php": ["php"], "js": ["js", "jsx", "mjs", "ts", "tsx"], "py": ["py"], "ts": ["ts", "tsx"]}


def norm(path: str | Column) -> Column:
    """Forward slashes."""
    return F.replace(F.col(path) if isinstance(path, str) else path, F.lit("\\"), F.lit("/"))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent(path: Column) -> Column:
    """Directory of a path; null at the top."""
    cut = F.length(path) - F.length(basename(path)) - 1
    return F.when(cut > 0, F.substring(path, F.lit(1), cut))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(basename(path), r"\.([^.]+)$", 1))


def prefixes(path: Column) -> Column:
    """All directories above a path, outermost first."""
    return F.filter(
        F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(F.split(path, "/")) - 1)), lambda i: F.array_join(F.slice(F.split(path, "/"), F.lit(1), i), "/")), lambda p: p != ""
    )


def pruned(path: Column) -> Column:
    """Does the path lie in a hidden, vendor or node_modules directory?"""
    return path.rlike(r"/(\.[^/]*|vendor|node_modules)/")


def discovered(path: Column, language: str) -> Column:
    """Is the file found by the discovery of a language?"""
    skip = SKIPPED[language]
    inside = path.rlike("/(" + "|".join(d.replace(".", r"\.") for d in skip) + ")/") if skip else F.lit(False)
    hidden = path.rlike(r"/\.[^/]+/") if language == "ts" else F.lit(False)
    return extension(path).isin(EXTENSIONS[language]) & ~inside & ~hidden
