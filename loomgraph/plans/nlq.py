"""Keyword and natural-language front end: ordered patterns to DataFrame builders.

The first pattern that matches decides; a pattern with a parameter that cannot be read is passed over.
What no pattern takes goes to a keyword search. Parameters are compared as values, never spliced into
query text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.graph import PropertyGraph
from loomgraph.operators.pattern import expand1


@dataclass(frozen=True)
class Template:
    pattern: str
    description: str
    words: tuple[str, ...] = ()
    types: tuple[str, ...] = ()
    ranks: tuple[tuple[tuple[str, str], ...], ...] = ()  # each a conjunction of (column, value)
    limit: int = 20
    extract: str = ""
    edges: tuple[str, ...] = ()


_CODE = ("class", "method", "function")
# Patterns, search words, filters, rankings and limits of the front end, in order.
TEMPLATES = [
    Template(r"how.*(email|mail).*(sent|send)", "mail sending", ("email", "mail", "smtp", "send"), _CODE, ((("name", "send"),), (("name", "email"),))),
    Template(r"(where|how).*(auth|login|authentication)", "authentication", ("auth", "login", "authenticate", "session"), _CODE, ((("type", "class"),), (("name", "auth"),))),
    Template(r"(what|where|how).*(validat|sanitiz).*(user|input|data)", "input validation", ("validat", "sanitiz", "filter", "check"), _CODE, ((("name", "validat"),),)),
    Template(r"(how|where).*(database|query|sql|repository)", "data access", ("query", "repository", "database", "entity", "orm"), ("class", "method"), ((("type", "class"),), (("name", "repository"),))),
    Template(r"(what|where|list).*(api|endpoint|route|controller)", "interfaces", ("controller", "action", "api", "endpoint"), ("class", "method"), ((("type", "class"), ("name", "controller")),)),
    Template(r"(how|where).*(error|exception).*(handled|caught|thrown)", "error handling", ("error", "exception", "catch", "throw"), (), ((("name", "exception"),),)),
    Template(r"(what|which).*(class|classes).*(extend|inherit|implement).*(\w+)", "class hierarchy", limit=20, extract=r"(extend|inherit|implement)\s+(\w+)", edges=("EXTENDS", "IMPLEMENTS")),
    Template(r"(what|which|who).*(call|invoke|use).*(\w+)", "callers", limit=20, extract=r"(call|invoke|use)\s+(\w+)", edges=("CALLS",)),
    Template(r"(where|which file).*(class|function|method).*(\w+)", "definition", limit=10, extract=r"(class|function|method)\s+(\w+)"),
]
# Words that stand for each other in a question.
SYNONYMS = {
    "email": ["email", "mail", "smtp", "mailer", "message"],
    "auth": ["auth", "login", "authenticate", "session", "token", "credential"],
    "database": ["database", "db", "query", "sql", "repository", "entity", "orm"],
    "user": ["user", "account", "profile", "member"],
    "api": ["api", "endpoint", "route", "controller", "action", "rest"],
    "error": ["error", "exception", "throw", "catch", "handle", "fail"],
    "validate": ["validate", "validation", "sanitize", "filter", "check", "verify"],
}
# The sample questions.
QUESTIONS = [
    "How is email sent?", "Where is user authentication handled?", "What validates user input?", "How are database queries executed?", "What are the API endpoints?",
    "How are errors handled?", "Which classes extend BaseEntity?", "What calls the save method?", "Where is the User class defined?", "Show me the authentication controllers",
]


def keywords(text: str) -> list[str]:
    """Words of a question with their synonyms, sorted, at most five."""
    low, found = text.lower(), set()
    for group in SYNONYMS.values():
        if any(w in low for w in group):
            found |= set(group)
    found |= {w for w in re.findall(r"\b[a-zA-Z_][a-zA-Z0-9_]*\b", low) if len(w) > 2}
    return sorted(found)[:5]


def route(text: str) -> tuple[Template | None, str | None]:
    """The template that takes a question, and its parameter."""
    low = text.lower().strip()
    for t in TEMPLATES:
        if re.search(t.pattern, low):
            if not t.extract:
                return t, None
            m = re.search(t.extract, low)
            if m:
                return t, m.group(2)
    return None, None


def _any(name: Column, words: list[str] | tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [name.contains(w) for w in words])


def ask(g: PropertyGraph, text: str) -> DataFrame:
    """Answer as (id, name, type, file_path, detail), ordered; every order ends in the id."""
    t, target = route(text)
    low = F.lower("name")
    cols = ["id", "name", "type", "file_path"]
    if t is not None and t.edges:
        r = expand1(g, *t.edges, dst=F.lower("t_name").contains(target))
        r = r.select(F.col("s_id").alias("id"), F.col("s_name").alias("name"), F.col("s_type").alias("type"), F.col("s_file").alias("file_path"), F.concat_ws(" ", "r_type", "t_name").alias("detail"))
        return r.distinct().orderBy("name", "id", "detail").limit(t.limit)
    if t is not None and target is not None:
        n = g.nodes.where(low.contains(target)).withColumn("rank", F.when(low == target, 0).otherwise(1))
        return n.orderBy("rank", "name", "id").limit(t.limit).select(*cols, F.lit("definition").alias("detail"))
    words = list(t.words) if t else keywords(text)
    n = g.nodes.where(_any(low, words)) if words else g.nodes.where("false")
    if t and t.types:
        n = n.where(F.col("type").isin(list(t.types)))
    if t is None:
        return n.orderBy("type", "name", "id").limit(30).select(*cols, F.lit("keyword search").alias("detail"))
    test = lambda c, v: (F.col("type") == v) if c == "type" else low.contains(v)
    ranks = [F.when(reduce(lambda a, b: a & b, [test(c, v) for c, v in rank]), 0).otherwise(1) for rank in t.ranks]
    return n.orderBy(*ranks, "name", "file_path", "id").limit(t.limit).select(*cols, F.lit(t.description).alias("detail"))
