"""Basic graph patterns as joins over the triples table."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsgraph.operators.rdf import RDF_TYPE


class Literal(NamedTuple):
    """A constant literal as the object of a pattern; plain text constants are IRIs."""

    value: str
    datatype: str | None = None


Pattern = tuple[str, str, str | Literal]


def _is_var(term: str | Literal) -> bool:
    return isinstance(term, str) and term.startswith("?")


def _kind(variable: str) -> str:
    return f"_kind_{variable}"


def _pattern_rows(triples: DataFrame, pattern: Pattern, node_vars: set[str]) -> DataFrame:
    """Triples that match one pattern, with two columns per variable: its text, and the kind of node or literal."""
    subject, predicate, target = pattern
    if _is_var(predicate):
        raise ValueError(f"the predicate {predicate} is a variable; predicates must be constants")
    if _is_var(subject) and subject == target:
        raise ValueError(f"{subject} stands twice in one pattern")
    rows = triples.where(F.col("p") == predicate)
    columns = []
    if _is_var(subject):
        kind = F.when(F.col("s").startswith("_:"), "bnode").otherwise("iri")
        columns += [F.col("s").alias(subject[1:]), kind.alias(_kind(subject[1:]))]
    else:
        rows = rows.where(F.col("s") == subject)
    if _is_var(target):
        literal = F.concat(F.lit("literal "), F.coalesce("o_datatype", F.lit("")))
        kind = F.when(F.col("o_kind") == "literal", literal).otherwise(F.col("o_kind"))
        columns += [F.col("o").alias(target[1:]), kind.alias(_kind(target[1:]))]
        if target in node_vars:
            rows = rows.where(F.col("o_kind") != "literal")
    elif isinstance(target, Literal):
        same_type = F.col("o_datatype").eqNullSafe(F.lit(target.datatype))
        rows = rows.where((F.col("o_kind") == "literal") & (F.col("o") == target.value) & same_type)
    else:
        rows = rows.where((F.col("o_kind") == "iri") & (F.col("o") == target))
    return rows.select(*columns)


def match_pattern(triples: DataFrame, patterns: list[Pattern], select: list[str]) -> DataFrame:
    """Solutions of a list of (subject, predicate, object) patterns; variables start with '?'.

    Predicates are constants, so every pattern is a filtered scan of the triples. Link patterns are equi-joined on
    the variables they share, in the order that keeps them connected; a type check on a bound variable only filters
    and becomes a semi-join, so it never multiplies rows. Values meet only when their kind is equal too: an IRI is
    not a literal of the same text. Refused with a ValueError: unconnected patterns (they would be crossed), a
    variable as predicate, and a variable that stands twice in one pattern.
    """
    node_vars = {s for s, _, _ in patterns if _is_var(s)}
    checks = [p for p in patterns if p[1] == RDF_TYPE and _is_var(p[0]) and not _is_var(p[2])]
    links = [p for p in patterns if p not in checks]
    if not links:
        links, checks = checks[:1], checks[1:]

    result = _pattern_rows(triples, links[0], node_vars)
    waiting = links[1:]
    while waiting:
        joined = next((p for p in waiting if {t[1:] for t in (p[0], p[2]) if _is_var(t)} & set(result.columns)), None)
        if joined is None:
            raise ValueError("patterns are not connected by shared variables")
        rows = _pattern_rows(triples, joined, node_vars)
        shared = [c for c in rows.columns if c in result.columns]
        result = result.join(rows, shared, "inner" if len(shared) < len(rows.columns) else "left_semi")
        waiting.remove(joined)
    for check in checks:
        variable = check[0][1:]
        if variable not in result.columns:
            raise ValueError(f"{check[0]} is not bound by a link pattern")
        result = result.join(_pattern_rows(triples, check, node_vars), [variable, _kind(variable)], "left_semi")
    return result.select(*[v.lstrip("?") for v in select])
