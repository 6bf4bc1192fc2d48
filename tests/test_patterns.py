import itertools
import random

import pytest

from newsgraph.operators.patterns import Literal, match_pattern
from newsgraph.operators.rdf import RDF_TYPE
from newsgraph.schema import TRIPLE_SCHEMA
from newsgraph.sources.readers import bindings_to_table
from tests.helpers import rows


def solve(triples, patterns, select):
    """Brute force: every combination of triples."""
    found = set()
    for combo in itertools.product(triples, repeat=len(patterns)):
        env, ok = {}, True
        for (s, p, o, kind, _), pattern in zip(combo, patterns):
            if p != pattern[1]:
                ok = False
                break
            for term, value in ((pattern[0], s), (pattern[2], o)):
                if term.startswith("?"):
                    ok = ok and env.setdefault(term, value) == value
                else:
                    ok = ok and term == value
            if not ok:
                break
        if ok:
            found.add(tuple(env[v] for v in select))
    return found


@pytest.fixture(scope="module")
def data():
    rng = random.Random(3)
    triples = set()
    for i in range(5):
        triples.add((f"u{i}", "domain", f"d{rng.randint(0, 1)}", "iri", None))
        triples.add((f"u{i}", "label", f"l{rng.randint(0, 2)}", "iri", None))
        if i != 2:
            triples.add((f"u{i}", RDF_TYPE, "Url", "iri", None))
    triples.add(("u0", "label", "l9", "iri", None))  # a second label, and one without type
    triples |= {(f"l{i}", RDF_TYPE, "Label", "iri", None) for i in range(3)}
    triples.add(("d0", RDF_TYPE, "Domain", "iri", None))
    return sorted(triples)


PATTERNS = [
    ("?d", RDF_TYPE, "Domain"),
    ("?u", RDF_TYPE, "Url"),
    ("?u", "domain", "?d"),
    ("?u", "label", "?l"),
    ("?l", RDF_TYPE, "Label"),
]


@pytest.mark.parametrize("n", [3, 4])
def test_patterns_agree_with_brute_force(spark, data, n):
    patterns = PATTERNS[5 - n :]
    select = sorted({t for p in patterns for t in (p[0], p[2]) if t.startswith("?")})
    found = match_pattern(spark.createDataFrame(data, TRIPLE_SCHEMA), patterns, select)
    assert set(rows(found)) == solve(data, patterns, select)
    assert found.count() == len(solve(data, patterns, select))


def test_all_patterns_and_single_type(spark, data):
    df = spark.createDataFrame(data, TRIPLE_SCHEMA)
    expected = {
        (u, d, lab)
        for u, p, d, _, _ in data if p == "domain" and d == "d0" and u != "u2"
        for v, q, lab, _, _ in data if q == "label" and v == u and lab != "l9"
    }
    assert set(rows(match_pattern(df, PATTERNS, ["?u", "?d", "?l"]))) == expected
    assert match_pattern(df, [("?u", RDF_TYPE, "Url")], ["?u"]).count() == 4


def test_unconnected_patterns_are_refused(spark, data):
    df = spark.createDataFrame(data, TRIPLE_SCHEMA)
    with pytest.raises(ValueError):
        match_pattern(df, [("?a", "domain", "?b"), ("?c", "label", "?d")], ["?a"])
    with pytest.raises(ValueError):
        match_pattern(df, [("?a", "domain", "?b"), ("?c", RDF_TYPE, "Url")], ["?a"])


def test_saved_response_with_an_unbound_variable(spark):
    response = (
        '{"head":{"vars":["a","b"]},"results":{"bindings":['
        '{"a":{"type":"uri","value":"x#1"},"b":{"type":"literal","value":"2"}},{"a":{"type":"uri","value":"x#3"}}]}}'
    )
    df = spark.createDataFrame([(response,), ('{"results":{"bindings":[]}}',)], "response string")
    assert rows(bindings_to_table(df, "response", ["a", "b"])) == [("x#1", "2"), ("x#3", None)]


def test_literals_and_kinds_are_told_apart(spark):
    data = [
        ("u1", "label", "fake", "literal", None),
        ("u2", "label", "fake", "iri", None),
        ("u3", "label", "fake", "literal", "string"),
        ("u4", "label", "_:b1", "bnode", None),
        ("u1", "note", "fake", "literal", None),
        ("u2", "note", "fake", "literal", None),
        ("u4", "note", "_:b1", "bnode", None),
    ]
    df = spark.createDataFrame(data, TRIPLE_SCHEMA)
    assert rows(match_pattern(df, [("?u", "label", Literal("fake"))], ["?u"])) == [("u1",)]
    assert rows(match_pattern(df, [("?u", "label", Literal("fake", "string"))], ["?u"])) == [("u3",)]
    assert rows(match_pattern(df, [("?u", "label", "fake")], ["?u"])) == [("u2",)]
    same = match_pattern(df, [("?u", "label", "?x"), ("?u", "note", "?x")], ["?u", "?x"])
    assert rows(same) == [("u1", "fake"), ("u4", "_:b1")]


def test_patterns_that_have_no_answer_here_are_refused(spark, data):
    df = spark.createDataFrame(data, TRIPLE_SCHEMA)
    with pytest.raises(ValueError, match="predicate"):
        match_pattern(df, [("?u", "?p", "?x")], ["?u"])
    with pytest.raises(ValueError, match="twice"):
        match_pattern(df, [("?u", "label", "?u")], ["?u"])
