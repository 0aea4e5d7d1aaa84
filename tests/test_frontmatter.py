"""Frontmatter as values."""

import json

import pytest

from loam.functions import frontmatter

CASES = [
    ("title: A\nsources:\n- a.py:L1-L2\n- \"b: c\"\nmeta:\n  owner: team\n  rank: 5", {"title": "A", "sources": ["a.py:L1-L2", "b: c"], "meta": {"owner": "team", "rank": 5}}),
    ("'quoted key': 'it''s'\n\"two\": \"a\\nb\"\nurl: http://x/y#z", {"quoted key": "it's", "two": "a\nb", "url": "http://x/y#z"}),
    ("tags: [a, 'b, c', 3, true, [x]]\nmap: {k: v, n: {m: 1.5}}\nempty: []\nnone:\nnil: ~", {"tags": ["a", "b, c", 3, True, ["x"]], "map": {"k": "v", "n": {"m": 1.5}}, "empty": [], "none": None, "nil": None}),
    ("list:\n  - name: a\n    n: 1\n  - name: b\n  -\n    - deep\n", {"list": [{"name": "a", "n": 1}, {"name": "b"}, ["deep"]]}),
    ("# note\na: 1 # one\n\nb: x#y\ntext: |\n  two\n  lines\nfold: >-\n  one\n  line", {"a": 1, "b": "x#y", "text": "two\nlines\n", "fold": "one line"}),
    ("a: 1\na: 2", {"a": 2}),
    ("a:\r\n- b\r\n- c: d\r\n", {"a": ["b", {"c": "d"}]}),
    ("date: 2026-01-02\nver: 1.2.3\nno: 'no'\nneg: -4", {"date": "2026-01-02", "ver": "1.2.3", "no": "no", "neg": -4}),
]
BAD = ["- a\n- b", "just text", "a: b: c", "a: [1, 2", "a: 'open", "\ta: 1", "a: 1\n   b: 2", "a: &x 1", "", "k: " + "[" * 200]


@pytest.mark.parametrize("text,value", CASES)
def test_values(text, value):
    assert frontmatter.parse(text) == value


@pytest.mark.parametrize("text", BAD)
def test_malformed_is_empty(text):
    assert frontmatter.parse(text) == {}


def test_as_variant(spark):
    pages = [(f"---\n{t}\n---\nbody --- more\n",) for t, _ in CASES] + [("---\r\na: 1\r\n---\r\n",), ("---\n---\nbody",), ("no head",), (None,), (f"---\n{BAD[0]}\n---\n",)]
    got = [json.loads(r[0]) for r in spark.createDataFrame(pages, "text string").coalesce(1).select(frontmatter.frontmatter_value("text").cast("string")).collect()]
    assert got == [v for _, v in CASES] + [{"a": 1}, {}, {}, {}, {}]
