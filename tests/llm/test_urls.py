import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from threatspark.llm.urls import GlobAutomaton, judge_urls

globs = st.lists(st.text("ab*?c", max_size=80), min_size=1, max_size=9)


def fits(pattern, text):
    return re.fullmatch("".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern), text, re.S) is not None


@settings(max_examples=200, deadline=None)
@given(globs, st.lists(st.text("abc", max_size=50), max_size=40))
def test_globs(patterns, texts):
    got = GlobAutomaton(patterns).matches([t.encode() for t in texts])
    assert got.tolist() == [[fits(p, t) for p in patterns] for t in texts]


def test_rules(spark):
    cases = [
        ("http://example.org/en/1x", "example.org/en/1", "block"), ("https://a.b.EXAMPLE.org/es/?q", "example.org/es/", "block"),
        ("http://example.org/en/2", "org/", "allow"), ("http://notexample.org/es/", "org/", "allow"), ("http://x.com/fr/", "com/fr/", "allow"),
        ("http://x.com/de/", "com/de/", "block"), ("http://x.com/DE/", None, "allow"), ("http://x.com", None, "allow"),
        ("http://x.org", None, "allow"), ("http://x.net/.org/", None, "allow"), ("http://cheap-pills.net/a", None, "block"),
        ("http://ok.net/cheap-pills", None, "allow"), (None, None, "allow"), ("", None, "allow"), ("no scheme/org/", None, "allow"),
        ("://org/", "org/", "allow"), ("http://x.org/a" + "b" * 50_000, "org/", "allow"), ("http://x.com#/fr/", None, "allow"),
    ]
    pages = spark.createDataFrame([(k, c[0], "own") for k, c in enumerate(cases)] * 2, "page_id long, url string, host string")
    got = judge_urls(pages)
    assert got.columns == ["page_id", "url", "host", "judged"]
    rows = got.select("page_id", "judged.v.rule", "judged.v.verdict").collect()
    assert len(rows) == 2 * len(cases)
    assert all((r.rule, r.verdict) == cases[r.page_id][1:] for r in rows)
    assert judge_urls(pages.where(F.lit(False))).count() == 0


def test_many_long_urls_move_side_by_side():
    automaton = GlobAutomaton(["*.org#/x*y", "a*"])
    texts = [b"." + b"h" * k + b".org#/x" + b"z" * (k * 3) + b"y" for k in range(40)] + [b""]
    assert automaton.matches(texts).tolist() == [[fits("*.org#/x*y", t.decode()), False] for t in texts]


def test_many_globs_are_judged_in_parts(spark, monkeypatch):
    from threatspark.llm import urls

    globs = [f"*.h{k}.net#/p{k % 7}*" for k in range(400)]
    pages = spark.range(900).selectExpr("id AS page_id", "concat('http://a.h', cast(id % 450 AS string), '.net/p', cast(id % 5 AS string), '/x') AS url")
    whole = sorted(map(str, judge_urls(pages, blocked=globs).collect()))
    assert sum("block" in r for r in whole) > 50
    for cells in (1, 1 << 14):
        monkeypatch.setattr(urls, "CELLS", cells)
        assert sorted(map(str, judge_urls(pages, blocked=globs).collect())) == whole
