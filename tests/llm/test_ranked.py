import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from threatspark.llm import ranked
from threatspark.llm.ranked import Best, ImpactLists, Slice, search, terms_of, top_documents

_TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def cut(text):
    return _TERM.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(rows, items, k=10):
    docs = [(i, Counter(t), len(t)) for i, text in rows if (t := cut(text))]
    total, df = sum(n for _, _, n in docs), Counter(t for _, c, _ in docs for t in c)
    out = []
    for item, text in {(i, t) for i, t in items if t is not None}:
        scored = []
        for i, tf, n in docs:
            m = 25 + 75 * n * len(docs) // total
            score = sum(
                math.floor(1000 * math.log((2 * len(docs) + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 8 * m)) for t in cut(text) if tf[t])
            if score > 0:
                scored.append((-score, i is None, i))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def found(frame):
    assert frame.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in frame.collect()), key=str)


@pytest.fixture
def make_items(spark):
    return lambda rows: spark.createDataFrame(rows, "item_id long, text string")


def random_text(rng, n):
    return " ".join(f"w{int(rng.paretovariate(0.6)) % 300}" for _ in range(n))


def test_terms():
    for text in ("", "A b-C9 été_x", "ÀÉ z\x00q\x7fr", "10.5% 日本語、テスト", " x"):
        assert [t.decode() for part in terms_of(text.encode()) for t in part] == cut(text)


def test_long_texts_are_cut_between_terms(monkeypatch):
    monkeypatch.setattr(ranked, "_CHUNK", 7)
    text = "some words, longword" * 50
    assert [t.decode() for part in terms_of(text.encode()) for t in part] == cut(text)


def test_against_brute_force(make_docs, make_items, monkeypatch):
    rng = random.Random(1)
    rows = [(i, random_text(rng, rng.randint(0, 60))) for i in range(400)]
    rows += [(1000 + i, rows[7][1]) for i in range(30)] + [(None, rows[7][1]), (7, rows[7][1]), (None, None), (5, "")]
    items = [(i, random_text(rng, rng.randint(1, 25))) for i in range(25)]
    items += [(50, rows[7][1]), (50, rows[7][1]), (50, "w1 w2 w2"), (51, None), (52, ""), (None, "w3 W3"), (53, "nowhere")]
    expect = brute(rows, items)
    assert found(top_documents(make_docs(rows, 1), make_items(items))) == expect
    monkeypatch.setattr(ranked, "SLICE_WORDS", 500)
    monkeypatch.setattr(ranked, "_FIRST_READ", 1)
    assert found(top_documents(make_docs(rows, 4), make_items(items), block_terms=100)) == expect
    assert found(top_documents(make_docs(rows, 3), make_items(items), k=3)) == brute(rows, items, 3)


def test_best_positions_stop_early_and_strictly_below():
    part = Slice({b"a": 1, b"b": 2})
    for i in range(5000):
        part.add(i, b"a b " * (1 + i % 50) + b"x " * (i % 97))
    lists = ImpactLists(part, 5000, sum(part.lengths))
    best = Best(10)
    looked = search(lists, [(1, 3), (2, 5)], best)
    assert looked < 500
    whole = Best(10)
    score = np.zeros(5000, np.int64)
    for term, factor in ((1, 3), (2, 5)):
        low, high = lists.span[term]
        score[lists.doc[low:high]] += factor * lists.impact[low:high]
    whole.add(score, lists.null, lists.id)
    assert best.id.tolist() == whole.id.tolist() and best.score.tolist() == whole.score.tolist()
    ties = Slice({b"a": 1})
    for i in range(300, 0, -1):  # all equal: every document ties with the 10th, so all must be seen
        ties.add(i, b"a")
    tied = Best(10)
    assert search(ImpactLists(ties, 300, 300), [(1, 1)], tied) == 300
    assert tied.id.tolist() == list(range(1, 11))


def test_awkward_rows(awkward, make_items):
    rows = [(r.doc_id, r.text) for r in awkward.select("doc_id", "text").collect()]
    items = [(1, "word"), (2, "A b c abc"), (3, "null id É"), (4, "another text x")]
    docs = awkward.withColumns({c: F.lit("z") for c in ("item", "score", "rank", "item_id", "term")})
    assert found(top_documents(docs, make_items(items).withColumns({"doc_id": F.lit(1), "item": F.lit(2)}))) == brute(rows, items)


def test_empty_tables(make_docs, make_items):
    docs = make_docs([(1, "a")])
    assert top_documents(docs.limit(0), make_items([(1, "a")])).count() == 0
    assert top_documents(docs, make_items([(1, "a")]).limit(0)).count() == 0
    assert top_documents(docs, make_items([(1, None)])).count() == 0
