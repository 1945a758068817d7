import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from threatspark.llm.mixing import copies_of, mix, source_targets


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    """Shares again and again what is over, until no source is above its limit."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    open_, target, rest = set(names), {}, share * sum(sizes.values())
    while open_:
        level = rest / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level >= most * sizes[s]}
        if not over:
            return target | {s: weight[s] * level for s in open_}
        for s in over:
            target[s] = most * sizes[s]
            rest -= target[s]
        open_ -= over
    return target


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


@pytest.fixture
def sourced(spark):
    return lambda rows: spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)


_UNEVEN = {"a": 10, "b": 1000, "c": 5, "d": 700, "é": 1, "z": 0, "Z": 40, None: 300}
_MANY = {f"s{k}": (k * k) % 97 for k in range(60)}


@pytest.mark.parametrize("sizes,share,most", [
    ({"a": 100, "b": 100, "c": 100}, 1.5, 2.0), (_UNEVEN, 1.5, 2.0), ({None: 7}, 1.5, 2.0), ({"a": 0, "b": 0}, 1.5, 2.0), (_MANY, 1.5, 2.0),
    ({}, 1.5, 2.0), (_UNEVEN, 0.2, 2.0), (_UNEVEN, 3.0, 2.0), (_UNEVEN, 2.0, 2.0), (_MANY, 1.0, 5.0),
])
def test_targets(spark, sizes, share, most):
    rows = spark.createDataFrame(list(sizes.items()), "source string, source_size long").repartition(4)
    got = {r.source: r.target for r in source_targets(rows, share=share, most=most).collect()}
    assert got == pytest.approx(brute_targets(sizes, share=share, most=most))
    assert sum(got.values()) == pytest.approx(min(share, most) * sum(sizes.values()))


def rows_of_sources():
    rows = [(k, "w " * (1 + k % 7), f"s{k % 5}") for k in range(3000)] + [(k, "x y\x0bz", "hot") for k in range(3000, 6000)]
    return rows + [(9000 + k, None, "blank") for k in range(5)] + [(None, "a b", None), (None, "a b", None), (9100, "", None), (1, "w ", "s1")]


def test_documents(sourced):
    rows = rows_of_sources()
    docs = sourced(rows)
    frame = copies_of(docs)
    assert frame.columns == ["doc_id", "size", "source_size", "target", "copies"]
    got = frame.collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, copies_of(docs.repartition(5)).collect()), key=str)
    assert sorted(((r.doc_id, r.size) for r in got), key=str) == sorted(((i, words(t)) for i, t, _ in rows), key=str)
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += words(text)
    target = brute_targets(sizes)
    source_of = {i: s for i, _, s in rows}
    taken = defaultdict(int)
    for r in got:
        s = source_of[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(target[s])
        rate = target[s] / sizes[s] if sizes[s] else 0
        assert int(rate) <= r.copies <= int(rate) + (rate > int(rate)) <= 2
        taken[s] += r.size * r.copies
    for s, t in target.items():
        assert abs(taken[s] - t) <= max(0.1 * t, 4)


def test_the_mixture_repeats_rows(sourced):
    docs = sourced(rows_of_sources()).withColumns({c: F.lit("mine") for c in ("size", "copies", "target", "c0", "own", "rate", "Copy")})
    out = mix(docs)
    assert out.columns == docs.columns
    asked = Counter()
    for r in copies_of(docs).collect():
        asked[r.doc_id] += r.copies
    assert Counter(r.doc_id for r in out.collect()) == +asked
    assert {tuple(r)[3:] for r in out.collect()} == {("mine",) * 7}


def test_seeds_and_awkward_rows(sourced, awkward):
    docs = sourced(rows_of_sources())
    a, b = ({(r.doc_id, r.size): r.copies for r in copies_of(docs, seed=s).collect()} for s in (0, 1))
    assert a != b
    got = copies_of(awkward.withColumn("source", F.lit(None).cast("string"))).collect()
    assert len(got) == awkward.count() and {r.target for r in got} == {1.5 * sum(r.size for r in got)}


def test_empty_table(sourced):
    docs = sourced([(1, "a", "s")]).limit(0)
    assert copies_of(docs).count() == 0 and mix(docs).count() == 0
    with pytest.raises(ValueError):
        copies_of(docs, weights=())
