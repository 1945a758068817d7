import math
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from threatspark.llm.quality import good_documents, importance_sample, threshold_of

BITS = 10


def brute_buckets(text):
    h = [xxhash.xxh64(t.encode()).intdigest() for t in re.findall(r"\w+|[^\w\s]+", text or "")]
    h = [int.from_bytes(x.to_bytes(8, "big"), "little") for x in h]  # as read from the digest's bytes
    mask, m1, m2 = (1 << 64) - 1, 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
    grams = h + [((a * m1 + b) & mask) ^ m2 for a, b in zip(h, h[1:], strict=False)]
    return [(g * m1 & mask) >> (64 - BITS) for g in grams]


def corpus(seed=1):
    rng = random.Random(seed)
    docs, labels = [], []
    for k in range(200):
        good = k % 4 != 0
        words = [rng.choice(["the", "of", "a", "sea", "land,"]) if good else rng.choice(["BUY!!", "now", "$$$"]) for _ in range(rng.randint(5, 60))]
        docs.append((k, " ".join(words)))
        if k % 2 == 0 or k % 5 == 0:
            labels.append((k, int(good)))
    return docs, labels


def test_scores_and_sample(spark, make_docs):
    docs, labels = corpus()
    table = spark.createDataFrame([*labels, (None, 1), (3, None), (9999, 0)], "doc_id long, quality int")
    got = {r.doc_id: r for r in importance_sample(make_docs(docs), table, bits=BITS).collect()}
    good = {i for i, q in labels if q}
    raw, target = np.zeros(1 << BITS), np.zeros(1 << BITS)
    for i, t in docs:
        for b in brute_buckets(t):
            raw[b] += 1
            target[b] += i in good
    ratio = np.log((target + 1) / (target.sum() + len(target))) - np.log((raw + 1) / (raw.sum() + len(raw)))
    for i, t in docs:
        assert math.isclose(got[i].log_importance, sum(ratio[b] for b in brute_buckets(t)), abs_tol=1e-4)
    k = round(len(docs) * len(good) / len(labels))
    order = sorted(got.values(), key=lambda r: -r.perturbed)
    assert {r.doc_id for r in order[:k]} == {i for i, r in got.items() if r.kept}
    assert sum(r.kept == (i % 4 != 0) for i, r in got.items()) > 0.8 * len(docs)  # noise decides on the short ones


def test_rows_that_stay(spark, make_docs):
    docs, labels = corpus(2)
    frame, table = make_docs(docs), spark.createDataFrame(labels, "doc_id long, quality int")
    stay = good_documents(frame, table)
    assert stay.columns == frame.columns
    kept = importance_sample(frame, table).where("kept")
    assert {r.doc_id for r in stay.collect()} == {r.doc_id for r in kept.collect()}


@pytest.mark.parametrize("values", [[1.0] * 50, list(range(50)), [0.0, 1e-9] * 20 + [1e9], [-1e300, 1.5, 1.5, 1.5, 2.0], [7.0]])
def test_thresholds(spark, values):
    frame = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
    for k in {1, 2, len(values) // 2, len(values) - 1, len(values), len(values) + 5} - {0}:
        assert threshold_of(frame, "v", k, enough=3, buckets=4) == sorted(map(float, values))[-min(k, len(values))]
    assert threshold_of(frame, "v", 0) is None and threshold_of(frame.limit(0), "v", 3) is None


def test_awkward_rows(spark, awkward):
    labels = spark.createDataFrame([(7, 1), (4, 1), (8, 0)], "doc_id long, quality int")
    got = importance_sample(awkward, labels).collect()
    assert len(got) == awkward.count()
    assert all(r.log_importance is None and not r.kept for r in got if r.doc_id in (1, 2, 3))
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.doc_id for r in importance_sample(awkward, none).collect() if r.kept} == {None, 4, 5, 6, 7, 8, 9, 10}
    assert good_documents(awkward, none).columns == awkward.columns
    assert good_documents(awkward.where(F.lit(False)), labels).count() == 0


def test_documents_without_words_take_no_places(spark, make_docs):
    docs, labels = corpus(3)
    empty = [(1000 + k, [None, "", " \u00a0\u2003\n"][k % 3]) for k in range(100)]  # a third of all
    table = spark.createDataFrame(labels + [(1000 + k, k % 2) for k in range(60)], "doc_id long, quality int")
    share = sum(q for _, q in labels) / len(labels)
    got = importance_sample(make_docs(docs + empty), table).collect()
    kept = {r.doc_id for r in got if r.kept}
    assert len(got) == 300 and len(kept) == round(len(docs) * share) < len(docs)
    assert {r.doc_id for r in good_documents(make_docs(docs + empty), table).collect()} == kept
