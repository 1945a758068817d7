import random
import re

import numpy as np

from threatspark.llm import substrings
from threatspark.llm.substrings import without_repeats


def brute(rows, window):
    """(doc_id, words, removed, kept) of every row; rows repeating id and text are one document."""
    order = sorted({(i is None, i or 0, t or "") for i, t in rows})
    seen, out = {}, {}
    for null, i, text in order:
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        gone = [False] * len(words)
        for p in range(len(words) - window + 1):
            key = tuple(words[p : p + window])
            if key in seen:
                gone[p : p + window] = [True] * window
            seen.setdefault(key, (i, p))
        out[(None if null else i, text)] = (len(words), sum(gone), " ".join(w for w, g in zip(words, gone, strict=True) if not g))
    return sorted(((i, *out[(i, t or "")]) for i, t in rows), key=str)


def check(docs, window):
    got = without_repeats(docs, window)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    found = got.collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in found), key=str) == brute(rows, window)
    assert all(sum(f["words"] for f in r.factors) == r.n_removed for r in found)


def random_rows(n, seed):
    rng = random.Random(seed)
    passages = [[rng.choice("abcdefgh") + str(rng.randrange(40)) for _ in range(rng.randint(5, 60))] for _ in range(8)]
    rows = []
    for i in range(n):
        words = []
        for _ in range(rng.randint(0, 6)):
            if rng.random() < 0.5:
                p = rng.choice(passages)
                a = rng.randrange(len(p))
                words += p[a : a + rng.randint(1, 60)]
            else:
                words += [rng.choice(["the", "of", "in", "x", f"r{rng.randrange(10**6)}"]) for _ in range(rng.randint(0, 30))]
        rows.append((i, rng.choice([" ", "\n", "  "]).join(words)))
    return rows


def test_against_brute_force(make_docs):
    for window, seed in ((20, 1), (5, 2), (12, 3)):
        check(make_docs(random_rows(120, seed), 5), window)


def test_repeats_found_across_slices(make_docs, monkeypatch):
    rows = random_rows(60, 4)
    monkeypatch.setattr(substrings, "SLICE_WORDS", 50)
    check(make_docs(rows, 1), 8)


def test_a_text_that_repeats_itself(make_docs):
    check(make_docs([(1, "a " * 500), (2, "a " * 30 + "b"), (3, "b " * 19), (4, "b " * 20)]), 20)


def test_awkward_rows(awkward):
    rows = [(r.doc_id, r.text) for r in awkward.select("doc_id", "text").collect()]
    ordered = {(i, t) for i, t in rows if i == 4}
    assert len(ordered) == 2  # two texts under one id share no window, so their order doesn't matter
    check(awkward, 3)


def test_empty_table(make_docs):
    assert without_repeats(make_docs([(1, "a")]).limit(0)).count() == 0


def test_factors_are_the_longest_matches():
    """Against all earlier phrases with the same anchor, word by word; what follows a factor is looked up again."""
    rng = random.Random(6)
    window, gram = 6, 3
    left, size = window - gram, 2 * window - gram
    rows = []
    for _ in range(300):
        n = rng.randint(1, left + 1)
        lead = rng.randint(n - 1, left)
        line = [0] * size
        for k in range(left - lead, left - lead + n + window - 1):
            line[k] = 7 if left <= k < left + gram else rng.choice([1, 1, 1, 2])
        rows.append((rng.choice([5, 9]), n, lead, line))
    rows.sort(key=lambda r: r[0])
    expect = []
    for i, (h, n, lead, line) in enumerate(rows):
        low = left - lead
        high, at = low + n + window - 1, low
        while at + window <= high:
            longest = 0
            for h2, n2, lead2, other in rows[:i]:
                if h2 == h and left - lead2 <= at:
                    k = at
                    while k < min(high, left - lead2 + n2 + window - 1) and other[k] == line[k]:
                        k += 1
                    longest = max(longest, k - at)
            if longest >= window:
                expect.append((i, at - low, longest - window + 1))
            at += max(1, longest - window + 1)
    h, n, lead = (np.array([r[k] for r in rows]) for k in range(3))
    got = substrings.factors(h.astype(np.uint64), n, lead, np.array([r[3] for r in rows], np.uint64), window)
    assert sorted(zip(*(x.tolist() for x in got), strict=True)) == expect and len(expect) > 100


def test_hot_anchors_are_split(make_docs, monkeypatch):
    rows = random_rows(120, 7)
    line = " ".join(f"common{k}" for k in range(14))
    rng = random.Random(8)
    rows += [(1000 + k, f"{rng.randrange(9)} x{rng.randrange(5)} y z {line} {rng.randrange(4)} a b c d{rng.randrange(6)} e") for k in range(80)]
    docs = make_docs(rows, 4)
    plain = sorted(map(tuple, without_repeats(docs).select("doc_id", "n_removed", "kept_text").collect()))
    monkeypatch.setattr(substrings, "SAMPLED", 1)
    for most in (10, 1, 0):
        monkeypatch.setattr(substrings, "HOT_DOCS", most)
        keyed = docs.selectExpr("doc_id AS doc", "0 AS tag", "cast(text AS binary) AS text")
        assert len(substrings._hot_anchors(keyed, 20)) > 0
        assert sorted(map(tuple, without_repeats(docs).select("doc_id", "n_removed", "kept_text").collect())) == plain
        check(docs, 20)


def test_blocks_keep_anchors_together():
    import pyarrow as pa

    rng = random.Random(9)
    h = sorted(rng.choices(range(40), k=500))
    batches, at = [], 0
    while at < len(h):
        size = rng.randint(0, 30)
        batches.append(pa.RecordBatch.from_arrays([pa.array(h[at : at + size], pa.int64())], names=["h"]))
        at += size
    before, substrings.BLOCK_ROWS = substrings.BLOCK_ROWS, 60
    try:
        blocks = [b.column(0).to_pylist() for b in substrings._blocks(iter(batches))]
    finally:
        substrings.BLOCK_ROWS = before
    assert [x for b in blocks for x in b] == h and len(blocks) > 4
    assert all(a[-1] != b[0] for a, b in zip(blocks, blocks[1:], strict=False))
