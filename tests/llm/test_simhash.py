import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from threatspark.llm.graph import components
from threatspark.llm.simhash import fingerprint_of, near_links, simhash_groups, without_near_duplicates


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(values, max_bits=3):
    values = sorted(set(values))
    label = {v: v for v in values}
    changed = True
    while changed:
        changed = False
        for a in values:
            for b in values:
                if (a ^ b).bit_count() <= max_bits and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return label


def test_fingerprints():
    rng = random.Random(1)
    texts = [None, "", " \n", "A", "a b", "A B c", "É ÀB c d\x1c e"] + [
        " ".join(rng.choice(["the", "Of", "in", "x", "ß", "日本"]) for _ in range(rng.randint(3, 80))) for _ in range(60)]
    assert [fingerprint_of(t) for t in texts] == [brute_fingerprint(t) for t in texts]


def test_long_texts_are_counted_in_parts(monkeypatch):
    text = " ".join(str(k) for k in range(3000))
    whole = fingerprint_of(text)
    monkeypatch.setattr("threatspark.llm.simhash._ROWS", 7)
    assert fingerprint_of(text) == whole


def test_links_against_all_pairs(spark):
    rng = random.Random(2)
    values = set()
    for _ in range(60):
        base = rng.getrandbits(64)
        for _ in range(6):
            values.add(base ^ sum({1 << rng.randrange(64) for _ in range(rng.randint(0, 5))}))
    values |= {0, 1, (1 << 64) - 1, 1 << 63, (1 << 31) | (1 << 32)}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    for bits in (1, 2, 3, 4, 5):
        rows = near_links(spark.createDataFrame([(v,) for v in signed], "fp long"), bits).distinct().collect()
        got = {(min(r.u, r.v), max(r.u, r.v)) for r in rows}
        mask = (1 << 64) - 1
        assert got == {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & mask).bit_count() <= bits}


def test_exploded_fingerprints_are_never_broadcast(spark, tmp_path):
    """Spark sizes them as before the explode: 35 rows for each fingerprint would go through the driver."""
    spark.range(1000).selectExpr("xxhash64(id) AS fp").write.parquet(f"{tmp_path}/fp")
    links = near_links(spark.read.parquet(f"{tmp_path}/fp"))
    assert links.count() == 0
    plan = links._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


@pytest.mark.parametrize("bits", [1, 2, 3])
def test_crowds_are_connected_like_pairs(spark, bits):
    rng = random.Random(8)
    base = [rng.getrandbits(64) for _ in range(4)]
    values = {b ^ sum({1 << rng.randrange(64) for _ in range(rng.randint(0, 4))}) for b in base for _ in range(60)}
    label = brute_components(values, bits)
    signed = {v - (1 << 64) if v >> 63 else v: v for v in values}
    links = near_links(spark.createDataFrame([(v,) for v in signed], "fp long"), bits, crowd=5)
    found = {r.node: r.label for r in components(links).collect()}
    groups, expected = {}, {}
    for s, v in signed.items():
        groups.setdefault(found.get(s, s), set()).add(v)
        expected.setdefault(label[v], set()).add(v)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(7, 7)]
    found = {r.node: r.label for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {k: 0 for k in range(41)} | {100 + k: 100 for k in range(30)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_awkward_rows(awkward):
    rows = [(r.doc_id, r.text) for r in awkward.select("doc_id", "text").collect()]
    got = simhash_groups(awkward).collect()
    label = brute_components([brute_fingerprint(t) for _, t in rows])
    members = {}
    for i, t in rows:
        members.setdefault(label[brute_fingerprint(t)], []).append(i)
    expected = [
        (i, f"{brute_fingerprint(t):016x}", min((x for x in m if x is not None), default=None), len(m))
        for i, t in rows for m in [members[label[brute_fingerprint(t)]]]
    ]
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, expected))


def test_one_of_each_group_stays(make_docs):
    words = [f"w{k}" for k in range(400)]
    near = words[:200] + ["changed"] + words[201:]
    docs = make_docs([(5, " ".join(words)), (3, " ".join(near)), (9, " ".join(words)), (7, "quite another text it is")])
    stay = without_near_duplicates(docs)
    groups = {r.component_id for r in simhash_groups(docs).collect()}
    assert stay.columns == docs.columns
    assert {r.doc_id for r in stay.collect()} == groups


def test_empty_table(make_docs):
    assert simhash_groups(make_docs([(1, "a")]).limit(0)).count() == 0
    assert without_near_duplicates(make_docs([(1, "a")]).where(F.lit(False))).count() == 0
