import hashlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from threatspark.llm.exact import exact_duplicates, without_exact_duplicates


def brute(rows):
    """(doc_id, keep_id, group_size, sha) of every row, sorted; and how many rows of each group are kept."""
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i or 0, i))
    out = []
    for norm, members in groups.items():
        keep = min(members)[3]
        out += [(i, keep, len(members), hashlib.sha256(norm.encode()).hexdigest()) for *_, i in members]
    return sorted(out, key=str), len(groups)


def check(docs, **options):
    got = exact_duplicates(docs, **options).collect()
    expected, groups = brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == expected
    assert sum(r.kept for r in got) == groups
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_awkward_rows(awkward):
    check(awkward)


@pytest.mark.parametrize("block_bytes", [1, 3, 64])
def test_small_blocks_need_many_levels(make_docs, block_bytes):
    check(make_docs([(1, "abcdefg"), (2, "abc defg"), (3, "abcdefgh"), (4, "gfedcba"), (5, "abab"), (6, "ab ab"), (7, ""), (8, "a")]), block_bytes=block_bytes)


def test_hashes_that_clash_are_named_by_their_blocks(make_docs):
    docs = make_docs([(k, f"text {k % 7}" * (1 + k % 3)) for k in range(60)])
    check(docs, block_bytes=5, block_hash=lambda block: F.octet_length(block))


def test_empty_table(make_docs):
    assert exact_duplicates(make_docs([(1, "a")]).limit(0)).count() == 0


def test_rows_that_stay(awkward):
    stay = without_exact_duplicates(awkward)
    assert stay.columns == awkward.columns
    assert stay.count() == brute([(r.doc_id, r.text) for r in awkward.select("doc_id", "text").collect()])[1]


def test_no_python_in_the_plan(awkward):
    plan = exact_duplicates(awkward)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
