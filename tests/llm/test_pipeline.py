import re
import sys

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from registry.compare import compare, connect
from tests.llm.test_decontaminate import brute as leaks
from tests.llm.test_simhash import brute_components, brute_fingerprint
from threatspark.llm import queries, simhash
from threatspark.llm.common import settled, table
from threatspark.llm.graph import components


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, sf_dir, name):
    assert compare(spark, connect(sf_dir), sf_dir, queries.QUERIES[name], queries.ORACLES[name]) == ""


def test_one_query_for_each_operator():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES) == list(range(1, 14))


def test_stages_against_brute_force(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    benchmark = [(r.item_id, r.text) for r in table(spark, sf_dir, "benchmark").collect()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r for r in docs.collect()}
        out = settled(stage(spark, docs, sf_dir), name)
        after = {r.doc_id: r for r in out.collect()}
        assert out.count() == len(after) and after.keys() <= before.keys()
        if k < 4:
            assert out.columns == docs.columns and all(after[i] == before[i] for i in after)
        if name == "quality_classifier":
            labels = {r.doc_id: r.quality for r in table(spark, sf_dir, "labels").collect()}
            good = [i for i in before if labels.get(i) == 1]
            assert sum(i in after for i in good) >= 0.97 * len(good)
        elif name == "exact_dedup":
            groups = {}
            for i, r in before.items():
                groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", r.text or ""), []).append((-len(r.text or ""), i))
            assert after.keys() == {min(m)[1] for m in groups.values()}
        elif name == "simhash_near_dedup":
            label = brute_components([brute_fingerprint(r.text) for r in before.values()])
            first = {}
            for i, r in before.items():
                c = label[brute_fingerprint(r.text)]
                first[c] = min(first.get(c, i), i)
            assert after.keys() == set(first.values())
        elif name == "benchmark_decontamination":
            assert after.keys() == before.keys() - {i for i, _ in leaks([(i, r.text) for i, r in before.items()], benchmark)}
        else:
            assert after.keys() == before.keys()
            assert all(r.decoded == (before[i].text or "") and r.n_tokens == len(r.ids) for i, r in after.items())
        docs = out


def test_awkward_rows_pass_all_stages(spark, sf_dir, awkward):
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, awkward, sf_dir)
        assert k == 4 or out.columns == awkward.columns
        out.collect()
        assert stage(spark, awkward.where(F.lit(False)), sf_dir).count() == 0


def test_clashing_columns_pass_all_stages(spark, sf_dir):
    """Names that the operators use for themselves, with values that would give other results if they were taken."""
    docs = table(spark, sf_dir, "documents").limit(60)
    names = ["_key", "_leak", "_text", "_id", "_id0", "_sha", "_sha0", "_chars", "_chars0", "_own", "_own_text", "_gone", "_gone_text", "c0", "C1", "perturbed", "kept"]
    more = docs.withColumns({n: F.concat(F.lit(n), F.col("doc_id").cast("string")) for n in names})
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, more, sf_dir)
        assert out.columns == more.columns
        rows = out.collect()
        assert rows and all(r[n] == f"{n}{r.doc_id}" for r in rows for n in names)
        assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in stage(spark, docs, sf_dir).collect())


def test_links_of_near_documents_pass_no_driver(spark, sf_dir, monkeypatch):
    """The stage joins the exploded fingerprints without a broadcast; Spark would size them as before the explode."""
    plans = []
    monkeypatch.setattr(simhash, "components", lambda links: plans.append(links._jdf.queryExecution().executedPlan().toString()) or components(links))
    docs = table(spark, sf_dir, "documents")
    assert 0 < dict(corpus_pipeline.STAGES)["simhash_near_dedup"](spark, docs, sf_dir).count() < docs.count()
    assert "SortMergeJoin" in plans[0] and "Broadcast" not in plans[0]


def test_nothing_else_imports_the_subpackage():
    import subprocess

    code = "import sys, registry.queries, threatspark.plans.detection, threatspark.streaming.jobs; print([m for m in sys.modules if 'threatspark.llm' in m])"
    assert subprocess.run([sys.executable, "-c", code], capture_output=True, text=True).stdout.strip() == "[]"
