import random
import zlib

import pytest

from threatspark.llm.language import identify

WORDS = {
    "en": "the of and in that with for this have from they which would there".split(),
    "de": "der die und das nicht mit ist ein auf eine auch sich werden über".split(),
    "fr": "les des est une dans pour qui que avec sont pas sur été où".split(),
    "es": "los las una por con para del está más como pero sus también año".split(),
    "zz": "qqx xxq zkz kzx wqz zzk xkq qzw kkx zwx".split(),
}


def texts(n, seed, languages):
    rng = random.Random(seed)
    return [(k, " ".join(rng.choice(WORDS[lang]) for _ in range(30)), lang) for k in range(n) for lang in [languages[k % len(languages)]]]


def test_held_out_accuracy(make_docs):
    rows = texts(300, 1, list(WORDS))
    got = {r.doc_id: r for r in identify(make_docs(rows)).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 == 1]
    assert {i for i, r in got.items() if r.held_out} == {r[0] for r in held}
    assert sum(got[i].lang_pred == lang for i, _, lang in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())


def test_predictions_depend_on_text_alone(make_docs):
    rows = texts(120, 2, ["en", "fr"])
    held = [k for k in range(1000, 1100) if zlib.crc32(str(k).encode()) % 3 == 1][:2]
    more = [(held[0], rows[1][1], "en"), (held[1], rows[1][1], None)]
    got = {r.doc_id: r for r in identify(make_docs(rows + more)).collect()}
    assert got[held[0]].lang_pred == got[held[1]].lang_pred == "fr" and got[held[0]].score == got[held[1]].score


def test_awkward_rows(make_docs):
    rows = texts(60, 3, ["en", "de"]) + [(None, "the of and", "en"), (900, None, "en"), (901, "", "de"), (902, "12 !? ٣", "en"), (903, "das ist", None), (5, "the of", "en")]
    got = identify(make_docs(rows)).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    assert [by_id[k].lang_pred for k in (900, 901, 902)] == ["und"] * 3
    assert by_id[903].lang_pred == "de"


@pytest.mark.parametrize("languages,expected", [([None], "und"), (["fr"], "fr")])
def test_little_to_learn_from(make_docs, languages, expected):
    rows = [(k, "les des est", languages[0]) for k in range(9)]
    assert {r.lang_pred for r in identify(make_docs(rows)).collect()} == {expected}


def test_empty_table(make_docs):
    assert identify(make_docs([(1, "a")]).limit(0)).count() == 0


def test_numbers_are_no_letters(make_docs):
    rows = texts(60, 4, ["en", "de"]) + [(900, "½ ² ①", None), (901, "٣ Ⅷ _", None), (902, "² der", None)]
    got = {r.doc_id: r for r in identify(make_docs(rows)).collect()}
    assert [(got[k].lang_pred, got[k].score) for k in (900, 901)] == [("und", 0.0)] * 2
    assert got[902].lang_pred in ("en", "de")


def test_against_plain_computation(make_docs):
    """Features, votes and scores once more, from the fitted machines with dictionaries and loops."""
    import math

    from threatspark.llm import language

    rows = texts(200, 5, list(WORDS)) + [(800, "the der les las", None), (801, "x" * 50_000 + " the of", None), (802, "Ünd ÉTÉ", None)]
    docs = make_docs(rows)
    model = language.fit(docs, "doc_id", "text", "lang", language.FAMILIES, language.SAMPLE_DOCS, language.BITS)
    assert sorted(model.languages) == ["germanic", "romance", "zz"] and len(model.between) == 3 and len(model.within["romance"]) == 1

    def features(text):
        data = (" " + text.lower() + " ").encode()
        counts = {}
        for k in range(len(data) - 2):
            gram = data[k] << 16 | data[k + 1] << 8 | data[k + 2]
            bucket = (gram * 0x9E3779B1 & 0xFFFFFFFF) >> 32 - language.BITS
            counts[bucket] = counts.get(bucket, 0) + 1
        size = math.sqrt(sum(counts.values()))
        return {b: math.sqrt(n) / size for b, n in counts.items()}

    def contest(x, names, machines):
        margins = {n: {} for n in names}
        for (a, b), (weights, intercept) in machines.items():
            m = sum(v * weights[k] for k, v in x.items()) + intercept
            margins[a][b], margins[b][a] = m, -m
        best = max(names, key=lambda n: (sum(m > 0 for m in margins[n].values()), sum(margins[n].values()), n))
        return best, 1 / (1 + math.exp(-2 * min([*margins[best].values(), 40.0])))

    got = {r.doc_id: r for r in identify(docs).collect()}
    for i, text, _ in rows:
        x = features(text)
        family, sure = contest(x, sorted(model.languages), model.between)
        name, within = contest(x, model.languages[family], model.within[family])
        assert got[i].lang_pred == name and abs(got[i].score - sure * within) < 1e-5


def test_a_machine_separates():
    import numpy as np

    from threatspark.llm.language import machine

    rng = np.random.default_rng(1)
    side = np.where(rng.random(300) < 0.5, 1.0, -1.0)
    x = rng.normal(size=(300, 20)) + side[:, None] * np.r_[2.0, np.zeros(19)]
    weights, intercept = machine(x, side)
    assert np.mean(np.sign(x @ weights + intercept) == side) > 0.97
    again, _ = machine(x, side)
    assert (weights == again).all()


def test_clashing_columns_and_long_texts(make_docs):
    from pyspark.sql import functions as F

    rows = texts(60, 6, ["en", "fr"]) + [(900, "les des " * 100_000, None)]
    docs = make_docs(rows)
    plain = {r.doc_id: r.lang_pred for r in identify(docs).collect()}
    more = docs.withColumns({n: F.lit("x") for n in ("p", "lang_pred", "score", "held_out", "family", "x", "kind", "a", "b", "sign", "id", "label", "features")})
    assert {r.doc_id: r.lang_pred for r in identify(more).collect()} == plain and plain[900] == "fr"
