import random

import pytest

from threatspark.llm import decontaminate
from threatspark.llm.decontaminate import contaminated, terms_of, without_contaminated


def grams(words, size):
    return {tuple(words[k : k + size]) for k in range(len(words) - size + 1)}


def sides(text):
    words = text.split()
    cut = max(0, len(words) - max(1, -(-len(words) // 4)))
    return terms_of(" ".join(words[:cut])), terms_of(" ".join(words[cut:]))


def brute(docs, items, overlap=0.8):
    out = set()
    for d, text in docs:
        words = terms_of(text)
        for i, item in items:
            question, answer = sides(item or "")
            if not question + answer:
                continue
            shares = []
            for side in (question, answer):
                size = min(5, len(side))
                shares.append(len(grams(side, size) & grams(words, size)) / len(grams(side, size)) if side else 1.0)
            if min(shares) >= overlap:
                out.add((d, i))
    return out


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    common = ["the", "of", "in", "and", "to"]
    word = lambda: rng.choice(common) if rng.random() < 0.5 else f"w{rng.randrange(3000)}"
    items = [(k, " ".join(word() for _ in range(rng.randint(12, 200)))) for k in range(60)]
    docs = []
    for d in range(120):
        words = [word() for _ in range(rng.randint(0, 300))]
        for _ in range(rng.randint(0, 2)):
            own = rng.choice(items)[1].split()
            kind = rng.randrange(4)
            if kind == 1:
                own[len(own) // 2] = "changed"
            elif kind == 2:
                own = own[: len(own) // 2]
            elif kind == 3:
                own = [w.upper() + "," for w in own]
            at = rng.randint(0, len(words))
            words[at:at] = own
        docs.append((d, " ".join(words)))
    return docs, items


@pytest.mark.parametrize("block_postings", [400_000, 1_000])
def test_against_brute_force(spark, make_docs, corpus, block_postings):
    docs, items = corpus
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in contaminated(make_docs(docs), benchmark, block_postings=block_postings).collect()}
    assert found == brute(docs, items)
    assert len(found) > 20


def test_bounds_lose_nothing(corpus):
    docs, items = corpus
    rows = [{"item_id": i, "question": t, "answer": ""} for i, t in items]
    frequency = {}
    for _, t in items:
        for w in set(terms_of(t)):
            frequency[w] = frequency.get(w, 0) + 1
    index = decontaminate.BlockIndex(rows, frequency, 100, 40.0, 0.3)
    texts = [t for _, t in docs]
    got = {(d, at, p): round(s, 6) for d, at, p, s in index.search(texts)}
    expected = {}
    for d, t in enumerate(texts):
        ids = index.terms[d].tolist()
        for at in range(0, len(ids), decontaminate.HALF):
            scores = {}
            for term in set(ids[at : at + 2 * decontaminate.HALF]) - {-1}:
                for p, x in zip(*index.postings[term], strict=True):
                    scores[int(p)] = scores.get(int(p), 0.0) + x
            expected |= {(d, at, p): round(float(s), 6) for p, s in scores.items() if s >= 0.3 - 1e-6}
    assert got.keys() == expected.keys() and len(got) > 20
    assert all(abs(got[k] - expected[k]) < 1e-5 for k in got)


def test_awkward_rows(spark, awkward):
    benchmark = spark.createDataFrame(
        [(1, None, "a"), (2, "", "a"), (3, "a null id", "a"), (3, "a null id", "b"), (None, "another text", "b"), (4, "!!! ...", "c")],
        "item_id long, text string, doc_id string")
    found = sorted(str((r.doc_id, r.item_id)) for r in contaminated(awkward, benchmark).collect())
    assert found == sorted(map(str, [(None, 3), (None, 3), (4, None)]))
    stay = without_contaminated(awkward, benchmark)
    assert stay.columns == awkward.columns
    assert stay.count() == awkward.count() - 3
    assert without_contaminated(awkward, benchmark.limit(0)).count() == awkward.count()
    assert contaminated(awkward.limit(0), benchmark).count() == 0


def test_own_question_and_answer(spark, make_docs):
    benchmark = spark.createDataFrame([(1, "what is the capital of that far land", "the city of nowhere at all")], "item_id long, q string, a string")
    docs = make_docs([(1, "what is the capital of that far land the city of nowhere at all"), (2, "what is the capital of that far land I ask you"), (3, "the city of nowhere at all")])
    found = contaminated(docs, benchmark, question_col="q", answer_col="a").collect()
    assert [(r.doc_id, r.question_overlap, r.answer_overlap) for r in found] == [(1, 1.0, 1.0)]


ODD = [
    (1, "the room has an area of 25 km² and ½ of it is wet"), (2, "हिन्दी भाषा में यह एक परीक्षा का प्रश्न है और उत्तर यहाँ है"),
    (3, "un café présenté à l'été dans la rue"), (4, "İstanbul ① and ② are the names of two İ signs"), (5, "½"), (6, "́ ्"),
]


@pytest.mark.parametrize("block_postings", [400_000, 20])
def test_signs_that_java_and_python_cut_differently(spark, make_docs, block_postings):
    docs = [(k, f"some words before {text} and others after it") for k, text in ODD]
    docs += [(10 + k, text.upper()) for k, text in ODD] + [(20, "none of them stands in here"), (21, "25 km and half of it is wet"), (22, "½ of it")]
    benchmark = spark.createDataFrame(ODD, "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in contaminated(make_docs(docs), benchmark, block_postings=block_postings).collect()}
    assert found == brute(docs, ODD)
    assert {(k, k) for k in range(1, 6)} <= found and not any(i == 6 for _, i in found)
