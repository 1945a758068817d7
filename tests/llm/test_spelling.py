import random
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from threatspark.llm import spelling
from threatspark.llm.spelling import SortedList, near_words, spelling_variants


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute_vocabulary(rows, least_length=5, least_count=3, noise=97):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = run.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{'' if i is None else i}:{word}".encode())
            if h % noise == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            if len(word) >= least_length:
                counts[word] += 1
    return {w: n for w, n in counts.items() if n >= least_count}


def brute(rows, **parameters):
    n = brute_vocabulary(rows, **parameters)
    near = {w: [v for v in n if abs(len(v) - len(w)) < 2 and distance(w, v) == 1] for w in n}
    best = {w: min(vs, key=lambda v: (-n[v], v)) for w, vs in near.items() if vs}
    form = {w: v for w, v in best.items() if n[v] >= 2 * n[w]}
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return sorted(out)


def found(frame):
    assert frame.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted(tuple(r) for r in frame.collect())


def random_words(rng, n, letters="abé", low=5, high=9):
    return ["".join(rng.choice(letters) for _ in range(rng.randint(low, high))) for _ in range(n)]


def test_a_list_against_plain_distances():
    rng = random.Random(1)
    for shared, size in ((0, 2), (1, 3), (2, 4), (3, 9)):
        words = sorted({"abababababab"[:shared] + w for w in random_words(rng, 150, "ab", 0, size)})
        list_ = SortedList(words, shared)
        for word in words:
            if len(word) > shared:
                assert [words[k] for k in list_.near(word)] == [v for v in words if distance(word, v) == 1]


def test_ranges_are_skipped(monkeypatch):
    words = sorted(random_words(random.Random(2), 400, "abcdefgh", 6, 8))
    list_, steps = SortedList(words, 0), Counter()

    class Counted(str):
        def __getitem__(self, k):
            steps["cells"] += 1
            return str.__getitem__(self, k)

    list_.words = [Counted(w) for w in words]
    list(list_.near("abcdefg"))
    assert steps["cells"] < 400  # one cell row for each of 400 words would be more than that, a whole matrix 2800


def test_near_words_against_brute_force(spark):
    rng = random.Random(3)
    n = {w: rng.randint(3, 9) for w in random_words(rng, 900)}
    words = spark.createDataFrame(list(n.items()), "word string, n long").repartition(5)
    expect = {}
    for w in n:
        near = [v for v in n if abs(len(v) - len(w)) < 2 and distance(w, v) == 1]
        if near:
            best = min(near, key=lambda v: (-n[v], v))
            expect[w] = (len(near), n[best], best)
    for list_words in (50_000, 4, 1):  # one list, and lists in parts
        rows = near_words(words, list_words).collect()
        assert len(rows) == len(expect) and {r.word: (r.n_near, r.best_n, r.best) for r in rows} == expect


def test_documents_against_brute_force(make_docs, monkeypatch):
    rng = random.Random(4)
    words = random_words(rng, 150, "abÀé") + ["Straße", "NAÏVE", "x×y÷zaa", "colour", "color", "colours"]
    rows = [(i, rng.choice([" ", "1", "Ā", "😀", "-", "\n"]).join(rng.choices(words, k=rng.randint(0, 60)))) for i in range(200)]
    rows += [(None, "colour colour"), (None, None), (3, "colour"), (3, "colour")]
    docs = make_docs(rows, 5)
    assert found(spelling_variants(docs)) == brute(rows)
    monkeypatch.setattr(spelling, "_COUNTED", 10)
    assert found(spelling_variants(docs, least_length=3, least_count=1, noise=3, list_words=20)) == brute(rows, least_length=3, least_count=1, noise=3)


def test_chains_of_forms(make_docs):
    chain = [("abcdefgh", 64), ("abcdefg", 32), ("abcdef", 16), ("abcde", 8), ("zabcde", 4), ("xzabcde", 2), ("tied1"[:4] + "x", 5)]
    rows = [(k, " ".join([w] * n)) for k, (w, n) in enumerate(chain)]
    got = found(spelling_variants(make_docs(rows), least_count=2, noise=1 << 40))
    assert got == brute(rows, least_count=2, noise=1 << 40)
    assert {r[2] for r in got} == {"abcdefgh", "tiedx"}


def test_awkward_rows(awkward):
    rows = [(r.doc_id, r.text) for r in awkward.select("doc_id", "text").collect()]
    assert found(spelling_variants(awkward, least_count=1)) == brute(rows, least_count=1)
    long = [(1, "a" * 50_000 + " " + "a" * 50_001 + " " + "a" * 49_999 + "b")]
    docs = awkward.sparkSession.createDataFrame(long, "doc_id long, text string")
    # of 50,000, 50,001 and 50,000 letters: one deleted and one replaced
    assert sorted(r.n_near for r in spelling_variants(docs, least_count=1, noise=1 << 40).collect()) == [1, 1, 2]


def test_empty_table_and_other_columns(make_docs):
    assert spelling_variants(make_docs([(1, "abcde")]).limit(0)).count() == 0
    docs = make_docs([(k, "abcde abcdef") for k in range(3)])
    for name in ("word", "n", "form", "near_word", "entry", "id"):
        docs = docs.withColumn(name, F.lit("x"))
    assert found(spelling_variants(docs, noise=1 << 40)) == [("abcde", None, "abcde", 3, 1, None), ("abcdef", None, "abcdef", 3, 1, None)]
