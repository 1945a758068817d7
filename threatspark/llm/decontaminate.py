"""Benchmark decontamination: every training passage queries a BM25 index of the test items by block-max WAND.

Test items are cut into parts of at most PART_WORDS words; a part is what the index scores. Document frequencies count items,
as the parts of an item are parts of one text; the mean length is that of all parts. Impacts are divided by the score of the part for itself, so that one
threshold holds for all parts and bounds can be compared with it.

The index is used in blocks of at most ``block_postings`` postings, each sent to the executors, as many passes over the
documents as there are blocks. Within one, parts are ordered by their
words and grouped by BLOCK_PARTS. The most frequent terms stand before the pivot, which is fixed for the block (no cursors move it):
they can't lift any part above PIVOT of the threshold, so a passage needs terms behind the pivot. For these the largest impact (WAND) and the largest impact in
each group (block-max) are kept, and for each group the most that the terms before the pivot can add. A passage is passed
over if its largest impacts stay below the threshold; then every group whose block-max sum does. Only what is left is
scored. Words repeated in a passage count once.

What is retrieved is verified in the document: the share of word 5-grams of the item's question found in it, and the same
for its answer. Without own columns the answer is the last quarter of the words.
"""

from __future__ import annotations

import math
import re
from array import array
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threatspark.llm.common import WorkerCache, own_names, settled, ship_code

PART_WORDS = 48
HALF = 32  # passages are 64 words, one starts every 32
BLOCK_PARTS = 8
PIVOT = 0.6
BLOCK_POSTINGS = 400_000
THRESHOLD = 0.5
OVERLAP = 0.8
GRAM = 5
SLICE_WORDS = 400_000
CACHED_WORDS = 200_000
K1, B = 1.2, 0.75
_TERM = re.compile(r"\w+")


def terms_of(text: str | None) -> list[str]:
    """The words of an item: runs of word characters, lower-cased."""
    return _TERM.findall((text or "").lower())


class BlockIndex:
    """The postings of some parts, with bounds by term and by group of parts."""

    def __init__(self, items: list[dict], frequency: dict[str, int], parts_in_all: int, mean_words: float, threshold: float) -> None:
        self.threshold = threshold
        self.items = [(x["item_id"], terms_of(x["question"]), terms_of(x["answer"])) for x in items]
        parts = []
        for k, (_, question, answer) in enumerate(self.items):
            words = question + answer
            n = max(1, math.ceil(len(words) / PART_WORDS))
            parts += [(words[len(words) * j // n : len(words) * (j + 1) // n], k) for j in range(n)]
        parts = sorted(p for p in parts if p[0])
        self.item_of = np.array([k for _, k in parts], np.int64)
        self.number: dict[str, int] = {}
        held = defaultdict(list)
        for p, (words, _) in enumerate(parts):
            impact = {}
            for t, tf in Counter(words).items():
                df = frequency[t]
                idf = math.log(1 + (parts_in_all - df + 0.5) / (df + 0.5))
                impact[t] = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(words) / mean_words))
            own = sum(impact.values())
            for t, x in impact.items():
                held[self.number.setdefault(t, len(self.number))].append((p, x / own))
        self.postings = [(np.array([p for p, _ in held[t]], np.int64), np.array([x for _, x in held[t]])) for t in range(len(self.number))]
        # the most frequent terms are those before the pivot: no part gets more than PIVOT of the threshold from them
        self.common = np.zeros(len(self.postings), bool)
        before = np.zeros(len(parts))
        for t in sorted(range(len(self.postings)), key=lambda t: -len(self.postings[t][0])):
            at, x = self.postings[t]
            if (before[at] + x).max() > PIVOT * threshold:
                break
            before[at] += x
            self.common[t] = True
        self.groups = max(1, -(-len(parts) // BLOCK_PARTS))
        self.rest = np.zeros(self.groups)  # the most that a part of a group gets from the common terms
        np.maximum.at(self.rest, np.arange(len(parts)) // BLOCK_PARTS, before)
        self.term_max, self.low, group, most = np.zeros(len(self.postings)), [0], [], []
        for t, (at, x) in enumerate(self.postings):
            for g in [] if self.common[t] else np.unique(at // BLOCK_PARTS).tolist():
                group.append(g)
                most.append(x[at // BLOCK_PARTS == g].max())
                self.term_max[t] = max(self.term_max[t], most[-1])
            self.low.append(len(group))
        self.by_group: list[dict[int, list[tuple[int, float]]]] = [{} for _ in range(self.groups)]
        for t, (at, x) in enumerate(self.postings):
            for p, y in zip(at.tolist(), x.tolist(), strict=True):
                self.by_group[p // BLOCK_PARTS].setdefault(t, []).append((p, y))
        self.low, self.group, self.block_max = np.array(self.low), np.array(group, np.int64), np.array(most)
        self.needed = [[self._grams([self.number[t] for t in side]) for side in (q, a)] for _, q, a in self.items]
        self.cache = _Numbers(self.number)

    @staticmethod
    def _grams(ids: list[int]) -> set[tuple[int, ...]]:
        size = max(1, min(GRAM, len(ids)))
        return {tuple(ids[k : k + size]) for k in range(len(ids) - size + 1)} if ids else set()

    def search(self, docs: list[str]) -> list[tuple[int, int, int, float]]:
        """(document, first word, part, score) of all passages and parts at or above the threshold."""
        self.terms = terms = [np.frombuffer(b"".join(map(self.cache.__getitem__, d.split())), np.int32) for d in docs]
        sizes = np.array([len(t) for t in terms])
        halves = -(-sizes // HALF)
        first = np.concatenate([[0], np.cumsum(halves)])
        if not first[-1] or not len(self.number):
            return []
        line = np.concatenate(terms)
        within = np.arange(len(line)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        half = np.repeat(first[:-1], sizes) + within // HALF
        opening = np.zeros(first[-1] + 1, bool)  # halves that begin a document, and are no second half of a passage
        opening[first[:-1][halves > 0]] = True
        least = self.threshold - 1e-6  # bounds are sums of rounded numbers
        hit = np.flatnonzero(line >= 0)
        hit = hit[~self.common[line[hit]]]
        # a word counts for the passage that starts at its half and for the one before
        second = hit[~opening[half[hit]]]
        passage, term = np.concatenate([half[hit], half[second] - 1]), line[np.concatenate([hit, second])]
        pairs = np.unique(passage * len(self.number) + term)
        passage, term = np.divmod(pairs, len(self.number))
        live = np.bincount(passage, self.term_max[term], first[-1]) + self.rest.max() >= least
        kept = live[passage]
        passage, term = passage[kept], term[kept]
        if not len(term):
            return []
        counts = self.low[term + 1] - self.low[term]
        ends = np.cumsum(counts)
        place = np.arange(ends[-1]) + np.repeat(self.low[term] - ends + counts, counts)
        key = np.repeat(passage, counts) * self.groups + self.group[place]
        order = np.argsort(key, kind="stable")
        key = key[order]
        starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        bound = np.add.reduceat(self.block_max[place[order]], starts)
        key = key[starts]
        out, firsts = [], first.tolist()
        for k in key[bound + self.rest[key % self.groups] >= least].tolist():
            h, g = divmod(k, self.groups)
            d = bisect_right(firsts, h) - 1
            at = (h - firsts[d]) * HALF
            scores: dict[int, float] = {}
            here = self.by_group[g]
            for t in here.keys() & terms[d][at : at + 2 * HALF].tolist():
                for p, x in here[t]:
                    scores[p] = scores.get(p, 0.0) + x
            out += [(d, at, p, x) for p, x in scores.items() if x >= least]
        return out

    def verified(self, docs: list[str], overlap: float) -> list[tuple[int, int, float, float, float, int]]:
        """(document, item number, score, question overlap, answer overlap, first word): the best passage of each pair."""
        best: dict[int, dict[int, tuple[float, int]]] = defaultdict(dict)
        for d, at, p, score in self.search(docs):
            k = int(self.item_of[p])
            best[d][k] = min(best[d].get(k, (0.0, 0)), (-score, at))
        out = []
        for d, found in sorted(best.items()):
            wanted = defaultdict(list)  # the grams of all items retrieved for this document, looked for in one pass
            for k in found:
                for side, grams in enumerate(self.needed[k]):
                    for gram in grams:
                        wanted[gram].append((k, side))
            ids, there = self.terms[d].tolist(), Counter()
            for size in {len(gram) for gram in wanted}:
                for gram in wanted.keys() & set(zip(*(ids[j:] for j in range(size)), strict=False)):
                    there.update(wanted[gram])
            for k, (score, at) in sorted(found.items()):
                shares = [there[k, side] / len(grams) if grams else 1.0 for side, grams in enumerate(self.needed[k])]
                if min(shares) >= overlap:
                    out.append((d, k, -score, shares[0], shares[1], at))
        return out


class _Numbers(WorkerCache):
    """The term numbers of a word as it is written, as int32 bytes: one for each run of word characters, -1 for terms of no item."""

    def __init__(self, number: dict[str, int]) -> None:
        self.number = number

    def __missing__(self, word: str) -> bytes:
        low = word.lower()
        terms = (low,) if low.isalnum() else _TERM.findall(low)
        found = array("i", [self.number.get(t, -1) for t in terms]).tobytes()
        if len(self) >= CACHED_WORDS:
            self.clear()
        if len(word) <= 64:
            self[word] = found
        return found


def _items(benchmark: DataFrame, item_col: str, text_col: str, question_col: str | None, answer_col: str | None) -> DataFrame:
    """item_id, question, answer, words (those of terms_of, as in BlockIndex): all items with a word in them."""

    @F.pandas_udf("array<string>")
    def terms(questions: pd.Series, answers: pd.Series) -> pd.Series:
        return pd.Series([terms_of(q) + terms_of(a) for q, a in zip(questions, answers, strict=True)], dtype="object")

    if question_col and answer_col:
        question, answer = F.coalesce(question_col, F.lit("")), F.coalesce(answer_col, F.lit(""))
        items = benchmark.select(F.col(item_col).alias("item_id"), question.alias("question"), answer.alias("answer"))
    else:
        words = F.split(F.trim(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), r"\s+", " ")), " ")
        parted = benchmark.select(F.col(item_col).alias("item_id"), words.alias("w"))
        cut = F.greatest(F.lit(0), F.size("w") - F.greatest(F.lit(1), F.ceil(F.size("w") / 4))).cast("int")
        items = parted.select(
            "item_id", F.array_join(F.slice("w", F.lit(1), cut), " ").alias("question"),
            F.array_join(F.slice("w", cut + 1, F.size("w")), " ").alias("answer"))
    # each block reads the items again, but they are cut once
    return settled(items.distinct().withColumn("words", terms("question", "answer")).where("size(words) > 0"), "items")


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", question_col: str | None = None, answer_col: str | None = None,
    threshold: float = THRESHOLD, overlap: float = OVERLAP, block_postings: int = BLOCK_POSTINGS,
) -> DataFrame:
    """One row per document and item found in it: doc_id, item_id, bm25, question_overlap, answer_overlap, first_word.

    ``bm25`` is the score of the best passage divided by the score of the item's part for itself; overlaps are shares of
    the item's distinct word 5-grams (of all its words, if fewer). Both must reach ``overlap``.

    Null and empty documents match nothing, null and empty items are not indexed. Null ids pass through, rows repeating a
    document each get their rows, repeated items count once. Empty tables give no rows; other columns are not read.
    """
    spark = ship_code(docs).sparkSession
    items = _items(benchmark, item_col, item_text_col, question_col, answer_col)
    n_parts = F.ceil(F.size("words") / PART_WORDS)
    total = items.agg(F.sum(n_parts), F.sum(F.size("words"))).first()
    schema = T.StructType([
        T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("item_id", benchmark.schema[item_col].dataType),
        T.StructField("bm25", T.DoubleType()), T.StructField("question_overlap", T.DoubleType()),
        T.StructField("answer_overlap", T.DoubleType()), T.StructField("first_word", T.LongType()),
    ])
    if not total[0]:
        return spark.createDataFrame([], schema)
    blocks = -(-total[1] // block_postings)
    placed = items.withColumn("block", F.pmod(F.xxhash64("question", "answer"), F.lit(blocks)))
    # document frequencies count items: parts of one item are parts of one text
    frequency = items.select(F.explode(F.array_distinct("words")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    out = None
    for block in range(blocks):
        own = placed.where(F.col("block") == block)
        rows = [r.asDict() for r in own.select("item_id", "question", "answer").collect()]  # at most about block_postings words
        terms = own.select(F.explode("words").alias("term")).distinct()
        df = {r.term: r.df for r in terms.join(frequency, "term").collect()}
        sent = spark.sparkContext.broadcast((rows, df, max(total[0], *df.values()) if df else 1, total[1] / total[0], threshold))
        found = _search(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")), sent, overlap, schema)
        out = found if out is None else out.unionByName(found)
    return out


def _search(docs: DataFrame, sent, overlap: float, schema: T.StructType) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = BlockIndex(*sent.value)
        index.cache.begin()

        def answer(ids: list, texts: list[str]) -> pa.RecordBatch:
            hits = index.verified(texts, overlap)
            columns = [[ids[d] for d, *_ in hits], [index.items[k][0] for _, k, *_ in hits]]
            columns += [[round(h[j], 6) for h in hits] for j in (2, 3, 4)] + [[h[5] for h in hits]]
            kinds = [batch.schema.field(0).type, None, pa.float64(), pa.float64(), pa.float64(), pa.int64()]
            kinds[1] = pa.infer_type([i[0] for i in index.items]) if any(i[0] is not None for i in index.items) else pa.int64()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=schema.names)

        for batch in batches:
            ids, texts, size = [], [], 0
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(i)
                texts.append(text or "")
                size += len(texts[-1])
                if size >= 6 * SLICE_WORDS:
                    yield answer(ids, texts)
                    ids, texts, size = [], [], 0
            if ids:
                yield answer(ids, texts)

    return docs.mapInArrow(work, schema)


def without_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` in which no test item is found, with all their columns; also rows without an id are judged."""
    plain, (own_id, own_text) = own_names(docs, id_col, text_col)
    key = F.concat_ws(":", F.xxhash64(F.col(own_text).cast("string")).cast("string"), F.col(own_id).cast("string"))
    named = plain.select(key.alias("_key"), F.col(own_text).alias("_text"))
    leaks = contaminated(named, benchmark, "_key", "_text").select(F.col("doc_id").alias("_leak")).distinct()
    keyed = plain.withColumn("_key", key).join(settled(leaks, "leaks"), F.col("_key") == F.col("_leak"), "left_anti")
    return keyed.select(*plain.columns).toDF(*docs.columns)
