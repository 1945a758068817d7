"""Ranked lexical search by the Best Position Algorithm.

Every item asks for the documents of highest score, a sum over its terms of term weight times impact of the term in the
document. One pass over the documents counts documents, words and document frequencies. In a second pass each task takes
slices of documents and sorts, for each term of the items, an impact list of the slice: its documents by falling impact.
An item then reads its lists side by side from the top. A document met there for the first time is looked up in all other
lists directly, which gives its whole score and marks its position in each of them as seen. The best position of a list is
the last one up to which all are seen, whether read or looked up: an unseen document stands behind it in every list, so the
impacts there, weighted and added up, bound its score. The item stops once this bound is strictly below its k-th score;
documents that tie with the k-th are therefore all seen. The k-th score is carried from slice to slice of a task, and the
best documents of all tasks are ranked at the end.

The terms of the items are sent to the executors, in blocks of at most about ``block_terms`` words of items; a block takes
two passes over the documents. A slice holds ``SLICE_WORDS`` words or one document.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threatspark.llm.common import settled, ship_code

K = 10
SLICE_WORDS = 2_000_000
BLOCK_TERMS = 1_000_000
#: Bytes of a task for direct access: the places of the slice's documents in the lists used last.
PLACES = 128 << 20
_FIRST_READ = 32
_CHUNK = 1 << 20

#: Bytes of UTF-8: A to Z to lower case, ASCII other than letters and digits to blanks, all else as it is.
_CLEAN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def terms_of(text: bytes | None) -> Iterator[list[bytes]]:
    """The terms of a text, in lists of those of about a megabyte."""
    at, clean = 0, (text or b"").translate(_CLEAN)
    while at < len(clean):
        end = clean.find(b" ", at + _CHUNK)
        end = len(clean) if end < 0 else end
        yield clean[at:end].split()
        at = end


def term_weight(documents: int, frequency: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * frequency + 1)))


class Slice:
    """Some documents: their ids, lengths, and (term, document, occurrences) for the terms that items ask for."""

    def __init__(self, number_of: dict[bytes, int]) -> None:
        self.number_of, self.ids, self.lengths, self.words = number_of, [], [], 0
        self._terms, self._sizes = [], []

    def add(self, doc_id: int | None, text: bytes | None) -> None:
        n, found = 0, []
        for words in terms_of(text):
            n += len(words)
            found.append(np.array([*filter(None, map(self.number_of.get, words))], np.int64))  # numbers begin with 1
        if n:
            self.ids.append(doc_id)
            self.lengths.append(n)
            self._terms += found
            self._sizes.append(sum(map(len, found)))
            self.words += n

    def postings(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """term, document and occurrences, by term and document."""
        size = max(1, len(self.ids))
        of = np.repeat(np.arange(len(self.ids), dtype=np.int64), self._sizes)
        keys, counts = np.unique(np.concatenate([*self._terms, np.empty(0, np.int64)]) * size + of, return_counts=True)
        return keys // size, keys % size, counts


class ImpactLists:
    """The impact lists of a slice, with direct access to the place of a document in each."""

    def __init__(self, part: Slice, documents: int, words: int) -> None:
        term, doc, tf = part.postings()
        size = np.array([25 + 75 * n * documents // words for n in part.lengths], np.int64)
        impact = 1_000_000_000 * tf // (1000 * tf + 8 * size[doc])
        order = np.lexsort((doc, -impact, term))
        self.doc, self.impact = doc[order], impact[order]
        names, first = np.unique(term, return_index=True)
        ends = np.append(first, len(term))[1:]  # a slice may hold none of the terms
        self.span = dict(zip(names.tolist(), zip(first.tolist(), ends.tolist(), strict=True), strict=True))
        self.documents = len(part.ids)
        self.null = np.array([i is None for i in part.ids], bool)
        self.id = np.array([0 if i is None else i for i in part.ids], np.int64)
        self._places: dict[int, np.ndarray] = {}

    def places(self, term: int) -> np.ndarray:
        """The place of every document of the slice in the list of a term, -1 where it lacks the term."""
        found = self._places.get(term)
        if found is None:
            if len(self._places) * 4 * self.documents > PLACES:
                self._places.clear()
            low, high = self.span[term]
            found = np.full(self.documents, -1, np.int32)
            found[self.doc[low:high]] = np.arange(high - low, dtype=np.int32)
            self._places[term] = found
        return found


class Best:
    """The k best documents so far: highest score, then smallest id, null last."""

    def __init__(self, k: int) -> None:
        self.k, self.score, self.null, self.id = k, np.empty(0, np.int64), np.empty(0, bool), np.empty(0, np.int64)

    @property
    def least(self) -> int:
        """The k-th score; 0 while there are fewer."""
        return int(self.score[-1]) if len(self.score) == self.k else 0

    def add(self, score: np.ndarray, null: np.ndarray, id_: np.ndarray) -> None:
        go = score >= max(1, self.least)
        score, null, id_ = (np.concatenate([a, b[go]]) for a, b in ((self.score, score), (self.null, null), (self.id, id_)))
        order = np.lexsort((id_, null, -score))[: self.k]
        self.score, self.null, self.id = score[order], null[order], id_[order]


def search(lists: ImpactLists, factors: list[tuple[int, int]], best: Best) -> int:
    """Adds the best documents of the slice for an item of (term, factor) to ``best``; returns the documents looked at."""
    asked = [(t, f, *lists.span[t]) for t, f in factors if f > 0 and t in lists.span]
    seen = np.zeros(lists.documents, bool)
    marks = [np.zeros(high - low, bool) for _, _, low, high in asked]
    front = [0] * len(asked)  # positions of a list seen without a gap from its top: the last is its best position
    at, step = 0, _FIRST_READ
    longest = max((len(m) for m in marks), default=0)
    while at < longest:
        read = np.unique(np.concatenate([lists.doc[low + at : min(low + at + step, high)] for _, _, low, high in asked]))
        new = read[~seen[read]]
        seen[new] = True
        score = np.zeros(len(new), np.int64)
        for (term, factor, low, _), mark in zip(asked, marks, strict=True):
            place = lists.places(term)[new]
            has = place >= 0
            place = place[has]
            mark[place] = True
            score[has] += factor * lists.impact[low + place]
        best.add(score, lists.null[new], lists.id[new])
        bound = 0
        for k, ((_, factor, low, _), mark) in enumerate(zip(asked, marks, strict=True)):
            if front[k] < len(mark):
                gap = int(mark[front[k] :].argmin())
                front[k] = front[k] + gap if not mark[front[k] + gap] else len(mark)
            if front[k] < len(mark):
                bound += factor * int(lists.impact[low + front[k] - 1])
        if bound < best.least:
            break
        at, step = at + step, 2 * step
    return int(seen.sum())


def _slices(batches: Iterator[pa.RecordBatch], number_of: dict[bytes, int]) -> Iterator[Slice]:
    part = Slice(number_of)
    for batch in batches:
        for id_, text in zip(batch.column(0), batch.column(1), strict=True):
            part.add(id_.as_py(), text.as_py())
            if part.words >= SLICE_WORDS:
                yield part
                part = Slice(number_of)
    if part.ids:
        yield part


def _item_blocks(items: DataFrame, item_col: str, text_col: str, block_terms: int) -> Iterator[list[tuple]]:
    """(item_id, text) of different items, in blocks of about ``block_terms`` words."""
    text = F.col(text_col).cast("string")
    rows = items.select(F.col(item_col).alias("item_id"), text.cast("binary").alias("item_text")).where("item_text is not null").distinct()
    rows = settled(rows, "items")
    words = rows.agg(F.sum(F.octet_length("item_text"))).first()[0] or 0  # a word has two bytes at least, with the blank
    blocks = words // (2 * block_terms) + 1
    for k in range(blocks):
        yield [(r.item_id, bytes(r.item_text)) for r in rows.where(F.pmod(F.xxhash64("item_id", "item_text"), F.lit(blocks)) == k).collect()]


def _ranked_block(docs: DataFrame, block: list[tuple], k: int) -> DataFrame:
    """item (place in the block), score and doc_id: the best of every task."""
    counts = [Counter(t for part in terms_of(text) for t in part) for _, text in block]
    number_of = {t: n for n, t in enumerate(sorted(set().union(*counts)), 1)}

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        documents, words, found = 0, 0, np.zeros(len(number_of) + 1, np.int64)
        for part in _slices(batches, number_of):
            documents, words = documents + len(part.ids), words + part.words
            found += np.bincount(part.postings()[0], minlength=len(found))
        held = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([[-1, -2], held])), pa.array(np.concatenate([[documents, words], found[held]]))], names=["term", "n"])

    stats = docs.mapInArrow(frequencies, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    number = {r.term: r.n for r in stats.collect()}  # one row for each term of the block at most
    documents, words = number.get(-1, 0), number.get(-2, 0)
    asked = [
        [(number_of[t], q * term_weight(documents, number[number_of[t]])) for t, q in count.items() if number_of[t] in number] for count in counts
    ]

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k) for _ in asked]
        for part in _slices(batches, number_of):
            lists = ImpactLists(part, documents, words)
            for factors, top in zip(asked, best, strict=True):
                search(lists, factors, top)
        for n, top in enumerate(best):
            if len(top.score):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(top.score), n)), pa.array(top.score), pa.array(top.id, mask=top.null)], names=["item", "score", "doc_id"])

    return docs.mapInArrow(rank, "item long, score long, doc_id long")


def top_documents(
    docs: DataFrame, items: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", block_terms: int = BLOCK_TERMS,
) -> DataFrame:
    """item_id, rank, doc_id, score: for every item its ``k`` documents of highest score above 0, equal ones by id.

    Terms are runs of ASCII letters, digits and characters beyond ASCII; only A to Z are lower-cased. The score is that of
    the module, all in whole numbers but for the logarithm.

    A null or blank text has no terms: such documents don't count, such items have no rows. Null ids come after all
    others. Every row is a document, repeated or not; items that repeat id and text are one, items with one id and
    different texts are ranked apart. An empty table gives no rows. Ids are whole numbers; other columns are not read.
    """
    ship_code(docs)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    out = None
    for number, block in enumerate(_item_blocks(items, item_col, item_text_col, block_terms)):
        names = _item_names(docs.sparkSession, items, item_col, block)
        found = _ranked_block(rows, block, k).withColumn("rank", F.row_number().over(
            Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last()))).where(F.col("rank") <= k)
        found = found.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
        out = found if out is None else out.unionByName(settled(found, f"ranked{number}"))
    return out


def _item_names(spark: SparkSession, items: DataFrame, item_col: str, block: list[tuple]) -> DataFrame:
    """item, item_id: the ids of a block of items."""
    kind = items.schema[item_col].dataType.simpleString()
    return spark.createDataFrame([(n, i) for n, (i, _) in enumerate(block)], f"item long, item_id {kind}")
