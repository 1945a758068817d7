"""Repeated passages by relative Lempel-Ziv parsing against reference blocks that anchors route to.

Parsing every document against every block of the corpus would be quadratic, so anchors decide what meets. The windows of
``window`` words of a document are grouped by their anchor, the word ``ANCHOR``-gram with the smallest hash in the window
(leftmost of equals); a phrase is the text below the windows of one anchor. Equal windows have equal anchors at equal places,
so a window can only repeat where its anchor does.

1. Whole phrases. Each task cuts its documents into phrases and looks them up among its own first; those met before there
   are factors already and are joined to longer ones. Only the first of each kind goes on, so that a phrase repeated in a
   third of all documents sends one row for each slice of documents, not for each document. Phrases then meet by anchor: one
   whose (anchor, text, length) was met earlier in the corpus is a factor as a whole.
2. Reference blocks. What is left to parse are new phrases whose anchor also stands in other phrases. They are sent, with
   their words, to the block of their anchor, a part of a shuffle by anchor, sorted by their place in the corpus. The block is
   indexed by the grams that begin at each place beside the anchor, and every phrase is factored greedily against all
   earlier ones: at the first place where ``window`` words are known, the longest match is taken as a factor.
3. Factor boundaries. After a factor, the windows that reach beyond its end are looked up one by one, and the next one that
   is known begins the next factor; so no window at the edge of a factor is missed.

What a factor covers is removed. Phrases and grams are compared by 64-bit hashes together with the words' own (whole phrases
by two independent ones, that of the anchor and that of the text).

Anchors that a sample shows in more than ``HOT_DOCS`` documents (a common line with other text around it) would fill one
block. Their phrases are sent window by window, each to the place of its own hash, where only its first occurrence counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threatspark.llm.common import WorkerCache, settled, ship_code

WINDOW = 20
ANCHOR = 10
SLICE_WORDS = 1_000_000
CACHED_WORDS = 200_000
HOT_DOCS = 200_000
#: One document in so many is looked at to find anchors of more than HOT_DOCS; the results don't depend on it.
SAMPLED = 64
BLOCK_ROWS = 50_000
_M1, _M2 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_LAST = (1 << 63) - 1


class _WordHashes(WorkerCache):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(self) >= CACHED_WORDS:
            self.clear()
        if len(word) <= 64:
            self[word] = h
        return h


_HASHES = _WordHashes()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _spans_hash(words: np.ndarray, starts: np.ndarray, sizes: np.ndarray, factor: int) -> np.ndarray:
    """Polynomial hashes of words[start : start + size], independent of where they stand."""
    powers = np.ones(len(words) + 1, np.uint64)
    powers[1:] = np.cumprod(np.full(len(words), factor, np.uint64))
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * powers[:-1], out=sums[1:])
    back = np.ones(len(words) + 1, np.uint64)
    back[1:] = np.cumprod(np.full(len(words), pow(factor, -1, 1 << 64), np.uint64))
    return _mixed((sums[starts + sizes] - sums[starts]) * back[starts] + sizes.astype(np.uint64))


class _Slice:
    """Some documents with the hashes of all their words on one line."""

    def __init__(self, keys: list[tuple[int, int]], words: list[list[bytes]]) -> None:
        self.doc = np.array([k[0] for k in keys], np.int64)
        self.tag = np.array([k[1] for k in keys], np.int32)
        sizes = np.array([len(w) for w in words], np.int64)
        self.low = np.concatenate([[0], np.cumsum(sizes)])
        self.hashes = np.fromiter((h for w in words for h in map(_HASHES.__getitem__, w)), np.uint64, int(self.low[-1]))
        self.of = np.repeat(np.arange(len(words)), sizes)

    def windows(self, window: int) -> np.ndarray:
        """Starts of all windows that lie within one document."""
        if len(self.hashes) < window:
            return np.empty(0, np.int64)
        starts = np.arange(len(self.hashes) - window + 1)
        return starts[self.of[starts] == self.of[starts + window - 1]]

    def phrases(self, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """start, number of windows, hash of the anchor, hash of the text and place of the anchor of every phrase."""
        at = self.windows(window)
        gram = min(ANCHOR, window)
        if not len(at):
            none = np.empty(0, np.int64)
            return none, none, none.view(np.uint64), none.view(np.uint64), none
        grams = np.zeros(len(self.hashes) - gram + 1, np.uint64)
        for k in range(gram):
            grams = grams * np.uint64(_M1) + self.hashes[k : k + len(grams)]
        grams = _mixed(grams)
        best, place = grams[at], at.copy()
        for k in range(1, window - gram + 1):
            other = grams[at + k]
            less = other < best
            best = np.where(less, other, best)
            place[less] = at[less] + k
        new = np.ones(len(at), bool)
        new[1:] = (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1) | (self.of[at[1:]] != self.of[at[:-1]])
        first = np.flatnonzero(new)
        n = np.diff(np.append(first, len(at)))
        start = at[first]
        return start, n, best[first], _spans_hash(self.hashes, start, n + window - 1, _M2), place[first]

    def windows_of(self, start: np.ndarray, n: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
        """The windows of some phrases, each as a phrase of its own: start, 1, two hashes of the text, and the start again."""
        starts = np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())
        size = np.full(len(starts), window, np.int64)
        return starts, np.ones(len(starts), np.int64), _spans_hash(self.hashes, starts, size, _M1), _spans_hash(self.hashes, starts, size, _M2), starts

    def rows(self, start: np.ndarray, n: np.ndarray, h: np.ndarray, text: np.ndarray, place_: np.ndarray) -> pa.RecordBatch:
        """Phrases (or windows) not met before in this slice, and with n below zero the runs of those that were.

        The upper half of n is the distance of the anchor from the start, which is the same wherever the text is.
        """
        packed = n | (place_ - start) << 16
        own = self.of[start]
        place = start - self.low[own]
        doc, tag = self.doc[own], self.tag[own]
        order = np.lexsort((place, tag, doc, n, text, h))
        same = np.zeros(len(order), bool)
        a, b = order[1:], order[:-1]
        same[1:] = (h[a] == h[b]) & (text[a] == text[b]) & (n[a] == n[b])
        first = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))]
        known = np.zeros(len(order), bool)
        known[order] = (doc[order] != doc[first]) | (tag[order] != tag[first]) | (place[order] != place[first])
        go = np.flatnonzero(~known)
        hit = np.flatnonzero(known)
        end = start[hit] + n[hit]
        joined = np.zeros(len(hit), bool)
        joined[1:] = (start[hit][1:] == end[:-1]) & (own[hit][1:] == own[hit][:-1])
        heads = np.flatnonzero(~joined)
        lows = hit[heads]
        sizes = (end[np.append(heads[1:], len(hit)) - 1] - start[lows]) if len(heads) else np.empty(0, np.int64)
        spread = _mixed(doc[lows].view(np.uint64) * np.uint64(_M1) + place[lows].view(np.uint64))
        cat = np.concatenate
        return pa.RecordBatch.from_arrays([
            pa.array(cat([h[go], spread]).view(np.int64)), pa.array(cat([text[go], np.zeros(len(lows), np.uint64)]).view(np.int64)),
            pa.array(cat([doc[go], doc[lows]])), pa.array(cat([tag[go], tag[lows]])),
            pa.array(cat([place[go], place[lows]])), pa.array(cat([packed[go], -sizes]).astype(np.int32)),
        ], names=["h", "text", "doc", "tag", "at", "n"])


_ROWS = T.StructType([
    T.StructField("h", T.LongType()), T.StructField("text", T.LongType()), T.StructField("doc", T.LongType()),
    T.StructField("tag", T.IntegerType()), T.StructField("at", T.LongType()), T.StructField("n", T.IntegerType()),
])


_SEGMENTS = T.StructType([
    T.StructField("h", T.LongType()), T.StructField("doc", T.LongType()), T.StructField("tag", T.IntegerType()), T.StructField("at", T.LongType()),
    T.StructField("n", T.IntegerType()), T.StructField("lead", T.IntegerType()), T.StructField("words", T.BinaryType()),
])
_FACTORS = T.StructType([_SEGMENTS[n] for n in ("doc", "tag", "at", "n")])


def _slices(batches: Iterator[pa.RecordBatch], extra: bool = False) -> Iterator[tuple[list, list, list]]:
    """Keys, words and spans of about SLICE_WORDS, cut between documents."""
    _HASHES.begin()
    keys, words, spans, total = [], [], [], 0
    for batch in batches:
        for k in range(batch.num_rows):
            text = batch.column(2)[k].as_py().split()
            keys.append((batch.column(0)[k].as_py(), batch.column(1)[k].as_py()))
            words.append(text)
            if extra:
                found = batch.column(3)[k].values
                spans.append(np.stack([found.field(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("at", "n", "h", "lead")]))
            total += len(text)
            if total >= SLICE_WORDS:
                yield keys, words, spans
                keys, words, spans, total = [], [], [], 0
    if keys:
        yield keys, words, spans


def segments(part: _Slice, start: np.ndarray, n: np.ndarray, h: np.ndarray, lead: np.ndarray, window: int) -> pa.RecordBatch:
    """Phrases with the hashes of their words, in a line on which the anchor has a fixed place."""
    gram = min(ANCHOR, window)
    left = window - gram
    place = start + lead
    line = place[:, None] - left + np.arange(2 * left + gram)
    inside = (line >= start[:, None]) & (line < (start + n + window - 1)[:, None])
    words = np.where(inside, part.hashes[np.clip(line, 0, len(part.hashes) - 1)], np.uint64(0)) if len(start) else np.empty((0, 2 * left + gram), np.uint64)
    own = part.of[start]
    size = 8 * words.shape[1]
    data = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer((np.arange(len(start) + 1) * size).astype(np.int32)), pa.py_buffer(words.tobytes())])
    return pa.RecordBatch.from_arrays([
        pa.array(h), pa.array(part.doc[own]), pa.array(part.tag[own]), pa.array(start - part.low[own]), pa.array(n.astype(np.int32)),
        pa.array((place - start).astype(np.int32)), data], names=_SEGMENTS.names)


def factors(h: np.ndarray, n: np.ndarray, lead: np.ndarray, words: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Greedy factors of the phrases of a block against the earlier ones with the same anchor: row, first window, windows.

    Rows are in the order of the corpus; ``words`` is a line for each, on which the anchor begins at ``window`` less its size.
    """
    size = words.shape[1]
    left = size - window
    low = left - lead  # where the phrase begins on its line, and where it ends
    high = low + n + window - 1
    powers = np.cumprod(np.full(size + 1, _M1, np.uint64))
    sums = np.zeros((len(h), size + 1), np.uint64)
    np.cumsum(words * powers[:size], axis=1, out=sums[:, 1:])

    own = _mixed(h)

    def known(at: int, length: int, rows: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the rows, which all have the gram: those asked for in which it isn't the first of its kind, and all of their kinds."""
        key = _mixed(sums[rows, at + length] - sums[rows, at]) ^ own[rows]
        order = np.argsort(key, kind="stable")
        new = np.append(True, key[order][1:] != key[order][:-1])
        kind = np.cumsum(new) - 1
        hits = ~new & asked[rows[order]]
        of_kind = np.zeros(kind[-1] + 1, bool)
        of_kind[kind[hits]] = True
        return rows[order[hits]], np.sort(rows[order[of_kind[kind]]])

    found, cursor = [], low.copy()
    for at in range(left + 1):
        have = np.flatnonzero((low <= at) & (high >= at + window))
        # windows within a factor are known with it; the others are looked up
        active, pool = known(at, window, have, cursor <= at) if len(have) else (have, have)
        length, longer, growing = np.full(len(h), window), window, active
        while len(growing):  # the longest match: the gram is made longer as long as an earlier phrase has it
            longer += 1
            pool = pool[high[pool] >= at + longer]
            if not len(pool):
                break
            asked = np.zeros(len(h), bool)
            asked[growing] = True
            growing, pool = known(at, longer, pool, asked)
            length[growing] = longer
        active = np.sort(active)
        windows = length[active] - window + 1
        cursor[active] = at + windows
        found.append((active, at - low[active], windows))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _known_earlier(rows: DataFrame) -> DataFrame:
    """doc, tag, at, n, h, lead, kind: 1 for factors, 2 for new phrases whose anchor stands in several kinds."""
    order = ["doc", "tag", "at"]
    anchor = Window.partitionBy("h").orderBy("text", "n", *order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = [f("text").over(anchor) for f in (F.first, F.last)] + [f("n").over(anchor) for f in (F.first, F.last)]
    rows = rows.withColumn("several", (ends[0] != ends[1]) | (ends[2] != ends[3]))
    kind = Window.partitionBy("h", "text", "n").orderBy(*order)
    doc, tag, at = (F.first(c).over(kind) for c in order)
    later = (F.col("tag") > tag) | ((F.col("tag") == tag) & (F.col("at") > at))
    rows = rows.withColumn("earlier", (F.col("doc") > doc) | ((F.col("doc") == doc) & later))
    found = F.when((F.col("n") < 0) | F.col("earlier"), 1).when(F.col("several"), 2)
    n = F.when(F.col("n") < 0, -F.col("n")).otherwise(F.col("n").bitwiseAND(0xFFFF))
    return rows.select("doc", "tag", "at", n.alias("n"), "h", F.shiftright("n", 16).alias("lead"), found.alias("kind")).where("kind is not null")


def _hot_anchors(keyed: DataFrame, window: int) -> np.ndarray:
    """Hashes of the anchors that, by a sample of the documents, stand in more than HOT_DOCS: a short list."""

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, words, _ in _slices(batches):
            part = _Slice(keys, words)
            start, _, h, _, _ = part.phrases(window)
            h, n = np.unique(np.unique(np.stack([h, part.of[start].astype(np.uint64)]), axis=1)[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["h", "n"])

    sample = keyed.where(F.pmod(F.xxhash64("doc", "tag"), F.lit(SAMPLED)) == 0).select("doc", "tag", "text")
    counts = sample.mapInArrow(anchors, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    hot = counts.where(F.col("n") * SAMPLED > HOT_DOCS).select("h").collect()
    return np.sort(np.array([r.h for r in hot], np.int64).view(np.uint64))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of about BLOCK_ROWS, with all rows of an anchor together."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        h = batch.column(0).to_numpy()
        if size >= BLOCK_ROWS:
            last = held[-1].column(0)[-1].as_py()
            cut = int(np.argmax(h != last)) if (h != last).any() else len(h)
            held.append(batch.slice(0, cut))
            batch = batch.slice(cut)
            if batch.num_rows:
                yield pa.concat_batches(held)
                held, size = [], 0
        if batch.num_rows:
            held.append(batch)
            size += batch.num_rows
    if held:
        yield pa.concat_batches(held)


def _by_document(spans: DataFrame, *columns: str) -> DataFrame:
    """The spans of each document in one list, which the length of the document bounds."""
    return spans.groupBy(F.col("doc").alias("_doc"), F.col("tag").alias("_tag")).agg(F.collect_list(F.struct(*columns)).alias("_spans"))


def without_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_text (kept words joined by a blank), factors (first word, words).

    Words are separated by blank and 0x09 to 0x0D and compared unchanged. A word is removed if a window of ``window`` words
    covers it whose words also start earlier: in a document with a smaller id, or earlier in its own. Windows are judged on
    the input, not on what is left.

    Null text has no words. Rows with a null id come after all others. Rows that repeat an id with another text are ordered
    by a hash of the text; rows that repeat id and text are one document, each gets its row. An empty table gives no rows;
    other columns are not read.
    """
    ship_code(docs)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("doc"), F.hash(text).alias("tag"), text.cast("binary").alias("text"),
        F.col(id_col).alias("doc_id"))

    hot = _hot_anchors(keyed, window)

    def phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, words, _ in _slices(batches):
            part = _Slice(keys, words)
            rows = part.phrases(window)
            if len(hot):
                many = np.isin(rows[2], hot)
                alone = part.windows_of(rows[0][many], rows[1][many], window)
                rows = tuple(np.concatenate([a[~many], b]) for a, b in zip(rows, alone, strict=True))
                order = np.argsort(rows[0], kind="stable")
                rows = tuple(x[order] for x in rows)
            yield part.rows(*rows)

    def to_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, words, spans in _slices(batches, True):
            part = _Slice(keys, words)
            at, n, h, lead = np.concatenate(spans, axis=1)
            low = np.repeat(part.low[:-1], [s.shape[1] for s in spans])
            yield segments(part, at + low, n, h, lead, window)

    def factored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            # rows that repeat a document are one
            place = np.stack([block.column(k).to_numpy().astype(np.int64) for k in range(4)])
            block = block.filter(pa.array(np.append(True, (place[:, 1:] != place[:, :-1]).any(axis=0))))
            h, n, lead = (block.column(k).to_numpy() for k in (0, 4, 5))
            words = np.frombuffer(b"".join(block.column(6).to_pylist()), np.uint64).reshape(len(h), -1)
            row, first, windows = factors(h.view(np.uint64), n, lead, words, window)
            yield pa.RecordBatch.from_arrays([
                block.column(1).take(pa.array(row)), block.column(2).take(pa.array(row)), pa.array(block.column(3).to_numpy()[row] + first),
                pa.array(windows.astype(np.int32))], names=_FACTORS.names)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, removed, kept, factors = [], [], [], []
            for k in range(batch.num_rows):
                here = batch.column(1)[k].as_py().split()
                spans = batch.column(2)[k].as_py() or []
                marks = np.zeros(len(here) + 1, np.int64)
                if spans:
                    at = np.array([x["at"] for x in spans])
                    np.add.at(marks, at, 1)
                    np.add.at(marks, at + np.array([x["n"] for x in spans]) - 1 + window, -1)
                gone = np.cumsum(marks[:-1]) > 0
                edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
                factors.append([{"first": int(a), "words": int(b - a)} for a, b in edges.reshape(-1, 2)])
                words.append(len(here))
                removed.append(int(gone.sum()))
                kept.append(b" ".join([w for w, g in zip(here, gone.tolist(), strict=True) if not g] if removed[-1] else here))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(words, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()),
                pa.array(factors, pa.list_(pa.struct([("first", pa.int32()), ("words", pa.int32())]))),
            ], names=["doc_id", "n_words", "n_removed", "kept", "factors"])

    found = settled(_known_earlier(keyed.select("doc", "tag", "text").mapInArrow(phrases, _ROWS)), "factors")
    by_doc = ["doc", "tag", "text", "doc_id"]
    edges = _by_document(found.where("kind = 2"), "at", "n", "h", "lead")
    touched = keyed.select(*by_doc).join(edges, (F.col("doc") == F.col("_doc")) & (F.col("tag") == F.col("_tag")))
    routed = touched.select("doc", "tag", "text", "_spans").mapInArrow(to_blocks, _SEGMENTS)
    parsed = routed.repartition("h").sortWithinPartitions("h", "doc", "tag", "at").mapInArrow(factored, _FACTORS)
    spans = _by_document(found.where("kind = 1").select("doc", "tag", "at", "n").unionByName(parsed), "at", "n")
    marked = keyed.select(*by_doc).join(spans, (F.col("doc") == F.col("_doc")) & (F.col("tag") == F.col("_tag")), "left")
    schema = T.StructType([
        T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()),
        T.StructField("kept", T.BinaryType()),
        T.StructField("factors", T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("words", T.IntegerType())]))),
    ])
    out = marked.select("doc_id", "text", "_spans").mapInArrow(keep, schema)
    return out.select("doc_id", "n_words", "n_removed", F.col("kept").cast("string").alias("kept_text"), "factors")
