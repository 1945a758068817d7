"""Spelling variants: words one edit apart, by dynamic programming along the sorted vocabulary.

Two words one edit apart share at least half of the shorter one, as a common prefix or as a common suffix. So a word is
listed, as it is and reversed, by the half it would share with words as long as itself, one longer, and one shorter. A list
is sorted and scanned for each of its words: the edit matrix between the word and an entry has a band of three cells in a
row; the rows of the prefix that an entry has in common with the one before it (LCP) are used again, and as soon as all
cells of a row exceed one edit, all entries that share the prefix up to that row are skipped. Rows of the half that the
whole list shares are known beforehand. Reversed lists leave out the pairs that the list of the common prefix has.

What leaves a list is one row for each of its words, with the number of its near words and the best of them, never pairs.
A list of more than ``LIST_WORDS`` words is split by a hash into parts; each part of its words asks each part of its entries.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threatspark.llm.common import settled, ship_code

LEAST_LENGTH = 5
LEAST_COUNT = 3
NOISE = 97
LIST_WORDS = 50_000
_COUNTED = 200_000
_FAR = 2  # more than one edit

#: Bytes of Latin-1: A to Z to lower case, letters and U+00C0 to U+00FF as they are, all else to blanks.
_CLEAN = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Maximal runs of letters, in Latin-1. Characters beyond it separate, as all but letters do."""
    return (text or "").encode("latin-1", "replace").translate(_CLEAN).split()


def noisy_counts(doc_id: int | None, text: str | None, noise: int = NOISE) -> dict[bytes, int]:
    """The words of a document, some with one code point deleted, and how often they occur."""
    out: dict[bytes, int] = {}
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for word, n in Counter(words_of(text)).items():
        h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), start)
        if h % noise == 0:
            at = h % len(word)
            word = word[:at] + word[at + 1 :]
        out[word] = out.get(word, 0) + n
    return out


def vocabulary(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, noise: int = NOISE,
) -> DataFrame:
    """word, n: the words of at least ``least_length`` code points that occur ``least_count`` times in all documents."""

    def rows(found: dict[bytes, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([w.decode("latin-1") for w in found], pa.string()), pa.array(found.values(), pa.int64())], names=["word", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[bytes, int] = {}
        for batch in batches:
            for id_, text in zip(batch.column(0), batch.column(1), strict=True):
                for word, n in noisy_counts(id_.as_py(), (text.as_py() or b"").decode("utf-8", "replace"), noise).items():
                    if len(word) >= least_length:
                        found[word] = found.get(word, 0) + n
                if len(found) >= _COUNTED:
                    yield rows(found)
                    found.clear()
        yield rows(found)

    texts = ship_code(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    counted = texts.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= least_count)


class SortedList:
    """Words in order that share a prefix of ``shared`` characters, with the LCP of each with the one before."""

    def __init__(self, words: list[str], shared: int) -> None:
        self.words, self.shared = words, shared
        self.lcp = [shared] * len(words)
        for k in range(1, len(words)):
            self.lcp[k] = _common(words[k - 1], words[k], shared)

    def near(self, word: str, start: int = 0) -> Iterator[int]:
        """The entries from ``start`` on at one edit from ``word``, which shares the prefix, too."""
        words, lcp, shared, size = self.words, self.lcp, self.shared, len(word)
        # rows[d]: edits between the first d characters of an entry and the first d - 1, d, d + 1 of the word
        rows = [(1, 0, 1)] * (shared + 1)
        known, at, end = shared, start, len(words)
        while at < end:
            entry = words[at]
            depth = known
            less, same, more = rows[depth]
            while depth < len(entry):
                c = entry[depth]
                depth += 1
                # cells of row d stand for prefixes d - 1, d, d + 1 of the word; beyond its end they are far
                a = min(same + 1, less + (depth < 2 or c != word[depth - 2])) if depth <= size + 1 else _FAR
                b = min(more + 1, a + 1, same + (c != word[depth - 1])) if depth <= size else _FAR
                more = min(b + 1, more + (c != word[depth])) if depth < size else _FAR
                less, same = a, b
                if depth < len(rows):
                    rows[depth] = (less, same, more)
                else:
                    rows.append((less, same, more))
                if less > 1 and same > 1 and more > 1:
                    break
            else:
                gap = size - depth
                if -1 <= gap <= 1 and (less, same, more)[gap + 1] == 1:
                    yield at
            # the rows up to the common prefix stay; a far row ends all entries that share it
            dead = less > 1 and same > 1 and more > 1
            at += 1
            known = depth
            while at < end:
                known = min(known, lcp[at])
                if not dead or known < depth:
                    break
                at += 1


def _common(a: str, b: str, start: int) -> int:
    n = min(len(a), len(b))
    while start < n and a[start] == b[start]:
        start += 1
    return start


class _List:
    """Finds near words in one list and folds them to a row for each word."""

    def __init__(self, short: int, longer: int, back: int) -> None:
        self.short, self.longer, self.back = short, longer, back
        self.shared = (short + longer) // 2
        self.entries: list[tuple[str, int]] = []
        self.asking: list[tuple[str, int]] = []
        self.found: dict[str, tuple[int, int, str]] = {}

    def _near(self, word: str, other: str, n: int) -> None:
        count, best, best_word = self.found.get(word, (0, 0, ""))
        if n > best or n == best and other < best_word:
            best, best_word = n, other
        self.found[word] = (count + 1, best, best_word)

    def rows(self) -> dict[str, tuple[int, int, str]]:
        own = {w: w[::-1] if self.back else w for w, _ in [*self.entries, *self.asking]}
        n_of = dict(self.entries)
        if self.longer:
            entries = SortedList([w for w, _ in self.entries if len(w) > self.short], self.shared)
            asking = [(w, n, 0) for w, n in self.asking if len(w) == self.short]
        else:
            entries = SortedList([w for w, _ in self.entries], self.shared)
            later, asking = 0, []
            for w, n in self.asking:  # both in order: only entries after the word, so that a pair is met once
                while later < len(entries.words) and entries.words[later] <= w:
                    later += 1
                asking.append((w, n, later))
        for word, n, start in asking:
            for k in entries.near(word, start):
                other = entries.words[k]
                if self.back and _common(own[word], own[other], 0) >= self.shared:
                    continue  # the list of the common prefix has this pair
                self._near(own[word], own[other], n_of[other])
                self._near(own[other], own[word], n)
        return self.found


def _lists(word: Column) -> Column:
    """The lists of a word: (short, longer, back, half, entry): by the length of the shorter word of a pair, whether the other
    is longer, whether words are reversed, and a hash of the half that the list shares."""
    length, backward = F.length(word), F.reverse(word)
    out = []
    for back, entry in ((0, word), (1, backward)):
        for less, longer in ((0, 0), (0, 1), (1, 1)):
            short = length - less
            half = F.xxhash64(F.substring(entry, F.lit(1), F.floor((short + longer) / 2).cast("int")))
            out.append(F.struct(short.alias("short"), F.lit(longer).alias("longer"), F.lit(back).alias("back"), half.alias("half"), entry.alias("entry")))
    return F.array(*out)


def near_words(words: DataFrame, list_words: int = LIST_WORDS) -> DataFrame:
    """word, n_near, best_n, best: for each word of (word, n) that has words one edit apart: how many, and of those of largest
    n the first by code point. Words of three characters at least."""
    ship_code(words)
    key = ["short", "longer", "back", "half"]
    listed = words.select("n", F.explode(_lists(F.col("word"))).alias("l")).select("l.*", "n")
    sizes = listed.groupBy(*key).agg(F.count("*").alias("size"))
    large = settled(sizes.where(F.col("size") > list_words), "large-lists")
    rows = listed.withColumns({"part": F.lit(0), "entry_of": F.lit(True), "asks": F.lit(True)})
    if not large.isEmpty():
        # every part of the entries meets every part of the words that ask
        parts = F.ceil(F.col("size") / list_words).cast("int")
        split = listed.join(large, key).withColumn("parts", parts).withColumn("own", F.pmod(F.xxhash64("entry"), "parts").cast("int"))
        split = split.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        columns = lambda part, entry_of: [*key, "n", "entry", part.alias("part"), F.lit(entry_of).alias("entry_of"), F.lit(not entry_of).alias("asks")]
        entries = split.select(*columns(F.col("own") * F.col("parts") + F.col("other"), True))
        asking = split.select(*columns(F.col("other") * F.col("parts") + F.col("own"), False))
        rows = rows.join(large.select(*key), key, "left_anti").select(*entries.columns).unionByName(entries).unionByName(asking)
    order = [*key, "part"]
    sorted_ = rows.select(*order, "entry", "n", "entry_of", "asks").repartition(*order).sortWithinPartitions(*order, "entry")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, current = None, None

        def closed(done: _List | None) -> Iterator[pa.RecordBatch]:
            found = done.rows() if done and (len(done.entries) > 1 or done.entries != done.asking) else {}
            if found:
                count, n, best = zip(*found.values(), strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found, pa.string()), pa.array(count, pa.int64()), pa.array(n, pa.int64()), pa.array(best, pa.string())],
                    names=["word", "n_near", "best_n", "best"])

        for batch in batches:
            short, longer, back, half, part, entry, n, entry_of, asks = (c.to_pylist() for c in batch.columns)
            for k, word in enumerate(entry):
                # different halves may share a hash
                own = (short[k], longer[k], back[k], half[k], part[k], word[: (short[k] + longer[k]) // 2])
                if own != here:
                    yield from closed(current)
                    here, current = own, _List(short[k], longer[k], back[k])
                if entry_of[k]:
                    current.entries.append((word, n[k]))
                if asks[k]:
                    current.asking.append((word, n[k]))
        yield from closed(current)

    return _folded(sorted_.mapInArrow(scan, "word string, n_near long, best_n long, best string"))


def _folded(found: DataFrame) -> DataFrame:
    """One row per word: of the best words of its lists the one of largest n, then the first."""
    best = F.min_by(F.struct("best_n", "best"), F.struct(-F.col("best_n"), F.col("best")))
    rows = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b"))
    return rows.select("word", "n_near", F.col("b.best_n").alias("best_n"), F.col("b.best").alias("best"))


def spelling_variants(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT,
    noise: int = NOISE, list_words: int = LIST_WORDS,
) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n.

    The words are those of :func:`vocabulary`. ``form`` is the near word of largest n (of equals the first by code point), if
    that n is at least twice the word's, else null; ``root`` the last word met by following the forms, the word itself
    without one.

    A null text has no words, a null id counts as empty in the noise. Every row is a document, repeated or not. An empty
    table gives no rows; other columns are not read.
    """
    words = settled(vocabulary(docs, id_col, text_col, least_length, least_count, noise), "vocabulary")
    near = settled(near_words(words, list_words), "near").withColumnRenamed("word", "near_word")
    is_form = F.col("best_n") >= 2 * F.col("n")
    joined = words.join(near, F.col("word") == F.col("near_word"), "left").select(
        "word", F.when(is_form, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(is_form, F.col("best_n")).alias("form_n"))
    formed = settled(joined, "forms")
    # n at least doubles from word to form, so there are no circles; a round doubles the length of the way followed
    roots = formed.select("word", F.coalesce("form", "word").alias("root"))
    while True:
        ahead = roots.select(F.col("word").alias("via"), F.col("root").alias("further"))
        stepped = roots.join(ahead.where("via <> further"), F.col("root") == F.col("via"), "left")
        roots = settled(stepped.select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        moved = not roots.where("moved").isEmpty()
        roots = roots.select("word", "root")
        if not moved:
            break
    ends = roots.select(F.col("word").alias("root_of"), "root")
    return formed.join(ends, F.col("word") == F.col("root_of")).select("word", "form", "root", "n", "n_near", "form_n")
