"""SentencePiece encoding of merge-type models by backtracking, and decoding.

A sequence of pieces is what the merges give exactly if each two neighbours are: merging their joint text again ends in
these two pieces. So a text is covered from left to right by the longest pieces that are compatible with their left
neighbour; where none fits, the position is marked in a bit field as failed and the piece before it is shortened. The
longest matches of all positions come from one run of an Aho-Corasick automaton over the pieces.

No piece of such a model goes on over a blank mark that follows another character, or from letters to other characters, so
texts are encoded run by run and the runs met before are looked up in a bounded cache. (If a model has such pieces, longer
runs or whole texts are encoded.)
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threatspark.llm.common import WorkerCache, ship_code

MARK = "▁"
CACHED_RUNS = 400_000
SLICE_CHARS = 1_000_000


class _Runs(WorkerCache):
    """Ids of the runs met lately: two generations of half of CACHED_RUNS each; long runs are not held."""

    def __init__(self, encode: Callable[[str], bytes]) -> None:
        self.encode, self.old = encode, {}

    def __missing__(self, run: str) -> bytes:
        ids = self.old.get(run)
        if ids is None:
            ids = self.encode(run)
        if len(run) <= 64:
            if len(self) >= CACHED_RUNS // 2:
                old = dict(self)
                self.clear()
                self.old = old
            self[run] = ids
        return ids

    def clear(self) -> None:
        self.old = {}
        super().clear()


class PieceEncoder:
    """Encodes with the pieces and scores of a byte-fallback merge model that leaves texts as they are."""

    def __init__(self, model: bytes) -> None:
        self.library = lib = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = lib.get_piece_size()
        special = {i for i in range(size) if lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i)}
        self.bytes = {int(lib.id_to_piece(i)[3:5], 16): i for i in special if lib.is_byte(i)}
        if len(self.bytes) != 256 or lib.decode(lib.encode("ａ  a ")) != "ａ  a ":
            raise ValueError("a model with byte fallback and identity normalisation is needed")
        self.text = {i: lib.id_to_piece(i) for i in range(size) if i not in special}
        self.score = {t: lib.get_score(i) for i, t in self.text.items()}
        self.number = {t: i for i, t in self.text.items()}
        self.known = set("".join(self.score))
        self.fits: dict[tuple[int, int], bool] = {}
        self.last: dict[str, tuple[str, str]] = {}  # the two pieces whose merge makes a piece
        self.ordered: set[str] = set()  # pieces made of merges that never get better on the way
        self.automaton = ahocorasick.Automaton()
        for t in sorted(self.number, key=len):
            parts = self.merged(t, 2)
            if len(t) == 1 or len(parts) == 2 and "".join(parts) in self.score and self.merged(t) == [t]:
                self.automaton.add_word(t, (len(t) - 1, self.number[t]))  # other pieces are never the outcome of merges
                if len(t) == 1:
                    self.ordered.add(t)
                else:
                    self.last[t] = (parts[0], parts[1])
                    if all(p in self.ordered and (len(p) == 1 or self.score[p] >= self.score[t]) for p in parts):
                        self.ordered.add(t)
        self.automaton.make_automaton()
        self.size = {i: len(t) for i, t in self.text.items()}
        self.shorter = {}  # the longest piece that a piece begins with
        for t, i in self.number.items():
            parts = (t[:k] for k in range(len(t) - 1, 0, -1))
            self.shorter[i] = next((self.number[x] for x in parts if x in self.automaton), -1)
        crossing = any(MARK in t.lstrip(MARK) for t in self.score)
        breaks = "".join(c for c in "\n\t\r" if c not in self.known)
        letter = re.compile(rf"[^\W\d_{MARK}]")
        mixed = any(MARK not in a + b and bool(letter.match(a)) != bool(letter.match(b)) for t in self.score for a, b in zip(t, t[1:], strict=False))
        # runs are cut with blanks in place of marks: such texts and keys take less room
        word = rf" *[^ {breaks}]+" if mixed else rf" *[^\W\d_]+| *(?:(?![^\W\d_])[^ {breaks}])+"
        self.runs = None if crossing else re.compile(rf"{word}| +" + (f"|[{breaks}]" if breaks else ""))
        self.cache = _Runs(self.run)

    def merged(self, text: str, least: int = 1) -> list[str]:
        """The pieces of a short known text by plain merging, best score first, then leftmost, down to ``least`` pieces."""
        parts, score = list(text), self.score
        while len(parts) > least:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the joint text of two pieces again leaves these two."""
        a, b = self.text[left], self.text[right]
        if len(self.fits) > CACHED_RUNS:
            self.fits.clear()
        plain = a not in self.ordered or b not in self.ordered
        found = self.fits[left, right] = self.merged(a + b) == [a, b] if plain else self._apart(a, b)
        return found

    def _apart(self, left: str, right: str) -> bool:
        """Takes the merges back from the last to the first and looks whether the boundary would have been merged instead.

        Of the two pieces at the boundary the one with the worse score, and of equal ones the right one, was made later.
        A joint piece wins over the merge taken back before (``until``) by a better score, or by an equal one if that merge
        lies to the right.
        """
        score, last, until, right_of = self.score, self.last, float("-inf"), True
        while True:
            joint = score.get(left + right)
            if joint is not None and (joint > until or joint == until and right_of):
                return False
            a, b = (score[x] if len(x) > 1 else float("inf") for x in (left, right))
            if a == b == float("inf"):
                return True
            if b <= a:
                until, right_of, right = b, True, last[right][0]
            else:
                until, right_of, left = a, False, last[left][1]

    def backtrack(self, text: str) -> list[int]:
        """The pieces of a text of known characters."""
        n = len(text)
        longest = [0] * n
        for end, (before, piece) in self.automaton.iter(text):
            longest[end - before] = piece  # of one start the longest comes last, as its end does
        failed = bytearray(n // 8 + 1)
        pieces: list[int] = []
        fits, size, shorter = self.fits, self.size, self.shorter
        at, piece, left = 0, longest[0], -1
        while True:
            while piece >= 0:
                end = at + size[piece]
                if not failed[end >> 3] >> (end & 7) & 1:
                    if left < 0:
                        break
                    fit = fits.get((left, piece))
                    if fit or fit is None and self.compatible(left, piece):
                        break
                piece = shorter[piece]
            if piece >= 0:
                pieces.append(piece)
                if end == n:
                    return pieces
                at, left = end, piece
                piece = longest[at]
            else:
                failed[at >> 3] |= 1 << (at & 7)
                piece = pieces.pop()
                at -= size[piece]
                piece = shorter[piece]
                left = pieces[-1] if pieces else -1

    def run(self, text: str) -> bytes:
        """The ids of one run as int32 bytes; characters without a piece become their UTF-8 bytes."""
        text = text.replace(" ", MARK)
        if self.known.issuperset(text):
            return array("i", self.backtrack(text)).tobytes()
        ids: list[int] = []
        low = 0
        for k, c in enumerate(text):
            if c not in self.known:
                if k > low:
                    ids += self.backtrack(text[low:k])
                ids += [self.bytes[b] for b in c.encode("utf-8", "surrogatepass")]
                low = k + 1
        if low < len(text):
            ids += self.backtrack(text[low:])
        return array("i", ids).tobytes()

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, np.int32)
        text = " " + text.replace(MARK, " ")  # a mark in the text is a blank to the model
        if self.runs is None:
            return np.frombuffer(self.run(text), np.int32)
        return np.frombuffer(b"".join(map(self.cache.__getitem__, self.runs.findall(text))), np.int32)

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.library.decode(ids)


@lru_cache(maxsize=2)
def encoder_of(model: bytes) -> PieceEncoder:
    """One encoder for each worker process, so that its caches live from task to task."""
    return PieceEncoder(model)


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Row ranges of about SLICE_CHARS, one row at least."""
    sizes = texts.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(sizes.buffers()[1], np.int64)[sizes.offset : sizes.offset + len(sizes) + 1]
    low = 0
    while low < len(texts):
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + SLICE_CHARS, "right")) - 1)
        yield low, high
        low = high


def encode_and_decode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """One row per document: doc_id, ids (array<int>), decoded, and the columns named in ``keep``.

    Null and empty texts have no ids and decode to the empty text. Nulls and repeats in ``id_col`` pass through; an empty
    table gives no rows; other columns are not read. The driver reads the model file (half a megabyte) and sends its bytes
    with the tasks.
    """
    with open(model_path, "rb") as f:
        model = f.read()
    keep = list(keep or [])
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string"), *keep).toDF("doc_id", "text", *[f"c{k}" for k in range(len(keep))])
    schema = T.StructType([
        T.StructField("doc_id", rows.schema["doc_id"].dataType), T.StructField("ids", T.ArrayType(T.IntegerType())),
        T.StructField("decoded", T.StringType()), *[T.StructField(x.name, x.dataType) for x in rows.schema.fields[2:]],
    ])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(model)
        encoder.cache.begin()
        for batch in batches:
            for low, high in _slices(batch.column(1)):
                part = batch.slice(low, high - low)
                found = [encoder.encode(t) for t in part.column(1).to_pylist()]
                offsets = np.zeros(len(found) + 1, np.int32)
                np.cumsum([len(x) for x in found], out=offsets[1:])
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found)))
                decoded = encoder.decode([x.tolist() for x in found])
                columns = [part.column(0), ids, pa.array(decoded, pa.string()), *part.columns[2:]]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return ship_code(rows).mapInArrow(work, schema).toDF("doc_id", "ids", "decoded", *keep)
