"""Language identification in two steps: the family, then one-versus-one linear support vector machines within it.

Features are hashed byte trigrams of the lower-cased text, square roots of their counts, scaled to length 1. The machines
are fitted on a bounded sample (about ``SAMPLE_DOCS`` of each language, by a hash of the id, and as many of each family), all
at once: the rows of a pair are a group of one grouped map, at most about two samples, whatever the number of languages.
Families vote among each other in the same way: one machine for each pair of families.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threatspark.llm.common import settled, ship_code

BITS = 12
SAMPLE_DOCS = 500
COST, EPOCHS = 10.0, 30
UNDETERMINED = "und"
#: Language families by ISO 639-1 code; a language not named here is a family of its own.
FAMILIES = {
    "germanic": ["en", "de", "nl", "sv", "da", "no", "is"],
    "romance": ["fr", "es", "it", "pt", "ro", "ca"],
    "slavic": ["ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr"],
}
_CHUNK = 1 << 22


def features_of(text: str | None, bits: int = BITS) -> np.ndarray:
    counts = np.zeros(1 << bits)
    data = np.frombuffer((" " + (text or "").lower() + " ").encode("utf-8", "surrogatepass"), np.uint8)
    for low in range(0, len(data) - 2, _CHUNK):
        part = data[low : low + _CHUNK + 2].astype(np.uint32)
        grams = (part[:-2] << 16 | part[1:-1] << 8 | part[2:]) * np.uint32(0x9E3779B1)
        counts += np.bincount(grams >> np.uint32(32 - bits), minlength=1 << bits)
    counts = np.sqrt(counts)
    return counts / max(float(np.linalg.norm(counts)), 1e-9)


def _fold(id_col: str) -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(3))


def machine(x: np.ndarray, sign: np.ndarray, cost: float = COST, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Weights and intercept of a linear support vector machine with squared hinge loss, by dual coordinate descent."""
    x = np.hstack([x.astype(np.float64), np.ones((len(x), 1))])
    signed, weights, alpha = x * sign[:, None], np.zeros(x.shape[1]), np.zeros(len(x))
    curve = np.einsum("ij,ij->i", x, x) + 0.5 / cost
    rng = np.random.default_rng(0)
    for _ in range(epochs):
        for k in rng.permutation(len(x)):
            slope = signed[k] @ weights - 1 + alpha[k] * 0.5 / cost
            step = max(alpha[k] - slope / curve[k], 0.0) - alpha[k]
            if step:
                alpha[k] += step
                weights += step * signed[k]
    return weights[:-1], float(weights[-1])


def _fitted(rows: pd.DataFrame) -> pd.DataFrame:
    """The machine of one pair; it is positive for ``a``."""
    rows = rows.sort_values(["sign", "h"], kind="stable")
    kind, a, b = rows[["kind", "a", "b"]].iloc[0]
    weights, intercept = machine(np.stack(rows["x"].to_numpy()), rows["sign"].to_numpy(np.float64))
    return pd.DataFrame({"kind": [kind], "a": [a], "b": [b], "weights": [weights], "intercept": [intercept]})


class LanguageModel:
    """Fitted machines; small enough to be sent with the tasks."""

    def __init__(self, languages: dict[str, list[str]], between: dict, within: dict, bits: int) -> None:
        self.languages, self.between, self.within, self.bits = languages, between, within, bits

    def _vote(self, x: np.ndarray, names: list[str], machines: dict) -> tuple[str, float]:
        """The name with most votes, then largest sum of margins; and how sure its closest contest is."""
        votes = dict.fromkeys(names, 0)
        margins = dict.fromkeys(names, 0.0)
        closest = dict.fromkeys(names, np.inf)
        for (a, b), (weights, intercept) in machines.items():
            margin = float(x @ weights + intercept)
            votes[a if margin > 0 else b] += 1
            for name, m in ((a, margin), (b, -margin)):
                margins[name] += m
                closest[name] = min(closest[name], m)
        best = max(names, key=lambda n: (votes[n], margins[n], n))
        return best, 1 / (1 + float(np.exp(-2 * min(closest[best], 40.0))))

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages or not any(c.isalpha() for c in text):
            return UNDETERMINED, 0.0
        x = features_of(text, self.bits)
        family, sure = self._vote(x, sorted(self.languages), self.between)
        language, within = self._vote(x, self.languages[family], self.within[family])
        return language, round(sure * within, 6)


def fit(docs: DataFrame, id_col: str, text_col: str, lang_col: str, families: dict[str, list[str]], sample_docs: int, bits: int) -> LanguageModel:
    """Learns from text and language of the rows outside the held-out fold."""
    family_of = {x: f for f, xs in families.items() for x in xs}
    usable = docs.where((_fold(id_col) != 1) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    counts = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}  # one row for each language
    if not counts:
        return LanguageModel({}, {}, {}, bits)
    share = F.create_map(*[F.lit(v) for lang, n in counts.items() for v in (lang, min(1.0, sample_docs / n))])
    picked = usable.where(F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20))

    @F.pandas_udf("array<float>")
    def features(texts: pd.Series) -> pd.Series:
        return pd.Series([features_of(t, bits).astype(np.float32) for t in texts])

    names = F.create_map(*[F.lit(v) for lang in counts for v in (lang, family_of.get(lang, lang))])
    hashed = F.xxhash64("id", "text")
    rows = settled(picked.select("lang", names[F.col("lang")].alias("family"), features("text").alias("x"), hashed.alias("h")), "sample")
    languages: dict[str, list[str]] = {}
    for r in rows.select("family", "lang").distinct().orderBy("family", "lang").collect():
        languages.setdefault(r["family"], []).append(r["lang"])
    # (language, pair, side, share of its rows): a family's sample is as large as a language's
    sides = [(lang, "within", a, b, 1.0 if lang == a else -1.0, 1.0) for ls in languages.values() for a, b in combinations(ls, 2) for lang in (a, b)]
    for a, b in combinations(sorted(languages), 2):
        sides += [(lang, "between", a, b, 1.0 if f == a else -1.0, 1 / len(languages[f])) for f in (a, b) for lang in languages[f]]
    machines: dict[str, dict] = {"between": {}, "within": {}}
    if sides:
        pairs = docs.sparkSession.createDataFrame(sides, "lang string, kind string, a string, b string, sign double, part double")
        members = rows.join(F.broadcast(pairs), "lang").where(F.pmod("h", F.lit(1 << 20)) < F.col("part") * (1 << 20))
        fitted = members.select("kind", "a", "b", "sign", "h", "x").groupBy("kind", "a", "b").applyInPandas(
            _fitted, "kind string, a string, b string, weights array<double>, intercept double")
        for r in fitted.collect():  # one row for each pair
            machines[r["kind"]][r["a"], r["b"]] = np.array(r["weights"]), r["intercept"]
    within = {f: {(a, b): machines["within"][a, b] for a, b in combinations(ls, 2)} for f, ls in languages.items()}
    return LanguageModel(languages, machines["between"], within, bits)


def identify(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    families: dict[str, list[str]] = FAMILIES, sample_docs: int = SAMPLE_DOCS, bits: int = BITS,
) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score (0 to 1).

    Rows whose crc32(id as text) mod 3 is 1 are held out of the fit (a null id counts as the empty text). Null texts and
    texts without a letter are ``und`` with score 0, as is everything if there is nothing to learn from; a language that
    is alone in its family, or the only one, needs no machine. Repeated rows each get a row. An empty table gives no rows;
    other columns are not read.
    """
    ship_code(docs)
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, id_col, text_col, lang_col, families, sample_docs, bits))

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([model.value.predict(t) for t in texts], columns=["lang_pred", "score"])

    found = docs.select(F.col(id_col).alias("doc_id"), (_fold(id_col) == 1).alias("held_out"), predict(F.col(text_col).cast("string")).alias("p"))
    return found.select("doc_id", "held_out", "p.lang_pred", "p.score")
