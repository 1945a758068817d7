"""URL filters by a bit-parallel wildcard automaton.

All glob patterns are laid out in one row of bits, one for each literal character, over as many 64-bit words as needed.
For every byte of a URL the states move on together (extended Shift-And): ``D = ((D << 1 | first) & B[c]) | (D & stay)``,
where ``B[c]`` are the positions that accept byte c, ``first`` the patterns that may begin here and ``stay`` the positions
before a ``*``. The URLs of a batch move side by side, a column of bytes at a time; when few long ones are left, they go
on one by one in big integers.

A URL is brought to the form ``.host#path``: ``#`` can be in neither. Rules (host, path) become the pattern
``*.host#path*``, which fits the host and its subdomains and every path that starts with the rule's. The longest rule that
fits wins. URLs without a rule are judged by the glob patterns ``BLOCKED``, and are allowed if none fits.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threatspark.llm.common import ascii_lower, ship_code

#: Verdict, host and path prefix.
RULES = [
    ("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
#: Globs over ``.host#path``, used where no rule fits: advertising, trackers and spam by host.
BLOCKED = ["*.ads.*#*", "*.ads-*#*", "*-ads.*#*", "*.track*.*#*", "*cheap-*#*", "*-pills*#*", "*casino*#*"]
_FEW = 16
#: Bytes of a task for states and results: so many URLs are judged side by side as fit into it.
CELLS = 1 << 26


class GlobAutomaton:
    """Simulates all patterns at once. ``*`` is any text, ``?`` any byte; patterns must fit whole texts."""

    def __init__(self, patterns: list[str]) -> None:
        self.n = len(patterns)
        accept: list[bytes | None] = []  # for each bit its byte, None for any
        self.always, self.start, self.loop, self.last, self.first_only, self.empty = [], [], [], [], [], []
        stay, anywhere, at_start = 0, 0, 0
        self.final = {}
        for k, pattern in enumerate(patterns):
            parts = pattern.encode("utf-8").split(b"*")
            literal = [p for p in parts if p]
            if not literal:
                (self.always if len(parts) > 1 else self.empty).append(k)
                continue
            if parts[0]:
                at_start |= 1 << len(accept)
            else:
                anywhere |= 1 << len(accept)
            for j, part in enumerate(literal):
                accept += [None if c == 0x3F else bytes([c]) for c in part]
                if j < len(literal) - 1 or not parts[-1]:
                    stay |= 1 << (len(accept) - 1)
            self.final[k] = len(accept) - 1
        self.bits = len(accept)
        first = anywhere | at_start
        self.table = [0] * 256
        for i, c in enumerate(accept):
            for b in range(256) if c is None else c:
                self.table[b] |= 1 << i
        # a pattern's last state must not run into the next pattern's first
        self.next_mask, self.anywhere, self.at_start, self.stay = ~first & ((1 << self.bits) - 1), anywhere, at_start, stay
        self.words = max(1, -(-self.bits // 64))
        self.wide = {name: self._wide(getattr(self, name)) for name in ("next_mask", "anywhere", "at_start", "stay")}
        self.wide_table = np.stack([self._wide(x) for x in self.table])

    def _wide(self, x: int) -> np.ndarray:
        return np.array([x >> (64 * k) & 0xFFFFFFFFFFFFFFFF for k in range(self.words)], np.uint64)

    def matches(self, texts: list[bytes]) -> np.ndarray:
        """texts x patterns: whether the pattern fits."""
        out = np.zeros((len(texts), self.n), bool)
        out[:, self.always] = True
        sizes = np.array([len(t) for t in texts], np.int64)
        out[np.ix_(sizes == 0, self.empty)] = True
        if not self.final or not len(texts):
            return out
        order = np.argsort(-sizes, kind="stable")
        states = np.zeros((len(texts), self.words), np.uint64)
        rank = sizes[order]
        line = np.frombuffer(b"".join(texts[i] for i in order.tolist()), np.uint8)
        low = np.cumsum(rank) - rank
        one, top = np.uint64(1), np.uint64(63)
        column, live = 0, int((rank > 0).sum())
        while live > _FEW or live and column == 0:
            here = self.wide_table[line[low[:live] + column]]
            d = states[:live]
            moved = d << one
            moved[:, 1:] |= d[:, :-1] >> top
            moved &= self.wide["next_mask"]
            moved |= self.wide["anywhere"]
            if column == 0:
                moved |= self.wide["at_start"]
            states[:live] = (moved & here) | (d & self.wide["stay"])
            column += 1
            live = int(np.searchsorted(-rank, -column, "left"))
        for i in range(live):
            d = sum(int(x) << (64 * k) for k, x in enumerate(states[i].tolist()))
            for c in line[low[i] + column : low[i] + rank[i]].tobytes():
                d = (((d << 1) & self.next_mask | self.anywhere) & self.table[c]) | (d & self.stay)
            states[i] = self._wide(d)
        for k, bit in self.final.items():
            out[order, k] = states[:, bit // 64] >> np.uint64(bit % 64) & one == one
        return out


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or end, A to Z lower-cased; empty without one."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def judge_urls(pages: DataFrame, url_col: str = "url", rules=RULES, blocked: list[str] = BLOCKED) -> DataFrame:
    """``pages`` with one more column ``judged``: struct of host, path, rule (null if none fits) and verdict.

    Of equally long rules that fit, the first wins. A null url, or one without ``://``, has empty host and path, fits no
    rule with a host and is allowed. Empty tables give no rows; repeated rows are judged alike; other columns stay.
    """
    ship_code(pages)
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    names = [host + path for _, host, path in ordered]
    globs = [f"*.{_plain(host)}#{_plain(path)}*" for _, host, path in ordered] + list(blocked)
    automaton = GlobAutomaton(globs)

    @F.pandas_udf("rule string, verdict string")
    def judge(hosts: pd.Series, paths: pd.Series) -> pd.DataFrame:
        texts = [f".{h}#{p}".encode("utf-8", "surrogatepass") for h, p in zip(hosts, paths, strict=True)]
        best, rest = np.full(len(texts), -1), np.zeros(len(texts), bool)
        step = max(1, CELLS // (automaton.n + 8 * automaton.words + 1))
        for low in range(0, len(texts), step):
            found = automaton.matches(texts[low : low + step])
            by_rule, rest[low : low + step] = found[:, : len(ordered)], found[:, len(ordered) :].any(axis=1)
            if ordered:
                best[low : low + step] = np.where(by_rule.any(axis=1), by_rule.argmax(axis=1), -1)
        return pd.DataFrame({
            "rule": [names[b] if b >= 0 else None for b in best.tolist()],
            "verdict": [ordered[b][0] if b >= 0 else "block" if r else "allow" for b, r in zip(best.tolist(), rest.tolist(), strict=True)],
        })

    parts = pages.withColumn("judged", F.struct(host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path")))
    verdict = judge(F.col("judged.host"), F.col("judged.path"))
    return parts.withColumn("judged", F.struct(F.col("judged.host").alias("host"), F.col("judged.path").alias("path"), verdict.alias("v")))


def _plain(text: str) -> str:
    if "*" in text or "?" in text:
        raise ValueError("rules are plain hosts and path prefixes; use globs for wildcards")
    return text
