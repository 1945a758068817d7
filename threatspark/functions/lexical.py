"""Lexical expressions over host names: entropy, word hits, typosquats, keyword verdicts, verifier replies, anomalies.

Arguments are plain, already normalised columns (lower case, trimmed). Operators normalise in an earlier projection:
the optimizer keeps such a projection apart when it is used more than once, so the text work is done once per row.
Word tests are one regular expression each, which keeps generated code small. Functions that go through a whole word list
take the name of a column and state the expression as SQL, which is far quicker to build than hundreds of small columns.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from threatspark import lexicon as L
from threatspark.functions.hosts import before


# --- building blocks ----------------------------------------------------------------------------
def has_any(text: Column, words: tuple[str, ...]) -> Column:
    return text.rlike("|".join(re.escape(w) for w in words))


def ends_with_any(text: Column, endings: tuple[str, ...]) -> Column:
    return text.rlike("(" + "|".join(re.escape(e) for e in endings) + r")\z")


def literal(word: str) -> str:
    """A word as SQL text."""
    return "'" + word.replace("\\", "\\\\").replace("'", "\\'") + "'"


def count_hits(column: str, words: tuple[str, ...]) -> Column:
    """How many of the words occur in the column."""
    return F.expr(" + ".join(f"CAST(contains({column}, {literal(w)}) AS INT)" for w in words))


def _each_hit(column: str, words: tuple[str, ...]) -> str:
    return ", ".join(f"CASE WHEN contains({column}, {literal(w)}) THEN {literal(w)} END" for w in sorted(words))


def first_hit(column: str, words: tuple[str, ...]) -> Column:
    """The alphabetically first word that occurs in the column, or NULL."""
    return F.expr(f"coalesce({_each_hit(column, words)})")


def hits(column: str, words: tuple[str, ...]) -> Column:
    """The words that occur in the column, alphabetically."""
    return F.expr(f"array_compact(array({_each_hit(column, words)}))")


def occurrences(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def entropy(text: Column) -> Column:
    """Shannon entropy of the characters in bits; 0 for NULL and empty text.

    (n log2 n - sum of k log2 k) / n for n characters, k of a kind. A character that occurs once adds nothing to the sum, so only the
    runs of the sorted text that are longer than one are gone through. What stands outside the ``aggregate`` is generated code.
    """

    def bits(size: Column) -> Column:
        return size * F.log2(size)

    size = F.length(text)
    runs = F.regexp_extract_all(F.array_join(F.sort_array(F.split(text, "")), ""), F.lit(r"(?s)(.)\1+"), F.lit(0))
    repeated = F.aggregate(runs, F.lit(0.0), lambda total, run: total + bits(F.length(run)))
    return F.when(size > 0, (bits(size) - repeated) / size).otherwise(0.0)


def entropy_stripped(text: Column) -> Column:
    """Entropy of the lower-cased text without dots and hyphens."""
    return entropy(F.lower(F.replace(F.replace(text, F.lit("."), F.lit("")), F.lit("-"), F.lit(""))))


def first_label(host: Column) -> Column:
    return before(host, ".")


def high_entropy_label(host: Column, limit: float = 4.5) -> Column:
    return host.contains(".") & (entropy(first_label(host)) > F.lit(limit))


# --- typosquats and look-alikes -----------------------------------------------------------------
def typosquat(label: str, brands: tuple[str, ...] = L.BRANDS) -> Column:
    """struct(distance, brand) of the nearest brand within its edit cap, NULL when there is none.

    Brands of six letters allow one edit, longer ones two; shorter brands are not tried. The brands are a short curated
    list, so each is one capped distance in generated code rather than a theta join. Distance and brand number travel
    as one integer; ``levenshtein`` gives -1 above the cap, which becomes a code no real match has.
    """
    tried = sorted(b for b in brands if len(b) >= 6)
    codes = ", ".join(
        f"CASE WHEN length({label}) BETWEEN {len(brand) - 2} AND {len(brand) + 2} AND {label} <> {literal(brand)} "
        f"THEN pmod(levenshtein({label}, {literal(brand)}, {1 if len(brand) == 6 else 2}), 100) * 1000 + {number} END"
        for number, brand in enumerate(tried)
    )
    if len(tried) < 2:  # least() takes two arguments
        codes = ", ".join(filter(None, [codes, "99000", "99000"]))
    best = F.expr(f"CASE WHEN length({label}) >= 4 THEN least({codes}) END")
    names = F.array(*[F.lit(b) for b in tried])
    return F.when(
        best < 99_000,
        F.struct(F.floor(best / 1000).cast("int").alias("distance"), F.get(names, best % 1000).alias("brand")),
    )


def mixed_token(label: Column) -> Column:
    """First run of at least four lower-case letters and digits holding both, '' when there is none."""
    return F.regexp_extract(label, r"(?<![a-z0-9])(?=[a-z0-9]*[a-z])(?=[a-z0-9]*[0-9])[a-z0-9]{4,}", 0)


def digit_swap_brand(token: str, rules: L.ScoreRules = L.ScoreRules()) -> Column:
    """Brand hidden by digits in a mixed token (``paypa1``), or NULL."""
    digits, letters = rules.deobfuscate
    plain = f"translate({token}, {literal(digits)}, {literal(letters)})"
    cases = (
        f"CASE WHEN contains({plain}, {literal(b)}) AND NOT contains({token}, {literal(b)}) THEN {literal(b)} END" for b in sorted(rules.brands)
    )
    return F.expr(f"coalesce({', '.join(cases)})")


# --- keyword verdicts ---------------------------------------------------------------------------
# fixed values: what each keyword rule reports
VERDICTS = (
    ("phishing", 0.95, "high"), ("phishing", 0.85, "high"), ("phishing", 0.82, "high"), ("phishing", 0.70, "medium"),
    ("legitimate", 0.95, "low"), ("legitimate", 0.85, "low"), ("phishing", 0.75, "medium"), ("legitimate", 0.92, "low"),
)


def dns_rule(name: Column, count: Column) -> Column:
    """Number of the keyword rule a queried name with so many indicator words falls under."""
    return (
        F.when(has_any(name, L.DNS_STRONG_PATTERNS), 0)
        .when(count >= 2, 1)
        .when((count == 1) & has_any(name, L.URGENT_WORDS), 2)
        .when(count == 1, 3)
        .otherwise(4)
    )


def tls_rule(name: Column) -> Column:
    """Number of the keyword rule a server name falls under: specific patterns only."""
    return (
        F.when(F.length(name) < 4, 5)
        .when(has_any(name, L.TLS_PATTERNS), 0)
        .when(has_any(name, L.URGENT_WORDS) & ~has_any(name, L.TLS_KNOWN_BRANDS), 6)
        .otherwise(7)
    )


def verdict_of(rule: Column) -> dict[str, Column]:
    """prediction, confidence and risk level of a rule number."""
    columns = zip(("prediction", "confidence", "risk_level"), zip(*VERDICTS, strict=True), strict=True)
    return {name: F.get(F.array(*[F.lit(x) for x in values]), rule) for name, values in columns}


def keyword_label(
    domain: Column,
    phishing: tuple[str, ...] = L.FEED_FALLBACK,
    legitimate: tuple[str, ...] = L.LABEL_LEGITIMATE,
) -> Column:
    """Training label of a name in any case: exact lists first, then keywords."""
    domain = F.lower(domain)
    return (
        F.when(domain.isin(*phishing), "phishing")
        .when(domain.isin(*legitimate), "legitimate")
        .when(has_any(domain, L.LABEL_KEYWORDS), "phishing")
        .otherwise("legitimate")
    )


def fallback_verify(domain: str) -> Column:
    """struct(is_phishing, confidence) of the weighted word-count verifier for a name in any case, in exact hundredths."""
    domain = f"lower({domain})"
    points = (
        40 * count_hits(domain, L.VERIFY_STRONG)
        + 20 * count_hits(domain, L.VERIFY_MEDIUM)
        + 10 * count_hits(domain, L.VERIFY_WEAK)
        + 30 * count_hits(domain, L.VERIFY_BRANDS)
    )
    phishing = points > 50
    thousandths = F.when(phishing, F.least(F.lit(950), F.lit(500) + 4 * points)).otherwise(
        F.least(F.lit(900), F.lit(500) + 3 * (F.lit(100) - points))
    )
    return F.struct(phishing.alias("is_phishing"), (thousandths / 1000).cast("double").alias("confidence"))


# --- verifier replies ---------------------------------------------------------------------------
REPLY_SCHEMA = "is_phishing string, confidence string, reasoning string"


def reply_body(reply: Column) -> Column:
    """Text from the first ``{`` to the last ``}``, '' without one."""
    return F.regexp_extract(reply, r"(?s)\{.*\}", 0)


def parse_reply_json(reply: Column, default_reason: str = L.REPLY_DEFAULT_REASON) -> Column:
    """struct(is_phishing, confidence, reasoning) of a JSON reply, NULL when it is not a readable object."""
    body = reply_body(reply)
    data = F.from_json(body, REPLY_SCHEMA)
    confidence = F.coalesce(data["confidence"], F.lit("0.5")).try_cast("double")
    readable = (body != "") & F.try_parse_json(body).isNotNull() & confidence.isNotNull()
    return F.when(
        readable,
        F.struct(
            F.coalesce(data["is_phishing"].try_cast("boolean"), F.lit(False)).alias("is_phishing"),
            confidence.alias("confidence"),
            F.coalesce(data["reasoning"], F.lit(default_reason)).alias("reasoning"),
        ),
    )


def parse_reply_text(reply: Column, reasoning_chars: int | None = None) -> Column:
    """struct(is_phishing, confidence, reasoning) from indicator words of a free-text reply, which is the reasoning."""
    text = F.lower(reply)
    certain = has_any(text, L.REPLY_PHISHING_WORDS + L.REPLY_LEGITIMATE_WORDS)
    return F.struct(
        has_any(text, L.REPLY_PHISHING_WORDS).alias("is_phishing"),
        F.when(certain, 0.7).otherwise(0.5).alias("confidence"),
        (reply if reasoning_chars is None else F.substring(reply, 1, reasoning_chars)).alias("reasoning"),
    )


def verify_reply(domain: str, reply: Column, reasoning_chars: int | None = None) -> Column:
    """One verdict per reply: JSON when readable, free text when the JSON is broken, word counts without any reply."""
    fallback = fallback_verify(domain)
    counted = F.struct(
        fallback["is_phishing"].alias("is_phishing"),
        fallback["confidence"].alias("confidence"),
        F.lit(L.FALLBACK_REASON).alias("reasoning"),
    )
    return F.when(F.coalesce(reply_body(reply), F.lit("")) == "", counted).otherwise(
        F.coalesce(parse_reply_json(reply), parse_reply_text(reply, reasoning_chars))
    )


# --- anomaly flags ------------------------------------------------------------------------------
def dns_anomalies(domain: Column, ttl: Column) -> Column:
    return F.array_compact(
        F.array(
            F.when((ttl > 0) & (ttl < 60), F.lit("low_ttl")),
            F.when(high_entropy_label(domain), F.lit("high_entropy")),
        )
    )


def tls_anomalies(tls_version: Column, sni: Column) -> Column:
    return F.array_compact(
        F.array(
            F.when(tls_version.contains("1.0"), F.lit("old_tls")),
            F.when(has_any(F.lower(sni), L.SNI_SUSPICIOUS), F.lit("suspicious_sni")),
        )
    )
