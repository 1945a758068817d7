"""Host-name expressions: normalisation, public-host test, SNI cleaning, parent suffixes, list membership."""

from __future__ import annotations

import re
from collections import defaultdict
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from threatspark import lexicon as L

WHITESPACE = " \t\n\r\f\v"


def strip(col: Column) -> Column:
    """Drop leading and trailing white space of any kind."""
    return F.btrim(col, F.lit(WHITESPACE))


def before(col: Column, mark: str) -> Column:
    """The part in front of the first ``mark``, or everything."""
    return F.substring_index(col, mark, 1)


def host_of(value: Column) -> Column:
    """Host of a URL or bare host: drop the scheme, cut at ``/`` or ``:``, lower-case."""
    return F.lower(F.regexp_extract(strip(value), r"(?s)^(?:.*?://)?([^/:]*)", 1))


def url_of(value: Column) -> Column:
    """The input when it names a scheme, else ``http://`` and its host part as written. Empty stays empty."""
    raw = strip(value)
    return (
        F.when(raw == "", F.lit(""))
        .when(raw.contains("://"), raw)
        .otherwise(F.concat(F.lit("http://"), before(before(raw, "/"), ":")))
    )


def _any(words: tuple[str, ...]) -> str:
    return "|".join(re.escape(w) for w in words)


# Scheme, user info and a closed bracket are skipped; a bare host must not run into a path.
AUTHORITY_HOST = (
    r"(?s)^(?:(?=.*://)(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#]*@)?(?:\[(?=[^/?#]*\]))?|(?!.*://)(?![^:]*[/?#]))([^/?#:]*)"
)
PUBLIC_HOST = (
    rf"^(?!(?:{_any(L.LOCAL_HOSTS)})\z)"
    rf"(?!.*(?:{_any(L.LOCAL_SUFFIXES)})\z)"
    rf"(?!{_any(L.PRIVATE_PREFIXES)})"
    r"(?!172\.0*(?:1[6-9]|2[0-9]|3[01])(?:\.|\z))"
    r"([a-z0-9.-]+)\z"
)
LABEL = "[0-9-]*[A-Za-z][A-Za-z0-9-]*"
# a name the cleaning rules would leave as it is ("h2" is the only junk token that fits into a name)
CLEAN_NAME = rf"^(?=.{{4,253}}\z)(?!-)(?!.*h2)(?!.*[^.]{{64}}){LABEL}(?:\.{LABEL})+(?<!-)\z"
DOMAIN_NAME = rf"^(?=.{{4,253}}\z)(?!.*[^.]{{64}}){LABEL}(?:\.{LABEL})+\z"


def external_host(value: Column) -> Column:
    """Public host of a URL or bare host; '' for loopback, link-local, mDNS and private ranges and for names with
    other characters.

    One pass per step and no column used twice, so a filter on the result stays cheap wherever it is pushed.
    """
    s = F.lower(strip(F.coalesce(value, F.lit(""))))
    host = F.btrim(F.regexp_extract(s, AUTHORITY_HOST, 1), F.lit("."))
    return F.regexp_extract(host, PUBLIC_HOST, 1)


def clean_sni(value: Column) -> Column:
    """Domain inside a noisy server name, '' when none is left.

    Junk tokens become blanks in list order; text ends at the first non-ASCII character and, once a name has begun,
    at white space. What is left must have at least two labels, each with a letter. Names that are clean already, as
    nearly all are, take one test.
    """
    stripped = strip(F.coalesce(value, F.lit("")))
    s = stripped
    for junk in L.SNI_GARBAGE:
        s = F.replace(s, F.lit(junk), F.lit(" "))
    ascii_part = F.regexp_extract(s, r"^[\x00-\x7F]*", 0)
    kept = F.regexp_replace(ascii_part, r"[^A-Za-z0-9.\- \n\r\t]", "")
    name = F.btrim(F.regexp_extract(kept, r"^[ \n\r\t]*([A-Za-z0-9.\-]*)", 1), F.lit(".-"))
    return F.when(stripped.rlike(CLEAN_NAME), stripped).otherwise(F.regexp_extract(name, DOMAIN_NAME, 0))


def suffixes(host: Column, min_labels: int = 1) -> Column:
    """The host and its parent names with at least ``min_labels`` labels, as an array. The host itself is always in."""
    parts = F.split(host, r"\.")
    count = F.size(parts)
    parents = F.transform(
        F.sequence(F.lit(0), F.greatest(count - F.lit(min_labels), F.lit(0))),
        lambda i: F.concat_ws(".", F.slice(parts, i + 1, count)),
    )
    return parents


def in_list(host: Column, entries: tuple[str, ...]) -> Column:
    """True when the host is an entry or lies below one.

    A suffix can only equal an entry with the same number of labels, so one set lookup per label count is enough:
    no explode, no join, no scan of the list.
    """
    h = strip(F.lower(F.coalesce(host, F.lit(""))))
    by_labels: dict[int, list[str]] = defaultdict(list)
    for entry in sorted(set(entries)):
        by_labels[entry.count(".") + 1].append(entry)
    checks = [F.substring_index(h, ".", -n).isin(*names) for n, names in sorted(by_labels.items())]
    return reduce(Column.__or__, checks, F.lit(False))
