"""Scores over a host column. Each runs in stages (normalise, signals, points), one projection per stage.

Points are whole hundredths and divided once, so every threshold is exact.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threatspark import lexicon as L
from threatspark.functions import lexical as X
from threatspark.functions.hosts import strip
from threatspark.session import settled


#: Characters of a word by which it is looked up in hosts.
GRAM = 4
#: Memory that a row of a broadcast table of short texts takes, about (140 to 196 bytes were measured on 75,000 rows).
ROW_BYTES = 128


def computed(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a costly column that is worked out exactly once per row.

    A later filter on a projected column is pushed below the projection with its whole expression, which then runs
    twice and bloats the generated code. Generator output is not rewritten that way.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def normalised(df: DataFrame, host: str, name: str = "_s_d") -> DataFrame:
    return df.withColumn(name, strip(F.lower(F.coalesce(F.col(host), F.lit("")))))


def _held(kind: str) -> Column:
    """The words of a kind that :func:`words_in` has found; none is an empty array."""
    return F.coalesce(F.col("_held")[kind], F.array().cast("array<string>"))


def quoted(prefix: str, value: Column, suffix: str = "'") -> Column:
    """Text around a value; NULL when the value is."""
    return F.concat(F.lit(prefix), value.cast("string"), F.lit(suffix))


def brand_heuristic(
    df: DataFrame, host: str, name: str = "brand", rules: L.BrandRules = L.BrandRules(), words: DataFrame | None = None, told_tokens: int = 2
) -> DataFrame:
    """Add struct(is_phishing, confidence, score, reason) of the brand-impersonation rules, naming ``told_tokens`` tokens.

    ``words`` is a table (word, kind) of kinds ``brand`` and ``token`` in place of those of the rules; it may be of any size.
    """
    c = F.col
    h = c("_s_d")
    named = normalised(df, host).withColumn("_s_label", X.first_label(h))
    if words is None:
        found = {"_s_hit": X.first_hit("_s_d", rules.brands), "_s_typo": X.typosquat("_s_label", rules.brands), "_s_tokens": X.hits("_s_d", rules.tokens)}
    else:
        brands = words.filter("kind = 'brand'").select(F.col("word").alias("brand"))
        named = named.join(words_in(named, "_s_d", words), "_s_d", "left").join(near_brands(named, "_s_label", brands), "_s_label", "left")
        found = {"_s_hit": F.get(_held("brand"), F.lit(0)), "_s_typo": c("_s_typo"), "_s_tokens": _held("token")}
    signals = named.withColumns({
        "_s_real": (h == "") | h.isin(*rules.real_domains),
        **found,
        "_s_hyphens": X.occurrences(c("_s_label"), "-"),
        "_s_cheap": X.ends_with_any(h, rules.tlds),
    })
    tokens = F.size("_s_tokens")
    points = (
        F.when(c("_s_hit").isNotNull(), 55).otherwise(0)
        + F.when(c("_s_typo").isNull(), 0).when(c("_s_hit").isNotNull(), 45).otherwise(80)
        + F.when(tokens > 0, F.lit(25) + 5 * F.least(tokens, F.lit(3))).otherwise(0)
        + F.when(c("_s_hyphens") >= 2, 10).otherwise(0)
        + F.when(c("_s_cheap"), 20).otherwise(0)
    )
    pointed = signals.withColumn("_s_points", F.when(c("_s_real"), 0).otherwise(points))
    impersonates = c("_s_hit").isNotNull() & ((tokens > 0) | (c("_s_hyphens") >= 2))
    phishing = ~c("_s_real") & (c("_s_points") >= 70) & (impersonates | c("_s_typo").isNotNull())
    reason = F.concat_ws(
        "; ",
        quoted("impersonates brand '", c("_s_hit")),
        F.concat(quoted("typo of brand '", c("_s_typo.brand")), quoted(" (edit distance ", c("_s_typo.distance"), ")")),
        F.when(tokens > 0, F.concat(F.lit("contains "), F.array_join(F.slice("_s_tokens", 1, told_tokens), "/"))),
        F.when(c("_s_hyphens") >= 2, quoted("", c("_s_hyphens"), " hyphens in label")),
        F.when(c("_s_cheap"), F.lit("cheap/abused TLD")),
    )
    result = F.struct(
        phishing.alias("is_phishing"),
        (F.least(c("_s_points"), F.lit(95)) / 100).cast("double").alias("confidence"),
        (c("_s_points") / 100).cast("double").alias("score"),
        F.when(phishing, F.concat(F.lit("Brand-impersonation pattern: "), reason)).alias("reason"),
    )
    return computed(pointed, name, result).select(*df.columns, name)


def lexical_risk(
    df: DataFrame, host: str, name: str = "risk", rules: L.ScoreRules = L.ScoreRules(), told_tokens: int = 3, words: DataFrame | None = None
) -> DataFrame:
    """Add struct(score, reasons): weighted lexical signals, capped at 1, with the text of each signal, naming ``told_tokens`` tokens.

    ``words`` is a table (word, kind) of kinds ``brand`` and ``token`` in place of those of the rules; it may be of any size. Its
    brands are looked for as they are; brands hidden by digits stay those of the rules.
    """
    c = F.col
    d = c("_s_d")
    named = normalised(df, host).withColumn("_s_label", X.first_label(d))
    if words is None:
        hit, tokens = X.first_hit("_s_d", rules.brands), X.hits("_s_d", rules.tokens)
    else:
        named = named.join(words_in(named, "_s_d", words), "_s_d", "left")
        hit, tokens = F.get(_held("brand"), F.lit(0)), _held("token")
    first = named.withColumns({
        "_s_hit": F.when(~d.isin(*rules.real_domains), hit),
        "_s_tokens": tokens,
        "_s_pair": F.coalesce(*[F.when(d.contains(p), F.lit(p)) for p in rules.lookalikes]),
        "_s_mixed": X.mixed_token(c("_s_label")),
        "_s_tld": F.coalesce(*[F.when(d.endswith(t), F.lit(t)) for t in rules.tlds]),
        "_s_hyphens": X.occurrences(d, "-"),
        "_s_size": F.length("_s_label"),
    })
    second = first.withColumns({
        "_s_swapped": X.digit_swap_brand("_s_mixed", rules),
        "_s_bits": F.round(F.when(c("_s_size") >= 8, X.entropy(c("_s_label"))).otherwise(0.0), 9),
    })
    tokens = F.size("_s_tokens")
    one_place = F.format_string("%.1f", F.bround("_s_bits", 1))
    signals = [
        (c("_s_hit").isNotNull(), F.lit(45), quoted("contains brand name '", c("_s_hit"))),
        (
            tokens > 0,
            F.lit(15) + 5 * F.least(tokens, F.lit(3)),
            F.concat(F.lit("suspicious token(s): "), F.array_join(F.slice("_s_tokens", 1, told_tokens), ", ")),
        ),
        (c("_s_pair").isNotNull(), F.lit(15), quoted("lookalike character pattern '", c("_s_pair"))),
        (c("_s_mixed") != "", F.lit(20), quoted("digit/letter mixing in token '", c("_s_mixed"))),
        (c("_s_swapped").isNotNull(), F.lit(35), quoted("brand impersonation via digit swap → '", c("_s_swapped"))),
        (c("_s_tld").isNotNull(), F.lit(25), quoted("cheap/abused TLD '", c("_s_tld"))),
        (c("_s_hyphens") >= 3, F.lit(15), quoted("", c("_s_hyphens"), " hyphens (typical of phishing)")),
        (c("_s_size") >= 25, F.lit(10), quoted("unusually long label (", c("_s_size"), " chars)")),
        (c("_s_bits") >= 3.5, F.lit(15), quoted("high-entropy label (entropy=", one_place, ")")),
    ]
    points = reduce(Column.__add__, [F.when(hit, weight).otherwise(0) for hit, weight, _ in signals])
    result = F.struct(
        (F.least(points, F.lit(100)) / 100).cast("double").alias("score"),
        F.array_compact(F.array(*[F.when(hit, text) for hit, _, text in signals])).alias("reasons"),
    )
    return computed(second, name, result).select(*df.columns, name)


def keyword_verdict(df: DataFrame, host: str, is_dns: Column) -> DataFrame:
    """Add prediction, confidence and risk_level by the keyword rules for queried names or for server names."""
    name = F.col("_s_d")
    counted = normalised(df, host).withColumn("_s_count", F.when(is_dns, X.count_hits("_s_d", L.DNS_INDICATORS)))
    rule = F.when(is_dns, X.dns_rule(name, F.col("_s_count"))).otherwise(X.tls_rule(name))
    ruled = computed(counted, "_s_rule", rule)
    return ruled.select(*df.columns, *[value.alias(n) for n, value in X.verdict_of(F.col("_s_rule")).items()])


def typosquat_match(df: DataFrame, host: str, brands: tuple[str, ...] | DataFrame = L.BRANDS) -> DataFrame:
    """Hosts whose first label is a near miss of a brand, with the brand and the edit distance.

    A tuple of brands is unrolled into one expression; a table (column ``brand``) may be of any size and is joined by
    :func:`near_brands`.
    """
    labelled = df.withColumn("_s_label", X.first_label(F.col(host)))
    if isinstance(brands, DataFrame):
        near = labelled.join(near_brands(labelled.select("_s_label"), "_s_label", brands), "_s_label")
    else:
        near = computed(labelled, "_s_typo", X.typosquat("_s_label", brands)).filter(F.col("_s_typo").isNotNull())
    return near.select(*df.columns, "_s_typo.*")


# --- word tables ----------------------------------------------------------------------------------
def _less(text: str, i: str) -> str:
    """SQL: the text without its character at ``i``."""
    return f"concat(substring({text}, 1, {i} - 1), substring({text}, {i} + 1))"


def _deletions(text: str) -> str:
    """SQL: hashes of the text and of all texts that are left when one or two of its characters go."""
    one = f"transform(sequence(1, length({text})), i -> {_less(text, 'i')})"
    two = f"flatten(transform(sequence(1, length({text}) - 1), i -> transform(sequence(i, length({text}) - 1), j -> {_less(_less(text, 'i'), 'j')})))"
    return f"array_distinct(transform(concat(array({text}), {one}, {two}), t -> xxhash64(t)))"


def _one_edit(text: str, whole: str, without: str) -> str:
    """SQL: hashes by which texts one edit apart meet: of the text (marked ``whole``), of what each character leaves (marked
    ``without``) and of the same with its place."""
    places = f"sequence(1, length({text}))"
    left = f"transform({places}, i -> xxhash64('{without}', {_less(text, 'i')})), transform({places}, i -> xxhash64(i, {_less(text, 'i')}))"
    return f"array_distinct(concat(array(xxhash64('{whole}', {text})), {left}))"


def _spread(texts: DataFrame) -> DataFrame:
    """Few texts in many tasks, too: each becomes a hundred rows, so their size does not tell the work."""
    return texts.repartition(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _sized(df: DataFrame, rows: int) -> DataFrame:
    """``df`` as one side of a join, with its number of rows told: Spark takes what grew by exploding for as small as it was before, and
    a written table for as small as its files. It is broadcast if the rows fit the session's limit, and neither side is if they do not."""
    limit = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return F.broadcast(df) if rows * ROW_BYTES <= limit else df.hint("merge")


def _by_texts(a: DataFrame, a_hashes: str, b: DataFrame, b_hashes: str, rows: str) -> DataFrame:
    """The columns of two tables of one text column each, where their hashes meet; ``rows`` is SQL for the most hashes of a text ``t``."""
    sides = []
    for texts, hashes in ((a, a_hashes), (b, b_hashes)):
        n = texts.toDF("t").agg(F.sum(F.expr(rows))).first()[0] or 0
        sides.append((n, texts.select("*", F.explode(F.expr(hashes)).alias("_h"))))
    (few, less), (_, more) = sorted(sides, key=lambda side: side[0])
    return more.join(_sized(less, few), "_h")


def near_brands(labels: DataFrame, label: str, brands: DataFrame) -> DataFrame:
    """``label`` and ``_s_typo`` = struct(distance, brand) of the nearest brand within its cap, of equals the first.

    First one edit is tried, then two for the labels that this leaves. One edit: either text is the other without a character, or both
    are equal without the character at the same place, so an equi-join on such texts meets near brands alone. Two edits: two texts
    within d edits have a text in common that deleting up to d characters of each can give, so hashes of these texts are joined and
    the distance of what meets is measured. Labels that are too long for every brand are not spelled out. Rules as in
    ``functions.lexical.typosquat``: brands of six letters allow one edit, longer ones two.
    """
    tried = brands.select("brand").filter(F.length("brand") >= 6).distinct()
    longest = tried.agg(F.max(F.length("brand"))).scalar()
    asked = labels.select(F.col(label).alias("_l")).filter((F.length("_l") >= 4) & (F.length("_l") <= longest + 2)).distinct()
    asked, tried = settled(_spread(asked), "labels"), settled(_spread(tried), "brands")  # both are spelled out twice

    def nearest(met: DataFrame, distance: int) -> DataFrame:
        return met.filter(F.expr(f"levenshtein(_l, brand, {distance})") == distance).groupBy("_l").agg(F.min("brand").alias("brand"))

    one = _by_texts(asked, _one_edit("_l", "without", "whole"), tried, _one_edit("brand", "whole", "without"), "2L * length(t) + 1")
    one = settled(nearest(one, 1), "one-edit")
    rest = settled(_spread(asked.join(_sized(one, one.count()), "_l", "left_anti")), "label-texts")
    long = tried.filter(F.length("brand") > 6)
    two = _by_texts(rest, _deletions("_l"), long, _deletions("brand"), "1 + length(t) + length(t) * (length(t) - 1L) DIV 2")
    two = settled(nearest(two, 2), "two-edits")
    found = one.withColumn("distance", F.lit(1)).unionByName(two.withColumn("distance", F.lit(2)))
    return _sized(found.select(F.col("_l").alias(label), F.struct("distance", "brand").alias("_s_typo")), one.count() + two.count())


def words_in(hosts: DataFrame, host: str, words: DataFrame) -> DataFrame:
    """``host`` and, for each ``kind`` of the table (word, kind), the words that the host holds, in order: a map kind to array.

    The first GRAM characters of the words (shorter words as they are) tell where in a host a word may stand and how long the
    words are that begin so; the pieces of those lengths are joined with the words as a whole. So however many words begin alike, a
    host meets only words that it holds. The plan is the same for ten words and for a million.
    """
    entries = settled(words.select("word", "kind").filter(F.length("word") > 0).distinct(), "words")
    starts = entries.groupBy(F.substring("word", 1, GRAM).alias("_g")).agg(F.collect_set(F.length("word")).alias("_sizes"))
    starts = settled(starts, "word-starts")
    asked = hosts.select(F.col(host).alias("_h")).filter(F.length("_h") > 0).distinct()
    # only pieces of a length that some start has go into the join
    sizes = F.coalesce(starts.agg(F.collect_set(F.length("_g"))).scalar(), F.array().cast("array<int>"))
    places = asked.select("_h", F.explode(F.sequence(F.lit(1), F.length("_h"))).alias("_i"), sizes.alias("_n"))
    pieces = places.select("_h", "_i", F.explode("_n").alias("_n")).filter("_i + _n <= length(_h) + 1").select("_h", "_i", F.expr("substring(_h, _i, _n)").alias("_g"))
    begun = pieces.join(_sized(starts, starts.count()), "_g").select("_h", "_i", F.explode("_sizes").alias("_n")).filter("_i + _n <= length(_h) + 1")
    held = begun.select("_h", F.expr("substring(_h, _i, _n)").alias("word")).join(_sized(entries, entries.count()), "word")
    held = held.groupBy("_h", "kind").agg(F.sort_array(F.collect_set("word")).alias("_w"))
    return held.groupBy(F.col("_h").alias(host)).agg(F.map_from_entries(F.collect_list(F.struct("kind", "_w"))).alias("_held"))
