"""The operators applied to the given tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threatspark.llm import decontaminate, exact, html, language, mixing, pieces, quality, ranked, simhash, spelling, substrings, urls, warc
from threatspark.llm.common import shared_folder, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


@query(
    """
    WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n_chars,
                      translate(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '') AS norm
               FROM documents)
    SELECT doc_id,
           first_value(doc_id) OVER (PARTITION BY norm ORDER BY n_chars DESC, doc_id) AS keep_id,
           count(*) OVER (PARTITION BY norm) AS group_size,
           row_number() OVER (PARTITION BY norm ORDER BY n_chars DESC, doc_id) = 1 AS kept,
           sha256(norm) AS text_sha256, n_chars
    FROM d
    """
)
def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, its group of equal texts and whether it stays."""
    return exact.exact_duplicates(table(spark, sf_dir, "documents"))


@query()
def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, its fingerprint and the component it is linked to."""
    return simhash.simhash_groups(table(spark, sf_dir, "documents"))


@query()
def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: its words, those removed as repeats of earlier text, and the digest of what is kept."""
    kept = substrings.without_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query()
def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: the number and digest of its ids, and the digest of the text decoded from them."""
    coded = pieces.encode_and_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query()
def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a test item, with the item, its score and the overlaps."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query()
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: whether it was held out, its predicted language and how sure that is."""
    return language.identify(table(spark, sf_dir, "documents"))


@query()
def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: its log importance for the labelled good texts, the same with noise, and whether it is kept."""
    return quality.importance_sample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query(
    r"""
    WITH u AS (SELECT page_id,
                      translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''),
                                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                      coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
               FROM pages),
         r AS (SELECT page_id, host, path, '.' || host AS h, '.' || host || '#' || path AS g,
                      CASE WHEN ends_with('.' || host, '.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
                           WHEN ends_with('.' || host, '.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
                           WHEN ends_with('.' || host, '.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
                           WHEN ends_with('.' || host, '.com') AND starts_with(path, '/de/') THEN 'com/de/'
                           WHEN ends_with('.' || host, '.org') AND starts_with(path, '/') THEN 'org/' END AS rule
               FROM u)
    SELECT page_id, host, path, rule,
           CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
                WHEN h LIKE '%.ads.%' OR h LIKE '%.ads-%' OR h LIKE '%-ads.%' OR h LIKE '%.track%.%' OR h LIKE '%cheap-%'
                  OR h LIKE '%-pills%' OR h LIKE '%casino%' THEN 'block'
                ELSE 'allow' END AS verdict
    FROM r
    """
)
def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page: host and path of its url, the longest rule that fits, and the verdict."""
    judged = urls.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"))
    return judged.select("page_id", "judged.host", "judged.path", "judged.v.rule", "judged.v.verdict")


@query(
    """
    WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
         d AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS payload_digest FROM p),
         r AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS last FROM d)
    SELECT page_id, payload_bytes, payload_digest,
           CASE WHEN payload_bytes >= 1000 AND last <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN payload_bytes >= 1000 AND last <> page_id THEN last END AS refers_to
    FROM r
    """
)
def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page: what the archives written from the table and read back say of its record."""
    path = shared_folder(spark, "archives")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    return warc.payload_digests(warc.read_archives(spark, path, whole_files=True)).withColumnRenamed("key", "page_id")


@query()
def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page: its main text and the number of its code points."""
    return html.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query()
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of the documents, the near word it is a variant of, and the root of its chain of forms."""
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


@query(
    r"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id,
                      regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
               FROM documents),
         g AS (SELECT count(*) AS nn, sum(len(terms))::BIGINT AS ll FROM d WHERE len(terms) > 0),
         i AS (SELECT item_id, text,
                      unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
               FROM (SELECT DISTINCT item_id, text FROM benchmark)),
         q AS (SELECT item_id, text, term, count(*) AS times FROM i GROUP BY ALL),
         t AS (SELECT r, any_value(doc_id) AS doc_id, any_value(n) AS n, term, count(*) AS tf
               FROM (SELECT r, doc_id, len(terms) AS n, unnest(terms) AS term FROM d) GROUP BY r, term),
         w AS (SELECT term, floor(1000 * ln((2 * any_value(nn) + 2) / (2 * count(*) + 1)))::BIGINT AS weight
               FROM t, g WHERE term IN (SELECT term FROM q) GROUP BY term),
         s AS (SELECT item_id, text, r, any_value(doc_id) AS doc_id,
                      sum(times * weight * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nn) // ll))))::BIGINT AS score
               FROM q JOIN w USING (term) JOIN t USING (term), g GROUP BY item_id, text, r),
         o AS (SELECT item_id, doc_id, score,
                      row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank
               FROM s WHERE score > 0)
    SELECT item_id, rank, doc_id, score FROM o WHERE rank <= 10
    """
)
def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item with its ten best documents."""
    return ranked.top_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query(
    r"""
    WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                      ('0x' || substr(md5('0:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 13))::BIGINT
                      / 4503599627370496.0::DOUBLE AS draw
               FROM documents),
         s AS (SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS place
               FROM d GROUP BY source),
         w AS (SELECT source, source_size, 2.0::DOUBLE * source_size AS cap,
                      CASE place WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight FROM s),
         o AS (SELECT cap / weight AS most, row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS pos,
                      (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE
                       - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                      / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
               FROM w),
         l AS (SELECT min_by(level, pos) AS level FROM o WHERE level < most),
         t AS (SELECT source, source_size, least(cap, weight * coalesce((SELECT level FROM l), 'inf'::DOUBLE)) AS target FROM w),
         r AS (SELECT doc_id, size, source_size, target, draw, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate
               FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
    SELECT doc_id, size, source_size, target, size * (floor(rate)::BIGINT + (draw < rate - floor(rate))::BIGINT) AS taken FROM r
    """
)
def op13_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: its words, those of its source, the source's target, and the words that the mixture takes of it."""
    mixed = mixing.copies_of(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
