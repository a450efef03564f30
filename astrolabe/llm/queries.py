"""The queries of the text operators: each applies one, with production parameters, to the whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import secrets

    docs = _table(spark, sf_dir, "documents")
    return secrets.scan(docs, secrets.fit(docs))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import toxicity

    docs = _table(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import mixing

    return mixing.mix_sizes(_table(spark, sf_dir, "documents"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import exact_dedup

    return exact_dedup.duplicates(_table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import language_id

    docs = _table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.fit(docs))


def op6_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import site_quality

    docs = _table(spark, sf_dir, "documents")
    return site_quality.judge(docs, site_quality.fit(docs, _table(spark, sf_dir, "labels")))


def op7_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import suffix_tree

    docs = _table(spark, sf_dir, "documents")
    return suffix_tree.score(docs, suffix_tree.fit(docs))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from . import packing

    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path(packing.TOKENIZER))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import near_dedup

    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality_rules

    docs = _table(spark, sf_dir, "documents")
    return quality_rules.judge(docs, *quality_rules.fit(docs, _table(spark, sf_dir, "labels")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_secrets, op2_toxicity, op3_mixing, op4_exact_dedup, op5_language_id, op6_site_quality, op7_suffix_tree, op8_packing, op9_near_dedup, op10_quality_rules
)}

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES: dict[str, str] = {
    "op3_mixing": f"""
        WITH words AS (
            SELECT doc_id, source, CAST(len({_WORDS.format("coalesce(text, '')")}) AS BIGINT) AS size FROM documents
        ), per AS (
            SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM words GROUP BY source
        ), weighed AS (
            SELECT *, CASE (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 WHEN 0 THEN 5e0 WHEN 1 THEN 2e0 ELSE 1e0 END AS weight FROM per
        ), ordered AS (
            SELECT *, row_number() OVER o AS k, CAST(sum(source_size) OVER () AS DOUBLE) AS total,
                   CAST(coalesce(sum(source_size) OVER (ORDER BY source_size / weight, source IS NULL, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) * 3, 0) AS DOUBLE) AS capped,
                   sum(weight) OVER (ORDER BY source_size / weight, source IS NULL, encode(source) ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open
            FROM weighed WINDOW o AS (ORDER BY source_size / weight, source IS NULL, encode(source))
        ), settled AS (
            SELECT k AS first_open, (total - capped) / open AS level FROM ordered WHERE (total - capped) / open * weight <= 3 * source_size ORDER BY k LIMIT 1
        ), targets AS (
            SELECT source, source_size, CASE WHEN k >= first_open THEN level * weight ELSE source_size * 3e0 END AS target FROM ordered LEFT JOIN settled ON TRUE
        ), ranked AS (
            SELECT doc_id, size, source_size, target, row_number() OVER (PARTITION BY w.source ORDER BY size, doc_id) AS r,
                   CASE WHEN source_size > 0 THEN least(3e0, target / source_size) ELSE 0e0 END AS rate,
                   (CAST('0x' || substr(md5('20:' || coalesce('s' || w.source, 'n')), 1, 8) AS BIGINT) + 5e-1) / 4294967296e0 AS start
            FROM words w JOIN targets t ON w.source IS NOT DISTINCT FROM t.source
        ), drawn AS (
            SELECT *, CAST(least(floor(r * rate + start) - floor((r - 1) * rate + start), 3) AS INTEGER) AS copies FROM ranked
        )
        SELECT doc_id, size, source_size, target, CAST(copies * size AS BIGINT) AS taken, copies FROM drawn
    """,
    "op4_exact_dedup": r"""
        WITH normal AS (
            SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
        )
        SELECT doc_id,
               min(doc_id) OVER same AS keep_id,
               CAST(count(*) OVER same AS BIGINT) AS group_size,
               doc_id = min(doc_id) OVER same AS kept,
               sha256(norm) AS text_sha256
        FROM normal
        WINDOW same AS (PARTITION BY norm)
    """,
    "op9_near_dedup": f"""
        WITH RECURSIVE listed AS (
            SELECT doc_id, {_WORDS.format(_LOWER)} AS w FROM documents
        ), sets AS (
            SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
                                WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM listed
        ), shingles AS (
            SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets
        ), links AS (
            SELECT a.doc_id AS x, b.doc_id AS y FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id < b.doc_id
            GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
        ), ends AS (
            SELECT x, y FROM links UNION ALL SELECT y, x FROM links
        ), reached AS (
            SELECT doc_id, doc_id AS other FROM documents
            UNION
            SELECT r.doc_id, b.y FROM reached r JOIN ends b ON r.other = b.x
        ), least AS (
            SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id
        )
        SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN least USING (doc_id)
    """,
    "op10_quality_rules": f"""
        WITH listed AS (
            SELECT doc_id, coalesce(text, '') AS text, {_WORDS.format("coalesce(text, '')")} AS w FROM documents
        ), lines AS (
            SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM listed
        ), repeated_lines AS (
            SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id
        ), windows AS (
            SELECT doc_id, i, [w[i], w[i + 1], w[i + 2]] AS three FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM listed)
        ), often AS (
            SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, three) AS times FROM windows
        ), repeated_words AS (
            SELECT doc_id, count(DISTINCT i + d) AS n FROM often, (VALUES (0), (1), (2)) v(d) WHERE times > 1 GROUP BY doc_id
        ), coded AS (
            SELECT doc_id, regexp_extract_all(hex(encode(text)), '..') AS h FROM listed
        ), codes AS (
            SELECT doc_id, CAST('0x' || unnest(list_transform(range(1, len(h) - 2), lambda i: h[i] || h[i + 1] || h[i + 2] || h[i + 3])) AS UBIGINT) AS c FROM coded
        ), grams AS (
            SELECT doc_id, xor(c * 2654435761 & 4294967295, (c >> 15) * 2246822519 & 4294967295) >> 16 AS g FROM codes
        ), counts AS (
            SELECT g, count(*) AS raw, count(*) FILTER (doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)) AS good FROM grams GROUP BY g
        ), totals AS (
            SELECT sum(raw) AS raw, sum(good) AS good FROM counts
        ), ratios AS (
            SELECT g, ln((c.good + 0.5e0) / (t.good + 32768e0)) - ln((c.raw + 0.5e0) / (t.raw + 32768e0)) AS ratio FROM counts c, totals t
        ), scores AS (
            SELECT doc_id, avg(ratio) AS score FROM grams JOIN ratios USING (g) GROUP BY doc_id
        ), base AS (
            SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
                   CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
                   CAST(coalesce(l.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words, coalesce(score, 0e0) AS score
            FROM listed LEFT JOIN repeated_lines l USING (doc_id) LEFT JOIN repeated_words r USING (doc_id) LEFT JOIN scores USING (doc_id)
        ), trusted AS (
            SELECT quantile_cont(score, 0.01) AS low, quantile_cont(score, 0.5) AS middle FROM base WHERE n_words >= 50 AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)
        ), judged AS (
            SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base
        )
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, round(score, 8) AS score, base_failed,
               NOT base_failed AND score >= low - 3 * (middle - low) AS kept
        FROM judged, trusted
    """,
}
