"""The registered queries of this subpackage, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import html_extract, licenses, mixing, quality_classifier, quality_rules, sentencepiece_codec, simhash, token_counts, topk, url_filter

TOP_K = 10
#: Weights of the sources in the mixed corpus; others share OTHER.
TARGETS = {f"src{i}": 0.06 if i < 10 else 0.04 for i in range(20)}
OTHER, MIX_SEED = 0.02, 1
URL_RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_rules.judge(docs, quality_rules.fit(docs, table(spark, sf_dir, "labels")))


def op2_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, TOP_K)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex16().alias("fingerprint"), "component_id")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return licenses.scan(docs, licenses.fit(docs))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), TARGETS, OTHER, MIX_SEED, copy_col="copy")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode(table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_classifier.score(docs, quality_classifier.fit(docs, table(spark, sf_dir, "labels")))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_rules,
        op2_top_k,
        op3_simhash,
        op4_license_scan,
        op5_mix_sources,
        op6_sentencepiece,
        op7_token_counts,
        op8_url_filter,
        op9_quality_classifier,
        op10_html_extraction,
    )
}

_WEIGHT_ROWS = ", ".join(f"('{k}', CAST({v} AS DOUBLE))" for k, v in TARGETS.items())

ORACLE_SQL = {
    "op2_top_k": f"""
        WITH v AS (
          SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE) FOR x IN embedding] AS q
          FROM embeddings
          WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
            AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = len(embedding)
        ), s AS (
          SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
          FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
          WHERE a.vec_id % 100 = 0
        )
        SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM s
        WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id)
        QUALIFY row_number() OVER w <= {TOP_K}
    """,
    "op5_mix_sources": f"""
        WITH RECURSIVE targets(source, w) AS (VALUES {_WEIGHT_ROWS}),
        grouped AS (SELECT d.*, t.source AS g FROM documents d LEFT JOIN targets t ON d.source = t.source),
        sizes AS (
          SELECT s.g, s.n, coalesce(t.w, CAST({OTHER} AS DOUBLE)) AS w
          FROM (SELECT g, count(*) AS n FROM grouped GROUP BY g) s LEFT JOIN targets t ON s.g = t.source
        ),
        rated AS (SELECT g, w / (SELECT sum(w) FROM sizes) * (SELECT sum(n) FROM sizes) / n AS rate FROM sizes),
        parts AS (SELECT g, greatest(1, CAST(ceil(rate / {mixing.MOST_MEAN}) AS BIGINT)) AS parts, rate FROM rated),
        cdf(g, parts, mean, k, p, c) AS (
          SELECT g, parts, rate / parts, 0, exp(-(rate / parts)), exp(-(rate / parts)) FROM parts
          UNION ALL
          SELECT g, parts, mean, k + 1, p * mean / (k + 1), c + p * mean / (k + 1) FROM cdf WHERE k < {mixing.TERMS}
        ),
        steps AS (SELECT g, any_value(parts) AS parts, list(c) AS cs FROM cdf GROUP BY g),
        drawn AS (
          SELECT d.*, s.cs, (CAST(('0x' || substr(md5('{MIX_SEED}|' || coalesce(CAST(d.doc_id AS VARCHAR), '') || '|' || CAST(part AS VARCHAR)), 1, {mixing.BITS // 4})) AS BIGINT) + 0.5::DOUBLE) / {float(1 << mixing.BITS)}::DOUBLE AS u
          FROM (SELECT g.*, row_number() OVER () AS row_no FROM grouped g) d JOIN steps s ON d.g IS NOT DISTINCT FROM s.g, range(1, s.parts + 1) r(part)
        ),
        counted AS (
          SELECT any_value(doc_id) AS doc_id, any_value(text) AS text, any_value(lang) AS lang, any_value(source) AS source, any_value(n_chars) AS n_chars,
            CAST(sum(len([c FOR c IN cs IF c < u])) AS BIGINT) AS copies
          FROM drawn GROUP BY row_no
        )
        SELECT doc_id, text, lang, source, n_chars, CAST(unnest(range(1, copies + 1)) AS INTEGER) AS copy FROM counted WHERE copies > 0
    """,
    "op8_url_filter": """
        WITH rules(h, p, verdict) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'block'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
        rest AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
        cut AS (
          SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
            regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path
          FROM rest
        ),
        numbered AS (SELECT *, row_number() OVER () AS row_no FROM cut),
        fits AS (
          SELECT n.row_no, h || p AS rule, verdict FROM numbered n JOIN rules ON (host = h OR suffix(host, '.' || h)) AND starts_with(path, p)
          QUALIFY row_number() OVER (PARTITION BY n.row_no ORDER BY length(h || p) DESC, length(p) DESC) = 1
        )
        SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM numbered LEFT JOIN fits USING (row_no)
    """,
}
