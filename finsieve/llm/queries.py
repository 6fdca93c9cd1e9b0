"""The registered queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_bpe import byte_bpe
from .chats import CLOSE, OPEN, collapse
from .common import documents
from .exact_dedup import exact_duplicates
from .language_id import language_id
from .packing import pack
from .secrets import find_secrets
from .simhash import simhash_groups
from .toxicity import toxicity
from .url_filter import HOST, filter_captures, host_of
from .vptree import nearest


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(documents(spark, sf_dir))


def op2_vantage_point_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(documents(spark, sf_dir, "embeddings"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(documents(spark, sf_dir))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(documents(spark, sf_dir))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_live", "n_copied")


def op6_chat_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapse(documents(spark, sf_dir, "conversations"))


def _drawn(name: Column) -> Column:
    """A number from 0 to 65535 by a name."""
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, 4), 16, 10).cast("int")


def op7_temporal_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table has neither fetch times nor a list: both are derived, times from page_id, dated entries from the names of hosts and of the domains of two labels."""
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), n)
    pages = documents(spark, sf_dir, "pages").select("page_id", "url", day((F.col("page_id") % 730).cast("int")).alias("fetched_at"))
    hosts = pages.select(host_of(F.col("url")).alias("host")).where("host is not null").distinct()
    domain = F.substring_index("host", ".", -2)
    drawn = hosts.select("host", domain.alias("domain"), _drawn(F.col("host")).alias("v"), _drawn(domain).alias("w"))

    def event(pattern: str, which: str, action: str, at: Column) -> Column:
        return F.when(F.expr(which), F.struct(F.col(pattern).alias("pattern"), F.lit(action).alias("action"), day(at).alias("at")))

    v, w = F.col("v"), F.col("w")
    made = [event("host", "v % 3 <> 0", "add", v % 400), event("host", "v % 3 = 1", "remove", v % 400 + 90), event("host", "v % 6 = 1", "add", v % 400 + 200), event("domain", "w % 5 = 0", "add", w % 600)]
    events = drawn.select(F.inline(F.array_compact(F.array(*made))))
    return filter_captures(pages, events).withColumn("fetched_at", F.col("fetched_at").cast("string"))


def op8_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = toxicity(documents(spark, sf_dir).select("doc_id", "text"), documents(spark, sf_dir, "labels"))
    return judged.select("doc_id", "low_quality_probability", "toxic_probability", "toxic")


def op9_compression_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(documents(spark, sf_dir))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {
    "op1_simhash_near_dedup": op1_simhash_near_dedup,
    "op2_vantage_point_ann": op2_vantage_point_ann,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_secret_scan": op5_secret_scan,
    "op6_chat_snapshots": op6_chat_snapshots,
    "op7_temporal_url_filter": op7_temporal_url_filter,
    "op8_toxicity_chain": op8_toxicity_chain,
    "op9_compression_language_id": op9_compression_language_id,
    "op10_best_fit_packing": op10_best_fit_packing,
}

ORACLES: dict[str, str] = {
    "op2_vantage_point_ann": """
        WITH e AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
            WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
        ), s AS (
            SELECT q.vec_id AS query_id, x.vec_id, list_reduce(list_transform(list_zip(q.v, x.v), lambda p: p[1] * p[2]), lambda a, b: a + b) AS score
            FROM e q JOIN e x ON q.vec_id % 20 = 0 AND q.vec_id <> x.vec_id
        )
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
        FROM s QUALIFY rank <= 20""",
    "op4_exact_dedup": """
        WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
        SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
        FROM n""",
    "op6_chat_snapshots": f"""
        WITH t AS (
            SELECT DISTINCT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL
        ), p AS (
            SELECT conv_id, row_number() OVER w AS n, count(*) OVER (PARTITION BY conv_id) AS n_turns,
                   string_agg(length(r) || ':' || r || length(x) || ':' || x, '') OVER w AS beginning,
                   string_agg('{OPEN}' || r || '|>' || chr(10) || x || '{CLOSE[:-1]}' || chr(10), '') OVER w AS rendered
            FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, r, x ROWS UNBOUNDED PRECEDING)
        ), whole AS (
            SELECT beginning, min(conv_id) AS conv_id, any_value(n_turns) AS n_turns, count(*) AS n_copies, any_value(rendered) AS rendered
            FROM p WHERE n = n_turns GROUP BY beginning
        )
        SELECT conv_id, n_turns, n_copies, rendered FROM whole
        WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.beginning = whole.beginning AND p.n < p.n_turns)""",
    "op7_temporal_url_filter": f"""
        WITH c AS (
            SELECT page_id, CAST(DATE '2024-01-01' + CAST(page_id % 730 AS INTEGER) AS DATE) AS fetched_at,
                   nullif(regexp_replace(regexp_extract(lower(url), '{HOST}', 1), '[.]$', ''), '') AS host
            FROM pages
        ), h AS (
            SELECT host AS pattern, CAST('0x' || substr(md5(host), 1, 4) AS INTEGER) AS v FROM (SELECT DISTINCT host FROM c WHERE host IS NOT NULL)
        ), d AS (
            SELECT pattern, CAST('0x' || substr(md5(pattern), 1, 4) AS INTEGER) AS v
            FROM (SELECT DISTINCT array_to_string(list_slice(string_split(pattern, '.'), -2, -1), '.') AS pattern FROM h)
        ), e AS (
            SELECT pattern, 'add' AS action, v % 400 AS day FROM h WHERE v % 3 <> 0
            UNION SELECT pattern, 'remove', v % 400 + 90 FROM h WHERE v % 3 = 1
            UNION SELECT pattern, 'add', v % 400 + 200 FROM h WHERE v % 6 = 1
            UNION SELECT pattern, 'add', v % 600 FROM d WHERE v % 5 = 0
        ), last AS (SELECT pattern, day, max(action) AS action FROM e GROUP BY pattern, day),
        i AS (SELECT pattern, action, DATE '2024-01-01' + day AS since, DATE '2024-01-01' + lead(day) OVER (PARTITION BY pattern ORDER BY day) AS until FROM last),
        m AS (
            SELECT page_id, max_by(pattern, length(pattern)) AS matched
            FROM c JOIN i ON (host = pattern OR ends_with(host, '.' || pattern)) AND action = 'add' AND fetched_at >= since AND (until IS NULL OR fetched_at < until)
            GROUP BY page_id
        )
        SELECT c.page_id, host, CAST(fetched_at AS VARCHAR) AS fetched_at, matched, matched IS NOT NULL AS blocked FROM c LEFT JOIN m USING (page_id)""",
}
