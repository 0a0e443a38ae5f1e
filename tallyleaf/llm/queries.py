"""Registered queries of the operators, over the whole of their tables, with their SQL twins where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyleaf.llm.licences import scan_licences, scan_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The words of a text, lower-cased or as they stand, in SQL.
SQL_WORDS = "list_filter(string_split_regex({}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@query("op3_ngram_jaccard_join", f"""
    WITH RECURSIVE w AS (SELECT doc_id, {SQL_WORDS.format(f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')")} AS ws FROM documents),
    s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
        ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g FROM w),
    e AS (SELECT doc_id, len(g) AS n, unnest(g) AS g FROM s),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id
        GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
    r AS (SELECT DISTINCT a AS node, a AS root FROM p UNION SELECT p.b, r.root FROM r JOIN p ON p.a = r.node)
    SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, coalesce(c.component_id, s.doc_id) AS component_id
    FROM s LEFT JOIN (SELECT node, min(root) AS component_id FROM r GROUP BY node) c ON c.node = s.doc_id""")
def op3(spark, sf_dir):
    from tallyleaf.llm.ngram_join import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


@query("op6_sentencepiece")
def op6(spark, sf_dir):
    from tallyleaf.llm.piece_transducer import encode_documents

    encoded = encode_documents(table(spark, sf_dir, "documents"), piece_model())
    digest = F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256)
    return encoded.select("doc_id", "n_tokens", digest.alias("ids_sha256"), "round_trip")


@query("op7_token_counts")
def op7(spark, sf_dir):
    from tallyleaf.llm.token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), piece_model())


@query("op8_source_mixing", f"""
    WITH d AS (SELECT doc_id, source, md5('mix' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS o,
        CAST(len({SQL_WORDS.format("coalesce(text, '')")}) AS BIGINT) AS size FROM documents),
    s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
    w AS (SELECT *, 3 * source_size AS cap, CAST(([5, 2, 1])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS BIGINT) AS weight FROM s),
    q AS (SELECT *, CAST(sum(source_size) OVER () AS BIGINT) AS total,
        sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
        sum(weight) OVER (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS shares FROM w),
    c AS (SELECT *, cap * shares <= rest * weight AS capped FROM q),
    t AS (SELECT source, source_size, CASE WHEN capped THEN cap::DOUBLE ELSE
        CAST((total - coalesce(sum(cap) FILTER (capped) OVER (), 0)) * weight AS DOUBLE) / sum(weight) FILTER (NOT capped) OVER () END AS target FROM c),
    a AS (SELECT d.*, t.source_size, t.target, CAST(floor(t.target) AS BIGINT) AS budget,
        CAST(sum(size) OVER (PARTITION BY d.source ORDER BY o, size ROWS UNBOUNDED PRECEDING) - size AS BIGINT) AS before
        FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
    SELECT doc_id, size, source_size, target, greatest(0, least(size, budget - before)) + greatest(0, least(size, budget - before - source_size))
        + greatest(0, least(size, budget - before - 2 * source_size)) AS taken FROM a""")
def op8(spark, sf_dir):
    from tallyleaf.llm.mixing import mixed_sizes

    return mixed_sizes(table(spark, sf_dir, "documents"))


@query("op10_personal_data")
def op10(spark, sf_dir):
    from tallyleaf.llm.pii import find_personal_data

    return find_personal_data(table(spark, sf_dir, "documents"))


@query("op4_quality_rules")
def op4(spark, sf_dir):
    from tallyleaf.llm.quality import quality_verdicts

    return quality_verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op9_language_id")
def op9(spark, sf_dir):
    from tallyleaf.llm.language_profiles import language_of_documents

    return language_of_documents(table(spark, sf_dir, "documents"))


@query("op2_nearest_neighbours")
def op2(spark, sf_dir):
    from tallyleaf.llm.neighbours import nearest_neighbours

    return nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@query("op1_license_scan", scan_sql())
def op1(spark, sf_dir):
    return scan_licences(table(spark, sf_dir, "documents"))


@query("op5_chat_formatting")
def op5(spark, sf_dir):
    from tallyleaf.llm.transcripts import format_conversations

    return format_conversations(table(spark, sf_dir, "conversations"))


from tallyleaf.llm import queries_more  # noqa: E402,F401  registers its queries
