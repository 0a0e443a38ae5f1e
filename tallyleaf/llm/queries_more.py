"""Registered queries of the miners, the binary output and the manifest, with their SQL twins where SQL can state them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyleaf.llm.queries import query, table

#: CRC-32 of a decimal number in SQL: each byte is taken in, then eight shifts (-1) follow.
SQL_CRC = """CAST(xor(4294967295, list_reduce(flatten([[CAST(4294967295 AS BIGINT)], flatten(list_transform(string_split(CAST({} AS VARCHAR), ''),
    lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))]),
    lambda h, b: CASE WHEN b >= 0 THEN xor(h, b) WHEN h & 1 = 1 THEN xor(h >> 1, 3988292384) ELSE h >> 1 END)) AS BIGINT)"""


def sql_field(column: str) -> str:
    return f"coalesce(strlen(CAST({column} AS VARCHAR)) || ':' || CAST({column} AS VARCHAR), '-')"


SQL_LEAF = "sha256(" + " || ".join(sql_field(c) for c in ("doc_id", "source", "lang", "n_chars")) + " || {})"


def sql_tree(name: str, leaves: str) -> str:
    """Levels of every tree of ``leaves`` (tree, pos, n, h) as table ``name``; a node with siblings or without, one row."""
    return f"""{name} AS (SELECT tree, 0 AS level, pos, n, h FROM {leaves} UNION ALL
        SELECT tree, level + 1, pos // 3, (any_value(n) + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM {name} WHERE n > 1 GROUP BY tree, level, pos // 3)"""


MANIFEST_SQL = f"""
    WITH RECURSIVE d AS (SELECT doc_id, struct_pack(s := source) AS tree, {SQL_LEAF.format(sql_field("text"))} AS h,
            {SQL_LEAF.format(sql_field("CASE WHEN " + SQL_CRC.format("doc_id") + " % 2 = 0 THEN replace(text, chr(10), '') ELSE text END"))} AS changed, source FROM documents),
    a AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, h) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM d),
    {sql_tree("t", "a")},
    tops AS (SELECT tree, h FROM t WHERE n = 1),
    b AS (SELECT 'all' AS tree, tree AS source, h, row_number() OVER (ORDER BY tree.s NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM tops),
    {sql_tree("u", "b")},
    p AS (SELECT a.doc_id, a.h AS leaf, a.source, a.tree, 0 AS level, a.pos, a.n, a.pos AS first, '' AS siblings, a.changed AS folded FROM a UNION ALL
        SELECT p.doc_id, p.leaf, p.source, p.tree, p.level + 1, p.pos // 3, (p.n + 2) // 3, p.first,
            p.siblings || coalesce(string_agg(t.h, '' ORDER BY t.pos) FILTER (t.pos <> p.pos), ''),
            sha256(string_agg(CASE WHEN t.pos = p.pos THEN p.folded ELSE t.h END, '' ORDER BY t.pos))
        FROM p JOIN t ON t.tree = p.tree AND t.level = p.level AND t.pos // 3 = p.pos // 3 WHERE p.n > 1
        GROUP BY p.doc_id, p.leaf, p.source, p.tree, p.level, p.pos, p.n, p.first, p.siblings, p.folded),
    q AS (SELECT p.doc_id, p.leaf, p.first, p.tree AS source, 0 AS level, b.pos, b.n, b.h AS subroot, p.siblings, p.folded FROM p JOIN b ON b.source = p.tree WHERE p.n = 1 UNION ALL
        SELECT q.doc_id, q.leaf, q.first, q.source, q.level + 1, q.pos // 3, (q.n + 2) // 3, q.subroot,
            q.siblings || coalesce(string_agg(u.h, '' ORDER BY u.pos) FILTER (u.pos <> q.pos), ''),
            sha256(string_agg(CASE WHEN u.pos = q.pos THEN q.folded ELSE u.h END, '' ORDER BY u.pos))
        FROM q JOIN u ON u.level = q.level AND u.pos // 3 = q.pos // 3 WHERE q.n > 1
        GROUP BY q.doc_id, q.leaf, q.first, q.source, q.level, q.pos, q.n, q.subroot, q.siblings, q.folded)
    SELECT doc_id, leaf, subroot, (SELECT h FROM u WHERE n = 1) AS root, sha256(siblings) AS proof_sha256, folded AS folded_root,
        folded = (SELECT h FROM u WHERE n = 1) AS verified FROM q WHERE n = 1"""


@query("op13_merkle_manifest", MANIFEST_SQL)
def op13(spark, sf_dir):
    from tallyleaf.llm.manifest import verified_manifest

    return verified_manifest(table(spark, sf_dir, "documents"))


@query("op12_token_files")
def op12(spark, sf_dir):
    import public_tokenizers

    from tallyleaf.llm.token_files import read_token_files, write_token_files
    from tallyleaf.session import scratch_path

    path = scratch_path(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return read_token_files(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query("op11_hard_negatives", """
    WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
        FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(CAST(x AS DOUBLE)))) = len(embedding)),
    s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
        FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
    p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5)
    SELECT p.a AS anchor_id, p.b AS positive_id, CAST(row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) AS INTEGER) AS rank,
        s.b AS negative_id, p.score AS positive_score, s.score AS negative_score
    FROM p JOIN s ON s.a = p.a AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
    QUALIFY row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) <= 3""")
def op11(spark, sf_dir):
    from tallyleaf.llm.hard_negatives import hard_negatives

    return hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
