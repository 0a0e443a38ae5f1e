"""Merkle manifest of a data set: a tree of digests per source, a tree over the sources, and a checked proof per document.

A level is made by a slot pivot: conditional aggregates spread the children of a parent into ``FANOUT`` columns. All columns
joined and hashed are the parent; all but a child's own column are its siblings. Levels are made ``STRETCH`` at a time
over blocks of ``FANOUT ** STRETCH`` neighbouring nodes: rows are shuffled once a stretch on (tree, block), and inside a
block every level groups by a prefix of the same sort order. A hot source is as many blocks as it needs. Paths go down
from the root per block, so what is copied to the leaves never passes a shuffle leaf by leaf.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyleaf.session import scratch_path

FANOUT, STRETCH = 3, 5
PATH = "array<struct<before:string,after:string>>"


def field(value: Column) -> Column:
    """A field as the leaf hashes it: ``-`` for null, else its UTF-8 length, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(text: Column) -> Column:
    return F.sha2(F.concat(field(F.col("doc_id")), field(F.col("source")), field(F.col("lang")), field(F.col("n_chars")), field(text)), 256)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder: later readers neither work them out again nor see another order."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def numbered(rows: DataFrame, tree: str, order: list[str], name: str) -> DataFrame:
    """Adds ``pos``, from 0 in ``order`` within each value of ``tree`` (nulls first), and ``n``, the rows of that value.

    Rows are dealt by ranges of the order and written with their range; each (range, tree) piece is numbered alone and moved
    by the sizes of the pieces before it. Fully equal rows are told apart by where they were read, so even they are dealt evenly.
    """
    ranged = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(tree, *order, "_tie").withColumn("_part", F.spark_partition_id())
    rows = written(ranged, name).withColumn("_piece", F.struct(F.col(tree).alias("tree"), F.col("_part").alias("part")))
    by_tree = Window.partitionBy("_piece.tree")
    before = by_tree.orderBy("_piece.part").rowsBetween(Window.unboundedPreceding, -1)
    pieces = rows.groupBy("_piece").agg(F.count("*").alias("_c")).select(
        "_piece", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"), F.sum("_c").over(by_tree).alias("n"))
    inside = Window.partitionBy("_piece").orderBy(*order, "_tie")
    return rows.join(pieces, "_piece").withColumn("pos", F.row_number().over(inside) - 1 + F.col("_before")).drop("_piece", "_before", "_part", "_tie")


def digit(pos: Column, level: int) -> Column:
    """The slot of the node's ancestor at ``level`` among its siblings."""
    return F.pmod(F.floor(pos / F.lit(FANOUT**level)), F.lit(FANOUT)).cast("int")


def joined(slots: list[Column]) -> Column:
    return F.concat(*[F.coalesce(s, F.lit("")) for s in slots])


def in_blocks(rows: DataFrame) -> DataFrame:
    """The rows dealt by (tree, block), with the slot of each of their ancestors inside the block."""
    block = F.floor(F.col("pos") / F.lit(FANOUT**STRETCH)).cast("bigint")
    slots = [digit(F.col("pos"), k).alias(f"d{k}") for k in range(STRETCH)]
    return rows.select("*", F.struct(F.col("tree"), block.alias("block")).alias("at"), *slots)


def levels_left(level: int) -> Column:
    """Whether a tree of ``n`` nodes still has several of them ``level`` levels up."""
    return F.col("n") > F.lit(FANOUT**level)


def climb(rows: DataFrame) -> DataFrame:
    """``tree, pos, n, digest`` one stretch up: a row for each block."""
    level = in_blocks(rows).repartition("at")
    for k in range(STRETCH):
        slots = [F.max(F.when(F.col(f"d{k}") == i, F.col("digest"))).alias(f"s{i}") for i in range(FANOUT)]
        level = level.groupBy("at", *[f"d{j}" for j in range(STRETCH - 1, k, -1)]).agg(*slots, F.max("n").alias("n"))
        columns = [F.col(f"s{i}") for i in range(FANOUT)]
        level = level.withColumn("digest", F.when(levels_left(k), F.sha2(joined(columns), 256)).otherwise(F.col("s0"))).drop(*[f"s{i}" for i in range(FANOUT)])
    return level.select(F.col("at.tree").alias("tree"), F.col("at.block").alias("pos"), F.ceil(F.col("n") / F.lit(FANOUT**STRETCH)).cast("bigint").alias("n"), "digest")


def descend(rows: DataFrame, above: DataFrame) -> DataFrame:
    """``rows`` with their ``path`` to the top; ``above`` has ``at`` (tree, block) and that block's path, and whatever else is handed down."""
    out = in_blocks(rows).join(above, "at")
    steps = []
    for k in range(STRETCH):
        family = Window.partitionBy("at", *[f"d{j}" for j in range(STRETCH - 1, k, -1)])
        slots = [F.max(F.when(F.col(f"d{k}") == i, F.col("digest"))).over(family) for i in range(FANOUT)]
        out = out.withColumns({f"s{i}": s for i, s in enumerate(slots)})
        columns = [F.col(f"s{i}") for i in range(FANOUT)]
        own = [F.when(F.col(f"d{k}") > i, c) for i, c in enumerate(columns)], [F.when(F.col(f"d{k}") < i, c) for i, c in enumerate(columns)]
        step = F.struct(joined(own[0]).alias("before"), joined(own[1]).alias("after"))
        up = F.when(levels_left(k), F.sha2(joined(columns), 256)).otherwise(F.col("digest"))
        out = out.withColumns({f"step{k}": F.when(levels_left(k), step), "digest": up}).drop(*[f"s{i}" for i in range(FANOUT)])
        steps.append(F.col(f"step{k}"))
    inner = F.filter(F.array(*steps), lambda s: s.isNotNull())
    return out.withColumn("path", F.concat(inner, F.col("path"))).drop("at", "digest", *[f"d{k}" for k in range(STRETCH)], *[f"step{k}" for k in range(STRETCH)])


def grow(rows: DataFrame) -> list[DataFrame]:
    """``rows`` (``tree, pos, n, digest``) and their stretches, the last with one node a tree."""
    stretches, most = [rows], rows.agg(F.max("n")).first()[0] or 0
    while most > 1:
        stretches.append(written(climb(stretches[-1].select("tree", "pos", "n", "digest")), "manifest-level"))
        most = -(-most // FANOUT**STRETCH)
    return stretches


def with_paths(stretches: list[DataFrame], handed: DataFrame, names: list[str]) -> DataFrame:
    """The lowest stretch with its paths: ``handed`` has ``tree``, the path above its root and the columns ``names``."""
    top = stretches[-1].select("tree", "pos").join(handed, "tree")
    below = top.select("tree", F.col("pos").alias("block"), "path", *names)
    for level, rows in enumerate(reversed(stretches[:-1])):
        found = descend(rows, below.select(F.struct("tree", "block").alias("at"), "path", *names))
        if level == len(stretches) - 2:
            return found
        below = found.select("tree", F.col("pos").alias("block"), "path", *names)
    return stretches[0].join(handed, "tree")


def build_manifest(docs: DataFrame) -> DataFrame:
    """``doc_id, source, leaf, changed_leaf, subroot, root, path``: every row's leaf and its siblings up to the root.

    ``docs`` has ``doc_id, source, lang, n_chars, text``; other columns are ignored. ``path`` lists, level by level from the leaf,
    the digests before and after the node among its parent's children, joined; a level where a node has no sibling counts, with
    two empty strings. ``changed_leaf`` is the leaf of the tampered row: where ``doc_id`` is not null and its CRC-32 is even, the text
    without its line feeds; null where that changes nothing. Null values are part of the leaf. Rows of one ``doc_id`` in
    a source are ordered by leaf; fully equal rows have different places but equal leaves, and any assignment of places among
    them is right. A null ``doc_id`` comes first, a null source is a source and the first one. An empty table gives no rows.
    A text is hashed where it is read and never shuffled.
    """
    text = F.col("text")
    hit = (F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(2)) == 0) & F.contains(text, F.lit("\n"))
    changed = F.when(hit, leaf_digest(F.replace(text, F.lit("\n"), F.lit(""))))
    source = F.struct("source").alias("tree")  # a null source joins as a value
    leaves = written(docs.select("doc_id", source, leaf_digest(text).alias("digest"), changed.alias("changed_leaf")), "manifest-leaves")
    leaves = written(numbered(leaves, "tree", ["doc_id", "digest"], "manifest-leaf-ranges"), "manifest-leaf-places")
    sources = grow(leaves)
    roots = sources[-1].select(F.lit("all").alias("tree"), F.col("tree").alias("source"), F.col("digest").alias("digest"))
    over = grow(written(numbered(roots, "tree", ["source"], "manifest-source-ranges"), "manifest-source-places"))
    nothing = F.array().cast(PATH).alias("path")
    # One row: the top of the one tree over all sources.
    top = F.broadcast(over[-1].select("tree", F.col("digest").alias("root"), nothing))
    handed = with_paths(over, top, ["root"]).join(over[0].select("source", F.col("digest").alias("subroot")), "source") if len(over) > 1 else over[0].withColumn("subroot", F.col("digest")).join(top, "tree")
    handed = handed.select(F.col("source").alias("tree"), "path", "root", "subroot")
    found = with_paths([s.withColumn("leaf", F.col("digest")) if i == 0 else s for i, s in enumerate(sources)], handed, ["root", "subroot"])
    return found.select("doc_id", F.col("tree.source").alias("source"), "leaf", "changed_leaf", "subroot", "root", "path")


def proof(path: Column) -> Column:
    """All sibling digests of a path, joined."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), "")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda h, s: F.sha2(F.concat(s["before"], h, s["after"]), 256))


def verified_manifest(docs: DataFrame) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``: each row's proof, checked against the tampered row."""
    again = folded(F.coalesce("changed_leaf", "leaf"), F.col("path"))
    return build_manifest(docs).select("doc_id", "leaf", "subroot", "root", F.sha2(proof(F.col("path")), 256).alias("proof_sha256"), again.alias("folded_root")).withColumn(
        "verified", F.col("folded_root") == F.col("root"))
