"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence matrix.

The incidence matrix is cut into column blocks by n-gram hash. A column block counts in how many distinct sets each
of its n-grams occurs; an n-gram of a single set can never overlap and is left out of everything that follows. Each
row (distinct set) then knows its shared n-grams: with fewer than ``ceil(t * size)`` of them it has no partner, else
any partner must share one of its first ``shared - ceil(t * size) + 1`` n-grams, rarest first. Rows that meet in
such an n-gram form candidate families, and inside a family the product of a row with the family's matrix gives the
exact overlap counts, which are held against the size-derived bound of each pair.

Only links are needed to find components, so a row of the product is computed only while it can still join two
components: rows inside the largest component of their block are put off. The largest can move, so rows put off are
taken up again until all of them lie in the component that is largest at the end; each pair then has a computed end or
lies in that one component. Families above ``FAMILY_ROWS`` rows are cut into blocks that share a few seed rows; afterwards only the
rows outside a family's largest component are held against its other blocks. No pair is ever emitted.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyleaf.llm import textscan as ts
from tallyleaf.llm.components import connected_components
from tallyleaf.session import cut_lineage

WIDTH, PERCENT = 5, 75
BLOCK_BYTES = 8 << 20
FAMILY_ROWS = 8192
SEEDS = 16

GRAM_BYTES = 7
CELLS = "block long, grams binary, places binary, nodes binary, sizes binary"
SHARED = "block long, grams binary, nodes binary, sizes binary, times binary"
SETS = "doc_id long, n_shingles long, node long"
ROWS = "node long, size long, grams binary, prefix array<long>"


def shingles_of(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH):
    """Distinct n-gram hashes of each row as (hashes, row numbers), rows in order, hashes ascending in a row."""
    rows_total = len(offsets) - 1
    starts, ends, row = ts.word_spans(data, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    words = ts.span_hashes(data, starts, ends, lower=True)
    count = ts.per_row(row, rows_total)
    first = np.concatenate([[0], np.cumsum(count)])
    runs = ts.window_hashes(words, width)
    whole = row[: len(runs)] == row[width - 1:]
    grams, owner = runs[whole], row[: len(runs)][whole]
    short = np.flatnonzero((count > 0) & (count < width))
    if len(short):
        extra = []
        for r in short:
            h = np.array([1469598103934665603], dtype=np.uint64)
            for k in range(first[r], first[r + 1]):
                h = ts.mix(h + words[k: k + 1])
            extra.append(h)
        grams = np.concatenate([grams, *extra])
        owner = np.concatenate([owner, short])
        order = np.argsort(owner, kind="stable")
        grams, owner = grams[order], owner[order]
    bounds = np.concatenate([[0], np.cumsum(ts.per_row(owner, rows_total))])
    grams = grams.copy()
    for i in range(rows_total):
        grams[bounds[i]: bounds[i + 1]].sort()
    fresh = np.ones(len(grams), dtype=bool)
    fresh[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
    return grams[fresh], owner[fresh]


def set_keys(grams: np.ndarray, owner: np.ndarray, rows: int):
    """Size and a 63-bit key of each row's set; rows with equal sets agree in both."""
    sizes = ts.per_row(owner, rows)
    key = np.zeros(rows, dtype=np.uint64)
    full = np.flatnonzero(sizes)
    if len(full):
        at = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
        key[full] = ts.mix(np.add.reduceat(ts.mix(grams ^ np.uint64(0x5851F42D4C957F2D)), at) + sizes[full].astype(np.uint64))
    return sizes, (key >> np.uint64(1)).astype(np.int64)


def _scan(batches, make):
    ts.claim("n-grams")
    for batch in batches:
        data, offsets = ts.text_bytes(batch.column("text"))
        for a, b in ts.chunks(offsets):
            part, at = data[offsets[a]: offsets[b]], offsets[a: b + 1] - offsets[a]
            grams, owner = shingles_of(part, at, make.width)
            sizes, keys = set_keys(grams, owner, b - a)
            yield from make(batch, a, b, grams, owner, sizes, keys)


class _Sets:
    def __init__(self, width, carried=("doc_id",)):
        self.width, self.carried = width, carried

    def __call__(self, batch, a, b, grams, owner, sizes, keys):
        yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(a, b - a) for c in self.carried], pa.array(sizes.astype(np.int64)), pa.array(keys)],
                                         [*self.carried, "n_shingles", "node"])


class _Cells:
    """Column cells of a chunk: for each block, the n-grams and the place of each one's set in the cell's list of sets.

    Equal sets of a chunk are written once. N-grams keep their upper 56 bits: in a pair of sets of 500 n-grams a false
    match has a chance of 1 in 10 ** 11.
    """

    def __init__(self, width, blocks):
        self.width, self.blocks = width, blocks

    def __call__(self, batch, a, b, grams, owner, sizes, keys):
        _, kept = np.unique(keys, return_index=True)
        use = np.zeros(b - a, dtype=bool)
        use[kept] = True
        use &= sizes > 0
        mask = use[owner]
        grams, owner = grams[mask], owner[mask]
        if not len(grams):
            return
        order = np.argsort(grams)
        grams, owner = grams[order], owner[order]
        block = (grams >> np.uint64(32)) * np.uint64(self.blocks) >> np.uint64(32)
        edges = np.searchsorted(block, np.arange(self.blocks + 1, dtype=np.uint64))
        out = []
        for k, (i, j) in enumerate(zip(edges[:-1], edges[1:])):
            if i < j:
                rows, place = np.unique(owner[i:j], return_inverse=True)
                out.append((k, grams[i:j].view(np.uint8).reshape(-1, 8)[:, 8 - GRAM_BYTES:].tobytes(), place.astype(np.uint16).tobytes(),
                            keys[rows].tobytes(), sizes[rows].astype(np.int32).tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), *[pa.binary()] * 4))],
                                         ["block", "grams", "places", "nodes", "sizes"])


def _joined(column, dtype):
    return np.frombuffer(b"".join(column.to_pylist()), dtype=dtype)


def _shared_columns(blocks: int):
    """Of a column block: the entries whose n-gram occurs in two sets at least, dealt out by set."""

    def run(table: pa.Table) -> pa.Table:
        ts.claim("n-grams")
        packed = _joined(table["grams"], np.uint8).reshape(-1, GRAM_BYTES)
        grams = np.zeros((len(packed), 8), dtype=np.uint8)
        grams[:, 8 - GRAM_BYTES:] = packed
        grams = grams.view(np.uint64).reshape(-1)
        own = [np.frombuffer(x, dtype=np.uint16) for x in table["places"].to_pylist()]
        nodes = np.concatenate([np.frombuffer(x, dtype=np.int64)[p] for x, p in zip(table["nodes"].to_pylist(), own)])
        sizes = np.concatenate([np.frombuffer(x, dtype=np.int32)[p] for x, p in zip(table["sizes"].to_pylist(), own)])
        order = np.lexsort((sizes, nodes, grams))
        grams, nodes, sizes = grams[order], nodes[order], sizes[order]
        fresh = np.ones(len(grams), dtype=bool)
        fresh[1:] = (grams[1:] != grams[:-1]) | (nodes[1:] != nodes[:-1]) | (sizes[1:] != sizes[:-1])
        grams, nodes, sizes = grams[fresh], nodes[fresh], sizes[fresh]
        start = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]])) if len(grams) else np.zeros(0, np.int64)
        df = np.diff(np.concatenate([start, [len(grams)]]))
        times = np.repeat(df, df).astype(np.int32)
        shared = times > 1
        grams, nodes, sizes, times = grams[shared], nodes[shared], sizes[shared], times[shared]
        to = ((ts.mix(nodes.astype(np.uint64)) >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        grams, nodes, sizes, times, to = grams[order], nodes[order], sizes[order], times[order], to[order]
        edge = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]])) if len(to) else np.zeros(0, np.int64)
        stop = np.concatenate([edge[1:], [len(to)]]).astype(np.int64)
        pick = lambda x: pa.array([x[i:j].tobytes() for i, j in zip(edge, stop)], pa.binary())
        return pa.table({"block": pa.array(to[edge] if len(edge) else [], pa.int64()), "grams": pick(grams), "nodes": pick(nodes),
                         "sizes": pick(sizes), "times": pick(times)})

    return run


def _bounded_rows(percent: int):
    """Of a row block: the sets that can have a partner, with their shared n-grams and the prefix a partner must meet."""

    def run(table: pa.Table) -> pa.Table:
        ts.claim("n-grams")
        grams, nodes = _joined(table["grams"], np.uint64), _joined(table["nodes"], np.int64)
        sizes, times = _joined(table["sizes"], np.int32), _joined(table["times"], np.int32)
        order = np.lexsort((grams, times, sizes, nodes))
        grams, nodes, sizes = grams[order], nodes[order], sizes[order].astype(np.int64)
        start = np.flatnonzero(np.concatenate([[True], (nodes[1:] != nodes[:-1]) | (sizes[1:] != sizes[:-1])])) if len(nodes) else np.zeros(0, np.int64)
        stop = np.concatenate([start[1:], [len(nodes)]]).astype(np.int64)
        shared, size = stop - start, sizes[start] if len(start) else np.zeros(0, np.int64)
        spare = shared - (percent * size + 99) // 100
        keep = spare >= 0
        start, stop, size, spare, node = start[keep], stop[keep], size[keep], spare[keep], nodes[start[keep]] if len(start) else nodes[:0]
        prefix = [grams[i: i + k + 1].view(np.int64) for i, k in zip(start, spare)]
        return pa.table({"node": pa.array(node, pa.int64()), "size": pa.array(size, pa.int64()),
                         "grams": pa.array([np.sort(grams[i:j]).tobytes() for i, j in zip(start, stop)], pa.binary()),
                         "prefix": pa.array(prefix, pa.list_(pa.int64()))})

    return run


class Product:
    """Exact overlaps of one row with all rows of a block, from the block's sparse columns."""

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray):
        self.sets, self.sizes = sets, sizes
        length = np.array([len(s) for s in sets])
        grams, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), length)
        order = np.argsort(grams, kind="stable")
        self.rows = row[order]
        self.columns, self.at = np.unique(grams[order], return_index=True)
        self.at = np.append(self.at, len(grams))

    def linked(self, grams: np.ndarray, size: int, percent: int) -> np.ndarray:
        """Rows of the block with ``100 * overlap >= percent * union``."""
        k = np.searchsorted(self.columns, grams)
        k = k[k < len(self.columns)]
        found = k[np.isin(self.columns[k], grams, assume_unique=True)] if len(k) else k
        if not len(found):
            return np.zeros(0, np.int64)
        first, many = self.at[found], self.at[found + 1] - self.at[found]
        flat = np.repeat(first - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
        overlap = np.bincount(self.rows[flat], minlength=len(self.sizes))
        return np.flatnonzero((overlap > 0) & (100 * overlap >= percent * (size + self.sizes - overlap)))


class Merged:
    """Component labels of a block's rows."""

    def __init__(self, count: int):
        self.parent = list(range(count))
        self.weight = [1] * count
        self.largest = 0

    def root(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = x = self.parent[self.parent[x]]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.root(x), self.root(y)
        if x != y:
            if self.weight[x] < self.weight[y]:
                x, y = y, x
            self.parent[y] = x
            self.weight[x] += self.weight[y]
            if self.weight[x] > self.weight[self.root(self.largest)]:
                self.largest = x


EDGES = "a_node long, a_size long, b_node long, b_size long"


def _block_sets(table: pa.Table):
    return [np.frombuffer(x, dtype=np.uint64) for x in table["grams"].to_pylist()], table["node"].to_numpy(), table["size"].to_numpy()


def _edge_table(pairs, node, size, other=None, other_size=None):
    other, other_size = (node, size) if other is None else (other, other_size)
    a, b = np.array([p[0] for p in pairs], dtype=np.int64), np.array([p[1] for p in pairs], dtype=np.int64)
    return pa.table({"a_node": pa.array(node[a], pa.int64()), "a_size": pa.array(size[a], pa.int64()),
                     "b_node": pa.array(other[b], pa.int64()), "b_size": pa.array(other_size[b], pa.int64())})


def spanning_links(count: int, linked) -> list[tuple[int, int]]:
    """Links that join rows 0..count-1 into the components of ``linked(x)``, which gives all rows linked with row x."""
    merged, pairs, todo = Merged(count), [], list(range(count))
    while todo:
        put_off = []
        for x in todo:
            if x and merged.root(x) == merged.root(merged.largest):
                put_off.append(x)
                continue
            for y in linked(x):
                if merged.root(x) != merged.root(int(y)):
                    merged.join(x, int(y))
                    pairs.append((x, int(y)))
        if len(put_off) == len(todo):
            break
        todo = put_off
    return pairs


def _inside_block(percent: int):
    """A spanning set of links inside one block of a family."""

    def run(table: pa.Table) -> pa.Table:
        ts.claim("n-grams")
        table = table.sort_by([("size", "ascending"), ("node", "ascending")])
        sets, node, size = _block_sets(table)
        product = Product(sets, size)
        pairs = spanning_links(len(sets), lambda x: product.linked(sets[x], int(size[x]), percent))
        return _edge_table(pairs, node, size)

    return run


def _across_blocks(percent: int):
    """Links of a family's rows outside its largest component (right) with the rows of one block (left)."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        pairs = []
        if left.num_rows and right.num_rows:
            sets, node, size = _block_sets(left)
            others, other, other_size = _block_sets(right)
            product = Product(sets, size)
            for x in range(len(others)):
                seen = set()
                for y in product.linked(others[x], int(other_size[x]), percent):
                    label = left["label"][int(y)].as_py()
                    if label not in seen:
                        seen.add(label)
                        pairs.append((int(y), x))
            return _edge_table(pairs, node, size, other, other_size)
        return _edge_table([], np.zeros(0, np.int64), np.zeros(0, np.int64))

    return run


def _key(node: str, size: str):
    return F.struct(F.col(node).alias("node"), F.col(size).alias("size"))


def _components(edges: DataFrame) -> DataFrame:
    keyed = edges.select(_key("a_node", "a_size").alias("a"), _key("b_node", "b_size").alias("b"))
    return connected_components(keyed)


def set_links(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, family_rows: int = FAMILY_ROWS) -> DataFrame:
    """``(node, size, label)`` for every distinct set that has a link; equal labels are one component."""
    spark = docs.sparkSession
    texts = docs.select("text").where("text is not null")
    volume = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(16, -(-volume // BLOCK_BYTES))
    cells = texts.mapInArrow(lambda batches, make=_Cells(width, blocks): _scan(batches, make), CELLS)
    shared = cells.groupBy("block").applyInArrow(_shared_columns(blocks), SHARED)
    rows = cut_lineage(shared.groupBy("block").applyInArrow(_bounded_rows(percent), ROWS))

    entries = rows.select(_key("node", "size").alias("k"), F.explode("prefix").alias("gram"))
    least = entries.groupBy("gram").agg(F.min("k").alias("m"), F.count("*").alias("c")).where("c > 1")
    meet = entries.join(least, "gram").where(F.col("k") != F.col("m")).select(F.col("k").alias("a"), F.col("m").alias("b")).distinct()
    family = connected_components(meet).select("node.node", "node.size", F.col("component").alias("family"))
    family = cut_lineage(family)

    members = rows.select("node", "size", "grams").join(family, ["node", "size"])
    counts = family.groupBy("family").agg(F.count("*").alias("n"))
    large = counts.where(F.col("n") > family_rows)
    if large.limit(1).count() == 0:
        links = cut_lineage(members.withColumn("part", F.lit(0)).groupBy("family", "part").applyInArrow(_inside_block(percent), EDGES))
        found = _components(links)
    else:
        found = _large_families(members, counts, percent, family_rows)
    return found.select("node.node", "node.size", F.col("component").alias("label"))


def _large_families(members: DataFrame, counts: DataFrame, percent: int, family_rows: int) -> DataFrame:
    """The same when some families exceed one block: blocks with shared seeds, then the rows still outside."""
    spread = F.xxhash64("node", "size")
    parts = members.join(counts.select("family", F.ceil(F.col("n") / F.lit(family_rows)).cast("int").alias("parts")), "family")
    parts = parts.withColumn("own", F.pmod(spread, F.col("parts")).cast("int"))
    seeds = counts.where(F.col("n") > family_rows).join(
        members.groupBy("family").agg(F.min_by("node", spread).alias("s1"), F.max_by("node", spread).alias("s2")), "family").select("family", "s1", "s2")
    tagged = parts.join(seeds, "family", "left").withColumn(
        "part", F.explode(F.when((F.col("parts") > 1) & F.col("node").isin(F.col("s1"), F.col("s2")), F.sequence(F.lit(0), F.col("parts") - 1))
                          .otherwise(F.array("own"))))
    rows = tagged.select("family", "part", "node", "size", "grams")
    links = cut_lineage(rows.groupBy("family", "part").applyInArrow(_inside_block(percent), EDGES))
    label = _components(links).select("node.node", "node.size", F.col("component").alias("label"))
    named = parts.where("parts > 1").join(label, ["node", "size"], "left").withColumn("label", F.coalesce("label", _key("node", "size")))
    weights = named.groupBy("family", "label").agg(F.count("*").alias("w"))
    main = weights.groupBy("family").agg(F.max_by("label", F.struct("w", "label")).alias("main"))
    open_rows = named.join(main, "family").where(F.col("label") != F.col("main")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    open_rows = open_rows.withColumn("slice", F.pmod(F.xxhash64("size", "node"), F.col("parts")).cast("int"))
    slices = open_rows.select("family", "part", "slice").distinct()
    left = named.withColumnRenamed("own", "part").join(slices, ["family", "part"])
    keep = ["family", "part", "slice", "node", "size", "grams", F.col("label").cast("string").alias("label")]
    names = ["family", "part", "slice", "node", "size", "grams", "label"]
    across = left.select(*keep).toDF(*names).groupBy("family", "part", "slice").cogroup(
        open_rows.select(*keep).toDF(*names).groupBy("family", "part", "slice")).applyInArrow(_across_blocks(percent), EDGES)
    return _components(links.union(across))


def near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, family_rows: int = FAMILY_ROWS) -> DataFrame:
    """``doc_id, n_shingles, component_id``: one row per row of ``docs`` (which needs ``doc_id`` and ``text``).

    A set is the distinct lower-cased (A-Z) word 5-grams, or the whole sequence where there are fewer words. Two
    documents link when ``100 * overlap >= percent * union``; the component is the smallest ``doc_id`` reachable.
    Null, empty and blank texts have size 0, link with nothing and are their own component. Rows that repeat a text
    share a component; rows that repeat a ``doc_id`` with other texts each count with their own text; a null
    ``doc_id`` takes part in links but never names a component (null where nothing else is reachable). Other columns
    are ignored whatever their names. An empty table gives no rows.
    """
    docs = docs.select("doc_id", "text")
    sets = docs.mapInArrow(lambda batches, make=_Sets(width): _scan(batches, make), SETS)
    sets = cut_lineage(sets)
    label = set_links(docs, width, percent, family_rows)
    classes = sets.where("n_shingles > 0").groupBy("node", F.col("n_shingles").alias("size")).agg(F.min("doc_id").alias("least"))
    classes = classes.join(label, ["node", "size"], "left").withColumn("label", F.coalesce("label", _key("node", "size")))
    names = classes.groupBy("label").agg(F.min("least").alias("component_id"))
    named = classes.join(names, "label").select("node", F.col("size").alias("n_shingles"), "component_id")
    empty = sets.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return sets.where("n_shingles > 0").join(named, ["node", "n_shingles"]).select("doc_id", "n_shingles", "component_id").union(empty)


def one_of_each_group(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, family_rows: int = FAMILY_ROWS) -> DataFrame:
    """The rows of ``docs`` that stay when each component of ``near_duplicates`` keeps one: the smallest ``doc_id`` (null last), then text.

    Groups go by the texts, so ``doc_id`` need not be a key: rows that repeat one with unrelated texts all stay, and rows without
    one are grouped like the others. A text without words resembles nothing: one stays for each ``doc_id``, and all without one.
    """
    wordless = ~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    text_key, null_id = F.md5(F.coalesce("text", F.lit(""))), F.col("doc_id").isNull()
    keyed = docs.select("doc_id", "text", text_key.alias("text_key")).where(~(null_id & wordless))
    make = _Sets(width, ("doc_id", "text_key"))
    sets = cut_lineage(keyed.mapInArrow(lambda batches, make=make: _scan(batches, make), "doc_id long, text_key string, n_shingles long, node long"))
    sets = sets.withColumn("node", F.when(F.col("n_shingles") > 0, F.col("node")).otherwise(F.col("doc_id")))
    label = set_links(docs, width, percent, family_rows)
    classes = sets.groupBy("node", F.col("n_shingles").alias("size")).agg(F.min(F.struct(null_id.alias("none"), F.col("doc_id").alias("id"))).alias("least"))
    classes = classes.join(label, ["node", "size"], "left").withColumn("label", F.coalesce("label", _key("node", "size")))
    heads = classes.groupBy("label").agg(F.min("least").alias("head"))
    named = classes.join(heads, "label").select("node", F.col("size").alias("n_shingles"), "label", "head")
    first = sets.join(named, ["node", "n_shingles"]).where(F.col("doc_id").eqNullSafe(F.col("head.id")))
    first = first.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_text_key"), F.col("label").alias("_label")).distinct()
    rows = docs.where(~(null_id & wordless)).select(text_key.alias("_own_key"), F.struct("text", *[c for c in docs.columns if c != "text"]).alias("_row"))
    rows = rows.join(first, (F.col("_own_key") == F.col("_text_key")) & F.col("_row.doc_id").eqNullSafe(F.col("_id")))
    kept = rows.groupBy("_label").agg(F.min("_row").alias("_row")).select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])
    return kept.union(docs.where(null_id & wordless))
