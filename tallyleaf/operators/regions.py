"""Text regions of pages: overlap, reading order, lines, tables, layout.

A page's regions come from one recognised page, so a page is a small unit; work that would be quadratic in it is
first cut into clusters that cannot touch each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyleaf import fixed_values as fv
from tallyleaf.operators.scale import join_keys

BOX =("x1", "y1", "x2", "y2")


def iou(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Intersection over union of two boxes; 0 when they do not overlap."""
    w = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
    h = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
    inter = w * h
    union = (a["x2"] - a["x1"]) * (a["y2"] - a["y1"]) + (b["x2"] - b["x1"]) * (b["y2"] - b["y1"]) - inter
    return F.when((w <= 0) | (h <= 0) | (union <= 0), F.lit(0.0)).otherwise(inter / union)


def box(prefix: str = "") -> dict[str, Column]:
    return {c: F.col(prefix + c) for c in BOX}


def drop_weak(regions: DataFrame, page: str = "doc_id", floor: float = 0.15) -> DataFrame:
    """Drop regions under the floor, but keep a page's best region when all are under it.

    The page's best is a combinable maximum joined back; no page is sorted. Regions with a null page form a page.
    """
    best = regions.groupBy(page).agg(F.max_by("region_id", F.struct("confidence", F.negate("region_id"))).alias("_best"),
                                     F.max("confidence").alias("_top"))
    joined = join_keys(regions, best, [page])
    keep = (F.col("confidence") >= floor) | ((F.col("_top") < floor) & (F.col("region_id") == F.col("_best")))
    return joined.where(keep).drop("_best", "_top")


def watermark_regions(regions: DataFrame, threshold: float = 0.9) -> DataFrame:
    """Regions that look like a watermark, with the reason."""
    low = F.lower("text")
    word = low.contains(fv.WATERMARK_WORDS[0])
    for w in fv.WATERMARK_WORDS[1:]:
        word = word | low.contains(w)
    weak = F.coalesce(F.nullif("confidence", F.lit(0.0)), F.lit(1.0)) < threshold
    reason = F.when(word, "keyword_match").when(weak, "low_confidence")
    return regions.withColumn("reason", reason).where(F.col("reason").isNotNull())


def center_inside(regions: DataFrame, areas: DataFrame, page: str = "doc_id", how: str = "inner", cell: int = 256) -> DataFrame:
    """Regions whose centre lies in an area of the same page (inclusive). ``left_anti`` keeps those in none.

    An area is listed in the grid cells it covers and a centre looks into its own cell only.
    """
    cx, cy = (F.col("r.x1") + F.col("r.x2")) / 2, (F.col("r.y1") + F.col("r.y2")) / 2
    placed = regions.withColumn("_gx", F.floor((F.col("x1") + F.col("x2")) / 2 / cell).cast("bigint")).withColumn(
        "_gy", F.floor((F.col("y1") + F.col("y2")) / 2 / cell).cast("bigint"))
    listed = _cells(areas, cell)
    inside = ((F.col(f"r.{page}") == F.col(f"a.{page}")) & (F.col("r._gx") == F.col("a._gx")) & (F.col("r._gy") == F.col("a._gy"))
              & (cx >= F.col("a.x1")) & (cx <= F.col("a.x2")) & (cy >= F.col("a.y1")) & (cy <= F.col("a.y2")))
    joined = placed.alias("r").join(listed.alias("a"), inside, how)
    own = [F.col(f"r.{c}") for c in regions.columns]
    return joined.select(*regions.columns) if how in ("left_anti", "left_semi") else joined.select(*own, F.col("a.area_id"))


def _cells(df: DataFrame, cell: int) -> DataFrame:
    def span(lo, hi):
        return F.sequence(F.floor(F.col(lo) / cell).cast("bigint"), F.floor(F.col(hi) / cell).cast("bigint"))

    return df.withColumn("_gx", F.explode(span("x1", "x2"))).withColumn("_gy", F.explode(span("y1", "y2")))


def overlapping_pairs(a: DataFrame, b: DataFrame, threshold: float, page: str = "doc_id", cell: int = 256) -> DataFrame:
    """Pairs of distinct boxes (a, b) of a page with IoU above the threshold, found through grid cells.

    A pair is counted in one cell only: the cell that holds the corner where the two boxes begin to overlap.
    """
    left = _cells(a.select(page, F.col("region_id"), *BOX), cell)
    right = _cells(b.select(page, F.col("region_id"), *BOX), cell)
    right = right.select(page, "_gx", "_gy", F.col("region_id").alias("b_id"), *[F.col(c).alias(f"b_{c}") for c in BOX])
    joined = left.join(right, [page, "_gx", "_gy"])
    first = ((F.col("_gx") == F.floor(F.greatest("x1", "b_x1") / cell)) & (F.col("_gy") == F.floor(F.greatest("y1", "b_y1") / cell)))
    return joined.where(first & (iou(box(), box("b_")) > threshold)).select(page, F.col("region_id").alias("a_id"), "b_id")


def merge_passes(a: DataFrame, b: DataFrame, threshold: float = 0.3, page: str = "doc_id", cell: int = 256) -> DataFrame:
    """All boxes of pass A and those of pass B that overlap none of A; copies of a box in A are joined once."""
    distinct = a.select(page, *BOX).distinct().withColumn("region_id", F.lit(0))
    taken = overlapping_pairs(distinct, b, threshold, page, cell).select(page, F.col("b_id").alias("region_id")).distinct()
    return a.unionByName(b.join(taken, [page, "region_id"], "left_anti"))


def touching_clusters(regions: DataFrame, page: str = "doc_id") -> DataFrame:
    """Number vertical clusters of a page's boxes; boxes of different clusters cannot overlap."""
    w = Window.partitionBy(page).orderBy("y1", "region_id")
    reach = F.max("y2").over(w.rowsBetween(Window.unboundedPreceding, -1))
    apart = F.coalesce((F.col("y1") >= reach).cast("int"), F.lit(0))
    return regions.withColumn("_apart", apart).withColumn("cluster", F.sum("_apart").over(w)).drop("_apart")


def suppress_overlaps(regions: DataFrame, threshold: float = 0.5, page: str = "doc_id", same_text: bool = False) -> DataFrame:
    """Greedy suppression: best confidence first, drop a box that overlaps a kept one above the threshold.

    Runs per cluster of touching boxes. With ``same_text`` only boxes of equal trimmed text suppress each other, and
    boxes without text are dropped.
    """
    if same_text:
        regions = regions.withColumn("_trimmed", F.trim("text")).where("_trimmed <> ''")
        return suppress_within(regions, threshold, page, [page, "cluster", "_trimmed"]).drop("_trimmed")
    return suppress_within(regions, threshold, page, [page, "cluster"])


def suppress_within(regions: DataFrame, threshold: float, page: str, keys: list[str]) -> DataFrame:
    item = F.struct(F.negate("confidence").alias("o"), "region_id", *BOX)
    grouped = touching_clusters(regions, page).groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("boxes"))
    kept = F.aggregate("boxes", F.slice("boxes", 1, 0), lambda acc, b: F.when(
        F.exists(acc, lambda k: iou({c: k[c] for c in BOX}, {c: b[c] for c in BOX}) > threshold), acc).otherwise(F.array_append(acc, b)))
    ids = grouped.select(page, F.explode(F.transform(kept, lambda k: k["region_id"])).alias("region_id"))
    return regions.join(ids, [page, "region_id"], "left_semi")


def reading_order(regions: DataFrame, page: str = "doc_id") -> DataFrame:
    """Line number and order: a new line starts when the centre drops by more than half the region's height."""
    cy, cx = (F.col("y1") + F.col("y2")) / 2.0, (F.col("x1") + F.col("x2")) / 2.0
    w = Window.partitionBy(page).orderBy("_cy", "region_id")
    fresh = F.coalesce((F.col("_cy") - F.lag("_cy").over(w) > F.greatest(F.col("y2") - F.col("y1"), F.lit(1)) * 0.5).cast("int"), F.lit(0))
    lined = regions.withColumn("_cy", cy).withColumn("_cx", cx).withColumn("_new", fresh)
    lined = lined.withColumn("line_no", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)) + 1)
    order = Window.partitionBy(page).orderBy("line_no", "_cx", "region_id")
    return lined.withColumn("position", F.row_number().over(order)).drop("_cy", "_cx", "_new")


def assemble_pages(ordered: DataFrame, page: str = "doc_id") -> DataFrame:
    """Text in reading order and mean confidence per page."""
    item = F.struct("position", F.trim("text").alias("t"))
    texts = F.filter(F.transform(F.array_sort(F.collect_list(item)), lambda s: s["t"]), lambda t: t != "")
    return ordered.groupBy(page).agg(F.array_join(texts, "\n").alias("page_text"), F.avg("confidence").alias("confidence"), F.count("*").alias("regions"))


def label_values(regions: DataFrame, page: str = "doc_id", line_gap: int = 20) -> DataFrame:
    """label: value pairs of a page's lines; the first value of each field wins.

    Lines break at a jump of more than ``line_gap`` between neighbouring centres. Labels match by prefix or part,
    in the order of the label list.
    """
    cy = (F.col("y1") + F.col("y2")) / 2.0
    w = Window.partitionBy(page).orderBy("_cy", "region_id")
    fresh = F.coalesce((F.abs(F.col("_cy") - F.lag("_cy").over(w)) > line_gap).cast("int"), F.lit(0))
    lined = regions.withColumn("_cy", cy).withColumn("_new", fresh)
    lined = lined.withColumn("line_no", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    item = F.struct("x1", "region_id", F.trim("text").alias("t"))
    words = F.filter(F.transform(F.array_sort(F.collect_list(item)), lambda s: s["t"]), lambda t: t != "")
    lines = lined.groupBy(page, "line_no").agg(F.array_join(words, " ").alias("line"))
    pattern = r"^([^:：]+)[:：]\s*(.+)$"
    label, value = F.lower(F.trim(F.regexp_extract("line", pattern, 1))), F.trim(F.regexp_extract("line", pattern, 2))
    chain = None
    for key, field in fv.LABEL_FIELDS.items():
        chain = F.when(F.col("label").contains(key), field) if chain is None else chain.when(F.col("label").contains(key), field)
    pairs = lines.withColumn("label", label).withColumn("value", value).where("label <> ''").withColumn("field", chain)
    return pairs.where(F.col("field").isNotNull()).groupBy(page, "field").agg(
        F.min_by("value", "line_no").alias("value"), F.min("line_no").alias("line_no"))


def paragraph_text(regions: DataFrame, page: str = "doc_id", factor: float = 1.5) -> DataFrame:
    """Page text from top to bottom with an empty line before a paragraph, and the indented form."""
    w = Window.partitionBy(page).orderBy("y1", "region_id")
    gap = F.col("y1") - F.lag("y1").over(w)
    fresh = F.coalesce(gap > (F.col("y2") - F.col("y1")) * factor, F.lit(False))
    rows = regions.withColumn("_p", fresh).where("text <> ''")
    item = F.struct("y1", "region_id", F.when(F.col("_p"), F.concat(F.lit("\n"), "text")).otherwise(F.col("text")).alias("t"),
                    F.concat(F.repeat(F.lit(" "), F.floor(F.col("x1") / 10).cast("int")), "text").alias("i"))
    sorted_items = F.array_sort(F.collect_list(item))
    return rows.groupBy(page).agg(
        F.array_join(F.transform(sorted_items, lambda s: s["t"]), "\n").alias("paragraphs"),
        F.array_join(F.transform(sorted_items, lambda s: s["i"]), "\n").alias("indented"),
        F.count_if("_p").alias("breaks"))


def layout_kind(regions: DataFrame, page: str = "doc_id", threshold: float = 100.0) -> DataFrame:
    """Single or multiple columns by the spread of the x centres."""
    spread = F.stddev_pop((F.col("x1") + F.col("x2")) / 2)
    return regions.groupBy(page).agg(spread.alias("x_spread")).withColumn(
        "layout", F.when(F.col("x_spread") > threshold, "multi_column").otherwise("single_column"))


def table_text(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Rebuild tables from cells: columns padded to their widest text, rows joined by ' | '.

    A grid position without a cell is empty; the widths come from a combinable maximum per column.
    """
    widths = cells.groupBy(*keys, "col").agg(F.max(F.length("text")).alias("width"))
    grid = cells.select(*keys, "row").distinct().join(widths, keys)
    filled = grid.join(cells, keys + ["row", "col"], "left")
    padded = F.rpad(F.coalesce("text", F.lit("")), F.col("width"), F.lit(" "))
    rows = filled.groupBy(*keys, "row").agg(F.array_sort(F.collect_list(F.struct("col", padded.alias("t")))).alias("r"))
    line = F.array_join(F.transform("r", lambda s: s["t"]), " | ")
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("row", line.alias("t")))).alias("l"), F.count("*").alias("rows")).select(
        *keys, "rows", F.array_join(F.transform("l", lambda s: s["t"]), "\n").alias("table_text"))


def chosen_table(cells: DataFrame, keys: list[str], words: tuple = fv.TABLE_WORDS) -> DataFrame:
    """One table of each page: the first that holds one of ``words``, else that with the most cells (ties to the first).

    ``cells`` holds table_no and text; both choices are combinable minima and maxima, no page is gathered.
    """
    hit = None
    for w in words:
        test = F.col("text").contains(w)
        hit = test if hit is None else hit | test
    tables = cells.groupBy(*keys, "table_no").agg(F.count("*").alias("cells"), F.coalesce(F.bool_or(hit), F.lit(False)).alias("named"))
    first = F.min(F.when(F.col("named"), F.struct("table_no", "cells")))
    best = F.max(F.struct("cells", F.negate("table_no").alias("n")))
    return tables.groupBy(*keys).agg(first.alias("f"), best.alias("b")).select(
        *keys, F.coalesce("f.table_no", F.negate(F.col("b.n"))).alias("table_no"), F.coalesce("f.cells", "b.cells").alias("cells"), F.col("f").isNotNull().alias("named"))


def merge_close_lines(coords: Column, threshold: int = 5) -> Column:
    """Keep a coordinate only when it lies more than ``threshold`` beyond the last kept one."""
    return F.aggregate(F.array_sort(coords), F.slice(coords, 1, 0), lambda acc, c: F.when(
        (F.size(acc) == 0) | (c - F.element_at(acc, -1) > threshold), F.array_append(acc, c)).otherwise(acc))


def assign_columns(regions: DataFrame, page: str = "doc_id", most_rounds: int = 100, at_once: int = 100_000) -> DataFrame:
    """Column of each region by one-dimensional k-means with quantile seeds; k grows until the inertia is small.

    A page that has not settled after ``most_rounds`` rounds is an error. Pages are worked out together, about ``at_once`` regions at a time.
    """
    def page_columns(x: np.ndarray, sizes: np.ndarray, names: list) -> np.ndarray:
        """Column of each x centre of many pages at once; ``sizes`` holds each page's number of centres, which stand page by page."""
        start, page = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(sizes)), sizes)
        ordered, labels, open_pages = x[np.lexsort((x, page))], np.zeros(len(x), dtype="int64"), np.arange(len(sizes))
        for k in range(2, 6):
            open_pages = open_pages[sizes[open_pages] >= k]
            if not len(open_pages):
                break
            # Quantiles of each page, between two of its centres in order.
            n, first = sizes[open_pages][:, None], start[open_pages][:, None]
            at = (n - 1) * ((np.arange(k) + 0.5) / k)
            below = np.floor(at).astype("int64")
            a, b, t = ordered[first + below], ordered[first + np.minimum(below + 1, n - 1)], at - below
            centers = np.where(t >= 0.5, b - (b - a) * (1 - t), a + (b - a) * t)
            slots = np.full(len(sizes), -1)
            slots[open_pages] = np.arange(len(open_pages))
            rows = np.flatnonzero(slots[page] >= 0)
            slot, value = slots[page[rows]], x[rows]
            # Pages leave as they settle; ``moving`` are those left, ``own`` the place there of each of their centres.
            moving, own, left = np.arange(len(open_pages)), slot, value
            for _ in range(most_rounds):
                now = centers[moving]
                cell = own * k + np.abs(left[:, None] - now[own]).argmin(axis=1)
                count = np.bincount(cell, minlength=now.size).reshape(now.shape)
                moved = np.where(count > 0, np.bincount(cell, left, now.size).reshape(now.shape) / np.maximum(count, 1), now)
                on = ~np.isclose(moved, now, atol=1e-9).all(axis=1)
                moving, stays = moving[on], on[own]
                if not len(moving):
                    break
                centers[moving] = moved[on]
                own, left = (np.cumsum(on) - 1)[own[stays]], left[stays]
            else:
                raise RuntimeError(f"columns of page {names[open_pages[moving[0]]]} did not settle in {most_rounds} rounds")
            near = np.abs(value[:, None] - centers[slot]).argmin(axis=1)
            tight = np.bincount(slot, (value - centers[slot, near]) ** 2, len(open_pages)) < sizes[open_pages] * 100
            rank = centers.argsort(axis=1, kind="stable").argsort(axis=1, kind="stable")
            labels[rows] = np.where(tight[slot], rank[slot, near], 0)
            open_pages = open_pages[~tight]
        return labels

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, lists = batch.column(0), batch.column(1)
            ends = np.cumsum(np.diff(lists.offsets.to_numpy()))
            row = 0
            while row < len(ends):
                done = ends[row - 1] if row else 0
                upto = max(row + 1, int(np.searchsorted(ends, done + at_once, "right")))
                sizes = np.diff(ends[row:upto], prepend=done)
                item, part = lists.slice(row, upto - row).flatten(), names.slice(row, upto - row)
                x = item.field("x").to_numpy(zero_copy_only=False).astype("float64")
                columns = page_columns(x, sizes, part.to_pylist())
                yield pa.RecordBatch.from_arrays([part.take(pa.array(np.repeat(np.arange(len(part)), sizes))), item.field("region_id"), pa.array(columns)], [page, "region_id", "column_no"])
                row = upto

    centre = ((F.col("x1") + F.col("x2")) / 2.0).alias("x")
    pages = regions.groupBy(F.col(page).cast("bigint").alias(page)).agg(F.collect_list(F.struct(centre, F.col("region_id").cast("bigint").alias("region_id"))).alias("r"))
    return pages.mapInArrow(fit, f"{page} bigint, region_id bigint, column_no bigint")


def exact_columns(regions: DataFrame, page: str = "doc_id", most: int = 5, spread: float = 100.0) -> DataFrame:
    """``page, region_id, column_no, columns``: the best cut of each page's x centres into columns, numbered from the left.

    For one dimension the best groups are runs of the sorted centres, so the least sum of squares for k groups follows from that for k - 1
    by trying every last cut; the smallest k from 2 to ``most`` whose sum lies under ``spread`` a region is taken, else one column. Exact, without
    seeds or rounds, and all in expressions over one array a page (a page is assumed to be a page). Of equal cuts the one furthest left counts; of
    equal centres those at a cut are told apart by ``region_id``.
    """
    centre = (F.col("x1") + F.col("x2")) / 2.0
    pages = regions.groupBy(page).agg(F.sort_array(F.collect_list(F.struct(centre.alias("x"), "region_id"))).alias("r"))
    zero = F.array(F.lit(0.0))
    pages = pages.withColumn("n", F.size("r"))
    # Running sums of the centres and of their squares.
    pages = pages.withColumn("p", F.aggregate("r", zero, lambda acc, s: F.concat(acc, F.array(F.element_at(acc, -1) + s["x"]))))
    pages = pages.withColumn("q", F.aggregate("r", zero, lambda acc, s: F.concat(acc, F.array(F.element_at(acc, -1) + s["x"] * s["x"]))))

    def scatter(a: Column, b: Column) -> Column:
        """Sum of squares of the centres from place a (from 0) up to b, b left out."""
        total = F.get("p", b) - F.get("p", a)
        return F.get("q", b) - F.get("q", a) - total * total / (b - a)

    no_cut = F.lit(0).cast("int")
    best = F.transform(F.sequence(F.lit(0), F.col("n")), lambda j: F.when(j > 0, F.struct(scatter(no_cut, j).alias("s"), F.array().cast("array<int>").alias("cuts"))))
    pages = pages.withColumn("b1", best)

    def layer(k: int) -> Column:
        """Best cuts into k groups of the first j centres, for every j."""
        def best_last(j: Column) -> Column:
            ways = F.transform(F.sequence(F.lit(k - 1), j - 1), lambda i: F.struct(
                (F.get(f"b{k - 1}", i)["s"] + scatter(i, j)).alias("s"), F.concat(F.get(f"b{k - 1}", i)["cuts"], F.array(i)).alias("cuts")))
            return F.when(j >= k, F.array_min(ways))

        return F.transform(F.sequence(F.lit(0), F.col("n")), best_last)

    for k in range(2, most + 1):
        pages = pages.withColumn(f"b{k}", layer(k))
    fits = [F.when(F.get(f"b{k}", F.col("n"))["s"] < F.col("n") * spread, F.get(f"b{k}", F.col("n"))["cuts"]) for k in range(2, most + 1)]
    cuts = F.coalesce(*fits, F.array().cast("array<int>"))
    rows = pages.select(page, cuts.alias("cuts"), F.posexplode("r").alias("place", "r"))
    return rows.select(page, "r.region_id", F.size(F.filter("cuts", lambda c: c <= F.col("place"))).cast("bigint").alias("column_no"), (F.size("cuts") + 1).cast("bigint").alias("columns"))


def vector_clusters(vectors: DataFrame, k: int, seed: int = 7, rounds: int = 40) -> DataFrame:
    """``vec_id, cluster, distance``: k-means over the embeddings of one length, scaled to unit length, from fixed seeds.

    Null vectors and those with a null component take no part. The centres (k vectors) are all that reaches the driver.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import Normalizer
    from pyspark.ml.functions import array_to_vector, vector_to_array

    usable = vectors.where(F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull())).select(
        "vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("raw"))
    model = Pipeline(stages=[Normalizer(inputCol="raw", outputCol="unit"), KMeans(k=k, seed=seed, maxIter=rounds, featuresCol="unit", predictionCol="cluster")]).fit(usable)
    centres = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in model.stages[-1].clusterCenters()])
    apart = F.zip_with(vector_to_array("unit"), F.get(centres, F.col("cluster")), lambda a, b: (a - b) * (a - b))
    return model.transform(usable).select("vec_id", "cluster", F.sqrt(F.aggregate(apart, F.lit(0.0), lambda t, x: t + x)).alias("distance"))


def block_counts(blocks: DataFrame, page: str = "doc_id") -> DataFrame:
    """Blocks per type and page."""
    return blocks.groupBy(page).pivot("type", ["text", "table", "seal", "chart", "formula", "image"]).agg(F.count(F.lit(1))).na.fill(0)


def page_markdown(blocks: DataFrame, page: str = "doc_id") -> DataFrame:
    """Markdown of a page from its blocks, from top to bottom."""
    c = F.col("content")
    mark = (
        F.when((F.col("type") == "text") & (F.col("category") == "title"), F.concat(F.lit("\n## "), c, F.lit("\n")))
        .when((F.col("type") == "text") & (F.col("category") == "list"), F.concat(F.lit("- "), c))
        .when(F.col("type") == "text", F.concat(c, F.lit("\n")))
        .when(F.col("type") == "table", F.concat(F.lit("\n### 表格\n\n"), c, F.lit("\n")))
        .when(F.col("type") == "seal", F.concat(F.lit("\n> **印章**: "), c, F.lit("\n")))
        .when(F.col("type") == "chart", F.concat(F.lit("\n### 图表\n\n"), c, F.lit("\n")))
        .when(F.col("type") == "formula", F.concat(F.lit("\n$$ "), c, F.lit(" $$\n")))
    )
    rows = blocks.withColumn("_m", mark).where(F.col("_m").isNotNull())
    item = F.array_sort(F.collect_list(F.struct("y1", "region_id", "_m")))
    return rows.groupBy(page).agg(F.array_join(F.transform(item, lambda s: s["_m"]), "\n").alias("markdown"))


def banded(value: Column, bands: list[tuple], otherwise: int, holds) -> Column:
    """Points of the first band, in order, that the value lies in."""
    points = F.lit(otherwise)
    for edge, given in reversed(bands):
        points = F.when(holds(value, edge), given).otherwise(points)
    return points


def quality_route(metrics: DataFrame) -> DataFrame:
    """Page quality score and route from a table of image measurements."""
    side, bright = F.least("width", "height"), F.col("brightness")
    sharp, edge = F.col("sharpness"), F.col("edge_energy")
    light = F.lit(5)
    for low, high, points in reversed(fv.LIGHT_BANDS):
        light = F.when(bright.between(low, high), points).otherwise(light)
    score = (banded(side, fv.SIDE_BANDS, 0, lambda c, x: c >= x) + banded(sharp, fv.SHARPNESS_BANDS, 0, lambda c, x: c > x) + light
             + banded(edge, fv.EDGE_BANDS, 5, lambda c, x: c > x))
    ratio = F.col("width") / F.greatest("height", F.lit(1))
    route = (
        F.when((F.col("score") >= 70) & (ratio > 0.3) & (ratio < 3.0), "full").when((ratio < 0.2) | (ratio > 5.0), "ocr_only")
        .when(F.col("score") < 25, "vl_only").when(sharp < 10, "enhance_full").otherwise("full")
    )
    return metrics.withColumn("score", score).withColumn("route", route)


def preprocessing_strategy(metrics: DataFrame) -> DataFrame:
    """Second scorer: deductions for blur, darkness, contrast and edge density, with the advised strategy."""
    sharp, bright, contrast, density = (F.col(c) for c in ("sharpness", "brightness", "contrast", "edge_density"))
    under = lambda c, x: c < x
    lost = banded(sharp, fv.BLUR_LOSS, 0, under) + banded(bright, fv.DARK_LOSS, 0, under) + banded(density, fv.DENSITY_LOSS, 0, under)
    lost = lost + banded(contrast, fv.CONTRAST_LOSS, 0, lambda c, x: c < x if x < fv.HIGH_CONTRAST else c > x)
    strategy = (F.when((bright < 40) & (contrast < 30), "dark_low_contrast").when((sharp < 30) & (contrast < 30), "blurry")
                .when(contrast < 30, "low_contrast").when(bright < 40, "dark").when(contrast > 80, "high_contrast").otherwise("normal"))
    return metrics.withColumn("quality_score", F.greatest(F.lit(0), 100 - lost)).withColumn("strategy", strategy)
