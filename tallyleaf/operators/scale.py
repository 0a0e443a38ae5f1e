"""Shared building blocks that keep exact results when one key holds a large share of all rows.

The common idea: a hot key is split by an ordered chunk (a time bucket, a value band). The small per-chunk
totals are scanned over the key, and their running value is handed to every chunk as an offset, so no task ever
needs more than one chunk of a key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def literal_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A dimension of fixed rows as an inline table: its size is known to the planner and bounded by the source code.

    ``schema`` is ``"name type; name type"``.
    """

    def one(x) -> str:
        if x is None:
            return "NULL"
        if isinstance(x, str):
            return "'" + x.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"
        if isinstance(x, (list, tuple)):
            return "array(" + ", ".join(one(y) for y in x) + ")"
        return str(x)

    columns = [c.strip().split(" ", 1) for c in schema.split(";")]
    body = ", ".join("(" + ", ".join(one(x) for x in row) + ")" for row in rows)
    casts = ", ".join(f"CAST({n} AS {t}) AS {n}" for n, t in columns)
    return spark.sql(f"SELECT {casts} FROM VALUES {body} AS t({', '.join(n for n, _ in columns)})")


def spread_scan(df: DataFrame, key: str) -> DataFrame:
    """Spread the rows over ``tallyleaf.scan.partitions`` partitions, where the caller has set it.

    Unset by default: a table of many splits needs no shuffle. It is for files that Spark cannot split (one row group).
    """
    partitions = df.sparkSession.conf.get("tallyleaf.scan.partitions", None)
    return df.repartition(int(partitions), key) if partitions else df


def hour_chunk(ts: str = "ts", hours: int = 1) -> Column:
    return F.floor(F.unix_seconds(F.col(ts).cast("timestamp")) / F.lit(3600 * hours)).cast("bigint")


def running_totals(
    df: DataFrame, keys: list[str], chunk: Column, order: list, sums: dict[str, Column]
) -> DataFrame:
    """Add inclusive running sums per key in ``order`` without bringing a whole key into one task.

    ``chunk`` must not decrease along ``order``. Two shuffles: one of per-chunk totals (partial aggregates, small)
    and one of the rows on (keys, chunk).
    """
    rows = df.withColumn("_piece", F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], chunk.alias("chunk")))
    for name, expr in sums.items():
        rows = rows.withColumn(f"_v_{name}", expr)
    totals = rows.groupBy("_piece").agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums])
    before = Window.partitionBy(*[f"_piece.k{i}" for i in range(len(keys))]).orderBy("_piece.chunk").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = totals.select("_piece", *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums])
    # The struct is the join key and the window key alike: the rows are shuffled once, and null keys still match.
    inside = Window.partitionBy("_piece").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = rows.join(offsets, "_piece", "left")
    for name in sums:
        joined = joined.withColumn(name, F.sum(f"_v_{name}").over(inside) + F.col(f"_o_{name}"))
    return joined.drop("_piece", *[f"_v_{n}" for n in sums], *[f"_o_{n}" for n in sums])


def positions(df: DataFrame, keys: list[str], chunk: Column, order: list, name: str = "pos") -> DataFrame:
    """1-based position of each row inside its key."""
    return running_totals(df, keys, chunk, order, {name: F.lit(1).cast("bigint")})


def rolling_blocks(df: DataFrame, pos: str, frame: int, block: int = 4096) -> DataFrame:
    """Split positioned rows into blocks that carry the ``frame - 1`` rows before them.

    Adds ``_block`` and ``_owned``. A window over (keys, _block) ordered by position sees every row a frame of
    ``frame`` rows needs; keep only ``_owned`` rows afterwards.
    """
    if block < frame:
        block = frame
    own = F.floor((F.col(pos) - 1) / F.lit(block)).cast("bigint")
    tail = ((F.col(pos) - 1) % F.lit(block)) >= F.lit(block - frame + 1)
    copies = F.when(tail, F.array(own, own + 1)).otherwise(F.array(own))
    return (
        df.withColumn("_own", own)
        .withColumn("_block", F.explode(copies))
        .withColumn("_owned", F.col("_block") == F.col("_own"))
        .drop("_own")
    )


def value_band(value: Column) -> Column:
    """An order-preserving coarse band of a double: sign, binary exponent and twelve bits of mantissa.

    At most a few thousand bands per factor of two, whatever the number of rows. Infinities and NaN have bands of
    their own; NaN is the largest, as in Spark's ordering.
    """
    v = value.cast("double")
    endless = F.isnan(v) | (F.abs(v) == float("inf"))
    magnitude = F.when(endless, F.lit(1.0)).otherwise(F.abs(v))
    exponent = F.floor(F.log2(magnitude))
    step = F.floor((magnitude / F.pow(F.lit(2.0), exponent) - 1.0) * 4096)
    # log2 may round up just below a power of two: the band is then one step low, so clamp it to stay monotone.
    band = exponent * 4096 + F.greatest(F.lit(0).cast("bigint"), F.least(F.lit(4095).cast("bigint"), step)) + 8_000_000
    edge = F.lit(1 << 40)
    return (F.when(F.isnan(v), edge + 1).when(v == float("inf"), edge).when(v == float("-inf"), -edge)
            .when(v == 0, F.lit(0).cast("bigint")).when(v > 0, band).otherwise(-band))


def key_struct(keys: list[str]) -> Column:
    """The keys as one value: equal in a join also where some are null."""
    return F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.lit(0).alias("all"))


def join_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null keys match each other; the keys come from the left side."""
    return left.withColumn("_key", key_struct(keys)).join(right.withColumn("_key", key_struct(keys)).drop(*keys), "_key", how).drop("_key")


def ranked_values(df: DataFrame, keys: list[str], value: str, ranks: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """Exact order statistics (keys, label, value): ``ranks`` gives a zero-based rank for each label from the row count.

    Distinct values are counted once, combined on the map side. A coarse histogram of those counts finds the band that
    holds each rank, and only that band's distinct values are ordered. No key is ever sorted in one task. Null values do
    not count; a null key is a key.
    """
    counted = (
        df.where(F.col(value).isNotNull()).groupBy(key_struct(keys).alias("_k"), F.col(value).cast("double").alias("_v"))
        .agg(F.count("*").alias("_c")).withColumn("_band", value_band(F.col("_v")))
    )
    whole = Window.partitionBy("_k")
    bands = counted.groupBy("_k", "_band").agg(F.sum("_c").alias("_bc")).withColumn("_n", F.sum("_bc").over(whole)).withColumn(
        "_before", F.coalesce(F.sum("_bc").over(whole.orderBy("_band").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    wanted = F.array(*[F.struct(F.lit(label).alias("label"), (rank(F.col("_n")).cast("bigint") - F.col("_before")).alias("rank")) for label, rank in ranks.items()])
    hits = bands.withColumn("_hits", F.filter(wanted, lambda w: (w["rank"] >= 0) & (w["rank"] < F.col("_bc")))).where(F.size("_hits") > 0)
    within = Window.partitionBy("_k", "_band").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ordered = counted.join(hits.select("_k", "_band", "_hits"), ["_k", "_band"]).withColumn("_to", F.sum("_c").over(within)).withColumn("_hit", F.explode("_hits"))
    found = ordered.where((F.col("_hit.rank") < F.col("_to")) & (F.col("_hit.rank") >= F.col("_to") - F.col("_c")))
    return found.select(*[F.col(f"_k.k{i}").alias(k) for i, k in enumerate(keys)], "_hit.label", F.col("_v").alias("value"))


def nearest_rank_percentiles(
    df: DataFrame, keys: list[str], value: str, probs: dict[str, float]
) -> DataFrame:
    """Exact nearest-rank percentiles ``sorted[min(int(n*p), n-1)]``, one column per label."""
    found = ranked_values(df, keys, value, {label: lambda n, p=p: F.least(F.floor(n * F.lit(p)), n - 1) for label, p in probs.items()})
    picks = [F.max(F.when(F.col("label") == label, F.col("value"))).alias(label) for label in probs]
    return found.groupBy(*keys).agg(*picks) if keys else found.agg(*picks)


def exact_median(df: DataFrame, keys: list[str], value: str, name: str = "median") -> DataFrame:
    """Median with the mean of the two middle values for an even count."""
    found = ranked_values(df, keys, value, {"lo": lambda n: F.floor((n - 1) / 2), "hi": lambda n: F.floor(n / 2)})
    return found.groupBy(*keys).agg(F.avg("value").alias(name))


def newest_per_key(df: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    """The first ``n`` rows of each key in ``order``. Spark trims each map task to ``n`` rows before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def salted_join(
    big: DataFrame, small: DataFrame, keys: list[str], spread_by: str, salts: int = 16, how: str = "inner"
) -> DataFrame:
    """Equi-join in which a hot key of ``big`` is spread over ``salts`` tasks.

    The salt comes from a hash of a row id, so a retried task produces the same rows. ``small`` is repeated
    ``salts`` times, which costs rows of the small side only.
    """
    left = big.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(salts)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, keys + ["_salt"], how).drop("_salt")


def idle_segments(df: DataFrame, keys: list[str], ts: str, gap_seconds: int, name: str = "segment") -> DataFrame:
    """Number the runs of rows of a key that are separated by an idle gap of at least ``gap_seconds``.

    Rows are first reduced to (first, last) per bucket of ``gap_seconds``; a gap that long cannot lie inside one
    bucket, so the run borders are found on the reduced table and joined back on the bucket.
    """
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    rows = df.withColumn("_b", F.floor(micros / F.lit(gap_seconds * 1_000_000)).cast("bigint"))
    spans = rows.groupBy(*keys, "_b").agg(F.min(micros).alias("_first"), F.max(micros).alias("_last"))
    w = Window.partitionBy(*keys).orderBy("_b")
    broken = F.col("_first") - F.lag("_last").over(w) >= F.lit(gap_seconds * 1_000_000)
    spans = spans.withColumn("_new", F.coalesce(broken, F.lit(False)).cast("bigint"))
    spans = spans.withColumn(name, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return join_keys(rows, spans.select(*keys, "_b", name), keys + ["_b"]).drop("_b")
