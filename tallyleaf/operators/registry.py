"""Rules, triggers and scenarios that a caller adds at run time, and what happens when an alert is written.

A rule is a function from columns to a column, checked when it is added; one in pandas is wrapped and runs over Arrow batches. Nothing is
registered globally: a ``Registry`` is a value that jobs are given.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyleaf import fixed_values as fv
from tallyleaf.functions.text import is_missing
from tallyleaf.operators.fields import keyword_hits


class Registry:
    """Named builders of columns, in the order in which they were added."""

    def __init__(self) -> None:
        self._builders: dict[str, tuple[Callable[..., Column], tuple[str, ...]]] = {}

    def __iter__(self):
        return iter(self._builders)

    def add(self, name: str, builder: Callable[..., Column], columns: Iterable[str]) -> Registry:
        """``builder`` is given one column for each name in ``columns``; one that cannot take so many, or a name added before, is refused."""
        columns = tuple(columns)
        if name in self._builders:
            raise ValueError(f"there is a rule {name} already")
        try:
            inspect.signature(builder).bind(*columns)
        except TypeError as e:
            raise TypeError(f"rule {name} cannot be called with {len(columns)} columns") from e
        self._builders[name] = (builder, columns)
        return self

    def add_pandas(self, name: str, function: Callable, columns: Iterable[str], returns: str) -> Registry:
        """For what columns cannot express: ``function`` is given pandas series of a batch and gives one of the same length."""
        columns = tuple(columns)
        self.add(name, function, columns)  # the signature that counts is that of the function itself
        self._builders[name] = (F.pandas_udf(function, returns), columns)
        return self

    def column(self, name: str) -> Column:
        if name not in self._builders:
            raise KeyError(f"no rule {name}; there are {', '.join(self._builders) or 'none'}")
        builder, columns = self._builders[name]
        made = builder(*[F.col(c) for c in columns])
        if not isinstance(made, Column):
            raise TypeError(f"rule {name} gave {type(made).__name__}, not a column")
        return made


def check_rules(rows: DataFrame, registry: Registry, keys: list[str]) -> DataFrame:
    """``keys, rule, passed`` for each row and rule; a null verdict counts as failed. One pass over the rows."""
    verdicts = [F.struct(F.lit(n).alias("rule"), F.coalesce(registry.column(n).cast("boolean"), F.lit(False)).alias("passed")) for n in registry]
    empty = F.array().cast("array<struct<rule:string,passed:boolean>>")
    return rows.select(*keys, F.inline(F.array(*verdicts) if verdicts else empty))


def failing_rules(rows: DataFrame, registry: Registry, name: str = "failed") -> DataFrame:
    """The rows with the names of the rules that they fail, in the order of adding."""
    failed = [F.when(~F.coalesce(registry.column(n).cast("boolean"), F.lit(False)), F.lit(n)) for n in registry]
    return rows.withColumn(name, F.array_compact(F.array(*failed)) if failed else F.array().cast("array<string>"))


def first_trigger(rows: DataFrame, registry: Registry, name: str = "trigger", otherwise: str = "none") -> DataFrame:
    """The rows with the first trigger that holds; added ones come after those added before."""
    chain = F.lit(otherwise)
    for trigger in reversed(list(registry)):
        chain = F.when(F.coalesce(registry.column(trigger).cast("boolean"), F.lit(False)), trigger).otherwise(chain)
    return rows.withColumn(name, chain)


def failures_by_field(fields: DataFrame, registry: Registry) -> DataFrame:
    """``category, field, checked, failed`` for rules named ``category.field`` over the column ``value``; missing values are not checked."""
    name = F.concat_ws(".", "category", "field")
    filled = fields.where(~is_missing(F.col("value")) & name.isin(*registry))
    passed = None
    for rule in registry:
        held = F.coalesce(registry.column(rule).cast("boolean"), F.lit(False))
        passed = F.when(name == rule, held) if passed is None else passed.when(name == rule, held)
    return filled.withColumn("_passed", F.lit(True) if passed is None else passed).groupBy("category", "field").agg(
        F.count("*").alias("checked"), F.count_if(~F.col("_passed")).alias("failed"))


SCENARIO_ROWS = "position int, scenario string, need int, words array<string>"


def scenario_rows(spark: SparkSession, extra: list[tuple[str, int, list[str]]] = ()) -> DataFrame:
    """The built-in scenarios as rows, then the ``extra`` ones (name, words needed, words); a name given again replaces the earlier row in its place."""
    known = {name: (need, list(words)) for name, (need, words) in fv.SCENARIO_KEYWORDS.items()}
    known |= {name: (need, list(words)) for name, need, words in extra}
    return spark.createDataFrame([(i, name, need, words) for i, (name, (need, words)) in enumerate(known.items())], SCENARIO_ROWS)


def scenarios_of(docs: DataFrame, rows: DataFrame, text: str = "text", default: str = fv.SCENARIO_DEFAULT) -> DataFrame:
    """``docs`` with the first scenario, by position, of which enough words stand in the text. The rows are a list of rules and are read when the job is built."""
    chain = F.lit(default)
    for r in sorted(rows.collect(), key=lambda r: -r.position):
        chain = F.when(keyword_hits(F.col(text), r.words) >= r.need, r.scenario).otherwise(chain)
    return docs.withColumn("scenario", chain)


def on_alerts(alerts: DataFrame, call_backs: list[Callable[[DataFrame, int], None]], checkpoint: str):
    """Starts a stream that hands every batch of alerts to each call-back, with its number; a call-back that fails stops the stream, and the batch comes again."""
    def hand_over(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            for call in call_backs:
                call(batch, number)
        finally:
            batch.unpersist()

    return alerts.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(hand_over).start()
