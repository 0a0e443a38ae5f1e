"""Fields of texts without labels, read from lines and their places, and the arbiter between them and the labelled rules."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyleaf import fixed_values as fv
from tallyleaf.functions import text as tx
from tallyleaf.operators.fields import extract_fields, first_rule, with_band

FREE = ("brand", "product_name", "ingredients", "features", "specification", "product_type")


def text_lines(text: Column) -> Column:
    """The lines of a text without the white space around them, empty ones left out."""
    return F.filter(F.transform(F.split(text, "\n"), tx.strip), lambda line: line != "")


def found(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(tx.strip(F.regexp_extract(text, pattern, group)), F.lit(""))


def holds_han(line: Column) -> Column:
    return line.rlike("[一-龥]")


def without_han(pattern: str) -> str | None:
    """What is left of ``(?:a|b|c)`` for a line without Han characters; null if nothing can match there."""
    kept = [word for word in pattern.removeprefix("(?:").removesuffix(")").split("|") if not re.search("[一-龥]", word)]
    return "(?:" + "|".join(kept) + ")" if kept else None


def listed(values: Column) -> Column:
    """The first few values as one text; null without any."""
    return F.when(F.size(values) > 0, F.array_join(F.slice(values, 1, fv.FREE_LISTED), "，"))


def free_brand(lines: Column) -> Column:
    """The first name in two scripts of any line; else the first short line of Han characters; else a Latin name alone in the first three lines."""
    lines_of_han = F.filter(lines, holds_han)
    mixed = F.flatten(F.transform(lines_of_han, lambda line: F.array(*[found(line, p) for p in fv.MIXED_BRAND])))
    bare = F.transform(lines_of_han, lambda line: F.regexp_replace(line, fv.HAN_BRAND_CUT, ""))
    han = F.filter(bare, lambda word: word.rlike("^[一-龥]{2,6}$") & ~word.rlike(fv.HAN_BRAND_BARRED))
    latin = F.filter(F.slice(lines, 1, 3), lambda line: line.rlike(fv.LATIN_BRAND))
    return F.coalesce(F.get(F.filter(mixed, lambda x: x.isNotNull()), F.lit(0)), F.get(han, F.lit(0)), F.get(latin, F.lit(0)))


def free_product_name(lines: Column, brand: Column, product_type: Column) -> Column:
    """What stands before the product's word in the first line, with the word; else brand and product type."""
    first = F.coalesce(F.get(lines, F.lit(0)), F.lit(""))
    word = F.coalesce(*[F.nullif(F.regexp_extract(first, p, 0), F.lit("")) for p, _ in fv.PRODUCT_TYPES])
    before = tx.strip(F.split_part(first, word, F.lit(1)))
    return F.when(before != "", F.concat(before, word)).otherwise(F.concat(F.coalesce(brand, F.lit("")), product_type))


def free_ingredients(lines: Column) -> Column:
    """Known ingredients line by line, each once; a line that begins with "without" names none."""
    with_any = F.filter(lines, lambda line: ~line.startswith("无"))

    def named(line: Column, patterns: list[str]) -> Column:
        return F.flatten(F.array(*[F.regexp_extract_all(line, F.lit("(?iu)" + p), F.lit(0)) for p in patterns]))

    latin = [p for p in map(without_han, fv.FREE_INGREDIENTS) if p is not None]
    each = F.transform(with_any, lambda line: F.when(holds_han(line), named(line, fv.FREE_INGREDIENTS)).otherwise(named(line, latin)))
    return listed(F.array_distinct(F.flatten(each)))


def free_features(lines: Column, brand: Column, product_name: Column) -> Column:
    """Longer lines with Han characters, cleaned at their heads; not the names, and none that holds or lies in an earlier one."""
    noise = "(?i)^(?:" + "|".join(fv.FREE_NOISE_LINES) + ")"

    def cleaned(line: Column) -> Column:
        for head in fv.FREE_NOISE_HEADS:
            line = tx.strip(F.regexp_replace(line, head, ""))
        return line

    def alike(a: Column, b: Column) -> Column:
        return F.coalesce(F.contains(a, b) | F.contains(b, a), F.lit(False))

    # Cleaning takes characters away only: a line without Han characters is none before it.
    kept = F.filter(F.transform(F.filter(lines, lambda line: holds_han(line) & ~line.rlike(noise)), cleaned), lambda line: (F.length(line) >= fv.FREE_LEAST_FEATURE)
                    & holds_han(line) & ~alike(line, brand) & ~alike(line, product_name))
    # Once the list is full later lines cannot change it, so it never grows with the text.
    return listed(F.aggregate(kept, F.array().cast("array<string>"), lambda have, line: F.when(
        (F.size(have) >= fv.FREE_LISTED) | F.exists(have, lambda h: alike(h, line)), have).otherwise(F.concat(have, F.array(line)))))


def free_form_fields(docs: DataFrame) -> DataFrame:
    """Adds ``free_`` and each name of ``FREE``: what the text says without labels, null where nothing is found.

    One pass without a shuffle; all rules work on the list of lines. A null text has no field.
    """
    out = docs.withColumn("_lines", F.coalesce(text_lines(F.col("text")), F.array().cast("array<string>")))
    lines = F.col("_lines")
    out = out.withColumn("_joined", F.array_join(lines, "")).withColumn("free_brand", free_brand(lines))
    out = out.withColumn("free_product_type", first_rule(F.col("_joined"), fv.PRODUCT_TYPES))
    out = out.withColumn("free_product_name", free_product_name(lines, F.col("free_brand"), F.col("free_product_type")))
    return out.withColumns({
        "free_ingredients": free_ingredients(lines),
        "free_features": free_features(lines, F.col("free_brand"), F.col("free_product_name")),
        "free_specification": F.coalesce(*[found(F.col("_joined"), p) for p in fv.FREE_SPECIFICATION]),
    }).drop("_lines", "_joined")


def settle(both: DataFrame, rules: dict[str, list[str]]) -> DataFrame:
    """One record out of the labelled fields and the ``free_`` ones.

    With one labelled field at most, everything found without labels is taken, and wins; else ingredients and
    specification are filled in where the labels gave none. ``layer`` says which of them spoke.
    """
    few = sum((F.col(f).isNotNull().cast("int") for f in rules), F.lit(0)) <= 1
    gaps = [f for f in fv.FILLED_FIELDS if f in rules]
    filled_in = F.exists(F.array(*[F.col(f).isNull() & F.col(f"free_{f}").isNotNull() for f in gaps]), lambda x: x)
    any_free = F.coalesce(*[F.col(f"free_{f}") for f in FREE]).isNotNull()
    layer = F.when(few & any_free, "free").when(few, "none").when(filled_in, "both").otherwise("labels")
    layer = F.when(few & ~any_free & F.coalesce(*rules).isNotNull(), "labels").otherwise(layer)
    values = {}
    for f in rules:
        free, own = (F.col(f"free_{f}") if f in FREE else F.lit(None).cast("string")), F.col(f)
        values[f] = F.when(few, F.coalesce(free, own)).otherwise(F.coalesce(own, free) if f in gaps else own)
    values |= {f: F.when(few, F.col(f"free_{f}")) for f in FREE if f not in rules}
    return both.withColumn("layer", layer).withColumns(values).drop(*[f"free_{f}" for f in FREE])


def settled_fields(docs: DataFrame, rules: dict[str, list[str]] | None = None) -> DataFrame:
    """Both layers over every text, settled, with the number of key fields filled and the confidence band after it."""
    rules = fv.FIELD_RULES if rules is None else rules
    both = free_form_fields(extract_fields(docs, rules))
    # One row of a struct: what both layers found is worked out once, however often the arbiter looks at it.
    once = both.select(F.explode(F.array(F.struct("*"))).alias("_found")).select("_found.*")
    return with_band(settle(once, rules))


def layer_fill(settled: DataFrame, rules: dict[str, list[str]]) -> DataFrame:
    """Documents and filled fields per layer that spoke."""
    return settled.groupBy("layer").agg(F.count("*").alias("docs"), *[F.count(f).alias(f) for f in (*rules, *[f for f in FREE if f not in rules])])
