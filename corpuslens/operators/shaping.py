"""Nested rows cut down to a budget of characters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters kept back for notes, the least budget, to how much long text is clipped first and at last, and halvings.
RESERVE, LEAST, LONG, SHORT, HALVINGS = 600, 1000, 4000, 400, 60


def _clipped(value: Column, kind: T.DataType, most: int) -> Column:
    """Long strings anywhere in a value, clipped."""
    if isinstance(kind, T.StringType):
        over = F.length(value) - most
        return F.when(over > 0, F.concat(F.substring(value, 1, most), F.format_string("… [clipped: %d more characters]", over))).otherwise(value)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: _clipped(x, kind.elementType, most))
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*[_clipped(value[f.name], f.dataType, most).alias(f.name) for f in kind]))
    return value


def _without(value: Column, kind: T.DataType, key: str) -> tuple[Column, T.DataType]:
    """A value without the fields of this name anywhere in it."""
    if isinstance(kind, T.ArrayType):
        inner = _without(F.lit(None).cast(kind.elementType), kind.elementType, key)[1]
        return F.transform(value, lambda x: _without(x, kind.elementType, key)[0]), T.ArrayType(inner)
    if isinstance(kind, T.StructType):
        kept = [(f.name, *_without(value[f.name], f.dataType, key)) for f in kind if f.name != key]
        return F.when(value.isNotNull(), F.struct(*[c.alias(n) for n, c, _ in kept])), T.StructType([T.StructField(n, k) for n, _, k in kept])
    return value, kind


def _size(value: Column) -> Column:
    return F.length(F.to_json(value))


def fit_to_budget(rows: DataFrame, most: int, key: str = "ui") -> DataFrame:
    """text, truncated and removed: each row as JSON, cut down to a budget of characters where it is longer.

    In this order, as far as is needed: fields named ``key`` go, strings are clipped to LONG characters, the longest of the
    row's arrays (its columns; the first of equally long ones) is halved, HALVINGS times at most and never below one
    element, and strings are clipped to SHORT. removed tells which steps were taken. What is left may still be too long: it
    is the least that the steps can reach. All of it is one expression on a row, so nothing is shuffled.
    """
    whole = T.StructType([f for f in rows.schema])
    given = F.struct(*[F.col(f.name) for f in whole])
    budget = max(LEAST, most - RESERVE)
    slim, kind = _without(given, whole, key)
    fits = lambda v: _size(v) <= budget
    base = rows.select(given.alias("given"), slim.alias("v")).withColumn("over", _size(F.col("given")) > most)
    base = base.withColumn("clip", F.col("over") & ~fits(F.col("v")))
    long = _clipped(F.col("v"), kind, LONG)
    base = base.withColumn("clipped", F.when(F.col("clip"), long).otherwise(F.col("v")))
    arrays = [f.name for f in kind if isinstance(f.dataType, T.ArrayType)]

    def halved(state: Column) -> Column:
        sizes = [F.coalesce(F.size(state[a]), F.lit(0)) for a in arrays]
        longest = F.greatest(*sizes, F.lit(0))
        first = F.array_position(F.array(*sizes), longest)
        cut = lambda f, i: F.when((first == i + 1) & (longest > 1), F.slice(state[f], 1, F.greatest(F.lit(1), F.floor(longest / 2).cast("int")))).otherwise(state[f])
        return F.struct(*[(cut(f.name, arrays.index(f.name)) if f.name in arrays else state[f.name]).alias(f.name) for f in kind])

    base = base.withColumn("halve", F.col("over") & ~fits(F.col("clipped")))
    step = lambda s, _: F.when(fits(s), s).otherwise(halved(s))
    shorter = F.aggregate(F.sequence(F.lit(1), F.lit(HALVINGS)), F.col("clipped"), step) if arrays else F.col("clipped")
    base = base.withColumn("short", F.when(F.col("halve"), shorter).otherwise(F.col("clipped")))
    base = base.withColumn("last", F.col("over") & ~fits(F.col("short")))
    done = F.when(F.col("last"), _clipped(F.col("short"), kind, SHORT)).otherwise(F.col("short"))
    note = lambda c, text: F.when(c, F.lit(text))
    removed = F.array_compact(F.array(
        note(F.col("over"), f"fields named {key}"), note(F.col("clip") & (F.to_json("v") != F.to_json("clipped")), f"text beyond {LONG} characters"),
        note(F.col("halve") & (F.to_json("clipped") != F.to_json("short")), "ends of lists"), note(F.col("last"), f"text beyond {SHORT} characters")))
    return base.select(F.when(F.col("over"), F.to_json(done)).otherwise(F.to_json("given")).alias("text"), F.col("over").alias("truncated"), removed.alias("removed"))
