"""Number statistics, formula columns and the registry of analyses."""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragspark.functions import text as tx
from ragspark.functions.arrays import bind
from ragspark.operators.hotkeys import salted_join
from ragspark.session import stored

# Distance of the sketched middle from the median on either side, and the sketch's accuracy.
_GAP, _ACCURACY = 0.001, 10_000
# Values of a group that one task may rank, bins that a wider range is cut in, and how often at most.
_RANKED, _BINS, _NARROWED = 1_000_000, 64, 12
# Groups whose ends, five numbers each, are broadcast.
_BROADCAST = 100_000


def multiply(left: Column, right: Column) -> Column:
    return left.cast("double") * right.cast("double")


def list_statistics(values: Column) -> Column:
    """Statistics of an array of numbers per row; an empty or null array is an error."""

    def of(s: Column) -> Column:
        n = F.size(s)
        total = F.aggregate(s, F.lit(0.0), lambda a, x: a + x)
        mean = total / n
        middle = F.floor(n / 2).cast("int")
        median = F.when(n % 2 == 1, F.get(s, middle)).otherwise(
            (F.get(s, middle - 1) + F.get(s, middle)) / 2
        )

        def spread(m: Column) -> Column:
            return F.aggregate(s, F.lit(0.0), lambda a, x: a + (x - m) * (x - m)) / n

        low, high = F.get(s, F.lit(0)), F.get(s, n - 1)
        return bind(
            F.struct(mean.alias("mean"), bind(mean, spread).alias("variance")),
            lambda v: F.struct(
                n.alias("count"),
                total.alias("sum"),
                v["mean"].alias("mean"),
                median.alias("median"),
                low.alias("min"),
                high.alias("max"),
                (high - low).alias("range"),
                v["variance"].alias("variance"),
                F.sqrt(v["variance"]).alias("std_dev"),
                s.alias("sorted"),
            ),
        )

    given = F.when(F.size(values) > 0, values.cast("array<double>")).otherwise(
        F.raise_error(F.lit("An empty list has no statistics"))
    )
    return bind(F.sort_array(given), of)


def _about_the_middle(value: str) -> Column:
    """Two values between which the median lies: the sketch's ranks are off by a tenth of the gap at most."""
    return F.percentile_approx(value, [0.5 - _GAP, 0.5 + _GAP], _ACCURACY)


def _covers(rank: Column) -> Column:
    return (rank < F.col("__upto")) & (rank >= F.col("__upto") - F.col("__c"))


def _within(rows: DataFrame, ends: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``value`` and how often it occurs (``__times``) up to the upper end of each group.

    The ends of up to ``_BROADCAST`` groups go to the rows. Those of more meet them by their key, equal values being
    counted before, and a group with many values being split.
    """
    if ends.count() <= _BROADCAST:
        near = rows.withColumn("__times", F.lit(1).cast("long")).join(F.broadcast(ends), keys)
    else:
        counted = rows.groupBy(*keys, value).agg(F.count("*").alias("__times"))
        near = salted_join(counted, ends, keys, "inner", F.xxhash64(value))
    return near.filter(F.col(value) <= F.col("__high"))


def _narrowed(rows: DataFrame, ends: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``ends`` again, around the bins between them that hold the middle; counts of bins are all that is windowed.

    Bins are cut at quantiles of the values between the ends, so that they hold like numbers of values, whatever these are.
    """
    between = _within(rows, ends, keys, value).filter(F.col(value) >= F.col("__low"))
    shares = [i / _BINS for i in range(1, _BINS)]
    cuts = between.groupBy(*keys).agg(F.array_distinct(F.percentile_approx(value, shares, 20 * _BINS)).alias("__cuts"))
    cut = stored(ends.join(cuts, keys), "cuts")
    place = F.when(F.col(value) < F.col("__low"), -1).otherwise(F.size(F.filter("__cuts", lambda c: c < F.col(value))))
    bins = _within(rows, cut, keys, value).groupBy(*keys, "__n", place.alias("__bin"))
    counted = bins.agg(F.sum("__times").alias("__c"), F.min(value).alias("__min"), F.max(value).alias("__max"))
    upto = F.sum("__c").over(Window.partitionBy(*keys).orderBy("__bin"))
    held = counted.withColumn("__upto", upto).filter(_covers(F.floor((F.col("__n") - 1) / 2)) | _covers(F.floor(F.col("__n") / 2)))
    return held.groupBy(*keys, "__n").agg(F.min("__min").alias("__low"), F.max("__max").alias("__high"), F.sum("__c").alias("__held"))


def _middle(rows: DataFrame, ends: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``keys, median`` from ``ends``: the number ``__n`` of values of each group and two values about its middle.

    What lies below the ends is only counted; what lies between them is counted by value and ranked. While that may be more than
    ``_RANKED`` values of a group, the ends are narrowed to the bins that hold the middle: each time about
    ``_BINS`` times fewer values are left, and a range of one value is done.
    """
    ends = ends.select(*keys, "__n", "__low", "__high", F.ceil(F.col("__n") * 2 * _GAP).alias("__held"))
    for _ in range(_NARROWED):
        most = ends.filter("__low < __high").agg(F.max("__held")).first()[0] or 0
        if most <= _RANKED:
            break
        ends = stored(_narrowed(rows, ends.drop("__held"), keys, value), "ends")
    near = (
        _within(rows, ends.drop("__held"), keys, value)
        .groupBy(*keys, "__n", F.when(F.col(value) >= F.col("__low"), F.col(value)).alias("__x"))
        .agg(F.sum("__times").alias("__c"))
    )
    upto = F.sum("__c").over(Window.partitionBy(*keys).orderBy("__x"))
    n = F.col("__n")
    return (
        near.withColumn("__upto", upto)
        .filter(_covers(F.floor((n - 1) / 2)) | _covers(F.floor(n / 2)))
        .groupBy(*keys)
        .agg(F.avg("__x").alias("median"))
    )


def exact_median(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Exact median per group as ``keys, median``; a task ranks a bounded part of a group, whatever its size and distribution."""
    rows = df.select(*keys, value).dropna()
    sketched = rows.groupBy(*keys).agg(_about_the_middle(value).alias("__mid"), F.count("*").alias("__n"))
    ends = sketched.select(*keys, "__n", F.col("__mid")[0].alias("__low"), F.col("__mid")[1].alias("__high"))
    return _middle(rows, stored(ends, "ends"), keys, value)


def number_statistics(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Count, sum, mean, exact median, min, max, range, population variance and deviation.

    Nulls are left out, as are rows without a key. Sorted values of a group are rows,
    not an array: see :func:`sorted_values`. All but the median come from one pass, whose result, a row a group, is written.
    """
    rows = df.select(*keys, F.col(value).cast("double").alias("__v")).dropna()
    basic = rows.groupBy(*keys).agg(
        F.count("*").alias("count"),
        F.sum("__v").alias("sum"),
        F.avg("__v").alias("mean"),
        F.min("__v").alias("min"),
        F.max("__v").alias("max"),
        (F.max("__v") - F.min("__v")).alias("range"),
        F.var_pop("__v").alias("variance"),
        F.stddev_pop("__v").alias("std_dev"),
        _about_the_middle("__v").alias("__mid"),
    )
    told = stored(basic.withColumns({"__low": F.col("__mid")[0], "__high": F.col("__mid")[1]}).drop("__mid"), "statistics")
    ends = told.select(*keys, F.col("count").alias("__n"), "__low", "__high")
    return told.drop("__low", "__high").join(_middle(rows, ends, keys, "__v"), keys)


def sorted_values(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``keys, value`` in ascending order by a range sort, so a large group spreads out.

    The salt lets the range cuts fall inside a run of equal values.
    """
    salted = df.select(*keys, value).withColumn("__salt", F.rand(1))
    return salted.orderBy(*keys, value, "__salt").drop("__salt")


_TOKEN = re.compile(r"\s*(?:(\d+\.\d*|\.\d+|\d+)|([A-Za-z_]\w*)|(\*\*|//|[-+*/()]))")


def formula(expression: str, columns: list[str]) -> Column:
    """A formula of numbers, ``+ - * / ( )`` and column names, in double arithmetic.

    Anything else, including ``**`` and ``//``, is a ``ValueError``; so is bad syntax.
    """
    parts, at = [], 0
    text = expression.rstrip()
    while at < len(text):
        found = _TOKEN.match(text, at)
        if not found:
            raise ValueError(f"Not part of a formula: {text[at:at + 20]!r}")
        number, name, sign = found.groups()
        if number:
            if re.fullmatch(r"0\d+", number) and float(number) != 0:
                raise ValueError(f"Invalid number {number!r}")
            parts.append(f"{float(number)!r}D")
        elif name:
            if name not in columns:
                raise ValueError(f"Unknown column {name!r}")
            parts.append(f"CAST(`{name}` AS DOUBLE)")
        elif sign in ("**", "//"):
            raise ValueError(f"Operator {sign!r} is not supported")
        else:
            parts.append(sign)
        at = found.end()
    _check_syntax(parts)
    return F.expr(" ".join(parts))


def _check_syntax(parts: list[str]) -> None:
    """Operands and operators alternate and parentheses close; signs may lead an operand."""
    depth, want_operand = 0, True
    for part in parts:
        if part == "(":
            if not want_operand:
                raise ValueError("Invalid mathematical expression")
            depth += 1
        elif part == ")":
            depth -= 1
            if want_operand or depth < 0:
                raise ValueError("Invalid mathematical expression")
        elif part in ("*", "/") or (part in ("+", "-") and not want_operand):
            if want_operand:
                raise ValueError("Invalid mathematical expression")
            want_operand = True
        elif part not in ("+", "-"):
            if not want_operand:
                raise ValueError("Invalid mathematical expression")
            want_operand = False
    if want_operand or depth:
        raise ValueError("Invalid mathematical expression")


# Analyses by category: each takes a frame and column names and returns a frame.
ANALYSES: dict[str, dict[str, tuple[Callable[..., DataFrame], str]]] = {
    "calculator": {
        "multiply": (
            lambda df, left, right: df.withColumn("product", multiply(F.col(left), F.col(right))),
            "Product of two columns",
        ),
        "calculate_expression": (
            lambda df, expression: df.withColumn("result", formula(expression, df.columns)),
            "Formula over numeric columns",
        ),
        "statistics": (
            lambda df, keys, value: number_statistics(df, keys, value),
            "Statistics of a column per group",
        ),
    },
    "text_analyzer": {
        "count_words": (
            lambda df, text="text": df.withColumn("basic_stats", tx.count_words(F.col(text))),
            "Word, character and sentence counts",
        ),
        "analyze_text": (lambda df, text="text": tx.analyze_text(df, text), "Full text statistics"),
    },
}


def enabled_analyses(config: dict[str, Any]) -> dict[str, Callable[..., DataFrame]]:
    """Analyses switched on by ``{"enabled": .., category: {"enabled": .., "tools": [..]}}``.

    Unknown categories and names are ignored.
    """
    if not config.get("enabled", False):
        return {}
    chosen = {}
    for category, settings in config.items():
        if isinstance(settings, dict) and settings.get("enabled", False):
            known = ANALYSES.get(category, {})
            chosen.update({t: known[t][0] for t in settings.get("tools", []) if t in known})
    return chosen


def analyses_info(config: dict[str, Any]) -> dict[str, Any]:
    names = list(enabled_analyses(config))
    about = {n: text for group in ANALYSES.values() for n, (_, text) in group.items()}
    return {
        "enabled": bool(names),
        "total_tools": len(names),
        "tools": [{"name": n, "description": about[n]} for n in names],
    }
