"""Prompt templates: files ``name_vN.yaml`` with a key ``template``."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_VERSIONED = r"^(.+)_v([^_]*)$"


def _stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)\.yaml$", 1)


@F.pandas_udf(T.StringType())
def _template_of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Value of the key ``template``, read by a YAML library; anything but a text or number is null."""
    try:
        import yaml
    except ImportError as missing:
        raise ImportError("templates are YAML: install PyYAML on the executors") from missing

    def value(text: str | None) -> str | None:
        found = yaml.safe_load(text) if text else None
        found = found.get("template") if isinstance(found, dict) else None
        return str(found) if isinstance(found, str | int | float) else None

    for part in texts:
        yield part.map(value)


def read_templates(spark: SparkSession, folder: str) -> DataFrame:
    """``name, version, number, template``; a file without ``_v`` has version ``default``.

    A file without the key has a null template; a file that is not YAML is an error.
    """
    files = spark.read.option("pathGlobFilter", "*.yaml").text(folder, wholetext=True)
    stem = _stem(F.col("_metadata.file_path"))
    versioned = stem.rlike(_VERSIONED)
    return files.select(
        F.when(versioned, F.regexp_extract(stem, _VERSIONED, 1)).otherwise(stem).alias("name"),
        F.when(versioned, F.concat(F.lit("v"), F.regexp_extract(stem, _VERSIONED, 2)))
        .otherwise("default")
        .alias("version"),
        F.when(versioned, F.regexp_extract(stem, _VERSIONED, 2).try_cast("int")).alias("number"),
        _template_of("value").alias("template"),
    )


def with_templates(
    rows: DataFrame, templates: DataFrame, name: str = "template_name", version: str = "template_version", to: str = "template"
) -> DataFrame:
    """``rows`` with the template they name as column ``to``; a null version is the latest.

    Each row is kept; a name or version that is not there gives null. Names and versions of ``templates``
    are taken to be unique.
    """
    latest = latest_templates(templates).select(F.col("name").alias("__name"), F.lit(None).cast("string").alias("__version"), F.col("template").alias(to))
    every = templates.select(F.col("name").alias("__name"), F.col("version").alias("__version"), F.col("template").alias(to))
    wanted = (F.col(name) == F.col("__name")) & F.col(version).eqNullSafe(F.col("__version"))
    return rows.join(every.unionByName(latest), wanted, "left").drop("__name", "__version")


def list_templates(templates: DataFrame) -> DataFrame:
    """Versions per name."""
    return templates.groupBy("name").agg(F.sort_array(F.collect_set("version")).alias("versions"))


def latest_templates(
    templates: DataFrame, name: str = "name", number: str = "number", template: str = "template"
) -> DataFrame:
    """The template with the highest number per name; one without a number only if alone."""
    order = F.coalesce(F.col(number), F.lit(-1))
    return templates.groupBy(name).agg(
        F.max_by(F.struct(number, template), order).alias("__top")
    ).select(name, F.col(f"__top.{number}").alias(number), F.col(f"__top.{template}").alias(template))


def pick_template(templates: DataFrame, name: str, version: str | None = None) -> str:
    """Text of one template, the latest unless ``version`` is given."""
    of_name = templates.filter(F.col("name") == name)
    chosen = (
        of_name.filter(F.col("version") == version) if version else latest_templates(of_name)
    )
    row = chosen.select("template").first()
    if row is None:
        raise FileNotFoundError(f"No template {name!r} {version or ''}".rstrip())
    if row["template"] is None:
        raise KeyError(f"Template key not found in {name!r}")
    return row["template"]
