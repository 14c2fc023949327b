"""Readers that hold to a contract: required and optional files, projections to what exists, dialects of headers."""

from __future__ import annotations

import random
import re

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.errors import AnalysisException


def read_csv(spark: SparkSession, path: str, schema: T.StructType, required: list[str] | None = None) -> DataFrame:
    """CSV with a header under a declared schema; byte order marks are stripped from header and text.

    Columns come by name, in any order; those that the file lacks are null. Missing required ones raise.
    """
    raw = spark.read.option("header", True).option("inferSchema", False).option("multiLine", True).csv(path)
    have = {re.sub(r"^﻿", "", c).strip(): c for c in raw.columns}
    lacking = [c for c in required or [] if c not in have]
    if lacking:
        raise ValueError(f"{path} lacks columns {lacking}")
    text = lambda c: F.regexp_replace(F.col(f"`{have[c]}`"), "^﻿", "")
    return raw.select(*[text(f.name).try_cast(f.dataType).alias(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in schema])


def read_parquet(spark: SparkSession, path: str | list[str], columns: list[str] | None = None) -> DataFrame:
    """Parquet files, of which only those of `columns` that exist are scanned; several paths form one table with merged schema."""
    paths = [path] if isinstance(path, str) else path
    df = spark.read.option("mergeSchema", len(paths) > 1).parquet(*paths)
    return df.select(*[c for c in columns if c in df.columns]) if columns else df


def read_optional(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The table conformed to the schema, or an empty one if there is no such file."""
    try:
        df = spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)
    return conform(df, schema)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns of the schema, cast; missing ones are null."""
    return df.select(*[(F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema])


def first_available(*tables: DataFrame | None) -> DataFrame:
    """The first table that was delivered and has rows, else the last delivered one."""
    given = [t for t in tables if t is not None]
    for t in given:
        if not t.isEmpty():
            return t
    return given[-1]


def match_column(columns: list[str], names: list[str], words: list[list[str]] = ()) -> str | None:
    """The best match of a wanted column: by the rank of its name among `names`, then by the first set of `words` that its name holds.

    Names are compared by their letters and digits only. Earlier columns win among equals.
    """
    plain = [re.sub(r"[^a-z0-9]+", "", c.lower()) for c in [*columns, *names]]
    here, wanted = plain[: len(columns)], {p: i for i, p in reversed(list(enumerate(plain[len(columns) :])))}

    def rank(at: int) -> float:
        held = [i for i, ws in enumerate(words) if all(re.sub(r"[^a-z0-9]+", "", w.lower()) in here[at] for w in ws)]
        return wanted.get(here[at], len(names) + held[0] if held else float("inf"))

    best = min(range(len(columns)), key=rank, default=None)
    return None if best is None or rank(best) == float("inf") else columns[best]


def canonical_columns(df: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """Columns renamed to canonical names by their aliases; names that exist already win."""
    names = {}
    for target, alts in aliases.items():
        if target not in df.columns and (c := match_column([x for x in df.columns if x not in names], alts)):
            names[c] = target
    return df.withColumnsRenamed(names)


def read_history_json(spark: SparkSession, path: str) -> DataFrame:
    """Cached responses {key..., result: [{timestamp, value}]} as rows (city_id, indicator, timestamp, year, value)."""
    schema = "city_id string, indicator string, result array<struct<timestamp: string, value: double>>"
    j = spark.read.schema(schema).option("multiLine", True).json(path)
    rows = j.select("city_id", "indicator", F.explode("result").alias("r")).select("city_id", "indicator", "r.timestamp", "r.value")
    return rows.withColumn("year", F.year(F.try_to_timestamp("timestamp")))


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, modified) of the files under a folder, without reading them."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return f.select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))


def column_families(columns: list[str], stem: str) -> dict[str, str]:
    """Columns of a family, by level: both `stem__LEVEL` and `stem_LEVEL` are read, the former wins; levels have capitals and digits."""
    found: dict[str, str] = {}
    for joint in ("_", "__"):
        for c in columns:
            if m := re.fullmatch(re.escape(stem + joint) + r"([A-Z]+\d+)", c):
                found[m[1]] = c
    return dict(sorted(found.items()))


def attach_labels(df: DataFrame, labels: DataFrame, key: str, label: str, missing: str = "no_label") -> DataFrame:
    """Left join of one label per key, with `<label>_note`: 'matched', 'several_labels' (the first in order is taken) or `missing`."""
    one = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("__k")).agg(F.min(label).alias(label), F.count_distinct(label).alias("__n"))
    out = df.join(one, F.col(key) == F.col("__k"), "left").drop("__k")
    note = F.when(F.col(label).isNull(), missing).when(F.col("__n") > 1, "several_labels").otherwise("matched")
    return out.withColumn(f"{label}_note", note).drop("__n")


def retry_waits(attempts: int, first: float = 1.0, most: float = 60.0, jitter: float = 0.25, seed: int = 1) -> list[float]:
    """Seconds to wait before each further attempt: doubled each time up to `most`, spread by a seeded jitter."""
    draw = random.Random(seed)
    return [min(most, first * 2**i) * (1 + draw.uniform(-jitter, jitter)) for i in range(max(0, attempts - 1))]
