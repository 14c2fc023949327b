"""Writers: guarded and resumable outputs, status tables, bundles of sheets, manifests, reports."""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from gridloom.sources.tables import read_optional


def write_guarded(df: DataFrame, path: str, overwrite: bool = False, partition_by: list[str] | None = None) -> None:
    """Parquet; an existing output is an error unless `overwrite`. The committer makes files appear all at once."""
    w = df.write.mode("overwrite" if overwrite else "errorifexists")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def todo(tasks: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Tasks without a finished chunk."""
    return tasks.join(done.select(*keys).distinct(), keys, "left_anti")


def latest_status(events: DataFrame, key: str, at: str) -> DataFrame:
    """The last event of each key; events are only ever appended. Ties go to the row that sorts last."""
    rest = [c for c in events.columns if c not in (key, at)]
    w = Window.partitionBy(key).orderBy(F.col(at).desc_nulls_last(), *[F.col(c).desc_nulls_last() for c in rest])
    return events.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") == 1).drop("__rn")


def upsert_status(spark: SparkSession, path: str, events: DataFrame, key: str, at: str) -> DataFrame:
    """Append events to a status log and give the present status of every key."""
    events.write.mode("append").parquet(path)
    return latest_status(read_optional(spark, path, events.schema), key, at)


#: Fixed values of workbooks: the longest name of a sheet, and characters that it may not hold.
LONGEST, FORBIDDEN = 31, str.maketrans(dict.fromkeys("[]:*?/\\", "_"))


def sheet_names(wanted: Iterable[str]) -> list[str]:
    """A name for each sheet that workbooks accept; names that fall together, in whatever case, are numbered from the second on."""
    used: dict[str, str] = {}
    count: Counter[str] = Counter()
    for name in wanted:
        plain = name.translate(FORBIDDEN).strip("'")[:LONGEST] or "sheet"
        fitting = ""
        while not fitting or fitting.lower() in used:
            count[plain.lower()] += 1
            number = f"_{count[plain.lower()]}" if count[plain.lower()] > 1 else ""
            fitting = plain[: LONGEST - len(number)] + number
        used[fitting.lower()] = fitting
    return list(used.values())


def write_bundle(sheets: dict[str, DataFrame], path: str, overwrite: bool = False) -> list[str]:
    """A folder with one CSV table per sheet; nested values are written as JSON text."""
    names = sheet_names(sheets)
    for name, df in zip(names, sheets.values()):
        flat = df.select(*[F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in df.dtypes])
        flat.write.mode("overwrite" if overwrite else "errorifexists").option("header", True).csv(f"{path}/{name}")
    return names


def write_manifest(spark: SparkSession, path: str, content: dict) -> None:
    """One JSON file on any file system, written aside and renamed; NaN and infinities, at any depth, are null."""
    strict = json.loads(json.dumps(content, default=lambda v: sorted(v) if isinstance(v, (set, frozenset)) else str(v)), parse_constant=lambda _: None)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target, aside = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(path + ".part")
    fs = target.getFileSystem(conf)
    out = fs.create(aside, True)
    out.write(bytearray(json.dumps(strict, ensure_ascii=False, indent=1, sort_keys=True).encode()))
    out.close()
    fs.delete(target, False)
    fs.rename(aside, target)


def markdown_table(df: DataFrame, rows: int = 20) -> str:
    """The first rows as a Markdown table, numbers with four decimals; a report, so only the lines that are shown are fetched."""
    shown = [F.format_string("%.4f", f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.replace(F.col(f"`{f.name}`").cast("string"), F.lit("|"), F.lit("\\|")) for f in df.schema]
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.when(F.col(f"`{c}`").isNull(), "").otherwise(v) for c, v in zip(df.columns, shown)]), F.lit(" |"))
    body = [r.line for r in df.select(line.alias("line")).take(rows + 1)]
    return "\n".join([f"| {' | '.join(df.columns)} |", "|" + " --- |" * len(df.columns), *body[:rows], *([f"\nFirst {rows} rows."] if len(body) > rows else [])])


def shapes(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """(name, rows, columns, bytes, files) of written Parquet tables; rows come from file footers, columns from the schema."""
    out = []
    for name, path in paths.items():
        df = spark.read.parquet(path)
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).load(path).agg(F.sum("length").alias("b"), F.count("*").alias("n")).first()
        out.append((name, df.count(), len(df.columns), files.b, files.n))
    return spark.createDataFrame(out, "name string, rows long, columns int, bytes long, files long")


def write_appendix(spark: SparkSession, sections: dict[str, dict[str, DataFrame]], path: str, overwrite: bool = False) -> dict[str, list[str]]:
    """A bundle per section and one manifest that names its sheets."""
    written = {section: write_bundle(sheets, f"{path}/{section}", overwrite) for section, sheets in sections.items()}
    write_manifest(spark, f"{path}/manifest.json", written)
    return written


def in_order(df: DataFrame, *keys: str) -> DataFrame:
    """Rows in one possible order only: by the keys, then by all other columns, missing values last."""
    rest = [f.name for f in df.schema if f.name not in keys and not f.dataType.simpleString().startswith(("map", "variant"))]
    return df.orderBy(*[F.col(f"`{c}`").asc_nulls_last() for c in (*keys, *rest)])


def column_dictionary(**tables: DataFrame) -> DataFrame:
    """(table, position, column, type, nullable) of several tables, from their schemas."""
    spark = next(iter(tables.values())).sparkSession
    rows = [(t, i, f.name, f.dataType.simpleString(), f.nullable) for t, df in tables.items() for i, f in enumerate(df.schema, 1)]
    return spark.createDataFrame(rows, "table string, position int, column string, type string, nullable boolean")
