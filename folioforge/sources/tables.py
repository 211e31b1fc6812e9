"""Nested JSON, report folders, directory listings, and writes that replace, append, delete or cascade."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from .versions import Versioned

QUESTION = "struct<number:int,stem:string,bogi:string,choices:map<string,string>,content:string>"
SEGMENTS = f"struct<passages:array<struct<id:string,question_range:string,content:string>>,questions:array<{QUESTION}>>"


def sql_table(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """A table of a database by JDBC; filters and columns are pushed down."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def questions_of(segments: Column) -> Column:
    """Questions of a segments document; they may be a JSON list or a JSON text of that list, bad JSON gives null."""
    direct = F.from_json(F.get_json_object(segments, "$.questions"), f"array<{QUESTION}>")
    inner = F.from_json(F.get_json_object(F.concat(F.lit('{"q":'), F.get_json_object(segments, "$.questions"), F.lit("}")), "$.q"), f"array<{QUESTION}>")
    return F.coalesce(direct, inner)


def repair_json(text: Column) -> Column:
    """A model's JSON reply without a code fence: as it is if it parses, else with control characters escaped within its strings,
    else an empty object."""
    bare = F.regexp_replace(text, r"(?s)^\s*```(?:json)?\s*|\s*```\s*$", "")
    parses = lambda c: F.try_parse_json(c).isNotNull()
    again = _escape_strings(bare)
    return F.when(parses(bare), bare).when(parses(again), again).otherwise(F.lit("{}"))


@F.pandas_udf(T.StringType())
def _escape_strings(text: pd.Series) -> pd.Series:
    """Raw control characters within string literals as JSON escapes."""
    names = {"\n": "\\n", "\r": "\\r", "\t": "\\t"}
    control = lambda m: names.get(m[0], f"\\u{ord(m[0]):04x}")
    literal = lambda m: re.sub(r"[\x00-\x1f]", control, m[0])
    return text.map(lambda t: None if t is None else re.sub(r'"(?:[^"\\]|\\.)*"', literal, t, flags=re.S))


def element_of(items: Column, field: str, value: Column) -> Column:
    """The first struct of an array whose field is the number, whatever type the field has; null without one."""
    return F.get(F.filter(items, lambda x: x[field].try_cast("int") == value), 0)


def of_kind(items: Column, kind: str, field: str = "kind") -> Column:
    """The structs of an array whose field is of that kind, in any case."""
    return F.filter(items, lambda x: F.lower(x[field]) == kind.lower())


def objects_only(items: Column) -> Column:
    """The items of a JSON array (a text) that are objects, as texts."""
    return F.filter(F.from_json(items, "array<string>"), lambda x: x.startswith("{"))


def write_snapshot(snap: DataFrame, path: str) -> None:
    """A snapshot (filename, category, fingerprint) as JSON documents, one a file with its warnings and their counts by category,
    and a summary beside them."""
    by = snap.groupBy("filename", "category").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("fingerprint")).alias("fingerprints"))
    files = by.groupBy("filename").agg(F.sum("n").alias("total"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "n")))).alias("counts"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "fingerprints")))).alias("warnings"))
    files.write.mode("overwrite").json(f"{path}/files")
    total = snap.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    total.agg(F.sum("n").alias("total"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "n")))).alias("counts")).write.mode("overwrite").json(f"{path}/summary")


def latest_reports(reports: DataFrame, key: str = "filename", at: str = "timestamp") -> DataFrame:
    """The report of each key with the greatest time."""
    cols = [c for c in reports.columns if c != key]
    best = F.max_by(F.struct(*cols), F.col(at)).alias("r")
    return reports.groupBy(key).agg(best).select(key, *(F.col(f"r.{c}").alias(c) for c in cols))


def read_reports(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON reports, one document a file (an object or a list), with the file's name; broken files give no rows."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(path).withColumn("report_path", F.col("_metadata.file_name"))


def listing(spark: SparkSession, path: str, extensions: tuple[str, ...]) -> DataFrame:
    """(path, name, length, modified) of the files below a folder with one of the extensions. Contents aren't read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", F.col("modificationTime").alias("modified"))
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return rows.withColumn("name", name).where(F.lower(name).rlike(rf"\.({'|'.join(extensions)})$"))


def first_folder(files: DataFrame, order: list[str]) -> DataFrame:
    """Files of the first folder in the order that has any, for each job: files has job_id, folder, name."""
    rank = F.coalesce(*(F.when(F.col("folder") == f, F.lit(i)) for i, f in enumerate(order)))
    best = files.withColumn("rank", rank).where("rank is not null")
    return best.join(best.groupBy("job_id").agg(F.min("rank").alias("rank")), ["job_id", "rank"]).drop("rank")


def stale(files: DataFrame, cache: DataFrame) -> DataFrame:
    """Files without a cache entry as new as they are: files (file, modified), cache (file, cached)."""
    return files.alias("f").join(cache.alias("c"), (F.col("f.file") == F.col("c.file")) & (F.col("c.cached") >= F.col("f.modified")), "left_anti")


def overwrite_keys(rows: DataFrame, path: str, key: str) -> None:
    """Replace the partitions of the keys that rows has; others stay. Running it again gives the same table."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def insert(rows: DataFrame, path: str, defaults: dict[str, object], key: str = "id") -> DataFrame:
    """Append rows with defaults for nulls and a new key where there is none."""
    out = rows.withColumn(key, F.coalesce(F.col(key), F.uuid())) if key in rows.columns else rows.withColumn(key, F.uuid())
    for c, v in defaults.items():
        out = out.withColumn(c, F.coalesce(F.col(c), F.lit(v)) if c in rows.columns else F.lit(v))
    out.write.mode("append").parquet(path)
    return out


def set_json_key(doc: Column, key: str, value: Column) -> Column:
    """A JSON object with one key replaced (a column of any type) and the others kept as they are, nested ones too. What is no
    JSON object counts as an empty one."""
    kind = "map<string,variant>"
    kept = F.map_filter(F.coalesce(F.from_json(doc, kind), F.from_json(F.lit("{}"), kind)), lambda k, _: k != key)
    new = F.from_json(F.to_json(F.struct(value.alias(key)), {"ignoreNullFields": "false"}), kind)
    return F.to_json(F.map_concat(kept, new))


def delete_ids(rows: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return rows.join(ids.select(key).distinct(), key, "left_anti")


def cascade(tables: dict[str, DataFrame], ids: DataFrame, key: str) -> dict[str, DataFrame]:
    """Every table that has the key, without the rows of the deleted ids."""
    return {name: delete_ids(t, ids, key) if key in t.columns else t for name, t in tables.items()}


def reference_counts(tables: dict[str, DataFrame], ids: DataFrame, key: str) -> DataFrame:
    """(table, key, rows) that a cascade would delete."""
    out = None
    for name, t in sorted(tables.items()):
        if key in t.columns:
            one = t.join(ids.select(key).distinct(), key).groupBy(key).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), key, "rows")
            out = one if out is None else out.unionByName(one)
    return out


def form_text(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def form_int(c: Column) -> Column:
    return F.when(F.trim(c).rlike(r"^\d+$"), F.trim(c).try_cast("int"))


def with_columns(rows: DataFrame, schema: T.StructType) -> DataFrame:
    """rows with the schema's columns: those it lacks are null, those it has beyond are kept."""
    return rows.select("*", *(F.lit(None).cast(f.dataType).alias(f.name) for f in schema if f.name not in rows.columns))


def backup(rows: DataFrame, path: str) -> None:
    """Write once before a change; an existing backup is an error."""
    rows.write.mode("errorifexists").parquet(path)


def report_lines(rows: DataFrame, columns: list[str]) -> list[str]:
    """A Markdown table of a small result."""
    out = ["| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns)]
    for r in rows.select(*columns).toLocalIterator():
        out.append("| " + " | ".join("" if v is None else str(v) for v in r) + " |")
    return out


def apply(rows: DataFrame, table: Versioned, dry_run: bool = True) -> DataFrame:
    """The rows as they would be in the table, or as they are in it: written only if it isn't a dry run, as its next version, so that
    they may be read from the table itself and a driver lost on the way leaves the table as it was."""
    if dry_run:
        return rows
    return table.read(table.replace(rows))
