"""Tables that change as a whole: data files that are never touched again, and a log of commits that names those that count.

A table is a folder. Rows are dealt into buckets by a hash of their key; a write puts new files of the buckets it changes below
`data/`, and then one file into `_commits/`, whose name is the next number and whose lines name the folder of every bucket. That
file is written aside and renamed, which either happens or doesn't, and fails if another writer had the number first. Readers
take the last commit. A driver that is lost at any step leaves the table as it was, with some files that no commit names.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

BUCKET = "bucket_"


class Conflict(RuntimeError):
    """Another writer committed first: read again and repeat."""


class Versioned:
    """A table of `schema` with unique `keys` at `path`. Columns must not be named bucket_."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType | str, keys: list[str], buckets: int = 16):
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), keys, buckets
        self.schema = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)

    # --- the log ---

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def version(self) -> int:
        """The number of the last commit, 0 before the first."""
        fs, p = self._fs(f"{self.path}/_commits")
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        return max((int(n) for n in names if n.isdigit()), default=0)

    def _folders(self, version: int) -> dict[int, str]:
        if not version:
            return {}
        text = "\n".join(r[0] for r in self.spark.read.text(f"{self.path}/_commits/{version:012d}").collect())  # a line a bucket
        return {x["bucket"]: x["folder"] for x in map(json.loads, text.splitlines())}

    def _commit(self, base: int, folders: dict[int, str]) -> int:
        """The next version, unless another came first."""
        aside = f"{self.path}/_commits/.{uuid.uuid4().hex}"
        fs, p = self._fs(aside)
        out = fs.create(p, False)
        out.write(bytearray("".join(json.dumps({"bucket": b, "folder": f}) + "\n" for b, f in sorted(folders.items())), "utf-8"))
        out.close()
        _, to = self._fs(f"{self.path}/_commits/{base + 1:012d}")
        if fs.exists(to) or not fs.rename(p, to):
            fs.delete(p, False)
            raise Conflict(f"version {base + 1} of {self.path} is another writer's")
        return base + 1

    # --- reading and writing ---

    def _bucket(self):
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _read(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/{f}" for f in folders))

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the last one unless told."""
        return self._read(list(self._folders(self.version() if version is None else version).values()))

    def _write(self, rows: DataFrame) -> dict[int, str]:
        """Folders of the buckets that rows has, written."""
        name = f"data/{uuid.uuid4().hex}"
        rows.select(*self.schema.names).withColumn(BUCKET, self._bucket()).repartition(self.buckets, BUCKET).write.partitionBy(BUCKET).parquet(f"{self.path}/{name}")
        fs, p = self._fs(f"{self.path}/{name}")
        found = [s.getPath().getName() for s in fs.listStatus(p)]
        return {int(n.split("=")[1]): f"{name}/{n}" for n in found if n.startswith(f"{BUCKET}=")}

    def replace(self, rows: DataFrame) -> int:
        """rows in place of all there are; they may be read from this table."""
        base = self.version()
        return self._commit(base, self._write(rows))

    def merge(self, rows: DataFrame, delete: DataFrame | None = None) -> int:
        """Update the rows of equal keys by those of `rows` (nulls don't overwrite), insert the others, and drop the keys of `delete`.

        Of rows of one key, which must not be null, the greatest in the order of its columns counts. Only buckets with a row that
        changes are written anew; without one there is no new version, so that repeating a merge changes nothing.
        """
        base = self.version()
        folders, values = self._folders(base), [n for n in self.schema.names if n not in self.keys]
        pack = F.struct(*values) if values else F.struct(F.lit(1).alias("one"))
        new = rows.select(*self.schema.names).groupBy(*self.keys).agg(F.max(pack).alias("new"))
        old = self._read(list(folders.values())).select(*self.keys, pack.alias("old"))
        both = old.join(new, self.keys, "full")
        if delete is not None:
            both = both.join(delete.select(*self.keys).distinct().withColumn("gone", F.lit(True)), self.keys, "left")
        else:
            both = both.withColumn("gone", F.lit(None).cast("boolean"))
        better = F.struct(*(F.coalesce(f"new.{v}", f"old.{v}").alias(v) for v in values)) if values else pack
        both = both.withColumn("now", F.when(F.col("gone"), None).otherwise(F.when(F.col("new").isNull(), F.col("old")).otherwise(better))).withColumn(BUCKET, self._bucket())
        touched = [r[0] for r in both.where(~F.col("now").eqNullSafe(F.col("old"))).select(BUCKET).distinct().collect()]  # numbers of buckets
        if not touched:
            return base
        kept = both.where(F.col(BUCKET).isin(touched) & F.col("now").isNotNull())
        written = self._write(kept.select(*self.keys, *(F.col(f"now.{v}").alias(v) for v in values)))
        return self._commit(base, {b: f for b, f in folders.items() if b not in touched} | written)


MEMO = "file string, modified timestamp, result string"


def memoised(files: DataFrame, extract: Callable[[DataFrame], DataFrame], memo: Versioned) -> DataFrame:
    """(file, modified, result) of files (file, modified): taken from the memo where it is as new as the file, else extracted and put
    into the memo. extract gets the stale files and returns file and result. A null result is extracted again the next time."""
    held = memo.read().where("result is not null")
    stale = files.join(held.select("file", F.col("modified").alias("held")), "file", "left").where("held is null or held < modified").drop("held")
    if not stale.isEmpty():
        new = extract(stale).select("file", "result").join(stale.select("file", "modified"), "file")
        memo.merge(new.where("result is not null"))
    now = memo.read().alias("m")
    return files.alias("f").join(now, (F.col("f.file") == F.col("m.file")) & (F.col("m.modified") >= F.col("f.modified")), "left").select("f.file", "f.modified", "m.result")
