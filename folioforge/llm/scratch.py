"""Tables in the shared folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where it is unset, a local session (tests) gets one temporary folder per context;
    on a cluster, whose hosts share no temporary folder, that is an error."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        base = getattr(sc, "_folioforge_scratch", None)
        if not base and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir isn't set: intermediate tables need a folder that all hosts share")
        if not base:
            base = sc._folioforge_scratch = "file://" + tempfile.mkdtemp(prefix="folioforge-")
        sc.setCheckpointDir(base)
    return base.rstrip("/")


class Scratch:
    """One job's folder. put() writes a table and reads it back, which cuts lineage and survives lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def put(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables that no later plan reads (all of them without names)."""
        jvm = self.spark._jvm
        for path in [self.path(n) for n in names] or [self.root]:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


#: Bytes of a table that is broadcast at most; a larger one is joined by a shuffle.
BROADCAST_BYTES = 16 << 20
#: Rows of one key that a join puts in one task at most; a key of more rows is dealt over several.
CHUNK_ROWS = 256


def free(name: str, *tables: DataFrame) -> str:
    """name, with underscores behind it until no column of the tables has it in any case."""
    taken = {c.lower() for t in tables for c in t.columns}
    while name.lower() in taken:
        name += "_"
    return name


def others(df: DataFrame, *names: str) -> list:
    """Fields of df but those that have one of the names in any case."""
    low = {n.lower() for n in names}
    return [f for f in df.schema if f.name.lower() not in low]


def _width(field: T.StructField) -> Column:
    c, kind = F.col(f"`{field.name}`"), field.dataType
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.octet_length(c)
    if isinstance(kind, T.ArrayType):
        return F.size(c) * 8
    return F.lit(8)


def small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if its values, which are measured, have few bytes. df is a written table or a part of one."""
    row = sum((F.coalesce(_width(f), F.lit(0)) for f in df.schema), F.lit(16)).cast("long")
    return F.broadcast(df) if (df.agg(F.sum(row)).first()[0] or 0) <= most else df


def join_hot(many: DataFrame, one: DataFrame, keys: list[str], how: str, times: str) -> DataFrame:
    """many joined with one (a row a key, whose column `times` says how often the key is in `many`; it is dropped).

    Keys that hold more than a thousandth of the rows of `many`, so fewer than a thousand keys, are joined by broadcast where
    their rows lie; the others by a shuffle.
    """
    total = one.agg(F.sum(times)).first()[0] or 0
    bar = max(CHUNK_ROWS, total // 1000)
    hot = F.broadcast(one.where(F.col(times) > bar).drop(times))
    cold = many.join(F.broadcast(one.where(F.col(times) > bar).select(*keys)), keys, "left_anti")
    return many.join(hot, keys).unionByName(cold.join(one.where(F.col(times) <= bar).drop(times), keys, how))


def spread(many: DataFrame, one: DataFrame, key: str, by: str, counted: DataFrame) -> DataFrame:
    """many joined with one (a row a key, which may be a large one). The rows of a hot key are dealt over tasks by a hash of
    column `by`, CHUNK_ROWS or so to each, and its row of `one` is sent to each of these. How many rows a key has is counted in
    `counted`, a written table with the keys of `many`."""
    hot = counted.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > CHUNK_ROWS)
    hot = small(hot.select(key, F.ceil(F.col("__n") / CHUNK_ROWS).cast("int").alias("__parts")))
    parts = F.coalesce("__parts", F.lit(1))
    left = many.join(hot, key, "left").withColumn("__part", F.pmod(F.xxhash64(by), parts).cast("int")).drop("__parts")
    right = one.join(hot, key, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("__parts")
    return left.join(right, [key, "__part"]).drop("__part")
