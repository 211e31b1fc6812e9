"""Token counts by source, language and tokenizer version, maintained by signed deltas.

A change of a document is an insert, a delete or a revised count. It becomes one row to subtract, one to add, or both;
a batch sums these by group and is written once as a folder named after it. Totals are the sum of all batches' rows, so
they cost a scan of small tables, not of the corpus. A batch is written aside and renamed into place: a retried or
repeated batch finds its folder there and changes nothing, and a lost driver leaves no half batch. Batches are merged into
a base from time to time, which remembers their names, so totals don't read every batch that ever was.
"""

from __future__ import annotations

import base64
import re
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..session import load, ship
from . import textkernel as tk
from .scratch import Scratch, others

GROUP = ["source", "lang", "tokenizer"]
#: Tokenizer version -> file of ranks.
TOKENIZERS = {"byte_bpe_50k": "/opt/tokenizers/byte_bpe_50k.tiktoken", "byte_bpe_multi_50k": "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"}
#: Fixed value: how both tokenizers split a text before merging bytes.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CHARS_A_TOKEN = 4

_encodings: dict = {}


def _encoding(name: str, ranks: bytes, pattern: str):
    if name not in _encodings:
        import tiktoken

        pairs = (line.split() for line in ranks.splitlines() if line)
        _encodings[name] = tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks={base64.b64decode(a): int(b) for a, b in pairs}, special_tokens={})
    return _encodings[name]


def count_tokens(docs: DataFrame, tokenizers: dict[str, str] = TOKENIZERS, pattern: str = PATTERN, text: str = "text") -> DataFrame:
    """All columns of docs but the text, with `tokenizer` and `tokens`: one row for each tokenizer. A null or empty text has no
    tokens, repeated rows count each; columns of docs named as the added ones, in any case, are replaced.

    The rank files are read on the driver and broadcast (fixed in size by their vocabularies). No shuffle.
    """
    spark = docs.sparkSession
    ship(spark)
    ranks = {}
    for name, path in tokenizers.items():
        with open(path, "rb") as f:
            ranks[name] = f.read()
    shared = spark.sparkContext.broadcast(ranks)
    kept = others(docs, text, "tokenizer", "tokens")
    schema = T.StructType([*kept, T.StructField("tokenizer", T.StringType()), T.StructField("tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encodings = {n: _encoding(n, r, pattern) for n, r in shared.value.items()}
        for batch in batches:
            cols = [batch.column(f.name) for f in kept]
            counts: dict[str, list[int]] = {n: [] for n in encodings}
            for x in batch.column(text):
                s = x.as_py() or ""
                for n, e in encodings.items():
                    counts[n].append(len(e.encode_ordinary(s)) if s else 0)
            for n, c in counts.items():
                yield pa.RecordBatch.from_arrays([*cols, pa.array([n] * len(c), pa.string()), pa.array(c, pa.int64())], names=schema.names)

    return docs.mapInArrow(tk.tidied(run), schema)


def signed(changes: DataFrame) -> DataFrame:
    """Delta rows (source, lang, tokenizer, docs, tokens) of changes with columns op, source, lang, tokenizer, tokens, old_tokens.

    op is insert (adds tokens), delete (takes old_tokens away) or revise (both, in one group; a document that moves to
    another group is a delete and an insert). Null counts are 0, null groups are groups; another op is an error.
    """
    add, sub = F.coalesce("tokens", F.lit(0)), F.coalesce("old_tokens", F.lit(0))
    known = F.when(F.col("op").isin("insert", "delete", "revise"), F.col("op")).otherwise(F.raise_error(F.concat(F.lit("unknown op "), F.coalesce("op", F.lit("null")))))
    op = changes.withColumn("op", known)
    docs = F.when(F.col("op") == "insert", 1).when(F.col("op") == "delete", -1).otherwise(0).cast("long")
    tokens = F.when(F.col("op") == "insert", add).when(F.col("op") == "delete", -sub).otherwise(add - sub).cast("long")
    return op.select(*GROUP, docs.alias("docs"), tokens.alias("tokens"))


class Rollup:
    """Totals in a folder of batches and of bases that batches were merged into; the newest base counts."""

    SCHEMA = "source string, lang string, tokenizer string, docs long, tokens long"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.jvm = spark._jvm
        root = self.jvm.org.apache.hadoop.fs.Path(self.path)
        self.fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
        self.fs.mkdirs(root)

    def _p(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    @staticmethod
    def _name(batch: str) -> str:
        return "batch-" + re.sub("%", "_", quote(batch, safe=""))

    def _folders(self, kind: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self._p("")) if s.getPath().getName().startswith(kind))

    def _base(self) -> str | None:
        """The newest base."""
        return next(reversed(self._folders("base-")), None)

    def _names(self) -> DataFrame:
        """The names of the batches in the newest base."""
        base = self._base()
        none = self.spark.createDataFrame([], "name string")
        return self.spark.read.schema("name string").parquet(f"{self.path}/{base}/names") if base else none

    def _merged(self, names: list[str]) -> set[str]:
        """Those of the names that are in the newest base. What was ever merged stays in its table; only these are looked up in it."""
        return {r["name"] for r in self._names().where(F.col("name").isin(names)).collect()} if names else set()

    def committed(self) -> list[str]:
        """The names of all batches there ever were, for a report; nothing here needs the list."""
        return sorted({*self._folders("batch-"), *(r["name"] for r in self._names().toLocalIterator())})

    def _rename(self, aside: str, name: str) -> bool:
        # rename into an existing folder would nest: the check and the target's absence decide who wins
        if self.fs.exists(self._p(name)) or not self.fs.rename(self._p(aside), self._p(name)):
            self.fs.delete(self._p(aside), True)
            return False
        if self.fs.exists(self._p(f"{name}/{aside}")):  # another writer was faster
            self.fs.delete(self._p(f"{name}/{aside}"), True)
            return False
        return True

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Add a batch of changes; False, and nothing is done, if a batch of that name is there."""
        name = self._name(batch)
        if self.fs.exists(self._p(name)) or self._merged([name]):
            return False
        aside = f"_aside-{uuid.uuid4().hex}"
        sums = signed(changes).groupBy(*GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        sums.write.parquet(f"{self.path}/{aside}")
        return self._rename(aside, name)

    def _rows(self) -> tuple[DataFrame, list[str], set[str]]:
        """The sums that count, the batches that aren't in the base, and of those that are the ones whose folders are still there."""
        base, folders = self._base(), self._folders("batch-")
        merged = self._merged(folders)
        loose = [n for n in folders if n not in merged]
        paths = [f"{self.path}/{n}" for n in loose] + ([f"{self.path}/{base}/sums"] if base else [])
        rows = self.spark.read.schema(self.SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], self.SCHEMA)
        return rows.groupBy(*GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0 or tokens <> 0"), loose, merged

    def compact(self) -> bool:
        """Merge all batches into a new base; their folders and older bases go with the next call, so that running reads find them."""
        before = self._base()
        sums, loose, merged = self._rows()
        n = int(before.rpartition("-")[2]) + 1 if before else 1
        aside = f"_aside-{uuid.uuid4().hex}"
        sums.write.parquet(f"{self.path}/{aside}/sums")
        names = self._names().unionByName(self.spark.createDataFrame([(x,) for x in loose], "name string"))
        names.coalesce(8).write.parquet(f"{self.path}/{aside}/names")
        if not self._rename(aside, f"base-{n:09d}"):
            return False
        for old in [x for x in self._folders("base-") if x < (before or "")] + sorted(merged):
            self.fs.delete(self._p(old), True)
        return True

    def totals(self) -> DataFrame:
        """Documents and tokens of each group that has any."""
        return self._rows()[0]


#: The tokenizer version that op6 loads first and takes back: an estimate from the number of characters.
ESTIMATE = "estimate"


def op6_tokencounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents are inserted with estimated counts, under each tokenizer version and under one of the estimate alone.
    A second batch, sent twice, revises the counts to exact ones and deletes the estimate's documents; then batches are merged."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    scratch = Scratch(spark, "tokencounts")
    guess = F.ceil(F.coalesce(F.length("text"), F.lit(0)) / CHARS_A_TOKEN).cast("long")
    counts = scratch.put(count_tokens(docs.withColumn("old_tokens", guess)), "counts")
    rollup = Rollup(spark, scratch.path("rollup"))
    none = F.lit(None).cast("long")
    first = counts.where(F.col("tokenizer") == min(TOKENIZERS)).withColumn("tokenizer", F.lit(ESTIMATE))
    row = lambda rows, op, new, old: rows.select(F.lit(op).alias("op"), *GROUP, new.alias("tokens"), old.alias("old_tokens"))
    guessed = F.col("old_tokens")
    rollup.commit("load", row(counts.unionByName(first), "insert", guessed, none))
    exact = row(counts, "revise", F.col("tokens"), guessed).unionByName(row(first, "delete", none, guessed))
    rollup.commit("exact", exact)
    rollup.commit("exact", exact)
    rollup.compact()
    return rollup.totals()
