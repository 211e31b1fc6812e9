"""MinHash near-dedup: fast similarity sketching, banding, exact verification and connected components.

A sketch has 128 coordinates. In round i every shingle is hashed to a bin and a value in [i, i+1); each bin keeps
its least value, and rounds go on until every bin is filled (from round 128 on, round i fills bin i-128), so every
coordinate is filled and the estimate concentrates as for independent MinHashes. Most texts need one or two rounds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import load, ship
from . import textkernel as tk
from .scratch import Scratch, free, join_hot, small, spread

SHINGLE = 5
COORDS = 128
ROWS = 4
#: A pair of likeness 0.75 is missed by all 32 bands with probability 5e-6.
BANDS = COORDS // ROWS
PERCENT = 75
_EMPTY = np.uint64(2**64 - 1)
_SEEDS = tk.mix(np.arange(1, 2 * COORDS + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
_BAND_COEF = tk.mix(np.arange(1001, 1001 + COORDS, dtype=np.uint64)) | np.uint64(1)


def sketches(sh: np.ndarray, off: np.ndarray, t: int = COORDS) -> np.ndarray:
    """Rows of t filled coordinates; of a document without shingles all are the empty value."""
    n = len(off) - 1
    table = np.full((n, t), _EMPTY)
    flat = table.reshape(-1)
    doc = np.repeat(np.arange(n), np.diff(off))
    shift = np.uint64(64 - t.bit_length() + 1)
    for i in range(2 * t):
        if not len(sh):
            break
        h = tk.mix(sh ^ _SEEDS[i % len(_SEEDS)])
        b = (h >> shift).astype(np.int64) if i < t else i - t
        np.minimum.at(flat, doc * t + b, np.uint64(i) << np.uint64(56) | (tk.mix(h) >> np.uint64(8)))
        open_ = (table == _EMPTY).any(axis=1)
        go = open_[doc]
        sh, doc = sh[go], doc[go]
    return table


def band_keys(table: np.ndarray, rows: int = ROWS) -> np.ndarray:
    n, t = table.shape
    k = (table * _BAND_COEF[:t]).reshape(n, t // rows, rows).sum(axis=2, dtype=np.uint64)
    return tk.mix(k ^ _BAND_COEF[: t // rows]).view(np.int64)


def set_digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def sketch_table(docs: DataFrame) -> DataFrame:
    """doc_id, number of distinct shingles, digest of the whole set, band keys and 16 bits of each coordinate. No shuffle."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = tk.column_bytes(batch.column("text"))
            for a, b in tk.chunks(off):
                w = tk.Words(buf[off[a] : off[b]], off[a : b + 1] - off[a])
                sh, first = tk.shingles(w.hashes(), w.first, SHINGLE)
                sets = list(tk.distinct_sets(sh, first))
                some = np.diff(first) > 0
                table = sketches(sh, first)
                keys = band_keys(table)
                low = (tk.mix(table) & np.uint64(0xFFFF)).astype(np.uint16)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(a, b - a),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([set_digest(s) if len(s) else None for s in sets], pa.binary()),
                        pa.array([k if x else None for k, x in zip(keys, some, strict=True)], pa.list_(pa.int64())),
                        pa.array([r.tobytes() if x else None for r, x in zip(low, some, strict=True)], pa.binary()),
                    ],
                    names=["doc_id", "n_shingles", "digest", "bands", "low"],
                )

    return docs.mapInArrow(tk.tidied(run), "doc_id long, n_shingles long, digest binary, bands array<long>, low binary")


def _sets(docs: DataFrame) -> DataFrame:
    """doc_id and the sorted distinct shingle hashes of the whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = tk.column_bytes(batch.column("text"))
            for a, b in tk.chunks(off):
                w = tk.Words(buf[off[a] : off[b]], off[a : b + 1] - off[a])
                sh, first = tk.shingles(w.hashes(), w.first, SHINGLE)
                sets = [s.view(np.int64) for s in tk.distinct_sets(sh, first)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(sets, pa.list_(pa.int64()))], names=["doc_id", "s"])

    return docs.mapInArrow(tk.tidied(run), "doc_id long, s array<long>")


def confirm(pairs: DataFrame, docs: DataFrame, scratch: Scratch, name: str, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) with `both`, the size of the intersection of the whole sets, and `link`: 100 * both >= percent * union."""
    need = scratch.put(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), f"{name}-ids")
    sets = scratch.put(_sets(docs.join(small(need), "doc_id", "left_semi")), f"{name}-sets")
    left, right = sets.select(F.col("doc_id").alias("a"), F.col("s").alias("sa")), sets.select(F.col("doc_id").alias("b"), F.col("s").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    joined = spread(spread(pairs, right, "b", "a", pairs), left, "a", "b", pairs).withColumn("both", both)
    link = F.col("both") * 100 >= (F.size("sa") + F.size("sb") - F.col("both")) * percent
    links = scratch.put(joined.select("a", "b", "both", link.alias("link")).distinct(), f"{name}-links")
    scratch.drop(f"{name}-sets", f"{name}-ids")
    return links


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, label): label is the least node of the component. Least labels pass along edges and jump to the label's label."""
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("other"))
    both = scratch.put(both.unionByName(both.select(F.col("other").alias("node"), F.col("node").alias("other"))).where("node <> other").distinct(), f"{name}-edges")
    lab = scratch.put(both.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("label")), f"{name}-0")
    for i in range(1, 200):
        near = both.join(lab.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("label").alias("m"))
        step = lab.join(near, "node", "left").select("node", F.least("label", F.coalesce("m", "label")).alias("label"), F.col("label").alias("old"))
        up = lab.select(F.col("node").alias("label"), F.col("label").alias("up"))
        new = scratch.put(step.join(up, "label", "left").select("node", F.least("label", F.coalesce("up", "label")).alias("label"), "old"), f"{name}-{i}")
        scratch.drop(f"{name}-{i - 1}")
        lab = new.select("node", "label")
        if new.where("label <> old").isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    return lab


def mixed(rows: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """The rows (band, doc_id, label, n) of bands that hold two components or more, and the least set size in the band. A band of
    very many rows isn't gathered: its least size is sent to where they lie."""
    rows = scratch.put(rows, f"{name}-all")
    some = rows.groupBy("band").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.min("n").alias("least"), F.count(F.lit(1)).alias("times"))
    some = scratch.put(some.where("lo < hi").select("band", "least", "times"), f"{name}-bands")
    return join_hot(rows, some, ["band"], "inner", "times")


def prune(rows: DataFrame, docs: DataFrame, scratch: Scratch, times: int = 2) -> tuple[DataFrame, DataFrame]:
    """(rows of mixed bands that can still have a link to another component, with c; their documents' shingles).

    c counts the shingles of a document that stand in another document of these rows. A link needs an intersection of
    75/175 of both sizes, which c bounds; the partner is as large as the least set of the band, and as 75 % of this one.
    Rows that fall short of it link with nothing in the band, so a group of copies too far from each other isn't
    compared pair by pair. What goes changes what is left of c, so this is done again; any number of times loses no link.
    """
    rows = scratch.put(rows, "mixed-0")
    ids = scratch.put(rows.select("doc_id").distinct(), "mixed-ids")
    sets = _sets(docs.join(small(ids), "doc_id", "left_semi"))
    sh = scratch.put(sets.select("doc_id", F.explode("s").alias("s")), "mixed-shingles-0")
    for i in range(1, times + 1):
        alone = sh.groupBy("s").agg(F.min("doc_id").alias("doc_id"), F.max("doc_id").alias("last")).where("doc_id = last").groupBy("doc_id").agg(F.count(F.lit(1)).alias("alone"))
        c = F.col("n") - F.coalesce("alone", F.lit(0))
        floor = F.greatest(F.col("least"), F.ceil(F.col("n") * PERCENT / 100))
        left = rows.drop("c").join(alone, "doc_id", "left").withColumn("c", c).where(F.col("c") * (100 + PERCENT) >= (F.col("n") + floor) * PERCENT)
        rows = scratch.put(mixed(left.drop("least", "alone"), scratch, f"left-{i}"), f"mixed-{i}")
        scratch.drop(f"mixed-{i - 1}", f"left-{i}-all", f"left-{i}-bands")
        keep = scratch.put(rows.select("doc_id").distinct(), f"mixed-ids-{i}")
        sh = scratch.put(sh.join(small(keep), "doc_id", "left_semi"), f"mixed-shingles-{i}")
        scratch.drop(f"mixed-shingles-{i - 1}")
    return rows, sh


def across(rows: DataFrame, sh: DataFrame, known: DataFrame) -> DataFrame:
    """Candidate pairs (a, b) between components: documents that share one of their rarest shingles.

    Of a linked pair at most n - 75/175 * (n + partner's n) shingles of either are not the other's, so the one more than that
    which are rarest hold a common one, and the first common one leaves enough behind it in both. In a group of copies these
    are mostly the edits, not what the whole group shares. Of documents compared with the same center, the intersection is at
    most the lesser of what they share with it and the lesser of what they don't.
    """
    docs = rows.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("n").alias("n"), F.max("c").alias("c"), F.min("least").alias("least"))
    near = known.groupBy(F.col("b").alias("doc_id")).agg(F.max_by("a", F.struct("both", -F.col("a"))).alias("center"), F.max("both").alias("held"))
    docs = docs.join(near, "doc_id", "left").withColumn("held", F.coalesce("held", "n")).withColumn("center", F.coalesce("center", "doc_id"))
    floor = F.greatest(F.col("least"), F.ceil(F.col("n") * PERCENT / 100))
    docs = docs.withColumn("p", (F.col("n") - F.ceil((F.col("n") + floor) * PERCENT / (100 + PERCENT)) + 1).cast("int"))
    rare = sh.join(sh.groupBy("s").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "s").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("df", "s"))).alias("s"))
    # those of one document come first and match nothing; at is the place among all
    rare = rare.join(docs, "doc_id").withColumn("alone", F.col("n") - F.size("s")).where(F.col("p") > F.col("alone"))
    rare = rare.select("doc_id", "label", "n", "c", "center", "held", "alone", F.posexplode(F.slice("s", 1, (F.col("p") - F.col("alone")).cast("int"))).alias("k", "s"))
    rare = rare.withColumn("s", F.col("s.s")).withColumn("at", F.col("alone") + F.col("k")).drop("alone", "k")
    other = rare.select("s", *(F.col(c).alias(f"{c}_y") for c in rare.columns if c != "s"))
    enough = lambda most: most * (100 + PERCENT) >= (F.col("n") + F.col("n_y")) * PERCENT
    by_center = F.least("held", "held_y") + F.least(F.col("n") - F.col("held"), F.col("n_y") - F.col("held_y"))
    able = (F.col("label") < F.col("label_y")) & enough(F.least("c", "c_y")) & enough(F.least(F.col("n") - F.col("at"), F.col("n_y") - F.col("at_y")))
    able = able & ((F.col("center") != F.col("center_y")) | enough(by_center))
    return rare.join(other, (rare["s"] == other["s"]) & able).select(F.least("doc_id", "doc_id_y").alias("a"), F.greatest("doc_id", "doc_id_y").alias("b")).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document (other columns are ignored).

    Texts of equal shingle sets are one class, whose least doc_id stands for it. Classes that share a band are candidates:
    each bucket's classes are first compared with its least one; then, in buckets that still hold several components,
    the classes of different components that share enough shingles to be linked at all. So pairs within a component
    aren't compared, however large the group of copies, and no candidate pair across components is left out. Each link is
    confirmed on whole sets.
    A null, empty or wordless text has an empty set and no links. A row with a null id takes no part in links: component_id is
    null, kept is true. Repeated rows and rows of one id are the same document. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    scratch = Scratch(spark, "neardup")
    sk = scratch.put(sketch_table(docs), "sketch")
    classes = sk.where("digest is not null and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n"))
    multi = scratch.put(classes.where("n > 1"), "classes")
    of_class = join_hot(sk.drop("low"), multi, ["digest"], "left", "n")
    member = scratch.put(of_class.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id")).alias("rep")), "member")
    stands = of_class.where("digest is not null and doc_id is not null").where("rep is null or rep = doc_id")
    bands = stands.select("doc_id", F.explode("bands").alias("band"))
    shared = bands.groupBy("band").agg(F.min("doc_id").alias("center"), F.max("doc_id").alias("last")).where("center < last").select("band", "center")
    bucket = scratch.put(bands.join(shared, "band"), "bucket")
    stars = scratch.put(bucket.where("center <> doc_id").select(F.col("center").alias("a"), F.col("doc_id").alias("b")).distinct(), "stars")
    known = confirm(stars, docs, scratch, "star")
    links = known.where("link").select("a", "b")
    label = components(links, scratch, "cc1")

    of = bucket.join(label.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("band", "doc_id", F.coalesce("label", "doc_id").alias("label"))
    rows = mixed(of.join(sk.select("doc_id", F.col("n_shingles").alias("n")).distinct(), "doc_id"), scratch, "placed")
    cross = across(*prune(rows, docs, scratch), known)
    cross = scratch.put(cross.join(stars, ["a", "b"], "left_anti"), "cross")
    if not cross.isEmpty():
        more = confirm(cross, docs, scratch, "cross").where("link").select("a", "b")
        if not more.isEmpty():
            label = components(links.unionByName(more), scratch, "cc2")
    out = member.join(label.withColumnRenamed("node", "rep"), "rep", "left").select("doc_id", "n_shingles", F.coalesce("label", "rep").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op8_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(load(spark, sf_dir, "documents"))


def stage_neardup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near duplicates, and all others, with all their columns. Rows of one id are one
    document and stay or go together. Null and empty texts, null ids and an empty table stay."""
    doc_id = free("doc_id_", docs)
    gone = Scratch(spark, "neardup-gone").put(near_duplicates(docs).where("not kept").select(F.col("doc_id").alias(doc_id)).distinct(), "gone")
    return docs.join(small(gone), F.col("doc_id") == F.col(doc_id), "left_anti").select(*docs.columns)
