"""Joins that SQL has no operator for. All take equi keys first, so that rows are hashed by them before any comparison."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from .rows import blocks_of, kept


#: Rows of one key from which on a join of intervals goes by bins.
HOT_ROWS = 2000
LEVEL, BIN = "__level", "__bin"


def hot_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The keys of more than HOT_ROWS rows, so at most one in HOT_ROWS rows."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > HOT_ROWS).select(*keys)


def _level(lo: Column, hi: Column) -> Column:
    """The least level whose bins, two to its power wide, are as wide as the span."""
    return F.ceil(F.log2(F.greatest(hi - lo, F.lit(0)).cast("double") + 1)).cast("int")


def _binned(rows: DataFrame, span: tuple[Column, Column], levels: list[int], side: str) -> DataFrame:
    """rows, once for each bin that the span meets, at its own level and those of `levels` above it: two bins at most at each."""
    lo, hi = span
    r = rows.withColumn(f"__lo_{side}", lo.cast("double")).withColumn(f"__own_{side}", _level(lo, hi))
    both = lambda k: F.array_distinct(F.array(F.floor(lo / F.pow(F.lit(2.0), k)), F.floor(hi / F.pow(F.lit(2.0), k))))
    at = F.filter(F.array(*map(F.lit, levels)).cast("array<int>"), lambda k: k >= F.col(f"__own_{side}"))
    bins = F.flatten(F.transform(at, lambda k: F.transform(both(k), lambda b: F.struct(k.alias("k"), b.alias("b")))))
    return r.withColumn("__at", F.explode_outer(bins)).withColumn(LEVEL, F.col("__at.k")).withColumn(BIN, F.col("__at.b")).drop("__at")


def by_key_or_bin(a: DataFrame, b: DataFrame, keys: list[str], span_a: tuple[Column, Column], span_b: tuple[Column, Column], joined: Callable[[DataFrame, DataFrame, list], DataFrame]) -> DataFrame:
    """joined(a, b, conditions) of rows whose closed spans must meet: by their key, and those of a hot key by bins besides.

    joined aliases its tables a and b, joins them on the keys, on its own conditions and on those given, and groups by columns that
    both had. At each level bins are twice as wide as at the one below, so at its own a span meets two at most; a pair meets at
    the greater level of both, and of the bins there that both meet the first counts. What a hot key costs is linear in its
    rows, but for spans that meet or nearly do.
    """
    hot = hot_keys(b, keys)
    if hot.isEmpty():
        return joined(a, b, [])
    hot = kept(hot)
    cold = joined(a.join(hot, keys, "left_anti"), b.join(hot, keys, "left_anti"), [])
    ah, bh = a.join(hot, keys, "left_semi"), b.join(hot, keys, "left_semi")
    own = ah.select(_level(*span_a).alias("k")).unionByName(bh.select(_level(*span_b).alias("k")))
    levels = sorted(r[0] for r in own.where("k is not null").distinct().collect())  # some dozens of numbers at most
    width = F.pow(F.lit(2.0), F.col(f"a.{LEVEL}"))
    first = F.greatest(F.floor(F.col("a.__lo_a") / width), F.floor(F.col("b.__lo_b") / width))
    more = [F.col(f"a.{LEVEL}") == F.col(f"b.{LEVEL}"), F.col(f"a.{BIN}") == F.col(f"b.{BIN}"), F.col(f"a.{LEVEL}") == F.greatest("a.__own_a", "b.__own_b"), F.col(f"a.{BIN}") == first]
    return cold.unionByName(joined(_binned(ah, span_a, levels, "a"), _binned(bh, span_b, levels, "b"), more))


def range_first(rows: DataFrame, ranges: DataFrame, keys: list[str], at: str, start: str, end: str, order: str, out: str) -> DataFrame:
    """Each row with the least `order` of the ranges that hold its number, or null.

    The least is taken while joining, by one aggregate over the rows' own columns; ranges of a hot key are looked up by bins.
    """
    cols = rows.columns

    def joined(a: DataFrame, b: DataFrame, more: list) -> DataFrame:
        hit = a.alias("a").join(b.alias("b"), [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys] + [F.col(f"a.{at}").between(F.col(f"b.{start}"), F.col(f"b.{end}"))] + more, "left")
        return hit.groupBy(*(F.col(f"a.{c}") for c in cols)).agg(F.min(f"b.{order}").alias(out))

    return by_key_or_bin(rows, ranges, keys, (F.col(at), F.col(at)), (F.col(start), F.col(end)), joined)


def as_of(rows: DataFrame, points: DataFrame, keys: list[str], at: str, point: str, value: str, out: str, default: str | None) -> DataFrame:
    """Each row with the value of the last point at or before it, or the default.

    Rows and points are laid in one order per key and the last value is carried forward: one shuffle and one sort, and no
    pair of a row and a point is made.
    """
    cols = [c for c in rows.columns]
    a = rows.select(*cols, F.lit(None).cast(points.schema[value].dataType).alias("__v"), F.lit(1).alias("__row"), F.col(at).alias("__at"))
    b = points.select(*(F.col(c) if c in keys else F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in cols), F.col(value).alias("__v"), F.lit(0).alias("__row"), F.col(point).alias("__at"))
    w = Window.partitionBy(*keys).orderBy("__at", "__row").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b).withColumn(out, F.last("__v", ignorenulls=True).over(w)).where("__row = 1")
    got = F.col(out) if default is None else F.coalesce(F.col(out), F.lit(default))
    return both.select(*cols, got.alias(out))


def overlap_anti(rows: DataFrame, zones: DataFrame, keys: list[str], span: tuple[str, str], zone: tuple[str, str]) -> DataFrame:
    """Rows whose [start, end) meets no zone of their key."""
    cols = rows.columns
    meets = (F.col(f"a.{span[0]}") < F.col(f"b.{zone[1]}")) & (F.col(f"b.{zone[0]}") < F.col(f"a.{span[1]}"))
    on = lambda: [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys] + [meets]
    z = zones.select(*keys, *zone)
    if hot_keys(z, keys).isEmpty():
        return rows.alias("a").join(z.alias("b"), on(), "left_anti").select(*(F.col(f"a.{c}") for c in cols))

    def joined(a: DataFrame, b: DataFrame, more: list) -> DataFrame:
        return a.alias("a").join(b.alias("b"), on() + more).groupBy(*(F.col(f"a.{c}") for c in cols)).agg(F.lit(True).alias("__hit"))

    hit = by_key_or_bin(rows, z, keys, (F.col(span[0]), F.col(span[1])), (F.col(zone[0]), F.col(zone[1])), joined)
    return rows.join(hit, [rows[c].eqNullSafe(hit[c]) for c in cols], "left_anti")


def anti_both_ways(current: DataFrame, baseline: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of either side that the other lacks, with `change` new or gone."""
    new = current.join(baseline, keys, "left_anti").withColumn("change", F.lit("new"))
    return new.unionByName(baseline.join(current, keys, "left_anti").withColumn("change", F.lit("gone")))


def containing(docs: DataFrame, items: DataFrame, doc_id: str, text: str, item_id: str, item: str, words: int = 3) -> DataFrame:
    """(doc_id, item_id) of the texts that hold an item's whole text. Candidates share the item's second to fourth words, which
    white space bounds in the text too; items too short for that, few or none, are looked for in every text."""
    split = lambda c: F.split(c, r"\s+")
    named = items.where(F.col(item).isNotNull()).withColumn("__w", split(F.col(item)))
    able = F.size("__w") >= words + 2
    key = named.where(able).select(item_id, item, F.xxhash64(F.array_join(F.slice("__w", 2, words), " ")).alias("__key"))
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.size("__w") - words + 1, F.lit(1))), lambda i: F.xxhash64(F.array_join(F.slice("__w", i, words), " ")))
    seen = docs.where(F.col(text).isNotNull()).select(doc_id, split(F.col(text)).alias("__w")).select(doc_id, F.explode(F.array_distinct(grams)).alias("__key"))
    key = key.select(item_id, "__key")
    # the keys of the items are few beside the texts' grams: they go to every task if they are measured to be small
    near = seen.join(F.broadcast(key) if blocks_of(key) == 1 else key, "__key").select(doc_id, item_id).distinct()
    long = near.join(docs.select(doc_id, text), doc_id).join(items, item_id).where(F.col(text).contains(F.col(item))).select(doc_id, item_id)
    rest = named.where(~able).select(item_id, item)
    parts = blocks_of(rest)  # of any number, one block after the other is looked for
    block = lambda k: F.broadcast(rest.where(F.pmod(F.xxhash64(item_id), F.lit(parts)) == k))
    for k in range(parts):
        long = long.unionByName(docs.join(block(k), F.col(text).contains(F.col(item))).select(doc_id, item_id))
    return long
