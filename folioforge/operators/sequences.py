"""Sequence operators as windows: gaps, islands, zones, slices, runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def missing_numbers(rows: DataFrame, keys: list[str], n: str, most: int = 5) -> DataFrame:
    """Numbers left out between neighbours that are 2 to `most` apart; repeated numbers count once."""
    w = Window.partitionBy(*keys).orderBy(n)
    nxt = rows.select(*keys, n).distinct().withColumn("__next", F.lead(n).over(w))
    gap = F.col("__next") - F.col(n)
    return nxt.where(gap.between(2, most)).select(*keys, F.explode(F.sequence(F.col(n) + 1, F.col("__next") - 1)).alias("missing"))


def island_ids(rows: DataFrame, keys: list[str], n: str, step: float, out: str = "island") -> DataFrame:
    """Rows with the running number of their island: a new one starts where n is more than `step` above its predecessor."""
    w = Window.partitionBy(*keys).orderBy(n)
    new = F.coalesce((F.col(n) - F.lag(n).over(w) > step).cast("int"), F.lit(0))
    return rows.withColumn("__new", new).withColumn(out, F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def valid_numbers(rows: DataFrame, keys: list[str], n: str) -> DataFrame:
    """Question numbers that are believed: all of three or fewer, or of one island; else those of islands of two or more, and
    all again if there is no such island. One gap is allowed within an island."""
    all_ = Window.partitionBy(*keys)
    isl = island_ids(rows.select(*keys, n).distinct(), keys, n, 2).withColumn("__size", F.count(F.lit(1)).over(Window.partitionBy(*keys, "island")))
    isl = isl.withColumn("__total", F.count(F.lit(1)).over(all_)).withColumn("__most", F.max("__size").over(all_))
    return isl.where((F.col("__total") <= 3) | (F.col("__size") >= 2) | (F.col("__most") == 1)).select(*keys, n)


def zones(rows: DataFrame, keys: list[str], pos: str, reach: int = 100, gap: int = 800) -> DataFrame:
    """(start, end) of runs of positions; a run ends where the next position is more than `gap` after its last."""
    isl = island_ids(rows.select(*keys, pos), keys, pos, gap)
    return isl.groupBy(*keys, "island").agg(F.min(pos).alias("start"), (F.max(pos) + reach).alias("end")).drop("island")


def running_gaps(rows: DataFrame, keys: list[str], start: str, end: str, least: float) -> DataFrame:
    """Gaps of at least `least` between a row's start and the greatest end before it: (gap_start, gap_end)."""
    before = Window.partitionBy(*keys).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumn("gap_start", F.max(end).over(before)).withColumn("gap_end", F.col(start))
    return out.where(F.col("gap_end") - F.col("gap_start") >= least).select(*keys, "gap_start", "gap_end")


def next_within(rows: DataFrame, keys: list[str], number: str, pos: str, reach: int, into: str) -> DataFrame:
    """rows with the place of the least of the next `reach` numbers that stands behind the row's own place, or null: where a numbered
    block ends if the numbers right after it are lost."""
    w = Window.partitionBy(*keys).orderBy(number).rangeBetween(1, reach)
    ahead = F.sort_array(F.collect_list(F.struct(F.col(number).alias("n"), F.col(pos).alias("p"))).over(w))  # `reach` numbers, by contract one place each
    return rows.withColumn(into, F.get(F.filter(ahead, lambda x: x["p"] > F.col(pos)), 0)["p"])


def slices(anchors: DataFrame, keys: list[str], pos: str, text: str) -> DataFrame:
    """The text from each anchor (a 0-based position) to the next one, or to the end; ordered by position, not by number."""
    end = F.lead(pos).over(Window.partitionBy(*keys).orderBy(pos))
    size = F.coalesce(end, F.length(text)) - F.col(pos)
    return anchors.withColumn("slice", F.substring(F.col(text), F.col(pos) + 1, size))


def line_slices(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, pos, slice: slices() with the line breaks of each text as anchors. Lines are dealt out instead of a copy of the
    text with each anchor, which grows with the square of a long text. Rows of one key are one document."""
    w = Window.partitionBy(key).orderBy("__k")
    lines = docs.select(key, F.posexplode(F.split(text, "\n")).alias("__k", "__line"))
    pos = F.sum(F.length("__line") + 1).over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1
    cut = lines.select(key, pos.alias("pos"), F.concat(F.lit("\n"), F.lead("__line").over(w)).alias("slice"))
    return cut.where(F.col("slice").isNotNull())


def runs(rows: DataFrame, keys: list[str], order: str, flag: str) -> DataFrame:
    """Rows with `run`, the number of the run of equal flags that they are in."""
    w = Window.partitionBy(*keys).orderBy(order)
    change = F.coalesce((~F.col(flag).eqNullSafe(F.lag(flag).over(w))).cast("int"), F.lit(1))
    return rows.withColumn("__c", change).withColumn("run", F.sum("__c").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__c")


def longest(rows: DataFrame, keys: list[str], size: Column, order: str, n: int = 12) -> DataFrame:
    """The n longest rows of each key, renumbered by length; ties go to the earlier."""
    w = Window.partitionBy(*keys).orderBy(size.desc(), order)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def next_matching(rows: DataFrame, keys: list[str], order: str, value: str, wanted: Column, out: str) -> DataFrame:
    """Rows with the value of the next row that is wanted."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(1, Window.unboundedFollowing)
    return rows.withColumn(out, F.first(F.when(wanted, F.col(value)), ignorenulls=True).over(w))


def label_marks(rows: DataFrame, keys: list[str], order: str, label: str, text: str) -> DataFrame:
    """One text per key in which stretches of an equal label are set between [label:START] and [label:END]."""
    w = Window.partitionBy(*keys).orderBy(order)
    first = F.col(label).isNotNull() & ~F.col(label).eqNullSafe(F.lag(label).over(w))
    last = F.col(label).isNotNull() & ~F.col(label).eqNullSafe(F.lead(label).over(w))
    open_ = F.when(first, F.concat(F.lit("["), label, F.lit(":START]"))).otherwise("")
    close = F.when(last, F.concat(F.lit("["), label, F.lit(":END]"))).otherwise("")
    marked = rows.withColumn("__t", F.concat(open_, F.coalesce(text, F.lit("")), close))
    return marked.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "__t"))), lambda x: x["__t"]), "\n").alias("text"))


def numbered(rows: DataFrame, keys: list[str], order: str, into: str, width: int = 10_000) -> DataFrame:
    """rows with their number, from 1, in the order of a numeric column within each key. A hot key is numbered in ranges of
    `width` of that column: within each, and behind the rows of the ranges before it."""
    part = F.floor(F.col(order) / width)
    r = rows.withColumn("__part", part)
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = r.groupBy(*keys, "__part").agg(F.count(F.lit(1)).alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    on = [r[k].eqNullSafe(sizes[k]) for k in (*keys, "__part")]
    own = F.row_number().over(Window.partitionBy(*(r[k] for k in (*keys, "__part"))).orderBy(r[order]))
    return r.join(sizes, on).select(*(r[c] for c in rows.columns), (own + F.col("__before")).alias(into))
