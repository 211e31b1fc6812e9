"""Benchmark decontamination by winnowing, with DataFrame functions only.

Of every six consecutive 5-word hashes of a text the least is a fingerprint, so any ten shared words share one.
Documents that share a fingerprint with a benchmark item are candidates; in these, every window is compared
with the items' windows as text, which extends the hit to all words that a window covers. The contract of a
window: ten consecutive item words, or the whole of an item of fewer words but not none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import load
from .scratch import Scratch, free, small

WINDOW = 10
GRAM = 5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: All ASCII characters that part words once A-Z are in lower case, and the same before.
_PARTS = "".join(chr(c) for c in range(128) if not chr(c).isalnum())
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_GAP_ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of the text with A-Z in lower case; null if there are none. Trimming first leaves no empty words to take out."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    low = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.split(F.nullif(F.btrim(low, F.lit(_PARTS)), F.lit("")), _GAP)


def n_words(text: Column) -> Column:
    some = F.nullif(F.btrim(text, F.lit(_PARTS)), F.lit(""))
    return F.coalesce(F.when(some.isNotNull(), F.size(F.split(some, _GAP_ANY_CASE))), F.lit(0)).cast("long")


def _grams(h: str, k: int) -> str:
    """SQL for the k-gram hashes of the array column h of word hashes."""
    rest = "".join(f", get({h}, i + {j})" for j in range(1, k))
    return f"slice(transform({h}, (x, i) -> xxhash64(x{rest})), 1, greatest(size({h}) - {k - 1}, 0))"


def _least(g: str, w: int) -> str:
    """SQL for the least of every w consecutive values of the array column g, or of all if there are fewer."""
    rest = "".join(f", get({g}, i + {j})" for j in range(1, w))
    return f"array_distinct(slice(transform({g}, (x, i) -> least(x{rest})), 1, greatest(size({g}) - {w - 1}, 1)))"


def fingerprints(rows: DataFrame, *keys: str, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """keys and one row per distinct winnowed fingerprint `fp` of column text. Spans of `window` words share one."""
    h = rows.select(*keys, words(F.col("text")).alias("w")).select(*keys, F.expr("transform(w, x -> xxhash64(x))").alias("h"))
    g = h.where(F.size("h") >= gram).select(*keys, F.expr(_grams("h", gram)).alias("g"))
    return g.select(*keys, F.expr(f"explode({_least('g', window - gram + 1)})").alias("fp"))


def whole_grams(rows: DataFrame, lengths: list[int], *keys: str) -> DataFrame:
    """keys and the distinct hashes of all spans of these numbers of words: for items too short to winnow. One pass for all."""
    h = rows.select(*keys, words(F.col("text")).alias("w")).select(*keys, F.expr("transform(w, x -> xxhash64(x))").alias("h"))
    grams = ", ".join(f"transform({_grams('h', m)}, x -> xxhash64(x, {m}))" for m in lengths)
    return h.where(F.size("h") >= min(lengths)).select(*keys, F.expr(f"explode(array_distinct(concat({grams})))").alias("fp"))


def windows(rows: DataFrame, lengths: list[int], *keys: str) -> DataFrame:
    """keys, position, text and length of every span of these numbers of words."""
    w = rows.select(*keys, words(F.col("text")).alias("w")).where(F.size("w") >= min(lengths))
    of = "transform(slice(w, 1, greatest(size(w) - {0} + 1, 0)), (x, i) -> named_struct('pos', i, 'len', {0}, 'span', array_join(slice(w, i + 1, {0}), ' ')))"
    spans = F.expr(f"concat({', '.join(of.format(m) for m in lengths)})")
    return w.select(*keys, F.explode(spans).alias("s")).select(*keys, "s.pos", "s.len", "s.span")


def _hits(docs: DataFrame, items: DataFrame, scratch: Scratch, window: int) -> DataFrame:
    """(i, k, n_hit, n_items, items_sha256) of the documents (i, k, text) with a window, a written table."""
    key = ["i", "k"]
    items = scratch.put(items.select("item_id", "text").withColumn("n", n_words(F.col("text"))).where("n > 0").distinct(), "items")
    short = sorted(r["n"] for r in items.where(F.col("n") < window).select("n").distinct().collect())  # at most window - 1 numbers

    full = items.where(F.col("n") >= window)
    kinds = [([window], full, fingerprints(full, window=window), fingerprints(docs, *key, window=window))]
    if short:
        rest = items.where(F.col("n") < window)
        kinds.append((short, rest, whole_grams(rest, short), whole_grams(docs, short, *key)))
    hits = None
    for m, these, item_fp, doc_fp in kinds:
        name = "-".join(map(str, m))
        item_fp = scratch.put(item_fp.distinct(), f"fp-{name}")
        candidate = scratch.put(doc_fp.join(small(item_fp), "fp").select(*key).distinct(), f"candidates-{name}")
        # a short item is one window, its whole; an item of length m isn't a window of another short length
        whole = windows(these, m, "item_id", "n").where(F.col("len") == F.least("n", F.lit(window)))
        spans = scratch.put(whole.select("span", "item_id").distinct(), f"spans-{name}")
        found = windows(docs.join(small(candidate), key, "left_semi"), m, *key).join(small(spans.select("span").distinct()), "span")
        found = scratch.put(found.select(*key, "pos", "len", "span"), f"found-{name}")
        of = found.select(*key, "span").distinct().join(small(spans), "span").select(*key, "item_id")
        one = found.select(*key, "pos", "len", F.lit(None).cast(items.schema["item_id"].dataType).alias("item_id")).unionByName(of.select(*key, F.lit(None).cast("int").alias("pos"), F.lit(None).cast("int").alias("len"), "item_id"))
        hits = one if hits is None else hits.unionByName(one)

    span = F.collect_set(F.when(F.col("pos").isNotNull(), F.struct("pos", "len"))).alias("at")
    hits = hits.distinct().groupBy(*key).agg(span, F.collect_set(F.col("item_id").cast("string")).alias("ids"))
    covered = F.expr(
        "aggregate(array_sort(at), named_struct('n', 0L, 'end', 0), "
        "(a, x) -> named_struct('n', a.n + greatest(0, x.pos + x.len - greatest(a.end, x.pos)), 'end', greatest(a.end, x.pos + x.len)), a -> a.n)"
    )
    hits = hits.select(*key, covered.alias("n_hit"), F.size("ids").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("ids"), ","), 256).alias("items_sha256"))
    return scratch.put(hits, "hits")


def _keys() -> list[Column]:
    """What tells documents apart: the id, and a hash of the text, since rows of one id may have different texts."""
    return [F.coalesce("doc_id", F.lit(-(2**63))), F.xxhash64("text")]


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every document.

    A null text has no words; items without words have no window. Rows of one id with different texts are judged
    each by its text, a null id is kept as null, repeated items count once. Other columns are ignored. An empty
    benchmark hits nothing. The documents' text is not shuffled unless the candidates are too many to broadcast.
    """
    key = ["i", "k"]
    i, k = _keys()
    docs = docs.select("doc_id", i.alias("i"), k.alias("k"), "text")
    hits = _hits(docs.select(*key, "text"), items, Scratch(docs.sparkSession, "decontaminate"), window)
    out = docs.select("doc_id", *key, n_words(F.col("text")).alias("n_words")).join(small(hits), key, "left")
    return out.select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def stage_decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window, with all their columns. Rows are judged each by its text, so of two of one id only
    the one with a window goes. Null and empty texts have none and stay, null ids too; an empty table stays empty."""
    i, k = free("i_", docs), free("k_", docs)
    own, text = _keys()
    keyed = docs.withColumn(i, own).withColumn(k, text)
    hits = _hits(keyed.select(F.col(i).alias("i"), F.col(k).alias("k"), "text"), load(spark, sf_dir, "benchmark"), Scratch(spark, "decontaminate"), WINDOW)
    bad = hits.where("n_hit > 0").select(F.col("i").alias(i), F.col("k").alias(k))
    return keyed.join(small(bad), [i, k], "left_anti").select(*docs.columns)


#: The same rows in DuckDB: every window of every item and document, compared as text.
ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS m, array_to_string(w[s + 1 : s + least(len(w), 10)], ' ') AS span
       FROM (SELECT item_id, w, unnest(range(0, greatest(len(w) - 9, 1))) AS s FROM b WHERE len(w) > 0)),
ms AS (SELECT DISTINCT m FROM bw),
dw AS (SELECT doc_id, s, m, array_to_string(w[s + 1 : s + m], ' ') AS span
       FROM (SELECT doc_id, w, m, unnest(range(0, len(w) - m + 1)) AS s FROM d, ms WHERE len(w) >= m)),
h AS (SELECT DISTINCT dw.doc_id, dw.s, dw.m, bw.item_id FROM dw JOIN bw ON dw.m = bw.m AND dw.span = bw.span),
p AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + m)) AS q FROM h) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(p.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(i.n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(i.ids, '')) AS items_sha256, coalesce(p.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN i USING (doc_id)
"""
