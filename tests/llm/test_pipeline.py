import corpus_pipeline
from folioforge.llm import decontaminate as dc
from folioforge.llm import linedup as ld
from folioforge.llm import sentencepiece_wfst as wf
from folioforge.llm import toxicity as tx
from folioforge.session import load

from . import brute
from .test_decontaminate import brute_force as windows_hit
from .test_linedup import distance
from .test_neardup import brute_components


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_stages_against_brute_force(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    names = docs.columns
    toxic, lines, near, bench, encode = (f for _, f in corpus_pipeline.STAGES)

    kept = toxic(spark, docs, sf_dir).cache()
    w = tx.train(docs, load(spark, sf_dir, "labels"))
    bad = {r["doc_id"] for r in tx.score(docs, w).where("predicted = 1").collect()}
    assert kept.columns == names and {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in docs.collect()} - bad

    out = lines(spark, kept, sf_dir).cache()
    seen, want = [], {}
    for r in sorted(kept.collect(), key=lambda r: r["doc_id"]):
        left, some = [], False
        for x in (r["text"] or "").split("\n"):
            v = tuple(brute.words(x))
            hit = v and any(v == u or (min(len(u), len(v)) >= 8 and abs(len(u) - len(v)) < 2 and len(set(u) ^ set(v)) <= 2 and distance(u, v) <= 1) for u in seen)
            if v:
                seen.append(v)
            left += [] if hit else [x]
            some |= bool(hit)
        if not some or brute.words("\n".join(left)):
            want[r["doc_id"]] = "\n".join(left)
    assert {r["doc_id"]: r["text"] or "" for r in out.collect()} == want and out.columns == names

    one = near(spark, out, sf_dir).cache()
    comp = brute_components([(r["doc_id"], r["text"]) for r in out.collect()])
    assert {r["doc_id"] for r in one.collect()} == {i for i, c in comp.items() if i == c}
    assert one.columns == names

    clean = bench(spark, one, sf_dir).cache()
    items = [(r["item_id"], r["text"]) for r in load(spark, sf_dir, "benchmark").collect()]
    hit = {r[0] for r in windows_hit([(r["doc_id"], r["text"]) for r in one.collect()], items) if r[5]}
    assert {r["doc_id"] for r in clean.collect()} == {r["doc_id"] for r in one.collect()} - hit and clean.columns == names

    t = wf.Transducer(open(wf.MODEL, "rb").read())
    last = encode(spark, clean, sf_dir).collect()
    assert len(last) == clean.count() and all(t.encode(r["text"] or "").tolist() == r["ids"] for r in last)
    assert dc.WINDOW == 10 and ld.NEAR_WORDS == 8


def test_run_equals_its_stages_and_takes_odd_rows(spark, sf_dir, tmp_path):
    schema = load(spark, sf_dir, "documents").schema
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(brute.ODD_TEXTS)] + [(None, "an id is missing here", None, None, None)]
    for name in ("benchmark", "labels"):
        load(spark, sf_dir, name).write.parquet(f"{tmp_path}/{name}.parquet")
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {"doc_id", "text", "ids"} <= set(out.columns) and out.where("doc_id is null").count() == 1
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
