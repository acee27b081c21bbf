"""Each stage against brute force on its own input."""

import importlib

from pyspark.sql import functions as F

from rasterloom.llm import decontam, quality

from .test_operators import DATA, brute_line_dedup, brute_near


def test_stages(spark, tmp_path):
    pipeline = importlib.import_module("corpus_pipeline")
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    names = docs.columns
    kept = {}
    for name, stage in pipeline.STAGES:
        before = docs
        stage(spark, docs, DATA).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = (before, docs)
        if name != pipeline.STAGES[-1][0]:
            assert docs.columns == names
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    before, after = kept["quality_classifier"]
    rejected = {r.doc_id for r in quality.quality_scores(before, spark.read.parquet(f"{DATA}/labels.parquet")).where("predicted = 0").collect()}
    assert ids(after) == ids(before) - rejected and rejected
    before, after = kept["line_dedup"]
    source = {r.doc_id: r.text for r in before.collect()}
    gone = brute_line_dedup(source.items())
    for r in after.collect():
        assert r.text == "\n".join(t for no, t in enumerate(source[r.doc_id].split("\n")) if (r.doc_id, no) not in gone) and r.n_chars == len(r.text)
    before, after = kept["near_duplicates"]
    assert sorted(map(str, ids(after))) == sorted({c for _, c, _ in brute_near([(r.doc_id, r.text) for r in before.collect()])})
    before, after = kept["decontamination"]
    dirty = {r.doc_id for r in decontam.contamination(before, spark.read.parquet(f"{DATA}/benchmark.parquet")).where(F.size("hit") > 0).collect()}
    assert ids(after) == ids(before) - dirty
    before, after = kept["bpe_tokens"]
    assert ids(after) == ids(before) and all(len(r["ids"]) == r.n_tokens for r in after.collect())


AWKWARD = "doc_id long, text string, lang string, source string, n_chars long, n_lines string, n_removed string, hit string, row string"


def test_run_on_awkward_and_empty_tables(spark, tmp_path):
    """Nulls, empty and very long texts, repeated rows, clashing columns; every stage alone sees them too."""
    pipeline = importlib.import_module("corpus_pipeline")
    long = " ".join(f"word{i % 1993}q{i % 37}" for i in range(40_000))
    plain = [r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").orderBy("doc_id").limit(3).collect()]
    texts = [None, None, "", " \n\t\n", long, long, *plain, plain[0]]
    ids = [None, 1, 2, 3, 4, 5, 6, 7, 8, 6]
    rows = [(i, t, None, None, None, "a", "b", "c", "d") for i, t in zip(ids, texts)]
    for name, part in (("odd", rows), ("none", [])):
        folder = str(tmp_path / name)
        docs = spark.createDataFrame(part, AWKWARD)
        docs.write.parquet(f"{folder}/documents.parquet")
        for table in ("labels", "benchmark"):
            source = spark.read.parquet(f"{DATA}/{table}.parquet")
            (source if part else source.limit(0)).write.parquet(f"{folder}/{table}.parquet")
        out = pipeline.run(spark, folder)
        found = out.collect()
        assert out.columns == ["doc_id", "n_tokens", "ids"] and all(len(r["ids"]) == r.n_tokens for r in found)
        assert (len(found) > 0) == bool(part) and len({r.doc_id for r in found}) == len(found)
        for _, stage in pipeline.STAGES[:-1]:
            kept = stage(spark, docs, folder)
            assert kept.columns == docs.columns and kept.count() <= len(part)
