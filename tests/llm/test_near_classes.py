"""Classes of near duplicates stay apart where they share a doc_id or have none."""

from pyspark.sql import functions as F

from rasterloom.llm import common, nearjoin


def test_keep_one_of_each_class_when_ids_repeat(spark):
    def text(name, edit=None):
        return " ".join(f"{name}{k}" if k != edit else "edited" for k in range(60))

    rows = [(7, text("a")), (7, text("b")), (8, text("b", 3)), (7, ""), (7, "..."), (7, None), (7, None), (9, text("c")), (9, text("c"))]
    rows += [(None, text("d")), (None, text("d", 5)), (None, text("e")), (None, "?"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [(r.doc_id, r.text) for r in nearjoin.keep_one(df).collect()]
    assert len(kept) == len(set(kept))
    nulls = {t for i, t in kept if i is None}
    assert len(nulls & {text("d"), text("d", 5)}) == 1 and nulls - {text("d"), text("d", 5)} == {text("e"), "?", None}
    assert {(i, t) for i, t in kept if i is not None} == {(7, text("a")), (7, text("b")), (7, ""), (7, "..."), (7, None), (9, text("c"))}


def test_search_depth_follows_the_links(spark):
    """Whole labels find near-equal texts; links at the threshold itself take shorter prefixes."""

    def depth_of(tail):
        rows = []
        for k in range(40):
            head = [f"p{k}x{j}" for j in range(104 - tail)]
            rows += [(2 * k + side, " ".join(head + [f"t{k}y{side}z{j}" for j in range(tail)])) for side in (0, 1)]
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        marked = nearjoin.signatures(docs, "doc_id", "text").withColumn("row", F.monotonically_increasing_id())
        nodes = common.cut(marked.groupBy("h1", "h2", "n").agg(F.min("row").alias("node"), F.count("*").alias("copies"), F.min(F.struct("doc_id", "k1", "k2")).alias("rep"), F.min("labels").alias("labels")))
        solved, depth = nearjoin.verified_links(nodes, docs, 0.8, 0.9995, "doc_id", "text")
        return depth, solved.where("kind = 'node' AND links = 1").count()

    assert depth_of(1) == (8, 80)
    shorter, linked = depth_of(11)
    assert shorter < 8 and linked == 80


def test_estimated_recall():
    assert nearjoin.estimated_recall({}, 8) == 1.0
    assert nearjoin.estimated_recall({95: 100}, 8) > 0.9999 > nearjoin.estimated_recall({80: 100}, 8) > 0.99
    assert nearjoin.estimated_recall({80: 100}, 6) > 0.9999
    assert nearjoin.first_depth({99: 100}, 0.9995) == nearjoin.first_depth({}, 0.9995) == 8 > nearjoin.first_depth({81: 100}, 0.9995)
