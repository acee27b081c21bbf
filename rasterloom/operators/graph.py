"""Connected components of keyed graphs, and cutting a plan's lineage."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, or, on a local master, one of the session's own."""
    sc = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not shared and sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(f"/tmp/rasterloom-checkpoints/{uuid.uuid4().hex}")
    return shared or sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The rows of ``df`` as a table in the shared folder, written and read again.

    What follows depends neither on the executors that made the rows nor on the plan's guess of
    their size: a table has its true size, so a small one can be broadcast. A checkpoint would
    hand the guess on, and joins multiply guesses round by round.
    """
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_counting(df: DataFrame, condition: Column | str) -> tuple[DataFrame, int]:
    """``cut``, and the number of rows that meet the condition, counted while they are written."""
    seen = Observation()
    test = F.expr(condition) if isinstance(condition, str) else condition
    table = cut(df.observe(seen, F.count_if(test).alias("n")))
    return table, seen.get["n"]


def size_estimate(df: DataFrame) -> int:
    """Bytes that the optimizer expects of ``df``."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def components(edges: DataFrame, nodes: DataFrame, key: str = "image_id") -> DataFrame:
    """(key, node, comp): comp is the smallest node that ``node`` is connected to inside its key.

    Labels fall to the least label of a node's neighbours, then jump to their own label's label,
    until nothing changes; jumping makes the number of rounds logarithmic in path length. Nodes
    without edges take no part in the rounds.
    """
    both, n = cut_counting(edges.select(key, "a", "b").union(edges.select(key, F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), F.lit(True))
    if n == 0:
        return nodes.select(key, "node", F.col("node").alias("comp"))
    labels = both.groupBy(key, F.col("a").alias("node")).agg(F.min("b").alias("low")).select(key, "node", F.least("node", "low").alias("comp"))
    labels = cut(labels)
    while True:
        near = both.join(labels.select(key, F.col("node").alias("b"), "comp"), [key, "b"]).groupBy(key, F.col("a").alias("node")).agg(F.min("comp").alias("low"))
        hooked = labels.join(near, [key, "node"]).select(key, "node", "comp", F.least("comp", "low").alias("low"))
        # A label that some member lowered is lowered for all of them.
        roots = hooked.groupBy(key, "comp").agg(F.min("low").alias("root"))
        moved = hooked.join(roots, [key, "comp"]).select(key, "node", "comp", "root")
        jump = labels.select(key, F.col("node").alias("root"), F.col("comp").alias("far"))
        new, changed = cut_counting(moved.join(jump, [key, "root"]).select(key, "node", F.col("comp").alias("was"), F.least("root", "far").alias("comp")), "was <> comp")
        labels = new.select(key, "node", "comp")
        if changed == 0:
            break
    return nodes.select(key, "node").join(labels, [key, "node"], "left").select(key, "node", F.coalesce("comp", "node").alias("comp"))
