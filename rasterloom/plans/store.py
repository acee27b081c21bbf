"""Results of stages by content: what an image's pixels and a stage's options gave once is not computed again."""

from __future__ import annotations

import uuid

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from rasterloom.operators.graph import cut, shared_folder


class StageStore:
    """Tables of each stage in a shared folder, and an index of the units they hold.

    A unit is an image's content under the options that the stage and those before it look at; its
    key is a hash of both. Rows of a run count only if the run is in the index, which is written
    last, so a run that fails leaves nothing behind that is read. Each run has folders of its own, so
    any session may use the store, and several at once.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, progress: Callable[[str, dict], None] | None = None):
        """``progress`` gets a stage's name and nothing when it begins, and the rows of its tables, counted as they are written, when it ends."""
        self.spark, self.folder = spark, folder or f"{shared_folder(spark)}/stages-{uuid.uuid4().hex}"
        self.progress = progress or (lambda stage, rows: None)

    def _exists(self, path: str) -> bool:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)

    def index(self, stage: str) -> DataFrame:
        """(image_id, run) of the units that the stage has results of; a unit that two runs made has one row."""
        path = f"{self.folder}/{stage}/index"
        if not self._exists(path):
            return self.spark.createDataFrame([], "image_id long, run string")
        return self.spark.read.schema("image_id long, run string").parquet(path).groupBy("image_id").agg(F.min("run").alias("run"))

    def results(self, stage: str, units: DataFrame, make) -> dict[str, DataFrame]:
        """The stage's tables for ``units`` (image_id and what ``make`` needs); ``make`` gets only those without results.

        ``make`` returns tables by name, each with an image_id.
        """
        index = self.index(stage)
        missing = cut(units.join(index, "image_id", "left_anti"))
        if missing.limit(1).count():
            run, rows = uuid.uuid4().hex, {}
            self.progress(stage, {})
            for name, df in make(missing).items():
                seen = Observation()
                df.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(f"{self.folder}/{stage}/{name}/run={run}")
                rows[name] = seen.get["rows"]
            missing.select("image_id").write.parquet(f"{self.folder}/{stage}/index/run={run}")
            self.progress(stage, rows)
            index = self.index(stage)
        wanted = index.join(units.select("image_id"), "image_id", "left_semi")
        return _Tables(self, stage, wanted)


class _Tables(dict):
    """Tables that are read when asked for."""

    def __init__(self, store: StageStore, stage: str, wanted: DataFrame):
        super().__init__()
        self.store, self.stage, self.wanted = store, stage, wanted

    def __missing__(self, name: str) -> DataFrame:
        rows = self.store.spark.read.parquet(f"{self.store.folder}/{self.stage}/{name}")
        self[name] = rows.withColumn("run", F.col("run").cast("string")).join(self.wanted, ["image_id", "run"]).drop("run")
        return self[name]
