"""A folder of images as a stream: every new file is vectorized in its micro-batch."""

from __future__ import annotations

from pyspark.sql import SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from rasterloom.plans.vectorize import Options, vectorize
from rasterloom.sources.raster import decode_images, write_svg


def vectorize_stream(spark: SparkSession, folder: str, out: str, checkpoint: str, options: Options = Options()) -> StreamingQuery:
    """Read new files with the file source's own bookkeeping and append one SVG for each."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.png").load(folder).select("path")

    def batch(df, number):
        paths = [r.path for r in df.collect()]  # names of one micro-batch
        if paths:
            results = vectorize(decode_images(spark, paths), options)
            write_svg(results.withColumn("image_id", F.col("image_id").cast("string")), f"{out}/batch={number}")

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
