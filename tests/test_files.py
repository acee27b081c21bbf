"""Strips of image files and SVG files, by Spark's reader and writer."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.sources import files


def test_strips_of_files(spark, tmp_path):
    rng = np.random.default_rng(2)
    colour, grey = rng.integers(0, 256, (37, 23, 3), dtype=np.uint8), rng.integers(0, 256, (5, 4), dtype=np.uint8)
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "a.ppm").write_bytes(b"P6\n# made here\n23 37\n255\n" + colour.tobytes())
    (tmp_path / "in" / "deep" / "b.pgm").write_bytes(b"P5 4 5 255\n" + grey.tobytes())
    (tmp_path / "in" / "note.txt").write_text("no image")
    files.register(spark)
    px = spark.read.format("raster").option("stripPixels", 23 * 4).load(str(tmp_path / "in"))
    assert px.rdd.getNumPartitions() == 10 + 1  # 37 rows by 4, and a small file
    for shape, want in (((37, 23), colour), ((5, 4), np.repeat(grey[..., None], 3, axis=2))):
        rows = px.where((F.col("height") == shape[0]) & (F.col("width") == shape[1])).collect()
        got = np.zeros((*shape, 3), dtype=np.uint8)
        for r in rows:
            got[r.y, r.x] = (r.r, r.g, r.b)
        assert len(rows) == shape[0] * shape[1] and (got == want).all()
    (tmp_path / "in" / "short.ppm").write_bytes(b"P6 9 9 255\n123")
    with pytest.raises(Exception, match="ends before its last pixel"):
        spark.read.format("raster").load(str(tmp_path / "in")).count()
    (tmp_path / "none").mkdir()
    assert spark.read.format("raster").load(str(tmp_path / "none")).count() == 0


def test_svg_files_come_whole_or_not_at_all(spark, tmp_path):
    files.register(spark)
    out = tmp_path / "out"
    rows = spark.range(7).select(F.col("id").alias("image_id"), F.concat(F.lit("<svg>é"), F.col("id").cast("string"), F.lit("</svg>")).alias("svg"), F.lit(1).alias("path_count")).repartition(3)
    rows.write.format("svgfile").mode("append").save(str(out))
    assert {f.name: f.read_text() for f in out.iterdir()} == {f"{k}.svg": f"<svg>é{k}</svg>" for k in range(7)}
    bad = rows.withColumn("image_id", F.col("image_id") + 100).withColumn("svg", F.when(F.col("image_id") == 106, F.raise_error(F.lit("boom"))).otherwise(F.col("svg")))
    with pytest.raises(Exception, match="boom"):
        bad.write.format("svgfile").mode("append").save(str(out))
    assert sorted(f.name for f in out.iterdir()) == [f"{k}.svg" for k in range(7)]
    rows.where("image_id = 3").withColumn("svg", F.lit("new")).write.format("svgfile").mode("append").save(str(out))
    assert (out / "3.svg").read_text() == "new" and len(list(out.iterdir())) == 7
    with pytest.raises(Exception, match="image_id and svg"):
        spark.range(2).write.format("svgfile").mode("append").save(str(out))
