"""Jobs with options of their own in one plan against a run for each, and stages that are not computed again."""

import threading
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.operators import palette, segment
from rasterloom.operators.graph import cut
from rasterloom.plans.jobs import job_rows, units, vectorize_jobs
from rasterloom.plans.runner import JobRunner, Superseded
from rasterloom.plans.store import StageStore
from rasterloom.plans.vectorize import Options, Vectorizer
from rasterloom.sources.raster import fingerprint
from tests.test_loops import image


@pytest.fixture(scope="module")
def pictures(spark):
    cells = np.zeros((26, 30), dtype=int)
    cells[4:16, 5:22] = 1
    cells[8:12, 9:14] = 0
    cells[20, 20:22] = 2
    one, _ = image(spark, cells, 3)
    two, _ = image(spark, np.where(cells == 1, 3, cells)[:, ::-1], 4)
    return cut(one.unionByName(two).unionByName(one.withColumn("image_id", F.lit(5).cast("long"))))


SETS = [
    Options(color_count=3, despeckle_size=1, merge_paths=False),
    Options(color_count=3, despeckle_size=4, smoothness=0.9, optimize=False, color_overrides=("#010203",)),
    Options(color_count="auto", despeckle_size=1, stacked_shapes=True, black_point=10, blur_radius=0.6, saturation=0.5),
    Options(color_count=2, despeckle_size=2, gap_closing=1, transparent_bg=True),
]


def test_jobs_in_one_plan_equal_runs_of_their_own(spark, pictures):
    jobs = [(10, 3, SETS[0]), (11, 3, SETS[1]), (12, 4, SETS[2]), (13, 4, SETS[3]), (14, 5, SETS[0])]
    got = {r.job_id: (r.svg, r.path_count, r.point_count) for r in vectorize_jobs(pictures, job_rows(spark, jobs)).collect()}
    for o in SETS:
        mine = {job: im for job, im, x in jobs if x == o}
        px = pictures.where(F.col("image_id").isin(*mine.values()))
        want = {r.image_id: (r.svg, r.path_count, r.point_count) for r in Vectorizer(px).run(o).collect()}
        for job, im in mine.items():
            assert got[job] == want[im]


def test_work_is_shared_by_content_and_common_options(spark, pictures):
    jobs = job_rows(spark, [(1, 3, SETS[0]), (2, 5, SETS[0]), (3, 3, SETS[1]), (4, 4, SETS[0])])
    keyed = units(jobs, fingerprint(pictures))
    n = keyed.select(*[F.count_distinct(f"{s}_unit").alias(s) for s in ("pre", "palette", "segment", "fit")]).first()
    assert (n.pre, n.palette, n.segment, n.fit) == (2, 2, 3, 3)  # images 3 and 5 are equal; job 3 differs from despeckling on


def test_a_second_run_computes_nothing_that_is_stored(spark, pictures, tmp_path, monkeypatch):
    folder = str(tmp_path / "stages")
    jobs = job_rows(spark, [(1, 3, SETS[0])])
    first = vectorize_jobs(pictures, jobs, StageStore(spark, folder)).collect()

    def never(*a, **k):
        raise AssertionError("computed again")

    monkeypatch.setattr(palette, "estimate_palette", never)
    monkeypatch.setattr(segment, "regions", never)
    again = vectorize_jobs(pictures, jobs, StageStore(spark, folder)).collect()  # as another session would
    assert again == first
    other = job_rows(spark, [(2, 5, SETS[0].__class__(**{**SETS[0].__dict__, "smoothness": 0.1}))])
    assert vectorize_jobs(pictures, other, StageStore(spark, folder)).count() == 1  # equal content, later option: from its stage on
    with pytest.raises(AssertionError):
        vectorize_jobs(pictures, job_rows(spark, [(3, 4, SETS[0])]), StageStore(spark, folder))


def test_a_failed_run_leaves_nothing_to_read(spark, tmp_path):
    store = StageStore(spark, str(tmp_path / "s"))
    wanted = spark.createDataFrame([(1,), (2,)], "image_id long")
    boom = F.raise_error(F.lit("boom")).cast("int")

    def bad(missing):
        return {"a": missing.withColumn("v", F.lit(1)), "b": missing.withColumn("v", F.when(F.col("image_id") == 2, boom).otherwise(1))}

    with pytest.raises(Exception, match="boom"):
        store.results("x", wanted, bad)
    made = store.results("x", wanted, lambda m: {"a": m.withColumn("v", F.lit(7)), "b": m.withColumn("v", F.lit(8))})
    assert [r.v for r in made["a"].collect()] == [7, 7] and [r.v for r in made["b"].collect()] == [8, 8]
    more = store.results("x", wanted.union(spark.createDataFrame([(3,)], "image_id long")), lambda m: {"a": m.withColumn("v", F.lit(9)), "b": m.withColumn("v", F.lit(9))})
    assert sorted((r.image_id, r.v) for r in more["a"].collect()) == [(1, 7), (2, 7), (3, 9)]


def test_a_newer_job_stops_an_older_one(spark, pictures, tmp_path):
    told, slow_began = [], threading.Event()

    def progress(session, number, stage, rows):
        told.append((session, number, stage, dict(rows)))
        slow_began.set()

    @F.udf("int")
    def slowly(v):
        time.sleep(0.05)
        return v

    runner = JobRunner(spark, str(tmp_path / "stages"), progress)
    slow = pictures.where("image_id = 3").withColumn("r", slowly("r"))  # over 30 seconds whenever it is read
    old = runner.submit("s", slow, job_rows(spark, [(1, 3, SETS[0])]))
    time.sleep(3)  # it is in its first Spark job
    other = runner.submit("t", pictures, job_rows(spark, [(7, 4, SETS[3])]))
    began = time.time()
    new = runner.submit("s", pictures, job_rows(spark, [(2, 4, SETS[3])]))
    with pytest.raises(Superseded):
        old.result(timeout=25)
    assert time.time() - began < 25
    assert [r.job_id for r in new.result(timeout=240)] == [2] and [r.job_id for r in other.result(timeout=240)] == [7]
    rows = {(n, stage): r for s, n, stage, r in told if s == "s" and r}
    assert {stage for n, stage in rows if n == 2} <= {"pre", "palette", "segment", "fit"} and not any(n == 1 and stage == "fit" for n, stage in rows)
    whole = [r for s, n, stage, r in told if stage == "pre" and r]
    assert whole and all(r == {"pixels": 26 * 30} for r in whole)
    runner.cancel("nobody")
