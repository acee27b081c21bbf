"""Job state, debounce and lateness as a stream against the batch rule and a replay."""

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from rasterloom.operators import jobs
from rasterloom.streaming import jobs as stream

SCHEMA = "session string, job_id long, ts timestamp, image_fp string, black_point long, color_count long, despeckle_size long"
START = dt.datetime(2024, 5, 1, 12)


def change(session, job, ms, fp="a", black=0, colors=4, speck=8):
    return {"session": session, "job_id": job, "ts": START + dt.timedelta(milliseconds=ms), "image_fp": fp, "black_point": black, "color_count": colors, "despeckle_size": speck}


def replay(rows, wait=150):
    """Timers in plain Python: each change cancels the one that waits."""
    out = []
    for session in sorted({r["session"] for r in rows}):
        mine, last = sorted((r for r in rows if r["session"] == session), key=lambda r: (r["ts"], r["job_id"])), None
        for i, r in enumerate(mine):
            ran = i + 1 == len(mine) or mine[i + 1]["ts"] - r["ts"] >= dt.timedelta(milliseconds=wait)
            stage = None
            if ran:
                if last is None or last["image_fp"] != r["image_fp"] or last["black_point"] != r["black_point"]:
                    stage = "pre"
                else:
                    stage = "palette" if last["color_count"] != r["color_count"] else "segment" if last["despeckle_size"] != r["despeckle_size"] else "fit"
                last = r
            out.append((session, r["job_id"], ran, stage))
    return sorted(out)


def drag():
    """Two sessions whose sliders are dragged, with changes of each kind."""
    rows = [change("s", 1, 0), change("s", 2, 100, black=9), change("s", 3, 200, black=5), change("s", 4, 350, black=5, colors=6), change("s", 5, 499, black=5, colors=6, speck=2),
            change("s", 6, 649, black=5, colors=6, speck=3), change("s", 7, 2000, black=5, colors=6, speck=3), change("s", 8, 2000, "b"), change("s", 9, 4000, "b")]
    return rows + [change("t", k, 137 * k, black=k % 3, colors=2 + k % 2) for k in range(1, 20)]


def run(spark, folder, files, **kw):
    """Each list of rows is a file, and each file a micro-batch."""
    (folder / "in").mkdir()
    for k, rows in enumerate(files):
        file = folder / "in" / f"{k:03}.json"
        file.write_text("\n".join(json.dumps({**r, "ts": r["ts"].isoformat()}) for r in rows))
        os.utime(file, (1_700_000_000 + k, 1_700_000_000 + k))  # files come in the order of their times
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(folder / "in"))
    with stream.state_store(spark):
        query = stream.job_stream(source, **kw).writeStream.format("parquet").option("path", str(folder / "out")).option("checkpointLocation", str(folder / "log")).trigger(availableNow=True).start()
        assert query.awaitTermination(240)
    rows = spark.read.schema("session string, job_id long, run_ms long, ran boolean, stage string").parquet(str(folder / "out"))
    return sorted((r.session, r.job_id, r.ran, r.stage) for r in rows.collect())


def test_batch_equals_replay(spark):
    rows = drag()
    found = jobs.debounced(spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA), 150).collect()
    assert sorted((r.session, r.job_id, r.ran, r.stage) for r in found) == replay(rows)
    ms = {(r.session, r.job_id): r.run_ms for r in found}
    assert ms["s", 4] - ms["s", 1] == 350


@pytest.mark.parametrize("step", [4, 100])
def test_stream_equals_replay(spark, tmp_path, step):
    rows = sorted(drag(), key=lambda r: (r["ts"], r["job_id"]))
    end = change("z", 99, 60_000)  # time goes on, so all others are decided
    files = [rows[i : i + step] for i in range(0, len(rows), step)] + [[end], [change("z", 100, 120_000)]]
    got = run(spark, tmp_path, files)
    assert [g for g in got if g[0] != "z"] == replay(rows)


def test_late_changes_are_dropped_within_the_delay_they_count(spark, tmp_path):
    early, late = [change("s", 1, 0), change("u", 50, 5000)], [change("s", 2, 100, black=7)]
    end = [[change("z", 98, 90_000)], [change("z", 99, 180_000)]]
    for name, delay, want in (("strict", "0 seconds", [("s", 1, True, "pre")]), ("lenient", "30 seconds", [("s", 1, False, None), ("s", 2, True, "pre")])):
        (tmp_path / name).mkdir()
        got = run(spark, tmp_path / name, [early, [change("u", 51, 6000)], late, *end], delay=delay)
        assert [g for g in got if g[0] == "s"] == want


def test_dirty_stages():
    base = {"image_fp": "x", "black_point": 0, "color_count": 4, "despeckle_size": 8}
    assert stream.dirty_stage(None, base) == "pre"
    for change_, stage in (({"image_fp": "y"}, "pre"), ({"black_point": 1}, "pre"), ({"color_count": 5}, "palette"), ({"despeckle_size": 9}, "segment"), ({"gap_closing": 2}, "segment"), ({}, "fit")):
        assert stream.dirty_stage(base, base | change_) == stage


def test_batch_ignores_nothing_of_an_empty_table(spark):
    assert jobs.debounced(spark.createDataFrame([], SCHEMA), 150).where(F.col("ran")).count() == 0
