import math

import pytest
from pyspark.sql import functions as F

from phonolith.operators import catalog, jobs, separate, signal
from phonolith.errors import SeparationError


def test_last_entry_counts_and_empty_values_fall_through(spark):
    entries = spark.createDataFrame(
        [(0, "/m/é.wav", "First", "A", "id1", 1), (1, "/m/é.wav", "", None, "id2", 2), (2, "/m/x.wav", "X", "B", None, None)],
        "pos long, path string, title string, artist string, audio_id string, flags int",
    )
    index = catalog.collection_index(entries)
    files = spark.createDataFrame([("/m/é.wav",), ("/m/x.wav",), ("/m/none.wav",), ("/m/skip.txt",)], "path string")
    got = {r["path"]: (r["title"], r["artist"], r["audio_id"]) for r in catalog.enrich(catalog.tracks(files), index).collect()}
    assert got == {"/m/é.wav": ("é", None, "id2"), "/m/x.wav": ("X", "B", None), "/m/none.wav": ("none", None, None)}
    single = catalog.single_track("/m/é.wav", index).first()
    assert tuple(single)[:3] == ("/m/é.wav", "é", None)
    assert tuple(catalog.single_track("/m/1 - a - b.wav", index).first()) == ("/m/1 - a - b.wav", "b", "a", None)


def test_flags(spark):
    entries = spark.createDataFrame([(0, "/a", 12), (1, "/b", None), (2, "/c", 64), (3, "/a", 12)], "pos long, path string, flags int")
    done = spark.createDataFrame([("/a",), ("/c",), ("/zz",)], "path string")
    got = {r["pos"]: (r["flags"], r["found"], r["changed"]) for r in catalog.mark_generated(entries, done).collect()}
    assert got == {0: (12, False, False), 1: (None, False, False), 2: (64, True, False), 3: (76, True, True)}


def test_logged_path_root_before_last(spark):
    log = spark.createDataFrame([(1, "T", "/S/1"), (2, "T", "/S/2"), (3, "T", "/Other/3"), (4, "T", "/Outputs/4")], "line_no long, title string, path string")
    assert catalog.latest_logged(log, "/S/").first()[1] == "/S/2"


def test_output_errors(spark):
    t = spark.createDataFrame([("/a", "A", None), ("/b", "B", "AAAA"), ("/c", "C", "")], "path string, title string, audio_id string")
    logged = spark.createDataFrame([("C", "/S/c.stem.mp4")], "title string, logged_path string")
    got = {r["path"]: (r["output"], r["error"]) for r in catalog.output_paths(t, logged, "/S").collect()}
    assert got["/a"][1].startswith("missing audio id") and got["/b"][1].startswith("audio id is not 256") and got["/c"] == ("/S/c.stem.mp4", None)


def test_job_log(spark, tmp_path):
    log = jobs.JobLog(spark, str(tmp_path / "jobs"))
    assert log.get("/a") is None
    row = lambda status, error=None: spark.createDataFrame([("/a", 1, 2, status, error)], "path string, size long, mtime_ns long, status string, error string")
    log.append(row("running", "x"))
    log.append(row("done"))
    got = log.get("/a")
    assert got["status"] == "done" and got["error"] is None and log.latest().count() == 1 and log.rows().count() == 2
    files = spark.createDataFrame([("/a", 1, 2), ("/a2", 1, 2)], "path string, size long, mtime_ns long")
    assert {r["path"]: r["done"] for r in jobs.done_current(files, log.latest()).collect()} == {"/a": True, "/a2": False}
    changed = files.withColumn("size", F.lit(9))
    assert not any(r["done"] for r in jobs.done_current(changed, log.latest()).collect())


@pytest.mark.parametrize("length,overlap", [(8, 0.25), (7, 0.5), (5, 0.0), (9, 0.8)])
def test_chunks_cover_like_brute_force(spark, length, overlap):
    stride = signal.stride_of(length, overlap)
    s = spark.range(50).select(F.col("id").alias("t"), F.lit(1.0).alias("x"))
    got = {(r["t"], r["chunk"], r["i"]) for r in signal.chunks(s, length, stride).collect()}
    assert got == {(t, o // stride, t - o) for o in range(0, 50, stride) for t in range(o, min(50, o + length))}


def test_identity_overlap_add_restores(spark):
    s = spark.range(100).select(F.lit(0).alias("ch"), F.col("id").alias("t"), F.sin("id").alias("x"))
    pieces = signal.chunks(s, 16, 12)
    out = signal.overlap_add(pieces, ["ch"], F.col("x"), signal.weight(F.col("i"), 16))
    assert all(math.isclose(r["num"] / r["den"], math.sin(r["t"]), abs_tol=1e-9) for r in out.collect())
    with pytest.raises(ValueError):
        signal.stride_of(10, 1.0)


def test_gate_verdicts(spark):
    rows = [(k, t, math.sin(t) if k != "silent" else 0.0) for k in ("good", "half", "loud", "silent") for t in range(400)]
    master = spark.createDataFrame(rows, "k string, t long, x double")
    scale = {"good": 1.0, "half": 0.5, "loud": -1.0, "silent": 1.0}
    parts = spark.createDataFrame([(k, t, x * scale[k] / 2) for k, t, x in rows for _ in (0, 1)], "k string, t long, x double")
    got = {r["k"]: r["verdict"] for r in signal.gate(master, parts, ["k"], F.col("t")).collect()}
    assert got == {"good": "passed", "half": "failed", "loud": "failed", "silent": "silent"}


def test_interleave_pads_and_clips(spark):
    rows = [(0, 0, 2.0), (0, 1, float("nan")), (1, 0, -3.0)]
    got = signal.interleave(spark.createDataFrame([("g", *r) for r in rows], "g string, slot int, t long, x double"), ["g"], 2).orderBy("t").collect()
    assert [tuple(r)[2:] for r in got] == [(0.99, -0.99), (0.0, 0.0)]


def test_separator_plug_in(spark):
    chunks = spark.createDataFrame([("p", 0, [1.0, 2.0]), ("p", 1, [4.0])], "path string, chunk long, samples array<double>")
    out = separate.separate(chunks, "linear-stand-in", 2, batch=4).groupBy("chunk").agg(F.collect_list("samples").alias("s")).collect()
    sums = {r["chunk"]: [sum(v) for v in zip(*r["s"])] for r in out}
    assert sums[0] == pytest.approx([1.0, 2.0]) and sums[1] == pytest.approx([4.0])
    with pytest.raises(SeparationError):
        separate.separate(chunks, "none", 2)
