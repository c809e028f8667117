"""Files on disk, streaming twins and resumable writes."""

import gzip
import json

import numpy as np
from pyspark.sql import functions as F

from heliopath.sources import files, redaction, scene_build
from heliopath.streaming import navigation as nav

SF = "/root/testdata/sf0.001"


def test_elevation_files(spark, tmp_path):
    grid = np.arange(9, dtype=">i2").reshape(3, 3)
    grid[1, 1] = -32768
    (tmp_path / "N42W072.hgt").write_bytes(grid.tobytes())
    (tmp_path / "S01E010.hgt.gz").write_bytes(gzip.compress(grid.tobytes()))
    rows = files.read_elevation_lines(spark, str(tmp_path), side=3).orderBy("north", "row").collect()
    assert [(r["north"], r["west"], r["row"]) for r in rows[:1]] == [(-1, 10, 0)]
    assert rows[4]["north"] == 42 and rows[4]["west"] == -72 and rows[4]["elev"] == [3, None, 5]


def test_asset_checksums(spark, tmp_path):
    import hashlib

    (tmp_path / "a.bin").write_bytes(b"abc")
    r = files.asset_checksums(spark, str(tmp_path)).collect()[0]
    assert (r["file"], r["bytes"], r["sha256"]) == ("a.bin", 3, hashlib.sha256(b"abc").hexdigest())
    record = files.source_record(files.asset_checksums(spark, str(tmp_path)), None, "dem", 2).collect()[0]
    assert record["extract_time"] is None


def test_csv_quotes(spark, tmp_path):
    df = spark.createDataFrame([('say "hi", now', 1)], "t string, n int")
    files.write_csv(df, str(tmp_path / "out"))
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "out")).collect()
    assert back[0]["t"] == 'say "hi", now'


def test_partitioned_tiles_replace_only_their_own(spark, tmp_path):
    path = str(tmp_path / "tiles")
    scene_build.write_tiles(spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "tx int, ty int, id string"), path)
    scene_build.write_tiles(spark.createDataFrame([(2, 1, "c")], "tx int, ty int, id string"), path)
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == ["a", "c"]
    from heliopath.operators.tiles import scan_required

    need = spark.createDataFrame([(2, 1)], "tx int, ty int")
    assert [r["id"] for r in scan_required(spark.read.parquet(path), need).collect()] == ["c"]


def test_redaction(spark):
    text = json.dumps({"apiToken": "x", "position": {"lat": 1.23456, "lng": 2.0}, "note": "n" * 400, "d": {"e": {"f": {"g": 1}}}})
    out = json.loads(spark.createDataFrame([(text,)], "t string").select(redaction.sanitize_json("t")).collect()[0][0])
    assert "apiToken" not in out and out["position"] == {"lat": 1.235, "lng": 2.0} and len(out["note"]) == 301
    assert out["d"]["e"]["f"] == {"g": "[truncated]"} or out["d"]["e"]["f"] == "[truncated]"


def _fixes(spark):
    from heliopath.plans.views import view

    return view(spark, SF, "fx_gps_fixes").select(*nav.FIX)


def _drain(stream, name):
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(150)
    assert q.exception() is None
    return q


def test_stream_equals_batch(spark, tmp_path):
    src = str(tmp_path / "fixes")
    _fixes(spark).coalesce(1).write.json(src)
    stream = nav.clean_fix_stream(files.read_fixes(spark, src))
    _drain(stream, "cleaned")
    got = {(r["fix_id"], r["reason"]) for r in spark.table("cleaned").collect()}
    want = {(r["fix_id"], r["reason"]) for r in nav.clean_fixes(_fixes(spark)).collect()}
    assert got == want and len(want) > 100


def test_late_rows_of_new_sessions_are_left_out(spark, tmp_path):
    """Micro-batches: on time, then a fix an hour behind the watermark and one after thirteen silent hours."""
    one = _fixes(spark).orderBy("fix_ms", "fix_id").first().asDict()
    base = one["fix_ms"]
    make = lambda **c: {**one, **c}
    hour = 3_600_000
    batches = [[make(fix_id=1, session_id=1, fix_ms=base)], [make(fix_id=2, session_id=1, fix_ms=base + 60_000)],
               [make(fix_id=3, session_id=2, fix_ms=base - hour), make(fix_id=4, session_id=1, fix_ms=base + 120_000)],
               [make(fix_id=5, session_id=3, fix_ms=base + 13 * hour)], [make(fix_id=6, session_id=3, fix_ms=base + 13 * hour + 60_000)],
               [make(fix_id=7, session_id=1, fix_ms=base + 13 * hour + 120_000)]]
    src = tmp_path / "fixes"
    src.mkdir()
    stream = nav.clean_fix_stream(spark.readStream.schema(files.GPS_FIX).option("maxFilesPerTrigger", 1).json(str(src)))
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, _fixes(spark).schema).coalesce(1).write.json(str(tmp_path / f"b{n}"))
        import shutil

        part = next((tmp_path / f"b{n}").glob("part-*.json"))
        shutil.copy(part, src / f"{n}.json")
    _drain(stream, "late")
    got = {r["fix_id"]: r["reason"] for r in spark.table("late").collect()}
    assert 3 not in got and set(got) == {1, 2, 4, 5, 6, 7}
    assert got[7] == "FIRST_RELIABLE_FIX"  # the state of session 1 has gone


def test_stream_lookups_once_per_cell(spark, tmp_path):
    src = str(tmp_path / "cells")
    spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "cell string, s int").withColumn(
        "ts", F.timestamp_seconds("s")).write.json(src)
    read = spark.readStream.schema("cell string, s int, ts timestamp").json(src)
    _drain(nav.lookups_with_ttl(read), "lookups")
    assert sorted(r["cell"] for r in spark.table("lookups").collect()) == ["a", "b"]


def test_long_silence_starts_a_new_trip(spark):
    from heliopath.streaming.keyed import with_trip

    hour = 3600 * 1000
    rows = [(1, i, t * hour) for i, t in enumerate([0, 1, 14, 15, 40, 41])]
    df = spark.createDataFrame(rows, "session_id long, fix_id long, fix_ms long")
    assert [r["trip_no"] for r in with_trip(df).orderBy("fix_id").collect()] == [0, 0, 1, 1, 2, 2]


def test_route_formats_reject_nothing_silently(spark):
    df = spark.createDataFrame([('{"type":"LineString","coordinates":[[1,2],[3,4]]}',), ("[]",), ("{}",)], "t string")
    got = [r[0] for r in df.select(files.any_route_coordinates("t")).collect()]
    assert got == [[[1.0, 2.0], [3.0, 4.0]], [], None]


def test_rejected_fixes_keep_no_heading(spark):
    rows = nav.clean_fixes(_fixes(spark)).filter("NOT accepted").select("heading").distinct().collect()
    assert [r["heading"] for r in rows] == [None]


def test_bad_elevation_files_are_told(spark, tmp_path):
    grid = np.arange(9, dtype=">i2")
    (tmp_path / "N42W072.hgt").write_bytes(grid.tobytes())
    (tmp_path / "N43W072.hgt").write_bytes(grid.tobytes()[:-2])
    (tmp_path / "N44W072.hgt.gz").write_bytes(b"not gzip")
    (tmp_path / "north.hgt").write_bytes(grid.tobytes())
    rows = files.read_elevation_lines(spark, str(tmp_path), side=3).collect()
    assert {r["file"]: r["problem"] for r in rows} == {
        "N42W072.hgt": None, "N43W072.hgt": "FILE_SIZE", "N44W072.hgt.gz": "GZIP", "north.hgt": "FILE_NAME"}


def test_fixes_far_off_the_route_keep_their_distance(spark):
    from heliopath.operators import paths

    v = spark.createDataFrame([(1, i, 42.0, -71.0 + 0.01 * i) for i in range(4)], "route_id long, v_idx long, lat double, lng double")
    run = paths.with_running_m(paths.with_heading(paths.route_segments(v)))
    ends = spark.createDataFrame([(1, 42.0, -70.97, 2)], "route_id long, end_lat double, end_lng double, last_seg long")
    fixes = spark.createDataFrame([(1, 1, 42.0001, -70.995), (2, 1, 42.0018, -70.985), (3, 1, 42.3, -70.975)],
                                  "fix_id long, route_id long, lat double, lng double")
    out = {r.fix_id: r.near for r in nav.with_near(fixes, nav.nearby_segments(run), ends, segments=run).collect()}
    assert [out[k][0].seg for k in (1, 2, 3)] == [0, 1, 2]
    for k, metres in ((1, 11.1), (2, 200.2), (3, 33358.5)):
        assert abs(out[k][0].gap - metres) < metres * 0.001 + 0.1
