"""Control-point files read, filtered and written again: headers alone, other columns, names, ids, failures."""

import os

import pytest
from pyspark.errors import PySparkException

from lumitrack.operators import tracks
from lumitrack.plans.georeference import filter_files
from lumitrack.sources import point_files

HEADER = "mapX,mapY,sourceX,sourceY,enable,dX,dY,residual,note"


def nine(folder, empty=4):
    """Nine files; one of them has a header alone, and one of a tenth and eleventh isn't a frame."""
    folder.mkdir()
    for f in range(9):
        rows = [] if f == empty else [f"{10 + 0.1 * f + sx / 1000:.6f},{20 + sy / 1000:.6f},{sx},{sy},1,0.50,0.250,0,n{f}" for sx in (0, 185, 370) for sy in (0, -185, -370)]
        (folder / f"ISS001-E-{100 + f}_real.points").write_text("\n".join([HEADER, *rows]) + "\n")
    (folder / "ISS001-E-300_real.points").write_text("mapX,mapY\n1,2\n")
    (folder / "other.txt").write_text("nothing")


def test_frames_are_files(spark, tmp_path):
    nine(tmp_path / "in")
    files = {r.file_name: r for r in point_files.read_point_files(spark, str(tmp_path / "in"), what="files").collect()}
    assert len(files) == 10 and files["ISS001-E-104_real.points"].n_points == 0 and files["ISS001-E-104_real.points"].complete and not files["ISS001-E-300_real.points"].complete
    frames = point_files.frames_of_files(spark, str(tmp_path / "in"), mission="ISS001").orderBy("frame_index").collect()
    assert [(r.frame_index, r.frame_id, r.output_name) for r in frames] == [(i, 100 + i, f"ISS001-E-{100 + i}.points") for i in range(9)]
    some = point_files.frames_of_files(spark, str(tmp_path / "in"), 103, 106).orderBy("frame_index").collect()
    assert [(r.frame_index, r.frame_id) for r in some] == [(0, 103), (1, 104), (2, 105), (3, 106)]


def test_nine_files_in_nine_out(spark, tmp_path):
    nine(tmp_path / "in")
    found = filter_files(spark, str(tmp_path / "in"), str(tmp_path / "out"), tracks.FilterConfig(order=1, min_points=4), 80.0, mission="ISS001")
    assert sorted(os.listdir(tmp_path / "out/points")) == [f"ISS001-E-{100 + i}.points" for i in range(9)]
    own = (tmp_path / "out/points/ISS001-E-103.points").read_text().splitlines()
    assert own[0] == HEADER + ",temporal_status,temporal_residual_km,temporal_threshold_km" and len(own) == 10 and all(",n3,kept," in r for r in own[1:])
    filled = (tmp_path / "out/points/ISS001-E-104.points").read_text().splitlines()
    assert len(filled) == 10 and all(",n0,imputed," in r for r in filled[1:]) and float(filled[1].split(",")[0]) == pytest.approx(10.4)
    qc = {r.frame_index: r for r in found.frame_qc.collect()}
    assert (qc[4].input_count, qc[4].imputed, qc[4].post_spatial_kept) == (0, 9, 9) and qc[3].pre_spatial_kept_diagnostic == 9
    written = spark.read.option("header", True).csv(str(tmp_path / "out/frame_qc"))
    assert written.columns == [
        "frame_index", "frame_id", "input_name", "output_name", "input_count", "pre_spatial_kept_diagnostic", "temporal_outliers", "imputed", "output_before_post_spatial",
        "post_spatial_kept", "post_spatial_rejected",
    ]
    assert len(found.track_qc.columns) == 17
    none = filter_files(spark, str(tmp_path / "in"), str(tmp_path / "less"), tracks.FilterConfig(order=1, min_points=4), 80.0, 101, 107, "X", status=False)
    assert sorted(os.listdir(tmp_path / "less/points")) == [f"X-E-{i}.points" for i in range(101, 108)] and none.frame_qc.count() == 7
    assert (tmp_path / "less/points/X-E-102.points").read_text().splitlines()[0] == HEADER


def test_rows_that_stay_are_the_same_bytes(spark, tmp_path):
    nine(tmp_path / "in")
    (tmp_path / "in/ISS001-E-109_real.points").write_text('mapX,mapY,sourceX,sourceY,note\n1.500,2.50,"3",-4.0,"a, ""b"""\n1e3,,7,8\n')
    read = point_files.read_point_files(spark, str(tmp_path / "in"), lines="true")
    row = {r.row_index: r for r in read.filter("frame_id = 109").collect()}
    assert (row[0].mapX, row[0].sourceX, row[0].note) == (1.5, 3.0, 'a, "b"') and (row[1].mapX, row[1].mapY, row[1].note) == (1000.0, None, None)
    files = point_files.read_point_files(spark, str(tmp_path / "in"), what="files").filter("complete")
    frames = files.selectExpr("frame_id as frame_index", "file_name as output_name")
    for i, some in enumerate((frames.filter("frame_index <> 109"), frames.filter("frame_index = 109"))):
        columns = HEADER.split(",") if i == 0 else ["mapX", "mapY", "sourceX", "sourceY", "note"]
        point_files.write_point_files(read.withColumnsRenamed({"frame_id": "frame_index", "row_index": "row_ordinal"}).repartition(5), some, str(tmp_path / f"out{i}"), columns)
        for name in os.listdir(tmp_path / f"out{i}"):
            assert (tmp_path / f"out{i}" / name).read_bytes() == (tmp_path / "in" / name).read_bytes()
    assert len(os.listdir(tmp_path / "out0")) == 9


def test_repeated_names_and_odd_values(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.points").write_text("﻿mapX, mapY,sourceX,sourceY,note,note,`odd`\r\n1,x,3,4,first,second,o\r\n\r\n")
    (tmp_path / "in" / "empty.points").write_text("")
    read = point_files.read_point_files(spark, str(tmp_path / "in"))
    assert read.columns == ["file_name", "frame_id", "row_index", "mapX", "mapY", "sourceX", "sourceY", "note", "note.1", "`odd`"]
    (r,) = read.collect()
    assert tuple(r) == ("a.points", None, 0, 1.0, None, 3.0, 4.0, "first", "second", "o")
    given = point_files.read_point_files(spark, str(tmp_path / "in"), columns="mapX,note")
    assert given.columns == ["file_name", "frame_id", "row_index", "mapX", "note"] and given.first().note == "first"
    assert point_files.read_point_files(spark, str(tmp_path / "none")).count() == 0


def test_a_run_that_fails_leaves_nothing(spark, tmp_path):
    point_files.register(spark)
    rows = spark.createDataFrame([(f"f{i % 3}.points", i, float(i)) for i in range(30)], "file_name string, row_index int, mapX double")
    for apart in (rows.repartition(4), rows.coalesce(1)):  # a file's rows in several tasks, or not together in one
        with pytest.raises(PySparkException):
            apart.write.format("points").mode("append").save(str(tmp_path / "out"))
        assert [f for _, _, files in os.walk(tmp_path / "out") for f in files] == []
    rows.repartition("file_name").sortWithinPartitions("file_name", "row_index").write.format("points").mode("append").save(str(tmp_path / "out"))
    assert sorted(n for n in os.listdir(tmp_path / "out") if n[0] != "_") == ["f0.points", "f1.points", "f2.points"]
    rows.filter("file_name = 'f1.points'").coalesce(1).write.format("points").mode("overwrite").save(str(tmp_path / "out"))
    assert [n for n in os.listdir(tmp_path / "out") if n[0] != "_"] == ["f1.points"]
