"""Range reads of volume files, files published together, and cases loaded from them."""

import gzip
import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from voluma.operators import cases
from voluma.sources import bundles, planes
from voluma.sources import volumes as S

AFFINE = np.diag([0.5, 0.75, 1.25, 1]).ravel().tolist()


@pytest.fixture
def files(tmp_path):
    array = np.arange(5 * 6 * 7, dtype="i2").reshape(5, 6, 7)
    (tmp_path / "a.nii.gz").write_bytes(S.nifti_bytes(array, AFFINE))
    (tmp_path / "b.nii").write_bytes(gzip.decompress(S.nifti_bytes(array, AFFINE)))
    np.save(tmp_path / "c.npy", array)
    np.save(tmp_path / "d.npy", np.asfortranarray(array))
    (tmp_path / "e.raw").write_bytes(array.astype(">u2").tobytes())
    (tmp_path / "e.raw.json").write_text('{"dtype": ">u2", "shape": [5, 6, 7]}')
    scaled = bytearray(gzip.decompress(S.nifti_bytes(array, AFFINE)))
    scaled[112:120] = np.array([2.0, -1.0], "<f4").tobytes()
    (tmp_path / "f.nii").write_bytes(bytes(scaled))
    return tmp_path, array


def test_all_kinds_of_files_by_ranges(spark, files):
    path, array = files
    for size in (1, 200, 1 << 20):
        rows = planes.scan_voxels(spark, str(path), range_bytes=size).collect()
        assert len(rows) == 6 * array.size and {r.volume_id for r in rows} == set("abcdef")
        assert all(r.value == (2 * array[r.z, r.y, r.x] - 1 if r.volume_id == "f" else array[r.z, r.y, r.x]) for r in rows)
    heads = {r.volume_id: r for r in planes.scan_headers(spark, str(path), spacing=0.8).collect()}
    assert all((h.nz, h.ny, h.nx) == (5, 6, 7) for h in heads.values())
    assert heads["b"].affine == pytest.approx(AFFINE) and heads["c"].zooms == [0.8] * 3 and heads["e"].dtype == "uint16"


def test_only_the_bytes_asked_for_are_read(files, monkeypatch):
    path, array = files
    read = []
    real = planes.read_range
    monkeypatch.setattr(planes, "read_range", lambda f, offset, size: read.append(size) or real(f, offset, size))

    def scanned(name, **options):
        reader = planes.VolumeReader({"path": str(path / name), "bytes": "1"} | {k: json.dumps(v) for k, v in options.items()})
        parts = reader.partitions()
        read.clear()
        rows = [r for p in parts for batch in reader.read(p) for r in batch.to_pylist()]
        return rows, sum(read)

    rows, size = scanned("c.npy", within={"z": [2, 3]})
    assert size == 2 * 6 * 7 * 2 and {r["z"] for r in rows} == {2, 3} and all(r["value"] == array[r["z"], r["y"], r["x"]] for r in rows)
    rows, size = scanned("b.nii", within={"x": [4, 4], "y": [None, 1], "z": [3, None]})
    assert size == 5 * 6 * 2 and {(r["x"], r["y"], r["z"]) for r in rows} == {(4, y, z) for y in (0, 1) for z in (3, 4)}
    assert all(r["value"] == array[r["z"], r["y"], 4] for r in rows)
    assert scanned("e.raw", within={"z": [9, 9]}) == ([], 0) and scanned("c.npy", volumes=["x", "y"]) == ([], 0)
    rows, size = scanned("", volumes=["c", "e"], within={"z": [0, 0]})
    assert size == 2 * 6 * 7 * 2 and {r["volume_id"] for r in rows} == {"c", "e"}


def test_uses_of_a_scan_do_not_meet(spark, files):
    path, array = files
    rows = planes.scan_voxels(spark, str(path), volumes=["c"], range_bytes=1)
    assert rows.where("z = 1").union(rows.where("z = 2")).count() == 2 * 6 * 7
    some = planes.scan_voxels(spark, str(path), within={"z": (3, 3)}, volumes=["c"], range_bytes=1)
    assert some.rdd.getNumPartitions() == 1 and [r.value for r in some.orderBy("y", "x").collect()] == array[3].ravel().tolist()


def test_short_files_are_errors(spark, files):
    path, _ = files
    (path / "b.nii").write_bytes((path / "b.nii").read_bytes()[:-1])
    with pytest.raises(Exception, match="early"):
        planes.scan_voxels(spark, str(path / "b.nii")).collect()
    with pytest.raises(Exception, match="FileNotFound"):
        planes.scan_voxels(spark, str(path / "none")).collect()


def test_files_of_a_write_come_together(spark, tmp_path):
    out = str(tmp_path / "out")
    rows = [(f"{k}/{i}.bin", part, bytes([i, part])) for k in "ab" for i in range(20) for part in (2, 0, 1)]
    files = spark.createDataFrame(rows, bundles.FILES).repartition(7)
    bundles.write_files(files, out)
    assert all(open(f"{out}/{k}/{i}.bin", "rb").read() == bytes([i, 0, i, 1, i, 2]) for k in "ab" for i in range(20))
    with pytest.raises(Exception, match="FileExistsError"):
        bundles.write_files(files, out)
    bundles.write_files(files.where("file = 'a/3.bin'"), out, overwrite=True)
    assert [f for _, _, names in os.walk(out) for f in names] == ["3.bin"]
    bad = str(tmp_path / "bad")
    failing = files.withColumn("content", F.when(F.col("file") == "b/7.bin", F.raise_error(F.lit("lost")).cast("binary")).otherwise(F.col("content")))
    with pytest.raises(Exception, match="lost"):
        bundles.write_files(failing, bad)
    with pytest.raises(Exception, match="part 1 where part 0"):
        bundles.write_files(files.where("part > 0"), bad)
    with pytest.raises(Exception, match="no name"):
        bundles.write_files(files.withColumn("file", F.lit("../x")), bad)
    assert sorted(os.listdir(tmp_path)) == ["out"]


def test_volumes_by_parts_are_those_written_whole(spark, tmp_path):
    array = np.random.default_rng(0).random((4, 3, 10)).astype("f4")
    array[:, :, 5:8] = 0
    voxels = spark.createDataFrame([("v", int(z), int(y), int(x), float(array[z, y, x])) for z, y, x in np.argwhere(array)], "volume_id string, z int, y int, x int, value double")
    heads = spark.createDataFrame([("v", 4, 3, 10, AFFINE), ("empty", 2, 2, 2, AFFINE)], "volume_id string, nz int, ny int, nx int, affine array<double>")
    bundles.write_prepared(voxels, heads, str(tmp_path / "p"))
    found = S.parse_nifti((tmp_path / "p" / "v.nii.gz").read_bytes())
    assert (found[0] == array).all() and found[1] == pytest.approx(AFFINE) and found[3:] == (3, 1, 2)
    assert (S.parse_nifti((tmp_path / "p" / "empty.nii.gz").read_bytes())[0] == 0).all()
    with pytest.raises(Exception, match="outside its size"):
        bundles.write_prepared(voxels, heads.withColumn("nx", F.lit(9)), str(tmp_path / "q"))


def cohort(spark, path, shift=0.0, mask_at=0.5, affine=AFFINE, shape=(3, 4, 5)):
    rng = np.random.default_rng(1)
    target = (rng.random((3, 4, 5)) > 0.5).astype("u1")
    score = (rng.random(shape) * 0.9 + shift).astype("f4")
    for name, array, a in (("t", target, AFFINE), ("s", score, affine), ("m", (score >= np.float32(mask_at)).astype("u1"), AFFINE)):
        (path / f"{name}.nii.gz").write_bytes(S.nifti_bytes(array, a))
    table = spark.createDataFrame([("one", 0.5, *[str(path / f"{n}.nii.gz") for n in "tsm"])], "case string, threshold double, target_path string, score_path string, mask_path string")
    return table, target, score


def test_cases_from_files(spark, tmp_path):
    table, target, score = cohort(spark, tmp_path)
    rows = cases.load_cases(spark, table, str(tmp_path)).collect()
    assert len(rows) == 60 and all(r.target == bool(target[r.z, r.y, r.x]) and np.float32(r.score) == score[r.z, r.y, r.x] for r in rows)
    assert all(r.prediction == (score[r.z, r.y, r.x] >= np.float32(0.5)) and (r.nz, r.ny, r.nx) == (3, 4, 5) for r in rows)


@pytest.mark.parametrize(
    "wrong,message",
    [({"shift": 0.5}, "not in"), ({"mask_at": 0.6}, "not the score at the threshold"), ({"affine": np.eye(4).ravel().tolist()}, "affine is not"), ({"shape": (3, 4, 4)}, "size is not")],
)
def test_wrong_cases_are_errors(spark, tmp_path, wrong, message):
    table, _, _ = cohort(spark, tmp_path, **wrong)
    with pytest.raises(Exception, match=f"{message}.*case one"):
        cases.load_cases(spark, table, str(tmp_path)).collect()


def test_missing_files_wrong_targets_and_records(spark, tmp_path):
    table, target, _ = cohort(spark, tmp_path)
    with pytest.raises(Exception, match="no mask file in case one"):
        cases.load_cases(spark, table.withColumn("mask_path", F.lit("nowhere")), str(tmp_path)).collect()
    (tmp_path / "t.nii.gz").write_bytes(S.nifti_bytes(target + 1, AFFINE))
    with pytest.raises(Exception, match="target that is not 0 and 1"):
        cases.load_cases(spark, table, str(tmp_path)).collect()
    records = spark.createDataFrame([("one", 0.5, None)], "case string, threshold double, mask_path string")
    assert cases.checked_records(table, records, ["threshold"]).count() == 1
    with pytest.raises(Exception, match="another mask_path recorded in case one"):
        cases.checked_records(table, records, ["threshold", "mask_path"]).collect()
    with pytest.raises(Exception, match="no record in case one"):
        cases.checked_records(table, records.limit(0), ["threshold"]).collect()


def test_case_writer(spark, tmp_path):
    out = str(tmp_path / "out")
    voxels = spark.createDataFrame([("c1", 0, 0, 1, 0.75)], "volume_id string, z int, y int, x int, value double")
    heads = spark.createDataFrame([("c1", 1, 1, 2, AFFINE)], "volume_id string, nz int, ny int, nx int, affine array<double>")
    records = spark.createDataFrame([("c1", "m", 0.5, None, {"b": 1, "a": 2})], "volume_id string, method string, threshold double, note string, more map<string,int>")
    bundles.write_cases(voxels, voxels.withColumn("value", F.lit(1)), heads, records, out)
    text = open(f"{out}/c1_metadata.json").read()
    want = {"method": "m", "threshold": 0.5, "note": None, "more": {"a": 2, "b": 1}, "outputs": {k: f"{out}/c1_{k}.nii.gz" for k in ("score", "mask")}}
    assert text == json.dumps(want, indent=2, sort_keys=True) + "\n"
    assert S.parse_nifti(open(f"{out}/c1_mask.nii.gz", "rb").read())[0].dtype == np.uint8
    with pytest.raises(Exception, match="not finite"):
        bundles.write_cases(voxels, voxels, heads, records.withColumn("threshold", F.lit(float("nan"))), str(tmp_path / "nan"))
    assert sorted(os.listdir(tmp_path)) == ["out"]
