"""Volume files there and back."""

import gzip
import json

import numpy as np
import pytest

from voluma.sources import volumes as S


def test_files_there_and_back(spark, tmp_path):
    array = np.arange(24, dtype="i2").reshape(2, 3, 4)
    affine = np.diag([0.5, 0.75, 1.25, 1]).ravel().tolist()
    (tmp_path / "a_label.nii.gz").write_bytes(S.nifti_bytes(array, affine))
    np.save(tmp_path / "b.npy", array)
    (tmp_path / "c.raw").write_bytes(array.astype("u2").tobytes())
    side = {"c.raw": json.loads('{"dtype": "uint16", "shape": [2, 3, 4]}')}
    rows = S.read_volumes(spark, str(tmp_path), side).collect()
    assert len(rows) == 72 and {r.volume_id for r in rows} == {"a_label", "b", "c"}
    assert all(r.value == array[r.z, r.y, r.x] for r in rows)
    heads = S.read_headers(spark, str(tmp_path), side)
    head = heads.where("volume_id = 'a_label'").first()
    assert (head.nz, head.ny, head.nx, head.dtype, head.unit) == (2, 3, 4, "int16", 3) and head.affine == pytest.approx(affine) and head.zooms == pytest.approx([0.5, 0.75, 1.25])
    out = S.to_nifti(S.read_volumes(spark, str(tmp_path), side), heads, dtype="i2").where("volume_id = 'a_label'").first()
    assert bytes(out.content) == S.nifti_bytes(array, affine)


def test_wrong_files():
    with pytest.raises(ValueError, match="not a NIfTI"):
        S.parse_nifti(gzip.compress(bytes(400)))
    with pytest.raises(ValueError, match="sidecar"):
        S._array("x.raw", b"", {})


def test_header_codes_and_orientation_are_kept(spark, tmp_path):
    array = np.arange(24, dtype="i2").reshape(2, 3, 4)
    turn = np.array([[0, -1, 0], [1, 0, 0], [0, 0, -1]]) * [0.5, 0.75, 1.25]
    affine = np.vstack([np.column_stack([turn, [3, -2, 7]]), [0, 0, 0, 1]]).ravel().tolist()
    whole = S.nifti_bytes(array, affine, 2, qform=1, sform=2)
    only_q = bytearray(gzip.decompress(whole))
    only_q[254:256], only_q[280:328] = bytes(2), bytes(48)
    for data in (whole, gzip.compress(bytes(only_q))):
        found = S.parse_nifti(data)
        assert found[1] == pytest.approx(affine, abs=1e-6) and found[3:5] == (2, 1) and (found[0] == array).all()
    (tmp_path / "q.nii.gz").write_bytes(whole)
    (tmp_path / "r.raw").write_bytes(array.tobytes())
    (tmp_path / "r.raw.json").write_text('{"dtype": "int16", "shape": [2, 3, 4]}')
    heads = S.read_headers(spark, str(tmp_path), spacing=0.8)
    raw = heads.where("volume_id = 'r'").first()
    assert (raw.nz, raw.ny, raw.nx) == (2, 3, 4) and raw.zooms == [0.8] * 3
    voxels = S.read_volumes(spark, str(tmp_path))
    out = S.to_nifti(voxels, heads, dtype="i2").where("volume_id = 'q'").first()
    again = S.parse_nifti(bytes(out.content))
    assert again[1] == pytest.approx(affine, abs=1e-6) and again[3:] == (2, 1, 2) and (again[0] == array).all()
    with pytest.raises(Exception, match="outside its size"):
        S.to_nifti(voxels.where("volume_id = 'q'"), heads.where("volume_id = 'q'").withColumn("nx", heads["nx"] - 1)).collect()


def test_target_affine_keeps_the_centre():
    affine = np.array([[0, -0.5, 0, 10], [0.4, 0, 0, 20], [0, 0, 0.8, 30], [0, 0, 0, 1]])
    new = np.array(S.target_affine(affine.ravel().tolist(), [5, 7, 3], [3, 4, 3], 0.8)).reshape(4, 4)
    assert np.allclose(affine @ [2, 3, 1, 1], new @ [1, 1.5, 1, 1]) and np.allclose(np.sqrt((new[:3, :3] ** 2).sum(axis=0)), 0.8)
    with pytest.raises(ValueError, match="independent"):
        S.target_affine(np.zeros(16).tolist(), [2, 2, 2], [2, 2, 2], 1.0)


def test_axes_beyond_16_bits(spark, tmp_path):
    """NIfTI-1 has no room for a size above 32,767; a part holds the planes that a task may hold."""
    from voluma.sources import bundles, planes, volumes

    affine = [float(v) for v in (0.5, 0, 0, 1, 0, 0.25, 0, 2, 0, 0, 2, 3, 0, 0, 0, 1)]
    heads = spark.createDataFrame([("long", 40_000, 1, 20, affine), ("wide", 5, 4, 3, affine)], "volume_id string, nz int, ny int, nx int, affine array<double>")
    rows = spark.createDataFrame([("long", 39_999, 0, 19, 7.0), ("long", 3, 0, 12, 5.0), ("wide", 4, 3, 2, 9.0)], "volume_id string, z int, y int, x int, value double")
    assert sorted((r.volume_id, r.part) for r in bundles.volume_parts(rows, heads).select("volume_id", "part").collect()) == [("long", 0), ("long", 1), ("wide", 0)]
    bundles.write_prepared(rows, heads, f"{tmp_path}/out")
    found = planes.scan_voxels(spark, f"{tmp_path}/out").where("value > 0").select("volume_id", "z", "y", "x", "value").collect()
    assert sorted(map(tuple, found)) == sorted(map(tuple, rows.collect()))
    head = {r.volume_id: r for r in volumes.read_headers(spark, f"{tmp_path}/out").collect()}["long"]
    assert (head.nz, head.ny, head.nx, head.unit, head.qform, head.sform, head.zooms) == (40_000, 1, 20, 3, 1, 2, [0.5, 0.25, 2.0]) and head.affine == pytest.approx(affine)
    turned = volumes.nifti_head((40_000, 1, 20), np.dtype("f4"), affine, 3, 1, 0)
    assert volumes.nifti_header(turned).affine == pytest.approx(affine)
