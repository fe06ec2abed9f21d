"""The data source of patch files: folders left out by filters, headers of both versions, stray files."""

import io

import numpy as np
import pytest
from pyspark.sql.datasource import EqualTo, GreaterThan, In

from zonomy.sources import patch_source


@pytest.fixture()
def tree(tmp_path):
    for k, dataset in enumerate(("training", "testing")):
        folder = tmp_path / dataset / "deep" / "er"
        folder.mkdir(parents=True)
        for i in range(5):
            np.save(folder / f"patch_{k}{i}.npy", np.arange(2 * 3 * (i + 1), dtype="<i2").reshape(2, 3, i + 1))
        (folder / "notes.txt").write_text("x")
    (tmp_path / "other").mkdir()
    np.save(tmp_path / "other" / "patch_99.npy", np.zeros((1, 1, 1)))
    return str(tmp_path)


def test_modes(spark, tree):
    files = patch_source.read_patches(spark, tree, parts=3)
    assert sorted((r["dataset"], r["patch_id"]) for r in files.collect()) == sorted((d, f"{k}{i}") for k, d in enumerate(("training", "testing")) for i in range(5))
    shapes = {r["patch_id"]: (r["h"], r["w"], r["bytes_read"]) for r in patch_source.read_patches(spark, tree, "shapes").collect()}
    assert shapes["03"] == (3, 4, 128) and shapes["14"] == (3, 5, 128)
    px = {(r["row"], r["col"]): r["v"] for r in patch_source.read_patches(spark, tree, "pixels").where("dataset = 'testing' and patch_id = '11'").collect()}
    assert px == {(i, j): [float(i * 2 + j), float(6 + i * 2 + j)] for i in range(3) for j in range(2)}
    assert patch_source.read_patches(spark, tree + "/nowhere").count() == 0


def test_a_filter_leaves_other_folders_unread(spark, tree, tmp_path):
    (tmp_path / "testing" / "patch_bad.npy").write_bytes(b"not an array")
    df = patch_source.read_patches(spark, tree, "shapes")
    assert df.where("dataset = 'training'").count() == 5
    with pytest.raises(Exception):
        df.where("dataset = 'testing'").select("h").collect()
    reader = patch_source.PatchReader({"path": tree, "parts": "2"})
    rest = list(reader.pushFilters([EqualTo(("dataset",), "testing"), GreaterThan(("h",), 3), In(("dataset",), ("testing", "training"))]))
    assert len(rest) == 1 and [p.dataset for p in reader.partitions()] == ["testing", "testing"]


def test_long_headers():
    buffer = io.BytesIO()
    np.lib.format.write_array_header_2_0(buffer, {"descr": "<f4", "fortran_order": False, "shape": (4, 7, 9)})
    buffer.write(b"\0" * 4 * 7 * 9 * 4)

    class File:
        def __init__(self, data):
            self.f = io.BytesIO(data)

        def read(self, n):
            return self.f.read(n)

    shape, read = patch_source.header_shape(File(buffer.getvalue()))
    assert shape == (4, 7, 9) and read <= 256
