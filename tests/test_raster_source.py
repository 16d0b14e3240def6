"""The raster data source: the same rows as the ingest, partitions by size, windows decoded alone."""

import io
import os

import numpy as np
import pytest
import tiff

from tessera import constants as K
from tessera.operators import grid as G
from tessera.sources import raster_source as SRC
from tessera.sources import rasters as RS


@pytest.fixture
def masks(tmp_path):
    rng = np.random.default_rng(0)
    root = tmp_path / "masks"
    (root / "sub").mkdir(parents=True)
    for k, side in enumerate((120, 100, 130, 1000, 7)):
        a = rng.choice(K.CLASS_CODES, (side, side + k)).astype(np.uint16)
        (root / ("sub" if k % 2 else ".") / f"S{k}{K.MASK_SUFFIX}").write_bytes(tiff.encode(a))
    (root / "notes.txt").write_text("no raster")
    (root / "S9_reference_map.TIF").write_bytes(b"another suffix")
    return str(root)


def test_whole_rasters_equal_the_ingest(spark, masks):
    got = SRC.read_rasters(spark, masks, tiff.decode_window, window=None).drop("path")
    want = RS.ingest_rasters(spark, masks, tiff.decode).drop("path")
    assert sorted(got.collect()) == sorted(want.collect()) and got.schema == want.schema


def test_windows_give_the_same_tables(spark, masks):
    rows = SRC.read_rasters(spark, f"file://{masks}", tiff.decode_window)
    assert {(r["img_name"], r["height"], r["width"]) for r in rows.collect()} == {("S0", 120, 120), ("S1", 100, 101), ("S2", 120, 120), ("S3", 120, 120), ("S4", 7, 11)}
    want = G.grid_area(RS.ingest_rasters(spark, masks, tiff.decode))
    assert sorted(G.grid_area(rows).collect()) == sorted(want.collect())


def test_rows_outside_the_window_are_not_decoded(spark, masks, tmp_path):
    seen = str(tmp_path / "seen")
    os.mkdir(seen)

    def counting(f, side, seen=seen):
        a = tiff.decode_window(f, side)
        with open(f"{seen}/{a.shape[1]}", "w") as out:
            out.write(str(a.shape[0]))
        return a

    SRC.read_rasters(spark, masks, counting).count()
    rows = {int(w): int(open(f"{seen}/{w}").read()) for w in os.listdir(seen)}
    assert rows == {120: 120, 101: 100, 132: 120, 1003: 120, 11: 7}  # of 1000 rows 120


def test_a_window_reads_its_own_bytes():
    class Counting(io.BytesIO):
        taken = 0

        def read(self, n=-1):
            out = super().read(n)
            self.taken += len(out)
            return out

    a = np.arange(2000 * 300, dtype=np.uint16).reshape(2000, 300)
    f = Counting(tiff.encode(a))
    assert (tiff.decode_window(f, 120) == a[:120]).all() and f.taken < 120 * 300 * 2 + 300


def test_partitions_follow_sizes():
    mb = 1 << 20
    got = SRC.packed([("a", 100 * mb), ("b", 50 * mb), ("c", 300 * mb), ("d", 1), ("e", 1)], 128 * mb)
    assert [p.paths for p in got] == [("a",), ("b",), ("c",), ("d", "e")]
    assert len(SRC.packed([(str(i), 10) for i in range(64)], 128 * mb)) == 2  # small files have a cost too


def test_partitions_of_a_read(spark, masks):
    rows = SRC.read_rasters(spark, masks, tiff.decode_window, partition_bytes=1)
    assert rows.rdd.getNumPartitions() == 5 and rows.count() == 5


def test_colour_images_empty_folders_and_wrong_kinds(spark, tmp_path):
    rgb = np.random.default_rng(1).integers(0, 256, (150, 4, 3), dtype=np.uint8)
    (tmp_path / "x.tif").write_bytes(tiff.encode(rgb))
    row = SRC.read_rasters(spark, str(tmp_path), tiff.decode_window, cut=4, kind="rgb").first()
    assert (row["img_name"], row["height"], row["width"]) == ("x", 120, 4)
    assert row["bands"] == [rgb[:120, :, b].ravel().astype(float).tolist() for b in range(3)]
    (tmp_path / "none").mkdir()
    assert SRC.read_rasters(spark, str(tmp_path / "none"), tiff.decode_window).count() == 0
    with pytest.raises(Exception, match="one band"):
        SRC.read_rasters(spark, str(tmp_path), tiff.decode_window, cut=4).collect()
    with pytest.raises(Exception, match="kind must be"):
        SRC.read_rasters(spark, str(tmp_path), tiff.decode_window, kind="other").collect()
