import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from voluma.sources import bundles, images


def test_pixels_there_and_back():
    rng = np.random.default_rng(0)
    for shape in ((1, 1, 3), (7, 5, 3), (40, 60, 3)):
        noise = rng.integers(0, 256, shape, np.uint8)
        ramp = np.broadcast_to(np.arange(shape[1])[None, :, None] * 3 % 256, shape).astype(np.uint8)
        for rgb in (noise, ramp, np.full(shape, 200, np.uint8), np.ascontiguousarray(ramp[::-1])):
            data = images.png_bytes(rgb)
            assert (images.png_pixels(data) == rgb).all()
            assert data[12:16] == b"IHDR" and int.from_bytes(data[29:33]) == zlib.crc32(data[12:29])
    broken = bytearray(data)
    broken[45] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        images.png_pixels(bytes(broken))
    with pytest.raises(ValueError, match="not a PNG"):
        images.png_pixels(b"GIF89a")


def test_panels_as_files(spark, tmp_path):
    rows = spark.createDataFrame([(f, p, r, c, 10 * p + r, c, 7) for f in ("a", "b") for p in (0, 1) for r in range(3) for c in range(2)], "f string, p int, row int, column int, r int, g int, b int")
    placed = images.laid_out(rows, F.lit(0), F.col("p"), 3, 2, gap=1)
    out = str(tmp_path / "figures")
    bundles.write_files(images.image_files(placed, F.concat("f", F.lit(".png")), (1, 2, 3)), out)
    got = images.png_pixels((tmp_path / "figures" / "b.png").read_bytes())
    assert got.shape == (3, 5, 3) and got[2, 4].tolist() == [12, 1, 7] and got[0, 2].tolist() == [1, 2, 3]
    back = images.read_images(spark.read.format("binaryFile").load(out))
    assert back.count() == 2 * 15 and back.where("path like '%a.png' and row = 1 and column = 3").first()[1:] == (1, 3, 11, 0, 7)
