"""RGB rows as PNG files, a file for each image, and back."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIGNATURE = b"\x89PNG\r\n\x1a\n"


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def png_bytes(rgb: np.ndarray) -> bytes:
    """A PNG file of (height, width, 3) bytes; each scan line is stored as it is, or as differences to the left or to the line
    above, whichever are smallest."""
    h, w, _ = rgb.shape
    lines = rgb.astype(np.uint8).reshape(h, w * 3)
    left, above = lines.copy(), lines.copy()
    left[:, 3:] -= lines[:, :-3]
    above[1:] -= lines[:-1]
    kinds = np.stack([lines, left, above])
    best = np.abs(kinds.view(np.int8).astype(np.int64)).sum(axis=2).argmin(axis=0)
    data = np.column_stack([best.astype(np.uint8), kinds[best, np.arange(h)]]).tobytes()
    head = struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(data, 9)) + _chunk(b"IEND", b"")


def png_pixels(data: bytes) -> np.ndarray:
    """The (height, width, 3) bytes of a file that ``png_bytes`` made; a wrong checksum or another kind of PNG is an error."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG file")
    at, body, size = 8, b"", (0, 0)
    while at < len(data):
        (n,), kind = struct.unpack(">I", data[at : at + 4]), data[at + 4 : at + 8]
        part = data[at + 8 : at + 8 + n]
        if struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0] != zlib.crc32(kind + part):
            raise ValueError("a PNG chunk has a wrong checksum")
        if kind == b"IHDR":
            w, h, *rest = struct.unpack(">IIBBBBB", part)
            if rest != [8, 2, 0, 0, 0]:
                raise ValueError("only plain RGB images of 8 bits are read")
            size = (h, w)
        body += part if kind == b"IDAT" else b""
        at += 12 + n
    h, w = size
    lines = np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, 1 + 3 * w)
    out = np.zeros((h, 3 * w), np.uint8)
    for i, line in enumerate(lines):
        if line[0] > 2:
            raise ValueError("only lines of differences to the left and above are read")
        if line[0] == 1:
            out[i] = np.cumsum(line[1:].reshape(w, 3), axis=0, dtype=np.uint8).ravel()
        else:
            out[i] = line[1:] + (out[i - 1] if line[0] == 2 and i else 0)
    return out.reshape(h, w, 3)


def laid_out(rows: DataFrame, down: Column, across: Column, height: int, width: int, gap: int = 4) -> DataFrame:
    """rows whose row and column are those in one figure of panels of a size, ``gap`` pixels apart."""
    return rows.withColumns({"row": F.col("row") + down * (height + gap), "column": F.col("column") + across * (width + gap)})


def image_files(rows: DataFrame, file: Column, background: Sequence[int] = (255, 255, 255)) -> DataFrame:
    """file, part, content (for ``bundles.write_files``): a PNG for each name, from rows of row, column, r, g, b.

    An image is as large as its last row and column; pixels without a row are ``background``; of a pixel with several rows the
    greatest (r, g, b) counts.  An image is made in one task: it is a picture to look at, a plane or a figure, not a volume.
    """
    pixels = rows.groupBy(file.alias("file"), "row", "column").agg(F.max(F.struct("r", "g", "b")).alias("c")).select("file", "row", "column", "c.*")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = np.full((int(pdf["row"].max()) + 1, int(pdf["column"].max()) + 1, 3), background, np.uint8)
        out[pdf["row"], pdf["column"]] = pdf[["r", "g", "b"]]
        return pd.DataFrame({"file": [pdf["file"].iloc[0]], "part": [0], "content": [png_bytes(out)]})

    return pixels.groupBy("file").applyInPandas(run, "file string, part int, content binary")


def read_images(files: DataFrame) -> DataFrame:
    """path, row, column, r, g, b of PNG files (path, content, as ``binaryFile`` gives them)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                rgb = png_pixels(bytes(content))
                row, column = (c.ravel() for c in np.indices(rgb.shape[:2]))
                yield pd.DataFrame({"path": path, "row": row, "column": column, **{c: rgb[..., i].ravel() for i, c in enumerate("rgb")}})

    return files.select("path", "content").mapInPandas(run, "path string, row int, column int, r int, g int, b int")
