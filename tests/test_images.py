import struct
import zlib

import numpy as np
from pyspark.sql import functions as F

from wordloom.sources import images as im


def _png(path, pixels: np.ndarray, color_type: int):
    """Minimal PNG writer (8-bit, no interlace) with zlib and struct."""
    h, w = pixels.shape[:2]
    raw = b"".join(b"\x00" + pixels[y].tobytes() for y in range(h))

    def chunk(kind, data):
        c = struct.pack(">I", len(data)) + kind + data
        return c + struct.pack(">I", zlib.crc32(kind + data) & 0xFFFFFFFF)

    ihdr = struct.pack(">IIBBBBB", w, h, 8, color_type, 0, 0, 0)
    data = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", ihdr) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
    with open(path, "wb") as f:
        f.write(data)
    return data


def test_image_scan_and_features(spark, tmp_dir):
    rgb = np.zeros((4, 6, 3), dtype=np.uint8)
    rgb[..., 0] = 255                                           # pure red
    _png(f"{tmp_dir}/rgb.png", rgb, 2)
    rgba = np.full((3, 3, 4), 128, dtype=np.uint8)
    _png(f"{tmp_dir}/rgba.png", rgba, 6)
    grey = np.full((5, 2), 200, dtype=np.uint8)
    _png(f"{tmp_dir}/grey.png", grey, 0)
    full = _png(f"{tmp_dir}/tmp.png", rgb, 2)
    with open(f"{tmp_dir}/broken.png", "wb") as f:
        f.write(full[:30])
    df = im.read_images(spark, tmp_dir)
    valid = {r.image.origin.split("/")[-1]: r.valid for r in df.collect()}
    assert valid["rgb.png"] and valid["rgba.png"] and valid["grey.png"]
    assert not valid.get("broken.png", False)
    feats = {r.origin.split("/")[-1]: r for r in im.image_features(df, size=8).collect()}
    red = np.array(feats["rgb.png"].features).reshape(3, 8, 8)
    assert feats["rgb.png"].input_shape == [3, 8, 8]
    assert np.allclose(red[0], (1 - 0.485) / 0.229, atol=1e-4)   # channel order is RGB
    assert np.allclose(red[2], (0 - 0.406) / 0.225, atol=1e-4)
    g = np.array(feats["grey.png"].features).reshape(3, 8, 8)
    assert np.allclose(g[1], (200 / 255 - 0.456) / 0.224, atol=1e-4)
    assert "broken.png" not in feats
    assert df.where(~F.col("valid")).count() == len(valid) - 4
