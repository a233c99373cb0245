"""Image scan with validity (S13), preprocessing (I1) and feature rows.

Spark's ``image`` source decodes files (PNG, JPEG ...) into
``image STRUCT<origin, height, width, nChannels, mode, data>`` with pixel
bytes in BGR(A) order.  Preprocessing - to RGB, bilinear resize, scale to
0-1, per-channel normalisation - runs in ``mapInPandas`` with numpy, one
Arrow batch at a time; output is channel-first ``ARRAY<FLOAT>``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values: target size and normalisation constants ----------------
TARGET_SIZE = 224
MEAN = [0.485, 0.456, 0.406]
STD = [0.229, 0.224, 0.225]
VALID_CHANNELS = [1, 3, 4]          # grey, RGB, RGBA
# ---------------------------------------------------------------------------

FEATURE_SCHEMA = ("origin STRING, features ARRAY<FLOAT>, "
                  "input_shape ARRAY<INT>, model_type STRING")


# S13 ------------------------------------------------------------------------
def read_images(spark: SparkSession, path: str, drop_invalid: bool = False,
                recursive: bool = False) -> DataFrame:
    """Image rows plus ``valid``: decoded, a known channel layout and both
    sides > 0 (undecodable files have height -1 in Spark's source)."""
    r = spark.read.format("image").option("dropInvalid", drop_invalid)
    if recursive:
        r = r.option("recursiveFileLookup", "true")
    df = r.load(path)
    valid = ((F.col("image.height") > 0) & (F.col("image.width") > 0)
             & F.col("image.nChannels").isin(*VALID_CHANNELS))
    return df.withColumn("valid", valid)


def _bilinear(img: np.ndarray, out_h: int, out_w: int) -> np.ndarray:
    """Half-pixel-centre bilinear resize of an H x W x C float array."""
    h, w = img.shape[:2]
    ys = (np.arange(out_h) + 0.5) * (h / out_h) - 0.5
    xs = (np.arange(out_w) + 0.5) * (w / out_w) - 0.5
    ys = np.clip(ys, 0, h - 1)
    xs = np.clip(xs, 0, w - 1)
    y0 = np.floor(ys).astype(int)
    x0 = np.floor(xs).astype(int)
    y1 = np.minimum(y0 + 1, h - 1)
    x1 = np.minimum(x0 + 1, w - 1)
    wy = (ys - y0)[:, None, None]
    wx = (xs - x0)[None, :, None]
    top = img[y0][:, x0] * (1 - wx) + img[y0][:, x1] * wx
    bot = img[y1][:, x0] * (1 - wx) + img[y1][:, x1] * wx
    return top * (1 - wy) + bot * wy


def to_rgb(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """Spark's BGR(A)/grey bytes -> H x W x 3 RGB uint8 (alpha dropped)."""
    a = np.frombuffer(data, dtype=np.uint8).reshape(height, width, channels)
    if channels == 1:
        return np.repeat(a, 3, axis=2)
    return a[:, :, [2, 1, 0]]


def preprocess_array(data: bytes, height: int, width: int, channels: int,
                     size: int = TARGET_SIZE) -> np.ndarray:
    """I1 on one image: 3 x size x size float32, normalised."""
    rgb = to_rgb(data, height, width, channels).astype(np.float32)
    x = _bilinear(rgb, size, size) / 255.0
    x = (x - np.array(MEAN, dtype=np.float32)) / np.array(STD, dtype=np.float32)
    return np.transpose(x, (2, 0, 1)).astype(np.float32)


IMAGES_AT_ONCE = 32


# I1 / I2 ----------------------------------------------------------------------
def image_features(images: DataFrame, size: int = TARGET_SIZE,
                   model_type: str = "generic") -> DataFrame:
    """(origin, features, input_shape, model_type) for the valid images;
    the features are the preprocessed pixel values."""
    valid = images.where("valid").select(
        F.col("image.origin").alias("origin"), F.col("image.height").alias("h"),
        F.col("image.width").alias("w"), F.col("image.nChannels").alias("c"),
        F.col("image.data").alias("data"))

    def slices(batches):
        # an image's output is some 600 kB: a full Arrow batch at once would be gigabytes
        for pdf in batches:
            for i in range(0, len(pdf), IMAGES_AT_ONCE):
                yield pdf.iloc[i:i + IMAGES_AT_ONCE]

    def run(batches):
        for pdf in slices(batches):
            feats = [preprocess_array(bytes(d), int(h), int(w), int(c), size).ravel()
                     for d, h, w, c in zip(pdf["data"], pdf["h"], pdf["w"], pdf["c"])]
            yield pd.DataFrame({"origin": pdf["origin"], "features": feats,
                                "input_shape": [[3, size, size]] * len(pdf),
                                "model_type": model_type})

    return valid.mapInPandas(run, FEATURE_SCHEMA)
