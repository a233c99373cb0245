"""Contract queries of the image operators (S13, I1, I2): the numbers of each
embedding are written as the pixels of a grey PNG file, as given tables hold no
images, and every tenth file is cut short; the files are then scanned and
prepared by the library."""

from __future__ import annotations

import struct
import zlib

from pyspark.sql import functions as F

from ..session import shared_dir
from ..sources import images, sinks
from ..tables import table
from .common import register

SIDE, SIZE = 8, 16
_PIXEL = "((floor(v::DOUBLE * 1000)::BIGINT % 256) + 256) % 256"


def _png(pixels: list[int]) -> bytes:
    """A grey 8-bit PNG of SIDE by SIDE pixels."""
    rows = b"".join(b"\x00" + bytes(pixels[i:i + SIDE]) for i in range(0, SIDE * SIDE, SIDE))
    out = b"\x89PNG\r\n\x1a\n"
    for kind, data in ((b"IHDR", struct.pack(">IIBBBBB", SIDE, SIDE, 8, 0, 0, 0, 0)), (b"IDAT", zlib.compress(rows)), (b"IEND", b"")):
        out += struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return out


def _scanned(spark, sf):
    """The image rows of the files with the vec_id of each."""
    def files(batches):
        import pyarrow as pa
        for b in batches:
            data = [_png(p) for p in b.column(1).to_pylist()]
            data = [d[:40] if i % 10 == 0 else d for i, d in zip(b.column(0).to_pylist(), data)]
            yield pa.RecordBatch.from_arrays([pa.array([f"{i}.png" for i in b.column(0).to_pylist()]), pa.array(data, pa.binary())],
                                             ["name", "content"])

    first = F.slice("embedding", 1, SIDE * SIDE)
    pixels = F.transform(first, lambda v: F.pmod(F.floor(v.cast("double") * 1000).cast("long"), F.lit(256)).cast("int"))
    png = (table(spark, sf, "embeddings").where(F.size("embedding") >= SIDE * SIDE).select("vec_id", pixels.alias("pixels"))
           .mapInArrow(files, "name string, content binary"))
    path = sinks.write_item_files(png, shared_dir(spark, "images"), "name", "content")
    return images.read_images(spark, path, recursive=True)


def _id(origin: str):
    return F.regexp_extract(origin, r"/([0-9]+)\.png$", 1).cast("bigint").alias("vec_id")


# S13 ------------------------------------------------------------------------
@register("image_scan", f"""
select vec_id, vec_id % 10 <> 0 as valid, case when vec_id % 10 <> 0 then {SIDE} else -1 end as height,
  case when vec_id % 10 <> 0 then 1 else -1 end as n_channels
from embeddings where len(embedding) >= {SIDE * SIDE}
""")
def image_scan(spark, sf):
    scanned = _scanned(spark, sf)
    return scanned.select(_id("image.origin"), "valid", F.col("image.height").alias("height"), F.col("image.nChannels").alias("n_channels"))


# A feature is (pixel / 255 - mean) / std; taken back to sixteenths of a pixel it is a whole number -------
@register("image_features", f"""
with e as (select vec_id, list_transform(embedding[1:{SIDE * SIDE}], lambda v: {_PIXEL}) as p from embeddings
    where len(embedding) >= {SIDE * SIDE} and vec_id % 10 <> 0),
 -- place o of {SIZE} lies a quarter before or after the middle of place o // 2 of {SIDE}
 o as (select o, greatest((o - 1) // 2, 0) as a, least((o + 1) // 2, {SIDE - 1}) as b,
        case when o = 0 or o = {SIZE - 1} then 4 when o % 2 = 1 then 3 else 1 end as wa from range({SIZE}) r(o)),
 g as (select vec_id, y.o as y, x.o as x,
    y.wa * (x.wa * p[y.a * {SIDE} + x.a + 1] + (4 - x.wa) * p[y.a * {SIDE} + x.b + 1])
    + (4 - y.wa) * (x.wa * p[y.b * {SIDE} + x.a + 1] + (4 - x.wa) * p[y.b * {SIDE} + x.b + 1]) as s
  from e, o y, o x),
 t as (select vec_id, list(s::INT order by y, x) as s, avg(s) / 16 / 255 as m from g group by vec_id)
select vec_id, '[3,{SIZE},{SIZE}]' as input_shape, 'generic' as model_type,
  '[' || array_to_string(s, ',') || ']' as red, '[' || array_to_string(s, ',') || ']' as blue,
  round(((m - 0.485) / 0.229 + (m - 0.456) / 0.224 + (m - 0.406) / 0.225) / 3, 3) as mean_feature
from t
""")
def image_features(spark, sf):
    scanned = _scanned(spark, sf)
    f = images.image_features(scanned, size=SIZE)
    n = SIZE * SIZE

    def back(channel: int):
        part = F.slice("features", channel * n + 1, n)
        whole = F.transform(part, lambda v: F.round((v.cast("double") * images.STD[channel] + images.MEAN[channel]) * 255 * 16).cast("int"))
        return F.concat(F.lit("["), F.array_join(whole, ","), F.lit("]"))

    mean = F.aggregate("features", F.lit(0.0), lambda a, v: a + v.cast("double")) / F.size("features")
    return f.select(_id("origin"), F.concat(F.lit("["), F.array_join("input_shape", ","), F.lit("]")).alias("input_shape"), "model_type",
                    back(0).alias("red"), back(2).alias("blue"), F.round(mean, 3).alias("mean_feature"))
