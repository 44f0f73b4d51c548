"""Suite: image archives and folders rendered from the ``embeddings`` table.

Each 64-value embedding becomes an 8×8 grayscale PNG (values quantised from
[-0.5, 0.5] to 0..255) in a folder named after its label, written by the
tasks below the shared checkpoint directory, then read back through the
archive reader and the JVM image decoder.
"""

from __future__ import annotations

import io
import struct
import zipfile
import zlib
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from ..sources import images as IM
from ..sources.readers import read_image_archive
from .common import table
from .registry import register

def png_gray(pixels: np.ndarray) -> bytes:
    """Encode a 2-D uint8 array as an 8-bit grayscale PNG."""
    h, w = pixels.shape
    raw = b"".join(b"\x00" + pixels[r].astype(np.uint8).tobytes() for r in range(h))

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data) & 0xFFFFFFFF)

    return (b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0))
            + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def quantize(vector: Column, lo: float, hi: float) -> Column:
    """``floor(clamp((x - lo) / (hi - lo), 0, 1) · 255 + 0.5)`` per element."""
    span = float(hi - lo)
    return F.transform(vector, lambda x: F.floor(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (x - lo) / span)) * 255
                                                 + 0.5).cast("int"))


def _fs(path: str):
    from ..sinks.files import filesystem_for

    return filesystem_for(path)


def write_image_folders(df: DataFrame, out_dir: str, id_col: str, label_col: str, pixels_col: str,
                        width: int, height: int) -> DataFrame:
    """One PNG per row at ``out_dir/<label>/<id>.png``; returns the written paths."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        filesystem, base = _fs(out_dir)
        made: set[str] = set()
        for pdf in batches:
            paths = []
            for ident, label, px in zip(pdf[id_col], pdf[label_col], pdf[pixels_col]):
                folder = f"{base}/{label}"
                if folder not in made:
                    filesystem.create_dir(folder, recursive=True)
                    made.add(folder)
                p = f"{folder}/{ident}.png"
                with filesystem.open_output_stream(p) as out:
                    out.write(png_gray(np.asarray(px, dtype=np.uint8).reshape(height, width)))
                paths.append(p)
            yield pd.DataFrame({"path": paths})
    return df.select(id_col, label_col, pixels_col).mapInPandas(run, "path string")


def write_image_archives(df: DataFrame, out_dir: str, id_col: str, label_col: str, pixels_col: str,
                         width: int, height: int) -> DataFrame:
    """One ZIP per task with members ``<label>/<id>.png``; returns archive paths."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        from ..sinks.files import write_once

        buf = io.BytesIO()
        n = 0
        with zipfile.ZipFile(buf, "w", zipfile.ZIP_STORED) as zf:
            for pdf in batches:
                for ident, label, px in zip(pdf[id_col], pdf[label_col], pdf[pixels_col]):
                    zf.writestr(f"{label}/{ident}.png", png_gray(np.asarray(px, dtype=np.uint8).reshape(height, width)))
                    n += 1
        if n:
            p = f"{out_dir.rstrip('/')}/part-{TaskContext.get().partitionId():05d}.zip"
            write_once(p, [buf.getvalue()])
            yield pd.DataFrame({"path": [p]})
    return df.select(id_col, label_col, pixels_col).mapInPandas(run, "path string")


_Q = ("CAST(floor(least(1.0, greatest(0.0, (CAST(x AS DOUBLE) + 0.5) / 1.0)) * 255 + 0.5) AS BIGINT)")


def _pixels(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select("vec_id", F.col("label").cast("string").alias("label"),
                    quantize(F.col("embedding"), -0.5, 0.5).alias("px"))


@register("read_image_archive", "SELECT CAST(label AS VARCHAR) || '/' || CAST(vec_id AS VARCHAR) || '.png' AS image, "
                                "CAST(label AS VARCHAR) AS label FROM embeddings")
def q_read_image_archive(spark, sf):
    out = scratch_path(spark, "zips")
    write_image_archives(_pixels(spark, sf), out, "vec_id", "label", "px", 8, 8).count()
    return read_image_archive(spark, out).select("image", "label")


def _decoded(spark, sf):
    out = scratch_path(spark, "pngs")
    write_image_folders(_pixels(spark, sf), out, "vec_id", "label", "px", 8, 8).count()
    return IM.decode_images(spark, out, 8, 8, "l")


@register("decode_images", "SELECT CAST(label AS VARCHAR) AS label, vec_id, CAST(sum(" + _Q + ") AS BIGINT) AS "
                           "pixel_sum FROM (SELECT label, vec_id, unnest(embedding) AS x FROM embeddings) "
                           "GROUP BY label, vec_id")
def q_decode_images(spark, sf):
    d = _decoded(spark, sf)
    total = F.aggregate(F.transform("vector", lambda v: F.round(v * 255).cast("long")), F.lit(0).cast("long"),
                        lambda a, v: a + v)
    return d.select("label", F.regexp_extract("image", "/([0-9]+)\\.png$", 1).cast("long").alias("vec_id"),
                    total.alias("pixel_sum"))


@register("decode_archives", "SELECT CAST(label AS VARCHAR) AS label, vec_id, CAST(sum(" + _Q + ") AS BIGINT) AS "
                             "pixel_sum FROM (SELECT label, vec_id, unnest(embedding) AS x FROM embeddings) "
                             "GROUP BY label, vec_id")
def q_decode_archives(spark, sf):
    out = scratch_path(spark, "zips")
    write_image_archives(_pixels(spark, sf), out, "vec_id", "label", "px", 8, 8).count()
    d = IM.decode_archives(spark, out, 8, 8)
    total = F.aggregate(F.transform("vector", lambda v: F.round(v * 255).cast("long")), F.lit(0).cast("long"),
                        lambda a, v: a + v)
    return d.select("label", F.regexp_extract("image", "/([0-9]+)\\.png$", 1).cast("long").alias("vec_id"),
                    total.alias("pixel_sum"))


@register("image_statistics", "SELECT count(*) AS images, CAST(0 AS BIGINT) AS invalid, count(DISTINCT label) AS "
                              "labels, 8 AS min_width, 8 AS max_width, 8 AS min_height, 8 AS max_height FROM embeddings")
def q_image_statistics(spark, sf):
    return IM.image_statistics(_decoded(spark, sf))


def _axis_sql(name: str, size: int, target: int) -> str:
    """CTE of the fixed-point bicubic weights (o, i, k) of one axis."""
    wide = max(size / target, 1.0)
    center = f"(o + 0.5) * {size} / {target}.0"
    return (f"{name} AS (SELECT o, i, trunc(w / sum(w) OVER (PARTITION BY o) * 4194304 + 0.5 * sign(w)) AS k FROM ("
            f"SELECT o, i, CASE WHEN a < 1 THEN 1.5 * a ^ 3 - 2.5 * a ^ 2 + 1 WHEN a < 2 THEN "
            f"-0.5 * a ^ 3 + 2.5 * a ^ 2 - 4 * a + 2 ELSE 0 END AS w FROM (SELECT o, i, abs((i - {center} + 0.5) / {wide}) "
            f"AS a FROM range({target}) t(o), range({size}) u(i) WHERE i >= greatest(0, trunc({center} - {2 * wide} + 0.5)) "
            f"AND i < least({size}, trunc({center} + {2 * wide} + 0.5)))))")


def _pass_sql(rows: str, axis: str, into: str, by: str, rest: str) -> str:
    return (f"{into} AS (SELECT label, vec_id, {rest}, o AS {by}, least(255, greatest(0, floor((sum(v * k) + 2097152) / "
            f"4194304))) AS v FROM {rows} JOIN {axis} ON {axis}.i = {rows}.{by} GROUP BY label, vec_id, {rest}, o)")


@register("decode_images_resized", "WITH " + _axis_sql("wx", 8, 5) + ", " + _axis_sql("wy", 8, 11) + ", "
          "e AS (SELECT label, vec_id, unnest(embedding) AS x, unnest(range(64)) AS p FROM embeddings), "
          "px AS (SELECT label, vec_id, p // 8 AS y, p % 8 AS x, " + _Q + " AS v FROM e), "
          + _pass_sql("px", "wx", "across", "x", "y") + ", " + _pass_sql("across", "wy", "down", "y", "x") +
          " SELECT CAST(label AS VARCHAR) AS label, vec_id, string_agg(v::INT::VARCHAR, ',' ORDER BY y, x) AS pixels "
          "FROM down GROUP BY label, vec_id")
def q_decode_images_resized(spark, sf):
    """Narrower and taller: one axis shrinks, the other grows."""
    out = scratch_path(spark, "pngs")
    write_image_folders(_pixels(spark, sf), out, "vec_id", "label", "px", 8, 8).count()
    d = IM.decode_images(spark, out, 5, 11, "l")
    return d.select("label", F.regexp_extract("image", "/([0-9]+)\\.png$", 1).cast("long").alias("vec_id"),
                    F.array_join(F.transform("vector", lambda v: F.round(v * 255).cast("int").cast("string")), ",")
                    .alias("pixels"))
