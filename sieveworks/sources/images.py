"""Image folders and archives: decoding, resampling, statistics.

Decoding uses Spark's JVM ``image`` data source (ImageIO; BGR byte order,
``height = -1`` for undecodable files); pixels are converted, resized
bicubically and scaled to ``[0, 1]`` by a pandas UDF in Arrow batches.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


FIXED_BITS = 22   # digits behind the point of the resampling weights, as 8-bit images are resampled


def bicubic(x: np.ndarray) -> np.ndarray:
    """The cubic convolution kernel with a = -1/2, of support 2."""
    x = np.abs(x)
    near = 1.5 * x ** 3 - 2.5 * x ** 2 + 1
    far = -0.5 * x ** 3 + 2.5 * x ** 2 - 4 * x + 2
    return np.where(x < 1, near, np.where(x < 2, far, 0.0))


@lru_cache(maxsize=256)
def resampling_weights(size: int, target: int) -> np.ndarray:
    """(target x size) fixed-point weights of one axis.  When the axis shrinks,
    the kernel widens by as much, so every source pixel counts."""
    scale = size / target
    wide = max(scale, 1.0)
    center = (np.arange(target)[:, None] + 0.5) * scale
    first = np.maximum(0, np.trunc(center - 2 * wide + 0.5))
    last = np.minimum(size, np.trunc(center + 2 * wide + 0.5))
    at = np.arange(size)[None, :]
    weights = np.where((at >= first) & (at < last), bicubic((at - center + 0.5) / wide), 0.0)
    weights /= weights.sum(axis=1, keepdims=True)
    return np.trunc(weights * (1 << FIXED_BITS) + np.copysign(0.5, weights)).astype(np.int64)


def resize_bicubic(img: np.ndarray, width: int, height: int) -> np.ndarray:
    """(h, w, channels) of 8 bits to (height, width, channels): one matrix
    product per axis, across and then down, each rounded to 8 bits."""
    def rounded(sums: np.ndarray) -> np.ndarray:
        return np.clip((sums + (1 << FIXED_BITS - 1)) >> FIXED_BITS, 0, 255)

    img = img.astype(np.int64)
    if img.shape[1] != width:
        img = rounded(np.einsum("ow,hwc->hoc", resampling_weights(img.shape[1], width), img, optimize=True))
    if img.shape[0] != height:
        img = rounded(np.einsum("oh,hwc->owc", resampling_weights(img.shape[0], height), img, optimize=True))
    return img


def _pixels_udf(width: int, height: int, mode: str):
    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def to_vector(h: pd.Series, w: pd.Series, c: pd.Series, data: pd.Series) -> pd.Series:
        out = []
        for hh, ww, cc, buf in zip(h, w, c, data):
            if hh is None or hh <= 0 or buf is None:
                out.append(None)
                continue
            img = np.frombuffer(buf, dtype=np.uint8).reshape(int(hh), int(ww), int(cc)).astype(np.int64)
            if cc >= 3:  # BGR(A) from the JVM decoder
                b, g, r = img[..., 0], img[..., 1], img[..., 2]
                # luma of ITU-R 601 in 16-bit fixed point
                img = (np.stack([r, g, b], axis=-1) if mode == "rgb"
                       else ((r * 19595 + g * 38470 + b * 7471 + 0x8000) >> 16)[..., None])
            elif mode == "rgb":
                img = np.repeat(img, 3, axis=-1)
            img = resize_bicubic(img, width, height)
            out.append(img.reshape(-1).astype(np.float32) / np.float32(255))
        return pd.Series(out)
    return to_vector


READ_TOGETHER = 16   # input splits that a task reads one after the other, where there are many


def fewer_tasks(files: DataFrame) -> DataFrame:
    """Spark counts 4 MB for opening a file, so a split holds a few small ones,
    and a task for each split costs more than its images.  Splits are grouped,
    without a shuffle, while every core keeps several tasks."""
    splits = files.rdd.getNumPartitions()
    most = max(4 * files.sparkSession.sparkContext.defaultParallelism, -(-splits // READ_TOGETHER))
    return files.coalesce(most) if splits > most else files


def decode_images(spark: SparkSession, path: str, width: int, height: int, mode: str = "l") -> DataFrame:
    """``(image, label, width, height, vector)`` for every image file below
    ``path``; label = parent folder; undecodable files get a null vector."""
    imgs = spark.read.format("image").option("recursiveFileLookup", True).option("dropInvalid", False).load(path)
    imgs = fewer_tasks(imgs)
    origin = F.col("image.origin")
    vec = _pixels_udf(width, height, mode)(F.col("image.height"), F.col("image.width"), F.col("image.nChannels"),
                                           F.col("image.data"))
    return imgs.select(origin.alias("image"), F.element_at(F.split(origin, "/"), -2).alias("label"),
                       F.col("image.width").alias("width"), F.col("image.height").alias("height"), vec.alias("vector"))


def decode_archives(spark: SparkSession, path: str, width: int, height: int, mode: str = "l") -> DataFrame:
    """``decode_images`` for the members of the ZIP archives below ``path``.

    The JVM decoder reads files, so tasks unpack the members once below the
    shared checkpoint directory, each under a name made from its archive and
    member path (a task that runs again writes the same files)."""
    from ..session import scratch_path
    from .readers import read_image_archive

    out_dir = scratch_path(spark, "members")

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from ..sinks.files import write_once

        for pdf in batches:
            paths = []
            for archive, image, label, content in zip(pdf["archive"], pdf["image"], pdf["label"], pdf["content"]):
                folder = hashlib.sha256(f"{archive}\0{image}".encode()).hexdigest()[:24]
                paths.append(f"{out_dir}/{folder}/{label}/{image.replace(chr(92), '/').rsplit('/', 1)[-1]}")
                write_once(paths[-1], [content])
            yield pd.DataFrame({"path": paths})

    members = read_image_archive(spark, path, with_bytes=True).filter("error IS NULL")
    if members.mapInPandas(unpack, "path string").count() == 0:
        raise ValueError(f"no images in the archives below {path}")
    return decode_images(spark, out_dir, width, height, mode)


def image_statistics(decoded: DataFrame) -> DataFrame:
    """Per image size: count; plus invalid images and distinct labels."""
    valid = F.col("height") > 0
    return decoded.agg(F.count_if(valid).alias("images"), F.count_if(~valid).alias("invalid"),
                       F.count_distinct("label").alias("labels"), F.min(F.when(valid, F.col("width"))).alias("min_width"),
                       F.max(F.when(valid, F.col("width"))).alias("max_width"),
                       F.min(F.when(valid, F.col("height"))).alias("min_height"),
                       F.max(F.when(valid, F.col("height"))).alias("max_height"))
