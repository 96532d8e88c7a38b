"""Scan cleanup over image tables (Spark's image source layout, BGR byte order)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Luminance weights, contrast and cut-offs.
RED, GREEN, BLUE = 0.299, 0.587, 0.114
CONTRAST, MIDDLE = 1.45, 128.0
BLACK_UP_TO, WHITE_FROM = 92.0, 188.0

#: Pixels whose planes are in memory at a time.
BLOCK = 1 << 19


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Decoded images: origin, height, width, nChannels, mode, data."""
    return spark.read.format("image").option("dropInvalid", "true").load(path).select("image.*")


def _clean(data: np.ndarray, channels: int) -> np.ndarray:
    """Whole pixels of one block, as bytes of gray."""
    pixels = data.reshape(-1, channels).astype(np.float64)
    gray = pixels[:, 0] if channels == 1 else pixels[:, 2] * RED + pixels[:, 1] * GREEN + pixels[:, 0] * BLUE
    sharp = np.clip((gray - MIDDLE) * CONTRAST + MIDDLE, 0.0, 255.0)
    return np.rint(np.where(sharp <= BLACK_UP_TO, 0.0, np.where(sharp >= WHITE_FROM, 255.0, sharp))).astype(np.uint8)


def _cleaned(data: pa.Scalar, height: int, width: int, channels: int) -> pa.Array:
    """The gray raster, made ``BLOCK`` pixels at a time."""
    source = np.frombuffer(data.as_buffer(), np.uint8, count=height * width * channels)
    gray = np.empty(height * width, np.uint8)
    for at in range(0, len(gray), BLOCK):
        gray[at : at + BLOCK] = _clean(source[at * channels : (at + BLOCK) * channels], channels)
    offsets = pa.py_buffer(np.array([0, len(gray)], np.int32))
    return pa.Array.from_buffers(pa.binary(), 1, [None, offsets, pa.py_buffer(gray)])


def scan_cleanup(images: DataFrame) -> DataFrame:
    """Gray, contrast-stretched, thresholded copies; one byte per pixel in ``gray``.

    Each raster is read where it lies in its Arrow batch and leaves in a batch of its own, so beside the batches a task
    holds one gray copy and the planes of one block. ``spark.sql.execution.arrow.maxBytesPerBatch`` bounds what arrives at once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heights, widths, channels = (batch.column(k).to_pylist() for k in (1, 2, 3))
            for n in range(batch.num_rows):
                row = [batch.column(k).slice(n, 1) for k in range(3)]
                gray = _cleaned(batch.column(4)[n], heights[n], widths[n], channels[n])
                yield pa.RecordBatch.from_arrays([*row, gray], names=["origin", "height", "width", "gray"])

    columns = images.select("origin", F.col("height").cast("int").alias("height"), F.col("width").cast("int").alias("width"), "nChannels", "data")
    return columns.mapInArrow(run, "origin string, height int, width int, gray binary")
