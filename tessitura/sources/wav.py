"""WAV files as a source and a sink, and discovery of files, through Spark's readers and writers."""

from __future__ import annotations

import io
import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parse_wav(data: bytes, mono: bool = False) -> tuple[int, list[list[float]]]:
    """(rate, samples of every channel) of a PCM or float RIFF file; ``mono`` keeps channel 0 only."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, rate, channels, bits, tag, body = 12, 0, 1, 16, 1, b""
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if name == b"fmt ":
            tag, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", data, at + 8)
            if tag == 0xFFFE and size >= 26:  # extensible: the format is the first field of the sub-format
                tag = struct.unpack_from("<H", data, at + 32)[0]
        elif name == b"data":
            body = data[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    step = channels * bits // 8
    body = body[: len(body) // step * step] if step else b""
    if (tag, bits) == (1, 24):
        wide = np.zeros((len(body) // 3, 4), np.uint8)
        wide[:, 1:] = np.frombuffer(body, np.uint8).reshape(-1, 3)
        flat = (wide.view("<i4")[:, 0] >> 8).astype(float)
    else:
        kind = {(1, 8): "u1", (1, 16): "<i2", (1, 32): "<i4", (3, 32): "<f4", (3, 64): "<f8"}.get((tag, bits))
        if kind is None:
            raise ValueError("unsupported sample format")
        flat = np.frombuffer(body, kind).astype(float)
    x = flat.reshape(-1, channels).T
    return rate, (x[:1] if mono else x).tolist()


def format_wav(samples: np.ndarray, rate: int, normalize: bool = False, top: float = 32767.0) -> bytes:
    """A 16-bit mono file; ``normalize`` scales the largest size to ``top``. Values are cut to whole numbers."""
    x = np.asarray(samples, float)
    if normalize and len(x) and np.abs(x).max() > 0:
        x = x / np.abs(x).max() * top
    body = np.clip(np.trunc(x), -32768, 32767).astype("<i2").tobytes()
    out = io.BytesIO()
    out.write(b"RIFF" + struct.pack("<I", 36 + len(body)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, 2 * rate, 2, 16) + b"data" + struct.pack("<I", len(body)) + body)
    return out.getvalue()


def find_files(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """(path, length) of files under a folder, at any depth, by a glob of their names; contents aren't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root).select("path", "length")


def read_wav(spark: SparkSession, root: str, pattern: str = "*.wav", mono: bool = False) -> DataFrame:
    """(signal_id, sr, channel, x array): one row a channel of every file; samples keep their file's scale."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root).select("path", "content")

    def run(batches):
        for rows in batches:
            for path, data in zip(rows["path"], rows["content"], strict=True):
                rate, channels = parse_wav(data, mono)
                yield pd.DataFrame({"signal_id": path, "sr": float(rate), "channel": range(len(channels)), "x": channels})

    return files.mapInPandas(run, "signal_id string, sr double, channel int, x array<double>")


def to_wav(arrays: DataFrame, rate: int, normalize: bool = True) -> DataFrame:
    """(signal_id, content): a WAV file for every (signal_id, x); write it with any sink, or one file a row with ``write_wav``."""

    @F.pandas_udf("binary")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: format_wav(v, rate, normalize))

    return arrays.select("signal_id", run("x").alias("content"))


def write_wav(arrays: DataFrame, folder: str, rate: int, normalize: bool = True) -> None:
    """One file a signal under a mounted folder that all executors share (a path or a file: URI), named by its id, percent-encoded.

    Files appear whole, so a task that runs twice does no harm. Other stores take the rows of ``to_wav`` through a sink of their own.
    """
    root = folder.removeprefix("file://")
    if "://" in root or root.startswith(("hdfs:", "s3")):
        raise ValueError("write_wav needs a mounted folder")

    def save(rows) -> None:
        import os
        import uuid
        from urllib.parse import quote

        os.makedirs(root, exist_ok=True)
        for row in rows:
            part = f"{root}/.{uuid.uuid4().hex}"
            with open(part, "wb") as file:
                file.write(bytes(row["content"]))
            os.replace(part, f"{root}/{quote(row['signal_id'], safe='')}.wav")

    to_wav(arrays, rate, normalize).foreachPartition(save)


def to_mono(arrays: DataFrame) -> DataFrame:
    """(signal_id, sr, x): mean over the channels of (signal_id, sr, channel, x)."""
    samples = arrays.select("signal_id", "sr", F.posexplode("x").alias("n", "x")).groupBy("signal_id", "sr", "n").agg(F.avg("x").alias("x"))
    return samples.groupBy("signal_id", "sr").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "x"))), lambda s: s["x"]).alias("x"))


def save_sounds(records: DataFrame, path: str, *partitions: str) -> None:
    """Feature records as Parquet, partitioned by columns such as the emitter or the call type."""
    records.write.mode("overwrite").partitionBy(*partitions).parquet(path)


def read_sounds(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
