"""Fixed-record binary vector files: a 64-byte header, then one record per object.

Header: magic PSBD, version f32, then header size, record length, vector
dimension, format, dummy, min and max as u64. A record of 0xFF bytes throughout
is absent. Formats 1 and 2 are 32 and 64 bit floats, 6 is 64 bit integers.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_FORMATS = {1: "<f4", 2: "<f8", 6: "<u8"}
HEADER = struct.Struct("<4sf7Q")


def pack(vectors: dict[int, list[float]], dim: int, fmt: int = 1) -> bytes:
    """The bytes of a file; objects that aren't given are absent."""
    kind = np.dtype(_FORMATS[fmt])
    n = max(vectors, default=-1) + 1
    body = np.full((n, kind.itemsize * dim), 0xFF, np.uint8)
    for i, v in vectors.items():
        body[i] = np.asarray(v, kind).view(np.uint8)
    return HEADER.pack(b"PSBD", 1.0, HEADER.size, kind.itemsize * dim, dim, fmt, 0, 0, 0).ljust(64, b"\0") + body.tobytes()


def unpack(content: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(indices, vectors) of the records that are present."""
    magic, _, start, length, dim, fmt, *_ = HEADER.unpack_from(content)
    if magic != b"PSBD":
        raise ValueError("not a vector file")
    if fmt not in _FORMATS:
        raise ValueError(f"format {fmt} is not supported")
    rows = np.frombuffer(content, np.uint8, offset=start)
    rows = rows[: len(rows) // length * length].reshape(-1, length)
    have = np.flatnonzero((rows != 0xFF).any(1))
    return have, np.ascontiguousarray(rows[have]).view(_FORMATS[fmt]).reshape(len(have), dim).astype(np.float64)


def read(spark: SparkSession, path: str) -> DataFrame:
    """feature (the file's name), object_idx, vec; one task a file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column("path").to_pylist(), b.column("content")):
                idx, vec = unpack(content.as_py())
                feature = name.rsplit("/", 1)[-1].rsplit(".", 1)[0]
                for k in range(0, len(idx), 4096):
                    v = vec[k : k + 4096]
                    yield pa.RecordBatch.from_arrays([pa.array([feature] * len(v)), pa.array(idx[k : k + 4096]), pa.array(v.tolist(), pa.list_(pa.float64()))], ["feature", "object_idx", "vec"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "feature string, object_idx long, vec array<double>")
