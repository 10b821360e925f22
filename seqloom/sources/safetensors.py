"""Tensor files: a header of names, kinds, shapes and places, then the numbers.

A file is eight bytes with the header's length (little-endian), the header as
JSON, and the tensors' bytes one after the other.  A file is read in one task, as
Spark's binary reader gives it whole; rows of tensors come out in batches.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: The kinds of numbers in such files, as NumPy names them; BF16 is handled apart.
KINDS = {"F64": "<f8", "F32": "<f4", "F16": "<f2", "I64": "<i8", "I32": "<i4", "I16": "<i2", "I8": "i1", "U8": "u1", "BOOL": "?"}


def parse(data: bytes | memoryview) -> dict[str, np.ndarray]:
    """Tensors by name; BF16 comes as 32-bit numbers."""
    size = int.from_bytes(data[:8], "little")
    header = json.loads(bytes(data[8 : 8 + size]))
    out = {}
    for name, what in header.items():
        if name == "__metadata__":
            continue
        lo, hi = what["data_offsets"]
        raw = data[8 + size + lo : 8 + size + hi]
        if what["dtype"] == "BF16":
            flat = (np.frombuffer(raw, "<u2").astype(np.uint32) << 16).view(np.float32)
        else:
            flat = np.frombuffer(raw, KINDS[what["dtype"]])
        out[name] = flat.reshape(what["shape"])
    return out


def encode(tensors: dict[str, np.ndarray]) -> bytes:
    """A file's bytes, tensors in the order given."""
    names = {np.dtype(v): k for k, v in KINDS.items()}
    header, parts, at = {}, [], 0
    for name, x in tensors.items():
        raw = np.ascontiguousarray(x).tobytes()
        header[name] = {"dtype": names[x.dtype], "shape": list(x.shape), "data_offsets": [at, at + len(raw)]}
        parts.append(raw)
        at += len(raw)
    text = json.dumps(header).encode()
    text += b" " * (-len(text) % 8)
    return len(text).to_bytes(8, "little") + text + b"".join(parts)


def read(spark: SparkSession, path: str, batch: int = 1024) -> DataFrame:
    """(file, tensor, at, x): a row for each place along all axes but the last."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                for name, x in parse(memoryview(data.as_buffer())).items():
                    flat = x.reshape(-1, x.shape[-1] if x.ndim else 1).astype(float)
                    for lo in range(0, len(flat), batch):
                        part = flat[lo : lo + batch]
                        offsets = np.arange(len(part) + 1, dtype=np.int32) * part.shape[1]
                        yield pa.RecordBatch.from_arrays(
                            [pa.repeat(file, len(part)), pa.repeat(name, len(part)), pa.array(np.arange(lo, lo + len(part))), pa.ListArray.from_arrays(pa.array(offsets), pa.array(part.ravel()))], ["file", "tensor", "at", "x"]
                        )

    files = spark.read.format("binaryFile").load(path).selectExpr("_metadata.file_name", "content")
    return files.mapInArrow(rows, "file string, tensor string, at long, x array<double>")


def encoded(df: DataFrame, key: str, at: str, x: str, tensor: str = "embeddings") -> DataFrame:
    """(key, content): for each key the bytes of a file with one tensor, the rows in
    the order of ``at``.  One file is made in one task, as it is read in one."""
    import pandas as pd

    kind = df.schema[key].dataType.simpleString()

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(at)
        content = encode({tensor: np.array(rows[x].tolist(), np.float32)})
        return pd.DataFrame({key: [rows[key].iloc[0]], "content": [content]})

    return df.select(key, at, x).groupBy(key).applyInPandas(one, f"{key} {kind}, content binary")
