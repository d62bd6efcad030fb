"""Python Data Source `safetensors`: (name, dtype, shape, values) of a file or an index of shards.

Headers are read on the driver; each tensor is one input partition, so a scan reads only the
tensors that filters on `name` leave, in parallel, and never a whole file into one task.
"""

from __future__ import annotations

import json
import math
import os
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

SIZES = {"F32": 4, "F16": 2, "BF16": 2}
SCHEMA = "name string, dtype string, shape array<int>, values array<float>"
MAX_HEADER = 100 << 20


def shard_name_ok(name: str) -> bool:
    return name not in ("", ".", "..") and "/" not in name and "\\" not in name


def widened(dtype: str, data: bytes) -> np.ndarray:
    """Little-endian F32, F16 or BF16 as float32."""
    if dtype == "F32":
        return np.frombuffer(data, "<f4").astype(np.float32)
    if dtype == "F16":
        return np.frombuffer(data, "<f2").astype(np.float32)
    if dtype == "BF16":
        return (np.frombuffer(data, "<u2").astype(np.uint32) << 16).view(np.float32)
    raise ValueError(f"dtype {dtype!r} is not supported")


def header(path: str) -> dict[str, tuple[str, list[int], int, int]]:
    """name: (dtype, shape, offset in the file, bytes), all checked against the file's size."""
    size = os.path.getsize(path)
    with open(path, "rb") as f:
        first = f.read(8)
        if len(first) < 8:
            raise ValueError(f"{path}: no header length")
        (n,) = struct.unpack("<Q", first)
        if n > min(MAX_HEADER, size - 8):
            raise ValueError(f"{path}: header of {n} bytes in a file of {size}")
        doc = json.loads(f.read(n))
    out = {}
    for name, t in doc.items():
        if name == "__metadata__" or name.endswith("position_ids"):
            continue
        dtype, shape, (a, b) = t["dtype"], [int(d) for d in t["shape"]], t["data_offsets"]
        if dtype not in SIZES:
            raise ValueError(f"{path}: {name} has dtype {dtype}")
        if not 0 <= a <= b <= size - 8 - n or min(shape, default=0) < 0 or b - a != math.prod(shape) * SIZES[dtype]:
            raise ValueError(f"{path}: {name} has offsets {a}-{b} for shape {shape}")
        out[name] = (dtype, shape, 8 + n + a, b - a)
    return out


def manifest(path: str) -> dict[str, tuple[str, str, list[int], int, int]]:
    """name: (file, dtype, shape, offset, bytes) of a file, an index, or a folder that holds either."""
    if os.path.isdir(path):
        whole, index = os.path.join(path, "model.safetensors"), os.path.join(path, "model.safetensors.index.json")
        path = whole if os.path.exists(whole) else index
    if not path.endswith(".json"):
        return {n: (path, *t) for n, t in header(path).items()}
    with open(path, encoding="utf-8") as f:
        where = json.load(f)["weight_map"]
    folder, out = os.path.dirname(path), {}
    for shard in sorted(set(where.values())):
        if not shard_name_ok(shard):
            raise ValueError(f"{path}: shard name {shard!r}")
        out |= {n: (os.path.join(folder, shard), *t) for n, t in header(os.path.join(folder, shard)).items()}
    if missing := [n for n in where if n not in out and not n.endswith("position_ids")]:
        raise ValueError(f"{path}: no tensor {missing[0]}")
    return out


class _Tensor(InputPartition):
    def __init__(self, name: str, at: tuple):
        self.name, self.at = name, at


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path, self.names = path, None

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("name",):
                self._keep({f.value})
            elif isinstance(f, In) and f.attribute == ("name",):
                self._keep(set(f.value))
            else:
                yield f

    def _keep(self, names: set) -> None:
        self.names = names if self.names is None else self.names & names

    def partitions(self):
        return [_Tensor(n, t) for n, t in manifest(self.path).items() if self.names is None or n in self.names] or [_Tensor("", ())]

    def read(self, partition: _Tensor) -> Iterator[pa.RecordBatch]:
        if not partition.at:
            return
        path, dtype, shape, offset, size = partition.at
        with open(path, "rb") as f:
            f.seek(offset)
            data = f.read(size)
        values = widened(dtype, data)
        yield pa.RecordBatch.from_arrays([pa.array([partition.name]), pa.array([dtype]), pa.array([shape], pa.list_(pa.int32())), pa.array([values], pa.list_(pa.float32()))], names=["name", "dtype", "shape", "values"])


class SafetensorsSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "safetensors"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"])


def read(spark: SparkSession, path: str) -> DataFrame:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SafetensorsSource)
    return spark.read.format("safetensors").load(path)


def write(path: str, tensors: dict[str, np.ndarray], dtype: str = "F32") -> None:
    """A file of the given tensors, through a temporary name (for tests and exports)."""
    blobs, doc, at = [], {}, 0
    for name, x in tensors.items():
        x = np.asarray(x, np.float32)
        raw = {"F32": lambda x=x: x.astype("<f4").tobytes(), "F16": lambda x=x: x.astype("<f2").tobytes(), "BF16": lambda x=x: (x.view(np.uint32) >> 16).astype("<u2").tobytes()}[dtype]()
        doc[name] = {"dtype": dtype, "shape": list(x.shape), "data_offsets": [at, at + len(raw)]}
        blobs.append(raw)
        at += len(raw)
    head = json.dumps(doc).encode()
    with open(path + ".tmp", "wb") as f:
        f.write(struct.pack("<Q", len(head)) + head + b"".join(blobs))
    os.replace(path + ".tmp", path)
