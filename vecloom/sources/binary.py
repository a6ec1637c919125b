"""A Spark data source for flat binary files of vectors.

    spark.dataSource.register(BinaryVectors)
    spark.read.format("flat_vectors").option("path", "/shared/v.bin").option("dtype", "float").load()

A file is an 8-byte little-endian width and then the numbers, row by row. It is read in ranges
of rows, each by a task that seeks to its place, so that a file may be larger than a task's
memory. The path is a file or a folder of files (in order of their names) that every node can
open. Ids count from 0 over all files. A width of 0 or a ragged end raises an error.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

ROWS = 1 << 18
KINDS = {"float": ("<f4", pa.float32()), "tinyint": ("i1", pa.int8())}


class Range(InputPartition):
    def __init__(self, path: str, width: int, begin: int, end: int, start: int):
        self.path, self.width, self.begin, self.end, self.start = path, width, begin, end, start


class _Reader(DataSourceReader):
    def __init__(self, path: str, dtype: str, rows: int):
        self.path, self.dtype, self.rows = path, dtype, rows

    def partitions(self) -> list[Range]:
        size = np.dtype(KINDS[self.dtype][0]).itemsize
        files = sorted(os.path.join(self.path, f) for f in os.listdir(self.path)) if os.path.isdir(self.path) else [self.path]
        out, start = [], 0
        for f in files:
            with open(f, "rb") as h:
                width = int.from_bytes(h.read(8), "little")
            body = os.path.getsize(f) - 8
            if width < 1 or body < 0 or body % (width * size):
                raise ValueError(f"no file of vectors: {f}")
            n = body // (width * size)
            out += [Range(f, width, a, min(a + self.rows, n), start) for a in range(0, n, self.rows)]
            start += n
        return out or [Range("", 1, 0, 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if part.begin == part.end:
            return
        kind, arrow = KINDS[self.dtype]
        size = np.dtype(kind).itemsize * part.width
        with open(part.path, "rb") as h:
            h.seek(8 + part.begin * size)
            for at in range(part.begin, part.end, 16384):
                n = min(16384, part.end - at)
                flat = np.frombuffer(h.read(n * size), kind)
                vecs = pa.FixedSizeListArray.from_arrays(pa.array(flat, arrow), part.width).cast(pa.list_(arrow))
                yield pa.record_batch([pa.array(np.arange(part.start + at, part.start + at + n)), vecs], names=["id", "vec"])


class BinaryVectors(DataSource):
    """Options: ``path``, ``dtype`` (``float`` or ``tinyint``), ``rows`` (rows per task)."""

    @classmethod
    def name(cls) -> str:
        return "flat_vectors"

    def schema(self) -> str:
        return f"id long, vec array<{self.options.get('dtype', 'float')}>"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], self.options.get("dtype", "float"), int(self.options.get("rows", ROWS)))
