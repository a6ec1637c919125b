"""Packed graphs of index files: codecs, and a Spark data source that reads such a file in ranges of nodes.

    spark.dataSource.register(PackedGraph)
    spark.read.format("packed_graph").option("path", "/shared/index").option("tag", "...").load()

The file: a header of 1,024 bytes (a tag, then JSON padded with blanks: ``num_layers``,
``layer_counts``, ``layer_sizes`` in bytes), then the layers. A layer: the length of its offsets
in bytes (8 bytes), the offsets in chunks of 128 bytes (an initial offset of 8 bytes and 60
differences of 2 bytes each, all ones where there is none), then the encoded lists. A list: its
length (1 byte), then the differences of its sorted numbers, in the variable-byte form (2 bits of
length for each number, four to a byte, then the bytes; at least four numbers, filled up with
zeros) where that is shorter, else as 4 bytes each. All numbers are little-endian.

A tag or counts that do not fit raise an error. A file without layers gives no rows. Lists may
be empty; more than 255 numbers in one, or differences of offsets above 65,534, cannot be written.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Fixed values of the format.
HEADER, CHUNK_OFFSETS, FEWEST, LONGEST, UNUSED = 1024, 60, 4, 255, 0xFFFF

_CHUNK = np.dtype([("initial", "<u8"), ("deltas", "<u2", CHUNK_OFFSETS)])
#: Nodes that one task reads: whole chunks.
NODES = CHUNK_OFFSETS * 2048


def pack_ints(values: np.ndarray, width: int) -> bytes:
    """Whole numbers from 0 in ``width`` bytes each; too large ones raise an error."""
    values = np.asarray(values, "<u8")
    if len(values) and int(values.max()) >> (8 * width):
        raise ValueError(f"a number needs more than {width} bytes")
    return values.view("u1").reshape(-1, 8)[:, :width].tobytes()


def unpack_ints(data: bytes, width: int) -> np.ndarray:
    """The numbers of ``pack_ints``; a ragged end raises an error."""
    if len(data) % width:
        raise ValueError("length is no multiple of the width")
    out = np.zeros((len(data) // width, 8), "u1")
    out[:, :width] = np.frombuffer(data, "u1").reshape(-1, width)
    return out.view("<u8").ravel()


def variable_bytes(values: np.ndarray) -> bytes:
    """Numbers below 2^32 in one to four bytes each, after their lengths."""
    values = np.asarray(values, "<u4")
    length = 1 + (values > 0xFF).astype("u1") + (values > 0xFFFF) + (values > 0xFFFFFF)
    codes = np.zeros(-(-len(values) // 4) * 4, "u1")
    codes[: len(values)] = length - 1
    control = (codes.reshape(-1, 4) << np.array([0, 2, 4, 6], "u1")).sum(1, dtype="u1")
    held = np.arange(4) < length[:, None]
    return control.tobytes() + values.view("u1").reshape(-1, 4)[held].tobytes()


def from_variable_bytes(data: bytes, count: int) -> np.ndarray:
    """``count`` numbers of ``variable_bytes``."""
    control = np.frombuffer(data, "u1", -(-count // 4))
    length = 1 + ((control[:, None] >> np.array([0, 2, 4, 6], "u1")) & 3).ravel()[:count]
    body = np.frombuffer(data, "u1", offset=len(control))
    if len(body) != int(length.sum()):
        raise ValueError("no list of numbers")
    out = np.zeros((count, 4), "u1")
    out[np.arange(4) < length[:, None]] = body
    return out.view("<u4").ravel()


def pack_set(numbers: Sequence[int]) -> bytes:
    """A list of numbers, in order of size."""
    ordered = np.sort(np.asarray(numbers, "<u4"))
    if len(ordered) > LONGEST:
        raise ValueError(f"more than {LONGEST} numbers in a list")
    deltas = np.diff(ordered, prepend=np.uint32(0)).astype("<u4")
    short = variable_bytes(np.pad(deltas, (0, max(0, FEWEST - len(deltas)))))
    return bytes([len(deltas)]) + (short if len(short) < 4 * len(deltas) else deltas.tobytes())


def unpack_set(data: bytes) -> np.ndarray:
    count, body = data[0], data[1:]
    deltas = np.frombuffer(body, "<u4") if len(body) == 4 * count else from_variable_bytes(body, max(FEWEST, count))[:count]
    return np.cumsum(deltas, dtype="u4")


def pack_offsets(offsets: np.ndarray) -> bytes:
    """Rising offsets in chunks."""
    offsets = np.asarray(offsets, "i8")
    chunks = np.zeros(max(1, -(-len(offsets) // CHUNK_OFFSETS)), _CHUNK)
    chunks["deltas"] = UNUSED
    for i in range(len(chunks)):
        own = offsets[i * CHUNK_OFFSETS : (i + 1) * CHUNK_OFFSETS]
        if not len(own):
            continue
        chunks["initial"][i] = own[0] if i else 0
        deltas = np.diff(own, prepend=own[0] if i else 0)
        if deltas.min() < 0 or deltas.max() >= UNUSED:
            raise ValueError("offsets fall, or are too far apart")
        chunks["deltas"][i, : len(own)] = deltas
    return chunks.tobytes()


def unpack_offsets(data: bytes) -> np.ndarray:
    chunks = np.frombuffer(data, _CHUNK)
    return (chunks["initial"][:, None].astype("i8") + np.cumsum(chunks["deltas"].astype("i8"), axis=1))[chunks["deltas"] != UNUSED]


def _layer(lists: Sequence[Sequence[int]]) -> bytes:
    packed = [pack_set(some) for some in lists]
    ends = np.concatenate([[0], np.cumsum([len(p) for p in packed], dtype="i8")])
    room = _CHUNK.itemsize * (1 + len(lists) // CHUNK_OFFSETS)
    offsets = pack_offsets(ends)
    return room.to_bytes(8, "little") + offsets.ljust(room, b"\xff") + b"".join(packed)


def write_packed(path: str, layers: Sequence[Sequence[Sequence[int]]], tag: str, **more) -> None:
    """Writes a file of layers, each a list of lists of neighbours; ``more`` goes into the header. For graphs that one process can hold."""
    blobs = [_layer(layer) for layer in layers]
    about = {"num_elements": len(layers[-1]) if layers else 0, "num_layers": len(layers), "layer_counts": [len(layer) for layer in layers], "layer_sizes": [len(b) for b in blobs], **more}
    header = (tag + json.dumps(about)).encode()
    if len(header) > HEADER:
        raise ValueError("the header is too long")
    with open(path, "wb") as f:
        f.write(header.ljust(HEADER))
        for b in blobs:
            f.write(b)


def read_header(file: BinaryIO, tag: str | None = None) -> dict:
    """The header's JSON; the tag before it must be ``tag``, if that is given."""
    found, _, body = file.read(HEADER).decode("utf-8", "replace").partition("{")
    if not body or (tag is not None and found != tag):
        raise ValueError("no packed graph: the tag is missing")
    about = json.loads("{" + body)
    if about["num_layers"] != len(about["layer_counts"]) or len(about["layer_sizes"]) != about["num_layers"]:
        raise ValueError("the header does not fit its layers")
    return about


def from_bytes(data: bytes, tag: str | None = None) -> list[list[np.ndarray]]:
    """The layers of a file that is in memory."""
    import io

    file = io.BytesIO(data)
    about, at, out = read_header(file, tag), HEADER, []
    for count, size in zip(about["layer_counts"], about["layer_sizes"]):
        out.append([unpack_set(d) for _, d in _lists(file, at, 0, count)])
        at += size
    return out


def _lists(file: BinaryIO, at: int, begin: int, end: int) -> Iterator[tuple[int, bytes]]:
    """The encoded lists of nodes ``begin`` (the first of a chunk) to ``end`` of the layer at byte ``at``."""
    if begin >= end:
        return
    file.seek(at)
    room = int.from_bytes(file.read(8), "little")
    file.seek(at + 8 + begin // CHUNK_OFFSETS * _CHUNK.itemsize)
    last = min(room // _CHUNK.itemsize, end // CHUNK_OFFSETS + 1)  # the end of the last list may be in the next chunk
    offsets = unpack_offsets(file.read((last - begin // CHUNK_OFFSETS) * _CHUNK.itemsize))[: end - begin + 1]
    file.seek(at + 8 + room + int(offsets[0]))
    body = file.read(int(offsets[-1] - offsets[0]))
    cuts = (offsets - offsets[0]).tolist()
    for i, (a, z) in enumerate(zip(cuts[:-1], cuts[1:])):
        yield begin + i, body[a:z]


class _Range(InputPartition):
    def __init__(self, layer: int, at: int, begin: int, end: int):
        self.layer, self.at, self.begin, self.end = layer, at, begin, end


class _Reader(DataSourceReader):
    def __init__(self, path: str, tag: str | None, nodes: int):
        self.path, self.tag, self.nodes = path, tag, max(1, nodes // CHUNK_OFFSETS) * CHUNK_OFFSETS

    def partitions(self) -> list[_Range]:
        out, at = [], HEADER
        with open(self.path, "rb") as f:
            about = read_header(f, self.tag)
        for layer, (count, size) in enumerate(zip(about["layer_counts"], about["layer_sizes"])):
            out += [_Range(layer, at, a, min(a + self.nodes, count)) for a in range(0, count, self.nodes)]
            at += size
        return out or [_Range(0, HEADER, 0, 0)]

    def read(self, part: _Range) -> Iterator[pa.RecordBatch]:
        with open(self.path, "rb") as f:
            rows = [(i, unpack_set(d)) for i, d in _lists(f, part.at, part.begin, part.end)]
        for a in range(0, len(rows), 8192):
            some = rows[a : a + 8192]
            offsets = np.concatenate([[0], np.cumsum([len(r) for _, r in some])]).astype("i4")
            flat = np.concatenate([r for _, r in some]).astype("i8")
            n = len(some)
            yield pa.record_batch([pa.array(np.zeros(n, "i4")), pa.array(np.full(n, part.layer, "i4")), pa.array(np.array([i for i, _ in some], "i8")), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["shard", "layer", "node", "neighbors"])


class PackedGraph(DataSource):
    """Options: ``path`` (a file that every node can open), ``tag`` (what the file must begin with), ``nodes`` (per task)."""

    @classmethod
    def name(cls) -> str:
        return "packed_graph"

    def schema(self) -> str:
        return "shard int, layer int, node long, neighbors array<long>"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], self.options.get("tag"), int(self.options.get("nodes", NODES)))
