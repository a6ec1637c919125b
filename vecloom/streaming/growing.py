"""An index that grows from a stream while it is searched.

Every micro-batch gets contiguous ids (up to a capacity; the surplus is dropped), its elements
are appended, the graph is extended, and a new version of the index is committed by writing a
small file with its number last. Searches read the newest committed version: they never wait,
and never see half of a batch. A batch that is replayed after a failure is recognised by its
number and changes nothing. Before the first commit a search finds nothing.
"""

from __future__ import annotations

import dataclasses
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.operators.ids import numbered
from vecloom.operators.index import Index, IndexBuilder
from vecloom.operators.layered import BuildConfig


#: Versions that stay readable while newer ones are committed.
KEPT = 3


class GrowingIndex:
    """An index below ``path`` (a folder that all nodes share) with room for ``max_elements``."""

    def __init__(self, spark: SparkSession, path: str, max_elements: int, config: BuildConfig | None = None, kind: str = "angular", shards: int | None = None):
        self.spark, self.path, self.max_elements, self.kind, self.shards = spark, path.rstrip("/"), max_elements, kind, shards
        self.config = BuildConfig(**{**(config or BuildConfig()).__dict__, "expected": max_elements})

    def _fs(self):
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def state(self) -> dict:
        """The newest commit: version, elements, the batches that are in."""
        jvm, fs = self._fs()
        top = jvm.org.apache.hadoop.fs.Path(f"{self.path}/commits")
        if not fs.exists(top):
            return {"version": 0, "elements": 0, "batch": -1}
        names = [s.getPath().getName() for s in fs.listStatus(top)]
        versions = sorted(int(n) for n in names if n.isdigit())
        return json.loads(self.spark.read.text(f"{self.path}/commits/{versions[-1]}").first()[0]) if versions else {"version": 0, "elements": 0, "batch": -1}

    def _commit(self, state: dict) -> None:
        self.spark.createDataFrame([(json.dumps(state),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/commits/_{state['version']}")
        jvm, fs = self._fs()
        at = jvm.org.apache.hadoop.fs.Path
        fs.rename(at(f"{self.path}/commits/_{state['version']}"), at(f"{self.path}/commits/{state['version']}"))

    def _forget(self, version: int) -> None:
        """Removes a version that no search that began lately can still read."""
        if version > 0:
            jvm, fs = self._fs()
            for old in (f"v{version}", f"commits/{version}"):
                fs.delete(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{old}"), True)

    def insert_batch(self, vectors: DataFrame, batch: int | None = None, vec_col: str = "vec") -> DataFrame:
        """Adds the vectors and commits; ``(id, vec)`` of those that were taken."""
        state = self.state()
        empty = self.spark.createDataFrame([], "id long, vec array<float>")
        if batch is not None and batch <= state["batch"]:
            return empty
        rows = vectors.select(F.col(vec_col).cast("array<float>").alias("vec")).where("vec is not null")
        taken = numbered(rows, "id", state["elements"]).where(F.col("id") < self.max_elements).select("id", "vec")
        n = taken.count()
        next_state = {"version": state["version"] + 1, "elements": state["elements"] + n, "batch": state["batch"] if batch is None else batch}
        if n:
            old = self.snapshot()
            # what is linked stays linked: only new elements are searched for
            builder = IndexBuilder.resume(old, dataclasses.replace(self.config, reinsert=False)).append(taken) if old else IndexBuilder(taken, self.config, self.kind, shards=self.shards)
            builder.build().save(f"{self.path}/v{next_state['version']}")
            self._commit(next_state)
            self._forget(next_state["version"] - KEPT)
        elif batch is not None:
            self._commit(next_state | {"version": state["version"]} if state["version"] else next_state | {"version": 0})
        return taken

    def insert(self, vec: list[float]) -> int | None:
        """Adds one vector; its id, or None if there is no room left."""
        row = self.insert_batch(self.spark.createDataFrame([([float(v) for v in vec],)], "vec array<float>")).select("id").first()
        return row and row["id"]

    def snapshot(self) -> Index | None:
        """The newest committed version."""
        version = self.state()["version"]
        return Index.load(self.spark, f"{self.path}/v{version}") if version else None

    def search(self, queries: DataFrame, max_search: int = 200, k: int = 10, **columns) -> DataFrame:
        """As ``Index.search`` on the newest version; nothing before the first."""
        index = self.snapshot()
        if index is None:
            return self.spark.createDataFrame([], "query_id long, rank int, id long, dist double")
        return index.search(queries, max_search, k, **columns)

    def __len__(self) -> int:
        return self.state()["elements"]

    def start(self, stream: DataFrame, checkpoint: str, vec_col: str = "vec", **trigger):
        """Feeds the index from a stream; a running query."""
        return stream.writeStream.foreachBatch(lambda df, n: (self.insert_batch(df, n, vec_col), None)[1]).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def capped_ids(rows: DataFrame, start: int, capacity: int, by: str | list[str]) -> DataFrame:
    """The rows of a batch that still fit, with contiguous ids from ``start`` in the order of ``by``."""
    return numbered(rows, "id", start, by).where(F.col("id") < capacity)
