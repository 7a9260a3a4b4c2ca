"""Embedding whitening: singular value decompositions of partitions, merged up a tree without losing a dimension."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from falloff.llm.common import cut

#: States that one task merges.
FAN = 16
_STATE = "node long, n long, sums binary, values binary, vectors binary"


@dataclass
class State:
    """Rows seen: how many, their sums, and singular values and right vectors of the rows less their mean."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @property
    def mean(self) -> np.ndarray:
        return self.sums / self.n

    @staticmethod
    def of(x: np.ndarray) -> State:
        sums = x.sum(axis=0)
        _, s, v = np.linalg.svd(x - sums / len(x), full_matrices=False)
        return State(len(x), sums, s, v)

    def merged(self, other: State) -> State:
        """Both sets of rows: their weighted vectors and one row that corrects for the difference of the means, decomposed again."""
        n = self.n + other.n
        shift = np.sqrt(self.n / n * other.n) * (self.mean - other.mean)
        rows = np.vstack([self.values[:, None] * self.vectors, other.values[:, None] * other.vectors, shift])
        _, s, v = np.linalg.svd(rows, full_matrices=False)
        return State(n, self.sums + other.sums, s, v)

    def row(self, node: int) -> dict:
        return {"node": node, "n": self.n, "sums": self.sums.tobytes(), "values": self.values.tobytes(), "vectors": self.vectors.tobytes()}

    @staticmethod
    def read(row, whole: bool) -> State:
        values = np.frombuffer(row["values"])
        return State(int(row["n"]), np.frombuffer(row["sums"], dtype=np.int64 if whole else np.float64), values, np.frombuffer(row["vectors"]).reshape(len(values), -1))


def _matrix(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def decompose(vectors: DataFrame, width: int, whole: bool, also=None) -> State | None:
    """The state of all rows of ``vectors`` (vector: arrays of ``width`` finite numbers); null if there are none.

    Each partition of the input keeps one state (width x width doubles), batches being merged into it as they come; states meet
    ``FAN`` at a time, so neither a task nor the driver ever holds more than a few of them. ``also`` is applied to a batch first.
    """

    def partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch, width)
                new = State.of(x if also is None else also(x))
                state = new if state is None else state.merged(new)
        if state is not None:
            yield pa.RecordBatch.from_pylist([state.row(TaskContext.get().partitionId())], schema=pa.schema([("node", pa.int64()), ("n", pa.int64()), ("sums", pa.binary()), ("values", pa.binary()), ("vectors", pa.binary())]))

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        states = [State.read(r, whole) for r in rows.sort_values("node").to_dict("records")]
        while len(states) > 1:
            states = [a.merged(b) for a, b in zip(states[::2], states[1::2], strict=False)] + states[len(states) & ~1 :]
        return pd.DataFrame([states[0].row(int(rows["node"].min()) // FAN)])

    states = cut(vectors.select("vector").mapInArrow(partition, _STATE), "whitening-states")
    most = states.agg(F.max("node")).first()[0]
    while most is not None and most > 0:
        states, most = states.groupBy(F.floor(F.col("node") / FAN).alias("_to")).applyInPandas(meet, _STATE), most // FAN
    found = None if most is None else states.first()
    return found and State.read(found, whole)


def usable(vector: Column) -> Column:
    """Whether a vector is there and holds finite numbers only."""
    bad = lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf"))
    return vector.isNotNull() & ~F.exists(vector, bad)


def whiten(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", most: int = 8) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error): every usable vector along the first ``most`` components.

    Components are the right singular vectors of all rows less their mean, from hierarchical merges (``decompose``), numbered
    from 1 by falling eigenvalue of the covariance with divisor n; whitened is the projection over the root of the eigenvalue,
    explained the eigenvalue's share of the trace. identity_error is the largest difference between the covariance of the whitened rows,
    found the same way, and the identity. deviation is the exact sum of (n * x - sum)^2 over the dimensions for vectors of whole
    numbers; null for others, and where it exceeds a long.

    Vectors that are null or hold null or non-finite entries are dropped, and so are those whose length is not the commonest (the greater
    of equals). A direction without variance (under 1e-24 of the largest eigenvalue) has no component, so a single vector or
    equal vectors give no rows, as an empty table does. Repeated rows count and return as often as they stand there; a null id stays
    null. Other columns are ignored, whatever their names. The model that tasks get has ``most`` + 1 vectors.
    """
    rows = vectors.select(F.col(id).alias("id"), F.col(vector).alias("vector")).where(usable(F.col("vector")))
    widths = rows.groupBy(F.size("vector").alias("w")).count().orderBy(F.desc("count"), F.desc("w")).first()
    kind = rows.schema["vector"].dataType.elementType.typeName()
    whole = kind in ("byte", "short", "integer", "long")
    rows = rows.select("id", F.col("vector").cast("array<long>" if whole else "array<double>"))
    id_type = vectors.schema[id].dataType.simpleString()
    schema = f"`{id}` {id_type}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if widths is None or widths["w"] == 0:
        return vectors.sparkSession.createDataFrame([], schema)
    width = widths["w"]
    rows = rows.where(F.size("vector") == width)
    state = decompose(rows, width, whole)
    energy = state.values**2
    k = int((energy[:most] > 1e-24 * energy[0]).sum()) if energy[0] > 0 else 0
    if not k:
        return vectors.sparkSession.createDataFrame([], schema)
    n, sums, mean = state.n, state.sums, state.mean
    onto = (state.vectors[:k] / np.sqrt(energy[:k] / n)[:, None]).T
    explained = energy[:k] / energy.sum()
    white = decompose(rows, width, False, lambda x: (x - mean) @ onto)
    error = float(np.abs((white.vectors.T * white.values**2) @ white.vectors / n - np.eye(k)).max())

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch, width)
            y = (x - mean) @ onto
            deviation = pa.nulls(len(x) * k, pa.int64())
            if whole:
                about = (((x - mean) * float(n)) ** 2).sum(axis=1)
                exact = ((n * x - sums) ** 2).sum(axis=1)
                deviation = pa.array(np.repeat(exact, k), mask=np.repeat(about > 9.2e18, k))
            times = lambda v, kind: pa.array(np.tile(v, len(x)), kind)  # noqa: E731, B023
            back = pa.array(np.repeat(np.arange(len(x)), k))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(back), times(np.arange(1, k + 1), pa.int32()), times([n], pa.int64()).take(back), deviation, pa.array(y.ravel()), times(explained, pa.float64()), times([error], pa.float64()).take(back)],
                names=[id, "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(project, schema)
