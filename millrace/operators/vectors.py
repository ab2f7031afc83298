"""Nearest-neighbour and range joins of vectors by cosine similarity: exact, or through an index."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from millrace.plans import fresh, merge_columns

#: Most values (vectors times dimensions) and most rows of the probe side that go to the executors at once.
MOST_VALUES, MOST_PROBES = 32_000_000, 10_000
#: Most similarities that a task works out at once.
MOST_SIMILARITIES = 4_000_000


def _matrix(col: pa.Array) -> np.ndarray:
    """Rows scaled to length 1; a zero vector stays zero, so its similarity is 0."""
    flat = col.flatten().to_numpy(zero_copy_only=False).astype("float64")
    m = flat.reshape(len(col), -1) if len(col) else flat.reshape(0, 0)
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def vector_join(
    stream: DataFrame, probe: DataFrame, *, left: str, right: str, k: int | None = 1, least: float | None = None, suffix: str = "_probe", index: VectorIndex | None = None
) -> DataFrame:
    """For every probe row the ``k`` most similar stream rows, or with ``k=None`` all of similarity ``least`` or more.

    Result: stream columns, probe columns (a clash gets ``suffix``), ``similarity`` and, with
    ``k``, ``rank`` from 1.  Equal similarities are ranked by the stream's other columns in
    order.  Rows with a null vector match nothing; probe rows that are alike each have their own
    results.  The probe side is read in blocks of bounded size, a scan of the stream each; a task
    keeps ``k`` rows per probe of the block, so the final ranking sees at most tasks x k rows per
    probe.  With ``index`` only the cells nearest to a probe are compared: ``stream`` must be what
    ``index.assign`` returned.
    """
    if (k is None) == (least is None):
        raise ValueError("give k or least")
    spark = stream.sparkSession
    shown = [c for c in stream.columns if index is None or c != index.cell]
    s = stream.filter(F.col(left).isNotNull())
    p = probe.filter(F.col(right).isNotNull())
    names = merge_columns(shown, probe.columns, suffix)
    others = [c for c in shown if c != left]
    if k is not None and others:  # the earlier of two equal rows stays
        s = s.sortWithinPartitions(*others)
    number = fresh("probe", shown, list(names.values()))
    schema = T.StructType([*[stream.schema[c] for c in shown], *[T.StructField(names[f.name], f.dataType) for f in probe.schema.fields], T.StructField("similarity", T.DoubleType()), T.StructField(number, T.LongType())])
    parts, first = [], 0
    for table in _blocks(p, right):
        rows = table.num_rows
        allowed = None if index is None else index.cells_of(_matrix(table.column(right).combine_chunks()))
        block = spark.sparkContext.broadcast((table, allowed))

        def best(batches: Iterator[pa.RecordBatch], block=block, first=first, step=max(1, MOST_SIMILARITIES // rows)) -> Iterator[pa.RecordBatch]:
            table, allowed = block.value
            q = _matrix(table.column(right).combine_chunks())
            kept = _Best(k or 0, len(q))
            for b in batches:
                for start in range(0, b.num_rows, step):
                    part = pa.Table.from_batches([b.slice(start, step)])
                    for rows, mine in _groups(part, allowed, VectorIndex.cell, len(q)):
                        sim = _matrix(rows.column(left).combine_chunks()) @ q[mine].T
                        rows = rows.select(shown)
                        if k is None:
                            i, j = np.nonzero(sim >= least)
                            yield from _pairs(rows, table, i, mine[j], sim[i, j], [f.name for f in schema.fields], first)
                        else:
                            kept.add(rows, sim, mine)
            if kept.rows is not None:
                n, j = np.nonzero(kept.ref >= 0)
                yield from _pairs(kept.rows, table, kept.ref[n, j], j, kept.sim[n, j], [f.name for f in schema.fields], first)

        parts.append(s.mapInArrow(best, schema))
        first += rows
    out = reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)
    if k is None:
        return out.drop(number)
    order = Window.partitionBy(number).orderBy(F.desc("similarity"), *others)
    return out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).drop(number)


def _blocks(probe: DataFrame, vector: str) -> Iterator[pa.Table]:
    """The rows of the probe side in tables of bounded size; one is on the driver at a time."""
    schema = to_arrow_schema(probe.schema)
    rows: list[dict] = []
    for r in probe.toLocalIterator():
        rows.append(r.asDict(recursive=True))
        if len(rows) >= MOST_PROBES or len(rows) * len(r[vector]) >= MOST_VALUES:
            yield pa.Table.from_pylist(rows, schema=schema)
            rows = []
    if rows:
        yield pa.Table.from_pylist(rows, schema=schema)


def _groups(rows: pa.Table, allowed: np.ndarray | None, cell: str | None, probes: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows with the probes that they are compared with: all, or those that look into the rows' cell."""
    if allowed is None:
        yield rows, np.arange(probes)
        return
    cells = rows.column(cell).to_numpy()
    for c in np.unique(cells).tolist():
        mine = np.flatnonzero(allowed[c])
        if len(mine):
            yield rows.filter(pa.array(cells == c)), mine


class _Best:
    """The best ``k`` rows of every probe; of equally similar ones the first that came."""

    def __init__(self, k: int, probes: int) -> None:
        self.k = k
        self.sim, self.ref = np.full((k, probes), -np.inf), np.full((k, probes), -1, dtype=np.int64)
        self.rows: pa.Table | None = None

    def add(self, rows: pa.Table, sim: np.ndarray, mine: np.ndarray) -> None:
        have = self.rows.num_rows if self.rows is not None else 0
        place = _top(sim, self.k)
        new = np.take_along_axis(sim, place, axis=0)
        sims, refs = np.concatenate([self.sim[:, mine], new]), np.concatenate([self.ref[:, mine], place + have])
        order = np.argsort(-sims, axis=0, kind="stable")[: self.k]
        self.sim[:, mine], self.ref[:, mine] = np.take_along_axis(sims, order, axis=0), np.take_along_axis(refs, order, axis=0)
        need, at = np.unique(self.ref, return_inverse=True)
        at = at.reshape(self.ref.shape)
        gone = int(need[0] == -1)
        both = rows if self.rows is None else pa.concat_tables([self.rows, rows])
        self.rows, self.ref = both.take(pa.array(need[gone:])).combine_chunks(), at - gone


def _top(sim: np.ndarray, k: int) -> np.ndarray:
    """Rows of the ``k`` greatest of each column, greatest first, of equal ones the first."""
    if len(sim) > 4 * k:
        edge = np.partition(sim, len(sim) - k, axis=0)[len(sim) - k]
        some = np.flatnonzero((sim >= edge).any(axis=1))
        return some[np.argsort(-sim[some], axis=0, kind="stable")[:k]]
    return np.argsort(-sim, axis=0, kind="stable")[:k]


class VectorIndex:
    """An inverted-file index: every row is in the cell of the nearest of some centroids, a search looks into a few cells.

    Centroids and the number of cells to look into are found on a sample of at most
    ``sample_rows`` rows; every row is indexed.  The number is the least that reaches ``target``
    recall for the rows of the sample.
    """

    cell = "__cell"

    def __init__(self, centroids: np.ndarray, looks: int) -> None:
        self.centroids, self.looks = centroids, looks

    @classmethod
    def fit(cls, df: DataFrame, column: str, *, cells: int | None = None, sample_rows: int = 20_000, k: int = 10, target: float = 0.97, seed: int = 5) -> VectorIndex:
        # the rows of the least hashes: the same sample whatever the partitions
        sample = df.filter(F.col(column).isNotNull()).select(column).orderBy(F.xxhash64(F.lit(seed), column)).limit(sample_rows).toArrow().column(column).combine_chunks()
        m = _matrix(sample)
        if not len(m):
            return cls(np.zeros((1, 0)), 1)
        rng = np.random.default_rng(seed)
        cells = max(1, min(len(m), cells or int(np.sqrt(len(m)))))
        centroids = m[rng.choice(len(m), cells, replace=False)]
        for _ in range(12):
            of = (m @ centroids.T).argmax(axis=1)
            total = np.zeros_like(centroids)
            np.add.at(total, of, m)
            filled = np.bincount(of, minlength=cells) > 0
            centroids = np.where(filled[:, None], total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-300), centroids)
        of = (m @ centroids.T).argmax(axis=1)
        asked = rng.choice(len(m), min(len(m), 300), replace=False)
        near = _top((m[asked] @ m.T).T, min(k, len(m)))
        ranked = np.argsort(np.argsort(-(m[asked] @ centroids.T), axis=1), axis=1)
        deep = np.sort(ranked[np.arange(len(asked))[None, :], of[near]].ravel())
        return cls(centroids, int(deep[min(len(deep) - 1, int(np.ceil(target * len(deep))))]) + 1)

    def cells_of(self, vectors: np.ndarray) -> np.ndarray:
        """Which (cell, probe) are compared."""
        if not self.centroids.size:  # an index of no rows
            return np.ones((1, len(vectors)), dtype=bool)
        sim = vectors @ self.centroids.T
        allowed = np.zeros(sim.T.shape, dtype=bool)
        nearest = np.argsort(-sim, axis=1, kind="stable")[:, : self.looks]
        allowed[nearest.T, np.arange(len(vectors))[None, :]] = True
        return allowed

    def assign(self, df: DataFrame, column: str) -> DataFrame:
        """Every row with its cell; rows with a null vector are left out.  Write it partitioned or sorted by the cell to keep it."""
        centroids = df.sparkSession.sparkContext.broadcast(self.centroids)
        at = df.columns.index(column)

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    of = (_matrix(b.column(at)) @ centroids.value.T).argmax(axis=1)
                    yield pa.record_batch([*b.columns, pa.array(of, pa.int64())], names=[*b.schema.names, VectorIndex.cell])

        return df.filter(F.col(column).isNotNull()).mapInArrow(place, T.StructType([*df.schema.fields, T.StructField(self.cell, T.LongType())]))


def _pairs(rows: pa.Table, probes: pa.Table, i: np.ndarray, j: np.ndarray, sim: np.ndarray, names: list[str], first: int) -> Iterator[pa.RecordBatch]:
    if len(i):
        left, right = rows.take(pa.array(i)), probes.take(pa.array(j))
        cols = [*left.columns, *right.columns, pa.chunked_array([pa.array(sim)]), pa.chunked_array([pa.array(np.asarray(j, dtype=np.int64) + first)])]
        yield from pa.table(cols, names=names).combine_chunks().to_batches()
