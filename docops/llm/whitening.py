"""Whitening of embeddings by shifted CholeskyQR.

Entries become integers, so counts and sums are exact.  A pass over the rows gives every partition's Gram matrix of
centred rows after triangular solves with the factor found so far; its Cholesky factor multiplies that factor.  The
first pass is shifted, so that it can't fail on nearly dependent columns, and passes go on until the solved rows are
orthonormal.  The singular values of the composed factor R then give the components: V = R'R / n.

What reaches the driver is sums by dimension and one matrix of dimension x dimension a pass, however many rows there
are; partial matrices are added on the executors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries of the rows that are worked on at once, the largest dimension (its matrix is 128 MB), most passes.
ENTRIES, LARGEST, PASSES = 1 << 21, 4096, 8
#: Groups in which partial matrices are added first.
GROUPS = 64
PARTIAL = "i int, part int, row array<double>"
_U = np.finfo(float).eps / 2


@dataclass
class Whitening:
    """n and S (exact), components as columns by falling eigenvalue, eigenvalues, their shares of the trace."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    eigenvalues: np.ndarray
    explained: np.ndarray
    passes: int


def scaled(values: np.ndarray, scale: int, offset: int) -> np.ndarray:
    x = np.floor(scale * values.astype(np.float64))
    if len(x) and np.abs(x).max() >= 2.0**62:
        raise OverflowError("an entry does not fit a 64-bit integer")
    return x.astype(np.int64) + offset


def _vectors(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """By length of vector: places in the batch, and the vectors' entries as a matrix."""
    lengths = np.diff(column.offsets.to_numpy())
    flat, begin = column.flatten().to_numpy(zero_copy_only=False), np.cumsum(lengths) - lengths
    for d in np.unique(lengths[lengths > 0]).tolist():
        at = np.flatnonzero(lengths == d)
        step = max(1, ENTRIES // d)
        for i in range(0, len(at), step):
            part = at[i : i + step]
            yield part, flat[begin[part][:, None] + np.arange(d)]


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v) of the rows whose vector is there and holds finite entries only."""
    bad = F.exists(vec_col, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return df.where(F.col(vec_col).isNotNull()).where(~bad).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))


def _sums(rows: DataFrame, scale: int, offset: int) -> list:
    """(d, i, n, s): by length of vector and dimension, exact.  Rows of the driver: lengths x dimensions."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for b in batches:
            for _, m in _vectors(b["v"]):
                x = scaled(m, scale, offset)
                if float(np.abs(x).max()) * len(x) >= 2.0**62:
                    raise OverflowError("a sum of entries does not fit a 64-bit integer")
                got = total.setdefault(x.shape[1], [0, [0] * x.shape[1]])
                got[0] += len(x)
                got[1] = [a + b for a, b in zip(got[1], x.sum(0).tolist())]
        for d, (n, s) in total.items():
            yield pa.RecordBatch.from_pydict({"d": pa.array([d] * d, pa.int32()), "i": pa.array(range(d), pa.int32()), "n": pa.array([n] * d, pa.int64()), "s": pa.array(s, pa.int64())})

    parts = rows.select("v").mapInArrow(step, "d int, i int, n long, s long")
    return parts.groupBy("d", "i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - S, exact."""
    if float(np.abs(x).max(initial=0)) * n >= 2.0**62:
        raise OverflowError("n * x does not fit a 64-bit integer")
    return n * x - sums


def _added(parts: DataFrame, d: int) -> np.ndarray:
    """Partial matrices, of which each task gave its rows (i, part, row), added by row in two steps."""

    def add(t: pa.Table) -> pa.Table:
        rows = t["row"].combine_chunks()
        total = rows.flatten().to_numpy().reshape(len(t), -1).sum(0)
        return pa.table({"i": t["i"].slice(0, 1), "row": pa.array([total], pa.list_(pa.float64()))})

    out = np.zeros((d, d))
    few = parts.groupBy("i", F.col("part") % GROUPS).applyInArrow(add, "i int, row array<double>")
    for r in few.groupBy("i").applyInArrow(add, "i int, row array<double>").collect():  # d rows
        out[r.i] = r.row
    return out


def _by_row(matrix: np.ndarray) -> pa.RecordBatch:
    from pyspark import TaskContext

    part = [TaskContext.get().partitionId()] * len(matrix)
    return pa.RecordBatch.from_pydict({"i": pa.array(range(len(matrix)), pa.int32()), "part": pa.array(part, pa.int32()), "row": pa.array(list(matrix), pa.list_(pa.float64()))})


def _gram(rows: DataFrame, n: int, sums: np.ndarray, factor: np.ndarray | None, scale: int, offset: int) -> np.ndarray:
    """Q'Q for the Q that solves Q R = centred rows, R being the factor so far, or for the centred rows."""
    d = len(sums)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for b in batches:
            for _, m in _vectors(b["v"]):
                if m.shape[1] == d:
                    y = centred(scaled(m, scale, offset), n, sums) / n
                    q = y if factor is None else np.linalg.solve(factor.T, y.T).T
                    total += q.T @ q
        yield _by_row(total)

    return _added(rows.select("v").mapInArrow(step, PARTIAL), d)


def semidefinite_cholesky(g: np.ndarray) -> np.ndarray:
    """Upper R with R'R = g; where no more than rounding is left of a pivot, its row is zero."""
    g, r = g.copy(), np.zeros_like(g)
    least = len(g) * _U * 4 * max(float(np.diag(g).max(initial=0)), 0.0)
    for k in range(len(g)):
        if g[k, k] > least:
            r[k, k:] = g[k, k:] / np.sqrt(g[k, k])
            g[k + 1 :, k + 1 :] -= np.outer(r[k, k + 1 :], r[k, k + 1 :])
    return r


def fit(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 1024, offset: int = 100_000) -> Whitening | None:
    """The whitening of all usable rows of ``df``; None if there are none.

    The dimension is that of most vectors (of equally many, the larger); vectors of another length take no part.
    """
    rows = usable(df, id_col, vec_col)
    by: dict[int, list] = {}
    for r in _sums(rows, scale, offset):
        by.setdefault(r.d, []).append(r)
    if not by:
        return None
    d = max(by, key=lambda k: (by[k][0].n, k))
    if d > LARGEST:
        raise ValueError(f"vectors have {d} entries, more than {LARGEST}")
    n, sums = by[d][0].n, np.array([r.s for r in sorted(by[d], key=lambda r: r.i)], np.int64)

    gram = _gram(rows, n, sums, None, scale, offset)
    size = float(np.trace(gram))
    # as large as rounding may make the smallest eigenvalue of a Gram matrix that is added up block by block
    shift = 11 * _U * d * (d + 1 + ENTRIES // d) * size
    whole = np.linalg.cholesky(gram + shift * np.eye(d)).T if size else np.eye(d)
    passes = 1
    while size and passes < PASSES:
        gram = _gram(rows, n, sums, whole, scale, offset)
        passes += 1
        # the columns are orthonormal, but for those that others determine, which are zero
        done = np.abs(gram @ gram - gram).max() < 1e-9
        try:
            factor = np.linalg.cholesky(gram).T
        except np.linalg.LinAlgError:
            factor = semidefinite_cholesky(gram) if done else np.linalg.cholesky(gram + 11 * _U * d * (d + 1) * np.trace(gram) * np.eye(d)).T
        whole = factor @ whole
        if done:
            break
    _, values, right = np.linalg.svd(whole if size else np.zeros((d, d)))
    components = right.T * np.where(right[np.arange(d), np.abs(right).argmax(1)] < 0, -1.0, 1.0)  # the sign is free: the largest entry is positive
    eigenvalues = values**2 / n
    total = eigenvalues.sum()
    return Whitening(n, sums, components, eigenvalues, eigenvalues / total if total else eigenvalues, passes)


def _rank(model: Whitening, k: int) -> int:
    """Components to give: those with some variance, k at most."""
    return int((model.eigenvalues[:k] > len(model.sums) * _U * 4 * model.eigenvalues[0]).sum()) if len(model.eigenvalues) else 0


def identity_error(df: DataFrame, model: Whitening, k: int = 8, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 1024, offset: int = 100_000) -> float | None:
    """The largest absolute entry of the whitened rows' covariance minus the identity, from a pass over the rows."""
    n, sums, k = model.n, model.sums, _rank(model, k)
    if not k:
        return None
    turn = model.components[:, :k] / np.sqrt(model.eigenvalues[:k])

    def pass_over(centre: np.ndarray, last) -> np.ndarray:
        def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = 0.0
            for b in batches:
                for _, m in _vectors(b["v"]):
                    if m.shape[1] == len(sums):
                        total = total + last((centred(scaled(m, scale, offset), n, sums) / n) @ turn - centre)
            yield _by_row(np.zeros((k, k)) + total)

        return _added(usable(df, id_col, vec_col).select("v").mapInArrow(step, PARTIAL), k) / n

    centre = pass_over(np.zeros(k), lambda w: w.sum(0))[0]  # rounding alone keeps it from 0
    return float(np.abs(pass_over(centre, lambda w: w.T @ w) - np.eye(k)).max())


def whitened(df: DataFrame, model: Whitening | None, k: int = 8, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 1024, offset: int = 100_000) -> DataFrame:
    """(id, whitened array<double>, deviation long) of every usable row: its first k components, and sum((n*x - S)^2).

    Rows whose vector is null, empty, of another length than the model's or holds null or non-finite entries are left
    out; rows without an id stay (id null) and repeated rows are whitened alike; an empty table gives an empty result;
    other columns are ignored.  Of a table with fewer than k dimensions of variance there are as many components as
    have some: none, if all vectors are equal.  Integers that do not fit 64 bits raise an error.
    """
    schema = "id long, whitened array<double>, deviation long"
    if model is None:
        return df.sparkSession.createDataFrame([], schema)
    n, sums, k = model.n, model.sums, _rank(model, k)
    turn = model.components[:, :k] / np.sqrt(model.eigenvalues[:k])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, m in _vectors(b["v"]):
                if m.shape[1] == len(sums):
                    y = centred(scaled(m, scale, offset), n, sums)
                    if (y.astype(float) ** 2).sum(1).max() >= 2.0**62:
                        raise OverflowError("a deviation does not fit a 64-bit integer")
                    w = (y / n) @ turn
                    rows = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * k, pa.int32()), pa.array(w.ravel()))
                    yield pa.RecordBatch.from_arrays([b["id"].take(pa.array(at)), rows, pa.array((y * y).sum(1))], ["id", "whitened", "deviation"])

    return usable(df, id_col, vec_col).mapInArrow(step, schema)


def whiten(df: DataFrame, k: int = 8) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row a vector and component."""
    model = fit(df)
    shares = [float(x) for x in model.explained[: _rank(model, k)]] if model else []
    error = identity_error(df, model, k) if model else None
    rows = whitened(df, model, k).select("id", "deviation", F.posexplode("whitened").alias("place", "value"))
    explained = F.get(F.array(*[F.lit(x) for x in shares] or [F.lit(None).cast("double")]), F.col("place"))
    return rows.select(
        F.col("id").alias("vec_id"), (F.col("place") + 1).cast("int").alias("component"), F.lit(model.n if model else 0).cast("long").alias("n"), "deviation", F.col("value").alias("whitened"), explained.alias("explained"), F.lit(error).cast("double").alias("identity_error")
    )
