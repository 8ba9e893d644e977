"""Embedding whitening from an exact scatter matrix: products modulo several primes, put together by Chinese remainders."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of one modular product. With residues of at most PRIME_BITS - 1 bits either way, its sums stay under 2**53, so that doubles hold them.
BLOCK = 4096
PRIME_BITS = 21
#: Partial matrices that one task adds up.
FAN = 64


def usable(vector: Column, size: Column | int) -> Column:
    """Whether a vector has that many entries, all of them there and finite."""
    return F.coalesce((F.size(vector) == size) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def common_size(rows: DataFrame, vector: str) -> int:
    """How many entries most of the usable vectors have; of equals the larger, and 0 if there is none."""
    sizes = rows.filter(usable(F.col(vector), F.size(vector))).groupBy(F.size(vector).alias("d")).count()
    found = sizes.filter("d > 0").orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return found[0]["d"] if found else 0


def matrix(column: pa.Array, d: int) -> np.ndarray:
    """Lists of d numbers each, as rows of doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)


def primes(bound: int) -> list[int]:
    """The largest primes under 2**PRIME_BITS: so many that their product is over bound, and one more to check the result with."""
    found, product, p = [], 1, (1 << PRIME_BITS) - 1
    while product <= bound or len(found) < 2:
        if all(p % q for q in range(3, int(p**0.5) + 1, 2)):
            found.append(p)
            product *= p
        p -= 2
    while not all(p % q for q in range(3, int(p**0.5) + 1, 2)):
        p -= 2
    return [*found, p]


def whole(values: np.ndarray, scale: float, offset: int) -> np.ndarray:
    """floor(scale * c) + offset, as longs; beyond 2**60 that bound stands, so that centred numbers and their sums stay in reach."""
    return np.clip(np.floor(values * scale), -(2.0**60), 2.0**60).astype(np.int64) + offset


def _sums(d: int, scale: float, offset: int):
    """Per partition and dimension: how many rows, the sum in two halves, the least and the largest entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(d, np.int64), np.zeros(d, np.int64)
        least, most = np.full(d, np.iinfo(np.int64).max), np.full(d, np.iinfo(np.int64).min)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = whole(matrix(batch.column(0), d), scale, offset)
            n += len(x)
            high += (x >> 31).sum(axis=0)
            low += (x & 0x7FFFFFFF).sum(axis=0)
            least, most = np.minimum(least, x.min(axis=0)), np.maximum(most, x.max(axis=0))
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(d)), pa.array(np.full(d, n)), *map(pa.array, (high, low, least, most))], ["dim", "n", "high", "low", "least", "most"])

    return run


def _scatter(d: int, scale: float, offset: int, centre: np.ndarray, moduli: list[int]):
    """Per partition, prime and row of the matrix: the sums of products of centred entries modulo the prime."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros((len(moduli), d, d), np.int64)
        seen = False
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK):
                seen = True
                y = whole(matrix(batch.column(0).slice(lo, BLOCK), d), scale, offset) - centre
                for k, p in enumerate(moduli):
                    r = y % p
                    r = np.where(r > p // 2, r - p, r).astype(np.float64)
                    total[k] = (total[k] + (r.T @ r).astype(np.int64)) % p
        if seen:
            m = len(moduli)
            rows = [x.tobytes() for x in total.reshape(m * d, d)]
            part = np.full(m * d, TaskContext.get().partitionId())
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(m), d)), pa.array(np.tile(np.arange(d), m)), pa.array(part), pa.array(rows, pa.binary())], ["prime", "row", "part", "residues"])

    return run


def _added(moduli: list[int]):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        prime, row, part = (x.as_py() for x in key)
        sums = np.zeros(0, np.int64)
        for value in table.column("residues"):
            sums = (np.frombuffer(value.as_buffer(), np.int64) + (sums if len(sums) else 0)) % moduli[prime]
        return pa.table({"prime": [prime], "row": [row], "part": [part], "residues": pa.array([sums.tobytes()], pa.binary())})

    return run


def chinese(residues: np.ndarray, moduli: list[int]) -> np.ndarray:
    """The whole numbers of least size with these residues (by prime, entry); mixed radix, exact."""
    value, product = residues[0].astype(object), moduli[0]
    for r, p in zip(residues[1:], moduli[1:], strict=True):
        step = (r.astype(object) - value) * pow(product, -1, p) % p
        value, product = value + product * step, product * p
    return np.where(value > product // 2, value - product, value)


def rank(whole_matrix: np.ndarray, p: int = 2**31 - 1) -> int:
    """The rank of a matrix of whole numbers modulo a prime: never over its rank, and under it for hardly any prime."""
    a, found = (whole_matrix % p).astype(np.int64), 0
    for column in range(a.shape[1]):
        at = np.flatnonzero(a[found:, column])
        if not len(at):
            continue
        k = found + int(at[0])
        a[[found, k]] = a[[k, found]]
        a[found] = a[found] * pow(int(a[found, column]), -1, p) % p
        a[found + 1 :] = (a[found + 1 :] - a[found + 1 :, column : column + 1] * a[found]) % p
        found += 1
        if found == len(a):
            break
    return found


class Whitening:
    """What the fit gives: n, the centre (whole numbers) and the rest of the mean, unit eigenvectors and eigenvalues by falling eigenvalue, the trace."""

    def __init__(self, n: int, sums: list[int], scatter: np.ndarray, centre: np.ndarray, reach: int, keep: int):
        d = len(sums)
        self.n, self.centre, self.reach = n, centre, reach
        rest = np.array([s - n * int(c) for s, c in zip(sums, centre, strict=True)], object)
        exact = n * scatter - np.outer(rest, rest)  # n * n times the covariance
        self.rest = rest
        v = np.array([[int(x) / (n * n) for x in row] for row in exact])
        self.trace = sum(int(exact[i, i]) for i in range(d)) / (n * n)
        _, u = np.linalg.eigh(v)
        # once more in the basis found, with products in extended precision, which settles small eigenvalues next to large ones
        wide = u.astype(np.longdouble)
        inner = wide.T @ v.astype(np.longdouble) @ wide
        inner = ((inner + inner.T) / 2).astype(np.float64)
        e, turn = np.linalg.eigh(inner)
        u = (wide @ turn.astype(np.longdouble)).astype(np.float64)
        u /= np.linalg.norm(u, axis=0)
        order = np.argsort(-e, kind="stable")[: min(keep, max(rank(exact), rank(exact, 2**31 - 19)))]
        order = order[e[order] > 0]
        self.values, self.vectors = e[order], u[:, order]
        if len(order):  # the largest entry of a component is positive
            self.vectors = self.vectors * np.sign(self.vectors[np.abs(self.vectors).argmax(axis=0), np.arange(len(order))])

    def whitened(self, x: np.ndarray) -> np.ndarray:
        mean = np.array([int(r) / self.n for r in self.rest])
        return ((x - self.centre).astype(np.float64) - mean) @ self.vectors / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Of each row the sum of (n * x - S)**2, exact; None where a long can't hold it."""
        y = x - self.centre
        if len(self.rest) * (self.n * (self.reach + 1)) ** 2 < 2**63:
            z = self.n * y - self.rest.astype(np.int64)
            return (z * z).sum(axis=1).tolist()
        z = self.n * y.astype(object) - self.rest
        return [s if s < 2**63 else None for s in map(int, (z * z).sum(axis=1))]


def _moments(d: int, scale: float, offset: int, fit: Whitening):
    """Per partition: the sums of whitened values and of their products."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(fit.values)
        total = np.zeros((k + 1, k))
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK):
                w = fit.whitened(whole(matrix(batch.column(0).slice(lo, BLOCK), d), scale, offset))
                total[:k] += w.T @ w
                total[k] += w.sum(axis=0)
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(total.ravel())], ["i", "j", "s"])

    return run


def _projected(d: int, scale: float, offset: int, fit: Whitening, error: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(fit.values)
        share = fit.values / fit.trace
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK):
                part = batch.slice(lo, BLOCK)
                x = whole(matrix(part.column(1), d), scale, offset)
                m = len(x)
                each = np.repeat(np.arange(m), k)
                columns = [part.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, fit.n)), pa.array(fit.deviations(x), pa.int64()).take(pa.array(each))]
                columns += [pa.array(fit.whitened(x).ravel()), pa.array(np.tile(share, m)), pa.array(np.full(m * k, error))]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return run


def fit(vectors: DataFrame, d: int, scale: float = 64, offset: int = 1_000_000, keep: int = 32) -> Whitening | None:
    """Fits on all of vectors, whose one column holds usable vectors of d entries; None if there is none.

    One pass for sums and bounds, which say how many primes are needed; one for the products: every task makes its own
    matrix modulo each prime, and tasks of at most FAN partial matrices add them up. The driver gets sums by dimension
    and the matrices of the primes (d * d numbers each), whatever the number of rows.
    """
    told = vectors.mapInArrow(_sums(d, scale, offset), "dim long, n long, high long, low long, least long, most long")
    wide = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    told = sorted(told.groupBy("dim").agg(F.sum("n").alias("n"), wide("high"), wide("low"), F.min("least").alias("least"), F.max("most").alias("most")).collect())
    if not told:
        return None
    n, sums = told[0]["n"], [(int(r["high"]) << 31) + int(r["low"]) for r in told]
    centre = np.array([s // n for s in sums], np.int64)
    reach = max(max(r["most"] - int(c), int(c) - r["least"]) for r, c in zip(told, centre, strict=True))
    if reach >= 2**62:
        raise OverflowError("the entries are too far apart for longs")
    moduli = primes(2 * n * reach * reach)
    parts = vectors.mapInArrow(_scatter(d, scale, offset, centre, moduli), "prime long, row long, part long, residues binary")
    left = vectors.rdd.getNumPartitions()
    while True:
        left = -(-left // FAN)
        parts = parts.withColumn("part", F.floor(F.col("part") / FAN)).groupBy("prime", "row", "part").applyInArrow(_added(moduli), parts.schema)
        if left <= 1:
            break
    residues = np.zeros((len(moduli), d, d), np.int64)
    got = parts.select("prime", "row", "residues").toArrow().combine_chunks()
    for k, row, value in zip(got["prime"].to_pylist(), got["row"].to_pylist(), got["residues"].to_pylist(), strict=True):
        residues[k, row] = np.frombuffer(value, np.int64)
    scatter = chinese(residues[:-1].reshape(len(moduli) - 1, -1), moduli[:-1])
    if (scatter % moduli[-1] != residues[-1].ravel()).any():
        raise ArithmeticError("the last prime doesn't confirm the sums: the rows changed between passes")
    return Whitening(n, sums, scatter.reshape(d, d), centre, reach, keep)


def whiten(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = 64, offset: int = 1_000_000, keep: int = 32) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row per usable vector and component, at most keep of them.

    A vector is usable if it isn't null, has no null, NaN or infinite entry, and as many entries as most have; others
    are dropped. A usable vector's entries become whole numbers floor(scale * c) + offset, at most 2**60 either way
    before the offset. The covariance is worked out exactly from centred numbers (fit), the components are as many as the covariance's rank has, at most keep, and identity_error is
    measured in a pass over the whitened values themselves. deviation is null where a long can't hold it. No usable
    vector, or none that differs from the others, gives no rows; rows that repeat count and come out as often, a null
    id stays. Other columns are not looked at. rows are read four times: store them if they are dear.
    """
    spark = rows.sparkSession
    kind = f"vec_id {rows.schema[id_col].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = rows.select(F.col(id_col).alias("vec_id"), F.col(vec_col).alias("v"))
    d = common_size(rows, "v")
    if not d:
        return spark.createDataFrame([], kind)
    rows = rows.filter(usable(F.col("v"), d))
    vectors = rows.select("v")
    model = fit(vectors, d, scale, offset, keep)
    if model is None or not len(model.values):
        return spark.createDataFrame([], kind)
    k = len(model.values)
    table = np.zeros((k + 1, k))
    for r in vectors.mapInArrow(_moments(d, scale, offset, model), "i long, j long, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect():
        table[r["i"], r["j"]] = r["s"] / model.n
    error = float(np.abs(table[:k] - np.outer(table[k], table[k]) - np.eye(k)).max())
    return rows.mapInArrow(_projected(d, scale, offset, model, error), kind)
