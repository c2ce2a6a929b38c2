"""Embedding whitening: exact integer means, a second pass of centred outer products, a symmetric eigendecomposition, a broadcast projection.

Vectors are taken as integers, floor(scale * entry). The fit list is each distinct vector once. The first pass adds it up exactly in
integers; the second centres each vector before anything is multiplied, as n * x - S in integers, and adds outer products by one matrix
product a batch. Both passes leave one partial sum a task, merged by treeAggregate. LAPACK's symmetric solver runs in a task, and every row
is projected by components that are broadcast: d numbers each. A third pass over the fit list measures how far the covariance of the
whitened vectors is from the identity.

Defined results: rows without a vector, or with an entry that is null or not finite, are left out; rows that repeat are kept, and count
once in the fit. Shorter vectors count as filled with zeros. A component without variance (all vectors alike, or fewer distinct vectors than
components) has the share 0.0 and a null projection, and isn't in the error. Components of equal variance are any basis of their space. An
empty table gives no rows. A deviation that a long can't hold is null. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, discard, written
from .vectors import EXACT_DOUBLE, EXACT_LONG, is_finite, largest, matrix, scaled, widest

#: Rows in an Arrow batch: a batch of vectors is one matrix product.
BATCH = 1024
#: A variance under this share of the largest is none: it is rounding of the second pass.
NO_VARIANCE = 1e-13


@dataclass
class Whitening:
    """n distinct vectors with their sums; components as rows, their variances, the total variance; the measured error."""

    n: int
    sums: list[int]
    components: list[list[float]]
    variances: list[float]
    total: float
    error: float = 0.0
    scale: int = 256


def vectors(df: DataFrame, column: str = "embedding", scale: int = 256) -> DataFrame:
    """The rows whose vector is whole, with the vector's integers as x."""
    return df.where(is_finite(df[column])).withColumn("x", scaled(F.col(column), scale))


def _partial(df: DataFrame, width: int, add):
    """add(matrix of the fit list's vectors) summed over all of them: a numpy object, or None without rows. One partial a task; treeAggregate
    merges them, so that the driver gets a few."""
    import pickle

    def run(batches):
        import pyarrow as pa

        total = None
        for batch in batches:
            if batch.num_rows:
                part = add(matrix(batch.column("x"), width))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_pydict({"part": [pickle.dumps(total)]}, schema=pa.schema([("part", pa.binary())]))

    def merge(a, b):
        return b if a is None else a if b is None else a + b

    parts = df.select("x").mapInArrow(run, "part binary").rdd
    return parts.treeAggregate(None, lambda total, row: merge(total, pickle.loads(row["part"])), merge)


def centred(x, n: int, sums):
    """n * x - S of each row, exactly: longs, or Python integers where longs can't hold them."""
    import numpy as np

    if n * (largest(x) + max(map(abs, sums), default=0) // max(n, 1) + 1) < EXACT_LONG:
        return x * n - np.array(sums, "i8")
    return x.astype(object) * n - np.array(sums, object)


def _sum(x):
    """Count and sums of a matrix's rows as Python integers, which hold any sum."""
    import numpy as np

    exact = x.sum(0) if largest(x) * max(1, len(x)) < EXACT_LONG else x.astype(object).sum(0)
    return np.array([len(x), *map(int, exact)], object)


def fit(df: DataFrame, components: int = 4, column: str = "embedding", scale: int = 256) -> Whitening | None:
    """The whitening of a table's distinct vectors; None without any."""
    import numpy as np

    whole = vectors(df, column, scale).select("x")
    width = widest(whole, "x")
    distinct = written(whole.select(F.concat("x", F.array_repeat(F.lit(0).cast("long"), width - F.size("x"))).alias("x")).distinct(), "vectors", BATCH)
    first = _partial(distinct, width, _sum)
    if first is None:
        discard(distinct)
        return None
    n, sums = int(first[0]), [int(s) for s in first[1:]]

    def outer(x):
        y = centred(x, n, sums).astype("f8") / n
        return y.T @ y

    covariance = _partial(distinct, width, outer) / n
    values, rows = _eigen(distinct.sparkSession, covariance, min(components, width))
    total = float(np.trace(covariance))
    model = Whitening(n, sums, rows, [v if v > NO_VARIANCE * values[0] and v > 0 else 0.0 for v in values], total, 0.0, scale)
    some = [k for k, v in enumerate(model.variances) if v]
    if some:
        def spread(x):
            z = project(model, x)[:, some]
            return z.T @ z

        model.error = float(np.abs(_partial(distinct, width, spread) / n - np.eye(len(some))).max())
    discard(distinct)
    return model


def _eigen(spark, covariance, most: int) -> tuple[list[float], list[list[float]]]:
    """The largest eigenvalues, falling, and their unit eigenvectors, the largest entry of each positive. Solved in a task, whose BLAS has
    one thread: a threaded solver beside the driver's JVM may hang."""
    if not len(covariance):
        return [], []
    sent = spark.sparkContext.broadcast(covariance)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for _ in batches:
            values, columns = np.linalg.eigh(sent.value)
            made = []
            for k in range(len(values) - 1, len(values) - 1 - most, -1):
                row = columns[:, k]
                made.append((len(made), float(values[k]), (row * (1 if row[np.abs(row).argmax()] >= 0 else -1)).tolist()))
            schema = pa.schema([("k", pa.int32()), ("value", pa.float64()), ("row", pa.list_(pa.float64()))])
            yield from batches_of(iter(made), schema)

    got = sorted(spark.range(0, 1, 1, 1).mapInArrow(run, "k int, value double, row array<double>").collect())
    sent.unpersist()
    return [max(0.0, r["value"]) for r in got], [r["row"] for r in got]


def project(model: Whitening, x, y=None):
    """The whitened coordinates of integer vectors; nan for components without variance."""
    import numpy as np

    y = centred(x, model.n, model.sums) if y is None else y
    deviations = np.array([v**0.5 if v else np.nan for v in model.variances])
    return (y.astype("f8") / model.n) @ np.array(model.components).reshape(len(model.variances), x.shape[1]).T / deviations


def squares(y) -> list[int]:
    """The sum of squares of each row of integers, exactly."""
    most = largest(y)
    if most * most * max(1, y.shape[1]) < EXACT_DOUBLE * 512:  # under 2^62
        return (y * y).sum(1).tolist()
    return [sum(int(v) ** 2 for v in row) for row in y.tolist()]


def whiten(df: DataFrame, model: Whitening | None, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error): a row for each whole vector and component. Narrow."""
    import pyarrow as pa

    ddl = f"`{key}` long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    spark = df.sparkSession
    if model is None:
        return spark.createDataFrame([], ddl)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH))
    sent = spark.sparkContext.broadcast(model)
    schema = pa.schema([(key, pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())])

    def run(batches):
        import numpy as np

        m = sent.value
        k = len(m.variances)
        shares = [v / m.total if m.total else 0.0 for v in m.variances]
        for batch in batches:
            rows = batch.num_rows
            if not rows or not k:
                continue
            x = matrix(batch.column("x"), len(m.sums))
            y = centred(x, m.n, m.sums)
            z = project(m, x, y).ravel()
            own = [v if v < 1 << 63 else None for v in squares(y)]
            cells = [
                pa.array(np.repeat(batch.column("k").to_numpy(zero_copy_only=False), k)) if not batch.column("k").null_count else pa.array([v for v in batch.column("k").to_pylist() for _ in range(k)], pa.int64()),
                pa.array(np.tile(np.arange(1, k + 1, dtype="i4"), rows)), pa.array(np.full(rows * k, m.n, "i8")), pa.array([v for v in own for _ in range(k)], pa.int64()),
                pa.array(z, mask=np.isnan(z)), pa.array(np.tile(np.array(shares), rows)), pa.array(np.full(rows * k, m.error)),
            ]
            yield pa.RecordBatch.from_arrays(cells, schema=schema)

    return vectors(df, column, model.scale).select(F.col(key).cast("long").alias("k"), "x").mapInArrow(run, ddl)
