"""Embedding whitening by Chebyshev-filtered subspace iteration.

Every entry c becomes the integer x = floor(256 c). The fit list has each distinct x vector once, n of them.
Components are unit eigenvectors of the fit list's covariance V (divisor n), by falling eigenvalue; a row's
whitened coordinate is its centred vector along the component, over the eigenvalue's root.

V itself is never formed. A *pass* sums (x - mean)(x - mean)'Q over the fit list, Q being a block of a few more
columns than components wanted: tasks multiply batches, Spark adds their sums up, and d times the block's
columns reach the driver. A round is a polynomial of V applied to the block by the three-term recurrence of
Chebyshev polynomials, a pass a degree, which damps eigenvalues between 0 and the block's smallest Ritz value
and lets those above grow; then QR and Rayleigh-Ritz. Ritz vectors whose residual |Vq - eq| is certified
(``TOLERANCE`` times its eigenvalue, or what sums of doubles allow) are locked and taken out of the block, from the first on. The
degree is kept so low that the block's leading vector doesn't drown the others. Where rounds no longer help,
the block doubles, up to all dimensions, where Rayleigh-Ritz is exact; so the search always ends.

Defined results: rows go whose vector is null, empty, or holds null, NaN or infinite entries, or entries
beyond 2**54 (their x has no place in a long's sums); so do vectors of another length than most (equally many:
the longer ones). A null vec_id, repeated ids and repeated rows are rows like others. Components whose
eigenvalue is zero (one distinct vector, say) don't exist and have no rows. Equal eigenvalues give any
orthonormal axes of their space. A deviation that exceeds a long is null. An empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklens.llm.common import stage, table

SCALE = 256
#: Residual, over the eigenvalue, at which a component is certified; what counts as zero beside the largest eigenvalue.
TOLERANCE, ZERO = 1e-13, 1e-12
#: Columns of a block beyond those wanted, highest degree of a filter, largest growth within one filter.
EXTRA, DEGREE, GROWTH = 12, 10, 1e8
#: Rounds without halving the residual after which the block doubles, or, where the residual is this small beside the
#: largest eigenvalue, no more can be had from doubles.
PATIENCE, SETTLED = 3, 1e-11


def integer_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, x): rows that can be whitened."""
    able = F.forall("embedding", lambda c: c.isNotNull() & (F.abs(c.cast("double")) < float(1 << 54)))  # false for NaN, too
    rows = vectors.where(able).select("vec_id", F.transform("embedding", lambda c: F.floor(c.cast("double") * SCALE)).alias("x"))
    usual = rows.groupBy(F.size("x").alias("d")).count().where("d > 0").orderBy(F.desc("count"), F.desc("d")).first()
    return rows.where(F.size("x") == (usual.d if usual else -1))


def fit_list(rows: DataFrame) -> DataFrame:
    """Each distinct x once; copies combine before they are shuffled."""
    return stage(rows.select("x").distinct(), "fit-list")


def _matrix(column):
    import numpy as np

    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1).astype(np.int64, copy=False)


def sums(fit: DataFrame) -> tuple[int, list[int]]:
    """(n, S), exactly."""

    def part(batches):
        from decimal import Decimal

        import numpy as np
        import pyarrow as pa

        n, total = 0, 0
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(0))
                safe = int(np.abs(x).max()) * len(x) < 1 << 62
                n, total = n + len(x), total + (x.sum(0).astype(object) if safe else x.astype(object).sum(0))
        if n:
            values = [n, *total]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(values)), pa.int32()), pa.array([Decimal(int(v)) for v in values], pa.decimal128(38, 0))], ["i", "v"])

    found = {r.i: int(r.v) for r in fit.mapInArrow(part, "i int, v decimal(38,0)").groupBy("i").agg(F.sum("v").cast("decimal(38,0)").alias("v")).collect()}  # d + 1 rows
    return found.get(0, 0), [found[i] for i in range(1, len(found))]


def _added(fit: DataFrame, of) -> list[float]:
    """of(batch of x) added up over the fit list, as a flat array; Spark adds the tasks' arrays place by place."""

    def part(batches):
        import numpy as np
        import pyarrow as pa

        total = None
        for batch in batches:
            if batch.num_rows:
                new = of(_matrix(batch.column(0)))
                total = new if total is None else total + new
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["i", "v"])

    rows = fit.mapInArrow(part, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    return [v for _, v in sorted(map(tuple, rows))]


def leading(multiply, d: int, wanted: int, extra: int = EXTRA, degree: int = DEGREE, seed: int = 1):
    """(eigenvalues, axes as columns, residuals) of the ``wanted`` largest, for a symmetric, non-negative operator
    of d dimensions that multiply(block) applies to a block of columns."""
    import numpy as np

    rng = np.random.default_rng(seed)
    locked, values, residuals = np.zeros((d, 0)), [], []
    width = min(d, wanted + extra)

    def free(y):
        return y - locked @ (locked.T @ y)

    def block_of(y):
        return np.linalg.qr(free(np.linalg.qr(free(y))[0]))[0]

    q = block_of(rng.normal(size=(d, width)))
    w = multiply(q)
    best, waited = np.inf, 0
    while True:
        h = q.T @ w
        theta, u = np.linalg.eigh((h + h.T) / 2)
        theta, u = theta[::-1], u[:, ::-1]
        q, w = q @ u, w @ u
        top = max([theta[0], *values])
        if top <= 0:
            break
        off = np.linalg.norm(w - q * theta, axis=0) / max(theta[0], ZERO * top)
        whole = locked.shape[1] + q.shape[1] == d  # all dimensions: Ritz vectors are eigenvectors
        if off[0] < best / 2:
            best, waited = off[0], 0
        else:
            waited += 1
        settled = whole or (waited >= PATIENCE and best * theta[0] <= SETTLED * top)
        while len(values) < wanted and q.shape[1] and (off[0] <= TOLERANCE or settled):
            locked = np.column_stack([locked, q[:, 0]])
            values.append(theta[0])
            residuals.append(off[0] * max(theta[0], ZERO * top))
            off = off[1:] * max(theta[0], ZERO * top)
            q, w, theta, best, waited = q[:, 1:], w[:, 1:], theta[1:], np.inf, 0
            off = off / max([ZERO * top, *theta[:1]])
            settled = whole
        if len(values) == wanted or not q.shape[1]:
            break
        if waited >= PATIENCE:  # neighbours outside the block are too close
            more = min(d - locked.shape[1], 2 * q.shape[1])
            q = block_of(np.column_stack([q, rng.normal(size=(d, more - q.shape[1]))]))
            w, best, waited = multiply(q), np.inf, 0
            continue
        edge = max(theta[-1], 1e-14 * top) / 2  # the unwanted spectrum is [0, 2 * edge]
        reach = np.arccosh(max(theta[0] / edge - 1, 1 + 1e-9))
        before, now = q, (w - edge * q) / edge
        for _ in range(int(np.clip(np.log(GROWTH) / reach, 1, degree)) - 1):
            before, now = now, 2 * (free(multiply(now)) - edge * now) / edge - before
            size = np.maximum(np.linalg.norm(now, axis=0), 1e-300)
            before, now = before / size, now / size
        q = block_of(now)
        w = multiply(q)
    order = np.argsort(-np.array(values), kind="stable")
    return np.array(values)[order], locked[:, order], np.array(residuals)[order]


@dataclass
class Whitening:
    """What a fit found; all of it has the size of the vectors' dimensions times the components."""

    n: int = 0
    sums: list = field(default_factory=list)
    values: list = field(default_factory=list)
    axes: list = field(default_factory=list)
    residuals: list = field(default_factory=list)
    trace: float = 0.0
    identity_error: float = 0.0

    def mean(self):
        import numpy as np

        return np.array([s / self.n for s in self.sums])


def fit_whitening(fit: DataFrame, components: int = 4, extra: int = EXTRA) -> Whitening:
    """From a staged fit list of (x)."""
    import numpy as np

    n, s = sums(fit)
    found = Whitening(n, s)
    if not n:
        return found
    d, mean = len(s), found.mean()

    def square(x):
        z = x - mean
        return np.array([(z * z).sum()])

    def multiply(block):
        def product(x):
            z = x - mean
            return (z.T @ (z @ block)).ravel()

        return np.array(_added(fit, product)).reshape(d, -1) / n

    found.trace = _added(fit, square)[0] / n
    if found.trace <= 0:
        return found
    values, axes, residuals = leading(multiply, d, min(components, d), extra)
    real = values > ZERO * values[:1].sum()
    found.values, found.axes, found.residuals = values[real], axes[:, real], residuals[real]
    count = len(found.values)
    if not count:
        return found
    weights = found.axes / np.sqrt(found.values)

    def moments(x):
        w = (x - mean) @ weights
        return np.concatenate([w.sum(0), (w.T @ w).ravel()])

    total = np.array(_added(fit, moments)) / n
    covariance = total[count:].reshape(count, count) - np.outer(total[:count], total[:count])
    found.identity_error = float(np.abs(covariance - np.eye(count)).max())
    return found


def _deviations(x, n: int, s: list[int]) -> list[int | None]:
    """Sum over dimensions of (n x - S)**2 of each row, exactly; null beyond a long."""
    import numpy as np

    reach = n * int(np.abs(x).max(initial=0)) + max(map(abs, s), default=0)
    if reach * reach * max(1, len(s)) < 1 << 62:
        return ((n * x - np.array(s, np.int64)) ** 2).sum(1).tolist()
    exact = ((n * x.astype(object) - np.array(s, object)) ** 2).sum(1)
    return [int(v) if v < 1 << 63 else None for v in exact]


def whiten(rows: DataFrame, model: Whitening) -> DataFrame:
    """(vec_id, deviation, whitened array<double>) of each row of (vec_id, x)."""

    def of(batches):
        import numpy as np
        import pyarrow as pa

        mean, weights = model.mean(), model.axes / np.sqrt(model.values)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("x"))
            w = (x - mean) @ weights
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(_deviations(x, model.n, model.sums), pa.int64()), pa.array(list(w), pa.list_(pa.float64()))], ["vec_id", "deviation", "whitened"])

    kind = dict(rows.dtypes)["vec_id"]
    if not len(model.values):
        return rows.sparkSession.createDataFrame([], f"vec_id {kind}, deviation long, whitened array<double>")
    return rows.mapInArrow(of, f"vec_id {kind}, deviation long, whitened array<double>")


def whitened_components(vectors: DataFrame, components: int = 4, extra: int = EXTRA) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for each vector and component."""
    rows = integer_vectors(vectors)
    model = fit_whitening(fit_list(rows), components, extra)
    explained = [float(v / model.trace) for v in model.values] or [0.0]
    each = whiten(rows, model).select("vec_id", "deviation", F.posexplode("whitened").alias("_i", "whitened"))
    return each.select("vec_id", (F.col("_i") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", F.element_at(F.lit(explained), F.col("_i") + 1).alias("explained"), F.lit(model.identity_error).alias("identity_error"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened_components(table(spark, sf_dir, "embeddings"))


QUERIES = {"op11_whitening": op11_whitening}
ORACLE_SQL: dict[str, str] = {}
