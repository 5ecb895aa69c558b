"""Networks of one hidden layer (sigmoid units, two-way softmax) and their fit by L-BFGS (L3, L4).

The network, its start, its loss and the steps of the fit are those of Spark's
``MultilayerPerceptronClassifier`` (Breeze's L-BFGS with ten corrections and a strong
Wolfe line search), weights in its order; the loss is the mean over rows.

* Rows are packed into blocks (``pack``), in tasks and without a shuffle: a block holds up
  to an Arrow batch of rows of one key as doubles, the label last.
* ``fit_together`` fits one network per key: a round is one job in which every task adds
  up the loss and the gradient of its blocks, for all networks at once.
* ``fit_apart`` fits one network per key where a key's rows (a batch) are few: each within
  a task, all keys side by side.
* A search (``lbfgs``) is a generator that asks for the loss and gradient at a point, so
  that both run the very same steps.
"""

from __future__ import annotations

from collections.abc import Callable, Generator, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_SCHEMA = "key int, n int, x binary"
#: rows times inputs times hidden units that are worked on at once: they stay in a core's
#: cache, and below 262,144 the BLAS does not spread a product over threads
SLICE = 200_000
CORRECTIONS = 10


def start_weights(spark, n_features: int, hidden: int, seed: int) -> np.ndarray:
    """The weights that Spark's network of this seed starts from."""
    from pyspark.ml.common import _java2py

    sc = spark.sparkContext
    layers = sc._gateway.new_array(sc._jvm.int, 3)  # noqa: SLF001
    layers[0], layers[1], layers[2] = n_features, hidden, 2
    topology = sc._jvm.org.apache.spark.ml.ann.FeedForwardTopology.multiLayerPerceptron(layers, True)  # noqa: SLF001
    return np.array(_java2py(sc, topology.model(seed).weights()).toArray())


def _layers(w: np.ndarray, d: int):
    """The hidden layer with its bias as last row, and the margin of class 1 over class 0."""
    h = (len(w) - 2) // (d + 3)
    inner = np.vstack([w[:h * d].reshape(d, h), w[h * d:h * (d + 1)]])
    outer, bias = w[h * (d + 1):-2].reshape(h, 2), w[-2:]
    return inner, outer[:, 1] - outer[:, 0], bias[1] - bias[0]


def _units(rows: np.ndarray, inner: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(features and a one, labels, hidden units, room of that shape) of some rows at a time;
    the arrays are used again."""
    step = min(max(16, SLICE // inner.size), len(rows))
    turned, held, room = -inner, np.empty((step, inner.shape[1])), np.empty((step, inner.shape[1]))
    for i in range(0, len(rows), step):
        x = rows[i:i + step].copy()
        y = x[:, -1].copy()
        x[:, -1] = 1.0
        z = np.matmul(x, turned, out=held[:len(x)])
        np.exp(z, out=z)
        z += 1.0
        yield x, y, np.reciprocal(z, out=z), room[:len(x)]


def predictions(w: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Class of every row (features, label)."""
    inner, outer, bias = _layers(w, rows.shape[1] - 1)
    with np.errstate(over="ignore"):
        out = [(a @ outer + bias > 0).astype(np.int64) for _, _, a, _ in _units(rows, inner)] if len(rows) else []
    return np.concatenate(out) if out else np.zeros(0, dtype=np.int64)


def loss_sums(w: np.ndarray, rows: np.ndarray) -> tuple[float, np.ndarray]:
    """Cross entropy and its gradient, summed over rows (features, label)."""
    d = rows.shape[1] - 1
    inner, outer, bias = _layers(w, d)
    h, loss, g_bias = len(outer), 0.0, 0.0
    g_inner, g_outer = np.zeros((d + 1, h)), np.zeros(h)
    with np.errstate(over="ignore", invalid="ignore"):
        for x, y, a, room in _units(rows, inner):
            m = a @ outer + bias
            loss += float((np.logaddexp(0.0, m) - y * m).sum())
            r = 1.0 / (1.0 + np.exp(-m)) - y
            g_outer += r @ a
            g_bias += float(r.sum())
            np.multiply(a, a, out=room)
            a -= room                                    # slope of the units
            x *= r[:, None]
            g_inner += x.T @ a
        g_inner *= outer
    grad = np.concatenate([g_inner[:d].ravel(), g_inner[d], np.stack([-g_outer, g_outer], axis=1).ravel(), [-g_bias, g_bias]])
    return loss, grad


# ---------------------------------------------------------------- the search
class _NoStep(Exception):
    """No step was found from here."""


def _direction(history: list, grad: np.ndarray) -> np.ndarray:
    """Minus the gradient times the inverse Hessian as the last steps show it (newest first)."""
    out, kept, scale = grad.copy(), [], 1.0
    if history:
        s, y = history[0]
        sy = s @ y
        if not sy >= 0:
            raise _NoStep
        scale = np.divide(sy, y @ y)
    for s, y in history:
        rho = s @ y
        a = np.divide(s @ out, rho)
        if np.isnan(a):
            raise _NoStep
        out -= a * y
        kept.append((a, rho))
    out *= scale
    for (s, y), (a, rho) in zip(reversed(history), reversed(kept)):
        out += (a - np.divide(y @ out, rho)) * s
    return -out


def _cubic(left, right) -> float:
    """Where the cubic through two points (t, slope, value) is least, kept off both ends."""
    (lt, ls, lv), (rt, rs, rv) = left, right
    d1 = ls + rs - 3 * (lv - rv) / (lt - rt)
    d2 = np.sqrt(d1 * d1 - ls * rs)
    t = rt - (rt - lt) * (rs + d2 - d1) / (rs - ls + 2 * d2)
    low, high = lt + 0.1 * (rt - lt), lt + 0.9 * (rt - lt)
    return float(low if t < low else high if t > high else t)


def _line_search(x, value, slope, direction, t) -> Generator:
    """Strong Wolfe conditions (1e-4, 0.9); returns (t, value, gradient) of the step."""
    seen = {}

    def at(t):
        v, g = yield x + direction * t
        seen[t] = v, g
        return t, float(g @ direction), v

    def zoom(low, high):
        for _ in range(10):
            t = _cubic(high, low) if low[0] > high[0] else _cubic(low, high)
            c = yield from at(t)
            if c[2] > value + 1e-4 * t * slope or c[2] >= low[2]:
                high = c
                continue
            if abs(c[1]) <= 0.9 * abs(slope):
                return t
            if c[1] * (high[0] - low[0]) >= 0:
                high = low
            low = c
        raise _NoStep

    if slope > 0:
        raise _NoStep
    low, found = (0.0, slope, value), None
    for i in range(10):
        c = yield from at(t)
        if not np.isfinite(c[2]):
            t /= 2.0
            continue
        if c[2] > value + 1e-4 * t * slope or (c[2] >= low[2] and i > 0):
            found = yield from zoom(low, c)
        elif abs(c[1]) <= 0.9 * abs(slope):
            found = t
        elif c[1] >= 0:
            found = yield from zoom(c, low)
        if found is not None:
            return found, *seen[found]
        low, t = c, t * 1.5
    raise _NoStep


def lbfgs(x: np.ndarray, iterations: int, tol: float) -> Generator:
    """Yields points, takes (mean loss, gradient) there, returns the last point."""
    history: list = []
    value, grad = yield x
    first, values, done, failed = value, [np.inf], 0, False
    with np.errstate(all="ignore"):
        while done < iterations:
            if len(values) >= 2 and abs(value - max(values)) <= tol * first:
                break
            if np.linalg.norm(grad) <= max(tol * value, 1e-8):
                break
            try:
                direction = _direction(history, grad)
                t = 1.0 / np.linalg.norm(direction) if done == 0 else 1.0
                t, v, g = yield from _line_search(x, value, float(grad @ direction), direction, t)
                if t * np.linalg.norm(grad) < 1e-10:
                    raise _NoStep
            except _NoStep:
                if failed:
                    break
                failed, history = True, []
                continue
            new = x + direction * t
            history = [(new - x, g - grad), *history][:CORRECTIONS]
            x, value, grad, done, failed = new, v, g, done + 1, False
            values = [*values, value][-20:]
    return x


def fitted(start: np.ndarray, rows: np.ndarray, iterations: int, tol: float) -> np.ndarray:
    """The weights after a fit on rows that are at hand."""
    search, n = lbfgs(start, iterations, tol), len(rows)
    point = next(search)
    while True:
        loss, grad = loss_sums(point, rows)
        try:
            point = search.send((loss / n, grad / n))
        except StopIteration as end:
            return end.value


# ---------------------------------------------------------------- rows in blocks
def pack(df: DataFrame, features: Sequence[str], label: str, key: Column) -> DataFrame:
    """``BLOCK_SCHEMA``: the rows of ``df`` as blocks, each of one key; gaps are refused."""
    width = len(features) + 1

    def blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            rows = np.stack([b.column(i + 1).to_numpy(zero_copy_only=False) for i in range(width)], axis=1)
            if not np.isfinite(rows).all():
                raise ValueError("null, NaN or infinite values: impute or drop such rows before a fit")
            keys = b.column(0).to_numpy(zero_copy_only=False)
            order = np.argsort(keys, kind="stable")
            keys, at = np.unique(keys[order], return_index=True)
            parts = np.split(rows[order], at[1:])
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int32()), pa.array([len(p) for p in parts], pa.int32()),
                 pa.array([p.tobytes() for p in parts], pa.binary())], names=["key", "n", "x"])

    rows = df.select(key.cast("int").alias("key"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(features)],
                     F.col(label).cast("double").alias("y"))
    return rows.mapInArrow(blocks, BLOCK_SCHEMA)


def in_order(blocks: DataFrame, partitions: int = 1) -> DataFrame:
    """All blocks of a key in one partition, in an order that only depends on the blocks."""
    dealt = blocks.repartition(1) if partitions == 1 else blocks.repartition(partitions, "key")
    return dealt.sortWithinPartitions("key", "x")


def by_key(batches: Iterable[pa.RecordBatch], width: int) -> Iterator[tuple[int, np.ndarray]]:
    """(key, rows) of sorted blocks, one key at a time."""
    key, held = None, []
    for b in batches:
        keys = b.column(0).to_pylist()
        for i, k in enumerate(keys):
            if held and k != key:
                yield key, np.concatenate(held)
                held = []
            key = k
            held.append(np.frombuffer(b.column(2)[i].as_buffer(), dtype=np.float64).reshape(-1, width))
    if held:
        yield key, np.concatenate(held)


def _sums(width: int, points: dict[int, np.ndarray]) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for b in batches:
            for i, k in enumerate(b.column(0).to_pylist()):
                if k not in points:
                    continue
                rows = np.frombuffer(b.column(2)[i].as_buffer(), dtype=np.float64).reshape(-1, width)
                loss, grad = loss_sums(points[k], rows)
                t = total.setdefault(k, [0, 0.0, np.zeros(len(grad))])
                t[0] += len(rows)
                t[1] += loss
                t[2] += grad
        if total:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(total), pa.int32()), pa.array([t[0] for t in total.values()], pa.int64()),
                 pa.array([t[1] for t in total.values()], pa.float64()),
                 pa.array([t[2].tobytes() for t in total.values()], pa.binary())], names=["key", "n", "loss", "grad"])
    return run


def fit_together(blocks: DataFrame, width: int, starts: dict[int, np.ndarray], iterations: int, tol: float) -> dict[int, np.ndarray]:
    """One network per key on all blocks of the key, wherever they lie: a job per round."""
    searches = {k: lbfgs(w, iterations, tol) for k, w in starts.items()}
    points, out = {k: next(s) for k, s in searches.items()}, {}
    while points:
        got: dict[int, list] = {}
        for r in blocks.mapInArrow(_sums(width, points), "key int, n long, loss double, grad binary").collect():
            t = got.setdefault(r.key, [0, 0.0, 0.0])
            t[0] += r.n
            t[1] += r.loss
            t[2] = t[2] + np.frombuffer(bytes(r.grad), dtype=np.float64)
        for k in list(points):
            n, loss, grad = got[k]
            try:
                points[k] = searches[k].send((loss / n, grad / n))
            except StopIteration as end:
                out[k] = end.value
                del points[k]
    return out


def fit_apart(blocks: DataFrame, width: int, starts: dict[int, np.ndarray], iterations: int, tol: float) -> dict[int, np.ndarray]:
    """One network per key, each fitted within a task."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, rows in by_key(batches, width):
            if k in starts:
                w = fitted(starts[k], rows, iterations, tol)
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([w.tobytes()], pa.binary())], names=["key", "w"])

    got = in_order(blocks, max(2, len(starts))).mapInArrow(run, "key int, w binary").collect()
    return {r.key: np.frombuffer(bytes(r.w), dtype=np.float64) for r in got}
