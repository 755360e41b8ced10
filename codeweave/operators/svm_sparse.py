"""M03/M04 on sparse TF-IDF rows: RBF kernel by random Fourier features, and one solver for all classes.

* Projection. The direction of a term is a seeded normal vector drawn from the term's own hash, so no
  matrix over the vocabulary exists anywhere and every task draws the same numbers:
  z(x) = sqrt(2/D) cos(sum_t x_t w_t + b), w_t ~ N(0, 2 gamma), with a constant 1 appended;
  gamma = 1 / (V var(X)), var over all cells of the (documents x vocabulary) matrix.
* Solver. All classes are fitted together, each against the rest: minimise
  |w_c|^2 / 2 + C sum_i max(0, 1 - y_ic w_c z_i)^2, strictly convex and differentiable. Every pass over
  the projected rows gives losses, gradients and second derivatives of all classes, summed within tasks and
  then by Spark; the driver takes Newton steps with a step length of its own for each class, a few of which
  do. Where the second derivatives are over ``CURVED`` numbers, passes give losses and gradients only, and
  the steps are those of L-BFGS.

M03 predicts the class with the largest margin, M04 every class with expit(margin) > t."""
from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import bounded_rows
from .scan import written

#: Most numbers in all class vectors together; directions of terms a task keeps.
MODEL_CELLS, KEPT_TERMS = 1 << 24, 20_000
#: Most numbers of the second derivatives of all classes.
CURVED = 1 << 22


def direction(term: str, features: int, seed: int) -> np.ndarray:
    """Standard normal vector of a term, the same everywhere."""
    import hashlib
    key = np.frombuffer(hashlib.blake2b(f"{seed}|{term}".encode(), digest_size=16).digest(), np.uint64)
    return np.random.Generator(np.random.Philox(key=key)).standard_normal(features)


def offsets(features: int, seed: int) -> np.ndarray:
    return np.random.Generator(np.random.Philox(key=[seed, 1])).uniform(0, 2 * np.pi, features)


def scale(x: DataFrame, n_docs: int, vocab_size: int) -> float:
    """gamma of the kernel over all cells, the zero ones too."""
    x = x.select(F.explode("ws").alias("w")) if "ws" in x.columns else x
    r = x.agg(F.sum("w").alias("s"), F.sum(F.col("w") * F.col("w")).alias("q")).first()
    cells = max(1, n_docs * vocab_size)
    var = (r["q"] or 0.0) / cells - ((r["s"] or 0.0) / cells) ** 2
    return 1.0 / (vocab_size * var) if var > 0 else 1.0


def project(x: DataFrame, ids: DataFrame, gamma: float, features: int = 256, seed: int = 0) -> DataFrame:
    """(id, z): random Fourier features and the constant of every id; without terms those of the zero vector. ``x`` is
    (id, term, w), or (id, terms, ws) with a row for every one of the ids."""
    kind = dict(ids.dtypes)["id"]
    if "terms" in x.columns:
        rows = x.select("id", "terms", "ws")
    else:
        rows = ids.select("id").distinct().join(x.groupBy("id").agg(F.collect_list("term").alias("terms"), F.collect_list("w").alias("ws")), "id", "left")

    def run(batches):
        import pyarrow as pa
        b, kept = offsets(features, seed), {}
        for batch in batches:
            out = np.empty((batch.num_rows, features + 1))
            for i, (terms, ws) in enumerate(zip(batch.column("terms").to_pylist(), batch.column("ws").to_pylist())):
                u = np.zeros(features)
                for t, w in sorted(zip(terms or (), ws or ())):
                    if t not in kept:
                        if len(kept) >= KEPT_TERMS:
                            kept.clear()
                        kept[t] = direction(t, features, seed)
                    u += w * kept[t]
                out[i, :-1] = np.sqrt(2.0 / features) * np.cos(np.sqrt(2 * gamma) * u + b)
            out[:, -1] = 1.0
            ends = pa.array(np.arange(batch.num_rows + 1) * (features + 1), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(ends, pa.array(out.ravel()))], names=["id", "z"])
    return rows.mapInArrow(run, f"id {kind}, z array<double>")


def _matrix(column) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def _stored(z: DataFrame, y: DataFrame) -> DataFrame:
    """(z, ys) of all ids with labels, z as bytes, in a few partitions a core."""
    def run(batches):
        import pyarrow as pa
        for b in batches:
            m = _matrix(b.column("z")) if b.num_rows else np.zeros((0, 1))
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in m], pa.binary()), b.column("ys")], names=["z", "ys"])
    rows = z.join(y.groupBy("id").agg(F.collect_set("label").alias("ys")), "id").select("z", "ys")
    rows = written(rows.mapInArrow(run, f"z binary, ys {dict(rows.dtypes)['ys']}"), "svm-rows")
    try:
        return rows.coalesce(4 * rows.sparkSession.sparkContext.defaultParallelism)
    except Exception:  # no classic SparkContext
        return rows


def losses(rows: DataFrame, model: np.ndarray, labels: list, c: float, curved: bool = False) -> tuple:
    """(loss, gradient, second derivatives or None) of every class at ``model`` over rows (z, ys); one pass. A task's sums
    are one row per class, added up by class."""
    at, dims = {label: i for i, label in enumerate(labels)}, model.shape[1]
    size = 1 + dims + (dims * dims if curved else 0)

    def run(batches):
        import pyarrow as pa
        sums = np.zeros((len(labels), size))
        for b in batches:
            if not b.num_rows:
                continue
            z, y = np.frombuffer(b"".join(b.column("z").to_pylist())).reshape(b.num_rows, dims), np.full((b.num_rows, len(labels)), -1.0)
            for i, ys in enumerate(b.column("ys").to_pylist()):
                y[i, [at[x] for x in ys]] = 1.0
            gap = np.maximum(0.0, 1.0 - y * (z @ model.T))
            sums[:, 0] += (gap * gap).sum(axis=0)
            sums[:, 1:1 + dims] -= 2 * (y * gap).T @ z
            for k in range(len(labels) if curved else 0):
                on = z[gap[:, k] > 0]
                sums[k, 1 + dims:] += 2 * (on.T @ on).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(range(len(labels)), pa.int64()), pa.array([r.tobytes() for r in sums], pa.binary())], names=["label", "sums"])

    def add(table):
        import pyarrow as pa
        total = sum(np.frombuffer(x) for x in table.column("sums").to_pylist())
        return pa.table({"label": table.column("label")[:1], "sums": pa.array([total.tobytes()], pa.binary())})
    found = rows.select("z", "ys").mapInArrow(run, "label long, sums binary").groupBy("label").applyInArrow(add, "label long, sums binary")
    out = np.zeros((len(labels), size))
    for r in found.collect():  # one row per class, sizes checked by fit
        out[r["label"]] = np.frombuffer(bytes(r["sums"]))
    second = np.eye(dims) + c * out[:, 1 + dims:].reshape(-1, dims, dims) if curved else None
    return (model * model).sum(axis=1) / 2 + c * out[:, 0], model + c * out[:, 1:1 + dims], second


def _steps(grad, past) -> np.ndarray:
    """L-BFGS directions, class by class, from the last pairs of steps and gradient changes."""
    q, alphas = grad.copy(), []
    for s, y, ok in reversed(past):
        rho = np.where(ok, 1.0 / np.where(ok, (s * y).sum(axis=1), 1.0), 0.0)
        a = rho * (s * q).sum(axis=1)
        q -= a[:, None] * y
        alphas.append((a, rho))
    if past:
        s, y, ok = past[-1]
        q *= np.where(ok, (s * y).sum(axis=1) / np.maximum((y * y).sum(axis=1), 1e-300), 1.0)[:, None]
    for (s, y, ok), (a, rho) in zip(past, reversed(alphas)):
        q += (a - rho * (y * q).sum(axis=1))[:, None] * s * ok[:, None]
    return -q


def fit(z: DataFrame, y: DataFrame, c: float = 2.0, passes: int = 150, tolerance: float = 1e-4) -> tuple[list, np.ndarray]:
    """(labels, one vector per label) of projected rows (id, z) and labels (id, label); an id may have several labels."""
    labels = [r["label"] for r in bounded_rows(y.select("label").distinct().orderBy("label"), 100_000, "labels")]
    first = z.select(F.size("z").alias("n")).first()
    if not labels or first is None:
        return labels, np.zeros((len(labels), 1))
    if len(labels) * first["n"] > MODEL_CELLS:
        raise ValueError("too many classes for one model")
    rows, curved = _stored(z, y), len(labels) * first["n"] ** 2 <= CURVED
    w = np.zeros((len(labels), first["n"]))
    f, g, h = losses(rows, w, labels, c, curved)
    start, past, used = np.maximum(1.0, np.linalg.norm(g, axis=1)), [], 1
    while used < passes and (np.linalg.norm(g, axis=1) > tolerance * start).any():
        d = -np.linalg.solve(h, g[:, :, None])[:, :, 0] if curved else _steps(g, past)
        slope = (d * g).sum(axis=1)
        d, slope = np.where((slope < 0)[:, None], d, -g), np.where(slope < 0, slope, -(g * g).sum(axis=1))
        t = np.ones(len(labels)) if past or curved else 1.0 / start
        while True:
            f2, g2, h2 = losses(rows, w + t[:, None] * d, labels, c, curved)
            used += 1
            short = f2 > f + 1e-4 * t * slope + 1e-12 * np.abs(f)
            if not short.any() or used >= passes:
                break
            t = np.where(short, t / 4, t)
        t = np.where(f2 <= f + 1e-12 * np.abs(f), t, 0.0)
        s, dy = t[:, None] * d, np.where((t > 0)[:, None], g2 - g, 0.0)
        past = (past + [(s, dy, (s * dy).sum(axis=1) > 1e-12 * (dy * dy).sum(axis=1))])[-10:]
        w, f, g = w + s, np.where(t > 0, f2, f), np.where((t > 0)[:, None], g2, g)
        h = np.where((t > 0)[:, None, None], h2, h) if curved else None
        if not (t > 0).any():
            break
    return labels, w


def margins(z: DataFrame, labels: list, model: np.ndarray) -> DataFrame:
    """(id, label, margin) for every id and class."""
    kind = dict(z.dtypes)["id"]

    def run(batches):
        import pyarrow as pa
        for b in batches:
            m = _matrix(b.column("z")) @ model.T if b.num_rows else np.zeros((0, len(labels)))
            ids = b.column("id").take(pa.array(np.repeat(np.arange(b.num_rows), len(labels))))
            yield pa.RecordBatch.from_arrays([ids, pa.array(labels * b.num_rows, pa.string()), pa.array(m.ravel())], names=["id", "label", "margin"])
    return z.mapInArrow(run, f"id {kind}, label string, margin double")


def svm(train_x: DataFrame, train_y: DataFrame, test_ids: DataFrame, test_x: DataFrame, vocab_size: int, several: bool = False,
        c: float = 2.0, t: float = 0.1, features: int = 256, seed: int = 0) -> DataFrame:
    """(id, label, pred, score): M03 (one class per document, trained on the first label, margins as scores) or,
    if ``several``, M04 (every class with expit(margin) > t, trained on all labels, expit as score)."""
    y = train_y.select("id", F.col("label").cast("string").alias("label"))
    y = y.distinct() if several else y.groupBy("id").agg(F.min("label").alias("label"))
    gamma = scale(train_x, y.select("id").distinct().count(), vocab_size)
    labels, model = fit(project(train_x, y, gamma, features, seed), y, c)
    m = margins(project(test_x, test_ids, gamma, features, seed), labels, model)
    if several:
        p = 1.0 / (1.0 + F.exp(-F.col("margin")))
        return m.select("id", "label", (p > t).alias("pred"), p.alias("score"))
    best = m.groupBy("id").agg(F.min_by("label", F.struct(-F.col("margin"), F.col("label"))).alias("best"))
    return m.join(best, "id").select("id", "label", (F.col("label") == F.col("best")).alias("pred"), F.col("margin").alias("score"))
