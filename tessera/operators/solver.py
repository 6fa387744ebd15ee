"""Many logistic models at once: each iteration is one pass over the rows, whatever the number of models.

A task is a set of training rows and one of test rows with a label. All tasks, at all strengths of regularization, are fitted
together: tasks of a Spark job add up the loss, the gradient and the Hessian of every model over the rows that they read, and
the driver makes a Newton step of each. Values are standardized, and directions taken away, by changing the parameters, so
that the rows are read as they are.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.vectors import doubles

#: Models that are fitted together at most, and numbers of all Hessians; beyond the latter, steps come from gradients only (L-BFGS).
MOST_MODELS, MOST_HESSIAN = 20_000, 1 << 25
#: Gradients that L-BFGS remembers.
_MEMORY = 10
#: Parts in which the sums of many tasks are added before they are added together.
_PARTS = 64


@dataclass
class Task:
    """A model to be fitted to the rows of `train` and tried on those of `test`; y and test_y are class numbers from 0.

    Rows whose class is null are in neither. `without` has directions, as rows, that are taken away from the values.
    """

    name: tuple
    train: Column
    test: Column
    y: Column
    classes: int
    test_y: Column | None = None
    without: np.ndarray | None = None


@dataclass
class Model:
    """A fitted model: coef (one row for two classes, else one for each) and intercept on the values as they are.

    standard has the coefficients on standardized values, mean and scale what those are standardized by; a model without two
    classes of training rows is not fitted.
    """

    task: int
    strength: float
    fitted: bool
    coef: np.ndarray
    intercept: np.ndarray
    standard: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    n_train: int
    iterations: int = 0
    gradient: float = 0.0


@dataclass
class _Fit:
    """The state of one model: parameters (outputs, width + 1) on the task's own standardized values."""

    task: int
    penalty: float
    at: np.ndarray
    tried: np.ndarray
    loss: float = np.inf
    gradient: np.ndarray | None = None
    direction: np.ndarray | None = None
    step: float = 1.0
    done: bool = False
    iterations: int = 0
    memory: list = field(default_factory=list)


def _members(tasks: Sequence[Task], rows: DataFrame, side: str) -> DataFrame:
    """rows with _in: (t, y) of each task whose training (or test) rows a row is one of."""
    listed = []
    for i, t in enumerate(tasks):
        y = t.y if side == "train" or t.test_y is None else t.test_y
        inside = (t.train if side == "train" else t.test) & y.isNotNull()
        listed.append(F.when(inside, F.struct(F.lit(i).alias("t"), y.cast("int").alias("y"))))
    members = F.filter(F.array(*listed), lambda m: m.isNotNull())
    return rows.withColumn("_in", members).where(F.col("values").isNotNull() & (F.size("_in") > 0))


def _read(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Values (rows, width), and row, task and class of each membership."""
    values, members = batch.column(0), batch.column(1)
    x = values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1)
    at = np.repeat(np.arange(len(members)), members.value_lengths().to_numpy())
    flat = members.flatten()
    return x, at, flat.field("t").to_numpy(), flat.field("y").to_numpy()


def _each(x: np.ndarray, at: np.ndarray, task: np.ndarray, y: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Task, values and classes of the rows of each task in a batch."""
    for t in np.unique(task):
        own = task == t
        yield int(t), x[at[own]], y[own]


def summed(rows: DataFrame, add) -> dict[tuple[int, int], np.ndarray]:
    """Vectors by (model, row): each task's own, which add(batch, held) puts in held for batches of values and _in, are added in two
    steps, a sorted run at a time."""
    schema = "model int, row int, part int, v array<double>"
    names = ["model", "row", "part", "v"]

    def table(model, row, part, vectors) -> pa.RecordBatch:
        offsets = np.cumsum([0] + [len(v) for v in vectors]).astype(np.int32)
        flat = pa.array(np.concatenate(vectors) if vectors else np.zeros(0))
        return pa.RecordBatch.from_arrays([pa.array(model, pa.int32()), pa.array(row, pa.int32()), pa.array([part] * len(model), pa.int32()), pa.ListArray.from_arrays(pa.array(offsets), flat)], names=names)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            if batch.num_rows:
                add(batch, held)
        keys, part = list(held), TaskContext.get().partitionId() % _PARTS
        for i in range(0, len(keys), 256):
            some = keys[i : i + 256]
            yield table([k[0] for k in some], [k[1] for k in some], part, [held[k] for k in some])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total = None, None
        for batch in batches:
            for m, r, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3)):
                v = v.values.to_numpy()
                if key == (m, r):
                    total = total + v
                    continue
                if key:
                    yield table([key[0]], [key[1]], 0, [total])
                key, total = (m, r), v
        if key:
            yield table([key[0]], [key[1]], 0, [total])

    found = rows.select(doubles("values").alias("values"), "_in").mapInArrow(gather, schema)
    for keys in (["model", "row", "part"], ["model", "row"]):
        found = found.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(added, schema)
    return {(r["model"], r["row"]): np.array(r["v"]) for r in found.select("model", "row", "v").collect()}


def hold(held: dict, key: tuple[int, int], v: np.ndarray) -> None:
    held[key] = held[key] + v if key in held else v


@dataclass
class _Basis:
    """How a task's values are seen: (x - center) @ B - offset, and what its classes weigh."""

    n: int
    counts: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    matrix: np.ndarray | None  # None: only scaled
    offset: np.ndarray
    weights: np.ndarray

    def outward(self, at: np.ndarray) -> np.ndarray:
        """Parameters on x - center, from those on the standardized values."""
        w = at[:, :-1] / self.scale
        if self.matrix is not None:
            w = w @ self.matrix
        return np.concatenate([w, (at[:, -1] - at[:, :-1] @ (self.offset / self.scale))[:, None]], 1)

    def map(self) -> np.ndarray:
        """The matrix that takes (x - center, 1) to (standardized values, 1)."""
        d = len(self.scale)
        out = np.zeros((d + 1, d + 1))
        out[:d, :d] = (np.eye(d) if self.matrix is None else self.matrix) / self.scale
        out[d, :d] = -self.offset / self.scale
        out[d, d] = 1.0
        return out


def _bases(rows: DataFrame, tasks: Sequence[Task]) -> tuple[np.ndarray, dict[int, _Basis]]:
    """A vector near all values, and each task's basis, from the counts, sums and squares of its training rows."""
    first = rows.select(doubles("values").alias("v")).first()
    center = np.array(first["v"]) if first else np.zeros(0)
    shared = rows.sparkSession.sparkContext.broadcast((center, [t.classes for t in tasks], [t.without is not None for t in tasks]))

    def add(batch: pa.RecordBatch, held: dict) -> None:
        center, classes, whole = shared.value
        for t, x, y in _each(*_read(batch)):
            x = x - center
            hold(held, (t, 0), np.bincount(y, minlength=classes[t]).astype(float))
            hold(held, (t, 1), x.sum(0))
            hold(held, (t, 2), (x.T @ x).ravel() if whole[t] else (x * x).sum(0))

    sums = summed(rows, add)
    bases = {}
    for i, t in enumerate(tasks):
        if (i, 0) not in sums:
            continue
        counts, n, d = sums[i, 0], sums[i, 0].sum(), len(center)
        mean = sums[i, 1] / n
        matrix = None
        if t.without is not None:
            _, s, vt = np.linalg.svd(np.atleast_2d(t.without), full_matrices=False)
            q = vt[s > 1e-10 * max(s.max(initial=0), 1e-300)]
            matrix = np.eye(d) - q.T @ q
            cov = matrix @ (sums[i, 2].reshape(d, d) / n - np.outer(mean, mean)) @ matrix
            spread = np.diag(cov)
        else:
            spread = sums[i, 2] / n - mean * mean
        scale = np.sqrt(np.clip(spread, 0, None))
        offset = mean if matrix is None else mean @ matrix
        present = counts > 0
        weights = np.where(present, n / (present.sum() * np.maximum(counts, 1)), 0.0)
        bases[i] = _Basis(int(n), counts, mean + center, np.where(scale > 1e-9, scale, 1.0), matrix, offset, weights)
    return center, bases


def _softmax(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities, and the logarithm of the sum of powers."""
    top = z.max(1, keepdims=True)
    e = np.exp(z - top)
    total = e.sum(1, keepdims=True)
    return e / total, (np.log(total) + top)[:, 0]


def _part(x: np.ndarray, y: np.ndarray, params: np.ndarray, weights: np.ndarray, hessian: bool) -> tuple[float, np.ndarray, np.ndarray | None]:
    """Weighted loss, gradient and Hessian of rows x (with a column of ones)."""
    s, k = weights[y], len(params)
    z = x @ params.T
    if k == 1:
        p = 1 / (1 + np.exp(-np.clip(z[:, 0], -700, 700)))
        loss = s @ (np.logaddexp(0, z[:, 0]) - z[:, 0] * y)
        return loss, (s * (p - y)) @ x, (x.T * (s * p * (1 - p))) @ x if hessian else None
    p, log = _softmax(z)
    loss = s @ (log - z[np.arange(len(y)), y])
    rest = p.copy()
    rest[np.arange(len(y)), y] -= 1
    gradient = ((rest * s[:, None]).T @ x).ravel()
    if not hessian:
        return loss, gradient, None
    d = x.shape[1]
    out = np.zeros((k * d, k * d))
    for a in range(k):
        for b in range(a, k):
            block = (x.T * (s * p[:, a] * ((a == b) - p[:, b]))) @ x
            out[a * d : (a + 1) * d, b * d : (b + 1) * d] = block
            out[b * d : (b + 1) * d, a * d : (a + 1) * d] = block
    return loss, gradient, out


def evaluate(rows: DataFrame, center: np.ndarray, params: dict[int, tuple[int, np.ndarray, np.ndarray]], hessian: bool) -> dict[tuple[int, int], np.ndarray]:
    """Sums over the training rows, by model: row 0 has loss and gradient, the others those of the Hessian.

    params has, by model, its task, its parameters on x - center and its class weights. One job.
    """
    by_task: dict[int, list[int]] = {}
    for m, (t, _, _) in params.items():
        by_task.setdefault(t, []).append(m)
    shared = rows.sparkSession.sparkContext.broadcast((center, params, by_task))

    def add(batch: pa.RecordBatch, held: dict) -> None:
        center, params, by_task = shared.value
        for t, x, y in _each(*_read(batch)):
            x = np.concatenate([x - center, np.ones((len(x), 1))], 1)
            for m in by_task.get(t, ()):
                loss, gradient, square = _part(x, y, params[m][1], params[m][2], hessian)
                hold(held, (m, 0), np.concatenate([[loss], gradient]))
                if square is not None:
                    for i in range(0, len(square), 64):
                        hold(held, (m, 1 + i // 64), square[i : i + 64].ravel())

    return summed(rows, add)


def _direction(fit: _Fit, gradient: np.ndarray, hessian: np.ndarray | None) -> np.ndarray:
    if hessian is not None:
        return -np.linalg.lstsq(hessian, gradient, rcond=1e-12)[0]
    q, alphas = gradient.copy(), []
    for s, y in reversed(fit.memory):
        alphas.append((s @ q) / (s @ y))
        q -= alphas[-1] * y
    q *= (fit.memory[-1][0] @ fit.memory[-1][1]) / (fit.memory[-1][1] @ fit.memory[-1][1]) if fit.memory else 1 / max(1.0, float(np.linalg.norm(gradient)))
    for (s, y), a in zip(fit.memory, reversed(alphas)):
        q += (a - (y @ q) / (s @ y)) * s
    return -q


def _advance(fit: _Fit, loss: float, gradient: np.ndarray, hessian: np.ndarray | None, n: int, tol: float) -> None:
    """One step: keep what was tried if the loss fell enough, and try the next; or go back half the way."""
    if fit.gradient is not None and not loss <= fit.loss + 1e-4 * fit.step * float(fit.gradient @ fit.direction) + 1e-12 * abs(fit.loss):
        fit.step /= 2
        if fit.step < 1e-10:
            fit.done = True
        fit.tried = fit.at + (fit.step * fit.direction).reshape(fit.at.shape)
        return
    if fit.gradient is not None:
        s, y = (fit.tried - fit.at).ravel(), gradient - fit.gradient
        if s @ y > 1e-12 * float(np.linalg.norm(s) * np.linalg.norm(y)):
            fit.memory = [*fit.memory, (s, y)][-_MEMORY:]
    fit.at, fit.loss, fit.gradient, fit.step = fit.tried, loss, gradient, 1.0
    fit.iterations += 1
    if np.abs(gradient).max() <= tol * n:
        fit.done = True
        return
    fit.direction = _direction(fit, gradient, hessian)
    if gradient @ fit.direction >= 0:
        fit.memory, fit.direction = [], -gradient / max(1.0, float(np.linalg.norm(gradient)))
    fit.tried = fit.at + fit.direction.reshape(fit.at.shape)


def fit_tasks(rows: DataFrame, tasks: Sequence[Task], cs: Sequence[float] = (), alphas: Sequence[float] = (), tol: float = 1e-7, max_iter: int = 100) -> list[Model]:
    """The models of all tasks at all strengths: the minimum of the balanced logistic loss and an L2 penalty.

    Of a strength c in cs, the penalty on coefficients of standardized values is 1 / (2 c); of one in alphas, it is alpha / 2 times the training rows. Exactly one
    of the two is given. Two classes have one coefficient a value, more have one for each class. Every row with `values` counts in each task it
    is one of. Each iteration is one job for all models that are not done; the driver holds their parameters and, if these are few, Hessians.
    """
    if bool(cs) == bool(alphas):
        raise ValueError("give either cs or alphas")
    strengths = list(cs or alphas)
    if len(tasks) * len(strengths) > MOST_MODELS:
        raise ValueError(f"more than {MOST_MODELS} models")
    members = _members(tasks, rows, "train")
    center, bases = _bases(members, tasks)
    d = len(center)
    fits: dict[int, _Fit] = {}
    for t, task in enumerate(tasks):
        basis = bases.get(t)
        if basis is None or (basis.counts > 0).sum() < 2:
            continue
        outputs = 1 if task.classes == 2 else task.classes
        for k, strength in enumerate(strengths):
            start = np.zeros((outputs, d + 1))
            fits[t * len(strengths) + k] = _Fit(t, 1 / strength if cs else strength * basis.n, start, start)
    square = sum((f.at.size) ** 2 for f in fits.values()) <= MOST_HESSIAN
    for _ in range(max_iter if square else 10 * max_iter):
        open_ = {m: f for m, f in fits.items() if not f.done}
        if not open_:
            break
        sums = evaluate(members, center, {m: (f.task, bases[f.task].outward(f.tried), bases[f.task].weights) for m, f in open_.items()}, square)
        for m, f in open_.items():
            k, p = f.at.shape
            change = bases[f.task].map()
            head = sums[m, 0]
            gradient = (head[1:].reshape(k, p) @ change).ravel()
            hessian = None
            ridge = np.tile(np.append(np.full(d, f.penalty), 0.0), k)
            if square:
                whole = np.concatenate([sums[m, r] for r in range(1, 2 + (k * p - 1) // 64)]).reshape(k * p, k * p)
                wide = np.kron(np.eye(k), change)
                hessian = wide.T @ whole @ wide + np.diag(ridge)
            loss = head[0] + 0.5 * float(ridge @ f.tried.ravel() ** 2)
            _advance(f, loss, gradient + ridge * f.tried.ravel(), hessian, bases[f.task].n, tol)
    models = []
    for t, task in enumerate(tasks):
        for k, strength in enumerate(strengths):
            f, basis = fits.get(t * len(strengths) + k), bases.get(t)
            if f is None:
                none = np.zeros((1 if task.classes == 2 else task.classes, d))
                models.append(Model(t, strength, False, none, none[:, :0].sum(1), none, np.zeros(d), np.ones(d), basis.n if basis else 0))
                continue
            outward = basis.outward(f.at)
            intercept = outward[:, -1] - outward[:, :-1] @ center
            largest = float(np.abs(f.gradient).max()) if f.gradient is not None else np.inf
            models.append(Model(t, strength, True, outward[:, :-1], intercept, f.at[:, :-1], basis.mean, basis.scale, basis.n, f.iterations, largest))
    return models


def score_tasks(rows: DataFrame, key: str, tasks: Sequence[Task], models: Sequence[Model]) -> DataFrame:
    """(key, task, strength, true_index, predicted_index, probability, probabilities) of the test rows of each fitted model.

    predicted_index is the first of the most probable classes, probability that of class 1 for two classes, else the greatest.
    The models are broadcast: their number and width are bounded by fit_tasks().
    """
    kind = rows.schema[key].dataType.simpleString()
    by_task: dict[int, list[tuple[float, np.ndarray, np.ndarray]]] = {}
    for m in models:
        if m.fitted:
            by_task.setdefault(m.task, []).append((m.strength, m.coef, m.intercept))
    shared = rows.sparkSession.sparkContext.broadcast(by_task)
    names = ["key", "task", "strength", "true_index", "predicted_index", "probability", "probabilities"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, at, task, y = _read(batch)
            for t in np.unique(task):
                own = task == t
                for strength, coef, intercept in shared.value.get(int(t), ()):
                    z = x[at[own]] @ coef.T + intercept
                    p = _softmax(np.concatenate([np.zeros_like(z), z], 1) if z.shape[1] == 1 else z)[0]
                    n, k = p.shape
                    best = (z[:, 0] > 0).astype(np.int32) if coef.shape[0] == 1 else p.argmax(1).astype(np.int32)
                    probability = p[:, 1] if k == 2 else p.max(1)
                    listed = pa.ListArray.from_arrays(pa.array(np.arange(0, n * k + 1, k), pa.int32()), pa.array(p.ravel()))
                    columns = [batch.column(2).take(pa.array(at[own])), pa.array(np.full(n, t), pa.int32()), pa.array(np.full(n, strength)), pa.array(y[own], pa.int32()), pa.array(best), pa.array(probability), listed]
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    members = _members(tasks, rows, "test").select(doubles("values").alias("values"), "_in", F.col(key).alias("key"))
    schema = f"key {kind}, task int, strength double, true_index int, predicted_index int, probability double, probabilities array<double>"
    return members.mapInArrow(run, schema).withColumnRenamed("key", key)


def model_table(spark: SparkSession, models: Sequence[Model], classes: Sequence[Sequence[str]]) -> DataFrame:
    """A row for each fitted model, to be written as a table: task, strength, classes, coef, intercept, standard, mean, scale, n_train.

    classes has the labels of each task's class numbers.
    """
    listed = lambda m: [[float(x) for x in row] for row in np.atleast_2d(m)]
    rows = [(m.task, float(m.strength), [str(c) for c in classes[m.task]], listed(m.coef), m.intercept.tolist(), listed(m.standard), m.mean.tolist(), m.scale.tolist(), m.n_train) for m in models if m.fitted]
    matrix, vector = "array<array<double>>", "array<double>"
    return spark.createDataFrame(rows, f"task int, strength double, classes array<string>, coef {matrix}, intercept {vector}, standard {matrix}, mean {vector}, scale {vector}, n_train long")


def read_models(table: DataFrame) -> tuple[list[Model], dict[int, list[str]]]:
    """The models of model_table(), and the labels of each task; ValueError for one whose parts don't fit together, or for more than MOST_MODELS."""
    found = table.limit(MOST_MODELS + 1).collect()
    if len(found) > MOST_MODELS:
        raise ValueError(f"more than {MOST_MODELS} models")
    models, classes = [], {}
    for r in sorted(found, key=lambda r: (r["task"], r["strength"])):
        outputs, width = (1 if len(r["classes"]) == 2 else len(r["classes"])), len(r["mean"])
        if len(r["classes"]) < 2 or {len(r["coef"]), len(r["intercept"]), len(r["standard"])} != {outputs} or {len(x) for x in (*r["coef"], *r["standard"], r["scale"])} != {width}:
            raise ValueError(f"model {r['task']}, {r['strength']} is no whole model")
        if classes.setdefault(r["task"], r["classes"]) != r["classes"]:
            raise ValueError(f"task {r['task']} has models of different classes")
        coef, intercept, standard, mean, scale = (np.array(r[c], float) for c in ("coef", "intercept", "standard", "mean", "scale"))
        models.append(Model(r["task"], r["strength"], True, coef, intercept, standard, mean, scale, r["n_train"]))
    return models, classes


def staged(
    rows: DataFrame, key: str, stages: Sequence[Column], y: Column, classes: int, epochs: Sequence[int] = (),
    alpha: float = 1e-4, rate: float = 1.0, batches: int = 4, seed: int = 42,
) -> Model:
    """A model trained on stages of rows, one after the other: each begins with what the one before has learned.

    Scaler and class weights are those of all stages' rows. An epoch deals the rows of its stage in batches by a hash of key, seed and epoch; each batch is
    a job that adds up the gradient of the loss, and a step against its mean and the penalty alpha, at a rate that falls with the steps made:
    rate / (1 + alpha rate t). Two classes or more; epochs has a number for each stage, 1 by default.
    """
    epochs = list(epochs) or [1] * len(stages)
    if len(epochs) != len(stages) or not stages or any(e <= 0 for e in epochs):
        raise ValueError("epochs must have a positive number for each stage")
    for i, stage in enumerate(stages):
        if rows.where(stage & y.isNotNull()).limit(1).count() == 0:
            raise ValueError(f"stage {i} has no rows")
    union = F.lit(False)
    for stage in stages:
        union = union | F.coalesce(stage, F.lit(False))
    task = Task((), union, F.lit(False), y, classes)
    members = _members([task], rows, "train")
    center, bases = _bases(members, [task])
    basis, d = bases[0], len(center)
    if (basis.counts > 0).sum() < 2:
        raise ValueError("the stages' rows have one class only")
    at, t, epoch = np.zeros((1 if classes == 2 else classes, d + 1)), 0, 0
    change = basis.map()
    for stage, n in zip(stages, epochs):
        for _ in range(n):
            dealt = F.pmod(F.xxhash64(F.lit(seed), F.lit(epoch), F.col(key)), F.lit(batches))
            for b in range(batches):
                part = members.where(stage & (dealt == b))
                sums = evaluate(part.withColumn("_in", F.col("_in")), center, {0: (0, basis.outward(at), basis.weights)}, False)
                counts = part.count() if sums else 0
                if counts:
                    gradient = sums[0, 0][1:].reshape(len(at), d + 1) @ change / counts
                    at = at - rate / (1 + alpha * rate * t) * (gradient + alpha * np.concatenate([at[:, :-1], np.zeros((len(at), 1))], 1))
                    t += 1
            epoch += 1
    outward = basis.outward(at)
    return Model(0, alpha, True, outward[:, :-1], outward[:, -1] - outward[:, :-1] @ center, at[:, :-1], basis.mean, basis.scale, basis.n, t)
