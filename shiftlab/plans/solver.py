"""Softmax heads on frozen features, fitted together: one scan per step for all of them.

A *cell* is one head to fit: a subset of the rows and a regularisation. The features lie in a
written table of dense blocks whose rows carry a bit per subset, so a scan serves every cell
and no subset is ever copied. A scan multiplies each block with the stacked heads and adds up
loss and gradient per cell; the sums of the tasks are merged as a tree and only one vector per
cell reaches the driver, where L-BFGS proposes the cells' next points side by side. Directions
are preconditioned by the features' second moments (the bound of Böhning, 1992, on the
softmax Hessian), so few scans are needed; a cell that is done takes part no more.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftlab.operators.tree import list_column, list_rows, tree_sum
from shiftlab.sources.tables import written

#: Rows and bytes of a block of features.
BLOCK_ROWS, BLOCK_BYTES = 4096, 8 * 1024 * 1024
#: Partitions of one batch, and bytes of gradients that reach the driver in a step.
GATHERED_PARTS, GATHERED_BYTES = 64, 64 * 1024 * 1024
#: Subsets that one block table can tell apart (bits of a long, without its sign).
MAX_SUBSETS = 62
#: Widest features whose full second moments are used; wider ones take their variances.
MOMENT_WIDTH = 2048
#: A cell is done when no entry of its gradient, per standardised feature, is above this.
GRADIENT = 5e-4
#: Steps that L-BFGS remembers, and bytes of heads that are fitted together.
MEMORY, STACK_BYTES = 10, 16 * 1024 * 1024

_BLOCK = "slice string, n long, width int, x binary, y binary, members binary"


def feature_blocks(items: DataFrame, members: F.Column, features: str = "features", label: str = "y_true",
                   slice_col: str = "split") -> DataFrame:
    """``items`` as a written table of dense blocks: float32 features, labels and the bits of
    ``members`` (long). Rows without a vector or a label are left out."""
    return written(_as_blocks(items, members, features, label, slice_col), "feature-blocks")


def _as_blocks(items: DataFrame, members: F.Column, features: str, label: str, slice_col: str) -> DataFrame:
    """The blocks of :func:`feature_blocks`, a partition's rows in its own blocks."""
    rows = items.select(F.col(slice_col).cast("string").alias("slice"), F.col(features).cast("array<float>").alias("x"),
                        F.col(label).cast("int").alias("y"), members.cast("long").alias("m"))
    rows = rows.filter("x is not null and y is not null")

    def run(batches):
        held, width = {}, None

        def block(name, parts):
            x, y, m = (np.concatenate(p) for p in zip(*parts))
            return pa.RecordBatch.from_arrays(
                [pa.array([name], pa.string()), pa.array([len(y)]), pa.array([x.shape[1]], pa.int32()),
                 pa.array([x.tobytes()], pa.binary()), pa.array([y.tobytes()], pa.binary()),
                 pa.array([m.tobytes()], pa.binary())], names=["slice", "n", "width", "x", "y", "members"])

        for b in batches:
            if not b.num_rows:
                continue
            x = list_rows(b.column(1), np.float32)
            width = width or x.shape[1]
            if x.shape[1] != width:
                raise ValueError("feature vectors differ in width")
            y, m = b.column(2).to_numpy().astype(np.int32), b.column(3).to_numpy().astype(np.int64)
            most = max(1, min(BLOCK_ROWS, BLOCK_BYTES // (4 * max(width, 1))))
            names = np.array([s if s is not None else "" for s in b.column(0).to_pylist()], object)
            null = np.array([s is None for s in b.column(0).to_pylist()])
            for name in {(n, z) for n, z in zip(names.tolist(), null.tolist())}:
                at = np.flatnonzero((names == name[0]) & (null == name[1]))
                while len(at):
                    parts = held.setdefault(name, [])
                    take, at = np.split(at, [most - sum(len(p[1]) for p in parts)])
                    parts.append((x[take], y[take], m[take]))
                    if sum(len(p[1]) for p in parts) >= most:
                        yield block(None if name[1] else name[0], held.pop(name))
        for name, parts in held.items():
            yield block(None if name[1] else name[0], parts)

    return rows.mapInArrow(run, _BLOCK)


def batch_parts(batch_size: int, parameters: int) -> int:
    """Partitions of one batch of :func:`batch_blocks`: whole blocks each, and no more than
    send ``GATHERED_BYTES`` of gradients to the driver in a step."""
    return max(1, min(-(-batch_size // BLOCK_ROWS), GATHERED_PARTS, GATHERED_BYTES // (8 * max(parameters, 1))))


def batch_blocks(draws: DataFrame, batch_size: int, n_batches: int, parts: int, features: str = "features",
                 label: str = "y_true", draw: str = "draw") -> RDD:
    """Drawn rows as blocks kept on the executors' disks (``unpersist`` frees them): batch ``b``
    lies in the partitions ``b * parts`` to ``b * parts + parts - 1`` alone, in order of the draws."""
    place = F.expr(f"{draw} div {int(batch_size)} * {int(parts)} + {draw} % {int(batch_size)} * {int(parts)} div {int(batch_size)}")
    dealt = draws.repartitionById(n_batches * parts, place.cast("int")).sortWithinPartitions(draw)
    return _as_blocks(dealt.withColumn("_slice", F.lit("batch")), F.lit(1), features, label, "_slice") \
        .select("n", "width", "x", "y").rdd.persist(StorageLevel.DISK_ONLY)


def batch_sums(blocks: RDD, partitions: list[int], w: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sums of :func:`loss_and_gradient` over some partitions of :func:`batch_blocks`: one job
    without a shuffle whose tasks read these partitions alone and return a vector each."""
    def run(rows):
        total = None
        for r in rows:
            x = np.frombuffer(r["x"], np.float32).reshape(r["n"], r["width"]).astype(np.float64)
            v = _softmax_sums(x, np.frombuffer(r["y"], np.int32), w, b)
            total = v if total is None else total + v
        return [] if total is None else [total]
    return sum(blocks.context.runJob(blocks, run, partitions), np.zeros(1 + w.size + b.size))


def _arrays(batch: pa.RecordBatch):
    for i in range(batch.num_rows):
        n, d = batch.column("n")[i].as_py(), batch.column("width")[i].as_py()
        x = np.frombuffer(batch.column("x")[i].as_py(), np.float32).reshape(n, d).astype(np.float64)
        yield (batch.column("slice")[i].as_py(), x, np.frombuffer(batch.column("y")[i].as_py(), np.int32),
               np.frombuffer(batch.column("members")[i].as_py(), np.int64))


def _bit(members: np.ndarray, subset: int) -> np.ndarray:
    return (members >> subset & 1).astype(bool)


def _summed(blocks: DataFrame, add, keys: str, names: list[str], tasks: int | None = None) -> list:
    """Run ``add`` (block -> key and vector pairs) over all blocks; one vector per key comes
    back. ``tasks`` bounds the number of tasks (there are not more than blocks)."""
    def run(batches):
        from pyspark import TaskContext
        total: dict[tuple, np.ndarray] = {}
        for b in batches:
            for block in _arrays(b):
                for key, v in add(*block):
                    total[key] = total[key] + v if key in total else v
        task = TaskContext.get().partitionId()
        for key, v in total.items():
            yield pa.RecordBatch.from_arrays(
                [*[pa.array([k], pa.int32()) for k in key], pa.array([task], pa.int64()),
                 list_column(v[None, :]), pa.array([1], pa.int64())], names=[*names, "_t", "_s", "_n"])
    parts = blocks.mapInArrow(run, f"{keys}, _t long, _s array<double>, _n long")
    return tree_sum(parts, names, tasks=tasks).drop("_n").collect()


def _lower_inverse(low: np.ndarray) -> np.ndarray:
    """Inverse of a lower triangular matrix, by halves."""
    n = len(low)
    out = np.zeros_like(low)
    if n <= 32:
        for i in range(n):
            out[i, i] = 1.0
            out[i] = (out[i] - low[i, :i] @ out[:i]) / low[i, i]
        return out
    h = n // 2
    a, c = _lower_inverse(low[:h, :h]), _lower_inverse(low[h:, h:])
    out[:h, :h], out[h:, h:], out[h:, :h] = a, c, -c @ (low[h:, :h] @ a)
    return out


def _inverse(positive: np.ndarray) -> np.ndarray:
    """Inverse of a symmetric positive definite matrix."""
    low = _lower_inverse(np.linalg.cholesky(positive))
    return low.T @ low


@dataclass
class Moments:
    """Rows of a subset: their number, classes, and the features' means, spreads and (where
    narrow enough) correlations."""

    n: int
    classes: np.ndarray
    mean: np.ndarray
    spread: np.ndarray
    correlation: np.ndarray | None


def moments(blocks: DataFrame, subsets: list[int], n_classes: int, tasks: int | None = None) -> dict[int, Moments]:
    """One scan. Subsets without rows are missing."""
    rows = 64                                                    # of the second moments in one vector

    def add(_, x, y, members):
        for s in subsets:
            m = _bit(members, s)
            if not m.any():
                continue
            z = x[m]
            yield (s, -1), np.concatenate([np.bincount(y[m], minlength=n_classes), z.sum(axis=0), (z * z).sum(axis=0)])
            if z.shape[1] <= MOMENT_WIDTH:
                second = z.T @ z
                for at in range(0, len(second), rows):
                    yield (s, at // rows), second[at:at + rows].ravel()

    found: dict[int, dict[int, np.ndarray]] = {}
    for r in _summed(blocks, add, "subset int, part int", ["subset", "part"], tasks):
        found.setdefault(r["subset"], {})[r["part"]] = np.array(r["_s"])
    out = {}
    for s, parts in found.items():
        first = parts.pop(-1)
        classes, d = first[:n_classes], (len(first) - n_classes) // 2
        n = int(classes.sum())
        mean = first[n_classes:n_classes + d] / n
        spread = np.sqrt(np.maximum(first[n_classes + d:] - n * mean ** 2, 0) / max(n - 1, 1))
        spread[spread <= 1e-9 * np.maximum(np.abs(mean), 1)] = 0.0
        correlation = None
        if parts:
            second = np.concatenate([parts[i] for i in sorted(parts)]).reshape(d, d)
            scale = np.where(spread > 0, spread, 1.0)
            correlation = (second / n - np.outer(mean, mean)) / np.outer(scale, scale)
        out[s] = Moments(n, classes, mean, spread, correlation)
    return out


def _softmax_sums(x: np.ndarray, label: np.ndarray, w: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sum of the rows' cross-entropies, then its gradient by W (row by row) and b."""
    score = x @ w.T + b
    score -= score.max(axis=1, keepdims=True)
    at = np.arange(len(label))
    own = score[at, label]
    np.exp(score, out=score)
    total = score.sum(axis=1)
    loss = np.log(total) - own
    score /= total[:, None]
    score[at, label] -= 1
    return np.concatenate([[loss.sum()], (score.T @ x).ravel(), score.sum(axis=0)])


def loss_and_gradient(blocks: DataFrame, heads: list[tuple[int, np.ndarray, np.ndarray]],
                      tasks: int | None = None) -> list[np.ndarray]:
    """For every head (subset, W, b): the sum of the cross-entropies of the subset's rows, then
    the gradient of that sum by W (row by row) and b. One scan."""
    shared = blocks.sparkSession.sparkContext.broadcast(heads)

    def add(_, x, y, members):
        part: dict[int, tuple] = {}
        for c, (s, w, b) in enumerate(shared.value):
            if s not in part:
                m = _bit(members, s)
                part[s] = (x, y) if m.all() else (x[m], y[m])
            z, label = part[s]
            if not len(label):
                continue
            yield (c,), _softmax_sums(z, label, w, b)

    out: list = [None] * len(heads)
    for r in _summed(blocks, add, "cell int", ["cell"], tasks):
        out[r["cell"]] = np.array(r["_s"])
    shared.unpersist()
    return out


@dataclass
class Cell:
    """One head on its way: the point in standardised features (last column: intercepts)."""

    subset: int
    reg: float
    stats: Moments
    point: np.ndarray
    inverse: np.ndarray
    live: np.ndarray                                     # classes that the subset has
    value: float = np.inf
    gradient: np.ndarray | None = None
    steps: list = field(default_factory=list)            # (step, change of gradient) of the last accepted steps
    direction: np.ndarray | None = None
    length: float = 1.0
    done: bool = False

    @classmethod
    def start(cls, subset: int, reg: float, m: Moments) -> "Cell":
        live = m.classes > 0
        d = len(m.mean)
        point = np.zeros((len(live), d + 1))
        point[live, d] = np.log(m.classes[live] / m.n)
        curve = np.zeros((d + 1, d + 1))
        curve[:d, :d] = 0.5 * (m.correlation if m.correlation is not None else np.eye(d))
        curve[d, d] = 0.5
        curve[np.arange(d), np.arange(d)] += reg + 1e-6
        dead = np.flatnonzero(m.spread == 0)
        curve[dead, :] = curve[:, dead] = 0
        curve[dead, dead] = 1
        return cls(subset, reg, m, point, _inverse(curve), live)

    def head(self, point: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
        """The head in the features as they are; classes the subset lacks never win."""
        s = self.stats.spread
        w = np.divide(point[:, :-1], s, out=np.zeros_like(point[:, :-1]), where=s > 0)
        w[~self.live] = 0
        return self.subset, w, np.where(self.live, point[:, -1] - w @ self.stats.mean, -np.inf)

    def proposal(self) -> np.ndarray:
        return self.point if self.direction is None else self.point + self.length * self.direction

    def take(self, sums: np.ndarray, tolerance: float) -> None:
        """Accept or shorten the step to the proposal, whose sums over all rows are given."""
        c, d = len(self.live), len(self.stats.mean)
        at = self.proposal()
        s = self.stats.spread
        by_w, by_b = sums[1:1 + c * d].reshape(c, d), sums[1 + c * d:]
        g = np.zeros((c, d + 1))
        g[:, :d] = np.divide(by_w - np.outer(by_b, self.stats.mean), s, out=np.zeros((c, d)), where=s > 0)
        g[:, d] = by_b
        g /= self.stats.n
        g[:, :d] += self.reg * at[:, :d]
        g[~self.live] = 0
        value = sums[0] / self.stats.n + 0.5 * self.reg * float((at[:, :d] ** 2).sum())
        if self.direction is not None:
            slope = float((self.gradient * self.direction).sum())
            if value > self.value + 1e-4 * self.length * slope + 1e-13 * max(abs(self.value), 1e-3):
                self.length /= 2
                if self.length < 1e-8:                     # no further at this precision
                    self.done = True
                return
            step, change = at - self.point, g - self.gradient
            if float((step * change).sum()) > 1e-14:
                self.steps = (self.steps + [(step, change)])[-MEMORY:]
        self.point, self.value, self.gradient = at, value, g
        self.done = float(np.abs(g).max(initial=0.0)) <= tolerance
        if not self.done:
            self._aim()

    def _aim(self) -> None:
        q, kept = self.gradient.copy(), []
        for step, change in reversed(self.steps):
            rho = 1.0 / float((step * change).sum())
            a = rho * float((step * q).sum())
            q -= a * change
            kept.append((a, rho))
        scale = 1.0
        if self.steps:
            step, change = self.steps[-1]
            scale = float((step * change).sum()) / float((change * (change @ self.inverse)).sum())
        r = scale * (q @ self.inverse)
        for (step, change), (a, rho) in zip(self.steps, reversed(kept)):
            r += step * (a - rho * float((change * r).sum()))
        self.direction, self.length = -r, 1.0

    @property
    def largest(self) -> float:
        return float(np.abs(self.gradient).max(initial=0.0))


@dataclass
class Fitted:
    w: np.ndarray
    b: np.ndarray
    gradient: float
    scans: int


def fit_heads(blocks: DataFrame, cells: list[tuple[int, float]], n_classes: int, max_steps: int = 500,
              tolerance: float = GRADIENT) -> list[Fitted | None]:
    """Fit a head per cell (subset, regularisation): mean cross-entropy of the subset's rows
    plus ``reg / 2`` times the squared weights per standardised feature (intercepts free).

    None for a subset without rows. Raises if a cell is not done after ``max_steps`` scans.
    Cells are fitted together as long as their heads take ``STACK_BYTES``.
    """
    tasks = blocks.count()
    stats = moments(blocks, sorted({s for s, _ in cells}), n_classes, tasks)
    out: list[Fitted | None] = [None] * len(cells)
    todo = [i for i, (s, _) in enumerate(cells) if s in stats]
    while todo:
        one = 8 * n_classes * (len(stats[cells[todo[0]][0]].mean) + 1)
        now, todo = np.split(np.array(todo), [max(1, STACK_BYTES // one)])
        todo = todo.tolist()
        states = {int(i): Cell.start(*cells[int(i)], stats[cells[int(i)][0]]) for i in now}
        for scan in range(1, max_steps + 1):
            open_ = [i for i, c in states.items() if not c.done]
            if not open_:
                break
            found = loss_and_gradient(blocks, [states[i].head(states[i].proposal()) for i in open_], tasks)
            for i, sums in zip(open_, found):
                states[i].take(sums, tolerance)
                if states[i].done:
                    _, w, b = states[i].head(states[i].point)
                    out[i] = Fitted(w, b, states[i].largest, scan)
        late = [i for i, c in states.items() if not c.done]
        if late:
            raise RuntimeError(f"{len(late)} linear probes have not converged after {max_steps} steps")
    return out


def evaluate_heads(blocks: DataFrame, heads: list[tuple[np.ndarray, np.ndarray]], slices: list[str] | None = None) -> DataFrame:
    """``(cell, split, y_true, y_pred, n, loss)``: confusion counts (the first of equal scores
    wins) and summed cross-entropy of every head, in one scan."""
    shared = blocks.sparkSession.sparkContext.broadcast(heads)

    def run(batches):
        total: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for name, x, y, _ in _arrays(batch):
                for c, (w, b) in enumerate(shared.value):
                    score = x @ w.T + b
                    top, best = score.max(axis=1), score.argmax(axis=1)
                    inside = (y >= 0) & (y < score.shape[1])
                    own = np.where(inside, score[np.arange(len(y)), np.where(inside, y, 0)], -np.inf)
                    loss = top + np.log(np.exp(score - top[:, None]).sum(axis=1)) - own
                    pair, of = np.unique(np.stack([y, best]), axis=1, return_inverse=True)
                    n, sums = np.bincount(of.ravel()), np.bincount(of.ravel(), weights=loss)
                    for k in range(pair.shape[1]):
                        key = (c, name, int(pair[0, k]), int(pair[1, k]))
                        total[key] = total.get(key, 0) + np.array([n[k], sums[k]])
        if total:
            v = np.stack(list(total.values()))
            cell, name, label, best = zip(*total)
            yield pa.RecordBatch.from_arrays(
                [pa.array(cell, pa.int32()), pa.array(name, pa.string()), pa.array(label, pa.int32()),
                 pa.array(best, pa.int32()), pa.array(v[:, 0].astype(np.int64)), pa.array(v[:, 1])],
                names=["cell", "split", "y_true", "y_pred", "n", "loss"])

    some = blocks if slices is None else blocks.filter(F.col("slice").isin(slices))
    parts = some.mapInArrow(run, "cell int, split string, y_true int, y_pred int, n long, loss double")
    return parts.groupBy("cell", "split", "y_true", "y_pred").agg(F.sum("n").alias("n"), F.sum("loss").alias("loss"))
