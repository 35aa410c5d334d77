"""Document quality by Bradley-Terry ranking.

A document's strength is a linear function of its features; a preference pair is a document labelled 1
over one labelled 0, and the weights minimise the logistic loss on the pairs' feature differences
(Newton steps, a small ridge). The threshold is a quantile of the training rows' strengths: the one that sets
fewest rows on the wrong side. Scores are logistic in the distance from that quantile and equal ``cut`` on it.

Features come from the text alone: shares of letters, marks and digits, repeated words and lines,
lengths. Training takes every labelled row outside the held-out fold and every pair of a good and a bad one;
scoring covers every row and whole texts.

The rows stay on the executors, in blocks of features. A pair's loss is a smooth function of the difference of two
strengths, so it is interpolated between nodes ``STEP`` apart in both strengths (16 nodes around each; the error of a pair is under 1e-9):
each block sums its rows' weights and features by node and class, and the driver joins the nodes of both classes,
a few hundred numbers each, whatever the number of pairs.

Defined results: null and empty texts have the features of no words and are scored like any other; with
labels of one class only, or none, every score is 0.5; rows without an id are scored.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, ordered_positions, text_bytes
from .labelled import fold, training_labels

NAMES = ("words", "upper", "shouts", "bars", "symbols", "digits", "stutter", "variety", "line_repeats", "word_length", "stops", "lines", "any_shouts", "any_bars", "any_symbols", "any_stutter", "any_upper")
STEP, AROUND = 0.25, np.arange(-7, 9)  # strengths are interpolated from the nodes around them, STEP apart
_BETWEEN = np.array([np.prod([float(a - b) for b in AROUND if b != a]) for a in AROUND])
BLOCK = 20_000  # rows a task of a training pass, about


def features(raw: bytes) -> list[float]:
    n = len(raw)
    h = np.bincount(np.frombuffer(raw, np.uint8), minlength=128)
    words, lines = raw.split(), raw.split(b"\n")
    k = max(1, len(words))
    upper = int(h[65:91].sum())
    letters = max(1, upper + int(h[97:123].sum()))
    symbols = int(h[[35, 36, 37, 38, 42, 43, 47, 60, 61, 62, 64, 91, 92, 93, 94, 95, 96, 123, 125, 126]].sum())
    stutter = sum(map(eq, words, islice(words, 1, None))) / k
    shouts, bars, marks = int(h[33]) / k, int(h[124]) / k, symbols / k
    some = lambda x: x / (x + 0.05)
    return [
        math.log1p(len(words)), upper / letters, shouts, bars, marks, int(h[48:58].sum()) / max(1, n), stutter,
        math.log1p(len(set(words))) / math.log(k + 2), 1 - len(set(lines)) / max(1, len(lines)), min(20.0, n / k), (int(h[46]) + int(h[44])) / k, len(lines) / k,
        some(shouts), some(bars), some(marks), some(stutter), some(max(0.0, upper / letters - 0.15)),
    ]


class Ranker:
    """A fitted Bradley-Terry model: strengths are linear in standardised features."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray, threshold: float, cut: float):
        self.mean, self.scale, self.weights, self.threshold, self.cut = mean, scale, weights, threshold, cut

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6)

    def strength(self, x: np.ndarray) -> np.ndarray:
        return (self.standard(x) * self.weights).sum(axis=1)  # row by row: the same in any batch

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.strength(x) - self.threshold + math.log(self.cut / (1 - self.cut))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def newton(pairs: Callable[[np.ndarray], tuple[float, np.ndarray, Callable[[], np.ndarray]]], size: int, ridge: float) -> np.ndarray:
    """The weights of least mean loss and ridge; ``pairs`` gives the mean loss over all pairs, its gradient, and on demand its curvature."""
    w = np.zeros(size)
    loss, g, curvature = pairs(w)
    for _ in range(60):
        g, loss = g + ridge * w, loss + ridge / 2 * float(w @ w)
        step, t = np.linalg.solve(curvature() + ridge * np.eye(size), g), 1.0
        while True:
            new = w - t * step
            there = pairs(new)
            if t < 1e-6 or there[0] + ridge / 2 * float(new @ new) <= loss - 1e-4 * t * float(g @ step) + 1e-11:
                break
            t /= 2
        w, (loss, g, curvature) = new, there
        if np.abs(t * step).max() < 1e-6:  # the next one would be its square
            break
    return w


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, share_rejected: float, cut: float = 0.3, ridge: float = 1e-3) -> Ranker | None:
    """The model from feature rows and labels 0/1 in memory, over the written-out matrix of good x bad rows; None unless both labels are there.

    ``train`` fits the same model to any number of rows.
    """
    if len(y) == 0 or y.min() == y.max():
        return None
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.clip((x - mean) / scale, -6, 6)
    good, bad = z[y == 1], z[y == 0]
    n = len(good) * len(bad)

    def pairs(w: np.ndarray):
        d = (bad @ w)[None, :] - (good @ w)[:, None]
        p = _logistic(d)  # of the pair being the other way round

        def curvature():
            q = p * (1 - p)
            cross = good.T @ q @ bad
            return (good.T @ (good * q.sum(axis=1)[:, None]) + bad.T @ (bad * q.sum(axis=0)[:, None]) - cross - cross.T) / n

        return float(np.logaddexp(0, d).mean()), -(good.T @ p.sum(axis=1) - bad.T @ p.sum(axis=0)) / n, curvature

    w = newton(pairs, z.shape[1], ridge)
    s = z @ w  # the classes may be sampled apart: each row stands for its class's share
    own = np.where(y == 0, share_rejected / (y == 0).sum(), (1 - share_rejected) / (y == 1).sum())
    order = np.argsort(s, kind="stable")
    wrong = np.cumsum(np.where(y == 1, own, -own)[order])  # good rows at or under each quantile cost, bad ones gain
    best = np.flatnonzero(wrong[:-1] <= wrong[:-1].min() + 1e-12)
    i = best[np.argmax(np.diff(s[order])[best])]  # of equally good quantiles, the one in the widest gap
    threshold = (s[order[i]] + s[order[i + 1]]) / 2
    return Ranker(mean, scale, w, float(threshold), cut)


def around(u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first node, weights of the 16 nodes from there) that interpolate a smooth function at the strengths ``u``."""
    cell = np.floor(u / STEP)
    d = (u / STEP - cell)[:, None] - AROUND
    one = np.ones((len(u), 1))
    left = np.cumprod(np.hstack([one, d[:, :-1]]), axis=1)
    right = np.cumprod(np.hstack([one, d[:, :0:-1]]), axis=1)[:, ::-1]
    return cell.astype(np.int64) + AROUND[0], left * right / _BETWEEN


def by_node(u: np.ndarray, z: np.ndarray) -> tuple[int, np.ndarray]:
    """(first node, table): a row for each node with the sums of the rows' weights there and of their features times the weights."""
    first, weights = around(u)
    order = np.argsort(first, kind="stable")
    first, weights, values = first[order], weights[order], np.hstack([np.ones((len(u), 1)), z])[order]
    low = int(first[0])
    table = np.zeros((int(first[-1]) - low + len(AROUND), values.shape[1]))
    starts = np.flatnonzero(np.diff(first, prepend=low - 1))
    for a, b in zip(starts, [*starts[1:], len(u)], strict=True):
        at = int(first[a]) - low
        table[at : at + len(AROUND)] += weights[a:b].T @ values[a:b]
    return low, table


class Blocks:
    """Labelled feature rows on the executors, in sorted blocks; every sum is made block by block and added up in the blocks' order, so reruns agree to the last bit."""

    def __init__(self, rows: DataFrame, n: int):
        """``rows``: ``__id``, ``__label`` and ``__x``; about ``n`` of them."""
        from pyspark import TaskContext

        self.tasks = max(1, math.ceil(n / BLOCK))

        def pack(batches):
            part = TaskContext.get().partitionId()
            for k, b in enumerate(batches):
                if b.num_rows:
                    y = np.array(b.column(0).to_pylist(), np.int8).tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([k], pa.int32()), pa.array([y], pa.binary()), pa.array([_matrix(b.column(1)).tobytes()], pa.binary())], ["part", "nth", "y", "x"])

        dealt = rows.repartition(self.tasks, "__id", "__x").sortWithinPartitions("__id", "__x").select("__label", "__x")
        self.held = materialise(dealt.mapInArrow(pack, "part int, nth int, y binary, x binary")).coalesce(self.tasks)

    def each(self, f: Callable[[np.ndarray, np.ndarray], list[tuple[int, int, np.ndarray]]]) -> list[tuple[int, int, np.ndarray]]:
        """What ``f(x, y)`` gives for each block: (kind, place, numbers), in the blocks' order."""

        made = pa.schema([("part", pa.int32()), ("nth", pa.int32()), ("kind", pa.int32()), ("place", pa.int64()), ("v", pa.binary())])

        def run(batches):
            for b in batches:
                for part, nth, y, x in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    found = f(np.frombuffer(x).reshape(-1, len(NAMES)), np.frombuffer(y, np.int8))
                    for kind, place, numbers in found:
                        yield pa.RecordBatch.from_pylist([{"part": part, "nth": nth, "kind": kind, "place": place, "v": np.ascontiguousarray(numbers, float).tobytes()}], made)

        got = self.held.mapInArrow(run, "part int, nth int, kind int, place long, v binary").collect()  # a node table of each class at most for each block
        return [(r.kind, r.place, np.frombuffer(r.v)) for r in sorted(got, key=lambda r: (r.part, r.nth, r.kind))]

    def moments(self) -> tuple[np.ndarray, np.ndarray, int, int]:
        """Mean and standard deviation of the features, and how many rows are 0 and 1."""
        found = [v for _, _, v in self.each(lambda x, y: [(0, 0, np.concatenate([[(y == 0).sum(), (y == 1).sum()], x.mean(axis=0), ((x - x.mean(axis=0)) ** 2).sum(axis=0)]))])]
        if not found:
            return np.zeros(len(NAMES)), np.zeros(len(NAMES)), 0, 0
        v, d = np.array(found), len(NAMES)
        n = v[:, 0] + v[:, 1]
        mean = (v[:, 2 : 2 + d] * n[:, None]).sum(axis=0) / n.sum()
        square = (v[:, 2 + d :] + n[:, None] * (v[:, 2 : 2 + d] - mean) ** 2).sum(axis=0)
        return mean, np.sqrt(square / n.sum()), int(v[:, 0].sum()), int(v[:, 1].sum())

    def tables(self, model: Ranker) -> list[tuple[int, np.ndarray]]:
        """``by_node`` of the bad and of the good rows at the model's strengths."""

        def f(x, y):
            u, z = model.strength(x), model.standard(x)
            return [(k, *by_node(u[y == k], z[y == k])) for k in (0, 1) if (y == k).any()]

        parts = [(k, low, v.reshape(-1, 1 + len(NAMES))) for k, low, v in self.each(f)]
        out = []
        for k in (0, 1):
            own = [(low, v) for kind, low, v in parts if kind == k]
            low = min(at for at, _ in own)
            table = np.zeros((max(at + len(v) for at, v in own) - low, 1 + len(NAMES)))
            for at, v in own:
                table[at - low : at - low + len(v)] += v
            out.append((low, table))
        return out

    def squares(self, model: Ranker, weights: list[tuple[int, np.ndarray]]) -> np.ndarray:
        """Sum of the rows' squared features (outer products), each times its class's function of strength, given at the nodes."""
        d = len(NAMES)

        def f(x, y):
            u, z, total = model.strength(x), model.standard(x), np.zeros((d, d))
            for k, (low, at_nodes) in enumerate(weights):
                own = y == k
                first, w = around(u[own])
                value = (w * at_nodes[(first - low)[:, None] + np.arange(len(AROUND))]).sum(axis=1)
                total += z[own].T @ (z[own] * value[:, None])
            return [(0, 0, total.ravel())]

        return sum((v for _, _, v in self.each(f)), np.zeros(d * d)).reshape(d, d)

    def strengths(self, model: Ranker) -> DataFrame:
        """(``s``, ``bad``, ``good``): a row for each distinct strength, and how many rows of each class have it."""

        def run(batches):
            for b in batches:
                for y, x in zip(*(b.column(c).to_pylist() for c in (2, 3)), strict=True):
                    s, at = np.unique(model.strength(np.frombuffer(x).reshape(-1, len(NAMES))), return_inverse=True)
                    n = [np.bincount(at, np.frombuffer(y, np.int8) == k, len(s)).astype(np.int64) for k in (0, 1)]
                    yield pa.RecordBatch.from_arrays([pa.array(s), pa.array(n[0]), pa.array(n[1])], ["s", "bad", "good"])

        return self.held.mapInArrow(run, "s double, bad long, good long").groupBy("s").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))


def best_quantile(strengths: DataFrame) -> float:
    """The middle of the gap between two strengths (``s``, ``bad``, ``good``; distinct) with fewest good rows under and bad rows over it; of equally good gaps the widest, then the lowest."""
    placed = ordered_positions(strengths, ["s"], ["bad", "good"])
    wrong = placed.select("s", "position", (F.col("before_good") + F.col("good") - F.col("before_bad") - F.col("bad")).alias("wrong"))
    upper = placed.select((F.col("position") - 1).alias("position"), F.col("s").alias("over"))
    gaps = wrong.join(upper, "position").select("wrong", (F.col("over") - F.col("s")).alias("gap"), "s", "over")
    found = gaps.orderBy("wrong", F.desc("gap"), "s").first()
    return (found.s + found.over) / 2 if found is not None else float(placed.first().s)  # all rows are equally strong


def fit_blocks(blocks: Blocks, cut: float = 0.3, ridge: float = 1e-3) -> Ranker | None:
    """The model over every pair of a good and a bad row of the blocks; None unless both labels are there."""
    mean, deviation, zeros, ones = blocks.moments()
    if not zeros or not ones:
        return None
    scale, n = deviation + 1e-9, float(zeros) * ones

    def pairs(w: np.ndarray):
        model = Ranker(mean, scale, w, 0.0, cut)
        (low_bad, bad), (low_good, good) = blocks.tables(model)
        at_bad, at_good = (low_bad + np.arange(len(bad))) * STEP, (low_good + np.arange(len(good))) * STEP
        loss, d = 0.0, len(w)
        p_good, p_bad, q_good, q_bad, cross = np.zeros(len(good)), np.zeros(len(bad)), np.zeros(len(good)), np.zeros(len(bad)), np.zeros((d, d))
        for a in range(0, len(good), 512):
            own = slice(a, a + 512)
            apart = at_bad[None, :] - at_good[own, None]
            p = _logistic(apart)  # of the pair being the other way round
            q = p * (1 - p)
            loss += float(good[own, 0] @ np.logaddexp(0, apart) @ bad[:, 0])
            p_good[own], q_good[own] = p @ bad[:, 0], q @ bad[:, 0]
            p_bad += good[own, 0] @ p
            q_bad += good[own, 0] @ q
            cross += good[own, 1:].T @ q @ bad[:, 1:]
        g = -(good[:, 1:].T @ p_good - bad[:, 1:].T @ p_bad) / n
        return loss / n, g, lambda: (blocks.squares(model, [(low_bad, q_bad), (low_good, q_good)]) - cross - cross.T) / n

    model = Ranker(mean, scale, newton(pairs, len(NAMES), ridge), 0.0, cut)
    model.threshold = best_quantile(blocks.strengths(model))
    return model


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), len(NAMES))


def described(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(``__id``, ``__x``): the features of every whole text."""
    rows = docs.select(F.col(id_col).alias("__id"), text_bytes().alias("__raw"))

    def run(batches):
        for b in batches:
            x = [features(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.list_(pa.float64()))], ["__id", "__x"])

    return rows.mapInArrow(run, T.StructType([rows.schema["__id"], T.StructField("__x", T.ArrayType(T.DoubleType()))]))


def train(rows: DataFrame, labels: DataFrame, label: str = "quality", cut: float = 0.3, id_col: str = "doc_id") -> Ranker | None:
    """The model from ``described`` rows and all labels outside the held-out fold."""
    own = training_labels(labels, label, id_col)
    return fit_blocks(Blocks(rows.join(own, "__id").select("__id", "__label", "__x"), own.count()), cut)


def _scored(model: Ranker | None, x: list[list[float]] | np.ndarray, n: int) -> np.ndarray:
    return np.full(n, 0.5) if model is None else model.score(np.asarray(x, float).reshape(n, len(NAMES)))


def rank_documents(docs: DataFrame, labels: DataFrame, label: str = "quality", cut: float = 0.3, id_col: str = "doc_id") -> DataFrame:
    """One row per document: id, ``held_out``, ``score``, ``predicted`` (1 if the score is at least ``cut``)."""
    rows = materialise(described(docs, id_col))  # every text is read once
    held = docs.sparkSession.sparkContext.broadcast(train(rows, labels, label, cut, id_col))  # a few hundred numbers

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_scored(held.value, _matrix(b.column(1)), b.num_rows), pa.float64())], ["__id", "score"])

    out = rows.mapInArrow(run, T.StructType([rows.schema["__id"], T.StructField("score", T.DoubleType())])).withColumnRenamed("__id", id_col)
    return out.select(id_col, (fold(id_col) == 0).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, label: str = "quality", cut: float = 0.3, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that score at least ``cut``."""
    held = docs.sparkSession.sparkContext.broadcast(train(described(docs, id_col), labels, label, cut, id_col))
    rows = docs.select(*docs.columns, text_bytes().alias("__raw"))
    names, n = docs.columns, len(docs.columns)

    def run(batches):
        for b in batches:
            x = [] if held.value is None else [features(t.as_py()) for t in b.column(n)]
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(_scored(held.value, x, b.num_rows), pa.float64())], [*names, "__score"])

    scored = rows.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("__score", T.DoubleType())]))
    return scored.filter(F.col("__score") >= cut).drop("__score")
