"""Boosted trees for labels 0 and 1, by the definition of Spark ML's GBTClassifier (logistic loss, variance of residuals,
rounds that end with the loss on rows held out), for several fits on the same rows.

A row is one byte a feature, the number of its bin, and rows lie in blocks of a stored table that all fits share. A tree
level is one job: tasks count their blocks by node, feature and bin, a shuffle sums the counts of each feature and finds
its best split of each node, and the driver takes a row a node and feature."""

from __future__ import annotations

import json
import math
import sys
import zlib
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millwatch.operators.select import Profile, numbers, plain, points
from millwatch.sources.io import stored

# what tasks run goes to executors with the tasks, which need not find this package there
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bins of a feature, rows of a block, and rounds after which the rows' margins are stored, so that a pass walks no more
#: trees than that.
BINS, BLOCK, KEEP = 32, 1 << 15, 5
#: The loss must fall by this share for another round; a split must gain as much.
TOLERANCE, LEAST_GAIN = 0.01, 1e-12


@dataclass
class Tree:
    """Nodes, the root first. A leaf has feature -1; an inner node's rows go left where the bin is not above `bin` (the
    value not above `at`)."""

    feature: list[int] = field(default_factory=list)
    bin: list[int] = field(default_factory=list)
    at: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)
    gain: list[float] = field(default_factory=list)
    depth: int = 0

    def leaf(self, value: float) -> int:
        for of, x in ((self.feature, -1), (self.bin, 255), (self.at, 0.0), (self.left, len(self.value)), (self.value, value), (self.gain, 0.0)):
            of.append(x)
        return len(self.value) - 1

    def nodes(self, x: np.ndarray) -> np.ndarray:
        """The node that each row of a block (features by rows) comes to."""
        rows, flat, node = x.shape[1], x.reshape(-1), np.zeros(x.shape[1], np.int64)
        place = np.arange(rows)
        first, edge = np.maximum(np.array(self.feature), 0) * rows, np.array(self.bin, np.uint8)
        left = np.array(self.left)
        for _ in range(self.depth):
            node = left[node] + (flat[first[node] + place] > edge[node])
        return node

    def sql(self, node: int = 0) -> str:
        if self.feature[node] < 0:
            return _number(self.value[node])
        return f"CASE WHEN _x[{self.feature[node]}] <= {_number(self.at[node])} THEN {self.sql(self.left[node])} ELSE {self.sql(self.left[node] + 1)} END"


def _number(v: float) -> str:
    return f"{v!r}D" if math.isfinite(v) else f"CAST('{v!r}' AS DOUBLE)"


@dataclass
class Trees:
    """A fitted model: trees with their weights; importances by feature."""

    trees: list[Tree]
    weights: list[float]
    features: int

    def probability(self) -> Column:
        """Of label 1, from the array _x of feature values."""
        margin = " + ".join(f"{_number(w)} * {t.sql()}" for t, w in zip(self.trees, self.weights, strict=True))
        return F.expr(f"1 / (1 + exp(-2 * ({margin})))")

    def importances(self) -> list[float]:
        """Gains by the weight of their rows, 1 in all."""
        out = np.zeros(self.features)
        for t in self.trees:
            np.add.at(out, [f for f in t.feature if f >= 0], [g for f, g in zip(t.feature, t.gain, strict=True) if f >= 0])
        return (out / out.sum() if out.sum() > 0 else out).tolist()

    def text(self) -> str:
        return json.dumps({"features": self.features, "weights": self.weights, "trees": [vars(t) for t in self.trees]})

    @classmethod
    def of(cls, text: str) -> Trees:
        d = json.loads(text)
        return cls([Tree(**t) for t in d["trees"]], d["weights"], d["features"])


def edges(told: Profile, fill: float) -> list[float]:
    """The values between a feature's bins: quantiles of all rows, or what lies between the values where they are few.
    Missing values are `fill`."""
    more = [(np.array([fill]), np.array([told.gaps]))] if told.gaps else []
    v, n, _ = points([(told.values, told.rows), *more], sys.maxsize)
    if told.exact and len(v) <= BINS:
        return [(a + b) / 2 if math.isfinite(a + b) else a for a, b in zip(v.tolist(), v[1:].tolist(), strict=False)]
    upto = np.cumsum(n)
    return sorted({float(v[np.searchsorted(upto, math.ceil(k * int(upto[-1]) / BINS))]) for k in range(1, BINS)}) if len(v) else []


@dataclass
class Blocks:
    """Rows in blocks, each with one value of `by`: _n rows, _p with label 1, _h a hash, _y labels, _x bins."""

    table: DataFrame
    edges: list[list[float]]


def pack(df: DataFrame, features: list[str], fills: Mapping[str, float], told: list[Profile], target: str, by: str) -> Blocks:
    """The rows of df in blocks; told: profiles() of the features, whose missing values are those of fills, or 0."""
    n, fill = len(features), [float(fills.get(f, 0.0)) if p.gaps else 0.0 for f, p in zip(features, told, strict=True)]
    ends = [edges(p, x) for p, x in zip(told, fill, strict=True)]
    bounds = [np.array(p, float) for p in ends]
    kind = df.schema[by].dataType
    schema = T.StructType([T.StructField(by, kind), *[T.StructField(c, T.LongType()) for c in ("_n", "_p", "_h")], T.StructField("_y", T.BinaryType()), T.StructField("_x", T.BinaryType())])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}

        def out(key, least: int) -> Iterator[pa.RecordBatch]:
            parts = held[key]
            while parts and sum(len(y) for y, _ in parts) >= least:
                y, x = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts], axis=1)
                held[key] = parts = [(y[BLOCK:], x[:, BLOCK:])] if len(y) > BLOCK else []
                ones, y, x = int(y[:BLOCK].sum()), y[:BLOCK].tobytes(), x[:, :BLOCK].tobytes()
                cols = [[key], [len(y)], [ones], [zlib.crc32(x, zlib.crc32(y))], [y], [x]]
                types = [made[0], pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=schema.names)

        made: list = []
        for batch in batches:
            made[:] = [batch.column(0).type]
            label = batch.column(1).to_numpy(zero_copy_only=False)
            if not np.isin(label, (0, 1)).all():
                raise ValueError(f"{target} must be 0 or 1")
            x = np.empty((n, batch.num_rows), np.uint8)
            for i, b in enumerate(bounds):
                v = numbers(batch.column(2 + i))
                x[i] = np.searchsorted(b, np.where(np.isnan(v), fill[i], v))
            keys = batch.column(0).dictionary_encode(null_encoding="encode")
            codes = keys.indices.to_numpy(zero_copy_only=False)
            for code, key in enumerate(keys.dictionary.to_pylist()):
                mine = codes == code
                held.setdefault(key, []).append((label[mine].astype(np.uint8), x[:, mine]))
                yield from out(key, BLOCK)
        for key in held:
            yield from out(key, 1)

    rows = df.select(by, F.col(target).cast("double").alias("_y"), *plain(df, features))
    return Blocks(stored(rows.mapInArrow(blocks, schema), "blocks", by=[by]), ends)


def _read(batches: Iterator[pa.RecordBatch], n: int, trees: list[Tree], weights: list[float]) -> Iterator[tuple]:
    """(hash, labels, bins, margins) of each block: the stored margins and those of the trees since."""
    for batch in batches:
        for row in range(batch.num_rows):
            get = lambda c, kind: np.frombuffer(batch.column(c)[row].as_buffer(), kind)  # noqa: B023, E731
            y = get("_y", np.uint8)
            x = get("_x", np.uint8).reshape(n, -1)
            m = get("_m", float).copy() if "_m" in batch.schema.names else np.zeros(len(y))
            for t, w in zip(trees, weights, strict=True):
                m += w * np.array(t.value)[t.nodes(x)]
            yield batch.column("_h")[row].as_py(), y, x, m


def _best(n: int, weight: tuple[float, float], nodes: int, least_rows: int, first: bool):
    """Sums a feature's counts and finds its best split of each node."""

    def best(key, group):
        parts = sorted(zip(group.column("task").to_pylist(), group.column("h").to_pylist(), strict=True))
        h = sum(np.frombuffer(b, float) for _, b in parts).reshape(-1, nodes, BINS)
        rows, ones = h[0], h[1]
        w = weight[1] * ones + weight[0] * (rows - ones)
        s = weight[1] * ones - weight[0] * (rows - ones) if first else h[2]
        left = [np.cumsum(a, axis=1) for a in (rows, w, s)]
        whole = [a[:, -1:] for a in left]
        right = [a - b for a, b in zip(whole, left, strict=True)]
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = (left[2] ** 2 / left[1] + right[2] ** 2 / right[1] - whole[2] ** 2 / whole[1]) / whole[1]
        gain[(left[0] < least_rows) | (right[0] < least_rows) | ~np.isfinite(gain)] = -1.0
        at = gain.argmax(axis=1)
        k = np.arange(nodes)
        share = lambda a: np.divide(a[2], a[1], out=np.zeros_like(a[1]), where=a[1] > 0)
        cols = {"node": k.astype(np.int32), "f": np.full(nodes, key[0].as_py(), np.int32), "bin": at.astype(np.int32), "gain": gain[k, at], "rows": whole[0][:, 0], "w": whole[1][:, 0], "value": share(whole)[:, 0], "lv": share(left)[k, at], "rv": share(right)[k, at]}
        return pa.table(cols)

    return best


def _grow(rows: DataFrame, blocks: Blocks, before: list[Tree], weights: list[float], first: bool, weight: tuple[float, float], depth: int, least_rows: int, share: float, seed: list[int]) -> Tree:
    """One tree on the residuals of the trees before, on a share of the rows."""
    n, tree, open_ = len(blocks.edges), Tree(), [0]
    tree.leaf(0.0)
    for level in range(depth):
        slots = np.full(len(tree.value), len(open_))
        slots[open_] = np.arange(len(open_))
        size = (len(open_) + 1) * BINS

        def count(batches, tree=tree, slots=slots, size=size):
            from pyspark import TaskContext

            total = None
            for h, y, x, m in _read(batches, n, before, weights):
                total = np.zeros((n, 2 if first else 3, size)) if total is None else total
                slot = slots[tree.nodes(x)]
                if share < 1:
                    slot[np.random.default_rng([*seed, h]).random(len(y), np.float32) >= share] = size // BINS - 1
                base, ones = slot * BINS, np.flatnonzero(y)
                if not first:
                    sign = 2.0 * y - 1
                    r = np.where(y == 1, weight[1], weight[0]) * 4 * sign / (1 + np.exp(2 * sign * m))
                for f in range(n):
                    at = base + x[f]
                    total[f, 0] += np.bincount(at, minlength=size)
                    total[f, 1] += np.bincount(at[ones], minlength=size)
                    if not first:
                        total[f, 2] += np.bincount(at, weights=r, minlength=size)
            if total is not None:
                told = total[:, :, : size - BINS]
                yield pa.RecordBatch.from_arrays([pa.array(range(n), pa.int32()), pa.array([TaskContext.get().partitionId()] * n, pa.int32()), pa.array([t.tobytes() for t in told], pa.binary())], names=["f", "task", "h"])

        counted = rows.mapInArrow(count, "f int, task int, h binary")
        found = counted.groupBy("f").applyInArrow(_best(n, weight, len(open_), least_rows, first), "node int, f int, bin int, gain double, rows double, w double, value double, lv double, rv double").collect()  # a row a node and feature
        if level == 0:
            if not found or not found[0]["rows"]:
                raise ValueError("no rows to train on")
            tree.value[0] = found[0]["value"]
        opened = []
        for slot, node in enumerate(open_):
            b = max((r for r in found if r["node"] == slot), key=lambda r: (r["gain"], -r["f"]))
            if b["gain"] <= LEAST_GAIN or b["bin"] >= len(blocks.edges[b["f"]]):
                continue
            tree.feature[node], tree.bin[node], tree.at[node], tree.gain[node] = b["f"], b["bin"], float(blocks.edges[b["f"]][b["bin"]]), b["gain"] * b["w"]
            tree.left[node] = tree.leaf(b["lv"])
            opened += [tree.left[node], tree.leaf(b["rv"])]
            tree.depth = level + 1
        open_ = opened
        if not open_:
            break
    return tree


def _loss(rows: DataFrame, n: int, trees: list[Tree], weights: list[float], weight: tuple[float, float]) -> float:
    """Mean weighted logistic loss of the rows."""

    def told(batches):
        loss = of = 0.0
        for _, y, _, m in _read(batches, n, trees, weights):
            w = np.where(y == 1, weight[1], weight[0])
            loss, of = loss + float((w * 2 * np.logaddexp(0, -2 * (2.0 * y - 1) * m)).sum()), of + float(w.sum())
        yield pa.RecordBatch.from_arrays([pa.array([loss]), pa.array([of])], names=["loss", "of"])

    loss, of = rows.mapInArrow(told, "loss double, of double").agg(F.sum("loss"), F.sum("of")).first()
    return loss / of if of else math.nan


def _margins(rows: DataFrame, n: int, trees: list[Tree], weights: list[float]) -> DataFrame:
    """rows, stored with the margins of the trees."""
    schema = T.StructType([T.StructField("_stop", T.BooleanType()), T.StructField("_h", T.LongType()), *[T.StructField(c, T.BinaryType()) for c in ("_y", "_x", "_m")]])

    def add(batches):
        for batch in batches:
            made = [m.tobytes() for _, _, _, m in _read(iter([batch]), n, trees, weights)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("_stop", "_h", "_y", "_x")] + [pa.array(made, pa.binary())], names=schema.names)

    return stored(rows.mapInArrow(add, schema), "margins", by=["_stop"])


def fit(blocks: Blocks, stop: Column, rounds: int, depth: int, step: float, seed: int, share: float, least_rows: int) -> Trees:
    """A model of the blocks outside `stop`, classes having equal weight; those of `stop` end the rounds."""
    n, all_ = len(blocks.edges), blocks.table.withColumn("_stop", stop)
    total, ones = all_.where(~F.col("_stop")).agg(F.coalesce(F.sum("_n"), F.lit(0)), F.coalesce(F.sum("_p"), F.lit(0))).first()
    weight = (total / (2 * max(total - ones, 1)), total / (2 * max(ones, 1)))
    trees, weights, kept, best, keep = [], [], 0, math.inf, 1
    rows = all_.select("_stop", "_h", "_y", "_x")
    for m in range(rounds):
        if m and m % KEEP == 0:
            rows, kept = _margins(rows, n, trees[kept:], weights[kept:]), m
        trees.append(_grow(rows.where(~F.col("_stop")), blocks, trees[kept:], weights[kept:], not m, weight, depth, least_rows, share, [seed, m]))
        weights.append(step if m else 1.0)
        loss = _loss(rows.where("_stop"), n, trees[kept:], weights[kept:], weight)
        if not m:
            best = loss
        elif best - loss < TOLERANCE * max(loss, 0.01):
            break
        elif loss < best:
            best, keep = loss, m + 1
    return Trees(trees[:keep], weights[:keep], n)
