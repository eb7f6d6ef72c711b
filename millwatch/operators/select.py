"""Values and cuts at given ranks, exact, without ordering rows or values.

Columns are read together, pass after pass. The first pass counts values by sign and power of two; each later one counts
the values of the bins that hold an asked rank in `BINS` equal parts of that bin's own range, least and greatest value
known. A bin's range shrinks to one value, or few values are left and are counted as they are. So a pass shuffles a row
for each bin a task meets, never a row for each value, and the driver holds some numbers for each column and rank. Of many
columns a value isn't even a row within a task, which sorts and counts its batches as arrays.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millwatch.sources.io import stored

# what tasks run goes to executors with the tasks, which need not find this package there
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Parts of a bin; values that are counted one by one; columns or targets whose bins the driver takes (a few thousand
#: small rows each), where Spark's own look-up would be jobs more.
BINS, FEW, FEW_COLUMNS = 4096, 1 << 16, 16
#: Values of a column that a task gathers before it keeps some of them; points that it tells of them.
HELD, POINTS = 1 << 16, 1 << 12


@dataclass
class Profile:
    """What all rows say of a feature: how many miss it, and its values with the rows of each, ascending; `exact`: all
    values, else points whose places are right within some thousandth of the rows."""

    gaps: int
    values: np.ndarray
    rows: np.ndarray
    exact: bool

    def at(self, share: float) -> float:
        """The exact percentile, between two values by their distance."""
        upto = np.cumsum(self.rows)
        rank = share * (int(upto[-1]) - 1)
        x, y = (float(self.values[np.searchsorted(upto, end(rank), "right")]) for end in (math.floor, math.ceil))
        f = rank - math.floor(rank)
        return x if x == y else x * (1 - f) + y * f


def points(parts: list[tuple[np.ndarray, np.ndarray]], most: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """Values with their rows, ascending, equal ones together. Of more than `most` the last of each `most`-th part of the
    rows, with the part's rows."""
    v, n = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, kind) for i, kind in enumerate((float, np.int64)))
    if not len(v):
        return v, n, True
    order = np.argsort(v, kind="stable")
    v, n = v[order], n[order]
    first = np.flatnonzero(np.append(True, v[1:] != v[:-1]))
    v, n = v[first], np.add.reduceat(n, first)
    if len(v) <= most:
        return v, n, True
    upto = np.cumsum(n)
    part = (upto - 1) // max(1, -(-int(upto[-1]) // most))
    last = np.flatnonzero(np.append(part[1:] != part[:-1], True))
    return v[last], np.diff(upto[last], prepend=0), False


def plain(df: DataFrame, features: list[str]) -> list[Column]:
    """The features as numbers that tasks read as arrays; a cast is left out where it isn't needed."""
    kinds = dict(df.dtypes)
    return [F.col(f"`{f}`").alias(f"_x{i}") if kinds.get(f) in ("double", "float", "bigint", "int", "smallint", "tinyint") else F.col(f).cast("double").alias(f"_x{i}") for i, f in enumerate(features)]


def numbers(column: pa.Array) -> np.ndarray:
    """Doubles, NaN where a value is missing."""
    return column.to_numpy(zero_copy_only=False).astype(float, copy=False)


def profiles(df: DataFrame, features: list[str]) -> list[Profile]:
    """Of each feature, in one pass: tasks sort their batches, gather up to HELD values and keep some of them."""
    n = len(features)

    def told(batches):
        from pyspark import TaskContext

        held, gaps, exact = [[] for _ in range(n)], np.zeros(n, np.int64), np.ones(n, bool)

        def fewer(i: int, most: int) -> None:
            v, w, whole = points(held[i], most)
            held[i], exact[i] = [(v, w)], exact[i] and whole

        for batch in batches:
            for i in range(n):
                x = numbers(batch.column(i))
                here = x[~np.isnan(x)]
                gaps[i] += len(x) - len(here)
                held[i].append(np.unique(here, return_counts=True))
                if sum(len(v) for v, _ in held[i]) > HELD:
                    fewer(i, HELD // 8)
        for i in range(n):
            fewer(i, POINTS)
        cols = [list(range(n)), [TaskContext.get().partitionId()] * n, gaps.tolist(), [h[0][0].tobytes() for h in held], [h[0][1].astype(np.int64).tobytes() for h in held], exact.tolist()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.bool_()), strict=True)], names=["f", "task", "gaps", "v", "w", "exact"])

    def together(key, group):
        rows = sorted(group.select(["task", "v", "w"]).to_pylist(), key=lambda r: r["task"])
        v, w, whole = points([(np.frombuffer(r["v"], float), np.frombuffer(r["w"], np.int64)) for r in rows], 2 * POINTS)
        exact = whole and all(group.column("exact").to_pylist())
        return pa.table({"f": pa.array([key[0].as_py()], pa.int32()), "gaps": pa.array([sum(group.column("gaps").to_pylist())], pa.int64()), "v": pa.array([v.tobytes()], pa.binary()), "w": pa.array([w.tobytes()], pa.binary()), "exact": [exact]})

    parts = df.select(*plain(df, features)).mapInArrow(told, "f int, task int, gaps long, v binary, w binary, exact boolean")
    found = {r["f"]: r for r in parts.groupBy("f").applyInArrow(together, "f int, gaps long, v binary, w binary, exact boolean").collect()}  # a row a feature
    empty = {"gaps": 0, "v": b"", "w": b"", "exact": True}
    rows = [found.get(i, empty) for i in range(n)]
    return [Profile(r["gaps"], np.frombuffer(r["v"], float), np.frombuffer(r["w"], np.int64), r["exact"]) for r in rows]


@dataclass
class Place:
    """A value, the rows below it and the rows equal to it."""

    value: float | int
    below: int
    equal: int


def _coarse(x: Column) -> Column:
    """Sign and power of two: never falls where x rises, whatever the logarithm's last digit."""
    power = F.floor(F.least(F.log2(F.abs(x)), F.lit(2000.0))).cast("int") + 1100
    return F.when(x == 0, 0).when(x > 0, power).otherwise(-power)


def _values(df: DataFrame, cols: list[str], only: list[int], kind: str) -> DataFrame:
    """(c int, x) of the columns numbered `only`, without nulls and NaN."""
    x = F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.col(cols[i]).cast(kind).alias("x")) for i in only])).alias("p")
    line = df.select(x).select("p.*").where(F.col("x").isNotNull())
    return line.where(~F.isnan("x")) if kind == "double" else line


def _bins(line: DataFrame, part: Column, by: list[str]) -> DataFrame:
    return line.groupBy(*by, part.alias("bin")).agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))


#: Bins of a column in the first pass of arrays, and the one of zero.
COARSE, ZERO = 6400, 3200


class _Held:
    """A task's bins of one column or target."""

    def __init__(self, size: int):
        self.n, self.lo, self.hi = np.zeros(size, np.int64), np.full(size, np.inf), np.full(size, -np.inf)

    def add(self, x: np.ndarray, part: np.ndarray) -> None:
        """x ascending, and with it their bins."""
        first = np.flatnonzero(np.diff(part, prepend=-1))
        last, at = np.append(first[1:], len(part)) - 1, part[first]
        self.n[at] += last - first + 1
        self.lo[at], self.hi[at] = np.minimum(self.lo[at], x[first]), np.maximum(self.hi[at], x[last])


def _counted(df: DataFrame, cols: list[str], spans: list[tuple] | None, each: bool = False) -> DataFrame:
    """(g, bin, n, lo, hi) of each column by sign and power of two, or of the parts of each span (g, c, lo, hi); each: (g, x,
    n) of the spans' values."""
    only = list(range(len(cols))) if spans is None else sorted({s[1] for s in spans})
    of = {c: [s for s in spans or () if s[1] == c] for c in only}

    def count(batches):
        held: dict = {}
        for batch in batches:
            for i, c in enumerate(only):
                x = batch.column(i).to_numpy(zero_copy_only=False)
                x = np.sort(x[~np.isnan(x)])
                if spans is None and len(x):
                    power = np.where(np.isinf(x), 2001, np.frexp(x)[1]) + 1099
                    held.setdefault(c, _Held(COARSE)).add(x, ZERO + np.where(x == 0, 0, np.where(x > 0, power, -power)))
                for g, _, lo, hi in of[c]:
                    mine = x[np.searchsorted(x, lo, "left") : np.searchsorted(x, hi, "right")]
                    if each:
                        held.setdefault(g, []).append(mine)
                    elif len(mine):
                        with np.errstate(invalid="ignore", over="ignore"):
                            part = np.nan_to_num((mine - lo) / (np.float64(hi) - lo)) * BINS
                        held.setdefault(g, _Held(BINS)).add(mine, np.minimum(part, BINS - 1).astype(np.int64))
        for g, h in held.items():
            if each:
                x, n = np.unique(np.concatenate(h), return_counts=True)
                told = {"g": np.full(len(x), g, np.int32), "x": x, "n": n}
            else:
                at = np.flatnonzero(h.n)
                told = {"g": np.full(len(at), g, np.int32), "bin": (at - (ZERO if spans is None else 0)).astype(np.int32), "n": h.n[at], "lo": h.lo[at], "hi": h.hi[at]}
            yield pa.RecordBatch.from_pydict(told)

    line = df.select(*[F.col(cols[c]).cast("double").alias(f"_x{c}") for c in only])
    if each:
        return line.mapInArrow(count, "g int, x double, n long").groupBy("g", "x").agg(F.sum("n").alias("n"))
    return line.mapInArrow(count, "g int, bin int, n long, lo double, hi double").groupBy("g", "bin").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))


class Bins:
    """A pass's bins (g, bin, n, lo, hi): on the driver where they are of a few columns or targets, else as a table."""

    def __init__(self, df: DataFrame, few: bool):
        self.df, self.rows = (None, {}) if few else (stored(df, "bins"), None)
        if few:
            for r in df.collect():
                self.rows.setdefault(r["g"], []).append((r["bin"], r["n"], r["lo"], r["hi"]))
            for line in self.rows.values():
                line.sort()

    def sizes(self) -> dict[int, int]:
        if self.rows is not None:
            return {g: sum(n for _, n, _, _ in line) for g, line in self.rows.items()}
        return {r["g"]: r["n"] for r in self.df.groupBy("g").agg(F.sum("n").alias("n")).collect()}  # a row a column

    def find(self, want: list[tuple[int, int, int]]) -> list[tuple]:
        """(i, n, lo, hi, before) of the bin that holds rank r of g, for each (i, g, r)."""
        if self.rows is None:
            asked = F.broadcast(self.df.sparkSession.createDataFrame(want, "i int, g int, r long"))
            line = self.df.withColumn("before", F.coalesce(F.sum("n").over(W.partitionBy("g").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
            return [tuple(x) for x in line.join(asked, "g").where("r >= before and r < before + n").select("i", "n", "lo", "hi", "before").collect()]  # a row a target
        out = []
        for i, g, r in want:
            before = 0
            for _, n, lo, hi in self.rows[g]:
                if r < before + n:
                    out.append((i, n, lo, hi, before))
                    break
                before += n
        return out


def places(df: DataFrame, cols: list[str], ask: Callable[[int], dict], kind: str = "double", arrays: bool | None = None) -> dict[tuple[str, object], Place]:
    """{(column, tag): Place} for the ranks (from 0, smallest first) that `ask` names by tag, given a column's number of
    values. A column without values has none. kind: double, or bigint for whole numbers. df is read once a pass. arrays:
    whether tasks count doubles as arrays; many columns they do."""
    spark, arrays = df.sparkSession, kind == "double" and (len(cols) > FEW_COLUMNS if arrays is None else arrays)
    coarse = _counted(df, cols, None) if arrays else _bins(_values(df, cols, range(len(cols)), kind), _coarse(F.col("x").cast("double")), ["c"]).withColumnRenamed("c", "g")
    held = Bins(coarse, len(cols) <= FEW_COLUMNS)
    asked = [(c, t, r) for c, m in held.sizes().items() for t, r in ask(m).items()]
    if not asked:
        return {}
    out: dict[int, tuple] = {}
    # target: its column, rank among the values of its bin, values below the bin
    live, group = {i: (c, r, 0) for i, (c, _, r) in enumerate(asked)}, {i: c for i, (c, _, _) in enumerate(asked)}
    widths: dict[int, tuple] = {}
    while live:
        found = held.find([(i, group[i], r) for i, (_, r, _) in live.items()])
        stuck = True
        for i, n, lo, hi, before in found:
            c, r, below = live.pop(i)
            if lo == hi:
                out[i] = Place(lo, below + before, n)
                continue
            stuck = stuck and widths.get(i) == (lo, hi)
            widths[i] = (lo, hi)
            live[i], group[i] = (c, r - before, below + before), (c, lo, hi, n)
        if not live:
            break
        spans = {s: g for g, s in enumerate(dict.fromkeys(group[i] for i in live))}
        only, told = sorted({s[0] for s in spans}), [(g, *s[:3]) for s, g in spans.items()]
        few = stuck or sum(s[3] for s in spans) <= FEW
        if arrays and not few:
            held = Bins(_counted(df, cols, told), len(spans) <= FEW_COLUMNS)
            group = {i: spans[group[i]] for i in live}
            continue
        ranges = F.broadcast(spark.createDataFrame(told, f"g int, sc int, slo {kind}, shi {kind}"))
        inside = _values(df, cols, only, kind).join(ranges, (F.col("c") == F.col("sc")) & (F.col("x") >= F.col("slo")) & (F.col("x") <= F.col("shi")))
        if few:
            # few values, or whole numbers so near to each other that doubles don't tell them apart
            counts: dict[int, list] = {}
            alone = _counted(df, cols, told, True) if arrays else inside.groupBy("g", "x").agg(F.count("*").alias("n"))
            for r in alone.orderBy("g", "x").collect():
                counts.setdefault(r["g"], []).append((r["x"], r["n"]))
            for i, (_, r, below) in live.items():
                for x, n in counts[spans[group[i]]]:
                    if r < n:
                        out[i] = Place(x, below, n)
                        break
                    r, below = r - n, below + n
            break
        width = F.col("shi").cast("double") - F.col("slo").cast("double")
        part = F.coalesce(F.floor(F.try_divide(F.col("x").cast("double") - F.col("slo").cast("double"), width) * BINS), F.lit(0))
        held = Bins(_bins(inside, F.least(part, F.lit(BINS - 1)).cast("int"), ["g"]), len(spans) <= FEW_COLUMNS)
        group = {i: spans[group[i]] for i in live}
    return {(cols[asked[i][0]], asked[i][1]): p for i, p in out.items()}


@dataclass
class Cut:
    """The rows that come first: score above `score` (NaN is above all), or equal to it with an id up to `row_id` (None:
    any id). `score` None: all that have a score, and of those without one the ids up to `row_id`."""

    k: int
    score: float | None
    row_id: int | None
    nothing: bool = False

    def holds(self, score: Column, row_id: Column) -> Column:
        if self.nothing:
            return F.lit(False)
        s = score.cast("double")
        tie = F.lit(True) if self.row_id is None else row_id <= F.lit(self.row_id)
        if self.score is None:
            return s.isNotNull() | tie
        # Spark takes NaN for equal to itself and greater than all else
        return F.coalesce((s > F.lit(self.score)) | ((s == F.lit(self.score)) & tie), F.lit(False))


def cuts(df: DataFrame, ks: Callable[[int], list[int]], score: str = "pred", row_id: str = "Id") -> tuple[list[Cut], int]:
    """For each k that `ks` names, given the number of rows, the cut that k rows pass: highest score first, rows without
    one last, ties by id (unique whole numbers); and the number of rows. k beyond the rows lets all pass."""
    slim = stored(df.select(F.col(score).cast("double").alias("s"), F.col(row_id).cast("long").alias("i")), "scores")
    n, nans, nulls = slim.agg(F.count("*"), F.count_if(F.isnan("s")), F.count_if(F.col("s").isNull())).first()
    asked, m = ks(n), n - nans - nulls
    at = places(slim, ["s"], lambda size: {k: size - (k - nans) for k in asked if nans < k <= nans + size})
    out, ties = [], {}
    for j, k in enumerate(asked):
        if k <= 0 or k >= n:
            out.append(Cut(k, None, None, k <= 0))
            continue
        if k <= nans:
            cut, rank, size = Cut(k, math.nan, None), k - 1, nans
        elif k <= nans + m:
            p = at["s", k]
            cut, size = Cut(k, p.value, None), p.equal
            rank = k - nans - (m - p.below - p.equal) - 1
        else:
            cut, rank, size = Cut(k, None, None), k - nans - m - 1, nulls
        out.append(cut)
        if rank + 1 < size:
            ties[j] = rank
    if ties:
        s = F.col("s")
        mine = lambda c: s.isNull() if c.score is None else s == F.lit(c.score)
        names = {j: f"t{j}" for j in ties}
        rows = slim.select(*[F.when(mine(out[j]), F.col("i")).alias(c) for j, c in names.items()])
        found = places(rows, list(names.values()), lambda size: {r: r for r in set(ties.values()) if r < size}, "bigint")
        for j, r in ties.items():
            out[j].row_id = found[names[j], r].value
    return out, n
