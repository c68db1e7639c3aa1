"""Hidden-state models of long series, fitted per series by products over blocks.

A series is cut into blocks of rows. What a block does to a distribution over states is a 3 x 3 matrix, and
blocks follow each other by matrix product: (+, x) for probabilities, (max, +) for the best path. So one task handles a
block, a small table of one matrix per block is scanned per series, and each block gets the vectors with
which the series enters and leaves it. No task reads a whole series.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketpulse.functions.numeric import nonzero, num
from marketpulse.operators.series import join_same, number_rows
from marketpulse.session import materialise, sized

# Functions that run in Python workers are sent by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Rows of a block, states, and the variance that is added to each state.
BLOCK, STATES, FLOOR = 4096, 3, 1e-3
#: Fixed value: thirds of a normal distribution, by which states are seeded.
THIRD = 0.4307
#: Blocks that are computed at a time.
AT_ONCE = 64

PARAMS = "start array<double>, moves array<double>, means array<double>, spreads array<double>"


def standardised(rows: DataFrame, columns: tuple[str, ...], names: tuple[str, ...], by: str = "symbol", least: int = 1) -> DataFrame:
    """Rows with each column less its mean, by its deviation in the series; series of fewer than ``least`` rows are left out."""
    stats = [f(F.col(c)).alias(f"_{k}_{c}") for c in columns for k, f in (("m", F.avg), ("s", F.stddev_pop))]
    scale = sized(rows.groupBy(by).agg(F.count(F.lit(1)).alias("_n"), *stats).where(F.col("_n") >= least))
    return join_same(rows, scale, [by]).withColumns(
        {n: (F.col(c) - F.col(f"_m_{c}")) / nonzero(F.col(f"_s_{c}")) for n, c in zip(names, columns)}
    ).drop("_n", *[f"_{k}_{c}" for c in columns for k in "ms"])


def blocks(rows: DataFrame, by: str = "symbol", ts: str = "ts", size: int = BLOCK, chunk=None) -> DataFrame:
    """(by, block, n, x, y): the numbers of up to ``size`` consecutive rows of a series as arrays, in order."""
    numbered = number_rows(rows.select(by, ts, "x", "y"), (by,), (ts, "x", "y"), chunk)
    at = F.col("_rn") - 1
    grouped = numbered.groupBy(by, F.expr(f"(_rn - 1) div {size}").alias("block")).agg(
        F.sort_array(F.collect_list(F.struct(at.alias("rn"), "x", "y"))).alias("_rows"))
    return grouped.select(by, "block", F.size("_rows").alias("n"), F.col("_rows.x").alias("x"), F.col("_rows.y").alias("y"))


def seeds(rows: DataFrame, by: str = "symbol", linked: bool = True) -> DataFrame:
    """Parameters to begin with: states of low, middle and high ``x``, each likely to last, or equally likely if not ``linked``."""
    inside = [F.col("x") < -THIRD, F.abs("x") <= THIRD, F.col("x") > THIRD]
    means = [F.coalesce(F.avg(F.when(k, F.col(c))), num(v)) for c, d in (("x", 1.0), ("y", 0.0)) for k, v in zip(inside, (-d, 0.0, d))]
    moves = [num((0.8 if i == j else 0.1) if linked else 1 / 3) for i in range(STATES) for j in range(STATES)]
    return rows.groupBy(by).agg(
        F.array(*[num(1 / 3)] * STATES).alias("start"), F.array(*moves).alias("moves"), F.array(*means).alias("means"),
        F.array(*[num(v) for v in (1.0, 0.0, 1.0) for _ in range(STATES)]).alias("spreads"))


class Batch:
    """Blocks of several series side by side: (block, row, ...) arrays, shorter blocks padded with steps that change nothing."""

    def __init__(self, cols: dict[str, list]):
        many = len(cols["n"])
        self.n = np.array(cols["n"])
        self.block = np.array(cols["block"])
        self.length = int(self.n.max())
        self.live = np.arange(self.length) < self.n[:, None]
        self.x, self.y = (self._padded(cols[c]) for c in ("x", "y"))
        self.start = np.array(cols["start"])
        self.moves = np.array(cols["moves"]).reshape(many, STATES, STATES)
        self.means = np.array(cols["means"]).reshape(many, 2, STATES)
        self.spreads = np.array(cols["spreads"]).reshape(many, 3, STATES)
        self.log_density = self._log_density()
        self.top = np.where(self.live, self.log_density.max(2), 0.0)
        self.density = np.exp(self.log_density - self.top[:, :, None])

    def _padded(self, values: list) -> np.ndarray:
        out = np.zeros((len(values), self.length))
        out[self.live] = np.concatenate(values)
        return out

    def _log_density(self) -> np.ndarray:
        """Log-density of each row in each state, less a constant."""
        a, c, b = (self.spreads[:, None, k] for k in range(3))
        dx, dy = self.x[:, :, None] - self.means[:, None, 0], self.y[:, :, None] - self.means[:, None, 1]
        det = a * b - c * c
        return -0.5 * ((b * dx * dx - 2 * c * dx * dy + a * dy * dy) / det + np.log(det))

    def step(self, t: int) -> np.ndarray:
        """The matrix of row t: from the state of the row before to its own; a first row starts whatever came before."""
        if t:
            return self.moves
        return np.where((self.block == 0)[:, None, None], self.start[:, None, :], self.moves)

    def product(self) -> tuple[np.ndarray, np.ndarray]:
        """The product of each block's matrices, scaled, and the log of the scale."""
        now, log = np.broadcast_to(np.eye(STATES), (len(self.n), STATES, STATES)), self.top.sum(1)
        for t in range(self.length):
            after = (now @ self.step(t)) * self.density[:, t, None, :]
            after = np.where(self.live[:, t, None, None], after, now)
            scale = after.sum((1, 2))
            now, log = after / scale[:, None, None], log + np.log(scale)
        return now, log

    def best(self) -> np.ndarray:
        """The (max, +) product: best log score from each state before the block to each state of its last row."""
        now = np.where(np.eye(STATES, dtype=bool), 0.0, -np.inf) + np.zeros((len(self.n), 1, 1))
        with np.errstate(divide="ignore"):
            for t in range(self.length):
                after = (now[:, :, :, None] + np.log(self.step(t))[:, None]).max(2) + self.log_density[:, t, None, :]
                now = np.where(self.live[:, t, None, None], after, now)
        return now

    def smoothed(self, enter: np.ndarray, leave: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities of the states of each row, and sums of those of each pair of consecutive states."""
        forward = np.zeros((len(self.n), self.length + 1, STATES))
        forward[:, 0] = enter
        for t in range(self.length):
            now = np.einsum("bi,bij->bj", forward[:, t], self.step(t)) * self.density[:, t]
            forward[:, t + 1] = np.where(self.live[:, t, None], now / now.sum(1, keepdims=True), forward[:, t])
        rows, pairs, back = np.zeros_like(self.density), np.zeros((len(self.n), STATES, STATES)), leave
        for t in reversed(range(self.length)):
            live, seen = self.live[:, t, None], self.density[:, t] * back
            own = forward[:, t + 1] * back
            rows[:, t] = np.where(live, own / own.sum(1, keepdims=True), 0.0)
            both = forward[:, t, :, None] * self.step(t) * seen[:, None, :]
            both /= both.sum((1, 2), keepdims=True)
            first = (self.block == 0)[:, None, None] & (t == 0)
            pairs += np.where(live[:, :, None] & ~first, both, 0.0)
            before = np.einsum("bij,bj->bi", self.step(t), seen)
            back = np.where(live, before / before.sum(1, keepdims=True), back)
        return rows, pairs

    def path(self, enter: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The best state of each row, given the scores before the block and the state of its last row."""
        score, came = enter, np.zeros((len(self.n), self.length, STATES), np.int64)
        with np.errstate(divide="ignore"):
            for t in range(self.length):
                ways = score[:, :, None] + np.log(self.step(t))
                came[:, t] = ways.argmax(1)
                score = np.where(self.live[:, t, None], ways.max(1) + self.log_density[:, t], score)
        out, state = np.zeros((len(self.n), self.length), np.int64), last.copy()
        for t in reversed(range(self.length)):
            live = self.live[:, t]
            out[:, t] = state
            state = np.where(live, came[np.arange(len(self.n)), t, state], state)
        return out


def _each(batches: Iterator[pa.RecordBatch], compute: Callable) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, AT_ONCE):
            part = batch.slice(start, AT_ONCE)
            cols = {name: part.column(name).to_pylist() for name in part.schema.names}
            yield compute(part, cols, Batch(cols))


def _flat(values: np.ndarray) -> pa.Array:
    return pa.array(list(values.reshape(len(values), -1)), pa.list_(pa.float64()))


def _carries(by: str, kind: str, cut: DataFrame, params: DataFrame) -> DataFrame:
    """(by, block, enter, leave, best, last): what each block begins and ends with, from one matrix per block."""
    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one(part, cols, b):
            product, log = b.product()
            return pa.RecordBatch.from_arrays(
                [part.column(by), part.column("block"), _flat(product), pa.array(log), _flat(b.best())],
                [by, "block", "product", "log", "best"])
        return _each(batches, one)

    def scan(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        n = table.num_rows
        product, best = (np.array(table.column(c).to_pylist()).reshape(n, STATES, STATES) for c in ("product", "best"))
        enter, leave, score = (np.zeros((n, STATES)) for _ in range(3))
        last, log = np.zeros(n, np.int64), float(np.sum(table.column("log").to_pylist()))
        now, ahead = np.eye(STATES)[0], np.zeros(STATES)
        for k in range(n):
            enter[k], score[k] = now, ahead
            now = now @ product[k]
            log += np.log(now.sum())
            now, ahead = now / now.sum(), (ahead[:, None] + best[k]).max(0)
        back, state = np.ones(STATES), int(ahead.argmax())
        for k in reversed(range(n)):
            leave[k], last[k] = back, state
            back = product[k] @ back
            back, state = back / back.sum(), int((score[k] + best[k][:, state]).argmax())
        return pa.table([table.column(by), table.column("block"), _flat(enter), _flat(leave), _flat(score), pa.array(last),
                         pa.array(np.full(n, log))], [by, "block", "enter", "leave", "score", "last", "log_likelihood"])

    given = join_same(cut, params, [by])
    matrices = given.mapInArrow(products, f"{by} {kind}, block long, product array<double>, log double, best array<double>")
    return matrices.groupBy(by).applyInArrow(
        scan, f"{by} {kind}, block long, enter array<double>, leave array<double>, score array<double>, last long, log_likelihood double")


def _maximised(by: str, kind: str, cut: DataFrame, params: DataFrame, carried: DataFrame, linked: bool) -> DataFrame:
    """Parameters from the expected counts and sums under the old ones; a state that no row is in keeps its old ones."""
    width = STATES * 10

    def expected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one(part, cols, b):
            rows, pairs = b.smoothed(np.array(cols["enter"]), np.array(cols["leave"]))
            sums = [np.einsum("bts,bt->bs", rows, v) for v in (np.ones_like(b.x), b.x, b.y, b.x * b.x, b.x * b.y, b.y * b.y)]
            first = np.where((b.block == 0)[:, None], rows[:, 0], 0.0)
            return pa.RecordBatch.from_arrays([part.column(by), _flat(np.hstack([*sums, first, pairs.reshape(len(pairs), -1)]))], [by, "sums"])
        return _each(batches, one)

    def maximise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = np.array([batch.column(f"s{k}").to_pylist() for k in range(width)]).T.reshape(-1, 10, STATES)
            old = {c: np.array(batch.column(c).to_pylist()) for c in ("moves", "means", "spreads")}
            n, x, y, xx, xy, yy, first = (s[:, k] for k in range(7))
            some, full = n > 1e-9, np.maximum(n, 1e-9)
            x, y = x / full, y / full
            spread = np.stack([xx / full - x * x + FLOOR, xy / full - x * y, yy / full - y * y + FLOOR], 1)
            left = s[:, 7:].sum(2, keepdims=True)
            moves = np.where(left > 1e-9, s[:, 7:] / np.maximum(left, 1e-9), old["moves"].reshape(-1, STATES, STATES))
            if not linked:
                first = n / n.sum(1, keepdims=True)
                moves = np.repeat(first[:, None], STATES, 1)
            means = np.where(some[:, None], np.stack([x, y], 1), old["means"].reshape(-1, 2, STATES))
            spreads = np.where(some[:, None], spread, old["spreads"].reshape(-1, 3, STATES))
            yield pa.RecordBatch.from_arrays([batch.column(by), *map(_flat, (first, moves, means, spreads))],
                                             [by, "start", "moves", "means", "spreads"])

    given = join_same(join_same(cut, params, [by]), carried.select(by, "block", "enter", "leave"), [by, "block"])
    summed = given.mapInArrow(expected, f"{by} {kind}, sums array<double>").groupBy(by).agg(
        *[F.sum(F.get("sums", F.lit(k))).alias(f"s{k}") for k in range(width)])
    return join_same(summed, params, [by]).mapInArrow(maximise, f"{by} {kind}, {PARAMS}")


def fit_states(cut: DataFrame, params: DataFrame, rounds: int = 10, by: str = "symbol", linked: bool = True) -> DataFrame:
    """Parameters per series after ``rounds`` of expectation and maximisation."""
    kind = cut.schema[by].dataType.simpleString()
    for _ in range(rounds):
        carried = sized(_carries(by, kind, cut, params))
        params = sized(_maximised(by, kind, cut, params, carried, linked))
    return params


def decode(cut: DataFrame, params: DataFrame, by: str = "symbol") -> DataFrame:
    """(by, _rn, state, probability, log_likelihood): the best path's state of each row and its smoothed probability."""
    kind = cut.schema[by].dataType.simpleString()

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one(part, cols, b):
            state = b.path(np.array(cols["score"]), np.array(cols["last"]))
            rows, _ = b.smoothed(np.array(cols["enter"]), np.array(cols["leave"]))
            sure = np.take_along_axis(rows, state[:, :, None], 2)[:, :, 0]
            place = np.repeat(np.arange(part.num_rows), b.n)
            return pa.RecordBatch.from_arrays(
                [part.column(by).take(pa.array(place)), pa.array((b.block[:, None] * size + np.arange(b.length) + 1)[b.live]),
                 pa.array(state[b.live].astype(np.int32)), pa.array(sure[b.live]),
                 part.column("log_likelihood").take(pa.array(place))], [by, "_rn", "state", "probability", "log_likelihood"])
        return _each(batches, one)

    size = int(cut.agg(F.max("n")).first()[0] or 1)
    given = join_same(join_same(cut, params, [by]), sized(_carries(by, kind, cut, params)), [by, "block"])
    return given.mapInArrow(label, f"{by} {kind}, _rn long, state int, probability double, log_likelihood double")


def hidden_states(rows: DataFrame, x: str, y: str, rounds: int = 10, by: str = "symbol", ts: str = "ts", least: int = 20,
                  block: int = BLOCK, chunk=None, linked: bool = True) -> DataFrame:
    """(by, ts, x, y columns, state 0-2, probability): three hidden states with transitions, fitted to each series alone.

    Each state has a normal distribution of the two columns. States are seeded by thirds of ``x`` and fitted by
    ``rounds`` of EM; ``state`` is that of the most likely path, ``probability`` its smoothed probability. Without
    ``linked`` a state does not depend on the one before: a mixture. Rows with a NULL in
    either column are left out, and series with fewer than ``least`` others. A NULL series or time is a value like others (first);
    rows equal in time follow by ``x``, then ``y``. The result does not depend on ``block``.
    """
    known = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(by, ts, F.col(x).alias("_x"), F.col(y).alias("_y"))
    scaled = materialise(standardised(known, ("_x", "_y"), ("x", "y"), by, least), "observed")
    cut = materialise(blocks(scaled, by, ts, block, chunk), "blocks")
    params = fit_states(cut, sized(seeds(scaled, by, linked)), rounds, by, linked)
    numbered = number_rows(scaled, (by,), (ts, "x", "y"), chunk)
    found = join_same(numbered, decode(cut, params, by), [by, "_rn"])
    return found.select(by, ts, F.col("_x").alias(x), F.col("_y").alias(y), "state", "probability")
