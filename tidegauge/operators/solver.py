"""Sparse-change recovery: many bounded total-variation problems per Arrow batch.

One row is one problem with its arrays; Spark builds and spreads the rows. A
task stacks problems of equal length into a matrix and runs all of them in step.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.operators.ordered import trailing_lists, with_lag
from tidegauge.session import spread, staged

DENSE_ROWS = 1_024  # up to this length the system's inverse is kept; longer ones use its band
KEPT_SYSTEMS = 32  # solved systems that a task keeps, by length
STACK = 512  # problems solved together, small enough to stay in cache
CELLS = 2_000_000  # values of problems that a task looks at together, some 50 MB
CELL_BYTES = 32  # of a value with its row and box; columns that go along count for more values
CLOSED = 0.75  # share of open problems at which a stack leaves out the finished ones
LANE = 32  # successive windows that start from each other's solutions


def soft(x: np.ndarray, limit: float) -> np.ndarray:
    return np.sign(x) * np.maximum(np.abs(x) - limit, 0.0)


def difference_transposed(v: np.ndarray, order: int) -> np.ndarray:
    """Transposed ``order``-th difference applied to every row."""
    for _ in range(order):
        edge = np.zeros((len(v), 1))
        v = -np.diff(v, axis=1, prepend=edge, append=edge)
    return v


def step_terms(lambda_tv: float, lambda_l1: float, rho: float = 2.0) -> list[tuple]:
    """Box, sparsity and first differences: (difference order, penalty, boxed, rho)."""
    return [(0, 0.0, True, rho), (0, lambda_l1, False, rho), (1, lambda_tv, False, rho)]


def trend_terms(lambda_0: float, lambda_1: float, lambda_2: float, rho: float = 2.0) -> list[tuple]:
    """Boxed sparsity, first and second differences; unused orders are left out."""
    terms = [(0, lambda_0, True, rho)]
    terms += [(1, lambda_1, False, rho)] if lambda_1 > 0 else []
    terms += [(2, lambda_2, False, rho)] if lambda_2 > 0 else []
    return terms


def objective(r: np.ndarray, d: np.ndarray, weight: float, terms: Sequence[tuple]) -> np.ndarray:
    loss = 0.5 * weight * np.sum((r - d) ** 2, axis=1)
    for order, penalty, _, _ in terms:
        if penalty > 0 and d.shape[1] > order:
            loss = loss + penalty * np.sum(np.abs(np.diff(d, n=order, axis=1)), axis=1)
    return loss


class Band:
    """Factors of the system ``w I + sum rho D^T D``, whose band is two wide at most.

    Memory and work are linear in the length, so a problem may be a whole series.
    """

    def __init__(self, n: int, weight: float, terms: Sequence[tuple]):
        main, one, two = np.full(n, float(weight)), np.zeros(n), np.zeros(n)
        for order, _, _, rho in terms:
            stencil = np.array([[1.0], [-1.0, 1.0], [1.0, -2.0, 1.0]][order]) * 1.0
            last = n - order
            for i, a in enumerate(stencil):
                main[i : i + last] += rho * a * a
                for gap, off in ((1, one), (2, two)):
                    if i + gap < len(stencil):
                        off[i : i + last] += rho * a * stencil[i + gap]
        a0, a1, a2 = main.tolist(), one.tolist(), two.tolist()
        d, l1, l2 = [0.0] * n, [0.0] * (n + 2), [0.0] * (n + 2)
        for i in range(n):
            if i > 1:
                l2[i] = a2[i - 2] / d[i - 2]
            if i > 0:
                l1[i] = (a1[i - 1] - (l2[i] * d[i - 2] * l1[i - 1] if i > 1 else 0.0)) / d[i - 1]
            d[i] = a0[i] - (l1[i] ** 2 * d[i - 1] if i > 0 else 0.0) - (l2[i] ** 2 * d[i - 2] if i > 1 else 0.0)
        self.d, self.l1, self.l2 = np.array(d), l1, l2

    def __call__(self, right: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(self.columns(right.T, np.empty(right.T.shape)).T)

    def columns(self, right: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Forward and backward substitution into ``x``, for all columns in step."""
        np.copyto(x, right)
        n, l1, l2 = len(x), self.l1, self.l2
        for i in range(1, n):
            x[i] -= l1[i] * x[i - 1]
            if i > 1:
                x[i] -= l2[i] * x[i - 2]
        x /= self.d[:, None]
        for i in range(n - 2, -1, -1):
            x[i] -= l1[i + 1] * x[i + 1]
            if i + 2 < n:
                x[i] -= l2[i + 2] * x[i + 2]
        return x


class _dense:
    """The system's inverse, for rows or columns."""

    def __init__(self, n: int, weight: float, terms: Sequence[tuple]):
        system = weight * np.eye(n)
        for order, _, _, rho in terms:
            difference = np.diff(np.eye(n), n=order, axis=0)
            system += rho * difference.T @ difference
        self.matrix = np.linalg.inv(system)

    def __call__(self, right: np.ndarray) -> np.ndarray:
        return right @ self.matrix

    def columns(self, right: np.ndarray, x: np.ndarray) -> np.ndarray:
        return np.matmul(self.matrix.T, right, out=x)


class Solved(NamedTuple):
    """Estimates, rounds, and the state from which a similar problem may start."""

    d: np.ndarray
    iterations: np.ndarray
    z: list[np.ndarray]
    u: list[np.ndarray]


def solve_stack(
    r: np.ndarray, low: np.ndarray, high: np.ndarray, weight: float, terms: Sequence[tuple],
    max_iter: int, tol: float, least_iter: int, watch_box: bool, inverses: dict[int, Callable],
    start: Solved | None = None,
) -> Solved:
    """Minimise ``w/2 |r-d|^2 + sum_k penalty_k |D^k d|_1`` in the box, row by row of ``r``.

    Alternating directions with one split per term. A row stops on its own when
    the splits agree and the box copy (``watch_box``) or the estimate stands still.
    ``start`` continues from another solution of the same shape.
    """
    rows, n = r.shape
    d = np.clip(r, low, high)
    iterations = np.ones(rows, dtype=np.int32)
    if n == 1:
        return Solved(d, iterations, [], [])
    terms = [term for term in terms if n > term[0]]
    if n not in inverses:
        if len(inverses) >= KEPT_SYSTEMS:
            inverses.clear()
        inverses[n] = Band(n, weight, terms) if n > DENSE_ROWS else _dense(n, weight, terms)
    inverse = inverses[n].columns

    if start is None:
        z = [np.diff(d, n=order, axis=1) for order, *_ in terms]
        u = [np.zeros_like(part) for part in z]
    else:
        d, z, u = start.d, list(start.z), list(start.u)
    out, out_z, out_u = d.copy(), [p.copy() for p in z], [p.copy() for p in u]
    # A problem is a column from here on: differences are then taken between whole rows. The
    # arrays are used again in every round, as new ones would cost more than the arithmetic.
    pull, low, high, d = (np.ascontiguousarray(c.T) for c in (weight * r, low, high, d))
    z, u = ([p.T.copy() for p in parts] for parts in (z, u))
    active, open_ = np.arange(rows), np.ones(rows, dtype=bool)
    room = _Room(n, rows, terms)
    for it in range(1, max_iter + 1):
        np.copyto(room.right, pull)
        for (order, _, _, rho), zk, uk in zip(terms, z, u):
            pushed = np.subtract(zk, uk, out=room.a[: n - order])
            room.right += np.multiply(room.transposed(pushed, order), rho, out=room.b)
        new = inverse(room.right, room.new)
        moved = room.largest(new, d)
        d, room.new = new, d
        images = room.differences(new, terms)
        for k, (order, penalty, boxed, rho) in enumerate(terms):
            pushed = np.add(images[k], u[k], out=u[k])
            part = room.b[: n - order]
            if penalty > 0:
                np.subtract(pushed, pushed.clip(-penalty / rho, penalty / rho, out=part), out=part)
            else:
                np.copyto(part, pushed)
            if boxed:
                np.minimum(np.maximum(part, low, out=part), high, out=part)
                if watch_box:
                    moved = room.largest(part, z[k])
            np.copyto(z[k], part)
            pushed -= part
        still = open_ & (moved < tol)
        if it == max_iter:
            done = open_
        elif it < least_iter or not still.any():
            continue
        else:  # whether the splits agree is asked only where the estimate stands still
            at = np.flatnonzero(still)
            for image, part in zip(reversed(images), reversed(z)):
                at = at[np.abs(image.take(at, axis=1) - part.take(at, axis=1)).max(axis=0) < tol] if len(at) else at
            done = np.zeros(len(open_), dtype=bool)
            done[at] = True
        if not done.any():
            continue
        at = active[done]
        out[at] = d[:, done].T
        for k in range(len(terms)):
            out_z[k][at], out_u[k][at] = z[k][:, done].T, u[k][:, done].T
        iterations[at] = it
        open_ = open_ & ~done
        left = np.count_nonzero(open_)
        if not left:
            break
        if left <= CLOSED * len(open_):  # finished problems go on for a while, without effect
            active = active[open_]
            pull, low, high, d = (c.compress(open_, axis=1) for c in (pull, low, high, d))
            z, u = ([p.compress(open_, axis=1) for p in parts] for parts in (z, u))
            open_ = np.ones(left, dtype=bool)
            room = _Room(n, left, terms)
    return Solved(out, iterations, out_z, out_u)


class _Room:
    """Arrays that the rounds of a stack write into, a column per problem."""

    def __init__(self, n: int, columns: int, terms: Sequence[tuple]):
        self.right, self.new, self.a, self.b, self.c = (np.empty((n, columns)) for _ in range(5))
        self.images = [np.empty((n - order, columns)) if order else None for order, *_ in terms]

    def largest(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Largest distance by column."""
        away = np.subtract(x, y, out=self.a[: len(x)])
        return np.abs(away, out=away).max(axis=0)

    def transposed(self, v: np.ndarray, order: int) -> np.ndarray:
        """Transposed ``order``-th difference of every column; ``v`` lies in ``a``."""
        for spare in (self.b, self.c)[:order]:
            wide = spare[: len(v) + 1]
            np.negative(v[0], out=wide[0])
            np.subtract(v[:-1], v[1:], out=wide[1:-1])
            wide[-1] = v[-1]
            v = wide
        return v

    def differences(self, x: np.ndarray, terms: Sequence[tuple]) -> list[np.ndarray]:
        """The difference of every term's order."""
        found = []
        for (order, *_), place in zip(terms, self.images):
            if order == 2:
                first = np.subtract(x[1:], x[:-1], out=self.a[:-1])
                np.subtract(first[1:], first[:-1], out=place)
            elif order == 1:
                np.subtract(x[1:], x[:-1], out=place)
            found.append(place if order else x)
        return found


def _conjugate(v: np.ndarray, low: np.ndarray, high: np.ndarray, penalty: float) -> np.ndarray:
    """Greatest ``v z - penalty |z|`` of ``z`` in the box; the ends and the point next to zero decide."""
    best = v * (zero := np.clip(0.0, low, high)) - penalty * np.abs(zero)
    for end in (low, high):
        known = np.isfinite(end)
        at = np.where(known, end, 0.0)
        best = np.maximum(best, np.where(known, v * at - penalty * np.abs(at), -np.inf))
    return best


def duality_gap(
    r: np.ndarray, d: np.ndarray, low: np.ndarray, high: np.ndarray, weight: float, terms: Sequence[tuple], u: Sequence[np.ndarray]
) -> np.ndarray:
    """How far the objective of ``d``, a point of the box, is from the minimum at most, by row.

    The scaled multipliers ``u`` give a lower bound of the minimum once they are cut to
    where it is finite. The objective is ``w``-strongly convex, so no value of ``d`` is
    farther from the exact solution than ``sqrt(2 gap / w)``.
    """
    pull, bound = np.zeros_like(r), np.zeros(len(r))
    used = [term for term in terms if r.shape[1] > term[0]] if len(u) else []
    for (order, penalty, boxed, rho), part in zip(used, u):
        v = rho * part
        if boxed:
            v = np.where(np.isfinite(high), v, np.minimum(v, penalty))
            v = np.where(np.isfinite(low), v, np.maximum(v, -penalty))
            bound += _conjugate(v, low, high, penalty).sum(axis=1)
        else:
            v = np.clip(v, -penalty, penalty)
        pull += difference_transposed(v, order)
    least = (pull * r).sum(axis=1) - (pull**2).sum(axis=1) / (2 * weight) - bound
    return np.maximum(0.0, objective(r, d, weight, terms) - least)


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Successive batches joined up to ``CELLS`` values, so that stacks of one length are full."""
    held, cells = [], 0
    for batch in batches:
        held.append(batch)
        cells += max(len(batch.column(batch.schema.get_field_index("r")).flatten()), batch.nbytes // CELL_BYTES)
        if cells >= CELLS:
            yield pa.concat_batches(held)
            held, cells = [], 0
    if held:
        yield pa.concat_batches(held)


def _next_window(last: Solved, rows: np.ndarray) -> Solved:
    """State of the windows one row further on, from those that ``rows`` selects."""
    d = np.concatenate([last.d[rows, 1:], last.d[rows, -1:]], axis=1)
    z = [np.concatenate([p[rows, 1:], p[rows, -1:]], axis=1) for p in last.z]
    u = [np.concatenate([p[rows, 1:], np.zeros((len(rows), 1))], axis=1) for p in last.u]
    return Solved(d, last.iterations[rows], z, u)


def _lanes(at: np.ndarray, follows: np.ndarray) -> np.ndarray:
    """Place of every problem in its lane of successive windows; a lane starts cold."""
    begins = np.flatnonzero(~(follows[at] & (np.diff(at, prepend=-2) == 1)))
    since = np.arange(len(at)) - np.repeat(begins, np.diff(np.append(begins, len(at))))
    return since % LANE


def solve_problems(
    problems: DataFrame, terms: Sequence[tuple], keep: Sequence[str], weight: float = 1.0,
    max_iter: int = 1_000, tol: float = 1e-6, least_iter: int = 1, watch_box: bool = False,
    last_only: bool = False, warm: bool = False,
) -> DataFrame:
    """Solve rows with arrays ``r, low, high``; adds ``solution, iterations, loss, gap``.

    ``solution`` is clipped to the box; its last value only if ``last_only``. ``loss``
    is the objective of the clipped solution, or of the raw one for rolling windows; ``gap``
    bounds how far the clipped solution's objective is above the minimum. With ``warm``,
    the last column of ``keep`` numbers windows of one series, and a window starts from the
    solution of the one before it in the task.
    """
    terms = list(terms)
    result = T.DoubleType() if last_only else T.ArrayType(T.DoubleType())
    schema = T.StructType(
        [problems.schema[c] for c in keep]
        + [
            T.StructField("solution", result),
            T.StructField("iterations", T.IntegerType()),
            T.StructField("loss", T.DoubleType()),
            T.StructField("gap", T.DoubleType()),
        ]
    )

    def follows(table: dict[str, pa.Array], rows: int) -> np.ndarray:
        """Whether a row is the next window of the series of the row before it."""
        out = np.zeros(rows, dtype=bool)
        if warm and rows > 1:
            out[1:] = np.diff(table[keep[-1]].to_numpy(zero_copy_only=False)) == 1
            for c in keep[:-1]:
                names = pa.chunked_array([table[c]]).combine_chunks()
                out[1:] &= np.asarray(pc.fill_null(pc.equal(names[1:], names[:-1]), False))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inverses: dict[int, Callable] = {}
        for batch in _gathered(batches):
            table = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            starts, r = _lists(table["r"])
            low_at, low = _lists(table["low"])
            high_at, high = _lists(table["high"])
            sizes = np.diff(starts)
            after = follows(table, batch.num_rows)
            solutions: list = [None] * batch.num_rows
            counts = np.zeros(batch.num_rows, dtype=np.int32)
            losses, gaps = np.zeros(batch.num_rows), np.zeros(batch.num_rows)

            def solve(at: np.ndarray, n: int, start: Solved | None) -> Solved:
                span = np.arange(n)
                rr = r[starts[at][:, None] + span]
                hi = high[high_at[at][:, None] + span]
                lo = np.minimum(low[low_at[at][:, None] + span], hi)
                found = solve_stack(rr, lo, hi, weight, terms, max_iter, tol, least_iter, watch_box, inverses, start)
                clipped = np.clip(found.d, lo, hi)
                counts[at] = found.iterations
                losses[at] = objective(rr, found.d if last_only else clipped, weight, terms)
                gaps[at] = duality_gap(rr, clipped, lo, hi, weight, terms, found.u)
                for i, row in zip(at, clipped):
                    solutions[i] = float(row[-1]) if last_only else row
                return found

            for n in np.unique(sizes):
                same = np.flatnonzero(sizes == n)
                place = _lanes(same, after) if warm else np.zeros(len(same), dtype=np.int64)
                for begin in range(0, int((place == 0).sum()), STACK):
                    lane = np.flatnonzero(place == 0)[begin : begin + STACK]  # in ``same``
                    last = solve(same[lane], n, None)
                    for step in range(1, int(place.max()) + 1):
                        on = lane + 1 < len(same)
                        on[on] = place[lane[on] + 1] == step
                        if not on.any():
                            break
                        lane = lane[on] + 1
                        last = solve(same[lane], n, _next_window(last, np.flatnonzero(on)))
            arrays = [table[c] for c in keep]
            kind = pa.float64() if last_only else pa.list_(pa.float64())
            arrays += [pa.array(solutions, type=kind), pa.array(counts), pa.array(losses), pa.array(gaps)]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.fieldNames())

    return problems.select(*keep, "r", "low", "high").mapInArrow(run, schema)


def delta_bounds(y: Column, x_min: Column, x_max: Column, inside: Column | None = None) -> tuple[Column, Column]:
    """Box of the disturbance from the physical range of the clean signal; zero off the support."""
    high = y - x_min
    low = F.least(y - x_max, high)
    if inside is not None:
        low, high = F.when(inside, low).otherwise(0.0), F.when(inside, high).otherwise(0.0)
    return low, high


def whole_problems(rows: DataFrame, key: Sequence[str], t: str = "t", carry: Sequence[str] = ()) -> DataFrame:
    """One problem per key from rows ``(t, r, low, high)``, with arrays of the columns ``carry``.

    A problem is one block or one event-centred crop, whose arrays one task holds; the
    solution of a whole series couples all its rows. Rolling windows have no such bound.
    """
    columns = [t, "r", "low", "high", *carry]
    cells = F.sort_array(F.collect_list(F.struct(*columns)))
    return spread(rows, *key).groupBy(*key).agg(cells.alias("_c")).select(*key, *(F.col(f"_c.{c}").alias(c) for c in columns))


def recover_whole(
    rows: DataFrame, key: Sequence[str], terms: Sequence[tuple], weight: float = 1.0, t: str = "t",
    carry: Sequence[str] = (), **options,
) -> DataFrame:
    """Offline recovery: ``(*key, t, delta_hat, *carry, iterations, loss, gap)``.

    Columns ``carry`` of the rows go through the solver, so that no join need bring them back.
    """
    solved = solve_problems(whole_problems(rows, key, t, carry), terms, [*key, t, *carry], weight, **options)
    pairs = F.arrays_zip(F.col(t), F.col("solution"), *(F.col(c) for c in carry))
    return solved.select(*key, F.inline(pairs).alias(t, "delta_hat", *carry), "iterations", "loss", "gap")


def recover_rolling(
    rows: DataFrame, key: Sequence[str], terms: Sequence[tuple], window: int = 48, weight: float = 1.0,
    max_iter: int = 300, tol: float = 1e-5, t: str = "t", **options,
) -> DataFrame:
    """Causal recovery: every row solves its trailing window and keeps the last value.

    No row looks ahead and windows of any series run in parallel. With ``warm=True``
    up to ``LANE`` successive windows of a task start from each other's solutions.
    """
    lists = trailing_lists(rows, key, window, {"_r": "r", "_low": "low", "_high": "high"}, t, wide=True)
    problems = lists.select(
        *key, t, F.col("_r").alias("r"), F.col("_low").alias("low"), F.col("_high").alias("high")
    )
    solved = solve_problems(
        problems, terms, [*key, t], weight, max_iter=max_iter, tol=tol, last_only=True, **options
    )
    return solved.withColumnRenamed("solution", "delta_hat")


STENCILS = {1: (-1.0, 1.0), 2: (1.0, -2.0, 1.0)}


def _pulls(terms: Sequence[tuple], crossing: Callable[[int, int], Column] | None = None) -> Column:
    """``sum_k D_k^T v_k`` at a row from its own and lagged multipliers, of some links or all."""
    total = F.lit(0.0)
    for k, (order, *_) in enumerate(terms):
        for back, c in enumerate(STENCILS.get(order, (1.0,))):
            v = F.coalesce(F.col(f"_v{k}_{back}"), F.lit(0.0))
            if crossing is not None:
                if not order:
                    continue
                v = F.when(crossing(back, order), v).otherwise(0.0)
            total = total + c * v
    return total


def _lagged(state: DataFrame, key: Sequence[str], terms: Sequence[tuple], t: str, estimates: bool) -> DataFrame:
    lags = {f"_v{k}_{back}": (f"v{k}", back) for k, (order, *_) in enumerate(terms) for back in range(order + 1)}
    if estimates:
        lags |= {f"_d_{back}": ("d", back) for back in range(3)}
    return with_lag(state, key, lags, t)


def _state_gap(state: DataFrame, key: Sequence[str], terms: Sequence[tuple], weight: float, t: str) -> DataFrame:
    """Objective and duality gap of every key from one row per cell, as sums."""
    rows = _lagged(state, key, terms, t, estimates=True)
    differences = {0: F.col("d"), 1: F.col("d") - F.col("_d_1"), 2: F.col("d") - 2 * F.col("_d_1") + F.col("_d_2")}
    loss = 0.5 * weight * (F.col("r") - F.col("d")) ** 2
    bound = F.lit(0.0)
    zero = F.greatest(F.col("low"), F.least(F.lit(0.0), F.col("high")))
    for k, (order, penalty, boxed, _) in enumerate(terms):
        loss = loss + penalty * F.coalesce(F.abs(differences[order]), F.lit(0.0))
        if boxed:
            def worth(z: Column) -> Column:
                return F.col(f"v{k}") * z - penalty * F.abs(z)

            ends = [F.when(F.abs(F.col(e)) < float("inf"), worth(F.col(e))) for e in ("low", "high")]
            bound = bound + F.greatest(worth(zero), *ends)
    pull = _pulls(terms)
    sums = rows.select(*key, loss.alias("_p"), (pull * F.col("r") - pull * pull / (2 * weight) - bound).alias("_q"))
    told = sums.groupBy(*key).agg(F.sum("_p").alias("loss"), F.sum("_q").alias("_q"))
    return told.select(*key, "loss", F.greatest(F.lit(0.0), F.col("loss") - F.col("_q")).alias("gap"))


def recover_long(
    rows: DataFrame, key: Sequence[str], terms: Sequence[tuple], weight: float = 1.0, t: str = "t",
    block: int = 1_024, gap: float = 1e-6, max_rounds: int = 40, max_iter: int = 1_000, tol: float = 1e-7,
) -> DataFrame:
    """Offline recovery of series of any length by blocks: as ``recover_whole``, with ``rounds``.

    The dual of the problem couples rows through the multipliers of the differences alone.
    A round fixes those of the differences that cross a border between blocks, which leaves
    one small problem per block, and solves all blocks as a stack in parallel tasks. Borders move
    by half a block from round to round, so each multiplier is free every second round;
    the dual rises to its maximum, and the duality gap, a sum over rows, tells when every
    series is within ``gap`` of its minimum, relative to one plus its objective.
    """
    key, terms = list(key), list(terms)
    names = [f"v{k}" for k in range(len(terms))]
    box = F.least(F.col("low"), F.col("high"))
    state = rows.select(*key, t, F.col("r").cast("double"), box.cast("double").alias("low"), F.col("high").cast("double"))
    state = staged(state.withColumn("d", F.greatest("low", F.least("r", "high"))).withColumns({v: F.lit(0.0) for v in names}), "cells")
    for number in range(1, max_rounds + 1):
        state = staged(_round(state, key, terms, weight, t, block, (number % 2) * (block // 2), max_iter, tol), "cells")
        told = staged(_state_gap(state, key, terms, weight, t), "gaps")
        if told.filter(F.col("gap") > gap * (1 + F.col("loss"))).isEmpty():
            break
    out = state.select(*key, t, F.col("d").alias("delta_hat")).join(told, key)
    return out.withColumn("rounds", F.lit(number))


def _round(
    state: DataFrame, key: list[str], terms: list[tuple], weight: float, t: str, block: int, shift: int, max_iter: int, tol: float
) -> DataFrame:
    """Solve every block with the multipliers of the differences over its borders as they are."""

    def crossing(back: int, order: int) -> Column:
        first = F.col(t) - back + shift
        return F.floor(first / block) != F.floor((first + order) / block)

    names = [f"v{k}" for k in range(len(terms))]
    cells = _lagged(state, key, terms, t, estimates=False)
    cells = cells.withColumn("_s", F.col("r") - _pulls(terms, crossing) / weight)
    part = F.floor((F.col(t) + shift) / block).alias("_part")
    columns = [t, "r", "low", "high", "d", *names, "_s"]
    lists = spread(cells.withColumn("_part", part), *key, "_part").groupBy(*key, "_part").agg(
        F.sort_array(F.collect_list(F.struct(*columns))).alias("_c")
    )
    problems = lists.select(*key, *(F.col(f"_c.{c}").alias(c) for c in columns))
    kept = [*key, t, "r", "low", "high"]
    arrays = ["d", *names]
    schema = T.StructType([*(problems.schema[c] for c in kept), *(T.StructField(c, T.ArrayType(T.DoubleType())) for c in arrays)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inverses: dict[int, Callable] = {}
        for batch in batches:
            table = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            flat = {c: _lists(table[c]) for c in ("_s", "low", "high", *arrays)}
            sizes = np.diff(flat["_s"][0])
            solved: dict[str, list] = {c: [None] * batch.num_rows for c in arrays}
            for n in np.unique(sizes):
                same = np.flatnonzero(sizes == n)
                for begin in range(0, len(same), STACK):
                    at = same[begin : begin + STACK]
                    given = {c: values[starts[at][:, None] + np.arange(n)] for c, (starts, values) in flat.items()}
                    used = [k for k, term in enumerate(terms) if n > term[0]]
                    free = [given[names[k]][:, : n - terms[k][0]] / terms[k][3] for k in used]
                    first = Solved(given["d"], np.zeros(len(at), np.int32), [np.diff(given["d"], n=terms[k][0], axis=1) for k in used], free)
                    found = _solve_block(given, weight, terms, max_iter, tol, inverses, first)
                    values = {"d": np.clip(found.d, given["low"], given["high"])}
                    for k, term in enumerate(terms):
                        values[names[k]] = given[names[k]].copy()
                        if k in used and len(found.u):
                            v = term[3] * found.u[used.index(k)]
                            values[names[k]][:, : n - term[0]] = v if term[2] else np.clip(v, -term[1], term[1])
                    for c, matrix in values.items():
                        for i, row in zip(at, matrix):
                            solved[c][i] = row
            out = [*(table[c] for c in kept), *(pa.array(solved[c], pa.list_(pa.float64())) for c in arrays)]
            yield pa.RecordBatch.from_arrays(out, names=schema.fieldNames())

    done = problems.mapInArrow(run, schema)
    zipped = F.arrays_zip(*(F.col(c) for c in [t, "r", "low", "high", *arrays]))
    return done.select(*key, F.inline(zipped).alias(t, "r", "low", "high", *arrays))


def _solve_block(
    given: dict[str, np.ndarray], weight: float, terms: list[tuple], max_iter: int, tol: float, inverses: dict[int, Callable], first: Solved
) -> Solved:
    r, low, high = given["_s"], given["low"], given["high"]
    if r.shape[1] > 1:
        return solve_stack(r, low, high, weight, terms, max_iter, tol, 1, False, inverses, first)
    # One row: the minimum of the parabola and the sparsity, moved into the box.
    penalty = sum(p for order, p, _, _ in terms if order == 0)
    d = np.clip(soft(r, penalty / weight), low, high)
    rest, u = weight * (r - d), []
    for order, p, boxed, rho in (term for term in terms if not term[0]):
        v = rest - sum(np.clip(rest, -q, q) for o, q, b, _ in terms if o == 0 and not b) if boxed else np.clip(rest, -p, p)
        u.append(v / rho)
    return Solved(d, np.ones(len(r), np.int32), [], u)
