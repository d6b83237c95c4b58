"""Stacks of problems against one problem at a time, and batches joined before they are stacked."""

import numpy as np
import pyarrow as pa
import pytest

from tidegauge.operators import solver


def problems(rows, n, seed):
    rng = np.random.default_rng(seed)
    r = rng.exponential(1.0, (rows, n))
    high = r + rng.uniform(0.0, 2.0, (rows, n))
    low = np.where(rng.random((rows, n)) < 0.2, high, high - 3.0)
    return r, low, high


@pytest.mark.parametrize("terms", [solver.trend_terms(0.05, 0.5, 1.0), solver.trend_terms(0.05, 0.0, 1.0), solver.step_terms(1.0, 0.05)])
@pytest.mark.parametrize("n", [2, 3, 17])
@pytest.mark.parametrize("watch", [False, True])
def test_a_stack_gives_each_problem_its_own_solution(terms, n, watch):
    r, low, high = problems(40, n, n)
    many = solver.solve_stack(r, low, high, 1.0, terms, 300, 1e-5, 3, watch, {})
    for i in range(len(r)):
        one = solver.solve_stack(r[i : i + 1], low[i : i + 1], high[i : i + 1], 1.0, terms, 300, 1e-5, 3, watch, {})
        assert one.iterations[0] == many.iterations[i] and np.allclose(one.d[0], many.d[i], atol=1e-12)
        assert all(np.allclose(a[0], b[i], atol=1e-12) for a, b in zip([*one.z, *one.u], [*many.z, *many.u]))
    assert len(set(many.iterations)) > 1


def test_small_batches_are_solved_together(monkeypatch):
    """Stacks of a few problems cost more in calls than in arithmetic."""
    monkeypatch.setattr(solver, "CELLS", 30)
    batches = [pa.RecordBatch.from_pydict({"k": [i, i + 100], "r": [[float(i)] * 3, [0.5] * (i + 1)]}) for i in range(9)]
    joined = list(solver._gathered(iter(batches)))
    assert pa.Table.from_batches(joined).to_pylist() == pa.Table.from_batches(batches).to_pylist()
    assert len(joined) < len(batches) and all(len(b.column("r").flatten()) >= 30 for b in joined[:-1])
    assert list(solver._gathered(iter([]))) == []
