"""A sweep of op3 moves every customer."""

import numpy as np
import pytest

from loomstead.llm import pitman_yor


def one_by_one(seats, tables_here, parent):
    """The same sweep, a customer of each pair at a time."""
    c, t, other = seats.c, seats.t.copy(), tables_here - seats.t
    top = len(seats.alone) - 1
    for k in range(c.max()):
        live = k < c
        lone = np.where(c <= top, seats.alone[np.minimum(c, top), np.minimum(t, top)], seats.d * (t - 1) / c)
        less = t - (seats.rng.random(len(c)) < lone)
        fresh = (seats.theta + seats.d * (other + less)) * parent
        t = np.where(live, less + (seats.rng.random(len(c)) < fresh / (fresh + c - 1 - seats.d * less)), t)
    return t


@pytest.mark.parametrize("customers, begin", [(3, 1), (40, 20), (128, 2), (5000, 1), (5000, 900)])
def test_sweep_moves_every_customer(customers, begin):
    n = 2000
    seats = pitman_yor.Seating(np.full(n, customers), 0.85, 1.0, np.random.default_rng(1))
    seats.t[:] = begin
    here, parent = np.full(n, begin + 400), np.full(n, 0.05)
    want = one_by_one(seats, here, parent)
    seats.sweep(here, parent)
    error = np.hypot(want.std(), seats.t.std()) / n**0.5
    assert abs(seats.t.mean() - want.mean()) < 5 * error
    assert seats.t.std() == pytest.approx(want.std(), rel=0.15)
