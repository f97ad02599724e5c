"""Allocation on menus of any shape against all choices."""

import itertools
import random

import pytest

from tallgrass.operators import decision

KINDS = "id int, discount double, revenue double, spend double"


def steps(spark, menus):
    rows = [(i, d, float(r), float(s)) for i, menu in menus.items() for d, r, s in menu]
    return spark.createDataFrame(rows, KINDS)


def test_a_losing_step_is_passed_over(spark):
    """Revenue 100, 90, 120 and spend 0, 10, 25: one step of gain 20 and cost 25, beyond a budget of 20."""
    offer = steps(spark, {1: [(0.0, 100, 0), (0.1, 90, 10), (0.2, 120, 25)]})
    assert [(r.discount, r.gain, r.cost) for r in decision.discount_steps(offer).collect()] == [(0.2, 20.0, 25.0)]
    assert decision.allocate_greedy(offer, 20.0).count() == 0
    assert decision.allocate_greedy(offer, 25.0).first()["spent"] == 25.0


def test_a_better_later_step_is_joined_with_the_one_before(spark):
    offer = steps(spark, {1: [(0.0, 10, 0), (0.1, 11, 5), (0.2, 20, 10), (0.3, 21, 30), (0.4, 21, 30), (0.5, 15, 40)]})
    got = decision.discount_steps(offer).orderBy("step").collect()
    assert [(r.discount, r.gain, r.cost) for r in got] == [(0.2, 10.0, 10.0), (0.3, 1.0, 20.0)]


def test_menus_without_a_choice(spark):
    offer = steps(spark, {1: [(0.0, 5, 0)], 2: [(0.0, 5, 0), (0.1, 5, 3)], 3: [(0.0, float("nan"), 0), (0.1, 9, 1)]})
    assert decision.discount_steps(offer).count() == 0
    assert decision.dual_price(offer, 1.0) == 0.0
    assert decision.discount_steps(offer.limit(0)).count() == 0


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_bounds_hold_on_any_menu(spark, seed):
    rng = random.Random(seed)
    menus = {i: [(k / 10, rng.randint(0, 40), 0 if k == 0 else rng.randint(0, 20)) for k in range(4)] for i in range(5)}
    offer, budget = steps(spark, menus), 18.0
    base = {i: min(((s, -r) for _, r, s in m)) for i, m in menus.items()}
    best = max(sum(r for _, r, _ in c) for c in itertools.product(*menus.values()) if sum(s for _, _, s in c) <= budget + sum(b[0] for b in base.values()))
    best -= sum(-b[1] for b in base.values())
    greedy = decision.allocate_greedy(offer, budget).collect()
    row = decision.dual_bound(offer, budget).first()
    assert sum(r.cost for r in greedy) <= budget and len({(r.id, r.discount) for r in greedy}) == len(greedy)
    assert (row.greedy_gain or 0) <= best + 1e-6 and best <= row.lp_gain + 1e-3 and row.lp_gain <= row.dual_gain + 1e-3
    assert abs(row.lp_gain - row.dual_gain) < 1e-3
    for i in menus:  # an id's steps are taken in order
        mine = [r.step for r in decision.discount_steps(offer).where(f"id = {i}").collect()]
        taken = [r.discount for r in greedy if r.id == i]
        order = [r.discount for r in decision.discount_steps(offer).where(f"id = {i}").orderBy("step").collect()]
        assert sorted(mine) == list(range(len(mine))) and taken == order[: len(taken)]
