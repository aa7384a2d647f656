"""Tours, splits, batches and exact small tours against plain loops, and calendars."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkwarden.operators import routing as R
from sparkwarden.operators import tours
from sparkwarden.plans.registry import QUERIES
from tests.conftest import DATA


def frame(spark, n, seed, regions=2):
    rng = np.random.default_rng(seed)
    rows = [(r, r * 1000 + i, *map(float, rng.random(2) * 400), float(rng.random())) for r in range(regions) for i in range(n + r)]
    df = spark.createDataFrame(rows, "region bigint, id bigint, x double, y double, prize double")
    return df.join(df.groupBy("region").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy")), "region").cache()


def by_region(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.region, {"at": {}, "prize": {}, "home": (r.cx, r.cy)})
        out[r.region]["at"][r.id] = (r.x, r.y)
        out[r.region]["prize"][r.id] = r.prize
    return out


def minutes(a, b):
    return math.dist(a, b) * R.PACE


def tour(ids, place):
    path = [place["home"], *[place["at"][i] for i in ids], place["home"]]
    return sum(minutes(a, b) for a, b in zip(path, path[1:], strict=False))


def paths(routes):
    out = {}
    for r in sorted(routes.collect(), key=lambda r: (r.region, r.route, r.stop)):
        out.setdefault((r.region, r.route), []).append(r)
    return out


@pytest.mark.parametrize("n, day", [(1, 480.0), (7, 200.0), (30, 300.0), (44, 170.0)])
def test_routes_are_the_optimal_cut_of_the_sweep(spark, n, day):
    df = frame(spark, n, n)
    places, found = by_region(df), paths(R.split_routes(df, 1.0, day))
    for region, place in places.items():
        home = place["home"]
        order = sorted(place["at"], key=lambda i: (math.atan2(place["at"][i][1] - home[1], place["at"][i][0] - home[0]), i))
        best = [(0, 0.0)]
        for j in range(1, len(order) + 1):
            tries = [(i, tour(order[i:j], place) + R.SERVICE * (j - i)) for i in range(j)]
            best.append(min((best[i][0] + 1, best[i][1] + m) for i, m in tries if m <= day + 1e-9))
        own = [[r.id for r in v] for key, v in sorted(found.items()) if key[0] == region]
        assert [i for part in own for i in part] == order
        spent = [tour(part, place) + R.SERVICE * len(part) for part in own]
        assert max(spent) <= day + 1e-9 and (len(own), sum(spent)) == (best[-1][0], pytest.approx(best[-1][1]))
        # never more routes than stretches of equal length need
        equal = next(k for k in range(1, len(order) + 1) if max(tour(p, place) + R.SERVICE * len(p) for p in ([int(i) for i in q] for q in np.array_split(order, k))) <= day + 1e-9)
        assert len(own) <= equal
    for (region, _), route in found.items():
        assert sum(r.leg + r.back for r in route) == pytest.approx(tour([r.id for r in route], places[region]))


def test_a_stop_beyond_the_day_raises(spark):
    with pytest.raises(Exception, match="exceeds the day"):
        R.split_routes(frame(spark, 3, 1), 1.0, 20.0).collect()


def test_reversals_equal_a_loop_and_never_lengthen(spark):
    df = frame(spark, 12, 5)
    places, start = by_region(df), R.split_routes(df)
    found = paths(R.two_opt(start))
    for (region, route), rows in paths(start).items():
        place, now = places[region], [r.id for r in rows]
        while True:
            tries = [(tour(now, place) - tour(now[:i] + now[i : j + 1][::-1] + now[j + 1 :], place), -i, -j) for i in range(len(now)) for j in range(i + 1, len(now))]
            gain, i, j = max(tries, default=(0, 0, 0))
            if gain <= 1e-9:
                break
            now[-i : 1 - j] = now[-i : 1 - j][::-1]
        own = found[region, route]
        assert tour([r.id for r in own], place) == pytest.approx(tour(now, place))
        assert sum(r.leg + r.back for r in own) <= sum(r.leg + r.back for r in rows) + 1e-9


def test_nearest_tours_equal_a_loop(spark):
    df = frame(spark, 15, 6)
    got = {}
    for r in sorted(R.nearest_tour(df).collect(), key=lambda r: (r.region, r.stop)):
        got.setdefault(r.region, []).append(r.id)
    for region, place in by_region(df).items():
        at, left, order = place["home"], set(place["at"]), []
        while left:
            near = min(left, key=lambda i: (minutes(at, place["at"][i]), i))
            order.append(near)
            left.remove(near)
            at = place["at"][near]
        assert got[region] == order


def test_ranked_batches_equal_a_loop(spark):
    df = frame(spark, 18, 7)
    grid = ((4, 1, 120.0), (8, 2, 120.0), (15, 2, 240.0), (3, 1, 25.0))
    got = {}
    for r in sorted(R.ranked_batches(df, grid).collect(), key=lambda r: r.stop):
        got.setdefault((r.region, r.budget, r.teams, r.day), {}).setdefault(r.team, []).append(r.id)
    for region, place in by_region(df).items():
        alone = lambda i, p=place: 2 * minutes(p["home"], p["at"][i]) + R.SERVICE
        for budget, teams, day in grid:
            left = [i for i in sorted(place["at"], key=lambda i: (-place["prize"][i], i))[:budget] if alone(i) <= day]
            routes = {}
            for team in range(1, teams + 1):
                if not left:
                    break
                at, used = left.pop(0), None
                used, routes[team] = minutes(place["home"], place["at"][at]) + R.SERVICE, [at]
                while left:
                    near = min(left, key=lambda i: (minutes(place["at"][at], place["at"][i]), i))
                    step = minutes(place["at"][at], place["at"][near]) + R.SERVICE
                    if used + step + minutes(place["at"][near], place["home"]) > day:
                        break
                    used, at = used + step, near
                    routes[team].append(near)
                    left.remove(near)
            assert got.get((region, budget, teams, day), {}) == routes


@pytest.mark.parametrize("forced", [False, True])
def test_small_tours_are_the_best_of_all_sets(spark, forced):
    df = frame(spark, 9, 8).withColumn("must", (F.col("id") % 1000 == 4) if forced else F.lit(False))
    got = {(r.region, r.budget, r.day): r for r in R.best_small_tours(df, 3, (480.0, 90.0, 45.0)).collect()}
    for region, place in by_region(df).items():
        must = {region * 1000 + 4} if forced else set()
        for budget, day in itertools.product((1, 2, 3), (480.0, 90.0, 45.0)):
            sets = []
            for k in range(1, budget + 1):
                for some in itertools.combinations(sorted(place["at"]), k):
                    best = min(tour(p, place) for p in itertools.permutations(some)) + R.SERVICE * k
                    if must <= set(some) and best <= day:
                        sets.append((round(sum(place["prize"][i] for i in some), 9), -best, some))
            if not sets:
                assert (region, budget, day) not in got
                continue
            prize, less, some = max(sets)
            r = got[region, budget, day]
            assert r.prize == pytest.approx(prize) and r.minutes == pytest.approx(-less) and tuple(r.ids) == some


def test_exact_never_lies_below_the_heuristic(spark):
    from tests.conftest import DATA

    rows = R.small_budget_gains(spark, DATA).collect()
    assert rows and all(r.heuristic is None or r.exact >= r.heuristic - 1e-6 for r in rows)


def test_holidays_are_observed():
    assert "2027-07-05" in R.observed_holidays(2027) and "2026-11-26" in R.observed_holidays(2026)


def test_workdays(spark):
    days = [str(r.day) for r in R.workdays(spark, "2027-07-01", "2027-07-09").collect()]
    assert "2027-07-05" not in days and "2027-07-06" in days and len(days) == 6


def directed(ids, place):
    path = [place["home"], *[place["at"][i] for i in ids], place["home"]]
    return sum(minutes(a, b) * (1.25 if b[0] > a[0] else 1) for a, b in zip(path, path[1:], strict=False))


def test_directed_reversals_equal_a_loop_whatever_their_number(spark):
    df = frame(spark, 26, 9)
    # a bad start, so that more reversals are needed than one fold makes
    start = R.with_legs(df.withColumn("route", F.lit(1)).withColumn("stop", F.row_number().over(Window.partitionBy("region").orderBy(F.xxhash64("id"))) - 1), "region", "route")
    places, found, turns = by_region(df), paths(R.two_opt(start, R.eastward)), 0
    for (region, route), rows in paths(start).items():
        place, now = places[region], [r.id for r in rows]
        while True:
            cost = directed(now, place)
            tries = [(cost - directed(now[:i] + now[i : j + 1][::-1] + now[j + 1 :], place), -i, -j) for i in range(len(now)) for j in range(i + 1, len(now))]
            gain, i, j = max(tries)
            if gain <= 1e-9:
                break
            now[-i : 1 - j] = now[-i : 1 - j][::-1]
            turns += 1
        own = [r.id for r in found[region, route]]
        assert sorted(own) == sorted(now) and directed(own, place) == pytest.approx(directed(now, place))
        assert directed(own, place) < directed([r.id for r in rows], place)
    assert turns > 2 * tours.TURNS


def matrix(spark, legs, prizes, service, must=(), region=1):
    """A pool and its travel from a matrix whose first row and column are the depot."""
    n = len(prizes)
    pool = spark.createDataFrame([(region, i - 1, float(prizes[i]), float(service[i]), i in must) for i in range(1, n)], "region bigint, rank int, prize double, service double, must boolean")
    travel = spark.createDataFrame([(region, i - 1, j - 1, float(legs[i][j])) for i in range(n) for j in range(n) if i != j], "region bigint, a int, b int, minutes double")
    return pool, travel


TOY = [[0, 10, 10, 30, 30], [10, 0, 5, 30, 30], [10, 5, 0, 30, 30], [30, 30, 30, 0, 5], [30, 30, 30, 5, 0]]


def test_toy_plans_floors_and_an_impossible_floor(spark):
    pool, travel = matrix(spark, TOY, [0, 5, 6, 20, 1], [0, 2, 2, 2, 2])
    plan = lambda day, k=1, **o: tours.team_plans(pool, travel, [(4, k, day)], **o).first()
    got = plan(30.0)
    assert got.prize == 11 and sorted(got.routes[0]) == [0, 1] and got.minutes == 29
    assert plan(70.0).prize >= 21
    both = plan(70.0, 2)
    assert both.prize == 32 and sorted(sorted(r) for r in both.routes) == [[0, 1], [2, 3]]
    pool, travel = matrix(spark, TOY, [0, 5, 6, 20, 1], [0, 2, 2, 2, 2], must=(4,))
    got = tours.team_plans(pool, travel, [(4, 1, 70.0)], floor=1).first()
    assert 3 in got.routes[0] and got.prize == 21
    with pytest.raises(Exception, match="no plan meets the floor"):
        tours.team_plans(pool, travel, [(4, 1, 30.0)], floor=1).collect()
    assert tours.team_plans(pool, travel, [(4, 1, 30.0)], floor=1, strict=False).count() == 0


def test_tours_equal_all_orders_under_directed_travel(spark):
    rng = np.random.default_rng(11)
    legs = rng.random((6, 6)) * 30 + 1
    pool, travel = matrix(spark, legs, [0, *range(1, 6)], [0] + [3] * 5)
    found = {r["mask"]: r for r in tours.best_tours(pool, travel).collect()}
    assert len(found) == 31
    for mask, r in found.items():
        ids = [i for i in range(5) if mask >> i & 1]
        cost = lambda order: legs[0][order[0] + 1] + sum(legs[a + 1][b + 1] for a, b in zip(order, order[1:], strict=False)) + legs[order[-1] + 1][0] + 3 * len(order)
        assert r.minutes == pytest.approx(min(map(cost, itertools.permutations(ids)))) and r.minutes == pytest.approx(cost(r.path)) and r.size == len(ids)


def test_team_plans_equal_all_deals_and_beat_batches(spark):
    df = frame(spark, 9, 12, 1)
    pool = R.pool_of(df, 7)
    place, rows = by_region(df)[0], sorted(pool.collect(), key=lambda r: r["rank"])
    grid = [(b, k, d) for b in (2, 4, 7) for k in (1, 2) for d in (90.0, 200.0)]
    cost = {s: min(tour([rows[i].id for i in o], place) for o in itertools.permutations(s)) + R.SERVICE * len(s) if s else 0.0 for n in range(8) for s in itertools.combinations(range(7), n)}
    for r in tours.team_plans(pool, tours.planar_travel(pool, R.leg), grid).collect():
        want = 0.0
        for deal in itertools.product(range(3 if r.teams == 2 else 2), repeat=7):
            sets = [tuple(i for i in range(7) if deal[i] == t) for t in (1, 2)]
            if sum(map(len, sets)) <= r.budget and all(cost[s] <= r.day for s in sets):
                want = max(want, sum(rows[i].prize for s in sets for i in s))
        assert r.prize == pytest.approx(want)
        assert sorted({i for route in r.routes for i in route}) == sorted(i for route in r.routes for i in route) and r.stops == sum(map(len, r.routes))
    prize = {r.id: r.prize for r in rows}
    heuristic = {}
    for r in R.ranked_batches(pool.drop("rank"), tuple(grid)).collect():
        heuristic[r.budget, r.teams, r.day] = heuristic.get((r.budget, r.teams, r.day), 0) + prize[r.id]
    best = {(r.budget, r.teams, r.day): r.prize for r in tours.team_plans(pool, tours.planar_travel(pool, R.leg), grid).collect()}
    assert all(best[k] >= v - 1e-9 for k, v in heuristic.items())


def test_team_plans_make_no_rows_of_labels_or_deals(spark):
    rng = np.random.default_rng(5)
    rows = [(k, 40 * k + i, *map(float, rng.random(2) * 400), float(rng.random())) for k in range(40) for i in range(14)]
    df = spark.createDataFrame(rows, "region bigint, id bigint, x double, y double, prize double").join(spark.range(40).select(F.col("id").alias("region"), F.lit(200.0).alias("cx"), F.lit(200.0).alias("cy")), "region")
    pool = R.pool_of(df).localCheckpoint()
    plans = tours.team_plans(pool, tours.planar_travel(pool, R.leg), R.EXACT)
    text = plans._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in text
    assert plans.rdd.getNumPartitions() > 2  # small pools are not joined into a task or two
    assert plans.groupBy("region").count().where(f"count != {len(R.EXACT)}").count() == 0


def test_rounding_of_plans_is_that_of_spark(spark):
    values = [0.1234567895, 2.5000000005, 1.0000000015, 0.3333333333333333, 7.0, 123.4567891235, 4.35]
    wanted = spark.createDataFrame([(v,) for v in values], "v double").select(F.round("v", 9).alias("v")).collect()
    assert [r.v for r in wanted] == list(tours.rounded(np.array(values), 9))


def test_equal_tours_keep_the_first_path():
    t = tours.tours_of(np.full((4, 3), 10.0), np.full(3, 10.0), np.ones(3), np.zeros(3, int), 3, 480.0)
    assert t["minutes"][0b111] == 40 and t["path"][0b111] == 0x012


@pytest.mark.parametrize("name", ["rt11_team_sheet", "rt3_team_cycle", "rt5_team_plans", "sm5_gate_sweep"])
def test_team_queries_write_no_labels(spark, monkeypatch, name):
    monkeypatch.setattr(tours, "best_tours", lambda *a, **k: pytest.fail("labels are rows"))
    plan = QUERIES[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "shiftleft" not in plan
