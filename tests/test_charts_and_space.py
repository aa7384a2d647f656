"""Chart specs, clusters and joins by distance on small frames."""

import pytest

from sparkwarden.operators import spatial as S
from sparkwarden.plans.chartspec import DATASETS, ChartSpec, SpecError, aggregate, figure_table, prepare, roles, validate
from tests.conftest import DATA


def test_spec_round_trip_and_strange_keys():
    spec = ChartSpec("stores", "bar", x="segment")
    assert ChartSpec.from_json(spec.to_json()) == spec
    with pytest.raises(SpecError, match="no keys"):
        ChartSpec.from_json({"dataset": "stores", "kind": "bar", "what": 1})
    with pytest.raises(SpecError, match="needs"):
        ChartSpec.from_json({"dataset": "stores"})


@pytest.mark.parametrize(
    "spec, words",
    [
        ({"kind": "pie"}, "no chart of this kind: pie"),
        ({"kind": "bar"}, "can't be drawn without: x"),
        ({"kind": "bar", "x": "nothing"}, "no such column: nothing"),
        ({"kind": "bar", "x": "segment", "y": "name"}, "holds none: name"),
        ({"kind": "bar", "x": "segment", "size": "p"}, "no such channel: size"),
        ({"kind": "bar", "x": "store"}, "over 30 different numbers: store"),
        ({"kind": "bar", "x": "segment", "agg": "mode"}, "not an aggregate .*: mode"),
        ({"kind": "bar", "x": "segment", "top_n": 0}, "not a number of rows to keep: 0"),
        ({"kind": "bar", "x": "segment", "filters": [{"col": "zz"}]}, "no such column: zz"),
        ({"kind": "bar", "x": "segment", "facet": "tract"}, "tract makes more than 6 panels"),
        ({"kind": "map"}, "no such column: x, y"),
    ],
)
def test_problems_are_named(spark, spec, words):
    with pytest.raises(SpecError, match=words):
        prepare(ChartSpec("stores", **spec), spark, DATA)


def test_no_rows_is_an_error(spark):
    with pytest.raises(SpecError, match="No rows"):
        prepare(ChartSpec("stores", "bar", x="segment", filters=[{"col": "p", "min": 9}]), spark, DATA, check_rows=True)


def test_share_counts_all_filtered_rows_and_null_keys_go(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), (None, 3.0), ("b", None)], "k string, v double")
    assert {r.k: r.value for r in aggregate(df, ["k"], None, "share").collect()} == {"a": 0.5, "b": 0.25}
    assert {r.k: r.value for r in aggregate(df, ["k"], "v", "sum").collect()} == {"a": 3.0, "b": 0.0}
    assert validate(ChartSpec("x", "bar", x="k", y="v"), df) == []


def points(spark, rows):
    return spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(rows)], "id bigint, x double, y double")


def test_two_blobs_are_two_clusters_and_isolated_points_noise(spark):
    rows = [(k % 5, k // 5) for k in range(20)] + [(1000 + k % 5, k // 5) for k in range(20)] + [(5000, 5000)]
    out = {r.id: r.cluster for r in S.dbscan(points(spark, rows), 3.0, 4).collect()}
    assert {out[i] for i in range(20)} == {0} and {out[i] for i in range(20, 40)} == {1} and out[40] == -1


def test_a_border_point_joins_the_first_cluster(spark):
    left, right = [(0, 0), (0, 1), (0, -1), (-1, 0)], [(6, 0), (6, 1), (6, -1), (7, 0)]
    out = {r.id: r.cluster for r in S.dbscan(points(spark, [*right, *left, (3, 0)]), 3.0, 5).collect()}
    assert out[8] == 0


def test_clusters_equal_brute_force_on_dense_and_thin_places(spark):
    import random

    for seed, least in ((1, 4), (2, 7), (3, 2)):
        rng = random.Random(seed)
        rows = [(rng.gauss(cx, 6), rng.gauss(cy, 6)) for cx, cy in ((0, 0), (40, 0), (22, 30)) for _ in range(60)] + [(rng.uniform(-60, 90), rng.uniform(-50, 80)) for _ in range(60)] + [(5.0, 5.0)] * 9 + [(15.0, 5.0)]
        eps, n = 5.0, len(rows)
        near = [[j for j in range(n) if ((rows[i][0] - rows[j][0]) ** 2 + (rows[i][1] - rows[j][1]) ** 2) ** 0.5 <= eps] for i in range(n)]
        core = [len(x) >= least for x in near]
        label, wanted = {}, {}
        for i in range(n):
            if core[i] and i not in label:
                label[i], stack = i, [i]
                while stack:
                    for j in near[stack.pop()]:
                        if core[j] and j not in label:
                            label[j] = i
                            stack.append(j)
        number = {k: c for c, k in enumerate(sorted(set(label.values())))}
        for i in range(n):
            wanted[i] = number[label[i]] if core[i] else min((number[label[j]] for j in near[i] if core[j]), default=-1)
        got = {r.id: r.cluster for r in S.dbscan(points(spark, rows), eps, least).collect()}
        assert got == wanted


def test_distance_join_finds_all_pairs_and_skips_nulls(spark):
    rows = [(0, 0), (3, 4), (-3, -4), (100, 100)]
    pts = points(spark, rows).unionByName(spark.createDataFrame([(9, None, None)], "id bigint, x double, y double"))
    got = {(r.id, r.rid) for r in S.within_distance(pts, S.as_right(pts), 5.0).collect()}
    assert got == {(a, b) for a in range(4) for b in range(4) if (rows[a][0] - rows[b][0]) ** 2 + (rows[a][1] - rows[b][1]) ** 2 <= 25}


def test_hot_spot_z(spark):
    from sparkwarden.operators.projections import utm
    from pyspark.sql import functions as F

    east, north = (float(x) for x in spark.range(1).select(*utm(F.lit(-81.0), F.lit(0.0))).first())
    assert east == pytest.approx(500000, abs=1e-3) and north == pytest.approx(0, abs=1e-3)


def copies_in(df) -> bool:
    """Whether the plan makes rows of stores for each simulation."""
    return "sequence(0" in (text := df._jdf.queryExecution().optimizedPlan().toString()) or "Generate" in text


def test_simulated_dataset_counts_no_copies_of_stores(spark):
    df = DATASETS["simulation"].make(spark, DATA)
    assert not copies_in(df) and df.count() == 4


def test_figure_of_second_passes_counts_no_copies_of_stores(spark):
    assert not copies_in(figure_table("second_pass", spark, DATA))


def test_roles_of_the_simulated_dataset_read_no_copies_of_stores(spark):
    df = DATASETS["simulation"].make(spark, DATA)
    assert roles(df) == {"rule": "category", **dict.fromkeys(("events", "repeats", "fresh", "se"), "number")} and not copies_in(df)
