"""Routes of inspection teams, their calendars, and what they cost.

Stops are dealt into regions of bounded size.  Routes come from plans, not from solvers: a sweep around the region's centre
orders the stops, the optimal cut of that tour into days gives the routes, and the reversal that shortens a route most is
made until none does.  Exact answers over a bounded pool of stops are labels that grow by joins (``tours``).  Sequential
rules (nearest next, batches of the highest prizes) are folds over a region's array of stops.  All that looks at
many regions (times, constraints, calendars, costs) is a join or an aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkwarden.functions.rng import uniform, uniform_sql
from sparkwarden.functions.stats import place_within
from sparkwarden.operators import tours
from sparkwarden.plans.registry import ORACLES, query
from sparkwarden.sources.shared import forget, settled
from sparkwarden.sources.tables import POINTS_SQL, STORES, points, stores, table

#: Minutes of a day in the field, of a stop, and per metre; stops of a region, about.
DAY, SERVICE, PACE, REGION = 480.0, 20.0, 0.2, 40


def instance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stops with their region, its centre (where its teams start) and prize: region, id, x, y, prize, cx, cy."""
    rows = points(spark, sf_dir).select(F.expr(f"cast(label * 1000000 + id div {REGION * 10} as bigint)").alias("region"), "id", "x", "y", (0.05 + 0.9 * uniform("prize", "id")).alias("prize"))
    return rows.join(rows.groupBy("region").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy")), "region")


_INSTANCE = f"inst0 AS (SELECT CAST(label * 1000000 + id // {REGION * 10} AS BIGINT) AS region, id, x, y, 0.05 + 0.9 * {uniform_sql('prize', 'id')} AS prize FROM points), inst AS (SELECT i.*, cx, cy FROM inst0 i JOIN (SELECT region, avg(x) AS cx, avg(y) AS cy FROM inst0 GROUP BY region) USING (region))"


def leg(x: Column, y: Column, to_x: Column, to_y: Column) -> Column:
    """Travel minutes between two places."""
    return F.sqrt((x - to_x) * (x - to_x) + (y - to_y) * (y - to_y)) * PACE


_LEG = "sqrt(({0} - {2}) * ({0} - {2}) + ({1} - {3}) * ({1} - {3})) * 0.2::DOUBLE"


@query("rt1_instance", f"WITH {POINTS_SQL}, {_INSTANCE} SELECT region, count(*) AS stops, round(sum(prize), 5) AS prize, round(avg(x), 5) AS depot_x, round(avg(y), 5) AS depot_y FROM inst GROUP BY region")
def instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions with their depots (RT1)."""
    return instance(spark, sf_dir).groupBy("region").agg(F.count("*").alias("stops"), F.round(F.sum("prize"), 5).alias("prize"), F.round(F.avg("x"), 5).alias("depot_x"), F.round(F.avg("y"), 5).alias("depot_y"))


# --- tours and routes --------------------------------------------------------------------------


def with_legs(routes: DataFrame, *route: str, scale: float = 1.0, order: str = "stop") -> DataFrame:
    """routes with the minutes to each stop (from the centre to the first) and, at the last, back."""
    w = Window.partitionBy(*route).orderBy(order)
    x, y = F.col("x"), F.col("y")
    to = leg(F.coalesce(F.lag("x").over(w), F.col("cx")), F.coalesce(F.lag("y").over(w), F.col("cy")), x, y) * scale
    back = F.when(F.lead("x").over(w).isNull(), leg(x, y, F.col("cx"), F.col("cy")) * scale).otherwise(0.0)
    return routes.withColumn("leg", to).withColumn("back", back)


def sweep(rows: DataFrame, scale: float = 1.0) -> DataFrame:
    """Stops in the order of a sweep around the region's centre, with minutes from the centre, to it, and along the sweep."""
    own = Window.partitionBy("region").orderBy(F.atan2(F.col("y") - F.col("cy"), F.col("x") - F.col("cx")), "id")  # a region has some hundred stops at most
    x, y = F.col("x"), F.col("y")
    placed = rows.select("region", "id", "x", "y", "cx", "cy", F.row_number().over(own).alias("place"), F.coalesce(leg(F.lag("x").over(own), F.lag("y").over(own), x, y) * scale, F.lit(0.0)).alias("step"))
    along = F.sum("step").over(Window.partitionBy("region").orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    return placed.select("region", "id", "x", "y", "cx", "cy", "place", (leg(F.col("cx"), F.col("cy"), x, y) * scale).alias("out"), (leg(x, y, F.col("cx"), F.col("cy")) * scale).alias("home"), along.alias("along"))


def split_routes(rows: DataFrame, scale: float = 1.0, day: float = DAY) -> DataFrame:
    """(region, route, stop, id, x, y, cx, cy, leg, back): stops in the order of a sweep around the centre, cut optimally: the fewest
    routes that fit into the day, and of those cuts the one with the fewest minutes (RT14).

    The cut is a shortest path over stretches, a fold over each region's array.  A stop that alone exceeds the day is an error.
    """
    arrays = sweep(rows, scale).groupBy("region").agg(F.array_sort(F.collect_list(F.struct("place", "id", "x", "y", "cx", "cy", "out", "home", "along"))).alias("stops"))
    cuts = arrays.withColumn("cuts", tours.split_starts(F.col("stops"), day, SERVICE))
    each = cuts.select("region", "cuts", F.inline("stops")).withColumn("route", F.size(F.filter("cuts", lambda c: c <= F.col("place"))))
    stop = F.row_number().over(Window.partitionBy("region", "route").orderBy("place")) - 1
    return with_legs(each.withColumn("stop", stop), "region", "route", scale=scale).select("region", "route", "stop", "id", "x", "y", "cx", "cy", "leg", "back")


def routes_sql(source: str, out: str, scale: float = 1.0, day: float = DAY) -> str:
    """The same as SQL: common table expressions, some recursive, that end in ``out``, from a table ``source`` (region, id, x, y, cx, cy)."""
    part = "PARTITION BY region, route ORDER BY place"
    own = f"s[i].o + (s[j + 1].a - s[i].a) + s[j + 1].h + {SERVICE} * (j + 2 - i)"
    return f"""{out}_w AS (SELECT region, id, x, y, cx, cy, row_number() OVER w AS place, coalesce({_LEG.format('lag(x) OVER w', 'lag(y) OVER w', 'x', 'y')} * {scale}::DOUBLE, 0) AS step, {_LEG.format('cx', 'cy', 'x', 'y')} * {scale}::DOUBLE AS o, {_LEG.format('x', 'y', 'cx', 'cy')} * {scale}::DOUBLE AS h FROM {source} WINDOW w AS (PARTITION BY region ORDER BY atan2(y - cy, x - cx), id)),
 {out}_p AS (SELECT *, sum(step) OVER (PARTITION BY region ORDER BY place ROWS UNBOUNDED PRECEDING) AS a FROM {out}_w),
 {out}_s AS (SELECT region, list(struct_pack(o := o, h := h, a := a) ORDER BY place) AS s, count(*) AS n FROM {out}_p GROUP BY region),
 {out}_d(region, s, n, j, best) AS (SELECT region, s, n, 0::BIGINT, [struct_pack(r := 0::BIGINT, m := 0::DOUBLE, f := 0::BIGINT)] FROM {out}_s UNION ALL
  SELECT region, s, n, j + 1, list_append(best, list_sort(list_filter(list_transform(range(greatest(1, j + 2 - {tours.STOPS}), j + 2), lambda i: CASE WHEN {own} <= {day} + 1e-9 THEN struct_pack(r := best[i].r + 1, m := round(best[i].m + {own}, 7), f := i) END), lambda c: c IS NOT NULL))[1]) FROM {out}_d WHERE j < n),
 {out}_b(region, best, start, stop) AS (SELECT region, best, best[n + 1].f, n FROM {out}_d WHERE j = n UNION ALL SELECT region, best, best[start].f, start - 1 FROM {out}_b WHERE start > 1),
 {out}_r AS (SELECT region, start, stop, CAST(row_number() OVER (PARTITION BY region ORDER BY start) AS INTEGER) AS route FROM {out}_b),
 {out} AS (SELECT region, route, row_number() OVER ({part}) - 1 AS stop, id, x, y, cx, cy, {_LEG.format(f'coalesce(lag(x) OVER ({part}), cx)', f'coalesce(lag(y) OVER ({part}), cy)', 'x', 'y')} * {scale}::DOUBLE AS leg, CASE WHEN lead(x) OVER ({part}) IS NULL THEN {_LEG.format('x', 'y', 'cx', 'cy')} * {scale}::DOUBLE ELSE 0 END AS back FROM (SELECT p.region, r.route, p.place, p.id, p.x, p.y, p.cx, p.cy FROM {out}_p p JOIN {out}_r r ON r.region = p.region AND p.place BETWEEN r.start AND r.stop))"""


def two_opt(routes: DataFrame, minutes=None) -> DataFrame:
    """routes with stretches reversed, always the one that shortens a route most, until none does (RT13).

    ``minutes(a, b)`` of two stops is straight travel unless given, and may differ from ``minutes(b, a)``.
    """
    minutes = minutes or straight
    whole = routes.groupBy("region", "route").agg(F.transform(F.array_sort(F.collect_list(F.struct("stop", "id", "x", "y"))), lambda s: F.struct(s["id"].alias("id"), s["x"].alias("x"), s["y"].alias("y"))).alias("stops"), F.first("cx").alias("cx"), F.first("cy").alias("cy"))
    whole = settled(whole.withColumn("depot", F.struct(F.lit(-1).cast("bigint").alias("id"), F.col("cx").alias("x"), F.col("cy").alias("y"))))
    turned = tours.reversals(whole.select("region", "route", "stops", "depot"), ("region", "route"), minutes)
    each = turned.join(whole.select("region", "route", "cx", "cy"), ["region", "route"]).select("region", "route", "cx", "cy", F.posexplode("stops").alias("stop", "s"))
    return with_legs(each.select("region", "route", "stop", "s.id", "s.x", "s.y", "cx", "cy"), "region", "route")


def straight(a: Column, b: Column) -> Column:
    """Travel minutes between two stops."""
    return leg(a["x"], a["y"], b["x"], b["y"])


def eastward(a: Column, b: Column) -> Column:
    """Travel minutes that are a quarter longer towards the east."""
    return straight(a, b) * F.when(b["x"] > a["x"], 1.25).otherwise(1.0)


def route_times(routes: DataFrame) -> DataFrame:
    """Per route: stops, driving minutes and minutes in all (RT8)."""
    g = routes.groupBy("region", "route").agg(F.count("*").alias("stops"), F.sum(F.col("leg") + F.col("back")).alias("drive"))
    return g.withColumn("minutes", F.col("drive") + SERVICE * F.col("stops"))


def _times_sql(routes: str) -> str:
    return f"(SELECT region, route, count(*) AS stops, sum(leg + back) AS drive, sum(leg + back) + {SERVICE} * count(*) AS minutes FROM {routes} GROUP BY ALL)"


_ROUTES = f"{POINTS_SQL}, {_INSTANCE}, {routes_sql('inst', 'routes')}"


@query("rt14_split_routes", f"WITH RECURSIVE {_ROUTES} SELECT region, route, stop, id, round(leg, 6) AS leg, round(back, 6) AS back FROM routes")
def split_route_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sweep and optimal cut: every stop once, on the fewest routes within the day, then in the fewest minutes (RT14, RT15)."""
    return split_routes(instance(spark, sf_dir)).select("region", "route", "stop", "id", F.round("leg", 6).alias("leg"), F.round("back", 6).alias("back"))


@query("rt15_census_routes")
def census_route_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same routes, shortened by reversals (RT13, RT15)."""
    return two_opt(split_routes(instance(spark, sf_dir))).select("region", "route", "stop", "id", F.round("leg", 6).alias("leg"), F.round("back", 6).alias("back"))


def nearest_tour(rows: DataFrame) -> DataFrame:
    """(region, stop, id, leg): from the centre always to the nearest stop that is left: a fold over a region's array (RT12)."""
    arrays = rows.groupBy("region", "cx", "cy").agg(F.array_sort(F.collect_list(F.struct("id", "x", "y"))).alias("stops"))
    start = F.struct(F.col("cx").alias("x"), F.col("cy").alias("y"), F.col("stops").alias("left"), F.array().cast("array<struct<id: bigint, leg: double>>").alias("path"))

    def step(acc: Column, _: Column) -> Column:
        near = F.array_min(F.transform(acc["left"], lambda s: F.struct(leg(acc["x"], acc["y"], s["x"], s["y"]).alias("leg"), s["id"].alias("id"), s["x"].alias("x"), s["y"].alias("y"))))
        # an array of one binds the nearest to a name
        return F.transform(F.array(near), lambda s: F.struct(s["x"].alias("x"), s["y"].alias("y"), F.filter(acc["left"], lambda r: r["id"] != s["id"]).alias("left"), F.concat(acc["path"], F.array(F.struct(s["id"].alias("id"), s["leg"].alias("leg")))).alias("path")))[0]

    folded = arrays.select("region", F.aggregate(F.sequence(F.lit(1), F.size("stops")), start, step)["path"].alias("path"))
    return folded.select("region", F.posexplode("path").alias("stop", "p")).select("region", "stop", "p.id", "p.leg")


@query("rt12_nearest_tour")
def nearest_tours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest-neighbour tours of all regions (RT12)."""
    t = nearest_tour(instance(spark, sf_dir))
    return t.select("region", "stop", "id", F.round("leg", 6).alias("leg"))


@query(
    "rt16_check_routes",
    f"WITH RECURSIVE {_ROUTES}, seen AS (SELECT region, id, count(*) AS k FROM routes GROUP BY ALL), times AS {_times_sql('routes')} SELECT i.region, count(*) AS stops, count(*) FILTER (k IS NULL) AS missing, count(*) FILTER (k > 1) AS repeated, min(t.too_long) AS too_long, min(t.routes) AS routes FROM inst i LEFT JOIN seen USING (region, id) JOIN (SELECT region, count(*) AS routes, count(*) FILTER (minutes > {DAY} + 1e-6) AS too_long FROM times GROUP BY 1) t ON t.region = i.region GROUP BY i.region",
)
def check_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Constraints per region: each stop once, each route within the day; missing, repeated and too_long must be 0 (RT16)."""
    rows = instance(spark, sf_dir)
    routes = settled(split_routes(rows))
    seen = rows.select("region", "id").join(routes.groupBy("region", "id").agg(F.count("*").alias("k")), ["region", "id"], "left")
    stops = seen.groupBy("region").agg(F.count("*").alias("stops"), F.count_if(F.col("k").isNull()).alias("missing"), F.count_if(F.col("k") > 1).alias("repeated"))
    long = route_times(routes).groupBy("region").agg(F.count_if(F.col("minutes") > DAY + 1e-6).alias("too_long"), F.count("*").alias("routes"))
    return stops.join(long, "region")


@query(
    "rt8_route_statistics",
    f"WITH RECURSIVE {_ROUTES}, times AS {_times_sql('routes')} SELECT region, count(*) AS routes, min(stops) AS fewest, round(avg(stops), 4) AS mean_stops, max(stops) AS most, round(max(minutes), 4) AS longest, round(sum(drive) / sum(minutes), 6) AS drive_share, CAST(ceil(sum(stops) * {SERVICE} / {DAY}) AS BIGINT) AS least_routes, CAST(ceil(count(*) / 10.0) AS BIGINT) AS weeks_two_teams FROM times GROUP BY region",
)
def route_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stops, times and the bound from below of the number of routes (RT8, NB5, NB6)."""
    t = route_times(split_routes(instance(spark, sf_dir)))
    return t.groupBy("region").agg(F.count("*").alias("routes"), F.min("stops").alias("fewest"), F.round(F.avg("stops"), 4).alias("mean_stops"), F.max("stops").alias("most"), F.round(F.max("minutes"), 4).alias("longest"), F.round(F.sum("drive") / F.sum("minutes"), 6).alias("drive_share"), F.ceil(F.sum("stops") * SERVICE / DAY).alias("least_routes"), F.ceil(F.count("*") / 10).alias("weeks_two_teams"))


@query("rt13_directed_reversals")
def directed_reversals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minutes of each route before and after reversals, where travel towards the east is dearer (RT13)."""
    routes = settled(split_routes(instance(spark, sf_dir)))
    w = Window.partitionBy("region", "route").orderBy("stop")

    def driven(df: DataFrame) -> DataFrame:
        here, centre = F.struct("x", "y"), F.struct(F.col("cx").alias("x"), F.col("cy").alias("y"))
        before, last = F.coalesce(F.lag(here).over(w), centre), F.lead("x").over(w).isNull()
        legs = df.withColumn("went", eastward(before, here) + F.when(last, eastward(here, centre)).otherwise(0.0))
        return legs.groupBy("region", "route").agg(F.count("*").alias("stops"), F.sum("went").alias("drive"))

    after = driven(two_opt(routes, eastward)).select("region", "route", F.round("drive", 5).alias("after"))
    return driven(routes).select("region", "route", "stops", F.round("drive", 5).alias("before")).join(after, ["region", "route"])


#: Stops of a region on which the sweep is held against the best tour.
TRIAL = 9
_GROW = _LEG.format("t.x", "t.y", "u.x", "u.y")


@query(
    "rt18_heuristic_gap",
    f"""WITH RECURSIVE {POINTS_SQL}, {_INSTANCE}, t AS (SELECT * REPLACE (CAST(r - 1 AS INTEGER) AS r) FROM (SELECT *, row_number() OVER (PARTITION BY region ORDER BY {uniform_sql('gap', 'id')}, id) AS r FROM inst) WHERE r <= {TRIAL}), n AS (SELECT region, CAST(count(*) AS INTEGER) AS n FROM t GROUP BY 1),
 path(region, mask, last, len) AS (SELECT region, 1 << r, r, {_LEG.format('cx', 'cy', 'x', 'y')} FROM t UNION ALL SELECT p.region, p.mask | (1 << u.r), u.r, min(p.len + {_GROW}) FROM path p JOIN t ON t.region = p.region AND t.r = p.last JOIN t u ON u.region = p.region AND (p.mask & (1 << u.r)) = 0 GROUP BY 1, 2, 3),
 e AS (SELECT p.region, min(len + {_LEG.format('x', 'y', 'cx', 'cy')}) AS exact FROM path p JOIN n ON n.region = p.region AND p.mask = (1 << n) - 1 JOIN t ON t.region = p.region AND t.r = p.last GROUP BY 1),
 o AS (SELECT *, {_LEG.format('coalesce(lag(x) OVER w, cx)', 'coalesce(lag(y) OVER w, cy)', 'x', 'y')} AS leg, CASE WHEN lead(x) OVER w IS NULL THEN {_LEG.format('x', 'y', 'cx', 'cy')} ELSE 0 END AS back FROM t WINDOW w AS (PARTITION BY region ORDER BY atan2(y - cy, x - cx), id)), h AS (SELECT region, count(*) AS stops, sum(leg + back) AS heuristic FROM o GROUP BY region)
 SELECT region, stops, round(exact, 4) AS exact, round(heuristic, 4) AS heuristic, CASE WHEN exact > 0 THEN round((heuristic - exact) / exact, 6) END AS gap FROM e JOIN h USING (region)""",
)
def heuristic_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sweep against the best tour through nine random stops of each region: labels of (set, last), one join a stop (RT17, RT18)."""
    t = settled(tours.numbered(instance(spark, sf_dir), "region", [uniform("gap", "id"), "id"], TRIAL))
    pool = t.withColumns({"service": F.lit(0.0), "must": F.lit(False)})
    n = t.groupBy("region").agg(F.count("*").alias("stops"))
    exact = tours.best_tours(pool, tours.planar_travel(t, leg), TRIAL).join(n, "region").where("size = stops").select("region", F.col("minutes").alias("exact"))
    swept = with_legs(t.withColumn("angle", F.struct(F.atan2(F.col("y") - F.col("cy"), F.col("x") - F.col("cx")), "id")), "region", order="angle").groupBy("region").agg(F.count("*").alias("stops"), F.sum(F.col("leg") + F.col("back")).alias("heuristic"))
    gap = F.when(F.col("exact") > 0, F.round((F.col("heuristic") - F.col("exact")) / F.col("exact"), 6))
    return exact.join(swept, "region").select("region", "stops", F.round("exact", 4).alias("exact"), F.round("heuristic", 4).alias("heuristic"), gap.alias("gap"))


# --- orienteering ------------------------------------------------------------------------------

#: Days, and budgets that are solved exactly: all sets of so many stops of a region are looked at.
DAYS, SMALL = (480.0, 240.0, 120.0), 3


def best_small_tours(rows: DataFrame, budgets: int = SMALL, days: tuple[float, ...] = DAYS) -> DataFrame:
    """(region, budget, day, prize, minutes, ids): of all sets of at most ``budget`` stops whose best tour fits into the day, the one with the highest prize, then the fewest minutes.

    rows: region, id, x, y, prize, cx, cy, must; sets hold every stop that must be visited (a floor of coverage).  Tours
    of three stops have three orders that differ.  A region without a feasible set has no row.
    """
    one = rows.select("region", "id", "x", "y", "prize", "cx", "cy", F.col("must").cast("int").alias("must"))
    due = rows.groupBy("region").agg(F.sum(F.col("must").cast("int")).alias("due"))

    def named(k: str) -> DataFrame:
        return one.select("region", *[F.col(c).alias(f"{c}_{k}") for c in ("id", "x", "y", "prize", "must")])

    def d(a: str, b: str) -> Column:
        place = lambda k: (F.col("cx"), F.col("cy")) if k == "0" else (F.col(f"x_{k}"), F.col(f"y_{k}"))
        return leg(*place(a), *place(b))

    base = one.select("region", "cx", "cy").distinct()
    singles = base.join(named("a"), "region")
    pairs = singles.join(named("b"), "region").where("id_a < id_b")
    triples = pairs.join(named("c"), "region").where("id_b < id_c")
    kinds = [(singles, ("a",), 2 * d("0", "a")), (pairs, ("a", "b"), d("0", "a") + d("a", "b") + d("b", "0"))]
    orders = [d("0", p) + d(p, q) + d(q, r) + d(r, "0") for p, q, r in (("a", "b", "c"), ("a", "c", "b"), ("b", "a", "c"))]
    kinds.append((triples, ("a", "b", "c"), F.least(*orders)))
    sets = None
    for frame, names, drive in kinds[:budgets]:
        some = frame.select("region", F.lit(len(names)).alias("k"), sum((F.col(f"prize_{n}") for n in names[1:]), F.col(f"prize_{names[0]}")).alias("prize"), (drive + SERVICE * len(names)).alias("minutes"), F.array(*[F.col(f"id_{n}") for n in names]).alias("ids"), sum((F.col(f"must_{n}") for n in names[1:]), F.col(f"must_{names[0]}")).alias("has"))
        sets = some if sets is None else sets.unionByName(some)
    grid = F.array(*[F.struct(F.lit(b).alias("budget"), F.lit(float(x)).alias("day")) for b in range(1, budgets + 1) for x in days])
    tried = sets.join(due, "region").where("has = due").select("region", "k", "prize", "minutes", "ids", F.inline(grid)).where("k <= budget AND minutes <= day")
    best = tried.groupBy("region", "budget", "day").agg(F.max(F.struct(F.round("prize", 9).alias("prize"), (-F.col("minutes")).alias("less"), "ids")).alias("b"))
    return best.select("region", "budget", "day", F.col("b.prize").alias("prize"), (-F.col("b.less")).alias("minutes"), F.col("b.ids").alias("ids"))


_D = lambda a, b: _LEG.format(*(("cx", "cy") if a == "0" else (f"{a}.x", f"{a}.y")), *(("cx", "cy") if b == "0" else (f"{b}.x", f"{b}.y"))).replace("cx", "a.cx").replace("cy", "a.cy")
_SETS = f"""sets AS (SELECT a.region, 1 AS k, a.prize AS prize, 2 * {_D('0', 'a')} + {SERVICE} AS minutes, [a.id] AS ids, a.must AS has FROM m a
 UNION ALL SELECT a.region, 2, a.prize + b.prize, {_D('0', 'a')} + {_D('a', 'b')} + {_D('b', '0')} + {2 * SERVICE}, [a.id, b.id], a.must + b.must FROM m a JOIN m b ON b.region = a.region AND a.id < b.id
 UNION ALL SELECT a.region, 3, a.prize + b.prize + c.prize, least({_D('0', 'a')} + {_D('a', 'b')} + {_D('b', 'c')} + {_D('c', '0')}, {_D('0', 'a')} + {_D('a', 'c')} + {_D('c', 'b')} + {_D('b', '0')}, {_D('0', 'b')} + {_D('b', 'a')} + {_D('a', 'c')} + {_D('c', '0')}) + {3 * SERVICE}, [a.id, b.id, c.id], a.must + b.must + c.must FROM m a JOIN m b ON b.region = a.region AND a.id < b.id JOIN m c ON c.region = a.region AND b.id < c.id),
 best AS (SELECT s.region, budget, day, arg_max(ids, (round(prize, 9), -minutes, ids)) AS ids, max(round(prize, 9)) AS prize, arg_max(minutes, (round(prize, 9), -minutes, ids)) AS minutes FROM sets s JOIN (SELECT region, sum(must) AS due FROM m GROUP BY 1) u ON u.region = s.region AND has = due, (VALUES (1), (2), (3)) b(budget), (VALUES (480.0::DOUBLE), (240.0::DOUBLE), (120.0::DOUBLE)) d(day) WHERE k <= budget AND minutes <= day GROUP BY ALL)"""


@query("rt4_best_small_tours", f"WITH {POINTS_SQL}, {_INSTANCE}, m AS (SELECT *, 0 AS must FROM inst), {_SETS} SELECT region, budget, day, round(prize, 6) AS prize, round(minutes, 5) AS minutes, ids FROM best")
def small_tours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best single tours of one to three stops over all stops of each region, in days of three lengths (RT4)."""
    best = best_small_tours(instance(spark, sf_dir).withColumn("must", F.lit(False)))
    return best.select("region", "budget", "day", F.round("prize", 6).alias("prize"), F.round("minutes", 5).alias("minutes"), "ids")


@query(
    "rt3_plan_cycle",
    f"WITH {POINTS_SQL}, {_INSTANCE}, drawn AS (SELECT region, id, x, y, cx, cy, prize * (0.8 + 0.4 * {uniform_sql('cycle', '0', 'id')}) AS prize, row_number() OVER (PARTITION BY region ORDER BY {uniform_sql('forced', 'id')}, id) AS r FROM inst), m AS (SELECT region, id, x, y, cx, cy, prize, CAST(r = 1 AS INTEGER) AS must FROM drawn), {_SETS} SELECT region, budget, day, round(prize, 6) AS prize, round(minutes, 5) AS minutes, ids FROM best",
)
def plan_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cycle's plan: drawn prizes, and a random stop of each region that must be visited (RT3, RT5's floor of coverage)."""
    rows = instance(spark, sf_dir).withColumn("prize", F.col("prize") * (0.8 + 0.4 * uniform("cycle", F.lit(0), "id")))
    forced = top_of(rows, uniform("forced", "id")).select("id", F.lit(True).alias("must"))
    best = best_small_tours(rows.join(forced, "id", "left").withColumn("must", F.coalesce("must", F.lit(False))))
    return best.select("region", "budget", "day", F.round("prize", 6).alias("prize"), F.round("minutes", 5).alias("minutes"), "ids")


def top_of(rows: DataFrame, order: Column, k: int = 1) -> DataFrame:
    """The first k stops of each region."""
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy("region").orderBy(order, "id"))).where(F.col("rn") <= k)


#: The sweep of the heuristic: budgets, teams and days.
GRID = tuple((b, k, day) for b in (4, 8, 15, 25) for k in (1, 2) for day in DAYS)


def ranked_batches(rows: DataFrame, grid=GRID) -> DataFrame:
    """(region, budget, teams, day, team, stop, id): the highest prizes of a region, batched into routes (RT7).

    A team starts with the best stop that is left and fits alone, and goes on to the nearest while the day lasts.  Budgets bound
    the stops, which are folded as one array per region and setting.
    """
    most = max(b for b, _, _ in grid)
    ranked = top_of(rows, F.desc("prize"), most).withColumn("alone", 2 * leg(F.col("x"), F.col("y"), F.col("cx"), F.col("cy")) + SERVICE)
    arrays = ranked.groupBy("region", "cx", "cy").agg(F.array_sort(F.collect_list(F.struct("rn", "id", "x", "y", "alone"))).alias("all"))
    settings = arrays.withColumn("g", F.explode(F.array(*[F.struct(F.lit(b).alias("budget"), F.lit(k).alias("teams"), F.lit(float(d)).alias("day")) for b, k, d in grid]))).select("region", "cx", "cy", "all", "g.*")
    left = F.filter(F.slice("all", 1, F.col("budget")), lambda s: s["alone"] <= F.col("day"))
    start = F.struct(left.alias("left"), F.lit(0).alias("team"), F.lit(0.0).alias("used"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.array().cast("array<struct<team: int, id: bigint>>").alias("out"))
    home = lambda s: leg(s["x"], s["y"], F.col("cx"), F.col("cy"))

    def take(acc: Column, s: Column, team: Column, used: Column) -> Column:
        return F.struct(F.filter(acc["left"], lambda r: r["id"] != s["id"]).alias("left"), team.alias("team"), used.alias("used"), s["x"].alias("x"), s["y"].alias("y"), F.concat(acc["out"], F.array(F.struct(team.alias("team"), s["id"].alias("id")))).alias("out"))

    def step(acc: Column, _: Column) -> Column:
        near = F.array_min(F.transform(acc["left"], lambda s: F.struct(leg(acc["x"], acc["y"], s["x"], s["y"]).alias("leg"), s["id"].alias("id"), s["x"].alias("x"), s["y"].alias("y"))))
        goes_on = lambda s: (acc["team"] > 0) & (acc["used"] + s["leg"] + SERVICE + home(s) <= F.col("day"))
        first = F.get(acc["left"], F.lit(0))
        begun = F.when(acc["team"] < F.col("teams"), take(acc, first, acc["team"] + 1, home(first) + SERVICE)).otherwise(acc)
        moved = F.transform(F.array(near), lambda s: F.when(goes_on(s), take(acc, s, acc["team"], acc["used"] + s["leg"] + SERVICE)).otherwise(begun))[0]
        return F.when(F.size(acc["left"]) > 0, moved).otherwise(acc)

    folded = settings.select("region", "budget", "teams", "day", F.aggregate(F.sequence(F.lit(1), F.col("budget") + F.col("teams")), start, step)["out"].alias("out"))
    return folded.select("region", "budget", "teams", "day", F.posexplode("out").alias("stop", "o")).select("region", "budget", "teams", "day", "o.team", "stop", "o.id")


@query("rt7_ranked_batches")
def batches_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the heuristic collects in each region for four budgets, two numbers of teams and three days (RT7, SM5)."""
    rows = instance(spark, sf_dir)
    g = ranked_batches(rows).join(rows.select("region", "id", "prize"), ["region", "id"]).groupBy("region", "budget", "teams", "day")
    return g.agg(F.count("*").alias("stops"), F.countDistinct("team").alias("routes"), F.round(F.sum("prize"), 6).alias("prize"))


@query("sm5_small_budget_gains")
def small_budget_gains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact best tours against the heuristic where budgets are small: gain in per cent (SM5, RT4, RT7)."""
    rows = instance(spark, sf_dir)
    own = ranked_batches(rows, tuple((b, 1, d) for b in range(1, SMALL + 1) for d in DAYS)).join(rows.select("region", "id", "prize"), ["region", "id"]).groupBy("region", "budget", "day").agg(F.sum("prize").alias("heuristic"))
    both = best_small_tours(rows.withColumn("must", F.lit(False))).join(own, ["region", "budget", "day"], "left")
    return both.select("region", "budget", "day", F.round("prize", 6).alias("exact"), F.round("heuristic", 6).alias("heuristic"), F.round(100 * F.try_divide(F.col("prize") - F.col("heuristic"), F.col("heuristic")), 4).alias("gain_pct"))


# --- teams ----------------------------------------------------------------------------------------

#: The settings that are solved exactly over a pool: budgets, teams and days; and a day that one stop of a region may not fit.
EXACT = tuple((b, k, day) for b in (4, 8) for k in (1, 2) for day in DAYS)


def pool_of(rows: DataFrame, size: int = tours.POOL) -> DataFrame:
    """The stops with the highest prizes of each region, ranked from 0."""
    pool = tours.numbered(rows, "region", [F.desc("prize"), "id"], size).withColumn("service", F.lit(SERVICE))
    return pool if "must" in pool.columns else pool.withColumn("must", F.lit(False))


def named_plans(pool: DataFrame, plans: DataFrame) -> DataFrame:
    """plans with the ids of each route's stops in their own order, instead of ranks."""
    ids = pool.groupBy("region").agg(F.map_from_entries(F.collect_list(F.struct("rank", "id"))).alias("ids"))  # a pool is bounded
    named = F.transform("routes", lambda r: F.transform(r, lambda k: F.element_at(F.col("ids"), k)))
    return plans.join(ids, "region").withColumn("routes", named).drop("ids")


def _team_sql(pool: str, grid, floor: int = 0, tag: str = "") -> str:
    """SQL of the best plans over a pool (region, r, id, x, y, prize, cx, cy, must): region, budget, teams, day, stops, prize, minutes, and the sets of both teams with their minutes."""
    budgets, days, teams = sorted({b for b, _, _ in grid}), sorted({d for _, _, d in grid}, reverse=True), sorted({k for _, k, _ in grid})
    values = lambda xs: ", ".join(f"({x})" for x in xs)
    path, whole, tour, plan, best = (f"{n}{tag}" for n in ("path", "whole", "tour", "plan", "best"))
    return f"""{path}(region, mask, last, len) AS (SELECT region, 1 << r, r, {_LEG.format('cx', 'cy', 'x', 'y')} + {SERVICE} FROM {pool} UNION ALL SELECT p.region, p.mask | (1 << u.r), u.r, min(p.len + {_GROW} + {SERVICE}) FROM {path} p JOIN {pool} t ON t.region = p.region AND t.r = p.last JOIN {pool} u ON u.region = p.region AND (p.mask & (1 << u.r)) = 0 WHERE bit_count(p.mask) < {max(budgets)} GROUP BY 1, 2, 3),
 {whole} AS (SELECT p.region, p.mask, min(p.len + {_LEG.format('t.x', 't.y', 't.cx', 't.cy')}) AS minutes FROM {path} p JOIN {pool} t ON t.region = p.region AND t.r = p.last GROUP BY 1, 2),
 {tour} AS (SELECT w.region, w.mask, any_value(w.minutes) AS minutes, round(sum(t.prize), 9) AS prize, sum(t.must) AS due, count(*) AS size FROM {whole} w JOIN {pool} t ON t.region = w.region AND (w.mask & (1 << t.r)) > 0 GROUP BY 1, 2 UNION ALL SELECT DISTINCT region, 0, 0::DOUBLE, 0::DOUBLE, 0, 0 FROM {pool}),
 {plan} AS (SELECT region, 1 AS used, size, prize, due, minutes, minutes AS longest, mask AS a, 0 AS b, minutes AS ma, 0::DOUBLE AS mb FROM {tour} UNION ALL SELECT a.region, 2, a.size + b.size, round(a.prize + b.prize, 9), a.due + b.due, a.minutes + b.minutes, greatest(a.minutes, b.minutes), a.mask, b.mask, a.minutes, b.minutes FROM {tour} a JOIN {tour} b ON b.region = a.region AND (a.mask & b.mask) = 0 AND (a.mask & -a.mask) < (b.mask & -b.mask) AND a.mask > 0 AND a.size + b.size <= {max(budgets)}),
 {best} AS (SELECT *, p.stops AS stops, p.minutes AS minutes FROM (SELECT region, budget, teams, day, max(prize) AS prize, arg_max(struct_pack(stops := size, minutes := minutes, a := a, b := b, ma := ma, mb := mb), (prize, -round(minutes, 7), -used)) AS p FROM {plan}, (VALUES {values(budgets)}) b(budget), (VALUES {values(teams)}) k(teams), (VALUES {values(f'{d}::DOUBLE' for d in days)}) d(day) WHERE size <= budget AND used <= teams AND longest <= day + 1e-9 AND due >= {floor} GROUP BY 1, 2, 3, 4))"""


_POOL = f"pool AS (SELECT * REPLACE (CAST(r - 1 AS INTEGER) AS r), 0 AS must FROM (SELECT *, row_number() OVER (PARTITION BY region ORDER BY prize DESC, id) AS r FROM inst) WHERE r <= {tours.POOL})"


@query("rt5_team_plans", f"WITH RECURSIVE {POINTS_SQL}, {_INSTANCE}, {_POOL}, {_team_sql('pool', EXACT)} SELECT region, budget, teams, day, CAST(stops AS INTEGER) AS stops, round(prize, 6) AS prize, round(minutes, 5) AS minutes FROM best")
def team_plan_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best plans of one and two teams over each region's pool, for budgets of four and eight and three days, exactly (RT5, RT4)."""
    pool = settled(pool_of(instance(spark, sf_dir)))
    plans = tours.team_plans(pool, tours.planar_travel(pool, leg), EXACT)
    return plans.select("region", "budget", "teams", "day", "stops", F.round("prize", 6).alias("prize"), F.round("minutes", 5).alias("minutes"))


#: Stops of a region's random floor, and how many of them every plan has to visit.
DUE, FLOOR = 3, 1


@query(
    "rt3_team_cycle",
    f"""WITH RECURSIVE {POINTS_SQL}, {_INSTANCE}, drawn AS (SELECT region, id, x, y, cx, cy, prize * (0.8 + 0.4 * {uniform_sql('cycle', '0', 'id')}) AS prize FROM inst), pool0 AS (SELECT * REPLACE (CAST(r - 1 AS INTEGER) AS r) FROM (SELECT *, row_number() OVER (PARTITION BY region ORDER BY prize DESC, id) AS r FROM drawn) WHERE r <= {tours.POOL}),
 pool AS (SELECT *, CAST(row_number() OVER (PARTITION BY region ORDER BY {uniform_sql('forced', 'id')}, id) <= {DUE} AS INTEGER) AS must FROM pool0), {_team_sql('pool', EXACT, FLOOR)} SELECT region, budget, teams, day, CAST(stops AS INTEGER) AS stops, round(prize, 6) AS prize, round(minutes, 5) AS minutes FROM best""",
)
def team_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cycle's team plans: drawn prizes, and a floor: each plan visits one of three random stops of its region's pool at least (RT3, RT5).

    Where no plan meets the floor within a day there is no row.
    """
    pool = pool_of(instance(spark, sf_dir).withColumn("prize", F.col("prize") * (0.8 + 0.4 * uniform("cycle", F.lit(0), "id"))))
    due = F.row_number().over(Window.partitionBy("region").orderBy(uniform("forced", "id"), "id")) <= DUE
    pool = settled(pool.withColumn("must", due))
    plans = tours.team_plans(pool, tours.planar_travel(pool, leg), EXACT, FLOOR, strict=False)
    return plans.select("region", "budget", "teams", "day", "stops", F.round("prize", 6).alias("prize"), F.round("minutes", 5).alias("minutes"))


@query("sm5_gate_sweep")
def gate_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 24 settings over each region's pool: the exact plan against ranked batches, and the gain in per cent (SM5, RT5, RT7).

    ``bounded``: the budget exceeds the pool, so that the exact plan is one of the pool's stops alone.
    """
    pool = settled(pool_of(instance(spark, sf_dir)))
    plans = tours.team_plans(pool, tours.planar_travel(pool, leg), GRID).select("region", "budget", "teams", "day", "stops", "prize", "minutes")
    own = ranked_batches(pool.drop("rank")).join(pool.select("region", "id", F.col("prize").alias("p")), ["region", "id"]).groupBy("region", "budget", "teams", "day").agg(F.sum("p").alias("heuristic"), F.count("*").alias("heuristic_stops"))
    both = plans.join(own, ["region", "budget", "teams", "day"], "left").na.fill({"heuristic": 0.0, "heuristic_stops": 0})
    gain = F.when(F.col("heuristic") > 0, F.round(100 * (F.col("prize") / F.col("heuristic") - 1), 4))
    return both.select("region", "budget", "teams", "day", "stops", F.round("prize", 6).alias("prize"), F.round("minutes", 4).alias("minutes"), "heuristic_stops", F.round("heuristic", 6).alias("heuristic"), gain.alias("gain_pct"), (F.col("budget") > tours.POOL).alias("bounded"))


@query(
    "rt10_horizon",
    f"WITH {POINTS_SQL}, {_INSTANCE}, reach AS (SELECT * FROM inst WHERE 2 * {_LEG.format('x', 'y', 'cx', 'cy')} + {SERVICE} <= {DAY}), h0 AS (SELECT * FROM (SELECT region, id, 0 AS cycle, prize * (0.8 + 0.4 * {uniform_sql('cycle', '0', 'id')}) AS score, row_number() OVER (PARTITION BY region ORDER BY prize * (0.8 + 0.4 * {uniform_sql('cycle', '0', 'id')}) DESC, id) AS place FROM reach) WHERE place <= 4), h1 AS (SELECT * FROM (SELECT region, id, 1 AS cycle, prize * (0.8 + 0.4 * {uniform_sql('cycle', '1', 'id')}) AS score, row_number() OVER (PARTITION BY region ORDER BY prize * (0.8 + 0.4 * {uniform_sql('cycle', '1', 'id')}) DESC, id) AS place FROM (SELECT * FROM reach WHERE id NOT IN (SELECT id FROM h0))) WHERE place <= 4), h2 AS (SELECT * FROM (SELECT region, id, 2 AS cycle, prize * (0.8 + 0.4 * {uniform_sql('cycle', '2', 'id')}) AS score, row_number() OVER (PARTITION BY region ORDER BY prize * (0.8 + 0.4 * {uniform_sql('cycle', '2', 'id')}) DESC, id) AS place FROM (SELECT * FROM reach WHERE id NOT IN (SELECT id FROM h0 UNION ALL SELECT id FROM h1))) WHERE place <= 4) SELECT region, id, cycle, round(score, 6) AS score, place, (place - 1) % 2 + 1 AS team FROM (SELECT * FROM h0 UNION ALL SELECT * FROM h1 UNION ALL SELECT * FROM h2)",
)
def horizon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three monthly cycles per region, four stops each, no stop twice: the visited go by an anti join, and so do stops that no day holds (RT10)."""
    rows = instance(spark, sf_dir)
    left, done = rows.where(2 * leg(F.col("x"), F.col("y"), F.col("cx"), F.col("cy")) + SERVICE <= DAY), None
    for cycle in range(3):
        w = Window.partitionBy("region").orderBy(F.desc("score"), "id")
        score = F.col("prize") * (0.8 + 0.4 * uniform("cycle", F.lit(cycle), "id"))
        some = left.withColumn("score", score).withColumn("rn", F.row_number().over(w)).where("rn <= 4").select("region", "id", F.lit(cycle).alias("cycle"), F.round("score", 6).alias("score"), F.col("rn").alias("place"), ((F.col("rn") - 1) % 2 + 1).alias("team"))
        done = some if done is None else done.unionByName(some)
        left = left.join(some.select("id"), "id", "left_anti")
    return done


#: Cycles of the team horizon, and each one's budget, teams and day.
CYCLES, CYCLE = 3, (6, 2, 240.0)


def team_horizon(rows: DataFrame, cycles: int = CYCLES, setting: tuple[int, int, float] = CYCLE, floor: int = FLOOR) -> DataFrame:
    """(region, cycle, team, stop, id, prize, minutes): exact team plans of successive cycles, no stop twice in the horizon (RT10).

    Every cycle draws prizes anew, takes the pool of the highest among the stops that no cycle before has visited, and plans
    routes that fit into the day; of ``DUE`` random stops of the pool at least ``floor`` are visited.  A region whose floor no plan
    meets has no stops in that cycle.  minutes are those of the whole route.
    """
    left, done = settled(rows), None
    for cycle in range(cycles):
        pool = pool_of(left.withColumn("prize", F.col("prize") * (0.8 + 0.4 * uniform("cycle", F.lit(cycle), "id"))))
        due = F.row_number().over(Window.partitionBy("region").orderBy(uniform("forced", F.lit(cycle), "id"), "id")) <= DUE
        pool = settled(pool.withColumn("must", due))
        plans = tours.team_plans(pool, tours.planar_travel(pool, leg), [setting], floor, strict=False)
        each = named_plans(pool, plans).select("region", F.posexplode("routes").alias("team", "ids")).select("region", F.lit(cycle).alias("cycle"), (F.col("team") + 1).alias("team"), F.posexplode("ids").alias("stop", "id"))
        legs = with_legs(each.join(pool.select("region", "id", "prize", "x", "y", "cx", "cy"), ["region", "id"]), "region", "cycle", "team")
        total = F.sum(F.col("leg") + F.col("back") + SERVICE).over(Window.partitionBy("region", "cycle", "team"))
        some = settled(legs.select("region", "cycle", "team", "stop", "id", "prize", total.alias("minutes")))
        done = some if done is None else done.unionByName(some)
        if cycle + 1 < cycles:
            new = settled(left.join(some.select("region", "id"), ["region", "id"], "left_anti"))
            forget(left)
            left = new
    return done


def _horizon_sql() -> str:
    parts, picks = [], []
    for c in range(CYCLES):
        seen = " UNION ALL ".join(f"SELECT region, id FROM pick{k}" for k in range(c))
        left = f"(SELECT * FROM inst ANTI JOIN ({seen}) USING (region, id))" if c else "inst"
        score = f"prize * (0.8 + 0.4 * {uniform_sql('cycle', str(c), 'id')})"
        parts.append(f"""score{c} AS (SELECT region, id, x, y, cx, cy, {score} AS prize FROM {left}), ranked{c} AS (SELECT * REPLACE (CAST(r - 1 AS INTEGER) AS r) FROM (SELECT *, row_number() OVER (PARTITION BY region ORDER BY prize DESC, id) AS r FROM score{c}) WHERE r <= {tours.POOL}),
 pool{c} AS (SELECT *, CAST(row_number() OVER (PARTITION BY region ORDER BY {uniform_sql('forced', str(c), 'id')}, id) <= {DUE} AS INTEGER) AS must FROM ranked{c}), {_team_sql(f'pool{c}', [CYCLE], FLOOR, str(c))},
 pick{c} AS (SELECT b.region, {c} AS cycle, CASE WHEN (b.p.a & (1 << t.r)) > 0 THEN 1 ELSE 2 END AS team, t.id, t.prize, CASE WHEN (b.p.a & (1 << t.r)) > 0 THEN b.p.ma ELSE b.p.mb END AS minutes FROM best{c} b JOIN pool{c} t ON t.region = b.region AND ((b.p.a | b.p.b) & (1 << t.r)) > 0)""")
        picks.append(f"SELECT * FROM pick{c}")
    return f"WITH RECURSIVE {POINTS_SQL}, {_INSTANCE}, {', '.join(parts)} SELECT region, cycle, team, id, round(prize, 6) AS prize, round(minutes, 5) AS minutes FROM ({' UNION ALL '.join(picks)})"


@query("rt10_team_horizon", _horizon_sql())
def team_horizon_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three cycles of two teams within a day of four hours: who is visited when, and how long each route takes (RT10)."""
    out = team_horizon(instance(spark, sf_dir))
    return out.select("region", "cycle", "team", "id", F.round("prize", 6).alias("prize"), F.round("minutes", 5).alias("minutes"))


@query("rt11_team_sheet")
def team_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The team horizon as route sheets: the order of stops, when each is done, and a workday of the cycle for each route (RT9, RT10, RT11)."""
    done = team_horizon(instance(spark, sf_dir)).join(instance(spark, sf_dir).select("region", "id", "x", "y", "cx", "cy"), ["region", "id"])
    w = Window.partitionBy("region", "cycle", "team")
    timed = with_legs(done, "region", "cycle", "team").withColumn("done_at", F.sum(F.col("leg") + SERVICE).over(w.orderBy("stop").rowsBetween(Window.unboundedPreceding, 0)))
    first = F.add_months(F.to_date(F.lit("1996-01-01")), F.col("cycle"))
    days = workdays(spark, "1996-01-01", "1996-03-28").withColumn("month", F.trunc("day", "month")).withColumn("n", F.row_number().over(Window.partitionBy(F.trunc("day", "month")).orderBy("day")))
    turn = 1 + F.floor(10 * uniform("workday", "region", "cycle", "team")).cast("int")
    dated = timed.withColumn("month", first).withColumn("n", turn).join(F.broadcast(days.where("n <= 10")), ["month", "n"])  # ten a cycle
    return dated.select("region", "cycle", "team", "day", (F.col("stop") + 1).alias("stop"), "id", F.round("prize", 6).alias("prize"), F.round("done_at", 4).alias("done_at"), F.round("minutes", 4).alias("minutes"))


_TEAM = "PARTITION BY region, cycle, team ORDER BY stop"


@query(
    "rt11_route_sheet",
    f"""WITH {POINTS_SQL}, {_INSTANCE}, hz AS ({ORACLES['rt10_horizon']}), o AS (SELECT h.region, cycle, team, h.id, score, x, y, cx, cy, row_number() OVER (PARTITION BY h.region, cycle, team ORDER BY atan2(y - cy, x - cx), h.id) - 1 AS stop FROM hz h JOIN inst i ON i.region = h.region AND i.id = h.id),
 l AS (SELECT *, {_LEG.format(f'coalesce(lag(x) OVER ({_TEAM}), cx)', f'coalesce(lag(y) OVER ({_TEAM}), cy)', 'x', 'y')} AS leg, CASE WHEN lead(x) OVER ({_TEAM}) IS NULL THEN {_LEG.format('x', 'y', 'cx', 'cy')} ELSE 0 END AS back FROM o),
 t AS (SELECT *, sum(leg + {SERVICE}) OVER ({_TEAM} ROWS UNBOUNDED PRECEDING) AS done_at, sum(leg + back + {SERVICE}) OVER (PARTITION BY region, cycle, team) AS total FROM l)
 SELECT region, cycle, team, stop, id, score, round(leg, 5) AS leg, round(done_at, 5) AS done_at, round(total, 5) AS total, total <= {DAY} AS within_day FROM t""",
)
def route_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The horizon's stops as teams drive them: order, legs, when each is done, and whether the day holds (RT10, RT11)."""
    rows = horizon(spark, sf_dir).join(instance(spark, sf_dir).drop("prize"), ["region", "id"])
    w = Window.partitionBy("region", "cycle", "team")  # four stops at most
    stop = F.row_number().over(w.orderBy(F.atan2(F.col("y") - F.col("cy"), F.col("x") - F.col("cx")), "id")) - 1
    legs = with_legs(rows.withColumn("stop", stop), "region", "cycle", "team")
    done = F.sum(F.col("leg") + SERVICE).over(w.orderBy("stop").rowsBetween(Window.unboundedPreceding, 0))
    timed = legs.withColumn("done_at", done).withColumn("total", F.sum(F.col("leg") + F.col("back") + SERVICE).over(w))
    return timed.select("region", "cycle", "team", "stop", "id", "score", F.round("leg", 5).alias("leg"), F.round("done_at", 5).alias("done_at"), F.round("total", 5).alias("total"), (F.col("total") <= DAY).alias("within_day"))


def observed_holidays(year: int) -> list[str]:
    """Federal holidays of a year by rule: fixed days move from Saturday to Friday and from Sunday to Monday."""
    import datetime as d

    def nth(month: int, weekday: int, n: int) -> d.date:
        first = d.date(year, month, 1)
        return first + d.timedelta((weekday - first.weekday()) % 7 + 7 * (n - 1))

    fixed = [d.date(year, 1, 1), d.date(year, 6, 19), d.date(year, 7, 4), d.date(year, 11, 11), d.date(year, 12, 25), d.date(year + 1, 1, 1)]
    moved = [x + d.timedelta({5: -1, 6: 1}.get(x.weekday(), 0)) for x in fixed]
    last_monday = d.date(year, 5, 31) - d.timedelta(d.date(year, 5, 31).weekday())
    floating = [nth(1, 0, 3), nth(2, 0, 3), last_monday, nth(9, 0, 1), nth(10, 0, 2), nth(11, 3, 4)]
    return sorted(x.isoformat() for x in [*moved, *floating] if x.year == year)


def workdays(spark: SparkSession, first: str, last: str) -> DataFrame:
    """Weekdays between two days that are no holidays."""
    off = [h for y in range(int(first[:4]), int(last[:4]) + 1) for h in observed_holidays(y)]
    days = spark.range(1).select(F.explode(F.expr(f"sequence(date'{first}', date'{last}')")).alias("day"))
    return days.where(~F.dayofweek("day").isin(1, 7) & ~F.col("day").cast("string").isin(off))


#: Years that the SQL's list of holidays covers.
_YEARS = range(1990, 2011)
_OFF = ", ".join(f"DATE '{h}'" for y in _YEARS for h in observed_holidays(y))


def holidays(spark: SparkSession, first: int, last: int) -> DataFrame:
    """(day) of the holidays from one year to another, by rule."""
    return spark.createDataFrame([(h,) for y in range(first, last + 1) for h in observed_holidays(y)], "day string").select(F.to_date("day").alias("day"))


def year_span(spark: SparkSession, sf_dir: str) -> tuple[int, int]:
    """First and last year of the orders."""
    row = table(spark, sf_dir, "orders").agg(F.min(F.year("o_orderdate")).alias("a"), F.max(F.year("o_orderdate")).alias("b")).first()
    return row["a"] or 2000, row["b"] or 2000


@query(
    "rt9_cycle_workdays",
    f"WITH s AS (SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS start FROM orders), d AS (SELECT start, start + CAST(k AS INTEGER) AS day FROM s, (SELECT unnest(range(28)) AS k)), w AS (SELECT start, day, row_number() OVER (PARTITION BY start ORDER BY day) AS n FROM d WHERE dayofweek(day) NOT IN (0, 6) AND day NOT IN ({_OFF})) SELECT start, day FROM w WHERE n <= 10",
)
def cycle_workdays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten workdays of each monthly cycle that the orders cover (RT9)."""
    first, last = year_span(spark, sf_dir)
    starts = table(spark, sf_dir, "orders").select(F.to_date(F.date_trunc("month", "o_orderdate")).alias("start")).distinct()
    days = starts.withColumn("day", F.explode(F.expr("sequence(start, date_add(start, 27))"))).where(~F.dayofweek("day").isin(1, 7))
    days = days.join(F.broadcast(holidays(spark, first, last + 1)), "day", "left_anti")  # some ten a year
    return days.withColumn("n", F.row_number().over(Window.partitionBy("start").orderBy("day"))).where("n <= 10").select("start", "day")


#: Plans of a year: how many portions a year has (a summer block is one), and whether routes are dealt by falling risk.
_PLANS = (("A", 1, False), ("B", 4, False), ("C", 12, False), ("D", 4, True))
_PLAN_DAYS = "CASE plan WHEN 'A' THEN CASE WHEN day BETWEEN make_date(year(day), 7, 6) AND make_date(year(day), 8, 21) THEN 1 END WHEN 'C' THEN month(day) ELSE quarter(day) END"


@query(
    "rt19_portion_calendar",
    f"""WITH {STORES}, r AS (SELECT tract AS route, avg(p) AS risk FROM stores GROUP BY tract), y AS (SELECT DISTINCT CAST(year(o_orderdate) AS INTEGER) AS year FROM orders), pl(plan, parts, by_risk) AS (VALUES ('A', 1, FALSE), ('B', 4, FALSE), ('C', 12, FALSE), ('D', 4, TRUE)),
 q AS (SELECT plan, year, route, 1 + CAST(floor((row_number() OVER (PARTITION BY plan, year ORDER BY CASE WHEN by_risk THEN -risk ELSE {uniform_sql('deal', 'plan', 'year', 'route')} END, route) - 1) * parts / CAST(count(*) OVER (PARTITION BY plan, year) AS DOUBLE)) AS INTEGER) AS portion FROM r, y, pl),
 o AS (SELECT *, row_number() OVER (PARTITION BY plan, year, portion ORDER BY {uniform_sql('cal', 'plan', 'year', 'route')}, route) AS k FROM q),
 d AS (SELECT year, unnest(generate_series(make_date(year, 1, 1), make_date(year, 12, 31), INTERVAL 1 DAY))::DATE AS day FROM y), w AS (SELECT * FROM d WHERE dayofweek(day) NOT IN (0, 6) AND day NOT IN ({_OFF})),
 s AS (SELECT plan, year, day, team, CAST({_PLAN_DAYS} AS INTEGER) AS portion FROM w, pl, (VALUES (1), (2)) t(team)), n AS (SELECT *, row_number() OVER (PARTITION BY plan, year, portion ORDER BY {uniform_sql('slot', 'plan', 'day', 'team')}, day, team) AS k FROM s WHERE portion IS NOT NULL)
 SELECT plan, year, route, portion, day, team, CAST(month(day) AS INTEGER) AS month FROM o JOIN n USING (plan, year, portion, k)""",
)
def portion_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes (one a tract) on random days and teams in every year: in a summer block, by quarters, by months, by quarters of falling risk (RT19, plans A to D).

    A portion with more routes than days and teams is an error.
    """
    first, last = year_span(spark, sf_dir)
    years = table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("year")).distinct()
    plans = F.array(*[F.struct(F.lit(n).alias("plan"), F.lit(k).alias("parts"), F.lit(r).alias("by_risk")) for n, k, r in _PLANS])
    r = stores(spark, sf_dir).groupBy(F.col("tract").alias("route")).agg(F.avg("p").alias("risk")).crossJoin(F.broadcast(years)).select("*", F.inline(plans))  # a row per tract, year and plan
    w = Window.partitionBy("plan", "year")
    order = F.when(F.col("by_risk"), -F.col("risk")).otherwise(uniform("deal", "plan", "year", "route"))
    q = r.withColumn("portion", (1 + F.floor((F.row_number().over(w.orderBy(order, "route")) - 1) * F.col("parts") / F.count("*").over(w))).cast("int"))
    o = q.withColumn("k", F.row_number().over(Window.partitionBy("plan", "year", "portion").orderBy(uniform("cal", "plan", "year", "route"), "route")))
    d = years.withColumn("day", F.explode(F.expr("sequence(make_date(year, 1, 1), make_date(year, 12, 31))"))).where(~F.dayofweek("day").isin(1, 7)).join(F.broadcast(holidays(spark, first, last)), "day", "left_anti")
    slots = d.withColumn("team", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("plan", F.explode(F.array(*[F.lit(n) for n, _, _ in _PLANS])))
    slots = slots.withColumn("portion", F.expr(_PLAN_DAYS)).where("portion IS NOT NULL")
    s = slots.withColumn("k", F.row_number().over(Window.partitionBy("plan", "year", "portion").orderBy(uniform("slot", "plan", "day", "team"), "day", "team")))
    out = o.join(s, ["plan", "year", "portion", "k"], "left")
    day = F.coalesce("day", F.raise_error(F.concat(F.lit("more routes than days in plan "), "plan")).cast("date"))
    return out.select("plan", "year", "route", "portion", day.alias("day"), "team", F.month("day").alias("month"))


_CALENDAR = "cal AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, CAST(o_orderdate AS DATE) AS day, o_custkey AS route FROM orders)"


@query("rt20_calendar_summary", f"WITH {_CALENDAR}, m AS (SELECT year, month(day) AS m, count(*) AS n, min(day) AS a, max(day) AS b FROM cal GROUP BY ALL) SELECT year, min(a) AS first_day, max(b) AS last_day, CAST(ceil((max(b) - min(a)) / 7.0) + 1 AS BIGINT) AS weeks, max(n) AS busiest, count(*) AS months FROM m GROUP BY year")
def calendar_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last day, weeks, busiest month of each year (RT20)."""
    cal = table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("year"), F.to_date("o_orderdate").alias("day"))
    m = cal.groupBy("year", F.month("day").alias("m")).agg(F.count("*").alias("n"), F.min("day").alias("a"), F.max("day").alias("b"))
    return m.groupBy("year").agg(F.min("a").alias("first_day"), F.max("b").alias("last_day"), (F.ceil(F.datediff(F.max("b"), F.min("a")) / 7) + 1).alias("weeks"), F.max("n").alias("busiest"), F.count("*").alias("months"))


@query("rt20_store_check_months", f"WITH {_CALENDAR} SELECT year, route AS store, list_sort(list_distinct(list(CAST(month(day) AS INTEGER)))) AS months FROM cal GROUP BY ALL")
def store_check_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The months in which each store is checked, per year (RT20)."""
    cal = table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("year"), F.col("o_custkey").alias("store"), F.month("o_orderdate").alias("m"))
    return cal.groupBy("year", "store").agg(F.sort_array(F.collect_set("m")).alias("months"))


@query("rt21_monthly_protection", f"WITH {STORES}, c AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, o_custkey AS store, max(CAST(month(o_orderdate) AS INTEGER)) AS m FROM orders GROUP BY ALL) SELECT year, k.month, round(sum(CASE WHEN ((k.month - m) % 12 + 12) % 12 < 3 THEN p ELSE 0 END) / sum(p), 6) AS protected FROM stores JOIN c USING (store), (SELECT unnest(range(1, 13)) AS month) k GROUP BY year, k.month")
def monthly_protection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Risk-weighted share of stores checked within the last three months, per month of each year (RT21)."""
    c = table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("year"), F.col("o_custkey").alias("store")).agg(F.max(F.month("o_orderdate")).alias("m"))
    rows = stores(spark, sf_dir).join(c, "store").groupBy("year", "m").agg(F.sum("p").alias("p")).withColumn("month", F.explode(F.sequence(F.lit(1), F.lit(12))))
    return rows.groupBy("year", F.col("month").cast("bigint").alias("month")).agg(F.round(F.sum(F.when(F.pmod(F.col("month") - F.col("m"), F.lit(12)) < 3, F.col("p")).otherwise(0.0)) / F.sum("p"), 6).alias("protected"))


# Low, base and high of each cost parameter.
COSTS = {
    "admin_minutes": (10.0, 15.0, 25.0), "retry_share": (0.05, 0.10, 0.20), "drive_factor": (1.0, 1.5, 2.0), "supervisor_wage": (28.0, 35.28, 45.0), "purchaser_wage": (15.0, 15.0, 20.0), "fringe": (1.25, 1.35, 1.5),
    "mileage_rate": (0.725, 0.76, 0.76), "commute_miles": (10.0, 25.0, 50.0), "overhead_share": (0.15, 0.30, 0.50), "data_per_check": (2.0, 5.0, 10.0), "training_fixed": (0.0, 2000.0, 5000.0),
}
SCENARIOS = ("low", "base", "high")
ONSITE, MPH = 20.0, 22.0


def cost_lines(totals: DataFrame) -> DataFrame:
    """totals (stops, routes, drive, and a column per cost parameter) with the cost lines in dollars."""
    c = {k: F.col(k) for k in COSTS}
    service = ONSITE + c["admin_minutes"]
    retries = c["retry_share"] * F.col("stops")
    hours = (F.col("drive") * c["drive_factor"] + (F.col("stops") + retries) * service + retries * 5) / 60
    miles = (F.col("drive") * c["drive_factor"] + retries * 5) / 60 * MPH + F.col("routes") * c["commute_miles"]
    rows = totals.withColumns({"labor": hours * (c["supervisor_wage"] + c["purchaser_wage"]) * c["fringe"], "mileage": miles * c["mileage_rate"], "data": (F.col("stops") + retries) * c["data_per_check"], "training": c["training_fixed"]})
    return rows.withColumn("overhead", (F.col("labor") + F.col("mileage") + F.col("data") + F.col("training")) * c["overhead_share"])


def scenarios(df: DataFrame) -> DataFrame:
    """Each row once per scenario, with the scenario's cost parameters."""
    some = F.array(*[F.struct(F.lit(s).alias("scenario"), *[F.lit(v[k]).alias(name) for name, v in COSTS.items()]) for k, s in enumerate(SCENARIOS)])
    return df.withColumn("s", F.explode(some)).select(*df.columns, "s.*")


_TOTALS = "tot AS (SELECT o_orderpriority AS plan, count(*) AS stops, CAST(ceil(count(*) / 12.0) AS BIGINT) AS routes, sum(o_totalprice) / 20000 AS drive FROM orders GROUP BY 1)"
_PARAMS = "par(scenario, " + ", ".join(COSTS) + ") AS (VALUES " + ", ".join("('" + s + "', " + ", ".join(f"{v[k]}::DOUBLE" for v in COSTS.values()) + ")" for k, s in enumerate(SCENARIOS)) + ")"
_LINES = f"{_TOTALS}, {_PARAMS}, c AS (SELECT *, (drive * drive_factor + (stops + retry_share * stops) * (20 + admin_minutes) + retry_share * stops * 5) / 60 * (supervisor_wage + purchaser_wage) * fringe AS labor, ((drive * drive_factor + retry_share * stops * 5) / 60 * 22 + routes * commute_miles) * mileage_rate AS mileage, (stops + retry_share * stops) * data_per_check AS data, training_fixed AS training FROM tot, par), lines AS (SELECT *, (labor + mileage + data + training) * overhead_share AS overhead FROM c)"


def plan_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stops, routes and driving minutes per plan."""
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("plan")).agg(F.count("*").alias("stops"), F.ceil(F.count("*") / 12).alias("routes"), (F.sum("o_totalprice") / 20000).alias("drive"))


@query("cv3_cost_components", f"WITH {_LINES}, u AS (UNPIVOT (SELECT plan, scenario, labor, mileage, data, training, overhead FROM lines) ON labor, mileage, data, training, overhead INTO NAME component VALUE dollars) SELECT plan, coalesce(component, 'TOTAL') AS component, round(sum(dollars) FILTER (scenario = 'low'), 3) AS low, round(sum(dollars) FILTER (scenario = 'base'), 3) AS base, round(sum(dollars) FILTER (scenario = 'high'), 3) AS high FROM u GROUP BY GROUPING SETS ((plan, component), (plan))")
def cost_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost lines by scenario with a total row: rollup of unpivoted lines (CV1 to CV3, NB7)."""
    lines = cost_lines(scenarios(plan_totals(spark, sf_dir))).unpivot(["plan", "scenario"], ["labor", "mileage", "data", "training", "overhead"], "component", "dollars")
    both = lines.unionByName(lines.withColumn("component", F.lit("TOTAL")))
    g = both.groupBy("plan", "component").pivot("scenario", list(SCENARIOS)).agg(F.sum("dollars"))
    return g.select("plan", "component", *[F.round(s, 3).alias(s) for s in SCENARIOS])


@query("cv4_cost_table", f"WITH {_LINES} SELECT plan, scenario, stops, round(labor + mileage + data + training + overhead, 2) AS total, round((labor + mileage + data + training + overhead) / stops, 4) AS per_check, 116 * stops AS top_down_low, 400 * stops AS top_down_high FROM lines")
def cost_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals from below and from above (CV4, NB8)."""
    total = F.col("labor") + F.col("mileage") + F.col("data") + F.col("training") + F.col("overhead")
    return cost_lines(scenarios(plan_totals(spark, sf_dir))).select("plan", "scenario", "stops", F.round(total, 2).alias("total"), F.round(total / F.col("stops"), 4).alias("per_check"), (116 * F.col("stops")).alias("top_down_low"), (400 * F.col("stops")).alias("top_down_high"))


_CASES = "par(parameter, side, " + ", ".join(COSTS) + ") AS (VALUES " + ", ".join([f"('{n}', '{e}', " + ", ".join(f"{(v[k] if m == n else v[1])}::DOUBLE" for m, v in COSTS.items()) + ")" for n in COSTS for k, e in ((0, "low"), (2, "high"))]) + ")"


@query("cv5_cost_sensitivity", f"WITH {_LINES.replace(_PARAMS, _CASES)}, t AS (SELECT plan, parameter, side, labor + mileage + data + training + overhead AS total FROM lines) SELECT plan, parameter, round(max(CASE WHEN side = 'low' THEN total END), 2) AS low, round(max(CASE WHEN side = 'high' THEN total END), 2) AS high, round(max(CASE WHEN side = 'high' THEN total END) - max(CASE WHEN side = 'low' THEN total END), 2) AS swing FROM t GROUP BY ALL")
def cost_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each parameter at its low and high, all others at base: the swing of the total, largest first (CV5)."""
    cases = [("base", "base")] + [(name, end) for name in COSTS for end in ("low", "high")]
    pick = lambda name, case: COSTS[name][SCENARIOS.index(case[1]) if case[0] == name else 1]
    grid = F.array(*[F.struct(F.lit(c[0]).alias("parameter"), F.lit(c[1]).alias("end"), *[F.lit(pick(n, c)).alias(n) for n in COSTS]) for c in cases])
    totals = plan_totals(spark, sf_dir)
    rows = cost_lines(totals.withColumn("g", F.explode(grid)).select(*totals.columns, "g.*"))
    total = F.col("labor") + F.col("mileage") + F.col("data") + F.col("training") + F.col("overhead")
    wide = rows.where("parameter != 'base'").groupBy("plan", "parameter").agg(F.max(F.when(F.col("end") == "low", total)).alias("low"), F.max(F.when(F.col("end") == "high", total)).alias("high"))
    return wide.select("plan", "parameter", F.round("low", 2).alias("low"), F.round("high", 2).alias("high"), F.round(F.col("high") - F.col("low"), 2).alias("swing"))


_ROUTE_COSTS = ", ".join(routes_sql("inst", f"r{k}", COSTS["drive_factor"][k]) for k in range(3))
_ROUTE_TOTALS = " UNION ALL ".join(f"SELECT region, '{name}' AS scenario, sum(stops) AS stops, count(*) AS routes, sum(drive) / {COSTS['drive_factor'][k]} AS drive FROM {_times_sql(f'r{k}')} GROUP BY region" for k, name in enumerate(SCENARIOS))


@query(
    "cv2_route_costs",
    f"WITH RECURSIVE {POINTS_SQL}, {_INSTANCE}, {_ROUTE_COSTS}, tot AS ({_ROUTE_TOTALS}), {_PARAMS}, c AS (SELECT *, (drive * drive_factor + (stops + retry_share * stops) * (20 + admin_minutes) + retry_share * stops * 5) / 60 * (supervisor_wage + purchaser_wage) * fringe AS labor, ((drive * drive_factor + retry_share * stops * 5) / 60 * 22 + routes * commute_miles) * mileage_rate AS mileage, (stops + retry_share * stops) * data_per_check AS data FROM tot JOIN par USING (scenario)) SELECT region, scenario, CAST(stops AS BIGINT) AS stops, routes, round((labor + mileage + data + training_fixed) * (1 + overhead_share), 2) AS total, round((labor + mileage + data) * (1 + overhead_share), 2) AS later_passes FROM c",
)
def route_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Costs of the real routes of each region, in three scenarios of traffic (CV2 to CV4, CV7)."""
    rows = instance(spark, sf_dir)
    parts = None
    for k, s in enumerate(SCENARIOS):
        factor = COSTS["drive_factor"][k]
        t = route_times(split_routes(rows, factor)).groupBy("region").agg(F.sum("stops").alias("stops"), F.count("*").alias("routes"), (F.sum("drive") / factor).alias("drive")).withColumn("scenario", F.lit(s)).withColumns({n: F.lit(v[k]) for n, v in COSTS.items()})
        parts = t if parts is None else parts.unionByName(t)
    total = F.col("labor") + F.col("mileage") + F.col("data") + F.col("training") + F.col("overhead")
    return cost_lines(parts).select("region", "scenario", "stops", "routes", F.round(total, 2).alias("total"), F.round(total - F.col("training") * (1 + F.col("overhead_share")), 2).alias("later_passes"))


@query(
    "cv6_risk_staged_cost",
    f"WITH RECURSIVE {POINTS_SQL}, {_INSTANCE}, tiers AS (SELECT region * 10 + ntile(2) OVER (PARTITION BY region ORDER BY prize DESC, id) AS region, id, x, y, cx, cy FROM inst), {routes_sql('inst', 'one')}, {routes_sql('tiers', 'two')}, a AS (SELECT region, count(*) AS routes, sum(minutes) AS minutes FROM {_times_sql('one')} GROUP BY 1), b AS (SELECT region // 10 AS region, count(*) AS staged_routes, sum(minutes) AS staged FROM {_times_sql('two')} GROUP BY 1) SELECT region, routes, staged_routes, round(minutes, 3) AS minutes, round(staged, 3) AS staged_minutes FROM a JOIN b USING (region)",
)
def risk_staged_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes by risk tier against routes over all stops: what staging costs in minutes (CV6)."""
    rows = instance(spark, sf_dir)
    w = Window.partitionBy("region").orderBy(F.desc("prize"), "id")
    tiers = rows.withColumn("region", F.col("region") * 10 + F.ntile(2).over(w))
    one = route_times(split_routes(rows)).groupBy("region").agg(F.count("*").alias("routes"), F.sum("minutes").alias("minutes"))
    two = route_times(split_routes(tiers)).groupBy(F.expr("region div 10").alias("region")).agg(F.count("*").alias("staged_routes"), F.sum("minutes").alias("staged"))
    return one.join(two, "region").select("region", "routes", "staged_routes", F.round("minutes", 3).alias("minutes"), F.round("staged", 3).alias("staged_minutes"))


_TEAMS = (1, 2, 4, 8)


@query(
    "nb6_team_sweep",
    f"WITH RECURSIVE {_ROUTES}, times AS {_times_sql('routes')} SELECT teams, count(*) AS routes, CAST(ceil(count(*) / CAST(teams AS DOUBLE)) AS BIGINT) AS days, round(ceil(count(*) / CAST(teams AS DOUBLE)) / 21, 5) AS months, round(sum(minutes) / 60 / teams, 3) AS hours_a_team, round(avg(stops), 4) AS mean_stops FROM times, (VALUES {', '.join(f'({k})' for k in _TEAMS)}) t(teams) GROUP BY teams",
)
def team_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All routes of the optimal cut driven by one to eight teams: days, months and hours (NB6)."""
    t = route_times(split_routes(instance(spark, sf_dir))).agg(F.count("*").alias("routes"), F.sum("minutes").alias("minutes"), F.avg("stops").alias("mean_stops"))
    t = t.withColumn("teams", F.explode(F.array(*map(F.lit, _TEAMS))))
    days = F.ceil(F.col("routes") / F.col("teams"))
    return t.select("teams", "routes", days.alias("days"), F.round(days / 21, 5).alias("months"), F.round(F.col("minutes") / 60 / F.col("teams"), 3).alias("hours_a_team"), F.round("mean_stops", 4).alias("mean_stops"))


@query("cv11_what_if", f"WITH {_TOTALS}, g AS (SELECT plan, stops, d.h, t.k, CAST(ceil((stops * 35 + drive) / (d.h * 60.0)) AS BIGINT) AS routes FROM tot, (VALUES (4), (8)) d(h), (VALUES (1), (2), (4)) t(k)) SELECT plan, h AS day_hours, k AS teams, routes, CAST(ceil(routes / CAST(k AS DOUBLE)) AS BIGINT) AS days, round(ceil(routes / CAST(k AS DOUBLE)) / 21, 5) AS months, CASE WHEN ceil(routes / CAST(k AS DOUBLE)) > 65 THEN 'time' WHEN stops < routes * 8 THEN 'distance' ELSE 'none' END AS binding FROM g")
def what_if(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Field days by hours and teams, and what binds (CV11)."""
    grid = F.array(*[F.struct(F.lit(h).alias("day_hours"), F.lit(k).alias("teams")) for h in (4, 8) for k in (1, 2, 4)])
    t = plan_totals(spark, sf_dir).withColumn("g", F.explode(grid)).select("plan", "stops", "drive", "g.*")
    t = t.withColumn("routes", F.ceil((F.col("stops") * 35 + F.col("drive")) / (F.col("day_hours") * 60.0)))
    days = F.ceil(F.col("routes") / F.col("teams"))
    return t.select("plan", "day_hours", "teams", "routes", days.alias("days"), F.round(days / 21, 5).alias("months"), F.when(days > 65, "time").when(F.col("stops") < F.col("routes") * 8, "distance").otherwise("none").alias("binding"))


@query("sm10_frontier", f"WITH {STORES}, r AS (SELECT p, row_number() OVER (ORDER BY p DESC, store) AS rp, row_number() OVER (ORDER BY prize DESC, store) AS rz, count(*) OVER () AS n FROM stores), g AS (SELECT * FROM r, (VALUES (0.1::DOUBLE), (0.25::DOUBLE), (0.5::DOUBLE), (1.0::DOUBLE)) s(share)) SELECT share, CAST(round_even(share * min(n), 0) AS BIGINT) AS checks, round(sum(p) * share, 4) AS random, round(sum(CASE WHEN rp <= round_even(share * n, 0) THEN p ELSE 0 END), 4) AS by_risk, round(sum(CASE WHEN rz <= round_even(share * n, 0) THEN p ELSE 0 END), 4) AS by_prize, round(sum(1 - pow(1 - p, 2)), 4) AS two_pass FROM g GROUP BY share")
def frontier_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violators found by budget: at random, by risk, by prize, and in two passes (SM10).

    Places come from buckets of scores, not from one task.
    """
    s = stores(spark, sf_dir).select("store", "p", "prize")
    n = s.count()
    ranked = place_within(place_within(s, "p", "store", out="rp").drop("n_all"), "prize", "store", out="rz")
    shares = (0.1, 0.25, 0.5, 1.0)
    g = ranked.withColumn("share", F.explode(F.array(*map(F.lit, shares)))).withColumn("k", F.bround(F.col("share") * n, 0))
    part = lambda r: F.round(F.sum(F.when(F.col(r) <= F.col("k"), F.col("p")).otherwise(0.0)), 4)
    return g.groupBy("share").agg(F.max("k").cast("bigint").alias("checks"), F.round(F.sum("p") * F.first("share"), 4).alias("random"), part("rp").alias("by_risk"), part("rz").alias("by_prize"), F.round(F.sum(1 - F.pow(1 - F.col("p"), F.lit(2))), 4).alias("two_pass"))
