"""Spatial operators on points in the plane: distance joins by grid cells, point in polygon, clusters and hot spots.

A distance join is an equi-join on cells as wide as the distance: each point on one side is copied to its 3 by 3
neighbour cells, so Spark shuffles on cells and no pair farther than two cells is ever compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwarden.functions.stats import place_within
from sparkwarden.functions.text import similarity
from sparkwarden.plans.registry import query
from sparkwarden.sources.shared import forget, settled
from sparkwarden.sources.tables import POINTS_SQL, points, table


def within_distance(left: DataFrame, right: DataFrame, radius: float) -> DataFrame:
    """Pairs of left (id, x, y) and right (rid, rx, ry) at most ``radius`` apart, with their distance."""
    near = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    a = left.where("x IS NOT NULL AND y IS NOT NULL").withColumn("cx", F.floor(F.col("x") / radius)).withColumn("cy", F.floor(F.col("y") / radius))
    b = right.where("rx IS NOT NULL AND ry IS NOT NULL").withColumn("n", F.explode(near))
    b = b.withColumn("cx", F.floor(F.col("rx") / radius) + F.col("n.i")).withColumn("cy", F.floor(F.col("ry") / radius) + F.col("n.j")).drop("n")
    d = F.sqrt(F.pow(F.col("x") - F.col("rx"), F.lit(2)) + F.pow(F.col("y") - F.col("ry"), F.lit(2)))
    return a.join(b, ["cx", "cy"]).withColumn("d", d).where(F.col("d") <= radius).drop("cx", "cy")


def as_right(df: DataFrame, *extra: str) -> DataFrame:
    """The right side of a distance join."""
    return df.select(F.col("id").alias("rid"), F.col("x").alias("rx"), F.col("y").alias("ry"), *[F.col(c).alias(f"r_{c}") for c in extra])


@query("jn8_proximity_counts", f"WITH {POINTS_SQL}, r AS (SELECT * FROM points WHERE label < 5), s AS (SELECT * FROM points WHERE label >= 5), p AS (SELECT r.id, sqrt(pow(r.x - s.x, 2) + pow(r.y - s.y, 2)) AS d FROM r, s) SELECT r.id, CASE WHEN min(d) <= 100 THEN round(min(d), 6) END AS nearest, count(*) FILTER (d <= 30) AS within_30, count(*) FILTER (d <= 100) AS within_100 FROM r LEFT JOIN p USING (id) GROUP BY r.id")
def proximity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest site within 100 m of each retailer and counts within 30 and 100 m; nulls where there is none (JN8, SP3)."""
    pts = points(spark, sf_dir)
    retailers = pts.where("label < 5")
    pairs = within_distance(retailers.select("id", "x", "y"), as_right(pts.where("label >= 5")), 100.0)
    near = pairs.groupBy("id").agg(F.round(F.min("d"), 6).alias("nearest"), F.count_if(F.col("d") <= 30).alias("within_30"), F.count("*").alias("within_100"))
    return retailers.select("id").join(near, "id", "left").select("id", "nearest", F.coalesce("within_30", F.lit(0)).alias("within_30"), F.coalesce("within_100", F.lit(0)).alias("within_100"))


@query("jn7_pair_distances", f"WITH {POINTS_SQL} SELECT a.id, b.id AS rid, round(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)), 6) AS d FROM points a JOIN points b ON a.label = b.label AND a.id // 50 = b.id // 50 AND a.id < b.id")
def pair_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All distances within small regions: an edge list instead of a dense matrix (JN7, RT2)."""
    pts = points(spark, sf_dir).withColumn("region", F.expr("id div 50"))
    other = pts.select(F.col("id").alias("rid"), "label", "region", F.col("x").alias("rx"), F.col("y").alias("ry"))
    d = F.sqrt(F.pow(F.col("x") - F.col("rx"), F.lit(2)) + F.pow(F.col("y") - F.col("ry"), F.lit(2)))
    return pts.join(other, ["label", "region"]).where("id < rid").select("id", "rid", F.round(d, 6).alias("d"))


def polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of a hexagon around the mean of each label's points: poly, x1, y1, x2, y2; derived from the points."""
    c = points(spark, sf_dir).groupBy("label").agg(F.round(F.avg("x"), 3).alias("mx"), F.round(F.avg("y"), 3).alias("my"))
    xs, ys = (120, 60, -60, -120, -60, 60), (0, 104, 104, 0, -104, -104)
    edges = F.array(*[F.struct(F.lit(xs[k]).alias("a"), F.lit(ys[k]).alias("b"), F.lit(xs[(k + 1) % 6]).alias("c"), F.lit(ys[(k + 1) % 6]).alias("d")) for k in range(6)])
    e = c.withColumn("e", F.explode(edges))
    return e.select(F.col("label").alias("poly"), (F.col("mx") + F.col("e.a")).alias("x1"), (F.col("my") + F.col("e.b")).alias("y1"), (F.col("mx") + F.col("e.c")).alias("x2"), (F.col("my") + F.col("e.d")).alias("y2"))


def point_in_polygon(pts: DataFrame, edges: DataFrame, cell: float) -> DataFrame:
    """For each point the least polygon that holds it, or null: cells of the bounding boxes, then ray casting."""
    box = edges.groupBy("poly").agg(F.min("x1").alias("lx"), F.max("x1").alias("hx"), F.min("y1").alias("ly"), F.max("y1").alias("hy"))
    over = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / cell), F.floor(F.col(hi) / cell)))
    cells = box.withColumn("cx", over("lx", "hx")).withColumn("cy", over("ly", "hy"))
    near = pts.withColumn("cx", F.floor(F.col("x") / cell)).withColumn("cy", F.floor(F.col("y") / cell)).join(cells, ["cx", "cy"]).where("x BETWEEN lx AND hx AND y BETWEEN ly AND hy")
    hit = near.select("id", "x", "y", "poly").join(edges, "poly")
    crosses = ((F.col("y1") > F.col("y")) != (F.col("y2") > F.col("y"))) & (F.col("x") < (F.col("x2") - F.col("x1")) * (F.col("y") - F.col("y1")) / (F.col("y2") - F.col("y1")) + F.col("x1"))
    odd = hit.groupBy("id", "poly").agg((F.count_if(F.when(F.col("y1") != F.col("y2"), crosses).otherwise(False)) % 2 == 1).alias("inside")).where("inside")
    return pts.select("id").join(odd.groupBy("id").agg(F.min("poly").alias("poly")), "id", "left")


@query(
    "jn6_point_in_polygon",
    f"""WITH {POINTS_SQL}, c AS (SELECT label, round(avg(x), 3) AS mx, round(avg(y), 3) AS my FROM points GROUP BY label), o(k, ex, ey) AS (VALUES (0, 120, 0), (1, 60, 104), (2, -60, 104), (3, -120, 0), (4, -60, -104), (5, 60, -104)),
 e AS (SELECT label AS poly, mx + a.ex AS x1, my + a.ey AS y1, mx + b.ex AS x2, my + b.ey AS y2 FROM c, o a JOIN o b ON b.k = (a.k + 1) % 6),
 h AS (SELECT id, poly, count(*) FILTER (CASE WHEN y1 = y2 THEN FALSE ELSE (y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / (y2 - y1) + x1 END) % 2 = 1 AS inside FROM points, e GROUP BY id, poly)
 SELECT p.id, min(h.poly) AS poly FROM points p LEFT JOIN h ON h.id = p.id AND h.inside GROUP BY p.id""",
)
def assign_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first polygon that holds each point (JN6, SP4)."""
    return point_in_polygon(points(spark, sf_dir), polygons(spark, sf_dir), 100.0)


@query(
    "jn5_distance_name_match",
    f"""WITH {POINTS_SQL}, n AS (SELECT p.id, p.label, x, y, part.p_name AS name, part.p_type AS kind FROM points p JOIN part ON p_partkey = id), a AS (SELECT * FROM n WHERE label < 5), b AS (SELECT * FROM n WHERE label >= 5),
 t1 AS (SELECT a.id, b.id AS rid, 1 AS tier, CAST(NULL AS DOUBLE) AS dist FROM a JOIN b ON a.name = b.name AND a.kind = b.kind),
 t2 AS (SELECT a.id, b.id AS rid, 2 AS tier, round(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)), 6) AS dist FROM a JOIN b ON sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) <= 75 AND 1 - levenshtein(a.name, b.name) / CAST(greatest(length(a.name), length(b.name)) AS DOUBLE) >= 0.55 WHERE a.id NOT IN (SELECT id FROM t1))
 SELECT * FROM t1 UNION ALL SELECT * FROM t2""",
)
def distance_name_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiered matching: equal keys first; for the rest, near by and alike in name (JN4, JN5, ER1)."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("kind"))
    n = points(spark, sf_dir).join(part, "id")
    a, b = n.where("label < 5"), n.where("label >= 5")
    first = a.join(b.select(F.col("id").alias("rid"), "name", "kind"), ["name", "kind"]).select("id", "rid", F.lit(1).alias("tier"), F.lit(None).cast("double").alias("dist"))
    rest = a.join(first.select("id").distinct(), "id", "left_anti")
    pairs = within_distance(rest.select("id", "x", "y", "name"), as_right(b, "name"), 75.0).where(similarity(F.col("name"), F.col("r_name")) >= 0.55)
    return first.unionByName(pairs.select("id", "rid", F.lit(2).alias("tier"), F.round("d", 6).alias("dist")))


@query(
    "sp2_local_z",
    f"""WITH {POINTS_SQL}, v AS (SELECT id, x, y, CAST(label AS DOUBLE) AS v FROM points), g AS (SELECT avg(v) AS m, sqrt(avg(v * v) - avg(v) * avg(v)) AS s, count(*) AS n FROM v), w AS (SELECT a.id, sum(b.v) AS wx, count(*) AS w FROM v a JOIN v b ON sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) <= 40 GROUP BY a.id)
 SELECT id, w AS neighbours, round(coalesce((wx - m * w) / nullif(s * sqrt(greatest((n * w - w * w) / CAST(n - 1 AS DOUBLE), 0)), 0), 0), 5) AS z FROM w, g""",
)
def local_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local hot spots: each point's neighbourhood sum against what chance gives (SP2)."""
    v = points(spark, sf_dir).withColumn("v", F.col("label").cast("double"))
    g = v.agg(F.avg("v").alias("m"), F.sqrt(F.avg(F.col("v") * F.col("v")) - F.avg("v") * F.avg("v")).alias("s"), F.count("*").alias("n"))
    w = within_distance(v.select("id", "x", "y"), as_right(v, "v"), 40.0).groupBy("id").agg(F.sum("r_v").alias("wx"), F.count("*").alias("w"))
    spread = F.col("s") * F.sqrt(F.greatest((F.col("n") * F.col("w") - F.col("w") * F.col("w")) / (F.col("n") - 1), F.lit(0.0)))
    return w.join(F.broadcast(g)).select("id", F.col("w").alias("neighbours"), F.round(F.coalesce(F.try_divide(F.col("wx") - F.col("m") * F.col("w"), spread), F.lit(0.0)), 5).alias("z"))


def hex_cell(x: Column, y: Column, size: float) -> tuple[Column, Column, Column]:
    """The hexagon of a point: of two shifted lattices the nearer centre (lattice, column, row)."""
    sx, sy = size, size * 3**0.5
    i0, j0 = F.bround(x / sx, 0), F.bround(y / sy, 0)
    i1, j1 = F.floor(x / sx), F.floor(y / sy)
    d0 = F.pow(x / sx - i0, F.lit(2)) + 3 * F.pow(y / sy - j0, F.lit(2))
    d1 = F.pow(x / sx - i1 - 0.5, F.lit(2)) + 3 * F.pow(y / sy - j1 - 0.5, F.lit(2))
    first = d0 < d1
    return F.when(first, 0).otherwise(1), F.when(first, i0).otherwise(i1).cast("int"), F.when(first, j0).otherwise(j1).cast("int")


@query(
    "sp5_hexbin",
    f"""WITH {POINTS_SQL}, q AS (SELECT label, x / 50 AS a, y / (50 * pow(3.0::DOUBLE, 0.5)) AS b FROM points), h AS (SELECT label, pow(a - round_even(a, 0), 2) + 3 * pow(b - round_even(b, 0), 2) < pow(a - floor(a) - 0.5, 2) + 3 * pow(b - floor(b) - 0.5, 2) AS f, a, b FROM q)
 SELECT CASE WHEN f THEN 0 ELSE 1 END AS lattice, CAST(CASE WHEN f THEN round_even(a, 0) ELSE floor(a) END AS INTEGER) AS col, CAST(CASE WHEN f THEN round_even(b, 0) ELSE floor(b) END AS INTEGER) AS row, count(*) AS n, CAST(sum(label) AS BIGINT) AS total, round(avg(label), 6) AS mean FROM h GROUP BY ALL""",
)
def hexbin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, sums and means per hexagon (SP5, CS9)."""
    lattice, col, row = hex_cell(F.col("x"), F.col("y"), 50.0)
    return points(spark, sf_dir).groupBy(lattice.alias("lattice"), col.alias("col"), row.alias("row")).agg(F.count("*").alias("n"), F.sum("label").alias("total"), F.round(F.avg("label"), 6).alias("mean"))


def connected(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, label): the least id of each node's component; edges (a, b) stand in both directions.

    Labels spread along edges and jump along labels, so rounds grow with the logarithm of a component's length.
    """
    edges = settled(edges)
    labels = settled(nodes.select("id", F.col("id").alias("label")))
    while True:
        near = edges.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("m"))
        low = labels.join(near, "id", "left").select("id", "label", F.least("label", F.coalesce("m", "label")).alias("m"))
        new = settled(low.join(labels.select(F.col("id").alias("m"), F.col("label").alias("k")), "m", "left").select("id", "label", F.least("m", "k").alias("m")))
        if new.where("m != label").isEmpty():
            forget(new, edges)
            return labels
        forget(labels)
        labels = new.select("id", F.col("m").alias("label"))


#: Parts of a cell's side; one point of each part stands for the others where cells are linked first.
PARTS = 8


def _beside(df: DataFrame, x: str = "cx", y: str = "cy") -> DataFrame:
    """Each row for the cells around its own, two in each direction: nx, ny."""
    near = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-2, 3) for j in range(-2, 3)])
    return df.withColumn("_n", F.explode(near)).withColumn("nx", F.col(x) + F.col("_n.i")).withColumn("ny", F.col(y) + F.col("_n.j")).drop("_n")


def linked_cells(core: DataFrame, eps: float) -> DataFrame:
    """(a, b), both ways, of neighbouring cells with core points within eps: first by one point of each part of a cell, then,
    for pairs of cells that these leave open, by all points that lie within eps of the other cell."""
    side = eps / 2**0.5
    part = [F.floor(F.col(v) / side * PARTS) for v in ("x", "y")]
    first = core.groupBy("cx", "cy", "cell", part[0].alias("px"), part[1].alias("py")).agg(F.min(F.struct("id", "x", "y")).alias("p")).select("cx", "cy", "cell", "p.x", "p.y")
    apart = F.sqrt(F.pow(F.col("x") - F.col("rx"), F.lit(2)) + F.pow(F.col("y") - F.col("ry"), F.lit(2)))

    def pairs(left: DataFrame, right: DataFrame) -> DataFrame:
        to = right.select(F.col("cx").alias("nx"), F.col("cy").alias("ny"), F.col("cell").alias("rcell"), F.col("x").alias("rx"), F.col("y").alias("ry"))
        return left.join(to, ["nx", "ny"]).where((F.col("cell") < F.col("rcell")) & (apart <= eps)).select("cell", "rcell").distinct()

    quick = settled(pairs(_beside(first), first))
    cells = core.select("cx", "cy", "cell").distinct()
    both = _beside(cells).join(cells.select(F.col("cx").alias("nx"), F.col("cy").alias("ny"), F.col("cell").alias("rcell")), ["nx", "ny"]).where("cell < rcell")
    open_ = settled(both.join(quick, ["cell", "rcell"], "left_anti").select("cell", "rcell", "cx", "cy", "nx", "ny"))
    # distance of a point to the other cell's box
    beyond = lambda v, k: F.greatest(F.col(k) * side - F.col(v), F.col(v) - (F.col(k) + 1) * side, F.lit(0.0))
    gap = lambda x, y, cx, cy: F.sqrt(F.pow(beyond(x, cx), F.lit(2)) + F.pow(beyond(y, cy), F.lit(2)))
    left = open_.join(core.select("cell", "x", "y"), "cell").where(gap("x", "y", "nx", "ny") <= eps * (1 + 1e-9))
    right = open_.join(core.select(F.col("cell").alias("rcell"), F.col("x").alias("rx"), F.col("y").alias("ry")), "rcell").where(gap("rx", "ry", "cx", "cy") <= eps * (1 + 1e-9)).select("cell", "rcell", "rx", "ry")
    slow = left.join(right, ["cell", "rcell"]).where(apart <= eps).select("cell", "rcell").distinct()
    found = quick.unionByName(slow).select(F.col("cell").alias("a"), F.col("rcell").alias("b"))
    return found.unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b")))


def dbscan(pts: DataFrame, eps: float, least: int) -> DataFrame:
    """Clusters of points (id, x, y): label 0, 1, ... by the least core id, -1 for noise; border points join the first cluster.

    Cells have a diagonal of eps, so that all points of a cell are neighbours: where a cell holds ``least`` points, all
    are core points without a pair looked at, and cells, not points, are the nodes that are connected.
    """
    side = eps / 2**0.5
    at = pts.select("id", "x", "y").where("x IS NOT NULL AND y IS NOT NULL").withColumn("cx", F.floor(F.col("x") / side)).withColumn("cy", F.floor(F.col("y") / side))
    at = settled(at.join(at.groupBy("cx", "cy").agg(F.count("*").alias("n")), ["cx", "cy"]))
    d = F.sqrt(F.pow(F.col("x") - F.col("rx"), F.lit(2)) + F.pow(F.col("y") - F.col("ry"), F.lit(2)))
    other = at.select(F.col("cx").alias("nx"), F.col("cy").alias("ny"), F.col("id").alias("rid"), F.col("x").alias("rx"), F.col("y").alias("ry"))
    thin = _beside(at.where(F.col("n") < least))
    sparse = thin.join(other, ["nx", "ny"]).where(d <= eps).groupBy("id").agg(F.count("*").alias("near")).where(F.col("near") >= least).select("id")
    core = at.where(F.col("n") >= least).unionByName(at.where(F.col("n") < least).join(sparse, "id", "left_semi").select(*at.columns)).drop("n")
    cells = core.groupBy("cx", "cy").agg(F.min("id").alias("cell"))
    core = settled(core.join(cells, ["cx", "cy"]))
    labels = settled(connected(linked_cells(core, eps), cells.select(F.col("cell").alias("id"))))
    heads = labels.select("label").distinct().withColumn("low", -F.col("label").cast("double"))
    number = place_within(heads, "low", "label").select("label", (F.col("rn") - 1).cast("int").alias("cluster"))
    named = settled(core.join(labels.join(number, "label").select(F.col("id").alias("cell"), "cluster"), "cell").select("id", "x", "y", "cx", "cy", "cluster"))
    to = named.select(F.col("cx").alias("nx"), F.col("cy").alias("ny"), F.col("x").alias("rx"), F.col("y").alias("ry"), "cluster")
    border = thin.join(named.select("id"), "id", "left_anti").join(to, ["nx", "ny"]).where(d <= eps).groupBy("id").agg(F.min("cluster").alias("cluster"))
    both = named.select("id", "cluster").unionByName(border)
    return pts.select("id").join(both, "id", "left").select("id", F.coalesce("cluster", F.lit(-1)).alias("cluster"))


_DBSCAN = f"""WITH RECURSIVE {POINTS_SQL}, pr AS (SELECT a.id, b.id AS rid FROM points a JOIN points b ON sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) <= 20), core AS (SELECT id FROM pr GROUP BY id HAVING count(*) >= 4),
 ce AS (SELECT id, rid FROM pr WHERE id IN (SELECT id FROM core) AND rid IN (SELECT id FROM core)), rc(id, root) AS (SELECT id, id FROM core UNION SELECT ce.rid, rc.root FROM rc JOIN ce ON ce.id = rc.id WHERE rc.root < ce.rid), lab AS (SELECT id, min(root) AS root FROM rc GROUP BY id),
 num AS (SELECT root, CAST(row_number() OVER (ORDER BY root) - 1 AS INTEGER) AS cluster FROM (SELECT DISTINCT root FROM lab)), nm AS (SELECT id AS rid, cluster FROM lab JOIN num USING (root)), best AS (SELECT id, min(cluster) AS cluster FROM pr JOIN nm USING (rid) GROUP BY id),
 cl AS (SELECT p.id, p.x, p.y, p.label, coalesce(nm.cluster, best.cluster, -1) AS cluster FROM points p LEFT JOIN best ON best.id = p.id LEFT JOIN nm ON nm.rid = p.id)"""


@query("sp1_dbscan", _DBSCAN + " SELECT id, cluster FROM cl")
def density_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Density clusters of all points, 20 m, 4 neighbours (SP1)."""
    return dbscan(points(spark, sf_dir), 20.0, 4)


@query("ag16_hotspot_table", _DBSCAN + ", h AS (SELECT cluster, count(*) AS n, sum(label) AS total, avg(label) AS mean, count(DISTINCT label) AS kinds, avg(x) AS cx, avg(y) AS cy FROM cl WHERE cluster >= 0 GROUP BY cluster) SELECT cluster, n, CAST(total AS BIGINT) AS total, round(mean, 6) AS mean, kinds, round(cx, 4) AS cx, round(cy, 4) AS cy, row_number() OVER (ORDER BY total DESC, cluster) AS place FROM h")
def hotspot_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters by their total, with centres; noise left out (AG16)."""
    pts = points(spark, sf_dir)
    c = pts.join(dbscan(pts, 20.0, 4), "id").where("cluster >= 0")
    h = c.groupBy("cluster").agg(F.count("*").alias("n"), F.sum("label").alias("total"), F.round(F.avg("label"), 6).alias("mean"), F.countDistinct("label").alias("kinds"), F.round(F.avg("x"), 4).alias("cx"), F.round(F.avg("y"), 4).alias("cy"))
    return place_within(h.withColumn("_t", F.col("total").cast("double")), "_t", "cluster", out="place").drop("_t", "n_all")


def shortest_paths(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(src, id, minutes) from each source to all nodes that it reaches: edges (a, b, w) are relaxed until nothing gets shorter.

    Only nodes that got nearer in a round send on, so a round moves the frontier alone.
    """
    edges = settled(edges)
    best = settled(sources.select(F.col("id").alias("src"), "id", F.lit(0.0).alias("minutes")))
    front, old = best, []
    while not front.isEmpty():
        tried = front.join(edges, F.col("id") == F.col("a")).groupBy("src", F.col("b").alias("id")).agg(F.min(F.col("minutes") + F.col("w")).alias("new"))
        front = settled(tried.join(best, ["src", "id"], "left").where(F.col("minutes").isNull() | (F.col("new") < F.col("minutes") - 1e-9)).select("src", "id", F.col("new").alias("minutes")))
        new = settled(best.unionByName(front).groupBy("src", "id").agg(F.min("minutes").alias("minutes")))
        forget(*old)
        old, best = [best], new
    return best


@query(
    "jn15_network_minutes",
    f"""WITH RECURSIVE {POINTS_SQL}, e AS (SELECT a.id AS a, b.id AS b, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) * 0.2 AS w FROM points a JOIN points b ON a.id <> b.id AND sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) <= 40),
 s AS (SELECT min(id) AS id FROM points GROUP BY label), sp(src, id, d) USING KEY (src, id) AS (SELECT id, id, 0.0::DOUBLE FROM s UNION SELECT n.src, n.id, n.d FROM (SELECT sp.src, e.b AS id, min(sp.d + e.w) AS d FROM sp JOIN e ON e.a = sp.id GROUP BY sp.src, e.b) n LEFT JOIN recurring.sp k ON k.src = n.src AND k.id = n.id WHERE k.d IS NULL OR n.d < k.d - 1e-9)
 SELECT s.id AS src, p.id, round(coalesce(sp.d, sqrt(pow(p.x - q.x, 2) + pow(p.y - q.y, 2)) * 0.2 * 1.35), 5) AS minutes FROM s JOIN points q ON q.id = s.id CROSS JOIN points p LEFT JOIN sp ON sp.src = s.id AND sp.id = p.id WHERE p.label = q.label""",
)
def network_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minutes along a network of short legs from each label's first point to its others; straight lines where there is no way (JN15)."""
    pts = points(spark, sf_dir)
    pairs = within_distance(pts.select("id", "x", "y"), as_right(pts), 40.0).where("id <> rid")
    first = pts.groupBy("label").agg(F.min("id").alias("id"))
    paths = shortest_paths(pairs.select(F.col("id").alias("a"), F.col("rid").alias("b"), (F.col("d") * 0.2).alias("w")), first)
    start = pts.join(first, ["label", "id"]).select("label", F.col("id").alias("src"), F.col("x").alias("sx"), F.col("y").alias("sy"))
    straight = F.sqrt(F.pow(F.col("x") - F.col("sx"), F.lit(2)) + F.pow(F.col("y") - F.col("sy"), F.lit(2))) * 0.2 * 1.35
    return pts.join(F.broadcast(start), "label").join(paths, ["src", "id"], "left").select("src", "id", F.round(F.coalesce("minutes", straight), 5).alias("minutes"))
