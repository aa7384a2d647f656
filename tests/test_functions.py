"""Column functions on small frames: text, ranks, random numbers, filters, curves, shifts."""

import pytest
from pyspark.sql import functions as F

from sparkwarden.functions import text as T
from sparkwarden.functions.rng import normal, uniform, uniform_sql
from sparkwarden.functions.stats import auc, average_rank, quantile_bucket
from sparkwarden.operators.policy import find_shift, shifted
from sparkwarden.operators.projections import proximity_score, shrunk, unit_scaled
from sparkwarden.operators.relational import apply_filters, concentration, first_crossing, lift_at


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "c string").select(f(F.col("c")).alias("o")).first().o


@pytest.mark.parametrize(
    "f, given, wanted",
    [
        (T.normalize_text, "  corner  store ", "CORNER STORE"),
        (T.normalize_address, "12 Main St., Apt 2", "12 MAIN ST APT 2"),
        (T.match_address, "5901 Fifth Avenue Suite 3", "5901 5TH AVE"),
        (T.match_address, "5901 5th Ave", "5901 5TH AVE"),
        (T.match_address, "100 North Craig Street", "100 N CRAIG ST"),
        (T.match_address, None, None),
        (T.zip5, "15213-1234", "15213"),
        (T.zip5, "n/a", None),
        (T.name_key, "JOE'S MART #12", "JOE S MART"),
        (T.name_key, "Joe's Mart 7", "JOE S MART"),
        (T.classify_outlet, "Mike's Vape & Smoke Shop", "tobacco_shop"),
        (T.classify_outlet, "GETGO #3456", "convenience_gas"),
        (T.classify_outlet, "Giant Eagle Pharmacy", "supermarket"),
        (T.classify_outlet, "Family Dollar #123", "dollar_store"),
        (T.classify_outlet, "Joe's Corner Market", "convenience_independent"),
        (T.classify_outlet, "Zzz Holdings", "other"),
        (T.classify_outlet, None, "other"),
    ],
)
def test_text(spark, f, given, wanted):
    assert one(spark, given, f) == wanted


def test_location_key_is_null_if_a_part_is(spark):
    df = spark.createDataFrame([("12 Main St., Apt 2", "15213-1234"), ("1 A St", None)], "s string, z string")
    assert [r.k for r in df.select(T.location_key(F.col("s"), F.col("z")).alias("k")).collect()] == ["12 MAIN ST APT 2|15213", None]


def test_similarity(spark):
    df = spark.createDataFrame([("QUICK STOP", "PIZZA PALACE"), ("SAME", "SAME"), ("", "")], "a string, b string")
    low, equal, empty = (r.s for r in df.select(T.similarity(F.col("a"), F.col("b")).alias("s")).collect())
    assert low < 0.55 and equal == 1 and empty == 1


def test_uniform_is_the_same_in_sql(spark, duck):
    ours = [r.u for r in spark.range(50).select(uniform("x", "id").alias("u")).collect()]
    assert ours == [r[0] for r in duck.sql(f"SELECT {uniform_sql('x', 'range')} FROM range(50)").fetchall()]
    assert all(0 <= u < 1 for u in ours)


def test_normal_has_mean_0_and_deviation_1(spark):
    row = spark.range(4000).select(normal("n", "id").alias("z")).agg(F.avg("z").alias("m"), F.stddev("z").alias("s")).first()
    assert abs(row.m) < 0.06 and abs(row.s - 1) < 0.06


def test_ranks_and_buckets(spark):
    df = spark.createDataFrame([(x,) for x in [10, 20, 20, 30]], "v int")
    assert sorted(r.r for r in df.select(average_rank("v").alias("r")).collect()) == [1, 2.5, 2.5, 4]
    rows = spark.range(124).withColumn("b", quantile_bucket(5, F.col("id") + 1, F.lit(124))).groupBy("b").count().orderBy("b").collect()
    assert [r["count"] for r in rows] == [25, 25, 24, 25, 25]


def test_places_and_chunks_equal_windows_over_whole_groups(spark, monkeypatch):
    from pyspark.sql import Window

    from sparkwarden.functions import stats

    rows = [(k % 3 if k % 7 else None, None if k % 11 == 0 else float(k * 37 % 23) - 5, k) for k in range(200)] + [(9, 1.0, 900)]
    df = spark.createDataFrame(rows, "g int, s double, id int").repartition(4)
    w = Window.partitionBy("g")
    wanted = df.withColumn("rn", F.row_number().over(w.orderBy(F.desc("s"), "id"))).withColumn("n_all", F.count("*").over(w))
    for buckets in (4096, 3):
        monkeypatch.setattr(stats, "BUCKETS", buckets)
        got = stats.place_within(df, "s", "id", "g")
        assert sorted(map(str, got.collect())) == sorted(map(str, wanted.collect()))
        assert sorted(map(str, stats.place_within(df, "s", "id", "g", ends=(-5.0, 20.0)).collect())) == sorted(map(str, wanted.collect()))
    chunks = wanted.select("id", stats.ntile(9, F.col("rn"), F.col("n_all")).alias("c"))
    plain = df.select("id", F.ntile(9).over(w.orderBy(F.desc("s"), "id")).alias("c"))
    assert sorted(map(tuple, chunks.collect())) == sorted(map(tuple, plain.collect()))
    assert stats.place_within(df.limit(0), "s", "id", "g").count() == 0
    low = df.where("s IS NOT NULL").withColumn("u", (F.col("s") + 5) / 24).withColumn("k", F.coalesce(F.col("g") * 4, F.lit(3)))
    first = low.withColumn("rn", F.row_number().over(w.orderBy("u", "id"))).where("rn <= k").drop("rn")
    for most in (10, 0):
        assert sorted(map(str, stats.lowest_within(low, "u", "id", "k", "g", buckets=5, most=most).collect())) == sorted(map(str, first.collect()))


def test_auc(spark):
    df = spark.createDataFrame([(0.1, 0), (0.2, 0), (0.8, 1), (0.9, 1), (0.2, 1)], "s double, y int")
    assert auc(df, "s", "y").first().auc == pytest.approx((2 + 2 + 1.5) / 6)


def test_lift_of_a_perfect_ranking(spark):
    df = spark.range(100).select("id", (F.col("id") < 10).cast("int").alias("y"), (-F.col("id")).alias("s"))
    assert lift_at(df, "s", "y", 0.1, ["id"]).first().lift == pytest.approx(10)


def test_concentration_of_ten_rows(spark):
    df = spark.createDataFrame([(i, 10 - i, v) for i, v in enumerate([50, 10, 10, 10, 5, 5, 5, 3, 1, 1])], "id int, s int, v int").withColumn("g", F.lit(1))
    rows = concentration(df, "s", "v", "id", "g").orderBy("k").collect()
    assert rows[0].captured == 0 and rows[1].captured == 0.5 and rows[10].captured == 1
    assert all(r.best >= r.captured - 1e-12 for r in rows)


def test_first_crossing(spark):
    df = spark.createDataFrame([("a", 0.0, -1.0), ("a", 1.0, -1.0), ("a", 2.0, 1.0), ("b", 0.0, 1.0), ("b", 1.0, 2.0)], "g string, x double, y double")
    assert {r.g: r.crossing for r in first_crossing(df, "x", "y", "g").collect()} == {"a": 1.5, "b": None}


def test_filters(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (None, "a")], "v int, k string")
    assert apply_filters(df, [{"col": "v", "min": 1, "max": 2}]).count() == 2
    assert apply_filters(df, [{"col": "k", "values": ["a"]}, {"col": "v", "max": 1}]).count() == 1


def test_shift_hits_the_target_and_keeps_the_order(spark):
    df = spark.createDataFrame([(0.05,), (0.1,), (0.2,), (0.4,)], "p double")
    shift = find_shift(df, "p", 0.3)
    q = [r.q for r in df.select(shifted(F.col("p"), F.lit(1.0), F.lit(shift)).alias("q")).collect()]
    assert shift > 0 and sum(q) / 4 == pytest.approx(0.3, abs=1e-8) and q == sorted(q)


def test_proximity_scaling_and_shrinkage(spark):
    df = spark.createDataFrame([(100.0, 1), (None, None)], "d double, n int")
    near, far = (r.s for r in df.select(proximity_score(F.col("d"), F.col("n"), 300.0, 3).alias("s")).collect())
    assert near > 0.3 and far < 1e-6
    flat = spark.createDataFrame([(2.0,), (2.0,)], "x double")
    assert [r.u for r in unit_scaled(flat, "x", "u").collect()] == [0.0, 0.0]
    shares = spark.createDataFrame([(0.1, 0.01), (0.3, 0.5), (0.9, 0.01), (None, 0.1)], "s double, m double")
    out = [r.o for r in shrunk(shares, "s", "m", "o").collect()]
    assert out[3] == pytest.approx(0.3) and 0.3 < out[2] < 0.9


def test_sequence_ratio_equals_the_standard_matcher(spark):
    import difflib
    import random

    from pyspark.sql import functions as F

    from sparkwarden.functions import text as T

    rng = random.Random(8)
    pairs = [(None, None), ("", "x"), ("", ""), ("same", "same"), ("abcd", "bcde"), ("SMOKE SHOP #12", "THE SMOKE SHOPPE"), ("aaaa", "aa"), ("qabxcd", "abycdf"), ("é日本", "日é本")]
    pairs += [tuple("".join(rng.choice("ABC D") for _ in range(rng.randrange(22))) for _ in "ab") for _ in range(150)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    for r in df.select("i", T.sequence_ratio(F.col("a"), F.col("b")).alias("ratio")).collect():
        a, b = pairs[r.i]
        assert abs(r.ratio - difflib.SequenceMatcher(None, a or "", b or "").ratio()) < 1e-12, pairs[r.i]


def test_workbooks_are_read_by_stretches_with_pushed_filters(spark, tmp_path):
    from pyspark.sql import functions as F

    from sparkwarden.sources import workbook as W

    rows = [(i, None if i % 7 == 0 else f"kind <{i % 3}> & é", float(i) / 4 if i % 5 else None, " padded ") for i in range(130)]
    df = spark.createDataFrame(rows, "id bigint, kind string, price double, note string").repartition(2)
    assert W.write_workbooks(df, f"file://{tmp_path}/books") == 2
    schema = "id bigint, kind string, price double, note string, other string"
    got = W.read_workbooks(spark, f"file://{tmp_path}/books", schema, 40)
    assert got.rdd.getNumPartitions() >= 4
    assert sorted(tuple(r) for r in got.collect()) == sorted((*r, None) for r in rows)
    one = got.where((F.col("kind") == "kind <1> & é") & (F.col("id") > 20))
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "kind" not in plan.split("Filter", 1)[1].split("\n")[0] and "id" in plan.split("Filter", 1)[1].split("\n")[0]
    assert sorted(r.id for r in one.collect()) == [i for i, k, _, _ in rows if k == "kind <1> & é" and i > 20]


def test_sheets_with_shared_texts_and_gaps(tmp_path):
    import zipfile

    from sparkwarden.sources import workbook as W

    ns = W._NS[1:-1]
    with zipfile.ZipFile(tmp_path / "a.xlsx", "w") as book:
        book.writestr("xl/workbook.xml", f'<workbook xmlns="{ns}" xmlns:r="{W._REL[1:-1]}"><sheets><sheet name="x" sheetId="1" r:id="q"/></sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="p"><Relationship Id="q" Target="/xl/worksheets/s.xml"/></Relationships>')
        book.writestr("xl/sharedStrings.xml", f'<sst xmlns="{ns}"><si><t>name</t></si><si><r><t>a</t></r><r><t>b</t></r></si></sst>')
        book.writestr("xl/worksheets/s.xml", f'<worksheet xmlns="{ns}"><sheetData><row><c r="B1" t="s"><v>0</v></c></row><row/><row><c r="AA3"><v>5</v></c><c r="B3" t="s"><v>1</v></c></row></sheetData></worksheet>')
    with zipfile.ZipFile(tmp_path / "a.xlsx") as book:
        assert W.sheets(book) == ["xl/worksheets/s.xml"]
        assert list(W.rows(book, W.sheets(book)[0], W.shared_texts(book))) == [{1: "name"}, {}, {26: "5", 1: "ab"}]
    assert W.typed("x", int) is None and W.typed("2.0", int) == 2


def test_views_and_table_functions(spark):
    from sparkwarden.plans import views
    from tests.conftest import DATA

    names = views.register_views(spark, DATA, ["stores", "tracts"])
    assert {"orders", "dataset_stores", "dataset_tracts"} <= set(names)
    assert spark.sql("SELECT count(*) FROM dataset_stores").first()[0] == spark.sql("SELECT count(*) FROM customer").first()[0]
    views.register_figures(spark, DATA, ("power", "outlets"))
    assert {r.figure for r in spark.sql("SELECT * FROM figure_info('out')").collect()} == {"outlets"}
    one = spark.sql("SELECT * FROM figure_rows('power')")
    assert one.count() > 0 and {r.figure for r in one.collect()} == {"power"}
    assert "lineitem" not in one._jdf.queryExecution().optimizedPlan().toString()  # the other figure is gone from the plan
    assert spark.sql("SELECT * FROM figure_rows('none')").count() == 0
