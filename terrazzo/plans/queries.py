"""Registered queries over the driver's tables, as integer geometries derived from them, and their SQL.

The views are the same text in both engines: boxes from parts, points from suppliers, segments from line
items, triangles from orders, lines from users' events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from terrazzo.functions import canonical, exact, geometry as g, kernels as k
from terrazzo.operators import certify, hausdorff, locate as loc, measures, model, overlay as ov, relate as rel, spatial_join as sj, slabs, validity, witness
from terrazzo.plans import audit, sampling, scoring
from terrazzo.session import materialize, ship

CENTS = "CAST(ROUND({0} * 100) AS BIGINT)"
MOD = "(({0} % {1}) + {1}) % {1}"

BOXES = f"""SELECT p_partkey AS k, CAST(p_size AS BIGINT) AS x1, CAST(p_size + 1 + p_partkey % 7 AS BIGINT) AS x2,
    {CENTS.format('p_retailprice')} % 97 AS y1, {CENTS.format('p_retailprice')} % 97 + 1 + p_partkey % 5 AS y2 FROM part"""
POINTS = f"SELECT s_suppkey AS k, s_suppkey % 50 AS x, {MOD.format(CENTS.format('s_acctbal'), 97)} AS y FROM supplier"
SEGMENTS = """SELECT l_orderkey AS k, CAST(l_linenumber AS BIGINT) AS i, l_partkey % 64 AS x1, CAST(l_quantity AS BIGINT) AS y1,
    l_suppkey % 64 AS x2, CAST(l_linenumber * 7 AS BIGINT) AS y2 FROM lineitem"""
TRIANGLES = f"""SELECT o_orderkey AS k, o_custkey % 40 AS ax, o_orderkey % 37 AS ay, o_orderkey % 31 AS bx, {CENTS.format('o_totalprice')} % 29 AS bz,
    {CENTS.format('o_totalprice')} % 43 AS cx, o_custkey % 41 AS cy FROM orders"""
LINES = f"""SELECT k, seq, x, y FROM (SELECT user_id AS k, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq,
    event_id % 64 AS x, {CENTS.format('value')} % 64 AS y FROM events) AS e"""


def _view(spark: SparkSession, sf_dir: str, sql: str, *tables: str) -> DataFrame:
    ship(spark)
    for t in tables:
        name = f"terrazzo_{t}"
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(name)
        sql = sql.replace(f"FROM {t}", f"FROM {name}")
    return spark.sql(sql)


def boxes(spark: SparkSession, d: str) -> DataFrame:
    return _view(spark, d, BOXES, "part")


def points(spark: SparkSession, d: str) -> DataFrame:
    return _view(spark, d, POINTS, "supplier")


def segments(spark: SparkSession, d: str) -> DataFrame:
    return _view(spark, d, SEGMENTS, "lineitem")


def triangles(spark: SparkSession, d: str) -> DataFrame:
    return _view(spark, d, TRIANGLES, "orders")


def lines(spark: SparkSession, d: str) -> DataFrame:
    return _view(spark, d, LINES, "events")


def _c(*names: str) -> list[Column]:
    return [F.col(n) for n in names]


def box_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Each part's box with the next part's: pair, the ordinates of both, and the geometries a and b."""
    a = boxes(spark, d)
    b = a.select((F.col("k") - 1).alias("k"), *(F.col(c).alias(f"{c}_r") for c in ("x1", "x2", "y1", "y2")))
    rows = a.join(b, "k").withColumnRenamed("k", "pair")
    return rows.withColumn("a", g.box(*_c("x1", "y1", "x2", "y2"))).withColumn("b", g.box(*_c("x1_r", "y1_r", "x2_r", "y2_r")))


def box_relate(spark, d):
    return model.once(box_pairs(spark, d), lambda p: rel.relate(p, "narrow"))


def box_relate_wide(spark, d):
    """The same through the lane of unbounded integers, on boxes scaled down to fractions that only it holds."""
    small = lambda x, y: (x / 1024 + 2.0**-40, y * 2.0**-30)
    pairs = box_pairs(spark, d).select("pair", g.st_mapcoords(F.col("a"), small).alias("a"), g.st_mapcoords(F.col("b"), small).alias("b"))
    return model.once(pairs, lambda p: rel.relate(p, "wide"))


def box_predicates(spark, d):
    return model.once(box_pairs(spark, d), lambda p: rel.predicates(p, "narrow")).drop("dim_a", "dim_b", "conventions")


def box_overlay(spark, d):
    out = model.once(box_pairs(spark, d), lambda p: ov.overlay(p, lane="narrow"))
    return out.select("pair", "op", F.col("area").cast("bigint").alias("area"))


def box_overlay_wkt(spark, d):
    """Intersections of neighbouring boxes as text."""
    return model.once(box_pairs(spark, d), lambda p: ov.overlay_geometry(p, "intersection", areal=True, lane="narrow")).select("pair", "wkt")


def box_consistency(spark, d):
    """Pairs whose areas contradict their matrix: none."""
    corner = lambda n, i: F.col(f"{n}.elements")[0]["rings"][0][i]
    area_of = lambda n: ((corner(n, 2)["x"] - corner(n, 0)["x"]) * (corner(n, 2)["y"] - corner(n, 0)["y"])).cast("bigint").cast("string").alias(f"area_{n}")

    def problems(pairs: DataFrame) -> DataFrame:
        related = rel.relate(pairs, "narrow").join(pairs.select("pair", area_of("a"), area_of("b")), "pair")
        return ov.consistency_problems(related, ov.overlay(pairs, lane="narrow"))

    return model.once(box_pairs(spark, d), problems)


def box_dual_route(spark, d):
    """Matrices from the arrangement against the closed form of boxes: how many agree, by matrix."""
    pairs = box_pairs(spark, d)
    closed = pairs.select("pair", sj.box_matrix().alias("closed"))
    both = model.once(pairs, lambda p: rel.relate(p, "narrow")).join(closed, "pair")
    return both.groupBy("matrix").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("matrix").eqNullSafe(F.col("closed")), 1)).alias("agree"))


def box_join_histogram(spark, d):
    """All pairs of boxes that meet, by matrix."""
    return sj.box_join_matrices(boxes(spark, d), 16.0)


def box_join_area(spark, d):
    """Common area of each box with all others that meet it."""
    return sj.box_join_totals(boxes(spark, d), 16.0)


def point_location(spark, d):
    """Suppliers' points in parts' boxes: inside and on the border."""
    return sj.count_in_boxes(points(spark, d), boxes(spark, d), 16.0)


def triangle_location(spark, d):
    """Where each order's triangle holds the point (20, 20)."""
    t = triangles(spark, d)
    corners = [("ax", "ay"), ("bx", "bz"), ("cx", "cy")]
    sides = F.array(*(F.struct(*(F.col(c).alias(n) for c, n in zip((*p, *q), ("x1", "y1", "x2", "y2")))) for p, q in zip(corners, corners[1:] + corners[:1])))
    edges = t.select(F.col("k").alias("key"), F.explode(sides).alias("e")).select("key", "e.*")
    at = t.select(F.col("k").alias("key"), F.lit(0).alias("id"), F.lit(20).cast("bigint").alias("x"), F.lit(20).cast("bigint").alias("y"))
    return sj.locate_in_rings(at, edges).select("key", "loc")


def triangle_area(spark, d):
    t = triangles(spark, d)
    area2 = k.orient_value(*_c("ax", "ay", "bx", "bz", "cx", "cy"))
    return t.select("k", area2.alias("area2"), k.sign(area2).cast("bigint").alias("turn"), k.quadrant(F.col("bx") - F.col("ax"), F.col("bz") - F.col("ay")).cast("bigint").alias("quadrant"))


def triangle_measures(spark, d):
    """Area by the general measure, as exact text."""
    t = triangles(spark, d)
    ring = [(F.col(x), F.col(y)) for x, y in (("ax", "ay"), ("bx", "bz"), ("cx", "cy"), ("ax", "ay"))]
    geoms = t.select(F.col("k").alias("id"), g.polygon(ring).alias("geom"))
    return measures.area(geoms)


def triangle_validity(spark, d):
    """Triangles that are no polygons, with the reason."""
    t = triangles(spark, d)
    ring = [(F.col(x), F.col(y)) for x, y in (("ax", "ay"), ("bx", "bz"), ("cx", "cy"), ("ax", "ay"))]
    out = validity.validate(t.select(F.col("k").alias("id"), g.polygon(ring).alias("geom")), "narrow")
    return out.select("id", "valid")


def segment_meetings(spark, d):
    """Pairs of an order's segments: apart, touching or crossing, and whether they are parallel."""
    s = segments(spark, d)
    t = s.select("k", *(F.col(c).alias(f"{c}_r") for c in ("i", "x1", "y1", "x2", "y2")))
    rows = s.join(t, "k").where("i < i_r")
    o = [*_c("x1", "y1", "x2", "y2"), *_c("x1_r", "y1_r", "x2_r", "y2_r")]
    s1, s2 = (k.sign(k.orient_value(*o[:4], *o[i : i + 2])) for i in (4, 6))
    s3, s4 = (k.sign(k.orient_value(*o[4:], *o[i : i + 2])) for i in (0, 2))
    kind = F.when((s1 * s2 < 0) & (s3 * s4 < 0), "cross").when(k.segments_intersect(*o), "touch").otherwise("apart")
    return rows.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def segment_crossings(spark, d):
    """The point where two segments of an order cross, as exact text."""
    s = segments(spark, d).where("NOT (x1 = x2 AND y1 = y2)")
    t = s.select("k", *(F.col(c).alias(f"{c}_r") for c in ("i", "x1", "y1", "x2", "y2")))
    rows = s.join(t, "k").where("i < i_r")
    p = k.Narrow.crossings(*_c("x1", "y1", "x2", "y2", "x1_r", "y1_r", "x2_r", "y2_r"))
    rows = rows.select("k", "i", "i_r", p.alias("p")).where("size(p) = 1").select("k", "i", "i_r", F.col("p")[0].alias("p"))
    return rows.select("k", "i", "i_r", *(F.col(f"p.{c}").cast("bigint").alias(c.lower()) for c in "XYW"))


def segment_distance(spark, d):
    """Squared distance of each segment to the point (32, 25), as numerator and denominator."""
    n, m = k.point_segment_sqdist(F.lit(32).cast("bigint"), F.lit(25).cast("bigint"), *_c("x1", "y1", "x2", "y2"))
    return segments(spark, d).select("k", "i", n.alias("num"), m.alias("den"))


def line_ends(spark, d):
    """Boundary of each user's line by the Mod-2 rule: its ends, none if it is closed."""
    coords = lines(spark, d).select(F.col("k").alias("pair"), F.lit(0).alias("g"), F.lit(0).alias("elem"), F.lit(model.LINE).alias("kind"), F.lit(0).alias("ring"), F.col("seq").alias("i"), "x", "y")
    return model.endpoints_mod2(coords).where("n % 2 = 1").select(F.col("pair").alias("k"), "x", "y")


def line_boxes(spark, d):
    """Users' lines against parts' boxes of the same number: matrices."""
    rows = lines(spark, d).groupBy("k").agg(F.sort_array(F.collect_list(F.struct("seq", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")))).alias("p"))
    a = rows.select(F.col("k").alias("pair"), g.linestring(F.transform("p", lambda v: F.struct(v["x"].alias("x"), v["y"].alias("y")))).alias("a"))
    b = boxes(spark, d).select(F.col("k").alias("pair"), g.box(*_c("x1", "y1", "x2", "y2")).alias("b"))
    return rel.relate(a.join(b, "pair"), "narrow")


def line_lengths(spark, d):
    """Certified length of each user's line, in thousandths: n segments of one length count as one of n times it, so that a user has a bounded number of terms."""
    w = Window.partitionBy("k").orderBy("seq")
    step = lambda c: F.lead(c).over(w) - F.col(c)
    rows = lines(spark, d).select("k", step("x").alias("dx"), step("y").alias("dy"))
    terms = rows.groupBy("k", F.coalesce(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"), F.lit(0)).alias("d2")).agg(F.count(F.lit(1)).cast("decimal(19,0)").alias("n"))
    sums = terms.groupBy("k").agg(exact.sqrt_sum(F.collect_list((F.col("n") * F.col("n") * F.col("d2").cast("decimal(10,0)")).cast("string"))).alias("length"))
    return sums.select(F.col("k").alias("id"), F.round(F.col("length.rounded") * 1000).cast("bigint").alias("length"))


def line_hulls(spark, d):
    """Corners of each user's convex hull: a corner is the lowest or highest point at its x, and only those are collected."""
    ends = lines(spark, d).groupBy("k", "x").agg(F.min("y").alias("low"), F.max("y").alias("high"))
    points = ends.select("k", F.explode(F.array(*(F.struct(F.col("x").cast("double").alias("x"), F.col(c).cast("double").alias("y")) for c in ("low", "high")))).alias("p"))
    rows = points.groupBy("k").agg(F.sort_array(F.collect_list("p")).alias("p"))
    geoms = rows.select(F.col("k").alias("id"), g.linestring(F.col("p")).alias("geom"))
    return measures.convex_hull(geoms).select("id", F.explode("hull").alias("p")).select("id", F.col("p.x").cast("bigint").alias("x"), F.col("p.y").cast("bigint").alias("y"))


def nearest_points(spark, d):
    """The nearest other supplier of each supplier, however far."""
    return measures.nearest_other(points(spark, d).withColumnRenamed("k", "id"), 12.0)


def number_texts(spark, d):
    """Exact texts of accounts in quarters, and the doubles read back from them."""
    s = ship(spark).read.parquet(f"{d}/supplier.parquet").select("s_suppkey", (F.round(F.col("s_acctbal") * 100) / 4).alias("v"))
    return s.select("s_suppkey", exact.to_rational("v").alias("exact"), exact.rational_to_double(exact.to_rational("v")).alias("back"))


def wkt_round_trip(spark, d):
    """Boxes written as text, JSON and binary and read again: how many come back equal."""
    each = boxes(spark, d).groupBy("x1", "y1", "x2", "y2").agg(F.count(F.lit(1)).alias("times"))  # equal boxes are written once
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))  # few bytes but much work
    b = each.repartition(tasks).select("times", g.box(*_c("x1", "y1", "x2", "y2")).alias("geom"))
    rows = b.select("times", "geom", g.st_geomfromtext(g.st_astext("geom")).alias("t"), g.st_geomfromjson(g.st_asjson("geom")).alias("j"), g.st_geomfromwkb(g.st_asbinary("geom")).alias("w"))
    total = lambda n: F.coalesce(F.sum(n), F.lit(0))
    same = lambda c: total(F.when(F.col(c).eqNullSafe(F.col("geom")), F.col("times"))).alias(c)
    return rows.agg(total("times").alias("n"), same("t"), same("j"), same("w"))


def _synthetic_scores(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Cases, exact answers and the answers of a faulty library: every 17th predicate of the boxes is negated."""
    pairs = box_pairs(spark, d)
    matrix = sj.box_matrix()
    named = rel.named_predicates(F.col("m"), F.lit(2), F.lit(2))
    rows = pairs.select("pair", matrix.alias("m")).select("pair", "m", *(c.cast("string").alias(n) for n, c in named.items()))
    cid = F.col("pair").cast("string")
    family = F.concat(F.lit("f"), (F.col("pair") % 5).cast("string"))
    cases = rows.select(cid.alias("id"), family.alias("family"))
    both = lambda f: F.map_from_arrays(F.array(*map(F.lit, scoring.PREDICATES)), F.array(*(f(i, p) for i, p in enumerate(scoring.PREDICATES))))
    expected = rows.select(
        cid.alias("id"), F.lit("ok").alias("status"), F.col("m").alias("relate"), both(lambda i, p: F.col(p)).alias("predicates"), F.array(F.lit("equals")).alias("conventions"), F.lit("true").alias("valid_a"), F.lit("true").alias("valid_b")
    )
    flip = lambda i, p: F.when((F.col("pair") * 10 + i + 1) % 17 == 0, F.when(F.col(p) == "true", "false").otherwise("true")).otherwise(F.col(p))
    results = rows.select(
        cid.alias("id"), F.lit("faulty@1").alias("lib"), F.when(F.col("pair") % 29 == 0, "unsupported").otherwise(F.col("m")).alias("relate"), both(flip).alias("predicates"),
        F.lit("true").alias("valid_a"), F.when(F.col("pair") % 31 == 0, "false").otherwise("true").alias("valid_b"), F.create_map().cast("map<string,string>").alias("errors"),
    )
    return cases, expected, results


def score_summary(spark, d):
    """Verdicts of the faulty library by capability."""
    return scoring.summary(scoring.score(*_synthetic_scores(spark, d))).select("capability", "records", "correct", "wrong", "convention", "unsupported", "failure_rate")


def score_rollup(spark, d):
    return scoring.by_family(scoring.score(*_synthetic_scores(spark, d)))


def score_clusters(spark, d):
    """The largest clusters of wrong answers."""
    return scoring.clusters(scoring.score(*_synthetic_scores(spark, d)))


def score_controls(spark, d):
    """Planted faults that scoring missed, and failures that were not planted."""
    cases, expected, results = _synthetic_scores(spark, d)
    scores = scoring.score_predicates(scoring.join_results(cases, expected, results))
    n = F.col("id").cast("bigint")
    hit = F.exists(F.sequence(F.lit(0), F.lit(9)), lambda i: (n * 10 + i + 1) % 17 == 0)
    return scoring.controls(scores, cases.where(hit).select("id"))


def sample_strata(spark, d):
    """A stratified sample of 50 customers by nation: how many of each, and their least key."""
    c = ship(spark).read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("stratum"))
    return sampling.stratified_sample(c, "stratum", 50).groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))


def corpus_crosstab(spark, d):
    """Events by type and band of value with a total row."""
    o = ship(spark).read.parquet(f"{d}/events.parquet").select("event_type", F.when(F.col("value") < 100, "low").when(F.col("value") < 300, "middle").otherwise("high").alias("band"))
    return scoring.crosstab(o, "event_type", "band", ["low", "middle", "high"])


def line_centroids(spark, d):
    """Certified centroid of each user's line, in thousandths; segments of one length are one term, so that a user has a bounded number of terms."""
    w = Window.partitionBy("k").orderBy("seq")
    steps = lines(spark, d).select("k", "x", "y", F.lead("x").over(w).alias("u"), F.lead("y").over(w).alias("v")).where("u IS NOT NULL")
    q = (F.col("u") - F.col("x")) * (F.col("u") - F.col("x")) + (F.col("v") - F.col("y")) * (F.col("v") - F.col("y"))
    half = lambda a, b: F.concat(F.sum(F.col(a) + F.col(b)).cast("string"), F.lit("/2"))
    terms = steps.groupBy(F.col("k").alias("id"), q.cast("string").alias("q")).agg(half("x", "u").alias("mx"), half("y", "v").alias("my"), F.count(F.lit(1)).alias("n"))
    return measures.weighted_means(terms).select("id", *(F.round(F.col(f"{c}.rounded") * 1000).cast("bigint").alias(c) for c in "xy"))


def triangle_case_measures(spark, d):
    """All measures of each order's triangle: exact area and centroid, corners of the hull."""
    t = triangles(spark, d)
    ring = [(F.col(x), F.col(y)) for x, y in (("ax", "ay"), ("bx", "bz"), ("cx", "cy"), ("ax", "ay"))]
    out = measures.case_measures(t.select(F.col("k").alias("id"), g.polygon(ring).alias("geom")))
    return out.select("id", "area", F.col("centroid.x").alias("x"), F.col("centroid.y").alias("y"), F.size("hull").cast("bigint").alias("corners"))


def nested_areas(spark, d):
    """Twice the even-odd area of each part's box with rings around it: as many as its key's remainder by four."""
    rows = boxes(spark, d).withColumn("n", F.explode(F.sequence(F.lit(0), (F.col("k") % 4).cast("int")))).withColumn("n", F.col("n").cast("bigint") * 2)
    c = [F.col("x1") - F.col("n"), F.col("y1") - F.col("n"), F.col("x2") + F.col("n"), F.col("y2") + F.col("n")]
    corners = [(c[0], c[1]), (c[2], c[1]), (c[2], c[3]), (c[0], c[3])]
    sides = F.array(*(F.struct(*(v.alias(n) for v, n in zip((*p, *q), ("x1", "y1", "x2", "y2")))) for p, q in zip(corners, corners[1:] + corners[:1])))
    return measures.even_odd_area(rows.select(F.col("k").alias("id"), F.explode(sides).alias("e")).select("id", "e.*"))


def dyadic_parts(spark, d):
    """Accounts in quarters as an odd number times a power of two."""
    s = ship(spark).read.parquet(f"{d}/supplier.parquet").select("s_suppkey", exact.dyadic(F.round(F.col("s_acctbal") * 100) / 4).alias("v"))
    return s.select("s_suppkey", F.col("v.m").cast("bigint").alias("m"), F.col("v.e").cast("bigint").alias("e"))


def _order_answers(spark: SparkSession, d: str) -> DataFrame:
    return ship(spark).read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("customer"))


def _ring(*corners: tuple[str, str]) -> list[tuple[Column, Column]]:
    return [(F.col(x), F.col(y)) for x, y in (*corners, corners[0])]


_CORNERS = ("ax", "ay"), ("bx", "bz"), ("cx", "cy")


def triangle_points(spark, d):
    """Where the suppliers of an order's items lie relative to its triangle."""
    items = ship(spark).read.parquet(f"{d}/lineitem.parquet").select(F.col("l_orderkey").alias("key"), F.col("l_suppkey").alias("id")).distinct()
    at = items.join(points(spark, d).withColumnRenamed("k", "id"), "id").select("key", "id", "x", "y")
    geoms = triangles(spark, d).select(F.col("k").alias("key"), g.polygon(_ring(*_CORNERS)).alias("geom"))
    return loc.locate(at, geoms)


#: Side of the cells by which places meet segments; places of suppliers are at most 50 by 97. Suppliers of a row of ``line_points``' second side, about.
_CELL, _TOGETHER = 8, 10_000


def _last(c: str) -> Column:
    return F.col(c) % 10


def line_points(spark, d):
    """Where suppliers lie relative to the lines of the users whose numbers end in the same digit.

    The result has suppliers times users rows by ten. Only places that lie on a user's line are located, the others are outside; what a line holds
    stays one row a user, which the places of its digit, with their suppliers, read as they stream by: no step sends or writes a row a user and place.
    """
    rows = lines(spark, d).groupBy("k").agg(F.sort_array(F.collect_list(F.struct("seq", "x", "y"))).alias("p"))
    rows = materialize(rows, "lines")
    real = lambda v: F.struct(v["x"].cast("double").alias("x"), v["y"].cast("double").alias("y"))
    geoms = rows.select(F.col("k").alias("key"), g.linestring(F.transform("p", real)).alias("geom"))
    named = points(spark, d).withColumn("_d", _last("k"))
    found = loc.locate(_places_on_lines(rows, named), geoms).where("loc <> 'E'")
    held = found.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("id", F.struct("loc", "dim")))).alias("held"))  # of one line
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    users = rows.select(F.col("k").alias("key"), _last("k").alias("_d")).join(held.hint("merge"), "key", "left").withColumn("_salt", F.pmod(F.xxhash64("key"), F.lit(tasks)))
    parts = -(-named.count() // _TOGETHER)
    places = named.groupBy("_d", "x", "y", F.pmod(F.xxhash64("k"), F.lit(max(1, parts))).alias("_part")).agg(F.collect_list("k").alias("ids"))
    places = places.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1)))).withColumn("_salt", F.col("_salt").cast("bigint"))
    users, places = (x.repartition(tasks, "_d", "_salt") for x in (users, places))  # few bytes but many results: not for AQE to coalesce
    at = users.join(places.hint("merge"), ["_d", "_salt"]).withColumn("at", F.col("held")[F.struct("x", "y")])
    return at.select("key", F.explode("ids").alias("id"), F.coalesce("at.loc", F.lit("E")).alias("loc"), F.coalesce("at.dim", F.lit(-1)).alias("dim"))


def _places_on_lines(rows: DataFrame, named: DataFrame) -> DataFrame:
    """(key, id, x, y): the places of each digit's suppliers that lie on a segment or at the only point of a user's line (k, p), whose id is (x, y)."""
    after = F.concat(F.slice("p", F.lit(2), F.size("p") - 1), F.slice("p", -1, 1))
    ends = F.zip_with("p", after, lambda u, v: F.struct(u["x"].alias("x1"), u["y"].alias("y1"), v["x"].alias("x2"), v["y"].alias("y2")))
    of = lambda f, c: f(F.col(f"{c}1"), F.col(f"{c}2"))
    segs = rows.select("k", _last("k").alias("_d"), F.explode(ends).alias("s")).select("k", "_d", "s.*")
    cell = lambda c: F.floor(c / _CELL)
    segs = segs.withColumn("_cell", F.explode(F.sequence(cell(of(F.least, "y")), cell(of(F.greatest, "y")))))
    places = F.broadcast(named.select("_d", "x", "y").distinct().withColumn("_cell", cell(F.col("y"))))
    on = segs.join(places, ["_d", "_cell"]).where(k.on_segment(*_c("x", "y", "x1", "y1", "x2", "y2")))
    return on.select(F.col("k").alias("key"), F.struct("x", "y").alias("id"), "x", "y").distinct()


def mixed_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Each customer's first triangle with a frame around a part's box, the rim of the customer's last triangle, or that triangle, by number: pair, kind, a, b."""
    t = triangles(spark, d).where(k.orient_value(*_c("ax", "ay", "bx", "bz", "cx", "cy")) != 0)
    own = ship(spark).read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("pair"))
    own = own.join(t, "k").groupBy("pair").agg(*(f(F.struct("k", *(n for c in _CORNERS for n in c))).alias(n) for f, n in ((F.min, "s"), (F.max, "e"))))
    corners = lambda s: _ring(*((f"{s}.{x}", f"{s}.{y}") for x, y in _CORNERS))
    around = lambda n: [(F.col("x1") - n, F.col("y1") - n), (F.col("x2") + n, F.col("y1") - n), (F.col("x2") + n, F.col("y2") + n), (F.col("x1") - n, F.col("y2") + n), (F.col("x1") - n, F.col("y1") - n)]
    points_of = lambda ring: F.array(*(F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in ring))
    rows = own.join(boxes(spark, d).withColumnRenamed("k", "pair"), "pair")
    kind = F.element_at(F.array(*map(F.lit, ("frame", "rim", "triangle"))), (F.col("pair") % 3 + 1).cast("int"))
    b = F.when(kind == "frame", g.polygon(around(3), around(0))).when(kind == "rim", g.linestring(points_of(corners("e")))).otherwise(g.polygon(corners("e")))
    return rows.select("pair", kind.alias("kind"), g.polygon(corners("s")).alias("a"), b.alias("b"))


def dual_routes(spark, d):
    """Matrices of the arrangement and of witness points, which share no labels: pairs and how many agree, by what the triangle meets."""
    pairs = mixed_pairs(spark, d)
    both = witness.dual_agreement(pairs.select("pair", "a", "b"), rel.relate(pairs.select("pair", "a", "b"), "narrow"))
    return both.join(pairs.select("pair", "kind"), "pair").groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_if("agree").alias("agree"))


def _triangle_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Each customer's first and last triangle: pair, corners ax .. cy of one and ax_r .. cy_r of the other, a, b."""
    t = triangles(spark, d).where(k.orient_value(*_c("ax", "ay", "bx", "bz", "cx", "cy")) != 0)
    names = [n for c in _CORNERS for n in c]
    own = ship(spark).read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("pair")).join(t, "k")
    rows = own.groupBy("pair").agg(*(f(F.struct("k", *names)).alias(n) for f, n in ((F.min, "s"), (F.max, "e"))))
    ring = lambda s: _ring(*((f"{s}.{x}", f"{s}.{y}") for x, y in _CORNERS))
    return rows.select("pair", g.polygon(ring("s")).alias("a"), g.polygon(ring("e")).alias("b"))


def triangle_overlays(spark, d):
    """Areas of the four operations over each customer's first and last triangle, times 1000 sqrt(2) and rounded."""
    out = ov.overlay(_triangle_pairs(spark, d), lane="narrow")
    return out.select("pair", "op", F.round(exact.rational_to_double("area") * 1414.2135623730951).cast("bigint").alias("area"))


def slab_agreement(spark, d):
    """The same areas by two routes, the arrangement and slabs: how many agree exactly, by operation, and how many have none."""
    pairs = _triangle_pairs(spark, d)
    both = ov.overlay(pairs, lane="narrow").select("pair", "op", "area").join(slabs.overlay_areas(pairs, "narrow").withColumnRenamed("area", "other"), ["pair", "op"])
    return both.groupBy("op").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("area") == F.col("other")).alias("agree"), F.count_if(F.col("other") == "0").alias("without"))


def box_certificates(spark, d):
    """Certified intersections of neighbouring boxes: whether each holds, and at how many nodes it was looked at.

    Neither changes if both boxes move by integers, so pairs are certified with the first box at the origin, and those that are equal there once:
    parts have 50 sizes, 97 prices and 35 shapes of box, which leaves 99 * 193 * 35 such pairs, whatever the number of parts.
    """
    at = lambda r: [F.col(f"{c}{r}") - F.col(f"{c[0]}1") for c in ("x1", "y1", "x2", "y2")]
    pairs = box_pairs(spark, d).select("pair", g.box(*at("")).alias("a"), g.box(*at("_r")).alias("b"))
    out = model.once(pairs, lambda p: certify.overlay_certified(p, "intersection", lane="narrow"))
    return out.select("pair", "ok", "nodes")


def canonical_triangles(spark, d):
    """Triangles of orders written in all six ways: how many digests they have, and the first two vertices of their canonical form."""
    t = triangles(spark, d).where(k.orient_value(*_c("ax", "ay", "bx", "bz", "cx", "cy")) != 0)
    turns = [_CORNERS[i:] + _CORNERS[:i] for i in range(3)]
    forms = F.array(*(g.polygon(_ring(*way)) for turn in turns for way in (turn, turn[::-1])))
    rows = t.select("k", F.explode(forms).alias("geom")).select("k", canonical.canonicalize(F.col("geom")).alias("geom"))
    ring = F.col("geom.elements")[0]["rings"][0]
    at = lambda i, c: F.min(ring[i][c]).cast("bigint").alias(f"{c}{i + 1}")
    return rows.groupBy("k").agg(F.count_distinct(F.to_json("geom")).alias("n"), *(at(i, c) for i in (0, 1) for c in "xy"))


def corner_distances(spark, d):
    """Squared Hausdorff distance between the first and the last corners of each customer's triangles."""
    corner = lambda x, y: F.struct(F.array().cast("array<int>").alias("path"), F.lit(model.POINT).alias("kind"), F.array(F.array(F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")))).alias("rings"))
    own = ship(spark).read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("pair")).join(triangles(spark, d), "k")
    many = lambda p: F.struct(F.lit("MultiPoint").alias("type"), F.collect_list(p).alias("elements"))
    pairs = own.groupBy("pair").agg(many(corner("ax", "ay")).alias("a"), many(corner("cx", "cy")).alias("b"))
    return hausdorff.hausdorff2(pairs).select("pair", F.col("lo").cast("bigint").alias("d2"))


def answer_disagreements(spark, d):
    """Orders against a copy in which every 7th status and every 11th customer are changed: each field that differs."""
    a = _order_answers(spark, d)
    b = a.select("id", F.when(F.col("id") % 7 == 0, "?").otherwise(F.col("status")).alias("status"), F.when(F.col("id") % 11 == 0, -1).otherwise(F.col("customer")).alias("customer"))
    return audit.disagreements(a, b, ["status", "customer"])


def answer_sides(spark, d):
    """Keys of orders and of lines with more than 45 pieces: in both tables or in one."""
    few = ship(spark).read.parquet(f"{d}/lineitem.parquet").where("l_quantity > 45").select(F.col("l_orderkey").alias("id"))
    return audit.one_sided(_order_answers(spark, d), few).groupBy("side").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"))


def finding_tally(spark, d):
    """Events by type and band of value, a column for each band."""
    e = ship(spark).read.parquet(f"{d}/events.parquet").select(F.col("event_type").alias("lib"), F.when(F.col("value") < 100, "low").otherwise("high").alias("kind"))
    return audit.tally(e, ["low", "high"])


def _runs(spark: SparkSession, d: str) -> DataFrame:
    return ship(spark).read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), (F.col("o_custkey") % 50).alias("cpu"), F.round(F.col("o_totalprice") * 100).cast("bigint").alias("wall"))


def run_totals(spark, d):
    return audit.run_totals(_runs(spark, d))


def slowest_runs(spark, d):
    """The five dearest orders (a top-k report)."""
    return audit.slowest(_runs(spark, d)).select("id", "wall")


def nth_lines(spark, d):
    """Every 17th line item in order of order and line, counted without one task for all."""
    rows = ship(spark).read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return audit.every_nth(rows, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"], 17).where("hit").select("l_orderkey", "l_linenumber")


QUERIES = {f.__name__: f for f in (
    box_relate, box_relate_wide, box_predicates, box_overlay, box_overlay_wkt, box_consistency, box_dual_route, box_join_histogram, box_join_area, point_location,
    triangle_location, triangle_area, triangle_measures, triangle_validity, segment_meetings, segment_crossings, segment_distance, line_ends, line_lengths, line_hulls,
    line_boxes, nearest_points, number_texts, wkt_round_trip, score_summary, score_rollup, score_clusters, score_controls, sample_strata, corpus_crosstab,
    line_centroids, triangle_case_measures, nested_areas, dyadic_parts, answer_disagreements, answer_sides, finding_tally, run_totals, slowest_runs, nth_lines,
    triangle_points, line_points, dual_routes, box_certificates, triangle_overlays, slab_agreement, corner_distances, canonical_triangles,
)}
#: Further names of queries, kept for their users.
ALIASES = {"line_ends_whole": "line_ends", "line_lengths_whole": "line_lengths", "line_hulls_whole": "line_hulls", "line_boxes_whole": "line_boxes", "nearest_points_any": "nearest_points"}
QUERIES |= {also: QUERIES[name] for also, name in ALIASES.items()}

# -- SQL of the same queries --

_PAIRS = f"""box AS ({BOXES}), pairs AS (SELECT a.k AS pair, a.x1 AS ax1, a.x2 AS ax2, a.y1 AS ay1, a.y2 AS ay2, b.x1 AS bx1, b.x2 AS bx2, b.y1 AS by1, b.y2 AS by2
    FROM box a JOIN box b ON {{on}})"""
_MATRIX = """flags AS (SELECT *, ax1 < bx2 AND bx1 < ax2 AS ox, ay1 < by2 AND by1 < ay2 AS oy, ax1 <= bx2 AND bx1 <= ax2 AS cx, ay1 <= by2 AND by1 <= ay2 AS cy,
    ax1 >= bx1 AND ax2 <= bx2 AND ay1 >= by1 AND ay2 <= by2 AS ab, bx1 >= ax1 AND bx2 <= ax2 AND by1 >= ay1 AND by2 <= ay2 AS ba,
    ax1 > bx1 AND ax2 < bx2 AND ay1 > by1 AND ay2 < by2 AS abi, bx1 > ax1 AND bx2 < ax2 AND by1 > ay1 AND by2 < ay2 AS bai,
    ax1 IN (bx1, bx2) OR ax2 IN (bx1, bx2) AS sx, ay1 IN (by1, by2) OR ay2 IN (by1, by2) AS sy FROM pairs),
  m AS (SELECT *, (CASE WHEN ox AND oy THEN '2' ELSE 'F' END) || (CASE WHEN ox AND oy AND NOT ab THEN '1' ELSE 'F' END) || (CASE WHEN ab THEN 'F' ELSE '2' END)
    || (CASE WHEN ox AND oy AND NOT ba THEN '1' ELSE 'F' END) || (CASE WHEN (oy AND sx) OR (ox AND sy) THEN '1' WHEN cx AND cy AND NOT abi AND NOT bai THEN '0' ELSE 'F' END)
    || (CASE WHEN ab THEN 'F' ELSE '1' END) || (CASE WHEN ba THEN 'F' ELSE '2' END) || (CASE WHEN ba THEN 'F' ELSE '1' END) || '2' AS matrix FROM flags)"""
_NEXT = "WITH " + _PAIRS.format(on="b.k = a.k + 1") + ", " + _MATRIX
_P = {
    "disjoint": "NOT (cx AND cy)", "intersects": "cx AND cy", "touches": "cx AND cy AND NOT (ox AND oy)", "crosses": "FALSE", "overlaps": "ox AND oy AND NOT ab AND NOT ba",
    "contains": "ba", "within": "ab", "covers": "ba", "covered_by": "ab", "equals": "ab AND ba",
}
_SHARED = "greatest(0, least(ax2, bx2) - greatest(ax1, bx1)) * greatest(0, least(ay2, by2) - greatest(ay1, by1))"
_AREAS = f"areas AS (SELECT pair, (ax2 - ax1) * (ay2 - ay1) AS a, (bx2 - bx1) * (by2 - by1) AS b, {_SHARED} AS i FROM pairs)"
_O = "((bx - ax) * (cy - ay) - (bz - ay) * (cx - ax))"


def _orient(a: str, b: str, c: str) -> str:
    (ax, ay), (bx, by), (cx, cy) = (p.split() for p in (a, b, c))
    return f"(({bx} - {ax}) * ({cy} - {ay}) - ({by} - {ay}) * ({cx} - {ax}))"


_S = ("s.x1 s.y1", "s.x2 s.y2", "t.x1 t.y1", "t.x2 t.y2")


def _on(a: str, b: str, c: str) -> str:
    (ax, ay), (bx, by), (cx, cy) = (p.split() for p in (a, b, c))
    return f"({_orient(a, b, c)} = 0 AND {cx} BETWEEN least({ax}, {bx}) AND greatest({ax}, {bx}) AND {cy} BETWEEN least({ay}, {by}) AND greatest({ay}, {by}))"


_D1, _D2 = f"sign({_orient(_S[0], _S[1], _S[2])}) * sign({_orient(_S[0], _S[1], _S[3])})", f"sign({_orient(_S[2], _S[3], _S[0])}) * sign({_orient(_S[2], _S[3], _S[1])})"
_TOUCH = " OR ".join([_on(_S[0], _S[1], _S[2]), _on(_S[0], _S[1], _S[3]), _on(_S[2], _S[3], _S[0]), _on(_S[2], _S[3], _S[1])])
_SIDES = "SELECT k, ax AS x1, ay AS y1, bx AS x2, bz AS y2 FROM t UNION ALL SELECT k, bx, bz, cx, cy FROM t UNION ALL SELECT k, cx, cy, ax, ay FROM t"
_E = "((x2 - x1) * (20 - y1) - (y2 - y1) * (20 - x1))"
_FLIPS = {p: f"(pair * 10 + {i + 1}) % 17 = 0" for i, p in enumerate(scoring.PREDICATES)}
_WRONG = " OR ".join(v for p, v in _FLIPS.items() if p != "equals")
_SCORES = f"""{_NEXT}, s AS (SELECT pair, 'f' || (pair % 5) AS family, {_WRONG} AS w, {_FLIPS['equals']} AS c FROM m),
  scores AS (SELECT pair, family, 'relate' AS capability, CASE WHEN pair % 29 = 0 THEN 'unsupported' ELSE 'correct' END AS verdict FROM s
    UNION ALL SELECT pair, family, 'predicates', CASE WHEN w THEN 'wrong' WHEN c THEN 'convention' ELSE 'correct' END FROM s
    UNION ALL SELECT pair, family, 'validity', CASE WHEN pair % 31 = 0 THEN 'wrong' ELSE 'correct' END FROM s)"""
_COR = "t.ax AS {0}1x, t.ay AS {0}1y, t.bx AS {0}2x, t.bz AS {0}2y, t.cx AS {0}3x, t.cy AS {0}3y"
_TWO = f"""t AS (SELECT * FROM ({TRIANGLES}) WHERE {_O} <> 0), o AS (SELECT o_custkey AS pair, min(k) AS f, max(k) AS l FROM t JOIN orders ON o_orderkey = k GROUP BY 1),
  c AS (SELECT pair, 0 AS g, t.* EXCLUDE (k) FROM o JOIN t ON k = f UNION ALL SELECT pair, 1, t.* EXCLUDE (k) FROM o JOIN t ON k = l),
  e AS (SELECT pair, g, ax AS x1, ay AS y1, bx AS x2, bz AS y2 FROM c UNION ALL SELECT pair, g, bx, bz, cx, cy FROM c UNION ALL SELECT pair, g, cx, cy, ax, ay FROM c),
  r AS (SELECT pair, g, CAST(least(x1, x2) AS DOUBLE) AS x1, CAST(CASE WHEN x1 < x2 THEN y1 ELSE y2 END AS DOUBLE) AS y1, CAST(greatest(x1, x2) AS DOUBLE) AS x2, CAST(CASE WHEN x1 < x2 THEN y2 ELSE y1 END AS DOUBLE) AS y2 FROM e WHERE x1 <> x2),
  x AS (SELECT pair, unnest([x1, x2]) AS x FROM r UNION SELECT p.pair, p.x1 + (q.y1 - p.y1 + (p.x1 - q.x1) * (q.y2 - q.y1) / (q.x2 - q.x1)) / ((p.y2 - p.y1) / (p.x2 - p.x1) - (q.y2 - q.y1) / (q.x2 - q.x1)) AS x
    FROM r p JOIN r q ON p.pair = q.pair AND p.g < q.g AND (p.y2 - p.y1) * (q.x2 - q.x1) <> (q.y2 - q.y1) * (p.x2 - p.x1)),
  s AS (SELECT pair, x AS l, lead(x) OVER (PARTITION BY pair ORDER BY x) AS r FROM x),
  h AS (SELECT s.pair, s.l, s.r, min(y) FILTER (g = 0) AS a1, max(y) FILTER (g = 0) AS a2, min(y) FILTER (g = 1) AS b1, max(y) FILTER (g = 1) AS b2
    FROM (SELECT s.*, e.g, e.y1 + (e.y2 - e.y1) * ((s.l + s.r) / 2 - e.x1) / (e.x2 - e.x1) AS y FROM s JOIN r e ON e.pair = s.pair AND e.x1 < (s.l + s.r) / 2 AND (s.l + s.r) / 2 < e.x2) s GROUP BY 1, 2, 3),
  v AS (SELECT pair, coalesce(sum((r - l) * (a2 - a1)), 0) AS a, coalesce(sum((r - l) * (b2 - b1)), 0) AS b, coalesce(sum((r - l) * greatest(0, least(a2, b2) - greatest(a1, b1))) FILTER (a1 IS NOT NULL AND b1 IS NOT NULL), 0) AS i FROM h GROUP BY pair)"""
_FOUR = "(SELECT pair, unnest(['intersection', 'union', 'difference', 'symdifference']) AS op, unnest([i, a + b - i, a - i, a + b - 2 * i]) AS area FROM v)"
_SIG = "concat_ws(',', " + ", ".join(f"CASE WHEN {v} THEN '{p}' END" for p, v in _FLIPS.items() if p != "equals") + ")"

ORACLE_SQL = {
    "box_relate": f"{_NEXT} SELECT pair, matrix FROM m",
    "box_relate_wide": f"{_NEXT} SELECT pair, matrix FROM m",
    "box_predicates": f"{_NEXT} SELECT pair, matrix, {', '.join(f'{v} AS {p}' for p, v in _P.items())} FROM m",
    "box_overlay": f"""{_NEXT}, {_AREAS} SELECT pair, 'intersection' AS op, i AS area FROM areas UNION ALL SELECT pair, 'union', a + b - i FROM areas
        UNION ALL SELECT pair, 'difference', a - i FROM areas UNION ALL SELECT pair, 'symdifference', a + b - 2 * i FROM areas""",
    "box_overlay_wkt": f"""{_NEXT}, r AS (SELECT pair, ox AND oy AS meets, greatest(ax1, bx1) AS x1, least(ax2, bx2) AS x2, greatest(ay1, by1) AS y1, least(ay2, by2) AS y2 FROM m)
        SELECT pair, CASE WHEN meets THEN format('POLYGON (({{}} {{}}, {{}} {{}}, {{}} {{}}, {{}} {{}}, {{}} {{}}))', x1, y1, x2, y1, x2, y2, x1, y2, x1, y1) ELSE 'POLYGON EMPTY' END AS wkt FROM r""",
    "box_consistency": "SELECT CAST(NULL AS BIGINT) AS pair, CAST(NULL AS VARCHAR) AS problem WHERE FALSE",
    "box_dual_route": f"{_NEXT} SELECT matrix, count(*) AS n, count(*) AS agree FROM m GROUP BY matrix",
    "box_join_histogram": "WITH " + _PAIRS.format(on="a.k < b.k AND a.x1 <= b.x2 AND b.x1 <= a.x2 AND a.y1 <= b.y2 AND b.y1 <= a.y2") + f", {_MATRIX} SELECT matrix, count(*) AS n FROM m GROUP BY matrix",
    "box_join_area": "WITH " + _PAIRS.format(on="a.k <> b.k AND a.x1 <= b.x2 AND b.x1 <= a.x2 AND a.y1 <= b.y2 AND b.y1 <= a.y2") + f" SELECT pair AS k, count(*) AS n, CAST(sum({_SHARED}) AS BIGINT) AS area FROM pairs GROUP BY pair",
    "point_location": f"""WITH box AS ({BOXES}), p AS ({POINTS}) SELECT p.k, CASE WHEN x IN (x1, x2) OR y IN (y1, y2) THEN 'B' ELSE 'I' END AS loc, count(*) AS n
        FROM p JOIN box ON x BETWEEN x1 AND x2 AND y BETWEEN y1 AND y2 GROUP BY 1, 2""",
    "triangle_location": f"""WITH t AS ({TRIANGLES}), e AS ({_SIDES}), h AS (SELECT k, bool_or({_E} = 0 AND 20 BETWEEN least(x1, x2) AND greatest(x1, x2) AND 20 BETWEEN least(y1, y2) AND greatest(y1, y2)) AS onit,
        sum(CASE WHEN (y1 > 20) <> (y2 > 20) AND CASE WHEN y2 > y1 THEN {_E} > 0 ELSE {_E} < 0 END THEN 1 ELSE 0 END) AS n FROM e GROUP BY k)
        SELECT k AS key, CASE WHEN onit THEN 'B' WHEN n % 2 = 1 THEN 'I' ELSE 'E' END AS loc FROM h""",
    "triangle_area": f"""WITH t AS ({TRIANGLES}) SELECT k, {_O} AS area2, CAST(sign({_O}) AS BIGINT) AS turn,
        CAST(CASE WHEN bx > ax AND bz >= ay THEN 0 WHEN bx <= ax AND bz > ay THEN 1 WHEN bx < ax AND bz <= ay THEN 2 ELSE 3 END AS BIGINT) AS quadrant FROM t""",
    "triangle_measures": f"WITH t AS ({TRIANGLES}) SELECT k AS id, CASE WHEN {_O} % 2 = 0 THEN CAST(abs({_O}) // 2 AS VARCHAR) ELSE abs({_O}) || '/2' END AS area FROM t",
    "triangle_validity": f"WITH t AS ({TRIANGLES}) SELECT k AS id, {_O} <> 0 AS valid FROM t",
    "segment_meetings": f"""WITH s AS ({SEGMENTS}) SELECT CASE WHEN {_D1} < 0 AND {_D2} < 0 THEN 'cross' WHEN {_TOUCH} THEN 'touch' ELSE 'apart' END AS kind, count(*) AS n
        FROM s JOIN s AS t ON s.k = t.k AND s.i < t.i GROUP BY 1""",
    "segment_crossings": f"""WITH s AS (SELECT * FROM ({SEGMENTS}) WHERE NOT (x1 = x2 AND y1 = y2)), q AS (SELECT s.k, s.i, t.i AS i_r, s.x1 AS px, s.y1 AS py, s.x2 - s.x1 AS ux, s.y2 - s.y1 AS uy,
            (s.x2 - s.x1) * (t.y2 - t.y1) - (s.y2 - s.y1) * (t.x2 - t.x1) AS den, (t.x1 - s.x1) * (t.y2 - t.y1) - (t.y1 - s.y1) * (t.x2 - t.x1) AS tn, (t.x1 - s.x1) * (s.y2 - s.y1) - (t.y1 - s.y1) * (s.x2 - s.x1) AS un,
            s.x1, s.y1, s.x2, s.y2, t.x1 AS tx1, t.y1 AS ty1, t.x2 AS tx2, t.y2 AS ty2 FROM s JOIN s AS t ON s.k = t.k AND s.i < t.i),
        proper AS (SELECT k, i, i_r, (px * den + tn * ux) AS x, (py * den + tn * uy) AS y, den AS w FROM q WHERE den <> 0 AND tn * sign(den) BETWEEN 0 AND abs(den) AND un * sign(den) BETWEEN 0 AND abs(den)),
        ends AS (SELECT k, i, i_r, unnest([CASE WHEN tx1 BETWEEN least(x1, x2) AND greatest(x1, x2) AND ty1 BETWEEN least(y1, y2) AND greatest(y1, y2) THEN {{'x': tx1, 'y': ty1}} END,
            CASE WHEN tx2 BETWEEN least(x1, x2) AND greatest(x1, x2) AND ty2 BETWEEN least(y1, y2) AND greatest(y1, y2) THEN {{'x': tx2, 'y': ty2}} END,
            CASE WHEN x1 BETWEEN least(tx1, tx2) AND greatest(tx1, tx2) AND y1 BETWEEN least(ty1, ty2) AND greatest(ty1, ty2) THEN {{'x': x1, 'y': y1}} END,
            CASE WHEN x2 BETWEEN least(tx1, tx2) AND greatest(tx1, tx2) AND y2 BETWEEN least(ty1, ty2) AND greatest(ty1, ty2) THEN {{'x': x2, 'y': y2}} END]) AS p FROM q WHERE den = 0 AND un = 0),
        shared AS (SELECT k, i, i_r, any_value(p) AS p FROM (SELECT DISTINCT * FROM ends WHERE p IS NOT NULL) GROUP BY 1, 2, 3 HAVING count(*) = 1),
        every AS (SELECT * FROM proper UNION ALL SELECT k, i, i_r, p.x, p.y, 1 FROM shared)
        SELECT k, i, i_r, CAST(x * sign(w) // gcd(gcd(x, y), w) AS BIGINT) AS x, CAST(y * sign(w) // gcd(gcd(x, y), w) AS BIGINT) AS y, CAST(abs(w) // gcd(gcd(x, y), w) AS BIGINT) AS w FROM every""",
    "segment_distance": f"""WITH s AS (SELECT *, x2 - x1 AS dx, y2 - y1 AS dy, 32 - x1 AS px, 25 - y1 AS py FROM ({SEGMENTS})), v AS (SELECT *, dx * dx + dy * dy AS len, px * dx + py * dy AS along FROM s)
        SELECT k, i, CAST(CASE WHEN len = 0 OR along <= 0 THEN px * px + py * py WHEN along >= len THEN (32 - x2) * (32 - x2) + (25 - y2) * (25 - y2) ELSE (dx * py - dy * px) * (dx * py - dy * px) END AS BIGINT) AS num,
        CAST(CASE WHEN len = 0 OR along <= 0 OR along >= len THEN 1 ELSE len END AS BIGINT) AS den FROM v""",
    "line_ends": f"""WITH l AS ({LINES}), b AS (SELECT k, min(seq) AS f, max(seq) AS t FROM l GROUP BY k), e AS (SELECT l.k, x, y FROM l JOIN b ON l.k = b.k AND seq = f UNION ALL SELECT l.k, x, y FROM l JOIN b ON l.k = b.k AND seq = t)
        SELECT k, x, y FROM e GROUP BY k, x, y HAVING count(*) % 2 = 1""",
    "line_lengths": f"""WITH l AS ({LINES}), s AS (SELECT k, x, y, lead(x) OVER w AS u, lead(y) OVER w AS v FROM l WINDOW w AS (PARTITION BY k ORDER BY seq))
        SELECT k AS id, CAST(round(coalesce(sum(sqrt((u - x) * (u - x) + (v - y) * (v - y))), 0) * 1000) AS BIGINT) AS length FROM s GROUP BY k""",
    "line_hulls": f"""WITH l AS (SELECT DISTINCT k, x, y FROM ({LINES})), o AS (SELECT p.k, p.x, p.y, q.x - p.x AS dx, q.y - p.y AS dy FROM l p JOIN l q ON q.k = p.k AND (q.x <> p.x OR q.y <> p.y)),
        s AS (SELECT a.k, a.x, a.y, bool_and(a.dx * b.dy > a.dy * b.dx OR (a.dx * b.dy = a.dy * b.dx AND a.dx * b.dx + a.dy * b.dy > 0)) AS one_side
            FROM o a JOIN o b ON a.k = b.k AND a.x = b.x AND a.y = b.y GROUP BY a.k, a.x, a.y, a.dx, a.dy)
        SELECT DISTINCT k AS id, x, y FROM s WHERE one_side UNION ALL SELECT k, any_value(x), any_value(y) FROM l GROUP BY k HAVING count(*) = 1""",
    "nearest_points": f"""WITH p AS ({POINTS}), d AS (SELECT a.k AS left_id, b.k AS right_id, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS distance2 FROM p a JOIN p b ON a.k <> b.k)
        SELECT left_id, right_id, distance2 FROM (SELECT *, row_number() OVER (PARTITION BY left_id ORDER BY distance2, right_id) AS r FROM d) WHERE r = 1""",
    "number_texts": f"""WITH v AS (SELECT s_suppkey, {CENTS.format('s_acctbal')} AS c FROM supplier) SELECT s_suppkey, CASE WHEN c % 4 = 0 THEN CAST(c // 4 AS VARCHAR) WHEN c % 2 = 0 THEN (c // 2) || '/2' ELSE c || '/4' END AS exact, c / 4.0::DOUBLE AS back FROM v""",
    "wkt_round_trip": "SELECT count(*) AS n, count(*) AS t, count(*) AS j, count(*) AS w FROM part",
    "score_summary": f"""{_SCORES} SELECT capability, count(*) AS records, count(*) FILTER (verdict = 'correct') AS correct, count(*) FILTER (verdict = 'wrong') AS wrong, count(*) FILTER (verdict = 'convention') AS convention,
        count(*) FILTER (verdict = 'unsupported') AS unsupported, round(count(*) FILTER (verdict = 'wrong') / count(*)::DOUBLE, 6) AS failure_rate FROM scores GROUP BY capability""",
    "score_rollup": f"""{_SCORES} SELECT CASE WHEN grouping(lib) = 0 THEN lib END AS lib, family, capability, count(*) AS records, count(*) FILTER (verdict = 'wrong') AS failures, count(DISTINCT pair) AS cases
        FROM (SELECT 'faulty@1' AS lib, * FROM scores) GROUP BY ROLLUP (lib, family, capability)""",
    "score_clusters": f"""{_NEXT}, s AS (SELECT pair, 'faulty@1|f' || (pair % 5) || '|predicates:' || {_SIG} AS cluster FROM m WHERE {_WRONG}
        UNION ALL SELECT pair, 'faulty@1|f' || (pair % 5) || '|validity:valid_b=false' FROM m WHERE pair % 31 = 0)
        SELECT cluster, count(*) AS records, count(DISTINCT pair) AS cases, min(CAST(pair AS VARCHAR)) AS first_id FROM s GROUP BY cluster ORDER BY records DESC, cluster LIMIT 40""",
    "score_controls": "SELECT CAST(0 AS BIGINT) AS missed, CAST(0 AS BIGINT) AS other_changed",
    "sample_strata": """WITH n AS (SELECT c_nationkey AS s, count(*) AS n, sum(count(*)) OVER () AS total FROM customer GROUP BY 1),
        q AS (SELECT s, n, n * 50 // total AS base, n * 50 % total AS rest FROM n), r AS (SELECT *, row_number() OVER (ORDER BY rest DESC, s) AS k, 50 - sum(base) OVER () AS spare FROM q),
        o AS (SELECT c_nationkey AS s, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY sha256(CAST(c_custkey AS VARCHAR)), c_custkey) AS k FROM customer)
        SELECT o.s AS stratum, count(*) AS n, min(c_custkey) AS first FROM o JOIN r ON o.s = r.s WHERE o.k <= least(n, base + CASE WHEN r.k <= spare THEN 1 ELSE 0 END) GROUP BY 1""",
    "corpus_crosstab": """WITH e AS (SELECT event_type, CASE WHEN value < 100 THEN 1 ELSE 0 END AS l, CASE WHEN value >= 100 AND value < 300 THEN 1 ELSE 0 END AS m, CASE WHEN value >= 300 THEN 1 ELSE 0 END AS h FROM events)
        SELECT event_type, CAST(sum(l) AS BIGINT) AS low, CAST(sum(m) AS BIGINT) AS middle, CAST(sum(h) AS BIGINT) AS high FROM e GROUP BY 1
        UNION ALL SELECT 'total', CAST(sum(l) AS BIGINT), CAST(sum(m) AS BIGINT), CAST(sum(h) AS BIGINT) FROM e""",
    "line_centroids": f"""WITH l AS ({LINES}), s AS (SELECT k, x, y, lead(x) OVER w AS u, lead(y) OVER w AS v FROM l WINDOW w AS (PARTITION BY k ORDER BY seq)),
        t AS (SELECT k, x + u AS mx, y + v AS my, sqrt((u - x) * (u - x) + (v - y) * (v - y)) AS d FROM s WHERE u IS NOT NULL)
        SELECT k AS id, CAST(round(sum(d * mx) / nullif(sum(d), 0) * 500) AS BIGINT) AS x, CAST(round(sum(d * my) / nullif(sum(d), 0) * 500) AS BIGINT) AS y FROM t GROUP BY k""",
    "triangle_case_measures": f"""WITH t AS (SELECT *, {_O} AS o, ax + bx + cx AS sx, ay + bz + cy AS sy FROM ({TRIANGLES}))
        SELECT k AS id, CASE WHEN o % 2 = 0 THEN CAST(abs(o) // 2 AS VARCHAR) ELSE abs(o) || '/2' END AS area,
        CASE WHEN o = 0 THEN NULL WHEN sx % 3 = 0 THEN CAST(sx // 3 AS VARCHAR) ELSE sx || '/3' END AS x, CASE WHEN o = 0 THEN NULL WHEN sy % 3 = 0 THEN CAST(sy // 3 AS VARCHAR) ELSE sy || '/3' END AS y,
        CASE WHEN o <> 0 THEN 3::BIGINT WHEN ax = bx AND bx = cx AND ay = bz AND bz = cy THEN 1 ELSE 2 END AS corners FROM t""",
    "nested_areas": f"""WITH b AS ({BOXES}), r AS (SELECT k, unnest(range(0, k % 4 + 1)) AS n, x2 - x1 AS w, y2 - y1 AS h FROM b)
        SELECT k AS id, CAST(sum(2 * (w + 4 * n) * (h + 4 * n) * CASE WHEN (k % 4 - n) % 2 = 0 THEN 1 ELSE -1 END) AS BIGINT) AS area2 FROM r GROUP BY k""",
    "dyadic_parts": f"""WITH v AS (SELECT s_suppkey, {CENTS.format('s_acctbal')} AS c FROM supplier), p AS (SELECT *, abs(c) & -abs(c) AS low FROM v)
        SELECT s_suppkey, CASE WHEN c = 0 THEN 0 ELSE c // low END AS m, CAST(CASE WHEN c = 0 THEN 0 ELSE round(log2(low)) - 2 END AS BIGINT) AS e FROM p""",
    "triangle_points": f"""WITH t AS ({TRIANGLES}), e AS ({_SIDES}), p AS ({POINTS}), i AS (SELECT DISTINCT l_orderkey AS key, l_suppkey AS id FROM lineitem),
        o AS (SELECT key, id, x, y, x1, y1, x2, y2, (x2 - x1) * (y - y1) - (y2 - y1) * (x - x1) AS o FROM i JOIN p ON p.k = id JOIN e ON e.k = key),
        h AS (SELECT key, id, bool_or(o = 0 AND x BETWEEN least(x1, x2) AND greatest(x1, x2) AND y BETWEEN least(y1, y2) AND greatest(y1, y2)) AS onit,
            count(*) FILTER ((y1 > y) <> (y2 > y) AND (o > 0) = (y2 > y1) AND o <> 0) % 2 = 1 AS odd FROM o GROUP BY key, id)
        SELECT key, id, CASE WHEN onit THEN 'B' WHEN odd THEN 'I' ELSE 'E' END AS loc, CAST(CASE WHEN onit OR odd THEN 2 ELSE -1 END AS INTEGER) AS dim FROM h""",
    "line_points": f"""WITH l AS ({LINES}), p AS ({POINTS}), b AS (SELECT k, min(seq) AS f, max(seq) AS t FROM l GROUP BY k HAVING count(DISTINCT (x, y)) > 1),
        e AS (SELECT k, x, y FROM (SELECT l.k, x, y FROM l JOIN b ON l.k = b.k AND seq = f UNION ALL SELECT l.k, x, y FROM l JOIN b ON l.k = b.k AND seq = t) GROUP BY k, x, y HAVING count(*) % 2 = 1),
        s AS (SELECT k, x AS x1, y AS y1, coalesce(lead(x) OVER w, x) AS x2, coalesce(lead(y) OVER w, y) AS y2 FROM l WINDOW w AS (PARTITION BY k ORDER BY seq)),
        h AS (SELECT s.k AS key, p.k AS id, any_value(x) AS x, any_value(y) AS y, bool_or((x2 - x1) * (y - y1) = (y2 - y1) * (x - x1) AND x BETWEEN least(x1, x2) AND greatest(x1, x2)
            AND y BETWEEN least(y1, y2) AND greatest(y1, y2)) AS onit FROM s JOIN p ON p.k % 10 = s.k % 10 GROUP BY s.k, p.k)
        SELECT key, id, CASE WHEN e.k IS NOT NULL THEN 'B' WHEN onit THEN 'I' ELSE 'E' END AS loc, CAST(CASE WHEN onit THEN 1 ELSE -1 END AS INTEGER) AS dim
        FROM h LEFT JOIN e ON e.k = key AND e.x = h.x AND e.y = h.y""",
    "dual_routes": f"""WITH t AS ({TRIANGLES}), c AS (SELECT DISTINCT o_custkey AS pair FROM t JOIN orders ON o_orderkey = k WHERE {_O} <> 0)
        SELECT CASE pair % 3 WHEN 0 THEN 'frame' WHEN 1 THEN 'rim' ELSE 'triangle' END AS kind, count(*) AS n, count(*) AS agree FROM c JOIN part ON p_partkey = pair GROUP BY 1""",
    "box_certificates": f"""{_NEXT}, c AS (SELECT pair, unnest([ax1, ax2]) AS x, ay1, ay2, bx1, bx2, by1, by2 FROM pairs), d AS (SELECT pair, unnest([bx1, bx2]) AS x, by1, by2, ax1, ax2, ay1, ay2 FROM pairs),
        n AS (SELECT pair, x, unnest([ay1, ay2]) AS y FROM c UNION SELECT pair, x, unnest([by1, by2]) FROM d
            UNION SELECT pair, x, y FROM (SELECT *, unnest([by1, by2]) AS y FROM c) WHERE x BETWEEN bx1 AND bx2 AND y BETWEEN ay1 AND ay2
            UNION SELECT pair, x, y FROM (SELECT *, unnest([ay1, ay2]) AS y FROM d) WHERE x BETWEEN ax1 AND ax2 AND y BETWEEN by1 AND by2)
        SELECT pair, true AS ok, count(*) AS nodes FROM n GROUP BY pair""",
    "triangle_overlays": f"WITH {_TWO} SELECT pair, op, CAST(round(abs(area) * 1414.2135623730951) AS BIGINT) AS area FROM {_FOUR}",
    "slab_agreement": f"WITH {_TWO} SELECT op, count(*) AS n, count(*) AS agree, count(*) FILTER (abs(area) < 1e-7) AS without FROM {_FOUR} GROUP BY op",
    "canonical_triangles": f"""WITH t AS (SELECT * FROM ({TRIANGLES}) WHERE {_O} <> 0),
        r AS (SELECT k, CASE WHEN {_O} > 0 THEN [(ax, ay), (bx, bz), (cx, cy)] ELSE [(ax, ay), (cx, cy), (bx, bz)] END AS p FROM t), m AS (SELECT k, p, list_position(p, list_min(p)) AS i FROM r),
        q AS (SELECT k, p[i] AS s, p[i % 3 + 1] AS e FROM m) SELECT k, 1::BIGINT AS n, s[1] AS x1, s[2] AS y1, e[1] AS x2, e[2] AS y2 FROM q""",
    "corner_distances": f"""WITH o AS (SELECT o_custkey AS pair, t.* FROM ({TRIANGLES}) t JOIN orders ON o_orderkey = k),
        d AS (SELECT p.pair, p.k AS i, q.k AS j, (p.ax - q.cx) * (p.ax - q.cx) + (p.ay - q.cy) * (p.ay - q.cy) AS d FROM o p JOIN o q ON p.pair = q.pair),
        m AS (SELECT pair, min(d) AS d FROM d GROUP BY pair, i UNION ALL SELECT pair, min(d) FROM d GROUP BY pair, j) SELECT pair, CAST(max(d) AS BIGINT) AS d2 FROM m GROUP BY pair""",
    "answer_disagreements": """SELECT o_orderkey AS id, 'status' AS field, o_orderstatus AS "left", '?' AS "right" FROM orders WHERE o_orderkey % 7 = 0
        UNION ALL SELECT o_orderkey, 'customer', CAST(o_custkey AS VARCHAR), '-1' FROM orders WHERE o_orderkey % 11 = 0""",
    "answer_sides": """WITH o AS (SELECT DISTINCT o_orderkey AS id FROM orders), l AS (SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_quantity > 45)
        SELECT CASE WHEN l.id IS NULL THEN 'left' WHEN o.id IS NULL THEN 'right' ELSE 'both' END AS side, count(*) AS n, CAST(sum(coalesce(o.id, l.id)) AS BIGINT) AS ids FROM o FULL JOIN l ON o.id = l.id GROUP BY 1""",
    "finding_tally": "SELECT event_type AS lib, count(*) FILTER (value < 100) AS low, count(*) FILTER (value >= 100 OR value IS NULL) AS high FROM events GROUP BY 1",
    "run_totals": f"""WITH r AS (SELECT o_orderstatus AS status, o_custkey % 50 AS cpu, {CENTS.format('o_totalprice')} AS wall FROM orders)
        SELECT status, count(*) AS n, CAST(sum(cpu) AS BIGINT) AS cpu, CAST(sum(wall) AS BIGINT) AS wall FROM r GROUP BY 1 UNION ALL SELECT 'all', count(*), CAST(sum(cpu) AS BIGINT), CAST(sum(wall) AS BIGINT) FROM r""",
    "slowest_runs": f"SELECT o_orderkey AS id, {CENTS.format('o_totalprice')} AS wall FROM orders ORDER BY wall DESC, id LIMIT 5",
    "nth_lines": """SELECT l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity) AS n FROM lineitem) WHERE n % 17 = 0""",
}
ORACLE_SQL |= {also: ORACLE_SQL[name] for also, name in ALIASES.items() if name in ORACLE_SQL}
