"""Queries on a mesh: `customer` as a sheet of square cells.

Customers stand in rows as long as the root of their number; each is a vertex, moved a little in the plane by nation and
segment, with the balance as its height (or 0, where SQL can say what a flattened collapse gives). A cell of four
customers is two faces, turned alike. What is left over from full rows takes no part.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import intrinsic
from .plans import decimate
from .plans.iterate import cut

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def sheet(spark: SparkSession, d: str, flat: bool = False) -> tuple[DataFrame, DataFrame]:
    """(points: id, x, y, z; faces: f, a, b, c)."""
    customers = spark.read.parquet(f"{d}/customer.parquet")
    w = int(customers.count() ** 0.5)
    rows = customers.agg(F.count("*")).first()[0] // max(w, 1)
    id_ = F.col("c_custkey").cast("long")
    height = F.lit(0.0) if flat else F.col("c_acctbal") / 5000
    place = [(id_ % w + (F.col("c_nationkey") - 12) * F.lit(0.012)).alias("x"), (F.floor(id_ / w) + (F.length("c_mktsegment") - 9) * F.lit(0.05)).alias("y"), height.alias("z")]
    points = customers.where(id_ < w * rows).select(id_.alias("id"), *place)
    at = lambda *k: [F.lit(n) + F.col("id") for n in k]
    face = lambda n, a, b, c: F.struct((2 * F.col("id") + n).alias("f"), a.alias("a"), b.alias("b"), c.alias("c"))
    cells = points.where((F.col("id") % w < w - 1) & (F.col("id") < w * (rows - 1)))
    both = F.explode(F.array(face(0, *at(0, 1, w + 1)), face(1, *at(0, w + 1, w))))
    return points, cells.select(both.alias("t")).select("t.*")


def _r(c, digits: int = 6):
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)


_SHEET = """n AS (SELECT CAST(floor(sqrt(count(*))) AS BIGINT) AS w, count(*) // CAST(floor(sqrt(count(*))) AS BIGINT) AS h FROM customer),
p AS (SELECT CAST(c_custkey AS BIGINT) AS id, c_custkey % w + (c_nationkey - 12) * 0.012::DOUBLE AS x, c_custkey // w + (length(c_mktsegment) - 9) * 0.05::DOUBLE AS y, w, h FROM customer, n WHERE c_custkey < w * h),
q AS (SELECT id, w FROM p WHERE id % w < w - 1 AND id < w * (h - 1)),
t AS (SELECT 2 * id AS f, id AS a, id + 1 AS b, id + w + 1 AS c FROM q UNION ALL SELECT 2 * id + 1, id, id + w + 1, id + w FROM q),
e AS (SELECT least(i, j) AS a, greatest(i, j) AS b, count(*) AS faces FROM (SELECT a AS i, b AS j FROM t UNION ALL SELECT b, c FROM t UNION ALL SELECT c, a FROM t) GROUP BY 1, 2),
r AS (SELECT e.*, (p.x + q.x) / 2 AS mx, (p.y + q.y) / 2 AS my, row_number() OVER (ORDER BY sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y)), a, b) AS rank FROM e JOIN p ON p.id = a JOIN p q ON q.id = b),
v AS (SELECT a AS v, rank, faces FROM r UNION ALL SELECT b, rank, faces FROM r),
here AS (SELECT v, min(rank) AS rank, min(faces) = 1 AS border FROM v GROUP BY v),
beside AS (SELECT a, b, least(x.rank, y.rank) AS rank FROM r JOIN here x ON x.v = a JOIN here y ON y.v = b),
near AS (SELECT v, min(rank) AS rank FROM (SELECT a AS v, rank FROM beside UNION ALL SELECT b, rank FROM beside) GROUP BY v),
least_ AS (SELECT r.*, x.border AS ba, y.border AS bb FROM r JOIN near m ON m.v = a JOIN near k ON k.v = b JOIN here x ON x.v = a JOIN here y ON y.v = b WHERE r.rank = m.rank AND r.rank = k.rank),
s AS (SELECT DISTINCT l.a AS ka, l.b AS kb, l.mx, l.my, ba OR bb AS border, (t.a IN (l.a, l.b))::INT + (t.b IN (l.a, l.b))::INT + (t.c IN (l.a, l.b))::INT = 2 AS twice, t.* FROM least_ l JOIN t ON l.a IN (t.a, t.b, t.c) OR l.b IN (t.a, t.b, t.c)),
g AS (SELECT s.*, p.x AS x0, p.y AS y0, q.x AS x1, q.y AS y1, o.x AS x2, o.y AS y2 FROM s JOIN p ON p.id = s.a JOIN p q ON q.id = s.b JOIN p o ON o.id = s.c),
m AS (SELECT *, CASE WHEN a IN (ka, kb) THEN mx ELSE x0 END AS u0, CASE WHEN a IN (ka, kb) THEN my ELSE y0 END AS v0, CASE WHEN b IN (ka, kb) THEN mx ELSE x1 END AS u1, CASE WHEN b IN (ka, kb) THEN my ELSE y1 END AS v1,
CASE WHEN c IN (ka, kb) THEN mx ELSE x2 END AS u2, CASE WHEN c IN (ka, kb) THEN my ELSE y2 END AS v2 FROM g),
w AS (SELECT *, ((x1 - x0) * (y2 - y0) - (y1 - y0) * (x2 - x0)) / 2 AS before, CASE WHEN NOT twice THEN ((u1 - u0) * (v2 - v0) - (v1 - v0) * (u2 - u0)) / 2 END AS after,
(u1 - u0) ** 2 + (v1 - v0) ** 2 + (u2 - u1) ** 2 + (v2 - v1) ** 2 + (u0 - u2) ** 2 + (v0 - v2) ** 2 AS squares FROM m),
common AS (SELECT l.a, l.b, count(*) AS n FROM least_ l JOIN (SELECT a AS i, b AS j FROM e UNION ALL SELECT b, a FROM e) x ON x.i = l.a JOIN (SELECT a AS i, b AS j FROM e UNION ALL SELECT b, a FROM e) y ON y.i = l.b AND y.j = x.j GROUP BY 1, 2),
fine AS (SELECT l.a, l.b, l.mx, l.my FROM least_ l JOIN common USING (a, b) WHERE common.n = l.faces AND NOT (ba AND bb AND l.faces = 2) AND (l.a, l.b) IN (SELECT (ka, kb) FROM w GROUP BY ka, kb
HAVING count(after) > 0 AND min(before) > 0.5e-10 AND min(after) > 0.5e-10 AND min(CASE WHEN after IS NOT NULL AND border THEN 4 * sqrt(3) * after / squares ELSE 1 END) >= 0.3))"""


def _first_round(spark, d):
    points, faces = sheet(spark, d, flat=True)
    fat = cut(decimate.graph.corners(faces, points))
    edges = decimate._midpoints(fat).withColumn("rank", F.struct("cost", "a", "b"))
    return points, faces, cut(decimate.patches(decimate.local_minima(edges), fat).where("refused is null").withColumn("step", F.lit(0)))


@query("collapse_round", f"WITH {_SHEET} SELECT a, b, round(mx, 6) AS x, round(my, 6) AS y FROM fine")
def collapse_round(spark, d):
    """The edges that the first round takes, and where their vertex goes."""
    return _first_round(spark, d)[2].select("a", "b", _r("x").alias("x"), _r("y").alias("y"))


@query("joint_flattening", f"WITH {_SHEET} SELECT ka AS a, kb AS b, f, round(before, 6) AS pre, round(after, 6) AS post FROM w WHERE (ka, kb) IN (SELECT (a, b) FROM fine)")
def joint_flattening(spark, d):
    """Areas in the plane of the faces around each collapse, on both sides; of a flat sheet they are the faces' own."""
    log = _first_round(spark, d)[2]

    def areas(side: str) -> DataFrame:
        t = log.select("a", "b", F.explode(side).alias("t"))
        u = lambda k: F.col("t.uv")[k]
        area = ((u(2) - u(0)) * (u(5) - u(1)) - (u(3) - u(1)) * (u(4) - u(0))) / 2
        return t.select("a", "b", F.col("t.f").alias("f"), _r(area).alias(side))

    return areas("pre").join(areas("post"), ["a", "b", "f"], "left")


_CELLS = """c AS (SELECT q.id AS ia, q.id + 1 AS ib, q.id + q.w + 1 AS ic, q.id + q.w AS id, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS "by", c.x AS cx, c.y AS cy, d.x AS dx, d.y AS dy
FROM q JOIN p a ON a.id = q.id JOIN p b ON b.id = q.id + 1 JOIN p c ON c.id = q.id + q.w + 1 JOIN p d ON d.id = q.id + q.w),
o AS (SELECT *, ((ax - bx) * (cx - bx) + (ay - "by") * (cy - "by")) / abs((ax - bx) * (cy - "by") - (ay - "by") * (cx - bx)) + ((ax - dx) * (cx - dx) + (ay - dy) * (cy - dy)) / abs((ax - dx) * (cy - dy) - (ay - dy) * (cx - dx)) >= -1e-10 AS keep FROM c),
dt AS (SELECT unnest(CASE WHEN keep THEN [[ia, ib, ic], [ia, ic, id]] ELSE [[ia, ib, id], [ib, ic, id]] END) AS t FROM o),
k AS (SELECT t[1] AS p, t[2] AS i, t[3] AS j FROM dt UNION ALL SELECT t[2], t[3], t[1] FROM dt UNION ALL SELECT t[3], t[1], t[2] FROM dt),
u AS (SELECT i, j, ((a.x - o.x) * (b.x - o.x) + (a.y - o.y) * (b.y - o.y)) AS inner_, abs((a.x - o.x) * (b.y - o.y) - (a.y - o.y) * (b.x - o.x)) AS twice, k.p AS corner FROM k JOIN p o ON o.id = k.p JOIN p a ON a.id = k.i JOIN p b ON b.id = k.j)"""


@query(
    "robust_laplacian",
    f"WITH {_SHEET}, {_CELLS}, e2 AS (SELECT i, j, inner_ / twice / 2 AS w FROM u), z AS (SELECT i, i AS j, w AS v FROM e2 UNION ALL SELECT j, j, w FROM e2 UNION ALL SELECT i, j, -w FROM e2 UNION ALL SELECT j, i, -w FROM e2) "
    "SELECT i, j, round(sum(v), 5) + 0.0 AS v FROM z GROUP BY i, j HAVING round(sum(v), 5) <> 0",
)
def robust_laplacian(spark, d):
    """Of the flat sheet, where flips turn the diagonals that are not the better ones."""
    stiff, _ = intrinsic.robust_laplacian(*sheet(spark, d, flat=True), least=0.0)
    return stiff.select("i", "j", _r("v", 5).alias("v")).where("v <> 0")


@query("robust_mass", f"WITH {_SHEET}, {_CELLS} SELECT corner AS i, round(sum(twice) / 6, 6) AS v FROM u GROUP BY corner")
def robust_mass(spark, d):
    _, mass = intrinsic.robust_laplacian(*sheet(spark, d, flat=True), least=0.0)
    return mass.select("i", _r("v").alias("v"))


@query("point_laplacian")
def point_laplacian(spark, d):
    """Of the sheet's points alone."""
    return intrinsic.point_laplacian(sheet(spark, d)[0])[0]


_TRACE = """k AS (SELECT unnest([a, b]) AS id, a, b FROM fine),
h AS (SELECT k.id, w.f, CASE WHEN w.a = kb THEN ka ELSE w.a END AS c0, CASE WHEN w.b = kb THEN ka ELSE w.b END AS c1, CASE WHEN w.c = kb THEN ka ELSE w.c END AS c2,
((u1 - u0) * (v2 - v0) - (u2 - u0) * (v1 - v0)) AS det, ((p.x - u0) * (v2 - v0) - (u2 - u0) * (p.y - v0)) AS d1, ((u1 - u0) * (p.y - v0) - (p.x - u0) * (v1 - v0)) AS d2 FROM k JOIN p ON p.id = k.id JOIN w ON ka = k.a AND kb = k.b AND after IS NOT NULL),
j AS (SELECT id, f, [c0, c1, c2] AS c, [1 - d1 / det - d2 / det, d1 / det, d2 / det] AS wt FROM h),
best AS (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(list_min(wt), 9) DESC, f) = 1),
z AS (SELECT id AS i, unnest(c) AS j, greatest(unnest(wt), 0.0) AS w FROM best),
y AS (SELECT i, j, w / sum(w) OVER (PARTITION BY i) AS w FROM z)"""


@query("trace_round", f"WITH {_SHEET}, {_TRACE} SELECT i, j, round(sum(w), 6) AS w FROM (SELECT i, j, w FROM y UNION ALL SELECT id, id, 1.0 FROM p WHERE id NOT IN (SELECT id FROM k)) GROUP BY 1, 2 HAVING round(sum(w), 6) > 0")
def trace_round(spark, d):
    """Weights of all vertices after the first round, through the log."""
    points, faces, log = _first_round(spark, d)
    fresh = log.select(F.explode("post").alias("t")).select("t.f", "t.a", "t.b", "t.c")
    coarse = faces.join(log.select(F.explode("pre.f").alias("f")), "f", "left_anti").select("f", "a", "b", "c").unionByName(fresh)
    weights = decimate.traced_weights(decimate.trace_points(points, faces, coarse, log))
    return weights.select("i", "j", _r("w").alias("w")).where("w > 0")


def _decimated(spark, d):
    points, faces = sheet(spark, d)
    return points, faces, *decimate.decimate(points, faces, faces.count() // 4)


@query("decimate_rounds")
def decimate_rounds(spark, d):
    """The log of collapses until a quarter of the faces is left."""
    return _decimated(spark, d)[-1].select("step", "a", "b", "cost", "x", "y", "z")


@query("trace_points")
def trace_points(spark, d):
    """Every vertex on the faces that are left."""
    points, faces, _, coarse, log = _decimated(spark, d)
    return decimate.trace_points(points, faces, coarse, log)
