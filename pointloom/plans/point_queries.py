"""Queries over points: normalisation, rotation, neighbour graphs, geodesics, features, parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import geometry as G
from ..operators import features as feat, graph, normalize as nrm, parts
from . import views as V
from .views import r

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _xyz(df: DataFrame, *more: str, digits: int = 6) -> DataFrame:
    return df.select("shape_id", "point_idx", *more, *(r(F.col(c), digits).alias(c) for c in "xyz"))


_BOX = f"""WITH {V.POINTS}, box AS (SELECT shape_id, min(x) AS lx, min(y) AS ly, min(z) AS lz, {{hi}} FROM points GROUP BY shape_id),
b AS (SELECT p.*, lx, ly, lz, hx, hy, hz, (hx+lx)/2 AS mx, (hy+ly)/2 AS my, (hz+lz)/2 AS mz, sqrt((hx-lx)*(hx-lx)+(hy-ly)*(hy-ly)+(hz-lz)*(hz-lz)) AS d FROM points p JOIN box USING (shape_id))"""
_HI = "max(x) AS hx, max(y) AS hy, max(z) AS hz"
_HI_COMPAT = ", ".join(f"greatest(max({a}), {G.SMALLEST!r}) AS h{a}" for a in "xyz")
_NORMAL = """ SELECT shape_id, point_idx, round((x-mx)/d, 6)+0.0 AS x, round((y-my)/d, 6)+0.0 AS y, round((z-mz+(hz-lz)/2)/d, 6)+0.0 AS z FROM b"""


@query(_BOX.format(hi=_HI) + _NORMAL)
def normalize_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _xyz(nrm.normalize_points(V.points(spark, sf_dir)))


@query(_BOX.format(hi=_HI_COMPAT) + _NORMAL)
def normalize_points_compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _xyz(nrm.normalize_points(V.points(spark, sf_dir), compat=True))


@query(_BOX.format(hi=_HI) + """ SELECT shape_id, point_idx, round((x-mx)/d, 6)+0.0 AS x, round((y-my)/d, 6)+0.0 AS y, round((z-mz)/d-(lz-mz)/d, 6)+0.0 AS z FROM b""")
def normalize_lifted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _xyz(nrm.normalize_lifted(V.points(spark, sf_dir)))


@query(_BOX.format(hi=_HI) + """, s AS (SELECT shape_id, 2*max(sqrt((x-mx)*(x-mx)+(y-my)*(y-my)+(z-mz)*(z-mz))) AS span FROM b GROUP BY 1)
SELECT shape_id, point_idx, round((x-mx)/span, 6)+0.0 AS x, round((y-my)/span, 6)+0.0 AS y, round((z-mz+(hz-lz)/2)/span, 6)+0.0 AS z FROM b JOIN s USING (shape_id)""")
def normalize_mesh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _xyz(nrm.normalize_mesh(V.points(spark, sf_dir)))


@query(_BOX.format(hi=_HI) + """ SELECT DISTINCT shape_id, round(lx, 6)+0.0 AS lo_x, round(ly, 6)+0.0 AS lo_y, round(lz, 6)+0.0 AS lo_z, round(hx, 6)+0.0 AS hi_x, round(hy, 6)+0.0 AS hi_y, round(hz, 6)+0.0 AS hi_z, round(d, 6)+0.0 AS diagonal FROM b""")
def bounding_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = nrm.bounding_box(V.points(spark, sf_dir))
    return b.select("shape_id", *(r(F.col(c)).alias(c) for c in b.columns if c != "shape_id"), r(G.norm(tuple(F.col(f"hi_{a}") - F.col(f"lo_{a}") for a in "xyz"))).alias("diagonal"))


def _turn_sql(m) -> str:
    return f"WITH {V.POINTS} SELECT shape_id, point_idx, " + ", ".join(f"round(({a!r})*x+({b!r})*y+({c!r})*z, 6)+0.0 AS {n}" for (a, b, c), n in zip(m, "xyz", strict=True)) + " FROM points"


@query(_turn_sql(G.rotation((0.6, 0.0, 0.8), 30.0)))
def rotate_axis_angle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _xyz(nrm.rotate_axis_angle(V.points(spark, sf_dir), axis=(0.6, 0.0, 0.8), degrees=30.0))


@query(_turn_sql(nrm.UPRIGHT))
def rotate_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _xyz(nrm.rotate_fixed(V.points(spark, sf_dir)))


@query(f"WITH {V.POINTS} SELECT shape_id, point_idx, round(2*(x+0.5), 6)+0.0 AS x, round(2*(y-0.25), 6)+0.0 AS y, round(2*(z+1), 6)+0.0 AS z FROM points")
def translate_rescale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _xyz(nrm.rescale(nrm.translate(V.points(spark, sf_dir), (0.5, -0.25, 1.0)), 2.0))


@query(f"WITH {V.POINTS} SELECT shape_id, point_idx, round(z - min(z) OVER (PARTITION BY shape_id), 6)+0.0 AS height FROM points")
def height(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nrm.heights(V.points(spark, sf_dir)).select("shape_id", "point_idx", r(F.col("height")).alias("height"))


# ---------------------------------------------------------------------------------------------- graphs


@query(f"WITH {V.POINTS}, {V.KNN} SELECT shape_id, i, j, round(w, 6)+0.0 AS w FROM edges")
def knn_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.knn_edges(V.points(spark, sf_dir)).select("shape_id", "i", "j", r(F.col("w")).alias("w"))


@query(f"WITH {V.POINTS}, {V.KNN} SELECT shape_id, u AS point_idx, count(*) AS degree, round(sum(w), 5)+0.0 AS total_w FROM und GROUP BY 1, 2")
def knn_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degrees(graph.knn_edges(V.points(spark, sf_dir))).select("shape_id", "point_idx", "degree", r(F.col("total_w"), 5).alias("total_w"))


@query(f"WITH {V.POINTS}, {V.KNN} SELECT shape_id, u AS point_idx, array_to_string(list(v ORDER BY v), ' ') AS neighbours FROM und GROUP BY 1, 2")
def adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.adjacency(graph.knn_edges(V.points(spark, sf_dir))).select("shape_id", "point_idx", F.array_join(F.col("neighbours").cast("array<string>"), " ").alias("neighbours"))


@query(f"""WITH {V.POINTS}, p AS (SELECT a.shape_id, a.point_idx AS i, b.point_idx AS j, sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)) AS d FROM points a JOIN points b USING (shape_id) WHERE a.point_idx <> b.point_idx)
SELECT shape_id, i, j, round(d, 6)+0.0 AS d FROM p WHERE d < 0.1""")
def radius_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.radius_pairs(V.points(spark, sf_dir), 0.1).select("shape_id", "i", "j", r(F.col("d")).alias("d"))


@query(f"""WITH RECURSIVE {V.POINTS}, {V.KNN}, {V.GEODESIC()} SELECT shape_id, src, dst, round(d, 6)+0.0 AS d FROM nbrs""")
def geodesic_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("shape_id", "src", "dst", r(F.col("d")).alias("d"))


def _pairs(spark: SparkSession, sf_dir: str, radius: float = 1.3) -> DataFrame:
    return graph.geodesics(graph.knn_edges(V.points(spark, sf_dir)), radius)


@query(f"""WITH RECURSIVE {V.POINTS}, {V.KNN}, {V.GEODESIC("1e300")}, n AS (SELECT shape_id, count(*) AS n FROM points GROUP BY 1), d AS (SELECT shape_id, max(d) AS far, count(*) AS k FROM nbrs GROUP BY 1)
SELECT n.shape_id, round(CASE WHEN coalesce(k, 0) = n * (n - 1) THEN coalesce(far, 0) END, 6)+0.0 AS diameter FROM n LEFT JOIN d USING (shape_id)""")
def graph_diameter(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = V.points(spark, sf_dir)
    return graph.diameter(graph.all_distances(graph.knn_edges(p)), p).select("shape_id", r(F.col("diameter")).alias("diameter"))


_NEAREST = """SELECT shape_id, src, dst, CAST(rank AS INTEGER) AS rank, round(d, 6)+0.0 AS d FROM (SELECT *, row_number() OVER (PARTITION BY shape_id, src ORDER BY {o}, dst) AS rank FROM nbrs) WHERE rank <= 5"""


@query(f"WITH RECURSIVE {V.POINTS}, {V.KNN}, {V.GEODESIC()} " + _NEAREST.format(o="d"))
def nearest_by_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.nearest_by_path(_pairs(spark, sf_dir), 5).select("shape_id", "src", "dst", "rank", r(F.col("d")).alias("d"))


@query(f"WITH RECURSIVE {V.POINTS}, {V.KNN}, {V.GEODESIC()} " + _NEAREST.format(o="d DESC"))
def farthest_by_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.nearest_by_path(_pairs(spark, sf_dir), 5, compat=True).select("shape_id", "src", "dst", "rank", r(F.col("d")).alias("d"))


@query(f"""WITH RECURSIVE {V.POINTS}, {V.KNN}, {V.GEODESIC()}, want AS (SELECT shape_id, point_idx AS src, (7 * point_idx + 3) % 125 AS dst FROM points)
SELECT w.shape_id, w.src, w.dst, round(CASE WHEN w.src = w.dst THEN 0 ELSE d END, 6)+0.0 AS d FROM want w LEFT JOIN nbrs n ON n.shape_id = w.shape_id AND n.src = w.src AND n.dst = w.dst""")
def path_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    want = V.points(spark, sf_dir).select("shape_id", F.col("point_idx").alias("src"), ((7 * F.col("point_idx") + 3) % 125).alias("dst"))
    return graph.distance_of(_pairs(spark, sf_dir), want).select("shape_id", "src", "dst", r(F.col("d")).alias("d"))


_REACH = """, reach(shape_id, u, v) AS (SELECT shape_id, point_idx, point_idx FROM points UNION SELECT r.shape_id, r.u, e.v FROM reach r JOIN und e ON e.shape_id = r.shape_id AND e.u = r.v),
least AS (SELECT shape_id, u, min(v) AS low FROM reach GROUP BY 1, 2)"""


@query(f"WITH RECURSIVE {V.POINTS}, {V.KNN}{_REACH} SELECT shape_id, u AS point_idx, CAST(dense_rank() OVER (PARTITION BY shape_id ORDER BY low) - 1 AS INTEGER) AS component FROM least")
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = V.points(spark, sf_dir)
    return graph.components(p, graph.knn_edges(p))


@query(f"""WITH {V.POINTS}, {V.KNN}, m AS (SELECT shape_id, u AS point_idx, bool_and(a.z < b.z) AS is_min, bool_and(a.z >= b.z) AS is_max FROM und e JOIN points a USING (shape_id) JOIN points b USING (shape_id) WHERE a.point_idx = e.u AND b.point_idx = e.v GROUP BY 1, 2) SELECT * FROM m""")
def local_extrema(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = V.points(spark, sf_dir)
    return graph.local_extrema(p.select("shape_id", "point_idx", F.col("z").alias("value")), graph.knn_edges(p))


@query(f"""WITH {V.POINTS}, {V.KNN}, ring AS (SELECT shape_id, u, v FROM und UNION SELECT a.shape_id, a.u, b.v FROM und a JOIN und b ON b.shape_id = a.shape_id AND b.u = a.v)
SELECT shape_id, u AS point_idx, bool_and(a.z < b.z) AS is_min, bool_and(a.z >= b.z) AS is_max FROM ring e JOIN points a USING (shape_id) JOIN points b USING (shape_id) WHERE a.point_idx = e.u AND b.point_idx = e.v AND u <> v GROUP BY 1, 2""")
def local_extrema_two_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = V.points(spark, sf_dir)
    return graph.local_extrema(p.select("shape_id", "point_idx", F.col("z").alias("value")), graph.knn_edges(p), 2)


# ---------------------------------------------------------------------------------------------- features

_SECOND = f"""WITH RECURSIVE {V.POINTS}, {V.KNN}, {V.GEODESIC()}, m AS (SELECT o.shape_id, o.src AS point_idx, avg(x*x) AS a, avg(x*y) AS b, avg(x*z) AS c, avg(y*y) AS d, avg(y*z) AS e, avg(z*z) AS f, var_pop(z) AS zv
  FROM (SELECT shape_id, point_idx AS src FROM points) o LEFT JOIN (SELECT shape_id, src, dst FROM nbrs WHERE d < {{radius}}) n USING (shape_id, src) LEFT JOIN points p ON p.shape_id = o.shape_id AND p.point_idx = n.dst GROUP BY 1, 2)"""


def _hood(spark: SparkSession, sf_dir: str, radius: float) -> DataFrame:
    """All points; null where none is near."""
    p = V.points(spark, sf_dir)
    return p.select("shape_id", "point_idx").join(feat.neighbourhoods(_pairs(spark, sf_dir), p, (radius,)), ["shape_id", "point_idx"], "left")


@query(_SECOND.format(radius=0.3) + f", {V.eig()} SELECT shape_id, point_idx, round(l2/l1, 5)+0.0 AS e2, round(l3/l1, 5)+0.0 AS e3 FROM eig")
def eig_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hood(spark, sf_dir, 0.3).select("shape_id", "point_idx", r(F.col("e2_0"), 5).alias("e2"), r(F.col("e3_0"), 5).alias("e3"))


@query(_SECOND.format(radius=0.3) + f", {V.eig()}, {V.eigenvector('l1', 'eig', 'v')}, {V.eigenvector('l3', '(SELECT * RENAME (ex AS fx, ey AS fy, ez AS fz) FROM v)', 'w')} SELECT shape_id, point_idx, CASE WHEN a IS NOT NULL THEN round(CASE WHEN l1 - l2 > 1e-3 * l1 THEN abs(fy) ELSE 0 END, 4)+0.0 END AS g1, CASE WHEN a IS NOT NULL THEN round(CASE WHEN l2 - l3 > 1e-3 * l1 THEN abs(ey) ELSE 0 END, 4)+0.0 END AS g3 FROM w")
def gravity_abs(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = _hood(spark, sf_dir, 0.3)
    return h.select("shape_id", "point_idx", r(F.col("g1_0"), 4).alias("g1"), r(F.col("g3_0"), 4).alias("g3"))


@query(_SECOND.format(radius=0.2) + " SELECT shape_id, point_idx, round(zv, 6)+0.0 AS z_variance FROM m")
def z_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hood(spark, sf_dir, 0.2).select("shape_id", "point_idx", r(F.col("zv_0")).alias("z_variance"))


def _normals_sql(radius: float) -> str:
    """A table nrm of all points with nx, ny, nz (null where there is no normal)."""
    return f"""nm AS (SELECT a.shape_id, a.point_idx, any_value(a.x) AS px, any_value(a.y) AS py, any_value(a.z) AS pz, count(*) AS n, covar_pop(b.x, b.x) AS a, covar_pop(b.x, b.y) AS b, covar_pop(b.x, b.z) AS c, covar_pop(b.y, b.y) AS d, covar_pop(b.y, b.z) AS e, covar_pop(b.z, b.z) AS f
  FROM points a JOIN points b ON b.shape_id = a.shape_id AND (a.point_idx = b.point_idx OR sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)) < {radius}) GROUP BY 1, 2),
{V.eig("nm").replace("q0 AS", "nq0 AS").replace("q1 AS", "nq1 AS").replace("q2 AS", "nq2 AS").replace("q3 AS", "nq3 AS").replace("eig AS", "neig AS").replace("FROM q", "FROM nq")}, {V.eigenvector('l3', 'neig', 'nv')},
nrm AS (SELECT shape_id, point_idx, CASE WHEN n >= 3 AND l2 - l3 > 1e-3 * l1 THEN CASE WHEN ex*px+ey*py+ez*pz > 0 THEN -ex ELSE ex END END AS nx, CASE WHEN n >= 3 AND l2 - l3 > 1e-3 * l1 THEN CASE WHEN ex*px+ey*py+ez*pz > 0 THEN -ey ELSE ey END END AS ny,
  CASE WHEN n >= 3 AND l2 - l3 > 1e-3 * l1 THEN CASE WHEN ex*px+ey*py+ez*pz > 0 THEN -ez ELSE ez END END AS nz FROM nv)"""


@query(f"WITH {V.POINTS}, {_normals_sql(0.15)} SELECT shape_id, point_idx, round(nx, 3)+0.0 AS nx, round(ny, 3)+0.0 AS ny, round(nz, 3)+0.0 AS nz FROM nrm")
def normals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feat.normals(V.points(spark, sf_dir), 0.15).select("shape_id", "point_idx", *(r(F.col(c), 3).alias(c) for c in ("nx", "ny", "nz")))


@query(f"""WITH RECURSIVE {V.POINTS}, {V.KNN}, {V.GEODESIC()}, b AS (SELECT shape_id, src, CAST(floor(8*d/1.3+0.5) AS INTEGER) AS b FROM nbrs WHERE d <= 1.3)
SELECT shape_id, src AS point_idx, b AS bin, round(count(*) / sum(count(*)) OVER (PARTITION BY shape_id, src), 6)+0.0 AS share FROM b WHERE b < 8 GROUP BY shape_id, src, b""")
def geodesic_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = feat.histogram(_pairs(spark, sf_dir)).select("shape_id", "point_idx", F.posexplode("h").alias("bin", "share"))
    return h.filter("share > 0").select("shape_id", "point_idx", "bin", r(F.col("share")).alias("share"))


def _curvature_sql(radius: float) -> str:
    """Tables nrm and cv: all points with their curvature."""
    return f"""{_normals_sql(radius)}, t AS (SELECT n.shape_id, n.src, b.x-a.x AS dx, b.y-a.y AS dy, b.z-a.z AS dz FROM nbrs n JOIN points a ON a.shape_id = n.shape_id AND a.point_idx = n.src JOIN points b ON b.shape_id = n.shape_id AND b.point_idx = n.dst WHERE n.d < {radius}),
bend AS (SELECT shape_id, src, sum(dx/sqrt(dx*dx+dy*dy+dz*dz)) AS sx, sum(dy/sqrt(dx*dx+dy*dy+dz*dz)) AS sy, sum(dz/sqrt(dx*dx+dy*dy+dz*dz)) AS sz, count(*) AS n FROM t WHERE dx*dx+dy*dy+dz*dz > 0 GROUP BY 1, 2),
cv AS (SELECT p.shape_id, p.point_idx, coalesce(abs(sx*nx+sy*ny+sz*nz)/n, 0) AS curvature FROM nrm p LEFT JOIN bend s ON s.shape_id = p.shape_id AND s.src = p.point_idx)"""


_MEAN = """smooth AS (SELECT c.shape_id, c.point_idx, any_value(c.curvature) AS curvature, (any_value(c.curvature) + coalesce(sum(o.curvature), 0)) / (count(o.point_idx) + 1) AS mean_curvature
  FROM cv c LEFT JOIN nbrs n ON n.shape_id = c.shape_id AND n.src = c.point_idx AND n.d < 0.3 LEFT JOIN cv o ON o.shape_id = n.shape_id AND o.point_idx = n.dst GROUP BY 1, 2)"""


def _curved(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p = V.points(spark, sf_dir)
    pairs = _pairs(spark, sf_dir)
    return pairs, feat.curvature(pairs, p, feat.normals(p, 0.15), 0.15)


@query(f"WITH RECURSIVE {V.POINTS}, {V.KNN}, {V.GEODESIC()}, {_curvature_sql(0.15)}, {_MEAN} SELECT shape_id, point_idx, round(mean_curvature, 5)+0.0 AS mean_curvature FROM smooth")
def mean_curvature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feat.mean_curvature(*_curved(spark, sf_dir)).select("shape_id", "point_idx", r(F.col("mean_curvature"), 5).alias("mean_curvature"))


@query(f"WITH RECURSIVE {V.POINTS}, {V.KNN}, {V.GEODESIC()}, {_curvature_sql(0.15)} SELECT shape_id, point_idx, round(curvature, 5)+0.0 AS curvature FROM cv")
def curvature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _curved(spark, sf_dir)[1].select("shape_id", "point_idx", r(F.col("curvature"), 5).alias("curvature"))


_UNIT = V.POINTS.replace("points AS", "raw AS", 1) + """, box AS (SELECT shape_id, min(x) AS lx, min(y) AS ly, min(z) AS lz, max(x) AS hx, max(y) AS hy, max(z) AS hz FROM raw GROUP BY 1),
box2 AS (SELECT *, (hx+lx)/2 AS mx, (hy+ly)/2 AS my, (hz+lz)/2 AS mz, sqrt((hx-lx)*(hx-lx)+(hy-ly)*(hy-ly)+(hz-lz)*(hz-lz)) AS diag FROM box),
points AS (SELECT p.shape_id, point_idx, label, (x-mx)/diag AS x, (y-my)/diag AS y, (z-mz+(hz-lz)/2)/diag AS z FROM raw p JOIN box2 USING (shape_id))"""


def _vector_sql() -> str:
    """All 36 features: five rows of moments a point, one for each radius, turned into columns."""
    radii = ", ".join(f"({k}, {x})" for k, x in enumerate(feat.RADII))
    of = lambda c, k: f"coalesce(max(CASE WHEN k = {k} THEN {c} END), 0)"
    names = [of(c, k) for k in range(5) for c in ("e2", "e3", "g1", "g3")] + [of("zv", k) for k in range(5)]
    tail = ["height", "curvature", "mean_curvature", *(f"coalesce(h{b}, 0)" for b in range(8))]
    outer = ", ".join(f"round({c}, 4)+0.0 AS f{k}" for k, c in enumerate([f"v{k}" for k in range(25)] + tail))
    return f"""WITH RECURSIVE {_UNIT}, {V.KNN}, {V.GEODESIC()}, radius(k, r) AS (VALUES {radii}),
m AS (SELECT n.shape_id, n.src AS point_idx, k, avg(x*x) AS a, avg(x*y) AS b, avg(x*z) AS c, avg(y*y) AS d, avg(y*z) AS e, avg(z*z) AS f, var_pop(z) AS zv FROM nbrs n JOIN radius ON n.d < r JOIN points p ON p.shape_id = n.shape_id AND p.point_idx = n.dst GROUP BY 1, 2, 3),
{V.eig()}, {V.eigenvector('l1', 'eig', 'v')}, {V.eigenvector('l3', '(SELECT * RENAME (ex AS fx, ey AS fy, ez AS fz) FROM v)', 'w')},
part AS (SELECT shape_id, point_idx, k, coalesce(l2/l1, 0) AS e2, coalesce(l3/l1, 0) AS e3, CASE WHEN l1 - l2 > 1e-3 * l1 THEN abs(fy) ELSE 0 END AS g1, CASE WHEN l2 - l3 > 1e-3 * l1 THEN abs(ey) ELSE 0 END AS g3, zv FROM w),
wide AS (SELECT p.shape_id, p.point_idx, {", ".join(f"{c} AS v{k}" for k, c in enumerate(names))} FROM points p LEFT JOIN part USING (shape_id, point_idx) GROUP BY 1, 2),
{_curvature_sql(0.05)}, {_MEAN}, tall AS (SELECT shape_id, point_idx, z - min(z) OVER (PARTITION BY shape_id) AS height FROM points),
bin AS (SELECT shape_id, src, CAST(floor(8*d/1.3+0.5) AS INTEGER) AS b FROM nbrs WHERE d <= 1.3),
hist AS (SELECT shape_id, src AS point_idx, {", ".join(f"count(*) FILTER (WHERE b = {b}) / count(*) AS h{b}" for b in range(8))} FROM bin WHERE b < 8 GROUP BY 1, 2)
SELECT shape_id, point_idx, {outer} FROM wide JOIN tall USING (shape_id, point_idx) JOIN smooth USING (shape_id, point_idx) LEFT JOIN hist USING (shape_id, point_idx)"""


@query(_vector_sql())
def feature_vector36(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = feat.features36(nrm.normalize_points(V.points(spark, sf_dir)))
    return f.select("shape_id", "point_idx", *(r(F.get("f", F.lit(k)), 4).alias(f"f{k}") for k in range(36)))


# ---------------------------------------------------------------------------------------------- parts

_PARTS = f"""WITH RECURSIVE {V.POINTS}, part AS (SELECT p.* FROM points p JOIN (SELECT shape_id, label FROM points GROUP BY 1, 2 HAVING count(*) >= {{least}}) USING (shape_id, label) WHERE {{which}}),
near AS (SELECT * FROM (SELECT a.shape_id, a.label, a.point_idx AS i, b.point_idx AS j, row_number() OVER (PARTITION BY a.shape_id, a.label, a.point_idx ORDER BY (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z), b.point_idx) AS rn FROM part a JOIN part b USING (shape_id, label)) WHERE rn <= {{k}}),
und AS (SELECT shape_id, i AS u, j AS v FROM near WHERE j > i UNION ALL SELECT shape_id, j, i FROM near WHERE j > i),
reach(shape_id, u, v) AS (SELECT shape_id, point_idx, point_idx FROM part UNION SELECT r.shape_id, r.u, e.v FROM reach r JOIN und e ON e.shape_id = r.shape_id AND e.u = r.v),
low AS (SELECT shape_id, u, min(v) AS low FROM reach GROUP BY 1, 2),
comp AS (SELECT p.shape_id, p.label, p.point_idx, p.x, p.y, p.z, CAST(dense_rank() OVER (PARTITION BY p.shape_id, p.label ORDER BY low) - 1 AS INTEGER) AS component FROM part p JOIN low l ON l.shape_id = p.shape_id AND l.u = p.point_idx)"""


@query(_PARTS.format(least=3, which="true", k=10) + """, s AS (SELECT shape_id, label, component, count(*) AS n FROM comp GROUP BY 1, 2, 3), t AS (SELECT shape_id, label, sum(CASE WHEN n > 5 THEN 1 ELSE 0 END) AS k FROM s GROUP BY 1, 2)
SELECT l.label, CAST(coalesce(max(k), 0) AS INTEGER) AS parts FROM (SELECT CAST(unnest([0, 1, 2, 3, 4, 5]) AS INTEGER) AS label) l LEFT JOIN t USING (label) GROUP BY 1""")
def count_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parts.count_parts(V.points(spark, sf_dir), 6, larger_than=5)


def _clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components over the two nearest neighbours only, so that parts have several."""
    p = V.points(spark, sf_dir)
    return graph.components(p, graph.knn_edges(p, 3, key=parts.KEY), key=parts.KEY)


_CENTERS = _PARTS.format(least=1, which="true", k=3) + ", center AS (SELECT shape_id, label, component, count(*) AS size, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM comp GROUP BY 1, 2, 3)"


def _centers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parts.cluster_centroids(_clusters(spark, sf_dir), V.points(spark, sf_dir))


@query(_CENTERS + " SELECT shape_id, label, component, size, round(x, 6)+0.0 AS x, round(y, 6)+0.0 AS y, round(z, 6)+0.0 AS z FROM center")
def cluster_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _centers(spark, sf_dir).select("shape_id", "label", "component", "size", *(r(F.col(c)).alias(c) for c in "xyz"))


@query(_CENTERS + " SELECT shape_id, label, component, CAST(row_number() OVER (PARTITION BY shape_id, label ORDER BY x*0.6+z*0.8, component) - 1 AS INTEGER) AS rank FROM center")
def split_order_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parts.order_on_line(_centers(spark, sf_dir), (3.0, 0.0, 4.0)).select("shape_id", "label", "component", "rank")


@query(_CENTERS + """, o AS (SELECT *, x-avg(x) OVER w AS dx, y-avg(y) OVER w AS dy, z-avg(z) OVER w AS dz FROM center WINDOW w AS (PARTITION BY shape_id, label)),
c AS (SELECT *, greatest(-1, least(1, CASE WHEN dx*dx+dy*dy+dz*dz > 0 THEN dx/sqrt(dx*dx+dy*dy+dz*dz) ELSE 1 END)) AS cosine FROM o),
g AS (SELECT *, CASE WHEN dy < 0 THEN 2*3.14159265358-acos(cosine) ELSE acos(cosine) END AS angle FROM c)
SELECT shape_id, label, component, round(angle, 4)+0.0 AS angle, CAST(row_number() OVER (PARTITION BY shape_id, label ORDER BY angle, component) - 1 AS INTEGER) AS rank FROM g""")
def split_order_angle(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _centers(spark, sf_dir)
    out = parts.order_by_angle(c, (1.0, 0.0, 0.0), (0.0, 1.0, 0.0))
    return out.select("shape_id", "label", "component", r(F.col("angle"), 4).alias("angle"), "rank")


_EXPECTED = "CASE label WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 END"


@query(_CENTERS + f" SELECT shape_id, label, component, size FROM (SELECT *, row_number() OVER (PARTITION BY shape_id, label ORDER BY size DESC, component) AS rn FROM center) WHERE rn <= {_EXPECTED}")
def drop_smallest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parts.keep_largest(_centers(spark, sf_dir), V.groups(spark)).select("shape_id", "label", "component", "size")


@query(_CENTERS + f", k AS (SELECT shape_id, label, count(*) AS k, sum(size) AS n FROM center WHERE label IN (1, 2) GROUP BY 1, 2) SELECT DISTINCT shape_id FROM k WHERE n < 10 OR k <> {_EXPECTED}")
def wrong_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parts.wrong_shapes(V.points(spark, sf_dir), _clusters(spark, sf_dir), V.groups(spark), "force_match")


@query(_PARTS.format(least=10, which="p.label IN (1, 2)", k=10) + f""", center AS (SELECT shape_id, label, component, count(*) AS size, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM comp GROUP BY 1, 2, 3),
kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY shape_id, label ORDER BY size DESC, component) AS rn FROM center) WHERE rn <= {_EXPECTED}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY shape_id, label ORDER BY x, component) - 1 AS rank FROM kept),
own AS (SELECT c.shape_id, c.point_idx, rank FROM comp c JOIN ranked k USING (shape_id, label, component))
SELECT p.shape_id, p.point_idx, CAST(CASE WHEN p.label = 0 THEN 0 WHEN p.label = 1 THEN 1 + rank WHEN p.label = 2 THEN 3 + rank END AS INTEGER) AS new_label FROM points p LEFT JOIN own USING (shape_id, point_idx)""")
def split_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parts.split_parts(V.points(spark, sf_dir), V.groups(spark), [(1.0, 0.0, 0.0)])
