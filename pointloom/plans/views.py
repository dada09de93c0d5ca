"""Views of the driver's tables as shapes, for the registered queries; the same in SQL, as common table expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r(c: Column, digits: int = 6) -> Column:
    """Rounded, without negative zero."""
    return F.round(c, digits) + F.lit(0.0)


#: Points of a shape: like meshes, shapes grow in number with the table, not in size.
SHAPE_POINTS = 125
SHAPE = f"cast(vec_id div {SHAPE_POINTS} as int)"


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """shape_id (runs of vec_ids), point_idx (order of vec_id), label (vec_id mod 4), x, y, z (the first three components)."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.expr(SHAPE).alias("shape_id"), *(F.get("embedding", F.lit(k)).cast("double").alias(c) for k, c in enumerate("xyz")))
    at = F.row_number().over(W.partitionBy("shape_id").orderBy("vec_id")) - 1
    return e.select("shape_id", at.alias("point_idx"), (F.col("vec_id") % 4).cast("int").alias("label"), "x", "y", "z")


def vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).select("shape_id", F.col("point_idx").alias("v_idx"), "x", "y", "z")


def faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Face k has the corners 3k, 3k + 1, 3k + 2 where all exist."""
    v = points(spark, sf_dir).filter("point_idx % 3 = 2").select("shape_id", F.col("point_idx").alias("v2"))
    return v.select("shape_id", F.expr("cast(v2 div 3 as int)").alias("f_idx"), (F.col("v2") - 2).alias("v0"), (F.col("v2") - 1).alias("v1"), "v2")


def strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faces k, k + 1, k + 2 of consecutive points: neighbours share edges."""
    v = points(spark, sf_dir).filter("point_idx >= 2").select("shape_id", F.col("point_idx").alias("v2"))
    return v.select("shape_id", (F.col("v2") - 2).alias("f_idx"), (F.col("v2") - 2).alias("v0"), (F.col("v2") - 1).alias("v1"), "v2")


def face_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return faces(spark, sf_dir).select("shape_id", F.col("f_idx").alias("elem_idx"), (F.col("f_idx") % 3).alias("label"))


def vertex_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vertices(spark, sf_dir).select("shape_id", "v_idx", F.col("z").alias("value"))


def probs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Magnitudes of the first four components as the probabilities of labels 0 to 3."""
    e = table(spark, sf_dir, "embeddings")
    at = F.row_number().over(W.partitionBy("shape_id").orderBy("vec_id")) - 1
    rows = e.withColumn("shape_id", F.expr(SHAPE)).select("shape_id", at.alias("point_idx"), F.slice("embedding", 1, 4).alias("e"))
    p = rows.select("shape_id", "point_idx", F.posexplode("e").alias("label", "p"))
    return p.withColumn("p", F.abs(F.col("p").cast("double")))


GROUPS = [[0], [1, 2], [3, 4, 5]]


def groups(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(GROUPS)), "group_idx int, members array<int>")


# ---------------------------------------------------------------------------------------------- SQL

_SHAPE = f"CAST(vec_id // {SHAPE_POINTS} AS INTEGER)"
POINTS = f"""points AS (SELECT {_SHAPE} AS shape_id, CAST(row_number() OVER (PARTITION BY {_SHAPE} ORDER BY vec_id) - 1 AS INTEGER) AS point_idx,
  CAST(vec_id % 4 AS INTEGER) AS label, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings)"""
FACES = """faces AS (SELECT shape_id, point_idx // 3 AS f_idx, point_idx - 2 AS v0, point_idx - 1 AS v1, point_idx AS v2 FROM points WHERE point_idx % 3 = 2)"""
STRIP = """faces AS (SELECT shape_id, point_idx - 2 AS f_idx, point_idx - 2 AS v0, point_idx - 1 AS v1, point_idx AS v2 FROM points WHERE point_idx >= 2)"""
CORNERS = """corners AS (SELECT f.*, a.x AS ax, a.y AS ay, a.z AS az, b.x AS bx, b.y AS "by", b.z AS bz, c.x AS cx, c.y AS cy, c.z AS cz FROM faces f
  JOIN points a ON a.shape_id = f.shape_id AND a.point_idx = f.v0 JOIN points b ON b.shape_id = f.shape_id AND b.point_idx = f.v1 JOIN points c ON c.shape_id = f.shape_id AND c.point_idx = f.v2)"""
NORMALS = """n0 AS (SELECT *, ("by"-ay)*(cz-az)-(bz-az)*(cy-ay) AS ux, (bz-az)*(cx-ax)-(bx-ax)*(cz-az) AS uy, (bx-ax)*(cy-ay)-("by"-ay)*(cx-ax) AS uz FROM corners),
area AS (SELECT *, sqrt(ux*ux+uy*uy+uz*uz) / 2 AS area FROM n0)"""
LENGTHS = """lengths AS (SELECT *, sqrt((bx-cx)*(bx-cx)+("by"-cy)*("by"-cy)+(bz-cz)*(bz-cz)) AS l0, sqrt((cx-ax)*(cx-ax)+(cy-ay)*(cy-ay)+(cz-az)*(cz-az)) AS l1, sqrt((ax-bx)*(ax-bx)+(ay-"by")*(ay-"by")+(az-bz)*(az-bz)) AS l2 FROM corners)"""
ANGLES = """angles AS (SELECT *, acos(greatest(-1, least(1, (l1*l1+l2*l2-l0*l0)/(2*l1*l2)))) AS t0, acos(greatest(-1, least(1, (l2*l2+l0*l0-l1*l1)/(2*l2*l0)))) AS t1, acos(greatest(-1, least(1, (l0*l0+l1*l1-l2*l2)/(2*l0*l1)))) AS t2 FROM lengths)"""
KNN = """near AS (SELECT * FROM (SELECT a.shape_id, a.point_idx AS i, b.point_idx AS j, (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z) AS d2,
  row_number() OVER (PARTITION BY a.shape_id, a.point_idx ORDER BY (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z), b.point_idx) AS rn FROM points a JOIN points b USING (shape_id)) WHERE rn <= 10),
edges AS (SELECT shape_id, i, j, sqrt(d2) AS w FROM near WHERE j > i),
und AS (SELECT shape_id, i AS u, j AS v, w FROM edges UNION ALL SELECT shape_id, j, i, w FROM edges)"""


def GEODESIC(radius: str = "1.3") -> str:
    return f"""sp(shape_id, src, dst, d) USING KEY (shape_id, src, dst) AS (SELECT DISTINCT shape_id, u, u, CAST(0 AS DOUBLE) FROM und
  UNION SELECT s.shape_id, s.src, e.v, min(s.d + e.w) FROM sp s JOIN und e ON e.shape_id = s.shape_id AND e.u = s.dst
  LEFT JOIN recurring.sp k ON k.shape_id = s.shape_id AND k.src = s.src AND k.dst = e.v WHERE s.d + e.w < {radius} AND (k.d IS NULL OR s.d + e.w < k.d) GROUP BY 1, 2, 3),
nbrs AS (SELECT shape_id, src, dst, d FROM sp WHERE src <> dst)"""


DIRECTED = """directed AS (SELECT shape_id, f_idx, 0 AS k, v0 AS u, v1 AS v FROM faces UNION ALL SELECT shape_id, f_idx, 1, v1, v2 FROM faces UNION ALL SELECT shape_id, f_idx, 2, v2, v0 FROM faces),
sides AS (SELECT shape_id, least(u, v) AS a, greatest(u, v) AS b, count(*) AS faces, CAST(sum(CASE WHEN u < v THEN 1 ELSE -1 END) AS BIGINT) AS turns FROM directed GROUP BY 1, 2, 3)"""
CORNER = """corner AS (SELECT shape_id, f_idx, 0 AS k, v0 AS v_idx FROM faces UNION ALL SELECT shape_id, f_idx, 1, v1 FROM faces UNION ALL SELECT shape_id, f_idx, 2, v2 FROM faces)"""
PROBS = f"""probs AS (SELECT shape_id, point_idx, label, abs(CAST(e[label + 1] AS DOUBLE)) AS p FROM (SELECT {_SHAPE} AS shape_id, CAST(row_number() OVER (PARTITION BY {_SHAPE} ORDER BY vec_id) - 1 AS INTEGER) AS point_idx, embedding AS e FROM embeddings), (SELECT unnest([0, 1, 2, 3]) AS label))"""


def eig(m: str = "m") -> str:
    """Columns l1, l2, l3 of the symmetric matrix (a, b, c, d, e, f) of a table."""
    return f"""q0 AS (SELECT *, (a+d+f)/3 AS q FROM {m}),
q1 AS (SELECT *, sqrt(((a-q)*(a-q)+(d-q)*(d-q)+(f-q)*(f-q)+2*(b*b+c*c+e*e))/6) AS p, (a-q)*((d-q)*(f-q)-e*e)-b*(b*(f-q)-e*c)+c*(b*e-(d-q)*c) AS det FROM q0),
q2 AS (SELECT *, acos(greatest(-1.0, least(1.0, CASE WHEN p > 0 THEN det/(2*p*p*p) END)))/3 AS phi FROM q1),
q3 AS (SELECT *, CASE WHEN p <= 0 THEN q ELSE q+2*p*cos(phi) END AS l1, CASE WHEN p <= 0 THEN q ELSE q+2*p*cos(phi+2*pi()/3) END AS l3 FROM q2),
eig AS (SELECT *, CASE WHEN p <= 0 THEN q ELSE 3*q-l1-l3 END AS l2 FROM q3)"""


def eigenvector(value: str, table: str, name: str) -> str:
    """A table with ex, ey, ez: a unit eigenvector for `value`."""
    return f"""{name}_c AS (SELECT *, b*e-c*(d-{value}) AS x1, c*b-(a-{value})*e AS y1, (a-{value})*(d-{value})-b*b AS z1, b*(f-{value})-c*e AS x2, c*c-(a-{value})*(f-{value}) AS y2, (a-{value})*e-b*c AS z2,
  (d-{value})*(f-{value})-e*e AS x3, e*c-b*(f-{value}) AS y3, b*e-(d-{value})*c AS z3 FROM {table}),
{name}_d AS (SELECT *, x1*x1+y1*y1+z1*z1 AS n1, x2*x2+y2*y2+z2*z2 AS n2, x3*x3+y3*y3+z3*z3 AS n3, greatest(x1*x1+y1*y1+z1*z1, x2*x2+y2*y2+z2*z2, x3*x3+y3*y3+z3*z3) AS best FROM {name}_c),
{name} AS (SELECT * EXCLUDE (x1, y1, z1, x2, y2, z2, x3, y3, z3, n1, n2, n3, best),
  CASE WHEN best > 0 THEN CASE WHEN n1 >= best THEN x1 WHEN n2 >= best THEN x2 ELSE x3 END / sqrt(best) END AS ex,
  CASE WHEN best > 0 THEN CASE WHEN n1 >= best THEN y1 WHEN n2 >= best THEN y2 ELSE y3 END / sqrt(best) END AS ey,
  CASE WHEN best > 0 THEN CASE WHEN n1 >= best THEN z1 WHEN n2 >= best THEN z2 ELSE z3 END / sqrt(best) END AS ez FROM {name}_d)"""
