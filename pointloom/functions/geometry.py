"""Column expressions of 3-D geometry: vectors are structs (x, y, z) or three columns; all stay inside generated code."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

#: The circle constant and the smallest positive double that the rotation and bounding-box conventions use.
PI = 3.14159265358
SMALLEST = 2.2250738585072014e-308

Vec = tuple[Column, Column, Column]


def cols(prefix: str = "", names: str = "xyz") -> Vec:
    return tuple(F.col(f"{prefix}{n}") for n in names)


def sub(a: Vec, b: Vec) -> Vec:
    return tuple(p - q for p, q in zip(a, b, strict=True))


def scale(a: Vec, k: Column | float) -> Vec:
    return tuple(p * k for p in a)


def add(*vs: Vec) -> Vec:
    out = vs[0]
    for v in vs[1:]:
        out = tuple(p + q for p, q in zip(out, v, strict=True))
    return out


def dot(a: Vec, b: Vec) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def norm(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def cross(a: Vec, b: Vec) -> Vec:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def unit(a: Vec) -> Vec:
    """The vector of length one, null for the null vector."""
    return tuple(F.try_divide(p, norm(a)) for p in a)


def squared_distance(a: Vec, b: Vec) -> Column:
    d = sub(a, b)
    return dot(d, d)


def rotation(axis: Sequence[float], degrees: float) -> list[list[float]]:
    """The matrix of a turn about `axis`, which is taken as given and not made a unit vector."""
    t = degrees * PI / 180.0
    c, s = math.cos(t), math.sin(t)
    rows = []
    for i in range(3):
        row = []
        for j in range(3):
            k = 3 - i - j
            skew = 0.0 if i == j else (axis[k] if (j - i) % 3 == 2 else -axis[k])
            row.append((1 - c) * axis[i] * axis[j] + s * skew + (c if i == j else 0.0))
        rows.append(row)
    return rows


def matmul(a: Sequence[Sequence[float]], b: Sequence[Sequence[float]]) -> list[list[float]]:
    return [[sum(x * y for x, y in zip(r, c, strict=True)) for c in zip(*b, strict=True)] for r in a]


def apply(m: Sequence[Sequence[float]], v: Vec) -> Vec:
    return tuple(F.lit(float(r[0])) * v[0] + F.lit(float(r[1])) * v[1] + F.lit(float(r[2])) * v[2] for r in m)


def triangle_area(a: Vec, b: Vec, c: Vec) -> Column:
    """Half of the product of two edges and the sine between them; 0 where an edge has no length."""
    u, v = sub(b, a), sub(c, a)
    square = dot(u, u) * dot(v, v) - dot(u, v) * dot(u, v)
    return 0.5 * F.sqrt(F.greatest(square, F.lit(0.0)))


def cross_area(a: Vec, b: Vec, c: Vec) -> Column:
    return 0.5 * norm(cross(sub(b, a), sub(c, a)))


def with_eigenvalues(df: DataFrame, m: Sequence[str], out: str) -> DataFrame:
    """Adds {out}1 to {out}3: eigenvalues, largest first, of the symmetric matrix [[a, b, c], [b, d, e], [c, e, f]] of columns m.

    Step by step, so that each value is computed once and no expression repeats another.
    """
    a, b, c, d, e, f = map(F.col, m)
    q, p, det, phi = (F.col(f"_{out}{n}") for n in ("q", "p", "det", "phi"))
    df = df.withColumn(f"_{out}q", (a + d + f) / 3)
    df = df.withColumns(
        {
            f"_{out}p": F.sqrt(((a - q) * (a - q) + (d - q) * (d - q) + (f - q) * (f - q) + 2 * (b * b + c * c + e * e)) / 6),
            f"_{out}det": (a - q) * ((d - q) * (f - q) - e * e) - b * (b * (f - q) - e * c) + c * (b * e - (d - q) * c),
        }
    )
    df = df.withColumn(f"_{out}phi", F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(det, 2 * p * p * p)))) / 3)
    turn = lambda k: F.when(p <= 0, q).otherwise(q + 2 * p * F.cos(phi + k * math.pi / 3))
    df = df.withColumns({f"{out}1": turn(0), f"{out}3": turn(2)})
    df = df.withColumn(f"{out}2", F.when(p <= 0, q).otherwise(3 * q - F.col(f"{out}1") - F.col(f"{out}3")))
    return df.drop(*(f"_{out}{n}" for n in ("q", "p", "det", "phi")))


def with_eigenvector(df: DataFrame, m: Sequence[str], value: str, out: str) -> DataFrame:
    """Adds {out}x, {out}y, {out}z: a unit eigenvector of the eigenvalue in column `value`, the longest cross product of two rows
    of the matrix less that value; its sign is arbitrary, and it is null if all rows are parallel."""
    a, b, c, d, e, f = map(F.col, m)
    v = F.col(value)
    rows = [(a - v, b, c), (b, d - v, e), (c, e, f - v)]
    names = [f"_{out}{k}{n}" for k in range(3) for n in "xyz"]
    pairs = ((0, 1), (0, 2), (1, 2))
    df = df.withColumns({f"_{out}{k}{n}": x for k, (i, j) in enumerate(pairs) for n, x in zip("xyz", cross(rows[i], rows[j]), strict=True)})
    df = df.withColumns({f"_{out}n{k}": dot(cols(f"_{out}{k}"), cols(f"_{out}{k}")) for k in range(3)})
    n = [F.col(f"_{out}n{k}") for k in range(3)]
    df = df.withColumn(f"_{out}best", F.greatest(*n))
    best = F.col(f"_{out}best")
    pick = lambda x: F.when(n[0] >= best, F.col(f"_{out}0{x}")).when(n[1] >= best, F.col(f"_{out}1{x}")).otherwise(F.col(f"_{out}2{x}"))
    df = df.withColumns({f"{out}{x}": F.try_divide(pick(x), F.sqrt(best)) for x in "xyz"})
    return df.drop(*names, *(f"_{out}n{k}" for k in range(3)), f"_{out}best")


def with_solution(df: DataFrame, a: Sequence[Sequence[str]], b: Sequence[str], out: str, *, least: float = 1e-12) -> DataFrame:
    """Adds {out}0, {out}1, .. : the solution of a x = b, a symmetric with positive pivots (columns by name, its lower half is read).

    By L D L^T, a column for each step. Null where a pivot is not above `least` of its diagonal element.
    """
    n = len(b)
    low, pivot = lambda i, k: F.col(f"_{out}l{i}{k}"), lambda k: F.col(f"_{out}d{k}")
    for j in range(n):
        d = F.col(a[j][j])
        for k in range(j):
            d = d - low(j, k) * low(j, k) * pivot(k)
        df = df.withColumn(f"_{out}d{j}", F.when(d > least * F.col(a[j][j]), d))
        columns = {}
        for i in range(j + 1, n):
            x = F.col(a[i][j])
            for k in range(j):
                x = x - low(i, k) * low(j, k) * pivot(k)
            columns[f"_{out}l{i}{j}"] = x / pivot(j)
        if columns:
            df = df.withColumns(columns)
    for i in range(n):
        y = F.col(b[i])
        for k in range(i):
            y = y - low(i, k) * F.col(f"_{out}y{k}")
        df = df.withColumn(f"_{out}y{i}", y)
    for i in reversed(range(n)):
        x = F.col(f"_{out}y{i}") / pivot(i)
        for k in range(i + 1, n):
            x = x - low(k, i) * F.col(f"{out}{k}")
        df = df.withColumn(f"{out}{i}", x)
    return df.drop(*(f"_{out}{c}{i}" for c in "dy" for i in range(n)), *(f"_{out}l{i}{k}" for i in range(n) for k in range(i)))


def hsv_to_rgb(h: Column, s: Column, v: Column) -> Vec:
    """Colour with hue, saturation and value in [0, 1]."""
    six = h * 6
    i = F.floor(six)
    f = six - i
    p, q, t = v * (1 - s), v * (1 - s * f), v * (1 - s * (1 - f))
    k = i % 6
    pick = lambda *x: F.when(k == 0, x[0]).when(k == 1, x[1]).when(k == 2, x[2]).when(k == 3, x[3]).when(k == 4, x[4]).otherwise(x[5])
    return pick(v, q, p, p, t, v), pick(t, v, v, q, p, p), pick(p, p, t, v, v, q)


# ---------------------------------------------------------------------------------------------- quaternions (x, y, z, w)

Quat = tuple[Column, Column, Column, Column]


def axis_angle_to_quat(axis: Vec, angle: Column) -> Quat:
    n = norm(axis)
    s = F.try_divide(F.sin(angle / 2), n)
    zero = n == 0
    return (*(F.when(zero, F.lit(0.0)).otherwise(a * s) for a in axis), F.when(zero, F.lit(1.0)).otherwise(F.cos(angle / 2)))


def quat_mult(p: Quat, q: Quat) -> Quat:
    v = add(scale(p[:3], q[3]), scale(q[:3], p[3]), cross(p[:3], q[:3]))
    return (*v, p[3] * q[3] - dot(p[:3], q[:3]))


def quat_conjugate(q: Quat) -> Quat:
    return -q[0], -q[1], -q[2], q[3]


def normalize_quat(q: Quat) -> Quat:
    n = F.sqrt(dot(q[:3], q[:3]) + q[3] * q[3])
    return tuple(F.try_divide(c, n) for c in q)


def rotate_by_quat(v: Vec, q: Quat) -> Vec:
    return quat_mult(quat_mult(q, (*v, F.lit(0.0))), quat_conjugate(q))[:3]


def quat_to_axis_angle(q: Quat) -> tuple[Column, Column, Column, Column]:
    n = norm(q[:3])
    return (*(F.when(n == 0, F.lit(0.0)).otherwise(F.try_divide(c, n)) for c in q[:3]), 2 * F.atan2(n, q[3]))


def quat_to_mat(q: Quat) -> list[list[Column]]:
    x, y, z, w = q
    return [
        [1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)],
        [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)],
        [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)],
    ]
