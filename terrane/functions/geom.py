"""Vector arithmetic on x, y, z as column expressions; a vector is a tuple of three columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Vector = tuple[Column, Column, Column]


def vec(alias: str) -> Vector:
    return tuple(F.col(f"{alias}.{c}") for c in "xyz")  # type: ignore[return-value]


def at(prefix: str) -> Vector:
    return tuple(F.col(f"{prefix}{c}") for c in "xyz")  # type: ignore[return-value]


def minus(a: Vector, b: Vector) -> Vector:
    return a[0] - b[0], a[1] - b[1], a[2] - b[2]


def plus(a: Vector, b: Vector) -> Vector:
    return a[0] + b[0], a[1] + b[1], a[2] + b[2]


def times(a: Vector, s: Column) -> Vector:
    return a[0] * s, a[1] * s, a[2] * s


def dot(a: Vector, b: Vector) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vector, b: Vector) -> Vector:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def norm(a: Vector) -> Column:
    return F.sqrt(dot(a, a))


def distance(a: Vector, b: Vector) -> Column:
    return norm(minus(a, b))


def normalised(a: Vector) -> Vector:
    """null for a vector of length 0."""
    n = F.nullif(norm(a), F.lit(0.0))
    return a[0] / n, a[1] / n, a[2] / n


def clamped(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def floored(x: Column, low: float = 1e-8) -> Column:
    return F.greatest(x, F.lit(low))


def area(a: Vector, b: Vector, c: Vector) -> Column:
    return norm(cross(minus(b, a), minus(c, a))) * 0.5


def signed_area(a: Vector, b: Vector, c: Vector) -> Column:
    """Area in the x, y plane, positive for a counter-clockwise triangle."""
    return ((b[0] - a[0]) * (c[1] - a[1]) - (c[0] - a[0]) * (b[1] - a[1])) * 0.5


def quality(a: Vector, b: Vector, c: Vector) -> Column:
    """4 sqrt(3) area / (sum of squared sides): 1 for an equilateral triangle, null for a point."""
    ab, bc, ca = minus(b, a), minus(c, b), minus(a, c)
    return F.lit(6.928203230275509) * area(a, b, c) / F.nullif(dot(ab, ab) + dot(bc, bc) + dot(ca, ca), F.lit(0.0))


def barycentric(p: Vector, a: Vector, b: Vector, c: Vector) -> Vector:
    """Coordinates of p, projected onto the triangle's plane; null for a degenerate triangle."""
    e1, e2, ep = minus(b, a), minus(c, a), minus(p, a)
    d11, d12, d22, d1, d2 = dot(e1, e1), dot(e1, e2), dot(e2, e2), dot(ep, e1), dot(ep, e2)
    det = F.nullif(d11 * d22 - d12 * d12, F.lit(0.0))
    vb, vc = (d22 * d1 - d12 * d2) / det, (d11 * d2 - d12 * d1) / det
    return F.lit(1.0) - vb - vc, vb, vc


def on_segment(p: Vector, a: Vector, b: Vector) -> Column:
    """Place of p's projection on the segment from a (0) to b (1), clamped."""
    e = minus(b, a)
    return clamped(dot(minus(p, a), e) / floored(dot(e, e), 1e-16))


def quadric(cost: dict[str, Column], p: Vector) -> Column:
    """p'Ap + 2b'p + c with A symmetric: keys a11 a12 a13 a22 a23 a33 b1 b2 b3 c."""
    x, y, z = p
    return (
        cost["a11"] * x * x + 2 * cost["a12"] * x * y + 2 * cost["a13"] * x * z + cost["a22"] * y * y + 2 * cost["a23"] * y * z + cost["a33"] * z * z
        + 2 * (cost["b1"] * x + cost["b2"] * y + cost["b3"] * z) + cost["c"]
    )


def quadric_minimum(q: dict[str, Column]) -> Vector:
    """The point -A^-1 b by Cramer's rule; null where A is singular."""
    a, b, c, d, e, f = (q[k] for k in ("a11", "a12", "a13", "a22", "a23", "a33"))
    c11, c12, c13, c22, c23, c33 = d * f - e * e, c * e - b * f, b * e - c * d, a * f - c * c, b * c - a * e, a * d - b * b
    det = F.nullif(a * c11 + b * c12 + c * c13, F.lit(0.0))
    x, y, z = q["b1"], q["b2"], q["b3"]
    return -(c11 * x + c12 * y + c13 * z) / det, -(c12 * x + c22 * y + c23 * z) / det, -(c13 * x + c23 * y + c33 * z) / det


def conformal_error(u: Vector, v: Vector, a: Vector, b: Vector, c: Vector, p: Vector, q: Vector, r: Vector) -> Column:
    """Ratio of the singular values of the map from triangle abc to the plane triangle pqr. u, v: unit axes in the
    plane of abc."""
    x1, y1, x2, y2 = dot(minus(b, a), u), dot(minus(b, a), v), dot(minus(c, a), u), dot(minus(c, a), v)
    det = F.nullif(x1 * y2 - x2 * y1, F.lit(0.0))
    s1, t1, s2, t2 = q[0] - p[0], q[1] - p[1], r[0] - p[0], r[1] - p[1]
    j11, j12 = (s1 * y2 - s2 * y1) / det, (s2 * x1 - s1 * x2) / det
    j21, j22 = (t1 * y2 - t2 * y1) / det, (t2 * x1 - t1 * x2) / det
    e, f, g, h = (j11 + j22) / 2, (j11 - j22) / 2, (j21 + j12) / 2, (j21 - j12) / 2
    big, small = F.sqrt(e * e + h * h), F.sqrt(f * f + g * g)
    return (big + small) / F.nullif(F.abs(big - small), F.lit(0.0))
