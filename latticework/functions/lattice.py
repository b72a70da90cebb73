"""3x3 lattice algebra as column expressions. Cells are row vectors, points are rows: p = f @ cell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import BIN_WIDTH, EDGE_EPS, N_BINS


def rows(cell: Column) -> list[list[Column]]:
    return [[cell[i][j] for j in range(3)] for i in range(3)]


def cross(a, b) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def dot(a, b) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def det(m) -> Column:
    return dot(m[0], cross(m[1], m[2]))


def volume(cell: Column) -> Column:
    return F.abs(det(rows(cell)))


def heights(cell: Column) -> list[Column]:
    """Distance between opposite faces along each lattice direction."""
    m = rows(cell)
    return [F.abs(det(m)) / norm(cross(m[(i + 1) % 3], m[(i + 2) % 3])) for i in range(3)]


def expand_cells(structures: DataFrame, keep: list[str]) -> DataFrame:
    """Cell algebra as plain columns, computed once per structure.

    a{r}{k} cell, v{r}{k} inverse (f = p @ v), w{r}{k} metric for r <= k (d2 = sum w_rk f_r f_k, off-diagonal
    terms doubled), h{k} heights. Cells that are null give nulls.
    """
    nxt = {0: (1, 2), 1: (2, 0), 2: (0, 1)}
    axes = range(3)
    flat = structures.selectExpr(*keep, *[f"cell[{r}][{k}] AS a{r}{k}" for r in axes for k in axes])
    # x{r}{k}: component k of the cross product of the two other lattice rows
    faces = flat.selectExpr("*", *[
        f"a{nxt[r][0]}{nxt[k][0]} * a{nxt[r][1]}{nxt[k][1]} - a{nxt[r][0]}{nxt[k][1]} * a{nxt[r][1]}{nxt[k][0]} AS x{r}{k}"
        for r in axes for k in axes])
    solid = faces.selectExpr("*", "a00 * x00 + a01 * x01 + a02 * x02 AS det")
    return solid.selectExpr(
        *keep, *[f"a{r}{k}" for r in axes for k in axes],
        *[f"abs(det) / sqrt(x{r}0 * x{r}0 + x{r}1 * x{r}1 + x{r}2 * x{r}2) AS h{r}" for r in axes],
        *[f"x{k}{r} / det AS v{r}{k}" for r in axes for k in axes],
        *[f"{1.0 if r == k else 2.0}D * (a{r}0 * a{k}0 + a{r}1 * a{k}1 + a{r}2 * a{k}2) AS w{r}{k}"
          for r in axes for k in axes if k >= r])


def fraction_sql(k: int, x: str = "x", y: str = "y", z: str = "z") -> str:
    """Fractional coordinate k from Cartesian columns and expanded cells."""
    return f"{x} * v0{k} + {y} * v1{k} + {z} * v2{k}"


def cartesian_sql(k: int, f: str = "f") -> str:
    return f"{f}0 * a0{k} + {f}1 * a1{k} + {f}2 * a2{k}"


def times(point, matrix: Column) -> list[Column]:
    m = rows(matrix)
    return [point[0] * m[0][k] + point[1] * m[1][k] + point[2] * m[2][k] for k in range(3)]


def wrap_sql(u: str) -> str:
    """u mod 1, never 1.0 itself (a tiny negative remainder rounds up to 1.0)."""
    return f"if({u} - floor({u}) >= 1D, 0D, {u} - floor({u}))"


def distance_bin(d: Column, width: float = BIN_WIDTH, n: int = N_BINS) -> Column:
    return F.least(F.floor(d / F.lit(width) + F.lit(EDGE_EPS)), F.lit(n - 1)).cast("int")
