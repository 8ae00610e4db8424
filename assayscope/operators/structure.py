"""Spatial features on residue coordinates. Neighbours are looked for in grid cells of the radius's size (27 cells around
each point), then counted by their exact distance."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from assayscope.sources.ingest import written


def _distance2(a: list[Column], b: list[Column]) -> Column:
    d = [(x - y) * (x - y) for x, y in zip(a, b)]
    return d[0] + d[1] + d[2]


def _cell(x: str, size: float) -> Column:
    return F.floor(F.col(x) / F.lit(size)).cast("int")


#: Points, and other residues, that one task compares at once.
POINTS, OTHERS = 32_768, 131_072
#: Pairs that a task is dealt, about, and cells, if they are small: there are as many tasks as these ask for.
PAIRS, CELLS = 1 << 28, 100


def counts_within(x: np.ndarray, near: np.ndarray, radius: float) -> np.ndarray:
    """How many rows of `near` are at most radius away from each row of x, both sorted by their first column.

    Distances are told in single precision by one product of matrices, from the middle of x, as long as they are not
    within its error of the radius; such pairs are told in doubles.
    """
    limit, n = radius * radius, np.zeros(len(x), dtype=np.int64)
    middle = (x.min(axis=0) + x.max(axis=0)) / 2
    a, b = x - middle, near - middle
    # 2**-24 for each of 5 products, their factors and sums, which are 2 (a**2 + b**2) + limit at most: thrice that
    slack = 3e-6 * (np.square(a).sum(axis=1).max() + np.square(b).sum(axis=1).max() + limit)
    a = np.column_stack([a, np.square(a).sum(axis=1) - limit, np.ones(len(a))]).astype(np.float32)
    b = np.column_stack([-2 * b, np.ones(len(b)), np.square(b).sum(axis=1)]).astype(np.float32).T.copy()
    for k in range(0, len(x), 64):
        at = slice(k, k + 64)
        # a little wider than the radius: the exact distance decides
        lo, hi = np.searchsorted(near[:, 0], (x[at, 0].min() - radius * 1.001, x[at, 0].max() + radius * 1.001))
        for j in range(lo, hi, 2048):
            to = slice(j, min(hi, j + 2048))
            over = a[at] @ b[:, to]
            sure, may = (np.array([np.count_nonzero(row) for row in over <= d]) for d in (-slack, slack))
            n[at] += sure
            for i in np.flatnonzero(sure != may):
                close = np.flatnonzero((over[i] > -slack) & (over[i] <= slack))
                n[k + i] += np.count_nonzero(_squares(x[k + i], near[j + close]) <= limit)
    return n


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of rows, added up as _distance2() does."""
    d = np.square(a - b)
    return d[..., 0] + d[..., 1] + d[..., 2]


def near_counts(points: DataFrame, others: DataFrame, radius: float) -> DataFrame:
    """structure, owner, i, n: of each point of `points` (structure, owner, i, x, y, z) with any, the residues of `others`
    (structure, residue, x, y, z) but its owner that are at most `radius` away.

    Pairs are counted inside tasks and never become rows. Points meet the residues of the 27 cells around theirs; full
    cells are split, so that no task holds more than POINTS and OTHERS rows of them, and cells are dealt to as many tasks
    as their pairs and numbers ask for. Rows without a finite place are near to nothing.
    """
    cells = {c: _cell(x, radius) for c, x in (("cx", "x"), ("cy", "y"), ("cz", "z"))}
    key = ["structure", *cells]
    placed = lambda d: d.where(" and ".join(f"abs({c}) < double('infinity')" for c in "xyz")).withColumns(cells)
    a, b = placed(points), placed(others.select("structure", "residue", "x", "y", "z"))
    near = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(k).alias("k")) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)]))
    b = b.withColumn("step", near).withColumns({c: F.col(c) + F.col(f"step.{s}") for c, s in (("cx", "i"), ("cy", "j"), ("cz", "k"))}).drop("step")
    # one row per cell that holds points
    parts = written(a.groupBy(*key).agg(F.count("*").alias("rows")).join(b.groupBy(*key).agg(F.count("*").alias("cols")), key), "cells")
    tasks = parts.agg(F.ceil(F.sum(F.col("rows").cast("double") * F.col("cols") / PAIRS + F.lit(1 / CELLS)))).first()[0] or 1
    parts = parts.withColumns({"rows": F.ceil(F.col("rows") / POINTS).cast("int"), "cols": F.ceil(F.col("cols") / OTHERS).cast("int")})
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    mine = lambda n, *c: F.pmod(F.xxhash64(*c), F.col(n)).cast("int")
    a = a.join(parts, key).withColumn("row", mine("rows", "owner", "i")).withColumn("col", each("cols")).drop("rows", "cols")
    b = b.join(parts, key).withColumn("col", mine("cols", "residue")).withColumn("row", each("rows")).drop("rows", "cols")
    kinds = dict(points.dtypes)

    schema = f"structure {kinds['structure']}, owner {kinds['owner']}, i int, n long"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def count(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return arrow.empty_table()
        left, right = left.sort_by("x"), right.sort_by("o_x")
        x, near = (np.column_stack([t[c].to_numpy() for c in names]) for t, names in ((left, ("x", "y", "z")), (right, ("o_x", "o_y", "o_z"))))
        n = counts_within(x, near, radius)
        # owners are no neighbours of their own points
        residue = right["o_residue"].to_numpy()
        order = np.argsort(residue, kind="stable")
        first, last = (np.searchsorted(residue, left["owner"].to_numpy(), side=s, sorter=order) for s in ("left", "right"))
        while (there := np.flatnonzero(first < last)).size:
            n[there] -= _squares(x[there], near[order[first[there]]]) <= radius * radius
            first[there] += 1
        some = np.flatnonzero(n)
        return left.select(["structure", "owner", "i"]).take(some).append_column("n", pa.array(n[some])).cast(arrow)

    deal = [*key, "row", "col"]
    # names of their own, as both sides may come from one table
    b = b.select(*[F.col(c).alias(f"o_{c}") for c in (*deal, "residue", "x", "y", "z")])
    a, b = a.select(*deal, "owner", "i", "x", "y", "z").repartition(tasks, *deal), b.repartition(tasks, *[f"o_{c}" for c in deal])
    found = a.groupBy(*deal).cogroup(b.groupBy(*[f"o_{c}" for c in deal])).applyInArrow(count, schema)
    return found.groupBy("structure", "owner", "i").agg(F.sum("n").alias("n"))


def radius_counts(coords: DataFrame, radius: float = 10.0) -> DataFrame:
    """structure, residue, neighbours: other residues within the radius."""
    c = written(coords, "coords")
    n = near_counts(c.withColumnRenamed("residue", "owner").withColumn("i", F.lit(0)), c, radius)
    n = n.select("structure", F.col("owner").alias("residue"), F.col("n").alias("neighbours"))
    return c.select("structure", "residue").join(n, ["structure", "residue"], "left").fillna(0, ["neighbours"])


def sphere_points(n: int = 32) -> list[tuple[int, float, float, float]]:
    """n points spread over the unit sphere along a golden-angle spiral."""
    turn = math.pi * (3 - math.sqrt(5))
    out = []
    for i in range(n):
        z = 1 - (2 * i + 1) / n
        rad = math.sqrt(1 - z * z)
        out.append((i, rad * math.cos(i * turn), rad * math.sin(i * turn), z))
    return out


def residue_sasa(coords: DataFrame, radius: float = 4.0, points: int = 32) -> DataFrame:
    """structure, residue, sasa: area of the residue's sphere that no other sphere covers."""
    coords = written(coords, "coords")
    ball = coords.sparkSession.createDataFrame(sphere_points(points), "i int, ux double, uy double, uz double")
    # a literal table of `points` rows
    p = coords.crossJoin(F.broadcast(ball)).select(
        "structure", F.col("residue").alias("owner"), "i", *[(F.col(x) + F.lit(radius) * F.col(f"u{x}")).alias(x) for x in "xyz"]
    )
    hit = near_counts(p, coords, radius)
    covered = hit.groupBy("structure", F.col("owner").alias("residue")).agg(F.count("*").alias("covered"))
    out = coords.select("structure", "residue").join(covered, ["structure", "residue"], "left").fillna(0, ["covered"])
    return out.withColumn("sasa", F.lit(4 * math.pi * radius * radius) * (F.lit(points) - F.col("covered")) / points)


def align_offset(positions: DataFrame, coords: DataFrame, start: int) -> DataFrame:
    """structure, offset: start - 1 if moving residue numbers by it covers more of the mutated positions."""
    r = coords.select("structure", F.col("residue").alias("position")).distinct()
    plain = positions.join(r, ["structure", "position"], "left_semi").groupBy("structure").agg(F.count("*").alias("plain"))
    moved = positions.join(r.withColumn("position", F.col("position") + (start - 1)), ["structure", "position"], "left_semi").groupBy("structure").agg(F.count("*").alias("moved"))
    every = positions.select("structure").distinct().join(plain, "structure", "left").join(moved, "structure", "left").fillna(0, ["plain", "moved"])
    return every.select("structure", "plain", "moved", F.when(F.col("moved") > F.col("plain"), start - 1).otherwise(0).alias("offset"))


def pair_distances(sites: DataFrame, coords: DataFrame) -> DataFrame:
    """structure, variant, min_distance over the variant's pairs of positions (structure, variant,
    positions); null if a position has no coordinates or there is no pair."""
    p = sites.select("structure", "variant", F.col("positions").alias("ps"), F.posexplode("positions").alias("i", "a"))
    p = p.select("structure", "variant", "a", F.explode(F.slice("ps", F.col("i") + 2, F.size("ps"))).alias("b"))
    at = lambda s: coords.select("structure", F.col("residue").alias(s), *[F.col(x).alias(f"{s}{x}") for x in "xyz"])
    j = p.join(at("a"), ["structure", "a"], "left").join(at("b"), ["structure", "b"], "left")
    d = F.sqrt(_distance2([F.col(f"a{x}") for x in "xyz"], [F.col(f"b{x}") for x in "xyz"]))
    g = j.groupBy("structure", "variant").agg(F.min(d).alias("least"), F.bool_and(d.isNotNull()).alias("whole"))
    g = g.select("structure", "variant", F.when(F.col("whole"), F.col("least")).alias("min_distance"))
    return sites.select("structure", "variant").join(g, ["structure", "variant"], "left")
