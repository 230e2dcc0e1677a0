"""DBSCAN by a graph of cells.

Equal rows are merged into points with a weight. Points fall into cells whose
diagonal is eps, so all points of a cell are within eps of each other: a cell of
min_samples rows has core points only, and the core points of a cell are one
cluster. Only cells that lie close to each other are compared, by the boxes
around their points: boxes that are nowhere further apart than eps need no look
at their points, boxes that are further apart than eps everywhere neither.

What is left are the rows of sparse cells, fewer than min_samples in each, whose
neighbours are counted point by point; and pairs of cells of which it isn't
certain whether a core point of one is within eps of one of the other. Those
are halved along each axis, again and again, until a pair of small boxes is
close enough, or none is, or so few points are left that they are compared. So
a dense cell is never compared with itself, nor all its points with those of
another.

Cells are paired by a coarse grid over the first GRID axes, so a row isn't
copied 3^d times for d columns.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.storage import checkpointed
from .tabular import ROW, clean, numeric, with_row_id

#: axes of the grid by which cells find their neighbours
GRID = 3
#: pairs of points of two boxes that are compared directly rather than halved
COMPARED = 4096


def _sum(terms: list[Column]) -> Column:
    return sum(terms[1:], terms[0]) if terms else F.lit(0.0)


def _apart(d: int, a: str, b: str) -> Column:
    """The least squared distance of two boxes, columns of lo and hi arrays."""
    gaps = [F.greatest(F.col(f"{b}.lo")[i] - F.col(f"{a}.hi")[i], F.col(f"{a}.lo")[i] - F.col(f"{b}.hi")[i], F.lit(0.0)) for i in range(d)]
    return _sum([g * g for g in gaps])


def _across(d: int, a: str, b: str) -> Column:
    """The largest squared distance between points of two boxes."""
    gaps = [F.greatest(F.abs(F.col(f"{a}.hi")[i] - F.col(f"{b}.lo")[i]), F.abs(F.col(f"{b}.hi")[i] - F.col(f"{a}.lo")[i])) for i in range(d)]
    return _sum([g * g for g in gaps])


def _squared(d: int, x: Column, y: Column) -> Column:
    return _sum([(x[i] - y[i]) * (x[i] - y[i]) for i in range(d)])


def _boxes(points: DataFrame, d: int, by: list[str]) -> DataFrame:
    """(by, box, n): the box around the points of each group, and its weight."""
    box = F.struct(F.array(*(F.min(F.col("x")[i]) for i in range(d))).alias("lo"), F.array(*(F.max(F.col("x")[i]) for i in range(d))).alias("hi"))
    return points.groupBy(*by).agg(box.alias("box"), F.sum("weight").alias("n"), F.count("*").alias("points"))


def neighbours(cells: DataFrame, d: int, eps: float) -> DataFrame:
    """(a, b, certain) of the cells(cell, box) whose boxes come within eps, both ways, but not each with itself; certain if all their points do."""
    axes = range(min(d, GRID))
    corner = [F.floor(F.col("box.lo")[i] / F.lit(2 * eps)) for i in axes]
    left = cells.select(F.col("cell").alias("a"), F.col("box").alias("p"), *(c.alias(f"g{i}") for i, c in zip(axes, corner, strict=True)))
    right = cells.select(F.col("cell").alias("b"), F.col("box").alias("q"), *(c.alias(f"g{i}") for i, c in zip(axes, corner, strict=True)))
    for i in axes:
        # boxes are no wider than eps, so corners of close ones are no further apart than 2 eps
        right = right.withColumn(f"g{i}", F.explode(F.sequence(F.col(f"g{i}") - 1, F.col(f"g{i}") + 1)))
    near = left.join(right, [f"g{i}" for i in axes]).where((F.col("a") != F.col("b")) & (_apart(d, "p", "q") <= eps * eps))
    return near.select("a", "b", (_across(d, "p", "q") <= eps * eps).alias("certain"))


def reached(asked: DataFrame, points: DataFrame, near: DataFrame, cells: DataFrame, d: int, eps: float) -> DataFrame:
    """(pid, theirs): for the points asked(pid, x, cell), the rows of other cells within eps, if there are any."""
    at = F.struct(F.col("x").alias("lo"), F.col("x").alias("hi"))
    other = cells.select(F.col("cell").alias("b"), F.col("box").alias("q"), F.col("n").alias("theirs"))
    met = asked.join(near, asked["cell"] == near["a"]).join(other, "b").withColumn("p", at).where(_apart(d, "p", "q") <= eps * eps)
    met = checkpointed(met.select("pid", "x", "b", F.when(_across(d, "p", "q") <= eps * eps, F.col("theirs")).alias("theirs")))
    theirs = points.select(F.col("cell").alias("b"), F.col("x").alias("y"), F.col("weight").alias("theirs"))
    looked = met.where("theirs is null").drop("theirs").join(theirs, "b").where(_squared(d, F.col("x"), F.col("y")) <= eps * eps).select("pid", "theirs")
    return met.where("theirs is not null").select("pid", "theirs").unionByName(looked).groupBy("pid").agg(F.sum("theirs").alias("theirs"))


def core_points(points: DataFrame, near: DataFrame, cells: DataFrame, d: int, eps: float, min_samples: int) -> DataFrame:
    """The points(pid, x, weight, cell) with min_samples rows within eps, themselves included."""
    known = points.join(cells.select("cell", "n"), "cell")
    sparse = known.where(F.col("n") < min_samples)
    counted = reached(sparse.select("pid", "x", "cell"), points, near, cells, d, eps)
    enough = sparse.join(counted, "pid", "left").where(F.col("n") + F.coalesce("theirs", F.lit(0)) >= min_samples)
    return known.where(F.col("n") >= min_samples).select("pid", "x", "weight", "cell").unionByName(enough.select("pid", "x", "weight", "cell"))


def linked_cells(core: DataFrame, near: DataFrame, d: int, eps: float, width: float) -> DataFrame:
    """(a, b), a < b: the neighbouring cells that have core points within eps of each other."""
    level = 0
    boxes = checkpointed(_boxes(core.withColumn("sub", F.array().cast("array<bigint>")), d, ["cell", "sub"]))
    side = lambda name, cell: boxes.select(F.col("cell").alias(cell), F.col("sub").alias(f"{cell}_sub"), F.col("box").alias(name), F.col("points").alias(f"{cell}_points"))
    open_ = near.where("a < b").select("a", "b", F.array().cast("array<bigint>").alias("a_sub"), F.array().cast("array<bigint>").alias("b_sub"))
    done = None
    while True:
        pairs = open_.join(side("p", "a"), ["a", "a_sub"]).join(side("q", "b"), ["b", "b_sub"]).where(_apart(d, "p", "q") <= eps * eps)
        pairs = checkpointed(pairs.select("a", "b", "a_sub", "b_sub", (_across(d, "p", "q") <= eps * eps).alias("certain"), (F.col("a_points") * F.col("b_points")).alias("size")))
        found = pairs.where("certain").select("a", "b").distinct()
        left = pairs.join(found, ["a", "b"], "left_anti")
        few = left.where(F.col("size") <= COMPARED)
        points = core.withColumn("sub", _sub(level, d, width))
        listed = points.groupBy("cell", "sub").agg(F.collect_list("x").alias("xs"))
        both = few.join(listed.select(F.col("cell").alias("a"), F.col("sub").alias("a_sub"), F.col("xs").alias("us")), ["a", "a_sub"]).join(listed.select(F.col("cell").alias("b"), F.col("sub").alias("b_sub"), F.col("xs").alias("vs")), ["b", "b_sub"])
        touch = both.where(F.exists("us", lambda u: F.exists("vs", lambda v: _squared(d, u, v) <= eps * eps))).select("a", "b")
        found = checkpointed(found.unionByName(touch).distinct())
        done = found if done is None else done.unionByName(found)
        left = checkpointed(left.where(F.col("size") > COMPARED).join(found, ["a", "b"], "left_anti").select("a", "b", "a_sub", "b_sub"))
        if left.isEmpty():
            return done
        # halve every box that is still in question
        level += 1
        asked = left.select(F.col("a").alias("cell")).union(left.select("b")).distinct()
        finer = core.join(asked, "cell", "left_semi").withColumn("above", _sub(level - 1, d, width)).withColumn("sub", _sub(level, d, width))
        boxes = checkpointed(_boxes(finer, d, ["cell", "above", "sub"]))
        child = lambda cell: boxes.select(F.col("cell").alias(cell), F.col("above").alias(f"{cell}_sub"), F.col("sub").alias(f"{cell}_next"))
        open_ = left.join(child("a"), ["a", "a_sub"]).join(child("b"), ["b", "b_sub"]).select("a", "b", F.col("a_next").alias("a_sub"), F.col("b_next").alias("b_sub"))


def _sub(level: int, d: int, width: float) -> Column:
    """The part of its cell in which a point is, cells being halved `level` times."""
    if not level:
        return F.array().cast("array<bigint>")
    return F.array(*(F.floor(F.col("x")[i] / F.lit(width) * F.lit(2.0**level)) for i in range(d)))


def least_linked(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(cell, root): the smallest id of the nodes(cell, id) that each reaches over links(a, b)."""
    ids = [nodes.select(F.col("cell").alias(c), F.col("id").alias(i)) for c, i in (("a", "u"), ("b", "v"))]
    edges = links.join(ids[0], "a").join(ids[1], "b").select("u", "v")
    edges = checkpointed(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))))
    parent = checkpointed(nodes.select(F.col("id").alias("u"), F.col("id").alias("p")))
    while True:
        of = [parent.select(F.col("u").alias(n), F.col("p").alias(f"p{n}")) for n in "uv"]
        crossing = edges.join(of[0], "u").join(of[1], "v").where("pu > pv").select(F.explode(F.array(F.struct(F.col("pu").alias("u"), F.col("pv").alias("p")), F.struct("u", F.col("pv").alias("p")))).alias("h"))
        hooked = checkpointed(parent.unionByName(crossing.select("h.*")).groupBy("u").agg(F.min("p").alias("p")))
        up = hooked.select(F.col("u").alias("p"), F.col("p").alias("r"))
        new = checkpointed(hooked.join(up, "p").select("u", F.least("p", "r").alias("p")))
        if new.join(parent.withColumnRenamed("p", "old"), "u").where("p <> old").isEmpty():
            return nodes.join(new.select(F.col("u").alias("id"), F.col("p").alias("root")), "id").select("cell", "root")
        parent = new


def _celled(df: DataFrame, cols: list[str], eps: float) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, float]:
    """Rows (id, x), the distinct points, their cells, which cells are near each other, and the width of a cell."""
    if eps <= 0:
        raise ValueError("eps must be positive")
    d = len(cols)
    # a little less, so that rounding leaves all points of a cell within eps
    width = eps / math.sqrt(d) * (1 - 1e-9)
    rows = clean(df).select(ROW, *cols).na.drop("any").select(ROW, F.array(*(F.col(f"`{c}`").cast("double") + 0.0 for c in cols)).alias("x"))
    merged = rows.groupBy("x").agg(F.min(ROW).alias("pid"), F.count("*").alias("weight"))
    points = checkpointed(merged.withColumn("cell", F.array(*(F.floor(F.col("x")[i] / F.lit(width)) for i in range(d)))))
    cells = checkpointed(_boxes(points, d, ["cell"]))
    return rows, points, cells, checkpointed(neighbours(cells, d, eps)), width


def neighbour_counts(df: DataFrame, eps: float) -> DataFrame:
    """(row id, n): how many rows are within eps of each row without a missing value, itself included."""
    df = with_row_id(df)
    cols = numeric(df)
    rows, points, cells, near, _ = _celled(df, cols, eps)
    counted = points.join(cells.select("cell", "n"), "cell").join(reached(points.select("pid", "x", "cell"), points, near, cells, len(cols), eps), "pid", "left")
    return rows.join(counted.select("x", (F.col("n") + F.coalesce("theirs", F.lit(0))).alias("n")), "x").select(ROW, "n")


def dbscan(df: DataFrame, eps: float = 0.5, min_samples: int = 5) -> DataFrame:
    """Clusters are numbered by their first core row, noise is -1; a border row goes to the first cluster that reaches it."""
    df = with_row_id(df)
    cols = numeric(df)
    d = len(cols)
    if not cols:
        return df.select(ROW, F.lit(-1).alias("label"))
    rows, points, cells, near, width = _celled(df, cols, eps)
    core = checkpointed(core_points(points, near, cells, d, eps, min_samples))
    own = checkpointed(_boxes(core, d, ["cell"]).join(core.groupBy("cell").agg(F.min("pid").alias("id")), "cell"))
    between = near.join(own.select(F.col("cell").alias("a")), "a", "left_semi").join(own.select(F.col("cell").alias("b")), "b", "left_semi")
    root = checkpointed(least_linked(own.select("cell", "id"), linked_cells(core, between.select("a", "b"), d, eps, width)))
    # border points: in the cell of a core point, or within eps of one of another cell
    others = points.join(core.select("pid"), "pid", "left_anti").select("pid", "x", "cell")
    inside = others.join(root, "cell").select("pid", "root")
    reach = near.join(root.select(F.col("cell").alias("b"), "root"), "b").join(own.select(F.col("cell").alias("b"), F.col("box").alias("q")), "b")
    asked = others.join(reach, others["cell"] == reach["a"]).withColumn("p", F.struct(F.col("x").alias("lo"), F.col("x").alias("hi"))).where(_apart(d, "p", "q") <= eps * eps)
    theirs = core.select(F.col("cell").alias("b"), F.col("x").alias("y"))
    sure = _across(d, "p", "q") <= eps * eps
    looked = asked.where(~sure).select("pid", "x", "b", "root").join(theirs, "b").where(_squared(d, F.col("x"), F.col("y")) <= eps * eps).select("pid", "root")
    border = inside.unionByName(asked.where(sure).select("pid", "root")).unionByName(looked).groupBy("pid").agg(F.min("root").alias("root"))
    labelled = checkpointed(core.join(root, "cell").select("pid", "root").unionByName(border))
    number = root.select("root").distinct().select("root", (F.row_number().over(Window.orderBy("root")) - 1).alias("label"))  # a row for each cluster
    named = points.join(labelled, "pid").join(number, "root").select("x", "label")
    return df.select(ROW).join(rows.join(named, "x").select(ROW, "label"), ROW, "left").select(ROW, F.coalesce("label", F.lit(-1)).alias("label"))
