"""An adaptive grid for line and polygon work: cells that many segments and edges share are split.

The plane is cut into square cells. Where more than ``PAIRS`` pairs of a segment and an edge would meet in one cell, it
is split into quarters, these again, and so on; a cell is named by its level and its whole-number
place. Splitting follows the data: one aggregate a level counts both sides, a level without crowded cells is the last. What is still crowded
at the last level (many lines through one point) is dealt by a salt: segments to one of k parts, edges to all.

The cover of a polygon says for every cell whether its reference point lies inside:

- cells that no edge passes are wholly inside or outside; the inside ones are runs of a row of cells, held as cells
  and as blocks of ``BLOCK`` cells, so that their number grows with the boundary and not with the area;
- in a border cell a point is inside if the reference point is, changed by each edge that the way from the point to the
  reference point crosses: along x, then along y, both inside the cell. So only that cell's edges take part.

Edges on the way are counted by half-open rules that see a point on the boundary as moved by a hair to +x and +y.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage_table

#: Pairs that may meet in one cell, the deepest level, cells of a block, and how far along each side the reference point lies:
#: an irrational share, so that borders on round coordinates never pass it.
PAIRS, LEVELS, BLOCK, REFERENCE = 1 << 20, 10, 32, 0.5 + 2 ** 0.5 / 100
PLACE = ["_lv", "_ix", "_iy"]
EDGE = ["ex1", "ey1", "ex2", "ey2"]


def _rows_in_slab(ends: list[Column], left: Column, right: Column, cell: Column | float) -> tuple[Column, Column]:
    """First and last row of cells that a segment passes between two x values; padded by a hair, so that points
    on the borders of cells are never lost."""
    ax, ay, bx, by = ends
    slope = F.try_divide(by - ay, bx - ax)
    upright = ax == bx
    ya = F.when(upright, F.least(ay, by)).otherwise(ay + (F.greatest(F.least(ax, bx), left) - ax) * slope)
    yb = F.when(upright, F.greatest(ay, by)).otherwise(ay + (F.least(F.greatest(ax, bx), right) - ax) * slope)
    pad = cell * 1e-9
    return F.floor((F.least(ya, yb) - pad) / cell), F.floor((F.greatest(ya, yb) + pad) / cell)


def cells(df: DataFrame, x1: str, y1: str, x2: str, y2: str, cell: float) -> DataFrame:
    """The level 0 cells that a segment passes (not its whole box): for each column of cells the rows between its
    y values at the column's borders. Linear in the segment's length."""
    ends = [F.col(c) for c in (x1, y1, x2, y2)]
    ax, _, bx, _ = ends
    out = df.withColumn("_lv", F.lit(0)).withColumn(
        "_ix", F.explode(F.sequence(F.floor(F.least(ax, bx) / cell), F.floor(F.greatest(ax, bx) / cell))))
    low, high = _rows_in_slab(ends, F.col("_ix") * cell, (F.col("_ix") + 1) * cell, cell)
    return out.withColumn("_iy", F.explode(F.sequence(low, high)))


def _quarters(inside) -> Column:
    """The quarters of the row's cell for which ``inside(ix, iy)`` holds."""
    at = [F.struct((F.col("_lv") + 1).alias("_lv"), (F.col("_ix") * 2 + dx).alias("_ix"), (F.col("_iy") * 2 + dy).alias("_iy"))
          for dx in (0, 1) for dy in (0, 1)]
    return F.filter(F.array(*at), lambda q: inside(q["_ix"], q["_iy"]))


def _passed(ends: list[str], cell: float):
    """Whether the segment passes a cell of this size."""
    cols = [F.col(c) for c in ends]
    ax, _, bx, _ = cols

    def inside(ix: Column, iy: Column) -> Column:
        low, high = _rows_in_slab(cols, ix * cell, (ix + 1) * cell, cell)
        return (F.floor(F.least(ax, bx) / cell) <= ix) & (F.floor(F.greatest(ax, bx) / cell) >= ix) & iy.between(low, high)
    return inside


class Grid:
    """The crowded cells of some segments and edges, level by level, and the placing of rows by them."""

    def __init__(self, segments: DataFrame, edges: DataFrame, cell: float, pairs: int = PAIRS, levels: int = LEVELS):
        """``segments`` have x1, y1, x2, y2, ``edges`` have ex1, ey1, ex2, ey2; both may have any other columns."""
        self.cell, self.crowded, self.salted = cell, [], None
        s = cells(segments.select("x1", "y1", "x2", "y2"), "x1", "y1", "x2", "y2", cell)
        e = cells(edges.select(*EDGE), *EDGE, cell)
        for level in range(levels + 1):
            both = s.select(*PLACE, F.lit(1).alias("s"), F.lit(0).alias("e")).unionAll(
                e.select(*PLACE, F.lit(0).alias("s"), F.lit(1).alias("e")))
            counts = both.where(F.col("_lv") == level).groupBy(*PLACE).agg(F.sum("s").alias("s"), F.sum("e").alias("e"))
            meet = F.col("s") * F.col("e")
            parts = F.least(F.ceil(meet / pairs), F.col("s")).alias("_k")
            found = stage_table(counts.where(meet > pairs).select(*PLACE, parts), "crowded")
            if found.isEmpty():
                return
            if level == levels:
                self.salted = found
                return
            self.crowded.append(found.select(*PLACE, F.lit(True).alias("_split")))
            s = self._step(s, level, ["x1", "y1", "x2", "y2"], only=True)
            e = self._step(e, level, EDGE, only=True)

    def _step(self, df: DataFrame, level: int, ends: list[str], only: bool = False) -> DataFrame:
        """Rows in the crowded cells of a level move to the quarters that they pass."""
        small = self.cell / 2 ** (level + 1)
        inside = _passed(ends, small) if len(ends) == 4 else (
            lambda ix, iy: (ix == F.floor(F.col(ends[0]) / small)) & (iy == F.floor(F.col(ends[1]) / small)))
        rest = [c for c in df.columns if c not in PLACE]
        marked = df.join(self.crowded[level], PLACE, "inner" if only else "left")
        stay = F.array(F.struct(*PLACE))
        to = F.when(F.col("_split"), _quarters(inside)).otherwise(stay)
        return marked.select(*rest, F.explode(to).alias("_to")).select(*rest, "_to.*")

    def _deal(self, df: DataFrame, by: list[str] | None) -> DataFrame:
        """``_salt``: in cells crowded to the last, rows go to the part that ``by`` says, or (None) to all parts."""
        if self.salted is None:
            return df.withColumn("_salt", F.lit(0))
        marked = df.join(self.salted, PLACE, "left")
        k = F.coalesce(F.col("_k"), F.lit(1))
        salt = F.pmod(F.xxhash64(*by), k).cast("int") if by else F.explode(F.sequence(F.lit(0), k.cast("int") - 1))
        return marked.withColumn("_salt", salt).drop("_k")

    def place(self, df: DataFrame, ends: list[str], by: list[str] | None) -> DataFrame:
        """``df`` in the leaf cells that its segments (4 columns) pass or its points (2 columns) lie in.

        Adds ``_lv``, ``_ix``, ``_iy`` and ``_salt``; ``by`` names the columns that deal a row to a salt, None copies it to all.
        """
        if len(ends) == 4:
            df = cells(df, *ends, self.cell)
        else:
            df = df.withColumn("_lv", F.lit(0)).withColumn("_ix", F.floor(F.col(ends[0]) / self.cell)).withColumn(
                "_iy", F.floor(F.col(ends[1]) / self.cell))
        for level in range(len(self.crowded)):
            df = self._step(df, level, ends)
        return self._deal(df, by)

    def _reference(self, ix: Column, iy: Column, level: Column | int = 0) -> tuple[Column, Column]:
        size = F.lit(self.cell) / F.pow(F.lit(2.0), F.lit(level) if isinstance(level, int) else level)
        return (ix + REFERENCE) * size, (iy + REFERENCE) * size

    def cover(self, edges: DataFrame, key: list[str]) -> DataFrame:
        """What decides for a point whether it is inside: (``_lv``, ``_ix``, ``_iy``, ``_salt``, key, edge columns).

        Rows with null edge columns count one: border cells whose reference point is inside, and cells and blocks
        (level -1) wholly inside. Rows with an edge count as ``changes`` says. A point is inside the polygons for which the sum
        over the rows of its ``looked_up`` cells is odd.
        """
        placed = cells(edges, *EDGE, self.cell)
        cx, cy = self._reference(F.col("_ix"), F.col("_iy"))
        at = F.col("ex1") + F.try_divide((cy - F.col("ey1")) * (F.col("ex2") - F.col("ex1")), F.col("ey2") - F.col("ey1"))
        at = F.greatest(F.least("ex1", "ex2"), F.least(F.greatest("ex1", "ex2"), at))
        here = F.coalesce(((F.col("ey1") > cy) != (F.col("ey2") > cy)) & (F.floor(at / self.cell) == F.col("_ix")), F.lit(False))
        border = placed.groupBy(*key, "_ix", "_iy").agg(
            F.count_if(here).alias("here"), F.count_if(here & (at > cx)).alias("right"))
        row = Window.partitionBy(*key, "_iy").orderBy(F.desc("_ix"))
        beyond = F.coalesce(F.sum("here").over(row.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        border = border.withColumn("beyond", beyond).withColumn("next", F.lag("_ix").over(row))
        # Both kinds of cells wholly or by reference inside, from one pass over the border cells of a row.
        a, z = F.col("_ix") + 1, F.col("next") - 1
        first, last = F.ceil(a / BLOCK), F.floor((z + 1) / BLOCK) - 1
        blocks = first <= last
        none = F.expr("cast(array() as array<bigint>)")

        def span(low: Column, high: Column) -> Column:
            return F.when(low <= high, F.sequence(low, high)).otherwise(none)

        def named(places: Column, level: int) -> Column:
            return F.transform(places, lambda i: F.struct(F.lit(level).alias("_lv"), i.alias("_ix")))

        alone = F.when(blocks, F.concat(span(a, first * BLOCK - 1), span((last + 1) * BLOCK, z))).otherwise(span(a, z))
        run = (F.col("beyond") % 2 == 1) & F.col("next").isNotNull()
        own = F.when((F.col("right") + F.col("beyond")) % 2 == 1, F.array("_ix")).otherwise(none)
        inside = F.concat(
            F.transform(own, lambda i: F.struct(F.lit(0).alias("_lv"), i.alias("_ix"), F.lit(True).alias("border"))),
            *[F.transform(named(F.when(run, places).otherwise(none), level),
                          lambda c: F.struct(c["_lv"], c["_ix"], F.lit(False).alias("border")))
              for places, level in ((alone, 0), (F.when(blocks, span(first, last)).otherwise(none), -1))])
        found = border.select(*key, "_iy", F.explode(inside).alias("c")).select(*key, "c.*", "_iy")
        if not self.crowded:
            refs = found.drop("border")
        else:
            refs = self._refine(found, placed, key)
        for level in range(len(self.crowded)):
            placed = self._step(placed, level, EDGE)
        nothing = [F.lit(None).cast("double").alias(c) for c in EDGE]
        return self._deal(refs.select(*PLACE, *key, *nothing).unionByName(placed.select(*PLACE, *key, *EDGE)), None)

    def _refine(self, found: DataFrame, placed: DataFrame, key: list[str]) -> DataFrame:
        """The reference points of split cells, from their parents' and the edges on the way."""
        found = stage_table(found, "cover")
        kept, open_ = [found.where("NOT border").select(*key, *PLACE)], found.where("border").select(*key, *PLACE)
        for level, crowded in enumerate(self.crowded):
            marked = open_.join(crowded, PLACE, "left")
            kept.append(marked.where(F.col("_split").isNull()).select(*key, *PLACE))
            to = F.explode(_quarters(lambda ix, iy: F.lit(True))).alias("q")
            parents = marked.where("_split").select(*key, to, F.lit(1).alias("change"))
            edges = placed.where(F.col("_lv") == level).join(crowded, PLACE)
            mx, my = self._reference(F.col("q._ix"), F.col("q._iy"), level + 1)
            edges = edges.select(*key, *EDGE, F.col("_ix").alias("px"), F.col("_iy").alias("py"), to)
            change = self.changes(mx, my, *self._reference(F.col("px"), F.col("py"), level))
            moved = parents.unionByName(edges.select(*key, "q", change.alias("change")).where("change > 0"))
            open_ = moved.groupBy(*key, "q").agg(F.sum("change").alias("n")).where("n % 2 = 1").select(*key, "q.*")
            if level + 1 < len(self.crowded):
                open_ = stage_table(open_, "cover")
                placed = self._step(placed, level, EDGE)
        out = open_.select(*key, *PLACE)
        for part in kept:
            out = out.unionByName(part)
        return out

    @staticmethod
    def changes(mx: Column, my: Column, cx: Column, cy: Column) -> Column:
        """How often the row's edge (none: once) is crossed on the way from (mx, my) to (cx, cy): along x, then y."""
        ex1, ey1, ex2, ey2 = (F.col(c) for c in EDGE)
        x = ex1 + F.try_divide((my - ey1) * (ex2 - ex1), ey2 - ey1)
        y = ey1 + F.try_divide((cx - ex1) * (ey2 - ey1), ex2 - ex1)
        along = ((ey1 > my) != (ey2 > my)) & (x > F.least(mx, cx)) & (x <= F.greatest(mx, cx))
        up = ((ex1 > cx) != (ex2 > cx)) & (y > F.least(my, cy)) & (y <= F.greatest(my, cy))
        one = lambda c: F.when(c, 1).otherwise(0)
        return F.when(ex1.isNull(), 1).otherwise(one(along) + one(up))

    def looked_up(self, points: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
        """Points once for each place of the cover that may decide on them, with the reference point (``_cx``, ``_cy``)."""
        placed = self.place(points, [x, y], by)
        cx, cy = self._reference(F.col("_ix"), F.col("_iy"), F.col("_lv"))
        none = F.lit(0).alias("_salt")  # only leaf cells are salted
        base = F.struct(F.lit(0).alias("_lv"), F.floor(F.col(x) / self.cell).alias("_ix"), F.floor(F.col(y) / self.cell).alias("_iy"), none)
        own = F.struct(*PLACE, F.col("_salt").cast("int").alias("_salt"))
        block = F.struct(F.lit(-1).alias("_lv"), F.floor(base["_ix"] / BLOCK).alias("_ix"), base["_iy"].alias("_iy"), none)
        where = F.array(block, own) if not self.crowded else F.when(
            F.col("_lv") == 0, F.array(block, own)).otherwise(F.array(block, base, own))
        rest = [*points.columns, "_cx", "_cy"]
        return placed.withColumn("_cx", cx).withColumn("_cy", cy).select(*rest, F.explode(where).alias("_at")).select(*rest, "_at.*")
