"""How many boxes every box overlaps, without pairs: inclusion and exclusion over dominance counts.

Two boxes of some area are apart if one ends before the other begins, along x or along y. Along one axis only one of
the two orders can hold, so of all boxes of a page those apart from a given one are

    ends left of it + begins right of it + ends above it + begins below it - the four corners counted twice.

Each of the eight is a count of points (u, v) with u and v no greater than the query's. The coordinates are whole
numbers, so the points below u are covered by one dyadic range for each set bit of u + 1; inside a range the count is
a running sum along v. A point lies in one range a bit, hence n boxes cost n log(side) rows and no page is one group:
running sums are cut into blocks along v.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelflow.operators.ordered import block_of, running_sum

BLOCK_SIDE = 256  # pixels along v of one block of a running sum


def dominance_counts(rows: DataFrame, keys: Sequence[str], out: str, block: int = BLOCK_SIDE) -> DataFrame:
    """(keys, u, v, weight, ask) -> rows with ``ask``, and ``out``: the weights of the key's other rows with u and v no greater.

    ``u`` and ``v`` are whole numbers from 0 and ``__bits`` (a column of ``rows``) is how many bits u + 1 may have. A row
    that asks has no weight. Rows may repeat; each row that asks must be told apart by its other columns, which all stay.
    """
    u = F.when(F.col("ask"), F.col("u") + 1).otherwise(F.col("u"))
    # a point stands at the left of a pair of ranges, a query asks the left one when it stands at the right
    levels = F.filter(F.sequence(F.lit(0), F.col("__bits") - 1),
                      lambda bit: (F.call_function("shiftright", u, bit) % 2) == F.col("ask").cast("bigint"))
    spread = rows.withColumn("__level", F.explode(levels)).withColumn(
        "__node", F.call_function("shiftright", u, F.col("__level")) - F.col("ask").cast("bigint"))
    summed = running_sum(
        spread.withColumn("__at", F.struct("v", "ask")), [*keys, "__level", "__node"], "__at",
        F.when(F.col("ask"), F.lit(0).cast("bigint")).otherwise(F.col("weight")), "__below", block_of("v", block))
    told = [c for c in rows.columns if c not in ("weight", "ask", "__bits")]
    return summed.where("ask").groupBy(*told).agg(F.sum("__below").alias(out))


def _corners(boxes: DataFrame, key: str) -> DataFrame:
    """Every box as eight points and eight queries: (key, kind, sign, box, u, v, weight, ask)."""
    x = {"ends": (F.col("right") - F.col("__x0"), F.col("left") - F.col("__x0")),
         "begins": (F.col("__x1") - F.col("left"), F.col("__x1") - F.col("right"))}
    y = {"ends": (F.col("bottom") - F.col("__y0"), F.col("top") - F.col("__y0")),
         "begins": (F.col("__y1") - F.col("top"), F.col("__y1") - F.col("bottom"))}
    zero = (F.lit(0).cast("bigint"),) * 2
    kinds = [(f"x {a}", 1, x[a], zero) for a in x] + [(f"y {b}", 1, y[b], zero) for b in y]
    kinds += [(f"x {a}, y {b}", -1, x[a], y[b]) for a in x for b in y]
    box = F.struct("left", "top", "right", "bottom")

    def row(kind: str, sign: int, u: tuple[Column, Column], v: tuple[Column, Column], ask: bool) -> Column:
        return F.struct(
            F.lit(kind).alias("kind"), F.lit(sign).alias("sign"), F.when(F.lit(ask), box).alias("box"), u[ask].alias("u"), v[ask].alias("v"),
            F.col("n").alias("weight"), F.lit(ask).alias("ask"))

    return boxes.select(key, "__bits", F.inline(F.array(*[row(*kind, ask) for kind in kinds for ask in (False, True)])))


def boxes_apart(boxes: DataFrame, key: str) -> DataFrame:
    """Distinct boxes (key, edges, n copies, page limits __x0 __y0 __x1 __y1) -> (key, edges, apart): boxes of the page that share no area with this one."""
    side = F.greatest(F.col("__x1") - F.col("__x0"), F.col("__y1") - F.col("__y0")) + 1
    rows = _corners(boxes.withColumn("__bits", F.length(F.bin(side))), key)
    points = rows.where(~F.col("ask")).groupBy(key, "__bits", "kind", "sign", "box", "u", "v", "ask").agg(F.sum("weight").alias("weight"))
    counted = dominance_counts(points.unionByName(rows.where("ask")), [key, "kind"], "below")
    return counted.groupBy(key, "box").agg(F.sum(F.col("sign") * F.col("below")).alias("apart")).select(key, "box.*", "apart")
