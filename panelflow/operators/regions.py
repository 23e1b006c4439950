"""Region QA: normalise, filter by confidence, report and remove near copies."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelflow.functions.color import parse_hex, rgb
from panelflow.functions.geometry import EDGES, area, with_pixel_box
from panelflow.functions.values import clamp, is_finite, or_zero, strip_space, zero_means_default
from panelflow.operators.components import connected_components
from panelflow.operators.folds import ordered_fold
from panelflow.session import materialize
from panelflow.schemas import MIN_CONFIDENCE, REGION_FIELDS

# Fixed value: two regions of one image are copies from this overlap on.
COPY_OVERLAP = 0.72
# Images of more regions are taken apart into components; the others are worked on as one array each.
CROWDED = 64
_KINDS = dict((column, kind) for _, column, kind in REGION_FIELDS)["region_kind"]


def _counted_confidence() -> Column:
    """A null confidence counts as 0, a missing one not at all."""
    value = F.when(F.col("has_confidence"), F.coalesce(F.col("confidence"), F.lit(0.0)))
    return F.when(is_finite(value), value)


def reliable(minimum: float = MIN_CONFIDENCE) -> Column:
    return F.coalesce(_counted_confidence() >= minimum, F.lit(False))


def split_reliable(regions: DataFrame, minimum: float = MIN_CONFIDENCE) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected), each with its rows unchanged."""
    return regions.where(reliable(minimum)), regions.where(~reliable(minimum))


def average_confidence() -> Column:
    """Aggregate: mean confidence of a group, null when nothing counts."""
    return F.avg(_counted_confidence())


def normalize_regions(regions: DataFrame, image_width: Column, image_height: Column) -> DataFrame:
    """Pixel regions; rows without a usable box or translation drop out."""
    own = F.col("__own")
    layout = F.col("__layout")
    black, white = rgb(17, 17, 17), rgb(255, 255, 255)
    height = image_height.cast("double")
    usable = regions.where(strip_space(F.coalesce("translated", F.lit(""))) != "")
    usable = with_pixel_box(usable, "box", "__own", image_width, image_height).where("__own is not null")
    boxed = (
        with_pixel_box(usable, "layout_box", "__found", image_width, image_height)
        .withColumn(
            "region_kind",
            F.when(F.col("region_kind").isin(*_KINDS), F.col("region_kind"))
            .when(F.col("background_complex"), "label").otherwise("dialogue"),
        )
        .withColumn(
            "has_layout_box",
            F.col("__found").isNotNull()
            & ~(F.col("region_kind").isin("dialogue", "narration") & (area(F.col("__found")) < area(own) * 0.68)),
        )
        .withColumn("__layout", F.when(F.col("has_layout_box"), F.col("__found")).otherwise(own))
    )
    default_size = (own["bottom"] - own["top"]) / height * 820
    background = parse_hex(F.col("background_color"), white)
    return boxed.select(
        *[c for c in regions.columns if c not in ("translated", "region_kind", "font_size", "rotation")],
        strip_space(F.col("translated")).alias("translated"),
        "region_kind",
        *[own[e].alias(e) for e in EDGES],
        "has_layout_box",
        *[layout[e].alias(f"layout_{e}") for e in EDGES],
        F.col("font_size"),
        clamp(
            zero_means_default(F.col("font_size"), default_size) / 1000 * height, 7.0, 240.0
        ).alias("font_px"),
        parse_hex(F.col("text_color"), black).alias("text_rgb"),
        background.alias("background_rgb"),
        parse_hex(F.col("stroke_color"), background).alias("stroke_rgb"),
        (clamp(or_zero(F.col("stroke_width")), 0.0, 1000.0) / 1000 * height).alias("stroke_px"),
        clamp(or_zero(F.col("rotation")), -180.0, 180.0).alias("rotation"),
    )


# ---------------------------------------------------------------- near copies

def _spread(low: Column, high: Column, least: Column, most: Column) -> Column:
    """Bins along one axis that may hold a partner of a box spanning low..high.

    Sizes are classed by powers of four and each class is cut into bins of its upper
    size. A partner is between 0.72 and 1/0.72 as long and starts at most 0.39 of the
    length away; both are widened for the slack inside one cell.
    """
    reach = most * 0.5

    def bins(k: Column) -> Column:
        side = F.pow(F.lit(4.0), k + 1)
        return F.transform(
            F.sequence(F.floor((low - reach) / side), F.floor((high + reach) / side)),
            lambda c: F.struct(k.cast("bigint").alias("k"), c.cast("bigint").alias("c")),
        )

    return F.flatten(F.transform(F.sequence(_size_class(least * 0.65), _size_class(most / 0.65)), bins))


def _size_class(size: Column) -> Column:
    return F.floor(F.log(F.greatest(size, F.lit(1e-6))) / F.log(F.lit(4.0)) + F.lit(1e-12)).cast("bigint")


def _home(start: Column, size: Column) -> Column:
    k = _size_class(size)
    return F.struct(k.alias("k"), F.floor(start / F.pow(F.lit(4.0), k + 1)).cast("bigint").alias("c"))


def _close_cells(cells: DataFrame, key: str) -> DataFrame:
    """Pairs of cells of one image that may hold copies of each other.

    ``cells`` has ``key``, ``cell`` (a number unique in its image) and the range of each
    edge (``left_min``...). Partners are found by equal bins, never by all pairs.
    ``certain`` says that every box of one cell copies every box of the other.
    """
    size_x = F.col("right_min") - F.col("left_min")
    size_y = F.col("bottom_min") - F.col("top_min")
    ranges = [f"{e}_{m}" for e in EDGES for m in ("min", "max")]
    homes = cells.select(
        key, F.col("cell").alias("b"), *[F.col(r).alias(f"b_{r}") for r in ranges],
        _home(F.col("left_min"), size_x).alias("__x"), _home(F.col("top_min"), size_y).alias("__y"),
    )
    probes = cells.select(
        key, F.col("cell").alias("a"), *[F.col(r).alias(f"a_{r}") for r in ranges],
        F.explode(_spread(F.col("left_min"), F.col("left_max"), F.col("right_min") - F.col("left_max"),
                          F.col("right_max") - F.col("left_min"))).alias("__x"),
        _spread(F.col("top_min"), F.col("top_max"), F.col("bottom_min") - F.col("top_max"),
                F.col("bottom_max") - F.col("top_min")).alias("__ys"),
    ).withColumn("__y", F.explode("__ys")).drop("__ys")

    def shared(outer: str, inner: str) -> Column:
        def span(near: str, far: str) -> Column:
            return F.greatest(F.lit(0), F.least(F.col(f"a_{far}_{outer}"), F.col(f"b_{far}_{outer}"))
                              - F.greatest(F.col(f"a_{near}_{inner}"), F.col(f"b_{near}_{inner}")))
        return span("left", "right") * span("top", "bottom")

    def size(side: str, outer: str, inner: str) -> Column:
        return (F.col(f"{side}_right_{outer}") - F.col(f"{side}_left_{inner}")) * (
            F.col(f"{side}_bottom_{outer}") - F.col(f"{side}_top_{inner}"))

    most, least = shared("max", "min"), shared("min", "max")
    low_union = size("a", "min", "max") + size("b", "min", "max") - most
    highest = most / low_union
    lowest = least / (size("a", "max", "min") + size("b", "max", "min") - least)
    joined = probes.join(homes, [key, "__x", "__y"]).where("a < b")
    return joined.where((most > 0) & ((low_union <= 0) | (highest >= COPY_OVERLAP))).select(
        key, "a", "b", F.coalesce(lowest >= COPY_OVERLAP, F.lit(False)).alias("certain"),
        F.when(low_union > 0, lowest).alias("iou"),
    )


def _cell_step(size: Column) -> Column:
    """Grid step for an edge: between 1/64 and 1/32 of the box, a power of two."""
    return F.pow(F.lit(2.0), F.floor(F.log2(size)) - 5)


def _with_cells(rows: DataFrame) -> tuple[DataFrame, list[str]]:
    """Boxes whose edges all fall into the same fine grid cells get the same cell key;
    any two of them overlap by more than the copy limit."""
    step_x, step_y = _cell_step(F.col("right") - F.col("left")), _cell_step(F.col("bottom") - F.col("top"))
    cell = [
        step_x.alias("__sx"), step_y.alias("__sy"),
        F.floor(F.col("left") / step_x).alias("__l"), F.floor(F.col("right") / step_x).alias("__r"),
        F.floor(F.col("top") / step_y).alias("__t"), F.floor(F.col("bottom") / step_y).alias("__b"),
    ]
    return rows.select("*", *cell), ["__sx", "__sy", "__l", "__r", "__t", "__b"]


def overlap_report(regions: DataFrame, key: str = "image_id") -> DataFrame:
    """Per distinct box of an image: copies of itself and of boxes overlapping it by 0.72 or more.

    Equal boxes are counted before anything is joined, so copies never multiply.
    """
    boxes = materialize(
        regions.groupBy(key, *EDGES).agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("cell")), "boxes")
    ranged = boxes.select(
        key, "cell", *[F.col(e).cast("double").alias(f"{e}_{m}") for e in EDGES for m in ("min", "max")]
    )
    pairs = _close_cells(ranged, key)
    both = pairs.select(key, F.col("a").alias("cell"), F.col("b").alias("other"), "iou").unionByName(
        pairs.select(key, F.col("b").alias("cell"), F.col("a").alias("other"), "iou"))
    others = both.join(boxes.select(key, F.col("cell").alias("other"), F.col("n").alias("n_other")), [key, "other"])
    partners = others.groupBy(key, "cell").agg(F.sum("n_other").alias("n_near"), F.max("iou").alias("best_iou"))
    return boxes.join(partners, [key, "cell"], "left").select(
        key, *EDGES, F.col("n").alias("n_equal"), F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        "best_iou",
    )


def _bins(size: float, start: float) -> list[tuple[int, int]]:
    """Where along one axis a box may lie that overlaps one of this size and start by the copy limit.

    Such a box is between 0.72 and 1 / 0.72 as long, and starts within (1 / 0.72 - 1) lengths.
    """
    reach = size * (1 / COPY_OVERLAP - 1) * (1 + 1e-9)
    found = []
    for k in range(math.frexp(size * COPY_OVERLAP * (1 - 1e-9))[1], math.frexp(size / COPY_OVERLAP * (1 + 1e-9))[1] + 1):
        side = math.ldexp(1.0, k - 1)
        found += [(k, c) for c in range(math.floor((start - reach) / side), math.floor((start + reach) / side) + 1)]
    return found


def _bin(size: float, start: float) -> tuple[int, int]:
    k = math.frexp(size)[1]  # a bin is as wide as the shortest box of its class
    return k, math.floor(start / math.ldexp(1.0, k - 1))


class _KeepFirstCopy:
    """Slots in order of creation; a more confident copy takes over the first slot it overlaps.

    Slots are found by a spatial hash over size and place, so a row is held against its neighbours only.
    """

    def __init__(self, at: dict[str, int]):
        self.at = at
        self.slots: list[list] = []
        self.near: dict[tuple, set[int]] = {}

    def _home(self, left: float, top: float, right: float, bottom: float) -> tuple | None:
        """The slot's bins; none for boxes without area, which overlap nothing."""
        flat = not (right > left and bottom > top) or not all(map(math.isfinite, (left, top, right - left, bottom - top)))
        return None if flat else _bin(right - left, left) + _bin(bottom - top, top)

    def step(self, row: tuple) -> Iterator[tuple]:
        at = self.at
        left, top, right, bottom = (row[at[e]] for e in EDGES)
        ord_, confidence = row[at["ord"]], row[at["__confidence"]]
        size = (right - left) * (bottom - top)
        home = self._home(left, top, right, bottom)
        found = home and {n for x in _bins(right - left, left) for y in _bins(bottom - top, top) for n in self.near.get(x + y, ())}
        for number in sorted(found or ()):
            slot = self.slots[number]
            shared_x = min(right, slot[3]) - max(left, slot[1])
            shared_y = min(bottom, slot[4]) - max(top, slot[2])
            if shared_x <= 0 or shared_y <= 0:
                continue
            shared = shared_x * shared_y
            if shared / (size + slot[6] - shared) >= COPY_OVERLAP:
                if confidence > slot[5]:
                    self.near[self._home(*slot[1:5])].discard(number)
                    slot[1:] = [left, top, right, bottom, confidence, size, ord_]
                    self.near.setdefault(home, set()).add(number)
                return iter(())
        if home:
            self.near.setdefault(home, set()).add(len(self.slots))
        self.slots.append([ord_, left, top, right, bottom, confidence, size, ord_])
        return iter(())

    def finish(self) -> Iterator[tuple]:
        for slot in self.slots:
            yield slot[0], slot[7]


def _confidence() -> Column:
    return F.coalesce(F.when(~F.isnan("confidence"), F.col("confidence")), F.lit(0.0))


def dedup_regions(regions: DataFrame, key: str = "image_id", crowded: int = CROWDED) -> DataFrame:
    """Drop near copies (overlap >= 0.72) inside each image, in order of ``ord``.

    The first kept region that a newcomer overlaps is replaced in place when it is
    strictly less confident, else the newcomer goes. ``slot_ord`` gives the order of
    the kept rows.

    An image of up to ``crowded`` regions is one array, folded where its rows are
    grouped: rows are shuffled once and nothing else is written. Crowded images, and
    the few with boxes without area, are counted first and go by cells and components.
    """
    regions = regions.where(F.col(key).isNotNull())
    plain = F.col("ord").isNotNull() & (F.col("left") < F.col("right")) & (F.col("top") < F.col("bottom"))
    for e in EDGES:  # sums of two areas of such boxes are exact
        plain = plain & (F.abs(e) <= 2**25)
    others = materialize(
        regions.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min(F.coalesce(plain, F.lit(False))).alias("plain"))
        .where((F.col("n") > crowded) | ~F.col("plain")).select(F.col(key).alias("__key")), "crowded")
    if others.isEmpty():
        return _dedup_arrays(regions, key)
    is_other = F.col(key) == F.col("__key")
    return _dedup_arrays(regions.join(others, is_other, "left_anti"), key).unionByName(
        _dedup_components(regions.join(others, is_other, "left_semi"), key))


def _dedup_arrays(regions: DataFrame, key: str) -> DataFrame:
    """:func:`dedup_regions` of images with few regions, each an array of its rows."""
    rest = [c for c in regions.columns if c not in (key, "ord")]
    rows = regions.groupBy(key).agg(F.array_sort(
        F.collect_list(F.struct("ord", _confidence().alias("__confidence"), F.struct(*rest).alias("rest"))),
        lambda a, b: F.when(a["ord"] < b["ord"], -1).when(a["ord"] > b["ord"], 1).otherwise(0)).alias("rows"))

    def slot(row: Column, number: Column) -> Column:
        return F.struct(
            number.cast("bigint").alias("slot_ord"), row["ord"].alias("ord"), row["__confidence"].alias("confidence"),
            *[row["rest"][e].cast("double").alias(e) for e in EDGES])

    def copies(a: Column, b: Column) -> Column:
        shared_x = F.least(a["right"], b["right"]) - F.greatest(a["left"], b["left"])
        shared_y = F.least(a["bottom"], b["bottom"]) - F.greatest(a["top"], b["top"])
        shared = shared_x * shared_y
        return (shared_x > 0) & (shared_y > 0) & (shared / (area(a) + area(b) - shared) >= COPY_OVERLAP)

    def step(slots: Column, row: Column) -> Column:
        new = slot(row, row["ord"])

        def put(at: Column) -> Column:
            return F.when(at == 0, F.concat(slots, F.array(new))).when(
                F.get(slots, at - 1)["confidence"] >= row["__confidence"], slots
            ).otherwise(F.transform(slots, lambda s, i: F.when(i == at - 1, slot(row, s["slot_ord"])).otherwise(s)))

        return _once(F.array_position(F.transform(slots, lambda s: copies(new, s)), True).cast("int"), put)

    none = F.filter(F.transform("rows", lambda row: slot(row, row["ord"])), lambda s: F.lit(False))
    # a number that comes twice stands for all its rows
    kept = F.flatten(F.transform(F.aggregate("rows", none, step), lambda s: F.transform(
        F.filter("rows", lambda row: row["ord"] == s["ord"]), lambda row: F.struct(row["ord"].alias("ord"), row["rest"].alias("rest"), s["slot_ord"].alias("slot_ord")))))
    return rows.select(key, F.inline(kept)).select(key, "ord", "rest.*", "slot_ord")


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, not wherever it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _dedup_components(regions: DataFrame, key: str) -> DataFrame:
    """:func:`dedup_regions` of images with any number of regions.

    Equal and almost equal boxes are folded into cells on the map side. Cells that may
    touch form components; components never influence one another. Where all boxes of
    a component copy each other there is a single slot, and its winner is a plain
    aggregate, however many rows it has. Only the rest runs the ordered fold, one
    component per key.
    """
    rated = materialize(regions.select(key, "ord", *EDGES, _confidence().alias("__confidence")), "boxes")
    best = F.struct((-F.col("__confidence")).alias("c"), F.col("ord").alias("ord"))
    boxes = rated.groupBy(key, *EDGES).agg(F.min("ord").cast("bigint").alias("ord"), F.min(best).alias("__best"))
    boxes, cell_keys = _with_cells(boxes)
    cells = materialize(boxes.groupBy(key, *cell_keys).agg(
        F.min("ord").alias("cell"), F.min("__best").alias("__best"),
        *[f(e).cast("double").alias(f"{e}_{m}") for e in EDGES for m, f in (("min", F.min), ("max", F.max))],
    ), "cells")
    pairs = materialize(_close_cells(cells, key), "pairs")
    found = connected_components(
        pairs.select(F.col(key).alias("g"), F.col("a").alias("u"), F.col("b").alias("v"))
    ).select(F.col("g").alias(key), F.col("node").alias("cell"), "component")
    placed = (
        cells.select(key, *cell_keys, "cell", "__best").join(found, [key, "cell"], "left")
        .withColumn("component", F.coalesce("component", "cell"))
    )
    certain = (
        pairs.where("certain").select(key, F.col("a").alias("cell")).join(found, [key, "cell"])
        .groupBy(key, "component").agg(F.count(F.lit(1)).alias("n_certain"))
    )
    sizes = placed.groupBy(key, "component").agg(
        F.count(F.lit(1)).alias("n"), F.min("__best").alias("__winner"), F.min("cell").alias("slot_ord")
    ).join(certain, [key, "component"], "left")
    is_clique = F.coalesce("n_certain", F.lit(0)) * 2 == F.col("n") * (F.col("n") - 1)
    settled = sizes.where(is_clique).select(key, "slot_ord", F.col("__winner.ord").alias("ord"))

    tangled = placed.join(sizes.where(~is_clique).select(key, "component"), [key, "component"])
    rows, _ = _with_cells(rated)
    to_fold = rows.join(tangled.select(key, *cell_keys, "component"), [key, *cell_keys]).select(
        key, "component", "ord", *EDGES, "__confidence"
    )
    at = {c: i for i, c in enumerate(to_fold.columns)}
    types = dict(regions.dtypes)
    folded = ordered_fold(
        to_fold, [key, "component"], ["ord"], lambda: _KeepFirstCopy(at), ["slot_ord", "ord"],
        f"{key} {types[key]}, component bigint, slot_ord bigint, ord {types['ord']}",
    ).drop("component")
    kept = settled.unionByName(folded)
    return regions.join(kept, [key, "ord"])
