"""Crop and batch planning: group nearby regions, pack crops into bounded sheets."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelflow.functions import geometry as g
from panelflow.functions.values import clamp, half_up, strip_space
from panelflow.operators.dominance import boxes_apart
from panelflow.operators.folds import ordered_fold
from panelflow.operators.ordered import numbered
from panelflow.session import materialize

# What a merged crop may be at most.
MAX_MEMBERS = 3
MAX_WIDTH_SHARE, MAX_HEIGHT_SHARE, MAX_AREA_SHARE = 0.48, 0.38, 0.16
# A sheet holds up to four tiles in two columns, 32 pixels apart.
MAX_TILES, MAX_SIDE, GUTTER, MIN_GUTTER = 4, 4096, 32, 12

CHUNK = 4096
FEW = 8  # open groups that are all met without a look at the cells
CELL, CELLS = 512, 32  # pixels of a look-up cell at least, and cells along a page at most


def crop_candidates(regions: DataFrame, image_width: Column, image_height: Column, key: str = "image_id") -> DataFrame:
    """Each usable region with its padded box."""
    page = regions.where(strip_space(F.coalesce("translated", F.lit(""))) != "").select(
        key, "ord", image_width.alias("image_width"), image_height.alias("image_height"), "box", "layout_box")
    size = F.col("image_width"), F.col("image_height")
    found = g.with_pixel_box(g.with_pixel_box(page, "box", "__own", *size), "layout_box", "__layout", *size)
    boxed = found.where("__own is not null or __layout is not null").withColumn(
        "__c", g.union_box(F.col("__own"), F.col("__layout")))
    c, w, h = F.col("__c"), g.width(F.col("__c")), g.height(F.col("__c"))
    pad_x = half_up(clamp(F.greatest(F.lit(24), w * 0.65, h * 0.18), 24, F.col("image_width") * 0.14))
    pad_y = half_up(clamp(F.greatest(F.lit(24), h * 0.28, w * 0.18), 24, F.col("image_height") * 0.12))
    return boxed.select(
        key, "ord", "image_width", "image_height",
        F.greatest(F.lit(0), c["left"] - pad_x).cast("bigint").alias("left"),
        F.greatest(F.lit(0), c["top"] - pad_y).cast("bigint").alias("top"),
        F.least(F.col("image_width"), c["right"] + pad_x).cast("bigint").alias("right"),
        F.least(F.col("image_height"), c["bottom"] + pad_y).cast("bigint").alias("bottom"),
    )


class _MergeNearby:
    """Folds boxes into groups, newest group first, growing while scanning.

    A group that can never merge again (full, or already as large as allowed) is
    given out at once, so the state holds open groups only. They are looked up by the
    grid cells they touch, so a box meets only groups nearby.
    """

    def __init__(self, at: dict[str, int]):
        self.at = at
        self.open: dict[int, tuple] = {}
        self.cells: dict[tuple[int, int], set[int]] = {}
        self.next = 0

    @staticmethod
    def _fits(box: tuple, page: tuple) -> bool:
        w, h = box[2] - box[0], box[3] - box[1]
        return (
            w <= page[0] * MAX_WIDTH_SHARE and h <= page[1] * MAX_HEIGHT_SHARE
            and w * h <= page[0] * page[1] * MAX_AREA_SHARE
        )

    @staticmethod
    def _touched(box: tuple, page: tuple) -> Iterator[tuple[int, int]]:
        across, down = (max(CELL, -(-int(side) // CELLS)) for side in page)
        for x in range(box[0] // across, box[2] // across + 1):
            for y in range(box[1] // down, box[3] // down + 1):
                yield x, y

    def _near(self, box: tuple, page: tuple, below: int) -> set[int]:
        if len(self.open) <= FEW:
            return {i for i in self.open if i < below}
        near: set[int] = set()
        for cell in self._touched(box, page):
            near |= self.cells.get(cell, near)
        return {i for i in near if i < below}

    def step(self, row: tuple) -> Iterator[tuple]:
        at = self.at
        page = (row[at["image_width"]], row[at["image_height"]])
        box = tuple(row[at[e]] for e in g.EDGES)
        newest, members = row[at["ord"]], (row[at["ord"]],)
        if not self._fits(box, page):  # nor does anything that contains it
            yield newest, *box, list(members)
            return
        near = self._near(box, page, self.next)
        while near:
            index = max(near)
            near.discard(index)
            _, other, theirs = self.open[index]
            if (
                box[0] < other[2] and box[2] > other[0] and box[1] < other[3] and box[3] > other[1]
                and len(members) + len(theirs) <= MAX_MEMBERS
            ):
                joint = (min(box[0], other[0]), min(box[1], other[1]), max(box[2], other[2]), max(box[3], other[3]))
                if self._fits(joint, page):
                    box, members = joint, theirs + members
                    del self.open[index]
                    for cell in self._touched(other, page):
                        self.cells[cell].discard(index)
                    near |= self._near(box, page, index)
        if len(members) >= MAX_MEMBERS:
            yield newest, *box, list(members)
        else:
            self.open[self.next] = (newest, box, members)
            for cell in self._touched(box, page):
                self.cells.setdefault(cell, set()).add(self.next)
            self.next += 1

    def finish(self) -> Iterator[tuple]:
        for newest, box, members in self.open.values():
            yield newest, *box, list(members)


def _island(boxes: DataFrame, keys: list[str], low: str, high: str, out: str) -> DataFrame:
    """Number the stretches of an axis that boxes cover without a gap.

    Works on the distinct edge positions of an image, of which there are at most as
    many as pixels, so no window grows with the number of boxes.
    """
    marks = (
        boxes.select(*keys, F.col(low).alias("__at"), F.lit(1).alias("__d"))
        .unionByName(boxes.select(*keys, F.col(high).alias("__at"), F.lit(-1).alias("__d")))
        .groupBy(*keys, "__at").agg(F.sum("__d").alias("__d"))
    )
    along = Window.partitionBy(*keys).orderBy("__at")
    starts = marks.withColumn(
        "__open", F.coalesce(F.sum("__d").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ).select(
        *keys, F.col("__at").alias(low),
        F.max(F.when(F.col("__open") == 0, F.col("__at"))).over(along).alias(out),
    )
    return boxes.join(starts, [*keys, low])


def plan_crops(regions: DataFrame, image_width: Column, image_height: Column, key: str = "image_id") -> DataFrame:
    """(key, crop_index, left, top, right, bottom, members): crops from top to bottom.

    ``members`` are the ``ord`` of the up to three regions inside, in their order. Every image
    is cut along empty rows into islands, which cannot influence each other. An
    island of one box is a crop as it is; each of the others is one key of the fold.
    """
    # written first: the islands read them three times, and each time would work out all boxes again
    boxes = materialize(crop_candidates(regions, image_width, image_height, key), "candidates")
    keys = [key, "__island"]
    boxes = materialize(_island(boxes, [key], "top", "bottom", "__island"), "islands")
    types = dict(boxes.dtypes)
    whole = boxes.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct(F.col("ord").alias("newest"), *g.EDGES)).alias("__box"))
    single = whole.where("n = 1").select(*keys, "__box.*").withColumn("members", F.array("newest"))
    shared = boxes.join(whole.where("n > 1").select(*keys), keys, "left_semi").select(*boxes.columns)
    at = {c: i for i, c in enumerate(shared.columns)}
    folded = ordered_fold(
        shared, keys, ["ord"], lambda: _MergeNearby(at), ["newest", *g.EDGES, "members"],
        ", ".join([*(f"{k} {types[k]}" for k in keys), "newest bigint", *(f"{e} bigint" for e in g.EDGES), "members array<bigint>"]),
    )
    grouped = materialize(single.unionByName(folded).drop("__island"), "grouped")  # numbering reads it twice
    return numbered(grouped, [key], ["top", "left", "newest"], "crop_index", F.col("top")).select(
        key, "crop_index", *g.EDGES, "members"
    )


def crop_regions(
    crops: DataFrame, regions: DataFrame, image_width: Column, image_height: Column, key: str = "image_id"
) -> DataFrame:
    """The regions of every crop, carried into the crop's own 0..1000 frame."""
    inside = crops.select(
        key, "crop_index", g.box(*[F.col(e) for e in g.EDGES]).alias("crop"),
        F.posexplode("members").alias("position", "ord"),
    )
    crop = F.col("crop")
    scale = image_height / F.greatest(F.lit(1), g.height(crop))
    return inside.join(regions, [key, "ord"]).select(
        key, "crop_index", "position", "ord",
        g.remap_to_crop(F.col("box"), crop, image_width, image_height).alias("box"),
        g.remap_to_crop(F.col("layout_box"), crop, image_width, image_height).alias("layout_box"),
        g.rescale(F.col("font_size"), scale).alias("font_size"),
        g.rescale(F.col("stroke_width"), scale).alias("stroke_width"),
    )


# -------------------------------------------------------------------- batches

def _fits_with(count: int, width: Column, height: Column) -> Column:
    rows = -(-count // 2)
    return (width * 2 + GUTTER * 3 <= MAX_SIDE) & (height * rows + GUTTER * (rows + 1) <= MAX_SIDE)


class _ChainChunks:
    """Threads the entry offset and the batch number through the chunks of a key."""

    def __init__(self, at: dict[str, int]):
        self.at = at
        self.entry = 0
        self.batches = 0

    def step(self, row: tuple) -> Iterator[tuple]:
        yield row[self.at["__chunk"]], self.entry, self.batches
        leave, count = row[self.at["__exits"]][self.entry]
        self.entry, self.batches = int(leave), self.batches + int(count)

    def finish(self) -> Iterator[tuple]:
        return iter(())


def pack_batches(
    crops: DataFrame, key: str = "image_id", maximum_tiles: int = MAX_TILES, chunk: int = CHUNK
) -> DataFrame:
    """Add ``batch`` and ``position``: crops in order fill a batch until one more would make
    it too many or force the sheet to shrink.

    Where a batch ends depends only on the next few crops after its start. So every
    chunk of consecutive crops works out where it is left for each of the few offsets it
    may be entered at, the tiny chunk table is chained, and the chunks are then cut
    independently: a single image with any number of crops spreads over all tasks.
    """
    limit = max(1, maximum_tiles)
    rows = crops.select(
        key, (F.col("crop_index") - 1).alias("__i"), (F.col("right") - F.col("left")).alias("__w"),
        (F.col("bottom") - F.col("top")).alias("__h"),
    )
    own = F.floor(F.col("__i") / chunk).cast("bigint")
    # the first crops of a chunk are also seen by the chunk before it
    seen = rows.withColumn("__chunk", F.explode(
        F.when((F.col("__i") % chunk < limit - 1) & (own > 0), F.array(own, own - 1)).otherwise(F.array(own))
    ))
    ahead = Window.partitionBy(key, "__chunk").orderBy("__i")
    taken, still = F.lit(1), F.lit(True)
    for count in range(2, limit + 1):
        span = ahead.rowsBetween(Window.currentRow, count - 1)
        still = still & (F.count(F.lit(1)).over(span) == count) & _fits_with(
            count, F.max("__w").over(span), F.max("__h").over(span))
        taken = taken + F.when(still, 1).otherwise(0)
    taken_rows = materialize(seen.withColumn("__take", taken).where(own == F.col("__chunk")).select(
        key, "__chunk", "__i", "__take"), "takes")
    chunks = taken_rows.groupBy(key, "__chunk").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("__i", "__take"))), lambda s: s["__take"]).alias("__takes"),
    )
    pairs = F.transform("__takes", lambda take, i: F.struct(i.alias("i"), take.alias("take")))

    def through(entry: Column) -> Column:
        start = F.struct(entry.cast("int").alias("next"), F.lit(0).alias("n"))
        return F.aggregate(
            pairs, start,
            lambda acc, p: F.when(
                p["i"] == acc["next"],
                F.struct((acc["next"] + p["take"]).cast("int").alias("next"), (acc["n"] + 1).cast("int").alias("n")),
            ).otherwise(acc),
            lambda acc: F.array(acc["next"] - F.lit(chunk), acc["n"]),
        )

    exits = chunks.select(key, "__chunk", F.array(*[through(F.lit(e)) for e in range(limit)]).alias("__exits"))
    at = {c: i for i, c in enumerate(exits.columns)}
    entries = ordered_fold(
        exits, [key], ["__chunk"], lambda: _ChainChunks(at), ["__chunk", "__entry", "__first"],
        f"{key} {dict(crops.dtypes)[key]}, __chunk bigint, __entry int, __first bigint",
    )
    # walk the chunk once more from its true entry and number its starts
    along = F.aggregate(
        pairs, F.struct(F.col("__entry").alias("next"), F.array().cast("array<int>").alias("starts")),
        lambda acc, p: F.when(
            p["i"] == acc["next"],
            F.struct((acc["next"] + p["take"]).cast("int").alias("next"), F.concat(acc["starts"], F.array(p["i"])).alias("starts")),
        ).otherwise(acc),
        lambda acc: acc["starts"],
    )
    starts = chunks.join(entries, [key, "__chunk"]).select(
        key, "__first", "__chunk", F.posexplode(along).alias("__n", "__s")
    ).select(
        key, (F.col("__chunk") * chunk + F.col("__s")).alias("__i"), (F.col("__first") + F.col("__n") + 1).alias("batch")
    )
    sized = starts.join(taken_rows.select(key, "__i", "__take"), [key, "__i"]).select(
        key, "batch", F.col("__i").alias("__start"), F.explode(F.sequence(F.lit(0), F.col("__take") - 1)).alias("position")
    ).select(key, "batch", "position", (F.col("__start") + F.col("position") + 1).alias("crop_index"))
    return crops.join(sized, [key, "crop_index"])


def layout_batches(batched: DataFrame, key: str = "image_id") -> DataFrame:
    """Tile place and size of each crop on its sheet: equal cells, tiles centred."""
    sheet = Window.partitionBy(key, "batch")
    w, h = F.col("right") - F.col("left"), F.col("bottom") - F.col("top")
    rows = batched.withColumn("__n", F.count(F.lit(1)).over(sheet)).withColumn(
        "__w", F.greatest(F.lit(1), F.max(w).over(sheet))).withColumn("__h", F.greatest(F.lit(1), F.max(h).over(sheet)))
    columns = F.when(F.col("__n") == 1, 1).otherwise(2)
    lines = F.ceil(F.col("__n") / columns)
    raw_w = F.col("__w") * columns + GUTTER * (columns + 1)
    raw_h = F.col("__h") * lines + GUTTER * (lines + 1)
    rows = rows.select(
        "*", columns.alias("__cols"), lines.alias("__rows"),
        F.least(F.lit(1.0), F.lit(MAX_SIDE) / raw_w, F.lit(MAX_SIDE) / raw_h).alias("scale"),
    )
    scale = F.col("scale")
    rows = rows.select(
        "*",
        F.greatest(F.lit(1), half_up(F.col("__w") * scale)).alias("__cell_w"),
        F.greatest(F.lit(1), half_up(F.col("__h") * scale)).alias("__cell_h"),
        F.greatest(F.lit(MIN_GUTTER), half_up(GUTTER * scale)).alias("__gap"),
        F.greatest(F.lit(1), half_up(w * scale)).alias("tile_width"),
        F.greatest(F.lit(1), half_up(h * scale)).alias("tile_height"),
    )
    column, line = F.col("position") % F.col("__cols"), F.floor(F.col("position") / F.col("__cols"))
    gap = F.col("__gap")

    def place(index: Column, cell: str, tile: str) -> Column:
        return (gap + index * (F.col(cell) + gap) + F.floor((F.col(cell) - F.col(tile)) / 2)).cast("bigint")

    hidden = ("__n", "__w", "__h", "__cols", "__rows", "__cell_w", "__cell_h", "__gap")
    return rows.select(
        "*",
        place(column, "__cell_w", "tile_width").alias("tile_left"),
        place(line, "__cell_h", "tile_height").alias("tile_top"),
        (F.col("__cell_w") * F.col("__cols") + gap * (F.col("__cols") + 1)).cast("bigint").alias("sheet_width"),
        (F.col("__cell_h") * F.col("__rows") + gap * (F.col("__rows") + 1)).cast("bigint").alias("sheet_height"),
    ).drop(*hidden)


def sheet_regions(tiles: DataFrame, regions: DataFrame, key: str = "image_id") -> DataFrame:
    """Regions of crops (see :func:`crop_regions`) carried into the 0..1000 frame of their sheet."""
    tile = F.struct(F.col("tile_left").alias("left"), F.col("tile_top").alias("top"),
                    F.col("tile_width").alias("width"), F.col("tile_height").alias("height"))
    placed = tiles.select(key, "crop_index", "batch", "sheet_width", "sheet_height", tile.alias("tile"))
    scale = F.col("tile.height") / F.col("sheet_height")
    return regions.join(placed, [key, "crop_index"]).select(
        key, "batch", "crop_index", "position", "ord",
        g.remap_to_batch(F.col("box"), F.col("tile"), F.col("sheet_width"), F.col("sheet_height")).alias("box"),
        g.remap_to_batch(F.col("layout_box"), F.col("tile"), F.col("sheet_width"), F.col("sheet_height")).alias("layout_box"),
        g.rescale(F.col("font_size"), scale).alias("font_size"),
        g.rescale(F.col("stroke_width"), scale).alias("stroke_width"),
    )


def crop_overlaps(boxes: DataFrame, key: str = "image_id", few: int = 64) -> DataFrame:
    """Per distinct box of an image: its copies and how many other boxes it strictly overlaps.

    Equal boxes are counted first, into a written table. On an image of at most ``few`` distinct boxes they meet each other; on a crowded one
    the boxes apart are counted (see :mod:`dominance`) and the rest overlaps, so no box ever meets more than ``few``.
    Edges are whole numbers; boxes without area, or with an edge missing, overlap nothing and are left out.
    """
    # the filter works on the written table: pushed down, it would repeat the long expressions behind every edge
    distinct = materialize(boxes.groupBy(key, *g.EDGES).agg(F.count(F.lit(1)).alias("n")), "boxes").where("right > left and bottom > top")
    pages = distinct.groupBy(key).agg(
        F.count(F.lit(1)).alias("__distinct"), F.sum("n").alias("__all"),
        F.min("left").alias("__x0"), F.min("top").alias("__y0"), F.max("right").alias("__x1"), F.max("bottom").alias("__y1"))
    rows = distinct.join(pages, key)
    calm, crowded = rows.where(F.col("__distinct") <= few), rows.where(F.col("__distinct") > few)
    other = calm.select(key, F.col("n").alias("o_n"), *[F.col(e).alias(f"o_{e}") for e in g.EDGES])
    met = calm.join(other, key).where(
        (F.col("left") < F.col("o_right")) & (F.col("right") > F.col("o_left"))
        & (F.col("top") < F.col("o_bottom")) & (F.col("bottom") > F.col("o_top")))
    # every box meets itself once; that pair stands for its equal copies
    near = met.groupBy(key, *g.EDGES).agg(F.max("n").alias("n_equal"), (F.sum("o_n") - 1).alias("n_overlapping"))
    far = boxes_apart(crowded, key)
    counted = crowded.join(far, [key, *g.EDGES], "left").select(
        key, *g.EDGES, F.col("n").alias("n_equal"), (F.col("__all") - F.coalesce("apart", F.lit(0)) - 1).alias("n_overlapping"))
    return near.unionByName(counted)
