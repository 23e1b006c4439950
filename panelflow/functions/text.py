"""Text rules: wrapping, caption size, labels, natural order, log formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from panelflow.functions.values import half_up

# Punctuation that stays with the chunk before it.
CLOSING = ",.!?…。，、！？：；）】』」"
MIN_FONT = 7
LINE_HEIGHT, CHAR_WIDTH, COLUMN_STEP, USABLE_SHARE = 1.12, 1.02, 1.08, 0.84

def _no_texts() -> Column:
    return F.array().cast("array<string>")


def utf16_length(text: Column) -> Column:
    return (F.length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def words_of(paragraph: Column) -> Column:
    return F.filter(F.split(paragraph, r"(?U)\s+"), lambda w: w != "")


def split_long_word(word: Column, limit: Column) -> Column:
    """Chunks of ``limit`` characters; closing punctuation stays with the chunk before it."""
    pattern = F.concat(F.lit("(?s).{"), limit.cast("string"), F.lit("}[" + CLOSING + "]?|.+"))
    return F.regexp_extract_all(word, pattern, F.lit(0))


def wrap_text(text: Column, limit: Column) -> Column:
    """Lines of at most ``limit`` characters: greedy by word, paragraph by paragraph."""
    start = F.struct(_no_texts().alias("lines"), F.lit("").alias("current"))

    def add(acc: Column, word: Column) -> Column:
        current = acc["current"]
        candidate = F.when(current == "", word).otherwise(F.concat(current, F.lit(" "), word))
        before = F.when(current == "", acc["lines"]).otherwise(F.concat(acc["lines"], F.array(current)))
        chunks = split_long_word(word, limit)
        return F.when(
            utf16_length(candidate) <= limit, F.struct(acc["lines"].alias("lines"), candidate.alias("current"))
        ).otherwise(F.struct(
            F.concat(before, F.slice(chunks, F.lit(1), F.size(chunks) - 1)).alias("lines"),
            F.element_at(chunks, -1).alias("current"),
        ))

    def wrap(paragraph: Column) -> Column:
        words = words_of(paragraph)
        folded = F.aggregate(words, start, add, lambda acc: F.concat(acc["lines"], F.array(acc["current"])))
        return F.when(F.size(words) == 0, F.array(F.lit(""))).otherwise(folded)

    return F.flatten(F.transform(F.split(text, "\n"), wrap))


def render_orientation(
    translated: Column, orientation: Column, kind: Column, layout_width: Column, layout_height: Column
) -> Column:
    """Korean set vertically becomes horizontal, except effects and narrow balloons."""
    narrow = F.coalesce((kind == "dialogue") & (layout_width < 120) & (layout_height >= layout_width * 1.65), F.lit(False))
    turned = translated.rlike("[가-힣]") & (orientation == "vertical") & ~F.coalesce(kind == "sfx", F.lit(False))
    return (
        F.when(turned, F.when(narrow, "vertical").otherwise("horizontal"))
        .when(orientation == "vertical", "vertical")
        .otherwise("horizontal")
    )


def _first_fitting(largest: Column, fits) -> Column:
    """The largest size of largest, largest-1, ... >= 7 that fits, else null. Stops looking once found."""
    steps = F.when(largest >= MIN_FONT, F.sequence(F.lit(0), F.floor(largest - MIN_FONT).cast("int"))).otherwise(
        F.array().cast("array<int>"))
    return F.aggregate(
        steps, F.lit(None).cast("double"),
        lambda found, i: F.when(found.isNotNull(), found).otherwise(F.when(fits(largest - i), largest - i)),
    )


def fit_horizontal(text: Column, largest: Column, layout_width: Column, layout_height: Column) -> Column:
    """Largest font size whose wrapped lines fit 84 % of the area; null when none does."""
    width, height = layout_width * USABLE_SHARE, layout_height * USABLE_SHARE
    ink = F.length(F.regexp_replace(text, r"(?U)\s+", ""))

    def fits(size: Column) -> Column:
        limit = F.greatest(F.lit(1), F.floor(width / (size * CHAR_WIDTH))).cast("int")
        # no line holds more than limit + 1 characters: skip sizes that cannot fit
        fewest = F.ceil(ink / (limit + 1))
        lines = F.when(fewest * size * LINE_HEIGHT > height, F.lit(None).cast("int")).otherwise(
            F.size(wrap_text(text, limit)))
        return F.coalesce(lines * size * LINE_HEIGHT <= height, F.lit(False))

    return _first_fitting(largest, fits)


def fit_vertical(text: Column, largest: Column, layout_width: Column, layout_height: Column) -> Column:
    width, height = layout_width * USABLE_SHARE, layout_height * USABLE_SHARE
    count = F.length(F.regexp_replace(text, r"(?U)\s+", ""))

    def fits(size: Column) -> Column:
        per_column = F.greatest(F.lit(1), F.floor(height / (size * COLUMN_STEP)))
        return F.ceil(count / per_column) * size * COLUMN_STEP <= width

    return _first_fitting(largest, fits)


def single_line(text: Column, limit: int) -> Column:
    flat = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))
    return F.substring(flat, 1, limit)


def format_bytes(size: Column) -> Column:
    def decimals(value: Column, places: int) -> Column:
        factor = 10 ** places
        return F.format_string(f"%.{places}f", half_up(value * factor) / factor)

    return (
        F.when(size.isNull() | (size <= 0), F.lit("0 B"))
        .when(size < 1024, F.concat(size.cast("bigint").cast("string"), F.lit(" B")))
        .when(size < 1024 * 1024, F.concat(decimals(size / 1024, 1), F.lit(" KB")))
        .otherwise(F.concat(decimals(size / 1024 / 1024, 2), F.lit(" MB")))
    )


def format_duration(milliseconds: Column) -> Column:
    seconds = F.greatest(F.lit(0), half_up(milliseconds / 1000))
    minutes = F.floor(seconds / 60)
    return F.when(seconds < 60, F.concat(seconds.cast("string"), F.lit("초"))).otherwise(
        F.concat(minutes.cast("string"), F.lit("분 "), (seconds - minutes * 60).cast("string"), F.lit("초")))


def format_source(element: Column, source_url: Column) -> Column:
    """``<element> · host/path`` with the path decoded and cut at 120 characters."""
    tag = F.when(F.coalesce(element, F.lit("")) == "", F.lit("이미지")).otherwise(
        F.concat(F.lit("<"), F.substring(element, 1, 20), F.lit(">")))
    raw = F.coalesce(source_url, F.lit(""))
    host = F.lower(F.try_parse_url(raw, F.lit("HOST")))
    path = F.try_parse_url(raw, F.lit("PATH"))
    path = F.when(F.coalesce(path, F.lit("")) == "", F.lit("/")).otherwise(path)
    decoded = F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    told = (
        F.when(raw.rlike("^(canvas|inline-svg|screen-capture):"), raw)
        .when(host.isNull() | decoded.isNull(), F.lit("출처 미상"))
        .otherwise(F.concat(host, F.substring(decoded, 1, 120)))
    )
    return F.concat(tag, F.lit(" · "), told)


def natural_key(text: Column) -> Column:
    """Sorts digit runs as numbers of any length and the rest without case: page2 before page10.

    A number is its length without leading zeros, then its digits as text; no digits come before zero.
    """
    pattern = F.lit(r"(\D*)(\d*)")

    def part(word: Column, digits: Column) -> Column:
        plain = F.regexp_replace(digits, "^0+", "")
        return F.struct(F.lower(word).alias("text"), F.when(digits != "", F.length(plain)).alias("size"), plain.alias("digits"))

    return F.zip_with(F.regexp_extract_all(text, pattern, F.lit(1)), F.regexp_extract_all(text, pattern, F.lit(2)), part)


def number_key(label: Column) -> Column:
    """Sort key of a ``#12`` label; anything else goes last."""
    return F.coalesce(F.regexp_replace(label, "^#+", "").try_cast("bigint"), F.lit(10**9))


def output_name(path: Column) -> Column:
    """``folder/stem_ko.zip`` next to the source archive."""
    return F.concat(F.regexp_replace(path, r"(?<=[^/])\.[^./]*$", ""), F.lit("_ko.zip"))
