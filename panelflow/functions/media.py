"""Picture payloads and addresses: type sniffing, data URLs, admission, source resolution."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from panelflow.functions.values import clamp_setting, strip_space

# Accepted types, suffixes and limits.
KNOWN_TYPES = ("image/jpeg", "image/png", "image/webp", "image/gif", "image/avif", "image/svg+xml")
REQUEST_TYPES = ("image/jpeg", "image/png", "image/webp")
UPLOAD_TYPES = ((".png", "image/png"), (".jpg", "image/jpeg"), (".jpeg", "image/jpeg"), (".webp", "image/webp"))
MAX_REQUEST_BYTES = 15 * 1024 * 1024
MAX_UPLOAD_BYTES = 14 * 1024 * 1024
LAZY_ATTRIBUTES = ("current_src", "src", "data_src", "data_original", "data_lazy_src")


def sniff_mime(content: Column, content_type: Column) -> Column:
    """Type of a downloaded picture: a trusted header, else the first bytes, else null."""
    told = F.lower(strip_space(F.split_part(F.coalesce(content_type, F.lit("")), F.lit(";"), F.lit(1))))
    magic = F.hex(F.substring(content, 1, 12))
    opening = F.ltrim(F.try_validate_utf8(F.substring(content, 1, 512).cast("string")))
    opening = F.coalesce(opening, F.ltrim(F.decode(F.substring(content, 1, 512), "ISO-8859-1")))
    return (
        F.when(told.isin(*KNOWN_TYPES), told)
        .when(magic.startswith("FFD8"), "image/jpeg")
        .when(magic.startswith("89504E47"), "image/png")
        .when(magic.startswith("474946"), "image/gif")
        .when(magic.rlike("^52494646.{8}57454250"), "image/webp")
        .when(opening.startswith("<svg") | (opening.startswith("<?xml") & opening.contains("<svg")), "image/svg+xml")
    )


def parse_data_url(url: Column) -> Column:
    """(mime, data) of a base64 data URL, else null."""
    pattern = "(?s)^data:([^;,]+);base64,(.+)$"
    return F.when(url.rlike(pattern), F.struct(
        F.regexp_extract(url, pattern, 1).alias("mime"), F.regexp_extract(url, pattern, 2).alias("data")))


def base64_bytes(data: Column) -> Column:
    """Decoded length estimated from the text length and its padding."""
    padding = F.when(data.endswith("=="), 2).when(data.endswith("="), 1).otherwise(0)
    return F.greatest(F.lit(0), F.floor(F.length(data) * 0.75) - padding).cast("bigint")


def reject_reason(mime: Column, data: Column) -> Column:
    """Why a request cannot be taken, or null."""
    size = base64_bytes(F.regexp_replace(data, r"[\r\n]", ""))
    return (
        F.when((F.coalesce(mime, F.lit("")) == "") | (F.coalesce(data, F.lit("")) == ""), "no_image")
        .when(~mime.isin(*REQUEST_TYPES), "type")
        .when(~data.rlike(r"^[a-zA-Z0-9+/=\r\n]+$"), "base64")
        .when((size < 1) | (size > MAX_REQUEST_BYTES), "size")
    )


def positive_integer(value: Column) -> Column:
    return F.when((value > 0) & (value == F.floor(value)), value.cast("bigint"))


def review_plan(quality_review_mode: Column, skip: Column, attempts: Column) -> Column:
    """(mode, max_attempts): manual is one attempt and never skipped; skipping means none."""
    manual = F.coalesce(quality_review_mode == "manual", F.lit(False))
    skipped = ~manual & F.coalesce(skip, F.lit(False))
    return F.struct(
        F.when(manual, "manual").when(skipped, "skipped").otherwise("automatic").alias("mode"),
        F.when(manual, F.lit(1)).when(skipped, F.lit(0)).otherwise(clamp_setting(attempts, 1, 5, 3)).cast("int").alias("max_attempts"),
    )


def render_mode(value: Column) -> Column:
    """Fixed value: the model renderer's mode name; everything else is local."""
    return F.when(value == "codex-image", value).otherwise("local")


def upload_plan(suffix: Column, length: Column) -> Column:
    """(action pass|convert|reject, mime, reason) for an archive image about to be sent."""
    lower = F.lower(suffix)
    mime = F.lit(None).cast("string")
    for known, name in UPLOAD_TYPES:
        mime = F.when(lower == known, name).otherwise(mime)
    passes = mime.isNotNull() & (length <= MAX_UPLOAD_BYTES)
    unknown = mime.isNull() & (lower != ".bmp")
    return F.struct(
        F.when(passes, "pass").when(unknown, "reject").otherwise("convert").alias("action"),
        F.when(passes, mime).when(~unknown, "image/png").alias("mime"),
        F.when(unknown, "type").alias("reason"),
    )


# ------------------------------------------------------------------ addresses

def _segments(path: Column) -> Column:
    """Resolve ``.`` and ``..`` in a path."""
    parts = F.split(path, "/")
    last = F.element_at(parts, -1)
    kept = F.aggregate(
        parts, F.array().cast("array<string>"),
        lambda acc, s: F.when(s == ".", acc).when(
            s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(1)))).otherwise(F.concat(acc, F.array(s))),
    )
    return F.concat(F.array_join(kept, "/"), F.when(last.isin(".", ".."), "/").otherwise(""))


def absolute_url(address: Column, base: Column) -> Column:
    """``address`` made absolute against the page address ``base``; null without one."""
    scheme = F.try_parse_url(base, F.lit("PROTOCOL"))
    origin = F.concat(scheme, F.lit("://"), F.try_parse_url(base, F.lit("AUTHORITY")))
    path = F.coalesce(F.try_parse_url(base, F.lit("PATH")), F.lit(""))
    folder = F.regexp_replace(F.when(path == "", "/").otherwise(path), "[^/]*$", "")
    own = F.regexp_extract(address, "^[^?#]*", 0)
    tail = F.substring(address, F.length(own) + 1, F.length(address))
    return (
        F.when(F.coalesce(address, F.lit("")) == "", F.lit(None))
        .when(address.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), address)
        .when(address.startswith("//"), F.concat(scheme, F.lit(":"), address))
        .when(address.startswith("/"), F.concat(origin, _segments(own), tail))
        .when(address.startswith("?"), F.concat(origin, path, address))
        .when(address.startswith("#"), F.concat(F.regexp_replace(base, "#.*$", ""), address))
        .otherwise(F.concat(origin, _segments(F.concat(folder, own)), tail))
    )


def _first_of(*values: Column) -> Column:
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values])


def resolve_source(attributes: dict[str, Column], base: Column) -> Column:
    """Address of an image element: plain and lazy attributes, then the first srcset entry."""
    direct = _first_of(*[attributes[n] for n in LAZY_ATTRIBUTES if n in attributes])
    several = _first_of(*[attributes[n] for n in ("srcset", "data_srcset") if n in attributes])
    candidate = F.split_part(F.regexp_replace(strip_space(F.split_part(several, F.lit(","), F.lit(1))), r"\s+", " "), F.lit(" "), F.lit(1))
    return absolute_url(F.coalesce(direct, candidate), base)


def background_url(css: Column) -> Column:
    """First ``url(...)`` of a style, quoted or not."""
    pattern = r"""(?i)url\(\s*(?:"([^"]+)"|'([^']+)'|([^)'"\s][^)]*))\s*\)"""
    return _first_of(*[F.regexp_extract(css, pattern, g) for g in (1, 2)], strip_space(F.regexp_extract(css, pattern, 3)))
