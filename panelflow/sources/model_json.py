"""Model answers as tables: every violation of the contract is named, nothing is lost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelflow.schemas import KIND_TYPES, REGION_FIELDS

_NUMBER = "^(BIGINT|INT|SMALLINT|TINYINT|DECIMAL|DOUBLE|FLOAT)"
_NUMBERS = "^ARRAY<(BIGINT|INT|SMALLINT|TINYINT|DECIMAL|DOUBLE|FLOAT|VOID)"


def _field(v: Column, name: str, kind: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", kind)


def _once(rows: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that later steps use more than once: the generator keeps them from being worked out at each use."""
    return rows.select(*rows.columns, F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def _violation(value: Column, name: str, kind) -> Column:
    """Null when the field keeps the contract, else what is wrong with it."""
    told = F.schema_of_variant(value)
    missing = F.when(value.isNull(), F.lit(f"missing:{name}"))
    wrong_type = F.lit(f"type:{name}")
    if isinstance(kind, tuple):
        return missing.when(told != "STRING", wrong_type).when(
            ~F.try_variant_get(value, "$", "string").isin(*kind), F.lit(f"enum:{name}")
        )
    if kind == "box":
        return missing.when(~told.rlike(_NUMBERS), wrong_type).when(
            F.size(F.try_variant_get(value, "$", "array<double>")) != 4, F.lit(f"size:{name}")
        )
    if kind in ("number", "share"):
        checked = missing.when(~told.rlike(_NUMBER), wrong_type)
        if kind == "share":
            checked = checked.when(~F.try_variant_get(value, "$", "double").between(0, 1), F.lit(f"range:{name}"))
        return checked
    return missing.when(told != kind.upper(), wrong_type)


def _unexpected(keys: Column, known: list[str]) -> Column:
    extra = F.array_sort(F.array_except(keys, F.array(*[F.lit(k) for k in known])))
    return F.transform(extra, lambda key: F.concat(F.lit("unexpected:"), key))


def _named(violations: list[Column], unexpected: Column) -> Column:
    return F.concat(F.array_compact(F.array(*violations)), F.coalesce(unexpected, F.array().cast("array<string>")))


def _keys(v: Column) -> Column:
    """The names in an object, null for any other value."""
    return F.map_keys(F.try_variant_get(v, "$", "map<string,variant>"))


def _parsed(answers: DataFrame, column: str, known: list[str], checks) -> DataFrame:
    """Keys plus ``__envelope`` (its violations), ``__answer`` and ``__regions``; every text is parsed exactly once.

    What is an object and what an array is told by the cast to one, which looks at the outermost value only.
    """
    keys = [c for c in answers.columns if c != column]
    rows = _once(answers, __answer=F.try_parse_json(F.col(column))).select(*keys, "__answer")
    v = F.col("__answer")
    rows = _once(rows, __names=_keys(v), __regions=_field(v, "regions", "array<variant>"))
    envelope = (
        F.when(v.isNull(), F.array(F.lit("invalid_json")))
        .when(F.col("__names").isNull(), F.array(F.lit("not_an_object")))
        .when(F.col("__regions").isNull(), F.array(F.lit("regions_not_an_array")))
        .otherwise(_named(checks(v), _unexpected(F.col("__names"), known)))
    )
    return _once(rows, __envelope=envelope).drop("__names")


# the type of a region that keeps the contract, as its fields appear in name order
_SHAPES = {"box": r"ARRAY<(?:BIGINT|DECIMAL\([0-9, ]+\)|DOUBLE|VOID)>", "boolean": "BOOLEAN",
           "number": r"(?:BIGINT|DECIMAL\([0-9, ]+\)|DOUBLE)", "share": r"(?:BIGINT|DECIMAL\([0-9, ]+\)|DOUBLE)"}
_RIGHT_SHAPE = "^OBJECT<" + ", ".join(
    f"{name}: {_SHAPES.get(kind, 'STRING') if isinstance(kind, str) else 'STRING'}" for name, _, kind in sorted(REGION_FIELDS)) + ">$"


def _right(region: Column) -> Column:
    """Whether a region keeps the contract: one look at its whole type and at the few checked values tells."""
    right = F.schema_of_variant(region).rlike(_RIGHT_SHAPE)
    for name, _, kind in REGION_FIELDS:
        if isinstance(kind, tuple):
            right = right & _field(region, name, "string").isin(*kind)
        elif kind == "box":
            right = right & (F.size(_field(region, name, "array<double>")) == 4)
        elif kind == "share":
            right = right & _field(region, name, "double").between(0, 1)
    return F.coalesce(right, F.lit(False))


def _good(parsed: DataFrame) -> DataFrame:
    """One row per region that keeps the contract, of answers whose envelope is right."""
    keys = [c for c in parsed.columns if not c.startswith("__")]
    region = F.col("__region")
    listed = parsed.where(F.size("__envelope") == 0).select(*keys, F.posexplode("__regions").alias("__pos", "__region"))
    return listed.where(_right(region)).select(
        *keys,
        (F.col("__pos") + 1).cast("bigint").alias("ord"),
        *[_field(region, name, KIND_TYPES.get(kind, "string") if isinstance(kind, str) else "string").alias(column)
          for name, column, kind in REGION_FIELDS],
        _field(region, "confidence", "variant").isNotNull().alias("has_confidence"),
    )


def _bad(parsed: DataFrame) -> DataFrame:
    """(keys..., ord, violations) of broken envelopes (null ``ord``) and bad regions, in one pass over the answers.

    Only regions that are not right are gone through field by field, so each of them is in one of the two tables.
    """
    keys = [c for c in parsed.columns if not c.startswith("__")]
    whole, region = F.size("__envelope") == 0, F.col("__region")
    listed = parsed.select(*keys, "__envelope", F.posexplode(
        F.when(whole, F.col("__regions")).otherwise(F.array(F.lit(None).cast("variant")))).alias("__pos", "__region"))
    wrong = listed.where(~_right(region))
    fields = ", ".join(f"{name}: variant" for name, _, _ in REGION_FIELDS)
    opened = _once(wrong, __fields=F.try_variant_get(region, "$", f"struct<{fields}>"), __names=_keys(region))
    told = _once(opened, __told=F.array(*[_violation(F.col("__fields")[name], name, kind) for name, _, kind in REGION_FIELDS]))
    named = F.concat(F.array_compact("__told"), F.coalesce(
        _unexpected(F.col("__names"), [name for name, _, _ in REGION_FIELDS]), F.array().cast("array<string>")))
    return told.select(*keys, F.when(whole, (F.col("__pos") + 1).cast("bigint")).alias("ord"),
                       F.when(whole, named).otherwise(F.col("__envelope")).alias("violations"))


def scan_regions(answers: DataFrame, column: str = "output") -> tuple[DataFrame, DataFrame]:
    """(keys..., output) -> (clean regions, quarantine with every violation named).

    A broken envelope is quarantined whole (null ``ord``); a bad region alone.
    """
    parsed = _parsed(answers, column, ["regions"], lambda v: [])
    return _good(parsed), _bad(parsed)


def scan_reviews(answers: DataFrame, column: str = "output") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Like :func:`scan_regions` for review answers: (reviews, clean regions, quarantine)."""

    def checks(v: Column) -> list[Column]:
        def check(name: str, right) -> Column:
            told = F.schema_of_variant(_field(v, name, "variant"))
            return F.when(told.isNull(), F.lit(f"missing:{name}")).when(~right(told), F.lit(f"type:{name}"))

        return [
            check("passed", lambda t: t == "BOOLEAN"),
            check("summary", lambda t: t == "STRING"),
            check("issues", lambda t: t.isin("ARRAY<STRING>", "ARRAY<VOID>")),
        ]

    parsed = _parsed(answers, column, ["passed", "summary", "issues", "regions"], checks)
    keys = [c for c in answers.columns if c != column]
    v = F.col("__answer")
    reviews = parsed.where(F.size("__envelope") == 0).select(
        *keys, _field(v, "passed", "boolean").alias("passed"), _field(v, "summary", "string").alias("summary"),
        _field(v, "issues", "array<string>").alias("issues"),
        F.size("__regions").cast("bigint").alias("n_regions"),
    )
    return reviews, _good(parsed), _bad(parsed)
