"""The region and review contracts of a model answer."""

from __future__ import annotations

# Field name in the answer, column name here, and kind of value.
REGION_FIELDS = (
    ("box", "box", "box"),
    ("layoutBox", "layout_box", "box"),
    ("original", "original", "string"),
    ("translated", "translated", "string"),
    ("confidence", "confidence", "share"),
    ("regionKind", "region_kind", ("dialogue", "narration", "sfx", "label")),
    ("orientation", "orientation", ("horizontal", "vertical")),
    ("fontSize", "font_size", "number"),
    ("textColor", "text_color", "string"),
    ("backgroundColor", "background_color", "string"),
    ("bold", "bold", "boolean"),
    ("fontStyle", "font_style", ("sans", "serif", "rounded", "handwritten", "display")),
    ("strokeColor", "stroke_color", "string"),
    ("strokeWidth", "stroke_width", "number"),
    ("italic", "italic", "boolean"),
    ("rotation", "rotation", "number"),
    ("align", "align", ("left", "center", "right")),
    ("backgroundComplex", "background_complex", "boolean"),
)

KIND_TYPES = {"box": "array<double>", "string": "string", "share": "double", "number": "double", "boolean": "boolean"}

REGION_TYPE = "struct<" + ",".join(
    f"{column}:{KIND_TYPES.get(kind, 'string') if isinstance(kind, str) else 'string'}"
    for _, column, kind in REGION_FIELDS
) + ">"

MIN_CONFIDENCE = 0.45
