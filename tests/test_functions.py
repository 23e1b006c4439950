"""Golden values of the column functions."""

import pytest
from pyspark.sql import functions as F

from panelflow.functions import color, geometry as g, media, messages as m, progress as p, text as t, values as v


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def doubles(*values):
    return F.array(*[F.lit(float(x)) for x in values])


def test_normalize_box(spark):
    row = one(spark, g.normalize_box(doubles(-20, 900, 1200, 100)), g.normalize_box(doubles(1, 1, 1, 10)), g.normalize_box(doubles(1, 2, 3)),
              g.normalize_box(doubles(float("nan"), 0, float("inf"), 10)))
    assert (row.c0.left, row.c0.top, row.c0.right, row.c0.bottom) == (0, 100, 1000, 900)
    assert row.c1 is None and row.c2 is None and row.c3 is None


def test_pixel_box_floors_and_ceils(spark):
    row = one(spark, g.box_to_pixels(doubles(200, 100, 800, 500), F.lit(1000), F.lit(500)), g.box_to_pixels(doubles(0.5, 0, 1.4, 10), F.lit(1000), F.lit(1000)),
              g.box_to_pixels(doubles(1, 0, 1.9, 10), F.lit(1000), F.lit(1000)))
    assert tuple(row.c0) == (200, 50, 800, 250) and tuple(row.c1) == (0, 0, 2, 10)
    assert row.c2 is None


def test_stepwise_pixel_box_equals_the_expression(spark):
    df = spark.createDataFrame([([10.2, 990.0, 300.7, -5.0],), ([1.0, 2.0, 3.0],), (None,), ([5.0, 5.0, 5.1, 900.0],)], "values array<double>")
    rows = g.with_pixel_box(df, "values", "b", F.lit(777), F.lit(1234)).select("b", g.box_to_pixels(F.col("values"), F.lit(777), F.lit(1234)).alias("e"))
    assert all(r.b == r.e for r in rows.collect())


def test_anchor_and_font_ratio(spark):
    crop = F.struct(F.lit(0.1).alias("left"), F.lit(0.2).alias("top"), F.lit(0.5).alias("width"), F.lit(0.6).alias("height"))
    row = one(spark, g.map_to_anchor(doubles(200, 100, 800, 500), crop), g.font_ratio(F.lit(80.0), doubles(0, 0, 1, 1), F.lit("horizontal"), F.lit(0.5)),
              g.font_ratio(F.lit(None).cast("double"), F.lit(None).cast("array<double>"), F.lit("x"), F.lit(0.5)),
              g.font_ratio(F.lit(0.0), doubles(0, 0, 100, 500), F.lit("vertical"), F.lit(0.5)))
    assert tuple(round(x, 9) for x in row.c0) == (0.2, 0.26, 0.3, 0.24)
    assert round(row.c1, 9) == 0.04 and row.c2 == 0.03 and round(row.c3, 9) == 0.041


def test_colors(spark):
    row = one(spark, color.normalize_color(F.lit(" #A0b1C2 "), "#000000"), color.normalize_color(F.lit("red"), "#000000"),
              color.parse_hex(F.lit("#112233"), color.rgb(1, 2, 3)), color.parse_hex(F.lit(" #112233"), color.rgb(1, 2, 3)),
              color.rgb_to_hex(color.rgb(17, 34, 300)), color.color_distance(color.rgb(0, 0, 0), color.rgb(2, 3, 6)))
    assert row.c0 == "#A0b1C2" and row.c1 == "#000000" and tuple(row.c2) == (17, 34, 51) and tuple(row.c3) == (1, 2, 3)
    assert row.c4 == "#1122ff" and row.c5 == 7.0


def test_rounding_goes_half_up(spark):
    row = one(spark, v.half_up(F.lit(-2.5)), v.half_up(F.lit(2.5)), v.tenth(F.lit(0.25)), v.clamp_finite(F.lit(float("nan")), 3.0, 9.0))
    assert (row.c0, row.c1, row.c2, row.c3) == (-2, 3, 0.3, 3.0)


def test_settings(spark):
    def num(x):
        return F.lit(x).cast("double")

    row = one(spark, v.clamp_setting(num(99), 1, 12, 6), v.clamp_setting(num(2.5), 1, 12, 6), v.clamp_setting(num(None), 1, 5, 3), v.bounded_setting(num(80), 1024, 65535, 38473))
    assert tuple(row) == (12, 6, 3, 38473)


def test_review_plan_manual_is_one_attempt_and_never_skipped(spark):
    row = one(spark, media.review_plan(F.lit("manual"), F.lit(True), F.lit(5.0)), media.review_plan(F.lit("automatic"), F.lit(True), F.lit(5.0)),
              media.review_plan(F.lit(None), F.lit(None), F.lit(9.0)))
    assert tuple(row.c0) == ("manual", 1) and tuple(row.c1) == ("skipped", 0) and tuple(row.c2) == ("automatic", 5)


@pytest.mark.parametrize("w,h,want", [(640, 360, (1600, 900, 2.5)), (3000, 2000, (3000, 2000, 1.0)), (1200, 600, (2400, 1200, 2.0)), (9000, 100, (4096, 46, 4096 / 9000))])
def test_ocr_size(spark, w, h, want):
    row = one(spark, g.ocr_size(F.lit(w), F.lit(h))).c0
    assert (row.width, row.height) == want[:2] and abs(row.scale - want[2]) < 1e-12


def test_recenter_keeps_size_and_stays_inside(spark):
    def box(*e):
        return g.box(*[F.lit(float(x)) for x in e])

    row = one(spark, g.recenter(box(10, 10, 60, 40), box(0, 0, 20, 10), F.lit(100.0), F.lit(100.0))).c0
    assert tuple(row) == (0, 0, 50, 30)


@pytest.mark.parametrize("text,limit,lines", [
    ("이미지번역", 3, ["이미지", "번역"]),
    ("안녕, 괜찮아?", 7, ["안녕,", "괜찮아?"]),
    ("", 5, [""]),
    ("a\n\nb", 5, ["a", "", "b"]),
    ("abcdef!", 3, ["abc", "def!"]),
    ("abc, de", 3, ["abc,", "de"]),
    ("x abcdefgh", 3, ["x", "abc", "def", "gh"]),
])
def test_wrap_text(spark, text, limit, lines):
    assert one(spark, t.wrap_text(F.lit(text), F.lit(limit))).c0 == lines


def test_render_orientation(spark):
    def case(text, kind, w=None, h=None):
        return t.render_orientation(F.lit(text), F.lit("vertical"), F.lit(kind), F.lit(w).cast("double"), F.lit(h).cast("double"))

    row = one(spark, case("괜찮아?", "dialogue"), case("괜찮아?", "dialogue", 100, 220), case("괜찮아?", "dialogue", 300, 700), case("쾅", "sfx"), case("ok", "dialogue", 300, 700))
    assert tuple(row) == ("horizontal", "vertical", "horizontal", "vertical", "vertical")


def test_fit_horizontal(spark):
    row = one(
        spark,
        t.fit_horizontal(F.lit("이 문장은 좁은 말풍선 안에 들어가도록 크기가 자동으로 조절되어야 합니다."), F.lit(72.0), F.lit(220.0), F.lit(300.0)),
        t.fit_horizontal(F.lit("괜찮아?"), F.lit(72.0), F.lit(500.0), F.lit(260.0)),
        t.fit_horizontal(F.lit("가" * 500), F.lit(20.0), F.lit(50.0), F.lit(50.0)))
    assert 7 <= row.c0 < 57.6 and 71 <= row.c1 <= 72 and row.c2 is None


def test_formats(spark):
    row = one(spark, t.format_bytes(F.lit(0)), t.format_bytes(F.lit(1280)), t.format_bytes(F.lit(1300000)), t.format_duration(F.lit(61499.0)),
              t.format_duration(F.lit(900.0)), t.single_line(F.lit(" a \n b\t c "), 4))
    assert tuple(row) == ("0 B", "1.3 KB", "1.24 MB", "1분 1초", "1초", "a b ")


def test_natural_order(spark):
    df = spark.createDataFrame([("page10",), ("page2",), ("Page1",), ("page",), ("1",), ("page2b",)], "s string")
    assert [r.s for r in df.orderBy(t.natural_key(F.col("s"))).collect()] == ["1", "page", "Page1", "page2", "page2b", "page10"]
    big = ["p10", "p" + "9" * 40, "p2", "p" + "1" * 41, "p0002x", "p", "p0", "p" + "0" * 60 + "3"]
    ordered = spark.createDataFrame([(s,) for s in big], "s string").orderBy(t.natural_key(F.col("s")), "s").collect()
    assert [r.s for r in ordered] == ["p", "p0", "p2", "p0002x", "p" + "0" * 60 + "3", "p10", "p" + "9" * 40, "p" + "1" * 41]


def test_output_name_and_number_key(spark):
    row = one(spark, t.output_name(F.lit("/x/a.b.zip")), t.output_name(F.lit("/x.d/.hidden")), t.number_key(F.lit("#12")), t.number_key(F.lit("?")))
    assert tuple(row) == ("/x/a.b_ko.zip", "/x.d/.hidden_ko.zip", 12, 10**9)


def test_urls(spark):
    base = F.lit("https://h.example:81/a/b/c.html?q=1#f")
    given = ["x.png", "./x.png", "../x.png", "../../../x.png", "/r/../x.png", "//o.example/y", "data:image/png;base64,AA", "?z=2", "x.png?a=../b"]
    row = one(spark, *[media.absolute_url(F.lit(x), base) for x in given])
    assert list(row) == [
        "https://h.example:81/a/b/x.png", "https://h.example:81/a/b/x.png", "https://h.example:81/a/x.png", "https://h.example:81/x.png",
        "https://h.example:81/x.png", "https://o.example/y", "data:image/png;base64,AA", "https://h.example:81/a/b/c.html?z=2",
        "https://h.example:81/a/b/x.png?a=../b"]


def test_background_url(spark):
    row = one(spark, *[media.background_url(F.lit(x)) for x in ('red url( "a b.png" )', "url('q.png')", "x URL( r.png ) y", "none")])
    assert list(row) == ["a b.png", "q.png", "r.png", None]


def test_sniff_and_data_url(spark):
    row = one(spark, media.sniff_mime(F.unhex(F.lit("FFD8FF")), F.lit(None).cast("string")), media.sniff_mime(F.encode(F.lit("  <svg x>"), "UTF-8"), F.lit("text/xml")),
              media.sniff_mime(F.unhex(F.lit("00")), F.lit("Image/PNG; a=b")), media.sniff_mime(F.unhex(F.lit("FE01")), F.lit("")),
              media.parse_data_url(F.lit("data:image/png;base64,QUI=")), media.parse_data_url(F.lit("data:image/png,QUI=")), media.base64_bytes(F.lit("QUI=")))
    assert (row.c0, row.c1, row.c2, row.c3) == ("image/jpeg", "image/svg+xml", "image/png", None)
    assert tuple(row.c4) == ("image/png", "QUI=") and row.c5 is None and row.c6 == 2


def test_safety_and_paths(spark):
    row = one(spark, m.safety_blocked(F.lit("The Safety\nfilter has\n refused it")), m.safety_blocked(F.lit("safety first")),
              m.inside_root(F.lit("C:\\Gen\\a\\x.png"), F.lit("c:/gen")), m.inside_root(F.lit("C:/gender/x.png"), F.lit("c:/gen")),
              m.safe_thread_id(F.lit("0f8fad5b-d9cb-469f-a165-70867728950e")), m.safe_thread_id(F.lit("../x")))
    assert tuple(row) == (True, False, True, False, True, False)


def test_error_view_keeps_twelve(spark):
    details = F.array(*[F.lit(f"d{i}") for i in range(14)], F.lit(""))
    shown = one(spark, m.error_view(F.lit("head"), details)).c0.split("\n")
    assert shown[0] == "head" and len(shown) == 13 and shown[-1] == "• d11"


def test_rules_first_marker_wins(spark):
    row = one(spark, p.classify(F.lit("자동 검수 1/3 · 합성 결과 시각 검수 3/3 시작")), p.classify(F.lit("자동 검수 3회 미통과 · 사용자 검수 필요")),
              p.classify(F.lit("최종 원문 제거 및 한국어 이미지 재합성 시작")), p.source_of(F.lit("페이지 이미지 교체 확인 · <img>")), p.source_of(F.lit("x")))
    assert row.c0.stage == "자동 재검수" and row.c1.state == "review" and row.c2.stage == "처리 중"
    assert tuple(row.c3) == ("web", "웹 <img>") and row.c4 is None
    assert len(p.RULES) == 55


def test_filter_on_a_pixel_box_does_not_repeat_it(spark):
    values = spark.range(3).select(F.array(*[(F.col("id") * k).cast("double") for k in (1, 2, 300, 400)]).alias("v"))
    found = g.with_pixel_box(values, "v", "b", F.lit(1000), F.lit(1400)).where("b is not null")
    assert found._jdf.queryExecution().optimizedPlan().toString().upper().count("FLOOR(") == 2
    assert sorted(r.b.right for r in found.collect()) == [300, 600]
