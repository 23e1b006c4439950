from llm.cases import PROSE, awkward, empty, rows

from panelflow.llm.licenses import TEMPLATES, bounds, license_scan, telling_words, template_bigrams


def test_planted_notices(spark):
    extra = [
        (30, PROSE + "\nReleased under the MIT license\n" + PROSE, "l"), (31, "licensed under CC BY-NC 4.0", "l"), (32, "Licensed under CC BY-SA 4.0.\nReleased under the MIT License.", "l"),
        (33, "\n".join(TEMPLATES[2][1].replace(", ", ",\n").split("\n")), "l"), (34, "This work is licensed.", "l"), (35, TEMPLATES[5][1].upper() + "\n" + TEMPLATES[5][1], "l"),
    ]
    got = {r[0]: r[1:] for r in rows(license_scan(awkward(spark, extra))) if r[0] is not None}
    assert got[30][:3] == (1, "MIT", "MIT") and got[31] == (1, "CC-BY-NC-4.0", "CC-BY-NC-4.0", 1.0)
    assert got[32][:2] == (2, "CC-BY-SA-4.0,MIT") and got[33][1] == "MIT" and got[35][:2] == (3, "GPL-3.0")  # the two lines and their paragraph
    assert all(got[i] == (0, "", None, None) for i in (1, 4, 5, 9, 34))


def test_notices_inside_lines_and_across_them(spark):
    extra = [
        (40, "Visit us. Released under the MIT License. Contact us at any time.", "l"), (41, "All rights reserved.", "l"), (42, "Copyright 2020. ALL RIGHTS RESERVED", "l"),
        (43, "Some words of a page. This work is licensed under the GNU\nGeneral Public License, version 3. And more words\nfollow on it.", "l"),
        (44, "Rights are reserved by all of us, released from any licence.", "l"), (45, "Released under the MIT License. ", "l"),
        (46, "This is free and unencumbered software released into the public domain.\n\nAnyone is free.", "l")]
    got = {r[0]: r[1:3] for r in rows(license_scan(awkward(spark, extra))) if r[0] is not None}
    assert [got[i] for i in range(40, 47)] == [
        (1, "MIT"), (1, "Proprietary"), (1, "Proprietary"), (1, "GPL-3.0"), (0, ""), (1, "MIT"), (1, "Unlicense")]


def test_telling_words_lose_nothing():
    for _, text in TEMPLATES:
        grams = template_bigrams(text)
        words, least = set(telling_words(grams, 0.8)), bounds(len(grams), 0.8)[0]
        without = sum(words.isdisjoint(g.split(" ")) for g in grams)
        assert words and without < least  # a passage without these words shares too few bigrams


def test_size_bounds_lose_nothing():
    for n in range(1, 60):
        least, most = bounds(n, 0.8)
        reach = [b for b in range(1, 200) if 2 * min(b, n) / (b + n) >= 0.8]
        assert (least, most) == (min(reach), max(reach))


def test_templates_are_told_apart():
    grams = [(name, set(template_bigrams(t))) for name, t in TEMPLATES]
    for i, (a, x) in enumerate(grams):
        for b, y in grams[:i]:
            assert a == b or 2 * len(x & y) / (len(x) + len(y)) < 1


def test_empty_and_native(spark):
    assert license_scan(empty(spark)).collect() == []
    plan = license_scan(awkward(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
