"""URL filtering by explicit rules and, where none fits, by a tree of path templates for each host.

The tree is grown level by level. Of the segments below a node those that hold enough of its pages stay literal, all
others are variable and become one wildcard. Labels that rules made know nothing of pages beside the rule's path, so
the segments of such a path stay literal whatever their support. Sibling branches that differ in one literal and whose labelled pages
show no significant difference are merged. A (merged) template is rejected when its labelled purity, smoothed by
as many good as bad pages, is too low and enough of its pages are labelled; one without labels never is.

Every step is a grouped count or a join of written tables, so a host may hold any share of the pages.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelflow.session import materialize

DEPTH = 8  # literal or wildcard segments of a template; what follows is one open end
MIN_SUPPORT, MIN_SHARE = 20, 0.01
SMOOTHING, MIN_PURITY, MIN_LABELLED, SIGNIFICANCE = 10.0, 0.4, 0.5, 1.96
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Fixed values of the evidence: signs of junk, words of addresses that lead to gambling, drugs, adult or spam pages.
SIGNS, SIGN_SHARE, MIN_WORDS = "#*$%|", 0.05, 50
BAD_WORDS = (
    "adult", "bets", "betting", "casino", "escort", "gambling", "hentai", "jackpot", "pharmacy", "pills", "poker", "porn",
    "roulette", "sex", "slots", "spam", "viagra", "warez", "webcam", "xxx",
)
_UNSEEN = r"(?is)<(script|style)\b.*?(?:</\1\s*>|\z)|<!--.*?(?:-->|\z)|<[^<>]*>"


def page_evidence(url: Column, html: Column) -> Column:
    """Is the page bad by itself: a bad word in its address, too few words, or too large a share of signs in them?

    Null where there is neither a page nor a bad word. Tags, comments, scripts and styles are not text.
    """
    host, path = host_and_path(url)
    named = F.arrays_overlap(F.split(F.lower(F.concat(host, path)), "[^a-z]+"), F.array(*[F.lit(w) for w in BAD_WORDS]))
    text = F.trim(F.regexp_replace(F.regexp_replace(html, _UNSEEN, " "), r"[\x20\x09-\x0D]+", " "))
    solid = F.translate(text, " ", "")
    n_words = F.when(text == "", 0).otherwise(F.length(text) - F.length(solid) + 1)
    n_signs = F.length(solid) - F.length(F.translate(solid, SIGNS, ""))
    return F.when(named, True).otherwise((n_words < MIN_WORDS) | (n_signs > SIGN_SHARE * F.length(solid)))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty where the URL is null or has no ``://``."""
    known = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(known, _URL, 1), _UPPER, _LOWER), F.regexp_extract(known, _URL, 2)


def match_rules(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, or nulls. ``rules``: (host/path prefix, allow or block)."""
    if not rules:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, told in sorted(rules, key=lambda r: (len(r[0]), r[0])):  # the longest is tried first in the end
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(told)).otherwise(verdict)
    return rule, verdict


def _grow(rows: DataFrame, depth: int, min_support: int, min_share: float) -> DataFrame:
    """``rows`` (host, segments, ruled, ...: so many segments are literal) with ``template``, and ``stem`` and ``rest``: it without its last literal, ``word``."""
    deepest = rows.agg(F.max(F.size("segments")).alias("d")).first().d or 0
    rows = rows.withColumn("template", F.lit("")).withColumn("stem", F.lit("")).withColumn("word", F.lit("")).withColumn("rest", F.lit(""))
    for level in range(min(depth, deepest)):
        here = rows.withColumn("token", F.get("segments", F.lit(level)))
        children = materialize(
            here.filter("token is not null").groupBy("host", "template", "token").agg(
                F.count(F.lit(1)).alias("n"), F.max(F.col("ruled") > level).alias("kept")), "children")
        parents = materialize(children.groupBy("host", "template").agg(F.sum("n").alias("total")), "parents")
        literal = materialize(
            children.filter((F.col("n") >= min_support) | F.col("kept")).join(parents, ["host", "template"])
            .filter((F.col("n") >= min_share * F.col("total")) | F.col("kept")).select("host", "template", "token", F.lit(True).alias("literal")), "literals")
        step = F.when(F.col("token").isNull(), "").when(F.col("literal"), F.concat(F.lit("/"), "token")).otherwise("/*")
        grown = here.join(literal, ["host", "template", "token"], "left").withColumn("step", step).withColumn("literal", F.coalesce("literal", F.lit(False)))
        rows = materialize(grown.select(
            *[c for c in rows.columns if c not in ("template", "stem", "word", "rest")],
            F.concat("template", "step").alias("template"),
            F.when(F.col("literal"), F.col("template")).otherwise(F.col("stem")).alias("stem"),
            F.when(F.col("literal"), F.col("token")).otherwise(F.col("word")).alias("word"),
            F.when(F.col("literal"), "").otherwise(F.concat("rest", "step")).alias("rest")), "grown")
    return rows.withColumn("rest", F.when(F.size("segments") > depth, F.concat("rest", F.lit("/**"))).otherwise(F.col("rest")))


def _judge(templates: DataFrame, smoothing: float, min_purity: float, min_labelled: float, significance: float) -> DataFrame:
    """(host, stem, word, rest, pages, labelled, bad) with ``branch`` (of merged siblings), ``purity`` and ``rejected``."""
    siblings = Window.partitionBy("host", "stem", "rest")
    ordered = siblings.orderBy(F.col("labelled") > 0, F.col("bad") / F.nullif(F.col("labelled"), F.lit(0)), "word")
    n, m, bad, was = F.col("labelled"), F.lag("labelled").over(ordered), F.col("bad"), F.lag("bad").over(ordered)
    pooled = (bad + was) / (n + m)
    unlike = (n > 0) & ((m == 0) | (F.abs(bad / n - was / m) > significance * F.sqrt(pooled * (1 - pooled) * (1 / n + 1 / m))))
    parted = templates.withColumn("first", F.coalesce(F.when(n > 0, unlike).otherwise(False), F.lit(False)).cast("int"))
    branches = parted.withColumn("branch", F.sum("first").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    merged = Window.partitionBy("host", "stem", "rest", "branch")
    all_n, all_bad = F.sum("labelled").over(merged), F.sum("bad").over(merged)
    purity = 1 - (all_bad + smoothing / 2) / (all_n + smoothing)
    known = all_n >= min_labelled * F.sum("pages").over(merged)
    return branches.withColumn("purity", purity).withColumn("rejected", (F.col("purity") < min_purity) & known).withColumn(
        "words", F.array_sort(F.collect_list("word").over(merged)))


def url_filter(pages: DataFrame, rules: Sequence[tuple[str, str]], url: str = "url", page_id: str = "page_id", bad: Column | None = None,
               depth: int = DEPTH, min_support: int = MIN_SUPPORT, min_share: float = MIN_SHARE, smoothing: float = SMOOTHING,
               min_purity: float = MIN_PURITY, min_labelled: float = MIN_LABELLED, significance: float = SIGNIFICANCE) -> DataFrame:
    """The verdict on every row: page_id, host, path, rule, verdict, template, purity.

    ``bad`` labels pages of known quality (boolean, null: unknown), such as :func:`page_evidence`; without it the pages that a rule fits are the
    labelled ones, and judge no page beside the path of their rule. Null URLs and those without ``://`` have an empty host and path and are judged with each other.
    Null or repeated identifiers are judged like any other row, an empty table gives no rows, and columns not named
    are not looked at. Templates show merged siblings in braces.
    """
    host, path = host_and_path(F.col(url))
    parsed = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"),
                          (bad if bad is not None else F.lit(None)).cast("boolean").alias("label"))
    rule, told = match_rules(F.col("host"), F.col("path"), rules)
    parsed = parsed.withColumn("rule", rule).withColumn("told", told)
    ruled = F.lit(0)
    if bad is None:
        parsed = parsed.withColumn("label", F.col("told") == "block")
        of_rule = F.filter(F.split(F.regexp_replace("rule", "^[^/]*", ""), "/"), lambda s: s != "")
        ruled = F.when(F.col("rule").isNull(), 0).otherwise(F.size(of_rule))
        depth = max([depth, *(sum(map(bool, text.partition("/")[2].split("/"))) for text, _ in rules)])
    rows = materialize(parsed.withColumn("segments", F.filter(F.split("path", "/"), lambda s: s != "")).withColumn("ruled", ruled), "pages")
    grown = _grow(rows, depth, min_support, min_share)
    templates = materialize(grown.groupBy("host", "stem", "word", "rest").agg(
        F.count(F.lit(1)).alias("pages"), F.count("label").alias("labelled"), F.count_if("label").alias("bad")), "templates")
    judged = materialize(_judge(templates, smoothing, min_purity, min_labelled, significance).select("host", "stem", "word", "rest", "purity", "rejected", "words"), "judged")
    shown = F.when(F.size("words") > 1, F.concat(F.lit("/{"), F.array_join("words", "|"), F.lit("}"))).when(F.col("word") != "", F.concat(F.lit("/"), "word")).otherwise("")
    return grown.join(judged, ["host", "stem", "word", "rest"]).select(
        "page_id", "host", "path", "rule", F.coalesce("told", F.when(F.col("rejected"), "block").otherwise("allow")).alias("verdict"),
        F.concat("stem", shown, "rest").alias("template"), "purity")
