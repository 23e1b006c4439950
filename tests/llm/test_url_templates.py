import re

from llm.cases import awkward, empty, rows
from pyspark.sql import functions as F

from panelflow.llm.queries import URL_RULES, op3_url_templates
from panelflow.llm.url_templates import BAD_WORDS, page_evidence, url_filter

URLS = [
    None, "", "no scheme/en/", "http://a.com/x", "HTTP://A.B.Com/en/1?q=/es/", "https://example.com/en/1", "https://www.example.com/en/1", "https://m.www.EXAMPLE.com/en/",
    "https://notexample.com/en/1", "http://x.net/es/1#t", "http://net/fr/", "http://x.net/fr", "http://x.net?u=/es/", "http://x.org/en/1", "http://a://b.com/c", "x://h.com", "http://e.net/ES/1",
    "http://fooexample.com/en/", "http://x.com\n.net/es/", "http://é.com/en/É",
]


def parse(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] + [len(rest)])
    host, rest = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
    return host, rest[:min([rest.find(c) for c in "?#" if c in rest] + [len(rest)])]


def ruled(host, path):
    best = None
    for text, told in URL_RULES:
        name, _, tail = text.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + tail) and (best is None or len(text) > len(best[0])):
            best = (text, told)
    return best


def test_hosts_paths_and_rules(spark):
    df = spark.createDataFrame(list(enumerate(URLS)), "page_id bigint, url string")
    got = {r[0]: r[1:5] for r in rows(url_filter(df, URL_RULES))}
    assert len(got) == len(URLS)
    for i, url in enumerate(URLS):
        host, path = parse(url)
        rule = ruled(host, path)
        assert got[i][:3] == (host, path, rule and rule[0]), url
        assert got[i][3] == (rule[1] if rule else "allow"), url


def planted(spark):
    found = []
    for k in range(300):
        found += [(f"http://h.org/news/{k}", None), (f"http://h.org/blog/{k}/x", False), (f"http://h.org/shop/{k}", True if k % 2 else None), (f"http://h.org/ads/{k}", True), (f"http://q.org/u{k}", None)]
    found += [("http://few.org/a", True), ("http://few.org/b", None), ("http://few.org/c", None)]
    return spark.createDataFrame([(i, u, b) for i, (u, b) in enumerate(found)], "page_id bigint, url string, bad boolean")


def test_templates_reject_by_purity(spark):
    got = rows(url_filter(planted(spark), (), bad=F.col("bad")), "host", "path", "template", "verdict")
    told = {(h, p.split("/")[1]): (t, v) for h, p, t, v in got}
    assert told["h.org", "news"] == ("/news/*", "allow") and told["h.org", "blog"] == ("/blog/*/x", "allow")
    assert told["h.org", "ads"] == told["h.org", "shop"] == ("/{ads|shop}/*", "block")  # alike where labelled
    assert told["q.org", "u7"] == ("/*", "allow") and told["few.org", "a"][1] == "allow"  # too few labels


def test_rules_judge_no_pages_beside_their_path(spark):
    for n in (13, 40):  # below and above the support of a literal segment
        urls = [f"http://s.example.net/{lang}/{k}" for lang in ("de", "es", "fr") for k in range(n)]
        df = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
        got = {(p.split("/")[1], v) for p, v in rows(url_filter(df, URL_RULES), "path", "verdict")}
        assert got == {("de", "allow"), ("es", "block"), ("fr", "block")}
    deep = "/".join(["s"] * 10)
    df = spark.createDataFrame([(k, f"http://d.org/{deep}/{'x' if k % 3 else 'y'}/{k}") for k in range(60)], "page_id bigint, url string")
    got = {(p.split("/")[11], v) for p, v in rows(url_filter(df, [(f"d.org/{deep}/x/", "block")]), "path", "verdict")}
    assert got == {("x", "block"), ("y", "allow")}


def test_deep_paths_and_depth(spark):
    df = spark.createDataFrame([(i, "http://d.org/" + "/".join(["s"] * 40) + f"/{i}") for i in range(30)], "page_id bigint, url string")
    assert set(rows(url_filter(df, (), depth=3), "template")) == {("/s/s/s/**",)}


def test_other_rows(spark):
    got = rows(url_filter(awkward(spark), URL_RULES, page_id="doc_id"), "page_id", "host", "path", "rule", "verdict")
    assert sorted(got, key=str) == sorted([(i, "", "", None, "allow") for (i,) in rows(awkward(spark), "doc_id")], key=str)
    assert url_filter(empty(spark), URL_RULES, page_id="doc_id").collect() == []


def evident(url, html):
    host, path = parse(url)
    if set(re.split("[^a-z]+", (host + path).lower())) & set(BAD_WORDS):
        return True
    if html is None:
        return None
    text = re.sub(r"(?is)<(script|style)\b.*?(?:</\1\s*>|\Z)|<!--.*?(?:-->|\Z)|<[^<>]*>", " ", html)
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    solid = "".join(words)
    return len(words) < 50 or sum(c in "#*$%|" for c in solid) > 0.05 * len(solid)


def evidence_cases():
    prose, junk = " ".join(["word"] * 60), " ".join(["wo###rd"] * 60)
    htmls = [None, "", "<p>" + prose, junk, "<script>" + prose, f"<style>{prose}</style>few", f"<!-- {prose}", "<" * 5000, f"<p>{prose}<!-- x --><b>{junk[:40]}", prose + "<" * 50]
    urls = [None, "", "http://a.org/x", "http://casino-win.org/x", "http://a.org/Poker/1", "http://pokers.org/x"]
    return [(i, u, h) for i, (u, h) in enumerate((u, h) for u in urls for h in htmls)]


def test_evidence_of_pages(spark):
    df = spark.createDataFrame(evidence_cases(), "page_id bigint, url string, html string")
    got = dict(rows(df.select("page_id", page_evidence(F.col("url"), F.col("html")).alias("bad"))))
    assert got == {i: evident(u, h) for i, u, h in evidence_cases()}
    assert {v for v in got.values()} == {True, False, None}


def test_evidence_decides_templates(spark, tmp_path):
    prose, junk = " ".join(["word"] * 60), " ".join(["wo###rd"] * 60)
    found = [(f"http://h.org/{part}/{k}", junk if part == "bad" and k % 10 or k % 10 == 9 else prose) for part in ("good", "bad") for k in range(60)]
    found += [(f"http://best-bets.org/{k}", prose) for k in range(30)] + [(f"http://x.org/{k}", None) for k in range(30)]
    pages = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(found)], "page_id bigint, url string, html string")
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    got = {(h, p.split("/")[1] if h == "h.org" else "", v) for h, p, v in rows(op3_url_templates(spark, str(tmp_path)), "host", "path", "verdict")}
    assert got == {("h.org", "good", "allow"), ("h.org", "bad", "block"), ("best-bets.org", "", "block"), ("x.org", "", "allow")}
