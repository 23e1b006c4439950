"""Inputs of the jobs derived from the given tables.

Each view is one SQL text that Spark and a check engine both run unchanged.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from panelflow.session import materialize, spread

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

BLANKS = "' 　' || chr(9) || chr(10)"  # what the derived texts are padded with, in SQL

VIEWS = {
    # log lines; '?' image numbers must vanish, one text contains two rule markers
    "v_log_lines": """
SELECT event_id AS seq, ts,
  '[' || substr(cast(ts AS varchar(40)),12,8) || '] [작업 #' || cast(user_id AS varchar(20)) || ' · 이미지 #' ||
  CASE WHEN event_id % 50 = 0 THEN '?' WHEN event_id % 50 = 1 THEN '123456789012345678901234567890' ELSE cast(event_id % 40 + 1 AS varchar(20)) END || '] ' ||
  CASE event_type
    WHEN 'signup' THEN CASE WHEN user_id % 2 = 0 THEN '요청 수신 · 1.24 MB · <zip> · zip' ELSE '요청 수신 · 800 KB · <img> · example.com/page.png' END
    WHEN 'view' THEN '자동 검수 1/3 · 합성 결과 시각 검수 3/3 시작 · 첨부 자료 5개'
    WHEN 'click' THEN '자동 검수 3회 미통과 · 사용자 검수 필요'
    WHEN 'error' THEN '오류 · timeout'
    ELSE CASE WHEN user_id % 2 = 0 THEN 'ZIP 이미지 저장 확인 · <zip>' ELSE '페이지 이미지 교체 확인 · <img>' END END AS line
FROM events""",
    # regions on a coarse grid: many near copies, null confidence, blank translation
    "v_regions": """
SELECT l_orderkey AS image_id, cast(row_number() OVER (PARTITION BY l_orderkey
    ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount, l_returnflag) AS bigint) AS ord,
  (l_partkey % 5) * 150 + l_suppkey % 7 AS x0, (l_partkey % 3) * 250 + l_suppkey % 5 AS y0,
  (l_partkey % 5) * 150 + 120 AS x1, (l_partkey % 3) * 250 + 200 AS y1,
  CASE WHEN l_linenumber = 7 THEN NULL ELSE round(l_discount * 10, 2) END AS confidence,
  CASE l_returnflag WHEN 'A' THEN 'dialogue' WHEN 'N' THEN 'narration' ELSE 'sfx' END AS region_kind,
  CASE WHEN l_quantity < 2 THEN ' ' WHEN l_quantity < 3 THEN '　' || chr(9) || chr(10) WHEN l_quantity < 4 THEN '　t' || chr(10) ELSE 't' || cast(l_partkey AS varchar(20)) END AS translated
FROM lineitem""",
    # pages with an image-bearing element appended
    "v_pages_img": """
SELECT page_id, url, html || CASE page_id % 4
  WHEN 0 THEN '<img src="/a/' || cast(page_id AS varchar(20)) || '.png" width="640" height="360">'
  WHEN 1 THEN '<img data-src="b.jpg" width="60" height="30">'
  WHEN 2 THEN '<img srcset="c.webp 1x, d.webp 2x" width="300" height="200">'
  ELSE '<div style="background-image:url(e.png)"></div>' END AS html
FROM pages""",
    # archive entries: upper-case suffix, non-image, directory
    "v_entries": """
SELECT o_custkey AS archive_id, o_orderkey AS entry_index,
  'p/' || cast(o_orderkey AS varchar(20)) || CASE o_orderkey % 4 WHEN 0 THEN '.PNG' WHEN 1 THEN '.jpg' WHEN 2 THEN '.txt' ELSE '/' END AS name,
  o_orderkey % 11 = 0 AS skip, o_orderkey % 13 = 0 AS error, o_orderkey % 2 = 0 AS changed
FROM orders""",
    # run event lines with unparsable JSON and plain text
    "v_run_events": """
SELECT event_id AS seq, user_id AS run_id, CASE event_type
  WHEN 'error' THEN '{"type":"turn.failed","error":{"message":"boom ' || cast(event_id % 9 AS varchar(20)) || '"}}'
  WHEN 'click' THEN '{"type":"item.completed","item":{"type":"command_execution","exit_code":2,"aggregated_output":"denied"}}'
  WHEN 'view' THEN '{"type":"item.completed","item":{"type":"agent_message","text":"m' || cast(event_id % 7 AS varchar(20)) || '"}}'
  WHEN 'signup' THEN '{broken'
  ELSE 'plain text' END AS line
FROM events""",
}

# chained overlaps: neighbours copy each other, the ends of a chain do not
VIEWS["v_chained"] = VIEWS["v_regions"].replace("l_suppkey % 7 AS x0", "(l_suppkey % 7) * 8 AS x0").replace(
    "* 150 + 120 AS x1", "* 150 + (l_suppkey % 7) * 8 + 120 AS x1")

# regions with layout areas, colours and sizes, some of them unusable
VIEWS["v_styled"] = f"""
SELECT image_id, ord, x0, y0, x1, y1, confidence, translated,
  CASE WHEN ord % 6 = 5 THEN 'other' ELSE region_kind END AS region_kind,
  ord % 5 <> 4 AS has_layout,
  x0 - (ord % 3) * 20 AS lx0, y0 + (ord % 2) * 60 AS ly0, x1 + (ord % 3) * 25 AS lx1, y1 + (ord % 4) * 10 AS ly1,
  CASE WHEN ord % 5 = 0 THEN NULL ELSE cast((x0 + y0) % 60 AS double) END AS font_size,
  CASE ord % 3 WHEN 0 THEN '#11Aa3' || cast(ord % 10 AS varchar(20)) WHEN 1 THEN ' #102030' ELSE 'red' END AS text_color,
  CASE ord % 4 WHEN 0 THEN '#ffffff' WHEN 1 THEN '#f0e0d0' ELSE NULL END AS background_color,
  CASE ord % 2 WHEN 0 THEN '#0000ff' ELSE '' END AS stroke_color,
  cast(ord % 4 AS double) AS stroke_width, cast(ord * 70 - 280 AS double) AS rotation,
  ord % 3 = 1 AS background_complex,
  CASE ord % 2 WHEN 0 THEN 'vertical' ELSE 'horizontal' END AS orientation
FROM ({VIEWS["v_regions"].strip()}
) r"""

# one model answer per line, with every kind of fault
VIEWS["v_answers"] = """
SELECT image_id, n, CASE n % 16
  WHEN 8 THEN '{"regions":[' || part_a || '}'
  WHEN 9 THEN '{"regions":{}}'
  WHEN 11 THEN '{"regions":[],"note":1}'
  WHEN 12 THEN '[1]'
  ELSE '{"regions":[' || part_a || part_b || '}]}' END AS output
FROM (
  SELECT image_id, n,
    '{"box":[10,20,' || CASE WHEN n % 16 = 5 THEN '30' ELSE '300,400.5' END || '],"layoutBox":[0,0,500,500],"original":"o' ||
    cast(n AS varchar(20)) || '","translated":"t","regionKind":"' || CASE WHEN n % 16 = 6 THEN 'shout' ELSE 'sfx' END ||
    '","orientation":"vertical","fontSize":' || cast(n % 40 AS varchar(20)) ||
    ',"textColor":"#112233","backgroundColor":"#ffffff","bold":' || CASE WHEN n % 16 = 10 THEN '"yes"' ELSE 'true' END ||
    ',"fontStyle":"serif","strokeColor":"#000000","strokeWidth":2,"italic":false,"rotation":-4.5,"align":"left","backgroundComplex":true' AS part_a,
    CASE n % 16 WHEN 1 THEN '' WHEN 2 THEN ',"confidence":null' WHEN 3 THEN ',"confidence":"0.9"' WHEN 4 THEN ',"confidence":1.5'
      ELSE ',"confidence":' || cast(share AS varchar(20)) END || CASE WHEN n % 16 = 7 THEN ',"zeta":1,"alpha":2' ELSE '' END AS part_b
  FROM (SELECT l_orderkey AS image_id, l_partkey + l_linenumber AS n, l_discount AS share FROM lineitem) a
) b"""

# crops on few, long pages (one page may hold any number of crops)
VIEWS["v_crops"] = f"""
SELECT page, crop_index, x0 AS left_edge, y0 AS top_edge,
  x0 + 200 + (x0 * 37 + crop_index * 211) % 1500 AS right_edge, y0 + 300 + (y0 * 53 + crop_index * 97) % 1800 AS bottom_edge
FROM (
  SELECT image_id % 101 AS page, x0, y0,
    cast(row_number() OVER (PARTITION BY image_id % 101 ORDER BY image_id, ord) AS bigint) AS crop_index
  FROM ({VIEWS["v_regions"].strip()}
  ) r
) q"""

# captions to be set: half of them Korean
VIEWS["v_captions"] = """
SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN '가 ' || text ELSE text END AS translated,
  CASE WHEN conv_id % 3 = 0 THEN 'horizontal' ELSE 'vertical' END AS orientation,
  CASE conv_id % 4 WHEN 0 THEN 'dialogue' WHEN 1 THEN 'narration' WHEN 2 THEN 'sfx' ELSE 'label' END AS region_kind,
  cast(90 + (conv_id * 7 + turn) % 11 * 80 AS double) AS layout_width,
  cast(60 + (conv_id * 5 + turn) % 13 * 70 AS double) AS layout_height,
  cast(9 + (conv_id + turn) % 40 AS double) AS font_px
FROM conversations"""


# pages with image-bearing elements of every kind, also hidden in comments and scripts
VIEWS["v_pages_rich"] = """
SELECT page_id, url, html || CASE page_id % 10
  WHEN 0 THEN '<img src="/a/' || cast(page_id AS varchar(20)) || '.png" width="640" height="360">'
  WHEN 1 THEN '<IMG data-src=' || chr(39) || 'b.jpg' || chr(39) || ' width=60 height=30>'
  WHEN 2 THEN '<img srcset="c.webp 1x, d.webp 2x" width="300" height="200">'
  WHEN 3 THEN '<div style="background-image:url(e.png)"></div>'
  WHEN 4 THEN '<img src="" data-original="//cdn.example.com/z.jpg" width="500" height="400"><canvas width="200" height="100"></canvas>'
  WHEN 5 THEN '<!-- <img src="no.png"> --><span style="color:red; background: url(' || chr(39) || '../up/./f.png' || chr(39) || ')">x</span>'
  WHEN 6 THEN '<svg width="120" height="80"></svg>'
  WHEN 7 THEN '<img src="https://o.example.net/p.png?x=1&amp;y=2" width="120" height="80" style="display:none">'
  WHEN 8 THEN '<script>document.write(' || chr(39) || '<img src="s.png">' || chr(39) || ')</script><img data-srcset="g.png 2x" width="121" height="79">'
  ELSE '<img alt="none" width="900" height="900">' END || CASE WHEN page_id % 97 = 13 THEN '<div ' || repeat('x', 1000000) ELSE '' END AS html
FROM pages"""

# pages whose pictures depend on what is around them
VIEWS["v_pages_tree"] = """
SELECT page_id, url, html || CASE page_id % 10
  WHEN 0 THEN '<div style="display:none"><p><img src="/h.png" width="300" height="200"></p></div>'
  WHEN 1 THEN '<div hidden><section><img src="/h.png" width=300 height=200></section></div>'
  WHEN 2 THEN '<div style="visibility:hidden"><img src="/a.png" width="300"><img src="/b.png" width="300" style="visibility:visible"></div>'
  WHEN 3 THEN '<div style="opacity:.2"><div style="opacity:0.2"><img src="/o.png"></div></div><div style="opacity:50%"><img src="/q.png"></div>'
  WHEN 4 THEN '<template><img src="/t.png"></template><textarea><img src="/x.png"></textarea><noscript><img src="/n.png"></noscript><img src="/i.png">'
  WHEN 5 THEN '<style>.zhero{background:url("/hero.png")} #ztop{background-image:url(/top.png)} x-m{background:#fff url(/m.png)} .zhero.zoff{background:none}'
    || ' @media print{x-m{background:none}}</style><div class="big zhero"></div><div id="ztop" class="zhero"></div><x-m></x-m><div class="zhero zoff"></div>'
  WHEN 6 THEN '<x-card><template shadowrootmode="open"><style>x-b{background:url(/s.png)}</style><x-b>x</x-b><img src="/in.png"></template></x-card><x-b>y</x-b>'
  WHEN 7 THEN '<style>.zgone{display:none} .zpic::before{content:"";background:url(/p.png)}</style><div class=zgone><img src="/g.png"></div><span class="zpic"></span>'
  WHEN 8 THEN '<ul><li hidden><img src="/l1.png"><li><img src="/l2.png"></ul>'
  ELSE '<p style="display:none">x<div><img src="/d.png"></div>' END AS html
FROM pages"""

# work requests with payloads, some not acceptable
VIEWS["v_requests"] = """
SELECT conv_id, turn, text, CASE turn % 5 WHEN 0 THEN 'image/png' WHEN 1 THEN 'image/jpeg' WHEN 2 THEN 'image/gif' WHEN 3 THEN NULL ELSE 'image/webp' END AS mime,
  CASE WHEN conv_id % 9 = 0 THEN text WHEN conv_id % 9 = 1 THEN '' WHEN conv_id % 9 = 2 THEN '====' ELSE substr(md5(text), 1, cast(4 * (1 + conv_id % 7) AS int)) || CASE conv_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'QQ==' ELSE 'QUE=' END END AS data,
  CASE conv_id % 4 WHEN 0 THEN 'manual' WHEN 1 THEN 'automatic' ELSE NULL END AS review_mode,
  conv_id % 5 = 0 AS skip, cast(conv_id % 8 AS double) / CASE WHEN conv_id % 6 = 0 THEN 4 ELSE 1 END AS attempts,
  CASE conv_id % 3 WHEN 0 THEN 'codex-image' WHEN 1 THEN 'other' ELSE NULL END AS render,
  CASE conv_id % 6 WHEN 0 THEN 'zip' WHEN 1 THEN 'img' WHEN 2 THEN '' ELSE role END AS element,
  CASE conv_id % 7 WHEN 0 THEN 'canvas:' WHEN 1 THEN 'https://Img.Example.com/a%20b/' || cast(turn AS varchar(20)) || '.png?q=1' WHEN 2 THEN 'nothing here'
    WHEN 3 THEN 'http://x.example.org' ELSE 'zip://pages/' || cast(turn AS varchar(20)) || '.png' END AS source_url
FROM conversations"""


def _uuid(value: str) -> str:
    h = f"md5({value})"
    return " || '-' || ".join(f"substr({h}, {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))


_THREAD, _OTHER = _uuid("cast(user_id AS varchar(20))"), _uuid("cast(user_id + 7 AS varchar(20))")

# run output of all kinds: events, nested ids, escaped and plain paths, noise
VIEWS["v_run_lines"] = f"""
SELECT event_id AS seq, user_id AS run_id,
  CASE WHEN event_id % 12 IN (4, 9, 10) AND user_id % 7 <> 3 THEN 'stderr' ELSE 'stdout' END AS stream,
  CASE WHEN user_id % 7 = 3 THEN 'plain   output ' || cast(event_id AS varchar(20)) ELSE CASE event_id % 12
    WHEN 0 THEN '{{"type":"thread.started","thread_id":"' || {_THREAD} || '"}}'
    WHEN 1 THEN '{{"type":"item.completed","item":{{"type":"agent_message","text":"saved C:' || chr(92) || chr(92) || 'gen' || chr(92) || chr(92) || {_THREAD}
      || chr(92) || chr(92) || 'img' || cast(event_id % 7 AS varchar(20)) || '.png ok"}}}}'
    WHEN 2 THEN '{{"type":"item.completed","item":{{"type":"command_execution","exit_code":2,"aggregated_output":"denied ' || cast(event_id % 3 AS varchar(20)) || '"}}}}'
    WHEN 3 THEN CASE WHEN event_id % 5000 = 3 THEN '{{"pad":"' || repeat('y', 1000000) || '","path":"C:/gen/long.png"}}'
      WHEN user_id % 13 = 0 THEN '{{"key.png":"C:' || chr(92) || 'u005cgen' || chr(92) || 'u005cu' || cast(event_id % 5 AS varchar(20)) || '.png","next":":,"}}'
      ELSE '{{"type":"item.completed","item":{{"type":"command_execution","exit_code":0,"aggregated_output":"fine"}}}}' END
    WHEN 4 THEN 'warn  models cache   stale ' || cast(event_id % 4 AS varchar(20))
    WHEN 5 THEN '{{"type":"turn.failed","error":{{"message":"boom ' || cast(event_id % 9 AS varchar(20)) || '"}}}}'
    WHEN 6 THEN ' {{"type":"Error","message":"rate limit","item":{{"error":"inner","message":{{"detail":"deep"}}}}}}'
    WHEN 7 THEN 'wrote D:' || chr(92) || 'other' || chr(92) || 'x' || cast(event_id % 3 AS varchar(20)) || '.JPG and c:/gen/y.webp'
    WHEN 8 THEN CASE WHEN user_id % 11 = 0 THEN 'the safety filter chose to block this' ELSE '{{broken' END
    WHEN 9 THEN 'trace ' || cast(event_id % 5 AS varchar(20))
    WHEN 10 THEN CASE WHEN user_id % 5 = 0 THEN 'prompt_cache_retention is not supported on this model' ELSE '  ' END
    ELSE '[{{"a":{{"threadId":"' || {_OTHER} || '"}}}},"x"]' END END AS line
FROM events"""

VIEWS["v_runs"] = """
SELECT DISTINCT user_id AS run_id, CASE WHEN user_id % 6 = 0 THEN '' ELSE 'render ' || cast(user_id % 3 AS varchar(20)) END AS stage,
  user_id % 4 AS exit_code, CASE WHEN user_id % 9 = 0 THEN 'spawn failed' ELSE '' END AS spawn_error,
  user_id % 13 = 0 AS cancelled, user_id % 17 = 0 AS timed_out
FROM events"""

VIEWS["v_files"] = f"""
SELECT DISTINCT 'C:' || chr(92) || 'gen' || chr(92) || {_THREAD} || chr(92) || 'img' || cast(event_id % 7 AS varchar(20)) || '.png' AS path,
  event_id % 7 * 10 + user_id % 10 AS modified_at
FROM events WHERE user_id % 3 <> 0 AND event_id % 7 < 4"""


def view_text(name: str) -> str:
    return VIEWS[name].strip()


def with_views(body: str, *names: str) -> str:
    """``body`` with the named views put in front as common table expressions."""
    head = ",\n".join(f"{name} AS (\n{view_text(name)}\n)" for name in names)
    if not head:
        return body.strip()
    body = body.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {head},\n{body[5:]}"
    return f"WITH {head}\n{body}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str, heavy: bool = False, by: str | None = None) -> DataFrame:
    """The derived view ``name`` over the tables in ``sf_dir``; ``heavy`` spreads small scans over all cores.

    ``by`` deals the tables out by that column first: for views with a window over it, which else shuffles the derived
    columns beside those of the table, and for jobs that group by it afterwards.
    """
    text = view_text(name).replace("{", "{{").replace("}", "}}")
    used = sorted({t for t in TABLES if re.search(rf"\bFROM {t}\b", text)})
    for t in used:
        text = re.sub(rf"\bFROM {t}\b", f"FROM {{{t}}}", text)
    sources = {t: table(spark, sf_dir, t) for t in used}
    if by:
        sources = {t: df.repartition(by) for t, df in sources.items()}
    return spark.sql(text, **{t: spread(df) if heavy else df for t, df in sources.items()})


def stored_view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The derived view ``name`` written once and read back.

    For views with a ``repeat`` of a million characters: Spark folds it into a literal, which would stand in the
    plan (and in its text, which the driver keeps) wherever the column is used.
    """
    return materialize(view(spark, sf_dir, name, heavy=True), name)
