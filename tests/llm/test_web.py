import random

import duckdb
import pytest

from latewing.llm import htmltext, queries, shared, topk, urlrules
from latewing.llm.urlrules import HostRule, PatternRule

URLS = [
    "http://www.example.com/en/1", "http://m.example.com/en/1?x", "https://example.com/fr/", "http://EXAMPLE.com/en/", "http://a.net/es/x", "http://a.net/fr/#y", "http://a.net/de/",
    "http://www.example.com", "http://x.com?en/", "http://notexample.com/en/", "http://examplexcom/en/", "no scheme/en/", "", None, "http://user@h.com/a://b", "a://b://c/d",
    "http://m.casino-win.org/x", "http://casinowin.org/x", "http://x.org/online/casino", "http://x.org/casino-museum", "http://net/fr/", "://com/", "http://a.com/en/EN/", "http://www.example.com/EN/",
]


@pytest.fixture()
def pages(spark):
    return spark.createDataFrame([(i, u, "clash") for i, u in enumerate([*URLS, URLS[0]])], "page_id long, url string, path string")


def brute(url):
    text = url or ""
    host = path = ""
    if "://" in text:
        rest = text.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fit = [r for r in urlrules.HOST_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fit, key=lambda r: len(r.name), default=None)
    found = sorted((r.verdict, r.name) for r in urlrules.PATTERN_RULES if r.matcher()(text.lower(), host, path))
    return host, path, best and best.name, best.verdict if best else found[0][0] if found else "allow"


def test_urls(spark, pages):
    rows = urlrules.judge_urls(pages).orderBy("page_id").collect()
    assert [(r.url_verdict.host, r.url_verdict.path, r.url_verdict.rule, r.url_verdict.verdict) for r in rows] == [brute(u) for u in [*URLS, URLS[0]]]
    assert urlrules.judge_urls(pages.limit(0)).count() == 0
    assert urlrules.judge_urls(pages, hosts=[], patterns=[]).where("url_verdict.verdict <> 'allow'").count() == 0


def test_patterns_with_stars_and_host_anchors(spark):
    rules = [PatternRule("||ads.*^click"), PatternRule("^aff_id=*&offer="), PatternRule("@@||docs.*^click")]
    urls = {
        "http://ads.x.org/a/click?1": "block", "http://www.ads.x.org/click": "block", "http://loads.x.org/click": "allow", "http://x.org/ads.y/click": "allow",
        "http://x.org/?aff_id=3&z&offer=1": "block", "http://x.org/?xaff_id=3&offer=1": "allow", "http://docs.x.org/ads.z/click": "allow", "http://ads.docs.x.org/click": "allow",
    }
    table = spark.createDataFrame(list(urls.items()), "u string, want string").selectExpr("*", "1 as _host", "2 as _path", "3 as _r0", "4 as host", "'old' as url_verdict")
    made = urlrules.judge_urls(table, "u", hosts=[], patterns=rules)
    assert made.columns == ["u", "want", "_host", "_path", "_r0", "host", "url_verdict"]
    assert all(r.url_verdict.verdict == r.want and (r._host, r._path, r._r0, r.host) == (1, 2, 3, 4) for r in made.collect())


def test_parts_of_long_lists_agree(spark, pages, monkeypatch):
    whole = urlrules.judge_urls(pages).select("page_id", "url_verdict.rule", "url_verdict.verdict", "url_verdict.pattern").orderBy("page_id").collect()
    monkeypatch.setattr(urlrules, "RULES_PER_PASS", 4)
    assert urlrules.judge_urls(pages).select("page_id", "url_verdict.rule", "url_verdict.verdict", "url_verdict.pattern").orderBy("page_id").collect() == whole


def test_rules_are_filed_under_their_rarest_token(spark, pages):
    rules = [PatternRule("^common^rare^"), PatternRule("*common*"), PatternRule("xcommon^rare"), HostRule("block", "a.com", "/part")]
    index = urlrules.index_rules(rules, {"common": 50, "rare": 2, "com": 90, "a": 9})
    assert index == {"rare": [rules[0]], "": [rules[1], rules[2]], "a": [rules[3]]}
    tried = urlrules.judge_urls(pages).selectExpr("max(url_verdict.n_tried)").first()[0]
    assert tried < len(urlrules.HOST_RULES) + len(urlrules.PATTERN_RULES)


def test_url_sql(spark):
    sf = "/root/testdata/sf0.001"
    for name, sql, view in (("op7_url_rules", urlrules.SQL, "pages"), ("op8_pivot_top_k", topk.SQL, "embeddings")):
        made = queries.QUERIES[name](spark, sf).toPandas()
        c = duckdb.connect()
        c.execute(f"create view {view} as select * from '{sf}/{view}.parquet'")
        want = c.execute(sql).df()[list(made.columns)]
        as_rows = lambda d: sorted(map(str, d.astype(object).where(d.notna(), None).itertuples(index=False, name=None)))
        assert as_rows(made) == as_rows(want)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body><header><h2>Site {n}</h2></header>
<nav><ul><li><a href=/a>A{n}</a></li><li>B</li></ul></nav><div class="cookie-notice">We use {n}</div><div class="ad">Buy {n}</div>
<article><h1>Title &amp; {n}</h1><p>First <b>bold</b>\n  text {n}&nbsp;&#233;</p><div class=kicker>Read our paper</div><ul><li>one {n}<li>two</ul><!-- no --><p>Last{n}<br>line
<section id="comments"><p>Nice {n}</p></section><form><input><label>Mail</label></form></article><aside><p>Side {n}</p></aside><footer>&copy; {n}</footer></body></html>"""


def test_main_text(spark):
    pages = [(i, f"http://h.org/{i}", PAGE.format(n=i), "kept") for i in range(30)]
    odd = ["", None, "plain words", "<p>open", "<div><article>a<article>b</article></div>", "<article>" * 500 + "deep", "< p>x</ p><p/>y", "<script>unclosed", "<p a='>'>q</p>", "<!-- open", "&lt;b&gt; &amp;amp; &#x41;"]
    pages += [(100 + i, None, h, "kept") for i, h in enumerate(odd)]
    pages += [(200 + i, "http://copies.org/x", "<article><p>all the same</p></article>", "kept") for i in range(20)]
    docs = spark.createDataFrame(pages, "page_id long, url string, html string, host string").withColumnRenamed("host", "hash")
    made = {r.page_id: r.text for r in htmltext.main_text(docs, shared.shared_folder(spark)).collect()}
    for i in range(30):  # the kicker stands on all pages of the host: template
        assert made[i] == f"Title & {i}\nFirst bold text {i} é\none {i}\ntwo\nLast{i} line"
    assert [made[100 + i] for i in range(len(odd))] == ["", "", "plain words", "open", "a\nb", "deep", "< p>x\ny", "", "q", "", "<b> &amp; A"]
    assert all(made[200 + i] == "all the same" for i in range(20))
    assert htmltext.main_text(docs.limit(0), shared.shared_folder(spark)).count() == 0


MENUS = ["main-menu", "post-share", "content-sidebar", "entry-footer", "sidebar-content", "comment-content", "mainMenu", "adBox"]
KEPT = ["entry-header", "content has-sidebar", "content sidebar-right", "post-content", "article-body", "no-ads", "header-post"]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
@pytest.mark.parametrize("name", ["op4_mix_sources", "op10_jaccard_join"])
def test_document_sql(spark, name, sf):
    path = f"/root/testdata/{sf}"
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{path}/documents.parquet'")
    made = queries.QUERIES[name](spark, path).toPandas()
    want = c.execute(queries.SQL[name]).df()[list(made.columns)]
    rows = lambda d: sorted(map(str, d.astype(object).where(d.notna(), None).itertuples(index=False, name=None)))
    assert rows(made) == rows(want)


def test_names_tell_what_is_no_article():
    for name in MENUS + KEPT:
        for attribute in ("class", "id"):
            text = [t for _, t, _ in htmltext.parse(f"<body class='has-menu'><div {attribute}='{name}'>X</div><p>y</p>").blocks]
            assert text == (["y"] if name in MENUS else ["X", "y"]), (attribute, name)


@pytest.mark.parametrize("unit", ['<a b="c ', '<a ">" ', "<div>", "</b><div>", "<![CDATA[", "<!--", "<p <", "<span><div></span>", '<a b=">', "</p x", "<ul><li>", "<a '>\" ", "<script>"])
def test_broken_markup_takes_linear_time(unit):
    import time

    def seconds(n):
        begin = time.process_time()
        htmltext.parse(unit * n)
        return time.process_time() - begin

    assert seconds(40_000) < 1 + 40 * seconds(4_000)


LAYOUTS = {
    "named": '<body><nav>menu {n}</nav><div class="ad">buy {n}</div><article><h1>{title}</h1>{paragraphs}</article><footer>f</footer>',
    "bare": "<body><div><p>About this site</p></div><div><h1>{title}</h1>{paragraphs}<p>Subscribe to our letter today</p></div><div><p>All rights kept</p></div>",
    "table": "<body><table><tr><td>Home</td><td>News</td></tr></table><section><h1>{title}</h1>{paragraphs}</section><section><p>Legal terms</p></section>",
}


def test_generated_sites_with_known_articles(spark):
    """Small hosts, two layouts on one host, near copies, and constant blocks that nothing names."""
    rng = random.Random(8)
    say = lambda k: " ".join(rng.choices([f"word{i}" for i in range(300)], k=k))
    rows, want = [], {}
    for host, layouts, n in (("a.org", ["named"], 3), ("b.org", ["bare"], 3), ("c.org", ["bare", "table"], 12), ("d.org", ["table"], 30), ("e.org", ["named"], 1)):
        for i in range(n):
            article = [say(4), *[say(rng.randrange(12, 60)) for _ in range(rng.randrange(2, 6))]]
            html = LAYOUTS[layouts[i % len(layouts)]].format(n=i, title=article[0], paragraphs="".join(f"<p>{p}</p>" for p in article[1:]))
            rows.append((len(rows), f"http://{host}/{i}", html))
            want[rows[-1][0]] = "\n".join(article)
            if i == 0 and n > 1:  # near copies, with an edit in every block in turn
                for k in range(len(article)):
                    edited = [x.replace(" ", " also ", 1) if j == k else x for j, x in enumerate(article)]
                    rows.append((len(rows), f"http://{host}/copy{k}", LAYOUTS[layouts[i % len(layouts)]].format(n=i, title=edited[0], paragraphs="".join(f"<p>{p}</p>" for p in edited[1:]))))
                    want[rows[-1][0]] = "\n".join(edited)
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as host", "2 as blocks", "3 as layout", "4 as reference", "'old' as text")
    made = htmltext.main_text(pages, shared.shared_folder(spark))
    assert made.columns == ["page_id", "url", "host", "blocks", "layout", "reference", "text"]
    got = {r.page_id: r.text for r in made.collect()}
    assert got == want


def test_hosts_of_near_copies_alone_keep_their_articles(spark):
    """Two to twelve versions of one article on a host, edited in the longest paragraph or in all."""
    rng = random.Random(4)
    say = lambda k: " ".join(rng.choices([f"word{i}" for i in range(300)], k=k))
    rows, want = [], {}
    for h in range(12):
        article = [say(60 + 30 * (h % 2)), say(25), say(30), say(28)]
        for i in range(2 + h):
            edited = [" ".join(w if rng.random() > 0.06 or (h % 3 and j) else "new" for w in x.split()) for j, x in enumerate(article)]
            edited[0] = f"{edited[0]} version {i}"
            rows.append((len(rows), f"http://h{h}.org/{i}", "<body><div>" + "".join(f"<p>{p}</p>" for p in edited) + "</div>"))
            want[rows[-1][0]] = "\n".join(edited)
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in htmltext.main_text(pages, shared.shared_folder(spark)).collect()}
    assert got == want


WRAPPED = {
    "<body><form id=aspnetForm><div class=menu>m</div><p>the article</p><p>more of it</p><fieldset><p>short</p></fieldset></form><footer>f</footer>": "the article\nmore of it",
    "<body><article class=search><p>found words</p></article>": "found words",
    "<body><form><input><p>find</p></form><p>all of the text</p>": "all of the text",
    "<body><header><h1>Site</h1></header><h1>Title</h1><main><p>text of it</p></main>": "Title\ntext of it",
    "<body><h1>Site</h1><article><h1>Own</h1><p>text</p></article>": "Own\ntext",
    "<body><article><p>" + "long article " * 20 + "</p></article><article><p>teaser</p></article><article><p>another</p></article>": ("long article " * 20).strip(),
    "<body><article><p>one of two posts</p></article><article><p>two of two posts</p></article>": "one of two posts\ntwo of two posts",
    "<body><div class=cookiebar>we use them</div><div class=topbar>call us</div><p>text</p>": "text",
    "<body><article hidden><p>" + "not shown " * 30 + "</p></article><p>shown</p>": "shown",
    "<body><p>short</p><article class=comment><p>" + "a long comment " * 30 + "</p></article>": "short",
    "<p>a <span class=share>s<br>t</span> b <button>x</button>c</p>": "a b c",
}


@pytest.mark.parametrize("page", WRAPPED)
def test_wrappers_titles_and_teasers(page):
    assert "\n".join(t for _, t, _ in htmltext.parse(page).blocks) == WRAPPED[page]


def test_clashing_text_column(spark):
    pages = spark.createDataFrame([(1, "http://a.org", "<p>x</p>", "old", 5)], "page_id long, url string, html string, Text string, _row int")
    made = htmltext.main_text(pages, shared.shared_folder(spark))
    assert made.columns == ["page_id", "url", "_row", "text"] and tuple(made.first()) == (1, "http://a.org", 5, "x")


def test_trees_are_matched():
    a = htmltext.parse("<div><p>x</p><ul><li>1</li><li>2</li></ul><h2>y</h2></div>").slots
    b = htmltext.parse("<div><h1>t</h1><p>x</p><h2>y</h2></div>").slots
    pairs = htmltext.simple_tree_matching(a, b)
    assert {(a[i].label, b[j].label) for i, j in pairs.items()} == {("html", "html"), ("div", "div"), ("p", "p"), ("h2", "h2")}
    assert htmltext.simple_tree_matching(a, a) == {i: i for i in range(len(a))}
