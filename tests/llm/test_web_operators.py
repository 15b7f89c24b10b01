import html as entities
import json
import random
import re
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from lexweave.llm import chat, html, urls

SF = "/root/testdata/sf0.001"


# --- HTML

PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h1>Site name</h1></header><nav><a href=x>menu</a></nav><div class="cookie-notice">We use cookies</div>
<div class="layout"><aside>side words</aside>%s<div class="sidebar"><p>more side</p></div></div>
<form><p>your name</p></form><section id="comments"><article class="comment"><p>nice post %s</p></article></section><footer>&copy; x</footer></body></html>"""


def test_page_without_its_surroundings():
    body = '<div class="post post-12"><h2>A &amp; B</h2><p>Hello&nbsp;wor<b>ld</b>,\n one<br>two</p><ul><li>a<li>b</ul><div class="ad">buy</div><p hidden>secret</p><table><tr><td>c<td>d</table></div>'
    assert html.Page(PAGE % (body, "")).extract(None) == "A & B\nHello world, one two\na\nb\nc\nd"


@pytest.mark.parametrize(("raw", "text"), [("", ""), ("plain words", "plain words"), ("<p>a<p>b", "a\nb"), ("<article><p><b>x<br><p>y</p></article>", "x\ny"), ("<div><div>", ""), ("a < b &lt; c", "a < b < c"), ("<p>&#x41;&#66;", "AB")])
def test_small_pages(raw, text):
    assert html.Page(raw).extract(None) == text


@pytest.mark.parametrize(
    ("names", "top", "marked"),
    [("ad", False, True), ("sideBar", False, True), ("main has-sidebar", True, False), ("no-comments post", True, False), ("site-header", True, True), ("entry-header", True, False), ("site-header", False, False), ("adage", False, False), ("cookie_banner-2", True, True), ("", True, False), ("content-with-sidebar", True, False),
     ("comments-open", True, False), ("comment-status-open", True, False), ("post-comments", True, True), ("comment-body", True, True), ("site-nav-wrapper", True, True), ("copyright-law", True, False), ("related-posts", False, True), ("share-buttons", False, True), ("share-price-news", False, False), ("widget-area", False, True), ("elementor-widget", False, False), ("search", False, True), ("comments-area", False, True)],
)
def test_marks(names, top, marked):
    assert html._marked(names, top) is marked


def test_hosts_vote(spark):
    """A page whose article is short beside unmarked words follows its host's path; the vote is per host."""
    main, other = "<div class='main-text'><p>%s</p></div>", "<div class='x9'><p>%s</p></div>"
    rows = [(i, "http://a.org/" + str(i), PAGE % (other % "few words" + main % ("long text " * 40), "")) for i in range(5)]
    rows += [(9, "http://a.org/9", PAGE % (other % "these are other words here " + main % "short text", "")), (10, "http://b.org/", "<p>only</p>"), (11, None, None), (11, None, None)]
    pages = spark.createDataFrame([(*r, 0, "t") for r in rows], "page_id int, url string, html string, depth int, path_hash string")
    got = {r.page_id: r for r in html.extract(pages).collect()}
    assert got[9].text == "short text" and got[0].text == ("long text " * 40).strip() and got[10].text == "only" and got[11].text == "" and got[0].n_chars == len(got[0].text)
    assert html.extract(pages).count() == len(rows) and html.extract(pages.limit(0)).count() == 0


def test_all_containers_of_the_path(spark):
    """An article in several parts keeps them all, in page order; a page of another layout keeps its own article."""
    parts = "".join(f"<div class='section-{i}'><p>%s</p></div>" for i in range(3))
    page = "<html><body><div class='side'><p>unmarked words beside it</p></div><div class='text'>" + parts + "</div></body></html>"
    same = html.Page("<body><article><p>one long part of it</p></article><p>x</p><article><p>and more</p></article></body>")
    first = html.Page("<body><article><p>" + "word " * 50 + "</p></article></body>")
    assert same.extract(first.elements[first.choice()][2]) == same.extract(None) == "one long part of it\nand more"
    split = html.Page(page % ("first part", "the second part is longer", "third"))
    wanted = next(e[2] for e in split.elements if e[3] == "div.section-#")
    assert split.extract(wanted) == "first part\nthe second part is longer\nthird"
    other = "<body><div class='old'><p>%s</p></div><div class='main-text'><p>few words</p></div></body>"
    usual = "<body><div class='main-text'><p>%s</p></div></body>"
    rows = [(i, f"http://a.org/{i}", usual % ("long text " * 40)) for i in range(5)] + [(9, "http://a.org/9", other % ("its own article " * 20))]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()}
    assert got[9] == ("its own article " * 20).strip() and got[0] == ("long text " * 40).strip()


def extracted(spark, rows):
    pages = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(rows)], "page_id int, url string, html string")
    return [r.text for r in sorted(html.extract(pages).collect(), key=lambda r: r.page_id)]


def test_text_in_several_containers(spark):
    """Equal articles, sibling posts and a short division beside a long one are all kept."""
    long, short = " ".join(f"w{i}" for i in range(95)), "five more words stand here"
    rows = [
        ("http://a.org/1", f"<body><nav>m</nav><article><p>{long}</p></article><article><p>{long}</p></article></body>"),
        ("http://b.org/1", f"<body><div class='post'><p>{long}</p></div><div class='post'><p>{short}</p></div></body>"),
        ("http://c.org/1", f"<body><div class='a'><p>{long}</p></div><div class='b'><p>{short}</p></div><div><a href=x>all links here</a></div></body>"),
    ]
    assert extracted(spark, rows) == [f"{long}\n{long}", f"{long}\n{short}", f"{long}\n{short}"]


@pytest.mark.parametrize("wrapper", ["<div class='content-with-sidebar'>", "<div class='elementor-widget-container'>", "<div class='search-result-page'>", "<div id='share-price-news'>", "<form action=x>", "<div class='page-popup'><div class='modal'>", "<div class='post comments-open'>", "<article class='post comment-status-open'>", "<div class='single comments-open'>"])
def test_wrapped_pages_are_not_empty(wrapper):
    text = "\n".join(" ".join(f"w{i}{j}" for i in range(20)) for j in range(3))
    body = "".join(f"<p>{line}</p>" for line in text.split("\n"))
    page = f"<body><header>Site</header>{wrapper}<h1>A title</h1>{body}<div class='sidebar'><p>side</p></div><div class='comments'><p>{'nice ' * 500}</p></div></body>"
    assert html.Page(page).extract(None) == "A title\n" + text


@pytest.mark.parametrize(("page", "text"), [
    ("<form action=x><input type=hidden name=v><h1>A title</h1><p>few words in it</p></form>", "A title\nfew words in it"), ("<form><p>few words in it</p></form>", "few words in it"),
    ("<form><p>Your name</p><input name=n></form>", ""), ("<div class='cookie-notice'><p>We use cookies</p></div>", ""), ("<div class='modal'><h1>A title</h1><p>few words</p></div>", "A title\nfew words"),
    ("<article><p>A <span class='share'>portion</span> of it, and a <a class='related' href=x>linkedword</a> stay.</p><p><a class='share' href=x>Tweet</a></p></article>", "A portion of it, and a linkedword stay."),
    ("<article><div class='copyright-law'><p>On the law</p></div><section id='menu-ideas'><p>On menus</p></section><div class='copyright'><p>Me 2020</p></div></article>", "On the law\nOn menus"),
    ("<article class='post comment-status-open'><p>words</p></article><div class='comments-area'><p>nice</p></div><ol class='comment-list'><li>bad</ol>", "words"),
])
def test_short_pages_and_names(page, text):
    made = html.Page(f"<body>{page}</body>")
    assert made.extract(None) == text


def test_prose_beside_semantic_containers(spark):
    lead, more = (" ".join(f"{x}{i}" for i in range(n)) for x, n in (("a", 60), ("b", 40)))
    rows = [
        ("http://a.org/", f"<body><main><article class='lead'><p>{lead}</p></article><article class='more'><p>{more}</p></article></main></body>"),
        ("http://b.org/", f"<body><main><h1>Heading</h1><article><p>{lead}</p></article></main></body>"),
        ("http://c.org/", f"<body><main><article><p>{lead}</p></article><p>{more}</p></main></body>"),
        ("http://d.org/", f"<body><div><p>{more}</p></div><article><p>{lead}</p></article></body>"),
    ] + [(f"http://e.org/{i}", f"<body><h1>Name of the site</h1><article><p>{lead} {i}</p></article><p>All about us</p></body>") for i in range(4)]
    assert extracted(spark, rows) == [f"{lead}\n{more}", f"Heading\n{lead}", f"{lead}\n{more}", f"{more}\n{lead}", *(f"{lead} {i}" for i in range(4))]


def test_templates_beside_the_article(spark):
    """Words that repeat at one path of a host's pages go; words that differ from page to page stay."""
    page = "<body><div class='x1'><p>%s</p></div><div class='main-text'><p>%s</p></div></body>"
    article = [" ".join(f"a{p}w{i}" for i in range(90)) for p in range(4)]
    same = [("http://a.org/", page % ("call us now", a)) for a in article]
    own = [("http://b.org/", page % (f"lead {p}", a)) for p, a in enumerate(article)]
    assert extracted(spark, same + own) == article + [f"lead {p}\n{a}" for p, a in enumerate(article)]


def test_layouts_survive_packing():
    page = html.Page(PAGE % ("<div class='post'><p>A &amp; b <a href=x>c</a></p><div></div><p>\ud800 é</p></div>", ""))
    held = html.Layout.unpack(page.pack())
    assert [t for _, t in held.blocks] == [t for _, t in page.blocks] and held.link_words == page.link_words
    assert held.extract(None) == page.extract(None) == "A & b c\n\ud800 é" and len(held.elements) < len(page.elements)
    assert html.Layout.unpack(html.Page("").pack()).extract(5, set()) == ""


def test_votes_equal_counting(spark):
    """The winner of each host where its pages disagree, by counting the pages one by one."""
    rnd, rows = random.Random(7), []
    for i in range(120):
        tag = rnd.choice(["<article class='a%d'>", "<div class='t-%d'><div class='u'>", "<main>", "<section class='s'>"])
        rows.append((i, f"http://h{rnd.randint(0, 6)}.org/{i}", f"<body>{tag % i if '%' in tag else tag}<p>{'word ' * rnd.randint(5, 40)}</p></body>"))
    count, hashes = {}, {}
    for _, url, page in rows:
        made = html.Page(page)
        at = made.choice()
        key = (plain_host(url)[0], made.path(at))
        count[key] = count.get(key, 0) + 1
        hashes[key] = made.elements[at][2], made.elements[at][4]
    best = {}
    for (host, path), n in count.items():
        best[host] = min(best.get(host, (1, 0, "")), (-n, -hashes[host, path][1], path))
    got = {r.host: (r.path, r.votes, r.path_hash) for r in html.winners(html.read(spark.createDataFrame(rows, "page_id int, url string, html string"))).collect()}
    assert got == {h: (p, -n, hashes[h, p][0]) for h, (n, _, p) in best.items()}


def test_all_pages_equal_their_articles(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r.text for r in html.extract(pages).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*)</article>", r.html, re.S).group(1)
        blocks = (" ".join(entities.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"<br>\s*<p>|</p>|<p>|</?h1>", article))
        assert got[r.page_id] == "\n".join(b for b in blocks if b)


def test_deep_and_long_pages():
    assert html.Page("<div>" * 3000 + "deep").extract(None) == "deep"
    assert len(html.Page("<p>" + "word " * 100_000).extract(None)) == 499_999


# --- URL rules


def plain_host(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def plain_rule(host, path):
    fits = [(len(h + p), h + p, v) for h, p, v in urls.HOST_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


URLS = ["http://A.Example.ORG/es/1?x#y", "https://example.org/en/12", "http://example.org", "x://org/", "http://notexample.org/es/", "http://b.com/de/3", "http://b.com/fr", "no scheme", "", None, "a://b://c/d", "http://h.net/\nx?y", "http://ÄB.com/de/", "http://m.example.org/en/2"]


def test_hosts_paths_and_fixed_rules(spark):
    rows = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)], "page_id int, url string")
    for r in urls.judged(rows).collect():
        host, path = plain_host(URLS[r.page_id])
        rule, verdict = plain_rule(host, path)
        assert (r.host, r.path) == (host, path), URLS[r.page_id]
        assert (r.fixed.rule if r.fixed else None, r.fixed.verdict if r.fixed else None) == (rule, verdict)


def test_mined_rules_equal_counting(spark):
    """Every page's verdict by scanning all rules, against the index; every rule's figures against the baskets."""
    rnd = random.Random(3)
    hosts = ["bad-pills.net", "good.net", "m.fine.net", "spam.farm.info", "x.org"]
    pages = [(i, f"http://{(h := rnd.choice(hosts))}/{rnd.choice(['buy', 'news', 'a7'])}/{i}{rnd.choice(['', '?ref=1', '?q=2&ref=3'])}", h) for i in range(300)]
    labels = [(i, 0 if "pills" in h or "spam" in h else 1, 0) for i, _, h in pages if rnd.random() < 0.7] + [(None, 0, 1), (9999, 0, 0)]
    table = spark.createDataFrame([p[:2] for p in pages] + [(300, None), (0, pages[0][1])], "page_id long, url string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rules = [r.asDict() for r in urls.mine(table, marks).collect()]
    assert any(r["verdict"] == "block" and r["antecedent"] == ["h:bad"] for r in rules)
    found = urls.filter_urls(table, marks).collect()
    cut = urls.judged(table).withColumn(urls.ROW, F.monotonically_increasing_id())
    classes = {}
    for r in urls._mine(cut, marks)[1].collect():
        classes.setdefault(r["class"], set()).add(r.token)
    tokens = {(r.page_id, r.url): set(r.tokens) for r in urls.judged(table).collect()}
    assert len(found) == 302
    by = {p[0]: p[1] for p in pages} | {300: None}
    for r in found:
        rule, verdict = plain_rule(*plain_host(by[r.page_id]))
        own = tokens[r.page_id, by[r.page_id]]
        fits = [(-x["confidence"], -x["support"], x["verdict"] != "block", x["verdict"]) for x in rules if all(classes[c] & own for c in x["antecedent"])]
        assert r.rule == rule and r.verdict == (verdict or (min(fits)[3] if fits else "allow"))
    judged = [r for r in found if r.rule is None and by[r.page_id]]
    assert all((r.verdict == "block") == ("pills" in r.host or "spam" in r.host) for r in judged)


def test_long_rules_decide(spark):
    """Every verdict by counting all token sets of a page, where only five path segments together tell a bad page."""
    rnd = random.Random(5)
    sets = [s for s in ("abcde", "bcde", "acde", "abde", "abce", "abcd") for _ in range(20)] + ["".join(rnd.sample("abcdef", 4)) for _ in range(30)]
    rows = [(i, "http://h.net/" + "/".join(s), s == "abcde") for i, s in enumerate(sets)]
    table = spark.createDataFrame([r[:2] for r in rows], "page_id long, url string")
    marks = spark.createDataFrame([(i, 1 - bad, 0) for i, _, bad in rows], "doc_id long, quality int, toxic int")
    tokens = {r.page_id: sorted(r.tokens) for r in urls.judged(table).collect()}
    parts = {i: [c for n in range(1, len(t) + 1) for c in combinations(t, n)] for i, t in tokens.items()}
    count, marked = Counter(c for p in parts.values() for c in p), Counter((c, "block" if bad else "allow") for i, _, bad in rows for c in parts[i])
    share = Counter("block" if bad else "allow" for _, _, bad in rows)
    rules = {(c, v): (k / count[c], k) for (c, v), k in marked.items() if k >= urls.MIN_SUPPORT * len(rows) and k / count[c] >= urls.MIN_CONFIDENCE and k / count[c] * len(rows) / share[v] >= urls.MIN_LIFT}
    found = {r.page_id: r.verdict for r in urls.filter_urls(table, marks).collect()}
    for i, p in parts.items():
        fits = [(*rules[c, v], v) for c in p for v in share if (c, v) in rules]
        assert found[i] == (max(fits, key=lambda x: (*x[:2], x[2] == "block"))[2] if fits else "allow"), rows[i]
    assert [found[i] for i, _, bad in rows if bad] == ["block"] * 20


def test_tokens_that_a_site_shares(spark):
    """Twenty tokens in common are one class: a rule for each of them alone, none for their sets; pages with one of them are met."""
    deep = "/".join(f"s{chr(97 + i)}" for i in range(20))
    rows = [(i, f"http://spam.net/{deep}/{i}") for i in range(100)] + [(i, f"http://fine.org/news/{i}") for i in range(100, 1000)] + [(2000, "http://other.info/sc/x"), (2001, "http://other.info/y")]
    table = spark.createDataFrame(rows, "page_id long, url string").withColumn("verdict", F.lit("clash")).withColumn("tokens", F.lit(1)).withColumn("class", F.lit(2))
    marks = spark.createDataFrame([(i, 0 if i < 100 else 1, 0, "x") for i in range(1000)], "doc_id long, quality int, toxic int, token string")
    rules = urls.mine(table, marks).collect()
    assert len(rules) <= 6 and all(len(r.antecedent) == 1 for r in rules)
    found = {r.page_id: (r.verdict, r.mined_rule) for r in urls.filter_urls(table, marks).collect()}
    assert found[5] == ("block", "h:net") and found[2000] == ("block", "p:sc") and found[2001][0] == "allow" and found[500][0] == "allow"


def test_urls_without_labels(spark):
    pages = spark.createDataFrame([(1, "http://a.net/x"), (2, None)], "page_id int, url string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.verdict for r in urls.filter_urls(pages, none).collect()} == {"allow"}
    assert urls.filter_urls(pages.limit(0), none).count() == 0


# --- chat


def message(**body):
    return json.dumps(body)


SCHEMA = "conv_id long, turn long, role string, text string"
TOOLS = [{"name": "add", "parameters": {"required": ["a"], "properties": {"a": {"type": "integer"}, "b": {"type": "string"}, "c": {"type": "array"}}}}]
CHAT = [
    (1, 0, "system", message(content="hi", tools=TOOLS)), (1, 1, "user", 'add é "1"\n'), (1, 3, "tool", message(tool_call_id="c1", content="2")),
    (1, 4, "assistant", message(content="x", tool_calls=[{"id": "c1", "name": "add", "arguments": {"b": "z", "a": 1}}, {"id": "c2", "name": "add", "arguments": {"b": 2}}])),
    (1, 5, "assistant", message(tool_calls=[{"id": "c3", "name": "free", "arguments": {"z": {"y": [1, 2.5, None]}}}])), (1, 6, "tool", message(tool_call_id="c3", content="ok")),
    (1, 6, "tool", message(tool_call_id="c3", content="ok")), (1, 7, "tool", '{"tool_call_id":"zz"}'), (2, 0, "tool", message(tool_call_id="c1")), (2, 1, None, None), (None, None, "user", "{bad"),
    (2, 2, "assistant", message(tool_calls=[{"id": "k", "name": "add", "arguments": {"a": "no"}}])), (1, 8, "assistant", message(tool_calls=[{"id": "c1", "name": "add", "arguments": {"a": 1, "c": [1]}}])),
]


def test_calls_and_results(spark):
    got = {(r.conv_id, r.turn, r.role): r for r in chat.link(spark.createDataFrame(CHAT, SCHEMA)).collect()}
    assert chat.link(spark.createDataFrame(CHAT, SCHEMA)).count() == len(CHAT)
    late = got[1, 3, "tool"]
    assert (late.anchor_turn, late.is_result, late.status) == (4, True, "linked")
    both = got[1, 4, "assistant"]
    assert (both.n_calls, both.n_answered, both.args_valid, both.status) == (2, 1, False, "pending")
    assert both.message == '{"content":"x","role":"assistant","tool_calls":[{"arguments":{"a":1,"b":"z"},"id":"c1","name":"add"},{"arguments":{"b":2},"id":"c2","name":"add"}],"turn":4}'
    free = got[1, 5, "assistant"]
    assert (free.args_valid, free.status) == (None, "answered") and '{"z":{"y":[1,2.5,null]}}' in free.message
    assert got[1, 7, "tool"].status == got[2, 0, "tool"].status == "orphan"
    assert got[2, 2, "assistant"].args_valid is None and got[1, 8, "assistant"].args_valid is True
    assert got[2, 1, "unknown"].message == '{"content":"","role":"unknown","turn":1}' and got[None, None, "user"].status == "plain"
    assert json.loads(got[1, 1, "user"].message) == {"content": 'add é "1"\n', "role": "user", "turn": 1}


def test_conversations_are_whole_and_canonical(spark):
    rows = spark.read.parquet(f"{SF}/conversations.parquet")
    expected = {(r.conv_id, r.turn): json.dumps({"content": r.text, "role": r.role, "turn": r.turn}, sort_keys=True, separators=(",", ":"), ensure_ascii=False) for r in rows.collect()}
    got = {(r.conv_id, r.turn): r.message for r in chat.link(rows).collect()}
    assert got == expected
    assert chat.link(rows.limit(0)).count() == 0 and chat.link(rows.withColumn("status", F.lit(1)).withColumn("calls", F.lit(2))).count() == len(expected)


def plain_link(rows):
    """Every message's place, by following each result up to its call, one message at a time."""
    bodies = []
    for conv, turn, role, text in rows:
        try:
            body = json.loads(text) if text and text.lstrip().startswith("{") else None
        except ValueError:
            body = None
        body = body if isinstance(body, dict) and {"content", "tool_calls", "tool_call_id", "tools"} & set(body) else {}
        calls = [c for c in body.get("tool_calls") or [] if isinstance(c, dict)]
        bodies.append((conv, turn, calls, body.get("tool_call_id")))
    holders = {}
    for conv, turn, calls, _ in bodies:
        for c in calls:
            if conv is not None and turn is not None and c.get("id") is not None:
                holders[conv, c["id"]] = min(turn, holders.get((conv, c["id"]), turn))
    at = {(conv, turn): answers for conv, turn, _, answers in bodies}
    done = {(conv, answers) for conv, turn, _, answers in bodies if conv is not None and turn is not None and answers is not None}
    out = []
    for conv, turn, calls, answers in bodies:
        here, depth, met = turn, 0, set()
        while (up := holders.get((conv, at.get((conv, here))))) is not None and here not in met and turn is not None:
            met.add(here)
            here, depth = up, depth + 1
        circle = here in met
        linked = (conv, answers) in holders and turn is not None
        status = "cyclic" if circle else "linked" if linked else "orphan" if answers is not None else None
        n_answered = sum((conv, c.get("id")) in done for c in calls)
        status = status or ("plain" if not calls else "pending" if n_answered < len(calls) else "answered")
        out.append((conv, turn, turn if circle else here, 0 if circle else depth, answers is not None, len(calls), n_answered, status))
    return out


def test_links_equal_following_them(spark):
    """Random conversations, a message a turn: chains through results that call, repeated and missing identifiers, circles."""
    rnd, rows = random.Random(12), []
    for conv in range(60):
        ids = [f"k{i}" for i in range(rnd.randint(1, 7))]
        for turn in rnd.sample(range(30), rnd.randint(1, 14)):
            body = {"content": "x"}
            if rnd.random() < 0.6:
                body["tool_calls"] = [{"id": rnd.choice(ids), "name": "f", "arguments": {}} for _ in range(rnd.randint(1, 2))]
            if rnd.random() < 0.6:
                body["tool_call_id"] = rnd.choice(ids)
            rows.append((conv, turn, "tool", json.dumps(body) if rnd.random() < 0.9 else "text"))
    rows += [(None, 1, "tool", message(tool_call_id="k1")), (1, None, "tool", message(tool_call_id="k1")), (None, 2, "assistant", message(tool_calls=[{"id": "k1", "name": "f"}]))]
    rows += [(99, t, "tool", message(tool_call_id=f"c{t}", tool_calls=[{"id": f"c{t + 1}", "name": "f"}])) for t in range(20, 0, -1)]
    expected = plain_link(rows)
    assert {e[-1] for e in expected} == {"cyclic", "linked", "orphan", "plain", "pending", "answered"} and max(e[3] for e in expected) == 19
    got = chat.link(spark.createDataFrame(rows, SCHEMA)).collect()
    found = [(r.conv_id, r.turn, r.anchor_turn, r.depth, r.is_result, r.n_calls, r.n_answered, r.status) for r in got]
    order = lambda r: tuple((v is None, v) for v in r)
    assert sorted(found, key=order) == sorted(expected, key=order)
    place = {(r.conv_id, r.turn): (r.anchor_turn, r.depth, r.turn) for r in got}
    for conv, turn, _, text in rows:
        body = json.loads(text) if text.startswith("{") else {}
        for call in body.get("tool_calls", []):
            for other, later, _, reply in rows:
                if other == conv and conv is not None and later is not None and reply.startswith("{") and json.loads(reply).get("tool_call_id") == call["id"]:
                    first = min(t for c, t, _, x in rows if c == conv and x.startswith("{") and any(k["id"] == call["id"] for k in json.loads(x).get("tool_calls", [])))
                    if first == turn and not any(r.status == "cyclic" for r in got if (r.conv_id, r.turn) in ((conv, later), (conv, turn))):
                        assert place[conv, turn] < place[conv, later]


def test_bodies_keep_what_they_hold(spark):
    call = {"id": "c1", "type": "function", "function": {"name": "add", "arguments": '{"b": "é", "a": 1}'}}
    texts = [
        ('{"content":"keep","note":"lost?"}', {"content": "keep", "note": "lost?", "role": "user", "turn": 0}),
        (message(content="hi", tools=TOOLS), {"content": "hi", "role": "user", "tools": TOOLS, "turn": 1}),
        (message(content=None, tool_calls=[call]), {"content": None, "role": "user", "turn": 2, "tool_calls": [{"id": "c1", "type": "function", "name": "add", "arguments": {"a": 1, "b": "é"}}]}),
        (message(content=[1, {"b": 2, "a": "\n"}], role="x", turn=9), {"content": [1, {"a": "\n", "b": 2}], "role": "user", "turn": 3, "_role": "x", "_turn": 9}),
        ('{"a": 1}', {"content": '{"a": 1}', "role": "user", "turn": 4}),
        ('{"tool_calls": "none", "content": ""}', {"content": "", "role": "user", "tool_calls": "none", "turn": 5}),
        ('{"tool_calls": ["x", {"id": 7, "arguments": "not json"}]}', {"content": "", "role": "user", "tool_calls": ["x", {"arguments": "not json", "id": 7}], "turn": 6}),
    ]
    rows = [(1, i, "user", t) for i, (t, _) in enumerate(texts)]
    got = {r.turn: r for r in chat.link(spark.createDataFrame(rows, SCHEMA)).collect()}
    for i, (_, wanted) in enumerate(texts):
        assert got[i].message == json.dumps(wanted, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    assert (got[2].n_calls, got[2].args_valid, got[6].n_calls) == (1, True, 1)


DEEP = {
    "required": ["kind"],
    "properties": {
        "kind": {"type": "string", "enum": ["x", "y"]}, "n": {"type": ["integer", "null"]}, "list": {"type": "array", "items": {"type": "number"}},
        "in": {"type": "object", "required": ["z"], "properties": {"z": {"type": "object", "properties": {"w": {"type": "boolean"}}}}},
    },
}
ARGUMENTS = [
    ({"kind": "x"}, True), ({"kind": "z"}, False), ({}, False), ({"kind": "y", "n": None}, True), ({"kind": "y", "n": "1"}, False), ({"kind": "x", "list": [1, 2.5]}, True),
    ({"kind": "x", "list": [1, "a"]}, False), ({"kind": "x", "in": {}}, False), ({"kind": "x", "in": {"z": {"w": True}}}, True), ({"kind": "x", "in": {"z": {"w": 1}}}, False),
    ({"kind": "x", "other": 1}, True), ([1], False), ("text", False), ('{"kind": "x", "n": 4}', True),
]


def test_arguments_against_nested_schemas(spark):
    rows = [(1, 0, "system", message(tools=[{"type": "function", "function": {"name": "f", "parameters": DEEP}}]))]
    rows += [(1, i + 1, "assistant", message(tool_calls=[{"id": f"c{i}", "name": "f", "arguments": a}])) for i, (a, _) in enumerate(ARGUMENTS)]
    got = {r.turn: r.args_valid for r in chat.link(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [got[i + 1] for i in range(len(ARGUMENTS))] == [ok for _, ok in ARGUMENTS]


def _deep(n, leaf):
    return leaf if not n else {"type": "object", "properties": {"x": _deep(n - 1, leaf)}}


def _put(n, leaf):
    return leaf if not n else {"x": _put(n - 1, leaf)}


NUMBER = {"type": "integer", "minimum": 1, "maximum": 9}
SCHEMAS = [
    (_deep(1, NUMBER), _put(1, 5), True), (_deep(9, NUMBER), _put(9, 5), True), (_deep(9, NUMBER), _put(9, "5"), False), (_deep(4, NUMBER), _put(4, "a"), False), (_deep(2, NUMBER), _put(2, 0), False), (_deep(2, NUMBER), _put(2, 10), False),
    ({"properties": {"a": {}}, "additionalProperties": False}, {"a": 1}, True), ({"properties": {"a": {}}, "additionalProperties": False}, {"a": 1, "b": 2}, False), ({"additionalProperties": {"type": "string"}}, {"b": "x"}, True),
    ({"additionalProperties": {"type": "string"}}, {"b": 2}, False), ({"properties": {"a": {"pattern": "^[a-z]+-\\d{2}$"}}}, {"a": "ab-12"}, True), ({"properties": {"a": {"pattern": "^[a-z]+-\\d{2}$"}}}, {"a": "ab-1"}, False),
    ({"properties": {"a": {"pattern": "(["}}}, {"a": "x"}, None), ({"properties": {"a": {"pattern": "(["}, "b": NUMBER}}, {"a": "x", "b": 99}, False), ({"anyOf": [{}]}, {"a": 1}, None), ({"properties": {"a": {"exclusiveMinimum": 1}}}, {"a": 1}, False),
    ({"properties": {"a": {"minLength": 2, "maxLength": 3}}}, {"a": "é漢"}, True), ({"properties": {"a": {"minLength": 2}}}, {"a": "x"}, False), ({"properties": {"a": {"minItems": 2, "items": NUMBER}}}, {"a": [1]}, False), ({"properties": {"a": {"items": {"items": NUMBER}}}}, {"a": [[1, 2], [3]]}, True),
    ({"properties": {"a": {"items": {"items": NUMBER}}}}, {"a": [[1, 2], [33]]}, False), ({"properties": {"a": {"const": [1, {"b": 2}]}}}, {"a": [1, {"b": 2}]}, True), ({"properties": {"a": {"type": "integer"}}}, {"a": None}, False), ({"properties": {"a": False}}, {"a": 1}, False), ({"properties": {"a": True}}, {"a": 1}, True),
    ({"properties": {"a": {"items": [NUMBER]}}}, {"a": [1]}, None),
]


def test_schemas_of_any_depth(spark):
    rows = []
    for i, (schema, given, _) in enumerate(SCHEMAS):
        rows += [(i, 0, "system", message(tools=[{"name": "f", "parameters": schema}])), (i, 1, "assistant", message(tool_calls=[{"id": "c", "name": "f", "arguments": given}]))]
    got = {r.conv_id: r.args_valid for r in chat.link(spark.createDataFrame(rows, SCHEMA)).where("turn = 1").collect()}
    assert [got[i] for i in range(len(SCHEMAS))] == [ok for *_, ok in SCHEMAS]
