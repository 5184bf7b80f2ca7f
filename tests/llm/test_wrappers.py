from vertexflow.llm import wrappers
from vertexflow.llm.wrappers import groups, infer, read

FULL = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var a="</p><p>no</p>";</script></head><body class="has-sidebar">
<div id="cookie-notice"><p>We use cookies</p></div><header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav>
<main><article><header><h1>Title</h1></header><p>First  <b>bold</b>
 text&nbsp;&eacute; &lt;b&gt;.</p><div class="ad">Buy</div><ul><li>one</li><li>two</li></ul><p>a<br>b</p><blockquote>Quote <i>it</i>alic</blockquote>
<form><label>Mail</label><input></form><section class="comments"><p>Nice!</p></section></article><aside>More</aside></main><footer>foot</footer></body></html>"""


def test_article_alone():
    assert read(FULL, None)[0] == "Title\nFirst bold text é <b>.\none\ntwo\na\nb\nQuote italic"
    assert read(None, None)[0] == read("", None)[0] == read("<nav>x</nav>", None)[0] == ""
    assert read("<p><b>one<br><p>two</p><p>three", None)[0] == "one\ntwo\nthree"
    assert read("plain &amp text", None)[0] == "plain & text"
    wordpress = "<div class='site-header'>S</div><div class='post'><div class='entry-header'><h1>T</h1></div><p>x</p><div class='post-navigation'>n</div><ol class='commentlist'><li>c</ol></div>"
    assert read(wordpress, None)[0] == "T\nx"


def page(k, paragraphs, extra=""):
    body = "".join(f"<p>text {k} {j}</p>" for j in range(paragraphs))
    return f"<html><body><div>Our Site</div><div><a>m1</a><a>m2</a></div><div><h2>Head {k}</h2>{body}{extra}</div><div>All rights</div></body></html>"


def test_class_names_do_not_empty_an_article():
    for h in (
        '<article class="post has-sidebar"><p>x</p></article>', '<article class="post format-aside"><p>x</p></article>', '<article class="article social-enabled"><p>x</p></article>',
        '<article id="ad-review"><p>x</p></article>', '<div id="content" class="content sidebar-right"><p>x</p></div>', '<div class="share-story"><article><p>x</p></article></div>',
        '<div class="comments"><p>x</p></div>',
    ):
        assert read(h, None)[0] == "x", h
    assert read('<article><p class="promo-intro">a</p><section class="related-work"><p>b</p></section><div class="share-buttons">c</div></article>', None)[0] == "a\nb"
    assert read('<article><p>a</p></article><ol class="comments"><li><article class="comment"><p>b</p></article></ol>', None)[0] == "a"


def test_foreign_tags_end_where_they_should():
    assert read("<p>x <svg/>of x</p>", None)[0] == "x of x"
    assert read("<p>y<iframe src=a> after</p>", None)[0] == "y after"
    assert read("<p>a<svg><path/><text>no</text></svg>b<noscript>c</noscript></p>", None)[0] == "ab"


def test_wrapper_of_pages_without_semantic_tags():
    pages = [page(0, 1), page(1, 3), page(2, 2, "<i>once</i>"), page(3, 4)]
    wrapper = infer(pages)
    assert groups(wrapper)[1] >= 1 and wrapper[1] == 4
    for k, p in enumerate(pages):
        text, by_wrapper = read(p, wrapper)
        assert by_wrapper and text.split("\n")[:2] == [f"Head {k}", f"text {k} 0"] and "Our Site" not in text and "All rights" not in text
    unseen = page(9, 7, "<table><tr><td>cell</td></tr></table>")
    assert read(unseen, wrapper) == ("\n".join(["Head 9", *(f"text 9 {j}" for j in range(7)), "cell"]), True)


def test_wrapper_is_right_where_rules_alone_are_wrong():
    def article(k, n):
        body = "".join(f"<p>Words of page {k}, paragraph {j}.</p>" for j in range(n))
        return f"<body><nav><a>a</a></nav><article><div>Our cookie rules apply.</div><h1>Title {k}</h1>{body}<p>Read our letter.</p></article></body>"

    pages = [article(k, k % 3 + 1) for k in range(9)]
    wrapper = infer(pages)
    for k, p in enumerate(pages):
        right = "\n".join([f"Title {k}", *(f"Words of page {k}, paragraph {j}." for j in range(k % 3 + 1))])
        assert read(p, wrapper) == (right, True)
        assert read(p, None)[0] == f"Our cookie rules apply.\n{right}\nRead our letter."
    # a short article next to long notices: the page alone is misleading, its host is not
    body = lambda k, long: f"<body><div><p>Notice {k} {'n' * 200}</p></div><div><h2>Head {k}</h2><p>{'word ' * (400 if long else 5)}{k}</p></div></body>"
    host = infer([body(k, k != 5) for k in range(9)])
    assert read(body(5, False), host)[0].startswith("Head 5") and read(body(5, False), None)[0].startswith("Notice 5")


def test_templates_of_two_kinds_and_near_copies():
    two = lambda k: f"<body><div id='x'><h2>X {k}</h2><p>{'words ' * 30}{k}</p></div><div>foot</div></body>" if k % 2 else f"<body><div>foot</div><section><h3>Y {k}</h3><p>{'other ' * 40}{k}</p></section></body>"
    wrapper = infer([two(k) for k in range(12)])
    assert groups(wrapper)[0] >= 2
    for k in range(12):
        text = read(two(k), wrapper)[0].split("\n")
        assert len(text) == 2 and text[0] == f"{'XY'[k % 2 == 0]} {k}"
    same = "<body><article><h1>Title</h1>" + "".join(f"<p>paragraph {k} of the only page</p>" for k in range(200)) + "</article></body>"
    assert read(same, infer([same] * 40)) == read(same, None)[:1] + (True,)
    copies = [f"<body><article><h1>Same title</h1><p>{'same words ' * 20}</p><p>but {k}</p></article></body>" for k in range(6)]
    assert read(copies[2], infer(copies))[0].split("\n") == ["Same title", ("same words " * 20).strip(), "but 2"]


def test_merging_in_any_grouping_counts_all_pages():
    pages = [page(k, k % 4 + 1, "<ul><li>a</li></ul>" if k % 5 == 0 else "") for k in range(20)]
    whole, halves = infer(pages), wrappers.joined(infer(pages[:7]), infer(pages[7:]))
    assert whole[1] == halves[1] == 20
    for p in pages:
        assert read(p, whole) == read(p, halves)


def test_very_deep_and_very_long_pages():
    deep = "<div>" * 5000 + "<p>x</p>" + "</div>" * 5000
    assert read(deep, infer([deep] * 3))[0] == "x"
    long = "<body>" + "".join(f"<h2>h {k}</h2><p>p {k}</p>" for k in range(20_000)) + "</body>"
    assert read(long, infer([long] * 3))[0].count("\n") == 39_999


def test_few_or_equal_pages_have_no_template():
    assert read(page(1, 2), infer([page(1, 2)]))[0].startswith("Our Site\nHead")
    assert read(page(1, 2), infer([page(1, 2)] * 5))[0].startswith("Our Site\nHead")


def test_rows(spark):
    rows = [(k, f"http://Host{k % 2}.example/{k}", page(k, k % 4 + 1), "t") for k in range(30)] + [(30, "http://host0.example/x", FULL, "t"), (31, None, FULL, "t"), (32, "nothing", None, "t"), (32, "nothing", None, "t")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    found = wrappers.extract(df).collect()
    assert len(found) == len(rows)
    by = {r["page_id"]: r for r in found}
    for k in range(30):
        assert by[k]["text"] == "\n".join([f"Head {k}", *(f"text {k} {j}" for j in range(k % 4 + 1))])
    assert by[30]["text"] == by[31]["text"] == read(FULL, None)[0]
    assert (by[32]["text"], by[32]["n_chars"]) == ("", 0) and all(r["n_chars"] == len(r["text"]) for r in found)
    assert wrappers.extract(df.limit(0)).count() == 0
