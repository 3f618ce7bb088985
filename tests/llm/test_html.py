from tidegauge.llm import html_text
from tidegauge.llm.common import read_table

SHELL = (
    "<html><head><title>t</title><style>p{{}}</style></head><body><nav><a href=/>Home</a></nav><div class='top'>Site slogan of all</div>"
    "<div id=x><h1>Title {n}</h1><p>Body &amp; text&nbsp;{n}<br>goes   on<p>Second <b>bold</b>{n}</div>"
    "<div class=comments><p>Nice one {n}</p></div><div>Terms apply everywhere</div><footer>(c)</footer><script>var a = '<p>no</p>';</script></body></html>"
)


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id bigint, url string, html string")


def test_templates_go_and_articles_stay(spark):
    rows = [(n, f"http://h.example/{n}", SHELL.format(n=n)) for n in range(8)]
    got = {r.page_id: r for r in html_text.main_text(pages(spark, rows)).collect()}
    assert got[3].text == "Title 3\nBody & text 3 goes on\nSecond bold3" and got[3].n_chars == len(got[3].text)


def test_marked_article_keeps_quoted_paragraphs(spark):
    page = "<body><header>H</header><article><p>Quoted often</p><p>Own {n}</p><aside>ad</aside></article><p>outside</p></body>"
    rows = [(n, "http://a.example/", page.format(n=n)) for n in range(3)] + [(9, "http://b.example/", page.format(n=9))]
    got = {r.page_id: r.text for r in html_text.main_text(pages(spark, rows)).collect()}
    assert got[9] == "Quoted often\nOwn 9" and got[1] == "Quoted often\nOwn 1"


def test_edges(spark):
    rows = [(1, None, None), (2, "odd", ""), (None, "http://x/", "plain &lt;text&gt;"), (4, "http://x/", "<p>open <i>never closed"), (4, "http://x/", "<p>open <i>never closed"), (5, "http://x/", "<div>" * 3000 + "deep" + "</div>" * 3000), (6, "http://x/", "<!-- only -->")]
    got = html_text.main_text(pages(spark, rows).selectExpr("*", "1 as host", "2 as text", "3 as templates")).collect()
    assert sorted((str(r.page_id), r.text) for r in got) == [("1", ""), ("2", ""), ("4", "open never closed"), ("4", "open never closed"), ("5", "deep"), ("6", ""), ("None", "plain <text>")]
    assert html_text.main_text(pages(spark, [])).count() == 0


def test_salted_join_gives_the_same(spark, small):
    table = read_table(spark, small, "pages")
    a = html_text.main_text(table).orderBy("page_id").collect()
    assert a == html_text.main_text(table, broadcast_templates=0).orderBy("page_id").collect()
    assert sum(r.n_chars > 0 for r in a) > 0.9 * len(a)


def text_of(source, templates=None):
    root = html_text.parse(source)
    html_text.weigh(root, set())
    return html_text.extract(root, templates or {})


def test_class_names_of_articles_stay():
    page = '<article><h1>T</h1><section class="related-work"><p>Prior art.</p></section><p class="share-price">It rose.</p><div class="search-results"><p>Found.</p></div>'
    page += '<div class="related-posts">More</div><div class="ad">Buy</div><ol class="comment-list"><li>First!</li></ol><p class="x1 share-buttons">Tweet</p></article>'
    assert text_of(page) == "T\nPrior art.\nIt rose.\nFound."


def test_attributes_are_names_and_values():
    kept = ['<a href="/hidden-valley">', '<p title="a hidden gem">', '<p data-role="menu">', '<p data-id="sidebar">', '<a href="/search?class=menu">', '<p data-style="display:none">', "<p title='class=\"ad\"'>", '<p data-hidden>', '<p class=x title="id=footer">', '<p hiddenish>', '<p class="">', "<p style='color:red'>", '<p aria-hidden="false">', '<p role="paragraph">']
    for tag in kept:
        assert text_of(f"<body>{tag}words</{tag[1]}></body>") == "words", tag
    gone = ['<p hidden>', '<p HIDDEN="">', "<p aria-hidden='true'>", '<p role=navigation>', '<p style="Display : None">', '<p a="1"class="ad">', '<p title="x"id=sidebar>', '<p class = "x menu">', '<p data-x=1 hidden data-y>']
    for tag in gone:
        assert text_of(f"<body><p>rest{tag}words</body>") == "rest", tag


def test_names_inside_an_article():
    for tag in ('<p class="teaser">', '<section class="discussion">', '<section id="legal">', '<section id="related">', '<section id="form">', '<p class="share">', '<div class="no-adverse">', '<p id="ad-hoc">', '<p class="commentary">'):
        assert text_of(f"<article><p>One.</p>{tag}two</article>") == "One.\ntwo", tag
    for tag in ('<div class="user-comment">', '<div id="comment-1234abc">', '<div class="inline-ad">', '<ol class="comments">', '<div class="cookie-notice">', '<div class="newsletter">', '<div class="related-posts">', '<div class="advert">', '<section class="notice">', '<form>', '<div class="breadcrumbs">', '<aside>'):
        assert text_of(f"<article><p>One.</p>{tag}two</{tag[1:].split(' ')[0].rstrip('>')}></article>") == "One.", tag
    assert text_of('<article class="post teaser"><p>Kept.</p></article>') == "Kept." == text_of('<article class="post has-comments"><p>Kept.</p></article>')
    assert text_of('<article><p>Kept.</p></article><article class="comment"><p>First!</p></article>') == "Kept."
    assert text_of('<body><p>Kept.</p><div id="related"><p>More</p></div></body>') == "Kept."


def test_a_raw_element_ends_at_its_whole_name():
    for end in ("</script>", "</SCRIPT >", "</script\n>", "</script/>", "</script x='y'>"):
        assert text_of(f"<p>a</p><script>var x = '</scripture> <p>no</p>'; '</scripts>' {end}<p>b</p>") == "a\nb", end
    assert text_of("<p>a</p><script>var x = 1; </script") == "a" == text_of("<p>a</p><style>p{} </sty")
    assert text_of("<p>a</p><textarea>x</textareas>y</textarea>b") == "a\nb"


def test_odd_tags_are_read_in_one_pass():
    import time

    began = time.time()
    for bad in ("<a " + "\"'" * 200_000, "<a x=" * 100_000, "<div " + "a\"b'c" * 50_000 + "x>tail", "<b>" * 30_000 + "</i>" * 30_000, "<" * 300_000, "<!-- " * 100_000, "<span>" * 20_000 + "<p>" * 20_000, '<a href="x>y' * 50_000):
        text_of(bad)
    assert time.time() - began < 60
    assert text_of('<p>one <a title="a > b" href=\'c>d\'>two</a> 3 < 4 <3 & &lt;5</p><p>six') == "one two 3 < 4 <3 & <5\nsix"
    assert text_of('<p>a</p><p class="x>b</p><p>c</p>') == "a\nb\nc"
    assert text_of("<p>x<!-- <p>y --> z</p><script>var a = '<p>no</p>';</script><br/><p>w</p>") == "x z\nw"


def test_template_counts_equal_brute_force(spark):
    rows = []
    for h in range(3):
        for p in range(12):
            body = "".join(f"<p>own {h} {p} {i}</p>" for i in range(3))
            extra = f"<p>seen {h} twelve times</p>" + (f"<p>seen {h} thrice</p>" if p < 3 else "") + (f"<div><p>seen {h} on half</p></div>" if p % 2 else "")
            rows.append((h * 100 + p, f"http://h{h}.example/{p}", f"<body><div>{extra}</div>{body}</body>"))
    rows += [(900 + i, "http://h0.example/copy", rows[0][2]) for i in range(30)]  # copies count once
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    parsed = {}
    for _, url, source in rows:
        hashes: set = set()
        root = html_text.parse(source)
        html_text.weigh(root, hashes)
        parsed[url.split("/")[2], root.hash] = hashes - {root.hash}
    want = {}
    for host in {h for h, _ in parsed}:
        pages = [x for (h, _), x in parsed.items() if h == host]
        counts = {x: sum(x in p for p in pages) for x in set().union(*pages)}
        want[host] = {(x, n >= 0.5 * len(pages)) for x, n in counts.items() if n >= 4 and n >= 0.2 * len(pages)}
    with_host = df.select("page_id", "url", "html", html_text.host_of(df["url"]).alias("host"))
    got = {r.host: {(t["hash"], t["strong"]) for t in r.templates} for r in html_text.site_templates(with_host, 0.2, 4).collect()}
    assert got == want and all(got.values())
    texts = {r.page_id: r.text for r in html_text.main_text(df).collect()}
    salted = {r.page_id: r.text for r in html_text.main_text(df, broadcast_templates=0).collect()}
    assert texts == salted
    assert texts[0] == "seen 0 thrice\nown 0 0 0\nown 0 0 1\nown 0 0 2" and texts[5] == "own 0 5 0\nown 0 5 1\nown 0 5 2"
