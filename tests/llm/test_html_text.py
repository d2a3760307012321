import html
import random

from quire.llm import html_text


def page(rng, host, n):
    words = lambda k: " ".join(rng.choice(("alpha", "beta", "gämma", "x & y", "a<b", "“q”")) + str(rng.randrange(99)) for _ in range(k))
    blocks = [words(rng.randint(3, 40)) for _ in range(rng.randint(1, 6))]
    nav = "".join(f'<li><a href="/{k}">{html.escape(words(1))}</a>' for k in range(rng.randint(2, 6)))
    body = "".join(f"<p>{html.escape(b)}" + rng.choice(("", "</p>", "<br></p>", "\n")) for b in blocks)
    inner = {"a.org": f'<article class="post">{body}<div class="comments"><p>first!</p></div></article>', "b.org": f'<div id="content"><div class="ad">{html.escape(words(4))}</div>{body}<form><p>name</p></form></div>'}[host]
    return f"https://{host}/{n}", f'<!DOCTYPE html><html><head><title>t</title><script>var t="</p>";</script><style>p{{}}</style></head><body><nav><ul>{nav}</ul></nav><!-- x <p> -->{inner}<aside><p>{html.escape(words(9))}</p></aside><footer>&copy; {host}</footer></body></html>', "\n\n".join(blocks)


def test_slots_of_two_hosts(spark):
    rng = random.Random(6)
    rows = [(n, *page(rng, host, n)) for n, host in enumerate(("a.org", "b.org") * 30)]
    got = {r.page_id: r for r in html_text.main_text(spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string").repartition(4)).collect()}
    for n, url, _, want in rows:
        assert (got[n].url, got[n].text, got[n].n_chars) == (url, want, len(want))


def test_vectors_do_not_depend_on_partitions(spark):
    rng = random.Random(7)
    rows = [(n, *page(rng, "a.org", n)[:2]) for n in range(30)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    a, b = ({(r.token, r.pages, r.low, r.high, r.once, r.free) for r in html_text.template_tokens(frame.repartition(k)).collect()} for k in (1, 7))
    assert a == b
    everywhere = [r for r in a if r[1] == 30 and r[4]]
    root = next(r for r in a if r[0] == html_text.ROOT)
    assert sum(r[2:4] == root[2:4] for r in everywhere) >= 8  # html, head, body, nav, ... form one class


def brute_template(pages):
    """Text runs that stand once on 4/5 of the pages, under elements that do, and share their pages with another such token; by plain comparison of vectors."""
    counts = []
    for p in pages:
        c = {}
        for token, row in html_text.Page(p).tokens().items():
            c[token] = (row[0], row[6], row[7])
        counts.append(c)
    vectors = {}
    for t in set().union(*counts):
        vectors[t] = tuple(c.get(t, (0,))[0] for c in counts)
    info = {t: v[1:] for c in counts for t, v in c.items()}
    often = {t for t, v in vectors.items() if sum(x > 0 for x in v) >= 0.8 * len(pages)}
    kept = {t for t in often if set(vectors[t]) <= {0, 1}}

    def nested(t):
        return t == html_text.ROOT or (t in kept and nested(info[t][1]))

    texts = set()
    for t in often:
        if info[t][0] == "":
            if t in kept and nested(info[t][1]) and any(vectors[o] == vectors[t] and info[o][0] and nested(o) for o in often):
                texts.add(t)
            elif t not in kept and vectors.get(info[t][1]) == vectors[t]:
                texts.add(t)
    return texts


def frame_page(rng, n, share="Share this with a friend"):
    words = lambda k: " ".join(f"w{rng.randrange(900)}" for _ in range(k))
    body = "".join(f"<p>{words(rng.randint(8, 30))}</p>" for _ in range(rng.randint(2, 5)))
    replies = "".join(f'<section class="note"><h3>{words(2)}</h3><span class="tail">read more</span></section>' for _ in range(rng.randint(1, 4)))
    promo = "<div class='box'>Our best offers today</div>" if n % 8 else ""
    return f'<html><body><div class="top"><b>Site of ours</b></div><div class="page"><div class="inner"><h1>{words(4)}</h1>{promo}{body}<div class="tools"><i>{share}</i></div>{replies}</div></div><div class="low">All rights</div></body></html>'


def test_the_template_is_that_of_plain_vectors_and_is_left_out(spark):
    rng = random.Random(11)
    pages = [frame_page(rng, n) for n in range(24)]
    frame = spark.createDataFrame([(n, "http://c.org/x", p) for n, p in enumerate(pages)], "page_id long, url string, html string")
    row = html_text.templates(frame).first()
    template = html_text.Template(bytes(row.template))
    want = brute_template(pages)
    assert set().union(template.constant, *template.text_of) == want and len(want) >= 5
    got = {r.page_id: r.text for r in html_text.main_text(frame).collect()}
    for n, p in enumerate(pages):
        assert "Share this" not in got[n] and "best offers" not in got[n] and "Site of ours" not in got[n] and "read more" not in got[n]
        assert got[n].split("\n\n") == [" ".join(x) for x in plain_blocks(p)]
        assert got[n] != html_text.extract(p, None)  # by the page alone the frame stays


def plain_blocks(p):
    import re

    return [x.split() for x in re.findall(r"<(?:p|h1|h3)>([^<]*)<", p)]


def test_copies_and_moved_tokens_keep_their_text(spark):
    rng = random.Random(12)
    one = frame_page(rng, 1)
    frame = spark.createDataFrame([(n, "http://d.org/", one) for n in range(9)], "page_id long, url string, html string")
    assert all(len(r.text) > 60 for r in html_text.main_text(frame).collect())  # the frame would be all
    swapped = '<html><body><i>B text</i><p>middle of it goes on and on</p><i>A text</i></body></html>'
    template = html_text.Template(html_text.fit_template([])[1])
    assert template.fixed(html_text.Page(swapped).tokens()) == set()


def test_long_and_deep_pages_are_linear():
    import time

    began = time.perf_counter()
    for p in ("<a " * 350_000, "<div>" * 100_000 + "x" + "</div>" * 100_000, "<b>" * 60_000 + "<h1>" * 60_000, "<p><td>" + "<h1>" * 60_000, "<b><div>" + "<i>" * 50_000 + "</b>" * 50_000, '<a "' * 200_000, "<!" * 300_000, "</section>" * 50_000, "x" * 1_000_000):
        html_text.extract(p, None)
    assert time.perf_counter() - began < 60
    assert html_text.extract("<article><p>a&am<!-- x -->p;b</article>", None) == "a&amp;b"


def test_nulls_odd_pages_and_copies(spark):
    rows = [(1, None, None), (2, "http://u", ""), (3, "http://u", "plain &amp; simple"), (3, "http://u", "plain &amp; simple"), (None, "::", "<p>a<p>b  c<br>d</p><script>x</script"), (5, "http://v/", "<div>" * 3000 + "deep" + "</div>" * 3000), (6, "http://w/", "<article><p>one &eacute;&#8364;</article><footer>no")]
    got = sorted((r.page_id or 0, r.text) for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    assert got == [(0, "a\n\nb c d"), (1, ""), (2, ""), (3, "plain & simple"), (3, "plain & simple"), (5, "deep"), (6, "one é€")]
    assert html_text.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_names_in_slugs_drop_no_text():
    prose = "long free text of the page " * 10
    text = lambda page: html_text.extract(page, None)
    assert text(f'<div class="post has-sidebar"><p>{prose}</div>') == prose.strip()
    assert text(f'<body><div class="no-sidebar content"><p>{prose}</div>') == prose.strip()
    inside = '<section id="search-and-rescue"><h2 id="how-to-form-a-company">How</h2><p>s</section><div class="entry-header"><h1>Title</h1></div><p data-id="ad-7">seven<p title="x class=ad">eight'
    assert text(f"<article>{inside}<p>{prose}</article>").split("\n\n") == ["How", "s", "Title", "seven", "eight", prose.strip()]
    assert text("<article><p>so <math><mrow><mi>x</mi><mo>=</mo><mn>2</mn></mrow></math> holds</article>") == "so x=2 holds"


def test_names_with_their_text_still_drop():
    prose = "long free text of the page " * 10
    junk = '<div class="ad">buy</div><div class="comments"><p>first!</div><div role="search">find</div><div class="site-nav"><a>one</a> <a>two</a></div>'
    assert html_text.extract(f"<article><p>{prose}</p>{junk}</article>", None) == prose.strip()


def test_the_template_chooses_the_slot_without_tags_that_tell(spark):
    """The same pages with article, nav and footer as plain div elements: the slot comes from the host's classes."""
    rows = []
    for i in range(8):
        own = f"Title {i}", " ".join(f"word{i}x{k}" for k in range(60)), f"Second part {i} with words of its own."
        menu = "".join(f"<li><a href='/{k}'>Entry {k}</a></li>" for k in range(5))
        rows.append((i, f"http://plain.org/{i}", f"<html><body><div id=top><ul>{menu}</ul></div><div id=a><h1>{own[0]}</h1><p>{own[1]}</p><p>{own[2]}</p></div><div id=end><p>Always the same last words here</p></div></body></html>"))
    got = {r.page_id: r.text for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"Title {i}\n\n" + " ".join(f"word{i}x{k}" for k in range(60)) + f"\n\nSecond part {i} with words of its own." for i in range(8))


def test_an_article_keeps_its_own_header():
    page = "<body><header><p>Site name</p></header><article><header><h1>Its title</h1></header><p>Words of the article, some more of them.</p></article></body>"
    assert html_text.extract(page, None) == "Its title\n\nWords of the article, some more of them."


def test_an_article_that_holds_little_is_not_the_slot():
    page = "<body><article><p>teaser</p></article><div><p>" + "long text of the page " * 30 + "</p></div></body>"
    assert html_text.extract(page, None).startswith("long text of the page")
