import html
import random
import re

from pyspark.sql import functions as F

from strataline.llm import wrappers as w

SCHEMA = "page_id long, url string, html string"


def plain(page):
    """The main text of the given pages: what is between the article's tags, a block for each heading and paragraph."""
    m = re.search(r"<article>(.*?)</article>", page or "", re.S)
    if not m:
        return ""
    blocks = re.split(r"</?(?:p|h1)>", m[1])
    lines = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in blocks]
    return "\n".join(x for x in lines if x)


def test_pages(spark, sf):
    for d in (sf, "/root/testdata/sf0.01"):
        pages = {r.page_id: r.html for r in spark.read.parquet(f"{d}/pages.parquet").collect()}
        rows = w.op3_html_wrappers(spark, d).collect()
        assert len(rows) == len(pages)
        for r in rows:
            assert r.text == plain(pages[r.page_id]) and r.n_chars == len(r.text)


def text_of(spark, pages):
    df = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(pages)], SCHEMA).withColumn("text", F.lit(1)).withColumn("host", F.lit("x"))
    return [r.text for r in w.main_text(df).orderBy("page_id").collect()]


def test_parts_that_are_no_main_text(spark):
    page = (
        "<html><body><header>Site</header><nav>Menu</nav><div class='cookie-notice'>Cookies</div><main><article class=post><header><p>by X</p></header><h1>T &amp; t</h1>"
        "<p>One <b>two</b>\n three<br>four<p>five<ul><li>a<li>b</ul><form>Mail</form><aside>Side</aside><script>x('</p>')</script><style>p{}</style><!-- c -- > <p>no</p> -->"
        "<table><tr><td>c1<td>c2</table><footer>foot</footer></article><section id=comments><article>Reader</article></section></main><div class='sidebar'>Bar</div></body></html>"
    )
    assert text_of(spark, [("http://h/1", page)]) == ["T & t\nOne two three four\nfive\na\nb\nc1\nc2"]


def test_pages_without_article_use_slots_that_vary(spark):
    make = lambda t, x: f"<html><head><title>{t}</title></head><body><div class=top>The Site</div><div class=c><h2>{t}</h2><p>{x}</p></div><div>All rights reserved</div></body></html>"
    got = text_of(spark, [(f"http://h.example/{i}", make(f"Title {i}", f"Body {i} text")) for i in range(4)])
    assert got == [f"Title {i}\nBody {i} text" for i in range(4)]


def test_defined_cases(spark):
    got = text_of(spark, [(None, None), ("nonsense", ""), ("http://a/", "<p>alone"), ("http://b/", "plain < text & &copy &#x41; &nbsp; end"), ("http://c/", "<!-- open <p>x"), ("http://d/", "<p>a<script>if (a<b) {"), ("http://e/", "<article></article>")])
    assert got == ["", "", "alone", "plain < text & © A end", "", "a", ""]
    assert text_of(spark, [("http://a/", "<article>" + "<p>x</p>" * 20000 + "</article>")] * 2) == ["\n".join("x" * 20000)] * 2
    empty = spark.createDataFrame([], SCHEMA)
    assert w.main_text(empty).count() == 0 and w.infer(empty).count() == 0


def test_expressions():
    learn = lambda *pages: w.pattern(_all([w.learn(w.parse(p)) for p in pages]))

    def _all(ws):
        out = ws[0]
        for x in ws[1:]:
            out = w._merge_node(out, x)
        return out

    assert learn("<ul><li>a</li><li>b</li></ul>") == "<><ul>(<li>#</>)+</></>"
    assert learn("<div><p>a</p></div>", "<div><h2>t</h2><p>b</p></div>") == "<><div>(<h2>#=</>)? <p>#</></></>"
    assert learn("<dl><dt>a<dd>b<dt>c<dd>d</dl>", "<dl><dt>x<dd>y</dl>") == "<><dl>(<dt>#</> <dd>#</>)+</></>"
    assert learn("<p>same", "<p>same", "<p>same") == "<><p>#=</></>"


def test_classes_that_speak_of_the_page(spark):
    page = "<body class='home has-menu'><div class='page with-sidebar'><article><p>Text</p></article><div class='sidebar'><p>Bar</p></div></div></body>"
    assert text_of(spark, [("http://h/1", page)]) == ["Text"]


def test_copies_of_a_page_without_article(spark):
    page = "<html><body><nav>Menu</nav><div class=c><h2>Title</h2><p>Body text</p></div></body></html>"
    other = "<html><body><nav>Menu</nav><div class=c><h2>{0}</h2><p>{0} text</p></div></body></html>"
    want = "Title\nBody text"
    assert text_of(spark, [("http://h/1", page)] * 3) == [want] * 3
    assert text_of(spark, [("http://h/1", page), ("http://h/2", page.replace("Menu", "Menu 2"))]) == [want] * 2
    form = "<html><body><div class=letter><pre>Only here</pre></div></body></html>"
    assert text_of(spark, [("http://h/1", form)] * 2 + [(f"http://h/{i}", other.format(i)) for i in (2, 3)]) == ["Only here"] * 2 + ["2\n2 text", "3\n3 text"]
    same = [f"<html><body><div>Shared</div><i class={c}></i></body></html>" for c in ("a", "b")]
    assert text_of(spark, [("http://h/1", same[0]), ("http://h/2", same[1])]) == ["Shared"] * 2


def test_deep_pages_are_whole(spark):
    deep = lambda n, x: "<div>" * n + x + "</div>" * n
    page = "<div><article>{}<p>rest</p></article></div><div>no</div>"
    for n in (10, 97, 98, 99, 110, 3000):
        inner = "a <b>b</b> c<br>d<div>e<p>f</p>g</div>h<div class=sidebar>x<p>y</p></div><ul><li>i<li>j</ul>"
        assert text_of(spark, [("http://h/1", page.format(deep(n, inner)))]) == ["a b c d\ne\nf\ng\nh\ni\nj\nrest"], n
        assert text_of(spark, [("http://h/1", deep(n, "<p>n</p><article>t<div><i>u</i></div></article><p>o</p>"))]) == ["t\nu"], n


def test_names_are_a_prior(spark):
    body = "<p>A paragraph of the article, long enough to be one, number {0}.</p>"
    page = f"<article><h1>T {{0}}</h1><div class='sidebar no-print'>Bar</div><div class='advert has-image'>Buy</div>{body}<section class='related-work'><p>Earlier work on {{0}} is described by many authors in detail.</p></section><p class='search'>search {{0}}</p></article>"
    got = text_of(spark, [(f"http://h/{i}", page.format(i)) for i in range(4)])
    assert got == [f"T {i}\nA paragraph of the article, long enough to be one, number {i}.\nEarlier work on {i} is described by many authors in detail.\nsearch {i}" for i in range(4)]
    assert text_of(spark, [("http://h/0", page.format(0))]) == got[:1]


def test_what_all_articles_say_is_no_main_text(spark):
    page = "<article><h1>T {0}</h1><p>Text {0}</p><div class=x>Join our mailing list today</div></article>"
    assert text_of(spark, [(f"http://h/{i}", page.format(i)) for i in range(5)]) == [f"T {i}\nText {i}" for i in range(5)]


def test_story_beside_a_list_of_stories(spark):
    page = "<body><div class=story><h2>T {0}</h2><p>The story {0} goes on for a while, as they do.</p><p>And ends {0}.</p></div><div class=list><p><a href=/x>Other {0}</a></p><p><a href=/y>More {0}</a></p></div></body>"
    assert text_of(spark, [(f"http://h/{i}", page.format(i)) for i in range(4)]) == [f"T {i}\nThe story {i} goes on for a while, as they do.\nAnd ends {i}." for i in range(4)]


def test_templates_without_articles(spark):
    """Hosts with templates of their own, the main text known from how the pages were made."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=rng.randrange(3, 9)))
    say = lambda n: " ".join(word() for _ in range(n))
    pages, want = [], []
    for h in range(12):
        name, logo, foot, note = word(), say(2), say(9), say(6)
        shape = rng.choice(("div", "section", "td"))
        for i in range(rng.randrange(4, 9)):
            blocks = [say(rng.randrange(2, 5))] + [say(rng.randrange(8, 40)) for _ in range(rng.randrange(2, 7))]
            main = f"<h2>{blocks[0]}</h2>" + "".join(f"<p>{x}</p>" for x in blocks[1:])
            links = "".join(f"<li><a href='/{word()}'>{say(2)}</a></li>" for _ in range(rng.randrange(2, 6)))
            extra = f"<div class={word() if h % 2 else name + 'x'}>{note}</div>" if not h % 2 else ""
            holder = f"<table><tr><td class={name}>{main}</td></tr></table>" if shape == "td" else f"<{shape} class={name}>{main}</{shape}>"
            pages.append((f"http://host{h}.example/{i}", f"<html><head><title>{say(3)}</title></head><body><div>{logo}</div><ul>{links}</ul>{extra}{holder}<div class=z{name}>{foot}</div></body></html>"))
            want.append("\n".join(blocks))
    assert text_of(spark, pages) == want


def test_reruns_and_other_partitions_agree(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    rows = lambda df: sorted((r.page_id, r.text) for r in w.main_text(df).collect())
    assert rows(pages) == rows(pages) == rows(pages.repartition(5, "page_id"))


def test_dump_and_load():
    for page in ("", "<p>a b</p>" * 9, "<dl><dt>a<dd>b<dt>c<dd>d</dl>x", "<div>" * 5000 + "deep"):
        x = w.learn(w.parse(page))
        assert w.dump(w.load(w.dump(x))) == w.dump(x)
        assert w.dump(w.decide(w.load(w.dump(x)))) == w.dump(w.load(w.dump(w.decide(x))))
