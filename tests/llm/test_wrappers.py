import random
import time

import pytest

from tracewarden.llm import wrappers

SCHEMA = "page_id long, url string, html string, host string, slot string, texts string"


def texts(spark, pages):
    rows = [(i, url, page, "x", "y", "z") for i, (url, page) in enumerate(pages)]
    out = wrappers.main_texts(spark.createDataFrame(rows, SCHEMA)).collect()
    assert all(r.n_chars == len(r.text) for r in out)
    return {r.page_id: r.text for r in out}


def test_frame_and_article(spark):
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head>
    <body><header><h2>Site</h2></header><nav><ul><li><a href=/a>A</a><li><a>B</a></ul></nav><!-- <p>no</p> -->
    <div class="cookie-notice">We use cookies</div><div class=ad>Buy</div>
    <article><h1>Head &amp; tail</h1><p>One <b>two</b>
      three<br>four<p>&#233;t&eacute; &lt;p&gt;<ul><li>x<li>y</ul><form><input value=a>Name</form>
      <aside>Side</aside></article>
    <section id="comments"><p>First!</p></section><footer>&copy; us</footer>"""
    got = texts(spark, [("http://h.example/1", page)])
    assert got[0] == "Head & tail\nOne two three four\nété <p>\nx\ny"


def test_induction_without_any_names(spark):
    """Only the alignment of pages tells template from content."""
    rng = random.Random(1)
    pages, expected = [], {}
    for i in range(30):
        lines = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(8)) for _ in range(rng.randint(1, 6))]
        body = "".join(f"<p>{x}</p>" for x in lines)
        page = (
            "<html><body><div><span>Our site</span></div><div><i>Welcome</i><i>Contact</i></div>"
            f"<div>{body}</div><div><b>All rights</b></div></body></html>"
        )
        pages.append(("https://plain.example/" + str(i), page))
        expected[i] = "\n".join(lines)
    assert texts(spark, pages) == expected


def test_copies_are_no_template(spark):
    """A host that shows one article many times has nothing to align; the article stays."""
    page = "<body><nav>Menu {}</nav><article><p>The one article.</p></article></body>"
    got = texts(spark, [(f"//one.example/{i}", page.format(i)) for i in range(12)])
    assert set(got.values()) == {"The one article."}


def test_edges(spark):
    deep = "<div>" * 5000 + "deep" + "</div>" * 5000
    many = "".join(f"<p>a{i}<h2>b{i}</h2>" for i in range(3000))
    pages = [
        (None, None), ("", ""), ("http://a.example", "no tags at all"), ("http://b.example", "<article>open <p>end"),
        ("http://c.example", "a < b and <b>c"), ("http://d.example", deep), ("http://e.example", many),
        ("http://f.example", "<script>never closed"), ("http://g.example", "</div></p><p>stray</span> ends</p>"),
        ("http://h.example", '<p title="a>b">quoted</p><p title="lone>x</p>'), ("http://i.example", "&amp &bogus; &#0;"),
        ("http://c.example", "a < b and <b>c"),
    ]
    got = texts(spark, pages)
    assert len(got) == len(pages)
    assert [got[i] for i in (0, 1, 2, 3, 4, 5, 7, 8)] == [
        "", "", "no tags at all", "open\nend", "a < b and c", "deep", "", "stray ends",
    ]
    assert got[6].split("\n") == [x for i in range(3000) for x in (f"a{i}", f"b{i}")]
    assert got[9].startswith("quoted") and got[11] == got[4]


def test_empty(spark):
    assert texts(spark, []) == {}


@pytest.mark.parametrize("most", [8, 60])
@pytest.mark.parametrize("seed", range(6))
def test_every_tree_fits_its_wrapper(seed, most):
    """Each node of a tree finds a place of its own kind in what the tree was merged into.

    Beyond ``SIBLINGS`` children the order is given up, and with it, for a few nodes, the place:
    they are read as part of their parent.
    """
    rng = random.Random(seed)

    def tree(depth):
        n = rng.choice([0, 1, 3, most]) if depth else 0
        return (rng.choice("abc"), tuple(tree(depth - 1) for _ in range(n)))

    def kinds(t):
        return [t[0]] + [k for c in t[1] for k in kinds(c)]

    tools = wrappers.Trees()
    trees = [("", tuple(tree(2) for _ in range(rng.choice([2, most])))) for _ in range(3)]
    frame = tools.skeleton(trees[0])
    for t in trees[1:]:
        frame = tools.merged(frame, tools.skeleton(t))
    names = kinds(frame)
    nodes = [(k, names[place]) for t in trees for k, place in zip(kinds(t), tools.located(t, frame), strict=True)]
    lost = sum(a != b for a, b in nodes)
    assert lost == 0 if most < wrappers.SIBLINGS else lost < 0.05 * len(nodes)


def test_depth(spark):
    """Beyond ``DEPTH``, end tags still meet their own elements, and frames and scripts stay out."""
    deep = "<div>" * 150
    inside = "<script>var x</script><nav>Menu</nav><p>in</p><style>p{}</style><form>Name</form>"
    pages = [
        ("http://a.example", f"<body><div><article>{deep}{inside}{'</div>' * 150}<p>end</p></article></div></body>"),
        ("http://b.example", f"<body>{'<font>' * 150}<p>one</p>{inside}<main>two</main>"),
        ("http://c.example", "<p><table>" + "<div><li>" * 20000 + "x"),
    ]
    assert texts(spark, pages) == {0: "in\nend", 1: "two", 2: "x"}


@pytest.mark.parametrize("n", [10, 60])
def test_few_values_are_no_template(spark, n):
    """Whether a text is content does not depend on the number of pages, and main elements stay."""
    rng = random.Random(n)
    main, plain = [], []
    for i in range(n):
        words = " ".join(f"w{rng.randrange(10**6)}" for _ in range(8))
        value = ["yes", "no", "maybe"][i % 3]
        main.append((f"<article><p>{words} <b>Note</b> end{i}</p><ul><li>{value}</li></ul><h2>Details</h2></article>",
                     f"{words} Note end{i}\n{value}\nDetails"))
        plain.append((f"<body><div><p>{words}</p><h2>{value}</h2></div><div><i>All rights</i></div></body>", f"{words}\n{value}"))
    pages = [(f"http://main.example/{i}", p) for i, (p, _) in enumerate(main)]
    pages += [(f"http://plain.example/{i}", p) for i, (p, _) in enumerate(plain)]
    assert texts(spark, pages) == dict(enumerate(t for _, t in main + plain))


def test_constant_neighbours_are_template(spark):
    """Among neighbours of one kind the constant ones are template; lines of content stay whole."""
    rng = random.Random(3)
    pages, expected = [], {}
    for i in range(30):
        a, b, c = (" ".join(f"w{rng.randrange(10**6)}" for _ in range(8)) for _ in range(3))
        page = (
            f"<body><div>Only today: half price</div><div><p>{a}</p><p>{b} <b>Note</b>.</p><p><a>Read more</a></p>"
            f"<p>Sign up for\n our newsletter</p><ul><li>{['yes', 'no', 'maybe'][i % 3]}</li></ul></div><div>{c}</div></body>"
        )
        pages.append((f"http://plain.example/{i}", page))
        expected[i] = f"{a}\n{b} Note.\n{['yes', 'no', 'maybe'][i % 3]}\n{c}"
    assert texts(spark, pages) == expected


WORDS = "some words that make up a text of the usual length for such a place"
#: Pages whose names mislead, and their main text.
MISLEADING = [
    (f"<body><main></main><div class=content><p>{WORDS}</p></div></body>", WORDS),
    (f'<body><div id=page class="has-sidebar"><article><p>{WORDS}</p></article></div></body>', WORDS),
    (f'<body><div class="sidebar-layout"><article><p>{WORDS}</p></article></div></body>', WORDS),
    (f'<body><article class="post no-comments"><p>{WORDS}</p></article></body>', WORDS),
    (f'<body><h1 class="main-title">Head</h1><p>{WORDS}</p></body>', f"Head\n{WORDS}"),
    (f"<body><p>{WORDS}</p><ul><li><a class=article-link>one</a><li><a>two</a></ul></body>", f"{WORDS}\none\ntwo"),
    (f"<body><p>{WORDS} a <span class=share>share</span> of it</p><div><a class=share>Tweet</a></div></body>", f"{WORDS} a share of it"),
    (f"<body><div class=comments-page><div class=text><p>{WORDS}</p></div></div></body>", WORDS),
    (f"<body><article><p>{WORDS}</p><div class=share>Tweet</div></article><section class=comments>No!</section></body>", WORDS),
]


def test_names_do_not_decide_alone(spark):
    pages = [(f"http://h{i}.example/", page) for i, (page, _) in enumerate(MISLEADING)]
    assert texts(spark, pages) == {i: t for i, (_, t) in enumerate(MISLEADING)}


def site(rng, article, ad, bare):
    """Pages of one host: an advert, an article and a title, all different on each page."""
    pages, expected = [], {}
    for i in range(20):
        line = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
        head, body = line(5), [line(30) for _ in range(rng.randint(2, 6))]
        blocks = "".join(f"<p>{x}</p>" for x in body)
        page = f"<body><nav><a>{line(1)}</a></nav><{ad}>{line(4)}</{ad.split()[0]}><{article}><h1>{head}</h1>{blocks}</{article.split()[0]}></body>"
        pages.append((f"http://{bare}.example/{i}", page))
        expected[i] = "\n".join([head, *body])
    return pages, expected


@pytest.mark.parametrize("article, ad", [("article", 'div class="ad"'), ("div class=x1", "div class=x2"), ("section", "div")])
def test_region_decides_without_telling_names(spark, article, ad):
    """All texts differ from page to page: only the place of most of them tells the article."""
    pages, expected = site(random.Random(5), article, ad, "bare")
    assert texts(spark, pages) == expected


def test_a_page_laid_out_differently_keeps_its_text(spark):
    pages, expected = site(random.Random(6), "article", "div class=ad", "mixed")
    pages.append(("http://mixed.example/other", f"<body><table><tr><td>{WORDS}</td></tr></table></body>"))
    assert texts(spark, pages) == {**expected, len(expected): WORDS}


def test_many_shapes_are_folded_in_levels(spark, monkeypatch):
    monkeypatch.setattr(wrappers, "FOLD", 4)
    rng = random.Random(4)
    pages, expected = [], {}
    for i in range(40):
        body = [f"w{rng.randrange(10**6)} " * 8 for _ in range(3)]
        tags = [rng.choice(["p", "h3", "pre", "blockquote"]) for _ in body]
        inner = "".join(f"<{t}>{x}</{t}>" for t, x in zip(tags, body, strict=True))
        pages.append((f"http://free.example/{i}", f"<body><article>{inner}</article></body>"))
        expected[i] = "\n".join(x.strip() for x in body)
    assert texts(spark, pages) == expected


def test_hostile_markup_takes_linear_time():
    for page in ("<a " * 500_000, '<a "' * 200_000 + ">", "<![CDATA[" * 100_000, "<!" * 200_000, "<!-- >" * 100_000):
        began = time.time()
        wrappers.parsed(page)
        assert time.time() - began < 10
