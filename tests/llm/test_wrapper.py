import random

from tessera.llm import wrapper
from tessera.llm.alignment import Matching, Twig, below
from tessera.llm.dom import parse

LAYOUT = (
    "<html><head><title>t{n}</title><style>p{{}}</style></head><body><header><h2>Site</h2></header>"
    "<nav><ul><li><a href='/a{n}'>menu {n}<li><a>two</a></ul></nav><!-- x --><div class='ad'>buy {n}</div>"
    "<article><h1>Title&nbsp;{n}</h1><p><b>First &amp; best {n}<br><p>Second\n\t line {n}, which goes on for long enough to be what the page is about<script>x='</p>'</script></p>{more}"
    "<p>Follow our channel for more</p></article><aside>side {n}</aside>"
    "<div id=comments><p>reader {n}</p></div><form><p>mail</p></form><footer>&copy; {n}</footer></body></html>"
)

REST = ", which goes on for long enough to be what the page is about"


def run(spark, rows):
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, host string, tree string")
    return {r["id"]: r["text"] for r in wrapper.extract_articles(frame).collect()}


def test_constant_parts_go_and_slots_stay(spark):
    rows = [(n, f"https://a.example/{n}", LAYOUT.format(n=n, more=f"<p>Further words of {n}.</p>" * (n % 3)), "h", "t") for n in range(12)]
    rows += [(50, "http://b.example/", LAYOUT.format(n=50, more=""), "h", "t")]
    got = run(spark, rows)
    for n in range(12):
        want = [f"Title {n}", f"First & best {n}", f"Second line {n}{REST}"] + [f"Further words of {n}."] * (n % 3)
        assert got[n].split("\n") == want
    assert got[50].split("\n") == ["Title 50", "First & best 50", f"Second line 50{REST}", "Follow our channel for more"]  # one page shows no template


def test_copies_of_an_article_are_no_template(spark):
    page = "<body><nav>m</nav><article><h1>Same</h1><p>Every word of it is the same.</p></article>"
    got = run(spark, [(n, "https://a.example/x", page, "h", "t") for n in range(8)])
    assert set(got.values()) == {"Same\nEvery word of it is the same."}


def test_odd_pages(spark):
    got = run(spark, [
        (1, None, None, "h", "t"), (2, "", "", "h", "t"), (3, "no host", "plain <b>text", "h", "t"), (4, "https://c.example", "<div><p>a<p>b<ul><li>c<li>d</ul></div>" , "h", "t"),
        (5, "https://c.example", "<div" + "<div>" * 3000 + "deep", "h", "t"), (6, "https://c.example", "<article><p>x &lt; y   z</p></article><article class='comment'><p>no, no, no, no, no, no", "h", "t"),
    ])
    assert got[1] == got[2] == ""
    assert got[3] == "plain text"
    assert got[4] == "a\nb\nc\nd"
    assert "deep" in got[5]
    assert got[6] == "x < y z"
    assert run(spark, []) == {}


def random_tree(rng, depth):
    kids = [random_tree(rng, depth - 1) for _ in range(rng.randrange(4) if depth else 0)]
    return Twig(rng.choice("ab"), rng.choice([1, 2, 3, rng.randrange(4, 99)]), kids)


def brute_size(a, b):
    """Elements that match, over all matchings in order."""
    if a.label != b.label:
        return 0.0

    def lists(xs, ys):
        if not xs or not ys:
            return 0.0
        return max(lists(xs[1:], ys), lists(xs, ys[1:]), brute_size(xs[0], ys[0]) + lists(xs[1:], ys[1:]))

    return 1.0 + 0.5 * (a.key == b.key) + lists(a.kids, b.kids)


def test_matching_agrees_with_brute_force():
    rng = random.Random(6)
    for _ in range(150):
        a, b = random_tree(rng, 3), random_tree(rng, 3)
        for cells in (1, 4, 10_000):  # small tables are halved, over and over
            matching = Matching(a, b, cells)
            assert matching.size(a, b) == brute_size(a, b)
            pairs = matching.aligned()
            assert sum(1 + 0.5 * (x.key == y.key) for x, y in pairs) == brute_size(a, b)
            order = {id(x): i for tree in (a, b) for i, x in enumerate(below(tree))}
            assert len({id(x) for x, _ in pairs}) == len({id(y) for _, y in pairs}) == len(pairs)
            places = sorted((order[id(x)], order[id(y)]) for x, y in pairs)
            assert all(p[1] < q[1] for p, q in zip(places, places[1:]))  # in order of the page


def test_long_lists_are_matched_in_order():
    xs = wrapper._twigs(wrapper._prepared("<div>" + "".join(f"<p>x{i}</p>" for i in range(400)) + "<p>end</p></div>"))
    page = wrapper._twigs(wrapper._prepared("<div>" + "".join(f"<p>y{i}</p>" for i in range(550)) + "<p>end</p></div>"))
    pairs = Matching(xs, page).aligned()
    assert len(pairs) == 403 and sum(x.key == y.key for x, y in pairs) == 1
    assert parse("<p>a").kids[0].tag == "p"


def test_structure_decides_where_names_say_nothing(spark):
    """Class names are nonsense, there is no article element, and all texts vary."""
    rng = random.Random(9)
    words = "river stone cloud letter window garden market bridge winter silver".split()
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows, want = [], {}
    for n in range(30):
        menu = "".join(f"<li><a href='/{k}'>{text(2)}</a></li>" for k in range(5))
        body = [text(6), *[text(rng.randrange(30, 60)) for _ in range(rng.randrange(2, 7))]]
        story = f"<h2>{body[0]}</h2>" + "".join(f"<p>{p}</p>" for p in body[1:])
        more = "".join(f"<li><a href='/m{k}'>{text(3)}</a></li>" for k in range(3))
        rows.append((n, f"https://z.example/{n}", f"<body><div class=qx1><ul>{menu}</ul></div><div class=qx2>{text(5)}</div><div class=qx3>{story}<ul class=qx4>{more}</ul></div><div class=qx5><p>{text(4)}</p></div></body>", "h", "t"))
        want[n] = "\n".join(body)
    assert run(spark, rows) == want


def test_template_elements_are_found(spark):
    page = "<body><nav><ul><li><a>m{n}</a></ul></nav><div class=ad>b{n}</div><article><h1>T{n}</h1><p>Words of {n}.</p></article><footer>f{n}</footer></body>"
    frame = spark.createDataFrame([(n if n else None, f"https://a.example/{n}", page.format(n=n)) for n in range(3)], "page_id long, url string, html string")
    out = wrapper.extract_articles(frame).collect()
    assert all(r["n_template"] >= 6 for r in out)
    assert sorted((str(r["id"]), r["text"]) for r in out) == [("1", "T1\nWords of 1."), ("2", "T2\nWords of 2."), ("None", "T0\nWords of 0.")]


def test_a_section_named_like_noise_stays_if_it_is_of_the_article(spark):
    page = "<article><h1>A paper</h1><section class='discussion'><p>What the results mean, at length.</p></section><div id='related'><p>Work that is related, at some length, with more to say.</p></div><div class='comments'><p>A reader says so much that it is most of the page, " + "again " * 30 + "</p></div></article>"
    assert run(spark, [(1, "https://a.example/", page, "h", "t")])[1] == "A paper\nWhat the results mean, at length.\nWork that is related, at some length, with more to say."


def test_a_very_long_page(spark):
    page = "<body><article>" + "<p>w <b>{n}</b> {n}</p>" * 3_000 + "<h2>{n}</h2>" + "<p>w {n}</p>" * 900 + "</article></body>"
    got = run(spark, [(n, f"https://a.example/{n}", page.replace("{n}", str(n)).replace("<h2>", "<h2>" * (1 + n % 2)), "h", "t") for n in range(3)])
    assert all(len(got[n]) == 3_000 * 6 + 2 + 900 * 4 - 1 for n in range(3))


def test_each_layout_of_a_host_has_its_template(spark):
    menu = "<div class='top'><p>Home of all the best things to read, to hear and to see</p><p>Another constant line of the layout, long enough</p></div>"
    one = "<body>{menu}<div class='story'><p>Short {n}.</p></div></body>"
    two = "<body><section class='wide'><p>Constant words of the second layout, which are on all of its pages</p><p>Tale {n}.</p></section></body>"
    rows = [(n, f"https://a.example/{n}", (one if n % 2 else two).format(n=n, menu=menu), "h", "t") for n in range(16)]
    assert run(spark, rows) == {n: f"Short {n}." if n % 2 else f"Tale {n}." for n in range(16)}


def test_many_copies_of_two_articles_are_no_template(spark):
    page = "<body><article><h1>{0}</h1><p>Every word of {0} is the same.</p></article>"
    rows = [(n, f"https://a.example/{n}", page.format("One" if n else "Two"), "h", "t") for n in range(30)]
    got = run(spark, rows)
    assert got[0].startswith("Two") and all(got[n] == "One\nEvery word of One is the same." for n in range(1, 30))


def test_names_around_the_article_drop_nothing(spark):
    story = "<p>What the page is about, in words enough</p>"
    pages = [
        f"<div class='layout has-sidebar'><article>{story}</article></div>", f"<div class='post comments-open'>{story}</div><div class='comments'><p>no</p></div>",
        f"<div id='search-results'>{story}</div>", f"<div class='sidebar'><article>{story}</article></div><div class='related'><article>x</article></div>",
        f"<div class='widget'>{story}</div><p class='cookie-consent'>yes?", f"<form hidden><article>{story}</article></form>",
    ]
    got = run(spark, [(n, f"https://{n}.example/", page, "h", "t") for n, page in enumerate(pages)])
    assert set(got.values()) == {"What the page is about, in words enough"}


def test_all_parts_of_a_story_are_taken(spark):
    got = run(spark, [
        (1, "https://a.example", "<article><p>Part one.</p></article><article><p>Part two is longer.</p></article>", "h", "t"),
        (2, "https://b.example", "<main><article><p>A teaser.</p></article><div><p>The story, which is longer than its teaser.</p></div></main>", "h", "t"),
        (3, "https://c.example", "<main><article><p>The story, which is longer than its note.</p></article><p>A note.</p></main>", "h", "t"),
    ])
    assert got[1] == "Part one.\nPart two is longer."
    assert got[2] == "A teaser.\nThe story, which is longer than its teaser."
    assert got[3] == "The story, which is longer than its note."


def test_an_article_below_many_elements_is_found(spark):
    page = "<div>" * 900 + "<article><p>The story.</p></article><p>Beside it.</p>" + "</div>" * 900 + "<p>After it."
    assert run(spark, [(n, f"https://a.example/{n}", page, "h", "t") for n in range(2)]) == {0: "The story.", 1: "The story."}
