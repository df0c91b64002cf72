import pytest

from gapspark.llm import html as H


def page(body, menu="Menu"):
    return f'<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script></head><body><nav><ul><li><a href="/">{menu}</a></li></ul></nav><div class="ad">buy {menu}</div>{body}<footer>&copy; site {menu}</footer></body></html>'


CASES = [
    (page("<article><h1>A &amp; B</h1><p><b>one<br>two<p>three  \n four</p></article>"), "A & B one two three four"),
    (page("<main><p>x</p><form>no <input></form><aside>no</aside><div class='comments'>no</div><p>y</p></main>"), "x y"),
    (page("<article><header><h1>Title</h1></header><p>in<i>li</i>ne</p><ul><li>a<li>b</ul></article>"), "Title inline a b"),
    ("<p>loose <p>text", "loose text"),
    ("plain", "plain"),
    ("<article><p>unclosed", "unclosed"),
    ("<article><!-- <p>no</p> --><p>caf&eacute;&nbsp;au&#32;lait</p><style>p{}</style></article>", "café au lait"),
    ("<article><table><tr><td>1<td>2<tr><td>3</table></article>", "1 2 3"),
    ("", ""), (None, ""), ("<html></html>", ""), ("<div><</div>", "<"), ("<nav>only a menu</nav>", ""),
]


@pytest.mark.parametrize("source,text", CASES)
def test_without_a_template(source, text):
    assert H.main_text(source, None) == text


def test_wrapper_without_semantic_elements():
    def made(i):
        return f"<body><div><span>Site name</span></div><div><h1>Story {i}</h1><p>Body of story {i} with words.</p><p>Read our terms.</p></div><div><p>All rights reserved</p></div></body>"

    template = H.induced([made(i) for i in range(5)])
    assert H.main_text(made(9), template) == "Story 9 Body of story 9 with words. Read our terms."
    assert "Site name" not in H.main_text(made(9), template)


def test_constant_nodes_are_template_but_never_the_whole_page():
    def made(i):
        return f"<article><div><p>Sign up today</p></div><section><p>News {i}</p></section></article>"

    template = H.induced([made(i) for i in range(4)])
    assert H.main_text(made(7), template) == "News 7"
    same = "<nav>{}</nav><article><p>One article everywhere</p></article>"
    assert H.main_text(same.format(5), H.induced([same.format(i) for i in range(6)])) == "One article everywhere"


def test_tree_matching():
    def tree(label, *kids):
        return H.Shape(label, list(kids), [])

    a = tree("r", tree("x", tree("y")), tree("z"), tree("w"))
    b = tree("r", tree("x"), tree("q"), tree("z"), tree("w"))
    n, pairs = H.matched(a, b)
    assert n == 4 and [(x.label, y.label) for x, y in pairs].count(("z", "z")) == 1
    assert H.matched(a, tree("other"))[0] == 0


def test_pages_of_all_kinds(spark):
    rows = [(i, f"http://Host.example/{i}", page(f"<article><p>text {i}</p></article>", f"m{i}"), "clash") for i in range(30)]
    rows += [(90, None, page("<article><p>no host</p></article>"), "c"), (91, "http://host.example/x", None, "c"), (92, "not an address", "", "c"), (None, "http://host.example/", page("<article>no id</article>"), "c"), rows[3], rows[3]]
    out = H.extracted(spark.createDataFrame(rows, "page_id long, url string, html string, text string").repartition(5)).collect()
    assert len(out) == len(rows)
    told = {r.page_id: r.text for r in out}
    assert all(told[i] == f"text {i}" for i in range(30)) and (told[90], told[91], told[92], told[None]) == ("no host", "", "", "no id")


def test_deep_and_long_pages(spark):
    deep = "<div>" * 5000 + "core" + "</div>" * 5000
    assert H.main_text(deep, None) == "core"
    long = "<article>" + "".join(f"<p>p{i}</p><ul><li>l{i}</li></ul>" for i in range(4000)) + "</article>"
    pages = [long.replace("p1", f"q{k}1") for k in range(5)]  # near copies: nothing is template
    text = H.main_text(long, H.induced(pages))
    assert text.startswith("p0 l0 p1") and text.endswith("p3999 l3999")
    wrapper = H.induced([deep.replace("core", f"<p>site</p><p class=x>text {k}</p>") for k in range(5)])
    assert H.main_text(deep.replace("core", "<p>site</p><p class=x>text 9</p>"), wrapper) == "text 9"


def test_empty_table(spark):
    assert H.extracted(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_headline_beside_the_body_container_is_kept():
    pages = [f'<body><div class="wrap"><h1>Headline {w}</h1><div class="text"><p>{w} ' + f"{w} says this at length. " * 20 + f"</p><p>more of {w}</p></div><p>One site, all rights</p></div></body>" for w in ("alpha", "beta", "gamma", "delta", "epsilon")]
    template = H.induced(pages)
    for w, page in zip(("alpha", "beta", "gamma", "delta", "epsilon"), pages):
        text = H.main_text(page, template)
        assert text.startswith(f"Headline {w} ") and text.endswith(f"more of {w}")


def plain(i, menu="Home News Contact"):
    """A page without telling elements or classes: what is template only alignment can say."""
    return f'<body><div class="x1"><div>{menu}</div></div><div class="x2"><div><h2>Story {i}</h2></div><div><p>{" ".join(f"word{i}x{k}" for k in range(20))}</p></div></div><div class="x3"><span>All rights of this long notice are reserved by the people who run the site, whoever they are</span></div></body>'


def test_the_template_changes_the_text_of_a_host_without_telling_names(spark):
    pages = [(i, f"http://plain.example/{i}", plain(i)) for i in range(12)] + [(50 + i, "http://few.example/", plain(i)) for i in range(2)]
    out = {r.page_id: r.text for r in H.extracted(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)).collect()}
    wrapper = H.induced([plain(i) for i in range(12)])
    for i in range(12):
        assert out[i] == H.main_text(plain(i), wrapper) == f"Story {i} " + " ".join(f"word{i}x{k}" for k in range(20))
        assert H.main_text(plain(i), None).startswith("Home News Contact Story")
    assert out[50].startswith("Home News Contact") and "All rights" in out[51]


def test_layouts_of_one_host_have_templates_of_their_own():
    def other(i):
        return f'<body><table><tr><td>Archive</td></tr><tr><td class="t">Entry {i} of the archive</td></tr></table><ol><li>One</li></ol></body>'

    pages = [plain(i) for i in range(5)] + [other(i) for i in range(5)]
    wrapper = H.induced(pages)
    assert len(wrapper.seeds) == 2
    assert H.main_text(plain(7), wrapper).startswith("Story 7") and H.main_text(other(7), wrapper) == "Entry 7 of the archive"


def test_two_near_copies_lose_nothing():
    a = "<article><h1>T</h1><div><p>First part</p></div><h2>Then</h2><section><p>Second part</p></section></article>"
    pages = [a, a.replace("Second", "Another")]
    assert H.main_text(a, H.induced(pages)) == "T First part Then Second part"


@pytest.mark.parametrize("name", ["no-sidebar", "post related-topic comments-open share", "has-comments site", "with-nav"])
def test_wrappers_with_odd_class_names_keep_their_text(name):
    assert H.main_text(f'<body><div class="{name}"><p>The text of the page</p></div></body>', None) == "The text of the page"
    assert H.main_text(f'<body><div class="{name}"><article><h1>T</h1><p>x</p></article></div></body>', None) == "T x"
    assert H.main_text('<article><p>x</p><div class="comments"><p>I say something much longer than that</p></div></article>', None) == "x"


def test_lists_of_links_are_no_content_outside_an_article():
    links = "<ul>" + "".join(f'<li><a href="/{k}">entry {k}</a></li>' for k in range(4)) + "</ul>"
    assert H.main_text(f"<div>{links}<p>text</p></div>", None) == "text"
    assert H.main_text(f"<article><p>text</p>{links}</article>", None) == "text entry 0 entry 1 entry 2 entry 3"


def test_pairing_in_order_beyond_the_bound():
    a = H.Shape("r", [H.Shape("p" if k % 2 else "q", [], [str(k)]) for k in range(40)], [])
    b = H.Shape("r", [H.Shape("p" if k % 2 else "q", [], [str(k)]) for k in range(-4, 44)], [])
    n, pairs = H.matched(a, b, dynamic=10)
    assert n == 41 and all(x.texts == y.texts for x, y in pairs)


def test_a_seed_written_and_read_is_the_same():
    one = H.Wrapper.of_sample([plain(0), "<body><ul><li>a</ul></body>"])
    two = H.Wrapper.loads(one.dumps())
    assert two.dumps() == one.dumps() and [s.size for s in two.seeds] == [s.size for s in one.seeds]


STORY = "The council decided on Monday that the old bridge over the river will be rebuilt within two years of today."
MORE = "Engineers had warned for a decade that its pillars were worn, and traffic was led over the northern road."


def told(body):
    return H.main_text(f"<html><head><title>t</title></head><body>{body}</body></html>", None)


def test_a_page_inside_a_form_or_dialog_is_a_page():
    inner = f"<nav>Home News</nav><article><p>{STORY}</p></article><footer>Imprint</footer>"
    assert told(f'<form id="aspnetForm">{inner}</form>') == STORY
    assert told(f'<form id="aspnetForm"><div><p>{STORY}</p><p>{MORE}</p></div><input value="x"></form>') == f"{STORY} {MORE}"
    assert told(f"<dialog open><main><p>{STORY}</p></main></dialog>") == STORY
    assert told(f"<article><p>{STORY}</p></article><form><label>Your name</label><input></form>") == STORY
    assert told(f"<article><p>{STORY}</p><form><label>Your name</label><p>Sign up here</p></form></article>") == STORY
    assert told(f"<div><p>{STORY}</p><div role='dialog'>Accept all?</div></div>") == STORY


def test_a_teaser_is_not_the_story():
    page = f'<main><h1>Bridge</h1><p>{STORY}</p><p>{MORE}</p><p>{STORY}</p><p>{MORE}</p><article class="teaser"><h2>Next</h2><p>A short teaser.</p></article></main>'
    assert told(page) == f"Bridge {STORY} {MORE} {STORY} {MORE}"
    assert told(f"<main><h1>Bridge</h1><article><p>{STORY}</p></article></main>") == STORY
    assert told(f"<article><p>{STORY}</p></article><article><p>{MORE}</p></article>") == f"{STORY} {MORE}"


def test_comments_are_not_the_story():
    story = f"<p>{STORY}</p><p>{MORE}</p><p>{STORY}</p>"
    plain = f"<div>{story}</div><section><article><p>I like it.</p></article><article><p>Me too!</p></article></section>"
    assert told(plain) == f"{STORY} {MORE} {STORY}"
    assert told(f'<div>{story}</div><section class="comments"><article><p>{MORE} {MORE}</p></article></section>') == f"{STORY} {MORE} {STORY}"
    assert told(f'<article>{story}<ol class="comment-list"><li>Me too!</li></ol></article>') == f"{STORY} {MORE} {STORY}"
    assert told(f'<article>{story}</article><article class="comment"><p>{MORE}</p></article>') == f"{STORY} {MORE} {STORY}"


def test_topics_that_sound_like_names_of_parts():
    for attribute in ('class="social-policy"', 'id="related-work"', 'id="menu-planning"', 'class="advertising-history"', 'class="comment-culture"'):
        assert told(f"<article><p>{STORY}</p><section {attribute}><p>{MORE}</p></section></article>") == f"{STORY} {MORE}", attribute
    for attribute in ('class="social-links"', 'id="related-posts"', 'class="share-buttons top"', 'class="newsletter-signup"', 'class="ad-slot-3"'):
        assert told(f"<article><p>{STORY}</p><section {attribute}><p>Other</p></section></article>") == STORY, attribute


def test_images_stand_inside_a_word():
    assert told("<article><p>foo<img src='x'>bar</p></article>") == "foobar"


def layout(k, i):
    """Page i of layout k, whose template only alignment can tell."""
    tags = ["section", "div", "table", "dl", "blockquote", "center", "fieldset", "ol"]
    shell = "".join(f'<{tags[(k >> j) % 8]} class="{"abcdefgh"[(k + j) % 8] * (k + 1)}"><p>part {j} of layout {k}</p></{tags[(k >> j) % 8]}>' for j in range(4))
    return f'<body><div class="{"z" * (k + 1)}">{shell}<div class="{"y" * (k + 1)}"><p>{" ".join(f"word{i}x{n}" for n in range(20))}</p></div></div></body>'


def test_a_layout_that_the_first_sample_misses_has_a_template(spark):
    pages = [(i, "http://rare.example/", plain(i)) for i in range(400)] + [(1000 + i, "http://rare.example/", layout(0, i)) for i in range(5)]
    pages += [(2000 + 10 * k + i, "http://many.example/", layout(k, i)) for k in range(30) for i in range(5)]
    pages += [pages[-1], (None, *pages[-1][1:]), (3000, "http://many.example/", "<body><b>one of its own</b></body>")]
    out = H.extracted(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)).collect()
    told = lambda i: " ".join(f"word{i}x{n}" for n in range(20))
    assert len(out) == len(pages) and [r.text for r in out].count(told(4)) == 33 and sum(r.page_id is None for r in out) == 1
    by_id = {r.page_id: r.text for r in out}
    assert all(by_id[1000 + i] == told(i) for i in range(5)) and all(by_id[i] == f"Story {i} {told(i)}" for i in range(400))
    assert all(by_id[2000 + 10 * k + i] == told(i) for k in range(30) for i in range(5)) and by_id[3000] == "one of its own"


def test_a_seed_of_many_children_matches_its_own_page():
    long = H.parse("<body>" + "".join(f"<{'p' if k % 3 else 'ul'}><div>t{k}</div></{'p' if k % 3 else 'ul'}>" for k in range(900)) + "</body>")
    seed = H.Wrapper.loads(H.Wrapper([H.shape(long)[0]]).dumps()).seeds[0]
    assert H.matched(seed, H.shape(long)[0])[0] == seed.size
