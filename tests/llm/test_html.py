"""Main text of hand-made pages: hostile markup, everyday class names and ten templates, with the text known beforehand."""

import random

import pytest

from tonegraph.llm import html_extract
from tonegraph.llm.html_extract import Page, nouns

PARAGRAPHS = [f"Paragraph {k} of the text, which goes on for a while, and then goes on again. " * 4 for k in range(4)]
P = "".join(f"<p>{t}</p>" for t in PARAGRAPHS)
TEXT = "\n".join(t.strip() for t in PARAGRAPHS)


def page(body, attributes=""):
    return f"<!doctype html><html><head><title>x</title></head><body {attributes}>{body}</body></html>"


@pytest.mark.parametrize(
    ("source", "want"),
    [
        (f'<div class="content has-sidebar"><article>{P}</article></div><p>Copyright line</p>', TEXT),
        (f'<div class="post comment-open">{P}</div><p>Copyright line</p>', TEXT),
        (f'<div class="post widget-area">{P}</div><p>Copyright line</p>', TEXT),
        (f'<article><p class="comment-free">Kept.</p>{P}</article>', f"Kept.\n{TEXT}"),
        ("<article><p title=Bob's>first</p><p>second</p><p>Ann's third</p></article>", "first\nsecond\nAnn's third"),
        ("<article><p title=\"a>b\" data-x='<p>'>one</p><p title=>two</p><p =x>three</p></article>", "one\ntwo\nthree"),
        ("<article><p title='open>one</p><p>two</p></article>", "one\ntwo"),
        (f"<article>{P}<p>See <button>Buy</button> this <select><option>a<option>b</select><label>L</label> here.</p></article>", f"{TEXT}\nSee this here."),
        (f"<article>{P}<p>x <span class=ad>AD</span>y <span class='advert'>AD</span>z</p></article>", f"{TEXT}\nx y z"),
        (f"<article>{P}<article class=comment><p>Nice, really nice.</p></article></article>", TEXT),
        (f"<article>{P}<div class=comments><article><p>Nice, really nice.</p></article></div></article>", TEXT),
        (f"<div class=menu>{P}</div><p>c</p>", TEXT),
        ("<div class=notice>All there is.</div>", "All there is."),
    ],
)
def test_classes_and_markup(source, want):
    assert Page(page(source)).text(None) == want


@pytest.mark.parametrize("source", [P, f"<p>x</p><div>{P}</div>", f"<table><tr><td>{P}</td></tr></table>"])
def test_text_outside_a_body(source):
    assert Page(source).text(None).endswith(TEXT)


SITE = "<header class=site-header><h1>The Site</h1><nav><a href=/>Home</a></nav></header>"
TEMPLATES = {
    "blog": f"""<div id=page>{SITE}<div class=site-content><div class=primary><div class="post-12 post hentry"><header class=entry-header><h1>Title</h1></header>
      <div class=entry-content>{P}</div></div><div id=comments class=comments-area><ol class=comment-list><li class=comment><p>First, good post. Very, very good.</p></ol>
      <div id=respond><form><p>Leave a reply</p></form></div></div></div><aside>side</aside></div><footer>f</footer></div>""",
    "news": f"""{SITE}<div class=breadcrumb><a href=/>News</a></div><main><h1>Title</h1><div class="ad-slot">Buy</div>{P}<div class=related-posts><p>Other, story.</p></div>
      <div class=newsletter-signup>Sign up</div></main><div class=cookie-banner>We use cookies, as all do.</div>""",
    "forum": f"""<div class=wrap><div class=thread-title><h2>Title</h2></div><div class=message>{P}</div><div class=replies><div class=message-2><p>Reply, short.</p></div></div></div>""",
    "shop": f"""<nav>Shop</nav><div class=product><h1>Title</h1><div class=description>{P}</div><form class=cart><label>Size<select><option>S</select></label><button>Add</button></form></div>""",
    "old table": f"""<table><tr><td><a href=a>One</a> <a href=b>Two</a></td><td><h1>Title</h1>{P}</td></tr></table>""",
    "server form": f"""<form id=aspnetForm><div class=top><a href=x>Home</a></div><div id=main><h1>Title</h1>{P}</div><div class=login><p>Log in</p></div></form>""",
    "divs as paragraphs": "<div id=c><h1>Title</h1>" + "".join(f"<div class=par>{t}</div>" for t in PARAGRAPHS) + "</div><div class=site-footer>f, g. h</div>",
    "page builder": "<div class=builder><h1>Title</h1>" + "".join(f'<div class="el el-{k} el-widget"><div class=el-inner><p>{t}</p></div></div>' for k, t in enumerate(PARAGRAPHS)) + "</div>",
    "sections": "<main><h1>Title</h1>" + "".join(f"<section><p>{t}</p></section>" for t in PARAGRAPHS) + "<section id=comments><p>Well, well. Well.</p></section></main>",
    "wiki": f"""<div id=nav role=navigation><ul><li><a href=a>A</a></ul></div><div id=content class=mw-body role=main><h1>Title</h1><div id=bodyContent>{P}</div></div><div id=footer>f</div>""",
    "docs": f"""<div class=layout-with-sidebar><div class=sidebar><ul><li>One, two, three</ul></div><div class=doc><h1>Title</h1>{P}</div></div>""",
    "amp": f"""<div class="sidebarLeft no-ads"><div class=story-body><h1>Title</h1>{P}<p class=ad>Buy, buy.</p><ins class=ads>Buy</ins></div></div><p class=copyright>All rights, reserved.</p>""",
}


@pytest.mark.parametrize("name", TEMPLATES)
@pytest.mark.parametrize("attributes", ["", "class='nav-open comment-page' id=menu"])
def test_templates(name, attributes):
    assert Page(page(TEMPLATES[name], attributes)).text(None) == f"Title\n{TEXT}"


@pytest.mark.parametrize("name", TEMPLATES)
@pytest.mark.parametrize("pages", [9, 10, 11, 12])
def test_templates_by_host(spark, name, pages):
    """The same with other words on each page, through the host's vote; the text is known from the words put in."""
    rng = random.Random(name)
    rows, wants = [], {}
    for k in range(pages):
        source = page(TEMPLATES[name])
        want = f"Title\n{TEXT}"
        for t in PARAGRAPHS:
            new = " ".join(rng.choices(["one", "two,", "three.", "four", "five"], k=rng.randint(30, 60)))
            source, want = source.replace(t, new), want.replace(t.strip(), new)
        rows.append((k, f"http://{name.replace(' ', '-')}.org/{k}", source))
        wants[k] = want
    assert extracted(spark, rows) == wants


def extracted(spark, rows):
    return {r.page_id: r.text for r in html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


@pytest.mark.parametrize("pages", [5, 9, 10, 11, 100])
def test_what_pages_of_a_host_share_stays(spark, pages):
    """Bylines, datelines, series titles, verdicts and closing lines repeat on a host and are part of each article, whatever
    the number of pages; marked notices go on all of them."""
    body = """<div class=story><h1>{}</h1><p class=byline>By {}</p><p class=series>Part of a series</p><div class=dateline>Berlin</div>{}<div class=verdict><p>{}</p></div>
      <div class=terms>Our terms apply, as always, to all.</div><div class=cookie-notice>We use cookies.</div></div>"""
    own = lambda k: [f"{k} {t.strip()}" for t in PARAGRAPHS]
    rows, wants = [], {}
    for k in range(pages):
        parts = [f"Title {k}", f"By author {k % 8}", "Part of a series", "Berlin", *own(k), ("Worth it.", "Not worth it.")[k % 2], "Our terms apply, as always, to all."]
        rows.append((k, "http://a.org/x", page(body.format(parts[0], parts[1][3:], "".join(f"<p>{t}</p>" for t in own(k)), parts[-2]))))
        wants[k] = "\n".join(parts)
    assert extracted(spark, rows) == wants


def test_copies_of_a_page_are_extracted_alike(spark):
    rows = [(k, "http://b.org/x", page(TEMPLATES["news"])) for k in range(30)]
    assert set(extracted(spark, rows).values()) == {f"Title\n{TEXT}"}


def test_hosts_beyond_the_broadcast(spark, monkeypatch):
    monkeypatch.setattr(html_extract, "BROADCAST_BYTES", 0)
    rows = [(k, f"http://h{k % 3}.org/", page(TEMPLATES["blog"])) for k in range(9)]
    got = html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert [r.text for r in got] == [f"Title\n{TEXT}"] * 9


def test_nouns():
    assert nouns("cookie-notice comment-list sidebarLeft no-sidebar has-comments comment-open related-posts AdSlot") == {
        "notice", "comment", "sidebar", "open", "related", "ad"
    }


def test_hostile_markup_takes_linear_time():
    for piece in ("<a b='", '<p c="', "<", "<div ", "<!--", "<span class=ad>", "</p", "<script>", "<a ===", "<p a = "):
        Page(piece * 20_000).text(None)
