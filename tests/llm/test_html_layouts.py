"""Layouts of pages: what is unmarked stays whole, what the smoothed ratio tells apart falls."""

import random

import pytest

from docweave.llm import html_text
from docweave.llm.html_text import extract_pages, main_text

LONG = "Plain sentences about one matter follow each other here and go on for a while, as articles do."
FARM = "".join(f"<p><a href='/{i}'>More {i}</a></p>" for i in range(12))


@pytest.mark.parametrize(
    ("html", "want"),
    [
        (f"<body><h1>Title</h1><p>{LONG}</p><p>{LONG} 2</p><p>The end.</p></body>", ["Title", LONG, f"{LONG} 2", "The end."]),
        (f"<body><div><h1>Title</h1></div><div><p>{LONG}</p><p>{LONG} 2</p></div></body>", ["Title", LONG, f"{LONG} 2"]),
        (f"<body><div class=lead>Short lead.</div><div class=text><p>{LONG}</p><p>{LONG} 2</p></div></body>", ["Short lead.", LONG, f"{LONG} 2"]),
        (f"<article><h2><a href=/p/1>Linked headline</a></h2><p>{LONG}</p></article>", ["Linked headline", LONG]),
        (f"<article><p>{LONG}</p><p>{LONG}</p><p><a href=/r>Read the full report</a></p></article>", [LONG, LONG, "Read the full report"]),
        (f"<article><p>{LONG}</p><ul><li><a>One</a><li><a>Two</a><li><a>Three</a></ul><p>{LONG}</p></article>", [LONG, "One", "Two", "Three", LONG]),
        (f"<article><p>{LONG}</p><div class='related-work'><p>Work of others.</p></div><table class=share-class-table><tr><td>A</table></article>", [LONG, "Work of others.", "A"]),
        (f"<article><p>{LONG}</p><div class='related-posts'><p>Other posts.</p></div><div class='share-buttons'>Share</div></article>", [LONG]),
        (f"<body><p>{LONG}</p><div id='cookieNotice'>We use cookies.</div><div class='sidebar-left widget'>Side</div></body>", [LONG]),
        ("<body><p>Yes.</p><p>No.</p></body>", ["Yes.", "No."]),
        ("<body><p><a href=/>Only a link</a></p></body>", ["Only a link"]),
    ],
)
def test_layouts(html, want):
    assert main_text(html).split("\n") == want


def generated(rng):
    """A page with or without an article, its blocks in random containers, marked ones around and between; its text."""
    blocks = []
    text = lambda: rng.choice([LONG, f"{LONG} {LONG}", "Short one.", "A few words more than that, perhaps."]) + f" {rng.randrange(10**6)}"
    shown = []
    for _ in range(rng.randrange(2, 12)):
        words = text()
        shown.append(words)
        blocks.append(rng.choice(["<p>{}</p>", "<div>{}</div>", "<div class='x'><p>{}</p></div>", "<section><div><p>{}</p></div></section>", "<blockquote>{}</blockquote>", "<h2>{}</h2>", "<p><b>{}</b></p>"]).format(words))
        if rng.random() < 0.2:
            blocks.append(rng.choice(["<div class='ad'>Buy now, it is cheap</div>", "<aside>Side text</aside>", "<div class='newsletter-signup'>Sign up</div>", "<script>var a = '<p>x</p>'</script>", "<ul class='social-links'><li><a>f</a></ul>"]))
    if rng.random() < 0.5:
        shown.insert(0, "The title")
        blocks.insert(0, rng.choice(["<h1>The title</h1>", "<div><h1>The title</h1></div>", "<h1><a href=/>The title</a></h1>"]))
    inner = "".join(blocks)
    wrap = rng.choice(["{}", "<article>{}</article>", "<main>{}</main>", "<div class='page'>{}</div>", "<main><article>{}</article></main>"])
    head = rng.choice(["", "<header>Site</header>", "<nav><a>Menu</a></nav>", "<div id='breadcrumbs'><a>Home</a></div>"])
    foot = rng.choice(["", "<footer>Foot &copy;</footer>", "<div class='comments'><p>Reader says</p></div>", FARM])
    return f"<html><head><title>T</title></head><body>{head}{wrap.format(inner)}{foot}</body></html>", shown, foot == FARM


def test_generated_pages_lose_no_unmarked_block():
    rng = random.Random(7)
    for _ in range(1500):
        html, shown, farm = generated(rng)
        found = [x for x in main_text(html).split("\n") if not x.startswith("More ")]
        assert found == shown, html


def test_ratio_smoothing_and_threshold_each_decide(monkeypatch):
    pages = [
        f"<article>{f'<p>{LONG}</p>' * 4}{FARM}</article>",
        f"<article>{f'<p>{LONG}</p>' * 4}<p><a>See there</a></p>{f'<p>{LONG}</p>' * 3}{FARM}</article>",
        f"<body>{f'<p>{LONG}</p>' * 4}{'<div><b>x</b><i>y</i><u>z</u></div>' * 5}</body>",
    ]
    whole = [main_text(p) for p in pages]
    assert [len(x.split("\n")) for x in whole] == [4, 8, 4]
    monkeypatch.setattr(html_text, "_threshold", lambda values: -1.0)
    assert all(main_text(p) != x for p, x in zip(pages, whole, strict=True))
    monkeypatch.undo()
    monkeypatch.setattr(html_text, "_smooth", lambda values, sigma: values)
    assert main_text(pages[1]) != whole[1]
    monkeypatch.undo()
    monkeypatch.setattr(html_text.np, "log1p", lambda x: x * 0 + 1.0)  # every ratio the same: a tie, one cluster
    assert all(main_text(p) != x for p, x in zip(pages, whole, strict=True))


def test_clashing_names_and_ties(spark):
    rows = [(1, "u", "<p>a</p><p>a</p>", "x", 3, "t")]
    got = extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, n_chars string, text int, _url string"))
    assert [tuple(r) for r in got.collect()] == [(1, "u", "a\na", 3)]
