"""Names that only tell of other parts of a page, and elements that are empty, unclosed or hold text."""

import pytest

from rampart.llm import html_extract
from rampart.llm.html_extract import main_text

LONG = "This paragraph is long enough to be seen as the content of the page, whatever its names say."
PAGE = f"<article><h1>Head</h1><p>{LONG}</p></article>"


@pytest.mark.parametrize("at", ["body class='has-sidebar'", "body class=no-sidebar", "body class='comments-open'", "body class=sidebar", "div class='with-sidebar'", "div class='sidebar wrap'", "main class=comments"])
def test_names_of_other_parts_hide_nothing(at):
    assert main_text(f"<{at}>{PAGE}<div class=sidebar><p>Popular posts of this month.</p></div></{at.split()[0]}>") == f"Head\n{LONG}"


def test_comments_stay_hidden():
    comments = "".join(f"<article><p>{LONG} {i}</p></article>" for i in range(9))
    assert main_text(f"<body>{PAGE}<div id=comments>{comments}</div></body>") == f"Head\n{LONG}"


@pytest.mark.parametrize("odd", ["<svg viewBox='0 0 1 1'/>", "<svg/>", "<math/>", "<noscript>", "<template>", "<object data=x>", "<svg>"])
def test_the_rest_is_not_dropped(odd):
    assert main_text(f"<article><p>{LONG}</p>{odd}<p>{LONG} Twice.</p></article>") == f"{LONG}\n{LONG} Twice."


def test_formulas_and_plain_text_stay():
    assert main_text(f"<article><p>{LONG} So <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds.</p></article>") == f"{LONG} So x=1 holds."
    assert "a <b> &amp; c" in main_text(f"<article><p>{LONG}</p><xmp>a <b> &amp; c is kept as it stands in the page.</xmp></article>")


SAID = "This is a long enough sentence of the main article, with more than a few words in it, so that it counts as prose."


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<p>{SAID} <span class='ad'>Buy now</span> and it goes on here.</p>", f"{SAID} and it goes on here."),
        (f"<article>{SAID}<a class=ad href=x>Ad <b>bold</b></a> rest</article>", f"{SAID} rest"),
        (f'<article><p title="it\'s>{SAID}</p><p>More text.</p>', f"{SAID}\nMore text."),
        (f'<p title="it\'s>{SAID}</p><p>More "text" here, and {SAID}</p>', f'{SAID}\nMore "text" here, and {SAID}'),
        (f"<article><p title='a > b' class=\"x\">{SAID}</p></article>", SAID),
        (f"<p>{SAID} <i>in</i> <span class=ad><span class=ad>x</span> y</span> end of it, with a few more words.</p>", f"{SAID} in end of it, with a few more words."),
    ],
)
def test_inline_parts_and_broken_quotes(page, text):
    assert html_extract.main_text(page) == text


def test_the_cut_decides_where_blocks_alone_do_not():
    """Pages of plain divs: short lines amid prose are content, short lines amid links are not, whatever each says alone."""
    import random

    r = random.Random(3)
    changed = blocks = right = alone = 0
    for _ in range(60):
        short = lambda: " ".join(r.choices(["note", "see", "part", "one", "list"], k=r.randint(1, 3)))
        body = [(f"<p>{SAID} {k}.</p>" if r.random() < 0.7 else f"<p>{short()}</p>", True) for k in range(8)]
        body[0] = body[-1] = (f"<p>{SAID}</p>", True)
        menu = [(f"<li><a href=x>{short()}</a></li>" if r.random() < 0.7 else f"<li>{short()}.</li>", False) for _ in range(8)]
        page = "<div><ul>" + "".join(x for x, _ in menu) + "</ul></div><div>" + "".join(x for x, _ in body) + "</div>"
        found, tree = html_extract.blocks(page)
        want = [k for _, k in menu + body]
        assert len(found) == len(want)
        cut = html_extract.content(found, tree)
        own = [html_extract.odds_of_content(b) > 0 for b in found]
        blocks += len(want)
        changed += sum(a != b for a, b in zip(cut, own, strict=True))
        right += sum(a == b for a, b in zip(cut, want, strict=True))
        alone += sum(a == b for a, b in zip(own, want, strict=True))
    assert changed > 0.05 * blocks and right > alone and right > 0.97 * blocks, (changed, right, alone, blocks)


PROSE = f"<p>{SAID}</p>" * 3


@pytest.mark.parametrize(
    "part",
    [
        f'<section id="discussion"><h2>Discussion</h2><p>{SAID} A.</p><p>{SAID} B.</p></section>',
        f'<section class="related work"><h2>Related work</h2><p>{SAID} C.</p></section>',
        f'<p class="legal">{SAID} D.</p>',
        f'<div class="notice"><p>{SAID} E.</p></div>',
        f'<section id="login"><h3>Login</h3><p>{SAID} F.</p></section>',
        f'<div class="share-of-voice search"><p>{SAID} G.</p></div>',
        '<ul><li><a href="x">First source</a></li><li><a href="y">Second source</a></li></ul>',
        '<ol class="references"><li><a href="x">A paper</a></li><li><a href="y">A book</a></li><li><a href="z">A talk</a></li></ol>',
    ],
)
def test_sections_of_an_article_stay(part):
    """What an article's own section or paragraph says stays, whatever the page calls it."""
    want = [t for x in part.split("<")[1:] if (t := x.split(">", 1)[1].strip())]
    got = main_text(f"<nav><a href=a>Home</a></nav><article><h1>Head</h1>{PROSE}{part}{PROSE}</article><footer>Imprint</footer>").split("\n")
    assert got == ["Head", *[SAID] * 3, *want, *[SAID] * 3]


@pytest.mark.parametrize(
    "part",
    [
        '<div class="related"><a href=x>Other story</a> <a href=y>One more story</a></div>',
        '<div class="share"><a href=x>Mail</a><a href=y>Link</a></div>',
        f'<section id="comments"><h2>Comments</h2><p>{SAID}</p></section>',
        "<div class='discussion'>" + "".join(f"<div class='post'><b>Reader {k}</b><p>{SAID}</p></div>" for k in range(4)) + "</div>",
        f'<div class="sponsored"><p>{SAID}</p></div>',
        '<div class="newsletter"><p>Get our letter every day, it costs nothing.</p></div>',
    ],
)
def test_other_parts_inside_an_article_go(part):
    assert main_text(f"<article><h1>Head</h1>{PROSE}{part}{PROSE}</article>").split("\n") == ["Head", *[SAID] * 6]


def test_unended_elements_take_linear_time():
    import time

    began = time.time()
    for name in ("noscript", "iframe", "template", "object"):
        assert main_text(f"<article><p>{SAID}</p>" + f"<{name}>" * 20_000 + f"<p>{SAID} End.</p></article>") == f"{SAID}\n{SAID} End."
    assert time.time() - began < 4


def test_the_cut_decides_amid_names_too():
    """Prose pages whose sections have names of other parts: the cut changes what blocks alone say, and gets more right."""
    import random

    r = random.Random(8)
    changed = blocks = right = alone = 0
    for _ in range(60):
        rows = [("<h1>Head</h1>", True)]
        for k in range(6):
            name = r.choice(["discussion", "related work", "legal", "notice", "menu", ""])
            inner = [f"<h2>Part {k}</h2>", *(f"<p>{SAID} {j}.</p>" if r.random() < 0.6 else f"<p>{r.choice(['See', 'So', 'Then'])} {j}</p>" for j in range(r.randint(2, 4))), f"<p>{SAID}</p>"]
            rows += [(("" if i else f'<section class="{name}">') + x + ("</section>" if i == len(inner) - 1 else ""), True) for i, x in enumerate(inner)]
        side = [(f"<li><a href=x>Story {k}</a></li>" if r.random() < 0.7 else f"<li>Story {k}</li>", False) for k in range(6)]
        page = "<main>" + "".join(x for x, _ in rows) + "</main><div class=related><ul>" + "".join(x for x, _ in side) + "</ul></div>"
        found, tree = html_extract.blocks(page)
        want = [k for _, k in rows + side]
        assert len(found) == len(want)
        cut = html_extract.content(found, tree)
        own = [html_extract.odds_of_content(b) > 0 for b in found]
        blocks += len(want)
        changed += sum(a != b for a, b in zip(cut, own, strict=True))
        right += sum(a == b for a, b in zip(cut, want, strict=True))
        alone += sum(a == b for a, b in zip(own, want, strict=True))
    assert changed > 0.005 * blocks and right > alone and right > 0.97 * blocks, (changed, right, alone, blocks)
