"""Operator 7 keeps main text outside an article and in wrappers whose class names a sidebar or header."""

from granary.llm import html

STORY = "The harbour froze early that winter and the ferries stayed tied up for weeks"


def test_teaser_and_wrappers(spark):
    menu = "Home News Sport Weather Travel Money Culture Shop Contact About"
    teaser = [f"{STORY} in town {w}" for w in ("alpha", "beta", "gamma")]
    rows = [(i, f"https://t.example/{i}", f"<body><div>{menu}</div><div><p>{i} n{i}a n{i}b n{i}c {i * 7}</p></div><article><p>Teaser {i}</p></article></body>") for i in range(4)]
    rows += [
        (10, "https://w.example/1", f"<body><div class='layout has-sidebar'><nav>menu</nav><article><p>{teaser[0]}</p></article></div></body>"),
        (11, "https://w.example/2", f"<body><div id='page' class='with-header'><p>{teaser[1]}</p></div></body>"),
        (12, "https://w.example/3", f"<body><div class='sidebar'><div class='header'><main>{teaser[2]}</main></div></div></body>"),
        (13, "https://v.example/4", f"<body><form><div class='header'>{STORY}</div></form></body>"),
        (14, "https://v.example/5", "<body><aside><article>teaser</article></aside><article>whole story</article><div class='sidebar'>side</div></body>"),
    ]
    got = {r["page_id"]: r["text"] for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"{i} n{i}a n{i}b n{i}c {i * 7}\nTeaser {i}" for i in range(4))
    assert [got[10 + i] for i in range(3)] == teaser and got[13] == STORY and got[14] == "whole story"


def text(page):
    return "\n".join(html.blocks(page)[0])


MANY = "".join(f"<p>Reader {i} has something long to say about the matter at hand, again and again {i}</p>" for i in range(30))


def test_longer_than_the_article():
    """What is dropped is dropped however long it is, inside and outside an article."""
    article = f"<article><h1>Short</h1><p>{STORY}</p></article>"
    for head, tail in [
        ('<div class="comments">', "</div>"), ('<div class="sidebar">', "</div>"), ('<div id="cookie-banner">', "</div>"), ("<form>", "</form>"), ('<ul class="menu">', "</ul>"),
        ('<div class="user-comments">', "</div>"), ('<section id="comments_list">', "</section>"), ('<div class="ad-box">', "</div>"), ('<div class="left-sidebar">', "</div>"), ('<aside>', "</aside>"),
        ('<div class="newsletter-signup newsletter-box">', "</div>"), ('<div role="navigation">', "</div>"),
    ]:
        assert text(f"<body>{article}{head}{MANY}{tail}</body>") == f"Short\n{STORY}", head
        assert text(f"<body>{head}{MANY}{tail}{article}</body>") == f"Short\n{STORY}", head
    inner = f'<article><p>{STORY}</p><section class="comments">{MANY}</section><div class="share-buttons">{MANY}</div><p>end</p></article>'
    assert text(inner) == f"{STORY}\nend"
    assert text(f'<div class="story"><p>{STORY}</p></div><div class="comments">{MANY}</div><div class="sidebar">{MANY}</div>') == STORY


def test_cards():
    article = f"<article><p>{STORY}</p></article>"
    assert text(f'{article}<div class="related"><article>Other story teaser</article></div>') == STORY
    assert text(f'{article}<div class="sidebar"><article class="ad">Buy now cheap</article></div>') == STORY
    assert text(f'<article class="promo">Buy now</article>{article}<article class="comment">Nice {MANY}</article>') == STORY
    # wrappers of pages stay, whatever they are called
    assert text(f'<div class="sidebar-layout has-sidebar with-header"><nav>n</nav>{article}<div class="ad">x</div></div>') == STORY
    assert text(f'<div class="header"><div class="sidebar">{article}</div></div><div class="related"><article>teaser</article></div>') == STORY
    assert text(f'<form id="aspnetForm"><nav>n</nav><div id="story">{STORY}</div></form>') == STORY
    assert text(f'<article class="sidebar">{STORY}</article><p class="ad">x</p>') == STORY
    assert text('<div class="ad">only adverts</div>') == "" and text(f'<div class="comments">{MANY}</div>') == ""


def test_state_names():
    for name in ("has-sidebar", "with-header", "no-comments", "is-menu", "advance", "shadow", "commentary", "leaderboard", "socialism", "header-image-text"):
        assert text(f'<div class="{name}">{STORY}</div>') == STORY
