"""Operator 7: repeated substrings over a host's pages against a plain search, and leniently read tags."""

import random
from collections import defaultdict

from granary.llm import html

SCHEMA = "page_id long, url string, html string, text string"


def pages():
    rng = random.Random(8)
    vocab = [f"t{i}" for i in range(400)]
    bars = [" ".join(rng.choices(vocab, k=k)) for k in (12, 30, 9, 7)]
    rows = []
    for i in range(60):
        host = "big.example" if i % 3 else f"h{i % 2}.example"
        body = [rng.choice(bars), " ".join(rng.choices(vocab, k=rng.randrange(1, 60))), rng.choice(bars)]
        if i % 5 == 0:
            body[1] = f"<article><p>{bars[0]} {body[1]}</p></article>"
        rows.append((i, f"https://{host}/{i}", "<body>" + "".join(f"<div>{b}</div>" for b in body) + "</body>", "x"))
    rows += [(100 + i, "https://s.example/a", f"<div>few words {i // 3}</div>", None) for i in range(6)]  # short pages; 0-2 and 3-5 are equal
    rows += [(110 + i, "https://s.example/b", f"<div>same short text</div><!-- {i} -->", None) for i in range(4)]
    rows += [(120, "https://q.example/", rows[1][2], None), (120, "https://q.example/", rows[1][2], None), (121, None, None, None), (122, "bad://[", "", None)]
    return rows


def plain(rows):
    read, where = {}, defaultdict(set)
    for r in rows:
        text, inside = html.blocks(r[2] or "")
        tokens = [t for b, i in zip(text, inside) if not i for t in b.split()]
        read[r[:3]] = (text, inside, tokens)
        n = len(tokens)
        for a in range(n - html.RUN + 1) if n >= html.RUN else [0] * bool(n):
            where[html._host(r[1]), n < html.RUN, tuple(tokens[a : a + html.RUN])].add(r[2])
    out = {}
    for key, (text, inside, tokens) in read.items():
        gone, n = set(), len(tokens)
        for a in range(n - html.RUN + 1) if n >= html.RUN else [0] * bool(n):
            if len(where[html._host(key[1]), n < html.RUN, tuple(tokens[a : a + html.RUN])]) >= html.MIN_PAGES:
                gone.update(range(a, a + html.RUN))
        k, kept = 0, []
        for b, i in zip(text, inside):
            ts = b.split()
            left = ts if i else [t for j, t in enumerate(ts, k) if j not in gone]
            k += 0 if i else len(ts)
            kept += [" ".join(left)] if left else []
        out[key] = "\n".join(kept)
    return out


def test_against_a_plain_search(spark):
    rows = pages()
    want = plain(rows)
    got = html.main_text(spark.createDataFrame(rows, SCHEMA))
    assert got.columns == ["page_id", "url", "text"]
    assert sorted(map(str, got.collect())) == sorted(str(g) for g in spark.createDataFrame([(r[0], r[1], want[r[:3]]) for r in rows], "page_id long, url string, text string").collect())
    assert sum(len(t) for t in want.values()) < 0.8 * sum(len(" ".join(html.blocks(r[2] or "")[0])) for r in rows)
    assert all(want[r[:3]] == "" for r in rows if r[0] >= 110 and r[0] < 114) and all(want[r[:3]] for r in rows if 100 <= r[0] < 106)
    assert html.main_text(spark.createDataFrame([], SCHEMA)).count() == 0


def text(page):
    return "\n".join(html.blocks(page)[0])


def test_lenient_tags():
    story = "a long story of the harbour and its ships in winter and spring"
    assert text("<p title=don't>Hello</p>") == "Hello"
    assert text(f"<article><div class='post menu-open'><p>{story}</p></div></article>") == story
    assert text(f"<article><p>{story}</p><div class='share'>Tweet</article><p>after</p>") == f"{story}\nafter"
    assert text(f"<article><div class='share'>Tweet<p>{story}</p></article>") == f"Tweet\n{story}"
    assert text(f"<article><p>Use <select> box</p><p>{story}</p></article>") == f"Use\n{story}"
    assert text(f"<header>site</header><article><header><h1>Title</h1></header><p>{story}</p><footer>by x</footer></article>") == f"Title\n{story}"
    assert text(f"<head><title>t</title><body><p class=\"a>b\">{story}<p>x &lt; y &amp;amp; z<br>w") == f"{story}\nx < y &amp; z\nw"
    assert text(f"<ul><li class=menu>one<li>two</ul><p>{story}</p>") == f"one\ntwo\n{story}"
    assert text(f"<ul><li class=ad>one<li>two</ul><p>{story}</p>") == f"two\n{story}"
    assert text("<script>if (a < b) '</p>'</script><style>x<y</style>t<!-- c > d --> u") == "t u"
    assert text(f"<main>{story}</main><aside>x</aside><p>{story} y</p>") == f"{story}\n{story} y"


def test_long_page(spark):
    page = "<body><article>" + "<p>word and word</p>" * 50_000 + "</article></body>"
    got = html.main_text(spark.createDataFrame([(1, "u", page, None)], SCHEMA)).first()
    assert got["text"] == "\n".join(["word and word"] * 50_000)
