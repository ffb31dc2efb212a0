import random
import re
import time

import public_tokenizers
import pytest
import tiktoken

from tessera.llm import html_text as ht
from tessera.llm import token_counts as tc

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")

PAGES = [
    ("<html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body><nav><ul><li><a href=/a>Home</a></li></ul></nav><!-- ad <p>x</p> -->"
     "<div class=\"ad\">Buy this now.</div><article><h1>The headline</h1><p><b>First &amp; second,<br>third\n  &eacute;&#x4e2d;&nbsp;x.<br><p>Short.</p>"
     "<form><p>Your name</p><input></form><p>Read <a href=/b>this &lt;link&gt;</a> too.</p><section class=\"comments\"><p>Nice article, thank you very much for it!</p></section></article>"
     "<aside>Other things to read, many of them</aside><footer>&copy; someone</footer></body></html>",
     "The headline\n\nFirst & second, third é中 x.\n\nShort.\n\nRead this <link> too."),
    ("<body><nav>menu</nav><article><p>Cut off in the mid", "Cut off in the mid"),
    ("<body><article><p>One</p><p>Two &am", "One\n\nTwo &am"),
    ("<article><p>Tag cut off</p><p", "Tag cut off"),
    ("<article><p>a < b and c > d</p><p title='x > y'>e</p></article>", "a < b and c > d\n\ne"),
    ("<main><SCRIPT>if (a<b) {}</SCRIPT ><P>Upper</P><![CDATA[raw]]></main>", "Upper\n\nraw"),
    ("<article><p>open comment</p><!-- <p>never closed</p>", "open comment"),
    ("<nav>only a menu</nav>", ""), ("", ""), (None, ""), ("no markup but a few words of plain text here", "no markup but a few words of plain text here"),
]


@pytest.mark.parametrize("page, want", PAGES)
def test_pages(page, want):
    assert ht.main_text(page, ht.tree_of()) == want


TEXT = " ".join(["word"] * 40)


@pytest.mark.parametrize("page, want", [
    (f"<body><article><p>{TEXT}</p><button>Share<p>{TEXT}</p></article><p>{TEXT}</p></body>", 3 * 40),
    (f"<body><article><p>{TEXT}<select><option>word</article><div><p>{TEXT}</p></div></body>", 2 * 40 + 1),
    (f"<body><article><p>{TEXT}</p><form><p>Your name</p></article><div><p>{TEXT}</p></div></body>", 2 * 40),
    (f"<body><form id=aspnetForm><nav>Home</nav><div><p>{TEXT}</p><p>{TEXT}</p></div><footer>End</footer></form></body>", 2 * 40),
    (f"<body><form><nav>Home</nav><article><p>word</p></article></form></body>", 1),
    (f"<body><article><p>{TEXT}</p><form><p>word word</p><button>word</button></form></article></body>", 40),
    (f"<body><article><p>{TEXT}</p><dialog><div><p>{TEXT}</p></div></dialog><p>{TEXT}</p></article></body>", 80),
])
def test_forms_and_unclosed_controls(page, want):
    assert ht.main_text(page, ht.tree_of()).split().count("word") == want


@pytest.mark.parametrize("page, want", [
    (f"<body><div class='content-sidebar-wrap'><article><p>{TEXT}</p></article></div></body>", 40),
    (f"<body><div id=content class='has-sidebar'><p>{TEXT}</p></div></body>", 40),
    (f"<body><article class='post comments-open'><div class='entry-header'><h1>word</h1></div><p>{TEXT}</p></article></body>", 41),
    (f"<body><main class='no-sidebar'><p>{TEXT}</p></main></body>", 40),
    (f"<body><div class=sidebar><article><p>{TEXT}</p></article></div></body>", 40),
    (f"<body><article><p>{TEXT}</p><div class='comments-area'><article class=comment><p>{TEXT}</p></article></div></article></body>", 40),
    (f"<body><article><p>{TEXT}</p></article><aside><article><p>{TEXT}</p></article></aside><div class='site-footer'><p>{TEXT}</p></div></body>", 40),
])
def test_hints_are_whole_names(page, want):
    assert ht.main_text(page, ht.tree_of()).split().count("word") == want


def test_pages_table(spark):
    rows = [(i, f"u{i}", p) for i, (p, _) in enumerate(PAGES)] + [(None, None, PAGES[0][0]), (0, "u0", PAGES[0][0])]
    from pyspark.sql import functions as F
    table = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("n_chars", F.lit("clash"))
    got = sorted((tuple(r) for r in ht.extracted(table.repartition(2)).collect()), key=str)
    want = [(i, f"u{i}", w, len(w)) for i, (_, w) in enumerate(PAGES)]
    want += [(None, None, PAGES[0][1], len(PAGES[0][1])), (0, "u0", PAGES[0][1], len(PAGES[0][1]))]
    assert got == sorted(want, key=str)
    assert ht.extracted(table.limit(0)).collect() == []


def test_very_long_pages_take_linear_time():
    for page in ("<p>word " * 40_000, "<a \"" * 20_000, "<!-- " * 20_000, "<script>" * 20_000, "<div class='x'>" * 5_000, "&" * 100_000, "<" * 100_000):
        ht.main_text(page, ht.tree_of())


def test_tree_uses_neighbours_and_links():
    a = "<div><p>%s</p><p>%s</p></div>" % ("word " * 40, "word " * 50)
    links = "<p>" + "<a href=x>word word</a> " * 20 + "</p>"
    assert "\n\n" in ht.main_text(a, ht.tree_of())
    assert ht.main_text(f"<body>{a}{links}{links}</body>", ht.tree_of()).count("word") == 90

T = " ".join(["word"] * 40)
LINK = "<a href=/x>link link</a>"


@pytest.mark.parametrize("page, want", [
    (f"<p><a name='top'>Lead word</p><p>{T}</p><p>word</p>", 42),
    (f"<body><p>{T} <a href=/b>word</p><p>{T}</p><p>word</p><p>{T}</p></body>", 122),
    (f"<body><a href=/x><div><p>{LINK}</p></div></a><p>{T}</p></body>", 40),
    ("<p>Short word.</p>", 1),
    (f"<div><h1>A word</h1></div><div>{T}</div><div>Hi word.</div><div>{T}</div><div>word</div>", 83),
    (f'<article><img alt="x <i>leak</i> word"><p>{T}</p></article>', 40),
    ('<article data-x="a <b> c > d"><p>word</p></article>', 1),
    ("<article><p title='a=\"b > c'>word</p><p title=\"never closed>word</p><p class='y'>word</p></article>", 3),
    (f"<body><ul><li class=ad>{T}<li>{T}</ul><table><tr><td class=sidebar>{T}<td>{T}</table></body>", 80),
    (f"<body><p class='ad'>{T}<p>{T}<p hidden>{T}</p><div style='display:none'>{T}</div></body>", 40),
    (f"<article><p>{T}</p><noscript><p>{T}</p><svg></article>", 80),
])
def test_scanner(page, want):
    assert ht.main_text(page, ht.tree_of()).replace(".", "").split().count("word") == want


@pytest.mark.parametrize("hint", ["class=topbar", "class=alert", "class=paywall", "class=discussion", "class='user-reviews'", "class='comment-body'", "id=disqus_thread",
                                  "class='ad-slot-container'", "id='ad-slot-12'", "role=complementary", "role=contentinfo", "role=alert", "role=search", "class='cookie-content'"])
def test_furniture_names(hint):
    page = f"<body><div {hint}><p>{T}</p></div><div class='article-body'><p>{T}</p></div></body>"
    assert ht.main_text(page, ht.tree_of()).split().count("word") == 40


def used(tree):
    return set() if isinstance(tree, bool) else {ht.FEATURES[tree[0]]} | used(tree[2]) | used(tree[3])


def held_out():
    """Pages of plain div and p elements that are not in the labelled table: blocks, labels."""
    rng, out = random.Random(11), []
    for _ in range(200):
        blocks = [f"-{n}/{n}" for n in (rng.randint(1, 3) for _ in range(rng.randint(2, 8)))]
        blocks += [f"+{rng.randint(3, 12)}h"] * rng.randint(0, 1) + [f"+{rng.randint(26, 120)}"]
        for _ in range(rng.randint(1, 8)):
            n = rng.choice([rng.randint(1, 10), rng.randint(20, 140)])
            blocks.append(f"+{n}/{rng.randint(0, n // 8)}")
        blocks.append(f"+{rng.randint(26, 90)}")
        blocks += [f"-{rng.randint(1, 4)}h"] * rng.randint(0, 1) + [f"-{n}/{n}" for n in (rng.randint(2, 12) for _ in range(rng.randint(2, 6)))]
        out.append(ht.labelled_blocks(" ".join(blocks)))
    return out


def test_neighbours_decide():
    tree = ht.tree_of()
    assert {"words", "links", "words after", "links before", "links after"} <= used(tree)
    blind = ht.tree_of([re.sub(r"[bf]", "", page) for page in ht.LABELLED if not re.search("[bf]", page)])  # never saw a place
    pages = held_out()
    for t, least in ((tree, 0.97), (blind, 0.95)):
        right = [ht.decide(t, x) == label for blocks, labels in pages for x, label in zip(ht.features(blocks), labels)]
        assert sum(right) / len(right) >= least
    # whole pages: from markup to text
    page = f"<body><div>{LINK}</div><div>{LINK}</div><h2>A word</h2><p>{T}</p><p>word</p><p>{T}</p><h3>More</h3><div>{LINK}</div><div>{LINK}</div><div>Made by us</div></body>"
    assert ht.main_text(page, tree) == f"A word\n\n{T}\n\nword\n\n{T}"
    assert ht.main_text(page, blind) == f"A word\n\n{T}\n\nword\n\n{T}"


def test_unmatched_tags_take_linear_time():
    start = time.time()
    for page in ("<div>" * 20_000 + "</section>" * 20_000, "<a x=\"" * 20_000, "<a x=\">" * 20_000, "<noscript>x" * 20_000, "<button>" * 20_000,
                 "<a href=x>" * 20_000, "<li>x" * 20_000, "<a " + "= " * 50_000, "<td " + "x='" * 50_000):
        ht.main_text(page, ht.tree_of())
    assert time.time() - start < 20


def slow_sections(text, encoding):
    """Each token's first byte decides; spans in code points."""
    lines = text.splitlines(keepends=True) if "\n" in text else [text]
    lines = [x + "\n" for x in text.split("\n")[:-1]] + ([text.split("\n")[-1]] if not text.endswith("\n") or not text else [])
    out, byte, char = [], 0, 0
    for line in lines:
        n = len(line.encode())
        out.append([char, char + len(line), 0, 0, byte, byte + n])
        byte, char = byte + n, char + len(line)
    at = 0
    for token in encoding.encode_ordinary(text):
        size = len(encoding.decode_single_token_bytes(token))
        row = next(r for r in out if r[4] <= at < r[5])
        row[2] += 1
        row[3] += at + size > row[5]
        at += size
    return [tuple(r[:4]) for r in out]


def test_token_counts(spark, corpus, docs, clashing, empty):
    encoder = tc.Encoder(RANKS, public_tokenizers.PATTERN)
    texts = ["a\n\n\nb", "é漢\n😀😀\n", "\n", " \n \n x", "one line", "x\n" * 300] + [r[1] or "" for r in corpus if len(r[1] or "") < 3000]
    crossing = 0
    for text in texts:
        got = [tuple(int(x) for x in r) for r in zip(*tc.sections(text, encoder))]
        assert got == slow_sections(text, encoder.encoding)
        crossing += sum(r[3] for r in got)
    assert crossing > 0
    rows = tc.counted(docs, RANKS, public_tokenizers.PATTERN).collect()
    total = {}
    for r in rows:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.n_tokens
    want = {}
    for r in corpus:
        want[r[0]] = want.get(r[0], 0) + len(encoder.encoding.encode_ordinary(r[1] or ""))
    assert total == want
    assert tc.counted(clashing, RANKS, public_tokenizers.PATTERN).count() == len(rows)
    assert tc.counted(empty, RANKS, public_tokenizers.PATTERN).collect() == []


def test_very_long_runs():
    encoder = tc.Encoder(RANKS, public_tokenizers.PATTERN)
    for text in ("a" * 100_000, " " * 100_000, "\n" * 50_000):
        assert tc.sections(text, encoder)[2].sum() == len(encoder.encoding.encode_ordinary(text))
