"""Main text of pages: what templates share goes, what articles share stays."""

import random

import pytest

from sievework.llm.pagetext import AROUND, BLOCK, aligned, main_texts, page_lines
from tests.llm.cases import PROSE

SCHEMA = "page_id long, url string, html string"


def texts(spark, rows):
    out = main_texts(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    assert all(r.n_chars == len(r.text) for r in out) and len(out) == len(rows)
    return {(r.page_id, r.url): r.text for r in out}


def lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def test_alignment_is_a_longest_common_subsequence():
    rng = random.Random(2)
    for letters in (2, 4, 9):
        for _ in range(60):
            a, b = ([rng.randrange(letters) for _ in range(rng.randint(0, 40))] for _ in range(2))
            at = aligned(a, b)
            picked, k = [a[i] for i in at], 0
            for y in b:
                k += k < len(picked) and picked[k] == y
            assert k == len(picked) == lcs(a, b) and at == sorted(set(at))
    assert len(aligned([1, 2] * 20_000, [2, 1] * 20_000)) == 39_999


def article(k, rng):
    return [f"Story {k} of {rng.random()}"] + [" ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.randint(3, 30))) for _ in range(rng.randint(1, 5))]


def unnamed(lines):
    body = "".join(f"<div>{x}</div>" for x in lines)
    return f"<body><div>Home</div><div>Products and prices</div><b>My site</b>{body}<div>Terms</div><div>All rights are with My site</div></body>"


def test_pages_without_named_articles_lose_what_neighbours_share(spark):
    rng, rows, want = random.Random(4), [], {}
    n = 2 * BLOCK + 40  # three blocks of ranks
    for k in range(n):
        lines = article(k, rng)
        rows.append((k, f"http://one.example/{k % 7}/{k}", unnamed(lines)))
        want[rows[-1][:2]] = "\n".join(lines)
    for k in range(4):  # another host's template is not compared
        rows.append((1000 + k, f"http://two.example/{k}", "<p>Home<p>Only here " + str(k)))
        want[rows[-1][:2]] = f"Only here {k}"
    assert texts(spark, rows) == want


def test_copies_and_quotations_stay(spark):
    rng = random.Random(6)
    copy, quoted = article(1, rng), " ".join(f"q{i}" for i in range(60))
    rows, want = [], {}
    for k in range(30):
        lines = copy if k in (3, 4, 5, 20) else [*article(k, rng), *([quoted] if k % 3 == 0 else [])]
        named = f"<nav><a>Home</a></nav><article><header><h1>{lines[0]}</h1></header>{''.join(f'<p>{x}</p>' for x in lines[1:])}<p>Thank you for reading.</p></article><div>Elsewhere {k}</div>"
        rows.append((k, f"https://n.example/a/{k:03d}", named))
        want[rows[-1][:2]] = "\n".join(lines)
    got = texts(spark, rows)
    assert got == want
    alone = [(k, f"https://c.example/{k}", unnamed(copy)) for k in range(9)]  # copies alone tell nothing
    assert all("Story 1" in t for t in texts(spark, alone).values())


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<p>a&amp;b &lt;c&gt; &eacute;&#233;&nbsp;d<br>e\n  f</p>", ["a&b <c> éé d e f"]),
        ("<article><h1>T</h1><p><b>one.<br><p>two <i>t</i>hree</article>", ["T", "one.", "two three"]),
        ("<script>var t='</p>';</script><style>p{}</style><p>x<!-- no --><script>y</script>z</p>", ["xz"]),
        ("<header><p>site</p></header><main><header><h1>T</h1></header><p>x</p><aside>s</aside><footer>f</footer></main>", ["T", "x"]),
        ("<form><input><article>x<form><p>y</p></form></article></form><div class=cookie-notice>c</div>", ["x"]),
        ("<div class='hasSidebar'><p>x<div id='sidebarLeft'>y</div></div><p hidden>h<p style='display: none'>n", []),
        ("<article>x<section class=comments><article>c</article></section><p>y <span class='ad'>buy</span> z</article>", ["x", "y z"]),
        ("<div role=navigation>n</div><div aria-hidden=true>h</div>x<table><tr><td>1<td>2</table><ul><li>a<li>b</ul>", ["x", "1", "2", "a", "b"]),
        ("<article>open to the end <b>bold", ["open to the end bold"]),
        ("<![if IE]><p>x<![endif]><![CDATA[no]]><?php no ?></p></nav></div>&copy", ["x", "©"]),
        ("plain < text & more", ["plain < text & more"]),
    ],
)
def test_markup(html, want):
    lines, place, _ = page_lines(html)
    assert [t for t, p in zip(lines, place, strict=True) if p == 0] == want


def test_edge_cases(spark):
    long = "<p>" + "word " * 40_000 + "</p>" + "<p>x</p>" * 3000 + "<b>" * 5000 + "end"
    rows = [(1, None, "<p>x"), (1, None, "<p>x"), (None, "http://h.example/a", None), (2, "http://h.example/a", ""), (3, "", " \n "), (4, "http://h.example/b", long), (5, "no scheme", PROSE)]
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as key", "2 as host", "3 as path", "4 as text", "5 as n_chars", "6 as row", "7 as gone")
    out = sorted((r.page_id or 0, r.text) for r in main_texts(frame).collect())
    assert [t for _, t in out] == ["", "x", "x", "", "", "\n".join(["word " * 39_999 + "word", *["x"] * 3000, "end"]), PROSE]
    assert main_texts(frame.where("false")).isEmpty()
    assert AROUND < BLOCK
