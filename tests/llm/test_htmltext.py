from __future__ import annotations

import random
import time

from tessera.llm import htmltext
from tessera.llm.htmltext import Block, _aligned, blocks, extract, main_text, shared_blocks


def text(page):
    return main_text(blocks(page), [])


def test_article_without_what_is_around():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var x="</p><p>no";</script></head><body>
    <header>Site</header><nav><ul><li><a>Home</a></li></ul></nav><div class="cookie-notice">Cookies</div><main><article><h1>One&amp;two</h1>
    <header>By me</header><p>First <b>bold</b>
    word<br>next<p>Second &lt;tag&gt;<div class="ad">Buy</div><form><input><button>Go</button></form><table><tr><td>a<td>b</table></article>
    <aside>Related</aside><section id="comments"><p>Nice!</p></section></main><!-- <p>gone --><footer>&copy; me</footer>"""
    assert text(page) == "One&two By me First bold word next Second <tag> a b"


def test_broken_pages():
    assert text("") == ""
    assert text("a < b and <") == "a < b and <"
    assert text("<p>one<script>never closed <p>two") == "one"
    assert text("</div></p>x<p class='unclosed>y</p>z") in ("x y z", "x z", "x")
    assert text("<div class=ad>ad<p>in ad</div>out") == "out"
    assert text("&#65;&nbsp;&eacute;&bogus;") == "A é&bogus;"


def test_teasers_do_not_stand_for_the_article():
    assert text("<main><p>" + "long text " * 20 + "</p><article>teaser</article></main>").startswith("long text")


def test_differencing_decides_beside_articles():
    body = "own words of the page " * 9
    page = lambda body: blocks(f"<div>Top bar</div><div><p>{body}</p></div><article>teaser</article><div>Bottom line</div>")
    assert main_text(page(body), [page("others " * 20)]) == f"{body.strip()} teaser"
    assert main_text(page(body), []) == f"Top bar {body.strip()} teaser Bottom line"
    assert text(f"<main><article>{'a' * 40}</article><p>{'b' * 60}</p></main>") == "a" * 40 + " " + "b" * 60
    framed = lambda t: blocks(f"<div>{'menu ' * 30}</div><div>{t[:3]}</div><article>{t}</article>")
    assert main_text(framed("mine " * 9), [framed("other " * 9)]) == ("mine " * 9).strip()


def test_marks_do_not_drop_the_page():
    body = "<p>" + "own words " * 20 + "</p>"
    want = ("own words " * 20).strip()
    for start, end in (
        ("<article class='post no-sidebar'>", "</article>"), ("<article class='category-social comments-open'>", "</article>"), ("<div class='layout has-sidebar'><article>", "</article></div>"),
        ("<div class='layout has-sidebar'>", "</div>"), ("<form id=aspnetForm><div>", "</div></form>"), ("<div id='page-widget'>", "</div>"), ("<div class=social><main>", "</main></div>"),
        ("<article class='related'>", "</article>"), ("<form><article class='post paywall'>", "</article></form>"),
    ):
        assert text(f"<nav>Home</nav>{start}{body}<div class='sidebar'>Other</div>{end}<div class=ad>Buy</div>") == want, start
    listed = "".join(f"<li class='post-social'><article class='post tag-sponsored'><p>{i} words</p></article></li>" for i in "abc")
    assert text(f"<ul>{listed}</ul>") == "a words b words c words"
    aside = "<div class=related><article>teaser</article></div><div id=comments><article class=comment-body>Nice!</article></div>"
    assert text(f"<article>{body}</article>{aside}") == want
    assert text(f"<form>U<span class='x-widget'>S</span>A {want}</form>") == f"U A {want}" and text("<b id='x-widget'>U</b>SA") == "SA"
    assert text("<p>a<b class='my-banner'>bcdef</b>g</p>") == "abcdefg"


def test_longest_common_subsequence():
    def table(a, b):
        rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a, 1):
            for j, y in enumerate(b, 1):
                rows[i][j] = rows[i - 1][j - 1] + 1 if x == y else max(rows[i - 1][j], rows[i][j - 1])
        return rows[-1][-1]

    import random

    rng = random.Random(2)
    for _ in range(300):
        a, b = [[rng.choice("abcd") for _ in range(rng.randint(0, 9))] for _ in range(2)]
        x, y = shared_blocks(a, b)
        assert len(x) == len(y) == table(a, b) and [a[i] for i in sorted(x)] == [b[j] for j in sorted(y)]


def test_templates_go_and_copies_stay():
    page = lambda *t: [Block(x, 0) for x in t]
    assert main_text(page("menu", "own words", "imprint"), [page("menu", "others", "imprint")]) == "own words"
    assert main_text(page("menu", "own"), [page("menu", "own")]) == "menu own"
    assert main_text([Block("menu", 0), Block("quoted", 2)], [page("menu", "quoted")]) == "quoted"


def test_rows(spark):
    rows = [(i, f"http://h.example/a{i:04d}", f"<div>Top bar</div><p>Page {i} text</p><div>Bottom line</div>", "x") for i in range(60)]
    rows += [(100, None, None, "x"), (101, "http://one.example/", "<p>alone</p>", "x"), (5, "http://h.example/a0005?q=1", "<p>version</p>", "x"), (None, "", "", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string").repartition(5)
    got = {(r["page_id"], r["url"]): r["text"] for r in extract(df).collect()}
    assert len(got) == len(rows)
    assert all(got[i, f"http://h.example/a{i:04d}"] == f"Page {i} text" for i in range(60) if i not in (4, 5, 6))
    assert got[100, None] == "" and got[101, "http://one.example/"] == "alone" and got[None, ""] == ""
    assert extract(df.limit(0)).count() == 0
    few = extract(df.coalesce(1)).collect()
    assert {(r["page_id"], r["url"]): r["text"] for r in few} == got
    assert all(r["n_chars"] == len(r["text"]) for r in few)


def test_pages_of_one_path_pair_with_the_paths_beside_it(spark):
    page = lambda t: f"<div>Top bar</div><p>{t}</p><div>Bottom line</div>"
    rows = [(i, f"http://h.example/{p}", page(f"{p} text")) for i, p in enumerate("abde")]
    rows += [(100 + i, f"http://h.example/c?v={i}", page(f"version {i}")) for i in range(40)]
    rows += [(200 + i, f"http://h.example/f?v={i}", page("copy of one")) for i in range(30)]
    rows += [(300 + i, f"http://other.example/c?v={i}", page("alone")) for i in range(30)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for parts in (1, 7):
        got = {r["page_id"]: r["text"] for r in extract(df.repartition(parts)).collect()}
        assert len(got) == len(rows)
        assert [got[i] for i in range(4)] == [f"{p} text" for p in "abde"]
        assert all(got[100 + i] == f"version {i}" for i in range(40)) and all(got[200 + i] == "copy of one" for i in range(30))
        assert all(got[300 + i] == "Top bar alone Bottom line" for i in range(30))


def test_class_words_do_not_drop_parts_of_an_article():
    assert text('<article><p>Text</p><p class="related-work">Related work section of the paper</p><div class="share-price">ACME rose 3 %</div></article>') == "Text Related work section of the paper ACME rose 3 %"
    assert text('<article><p>Text of it</p><div class="ad-slot">Buy</div><div class="share-buttons">Tell</div></article>') == "Text of it"
    assert text("<main><p>" + "lead " * 9 + "</p><article>" + "second part " * 20 + "</article></main>").startswith("lead lead")


def test_a_shared_menu_goes_whatever_is_left():
    page = lambda t: blocks(f"<div>{'menu ' * 50}</div><p>{t}</p>")
    assert main_text(page("a"), [page("b")]) == "a"


def test_alignments_in_parts(monkeypatch):
    rng = random.Random(4)
    cases = [([rng.choice("abcd") for _ in range(rng.randint(0, 30))], [rng.choice("abcd") for _ in range(rng.randint(0, 30))]) for _ in range(200)]
    whole = [len(_aligned(a, b)) for a, b in cases]
    monkeypatch.setattr(htmltext, "TABLE", 20)
    for (a, b), size in zip(cases, whole, strict=True):
        pairs = _aligned(a, b)
        assert len(pairs) == size and all(a[i] == b[j] for i, j in pairs) and all(x < y and u < v for (x, u), (y, v) in zip(pairs, pairs[1:], strict=False))


def test_long_pages_end():
    lines = [f"line {i}" for i in range(20_000)]
    for page, near in (("<span>" * 40_000 + "</i>" * 40_000 + "x", []), ("<span>" * 30_000 + "<p>a</p>" * 30_000, []), ("<b><div>" * 30_000 + "x", [])):
        began = time.time()
        main_text(blocks(page), near)
        assert time.time() - began < 5
    for own, other in ((lines, lines[::-1]), (["a", "b"] * 10_000, ["b", "c", "a"] * 7_000)):
        began = time.time()
        shared_blocks(own, other)
        assert time.time() - began < 10


def naive(sites):
    """(key, url) to text, blocks that neighbours share and marked ones, by the definition: sites are (key, url, host, path, [(text, kind)])."""
    order = sorted(sites, key=lambda s: (s[2], s[3], s[0]))

    def common(a, b):
        rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a, 1):
            for j, y in enumerate(b, 1):
                rows[i][j] = rows[i - 1][j - 1] + 1 if x == y else max(rows[i - 1][j], rows[i][j - 1])
        return rows[-1][-1]

    out = {}
    for n, (key, url, host, path, parts) in enumerate(order):
        near = [next((o for o in side if o[3] != path), None) for side in (order[:n][::-1], order[n + 1 :])]
        near = [[t for t, _ in o[4]] for o in near if o and o[2] == host]
        texts, gone = [t for t, _ in parts], set()
        for other in near:
            whole = common(texts, other)
            # lines are distinct within a page here, so a line is in the subsequence if leaving it out shortens it
            shared = {i for i in range(len(texts)) if common(texts[:i] + texts[i + 1 :], other) < whole}
            if any(k != "nav" and i not in shared for i, (_, k) in enumerate(parts)):
                gone |= {i for i in shared if parts[i][1] != "article"}
        left = [p for i, p in enumerate(parts) if p[1] != "nav" and i not in gone]
        inside = [t for t, k in left if k == "article"]
        text = " ".join(inside if sum(map(len, inside)) > 0.5 * sum(len(t) for t, _ in left) else [t for t, _ in left])
        out[key, url] = text, len(gone), sum(k == "nav" and i not in gone for i, (_, k) in enumerate(parts))
    return out


def test_random_sites_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(htmltext, "RANGE_BYTES", 2000)
    rng = random.Random(6)
    sites, rows = [], []
    for h in range(5):
        template = [f"site {h} line {i}" for i in range(6)]
        for k in range(rng.randint(1, 40)):
            path = f"/p{rng.randint(0, 25):02d}"
            own = [(t, rng.choice(["nav", "div"])) for t in template if rng.random() < 0.8]
            at = rng.randint(0, len(own))
            body = rng.choice(["article", "p"])
            own[at:at] = [(f"own {h} {k} words {i} " + "more " * rng.randint(0, 3) + "end", body) for i in range(rng.randint(0, 4))]
            if rng.random() < 0.2 and all(t != "quoted by many" for t, _ in own):
                own.append(("quoted by many", "article"))
            url = f"http://h{h}.example{path}?v={k}"
            sites.append((100 * h + k, url, f"h{h}.example", path, own))
            rows.append((100 * h + k, url, "<body>" + "".join(f"<{e}>{t}</{e}>" for t, e in own)))
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    want = naive(sites)
    got = {(r["page_id"], r["url"]): (r["text"], r["n_shared"], r["n_marked"]) for r in extract(df).collect()}
    assert got == want
    assert sum(v[1] > 0 for v in want.values()) > 20


def test_differencing_decides_on_given_pages(spark, folder):
    got = htmltext.op5_page_differencing(spark, folder.replace("sf0.001", "sf0.01")).collect()
    assert sum(r["n_shared"] > 0 for r in got) > 0
