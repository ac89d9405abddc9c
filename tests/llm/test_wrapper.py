"""Tree matching against all matches of small trees; extraction on pages with and without an article element."""

import itertools
import random

from millwright.llm import wrapper as w


def nodes(tree, path=()):
    yield path, tree[0]
    for i, c in enumerate(tree[2]):
        yield from nodes(c, (*path, i))


def brute(a, b):
    """Largest order-preserving match of children lists, by recursion over all subsets of pairs."""
    if a[0] != b[0]:
        return 0
    best = 0
    x, y = a[2], b[2]
    for n in range(min(len(x), len(y)) + 1):
        for p in itertools.combinations(range(len(x)), n):
            for q in itertools.combinations(range(len(y)), n):
                best = max(best, sum(brute(x[i], y[j]) for i, j in zip(p, q)))
    return 1 + best


def test_match_equals_brute_force():
    rng = random.Random(1)

    def tree(depth):
        return [rng.choice("ab"), 0, [tree(depth - 1) for _ in range(rng.randint(0, 3))] if depth else []]

    for _ in range(60):
        a, b = tree(2), tree(2)
        size, pairs = w.match(a, b)
        assert size == brute(a, b) == len(pairs)
        labels = [l for _, l in nodes(a)], [l for _, l in nodes(b)]
        assert all(labels[0][i] == labels[1][j] for i, j in pairs)
        assert len({i for i, _ in pairs}) == len({j for _, j in pairs}) == len(pairs)


def text(page):
    return "\n\n".join(w.content(w.parse(page)))


def test_article_page():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><article>";</script></head><body>
    <header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></ul></nav><div class="cookie-notice">We use cookies</div>
    <main><article><header><h1>A &amp; B</h1></header><p><b>One<br>two
      three.<p>Four <a href=x>five</a> &lt;six&gt; &nbsp; seven<div class="ad">Buy</div><ul><li>i<li>ii</ul>
    <form><input name=q>Search me</form><table><tr><td>c1<td>c2</table>tail<aside>Related</aside>
    <section id="comments"><article class="comment"><p>First!</article></section></article></main>
    <footer>&copy; us</footer></body>"""
    assert text(page).split("\n\n") == ["A & B", "One two three.", "Four five <six> seven", "i", "ii", "c1", "c2", "tail"]


def test_odd_pages():
    assert text("") == "" and text("<") == "<" and text("a < b") == "a < b" and text("<!-- x") == "" and text("<p") == ""
    assert text("<p>unclosed <b>bold") == "unclosed bold" and text("</div>x</p>y") == "xy"
    assert text("<script>never closed") == "" and text("<p title='a>b'>x</p>") == "x" and text("<p title=it's>x</p>") == "x"
    assert text("<div><p>a</div>b") == "a\n\nb" and text("<p>x<hr>y") == "x\n\ny"
    assert text("<p>" * 3000 + "x") == text("<div>" * 3000 + "x") == "x"


def page(i, body):
    menu = "".join(f'<li><a href="/{k}">Part {k}</a></li>' for k in range(i % 3 + 2))
    return (
        f'<html><body><div class="top"><h2>The Daily</h2></div><ul>{menu}</ul><div class="text">{body}</div>'
        '<div class="end">All rights reserved by the Daily.</div></body></html>'
    )


def test_template_and_slots(spark):
    bodies = [f"<h1>Story {i}</h1>" + "".join(f"<p>Line {i} {k}</p>" for k in range(i % 4 + 1)) for i in range(8)]
    rows = [(i, f"https://News.example.com:80/{i}", page(i, b)) for i, b in enumerate(bodies)]
    rows += [(50, rows[0][1], rows[0][2]), (51, None, None), (52, "https://other.example.org/", page(0, bodies[0])), (53, "x", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {r.page_id: r for r in w.main_text(df).collect()}
    want = {i: "\n\n".join([f"Story {i}", *(f"Line {i} {k}" for k in range(i % 4 + 1))]) for i in range(8)}
    assert {i: got[i].text for i in range(8)} == want and got[50].text == want[0]
    # one page of a host tells nothing constant from what varies
    assert got[52].text == f"The Daily\n\n{want[0]}\n\nAll rights reserved by the Daily."
    assert (got[51].text, got[51].n_chars, got[51].url, got[53].text) == ("", 0, None, "")
    assert all(r.n_chars == len(r.text) for r in got.values())
    assert w.main_text(df.limit(0)).count() == 0


def test_equal_texts_are_matched_and_long_lists_end():
    rng = random.Random(2)
    a = ["ul", 0, [["li", h, []] for h in (1, 2, 3, 9)]]
    b = ["ul", 0, [["li", h, []] for h in (4, 9)]]
    assert w.match(a, b) == (3, [(0, 0), (4, 2), (3, 1)]) or set(w.match(a, b)[1]) >= {(0, 0), (4, 2)}
    table = lambda n: ["table", 0, [["tr", 0, [["td", rng.randrange(1, 10**9), []] for _ in range(3)]] for _ in range(n)]]
    x, y = table(10_000), table(9_000)
    y[2][5_000] = x[2][6_000]
    size, pairs = w.match(x, y)
    assert size > 30_000 and len(pairs) == size and (1 + 4 * 6_000, 1 + 4 * 5_000) in pairs
    assert [j for _, j in sorted(pairs)] == sorted({j for _, j in pairs})


def article(i, notice="Join our letter and read on tomorrow."):
    ps = "".join(f"<p>Line {i} {k}</p>" for k in range(i % 5 + 1))
    return f"<html><body><nav>menu {i}</nav><article><h1>Story {i}</h1>{ps}<div><span>{notice}</span></div><p>Call us any time.</p></article></body></html>"


def test_constant_nodes_inside_articles(spark):
    """Constant blocks without a telling name go, on every layout of a host; an article that all pages repeat stays."""
    want = {i: "\n\n".join([f"Story {i}", *(f"Line {i} {k}" for k in range(i % 5 + 1))]) for i in range(12)}
    rows = [(i, "http://a.example.com/x", article(i)) for i in range(12)]
    rows += [(100 + i, "http://a.example.com/y", page(i, f"<p>Words {i}</p>")) for i in range(6)]
    rows += [(200 + i, "http://b.example.com/", article(i)) for i in range(3)]
    rows += [(300 + i, "http://c.example.com/", article(0).replace("menu 0", f"menu {i}")) for i in range(9)]
    rows += [(400, "http://a.example.com/z", ""), (401, "http://a.example.com/z", "<article>Call us any time.</article>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    got = {r.page_id: r.text for r in w.main_text(df).collect()}
    assert {i: got[i] for i in range(12)} == want
    assert {got[100 + i] for i in range(6)} == {f"Words {i}" for i in range(6)}
    extra = "\n\nJoin our letter and read on tomorrow.\n\nCall us any time."
    assert [got[200 + i] for i in range(3)] == [want[i] + extra for i in range(3)]  # too few articles to tell
    assert {got[300 + i] for i in range(9)} == {want[0] + extra}
    assert got[400] == "" and got[401] == "Call us any time."


def test_page_of_thousands_of_blocks(spark):
    big = lambda s: "<table>" + "".join(f"<tr><td>{s} {i}<td>{i * i}" for i in range(5_000)) + "</table>"
    df = spark.createDataFrame([(i, "http://t.example.com", f"<article>{big(i)}</article>") for i in range(4)], "page_id long, url string, html string")
    got = {r.page_id: r for r in w.main_text(df).collect()}
    assert all(got[i].text.count("\n\n") == 9_999 and got[i].text.endswith(str(4_999**2)) for i in range(4))


def largest(x, y):
    """(matched, of these in equal elements with children, equal texts) of the largest match of two trees, from the definition."""
    if x[0] != y[0]:
        return 0, 0, 0
    table = [[(0, 0, 0)] * (len(y[2]) + 1) for _ in range(len(x[2]) + 1)]
    for p, c in enumerate(x[2]):
        for q, d in enumerate(y[2]):
            pair = tuple(map(sum, zip(table[p][q], largest(c, d))))
            table[p + 1][q + 1] = max(table[p][q + 1], table[p + 1][q], pair)
    n, alike, e = table[-1][-1]
    return n + 1, n + 1 if x == y and x[2] else alike, e + (x[1] == y[1])


def test_long_lists_are_matched_exactly(monkeypatch):
    """The largest match with the most equal texts at every length, the same pairs however the table is filled."""
    rng = random.Random(4)

    def tree(depth, most):
        below = [tree(depth - 1, most) for _ in range(rng.randint(most // 2, most))] if depth else []
        return [rng.choice("ab"), rng.randrange(6), below]

    for depth, most in [(1, 100), (1, 60), (2, 9), (3, 4)] * 4:
        a, b = ["r", 0, tree(depth, most)[2]], ["r", 0, tree(depth, most)[2]]
        size, pairs = w.match(a, b)
        texts = w.hashes_of(a), w.hashes_of(b)
        assert (size, sum(texts[0][i] == texts[1][j] for i, j in pairs)) == largest(a, b)[::2] and len(pairs) == size
        for loop, cells, kept in (10**9, 1, 1), (-1, 1, 1), (-1, 1 << 24, 1 << 20):
            with monkeypatch.context() as m:
                m.setattr(w, "LOOP", loop), m.setattr(w, "CELLS", cells), m.setattr(w, "KEPT", kept)
                assert sorted(w.match(a, b)[1]) == sorted(pairs)


def test_template_does_not_depend_on_the_length_of_lists(spark):
    """A line repeated after every item is template on short and long pages, also where an extra block shifts the list."""
    rows, want = [], {}
    for host, items in enumerate((3, 80)):
        for i in range(8):
            blocks = [f"Extra {i}"] * (i % 2) + [x for k in range(items) for x in (f"Item {i} {k}", "Read on")] + [f"End {i}"]
            rows.append((100 * host + i, f"http://h{host}.example.com", "<div>" + "".join(f"<p>{x}</p>" for x in blocks) + "</div>"))
            want[100 * host + i] = "\n\n".join(x for x in blocks if x != "Read on")
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.page_id: r.text for r in w.main_text(df).collect()} == want


def test_equal_rows_outweigh_cells_of_few_values():
    """A row that comes back among rows of unlike and few-valued cells stays aligned in short and long tables."""
    rng = random.Random(9)
    notice = ["tr", 0, [["td", 7, []]]]

    def table(n):
        rows = [["tr", 0, [["td", rng.randrange(10, 10**9), []], ["td", rng.randrange(1, 4), []]]] for _ in range(n)]
        return ["table", 0, [x for k, r in enumerate(rows) for x in ([r, notice] if k % 5 == 4 else [r])]]

    for n in 20, 300:
        a, b = table(n), table(n + n // 2)
        texts = w.hashes_of(a), w.hashes_of(b)
        matched = {i: j for i, j in w.match(a, b)[1]}
        assert all(texts[1][matched[i]] == 7 for i, t in enumerate(texts[0]) if t == 7)
