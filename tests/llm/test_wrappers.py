import random

import pytest
from helpers import prose
from weftline.llm import html_dom, wrappers

PAGE = """<!DOCTYPE html><html><head><title>{t}</title><style>p{{}}</style><script>var a="</p><p>no";</script></head><body class="has-sidebar">
<header><a href="/">Home</a> Daily</header><div id="main-menu"><ul><li><a>One</a><li><a>Two</a></ul></div><div class="x1">Find out what we are about.</div>
<article><h1>{t}</h1><p>{a}<br>second   line &amp; more<p>{b}<div class="ad">Buy</div><form><p>Your mail</p></form><aside>More</aside></article>
<section class="comments"><p>First!</p></section><div class="x2">Printed on paper.</div><footer>&copy; us</footer></body></html>"""
PLAIN = PAGE.replace("<article>", "<div>").replace("</article>", "</div>")


def page(rng, form):
    t, a, b = (prose(rng, n) for n in (4, 30, 20))
    return form.format(t=t, a=a, b=b), f"{t}\n{a} second line & more\n{b}"


def test_article():
    html, text = page(random.Random(1), PAGE)
    assert wrappers.extract(html) == text


def test_template_is_learned_from_the_host(make):
    rng = random.Random(2)
    made = [(i, f"https://{'hot' if i % 3 else 'cold'}.example.com/{i}?q", *page(rng, PLAIN)) for i in range(30)]
    made += [(100 + i, f"//few{i}.example.com/", *page(rng, PLAIN)) for i in range(2)]
    got = {r.page_id: r for r in wrappers.main_text(make([m[:3] for m in made], "page_id long, url string, html string"), ["page_id", "url"]).collect()}
    for i, _, _, text in made:
        want = text if i < 100 else "\n".join(["Find out what we are about.", text, "Printed on paper."])
        assert got[i].text == want and got[i].n_chars == len(want)


@pytest.mark.parametrize("html,text", [
    (None, ""), ("", ""), ("<p>a", "a"), ("plain &lt;text&gt;", "plain <text>"), ("<p>a<p>b</b></i>c", "a\nbc"), ("<div>" * 3000 + "x" + "</div>" * 3000 + "<p>y", "x\ny"), ("<a " * 500, ""), ("<!-- x", ""),
    ("<p>a  \n b</p>", "a b"), ("<table><tr><td>1<td>2<tr><td>3</table>", "1\n2\n3"), ("<script>x</script>ok<script>y", "ok"), ("<p hidden>x</p><p style='display: none'>y</p><p>z", "z"), ("a < b > c", "a < b > c"),
])
def test_broken_markup(html, text):
    assert wrappers.extract(html) == text


def slow_match(a, b):
    """The size of the largest mapping, by the plain recursion."""
    if a[0] != b[0]:
        return 0
    m = [[0] * (len(b[3]) + 1) for _ in range(len(a[3]) + 1)]
    for i, x in enumerate(a[3], 1):
        for j, y in enumerate(b[3], 1):
            m[i][j] = max(m[i - 1][j], m[i][j - 1], m[i - 1][j - 1] + slow_match(x, y))
    return 1 + m[-1][-1]


def test_tree_matching():
    rng = random.Random(3)

    def tree(depth):
        return [rng.choice("abc"), "", "", [tree(depth - 1) for _ in range(rng.randint(0, 4))] if depth else []]

    for _ in range(300):
        a, b = tree(3), tree(3)
        found = html_dom.match(a, b)
        assert len(found) == slow_match(a, b) and len(set(found.values())) == len(found)


def test_odd_rows(make):
    rows = [(1, None, "<p>a"), (None, "http://h.example/", None), (2, "", ""), (3, "http://u:p@h.example:80/", "<p>b"), (3, "http://u:p@h.example:80/", "<p>b"), (4, "http://h.example", "<p>b")]
    got = wrappers.main_text(make(rows, "page_id long, url string, html string"), ["page_id", "url"]).collect()
    assert sorted((str(r.page_id), r.text) for r in got) == [("1", "a"), ("2", ""), ("3", "b"), ("3", "b"), ("4", "b"), ("None", "")]
    assert wrappers.main_text(make([], "page_id long, url string, html string"), ["page_id"]).count() == 0
