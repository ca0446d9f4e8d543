import random

from helpers import prose
from weftline.llm import wrappers


def page(rng, article, deep=0):
    """A page without article elements and telling names, whose menu, notice and promotion differ from page to page."""
    menu = "".join(f'<li><a href="/{prose(rng, 1)}">{prose(rng, 2)}</a></li>' for _ in range(rng.randint(3, 9)))
    promo = f'<div class="q7"><b>{prose(rng, 2)}</b> {prose(rng, rng.randint(3, 8))}</div>' if rng.random() < 0.8 else ""
    latest = "".join(f'<div><a href="#">{prose(rng, rng.randint(3, 6))}</a></div>' for _ in range(rng.randint(2, 6)))
    body = "".join(f"<p>{x}</p>" for x in article)
    return f'<html><body><div class="k1"><ul>{menu}</ul></div>{promo}<div class="k3">{"<div>" * deep}{body}{"</div>" * deep}</div><div class="k4">{latest}</div><div class="k5">Printed on paper.</div></body></html>'


def corpus(seed, hosts=3, pages=12, deep=0):
    rng = random.Random(seed)
    out = []
    for h in range(hosts):
        for i in range(pages):
            article = [prose(rng, rng.randint(15, 60)) for _ in range(rng.randint(2, 7))]
            out.append((h * 100 + i, f"https://host{h}.example/{i}", page(rng, article, deep), "\n".join(article)))
    return out


def read(make, rows):
    return {r.page_id: r.text for r in wrappers.main_text(make([r[:3] for r in rows], "page_id long, url string, html string"), ["page_id"]).collect()}


def test_figures_of_the_host_decide(make):
    rows = corpus(1)
    got = read(make, rows)
    assert all(got[i] == text for i, _, _, text in rows)
    # without the wrapper, none of it would be right
    assert not any(wrappers.extract(html) == text for _, _, html, text in rows)


def test_any_depth(make):
    rows = corpus(2, hosts=1, pages=5, deep=2000)
    got = read(make, rows)
    assert all(got[i] == text for i, _, _, text in rows)


def test_names_do_not_outvote_the_main_text(make):
    rows = [(i, u, h.replace("k3", "sidebar"), t) for i, u, h, t in corpus(3)]
    got = read(make, rows)
    assert all(got[i] == text for i, _, _, text in rows)


def test_copies_of_one_article_are_not_template(make):
    rows = corpus(4, hosts=1, pages=4)
    rows += [(50 + k, rows[0][1], rows[0][2], rows[0][3]) for k in range(40)]
    got = read(make, rows)
    assert all(text in got[i] for i, _, _, text in rows)


def test_long_lists_of_siblings(make):
    rng = random.Random(5)
    rows = []
    for i in range(4):
        article = [prose(rng, 4) for _ in range(600 + i)]
        rows.append((i, f"https://long.example/{i}", page(rng, article), "\n".join(article)))
    got = read(make, rows)
    assert all(got[i] == text for i, _, _, text in rows)
