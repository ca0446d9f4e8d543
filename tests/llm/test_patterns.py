import random

from test_wrappers import PLAIN, page
from weftline.llm import wrappers


def test_blank_and_long_pages_do_not_cost_a_host_its_template(make, monkeypatch):
    rng = random.Random(6)
    made = [(i, f"https://{host}.example/{i}", *page(rng, PLAIN)) for host in ("blank", "long") for i in range(10, 20)]
    rows = [m[:3] for m in made] + [(1, "https://blank.example/1", ""), (2, "https://blank.example/2", " \n")]
    for limit in (200_000, 10):
        monkeypatch.setattr(wrappers, "PATTERN_CHARS", limit)
        got = {r.url: r.text for r in wrappers.main_text(make(rows, "page_id long, url string, html string"), ["url"]).collect()}
        assert all(got[url] == text for _, url, _, text in made) and got["https://blank.example/1"] == ""
