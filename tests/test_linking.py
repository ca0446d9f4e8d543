import json

from weftline.sources import linking


def test_corpus(spark, tmp_path):
    def bag(lang, *ids):
        return {"info": {"lang": lang, "eventUri": "e"}, "articles": {"results": [{"id": i, "body": "b", "title": "t", "eventUri": "e", "isDuplicate": False, "lang": lang, "date": "2024-01-02", "time": "03:04:05", "source": {"title": "s"}} for i in ids]}}

    for kind, content in (("positive", {"A": bag("en", "1", "2"), "B": bag("de", "3"), "meta": {}}), ("negative", {"C": bag("en", "4"), "D": bag("en", "5")})):
        (tmp_path / kind).mkdir()
        (tmp_path / kind / "x.json").write_text(json.dumps(content))
    (tmp_path / "broken.json").write_text("{")
    bags, articles, links = linking.read_corpus(spark, str(tmp_path))
    assert bags.count() == 4 and articles.count() == 5
    pairs = {tuple(r) for r in linking.gold_pairs(links, articles).collect()}
    assert pairs == {("1", "3", "positive"), ("2", "3", "positive"), ("3", "1", "positive"), ("3", "2", "positive"), ("4", "5", "negative"), ("5", "4", "negative")}
    assert linking.read_corpus(spark, str(tmp_path), limited=True)[0].count() == 2
    linking.write_pairs(linking.gold_pairs(links, articles), str(tmp_path / "out"))
    back = linking.read_cross_pairs(spark, str(tmp_path / "out"))
    assert back.where("positive").count() == 4 and back.count() == 6
