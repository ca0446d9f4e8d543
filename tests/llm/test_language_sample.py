import random

from helpers import prose
from pyspark.sql import functions as F
from weftline.llm import langid


def test_copies_take_no_share_of_the_sample(make):
    texts = [prose(random.Random(i), 30) for i in range(6)]
    schema, other = "doc_id long, text string, lang string", [(99, "otra lengua", "es")]
    once = langid.fit(make([*((i, t, "en") for i, t in enumerate(texts)), *other], schema), F.lit(True), rows=20)
    copied = langid.fit(make([*((i, t, "en") for i, t in enumerate([*texts, *texts[:1] * 3000])), *other], schema), F.lit(True), rows=20)
    assert copied.langs == once.langs and (copied.like == once.like).all()
