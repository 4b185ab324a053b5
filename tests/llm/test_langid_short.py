"""A language whose texts are all short is learned too."""

import corpus
from lexiquarry.llm import langid
from pyspark.sql import functions as F


def test_short_texts_teach(spark):
    titles = ["日本語の題", "東京の天気", "本日の新聞", "大阪の地図", "京都の寺"]
    long = "the quick brown fox jumps over the lazy dog again"
    data = [(i, t, "ja", "s", len(t)) for i, t in enumerate(titles)] + [(10 + i, long, "en", "s", len(long)) for i in range(3)]
    data += [(20, "12 34", "xx", "s", 5), (21, "", "yy", "s", 0)]
    docs = corpus.frame(spark, data)
    samples = langid.learn(docs, F.lit(True))
    assert set(samples) == {"en", "ja"}
    got = {r.doc_id: r.lang_pred for r in langid.identify(docs, samples).collect()}
    assert all(got[i] == "ja" for i in range(5)) and got[10] == "en"
