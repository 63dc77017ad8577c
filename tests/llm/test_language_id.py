"""Held-out accuracy, scores that don't depend on the batch, and more languages than the sample has room for."""

import numpy as np

from foliograph.llm import language_id
from foliograph.llm.common import documents


def test_held_out_accuracy(spark):
    docs = documents(spark, "/root/testdata/sf0.01").select("doc_id", "text", "lang")
    lang = {r.doc_id: r.lang for r in docs.collect()}
    got = [r for r in language_id.identify(docs).collect() if r.held_out and lang[r.doc_id] and r.lang_pred != "und"]
    assert len(got) > 100 and np.mean([lang[r.doc_id] == r.lang_pred for r in got]) > 0.97


def test_batches(spark):
    texts = [r.text.encode() for r in documents(spark, "/root/testdata/sf0.001").filter("text IS NOT NULL").collect()]
    net = language_id.ByteNet(["a", "b", "c"])
    net.train(texts[:60], np.arange(60) % 3, epochs=2)
    ends = np.cumsum([0, *map(len, texts)])
    whole = net.predict(np.frombuffer(b"".join(texts), np.uint8), ends)
    for i in (0, 7, len(texts) - 1):
        alone = net.predict(np.frombuffer(texts[i], np.uint8), np.array([0, len(texts[i])]))
        assert (alone[0] == whole[i]).all()
    some = net.predict(np.frombuffer(b"".join(texts[5:25]), np.uint8), ends[5:26] - ends[5])
    assert (some == whole[5:25]).all()


def test_many_languages(spark):
    rows = [(i, f"word{i % 700} text", f"l{i % 700:03}") for i in range(2100)]
    net = language_id.fit_language_net(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample_rows=1000)
    assert len(net.langs) > 600
