import random

import numpy as np
from riskloom.llm import toxicity
from riskloom.llm.chargrams import WordGrams, slots

from test_models import fold  # noqa: I001


def test_no_gram_displaces_another(spark):
    rnd = random.Random(9)
    ids = [i for i in range(300) if fold(i, 3) != 1]
    rows = [(i, " ".join("".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(30))) for i in ids]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, toxic int"))
    _, grams = toxicity._top_grams(WordGrams([w for _, t in rows for w in t.split()]))
    for key, (tags, values) in (("gram", model.known), ("context", model.other)):
        wanted = np.unique(grams[key])
        assert np.array_equal(tags, wanted) and all(len(v) == len(wanted) for v in values.values())
    wanted = np.unique(grams["gram"])
    assert len(np.unique(slots(wanted.view(np.uint64), 20))) < len(wanted) - 100  # a table of 2**20 places would lose these


def test_a_model_too_large_to_send_scores_alike(spark, monkeypatch):
    rnd = random.Random(4)
    words = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 8))) for _ in range(400)]
    rows = [(i, " ".join([*rnd.choices(words, k=rnd.randint(0, 40)), *(["nasty"] if i % 3 == 0 else [])])) for i in range(400)]
    rows += [(400, None), (401, ""), (402, "12 !"), (None, "nasty " + words[0]), (5, "x" * 30_000 + " nasty")]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, W int").repartition(4)
    marks = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(400)], "doc_id long, toxic int")
    sent = toxicity.train(docs, marks)
    assert sent.joined is None
    monkeypatch.setattr(toxicity, "MOST_SENT", 0)
    for hot in (1 << 16, 20, 0):
        monkeypatch.setattr(toxicity, "HOT_WORDS", hot)
        kept = toxicity.train(docs, marks)
        assert kept.joined and np.isclose(kept.slope, sent.slope) and np.isclose(kept.offset, sent.offset)
        key = lambda r: (str(r["doc_id"]), str(r["text"]))
        one = sorted(toxicity.score_toxicity(docs, sent).collect(), key=key)
        two = sorted(toxicity.score_toxicity(docs, kept).collect(), key=key)
        assert [(r["doc_id"], r["expression"]) for r in one] == [(r["doc_id"], r["expression"]) for r in two]
        assert np.allclose([r["toxicity"] for r in one], [r["toxicity"] for r in two], rtol=1e-9)
    assert toxicity.drop_toxic(docs, kept).columns == docs.columns
    assert toxicity.score_toxicity(docs.where("false"), kept).count() == 0
