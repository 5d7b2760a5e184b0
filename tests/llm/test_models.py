import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from riskloom.llm import chargrams, language, toxicity

SYLLABLES = {"en": "th er on an re he in ed nd ha at en es of or".split(), "de": "sch ei ch en der ie au ße ü nd ung keit".split(), "fr": "eau oi ou é è que ment tion le re ai ç".split(), "el": "αν το και με στ ου ης".split()}
INSULTS = ("idiot", "scum", "moron")


def words(rnd, lang, n):
    return ["".join(rnd.choice(SYLLABLES[lang]) for _ in range(rnd.randint(1, 4))) for _ in range(n)]


def corpus(n=240, seed=2):
    rnd = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        lang = rnd.choice(list(SYLLABLES))
        text = words(rnd, lang, rnd.randint(5, 80))
        toxic = int(rnd.random() < 0.3)
        if toxic:
            text.insert(rnd.randrange(len(text)), rnd.choice(INSULTS).upper() if rnd.random() < 0.3 else rnd.choice(INSULTS))
        rows.append((i, " ".join(text), lang, "s", i))
        labels.append((i, 1, toxic))
    return rows, labels


def fold(i, n):
    return zlib.crc32(str(i).encode()) % n


def test_language(spark):
    rows, _ = corpus()
    rows += [(1000, None, "en", "s", 0), (1001, "", "de", "s", 0), (1002, "123 $$", "fr", "s", 0), (None, rows[0][1], None, "s", 0), (0, rows[0][1], rows[0][2], "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, spans long").repartition(3)
    model = language.train(docs, language.learning_rows())
    got = language.identify(docs.drop("spans"), model).collect()
    assert len(got) == len(rows) and {r["lang_pred"] for r in got} <= {*SYLLABLES, "und"}
    assert all(0 <= r["score"] <= 1 for r in got)
    odd = {r["doc_id"]: r["lang_pred"] for r in got if r["doc_id"] in (1000, 1001, 1002)}
    assert odd == dict.fromkeys((1000, 1001, 1002), "und")
    held = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 1000 and fold(r["doc_id"], 4) == 2]
    assert len(held) > 30 and sum(r["lang"] == r["lang_pred"] for r in held) >= 0.95 * len(held)
    kept = language.drop_unidentified(docs, model)
    assert kept.columns == docs.columns and kept.count() == len(rows) - 3


def test_language_without_labels(spark):
    docs = spark.createDataFrame([(1, "some words", None)], "doc_id long, text string, lang string")
    model = language.train(docs, language.learning_rows())
    assert language.identify(docs, model).first()["lang_pred"] == "und"
    assert language.identify(docs.where("false"), model).count() == 0


def test_spans_of_mixed_text(spark):
    rnd = random.Random(4)
    rows, _ = corpus(200)
    docs = spark.createDataFrame([(r[0], r[1], r[2]) for r in rows], "doc_id long, text string, lang string")
    model = language.train(docs, F.lit(True))
    text = " ".join([*words(rnd, "de", 30), *words(rnd, "fr", 40), *words(rnd, "el", 5)])
    spans = language.identify(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).first()["spans"]
    assert [s["lang"] for s in spans] == ["de", "fr", "el"] and spans[2]["words"] == 5 and abs(spans[0]["words"] - 30) <= 1


def test_unseen_scripts_speak_for_no_language(spark):
    rows = [r for r in corpus(160)[0] if r[2] != "el"]
    docs = spark.createDataFrame([(r[0], r[1], r[2]) for r in rows], "doc_id long, text string, lang string")
    model = language.train(docs, F.lit(True))
    odd = spark.createDataFrame([(1, "это только русский текст"), (2, "这是 中文"), (3, f"{rows[0][1]} это"), (4, "这")], "doc_id long, text string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identify(odd, model).collect()}
    assert all(got[i][1] == 0.0 and got[i][0] in SYLLABLES for i in (1, 2, 4))
    total = sum(len(w) for w in language._words(rows[0][1]))
    assert got[3][0] == rows[0][2] and 0.5 < got[3][1] <= total / (total + 3)
    assert [r["doc_id"] for r in language.drop_unidentified(odd, model).collect()] == [3]


def test_a_letter_proves_little(spark):
    """A letter that happens to stand in toxic texts more often does not make a text toxic."""
    rnd = random.Random(9)
    rows, labels = [], []
    for i in range(400):
        toxic = int(i % 4 == 0)
        text = words(rnd, "en", 30)
        if rnd.random() < (0.2 if toxic else 0.1):
            text.insert(3, "b")
        if toxic:
            text.insert(5, rnd.choice(INSULTS))
        rows.append((i, " ".join(text)))
        labels.append((i, toxic))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    found = {r["doc_id"]: r["toxicity"] for r in toxicity.score_toxicity(docs, model).collect()}
    assert not [i for i, t in labels if not t and found[i] >= 0.7]
    assert sum(found[i] >= 0.7 for i, t in labels if t) >= 95


def test_viterbi_against_all_labellings():
    rnd = np.random.default_rng(1)
    scores = rnd.normal(size=(12, 3)) * 2
    texts = [np.array(x, dtype=np.int64) for x in ([0, 1, 2, 3, 4], [5], [], [6, 7, 8, 9, 10, 11])]
    import itertools

    for labels, t in zip(language.viterbi(texts, scores, 1.5), texts):
        value = lambda y: sum(scores[r, k] for r, k in zip(t, y)) - 1.5 * sum(a != b for a, b in zip(y, y[1:]))  # noqa: E731, B023
        assert len(labels) == len(t) and np.isclose(value(labels), max(map(value, itertools.product(range(3), repeat=len(t)))))


def test_toxicity(spark):
    rows, labels = corpus()
    truth = {i: t for i, _, t in labels}
    rows += [(1000, None, "en", "s", 0), (1001, "", "de", "s", 0), (None, "an idiot wrote", "en", "s", 0), (1002, "clean words only " * 4000 + " idiot", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, toxicity long").repartition(3)
    marks = spark.createDataFrame([*labels, (1, 1, 7), (2, 1, None), (None, 1, 1), *labels[:5]], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, marks)
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(docs.drop("toxicity"), model).collect()}
    assert all(0 <= r["toxicity"] <= 1 for r in got.values()) and got[1000]["expression"] is None and got[1000]["toxicity"] < 0.5
    held = [i for i in truth if fold(i, 3) == 1]
    right = sum((got[i]["toxicity"] >= 0.7) == (truth[i] == 1) for i in held)
    assert len(held) > 50 and right >= 0.95 * len(held)
    assert got[1002]["toxicity"] >= 0.7 and got[1002]["expression"] == "idiot"
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns and kept.where("doc_id = 1002").count() == 0


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "idiot")], "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score_toxicity(docs, model).first()["toxicity"] < 0.01


def test_slots_agree_with_sql(spark):
    ids = np.random.default_rng(3).integers(-(2**63), 2**63 - 1, 200)
    df = spark.createDataFrame([(int(i),) for i in ids], "id long").selectExpr("id", chargrams.slot_column("id", 20) + " AS slot")
    got = {r["id"]: r["slot"] for r in df.collect()}
    assert all(got[int(i)] == s for i, s in zip(ids, chargrams.slots(ids.view(np.uint64), 20)))


def test_grams_stay_within_words():
    grams = chargrams.WordGrams(["ab", "c"])
    assert [len(grams.ends(n)) for n in (1, 2, 3, 4)] == [3, 5, 3, 1]
    same = chargrams.WordGrams(["xab", "ab"])
    assert same.ids(3)[4] == same.ids(3)[7] == grams.ids(3)[3] or same.ids(2)[3] == grams.ids(2)[2]


def test_texts_without_a_letter_and_taken_names(spark):
    rows, _ = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, place int")
    model = language.train(df, F.lit(True))
    odd = spark.createDataFrame([(1, "½ ² Ⅷ 12 _", "a"), (2, "", "b"), (3, None, "c"), (4, "ab " * 200_000, "d")], "doc_id long, text string, score string")
    got = {r["doc_id"]: r for r in language.identify(odd, model).collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and got[4]["lang_pred"] in SYLLABLES and 0 <= got[4]["score"] <= 1
    kept = language.drop_unidentified(odd, model)
    assert kept.columns == odd.columns and [r["score"] for r in kept.collect()] == ["d"]


def test_every_label_is_learned(spark):
    df = spark.createDataFrame([(i, f"{chr(0x4E00 + i)}{chr(0x4E00 + i)} " * 5, f"l{i}") for i in range(300)], "doc_id long, text string, lang string")
    model = language.train(df, F.lit(True))
    assert len(model.languages) == 300
    got = {r["doc_id"]: r["lang_pred"] for r in language.identify(df.select("doc_id", "text"), model).collect()}
    assert sum(got[i] == f"l{i}" for i in range(300)) >= 290
