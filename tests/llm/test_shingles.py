import random

from pyspark.sql import functions as F

import corpus_pipeline
from riskloom.llm import shingles


def plain_set(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", lowered) if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_groups(ids, texts):
    sets = [plain_set(t) for t in texts]
    group = list(range(len(ids)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if group[i] != group[j] and 5 * len(a & b) >= 4 * len(a | b):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    return [min(ids[j] for j in range(len(ids)) if group[j] == g) for g in group]


def texts(seed=3):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    passage = [rnd.choice(vocabulary) for _ in range(30)]
    out = [None, "", " \t", "One two", "one  TWO", "a b c d e f", "É é É é É x"]
    for size in (100, 40, 120, 60, 200, 12):
        base = [rnd.choice(vocabulary) for _ in range(size)] + passage * (size % 3)
        for _ in range(14):
            near = list(base)
            for _ in range(rnd.randint(0, max(1, size // 25))):
                near[rnd.randrange(len(near))] = rnd.choice(vocabulary)
            out.append(" ".join(near))
    return out


def test_groups_match_brute_force(spark):
    rows = list(enumerate(texts()))
    want = plain_groups(*zip(*rows))
    assert len(set(want)) < len({frozenset(plain_set(t)) for _, t in rows}) - 10  # unequal texts are linked
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, h long")
    for bucket in (64, 2):  # 2: most shared shingles count as crowded
        got = {r["doc_id"]: r["component_id"] for r in shingles.near_duplicate_groups(df, bucket=bucket).collect()}
        assert got == dict(zip([i for i, _ in rows], want))


def test_pipeline_stage_drops_near_copies(spark):
    rnd = random.Random(8)
    words = [f"v{rnd.randrange(5000)}" for _ in range(300)]
    near, far = list(words), list(words)
    for at in (40, 120, 200, 280):
        near[at] = "changed"
    for at in range(10, 300, 20):
        far[at] = "changed"
    df = spark.createDataFrame([(1, " ".join(words), "en"), (2, " ".join(near), "en"), (3, " ".join(far), "en")], "doc_id long, text string, lang string")
    kept = corpus_pipeline.one_of_each(spark, df, "")
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 3]
    none = df.where("false")
    assert corpus_pipeline.one_of_each(spark, none, "").count() == 0


def test_a_pair_is_met_under_one_of_its_keys(spark):
    """Forty texts that share thirty crowded keys, and a few more each: every pair is one row."""
    rnd = random.Random(11)
    rows = [(h, k) for h in range(40) for k in {*rnd.sample(range(30), 28), 100 + h}]
    crowded = shingles._carried(spark.createDataFrame(rows, "h long, key long"))
    x, y = crowded.alias("x"), crowded.alias("y")
    met = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.h") < F.col("y.h")) & shingles._met_first("x", "y"))
    assert met.count() == met.select("x.h", "y.h").distinct().count() == 40 * 39 // 2


def test_texts_of_one_template(spark):
    """A crowd whose texts are alike in part only: the groups of brute force."""
    rnd = random.Random(12)
    frame = [f"t{i}" for i in range(60)]
    made = []
    for i in range(90):
        text = list(frame)
        for _ in range(rnd.choice([0, 1, 3, 12, 30])):
            text[rnd.randrange(60)] = f"x{rnd.randrange(400)}"
        made.append((i, " ".join(text)))
    want = plain_groups(*zip(*made))
    df = spark.createDataFrame(made, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in shingles.near_duplicate_groups(df, bucket=8).collect()}
    assert got == dict(enumerate(want))
