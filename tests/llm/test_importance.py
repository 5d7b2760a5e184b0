import hashlib
import math
import random
import re
import zlib

from pyspark.sql import functions as F

from riskloom.llm import importance
from riskloom.operators.ranks import numbered

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans(importance._UPPER, importance._LOWER)


def features(text, longest, buckets):
    words = WORD.findall((text or "").translate(LOWER))
    runs = [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]
    return len(words), [zlib.crc32(r.encode()) % buckets for r in runs]


def plain(docs, target, percent=10, least=20, longest=1, buckets=10_000):
    """``(doc_id, n_features, weight, score, rank)`` by loops over everything."""
    found = [(i, *features(t, longest, buckets)) for i, t in docs]
    s, t = [0] * buckets, [0] * buckets
    for _, _, bs in found:
        for b in bs:
            s[b] += 1
    for text in target:
        for b in features(text, longest, buckets)[1]:
            t[b] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + buckets) / ((s[b] + 1) * (sum(t) + buckets)))) for b in range(buckets)]
    scored = []
    for i, n, bs in found:
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in bs)
        scored.append((i, len(bs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n))
    able = sorted((x for x in scored if x[4] >= least), key=lambda x: (-x[3], x[0] is None, x[0] or 0, x[1], x[2]))
    drawn = percent * len(able) // 100
    return [(*x[:4], k + 1 if k < drawn else None) for k, x in enumerate(able)] + [(*x[:4], None) for x in scored if x[4] < least]


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr)


def some_texts(n, seed):
    rnd = random.Random(seed)
    words = ["the", "Of", "ÉTÉ", "été", "a1", "naïve", "日本", "İx", "zebra", "don't", "x_y", "😀k"] + [f"w{i}" for i in range(40)]
    return ["".join(rnd.choice(words) + rnd.choice([" ", ", ", "\n", "\x00", "—"]) for _ in range(rnd.randint(0, 60))) for _ in range(n)]


def test_equals_plain_loops(spark):
    texts = some_texts(300, 1)
    docs = [(i, t) for i, t in enumerate(texts)] + [(None, texts[3]), (7, texts[7]), (7, "short"), (900, None), (901, ""), (902, "!! ..")]
    target = some_texts(20, 2) + [None, ""]
    rows = spark.createDataFrame([(i, t, "noise", 1) for i, t in docs], "doc_id long, text string, words string, buckets int")
    wanted = spark.createDataFrame([(t,) for t in target], "text string")
    assert got(importance.resample(rows, wanted)) == sorted(plain(docs, target), key=repr)


def test_longer_runs(spark):
    docs = list(enumerate(some_texts(60, 3)))
    target = some_texts(5, 4)
    rows, wanted = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(t,) for t in target], "text string")
    found = importance.resample(rows, wanted, runs=(1, 3), buckets=500, percent=50, least_words=5)
    assert got(found) == sorted(plain(docs, target, 50, 5, 3, 500), key=repr)


def test_empty_tables(spark):
    rows = spark.createDataFrame([(1, "a b " * 20)], "doc_id long, text string")
    assert importance.resample(rows.where("false"), rows).count() == 0
    assert got(importance.resample(rows, rows.where("false"), percent=100))[0][4] == 1


def test_a_very_long_text(spark):
    rows = spark.range(1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("Word one, two "), 300_000).alias("text"))
    assert importance.bucket_arrays(rows, text="text").first()["n_words"] == 900_000


def test_numbers_of_rows_in_an_order(spark):
    rnd = random.Random(5)
    values = [(rnd.choice([None, *range(50)]), i) for i in range(2_000)]
    df = spark.createDataFrame(values, "v int, i int").repartition(7)
    for partitions in (1, 3, 16):
        rows = numbered(df, [F.col("v").desc_nulls_last(), F.col("i")], partitions=partitions).collect()
        assert sorted(r["rank"] for r in rows) == list(range(1, 2_001))
        assert [(r["v"], r["i"]) for r in sorted(rows, key=lambda r: r["rank"])] == sorted(values, key=lambda x: (x[0] is None, -(x[0] or 0), x[1]))
    assert numbered(df.where("false"), [F.col("v")]).count() == 0
