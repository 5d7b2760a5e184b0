import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from riskloom.llm import components, shingles, simhash

WORDS = "the of and to in is on it as by at or an be we us he so no if up do go my me".split()


def plain_fingerprint(text, n=3):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", lowered) if w]
    if not words:
        return 0
    grams = [" ".join(words)] if len(words) < n else [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(prints, ids, most=2):
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= most:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    least = {}
    for i, d in enumerate(ids):
        r = find(i)
        least[r] = min([x for x in (least.get(r), d) if x is not None], default=None)
    return [least[find(i)] for i in range(len(ids))]


def texts():
    rnd = random.Random(5)
    out = [None, "", " \t\x0b", "One", "one", "ÉA b", "x" * 5000, "a\x1cb c d e", "ab " * 20000]
    for _ in range(12):
        words = [rnd.choice(WORDS) for _ in range(rnd.randint(1, 120))]
        out.append(" ".join(words))
        for _ in range(rnd.randint(0, 3)):
            near = list(words)
            near[rnd.randrange(len(near))] = rnd.choice(WORDS)
            out.append(" ".join(near))
    return out + out[9:14]


def test_fingerprints():
    for t in texts():
        assert simhash.fingerprint(t) == plain_fingerprint(t)


def test_groups_match_brute_force(spark):
    rows = list(enumerate(texts())) + [(None, "lonely words of a text without an id"), (3, "One")]
    df = spark.createDataFrame([(i, t, 7, 9) for i, t in rows], "doc_id long, text string, fp long, component_id long")
    expected = plain_groups([plain_fingerprint(t) for _, t in rows], [i for i, _ in rows])
    for bucket in (512, 1):  # 1: every shared variant counts as crowded
        got = simhash.near_duplicate_groups(df, bucket=bucket).collect()
        want = sorted((str(i), f"{plain_fingerprint(t):016x}", str(c)) for (i, t), c in zip(rows, expected))
        assert sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in got) == want


def test_links_by_flipped_bits(spark):
    rnd = random.Random(1)
    prints = {rnd.getrandbits(64) for _ in range(20)}
    for p in list(prints)[:10]:
        for k in (1, 2, 3):
            q = p
            for b in rnd.sample(range(64), k):
                q ^= 1 << b
            prints.add(q)
    signed = [int(np.uint64(p).astype(np.int64)) for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    got = {(r["a"], r["b"]) for r in simhash.fingerprint_links(df).collect()}
    want = {(a, b) for a in signed for b in signed if a < b and bin((a ^ b) & (1 << 64) - 1).count("1") <= 2}
    assert got == want


def test_empty_and_dropping(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicate_groups(none).count() == 0
    df = spark.createDataFrame([(1, "a b c d", "x"), (2, "A b c d", "y"), (2, "A b c d", "y"), (3, "other words are here now", "z"), (3, "other words are here now", "z"), (None, "z y x", "w")], "doc_id long, text string, copies string")
    kept = simhash.drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted((str(r["doc_id"]), r["copies"]) for r in kept.collect()) == [("1", "x"), ("3", "z"), ("None", "w")]


def test_components_of_a_chain(spark):
    edges = spark.range(60).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).unionByName(spark.createDataFrame([(100, 101), (101, 100), (7, 7), (None, 5)], "a long, b long"))
    got = {r["node"]: r["root"] for r in components.connected_components(edges).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100}
    assert components.connected_components(edges.where("false")).count() == 0


def test_dropping_tells_rows_without_an_id_apart(spark):
    texts = ["one text of its own", "a second and other one", "a second and other one", "third words that differ from both", None, ""]
    rows = [(None, t, i) for i, t in enumerate(texts)] + [(5, "fifth text here with id", 9), (5, "fifth but of other words entirely", 10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row_file int")
    for module in (simhash, shingles):
        kept = module.drop_near_duplicates(df)
        assert kept.columns == df.columns
        got = kept.collect()
        assert len(got) == 6 and {r["text"] or "" for r in got} == {t or "" for _, t, _ in rows}


def test_a_taken_name_gives_way(spark):
    df = spark.createDataFrame([(1, "x")], "fingerprint long, text string")
    assert simhash.with_fingerprint(df).columns == ["text", "fingerprint"]
