import math
import random
import re
from collections import Counter

import numpy as np

from riskloom.llm import ranked_search as search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans(search._UPPER, search._LOWER)


def terms(text):
    return Counter(TERM.findall((text or "").translate(LOWER)))


def plain(docs, questions, k):
    """Every question against every document."""
    counted = [(i, c) for i, c in ((i, terms(t)) for i, t in docs) if c]
    n_docs, n_terms = len(counted), sum(c.total() for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    asked = {}
    for q, text in questions:
        asked.setdefault(q, set()).update(terms(text))
    out = []
    for q, wanted in asked.items():
        scores = []
        for i, c in counted:
            m = 50 + (50 * c.total() * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in wanted if c[t])
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        out += [(q, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def texts(n, seed, longest=40):
    rnd = random.Random(seed)
    words = ["The", "the", "of", "ÉTÉ", "été", "日本", "a1b", "x_y", "don't", "😀"] + [f"w{i}" for i in range(60)]
    weights = [30, 30, 20, 5, 5, 3, 3, 2, 2, 1] + [60 / (i + 1) for i in range(60)]
    return ["".join(w + rnd.choice([" ", ", ", "\n", "\x00"]) for w in rnd.choices(words, weights, k=rnd.randint(0, longest))) for _ in range(n)]


def tables(spark, docs, questions, parts=5):
    d = spark.createDataFrame([(i, t, "x", 0) for i, t in docs], "doc_id long, text string, score string, n int").repartition(parts)
    return d, spark.createDataFrame([(i, t, 1.0) for i, t in questions], "item_id long, text string, rank double")


def test_equals_plain_ranking(spark):
    body = texts(400, 1)
    docs = list(enumerate(body)) + [(1000 + i, body[5]) for i in range(30)] + [(5, body[5]), (None, body[9]), (None, body[9]), (2000, None), (2001, ""), (2002, "?!")]
    questions = list(enumerate(texts(25, 2, 12))) + [(3, "w1 w2 w2"), (None, "w7"), (50, None), (51, "..."), (52, "nowhere"), (53, "the nowhere")]
    for k, block in ((50, 400_000), (7, 200), (1, 1)):
        d, q = tables(spark, docs, questions)
        assert got(search.rank_documents(d, q, k=k, block=block)) == plain(docs, questions, k)


def test_questions_in_blocks(spark):
    docs, questions = list(enumerate(texts(150, 3))), list(enumerate(texts(20, 4, 10)))
    d, q = tables(spark, docs, questions)
    assert len(list(search.question_blocks(q.select("item_id", "text"), most_terms=9))) > 5
    assert got(search.rank_documents(d, q, k=10, most_terms=9)) == plain(docs, questions, 10)


def test_empty_tables(spark):
    d, q = tables(spark, [(1, "a b")], [(1, "a")])
    assert search.rank_documents(d.where("false"), q).count() == 0
    assert search.rank_documents(d, q.where("false")).count() == 0


def test_long_texts_are_cut_between_terms(monkeypatch):
    text = (" ".join(texts(200, 5)) + "é" * 3000 + " Z").encode()
    whole = search.term_counts(text)
    monkeypatch.setattr(search, "PIECE", 64)
    assert search.term_counts(text) == whole
    assert whole == Counter({t.encode(): n for t, n in terms(text.decode()).items()})


def test_documents_that_cannot_beat_the_heap_are_jumped_over():
    rnd = random.Random(6)
    n = 20_000
    rare = {rnd.randrange(n) for _ in range(60)}
    lists = [[0, 1] if i in rare else [0] for i in range(n)]
    ends = np.concatenate(([0], np.cumsum([len(x) for x in lists])))
    flat = np.array([t for x in lists for t in x])
    weights = np.array([100, 9000])

    class Read(list):
        reads = 0

        def __getitem__(self, at):
            Read.reads += 1
            return list.__getitem__(self, at)

    block = search._Block(list(range(n)), np.full(n, 10), ends, flat, np.ones(len(flat), np.int64), weights, n, 10 * n)
    docs, impacts = block.of(0)
    block._lists[0] = (docs, Read(impacts))
    heap = []
    search.wand(block, np.array([0, 1]), heap, 20)
    assert sorted(-i for _, i in heap) == sorted(rare)[:20]
    assert Read.reads < sorted(rare)[19] + 100  # from the twentieth on, only documents with the rare term are read
