import random
import re

from riskloom.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_targets(sizes, weights=(5, 2, 1), most=3.0):
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, capped, free = sum(sizes.values()), {}, set(sizes)
    while free:
        level = (total - sum(capped.values())) / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > most * sizes[s]]
        if not over:
            break
        for s in over:
            capped[s] = most * sizes[s]
            free.discard(s)
    return {s: capped.get(s, level * weight[s] if free else 0.0) for s in sizes}


def documents(seed=3):
    rnd = random.Random(seed)
    rows = []
    for source, n in (("a", 120), ("b", 9), ("é", 40), (None, 25), ("Z", 2), ("c", 30)):
        for _ in range(n):
            rows.append((len(rows), source, " ".join("w" for _ in range(rnd.choice([0, 1, 5, 20, 60, 200])))))
    rows += [(5, "a", rows[5][2])] * 3 + [(None, "a", "x y z"), (999, "b", None), (1000, "c", "\x1ctwo words\x0bthree")]
    return rows


def test_mix(spark):
    rows = documents()
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, source string, text string, size int, copies int")
    got = mixing.mix_sources(df, fan_in=16).collect()
    size = {i: 0 for i in ()}
    sizes = {}
    for _, s, t in rows:
        sizes[s] = sizes.get(s, 0) + len(WORD.findall(t or ""))
    want = plain_targets(sizes)
    assert len(got) == len(rows) and not size
    assert sorted((str(r["doc_id"]), r["size"]) for r in got) == sorted((str(i), len(WORD.findall(t or ""))) for i, _, t in rows)
    of = {round(v): s for s, v in sizes.items()}
    assert len(of) == len(sizes)
    taken = {}
    for r in got:
        s = of[r["source_size"]]
        assert abs(r["target"] - want[s]) < 1e-6 and 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"]
        taken[s] = taken.get(s, 0) + r["taken"]
    for s, t in taken.items():
        if sizes[s] > 500:
            assert abs(t - want[s]) <= 0.02 * want[s], (s, t, want[s])
    again = mixing.mix_sources(df.repartition(7, "source"), fan_in=16).collect()
    key = lambda r: (str(r["doc_id"]), r["size"], r["taken"])
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_targets_match_rounds(spark):
    for sizes in ({"a": 10, "b": 1000, "c": 5, None: 7}, {"a": 0, "b": 0}, {"a": 3}, {"a": 1, "b": 1, "c": 1, "d": 100, "e": 0}):
        df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, source_size long")
        got = {r["source"]: r["target"] for r in mixing.source_targets(df).collect()}
        want = plain_targets(sizes)
        assert all(abs(got[s] - want[s]) < 1e-9 for s in sizes), (sizes, got, want)


def test_empty_and_repeating(spark):
    none = spark.createDataFrame([], "doc_id long, source string, text string")
    assert mixing.mix_sources(none).count() == 0
    df = spark.createDataFrame([(i, "ab"[i % 2], "one two three", i) for i in range(20)], "doc_id long, source string, text string, copies int")
    out = mixing.repeat_to_mix(df)
    assert out.columns == df.columns
    mixed = {r["doc_id"]: r["copies"] for r in mixing.mix_sources(df).collect()}
    assert sorted(r["doc_id"] for r in out.collect()) == sorted(i for i, n in mixed.items() for _ in range(n))


def test_many_sources(spark):
    rows = [(i, f"s{i:03d}", "w " * (1 + i % 7)) for i in range(300)] + [(1000 + i, "s000", "w " * (1 + i % 5)) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = mixing.mix_sources(df, fan_in=16).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(i for i, _, _ in rows)
    sizes = {}
    for i, s, t in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    want, source = plain_targets(sizes), {i: s for i, s, _ in rows}
    for r in got:
        assert abs(r["target"] - want[source[r["doc_id"]]]) < 1e-6 and 0 <= r["taken"] <= 3 * r["size"]


def test_rows_without_or_with_the_same_id_have_their_own_copies(spark, monkeypatch):
    rnd = random.Random(4)
    rows = [(None, "ab"[i % 2], "w " * rnd.choice([1, 3, 50]), i) for i in range(120)] + [(7, "a", "w " * rnd.choice([2, 9]), i) for i in range(120, 180)] + [(i, "c", "x y", i) for i in range(200, 260)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, place int")
    monkeypatch.setattr(mixing, "BLOCK", 10)  # equal rows are numbered in several parts
    mixed = mixing.mix_sources(df)
    out = mixing.repeat_to_mix(df).collect()
    key = lambda r: (str(r[0]), len(r[2].split()))
    wanted = {}
    for r in mixed.collect():
        k = (str(r["doc_id"]), r["size"])
        wanted[k] = wanted.get(k, 0) + r["copies"]
    taken, of_place = {}, {}
    for r in out:
        taken[key(r)] = taken.get(key(r), 0) + 1
        of_place[r["place"]] = of_place.get(r["place"], 0) + 1
    assert taken == {k: n for k, n in wanted.items() if n}
    assert max(of_place.values()) <= 3
    lengths = {}
    for _, s, t, i in rows:
        lengths[s] = lengths.get(s, 0) + len(t.split())
    got = {}
    for r in out:
        got[r["source"]] = got.get(r["source"], 0) + len(r["text"].split())
    for s, target in plain_targets(lengths).items():
        assert abs(got.get(s, 0) - target) <= 50, (s, got, target)
