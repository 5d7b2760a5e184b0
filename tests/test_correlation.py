"""Prints, pairs of payloads, publishers and ancestry against plain recurrences."""

import hashlib
import random
from collections import Counter
from datetime import datetime

from pyspark.sql import functions as F

from riskloom.functions import codeprint
from riskloom.operators import ancestry, correlate
from riskloom.operators.ranks import head_lists, heads
from riskloom.plans import queries, storage
from riskloom.sources import feeds

BASE, PRIME = 1_000_003, (1 << 61) - 1


def rolled(tokens, gram):
    """One hash after the other, each from the last."""
    values = [int.from_bytes(hashlib.blake2b(t.encode(), digest_size=6).digest(), "big") for t in tokens]
    out, h = [], 0
    for i, v in enumerate(values):
        h = (h * BASE + v) % PRIME
        if i >= gram:
            h = (h - values[i - gram] * pow(BASE, gram, PRIME)) % PRIME
        if i >= gram - 1:
            out.append(h)
    return out


def test_hashes_equal_a_rolling_recurrence():
    rnd = random.Random(1)
    words = ["id", "num", "str", "(", ")", "=>", "function", "{", "}", "é", "x" * 50]
    for _ in range(1_000):
        tokens = [rnd.choice(words) for _ in range(rnd.randint(0, 40))]
        assert codeprint.gram_hashes(tokens).tolist() == rolled(tokens, 9)
    tokens = [rnd.choice(words) for _ in range(30)]
    assert codeprint.gram_hashes(["a", "b", *tokens])[-22:].tolist() == codeprint.gram_hashes(tokens).tolist()


def test_the_largest_values_stay_exact(monkeypatch):
    monkeypatch.setattr(codeprint, "token_hash", lambda t: (1 << 48) - 1)
    h = 0
    for _ in range(9):
        h = (h * BASE + (1 << 48) - 1) % PRIME
    assert codeprint.gram_hashes(["a"] * 9).tolist() == [h]
    import numpy as np

    top = np.array([PRIME - 1], dtype=np.uint64)
    assert int(codeprint._times_base_plus(top, np.array([(1 << 48) - 1], dtype=np.uint64))[0]) == ((PRIME - 1) * BASE + (1 << 48) - 1) % PRIME


def test_winnowing_keeps_each_windows_least():
    rnd = random.Random(2)
    hashes = codeprint.gram_hashes([rnd.choice("abcdef") for _ in range(300)])
    assert codeprint.winnow(hashes) == sorted({min(hashes.tolist()[i : i + 6]) for i in range(len(hashes) - 5)})


def test_labels(spark):
    prints = [5, 1, (1 << 61) - 2]
    digest = hashlib.blake2b(digest_size=8)
    for p in sorted(prints):
        digest.update(p.to_bytes(8, "big"))
    assert codeprint.label(prints) == codeprint.label(prints[::-1]) == digest.hexdigest()
    rows = spark.createDataFrame([(prints,), ([],), (None,)], "p array<bigint>").select(codeprint.label_of("p").alias("l")).collect()
    assert [r["l"] for r in rows] == [digest.hexdigest(), None, None]


FILES = "pkg_key string, rel string, owner string, prints array<bigint>"


def pairs_of(spark, files):
    rows = spark.createDataFrame(files, FILES).withColumn("class", correlate.print_class(F.col("prints")))
    found = correlate.payload_pairs(correlate.print_classes(rows))
    by_class = {}
    for r in rows.collect():
        by_class.setdefault(r["class"], []).append(r["pkg_key"])
    return sorted(tuple(sorted([min(by_class[r["a"]]), min(by_class[r["b"]])])) for r in found.collect())


def test_pairs_of_one_package_or_owner_are_refused(spark):
    body = list(range(20))
    more = [*body, 100]
    assert pairs_of(spark, [("a", "x", None, body), ("b", "x", None, more)]) == [("a", "b")]
    assert pairs_of(spark, [("a", "x", None, body), ("a", "y", None, more)]) == []
    assert pairs_of(spark, [("a", "x", "o", body), ("b", "x", "o", more)]) == []
    assert pairs_of(spark, [("a", "x", "o", body), ("b", "x", "p", more)]) == [("a", "b")]
    # a class of one owner meets one that an outsider is in as well
    assert pairs_of(spark, [("a", "x", "o", body), ("b", "x", "o", more), ("c", "x", None, more)]) == [("a", "b")]
    # too little in common, or too little of the smaller
    assert pairs_of(spark, [("a", "x", None, body[:7]), ("b", "x", None, more)]) == []
    assert pairs_of(spark, [("a", "x", None, body), ("b", "x", None, [*body[:15], *range(50, 60)])]) == []


def test_equal_labels_do_not_link(spark, monkeypatch):
    rows = spark.createDataFrame([("a", None), ("b", None)], "pkg_key string, owner string")
    found = spark.createDataFrame([("a", "x", list(range(20))), ("b", "x", list(range(40, 60)))], "pkg_key string, rel string, prints array<bigint>")
    assert correlate.payload_links(found, rows).links.count() == 0


def test_a_scope_links_to_an_outsider_alone(spark):
    prints = list(range(20))
    rows = spark.createDataFrame([("a", "s"), ("b", "s"), ("c", None), ("d", "t"), ("e", "t")], "pkg_key string, owner string")
    files = [(k, "x.js", prints) for k in "abc"] + [(k, "x.js", [*range(100, 130)]) for k in "de"]
    found = correlate.payload_links(spark.createDataFrame(files, "pkg_key string, rel string, prints array<bigint>"), rows)
    (link,) = found.links.collect()
    assert link["n"] == 3 and "under 2 separate owners" in link["detail"] and link["key"] == codeprint.label(prints)
    assert sorted(r["pkg_key"] for r in found.members.collect()) == ["a", "b", "c"]


def test_earlier_publishers(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice("ab"), f"v{i}", rnd.choice([f"2024-01-{d:02}" for d in range(1, 25)] + [None]), rnd.choice([None, *"pqrstuvw"]), rnd.choice([None, 0, 5, 9])) for i in range(200)]
    df = spark.createDataFrame(rows, "name string, version string, published_at string, publisher string, unpacked_size long")
    got = {r["version"]: (r["n_prior_publishers"], r["prior_publishers"], r["publisher_new"]) for r in feeds.release_history(df).collect()}
    want = {}
    for name, version, at, publisher, _ in rows:
        if at is not None:
            prior = {p for n, _, t, p, _ in rows if n == name and t is not None and t < at and p is not None}
            want[version] = (len(prior), sorted(prior)[:3], publisher not in prior)
    drop_null = lambda d: {k: v if next(r[3] for r in rows if r[1] == k) else v[:2] for k, v in d.items()}
    assert drop_null(got) == drop_null(want)


def plain_tags(parents, tags):
    above = {}
    for sha, parent, _ in parents:
        above.setdefault(sha, []).append(parent)
    out = set()
    for tag, sha in tags:
        todo, seen = [sha], {sha}
        while todo:
            out.add((at := todo.pop(), tag))
            for p in above.get(at, ()):
                if p not in seen:
                    seen.add(p)
                    todo.append(p)
    return out


def ancestry_of(spark, shas, parents, tags):
    c = spark.createDataFrame([(s,) for s in shas], "sha string")
    p = spark.createDataFrame(parents, "sha string, parent string, place int")
    t = spark.createDataFrame(tags, "tag string, sha string")
    return {(r["sha"], r["tag"]) for r in ancestry.tags_containing(c, p, t, c).collect()}


def test_tags_over_random_histories(spark):
    for seed in (4, 5):
        rnd = random.Random(seed)
        shas = [f"s{i:03}" for i in range(60)]
        parents = []
        for i, s in enumerate(shas[1:], 1):
            for place, p in enumerate(rnd.sample(range(max(0, i - 6), i), min(i, rnd.choice([1, 1, 1, 2, 3])))):
                parents.append((s, shas[p], place))
        tags = [(f"t{i}", rnd.choice(shas)) for i in range(12)] + [("same", shas[20]), ("again", shas[20])]
        assert ancestry_of(spark, shas, parents, tags) == plain_tags(parents, tags)


def test_a_long_line_with_branches_is_two_rounds(spark):
    n = 300
    parents = [(f"m{i:04}", f"m{i - 1:04}", 0) for i in range(1, n)]
    for i in range(10, n, 20):
        parents += [(f"b{i:04}", f"m{i - 5:04}", 0), (f"m{i:04}", f"b{i:04}", 1)]
    shas = sorted({x for a, b, _ in parents for x in (a, b)})
    placed = ancestry.chains(spark.createDataFrame([(s,) for s in shas], "sha string"), spark.createDataFrame(parents, "sha string, parent string, place int"))
    main = {r["sha"]: (r["chain"], r["pos"]) for r in placed.collect()}
    assert all(main[f"m{i:04}"] == ("m0000", i) for i in range(n))
    tags = [("old", "m0040"), ("new", f"m{n - 1:04}"), ("side", "b0050")]
    assert ancestry_of(spark, shas, parents, tags) == plain_tags(parents, tags)


def test_parents_beyond_a_shallow_clone(spark):
    assert ancestry_of(spark, ["a", "b"], [("a", "gone", 0), ("b", "a", 0)], [("t", "b"), ("u", "gone")]) == {("a", "t"), ("b", "t")}


def test_histories_of_tags_are_dealt_by_keys(spark):
    c = spark.createDataFrame([("a",), ("b",), ("c",)], "sha string")
    p = spark.createDataFrame([("b", "a", 0), ("b", "a", 1), ("c", "b", 0)], "sha string, parent string, place int")
    t = spark.createDataFrame([("t", "b"), ("t", "c"), ("u", "a")], "tag string, sha string")
    found = ancestry.tags_containing(c, p, t, c.unionByName(c))
    assert sorted(map(tuple, found.collect())) == [("a", "t"), ("a", "u"), ("b", "t"), ("c", "t")]
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_heads_of_groups(spark):
    rnd = random.Random(7)
    rows = [(rnd.choice("xyz"), rnd.randint(0, 30), f"n{i}") for i in range(500)]
    df = spark.createDataFrame(rows, "g string, v int, name string").repartition(9)
    want = {g: sorted((v, n) for a, v, n in rows if a == g) for g in "xyz"}
    got = {}
    for r in heads(df, ["g"], ["v", "name"], 4).orderBy("g", "turn").collect():
        got.setdefault(r["g"], []).append((r["v"], r["name"]))
    assert got == {g: w[:4] for g, w in want.items()}
    lists = {r["g"]: (r["names"], r["n"]) for r in head_lists(df, ["g"], ["v", "name"], 3, "name", "names", "n").collect()}
    assert lists == {g: ([n for _, n in w[:3]], len(w)) for g, w in want.items()}
    assert "WindowGroupLimit" in heads(df, ["g"], ["v"], 4)._jdf.queryExecution().executedPlan().toString()


def test_pairs_that_cannot_agree_are_no_candidates(spark):
    rare = [(i, [f"r{i // 2}"] + [f"w{i}-{j}" for j in range(20)]) for i in range(40)]  # one rare word in common, nothing else
    alike = [(100, [f"s{j}" for j in range(20)]), (101, [f"s{j}" for j in range(4, 20)] + [f"t{j}" for j in range(30)]), (102, [f"s{j}" for j in range(5, 20)] + [f"v{j}" for j in range(30)])]
    classes = spark.createDataFrame(rare + alike, "class long, prints array<string>")
    proposed = {(r["a"], r["b"]) for r in correlate.candidate_pairs(classes).collect()}
    found = {(r["a"], r["b"], len(r["common"])) for r in correlate.similar_classes(classes).collect()}
    assert found == {(100, 101, 16)}  # 16 of 20 are four fifths, 15 are not
    assert (100, 101) in proposed and not any(a < 40 for a, _ in proposed)


def test_history_names_every_earlier_publisher(spark):
    rows = [("a", f"1.{i}", f"2024-01-{i + 1:02}T00:00:00", f"p{9 - i}", None) for i in range(6)]
    df = spark.createDataFrame(rows, "name string, version string, published_at string, publisher string, unpacked_size bigint")
    got = {r["version"]: r["prior_publishers"] for r in feeds.release_history(df, every=True).collect()}
    assert got["1.0"] == [] and got["1.5"] == ["p5", "p6", "p7", "p8", "p9"]


def test_of_sizes_at_one_time_that_of_the_greatest_version_counts(spark):
    rows = [("a", f"1.{i}", "2024-01-01T00:00:00", "p", 100 + (i * 7) % 10) for i in range(10)] + [("a", "2.0", "2024-01-02T00:00:00", "p", 1)]
    df = spark.createDataFrame(rows, "name string, version string, published_at string, publisher string, unpacked_size bigint")
    for laid in (df.orderBy("version"), df.orderBy(F.desc("version"))):
        got = {r["version"]: r["prior_unpacked_size"] for r in feeds.release_history(laid.repartition(1)).collect()}
        assert got["2.0"] == 103


def test_to_a_release_without_a_time_all_others_are_earlier(spark):
    rows = [("a", "1.0", "2024-01-01T00:00:00", "p", 7), ("a", "1.1", "2024-01-02T00:00:00", "q", 8), ("a", "1.2", None, "r", 9), ("a", "1.3", None, "p", 10)]
    df = spark.createDataFrame(rows, "name string, version string, published_at string, publisher string, unpacked_size bigint")
    got = {r["version"]: (r["prior_publishers"], r["publisher_new"], r["prior_unpacked_size"]) for r in feeds.release_history(df).collect()}
    assert got == {"1.0": ([], True, None), "1.1": (["p"], True, 7), "1.2": (["p", "q"], True, 8), "1.3": (["p", "q"], False, 8)}


def _events(spark, folder, more):
    rows = [(i, datetime(2024, 1, 2 + 2 * i), 1, "view", 10.0 + 40 * (i % 2)) for i in range(1, 13)] + more
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").write.parquet(f"{folder}/events.parquet")
    return str(folder)


def test_releases_with_empty_columns_are_named_as_in_sql(spark, tmp_path):
    folder = _events(spark, tmp_path, [(97, datetime(2024, 1, 5), None, None, 1.0), (98, None, 1, "view", 1.0)])
    got = {(r["name"], r["version"]): (r["n_prior"], r["is_new"]) for r in queries.release_history(spark, folder).collect()}
    assert len(got) == 14 and got["pkg", "1.97"] == (0, True) and got["pkg1", "1.98"] == (12, False)


def test_a_release_told_twice_is_judged_once_a_record(spark, tmp_path):
    once = Counter(queries.registry_rules(spark, _events(spark, tmp_path / "once", [])).collect())
    again = Counter(queries.registry_rules(spark, _events(spark, tmp_path / "twice", [(6, datetime(2024, 1, 14), 1, "view", 10.0)])).collect())
    assert sum(once.values()) > 0 and {r: n for r, n in again.items() if r["version"] != "1.6"} == {r: n for r, n in once.items() if r["version"] != "1.6"}
    assert {r: n for r, n in again.items() if r["version"] == "1.6"} == {r: 2 * n for r, n in once.items() if r["version"] == "1.6"}


def test_pairs_met_in_rounds_are_the_same_and_leave_little_on_disk(spark, monkeypatch):
    rows = [(i, [f"s{i // 4}-{j}" for j in range(20 - i % 4)] + [f"own{i}", "everywhere"]) for i in range(120)]
    classes = spark.createDataFrame(rows, "class long, prints array<string>")
    once = sorted((r["a"], r["b"], len(r["common"])) for r in correlate.similar_classes(classes).collect())
    monkeypatch.setattr(correlate, "AT_ONCE", 0)
    monkeypatch.setattr(correlate, "COMMONEST", 1)
    mark = storage.written()
    files = lambda: spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(",")
    before = set(files().split(","))
    found = correlate.similar_classes(classes)
    shuffled = [f for f in set(files().split(",")) - before if "shuffle_" in f and f.endswith(".data")]
    left = {p.rsplit("/", 1)[1].rsplit("-", 1)[0] for p in storage._written[mark:]}
    assert left == {"sketch-sets", "sketch-near", "sketch-candidates", "sketch-asked"} and not shuffled
    assert sorted((r["a"], r["b"], len(r["common"])) for r in found.collect()) == once and len(once) == 180
