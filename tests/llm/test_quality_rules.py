import math
import random
import re
from collections import Counter

from riskloom.llm import quality_rules as quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")
NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def counts(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    flat = "".join(words)
    return len(words), len(flat), len(re.findall("[#*$%&|<>]", flat)), len(lines) - len(set(lines)), len(covered)


def bins(text):
    flat = "".join(WORD.findall(text or ""))
    others = [len(re.findall(p, flat)) for p in quality.CLASSES.values()]
    return [len(flat) - sum(others), *others]


def distance(p, q):
    m = [(a + b) / 2 for a, b in zip(p, q)]
    side = lambda x: sum(a * math.log2(a / b) for a, b in zip(x, m) if a > 0)
    return math.sqrt(max(0, (side(p) + side(q)) / 2))


def plain(docs):
    """``kept`` of every (doc_id, text, lang), by loops."""
    spoken = {}
    for _, text, lang in docs:
        if lang is not None:
            spoken.setdefault(lang, []).append(text or "")
    references = {}
    for lang, all_ in spoken.items():
        words = Counter(w for t in all_ for w in WORD.findall(t))
        n = words.total()
        if n >= 1_000:
            top = sorted(((-c, w) for w, c in words.items() if re.search(quality.LETTERS, w)))[:50]
            sums = [sum(x) for x in zip(*(bins(t) for t in all_))]
            references[lang] = ([x / sum(sums) for x in sums], [(w, -c / n) for c, w in top])
    out = []
    for i, text, lang in docs:
        n, chars, *_, repeats = counts(text)
        failed = n < 50 or 100 * repeats > 50 * n
        fits = not references or (lang is not None and lang not in references)
        words, shape = Counter(WORD.findall(text or "")), bins(text)
        for shares, common in references.values() if not failed else ():
            p = [words[w] / n for w, _ in common]
            by_words = distance([*p, 1 - sum(p)], [*(q for _, q in common), 1 - sum(q for _, q in common)])
            fits |= (chars < 200 or distance([x / chars for x in shape], shares) <= 0.3) and (n < 100 or by_words <= 0.45)
        out.append((i, *counts(text), failed, not failed and fits))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", *NAMES, "base_failed", "kept").collect()), key=repr)


def prose(rnd, lang, n):
    common = {"en": "the of and to in is that it for was".split(), "fr": "de la le et les des en que un du".split()}[lang]
    rest = {"en": "river stone Window paper garden yellow,", "fr": "rivière pierre fenêtre Papier jardin jaune."}[lang].split()
    return " ".join(rnd.choice(common) if rnd.random() < 0.4 else rnd.choice(rest) + rnd.choice("abcdefghij") for _ in range(n))


def corpus():
    rnd = random.Random(3)
    docs = [(i, prose(rnd, lang, rnd.randint(30, 300)), lang) for i, lang in enumerate(["en", "fr"] * 30)]
    docs += [(100, " ".join(f"w{rnd.random()}&&&" for _ in range(120)), "en"), (101, prose(rnd, "en", 150).upper(), "fr"), (102, " ".join(f"{i}" for i in range(200)), None)]
    docs += [(103, prose(rnd, "fr", 120), None), (104, " ".join(f"#{i}#" for i in range(60)), "xx"), (105, None, "en"), (106, "", None), (107, "a b c " * 40, "en")]
    docs += [(108, "one two\n\none two\n \n \none two\nthree", "en"), (None, docs[0][1], "en"), (0, docs[0][1], "en"), (109, "|" * 10, "fr")]
    return docs


def table(spark, docs):
    return spark.createDataFrame([(i, t, g, 5, "x") for i, t, g in docs], "doc_id long, text string, lang string, n_words int, kept string").repartition(3)


def test_equals_plain_loops(spark):
    docs = corpus()
    assert got(quality.judge_quality(table(spark, docs))) == plain(docs)
    verdict = {r[0]: r[-1] for r in plain(docs)}
    assert not any(verdict[i] for i in (100, 101, 102, 105, 106, 107)) and verdict[103] and verdict[104]


def test_without_a_reference_all_but_the_base_failures_stay(spark):
    docs = [(i, t, None) for i, t, _ in corpus()]
    found = got(quality.judge_quality(table(spark, docs)))
    assert found == plain(docs) and all(r[-1] is not r[-2] for r in found)
    assert quality.judge_quality(table(spark, docs).where("false")).count() == 0


def test_repeated_windows(spark):
    rnd = random.Random(4)
    docs = [(i, "".join(rnd.choice("abc") + rnd.choice([" ", "\n", "  ", "\t", "\x0b"]) for _ in range(rnd.randint(0, 40))), None) for i in range(300)]
    rows = table(spark, docs).select("doc_id", "text")
    found = {r["doc_id"]: tuple(r[n] for n in NAMES) for r in quality.text_counts(rows, "doc_id").collect()}
    assert found == {i: counts(t) for i, t, _ in docs}
