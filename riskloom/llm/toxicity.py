"""Toxicity by class-conditional Kneser-Ney models of the spelling of words.

Two interpolated Kneser-Ney models, one of toxic and one of ordinary documents,
give each character of a word its probability after the four before it.  Both
back off to one lower order, whose counts are shared: the number of different
grams, of either class, that a shorter gram ends.  A spelling that only one
class has seen is then told by the counts, a rare one by the backoff, and one
that neither has seen by neither.  A word's evidence is the difference of its
two log-likelihoods over its length, a word shorter than the longest gram counting
as one of that length, so that a letter or two prove little; a document's is that
of its strongest word, which a logistic curve turns into a score.

All labelled rows are counted, in Spark, and every gram counted is kept, in two
tables of all grams and of all contexts.  Up to ``MOST_SENT`` grams they are sent
to the workers as sorted arrays.  Beyond, they stay in Spark: the different words
meet them by joins, the ``HOT_WORDS`` words of most documents are sent with their
evidence and the others' evidence is joined to the documents.  Evidence is
a multiple of 2**-20, so that its sums are exact and both ways agree.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chargrams import LETTERS, WordGrams
from .runtime import keyed, materialize, narrow, sent_small, table, thrifty, unused_name, without

#: Characters of a gram of the class-conditional order, and of the shared one.
ORDER, SHARED = 5, 3
#: The logistic curve is fitted on about so many labelled rows at most.
CURVE_ROWS = 20_000
#: Rows are scored in groups of about so many characters.
GROUP_CHARS = 500_000
#: Grams, and so contexts, that are sent to the workers at most: 20 bytes a row to the driver, 12 to a worker.
MOST_SENT = 2_000_000
#: Words of most documents whose evidence is sent beyond that, at 24 bytes each.
HOT_WORDS = 1 << 16
_MODELS = ("all", "first", "second")


def fold_of(doc_id: Column) -> Column:
    """The remainder by three of an id's checksum; null ids are in no fold."""
    return F.crc32(doc_id.cast("string")) % 3


def _words(text: str | None) -> list[str]:
    return LETTERS.findall((text or "").lower())


def _top_grams(grams: WordGrams) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Positions and, of the longest gram that ends at each: its id, its context, its shared gram, that one's context, its character."""
    at = np.nonzero(grams.last_blank >= 0)[0]
    start = np.maximum(at - (ORDER - 1), grams.last_blank[at])
    order = at - start + 1
    ids = {k: np.zeros(len(at), np.uint64) for k in ("gram", "context", "shared", "shared_context")}
    for n in range(2, ORDER + 1):
        these = order == n
        ends, k = at[these], min(SHARED, n - 1)
        ids["gram"][these] = grams.ids(n)[ends]
        ids["context"][these] = grams.ids(n - 1)[ends - 1]
        ids["shared"][these] = grams.ids(k)[ends]
        ids["shared_context"][these] = grams.ids(k - 1)[ends - 1]
    ids["letter"] = grams.codes[at]
    return at, {k: v.view(np.int64) for k, v in ids.items()}


# counting

_COUNTS = ("o0", "t0", "o1", "t1")


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(class and half, text) to word counts; what is held stays bounded, later sums join what was sent in parts."""

    def sent(held: dict[str, list[int]]) -> pa.RecordBatch:
        counts = np.array(list(held.values()), dtype=np.int64).reshape(-1, 4)
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), *[pa.array(counts[:, i]) for i in range(4)]], names=["word", *_COUNTS])

    held: dict[str, list[int]] = {}
    for batch in batches:
        for part, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            for word, n in Counter(_words(text.as_py())).items():
                row = held.get(word)
                if row is None:
                    row = held[word] = [0, 0, 0, 0]
                row[part] += n
            if len(held) > 200_000:
                yield sent(held)
                held = {}
    if held:
        yield sent(held)


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = batch.column(0).to_pylist()
        counts = np.stack([batch.column(i + 1).to_numpy() for i in range(4)], axis=1)
        grams = WordGrams(words)
        at, ids = _top_grams(grams)
        unique, first, back = np.unique(ids["gram"], return_index=True, return_inverse=True)
        word = grams.word[at]
        sums = [np.bincount(back, counts[word, i], minlength=len(unique)).astype(np.int64) for i in range(4)]
        yield pa.RecordBatch.from_arrays([pa.array(ids[k][first]) for k in ids] + [pa.array(s) for s in sums], names=[*ids, *_COUNTS])


def count_grams(texts: DataFrame) -> DataFrame:
    """``texts`` (toxic 0 or 1, half 0 or 1, text) to one row per gram with its counts by class and half."""
    parted = texts.select((F.col("half") * 2 + F.col("toxic")).cast("int").alias("part"), "text")
    words = sent_small(parted).mapInArrow(thrifty(_count_words), "word string, o0 long, t0 long, o1 long, t1 long")
    words = words.groupBy("word").agg(*[F.sum(c).alias(c) for c in _COUNTS])
    keys = ("gram", "context", "shared", "shared_context", "letter")
    schema = ", ".join(f"{k} long" for k in (*keys, *_COUNTS))
    grams = words.mapInArrow(thrifty(_count_grams), schema)
    return grams.groupBy("gram").agg(*[F.first(k).alias(k) for k in keys[1:]], *[F.sum(c).alias(c) for c in _COUNTS])


# the model


def _by_model() -> dict[str, tuple[Column, Column]]:
    """Of each model, the counts of ordinary and of toxic rows."""
    o0, t0, o1, t1 = (F.col(c) for c in _COUNTS)
    return {"all": (o0 + o1, t0 + t1), "first": (o0, t0), "second": (o1, t1)}


def _model_tables(grams: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Evidence of known grams, and of other characters after known contexts: ``(id, all, first, second)``."""
    total = F.col("o0") + F.col("t0") + F.col("o1") + F.col("t1")
    once = grams.agg(F.count_if(total == 1).alias("one"), F.count_if(total == 2).alias("two")).first()
    one, two = once["one"] or 0, once["two"] or 0
    discount = min(0.95, max(0.5, one / (one + 2 * two))) if one else 0.75

    shared = grams.groupBy("shared").agg(F.count("*").alias("n"), F.first("shared_context").alias("shared_context"), F.first("letter").alias("letter"))
    contexts = shared.groupBy("shared_context").agg(F.sum("n").alias("context_n"), F.count("*").alias("context_kinds"))
    letters = shared.groupBy("letter").agg(F.count("*").alias("letter_n"))
    kinds = max(1, shared.count())
    lower = F.greatest(F.col("n") - discount, F.lit(0.0)) / F.col("context_n") + discount * F.col("context_kinds") / F.col("context_n") * F.col("letter_n") / kinds
    lower = shared.join(contexts, "shared_context").join(letters, "letter").select("shared", lower.alias("lower"))

    models = _by_model()
    sums = [f(c).alias(f"{what}_{side}_{name}") for name, pair in models.items() for side, c in zip("ot", pair) for what, f in (("n", F.sum), ("kinds", lambda c: F.count_if(c > 0)))]
    seen = grams.groupBy("context").agg(*sums)

    def left_over(side: str, name: str) -> Column:
        return F.when(F.col(f"n_{side}_{name}") > 0, discount * F.col(f"kinds_{side}_{name}") / F.col(f"n_{side}_{name}")).otherwise(1.0)

    def chance(side: str, name: str) -> Column:
        count, n = models[name]["ot".index(side)], F.col(f"n_{side}_{name}")
        own = F.when(n > 0, F.greatest(count - discount, F.lit(0.0)) / n).otherwise(0.0)
        return own + left_over(side, name) * F.col("lower")

    joined = grams.join(seen, "context").join(lower, "shared")
    def evidence(of, name: str) -> Column:
        return (F.round((F.ln(of("t", name)) - F.ln(of("o", name))) * (1 << 20)) / (1 << 20)).cast("float").alias(name)

    known = joined.select(F.col("gram").alias("id"), *[evidence(chance, m) for m in _MODELS])
    other = seen.select(F.col("context").alias("id"), *[evidence(left_over, m) for m in _MODELS])
    return known, other


@dataclass
class ToxicityModel:
    """Two tables of evidence and the curve from a document's evidence to its score.

    ``joined`` has the tables in Spark if they are too large for the arrays, which are empty then.
    """

    known: tuple[np.ndarray, dict[str, np.ndarray]]
    other: tuple[np.ndarray, dict[str, np.ndarray]]
    slope: float = 0.0
    offset: float = -30.0
    joined: tuple[DataFrame, DataFrame] | None = None

    def only(self, *models: str) -> ToxicityModel:
        """The same curve and tables, without the evidence of other models."""
        (known, k), (other, o) = self.known, self.other
        return ToxicityModel((known, {m: k[m] for m in models}), (other, {m: o[m] for m in models}), self.slope, self.offset)

    def evidence(self, words: list[str], model: str = "all") -> np.ndarray:
        """Difference of the log-likelihoods of each word, over its length or ``ORDER``, if that is more."""
        if not words:
            return np.zeros(0)
        grams = WordGrams(words)
        at, ids = _top_grams(grams)
        found = np.zeros(len(at), np.float32)
        missing = np.ones(len(at), bool)
        for (tags, values), key in ((self.known, "gram"), (self.other, "context")):
            if not len(tags):
                continue
            place = np.minimum(np.searchsorted(tags, ids[key]), len(tags) - 1)
            hit = missing & (tags[place] == ids[key])
            found[hit] = values[model][place[hit]]
            missing &= ~hit
        word = grams.word[at]
        return np.bincount(word, found, minlength=len(words)) / np.maximum(np.bincount(word, minlength=len(words)), ORDER)

    def strongest(self, texts: list[str | None], model: str = "all") -> list[tuple[float, str | None]]:
        """Evidence of each text's strongest word, and the word; zero and None if it has none."""
        index: dict[str, int] = {}
        each = [[index.setdefault(w, len(index)) for w in set(_words(t))] for t in texts]
        words = list(index)
        values = self.evidence(words, model)
        out = []
        for places in each:
            if not places:
                out.append((0.0, None))
                continue
            found = np.array(places)
            top = values[found].max()
            out.append((float(top), min(words[i] for i in found[values[found] == top])))
        return out

    def score(self, evidence: float) -> float:
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, self.slope * evidence + self.offset))))


# documents and a model too large to send


def _block_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(.., .., text) to the different words of a group of rows, with the number of rows that hold each."""
    for batch in _grouped(batches, 2):
        counts = Counter(w for t in batch.column(2) for w in set(_words(t.as_py())))
        yield pa.RecordBatch.from_arrays([_digests(counts), pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["w", "word", "n"])


def _digests(words) -> pa.Array:
    return pa.array([xxhash.xxh3_128_digest(w.encode("utf-8", "surrogatepass")) for w in words], pa.binary())


def _word_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(w, word) to a row per place of a word: its gram and that one's context."""
    for batch in _grouped(batches, 1):
        grams = WordGrams(batch.column(1).to_pylist())
        at, ids = _top_grams(grams)
        names = batch.column(0).take(pa.array(grams.word[at]))
        yield pa.RecordBatch.from_arrays([names, pa.array(ids["gram"]), pa.array(ids["context"])], names=["w", "gram", "context"])


def _strongest_rows(rows: DataFrame, joined: tuple[DataFrame, DataFrame], model: str) -> DataFrame:
    """``(row_file, row_place, evidence, expression)`` of ``rows`` (row_file, row_place, text), as ``ToxicityModel.strongest`` has it."""
    words = sent_small(rows).mapInArrow(thrifty(_block_words), "w binary, word string, n long").groupBy("w").agg(F.first("word").alias("word"), F.sum("n").alias("n"))
    words = materialize(words, "toxicity-words")
    known, other = (df.select(F.col("id").alias(key), F.col(model).alias(f"by_{key}")) for df, key in zip(joined, ("gram", "context")))
    places = words.select("w", "word").mapInArrow(thrifty(_word_grams), "w binary, gram long, context long")
    places = places.join(known, "gram", "left").join(other, "context", "left")
    value = F.coalesce("by_gram", "by_context", F.lit(0.0)).cast("double")
    found = words.join(places.groupBy("w").agg((F.sum(value) / F.greatest(F.count("*"), F.lit(ORDER))).alias("evidence")), "w")
    found = materialize(found, "toxicity-words-scored")

    hot = found.select("w", "n", "evidence").orderBy(F.desc("n"), "w").limit(HOT_WORDS).toArrow()
    sent = rows.sparkSession.sparkContext.broadcast(dict(zip(hot.column("w").to_pylist(), hot.column("evidence").to_pylist())))  # HOT_WORDS at most

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _grouped(batches, 2):
            best, rest = [], []
            for text in batch.column(2):
                known_best, unknown = None, []
                different = list(set(_words(text.as_py())))
                for word, w in zip(different, _digests(different).to_pylist()):
                    evidence = sent.value.get(w)
                    if evidence is None:
                        unknown.append(w)
                    elif known_best is None or (-evidence, word) < known_best:
                        known_best = (-evidence, word)
                best.append(known_best)
                rest.append(unknown)
            arrays = [pa.array([b and b[0] for b in best], pa.float64()), pa.array([b and b[1] for b in best], pa.string()), pa.array(rest, pa.list_(pa.binary()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], names=["row_file", "row_place", "less", "word", "rest"])

    at = ["row_file", "row_place"]
    seen = materialize(sent_small(rows).mapInArrow(thrifty(each), "row_file long, row_place long, less double, word string, rest array<binary>"), "toxicity-hot")
    pair = F.struct((-F.col("evidence")).alias("less"), "word")
    rare = seen.select(*at, F.explode("rest").alias("w")).join(found.select("w", "word", "evidence"), "w").groupBy(*at).agg(F.min(pair).alias("best"))
    frequent = seen.where("word IS NOT NULL").select(*at, F.struct("less", "word").alias("best"))
    best = rare.unionByName(frequent).groupBy(*at).agg(F.min("best").alias("best"))
    return best.select(*at, (-F.col("best.less")).alias("evidence"), F.col("best.word").alias("expression"))


def _score_by_joins(docs: DataFrame, model: ToxicityModel, text: str, stay: list[str]) -> DataFrame:
    """``score_toxicity`` with a model too large to send."""
    rows, at = keyed(docs)
    best = _strongest_rows(narrow(rows, row_file=at[0], row_place=at[1], text=text), model.joined, "all")
    best = best.select(F.col("row_file").alias(at[0]), F.col("row_place").alias(at[1]), F.col("evidence").alias("toxicity"), "expression")
    kept = rows.select(*[f"`{c}`" for c in stay], *at).join(best, at, "left")
    power = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), model.slope * F.coalesce("toxicity", F.lit(0.0)) + model.offset))
    return kept.select(*[f"`{c}`" for c in stay], (1.0 / (1.0 + F.exp(-power))).alias("toxicity"), "expression")


def _fit_curve(evidence: np.ndarray, toxic: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Slope and offset of a logistic curve; either class weighs the same, and the ridge keeps the slope finite."""
    weight = np.where(toxic == 1, 0.5 / max(1, (toxic == 1).sum()), 0.5 / max(1, (toxic == 0).sum()))
    x = np.stack([evidence, np.ones_like(evidence)], axis=1)
    w = np.zeros(2)
    penalty = np.diag([ridge, 1e-6])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x + penalty, x.T @ (weight * (toxic - p)) - penalty @ w)
        size = np.abs(step).max()
        w += step * min(1.0, 5.0 / max(size, 1e-12))
        if size < 1e-8:
            break
    return float(w[0]), float(w[1])


def _collected(rows: DataFrame) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """A table of evidence as arrays, sorted by id."""
    got = rows.toArrow()
    tags = got.column("id").to_numpy()
    order = np.argsort(tags)
    return tags[order], {m: got.column(m).to_numpy()[order] for m in _MODELS}


def _grouped(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """Batches cut to about ``GROUP_CHARS`` characters of a text column."""
    for batch in batches:
        lengths = np.array([len(t.as_py() or "") for t in batch.column(column)], dtype=np.int64)
        group = (np.cumsum(lengths) - lengths) // GROUP_CHARS
        edges = np.concatenate((np.nonzero(np.diff(group, prepend=-1))[0], [len(lengths)]))
        for a, b in zip(edges[:-1], edges[1:]):
            yield batch.slice(a, b - a)


def _curve_rows_by_joins(chosen: DataFrame, joined: tuple[DataFrame, DataFrame]) -> DataFrame:
    """``(toxic, evidence)`` of ``chosen`` (toxic, half, text), each half by the model of the other."""
    rows, at = keyed(chosen)
    out = []
    for half, name in ((0, "second"), (1, "first")):
        part = rows.where(F.col("half") == half)
        best = _strongest_rows(narrow(part, row_file=at[0], row_place=at[1], text="text"), joined, name)
        best = best.select(F.col("row_file").alias(at[0]), F.col("row_place").alias(at[1]), "evidence")
        out.append(part.join(best, at, "left").select("toxic", F.coalesce("evidence", F.lit(0.0)).alias("evidence")))
    return out[0].unionByName(out[1])


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic") -> ToxicityModel:
    """Learn from the labelled rows whose fold is not 1.

    A document labelled more than once counts by its largest label; labels
    other than 0 and 1 are ignored.  Without rows of both classes every score is
    zero.  The curve is fitted on a bounded sample, of which each half is
    scored by the model that has not seen it.
    """
    marks = narrow(labels, doc_id=doc_id, toxic=toxic).where("toxic IN (0, 1)").where(fold_of(F.col("doc_id")) != 1)
    marks = marks.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    half = F.pmod(F.floor(F.crc32(F.col("doc_id").cast("string")) / 3), F.lit(2)).cast("int")
    rows = narrow(docs, doc_id=doc_id, text=text).where(fold_of(F.col("doc_id")) != 1).join(marks.hint("shuffle_hash"), "doc_id").select("doc_id", "toxic", half.alias("half"), "text")
    grams = materialize(count_grams(rows), "toxicity-grams")
    per_class = {r["toxic"]: r["n"] for r in marks.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(per_class) < 2 or grams.isEmpty():
        empty = (np.zeros(0, np.int64), {m: np.zeros(0, np.float32) for m in _MODELS})
        return ToxicityModel(empty, empty)
    known, other = _model_tables(grams)
    if grams.count() <= MOST_SENT:
        model = ToxicityModel(_collected(known), _collected(other))
    else:
        empty = (np.zeros(0, np.int64), {m: np.zeros(0, np.float32) for m in _MODELS})
        model = ToxicityModel(empty, empty, joined=(materialize(known, "toxicity-known"), materialize(other, "toxicity-other")))

    shares = {k: min(1.0, CURVE_ROWS / 2 / n) for k, n in per_class.items()}
    dice = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1_000_000)) / 1_000_000
    chosen = marks.where(dice < F.when(F.col("toxic") == 1, shares[1]).otherwise(shares[0]))  # about CURVE_ROWS rows at most
    chosen = narrow(docs, doc_id=doc_id, text=text).join(F.broadcast(chosen), "doc_id").select("toxic", half.alias("half"), "text")
    if model.joined:
        seen = _curve_rows_by_joins(chosen, model.joined).toPandas()  # about CURVE_ROWS rows
        if seen["toxic"].nunique() == 2:
            model.slope, model.offset = _fit_curve(seen["evidence"].to_numpy(), seen["toxic"].to_numpy())
        return model
    sent = docs.sparkSession.sparkContext.broadcast(model.only("first", "second"))

    def other_half(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _grouped(batches, 2):
            texts, halves = batch.column(2).to_pylist(), np.array(batch.column(1).to_pylist())
            found = np.zeros(len(texts))
            for h, name in ((0, "second"), (1, "first")):
                at = np.nonzero(halves == h)[0]
                found[at] = [x for x, _ in sent.value.strongest([texts[i] for i in at], name)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int32()), pa.array(found)], names=["toxic", "evidence"])

    seen = sent_small(chosen).mapInArrow(thrifty(other_half), "toxic int, evidence double").toPandas()
    if seen["toxic"].nunique() == 2:
        model.slope, model.offset = _fit_curve(seen["evidence"].to_numpy(), seen["toxic"].to_numpy())
    return model


def score_toxicity(docs: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """``docs`` with ``toxicity`` (0 to 1) and ``expression``, the word with the strongest evidence (null without words).

    Whole texts are read; null, empty and wordless ones have evidence zero.
    Columns of those names in ``docs`` give way.
    """
    fields, stay = without(docs, "toxicity", "expression")
    schema = T.StructType([*fields, T.StructField("toxicity", T.DoubleType(), False), T.StructField("expression", T.StringType())])
    if model.joined:
        return _score_by_joins(docs, model, text, [docs.columns[i] for i in stay])
    at = docs.columns.index(text)
    sent = docs.sparkSession.sparkContext.broadcast(model.only("all"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _grouped(batches, at):
            found = sent.value.strongest(batch.column(at).to_pylist())
            scores = pa.array([sent.value.score(e) for e, _ in found], pa.float64())
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in stay], scores, pa.array([w for _, w in found], pa.string())], names=[f.name for f in schema.fields])

    return sent_small(docs).mapInArrow(thrifty(each), schema)


def drop_toxic(docs: DataFrame, model: ToxicityModel, text: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``."""
    columns = docs.columns
    safe = {c: unused_name(docs, c) for c in ("toxicity", "expression")}
    taken = [c for c in columns if c.lower() in safe]
    renamed = docs.withColumnsRenamed({c: safe[c.lower()] for c in taken})
    scored = score_toxicity(renamed, model, safe.get(text.lower(), text) if text in taken else text).where(F.col("toxicity") < threshold)
    return scored.drop("toxicity", "expression").withColumnsRenamed({safe[c.lower()]: c for c in taken}).select(*[f"`{c}`" for c in columns])


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the labelled rows outside fold 1."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_toxicity(docs, train(docs, table(spark, sf_dir, "labels")))
    held_out = F.coalesce(fold_of(F.col("doc_id")) == 1, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.7).cast("int").alias("predicted"), "expression")
