"""Language identification of mixed-language text by Viterbi over words.

Each word's script, told by ranges of code points, narrows the languages to
those that are written in it.  Its characters' n-grams give it a score for each
of these.  The best labelling of a text's words, where every change of language
costs ``penalty``, splits the text into spans of one language; the language
with most letters names the text, and its share of the letters is the score.

The n-gram tables are learned from a bounded sample of labelled texts
(``ROWS_PER_LANGUAGE`` of each language, or all if there are fewer).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chargrams import LETTERS, WordGrams, slots
from .runtime import narrow, sent_small, table, thrifty, unused_name, without

#: Expected size of the sample that a language is learned from.
ROWS_PER_LANGUAGE = 3_000
ORDERS = (1, 2, 3, 4)
SLOT_BITS = 16
PENALTY = 6.0
UNKNOWN = "und"
#: Texts are read in groups of about so many characters.
GROUP_CHARS = 2_000_000
#: Grams are counted for about so many characters at a time.
COUNTED_CHARS = 500_000
#: A language is a candidate for a script that this share of its words is written in.
SCRIPT_SHARE = 0.001

#: Where scripts begin, by code point; each range ends where the next begins.
SCRIPT_STARTS = (
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"),
    (0x0600, "Arabic"), (0x0700, "Syriac"), (0x0750, "Arabic"), (0x0780, "Thaana"), (0x0900, "Devanagari"), (0x0980, "Bengali"),
    (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"), (0x0B00, "Oriya"), (0x0B80, "Tamil"), (0x0C00, "Telugu"),
    (0x0C80, "Kannada"), (0x0D00, "Malayalam"), (0x0D80, "Sinhala"), (0x0E00, "Thai"), (0x0E80, "Lao"),
    (0x0F00, "Tibetan"), (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"),
    (0x13A0, "Cherokee"), (0x1780, "Khmer"), (0x1800, "Mongolian"), (0x1C80, "Cyrillic"), (0x1D00, "Latin"),
    (0x1F00, "Greek"), (0x2000, "Other"), (0x2C60, "Latin"), (0x2C80, "Other"), (0x3040, "Kana"), (0x3100, "Han"),
    (0x3130, "Hangul"), (0x31A0, "Han"), (0xA000, "Other"), (0xA640, "Cyrillic"), (0xA720, "Latin"), (0xA800, "Other"),
    (0xAC00, "Hangul"), (0xD7FC, "Other"), (0xF900, "Han"), (0xFB00, "Latin"), (0xFB1D, "Hebrew"), (0xFB50, "Arabic"),
    (0xFE00, "Other"), (0xFF21, "Latin"), (0xFF66, "Kana"), (0xFFA0, "Hangul"), (0xFFE0, "Other"), (0x20000, "Han"),
)
SCRIPTS = tuple(sorted({name for _, name in SCRIPT_STARTS}))
_STARTS = np.array([at for at, _ in SCRIPT_STARTS], dtype=np.uint64)
_SCRIPT_AT = np.array([SCRIPTS.index(name) for _, name in SCRIPT_STARTS])


def fold_of(doc_id: Column) -> Column:
    """The remainder by four of an id's checksum; null ids are in no fold."""
    return F.crc32(doc_id.cast("string")) % 4


def _words(text: str | None) -> list[str]:
    return LETTERS.findall((text or "").lower())


def _scripts(grams: WordGrams) -> np.ndarray:
    """The script of most of each word's letters; of equals the first by name."""
    at = np.nonzero(~grams.blank)[0]
    letter = _SCRIPT_AT[np.searchsorted(_STARTS, grams.codes[at], side="right") - 1]
    seen = np.bincount(grams.word[at] * len(SCRIPTS) + letter, minlength=grams.n_words * len(SCRIPTS))
    return seen.reshape(-1, len(SCRIPTS)).argmax(axis=1)


def _places(grams: WordGrams) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order, the word and the slot of its grams."""
    for order in ORDERS:
        ends = grams.ends(order)
        yield grams.word[ends], slots(grams.ids(order)[ends], SLOT_BITS)


@dataclass
class LanguageModel:
    """Scores of gram slots by language, and the languages of each script."""

    languages: list[str]
    grams: np.ndarray  # (slots, languages): log-probabilities over their mean
    candidates: np.ndarray  # (scripts, languages)

    def word_scores(self, words: list[str]) -> np.ndarray:
        """(words, languages); grams are looked up for the candidates of a word's script alone, other languages score far below.

        A word in a script that no language is written in scores zero for all.
        """
        out = np.zeros((len(words), len(self.languages)), np.float32)
        if not words or not self.languages:
            return out
        script = _scripts(WordGrams(words))
        for s in np.unique(script):
            languages = np.nonzero(self.candidates[s])[0]
            if not len(languages):
                continue
            some = np.nonzero(script == s)[0]
            scores = np.zeros((len(some), len(languages)))
            if len(languages) > 1:  # where one is left, nothing is to be told apart
                for word, place in _places(WordGrams([words[i] for i in some])):
                    for k, language in enumerate(languages):
                        scores[:, k] += np.bincount(word, self.grams[place, language], minlength=len(some))
            out[some] = scores.min(axis=1, keepdims=True) - 20.0
            out[np.ix_(some, languages)] = scores
        return out

    def label(self, texts: list[str | None], penalty: float = PENALTY) -> list[np.ndarray]:
        """The language of every word of each text, as places in ``languages``."""
        return self.labelled(texts, penalty)[0]

    def labelled(self, texts: list[str | None], penalty: float = PENALTY) -> tuple[list[np.ndarray], list[np.ndarray], list[int]]:
        """``label``, the letters of each word that speak for its language, and the letters of each text.

        A word in a script that no language was learned in speaks for none.
        """
        index: dict[str, int] = {}
        each = [np.array([index.setdefault(w, len(index)) for w in _words(t)], dtype=np.int64) for t in texts]
        words = list(index)
        length = np.array([len(w) for w in words], dtype=np.int64)
        read = self.candidates[_scripts(WordGrams(words))].any(axis=1) if words else np.zeros(0, bool)
        labels = viterbi(each, self.word_scores(words), penalty)
        return labels, [np.where(read[e], length[e], 0) for e in each], [int(length[e].sum()) for e in each]


def viterbi(texts: list[np.ndarray], scores: np.ndarray, penalty: float) -> list[np.ndarray]:
    """Best labels of several sequences of rows of ``scores``, all taken a step at a time together.

    Every change of label costs ``penalty``; of equal labellings the one that stays, then the first label, is taken.
    """
    kinds = scores.shape[1]
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    lengths = np.array([len(texts[i]) for i in order])
    steps = int(lengths[0]) if len(order) else 0
    if not kinds or not steps:
        return [np.zeros(len(t), np.int8) for t in texts]
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    rows = np.concatenate([texts[i] for i in order])
    active = np.searchsorted(-lengths, -np.arange(1, steps + 1), side="right")  # sequences that have a step t
    own = np.arange(kinds, dtype=np.int16)[None, :]
    value = scores[rows[starts[: active[0]]]].astype(np.float64)
    back: list[np.ndarray] = []
    final = np.zeros(len(order), np.int16)
    final[: active[0]] = value.argmax(axis=1)
    for t in range(1, steps):
        a = active[t]
        value = value[:a]
        best = value.argmax(axis=1)
        change = value[np.arange(a), best][:, None] - penalty
        stay = value >= change
        back.append(np.where(stay, own, best[:, None].astype(np.int16)))
        value = np.where(stay, value, change) + scores[rows[starts[:a] + t]]
        final[:a] = value.argmax(axis=1)
    labels = np.zeros(len(rows), np.int16)
    now = final.copy()
    for t in range(steps - 1, -1, -1):
        a = active[t]
        labels[starts[:a] + t] = now[:a]
        if t:
            now[:a] = back[t - 1][np.arange(a), now[:a]]
    out: list[np.ndarray] = [np.zeros(0, np.int16)] * len(texts)
    for k, i in enumerate(order):
        out[i] = labels[starts[k] : starts[k] + lengths[k]]
    return out


def train(docs: DataFrame, learn: Column, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> LanguageModel:
    """Learn from the rows of ``docs`` where ``learn`` holds and the label is not null, every label that occurs.

    The model has 2**16 numbers for each language.  Without any such row the model knows no language and every text is ``und``.
    """
    rows = docs.where(learn & F.col(f"`{lang}`").isNotNull())
    rows = narrow(rows, doc_id=doc_id, text=text, lang=lang)
    found = rows.groupBy("lang").agg(F.count("*").alias("n")).collect()  # a row per language
    languages = sorted(r["lang"] for r in found)
    if not languages:
        return LanguageModel([], np.zeros((1 << SLOT_BITS, 0), np.float32), np.zeros((len(SCRIPTS), 0), bool))
    place = {name: i for i, name in enumerate(languages)}
    part = {r["lang"]: min(1.0, ROWS_PER_LANGUAGE / r["n"]) for r in found}
    per_row = F.create_map(*[F.lit(x) for name in languages for x in (name, part[name])])
    dice = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1_000_000)) / 1_000_000
    numbered = F.create_map(*[F.lit(x) for name in languages for x in (name, place[name])])
    sample = rows.where(dice < F.try_element_at(per_row, F.col("lang"))).select(F.try_element_at(numbered, F.col("lang")).alias("lang"), "text")
    n_languages = len(languages)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (kind, slot, lang, n) of each batch: n-grams of kind 0, scripts of kind 1."""
        def counted(seen: dict[int, list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
            for kind, keys in seen.items():
                key, n = np.unique(np.concatenate(keys) if keys else np.zeros(0, np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind)), pa.array(key & ((1 << SLOT_BITS) - 1)), pa.array(key >> SLOT_BITS), pa.array(n)], names=["kind", "slot", "lang", "n"])

        for batch in batches:
            seen, chars = {0: [], 1: []}, 0
            for lang_, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = _words(value.as_py())
                if words:
                    grams = WordGrams(words)
                    seen[1].append(_scripts(grams) + (lang_ << SLOT_BITS))
                    seen[0] += [places + (lang_ << SLOT_BITS) for _, places in _places(grams)]
                    chars += len(grams.codes)
                if chars > COUNTED_CHARS:
                    yield from counted(seen)
                    seen, chars = {0: [], 1: []}, 0
            yield from counted(seen)

    counts = sent_small(sample).mapInArrow(thrifty(count), "kind long, slot long, lang long, n long").groupBy("kind", "slot", "lang").agg(F.sum("n").alias("n")).toArrow()
    kind, slot, lang_, n = (counts.column(c).to_numpy() for c in ("kind", "slot", "lang", "n"))
    table_ = np.full((1 << SLOT_BITS, n_languages), 0.5)
    table_[slot[kind == 0], lang_[kind == 0]] += n[kind == 0]
    logs = np.log(table_ / table_.sum(axis=0, keepdims=True))
    logs -= logs.mean(axis=1, keepdims=True)
    scripts_of = np.zeros((len(SCRIPTS), n_languages))
    scripts_of[slot[kind == 1], lang_[kind == 1]] = n[kind == 1]
    share = scripts_of / np.maximum(scripts_of.sum(axis=0, keepdims=True), 1)
    return LanguageModel(languages, logs.astype(np.float32), share >= SCRIPT_SHARE)


_SPANS = T.ArrayType(T.StructType([T.StructField("lang", T.StringType()), T.StructField("words", T.LongType())]))


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", penalty: float = PENALTY) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``spans`` (runs of words of one language, in order).

    The score is the share of all letters that speak for the language; those in a
    script that no language was learned in speak for none, so that a text in such
    a script alone has the score 0.  Null texts and those without a letter are
    ``und`` with score 0 and no spans.
    Whole texts are read.  Columns of those names in ``docs`` give way.
    """
    fields, stay = without(docs, "lang_pred", "score", "spans")
    added = [T.StructField("lang_pred", T.StringType(), False), T.StructField("score", T.DoubleType(), False), T.StructField("spans", _SPANS, False)]
    schema = T.StructType([*fields, *added])
    at = docs.columns.index(text)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 2**SLOT_BITS numbers a language
    span_type = pa.list_(pa.struct([("lang", pa.string()), ("words", pa.int64())]))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = sent.value.languages
        for batch in batches:
            lengths = np.array([len(t.as_py() or "") for t in batch.column(at)], dtype=np.int64)
            group = (np.cumsum(lengths) - lengths) // GROUP_CHARS
            edges = np.concatenate((np.nonzero(np.diff(group, prepend=-1))[0], [len(lengths)]))
            for a, b in zip(edges[:-1], edges[1:]):
                part = batch.slice(a, b - a)
                texts = part.column(at).to_pylist()
                preds, scores, spans = [], [], []
                for labels, letters_of, total in zip(*sent.value.labelled(texts, penalty)):
                    if not len(labels) or not names:
                        preds.append(UNKNOWN)
                        scores.append(0.0)
                        spans.append([])
                        continue
                    letters = np.bincount(labels, letters_of, minlength=len(names))
                    best = int(letters.argmax())
                    preds.append(names[best])
                    scores.append(float(letters[best] / total))
                    cuts = np.concatenate((np.nonzero(np.diff(labels, prepend=-1))[0], [len(labels)]))
                    spans.append([{"lang": names[labels[i]], "words": int(j - i)} for i, j in zip(cuts[:-1], cuts[1:])])
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(i) for i in stay], pa.array(preds, pa.string()), pa.array(scores, pa.float64()), pa.array(spans, span_type)],
                    names=[f.name for f in schema.fields],
                )

    return sent_small(docs).mapInArrow(thrifty(each), schema)


def drop_unidentified(docs: DataFrame, model: LanguageModel, text: str = "text", least: float = 0.4) -> DataFrame:
    """The rows of ``docs`` whose text has letters, of which one language has at least ``least``."""
    columns = docs.columns
    safe = {c: unused_name(docs, c) for c in ("lang_pred", "score", "spans")}
    taken = [c for c in columns if c.lower() in safe]
    renamed = docs.withColumnsRenamed({c: safe[c.lower()] for c in taken})
    kept = identify(renamed, model, safe[text.lower()] if text in taken else text).where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least))
    return kept.drop("lang_pred", "score", "spans").withColumnsRenamed({safe[c.lower()]: c for c in taken}).select(*[f"`{c}`" for c in columns])


def learning_rows(doc_id: str = "doc_id") -> Column:
    """The rows that the registered query and the pipeline learn from."""
    return fold_of(F.col(f"`{doc_id}`")) != 2


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned outside fold 2."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs, learning_rows())
    found = identify(docs.select("doc_id", "text"), model)
    held_out = F.coalesce(fold_of(F.col("doc_id")) == 2, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
