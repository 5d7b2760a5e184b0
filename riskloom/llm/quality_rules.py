"""Quality rules: counts of a text, and how far its histograms are from those of a language.

A document is described by two histograms: its characters by class (lower and
upper case, digits, punctuation, other signs, everything beyond ASCII) and the
commonest words of a language.  Every language that enough documents name is a
reference, with the histograms of all its documents together.  A document passes
if some language is near to it in both, by the Jensen-Shannon distance (to the
base 2: 0 if equal, 1 if nothing is shared).  Texts too short for a histogram are
not judged by it, and neither are documents in a language without a reference.

The candidates for common words come from a bounded sketch per language and are
then counted exactly.  A document's words meet them in a join and are counted
in their own task first; all else is worked out in the row, without a shuffle.
DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .runtime import keyed, materialize, narrow, table

WORD = r"[^\x20\x09-\x0D]+"
SYMBOL = "[#*$%&|<>]"
#: Words that can be common ones: letters alone.
LETTERS = r"^[^\x00-\x40\x5B-\x60\x7B-\x7F]+$"
#: Classes of characters that are not a-z, each by its pattern.
CLASSES = {
    "upper": "[A-Z]",
    "digits": "[0-9]",
    "marks": r"[\x21\x22\x27-\x29\x2C-\x2E\x3A\x3B\x3F]",
    "signs": r"[\x00-\x20\x23-\x26\x2A\x2B\x2F\x3C-\x3E\x40\x5B-\x60\x7B-\x7F]",
    "beyond": r"[^\x00-\x7F]",
}
_BINS = ("lower", *CLASSES)
#: Items that the sketch of a language keeps, and those it is asked for.
_TRACKED, _ASKED = 20_000, 256
#: Parts that a language's sketches are merged in before they meet.
_PARTS = 64
#: Languages with the most words that are references.
MOST_LANGUAGES = 200


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def _text() -> Column:
    return F.coalesce("text", F.lit(""))


def text_counts(rows: DataFrame, *keep: str) -> DataFrame:
    """``rows`` with a ``text`` to the columns ``keep``, the counts of the base rules and those of the character classes.

    Windows of three words are told apart by 64-bit hashes, which are compared
    within one text only: where some hash repeats, hashes are sorted with their
    places and equal neighbours are the repeated ones.
    """
    first = rows.select(*keep, _text().alias("text"), _words(_text()).alias("words"))
    n = F.size("words")
    windows = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)))
    joined = F.array_join("words", "")
    lines = F.filter(F.split("text", "\n", -1), lambda line: line.rlike(WORD))
    second = first.select(
        *keep,
        n.cast("long").alias("n_words"),
        F.length(joined).cast("long").alias("word_chars"),
        F.regexp_replace(joined, "[a-z]+", "").alias("rest"),
        lines.alias("lines"),
        F.when(n >= 3, windows).otherwise(F.array().cast("array<bigint>")).alias("windows"),
    )
    plain = ("n_words", "word_chars")
    counts = {name: F.regexp_count("rest", F.lit(pattern)).cast("long").alias(name) for name, pattern in CLASSES.items()}
    placed = F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    third = second.select(
        *keep,
        *plain,
        F.regexp_count("rest", F.lit(SYMBOL)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        *counts.values(),
        F.when(F.size(F.array_distinct("windows")) < F.size("windows"), placed).otherwise(none).alias("placed"),
    )
    same = lambda x, i: (x["h"] == F.get("placed", i - 1)["h"]) | (x["h"] == F.get("placed", i + 1)["h"])
    fourth = third.withColumn("again", F.filter("placed", same)).drop("placed")
    covered = F.array_distinct(F.flatten(F.transform("again", lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))))
    lower = F.col("word_chars") - sum((F.col(c) for c in CLASSES), F.lit(0))
    return fourth.select(*keep, *plain, "n_symbols", "n_dup_lines", F.size(covered).cast("long").alias("n_repeat_words"), lower.alias("lower"), *CLASSES)


def _half(a: Column, b: Column) -> Column:
    return F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(0.0) / 2


def divergence(p: Column, q: Column) -> Column:
    """What one bin with the shares ``p`` and ``q`` adds to the Jensen-Shannon divergence."""
    return _half(p, q) + _half(q, p)


def candidate_words(rows: DataFrame, least_words: int, most_languages: int = MOST_LANGUAGES) -> DataFrame:
    """``(lang, n_lang, word)``: words that may be the commonest of the languages with ``least_words`` words or more.

    A sketch per language holds every word that makes up more than about a
    ten-thousandth of its text; words of other signs than letters are left out.
    Sketches of tasks are merged in parts first and those then, so that no task
    reads one of every other task.
    """
    words = rows.where("lang IS NOT NULL").select("lang", F.explode(_words(F.col("text"))).alias("word"), F.pmod(F.spark_partition_id(), F.lit(_PARTS)).alias("part"))
    parts = words.groupBy("lang", "part").agg(F.expr(f"approx_top_k_accumulate(word, {_TRACKED})").alias("sketch"), F.count("*").alias("n"))
    tops = parts.groupBy("lang").agg(F.expr(f"approx_top_k_combine(sketch, {_TRACKED})").alias("sketch"), F.sum("n").alias("n_lang"))
    tops = tops.select("lang", "n_lang", F.expr(f"approx_top_k_estimate(sketch, {_ASKED})").alias("top"))
    tops = tops.where(F.col("n_lang") >= least_words).orderBy(F.desc("n_lang"), "lang").limit(most_languages)
    return tops.select("lang", "n_lang", F.explode("top.item").alias("word")).where(F.col("word").rlike(LETTERS))


def judge_quality(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    common: int = 50,
    class_distance: float = 0.3,
    word_distance: float = 0.45,
    least_chars: int = 200,
    least_words: int = 100,
    least_reference: int = 1_000,
    base_words: int = 50,
    base_repeats: int = 50,
) -> DataFrame:
    """The base counts of every row of ``docs``, ``base_failed``, and ``kept``.

    ``n_dup_lines`` counts lines with a word that equal an earlier one,
    ``n_repeat_words`` the words inside any window of three words that occurs
    more than once.  A text fails the base rules with fewer than ``base_words``
    words or with more than ``base_repeats`` of a hundred words repeated.  Of
    the others, a text is kept if one reference language is within
    ``class_distance`` by its characters (not asked of fewer than
    ``least_chars`` characters) and within ``word_distance`` by that language's
    ``common`` commonest words (not asked of fewer than ``least_words`` words).

    Null and empty texts have no words and fail.  Rows without a language are
    compared like others but are part of no reference; rows that name a
    language of fewer than ``least_reference`` words in all, and all rows if no
    language has more, are kept.  Repeated rows and ids are separate rows;
    other columns are not read, and empty tables give empty results.
    """
    rows, at = keyed(docs)
    key = ("row_file", "row_place")
    rows = narrow(rows, row_file=at[0], row_place=at[1], doc_id=doc_id, text=text, lang=lang)
    counts = materialize(text_counts(rows, *key, "doc_id", "lang"), "quality-counts")

    candidates = materialize(candidate_words(rows, least_reference), "quality-candidates")
    listed = candidates.select("word").distinct()  # some hundreds a language, of a bounded number
    spoken = rows.select(*key, "lang", _words(F.col("text")).alias("words")).select(*key, "lang", F.size("words").alias("n"), F.explode("words").alias("word"))
    spoken = spoken.join(F.broadcast(listed), "word").groupBy(*key, "lang", "n", "word").agg(F.count("*").alias("c"))
    spoken = materialize(spoken, "quality-words")

    exact = spoken.groupBy("lang", "word").agg(F.sum("c").alias("total"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("total"), "word"))  # the candidates of a language
    shares = candidates.join(exact, ["lang", "word"]).withColumn("place", place).where(F.col("place") <= common)
    shares = materialize(shares.select(F.col("lang").alias("of"), "word", (F.col("total") / F.col("n_lang")).alias("q")), "quality-shares")
    sums = counts.groupBy("lang").agg(*[F.sum(c).alias(c) for c in _BINS])
    all_signs = sum((F.col(c) for c in _BINS), F.lit(0))
    languages = sums.join(shares.groupBy(F.col("of").alias("lang")).agg(F.sum("q").alias("common")), "lang")
    reference = F.struct("lang", "common", *[(F.col(c) / all_signs).alias(c) for c in _BINS])
    references = languages.agg(F.sort_array(F.collect_list(reference)).alias("references"))

    p = F.col("c") / F.col("n")
    met = spoken.join(F.broadcast(shares), "word").groupBy(*key, "of").agg(F.sum(divergence(p, F.col("q"))).alias("d"), F.sum(p).alias("p"), F.sum("q").alias("q"))
    met = met.groupBy(*key).agg(F.collect_list(F.struct("of", "d", "p", "q")).alias("met"))  # a row a language
    judged = counts.join(met, list(key), "left").crossJoin(F.broadcast(references))  # one row

    chars = F.col("word_chars")
    none = F.array().cast("array<struct<of:string,d:double,p:double,q:double>>")
    by_class = lambda r: F.sqrt(F.greatest(F.lit(0.0), sum((divergence(F.col(c) / chars, r[c]) for c in _BINS), F.lit(0.0))))

    def by_words(r: Column) -> Column:
        own = F.get(F.filter(F.coalesce("met", none), lambda m: m["of"] == r["lang"]), F.lit(0))
        d, in_doc, in_lang = (F.coalesce(own[f], F.lit(0.0)) for f in ("d", "p", "q"))
        return F.sqrt(F.greatest(F.lit(0.0), d + (r["common"] - in_lang) / 2 + divergence(1 - in_doc, 1 - r["common"])))

    near = F.exists("references", lambda r: ((chars < least_chars) | (by_class(r) <= class_distance)) & ((F.col("n_words") < least_words) | (by_words(r) <= word_distance)))
    unknown = F.col("lang").isNotNull() & ~F.exists("references", lambda r: r["lang"] == F.col("lang"))
    failed = (F.col("n_words") < base_words) | (100 * F.col("n_repeat_words") > base_repeats * F.col("n_words"))
    kept = ~failed & ((F.size("references") == 0) | unknown | near)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), kept.alias("kept"))


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by the base rules and by their distance from the languages of the corpus."""
    return judge_quality(table(spark, sf_dir, "documents"))


def _sql_count(pattern: str, of: str = "flat") -> str:
    return f"len(regexp_extract_all({of}, '{pattern}'))"


def _sql_divergence(p: str, q: str) -> str:
    half = lambda a, b: f"(CASE WHEN {a} > 0 THEN {a} * log2(2 * {a} / ({a} + {b})) ELSE 0 END) / 2.0::double"
    return f"({half(p, q)} + {half(q, p)})"


ORACLE = f"""
WITH split AS (SELECT row_number() OVER () AS line, doc_id, lang, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS words FROM documents),
flat AS (SELECT *, array_to_string(words, '') AS flat FROM split),
windows AS (SELECT line, unnest(range(1, len(words) - 1)) AS i FROM split WHERE len(words) >= 3),
grams AS (SELECT line, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS gram FROM windows JOIN split USING (line)),
again AS (SELECT line, i FROM (SELECT *, count(*) OVER (PARTITION BY line, gram) AS n FROM grams) WHERE n > 1),
covered AS (SELECT line, count(DISTINCT i + k) AS n_repeat_words FROM again, range(3) r(k) GROUP BY line),
dups AS (
  SELECT line, sum(n - 1)::bigint AS n_dup_lines
  FROM (SELECT line, part, count(*) AS n FROM (SELECT line, unnest(string_split(text, chr(10))) AS part FROM split) WHERE regexp_matches(part, '{WORD}') GROUP BY line, part) GROUP BY line
),
counts AS (
  SELECT line, doc_id, lang, len(words)::bigint AS n_words, length(flat)::bigint AS word_chars, {_sql_count(SYMBOL)}::bigint AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, {", ".join(f"{_sql_count(p)} AS {c}" for c, p in {"lower": "[a-z]", **CLASSES}.items())}
  FROM flat LEFT JOIN covered USING (line) LEFT JOIN dups USING (line)
),
spoken AS (SELECT line, lang, len(words) AS n, unnest(words) AS word FROM split),
sizes AS (SELECT lang, count(*) AS n_lang FROM spoken WHERE lang IS NOT NULL GROUP BY lang HAVING count(*) >= 1000),
totals AS (SELECT lang, n_lang, word, count(*) AS total FROM spoken JOIN sizes USING (lang) WHERE regexp_matches(word, '{LETTERS}') GROUP BY ALL),
shares AS (SELECT lang AS known, word, total / n_lang::double AS q FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY total DESC, word) AS r FROM totals) WHERE r <= 50),
reference AS (
  SELECT lang AS known, (SELECT sum(q) FROM shares WHERE known = lang) AS common, {", ".join(f"sum({c}) / sum(word_chars)::double AS q_{c}" for c in _BINS)}
  FROM counts JOIN sizes USING (lang) GROUP BY lang
),
met AS (
  SELECT line, known, sum({_sql_divergence("p", "q")}) AS d, sum(p) AS p, sum(q) AS q
  FROM (SELECT line, word, count(*) / n::double AS p FROM spoken GROUP BY line, word, n) JOIN shares USING (word) GROUP BY line, known
),
distances AS (
  SELECT line, n_words, word_chars,
    sqrt(greatest(0, {" + ".join(_sql_divergence(f"({c} / word_chars::double)", f"q_{c}") for c in _BINS)})) AS by_class,
    sqrt(greatest(0, coalesce(d, 0) + (common - coalesce(q, 0)) / 2 + {_sql_divergence("(1 - coalesce(p, 0))", "(1 - common)")})) AS by_words
  FROM counts CROSS JOIN reference LEFT JOIN met USING (line, known) WHERE n_words >= 50
),
near AS (SELECT line FROM distances WHERE (word_chars < 200 OR by_class <= 0.3::double) AND (n_words < 100 OR by_words <= 0.45::double) GROUP BY line),
judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    line IN (SELECT line FROM near) OR NOT EXISTS (SELECT 1 FROM reference) OR (lang IS NOT NULL AND lang NOT IN (SELECT known FROM reference)) AS fits
  FROM counts
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND fits AS kept FROM judged
"""
