"""Documents drawn by how much more likely a target makes them than the corpus does.

Every run of words falls into one of ``buckets`` by its checksum.  What a bucket
is worth is the logarithm of its share in the target against its share in the
corpus; a document weighs the sum over its runs, and random noise of the Gumbel
distribution on top makes the highest scores a draw without replacement.

A document is read once: higher-order functions turn it into an array of bucket
numbers, which is stored.  Only the totals of buckets are shuffled, each task's
counts first summed by itself.  Scores come from the arrays by an aggregate
whose terms are looked up in one literal array of gains, so that scoring neither
explodes nor joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranks import numbered
from .runtime import materialize, narrow, table

#: Letters and digits of ASCII, lower-cased, and everything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKETS = 10_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    """``text`` with A-Z lower-cased and nothing else changed; texts of ASCII alone take the quick way."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def _runs(words: Column, shortest: int, longest: int) -> Column:
    """All runs of ``shortest`` to ``longest`` consecutive words, each joined by a blank."""

    def of(n: int) -> Column:
        if n == 1:
            return words
        starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - (n - 1))).otherwise(F.expr("array()").cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), " "))

    lists = [of(n) for n in range(shortest, longest + 1)]
    return lists[0] if len(lists) == 1 else F.concat(*lists)


def bucket_arrays(df: DataFrame, *keep: str, text: str = "text", runs: tuple[int, int] = (1, 1), buckets: int = BUCKETS) -> DataFrame:
    """``df``'s columns ``keep`` with ``n_words`` and ``buckets`` (array of int), for every row; a null text has no words."""
    words = F.coalesce(F.regexp_extract_all(lower_ascii(F.col(f"`{text}`")), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))
    rows = df.select(*keep, words.alias("words"))
    numbers = F.transform(_runs(F.col("words"), *runs), lambda run: (F.crc32(run.cast("binary")) % buckets).cast("int"))
    return rows.select(*keep, F.size("words").cast("long").alias("n_words"), numbers.alias("buckets"))


def bucket_totals(arrays: DataFrame, name: str) -> DataFrame:
    """``(bucket, name)``: how many runs of all rows fall into each bucket; a task sends one row a bucket at most."""
    return arrays.select(F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.count("*").alias(name))


def bucket_gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """What each bucket is worth, in thousandths of a natural logarithm, every bucket counted once more than it occurs.

    ``corpus`` and ``target`` are tables of ``bucket_arrays``.  The list has
    ``buckets`` numbers, whatever the tables' size.
    """
    every = corpus.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = every.join(bucket_totals(corpus, "s"), "bucket", "left").join(bucket_totals(target, "t"), "bucket", "left")
    both = both.select("bucket", *[F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in ("s", "t")])
    sums = both.agg(F.sum("s").alias("sum_s"), F.sum("t").alias("sum_t"))
    ratio = (F.col("t") + 1) * (F.col("sum_s") + buckets) / ((F.col("s") + 1) * (F.col("sum_t") + buckets))
    rows = both.crossJoin(F.broadcast(sums)).select("bucket", F.floor(1000 * F.ln(ratio)).alias("gain")).collect()
    return [r["gain"] for r in sorted(rows, key=lambda r: r["bucket"])]


def weighed(arrays: DataFrame, gains: list[int]) -> DataFrame:
    """``arrays`` with ``weight``: the sum of the gains of a row's buckets, 0 if it has none."""
    listed = F.split(F.lit(",".join(map(str, gains))), ",").cast("array<bigint>")  # folds into one literal
    return arrays.withColumn("weight", F.aggregate("buckets", F.lit(0).cast("long"), lambda sum_, b: sum_ + F.element_at(listed, b + 1)))


def gumbel(seed: str, doc_id: Column) -> Column:
    """Noise of the Gumbel distribution in thousandths, from a digest of seed and id."""
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    share = (F.conv(F.substring(hashed, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000 * F.ln(-F.ln(share)))


def resample(
    docs: DataFrame,
    target: DataFrame,
    percent: int = 10,
    least_words: int = 20,
    seed: str = "2024",
    runs: tuple[int, int] = (1, 1),
    buckets: int = BUCKETS,
    doc_id: str = "doc_id",
    text: str = "text",
    target_text: str = "text",
) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` for every row of ``docs``.

    Of the rows with ``least_words`` words or more, the ``percent`` of a hundred
    (rounded down) with the highest scores are drawn and ranked from 1, equal
    scores by the smaller id; the others have no rank.  Null and empty texts have
    no features and weigh 0.  Rows that repeat an id or a text each count; of
    rows that agree in score and id, the one with fewer features comes first.  A
    row without an id takes the noise of an empty one and comes last among equal
    scores.  With an empty target the rarer buckets gain most; empty ``docs``
    give an empty table.  No other column is read.
    """
    corpus = materialize(bucket_arrays(narrow(docs, doc_id=doc_id, text=text), "doc_id", runs=runs, buckets=buckets), "importance-buckets")
    wanted = bucket_arrays(narrow(target, text=target_text), runs=runs, buckets=buckets)
    scored = weighed(corpus, bucket_gains(corpus, wanted, buckets))
    scored = scored.select("doc_id", "n_words", F.size("buckets").cast("long").alias("n_features"), "weight")
    scored = materialize(scored.withColumn("score", F.col("weight") + gumbel(seed, F.col("doc_id"))), "importance-scores")
    able, columns = F.col("n_words") >= least_words, ("doc_id", "n_features", "weight", "score")
    drawn = percent * scored.where(able).count() // 100
    order = (F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features"), F.col("weight"))
    ranked = numbered(scored.where(able).select(*columns), order)
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return ranked.select(*columns, "rank").unionByName(scored.where(~able).select(*columns, F.lit(None).cast("long").alias("rank")))


def op13_importance_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, a tenth of them drawn towards the words of the benchmark."""
    found = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumn("doc_id", F.col("doc_id").cast("long"))


_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{WORD}')"

ORACLE = f"""
WITH bits AS (
  SELECT list(list_reduce(list_prepend(i, range(1, 9)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS crc FROM range(256) t(i)
), docs AS (SELECT doc_id, row_number() OVER () AS line, {_WORDS} AS words FROM documents),
doc_words AS (SELECT line, unnest(words) AS word FROM docs),
item_words AS (SELECT unnest({_WORDS}) AS word FROM benchmark),
known AS (SELECT DISTINCT word FROM (SELECT word FROM doc_words UNION ALL SELECT word FROM item_words)),
bytes AS (SELECT word, list_transform(regexp_extract_all(hex(encode(word)), '..'), lambda x: cast('0x' || x AS BIGINT)) AS b FROM known),
sums AS (
  SELECT word, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, crc[(xor(c, x) & 255) + 1])), 4294967295) % {BUCKETS} AS bucket FROM bytes, bits
),
s AS (SELECT bucket, count(*) AS s FROM doc_words JOIN sums USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM item_words JOIN sums USING (word) GROUP BY bucket),
gains AS (
  SELECT b AS bucket, floor(1000 * ln((coalesce(t, 0)::double + 1) * ((SELECT count(*) FROM doc_words)::double + {BUCKETS}) / ((coalesce(s, 0)::double + 1) * ((SELECT count(*) FROM item_words)::double + {BUCKETS}))))::bigint AS gain
  FROM range({BUCKETS}) r(b) LEFT JOIN s ON s.bucket = b LEFT JOIN t ON t.bucket = b
),
weights AS (SELECT line, sum(gain)::bigint AS weight FROM doc_words JOIN sums USING (word) JOIN gains USING (bucket) GROUP BY line),
scored AS (
  SELECT doc_id, len(words)::bigint AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((cast('0x' || left(sha256('2024:' || doc_id), 8) AS BIGINT)::double + 0.5) / 4294967296.0::double)))::bigint AS score
  FROM docs LEFT JOIN weights USING (line)
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS r, count(*) FILTER (WHERE n_features >= 20) OVER () AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND r <= 10 * n // 100 THEN r END AS rank FROM ranked
"""
