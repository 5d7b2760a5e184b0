"""The best documents for each of a set of questions, by WAND over shards of documents.

What a term adds to a document's score depends on how often it occurs there, on
the document's length and on how many documents hold it.  The terms of the
questions are few and known, so a first pass over the texts keeps only what
concerns them: per document its number of terms and the counts of the question
terms in it.  Totals over that table give every term's weight.

A second pass searches.  Each task is a shard: it takes its documents block by
block, lays out a block's postings by term, and runs through the documents for
each question with one cursor a term.  Cursors are kept in order of their next
document, and their terms' greatest impacts in the block are added up until the
heap's lowest score is within reach: the document there is the pivot, all
before it cannot enter the heap and are jumped over.  A shard's heaps live from
block to block, so its bar only rises; the shards' heaps are merged by a ranking
that every task cuts to the best ``k`` of a question first.

Questions are taken in blocks of a bounded number of terms, whatever their
number; each block is one such search.
"""

from __future__ import annotations

import heapq
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .runtime import materialize, narrow, sent_small, table

#: Terms in UTF-8: letters and digits of ASCII and everything beyond it, after A-Z are lower-cased.
_TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
_BETWEEN = re.compile(rb"[^0-9A-Za-z\x80-\xff]")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LOWERED = bytes.maketrans(_UPPER.encode(), _LOWER.encode())
#: Bytes of a text that are split into terms at a time.
PIECE = 1 << 20
#: Postings that a shard lays out at a time.
BLOCK = 400_000
#: Terms of the questions that are searched for together.
QUESTION_TERMS = 200_000
_POSTINGS = "doc_id bigint, n bigint, terms array<int>, counts array<bigint>"
_HITS = "question int, doc_id bigint, score bigint"


def _pieces(text: bytes) -> Iterator[bytes]:
    """A long text in parts that end between terms."""
    at = 0
    while at < len(text):
        gap = _BETWEEN.search(text, at + PIECE)
        end = gap.start() if gap else len(text)
        yield text[at:end]
        at = end


def term_counts(text: bytes | None) -> Counter[bytes]:
    """How often each term occurs in a UTF-8 text; null has none."""
    found: Counter[bytes] = Counter()
    for piece in _pieces(text or b""):
        found.update(_TERM.findall(piece.translate(_LOWERED)))
    return found


def _texts(batch: pa.RecordBatch, column: str) -> list[bytes | None]:
    return batch.column(column).cast(pa.binary()).to_pylist()


def question_blocks(questions: DataFrame, most_terms: int = QUESTION_TERMS) -> Iterator[list[tuple[int | None, list[bytes]]]]:
    """``questions`` (item_id, text) as blocks of ``(item_id, terms)`` with about ``most_terms`` terms together.

    Texts of one id are one question.  Terms arrive sorted by question, so the
    driver holds one block at a time.
    """

    def split(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = [sorted(term_counts(t)) for t in _texts(batch, "text")]
            ids = [i for i, ts in zip(batch.column("item_id").to_pylist(), terms) for _ in ts]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([t for ts in terms for t in ts], pa.binary())], ["item_id", "term"])

    terms = questions.mapInArrow(split, "item_id bigint, term binary").distinct()
    block: list[tuple[int | None, list[bytes]]] = []
    held = 0
    for row in terms.orderBy("item_id", "term").toLocalIterator():
        if not block or block[-1][0] != row["item_id"]:
            if held >= most_terms:
                yield block
                block, held = [], 0
            block.append((row["item_id"], []))
        block[-1][1].append(bytes(row["term"]))
        held += 1
    if block:
        yield block


def postings(docs: DataFrame, known: dict[bytes, int]) -> DataFrame:
    """``docs`` (doc_id, text) to ``doc_id, n, terms, counts``: the documents with any term, and those of ``known`` in them."""

    def index(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lengths, ends, terms, counts = [], [], [0], [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), _texts(batch, "text")):
                found = term_counts(text)
                if not found:
                    continue
                ids.append(doc_id)
                lengths.append(found.total())
                for term in found.keys() & known.keys():
                    terms.append(known[term])
                    counts.append(found[term])
                ends.append(len(terms))
            at = pa.array(ends, pa.int32())
            lists = [pa.ListArray.from_arrays(at, pa.array(terms, pa.int32())), pa.ListArray.from_arrays(at, pa.array(counts, pa.int64()))]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(lengths, pa.int64()), *lists], ["doc_id", "n", "terms", "counts"])

    return docs.mapInArrow(index, _POSTINGS)


def weight(n_docs: int, df: int) -> int:
    """What a term is worth that ``df`` of ``n_docs`` documents hold."""
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class _Block:
    """The postings of some documents by term: documents in order, impacts, and the greatest impact of each term."""

    def __init__(self, doc_ids: list[int | None], n: np.ndarray, ends: np.ndarray, terms: np.ndarray, counts: np.ndarray, weights: np.ndarray, n_docs: int, n_terms: int):
        self.doc_ids = doc_ids
        m = 50 + (50 * n * n_docs) // n_terms
        doc = np.repeat(np.arange(len(n)), np.diff(ends))
        impact = weights[terms] * ((1_000_000_000 * counts) // (1000 * counts + 20 * m[doc]))
        counted = impact > 0
        terms, doc, impact = terms[counted], doc[counted], impact[counted]
        order = np.argsort(terms, kind="stable")
        self._doc, self._impact = doc[order], impact[order]
        self._at = np.searchsorted(terms[order], np.arange(len(weights) + 1))
        held = np.nonzero(np.diff(self._at))[0]
        self.greatest = np.zeros(len(weights), np.int64)
        if len(held):
            self.greatest[held] = np.maximum.reduceat(self._impact, self._at[held])
        self._lists: dict[int, tuple[list[int], list[int]]] = {}

    def of(self, term: int) -> tuple[list[int], list[int]]:
        """A term's documents and impacts, with a last document beyond all others."""
        if term not in self._lists:
            a, b = self._at[term], self._at[term + 1]
            self._lists[term] = ([*self._doc[a:b].tolist(), len(self.doc_ids)], [*self._impact[a:b].tolist(), 0])
        return self._lists[term]


_NEXT = itemgetter(0)


def wand(block: _Block, terms: np.ndarray, heap: list[tuple[int, float]], k: int) -> None:
    """Bring the documents of ``block`` that are among the best ``k`` for ``terms`` into ``heap``.

    An entry is (score, minus id), so that the least entry is the one to leave:
    the lowest score, and of equal scores the largest id; a null id is the last of all.
    A document whose bound equals the bar may still enter, by its id.
    """
    greatest = block.greatest[terms]
    bar = heap[0][0] if len(heap) == k else 1
    if int(greatest.sum()) < bar:
        return
    end = len(block.doc_ids)
    cursors = []  # [next document, greatest impact, documents, impacts, place]
    for term, bound in zip(terms[greatest > 0].tolist(), greatest[greatest > 0].tolist()):
        docs, impacts = block.of(term)
        cursors.append([docs[0], bound, docs, impacts, 0])
    while True:
        cursors.sort(key=_NEXT)
        reach = 0
        for at, cursor in enumerate(cursors):
            reach += cursor[1]
            if reach >= bar:
                break
        else:
            return
        pivot = cursor[0]
        if pivot == end:
            return
        if cursors[0][0] < pivot:
            for cursor in cursors[:at]:
                if cursor[0] < pivot:
                    place = bisect_left(cursor[2], pivot, cursor[4] + 1)
                    cursor[4], cursor[0] = place, cursor[2][place]
            continue
        score = 0
        for cursor in cursors:
            if cursor[0] != pivot:
                break
            place = cursor[4]
            score += cursor[3][place]
            cursor[4], cursor[0] = place + 1, cursor[2][place + 1]
        if score >= bar:
            doc_id = block.doc_ids[pivot]
            entry = (score, -math.inf if doc_id is None else -doc_id)
            if len(heap) < k:
                heapq.heappush(heap, entry)
            elif entry > heap[0]:
                heapq.heapreplace(heap, entry)
            if len(heap) == k:
                bar = heap[0][0]


def _blocks(batches: Iterable[pa.RecordBatch], most: int) -> Iterator[tuple[list, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of ``postings`` gathered to about ``most`` postings; ends are running totals."""
    held: list[pa.RecordBatch] = []
    n = 0

    def out() -> tuple[list, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        rows = pa.Table.from_batches(held).combine_chunks()
        lists = [rows.column(c).combine_chunks() for c in ("terms", "counts")]
        sizes = lists[0].value_lengths().to_numpy(zero_copy_only=False)
        flat = [x.flatten().to_numpy(zero_copy_only=False) for x in lists]
        return rows.column("doc_id").to_pylist(), rows.column("n").to_numpy(), np.concatenate(([0], np.cumsum(sizes))), flat[0], flat[1]

    for batch in batches:
        held.append(batch)
        n += len(batch.column("terms").flatten())
        if n >= most:
            yield out()
            held, n = [], 0
    if held:
        yield out()


def shard_hits(index: DataFrame, questions: list[list[int]], weights: list[int], n_docs: int, n_terms: int, k: int, block: int = BLOCK) -> DataFrame:
    """The best ``k`` documents of each task's share of ``index`` for every question: ``question, doc_id, score``."""

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worth = np.array(weights, np.int64)
        asked = [np.array(q, np.int64) for q in questions]
        heaps: list[list[tuple[int, float]]] = [[] for _ in asked]
        for doc_ids, n, ends, terms, counts in _blocks(batches, block):
            laid = _Block(doc_ids, n, ends, terms, counts, worth, n_docs, n_terms)
            for terms_, heap in zip(asked, heaps):
                wand(laid, terms_, heap, k)
        rows = [(q, None if i == -math.inf else -i, s) for q, heap in enumerate(heaps) for s, i in heap]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int32(), pa.int64(), pa.int64()))], ["question", "doc_id", "score"])

    return index.mapInArrow(search, _HITS)


def rank_documents(
    docs: DataFrame,
    questions: DataFrame,
    k: int = 50,
    most_terms: int = QUESTION_TERMS,
    block: int = BLOCK,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents of every question, best first, equal scores by the smaller id.

    Documents without a term of a question are none of its hits, nor are those
    that hold only terms without weight; a question may so have fewer hits, or
    none.  Null and empty texts hold no terms and are not counted.  Rows that
    repeat a text or an id each count and are ranked; rows without an id come
    last among equal scores.  Questions with the same id, or without one, are
    one question.  Ids are integers.  Empty tables give an empty result; no
    other column is read.
    """
    spark = docs.sparkSession
    rows = sent_small(narrow(docs, doc_id=doc_id, text=text)).select(F.col("doc_id").cast("long"), "text")
    asked = sent_small(narrow(questions, item_id=item_id, text=item_text)).select(F.col("item_id").cast("long"), "text")
    found = spark.createDataFrame([], "item_id bigint, doc_id bigint, score bigint")
    for items in question_blocks(asked, most_terms):
        known = {t: i for i, t in enumerate(sorted({t for _, ts in items for t in ts}))}
        index = materialize(postings(rows, known), "search-postings")
        totals = index.agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
        held = {r["term"]: r["df"] for r in index.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect()}  # a row a question term
        weights = [weight(totals["docs"], held.get(i, 0)) for i in range(len(known))]
        hits = shard_hits(index, [[known[t] for t in ts] for _, ts in items], weights, totals["docs"], totals["terms"] or 1, k, block)
        ids = spark.createDataFrame([(q, i) for q, (i, _) in enumerate(items)], "question int, item_id bigint")
        found = found.unionByName(hits.join(F.broadcast(ids), "question").select("item_id", "doc_id", "score"))  # one block's questions
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty best documents of every benchmark item."""
    return rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_TERMS = f"unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{_PATTERN}'))"

ORACLE = f"""
WITH words AS (SELECT line, doc_id, {_TERMS} AS term FROM (SELECT *, row_number() OVER () AS line FROM documents)),
lengths AS (SELECT line, doc_id, count(*) AS n FROM words GROUP BY line, doc_id),
totals AS (SELECT count(*) AS n_docs, sum(n)::bigint AS n_terms FROM lengths),
asked AS (SELECT DISTINCT item_id, {_TERMS} AS term FROM benchmark),
tf AS (SELECT line, term, count(*) AS tf FROM words WHERE term IN (SELECT term FROM asked) GROUP BY line, term),
weights AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::double / (2 * count(*) + 1)::double))::bigint AS w FROM tf, totals GROUP BY term, n_docs),
impacts AS (
  SELECT line, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms))) AS impact
  FROM tf JOIN weights USING (term) JOIN lengths USING (line), totals
),
scores AS (SELECT item_id, doc_id, line, sum(impact)::bigint AS score FROM asked JOIN impacts USING (term) GROUP BY item_id, doc_id, line)
SELECT item_id, rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0) WHERE rank <= 50
"""
