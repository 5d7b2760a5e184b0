"""Near-duplicates by the exact Jaccard similarity of five-word shingles.

Two sets that are alike to four fifths share a shingle among the first fifth of
each, in whatever order all shingles are put.  So those shingles are the keys of
an equality join that misses no pair.  The order only decides the work: frequent
shingles, as a sample shows them, come last.  A bitmap of the parity of each
set's hashes bounds the difference of two sets from below, which leaves few
pairs to compare whole.

A key that more than ``bucket`` texts share is not paired out: its texts are
compared with ``PIVOTS`` of them, and what the links so far do not join to the
key's largest component is compared with all of the key: first a few of them,
which in a crowd of near copies link most of the others, then whatever is still
apart.  Two texts of that component need no link between them, so no component
is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .components import connected_components
from .runtime import keyed, materialize, narrow, sent_small, thrifty
from .simhash import _LOWER, first_row, keep_rows

WORDS = 5
#: Bits of a bitmap, in longs of 64.
_LONGS = 8
_BITMAP = [f"m{i}" for i in range(_LONGS)]
_COUNTED = 512
#: Bytes that a side of a join may have to be broadcast; a larger one is shuffled.
_BROADCAST = 32 << 20
#: Texts of a crowded key that all of its texts are compared with.
PIVOTS = 8
#: Then, round after round, of those outside its largest component so many more; 0: all.
MORE_PIVOTS = (8, 32, 0)
#: Crowded keys of a text by which it is told whether a pair was met under another key.
CARRIED = 64
#: One text in so many is read to find frequent shingles, of which so many at most are put last.
_ORDER_SHARE, _ORDER_LATE = 8, 1 << 16


def _lowered(text: str | None) -> bytes:
    """Words of ASCII lower case, as ``simhash.fingerprint`` splits them, by single blanks."""
    return b" ".join((text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split())


def text_hash(joined: bytes) -> int:
    return xxhash.xxh64_intdigest(joined, 7)


def shingles(joined: bytes, words: int = WORDS) -> np.ndarray:
    """Sorted hashes of the different shingles; a shorter text is one shingle, a wordless one has none."""
    if not joined:
        return np.zeros(0, np.uint64)
    ends = np.append(np.nonzero(np.frombuffer(joined, np.uint8) == 32)[0], len(joined))
    n = max(1, len(ends) - words + 1)
    starts = np.concatenate(([0], ends[:-1] + 1))[:n]
    digest = xxhash.xxh64_intdigest
    found = [digest(joined[a:b]) for a, b in zip(starts.tolist(), ends[-n:].tolist())]
    return np.unique(np.array(found, dtype=np.uint64))


def prefix(found: np.ndarray, late: np.ndarray | None = None) -> np.ndarray:
    """The shingles of which a set shares one at least with any set alike to four fifths; ``late`` ones come last, in its order."""
    n = len(found)
    if not n:
        return found
    size = n - (4 * n + 4) // 5 + 1
    if late is not None and len(late):
        by_hash = np.argsort(late)
        at = np.minimum(np.searchsorted(late[by_hash], found), len(late) - 1)
        rank = np.where(late[by_hash][at] == found, by_hash[at] + 1, 0)
        found = found[np.argsort(rank, kind="stable")]
    return found[:size]


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.astype(np.uint64).view(np.int64))


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), _signed(np.concatenate(rows) if rows else np.zeros(0, np.uint64)))


def _late_shingles(texts: DataFrame, bucket: int) -> np.ndarray:
    """Frequent first shingles of a sample of ``texts``, the rarer ones first."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [prefix(shingles(_lowered(t.as_py()))) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([_signed(np.concatenate(found) if found else np.zeros(0, np.uint64))], names=["key"])

    some = texts.where(F.pmod(F.xxhash64("text"), F.lit(_ORDER_SHARE)) == 0)
    counts = sent_small(some.select("text")).mapInArrow(thrifty(each), "key long").groupBy("key").agg(F.count("*").alias("n"))
    rows = counts.where(F.col("n") > max(1, bucket // _ORDER_SHARE)).orderBy(F.desc("n"), "key").limit(_ORDER_LATE).toArrow()
    return rows.column("key").to_numpy().view(np.uint64)[::-1].copy()


def _prints(docs: DataFrame, late: np.ndarray) -> DataFrame:
    """``(doc_id, row_file, row_place, h, n, m0.., keys)`` of ``(doc_id, row_file, row_place, text)``."""
    sent = docs.sparkSession.sparkContext.broadcast(late)  # _ORDER_LATE at most
    about = ["doc_id", "row_file", "row_place"]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            joined = [_lowered(t.as_py()) for t in batch.column(3)]
            sets = [shingles(j) for j in joined]
            bits = np.stack([np.packbits(np.bincount((s & np.uint64(511)).astype(np.int64), minlength=512) & 1) for s in sets]).view(np.uint64) if sets else np.zeros((0, _LONGS), np.uint64)
            hashes = np.array([text_hash(j) for j in joined], dtype=np.uint64)
            sizes = pa.array([len(s) for s in sets], pa.int64())
            counts = pa.array([np.minimum(np.bincount((s >> np.uint64(9)).astype(np.int64) & (_COUNTED - 1), minlength=_COUNTED), 255).astype(np.uint8).tobytes() for s in sets], pa.binary())
            keys = _lists([prefix(s, sent.value) for s in sets])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], _signed(hashes), sizes, *[_signed(bits[:, i].copy()) for i in range(_LONGS)], counts, keys], names=[*about, "h", "n", *_BITMAP, "counts", "keys"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return sent_small(docs).mapInArrow(thrifty(each), f"doc_id {kind}, row_file long, row_place long, h long, n long, {', '.join(f'{m} long' for m in _BITMAP)}, counts binary, keys array<long>")


def _sent(df: DataFrame, row_bytes: int) -> DataFrame:
    """``df``, to be broadcast if its rows, counted, are within ``_BROADCAST`` bytes."""
    return F.broadcast(df) if df.count() * row_bytes <= _BROADCAST else df


def _sets(docs: DataFrame, needed: DataFrame) -> DataFrame:
    """``(h, all)``: the whole sets of the texts that stand at the places in ``needed`` (h, row_file, row_place)."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists([shingles(_lowered(t.as_py())) for t in batch.column(1)])], names=["h", "all"])

    texts = docs.join(_sent(needed, 24), ["row_file", "row_place"]).select("h", "text")
    return sent_small(texts).mapInArrow(thrifty(whole), "h long, all array<long>")


def _counts_allow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (a, b, n of both, counts of each) the pairs (a, b) that the counts do not rule out."""
    for batch in batches:
        one, two = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, _COUNTED).astype(np.int16) for i in (3, 4))
        differ = np.abs(one - two).sum(axis=1, dtype=np.int64)
        keep = pa.array(9 * differ <= batch.column(2).to_numpy())
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])


def _may_be_alike(a: str, b: str) -> Column:
    """False only where the bitmaps or sizes rule out that two sets are alike to four fifths."""
    differ = " + ".join(f"bit_count({a}.{m} ^ {b}.{m})" for m in _BITMAP)
    return F.expr(f"9 * abs({a}.n - {b}.n) <= {a}.n + {b}.n AND 9 * ({differ}) <= {a}.n + {b}.n")


def _alike(pairs: DataFrame, texts: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs ``(a, b)`` whose sets are alike to four fifths, written.

    ``texts`` has a row per text with ``n``, ``counts`` and the place of one of its rows in ``docs``.
    """
    one, two = (texts.select(F.col("h").alias(c), F.col("n").alias(f"n_{c}"), F.col("counts").alias(f"counts_{c}")) for c in "ab")
    counted = one.join(_sent(pairs, 16), "a").join(two, "b").select("a", "b", (F.col("n_a") + F.col("n_b")).alias("n"), "counts_a", "counts_b")
    pairs = materialize(counted.mapInArrow(thrifty(_counts_allow), "a long, b long"), "shingle-near")
    ends = pairs.select(F.col("a").alias("h")).unionByName(pairs.select(F.col("b").alias("h"))).distinct()
    needed = materialize(texts.join(_sent(ends, 8), "h").select("h", "row_file", "row_place"), "shingle-needed")
    sets = materialize(_sets(docs, needed), "shingle-sets")
    left, right = (sets.select(F.col("h").alias(c), F.col("all").alias(f"all_{c}")) for c in "ab")
    both = left.join(_sent(pairs, 16), "a").join(right, "b")
    common = F.size(F.array_intersect("all_a", "all_b"))
    links = both.where(9 * common >= 4 * (F.size("all_a") + F.size("all_b"))).select("a", "b")
    return materialize(links, "shingle-links")


def _carried(crowded: DataFrame) -> DataFrame:
    """``crowded`` with ``carried``: the least crowded keys of the row's text."""
    keys = crowded.groupBy("h").agg(F.slice(F.sort_array(F.collect_list("key")), 1, CARRIED).alias("carried"))  # of one text's prefix
    return crowded.join(keys, "h")


def _met_first(a: str, b: str) -> Column:
    """True for a pair under the least of the keys that both carry, so that near copies, which share most keys, are one row and not one for each key."""
    common = F.array_min(F.array_intersect(f"{a}.carried", f"{b}.carried"))
    return common.isNull() | (common == F.col(f"{a}.key"))


def _ordered(a: str, b: str) -> list[Column]:
    return [F.least(f"{a}.h", f"{b}.h").alias("a"), F.greatest(f"{a}.h", f"{b}.h").alias("b")]


def _linked(docs: DataFrame, bucket: int) -> tuple[DataFrame, DataFrame]:
    """Of ``docs`` (doc_id, row_file, row_place, text): each row with its text's hash ``h``, and ``(h, root, first)``, a row per text with its group and its first row."""
    prints = materialize(_prints(docs, _late_shingles(docs, bucket)), "shingle-prints")
    columns = ("row_file", "row_place", "n", *_BITMAP, "counts", "keys")
    alone = F.min(F.struct("row_file", "row_place", *[c for c in columns if c not in ("row_file", "row_place")])).alias("x")  # any row of the text serves
    texts = materialize(prints.groupBy("h").agg(alone).select("h", *[f"x.{c}" for c in columns]), "shingle-texts")
    by_key = texts.select("h", F.explode("keys").alias("key")).withColumn("sharers", F.count("*").over(Window.partitionBy("key"))).where("sharers > 1")
    shared = materialize(by_key.join(texts.select("h", "n", *_BITMAP).hint("shuffle_hash"), "h"), "shingle-keys")
    few, crowded = shared.where(F.col("sharers") <= bucket), shared.where(F.col("sharers") > bucket)
    crowded = materialize(_carried(crowded), "shingle-crowds")

    pairs = few.alias("x").join(few.alias("y"), F.expr("x.key = y.key AND x.h < y.h") & _may_be_alike("x", "y")).select(*_ordered("x", "y"))
    pivots = crowded.withColumn("place", F.row_number().over(Window.partitionBy("key").orderBy("h"))).where(F.col("place") <= PIVOTS)
    stars = crowded.alias("x").join(pivots.alias("y"), F.expr("x.key = y.key AND x.h <> y.h") & _may_be_alike("x", "y")).select(*_ordered("x", "y"))
    pairs = materialize(pairs.unionByName(stars).distinct(), "shingle-pairs")
    links = _alike(pairs, texts, docs)

    for more in MORE_PIVOTS if not crowded.isEmpty() else ():
        roots = connected_components(links, label="shingle-components")
        placed = crowded.join(roots.select(F.col("node").alias("h"), "root"), "h", "left").withColumn("root", F.coalesce("root", "h"))
        placed = materialize(placed, "shingle-crowded")
        largest = placed.groupBy("key", "root").agg(F.count("*").alias("size")).groupBy("key").agg(F.max(F.struct("size", "root")).alias("top"))
        apart = placed.join(largest.select("key", F.col("top.root").alias("top_root")), "key").where("root <> top_root").drop("top_root")
        if more:
            apart = apart.withColumn("place", F.row_number().over(Window.partitionBy("key").orderBy("h"))).where(F.col("place") <= more).drop("place")
        across = apart.alias("x").join(placed.alias("y"), F.expr("x.key = y.key AND x.root <> y.root") & _may_be_alike("x", "y") & _met_first("x", "y")).select(*_ordered("x", "y"))
        across = materialize(across.distinct(), "shingle-across")
        if not across.isEmpty():
            links = links.unionByName(_alike(across, texts, docs))

    roots = connected_components(links, label="shingle-components")
    named = prints.groupBy("h").agg(F.min("doc_id").alias("least"), first_row())
    linked = named.join(roots, named["h"] == roots["node"], "left").select("h", "least", "first", F.coalesce("root", "h").alias("root"))
    return prints.select("doc_id", "h"), linked


def near_duplicate_groups(df: DataFrame, doc_id: str = "doc_id", text: str = "text", bucket: int = 64) -> DataFrame:
    """One row per row of ``df``: ``doc_id`` and ``component_id``, the smallest ``doc_id`` reachable over links.

    Texts are linked if four fifths of their five-word shingles, of both
    together, are common; wordless ones are all alike.  A null ``doc_id`` keeps
    its row but names no group.
    """
    rows, at = keyed(df)
    docs, linked = _linked(narrow(rows, doc_id=doc_id, row_file=at[0], row_place=at[1], text=text), bucket)
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    return docs.join(linked.join(least, "root").select("h", "component_id"), "h").select("doc_id", "component_id")


def drop_near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", bucket: int = 64) -> DataFrame:
    """One row of every group: that of the smallest id, null last; rows are told apart by their place in their files."""
    rows, at = keyed(df)
    _, linked = _linked(narrow(rows, doc_id=doc_id, row_file=at[0], row_place=at[1], text=text), bucket)
    return keep_rows(rows, at, linked.groupBy("root").agg(F.min("first").alias("first")))
