"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint of 64 bits is cut into two segments.  Where two fingerprints
differ in at most two bits, one segment differs in at most one; so each
segment is indexed once for every bit of it left out, an equality join on those
variants finds the candidates, and the whole fingerprints are compared.

Only distinct fingerprints are indexed, so that exact copies cost nothing, and
a variant that more than ``bucket`` fingerprints share is not paired at all:
its members are indexed by the whole fingerprint with every two bits left out.
Such a key has four members at most, so that way is exact and linear too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .components import connected_components
from .runtime import keyed, materialize, narrow, sent_small, table, without

BITS = 64
SEED = 42
#: Upper-case ASCII letters become lower-case; other bytes stay.
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Row b: the eight bits of byte b, the high one first.
_BIT_ROWS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def fingerprint(text: str | None, words: int = 3) -> int:
    """The unsigned SimHash of one text; 0 if it has no word."""
    found = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()  # bytes split at exactly these six
    if not found:
        return 0
    joined = b" ".join(found)
    if len(found) <= words:
        spans: Iterator = iter([(0, len(joined))])
        n = 1
    else:
        ends = np.cumsum(np.fromiter(map(len, found), dtype=np.int64, count=len(found)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        n = len(found) - words + 1
        spans = zip(starts[:n].tolist(), ends[words - 1 :].tolist())
    digest = xxhash.xxh64_digest
    hashes = np.frombuffer(b"".join([digest(joined[s:e], SEED) for s, e in spans]), dtype=np.uint8).reshape(n, 8)
    seen = np.stack([np.bincount(hashes[:, j], minlength=256) for j in range(8)])
    ones = (seen @ _BIT_ROWS).ravel()
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def with_fingerprint(df: DataFrame, text: str = "text", out: str = "fingerprint", words: int = 3) -> DataFrame:
    """``df`` with the SimHash of ``text`` as a signed long in column ``out``; a column of that name gives way."""
    fields, stay = without(df, out)
    schema = T.StructType([*fields, T.StructField(out, T.LongType(), False)])
    at = df.columns.index(text)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.fromiter((fingerprint(t.as_py(), words) for t in batch.column(at)), dtype=np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in stay], pa.array(values.view(np.int64))], names=[f.name for f in schema.fields])

    return sent_small(df).mapInArrow(each, schema)


def _variants(prints: DataFrame) -> DataFrame:
    """Both segments of each fingerprint with each bit left out: ``(key, fp)``."""
    half = F.when(F.col("k") < 32, F.col("fp").bitwiseAND(0xFFFFFFFF)).otherwise(F.shiftrightunsigned("fp", 32))
    left_out = half.bitwiseAND(F.expr("~shiftleft(1L, k % 32)"))
    return (
        prints.select("fp", F.explode(F.sequence(F.lit(0), F.lit(BITS - 1))).alias("k"))
        .select(left_out.bitwiseOR(F.expr("shiftleft(cast(k AS BIGINT), 32)")).alias("key"), "fp")
    )


def _pairs(index: DataFrame, max_bits: int) -> DataFrame:
    left = index.select("key", F.col("fp").alias("a"))
    right = index.select("key", F.col("fp").alias("b"))
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)
    return left.join(right, (left["key"] == right["key"]) & near).select("a", "b")


def _two_left_out(prints: DataFrame) -> DataFrame:
    """Links of at most two bits by keys that leave out two bits of the whole fingerprint."""
    i, j = F.explode(F.sequence(F.lit(0), F.lit(BITS - 2))).alias("i"), F.explode(F.expr("sequence(i + 1, 63)")).alias("j")
    keyed = prints.select("fp", i).select("fp", "i", j).select("fp", "i", "j", F.expr("fp & ~shiftleft(1L, i) & ~shiftleft(1L, j)").alias("rest"))
    least = F.min("fp").alias("a")
    members = F.collect_set("fp").alias("all")  # four at most
    return keyed.groupBy("i", "j", "rest").agg(least, members).where(F.size("all") > 1).select("a", F.explode("all").alias("b")).where("a <> b")


def fingerprint_links(prints: DataFrame, max_bits: int = 2, bucket: int = 512) -> DataFrame:
    """Distinct linked pairs ``(a, b)`` of a table ``(fp)`` of distinct fingerprints.

    ``max_bits`` is 1 or 2.  Links inside a crowded variant are returned as
    stars, which connect the same fingerprints.
    """
    if max_bits not in (1, 2):
        raise ValueError("max_bits must be 1 or 2")
    shared = _variants(prints).withColumn("n", F.count("*").over(Window.partitionBy("key"))).where("n > 1")
    shared = materialize(shared, "simhash-variants")
    crowded = shared.where(F.col("n") > bucket).select("fp").distinct()
    far = _two_left_out(crowded)
    if max_bits == 1:
        far = far.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 1)
    return _pairs(shared.where(F.col("n") <= bucket), max_bits).unionByName(far).distinct()


def _groups(prints: DataFrame, max_bits: int, bucket: int) -> DataFrame:
    """``prints`` (fp, ...), a row per fingerprint, with ``root``, which names its group."""
    roots = connected_components(fingerprint_links(prints.select("fp"), max_bits, bucket), label="simhash-components")
    return prints.join(roots, prints["fp"] == roots["node"], "left").withColumn("root", F.coalesce("root", "fp")).drop("node")


def near_duplicate_groups(df: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3, max_bits: int = 2, bucket: int = 512) -> DataFrame:
    """One row per row of ``df``: ``doc_id``, ``fingerprint`` (hex) and ``component_id``.

    ``component_id`` is the smallest ``doc_id`` reachable over links of at most
    ``max_bits`` bits.  A null or wordless text has fingerprint zero and is
    linked like any other; a null ``doc_id`` keeps its row but names no group;
    repeated rows are kept; an empty table gives an empty one.  Other columns of
    ``df`` are not read.
    """
    docs = materialize(with_fingerprint(narrow(df, doc_id=doc_id, text=text), out="fp", words=words).select("doc_id", "fp"), "simhash-docs")
    linked = _groups(docs.groupBy("fp").agg(F.min("doc_id").alias("least")), max_bits, bucket)
    named = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    groups = linked.join(named, "root").select("fp", "component_id")
    return docs.join(groups, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def first_row() -> Column:
    """Of several rows the one that stays: that of the smallest id, null last, then of the first place."""
    return F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_file", "row_place")).alias("first")


def keep_rows(rows: DataFrame, at: list[str], firsts: DataFrame) -> DataFrame:
    """The rows of a keyed table that are a ``first`` in ``firsts``, without their keys."""
    kept = materialize(firsts.select(*[F.col(f"first.{c}").alias(name) for c, name in zip(("row_file", "row_place"), at)]), "first-rows")
    return rows.join(kept.hint("shuffle_hash"), at, "left_semi").drop(*at)  # two numbers a row, evenly dealt


def drop_near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3, max_bits: int = 2, bucket: int = 512) -> DataFrame:
    """One row of every group: that of the smallest id, null last.

    Rows are told apart by their place in their files: texts without an id, or
    with the same one, are grouped by what they say like any others.
    """
    rows, at = keyed(df)
    docs = narrow(rows, doc_id=doc_id, text=text, row_file=at[0], row_place=at[1])
    docs = materialize(with_fingerprint(docs, out="fp", words=words).drop("text"), "simhash-docs")
    linked = _groups(docs.groupBy("fp").agg(first_row()), max_bits, bucket)
    return keep_rows(rows, at, linked.groupBy("root").agg(F.min("first").alias("first")))


def op1_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash groups of all documents: words in threes, links of two bits or fewer."""
    return near_duplicate_groups(table(spark, sf_dir, "documents"))
