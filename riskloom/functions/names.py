"""Package names: normal forms and distances."""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..corpus import Corpus


def pep503(name: Column) -> Column:
    """Lower case, with runs of ``-``, ``_`` and ``.`` as one dash."""
    return F.lower(F.regexp_replace(name, "[-_.]+", "-"))


def without_scope(name: Column) -> Column:
    return F.when(name.startswith("@"), F.substring_index(name, "/", -1)).otherwise(name)


def compared_name(ecosystem: Column, name: Column) -> Column:
    """The form of a name that the naming rules compare."""
    bare = F.lower(without_scope(name))
    return F.when(ecosystem == "pypi", pep503(bare)).otherwise(bare)


#: Letters at the beginning of a name that its keys are made of.
KEYED = 7


def letters_left_out(name: str, most: int = 2) -> Column:
    """The first ``KEYED`` letters of a name, and what is left of them without any one, or any ``most`` (1 or 2).

    Two names within ``most`` edits share one of these at least, an edit being
    a letter more, less or other, or two neighbours swapped: each edit takes
    one letter at most from either beginning, be it changed or pushed out.
    """
    # One expression as text: as columns it would take hundreds of calls to the JVM.
    without = lambda text, i: f"concat(left({text}, {i - 1}), substr({text}, {i + 1}))"
    at = [("h", 0), *[(without("h", i), i) for i in range(1, KEYED + 1)]]
    if most > 1:
        at += [(without(without("h", j), i), j) for j in range(2, KEYED + 1) for i in range(1, j)]
    keys = ", ".join(f"CASE WHEN length(h) >= {least} THEN {key} END" for key, least in at)
    return F.expr(f"array_compact(element_at(transform(array(left({name}, {KEYED})), h -> array({keys})), 1))")


def swap_distance(a: Column, b: Column) -> Column:
    """Edits between two strings, where swapping neighbours is one edit and no part is edited twice.

    One row of the table of prefixes after the other, each an array; for the few
    pairs that share a key, as it is not compiled.
    """
    empty = F.array().cast("array<int>")
    letter = lambda text, i: F.substr(text, i, F.lit(1))
    start = F.sequence(F.lit(0), F.length(b))

    def next_row(state: Column, i: Column) -> Column:
        above, before = state["above"], state["before"]

        def cell(row: Column, j: Column) -> Column:
            same = F.when(letter(a, i) == letter(b, j), 0).otherwise(1)
            plain = F.least(F.element_at(above, j + 1) + 1, F.element_at(row, -1) + 1, F.element_at(above, j) + same)
            swapped = (i > 1) & (j > 1) & (letter(a, i) == letter(b, j - 1)) & (letter(a, i - 1) == letter(b, j))
            return F.array_append(row, F.when(swapped, F.least(plain, F.try_element_at(before, j - 1) + same)).otherwise(plain))

        columns = F.when(F.length(b) > 0, F.sequence(F.lit(1), F.length(b))).otherwise(empty)
        return F.struct(F.aggregate(columns, F.array(i), cell).alias("above"), above.alias("before"))

    rows = F.when(F.length(a) > 0, F.sequence(F.lit(1), F.length(a))).otherwise(empty)
    return F.aggregate(rows, F.struct(start.alias("above"), empty.alias("before")), next_row, lambda s: F.element_at(s["above"], -1))


def popular_table(spark: SparkSession, corpus: Corpus) -> DataFrame:
    """``(ecosystem, target)`` of a corpus, which is a list that people keep and so is small."""
    return spark.createDataFrame(_popular(corpus))


@lru_cache(maxsize=8)
def _popular(corpus: Corpus) -> pa.Table:
    return _strings(["ecosystem", "target"], [(e, n) for e in ("npm", "pypi") for n in corpus.names(e)])


def _strings(columns: list[str], rows: list[tuple]) -> pa.Table:
    return pa.table({c: pa.array([r[i] for r in rows], pa.string()) for i, c in enumerate(columns)})


def nearest_popular(asked: DataFrame, corpus: Corpus, most: int = 2) -> DataFrame:
    """``asked`` (ecosystem, compared; repeats count once) to ``ecosystem, compared, distance, target``: the closest popular name at one to ``most`` edits, of equally close ones the first.

    Names meet by equality of what is left without some letters; only those
    that meet are compared.  Names are dealt out once: a name's keys, what they
    meet and what is nearest stay in its partition.
    """
    name = ["ecosystem", "compared"]
    popular = popular_table(asked.sparkSession, corpus)
    lengths = [len(n) for e in ("npm", "pypi") for n in corpus.names(e)] or [0]
    may = asked.select(*name).where(F.length("compared").between(min(lengths) - most, max(lengths) + most))
    dealt = may.repartition(asked.sparkSession.sparkContext.defaultParallelism, *name).distinct()  # few bytes, but each name has many keys
    left = dealt.select(*name, F.explode(letters_left_out("compared", most)).alias("key"))
    right = popular.select("ecosystem", "target", F.explode(letters_left_out("target", most)).alias("key"))
    near = F.levenshtein("compared", "target", 2 * most) >= 0  # a swap is two plain edits
    alike = (F.abs(F.length("compared") - F.length("target")) <= most) & near
    met = left.join(F.broadcast(right.distinct()), ["ecosystem", "key"]).where(alike).groupBy(*name).agg(F.collect_set("target").alias("targets"))
    far = F.transform("targets", lambda t: F.struct(swap_distance(F.col("compared"), t).alias("distance"), t.alias("target")))
    hit = F.array_min(F.filter(far, lambda x: x["distance"].between(1, most)))
    return met.select(*name, hit.alias("hit")).where("hit IS NOT NULL").select(*name, "hit.distance", "hit.target")


def with_affixes(spark: SparkSession, corpus: Corpus, affixes: dict[str, tuple[str, ...]], least: int = 4) -> DataFrame:
    """``ecosystem, worn, stripped, affix``: every popular name of ``least`` letters or more with an affix put on it.

    An affix stands in front or behind, with a separator or without.  Where one
    worn name comes of several, the one of the first affix in its list counts,
    and of that the first way: in front with a separator, behind with one, in
    front, behind.
    """
    return spark.createDataFrame(_worn(corpus, tuple((e, tuple(a)) for e, a in affixes.items()), least))


@lru_cache(maxsize=8)
def _worn(corpus: Corpus, affixes: tuple[tuple[str, tuple[str, ...]], ...], least: int) -> pa.Table:
    best: dict[tuple[str, str], tuple] = {}
    for ecosystem, known in affixes:
        for name in corpus.names(ecosystem):
            if len(name) < least:
                continue
            for i, affix in enumerate(known):
                ways = [[affix + sep + name for sep in "-_."], [name + sep + affix for sep in "-_."], [affix + name], [name + affix]]
                for way, forms in enumerate(ways):
                    for worn in forms:
                        row = (ecosystem, worn, name, affix, i * 4 + way)
                        best[row[:2]] = min(best.get(row[:2], row), row, key=lambda r: r[4])
    return _strings(["ecosystem", "worn", "stripped", "affix"], list(best.values()))
