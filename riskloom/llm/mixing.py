"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source is wanted ``target / source size`` times.  The whole
part of that is taken at once; the fraction is a probability of one more copy.
Two documents at a time, words of probability move from one to the other, in a
random direction that keeps both expectations, until one of them is settled at
zero or one.  What a source takes then changes only by the rounding of its last
unsettled document, and ``made_up`` documents of the size that is nearest to
that difference make up for it.

The pairing is a reduction tree: the rows of each source are dealt to groups of
about ``fan_in``, each group is settled but for one document by a fold over its
rows from the largest to the smallest, and those that are left go on to the
next level, until their source has a single group.  DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .runtime import keyed, materialize, narrow, table, unused_name

WORD = r"[^\x20\x09-\x0D]+"
_ALMOST = 1e-9
_ITEM = "struct<size:bigint,doc_id:bigint,copy_no:bigint,p:double>"
#: Rows of one class that are numbered at a time.
BLOCK = 100_000


def source_targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), most: float = 3.0) -> DataFrame:
    """``sizes`` (source, source_size) with ``target``: weights dealt by code point, null last, capped at ``most`` times the size.

    What a cap leaves over is shared by weight among the others until none is
    above its cap.  Sorted by the level at which they reach their caps, the
    capped sources come first, so running sums give the final level at once.
    One row per source, not per document, passes through the windows.
    """
    named = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.row_number().over(named)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((turn - 1) % len(weights) + 1).cast("int"))
    room = sizes.withColumn("turn", turn).withColumn("weight", weight).withColumn("most", F.col("source_size") * float(most))
    by_level = Window.orderBy(F.col("most") / F.col("weight"), "turn")
    before, rest = by_level.rowsBetween(Window.unboundedPreceding, -1), by_level.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    room = room.withColumn("level", level).withColumn("fits", F.col("level") * F.col("weight") <= F.col("most"))
    final = F.max(F.when(F.col("fits"), F.col("level"))).over(everything)  # of the first that fits: later ones take sources as capped that are not
    return room.withColumn("final", final).select("source", "source_size", F.least("most", F.coalesce(F.col("final") * F.col("weight"), F.col("most"))).alias("target"))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _item(of: Column, p: Column) -> Column:
    return F.struct(of["size"].alias("size"), of["doc_id"].alias("doc_id"), of["copy_no"].alias("copy_no"), p.alias("p"))


def _chance(a: Column, b: Column, seed: int) -> Column:
    hashed = F.xxhash64(a["doc_id"], a["copy_no"], a["size"], b["doc_id"], b["copy_no"], b["size"], F.lit(seed))
    return F.shiftrightunsigned(hashed, 11) / F.lit(float(1 << 53))


def _settled(p: Column) -> Column:
    return (p <= _ALMOST) | (p >= 1 - _ALMOST)


def _pivot(carry: Column, item: Column, done: Column, seed: int) -> Column:
    """Move words of probability between two items until one is settled."""

    def after(v: Column) -> Column:
        a, b = v["a"], v["b"]
        a_free = ~_settled(a["p"])
        settled = F.concat(F.when(~a_free, F.array(a)).otherwise(F.expr(f"cast(array() AS array<{_ITEM}>)")), F.when(a_free | _settled(b["p"]), F.array(b)).otherwise(F.expr(f"cast(array() AS array<{_ITEM}>)")))
        return F.struct(F.when(a_free, a).when(~_settled(b["p"]), b).alias("carry"), F.concat(done, settled).alias("done"))

    def moved(v: Column) -> Column:
        by = F.when(v["u"] * (v["up"] + v["down"]) < v["down"], v["up"]).otherwise(-v["down"])
        return F.struct(_item(carry, carry["p"] + by / carry["size"]).alias("a"), _item(item, item["p"] - by / item["size"]).alias("b"))

    masses = F.struct(
        F.least((1 - carry["p"]) * carry["size"], item["p"] * item["size"]).alias("up"),
        F.least(carry["p"] * carry["size"], (1 - item["p"]) * item["size"]).alias("down"),
        _chance(carry, item, seed).alias("u"),
    )
    return _let(masses, lambda m: _let(moved(m), after))


def _fold(items: Column, seed: int) -> Column:
    """``struct(carry, done)``: the items of a group settled but for one at most."""
    start = F.expr(f"named_struct('carry', cast(null AS {_ITEM}), 'done', cast(array() AS array<{_ITEM}>))")
    first = lambda acc, x: F.struct(x.alias("carry"), acc["done"].alias("done"))
    return F.aggregate(items, start, lambda acc, x: F.when(acc["carry"].isNull(), first(acc, x)).otherwise(_pivot(acc["carry"], x, acc["done"], seed)))


def _joined(left: DataFrame, right: DataFrame, names: Sequence[str], how: str = "inner") -> DataFrame:
    """A join on columns of the same names in which null equals null."""
    other = right.withColumnsRenamed({c: f"{c}_of_other" for c in names})
    found = left.join(other, [F.col(c).eqNullSafe(F.col(f"{c}_of_other")) for c in names], how)
    return found.drop(*[f"{c}_of_other" for c in names])


def _numbered(classes: DataFrame) -> DataFrame:
    """``classes`` with ``copy_no`` from 1 to ``n``, a row each; classes of very many rows are dealt to tasks in blocks."""
    few = classes.where(F.col("n") <= BLOCK).withColumn("copy_no", F.explode(F.expr("sequence(1L, n)")))
    blocks = classes.where(F.col("n") > BLOCK).withColumn("first", F.explode(F.expr(f"sequence(1L, n, {BLOCK}L)"))).repartition("doc_id", "size", "first")
    many = blocks.withColumn("copy_no", F.explode(F.expr(f"sequence(first, least(first + {BLOCK - 1}L, n))"))).drop("first")
    return few.unionByName(many)


def _mixed(sizes: DataFrame, weights: Sequence[float], most: float, seed: int, fan_in: int, made_up: int) -> DataFrame:
    """``sizes`` (source, doc_id, size) to ``source, doc_id, size, source_size, target, copy_no, copies``.

    Equal rows are counted first and told apart by ``copy_no``, from 1.
    """
    classes = sizes.groupBy("source", "doc_id", "size").agg(F.count("*").alias("n"))
    targets = materialize(source_targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most), "mix-targets")
    wanted = _joined(classes, targets, ["source"], "left")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(ratio + _ALMOST)
    wanted = wanted.withColumn("whole", whole).withColumn("p", F.greatest(ratio - whole, F.lit(0.0)))
    open_ = (F.col("size") > 0) & (F.col("p") > _ALMOST)
    columns = ("source", "doc_id", "size", "source_size", "target", "whole", "copy_no", "open", "extra")
    numbered = materialize(_numbered(wanted.withColumn("open", open_)), "mix-numbered")
    settled = [numbered.where("NOT open").withColumn("extra", F.lit(0)).select(*columns)]

    open_rows = numbered.where("open")
    groups_of = lambda n: F.ceil(n / F.lit(fan_in)).cast("long")
    counts = materialize(open_rows.groupBy("source").agg(groups_of(F.count("*")).alias("groups")), "mix-groups")
    largest = counts.agg(F.max("groups")).first()[0] or 0
    rows = _joined(open_rows, counts, ["source"])
    level = 0
    key = ("source", "source_size", "target", "whole", "groups")
    done_columns = [F.lit(True).alias("open"), F.round("p").cast("int").alias("extra")]
    while largest:
        # A source of one group is down to one open row after this level, and goes no further.
        dealt = F.pmod(F.xxhash64("doc_id", "copy_no", "size", F.lit(seed + level)), F.col("groups"))
        items = F.collect_list(F.struct("size", "doc_id", "copy_no", "p"))
        folded = rows.groupBy(*key, dealt.alias("group")).agg(_fold(F.sort_array(items, asc=False), seed + level).alias("fold"))
        folded = materialize(folded.select(*key, "fold.carry", "fold.done"), f"mix-level-{level}")
        settled.append(folded.select(*key, F.explode("done").alias("x")).select(*key, "x.*").select("*", *done_columns).select(*columns))
        last = F.shiftrightunsigned(F.xxhash64("doc_id", "copy_no", "size", F.lit(~seed)), 11) / F.lit(float(1 << 53)) < F.col("p")
        left = folded.where("carry IS NOT NULL").select(*key, "carry.*")
        settled.append(left.where("groups = 1").withColumns({"open": F.lit(True), "extra": last.cast("int")}).select(*columns))
        rows = left.where("groups > 1").withColumn("groups", groups_of(F.col("groups")))
        largest = 0 if largest == 1 else -(-largest // fan_in)
        level += 1

    rounded = settled[0]
    for part in settled[1:]:
        rounded = rounded.unionByName(part)
    rounded = _make_up(materialize(rounded, "mix-rounded"), made_up)
    return rounded.withColumn("copies", (F.col("whole") + F.col("extra")).cast("long"))


def _sizes(df: DataFrame, *more: str, **columns: str) -> DataFrame:
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return narrow(df, **columns).select(F.col("doc_id").cast("long"), "source", size.alias("size"), *more)


def mix_sources(
    df: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    doc_id: str = "doc_id",
    source: str = "source",
    text: str = "text",
    most: float = 3.0,
    seed: int = 42,
    fan_in: int = 128,
    made_up: int = 3,
) -> DataFrame:
    """``doc_id, size, source_size, target, copies, taken`` for every row of ``df``.

    ``size`` counts the words of a text (null or empty: 0, never taken);
    a null source is a source of its own, the last.  Repeated rows are separate
    rows, each with its own copies.  Reruns agree, whatever the partitions.  An
    empty table gives an empty one, and no other column is read.  ``doc_id`` is
    an integer and may be null.

    The levels of the tree are as many as the logarithm, to the base
    ``fan_in``, of the rows of the largest source; the number of sources does
    not matter.  Every document's expected copies are its wanted ones up to the
    at most ``made_up`` documents of a source that are turned at the end, which
    trade that for a total nearer to the target.
    """
    sizes = materialize(_sizes(df, doc_id=doc_id, source=source, text=text), "mix-sizes")
    mixed = _mixed(sizes, weights, most, seed, fan_in, made_up)
    return mixed.select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def _make_up(rounded: DataFrame, rounds: int) -> DataFrame:
    """Settle what the last rounding cost a source: turn the one document whose extra copy comes nearest to it, a few times.

    Only per-source minima move; a source that no document brings nearer keeps its copies.
    """
    row = ("source", "doc_id", "size", "copy_no")
    off = materialize(rounded.groupBy("source").agg((F.sum((F.col("whole") + F.col("extra")) * F.col("size")) - F.first("target")).alias("off")), "mix-off")
    turned = None
    for k in range(rounds):
        open_ = rounded.where("open").select(*row, "extra")
        if turned is not None:
            open_ = _joined(open_, turned, row, "left_anti")
        near = _joined(open_, off, ["source"])
        step = F.when(F.col("extra") == 1, -F.col("size")).otherwise(F.col("size"))
        rest = F.abs(F.col("off") + step)
        choice = F.struct(rest.alias("rest"), "size", "doc_id", "copy_no", "extra")
        best = near.where(rest < F.abs("off")).groupBy("source").agg(F.min(choice).alias("x"))
        best = materialize(best.select("source", "x.*"), f"mix-turned-{k}")
        off = _joined(off, best.select("source", step.alias("step")), ["source"], "left")
        off = materialize(off.select("source", (F.col("off") + F.coalesce("step", F.lit(0))).alias("off")), "mix-off")
        best = best.select(*row)
        turned = best if turned is None else turned.unionByName(best)
    if turned is None:
        return rounded
    found = _joined(rounded, turned.withColumn("turn", F.lit(1)), row, "left")
    return found.withColumn("extra", F.when(F.col("turn") == 1, 1 - F.col("extra")).otherwise(F.col("extra"))).drop("turn")


def repeat_to_mix(
    df: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    doc_id: str = "doc_id",
    source: str = "source",
    text: str = "text",
    most: float = 3.0,
    seed: int = 42,
    fan_in: int = 128,
    made_up: int = 3,
) -> DataFrame:
    """The rows of ``df`` as often as the mix takes them; rows that it leaves out go.

    Every row has its own copies, with an id, without one or with a repeated
    one: rows are told apart by their place in their files, not by ids.
    """
    rows, at = keyed(df)
    named = _sizes(rows, "row_file", "row_place", doc_id=doc_id, source=source, text=text, row_file=at[0], row_place=at[1])
    named = materialize(named, "mix-rows")
    same = ("source", "doc_id", "size")
    mixed = materialize(_mixed(named.select(*same), weights, most, seed, fan_in, made_up).select(*same, "copy_no", "copies"), "mix-copies")
    # Rows that agree in source, id and size are numbered in parts of about BLOCK rows, so that no task orders them all.
    repeated = mixed.groupBy(*same).agg(F.count("*").alias("n")).where("n > 1")
    several = _joined(named, repeated, same)
    part = F.pmod(F.xxhash64("row_file", "row_place"), F.ceil(F.col("n") / BLOCK).cast("long"))
    several = several.withColumn("part", part).withColumn("at", F.row_number().over(Window.partitionBy(*same, "part").orderBy("row_file", "row_place")))
    several = materialize(several, "mix-repeated")
    before = several.groupBy(*same, "part").agg(F.count("*").alias("in_part"))
    before = before.withColumn("before", F.sum("in_part").over(Window.partitionBy(*same).orderBy("part")) - F.col("in_part")).drop("in_part")
    numbered = _joined(several, before, (*same, "part")).select(*named.columns, (F.col("at") + F.col("before")).alias("copy_no"))
    alone = _joined(named, repeated.drop("n"), same, "left_anti").withColumn("copy_no", F.lit(1).cast("long"))
    numbered = alone.unionByName(numbered)
    copies = unused_name(rows, "copies")
    taken = _joined(numbered, mixed, (*same, "copy_no")).where("copies > 0").select("row_file", "row_place", F.col("copies").alias(copies))
    taken = materialize(taken.withColumnsRenamed(dict(zip(("row_file", "row_place"), at))), "mix-taken")
    turn = unused_name(rows, "turn")
    found = rows.join(taken.hint("shuffle_hash"), at).drop(*at)  # a few numbers a row, evenly dealt
    return found.withColumn(turn, F.explode(F.expr(f"sequence(1L, `{copies}`)"))).drop(copies, turn)


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed at weights 5, 2, 1 by source, at most three copies of each."""
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")
