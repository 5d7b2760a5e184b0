"""Embedding near-duplicates over a robust-pruned flat graph.

Vectors of one label are cut into cells around pivots; a vector is at home with
its nearest pivot and joins every other cell from whose border it is no farther
than two linked vectors can be, so that all its links are in its home cell
whatever the cut.  In every cell a graph is built: of each vector's nearest, one
is dropped if it is much closer to a neighbour already kept, and a few links go
far.  A vector's adjacency lists from all its
cells are united.  Then every vector is searched for from its own cell's medoid,
greedily, and from what lies within the threshold the search widens as long as
it finds more; all links are verified by exact cosine.  The search of each cell
is audited against brute force on a sample of its vectors, and repeated with a
wider beam where it missed any.

A cell that no cut makes smaller, because its vectors are all alike, is dealt to
blocks, and every two of its blocks are compared whole in a task of their own.

Equal vectors are one node with a weight.  Links leave a cell as counts and as
the edges of a spanning forest, so that a dense group's pairs are never rows.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import connected_components
from .runtime import materialize, narrow, table
from .vectors import matrix, usable

#: Rows that a cell should have; larger ones are cut again.
CELL = 8_192
#: Pivots of one cut: about so many rows chosen by hash, whatever the cell's size.
PIVOTS = 16
#: Links kept of near and of far candidates, and how much closer a kept neighbour must be to drop one.
NEAR, FAR, ALPHA = 20, 8, 1.2
#: Candidates of the pruning.
POOL = 64
BEAM = 24
#: Vectors of each cell that are audited.
AUDITED = 48
#: How far below the threshold the search still widens.
SLACK = 0.03


# cells


def _assign(least: float):
    """Rows of cells that are cut to rows of the cells they are cut into.

    Let x be at home with pivot p, y with q, and their distance at most r.  The
    border between p and q is a plane with x on the side of p and y on that of
    q, so y is no farther than r from it: |y-p|^2 - |y-q|^2 <= 2 r |p-q|.  So
    where y joins all cells for which that holds, x finds it at home.
    """
    reach = float(np.sqrt(2 - 2 * least)) + 1e-6

    def each(rows: pa.RecordBatch) -> pa.RecordBatch:
        dims = len(rows.column("vector")[0])
        vectors = matrix(rows.column("vector"), dims)
        vectors /= np.sqrt((vectors * vectors).sum(axis=1))[:, None]
        out_row, out_cell, out_home = [], [], []
        cells = rows.column("cell").to_pylist()
        pivots_of = rows.column("pivots")
        groups: dict[str, list[int]] = {}
        for i, c in enumerate(cells):
            groups.setdefault(c, []).append(i)
        for cell, members in groups.items():
            pivots = matrix(pivots_of.slice(members[0], 1).flatten(), dims)
            pivots /= np.sqrt((pivots * pivots).sum(axis=1))[:, None]
            apart = np.sqrt(np.maximum(2 - 2 * pivots @ pivots.T, 0))
            far = np.maximum(2 - 2 * vectors[members] @ pivots.T, 0)  # squares of distances
            nearest = far.argmin(axis=1)
            joins = far - far[np.arange(len(members)), nearest][:, None] <= 2 * reach * apart[nearest] + 1e-9
            for m, home, row in zip(members, nearest, joins):
                for p in np.nonzero(row)[0]:
                    out_row.append(m)
                    out_cell.append(f"{cell}.{p}")
                    out_home.append(bool(p == home))
        at = pa.array(out_row, pa.int64())
        home = [a and h for a, h in zip(rows.column("home").take(at).to_pylist(), out_home)]
        return pa.RecordBatch.from_arrays([rows.column("rid").take(at), rows.column("weight").take(at), rows.column("vector").take(at), pa.array(out_cell, pa.string()), pa.array(home, pa.bool_())], names=["rid", "weight", "vector", "cell", "home"])

    return lambda batches: (each(b) for b in batches if b.num_rows)


def _cells(nodes: DataFrame, size: int, least: float, rounds: int = 6) -> DataFrame:
    """``(rid, weight, vector, cell, home)`` in overlapping cells of about ``size`` rows.

    Every vector is at home in one cell.  A cell that a cut does not make
    smaller, because its vectors are all alike, stays as it is, and so does what
    is left after ``rounds``: ``_crowded`` takes both.
    """
    now = nodes.withColumn("home", F.lit(True))
    done: list[DataFrame] = []
    for k in range(rounds):
        counts = now.groupBy("cell").agg(F.count("*").alias("n"))
        large = materialize(counts.where(F.col("n") > size), f"groups-large-{k}")
        if large.isEmpty():
            break
        dice = F.pmod(F.xxhash64("rid", F.lit(k)), F.lit(1_000_000)) / 1_000_000
        wanted = F.least(F.lit(float(PIVOTS)), F.ceil(F.col("n") / size * 2).cast("double"))
        picked = now.where("home").join(large, "cell").where(dice < wanted * 1.5 / F.col("n"))
        pivots = picked.groupBy("cell").agg(F.collect_list("vector").alias("pivots")).where(F.size("pivots") > 1)
        pivots = materialize(pivots, f"groups-pivots-{k}")
        if pivots.isEmpty():
            break
        cut = now.join(pivots, "cell").select("rid", "weight", "vector", "cell", "home", "pivots")
        cut = materialize(cut.mapInArrow(_assign(least), cut.drop("pivots").schema), f"groups-cut-{k}")
        # A cut that copies most rows into most cells is taken back.
        kept = cut.select("*", F.regexp_replace("cell", r"\.\d+$", "").alias("parent"))
        useful = kept.groupBy("parent", "cell").agg(F.count("*").alias("n")).groupBy("parent").agg(F.max("n").alias("most"))
        useful = materialize(useful.join(large, useful["parent"] == large["cell"]).where(F.col("most") < F.col("n") * 0.9).select("parent"), f"groups-useful-{k}")
        done.append(now.join(useful, now["cell"] == useful["parent"], "left_anti"))
        now = kept.join(useful, "parent", "left_semi").drop("parent")
        if useful.isEmpty():
            break
    return _union([*done, now])


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# graphs


def _unit(rows: pa.Table) -> np.ndarray:
    vectors = matrix(rows.column("vector"), len(rows.column("vector")[0]))
    return vectors / np.sqrt((vectors * vectors).sum(axis=1))[:, None]


def _prune(own: np.ndarray, pool: np.ndarray, vectors: np.ndarray, keep: int) -> list[int]:
    """Of a pool sorted by distance, those not much closer to one already kept."""
    kept: list[int] = []
    others = vectors[pool]
    distance = 1 - others @ own
    alive = np.ones(len(pool), bool)
    while alive.any() and len(kept) < keep:
        i = int(alive.argmax())
        kept.append(int(pool[i]))
        alive &= ALPHA * ALPHA * (1 - others @ others[i]) > distance
        alive[i] = False
    return kept


def build_graph(vectors: np.ndarray, seed: int = 42) -> list[list[int]]:
    """Adjacency lists, in both directions, of unit vectors."""
    n = len(vectors)
    links: list[set[int]] = [set() for _ in range(n)]
    random = np.random.default_rng(seed)
    for start in range(0, n, 512):
        near = vectors[start : start + 512] @ vectors.T
        near[np.arange(len(near)), np.arange(start, start + len(near))] = -np.inf
        m = min(POOL, n - 1)
        pool = np.argpartition(-near, m - 1, axis=1)[:, :m] if 0 < m < n - 1 else np.argsort(-near, axis=1)[:, :m]
        for row, candidates in enumerate(pool):
            i = start + row
            candidates = candidates[np.argsort(-near[row, candidates], kind="stable")]
            far = random.integers(0, n, FAR * 2)
            far = far[far != i]
            far = far[np.argsort(-near[row, far], kind="stable")]
            for j in [*_prune(vectors[i], candidates, vectors, NEAR), *_prune(vectors[i], far, vectors, FAR)]:
                links[i].add(j)
                links[j].add(i)
    return [sorted(x) for x in links]


def _medoid(vectors: np.ndarray) -> int:
    return int((vectors @ vectors.mean(axis=0)).argmax())


def range_search(query: np.ndarray, vectors: np.ndarray, links: list[np.ndarray], entry: int, least: float, beam: int) -> np.ndarray:
    """Places of vectors whose cosine with the query is at least ``least``, found greedily from ``entry``.

    The best ``beam`` are followed until none is better; while any found lies
    within ``SLACK`` of the threshold, all its neighbours are looked at too.
    """
    seen = np.zeros(len(vectors), bool)
    seen[entry] = True
    first = float(vectors[entry] @ query)
    todo = [(-first, entry)]
    best = [first]
    hits = [entry] if first >= least else []
    while todo:
        score, node = heapq.heappop(todo)
        if -score < best[0] and len(best) >= beam and -score < least - SLACK:
            break
        near = links[node]
        near = near[~seen[near]]
        if not len(near):
            continue
        seen[near] = True
        scores = vectors[near] @ query
        floor = best[0] if len(best) >= beam else -2.0
        for s, j in zip(scores.tolist(), near.tolist()):
            if s >= least - 1e-9:
                hits.append(j)
            if s > floor or s >= least - SLACK:
                heapq.heappush(todo, (-s, j))
                if len(best) < beam:
                    heapq.heappush(best, s)
                elif s > best[0]:
                    heapq.heapreplace(best, s)
    return np.array(hits, dtype=np.int64)


def _build(rows: pa.Table) -> pa.Table:
    rid = np.asarray(rows.column("rid"))
    if len(rid) < 2:
        return pa.table({"rid": pa.array([], pa.int64()), "near": pa.array([], pa.list_(pa.int64()))})
    links = build_graph(_unit(rows))
    return pa.table({"rid": pa.array(rid), "near": pa.array([rid[x].tolist() for x in links], pa.list_(pa.int64()))})


def _search(least: float):
    def each(rows: pa.Table) -> pa.Table:
        rid, weight, home = (np.asarray(rows.column(c)) for c in ("rid", "weight", "home"))
        raw = matrix(rows.column("vector"), len(rows.column("vector")[0]))
        norms = np.sqrt((raw * raw).sum(axis=1))
        vectors = raw / norms[:, None]
        place = {int(r): i for i, r in enumerate(rid)}
        links = [np.array([place[j] for j in (x or ()) if j in place], dtype=np.int64) for x in rows.column("near").to_pylist()]
        entry, n = _medoid(vectors), len(rid)

        def exactly(i: int, found: np.ndarray) -> np.ndarray:
            cosine = (raw[found] * raw[i]).sum(axis=1) / (norms[found] * norms[i])
            return found[(cosine >= least) & (found != i)]

        beam = BEAM
        sample = np.argsort((rid * 2654435761) % 4294967291, kind="stable")[:AUDITED]
        while beam < n:  # audit, and widen until nothing in the sample is missed
            missed = 0
            for i in sample:
                found = exactly(i, range_search(vectors[i], vectors, links, entry, least, beam))
                missed += len(exactly(i, np.nonzero(vectors @ vectors[i] >= least - 1e-9)[0])) - len(found)
            if not missed:
                break
            beam *= 4
        count, forest = np.zeros(n, np.int64), _Forest(n)
        for i in np.nonzero(home)[0].tolist():
            found = range_search(vectors[i], vectors, links, entry, least, beam) if beam < n else np.nonzero(vectors @ vectors[i] >= least - 1e-9)[0]
            found = exactly(i, found)
            count[i] = weight[found].sum()
            for j in found.tolist():
                forest.join(i, j)
        roots = forest.roots()
        keep = home | (roots != np.arange(n))
        return pa.table({"rid": pa.array(rid[keep]), "home": pa.array(home[keep]), "links": pa.array(count[keep]), "root": pa.array(rid[roots][keep])})

    return each


class _Forest:
    """Disjoint sets of places, each named by its least."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def root(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def join(self, x: int, y: int) -> None:
        a, b = self.root(x), self.root(y)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def roots(self) -> np.ndarray:
        return np.array([self.root(i) for i in range(len(self.parent))], dtype=np.int64)


def _compare(least: float):
    """Links between the two blocks of a task, or within the one that it has."""

    def each(rows: pa.Table) -> pa.Table:
        rid, weight, home, block = (np.asarray(rows.column(c)) for c in ("rid", "weight", "home", "block"))
        raw = matrix(rows.column("vector"), len(rows.column("vector")[0]))
        norms = np.sqrt((raw * raw).sum(axis=1))
        vectors = raw / norms[:, None]
        first = np.nonzero(block == block.min())[0]
        second = np.nonzero(block == block.max())[0]
        one = len(first) == len(block)
        count, forest = np.zeros(len(rid), np.int64), _Forest(len(rid))
        for start in range(0, len(first), 512):
            some = first[start : start + 512]
            near = vectors[some] @ vectors[second].T >= least - 1e-9
            for i, hits in zip(some.tolist(), near):
                found = second[hits]
                cosine = (raw[found] * raw[i]).sum(axis=1) / (norms[found] * norms[i])
                found = found[(cosine >= least) & (found != i)]
                if home[i]:
                    count[i] += weight[found].sum()
                if not one:
                    count[found[home[found]]] += weight[i]
                for j in found.tolist():
                    if home[i] or home[j]:
                        forest.join(i, j)
        roots = forest.roots()
        keep = home | (roots != np.arange(len(rid)))
        return pa.table({"rid": pa.array(rid[keep]), "home": pa.array(home[keep]), "links": pa.array(count[keep]), "root": pa.array(rid[roots][keep])})

    return each


def _crowded(cells: DataFrame, size: int, least: float) -> DataFrame:
    """``rid, home, links, root`` of cells of more than twice ``size`` rows, by tasks of two blocks of about ``size`` each."""
    n = cells.groupBy("cell").agg(F.ceil(F.count("*") / size).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("rid", F.lit(3)), F.col("blocks")).cast("int")
    dealt = cells.join(n, "cell").withColumn("block", own).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    dealt = dealt.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})
    return dealt.groupBy("cell", "low", "high").applyInArrow(_compare(least), "rid long, home boolean, links long, root long")


def vector_groups(df: DataFrame, least: float = 0.98, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", cell: int = CELL) -> DataFrame:
    """One row per row of ``df``: ``vec_id, n_links, component_id, kept``.

    Vectors link if their labels are equal and not null and their cosine is at
    least ``least``.  Vectors that are null, zero or hold null or non-finite
    components link with nothing, nor do vectors of different lengths.
    ``component_id`` is the smallest id reachable; rows without an id are kept
    but name no component.  Repeated rows are separate vectors that link with
    each other.  An empty table gives an empty one.
    """
    rows = materialize(narrow(df, vec_id=vec_id, vector=vector, label=label).withColumn("usable", usable("vector") & F.col("label").isNotNull()), "groups-rows")
    alone = rows.where("NOT usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    grouped = rows.where("usable").groupBy("label", "vector").agg(F.count("*").alias("weight"), F.min("vec_id").alias("least"))
    nodes = materialize(grouped.withColumn("rid", F.monotonically_increasing_id()), "groups-nodes")
    start = F.concat(F.col("label").cast("string"), F.lit("/"), F.size("vector").cast("string"))
    cells = materialize(_cells(nodes.select("rid", "weight", "vector", start.alias("cell")), cell, least), "groups-cells")
    large = materialize(cells.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > 2 * cell).select("cell"), "groups-crowded")
    every, cells = cells, cells.join(large, "cell", "left_anti")

    lists = cells.groupBy("cell").applyInArrow(_build, "rid long, near array<long>")
    lists = lists.groupBy("rid").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))  # from all its cells
    found = cells.join(lists, "rid", "left").groupBy("cell").applyInArrow(_search(least), "rid long, home boolean, links long, root long")
    if not large.isEmpty():
        found = found.unionByName(_crowded(every.join(large, "cell", "left_semi"), cell, least))
    found = materialize(found, "groups-found")

    roots = connected_components(found.select(F.col("rid").alias("a"), F.col("root").alias("b")), label="groups-components")
    linked = nodes.join(roots, nodes["rid"] == roots["node"], "left").select("rid", "label", "vector", "weight", "least", F.coalesce("root", "rid").alias("root"))
    named = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    counts = found.where("home").groupBy("rid").agg(F.sum("links").alias("links"))
    node = linked.join(named, "root").join(counts, "rid", "left").select("label", "vector", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id")
    back = rows.where("usable").join(node, ["label", "vector"]).select("vec_id", "n_links", "component_id")
    return back.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def audit_recall(df: DataFrame, groups: DataFrame, least: float = 0.98, every: int = 100, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> float:
    """Share of the links of the vectors whose id is divisible by ``every`` that ``groups`` has counted.

    Brute force of the sample against all rows, in Spark.
    """
    rows = narrow(df, vec_id=vec_id, vector=vector, label=label).where(usable("vector") & F.col("label").isNotNull())
    dot = F.aggregate(F.zip_with("v", "w", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda c: F.sqrt(F.aggregate(F.transform(c, lambda a: a.cast("double") * a.cast("double")), F.lit(0.0), lambda s, x: s + x))
    asked = rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("asked"), "label", F.col("vector").alias("v"))
    pairs = asked.join(rows.withColumnRenamed("vector", "w"), "label").where("asked <> vec_id").where(F.size("v") == F.size("w"))
    true = pairs.where(dot / (norm("v") * norm("w")) >= least).groupBy("asked").agg(F.count("*").alias("links"))
    row = true.join(groups, F.col("asked") == F.col("vec_id")).agg(F.sum(F.least("links", "n_links")).alias("found"), F.sum("links").alias("all")).first()
    return 1.0 if not row["all"] else row["found"] / row["all"]


def op9_vector_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of cosine 0.98 or more among embeddings of one label, and their groups."""
    return vector_groups(table(spark, sf_dir, "embeddings"))
