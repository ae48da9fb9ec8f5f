"""Vectors: an epsilon grid order join for near-duplicates and a hierarchical k-means tree for nearest neighbours."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.llm.components import components
from marlstone.runtime import batch_rows, store, table

COSINE = 0.93
#: Numbers (rows times dimensions) of the bounded sample on which axes and trees are fitted.
SAMPLE_NUMBERS = 2_000_000
GRID_AXES = 8
#: Numbers (rows times dimensions) of an interval of the grid order, and interval pairs that one task compares.
INTERVAL_NUMBERS = 524_288
TASK_PAIRS = 4
#: Leading axes by whose cells intervals meet.
MEET_AXES = 2
LEAF = 256


def usable(embedding: Column) -> Column:
    """Neither null nor zero, and every component there and finite."""
    fine = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(fine & F.exists(embedding, lambda x: x != 0), F.lit(False))


def _stack(column) -> np.ndarray:
    """A column of equally long lists as a matrix of doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 0))


def sample(vectors: DataFrame, numbers: int = SAMPLE_NUMBERS) -> dict[int, np.ndarray]:
    """By dimension, about `numbers` components' worth of vectors (vec_id, embedding), chosen by a hash of the id."""
    sizes = {r.d: r["count"] for r in vectors.groupBy(F.size("embedding").alias("d")).count().collect()}
    out = {}
    for d, n in sorted(sizes.items()):
        share = min(1.0, numbers / d / n)
        draw = F.xxhash64(F.lit("axes"), "vec_id", "embedding") / F.lit(2.0**64) + F.lit(0.5)
        got = vectors.where((F.size("embedding") == d) & (draw <= share)).select("vec_id", "embedding").toArrow().sort_by("vec_id")
        out[d] = _stack(got.column("embedding"))
    return out


def axes(points: np.ndarray, d: int) -> np.ndarray:
    """The principal axes as columns, the leading one first. Any rotation keeps the join exact; this one sorts best."""
    if not len(points):
        return np.eye(d)
    unit = points / np.linalg.norm(points, axis=1, keepdims=True)
    values, vectors = np.linalg.eigh(np.cov(unit.T).reshape(d, d) if len(unit) > 1 else np.eye(d))
    return vectors[:, np.argsort(-values, kind="stable")]


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest label reachable by the links a-b."""
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        np.minimum.at(label, before[a], low)
        np.minimum.at(label, before[b], low)
        label = label[label]
        if (label == before).all():
            return label
    return label


def ego_join(x: np.ndarray, y: np.ndarray, box_x: np.ndarray, box_y: np.ndarray, cosine: float, same: bool, leaf: int = LEAF) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j) with a cosine of at least `cosine` between rows of two intervals of the grid order.

    x and y are unit vectors, box_x and box_y the same on the principal axes. Two intervals are skipped where their
    boxes are farther apart than such vectors can be; else each is halved, down to `leaf` rows that are compared outright.
    With `same`, only i < j.
    """
    eps2 = 2 - 2 * cosine + 1e-9
    boxes: dict[tuple[int, int, int], tuple[np.ndarray, np.ndarray]] = {}

    def box(side: int, lo: int, hi: int):
        key = (side, lo, hi)
        if key not in boxes:
            rows = (box_x, box_y)[side][lo:hi]
            boxes[key] = (rows.min(axis=0), rows.max(axis=0))
        return boxes[key]

    todo = [(0, len(x), 0, len(y))]
    while todo:
        a, b, c, d = todo.pop()
        if a >= b or c >= d or same and a >= d:
            continue
        (lo1, hi1), (lo2, hi2) = box(0, a, b), box(1, c, d)
        gap = np.maximum(0, np.maximum(lo1 - hi2, lo2 - hi1))
        if gap @ gap > eps2:
            continue
        if b - a > leaf or d - c > leaf:
            m, n = ((a + b) // 2 if b - a > leaf else b), ((c + d) // 2 if d - c > leaf else d)
            todo += [(p, q, r, s) for p, q in ((a, m), (m, b)) for r, s in ((c, n), (n, d)) if p < q and r < s]
            continue
        dots = x[a:b] @ y[c:d].T
        i, j = np.nonzero(dots >= cosine - 1e-9)
        i, j = i + a, j + c
        if same:
            i, j = i[i < j], j[i < j]
        if len(i):
            yield i, j


def _cells(low: str, high: str, reach: float, eps: float) -> Column:
    """The cells of the MEET_AXES leading axes that a box, widened by `reach`, lies in."""
    along = [F.sequence(F.floor((F.col(low)[a] - reach) / eps), F.floor((F.col(high)[a] + reach) / eps)) for a in range(MEET_AXES)]
    return F.flatten(F.transform(along[0], lambda i: F.transform(along[1], lambda j: F.struct(i.alias("i"), j.alias("j")))))


def similar(vectors: DataFrame, cosine: float = COSINE, interval_numbers: int = INTERVAL_NUMBERS, leaf: int = LEAF) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of `vectors` (vec_id, embedding, label).

    Rows of one label, which is not null, and one dimension are linked where the cosine in double precision is at least
    `cosine`. Unusable vectors, rows without label and rows without vec_id link with nothing: n_links 0, their own
    component. Equal vectors are one class, whose links count once for each copy; repeated rows are copies, and rows that
    repeat an id share its component. An empty table gives no rows. Other columns are not read.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("embedding"), "label")
    fit = rows.where(usable(F.col("embedding")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    classes = store(fit.groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")).withColumn("cid", F.monotonically_increasing_id()), "ego-classes")  # numbered once and written
    rotations = spark.sparkContext.broadcast({d: axes(p, d) for d, p in sample(classes.df.withColumnRenamed("rep", "vec_id")).items()})
    eps = float(np.sqrt(2 - 2 * cosine))

    def cells(batches):
        for batch in batches:
            grid = []
            for v in batch.column(1):
                x = np.array(v.as_py())
                y = (x / np.linalg.norm(x)) @ rotations.value[len(x)][:, :GRID_AXES]
                grid.append(np.floor(y / eps).astype(int).tolist() + [0] * (GRID_AXES - len(y)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(grid, pa.list_(pa.int32()))], names=["cid", "embedding", "label", "copies", "cells"])

    placed = classes.df.select("cid", "embedding", F.col("label").cast("string").alias("label"), "copies").mapInArrow(cells, "cid long, embedding array<double>, label string, copies long, cells array<int>")
    widest = classes.df.agg(F.max(F.size("embedding")).alias("d"), F.count("*").alias("n")).first()
    interval = max(leaf, interval_numbers // max(1, widest.d or 1))
    parts = max(1, -(-widest.n // interval))
    ordered = placed.withColumn("d", F.size("embedding")).repartitionByRange(parts, "label", "d", "cells", "cid").sortWithinPartitions("label", "d", "cells", "cid")

    def intervals(batches):
        """Runs of the order, of one label and dimension, with their boxes on the grid's axes."""
        from pyspark import TaskContext

        number, keep = TaskContext.get().partitionId() << 24, []

        def flush(keep):
            for at in range(0, len(keep), interval):
                own = keep[at : at + interval]
                x = np.array([v for _, v, _, _ in own])
                y = x / np.linalg.norm(x, axis=1, keepdims=True) @ rotations.value[x.shape[1]][:, :GRID_AXES]
                y = np.pad(y, ((0, 0), (0, GRID_AXES - y.shape[1])))
                yield own[0][2], x.shape[1], y.min(axis=0).tolist(), y.max(axis=0).tolist(), [c for c, *_ in own], [n for *_, n in own], x.tobytes()

        def out(found, first):
            cols = list(zip(*found))
            return pa.RecordBatch.from_arrays(
                [pa.array(range(first, first + len(found)), pa.int64()), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.list_(pa.float64())) for c in cols[2:4]), *(pa.array(c, pa.list_(pa.int64())) for c in cols[4:6]), pa.array(cols[6], pa.binary())],
                names=["no", "label", "d", "low", "high", "cids", "copies", "points"],
            )

        for batch in batches:
            for cid, v, lab, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if keep and (keep[0][2] != lab or len(keep[0][1]) != len(v) or len(keep) >= interval):
                    found = list(flush(keep))
                    yield out(found, number)
                    number, keep = number + len(found), []
                keep.append((cid, v, lab, n))
        if keep:
            yield out(list(flush(keep)), number)

    runs = store(ordered.select("cid", "embedding", "label", "copies").mapInArrow(intervals, "no long, label string, d int, low array<double>, high array<double>, cids array<long>, copies array<long>, points binary"), "ego-runs")
    box = runs.df.select("no", "label", "d", "low", "high")
    other = box.select(F.col("no").alias("no2"), F.col("label").alias("label2"), F.col("d").alias("d2"), F.col("low").alias("low2"), F.col("high").alias("high2"))
    gaps = F.zip_with(F.zip_with("low", "high2", lambda a, b: a - b), F.zip_with("low2", "high", lambda a, b: a - b), lambda a, b: F.greatest(a, b, F.lit(0.0)))
    near = F.aggregate(gaps, F.lit(0.0), lambda s, g: s + g * g) <= eps * eps + 1e-9
    # Intervals meet in the cells of the leading axes: those of one, and those within eps of the other.
    here = box.withColumn("cell", F.explode(_cells("low", "high", 0.0, eps)))
    there = other.withColumn("cell2", F.explode(_cells("low2", "high2", eps * (1 + 1e-6), eps)))
    met = here.join(there, (F.col("label") == F.col("label2")) & (F.col("d") == F.col("d2")) & (F.col("cell") == F.col("cell2")) & (F.col("no") <= F.col("no2")))
    pairs = store(met.where(near).select("no", "no2", "d").distinct(), "ego-pairs")
    tasks = max(8, -(-pairs.df.count() // TASK_PAIRS))
    side = lambda n, s: runs.df.select(F.col("no").alias(n), F.col("cids").alias(f"cids{s}"), F.col("copies").alias(f"copies{s}"), F.col("points").alias(f"points{s}"))
    work = pairs.df.repartition(tasks, "no", "no2").join(side("no", "1"), "no").join(side("no2", "2"), "no2").select("no", "no2", "d", "cids1", "copies1", "points1", "cids2", "copies2", "points2")

    def join(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                one, two, d = (batch.column(c)[k].as_py() for c in range(3))
                same = one == two
                x = np.frombuffer(batch.column(5)[k].as_py(), np.float64).reshape(-1, d)
                y = x if same else np.frombuffer(batch.column(8)[k].as_py(), np.float64).reshape(-1, d)
                ids = np.array(batch.column(3)[k].as_py() + ([] if same else batch.column(6)[k].as_py()), np.int64)
                copies = np.array(batch.column(4)[k].as_py() + ([] if same else batch.column(7)[k].as_py()), np.int64)
                ux, uy = x / np.linalg.norm(x, axis=1, keepdims=True), y / np.linalg.norm(y, axis=1, keepdims=True)
                turn = rotations.value[d]
                shift = 0 if same else len(x)
                links, label = np.zeros(len(ids), np.int64), np.arange(len(ids))
                for i, j in ego_join(ux, uy, ux @ turn, uy @ turn, cosine, same, leaf):
                    # the exact test, on the vectors as they are
                    real = np.einsum("ij,ij->i", x[i], y[j]) / (np.sqrt(np.einsum("ij,ij->i", x[i], x[i])) * np.sqrt(np.einsum("ij,ij->i", y[j], y[j]))) >= cosine
                    i, j = i[real], j[real] + shift
                    links += np.bincount(i, copies[j], len(ids)).astype(np.int64) + np.bincount(j, copies[i], len(ids)).astype(np.int64)
                    label = _merge(label, i, j)
                on = np.flatnonzero(links)
                yield pa.RecordBatch.from_arrays([pa.array(ids[on]), pa.array(links[on]), pa.array(ids[label[on]])], names=["cid", "links", "root"])

    with batch_rows(spark, 4):
        found = store(work.mapInArrow(join, "cid long, links long, root long"), "ego-links")
    runs.drop()
    pairs.drop()
    reps = classes.df.select(F.col("cid"), "rep", "copies")
    totals = found.df.groupBy("cid").agg(F.sum("links").alias("links"))
    roots = components(found.df.select(F.col("cid").alias("a"), F.col("root").alias("b")), "ego-components").df
    whole = reps.join(totals, "cid", "left").join(roots.withColumnRenamed("node", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    # the components above are named by class; the least vec_id of their classes is the name to give
    names = whole.groupBy("component").agg(F.min("rep").alias("component_id"))
    per_class = whole.join(names, "component").select(
        F.col("cid"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"), "component_id"
    )
    named = classes.df.select(F.col("label").alias("c_label"), F.col("embedding").alias("c_embedding"), "cid").join(per_class, "cid")
    member = rows.join(named, (F.col("label") == F.col("c_label")) & (F.col("embedding") == F.col("c_embedding")) & F.col("vec_id").isNotNull(), "left")
    component = F.coalesce("component_id", "vec_id")
    return member.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))


# ---- nearest neighbours -------------------------------------------------------------------------------------------

NEIGHBOURS = 10
BRANCHING = 16
LEAF_ROWS = 256
#: Numbers of the bounded sample that the tree is grown on, and sampled rows a leaf at least: they bound the tree.
TREE_NUMBERS, LEAF_SAMPLE = 8_000_000, 8
RECALL = 0.97
CALIBRATION = 128
BUCKET_ROWS = 32_768
QUERY_CHUNK = 4096


@dataclass
class Tree:
    """Centres of all nodes; a node has children or is a leaf with a number."""

    centres: np.ndarray
    children: list[list[int]] = field(default_factory=list)
    leaf: list[int] = field(default_factory=list)
    leaves: int = 0

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row: down the nearest child at every level."""
        out = np.empty(len(x), np.int32)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if not len(rows):
                continue
            own = self.children[node]
            if not own:
                out[rows] = self.leaf[node]
                continue
            near = np.argmin(_distances(x[rows], self.centres[own]), axis=1)
            todo += [(own[k], rows[near == k]) for k in range(len(own))]
        return out

    def best_bins(self, q: np.ndarray) -> Iterator[int]:
        """All leaves, each taken from a priority queue of nodes by the distance of their centres."""
        queue = [(0.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            own = self.children[node]
            if not own:
                yield self.leaf[node]
                continue
            for gap, child in zip(_distances(q[None], self.centres[own])[0].tolist(), own):
                heapq.heappush(queue, (gap, child))


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances, by products: near enough to choose by."""
    return np.maximum(0, (x * x).sum(axis=1)[:, None] - 2 * x @ y.T + (y * y).sum(axis=1))


def grow(points: np.ndarray, leaves: int, branching: int = BRANCHING, rounds: int = 8) -> Tree:
    """A k-means tree over the sample with about `leaves` leaves of equal weight."""
    centres, children, leaf, number = [points.mean(axis=0)], [[]], [-1], 0
    stop = max(1, len(points) // max(1, leaves))
    todo = [(0, np.arange(len(points)))]
    while todo:
        node, rows = todo.pop(0)
        x = points[rows]
        k = min(branching, -(-len(rows) // stop), len(np.unique(x, axis=0)) if len(rows) > stop else 1)
        if len(rows) <= stop or k < 2:
            leaf[node] = number
            number += 1
            continue
        mid = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
        for _ in range(rounds):
            near = np.argmin(_distances(x, mid), axis=1)
            for j in range(k):
                if (near == j).any():
                    mid[j] = x[near == j].mean(axis=0)
        near = np.argmin(_distances(x, mid), axis=1)
        if (near == near[0]).all():
            leaf[node] = number
            number += 1
            continue
        for j in range(k):
            if (near == j).any():
                centres.append(mid[j])
                children.append([])
                leaf.append(-1)
                children[node].append(len(centres) - 1)
                todo.append((len(centres) - 1, rows[near == j]))
    return Tree(np.array(centres), children, leaf, number)


def _top(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int, allowed=None) -> Iterator[tuple[int, int, float]]:
    """(query, vec_id, distance) of each query's k nearest rows, ties to the smaller id; distances are exact."""
    for a in range(0, len(q), 256):
        near = _distances(q[a : a + 256], x)
        near[q_ids[a : a + 256, None] == ids[None, :]] = np.inf
        if allowed is not None:
            near[~allowed[a : a + 256]] = np.inf
        for r in range(len(near)):
            row = near[r]
            some = np.flatnonzero(np.isfinite(row))
            if len(some) > k:
                limit = np.partition(row[some], k - 1)[k - 1]
                scale = float(q[a + r] @ q[a + r]) + float(limit)
                some = some[row[some] <= limit + 1e-9 * scale]
            exact = np.sqrt(((x[some] - q[a + r]) ** 2).sum(axis=1))
            for at in np.lexsort((ids[some], exact))[:k]:
                yield int(q_ids[a + r]), int(ids[some[at]]), float(exact[at])


def _found(rows) -> pa.RecordBatch:
    rows = list(rows)
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.float64())], names=["query_id", "vec_id", "score"])


def _best(partial: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return partial.withColumn("rank", rank).where(F.col("rank") <= k)


def brute_force(vectors: DataFrame, queries: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """The true neighbours of a bounded set of queries, which go to every task."""
    got = queries.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).toArrow().sort_by("vec_id")
    shared = vectors.sparkSession.sparkContext.broadcast((_stack(got.column("embedding")), got.column("vec_id").to_numpy()))

    def run(batches):
        q, q_ids = shared.value
        for batch in batches:
            if batch.num_rows and len(q):
                yield _found(_top(q, q_ids, _stack(batch.column(1)), batch.column(0).to_numpy(), k))

    return _best(vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(run, "query_id long, vec_id long, score double"), k)


def nearest(
    vectors: DataFrame, is_query: Column, k: int = NEIGHBOURS, recall: float = RECALL, leaf_rows: int = LEAF_ROWS, bucket_rows: int = BUCKET_ROWS, query_chunk: int = QUERY_CHUNK
) -> DataFrame:
    """query_id, rank (from 1), vec_id and score (Euclidean distance in double precision) of the k nearest rows found.

    The tree is grown on a bounded sample and holds every row. A query takes leaves from a priority queue, best first;
    how many is widened until CALIBRATION rows of the table, with neighbours known by brute force, reach `recall`, and
    each query goes on until the leaves taken hold k rows that are not its own, if there are so many.
    Vectors that are unusable or without vec_id take no part. Only vectors of one dimension have a distance, so each
    dimension is a table of its own. Rows that repeat the query's id are its own. Ties go to the smaller vec_id. Fewer
    rows than k give all; an empty table gives none. Other columns are not read.
    """
    spark = vectors.sparkSession
    rows = vectors.withColumn("is_query", F.coalesce(is_query, F.lit(False))).select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("embedding"), "is_query")
    rows = rows.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull())
    out = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for dims in rows.groupBy(F.size("embedding").alias("d")).count().orderBy("d").collect():
        out = out.unionByName(_nearest(rows.where(F.size("embedding") == dims.d), dims.d, dims["count"], k, recall, leaf_rows, bucket_rows, query_chunk))
    return out


def _nearest(rows: DataFrame, d: int, total: int, k: int, recall: float, leaf_rows: int, bucket_rows: int, query_chunk: int) -> DataFrame:
    """`nearest` for rows (vec_id, embedding, is_query) of one dimension."""
    spark = rows.sparkSession
    points = sample(rows, TREE_NUMBERS)[d]
    tree = grow(points, max(1, min(total // leaf_rows, len(points) // LEAF_SAMPLE)))
    shared = spark.sparkContext.broadcast(tree)

    def place(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shared.value.assign(_stack(batch.column(1))) if batch.num_rows else [], pa.int32())], names=["vec_id", "embedding", "is_query", "leaf"])

    index = store(rows.mapInArrow(place, "vec_id long, embedding array<double>, is_query boolean, leaf int"), "tree-rows").df
    share = CALIBRATION / max(1, total)
    draw = F.xxhash64(F.lit("calibration"), "vec_id") / F.lit(2.0**64) + F.lit(0.5)
    trial = index.where(draw <= share)
    true = brute_force(index, trial, k).join(index.select("vec_id", "leaf"), "vec_id").select("query_id", "vec_id", "leaf").toPandas()
    tried = {r.vec_id: np.array(r.embedding) for r in trial.collect()}
    place_of = {q: {leaf: n for n, leaf in enumerate(tree.best_bins(v))} for q, v in tried.items()}
    needed = sorted(place_of[q][leaf] + 1 for q, leaf in zip(true.query_id, true.leaf))
    visits = needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))] if needed else tree.leaves
    # a bucket is a run of leaves, so neighbours in the tree, of bounded size
    sizes = {r.leaf: r["count"] for r in index.groupBy("leaf").count().collect()}
    bucket_of, bucket, held = np.zeros(tree.leaves, np.int32), 0, 0
    for leaf in range(tree.leaves):
        if held and held + sizes.get(leaf, 0) > bucket_rows:
            bucket, held = bucket + 1, 0
        bucket_of[leaf] = bucket
        held += sizes.get(leaf, 0)
    homes = spark.sparkContext.broadcast((bucket_of, [sizes.get(leaf, 0) for leaf in range(tree.leaves)]))

    def ask(batches):
        for batch in batches:
            out = []
            home, rows_in = homes.value
            for q, v, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                by: dict[int, list[int]] = {}
                held = 0
                for n, leaf in enumerate(shared.value.best_bins(np.array(v))):
                    if n >= visits and held >= k + own:
                        break
                    by.setdefault(int(home[leaf]), []).append(leaf)
                    held += rows_in[leaf]
                out += [(b, q, v, leaves) for b, leaves in by.items()]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.int32())))], names=["bucket", "query_id", "q", "leaves"])

    # rows that bear an id, where there are several
    copies = index.groupBy("vec_id").agg(F.count("*").alias("own"), F.max("is_query").alias("any_query")).where("own > 1 and any_query").select(F.col("vec_id").alias("own_id"), "own")
    asking = index.where("is_query").join(copies, F.col("vec_id") == F.col("own_id"), "left").select("vec_id", "embedding", F.coalesce("own", F.lit(1)).alias("own"))
    queries = store(asking.mapInArrow(ask, "bucket int, query_id long, q array<double>, leaves array<int>"), "tree-queries").df
    # A bucket with too many rows is cut into pieces, one with too many visits into chunks, and only there is anything
    # dealt twice. There are no more buckets than leaves, so this table is bounded by the tree.
    visits_of = {r.bucket: r["count"] for r in queries.groupBy("bucket").count().collect()}
    rows_of = np.bincount(bucket_of, [sizes.get(leaf, 0) for leaf in range(tree.leaves)], tree.leaves)
    plan = {b: (b, max(1, -(-n // query_chunk)), max(1, -(-int(rows_of[b]) // bucket_rows))) for b, n in visits_of.items()}
    of_leaf = F.broadcast(spark.createDataFrame([(leaf, *plan[b]) for leaf, b in enumerate(bucket_of.tolist()) if b in plan], "p_leaf int, bucket int, chunks int, pieces int"))
    of_bucket = F.broadcast(spark.createDataFrame(list(plan.values()), "p_bucket int, chunks int, pieces int"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    queries = queries.join(of_bucket, F.col("bucket") == F.col("p_bucket"))
    queries = queries.select("bucket", "query_id", "q", "leaves", dealt("query_id", "chunks").alias("chunk"), every("pieces").alias("piece"))
    held_rows = index.join(of_leaf, F.col("leaf") == F.col("p_leaf")).select("bucket", "vec_id", "embedding", "leaf", dealt("vec_id", "pieces").alias("piece"), every("chunks").alias("chunk"))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.Table.from_batches([_found([])])
        leaves = left.column("leaf").to_numpy()
        asked_leaves = right.column("leaves").to_pylist()
        seen = np.zeros((len(asked_leaves), int(leaves.max()) + 1), dtype=bool)
        for i, own in enumerate(asked_leaves):
            own = np.array(own)
            seen[i, own[own < seen.shape[1]]] = True
        return pa.Table.from_batches([_found(_top(_stack(right.column("q")), right.column("query_id").to_numpy(), _stack(left.column("embedding")), left.column("vec_id").to_numpy(), k, seen[:, leaves]))])

    keys = ("bucket", "piece", "chunk")
    partial = held_rows.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInArrow(search, "query_id long, vec_id long, score double")
    return _best(partial, k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of `embeddings`; unusable vectors and null labels link with nothing, an empty table gives no rows."""
    return similar(table(spark, sf_dir, "embeddings"))


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries are the rows of `embeddings` whose vec_id is divisible by 100, candidates all rows; unusable vectors take no part, an empty table gives no rows."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
