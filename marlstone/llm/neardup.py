"""Near-duplicate documents by tensored MinHash banding.

A document's word shingles give two small collections of half keys, each a few minhashes. A table's key is a pair, one
half from either collection, so 12 + 12 halves of 2 minhashes make 144 tables of 4 with 48 minhashes, not 576. Pairs
that share a key are candidates, and full shingle sets decide.

Equal sets are one class from the start, so copies cost nothing later. Of the classes that share a key, all are first
compared with one leader, and what links becomes one component. Rounds with new leaders go on, each in proportion to what
is left, while they settle half of it. Classes that then still share a key with another component are mostly alike only in
a line that very many texts have. They meet anew, under single shingles: with all shingles in one order, rare ones first,
two linked sets share one among the first fifth of each (and one more). Up to 64 classes under a shingle are paired, more
are compared in blocks of 64 sets, a pair of blocks at a time. Every pair that shares a key is so compared, found too
unlike, or in one component already: no cap drops any, and no more than 63 pairs of a class and shingle are ever rows.

Shingles are 64-bit hashes, and equal sets are told by their number and 128 bits: two different shingles of one pair of
documents are taken for one with a chance of (shingles of both)^2 / 2^65, under 1e-8 for documents of 100,000 words.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm._words import fingerprints, flat_sets, groups, least_of, mix64, numbers, ranges, word_hashes
from marlstone.llm.components import components
from marlstone.runtime import Stored, batch_rows, released, spread, store, table, text_batches

SHINGLE = 4
HALVES = 12
ROWS = 2
PERCENT = 80
#: Leader rounds end when one settles less than this share of the rows that are left.
SETTLED = 0.5
BLOCK = 64
#: Classes under one shingle that are paired one by one.
PAIRED = 64
#: Sets, by expectation, that the order of shingles is taken from, and its counters. Any order finds all links.
ORDER_SETS, COUNTERS = 1 << 14, 1 << 16


def miss(similarity: float, halves: int = HALVES, rows: int = ROWS) -> float:
    """The chance that a pair of this Jaccard similarity shares no key: that either collection has no equal half."""
    side = (1 - similarity**rows) ** halves
    return 1 - (1 - side) ** 2


def band_keys(sets: np.ndarray, first: np.ndarray, count: int, each: int) -> pa.Array:
    """For every set sets[first[i]:first[i+1]] its `count` keys of `each` minhashes, or null where it is empty."""
    n = count * each
    multiply, add = numbers(31, n), numbers(32, n)
    full = np.diff(first) > 0
    starts = np.append(first[:-1][full], len(sets))
    out = np.empty((int(full.sum()), count), np.int64)
    for band in range(count):
        half = np.zeros(len(out), np.uint64)
        for row in range(each):
            i = band * each + row
            half += mix64(least_of(sets * multiply[i] + add[i], starts) + numbers(34, each)[row])
        out[:, band] = mix64(half ^ numbers(33, count)[band]).astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum(full * count)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(out.ravel()), mask=pa.array(~full))


def signatures(docs: DataFrame, k: int = SHINGLE, halves: int = HALVES, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, set_a, set_b (a fingerprint of the set) and its 2 x halves half keys of `rows` minhashes. An
    empty set has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, to, data, offsets in groups(batch.column(1)):
                own, first = flat_sets(*word_hashes(data, offsets), k)
                a, b = fingerprints(own, first)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, to - row), pa.array(np.diff(first)), pa.array(a), pa.array(b), band_keys(own, first, 2 * halves, rows)],
                    names=["doc_id", "n_shingles", "set_a", "set_b", "halves"],
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(released(run), "doc_id long, n_shingles long, set_a long, set_b long, halves array<long>")


def sets_of(texts: DataFrame, k: int) -> DataFrame:
    """(rep, own) of `texts` (rep, text, set_a): the set of each as sorted 64-bit shingles. Where ids repeat, a text whose
    set is not the one that set_a marks is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, to, data, offsets in groups(batch.column(1)):
                own, first = flat_sets(*word_hashes(data, offsets), k)
                right = np.flatnonzero(fingerprints(own, first)[0] == batch.column(2).slice(row, to - row).to_numpy())
                yield set_rows(batch.column(0).slice(row, to - row).take(pa.array(right)), own, first, right)

    return texts.select("rep", "text", "set_a").mapInArrow(released(run), "rep long, own binary")


def set_rows(reps: pa.Array, own: np.ndarray, first: np.ndarray, which: np.ndarray) -> pa.RecordBatch:
    """Rows (rep, own) of the sets numbered `which` in own[first[i]:first[i+1]]."""
    return pa.RecordBatch.from_arrays([reps, pa.array([own[first[i] : first[i + 1]].tobytes() for i in which], pa.binary())], names=["rep", "own"])


def _flat_binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The sets of a column one after the other, and the size of each."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1] // 8
    return np.frombuffer(column.buffers()[2], np.uint64)[ends[0] : ends[-1]] if len(column) else np.zeros(0, np.uint64), np.diff(ends)


def verify(pairs: DataFrame, own: DataFrame, percent: int) -> DataFrame:
    """Of `pairs` (a, b, la, lb) the labels (la, lb) of the linked ones as (a, b). `own` holds (rep, own) of every class."""
    side = lambda x: own.select(F.col("rep").alias(x), F.col("own").alias(f"own_{x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (a, size_a), (b, size_b) = _flat_binary(batch.column(0)), _flat_binary(batch.column(1))
            # A shingle is told by its pair too, so one test for all pairs says which they share.
            mark = mix64(np.arange(1, batch.num_rows + 1, dtype=np.uint64))
            pair = np.repeat(np.arange(batch.num_rows), size_a)
            shared = np.isin(mix64(a ^ mark[pair]), mix64(b ^ np.repeat(mark, size_b)))
            both = np.bincount(pair[shared], minlength=batch.num_rows)
            found = pa.array(np.flatnonzero(100 * both >= percent * (size_a + size_b - both)))
            yield pa.RecordBatch.from_arrays([batch.column(2).take(found), batch.column(3).take(found)], names=["a", "b"])

    joined = pairs.join(side("b"), "b").join(side("a"), "a").select("own_a", "own_b", "la", "lb")
    return joined.mapInArrow(released(run), "a long, b long")


def relabelled(members: DataFrame, changes: list[Stored], name: str = "label") -> DataFrame:
    """`members` with the labels in column `name` taken through the changes (node, component), one after the other."""
    columns = members.columns
    for change in changes:
        new = change.df.select(F.col("node").alias("c_node"), F.col("component").alias("c_component"))
        members = members.join(new, F.col(name) == F.col("c_node"), "left").select(*[F.coalesce("c_component", c).alias(c) if c == name else c for c in columns])
    return members


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (rep, label) with their partition and their place in it."""
    from pyspark import TaskContext

    part, at = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part)), pa.array(np.arange(at, at + n)), batch.column(0), batch.column(1)], names=["part", "at", "rep", "label"])
        at += n


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, rep, label, own), sorted by block, to a row a block."""
    block, keep = None, []

    def out():
        return pa.RecordBatch.from_arrays(
            [pa.array([block]), *(pa.array([[x[i] for x in keep]], pa.list_(pa.int64())) for i in (1, 2)), pa.array([[x[3] for x in keep]], pa.list_(pa.binary()))],
            names=["block", "reps", "labels", "sets"],
        )

    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if keep and row[0] != block:
                yield out()
                keep = []
            block = row[0]
            keep.append(row)
    if keep:
        yield out()


def _rows_over(part: np.ndarray, own: list[np.ndarray]) -> np.ndarray:
    """Each sorted set as a 0/1 row over the sorted shingles in `part`."""
    out = np.zeros((len(own), len(part)), np.float32)
    for i, x in enumerate(own):
        x = x[np.searchsorted(x, part[0]) : np.searchsorted(x, part[-1], side="right")]
        at = np.searchsorted(part, x)
        out[i, at[part[at] == x]] = 1
    return out


def _compare(percent: int):
    """The differing labels of linked sets of two blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for row in range(batch.num_rows):
                sides = []
                for at in (0, 2):
                    own = [np.frombuffer(x, np.uint64) for x in batch.column(at + 1)[row].as_py()]
                    sides.append((np.array(batch.column(at)[row].as_py()), own, np.array([len(x) for x in own])))
                (l1, s1, n1), (l2, s2, n2) = sides
                # the sets as 0/1 rows over the shingles that both blocks have, a product of which counts what pairs share
                common = np.intersect1d(np.concatenate(s1), np.concatenate(s2))
                both = np.zeros((len(s1), len(s2)), np.float32)
                for lo in range(0, len(common), 1 << 15):
                    part = common[lo : lo + (1 << 15)]
                    both += _rows_over(part, s1) @ _rows_over(part, s2).T
                linked = (100 * both >= percent * (n1[:, None] + n2[None, :] - both)) & (l1[:, None] != l2[None, :])
                i, j = np.nonzero(linked)
                linked = np.unique(np.stack([l1[i], l2[j]]), axis=1)
                a += linked[0].tolist()
                b += linked[1].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _in_blocks(rest: DataFrame, own: DataFrame, percent: int) -> Stored:
    """Links between classes of `rest` (key, rep, label) that share a key and differ in label."""
    spark = rest.sparkSession
    # Neighbours under a key lie near each other when sorted by the least label they meet there.
    meets = rest.groupBy("key").agg(F.min("label").alias("meet"))
    placed = rest.join(meets, "key").groupBy("rep", "label").agg(F.min("meet").alias("meet"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = placed.repartitionByRange(parts, "meet", "label", "rep").sortWithinPartitions("meet", "label", "rep")
    rows = store(ordered.select("rep", "label").mapInArrow(_numbered, "part long, at long, rep long, label long"), "near-places")
    # Places go on from partition to partition, so that all blocks but the last are full however many partitions there are.
    before, ends = 0, []
    for row in sorted(rows.df.groupBy("part").agg(F.count("*").alias("n")).collect()):
        ends.append((row.part, before))
        before += row.n
    begins = F.broadcast(spark.createDataFrame(ends, "p long, begin long"))
    home = rows.df.join(begins, F.col("part") == F.col("p")).select(((F.col("begin") + F.col("at")) / BLOCK).cast("long").alias("block"), "rep", "label")
    filled = home.join(own.withColumnRenamed("rep", "r"), F.col("rep") == F.col("r")).select("block", "rep", "label", "own").repartition("block").sortWithinPartitions("block")
    blocks = store(filled.mapInArrow(released(_packed), "block long, reps array<long>, labels array<long>, sets array<binary>"), "near-blocks")
    home = home.select("block", "rep")
    # All keys that meet in a label are taken together: in the sort they are one run of blocks.
    met = store(rest.select("key", "rep").join(home, "rep").join(meets, "key").select("meet", "block").distinct(), "near-tiles")
    one, two = (met.df.select(F.col("meet").alias(f"meet_{n}"), F.col("block").alias(n)) for n in ("one", "two"))
    tiles = one.join(two, (F.col("meet_one") == F.col("meet_two")) & (F.col("one") <= F.col("two"))).select("one", "two").distinct()
    side = lambda n: blocks.df.select(*[F.col(c).alias(f"{c}_{n}") for c in blocks.df.columns])
    apart = ~((F.size(F.array_distinct(F.concat("labels_1", "labels_2")))) == 1)
    pairs = tiles.join(side(1), F.col("one") == F.col("block_1")).join(side(2), F.col("two") == F.col("block_2")).where(apart)
    with batch_rows(spark, 8):
        found = store(pairs.select("labels_1", "sets_1", "labels_2", "sets_2").mapInArrow(released(_compare(percent)), "a long, b long"), "near-links")
    for gone in (rows, blocks, met):
        gone.drop()
    return found


def shingle_counts(sets: DataFrame) -> np.ndarray:
    """How often shingles with the same last bits are in some of `sets` (own)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            total += np.bincount((_flat_binary(batch.column(0))[0] % np.uint64(COUNTERS)).astype(np.int64), minlength=COUNTERS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["at", "n"])

    draw = F.xxhash64(F.lit("order"), "own") / F.lit(2.0**64) + F.lit(0.5)
    some = sets.where(draw < min(1.0, ORDER_SETS / max(1, sets.count()))).select("own")
    got = some.mapInArrow(released(run), "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(COUNTERS, np.int64)
    out[got.column("at").to_numpy()] = got.column("n").to_numpy()
    return out


def first_shingles(sets: DataFrame, counts: np.ndarray, percent: int) -> DataFrame:
    """key, rep, label and n (the set's size) for the first shingles of each of `sets` (rep, label, own), ordered by
    `counts`: so many that two linked sets share one. Sets with `percent` of their union in common have at least that
    share of the larger one; if the first ones had none in common, too few would be left."""
    shared = sets.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, size = _flat_binary(batch.column(2))
            size = size.astype(np.int64)
            number = shared.value[(flat % np.uint64(COUNTERS)).astype(np.int64)]
            flat = flat[np.lexsort((flat, number, np.repeat(np.arange(len(size)), size)))]
            keep = np.where(size > 0, size - (percent * size + 99) // 100 + 1, 0)
            of = np.repeat(np.arange(len(size)), keep)
            key = flat[ranges(np.cumsum(size) - size, keep)].astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key), batch.column(0).take(pa.array(of)), batch.column(1).take(pa.array(of)), pa.array(size[of])], names=["key", "rep", "label", "n"])

    return sets.select("rep", "label", "own").mapInArrow(released(run), "key long, rep long, label long, n long")


def _by_shingles(rest: DataFrame, own: DataFrame, percent: int) -> list[Stored]:
    """Links between classes of `rest` (rep, label) that differ in label."""
    spark = rest.sparkSession
    left = rest.groupBy("rep").agg(F.min("label").alias("label")).join(own.withColumnRenamed("rep", "r"), F.col("rep") == F.col("r"))
    sets = store(left.select("rep", "label", "own"), "near-left")
    each = store(first_shingles(sets.df, shingle_counts(sets.df), percent), "near-first")
    several = each.df.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("c")).where("low < high")
    met = store(each.df.join(several.select("key", "c"), "key"), "near-met")
    few = met.df.where(F.col("c") <= PAIRED)
    one, two = (few.select("key", F.col("rep").alias(rep), F.col("label").alias(label), F.col("n").alias(n)) for rep, label, n in (("a", "la", "na"), ("b", "lb", "nb")))
    alike = (F.col("a") < F.col("b")) & (F.col("la") != F.col("lb")) & _close("na", "nb", percent) & _close("nb", "na", percent)
    pairs = one.join(two, "key").where(alike).select("a", "b", "la", "lb").distinct()
    with batch_rows(spark, 128):
        links = [store(verify(pairs, sets.df.select("rep", "own"), percent), "near-links")]
    many = met.df.where(F.col("c") > PAIRED).select("key", "rep", "label")
    if not many.isEmpty():
        links.append(_in_blocks(many, sets.df.select("rep", "own"), percent))
    for gone in (sets, each, met):
        gone.drop()
    return links


def _close(a: str, b: str, percent: int):
    return F.col(a) * 100 >= F.col(b) * percent


def live_keys(each: DataFrame) -> DataFrame:
    """Of `each` (rep, n_shingles, key) the rows whose key several have; of keys with the same members one is enough."""
    shared = each.groupBy("key").agg(F.count("*").alias("c"), F.sum(F.xxhash64("rep").cast("decimal(38,0)")).alias("s"), F.min("rep").alias("low")).where("c > 1")
    unique = shared.groupBy("c", "s", "low").agg(F.min("key").alias("key")).select("key")
    return each.join(unique, "key").select("rep", "n_shingles", "key")


def linked(members: DataFrame, own: DataFrame, percent: int) -> list[Stored]:
    """Changes (node, component) that take each rep, as its own label, to its component, one after the other.

    `members` (rep, n_shingles, key) are candidates where they share a key; their sets, `own` (rep, own), decide.
    """
    spark = members.sparkSession
    changes: list[Stored] = []
    rest = _open_keys(members.withColumn("label", F.col("rep")), 0)
    left, turn, settled = rest.df.count(), 0, True
    while left:
        if settled:
            pairs = rest.df.select(
                F.col("x.rep").alias("a"), F.col("x.label").alias("la"), F.col("x.n_shingles").alias("na"), F.col("rep").alias("b"), F.col("label").alias("lb"), F.col("n_shingles").alias("nb")
            )
            pairs = pairs.where(F.col("la") != F.col("lb")).where(_close("na", "nb", percent) & _close("nb", "na", percent)).select("a", "b", "la", "lb").distinct()
            with batch_rows(spark, 128):
                links = [store(verify(pairs, own, percent), "near-links")]
        else:
            links = _by_shingles(rest.df, own, percent)
        changes.append(components(reduce(DataFrame.union, [x.df for x in links]), "near-components"))
        for gone in links:
            gone.drop()
        if not settled:
            break
        moved = store(relabelled(rest.df.drop("x"), changes[-1:]), "near-moved")
        rest.drop()
        turn += 1
        rest = _open_keys(moved.df, turn)
        moved.drop()
        now = rest.df.count()
        left, settled = now, now <= (1 - SETTLED) * left
    rest.drop()
    return changes


def _open_keys(df: DataFrame, turn: int) -> Stored:
    """Of `df` (rep, n_shingles, key, label) the rows whose key has several labels, each with x, the leader of its key."""
    leader = F.min_by(F.struct("rep", "label", "n_shingles"), F.xxhash64("rep", F.lit(turn))).alias("x")
    several = df.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), leader).where("low < high").select("key", "x")
    return store(df.join(several, "key"), "near-rest")


def near_duplicates(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT, halves: int = HALVES, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of `docs` (doc_id, text).

    Words are runs of anything but ASCII white space, with A-Z lowered. Documents whose sets of distinct k-word shingles
    have `percent` hundredths of their union in common are linked; component_id is the smallest doc_id reachable, and
    kept says that it is the row's own. A text of fewer than k words is one shingle; null, empty and wordless texts have
    none and are linked with nothing. Repeated rows are copies; rows that repeat an id share its component. A row whose
    doc_id is null takes no part: its component is null and it is kept. An empty table gives no rows. Other columns are
    not read.
    """
    text_batches(docs.sparkSession)
    known = store(signatures(docs, k, halves, rows), "near-signatures")
    same = ("n_shingles", "set_a", "set_b")
    classes = store(known.df.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()).groupBy(*same).agg(F.min("doc_id").alias("rep"), F.first("halves").alias("halves")), "near-classes")
    each = classes.df.select("rep", "n_shingles", F.posexplode("halves").alias("at", "half"))
    live = each.groupBy("half").agg(F.count("*").alias("c")).where("c > 1").select("half")
    # Halves that two classes share at least, then pairs of such halves.
    lived = each.join(live, "half").groupBy("rep", "n_shingles").agg(
        F.collect_list(F.when(F.col("at") < halves, F.col("half"))).alias("left"), F.collect_list(F.when(F.col("at") >= halves, F.col("half"))).alias("right")
    )
    pairs = lived.where("size(left) > 0 and size(right) > 0").select("rep", "n_shingles", F.explode("left").alias("l"), "right").select("rep", "n_shingles", "l", F.explode("right").alias("r"))
    keyed = store(pairs.select("rep", "n_shingles", F.xxhash64("l", "r").alias("key")), "near-keys")
    members = store(live_keys(keyed.df), "near-members")
    keyed.drop()
    active = members.df.select("rep").distinct().join(classes.df.select("rep", "set_a", "set_b"), "rep")
    own = store(sets_of(docs.select(F.col("doc_id").cast("long").alias("rep"), "text").join(active, "rep"), k), "near-sets")
    changes = linked(members.df, own.df, percent)
    members.drop()
    own.drop()
    of_class = relabelled(classes.df.select(*same, F.col("rep").alias("component")), changes, "component").select(*[F.col(c).alias(f"c_{c}") for c in same], "component")
    component = F.coalesce("component", "doc_id")
    on = [F.col(c) == F.col(f"c_{c}") for c in same]
    return known.df.join(of_class, on[0] & on[1] & on[2] & F.col("doc_id").isNotNull(), "left").select(
        "doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept")
    )


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """`docs` without the rows that are not kept; of rows that repeat a kept id in full, all stay."""
    gone = near_duplicates(docs, **options).where(~F.col("kept")).select(F.col("doc_id").alias("gone_id")).distinct()
    return docs.join(gone, F.col("doc_id") == F.col("gone_id"), "left_anti")


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spread(table(spark, sf_dir, "documents")))
