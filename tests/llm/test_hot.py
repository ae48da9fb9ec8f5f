"""Groups that very many rows are in: the links found, and the rows that it takes to find them."""

import itertools
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from marlstone.llm import neardup, quality
from marlstone.llm.components import components, least_reachable
from tests.llm.test_ops import brute_components, sentence


def shingles(text):
    w = text.lower().split()
    return frozenset(tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3)))


def close_pairs(sets):
    return {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}


def own_sets(spark, df):
    marks = neardup.signatures(df).select(F.col("doc_id").alias("rep"), "set_a")
    return neardup.sets_of(df.withColumnRenamed("doc_id", "rep").join(marks, "rep"), 4)


def written(monkeypatch):
    """Rows of each table that near-dedup stores, by its name."""
    rows, store = {}, neardup.store

    def counted(df, name):
        out = store(df, name)
        rows.setdefault(name, []).append(out.df.count())
        return out

    monkeypatch.setattr(neardup, "store", counted)
    return rows


def test_few_links_take_no_rounds(spark):
    rng = np.random.default_rng(4)
    a, b = rng.integers(0, 400, 330), rng.integers(0, 400, 330)
    path = np.random.default_rng(5).permutation(200) + 1000
    a, b = np.concatenate([a, path[1:]]), np.concatenate([b, path[:-1]])
    links = spark.createDataFrame(list(zip(a.tolist(), b.tolist())), "a long, b long")
    few, many = ({r.node: r.component for r in components(links, driver_links=n).df.collect()} for n in (10**6, 0))
    assert few == many and {few.get(x, x) for x in path.tolist()} == {1000}
    node, least = least_reachable(a, b)
    assert all(few.get(x, x) == y for x, y in zip(node.tolist(), least.tolist()))


def test_blocks_are_full_in_many_partitions(spark, monkeypatch):
    rng = random.Random(13)
    base = [sentence(rng, 4) for _ in range(200)]
    texts = [(i, " ".join(base[i : i + 40])) for i in range(150)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    own = own_sets(spark, df)
    rest = df.select(F.lit(7).cast("long").alias("key"), F.col("doc_id").alias("rep"), F.col("doc_id").alias("label"))
    rows, before = written(monkeypatch), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        found = {tuple(sorted((r.a, r.b))) for r in neardup._in_blocks(rest, own, 80).df.collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found == close_pairs({i: shingles(t) for i, t in texts})
    assert rows["near-blocks"] == [3]


def test_a_common_line_makes_no_pairs(spark, monkeypatch):
    # all keys are shared, since all texts have the line; few texts are alike
    rng = random.Random(14)
    line = sentence(rng, 12)
    texts = [f"{line} {sentence(rng, 25)}" for _ in range(200)]
    texts += [t + " more" for t in texts[:5]] + [line, line + " ", line.split()[0]]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {i: shingles(t) for i, t in rows}
    members = df.select(F.col("doc_id").alias("rep"), F.lit(20).cast("long").alias("n_shingles"), F.lit(7).cast("long").alias("key"))
    tables = written(monkeypatch)
    changes = neardup.linked(members, own_sets(spark, df), 80)
    got = {r.rep: r.label for r in neardup.relabelled(members.withColumn("label", F.col("rep")), changes).collect()}
    assert got == brute_components(sets, 80)
    assert "near-blocks" not in tables


def test_first_shingles_meet_whatever_the_order(spark):
    rng = random.Random(15)
    base = sentence(rng, 30).split()
    texts = []
    for _ in range(60):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = f"new{rng.randint(0, 10**6)}"
        texts.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = own_sets(spark, df).withColumn("label", F.col("rep"))
    want = close_pairs({i: shingles(t) for i, t in enumerate(texts)})
    for counts in (np.zeros(neardup.COUNTERS, np.int64), neardup.shingle_counts(sets)):
        keys = {}
        for r in neardup.first_shingles(sets, counts, 80).collect():
            keys.setdefault(r.key, set()).add(r.rep)
        met = {p for reps in keys.values() for p in itertools.combinations(sorted(reps), 2)}
        assert want and want <= met


def test_pooled_sums_in_double_precision():
    rng = random.Random(16)
    texts = [sentence(rng, n) for n in (0, 1, 2, 1024, 1025, 3000)] + [None]
    vectors = quality.word_vectors(np.random.default_rng(1).integers(-50, 50, (1 << 10, quality.DIMENSIONS)))
    got = quality.pooled(pa.array(texts, pa.string()), vectors)
    for row, text in zip(got, texts):
        data = np.frombuffer((text or "").encode(), np.uint8)
        v = vectors[quality.tokens(data, np.array([0, len(data)]), len(vectors))[0]].astype(np.float64)
        n = len(v)
        want = [*v.sum(axis=0) / max(n, 1), *(v * v).sum(axis=0) / max(n, 1), (v[1:] * v[:-1]).sum() / max(n - 1, 1), np.log1p(n) / 5]
        assert np.abs(row - want).max() < 1e-12
