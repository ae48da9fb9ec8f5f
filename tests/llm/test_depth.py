"""The ten operators where the small fixtures of test_ops do not reach: many blocks, chunks and rounds, and models."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marlstone.llm import _words, bpe, langid, mixing, neardup, passages, pii, quality, urlfilter, vectors
from tests.llm.test_ops import brute_components, empty, sentence, words


def hashed(texts, k):
    (_, _, data, offsets), = _words.groups(pa.array(texts))
    return _words.flat_sets(*_words.word_hashes(data, offsets), k)


def test_flat_sets_are_the_sets():
    rng = random.Random(1)
    texts = [sentence(rng, n) for n in (0, 1, 3, 4, 5, 40)] + ["a b a b a b a b a b", "", None, " x "]
    own, first = hashed(texts, 4)
    seen = {}
    for t, part in zip(texts, np.split(own, first[1:-1])):
        w = words(t)
        want = {tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set()
        assert len(part) == len(want) and (np.diff(part.astype(object)) > 0).all()
        for s in want:
            seen.setdefault(s, set()).update(part.tolist())
    a, b = _words.fingerprints(own, first)
    assert a[0] == 0 and a[6] != a[7] and len(set(zip(a.tolist(), b.tolist()))) == len(texts) - 2


def test_blocks_after_the_leader_rounds(spark):
    # a ring of texts, each near its neighbours only, under keys that all share: leaders settle little
    rng = random.Random(12)
    base = [sentence(rng, 4) for _ in range(400)]
    rows = [(i, " ".join(base[i : i + 40])) for i in range(0, 300)]
    sets = {i: frozenset(tuple(t.split()[k : k + 4]) for k in range(len(t.split()) - 3)) for i, t in rows}
    want = brute_components(sets, 80)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(df).collect()}
    assert got == want
    members = df.select(F.col("doc_id").alias("rep"), F.lit(1).cast("long").alias("n_shingles"), F.lit(7).cast("long").alias("key"))
    marks = neardup.signatures(df).select(F.col("doc_id").alias("rep"), "set_a")
    own = neardup.sets_of(df.withColumnRenamed("doc_id", "rep").join(marks, "rep"), 4)
    rest = members.withColumn("label", F.col("rep")).select("key", "rep", "label")
    found = {(r.a, r.b) for r in neardup._in_blocks(rest, own, 80).df.collect()}
    pairs = {(a, b) for a, b in itertools.combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert {tuple(sorted(p)) for p in found} == pairs


def test_paragraphs_against_brute_force(spark):
    rng = random.Random(21)
    base = [sentence(rng, rng.randint(30, 60)) for _ in range(12)]
    rows = []
    for d in range(40):
        lines = [sentence(rng, 45)]
        for _ in range(2):
            w = rng.choice(base).split()
            for _ in range(rng.randint(0, 2)):
                w[rng.randrange(len(w))] = f"n{rng.randint(0, 9)}"
            lines.append(" ".join(w))
        rows.append((d, "\n".join(lines + [sentence(rng, 8)])))
    # a paragraph of 40 words whose shingles repeat, in two documents
    phrase = " ".join([sentence(rng, 10)] * 4)
    rows += [(100, phrase + "\n" + sentence(rng, 35)), (101, sentence(rng, 33) + "\n" + phrase)]
    sets, home = {}, {}
    for d, t in rows:
        for n, line in enumerate(t.split("\n")):
            w = words(line)
            if len(w) >= 30:
                sets[d * 100 + n] = frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    component = brute_components(sets, 80)
    for node, c in component.items():
        home.setdefault(c, set()).add(node // 100)
    want = {(node // 100, node % 100, min(home[c])) for node, c in component.items() if len(home[c]) > 1}
    got = [r for r in passages.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.kind == "paragraph"]
    found = {(r.doc_id, r.start, r.first_doc) for r in got}
    assert found <= want and len(found) >= 0.98 * len(want) and {100, 101} <= {r.doc_id for r in got}
    assert all(r.removed == (r.doc_id != r.first_doc) for r in got)


def test_passages_whose_ends_differ(spark):
    rng = random.Random(22)
    core = sentence(rng, 60).split()
    rows = [(i, " ".join([sentence(rng, 20 + 3 * i), *core[:-1], f"end{i}", sentence(rng, 25)])) for i in range(4)] + [(9, sentence(rng, 200)), (9, sentence(rng, 20_000))]
    got = [r for r in passages.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.kind == "passage"]
    assert {r.doc_id for r in got} == {0, 1, 2, 3} and len({r.cluster_id for r in got}) == 1
    assert all(r.first_doc == 0 for r in got)


def test_places_are_chosen_as_by_plain_windows():
    rng = np.random.default_rng(3)
    for n, window in ((5, 8), (26, 20), (200, 20), (200, 7)):
        x = rng.integers(0, 50, n).astype(np.uint64)
        want = sorted({i + int(np.argmin(x[i : i + window])) for i in range(n - window + 1)})
        assert passages.chosen(x, np.full(n, n), window).tolist() == want


def test_many_intervals(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 6))
    x[200:300] = x[:100] + rng.normal(scale=0.12, size=(100, 6))
    x[300:330] = x[0]
    label = np.array([int(i % 3 > 0) for i in range(len(x))])
    df = spark.createDataFrame([(i, v.tolist(), int(m)) for i, (v, m) in enumerate(zip(x, label))], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r for r in vectors.similar(df, interval_numbers=90, leaf=5).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = (unit @ unit.T >= 0.93) & (label[:, None] == label[None, :])
    np.fill_diagonal(links, False)
    component = np.arange(len(x))
    while True:
        new = np.array([min([component[i], *component[links[i]]]) for i in range(len(x))])
        if (new == component).all():
            break
        component = new
    assert all(got[i].n_links == links[i].sum() and got[i].component_id == component[i] for i in range(len(x)))


def test_nearest_with_many_leaves_and_chunks(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(20_000, 12)).astype(np.float32).astype(float)
    x[:300] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(30_000 + i, rng.normal(size=3).tolist()) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    by = {}
    for r in sorted(vectors.nearest(df, F.col("vec_id") % 200 == 0, leaf_rows=32, bucket_rows=500, query_chunk=20).collect(), key=lambda r: r["rank"]):
        by.setdefault(r.query_id, []).append(r.vec_id)
    hits = 0
    for q in range(0, 20_000, 200):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        hits += len(set(by[q]) & set(np.lexsort((np.arange(len(d)), d))[:10].tolist()))
        assert len(by[q]) == 10
    assert hits >= 0.9 * 1000 and len(by[30_000]) == 10 and all(v >= 30_000 for v in by[30_000])


def test_twelve_clusters(spark):
    rng = np.random.default_rng(4)
    x = (rng.normal(size=(12, 5)) * 20)[np.arange(3120) % 12] + rng.normal(size=(3120, 5)) * 0.1
    x[[0, 12, 24, 36]] += 500
    got = vectors.nearest(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), F.col("vec_id") % 100 == 0)
    assert {r["count"] for r in got.groupBy("query_id").count().collect()} == {10}


PIECES = ["▁a", "▁ab", "b", "bc", "c", "▁abc", "cab"]


def toy_model(seed=0):
    h = langid.piece_hashes(PIECES)
    order = np.argsort(h)
    chances = np.random.default_rng(seed).random((len(PIECES) + 1, 2)) * 0.3 + 1e-7
    return langid.Model(["x", "y"], h[order], chances, np.zeros(2), 4), order


def segmentations(word, model, order):
    """The sum over all ways to cut, one by one."""
    number = {PIECES[k]: i for i, k in enumerate(order)}
    marked = "▁" + word

    def total(at):
        if at == len(marked):
            return np.ones(2)
        out = np.zeros(2)
        for end in range(at + 1, len(marked) + 1):
            if at == 0 and end == 1:
                continue
            piece = marked[at:end]
            if piece in number:
                out = out + model.chances[number[piece]] * total(end)
            elif end - at == 1 or at == 0 and end == 2:
                out = out + model.chances[-1] * total(end)
        return out

    return np.log(total(0))


def test_words_of_any_length():
    model, order = toy_model()
    for w in ("abc", "abcabcz", "bca", "z", "cabab"):
        assert langid.log_chances([w], model)[0] == pytest.approx(segmentations(w, model, order))
        assert langid._log_forward(w, np.log(model.chances), model.hashes, model.longest)[-1] == pytest.approx(segmentations(w, model, order))
    # the sum does not care where plain products end, nor is anything lost in long runs
    for n in (langid.LONG - 1, langid.LONG, langid.LONG + 1, 200):
        w = ("abcab" * n)[:n]
        assert langid.log_chances([w], model)[0] == pytest.approx(langid._log_forward(w, np.log(model.chances), model.hashes, model.longest)[-1])
    rare = langid.Model(["x", "y"], model.hashes, np.stack([np.full(len(PIECES) + 1, 1e-7), np.full(len(PIECES) + 1, 5e-7)], axis=1), np.zeros(2), 4)
    for n in (43, 48, 200):
        x = langid.log_chances(["z" * n], rare)[0]
        assert x == pytest.approx([n * np.log(1e-7), n * np.log(5e-7)])
    assert langid.words_of("A" * 5000 + " b") == ["a" * 5000, "b"]


def test_expected_uses_of_pieces():
    model, _ = toy_model()
    p = model.chances[:, 0]
    for w in ("abcab", "cabab"):
        step = 1e-6
        want = [p[k] * (langid._log_forward(w, np.log(p + step * (np.arange(len(p)) == k))[:, None], model.hashes, 4)[-1, 0] - langid._log_forward(w, np.log(p)[:, None], model.hashes, 4)[-1, 0]) / step for k in range(len(p))]
        assert langid._long_counts(w, 1.0, p, model.hashes, 4) == pytest.approx(want, abs=1e-3)


def test_language_ties_repeats_and_misfits(spark):
    rng = random.Random(2)
    make = lambda bits: " ".join("".join(rng.choice(bits) for _ in range(rng.randint(1, 4))) for _ in range(60))
    rows = [(i, make(["the", "ing", "on", "er"] if i % 2 else ["der", "sch", "ung", "ein"]), "en" if i % 2 else "de") for i in range(40)]
    odd = [(100, "これは日本語の文章です " * 5, None), (101, rows[1][1], None), (101, rows[1][1], None), (None, rows[2][1], None), (102, make(["the"]) * 200, None)]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string").withColumn("fit", F.lit(1))
    model = langid.train(df)
    got = langid.predict(df, model).collect()
    assert len(got) == len(rows) + len(odd)
    assert all((r.fit < model.floor) == (r.doc_id == 100) for r in got)
    assert len({(r.lang_pred, r.score, r.fit) for r in got if r.doc_id == 101}) == 1 and {r.lang_pred for r in got if r.doc_id is None} == {"de"}
    even = langid.Model(["b", "c"], model.hashes, np.repeat(model.chances[:, :1], 2, axis=1), np.log([0.5, 0.5]), model.longest)
    assert {(r.lang_pred, r.score) for r in langid.predict(df, even).collect()} == {("b", 0.5)}


def test_random_indexing_against_plain_sums(spark):
    texts = ["the cat sat on the mat, 12 cats!", "", None, "one", "é à b " * 7, "x " * 3000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    for buckets in (1 << 10, 1 << 12):
        index, want = quality.signs(buckets).astype(int), np.zeros((buckets, quality.DIMENSIONS), int)
        for t in texts:
            data = np.frombuffer((t or "").encode(), np.uint8)
            at, _ = quality.tokens(data, np.array([0, len(data)]), buckets)
            for i, b in enumerate(at):
                for j in range(max(0, i - quality.WINDOW), min(len(at), i + quality.WINDOW + 1)):
                    if j != i:
                        want[b] += index[at[j]]
        assert (quality.contexts(df, buckets) == want).all()
    vectors_ = quality.word_vectors(want)
    assert np.allclose(quality.pooled(pa.array(texts, pa.string()), vectors_), np.concatenate([quality.pooled(pa.array([t], pa.string()), vectors_) for t in texts]))


def test_quality_ties_repeats_null_ids(spark):
    rng = random.Random(4)
    rows = [(i, sentence(rng, 40) if i % 2 else "spam!! " * 30) for i in range(80)] + [(None, "spam!! " * 30), (7, sentence(rng, 40)), (7, None), (90, "spam!! " * 20_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1), (3, 1), (500, 0)], "doc_id long, quality int")
    model = quality.train(df, lab)
    got = quality.score(df, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (0, 2, 4, None)}) == 1 and [r.score < 0.5 for r in got if r.doc_id == 90] == [True]


def chained(text, model):
    g = pii.graph(text)
    return pii.Graph(g.nodes, g.patterns, g.chain, [], [], g.failed)


def symmetric(rng):
    x = rng.normal(size=(pii.LABELS, pii.LABELS))
    return (x + x.T) / 2


def test_messages_against_all_labellings():
    rng = np.random.default_rng(0)
    model = pii.Model(rng.normal(size=(pii.BITS + 1, pii.LABELS)), symmetric(rng), symmetric(rng))
    g = chained("call +1 (375) 555-4393 or 375 555-4393 then 222 333-4444 or a.b@c.de and 1234567890123", model)
    known = [[n[3] for n in g.nodes]]
    field = pii._field([g], model, known, False)
    want, pairs = np.zeros((len(g.nodes), pii.LABELS)), np.zeros((pii.LABELS, pii.LABELS))
    for labels in itertools.product(range(pii.LABELS), repeat=len(g.nodes)):
        w = np.exp(sum(field.unary[i, x] for i, x in enumerate(labels)) + sum(model.chain[labels[a], labels[b]] for a, b in g.chain))
        want[np.arange(len(labels)), labels] += w
        for a, b in g.chain:
            pairs[labels[a], labels[b]] += w
    total = want[0].sum()
    assert np.allclose(want / total, pii.beliefs([g], model), atol=1e-5)
    assert np.allclose((pairs + pairs.T) / 2 / total, pii.expected([g], model, known)[1], atol=1e-5)


def test_the_field_learns_through_messages():
    rng = random.Random(3)
    phone = lambda: f"+1 {rng.randint(200, 999)} 555-{rng.randint(1000, 9999)}"
    texts = []
    for _ in range(40):
        p = phone()
        texts.append(f"call {p} or {p} again, order {rng.randint(10**12, 10**13 - 1)}, mail a.{rng.randint(1, 99)}@x.com")
    graphs = [pii.graph(t) for t in texts]
    zero = pii.Model(np.zeros((pii.BITS + 1, pii.LABELS)), np.zeros((pii.LABELS,) * 2), np.zeros((pii.LABELS,) * 2))
    known = [[n[3] or f for n, f in zip(g.nodes, g.failed)] for g in graphs]

    def right(model):
        p, _ = pii._pass(pii._field(graphs, model, None, True), model)
        truth = np.array([n[0] for g in graphs for n in g.nodes])
        return np.mean(np.log(p[np.arange(len(truth)), truth])[np.concatenate(known)])

    learned = pii.raise_likelihood(graphs, zero)
    assert right(learned) > right(zero) + 0.5 and np.allclose(learned.skip, learned.skip.T)
    assert np.diag(learned.skip).mean() > learned.skip.mean()


def test_pii_long_texts_null_ids_ties(spark):
    number = "375 555-4393"
    rows = [(None, f"call +1 {number}"), (1, f"call +1 {number} " + f"or {number} " * 3000), (1, None), (2, "j.doe@x.com then jdoe and j_doe wrote"), (3, "+1 222 333 4444 +1 222 333 4444")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model = pii.train(df)
    got = {(r.doc_id, len(r.spans)) for r in pii.find(df, model).collect()}
    assert got == {(None, 1), (1, 3001), (1, 0), (2, 2), (3, 2)}
    assert pii.redact(df, model).where("doc_id = 2").first().text.count("<EMAIL>") == 2


def test_merges_are_those_of_the_vocabulary():
    import tiktoken

    import public_tokenizers

    ranks = bpe.read_ranks(bpe.default_vocabulary())
    one = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(1)
    for _ in range(2000):
        w = bytes(rng.choice(b"aethinsorld  \xc3\xa9\xa8zqx") for _ in range(rng.randint(1, 90)))
        assert bpe.merge(w, ranks) == bpe._merge_long(w, ranks) == one._encode_single_piece(w)
    assert bpe.merge(b"a" * 20_000, ranks) == one._encode_single_piece(b"a" * 20_000)


def test_numbers_beyond_three_bytes():
    for x in ([], [0], [255, 256], [2**24, 2**24 + 5], [2**32 - 1]):
        assert bpe._unpack(bpe._pack(np.array(x, np.uint32))).tolist() == x


def test_words_over_many_buckets(spark):
    rng = random.Random(5)
    df = spark.createDataFrame([(i, sentence(rng, 30)) for i in range(60)], "doc_id long, text string")
    plain = {r.doc_id: r.ids for r in bpe.encode(df).collect()}
    assert {r.doc_id: r.ids for r in bpe.encode(df, block_chars=700, bucket_chars=50).collect()} == plain


def test_workers_give_memory_back(spark):
    """What a task held is not held by its worker any more, whether Arrow, numpy or Python had it."""
    from marlstone.runtime import released

    def rss():
        return int(open("/proc/self/statm").read().split()[1]) * 4096 / 1e6

    def hold(batches):
        kept = [np.ones(2000) * i for i in range(20_000)], [pa.array(range(1000)) for _ in range(10_000)], {str(i): [i] for i in range(500_000)}
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([rss()] * len(batch))], names=["mb"])
        del kept

    def look(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([rss()] * len(batch))], names=["mb"])

    # one partition at a time: the worker of the one before takes the next
    most = lambda f: spark.range(0, 1, 1, 1).mapInArrow(f, "mb double").first().mb
    held = most(released(hold))
    assert most(look) < held - 300


def test_mixing_targets_of_many_sources(spark):
    """Several sources above the water level, against rounds of resharing."""
    for sizes in ([100, 100, 100], [0, 7, 7000, 90, 4000, 1, 300, 300], [3000 + 37 * i for i in range(20)], [5], [0, 0]):
        names = [f"s{i:02}" for i in range(len(sizes) - 1)] + [None]
        weights, capped, budget = [mixing.WEIGHTS[i % 3] for i in range(len(sizes))], {}, 1.5 * sum(sizes)
        while True:
            free = [i for i in range(len(sizes)) if i not in capped]
            dealt = {i: (budget - sum(capped.values())) * weights[i] / sum(weights[j] for j in free) for i in free}
            over = {i: 2.0 * sizes[i] for i, t in dealt.items() if t > 2 * sizes[i]}
            if not over:
                break
            capped |= over
        got = mixing.source_targets(spark.createDataFrame(list(zip(names, sizes)), "source string, source_size long")).collect()
        assert {r.source: r.target for r in got} == pytest.approx({n: (capped | dealt)[i] for i, n in enumerate(names)})
    rows = [(100 * k + i, " ".join(["word"] * (5 + k)), f"s{k}") for k in range(6) for i in range(20)]
    mixed = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert all(0 <= r.taken <= 2 * r["size"] for r in mixed)
    assert sum(r.taken for r in mixed) == pytest.approx(1.5 * sum(r["size"] for r in mixed), abs=6)


def test_mixing_rows_that_share_ids(spark):
    rng = random.Random(6)
    rows = [(None, sentence(rng, 20 + i % 7), "a") for i in range(40)] + [(5, sentence(rng, 20), "b") for _ in range(30)] + [(6, "same words here", s) for s in ("a", "b", None) for _ in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken = mixing.mix(df).collect()
    assert len(taken) == len(rows) and len({r.key for r in taken if r.doc_id is None}) == 40
    first, again = (sorted((r.source or "", r.text) for r in mixing.apply_mix(x).collect()) for x in (df, df.repartition(5).orderBy("text")))
    assert first == again and sum(len(words(t)) for _, t in first) == sum(r.taken for r in taken)


def test_urls_in_one_form(spark):
    rows = [("HTTP://X.Example/a#t", "http://x.example/a"), ("http://x.example:80", "http://x.example/"), ("https://u@X.example.:443/B?q=1", "https://u@x.example/B?q=1"), ("https://x.example:8443/", "https://x.example:8443/"), ("http://[2001:DB8::1]:80/x", "http://[2001:db8::1]/x"), ("no url#x", "no url"), ("http://x.example?q", "http://x.example/?q")]
    df = spark.createDataFrame(rows, "url string, want string")
    assert all(r.got == r.want for r in df.select("want", urlfilter.normal_url(F.col("url")).alias("got")).collect())
    hosts = {r.url: r.host for r in df.select("url", urlfilter.host_of(F.col("url")).alias("host")).collect()}
    assert hosts["http://[2001:DB8::1]:80/x"] == "[2001:db8::1]" and hosts["no url#x"] == ""
    entries = spark.createDataFrame([("l", "host", "[2001:db8::1]", "add"), ("l", "url", "HTTP://x.example:80/a", "add"), ("l", "host", "x.example", "renew")], "list string, kind string, pattern string, action string").withColumn("at", F.lit("2024-01-01").cast("timestamp"))
    got = {r.url: r.n_entries for r in urlfilter.evaluate(df.withColumn("fetched_at", F.lit("2024-02-01").cast("timestamp")), entries).collect()}
    assert {u for u, n in got.items() if n} == {"HTTP://X.Example/a#t", "http://[2001:DB8::1]:80/x"}


def test_pipeline_on_empty_and_odd_tables(spark, tmp_path):
    import corpus_pipeline as p

    schema = "doc_id long, text string, lang string, source string, n_chars long, size string, key int, rep int"
    rng = random.Random(9)
    rows = [(i // 2, sentence(rng, 40), "en", "s", 1, "x", 1, 1) for i in range(12)] + [(None, sentence(rng, 40), None, None, None, None, None, None), (50, None, None, None, None, None, None, None), (51, "", "en", "s", 0, "x", 1, 1)]
    for name, own in (("odd", rows), ("none", [])):
        spark.createDataFrame(own, schema).write.parquet(str(tmp_path / name / "documents.parquet"))
    odd = p.run(spark, str(tmp_path / "odd")).collect()
    assert {r.doc_id for r in odd} <= {*range(6), None} and len(odd) >= 10
    assert p.run(spark, str(tmp_path / "none")).count() == 0


def test_empty_tables_stay_empty(spark):
    df = spark.createDataFrame([(1, "a", None)], "doc_id long, text string, source string")
    for out in (passages.repeats(empty(df)), bpe.encode(empty(df)), mixing.apply_mix(empty(df)), pii.redact(empty(df), pii.train(empty(df)))):
        assert out.count() == 0
