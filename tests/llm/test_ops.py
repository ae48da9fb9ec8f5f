"""The ten operators on small fixtures: against brute force, and with nulls, empties, ties, copies and clashing columns."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.llm import bpe, langid, mixing, neardup, passages, pii, quality, urlfilter, vectors
from marlstone.llm._words import word_hashes
from marlstone.llm.components import components

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 99)) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    base = [sentence(rng, 60) for _ in range(30)]
    rows = [(i, t, ["a", "b", None][i % 3]) for i, t in enumerate(base)]
    for i in range(30, 60):  # near copies: one to four words changed
        w = base[i % 5].split()
        for _ in range(rng.randint(1, 4)):
            w[rng.randrange(len(w))] = "changed"
        rows.append((i, " ".join(w), "a"))
    rows += [(60, None, "a"), (61, "", "b"), (62, " \n\t ", None), (63, "Two words", "b"), (64, "two WORDS", "b"), (65, base[0], "a"), (65, base[0], "a"), (None, base[0], "a"), (66, sentence(rng, 30_000), "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    # columns of other names, among them ones that operators use inside
    return df.withColumns({"lang": F.lit("en"), "n_chars": F.length("text").cast("long"), "size": F.lit("x"), "key": F.lit(1), "node": F.lit(2), "rep": F.lit(3), "label": F.lit("l")})


def empty(df):
    return df.where("1 = 0")


def brute_components(sets, percent):
    ids = list(sets)
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if sets[a] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_near_duplicates(spark, docs):
    sets = {}
    for r in docs.collect():
        w = words(r.text)
        if r.doc_id is not None:
            sets[r.doc_id] = frozenset(tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))) if w else frozenset()
    want = brute_components(sets, 80)
    got = neardup.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id)
    assert neardup.near_duplicates(empty(docs)).count() == 0
    kept = neardup.one_of_each(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, c in want.items() if i == c} | {None}


def test_large_group_of_near_copies(spark):
    rng = random.Random(5)
    base = sentence(rng, 40).split()
    rows = []
    for i in range(300):
        w = list(base)
        for _ in range(rng.randint(1, 3)):
            w[rng.randrange(len(w))] = f"new{rng.randint(0, 10**6)}"
        rows.append((i, " ".join(w)))
    sets = {i: frozenset(tuple(t.split()[k : k + 4]) for k in range(len(t.split()) - 3)) for i, t in rows}
    want = brute_components(sets, 80)
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_miss_rate():
    assert neardup.miss(0.8) < 1e-5 and neardup.miss(0.2) > 0.8


def test_components(spark):
    links = spark.createDataFrame([(5, 4), (4, 3), (3, 9), (9, 9), (20, 21), (22, 21), (None, 1)], "a long, b long")
    assert {r.node: r.component for r in components(links).df.collect()} == {4: 3, 5: 3, 9: 3, 21: 20, 22: 20}
    assert components(empty(links)).df.count() == 0


def test_similar_vectors(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(120, 8))
    x[60:90] = x[:30] + rng.normal(scale=0.1, size=(30, 8))
    x[100:110] = x[0]
    rows = [(i, v.astype(np.float32).tolist(), [1, 2, None][i % 7 % 3]) for i, v in enumerate(x)]
    rows += [(200, None, 1), (201, [0.0] * 8, 1), (202, [float("nan")] * 8, 1), (203, [1.0, None] + [0.0] * 6, 1), (204, [1.0], 1), (205, [2.0], 1), (None, rows[0][1], 1), (206, [], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({"cid": F.lit(1), "links": F.lit(1)})
    good = [(i, np.array(v, float), lab) for i, v, lab in rows if i is not None and lab is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    links = {i: {j for j, w, m in good if j != i and m == lab and len(w) == len(v) and v @ w / np.sqrt((v @ v) * (w @ w)) >= 0.93} for i, v, lab in good}
    comp = {i: i for i, *_ in good}
    for _ in range(len(good)):
        comp = {i: min([c, *(comp[j] for j in links[i])]) for i, c in comp.items()}
    got = vectors.similar(df).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.vec_id is not None:
            assert (r.n_links, r.component_id, r.kept) == (len(links.get(r.vec_id, ())), comp.get(r.vec_id, r.vec_id), comp.get(r.vec_id, r.vec_id) == r.vec_id)
    assert vectors.similar(empty(df)).count() == 0


def test_nearest(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(900, 6)).astype(np.float32)
    x[500:520] = x[0]  # ties
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1001, [0.0] * 6), (1002, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("leaf", F.lit(1))
    got = vectors.nearest(df, F.col("vec_id") % 100 == 0).collect()
    by = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        by.setdefault(r.query_id, []).append((r.vec_id, r.score))
    hits = 0
    assert set(by) == set(range(0, 900, 100))
    for q, found in by.items():
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(axis=1))
        d[q] = np.inf
        best = np.lexsort((np.arange(len(d)), d))[:10]
        hits += len(set(best) & {v for v, _ in found})
        assert len(found) == 10 and all(abs(d[v] - s) < 1e-12 for v, s in found)
    assert hits >= 0.9 * 90
    assert [v for v, _ in by[0]] == list(range(500, 510))
    assert vectors.nearest(empty(df), F.lit(True)).count() == 0
    assert vectors.nearest(df.where("vec_id < 3"), F.col("vec_id") == 0).count() == 2


def test_nearest_of_lone_rows(spark):
    rng = np.random.default_rng(6)
    groups = rng.normal(size=(8, 6)) * 3
    x = np.concatenate([[[500.0 + i, 0, 0, 0, 0, 0] for i in range(3)], groups[np.arange(2400) % 8]]).astype(np.float32).astype(float)
    rows = [(i, v.tolist(), i < 2) for i, v in enumerate(x)] + [(0, x[0].tolist(), False)] * 12
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, asked boolean")
    got = vectors.nearest(df, F.col("asked")).collect()
    for q in (0, 1):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        found = [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q]
        assert len(found) == 10 and all(v != q and abs(d[v] - s) < 1e-9 for v, s in found)
        assert [v for v, _ in found][:2] == ([1, 2] if q == 0 else [0, 0])


def test_language(spark):
    rng = random.Random(2)
    make = lambda bits: " ".join("".join(rng.choice(bits) for _ in range(rng.randint(1, 4))) for _ in range(40))
    rows = [(i, make(["the", "ing", "on", "er"]) if i % 2 else make(["der", "sch", "ung", "ein"]), "en" if i % 2 else "de") for i in range(60)]
    rows += [(100, None, "en"), (101, "12 34 !!", "de"), (102, "", None), (103, "x" * 5000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("old"))
    got = {r.doc_id: r for r in langid.predict(df, langid.train(df.where("doc_id >= 10"))).collect()}
    assert all(got[i].lang_pred == ("en" if i % 2 else "de") for i in range(60))
    assert [got[i].lang_pred for i in (100, 101, 102)] == ["und"] * 3 and got[100].score == 0
    assert all(0 <= r.score <= 1 for r in got.values())
    assert langid.predict(empty(df), langid.train(empty(df))).count() == 0
    assert {r.lang_pred for r in langid.predict(df, langid.train(empty(df))).collect()} == {"und"}


def test_forward_sums_all_segmentations():
    pieces = ["▁a", "▁ab", "b", "bc", "c", "▁abc"]
    h = langid.piece_hashes(pieces)
    order = np.argsort(h)
    p = np.array([0.2, 0.1, 0.3, 0.15, 0.25, 0.05])
    model = langid.Model(["x"], h[order], np.concatenate([p[order], [1e-7]])[:, None], np.zeros(1), 4)
    a, ab, b, bc, c, abc = p
    assert np.exp(langid.log_chances(["abc"], model)[0, 0]) == pytest.approx(a * b * c + ab * c + a * bc + abc)


def test_quality(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(200):
        good = i % 2
        rows.append((i, sentence(rng, 50) if good else " ".join([rng.choice(WORDS) + "!!"] * 50)))
        labels.append((i, good if i < 150 else None))
    rows += [(300, None), (301, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("quality", F.lit("x"))
    lab = spark.createDataFrame(labels, "doc_id long, quality int")
    model = quality.train(df, lab)
    got = {r.doc_id: r.score for r in quality.score(df, model).collect()}
    assert np.mean([(got[i] >= 0.5) == (i % 2) for i in range(150, 200)]) > 0.95
    assert len(got) == 202 and all(0 <= s <= 1 for s in got.values()) and got[300] == pytest.approx(got[301])
    untrained = quality.train(empty(df), empty(lab))
    assert quality.score(empty(df), untrained).count() == 0 and quality.score(df, untrained).first().score == 0.5


def test_mixing(spark, docs):
    sizes = [(r.doc_id, len(words(r.text)), r.source) for r in docs.collect()]
    got = mixing.mix(docs).collect()
    assert len(got) == len(sizes) and sorted((str(r.doc_id), r["size"]) for r in got) == sorted((str(i), n) for i, n, _ in sizes)
    total = {s: sum(n for _, n, x in sizes if x == s) for s in ("a", "b", None)}
    taken = {s: sum(r.taken for r in got if r.source == s) for s in total}
    for r in got:
        assert r.source_size == total[r.source] and 0 <= r.taken <= 2 * r["size"] and r.target <= 2 * r.source_size
    assert sum({r.source: r.target for r in got}.values()) == pytest.approx(1.5 * sum(total.values()))
    assert all(abs(taken[r.source] - r.target) < 1 for r in got)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(7)).collect()))
    assert mixing.mix(empty(docs)).count() == 0
    mixed = mixing.apply_mix(docs)
    assert mixed.columns == docs.columns
    assert sum(len(words(r.text)) for r in mixed.collect()) == sum(taken.values())


def plain_base(text):
    digits = lambda x: re.sub("[^0-9]", "", x)
    rules = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda x: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda x: all(int(p) <= 255 for p in x.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda x: 13 <= len(digits(x)) <= 19 and pii.luhn(digits(x))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda x: 9 <= len(digits(x)) <= 15),
    ]
    return [(k, m.start(), m.end()) for k, p, ok in rules for m in re.finditer(p, text or "") if ok(m[0])]


def test_pii_base_spans():
    rng = random.Random(6)
    for _ in range(3000):
        text = "".join(rng.choice("a1 0-+.@(%9é\n4") for _ in range(rng.randint(0, 50)))
        assert [(pii.KINDS[k], s, e) for k, s, e in pii.base_spans(text)] == plain_base(text)


def test_pii_links_mentions(spark):
    rows = [(1, "call +1 (375) 555-4393 é or later 375 555-4393"), (2, "mail abc.12@x.com and abc.12 again"), (3, None), (4, ""), (5, "no data, order 1234567890123"), (5, "no data, order 1234567890123"), (6, "card 4111 1111 1111 1111 " * 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit("x"))
    model = pii.train(df)
    got = pii.find(df, model).collect()
    assert len(got) == len(rows)
    texts = dict(rows)
    for r in got:
        assert [(s.kind, s.start, s.end) for s in r.spans if s.base] == plain_base(texts[r.doc_id])
    by = {r.doc_id: r.spans for r in got}
    assert any(not s.base and s.kind == "phone" for s in by[1]) and any(not s.base and s.kind == "email" for s in by[2]) and by[5] == []
    assert pii.redact(df, model).where("doc_id = 2").first().text == "mail <EMAIL> and <EMAIL> again"
    assert pii.find(empty(df), pii.train(empty(df))).count() == 0


def test_bpe_round_trip(spark, docs):
    import public_tokenizers
    import tiktoken

    rows = [(1, "don't  stop\n\n at 12345 — naïve \U0001f600\x1c\x85 ok"), (2, None), (3, ""), (4, "<|endoftext|> " * 3), (5, "a" * 20_000), (5, "a" * 20_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").unionByName(docs.select("doc_id", "text")).withColumn("block", F.lit(1))
    one = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(bpe.default_vocabulary()), special_tokens={})
    for chars in (bpe.BLOCK_CHARS, 500):
        got = bpe.decode(bpe.encode(df, block_chars=chars)).collect()
        want = sorted((str(r.doc_id), one.encode_ordinary(r.text or ""), (r.text or "").encode()) for r in df.collect())
        assert sorted((str(r.doc_id), r.ids, bytes(r.decoded)) for r in got) == want
    assert bpe.encode(empty(df)).count() == 0


def test_pii_repeats_do_not_fade():
    # weights that do not favour the right label themselves
    skip = np.full((pii.LABELS, pii.LABELS), -2.0) + 4.0 * np.eye(pii.LABELS)
    weights = np.zeros((pii.BITS + 1, pii.LABELS))
    weights[-1, pii.OTHER] = 0.5
    model = pii.Model(weights, np.zeros((pii.LABELS, pii.LABELS)), skip)
    number = "375 555-4393"
    for n in (1, 2, 12, 40):
        text = f"call +1 {number}" + f" or, said again, {number}" * n + " or 222 333-4444"
        for texts in ([text], [text, f"+1 {number}", None, "9 8 7 at 5551234 and 5551234"]):
            found = pii.label(texts, model)[0]
            assert len(found) == n + 1 and {k for k, *_ in found} == {3} and sum(b for *_, b in found) == 1
    p = pii.beliefs([g := pii.graph(text)], model)
    alone = pii.beliefs([pii.graph("call +1 " + number + " or " + number)], model)
    assert np.allclose(p[1:-1], alone[1], atol=1e-4) and len(p) == len(g.nodes)
    # opposed potentials swing, and stop all the same
    assert np.isfinite(pii.beliefs([g], pii.Model(weights, -6 * skip, skip))).all()


def test_repeated_passages(spark):
    rng = random.Random(8)
    passage = sentence(rng, 60)
    rows = [(i, sentence(rng, 40 + i) + " " + passage + " " + sentence(rng, 50)) for i in range(6)] + [(i, sentence(rng, 120)) for i in range(10, 20)]
    line = sentence(rng, 80).split()
    rows += [(20 + i, sentence(rng, 40) + "\n" + " ".join(line[:70] + [f"x{i}"] + line[71:]) + "\n" + sentence(rng, 35)) for i in range(3)]
    rows += [(30, None), (31, ""), (None, rows[0][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"start": F.lit(0), "one": F.lit("x")})
    got = passages.repeats(df).collect()
    assert {r.doc_id for r in got if r.kind == "passage"} >= set(range(6)) and not {r.doc_id for r in got} & set(range(10, 20))
    assert {r.doc_id for r in got if r.kind == "paragraph"} == {20, 21, 22}
    for r in got:
        assert r.removed == (r.doc_id != r.first_doc)
    spot = [r for r in got if r.doc_id == 3 and r.kind == "passage"]
    assert all(43 <= r.start and r.end <= 103 for r in spot)
    assert passages.repeats(empty(df)).count() == 0
    bands, rows_ = passages.tune_bands(0.8)
    assert 1 - (1 - 0.8**rows_) ** bands >= passages.RECALL


def test_url_filter(spark):
    events = [("l", "domain", "bad.example", "add", "2024-01-10"), ("l", "domain", "bad.example", "remove", "2024-02-01"), ("l", "host", "x.bad.example", "add", "2024-03-01"), ("m", "url", "http://ok.example/p", "add", "2024-01-01"), ("m", "url", "http://ok.example/p", "add", "2024-01-01"), ("t", "host", "tie.example", "add", "2024-01-05"), ("t", "host", "tie.example", "remove", "2024-01-05"), (None, "host", "n.example", "add", "2024-01-01")]
    entries = spark.createDataFrame(events, "list string, kind string, pattern string, action string, at string").withColumn("at", F.col("at").cast("timestamp"))
    asked = [("http://X.bad.example/a", "2024-01-15", 2 - 1), ("http://x.bad.example/a", "2024-02-01", 0), ("http://x.bad.example/a", "2024-03-02", 1), ("http://ok.example/p#top", "2024-01-01", 1), ("http://tie.example/", "2024-01-06", 0), ("no url", "2024-01-15", 0), (None, "2024-01-15", 0), ("http://bad.example/", None, 0), ("http://X.bad.example/a", "2024-01-15", 1)]
    caps = spark.createDataFrame(asked, "url string, t string, want int").withColumn("fetched_at", F.col("t").cast("timestamp")).withColumn("lists", F.lit("old"))
    got = urlfilter.evaluate(caps, entries).collect()
    assert len(got) == len(asked) and all(r.n_entries == r.want and r.blocked == (r.want > 0) for r in got)
    assert urlfilter.evaluate(empty(caps), entries).count() == 0 and urlfilter.evaluate(caps, empty(entries)).where("blocked").count() == 0


def test_pipeline(spark, sf_dir, tmp_path):
    import corpus_pipeline as p

    rng = random.Random(9)
    texts = [sentence(rng, 50) for _ in range(12)]
    rows = [(i, t, "en", f"s{i % 2}") for i, t in enumerate(texts)] + [(20, texts[0], "en", "s0"), (21, texts[1] + " end", "en", "s1"), (22, "123 !!", "en", "s0"), (23, None, None, "s1"), (24, "write to jo.1@mail.example now please", None, "s0")]
    df = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    kept = df
    for name, stage in p.STAGES[:-1]:
        kept = spark.createDataFrame(stage(spark, kept, str(tmp_path)).collect(), df.schema)
        assert kept.columns == df.columns
        if name == "language_id":
            assert {r.doc_id for r in kept.collect()} == {r[0] for r in rows} - {22, 23} and kept.where("lang is null").count() == 0
        if name == "near_dedup":
            assert {r.doc_id for r in kept.collect()} == set(range(12)) | {24}
        if name == "pii":
            assert kept.where("doc_id = 24").first().text == "write to <EMAIL> now please"
    import tiktoken

    import public_tokenizers

    one = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(bpe.default_vocabulary()), special_tokens={})
    expected = sorted((r.doc_id, one.encode_ordinary(r.text), hashlib.sha256(r.text.encode()).hexdigest()) for r in kept.collect())
    got = p.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.ids, r.decoded_sha256) for r in got) == expected


def test_every_unit_of_chained_passages_stays(spark):
    rng = random.Random(0)
    a, both, b = sentence(rng, 60), sentence(rng, 28), sentence(rng, 60)
    texts = {1: f"{sentence(rng, 40)} {a} {both}", 2: f"{sentence(rng, 40)} {a} {both} {b} {sentence(rng, 40)}", 3: f"{both} {b} {sentence(rng, 40)}"}
    got = [r for r in passages.repeats(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect() if r.kind == "passage"]
    left, marked = {}, {}
    for i, t in texts.items():
        rows = sorted((r.start, r.end, r.removed) for r in got if r.doc_id == i)
        assert all(x[1] <= y[0] for x, y in zip(rows, rows[1:]))
        gone = {k for s, e, off in rows if off for k in range(s, e)}
        left[i], marked[i] = " ".join(w if k not in gone else "|" for k, w in enumerate(t.split())), len(gone)
    units = [" ".join(t.split()[k : k + 30]) for t in texts.values() for k in starts_of(t)]
    shared = {u for u in units if units.count(u) > 1}
    assert len(shared) >= 4 and all(any(u in x for x in left.values()) for u in shared)
    assert len({r.cluster_id for r in got}) == 1 and all(r.removed == (r.doc_id != r.first_doc) for r in got)
    assert marked[1] == 0 and marked[2] >= 30 and marked[3] >= 30


def starts_of(text):
    data = np.frombuffer(text.encode(), np.uint8)
    found = passages.windows_of(*word_hashes(data, np.array([0, len(data)])), passages.MIN_WORDS, passages.ANCHOR_WINDOW, passages.WINDOW_BANDS)
    return sorted({int(k) for _, at, _, _ in found for k in at})
