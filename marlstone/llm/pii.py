"""Personal data by a skip-chain conditional random field.

Patterns with checks find the base spans. They and looser candidates (numbers with seven digits or more, address-like
words) are the nodes of a document's graph. Neighbours are linked as a chain; mentions of the same or a similar thing (the
same closing digits, the same mailbox name but for its signs), however far apart, are linked to one hub by skip edges that
share a potential; a hub whose mentions hold base spans carries their labels, so that each repeat is one edge from them.
Loopy message passing over both kinds of edges, until no message changes, labels the candidates consistently with the base
spans, which are fixed.

The field is fitted in two steps. Counts over all documents give the weights and potentials to start from. Then the
likelihood of what is known (base spans, and candidates that failed a check, which are nothing) is raised on a bounded
sample of documents, through the field itself: its gradient is what message passing expects of each weight with the known
labels held, less what it expects with all of them free.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.runtime import released, spread, table, text_batches

KINDS = ("email", "ip", "card", "phone")
OTHER = len(KINDS)
LABELS = len(KINDS) + 1
#: Documents with mentions on which the likelihood is raised, by expectation; chosen by a hash of the id, read whole.
SAMPLE_DOCS = 2_000
#: Gradient steps, their size, and how strongly weights are held to the counted ones.
STEPS, RATE, HOLD = 30, 0.1, 0.02
#: Messages that change less than this have stopped.
STILL = 1e-6
#: After so many sweeps ever smaller steps are taken, so that messages that would swing for ever stop too.
FREE_SWEEPS = 200
SURE = 0.7

_ANY = re.compile(r"[0-9@]").search
_LOCAL_SET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# Digits before a number cannot begin another match of it, so both patterns may start only at a run's first digit,
# and giving back digits cannot help them, so they need not try.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NUMBER = re.compile(r"(?<![0-9A-Za-z+])\(?[0-9](?:[\x20().-]{0,2}[0-9]){6,}+(?![0-9A-Za-z])")
_PART = re.compile(r"[^\x20]+")
_NAME = re.compile(r"(?<![A-Za-z0-9._%+@-])[A-Za-z0-9._%+-]{3,}+(?!@)")
_CUES = (("mail", "e-mail", "email", "contact"), ("ip", "host", "server", "address"), ("card", "visa", "credit"), ("phone", "tel", "call", "fax", "mobile"))


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k & 1:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _letters(name: str) -> str:
    return "".join(c for c in name.lower() if c.isalnum())


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """The leftmost, non-overlapping addresses, in time linear in the text: a mailbox name holds no @, so each @ has
    only the characters before it, back to the last match, to start from."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_SET:
            start -= 1
        found = start < at and _DOMAIN.match(text, at + 1)
        if found:
            done = found.end()
            yield start, done
            at = text.find("@", done)
        else:
            done = max(done, at)
            at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the patterns' matches that pass their checks, by kind and start."""
    if not text or not _ANY(text):
        return []
    out = [(0, s, e) for s, e in _emails(text)]
    out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        d = _digits(m[0])
        if 13 <= len(d) <= 19 and luhn(d):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


def _pattern(text: str, s: int, e: int) -> int:
    """Features of a mention as bits. None of them says that a base pattern matched."""
    t = text[s:e]
    d = _digits(t)
    n = len(d)
    before = re.split(r"[^a-z-]+", text[max(0, s - 24) : s].lower())[-3:]
    bits = [
        n == 0, 1 <= n <= 6, 7 <= n <= 8, 9 <= n <= 12, 13 <= n <= 15, 16 <= n <= 19, n > 19,
        "@" in t, t.startswith("+"), "(" in t, "-" in t, " " in t, t.count(".") == 3, t.count(".") in (1, 2),
        any(c.isalpha() for c in t), 13 <= n <= 19 and luhn(d), *(any(w in cue for w in before) for cue in _CUES),
    ]
    return sum(1 << k for k, on in enumerate(bits) if on)


BITS = 20


@dataclass
class Graph:
    nodes: list[tuple[int, int, int, bool]]  # label or OTHER, start, end, base
    patterns: list[int]
    chain: list[tuple[int, int]]
    skip: list[tuple[int, int]]  # each mention and the one before it of the same key; they are counted for the fit
    hubs: list[tuple[int, ...]]  # all mentions of a key
    failed: list[bool]  # candidates whose shape a base pattern has, but not its checks


def graph(text: str | None) -> Graph | None:
    """The candidates of a text and their links; None without any."""
    if not text or not _ANY(text):
        return None
    base = base_spans(text)
    taken = sorted((s, e) for _, s, e in base)
    nodes = [(k, s, e, True) for k, s, e in base]
    merged: list[list[int]] = []
    for s, e in taken:
        if merged and s < merged[-1][1]:
            merged[-1][1] = max(e, merged[-1][1])
        else:
            merged.append([s, e])
    starts = [s for s, _ in merged]

    def free(s: int, e: int) -> bool:
        at = int(np.searchsorted(starts, e)) if len(starts) > 8 else sum(x < e for x in starts)
        return at == 0 or merged[at - 1][1] <= s

    failed = {}
    for m in _NUMBER.finditer(text):
        # More digits than any number has: several numbers in a row.
        parts = _PART.finditer(text, m.start(), m.end()) if len(_digits(m[0])) > 19 else (m,)
        for part in parts:
            if len(_digits(part[0])) >= 7 and free(part.start(), part.end()):
                nodes.append((OTHER, part.start(), part.end(), False))
                failed[part.start()] = part is m and (13 <= len(_digits(m[0])) <= 19 or m[0].count(".") == 3)
    if any(k == 0 for k, *_ in base):
        for m in _NAME.finditer(text):
            t = m[0].strip(".-%+_")
            if len(t) < 3 or not any(c in "0123456789._%+-" for c in t) or not any(c.isalpha() for c in t):
                continue
            s = m.start() + m[0].index(t)
            if free(s, s + len(t)):
                nodes.append((OTHER, s, s + len(t), False))
    if not nodes:
        return None
    nodes.sort(key=lambda x: (x[1], x[2], x[0]))
    chain = [(i, i + 1) for i in range(len(nodes) - 1)]
    same: dict[tuple, list[int]] = {}
    for i, (k, s, e, is_base) in enumerate(nodes):
        t = text[s:e]
        if "@" in t and k == 0:
            keys = [("name", t.split("@")[0].lower()), ("plain", _letters(t.split("@")[0]))]
        elif k == 1:
            keys = [("ip", t)]
        elif any(c.isalpha() for c in t):
            keys = [("name", t.lower()), ("plain", _letters(t))]
        else:
            keys = [("digits", _digits(t)[-9:] if len(_digits(t)) >= 9 else _digits(t)), ("digits", _digits(t)[-7:])]
        for key in dict.fromkeys(keys):
            same.setdefault(key, []).append(i)
    hubs = list(dict.fromkeys(tuple(own) for own in same.values() if len(own) > 1))
    skip = list(dict.fromkeys(pair for own in hubs for pair in zip(own, own[1:])))
    return Graph(nodes, [_pattern(text, s, e) for _, s, e, _ in nodes], chain, skip, hubs, [failed.get(s, False) for _, s, _, _ in nodes])


@dataclass
class Model:
    weights: np.ndarray  # (bits + 1) x labels
    chain: np.ndarray  # log potentials, labels x labels
    skip: np.ndarray


def fit(patterns: dict[tuple[int, int], int], pairs: dict[tuple[str, int, int], int]) -> Model:
    """Counts of (pattern, label) and of (edge kind, label, label) to a model.

    The mentions' weights are a softmax regression on the labelled nodes: base spans, and candidates that failed a
    check, which are nothing. Edge potentials are log ratios of the pair counts to independence, smoothed; the skip
    edges' smoothing expects agreement nine times in ten.
    """
    keys = sorted(patterns)
    x = np.array([[(p >> k) & 1 for k in range(BITS)] + [1] for p, _ in keys], float).reshape(len(keys), BITS + 1)
    y = np.eye(LABELS)[[label for _, label in keys]] if keys else np.zeros((0, LABELS))
    n = np.sqrt(np.array([patterns[k] for k in keys], float)) if keys else np.zeros(0)
    w = np.zeros((BITS + 1, LABELS))
    for _ in range(400 if len(keys) else 0):
        z = x @ w
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        w -= 0.5 * (x.T @ ((p - y) * n[:, None]) / n.sum() + 0.01 * w)

    def potential(kind: str, prior: np.ndarray) -> np.ndarray:
        c = prior.copy()
        for (k, a, b), m in pairs.items():
            if k == kind:
                c[a, b] += m
                c[b, a] += m
        c = c / c.sum()
        return np.log(c / np.outer(c.sum(axis=1), c.sum(axis=0)))

    agree = np.full((LABELS, LABELS), 0.1 / (LABELS - 1)) + np.eye(LABELS) * (0.9 - 0.1 / (LABELS - 1))
    return Model(w, np.clip(potential("chain", np.ones((LABELS, LABELS))), -1, 1), np.clip(potential("skip", agree * 50), -6, 6))


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, steps: int = STEPS) -> Model:
    """A model of `docs` (doc_id, text): counts of patterns and of label pairs over all texts, whose number the features
    bound, then `steps` gradient steps on about `sample_docs` whole texts with mentions, chosen by a hash of the id. Null
    and empty texts say nothing; repeated rows count as often as they are there; an empty table gives the priors."""
    text_batches(docs.sparkSession)

    def count(batches):
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                g = graph(text.as_py())
                if g is None:
                    continue
                seen["text", 0, 0] += 1
                known = [b or f for (_, _, _, b), f in zip(g.nodes, g.failed)]
                for (k, *_), p, on in zip(g.nodes, g.patterns, known):
                    if on:
                        seen["node", p, k] += 1
                for kind, edges in (("chain", g.chain), ("skip", g.skip)):
                    for a, b in edges:
                        if known[a] and known[b]:
                            seen[kind, g.nodes[a][0], g.nodes[b][0]] += 1
        keys = list(seen)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int64()), pa.array([k[2] for k in keys], pa.int64()), pa.array([seen[k] for k in keys], pa.int64())], names=["what", "a", "b", "n"])

    rows = docs.select("text").mapInArrow(released(count), "what string, a long, b long, n long").groupBy("what", "a", "b").agg(F.sum("n").alias("n")).collect()
    model = fit({(r.a, r.b): r.n for r in rows if r.what == "node"}, {(r.what, r.a, r.b): r.n for r in rows if r.what in ("chain", "skip")})
    share = min(1.0, sample_docs / max(1, sum(r.n for r in rows if r.what == "text")))
    draw = F.xxhash64(F.lit("pii"), "doc_id", "text") / F.lit(2.0**64) + F.lit(0.5)

    def with_mentions(batches):
        for batch in batches:
            yield batch.filter(pa.array([graph(t.as_py()) is not None for t in batch.column(0)], pa.bool_()))

    drawn = docs.where((draw < share) & F.col("text").rlike("[0-9@]")).select("text")
    texts = sorted(r.text for r in drawn.mapInArrow(released(with_mentions), "text string").collect())
    return raise_likelihood([graph(t) for t in texts], model, steps)


def raise_likelihood(graphs: list[Graph], model: Model, steps: int = STEPS, rate: float = RATE, hold: float = HOLD) -> Model:
    """The model after gradient steps on the log likelihood of the known labels of `graphs`, held to where it began."""
    known = [[n[3] or f for n, f in zip(g.nodes, g.failed)] for g in graphs]
    total = sum(map(sum, known))
    if not total or not steps:
        return model
    start = [model.weights, model.chain, model.skip]
    now = [x.copy() for x in start]
    first, second = [np.zeros_like(x) for x in now], [np.zeros_like(x) for x in now]
    for step in range(1, steps + 1):
        held, free = (expected(graphs, Model(*now), k) for k in (known, None))
        for i in range(3):
            g = (held[i] - free[i]) / total - hold * (now[i] - start[i])
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.99 * second[i] + 0.01 * g * g
            now[i] = now[i] + rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.99**step)) + 1e-8) * np.minimum(1, np.abs(g) * 1e3)
    return Model(*now)


@dataclass
class Field:
    """All nodes of some graphs, their hubs after them, and all edges; what message passing runs on."""

    bits: np.ndarray
    unary: np.ndarray
    edges: np.ndarray  # a, b, kind (0 chain, 1 skip), graph
    graphs: int


def _field(graphs: list[Graph], model: Model, known: list[list[bool]] | None, free_hubs: bool) -> Field:
    """The field with the labels that `known` marks held. With free_hubs every mention has its edge to its hubs; without,
    the hub carries the known labels of its mentions itself, as what is held needs no message."""
    sizes = np.cumsum([0] + [len(g.nodes) for g in graphs])
    patterns = np.array([p for g in graphs for p in g.patterns], dtype=np.int64)
    bits = ((patterns[:, None] >> np.arange(BITS)) & 1).astype(float)
    bits = np.concatenate([bits, np.ones((len(bits), 1))], axis=1)
    unary = bits @ model.weights
    held = [(sizes[k] + i, node[0]) for k, g in enumerate(graphs) for i, node in enumerate(g.nodes) if known is not None and known[k][i]]
    if held:
        rows, labels = np.array(held).T
        unary[rows] = -50.0
        unary[rows, labels] = 0.0
    edges = [(sizes[k] + a, sizes[k] + b, 0, k) for k, g in enumerate(graphs) for a, b in g.chain]
    hubs = []
    for k, g in enumerate(graphs):
        for own in g.hubs:
            told = [] if free_hubs or known is None else [g.nodes[i][0] for i in own if known[k][i]]
            if told and len(told) == len(own):
                continue
            edges += [(len(unary) + len(hubs), sizes[k] + i, 1, k) for i in own if free_hubs or not known[k][i]]
            share = np.bincount(told, minlength=LABELS) / len(told) if told else np.ones(LABELS)
            hubs.append(np.log(np.maximum(share, np.exp(-50.0))))
    unary = np.concatenate([unary, np.array(hubs).reshape(-1, LABELS)])
    return Field(bits, unary - unary.max(axis=1, keepdims=True), np.array(edges, np.int64).reshape(-1, 4), len(graphs))


def _pass(field: Field, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Beliefs of all nodes and of all edges (a's label, b's label) by loopy message passing on all graphs at once. Each
    graph is swept until its own messages stop changing, whatever others it is passed with."""
    a, b, kind, of = field.edges.T
    m = len(a)
    source, target, of = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([of, of])
    potential = np.exp(np.stack([model.chain, model.skip])[np.concatenate([kind, kind])])
    logs = np.zeros((2 * m, LABELS))
    back = np.concatenate([np.arange(m, 2 * m), np.arange(m)])
    on, step, sweep = np.arange(2 * m), 0.5, 0

    def gathered() -> np.ndarray:
        total = field.unary.copy()
        np.add.at(total, target, logs)
        return total

    while len(on):
        total = field.unary.copy()
        np.add.at(total, target[on], logs[on])
        out = total[source[on]] - logs[back[on]]
        out = np.exp(out - out.max(axis=1, keepdims=True))
        new = np.log(np.maximum(np.einsum("ei,eij->ej", out, potential[on]), 1e-30))
        new -= new.max(axis=1, keepdims=True)
        moved = step * (new - logs[on])
        logs[on] += moved
        change = np.zeros(field.graphs)
        np.maximum.at(change, of[on], np.abs(moved).max(axis=1))
        on = on[change[of[on]] >= STILL]
        sweep += 1
        step *= 0.9 if sweep > FREE_SWEEPS else 1
    total = gathered()
    p = np.exp(total - total.max(axis=1, keepdims=True))
    both = (total[a] - logs[m:])[:, :, None] + (total[b] - logs[:m])[:, None, :] + np.log(potential[:m])
    q = np.exp(both - both.max(axis=(1, 2), keepdims=True))
    return p / p.sum(axis=1, keepdims=True), q / q.sum(axis=(1, 2), keepdims=True)


def expected(graphs: list[Graph], model: Model, known: list[list[bool]] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What the field expects of every weight and potential, with the labels that `known` marks held. The potentials are
    symmetric, and so are their sums."""
    field = _field(graphs, model, known, True)
    p, q = _pass(field, model)
    kind = field.edges[:, 2]
    pairs = [q[kind == k].sum(axis=0) for k in (0, 1)]
    return field.bits.T @ p[: len(field.bits)], *((x + x.T) / 2 for x in pairs)


def beliefs(graphs: list[Graph], model: Model) -> np.ndarray:
    """Label probabilities of all nodes of all graphs, base spans being held."""
    field = _field(graphs, model, [[n[3] for n in g.nodes] for g in graphs], False)
    return _pass(field, model)[0][: len(field.bits)]


def label(texts: list[str | None], model: Model, sure: float = SURE) -> list[list[tuple[int, int, int, bool]]]:
    """(kind, start, end, base) of each text, by kind, start and end. Base spans always stay."""
    graphs = [graph(t) for t in texts]
    there = [g for g in graphs if g is not None]
    p = beliefs(there, model) if there else np.zeros((0, LABELS))
    out, at = [], 0
    for g in graphs:
        found = []
        if g is not None:
            for i, (k, s, e, is_base) in enumerate(g.nodes):
                best = int(np.argmax(p[at + i]))
                if is_base:
                    found.append((k, s, e, True))
                elif best != OTHER and p[at + i, best] >= sure:
                    found.append((best, s, e, False))
            at += len(g.nodes)
        out.append(sorted(found))
    return out


def redacted(text: str, spans: list[tuple[int, int, int, bool]]) -> str:
    """The text with each span, or run of overlapping spans, replaced by the kind of its first."""
    parts, done = [], 0
    for k, s, e, _ in sorted(spans, key=lambda x: (x[1], x[2])):
        if s >= done:
            parts += [text[done:s], f"<{KINDS[k].upper()}>"]
        done = max(done, e)
    return "".join([*parts, text[done:]])


SPANS = "array<struct<kind:string,start:int,end:int,base:boolean>>"


def find(docs: DataFrame, model: Model, sure: float = SURE) -> DataFrame:
    """doc_id and spans (kind, start, end in code points, base) of every row of `docs` (doc_id, text), by kind as in
    KINDS, then start. Null text counts as empty; texts without candidates have an empty array; repeated rows keep one
    row each; an empty table gives none. Other columns are not read."""
    text_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())])
        for batch in batches:
            spans = label(batch.column(1).to_pylist(), shared.value, sure)
            rows = [[{"kind": KINDS[k], "start": s, "end": e, "base": b} for k, s, e, b in own] for own in spans]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(kind))], names=["doc_id", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(released(run), f"doc_id {kind}, spans {SPANS}")


def redact(docs: DataFrame, model: Model, sure: float = SURE) -> DataFrame:
    """`docs` with its columns as they are, but every span of text replaced by its kind and n_chars, if there, set anew.
    Null text stays null; repeated rows and null ids stay; an empty table gives no rows. Other columns may have any name."""
    text_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(place).to_pylist()
            new = [t if not own else redacted(t, own) for t, own in zip(texts, label(texts, shared.value, sure))]
            columns = list(batch.columns)
            columns[place] = pa.array(new, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    out = docs.mapInArrow(released(run), docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def _is(kind: str):
    return lambda span: span["kind"] == kind


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of `documents`, a row each; null texts have no spans, an empty table gives no rows."""
    docs = spread(table(spark, sf_dir, "documents"))
    found = find(docs, train(docs))
    base = F.filter("spans", lambda s: s["base"])
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.select(
        "doc_id",
        *[F.size(F.filter(base, _is(k))).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: ~s["base"])).cast("long").alias("n_added"),
    )
