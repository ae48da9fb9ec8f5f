"""Language identification by unigrams of pieces with the segmentation summed out.

A word is the pieces of a fixed public vocabulary in some order, and a text does not say which. Each language has
a probability for every piece; the forward algorithm adds up all ways to cut a word, so no single segmentation is
preferred. The piece probabilities are fitted by expectation maximisation on a bounded sample of labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm._words import numbers
from marlstone.runtime import released, spread, table, text_batches

UNKNOWN = "und"
#: Labelled rows a language that the fit reads, by expectation; they are chosen by a hash of the id.
SAMPLE_ROWS = 500
#: Runs of more letters are summed one by one in logarithms, shorter ones of a length together as plain products.
LONG = 32
#: A text fits no language if its letters are less likely than those the model learned from by a factor of e^MARGIN each.
MARGIN = 4.0
ROUNDS = 3
FLOOR = 1e-7
CACHE_WORDS = 400_000
_RADIX = np.uint64(numbers(5, 1)[0])


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def read_pieces(path: str) -> list[str]:
    """The ordinary pieces of the vocabulary in lower case, each once; the mark at a word's start is kept."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    kinds = (model.is_control, model.is_unknown, model.is_byte, model.is_unused)
    pieces = {model.id_to_piece(i).lower() for i in range(model.get_piece_size()) if not any(k(i) for k in kinds)}
    return sorted(p for p in pieces if p.strip("▁").isalpha() and "▁" not in p[1:])


@dataclass
class Model:
    languages: list[str]
    hashes: np.ndarray  # of the pieces, sorted
    chances: np.ndarray  # of a piece in each language, plus a last row for characters outside the vocabulary
    priors: np.ndarray
    longest: int
    floor: float = float("-inf")  # the least log probability a letter, with its share of word starts, of texts that fit


def words_of(text: str | None) -> list[str]:
    """Runs of letters in lower case, whole."""
    import regex

    return regex.findall(r"\p{L}+", (text or "").lower())


def _codes(words: list[str], width: int) -> np.ndarray:
    """Code points of words of one length behind the mark of a word's start."""
    flat = np.frombuffer("".join("▁" + w for w in words).encode("utf-32-le"), dtype="<u4")
    return flat.reshape(len(words), width + 1)


def piece_hashes(pieces: list[str]) -> np.ndarray:
    out = np.zeros(len(pieces), np.uint64)
    for k, piece in enumerate(pieces):
        h = 0
        for c in piece:
            h = (h * int(_RADIX) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        out[k] = h
    return out


def _lattice(codes: np.ndarray, hashes: np.ndarray, longest: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from, to, rows, pieces) for each stretch of characters that is a piece in some rows; single characters
    outside the vocabulary count as the piece after the last."""
    n, width = codes.shape
    values = codes.astype(np.uint64) + np.uint64(1)
    for end in range(2, width + 1):
        for start in range(max(0, end - longest), end):
            if start == 1:  # the mark alone is no piece: it goes with a letter at least
                continue
            h = np.zeros(n, np.uint64)
            for j in range(start, end):
                h = h * _RADIX + values[:, j]
            at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            known = hashes[at] == h
            if end - start == 1 or start == 0 and end == 2:
                yield start, end, slice(None), np.where(known, at, len(hashes))
            elif known.any():
                rows = np.flatnonzero(known)
                yield start, end, rows, at[rows]


def _pieces_to(word: str, hashes: np.ndarray, longest: int, chunk: int = 1 << 16) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(end, lengths, pieces) for every place of one word behind the mark of its start, by the rules of _lattice."""
    values = _codes([word], len(word))[0].astype(np.uint64) + np.uint64(1)
    n = len(values)
    for low in range(0, n, chunk):
        ends = np.arange(max(low, 1) + 1, min(low + chunk, n) + 1) if low else np.arange(2, min(chunk, n) + 1)
        found = np.full((len(ends), longest), -1, np.int64)
        for length in range(1, min(longest, n) + 1):
            start = ends - length
            real = start >= 0
            h = np.zeros(int(real.sum()), np.uint64)
            for k in range(length):
                h = h * _RADIX + values[start[real] + k]
            at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            known = hashes[at] == h
            single = (length == 1) | (start[real] == 0) & (length == 2)
            found[real, length - 1] = np.where(start[real] == 1, -1, np.where(known, at, np.where(single, len(hashes), -1)))
        for end, row in zip(ends.tolist(), found):
            on = np.flatnonzero(row >= 0)
            yield end, on + 1, row[on]


def _log_forward(word: str, logs: np.ndarray, hashes: np.ndarray, longest: int) -> np.ndarray:
    """Log probability of each beginning of one word, in each language, summed over its segmentations."""
    ahead = np.full((len(word) + 2, logs.shape[1]), -np.inf)
    ahead[0] = 0.0
    for end, lengths, pieces in _pieces_to(word, hashes, longest):
        v = ahead[end - lengths] + logs[pieces]
        top = v.max(axis=0)
        ahead[end] = top + np.log(np.exp(v - top).sum(axis=0))
    return ahead


def log_chances(words: list[str], model: Model) -> np.ndarray:
    """Log probability of each word in each language, summed over all segmentations, however long the word is."""
    out = np.zeros((len(words), len(model.languages)))
    lengths = np.array([len(w) for w in words])
    for k in np.flatnonzero(lengths > LONG):
        out[k] = _log_forward(words[k], np.log(model.chances), model.hashes, model.longest)[-1]
    for width in np.unique(lengths[lengths <= LONG]):
        for rows in np.array_split(np.flatnonzero(lengths == width), max(1, (lengths == width).sum() * int(width) // 400_000)):
            codes = _codes([words[i] for i in rows], int(width))
            ahead = np.zeros((int(width) + 2, len(rows), len(model.languages)))
            ahead[0] = 1.0
            for start, end, at, piece in _lattice(codes, model.hashes, model.longest):
                ahead[end][at] += ahead[start][at] * model.chances[piece]
            # no product of LONG floors is too small for a double
            out[rows] = np.log(ahead[int(width) + 1])
    return out


def _long_counts(word: str, weight: float, p: np.ndarray, hashes: np.ndarray, longest: int) -> np.ndarray:
    """Expected uses of every piece in one long word."""
    logs = np.log(p)
    ahead = _log_forward(word, logs[:, None], hashes, longest)[:, 0]
    back = np.full(len(ahead), -np.inf)
    back[-1] = 0.0
    seen = np.zeros(len(p))
    for end, lengths, pieces in reversed(list(_pieces_to(word, hashes, longest))):
        v = logs[pieces] + back[end]
        back[end - lengths] = np.logaddexp(back[end - lengths], v)
        np.add.at(seen, pieces, weight * np.exp(ahead[end - lengths] + v - ahead[-1]))
    return seen


def fit(counts: pd.DataFrame, pieces: list[str], priors: dict[str, float], rounds: int = ROUNDS) -> Model:
    """`counts` (lang, word, n) to a model. Languages without words get the priors alone."""
    hashes = piece_hashes(pieces)
    order = np.argsort(hashes)
    hashes, names = hashes[order], [pieces[i] for i in order]
    longest = max(map(len, names))
    languages = sorted(priors)
    chances = np.full((len(hashes) + 1, len(languages)), FLOOR)
    for j, lang in enumerate(languages):
        own = counts[counts.lang == lang]
        words, weight = own.word.tolist(), own.n.to_numpy(float)
        lengths = np.array([len(w) for w in words], dtype=int)
        p = np.full(len(hashes) + 1, 1.0 / (len(hashes) + 1))
        for _ in range(rounds if len(words) else 0):
            seen = np.full(len(hashes) + 1, 0.01)
            for k in np.flatnonzero(lengths > LONG):
                seen += _long_counts(words[k], weight[k], p, hashes, longest)
            for width in np.unique(lengths[lengths <= LONG]):
                rows = np.flatnonzero(lengths == width)
                codes, n = _codes([words[i] for i in rows], int(width)), int(width) + 1
                arcs = list(_lattice(codes, hashes, longest))
                ahead, back = np.zeros((n + 1, len(rows))), np.zeros((n + 1, len(rows)))
                ahead[0], back[n] = 1.0, 1.0
                for s, e, at, piece in arcs:
                    ahead[e][at] += ahead[s][at] * p[piece]
                for s, e, at, piece in sorted(arcs, key=lambda a: -a[0]):
                    back[s][at] += back[e][at] * p[piece]
                per = weight[rows] / ahead[n]
                for s, e, at, piece in arcs:
                    seen += np.bincount(piece, ahead[s][at] * p[piece] * back[e][at] * per[at], minlength=len(seen))
            p = np.maximum(seen / seen.sum(), FLOOR)
        chances[:, j] = np.maximum(p, FLOOR)
    prior = np.array([priors[x] for x in languages], float)
    model = Model(languages, hashes, chances, np.log(prior / prior.sum()) if len(prior) else prior, longest)
    fits = []
    for j, lang in enumerate(languages):
        own = counts[counts.lang == lang]
        if len(own):
            fits.append(float((log_chances(own.word.tolist(), model)[:, j] * own.n).sum() / (own.word.str.len() * own.n).sum()))
    model.floor = min(fits, default=float("-inf")) - MARGIN
    return model


def remainder(doc_id: Column, by: int) -> Column:
    """crc32 of the id as text, modulo `by`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % by


def train(labelled: DataFrame, vocabulary: str | None = None, sample_rows: int = SAMPLE_ROWS, rounds: int = ROUNDS) -> Model:
    """A model from rows (doc_id, text, lang) with non-null lang. About `sample_rows` whole texts of a language are
    read, those with the smallest id hashes; their distinct words with counts go to the driver, and no more."""
    rows = labelled.where("lang is not null").select("doc_id", "text", "lang")
    sizes = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, sample_rows / n))]) if sizes else None
    draw = (F.xxhash64(F.lit("langid"), "doc_id") / F.lit(2.0**64)) + F.lit(0.5)

    def count(batches):
        from collections import Counter

        seen: Counter = Counter()
        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1).to_pylist()):
                seen.update((lang, w) for w in words_of(text.as_py()))
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], names=["lang", "word", "n"])

    sampled = rows.where(draw < share[F.col("lang")]) if sizes else rows
    counts = sampled.select("text", "lang").mapInArrow(released(count), "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    # Longs summed by Spark and sorted here: the fit does not depend on the order in which tasks end.
    found = counts.toPandas().sort_values(["lang", "word"])
    return fit(found, read_pieces(vocabulary or default_vocabulary()), sizes, rounds)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """`docs` with lang_pred, score and fit appended, one row each.

    lang_pred is a language of the model, or `und` with score 0 where text is null, has no letter, or the model has
    no language. score is the probability of the prediction given the text; ties go to the first by code point. fit is the
    mean log probability of a letter in that language (null with `und`): below model.floor the text is in none of them.
    Only text is looked at, all of it. Repeated rows keep one row each; null ids stay; an empty table gives no rows.
    Columns named lang_pred, score or fit are replaced.
    """
    columns = [c for c in docs.columns if c not in ("lang_pred", "score", "fit")]
    kept = docs.select(*columns)
    text_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, number, known = shared.value, {}, np.zeros((0, len(shared.value.languages)))
        for batch in batches:
            seqs, fresh, lone, letters = [], [], [], []
            if len(number) > CACHE_WORDS:
                number, known = {}, known[:0]
            for text in batch.column(place):
                seq, long, size = [], np.zeros(len(model.languages)), 0
                for w in words_of(text.as_py()):
                    size += len(w)
                    if len(w) > LONG:  # not remembered: it may be of any size
                        long += log_chances([w], model)[0]
                        continue
                    k = number.get(w)
                    if k is None:
                        k = number[w] = len(number)
                        fresh.append(w)
                    seq.append(k)
                seqs.append(np.array(seq, dtype=np.int32))
                lone.append(long)
                letters.append(size)
            if fresh:
                known = np.concatenate([known, log_chances(fresh, model)])
            labels, scores, fits = [], [], []
            for seq, long, size in zip(seqs, lone, letters):
                if not size or not model.languages:
                    labels.append(UNKNOWN)
                    scores.append(0.0)
                    fits.append(None)
                    continue
                words = known[seq].sum(axis=0) + long
                logs = words + model.priors
                best = int(np.argmax(logs))
                labels.append(model.languages[best])
                scores.append(float(1.0 / np.exp(logs - logs[best]).sum()))
                fits.append(float(words[best] / size))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(labels, pa.string()), pa.array(scores, pa.float64()), pa.array(fits, pa.float64())], names=[*columns, "lang_pred", "score", "fit"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema), "lang_pred string, score double, fit double"])
    return kept.mapInArrow(released(run), schema)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of `documents`, told by a model of those that are not held out; null and letterless texts are `und`, a null id
    counts as the empty text in the split, an empty table gives no rows."""
    docs = spread(table(spark, sf_dir, "documents"))
    held_out = remainder(F.col("doc_id"), 4) == 2
    model = train(docs.where(~held_out))
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "fit")
