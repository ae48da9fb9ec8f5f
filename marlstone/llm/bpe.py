"""Byte-level BPE over a corpus: every distinct pre-token is encoded once.

1. Each task cuts its documents into pre-tokens and numbers the distinct ones of a block (some 16 million
   characters), frequent ones first. A document is kept as its sequence of numbers, which is its pre-tokens with
   positions.
2. The words are dealt over the cluster by their hash. A block sends each of its words once, so a frequent word is no
   hot key, and what a block sends to one bucket travels as one compressed row. A bucket has all the uses of its words:
   it makes them distinct, encodes each once by the merges below and answers every block. The number of buckets grows
   with the corpus, so that a bucket's distinct words fit in memory.
3. Ids go back by block, in the order of the words, and meet the sequences there. A block is bounded, however large
   the corpus is.

Decoding joins the fixed token-byte table, one entry a token, with the ids by position.
"""

from __future__ import annotations

import base64
import heapq
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.runtime import release, released, spread, store_bucketed, table, text_batches

BLOCK_CHARS = 16_000_000
#: Characters for which one more bucket of words is made: a bucket has far fewer distinct words.
BUCKET_CHARS = 16_000_000
#: Pre-tokens packed together.
PACK_TOKENS = 1 << 17
#: Words of more bytes are merged with a heap.
SHORT = 48


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def read_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary: a line holds a token in base64 and its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one pre-token: of all neighbouring parts, single bytes at first, the pair with the lowest rank becomes
    one part, the first of equals, until no pair is in the vocabulary."""
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    if len(word) > SHORT:
        return _merge_long(word, ranks)
    none = 1 << 62
    parts = [word[i : i + 1] for i in range(len(word))]
    pairs = [ranks.get(word[i : i + 2], none) for i in range(len(word) - 1)]
    while pairs:
        low = min(pairs)
        if low == none:
            break
        i = pairs.index(low)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del pairs[i]
        if i:
            pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
        if i < len(pairs):
            pairs[i] = ranks.get(parts[i] + parts[i + 1], none)
    return [ranks[p] for p in parts]


def _merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """As `merge`, in time n log n: parts are the stretches from a start to the start of the next one."""
    n = len(word)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    queue = [(rank, i, i + 2) for i in range(n - 1) if (rank := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(queue)
    while queue:
        _, i, end = heapq.heappop(queue)
        middle = after[i]
        # taken into another part since, or grown
        if middle < 0 or middle >= n or after[middle] != end:
            continue
        after[i], after[middle] = end, -1
        if end < n:
            before[end] = i
            if (rank := ranks.get(word[i : after[end]])) is not None:
                heapq.heappush(queue, (rank, i, after[end]))
        if before[i] >= 0 and (rank := ranks.get(word[before[i] : end])) is not None:
            heapq.heappush(queue, (rank, before[i], end))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : after[i]]])
        i = after[i]
    return out


def _pack(numbers: np.ndarray) -> bytes:
    """The numbers' byte planes, the low bytes first and as many as the largest needs, compressed; how long they are and
    their number stand in front."""
    planes = max(1, (int(numbers.max(initial=0)).bit_length() + 7) // 8)
    raw = numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T[:planes].tobytes()
    return struct.pack("<QB", len(raw), planes) + pa.compress(raw, codec="zstd", asbytes=True)


def _unpack(packed: bytes) -> np.ndarray:
    size, planes = struct.unpack_from("<QB", packed)
    raw = np.frombuffer(pa.decompress(packed[9:], size, codec="zstd", asbytes=True), dtype=np.uint8).reshape(planes, -1)
    out = np.zeros(raw.shape[1], np.uint32)
    for k in range(planes):
        out |= raw[k].astype(np.uint32) << (8 * k)
    return out


def _squeeze(raw: bytes) -> bytes:
    return struct.pack("<I", len(raw)) + pa.compress(raw, codec="zstd", asbytes=True)


def _expand(packed: bytes) -> bytes:
    return pa.decompress(packed[4:], struct.unpack_from("<I", packed)[0], codec="zstd", asbytes=True)


#: Three kinds of rows. Words: block, bucket, data (words after their lengths). Order: block, data (the numbers of the
#: words as the buckets have them). Documents: block, place, ids of the rows, number of pre-tokens of each, data.
BLOCK_SCHEMA = "kind string, block long, bucket int, place int, ids array<long>, sizes array<int>, data binary"


def _rows(kind: str, block: int, bucket=None, place=None, ids=None, sizes=None, data=None) -> pa.RecordBatch:
    n = len(data)
    none = lambda x, t: pa.nulls(n, t) if x is None else pa.array(x, t)
    return pa.RecordBatch.from_arrays(
        [pa.array([kind] * n), pa.array([block] * n, pa.int64()), none(bucket, pa.int32()), none(place, pa.int32()), none(ids, pa.list_(pa.int64())), none(sizes, pa.list_(pa.int32())), pa.array(data, pa.binary())],
        names=["kind", "block", "bucket", "place", "ids", "sizes", "data"],
    )


def _blocks(pattern: str, block_chars: int, buckets: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from zlib import crc32

        import regex
        from pyspark import TaskContext

        find = regex.compile(pattern).findall
        block, chars, number, docs = TaskContext.get().partitionId() << 20, 0, {}, []

        def flush():
            words = [w.encode() for w in number]
            seqs = [s for _, s in docs]
            flat = np.concatenate(seqs) if seqs else np.zeros(0, np.uint32)
            by_use = np.argsort(-np.bincount(flat, minlength=len(words)), kind="stable")
            rank = np.empty(len(words), np.uint32)
            rank[by_use] = np.arange(len(words), dtype=np.uint32)
            home = np.array([crc32(w) % buckets for w in words], dtype=np.int64)
            order = sorted(range(len(words)), key=words.__getitem__)
            order = np.array(order, dtype=np.int64)
            order = order[np.argsort(home[order], kind="stable")]
            found, cuts = np.unique(home[order], return_index=True)
            data = []
            for part in np.split(order, cuts[1:]) if len(order) else []:
                own = [words[i] for i in part]
                data.append(_squeeze(struct.pack("<I", len(own)) + np.array([len(w) for w in own], dtype="<u4").tobytes() + b"".join(own)))
            if data:
                yield _rows("words", block, bucket=found.astype(np.int32), data=data)
            del words, data
            yield _rows("order", block, data=[_pack(rank[order])])
            at, place = 0, 0
            while at < len(docs):
                to, n = at, 0
                while to < len(docs) and (to == at or n + len(seqs[to]) <= PACK_TOKENS):
                    n += len(seqs[to])
                    to += 1
                yield _rows("docs", block, place=[place], ids=[[d for d, _ in docs[at:to]]], sizes=[[len(s) for s in seqs[at:to]]], data=[_pack(rank[np.concatenate(seqs[at:to])] if n else np.zeros(0, np.uint32))])
                at, place = to, place + 1

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py() or ""
                if chars and (chars + len(text) > block_chars or len(number) > 1 << 22):
                    yield from flush()
                    block, chars, number, docs = block + 1, 0, {}, []
                docs.append((doc_id, np.array([number.setdefault(w, len(number)) for w in find(text)], dtype=np.uint32)))
                chars += len(text)
        if docs:
            yield from flush()

    return cut


def _encoder(ranks):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows come by bucket, and a word has one bucket, so what is known of the last one is of no more use
        bucket, known = None, {}
        for batch in batches:
            out = []
            for own, data in zip(batch.column(0).to_pylist(), batch.column(2)):
                if own != bucket:
                    bucket, known = own, {}
                raw = _expand(data.as_py())
                n = struct.unpack_from("<I", raw)[0]
                ends = np.cumsum(np.frombuffer(raw, "<u4", n, 4), dtype=np.int64) + 4 + 4 * n
                at, ids = 4 + 4 * n, []
                for end in ends.tolist():
                    word = raw[at:end]
                    at = end
                    code = known.get(word)
                    if code is None:
                        code = known[word] = merge(word, ranks.value)
                    ids.append(code)
                sizes = np.array([len(x) for x in ids], dtype="<u4")
                flat = np.fromiter((i for x in ids for i in x), dtype="<u4", count=int(sizes.sum()))
                out.append(struct.pack("<I", n) + _squeeze(sizes.view(np.uint8).reshape(-1, 4).T.tobytes() + flat.view(np.uint8).reshape(-1, 4).T.tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(0), pa.array(out, pa.binary())], names=["block", "bucket", "ids"])

    return encode


def _planes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _assemble(words: pa.Table, docs: pa.Table) -> pa.Table:
    try:
        return _assembled(words, docs)
    finally:
        release()


def _assembled(words: pa.Table, docs: pa.Table) -> pa.Table:
    words = words.sort_by("bucket")
    sizes, flat = [np.zeros(0, np.uint32)], [np.zeros(0, np.uint32)]
    for data in words.column("ids").to_pylist():
        n = struct.unpack_from("<I", data)[0]
        raw = _expand(data[4:])
        sizes.append(_planes(raw[: 4 * n]))
        flat.append(_planes(raw[4 * n :]))
    sizes, flat = np.concatenate(sizes).astype(np.int64), np.concatenate(flat).astype(np.int32)
    begin = np.cumsum(sizes) - sizes
    kinds = docs.column("kind").to_pylist()
    numbers = _unpack(docs.column("data")[kinds.index("order")].as_py())
    size_of, begin_of = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    size_of[numbers], begin_of[numbers] = sizes, begin
    doc_ids, out, lengths = [], [np.zeros(0, np.int32)], []
    for kind, ids, counts, data in zip(kinds, docs.column("ids").to_pylist(), docs.column("sizes").to_pylist(), docs.column("data")):
        if kind != "docs":
            continue
        seq = _unpack(data.as_py())
        n = size_of[seq]
        ends = np.cumsum(n)
        out.append(flat[np.arange(int(ends[-1]) if len(seq) else 0) + np.repeat(begin_of[seq] - (ends - n), n)])
        upto = np.concatenate([[0], ends])
        lengths.append(np.diff(upto[np.concatenate([[0], np.cumsum(counts)])]))
        doc_ids += ids
    offsets = np.concatenate([[0], np.cumsum(np.concatenate(lengths))])
    return pa.table({"doc_id": pa.array(doc_ids, pa.int64()), "ids": pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(np.concatenate(out)))})


def encode(docs: DataFrame, vocabulary: str | None = None, pattern: str | None = None, block_chars: int = BLOCK_CHARS, bucket_chars: int = BUCKET_CHARS) -> DataFrame:
    """doc_id and ids (array of int) for every row of `docs` (doc_id, text).

    Null text counts as empty and has no ids. Repeated rows and ids keep one row each; a null doc_id stays
    null. An empty table gives none. Only the two columns are read, so others may have any name. No special
    tokens are made: their strings are ordinary text.
    """
    spark = docs.sparkSession
    pattern = pattern or default_pattern()
    ranks = spark.sparkContext.broadcast(read_ranks(vocabulary or default_vocabulary()))
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    text_batches(spark)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = max(partitions, -(-chars // bucket_chars))
    # A block's rows are one task's, so they lie in one bucket of the table, and the sequences need no shuffle later. With
    # the blocks the buckets grow, so that each holds a few blocks only.
    cut = store_bucketed(docs.mapInArrow(released(_blocks(pattern, block_chars, buckets)), BLOCK_SCHEMA), "bpe_blocks", "block", max(partitions, -(-chars // (4 * block_chars))))
    words = cut.where("kind = 'words'").select("bucket", "block", "data")
    coded = words.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(released(_encoder(ranks)), "block long, bucket int, ids binary")
    seqs = cut.where("kind <> 'words'").select("block", "kind", "place", "ids", "sizes", "data")
    return coded.groupBy("block").cogroup(seqs.groupBy("block")).applyInArrow(_assemble, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """`encoded` (doc_id, ids) with a binary column `decoded`, the bytes of the ids in order; null ids decode to
    nothing. An id outside the vocabulary is an error."""
    by_id = {i: token for token, i in read_ranks(vocabulary or default_vocabulary()).items()}
    tokens = encoded.sparkSession.sparkContext.broadcast([by_id.get(i) for i in range(max(by_id) + 1)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take = np.array(tokens.value, dtype=object)
        for batch in batches:
            ids = batch.column(1)
            flat = ids.values.to_numpy(zero_copy_only=False)
            offsets = ids.offsets.to_numpy()
            texts = [b"".join(take[flat[a:b]].tolist()) for a, b in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), ids, pa.array(texts, pa.binary())], names=["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids")).mapInArrow(released(run), "doc_id long, ids array<int>, decoded binary")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of `documents`; null text is empty, a row each for repeated ids, no rows from an empty table."""
    both = decode(encode(spread(table(spark, sf_dir, "documents"))))
    return both.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )
