"""Encoding of a whole corpus by a public byte-level BPE: corpus-level merge replay.

1. Every text is split into words; a block of texts becomes codes into the block's own
   list of distinct words (``coded``, written to the shared folder).
2. The blocks' words are brought together by word, so that a word that occurs anywhere in
   the corpus is encoded in one place. There all words lie in one array of symbols; an
   index from token pair to positions is kept, and the merges are replayed in rank order:
   each is applied to all its positions at once, and only the neighbours of what changed
   are looked up and indexed anew.
3. The words' ids go back to their blocks, and the codes are replaced by ids.

A word reaches step 2 once per block, not once per occurrence, so that a word that makes
up a third of the corpus is no larger than any other.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.pretokens import words_of
from tessera.runtime import materialize, partitions_of, spread

DEFAULT_TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
#: Words of text per block, and rows of words replayed together.
BLOCK_WORDS = 400_000
REPLAY_ROWS = 1_500_000


@dataclass(frozen=True)
class Merges:
    """A tokenizer's tables; their size is the tokenizer's, not the data's."""

    byte_ids: np.ndarray  # id of each single byte
    left: np.ndarray  # per rank: the pair and what it becomes
    right: np.ndarray
    made: np.ndarray
    keys: np.ndarray  # left * size + right, sorted, with their ranks
    ranks: np.ndarray
    size: int


def _printable_bytes() -> dict[str, int]:
    """The usual one-to-one map from printable characters to bytes of byte-level BPE files:
    printable Latin-1 bytes stand for themselves, the others for code points from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def load_merges(path: str = DEFAULT_TOKENIZER) -> Merges:
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocab = model["vocab"]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    byte_ids = np.zeros(256, np.int32)
    for char, byte in _printable_bytes().items():
        byte_ids[byte] = vocab[char]
    left = np.array([vocab[a] for a, _ in pairs], np.int32)
    right = np.array([vocab[b] for _, b in pairs], np.int32)
    made = np.array([vocab[a + b] for a, b in pairs], np.int32)
    size = max(vocab.values()) + 1
    keys = left.astype(np.int64) * size + right
    order = np.argsort(keys)
    return Merges(byte_ids, left, right, made, keys[order], order.astype(np.int32), size)


def replay(words: pa.Array, m: Merges) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all ``words`` (binary, distinct), concatenated, and their offsets."""
    words = words.cast(pa.binary())
    _, offset_buffer, data = words.buffers()
    offsets = np.frombuffer(offset_buffer, np.int32, len(words) + 1, words.offset * 4).astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    n = len(raw)
    if not n:
        return np.zeros(0, np.int32), offsets
    sym = m.byte_ids[raw]
    after = np.arange(1, n + 1)
    before = np.arange(-1, n - 1)
    begins, ends = offsets[:-1][np.diff(offsets) > 0], offsets[1:][np.diff(offsets) > 0]
    after[ends - 1] = -1
    before[begins] = -1

    def rank_of(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        want = left.astype(np.int64) * m.size + right
        at = np.minimum(np.searchsorted(m.keys, want), len(m.keys) - 1)
        return np.where(m.keys[at] == want, m.ranks[at], -1)

    index: dict[int, list[np.ndarray]] = {}
    queue: list[int] = []

    def enter(at: np.ndarray) -> None:
        """Index the pairs that begin at these positions."""
        ranks = rank_of(sym[at], sym[after[at]])
        at, ranks = at[ranks >= 0], ranks[ranks >= 0]
        if not len(at):
            return
        order = np.argsort(ranks, kind="stable")
        at, ranks = at[order], ranks[order]
        cuts = np.flatnonzero(np.diff(ranks)) + 1
        firsts = np.concatenate(([0], cuts))
        for rank, part in zip(ranks[firsts].tolist(), np.split(at, cuts)):
            if rank in index:
                index[rank].append(part)
            else:
                index[rank] = [part]
                heapq.heappush(queue, rank)

    enter(np.flatnonzero(after >= 0))
    while queue:
        rank = heapq.heappop(queue)
        parts = index.pop(rank)
        at = np.unique(np.concatenate(parts)) if len(parts) > 1 else np.unique(parts[0])
        a, b = m.left[rank], m.right[rank]
        nxt = after[at]
        ok = (sym[at] == a) & (nxt >= 0)
        ok &= sym[nxt] == b
        at, nxt = at[ok], nxt[ok]
        if a == b and len(at) > 1:  # of overlapping pairs in a row, every second goes
            linked = np.concatenate(([False], nxt[:-1] == at[1:]))
            place = np.arange(len(at))
            head = np.maximum.accumulate(np.where(linked, 0, place))
            keep = (place - head) % 2 == 0
            at, nxt = at[keep], nxt[keep]
        if not len(at):
            continue
        sym[at] = m.made[rank]
        sym[nxt] = -1
        beyond = after[nxt]
        after[at] = beyond
        before[beyond[beyond >= 0]] = at[beyond >= 0]
        prior = before[at]
        enter(np.concatenate((at[beyond >= 0], prior[prior >= 0])))
    alive = sym >= 0
    kept = np.concatenate(([0], np.cumsum(alive)))
    return sym[alive].astype(np.int32), kept[offsets]


def _coder(block_words: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serial = TaskContext.get().partitionId() << 32
        keys, words, counts, held = [], [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            every = pa.chunked_array([c for w in words for c in w.chunks], pa.binary()).combine_chunks().dictionary_encode() if held else None
            codes = every.indices.to_numpy(zero_copy_only=False).astype(np.int32) if held else np.zeros(0, np.int32)
            cuts = np.concatenate(([0], np.cumsum(np.concatenate(counts)))) * 4
            blob = codes.tobytes()
            key = pa.concat_arrays(keys)
            n = len(key)
            packed = pa.array([blob[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([serial] * n, pa.int64()), key, packed, pa.nulls(n, pa.list_(pa.binary()))], names=["block", "key", "codes", "words"])
            if held:
                size = len(every.dictionary)
                lists = pa.ListArray.from_arrays(pa.array([0, size], pa.int32()), every.dictionary)
                yield pa.RecordBatch.from_arrays([pa.array([serial], pa.int64()), pa.nulls(1, key.type), pa.nulls(1, pa.binary()), lists], names=["block", "key", "codes", "words"])

        for batch in batches:
            texts = batch.column(1).to_pylist()
            at = 0
            while at < len(texts):  # a few texts at a time, so that blocks keep their size
                to, size = at, 0
                while to < len(texts) and (to == at or size + len(texts[to] or "") <= 4 * block_words):
                    size += len(texts[to] or "")
                    to += 1
                w, n = words_of(texts[at:to])
                keys.append(batch.column(0).slice(at, to - at))
                words.append(w)
                counts.append(n)
                held += len(w)
                at = to
                if held >= block_words:
                    yield from flush()
                    serial += 1
                    keys, words, counts, held = [], [], [], 0
        if keys:
            yield from flush()

    return run


def _replayer(m: Merges, rows: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held)
            words = t.column("word").combine_chunks().dictionary_encode()
            ids, cuts = replay(words.dictionary, m)
            blob, cuts = ids.tobytes(), (cuts * 4).tolist()
            packed = pa.array([blob[a:b] for a, b in zip(cuts[:-1], cuts[1:])], pa.binary()).take(words.indices)
            for piece in pa.table([t.column("block"), t.column("idx"), packed], names=["block", "idx", "ids"]).to_batches(100_000):
                yield piece

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= rows:
                yield from flush()
                held = []
        if held:
            yield from flush()

    return run


def _decoder(counts_only: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(docs: pa.Table, words: pa.Table) -> pa.Table:
        order = np.argsort(words.column("idx").to_numpy()) if words.num_rows else np.zeros(0, np.int64)
        packed = words.column("ids").combine_chunks().take(pa.array(order)) if len(order) else pa.array([], pa.binary())
        if isinstance(packed, pa.ChunkedArray):
            packed = packed.combine_chunks()
        cuts = np.frombuffer(packed.buffers()[1], np.int32, len(packed) + 1, packed.offset * 4).astype(np.int64) // 4 if len(packed) else np.zeros(1, np.int64)
        flat = np.frombuffer(packed.buffers()[2], np.int32) if len(packed) and packed.buffers()[2] is not None else np.zeros(0, np.int32)
        sizes = np.diff(cuts)
        key = docs.column("key").combine_chunks()
        blobs = docs.column("codes").to_pylist()
        n_words = np.array([len(b) // 4 for b in blobs], np.int64)
        codes = np.frombuffer(b"".join(blobs), np.int32)
        lengths = sizes[codes] if len(codes) else np.zeros(0, np.int64)
        ends = np.concatenate(([0], np.cumsum(lengths)))
        bounds = ends[np.concatenate(([0], np.cumsum(n_words)))]
        if counts_only:
            return pa.table([key, pa.array(np.diff(bounds), pa.int64())], names=["key", "n_tokens"])
        where = np.repeat(cuts[:-1][codes] - ends[:-1], lengths) + np.arange(ends[-1]) if len(codes) else np.zeros(0, np.int64)
        values = pa.array(flat[where], pa.int32())
        lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), values)
        return pa.table([key, lists], names=["key", "ids"])

    return run


def _encoded(df: DataFrame, key: str, text: str, tokenizer: str, counts_only: bool) -> DataFrame:
    kind = df.schema[key].dataType
    m = load_merges(tokenizer)
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("key", kind), T.StructField("codes", T.BinaryType()), T.StructField("words", T.ArrayType(T.BinaryType()))])
    coded = materialize(spread(df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))).mapInArrow(_coder(BLOCK_WORDS), schema), "bpe-coded")
    words = coded.filter(F.col("words").isNotNull()).select("block", F.posexplode("words").alias("idx", "word"))
    n = partitions_of(coded)
    known = words.repartition(n, "word").mapInArrow(_replayer(m, REPLAY_ROWS), "block long, idx int, ids binary")
    out = T.StructType([T.StructField("key", kind), T.StructField("n_tokens", T.LongType()) if counts_only else T.StructField("ids", T.ArrayType(T.IntegerType()))])
    docs = coded.filter(F.col("words").isNull()).select("block", "key", "codes")
    at = 4 * n  # blocks have no equal share of partitions, so these are small
    return docs.repartition(at, "block").groupBy("block").cogroup(known.repartition(at, "block").groupBy("block")).applyInArrow(_decoder(counts_only), out).withColumnRenamed("key", key)


def encode_corpus(df: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = DEFAULT_TOKENIZER) -> DataFrame:
    """(key, ids): the token ids of every text, one row per row of ``df``.

    An empty text and a null text both have the empty list. Strings that look like special
    tokens are ordinary text. Other columns are not read; a null key is kept as it is.
    """
    return _encoded(df, key, text, tokenizer, False)


def token_counts(df: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = DEFAULT_TOKENIZER) -> DataFrame:
    """(key, n_tokens): the length of ``encode_corpus``'s list, without building it."""
    return _encoded(df, key, text, tokenizer, True)
