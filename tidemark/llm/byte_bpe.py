"""Byte-level BPE encoding and decoding (operator 5), without a tokenizer library.

A pre-token's bytes are merged by rank with a queue made for very long pre-tokens: each rank has a bucket of positions of
the linked list of parts; a hierarchy of bitmaps holds which buckets have positions, and find-first-set in the top word, then
in the word it names, gives the lowest rank. Entries whose pair has changed since are stale and skipped. Every merge costs
a few word operations, so a pre-token of n bytes takes time in proportion to n.

Texts are cut twice: first into chunks with the standard library, whose ids are kept in a bounded cache, and a chunk that is
new is cut by the tokenizer's pattern. The first cut never splits a match of the pattern. New pre-tokens of many texts share
one queue; very long ones have a queue each.

The rank file is read by the driver and sent to the executors as one broadcast; its size is the vocabulary's. Documents are
encoded where they are read: no shuffle, so hot sources and copies don't matter. Memory: one batch of rows, the vocabulary
and the bounded caches.

Defined results: null text is the empty text, which has no ids; a text of a single long pre-token is encoded whole; repeated
rows are encoded each; equal ranks don't exist, and of equal pairs the leftmost is merged first; empty tables give no rows;
other columns are carried or ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.chunks import LETTERS, ChunkEncoder
from tidemark.llm.common import table, whole_text

#: Bytes of a pre-token that has a queue of its own; rows taken from a batch, and ids decoded, at once.
LONG, ROWS, DECODED = 256, 4096, 1 << 16
#: Bits of a bitmap word: two levels of words serve 65,536 ranks, and Python's integers hold such words whole.
WORD_BITS = 8
IN_WORD = (1 << WORD_BITS) - 1
#: Bits of the right id in the key of a pair.
ID_BITS = 24


class ByteBpe(ChunkEncoder):
    """Encoder and decoder of one rank file: lines of a base64 token and its rank."""

    def __init__(self, rank_file: bytes, pattern: str = public_tokenizers.PATTERN):
        pairs = (line.split() for line in rank_file.splitlines() if line)
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.none = ((max(self.ranks.values()) >> WORD_BITS) + 1) << WORD_BITS  # in a word without ranks
        self.low = [0] * (self.none >> WORD_BITS)  # which ranks have positions; all empty between calls
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)])
        self.pair_ranks = {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    self.pair_ranks[left << ID_BITS | right] = rank
        keys = np.fromiter(self.pair_ranks, dtype=np.int64, count=len(self.pair_ranks))
        order = np.argsort(keys)
        self.pair_keys = keys[order]
        self.pair_values = np.fromiter(self.pair_ranks.values(), dtype=np.int64, count=len(keys))[order]
        tokens = [b""] * self.none
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.token_bytes = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        self.token_sizes = np.array([len(t) for t in tokens])
        self.token_starts = np.cumsum(self.token_sizes) - self.token_sizes
        self.matches = regex.compile(pattern).findall
        super().__init__()

    def _ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left << ID_BITS | right
        at = np.searchsorted(self.pair_keys, keys)
        at[at == len(self.pair_keys)] = 0
        return np.where(self.pair_keys[at] == keys, self.pair_values[at], self.none)

    def merged(self, piece: bytes) -> list[int]:
        """Ids of one pre-token of any length, with a bucket of positions for each rank."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        rank_of, low = self.pair_ranks.get, self.low
        n = len(piece)
        parts = self.byte_ids[list(piece)].tolist()
        parts.append(-1)
        follows, leads = list(range(1, n + 2)), list(range(-1, n))
        pending = [-1] * (n + 1)  # the rank that the pair starting here is queued under
        buckets: dict[int, int | list[int]] = {}  # a position, or a list of them
        high = 0  # which words of ``low`` have a bit
        left = parts[0]
        for i in range(1, n):
            right = parts[i]
            rank = rank_of(left << ID_BITS | right)
            left = right
            if rank is not None:
                pending[i - 1] = rank
                held = buckets.get(rank)
                if held is None:
                    buckets[rank] = i - 1
                    word = rank >> WORD_BITS
                    low[word] |= 1 << (rank & IN_WORD)
                    high |= 1 << word
                elif held.__class__ is int:
                    buckets[rank] = [held, i - 1]
                else:
                    held.append(i - 1)
        while high:
            first = high & -high
            word = first.bit_length() - 1
            bits = low[word]
            lowest = bits & -bits
            rank = (word << WORD_BITS) + lowest.bit_length() - 1
            bits ^= lowest
            low[word] = bits
            if not bits:
                high ^= first
            held = buckets.pop(rank)
            if held.__class__ is int:
                held = (held,)
            else:
                held.sort()
            for turn, i in enumerate(held):
                if pending[i] != rank:
                    continue  # stale
                if high and (high & -high) < first:  # a merge has brought a pair of lower rank
                    buckets[rank] = list(held[turn:])
                    low[rank >> WORD_BITS] |= lowest
                    high |= first
                    break
                middle = follows[i]
                end = follows[middle]
                follows[i], leads[end] = end, i
                parts[i], pending[middle] = rank, -1
                before = leads[i]
                for at, key in ((i, rank << ID_BITS | parts[end]), (before, parts[before] << ID_BITS | rank)) if before >= 0 else ((i, rank << ID_BITS | parts[end]),):
                    new = rank_of(key)
                    if new is None:
                        pending[at] = -1
                        continue
                    pending[at] = new
                    other = buckets.get(new)
                    if other is None:
                        buckets[new] = at
                        word = new >> WORD_BITS
                        low[word] |= 1 << (new & IN_WORD)
                        high |= 1 << word
                    elif other.__class__ is int:
                        buckets[new] = [other, at]
                    else:
                        other.append(at)
        ids, i = [], 0
        while i < n:
            ids.append(parts[i])
            i = follows[i]
        return ids

    def merged_together(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of many pre-tokens, whose parts lie in one linked list with a gap after each pre-token.

        The queue's buckets are the bitmap words here: the first set bit of the top word names the lowest ranks that any
        pre-token has, and of its pairs there each pre-token merges the one of lowest rank, the leftmost of equals. The
        others go back; what has changed meanwhile is stale.
        """
        sizes = np.array([len(p) for p in pieces])
        ends = np.cumsum(sizes + 1) - 1
        flat = np.frombuffer(b"\0".join(pieces) + b"\0", dtype=np.uint8)
        parts = self.byte_ids[flat]
        parts[ends] = self.none
        owner = np.repeat(np.arange(len(pieces)), sizes + 1)
        follows, leads = np.arange(1, len(flat) + 1), np.arange(-1, len(flat) - 1)
        leads[0] = ends[-1]
        pending = np.append(self._ranks_of(parts[:-1], parts[1:]), self.none)
        alive = parts != self.none
        buckets: dict[int, list[np.ndarray]] = {}
        high = 0

        def push(positions: np.ndarray, ranks: np.ndarray) -> int:
            words = ranks >> WORD_BITS
            order = np.argsort(words, kind="stable")
            words, positions = words[order], positions[order]
            cuts = np.flatnonzero(words[1:] != words[:-1]) + 1
            bits = 0
            for word, part in zip(words[np.append(0, cuts)].tolist(), np.split(positions, cuts)):
                buckets.setdefault(word, []).append(part)
                bits |= 1 << word
            return bits

        at = np.flatnonzero(pending != self.none)
        if len(at):
            high |= push(at, pending[at])
        while high:
            first = high & -high
            high ^= first
            word = first.bit_length() - 1
            held = buckets.pop(word)
            at = np.concatenate(held) if len(held) > 1 else held[0]
            at = at[pending[at] >> WORD_BITS == word]  # the others are stale
            if not len(at):
                continue
            order = np.lexsort((at, pending[at], owner[at]))
            at = at[order]
            lead = np.append(True, owner[at[1:]] != owner[at[:-1]])
            if not lead.all():
                buckets[word] = [at[~lead]]
                high |= first
            at = at[lead]
            ranks = pending[at]
            middle = follows[at]
            end = follows[middle]
            follows[at], leads[end] = end, at
            parts[at], pending[middle], alive[middle] = ranks, self.none, False
            before = leads[at]
            after_ranks, before_ranks = self._ranks_of(ranks, parts[end]), self._ranks_of(parts[before], ranks)
            pending[before] = before_ranks
            pending[at] = after_ranks
            positions, ranks = np.concatenate([at, before]), np.concatenate([after_ranks, before_ranks])
            real = ranks != self.none
            if real.any():
                high |= push(positions[real], ranks[real])
        counts = np.bincount(owner[alive], minlength=len(pieces))
        packed = parts[alive].astype("<u4").tobytes()
        stops = (np.cumsum(counts) * 4).tolist()
        return [packed[start:stop] for start, stop in zip([0, *stops], stops)]

    def ids_of(self, chunks: list[str]) -> list[bytes]:
        cut = [[chunk.encode()] if LETTERS.fullmatch(chunk) else [m.encode() for m in self.matches(chunk)] for chunk in chunks]
        known, short = {}, []
        for piece in set().union(*cut):
            whole = self.ranks.get(piece)
            if whole is not None:
                known[piece] = whole.to_bytes(4, "little")
            elif len(piece) > LONG:
                known[piece] = np.array(self.merged(piece), dtype="<u4").tobytes()
            else:
                short.append(piece)
        if short:
            known.update(zip(short, self.merged_together(short)))
        return [b"".join([known[p] for p in pieces]) for pieces in cut]

    def decode(self, ids: bytes) -> bytes:
        """The bytes of the tokens, gathered block by block from one array of all tokens' bytes."""
        found = []
        for start in range(0, len(ids), 4 * DECODED):
            block = np.frombuffer(ids[start : start + 4 * DECODED], dtype="<u4")
            sizes = self.token_sizes[block]
            ends = np.cumsum(sizes)
            found.append(self.token_bytes[np.repeat(self.token_starts[block] - ends + sizes, sizes) + np.arange(ends[-1])].tobytes())
        return b"".join(found)


_LOADED: dict[bytes, ByteBpe] = {}


def loaded(rank_file: bytes) -> ByteBpe:
    """One encoder for each rank file in a worker."""
    key = hashlib.sha256(rank_file).digest()
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = ByteBpe(rank_file)
    return _LOADED[key]


def sent_ranks(spark: SparkSession, path: str) -> Broadcast:
    with open(path, "rb") as file:
        return spark.sparkContext.broadcast(file.read())


def round_trip(docs: DataFrame, ranks: Broadcast, with_ids: bool = False) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every row of ``docs`` (doc_id, text): ids and the bytes that they
    decode to, as digests; also ``ids`` themselves (little-endian unsigned 32-bit integers) if asked for."""
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(ranks.value)
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                rows = list(bpe.encode_all(part.column(1).to_pylist()))
                columns = [
                    part.column(0), pa.array([len(ids) // 4 for ids in rows], pa.int64()), pa.array([hashlib.sha256(ids).hexdigest() for ids in rows]),
                    pa.array([hashlib.sha256(bpe.decode(ids)).hexdigest() for ids in rows]),
                ]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(rows, pa.binary())] * with_ids, names=names)

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("__text"))
    return given.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids)


def query(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    ranks = sent_ranks(spark, path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return round_trip(table(spark, sf_dir, "documents"), ranks)
