"""Token counts (operator 8): how many pieces a unigram tokenizer makes of a text, without making them.

A text is cut before each space, as the tokenizer's word marks are. In each word an Aho-Corasick automaton over the
vocabulary enumerates all matches; a pass over the positions carries the best score and the number of pieces up to each.
Ties follow the tokenizer's lattice: starts are taken in ascending order and, from one start, ends too; a later path replaces
an earlier one only with a higher score. A character that no piece of one character covers costs the lowest score less a
penalty, and counts as one token for each of its UTF-8 bytes.

The vocabulary and scores are those of a given sentencepiece model file (normal pieces), read by the driver and sent as one
broadcast of the vocabulary's size. Words' counts are kept in a bounded cache. Texts are counted where they are read: no
shuffle, so hot sources and copies don't matter.

Defined results: null and empty texts have no tokens; a very long word takes time in proportion to its matches; repeated
rows are counted each; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import public_tokenizers
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import BoundedCache, table, whole_text

MARK = "▁"
UNKNOWN_PENALTY = 10.0
CACHED_WORDS = 300_000
NOTHING = float("-inf")


class UnigramCounter:
    """Counts pieces for a vocabulary of (piece, score); cached words stand without their mark."""

    def __init__(self, vocabulary: list[tuple[str, float]]):
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            self.automaton.add_word(piece, (len(piece), score))
        if vocabulary:
            self.automaton.make_automaton()
        self.unknown = min((score for _, score in vocabulary), default=0.0) - UNKNOWN_PENALTY
        self.words = BoundedCache(lambda word: self.count_word(MARK + word), CACHED_WORDS)

    def count_word(self, word: str) -> tuple[int, int]:
        """Tokens of one marked word, and the characters among them that no piece covers."""
        n = len(word)
        starting: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        if len(self.automaton):
            for last, (length, score) in self.automaton.iter(word):
                starting[last - length + 1].append((length, score))  # for one start, ends come in ascending order
        best, tokens, strange = [NOTHING] * (n + 1), [0] * (n + 1), [0] * (n + 1)
        best[0] = 0.0
        for start in range(n):
            here, single = best[start], False
            for length, score in starting[start]:
                end = start + length
                if here + score > best[end] or best[end] == NOTHING:
                    best[end], tokens[end], strange[end] = here + score, tokens[start] + 1, strange[start]
                single = single or length == 1
            if not single:
                end = start + 1
                if here + self.unknown > best[end] or best[end] == NOTHING:
                    best[end] = here + self.unknown
                    tokens[end], strange[end] = tokens[start] + len(word[start].encode()), strange[start] + 1
        return tokens[n], strange[n]

    def count(self, text: str) -> tuple[int, int]:
        if not text:
            return 0, 0
        words = text.replace(MARK, " ").split(" ")
        if not words[0]:
            words = words[1:]  # the text's own first space is the mark of its first word
        tokens = strange = 0
        cache = self.words
        for word in words:
            t, s = cache[word] if len(word) < 100 else self.count_word(MARK + word)
            tokens += t
            strange += s
        return tokens, strange


def model_vocabulary(path: str) -> list[tuple[str, float]]:
    """The normal pieces of a sentencepiece model file with their scores."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    special = lambda i: model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size()) if not special(i)]


_LOADED: dict[bytes, UnigramCounter] = {}


def _loaded(packed: bytes) -> UnigramCounter:
    key = hashlib.sha256(packed).digest()
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = UnigramCounter(pickle.loads(packed))
    return _LOADED[key]


def sent_vocabulary(spark: SparkSession, vocabulary: list[tuple[str, float]]) -> Broadcast:
    return spark.sparkContext.broadcast(pickle.dumps(vocabulary))


def counted(docs: DataFrame, vocabulary: Broadcast) -> DataFrame:
    """``doc_id, n_chars, n_tokens, n_unknown_chars`` of every row of ``docs`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _loaded(vocabulary.value)
        for batch in batches:
            sizes, tokens, strange = [], [], []
            for text in batch.column(1):
                text = text.as_py()
                t, s = counter.count(text)
                sizes.append(len(text))
                tokens.append(t)
                strange.append(s)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(x, pa.int64()) for x in (sizes, tokens, strange))], names=["doc_id", "n_chars", "n_tokens", "n_unknown_chars"]
            )

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("__text"))
    return given.mapInArrow(run, "doc_id long, n_chars long, n_tokens long, n_unknown_chars long")


def query(spark: SparkSession, sf_dir: str, model_path: str | None = None) -> DataFrame:
    vocabulary = sent_vocabulary(spark, model_vocabulary(model_path or public_tokenizers.path("piece_bpe_32k.model")))
    return counted(table(spark, sf_dir, "documents"), vocabulary)
