"""Encoders against the libraries that they must equal."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from cases import documents, rows
from tokenizers import Tokenizer, models, pre_tokenizers

from tidemark.llm import byte_bpe, token_counts, token_orc
from tidemark.session import shared_folder

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")


def odd_texts(n=3000):
    pick = random.Random(5)
    signs = "aab.,!?:;-é  \n\t'sreé1٣$\x1c\x85　<|endoftext|>漢😀́"
    short = ["".join(pick.choice(signs) for _ in range(pick.randint(0, 30))) for _ in range(n)]
    long = ["".join(pick.choice("abcdeinthrs") for _ in range(size)) for size in (255, 256, 257, 258, 5000)]
    return short + long + ["a" * 20_000, "ab" * 10_000, " " * 3000 + "x", "'s" * 500]


@pytest.fixture(scope="module")
def bpe():
    with open(RANKS, "rb") as file:
        return byte_bpe.ByteBpe(file.read())


@pytest.fixture(scope="module")
def library(bpe):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})


def test_bpe_equals_the_library(bpe, library):
    texts = odd_texts()
    for text, ids in zip(texts, bpe.encode_all(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text), ascii(text[:80])
        assert bpe.decode(ids) == text.encode()


def test_bpe_over_all_characters(bpe, library):
    texts = [f"a{chr(c)}b 1{chr(c)} {chr(c)}{chr(c)}x" for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    assert all(np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(t) for t, ids in zip(texts, bpe.encode_all(texts)))


def test_rank_order_where_a_merge_brings_a_lower_rank():
    """aba is lower than ab: after the first merge of a and b, the new pair goes before the second one of the same rank."""
    ranks = {bytes([b]): b for b in range(256)} | {b"aba": 256, b"ab": 257, b"abab": 258}
    made = byte_bpe.ByteBpe(b"\n".join(base64.b64encode(t) + b" " + str(r).encode() for t, r in ranks.items()))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for text in ("abab", "ababab", "abababab", "bab" * 5):
        want = library.encode_ordinary(text)
        assert made.merged(text.encode()) == want
        assert np.frombuffer(made.merged_together([text.encode()])[0], "<u4").tolist() == want


def test_both_queues_agree(bpe):
    pick = random.Random(3)
    pieces = [bytes(pick.choice(b"abcdeth") for _ in range(pick.randint(2, 40))) for _ in range(2000)]
    assert [np.frombuffer(p, "<u4").tolist() for p in bpe.merged_together(pieces)] == [bpe.merged(p) for p in pieces]


def test_small_caches_change_nothing(bpe, library, monkeypatch):
    from tidemark.llm import chunks

    monkeypatch.setattr(chunks, "CACHED", 20)
    monkeypatch.setattr(chunks, "TOGETHER", 50)
    with open(RANKS, "rb") as file:
        small = byte_bpe.ByteBpe(file.read())
    texts = odd_texts(300)
    assert list(small.encode_all(texts)) == list(bpe.encode_all(texts))


def test_round_trip_of_odd_rows(spark, library):
    found = byte_bpe.round_trip(documents(spark), byte_bpe.sent_ranks(spark, RANKS), with_ids=True).collect()
    want = sorted((str(r[0]), hashlib.sha256((r[1] or "").encode()).hexdigest(), len(library.encode_ordinary(r[1] or ""))) for r in rows())
    assert sorted((str(r.doc_id), r.decoded_sha256, r.n_tokens) for r in found) == want
    assert all(hashlib.sha256(r.ids).hexdigest() == r.ids_sha256 for r in found)
    assert byte_bpe.round_trip(documents(spark, []), byte_bpe.sent_ranks(spark, RANKS)).count() == 0


def test_orc_encoder_equals_the_library():
    with open(JSON, "rb") as file:
        made = token_orc.FileEncoder(file.read())
    library = Tokenizer.from_file(JSON)
    texts = [*odd_texts(), "a<|endoftext|>b <|endoftext|> c", "<|endoftext|>", " <|endoftext|>\n<|endoftext", "<|endoftext|><|endoftext|>"]
    want = library.encode_batch(texts, add_special_tokens=False)
    assert all(np.frombuffer(ids, "<u4").tolist() == w.ids for ids, w in zip(made.encode_all(texts), want))


def test_orc_files_hold_ids_in_order(spark):
    library = Tokenizer.from_file(JSON)
    path = shared_folder(spark, "test-orc")
    token_orc.write_ids(documents(spark), token_orc.sent_tokenizer(spark, JSON), 2, path, ranges=3)
    found = sorted(token_orc.read_digests(spark, path).collect(), key=lambda r: r.start)
    ordered = sorted(rows(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    assert [r.doc_id for r in found] == [r[0] for r in ordered]
    start = 0
    for r, (_, text, *_) in zip(found, ordered):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    pruned = spark.read.orc(path).where("doc_id = 14")
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,14)]" in pruned._jdf.queryExecution().toString()
    assert pruned.count() == 3
    empty = shared_folder(spark, "test-orc")
    token_orc.write_ids(documents(spark, []), token_orc.sent_tokenizer(spark, JSON), 2, empty)
    assert token_orc.read_digests(spark, empty).count() == 0


def test_counts_equal_the_library(spark):
    vocabulary = token_counts.model_vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    least = min(score for _, score in vocabulary)
    pieces = [("<unk>", 0.0), *vocabulary, *((f"<0x{b:02X}>", least) for b in range(256))]
    library = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=True))
    library.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    counter = token_counts.UnigramCounter(vocabulary)
    for text in [*odd_texts(1500)[:1500], "▁a▁ b", " ", "  ", "", "the " * 500]:
        assert counter.count(text)[0] == len(library.encode(text, add_special_tokens=False).ids), ascii(text)
    found = token_counts.counted(documents(spark), token_counts.sent_vocabulary(spark, vocabulary)).collect()
    want = sorted((str(r[0]), len(r[1] or ""), len(library.encode(r[1] or "", add_special_tokens=False).ids)) for r in rows())
    assert sorted((str(r.doc_id), r.n_chars, r.n_tokens) for r in found) == want
    assert token_counts.counted(documents(spark, []), token_counts.sent_vocabulary(spark, vocabulary)).count() == 0


def test_counts_break_ties_like_the_lattice():
    """Two ways of equal score: the path from the earlier start stays."""
    vocabulary = [("▁", 0.0), ("▁a", -1.0), ("ab", -2.0), ("a", -1.0), ("b", -1.0), ("▁ab", -2.0)]
    library = Tokenizer(models.Unigram([("<unk>", 0.0), *vocabulary], unk_id=0))
    library.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    counter = token_counts.UnigramCounter(vocabulary)
    for text in ("ab", "abab", "a b ab", "ba", "aab"):
        assert counter.count(text)[0] == len(library.encode(text).ids)
    assert token_counts.UnigramCounter([]).count("né") == (6, 3)
