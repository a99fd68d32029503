"""Token ids in ORC files (operator 9): stripes with run-length encoded integers, row indexes and Bloom filters on ids.

Documents are put into ascending order of doc_id by range, encoded with a tokenizer file of the ``tokenizers`` library, each
with an end id, and written as ORC: one file per range, sorted within, so that a reader can take stripes in parallel and
skip stripes and row groups by the doc_id's minimum, maximum and Bloom filter.

Encoding goes through distinct chunks: texts are cut at blanks, and between letters and the marks that end them, where no
match of the tokenizer's pattern can cross; only chunks that a worker hasn't met are given to the library, and the cache of
its results is bounded. Texts that hold an added token of the file go to the library whole.

Starts are prefix sums of the counts that the files hold: within each file's range by a window, over ranges by a small table
with one row per file. Ranges are made by sampling ids and beginnings of texts, so neither a hot source nor an id that a third
of the rows share is one file, unless its texts begin alike.

Defined results: null text is the empty text, which has the end id only; null ids come first; of repeated ids, rows are
ordered by text; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.chunks import LETTERS, ChunkEncoder
from tidemark.llm.common import table, whole_text
from tidemark.session import shared_folder

#: Rows of an output batch; rows of a file, where there are more of them than a file for each shuffle partition would take.
ROWS, RANGE_ROWS = 1024, 200_000
#: Byte-level alphabet: bytes without a visible sign of their own are shown by the signs from 256 on, in order.
_UNSEEN = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b)]
_BYTE_SIGNS = {b: chr(256 + _UNSEEN.index(b)) if b in _UNSEEN else chr(b) for b in range(256)}
ORC_OPTIONS = {
    "compression": "zstd", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.create.index": "true",
    "orc.row.index.stride": "1000", "orc.stripe.size": str(16 << 20),
}


class FileEncoder(ChunkEncoder):
    """Encodes by a tokenizer file."""

    cached = 250_000

    def __init__(self, tokenizer_file: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_str(tokenizer_file.decode())
        self.added = [token["content"] for token in json.loads(tokenizer_file)["added_tokens"]]

    def encode_all(self, texts: list[str]) -> Iterator[bytes]:
        """Texts that hold one of the file's added tokens, which the library finds before all else, go to it whole."""
        whole = [any(token in text for token in self.added) for text in texts]
        others = super().encode_all([text for text, is_whole in zip(texts, whole) if not is_whole])
        for text, is_whole in zip(texts, whole):
            yield np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes() if is_whole else next(others)

    def ids_of(self, chunks: list[str]) -> list[bytes]:
        """Single pre-tokens go to the library's model at once, in its alphabet for bytes; other chunks through all steps."""
        ids = {}
        words = [c for c in chunks if LETTERS.fullmatch(c)]
        signs = "\n".join(words).encode().decode("latin-1").translate(_BYTE_SIGNS).split(_BYTE_SIGNS[10]) if words else []
        tokenize = self.tokenizer.model.tokenize
        ids.update(zip(words, [[t.id for t in tokenize(word)] for word in signs]))
        others = [c for c in chunks if c not in ids]
        for start in range(0, len(others), 2000):
            part = others[start : start + 2000]
            ids.update(zip(part, [found.ids for found in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]))
        each = [ids[c] for c in chunks]
        packed = np.array(list(chain.from_iterable(each)), dtype="<u4").tobytes()
        stops = list(accumulate(4 * len(i) for i in each))
        return [packed[a:b] for a, b in zip([0, *stops], stops)]


_LOADED: dict[int, FileEncoder] = {}


def _loaded(tokenizer_file: bytes) -> FileEncoder:
    key = zlib.crc32(tokenizer_file)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = FileEncoder(tokenizer_file)
    return _LOADED[key]


def write_ids(docs: DataFrame, tokenizer: Broadcast, end_id: int, path: str, ranges: int | None = None) -> None:
    """Writes ``doc_id, place (range and position in it), ids`` of every row of ``docs`` (doc_id, text) as ORC files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, place, end = _loaded(tokenizer.value), 0, np.uint32(end_id).tobytes()
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                rows = [ids + end for ids in encoder.encode_all(part.column(2).to_pylist())]
                stops = np.cumsum([0, *(len(r) // 4 for r in rows)], dtype=np.int32)
                values = pa.Array.from_buffers(pa.int32(), int(stops[-1]), [None, pa.py_buffer(b"".join(rows))])
                places = pa.array(np.arange(place, place + len(rows), dtype=np.int64))
                place += len(rows)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), places, pa.ListArray.from_arrays(stops, values)], names=["doc_id", "piece", "place", "ids"])

    spark = docs.sparkSession
    ranges = ranges or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-docs.count() // RANGE_ROWS))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    ordered = rows.repartitionByRange(ranges, F.col("doc_id").asc_nulls_first(), F.substring("text", 1, 64)).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    placed = ordered.select("doc_id", F.spark_partition_id().alias("piece"), "text")
    placed.mapInArrow(run, "doc_id long, piece int, place long, ids array<int>").write.options(**ORC_OPTIONS).orc(path)


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every row of the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            values = np.asarray(lists.values).astype("<u4", copy=False)
            offsets = np.asarray(lists.offsets)
            sums = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:])]
            counts = pa.array(np.diff(offsets).astype(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], counts, pa.array(sums, pa.int64())], names=["doc_id", "piece", "place", "n_tokens", "ids_crc32"])

    stored = spark.read.schema("doc_id long, piece int, place long, ids array<int>").orc(path)
    rows = stored.mapInArrow(run, "doc_id long, piece int, place long, n_tokens long, ids_crc32 long")
    small = shared_folder(spark, "token-digests")
    rows.write.parquet(small)
    rows = spark.read.schema(rows.schema).parquet(small)
    totals = rows.groupBy("piece").agg(F.sum("n_tokens").alias("__total"))
    earlier = Window.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    offsets = totals.select("piece", F.coalesce(F.sum("__total").over(earlier), F.lit(0)).alias("__offset"))
    within = Window.partitionBy("piece").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("n_tokens").over(within), F.lit(0))
    return rows.withColumn("__before", before).join(offsets, "piece").select(
        "doc_id", (F.col("__offset") + F.col("__before")).cast("long").alias("start"), "n_tokens", "ids_crc32"
    )


def sent_tokenizer(spark: SparkSession, path: str) -> Broadcast:
    with open(path, "rb") as file:
        return spark.sparkContext.broadcast(file.read())


def query(spark: SparkSession, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    tokenizer = sent_tokenizer(spark, tokenizer_path or public_tokenizers.path("byte_bpe_50k.json"))
    path = shared_folder(spark, "token-ids")
    write_ids(table(spark, sf_dir, "documents"), tokenizer, 2, path)
    return read_digests(spark, path)
