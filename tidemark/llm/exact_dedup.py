"""Exact dedup (operator 6) with a minimal perfect hash over the digests of earlier documents.

The history's distinct digests are dealt into small buckets by their leading bits. Each bucket gets a minimal perfect hash
(hash and displace), which maps its n digests to the slots 0..n-1; a slot holds the full digest and the locator of the
history's winner. New digests look up their bucket's slot and compare all bytes: members are repeats of history, nonmembers
are grouped among themselves. Rows then learn the winner, the largest id, and the size of their group.

Hot groups: rows are folded to one per digest before any bucket is built or searched, so copies never meet in one task;
the final join by digest is a plain join that adaptive execution splits. Buckets hold about ``PER_BUCKET`` digests at any
size of the data.

Defined results: null text is the empty text; a null id loses to any other and is the winner of a group of null ids; of
repeated rows of the winner exactly one is kept; without history all rows are grouped; empty tables give no rows; other
columns are carried or ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import table, whole_text
from tidemark.session import written

PER_BUCKET = 2000
PER_SEED = 4
MIX = np.uint64(0x9E3779B97F4A7C15)
#: Stands for a null id, below all others.
_NO_ID_SQL = "CAST(-9223372036854775808 AS BIGINT)"


def _halves(digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit numbers of each 32-byte digest, from bytes that the bucket doesn't use."""
    words = digests.view("<u8").reshape(len(digests), 4)
    return words[:, 1].copy(), words[:, 2] | np.uint64(1)


def _place(first: np.ndarray, second: np.ndarray, seed: np.ndarray | int, slots: int) -> np.ndarray:
    x = first + second * np.asarray(seed, dtype=np.uint64)
    x ^= x >> np.uint64(29)
    x *= MIX
    return ((x >> np.uint64(32)) * np.uint64(slots)) >> np.uint64(32)


def build_hash(digests: np.ndarray) -> np.ndarray:
    """Seeds of a minimal perfect hash over distinct 32-byte digests: one for each group of about ``PER_SEED``.

    Groups are placed from the largest to the smallest; a group takes the first seed that sends its members to free slots
    that differ.
    """
    n = len(digests)
    groups = -(-n // PER_SEED)
    first, second = _halves(digests)
    group = _place(first, second, 0, groups).astype(np.int64)
    seeds, taken = np.zeros(groups, dtype="<u4"), np.zeros(n, dtype=bool)
    order = np.argsort(group, kind="stable")
    starts = np.searchsorted(group[order], np.arange(groups + 1))
    for g in np.argsort(-np.diff(starts), kind="stable"):
        members = order[starts[g] : starts[g + 1]]
        if not len(members):
            break
        a, b, low = first[members], second[members], 1
        while True:  # seeds are tried by the block
            tried = np.arange(low, low + 64, dtype=np.uint64)
            slots = _place(a[None, :], b[None, :], tried[:, None], n).astype(np.int64)
            fits = ~taken[slots].any(axis=1)
            if len(members) > 1:
                inner = np.sort(slots, axis=1)
                fits &= (inner[:, 1:] != inner[:, :-1]).all(axis=1)
            if fits.any():
                at = int(fits.argmax())
                seeds[g], taken[slots[at]] = tried[at], True
                break
            low += 64
    return seeds


def slots_of(digests: np.ndarray, seeds: np.ndarray, n: int) -> np.ndarray:
    """The slot of each digest; for digests that the hash was not built over, any slot."""
    first, second = _halves(digests)
    group = _place(first, second, 0, len(seeds)).astype(np.int64)
    return _place(first, second, seeds[group], n).astype(np.int64)


def _as_array(digests) -> np.ndarray:
    return np.frombuffer(b"".join(digests), dtype=np.uint8).reshape(-1, 32)


def _bucket(digest: Column, buckets: int) -> Column:
    return F.pmod(F.conv(F.substring(F.hex(digest), 1, 15), 16, 10).cast("long"), F.lit(buckets))


def build_index(history: DataFrame, buckets: int) -> DataFrame:
    """One row per bucket: the seeds, and by slot the digests, winners and counts, from rows of one per digest."""

    def built(rows: pd.DataFrame) -> pd.DataFrame:
        digests = _as_array(rows["digest"])
        seeds = build_hash(digests)
        slot = np.argsort(slots_of(digests, seeds, len(digests)))
        row = [rows["bucket"].iloc[0], seeds.tobytes(), digests[slot].tobytes(), rows["winner"].to_numpy()[slot], rows["copies"].to_numpy()[slot]]
        return pd.DataFrame([row], columns=["bucket", "seeds", "digests", "winners", "copies"])

    keyed = history.withColumn("bucket", _bucket(F.col("digest"), buckets))
    return keyed.groupBy("bucket").applyInPandas(built, "bucket long, seeds binary, digests binary, winners array<long>, copies array<long>")


def look_up(fresh: DataFrame, index: DataFrame, buckets: int) -> DataFrame:
    """Rows of (digest, winner, copies, member) for digests that ``fresh`` or the index holds, one row for each: members
    of the index with both winners and counts put together, the others as they are."""

    def found(new: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
        new = new[["digest", "winner", "copies"]].assign(member=False)
        if not len(old):
            return new
        entry = old.iloc[0]
        stored, seeds = _as_array([entry["digests"]]), np.frombuffer(entry["seeds"], dtype="<u4")
        winners, copies = np.array(entry["winners"]), np.array(entry["copies"])
        if len(new):
            digests = _as_array(new["digest"])
            slots = slots_of(digests, seeds, len(stored))
            member = (stored[slots] == digests).all(axis=1)  # all bytes of the slot's digest
            np.maximum.at(winners, slots[member], new["winner"].to_numpy()[member])
            np.add.at(copies, slots[member], new["copies"].to_numpy()[member])
            new = new[~member]
        known = pd.DataFrame({"digest": [d.tobytes() for d in stored], "winner": winners, "copies": copies, "member": True})
        return pd.concat([new, known]) if len(new) else known

    keyed = fresh.withColumn("bucket", _bucket(F.col("digest"), buckets))
    return keyed.groupBy("bucket").cogroup(index.groupBy("bucket")).applyInPandas(found, "digest binary, winner long, copies long, member boolean")


def _known_id() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.expr(_NO_ID_SQL))


def _digest() -> Column:
    return F.unhex(F.sha2(whole_text(), 256))


def _groups(hashed: DataFrame) -> DataFrame:
    """One row per digest of ``hashed`` (digest, id, old), found through the index of the old ones."""
    folded = written(hashed.groupBy("old", "digest").agg(F.max("id").alias("winner"), F.count("*").alias("copies")), "distinct-digests")
    buckets = max(1, folded.count() // PER_BUCKET)
    index = build_index(folded.where("old").drop("old"), buckets)
    return written(look_up(folded.where("NOT old").drop("old"), index, buckets), "digest-groups")


def exact_groups(docs: DataFrame, historical: Column) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` of every row of ``docs`` (doc_id, text).

    ``historical`` says which rows are history. The choice doesn't change the result, as the winner of a group is its
    largest id wherever it stands. All repeated rows of a winner are marked as kept; ``deduplicated`` keeps one.
    """
    hashed = written(docs.select(_known_id().alias("id"), _digest().alias("digest"), F.coalesce(historical, F.lit(False)).alias("old")), "digests")
    given = lambda c: F.nullif(F.col(c), F.expr(_NO_ID_SQL)).alias
    return hashed.join(_groups(hashed), "digest").select(
        given("id")("doc_id"), given("winner")("keep_id"), F.col("copies").alias("group_size"),
        (F.col("id") == F.col("winner")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"),
    )


def deduplicated(docs: DataFrame, historical: Column) -> DataFrame:
    """The rows of ``docs`` that stay, one for each text, with their columns as given."""
    hashed = written(docs.select(_known_id().alias("id"), _digest().alias("digest"), F.coalesce(historical, F.lit(False)).alias("old")), "digests")
    winners = _groups(hashed).select("digest", F.col("winner").alias("__winner"))
    rows = docs.select(F.struct("*").alias("row"), _known_id().alias("id"), _digest().alias("digest"))
    stays = rows.join(winners, "digest").where(F.col("id") == F.col("__winner"))
    return stays.dropDuplicates(["digest"]).select("row.*")


def earlier_half(docs: DataFrame) -> Column:
    """The rows whose id lies in the lower half of the range of ids: what an earlier load has brought."""
    ends = docs.agg(F.min("doc_id").cast("double").alias("low"), F.max("doc_id").cast("double").alias("high")).first()
    return F.col("doc_id") < ((ends["low"] or 0.0) + (ends["high"] or 0.0)) / 2


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return exact_groups(docs, earlier_half(docs))


SQL = """
WITH hashed AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM hashed WINDOW g AS (PARTITION BY text_sha256)
"""
