"""MinHash near-dedup (operator 10): an inverted join over signature coordinates, confirmed on full shingle sets.

1. Each text becomes the set of its five-word shingles, hashed, and a signature of ``COORDINATES`` minima. Equal word
   sequences are folded to one node at once.
2. Nodes are posted under coordinate-value pairs. Of two nodes that agree in at least ``MATCHES`` coordinates, both hold a
   common pair among their ``PREFIX`` rarest ones, so only those are posted, and frequent pairs (a line that many texts
   share) are skipped where rarer ones exist. A pair of sets at the threshold agrees in fewer coordinates with a chance of
   4 in 10 million.
3. In each list the node that shares most with others leads; every member is confirmed against the leader, and the links
   give components. A tight group of copies is settled here with one pair for each member and leader.
4. Members of a list that aren't connected yet are compared with all the others of it, except with those of their own
   component, which can't add anything. Short lists do so by a join that counts agreeing coordinates and gives each pair
   once; long ones in blocks of ``BLOCK`` nodes, where set sizes and intersections are matrix products and only links come
   out. So no link between components is lost, and no group is expanded into all of its pairs.
5. Components of all links are numbered by their smallest doc_id.

Hot groups: equal texts are folded before any join; posting lists, leaders and hubs meet other rows in plain joins that
adaptive execution splits, or in blocks.

Defined results: null and empty texts have no shingles and are linked with nothing; texts of fewer than five words are one
shingle; a null doc_id is never the smallest of a group unless all are; repeated rows belong to one component; empty tables
give no rows; other columns are carried or ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import BLANKS, BoundedCache, table, whole_text
from tidemark.llm.components import components
from tidemark.session import written

WORDS, THRESHOLD = 5, 75
COORDINATES, MATCHES = 24, 7
PREFIX = COORDINATES - MATCHES + 1
#: Comparisons of a list from which it is dealt in blocks, and nodes of a block.
LONG_LIST, BLOCK = 4096, 1000
CACHED_WORDS, COLUMNS = 200_000, 4096

_RANDOM = np.random.default_rng(20)
_FACTORS = _RANDOM.integers(1, 2**63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TERMS = _RANDOM.integers(0, 2**63, COORDINATES, dtype=np.uint64)
_PLACES = _RANDOM.integers(1, 2**63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def words_of(text: bytes) -> list[bytes]:
    """A-Z lower-cased, cut at the six ASCII blanks."""
    return text.lower().split()


def shingles(words: list[bytes], hash_of) -> np.ndarray:
    """Distinct 64-bit hashes of the shingles; with fewer words than a shingle has, of the whole sequence."""
    if not words:
        return np.zeros(0, dtype=np.uint64)
    if len(words) < WORDS:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed=len(words))], dtype=np.uint64)
    each = np.fromiter(map(hash_of, words), dtype=np.uint64, count=len(words))
    n = len(each) - WORDS + 1
    mixed = sum((each[k : k + n] * _PLACES[k] for k in range(1, WORDS)), each[:n] * _PLACES[0])
    mixed ^= mixed >> np.uint64(31)
    mixed *= np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def signature(hashes: np.ndarray) -> np.ndarray:
    """The minimum of each coordinate's hash, with the coordinate's number in front: one long for a coordinate and value."""
    minima = [((hashes * f + t) >> np.uint64(32)).min() for f, t in zip(_FACTORS, _TERMS)]
    return np.array(minima, dtype=np.int64) | (np.arange(COORDINATES, dtype=np.int64) << 32)


def _key(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def sketches(docs: DataFrame) -> DataFrame:
    """``doc_id, key, n_shingles, signature`` of every row of ``docs``; the key stands for the word sequence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hash_of = BoundedCache(xxhash.xxh64_intdigest, CACHED_WORDS).__getitem__
        for batch in batches:
            keys, sizes, signatures = [], [], []
            for text in batch.column(1):
                words = words_of(text.as_py())
                hashes = shingles(words, hash_of)
                sizes.append(len(hashes))
                keys.append(_key(words) if words else None)
                signatures.append(signature(hashes) if words else None)
            arrays = [batch.column(0), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(signatures, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "key", "n_shingles", "signature"])

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().cast("binary").alias("text"))
    return given.mapInArrow(run, "doc_id long, key binary, n_shingles long, signature array<long>")


def postings(nodes: DataFrame) -> DataFrame:
    """``key, token, prefix, shared, n_shingles, signature`` of nodes under the rarest of their coordinate-value pairs, as
    far as other nodes have them. ``shared``: how often all pairs of the node occur."""
    tokens = nodes.select("key", F.explode("signature").alias("token"))
    common = tokens.groupBy("token").agg(F.count("*").alias("often")).where("often > 1")
    of_node = Window.partitionBy("key")  # COORDINATES rows at most
    placed = tokens.join(common, "token").select(
        "key", "token", F.sum("often").over(of_node).alias("shared"),
        (F.row_number().over(of_node.orderBy("often", "token")) + COORDINATES - F.count("*").over(of_node)).alias("place"),
    )
    kept = placed.where(F.col("place") <= PREFIX)
    prefixes = kept.groupBy("key", "shared").agg(F.collect_list("token").alias("prefix"))
    return prefixes.join(nodes, "key")


def _fits(a: str, b: str) -> Column:
    """Whether the sizes of two sets allow the threshold at all."""
    return 100 * F.least(f"{a}_n", f"{b}_n") >= THRESHOLD * F.greatest(f"{a}_n", f"{b}_n")


def _linked(a: set, b: set) -> bool:
    common = len(a & b)
    return 100 * common >= THRESHOLD * (len(a) + len(b) - common)


def _exact(words: bytes) -> set:
    words = words.split(b" ")
    if len(words) < WORDS:
        return {tuple(words)}
    return set(zip(*(words[k:] for k in range(WORDS))))


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The rows of ``pairs`` (a, b) whose full sets, of words in ``texts`` (key, words), meet the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, known = None, None
        for batch in batches:
            a, b, a_words, b_words = (batch.column(i) for i in range(4))
            keep = []
            for i in range(batch.num_rows):
                if (key := a[i].as_py()) != last:
                    last, known = key, _exact(a_words[i].as_py())
                keep.append(_linked(known, _exact(b_words[i].as_py())))
            yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = texts.select(F.col("key").alias("a"), F.col("words").alias("a_words"))
    right = texts.select(F.col("key").alias("b"), F.col("words").alias("b_words"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "a_words", "b_words").mapInArrow(run, "a binary, b binary")


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``key, words`` for the nodes ``wanted`` (key, doc_id): the words of one of the node's documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [words_of(t.as_py()) for t in batch.column(1)]
            mine = pa.array([_key(w) == k.as_py() for w, k in zip(words, batch.column(0))], pa.bool_())  # ids may repeat
            rows = pa.RecordBatch.from_arrays([batch.column(0), pa.array([b" ".join(w) for w in words], pa.binary())], names=["key", "words"])
            yield rows.filter(mine)

    given = docs.select(F.col("doc_id").cast("long").alias("__id"), whole_text().cast("binary").alias("__text"))
    joined = given.join(wanted, F.col("__id").eqNullSafe(wanted["doc_id"])).select("key", "__text")
    return joined.mapInArrow(run, "key binary, words binary").dropDuplicates(["key"])


def _leader_pairs(lists: DataFrame) -> DataFrame:
    """Pairs of each list's leader and its other members, each pair once."""
    members = lists.select("key", "shared", F.col("n_shingles").alias("b_n"), F.col("signature").alias("b_s"), F.explode("prefix").alias("token"))
    leaders = members.groupBy("token").agg(F.max(F.struct("shared", "key")).alias("lead"), F.count("*").alias("n")).where("n > 1")
    pairs = members.select("key", "token").join(leaders, "token").select(F.col("lead.key").alias("a"), F.col("key").alias("b")).where("a <> b").distinct()
    known = lists.select("key", "n_shingles", "signature")
    return (
        pairs.join(known.toDF("a", "a_n", "a_s"), "a").join(known.toDF("b", "b_n", "b_s"), "b")
        .where((F.size(F.array_intersect("a_s", "b_s")) >= MATCHES) & _fits("a", "b")).select("a", "b")
    )


def _unsettled(lists: DataFrame, roots: DataFrame) -> DataFrame:
    """Postings of lists whose members lie in several components: with the component, whether it isn't the list's largest,
    and the list's counts."""
    rows = lists.select("*", F.explode("prefix").alias("token")).join(roots.withColumnRenamed("node", "key"), "key", "left")
    rows = rows.withColumn("root", F.coalesce("root", "key"))
    sizes = rows.groupBy("token", "root").agg(F.count("*").alias("n"))
    stats = sizes.groupBy("token").agg(F.sum("n").alias("members"), F.max(F.struct("n", "root")).alias("largest")).where("largest.n < members")
    stats = stats.select("token", "members", (F.col("members") - F.col("largest.n")).alias("apart"), F.col("largest.root").alias("largest"))
    return rows.join(stats, "token").select("key", "token", "prefix", "n_shingles", "signature", "root", "members", "apart", (F.col("root") != F.col("largest")).alias("is_apart"))


def _pairs_of_short(rows: DataFrame) -> DataFrame:
    """Pairs of members of different components in short lists, each at its first common list only. Only members apart from
    the list's largest component meet all the others, so a list costs its members times those apart."""
    short = rows.where(F.col("members") * F.col("apart") <= LONG_LIST)
    side = lambda s: short.select(
        F.col("key").alias(s), "token", F.col("prefix").alias(f"{s}_p"), F.col("n_shingles").alias(f"{s}_n"), F.col("signature").alias(f"{s}_s"),
        F.col("root").alias(f"{s}_r"), F.col("is_apart").alias(f"{s}_apart"),
    )
    first = F.array_min(F.array_intersect("a_p", "b_p")) == F.col("token")
    once = ~F.col("b_apart") | (F.col("a") < F.col("b"))
    return (
        side("a").where("a_apart").join(side("b"), "token")
        .where(once & (F.col("a_r") != F.col("b_r")) & _fits("a", "b") & (F.size(F.array_intersect("a_s", "b_s")) >= MATCHES) & first)
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    )


def block_links(rows: pd.DataFrame) -> pd.DataFrame:
    """Links of a block (key, root, is_apart, words) between nodes of different components, as many as connect what the
    block's links connect; two nodes of which neither ``is_apart`` aren't compared."""
    hash_of = BoundedCache(xxhash.xxh64_intdigest, CACHED_WORDS).__getitem__
    rows = rows.drop_duplicates("key")
    sets = [shingles(w.split(b" "), hash_of) for w in rows["words"]]
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    values, column, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = often[column] > 1
    owner, column = owner[shared], column[shared]
    used, column = np.unique(column, return_inverse=True)
    common = np.zeros((len(sets), len(sets)), dtype=np.float32)
    for start in range(0, len(used), COLUMNS):
        inside = (column >= start) & (column < start + COLUMNS)
        part = np.zeros((len(sets), min(COLUMNS, len(used) - start)), dtype=np.float32)
        part[owner[inside], column[inside] - start] = 1
        common += part @ part.T
    common = common.astype(np.int64)
    apart = rows["is_apart"].to_numpy(dtype=bool)
    _, group = np.unique(rows["root"].to_numpy(), return_inverse=True)
    linked = 100 * common >= THRESHOLD * (sizes[:, None] + sizes[None, :] - common)
    linked &= (apart[:, None] | apart[None, :]) & (group[:, None] != group[None, :])
    keys, out = rows["key"].to_numpy(), []
    at = list(range(group.max() + 1))

    def find(g: int) -> int:
        while at[g] != g:
            at[g] = at[at[g]]
            g = at[g]
        return g

    for i in np.flatnonzero(linked.any(axis=1)):
        others = np.flatnonzero(linked[i])
        for j in others[np.unique(group[others], return_index=True)[1]]:
            a, b = find(int(group[i])), find(int(group[j]))
            if a != b:
                at[a] = b
                out.append((keys[i], keys[j]))
    return pd.DataFrame(out, columns=["a", "b"])


def _links_of_long(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """Links between members of different components in long lists.

    The nodes apart from the list's largest component are dealt into blocks, and so are all others; every block of the
    first meets every block of both, once.
    """
    long = rows.where(F.col("members") * F.col("apart") > LONG_LIST)
    first = F.ceil(F.col("apart") * 2 / BLOCK).cast("int")
    rest = F.ceil((F.col("members") - F.col("apart")) * 2 / BLOCK).cast("int")
    dealt = long.select("key", "token", "root", "is_apart", first.alias("first"), rest.alias("rest")).withColumn(
        "own", F.pmod(F.xxhash64("key"), F.when(F.col("is_apart"), F.col("first")).otherwise(F.col("rest"))).cast("int")
    )
    # An apart node of block i meets the apart blocks j (as the pair of i and j in order) and all other blocks.
    with_apart = F.transform(F.sequence(F.lit(0), F.col("first") - 1), lambda j: F.struct(F.lit(0).alias("kind"), F.least("own", j).alias("i"), F.greatest("own", j).alias("j")))
    with_rest = F.transform(F.sequence(F.lit(0), F.col("rest") - 1), lambda j: F.struct(F.lit(1).alias("kind"), F.col("own").alias("i"), j.alias("j")))
    as_rest = F.transform(F.sequence(F.lit(0), F.col("first") - 1), lambda i: F.struct(F.lit(1).alias("kind"), i.alias("i"), F.col("own").alias("j")))
    meets = F.when(F.col("is_apart"), F.concat(with_apart, with_rest)).otherwise(as_rest)
    blocks = dealt.select("key", "token", "root", "is_apart", F.inline(F.transform(meets, lambda m: m))).join(texts, "key")
    return blocks.groupBy("token", "kind", "i", "j").applyInPandas(block_links, "a binary, b binary")


def near_groups(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row of ``docs`` (doc_id, text)."""
    rows = written(sketches(docs), "sketches")
    lists = written(postings(rows.where("n_shingles > 0").select("key", "n_shingles", "signature").distinct()), "postings")
    wanted = rows.select("key", "doc_id").join(lists.select("key"), "key").groupBy("key").agg(F.min("doc_id").alias("doc_id"))
    texts = written(_texts(docs, wanted), "texts")
    links = written(confirmed(_leader_pairs(lists), texts), "links")
    unsettled = written(_unsettled(lists, components(links)), "unsettled")
    more = written(confirmed(_pairs_of_short(unsettled), texts).unionByName(_links_of_long(unsettled, texts)), "links")
    roots = components(links.unionByName(more))
    nodes = rows.groupBy("key").agg(F.min("doc_id").alias("least")).join(roots.withColumnRenamed("node", "key"), "key")
    least = nodes.groupBy("root").agg(F.min("least").alias("component"))
    grouped = written(nodes.select("key", "root").join(least, "root").select("key", "component"), "groups")
    alone = rows.where("key IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("least"))
    known = alone.join(grouped, "key", "left").select("key", F.coalesce("component", "least").alias("component"))
    found = rows.join(known, "key", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def representatives(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, columns as given: of each group of near copies the one with the smallest id, once if
    it is repeated. Documents without words are linked with nothing and stay."""
    no_id = F.expr("CAST(-9223372036854775808 AS BIGINT)")
    known_id = F.coalesce(F.col("doc_id").cast("long"), no_id)
    keeps = near_groups(docs).groupBy(known_id.alias("__id")).agg(F.max("kept").alias("__kept")).where("__kept")
    words = F.sha2(F.regexp_replace(F.translate(whole_text(), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), BLANKS, " "), 256)
    rows = docs.select(F.struct("*").alias("row"), known_id.alias("__id"), words.alias("__words"))
    return rows.join(keeps, "__id").dropDuplicates(["__id", "__words"]).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"))
