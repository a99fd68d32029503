"""The Merkle manifest against a plain tree over lists."""

import hashlib
import zlib

import cases
import pytest
from pyspark.sql import functions as F

from tidemark.llm import merkle_manifest


def digest(data):
    return hashlib.sha256(data).hexdigest()


def leaf(values):
    told = [None if v is None else str(v).encode() for v in values]
    return digest(b"".join(b"-" if v is None else b"%d:%s" % (len(v), v) for v in told))


def tree(digests, arity):
    """The root, and for each leaf its siblings (before, after) on every level."""
    paths, at = [[] for _ in digests], list(range(len(digests)))
    while len(digests) > 1:
        for path, place in zip(paths, at):
            start = place - place % arity
            path.append(("".join(digests[start:place]), "".join(digests[place + 1 : start + arity])))
        digests = [digest("".join(digests[i : i + arity]).encode()) for i in range(0, len(digests), arity)]
        at = [place // arity for place in at]
    return digests[0], paths


def plain(rows, arity=3):
    by_source = {}
    for row in rows:
        claim = row["text"]
        if claim is not None and row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 2 == 0:
            claim = claim.replace("\n", "")
        first = [row[c] for c in ("doc_id", "source", "lang", "n_chars")]
        by_source.setdefault(row["source"], []).append((row["doc_id"], leaf([*first, row["text"]]), leaf([*first, claim])))
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    grown = []
    for source in order:
        mine = sorted(by_source[source], key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        grown.append((mine, *tree([r[1] for r in mine], arity)))
    if not grown:
        return []
    root, upper = tree([g[1] for g in grown], arity)
    found = []
    for (mine, subroot, paths), above in zip(grown, upper):
        for (doc_id, own, told), path in zip(mine, paths):
            for before, after in path + above:
                told = digest((before + told + after).encode())
            found.append((doc_id, own, subroot, root, digest("".join(a + b for a, b in path + above).encode()), told, told == root))
    return found


def same(got, want):
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_manifest_of_odd_rows(spark):
    docs = cases.documents(spark)
    found = merkle_manifest.verified(docs).collect()
    same(found, plain([r.asDict() for r in docs.collect()]))
    assert {r.verified for r in found} == {True, False}
    assert merkle_manifest.verified(cases.documents(spark, [])).count() == 0


def test_clashing_columns_and_hot_source(spark):
    texts = [(i, f"line {i}\nand more" if i % 3 else None, "en", "hot" if i % 4 else f"s{i}", 3) for i in range(60)] + [(7, "twice", "en", "hot", 1)] * 3
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string, source string, n_chars long")
    odd = docs.select("*", *[F.lit("x").alias(c) for c in ("tree", "i", "n", "digest", "path", "piece", "place", "told", "key", "row", "before", "root")])
    same(merkle_manifest.verified(odd.repartition(5)).collect(), plain([r.asDict() for r in docs.collect()]))


@pytest.mark.parametrize("arity", [2, 5])
def test_other_arities_and_a_single_row(spark, arity):
    docs = spark.createDataFrame([(i, str(i), None, "s", i) for i in range(9)] + [(1, "alone", None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    for some in (docs, docs.where("source IS NULL")):
        want = plain([r.asDict() for r in some.collect()], arity)
        rows = merkle_manifest.manifest(some, arity=arity, told={"text": merkle_manifest.tampered_text()}).collect()
        hexed = [(r.doc_id, r.leaf.hex(), r.subroot.hex(), r.root.hex()) for r in rows]
        assert sorted(hexed) == sorted(w[:4] for w in want)
        for r in rows:
            at = r.leaf.hex()
            for step in r.path:
                at = digest((step.before.hex() + at + step.after.hex()).encode())
            assert at == r.root.hex()
    with pytest.raises(ValueError):
        merkle_manifest.manifest(docs, arity=1)
