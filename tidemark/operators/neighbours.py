"""Nearest neighbours of many queries at once, by cells around learned centres.

Centres are fitted on a bounded sample; every row is stored under its nearest one, with the cell's radius known. A query
first looks into its nearest cells, which gives it ``n`` rows and the distance of the last. No row of a cell can be nearer
than the centre less the radius, so for exact results it then looks into all cells that may still hold a nearer one, and
into no others. Cells near each other make a block of rows, a cell with too many rows several, and queries are cut into blocks
as well: a task meets one block of either, so a row is sent once for each block of queries and a query once for each block of
rows that it looks into, not for each cell. Products of matrices pass over pairs that can't be among the nearest; what they let
through is measured from differences. Of equal vectors only the ``n + 1`` smallest keys are kept, as others are never among ``n``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ranks import top_per_group
from tidemark.session import written

#: Rows that centres are fitted on, most cells, most rows of a block, least queries of a block, queries and rows multiplied at a time,
#: pairs measured at a time.
SAMPLE, MOST_CELLS, BLOCK, QUERIES, TILE, CHUNK, PAIRS = 20_000, 1024, 50_000, 500, 256, 4096, 50_000
FIRST_CELLS, SEED = 2, 42


def fitted_centres(rows: DataFrame, key: str, vector: str, cells: int | None = None) -> np.ndarray:
    """Centres (cells by dimensions) from the ``SAMPLE`` rows whose keys hash lowest; as many cells as the root of the sample."""
    sample = rows.orderBy(F.xxhash64(F.col(key).cast("string"), F.lit(SEED)), key).limit(SAMPLE).select(array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    sample = written(sample, "centre-sample")
    size = sample.count()
    if not size:
        raise ValueError("no rows to fit centres on")
    return np.array(KMeans(k=cells or max(1, min(MOST_CELLS, int(np.sqrt(size)))), seed=SEED, maxIter=10).fit(sample).clusterCenters())


def _distances(vectors: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Euclidean distances of all pairs, from differences, so that equal vectors give 0."""
    return np.sqrt(np.stack([((others - v) ** 2).sum(axis=1) for v in vectors])) if len(vectors) else np.zeros((0, len(others)))


def in_cells(rows: DataFrame, key: str, vector: str, centres: np.ndarray) -> DataFrame:
    """``id, vector, cell, reach`` of every row: its nearest centre and the distance from it."""
    sent = rows.sparkSession.sparkContext.broadcast(centres)

    @F.pandas_udf("cell int, reach double")
    def nearest(vectors: pd.Series) -> pd.DataFrame:
        found = _distances(np.stack(vectors.to_list()), sent.value) if len(vectors) else np.zeros((0, len(sent.value)))
        cell = found.argmin(axis=1)
        return pd.DataFrame({"cell": cell, "reach": found[np.arange(len(cell)), cell]})

    known = rows.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("vector")).filter(F.col("id").isNotNull() & F.col("vector").isNotNull())
    return known.withColumn("_at", nearest("vector")).select("id", "vector", "_at.cell", "_at.reach")


def _blocks_of(centres: np.ndarray, counts: dict[int, int]) -> dict[int, tuple[int, int]]:
    """Of each filled cell its first block and their number: cells are taken from one to the nearest left, until a block is full."""
    left, found, block, size = sorted(counts), {}, 0, 0
    at = left[0]
    while left:
        at = left[int(_distances(centres[[at]], centres[left])[0].argmin())]
        left.remove(at)
        if size and size + counts[at] > BLOCK:
            block, size = block + 1, 0
        pieces = -(-counts[at] // BLOCK)
        found[at] = (block, pieces)
        block, size = (block + pieces, 0) if pieces > 1 else (block, size + counts[at])
    return found


def _visits(queries: DataFrame, centres: np.ndarray, radii: dict[int, float], blocks: dict[int, tuple[int, int]], first: int, bound: str | None) -> DataFrame:
    """``queries`` with ``block, cells``, a row for each block to look into and the cells wanted there: the ``first`` nearest ones, or, with a
    ``bound`` column, the others that may hold a row within it."""
    cells = np.array(sorted(blocks))
    sent = queries.sparkSession.sparkContext.broadcast((centres[cells], np.array([radii[c] for c in cells]), cells, [blocks[c] for c in cells]))

    @F.pandas_udf("array<array<int>>")
    def wanted(vectors: pd.Series, bounds: pd.Series) -> pd.Series:
        centres, reach, cells, blocks = sent.value
        found = _distances(np.stack(vectors.to_list()), centres) if len(vectors) else np.zeros((0, len(centres)))
        out = []
        for row, limit in zip(found, bounds):
            order = np.argsort(row, kind="stable")
            if not bound:
                order = order[:first]
            else:
                within = np.inf if limit is None or np.isnan(limit) else limit
                order = order[first:]
                order = order[(row[order] - reach[order]) * (1 - 1e-9) - 1e-9 <= within]
            by_block = {}
            for i in order:
                for block in range(blocks[i][0], sum(blocks[i])):
                    by_block.setdefault(block, [block]).append(int(cells[i]))
            out.append(list(by_block.values()))
        return pd.Series(out, dtype=object)

    limits = F.col(bound) if bound else F.lit(None).cast("double")
    met = queries.withColumn("_visit", F.explode(wanted("vector", limits)))
    return met.select(*queries.columns, F.col("_visit")[0].alias("block"), F.expr("slice(_visit, 2, size(_visit) - 1)").alias("cells"))


def _best(query: np.ndarray, row: np.ndarray, distance: np.ndarray, n: int) -> tuple[np.ndarray, ...]:
    """Of each query its nearest ``n`` rows, the first of equally near ones."""
    order = np.lexsort((row, distance, query))
    query = query[order]
    kept = np.arange(len(query)) - np.searchsorted(query, query) < n
    return query[kept], row[order][kept], distance[order][kept]


def nearest_pairs(
    ids: np.ndarray, vectors: np.ndarray, cells: np.ndarray, query_ids: np.ndarray, asked: np.ndarray, wanted: np.ndarray, bounds: np.ndarray, n: int
) -> tuple[np.ndarray, ...]:
    """Query, row and distance of the nearest ``n`` rows, within its bound, of each query in the cells that it wants (queries by cells numbered in
    ``cells``); rows ascend by id, and pairs of one id are left out.

    With s the product of both vectors less half the row's square, half the squared distance is half the query's square less s; pairs
    whose s is below what the nearest ones so far have, less what rounding can take, are passed over.
    """
    half, own = (vectors**2).sum(axis=1) / 2, (asked**2).sum(axis=1) / 2
    slack = 1e-12 * (own + half.max())
    chunks = [(c, rows[i : i + CHUNK]) for c in range(wanted.shape[1]) for rows in [np.flatnonzero(cells == c)] for i in range(0, len(rows), CHUNK)]
    chunks = [(c, rows, vectors[rows].T.copy(), half[rows]) for c, rows in chunks]
    parts = []
    for start in range(0, len(asked), TILE):
        tile = np.arange(start, min(start + TILE, len(asked)))
        least = own[tile] - bounds[tile] ** 2 / 2 - slack[tile]
        best, new, waiting = (np.zeros(0, int), np.zeros(0, int), np.zeros(0)), [], 0
        for at, (c, rows, columns, halves) in enumerate(chunks):
            who = np.flatnonzero(wanted[tile, c])
            if len(who):
                s = asked[tile[who]] @ columns - halves
                unbound = np.flatnonzero(~np.isfinite(least[who]))
                if len(unbound) and len(rows) > n:
                    last = np.partition(s[unbound], len(rows) - n - 1, axis=1)[:, len(rows) - n - 1]  # the row itself may be one of n + 1
                    least[who[unbound]] = np.fmax(least[who[unbound]], last - slack[tile[who[unbound]]])
                q, r = np.nonzero(~(s < least[who][:, None]))
                q, r = who[q], rows[r]
                other = query_ids[tile[q]] != ids[r]
                q, r = q[other], r[other]
                far = [np.sqrt(((vectors[r[i : i + PAIRS]] - asked[tile[q[i : i + PAIRS]]]) ** 2).sum(axis=1)) for i in range(0, len(q), PAIRS)]
                new.append((q, r, np.concatenate([np.zeros(0), *far])))
                waiting += len(q)
            if new and (waiting > n * len(tile) or at == len(chunks) - 1):
                best, new, waiting = _best(*map(np.concatenate, zip(best, *new)), n), [], 0
                full = np.flatnonzero(np.bincount(best[0], minlength=len(tile)) == n)
                last = best[2][np.searchsorted(best[0], full, side="right") - 1]
                least[full] = np.fmax(least[full], own[tile[full]] - last**2 / 2 - slack[tile[full]])
        if new:
            best = _best(*map(np.concatenate, zip(best, *new)), n)
        parts.append((tile[best[0]], *best[1:]))
    return tuple(np.concatenate(x) for x in zip(*parts))


def _nearest_in_blocks(stored: DataFrame, visits: DataFrame, blocks: dict[int, tuple[int, int]], pieces: int, n: int) -> DataFrame:
    """``query_id, id, distance``: the nearest ``n`` rows of every visited block; queries are cut into ``pieces``."""
    context = stored.sparkSession.sparkContext
    known = stored.sparkSession.createDataFrame([(int(c), *b) for c, b in blocks.items()], "cell int, first int, many int")
    hashed = lambda c, count: F.pmod(F.xxhash64(F.col(c).cast("string")), count).cast("int")
    rows = stored.join(known, "cell").select("id", "vector", "cell", (F.col("first") + hashed("id", F.col("many"))).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(pieces - 1))).alias("q"))
    bound = F.col("bound") if "bound" in visits.columns else F.lit(None).cast("double")
    asked = visits.select("query_id", "vector", "cells", bound.alias("bound"), "block", hashed("query_id", F.lit(pieces)).alias("q"))

    def nearest(block: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(block) or not len(queries):
            return pd.DataFrame({"query_id": queries["query_id"][:0], "id": block["id"][:0], "distance": pd.Series([], dtype=float)})
        block = block.sort_values("id", kind="stable")
        ids, query_ids = block["id"].to_numpy(), queries["query_id"].to_numpy()
        filled, cells = np.unique(block["cell"].to_numpy(), return_inverse=True)
        wanted = np.zeros((len(queries), len(filled)), dtype=bool)
        for row, some in zip(wanted, queries["cells"]):
            row[:] = np.isin(filled, some)
        bounds = queries["bound"].astype(float).fillna(np.inf).to_numpy()
        q, r, distance = nearest_pairs(ids, np.stack(block["vector"].to_list()), cells, query_ids, np.stack(queries["vector"].to_list()), wanted, bounds, n)
        return pd.DataFrame({"query_id": query_ids[q], "id": ids[r], "distance": distance})

    kind = stored.schema["id"].dataType.simpleString()
    tasks = max(context.defaultParallelism, pieces * (1 + max(first + many - 1 for first, many in blocks.values())))
    both = [part.repartition(tasks, "block", "q") for part in (rows, asked)]
    return both[0].groupBy("block", "q").cogroup(both[1].groupBy("block", "q")).applyInPandas(nearest, f"query_id {kind}, id {kind}, distance double")


def nearest_rows(
    rows: DataFrame, queries: DataFrame, key: str, vector: str, n: int, cells: int | None = None, first: int = FIRST_CELLS, exact: bool = True
) -> DataFrame:
    """``query_id, id, distance, position``: the nearest ``n`` other rows of every row of ``queries`` (key, vector).

    Exact by default; ``exact=False`` looks into the ``first`` nearest cells only. Rows without a key or vector are passed over;
    keys are unique; ties go to the smaller key; an empty table gives no rows.
    """
    nearest = [F.asc("distance"), F.asc("id")]
    if rows.isEmpty():
        kind = rows.schema[key].dataType.simpleString()
        return rows.sparkSession.createDataFrame([], f"query_id {kind}, id {kind}, distance double, position int")
    centres = fitted_centres(rows.filter(F.col(key).isNotNull() & F.col(vector).isNotNull()), key, vector, cells)
    place = F.dense_rank().over(Window.partitionBy("vector").orderBy("id"))
    stored = written(in_cells(rows, key, vector, centres).withColumn("_place", place).filter(F.col("_place") <= n + 1).drop("_place"), "cells")
    sizes = {r.cell: (r.radius, r.n) for r in stored.groupBy("cell").agg(F.max("reach").alias("radius"), F.count(F.lit(1)).alias("n")).collect()}  # two numbers a cell
    radii, blocks = {c: r for c, (r, _) in sizes.items()}, _blocks_of(centres, {c: count for c, (_, count) in sizes.items()})
    asked = written(in_cells(queries, key, vector, centres).select(F.col("id").alias("query_id"), "vector"), "queries")
    size, parallel = asked.count(), rows.sparkSession.sparkContext.defaultParallelism
    many = 1 + max(first + count - 1 for first, count in blocks.values())
    pieces = max(1, -(-size // BLOCK), min(-(-size // QUERIES), -(-4 * parallel // many)))
    found = _nearest_in_blocks(stored, _visits(asked, centres, radii, blocks, first, None), blocks, pieces, n)
    found = written(top_per_group(found, ["query_id"], nearest, n).drop("position"), "first-cells")
    if exact:
        last = found.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= n, F.max("distance")).alias("bound"))
        bounded = written(asked.join(last, "query_id", "left"), "bounds")
        found = found.unionByName(_nearest_in_blocks(stored, _visits(bounded, centres, radii, blocks, first, "bound"), blocks, pieces, n))
    return top_per_group(found, ["query_id"], nearest, n)
