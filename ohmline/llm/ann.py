"""Approximate nearest neighbours: inverted file of coarse centroids, product-quantised residuals, exact reranking.

A cell's centroid is the sum of two: one of the coarse centroids, and one of the centroids of what these leave out.
So the cells can keep in proportion to the rows while both lists, and the codebooks of what is left after them, are
fitted on the driver from a bounded sample. Every row is indexed.

A query looks into cells by the inner product with their centroids, raised by how far the cell's farthest row may lie
off it, until they hold the share of all rows that sampled queries showed to be needed. It rates the cells' rows by
asymmetric distance tables. What a code leaves out of its row is known by its length, so a table's score has bounds;
rows that may be among the best by these are ranked exactly, however many they are: quantisation loses none.
Neighbouring cells are put together to regions of a bounded number of rows; a task holds one region and some of the
queries that look into it. The best candidates of each query, of all regions, are then ranked by the exact inner
product on the original vectors, in double precision, summed in the order of the components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ohmline.shared import cut, drop_table, ship

ship(__name__)

NEIGHBOURS = 20
#: Bound of the training sample; rows for each of its centroids at least, and rows of the table that a cell is meant to hold.
SAMPLE_ROWS, ROWS_PER_CENTROID, ROWS_PER_CELL = 20_000, 20, 64
#: Rows of the sample that codebooks are fitted from.
BOOK_ROWS = 8_000
STEPS = 8
SUBSPACE, CODES = 2, 256
#: Share of the true neighbours that the cells looked into should hold, within the sample; sampled queries that are
#: asked for it; the least candidates in the cells for each neighbour.
TARGET, ASKED, LEAST_CANDIDATES = 0.97, 400, 20
#: How far a row may lie off its centroid in a query's direction: times its distance over the root of the components.
LEAN = 2.0
#: Candidates of a region, for each neighbour asked for, that are handed on.
RERANK = 3
REGION_ROWS, LOT_QUERIES = 4_096, 4_096
#: Queries that are ranked at a time, to bound the memory of a task; candidate lists that are merged at a time.
BLOCK, LISTS = 64, 8_192
#: Cells that are sorted, at most, to find where the nearest ones end.
FEW_CELLS = 4096


def usable(vector: Column) -> Column:
    """Not null, all components present and finite, and not all zero."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(odd, F.lit(True)) & F.exists(vector, lambda x: x != 0)


def matrix(column: pa.Array | pa.ChunkedArray, size: int) -> np.ndarray:
    """Rows of an Arrow column of equally long lists."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten(), dtype=np.float64).reshape(-1, size)


def nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each row."""
    found = np.empty(len(rows), np.int64)
    norms = (centres**2).sum(1)
    for at in range(0, len(rows), 4_096):
        part = rows[at : at + 4_096]
        found[at : at + 4_096] = (norms - 2 * part @ centres.T).argmin(1)
    return found


def k_means(rows: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Lloyd's steps from distinct sampled rows; a centre without rows moves to a random row."""
    start = np.unique(rows, axis=0)
    centres = start[rng.choice(len(start), min(k, len(start)), replace=False)]
    for _ in range(STEPS):
        home = nearest(rows, centres)
        n = np.bincount(home, minlength=len(centres))
        sums = np.stack([np.bincount(home, weights=x, minlength=len(centres)) for x in rows.T], axis=1)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], rows[rng.integers(len(rows), size=len(centres))])
    return centres


def fit(sample: np.ndarray, total: int, asked: np.ndarray | None = None, seed: int = 7) -> dict:
    """Both lists of centroids for ``total`` rows, codebooks, and the share of rows to look into, from sampled rows and queries.

    Without ``asked``, some of the sample's rows are the queries.
    """
    rng = np.random.default_rng(seed)
    scale = float(np.abs(sample).max())
    sample = np.unique(sample / scale, axis=0)  # else many equal rows would decide what is measured
    asked = sample if asked is None or not len(asked) else np.unique(asked / scale, axis=0)
    cells, most = max(1, total // ROWS_PER_CELL), max(1, len(sample) // ROWS_PER_CENTROID)
    first = k_means(sample, int(np.clip(np.ceil(np.sqrt(cells)), 1, most)), rng)
    rest = sample - first[nearest(sample, first)]
    second = k_means(rest, int(np.clip(-(-cells // len(first)), 1, most)), rng)
    model = {"size": sample.shape[1], "scale": scale, "first": first, "second": second}
    cell, rest = placed(sample, model)
    model["share"] = looked_into(sample, cell, rest, asked[rng.choice(len(asked), min(ASKED, len(asked)), replace=False)], model)
    rest = padded(rest[rng.permutation(len(rest))[:BOOK_ROWS]])
    books = []
    for at in range(0, rest.shape[1], SUBSPACE):
        book = k_means(rest[:, at : at + SUBSPACE], CODES, rng)
        books.append(np.vstack([book, np.full((CODES - len(book), SUBSPACE), 1e9)]))  # padding that no residual is near to
    return model | {"books": np.array(books)}


def placed(rows: np.ndarray, model: dict) -> tuple[np.ndarray, np.ndarray]:
    """Cell of each scaled row, and what the cell's centroid leaves out."""
    one = nearest(rows, model["first"])
    rest = rows - model["first"][one]
    two = nearest(rest, model["second"])
    return one * len(model["second"]) + two, rest - model["second"][two]


def cell_products(points: np.ndarray, model: dict) -> np.ndarray:
    """Inner product of each point with the centroid of each cell."""
    return ((points @ model["first"].T)[:, :, None] + (points @ model["second"].T)[:, None, :]).reshape(len(points), -1)


def raised(scores: np.ndarray, points: np.ndarray, far: np.ndarray) -> np.ndarray:
    """The cells' inner products with each point, raised by what their farthest rows, ``far`` off, may add to it."""
    return scores + LEAN / np.sqrt(points.shape[1]) * np.linalg.norm(points, axis=1)[:, None] * far


def looked_into(sample: np.ndarray, cell: np.ndarray, rest: np.ndarray, asked: np.ndarray, model: dict) -> float:
    """The share of rows that a query must look into for ``TARGET`` of its neighbours, measured within the sample.

    Neighbours in the whole table are nearer than those in a sample of it, so the number errs on the safe side.
    """
    held = np.bincount(cell, minlength=len(model["first"]) * len(model["second"]))
    far = np.zeros(len(held))
    np.maximum.at(far, cell, np.linalg.norm(rest, axis=1))
    shares, place = [], {row.tobytes(): i for i, row in enumerate(sample)}
    block = max(1, min(BLOCK, 4_000_000 // len(held)))
    for at in range(0, len(asked), block):
        points = asked[at : at + block]
        score = sample @ points.T
        for i, point in enumerate(points):
            score[place.get(point.tobytes(), []), i] = -np.inf  # its own row
        top = np.argsort(-score.T, axis=1, kind="stable")[:, : min(NEIGHBOURS, len(sample) - 1)]
        order = np.argsort(-raised(cell_products(points, model), points, far), axis=1, kind="stable")
        upto = np.empty(order.shape)
        np.put_along_axis(upto, order, np.cumsum(held[order], axis=1) / len(sample), axis=1)
        shares.append(np.take_along_axis(upto, cell[top], axis=1).ravel())
    shares = np.concatenate(shares)
    return float(np.quantile(shares, TARGET, method="higher")) if len(shares) else 1.0


def padded(rows: np.ndarray) -> np.ndarray:
    """Rows with zeros up to a whole number of subspaces."""
    return np.pad(rows, ((0, 0), (0, -rows.shape[1] % SUBSPACE)))


def encoded(rest: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of what the centroids leave out of some rows, and the length of what the codes leave out of that."""
    parts = padded(rest).reshape(len(rest), -1, SUBSPACE)
    codes = np.array([nearest(parts[:, i], book) for i, book in enumerate(books)], np.uint8).T
    return codes, np.linalg.norm(parts - books[np.arange(len(books)), codes], axis=(1, 2))


def indexed(vectors: DataFrame, model) -> DataFrame:
    """(vec_id, vector, cell, far, code, off) of each row; ``far`` is its distance to the centroid, ``off`` that to centroid and code."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            if batch.num_rows:
                rows = matrix(batch.column("vector"), m["size"]) / m["scale"]
                cell, rest = placed(rows, m)
                codes, off = encoded(rest, m["books"])
                off = off * (1 + 1e-9) + np.linalg.norm(rows, axis=1) * 1e-12  # what rounding may add
                found = [pa.array(cell, pa.int32()), pa.array(np.linalg.norm(rest, axis=1)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(off)]
                yield pa.record_batch([batch.column("vec_id"), batch.column("vector"), *found], ["vec_id", "vector", "cell", "far", "code", "off"])

    return vectors.mapInArrow(index, f"vec_id long, vector {vectors.schema['vector'].dataType.simpleString()}, cell int, far double, code binary, off double")


def regions_of(held: np.ndarray, rows: int = REGION_ROWS) -> np.ndarray:
    """Region of each cell: cells one after the other, until a region would hold more than ``rows``."""
    region, found, here = np.empty(len(held), np.int64), 0, 0
    for i, n in enumerate(held.tolist()):
        if here and here + n > rows:
            found, here = found + 1, 0
        region[i] = found
        here += n
    return region


def nearest_cells(scores: np.ndarray, held: np.ndarray, least: float) -> np.ndarray:
    """The cells of the highest scores that hold ``least`` rows together (all, if they don't); ties go to the smaller cell.

    Cells are parted at a pivot and only the side that the limit lies in is looked into further, so few are ever sorted.
    """
    rest, kept = np.arange(len(scores)), []
    while len(rest) > FEW_CELLS:
        pivot = np.median(scores[rest[:: len(rest) // 64]])
        above = scores[rest] > pivot
        if not above.any():
            break  # at the pivot are the highest
        high = rest[above]
        rows = held[high].sum()
        if rows >= least:
            rest = high
        else:
            kept.append(high)
            rest, least = rest[~above], least - rows
    order = rest[np.argsort(-scores[rest], kind="stable")]
    kept.append(order[: int(np.searchsorted(np.cumsum(held[order]), least)) + 1])
    return np.concatenate(kept)


def probes(queries: DataFrame, model, plan, k: int) -> DataFrame:
    """(query_id, query, region, cells) for each region that a query looks into; ``cells`` is a packed list."""

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, (held, far, region) = model.value, plan.value
        least = max(m["share"] * held.sum(), k * LEAST_CANDIDATES + 1)
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                points = matrix(part.column("vector"), m["size"])
                row, where, cells = [], [], []
                for i in range(len(points)):  # one query at a time: there may be a million cells
                    point = points[i : i + 1] / np.abs(points[i]).max()
                    scores = raised(cell_products(point, m), point, far)[0]
                    chosen = np.sort(nearest_cells(scores, held, least))
                    chosen = chosen[held[chosen] > 0]
                    turns = np.flatnonzero(np.diff(region[chosen], prepend=-1))
                    for part_ in np.split(chosen, turns[1:]):
                        row.append(i)
                        where.append(int(region[part_[0]]))
                        cells.append(part_.astype("<i4").tobytes())
                take = pa.array(row, pa.int64())
                yield pa.record_batch(
                    [part.column("vec_id").take(take), part.column("vector").take(take), pa.array(where, pa.int32()), pa.array(cells, pa.binary())],
                    ["query_id", "query", "region", "cells"],
                )

    return queries.mapInArrow(probe, f"query_id long, query {queries.schema['vector'].dataType.simpleString()}, region int, cells binary")


LISTED = "query_id long, ids binary, scores binary"


def searcher(model, k: int):
    """A function from some queries and the rows of a region to each query's best rows there, by distance tables and exact ranks."""

    def search(queries: pa.Table, rows: pa.Table) -> pa.Table:
        m, found = model.value, []
        if queries.num_rows and rows.num_rows:
            rows = rows.take(pa.array(np.argsort(rows.column("vec_id").to_numpy(), kind="stable")))
            ids, cell, off = (rows.column(c).to_numpy() for c in ("vec_id", "cell", "off"))
            codes = np.frombuffer(b"".join(rows.column("code").to_pylist()), np.uint8).reshape(len(ids), -1)
            vectors = matrix(rows.column("vector"), m["size"])
            cells, cell = np.unique(cell, return_inverse=True)
            asked, points = queries.column("query_id").to_numpy(), matrix(queries.column("query"), m["size"])
            looked = np.zeros((len(asked), len(cells)), bool)
            for i, x in enumerate(queries.column("cells").to_pylist()):
                looked[i, np.flatnonzero(np.isin(cells, np.frombuffer(x, "<i4")))] = True
            near = np.lexsort((asked, looked.argmax(1)))  # queries that look into the same cells stand together
            for at in range(0, len(near), BLOCK):
                part = near[at : at + BLOCK]
                some = np.flatnonzero(looked[part].any(0)[cell])
                found += best(asked[part], points[part], looked[part], ids[some], vectors[some], cells, cell[some], codes[some], off[some], m, k)
        kinds = (pa.int64(), pa.binary(), pa.binary())
        return pa.table([pa.array([f[i] for f in found], kind) for i, kind in enumerate(kinds)], names=["query_id", "ids", "scores"])

    return search


def greatest(scores: np.ndarray, n: int) -> np.ndarray:
    """The n-th greatest score of each line; the least number there is, if a line has fewer."""
    return np.full(len(scores), -np.inf) if scores.shape[1] < n else np.partition(scores, scores.shape[1] - n, axis=1)[:, scores.shape[1] - n]


def best(asked, points, looked, ids, vectors, cells, cell, codes, off, model, k) -> list[tuple[int, bytes, bytes]]:
    """The ``RERANK`` x ``k`` best rows for each query of a block; ``ids`` rise, ties go to the first.

    A table holds, for one subspace, the inner products of every code with the queries' parts; a row's score is that of
    its cell plus one entry of each table. By the length of what its code leaves out, the exact score is that, more or
    less; rows that can't reach the k-th surest one are out, the others are ranked by their vectors.
    """
    own = np.zeros((len(asked), len(ids)), bool)
    for i, (a, b) in enumerate(zip(np.searchsorted(ids, asked), np.searchsorted(ids, asked, "right"))):
        own[i, a:b] = True
    scaled = points / np.abs(points).max(1, keepdims=True)
    tables = np.einsum("mcs,qms->mcq", model["books"], padded(scaled).reshape(len(points), -1, SUBSPACE))
    scores = cell_products(scaled, model)[:, cells].T[cell]
    for table, code in zip(tables, codes.T):
        scores += table.take(code, axis=0)
    scores[~looked.T[cell] | own.T] = -np.inf
    scores = np.ascontiguousarray(scores.T)
    doubt = np.linalg.norm(scaled, axis=1)[:, None] * off
    may_be = (scores + doubt >= greatest(scores - doubt, k)[:, None]) & (scores > -np.inf)
    some = np.flatnonzero(may_be.any(0))
    ids, may_be = ids[some], may_be[:, some]
    exact = np.where(may_be, points @ vectors[some].T, -np.inf)
    keep, out = RERANK * k, []
    for name, line, bound in zip(asked.tolist(), exact, greatest(exact, keep)):
        over = np.flatnonzero(line > bound)
        if len(over) < keep and bound > -np.inf:
            over = np.concatenate((over, np.flatnonzero(line == bound)[: keep - len(over)]))
        if len(over):
            out.append((name, ids[over].astype("<i8").tobytes(), line[over].astype("<f8").tobytes()))
    return out


def merger(keep: int):
    """A function from the lists of some queries to the (query_id, vec_id) of each query's ``keep`` best."""

    def merge(table: pa.Table) -> pa.Table:
        lists = [np.frombuffer(x, "<i8") for x in table.column("ids").to_pylist()]
        asked = np.repeat(table.column("query_id").to_numpy(), [len(x) for x in lists])
        ids = np.concatenate(lists)
        scores = np.frombuffer(b"".join(table.column("scores").to_pylist()), "<f8")
        order = np.lexsort((ids, -scores, asked))
        asked, ids = asked[order], ids[order]
        starts = np.flatnonzero(np.diff(asked, prepend=asked[0] - 1))
        rank = np.arange(len(asked)) - np.repeat(starts, np.diff(np.append(starts, len(asked))))
        return pa.table({"query_id": pa.array(asked[rank < keep]), "vec_id": pa.array(ids[rank < keep])})

    return merge


def product(a: Column, b: Column) -> Column:
    """Inner product in double precision, summed in the order of the components."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def search(
    vectors: DataFrame,
    queries: Column,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = NEIGHBOURS,
    sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """The ``k`` nearest found of each row that the condition ``queries`` picks: query_id, rank, vec_id, score.

    * Vectors that are null, all zero, or hold null or non-finite components take no part, nor do rows without
      an id or whose length is not the most common one (of equally common lengths, the smallest).
    * Ties go to the smaller id. A repeated id counts once, with its best score; rows with the query's id are its own.
    * Of equal vectors, those of the ``k + 1`` least ids are indexed: no other can be among a query's ``k`` nearest.
    * Queries with fewer than ``k`` candidates get them all; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    rows = vectors.where(usable(F.col(vector_col)) & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector"), F.coalesce(queries, F.lit(False)).alias("asked")
    )
    lengths = rows.groupBy(F.size("vector").alias("size")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "size").first()
    if lengths is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.where(F.size("vector") == lengths["size"])
    part = min(1 << 40, (sample_rows << 40) // lengths["n"])
    sample = rows.where(F.pmod(F.xxhash64("vec_id", F.lit("ann")), F.lit(1 << 40)) < part).select("vec_id", "vector").limit(2 * sample_rows).toArrow()
    if not sample.num_rows:
        sample = rows.select("vec_id", "vector").limit(sample_rows).toArrow()
    order = np.argsort(sample.column("vec_id").to_numpy(), kind="stable")
    some = rows.where("asked").select("vec_id", "vector").orderBy(F.xxhash64("vec_id", F.lit("ann")), "vec_id").limit(ASKED).toArrow()
    model = spark.sparkContext.broadcast(fit(matrix(sample.column("vector"), lengths["size"])[order], lengths["n"], matrix(some.column("vector"), lengths["size"])))
    equal = rows.select("vec_id", "vector", F.xxhash64("vector").alias("__h"))
    by_id = Window.partitionBy("__h", "vector").orderBy("vec_id")
    folded = equal.withColumn("__n", F.dense_rank().over(by_id)).where(F.col("__n") <= k + 1).dropDuplicates(["__h", "vector", "vec_id"])
    index = cut(indexed(folded.select("vec_id", "vector"), model))
    cells = index.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("far")).collect()  # as many as the sample's bound allows
    held = np.zeros(len(model.value["first"]) * len(model.value["second"]), np.int64)
    far = np.zeros(len(held))
    for cell in cells:
        held[cell["cell"]], far[cell["cell"]] = cell["n"], cell["far"]
    region = regions_of(held)
    looked = cut(probes(rows.where("asked").select("vec_id", "vector"), model, spark.sparkContext.broadcast((held, far, region)), k))
    chunks = spark.createDataFrame(
        [(c["cell"], int(region[c["cell"]]), int(-(-c["n"] // REGION_ROWS))) for c in cells], "cell int, region int, chunks int"
    )
    lots = looked.groupBy("region").agg(F.ceil(F.count(F.lit(1)) / LOT_QUERIES).cast("int").alias("lots"))
    plan = chunks.join(lots, "region")
    dealt_rows = index.select("vec_id", "vector", "cell", "code", "off").join(plan, "cell").select(
        "region", F.pmod(F.xxhash64("vec_id"), F.col("chunks")).cast("int").alias("chunk"),
        F.explode(F.sequence(F.lit(0), F.col("lots") - 1)).alias("lot"), "vec_id", "vector", "cell", "code", "off",
    )
    by_region = plan.groupBy("region").agg(F.max("chunks").alias("chunks"), F.max("lots").alias("lots"))
    dealt_queries = looked.join(by_region, "region").select(
        "region", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"),
        F.pmod(F.xxhash64("query_id"), F.col("lots")).cast("int").alias("lot"), "query_id", "query", "cells",
    )
    place, keep = ["region", "chunk", "lot"], RERANK * k
    found = cut(dealt_queries.groupBy(*place).cogroup(dealt_rows.groupBy(*place)).applyInArrow(searcher(model, k), LISTED))
    turns = max(1, -(-found.count() // LISTS))
    merged = found.groupBy(F.pmod(F.xxhash64("query_id"), F.lit(turns))).applyInArrow(merger(keep), "query_id long, vec_id long")
    asked = rows.where("asked").select(F.col("vec_id").alias("query_id"), F.col("vector").alias("query"))
    pairs = merged.join(index.select("vec_id", "vector"), "vec_id").join(asked, "query_id")
    ranked = pairs.select("query_id", "vec_id", product(F.col("query"), F.col("vector")).alias("score")).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order_ = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    drop_table(looked)
    return ranked.withColumn("rank", F.row_number().over(order_)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
