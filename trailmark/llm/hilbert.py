"""Approximate nearest neighbours along shifted space-filling curves.

For the inner product, vectors get one more component that brings all of them to the largest norm, queries are scaled
to that norm with 0 there: the nearest by angle is then the largest inner product. Each of several orderings projects
the vectors by a random rotation, shifts the projections and sorts by the Hilbert key; Spark range-partitions the keys.
A query stands in each ordering at its own key, and the `share` of all rows on either side is its window. Orderings
are cut into blocks of consecutive rows; a block and the queries whose windows reach it meet in one task, which
computes exact inner products. The best of all windows merge, equal vectors are one row until the end.

The window is a share of the rows, since neighbours of nearly independent directions (as in data without clusters)
are spread along any curve: a fixed window loses recall as the table grows. Clustered data can do with less.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.llm.tables import written

ORDERINGS = 16
DIMENSIONS = 8
BITS = 7
SHARE = 0.04
BLOCK = 2048
FLUSH = 50_000  # distinct vectors that a collecting task holds
SEED = 20240131


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place along the Hilbert curve of integer points (rows) with `bits` bits a coordinate (Skilling, 2004)."""
    x, n = cells.astype(np.int64).copy(), cells.shape[1]
    bit = 1 << (bits - 1)
    while bit > 1:
        below = bit - 1
        for i in range(n):
            set_ = (x[:, i] & bit) != 0
            swap = np.where(set_, 0, (x[:, 0] ^ x[:, i]) & below)
            x[:, 0] ^= np.where(set_, below, swap)
            x[:, i] ^= swap
        bit >>= 1
    for i in range(1, n):
        x[:, i] ^= x[:, i - 1]
    flip, bit = np.zeros(len(x), dtype=np.int64), 1 << (bits - 1)
    while bit > 1:
        flip ^= np.where(x[:, n - 1] & bit, bit - 1, 0)
        bit >>= 1
    x ^= flip[:, None]
    key = np.zeros(len(x), dtype=np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | x[:, i] >> b & 1
    return key


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def distinct_vectors(rows: DataFrame, keep: int) -> tuple[DataFrame, DataFrame]:
    """(node, vector, ids): each distinct vector with its `keep` smallest ids; (node, query_id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, tuple[list, list[int], list[int]]] = {}

        def emit() -> pa.RecordBatch:
            out = pa.RecordBatch.from_pydict({
                "same": pa.array(list(held), pa.binary()), "vector": pa.array([v for v, _, _ in held.values()], pa.list_(pa.float64())),
                "ids": pa.array([sorted(set(i))[:keep] for _, i, _ in held.values()], pa.list_(pa.int64())),
                "queries": pa.array([sorted(set(q)) for _, _, q in held.values()], pa.list_(pa.int64()))})
            held.clear()
            return out

        for batch in batches:
            vectors = matrix(batch.column("vector"))
            for vec_id, query, vector in zip(batch.column("vec_id").to_pylist(), batch.column("is_query").to_pylist(), vectors):
                same = (vector + 0.0).tobytes()  # -0.0 is 0.0
                _, ids, queries = held.setdefault(same, (vector, [], []))
                ids.append(vec_id)
                if query:
                    queries.append(vec_id)
                if len(ids) > 64 * keep:
                    ids[:] = sorted(set(ids))[:keep]
            if len(held) > FLUSH:
                yield emit()
        if held:
            yield emit()

    parts = rows.select("vec_id", "is_query", F.col("vector").cast("array<double>").alias("vector"))
    parts = written(parts.mapInArrow(run, "same binary, vector array<double>, ids array<long>, queries array<long>"), "vector-parts")
    nodes = parts.groupBy("same").agg(F.first("vector").alias("vector"),
                                      F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, keep).alias("ids"))
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "vectors")
    queries = parts.select("same", F.explode("queries").alias("query_id")).join(nodes.select("same", "node"), "same")
    return nodes.drop("same"), queries.select("node", "query_id").distinct()


def placed(nodes: DataFrame, asking: DataFrame, size: int, largest: float) -> DataFrame:
    """(ordering, key, node, asks): a row for each vector in each ordering, and one for each asking vector."""
    rng = np.random.default_rng(SEED)
    dimensions = min(DIMENSIONS, size + 1)
    turns = [np.linalg.qr(rng.normal(size=(size + 1, size + 1)))[0][:, :dimensions] for _ in range(ORDERINGS)]
    shifts = rng.random((ORDERINGS, dimensions)) / 4
    reach = 4 * largest / np.sqrt(size + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = matrix(batch.column("vector"))
            norms = np.linalg.norm(vectors, axis=1) if len(vectors) else np.zeros(0)
            asks = batch.column("asks").to_numpy(zero_copy_only=False).astype(bool)
            scale = np.where(asks, largest / np.maximum(norms, 1e-300), 1.0)[:, None] if len(vectors) else 1.0
            rest = np.where(asks, 0.0, np.sqrt(np.maximum(largest**2 - norms**2, 0.0)))[:, None]
            lifted = np.hstack([vectors * scale, rest]) if len(vectors) else np.zeros((0, size + 1))
            for o in range(ORDERINGS if len(vectors) else 0):
                cells = ((lifted @ turns[o] / reach + 1) / 2 + shifts[o]) / 1.25 * (1 << BITS)
                keys = hilbert_keys(np.clip(cells, 0, (1 << BITS) - 1), BITS)
                yield pa.RecordBatch.from_pydict({"ordering": pa.array(np.full(len(keys), o), pa.int32()), "key": pa.array(keys),
                                                  "node": batch.column("node"), "asks": batch.column("asks")})

    rows = nodes.select("node", "vector", F.lit(False).alias("asks")).union(
        nodes.join(asking, "node", "left_semi").select("node", "vector", F.lit(True).alias("asks")))
    return rows.mapInArrow(run, "ordering int, key long, node long, asks boolean")


def ranked(entries: DataFrame) -> DataFrame:
    """The entries with their rank in their ordering and the ordering's length, from a range partition of the keys."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun: dict[int, int] = {}
        for batch in batches:
            orderings = batch.column("ordering").to_numpy()
            place = np.empty(len(orderings), dtype=np.int64)
            for o in np.unique(orderings).tolist():
                at = np.flatnonzero(orderings == o)
                place[at] = begun.get(o, 0) + np.arange(len(at))
                begun[o] = begun.get(o, 0) + len(at)
            yield batch.append_column("place", pa.array(place))

    order = ["ordering", "key", "node", "asks"]
    parts = max(ORDERINGS, int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sorted_ = entries.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    sorted_ = written(sorted_.mapInArrow(number, "ordering int, key long, node long, asks boolean, part int, place long"), "curve")
    sizes = sorted_.groupBy("ordering", "part").agg(F.count(F.lit(1)).alias("n"))  # a row for each partition and ordering
    before = sizes.alias("x").join(sizes.alias("y"), F.expr("x.ordering = y.ordering")).groupBy("x.ordering", "x.part").agg(
        F.coalesce(F.sum(F.expr("if(y.part < x.part, y.n, 0)")), F.lit(0)).alias("before"), F.sum("y.n").alias("length"))
    return sorted_.join(before, ["ordering", "part"]).select("ordering", "node", "asks", (F.col("before") + F.col("place")).alias("rank"), "length")


def nearest(embeddings: DataFrame, is_query: Column, k: int = 20, share: float = SHARE) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the k nearest found rows by inner product, the query's own id left out.

    `embeddings` has vec_id and embedding; `is_query` picks the queries. Vectors that are null, zero, or hold null or
    non-finite components take no part, nor do rows without id or with another length than most. Ties go to the smaller
    vec_id; rows with one vec_id are one row of the result (for different vectors, with the better score). An empty
    table gives an empty result; a table of fewer than k + 1 rows gives all others.
    """
    spark = embeddings.sparkSession
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vector"), is_query.alias("is_query"))
    rows = rows.where("vec_id is not null")
    limit = F.lit(float("inf"))
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < limit)) & F.exists("vector", lambda x: x != 0)
    rows = rows.where(F.col("vector").isNotNull() & fine)
    common = rows.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), "size").first()
    result = "query_id long, rank int, vec_id long, score double"
    if common is None:
        return spark.createDataFrame([], result)
    size = common["size"]
    nodes, queries = distinct_vectors(rows.where(F.size("vector") == size), k + 1)
    total, largest = nodes.agg(F.count(F.lit(1)), F.max(F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)))).first()
    curve = written(ranked(placed(nodes, queries.select("node").distinct(), size, largest)), "ranks")

    half = max(2 * k, int(np.ceil(share * total)))
    block = F.expr(f"cast(rank div {BLOCK} as int)")
    stored = curve.where("not asks").select("ordering", block.alias("block"), "rank", "node")
    low = F.greatest(F.lit(0), F.least(F.col("rank") - half, F.col("length") - 2 * half - 1))
    visits = curve.where("asks").select("ordering", "node", low.alias("low"), (low + 2 * half).alias("high"), "length")
    visits = visits.withColumn("block", F.explode(F.expr(f"sequence(cast(low div {BLOCK} as int), cast(least(high, length - 1) div {BLOCK} as int))")))
    vectors = nodes.select("node", "vector")
    stored, visits = (x.join(vectors, "node").toDF(*x.columns, "vector") for x in (
        stored.select("node", "ordering", "block", "rank"), visits.select("node", "ordering", "block", "low", "high")))

    def meet(block_: pa.Table, asking: pa.Table) -> pa.Table:
        schema = pa.schema([("query", pa.int64()), ("node", pa.int64()), ("score", pa.float64())])
        if not block_.num_rows or not asking.num_rows:
            return schema.empty_table()
        base, ask = matrix(block_["vector"].combine_chunks()), matrix(asking["vector"].combine_chunks())
        rank, node = block_["rank"].to_numpy(), block_["node"].to_numpy()
        low, high, query = asking["low"].to_numpy(), asking["high"].to_numpy(), asking["node"].to_numpy()
        out = []
        for at in range(0, len(ask), 512):
            part = slice(at, at + 512)
            scores = ask[part] @ base.T
            scores[(rank < low[part, None]) | (rank > high[part, None])] = -np.inf
            best = np.argpartition(-scores, min(k + 1, len(base)) - 1, axis=1)[:, :k + 1]
            row, column = np.repeat(np.arange(len(scores)), best.shape[1]), best.reshape(-1)
            good = np.isfinite(scores[row, column])
            row, column = row[good], column[good]
            exact = (ask[part][row] * base[column]).sum(axis=1)  # the same for a pair, whatever the block
            out.append(pa.table({"query": query[part][row], "node": node[column], "score": exact}, schema=schema))
        return pa.concat_tables(out)

    found = stored.groupBy("ordering", "block").cogroup(visits.groupBy("ordering", "block")).applyInArrow(
        meet, "query long, node long, score double")
    best = found.groupBy("query").agg(F.collect_set(F.struct((-F.col("score")).alias("down"), "node")).alias("all"))  # windows x (k + 1) at most
    best = best.select("query", F.explode(F.slice(F.array_sort("all"), 1, k + 1)).alias("x")).select("query", "x.down", "x.node")
    listed = best.join(nodes.select("node", "ids"), "node").select("query", "down", F.explode("ids").alias("vec_id"))
    listed = listed.groupBy("query", "vec_id").agg(F.min("down").alias("down")).groupBy("query").agg(
        F.slice(F.array_sort(F.collect_list(F.struct("down", "vec_id"))), 1, k + 1).alias("list"))  # (k + 1)^2 at most
    answers = queries.join(listed, F.col("node") == F.col("query"))
    answers = answers.select("query_id", F.posexplode(F.slice(F.filter("list", lambda x: x["vec_id"] != F.col("query_id")), 1, k)).alias("rank", "x"))
    return answers.select("query_id", (F.col("rank") + 1).alias("rank"), "x.vec_id", (-F.col("x.down")).alias("score"))
