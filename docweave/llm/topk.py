"""Exact top-k search by inner product: a KD-tree per shard, searched best first under a kth score that is passed on."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.llm.ordering import placed
from docweave.session import discard, materialize

#: Vectors of a shard, and of the block of rows whose queries travel together.
SHARD = 4096
#: Vectors of a leaf at most.
LEAF = 256
#: Scores up to this are exact sums of doubles; beyond it Python integers are used.
_EXACT = 1 << 53
_NO_SCORE = -(1 << 200)
_LONG = (-(1 << 63), (1 << 63) - 1)


def build_tree(vectors: np.ndarray, leaf: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A KD-tree over rows: the order of the rows, spans (start, end, left child or -1) and tight boxes (low, high).

    Every node is split at the median of its widest side; nodes of at most leaf rows, or of equal rows, are leaves. The
    right child follows the left one.
    """
    order = np.arange(len(vectors))
    spans: list[list[int]] = [[0, len(vectors), -1]]
    boxes = []
    for node in spans:  # grows
        start, end, _ = node
        inside = vectors[order[start:end]]
        low, high = inside.min(axis=0), inside.max(axis=0)
        boxes.append((low, high))
        if end - start <= leaf or not len(low):
            continue
        side = int(np.argmax(high.astype(object) - low if inside.dtype == object else high.astype(np.float64) - low))
        if low[side] == high[side]:
            continue
        middle = (end - start) // 2
        order[start:end] = order[start:end][np.argpartition(inside[:, side], middle)]
        node[2] = len(spans)
        spans += [[start, start + middle, -1], [start + middle, end, -1]]
    return order, np.array(spans, np.int32), np.array(boxes)


class _Best:
    """The k best (score, id) of each query so far: higher scores first, of equal ones the smaller id."""

    def __init__(self, k: int, bounds: list[int | None]) -> None:
        self.k = k
        self.rows: list[list[tuple[int, int, bool]]] = [[] for _ in bounds]
        self.kth = [_NO_SCORE if b is None else b for b in bounds]

    def add(self, query: int, scores: list[int], ids: list[int], nameless: list[bool]) -> None:
        rows = self.rows[query] + [(-s, i, n) for s, i, n in zip(scores, ids, nameless, strict=True)]
        rows.sort(key=lambda x: (x[0], x[2], x[1]))
        self.rows[query] = rows[: self.k]
        if len(rows) >= self.k:
            self.kth[query] = max(self.kth[query], -rows[self.k - 1][0])


def search_tree(
    tree: tuple[np.ndarray, np.ndarray, np.ndarray], ids: np.ndarray, nameless: np.ndarray, places: np.ndarray,
    queries: np.ndarray, own: np.ndarray, bounds: list[int | None], k: int,
) -> list[list[tuple[int, int, bool]]]:
    """The best (-score, id, whether it has none) of a shard for each query; see exact_top_k().

    tree: rows in its order, spans, boxes. All queries walk at once, each from its own frontier: it takes the node with the
    highest bound, the most that any vector in the node's box can score, and stops where that is under its kth score,
    which begins at bounds. Queries that are at the same leaf are scored together. own: the place of a query's own row.
    """
    vectors, spans, boxes = tree
    sizes = [int(np.abs(x.astype(object)).max()) if x.size else 0 for x in (vectors, queries)]
    kind = np.float64 if sizes[0] * sizes[1] * max(1, vectors.shape[1]) < _EXACT else object
    vectors, queries, boxes = vectors.astype(kind), queries.astype(kind), boxes.astype(kind)
    upper = np.maximum(queries, 0) @ boxes[:, 1].T + np.minimum(queries, 0) @ boxes[:, 0].T
    best = _Best(k, bounds)
    lowest = -np.inf if kind is np.float64 else _NO_SCORE - 1
    frontier = np.full(upper.shape, lowest, kind)
    frontier[:, 0] = upper[:, 0]
    active = np.arange(len(queries))
    while len(active):
        node = frontier[active].argmax(axis=1)
        bound = frontier[active, node]
        goes = np.array([b > lowest and b >= best.kth[q] for b, q in zip(bound.tolist(), active.tolist(), strict=True)], bool)
        active, node = active[goes], node[goes]
        frontier[active, node] = lowest
        child = spans[node, 2]
        inner = child >= 0
        for side in (0, 1):
            frontier[active[inner], child[inner] + side] = upper[active[inner], child[inner] + side]
        for leaf in np.unique(node[~inner]).tolist():
            start, end, _ = spans[leaf]
            here = active[node == leaf]
            scores = queries[here] @ vectors[start:end].T
            for q, row in zip(here.tolist(), scores, strict=True):
                keep = np.flatnonzero((row >= best.kth[q]) & (places[start:end] != own[q]))
                if len(keep) > k:
                    # Only scores of at least the kth of these can stay.
                    least = np.partition(row[keep], len(keep) - k)[len(keep) - k]
                    keep = keep[row[keep] >= least]
                if len(keep):
                    at = keep + start
                    best.add(q, [int(x) for x in row[keep]], ids[at].tolist(), nameless[at].tolist())
    return best.rows


def _packed(values: np.ndarray) -> tuple[bytes, str]:
    """Integers as bytes of the narrowest type that holds them."""
    low, high = (int(values.min()), int(values.max())) if values.size else (0, 0)
    kind = next(t for t in ("int16", "int32", "int64") if np.iinfo(t).min <= low and high <= np.iinfo(t).max)
    return values.astype(kind).tobytes(), kind


def _unpacked(data: bytes, kind: str, dim: int) -> np.ndarray:
    return np.frombuffer(data, kind).reshape(-1, dim) if dim else np.zeros((0, 0), kind)


def _vectors(table: pa.Table, dim: int) -> np.ndarray:
    column = table["vec"].combine_chunks()
    column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(table), dim)


def _tree_row(leaf: int, shard_size: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        dim = table["dim"][0].as_py()
        vectors = _vectors(table, dim)
        order, spans, boxes = build_tree(vectors, leaf)
        data, kind = _packed(vectors[order])
        box, box_kind = _packed(boxes)
        rows = table.take(pa.array(order))
        lists = {"ids": rows["vec_id"], "places": rows["pos"], "spans": pa.chunked_array([spans.reshape(-1)])}
        return pa.table(
            {
                "dim": pa.array([dim], pa.int32()),
                "shard": table["shard"].slice(0, 1),
                "shards": pa.array([-(-table["total"][0].as_py() // shard_size)], pa.int64()),
                "data": pa.array([data], pa.binary()),
                "kind": pa.array([kind]),
                "boxes": pa.array([box], pa.binary()),
                "box_kind": pa.array([box_kind]),
                **{k: pa.array([v.to_pylist()], pa.list_(pa.int32() if k == "spans" else pa.int64())) for k, v in lists.items()},
            }
        )

    return run


def _query_row(table: pa.Table) -> pa.Table:
    table = table.sort_by("pos")
    dim = table["dim"][0].as_py()
    data, kind = _packed(_vectors(table, dim))
    return pa.table(
        {
            "dim": pa.array([dim], pa.int32()),
            "home": table["shard"].slice(0, 1),
            "q_data": pa.array([data], pa.binary()),
            "q_kind": pa.array([kind]),
            "q_ids": pa.array([table["vec_id"].to_pylist()], pa.list_(pa.int64())),
            "q_places": pa.array([table["pos"].to_pylist()], pa.list_(pa.int64())),
            "bounds": pa.array([table["bound"].to_pylist()], pa.list_(pa.int64())),
        }
    )


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                dim = row["dim"]
                if not dim:
                    continue
                tree = (
                    _unpacked(row["data"], row["kind"], dim),
                    np.array(row["spans"], np.int32).reshape(-1, 3),
                    np.frombuffer(row["boxes"], row["box_kind"]).reshape(-1, 2, dim),
                )
                nameless = np.array([x is None for x in row["ids"]], bool)
                ids = np.array([x or 0 for x in row["ids"]], np.int64)
                queries = _unpacked(row["q_data"], row["q_kind"], dim)
                found = search_tree(tree, ids, nameless, np.array(row["places"]), queries, np.array(row["q_places"]), row["bounds"], k)
                flat = [(p, q, None if n else x, min(max(-s, _LONG[0]), _LONG[1])) for p, q, rows in zip(row["q_places"], row["q_ids"], found, strict=True) for s, x, n in rows]
                columns = list(zip(*flat, strict=True)) or [()] * 4
                arrays = [pa.array([dim] * len(flat), pa.int32()), *(pa.array(c, pa.int64()) for c in columns)]
                yield pa.RecordBatch.from_arrays(arrays, ["dim", "place", "query_id", "vec_id", "score"])

    return run


_FOUND = "dim int, place long, query_id long, vec_id long, score long"


def exact_top_k(
    vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding", shard: int = SHARD, leaf: int = LEAF
) -> DataFrame:
    """The k rows with the highest inner product for each query: query_id, rank, vec_id, score.

    A component x counts as floor(scale * x), of x as a double. Queries are the rows of vectors where is_query holds,
    candidates all other rows of the same length. Of equal scores the smaller id comes first, rows without an id
    last. Where there are fewer than k candidates all are returned.

    Null vectors, and those with null or non-finite components, take no part; neither do vectors without components.
    A repeated row is a candidate of its twin; two queries with the same id have their answers side by side. Components
    and scores beyond a long are cut to it. An empty table gives an empty result; other columns are not read.

    Rows are dealt to shards of equal size by their place in the order of (id, vector), and a KD-tree is built for each.
    First the queries of a shard search it; the kth score they find goes with them to all other shards, where boxes
    that cannot reach it are passed by. Queries travel in blocks; a task holds one tree and one block.
    """
    ident, vec = F.col(f"`{id_col}`").cast("long"), F.col(f"`{vec_col}`")
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    rows = vectors.select(ident.alias("vec_id"), F.coalesce(is_query, F.lit(False)).alias("asks"), vec.alias("vec"), F.coalesce(finite, F.lit(False)).alias("fit"))
    rows = rows.where("fit and size(vec) > 0").drop("fit")
    rows = rows.withColumn("vec", F.transform("vec", lambda x: F.floor(x.cast("double") * scale))).withColumn("dim", F.size("vec"))
    nodes, table = placed(rows, "dim", ["vec_id", "vec"], "vectors")
    nodes = materialize(nodes.withColumn("shard", F.floor(F.col("pos") / shard)), "vector-places")
    discard(table)

    kinds = "data binary, kind string, boxes binary, box_kind string, ids array<long>, places array<long>, spans array<int>"
    grouped = nodes.select("dim", "shard", "vec_id", "vec", "pos", "total").groupBy("dim", "shard")
    trees = materialize(grouped.applyInArrow(_tree_row(leaf, shard), f"dim int, shard long, shards long, {kinds}"), "trees")
    packed = "dim int, home long, q_data binary, q_kind string, q_ids array<long>, q_places array<long>, bounds array<long>"
    asked = nodes.where("asks").select("dim", "shard", "vec_id", "vec", "pos")
    at_home = asked.withColumn("bound", F.lit(None).cast("long")).groupBy("dim", "shard").applyInArrow(_query_row, packed)
    near = at_home.join(trees, (at_home["dim"] == trees["dim"]) & (at_home["home"] == trees["shard"])).drop(trees["dim"])
    near = materialize(near.mapInArrow(_search(k), _FOUND), "near")

    kth = near.groupBy("dim", "place").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least"))
    kth = kth.select("dim", F.col("place").alias("pos"), F.when(F.col("n") >= k, F.col("least")).alias("bound"))
    bounded = asked.join(kth, ["dim", "pos"], "left").groupBy("dim", "shard").applyInArrow(_query_row, packed)
    counts = trees.select("dim", "shards").distinct().withColumnRenamed("dim", "of_dim")
    sent = bounded.join(counts, bounded["dim"] == counts["of_dim"]).drop("of_dim")
    sent = sent.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1))).where("shard <> home").drop("shards")
    far = sent.join(trees.drop("shards"), ["dim", "shard"]).mapInArrow(_search(k), _FOUND)

    order = Window.partitionBy("dim", "place").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    ranked = near.unionByName(far).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
