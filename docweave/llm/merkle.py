"""Merkle manifest of a dataset: a hash tree per language, one over the languages, and a proof for every row."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.llm.common import ascii_lower, crc_mod
from docweave.llm.ordering import placed
from docweave.session import discard, materialize

#: Nodes that are hashed into their parent together.
FANOUT = 8
#: Levels of the tree inside one aligned block: a task holds FANOUT ** DEPTH digests of 64 bytes.
DEPTH = 4
#: Bytes of a digest as hex text.
WIDTH = 64
_STEP = "struct<before:string,after:string>"


def field_bytes(value: Column) -> Column:
    """What is hashed of a value: its UTF-8 byte count, a colon and the value; - for null."""
    shown = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(
        F.concat(F.octet_length(shown).cast("string"), F.lit(":"), shown)
    )


def leaf_digest(*values: Column) -> Column:
    return F.sha2(F.concat(*(field_bytes(v) for v in values)), 256)


def _matrix(digests: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Digests as rows of 64 bytes in one contiguous array."""
    joined = "".join(digests.to_pylist()).encode("ascii")
    return np.frombuffer(joined, np.uint8).reshape(-1, WIDTH)


def _parents(nodes: np.ndarray, fanout: int) -> np.ndarray:
    """The digests of runs of fanout rows; the last run may be shorter."""
    whole = len(nodes) // fanout
    rows = nodes[: whole * fanout].reshape(whole, fanout * WIDTH)
    digests = [hashlib.sha256(row).hexdigest() for row in rows]
    if whole * fanout < len(nodes):
        digests.append(hashlib.sha256(nodes[whole * fanout :].tobytes()).hexdigest())
    return np.frombuffer("".join(digests).encode("ascii"), np.uint8).reshape(-1, WIDTH)


def block_levels(leaves: np.ndarray, fanout: int, depth: int, alone: bool) -> list[np.ndarray]:
    """The levels of an aligned block, leaves first.

    A block that is alone in its tree is hashed until one node remains; one of several always over depth levels, so
    that its root is a node of the whole tree's level depth.
    """
    levels = [leaves]
    while len(levels[-1]) > 1 if alone else len(levels) <= depth:
        levels.append(_parents(levels[-1], fanout))
    return levels


def siblings(levels: list[np.ndarray], place: int, fanout: int) -> list[tuple[bytes, bytes]]:
    """For each level below the root: the digests of the run before and after the node above leaf number place."""
    found = []
    for nodes in levels[:-1]:
        low = place - place % fanout
        found.append((nodes[low:place].tobytes(), nodes[place + 1 : low + fanout].tobytes()))
        place //= fanout
    return found


def fold(digest: bytes, path: list[tuple[bytes, bytes]]) -> bytes:
    """The root that follows from a leaf and its siblings."""
    for before, after in path:
        digest = hashlib.sha256(before + digest + after).hexdigest().encode("ascii")
    return digest


def _blocks(nodes: DataFrame, fanout: int, depth: int, label: str) -> DataFrame:
    """nodes (tree, pos, total, digest, payload) as one row for each aligned block, written.

    tree, block, blocks (of the tree), digests (the contiguous matrix as bytes), payload (a list), digest (the root).
    """
    size = fanout**depth

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        leaves = _matrix(table["digest"])
        total = table["total"][0].as_py()
        blocks = -(-total // size)
        root = block_levels(leaves, fanout, depth, blocks == 1)[-1]
        payload = table["payload"].combine_chunks()
        if isinstance(payload, pa.ChunkedArray):
            payload = pa.concat_arrays(payload.chunks)
        return pa.table(
            {
                "tree": table["tree"].slice(0, 1),
                "block": pa.array([table["block"][0].as_py()], pa.int64()),
                "blocks": pa.array([blocks], pa.int64()),
                "digests": pa.array([leaves.tobytes()], pa.binary()),
                "payload": pa.ListArray.from_arrays(pa.array([0, len(payload)], pa.int32()), payload),
                "digest": pa.array([root.tobytes().decode("ascii")], pa.string()),
            }
        )

    kind = nodes.schema["payload"].dataType.simpleString()
    blocked = nodes.select("tree", F.floor(F.col("pos") / size).alias("block"), "pos", "total", "digest", "payload")
    schema = f"tree string, block long, blocks long, digests binary, payload array<{kind}>, digest string"
    return materialize(blocked.groupBy("tree", "block").applyInArrow(build, schema), label)


def _paths(nodes: DataFrame, fanout: int, depth: int, label: str) -> DataFrame:
    """For nodes (tree, pos, total, digest): tree, pos, root and path, the siblings from the node to the root.

    Blocks are joined to the paths of their roots, which are found the same way: a tier of FANOUT ** DEPTH times
    fewer nodes each.
    """
    blocks = _blocks(nodes.withColumn("payload", F.col("pos")), fanout, depth, label)
    above = _above(blocks, fanout, depth, label)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                leaves = np.frombuffer(row["digests"], np.uint8).reshape(-1, WIDTH)
                levels = block_levels(leaves, fanout, depth, row["blocks"] == 1)
                own = [siblings(levels, i, fanout) for i in range(len(leaves))]
                paths = [[{"before": b.decode(), "after": a.decode()} for b, a in x] + row["path"] for x in own]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["tree"]] * len(leaves), pa.string()),
                        pa.array(row["payload"], pa.int64()),
                        pa.array([row["root"]] * len(leaves), pa.string()),
                        pa.array(paths, pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))),
                    ],
                    ["tree", "pos", "root", "path"],
                )

    return above.mapInArrow(spread, f"tree string, pos long, root string, path array<{_STEP}>")


def _above(blocks: DataFrame, fanout: int, depth: int, label: str) -> DataFrame:
    """blocks with root, of their tree, and path: the siblings from the block's root to it."""
    several = blocks.where("blocks > 1").select("tree", F.col("block").alias("pos"), F.col("blocks").alias("total"), "digest")
    if several.isEmpty():
        return blocks.withColumns({"root": F.col("digest"), "path": F.array().cast(f"array<{_STEP}>")})
    upper = materialize(_paths(several, fanout, depth, label), f"{label}-upper")
    upper = upper.withColumnRenamed("pos", "block")
    return blocks.join(upper, ["tree", "block"], "left").withColumns(
        {"root": F.coalesce("root", "digest"), "path": F.coalesce("path", F.array().cast(f"array<{_STEP}>"))}
    )


def merkle_manifest(
    docs: DataFrame,
    id_col: str = "doc_id",
    fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"),
    group_col: str = "lang",
    text_col: str = "text",
    fanout: int = FANOUT,
    depth: int = DEPTH,
    tampered: int = 3,
) -> DataFrame:
    """One row per input row: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    A leaf is the SHA-256, as hex text, of the fields, each as its byte count, a colon and the value, or - for null. The
    leaves of a group ascend by id, nulls first, equal ids by digest. Every fanout consecutive nodes are hashed into
    their parent until one is left, the group's subroot; a single leaf is its own subroot. Subroots, in the order of
    their groups' UTF-8 bytes with null first, are hashed to the root in the same way. proof_sha256 is the digest of
    all siblings of a row from leaf to root, folded_root the root that follows from them and the leaf, taken after
    text_col's A-Z are lower-cased where tampered divides crc32 of the id; rows without an id are not tampered with.

    Repeated rows are leaves of their own. Null and empty texts differ. An empty table gives an empty result; other
    columns are not read. Texts are hashed where they are read; what is moved is 64 bytes of digest a row, in blocks of
    fanout ** depth rows however large a group is, and both trees are built from the same blocks.
    """
    named = {f: F.col(f"`{f}`") for f in fields}
    ident, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    changed = F.coalesce(crc_mod(ident, tampered) == 0, F.lit(False)) & text.isNotNull() & (text != ascii_lower(text))
    other = leaf_digest(*(ascii_lower(c) if f == text_col else c for f, c in named.items()))
    group = F.col(f"`{group_col}`")
    leaves = docs.select(
        F.when(group.isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), group.cast("string"))).alias("tree"),
        ident.alias("doc_id"),
        leaf_digest(*named.values()).alias("digest"),
        F.when(changed, other).alias("altered"),
    )
    leaves = materialize(leaves, "leaves")
    nodes, table = placed(leaves, "tree", ["doc_id", "digest"], "merkle")
    nodes = nodes.withColumn("payload", F.struct("doc_id", "altered"))
    blocks = _blocks(nodes, fanout, depth, "merkle-blocks")
    discard(leaves, table)
    inside = materialize(_above(blocks, fanout, depth, "merkle"), "merkle-inside")

    subroots = inside.where("block = 0").select(F.lit("").alias("top"), "tree", F.col("root").alias("digest"))
    ranked, _ = placed(subroots, "top", ["tree"], "merkle-top")
    ranked = materialize(ranked, "merkle-groups")
    over = _paths(ranked.select(F.col("top").alias("tree"), "pos", "total", "digest"), fanout, depth, "merkle-top")
    over = over.select("pos", F.col("root").alias("top_root"), F.col("path").alias("top_path"))
    groups = materialize(ranked.select("tree", "pos").join(over, "pos").drop("pos"), "merkle-roots")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = lambda path: [(x["before"].encode(), x["after"].encode()) for x in path]
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i] for c in batch.schema.names}
                leaves = np.frombuffer(row["digests"].as_py(), np.uint8).reshape(-1, WIDTH)
                levels = block_levels(leaves, fanout, depth, row["blocks"].as_py() == 1)
                shared = steps(row["path"].as_py()) + steps(row["top_path"].as_py())
                tail = b"".join(before + after for before, after in shared)
                root = row["top_root"].as_py()
                payload = row["payload"].values
                altered = payload.field("altered").to_pylist()
                proofs, folded = [], []
                for k in range(len(leaves)):
                    own = siblings(levels, k, fanout)
                    proof = hashlib.sha256(b"".join(before + after for before, after in own))
                    proof.update(tail)
                    proofs.append(proof.hexdigest())
                    leaf = altered[k].encode("ascii") if altered[k] else leaves[k].tobytes()
                    folded.append(fold(leaf, own + shared).decode("ascii"))
                n = len(leaves)
                yield pa.RecordBatch.from_arrays(
                    [
                        payload.field("doc_id"),
                        pa.array([x.tobytes().decode("ascii") for x in leaves], pa.string()),
                        pa.array([row["root"].as_py()] * n, pa.string()),
                        pa.array([root] * n, pa.string()),
                        pa.array(proofs, pa.string()),
                        pa.array(folded, pa.string()),
                        pa.array([x == root for x in folded], pa.bool_()),
                    ],
                    ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    digests = ", ".join(f"{c} string" for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root"))
    return inside.join(groups, "tree").mapInArrow(rows, f"doc_id {kind}, {digests}, verified boolean")
