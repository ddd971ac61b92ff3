"""Near-duplicates at a similarity of word shingles, by wide SimHash fingerprints under the pigeonring filter.

A fingerprint of 64 bits cannot tell a similarity of .8 from chance: its copies differ in ten bits on average. WORDS of
64 bits each estimate it well (the standard error is about .02 at .8), so that the Hamming check leaves few pairs to the
exact comparison of their shingles. What the filter misses, in crowded segments and among short texts, an exact prefix
join of the shingles finds, at any number of documents: see missed_pairs().
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.llm.common import key_bitmap, unused, with_bitmap_flag, without_ids
from docweave.llm.components import connected_components
from docweave.llm.exact_dedup import drop_exact_duplicates
from docweave.session import bounded_batches, discard, materialize

#: 64-bit words of a fingerprint, and the least and most bits of a segment; see segment_bits().
WORDS, LEAST_BITS, MOST_BITS = 16, 16, 40
#: Of more rows than this in one bucket each meets a partner: segments before the shuffle, prefixes in hub_pairs().
BUCKET = 16
#: Of each of the next two segments so many bits are carried along: both fit one number.
NEAR = 31
#: Fingerprints whose segments a task looks at together, before the shuffle.
LOCAL = 4096
#: Rounds of missed_pairs() with one partner a row, while its buckets would make over CROWDED pairs for each of their rows.
ROUNDS, CROWDED = 3, 4
#: By how much less similarity a pair may seem to have in its fingerprints.
SLACK = 0.06
#: A missed pair of sets of LONG shingles or more is compared exactly only if its fingerprints differ by no more than
#: SIGMAS standard errors above what similar sets do on average: one of 10^9 pairs at the limit does.
LONG, SIGMAS = 64, 6
#: A round of missed_pairs() that leaves more than this part of the buckets' pairs is the last before all are made.
WORTH = 0.9
#: Shingles before its own that a row of a bucket carries, so that a pair with many in common is not made at each.
BEFORE = 8
#: Texts looked at for common shingles: so many or so great a part of all; and how many of these shingles are noted.
SAMPLE, PART, COMMON = 8000, 50, 1 << 14
_CHUNK = 1 << 14
#: Texts at a time in Python, for bounded memory.
_TEXTS = 256
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_ODD = np.arange(1, WORDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
_LANES = np.uint64(0x0101010101010101)


def bits_for(similarity: float) -> int:
    """The Hamming budget of a Jaccard similarity: equal sets of sizes alike have the cosine 2J / (1 + J)."""
    return math.floor(64 * WORDS * math.acos(2 * similarity / (1 + similarity)) / math.pi)


def farthest(similarity: float) -> int:
    """How far the fingerprints of long sets that are similar enough may be apart: see SIGMAS."""
    part = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return math.floor(64 * WORDS * part + SIGMAS * math.sqrt(64 * WORDS * part * (1 - part)))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (batch.slice(at, _TEXTS) for batch in batches for at in range(0, batch.num_rows, _TEXTS))


def shingle_hashes(text: str | None, shingle: int = 5) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles; fewer words are one shingle, none give none."""
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_digest
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = ends[min(len(words), shingle) - 1 :]
    del words
    parts = []
    for at in range(0, len(last), _CHUNK):
        places = zip(starts[at : at + _CHUNK].tolist(), last[at : at + _CHUNK].tolist(), strict=False)
        parts.append(np.frombuffer(b"".join([digest(joined[a:b]) for a, b in places]), ">u8"))
    return np.unique(np.concatenate(parts).astype(np.uint64))


def wide_fingerprint(text: str | None, shingle: int = 5) -> np.ndarray:
    """SimHash over the distinct word shingles of a text, WORDS numbers. Without words all are zero."""
    return fingerprint_of(shingle_hashes(text, shingle))


def fingerprint_of(hashes: np.ndarray) -> np.ndarray:
    """The SimHash of shingle_hashes()."""
    if not len(hashes):
        return np.zeros(WORDS, np.uint64)
    counts = np.zeros((WORDS, 8, 8), np.int64)  # word, byte, shift
    for at in range(0, len(hashes), _CHUNK):
        x = hashes[at : at + _CHUNK, None] + _ODD
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        for shift in range(8):
            # One bit of every byte; byte lanes add up without overflow over 255 rows.
            lanes = np.add.reduceat((x >> np.uint64(shift)) & _LANES, np.arange(0, len(x), 255), axis=0)
            counts[:, :, shift] += lanes.view(np.uint8).reshape(len(lanes), WORDS, 8).sum(axis=0, dtype=np.int64)
    bits = (counts * 2 > len(hashes)).reshape(WORDS, 64)
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64).reshape(WORDS)


def least_shared(size: Column | int, similarity: float) -> Column | int:
    """How many shingles a set of this size has in common with any set that is similar enough."""
    if isinstance(size, int):
        return math.ceil(similarity * size - 1e-9)
    return F.ceil(similarity * size - 1e-9).cast("int")


def common_shingles(docs: DataFrame, shingle: int, id_col: str, text_col: str) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the most common shingles of a sample of docs, and how many of its texts have each.

    They only set the order of shingles in prefix_of(): any order gives the same pairs, this one keeps buckets small.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            for text in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_hashes(text.as_py(), shingle).view(np.int64))], ["shingle"])

    rows = docs.count()
    every = max(1, rows // max(SAMPLE, rows // PART))
    sample = docs.where(F.pmod(F.xxhash64(id_col), F.lit(every)) == 0).select(F.col(text_col).alias("text"))
    counts = sample.mapInArrow(run, "shingle long").groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).where("n > 2")
    found = counts.orderBy(F.desc("n"), "shingle").limit(COMMON).collect()
    hashes = np.array([r.shingle for r in found], np.int64).view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], np.array([r.n for r in found], np.int64)[order]


def prefix_of(hashes: np.ndarray, similarity: float, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The first shingles of a set in one order for all sets, rare before common: similar sets share one of them."""
    n = len(hashes)
    if len(common[0]):
        at = np.minimum(np.searchsorted(common[0], hashes), len(common[0]) - 1)
        rank = np.where(common[0][at] == hashes, common[1][at], 0)
        hashes = hashes[np.argsort(rank, kind="stable")]
    return hashes[: n - least_shared(n, similarity) + 1]


def wide_fingerprints(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 5,
    similarity: float = 0.8,
    common: tuple[np.ndarray, np.ndarray] = (np.zeros(0, np.uint64), np.zeros(0, np.int64)),
) -> DataFrame:
    """(doc_id, fp array<long>, size int, prefix array<long>): no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            sets = [shingle_hashes(t.as_py(), shingle) for t in batch.column(1)]
            table = [fingerprint_of(x).view(np.int64) for x in sets]
            prefixes = [prefix_of(x, similarity, common).view(np.int64) for x in sets]
            arrays = [pa.array(table, pa.list_(pa.int64())), pa.array([len(x) for x in sets], pa.int32())]
            arrays.append(pa.array(prefixes, pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["doc_id", "fp", "size", "prefix"])

    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(run, f"doc_id {id_type}, fp array<long>, size int, prefix array<long>")


def segment_bits(nodes: int) -> int:
    """Bits of a segment for so many fingerprints: four more than number them, so that few share one by chance."""
    return max(LEAST_BITS, min(MOST_BITS, max(1, nodes).bit_length() + 3))


def rings(bits: int) -> tuple[tuple[int, int], ...]:
    """(first bit, number of segments) of the two rings, half a segment apart."""
    return tuple((start, (64 * WORDS - start) // bits) for start in (0, bits // 2))


def segments_of(fps: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Of fingerprints (rows of WORDS): slots (which segment, and its value) and the two segments after each."""
    table = np.unpackbits(fps.view(np.uint8).reshape(len(fps), 8 * WORDS), axis=1, bitorder="little")
    weights = np.int64(1) << np.arange(bits, dtype=np.int64)
    low, slots, more, first = np.int64((1 << NEAR) - 1), [], [], 0
    for start, n in rings(bits):
        values = table[:, start : start + n * bits].reshape(len(fps), n, bits) @ weights
        slots.append(values | (np.arange(first, first + n, dtype=np.int64) << MOST_BITS))
        more.append((np.roll(values, -1, axis=1) & low) | ((np.roll(values, -2, axis=1) & low) << NEAR))
        first += n
    return np.concatenate(slots, axis=1), np.concatenate(more, axis=1)


def segment_rows(nodes: DataFrame, budget: int, bits: int) -> DataFrame:
    """(slot, node, more, hub) from (node, fp): a row for each segment of a fingerprint.

    Where over BUCKET of a task's fingerprints share a slot, only one goes on: the others become candidate pairs with
    it at once (hub), as they would after the shuffle, so that no slot gets a third of all rows.
    """
    two, three = _budgets(budget, bits)

    def emit(ids: pa.Array, fps: np.ndarray) -> pa.RecordBatch:
        slots, more = segments_of(fps, bits)
        row = np.repeat(np.arange(len(fps)), slots.shape[1])
        slots, more = slots.reshape(-1), more.reshape(-1)
        order = np.argsort(slots, kind="stable")
        slots, more, row = slots[order], more[order], row[order]
        edge = np.flatnonzero(np.concatenate(([True], slots[1:] != slots[:-1])))
        sizes = np.diff(np.concatenate((edge, [len(slots)])))
        head = np.repeat(edge, sizes)
        starred = np.repeat(sizes > BUCKET, sizes) & (head != np.arange(len(slots)))
        differ = more ^ more[head]
        near = np.bitwise_count(differ & np.int64((1 << NEAR) - 1)) <= two
        keep = ~starred | (near & (np.bitwise_count(differ) <= three))
        # A pair needs no slot; these negative ones spread pairs over the tasks.
        slots = np.where(starred, ~(more ^ row), slots)[keep]
        hub = pa.array(row[head][keep], mask=~starred[keep])
        arrays = [pa.array(slots), ids.take(pa.array(row[keep])), pa.array(more[keep]), ids.take(hub)]
        return pa.RecordBatch.from_arrays(arrays, ["slot", "node", "more", "hub"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, fps, n = [], [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, LOCAL):
                part = batch.slice(at, LOCAL)
                ids.append(part.column(0))
                fps.append(part.column(1).flatten().to_numpy().reshape(-1, WORDS))
                n += part.num_rows
                if n >= LOCAL:
                    yield emit(pa.concat_arrays(ids), np.concatenate(fps))
                    ids, fps, n = [], [], 0
        if n:
            yield emit(pa.concat_arrays(ids), np.concatenate(fps))

    kind = nodes.schema["node"].dataType.simpleString()
    return nodes.select("node", "fp").mapInArrow(run, f"slot long, node {kind}, more long, hub {kind}")


def _shingle_sets(texts: DataFrame, shingle: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            sets = [shingle_hashes(t.as_py(), shingle).view(np.int64) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["node", "shingles"])

    return texts.mapInArrow(run, f"node {texts.schema['node'].dataType.simpleString()}, shingles array<long>")


def _budgets(budget: int, bits: int) -> tuple[int, int]:
    """How much chains of two and three segments may differ after their equal first one: their share of the budget."""
    fewest = min(n for _, n in rings(bits))
    return 2 * budget // fewest, 3 * budget // fewest


def candidates(nodes: DataFrame, budget: int, bits: int) -> DataFrame:
    """Pairs (a, b) of nodes worth the full check, from (node, fp).

    Pigeonring: within the budget some chain of segments keeps its proportional share at every length. Chains that
    begin with an equal segment are found by grouping; the next two segments, carried along, prune a pair before its
    fingerprints meet. Nodes that share a segment each meet the smallest of them, so links grow with the rows and not
    with the square of a group: nodes alike share many segments, and few share one by chance (segment_bits()).
    missed_pairs() finds what is left out. There are two rings, half a segment apart, so that more chains are tried.
    """
    two, three = _budgets(budget, bits)

    def within(a: Column, b: Column) -> Column:
        differ = a.bitwiseXOR(b)
        return (F.bit_count(differ.bitwiseAND((1 << NEAR) - 1)) <= two) & (F.bit_count(differ) <= three)

    bucket = Window.partitionBy("slot")
    me = F.struct("node", "more")
    counted = segment_rows(nodes, budget, bits).withColumns({"n": F.count(F.lit(1)).over(bucket), "low": F.min(me).over(bucket)})
    shared = materialize(counted.where("hub is not null or (slot >= 0 and n > 1)"), "segments")
    local = shared.where("hub is not null").select(F.col("hub").alias("a"), F.col("node").alias("b"))
    met = shared.where(F.col("hub").isNull() & (F.col("node") != F.col("low.node")) & within(F.col("more"), F.col("low.more")))
    found = met.select(F.col("low.node").alias("a"), F.col("node").alias("b"))
    return found.union(local.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).distinct()


def shared_prefixes(nodes: DataFrame) -> DataFrame:
    """(key, node, size, place): the prefix shingles that other nodes have too, from (node, size, prefix)."""
    rows = nodes.select("node", "size", F.posexplode("prefix").alias("place", "key"))
    shared = rows.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("key"))).where("n > 1").drop("n")
    return materialize(shared, "prefixes")


def mixed_buckets(shared: DataFrame, roots: DataFrame, similarity: float) -> DataFrame:
    """The rows of shared_prefixes() that may belong to a pair of two components, with root, n and hub.

    A shingle that a pair shares first, in the order of all shingles, leaves both sets at least their overlap: the
    sizes behind it are need or more, each. So the slacks of both rows, size behind less their part of need, add up to
    no less than 0, and a row whose slack even the best of its bucket cannot make up is left out: texts that share a
    long passage but are not similar do not meet. n: rows with a slack of 0 or more, one of which every pair has.
    """
    bucket = Window.partitionBy("key")
    part = similarity / (1 + similarity)
    slack = F.col("size") - F.col("place") - 2 * part * F.col("size") + 1e-6
    parted = shared.join(roots, "node", "left").withColumns({"root": F.coalesce("root", "node"), "slack": slack})
    me = F.struct(F.xxhash64("root", "node").alias("draw"), "node", "size", "place", "root")
    free = F.col("slack") >= 0
    facts = {"low": F.min("root"), "high": F.max("root"), "most": F.max("slack"), "n": F.sum(free.cast("long")), "hub": F.min(F.when(free, me))}
    marked = parted.withColumns({k: c.over(bucket) for k, c in facts.items()})
    return materialize(marked.where("low < high and slack + most >= 0").drop("low", "high", "most", "slack"), "mixed")


def _enough_behind(a: str, b: str, similarity: float) -> Column:
    """Whether both sets have as many shingles from this one on as they must share; names end in a and b."""
    need = F.ceil((F.col(f"size{a}") + F.col(f"size{b}")) * (similarity / (1 + similarity)) - 1e-6)
    return F.least(F.col(f"size{a}") - F.col(f"place{a}"), F.col(f"size{b}") - F.col(f"place{b}")) >= need


def hub_pairs(mixed: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of each row of a bucket with over BUCKET in n with the bucket's hub, if of another component."""
    rows = mixed.where((F.col("n") > BUCKET) & (F.col("root") != F.col("hub.root"))).select(
        *(F.col(c).alias(f"{c}_a") for c in ("node", "size", "place")),
        *(F.col(f"hub.{c}").alias(f"{c}_b") for c in ("node", "size", "place")),
    )
    near = rows.where(_enough_behind("_a", "_b", similarity))
    return near.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct()


def missed_pairs(mixed: DataFrame, similarity: float) -> DataFrame:
    """All pairs (a, b) of nodes of different components that may be similar, from mixed_buckets().

    Exact: similar sets share a shingle of their prefixes, and from the first one they share on both have all of their
    overlap left. Nodes that are connected already need no comparison, and buckets of any size are paired.
    """
    return meetings(mixed, similarity).distinct()


def meetings(mixed: DataFrame, similarity: float) -> DataFrame:
    """The pairs of missed_pairs(), at the first shingle that both have and again only where the last BEFORE of each differ.

    Both of a pair have fewer shingles before an earlier one that they share, and so enough behind it too: they met
    there already. Of two texts with one id only those of a size see each other's shingles, for which this holds as well.
    """
    last = Window.partitionBy("node", "size").orderBy("place").rowsBetween(-BEFORE, -1)
    rows = mixed.select("key", "node", "size", "place", "root", F.collect_list("key").over(last).alias("before"))
    a, b = (rows.select("key", *(F.col(c).alias(f"{c}_{n}") for c in rows.columns if c != "key")) for n in "ab")
    apart = (F.col("node_a") < F.col("node_b")) & (F.col("root_a") != F.col("root_b"))
    new = ~F.arrays_overlap("before_a", "before_b")
    met = a.join(b, "key").where(apart & _enough_behind("_a", "_b", similarity) & new)
    return met.select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))


def _close(pairs: DataFrame, nodes: DataFrame, budget: int, least_size: int = 0) -> DataFrame:
    """The pairs (a, b) with fingerprints within the budget, or with a set of fewer than least_size shingles."""
    a, b = (nodes.select(F.col("node").alias(n), F.col("fp").alias(f"fp_{n}"), F.col("size").alias(f"size_{n}")) for n in "ab")
    distance = F.aggregate(F.zip_with("fp_a", "fp_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, d: s + d)
    small = F.least("size_a", "size_b") < least_size
    return pairs.join(a, "a").join(b, "b").where(small | (distance <= budget)).select("a", "b")


def _alike(docs: DataFrame, near: DataFrame, similarity: float, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """The pairs (a, b) of near whose shingles are similar enough, by exact comparison."""
    # Only the texts of these pairs are shingled; a bitmap keeps the others out of the shuffle.
    ids = materialize(near.select(F.col("a").alias("node")).union(near.select("b")).distinct(), "asked")
    texts = docs.select(F.col(id_col).alias("node"), F.col(text_col).alias("text"))
    asked = with_bitmap_flag(texts, F.col("node"), key_bitmap(ids, "node", ids.count()), "_asked").where("_asked").select("node", "text")
    sets = materialize(_shingle_sets(asked, shingle).join(ids, "node", "left_semi").dropDuplicates(["node"]), "sets")
    a, b = (sets.select(F.col("node").alias(n), F.col("shingles").alias(f"set_{n}")) for n in "ab")
    both = F.size(F.array_intersect("set_a", "set_b"))
    all_ = F.size("set_a") + F.size("set_b") - both
    alike = near.join(a, "a").join(b, "b").where((all_ == 0) | (both >= similarity * all_ - 1e-9)).select("a", "b")
    alike = materialize(alike, "alike")
    discard(sets, ids)
    return alike


def similar_documents(
    docs: DataFrame,
    similarity: float = 0.8,
    shingle: int = 5,
    id_col: str = "doc_id",
    text_col: str = "text",
    segment: int | None = None,
) -> DataFrame:
    """(doc_id, component_id) of the documents that have a near-duplicate: the smallest id of their component.

    A component's smallest document may be left out where all others have its fingerprint.
    Documents link when the Jaccard similarity of their distinct word shingles is enough; texts without words link
    with each other. Rows without an id are left out; a repeated id counts once, with one of its texts. segment is the
    width of a segment in bits, if not segment_bits().

    1. Fingerprints find most links, those of large groups in proportion to their size. The Hamming budget is that of
       a similarity SLACK lower, and the exact comparison follows.
    2. missed_pairs() finds all other pairs that could still join two components. Those of long sets whose fingerprints
       are far apart (see SIGMAS) go, so that few texts are moved; the others are compared exactly too. While the
       number of pairs would be out of proportion, rounds of hub_pairs() connect more components first.
    """
    with bounded_batches(docs.sparkSession):
        return _similar(docs, similarity, shingle, id_col, text_col, segment)


def _similar(docs: DataFrame, similarity: float, shingle: int, id_col: str, text_col: str, segment: int | None) -> DataFrame:
    budget = bits_for(similarity - SLACK)
    common = common_shingles(docs, shingle, id_col, text_col)
    fps = materialize(wide_fingerprints(docs, id_col, text_col, shingle, similarity, common), "wide")
    with_id = fps.where("doc_id is not null")
    # Equal fingerprints are one node, named by its smallest id.
    facts = F.min("doc_id").alias("node"), F.min("size").alias("size"), F.count(F.lit(1)).alias("n")
    nodes = materialize(with_id.groupBy("fp").agg(*facts), "nodes")
    several = materialize(nodes.where("n > 1").select("fp", F.col("node").alias("root")), "several")
    # Documents whose fingerprint is that of a smaller id: prefixes are compared once for each fingerprint.
    same = with_id.select("doc_id", "fp").join(F.broadcast(several) if several.count() < 10_000 else several, "fp")
    same = materialize(same.where("doc_id <> root").select("doc_id", "root").distinct(), "same")
    pairs = candidates(nodes, budget, segment or segment_bits(nodes.count()))
    near = materialize(_close(pairs, nodes, budget), "near")
    discard(pairs, several)
    links = _alike(docs, near, similarity, shingle, id_col, text_col)
    roots = connected_components(links)
    discard(near, links)
    prefixes = with_id.select("doc_id", "size", "prefix")
    if same.count():
        prefixes = without_ids(prefixes, "doc_id", same, same.count())
    shared = shared_prefixes(prefixes.withColumnRenamed("doc_id", "node"))
    discard(fps)
    crowd_before = math.inf
    for turn in range(ROUNDS + 1):
        mixed = mixed_buckets(shared, roots, similarity)
        rows, crowd = mixed.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        last = crowd <= CROWDED * rows or crowd > WORTH * crowd_before or turn == ROUNDS
        pairs = missed_pairs(mixed, similarity) if last else hub_pairs(mixed, similarity)
        missed = materialize(_close(pairs, nodes, farthest(similarity), LONG), "missed")
        discard(mixed)
        more = _alike(docs, missed, similarity, shingle, id_col, text_col)
        joined = connected_components(more.union(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))
        discard(missed, more, roots)
        roots, crowd_before = joined, crowd
        if last:
            break
    discard(shared, nodes)
    # Every document of a fingerprint follows the one that names it.
    of_same = same.join(roots, same["root"] == roots["node"], "left").select("doc_id", F.coalesce(roots["root"], same["root"]).alias("component_id"))
    return roots.select(F.col("node").alias("doc_id"), F.col("root").alias("component_id")).union(of_same)


def drop_similar(
    docs: DataFrame, similarity: float = 0.8, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The rows of docs that stay, with all their columns: of each component of near-duplicates the smallest id.

    If ids are null or repeated, rows are told apart by id and text: of equal texts one row stays first (a row
    without an id only if no row with its text has one), and rows without an id come after all others. Rows that share
    an id but differ in text are judged each for itself. Columns may have any names.
    """
    ident = F.col(f"`{id_col}`")
    some, twice = docs.select(F.count(F.lit(1)) > F.count(ident)).first()[0], False
    if not some:
        twice = not docs.groupBy(ident).count().where("count > 1").isEmpty()
    if not some and not twice:
        found = similar_documents(docs, similarity, shingle, id_col, text_col)
        gone = materialize(found.where("doc_id <> component_id").select(F.col("doc_id").alias(id_col)), "gone")
        return without_ids(docs, id_col, gone, gone.count())
    single = materialize(drop_exact_duplicates(docs, id_col, text_col), "single")
    key = unused(docs, "_row_key")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    keyed = single.withColumn(key, F.struct(ident.isNull().alias("last"), ident.alias("id"), F.md5(text).alias("hash")))
    found = similar_documents(keyed, similarity, shingle, key, text_col)
    gone = materialize(found.where("doc_id <> component_id").select(F.col("doc_id").alias(key)), "gone")
    return without_ids(keyed, key, gone, gone.count()).drop(key)
