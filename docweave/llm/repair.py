"""Repair of logged conversations: cheapest edits to a legal order of roles, found by shortest paths.

A conversation is legal when its roles are an optional system turn and then user and assistant in turns. Four states
tell what came last. A conversation of n rows is a graph of nodes (rows done, state); an arc keeps, reroles or deletes
the next row or inserts an empty turn, and costs a small integer. Dial's bucket queue records every node's distance to
the end, and a walk over the tight arcs, least letter first, gives the audit.

Conversations are cut into chunks of at most CHUNK rows. The distances over a chunk, from each state to each, are a
4 x 4 matrix; the matrices behind a chunk, composed, give the distances at its end, and with these a chunk is solved by
itself, for each state it may be entered in. So a conversation of any length is spread over tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.common import crc_mod
from docweave.llm.merkle import field_bytes
from docweave.llm.ordering import ordered
from docweave.session import materialize

#: At most so many rows of a conversation are solved together, as a power of two.
CHUNK_BITS = 12
#: States: nothing yet, after system, after user, after assistant. The next state by the initial of a role.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
STATES = range(4)
#: What an inserted or changed row becomes in each state.
WANTED = ("user", "user", "assistant", "user")
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: Distances from each state to a legal end once no rows are left, by inserts alone.
AT_END = (0, 2 * INSERT, INSERT, 0)
FAR = 1 << 40
#: Faults of a row; the first that holds counts.
NONE, BLANK, DUPLICATE, CUT = range(4)
_SPACES = " \t\n\x0b\x0c\r"


def arcs(initial: str, fault: int) -> list[tuple[str, int, int, int]]:
    """(letter, state, next state, cost) of the edits that use up a row, in the order of their letters."""
    found = [("D", s, s, DELETE) for s in STATES]
    if fault in (BLANK, DUPLICATE):
        return found
    more = TRUNCATED if fault == CUT else 0
    found += [("K", s, NEXT[s][initial], KEEP + more) for s in STATES if initial in NEXT[s]]
    return found + [("R", s, NEXT[s][WANTED[s][0]], REROLE + more) for s in STATES]


#: An insert leads on to the state that the wanted role gives.
INSERTS = [(s, NEXT[s][WANTED[s][0]]) for s in STATES]
ARCS = {(c, f): arcs(c, f) for c in ("s", "u", "a", "") for f in range(4)}
_INTO = {k: [[(s, cost) for _, s, t, cost in v if t == to] for to in STATES] for k, v in ARCS.items()}
_INSERTS_INTO = [[s for s, t in INSERTS if t == to] for to in STATES]


def distances(kinds: list[tuple[str, int]], after: list[int] | tuple[int, ...]) -> list[int]:
    """Distance of node 4 * i + state to the end, given the distances behind the last row: Dial's bucket queue."""
    n = len(kinds)
    dist = [FAR] * (4 * (n + 1))
    buckets: dict[int, list[int]] = {}
    for s in STATES:
        if after[s] < FAR:
            dist[4 * n + s] = after[s]
            buckets.setdefault(after[s], []).append(4 * n + s)
    d = min(buckets, default=0)
    while buckets:
        bucket = buckets.get(d)
        if bucket is None:
            d += 1
            continue
        for node in bucket:  # grows by arcs that cost nothing
            if dist[node] < d:
                continue
            i, t = divmod(node, 4)
            for s in _INSERTS_INTO[t]:
                if dist[4 * i + s] > d + INSERT:
                    dist[4 * i + s] = d + INSERT
                    buckets.setdefault(d + INSERT, []).append(4 * i + s)
            if i:
                low = 4 * (i - 1)
                for s, cost in _INTO[kinds[i - 1]][t]:
                    if dist[low + s] > d + cost:
                        dist[low + s] = d + cost
                        buckets.setdefault(d + cost, []).append(low + s)
        del buckets[d]
        d += 1
    return dist


def walk(kinds: list[tuple[str, int]], dist: list[int], state: int, last: bool) -> tuple[str, int]:
    """The least audit over tight arcs from a state before the first row, and the state after the last row."""
    letters = []
    n, i = len(kinds), 0
    while i < n or (last and dist[4 * n + state]):
        here = dist[4 * i + state]
        step = None
        if i < n:
            for letter, s, t, cost in ARCS[kinds[i]]:
                if s == state and here == cost + dist[4 * (i + 1) + t]:
                    step = letter, t
                    break
        t = INSERTS[state][1]
        if (step is None or step[0] > "I") and here == INSERT + dist[4 * i + t]:
            letters.append("I")
            state = t
            continue
        letters.append(step[0])
        state = step[1]
        i += 1
    return "".join(letters), state


def damage(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows (conv_id, turn, role, text) with planted faults, by crc32 of `conv_id:turn` modulo 20.

    0 drops the row, 1 empties its text, 2 removes every . ! and ? of it, 3 repeats the row, 4 sets the role user.
    Nulls of any column are one space there; conv_id and turn stay null.
    """
    blank = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    draw = crc_mod(F.concat(blank(conv_col), F.lit(":"), blank(turn_col)), 20)
    rows = turns.select(
        F.col(f"`{conv_col}`").alias("conv_id"), F.col(f"`{turn_col}`").cast("long").alias("turn"), blank(role_col).alias("role"), blank(text_col).alias("text"), draw.alias("draw")
    )
    text = F.when(F.col("draw") == 1, F.lit("")).when(F.col("draw") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("draw") == 4, F.lit("user")).otherwise(F.col("role"))
    kept = rows.where("draw <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), "draw")
    return kept.withColumn("copy", F.explode(F.expr("if(draw = 3, array(0, 1), array(0))"))).drop("copy", "draw")


class Repair:
    """Faults, audits and repaired rows of the conversations in turns; see repair_conversations()."""

    def __init__(self, turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, chunk_bits: int) -> None:
        part = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
        rows = turns.select(
            F.col(f"`{conv_col}`").alias("conv_id"), F.col(f"`{turn_col}`").cast("long").alias("turn"), part(role_col).alias("role"), part(text_col).alias("text")
        )
        self.kind = rows.schema["conv_id"].dataType.simpleString()
        rows = ordered(rows, ["conv_id", "turn", "role", "text"], "repair-rows")
        self._rows = rows.withColumn("block", F.expr(f"shiftright(_seq, {chunk_bits})")).drop("_part")
        self._marked = self._faults()
        self._chunks = self._solve()

    def _faults(self) -> DataFrame:
        """(conv_id, block, _seq, turn, initial, fault): what is left of a row without its texts, written."""
        bare = F.rtrim("text", F.lit(_SPACES))
        first = F.substring("role", 1, 1)
        narrow = self._rows.select(
            "conv_id",
            "block",
            "_seq",
            "turn",
            F.when(first.isin("s", "u", "a"), first).otherwise(F.lit("")).alias("initial"),
            (bare == "").alias("blank"),
            (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("cut"),
            F.sha2(F.concat(*(field_bytes(F.col(c)) for c in ("conv_id", "role", "text"))), 256).alias("mark"),
        )
        # Equal rows are counted before they meet: only marks that occur twice join, and those of a hot one by its first.
        twice = narrow.groupBy("mark").agg(F.min("_seq").alias("first_seq"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
        seen = F.coalesce(F.col("_seq") > F.col("first_seq"), F.lit(False))
        fault = F.when(F.col("blank"), BLANK).when(seen, DUPLICATE).when(F.col("cut"), CUT).otherwise(NONE)
        marked = narrow.join(twice, "mark", "left")
        return materialize(marked.select("conv_id", "block", "_seq", "turn", "initial", fault.alias("fault")), "repair-faults")

    def _solve(self) -> DataFrame:
        """(conv_id, block, entry, audit, cost, illegal) of each chunk, written; cost is that of the first chunk's start."""
        spans = self._marked.groupBy("conv_id").agg(F.min("block").alias("low"), F.max("block").alias("high"))
        several = materialize(spans.where("low < high"), "repair-several")
        alone = several.isEmpty()
        rows = self._marked
        if alone:
            rows = rows.withColumns({"after": F.lit(None).cast("array<long>"), "last": F.lit(True)})
        else:
            behind = materialize(self._behind(several), "repair-behind")
            rows = _with(rows, behind)
        chunks = _by_chunk(rows, _solve_chunk, self.kind, "illegal long, head string, tail string, cost long, audits array<string>, exits array<int>")
        if alone:
            chunks = chunks.withColumns({"entry": F.lit(0), "cross": F.lit(0).cast("long"), "first": F.lit(True)})
        else:
            chunks = materialize(chunks, "repair-chunks")
            parted = chunks.drop("audits").join(several, chunks["conv_id"].eqNullSafe(several["conv_id"]), "left_semi")
            entered = parted.groupBy("conv_id").applyInArrow(_enter, f"conv_id {self.kind}, block long, entry int, cross long, first boolean")
            chunks = _with(chunks, entered).withColumns({"entry": F.coalesce("entry", F.lit(0)), "first": F.coalesce("first", F.lit(True))})
        return materialize(
            chunks.select(
                "conv_id",
                "block",
                "entry",
                F.element_at("audits", F.least(F.col("entry") + 1, F.size("audits"))).alias("audit"),
                F.when(F.col("first"), F.col("cost")).alias("cost"),
                (F.col("illegal") + F.coalesce("cross", F.lit(0))).alias("illegal"),
            ),
            "repair-audits",
        )

    def _behind(self, several: DataFrame) -> DataFrame:
        """Distances at the end of each chunk of conversations that have several: (conv_id, block, after, last)."""
        rows = self._marked.join(several, self._marked["conv_id"].eqNullSafe(several["conv_id"]), "left_semi")
        rows = rows.withColumns({"after": F.lit(None).cast("array<long>"), "last": F.lit(True)})
        across = _by_chunk(rows, _cross_chunk, self.kind, "costs array<long>")
        return across.groupBy("conv_id").applyInArrow(_suffixes, f"conv_id {self.kind}, block long, after array<long>, last boolean")

    def audits(self) -> DataFrame:
        """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of conversations that have rows."""
        wide = "decimal(38,0)"
        most = F.lit((1 << 63) - 1).cast(wide)
        turn = F.col("turn").cast(wide)
        gaps = F.max(turn) - F.min(turn) + 1 - F.count_distinct("turn")
        counts = {"blank": BLANK, "duplicate": DUPLICATE, "truncated": CUT}
        faults = self._marked.groupBy("conv_id").agg(
            F.coalesce(F.when(gaps > most, most).otherwise(gaps), F.lit(0)).cast("long").alias("gaps"), *(F.count_if(F.col("fault") == v).alias(k) for k, v in counts.items())
        )
        pieces = F.array_sort(F.collect_list(F.struct("block", "audit")))
        found = self._chunks.groupBy("conv_id").agg(
            F.sum("illegal").alias("illegal"), F.max("cost").alias("cost"), F.array_join(F.transform(pieces, lambda x: x["audit"]), "").alias("audit")
        )
        found = found.withColumnRenamed("conv_id", "_conv")
        return faults.join(found, faults["conv_id"].eqNullSafe(found["_conv"])).drop("_conv")

    def turns(self) -> DataFrame:
        """The repaired rows (conv_id, pos, edit, role, text), in order: those of a conversation follow each other in
        one partition, as long as nothing is shuffled after this. Texts stream by; none is held longer than its batch."""
        plans = self._chunks.select("conv_id", "block", F.lit(-1).cast("long").alias("_seq"), "entry", F.col("audit").alias("role"), F.lit("").alias("text"))
        rows = self._rows.select("conv_id", "block", "_seq", F.lit(0).alias("entry"), "role", "text")
        both = plans.unionByName(rows).repartition("conv_id").sortWithinPartitions("conv_id", "block", "_seq")
        return both.mapInArrow(_edit, f"conv_id {self.kind}, pos long, edit string, role string, text string")


def repair_conversations(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", chunk_bits: int = CHUNK_BITS
) -> Repair:
    """The cheapest edits that make the roles of every conversation legal; audits() and turns() of the result.

    Rows go by (turn, role, text), nulls first. The first fault of a row counts: blank (white space only), duplicate
    (role and text seen before in the conversation), truncated (the last character but white space is none of . ! ?).
    Keep costs 0, rerole to user or assistant 1, delete 2 and is due for blank and duplicate rows, insert of an empty user or
    assistant turn 5; a truncated row that stays adds 5. Of equally cheap edits the audit, their initials, is the least.

    Null roles and texts are one space; a null conv_id is one conversation; null turns count in no gap. A role without
    a first letter, like any but s, u and a, cannot be kept. Repeated rows are duplicates. Gaps beyond a long are cut to
    it. An empty table gives empty results; other columns are not read.
    """
    return Repair(turns, conv_col, turn_col, role_col, text_col, chunk_bits)


def turn_digests(repaired: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256): SHA-256 of `role:text` of the rows of Repair.turns(), joined by line feeds.

    The digest of a conversation is sequential by definition; it is taken as its rows stream by, in bounded memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None
        for batch in batches:
            convs, found = [], []
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                line = f"{role}:{text}".encode()
                if digest is None or conv != now:
                    if digest is not None:
                        convs.append(now)
                        found.append(digest.hexdigest())
                    now, digest = conv, hashlib.sha256(line)
                else:
                    digest.update(b"\n" + line)
            yield pa.RecordBatch.from_arrays([pa.array(convs, batch.schema.field("conv_id").type), pa.array(found, pa.string())], ["conv_id", "repaired_sha256"])
            kind = batch.schema.field("conv_id").type
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], kind), pa.array([digest.hexdigest()])], ["conv_id", "repaired_sha256"])

    return repaired.mapInArrow(run, f"conv_id {repaired.schema['conv_id'].dataType.simpleString()}, repaired_sha256 string")


def repair_report(turns: DataFrame, damaged: DataFrame) -> DataFrame:
    """One row per conv_id of turns: the audit of its damaged rows and the digest of the repaired ones.

    A conversation without rows after the damage has zeros, an empty audit and the digest of nothing.
    """
    repair = repair_conversations(damaged)
    audits, digests = repair.audits(), turn_digests(repair.turns())
    every = turns.select("conv_id").distinct()
    parts = every.unionByName(audits, allowMissingColumns=True).unionByName(digests, allowMissingColumns=True)
    longs = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return parts.groupBy("conv_id").agg(
        *(F.coalesce(F.max(c), F.lit(0)).cast("long").alias(c) for c in longs),
        F.coalesce(F.max("audit"), F.lit("")).alias("audit"),
        F.coalesce(F.max("repaired_sha256"), F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


def _with(left: DataFrame, right: DataFrame) -> DataFrame:
    """left with the columns of right, by (conv_id, block), where there are any."""
    other = right.withColumnsRenamed({"conv_id": "_conv", "block": "_block"})
    same = left["conv_id"].eqNullSafe(other["_conv"]) & (left["block"] == other["_block"])
    return left.join(other, same, "left").drop("_conv", "_block")


def _by_chunk(rows: DataFrame, solve: Callable[..., tuple], kind: str, columns: str) -> DataFrame:
    """(conv_id, block) and what solve(rows' (initial, fault), after, last) gives for each chunk.

    Chunks follow each other in sorted partitions, so that a stream of batches serves many short conversations at once.
    """
    names = ["conv_id", "block", *(c.split()[0] for c in columns.split(", "))]
    schema = f"conv_id {kind}, block long, {columns}"
    types = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    types |= {f"array<{k}>": pa.list_(v) for k, v in types.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, kinds, with_ = None, [], ()
        conv_type = None
        batch_of = lambda out: pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (conv_type, *(types[x.split()[1]] for x in schema.split(", ")[1:])), strict=True)], names
        )
        for batch in batches:
            conv_type, out = batch.schema.field("conv_id").type, []
            values = (batch.column(c).to_pylist() for c in ("conv_id", "block", "initial", "fault", "after", "last"))
            for conv, block, initial, fault, after, last in zip(*values, strict=True):
                if key != (conv, block):
                    if key:
                        out.append((*key, *solve(kinds, *with_)))
                    key, kinds, with_ = (conv, block), [], (after, last)
                kinds.append((initial, fault))
            if out:
                yield batch_of(out)
        if key:
            yield batch_of([(*key, *solve(kinds, *with_))])

    dealt = rows.select("conv_id", "block", "_seq", "initial", "fault", "after", "last").repartition("conv_id", "block")
    return dealt.sortWithinPartitions("conv_id", "block", "_seq").mapInArrow(run, schema)


def _cross_chunk(kinds: list[tuple[str, int]], *_: object) -> tuple:
    to = [distances(kinds, [0 if s == t else FAR for s in STATES])[:4] for t in STATES]
    return ([to[t][s] for s in STATES for t in STATES],)


def _suffixes(table: pa.Table) -> pa.Table:
    table = table.sort_by("block")
    after, found = list(AT_END), []
    for costs in reversed(table["costs"].to_pylist()):
        found.append(after)
        after = [min(costs[4 * s + t] + after[t] for t in STATES) for s in STATES]
    last = [False] * (len(found) - 1) + [True]
    return pa.table({"conv_id": table["conv_id"], "block": table["block"], "after": pa.array(found[::-1], pa.list_(pa.int64())), "last": pa.array(last)})


def _solve_chunk(kinds: list[tuple[str, int]], after: list[int] | None, last: bool | None) -> tuple:
    """illegal, head, tail, cost, audits, exits; without `after` the chunk is a whole conversation, entered in state 0."""
    dist = distances(kinds, AT_END if after is None else after)
    walks = [walk(kinds, dist, s, last is not False) for s in (STATES if after else (0,))]
    illegal = sum(a + b not in ("su", "ua", "au") for (a, _), (b, _) in zip(kinds, kinds[1:], strict=False))
    return illegal, kinds[0][0], kinds[-1][0], dist[0], [w[0] for w in walks], [w[1] for w in walks]


def _enter(table: pa.Table) -> pa.Table:
    table = table.sort_by("block")
    state, before = 0, None
    entry, cross = [], []
    for head, tail, exits in zip(*(table[c].to_pylist() for c in ("head", "tail", "exits")), strict=True):
        entry.append(state)
        cross.append(int(before is not None and before + head not in ("su", "ua", "au")))
        state, before = exits[state], tail
    first = [True] + [False] * (len(entry) - 1)
    return pa.table({"conv_id": table["conv_id"], "block": table["block"], "entry": pa.array(entry, pa.int32()), "cross": pa.array(cross, pa.int64()), "first": pa.array(first)})


def _edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows after their chunk's audit become the repaired rows."""
    now, started, audit, at, state, pos = None, False, "", 0, 0, 0
    kind = None
    names = ["conv_id", "pos", "edit", "role", "text"]
    for batch in batches:
        kind = batch.schema.field("conv_id").type
        out: list[tuple] = []

        def insert() -> None:
            """Inserts that stand next in the audit."""
            nonlocal at, state, pos
            while at < len(audit) and audit[at] == "I":
                out.append((now, pos, "I", WANTED[state], ""))  # noqa: B023
                state, at, pos = INSERTS[state][1], at + 1, pos + 1

        for conv, seq, entry, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "_seq", "entry", "role", "text")), strict=True):
            if seq < 0:
                insert()
                if not started or conv != now:
                    now, started, pos = conv, True, 0
                audit, at, state = role, 0, entry
                continue
            insert()
            letter = audit[at]
            at += 1
            if letter != "D":
                shown = role if letter == "K" else WANTED[state]
                out.append((conv, pos, letter, shown, text))
                state, pos = NEXT[state][shown[0]], pos + 1
        yield _batch(out, kind, names)
    if started:
        out = []
        while at < len(audit):
            out.append((now, pos, "I", WANTED[state], ""))
            state, at, pos = INSERTS[state][1], at + 1, pos + 1
        yield _batch(out, kind, names)


def _batch(rows: list[tuple], kind: pa.DataType, names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 5
    types = [kind, pa.int64(), pa.string(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)
