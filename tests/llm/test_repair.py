import hashlib
import itertools
import random
import re
import zlib

import pytest

from docweave.llm import repair as rp

SCHEMA = "conv_id long, turn long, role string, text string, block int, _seq long, audit string"
SPACE = " \t\n\x0b\x0c\r"


def brute_damage(rows):
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text = " " if role is None else role, " " if text is None else text
        draw = zlib.crc32(key.encode()) % 20
        if draw == 0:
            continue
        text = "" if draw == 1 else re.sub("[.!?]", "", text) if draw == 2 else text
        yield from [(conv, turn, "user" if draw == 4 else role, text)] * (2 if draw == 3 else 1)


def brute_faults(rows):
    seen, found = set(), []
    for _, _, role, text in rows:
        bare = text.strip(SPACE)
        found.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return found


def every_repair(rows, faults, inserts):
    """All (cost, audit, repaired lines) with at most so many inserts, by trying every edit of every row."""
    legal = re.compile("(s?(ua)+)?")

    def rest(i, left):
        if i < len(rows):
            role, text = rows[i][2:]
            options = [(2, "D", [])]
            if faults[i] not in ("blank", "duplicate"):
                more = 5 if faults[i] == "truncated" else 0
                options += [(more, "K", [(role, text)])] + [(1 + more, "R", [(r, text)]) for r in ("user", "assistant")]
            for (c, a, x), (c2, a2, y) in itertools.product(options, rest(i + 1, left)):
                yield c + c2, a + a2, x + y
        else:
            yield 0, "", []
        if left:
            for role in ("user", "assistant"):
                for c, a, y in rest(i, left - 1):
                    yield c + 5, "I" + a, [(role, "")] + y

    return (x for x in rest(0, inserts) if legal.fullmatch("".join(r[:1] or "-" for r, _ in x[2])))


def brute_best(rows, faults):
    """(cost, audit, lines) by a table over (rows left, what came last): an exact search without queues."""
    after = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}

    def closed(best):
        for _ in range(3):
            for s, to in after.items():
                for role in ("user", "assistant"):
                    if role[0] in to and to[role[0]] in best:
                        c, a, x = best[to[role[0]]]
                        best[s] = min(best.get(s, (1 << 60, "", [])), (c + 5, "I" + a, [(role, ""), *x]))
        return best

    best = closed({"": (0, "", []), "a": (0, "", [])})
    for (_, _, role, text), fault in zip(reversed(rows), reversed(faults), strict=True):
        found = {}
        for s, to in after.items():
            c, a, x = best[s]
            options = [(c + 2, "D" + a, x)]
            if fault not in ("blank", "duplicate"):
                more = 5 if fault == "truncated" else 0
                for letter, cost, r in (("K", 0, role), ("R", 1, "user"), ("R", 1, "assistant")):
                    if r[:1] in to and r:
                        c, a, x = best[to[r[:1]]]
                        options.append((c + cost + more, letter + a, [(r, text), *x]))
            found[s] = min(options)
        best = closed(found)
    return best[""]


def brute(rows):
    out = []
    for conv in {r[0] for r in rows}:
        own = sorted(brute_damage(r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        faults = brute_faults(own)
        turns = [r[1] for r in own if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum((a[2][:1] + b[2][:1]) not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        cost, audit, lines = brute_best(own, faults)
        text = "\n".join(f"{r}:{t}" for r, t in lines)
        out.append((str(conv), gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out)


def found(df):
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    return sorted((str(r.conv_id), *(r[c] for c in names)) for r in df.collect())


def test_table_search_equals_every_repair():
    rng = random.Random(3)
    for _ in range(60):
        rows = [(1, i, rng.choice(["user", "assistant", "system", " ", "tool", ""]), rng.choice(["a.", "b!", "c", " ", "a."])) for i in range(rng.randrange(4))]
        faults = brute_faults(rows)
        assert brute_best(rows, faults) == min(every_repair(rows, faults, 2))


def test_distances_and_walk_equal_brute_force():
    rng = random.Random(4)
    codes = {"blank": rp.BLANK, "duplicate": rp.DUPLICATE, "truncated": rp.CUT, "": rp.NONE}
    for _ in range(200):
        rows = [(1, i, rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["a.", "b!", "c", "d", " ", "e?", "f."])) for i in range(rng.randrange(12))]
        faults = brute_faults(rows)
        kinds = [(r[2][0] if r[2][0] in "sua" else "", codes[f]) for r, f in zip(rows, faults, strict=True)]
        dist = rp.distances(kinds, rp.AT_END)
        cost, audit, _ = brute_best(rows, faults)
        assert (dist[0], rp.walk(kinds, dist, 0, True)[0]) == (cost, audit)


def test_walk_inserts_where_nothing_else_is_left():
    """At these costs a deletion is always cheaper than an insert; states that are entered without rows show inserts."""
    dist = rp.distances([], rp.AT_END)
    assert [rp.walk([], dist, s, True) for s in rp.STATES] == [("", 0), ("II", 3), ("I", 3), ("", 3)]
    kinds = [("u", rp.NONE)]
    assert rp.walk(kinds, rp.distances(kinds, rp.AT_END), 2, True) == ("R", 3)


def sample(seed, convs, turns):
    rng = random.Random(seed)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None]
    texts = ["Yes.", "No!", "Why?", "cut off", "cut é", " \n", "", None, "a\nb.", "X." * 2000]
    rows = []
    for conv in [*range(convs), None]:
        for t in range(rng.randrange(1, turns)):
            turn = rng.choice([t, t, t, t + 5, None, 0])
            role = rng.choice(roles[:4] if rng.random() < 0.8 else roles)
            rows.append((conv, turn, role, rng.choice(texts) if rng.random() < 0.4 else f"Text {rng.randrange(10**6)}."))
    return rows + rows[:3] + [(777, 1, None, None)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "x") for r in rows], SCHEMA).repartition(6)


def test_report_equals_brute_force(spark):
    rows = sample(1, 60, 12)
    turns = frame(spark, rows)
    got = found(rp.repair_report(turns, rp.damage(turns)))
    assert got == brute(rows)
    assert sum(r[2] for r in got) and sum(r[3] for r in got) and sum(r[4] for r in got)


@pytest.mark.parametrize("bits", [0, 2])
def test_chunks_of_long_conversations(spark, monkeypatch, bits):
    """Chunks of one and of four rows: distances, entries, audits and texts are put together across them."""
    rows = sample(2, 5, 70)
    turns = frame(spark, rows)
    monkeypatch.setattr(rp, "repair_conversations", lambda df, make=rp.repair_conversations: make(df, chunk_bits=bits))
    assert found(rp.repair_report(turns, rp.damage(turns))) == brute(rows)


def test_one_hot_conversation(spark):
    rows = [(1, i, ("user", "assistant")[i % 2], f"Turn {i}.") for i in range(9000)] + [(2, 0, "user", "Hi.")]
    assert found(rp.repair_report(frame(spark, rows), rp.damage(frame(spark, rows)))) == brute(rows)


def test_repaired_turns(spark):
    rows = [(1, 0, "system", "Be."), (1, 1, "tool", "Ask."), (1, 2, "assistant", "Say."), (1, 3, "assistant", "Say."), (2, 0, "assistant", "x.")]
    repaired = rp.repair_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).turns()
    got = [tuple(r) for r in repaired.collect()]
    assert sorted(got) == [(1, 0, "K", "system", "Be."), (1, 1, "R", "user", "Ask."), (1, 2, "K", "assistant", "Say.")]
    assert [r[1] for r in got if r[0] == 1] == [0, 1, 2]


def test_no_conversations_and_none_left(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert rp.repair_report(empty, rp.damage(empty)).collect() == []
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    rows = [(gone, 0, "user", "Hello.")]
    assert found(rp.repair_report(frame(spark, rows), rp.damage(frame(spark, rows)))) == [(str(gone), 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
