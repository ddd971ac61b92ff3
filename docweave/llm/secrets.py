"""Secret scans over a trigram inverted index, all in DataFrame functions."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.llm.common import ascii_lower, key_bitmap, with_bitmap_flag
from docweave.llm.trigrams import Query, trigram_query, trigrams_of
from docweave.session import materialize

#: Documents to a block of the index: no posting list is longer.
BLOCK_DOCS = 4096
#: Matches of one text that are placed at a time.
RUN = 128


@dataclass(frozen=True)
class Rule:
    """A kind of secret. A match counts if its group is at least `least` characters long."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    base: bool = False


RULES = (
    Rule(
        "assign",
        r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        group=2,
        least=12,
        base=True,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", least=18, base=True),
    Rule("hex", r"[0-9a-f]{16,}", base=True),  # runs are maximal, so shorter ones can be left out at once
    Rule("pem", r"-----BEGIN (RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----"),
    Rule("github", r"gh[oprsu]_[A-Za-z0-9]+", least=40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", least=16),
)


def _postings(docs: DataFrame, grams: Sequence[str], blocks: int) -> DataFrame:
    """The inverted index of the trigrams that any rule asks for: block, {trigram: ids}."""
    # One reference per trigram keeps the lower-cased text a column of its own, computed once.
    present = F.array_compact(F.array(*(F.when(F.contains("low", F.lit(g)), F.lit(g)) for g in grams)))
    return (
        docs.withColumn("low", ascii_lower(F.col("text")))
        .select("doc_id", F.explode(present).alias("gram"))
        .groupBy(F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).alias("block"), "gram")
        .agg(F.collect_set(F.struct("doc_id")).alias("ids"))
        .groupBy("block")
        .agg(F.map_from_entries(F.collect_list(F.struct("gram", "ids"))).alias("lists"))
    )


def _answer(query: Query) -> Column:
    """The ids that satisfy a query within a block."""
    if isinstance(query, str):
        return F.coalesce(F.element_at("lists", F.lit(query)), F.expr("filter(map_values(lists)[0], x -> false)"))
    join = F.array_intersect if query[0] == "and" else F.array_union
    found = _answer(query[1][0])
    for part in query[1][1:]:
        found = join(found, _answer(part))
    return found


def _tagged(kind: str, ids: Column) -> Column:
    return F.transform(ids, lambda x: F.struct(F.lit(kind).alias("kind"), x["doc_id"].alias("doc_id")))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _spans(rule: Rule, text: Column, number: int) -> Column:
    """Array of (start, number, end) in code points: the text between matches and the matches add up to positions."""
    pattern = F.lit(rule.pattern)
    between = F.split(text, rule.pattern, -1)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    tested = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else found
    lengths = F.zip_with(
        F.slice(between, F.lit(1), F.size(found)),
        F.arrays_zip(found.alias("whole"), tested.alias("part")),
        lambda gap, m: F.struct(
            F.length(gap).alias("gap"), F.length(m["whole"]).alias("size"), F.length(m["part"]).alias("tested")
        ),
    )
    none = F.expr("cast(array() as array<struct<start:int,number:int,end:int,tested:int>>)")
    # In runs of RUN matches: an array that grows by one element at a time is copied each time.
    def in_runs(all_: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(all_) + 1, F.lit(RUN))
        return F.transform(starts, lambda i: F.slice(all_, i, F.lit(RUN)))

    def begins(runs: Column) -> Column:
        return F.aggregate(
            runs,
            F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("all")),
            lambda acc, run: F.struct(
                F.aggregate(run, acc["at"], lambda n, x: n + x["gap"] + x["size"]).alias("at"),
                F.concat(acc["all"], F.array(acc["at"])).alias("all"),
            ),
            lambda acc: acc["all"],
        )

    def walk(run: Column, begin: Column) -> Column:
        return F.aggregate(
            run,
            F.struct(begin.alias("at"), none.alias("spans")),
            lambda acc, x: F.struct(
                (acc["at"] + x["gap"] + x["size"]).alias("at"),
                F.concat(
                    acc["spans"],
                    F.array(
                        F.struct(
                            (acc["at"] + x["gap"]).alias("start"),
                            F.lit(number).alias("number"),
                            (acc["at"] + x["gap"] + x["size"]).alias("end"),
                            x["tested"].alias("tested"),
                        )
                    ),
                ).alias("spans"),
            ),
            lambda acc: F.filter(acc["spans"], lambda s: s["tested"] >= rule.least),
        )

    walked = _let(lengths, lambda all_: _let(in_runs(all_), lambda runs: F.flatten(F.zip_with(runs, begins(runs), walk))))
    return F.when(F.regexp_like(text, pattern), walked).otherwise(none)


def _text_of(spans: Column, kinds: Sequence[str]) -> Column:
    names = F.array(*map(F.lit, kinds))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["number"] + 1), s["start"], s["end"])), ","
    )


def scan_secrets(
    docs: DataFrame, rules: Sequence[Rule] = RULES, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per input row: doc_id, n_<kind> for each rule, base_sha256, spans.

    Spans are kind:start:end in code points, end exclusive, by start and then in the order of the rules; the digest
    covers those of base rules. Null texts count as empty. Rows that share an id (or have none) are scanned each for
    itself. An empty table gives an empty result; other columns of docs are not read.

    1. A Boolean trigram query is derived from each pattern. One scan builds an inverted index of the trigrams that
       the queries mention, in blocks of a bounded number of documents.
    2. Within each block the posting lists are intersected and united as the query says. A rule's candidates set
       bits of a bitmap, which is broadcast within its bound: no text is shuffled.
    3. A second scan verifies candidates with the pattern itself. Rules without mandatory trigrams scan every text.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    asked = {r.kind: trigram_query(r.pattern) for r in rules}
    asked = {kind: q for kind, q in asked.items() if q is not True}
    flagged = base
    if asked:
        grams = sorted({t for q in asked.values() for t in trigrams_of(q)})
        blocks = max(1, -(-docs.count() // BLOCK_DOCS))
        index = _postings(base, grams, blocks)
        found = materialize(
            index.select(F.explode(F.concat(*(_tagged(kind, _answer(q)) for kind, q in asked.items()))).alias("c")).select(
                "c.*"
            ),
            "candidates",
        )
        size = {r["kind"]: r["count"] for r in found.groupBy("kind").count().collect()}  # one row a rule
        for kind in asked:
            bitmap = key_bitmap(found.where(F.col("kind") == kind), "doc_id", size.get(kind, 0))
            flagged = with_bitmap_flag(flagged, F.col("doc_id"), bitmap, f"may_{kind}")
    none = F.expr("cast(array() as array<struct<start:int,number:int,end:int,tested:int>>)")
    columns = {}
    for number, rule in enumerate(rules):
        spans = _spans(rule, F.col("text"), number)
        columns[f"s_{rule.kind}"] = F.when(F.col(f"may_{rule.kind}"), spans).otherwise(none) if rule.kind in asked else spans
    kinds = [r.kind for r in rules]
    sorted_ = lambda chosen: F.array_sort(F.concat(*(F.col(f"s_{r.kind}") for r in chosen)))
    return (
        flagged.select("doc_id", *(c.alias(n) for n, c in columns.items()))
        .select(
            "doc_id",
            *(F.size(f"s_{k}").cast("long").alias(f"n_{k}") for k in kinds),
            F.sha2(_text_of(sorted_([r for r in rules if r.base]), kinds), 256).alias("base_sha256"),
            _text_of(sorted_(rules), kinds).alias("spans"),
        )
    )
