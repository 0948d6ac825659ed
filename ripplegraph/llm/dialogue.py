"""Conversation repair: generalised LR parsing of the role sequence with weighted edits.

Roles follow ``Talk -> empty | Pairs | s Pairs; Pairs -> u a | Pairs u a`` by their initials.  A
graph-structured stack holds one node per LR state (equal tops are merged, the one with the smallest
(cost, audit) stays): 0 start, 1 after s, 2 after the first u, 3 after Pairs, 4 after Pairs u; shifting
a in 2 or 4 reduces to Pairs and goes to 3.  0 and 3 accept.  On a row a node may keep it (cost 0, if
its initial can be shifted), rerole it to what can be shifted (2) or delete it (3); before keep and
rerole one turn may be inserted (2), at the end up to two.  More insertions in one place come back to
an equal state at a higher cost, and an insertion before a deletion is the same as one after it with a
larger audit, so neither is tried.  Truncated rows that stay add 1.

Audits are compared without being built: the audits of two nodes that have read the same rows both end
with the letter of a row, so neither is the beginning of the other, and their order stays what it was
at the first difference.  A node keeps its rank and the letters of its last step.

A conversation may be larger than a task.  Rows are dealt by range over (conversation, turn, role,
digest), equal rows as one with their number; a stretch of one conversation in one range gives a table
of (cost, rank) from each state that the stretch may be entered in to each state that it may be left
in.  A conversation's stretches, as many as there are ranges, are joined from these small tables, then
each stretch is parsed again between the states chosen.  Texts take part only at the end: each text that stays is
joined by digest, texts of a stretch are put together in pieces, and the pieces of a conversation
stream through its hash, as SHA-256 needs them in order.

Rows are taken by turn, nulls first, then role, then the SHA-256 of the text.  Null roles and texts are
one space, so the row is blank or has an initial that fits nowhere; an empty role fits nowhere either.
A null conversation id is a conversation of its own.  Repeated rows are duplicates of the first.  Empty
tables give no rows.  Conversations without rows have zeros, an empty audit and the hash of the empty
string.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplegraph.session import materialize

#: Initial that a state shifts, and the state after it (reductions done); state 0 also shifts s.
NEXT = {0: ("u", 2), 1: ("u", 2), 2: ("a", 3), 3: ("u", 4), 4: ("a", 3)}
ACCEPT = (0, 3)
STATES = range(5)
ROLE = {"u": "user", "a": "assistant"}
REROLE, DELETE, INSERT, CUT = 2, 3, 2, 1
LEGAL = ("su", "ua", "au")
#: Salts of the first uses of a text, and bytes of a piece.
SALTS, PIECE = 32, 1 << 20
#: Most rows of a range, on average; white space of the fault tests.
RANGE, SPACE = 50_000, " \t\n\v\f\r"

#: A row for the parser: initial, whether it must go, whether it is truncated, and how many rows equal it.
Row = tuple[str, bool, bool, int]


class Node:
    """A stack top: LR state, cost and rank of its audit, and the letters that led here from ``back``."""

    __slots__ = ("state", "cost", "rank", "letters", "back")

    def __init__(self, state: int, cost: int, rank: int, letters: str, back: Node | None) -> None:
        self.state, self.cost, self.rank, self.letters, self.back = state, cost, rank, letters, back


def _steps(node: Node, row: Row) -> Iterator[tuple[int, int, str]]:
    """(state, cost, letters) of what a node can do with a row."""
    initial, gone, cut, _ = row
    yield node.state, node.cost + DELETE, "D"
    if gone:
        return
    state, cost, before = node.state, node.cost + (CUT if cut else 0), ""
    for _ in range(2):
        shift, after = NEXT[state]
        if initial == "s" and state == 0:
            yield 1, cost, "K"
        elif initial == shift:
            yield after, cost, before + "K"
        yield after, cost + REROLE, before + "R"
        state, cost, before = after, cost + INSERT, "I"


def parse(rows: list[Row], entry: int) -> dict[int, Node]:
    """The stack tops after ``rows``, by state, from one state of entry."""
    tops = {entry: Node(entry, 0, 0, "", None)}
    for row in rows:
        best: dict[int, tuple[int, int, str, Node]] = {}
        for node in tops.values():
            for state, cost, letters in _steps(node, row):
                made = (cost, node.rank, letters, node)
                if state not in best or made[:3] < best[state][:3]:
                    best[state] = made
        more = DELETE * (row[3] - 1)  # the rows that equal this one are duplicates
        order = sorted(best, key=lambda s: best[s][1:3])
        tops = {s: Node(s, best[s][0] + more, rank, best[s][2], best[s][3]) for rank, s in enumerate(order)}
    return tops


def letters_of(node: Node) -> list[str]:
    """Letters of each row on the way to a node."""
    out = []
    while node.back is not None:
        out.append(node.letters)
        node = node.back
    return out[::-1]


def transfer(rows: list[Row], entries: Iterable[int] = STATES) -> list[tuple[int, int, int, int]]:
    """(entry, exit, cost, rank) of a stretch; ranks order the audits of all ways through it, equal audits alike."""
    ways = [(e, s, n.cost, letters_of(n)) for e in entries for s, n in parse(rows, e).items()]
    place = {x: i for i, x in enumerate(sorted({tuple(w[3]) for w in ways}))}
    return [(e, s, c, place[tuple(x)]) for e, s, c, x in ways]


def chain(stretches: Iterable[list[tuple[int, int, int, int]]]) -> tuple[int, list[tuple[int, int]], str]:
    """Cost, (entry, exit) of each stretch and the letters inserted at the end; keeps five bytes of a stretch."""
    tops, came = {0: (0, 0)}, []
    for table in stretches:
        best: dict[int, tuple[int, int, int, int]] = {}
        for entry, state, cost, rank in table:
            if entry in tops:
                made = (tops[entry][0] + cost, tops[entry][1], rank, entry)
                if state not in best or made < best[state]:
                    best[state] = made
        order = sorted(best, key=lambda s: best[s][1:3])
        tops = {s: (best[s][0], rank) for rank, s in enumerate(order)}
        came.append(bytes(best[s][3] if s in best else 255 for s in STATES))
    ends = []
    for start, (cost, rank) in tops.items():
        state, tail = start, ""
        while state not in ACCEPT:
            state, tail = NEXT[state][1], tail + "I"
        ends.append((cost + INSERT * len(tail), rank, tail, start))
    cost, _, tail, state = min(ends)
    path = []
    for back in reversed(came):
        path.append((back[state], state))
        state = back[state]
    return cost, path[::-1], tail


def damage(talks: DataFrame) -> DataFrame:
    """Rows of (conv_id, turn, role, text) after damage by crc32(conv_id:turn) % 20, equal rows as one with ``times``.

    0 drops a row, 1 empties it, 2 removes its sentence ends, 3 repeats it, 4 makes it the user's.
    """
    name = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    kind = F.crc32(F.concat(name[0], F.lit(":"), name[1]).cast("binary")) % 20
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    hit = talks.withColumn("_kind", kind).filter("_kind <> 0")
    changed = F.when(F.col("_kind") == 1, F.lit("")).when(F.col("_kind") == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    return hit.select("conv_id", "turn", F.when(F.col("_kind") == 4, F.lit("user")).otherwise(role).alias("role"), changed.alias("text"), F.when(F.col("_kind") == 3, 2).otherwise(1).cast("bigint").alias("times"))


def conversation(c: Column) -> Column:
    """A key that is never null."""
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit(""))


def _streamed(df: DataFrame, schema: str, step: Callable[[Iterator[dict]], Iterator[dict]]) -> DataFrame:
    """``step`` over the rows of each partition in their order, a batch at a time."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = [], 0
        for row in step(r for b in batches for at in range(0, b.num_rows, 1024) for r in b.slice(at, 1024).to_pylist()):
            out.append(row)
            held += len(row.get("bytes") or b"")
            if len(out) == 4096 or held > 8 * PIECE:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)
                out, held = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return df.mapInArrow(run, schema)


def faults(rows: DataFrame) -> DataFrame:
    """(conv, turn, role, digest, blank, cut, seen, times) per different row; the last three: truncated, role and text of an earlier turn, equal rows."""
    bare = F.rtrim("text", F.lit(SPACE))
    narrow = rows.select("conv", "turn", "role", F.sha2("text", 256).alias("digest"), (bare == "").alias("blank"), (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("cut"), "times")
    keys = ["conv", "turn", "role", "digest"]
    unique = materialize(narrow.groupBy(*keys, "blank", "cut").agg(F.sum("times").alias("times")), "turns")
    first = unique.filter("not blank").groupBy("conv", "role", "digest").agg(F.min(F.struct(F.col("turn").isNotNull().alias("some"), "turn")).alias("first"), F.count("*").alias("n"))
    first = first.filter("n > 1").select("conv", "role", "digest", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = unique.withColumn("salt", F.pmod(F.xxhash64("turn"), F.lit(SALTS)).cast("int"))
    joined = salted.join(first, ["conv", "role", "digest", "salt"], "left")
    later = F.struct(F.col("turn").isNotNull().alias("some"), F.col("turn")) > F.col("first")
    return joined.select(*keys, "blank", "cut", F.coalesce(later, F.lit(False)).alias("seen"), "times")


def _row(r: dict) -> Row:
    return r["role"][:1], r["blank"] or r["seen"], r["cut"], r["times"]


def _stretch_of(r: dict) -> tuple[str, int]:
    return r["conv"], r["part"]


def _summaries(rows: Iterator[dict]) -> Iterator[dict]:
    range_before = None
    for (conv, part), group in groupby(rows, _stretch_of):
        own = list(group)  # at most one range of narrow rows
        initials = [r["role"][:1] for r in own]
        fits = sum(a + b in LEGAL for a, b in zip(initials, initials[1:], strict=False))
        # only the first conversation of a range may have begun in another one
        ways = transfer([_row(r) for r in own], (0,) if part == range_before else STATES)
        range_before = part
        yield {
            "conv": conv, "part": part, "ways": [{"entry": w[0], "exit": w[1], "cost": w[2], "rank": w[3]} for w in ways],
            "rows": sum(r["times"] for r in own), "fits": fits, "first": initials[0], "last": initials[-1],
            "blank": sum(r["times"] for r in own if r["blank"]),
            "duplicate": sum(r["times"] if r["seen"] else r["times"] - 1 for r in own if not r["blank"]),
            "truncated": sum(r["cut"] for r in own if not r["blank"] and not r["seen"]),
        }


def _choices(rows: Iterator[dict]) -> Iterator[dict]:
    """One row per stretch with its states, the last one of a conversation with its counts."""
    for conv, group in groupby(rows, lambda r: r["conv"]):
        total, parts = dict.fromkeys(("blank", "duplicate", "truncated", "rows", "fits"), 0), []

        def tables(group: Iterator[dict] = group, total: dict = total, parts: list = parts) -> Iterator[list]:
            before = ""
            for r in group:
                for c in total:
                    total[c] += r[c]
                total["fits"] += before + r["first"] in LEGAL
                before = r["last"]
                parts.append(r["part"])
                yield [(w["entry"], w["exit"], w["cost"], w["rank"]) for w in r["ways"]]

        cost, path, tail = chain(tables())
        counts = {"cost": cost, "illegal": total["rows"] - 1 - total["fits"], **{c: total[c] for c in ("blank", "duplicate", "truncated")}}
        for i, (part, (entry, leave)) in enumerate(zip(parts, path, strict=True), 1):
            last = i == len(parts)
            yield {"conv": conv, "part": part, "entry": entry, "exit": leave, "tail": tail if last else "", "only": len(parts) == 1, **(counts if last else {})}


def _decisions(rows: Iterator[dict]) -> Iterator[dict]:
    """Per row: its letters and the roles of the turns that it leaves; the row of the choice (pos -1) stands before its stretch."""
    for (conv, part), group in groupby(rows, _stretch_of):
        choice = next(group)
        own = list(group)
        letters = letters_of(parse([_row(r) for r in own], choice["entry"])[choice["exit"]])
        state = choice["entry"]
        out = {"conv": conv, "part": part, "only": choice["only"]}
        for r, step in zip(own, letters, strict=True):
            roles = []
            for x in step:
                if x == "D":
                    continue
                if x == "K":
                    roles.append(r["role"])
                    state = 1 if state == 0 and r["role"][:1] == "s" else NEXT[state][1]
                else:
                    roles.append(ROLE[NEXT[state][0]])
                    state = NEXT[state][1]
            yield {**out, "pos": r["pos"], "letters": step, "more": r["times"] - 1, "inserted": roles[:-1] if step[-1] != "D" else [], "as_role": roles[-1] if step[-1] != "D" else None, "role": r["role"], "digest": r["digest"]}
        if choice["tail"]:
            roles = []
            for _ in choice["tail"]:
                roles.append(ROLE[NEXT[state][0]])
                state = NEXT[state][1]
            yield {**out, "pos": own[-1]["pos"] + 1, "letters": choice["tail"], "more": 0, "inserted": roles, "as_role": None, "role": None, "digest": None}


def _pieces(rows: Iterator[dict]) -> Iterator[dict]:
    """Lines and letters of a stretch in pieces; a conversation of one stretch is hashed here."""
    for (conv, part), group in groupby(rows, _stretch_of):
        only, sha, lines, letters, size, number = False, hashlib.sha256(), [], [], 0, 0
        started = False
        for r in group:
            only = r["only"]
            for role, text in [(x, b"") for x in r["inserted"]] + ([(r["as_role"], r["text"])] if r["as_role"] is not None else []):
                line = role.encode() + b":" + text
                lines.append(line)
                size += len(line) + 1
            letters.append(r["letters"] + "D" * r["more"])
            size += len(letters[-1])
            if only and lines:
                sha.update((b"\n" if started else b"") + b"\n".join(lines))
                started, lines = True, []
            if not only and size >= PIECE:
                yield {"conv": conv, "part": part, "number": number, "bytes": b"\n".join(lines) if lines else None, "letters": "".join(letters), "sha": None}
                lines, letters, size, number = [], [], 0, number + 1
        yield {"conv": conv, "part": part, "number": number, "bytes": b"\n".join(lines) if lines else None, "letters": "".join(letters), "sha": sha.hexdigest() if only else None}


def _hashes(rows: Iterator[dict]) -> Iterator[dict]:
    for conv, group in groupby(rows, lambda r: r["conv"]):
        sha, letters, started, done = hashlib.sha256(), [], False, None
        for r in group:
            letters.append(r["letters"])
            done = r["sha"]
            if r["bytes"] is not None:
                sha.update((b"\n" if started else b"") + r["bytes"])
                started = True
        yield {"conv": conv, "audit": "".join(letters), "repaired_sha256": done or sha.hexdigest()}


def turns(rows: DataFrame, most: int = RANGE) -> tuple[DataFrame, DataFrame]:
    """Decisions over damaged ``rows`` (conv, turn, role, text, times): (conv, part, pos, letters, more, inserted, as_role, role, digest, only), and the counts per conversation."""
    marked = materialize(faults(rows), "faults")
    ranges = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-marked.count() // most))
    order = ["conv", "turn", "role", "digest"]
    dealt = marked.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()).withColumn("pos", F.monotonically_increasing_id())
    dealt = materialize(dealt, "dealt-turns")
    own = dealt.repartition(ranges, "part").sortWithinPartitions("part", "pos")
    ways = "array<struct<entry:int,exit:int,cost:bigint,rank:int>>"
    told = _streamed(own, f"conv string, part int, ways {ways}, rows bigint, fits bigint, first string, last string, blank bigint, duplicate bigint, truncated bigint", _summaries)
    told = materialize(told, "stretches")
    counts = "cost bigint, illegal bigint, blank bigint, duplicate bigint, truncated bigint"
    chosen = materialize(_streamed(told.repartition("conv").sortWithinPartitions("conv", "part"), f"conv string, part int, entry int, exit int, tail string, only boolean, {counts}", _choices), "choices")
    head = chosen.select("conv", "part", F.lit(-1).cast("bigint").alias("pos"), "entry", "exit", "tail", "only")
    both = dealt.unionByName(head, allowMissingColumns=True).repartition(ranges, "part").sortWithinPartitions("part", "conv", "pos")
    made = _streamed(both, "conv string, part int, only boolean, pos bigint, letters string, more bigint, inserted array<string>, as_role string, role string, digest string", _decisions)
    return materialize(made, "decisions"), chosen.filter("cost is not null").select("conv", "cost", "illegal", "blank", "duplicate", "truncated")


def repaired(rows: DataFrame, decisions: DataFrame) -> DataFrame:
    """``decisions`` with the text (binary) of each turn that stays."""
    kept = decisions.filter("as_role is not null")
    texts = rows.select("conv", "role", F.sha2("text", 256).alias("digest"), F.col("text").cast("binary").alias("text")).dropDuplicates(["conv", "role", "digest"])
    return kept.join(texts, ["conv", "role", "digest"]).unionByName(decisions.filter("as_role is null").withColumn("text", F.lit(None).cast("binary")))


def repair(talks: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", damaged: Callable[[DataFrame], DataFrame] | None = damage, most: int = RANGE) -> DataFrame:
    """One row per conversation: counts of faults, cost and audit of the cheapest repair and the hash of its lines.

    ``damaged`` changes the rows first (None: they are taken as they are, nulls as one space).
    """
    named = talks.select(F.col(conv).alias("conv_id"), F.col(turn).cast("bigint").alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    whole = named.select("conv_id", "turn", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")), F.lit(1).cast("bigint").alias("times"))
    rows = (damaged(named) if damaged else whole).withColumn("conv", conversation(F.col("conv_id")))
    decisions, counts = turns(rows, most)
    at = ["conv", "part"]
    pieces = _streamed(repaired(rows, decisions).repartition(*at).sortWithinPartitions(*at, "pos"), "conv string, part int, number int, bytes binary, letters string, sha string", _pieces)
    hashes = _streamed(pieces.repartition("conv").sortWithinPartitions("conv", "part", "number"), "conv string, audit string, repaired_sha256 string", _hashes)
    seen = rows.filter("turn is not null").groupBy("conv", "turn").agg(F.lit(1).alias("one")).groupBy("conv").agg((F.max("turn") - F.min("turn") + 1 - F.count("*")).alias("gaps"))
    all_ids = named.select("conv_id").distinct().withColumn("conv", conversation(F.col("conv_id")))
    zero = F.lit(0).cast("bigint")
    out = all_ids.join(counts, "conv", "left").join(hashes, "conv", "left").join(seen, "conv", "left")
    numbers = [F.coalesce(c, zero).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
