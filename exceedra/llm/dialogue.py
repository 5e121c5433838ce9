"""Operator 12: repair of conversation structure by an auction for shortest paths.

A conversation's rows, in order, span a lattice: a node is a place between rows and what the
repaired conversation ends with so far (nothing, system, user, assistant).  Keeping, giving
another role to, deleting or inserting a row is an arc with an integer cost, and the cheapest
legal repair is a shortest path.

The auction keeps a price for every node, never above the true cost from there, and a path.
At the path's last node, if all arcs cost more than its price, the price rises to the
cheapest and the path contracts by a node; otherwise it is extended along the cheapest arc.
A path that reaches the end, or a node with a settled price, settles all its nodes.  Arcs
that settled prices make tight lie on a shortest path; the trace takes the tight arc with the
least letter whose end the auction, started there, leaves tight.  Each letter leaves a node
by one arc at most, so this trace is the least string of letters.

Rows are narrowed to a code each (initial and fault) before anything is ordered; texts move
once, at the end.  Codes are range-partitioned and cut into segments of at most ``SEGMENT``
rows, so a conversation of any length is spread over tasks.  Where a conversation has several
segments, each is reduced to its costs between the four states at either end, those meet in
one task for each conversation (20 numbers for a segment) and give the prices behind each
segment, and the segments are then traced apart for each state they may be entered in.

A conversation's repaired text is one stream in order, as its digest needs it; a task that
writes it holds a batch of rows and the letters of a segment or two.

Defined cases: a null id, turn, role or text counts as one space, but a null turn is first in
order and no number; rows of the same turn are ordered by role, then the first 64 characters
of the text, then its sha256; equal rows are copies of one; a role is told by its first
character, none for an empty role; a conversation all of whose rows are gone returns zeros; an
empty table returns no row; texts may be of any length, only their features are ordered;
other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from exceedra.llm.common import arrow_map, materialize, no_clash, read_table, shuffle_partitions

KEEP, REROLE, DELETE, INSERT, LEFT_TRUNCATED = 0, 3, 4, 3, 3
SEGMENT = 256
KEPT_AUDITS = 100_000
BLANKS = " \t\n\x0b\x0c\r"

# Codes: the initial (s, u, a, another) + 4 for a truncated row, + 8 for one that must go.
INITIALS = "sua"
TRUNCATED, MUST_GO = 4, 8
START, SYSTEM, USER, ASSISTANT = range(4)
_OWED = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
_KEPT = {(START, 0): SYSTEM, (START, 1): USER, (SYSTEM, 1): USER, (USER, 2): ASSISTANT, (ASSISTANT, 1): USER}
ACCEPTED = (0, None, None, 0)


def _arcs() -> list[tuple[tuple[str, int, int], ...]]:
    """By 4 * code + state: (letter, step in node numbers, cost), letters in order."""
    out = []
    for code in range(12):
        left = LEFT_TRUNCATED if code & TRUNCATED else 0
        for s in range(4):
            owed = _OWED[s] - s
            arcs = [("D", 4, DELETE), ("I", owed, INSERT)]
            if code < MUST_GO:
                if (s, code & 3) in _KEPT:
                    arcs.append(("K", 4 + _KEPT[s, code & 3] - s, KEEP + left))
                arcs.append(("R", 4 + owed, REROLE + left))
            out.append(tuple(arcs))
    return out


ARCS = _arcs()


class Auction:
    """Prices of one segment's lattice; ``end`` has the cost behind each last state, None for no way.

    In a conversation's last segment rows may be inserted behind the last row, too.
    """

    def __init__(self, codes: bytes, end: tuple, last: bool) -> None:
        n = len(codes)
        self.end = 4 * (n + 1)
        self.arcs = [ARCS[4 * c + s] for c in codes for s in range(4)]
        for s in range(4):
            away = ((("", self.end - 4 * n - s, end[s]),) if end[s] is not None else ()) + ((("I", _OWED[s] - s, INSERT),) if last else ())
            self.arcs.append(away)
        # What no path avoids: rows that must go, and truncated rows kept at best.
        price = min(e for e in end if e is not None)
        self.price = [price] * 4
        for c in reversed(codes):
            price += DELETE if c >= MUST_GO else LEFT_TRUNCATED if c & TRUNCATED else 0
            self.price += [price] * 4
        self.price.reverse()
        self.price.append(0)
        if not last:
            self.price[4 * n : 4 * n + 4] = [FAR if e is None else e for e in end]
        self.settled = bytearray(self.end + 1)
        self.settled[self.end] = 1

    def settle(self, origin: int) -> int:
        """Extends and contracts a path from ``origin`` until its price is the true cost."""
        price, settled, arcs = self.price, self.settled, self.arcs
        path = [origin]
        while not settled[path[-1]]:
            v = path[-1]
            best, to = FAR, -1
            for _, step, cost in arcs[v]:
                total = cost + price[v + step]
                if total < best:
                    best, to = total, v + step
            if price[v] < best:
                price[v] = best
                if len(path) > 1:
                    path.pop()
            else:
                path.append(to)
        for v in path:
            settled[v] = 1
        return price[origin]

    def trace(self, state: int) -> tuple[str, int]:
        """The least letters of a shortest path from a state at the start, and the state it ends in."""
        self.settle(state)
        price, v, out = self.price, state, []
        while True:
            for letter, step, cost in self.arcs[v]:
                to = v + step
                if price[v] == cost + price[to] == cost + self.settle(to):
                    break
            if to == self.end:
                return "".join(out), v & 3
            out.append(letter)
            v = to


def repair_codes(codes: bytes) -> tuple[str, int]:
    """Letters and cost of a whole conversation."""
    a = Auction(codes, ACCEPTED, True)
    letters, _ = a.trace(START)
    return letters, a.price[START]


FAR = 1 << 50


def segment_costs(codes: bytes) -> list[int]:
    """Costs from each state at the start to each at the end, and to the end of a conversation that ends here.

    Only deletions lead back to the start, and only they and one kept system row to that
    row's state; the auction finds the ways to the other two, which can always be reached.
    """
    gone = DELETE * len(codes)
    kept = [gone - DELETE + (LEFT_TRUNCATED if c & TRUNCATED else 0) for c in codes if c < MUST_GO and c & 3 == 0]
    costs = {(START, START): gone, (SYSTEM, SYSTEM): gone, (START, SYSTEM): min(kept, default=FAR)}
    for e in (USER, ASSISTANT):
        a = Auction(codes, tuple(0 if s == e else None for s in range(4)), False)
        costs |= {(s, e): a.settle(s) for s in range(4)}
    last = Auction(codes, ACCEPTED, True)
    return [costs.get((s, e), FAR) for s in range(4) for e in range(4)] + [last.settle(s) for s in range(4)]


def illegal_pairs(codes: bytes) -> int:
    """Adjacent rows whose initials may not follow each other."""
    c = np.frombuffer(codes, np.uint8) & 3
    pair = c[:-1] * 4 + c[1:]
    return int(len(pair) - np.isin(pair, (0 * 4 + 1, 1 * 4 + 2, 2 * 4 + 1)).sum())


# ---------------------------------------------------------------- Spark side

_ORDER = ["conv", "turn", "role", "tie", "digest"]
_AT = "conv string, turn long, role string, tie string, digest binary"


def turns_of(conversations: DataFrame) -> DataFrame:
    """``conv, turn, role, text`` with nulls as one space (a null turn stays null)."""
    rows = no_clash(conversations, ["conv_id", "turn", "role", "text"])
    space = F.lit(" ")
    return rows.select(F.coalesce(F.col("conv_id").cast("string"), space).alias("conv"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"))


def damage(turns: DataFrame) -> DataFrame:
    """Some rows gone, emptied, without their stops, doubled or of the wrong role, by a hash of their place."""
    place = F.concat("conv", F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind = F.crc32(place.cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    left = turns.withColumn("kind", kind).filter("kind <> 0").select("conv", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("kind") == 3, 2).otherwise(1).alias("times"))
    return left.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times")))).drop("times", "copy")


def _placed(turns: DataFrame) -> DataFrame:
    return turns.withColumns({"tie": F.substring("text", 1, 64), "digest": F.unhex(F.sha2("text", 256))})


def faults(turns: DataFrame) -> DataFrame:
    """One narrow row for each different row: its place, copies, initial and first fault."""
    bare = F.rtrim(F.col("text"), F.lit(BLANKS))
    rows = _placed(turns).select(*_ORDER, (bare == "").alias("blank"), (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("cut"))
    rows = rows.groupBy(*_ORDER, "blank", "cut").agg(F.count("*").alias("n"))
    when = F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).alias("at"))
    first = rows.groupBy("conv", "role", "digest").agg(F.min(when).alias("first"))
    rows = rows.join(first, ["conv", "role", "digest"]).withColumn("fresh", ~F.col("blank") & (F.col("first") == when))
    initial = F.instr(F.lit(INITIALS), F.when(F.col("role") == "", " ").otherwise(F.substring("role", 1, 1)))
    return rows.select(*_ORDER, "n", "blank", "cut", "fresh", F.when(initial == 0, 3).otherwise(initial - 1).cast("int").alias("initial"))


def fault_counts(rows: DataFrame) -> DataFrame:
    """conv, gaps, blank, duplicate, truncated of :func:`faults`."""
    fresh = F.col("fresh").cast("long")
    by_turn = rows.groupBy("conv", "turn").agg(
        F.sum(F.when(F.col("blank"), F.col("n")).otherwise(0)).alias("blank"),
        F.sum(F.when(F.col("blank"), 0).otherwise(F.col("n") - fresh)).alias("duplicate"),
        F.sum(F.when(F.col("cut"), fresh).otherwise(0)).alias("truncated"),
    )
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps")
    return by_turn.groupBy("conv").agg(gaps, *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")])


def segments(rows: DataFrame, size: int = SEGMENT) -> DataFrame:
    """Codes of consecutive rows, at most ``size``: the first row's place, part, number, codes."""
    columns = [*_ORDER, "n", "blank", "cut", "fresh", "initial"]
    ordered = rows.select(*columns).repartitionByRange(shuffle_partitions(rows.sparkSession), *_ORDER).sortWithinPartitions(*_ORDER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        place, codes = None, bytearray()
        done: list[tuple] = []

        def batch_of() -> pa.RecordBatch:
            parts = list(zip(*done, strict=True))
            done.clear()
            kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.int32(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(parts, kinds, strict=True)], [*_ORDER, "part", "number", "codes"])

        for batch in batches:
            for *at, n, blank, cut, fresh, initial in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                left = n
                while left:
                    if place is None or place[0] != at[0] or len(codes) >= size:
                        if place is not None:
                            done.append((*place, part, number, bytes(codes)))
                            number += 1
                        place, codes = at, bytearray()
                    if fresh and left == n:
                        codes.append(initial + (TRUNCATED if cut else 0))
                        left -= 1
                    else:
                        k = min(left, size - len(codes))
                        codes += bytes((initial + MUST_GO,)) * k
                        left -= k
            if len(done) > 2000:
                yield batch_of()
        if place is not None:
            done.append((*place, part, number, bytes(codes)))
        if done:
            yield batch_of()

    return ordered.mapInArrow(run, f"{_AT}, part int, number long, codes binary")


_AUDITS: dict[bytes, tuple[str, int]] = {}


def _audit(codes: bytes) -> tuple[str, int]:
    """:func:`repair_codes` of short conversations, which repeat, are kept in the process."""
    if len(codes) > 24:
        return repair_codes(codes)
    found = _AUDITS.get(codes)
    if found is None:
        if len(_AUDITS) > KEPT_AUDITS:
            _AUDITS.clear()
        found = _AUDITS[codes] = repair_codes(codes)
    return found


def audits(segs: DataFrame) -> DataFrame:
    """Letters of every segment: place, part, number, audit, cost, illegal."""
    at = [*_ORDER, "part", "number"]
    found = f"{_AT}, part int, number long, audit string, cost long, illegal long"
    counted = segs.groupBy("conv").agg(F.count("*").alias("m"))
    joined = segs.join(counted, "conv").select(*at, "codes", "m")

    def whole(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        codes = batch.column(7).to_pylist()
        out = [_audit(c) for c in codes]
        columns = [pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.int64()), pa.array([illegal_pairs(c) for c in codes], pa.int64())]
        yield pa.RecordBatch.from_arrays([*batch.columns[:7], *columns], [*at, "audit", "cost", "illegal"])

    one = arrow_map(joined.filter("m = 1").drop("m"), whole, found)

    def costs(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        codes = batch.column(3).to_pylist()
        columns = [pa.array([segment_costs(c) for c in codes], pa.list_(pa.int64())), pa.array([c[0] & 3 for c in codes], pa.int32()), pa.array([c[-1] & 3 for c in codes], pa.int32()), pa.array([illegal_pairs(c) for c in codes], pa.int64())]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], *columns], ["conv", "part", "number", "costs", "head", "tail", "inner"])

    def behind(t: pa.Table) -> pa.Table:
        """Prices behind each segment, by going back over the costs of those that follow."""
        t = t.sort_by([("part", "ascending"), ("number", "ascending")])
        m = t.num_rows
        table = np.array(t.column("costs").to_pylist(), np.int64)
        head, tail = t.column("head").to_numpy(), t.column("tail").to_numpy()
        illegal = t.column("inner").to_numpy() + np.append(0, [illegal_pairs(bytes((a, b))) for a, b in zip(tail[:-1].tolist(), head[1:].tolist(), strict=True)]).astype(np.int64)
        prices: list[list[int | None]] = [list(ACCEPTED)] * m
        ahead = table[m - 1, 16:]
        for j in range(m - 2, -1, -1):
            prices[j] = ahead.tolist()
            ahead = (table[j, :16].reshape(4, 4) + ahead).min(1)
        return pa.table({"conv": t.column("conv"), "part": t.column("part"), "number": t.column("number"), "behind": pa.array(prices, pa.list_(pa.int64())), "last": pa.array([j == m - 1 for j in range(m)]), "illegal": illegal})

    def traces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ways = []
        for codes, end, last in zip(batch.column(7).to_pylist(), batch.column(8).to_pylist(), batch.column(9).to_pylist(), strict=True):
            a = Auction(codes, tuple(end), last)
            own = []
            for s in range(4):
                letters, to = a.trace(s)
                own.append({"audit": letters, "to": to, "cost": a.price[s] - (end[to] or 0)})
            ways.append(own)
        kind = pa.list_(pa.struct([("audit", pa.string()), ("to", pa.int32()), ("cost", pa.int64())]))
        yield pa.RecordBatch.from_arrays([*batch.columns[:7], batch.column(10), pa.array(ways, kind)], [*at, "illegal", "ways"])

    def entered(t: pa.Table) -> pa.Table:
        """The state in which each segment is entered."""
        t = t.sort_by([("part", "ascending"), ("number", "ascending")])
        state, states = START, []
        for to in t.column("to").to_pylist():
            states.append(state)
            state = to[state]
        return pa.table({"conv": t.column("conv"), "part": t.column("part"), "number": t.column("number"), "state": pa.array(states, pa.int32())})

    several = joined.filter("m > 1").drop("m")
    key = ["conv", "part", "number"]
    reduced = arrow_map(several.select(*key, "codes"), costs, "conv string, part int, number long, costs array<long>, head int, tail int, inner long")
    prices = reduced.groupBy("conv").applyInArrow(behind, "conv string, part int, number long, behind array<long>, last boolean, illegal long")
    ready = several.join(prices, key).select(*at, "codes", "behind", "last", "illegal")
    traced = arrow_map(ready, traces, f"{_AT}, part int, number long, illegal long, ways array<struct<audit:string,to:int,cost:long>>")
    states = traced.select(*key, F.col("ways.to").alias("to")).groupBy("conv").applyInArrow(entered, "conv string, part int, number long, state int")
    way = F.element_at("ways", F.col("state") + 1)
    chosen = traced.join(states, key).select(*at, way["audit"].alias("audit"), way["cost"].alias("cost"), "illegal")
    return one.unionByName(chosen)


def repaired_turns(turns: DataFrame, letters: DataFrame) -> DataFrame:
    """conv, place (from 0), role and text of the repaired conversations, in order within a partition.

    The letters of a segment sort just before its first row, so texts pass as one stream.
    """
    empty = [F.lit(None).cast("string").alias("text")]
    rows = _placed(turns).select(*_ORDER, F.lit(1).alias("flag"), "text", F.lit(None).cast("string").alias("audit"))
    marks = letters.select(*_ORDER, F.lit(0).alias("flag"), *empty, "audit", "part", "number")
    both = rows.withColumns({"part": F.lit(0), "number": F.lit(0).cast("long")}).unionByName(marks)
    order = [*_ORDER, "flag", "part", "number"]
    stream = both.repartition(shuffle_partitions(turns.sparkSession), "conv").sortWithinPartitions(*order).select("conv", "role", "text", "audit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, place = None, START, 0
        queue: deque[str] = deque()
        out: list[tuple[str, int, str, str]] = []

        def inserted() -> None:
            nonlocal state, place
            while queue and queue[0] == "I":
                queue.popleft()
                state = _OWED[state]
                out.append((conv, place, "user" if state == USER else "assistant", ""))
                place += 1

        for batch in batches:
            for key, role, text, audit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != conv:
                    inserted()
                    conv, state, place = key, START, 0
                    queue.clear()
                if audit is not None:
                    queue.extend(audit)
                    continue
                inserted()
                letter = queue.popleft()
                if letter == "D":
                    continue
                if letter == "R":
                    state = _OWED[state]
                    role = "user" if state == USER else "assistant"
                else:
                    state = _KEPT[state, INITIALS.index(role[:1])]
                out.append((conv, place, role, text))
                place += 1
            if out:
                yield _rows(out)
        inserted()
        if out:
            yield _rows(out)

    return stream.mapInArrow(run, "conv string, place long, role string, text string")


def _rows(out: list[tuple[str, int, str, str]]) -> pa.RecordBatch:
    columns = list(zip(*out, strict=True))
    out.clear()
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.string()), strict=True)], ["conv", "place", "role", "text"])


def text_digests(repaired: DataFrame) -> DataFrame:
    """conv and the sha256 of its ``role:text`` lines, of rows ordered as :func:`repaired_turns` gives them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, hasher = None, None
        for batch in batches:
            done = []
            for key, _, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if hasher is None or key != conv:
                    if hasher is not None:
                        done.append((conv, hasher.hexdigest()))
                    conv, hasher = key, hashlib.sha256()
                else:
                    hasher.update(b"\n")
                hasher.update(f"{role}:{text}".encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], ["conv", "sha"])
        if hasher is not None:
            yield pa.RecordBatch.from_arrays([pa.array([conv]), pa.array([hasher.hexdigest()])], ["conv", "sha"])

    return repaired.mapInArrow(run, "conv string, sha string")


def repair(turns: DataFrame, size: int = SEGMENT) -> tuple[DataFrame, DataFrame]:
    """Per conversation: conv, gaps, blank, duplicate, truncated, illegal, cost, audit; and the repaired rows."""
    rows = materialize(faults(turns))
    letters = materialize(audits(materialize(segments(rows, size))))
    parts = F.array_sort(F.collect_list(F.struct("part", "number", "audit")))
    summed = letters.groupBy("conv").agg(F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"), F.array_join(F.transform(parts, lambda x: x["audit"]), "").alias("audit"))
    return fault_counts(rows).join(summed, "conv"), repaired_turns(turns, letters)


def op12_auction_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = read_table(spark, sf_dir, "conversations")
    turns = turns_of(conversations)
    counts, repaired = repair(damage(turns))
    found = turns.select("conv").distinct().join(counts, "conv", "left").join(text_digests(repaired), "conv", "left")
    nothing = hashlib.sha256(b"").hexdigest()
    return found.select(
        F.when(F.col("conv") != " ", F.col("conv")).cast(conversations.schema["conv_id"].dataType).alias("conv_id"),
        *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("sha", F.lit(nothing)).alias("repaired_sha256"),
    )


SQL = r"""
WITH RECURSIVE base AS (
  SELECT coalesce(conv_id::VARCHAR, ' ') AS conv, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text FROM conversations),
places AS (SELECT *, encode(conv || ':' || coalesce(turn::VARCHAR, ' ')) AS place FROM base),
hashed AS (SELECT *, (xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, 8 * octet_length(place) + 1), lambda b: ((('0x' || substr(hex(place), 2 * ((b - 1) // 8) + 1, 2))::BIGINT >> ((b - 1) % 8)) & 1)::BIGINT)),
    lambda c, bit: xor(c >> 1, CASE WHEN (xor(c & 1, bit)) = 1 THEN 3988292384 ELSE 0 END)), 4294967295::BIGINT)) % 20 AS kind FROM places),
damaged AS (SELECT conv, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM hashed WHERE kind <> 0),
lined AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, substr(text, 1, 64), sha256(text)) AS i, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM damaged),
faulty AS (SELECT conv, turn, role, text, i, left(role, 1) AS c, bare = '' AS blank, right(bare, 1) NOT IN ('.', '!', '?') AS cut, row_number() OVER (PARTITION BY conv, role, text ORDER BY i) > 1 AS again,
    left(lag(role) OVER (PARTITION BY conv ORDER BY i), 1) || left(role, 1) AS pair FROM lined),
rows_ AS (SELECT *, blank OR again AS gone, CASE WHEN cut THEN 3 ELSE 0 END AS extra FROM faulty),
counts AS (SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate, count(*) FILTER (cut AND NOT gone) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM rows_ GROUP BY conv),
-- state: 0 nothing, 1 system, 2 user, 3 assistant; two insertions in a row lead back, so one before each row and two at the end are enough
walk AS (
  SELECT conv, 0 AS i, 0 AS s, 0 AS cost, '' AS audit, '' AS said FROM counts
  UNION ALL
  SELECT conv, i, s, cost, audit, said FROM (
    SELECT w.conv, r.i, t.s, w.cost + ins.cost + t.cost AS cost, w.audit || ins.letter || t.letter AS audit, w.said || ins.said || t.said AS said,
      row_number() OVER (PARTITION BY w.conv, t.s ORDER BY w.cost + ins.cost + t.cost, w.audit || ins.letter || t.letter) AS best
    FROM walk w JOIN rows_ r ON r.conv = w.conv AND r.i = w.i + 1,
    LATERAL (SELECT w.s AS s, 0 AS cost, '' AS letter, '' AS said UNION ALL SELECT CASE WHEN w.s = 2 THEN 3 ELSE 2 END, 3, 'I', CASE WHEN w.s = 2 THEN chr(10) || 'assistant:' ELSE chr(10) || 'user:' END
      UNION ALL SELECT CASE WHEN w.s = 2 THEN 2 ELSE 3 END, 6, 'II', CASE WHEN w.s = 2 THEN chr(10) || 'assistant:' || chr(10) || 'user:' ELSE chr(10) || 'user:' || chr(10) || 'assistant:' END) ins,
    LATERAL (SELECT ins.s AS s, 4 AS cost, 'D' AS letter, '' AS said
      UNION ALL SELECT CASE WHEN r.c = 's' THEN 1 WHEN r.c = 'u' THEN 2 ELSE 3 END, r.extra, 'K', chr(10) || r.role || ':' || r.text WHERE NOT r.gone AND (ins.s = 0 AND r.c IN ('s', 'u') OR ins.s IN (1, 3) AND r.c = 'u' OR ins.s = 2 AND r.c = 'a')
      UNION ALL SELECT CASE WHEN ins.s = 2 THEN 3 ELSE 2 END, 3 + r.extra, 'R', chr(10) || CASE WHEN ins.s = 2 THEN 'assistant:' ELSE 'user:' END || r.text WHERE NOT r.gone) t) WHERE best = 1),
ends AS (SELECT w.conv, w.cost + e.cost AS cost, w.audit || e.letter AS audit, w.said || e.said AS said FROM walk w JOIN counts c ON c.conv = w.conv AND c.n = w.i,
  LATERAL (SELECT 0 AS cost, '' AS letter, '' AS said WHERE w.s IN (0, 3) UNION ALL SELECT 3, 'I', chr(10) || 'assistant:' WHERE w.s = 2 UNION ALL SELECT 6, 'II', chr(10) || 'user:' || chr(10) || 'assistant:' WHERE w.s = 1) e),
chosen AS (SELECT * FROM ends QUALIFY row_number() OVER (PARTITION BY conv ORDER BY cost, audit) = 1)
SELECT CASE WHEN b.conv <> ' ' THEN b.conv::BIGINT END AS conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(substr(said, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv FROM base) b LEFT JOIN counts USING (conv) LEFT JOIN chosen USING (conv)
"""

__all__ = ["Auction", "audits", "damage", "fault_counts", "faults", "op12_auction_repair", "repair", "repair_codes", "repaired_turns", "segment_costs", "segments", "text_digests", "turns_of"]
