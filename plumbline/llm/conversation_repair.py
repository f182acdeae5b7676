"""Repair of conversation structure by bidirectional Dijkstra over the edit lattice.

A node of the lattice is (rows read, what the repaired roles end in); its edges keep, re-role, delete
or insert a row. Two searches, from the start and from the accepted ends, meet; all crossings of the
least cost are finished, and the least audit that two halves give is taken.

Rows are range-partitioned by conversation and turn, so that a conversation of any length spreads over
as many partitions as it needs. One that lies inside a partition is repaired there. Those that touch
its edges are cut into segments of bounded size: the search gives each segment the cheapest audit from
every state to every other, and these tables are put together in a tree. Only the digest of the
repaired text, which is one chain by its nature, runs through the segments one after another.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import Rows, small_batches, staged
from plumbline.operators.joins import lookup

KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 3, 4, 3, 3
SPACE = " \t\n\x0b\x0c\r"
ENDS = ".!?"
#: States: nothing yet, after a system row, after a user row, after an assistant row. Each has one role
#: that may follow; a system row may only be the first and is never made.
FOLLOWS = ((1, 2), (1, 2), (2, 3), (1, 2))
ROLES = {1: "user", 2: "assistant"}
SYSTEM, OTHER = 0, 3
INITIALS = {"s": SYSTEM, "u": 1, "a": 2}
LEGAL = {(0, 1), (1, 2), (2, 1)}
STATES = range(4)
ENTRY, ACCEPTED = 0, (0, 3)
#: A row as one byte: class of its initial, plus these.
TRUNCATED, GOES = 4, 8
#: Bounds of a segment, and of the open conversation that a task holds before it lets go of it.
SEGMENT_ROWS = 64
SEGMENT_CHARS = 1 << 20
HELD_ROWS = 10_000
#: Bits of the position that a round of the tree takes off: so many tables are put together at once.
FAN_BITS = 6
HEAD = 32
TOP = (1 << 63) - 1

Label = tuple[int, str]


def kept_state(state: int, initial: int) -> int | None:
    """State after a kept row of that initial, or None where it may not stand."""
    if initial == SYSTEM:
        return 1 if state == 0 else None
    follows, after = FOLLOWS[state]
    return after if initial == follows else None


def forward_edges(rows: bytes, i: int, state: int) -> Iterator[tuple[int, int, int, str]]:
    """(next i, next state, cost, letter)."""
    after = FOLLOWS[state][1]
    yield i, after, INSERT, "I"
    if i < len(rows):
        row = rows[i]
        yield i + 1, state, DELETE, "D"
        if not row & GOES:
            more = CUT_OFF if row & TRUNCATED else 0
            yield i + 1, after, REROLE + more, "R"
            kept = kept_state(state, row & 3)
            if kept is not None:
                yield i + 1, kept, KEEP + more, "K"


@functools.cache
def before(state: int) -> tuple[int, ...]:
    return tuple(q for q in STATES if FOLLOWS[q][1] == state)


def backward_edges(rows: bytes, i: int, state: int) -> Iterator[tuple[int, int, int, str]]:
    """(previous i, previous state, cost, letter)."""
    for q in before(state):
        yield i, q, INSERT, "I"
    if i:
        row = rows[i - 1]
        yield i - 1, state, DELETE, "D"
        if not row & GOES:
            more = CUT_OFF if row & TRUNCATED else 0
            for q in before(state):
                yield i - 1, q, REROLE + more, "R"
            for q in STATES:
                if kept_state(q, row & 3) == state:
                    yield i - 1, q, KEEP + more, "K"


class Search:
    """One of the two searches. Nodes leave the heap by cost and then along the free edges, so that a
    node's audit is the least of its cost when it leaves."""

    def __init__(self, rows: bytes, starts: list[tuple[int, int]], ahead: bool):
        self.rows, self.ahead = rows, ahead
        self.labels: dict[tuple[int, int], Label] = dict.fromkeys(starts, (0, ""))
        self.heap = [(0, i if ahead else -i, i, q) for i, q in starts]
        heapq.heapify(self.heap)
        self.done: set[tuple[int, int]] = set()

    @property
    def top(self) -> float:
        while self.heap and self.heap[0][2:] in self.done:
            heapq.heappop(self.heap)
        return self.heap[0][0] if self.heap else float("inf")

    def advance(self, other: Search) -> float:
        """Take the next node out; the least cost of a path over one of its edges to a node the other search has met."""
        cost, _, i, q = heapq.heappop(self.heap)
        self.done.add((i, q))
        audit = self.labels[i, q][1]
        met = other.labels.get((i, q))
        least = float("inf") if met is None else cost + met[0]
        for j, p, more, letter in (forward_edges if self.ahead else backward_edges)(self.rows, i, q):
            node = (j, p)
            if node in self.done:
                continue
            label = (cost + more, audit + letter if self.ahead else letter + audit)
            known = self.labels.get(node)
            if known is None or label < known:
                self.labels[node] = label
                if known is None or label[0] < known[0]:
                    heapq.heappush(self.heap, (label[0], j if self.ahead else -j, j, p))
            met = other.labels.get(node)
            if met is not None:
                least = min(least, label[0] + met[0])
        return least


def cheapest(rows: bytes, entry: int, ends: tuple[int, ...]) -> Label | None:
    """Least cost from state ``entry`` before the rows to one of ``ends`` after them, and the least audit of that cost."""
    n = len(rows)
    ahead = Search(rows, [(0, entry)], True)
    back = Search(rows, [(n, p) for p in ends], False)
    least = float("inf")
    # Beyond this sum no node is left out that a path of least cost could cross.
    while ahead.top + back.top <= least and ahead.heap and back.heap:
        side, other = (ahead, back) if ahead.top <= back.top else (back, ahead)
        least = min(least, side.advance(other))
    if least == float("inf"):
        return None
    best: str | None = None
    for i, q in ahead.done:
        cost, audit = ahead.labels[i, q]
        if i == n and q in ends and cost == least and (best is None or audit < best):
            best = audit
        for j, p, more, letter in forward_edges(rows, i, q):
            if (j, p) in back.done and (j, p) not in ahead.done:
                rest = back.labels[j, p]
                if cost + more + rest[0] == least:
                    whole = audit + letter + rest[1]
                    if best is None or whole < best:
                        best = whole
    return int(least), best


@functools.lru_cache(maxsize=50_000)
def repaired(rows: bytes) -> Label:
    return cheapest(rows, ENTRY, ACCEPTED)


Table = list[Label | None]


@functools.lru_cache(maxsize=5_000)
def table_of(rows: bytes) -> Table:
    """Cheapest audit from each state to each other over a segment, 4 x 4."""
    return [cheapest(rows, q, (p,)) for q in STATES for p in STATES]


def joined(left: Table, right: Table) -> Table:
    """Audits of equal cost between the same states never begin with one another, so halves can be chosen apart."""
    out: Table = []
    for q in STATES:
        for p in STATES:
            found = [(left[4 * q + m], right[4 * m + p]) for m in STATES]
            sums = [a[0] + b[0] for a, b in found if a is not None and b is not None]
            if not sums:
                out.append(None)
                continue
            least = min(sums)
            out.append((least, min(a[1] + b[1] for a, b in found if a is not None and b is not None and a[0] + b[0] == least)))
    return out


def all_joined(tables: list[Table]) -> Table:
    while len(tables) > 1:
        tables = [joined(*tables[i : i + 2]) if i + 1 < len(tables) else tables[i] for i in range(0, len(tables), 2)]
    return tables[0]


def accepted(table: Table) -> Label:
    return min(table[4 * ENTRY + p] for p in ACCEPTED if table[4 * ENTRY + p] is not None)


def lines(audit: str, state: int, rows: Iterator[tuple[str, str]]) -> Iterator[str]:
    """Repaired lines of an audit from ``state`` on; ``rows`` are (role, text)."""
    for letter in audit:
        follows, after = FOLLOWS[state]
        if letter == "I":
            yield f"{ROLES[follows]}:"
            state = after
            continue
        role, text = next(rows)
        if letter == "R":
            yield f"{ROLES[follows]}:{text}"
            state = after
        elif letter == "K":
            yield f"{role}:{text}"
            state = kept_state(state, initial_of(role))


def initial_of(role: str) -> int:
    return INITIALS.get(role[:1], OTHER)


def first_fault(text: str) -> tuple[bool, bool]:
    """(blank, cut off)."""
    body = text.rstrip(SPACE)
    return not body, bool(body) and body[-1] not in ENDS


class Facts:
    """What is counted over rows in their order; those of neighbouring segments can be put together."""

    FIELDS = "rows blank duplicate truncated illegal first last low high turns".split()

    def __init__(self, **values):
        self.rows = self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.last = self.low = self.high = None
        self.__dict__.update(values)

    def row(self, turn: int | None, initial: int, blank: bool, duplicate: bool, cut_off: bool) -> int:
        """Count a row; gives its byte."""
        duplicate = duplicate and not blank
        cut_off = cut_off and not (blank or duplicate)
        own = Facts(rows=1, blank=int(blank), duplicate=int(duplicate), truncated=int(cut_off), first=initial, last=initial)
        if turn is not None:
            own.low, own.high, own.turns = turn, turn, 1
        self.add(own)
        return initial | (TRUNCATED if cut_off else 0) | (GOES if blank or duplicate else 0)

    def add(self, later: Facts) -> None:
        if not later.rows:
            return
        if self.rows:
            self.illegal += (self.last, later.first) not in LEGAL
        else:
            self.first = later.first
        self.last = later.last
        for name in ("rows", "blank", "duplicate", "truncated", "illegal", "turns"):
            setattr(self, name, getattr(self, name) + getattr(later, name))
        if later.low is not None:
            self.turns -= self.high == later.low
            self.low = later.low if self.low is None else self.low
            self.high = later.high

    @property
    def gaps(self) -> int:
        return 0 if self.low is None else min(self.high - self.low + 1 - self.turns, TOP)

    def values(self) -> list:
        return [getattr(self, name) for name in self.FIELDS]


RESULT = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"
RESULT_FIELDS = [
    ("conv_id", pa.int64()),
    *((c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
    ("audit", pa.string()),
]
COUNTED = ("gaps", "blank", "duplicate", "truncated", "illegal")
PIECES = pa.schema(
    [
        *RESULT_FIELDS,
        ("repaired_sha256", pa.string()),
        ("position", pa.int64()),
        ("row", pa.int32()),
        ("turn", pa.int64()),
        ("role", pa.string()),
        ("text", pa.string()),
        ("digest", pa.binary()),
    ]
)
PIECES_SQL = RESULT + ", repaired_sha256 string, position bigint, row int, turn bigint, role string, text string, digest binary"


def closed(conv_id: int | None, rows: list[tuple]) -> tuple:
    """Result of a conversation whose rows (turn, role, text, digest, present) are all here."""
    facts, seen, codes = Facts(), set(), bytearray()
    there = [r for r in rows if r[4]]
    for turn, role, text, _, _ in there:
        blank, cut_off = first_fault(text)
        codes.append(facts.row(turn, initial_of(role), blank, (role, text) in seen, cut_off))
        seen.add((role, text))
    if len(codes) <= SEGMENT_ROWS:
        cost, audit = repaired(bytes(codes))
    else:
        cost, audit = accepted(all_joined([table_of(bytes(codes[i : i + SEGMENT_ROWS])) for i in range(0, len(codes), SEGMENT_ROWS)]))
    body = "\n".join(lines(audit, ENTRY, ((r[1], r[2]) for r in there)))
    return (conv_id, *(getattr(facts, c) for c in COUNTED), cost, audit, hashlib.sha256(body.encode()).hexdigest())


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of the conversations inside a sorted partition; of its first and last one, and of very long ones, the
    rows with their segment (``position``) and place in it."""
    out = Rows(PIECES)
    context = TaskContext.get()
    part = (context.partitionId() if context else 0) << 32
    current: object = pieces
    held: list[tuple] = []
    opened = True
    segment, filled, chars = -1, 0, 0
    conversations = 0

    def let_go(rows: list[tuple]) -> None:
        nonlocal segment, filled, chars
        for turn, role, text, digest, present in rows:
            if filled >= SEGMENT_ROWS or chars >= SEGMENT_CHARS:
                segment, filled, chars = segment + 1, 0, 0
            if not present:
                role = text = digest = None
            out.add(current, *[None] * 8, part | segment, filled, turn, role, text, digest, size=200 + len(text or ""))
            filled += 1
            chars += len(text or "")

    def begin_segment() -> None:
        nonlocal segment, filled, chars
        segment, filled, chars = segment + 1, 0, 0

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "digest", "present")]
        for conv_id, *row in zip(*columns, strict=True):
            if current is pieces or conv_id != current:
                if held:
                    out.add(*closed(current, held), *[None] * 6, size=200 + len(held))
                current, held = conv_id, []
                conversations += 1
                opened = conversations == 1
                if opened:
                    begin_segment()
            if not opened and len(held) >= HELD_ROWS:
                opened = True
                begin_segment()
                let_go(held)
                held = []
            if opened:
                let_go([row])
            else:
                held.append(row)
            if out.full():
                yield from out.take()
    if held:
        begin_segment()
        let_go(held)
    yield from out.take()


SEGMENTS = pa.schema(
    [
        ("conv_id", pa.int64()),
        ("position", pa.int64()),
        *((c, pa.int64()) for c in Facts.FIELDS),
        ("codes", pa.binary()),
        ("costs", pa.list_(pa.int64())),
        ("audits", pa.list_(pa.string())),
    ]
)
SEGMENTS_SQL = "conv_id bigint, position bigint, " + ", ".join(f"{c} bigint" for c in Facts.FIELDS) + ", codes binary, costs array<bigint>, audits array<string>"


def add_table(out: Rows, conv_id: int | None, position: int, facts: Facts, table: Table, codes: bytes | None = None) -> None:
    costs = [None if t is None else t[0] for t in table]
    audits = [None if t is None else t[1] for t in table]
    out.add(conv_id, position, *facts.values(), codes, costs, audits, size=400 + sum(len(a or "") for a in audits))


def segment_tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (position, row) to one table for each segment."""
    out = Rows(SEGMENTS)
    at: int | None = None
    conv: int | None = None
    facts, codes = Facts(), bytearray()
    names = ("conv_id", "position", "turn", "initial", "blank", "again", "cut_off", "present")
    for batch in batches:
        for conv_id, position, turn, initial, blank, again, cut_off, present in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
            if position != at:
                if at is not None:
                    add_table(out, conv, at, facts, table_of(bytes(codes)), bytes(codes))
                at, conv, facts, codes = position, conv_id, Facts(), bytearray()
            if present:
                codes.append(facts.row(turn, initial, blank, again, cut_off))
            if out.full():
                yield from out.take()
    if at is not None:
        add_table(out, conv, at, facts, table_of(bytes(codes)), bytes(codes))
    yield from out.take()


def grouped_tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tables sorted by (conversation, group, position) to one for each group of neighbours."""
    out = Rows(SEGMENTS)
    at: tuple | None = None
    facts, tables = Facts(), []
    for batch in batches:
        for row in batch.to_pylist():
            key = (row["conv_id"], row["grp"])
            if key != at:
                if at is not None:
                    add_table(out, *at, facts, all_joined(tables))
                at, facts, tables = key, Facts(), []
            facts.add(Facts(**{c: row[c] for c in Facts.FIELDS}))
            tables.append([None if c is None else (c, a) for c, a in zip(row["costs"], row["audits"], strict=True)])
            if out.full():
                yield from out.take()
    if at is not None:
        add_table(out, *at, facts, all_joined(tables))
    yield from out.take()


RESULTS = pa.schema(RESULT_FIELDS)


def results(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last table of each conversation to its result."""
    out = Rows(RESULTS)
    for batch in batches:
        for row in batch.to_pylist():
            facts = Facts(**{c: row[c] for c in Facts.FIELDS})
            cost, audit = accepted([None if c is None else (c, a) for c, a in zip(row["costs"], row["audits"], strict=True)])
            out.add(row["conv_id"], *(getattr(facts, c) for c in COUNTED), cost, audit, size=200 + len(audit))
            if out.full():
                yield from out.take()
    yield from out.take()


SLICES = pa.schema([("position", pa.int64()), ("row", pa.int32()), ("conv_id", pa.int64()), ("state", pa.int32()), ("role", pa.string()), ("text", pa.string())])
SLICES_SQL = "position bigint, row int, conv_id bigint, state int, role string, text string"


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per conversation its audit (position -1) and then its segments with the codes of their rows: the part of the audit
    and the state at which each segment begins. Inserts between two segments go to the later one, at the end to the last."""
    out = Rows(SLICES)
    audit, at, state, waiting = "", 0, ENTRY, None

    def moved(part: str, state: int, codes: bytes) -> int:
        rows = iter(codes)
        for letter in part:
            code = None if letter == "I" else next(rows)
            if letter != "D":
                state = kept_state(state, code & 3) if letter == "K" else FOLLOWS[state][1]
        return state

    def flush(last: bool) -> None:
        nonlocal at, state, waiting
        if waiting is None:
            return
        position, conv_id, codes = waiting
        end, left = at, len(codes)
        while left:
            left -= audit[end] != "I"
            end += 1
        if last:
            end = len(audit)
        out.add(position, -1, conv_id, state, None, audit[at:end], size=200 + end - at)
        state = moved(audit[at:end], state, codes)
        at, waiting = end, None

    for batch in batches:
        for conv_id, position, own, codes in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "position", "audit", "codes")), strict=True):
            if position < 0:
                flush(True)
                audit, at, state = own, 0, ENTRY
            else:
                flush(False)
                waiting = (position, conv_id, codes)
            if out.full():
                yield from out.take()
    flush(True)
    yield from out.take()


BODIES = pa.schema([("conv_id", pa.int64()), ("position", pa.int64()), ("body", pa.binary())])


def rendered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per segment its slice (row -1) and then its rows: the repaired lines, each after a line feed."""
    out = Rows(BODIES)
    slot: tuple | None = None
    rows: list[tuple[str, str]] = []

    def flush() -> None:
        if slot is not None:
            position, conv_id, state, audit = slot
            body = "".join(f"\n{line}" for line in lines(audit, state, iter(rows))).encode()
            out.add(conv_id, position, body, size=64 + len(body))

    for batch in batches:
        for position, row, conv_id, state, role, text in zip(*(batch.column(c.name).to_pylist() for c in SLICES), strict=True):
            if row < 0:
                flush()
                slot, rows = (position, conv_id, state, text), []
            elif role is not None:
                rows.append((role, text))
            if out.full():
                yield from out.take()
    flush()
    yield from out.take()


HASHED = pa.schema([*RESULT_FIELDS, ("repaired_sha256", pa.string())])
HASHED_SQL = RESULT + ", repaired_sha256 string"


def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per conversation its result (position -1) and then its bodies, which are held one at a time."""
    out = Rows(HASHED)
    result: list | None = None
    digest = None
    begun = False
    names = [f.name for f in RESULTS]
    for batch in batches:
        for position, body, *own in zip(*(batch.column(c).to_pylist() for c in ("position", "body", *names)), strict=True):
            if position < 0:
                if result is not None:
                    out.add(*result, digest.hexdigest(), size=300 + len(result[-1]))
                result, digest, begun = own, hashlib.sha256(), False
            elif body:
                digest.update(body if begun else body[1:])
                begun = True
            if out.full():
                yield from out.take()
    if result is not None:
        out.add(*result, digest.hexdigest(), size=300 + len(result[-1]))
    yield from out.take()


def open_results(found: DataFrame) -> DataFrame:
    """Results of the conversations that lie in several partitions, from their rows."""
    body = F.rtrim("text", F.lit(SPACE))
    rows = found.select(
        "conv_id",
        "position",
        "row",
        "turn",
        "digest",
        F.coalesce(*(F.when(F.substring("role", 1, 1) == k, v) for k, v in INITIALS.items()), F.lit(OTHER)).alias("initial"),
        (body == "").alias("blank"),
        (~F.substring(body, -1, 1).isin(*ENDS)).alias("cut_off"),
        F.col("role").isNotNull().alias("present"),
    )
    place = F.struct("position", "row")
    firsts = (
        rows.filter("present").groupBy("digest").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    )
    marked = lookup(rows, firsts.select("digest", "first"), ["digest"]).withColumn("again", F.coalesce(place > F.col("first"), F.lit(False)))
    segments = marked.drop("first", "digest").repartition("position").sortWithinPartitions("position", "row")
    flags = {c: F.coalesce(c, F.lit(False)).alias(c) for c in ("blank", "cut_off")}
    segments = segments.select("conv_id", "position", "turn", "initial", *flags.values(), "again", "present")
    tables = staged(segments.mapInArrow(segment_tables, SEGMENTS_SQL), "segments")

    # Positions are partition and segment, without the bits that no segment uses; the levels of the tree are shifts of them.
    part, own = F.shiftright("position", 32), F.col("position").bitwiseAND((1 << 32) - 1)
    most = tables.agg(F.max(part).alias("part"), F.max(own).alias("own")).first()
    bits = int(most.own or 0).bit_length()
    level = tables.withColumn("position", F.shiftleft(part, bits).bitwiseOR(own)).withColumn("codes", F.lit(None).cast("binary"))
    total, shift = int(most.part or 0).bit_length() + bits, 0
    while shift < total:
        level = level.withColumn("grp", F.shiftright("position", FAN_BITS))
        level = level.repartition("conv_id", "grp").sortWithinPartitions("conv_id", "grp", "position")
        level = level.mapInArrow(grouped_tables, SEGMENTS_SQL)
        shift += FAN_BITS
    told = staged(level.mapInArrow(results, RESULT), "open-results")

    first = F.lit(-1).cast("bigint").alias("position")
    segments = tables.select("conv_id", "position", F.lit(None).cast("string").alias("audit"), "codes")
    audits = told.select("conv_id", first, "audit", F.lit(None).cast("binary").alias("codes"))
    by_conversation = segments.unionByName(audits).repartition("conv_id").sortWithinPartitions("conv_id", "position")
    cuts = by_conversation.mapInArrow(slices, SLICES_SQL)
    texts = found.select("position", "row", "conv_id", F.lit(None).cast("int").alias("state"), "role", "text")
    bodies = (
        cuts.unionByName(texts)
        .repartition("position")
        .sortWithinPartitions("position", "row")
        .mapInArrow(rendered, "conv_id bigint, position bigint, body binary")
    )
    names = [f.name for f in RESULTS]
    chained = told.select(*names, first, F.lit(None).cast("binary").alias("body")).unionByName(bodies, allowMissingColumns=True)
    return chained.repartition("conv_id").sortWithinPartitions("conv_id", "position").mapInArrow(hashed, HASHED_SQL)


def repair(conversations: DataFrame, present: Column | None = None) -> DataFrame:
    """Per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    A null role or text is one space. Rows go by turn, nulls first; of the same turn by role and text (their
    first 32 characters, then SHA-256), so repeated rows follow one another and all but the first are
    duplicates. A null conv_id is a conversation of its own. An empty role has no initial: it can't be kept
    and is illegal next to any other. Rows of which ``present`` is not true only name their conversation; one
    without other rows has zeros, an empty audit and the digest of an empty string. ``gaps`` beyond a long
    is the greatest long. An empty table gives an empty result; other columns are not read.
    """
    small_batches(conversations.sparkSession)
    there = F.lit(True) if present is None else F.coalesce(present, F.lit(False))
    rows = conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").cast("bigint").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"),
        there.alias("present"),
    )
    named = F.concat_ws("\n", F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.length("role").cast("string"), F.concat("role", "text"))
    rows = rows.withColumns(
        {
            "digest": F.unhex(F.sha2(named, 256)),
            "__role": F.substring("role", 1, HEAD),
            "__text": F.substring("text", 1, HEAD),
            # Only identical rows are told apart by it, so that they too can lie in several partitions.
            "__salt": F.monotonically_increasing_id(),
        }
    )
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "__role", "__text", "digest", "__salt"]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    found = staged(ordered.select("conv_id", "turn", "role", "text", "digest", "present").mapInArrow(pieces, PIECES_SQL), "conversations")
    names = [f.name for f in HASHED]
    whole = found.filter("position is null").select(*names)
    return whole.unionByName(open_results(found.filter("position is not null")))


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with planted faults by checksum of ``conv_id:turn``, and a column ``present`` that is false for dropped ones."""
    space = F.lit(" ")
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn")))
    code = F.crc32(key.cast("binary")) % 20
    rows = conversations.select(
        "conv_id",
        "turn",
        F.coalesce(F.col("role").cast("string"), space).alias("role"),
        F.coalesce(F.col("text").cast("string"), space).alias("text"),
        code.alias("code"),
    )
    return rows.select(
        "conv_id",
        "turn",
        F.when(F.col("code") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.translate("text", ENDS, "")).otherwise(F.col("text")).alias("text"),
        (F.col("code") != 0).alias("present"),
        F.explode(F.when(F.col("code") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"),
    ).drop("copy")
