"""Conversation repair against plain enumeration and a plain dynamic program."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from plumbline.llm import conversation_repair as repair
from plumbline.llm import queries

PATTERN = re.compile(r"(s?(ua)+)?")


def step(state, letter):
    """State after a role of that initial: '' start, 's', 'u', 'a'; None where the pattern ends."""
    if letter == "s":
        return "s" if state == "" else None
    if letter == "u":
        return "u" if state in ("", "s", "a") else None
    if letter == "a":
        return "a" if state == "u" else None
    return None


def plain_repair(rows):
    """rows: (role, text, must_go, cut_off). Least (cost, audit, lines) by one sweep over the rows."""
    ways = {"": (0, "", ())}

    def offer(found, state, way):
        if state is not None and (state not in found or way[:2] < found[state][:2]):
            found[state] = way

    def inserted(found):
        for _ in range(4):
            for state, (cost, audit, own) in list(found.items()):
                for role in ("user", "assistant"):
                    offer(found, step(state, role[0]), (cost + 3, audit + "I", (*own, f"{role}:")))
        return found

    ways = inserted(ways)
    for role, text, must_go, cut_off in rows:
        found = {}
        for state, (cost, audit, own) in ways.items():
            offer(found, state, (cost + 4, audit + "D", own))
            if not must_go:
                more = 3 if cut_off else 0
                if role:
                    offer(found, step(state, role[0]), (cost + more, audit + "K", (*own, f"{role}:{text}")))
                for new in ("user", "assistant"):
                    offer(found, step(state, new[0]), (cost + more + 3, audit + "R", (*own, f"{new}:{text}")))
        ways = inserted(found)
    return min(ways[s] for s in ("", "a") if s in ways)


def enumerated(rows):
    """The same by all edit sequences with at most two inserts before and after each row."""
    best = None
    inserts = [(), ("user",), ("assistant",), ("user", "assistant"), ("assistant", "user")]
    edits = ["D", "K", "R user", "R assistant"]
    for picked in itertools.product(*[list(itertools.product(inserts, edits))] * len(rows), inserts):
        cost, audit, own = 0, "", []
        for i, choice in enumerate(picked):
            more, edit = (choice, None) if i == len(rows) else choice
            for role in more:
                cost, audit = cost + 3, audit + "I"
                own.append((role, ""))
            if edit is None:
                continue
            role, text, must_go, cut_off = rows[i]
            audit += edit[0]
            if edit == "D":
                cost += 4
                continue
            if must_go or not (edit[2:] or role):
                break
            cost += (3 if cut_off else 0) + (3 if edit[0] == "R" else 0)
            own.append((edit[2:] or role, text))
        else:
            if PATTERN.fullmatch("".join(r[:1] for r, _ in own)) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, tuple(f"{r}:{t}" for r, t in own))
    return best


def plain(rows, drop=True):
    """All result columns, from rows (conv_id, turn, role, text)."""
    groups = {}
    for conv_id, turn, role, text in rows:
        own = groups.setdefault(conv_id, [])
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}"
        code = zlib.crc32(key.encode()) % 20 if drop else 9
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(code, text)
        own += [(turn, "user" if code == 4 else role, text)] * {0: 0, 3: 2}.get(code, 1)
    out = []
    for conv_id, own in groups.items():
        digest = lambda r: hashlib.sha256("\n".join(["" if conv_id is None else str(conv_id), str(len(r[1])), r[1] + r[2]]).encode()).digest()  # noqa: E731,B023
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1][:32].encode(), r[2][:32].encode(), digest(r)))
        seen, marked, count = set(), [], [0, 0, 0]
        for _, role, text in own:
            body = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
            fault = 0 if not body else 1 if (role, text) in seen else 2 if body[-1] not in ".!?" else None
            if fault is not None:
                count[fault] += 1
            seen.add((role, text))
            marked.append((role, text, fault in (0, 1), fault == 2))
        turns = {t for t, *_ in own if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        initials = [r[:1] for r, *_ in marked]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
        cost, audit, lines = plain_repair(marked)
        out.append((conv_id, min(gaps, repair.TOP), *count, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def codes(rows):
    return bytes(repair.initial_of(r) | (repair.TRUNCATED if c else 0) | (repair.GOES if m else 0) for r, _, m, c in rows)


def some_rows(rng, n):
    kinds = ["user"] * 4 + ["assistant"] * 4 + ["system", "tool", "", " "]
    return [(rng.choice(kinds), f"t{i}", *rng.choice([(False, False)] * 4 + [(True, False), (False, True)])) for i in range(n)]


def test_search_equals_enumeration():
    rng = random.Random(1)
    for n in (0, 1, 1, 2, 2, 2, 3, 3):
        for _ in range(12 if n < 3 else 5):
            rows = some_rows(rng, n)
            want = enumerated(rows)
            assert repair.cheapest(codes(rows), 0, (0, 3)) == want[:2] == plain_repair(rows)[:2], rows
            assert tuple(repair.lines(want[1], 0, iter([r[:2] for r in rows]))) == want[2]


def test_search_equals_sweep_and_segments():
    rng = random.Random(2)
    for _ in range(400):
        rows = some_rows(rng, rng.randrange(25))
        want = plain_repair(rows)
        own = codes(rows)
        assert repair.cheapest(own, 0, (0, 3)) == want[:2], rows
        cut = sorted(rng.randrange(len(own) + 1) for _ in range(rng.randrange(4)))
        parts = [own[a:b] for a, b in itertools.pairwise([0, *cut, len(own)])]
        assert repair.accepted(repair.all_joined([repair.table_of(p) for p in parts])) == want[:2], rows
        assert tuple(repair.lines(want[1], 0, iter([r[:2] for r in rows]))) == want[2]


def rows_of(rng, conversations, longest):
    rows = []
    for conv_id in conversations:
        for turn in range(rng.randrange(1, longest)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", None, "tool", "", "umpire"])
            text = rng.choice(["Yes.", "No!", "Why?  \n", "cut off", "", " \t", None, f"Own {turn}.", f"own {turn}", "é…", ". .x"])
            rows.append((conv_id, rng.choice([turn, turn, turn, turn + 3, None]), role, text))
    return rows + rng.sample(rows, min(3, len(rows)))


def frame(spark, rows):
    wide = [(c, t, r, x, "z", 1, True) for c, t, r, x in rows]
    return spark.createDataFrame(wide, "conv_id bigint, turn bigint, role string, text string, digest string, position int, present boolean").repartition(5)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("held", [10_000, 5])
def test_equals_plain(spark, held, monkeypatch):
    rng = random.Random(3)
    rows = rows_of(rng, [*range(40), None, -5], 9)
    found = repair.repair(repair.damaged(frame(spark, rows)), repair.F.col("present"))
    assert found.columns == "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256".split()
    assert got(found) == plain(rows)
    if held < 100:
        undamaged = repair.repair(frame(spark, rows).drop("present"))
        assert got(undamaged) == plain(rows, drop=False)


def test_one_conversation_over_all_partitions(spark):
    """Most rows belong to one conversation; a third of these are one row again and again."""
    rng = random.Random(4)
    rows = rows_of(rng, [7] * 150 + [*range(5)], 9)
    rows += [(7, 4, "user", "again and again.")] * (len(rows) // 3)
    rows = [(c, t if t is None else t + i % 90, r, x) for i, (c, t, r, x) in enumerate(rows)]
    assert got(repair.repair(frame(spark, rows).drop("present"))) == plain(rows, drop=False)


def test_null_conversation_over_all_partitions(spark):
    rows = [(None, i, ("user", "assistant")[i % 2], f"Row {i}.") for i in range(400)]
    found = got(repair.repair(frame(spark, rows).drop("present")))
    assert found == plain(rows, drop=False) and found[0][7] == "K" * 400


def test_empty_dropped_and_extreme(spark):
    assert got(repair.repair(frame(spark, []))) == []
    rows = [(1, -(2**63), "user", "A."), (1, 2**63 - 1, "assistant", "B."), (2, None, None, None), (3, 1, "user", "x" * 300_000)]
    assert got(repair.repair(frame(spark, rows).drop("present"))) == plain(rows, drop=False)
    empty = hashlib.sha256(b"").hexdigest()
    nobody = repair.repair(frame(spark, rows), repair.F.lit(False))
    assert got(nobody) == [(c, 0, 0, 0, 0, 0, 0, "", empty) for c in (1, 2, 3)]


def test_registered_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(queries.QUERIES["op12_conversation_repair"](spark, sf)) == plain(rows)


def test_long_rows_of_repeats_stay_quick():
    rows = b"".join(bytes([c]) for c in (1, 5, 2, 9) * 16)
    assert repair.cheapest(rows, 0, (0, 3))[0] >= 16 * 4
