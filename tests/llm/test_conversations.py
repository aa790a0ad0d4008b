import hashlib
import heapq
import random
import re
import time
import zlib

import pytest

from talkloom.llm import conversations as v

SMALL = "/root/testdata/sf0.001"
ROWS = "conv_id long, turn long, role string, text string, cost string, at int"
GOOD = re.compile("(s?(ua)+)?")


def edits_by_search(rows):
    """(cost, audit, what is left) by Dijkstra's search over edit scripts: rows are (role, text, fault)."""
    heap, done = [(0, "", 0, "")], set()
    while heap:
        cost, audit, k, left = heapq.heappop(heap)
        if (k, left) in done:
            continue
        done.add((k, left))
        if k == len(rows) and GOOD.fullmatch(left):
            return cost, audit, left
        moves = [(3, "I", k, r) for r in "ua"]
        if k < len(rows):
            role, _, fault = rows[k]
            moves.append((4, "D", k + 1, ""))
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                moves += [(more, "K", k + 1, role[:1] or "?")] + [(3 + more, "R", k + 1, r) for r in "ua"]
        for c, letter, to, said in moves:
            new = left + said
            if re.fullmatch("(s|s?(ua)*u?)?", new):
                heapq.heappush(heap, (cost + c, audit + letter, to, new))


def report_by_hand(rows):
    """rows: (turn, role, text) of one conversation after damage, in order."""
    seen, faulty = set(), []
    for _, role, text in rows:
        said = text.rstrip(" \t\n\v\f\r")
        fault = "blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else ""
        seen.add((role, text))
        faulty.append((role, text, fault))
    cost, audit, left = edits_by_search(faulty)
    at, lines = 0, []
    for letter in audit:
        if letter == "I":
            lines.append({"u": "user:", "a": "assistant:"}[left[len(lines)]])
            continue
        role, text, _ = faulty[at]
        at += 1
        if letter != "D":
            lines.append(f"{role if letter == 'K' else {'u': 'user', 'a': 'assistant'}[left[len(lines)]]}:{text}")
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    count = [sum(f == x for _, _, f in faulty) for x in ("blank", "duplicate", "truncated")]
    return (gaps, *count, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def damage_by_hand(rows):
    space = lambda x: " " if x is None else str(x)
    out = {}
    for conv, turn, role, text in rows:
        kept = out.setdefault(conv, [])
        h = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20
        role, text = "user" if h == 4 else space(role), "" if h == 1 else space(text)
        kept += [(turn, role, re.sub("[.!?]", "", text) if h == 2 else text)] * (h != 0) * (1 + (h == 3))
    order = lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())
    return {c: sorted(k, key=order) for c, k in out.items()}


FIELDS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def report(df):
    return {r.conv_id: tuple(r[f] for f in FIELDS) for r in df.collect()}


@pytest.mark.parametrize("stretch", [1024, 2])
def test_edits_are_the_cheapest_and_least(monkeypatch, stretch):
    monkeypatch.setattr(v, "STRETCH", stretch)
    rng = random.Random(stretch)
    for _ in range(400):
        kinds = rng.sample([(r, f) for r in "sua?" for f in ("", "truncated", "blank")], rng.randrange(1, 5))
        rows = [k for k in rng.choices(kinds, k=4) for _ in range(rng.choice((1, 1, 2, 3)))][:8]
        symbols = ["sua?".index(r) * 3 + ("", "truncated", "blank").index(f) for r, f in rows]
        runs = []
        for s in symbols:
            runs = [*runs[:-1], (s, runs[-1][1] + 1)] if runs and runs[-1][0] == s else [*runs, (s, 1)]
        assert v.cheapest_edits(runs) == edits_by_search([(r, "", f) for r, f in rows])[:2]


def test_long_runs_are_crossed_by_powers():
    began = time.time()
    after = v.before_run(3, 10**15, v.AT_END)  # users' rows without answer
    assert after[0] == 3 * 10**15 // 2 and time.time() - began < 1  # every second one becomes an answer
    ahead = v.AT_END
    for symbol in [6] * 50_001 + [3] * 50_000:
        ahead = v._apply(v.power(symbol, 0), ahead)
    cost, audit = v.cheapest_edits([(3, 50_000), (6, 50_001)])
    assert cost == ahead[0] and len(audit.replace("I", "")) == 100_001


def test_odd_rows(spark):
    rows = [(1, 0, "system", "Be."), (1, 1, "user", "Hi?"), (1, 2, "assistant", "So."), (2, None, None, None), (2, None, "tool", "x."), (3, 5, "User", "y"), (3, 1, "", "z."), (None, 1, "user", "a."), (None, 1, "user", "a."), (4, 3, "assistant", "b! "), (4, 3, "assistant", "b! \v"), (4, 9, "s", "c.")]
    rng = random.Random(1)
    for conv in range(10, 60):
        rows += [(conv, rng.choice((k, k, 2 * k, None)), rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["ok.", "no", " ", "a?", "b!\n"])) for k in range(rng.randrange(8))]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], ROWS).repartition(4)
    want = {c: report_by_hand(k) for c, k in damage_by_hand(rows).items()}
    assert report(v.repair_report(v.damaged(df), df)) == want
    assert {"I", "D", "K", "R"} <= set("".join(x[6] for x in want.values()))


def test_a_long_conversation_streams(spark):
    rows = [(7, k, "user" if k % 2 == 0 else "assistant", f"text {k}.") for k in range(30_000)] + [(8, 0, "user", "x " * 200_000 + ".")]
    df = spark.createDataFrame([(*r, "", 1) for r in rows], ROWS).repartition(3)
    got = report(v.repair_report(df, df))
    lines = "\n".join(f"{r}:{t}" for _, _, r, t in rows[:30_000])
    assert got[7] == (0, 0, 0, 0, 0, 0, "K" * 30_000, hashlib.sha256(lines.encode()).hexdigest()) and got[8][5:7] == (3, "KI")


def test_nothing_left(spark):
    dropped = next(k for k in range(1000) if zlib.crc32(f"5:{k}".encode()) % 20 == 0)
    df = spark.createDataFrame([(5, dropped, "user", "x.", "", 1)], ROWS)
    assert report(v.repair_report(v.damaged(df), df)) == {5: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    none = spark.createDataFrame([], ROWS)
    assert v.repair_report(none, none).count() == 0


def test_query_by_hand(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert report(v.op13_conversation_repair(spark, SMALL)) == {c: report_by_hand(k) for c, k in damage_by_hand(rows).items()}
