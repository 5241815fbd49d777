"""Conversation repair, against a search over all edits."""

import hashlib
import itertools
import random
import re
import zlib
from heapq import heappop, heappush

import pytest
from pyspark.sql import functions as F

from docketry.llm import conversation_repair as C
from docketry.llm.queries import op11_conversation_repair

SF = "/root/testdata/sf0.001"
WHITE = " \t\n\v\f\r"


def brute_edits(symbols):
    """(cost, letters, roles) of the first cheapest edits: Dijkstra over (row, what the roles so far spell), least letters first."""
    heap = [(0, "", 0, "")]
    done = set()
    while True:
        cost, letters, n, roles = heappop(heap)
        if n == len(symbols) and re.fullmatch("(s?(ua)+)?", roles):
            return cost, letters, roles
        if (cost, letters, n, roles) in done:
            continue
        done.add((cost, letters, n, roles))
        steps = [("I", 3, n, roles + r) for r in "ua"] if len(roles) <= 2 * len(symbols) + 3 else []
        if n < len(symbols):
            symbol = symbols[n]
            steps.append(("D", 4, n + 1, roles))
            if symbol[-1] != "x":
                more = 3 if symbol[-1] == "t" else 0
                steps += [("K", more, n + 1, roles + symbol[0])] + [("R", 3 + more, n + 1, roles + r) for r in "ua"]
        for letter, more, at, new in steps:
            if re.fullmatch("s?(ua)*u?", new):
                heappush(heap, (cost + more, letters + letter, at, new))


def by_runs(symbols):
    runs = [(k, list(g)) for k, g in itertools.groupby(symbols)]
    starts = [1 + sum(len(g) for _, g in runs[:k]) for k in range(len(runs))]
    cost, made = C.cheapest_edits(starts, [k for k, _ in runs], len(symbols) + 1)
    letters, roles = "", ""
    for (n, inserted, edit, given), then in zip(made, made[1:] + [(len(symbols) + 2,)]):
        for k in range(n, then[0]):
            letters += "I" * len(inserted) + edit
            roles += inserted + (given or (symbols[k - 1][0] if edit == "K" else ""))
    return cost, letters, roles


SYMBOLS = ["s", "u", "a", "-", "st", "ut", "at", "-t", "x"]


@pytest.mark.parametrize("n", range(5))
def test_edits_of_short_conversations(n):
    for symbols in itertools.product(SYMBOLS, repeat=n) if n < 4 else random.Random(n).sample(list(itertools.product(SYMBOLS, repeat=n)), 400):
        assert by_runs(list(symbols)) == brute_edits(list(symbols)), symbols


def plain_cost(symbols):
    """The cost alone, row by row."""
    costs = [0, C.NEVER, C.NEVER, 0]
    free = lambda v: [min(v[q] + C.insertions()[p][q] for q in range(4)) for p in range(4)]
    costs = free(costs)
    for symbol in reversed(symbols):
        costs = free([min(more + costs[q] for _, more, q in C.choices(symbol, p)) for p in range(4)])
    return costs[0]


def test_long_runs_take_powers():
    r = random.Random(5)
    for _ in range(40):
        symbols = [s for _ in range(r.randrange(1, 6)) for s in [r.choice(SYMBOLS)] * r.choice([1, 2, 3, 31, 64, 100, 257])]
        cost, letters, roles = by_runs(symbols)
        assert cost == plain_cost(symbols) and re.fullmatch("(s?(ua)+)?", roles)
        assert cost == 4 * letters.count("D") + 3 * (letters.count("I") + letters.count("R")) + 3 * sum(s[-1] == "t" and e != "D" for s, e in zip(symbols, letters.replace("I", "")))
    assert C.cheapest_edits([1], ["u"], 10**5 + 1)[0] == 3 * 10**5 // 2


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        say = lambda x: " " if x is None else str(x)
        way, role, text = zlib.crc32(f"{say(conv)}:{say(turn)}".encode()) % 20, say(role), say(text)
        text = "" if way == 1 else re.sub("[.!?]", "", text) if way == 2 else text
        out += [(conv, turn, "user" if way == 4 else role, text)] * {0: 0, 3: 2}.get(way, 1)
    return out


def brute_repair(rows):
    """What the query returns, from undamaged rows."""
    out, after = {}, {}
    for x in damage(rows):
        after.setdefault(x[0], []).append(x[1:])
    for conv in {x[0] for x in rows}:
        own = sorted(after.get(conv, []), key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode()))
        seen, faults, symbols = set(), [], []
        for _, role, text in own:
            bare = text.strip(WHITE)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
            seen.add((role, text))
            faults.append(fault)
            symbols.append("x" if fault in ("blank", "duplicate") else (role[0] if role[:1] in ("s", "u", "a") else "-") + ("t" if fault else ""))
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, letters, roles = by_runs(symbols)
        if len(symbols) < 9:
            assert (cost, letters, roles) == brute_edits(symbols)
        lines, k, left = [], 0, list(roles)
        for edit in letters:
            if edit == "I":
                lines.append({"u": "user", "a": "assistant"}[left.pop(0)] + ":")
                continue
            _, role, text = own[k]
            k += 1
            if edit != "D":
                given = left.pop(0)
                lines.append((role if edit == "K" else {"u": "user", "a": "assistant"}[given]) + ":" + text)
        out[conv] = (gaps, *(faults.count(f) for f in C.FAULTS), illegal, cost, letters, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def test_query_against_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r[0]: tuple(r)[1:] for r in op11_conversation_repair(spark, SF).collect()}
    assert got == brute_repair(rows) and len(got) == len({r[0] for r in rows})


def odd_rows():
    r = random.Random(3)
    texts = ["", " \t\n", "Yes.", "No", "What?", "a\nb!\v", " ", None, "x" * 200_000 + ".", " ."]
    rows = [(r.choice([None, 0, 1, 2, 3, 7]), r.choice([None, 0, 1, 2, 3, 5, 9, 40]), r.choice(["user", "assistant", "system", "tool", "", None, "Sys"]), r.choice(texts)) for _ in range(150)]
    return rows + rows[:5] + [(50, k, "user", f"Line {k}.") for k in range(300)] + [(51, k, ("user", "assistant")[k % 2], f"Line {k}.") for k in range(200)] + [(60 + k, 0, "user", "One.") for k in range(40)]


def test_odd_rows(spark, tmp_path):
    rows = odd_rows()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("own") for c in ("n", "cost", "fault", "_conv")})
    df.write.parquet(str(tmp_path / "conversations.parquet"))
    got = op11_conversation_repair(spark, str(tmp_path))
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == brute_repair(rows)
    assert dict(got.dtypes) == {"conv_id": "bigint"} | {c: "bigint" for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")} | {"audit": "string", "repaired_sha256": "string"}
    empty = df.limit(0)
    assert C.repair_conversations(empty).count() == 0


def test_repaired_turns_and_other_ids(spark):
    rows = [("a", 1, "user", "Hello."), ("a", 2, "user", "Again."), ("a", 3, "assistant", "Yes."), ("b", None, "assistant", "Alone!"), (None, 1, "tool", "Result.")]
    read = C.materialize(C.with_faults(spark.createDataFrame(rows, "conv_id string, turn int, role string, text string")), "turns")
    turns, conversations = C.repair(read)
    got = [tuple(r) for r in turns.orderBy("conv_id", "n", "at").select("conv_id", "edit", "role", "text").collect()]
    assert got == [
        (None, "D", "tool", "Result."),
        ("a", "K", "user", "Hello."), ("a", "I", "assistant", ""), ("a", "K", "user", "Again."), ("a", "K", "assistant", "Yes."),
        ("b", "I", "user", ""), ("b", "K", "assistant", "Alone!"),
    ]
    assert {r.conv_id: r.cost for r in conversations.collect()} == {"a": 3, "b": 3, None: 4}
