import hashlib
import random
import re
import zlib

import pytest

from featurespark.llm.conversations import FORCED, BlockTables, audits, damage, op13_conversation_repair, repair

PATTERN = re.compile("s?(ua)*u?")
SPACES = " \t\n\x0b\f\r"


def cheapest(rows):
    """(cost, audit, turns) of the best edits: for each string of initials' end, the least (cost, letters) so far, row by row."""

    def moves(ends):  # inserts, until nothing gets better
        todo = list(ends)
        while todo:
            s = todo.pop()
            cost, letters, turns = ends[s]
            role = "assistant" if s == "u" else "user"
            new = (cost + 2, letters + "I", turns + ((role, ""),))
            if role[0] not in ends or new[:2] < ends[role[0]][:2]:
                ends[role[0]] = new
                todo.append(role[0])
        return ends

    ends = moves({"": (0, "", ())})
    for role, text, fault in rows:
        new = {}
        for s, (cost, letters, turns) in ends.items():
            made = "assistant" if s == "u" else "user"
            able = [(s, 3, "D", ())]
            if fault not in ("blank", "duplicate"):
                cut = fault == "truncated"
                able.append((made[0], 2 + cut, "R", ((made, text),)))
                if role and PATTERN.fullmatch({"": "", "s": "s", "u": "u", "a": "ua"}[s] + role[0]):
                    able.append((role[0], cut, "K", ((role, text),)))
            for to, more, letter, turn in able:
                x = (cost + more, letters + letter, turns + turn)
                if to not in new or x[:2] < new[to][:2]:
                    new[to] = x
        ends = moves(new)
    return min((ends[s] for s in ("", "a") if s in ends), key=lambda x: x[:2])


def brute(rows):
    """The contract's columns from damaged rows (conv_id, turn, role, text)."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = [(r[1], " " if r[2] is None else r[2], " " if r[3] is None else r[3]) for r in rows if r[0] == conv]
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).hexdigest()))
        seen, judged = set(), []
        for _, role, text in own:
            bare = text.strip(SPACES)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            judged.append((role, text, fault))
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        faults = [f for _, _, f in judged]
        illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit, made = cheapest(judged)
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest()
        out[conv] = (gaps, *[faults.count(x) for x in ("blank", "duplicate", "truncated")], illegal, cost, audit, sha, list(made))
    return out


@pytest.mark.parametrize("block", [1, 2, 3, 5])
def test_tables_equal_plain_search(block):
    rng, tables = random.Random(block), BlockTables(block)
    for _ in range(400):
        symbols = [rng.choice(range(9)) for _ in range(rng.randrange(14))]
        rows = [("sua-"[s // 2 % 4] if s != FORCED else "u", "x", "blank" if s == FORCED else "truncated" if s % 2 else "") for s in symbols]
        cost, letters = tables.solve(symbols)
        assert (cost, "".join(x for x, _ in letters)) == cheapest(rows)[:2]


def odd_rows():
    rng, rows = random.Random(5), []
    for conv in [None, *range(40)]:
        for _ in range(rng.randrange(1, 14)):
            turn = rng.choice([None, *range(-3, 9), 255, 256, 257, 1000])
            rows.append((conv, turn, rng.choice(["user", "assistant", "system", "tool", "", None, "unknown"]), rng.choice(["Yes.", "no", None, "", " \n", "Why? \t", "é!", "a\x00b", "Yes."])))
    rows += [(50, 3, "user", "again?")] * 700 + [(50, 3, "user", " ")] * 5 + [(50, 4, "assistant", "x" * 300_000 + ".")]
    rows += [(51, i, "user" if i % 2 == 0 else "assistant", f"turn {i}" + "." * (i % 5 > 0)) for i in range(1500)]
    return rows


def test_rows_of_all_kinds(spark):
    rows = odd_rows()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'x' as cost", "1 as chunk", "2 as _conv_id")
    want = brute(rows)
    got = {r.conv_id: r for r in audits(df.repartition(6), block=3).collect()}
    assert {k: tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")) for k, r in got.items()} == {k: v[:7] for k, v in want.items()}
    made = {}
    for r in repair(df.repartition(6), chunk_turns=7).orderBy("position").collect():
        made.setdefault(r.conv_id, []).append((r.role, r.text))
        assert r.position == len(made[r.conv_id]) - 1
    assert made == {k: v[8] for k, v in want.items() if v[8]}
    assert repair(df.limit(0)).count() == 0 and audits(df.limit(0)).count() == 0


def test_query_on_all_conversations(spark, tmp_path):
    """Damage and repair of odd rows by the query itself, ids that lose all rows included."""
    rows = odd_rows() + [(1000 + i, 0, "user", "One row?") for i in range(60)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    left = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        left += [(conv, turn, "user" if h == 4 else role, text)] * {0: 0, 3: 2}.get(h, 1)
    want = brute(left)
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    got = {r.conv_id: tuple(r)[1:] for r in op13_conversation_repair(spark, str(tmp_path)).collect()}
    assert got == {k: want[k][:8] if k in want else empty for k in {r[0] for r in rows}}
    assert empty in got.values()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert sorted(map(tuple, damage(df).collect()), key=repr) == sorted(left, key=repr)
