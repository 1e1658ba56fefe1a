"""Repair of the structure of conversations at least cost, by Four-Russians block tables (operator 13).

A conversation's rows are symbols: the role's initial (s, u, a or another) and the row's first fault. Wanted are roles
whose initials are ``(s?(ua)+)?``. Edits: Keep costs 0; Rerole to user or assistant 2; Delete 3, which blank and duplicate
rows must suffer; Insert an empty user or assistant turn 2; a truncated row that stays costs 1 more. Of the cheapest edits
those with the ASCII-least initials are taken.

The costs to the end from each of the pattern's four states are a vector that differs from its least entry by a bounded
amount, so only a handful of normalised vectors occur. For each of them and every block of ``block`` symbols a table holds
the vector before the block and the cost that it adds. A conversation is processed from its end by one lookup a block; on
the way back each block is expanded from the vector behind it, and the first letter in ASCII order that keeps to the
least cost is taken, so that ties come out the same whatever the blocks.

On Spark: equal rows are counted before the shuffle; whether a row was seen earlier is a join with the first turn of each
text's digest; rows are grouped by conversation and ``chunk_turns`` turn numbers; only symbols, two small values a row,
come together for a whole conversation, as its audit does in the result. Texts are met again chunk by chunk, and never
all those of a conversation at once. (The query's digest of a whole repaired conversation is the exception its contract
asks for.)

Defined results: null role or text is one space; null turns come first; rows of one turn are ordered by role, then by a
digest of role and text; a null id is a conversation of its own; repeated rows are duplicates; an empty table gives an
empty one; other columns don't pass, as inserted rows have none.
"""

from __future__ import annotations

from functools import lru_cache, reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import add_columns, let, written
from .importance import CRC_TABLE, crc_sql

SPACE = r" \t\n\x0B\f\r"
# States of the pattern: nothing yet, after s, after a user, after an assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
#: State after an inserted or re-roled turn, by state.
MADE = (USER, USER, ASSISTANT, USER)
#: State after a kept row whose role begins with s, u, a or another letter, by state; -1 where it can't stand.
KEPT = ((SYSTEM, -1, -1, -1), (USER, USER, -1, USER), (-1, -1, ASSISTANT, -1), (-1, -1, -1, -1))
END = (0, 4, 2, 0)  # costs behind the last row: what must still be inserted
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
FORCED, N_SYMBOLS = 8, 9  # symbols 0 to 7: 2 * initial + truncated
NO_TURN = -(1 << 60)  # the chunk of null turns


def _direct(symbol: int, state: int) -> list[tuple[str, int, int]]:
    """(letter, cost, next state) of the edits of a row, in ASCII order."""
    out = [("D", 3, state)]
    if symbol != FORCED:
        initial, cut = divmod(symbol, 2)
        if KEPT[initial][state] >= 0:
            out.append(("K", cut, KEPT[initial][state]))
        out.append(("R", 2 + cut, MADE[state]))
    return out


def _before(symbol: int, after: tuple[int, ...]) -> tuple[int, ...]:
    """Costs before a row from those behind it, inserts before the row included."""
    out = [min(cost + after[to] for _, cost, to in _direct(symbol, q)) for q in range(4)]
    for _ in range(3):
        out = [min(c, 2 + out[MADE[q]]) for q, c in enumerate(out)]
    return tuple(out)


class BlockTables:
    """Normalised cost vectors that occur, and transitions of them by symbol and by block of symbols."""

    def __init__(self, block: int):
        self.block, self.vectors, known = block, [END], {END: 0}
        one = []
        for v in self.vectors:  # grows while it is walked
            row = []
            for symbol in range(N_SYMBOLS):
                costs = _before(symbol, v)
                low = min(costs)
                new = tuple(c - low for c in costs)
                if new not in known:
                    known[new] = len(self.vectors)
                    self.vectors.append(new)
                row.append((known[new], low))
            one.append(row)
        table = np.array(one).transpose(1, 0, 2)  # symbol, vector, (vector before, cost added)
        self.one_to, self.one_add = table[..., 0], table[..., 1]
        to, add = np.arange(len(self.vectors))[None], np.zeros((1, len(self.vectors)), np.int64)
        for _ in range(block):  # a symbol in front of shorter blocks
            add = (add[None] + self.one_add[:, to]).reshape(-1, len(self.vectors))
            to = self.one_to[:, to].reshape(-1, len(self.vectors))
        self.to, self.add = to.tolist(), add.tolist()
        self.one_to, self.one_add = self.one_to.tolist(), self.one_add.tolist()

    def solve(self, symbols: list[int]) -> tuple[int, list[tuple[str, int]]]:
        """The least cost and, in order, the letters of the ASCII-least cheapest edits with the state after each."""
        head, code, at = len(symbols) % self.block, [], len(symbols) % self.block
        while at < len(symbols):
            n = 0
            for s in symbols[at : at + self.block]:
                n = n * N_SYMBOLS + s
            code.append(n)
            at += self.block
        behind, v, cost = [], 0, 0  # the vector behind each block
        for n in reversed(code):
            behind.append(v)
            cost += self.add[n][v]
            v = self.to[n][v]
        behind.reverse()
        first = v
        for s in reversed(symbols[:head]):
            cost += self.one_add[s][v]
            v = self.one_to[s][v]
        cost += self.vectors[v][START]
        out: list[tuple[str, int]] = []
        state = self._trace(symbols[:head], first, START, out)
        for i, v in enumerate(behind):
            a = head + i * self.block
            state = self._trace(symbols[a : a + self.block], v, state, out)
        while END[state]:
            state = MADE[state]
            out.append(("I", state))
        return cost, out

    def _trace(self, symbols: list[int], behind: int, state: int, out: list[tuple[str, int]]) -> int:
        """Expands a block backward from the vector behind it, then takes its edits forward; gives the state behind it."""
        ids = [behind]
        for s in reversed(symbols):
            ids.append(self.one_to[s][ids[-1]])
        ids.reverse()
        for i, s in enumerate(symbols):
            here, after, add = self.vectors[ids[i]], self.vectors[ids[i + 1]], self.one_add[s][ids[i + 1]]
            while True:
                rest = here[state] + add
                edits = _direct(s, state)
                best = next((e for e in edits if e[1] + after[e[2]] == rest), None)
                if best is None or (best[0] > "I" and here[state] == 2 + here[MADE[state]]):
                    state = MADE[state]
                    out.append(("I", state))
                    continue
                state = best[2]
                out.append((best[0], state))
                break
        return state


@lru_cache(maxsize=4)
def block_tables(block: int) -> BlockTables:
    return BlockTables(block)


def _digest(role: Column, text: Column) -> Column:
    return F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))


def _rows(df: DataFrame, chunk_turns: int) -> DataFrame:
    """conv_id, chunk, turn, role, sha, text of all rows."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit(" ")), F.coalesce(F.col("text").cast("string"), F.lit(" "))
    rows = df.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    chunk = F.coalesce(F.floor(F.col("turn") / chunk_turns), F.lit(NO_TURN))
    return rows.withColumns({"chunk": chunk, "sha": _digest(F.col("role"), F.col("text"))})


def _join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """left with the other columns of right by keys, of which nulls are equal."""
    right = right.withColumnsRenamed({k: f"_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    return left.join(right, same, how).drop(*[f"_{k}" for k in keys])


AUDIT = (
    "blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
    "edits array<struct<chunk:bigint,offset:bigint,turns:array<struct<row:int,role:string>>>>"
)


def audits(df: DataFrame, block: int = 4, chunk_turns: int = 256) -> DataFrame:
    """One row a conversation: gaps, counts of faults and illegal pairs, cost, audit, and the edits of each chunk.

    An edit is a turn of the result: ``row`` numbers the chunk's distinct rows in order (null: inserted), ``role`` is the
    new role (null: kept).
    """
    rows = _rows(df, chunk_turns)
    some = F.col("text").rlike(f"[^{SPACE}]")
    whole = F.col("text").rlike(rf"[.!?][{SPACE}]*\z")
    light = rows.groupBy("conv_id", "chunk", "turn", "role", "sha", (~some).alias("blank"), (~whole).alias("cut")).agg(F.count("*").alias("n"))
    light = written(light)
    first = light.groupBy("conv_id", "sha").agg(F.min("turn").alias("first"), F.bool_or(F.col("turn").isNull()).alias("in_front"))
    again = F.coalesce((F.col("turn") > F.col("first")) | (F.col("turn").isNotNull() & F.col("in_front")), F.lit(False))
    fault = F.when(F.col("blank"), BLANK).when(again, DUPLICATE).when(F.col("cut"), TRUNCATED).otherwise(FINE)
    seen = _join(light, first, ["conv_id", "sha"]).withColumn("fault", fault)
    kind = F.array_sort(F.collect_list(F.struct("turn", "role", "sha", "fault", "n")))
    chunks = seen.groupBy("conv_id", "chunk").agg(kind.alias("rows"), F.min("turn").alias("low"), F.max("turn").alias("high"))
    initial = lambda r: F.when(F.substring(r["role"], 1, 1).isin("s", "u", "a"), F.substring(r["role"], 1, 1)).otherwise("-")
    chunks = chunks.select(
        "conv_id", "low", "high",
        F.size(F.array_distinct(F.filter(F.transform("rows", lambda r: r["turn"]), lambda t: t.isNotNull()))).alias("turns"),
        F.struct(
            "chunk", F.array_join(F.transform("rows", initial), "").alias("initials"), F.array_join(F.transform("rows", lambda r: r["fault"].cast("string")), "").alias("faults"),
            F.transform("rows", lambda r: r["n"]).alias("n"),
        ).alias("part"),
    )
    gaps = F.coalesce(F.max("high") - F.min("low") + 1 - F.sum("turns"), F.lit(0)).cast("long")
    heads = chunks.groupBy("conv_id").agg(gaps.alias("gaps"), F.array_sort(F.collect_list("part")).alias("_parts"))

    def fn(parts: list[list]) -> list[tuple]:
        tables = block_tables(block)
        return [_audit(p, tables) for p in parts]

    return add_columns(heads, [heads["_parts"]], fn, AUDIT, drop=("_parts",))


def _audit(parts: list[dict], tables: BlockTables) -> tuple:
    initials, faults, place = [], [], []  # of each row, copies expanded; (part, row in it)
    for i, p in enumerate(parts):
        for j, (c, f, n) in enumerate(zip(p["initials"], map(int, p["faults"]), p["n"], strict=True)):
            initials += [c] * n
            faults += [f] + [BLANK if f == BLANK else DUPLICATE] * (n - 1)
            place += [(i, j)] * n
    symbols = [FORCED if f in (BLANK, DUPLICATE) else 2 * "sua-".index(c) + (f == TRUNCATED) for c, f in zip(initials, faults, strict=True)]
    cost, letters = tables.solve(symbols)
    turns: list[list] = [[] for _ in parts]
    at = 0
    for letter, state in letters:
        i, j = place[min(at, len(place) - 1)]
        role = {USER: "user", ASSISTANT: "assistant"}.get(state)
        if letter == "I":
            turns[i].append({"row": None, "role": role})
            continue
        if letter != "D":
            turns[i].append({"row": j, "role": role if letter == "R" else None})
        at += 1
    edits, done = [], 0
    for p, t in zip(parts, turns, strict=True):
        edits.append({"chunk": p["chunk"], "offset": done, "turns": t})
        done += len(t)
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    return (*[faults.count(f) for f in (BLANK, DUPLICATE, TRUNCATED)], illegal, cost, "".join(x for x, _ in letters), edits)


def _pieces(df: DataFrame, audit: DataFrame, chunk_turns: int) -> DataFrame:
    """conv_id, chunk, offset, turns (role, text) of the repaired conversations, chunk by chunk."""
    rows = _rows(df, chunk_turns)
    texts = rows.groupBy("conv_id", "chunk").agg(F.array_sort(F.collect_set(F.struct("turn", "role", "sha", "text"))).alias("rows"))
    edits = audit.select("conv_id", F.explode("edits").alias("e")).select("conv_id", "e.*")

    def turn(e: Column) -> Column:
        return let(F.get("rows", e["row"]), lambda r: F.struct(F.coalesce(e["role"], r["role"]).alias("role"), F.coalesce(r["text"], F.lit("")).alias("text")))

    return _join(edits, texts, ["conv_id", "chunk"]).select("conv_id", "chunk", "offset", F.transform("turns", turn).alias("turns"))


def repair(df: DataFrame, block: int = 4, chunk_turns: int = 256) -> DataFrame:
    """conv_id, position (from 0), role, text: the turns of all conversations after their cheapest edits."""
    pieces = _pieces(df, audits(df, block, chunk_turns), chunk_turns)
    turns = pieces.select("conv_id", "offset", F.posexplode("turns").alias("i", "t"))
    return turns.select("conv_id", (F.col("offset") + F.col("i")).alias("position"), "t.role", "t.text")


def damage(df: DataFrame) -> DataFrame:
    """Rows of conversations, a fifth of them damaged by a hash of id and turn: dropped, emptied, cut, repeated, re-roled."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    key = F.concat(*[x for c in ("conv_id", "turn") for x in (F.coalesce(F.col(c).cast("string"), F.lit(" ")), F.lit(":"))][:3])
    h = F.crc32(key) % 20
    text = F.when(h == 1, "").when(h == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    copies = F.array_repeat(F.lit(0), F.when(h == 0, 0).when(h == 3, 2).otherwise(1).cast("int"))
    rows = df.select("conv_id", "turn", F.when(h == 4, "user").otherwise(role).alias("role"), text.alias("text"), copies.alias("_copies"))
    return rows.select("*", F.explode("_copies")).drop("_copies", "col")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damages all conversations and repairs them; one row each."""
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    rows = damage(table)
    audit = written(audits(rows))
    pieces = _pieces(rows, audit, 256).filter(F.size("turns") > 0)
    piece = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    joined = pieces.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("chunk", piece.alias("piece")))).alias("p"))
    whole = joined.select("conv_id", F.sha2(F.array_join(F.transform("p", lambda x: x["piece"]), "\n"), 256).alias("sha"))
    out = _join(_join(table.select("conv_id").distinct(), audit.drop("edits"), ["conv_id"], "left"), whole, ["conv_id"], "left")
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def _step_sql() -> str:
    """One row r = [initial, fault] onto v, the best 'cost, audit' texts of the four states, in DuckDB's SQL."""

    def f(s: str, cost: str, letter: str) -> str:
        return f"(lpad((substr({s}, 1, 9)::int + {cost})::varchar, 9, '0') || substr({s}, 10) || '{letter}')"

    cut = "(case when r[2] = 'truncated' then 1 else 0 end)"
    may = "r[2] not in ('blank', 'duplicate')"
    z, s, u, a = (f"v[{i}]" for i in range(1, 5))

    def move(frm: list[str], initial: str, rerole: bool) -> str:
        kept = [f"case when {may} and r[1] = '{initial}' then {f(x, cut, 'K')} end" for x in frm]
        made = [f"case when {may} then {f(x, f'(2 + {cut})', 'R')} end" for x in frm if rerole]
        return ", ".join(kept + made)

    drop = [f(x, "3", "D") for x in (z, s, u, a)]
    direct = f"[{drop[0]}, least({drop[1]}, {move([z], 's', False)}), least({drop[2]}, {move([z, s, a], 'u', True)}), least({drop[3]}, {move([u], 'a', True)})]"
    user = f"least({u}, {f(z, '2', 'I')}, {f(s, '2', 'I')}, {f(a, '2', 'I')})"
    closed = f"list_transform([{direct}], lambda v: [{z}, {s}, {user}, {a}])[1]"
    return f"list_transform([{closed}], lambda v: [{z}, {s}, {u}, least({a}, {f(u, '2', 'I')})])[1]"


ORACLE = rf"""
with tab as ({CRC_TABLE}),
k as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as key from conversations),
h as (select *, {crc_sql("key")} % 20 as h from k, tab),
d as (
  select conv_id, turn, case when h = 4 then 'user' else role end as role,
    case h when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, unnest(range(case h when 0 then 0 when 3 then 2 else 1 end)) as copy
  from h),
o as (select *, row_number() over (partition by conv_id order by turn nulls first, role, sha256(length(role) || ':' || role || text)) as i from d),
s as (select *, row_number() over (partition by conv_id, role, text order by i) as seen, coalesce(nullif(left(role, 1), ''), '-') as c from o),
b as (
  select *, case when not regexp_matches(text, '[^\x20\x09-\x0D]') then 'blank' when seen > 1 then 'duplicate'
      when not regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') then 'truncated' else '' end as fault,
    lag(c) over (partition by conv_id order by i) || c as pair
  from s),
g as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (where fault = 'blank') as blank,
    count(*) filter (where fault = 'duplicate') as duplicate, count(*) filter (where fault = 'truncated') as truncated,
    count(*) filter (where pair not in ('su', 'ua', 'au')) as illegal,
    list_reduce(list_prepend(['000000000', null, '000000002I', '000000004II'], list([c, fault] order by i)), lambda v, r: {_step_sql()}) as v
  from b group by conv_id),
a as (select conv_id, substr(least(v[1], v[4]), 1, 9)::bigint as cost, substr(least(v[1], v[4]), 10) as audit from g),
l as (select conv_id, unnest(range(1, length(audit) + 1)) as p, substr(audit, p, 1) as letter from a),
n as (
  select conv_id, p, letter, sum((letter <> 'I')::int) over w as i, sum((letter <> 'D')::int) over w as e
  from l window w as (partition by conv_id order by p)),
m as (
  select n.conv_id, p, letter, e, text, role, first_value(letter = 'K' and b.c = 's') over (partition by n.conv_id order by p) as lead
  from n left join b on n.conv_id is not distinct from b.conv_id and n.i = b.i and n.letter <> 'I' where letter <> 'D'),
r as (
  select conv_id, sha256(string_agg(case when letter = 'K' then role when (e - lead::int) % 2 = 1 then 'user' else 'assistant' end || ':' || coalesce(text, ''), chr(10) order by p)) as sha
  from m group by conv_id)
select c.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated,
  coalesce(illegal, 0) as illegal, coalesce(cost, 0) as cost, coalesce(audit, '') as audit, coalesce(sha, sha256('')) as repaired_sha256
from (select distinct conv_id from conversations) c left join g on c.conv_id is not distinct from g.conv_id
  left join a on c.conv_id is not distinct from a.conv_id left join r on c.conv_id is not distinct from r.conv_id
"""

QUERIES = {"op13_conversation_repair": op13_conversation_repair}
ORACLES = {"op13_conversation_repair": ORACLE}
