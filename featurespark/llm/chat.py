r"""Chat formatting in budgeted windows (operator 11), in DataFrame functions only.

A conversation becomes training texts of at most ``budget`` tokens. Prefix sums of its turns' tokens (a pre-token count
plus the template's marks) choose spans that begin and end at turns: a window begins where the one before ended, repeats
the system turn and as many of the turns before it as ``history_turns``, ``history_tokens`` and its first turn allow, and
goes on while the sum of its tokens fits. The loss mask covers the assistant texts that are new in a window; repeated ones
are masked out, so each is learned once. A turn that doesn't fit with the system turn is a window of its own, marked
``over_budget``; nothing is cut or dropped.

Template: ``<|im_start|>role\ntext<|im_end|>\n``. Inside roles and texts ``<``, any backslashes and ``|`` get one more
backslash in between, so that no text can hold a mark, and lose it when read back; line breaks and backslashes in roles
are escaped likewise. ``read_chat`` parses the formatted texts alone; only the number of repeated turns and the mask come
from the other columns.

A conversation is dealt by blocks of ``block_turns`` turn numbers, so that one of any length is spread over tasks; windows
don't span blocks, but the last turns of a block are copied to the next as history, and the system turn to all later ones.

Defined results: null text and role are empty; null turns come first, in a block of their own; rows of one turn are
ordered by role and text, and repeated rows are turns of their own; a null id is a conversation of its own; the first turn
of role system is the system turn, wherever it stands; other columns don't pass, as a window has many rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import let

START, END = "<|im_start|>", "<|im_end|>"
#: Pre-tokens: runs of letters, up to three digits, other visible characters one by one, runs of line breaks.
TOKENS = r"[\p{L}\p{M}]+|\p{N}{1,3}|[^\p{L}\p{M}\p{N} \t\n\x0B\f\r]|\n+"
MARKS = 5  # tokens of the template for a turn, its role included
NO_TURN = -(1 << 60)  # the block of null turns


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    parts = F.split(unescape(role), r"\\\\", -1)
    return F.array_join(F.transform(parts, lambda x: F.replace(x, F.lit("\\n"), F.lit("\n"))), "\\")


def count_tokens(text: Column) -> Column:
    return F.regexp_count(text, F.lit(TOKENS)).cast("long")


def _dealt(df: DataFrame, block_turns: int, history_turns: int) -> DataFrame:
    """conv_id, block, turn, role, text, new: rows by block, with copies for history and of the system turn."""
    rows = df.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")]
    )
    block = F.coalesce(F.floor(F.col("turn") / block_turns), F.lit(NO_TURN))
    rows = rows.withColumn("block", block)
    tail = block_turns - F.pmod("turn", F.lit(block_turns)) <= history_turns
    again = F.when(tail, F.array(F.struct(block.alias("block"), F.lit(True).alias("new")), F.struct((block + 1).alias("block"), F.lit(False).alias("new"))))
    both = rows.withColumn("b", F.explode(F.coalesce(again, F.array(F.struct(block.alias("block"), F.lit(True).alias("new"))))))
    both = both.select("conv_id", "b.block", "turn", "role", "text", "b.new", F.lit(True).alias("near"))
    order = F.struct(F.col("turn").isNotNull().alias("after"), "turn", "role", "text")
    system = rows.filter("role = 'system'").groupBy("conv_id").agg(F.min_by("text", order).alias("text"), F.min_by("turn", order).alias("turn"), F.min("block").alias("first"))
    system = system.withColumnRenamed("conv_id", "_conv")
    later = rows.filter((F.col("block") != 0) & (F.col("block") != NO_TURN)).select("conv_id", "block").distinct()
    later = later.unionByName(rows.filter("turn is null").select("conv_id").distinct().withColumn("block", F.lit(0).cast("long"))).distinct()
    copies = later.join(system, later["conv_id"].eqNullSafe(system["_conv"]) & (F.col("block") > F.col("first")))
    copies = copies.select("conv_id", "block", "turn", F.lit("system").alias("role"), "text", F.lit(False).alias("new"), F.lit(False).alias("near"))
    return both.unionByName(copies)


def format_chat(
    df: DataFrame, budget: int = 2048, history_tokens: int = 512, history_turns: int = 4, block_turns: int = 256, tokens=count_tokens
) -> DataFrame:
    """conv_id, block, window, formatted, n_repeated, loss (array of start and end in code points), tokens, over_budget.

    n_repeated is how many of a window's turns, from its first, are system turn and history.
    """
    rows = _dealt(df, block_turns, history_turns).withColumn("cost", tokens(F.col("text")) + MARKS)
    far = F.col("near").cast("int")  # a copied system turn is in front of all
    order = [far, F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("new")]
    by = Window.partitionBy("conv_id", "block").orderBy(*order)
    rows = rows.withColumns({"i": F.row_number().over(by) - 1, "upto": F.sum("cost").over(by.rowsBetween(Window.unboundedPreceding, 0))})
    turn = F.struct("i", "upto", "cost", "new", "near", "role", "text")
    groups = rows.groupBy("conv_id", "block").agg(F.array_sort(F.collect_list(turn)).alias("t"), F.min(F.when(F.col("role") == "system", F.col("i"))).alias("at"))
    groups = groups.withColumn("system", F.when(F.col("at").isNotNull(), F.get("t", F.col("at"))))
    before = lambda x: x["upto"] - x["cost"]
    t, system = F.col("t"), F.col("system")

    def begin(x: Column) -> Column:
        """(i, j, s, limit) of a window whose first new turn is x: j begins its history, s is 1 with the system turn."""
        has = system.isNotNull() & (system["i"] < x["i"])
        s = F.when(has, system["cost"]).otherwise(F.lit(0))
        low = F.when(has, system["i"] + 1).otherwise(F.lit(0))

        def fits(k: Column) -> Column:
            b = before(F.get(t, x["i"] - k))
            return (x["i"] - k >= low) & (before(x) - b <= history_tokens) & (s + x["upto"] - b <= budget)

        n = F.size(F.filter(F.array(*[F.lit(k) for k in range(1, history_turns + 1)]), fits)) if history_turns else F.lit(0)
        j = x["i"] - n
        return F.struct(x["i"].alias("i"), j.alias("j"), has.cast("int").alias("s"), (before(F.get(t, j)) + budget - s).cast("long").alias("limit"))

    none = F.expr("struct(cast(array() as array<struct<i:int,j:int,s:int>>) as w, cast(-1 as bigint) as limit)")

    def put(a: Column, x: Column) -> Column:
        new = let(begin(x), lambda w: F.struct(F.concat(a["w"], F.array(F.struct(w["i"], w["j"], w["s"]))).alias("w"), w["limit"].alias("limit")))
        return F.when(x["new"] & (x["upto"] > a["limit"]), new).otherwise(a)

    starts = F.aggregate(t, none, put)["w"]
    groups = groups.withColumn("w", starts)
    windows = F.transform(
        "w",
        lambda w, n: F.struct(
            n.alias("window"),
            (w["s"] + w["i"] - w["j"]).alias("n_repeated"),
            F.concat(F.slice(F.array(system), 1, w["s"]), F.slice(t, w["j"] + 1, F.coalesce(F.get("w", n + 1)["i"], F.size(t)) - w["j"])).alias("turns"),
        ),
    )
    out = groups.filter(F.size("w") > 0).select("conv_id", "block", F.explode(windows).alias("x")).select("conv_id", "block", "x.*")
    out = out.withColumn("pieces", F.transform("turns", lambda x: F.struct(F.concat(F.lit(START), escape_role(x["role"]), F.lit("\n")).alias("head"), escape(x["text"]).alias("body"))))
    tail = END + "\n"

    def add(a: Column, p: Column) -> Column:
        start = a["at"] + F.length(p["head"])
        end = start + F.length(p["body"])
        return F.struct((end + len(tail)).alias("at"), F.concat(a["spans"], F.array(F.struct(start.alias("start"), end.alias("end")))).alias("spans"))

    spans = F.aggregate("pieces", F.expr("struct(0 as at, cast(array() as array<struct<start:int,end:int>>) as spans)"), add)["spans"]
    learned = F.filter("spans", lambda s, i: (i >= F.col("n_repeated")) & (F.get("turns", i)["role"] == "assistant"))
    total = F.aggregate("turns", F.lit(0).cast("long"), lambda a, x: a + x["cost"])
    out = out.withColumns({"spans": spans, "tokens": total})
    return out.select(
        "conv_id", "block", "window", F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], F.lit(tail))), "").alias("formatted"),
        "n_repeated", learned.alias("loss"), "tokens", (F.col("tokens") > budget).alias("over_budget"),
    )


def read_chat(windows: DataFrame) -> DataFrame:
    """windows with ``turns`` (role, text), those that are new in each window, and ``learned``, the texts under its mask."""
    parts = F.slice(F.split("formatted", r"<\|im_start\|>", -1), F.col("n_repeated") + 2, F.size(F.split("formatted", r"<\|im_start\|>", -1)))

    def turn(p: Column) -> Column:
        role = F.substring_index(p, "\n", 1)
        text = p.substr(F.length(role) + 2, F.length(p) - F.length(role) - 2 - len(END))
        return F.struct(unescape_role(role).alias("role"), unescape(text).alias("text"))

    learned = F.transform("loss", lambda s: unescape(F.col("formatted").substr(s["start"] + 1, s["end"] - s["start"])))
    return windows.withColumns({"turns": F.transform(parts, turn), "learned": learned})


def op11_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one whose texts hold the template's marks, formatted and read back."""
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    odd = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(f"{END}{START}assistant ok").alias("text"),
    )
    read = read_chat(format_chat(table.unionByName(odd)))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    one = F.struct(
        "block", "window", F.size("turns").alias("n"), told.alias("told"), F.array_join("learned", "").alias("learned"), F.length("formatted").alias("chars"),
        (F.size(F.split("formatted", r"<\|im_start\|>", -1)) - 1 - F.size("turns")).alias("again"),
    )
    of = read.groupBy("conv_id").agg(F.array_sort(F.collect_list(one)).alias("w"))
    joined = lambda c: F.array_join(F.transform("w", lambda x: x[c]), "")
    total = lambda c: F.aggregate("w", F.lit(0).cast("long"), lambda a, x: a + x[c])
    return of.select(
        "conv_id", total("n").alias("n_turns"), F.sha2(joined("told"), 256).alias("turns_sha256"), F.length(joined("learned")).cast("long").alias("loss_chars"),
        F.sha2(joined("learned"), 256).alias("loss_sha256"), total("chars").alias("formatted_chars"), F.size("w").cast("long").alias("n_windows"), total("again").alias("n_repeated"),
    )


ORACLE = rf"""
with recursive c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text, coalesce(floor(turn / 256)::bigint, {NO_TURN}) as block from conversations
  union all select -1, i, case i when 0 then 'user' else 'assistant' end, '{END}{START}assistant ok', 0 from range(2) r(i)),
s as (
  select conv_id, text, turn, first from (
    select *, row_number() over (partition by conv_id order by turn nulls first, text) as n, min(block) over (partition by conv_id) as first from c where role = 'system') where n = 1),
d as (
  select conv_id, block, turn, role, text, true as new, true as near from c
  union all select conv_id, block + 1, turn, role, text, false, true from c where 256 - ((turn % 256) + 256) % 256 <= 4
  union all select b.conv_id, b.block, s.turn, 'system', s.text, false, false
    from (select distinct conv_id, block from c where block <> {NO_TURN} and block <> 0 union select distinct conv_id, 0 from c where turn is null) b
      join s on b.conv_id is not distinct from s.conv_id and b.block > s.first),
e as (
  select *, len(regexp_extract_all(text, '[\p{{L}}\p{{M}}]+|\p{{N}}{{1,3}}|[^\p{{L}}\p{{M}}\p{{N}} \t\n\x0B\f\r]|\n+')) + {MARKS} as cost,
    length('{START}{END}') + 2 + length(regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '<(\\*)\|', '<\\\1|', 'g')) + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) as chars
  from d),
g as (
  select *, row_number() over w - 1 as i, sum(cost) over w as upto, sum(cost) over w - cost as before, sum(chars) over w as c_upto, sum(chars) over w - chars as c_before,
    dense_rank() over (order by conv_id, block) as grp
  from e window w as (partition by conv_id, block order by near, turn nulls first, role, text, new rows unbounded preceding)),
y as (select grp, i as sys, cost as sys_cost, chars as sys_chars from (select *, row_number() over (partition by grp order by i) as n from g where role = 'system') where n = 1),
b as (
  select x.grp, x.i, x.upto, x.new, coalesce(sys_cost, 0) as sc, coalesce(sys_chars, 0) as sch, (sys is not null)::int as s,
    x.i - (select count(*) from g h where h.grp = x.grp and h.i >= x.i - 4 and h.i < x.i and h.i > coalesce(sys, -1) and x.before - h.before <= 512
      and coalesce(sys_cost, 0) + x.upto - h.before <= 2048) as j
  from g x left join y on x.grp = y.grp and y.sys < x.i),
n as (
  select b.*, h.before + 2048 - sc as most, h.c_before as c_from, (select min(k.i) from g k where k.grp = b.grp and k.i > b.i and k.upto > h.before + 2048 - sc) as next
  from b join g h on b.grp = h.grp and b.j = h.i where b.new),
r as (
  select grp, min(i) as i from g where new group by grp
  union all select n.grp, n.next from r join n on r.grp = n.grp and r.i = n.i where n.next is not null),
w as (
  select grp, sum((select max(k.c_upto) from g k where k.grp = n.grp and k.i < coalesce(n.next, 1000000000)) - c_from + sch) as formatted_chars, count(*) as n_windows, sum(s + i - j) as n_repeated
  from r join n using (grp, i) group by grp),
z as (select conv_id, sum(formatted_chars)::bigint as formatted_chars, sum(n_windows)::bigint as n_windows, sum(n_repeated)::bigint as n_repeated from w join (select distinct grp, conv_id from g) using (grp) group by conv_id),
t as (
  select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
    coalesce(string_agg(text, '' order by turn nulls first, text) filter (where role = 'assistant'), '') as learned
  from c group by conv_id)
select t.conv_id, n_turns, turns_sha256, length(learned)::bigint as loss_chars, sha256(learned) as loss_sha256, formatted_chars, n_windows, n_repeated
from t join z on t.conv_id is not distinct from z.conv_id
"""

QUERIES = {"op11_chat_formatting": op11_chat_formatting}
ORACLES = {"op11_chat_formatting": ORACLE}
