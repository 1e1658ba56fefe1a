"""Quality rules as one projection (operator 7), in DataFrame functions only.

A table of (name, measure, least, most) is compiled into one Spark projection: measures of length, symbols, stop words and
lines become columns, and ``kept`` is the conjunction of all bounds. No user function and no shuffle; every array holds
numbers or words of one text.

Repeated words: each window of ``window`` words is hashed in place (two independent 64- and 32-bit hashes of the words),
windows are sorted within the text, and neighbours of equal hash mark their starts; the words covered by marked windows
are counted once each.

Defined results: null and empty text has zero in all measures, fails the word bound and is not kept; rows are judged one
by one, so repeated rows repeat; other columns pass through ``quality`` unless they bear a name of its result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let

SPACE = " \t\n\x0b\f\r"
# Function words of English, French, German and Spanish.
STOP_WORDS = (
    "the a an and or of to in is are was be that this it for with as on at by from not have has but they you we he she "
    "le la les un une des de du et est en que qui dans pour pas sur au aux par avec ce il elle nous vous sont "
    "der die das ein eine und ist nicht von zu mit für auf den dem im sich auch als an es werden aus bei "
    "el los las una unos y es del por con para no se lo como más su al son"
).split()

#: (name, measure, least, most): a text is kept if all measures lie between their bounds; None is no bound.
RULES = [
    ("length", "n_words", 20, 1_000_000),
    ("mean_word_chars", "word_chars / n_words", 2.0, 16.0),
    ("symbols", "n_symbols / n_words", None, 0.3),
    ("stop_words", "n_stop_words / n_words", 0.01, 0.9),
    ("duplicate_lines", "n_dup_lines / n_lines", None, 0.5),
    ("repeated_words", "n_repeat_words / n_words", None, 0.3),
    ("alphabetic", "n_letter_chars / word_chars", 0.5, None),
    ("upper_case", "n_upper_chars / n_letter_chars", None, 0.6),
    ("bullet_lines", "n_bullet_lines / n_lines", None, 0.9),
]
MEASURES = [
    "n_words",
    "word_chars",
    "n_symbols",
    "n_dup_lines",
    "n_repeat_words",
    "n_lines",
    "n_stop_words",
    "n_letter_chars",
    "n_upper_chars",
    "n_bullet_lines",
]


def repeated_words(words: Column, window: int) -> Column:
    """How many words lie in windows that occur at least twice in the array."""
    n = F.size(words) - window + 1
    starts = F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1)

    def gram(i: Column) -> Column:
        return F.slice(words, i + 1, window)

    def covered(grams: Column) -> Column:
        ordered = F.array_sort(F.transform(grams, lambda h, i: F.struct(h.alias("h"), F.hash(gram(i)).alias("g"), i.alias("i"))))

        def marks(s: Column) -> Column:
            def same(a: Column, b: Column) -> Column:
                return (a["h"] == b["h"]) & (a["g"] == b["g"])

            twice = F.filter(
                s, lambda x, i: F.coalesce(same(F.get(s, i - 1), x), F.lit(False)) | F.coalesce(same(F.get(s, i + 1), x), F.lit(False))
            )
            return F.array_sort(F.transform(twice, lambda x: x["i"]))

        def total(at: Column) -> Column:
            return F.aggregate(
                at,
                F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")),
                lambda a, i: F.struct(
                    (a["n"] + i + window - F.greatest(i, a["to"])).alias("n"), (i + window).alias("to")
                ),
            )["n"]

        repeats = F.size(F.array_distinct(grams)) < F.size(grams)
        return F.when(repeats, let(let(ordered, marks), total)).otherwise(0)

    hashed = F.transform(starts, lambda i: F.xxhash64(gram(i)))
    return F.when(n >= 2, let(hashed, covered)).otherwise(0)


def measures(docs: DataFrame, window: int) -> DataFrame:
    """docs with the columns of MEASURES."""
    text = F.coalesce(F.col("text"), F.lit(""))
    one = docs.drop(*MEASURES).withColumns(
        {
            "_words": F.filter(F.split(text, f"[{SPACE}]+"), lambda w: w != ""),
            "_letters": F.split(text, r"[^\p{L}]+"),
            "_lines": F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE}]")),
        }
    )
    stop = F.filter("_letters", lambda w: (F.octet_length(w) < 10) & F.lower(w).isin(sorted(set(STOP_WORDS))))
    symbols = F.length(text) - F.length(F.regexp_replace(text, "[#*$%&|<>]", ""))
    return one.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(F.array_join("_words", "")).cast("long"),
            "n_symbols": symbols.cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": repeated_words(F.col("_words"), window).cast("long"),
            "n_lines": F.size("_lines").cast("long"),
            "n_stop_words": F.size(stop).cast("long"),
            "n_letter_chars": F.length(F.array_join("_letters", "")).cast("long"),
            "n_upper_chars": F.length(F.regexp_replace(text, r"[^\p{Lu}]+", "")).cast("long"),
            "n_bullet_lines": F.size(F.filter("_lines", lambda x: F.ltrim(x).rlike(r"^[-*•+] "))).cast("long"),
        }
    ).drop("_words", "_letters", "_lines")


def within(rules: list[tuple]) -> Column:
    """All bounds as one condition; a ratio with a zero denominator is 0."""
    held = F.lit(True)
    for _, measure, least, most in rules:
        top, _, below = (x.strip() for x in measure.partition("/"))
        value = F.coalesce(F.try_divide(F.col(top), F.col(below)), F.lit(0.0)) if below else F.col(top)
        for bound, holds in ((least, lambda v, b: v >= b), (most, lambda v, b: v <= b)):
            if bound is not None:
                held = held & holds(value, F.lit(bound))
    return held


def quality(docs: DataFrame, rules: list[tuple] = RULES, window: int = 8, least_words: int = 20, most_repeated: int = 30) -> DataFrame:
    """docs with the measures, base_failed (too few words or too many repeated ones) and kept."""
    measured = measures(docs.drop("base_failed", "kept"), window)
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    return measured.withColumns({"base_failed": failed, "kept": ~failed & within(rules)})


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict for every document."""
    out = quality(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", *MEASURES[:5], "base_failed", "kept", *MEASURES[5:])


_STOP_SQL = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))


def _rule_sql(measure: str, least: float | None, most: float | None) -> str:
    top, _, below = (x.strip() for x in measure.partition("/"))
    value = f"coalesce({top}::double / nullif({below}, 0), 0)" if below else top
    return " and ".join([f"{value} >= {least}"] * (least is not None) + [f"{value} <= {most}"] * (most is not None))


ORACLE = rf"""
with d as (
  select doc_id, coalesce(text, '') as t, row_number() over () as r from documents),
s as (
  select *, list_filter(regexp_split_to_array(t, '[ \t\n\x0B\f\r]+'), lambda w: w <> '') as ws,
    list_filter(string_split(t, chr(10)), lambda x: length(regexp_replace(x, '[ \t\n\x0B\f\r]+', '', 'g')) > 0) as ls
  from d),
w as (
  select r, i, ws[i : i + 7] as win from
    (select r, ws, unnest(generate_series(1, len(ws) - 7)) as i from s where len(ws) >= 9)),
g as (select r, i from (select r, i, count(*) over (partition by r, win) as n from w) where n > 1),
c as (
  select r, sum(least(8, coalesce(nxt - i, 8))) as n_repeat_words
  from (select r, i, lead(i) over (partition by r order by i) as nxt from g) group by r),
m as (
  select doc_id, len(ws)::bigint as n_words, length(regexp_replace(t, '[ \t\n\x0B\f\r]+', '', 'g'))::bigint as word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::bigint as n_symbols,
    (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines,
    coalesce(n_repeat_words, 0)::bigint as n_repeat_words, len(ls)::bigint as n_lines,
    len(list_filter(regexp_split_to_array(t, '[^\p{{L}}]+'), lambda w: lower(w) in ({_STOP_SQL})))::bigint as n_stop_words,
    length(regexp_replace(t, '[^\p{{L}}]+', '', 'g'))::bigint as n_letter_chars,
    length(regexp_replace(t, '[^\p{{Lu}}]+', '', 'g'))::bigint as n_upper_chars,
    len(list_filter(ls, lambda x: regexp_matches(ltrim(x), '^[-*•+] ')))::bigint as n_bullet_lines
  from s left join c using (r)),
b as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from m)
select *, not base_failed and {" and ".join(_rule_sql(*r[1:]) for r in RULES)} as kept from b
"""

QUERIES = {"op7_quality_rules": op7_quality_rules}
ORACLES = {"op7_quality_rules": ORACLE}
