"""Personal data in text (operator 9), in DataFrame functions only.

For each kind a regular expression proposes spans, leftmost and not overlapping; a validator confirms them (octets of an
address, Luhn for cards, digit counts of phones, mod-97 and length for IBANs), failing matches are dropped without
another try; words just before a span raise its score. Positions come from the lengths of the parts between matches.

Patterns are written so that no text takes more than linear time: a run of characters is entered at its start or where
the last match ended (``\\G``), and repeats without a choice are possessive. They match what the plain forms match.

Besides the base kinds (email, ip, card, phone) it finds ``iban`` and ``secret`` (a named credential with its value).

Positions and redacted texts are put together in chunks, so that a text of very many spans takes time in proportion.

Defined results: null text has no spans (``redact`` leaves it null); texts
of any length are searched as a whole; an empty table gives no rows; rows are handled one by one, so repeated rows repeat;
all other columns pass through, unless they bear a name of the result.
"""

from __future__ import annotations

from dataclasses import dataclass
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let

# IBAN lengths by country.
IBAN_LENGTHS = {
    "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18,
    "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IT": 27, "LT": 20, "LU": 20, "LV": 21, "MT": 31,
    "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SE": 24, "SI": 19, "SK": 24,
}
BASE = ["email", "ip", "card", "phone"]
RESULT = ["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_iban", "n_secret", "mean_score"]


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def octets(m: Column) -> Column:
    def small(part: Column) -> Column:
        value = F.ltrim(part, F.lit("0"))
        return (F.length(value) <= 3) & (F.coalesce(value.try_cast("int"), F.lit(0)) <= 255)

    return F.forall(F.split(m, r"\."), small)


def luhn(m: Column) -> Column:
    """13 to 19 digits; from the right every second one doubled, its digits added, the total divisible by 10."""
    digits = F.reverse(_digits(m))
    n = F.length(digits)

    def value(i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return F.when(d > 9, d - 9).otherwise(d)

    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda a, i: a + value(i))
    return F.when(n.between(13, 19), total % 10 == 0).otherwise(False)


def phone_digits(m: Column) -> Column:
    return F.length(_digits(m)).between(9, 15)


def mod97(m: Column) -> Column:
    """The country's length, and 1 as remainder of the rearranged number by 97."""
    plain = F.replace(m, F.lit(" "), F.lit(""))
    moved = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))

    def step(a: Column, i: Column) -> Column:
        code = F.ascii(F.substring(moved, i, F.lit(1)))
        return F.when(code < 65, (a * 10 + code - 48) % 97).otherwise((a * 100 + code - 55) % 97)

    known = F.lit(False)
    for country, n in IBAN_LENGTHS.items():
        known = known | ((F.substring(plain, 1, 2) == country) & (F.length(plain) == n))
    return known & (F.aggregate(F.sequence(F.lit(1), F.length(moved)), F.lit(0), step) == 1)


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    valid: Callable[[Column], Column] | None
    score: float
    context: str


KINDS = [
    Kind(
        "email",
        r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        None,
        0.9,
        "mail|contact|write|address",
    ),
    Kind("ip", r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)", octets, 0.6, r"\bip\b|host|server|addr"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", luhn, 0.6, "card|visa|credit|pay|account"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", phone_digits, 0.7, "phone|tel|call|mobile|fax"),
    Kind("iban", r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?", mod97, 0.9, "iban|bank|account|konto|compte"),
    Kind(
        "secret",
        r"(?i:token|secret|api[_-]?key|password|passwd)[\x22']?[ \t]*[:=][ \t]*[\x22'][A-Za-z0-9+/_.=-]{12,}[\x22']",
        None,
        0.8,
        "auth|login|key|config",
    ),
]


def chunked(items: Column, n: int) -> Column:
    """An array cut into arrays of n items."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / n).cast("int")), lambda i: F.slice(items, i * n + 1, F.lit(n)))


def running(items: Column, fn: Callable[[Column, Column], Column], combine: Callable[[Column, Column], Column]) -> Column:
    """The state before each item of a non-empty array, from 0 on; two levels keep the time all but linear."""
    none = F.array().cast("array<int>")

    def grow(step: Callable[[Column, Column], Column]) -> Callable[[Column, Column], Column]:
        return lambda a, x: F.struct(step(a["now"], x).alias("now"), F.array_append(a["at"], a["now"]).alias("at"))

    def placed(chunks: Column) -> Column:
        totals = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), fn))
        before = F.aggregate(totals, F.struct(F.lit(0).alias("now"), none.alias("at")), grow(combine))["at"]
        own = F.zip_with(chunks, before, lambda c, b: F.aggregate(c, F.struct(b.alias("now"), none.alias("at")), grow(fn))["at"])
        return F.flatten(own)

    return let(items, lambda x: let(chunked(x, 128), placed))


def spans(text: Column, matches: Column, kind: Kind) -> Column:
    """Array of (kind, start, end, score) of a kind's valid matches; code points, end exclusive.

    The context of a span are the 40 characters before it. They lie in the part before it and in the eight matches and
    parts before that at most, since no match is shorter than five characters.
    """
    gaps = F.slice(F.split(text, kind.pattern, -1), F.lit(1), F.size(matches))
    sized = F.zip_with(gaps, matches, lambda g, m: F.struct(g.alias("gap"), m.alias("t"), F.length(g).alias("g"), F.length(m).alias("m")))

    def placed(parts: Column) -> Column:
        before = running(parts, lambda a, x: a + x["g"] + x["m"], lambda a, b: a + b)
        numbered = F.transform(parts, lambda x, i: F.struct(x["t"].alias("t"), x["gap"].alias("gap"), x["g"].alias("g"), x["m"].alias("m"), i.alias("i")))
        found = F.zip_with(numbered, before, lambda x, b: F.struct(x["t"].alias("t"), x["gap"].alias("gap"), x["i"].alias("i"), (b + x["g"]).alias("s"), (b + x["g"] + x["m"]).alias("e")))
        if kind.valid:
            found = F.filter(found, lambda x: kind.valid(x["t"]))

        def scored(x: Column) -> Column:
            earlier = F.slice(parts, F.greatest(x["i"] - 7, F.lit(1)), F.least(x["i"], F.lit(8)))
            earlier = F.transform(earlier, lambda y: F.concat(F.right(y["gap"], F.lit(40)), F.right(y["t"], F.lit(40))))
            near = F.right(F.concat(F.array_join(earlier, ""), F.right(x["gap"], F.lit(40))), F.lit(40))
            score = F.when(F.lower(near).rlike(kind.context), min(1.0, kind.score + 0.2)).otherwise(kind.score)
            return F.struct(F.lit(kind.name).alias("kind"), x["s"].alias("start"), x["e"].alias("end"), score.alias("score"))

        return F.transform(found, scored)

    none = F.array().cast("array<struct<kind:string,start:int,end:int,score:double>>")
    return F.when(F.size(matches) > 0, let(sized, placed)).otherwise(none)


def find_pii(docs: DataFrame, kinds: list[Kind] = KINDS, column: str = "pii") -> DataFrame:
    """docs with an array of (kind, start, end, score), in the order of kinds, then of start."""
    text = F.coalesce(F.col("text"), F.lit(""))
    matched = docs.drop(column).withColumns(
        {f"_m_{k.name}": F.regexp_extract_all(text, F.lit(k.pattern), F.lit(0)) for k in kinds}
    )
    found = F.concat(*[spans(text, F.col(f"_m_{k.name}"), k) for k in kinds])
    return matched.withColumn(column, found).drop(*[f"_m_{k.name}" for k in kinds])


def redact(docs: DataFrame, kinds: list[Kind] = KINDS) -> DataFrame:
    """docs with each span (overlapping ones as one) of its text replaced by its kind in brackets."""
    found = find_pii(docs, kinds, "_pii")
    ordered = F.array_sort(F.transform("_pii", lambda x: F.struct(x["start"], x["end"], x["kind"])))
    text = F.col("text")

    def tagged(part: Column, at: Column, x: Column) -> Column:
        """What lies before a span since the end of those before it, cut from a part of the text, and the span's tag."""
        tag = F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]"))
        return F.concat(F.substring(part, x["to"] - at + 1, x["start"] - x["to"]), tag)

    def cut(part: Column, at: Column, some: Column, sizes: list[int]) -> Column:
        """The tagged text of some spans. Each level cuts its part out once, so that no span reads from the text's start."""
        if not sizes:
            return F.array_join(F.transform(some, lambda x: tagged(part, at, x)), "")

        def inner(c: Column) -> Column:
            start = c[0]["to"]
            own = F.substring(part, start - at + 1, F.element_at(c, -1)["start"] - start)
            return let(own, lambda own: cut(own, start, c, sizes[1:]))

        return F.array_join(F.transform(chunked(some, sizes[0]), inner), "")

    def whole(found: Column) -> Column:
        before = running(found, lambda a, x: F.greatest(a, x["end"]), F.greatest)
        kept = F.zip_with(found, before, lambda x, b: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), b.alias("to")))
        kept = F.filter(kept, lambda x: x["start"] >= x["to"])
        tail = F.substring(text, F.array_max(F.transform(found, lambda x: x["end"])) + 1, F.length(text))
        return F.concat(let(kept, lambda kept: cut(text, F.lit(0), kept, [4096, 64])), tail)

    new = F.when(F.size("_pii") > 0, let(ordered, whole)).otherwise(text)
    return found.withColumn("text", new).select(docs.columns)


def listed(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def report(docs: DataFrame) -> DataFrame:
    """docs with the columns of RESULT."""
    found = find_pii(docs.drop(*RESULT), column="_found")

    def n(name: str) -> Column:
        return F.size(F.filter("_found", lambda x: x["kind"] == name)).cast("long")

    base = F.filter("_found", lambda x: x["kind"].isin(BASE))
    total = F.aggregate("_found", F.lit(0.0), lambda a, x: a + x["score"])
    return found.withColumns(
        {f"n_{k.name}": n(k.name) for k in KINDS}
        | {
            "base_sha256": F.sha2(listed(base), 256),
            "spans": listed(F.col("_found")),
            "mean_score": F.round(F.try_divide(total, F.size("_found")), 6),
        }
    ).drop("_found")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in every document."""
    return report(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).select("doc_id", *RESULT)


_PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"[A-Z]{2}[0-9]{2}( ?[A-Z0-9]{4}){2,7}( ?[A-Z0-9]{1,3})?",
    "secret": r"(?i:token|secret|api[_-]?key|password|passwd)[\x22\x27]?[ \t]*[:=][ \t]*[\x22\x27][A-Za-z0-9+/_.=-]{12,}[\x22\x27]",
}
_D = "regexp_replace(m, '[^0-9]', '', 'g')"
_P = "replace(m, ' ', '')"
_LENGTHS = " or ".join(f"({_P}[1:2] = '{c}' and length({_P}) = {n})" for c, n in IBAN_LENGTHS.items())
_MOD = (
    f"list_reduce(list_prepend(0, list_transform(string_split({_P}[5:] || {_P}[1:4], ''), lambda c: ascii(c)::int)), "
    "lambda a, c: case when c < 65 then (a * 10 + c - 48) % 97 else (a * 100 + c - 55) % 97 end) = 1"
)
_VALID = {
    "email": "true",
    "ip": r"len(list_filter(string_split(m, '.'), lambda p: length(ltrim(p, '0')) > 3 or coalesce(try_cast(ltrim(p, '0') as bigint), 0) > 255)) = 0",
    "card": f"length({_D}) between 13 and 19 and list_sum(list_transform(string_split(reverse({_D}), ''), lambda c, i: "
    "case when i % 2 = 0 then case when c::int * 2 > 9 then c::int * 2 - 9 else c::int * 2 end else c::int end)) % 10 = 0",
    "phone": f"length({_D}) between 9 and 15",
    "iban": f"({_LENGTHS}) and {_MOD}",
    "secret": "true",
}


def _kind_sql(i: int, k: Kind) -> str:
    p = _PLAIN[k.name]
    near = k.context.replace("'", "''")
    return rf"""
k{i} as (
  select r, {i} as o, '{k.name}' as kind, s, s + length(m) as e,
    case when regexp_matches(lower(substr(t, greatest(s - 40, 0) + 1, s - greatest(s - 40, 0))), '{near}')
      then {min(1.0, k.score + 0.2)} else {k.score} end as score
  from (
    select r, t, m, (sum(length(g) + length(m)) over (partition by r order by i) - length(m))::bigint as s from (
      select r, t, i, regexp_extract_all(t, '{p}')[i] as m, regexp_split_to_array(t, '{p}')[i] as g
      from (select r, t, unnest(generate_series(1, len(regexp_extract_all(t, '{p}')))) as i from d
        where regexp_matches(t, '{p}'))))
  where {_VALID[k.name]})"""


ORACLE = f"""
with d as (select doc_id, coalesce(text, '') as t, row_number() over () as r from documents),
{",".join(_kind_sql(i, k) for i, k in enumerate(KINDS))},
a as ({" union all ".join(f"select * from k{i}" for i in range(len(KINDS)))}),
g as (
  select r, {", ".join(f"count(*) filter (kind = '{k.name}') as n_{k.name}" for k in KINDS)},
    string_agg(kind || ':' || s || ':' || e, ',' order by o, s) filter (o < {len(BASE)}) as base,
    string_agg(kind || ':' || s || ':' || e, ',' order by o, s) as spans, round(avg(score), 6) as mean_score
  from a group by r)
select doc_id, {", ".join(f"coalesce(n_{k.name}, 0)::bigint as n_{k.name}" for k in KINDS)},
  sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans, mean_score::double as mean_score
from d left join g using (r)
"""

QUERIES = {"op9_pii": op9_pii}
ORACLES = {"op9_pii": ORACLE}
