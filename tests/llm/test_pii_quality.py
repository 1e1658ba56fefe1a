import hashlib
import re
import time

from featurespark.llm.pii import _PLAIN, BASE, KINDS, find_pii, redact, report
from featurespark.llm.quality import quality

CARD = "4539 1488-0343 6467"


def luhn(d):
    x = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(d))]
    return 13 <= len(d) <= 19 and sum(v - 9 * (v > 9) for v in x) % 10 == 0


def base_spans(text):
    out = []
    for kind in ("email", "ip", "card", "phone"):
        for m in re.finditer(_PLAIN[kind], text):
            d = re.sub("[^0-9]", "", m[0])
            ok = {
                "email": lambda: True,
                "ip": lambda: all(int(p) <= 255 for p in m[0].split(".")),
                "card": lambda: luhn(d),
                "phone": lambda: 9 <= len(d) <= 15,
            }[kind]()
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


TEXTS = [
    "a@b.c_d@e.f x@y@z.com a@b..c é@q.de ..@-.- \U0001f600 u.v+w%1@mail-3.ex.co.uk.",
    "1.2.3.4.5.6.7.8 256.1.1.1 007.0.0.255 9999999999999999999999.1.1.1 1.2.3 00000000000000255.1.1.1",
    f"card {CARD}, {CARD[:-1]}8 4539148803436467  5 45391488034364674539148803436467 0000000000000",
    "+1 (017) 555-7713 +12 +1 ( +49.30/1 +123456789012345 +1234567890123456 ++44 20 7946 0958",
    "iban DE89 3704 0044 0532 0130 00 and GB82WEST12345698765432 DE88370400440532013000",
    'api_key = "0123456789abcdef" token: \'x\' PASSWORD="longenoughsecret1"',
    "",
    None,
    "1" * 60000 + " " + "a." * 40000 + "@",
    "1.1.1.1 " * 300 + "\n" + "x" * 50000,
]


def test_base_spans_equal_plain_patterns(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as spans", "2 as other")
    for r in report(df).collect():
        want = base_spans(TEXTS[r.doc_id] or "")
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [x for x in r.spans.split(",") if x and x.split(":")[0] not in ("iban", "secret")] == want
        assert r.n_ip == sum(x.startswith("ip:") for x in want) and r.other == 2
    got = {r.doc_id: r for r in report(df).collect()}
    assert got[4].n_iban == 2 and got[5].n_secret == 2
    assert report(df.limit(0)).count() == 0


def test_context_raises_the_score(spark):
    df = spark.createDataFrame([(1, "host 1.2.3.4"), (2, "see 1.2.3.4")], "doc_id long, text string")
    a, b = (r.pii[0]["score"] for r in find_pii(df).orderBy("doc_id").collect())
    assert a > b


def test_redaction(spark):
    df = spark.createDataFrame([(1, f"é x@y.com! {CARD} +1 (017) 555-7713"), (2, None), (3, "clean")], "doc_id long, text string")
    rows = [r.text for r in redact(df).orderBy("doc_id").collect()]
    assert rows == ["é [EMAIL]! [CARD] [PHONE]", None, "clean"]


def test_many_spans_take_time_in_proportion(spark):
    took, n = [], 4000
    for size in (n, n, 4 * n):
        text = " ".join(f"write {i}@b.com, 1.2.3.{i % 256}" for i in range(size))
        df = spark.createDataFrame([(1, text)], "doc_id long, text string")
        began = time.perf_counter()
        found, clean = report(df).first(), redact(df).first().text
        took.append(time.perf_counter() - began)
        assert (found.n_email, found.n_ip) == (size, size)
        assert clean == " ".join(["write [EMAIL], [IP]"] * size)
    assert took[2] < 10 * took[1]


def test_spans_equal_brute_force_over_chunks(spark, rng):
    texts = []
    for _ in range(40):
        some = ["a@b.cc", "1.2.3.4", "+49 170 1234567", "4111 1111 1111 1111", "word", "mail", "é", "host 9.9.9.9", "x1@y.zz@q.org"]
        texts.append(rng.choice(["", " "]).join(rng.choice(some) + rng.choice([" ", ", ", "\n"]) for _ in range(rng.randrange(700))))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found, context = {}, {k.name: k for k in KINDS}
    for r in find_pii(df).collect():
        text, found[r.doc_id] = texts[r.doc_id], r.pii
        assert [f"{x.kind}:{x.start}:{x.end}" for x in r.pii if x.kind in BASE] == base_spans(text)
        for x in r.pii:
            near = re.search(context[x.kind].context, text[max(0, x.start - 40) : x.start].lower())
            assert (x.score > context[x.kind].score) == bool(near)
    for r in redact(df).collect():
        text, want, to = texts[r.doc_id], [], 0
        for start, end, kind in sorted((x.start, x.end, x.kind) for x in found[r.doc_id]):
            if start >= to:
                want.append(text[to:start] + f"[{kind.upper()}]")
            to = max(to, end)
        assert r.text == "".join(want) + text[to:]


def brute_quality(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen, hit = {}, set()
    for i in range(len(w) - 7):
        seen.setdefault(tuple(w[i : i + 8]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            hit.update(p for i in at for p in range(i, i + 8))
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    failed = len(w) < 20 or 100 * len(hit) > 30 * len(w)
    return (len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(hit), failed)


def test_quality_measures_equal_brute_force(spark, rng):
    texts = [None, "", " \n\t ", "a b", "x " * 9000, "#$%\n#$%\n\n a b \x0b c\x0cd \r\n#$%", "\U0001f600 é\U0001f600"]
    for _ in range(40):
        words = rng.choices(["the", "a", "é!", "B", "c", "<d>"], k=rng.randrange(120))
        at = rng.randrange(len(words) + 1)
        texts.append(rng.choice([" ", "\n"]).join(words + words[at : at + 12]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "9 as n_words", "1 as _w")
    rows = quality(df).collect()
    for r in rows:
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
        assert got == brute_quality(texts[r.doc_id]), texts[r.doc_id]
        assert not (r.kept and r.base_failed)
    assert len(rows) == len(texts) and quality(df.limit(0)).count() == 0
