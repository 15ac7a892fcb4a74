import hashlib
import time
import re

from pyspark.sql import functions as F

from harborline.llm.pii import KINDS, find_pii
from harborline.llm.queries import op3_pii
from tests.conftest import SF

FORMS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def valid(kind, text):
    digits = re.sub("[^0-9]", "", text)
    if kind == "ip":
        return all(int(p) <= 255 for p in text.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def base_spans(text):
    return [(k, *m.span()) for k, p in FORMS.items() for m in re.finditer(p, text or "") if valid(k, m[0])]


TRICKY = [
    None, "", "a@b.com_x@y.org", "a@b.com.x@y.org", "..@a.b@c.d", "1.2.3.4.5.6.7.8 999.1.1.1 0001.02.255.0", "1.2.3.256",
    "x" * 3000 + "@" + "y" * 3000 + ".z", "4111 1111 1111 1111 and 4111-1111-1111-1112", "+1 (988) 555-2485, +49 30 1234567.",
    "é𝄞 mail ü.a@b.co 𝄞 192.168.0.1", "1" * 5000, "+1 " + " " * 2000 + "x", "4111 1111 1111 1111 0", "a@b", "@", "p@q.r" * 40,
    "+1 212 555 0199 +44 20 7946 0958", "5-5-0-0-0-0-0-0-0-0-0-0-0-0-0-4",
]


def test_base_forms_on_tricky_texts(spark):
    rows = list(enumerate(TRICKY)) + [(None, "q a@b.cd"), (3, TRICKY[3]), (3, TRICKY[3])]
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, kind string, start int")
    got = sorted((str(r.doc_id), sorted((s.kind, s.start, s.end, s.text) for s in r.spans if s.base)) for r in find_pii(frame).collect())
    assert got == sorted((str(i), sorted((k, a, b, t[a:b]) for k, a, b in base_spans(t))) for i, t in rows)


def test_query_digests(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    found = {r.doc_id: r for r in op3_pii(spark, SF).collect()}
    for d in docs:
        spans = base_spans(d.text)
        r = found[d.doc_id]
        assert [r[f"n_{k}"] for k in KINDS] == [sum(s[0] == k for s in spans) for k in KINDS]
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
        assert set(f"{k}:{a}:{b}" for k, a, b in spans) <= set(r.spans.split(","))


def test_contexts_of_seeds_find_unseen_identifiers(spark):
    seeds = [(i, f"order {i} tel: +1 (212) 555-{1000 + i} thanks a lot") for i in range(30)]
    more = [(100, "tel: 212-555-0147 call"), (101, "size 212-555-0148 boxes"), (102, "tel: AB1234567"), (103, "room AB1234567")]
    fillers = [(200 + i, f"size 300-400-{5000 + i} boxes") for i in range(8)]
    frame = spark.createDataFrame(seeds + more + fillers, "doc_id long, text string")
    got = {r.doc_id: [s.text for s in r.spans if not s.base] for r in find_pii(frame).collect()}
    assert got[100] == ["212-555-0147"] and got[102] == ["AB1234567"]
    assert not any(got[i] for i in (101, 103, *range(30), *range(200, 208)))


def test_discoveries_support_further_patterns(spark):
    """Numbers after "tel:" are found beside seeds; they make "ring" a pattern, which finds codes no seed stands beside."""
    seeds = [(i + 500, f"order {i} tel: +1 (212) 555-{1000 + i} thanks") for i in range(400)]
    first = [(100 + i, f"x{i} tel: 300-400-{1000 + i} y{i}") for i in range(40)]
    again = [(200 + i, f"u{i} ring 300-400-{1000 + i} w{i}") for i in range(40)]
    second = [(300, "a0 ring 777-888-1234 b0"), (301, "a1 size 777-888-4321 b1")]
    frame = spark.createDataFrame(seeds + first + again + second, "doc_id long, text string")
    got = {r.doc_id: [s.text for s in r.spans if not s.base] for r in find_pii(frame).collect()}
    assert got[100] == ["300-400-1000"] and got[200] == ["300-400-1000"]
    assert got[300] == ["777-888-1234"] and got[301] == []


def test_many_matches_in_one_text(spark):
    """A log-like text of 100,000 addresses takes seconds: windows run once over its matches."""
    text = " ".join(f"u{i}@h{i % 97}.example.org 10.{i % 256}.0.1" for i in range(50_000))
    start = time.time()
    (row,) = find_pii(spark.createDataFrame([(1, text)], "doc_id long, text string")).select(F.size("spans").alias("n")).collect()
    assert row.n == 100_000 and time.time() - start < 60


def test_empty_table(spark):
    assert find_pii(spark.createDataFrame([], "doc_id long, text string")).count() == 0
