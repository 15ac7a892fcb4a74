"""URL rules against plain regular expressions and string functions."""

import random
import re

import pyarrow as pa
import pytest

from harborline.llm import url_filter
from harborline.session import literal_table

URLS = [
    None, "", "no scheme", "://", "http://", "http://net", "http://net/", "http://a.NET/x", "http://notnet/x", "http://x.net:80/",
    "http://example.net/en/", "http://m.example.net/en/1?q=/en/", "http://example.net/EN/", "http://badexample.net/en/x#y",
    "https://example.com/de/", "https://example.com/de", "https://a.org/fr/x", "https://a.org?u=/fr/", "https://b.org#/fr/",
    "http://spam-farm.example.org/en/1", "http://www.cheap-pills.example.com", "http://www.cheap-pills.example.com/a/b",
    "ftp://x://y.net/a", "HTTP://U@Host.net/é/ü", "http://é.example.com/a.exe", "http://a.com/" + "x" * 300_000 + ".zip",
    "http://" + "a." * 50_000 + "net/", "http://a.com/x\ny.exe", "http://k.edu/casino", "http://" + "İ" + ".net/",
]


def plain(pattern: str) -> re.Pattern:
    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**", i):
            out, i = out + "(?s:.*)", i + 2
        elif pattern[i] in "*?":
            out, i = out + ("[^/]*" if pattern[i] == "*" else "[^/]"), i + 1
        else:
            i += pattern[i] == "\\" and i + 1 < len(pattern)
            out, i = out + re.escape(pattern[i]), i + 1
    return re.compile(out)


def expected(url, rules=url_filter.RULES, patterns=url_filter.PATTERNS):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    raw = re.match(r"[^/?#]*", rest)[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in raw)
    path = re.match(r"[^?#]*", rest[len(raw):])[0]
    fits = [(v, h + p) for v, h, p in rules if ("." + host).endswith("." + h) and path.startswith(p)]
    if fits:
        verdict, rule = max(fits, key=lambda f: len(f[1]))
        return host, path, rule, verdict
    hits = [(v, p) for v, p in patterns if plain(p).fullmatch("." + host + path)]
    return host, path, None, max(hits, key=lambda h: len(h[1]))[0] if hits else "allow"


def test_rules_and_patterns_on_odd_urls(spark):
    rows = literal_table(spark, [(i, u, "x") for i, u in enumerate(URLS)], "page_id bigint, url string, verdict string")
    found = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(rows).collect()}
    assert found == {i: expected(u) for i, u in enumerate(URLS)}
    assert url_filter.judge(rows.limit(0)).count() == 0
    assert url_filter.judge(rows.union(rows)).count() == 2 * len(URLS)


@pytest.mark.parametrize("seed", range(4))
def test_automaton_equals_regular_expressions(seed):
    draw = random.Random(seed)
    word = lambda letters, most: "".join(draw.choice(letters) for _ in range(draw.randint(0, most)))
    patterns = tuple(word("ab/.é*?\\", 40 if seed % 2 else 8) for _ in range(60))
    texts = [word("ab/.é€", 30) for _ in range(400)]
    found = url_filter.first_matches(pa.array(texts), patterns)
    compiled = [plain(p) for p in patterns]
    assert found.tolist() == [next((k for k, p in enumerate(compiled) if p.fullmatch(t)), -1) for t in texts]


def test_many_patterns_cross_words(spark):
    patterns = [("block", f"*.host{i}.example/**") for i in range(500)]
    rows = literal_table(spark, [(i, f"http://a.host{i}.example/x") for i in range(600)], "page_id int, url string")
    found = {r.page_id: r.verdict for r in url_filter.judge(rows, (), patterns).collect()}
    assert found == {i: "block" if i < 500 else "allow" for i in range(600)}
