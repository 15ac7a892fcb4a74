"""URL rules as one bit-parallel automaton: every pattern is a run of bits, one step per byte moves them all."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harborline.llm.textio import byte_chunks

#: (verdict, host, path): a rule fits its host and all hosts below it, where the path starts with the rule's.
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
#: (verdict, pattern) for pages that no rule fits, over ``.host/path``; without a match a page is allowed.
PATTERNS = (
    ("block", "*spam**"),
    ("block", "*.cheap-*"),
    ("block", "*.cheap-*/**"),
    ("block", "*casino**"),
    ("allow", "*.edu/**"),
    ("block", "**.exe"),
    ("block", "**.zip"),
)
ALLOWED = "allow"
#: Bytes of automaton state and match flags per block of urls.
BLOCK_BYTES = 1 << 24
#: Below this many urls of a block that are still running, each goes on as one long integer.
FEW_LANES = 16

_BYTES = np.arange(256)
_FOLLOWS = (_BYTES >= 0x80) & (_BYTES < 0xC0)
_ANY = np.ones(256, bool)
_NO_SLASH = _BYTES != ord("/")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def escaped(text: str) -> str:
    return "".join("\\" + c if c in "*?\\" else c for c in text)


def rule_pattern(host: str, path: str) -> str:
    """The pattern over ``.host/path`` that a rule stands for."""
    return f"*.{escaped(host)}{escaped(path)}**"


def steps(pattern: str) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Per state the bytes that lead into it and those that it stays on; state 0 is the start.

    ``*`` is any run of characters but ``/``, ``**`` any run at all, ``?`` one character but ``/``;
    a backslash takes the next character as it is.  A character beyond one byte is entered by its
    first byte and stayed in on the others.
    """
    none = np.zeros(256, bool)
    enter, stay = [none], [none]
    i = 0
    while i < len(pattern):
        if pattern.startswith("**", i):
            stay[-1] = _ANY
            i += 2
            continue
        if pattern[i] == "*":
            stay[-1] = stay[-1] | _NO_SLASH
            i += 1
            continue
        if pattern[i] == "?":
            enter.append(_NO_SLASH & ~_FOLLOWS)
            stay.append(_FOLLOWS)
            i += 1
            continue
        i += pattern[i] == "\\" and i + 1 < len(pattern)
        for byte in pattern[i].encode():
            enter.append(_BYTES == byte)
            stay.append(none)
        i += 1
    return enter, stay


@dataclass(frozen=True)
class Automaton:
    """All patterns side by side: masks per byte, start bits, and the place of each pattern's last bit."""

    enter: np.ndarray
    stay: np.ndarray
    start: np.ndarray
    last: np.ndarray

    def integers(self) -> tuple[list[int], list[int], int]:
        whole = lambda words: int.from_bytes(words.astype("<u8").tobytes(), "little")
        return [whole(w) for w in self.enter], [whole(w) for w in self.stay], whole(self.start)


@lru_cache(maxsize=8)
def automaton(patterns: tuple[str, ...]) -> Automaton:
    enter, stay, first, last = [], [], [], []
    for pattern in patterns:
        into, on = steps(pattern)
        first.append(len(enter))
        enter += into
        stay += on
        last.append(len(enter) - 1)
    width = -(-max(len(enter), 1) // 64) * 64

    def words(bits: np.ndarray) -> np.ndarray:
        return np.packbits(bits, axis=-1, bitorder="little").view("<u8").astype(np.uint64)

    table = np.zeros((2, 256, width), bool)
    for place, (into, on) in enumerate(zip(enter, stay)):
        table[0, :, place], table[1, :, place] = into, on
    begin = np.zeros(width, bool)
    begin[first] = True
    return Automaton(words(table[0]), words(table[1]), words(begin), np.array(last, np.int64))


def run(machine: Automaton, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """State words after each text of a run of texts."""
    lengths = np.diff(offsets)
    order = np.argsort(-lengths, kind="stable")
    state = np.repeat(machine.start[None, :], len(lengths), axis=0)
    begins, left = offsets[:-1][order], lengths[order]
    place = 0
    while True:
        live = int(np.searchsorted(-left, -place, "left"))  # texts longer than place come first
        if live < FEW_LANES:
            break
        byte = data[begins[:live] + place]
        now = state[:live]
        moved = now << np.uint64(1)
        moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
        state[:live] = (moved & machine.enter[byte]) | (now & machine.stay[byte])
        place += 1
    if live:
        enter, stay, _ = machine.integers()
        width = state.shape[1] * 8
        for lane in range(live):
            bits = int.from_bytes(state[lane].astype("<u8").tobytes(), "little")
            for byte in data[begins[lane] + place : begins[lane] + left[lane]].tobytes():
                bits = (bits << 1) & enter[byte] | bits & stay[byte]
            state[lane] = np.frombuffer(bits.to_bytes(width, "little"), "<u8")
    out = np.empty_like(state)
    out[order] = state
    return out


def first_matches(texts: pa.Array, patterns: tuple[str, ...]) -> np.ndarray:
    """Per text the place of the first pattern that matches the whole of it, or -1."""
    found = np.full(len(texts), -1, np.int32)
    if not patterns:
        return found
    machine = automaton(patterns)
    lanes = max(1, BLOCK_BYTES // (16 * machine.start.size + len(patterns)))
    word, bit = machine.last // 64, (machine.last % 64).astype(np.uint64)
    for start, end, data, offsets in byte_chunks(texts):
        for a in range(start, end, lanes):
            b = min(a + lanes, end)
            state = run(machine, data, offsets[a - start : b - start + 1])
            hits = (state[:, word] >> bit & np.uint64(1)).astype(bool)
            found[a:b] = np.where(hits.any(axis=1), hits.argmax(axis=1), -1)
    return found


def judge(
    pages: DataFrame,
    rules: Sequence[tuple[str, str, str]] = RULES,
    patterns: Sequence[tuple[str, str]] = PATTERNS,
) -> DataFrame:
    """Allow or block every row of ``pages`` (``page_id``, ``url``) by rules, then by patterns.

    Returns ``page_id, host, path, rule, verdict, pattern``; other columns are left out.  All rules
    and patterns run as one automaton over ``.host/path`` of a url.  The longest rule that fits
    decides, then the longest pattern, of equally long ones the first given; ``pattern`` is what
    decided, and null where nothing matched and the page is allowed.  A null url and one without
    ``://`` have an empty host and path; an empty one matches no rule.  Repeated rows are judged
    each; an empty table gives no rows.  Rules and patterns are parameters of the job, so what the
    tasks get is as large as they are.
    """
    by_length = lambda made: sorted(made, key=lambda m: -m[0])
    ranked = by_length([(len(h + p), rule_pattern(h, p), h + p, v) for v, h, p in rules])
    ranked += by_length([(len(p), p, None, v) for v, p in patterns])
    texts = tuple(m[1] for m in ranked)

    def match(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            yield pa.array(first_matches(part, texts) + 1, pa.int32())

    rest = F.expr("CASE WHEN instr(url, '://') > 0 THEN substring(url, instr(url, '://') + 3) ELSE '' END")
    split = pages.select("page_id", rest.alias("rest")).withColumn("raw", F.regexp_extract("rest", "^([^/?#]*)", 1))
    parts = split.select(
        "page_id", F.translate("raw", UPPER, LOWER).alias("host"),
        F.regexp_extract(F.expr("substring(rest, length(raw) + 1)"), "^([^?#]*)", 1).alias("path"),
    )
    found = F.arrow_udf(match, "int")(F.concat(F.lit("."), "host", "path"))

    def pick(values: list[str | None]) -> Column:
        """The value of the match; place 0 is none."""
        return F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), F.col("place") + 1)

    return parts.withColumn("place", found).select(
        "page_id", "host", "path", pick([None] + [m[2] for m in ranked]).alias("rule"),
        pick([ALLOWED] + [m[3] for m in ranked]).alias("verdict"), pick([None, *texts]).alias("pattern"),
    )


ORACLE = f"""
WITH parts AS (
    SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest
    FROM pages),
hosts AS (SELECT *, regexp_extract(rest, '^([^/?#]*)', 1) AS raw FROM parts),
split AS (
    SELECT page_id, translate(raw, '{UPPER}', '{LOWER}') AS host,
           regexp_extract(substr(rest, length(raw) + 1), '^([^?#]*)', 1) AS path FROM hosts),
rules(verdict, rule_host, rule_path) AS (VALUES {", ".join(str(r) for r in RULES)}),
fits AS (
    SELECT s.page_id, s.host, s.path, r.rule_host || r.rule_path AS rule, r.verdict,
           row_number() OVER (PARTITION BY s.page_id ORDER BY length(r.rule_host || r.rule_path) DESC NULLS LAST) AS place
    FROM split s LEFT JOIN rules r ON ends_with('.' || s.host, '.' || r.rule_host) AND starts_with(s.path, r.rule_path)),
best AS (SELECT *, '.' || host || path AS whole FROM fits WHERE place = 1)
SELECT page_id, host, path, rule,
       coalesce(verdict, CASE WHEN regexp_full_match(whole, '[^/]*\\.edu/(?s:.*)') THEN 'allow'
                              WHEN regexp_full_match(whole, '[^/]*\\.cheap-[^/]*(/(?s:.*))?') THEN 'block'
                              WHEN regexp_full_match(whole, '[^/]*(spam|casino)(?s:.*)') THEN 'block'
                              WHEN regexp_full_match(whole, '(?s:.*)\\.(exe|zip)') THEN 'block' ELSE 'allow' END) AS verdict
FROM best
"""
