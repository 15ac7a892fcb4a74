"""Secrets in texts: fixed forms, and random strings that a tokenizer's vocabulary cannot shorten."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
KINDS = ("assign", "access", "hex")
OPAQUE = "opaque"
#: A candidate is random if its characters per token do not exceed this.
MAX_CHARS_PER_TOKEN = 2.0
MIN_CANDIDATE = 20

_ASSIGN = re.compile(
    r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", re.ASCII
)
_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % MIN_CANDIDATE)
#: Published digest lengths in hex digits, and identifiers of a fixed layout.
_KNOWN = re.compile(
    r"(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{56}|[0-9a-fA-F]{64}|[0-9a-fA-F]{96}|[0-9a-fA-F]{128}"
    r"|[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}|[0-9_=/+-]+)"
)
#: Simple pieces: candidates hold no blanks, so words, numbers and the rest are enough.
_PIECES = r"\p{L}+|\p{N}+|[^\s\p{L}\p{N}]+"

SPANS = "array<struct<kind:string,start:int,end:int,base:boolean,text:string>>"
_ARROW_SPANS = pa.list_(
    pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("text", pa.string())])
)


@lru_cache(maxsize=2)
def encoding(path: str) -> tiktoken.Encoding:
    """The public vocabulary at ``path``, loaded once per worker."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=_PIECES, mergeable_ranks=ranks, special_tokens={})


def is_random(token: str, vocabulary: tiktoken.Encoding, limit: float) -> bool:
    """Whether ``token`` has digits and letters, is no known digest or identifier, and needs many tokens."""
    if not any(c.isdigit() for c in token) or not any(c.isalpha() for c in token) or _KNOWN.fullmatch(token):
        return False
    return len(token) <= limit * len(vocabulary.encode_ordinary(token))


def scan(text: str, vocabulary: tiktoken.Encoding, limit: float) -> list[dict]:
    """All spans of one text by start, then kind; code points, end exclusive."""
    found = []
    low = text.lower()
    if any(w in low for w in _ASSIGN_WORDS):
        found += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [("hex", *m.span()) for m in _HEX.finditer(text)]
    found.sort(key=lambda s: (s[1], KINDS.index(s[0])))
    covered: list[list[int]] = []
    for _, a, b in found:
        if covered and a < covered[-1][1]:
            covered[-1][1] = max(covered[-1][1], b)
        else:
            covered.append([a, b])
    extra, i = [], 0
    for m in _CANDIDATE.finditer(text):
        while i < len(covered) and covered[i][1] <= m.start():
            i += 1
        inside = i < len(covered) and covered[i][0] < m.end()
        if not inside and is_random(m[0], vocabulary, limit):
            extra.append((OPAQUE, *m.span()))
    rows = [(k, a, b, True) for k, a, b in found] + [(k, a, b, False) for k, a, b in extra]
    rows.sort(key=lambda s: (s[1], (*KINDS, OPAQUE).index(s[0])))
    return [{"kind": k, "start": a, "end": b, "base": base, "text": text[a:b]} for k, a, b, base in rows]


def find_secrets(
    docs: DataFrame, vocabulary: str = VOCABULARY, max_chars_per_token: float = MAX_CHARS_PER_TOKEN
) -> DataFrame:
    """Secrets of every document: ``doc_id`` and ``spans`` with kind, place and text.

    Base kinds are ``assign``, ``access`` and ``hex``.  ``opaque`` spans are added by the
    token-efficiency test: strings of letters and digits outside base spans that average at most
    ``max_chars_per_token`` characters per token of the vocabulary file, unless they are digests of a
    published length, UUIDs or plain numbers.

    One row per input row in any case: null and empty texts have no spans, repeated rows repeat.
    Other columns are ignored.  An empty table gives no rows.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("spans", _ARROW_SPANS)])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoding(vocabulary)
        for part in parts:
            spans = [scan(t.as_py() or "", known, max_chars_per_token) for t in part.column(1)]
            yield pa.record_batch([part.column(0).cast(pa.int64()), pa.array(spans, _ARROW_SPANS)], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, spans {SPANS}")
