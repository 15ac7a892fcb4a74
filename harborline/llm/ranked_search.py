"""Ranked lexical search: an inverted index in shards of documents, searched by Block-Max MaxScore."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from harborline.llm.textio import byte_chunks
from harborline.session import stage

TOP_DOCUMENTS = 50
#: A shard is the documents of one task up to this many bytes of text (one document, if longer).
SHARD_BYTES = 8 << 20
#: Text is cut into terms this many bytes at a time.
PIECE_BYTES = 1 << 20
#: Postings of a block, the unit that is skipped or decompressed.
BLOCK_POSTINGS = 64
#: Items searched by one task in one shard.
GROUP_ITEMS = 512

_BYTE = np.arange(256)
_IS_TERM = ((_BYTE >= 0x30) & (_BYTE <= 0x39)) | ((_BYTE >= 0x41) & (_BYTE <= 0x5A)) | ((_BYTE >= 0x61) & (_BYTE <= 0x7A)) | (_BYTE >= 0x80)
_LOWER = np.where((_BYTE >= 0x41) & (_BYTE <= 0x5A), _BYTE + 32, _BYTE).astype(np.uint8)


def _pieces(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about a piece, or parts of a long text cut where no term is; with the first row."""
    for start, end, data, offsets in byte_chunks(texts, PIECE_BYTES):
        begin = 0
        while end - start == 1 and len(data) - begin > PIECE_BYTES:
            cut = begin + PIECE_BYTES
            while cut < len(data):
                free = np.flatnonzero(~_IS_TERM[data[cut : cut + 4096]])
                if len(free):
                    cut += int(free[0])
                    break
                cut += 4096
            cut = min(cut, len(data))
            yield start, data[begin:cut], np.array([0, cut - begin])
            begin = cut
        if end - start > 1 or begin < len(data):
            yield start, data[begin:], offsets if end - start > 1 else np.array([0, len(data) - begin])


def _term_places(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which bytes belong to terms, and the terms' first and end places."""
    inside = _IS_TERM[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    borders = offsets[(offsets > 0) & (offsets < len(data))]
    begins[borders] = inside[borders]
    ends[borders - 1] = inside[borders - 1]
    return inside, np.flatnonzero(begins), np.flatnonzero(ends) + 1


def _terms(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The terms of a piece in order, and the row of each within it."""
    inside, begins, ends = _term_places(data, offsets)
    places = np.concatenate(([0], np.cumsum(ends - begins))).astype(np.int64)
    kept = _LOWER[data[inside]]
    terms = pa.Array.from_buffers(pa.large_string(), len(begins), [None, pa.py_buffer(places), pa.py_buffer(kept)])
    return terms, np.searchsorted(offsets, begins, "right") - 1


def _lengths(texts: pa.Array) -> np.ndarray:
    count = np.zeros(len(texts), np.int64)
    for start, data, offsets in _pieces(texts):
        _, begins, _ = _term_places(data, offsets)
        rows = np.searchsorted(offsets, begins, "right") - 1
        count[start : start + len(offsets) - 1] += np.bincount(rows, minlength=len(offsets) - 1)
    return count


def corpus_size(docs: DataFrame) -> tuple[int, int]:
    """Documents with a term, and terms of all documents with repeats."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            count = _lengths(part.column(0))
            yield pa.record_batch([pa.array([int((count > 0).sum())]), pa.array([int(count.sum())])], names=["n", "l"])

    found = docs.select("text").mapInArrow(run, "n long, l long").agg(F.sum("n"), F.sum("l")).first()
    return found[0] or 0, found[1] or 0


def _varints(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values as bytes of seven bits, low ones first, and the place of each value."""
    sizes = np.ones(len(values), np.int64)
    rest = values >> 7
    while rest.any():
        sizes += rest > 0
        rest >>= 7
    places = np.concatenate(([0], np.cumsum(sizes)))
    out = np.zeros(places[-1], np.uint8)
    for i in range(int(sizes.max(initial=0))):
        more = sizes > i
        out[places[:-1][more] + i] = (values[more] >> (7 * i) & 127) | np.where(sizes[more] > i + 1, 128, 0)
    return out, places


def _values(raw: np.ndarray) -> np.ndarray:
    ends = np.flatnonzero(raw < 128)
    begins = np.concatenate(([0], ends[:-1] + 1))
    shift = np.arange(len(raw)) - np.repeat(begins, ends - begins + 1)
    return np.add.reduceat((raw & 127).astype(np.int64) << (7 * shift), begins)


def impacts(tf: np.ndarray, length: np.ndarray, n: int, total: int) -> np.ndarray:
    """What one term adds to a document's score, per unit of the term's weight."""
    if len(length) and 50 * n * int(length.max()) >= 1 << 62:
        length = length.astype(object)
    m = (50 + (50 * length * n) // total).astype(np.int64)
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


INDEX_COLUMNS = (
    "shard long, term string, df long, firsts array<int>, lasts array<int>, starts array<long>, tops array<int>, postings binary"
)


class _Shard:
    """Texts gathered until they make up a shard."""

    def __init__(self) -> None:
        self.ids: list[pa.Array] = []
        self.terms: list[pa.Array] = []
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.rows = self.bytes = self.words = 0

    def add(self, ids: pa.Array, texts: pa.Array) -> None:
        for start, data, offsets in _pieces(texts):
            terms, rows = _terms(data, offsets)
            if not len(terms):
                continue
            coded = terms.dictionary_encode()
            width = len(offsets)
            pairs, tf = np.unique(coded.indices.to_numpy().astype(np.int64) * width + rows, return_counts=True)
            self.parts.append((pairs // width + self.words, pairs % width + (self.rows + start), tf))
            self.terms.append(coded.dictionary)
            self.words += len(coded.dictionary)
        self.ids.append(ids)
        self.rows += len(ids)
        self.bytes += int(pc.sum(pc.binary_length(texts)).as_py() or 0) + 16 * len(texts)

    def index(self, shard: int, n: int, total: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        """One row per term with its postings in blocks, and one row of the documents' ids."""
        ids = pa.chunked_array(self.ids).combine_chunks()
        order = pc.sort_indices(ids, null_placement="at_end").to_numpy().astype(np.int64)
        local = np.empty(self.rows, np.int64)
        local[order] = np.arange(self.rows)
        listed = pa.array([ids.take(pa.array(order)).to_pylist()], schema.field("ids").type)
        yield pa.record_batch(
            [pa.array([shard]), *[pa.array([None], f.type) for f in list(schema)[1:8]], listed], schema=schema
        )
        if not self.parts:
            return
        coded = pa.chunked_array(self.terms).combine_chunks().dictionary_encode()
        known = coded.indices.to_numpy().astype(np.int64)
        term = known[np.concatenate([p[0] for p in self.parts])]
        doc = local[np.concatenate([p[1] for p in self.parts])]
        tf = np.concatenate([p[2] for p in self.parts])
        self.parts, self.terms = [], []  # several times the text's size
        key = term * self.rows + doc
        del term, doc, known
        sort = np.argsort(key, kind="stable")
        key, tf = key[sort], tf[sort]
        del sort
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        key, tf = key[first], np.add.reduceat(tf, first)  # a long text comes in several pieces
        term, doc = key // self.rows, key % self.rows
        length = np.bincount(doc, weights=tf, minlength=self.rows).astype(np.int64)
        gain = impacts(tf, length[doc], n, total)

        lists = np.flatnonzero(np.concatenate(([True], term[1:] != term[:-1])))
        sizes = np.diff(np.concatenate((lists, [len(term)])))
        within = np.arange(len(term)) - np.repeat(lists, sizes)
        blocks = np.flatnonzero(within % BLOCK_POSTINGS == 0)
        ends = np.concatenate((blocks[1:], [len(term)])) - 1
        gaps = np.diff(doc, prepend=0)
        gaps[blocks] = 0
        stream, places = _varints(np.stack([gaps, gain], axis=1).ravel())
        list_bytes = places[2 * np.concatenate((lists, [len(term)]))]
        per_list = np.concatenate(([0], np.cumsum(-(-sizes // BLOCK_POSTINGS))))
        block_bytes = places[2 * blocks] - np.repeat(list_bytes[:-1], np.diff(per_list))
        tops = np.maximum.reduceat(gain, blocks)

        def nested(values: np.ndarray, kind: pa.DataType) -> pa.Array:
            return pa.ListArray.from_arrays(pa.array(per_list, pa.int32()), pa.array(values, kind))

        yield pa.record_batch(
            [
                pa.array(np.full(len(lists), shard)), coded.dictionary.take(pa.array(term[lists])).cast(pa.string()), pa.array(sizes),
                nested(doc[blocks], pa.int32()), nested(doc[ends], pa.int32()), nested(block_bytes, pa.int64()), nested(tops, pa.int32()),
                pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(list_bytes.astype(np.int32)), pa.py_buffer(stream)]),
                pa.nulls(len(lists), schema.field("ids").type),
            ],
            schema=schema,
        )


def build_index(docs: DataFrame, n: int, total: int) -> DataFrame:
    """The inverted index of every row of ``docs`` (``doc_id``, ``text``).

    One row per shard and term: postings of document number and impact, in blocks with first and
    last document and greatest impact; and one row per shard without a term that lists the ids of
    its documents, which are numbered by ascending id, nulls last.
    """
    id_type = docs.schema["doc_id"].dataType
    schema = pa.schema([
        ("shard", pa.int64()), ("term", pa.string()), ("df", pa.int64()), ("firsts", pa.list_(pa.int32())), ("lasts", pa.list_(pa.int32())),
        ("starts", pa.list_(pa.int64())), ("tops", pa.list_(pa.int32())), ("postings", pa.binary()), ("ids", pa.list_(to_arrow_type(id_type))),
    ])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        shard = _Shard()
        for part in parts:
            ids, texts = part.column(0), part.column(1).cast(pa.large_binary()).fill_null(b"")
            sizes = np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64) + 16)
            start = 0
            while start < len(ids):
                before = sizes[start - 1] if start else 0
                end = max(start + 1, int(np.searchsorted(sizes, before + SHARD_BYTES - shard.bytes, "right")))
                shard.add(ids.slice(start, end - start), texts.slice(start, end - start))
                start = end
                if shard.bytes >= SHARD_BYTES or start < len(ids):
                    yield from shard.index(number, n, total, schema)
                    number += 1
                    shard = _Shard()
        if shard.rows:
            yield from shard.index(number, n, total, schema)

    return docs.select("doc_id", "text").mapInArrow(run, f"{INDEX_COLUMNS}, ids array<{id_type.simpleString()}>")


def item_terms(items: DataFrame) -> DataFrame:
    """``item`` and ``term``, each once, of the items' texts."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for start, data, offsets in _pieces(part.column(1).cast(pa.large_binary()).fill_null(b"")):
                terms, rows = _terms(data, offsets)
                yield pa.record_batch([part.column(0).take(pa.array(rows + start)), terms.cast(pa.string())], names=["item", "term"])

    return items.select("item", "text").mapInArrow(run, "item long, term string").distinct()


class Postings:
    """The list of one term in one shard; blocks are decompressed when they are asked for, and kept."""

    def __init__(self, weight: int, firsts: np.ndarray, lasts: np.ndarray, starts: np.ndarray, tops: np.ndarray, raw: np.ndarray):
        self.weight, self.firsts, self.lasts, self.raw = weight, firsts, lasts, raw
        self.starts = np.append(starts, len(raw))
        self.tops = tops.astype(np.int64) * weight
        self.bound = int(self.tops.max())
        self._read: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self._whole: tuple[np.ndarray, np.ndarray] | None = None

    def block(self, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and what the term adds to their scores."""
        if b not in self._read:
            pairs = _values(self.raw[self.starts[b] : self.starts[b + 1]])
            self._read[b] = self.firsts[b] + np.cumsum(pairs[0::2]), pairs[1::2] * self.weight
        return self._read[b]

    def whole(self) -> tuple[np.ndarray, np.ndarray]:
        if self._whole is None:
            pairs = _values(self.raw)
            gaps, gains = pairs[0::2], pairs[1::2] * self.weight
            steps = np.cumsum(gaps)
            heads = np.arange(0, len(gaps), BLOCK_POSTINGS)
            base = self.firsts - steps[heads]
            self._whole = steps + np.repeat(base, np.diff(np.append(heads, len(gaps)))), gains
        return self._whole

    def blocks_of(self, docs: np.ndarray) -> np.ndarray:
        """The block that may hold each document, or -1."""
        at = np.searchsorted(self.lasts, docs)
        safe = np.minimum(at, len(self.lasts) - 1)
        return np.where((at < len(self.lasts)) & (self.firsts[safe] <= docs), safe, -1)

    def gains(self, docs: np.ndarray, blocks: np.ndarray) -> np.ndarray:
        out = np.zeros(len(docs), np.int64)
        for b in np.unique(blocks[blocks >= 0]):
            mine = np.flatnonzero(blocks == b)
            held, gains = self.block(int(b))
            at = np.minimum(np.searchsorted(held, docs[mine]), len(held) - 1)
            out[mine] = np.where(held[at] == docs[mine], gains[at], 0)
        return out


def _kth(scores: np.ndarray, k: int) -> int:
    return int(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) >= k else 0


def best_documents(lists: list[Postings], k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` best documents of a shard (score, then number) and their scores above 0.

    Lists are taken by falling bound.  They are essential until the bounds of the rest together stay
    below the k-th best score: a document in none of them can't get in.  On the rest, the greatest
    impacts of the blocks that may hold a candidate are added up first, so that most candidates go
    before a block is decompressed; every list read lowers what the others may still reach.
    """
    lists = sorted(lists, key=lambda p: -p.bound)
    rest = np.cumsum([0] + [p.bound for p in reversed(lists)])[::-1].tolist()
    scores = np.zeros(1 + max(int(p.lasts[-1]) for p in lists), np.int64)
    floor, i = 0, 0
    while i < len(lists) and rest[i] >= floor:
        docs, gains = lists[i].whole()
        scores[docs] += gains
        i += 1
        if i < len(lists):
            floor = _kth(scores, k)
    docs = np.flatnonzero((scores > 0) & (scores + rest[i] >= floor))
    got = scores[docs]
    others = lists[i:]
    if others:
        at = [p.blocks_of(docs) for p in others]
        most = [np.where(b >= 0, p.tops[b], 0) for p, b in zip(others, at)]
        reach = got + sum(most)
        for j, p in enumerate(others):
            keep = reach >= floor
            if not keep.all():
                docs, got, reach = docs[keep], got[keep], reach[keep]
                at, most = [b[keep] for b in at], [m[keep] for m in most]
            gains = p.gains(docs, at[j])
            got = got + gains
            reach = reach - most[j] + gains
            floor = max(floor, _kth(got, k))
        docs, got = docs[reach >= floor], got[reach >= floor]
    best = np.lexsort((docs, -got))[:k]
    return docs[best], got[best]


def _search_group(found: pa.Table, k: int) -> pa.Table:
    """The best documents of one shard for every item of one group."""
    found = found.combine_chunks()

    def lists(name: str) -> tuple[np.ndarray, np.ndarray]:
        column = found.column(name).chunk(0)
        return column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)

    columns = [lists(n) for n in ("firsts", "lasts", "starts", "tops")]
    offsets, items = lists("items")
    weights = found.column("weight").to_numpy()
    raws = found.column("postings").chunk(0)
    held = [
        Postings(int(weights[r]), *[v[o[r] : o[r + 1]] for o, v in columns], np.frombuffer(raws[r].as_buffer(), np.uint8))
        for r in range(found.num_rows)
    ]
    rows = np.repeat(np.arange(found.num_rows), np.diff(offsets))
    items = items[offsets[0] : offsets[-1]]
    order = np.argsort(items, kind="stable")
    items, rows = items[order], rows[order]
    cuts = np.flatnonzero(np.concatenate(([True], items[1:] != items[:-1]))).tolist() + [len(items)]
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for a, b in zip(cuts[:-1], cuts[1:]):
        docs, scores = best_documents([held[r] for r in rows[a:b]], k)
        out.append((np.full(len(docs), items[a]), docs, scores))
    shard = found.column("shard")[0].as_py()
    item, doc, score = (np.concatenate([o[c] for o in out]) for c in range(3))
    return pa.table({"item": item, "shard": np.full(len(item), shard), "local": doc.astype(np.int64), "score": score})


def search(docs: DataFrame, items: DataFrame, k: int = TOP_DOCUMENTS) -> DataFrame:
    """The ``k`` best rows of ``docs`` (``doc_id``, ``text``) for each row of ``items`` (``item_id``, ``text``).

    Returns ``item_id, rank, doc_id, score``, scores above 0 only; equal scores by ascending
    ``doc_id``, nulls last.  Every row of ``docs`` counts as a document of its own, also under a
    repeated or null id; equal rows of ``items`` count once.  Null and empty texts have no terms, so such items,
    items without a known term and empty tables give no rows.  Other columns are left out.

    Documents are read twice, for the statistics and for the index, and not shuffled.  The postings
    of the items' terms are joined to the items by term and go to one task per shard and group of
    items, each bounded by its shard; every task keeps ``k`` documents an item, and these heaps are
    merged by a window that Spark cuts before its shuffle.
    """
    n, total = corpus_size(docs)
    asked = stage(items.select("item_id", "text").distinct().withColumn("item", F.monotonically_increasing_id()), "search-items")
    groups = max(1, -(-asked.count() // GROUP_ITEMS))
    index = stage(build_index(docs, n, max(total, 1)), "search-index")
    lists = index.where("term IS NOT NULL").drop("ids")
    terms = stage(item_terms(asked), "search-terms")
    wanted = terms.select("term").distinct()
    weight = F.floor(1000 * F.log((2 * F.lit(n).cast("double") + 2) / (2 * F.col("df") + 1)))
    weights = lists.join(wanted, "term").groupBy("term").agg(F.sum("df").alias("df")).select("term", weight.alias("weight"))
    per_group = terms.withColumn("group", F.pmod(F.xxhash64("item"), F.lit(groups)).cast("int"))
    asked_terms = per_group.groupBy("term", "group").agg(F.collect_list("item").alias("items"))
    # written, so that Spark knows its size and need not shuffle the whole index where it is small
    queries = stage(asked_terms.join(weights.where("weight > 0"), "term"), "search-queries")
    heaps = (
        lists.join(queries, "term")
        .select("shard", "group", "weight", "items", "firsts", "lasts", "starts", "tops", "postings")
        .groupBy("shard", "group")
        .applyInArrow(lambda t: _search_group(t, k), "item long, shard long, local long, score long")
    )
    place = Window.partitionBy("item").orderBy(F.col("score").desc())
    near = heaps.withColumn("place", F.rank().over(place)).where(F.col("place") <= k).drop("place")
    numbered = index.where("term IS NULL").select("shard", F.posexplode("ids").alias("local", "doc_id"))
    named = near.join(numbered, ["shard", "local"])
    final = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = named.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k)
    return ranked.join(asked.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


ORACLE = """
WITH words AS (
    SELECT doc_id, unnest(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
    FROM documents),
tfs AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
lens AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tfs GROUP BY doc_id),
totals AS (SELECT count(*) AS nn, sum(n)::BIGINT AS ll FROM lens),
ms AS (SELECT doc_id, 50 + ((50 * n * nn) // ll) AS m FROM lens, totals),
asked AS (
    SELECT DISTINCT item_id, unnest(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
    FROM benchmark),
weights AS (
    SELECT term, CAST(floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * df + 1))) AS BIGINT) AS w
    FROM (SELECT term, count(*) AS df FROM tfs WHERE term IN (SELECT term FROM asked) GROUP BY term), totals),
scores AS (
    SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
    FROM asked JOIN weights USING (term) JOIN tfs USING (term) JOIN ms USING (doc_id) GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
    SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0)
WHERE rank <= 50
"""
