"""Operator 5: benchmark decontamination with a broadcast set of normalised n-grams.

Test items and documents are lower-cased (A-Z) and cut into words. Each item gives its
windows of 13 words (a shorter item: one window of all its words). Tasks hash the windows;
the sorted hashes are broadcast with the place of each window in the items' words. Every
document's token windows are looked up among the hashes, hits are verified against the
words themselves, and the words they cover are marked. Documents over the share of hit
words can be dropped, or the spans cut out.

The broadcast is bounded by SET_BYTES of item text (about 5 bytes for each: the text, and
16 bytes a window). A larger benchmark is dealt into blocks under that bound; documents
are scanned once for each block, only those with hits are written down (by the SHA-256 of
their text), and a join brings the hits of all blocks back to the documents. A document
is worked on in blocks of BLOCK bytes that overlap by a window less one word.

Defined results: null texts and texts without words have no words and no hits; items
without words are ignored, and so are items without an id; items that share an id count
once; repeated rows are judged row by row; an empty benchmark hits nothing; an empty table
gives no rows; other columns ride along in a struct and may have any name.
"""

from __future__ import annotations

import math
import re
from functools import partial
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orograph.llm import text as X
from orograph.llm.common import annotate, cut, raw_texts, spans

WINDOW = 13
#: Most bytes of item text that one broadcast set is made from.
SET_BYTES = 32 << 20
BLOCK = 1 << 20
FOUND = "spans array<struct<pos:long,n:long>>, items array<string>, n_words long"
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def word_table() -> np.ndarray:
    """True for the bytes of words: digits, a-z and all of the bytes above ASCII."""
    table = np.ones(256, bool)
    table[0x00:0x30] = table[0x3A:0x61] = table[0x7B:0x80] = False
    return table


def _item_windows(window: int, batches):
    """Of each item: its words, joined and followed by spaces, the words of a window, and
    the windows' hashes and first bytes."""
    for batch in batches:
        texts, sizes, hashes, starts = [], [], [], []
        for raw in raw_texts(batch):
            words = WORD.findall(raw.lower())
            n = min(window, len(words))
            texts.append(b" ".join(words) + b" " * bool(words))
            w = X.Words([texts[-1]], word_table())
            h = X.window_hash(w.hash, n) if n else np.zeros(0, np.uint64)
            sizes.append(n), hashes.append(h.view(np.int64)), starts.append(w.start[: len(h)].astype(np.int32))
        yield pa.RecordBatch.from_arrays(
            [batch.column("item"), pa.array(texts, pa.binary()), pa.array(sizes, pa.int32()), pa.array(hashes, pa.list_(pa.int64())), pa.array(starts, pa.list_(pa.int32()))], ["item", "words", "n", "h", "start"]
        )


def ngram_set(items: DataFrame, window: int) -> dict:
    """The set of a block of ``items`` (item, text): all words, item ids, and for each
    window length the windows' sorted hashes, first bytes and items. A table of leading
    bits of hashes lets most lookups end early."""
    made = items.mapInArrow(partial(_item_windows, window), "item string, words binary, n int, h array<long>, start array<int>").toArrow().combine_chunks()
    column = lambda c: made.column(c).combine_chunks() if made.num_rows else pa.array([], made.schema.field(c).type)
    words, lists = column("words").to_pylist(), column("h")
    base = np.cumsum([0, *map(len, words)])[:-1]
    count = np.asarray(lists.value_lengths(), np.int64)
    owner = np.repeat(np.arange(len(words)), count)
    hashes, start = np.asarray(lists.flatten()).view(np.uint64), np.asarray(column("start").flatten()) + base[owner]
    size = np.asarray(column("n"))[owner] if len(owner) else owner
    by = {}
    for n in np.unique(size).tolist():
        mine = np.flatnonzero(size == n)
        mine = mine[np.argsort(hashes[mine], kind="stable")]
        seen = np.zeros(1 << min(22, max(10, int(len(mine)).bit_length() + 3)), bool)
        seen[hashes[mine] & np.uint64(len(seen) - 1)] = True
        by[n] = (seen, hashes[mine], start[mine].astype(np.int64), owner[mine].astype(np.int32))
    return {"words": b"".join(words), "items": column("item").to_pylist(), "by": by}


def _blocks(raw: list[bytes], overlap: int):
    """(number of the first text, words before the block in it, words of the block)."""
    for i, j in spans([len(t) for t in raw], BLOCK):
        if j - i > 1 or len(raw[i]) <= BLOCK:
            yield i, 0, X.Words([t.lower() for t in raw[i:j]], word_table())
            continue
        tail, base = b"", 0
        for piece in X.pieces(raw[i], BLOCK):
            w = X.Words([tail + piece.lower()], word_table())
            yield i, base, w
            step = max(0, len(w.start) - overlap)
            tail = w.buf[w.start[step] :] if step < len(w.start) else b""
            base += step


def _find(grams: dict, raw: list[bytes], window: int):
    """For each text: word spans covered by windows of the set, items hit, words."""
    spans_of: list[set] = [set() for _ in raw]
    items: list[set] = [set() for _ in raw]
    count = np.zeros(len(raw), np.int64)
    text, names = grams["words"], grams["items"]
    for first, base, w in _blocks(raw, window - 1):
        count[first : first + len(w.ptr) - 1] = base + np.diff(w.ptr)
        for n, (seen, hashes, starts, owners) in grams["by"].items():
            h = X.window_hash(w.hash, n)
            if not len(h):
                continue
            at = np.flatnonzero(seen[h & np.uint64(len(seen) - 1)])
            low, high = np.searchsorted(hashes, h[at], "left"), np.searchsorted(hashes, h[at], "right")
            owner = np.searchsorted(w.ptr, at, "right") - 1
            some = np.flatnonzero((high > low) & (at + n <= w.ptr[owner + 1]))
            for i, o, a, b in zip(at[some].tolist(), owner[some].tolist(), low[some].tolist(), high[some].tolist()):
                gram = b" ".join(w.word(k) for k in range(i, i + n)) + b" "
                hit = [names[owners[k]] for k in range(a, b) if text.startswith(gram, starts[k])]
                if hit:
                    spans_of[first + o].add((base + i - int(w.ptr[o]), n))
                    items[first + o].update(hit)
    return spans_of, items, count


def _finder(held, window: int):
    def fn(raw):
        spots, items, words = _find(held.value, raw, window)
        kind = pa.list_(pa.struct([("pos", pa.int64()), ("n", pa.int64())]))
        return [pa.array([[{"pos": p, "n": n} for p, n in sorted(s)] for s in spots], kind), pa.array([sorted(s) for s in items], pa.list_(pa.string())), pa.array(words, pa.int64())]

    return fn


def find_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, set_bytes: int = SET_BYTES) -> DataFrame:
    """Rows of ``docs`` (struct row) with spans (word position and length of each
    verified window), items (ids of items hit) and n_words. ``benchmark``: item_id, text."""
    send = docs.sparkSession.sparkContext.broadcast
    named = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text")).distinct()
    size = named.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / set_bytes))
    if blocks == 1:
        return annotate(docs, _finder(send(ngram_set(named, window)), window), FOUND)
    scanned, key = [], F.sha2("text", 256)
    for k in range(blocks):
        part = named.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k)
        hits = annotate(docs.select(key.alias("key"), "text"), _finder(send(ngram_set(part, window)), window), FOUND)
        scanned.append(cut(hits.where(F.size("spans") > 0).select("row.key", "spans", "items")))
    every = scanned[0]
    for s in scanned[1:]:
        every = every.unionByName(s)
    hits = every.groupBy("key").agg(F.array_distinct(F.flatten(F.collect_set("spans"))).alias("spans"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    counted = annotate(docs, _finder(send(ngram_set(named.limit(0), window)), window), FOUND).select("row", "n_words", F.sha2("row.text", 256).alias("own"))
    joined = counted.join(hits, counted["own"] == hits["key"], "left")
    none = lambda c, kind: F.coalesce(c, F.array().cast(kind)).alias(c)
    return joined.select("row", none("spans", "array<struct<pos:long,n:long>>"), none("items", "array<string>"), "n_words")


def judge(found: DataFrame, share: int = 20) -> DataFrame:
    """Adds n_hit (words inside any span), n_items, items_sha256 and contaminated (hit
    words make up 1/share of the words at least) to rows of ``find_hits``."""
    # words covered by sorted spans: each adds what lies beyond the furthest end so far
    ends = F.aggregate(
        F.array_sort("spans"),
        F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("hit")),
        lambda a, s: F.struct(F.greatest(a["end"], s["pos"] + s["n"]).alias("end"), (a["hit"] + F.greatest(F.lit(0).cast("long"), s["pos"] + s["n"] - F.greatest(a["end"], s["pos"]))).alias("hit")),
        lambda a: a["hit"],
    )
    counted = found.withColumn("n_hit", ends)
    return counted.select(
        "row", "spans", "items", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words"))).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = 20) -> DataFrame:
    """``docs`` without the contaminated ones."""
    return judge(find_hits(docs, benchmark, window), share).where("not contaminated").select("row.*")


def cut_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, text): texts without the words that windows of the benchmark cover, words
    joined by one space and lower-cased where anything was cut; other texts unchanged."""

    def fn(raw, spans):
        out = []
        for t, s in zip(raw, spans):
            if s:
                words = WORD.findall(t.lower())
                t = b" ".join(chain.from_iterable(X.without(words, *X.merged(np.array([x["pos"] for x in s]), np.array([x["n"] for x in s])))))
            out.append(t.decode("utf-8", "replace"))
        return out

    def run(batches):
        for batch in batches:
            raw = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fn(raw, batch.column("spans").to_pylist()), pa.string())], ["doc_id", "text"])

    found = find_hits(docs.select("doc_id", "text"), benchmark, window).select("row.doc_id", "row.text", "spans")
    return found.mapInArrow(run, "doc_id long, text string")


def digest_rows(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of the contract."""
    judged = judge(find_hits(docs.select("doc_id", "text"), benchmark))
    return judged.select("row.doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


#: DuckDB: all windows of items, joined to all windows of documents.
_CLEAN = "regexp_extract_all(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g'), '[^ ]+')"
ORACLE = f"""
WITH b AS (SELECT item_id, {_CLEAN} AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
    FROM (SELECT *, least({WINDOW}, len(w)) AS n FROM b WHERE len(w) > 0))),
d AS (SELECT doc_id, {_CLEAN} AS w FROM documents),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)),
hits AS (SELECT doc_id, dw.i, dw.n, item_id FROM dw JOIN bw USING (n, g)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM hits GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
