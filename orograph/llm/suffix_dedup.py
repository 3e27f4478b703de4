"""Operator 9: suffix-array dedup by a depth-limited radix sort.

Suffixes of all texts are ordered only as far as the threshold (200 bytes), by passes over
digits from the most significant on; groups that are still together after the last digit
are exactly the repeated windows.

Tasks share the suffixes by anchor (``recurring``), not by their leading bytes: equal
windows have equal anchors, too, but a segment of a hundred suffixes of one anchor travels
as one text, where ranges of leading bytes would need each suffix with 200 bytes of its
own. Suffixes whose anchor occurs once can't equal another and are left out before any
text is shipped. Within a task all suffixes of a chunk of anchors are sorted in one go:
the first key is the anchor and the distance to it, then come digits of 8 bytes, the
leading ones first; groups with different digits are dealt into buckets by 16 bits at a
time. A suffix that is alone in its group leaves. Equal segments travel and are sorted as
one, whose suffixes weigh two. Only after the last digit is it known which groups weigh
two or more, and their suffixes, and no others, are repeated. What the groups say of a
segment's text goes to each place that has it.

Defined results: null and empty texts have no bytes; a text shorter than the threshold
keeps all; rows that repeat an id and its text count as one document (each row is
returned); texts that share an id are documents of their own; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orograph.llm import recurring as R
from orograph.llm import text as X
from orograph.llm.common import cut, keyed, raw_texts

DEPTH = 200
CHUNK_BYTES = 1 << 20
DIGIT = 8
KEPT = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
_CUTS = "array<struct<pos: long, n: long>>"


def _digits(data: bytes) -> np.ndarray:
    """The DIGIT bytes from each place on, as a number; zeros beyond the end."""
    padded = np.frombuffer(data + bytes(DIGIT), np.uint8)
    value = np.zeros(len(data), np.uint64)
    for k in range(DIGIT):
        value = value << np.uint64(8) | padded[k : k + len(data)]
    return value


def _bucketed(*keys: np.ndarray) -> np.ndarray:
    """The stable order by keys (unsigned, the leading one first), by buckets of 16 bits from
    the last ones on. NumPy sorts 16 bits by counting."""
    order = np.arange(len(keys[0]))
    for key in reversed(keys):
        most = int(key.max()) if len(key) else 0
        for bits in range(0, most.bit_length(), 16):
            part = (key >> np.uint64(bits) & np.uint64(0xFFFF)).astype(np.uint16)
            order = order[np.argsort(part[order], kind="stable")]
    return order


def repeated(data: bytes, place: np.ndarray, group: np.ndarray, weight: np.ndarray, depth: int) -> np.ndarray:
    """Which suffixes of ``data`` (at ``place``, ``depth`` bytes long at least) are in a group
    that weighs two or more after ``depth`` bytes: of one ``group`` and equal that far."""
    digits = _digits(data)
    index = _bucketed(group.astype(np.uint64))
    key = group[index]
    new = np.concatenate(([True], key[1:] != key[:-1]))[: len(key)]  # begins a group
    for at in range(0, depth + DIGIT, DIGIT):
        alone = new & np.concatenate((new[1:], [True]))[: len(new)] & (weight[index] < 2)
        index, new = index[~alone], new[~alone]
        if at >= depth or not len(index):
            break
        digit = digits[place[index] + at]
        if depth - at < DIGIT:
            digit = digit >> np.uint64(8 * (DIGIT - depth + at))
        start = np.flatnonzero(new)
        number = np.cumsum(new) - 1
        mixed = np.logical_or.reduceat(digit != digit[start][number], start)
        if mixed.any():  # other groups stay as they are
            rows = np.flatnonzero(mixed[number])
            order = rows[_bucketed(number[rows].astype(np.uint64), digit[rows])]
            index[rows], digit[rows] = index[order], digit[order]
            new[1:] |= digit[1:] != digit[:-1]
    out = np.zeros(len(place), bool)
    out[index] = True
    return out


def _located(depth: int, batches):
    """Of each segment's text: the runs that repeated windows cover."""
    for table in R.chunks(batches, CHUNK_BYTES):
        segs = table.column("seg").to_pylist()
        size = np.fromiter(map(len, segs), np.int64, len(segs))
        windows = size - depth + 1
        owner = np.repeat(np.arange(len(segs)), windows)
        offset = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
        h, again = np.asarray(table.column("h")), np.asarray(table.column("again"))
        anchor = np.concatenate(([0], np.cumsum(h[1:] != h[:-1])))
        group = anchor[owner] * depth + np.asarray(table.column("at"))[owner] - offset
        found = np.flatnonzero(repeated(b"".join(segs), (np.cumsum(size) - size)[owner] + offset, group, np.where(again, 2, 1)[owner], depth))
        o, i = owner[found], offset[found]
        first = np.flatnonzero(np.concatenate(([True], (o[1:] != o[:-1]) | (i[1:] > i[:-1] + depth)))) if len(o) else np.zeros(0, np.int64)
        last = np.concatenate((first[1:], [len(o)]))[: len(first)] - 1
        runs = pa.StructArray.from_arrays([pa.array(i[first]), pa.array(i[last] - i[first] + depth)], ["pos", "n"])
        named, begins = np.unique(o[first], return_index=True)
        cuts = pa.ListArray.from_arrays(pa.array(np.concatenate((begins, [len(first)])), pa.int32()), runs)
        yield pa.RecordBatch.from_arrays([*(c.combine_chunks() for c in table.select(["h", "g"]).take(pa.array(named)).columns), cuts], ["h", "g", "found"])


def _sorted(segments: DataFrame, depth: int) -> DataFrame:
    """(dkey, tkey, cuts): what goes from each place of ``segments``."""
    ends = [f(c).alias(f"{name}_{c}") for c in ("dkey", "tkey", "pos") for name, f in (("least", F.min), ("most", F.max))]
    again = F.expr("least_dkey != most_dkey or least_tkey != most_tkey or least_pos != most_pos")
    once = segments.groupBy("h", "g", "at", "seg").agg(*ends).select("h", "g", "at", again.alias("again"), "seg")
    dealt = once.repartition(F.col("h")).sortWithinPartitions("h")
    found = cut(dealt.mapInArrow(partial(_located, depth), f"h long, g binary, found {_CUTS}"))
    placed = F.transform("found", lambda c: F.struct((c["pos"] + F.col("pos")).alias("pos"), c["n"].alias("n")))
    return cut(segments.select("h", "g", "dkey", "tkey", "pos").join(found, ["h", "g"]).select("dkey", "tkey", placed.alias("cuts")))


def _kept(with_text: bool, batches):
    for batch in batches:
        rows = []
        for raw, cuts in zip(raw_texts(batch), batch.column("cuts")):
            n, removed, runs, kept = len(raw), 0, 0, raw
            if cuts.is_valid and len(cuts):
                begins, ends = X.merged(np.asarray(cuts.values.field("pos")), np.asarray(cuts.values.field("n")))
                removed, runs = int((ends - begins).sum()), len(begins)
                kept = b"".join(X.without(raw, begins, ends))
            rows.append((n, removed, runs, hashlib.sha256(kept).hexdigest(), kept if with_text else None))
        out = list(zip(*rows)) or [()] * 5
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in out[:3]), pa.array(out[3], pa.string()), pa.array(out[4], pa.binary())],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
        ).select(KEPT[: 6 if with_text else 5])


def remove_repeated_bytes(docs: DataFrame, depth: int = DEPTH, gram: int = 32, with_text: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 and kept
    (bytes left) for each row of ``docs`` (doc_id, text). A byte goes if it lies in a
    string of ``depth`` bytes that also starts anywhere else, in any document."""
    docs = keyed(docs)
    segments = R.recurring_segments(docs, R.Unit(depth, gram, False))
    cuts = R.by_document([_sorted(part, depth) for part in segments])
    joined = docs.join(cuts, ["dkey", "tkey"], "left").select("doc_id", "text", "cuts")
    return joined.mapInArrow(partial(_kept, with_text), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text)


#: DuckDB: bytes as two hex digits each, cut into overlapping parts that substr() goes
#: through fast; all windows by their digest; maximal runs, and what lies between them.
ORACLE = f"""
WITH d AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
part AS (SELECT doc_id, j, substr(h, 2 * j + 1, 2 * {499 + DEPTH}) AS b FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - {DEPTH - 1}, 500)) AS j FROM d WHERE len(h) >= {2 * DEPTH})),
win AS MATERIALIZED (SELECT doc_id, j + k AS i, md5(substr(b, 2 * k + 1, {2 * DEPTH})) AS g FROM (SELECT doc_id, j, b, unnest(range(0, len(b) // 2 - {DEPTH - 1})) AS k FROM part)),
dup AS (SELECT g FROM win GROUP BY g HAVING count(*) > 1),
hit AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM win SEMI JOIN dup USING (g)),
isl AS (SELECT doc_id, i, sum(CASE WHEN i <= before + {DEPTH} THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM hit),
runs AS MATERIALIZED (SELECT doc_id, run, min(i) AS a, max(i) + {DEPTH} AS b FROM isl GROUP BY doc_id, run),
parts AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS z FROM runs),
cut_ AS (SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS last_b, string_agg(substr(h, 2 * z + 1, 2 * (a - z)), '' ORDER BY a) AS k FROM parts JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(k || substr(h, 2 * last_b + 1), h))) AS kept_sha256 FROM d LEFT JOIN cut_ USING (doc_id)
"""
