"""Candidate passages that recur, found without shipping texts.

A window of T units (words or bytes) is represented by its anchor: the gram of k units
with the smallest hash among those inside the window, leftmost on ties. Equal windows
have equal anchors at equal places, so only windows whose anchor occurs twice can recur.
Anchors are a few hundredths (bytes) or about a seventh (words) of the windows; counting
them is a partial aggregation, so frequent ones meet as counts and not as rows.

Consecutive windows with one anchor form a segment. Equal windows lie in segments of
equal anchors, at equal distances from them, so what recurs is decided anchor by anchor.
Two windows of one segment have different distances and are never equal.

An anchor that a great many different segments share (``crowded``) is refined: its
segments are cut into halves by the windows' distance to the anchor, and each half is
grouped anew by all the text that its windows have in common. Halves that stand alone
leave. At the latest, a half is one window and its group has one text, so the refinement
ends, and no group of segments grows with the input.

Hashes only choose who meets whom; what meets is compared by its units. Texts longer than
a block are cut into pieces that overlap by a window less one unit.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orograph.llm import text as X
from orograph.llm.common import cut, raw_texts, spans

#: Different segments, and bytes of them, from which on an anchor is refined.
CROWD, CROWD_BYTES = 2_000, 2 << 20
#: Bytes of a block of texts, or of a piece of one text.
BLOCK = 1 << 20
SEGMENT = "h long, g binary, at int, dkey long, tkey long, pos long, n int, size int, seg binary"


@dataclass(frozen=True)
class Unit:
    """window: units of a window; gram: units of an anchor; words: units are words,
    else bytes."""

    window: int
    gram: int
    words: bool

    def split(self, raw: bytes) -> list[bytes] | bytes:
        return raw.split() if self.words else raw

    def join(self, units) -> bytes:
        return b" ".join(units) if self.words else units


@dataclass
class Block:
    """Texts (from number ``first`` on) and their units: values, and the range
    [begin, end) of each text's. ``base``: units before those of a piece of a text."""

    first: int
    base: int
    raw: list[bytes]
    unit: Unit
    values: np.ndarray = field(init=False)
    begin: np.ndarray = field(init=False)
    end: np.ndarray = field(init=False)
    places: np.ndarray | None = field(init=False, default=None)

    def __post_init__(self):
        if self.unit.words:
            w = X.Words(self.raw, X.space_table())
            self.values, self.begin, self.end, self.places = w.hash, w.ptr[:-1], w.ptr[1:], w.start
        else:
            size = np.fromiter(map(len, self.raw), np.int64, len(self.raw))
            self.end = np.cumsum(size)
            self.begin = self.end - size
            self.values = X.byte_values()[np.frombuffer(b"".join(self.raw), np.uint8)]

    def segments(self):
        """Arrays of text number, first unit in the text, windows, distance of the anchor
        from the first unit, and anchor of each segment."""
        unit, count = self.unit, np.maximum(self.end - self.begin - self.unit.window + 1, 0)
        owner = np.repeat(np.arange(len(self.begin)), count)
        none = np.zeros(0, np.int64)
        if not len(owner):
            return none, none, none, none, np.zeros(0, np.uint64)
        grams = X.window_hash(self.values, unit.gram)
        start = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + self.begin[owner]
        a = X.window_argmin(grams, unit.window - unit.gram + 1)[start]
        first = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (owner[1:] != owner[:-1]))))
        windows = np.diff(np.concatenate((first, [len(owner)])))
        return self.first + owner[first], self.base + start[first] - self.begin[owner[first]], windows, a[first] - start[first], grams[a[first]]


def blocks(raw: list[bytes], unit: Unit):
    """All texts, in blocks of bounded size."""
    for i, j in spans([len(t) for t in raw], BLOCK):
        if j - i > 1 or len(raw[i]) <= BLOCK:
            yield Block(i, 0, raw[i:j], unit)
            continue
        text, start, base, size = raw[i], 0, 0, BLOCK
        while True:
            end = min(start + size, len(text))
            if unit.words and end < len(text):
                gap = X.GAP.search(text, end)
                end = gap.start() if gap else len(text)
            piece = Block(i, base, [text[start:end]], unit)
            step = len(piece.values) - unit.window + 1
            if end < len(text) and step <= 0:  # few and very long words
                size *= 2
                continue
            yield piece
            if end == len(text):
                break
            start += int(piece.places[step]) if unit.words else step
            base, size = base + step, BLOCK


def _anchors(unit: Unit, batches):
    for batch in batches:
        raw, key, tkey = raw_texts(batch), np.asarray(batch.column("dkey")), np.asarray(batch.column("tkey"))
        for block in blocks(raw, unit):
            owner, pos, _, _, h = block.segments()
            # an anchor that a text repeats is one row, with its places
            order = np.lexsort((pos, h, owner))
            o, a = owner[order], h[order].view(np.int64)
            first = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (o[1:] != o[:-1])))) if len(o) else np.zeros(0, np.int64)
            places = pa.ListArray.from_arrays(pa.array(np.concatenate((first, [len(o)])), pa.int32()), pa.array(pos[order].astype(np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array(a[first]), pa.array(key[o[first]]), pa.array(tkey[o[first]]), places], ["h", "dkey", "tkey", "pos"])


def digest(seg: bytes) -> bytes:
    return hashlib.blake2b(seg, digest_size=16).digest()


def _segment_rows(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [()] * 9
    kinds = [pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["h", "g", "at", "dkey", "tkey", "pos", "n", "size", "seg"])


def _texts_of(unit: Unit, batches):
    for batch in batches:
        raw, key, tkey = raw_texts(batch), np.asarray(batch.column("dkey")), np.asarray(batch.column("tkey"))
        wanted = batch.column("wanted")
        # (text, place) as one number, to look up the wanted places of all texts at once
        ask = np.repeat(np.arange(len(raw)), np.asarray(wanted.value_lengths())) << 40 | np.asarray(wanted.flatten()).astype(np.int64)
        for block in blocks(raw, unit):
            owner, pos, windows, at, h = block.segments()
            keep = np.flatnonzero(np.isin(owner << 40 | pos, ask))
            segs, units, last = [], None, -1
            size = windows[keep] + unit.window - 1
            for o, p, n in zip((owner[keep] - block.first).tolist(), (pos[keep] - block.base).tolist(), size.tolist()):
                if o != last:
                    units, last = unit.split(block.raw[o]), o
                segs.append(unit.join(units[p : p + n]))
            o = owner[keep]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(h[keep].view(np.int64)), pa.array(list(map(digest, segs)), pa.binary()), pa.array(at[keep].astype(np.int32)),
                    pa.array(key[o]), pa.array(tkey[o]), pa.array(pos[keep]), pa.array(size.astype(np.int32)),
                    pa.array(list(map(len, segs)), pa.int32()), pa.array(segs, pa.binary()),
                ],
                ["h", "g", "at", "dkey", "tkey", "pos", "n", "size", "seg"],
            )


def recurring_segments(docs: DataFrame, unit: Unit) -> list[DataFrame]:
    """A row for each segment whose anchor occurs more than once in ``docs`` (of
    ``common.keyed``): h anchor, g digest of the segment's text, at the anchor's distance
    from its first unit, dkey and tkey of its document, pos its first unit there, n its
    units, size its bytes, seg its text (words joined by one space). Tables in the shared folder; those
    after the first hold refined anchors. No anchor has over CROWD different texts."""
    anchors = docs.select("dkey", "tkey", "text").mapInArrow(partial(_anchors, unit), "h long, dkey long, tkey long, pos array<int>")
    # a table of its own, so that Spark can split the join where many texts share an anchor
    twice = cut(anchors.groupBy("h").agg(F.sum(F.size("pos")).alias("c")).where("c > 1").select("h"))
    # sets, since rows that repeat a document have the same places
    wanted = anchors.join(twice, "h").groupBy("dkey", "tkey").agg(F.flatten(F.collect_set("pos")).alias("wanted"))
    left = cut(docs.select("dkey", "tkey", "text").join(wanted, ["dkey", "tkey"]).mapInArrow(partial(_texts_of, unit), SEGMENT))
    parts = []
    most = unit.window - unit.gram  # of a window's distances to its anchor
    for level in range(most.bit_length() - 1, -1, -1):
        crowd = crowded(left)
        if crowd.isEmpty():
            break
        parts.append(left.join(crowd, "h", "left_anti"))
        halves = cut(left.join(crowd, "h").mapInArrow(partial(_halves, unit, 1 << level), SEGMENT))
        met = cut(halves.groupBy("h").agg(F.count("*").alias("c")).where("c > 1").select("h"))
        left = cut(halves.join(met, "h"))
    return [*parts, left]


def crowded(segments: DataFrame) -> DataFrame:
    """(h): anchors with over CROWD different segments, such as those at the edges of a
    passage that a great many documents share. Equal segments meet in a partial
    aggregation. A segment of one window is its group's only text."""
    texts = segments.groupBy("h", "g").agg(F.max("size").alias("size")).groupBy("h").agg(F.count("*").alias("c"), F.sum("size").alias("size"))
    return cut(texts.where((F.col("c") > CROWD) | ((F.col("c") > 1) & (F.col("size") > CROWD_BYTES))).select("h"))


def _halves(unit: Unit, step: int, batches):
    """Segments cut by their windows' distances to the anchor, in ranges of ``step``
    distances. All windows of a range have its core in common, which takes the anchor's
    place as the key of the group."""
    for batch in batches:
        rows = []
        for h, at, dkey, tkey, pos, n, seg in zip(*(batch.column(c).to_pylist() for c in ("h", "at", "dkey", "tkey", "pos", "n", "seg"))):
            units = unit.split(seg)
            for low in range((at - n + unit.window) // step * step, at + 1, step):
                high = min(low + step - 1, unit.window - unit.gram)
                core = unit.join(units[at - low : at - high + unit.window])
                key = hashlib.blake2b(b"%d %d " % (h, low) + core, digest_size=8).digest()
                first, last = max(at - high, 0), min(at - low, n - unit.window)
                part = unit.join(units[first : last + unit.window])
                rows.append((int.from_bytes(key, "little", signed=True), digest(part), at - first, dkey, tkey, pos + first, last - first + unit.window, len(part), part))
        yield _segment_rows(rows)


def chunks(batches, most: int):
    """Chunks of rows (as Arrow tables) of about ``most`` bytes of segment text that never
    cut through an anchor's rows."""
    held, size, last = [], 0, None
    for batch in batches:
        h = np.asarray(batch.column("h"))
        grown = size + np.cumsum(np.asarray(pa.compute.binary_length(batch.column("seg"))).astype(np.int64))
        new = np.concatenate(([last is None or h[0] != last], h[1:] != h[:-1])) if len(h) else np.zeros(0, bool)
        at, base = 0, 0
        for i in np.flatnonzero(new).tolist():
            before = int(grown[i - 1]) if i else size
            if before - base >= most:
                if i > at:
                    held.append(batch.slice(at, i - at))
                yield pa.Table.from_batches(held)
                held, at, base = [], i, before
        if at < len(h):
            held.append(batch.slice(at))
            size, last = int(grown[-1]) - base, h[-1]
    if held:
        yield pa.Table.from_batches(held)


def by_document(parts: list[DataFrame]) -> DataFrame:
    """(dkey, tkey, cuts) from rows of (dkey, tkey, cuts array<struct<pos, n>>): all cuts of
    a document, each once, so that rows that repeat it add nothing."""
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return found.groupBy("dkey", "tkey").agg(F.flatten(F.collect_set("cuts")).alias("cuts"))
