"""Operator 1: substring dedup by repeated-phrase automata.

1. Recurring passages are confirmed anchor by anchor (``recurring``). Documents are cut
   into segments, each with all windows of one anchor. Where an anchor has one segment
   text only, and that occurs at two places, the text is the passage; else the windows
   that occur at two places are.
2. Sharded Aho-Corasick automata: segments are dealt out by anchor; each task compiles an
   automaton (pyahocorasick) of the passages of every bounded chunk of anchors. Words are
   mapped to characters of a chunk's own alphabet, so matches are exact and start at words
   only.
3. All documents are streamed through the automata that can match in them, as segments:
   a passage can only occur in segments of its own anchor. Equal segments are streamed
   once, and what the automaton finds there is handed to every place that has the text.
4. What occurs earlier elsewhere is removed from each document; nothing else is.

Defined results: null and empty texts have no words; a document shorter than a window
keeps all; rows that repeat an id and its text count as one document (each row is
returned); texts that share an id are ordered by their hash; a null doc_id sorts first;
other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from functools import partial
from itertools import chain, groupby

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orograph.llm import recurring as R
from orograph.llm import text as X
from orograph.llm.common import cut, keyed, raw_texts

WINDOW = 20
CHUNK_BYTES = 1 << 20
KEPT = ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"]
#: Digits of a word's number: two or more characters, so that no node of an automaton has
#: many children. The first character of a word is in a range of its own.
DIGIT = 256
_CUTS = "array<struct<pos: long, n: long>>"
FOUND = f"h long, g binary, lo struct<dkey: long, tkey: long, pos: long>, every {_CUTS}, later {_CUTS}"


def _letters(texts: list[list[bytes]]) -> tuple[list[str], int]:
    """Texts with each word as ``width`` characters."""
    ids: dict[bytes, int] = {}
    for t in texts:
        for w in t:
            ids.setdefault(w, len(ids))
    width = 2
    while DIGIT**width < len(ids):
        width += 1
    number = np.fromiter((ids[w] for t in texts for w in t), np.int64)
    digits = np.stack([number // DIGIT**k % DIGIT for k in range(width - 1, -1, -1)], 1) + 0x100
    digits[:, 0] += DIGIT
    whole = digits.ravel().astype("<u4").tobytes().decode("utf-32-le")
    ends = np.cumsum([0, *map(len, texts)]) * width
    return [whole[a:b] for a, b in zip(ends.tolist(), ends[1:].tolist())], width


def _passages(texts: list[str], again: list[bool], anchors: list[int], size: int, width: int) -> set[str]:
    """What recurs among the texts of each anchor; ``again``: a text occurs twice itself."""
    found: set[str] = set()
    for _, rows in groupby(range(len(texts)), anchors.__getitem__):
        rows = list(rows)
        if len(rows) == 1:
            if again[rows[0]]:
                found.add(texts[rows[0]])
            continue
        seen: set[str] = set()
        for k in rows:
            own = {texts[k][i : i + size] for i in range(0, len(texts[k]) - size + 1, width)}
            found |= own if again[k] else own & seen
            seen |= own
    return found


def _runs(spans: list[tuple[int, int]]) -> list[dict]:
    """Sorted (from, to) as cuts, those that touch as one."""
    out: list[list[int]] = []
    for a, b in spans:
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [{"pos": a, "n": b - a} for a, b in out]


def _located(window: int, batches):
    """The places of all passages in each segment's text (``every``), and those that some
    other place precedes even where the segment occurs first (``later``)."""
    for table in R.chunks(batches, CHUNK_BYTES):
        texts, width = _letters([s.split(b" ") for s in table.column("seg").to_pylist()])
        passages = _passages(texts, table.column("again").to_pylist(), table.column("h").to_pylist(), window * width, width)
        if not passages:
            continue
        automaton = ahocorasick.Automaton()
        for p in passages:
            automaton.add_word(p, p)
        automaton.make_automaton()
        at = list(zip(*(table.column(c).to_pylist() for c in ("dkey", "tkey", "pos"))))
        hits: list[list] = []
        earliest: dict[str, tuple] = {}
        for t, (d, k, pos) in zip(texts, at):
            own = []
            for end, p in automaton.iter(t):
                place = (end + 1 - len(p)) // width
                own.append((place, place + len(p) // width, p))
                where = (d, k, pos + place)
                if where < earliest.get(p, (float("inf"),)):
                    earliest[p] = where
            hits.append(own)
        h, g = table.column("h").to_pylist(), table.column("g").to_pylist()
        rows = []
        for own, (d, k, pos), h1, g1 in zip(hits, at, h, g):
            if own:
                own.sort()
                later = [(a, b) for a, b, p in own if earliest[p] != (d, k, pos + a)]
                rows.append((h1, g1, {"dkey": d, "tkey": k, "pos": pos}, _runs([(a, b) for a, b, _ in own]), _runs(later)))
        cuts = pa.list_(pa.struct([("pos", pa.int64()), ("n", pa.int64())]))
        kinds = [pa.int64(), pa.binary(), pa.struct([("dkey", pa.int64()), ("tkey", pa.int64()), ("pos", pa.int64())]), cuts, cuts]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * 5, kinds)], ["h", "g", "lo", "every", "later"])


def _streamed(segments: DataFrame, window: int) -> DataFrame:
    """(dkey, tkey, cuts): what goes from each place of ``segments``."""
    at = F.struct("dkey", "tkey", "pos")
    once = segments.groupBy("h", "g").agg(F.min(at).alias("lo"), F.max(at).alias("hi"), F.first("seg").alias("seg"))
    dealt = once.select("h", "g", "lo.dkey", "lo.tkey", "lo.pos", (F.col("lo") != F.col("hi")).alias("again"), "seg").repartition(F.col("h")).sortWithinPartitions("h", "dkey", "tkey", "pos")
    found = cut(dealt.mapInArrow(partial(_located, window), FOUND))
    mine = F.when(at == F.col("lo"), F.col("later")).otherwise(F.col("every"))
    placed = F.transform(mine, lambda c: F.struct((c["pos"] + F.col("pos")).alias("pos"), c["n"].alias("n")))
    joined = segments.select("h", "g", "dkey", "tkey", "pos").join(found, ["h", "g"]).select("dkey", "tkey", placed.alias("cuts"))
    return cut(joined.where(F.size("cuts") > 0))


def _kept(with_text: bool, batches):
    for batch in batches:
        rows = []
        for raw, cuts in zip(raw_texts(batch), batch.column("cuts")):
            words = raw.split()
            n, removed = len(words), 0
            if cuts.is_valid and len(cuts):
                begins, ends = X.merged(np.asarray(cuts.values.field("pos")), np.asarray(cuts.values.field("n")))
                removed = int((ends - begins).sum())
                words = chain.from_iterable(X.without(words, begins, ends))
            kept = b" ".join(words)
            rows.append((n, removed, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace") if with_text else None))
        out = list(zip(*rows)) or [(), (), (), ()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()), pa.array(out[3], pa.string())],
            ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"],
        ).select(KEPT[: 5 if with_text else 4])


def remove_repeated_passages(docs: DataFrame, window: int = WINDOW, gram: int = 6, with_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept (words left, joined by a space)
    for each row of ``docs`` (doc_id, text). A word goes if it lies in a window of
    ``window`` words whose word sequence also starts earlier: in a smaller doc_id, or
    earlier in the same document."""
    docs = keyed(docs)
    segments = R.recurring_segments(docs, R.Unit(window, gram, True))
    cuts = R.by_document([_streamed(part, window) for part in segments])
    joined = docs.join(cuts, ["dkey", "tkey"], "left").select("doc_id", "text", "cuts")
    return joined.mapInArrow(partial(_kept, with_text), "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text)


#: DuckDB: all windows by their text, and the words of those that aren't the first.
ORACLE = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS MATERIALIZED (SELECT doc_id, i, md5(array_to_string(w[i:i + {WINDOW - 1}], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d WHERE len(w) >= {WINDOW})),
dup AS (SELECT g, min({{'doc_id': doc_id, 'i': i}}) AS lo FROM win GROUP BY g HAVING count(*) > 1),
later AS (SELECT doc_id, i FROM win JOIN dup USING (g) WHERE {{'doc_id': doc_id, 'i': i}} <> lo),
gone AS MATERIALIZED (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + {WINDOW})) AS p FROM later)),
n AS (SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS k FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d) ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256 FROM d LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
