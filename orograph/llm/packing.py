"""Operator 2: sum-of-squares online packing into windows of at most 2048 tokens.

A document's ids are cut into full windows, which need no packing, and a remainder. The
remainders are placed online: into the fill level that minimises the sum of squared
counts of partially filled windows, which a level array tracks (``Level``). Remainders
stay whole, unless over OPEN windows are partially filled: then those that the array
names may also be filled up, and the rest of the remainder is placed like a document.
Each task packs its own partition, with memory bounded by its open windows. When its rows
end, the pieces of the emptiest windows are placed into the others in the same way, so
that a task pads one sequence at most.

Ids come from a tokenizer file (``Tokenizer.from_file``), special tokens not added, and
an end id. Tokens never cross ASCII white space, so ids are looked up by white-space
separated chunk in a cache of bounded bytes; new chunks are merged by tiktoken with the same
vocabulary where ``ranks_of`` shows that this gives the same ids, else by the tokenizer.

Defined results: null and empty texts have the end id only; repeated rows and null ids
are packed like any other; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import array
import json
import re
import zlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from orograph.llm import text as X
from orograph.llm.common import per_worker, raw_texts, spans

WINDOW = 2048
END_ID = 1
#: Partially filled windows of a task, from which on documents may be cut to fill one up.
OPEN = 256
#: Bytes of text that are turned into ids at once.
PART = 1 << 19
#: Bytes of a worker's cache of chunks, as the interpreter counts them; emptied when full.
#: Chunks of more than KEEP bytes aren't kept beyond the texts that have them.
CACHE, KEEP = 128 << 20, 64
#: What an entry takes beside its bytes: two headers and its place in the table.
ENTRY = 170
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


#: Chunks that the fast path leaves to the tokenizer itself: those with more than printable
#: ASCII and Latin letters, which NFC leaves alone and which have one lower-case letter each.
ODD = re.compile("(?m)^.*(?:[^!-~\n\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]|<[|]).*$")
#: The normaliser and the pre-tokeniser's pattern that the fast path knows.
KNOWN_STEPS = ["NFC", "Replace", "Lowercase"]
KNOWN_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: The same words for other chunks, one on each line.
PLAIN_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|[0-9]|(?:[^\w\n]|_)+")
WORD_END = "</w>"


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable bytes
    for themselves, the others in order from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


def ranks_of(path: str) -> dict[bytes, int] | None:
    """Ids by bytes, a line feed for the end of a word, if merging by the result's id
    gives what the file's merge rules give; else None.

    It does when ids follow the order of the rules and each entry, cut into letters and
    merged by the rules, comes out as itself: were two neighbours joined that no rule
    joins, then their join, started from letters, would go the same way and stop there."""
    with open(path, encoding="utf-8") as file:
        made = json.load(file)
    model, steps = made["model"], (made.get("normalizer") or {}).get("normalizers", [])
    split = (made.get("pre_tokenizer") or {}).get("pretokenizers", [{}])[0]
    if model.get("type") != "BPE" or model.get("end_of_word_suffix") != WORD_END or [s.get("type") for s in steps] != KNOWN_STEPS or split.get("pattern") != {"Regex": KNOWN_WORDS}:
        return None
    special = {t["content"] for t in made["added_tokens"]}
    vocab = {k: i for k, i in model["vocab"].items() if k not in special}
    rules = {tuple(m if isinstance(m, list) else m.split(" ")): i for i, m in enumerate(model["merges"])}
    if any(vocab[a + b] != 512 + i for (a, b), i in rules.items()):
        return None
    for entry in vocab:
        parts = list(entry.removesuffix(WORD_END))
        if entry != WORD_END and entry.endswith(WORD_END):
            parts[-1] += WORD_END
        while len(parts) > 1:
            rank, at = min((rules.get(p, len(rules)), k) for k, p in enumerate(zip(parts, parts[1:])))
            if rank == len(rules):
                return None
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
    letter = byte_letters()
    return {bytes(letter[c] for c in k.removesuffix(WORD_END)) + b"\n" * k.endswith(WORD_END): i for k, i in vocab.items()}


class Ids:
    """Ids of texts as bytes (little-endian unsigned 32 bits)."""

    def __init__(self, path: str, ranks: dict[bytes, int] | None):
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path).encode_batch_fast
        self.fast = None
        self.chunks: dict[bytes, bytes] = {}
        self.held = 0
        if ranks:
            import tiktoken

            self.fast = tiktoken.Encoding("words", pat_str=r"[^\n]+\n|\n", mergeable_ranks=ranks, special_tokens={}).encode_to_numpy
            self.feed = ranks[b"\n"]

    def learn(self, new: list[bytes]) -> dict[bytes, bytes]:
        """The ids of chunks."""
        known, rest = {}, new
        if self.fast:
            lines = b"\n".join(new).decode("utf-8", "replace")
            rest = [x.encode() for x in ODD.findall(lines)]
            odd = set(rest)
            plain = [w for w in new if w not in odd] if odd else new
            if plain:
                if odd:
                    lines = b"\n".join(plain).decode("utf-8", "replace")
                # a line feed ends each word, one more ends each chunk
                ids = self.fast(PLAIN_WORDS.sub("\\g<0>\n", lines.lower() + "\n"))
                stops = np.flatnonzero(ids == self.feed)
                ids = np.delete(ids, stops).astype("<u4").tobytes()
                stops = (4 * (stops - np.arange(len(stops)))).tolist()
                known.update(zip(plain, map(ids.__getitem__, map(slice, [0, *stops], stops))))
        if rest:
            for w, e in zip(rest, self.slow([w.decode("utf-8", "replace") for w in rest], add_special_tokens=False)):
                known[w] = array.array("I", e.ids).tobytes()
        return known

    def of(self, raw: list[bytes]) -> list[bytes]:
        known, join = self.chunks, b"".join
        if self.held > CACHE:
            known.clear()
            self.held = 0
        get = known.get
        out, left = [], []
        for i, t in enumerate(raw):
            words = t.split()
            try:
                out.append(join(map(get, words)))
            except TypeError:  # a chunk that isn't known yet
                out.append(b"")
                left.append((i, words))
        new = list({w for _, words in left for w in words if w not in known})
        long: dict[bytes, bytes] = {}  # texts come in parts of bounded size, so these are bounded, too
        for i, j in spans([len(w) for w in new], PART):
            for w, ids in self.learn(new[i:j]).items():
                if len(w) > KEEP:
                    long[w] = ids
                else:
                    known[w] = ids
                    self.held += ENTRY + len(w) + len(ids)
        for i, words in left:
            out[i] = join(long[w] if len(w) > KEEP else known[w] for w in words) if long else join(map(get, words))
        return out


class Level:
    """Open windows by fill level, and the sum-of-squares choice among them."""

    def __init__(self, window: int, most: int = OPEN):
        self.window, self.most = window, most
        self.count = np.zeros(window, np.int64)
        self.open: list[list] = [[] for _ in range(window)]
        self.number = self.partial = 0

    def choose(self, length: int, cutting: bool, opening: bool) -> int:
        """The level (0: a new window) that leaves the least sum of squared counts of
        partially filled windows, the fullest of equals. A piece of ``length`` tokens,
        with 0 < length < window, goes in whole, or fills the level up if ``cutting``."""
        most, gap = np.iinfo(np.int64).max, self.window - length
        change = np.full(self.window, most)
        # by moving a window from a level to another: 2 (count there - count here) + 2
        change[:gap] = 2 * (self.count[length:] - self.count[:gap]) + 2
        # by filling a window up
        change[gap : self.window if cutting else gap + 1] = 1 - 2 * self.count[gap : self.window if cutting else gap + 1]
        change[self.count == 0] = most
        change[0] = 2 * self.count[length] + 1 if opening else most
        return self.window - 1 - int(np.argmin(change[::-1]))

    def place(self, piece: tuple, opening: bool = True):
        """Places a piece (doc_id, start, ids as bytes, tokens of the document). Yields the
        (sequence, pieces) that this fills."""
        doc_id, start, ids, total = piece
        while ids:
            opens = opening or not self.partial
            level = self.choose(len(ids) // 4, self.partial > self.most or not opens, opens)
            if level:
                seq, pieces = self.take(level)
            else:
                seq, pieces = self.number, []
                self.number += 1
            part = ids[: 4 * (self.window - level)]
            pieces.append((doc_id, start, part, total))
            level, start, ids = level + len(part) // 4, start + len(part) // 4, ids[len(part) :]
            if level == self.window:
                yield seq, pieces
            else:
                self.open[level].append((seq, pieces))
                self.count[level] += 1
                self.partial += 1

    def take(self, level: int) -> tuple[int, list]:
        self.count[level] -= 1
        self.partial -= 1
        return self.open[level].pop()

    def end(self):
        """Yields what is left, with one window at most that isn't full."""
        while self.partial:
            seq, pieces = self.take(int(np.flatnonzero(self.count)[0]))
            if not self.partial:
                yield seq, pieces
                return
            for p in pieces:
                yield from self.place(p, opening=False)


def _whole_ids(ids: Ids, raw: list[bytes]) -> list[bytes]:
    """Ids of texts; those of a long one part by part, since no token crosses white space."""
    if len(raw) > 1 or len(raw[0]) <= PART:
        return ids.of(raw)
    return [b"".join(ids.of([p])[0] for p in X.pieces(raw[0], PART))]


def _pack(path: str, ranks, window: int, end_id: int, batches):
    task = TaskContext.get()
    base = (task.partitionId() if task else 0) << 36
    ids, end = per_worker(f"ids {path}", partial(Ids, path, ranks.value)), array.array("I", [end_id]).tobytes()
    level = Level(window)

    def rows(made):
        cols = list(zip(*made)) or [()] * 7
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], PIECES.replace(" long", "").split(", "))

    made: list[tuple] = []
    for batch in batches:
        raw, doc_ids = raw_texts(batch), batch.column("doc_id").to_pylist()
        for i, j in spans([len(t) for t in raw], PART):
            for doc_id, b in zip(doc_ids[i:j], _whole_ids(ids, raw[i:j])):
                b += end
                total = len(b) // 4
                full = total - total % window
                for s in range(0, full, window):
                    made.append((doc_id, s, window, zlib.crc32(b[4 * s : 4 * (s + window)]), total, base + level.number, 0))
                    level.number += 1
                if total > full:
                    for seq, pieces in level.place((doc_id, full, b[4 * full :], total)):
                        made += _laid(pieces, base + seq)
        if made:
            yield rows(made)
            made = []
    for seq, pieces in level.end():
        made += _laid(pieces, base + seq)
    yield rows(made)


def _laid(pieces: list, seq: int) -> list[tuple]:
    out, at = [], 0
    for doc_id, start, b, total in pieces:
        out.append((doc_id, start, len(b) // 4, zlib.crc32(b), total, seq, at))
        at += len(b) // 4
    return out


def pack(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """A row for each piece of a document of ``docs`` (doc_id, text): doc_id, start (its
    document's ids before it), length, ids_crc32, doc_tokens, sequence_id, offset.
    ``tokenizer`` is the path of a tokenizer file that all workers can read."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    ranks = docs.sparkSession.sparkContext.broadcast(ranks_of(str(tokenizer)))  # as large as the vocabulary
    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(partial(_pack, str(tokenizer), ranks, window, end_id), PIECES)
