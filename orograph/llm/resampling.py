"""Operator 12: importance resampling towards a target, by the algebra of CRCs.

The features of a text are its runs of one to ``most`` words, each as the CRC-32 of its
words joined by a space, modulo a number of buckets. No such run is ever put together: the
CRC of each word is computed once, and the CRC of a run and a word after it is

    crc(run + " " + word) = shift(crc(run + " "), length of word) xor crc(word)

where ``shift`` by so many zero bytes is a linear map over GF(2), a 32 x 32 matrix of bits.
``Shift`` holds such matrices for all short lengths and for powers of two; longer ones are
their products.

Documents are scanned twice: once for the counts by bucket of all documents (a task gives
a row for each bucket, ``groupBy`` adds them up), once for the weight of each document, the
mean of its buckets' log-ratios. A Gumbel number from the document's id is added, and the
documents with the highest sums are a sample drawn without replacement with probabilities
by weight. They are numbered by a range-partitioned sort and the sizes of its partitions,
so no task sees more than its range, whatever the number of equal scores.

Defined results: null and empty texts, and texts without words, have no features and weight
0; a null id counts as an empty one in the digest and comes first among equals; rows that
repeat an id are drawn one by one, equal scores by id, then by a hash of the text; texts of
the target without words add nothing, and an empty target or table is no error; other
columns ride along in ``resampled`` and are ignored by the query.
"""

from __future__ import annotations

import math
import zlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orograph.llm import text as X
from orograph.llm.common import cut, raw_texts, spans
from orograph.llm.decontaminate import word_table

#: Of the query: words of a feature at most, buckets, least words, percents drawn, seed.
WORDS, BUCKETS, LEAST, PERCENT, SEED = 2, 10_000, 20, 25, 7
#: Bytes of text that are worked on at once.
BLOCK = 1 << 20
#: Words up to so many bytes have a matrix of their own.
SHORT = 64
_POLYNOMIAL = 0xEDB88320


def _step_table() -> np.ndarray:
    """What the eight steps of a byte do to the register's low byte."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, t >> 1 ^ np.uint32(_POLYNOMIAL), t >> 1).astype(np.uint32)
    return t


STEP = _step_table()


def _columns_of_one_byte() -> np.ndarray:
    """The matrix (images of the 32 bits) of one zero byte."""
    bits = np.uint32(1) << np.arange(32, dtype=np.uint32)
    return STEP[bits & 0xFF] ^ bits >> 8


def times(columns: np.ndarray, values: np.ndarray) -> np.ndarray:
    """A matrix over GF(2), given by its columns, times each value as a vector of bits."""
    out = np.zeros_like(values)
    for k in range(32):
        out ^= columns[k] * (values >> np.uint32(k) & np.uint32(1))
    return out


class Shift:
    """crc(text + n zero bytes), but for the constant part, of crc(text)."""

    def __init__(self):
        one, power = _columns_of_one_byte(), np.uint32(1) << np.arange(32, dtype=np.uint32)
        short = []
        for _ in range(SHORT):
            short.append(power)
            power = times(one, power)
        # a matrix as four tables, by byte of the value, so that a product is four lookups
        self.short = np.stack([self._tables(m) for m in short])
        self.powers = [power]  # of SHORT, twice SHORT, ... zero bytes
        for _ in range(40):
            self.powers.append(times(self.powers[-1], self.powers[-1]))

    @staticmethod
    def _tables(columns: np.ndarray) -> np.ndarray:
        return np.stack([times(columns, np.arange(256, dtype=np.uint32) << np.uint32(8 * b)) for b in range(4)])

    def __call__(self, values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        low, high = lengths % SHORT, lengths // SHORT
        t = self.short
        out = t[low, 0, values & 0xFF] ^ t[low, 1, values >> 8 & 0xFF] ^ t[low, 2, values >> 16 & 0xFF] ^ t[low, 3, values >> 24]
        long, k = np.flatnonzero(high), 0
        while len(long):
            now = long[(high[long] >> k & 1) == 1]
            out[now] = times(self.powers[k], out[now])
            k += 1
            long = long[high[long] >> k > 0]
        return out


SHIFT = Shift()
_SPACE = np.uint32(zlib.crc32(b" "))


def word_crcs(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The CRC-32 of each word (a byte span of ``data``)."""
    out = np.zeros(len(start), np.uint32)
    order = np.argsort(-size, kind="stable")
    n = size[order]
    short = order[np.searchsorted(-n, -SHORT) :]
    for i in order[: len(order) - len(short)].tolist():
        out[i] = zlib.crc32(data[start[i] : start[i] + size[i]])
    at, left = start[short], size[short]
    crc = np.full(len(short), 0xFFFFFFFF, np.uint32)
    for k in range(int(left[0]) if len(left) else 0):  # longer words come first
        m = np.searchsorted(-left, -k)  # words of over k bytes
        crc[:m] = STEP[(crc[:m] ^ data[at[:m] + k]) & 0xFF] ^ crc[:m] >> 8
    out[short] = ~crc
    return out


def features(raw: list[bytes], most: int):
    """For blocks of texts, or of one long text: the number of the first text, the words of
    each text of the block that don't belong to a block before, and for each length of a
    run the CRCs of the runs and the numbers of their texts in the block."""
    for first, before, w in _blocks(raw, most):
        data, size = np.frombuffer(w.buf, np.uint8), w.end - w.start
        own = word_crcs(data, w.start, size)
        text = np.repeat(np.arange(len(w.ptr) - 1), np.diff(w.ptr))
        runs, crc, n = [], own, 1
        while True:
            of = text[: len(crc)]
            # a run stays inside its text; of a text that goes on, runs that end in the
            # words of the block before are known
            mine = (of == text[n - 1 :]) & (np.arange(n - 1, n - 1 + len(crc)) >= before)
            runs.append((crc[mine], of[mine]))
            if n == most or len(crc) < 2:
                break
            crc = SHIFT(SHIFT(crc[:-1], np.ones(len(crc) - 1, np.int64)) ^ _SPACE, size[n:]) ^ own[n:]
            n += 1
        yield first, np.diff(w.ptr) - before, runs


def _blocks(raw: list[bytes], most: int):
    """(number of the first text, words that a block before has, the block's words)."""
    make = partial(X.Words, table=word_table(), hashed=False)
    for i, j in spans([len(t) for t in raw], BLOCK):
        if j - i > 1 or len(raw[i]) <= BLOCK:
            yield i, 0, make([t.lower() for t in raw[i:j]])
            continue
        tail, before = b"", 0
        for piece in X.pieces(raw[i], BLOCK):
            w = make([tail + piece.lower()])
            yield i, before, w
            before = min(most - 1, len(w.start))
            tail = w.buf[w.start[len(w.start) - before] :] if before else b""


def _counted(most: int, buckets: int, batches):
    counts = np.zeros(buckets, np.int64)
    for batch in batches:
        for _, _, runs in features(raw_texts(batch), most):
            for crc, _ in runs:
                counts += np.bincount(crc % buckets, minlength=buckets)
    some = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(counts[some])], ["bucket", "n"])


def bucket_counts(texts: DataFrame, most: int = WORDS, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): features of all texts (column text) by bucket, those that occur."""
    each = texts.select(F.col("text").cast("string").alias("text")).mapInArrow(partial(_counted, most, buckets), "bucket int, n long")
    return each.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, most: int = WORDS, buckets: int = BUCKETS) -> np.ndarray:
    """The log-ratio of each bucket in thousandths: its share of the target, over its share
    of the documents, both with one added. ``buckets`` numbers, whatever the tables."""
    counts = []
    for texts in (docs, target):
        held = np.zeros(buckets, object)
        for r in bucket_counts(texts, most, buckets).collect():
            held[r.bucket] = r.n
        counts.append(held)
    (s, t), (total_s, total_t) = counts, (sum(c.tolist()) for c in counts)
    up, down = float(total_s + buckets), float(total_t + buckets)
    return np.array([math.floor(1000 * math.log(float(b + 1) * up / (float(a + 1) * down))) for a, b in zip(s.tolist(), t.tolist())], np.int64)


MADE = "n_words long, n_features long, weight long"


def _weighed(most: int, held, batches):
    gain = held.value
    for batch in batches:
        raw = raw_texts(batch, "t")
        words, count, total = (np.zeros(len(raw), np.int64) for _ in range(3))
        for first, new, runs in features(raw, most):
            texts = slice(first, first + len(new))
            words[texts] += new
            for crc, text in runs:
                n = np.bincount(text, minlength=len(new))
                upto = np.concatenate(([0], np.cumsum(gain[crc % len(gain)])))
                ends = np.cumsum(n)
                count[texts] += n
                total[texts] += upto[ends] - upto[ends - n]
        weight = total // np.maximum(count, 1)  # rounds down
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in batch.schema.names if c != "t"), *map(pa.array, (words, count, weight))], [*(c for c in batch.schema.names if c != "t"), "n_words", "n_features", "weight"])


def weigh(docs: DataFrame, gain: np.ndarray, most: int = WORDS, seed: int = SEED, keep: list[str] | None = None) -> DataFrame:
    """A struct ``row`` of the columns of ``docs`` (all, or ``keep``) beside doc_id, tie (a
    hash of the text), n_words, n_features, weight and score. ``gain``: of ``gains``."""
    held = docs.sparkSession.sparkContext.broadcast(gain)
    text = F.col("text").cast("string")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep or docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("tie"), text.alias("t"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name not in ("row", "t"))
    made = type(rows.schema)([rows.schema["row"], *type(rows.schema).fromDDL(f"{kinds}, {MADE}").fields])
    weighed = rows.mapInArrow(partial(_weighed, most, held), made)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    gumbel = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    return weighed.withColumn("score", F.col("weight") + gumbel)


def ranked(weighed: DataFrame, least: int = LEAST, percent: int = PERCENT) -> DataFrame:
    """The rows of ``weigh`` with rank: 1, 2, 3... for the drawn ones by falling score, then
    id; null for others. Drawn are ``percent`` percent of those with ``least`` words."""
    weighed = cut(weighed)
    fit = weighed.where(F.col("n_words") >= least)
    salt = F.xxhash64(F.monotonically_increasing_id()).alias("salt")  # rows that are equal in all else are dealt out, too
    order = [F.desc("score"), F.asc_nulls_first("doc_id"), F.asc("tie"), F.asc("salt")]
    placed = fit.select("*", salt).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    placed = cut(placed.drop("salt"))
    part = F.shiftrightunsigned("at", 33)
    sizes = {r.part: r.n for r in placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}  # a row for each partition
    before, starts = 0, []
    for p in sorted(sizes):
        starts.append((p, before))
        before += sizes[p]
    offsets = weighed.sparkSession.createDataFrame(starts, "part long, before long")
    drawn = percent * before // 100
    place = F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    numbered = placed.withColumn("part", part).join(F.broadcast(offsets), "part").withColumn("rank", F.when(place <= drawn, place)).drop("part", "before", "at")
    return numbered.unionByName(weighed.where(F.col("n_words") < least).withColumn("rank", F.lit(None).cast("long")))


def resampled(docs: DataFrame, target: DataFrame, most: int = WORDS, buckets: int = BUCKETS, least: int = LEAST, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """The rows of ``docs`` that are drawn, with all their columns. Only keys are sorted;
    rows that are equal in id and text to the last one drawn are taken, too."""
    gain = gains(docs, target, most, buckets)
    key = F.struct(-F.col("score"), F.col("doc_id").isNotNull(), F.coalesce("doc_id", F.lit(0)), "tie")
    drawn = ranked(weigh(docs.select("doc_id", "text"), gain, most, seed, ["doc_id"]), least, percent).where("rank is not null")
    last = drawn.agg(F.max_by(F.struct("score", "doc_id", "tie"), "rank").alias("k")).select("k.*").select(key.alias("last"))
    rows = weigh(docs, gain, most, seed).where(F.col("n_words") >= least)
    return rows.join(F.broadcast(last), key <= F.col("last")).select("row.*")  # one row is broadcast


def sample_rows(docs: DataFrame, target: DataFrame) -> DataFrame:
    """The rows of the contract."""
    return ranked(weigh(docs.select("doc_id", "text"), gains(docs, target), keep=["doc_id"])).select("doc_id", "n_features", "weight", "score", "rank")


_WORDS = "regexp_extract_all(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g'), '[^ ]+')"
#: DuckDB: features as strings, the CRC of each different one byte by byte.
ORACLE = f"""
WITH RECURSIVE steps AS (SELECT b AS b0, CAST(b AS BIGINT) AS c, 0 AS k FROM range(256) r(b)
  UNION ALL SELECT b0, CASE WHEN c & 1 = 1 THEN xor(c >> 1, {_POLYNOMIAL}) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8),
tab AS MATERIALIZED (SELECT list(c ORDER BY b0) AS t FROM steps WHERE k = 8),
d AS MATERIALIZED (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT {_WORDS} AS w FROM benchmark),
df AS MATERIALIZED (SELECT doc_id, unnest(w) AS f FROM d UNION ALL SELECT doc_id, w[i] || ' ' || w[i + 1] FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM d)),
bf AS MATERIALIZED (SELECT unnest(w) AS f FROM b UNION ALL SELECT w[i] || ' ' || w[i + 1] FROM (SELECT w, unnest(range(1, len(w))) AS i FROM b)),
names AS (SELECT f, hex(encode(f)) AS h FROM (SELECT f FROM df UNION SELECT f FROM bf)),
codes AS (SELECT f, list_transform(range(0, len(h) // 2), lambda i: 16 * (strpos('0123456789ABCDEF', upper(h[2 * i + 1])) - 1) + strpos('0123456789ABCDEF', upper(h[2 * i + 2])) - 1) AS bytes FROM names),
hashed AS MATERIALIZED (SELECT f, xor(list_reduce(bytes, lambda a, x: xor(a >> 8, t[xor(a & 255, x) + 1]), 4294967295), 4294967295) % {BUCKETS} AS bucket FROM codes, tab),
s AS (SELECT bucket, count(*) AS s FROM df JOIN hashed USING (f) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM bf JOIN hashed USING (f) GROUP BY bucket),
n AS (SELECT (SELECT count(*) FROM df) AS big_s, (SELECT count(*) FROM bf) AS big_t),
g AS MATERIALIZED (SELECT s.bucket, CAST(floor(1000 * ln(CAST(coalesce(t, 0) + 1 AS DOUBLE) * (big_s + {BUCKETS}) / (CAST(s + 1 AS DOUBLE) * (big_t + {BUCKETS})))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (bucket), n),
m AS (SELECT doc_id, count(*) AS n_features, sum(gain) AS total FROM df JOIN hashed USING (f) JOIN g USING (bucket) GROUP BY doc_id),
w AS (SELECT doc_id, len(w) AS n_words, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features, CAST(coalesce((total - ((total % n_features) + n_features) % n_features) // n_features, 0) AS BIGINT) AS weight,
  CAST('0x' || substr(sha256('{SEED}:' || doc_id), 1, 8) AS BIGINT) AS h FROM d LEFT JOIN m USING (doc_id)),
z AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM w),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS fit FROM z WHERE n_words >= {LEAST})
SELECT doc_id, n_features, weight, score, CAST(CASE WHEN rank <= {PERCENT} * fit // 100 THEN rank END AS BIGINT) AS rank FROM z LEFT JOIN r USING (doc_id)
"""
