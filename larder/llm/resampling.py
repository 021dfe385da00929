"""Importance resampling towards a target's word distribution, with word tries local to each task.

Features are runs of one and two words, hashed into buckets. A task inserts its texts into a trie of
words: a node of the first level is a word, one of the second a word after a word. A node holds the
CRC of the path that leads to it, carried on from its parent's, and how often it was walked. Only
bucket totals leave a task: as many numbers as there are buckets, however many texts it read.

The gain of a bucket is the logarithm of the target's share over the corpus's. To score documents,
tasks walk tries again whose nodes carry the gain of their bucket. The draw keeps the highest scores
with a Gumbel term seeded by the document's id, which samples without replacement in proportion to
the weights; ranks come from counts by score, so nothing is sorted in one task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.common import checkpoint, ship, small_batches, text_bytes, text_or_empty

ship(__name__)

BUCKETS = 10_000
#: A trie with more nodes than this is emptied into the bucket totals and begun anew.
NODES = 1 << 20
#: Bytes of texts that are walked at once, and of a word whose CRC is taken alone.
PIECE, LONG_WORD = 2 << 20, 64
#: Scores are numbered in blocks of this width.
BLOCK = 256


#: Digits, small letters and bytes of other scripts are parts of words, A-Z become small, every other ASCII byte parts words.
_WORDS = np.array([b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256)], np.uint8)


def _crc_steps() -> np.ndarray:
    """What one zero byte makes of each of the 32 bits of a CRC state, as columns of a matrix over two elements."""
    out = np.zeros(32, np.uint64)
    for bit in range(32):
        state = 1 << bit
        for _ in range(8):
            state = (state >> 1) ^ (0xEDB88320 if state & 1 else 0)
        out[bit] = state
    return out


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


_CRC = _crc_table()


def crc_of_words(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The CRC of each word, one byte of all words at a time; long words one by one."""
    order = np.argsort(-np.minimum(lengths, LONG_WORD + 1).astype(np.int16), kind="stable")
    at, size = starts[order], lengths[order]
    state = np.full(len(at), 0xFFFFFFFF, np.uint32)
    n_long = int((size > LONG_WORD).sum())
    left = np.searchsorted(-size, -np.arange(LONG_WORD), "left")  # words with more than k bytes
    for k in range(int(size.max()) if len(size) and not n_long else LONG_WORD if len(size) else 0):
        own = slice(n_long, left[k])
        state[own] = _CRC[(state[own] ^ flat[at[own] + k]) & 255] ^ (state[own] >> 8)
    state ^= np.uint32(0xFFFFFFFF)
    for i in range(n_long):
        state[i] = zlib.crc32(flat[at[i] : at[i] + size[i]].tobytes())
    out = np.empty_like(state)
    out[order] = state
    return out


class Shifts:
    """CRC states carried over n further bytes, by four tables for each n: crc(a + b) = shift(crc(a), len(b)) ^ crc(b)."""

    def __init__(self):
        self._columns = [np.array([1 << k for k in range(32)], np.uint64)]
        self._tables: dict[int, np.ndarray] = {}

    def _table(self, n: int) -> np.ndarray:
        if n not in self._tables:
            step = _crc_steps()
            while len(self._columns) <= n:
                last, moved = self._columns[-1], np.zeros(32, np.uint64)
                for k in range(32):
                    moved ^= np.where((last >> np.uint64(k)) & np.uint64(1), step[k], np.uint64(0))
                self._columns.append(moved)
            column, value = self._columns[n], np.arange(256, dtype=np.uint64)
            table = np.zeros((4, 256), np.uint64)
            for part in range(4):
                for k in range(8):
                    table[part] ^= np.where((value >> np.uint64(k)) & np.uint64(1), column[8 * part + k], np.uint64(0))
            self._tables[n] = table.astype(np.uint32)
        return self._tables[n]

    def carried(self, state: np.ndarray, n: np.ndarray) -> np.ndarray:
        out = np.empty(len(state), np.uint32)
        order = np.argsort(n, kind="stable")
        lengths, starts = np.unique(n[order], return_index=True)
        for length, at, end in zip(lengths.tolist(), starts.tolist(), np.append(starts, len(order))[1:].tolist(), strict=True):
            rows = order[at:end]
            if length > 64:  # rare: by pieces of 64, so that tables stay few
                moved = state[rows]
                for step in [64] * (length // 64) + [length % 64]:
                    moved = self._moved(moved, step)
                out[rows] = moved
            else:
                out[rows] = self._moved(state[rows], length)
        return out

    def _moved(self, s: np.ndarray, n: int) -> np.ndarray:
        t = self._table(n)
        return t[0][s & 255] ^ t[1][(s >> 8) & 255] ^ t[2][(s >> 16) & 255] ^ t[3][s >> 24]


class Trie:
    """A trie of one or two words. Nodes hold the CRC state of their path, its count, and a gain if gains are given.

    Words of equal CRC and length are one node: whatever follows them, their paths fall into the same buckets.
    """

    def __init__(self, buckets: int, gains: np.ndarray | None = None):
        self.buckets, self.gains = buckets, gains
        self.totals = np.zeros(buckets, np.int64)
        self.shifts = Shifts()
        self._clear()

    def _clear(self) -> None:
        self.roots, self.number = np.zeros(0, np.int64), np.zeros(0, np.int64)  # sorted keys and the numbers of their nodes
        self.state, self.tail, self.length, self.count = np.zeros(0, np.uint32), np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pairs, self.pair_state, self.pair_count = np.zeros(0, np.int64), np.zeros(0, np.uint32), np.zeros(0, np.int64)

    @staticmethod
    def _fresh(known: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the sorted ``keys`` aren't known, and where each belongs."""
        at = np.searchsorted(known, keys)
        new = np.ones(len(keys), bool)
        inside = at < len(known)
        new[inside] = known[at[inside]] != keys[inside]
        return new, at

    def _numbers(self, words: np.ndarray) -> np.ndarray:
        """First-level nodes of words (length << 32 | CRC)."""
        key, back = np.unique(words, return_inverse=True)
        new, at = self._fresh(self.roots, key)
        fresh = key[new]
        if len(fresh):
            crc, length = (fresh & 0xFFFFFFFF).astype(np.uint32), (fresh >> 32) + 1
            space = np.full(len(fresh), zlib.crc32(b" "), np.uint32)
            self.roots = np.insert(self.roots, at[new], fresh)
            self.number = np.insert(self.number, at[new], np.arange(len(self.state), len(self.state) + len(fresh)))
            self.state, self.length = np.append(self.state, crc), np.append(self.length, length)
            self.tail = np.append(self.tail, self.shifts.carried(space, length - 1) ^ crc)
            self.count = np.append(self.count, np.zeros(len(fresh), np.int64))
        return self.number[np.searchsorted(self.roots, key)][back]

    def walk(self, words: np.ndarray, breaks: np.ndarray, seen: int = 0) -> np.ndarray:
        """Walk every run of one and two words; the gain of each word and of the pair that it ends (zeros without gains).

        ``breaks`` marks words that begin a text; the first ``seen`` words were walked before.
        """
        nodes = self._numbers(words)
        self.count += np.bincount(nodes[seen:], minlength=len(self.count))
        joined = np.flatnonzero(~breaks[1:])
        key, back, often = np.unique((nodes[joined] << 32) | nodes[joined + 1], return_inverse=True, return_counts=True)
        new, at = self._fresh(self.pairs, key)
        self.pair_count[at[~new]] += often[~new]
        first, second = key[new] >> 32, key[new] & 0xFFFFFFFF
        state = self.shifts.carried(self.state[first], self.length[second]) ^ self.tail[second]
        self.pairs = np.insert(self.pairs, at[new], key[new])
        self.pair_state = np.insert(self.pair_state, at[new], state)
        self.pair_count = np.insert(self.pair_count, at[new], often[new])
        gain = np.zeros(len(nodes), np.int64)
        if self.gains is not None:
            gain[seen:] = self.gains[self.state % self.buckets][nodes[seen:]]
            gain[joined + 1] += self.gains[self.pair_state[np.searchsorted(self.pairs, key)] % self.buckets][back]
        if len(self.pairs) + len(self.state) > NODES:
            self.drain()
        return gain

    def drain(self) -> np.ndarray:
        """Add the nodes' counts to the bucket totals and begin a new trie; the totals so far."""
        self.totals += np.bincount(self.state % self.buckets, weights=self.count, minlength=self.buckets).astype(np.int64)
        self.totals += np.bincount(self.pair_state % self.buckets, weights=self.pair_count, minlength=self.buckets).astype(np.int64)
        self._clear()
        return self.totals


def words_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words as length << 32 | CRC, how many each row has)."""
    flat = _WORDS[raw]
    edge = np.zeros(len(flat) + 1, bool)  # a word never crosses a row
    edge[offsets] = True
    inside = np.concatenate([[False], flat != 32, [False]])
    change = inside[1:-1]
    starts = np.flatnonzero(change & (~inside[:-2] | edge[:-1]))
    lengths = np.flatnonzero(change & (~inside[2:] | edge[1:])) + 1 - starts
    words = (lengths << 32) | crc_of_words(flat, starts, lengths).astype(np.int64)
    return words, np.diff(np.searchsorted(starts, offsets))


def _walked(batches: Iterator[pa.RecordBatch], trie: Trie, text: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(batch, words, gain) with the numbers of each row; texts of a batch are walked together, a long one piece by piece."""
    for batch in small_batches(batches, text, size=PIECE):
        raw, offsets = text_bytes(batch.column(text))
        n, gain = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
        if len(batch) == 1 and len(raw) > PIECE:
            last, at = np.zeros(0, np.int64), 0
            while at < len(raw):
                stop = at + PIECE
                while stop < len(raw) and _WORDS[raw[stop]] != 32:
                    stop += 1
                words, _ = words_of(raw[at:stop], np.array([0, len(raw[at:stop])]))
                n[0] += len(words)
                breaks = np.zeros(len(words) + len(last), bool)
                breaks[:1] = True
                gain[0] += trie.walk(np.concatenate([last, words]), breaks, len(last)).sum()
                last, at = words[-1:] if len(words) else last, stop
        else:
            words, n = words_of(raw, offsets)
            breaks = np.zeros(len(words), bool)
            ends = np.cumsum(n)
            breaks[(ends - n)[n > 0]] = True
            sums = np.concatenate([[0], np.cumsum(trie.walk(words, breaks))])
            gain = sums[ends] - sums[ends - n]
        yield batch, n, gain


def bucket_totals(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall into each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(buckets)
        for _ in _walked(batches, trie, 0):
            pass
        totals = trie.drain()
        found = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(totals[found])], ["bucket", "n"])

    summed = texts.select(text_or_empty().alias("text")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for bucket, n in summed.collect():  # as many rows as there are buckets at most
        out[bucket] = n
    return out


def gains_of(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * log of the target's share over the corpus's) of each bucket, with one feature added to each."""
    n = len(corpus)
    ratio = (target + 1.0) * (int(corpus.sum()) + n) / ((corpus + 1.0) * (int(target.sum()) + n))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def weigh(docs: DataFrame, gains: np.ndarray) -> DataFrame:
    """(doc_id, n_features, n_words, weight): weight is the floored mean gain of a text's features, 0 without any."""
    buckets = len(gains)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(buckets, gains)
        for batch, words, gain in _walked(batches, trie, 1):
            features = np.maximum(2 * words - 1, 0)
            weight = np.floor_divide(gain, np.maximum(features, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(features), pa.array(words), pa.array(weight)], ["doc_id", "n_features", "n_words", "weight"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, "doc_id long, n_features long, n_words long, weight long")


def gumbel(doc_id: Column, seed: int) -> Column:
    """floor(1000 * a Gumbel variable) drawn from a hash of the seed and the id; null without an id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def draw(weighed: DataFrame, percent: int, least_words: int, seed: int) -> DataFrame:
    """(doc_id, n_features, weight, score, rank): rank 1 is the highest score, ties go to the smaller doc_id.

    Of the N rows with an id and at least ``least_words`` words, floor(percent * N / 100) are drawn;
    the rank of the others is null, and so is the score of rows without an id.
    """
    rows = checkpoint(weighed.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)))
    able = F.coalesce((F.col("n_words") >= least_words) & F.col("score").isNotNull(), F.lit(False))
    # scores are whole thousandths of logarithms, so there are some ten thousand different ones at any size
    often = checkpoint(rows.where(able).groupBy("score").agg(F.count("*").alias("n")).withColumn("block", F.floor(F.col("score") / BLOCK)))
    down = Window.orderBy(F.desc("block"))  # of some hundred blocks
    above = F.coalesce(F.sum("n").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("above")
    drawn = F.floor(F.sum("n").over(down.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) * percent / 100).alias("drawn")
    blocks = often.groupBy("block").agg(F.sum("n").alias("n")).select("block", above, drawn)
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("block").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = often.withColumn("inside", inside).join(F.broadcast(blocks), "block")
    before = before.select("score", (F.col("above") + F.col("inside")).alias("before"), "drawn").where("before < drawn")
    place = F.row_number().over(Window.partitionBy("score").orderBy("doc_id"))
    ranked = rows.where(able).join(before, "score", "left").withColumn("rank", F.when(F.col("before").isNotNull(), F.col("before") + place))
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= F.col("drawn"), F.col("rank")))
    names = ["doc_id", "n_features", "weight", "score"]
    return ranked.select(*names, "rank").unionByName(rows.where(~able).select(*names, F.lit(None).cast("long").alias("rank")))


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, seed: int = 7, buckets: int = BUCKETS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_features, weight, score, rank.

    ``target`` (text) is the distribution drawn towards. Null texts are empty: no features, weight 0.
    Rows without a doc_id count in the corpus's features but have no score and can't be drawn.
    Repeated rows are documents of their own. Without documents the result is empty; without target
    texts its features count as one in each bucket. Other columns are not read.
    """
    return draw(weigh(docs, gains_of(bucket_totals(docs, buckets), bucket_totals(target, buckets))), percent, least_words, seed)


#: The CRC of a text's bytes, eight steps for each byte, for the SQL below.
_BIT = "CASE WHEN {x} & 1 = 1 THEN xor({x} >> 1, 3988292384) ELSE {x} >> 1 END"


def oracle(percent: int, least_words: int, seed: int, buckets: int = BUCKETS) -> str:
    """The same in DuckDB SQL; CRCs come from a table of 256 entries that the SQL builds by the rule."""
    return rf"""
WITH RECURSIVE bits AS (
  SELECT i AS byte, i::BIGINT AS x, 0 AS step FROM range(256) t(i)
  UNION ALL SELECT byte, {_BIT.format(x='x')}, step + 1 FROM bits WHERE step < 8),
crc_table AS MATERIALIZED (SELECT list(x ORDER BY byte) AS t FROM bits WHERE step = 8),
texts AS (
  SELECT 'd' AS kind, doc_id AS id, row_number() OVER () AS row, coalesce(text, '') AS text FROM documents
  UNION ALL SELECT 'b', item_id, -row_number() OVER (), coalesce(text, '') FROM benchmark),
worded AS MATERIALIZED (
  SELECT kind, id, row, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
feature AS (
  SELECT kind, row, unnest(w) AS f FROM worded
  UNION ALL SELECT kind, row, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM worded),
counted AS MATERIALIZED (SELECT kind, row, f, count(*) AS c FROM feature GROUP BY kind, row, f),
hashed AS MATERIALIZED (
  SELECT f, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(f)), '..'), lambda h: ('0x' || h)::BIGINT)),
    lambda s, b: xor(s >> 8, t[(xor(s, b) & 255) + 1])), 4294967295::BIGINT) % {buckets} AS bucket
  FROM (SELECT DISTINCT f FROM counted), crc_table),
sums AS (
  SELECT bucket, sum(CASE WHEN kind = 'd' THEN c ELSE 0 END) AS s, sum(CASE WHEN kind = 'b' THEN c ELSE 0 END) AS t FROM counted JOIN hashed USING (f) GROUP BY bucket),
totals AS (SELECT sum(s) AS s_all, sum(t) AS t_all FROM sums),
gains AS (
  SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (s_all + {buckets})::DOUBLE / ((s + 1)::DOUBLE * (t_all + {buckets})::DOUBLE)))::BIGINT AS gain FROM sums, totals),
weights AS (SELECT row, sum(c) AS n, sum(c * gain) AS g FROM counted JOIN hashed USING (f) JOIN gains USING (bucket) WHERE kind = 'd' GROUP BY row),
scored AS (
  SELECT id AS doc_id, len(w) AS n_words, coalesce(n, 0)::BIGINT AS n_features,
    coalesce((g - ((g % n) + n) % n) // n, 0)::BIGINT AS weight,
    floor(-1000 * ln(-ln((('0x' || substr(sha256('{seed}:' || id), 1, 8))::BIGINT + 0.5)::DOUBLE / 4294967296)))::BIGINT AS noise
  FROM worded LEFT JOIN weights USING (row) WHERE kind = 'd'),
ranked AS (
  SELECT *, weight + noise AS score, row_number() OVER (PARTITION BY n_words >= {least_words} ORDER BY weight + noise DESC, doc_id) AS place,
    count(*) FILTER (WHERE n_words >= {least_words}) OVER () AS able FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= {least_words} AND place <= {percent} * able // 100 THEN place END AS rank FROM ranked
"""
