"""Repeated passages by a depth-limited radix sort of suffixes.

A suffix is sorted only as far as the threshold: two suffixes that agree so far are one repeated
window. The sort goes by digits, the most significant first, and a group with one member leaves
after the digit that singled it out; what is left after the last digit are exactly the repeated
windows. Three digits are read:

1. The least hash of any ``GRAM`` bytes inside a window, its anchor. Equal windows have equal anchors
   at the same place, so an anchor seen once ends all windows that hold it. Neighbouring windows
   share an anchor, which makes them one row: some 200 bytes of text are a row of the first pass.
2. For anchors seen again, blocks of ``BLOCK`` windows at equal distance from the anchor: the bytes
   that all windows of a block share.
3. Single windows of the blocks that are still open.

With each digit goes the hash of all bytes that a row's windows cover. Rows that are equal in it are
equal in every window, so they are settled at once and one of them stands for all in later passes.
A pass counts keys and joins the counts to the rows; no group is ever gathered, however large.
Decisions rest on 128 bits of hashes of the windows' bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.llm.common import checkpoint, columns_of, free_names, mix64, ship, small_batches, text_bytes, text_or_empty

ship(__name__)

LENGTH = 400
#: Bytes of an anchor (at most half the length), and windows of a block.
GRAM, BLOCK = 32, 16
#: Windows of a text that are looked at together; the rows of longer texts end there.
PIECE = 1 << 16
_ROW = "inner long, outer long, k1 long, k2 long, span long, open boolean"


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base = 0x9E3779B97F4A7C15
    inverse = pow(base, -1, 1 << 64)
    up, down = np.full(n, base, np.uint64), np.full(n, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def packed(first: int, before: int, windows: int) -> int:
    """Windows that start at ``first`` and after it, as one number: their anchor stands ``before`` bytes after ``first``."""
    return first << 32 | before << 16 | windows


class Anchors:
    """Runs of neighbouring windows with one anchor each."""

    def __init__(self, length: int):
        if not 2 <= length < 1 << 16:
            raise ValueError("a window has 2 to 65535 bytes")
        self.length, self.gram = length, min(GRAM, length // 2)
        self.width = length - self.gram + 1  # grams of a window
        self.byte = np.random.default_rng(20250301).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.up, self.down = _powers(PIECE + length + 1)
        self.mask = np.uint64((1 << (PIECE + length).bit_length()) - 1)

    def of(self, data: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(first window, bytes from there to the anchor, windows, hash of the anchor) in order."""
        for at in range(0, max(0, len(data) - self.length + 1), PIECE):
            yield from self._piece(data[at : at + PIECE + self.length - 1], at)

    def _piece(self, data: np.ndarray, at: int) -> Iterator[tuple[int, int, int, int]]:
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.byte[data] * self.up[: len(data)], dtype=np.uint64, out=sums[1:])
        n = len(data) - self.gram + 1
        h = mix64((sums[self.gram :] - sums[: -self.gram]) * self.down[:n])
        # the leftmost least hash of each window: minima from block borders leftwards and rightwards
        cells = np.full(-(-n // self.width) * self.width, ~np.uint64(0))
        cells[:n] = (h & ~self.mask) | np.arange(n, dtype=np.uint64)
        cells = cells.reshape(-1, self.width)
        rightwards = np.minimum.accumulate(cells, axis=1).ravel()
        leftwards = np.minimum.accumulate(cells[:, ::-1], axis=1)[:, ::-1].ravel()
        windows = n - self.width + 1
        place = (np.minimum(leftwards[:windows], rightwards[self.width - 1 : self.width - 1 + windows]) & self.mask).astype(np.int64)
        firsts = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
        counts = np.diff(np.append(firsts, windows))
        yield from zip((firsts + at).tolist(), (place[firsts] - firsts).tolist(), counts.tolist(), h[place[firsts]].tolist(), strict=True)


def _long(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def keys(text: Column) -> list[Column]:
    """A text's identity in 128 bits."""
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(7), text).alias("k2")]


def first_digit(docs: DataFrame, length: int) -> DataFrame:
    """(inner, outer, k1, k2, span, open): a row for each run of windows with one anchor; outer hashes all their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        anchors = Anchors(length)
        for batch in small_batches(batches, 2):
            raw, offsets = text_bytes(batch.column(2))
            inner, outer, span, rows = [], [], [], []
            for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                data = raw[a:b]
                view = memoryview(data)
                for first, before, windows, anchor in anchors.of(data):
                    inner.append(anchor)
                    outer.append(xxhash.xxh3_64_intdigest(view[first : first + windows - 1 + length]))
                    span.append(packed(first, before, windows))
                rows.append(len(span))
            times = np.diff([0, *rows])
            k1, k2 = (np.repeat(batch.column(c).to_numpy(), times) for c in (0, 1))
            yield pa.RecordBatch.from_arrays([_long(inner), _long(outer), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(span, pa.int64()), pa.array(np.ones(len(span), bool))], ["inner", "outer", "k1", "k2", "span", "open"])

    long = docs.select(text_or_empty().alias("text")).where(F.octet_length("text") >= length)
    return long.select(*keys(F.col("text")), "text").mapInArrow(run, _ROW)


def next_digit(texts: DataFrame, length: int, block: int) -> DataFrame:
    """The same for blocks of windows at equal distance from their anchors, from (k1, k2, text, parts).

    ``parts`` holds (span, open). ``inner`` hashes the bytes that all windows of a block share, ``outer``
    those of the row's windows; with blocks of one window both are the window's, by two hashes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        digest = xxhash.xxh3_64_intdigest
        for batch in small_batches(batches, 2, rows=128):
            raw, offsets = text_bytes(batch.column(2))
            inner, outer, span, open_, times = [], [], [], [], []
            for i, parts in enumerate(batch.column(3).to_pylist()):
                view = memoryview(raw[offsets[i] : offsets[i + 1]])
                for part in parts:
                    first, before, windows = part["span"] >> 32, part["span"] >> 16 & 0xFFFF, part["span"] & 0xFFFF
                    anchor, least = first + before, before - windows + 1
                    for b in range(least // block, before // block + 1):
                        low, high = max(b * block, least), min(b * block + block - 1, before)
                        inner.append(digest(view[anchor - b * block : anchor - (b + 1) * block + 1 + length], 2 * b + 1))
                        outer.append(digest(view[anchor - high : anchor - low + length], 0x5851F42D4C957F2D + (high - low)))
                        span.append(packed(anchor - high, high, high - low + 1))
                        open_.append(part["open"])
                times.append(len(span))
            k1, k2 = (np.repeat(batch.column(c).to_numpy(), np.diff([0, *times])) for c in (0, 1))
            yield pa.RecordBatch.from_arrays([_long(inner), _long(outer), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(span, pa.int64()), pa.array(open_, pa.bool_())], ["inner", "outer", "k1", "k2", "span", "open"])

    return texts.select("k1", "k2", "text", "parts").mapInArrow(run, _ROW)


def _pass(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One pass: (settled spans that are repeated whole, representatives that need the next digit).

    Counts are tables of their own, so that a join of a common key with its count can be split. Groups of
    one outer hash are settled by the first count; only mixed ones are counted by both hashes.
    """
    often = rows.groupBy("inner").agg(F.count("*").alias("n"), F.min("outer").alias("lo"), F.max("outer").alias("hi")).where("n > 1")
    often = checkpoint(often.select("inner", (F.col("lo") != F.col("hi")).alias("mixed")))
    shared = checkpoint(rows.join(often, "inner").where("open or mixed"))
    mixed = shared.where("mixed")
    groups = checkpoint(mixed.groupBy("inner", "outer").agg(F.count("*").alias("n"), F.min(F.struct("k1", "k2", "span")).alias("one"), F.max("open").alias("open")))
    equal = groups.where("n > 1").select("inner", "outer")
    spans = ["k1", "k2", "span"]
    settled = shared.where("open and not mixed").select(spans).unionByName(mixed.where("open").join(equal, ["inner", "outer"]).select(spans))
    return checkpoint(settled.distinct()), groups.select("one.k1", "one.k2", "one.span", (F.col("open") & (F.col("n") == 1)).alias("open"))


def _parts(rows: DataFrame) -> DataFrame:
    """(k1, k2, parts): what is open of each text; as many as its windows at most."""
    return rows.groupBy("k1", "k2").agg(F.collect_list(F.struct("span", "open")).alias("parts"))


def repeated(docs: DataFrame, length: int = LENGTH, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(spans, texts): (k1, k2, runs) with the repeated runs of bytes of each different text, and the texts of those that aren't repeated whole.

    ``runs`` are starts and stops in turn, merged and in order.
    """
    settled, left = _pass(checkpoint(first_digit(docs, length)))
    windows = settled.select("k1", "k2", F.col("span").bitwiseAND(0xFFFF).alias("n"), F.lit(None).cast("struct<span:long,open:boolean>").alias("part"))
    known = windows.unionByName(left.select("k1", "k2", F.lit(0).cast("long").alias("n"), F.struct("span", "open").alias("part")))
    known = known.groupBy("k1", "k2").agg(F.sum("n").alias("n"), F.collect_list("part").alias("parts"))
    # copies of a text meet before the shuffle; a text is needed unless all its windows are settled and nobody compares with it
    bare = docs.select(text_or_empty().alias("text")).where(F.octet_length("text") >= length)
    whole = bare.groupBy(*keys(F.col("text"))).agg(F.first("text").alias("text"))
    texts = whole.join(known, ["k1", "k2"]).where((F.size("parts") > 0) | (F.col("n") < F.octet_length("text") - (length - 1)))
    texts = checkpoint(texts.select("k1", "k2", "text", "parts"))
    settled_blocks, left = _pass(next_digit(texts.where(F.size("parts") > 0), length, block))
    open_texts = texts.drop("parts").join(_parts(left), ["k1", "k2"])
    single = next_digit(open_texts, length, 1)
    equal = single.groupBy("inner", "outer").agg(F.count("*").alias("n")).where("n > 1").select("inner", "outer")
    settled_windows = single.where("open").join(equal, ["inner", "outer"]).select("k1", "k2", "span").distinct()
    every = settled.unionByName(settled_blocks).unionByName(settled_windows)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = [merged_runs(np.array(x, np.int64), length) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(runs, pa.list_(pa.int64()))], ["k1", "k2", "runs"])

    listed = every.groupBy("k1", "k2").agg(F.collect_list("span").alias("spans"))
    return listed.mapInArrow(merge, "k1 long, k2 long, runs array<long>"), texts.drop("parts")


def merged_runs(spans: np.ndarray, length: int) -> np.ndarray:
    """Starts and stops, in turn, of the bytes that packed windows cover."""
    starts = np.sort(spans)
    stops = (starts >> 32) + (starts & 0xFFFF) - 1 + length
    starts = starts >> 32
    reach = np.maximum.accumulate(stops)
    new = np.append(True, starts[1:] > reach[:-1])
    ends = np.append(np.flatnonzero(new)[1:] - 1, len(starts) - 1)
    return np.column_stack([starts[new], reach[ends]]).ravel()


def _kept(text: bytes, runs: list[int]) -> bytes:
    marks = [0, *runs, len(text)]
    return b"".join(text[a:b] for a, b in zip(marks[::2], marks[1::2], strict=True))


def _cut(spans: DataFrame, texts: DataFrame, digest: bool) -> DataFrame:
    """(k1, k2, n_removed, n_spans, kept): what is left of each text with repeats, its bytes or their SHA-256."""
    kind = "string" if digest else "binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = batch.column(2).to_pylist()
            kept = [b"" if t is None else _kept(t.encode(), r) for r, t in zip(runs, batch.column(3).to_pylist(), strict=True)]
            kept = [hashlib.sha256(k).hexdigest() for k in kept] if digest else kept
            removed = [sum(r[1::2]) - sum(r[::2]) for r in runs]
            arrays = [pa.array(removed, pa.int64()), pa.array([len(r) // 2 for r in runs], pa.int64()), pa.array(kept, pa.string() if digest else pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], ["k1", "k2", "n_removed", "n_spans", "kept"])

    with_text = spans.join(texts, ["k1", "k2"], "left").select("k1", "k2", "runs", "text")
    return with_text.mapInArrow(run, f"k1 long, k2 long, n_removed long, n_spans long, kept {kind}")


def digest(docs: DataFrame, length: int = LENGTH, block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    A byte is removed if a string of ``length`` bytes that covers it starts anywhere else too, in the
    same text or another; strings are judged on the texts as given. Null texts are empty. Repeated
    rows repeat each other; rows with a null doc_id are texts like any other. An empty table gives an
    empty result; other columns are not read.
    """
    cut = _cut(*repeated(docs, length, block), True)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    rows = rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), *keys(F.col("text")), F.sha2("text", 256).alias("whole"))
    none = F.lit(0).cast("long")
    return rows.join(cut, ["k1", "k2"], "left").select("doc_id", "n_bytes", F.coalesce("n_removed", none).alias("n_removed"), F.coalesce("n_spans", none).alias("n_spans"), F.coalesce("kept", "whole").alias("kept_sha256"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, block: int = BLOCK) -> DataFrame:
    """The rows of ``docs`` with a further column ``kept`` (with underscores before it if there is one): the bytes that are left of ``text``.

    A cut may part a character, so the bytes needn't be UTF-8. Null texts have none. Otherwise as ``digest``.
    """
    spans, texts = repeated(docs, length, block)
    a, b, kept = free_names(docs, "k1", "k2", "kept")
    cut = _cut(spans, texts, False).select(F.col("k1").alias(a), F.col("k2").alias(b), F.col("kept").alias(kept))
    k1, k2 = keys(text_or_empty())
    rows = docs.select("*", k1.alias(a), k2.alias(b)).join(cut, [a, b], "left")
    return rows.select(*columns_of(docs), F.coalesce(F.col(kept), F.encode(text_or_empty(), "UTF-8")).alias(kept))
