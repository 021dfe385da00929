"""Packing of examples into sequences: vector bin packing by the dot-product heuristic.

A sequence has three limits: tokens, segments and loss-bearing tokens. An open sequence takes, of the
examples that fit, the one whose sizes have the largest dot product with the room that is left, each
limit weighted by how much of it the waiting examples need. Documents may be cut: whole lengths go
straight into sequences of their own, only remainders are packed, and what would be padding is
filled with the head of a waiting remainder.

Each task packs its own rows in bounded pools as they stream by, so nothing is shuffled and no more
than a pool is held. A sequence that ends with much room, a task's last one or one full of segments, is
cut into sequences whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

import json
import os
import re
import sys
import zlib
from array import array
from collections.abc import Iterator
from types import ModuleType

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import ship, small_batches, text_or_empty

ship(__name__)

LENGTH, SEGMENTS = 2048, 128
#: Waiting examples of a pool.
POOL = 1024
#: Room of this many tokens or more is filled by cutting a waiting remainder.
LEAST_CUT = 16
END_ID = 1
# Fixed value: the pieces of byte-level tokenizers.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words whose ids a worker remembers (some 200 bytes each) before it starts anew.
REMEMBERED = 800_000


class Encoder:
    """Ids of a tokenizer file of the tokenizers library, with a memory of words.

    The byte-level pattern always starts a new piece at a space that a visible character follows. So
    a text's ids are those of its words, each with the space before it, and only words not seen
    before are encoded. Texts with other runs of white space, or with the file's special tokens, are
    encoded whole. For a byte-level file whose merges are in the order of their ids, new words go
    through tiktoken, fed with the file's own vocabulary: the same ids in a tenth of the time.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.odd = re.compile("|".join([r"^\s", *map(re.escape, self.special)]))
        self.known: dict[str, bytes | None] = {}
        self.quick = self._quick(path)

    def _quick(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        vocabulary, first = model["model"]["vocab"], (model.get("pre_tokenizer") or {})
        if first.get("type") != "ByteLevel" or first.get("add_prefix_space") or model.get("normalizer") or not first.get("use_regex", True):
            return None
        # bytes that aren't printable stand as characters from 256 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
        ranks = {bytes(byte[c] for c in token): i for token, i in vocabulary.items() if all(c in byte for c in token) and token not in self.special}
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["model"]["merges"]]
        made = [vocabulary["".join(m)] for m in merges]
        if made != sorted(made) or min(made, default=256) < 256:
            return None
        return tiktoken.Encoding(path, pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def words(self, words: list[str]) -> list[list[int]]:
        if self.quick:
            return [self.quick(f" {w}") for w in words]
        return [e.ids for e in self.tokenizer.encode_batch_fast([f" {w}" for w in words], add_special_tokens=False)]

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        split = [t.split(" ") for t in texts]
        if len(self.known) > REMEMBERED:
            self.known = {}
        code = "H" if self.kind is np.uint16 else "I"
        new = [w for w in set().union(*(s[1:] for s in split)) if w not in self.known]
        for i in range(0, len(new), 4096):
            part = new[i : i + 4096]
            for word, ids in zip(part, self.words(part), strict=True):
                self.known[word] = None if not word or self.odd.search(word) else array(code, ids).tobytes()
        out = []
        for text, (first, *rest) in zip(texts, split, strict=True):
            try:
                ids = self.whole(first) + b"".join(map(self.known.__getitem__, rest))
            except TypeError:
                ids = self.whole(text)
            out.append(np.frombuffer(ids, self.kind))
        return out


def encoder_of(path: str) -> Encoder:
    """The encoder of a file, one for each worker process: its tables and its memory serve all tasks that the process runs."""
    kept = sys.modules.setdefault("_larder_encoders", ModuleType("_larder_encoders")).__dict__
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]


def fill(sizes: np.ndarray, limits: np.ndarray, cut: bool, last: bool) -> tuple[list[list[tuple[int, int]]], list[int]]:
    """Bins of (example, tokens taken) by the dot-product heuristic, and the examples that still wait.

    ``sizes`` is n x 3: tokens, segments, loss-bearing tokens, each within ``limits``. With ``cut``, room of
    LEAST_CUT tokens takes the head of the longest waiting example. Unless ``last``, a bin that ends
    with room and nothing to fill it goes back to the waiting ones.
    """
    sizes = sizes.astype(np.float64).copy()
    share = sizes / limits
    need = share.sum(0) / max(share.sum(), 1e-12)
    waiting = np.ones(len(sizes), bool)
    bins: list[list[tuple[int, int]]] = []
    while waiting.any():
        room = limits.astype(np.float64).copy()
        own: list[tuple[int, int]] = []
        while True:
            fits = waiting & (sizes <= room).all(1)
            if fits.any():
                dot = (sizes / limits) @ (need * room / limits)
                i = int(np.where(fits, dot, -1).argmax())
                own.append((i, int(sizes[i, 0])))
                room -= sizes[i]
                waiting[i] = False
            elif cut and room[0] >= LEAST_CUT and room[1] >= 1 and waiting.any():
                i = int(np.where(waiting, sizes[:, 0], -1).argmax())
                take = int(min(room[0], room[2] * sizes[i, 0] // max(sizes[i, 2], 1)))
                if take < LEAST_CUT or take >= sizes[i, 0]:
                    break
                own.append((i, take))
                sizes[i, 2] -= min(sizes[i, 2], take)
                sizes[i, 0] -= take
                break
            else:
                break
        if not last and room[0] >= LEAST_CUT and not waiting.any():
            return bins, [i for i, _ in own]
        bins.append(own)
    return bins, []


def halves(own: list[tuple[int, int]], length: int) -> list[list[tuple[int, int]]]:
    """A bin of (example, tokens) as it is, or in order as bins of falling powers of two if it would be padded by LEAST_CUT tokens or more."""
    total = sum(n for _, n in own)
    if length - total < LEAST_CUT:
        return [own]
    out: list[list[tuple[int, int]]] = []
    room = 0
    for i, n in own:
        while n:
            if not room:
                room = 1 << (total.bit_length() - 1)
                out.append([])
            take = min(room, n)
            out[-1].append((i, take))
            room, n, total = room - take, n - take, total - take
    return out


def pack_documents(docs: DataFrame, tokenizer: str, length: int = LENGTH, segments: int = SEGMENTS, end_id: int = END_ID, pool: int = POOL, with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ``ids`` if wanted.

    A document is its text's ids and ``end_id``; every token bears loss. Null texts are empty and have
    the end id alone. Repeated rows are packed as often as they are there; a null doc_id is kept. An
    empty table gives an empty result; other columns are not read.
    """
    limits = np.array([length, segments, length])
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer)
        task = TaskContext.get()
        sequence = (task.partitionId() if task else 0) << 40
        waiting: list[list] = []  # doc_id, doc_tokens, start, ids
        rows: list[tuple] = []

        def put(doc_id, doc_tokens, start, ids, at):
            rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), doc_tokens, sequence, at, *[ids] * with_ids))

        def empty(last: bool):
            nonlocal sequence, waiting
            sizes = np.array([[len(w[3]), 1, len(w[3])] for w in waiting]).reshape(-1, 3)
            bins, left = fill(sizes, limits, True, last)
            for own in (part for whole in bins for part in halves(whole, length)):
                at = 0
                for i, n in own:
                    doc_id, doc_tokens, start, ids = waiting[i]
                    put(doc_id, doc_tokens, start, ids[:n], at)
                    waiting[i] = [doc_id, doc_tokens, start + n, ids[n:]]
                    at += n
                sequence += 1
            waiting = [waiting[i] for i in left]

        def told() -> pa.RecordBatch:
            c = list(zip(*rows, strict=True)) if rows else [[]] * 8
            columns = [pa.array(list(x), pa.int64()) for x in c[:7]]
            if with_ids:
                lengths = np.concatenate([[0], np.cumsum(c[2], dtype=np.int64)]).astype(np.int32)
                flat = pa.array(np.concatenate(c[7]).astype(np.int32) if rows else [], pa.int32())
                columns.append(pa.ListArray.from_arrays(pa.array(lengths), flat))
            rows.clear()
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in small_batches(batches, 1):
            ids_of = encoder.encode(batch.column(1).to_pylist())
            for doc_id, ids in zip(batch.column(0).to_pylist(), ids_of, strict=True):
                ids = np.append(ids, encoder.kind(end_id))
                whole = len(ids) // length * length
                for start in range(0, whole, length):
                    put(doc_id, len(ids), start, ids[start : start + length], 0)
                    sequence += 1
                if whole < len(ids):
                    waiting.append([doc_id, len(ids), whole, ids[whole:]])
                if len(waiting) >= pool:
                    empty(False)
            yield told()
        empty(True)
        yield told()

    schema = ", ".join(f"{n} {'array<int>' if n == 'ids' else 'long'}" for n in names)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, schema)


def pack_examples(examples: DataFrame, limits: tuple[int, int, int], pool: int = POOL) -> DataFrame:
    """(example_id, sequence_id, place) for instruction data that isn't cut: (example_id, tokens, segments, loss_tokens).

    Null sizes count as 0. An example beyond a limit gets a sequence of its own.
    """
    most = np.array(limits)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = TaskContext.get()
        sequence = (task.partitionId() if task else 0) << 40
        waiting = pd.DataFrame()

        def packed(rows: pd.DataFrame, last: bool) -> pd.DataFrame:
            nonlocal sequence, waiting
            sizes = rows[["tokens", "segments", "loss_tokens"]].to_numpy()
            over = (sizes > most).any(1)
            bins = [[(i, 0)] for i in np.flatnonzero(over)]
            inside = np.flatnonzero(~over)
            full, left = fill(sizes[inside], most, False, last)
            bins += [[(int(inside[i]), 0) for i, _ in own] for own in full]
            waiting = rows.iloc[inside[left]]
            ids, first = rows["example_id"].to_numpy(), sequence
            sequence += len(bins)
            return pd.DataFrame([(ids[i], first + k, place) for k, own in enumerate(bins) for place, (i, _) in enumerate(own)], columns=["example_id", "sequence_id", "place"])

        for frame in frames:
            waiting = pd.concat([waiting, frame], ignore_index=True)
            while len(waiting) >= pool:
                rest = waiting.iloc[pool:]
                out = packed(waiting.iloc[:pool], False)
                waiting = pd.concat([waiting, rest], ignore_index=True)
                yield out
        if len(waiting):
            yield packed(waiting, True)

    columns = [F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(c) for c in ("tokens", "segments", "loss_tokens")]
    return examples.select(F.col("example_id").cast("long").alias("example_id"), *columns).mapInPandas(run, "example_id long, sequence_id long, place long")


def conversation_sizes(conversations: DataFrame, tokenizer: str, answers: str = "assistant") -> DataFrame:
    """(example_id, tokens, segments, loss_tokens) of each conversation: all turns, and the answering role's tokens bear loss."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer)
        # by bytes of text too: words of a batch are held beside those remembered, however long turns are
        for batch in small_batches(batches, 1):
            n = [len(ids) + 1 for ids in encoder.encode(batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), batch.column(2)], ["conv_id", "n", "own"])

    own = F.coalesce(F.col("role") == answers, F.lit(False)).alias("own")
    turns = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), text_or_empty().alias("text"), own).mapInArrow(run, "conv_id long, n long, own boolean")
    return turns.groupBy(F.col("conv_id").alias("example_id")).agg(F.sum("n").alias("tokens"), F.count("*").alias("segments"), F.sum(F.when(F.col("own"), F.col("n")).otherwise(0)).alias("loss_tokens"))
