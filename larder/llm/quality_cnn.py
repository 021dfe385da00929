"""Quality classifier: a byte-level convolutional network in numpy.

Each filter looks at ``WIDTH`` bytes; the network adds its weights for each of them, rectifies, and
takes the largest value within every one of the overlapping chunks that cover the whole document. A
document's probability comes from the mean and the largest of its chunks' values. Sums of two
neighbouring bytes' weights are tabulated, so that a scan costs three lookups a byte.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import ship, small_batches, text_bytes, text_or_empty
from larder.llm.labelled import fold, training_rows

ship(__name__)

#: Most labelled rows that the network is fitted on, and most bytes of their texts together. Rows are drawn whole.
TRAIN_ROWS, TRAIN_BYTES = 3000, 6 << 20
FILTERS, WIDTH = 16, 6
#: A chunk has CHUNK cells of CELL bytes and starts every STRIDE cells.
CELL, CHUNK, STRIDE = 64, 8, 6
THRESHOLD = 0.3
_SLICE = 1 << 16
_CHUNKS = 512
_PAD = 32


@dataclass
class Network:
    taps: np.ndarray  # WIDTH x 256 x FILTERS
    bias: np.ndarray
    out: np.ndarray  # of the mean, then of the largest
    shift: float
    _tables: list = field(default_factory=list, repr=False, compare=False)

    def __getstate__(self):
        return self.__dict__ | {"_tables": []}

    def tables(self) -> list[np.ndarray]:
        if not self._tables:
            t = self.taps.astype(np.float32)
            self._tables = [(t[k][:, None, :] + t[k + 1][None, :, :]).reshape(65536, -1) for k in range(0, WIDTH, 2)]
        return self._tables

    def cells(self, data: np.ndarray) -> np.ndarray:
        """The largest rectified value of each filter in each cell of bytes."""
        pair = (data[:-1].astype(np.int32) << 8) | data[1:]
        n = len(data) - WIDTH + 1
        total = self.tables()[0][pair[:n]]
        for k, table in enumerate(self.tables()[1:], 1):
            total += table[pair[2 * k : 2 * k + n]]
        return np.maximum(np.maximum.reduceat(total, np.arange(0, n, CELL), axis=0) + self.bias.astype(np.float32), 0)

    def pooled(self, data: np.ndarray) -> np.ndarray:
        """Mean and largest over a document's chunks of what each chunk pools."""
        data = padded(data)
        parts = [self.cells(data[i : i + _SLICE + WIDTH - 1]) for i in range(0, max(1, len(data) - WIDTH + 1), _SLICE)]
        cells = np.concatenate(parts) if len(parts) > 1 else parts[0]
        starts = np.arange(0, max(1, len(cells) - CHUNK + STRIDE), STRIDE)
        chunks = np.stack([cells[np.minimum(starts + k, len(cells) - 1)] for k in range(CHUNK)]).max(0)
        return np.concatenate([chunks.mean(0), chunks.max(0)])

    def score(self, data: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.pooled(data) @ self.out + self.shift, -30, 30))))


def padded(data: np.ndarray) -> np.ndarray:
    """Short texts, empty ones too, are filled up with zero bytes."""
    return data if len(data) >= _PAD else np.concatenate([data, np.zeros(_PAD - len(data), np.uint8)])


def _sample(rows: DataFrame) -> pd.DataFrame:
    """(row, label, chunk): all chunks of each training text; what the driver gets is bounded by the rows' bytes.

    Equal texts of one label are one training row. Rows are taken in the order of their texts' hashes as long
    as they fit ``TRAIN_BYTES`` together; a text of more than a sixteenth of that isn't drawn.
    """
    rows = rows.withColumn("hash", F.xxhash64("text")).where(F.octet_length("text") <= TRAIN_BYTES // 16)
    sizes = rows.groupBy("hash").agg(F.max(F.octet_length("text")).alias("n")).orderBy("hash").limit(TRAIN_ROWS).collect()
    fits = int(np.searchsorted(np.cumsum([r.n for r in sizes]), TRAIN_BYTES, "right"))
    rows = rows.where(F.col("hash") <= sizes[fits - 1].hash if fits else F.lit(False)).select("text", "label").distinct()
    size = CELL * CHUNK + WIDTH - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 0):
            raw, offsets = text_bytes(batch.column(0))
            out = {"row": [], "label": [], "chunk": []}
            for i, label in enumerate(batch.column(1).to_pylist()):
                data = padded(raw[offsets[i] : offsets[i + 1]])
                starts = np.arange(0, max(1, len(data) - size + CELL * STRIDE), CELL * STRIDE)
                row = f"{hashlib.blake2b(data.tobytes(), digest_size=16).hexdigest()}:{label}"
                for s in starts:
                    for k, v in (("row", row), ("label", label), ("chunk", data[s : s + size].tobytes())):
                        out[k].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out["row"], pa.string()), pa.array(out["label"], pa.int32()), pa.array(out["chunk"], pa.binary())], ["row", "label", "chunk"])

    return rows.mapInArrow(run, "row string, label int, chunk binary").toPandas()


def winners(taps: np.ndarray, x: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place at which each filter is largest in each chunk, and its value there; many chunks are looked at in slices."""
    n = x.shape[1] - WIDTH + 1
    out = []
    for at in range(0, len(x), _CHUNKS):
        own = x[at : at + _CHUNKS]
        total = taps[0][own[:, :n]]
        for k in range(1, WIDTH):
            total = total + taps[k][own[:, k : k + n]]
        total[np.arange(n)[None, :] > (valid[at : at + _CHUNKS] - WIDTH)[:, None]] = -1e9
        win = total.argmax(1)
        out.append((win, np.take_along_axis(total, win[:, None, :], 1)[:, 0]))
    return np.concatenate([w for w, _ in out]), np.concatenate([v for _, v in out])


def fit(sample: pd.DataFrame, rounds: int = 14, seed: int = 7) -> Network:
    """Adam on the cross entropy of documents; only the places that win a pooling carry a gradient."""
    random = np.random.default_rng(seed)
    sample = sample.drop_duplicates(["row", "chunk"]).sort_values(["row", "chunk"], kind="stable").reset_index(drop=True)
    width = CELL * CHUNK + WIDTH - 1
    data = np.zeros((len(sample), width), np.uint8)
    valid = np.zeros(len(sample), int)
    for i, c in enumerate(sample["chunk"]):
        data[i, : len(c)] = np.frombuffer(c, np.uint8)
        valid[i] = len(c)
    doc, _ = pd.factorize(sample["row"])
    n_docs = int(doc.max()) + 1
    label = np.zeros(n_docs)
    label[doc] = sample["label"]
    share = np.clip(label.mean(), 0.02, 0.98)
    members = np.split(np.arange(len(doc)), np.flatnonzero(np.diff(doc)) + 1) if (np.diff(doc) >= 0).all() else [np.flatnonzero(doc == d) for d in range(n_docs)]
    w = {"taps": random.normal(0, 0.3, (WIDTH, 256, FILTERS)).astype(np.float32), "bias": np.zeros(FILTERS), "out": random.normal(0, 0.3, 2 * FILTERS), "shift": np.array([np.log(share / (1 - share))])}
    m1, m2 = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    step = 0
    for _ in range(rounds):
        order = random.permutation(n_docs)
        for at in range(0, n_docs, 64):
            docs = order[at : at + 64]
            index = np.concatenate([members[d] for d in docs])
            local = np.repeat(np.arange(len(docs)), [len(members[d]) for d in docs])
            x = data[index]
            win, raw = winners(w["taps"], x, valid[index])
            raw = raw + w["bias"]
            pool = np.maximum(raw, 0)
            count = np.bincount(local, minlength=len(docs))[:, None]
            mean = np.zeros((len(docs), FILTERS))
            np.add.at(mean, local, pool)
            mean /= count
            top = np.full((len(docs), FILTERS), -1.0)
            np.maximum.at(top, local, pool)
            feature = np.concatenate([mean, top], 1)
            p = 1 / (1 + np.exp(-np.clip(feature @ w["out"] + w["shift"][0], -30, 30)))
            miss = (p - label[docs]) / len(docs)
            g = {"out": feature.T @ miss + 1e-4 * w["out"], "shift": np.array([miss.sum()])}
            back = miss[:, None] * w["out"][None, :]
            wins = pool == top[local]
            d_pool = (back[:, :FILTERS] / count)[local] + np.where(wins, back[:, FILTERS:][local], 0)
            d_pool *= raw > 0
            g["bias"] = d_pool.sum(0)
            g["taps"] = np.zeros_like(w["taps"])
            rows_, filters = np.arange(len(x))[:, None], np.arange(FILTERS)[None, :]
            for k in range(WIDTH):
                np.add.at(g["taps"][k], (x[rows_, win + k], np.broadcast_to(filters, win.shape)), d_pool)
            step += 1
            for k in w:
                m1[k] = 0.9 * m1[k] + 0.1 * g[k]
                m2[k] = 0.999 * m2[k] + 0.001 * g[k] ** 2
                w[k] = w[k] - 0.02 * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
    return Network(w["taps"].astype(np.float32), w["bias"], w["out"], float(w["shift"][0]))


def constant(probability: float) -> Network:
    """A network that knows no texts."""
    p = min(max(probability, 1e-6), 1 - 1e-6)
    return Network(np.zeros((WIDTH, 256, FILTERS), np.float32), np.zeros(FILTERS), np.zeros(2 * FILTERS), float(np.log(p / (1 - p))))


def learn(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> Network:
    """A network from at most ``most`` labelled rows that aren't held out; a constant if there are none of either label."""
    sample = _sample(training_rows(docs, labels, "quality", most))
    if sample["label"].nunique() < 2:
        return constant(float(sample["label"].mean()) if len(sample) else 0.5)
    return fit(sample)


def score_documents(docs: DataFrame, network: Network) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, held_out, score, predicted.

    Null texts are empty, and get the network's score of zero bytes. Repeated rows stay, an empty
    table gives an empty result, other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 1):
            raw, offsets = text_bytes(batch.column(1))
            score = [network.score(raw[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64())], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", (fold() == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
