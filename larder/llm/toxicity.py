"""Toxicity: a weighted lexicon, matched by Aho-Corasick after folding look-alike letters and digits.

Lexicon entries are word beginnings or whole words that labelled toxic texts use and clean ones
don't, weighted by their log odds. A score is a logistic function of the weight found, as it is and
per word of the text. Exception phrases hide the entries inside them.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import ship, text_or_empty
from larder.llm.labelled import fold, training_rows

ship(__name__)

#: Most labelled rows that the lexicon is learned from.
TRAIN_ROWS = 8000
#: Least toxic texts with an entry, as a number and as a share, and least share of toxic use.
LEAST_TEXTS, LEAST_SHARE, PRECISION = 3, 0.01, 0.97
#: Parts of the training texts; how much an entry tells is judged on texts that it wasn't learned from.
PARTS = 5
PREFIXES = range(3, 8)
#: Harmless phrases that contain words which can be insults.
EXCEPTIONS = ("clown fish", "class clown", "trash can", "trash bin", "trash bag", "pond scum", "soap scum", "sore loser", "stupid question", "idiot proof")

# Letters that look like Latin ones, and digits and signs used for letters.
_GREEK_CYRILLIC = "аеорсухікӏѕјԁгпαβεικνορτυχ"
_LATIN = "aeopcyxiklsjdrnabeikvoptux"
_SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}


def _folding() -> dict[int, str]:
    table = {i: " " for i in range(128) if not chr(i).isalnum()}
    table |= {ord(a): b for a, b in zip(_GREEK_CYRILLIC, _LATIN, strict=True)}
    table |= {ord(a): b for a, b in _SIGNS.items()}
    table |= {0xFF21 + i: chr(97 + i) for i in range(26)} | {0xFF41 + i: chr(97 + i) for i in range(26)}
    table |= {0x1D400 + i: chr(97 + i % 26) for i in range(52)}
    return table | {0x200B: "", 0x200C: "", 0x200D: "", 0xAD: "", 0xA0: " "}


_TABLE = _folding()


def folded(text: str) -> str:
    """Lower case, look-alikes as Latin letters, digits as letters, other ASCII signs as single spaces, with a space at either end."""
    return f" {' '.join(text.lower().translate(_TABLE).split())} "


def patterns(text: str) -> set[str]:
    """The word beginnings and whole words of a text."""
    out = set()
    for word in set(folded(text).split()):
        out.update(f" {word[:k]}" for k in PREFIXES if k <= len(word))
        out.add(f" {word} ")
    return out


@dataclass
class Lexicon:
    weights: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    bias: float = -4.0
    slopes: tuple[float, float] = (1.0, 1.0)
    _automaton: object = field(default=None, repr=False, compare=False)

    def __getstate__(self):
        return self.__dict__ | {"_automaton": None}

    def automaton(self):
        if self._automaton is None:
            import ahocorasick

            self._automaton = ahocorasick.Automaton()
            for entry, weight in self.weights.items():
                self._automaton.add_word(entry, (len(entry), weight))
            for phrase in self.exceptions:
                entry = folded(phrase)
                self._automaton.add_word(entry, (len(entry), 0.0))
            if len(self._automaton):
                self._automaton.make_automaton()
        return self._automaton

    def found(self, text: str) -> tuple[float, int]:
        """Weight of the entries in a text, one for each word at most, and the number of words."""
        flat = folded(text)
        automaton = self.automaton()
        if not len(automaton):
            return 0.0, flat.count(" ") - 1
        best: dict[int, float] = {}
        hidden = []
        for end, (n, weight) in automaton.iter(flat):
            start = end - n + 1
            if weight:
                best[start] = max(best.get(start, 0.0), weight)
            else:
                hidden.append((start, end))
        if hidden:
            hidden.sort()
            starts = [a for a, _ in hidden]
            reached = list(accumulate((b for _, b in hidden), max))
            best = {at: w for at, w in best.items() if not (k := bisect_right(starts, at)) or reached[k - 1] <= at}
        total = sum(w for _, w in sorted(best.items()))
        return total, max(0, flat.count(" ") - 1)

    def score(self, text: str) -> float:
        total, words = self.found(text)
        return float(1 / (1 + math.exp(-max(-30.0, min(30.0, self.bias + float(features(total, words) @ np.array(self.slopes)))))))


def features(total: float, words: int) -> np.ndarray:
    """Weight found, and weight per hundred words, on logarithmic scales."""
    return np.array([math.log1p(total), math.log1p(100 * total / max(20, words))])


def part_of(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "replace")) % PARTS


def _counts(rows: DataFrame, least: int = 1, of: frozenset | None = None) -> dict[str, np.ndarray]:
    """In how many texts of each part each pattern stands, of those that stand in ``least`` texts; the empty pattern counts the texts."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            counted: Counter = Counter()
            for text in frame["text"]:
                found = patterns(text)
                part = part_of(text)
                counted.update((p, part) for p in (found if of is None else found & of))
                counted["", part] += 1
            yield pd.DataFrame({"pattern": [p for p, _ in counted], "part": [k for _, k in counted], "n": list(counted.values())})

    own = [F.sum(F.when(F.col("part") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in range(PARTS)]
    summed = rows.select("text").mapInPandas(run, "pattern string, part int, n long").groupBy("pattern").agg(F.sum("n").alias("n"), *own)
    return {r[0]: np.array(r[2:]) for r in summed.where((F.col("n") >= least) | (F.col("pattern") == "")).toLocalIterator()}


def choose_entries(toxic: dict[str, int], clean: dict[str, int], n_toxic: int, n_clean: int) -> dict[str, float]:
    """Entries and weights: of the beginnings that tell, the longest that still covers what the shortest covers."""

    def share(p: str) -> float:
        a, b = toxic[p] / max(1, n_toxic), (clean.get(p, 0) + 0.5) / max(1, n_clean)
        return a / (a + b)

    telling = {p for p in toxic if share(p) >= PRECISION}
    longer: dict[str, list[str]] = {}
    for p in telling:
        longer.setdefault(p[:-1], []).append(p)
    kept: set[str] = set()
    for p in sorted(telling, key=lambda p: (len(p), p)):
        if any(p[:k] in kept for k in range(3, len(p))):
            continue
        while more := [q for q in longer.get(p, []) if toxic[q] >= 0.97 * toxic[p]]:
            p = max(more, key=lambda q: (toxic[q], q))
        kept.add(p)
    return {p: math.log((toxic[p] + 0.5) / (n_toxic + 1)) - math.log((clean.get(p, 0) + 0.5) / (n_clean + 1)) for p in sorted(kept)}


def logistic_fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 30) -> np.ndarray:
    """Newton's method for a logistic model with an intercept in the first place."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def learn(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> Lexicon:
    """A lexicon from at most ``most`` labelled rows that aren't held out; without toxic and clean rows an empty one.

    What a found weight says is fitted on texts of each part with the entries that the other parts give, so
    that a few entries learned from a few texts aren't trusted too far.
    """
    rows = training_rows(docs, labels, "toxic", most)
    toxic_rows, clean_rows = rows.where("label = 1"), rows.where("label = 0")
    toxic = _counts(toxic_rows, LEAST_TEXTS)
    n_toxic = toxic.pop("", np.zeros(PARTS, int))
    if not toxic:
        return Lexicon({})
    clean = _counts(clean_rows, of=frozenset(toxic))
    n_clean = clean.pop("", np.zeros(PARTS, int))
    if not n_clean.sum():
        return Lexicon({})

    def lexicon(without: int | None = None) -> Lexicon:
        kept = np.array([k != without for k in range(PARTS)])
        sums = lambda counts: {p: int(n[kept].sum()) for p, n in counts.items()}
        least = max(LEAST_TEXTS, math.ceil(LEAST_SHARE * n_toxic[kept].sum()))
        own = {p: n for p, n in sums(toxic).items() if n >= least}
        return Lexicon(choose_entries(own, sums(clean), int(n_toxic[kept].sum()), int(n_clean[kept].sum())))

    apart = [lexicon(k) for k in range(PARTS)]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = [apart[part_of(t)].found(t) for t in frame["text"]]
            yield pd.DataFrame({"label": frame["label"], "total": [float(t) for t, _ in out], "words": [n for _, n in out]})

    known = rows.mapInPandas(run, "label int, total double, words long").toPandas().sort_values(["label", "total", "words"])
    x = np.stack([features(t, n) for t, n in zip(known["total"], known["words"], strict=True)])
    w = logistic_fit(x, known["label"].to_numpy(float))
    whole = lexicon()
    return Lexicon(whole.weights, whole.exceptions, float(w[0]), (float(w[1]), float(w[2])))


def _found(rows: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(doc_id, total, words): weight of the entries in each text, and its words."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = [lexicon.found(t) for t in frame.pop("text")]
            yield frame.assign(total=[float(t) for t, _ in out], words=[n for _, n in out])

    return rows.select("doc_id", "text").mapInPandas(run, "doc_id long, total double, words long")


def score_documents(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, held_out, score, predicted, weight, n_words.

    Null texts are empty; texts without words get the score of no weight found. Repeated rows stay,
    an empty table gives an empty result, other columns are not read.
    """
    found = _found(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")), lexicon)
    a, b = (float(s) for s in lexicon.slopes)
    logit = F.lit(lexicon.bias) + a * F.log1p("total") + b * F.log1p(100 * F.col("total") / F.greatest(F.lit(20), "words"))
    score = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), logit))))
    return found.withColumn("score", score).select("doc_id", (fold() == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.col("total").alias("weight"), F.col("words").alias("n_words"))


def keep_clean(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """The rows of ``docs`` whose text isn't toxic, with all their columns."""

    @F.pandas_udf("boolean")
    def clean(text: pd.Series) -> pd.Series:
        return text.map(lambda t: lexicon.score(t) < 0.5).astype(bool)

    return docs.where(clean(text_or_empty()))
