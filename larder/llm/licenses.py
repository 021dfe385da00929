"""License scan: exact short notices, and a fuzzy search for notices with a few edits.

A notice with at most k edits leaves one of its k + 1 pieces untouched (pigeonhole). Exact search for
the pieces finds candidate windows; the regex library's bounded-error matching then decides about
each window and says where the notice stands and how many edits it has. Matches are taken from left to
right, each improved where it stands, so that neighbouring notices are all found.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import ship, small_batches, text_bytes, text_or_empty

ship(__name__)

#: Exact phrases and their labels.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: Notices, labels and most edits for the fuzzy search. Words in braces tell licenses apart: there an edit is no typo.
NOTICES = (
    ("under the {mit} license", "mit", 2),
    ("apache license version {1}", "apache-1", 3),
    ("apache license version {2}", "apache-2", 3),
    ("cc by {nc}", "cc-by-nc", 1),
    ("creative commons attribution {noncommercial}", "cc-by-nc", 3),
    ("creative commons attribution {noderivatives}", "cc-by-nd", 3),
    ("creative commons attribution {noderivs}", "cc-by-nd", 3),
    ("creative commons attribution {sharealike}", "cc-by-sa", 3),
    ("{gnu} general public license", "gpl", 3),
    ("{gnu lesser} general public license", "lgpl", 3),
    ("{gnu affero} general public license", "agpl", 3),
    ("{bsd 2} clause license", "bsd-2", 2),
    ("{bsd 3} clause license", "bsd-3", 2),
    ("{bsd 4} clause license", "bsd-4", 2),
    ("mozilla public license", "mpl", 2),
    ("{all} rights reserved", "proprietary", 2),
)
_WORDS = np.full(256, 32, np.uint8)
_WORDS[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]
_WORDS[range(0x41, 0x5B)] = range(0x61, 0x7B)
WORD_TABLE = _WORDS.tobytes()
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = {i: i + 32 for i in range(65, 91)}


def words_of(data: bytes) -> list[bytes]:
    return data.translate(WORD_TABLE).split()


def pieces(notice: str, edits: int) -> list[tuple[int, str]]:
    """The notice cut into edits + 1 pieces of like length, with their places."""
    bounds = [round(i * len(notice) / (edits + 1)) for i in range(edits + 2)]
    return [(a, notice[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def expression(notice: str, edits: int) -> str:
    """A regular expression for whole words of a notice with at most so many edits, none of them in braces."""
    parts = re.split(r"( ?\{.*?\} ?)", notice)  # the spaces beside a telling word belong to it
    parts = [part.replace("{", "").replace("}", "") for part in parts]
    free = [k for k, part in enumerate(parts) if k % 2 == 0 and part.strip()]

    def shared_out(left: int, n: int) -> Iterator[tuple[int, ...]]:
        if n == 1:
            yield (left,)
            return
        for own in range(left, -1, -1):
            yield from ((own, *rest) for rest in shared_out(left - own, n - 1))

    ways = []
    for shares in shared_out(edits, len(free)):
        allowed = dict(zip(free, shares, strict=True))
        said = [regex.escape(part, special_only=True) for part in parts]
        ways.append("".join(f"(?:{x}){{e<={allowed[k]}}}" if allowed.get(k) else x for k, x in enumerate(said)))
    return rf"(?e)(?:^|(?<= ))(?:{'|'.join(ways)})(?= |$)"


class Search:
    def __init__(self, phrases=PHRASES, notices=NOTICES):
        self.phrases = [(f" {p} ".encode(), label) for p, label in phrases]
        self.notices = []
        for notice, label, edits in notices:
            plain = notice.replace("{", "").replace("}", "")
            cut = pieces(plain, edits)
            self.notices.append((label, edits, len(plain), cut, [p.encode() for _, p in cut], regex.compile(expression(notice, edits))))

    def exact(self, flat: bytes) -> tuple[list[int], set[str]]:
        """Word numbers at which phrases start, and their labels; ``flat`` has single spaces and one at either end."""
        starts, labels = [], set()
        for phrase, label in self.phrases:
            at = flat.find(phrase)
            seen, last = 0, 0
            while at >= 0:
                seen += flat.count(b" ", last, at)
                last = at
                starts.append(seen)
                labels.add(label)
                at = flat.find(phrase, at + 1)
        return sorted(starts), labels

    def fuzzy(self, flat: bytes) -> list[tuple[int, int, str, int, int]]:
        """(first word, words, label, edits, notice length) of each notice found, in order."""
        out, text = [], None
        for label, edits, n, cut, seeds, pattern in self.notices:
            if not any(s in flat for s in seeds):
                continue
            text = flat.decode("utf-8", "replace") if text is None else text
            windows = []
            for place, piece in cut:
                at = text.find(piece)
                while at >= 0:
                    windows.append((max(0, at - place - edits - 1), at - place + n + edits + 2))
                    at = text.find(piece, at + 1)
            windows.sort()
            merged: list[list[int]] = []
            for a, b in windows:
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(b, merged[-1][1])
                else:
                    merged.append([a, b])
            seen, last = 0, 0
            for a, b in merged:
                for m in pattern.finditer(text, a, min(b, len(text))):
                    if (m.start() and text[m.start() - 1] != " ") or not m.group().strip():
                        continue
                    seen += text.count(" ", last, m.start())
                    last = m.start()
                    first = seen - 1 + (len(m.group()) - len(m.group().lstrip()))
                    out.append((first, len(m.group().split()), label, sum(m.fuzzy_counts), n))
        return sorted(out)


def _code_points(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Word spans as code point spans of the text."""
    places = [(m.start(), m.end()) for m in WORD.finditer(text.translate(_LOWER))]
    return [(places[a][0], places[min(a + n, len(places)) - 1][1]) for a, n in spans]


def scan(docs: DataFrame, phrases=PHRASES, notices=NOTICES) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): counts, labels, score and the spans of fuzzy notices.

    doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, and ``notices``, an array of
    (label, start, stop, edits) in code points. The score is the best share of a notice that stands
    unedited, 1 for an exact phrase, 0 if nothing is found. Null texts are empty: no words, empty
    labels, null places. Repeated rows stay, an empty table gives an empty result, other columns are not read.
    """
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "notices"]
    span = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("edits", pa.int32())]))
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), span]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(phrases, notices)
        for batch in small_batches(batches, 1):
            raw, offsets = text_bytes(batch.column(1))
            data = raw.tobytes()
            rows = []
            for i in range(len(batch)):
                own = data[offsets[i] : offsets[i + 1]]
                words = words_of(own)
                flat = b" " + b" ".join(words) + b" "
                starts, base = search.exact(flat)
                found = search.fuzzy(flat)
                spans = _code_points(own.decode("utf-8", "replace"), [(a, n) for a, n, *_ in found]) if found else []
                labels = base | {f[2] for f in found}
                score = max([1.0 if starts else 0.0, *(1 - f[3] / f[4] for f in found)])
                told = [{"label": f[2], "start": s[0], "stop": s[1], "edits": f[3]} for f, s in zip(found, spans, strict=True)]
                rows.append((len(words), len(starts), starts[0] if starts else None, starts[-1] if starts else None, ",".join(sorted(base)), ",".join(sorted(labels)), score, told))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * (len(names) - 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), k) for c, k in zip(columns, kinds[1:], strict=True))], names)

    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, notices array<struct<label:string,start:long,stop:long,edits:int>>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, schema)


def digest(found: DataFrame) -> DataFrame:
    """:func:`scan` with its notices as text: label:start:stop:edits, in order, comma-joined."""
    told = F.transform("notices", lambda n: F.concat_ws(":", n["label"], n["start"].cast("string"), n["stop"].cast("string"), n["edits"].cast("string")))
    return found.withColumn("notices", F.array_join(told, ","))
