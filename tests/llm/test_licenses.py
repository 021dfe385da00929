import re

import regex

from larder.llm import licenses
from tests.llm.data import docs, table

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def base(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    places, labels = [], set()
    for phrase, label in licenses.PHRASES:
        p = phrase.split()
        for k in range(len(words)):
            if words[k : k + len(p)] == p:
                places.append(k)
                labels.add(label)
    return words, places, labels


def check(df):
    got = licenses.scan(df).collect()
    want = {}
    for r in df.collect():
        words, places, labels = base(r.text)
        flat = " ".join(words)
        more = {label for notice, label, e in licenses.NOTICES if regex.search(licenses.expression(notice, e), f" {flat} ")}
        want.setdefault(r.doc_id, []).append((len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | more))))
    for g in got:
        assert (g.n_words, g.n_base, g.first_word, g.last_word, g.base_labels, g.labels) in want[g.doc_id], g
        assert 0 <= g.score <= 1 and (g.score == 1 or not g.n_base)
    assert len(got) == df.count()
    return got


def test_given_documents(spark):
    assert sum(g.n_base for g in check(table(spark, "documents"))) > 10


def test_odd_cases(spark):
    check(docs(spark))
    assert licenses.scan(docs(spark).where("false")).count() == 0


def test_edits_and_spans(spark):
    texts = ["Released undr the MITT licence, so...", "UNDER THE MIT LICENSE under-the MIT_license", "cc by-nc 4.0", "cc by sa", "see the GNU genral public\nlicense here", "under the mit", "é under teh mit license", "apache license, version 2.0 and Apache Licence Version 2"]
    got = {g.doc_id: g for g in check(docs(spark, [(i, t, "en", "s", 1, 1, "k", 1) for i, t in enumerate(texts)]))}
    assert [got[i].labels for i in range(7)] == ["", "mit", "cc-by-nc", "", "gpl", "", "mit"]
    n = got[4].notices[0]
    assert texts[4][n.start : n.stop] == "GNU genral public\nlicense" and n.edits == 1
    assert (got[1].n_base, got[1].first_word, got[1].last_word) == (2, 0, 4) and got[1].score == 1


def test_neighbouring_notices_are_all_found(spark):
    """Every notice that a search of the whole text finds is reported, whatever stands beside it."""
    texts = ["all rigts reserved all rights reserved", "All Rights Reservd. All rights reserved; all rigths reserved", "under the mit license under teh mit license", "gnu general public license gnu lesser general public license gnu genral public license", "x " * 50 + "mozila public license mozilla publc license mozilla public license"]
    rows = docs(spark, [(i, t, "en", "s", 1, 1, "k", 1) for i, t in enumerate(texts)])
    found = {r.doc_id: r for r in licenses.scan(rows).collect()}
    for i, t in enumerate(texts):
        flat = f" {' '.join(WORD.findall(t.lower()))} "
        want = []
        for notice, label, e in licenses.NOTICES:
            for m in regex.finditer(licenses.expression(notice, e), flat):
                want.append((label, sum(m.fuzzy_counts)))
        assert sorted((n.label, n.edits) for n in found[i].notices) == sorted(want), t
    assert [(n.start, n.edits) for n in found[0].notices] == [(0, 1), (19, 0)]
    told = licenses.digest(licenses.scan(rows)).where("doc_id = 0").first().notices
    assert told == "proprietary:0:18:1,proprietary:19:38:0"


def test_telling_words_are_exact(spark):
    """An edit in the word that tells two licenses apart is another license, not a typo."""
    known = {
        "Apache License, Version 1.1": "apache-1", "Apache License, Version 3": "", "Apache License, Version 2.0": "apache-2", "apache licence, version 2": "apache-2", "apache license version 12": "",
        "BSD 2-Clause License": "bsd-2", "BSD 3-Clause License": "bsd-3", "BSD 4 clause licence": "bsd-4", "BSD 5 clause license": "",
        "CC BY ND": "", "cc by no": "", "CC BY NC": "cc-by-nc", "cc bye nc": "cc-by-nc", "under the MIT license": "mit", "under the NIT license": "", "under the hit license": "", "undr the mit licence": "mit",
        "GNU Affero General Public License": "agpl", "GNU General Public Licence": "gpl", "GNU Lesser General Pubic License": "lgpl", "gnu library general public license": "",
        "Creative Commons Attribution Commercial": "", "creative commons atribution noncommercial": "cc-by-nc", "Creative Commons Attribution-NoDerivatives": "cc-by-nd", "No rights reserved": "", "some rights reserved": "", "all rigths reserved": "proprietary",
    }
    rows = docs(spark, [(i, t, "en", "s", 1, 1, "k", 1) for i, t in enumerate(known)])
    assert {r.doc_id: r.labels for r in licenses.scan(rows).collect()} == dict(enumerate(known.values()))


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_expressions_equal_distances():
    """Found exactly where some stretch of whole words is the notice with few edits, its telling word apart."""
    import random

    rng = random.Random(1)
    for notice, before, telling, after, edits in (("under the {mit} license", "under the", " mit ", "license", 2), ("apache license version {2}", "apache license version", " 2", "", 3), ("{bsd 3} clause license", "", "bsd 3 ", "clause license", 2)):
        pattern = regex.compile(licenses.expression(notice, edits))
        for _ in range(150):
            text = list(f"a {before}{telling}{after} z")
            for _ in range(rng.randrange(4)):
                at = rng.randrange(len(text))
                text[at : at + rng.randrange(2)] = rng.choice(["", "x", "e", "2", "m", " "])
            text = "".join(text)
            bounds = [i for i in range(len(text) + 1) if i in (0, len(text)) or text[i - 1] == " " or text[i] == " "]
            want = any(
                distance(text[a:m], before) + distance(text[m + len(telling) : b], after) <= edits
                for a in bounds if a == 0 or text[a - 1] == " "
                for b in bounds if b >= a and (b == len(text) or text[b] == " ")
                for m in range(a, b) if text.startswith(telling, m) and m + len(telling) <= b and (after or m + len(telling) == b) and (before or m == a)
            )
            assert bool(pattern.search(text)) == want, text
