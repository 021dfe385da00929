"""Repair of conversations: cheapest edits against all edits tried, the query against a plain version."""

import hashlib
import itertools
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from larder.llm import conversations as C
from larder.llm import queries
from tests.llm.data import table

TURNS = "conv_id long, turn long, role string, text string, lang string, at long, plan string, part long, h1 long"
GOOD = re.compile(r"(s?(ua)+)?")


def tried(symbols):
    """The least (cost, audit) over all edits with at most two insertions in a place."""
    rows = [symbols[i : i + 2] for i in range(0, len(symbols), 2)]
    gaps = ["", "u", "a", "ua", "au"]
    options = []
    for role, fault in rows:
        more = 3 if fault == "t" else 0
        own = [("D", 4, "")]
        if fault in ".t":
            own += [("K", more, role), ("R", 3 + more, "u"), ("R", 3 + more, "a")]
        options += [[("I" * len(g), 3 * len(g), g) for g in gaps], own]
    options.append([("I" * len(g), 3 * len(g), g) for g in gaps])
    return min((sum(c for _, c, _ in way), "".join(x for x, _, _ in way)) for way in itertools.product(*options) if GOOD.fullmatch("".join(r for _, _, r in way)))


def test_cheapest_edits_equal_all_edits_tried():
    for n in range(3):
        for rows in itertools.product([c + f for c in "suax" for f in ".bt"], repeat=n):
            assert C.cheapest("".join(rows))[:2] == tried("".join(rows)), rows
    random = np.random.default_rng(3)
    for _ in range(150):
        rows = "".join(random.choice(list("suuaax")) + random.choice(list("....btd")) for _ in range(random.integers(3, 5)))
        assert C.cheapest(rows)[:2] == tried(rows), rows


def plain(rows, every):
    """The contract row by row, without machines: edits by a table over (grammar state, position) of whole strings."""
    by_id = defaultdict(list)
    for conv_id, turn, role, text in rows:
        key = f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}"
        role, text, kind = " " if role is None else role, " " if text is None else text, zlib.crc32(key.encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        by_id[conv_id] += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    step = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    out = {}
    for conv_id in {e for e in every}:
        own = sorted(by_id[conv_id], key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, kinds = set(), []
        for _, role, text in own:
            last = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
            kinds.append("b" if not last else "d" if (role, text) in seen else "t" if last[-1] not in ".!?" else ".")
            seen.add((role, text))
        best = {"": (0, "", ())}

        def inserted(best):
            for _ in range(3):
                for s, (c, label, said) in list(best.items()):
                    for r in "ua":
                        if r in step[s]:
                            new = (c + 3, label + "I", (*said, ({"u": "user", "a": "assistant"}[r], "")))
                            best[step[s][r]] = min(best.get(step[s][r], new), new)
            return best

        for (_, role, text), kind in zip(own, kinds, strict=True):
            after = {}
            for s, (c, label, said) in inserted(best).items():
                ways = [(s, 4, "D", ())]
                if kind in ".t":
                    more = 3 if kind == "t" else 0
                    ways += [(step[s][role[:1]], more, "K", ((role, text),))] if role[:1] in step[s] else []
                    ways += [(step[s][r], 3 + more, "R", ((full, text),)) for r, full in (("u", "user"), ("a", "assistant")) if r in step[s]]
                for to, cost, x, words in ways:
                    new = (c + cost, label + x, said + words)
                    after[to] = min(after.get(to, new), new)
            best = after
        cost, audit, said = min(v for s, v in inserted(best).items() if s in ("", "a"))
        turns = [t for t, _, _ in own if t is not None]
        roles = [r[:1] for _, r, _ in own]
        out[conv_id] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
            *(kinds.count(k) for k in "bdt"),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:], strict=False)),
            cost,
            audit,
            hashlib.sha256("\n".join(f"{r}:{t}" for r, t in said).encode()).hexdigest(),
        )
    return out


NAMES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def odd(spark):
    long = "word " * 60_000 + "."
    rows = [(1, 0, "user", "Hi."), (1, 1, "assistant", "Yes."), (1, 1, "assistant", "Yes."), (1, None, "system", "Be."), (1, 9, None, None), (1, 4, "tool", "x\n"), (1, 5, "", "y.")]
    rows += [(None, None, None, None), (None, 1, "user", "Null."), (None, 2, "assistant", long), (2, 3, "user", long), (2, 3, "user", long), (2, None, "assistant", "\x0b\t "), (3, None, "user", None)]
    rows += [(4, t, ("user", "assistant")[t % 2], f"Turn {t // 3}.") for t in range(400)] + [(5, 7, "user", "Same.")] * 60 + [(i, 0, "user", "Ünïcödé ☃?") for i in range(10, 70)]
    return spark.createDataFrame([(*r, "en", 1, "K", 2, 3) for r in rows], TURNS)


def test_query_equals_plain_version(spark):
    rows = [tuple(r) for r in table(spark, "conversations").select("conv_id", "turn", "role", "text").collect()]
    want = plain(rows, [r[0] for r in rows])
    got = queries.op11_conversation_repair(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(want) and {r.conv_id: tuple(r[n] for n in NAMES) for r in got} == want


def test_odd_cases(spark):
    df = odd(spark)
    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    got = C.report(C.damage(df), df).collect()
    want = plain(rows, [r[0] for r in rows])
    assert len(got) == len(want) and {r.conv_id: tuple(r[n] for n in NAMES) for r in got} == want
    assert C.report(C.damage(df.where("false")), df.where("false")).count() == 0
    gone = C.report(df.where("false"), df.where("conv_id = 1")).collect()
    assert [tuple(r) for r in gone] == [(1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())]


def test_repaired_turns_follow_the_grammar(spark):
    got = C.repair(odd(spark)).collect()
    by_id = defaultdict(list)
    for r in sorted(got, key=lambda r: (r.conv_id is not None, r.conv_id or 0, r.place)):
        by_id[r.conv_id].append(r)
    assert all(GOOD.fullmatch("".join(r.role[:1] for r in own)) for own in by_id.values())
    assert all([r.place for r in own] == list(range(len(own))) for own in by_id.values())
    assert all((r.edit == "I") == (r.turn is None and r.text == "") or r.conv_id in (None, 1) for r in got)
    assert C.repair(odd(spark).where("false")).count() == 0


@pytest.mark.parametrize("symbols,want", [("", (0, "", "")), ("s.", (4, "D", "D")), ("u.a.", (0, "KK", "KK")), ("u.u.", (3, "KR", "Ka")), ("a.", (3, "IK", "UK")), ("u.", (3, "KI", "KA")), ("u.ab", (7, "KDI", "KDA"))])
def test_known_repairs(symbols, want):
    assert C.cheapest(symbols) == want
