"""Differences between snapshots, heading layout and slugs, by example and by rule."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from larder.operators import slugs, tracking


def line(text, qty=None, item=None, heading=0, note=None):
    return {"position": 0, "is_heading": heading, "qty": qty, "ingredient_id": item, "label": None, "note": note, "raw_text": text, "grams": None, "secondary_measure": None, "quantity": None, "unit": None}


def whole(ingredients=(), steps=(), **fields):
    rows = [dict(r, position=i) for i, r in enumerate(ingredients)]
    return ({f: fields.get(f) for f in tracking.FIELDS}, rows, [{"position": i, "is_heading": h, "text": t} for i, (t, h) in enumerate(steps)])


def texts(spark, *wholes):
    line_type = "array<struct<position:int,is_heading:int,qty:string,ingredient_id:string,label:string,note:string,raw_text:string,grams:double,secondary_measure:string,quantity:string,unit:string>>"
    schema = f"i int, recipe struct<{','.join(f'{f}:string' for f in tracking.FIELDS)}>, ingredients {line_type}, steps array<struct<position:int,is_heading:int,text:string>>"
    df = spark.createDataFrame([(i, *w) for i, w in enumerate(wholes)], schema)
    rows = df.select("i", tracking.snapshot(F.col("recipe"), F.col("ingredients"), F.col("steps")).alias("s")).collect()
    return [r.s for r in sorted(rows)]


def diff(spark, *pairs):
    flat = texts(spark, *(w for p in pairs for w in p))
    df = spark.createDataFrame([(i, flat[2 * i], flat[2 * i + 1]) for i in range(len(pairs))], "recipe_id int, old string, new string")
    out = [[] for _ in pairs]
    for r in tracking.changes(df).collect():
        out[r.recipe_id].append(r)
    return out


def test_examples(spark):
    a, b, c = line("flour", "1 cup"), line("3 eggs"), line("salt")
    pairs = [
        (whole(servings="4"), whole(servings="6")),
        (whole([line("sugar", "1 cup", "s")]), whole([line("sugar", "¾ cup", "s")])),
        (whole([b, c]), whole([a, b, c])),
        (whole([a, b, c]), whole([a, c])),
        (whole([line("1 cup sugar")]), whole([line("¾ cup sugar")])),
        (whole([line("1 cup sugar")]), whole([line("3 eggs")])),
        (whole([line("DOUGH", heading=1), a]), whole([line("THE DOUGH", heading=1), a])),
        (whole([a, b], [("Mix.", 0)]), whole([a, b], [("Mix.", 0)])),
        (whole([a, b, c]), whole([c, a, b])),
        (whole([line("salt", "1 teaspoon")]), whole([line("salt", "1 tsp")])),
        (whole(steps=[("TOP", 1), ("Mix it well.", 0), ("Bake.", 0)]), whole(steps=[("TOP", 1), ("Bake.", 0)])),
        (whole(descr=None), whole(descr="")),
    ]
    got = diff(spark, *pairs)
    assert [len(g) for g in got] == [1, 1, 1, 1, 1, 2, 1, 0, 0, 0, 1, 0]
    assert (got[0][0].kind, got[0][0].field, got[0][0]["from"], got[0][0].to) == ("field", "servings", "4", "6")
    assert (got[1][0].type, got[1][0].field, got[1][0]["from"], got[1][0].to) == ("modified", "amount", "1 cup", "¾ cup")
    assert (got[2][0].type, got[2][0].new_pos, got[2][0].text) == ("added", 0, "1 cup flour")
    assert (got[3][0].type, got[3][0].old_pos, got[3][0].section) == ("removed", 1, None)
    assert got[4][0].type == "modified" and {r.type for r in got[5]} == {"removed", "added"}
    assert (got[6][0].kind, got[6][0].type) == ("heading", "modified")
    assert (got[10][0].type, got[10][0].section, got[10][0].old_pos) == ("removed", "TOP", 0)


def test_snapshot_is_canonical(spark):
    (s,) = texts(spark, whole([line("é")], [("x", 0)], name="n"))
    assert '"label":null' in s and "é" in s and s.index('"ingredients"') < s.index('"recipe"') < s.index('"steps"')


@pytest.mark.parametrize("seed", range(3))
def test_changes_explain_the_difference(spark, seed):
    """Whatever is edited: equal texts give nothing, and removed and added rows are what alignment leaves over."""
    rng = random.Random(seed)
    pairs = []
    for _ in range(12):
        old = [(f"step number {rng.randrange(30)} says {rng.randrange(9)}", 0) for _ in range(rng.randrange(1, 9))]
        new = [s for s in old if rng.random() < 0.8]
        rng.shuffle(new) if rng.random() < 0.3 else None
        new[rng.randrange(len(new) + 1) : 0] = [(f"wholly new words {rng.random()}", 0)]
        pairs.append((whole(steps=old), whole(steps=new)))
    for (old, new), rows in zip(pairs, diff(spark, *pairs), strict=True):
        a, b = [s["text"] for s in old[2]], [s["text"] for s in new[2]]
        removed, added = (sorted(r.text for r in rows if r.type == t) for t in ("removed", "added"))
        assert not set(removed) & set(added)
        for r in rows:
            if r.type == "modified":
                assert a[r.old_pos] == r["from"] and b[r.new_pos] == r.to and SequenceMatcher(None, r["from"], r.to).ratio() >= tracking.LIKE
            elif r.type == "removed":
                assert a[r.old_pos] == r.text
            else:
                assert b[r.new_pos] == r.text


def plainly(old, new):
    """Entries of two step lists by difflib alone, as (type, old place, new place)."""
    out = []
    for tag, i, i_end, j, j_end in SequenceMatcher(None, old, new, autojunk=False).get_opcodes():
        if tag == "equal":
            continue
        used = set()
        for k in range(i, i_end):
            best, at = 0.0, None
            for m in range(j, j_end):
                ratio = SequenceMatcher(None, old[k], new[m]).ratio() if m not in used else 0.0
                if ratio > best:
                    best, at = ratio, m
            if at is not None and best >= tracking.LIKE:
                used.add(at)
                out.append((k, at))
            else:
                out.append((k, None))
        out += [(None, m) for m in range(j, j_end) if m not in used]
    return out


@pytest.mark.parametrize("seed", range(4))
def test_alignment_equals_difflib(seed):
    """Repeated lines, near texts around the likeness, equal beginnings and ends, and long texts with common signs."""
    rng = random.Random(seed)
    words = ["stir", "the", "pot", "and", "salt", "wait", "x"]
    for _ in range(150):
        old = [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 6))) for _ in range(rng.randrange(0, 14))]
        if rng.random() < 0.2:
            old = [o * 60 for o in old]
        new = [w for w in old if rng.random() < 0.8]
        for _ in range(rng.randrange(4)):
            new[rng.randrange(len(new) + 1) : 0] = [rng.choice([*old, "fresh " + rng.choice(words), "ünïcode ☃"])]
        new = [n.replace("salt", "pepper") if rng.random() < 0.2 else n for n in new]
        assert list(tracking._align(old, new)) == plainly(old, new), (old, new)


def test_nothing_is_shuffled(spark):
    flat = texts(spark, whole(steps=[("a", 0)]), whole(steps=[("b", 0)]))
    df = spark.createDataFrame([(1, *flat), (2, None, flat[0]), (3, flat[0], flat[0])], "recipe_id int, old string, new string")
    found = tracking.changes(df)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.recipe_id, r.type, r.text) for r in found.collect()) == [(1, "added", "b"), (1, "removed", "a")]


def test_heading_sync(spark):
    schema = "recipe_id int, position int, is_heading int, text string"
    old = spark.createDataFrame([(1, 0, 1, "OLD"), (1, 1, 0, "a"), (1, 2, 0, "b"), (2, 0, 0, "x")], schema)
    now = spark.createDataFrame([(1, 0, 0, "a"), (1, 1, 1, "NEW"), (1, 2, 0, "b"), (1, 3, 0, "c"), (1, 4, 1, "LATE"), (2, 0, 1, "T"), (2, 1, 0, "y")], schema)
    got = sorted((r.recipe_id, r.position, r.text) for r in tracking.with_current_headings(old, now).collect())
    assert got == [(1, 0, "a"), (1, 1, "NEW"), (1, 2, "b"), (1, 3, "LATE"), (2, 0, "T"), (2, 1, "x")]
    assert tracking.content_violations(old, tracking.with_current_headings(old, now)).count() == 0
    assert [r.recipe_id for r in tracking.content_violations(old, now).orderBy("recipe_id").collect()] == [1, 2]


def test_guard_stops_a_batch_that_changes_content(spark):
    schema = "recipe_id int, position int, is_heading int, text string"
    before = spark.createDataFrame([(1, 0, 1, "OLD"), (1, 1, 0, "a"), (1, 2, 0, None), (2, 0, 0, "x"), (3, 0, 0, "alone")], schema)
    after = spark.createDataFrame([(1, 0, 0, "a"), (1, 1, 1, "NEW"), (1, 2, 0, None), (2, 0, 0, "x"), (4, 0, 0, "no baseline")], schema)
    assert sorted((r.recipe_id, r.position) for r in tracking.guarded(before, after).collect()) == [(1, 0), (1, 1), (1, 2)]
    assert tracking.guarded(before, before).count() == 0 and tracking.guarded(before.where("false"), after).count() == 0
    for bad in ([(2, 0, 0, "y")], [(2, 0, 0, "x"), (2, 1, 0, "z")], [(2, 1, 0, "x")], [(2, 0, 1, "x")], [(1, 0, 0, None), (1, 1, 0, "a")]):
        with pytest.raises(Exception, match="heading sync would change the content of recipe"):
            tracking.guarded(before, spark.createDataFrame(bad, schema)).collect()
    assert [r.recipe_id for r in tracking.content_violations(before, after).orderBy("recipe_id").collect()] == [3, 4]


def test_slugs_follow_the_batch(spark):
    rng = random.Random(4)
    bases = [rng.choice(["x", "x-2", "x-2-3", "y", "pie", "pie-10"]) for _ in range(60)] + ["alone"]
    taken = {"x", "pie-2", "y-3"}
    want, seen = [], set(taken)
    for b in bases:
        slug, n = b, 2
        while slug in seen:
            slug, n = f"{b}-{n}", n + 1
        seen.add(slug)
        want.append(slug)
    batch = spark.createDataFrame(list(enumerate(bases)), "entry long, base string")
    got = slugs.mint(batch, spark.createDataFrame([(t,) for t in taken], "slug string"))
    assert [r.slug for r in sorted(got.collect())] == want
