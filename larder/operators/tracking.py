"""Change tracking: canonical snapshots, content-matched differences, moves, heading layout.

Both snapshots of a recipe stand in one row, so differences are found where the row is: the lines of
either side are arrays, built by expressions, and nothing is shuffled. Only the alignment of two
sequences of texts has no expression. A small kernel does it on the keys and takes what stands in the
places that differ. Lines that keep their order are aligned without a search; texts are compared only
inside stretches that were replaced, and only those that the counts of their signs allow to be alike.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from larder.functions.shipping import ship
from larder.functions.amounts import canonical_units
from larder.functions.text import let

ship(__name__)

# What a snapshot holds, and the likeness from which two lines are one that changed.
FIELDS = ("name", "author", "source_url", "category", "servings", "prep_time", "cook_time", "total_time", "descr", "notes", "image")
LINE_FIELDS = ("position", "is_heading", "qty", "ingredient_id", "label", "note", "raw_text", "grams", "secondary_measure", "quantity", "unit")
LIKE = 0.6
#: Likenesses of short texts that a task remembers, and the rows whose texts it holds at a time.
REMEMBERED, ROWS = 50_000, 512
_LINE = "struct<grams:double,ingredient_id:string,is_heading:int,label:string,note:string,position:int,qty:string,quantity:string,raw_text:string,secondary_measure:string,unit:string>"
SNAPSHOT = f"ingredients array<{_LINE}>, recipe struct<{','.join(f'{f}:string' for f in sorted(FIELDS))}>, steps array<struct<is_heading:int,position:int,text:string>>"


def content(recipe: Column, ingredients: Column, steps: Column) -> Column:
    """What a snapshot holds, as a struct with sorted keys."""
    kept = lambda s, names: F.struct(*(s[n].alias(n) for n in sorted(names)))
    return F.struct(F.transform(ingredients, lambda r: kept(r, LINE_FIELDS)).alias("ingredients"), kept(recipe, FIELDS).alias("recipe"), F.transform(steps, lambda r: kept(r, ("position", "is_heading", "text"))).alias("steps"))


def snapshot(recipe: Column, ingredients: Column, steps: Column) -> Column:
    """The canonical JSON text: keys sorted, nulls kept, so that equal contents are equal bytes."""
    return F.to_json(content(recipe, ingredients, steps), {"ignoreNullFields": "false"})


#: Parts of a snapshot in the order of their entries.
INGREDIENT, INGREDIENT_HEADING, STEP, STEP_HEADING = range(4)
#: Stands in a part's place for a field of the recipe.
FIELD = 4


def _lines(parsed: Column) -> Column:
    """The ingredient lines of a parsed snapshot: (part, key, move, name, qty, note, item, text).

    ``key`` is what rows are matched on, ``move`` what a moved row keeps, ``text`` how a row alone is shown.
    A heading's key is its text as it stands. Steps have their text as name and key, and stripped as move and text.
    """
    heading = lambda r: F.coalesce(r["is_heading"], F.lit(0)) == 1

    def row(*values: Column) -> Column:
        return F.struct(*(c.alias(n) for c, n in zip(values, ("part", "key", "move", "name", "qty", "note", "item", "text"), strict=True)))

    def line(r: Column) -> Column:
        raw = F.coalesce(r["raw_text"], F.lit(""))
        name = F.when(heading(r), raw).otherwise(F.coalesce(F.nullif(r["label"], F.lit("")), raw))
        text = F.trim(F.concat_ws(" ", F.coalesce(r["qty"], F.lit("")), name))
        return let(
            F.struct(raw.alias("raw"), name.alias("name"), text.alias("text"), heading(r).alias("h")),
            lambda x: row(
                F.when(x["h"], INGREDIENT_HEADING).otherwise(INGREDIENT), F.when(x["h"], x["raw"]).otherwise(F.trim(F.concat_ws(" ", canonical_units(r["qty"]), x["name"]))),
                F.when(x["h"], x["text"]).otherwise(canonical_units(x["text"])), x["name"], r["qty"], r["note"], F.nullif(r["ingredient_id"], F.lit("")), x["text"],
            ),
        )

    return F.transform(F.coalesce(parsed["ingredients"], F.array().cast(f"array<{_LINE}>")), line)


def _in_order(a: list[str], b: list[str]) -> list[tuple[int, int]] | None:
    """Places of the texts that both sides have, if each stands once on either side and in one order; else None.

    An alignment by longest blocks keeps all of them then, whichever block it begins with.
    """
    at = dict(zip(b, range(len(b)), strict=True))
    if len(at) < len(b):
        at |= {t: -1 for t, n in Counter(b).items() if n > 1}
    places, last = [], -1
    for i, text in enumerate(a):
        j = at.get(text)
        if j is not None:
            if j <= last:
                return None
            places.append((i, j))
            last = j
    return places


def _free_end(a: list[str], b: list[str]) -> int:
    """How many first texts both sides share, if none of them stands anywhere else; else 0.

    An alignment by longest blocks always keeps such a beginning whole, so it may be left out of it.
    """
    n = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    own = set(a[:n])
    return n if own.isdisjoint(a[n:]) and own.isdisjoint(b[n:]) else 0


def _signs(texts: list[str]) -> np.ndarray:
    """How often each of 64 classes of signs stands in each text."""
    out = np.zeros((len(texts), 64), np.int32)
    for i, t in enumerate(texts):
        codes = np.frombuffer(t.encode("utf-32-le"), np.uint32)
        out[i] = np.bincount(codes & 63, minlength=64)
    return out


def _remember(known: dict[tuple[str, str], float], a: str, b: str, ratio: float) -> None:
    if len(a) + len(b) <= 400:
        if len(known) >= REMEMBERED:
            known.clear()
        known[a, b] = ratio


def _paired(old: list[str], new: list[str], known: dict[tuple[str, str], float]) -> Iterator[tuple[int | None, int | None]]:
    """Each old text with the likest new one that is still free and alike enough, in order; then the new ones left over."""
    if not old or not new:
        yield from ((k, None) for k in range(len(old)))
        yield from ((None, m) for m in range(len(new)))
        return
    alone = len(old) == len(new) == 1
    free = np.ones(len(new), bool)
    signs, sizes = _signs(new), np.array([len(t) for t in new], np.int64)
    matchers: dict[int, SequenceMatcher] = {}
    for k, (text, own) in enumerate(zip(old, _signs(old), strict=True)):
        # no more signs can match than both texts have
        most = 2.0 * np.minimum(own, signs).sum(1) / np.maximum(sizes + len(text), 1)
        most[sizes + len(text) == 0] = 1.0
        if alone and most[0] < LIKE:
            _remember(known, text, new[0], float(most[0]))
        best, at = 0.0, None
        for m in np.flatnonzero(free & (most >= LIKE)).tolist():
            if most[m] > best:
                ratio = known.get((text, new[m]))
                if ratio is None:
                    matcher = matchers.get(m) or matchers.setdefault(m, SequenceMatcher(None, "", new[m]))
                    matcher.set_seq1(text)
                    ratio = matcher.ratio()
                    _remember(known, text, new[m], ratio)
                if ratio > best:
                    best, at = ratio, m
        if at is not None and best >= LIKE:
            free[at] = False
            yield k, at
        else:
            yield k, None
    yield from ((None, m) for m in np.flatnonzero(free).tolist())


def _replaced(a: list[str], b: list[str]) -> Iterator[tuple[int, int, int, int]]:
    """Stretches (of a: begin, end; of b: begin, end) that an alignment by longest blocks leaves over."""
    places = _in_order(a, b)
    if places is not None:
        i = j = 0
        for k, m in (*places, (len(a), len(b))):
            if k > i or m > j:
                yield i, k, j, m
            i, j = k + 1, m + 1
        return
    head = _free_end(a, b)
    tail = _free_end(a[head:][::-1], b[head:][::-1])
    # texts as numbers: equal ones are told by their numbers
    number: dict[str, int] = {}
    a, b = ([number.setdefault(t, len(number)) for t in x[head : len(x) - tail]] for x in (a, b))
    for kind, i, i_end, j, j_end in SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
        if kind != "equal":
            yield head + i, head + i_end, head + j, head + j_end


def _align(a: list[str], b: list[str], known: dict[tuple[str, str], float] | None = None) -> Iterator[tuple[int | None, int | None]]:
    """Places (in a, in b) of what isn't equal: changed pairs, and entries of one side alone."""
    known = {} if known is None else known
    for i, i_end, j, j_end in _replaced(a, b):
        like = known.get((a[i], b[j])) if i_end - i == j_end - j == 1 else None
        if like is None:
            for k, m in _paired(a[i:i_end], b[j:j_end], known):
                yield None if k is None else i + k, None if m is None else j + m
        elif like >= LIKE:
            yield i, j
        else:
            yield i, None
            yield None, j


def _sections(parts: list[int]) -> list[int]:
    """The place of the heading over each row; -1 for none."""
    sections, section = [], -1
    for i, part in enumerate(parts):
        sections.append(section)
        section = i if part % 2 else section
    return sections


def _linked(a: Sequence[int], b: Sequence[int], old: list[str | None], new: list[str | None]) -> list[tuple[int, int]]:
    """Numbers of rows that hold the same occurrence of one item."""
    places: dict[tuple, int] = {}
    count: Counter = Counter()
    for n, j in enumerate(b):
        if new[j] is not None:
            places[new[j], count[new[j]]] = n
            count[new[j]] += 1
    count.clear()
    linked = []
    for n, i in enumerate(a):
        if old[i] is not None:
            at = places.get((old[i], count[old[i]]))
            count[old[i]] += 1
            if at is not None:
                linked.append((n, at))
    return linked


def differences(old: dict[str, list], new: dict[str, list], known: dict[tuple[str, str], float] | None = None) -> list[tuple[int, ...]]:
    """(part, old place, new place, old number, new number, heading's old place) of each difference; -1 for none.

    Each side has its lines' parts, keys, items and moves and its steps' parts and texts. Places are those in
    either list, numbers count rows of one part. Linked lines meet by their item's occurrence, the others by
    alignment. A removed and an added row of one kind that a move would explain go, one to one.
    """
    entries: list[tuple[int, ...]] = []
    for old_parts, old_keys, new_parts, new_keys in ((old["part"], old["key"], new["part"], new["key"]), (old["step"], old["text"], new["step"], new["text"])):
        sections: list[int] | None = None
        found = {*old_parts, *new_parts}
        for part in sorted(found):
            a, b = ([i for i, p in enumerate(parts) if p == part] if len(found) > 1 else range(len(parts)) for parts in (old_parts, new_parts))
            free_a, free_b = range(len(a)), range(len(b))
            if part == INGREDIENT:
                linked = _linked(a, b, old["item"], new["item"])
                entries += [(part, a[n], b[m], n, m, -1) for n, m in linked]
                met_a, met_b = {n for n, _ in linked}, {m for _, m in linked}
                free_a, free_b = [n for n in free_a if n not in met_a], [m for m in free_b if m not in met_b]
            headed = part + 1 in found and not part % 2
            for k, m in _align([old_keys[a[n]] for n in free_a], [new_keys[b[n]] for n in free_b], known):
                if k is None:
                    entries.append((part, -1, b[free_b[m]], -1, free_b[m], -1))
                elif m is not None:
                    entries.append((part, a[free_a[k]], b[free_b[m]], free_a[k], free_b[m], -1))
                else:
                    if headed and sections is None:
                        sections = _sections(old_parts)
                    entries.append((part, a[free_a[k]], -1, free_a[k], -1, sections[a[free_a[k]]] if headed else -1))
    kinds = (0, 2, 1, 2)
    move = lambda side, part, i: (kinds[part], side["move"][i] if part < STEP else side["text"][i].strip(" "))
    gone = [move(old, e[0], e[1]) for e in entries if e[2] < 0]
    come = [move(new, e[0], e[2]) for e in entries if e[1] < 0]
    if set(gone).isdisjoint(come):
        return entries
    moved = Counter(gone) & Counter(come)
    left = [moved.copy(), moved.copy()]
    out = []
    for e in entries:
        if min(e[1], e[2]) < 0:
            own, key = (left[0], move(old, e[0], e[1])) if e[2] < 0 else (left[1], move(new, e[0], e[2]))
            if own[key] > 0:
                own[key] -= 1
                continue
        out.append(e)
    return out


#: A difference as the kernel tells it: what stands on either side, null where nothing does.
_SHOWN = ("name", "qty", "note", "text")
_ENTRY = ("part", "old_pos", "new_pos", "section", "field", *(f"{side}_{n}" for side in "on" for n in _SHOWN))


class _Side:
    """Lines and steps of some rows, end to end: each row's begin and end at ``bounds``; steps stand behind all lines."""

    def __init__(self, lines: pa.Array, steps: pa.Array) -> None:
        self.bounds = [np.cumsum([0, *c.value_lengths().to_numpy()]) for c in (lines, steps)]
        lines, steps = lines.flatten(), steps.flatten()
        text, none, self.n_lines = pc.fill_null(steps.field("text"), ""), pa.nulls(len(steps), pa.string()), len(lines)
        own = {"key": text, "name": text, "qty": none, "note": none, "text": pc.utf8_trim(text, " ")}
        self.shown = {n: pa.concat_arrays([lines.field(n).cast(pa.string()), c.cast(pa.string())]) for n, c in own.items()}
        listed = lambda c: c.to_numpy(zero_copy_only=False).tolist()
        heads = pc.fill_null(pc.equal(steps.field("is_heading"), 1), False)
        self.lines = {n: listed(lines.field(n)) for n in ("part", "key", "item", "move")}
        self.steps = {"step": np.where(heads.to_numpy(zero_copy_only=False), STEP_HEADING, STEP).tolist(), "text": listed(text)}

    def rows(self) -> Iterator[dict[str, list]]:
        lines, steps = (b.tolist() for b in self.bounds)
        for i, i_end, j, j_end in zip(lines[:-1], lines[1:], steps[:-1], steps[1:], strict=True):
            yield {n: c[i:i_end] for n, c in self.lines.items()} | {n: c[j:j_end] for n, c in self.steps.items()}

    def take(self, name: str, part: np.ndarray, row: np.ndarray, place: np.ndarray) -> pa.Array:
        at = place + np.where(part < STEP, self.bounds[0][row], self.n_lines + self.bounds[1][row])
        return self.shown[name].take(pa.array(at, pa.int64(), mask=place < 0))


def _told(old: _Side, new: _Side, known: dict[tuple[str, str], float]) -> pa.Array:
    """A list of differences for each row of both sides."""
    found = [differences(a, b, known) for a, b in zip(old.rows(), new.rows(), strict=True)]
    sizes = [len(entries) for entries in found]
    part, i, j, old_pos, new_pos, head = np.array([e for entries in found for e in entries], np.int64).reshape(-1, 6).T
    row = np.repeat(np.arange(len(sizes)), sizes)
    number = lambda n: pa.array(n, pa.int32(), mask=n < 0)
    shown = [side.take(n, part, row, place) for side, place in ((old, i), (new, j)) for n in _SHOWN]
    columns = [number(part), number(old_pos), number(new_pos), old.take("key", part, row, head), pa.nulls(len(part), pa.string()), *shown]
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), pa.StructArray.from_arrays(columns, list(_ENTRY)))


@F.arrow_udf(ArrayType(StructType([StructField(n, IntegerType() if i < 3 else StringType()) for i, n in enumerate(_ENTRY)])))
def _differences(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """:func:`differences` of each row's old lines and steps and its new ones, with the texts of their places."""
    known: dict[tuple[str, str], float] = {}
    for batch in batches:
        for at in range(0, len(batch[0]), ROWS):
            old_lines, old_steps, new_lines, new_steps = (c.slice(at, ROWS) for c in batch)
            yield _told(_Side(old_lines, old_steps), _Side(new_lines, new_steps), known)


def field_changes(pairs: DataFrame) -> DataFrame:
    """(recipe_id, field, from, to) of recipe fields that differ; null and empty are the same."""
    both = pairs.select("recipe_id", F.from_json("old", SNAPSHOT)["recipe"].alias("o"), F.from_json("new", SNAPSHOT)["recipe"].alias("n"))
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(f).alias("field"), F.col(f"o.{f}").alias("from"), F.col(f"n.{f}").alias("to")) for i, f in enumerate(FIELDS))))
    return both.select("recipe_id", each.alias("c")).select("recipe_id", "c.*").where("coalesce(`from`, '') <> coalesce(`to`, '')")


def changes(pairs: DataFrame) -> DataFrame:
    """Differences of (recipe_id, old, new) snapshots: recipe_id, kind, type, field, label, from, to, text, new_pos, old_pos, section.

    Snapshots are texts, or the contents that stand in no text yet.
    Positions leave headings out. A pure move is no change: a removed and an added row of one kind and
    text pair off one to one. Equal snapshots, and null ones, give no rows. Nothing is shuffled.
    """
    # texts written, parsed and told apart once each: a generator's outputs aren't merged into what reads them
    once = lambda c: F.explode(F.array(c)).alias("x")
    whole = pairs.select("recipe_id", once(F.struct("old", "new"))).where("x.old IS NOT NULL AND x.new IS NOT NULL AND x.old <> x.new")
    if pairs.schema["old"].dataType == StringType():
        whole = whole.select("recipe_id", once(F.struct(F.from_json("x.old", SNAPSHOT).alias("old"), F.from_json("x.new", SNAPSHOT).alias("new"))))
    parsed = whole.select("recipe_id", F.col("x.old").alias("o"), F.col("x.new").alias("n"))
    steps = lambda side: F.coalesce(f"{side}.steps", F.array().cast("array<struct<is_heading:int,position:int,text:string>>"))
    both = parsed.select("recipe_id", F.col("o.recipe").alias("o"), F.col("n.recipe").alias("n"), *(steps(side).alias(f"{side}_steps") for side in "on"), once(F.struct(_lines(F.col("o")).alias("o_lines"), _lines(F.col("n")).alias("n_lines"))))
    both = both.withColumn("found", _differences.asNondeterministic()("x.o_lines", "o_steps", "x.n_lines", "n_steps"))
    none = F.lit(None).cast("string")
    told = {"part": F.lit(FIELD), "old_pos": F.lit(None).cast("int"), "new_pos": F.lit(None).cast("int")}
    field = lambda f: F.struct(*(c.alias(n) for n, c in ((n, (told | {"field": F.lit(f), "o_name": F.col(f"o.{f}"), "n_name": F.col(f"n.{f}")}).get(n, none)) for n in _ENTRY)))
    fields = F.array_compact(F.array(*(F.when(F.coalesce(f"o.{f}", F.lit("")) != F.coalesce(f"n.{f}", F.lit("")), field(f)) for f in FIELDS)))
    # arrays are made in projections, since what stands in a generator isn't compiled
    full = both.select("recipe_id", F.concat(fields, "found").alias("e")).select("recipe_id", F.explode("e").alias("e")).select("recipe_id", "e.*")
    kinds = F.when(F.col("part") == FIELD, "field").when(F.col("part") == INGREDIENT, "ingredient").when(F.col("part") == STEP, "step").otherwise("heading")
    null = lambda c: F.coalesce(F.col(c), F.lit(""))
    entry = lambda type_, field, label, a, b, text, section: F.struct(*(c.alias(n) for c, n in zip((F.lit(type_), F.lit(field).cast("string"), label, a, b, text, section), ("type", "field", "label", "from", "to", "text", "section"), strict=True)))
    line = F.col("part") == INGREDIENT
    label = F.when(line, F.coalesce(F.nullif("n_name", F.lit("")), "o_name"))
    changed = lambda field, a, b: entry("modified", field, label, a, b, none, none)
    alone = lambda type_, side, section: F.array(entry(type_, None, F.when(line, F.col(f"{side}_name")), none, none, F.col(f"{side}_text"), section))
    aspects = F.array_compact(F.array(
        F.when(line & (canonical_units(F.col("o_qty")) != canonical_units(F.col("n_qty"))), changed("amount", null("o_qty"), null("n_qty"))),
        F.when(line & (F.col("o_name") != F.col("n_name")), changed("name", F.col("o_name"), F.col("n_name"))),
        F.when(line & (null("o_note") != null("n_note")), changed("note", null("o_note"), null("n_note"))),
        F.when(~line & (F.col("o_name") != F.col("n_name")), changed(None, F.col("o_name"), F.col("n_name"))),
    ))
    own = F.array(entry("modified", None, none, F.col("o_name"), F.col("n_name"), none, none).withField("field", F.col("field")))
    told = F.when(F.col("part") == FIELD, own).when(F.col("n_name").isNull(), alone("removed", "o", F.col("section"))).when(F.col("o_name").isNull(), alone("added", "n", none)).otherwise(aspects)
    told = full.select("recipe_id", kinds.alias("kind"), "new_pos", "old_pos", told.alias("told"))
    return told.select("recipe_id", "kind", "new_pos", "old_pos", F.explode("told").alias("t")).select("recipe_id", "kind", "t.type", "t.field", "t.label", "t.from", "t.to", "t.text", "new_pos", "old_pos", "t.section")


def with_current_headings(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """Baseline content rows under the current headings, renumbered: (recipe_id, position, is_heading, text).

    A heading goes before the content row whose number it had among the current ones, at the end if
    the baseline is shorter.
    """
    before = F.sum(1 - F.col("is_heading")).over(Window.partitionBy("recipe_id").orderBy("position").rowsBetween(Window.unboundedPreceding, -1))
    content = baseline.where("is_heading = 0").select("recipe_id", "is_heading", "text", (F.row_number().over(Window.partitionBy("recipe_id").orderBy("position")) - 1).alias("slot"), F.lit(1).alias("late"), "position")
    sizes = content.groupBy("recipe_id").agg(F.count("*").alias("n"))
    heads = current.withColumn("slot", F.coalesce(before, F.lit(0))).where("is_heading = 1").join(sizes, "recipe_id", "left")
    heads = heads.select("recipe_id", "is_heading", "text", F.least("slot", F.coalesce("n", F.lit(0))).cast("int").alias("slot"), F.lit(0).alias("late"), "position")
    order = Window.partitionBy("recipe_id").orderBy("slot", "late", "position")
    return content.unionByName(heads).withColumn("position", (F.row_number().over(order) - 1).cast("int")).select("recipe_id", "position", "is_heading", "text")


def _digests(rows: DataFrame) -> DataFrame:
    """(recipe_id, content, layout, dense): hashes of the content rows in order and of all rows with their places, and whether places run 0, 1, 2, ...

    Texts are hashed before anything is ordered; a hash of a set is the exclusive or of its rows' hashes.
    """
    hashed = rows.select("recipe_id", "position", "is_heading", F.xxhash64("text").alias("a"), F.xxhash64(F.lit(5), "text").alias("b"))
    order = Window.partitionBy("recipe_id").orderBy("position")
    placed = hashed.withColumns({"n": F.row_number().over(order) - 1, "nth": F.sum(1 - F.col("is_heading")).over(order.rowsBetween(Window.unboundedPreceding, 0))})
    both = lambda rows, *c: F.struct(*(F.coalesce(F.bit_xor(F.when(rows, F.xxhash64(*c, h))), F.lit(0)) for h in ("a", "b")), F.count_if(rows))
    kept = F.col("is_heading") == 0
    return placed.groupBy("recipe_id").agg(both(kept, "nth").alias("content"), both(F.lit(True), "position", "is_heading").alias("layout"), F.every(F.col("n") == F.col("position")).alias("dense"))


def content_violations(before: DataFrame, after: DataFrame) -> DataFrame:
    """Recipes whose content rows differ between two layouts, or whose positions aren't 0, 1, 2, ...: empty if a sync was safe.

    A recipe that only one side has differs if it has content there.
    """
    old, new = _digests(before).select("recipe_id", F.col("content").alias("old")), _digests(after).select("recipe_id", F.col("content").alias("new"), "dense")
    nothing = F.struct(F.lit(0).cast("long"), F.lit(0).cast("long"), F.lit(0).cast("long"))
    joined = old.join(new, "recipe_id", "full")
    return joined.where((F.coalesce("old", nothing) != F.coalesce("new", nothing)) | ~F.coalesce("dense", F.lit(True))).select("recipe_id")


def guarded(before: DataFrame, after: DataFrame) -> DataFrame:
    """C14: the rows of ``after`` of recipes whose layout differs from ``before``; what stays the same isn't written again.

    A recipe without a layout before is left alone. If one's content rows would change, or its positions
    aren't 0, 1, 2, ..., the plan fails and names it, so nothing of the batch is written.
    """
    old = _digests(before).select("recipe_id", F.col("content").alias("old_content"), F.col("layout").alias("old_layout"))
    both = _digests(after).join(old, "recipe_id")
    bad = (F.col("content") != F.col("old_content")) | ~F.col("dense")
    stop = F.raise_error(F.concat(F.lit("heading sync would change the content of recipe "), F.col("recipe_id").cast("string"))).cast("boolean")
    changed = both.where(F.when(bad, stop).otherwise(F.col("layout") != F.col("old_layout"))).select("recipe_id")
    return after.join(changed, "recipe_id", "left_semi")
