"""Secret scan with multipart credential linking, in DataFrame functions alone.

Strong secrets (assigned values, access keys, long hex runs) count wherever they stand. Weak parts,
an account name, an opaque token, an endpoint, say little by themselves: each is reported only if a
complementary part stands in the same scope (a block between blank lines) at most ``REACH`` code
points away. Parts become intervals; an interval join on (document, scope, bucket of positions)
finds the partners. For each kind and bucket only the outermost positions are kept, which decide
the question exactly, so the join makes at most three rows for a part and kind of partner, however
many parts a scope holds.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from larder.llm.common import checkpoint, columns_of, free_names, text_or_empty

# The strong kinds, in the order in which ties are listed, with the least length of what counts.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
ASSIGN_LEAST, ACCESS_LEAST = 6, 20

#: Weak parts; each pattern is one alternative of a single scan, named by its order.
IDENTIFIER = r"""(?i:\b(?:user(?:_?name)?|login|account|client_?id|access_?key_?id))["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@+-]{2,}"""
WEAK_SECRET = r"""(?i:\b(?:pwd|pass|passphrase|auth|bearer|credential|private_?key))["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{4,}"""
OPAQUE = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[a-z0-9+/_-]*[A-Z])(?=[A-Z0-9+/_-]*[a-z])[A-Za-z0-9+/_-]{16,}={0,2}"
ENDPOINT = r"""https?://[^\s"'<>]+|jdbc:[a-z0-9]+:[^\s"'<>]+"""
BREAK = r"\n[ \t\r]*\n"
WEAK = f"{IDENTIFIER}|{WEAK_SECRET}|{ENDPOINT}|{OPAQUE}|{BREAK}"
REACH = 400
KINDS = ("assign", "access", "hex", "identifier", "weak_secret", "endpoint")
_SPAN = "array<struct<start:bigint,no:int,stop:bigint>>"
_BLOCK = 128


def _running(values: Column) -> Column:
    """Running sums of an array of longs, in blocks, so that long arrays aren't copied for each element."""

    def sums(block: Column) -> Column:
        zero = F.array(F.lit(0).cast("long"))
        return F.slice(F.aggregate(block, zero, lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x))), 2, F.greatest(F.size(block), F.lit(1)))

    starts = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(values) / _BLOCK) - 1, F.lit(0)).cast("int")), lambda b: b * _BLOCK + 1)
    blocks = F.transform(starts, lambda a: sums(F.slice(values, a, _BLOCK)))
    before = F.aggregate(blocks, F.array(F.lit(0).cast("long")), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + F.coalesce(F.element_at(x, -1), F.lit(0)))))
    shifted = F.zip_with(blocks, F.slice(before, 1, F.size(blocks)), lambda x, o: F.transform(x, lambda y: y + o))
    return F.when(F.size(values) > 0, F.flatten(shifted)).otherwise(F.array().cast("array<bigint>"))


def located(text: str, found: str, pattern: str) -> Column:
    """Array of (start, stop, match), in code points, for column ``found``: all matches of the pattern in column ``text``.

    The pieces between matches and the matches themselves have lengths whose running sums are the places.
    """
    hits = F.col(found)
    gaps = F.split(F.col(text), pattern, -1)
    steps = F.zip_with(F.slice(gaps, 1, F.size(hits)), hits, lambda g, h: (F.length(g) + F.length(h)).cast("long"))
    spans = F.zip_with(_running(steps), hits, lambda stop, h: F.struct((stop - F.length(h)).alias("start"), stop.alias("stop"), h.alias("hit")))
    return F.when(F.size(hits) > 0, spans).otherwise(F.array().cast("array<struct<start:bigint,stop:bigint,hit:string>>"))


def _spans(column: str, no: int, keep=None) -> Column:
    spans = F.col(column) if keep is None else F.filter(column, keep)
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(no).alias("no"), s["stop"].alias("stop")))


def _weak_no(hit: Column) -> Column:
    """The number of a weak part's kind; -1 for the blank line that ends a scope."""
    return (
        F.when(hit.rlike(r"^\n"), -1)
        .when(hit.rlike(r"^(https?://|jdbc:)"), 5)
        .when(hit.rlike(r"""^(?i:user(?:_?name)?|login|account|client_?id|access_?key_?id)["']?\x20*[:=]"""), 3)
        .otherwise(4)
    )


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, text_hash, base, weak, the located spans.

    ``base`` holds the strong spans sorted by start and kind; ``weak`` the weak parts, with the scope breaks.
    """
    found = docs.select("doc_id", text_or_empty().alias("text")).withColumns(
        {
            "text_hash": F.xxhash64("text"),
            "assign": F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(0)),
            "access": F.regexp_extract_all("text", F.lit(ACCESS), F.lit(0)),
            "hex": F.regexp_extract_all("text", F.lit(HEX), F.lit(0)),
            "weak": F.regexp_extract_all("text", F.lit(WEAK), F.lit(0)),
        }
    )
    # a weak part can only be reported beside another part: most texts are done here
    found = found.withColumn("weak", F.when(F.size(F.filter("weak", lambda h: ~h.rlike(r"^\n"))) > 0, F.col("weak")).otherwise(F.array().cast("array<string>")))
    placed = found.select("doc_id", "text_hash", *(located("text", k, p).alias(k) for k, p in (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX), ("weak", WEAK))))
    base = placed.select(
        "doc_id",
        "text_hash",
        F.array_sort(
            F.concat(
                _spans("assign", 0, lambda s: F.length(F.regexp_extract(s["hit"], ASSIGN, 2)) >= ASSIGN_LEAST),
                _spans("access", 1, lambda s: s["stop"] - s["start"] >= ACCESS_LEAST),
                _spans("hex", 2),
            )
        ).alias("base"),
        F.transform("weak", lambda s: F.struct(s["start"].alias("start"), _weak_no(s["hit"]).alias("no"), s["stop"].alias("stop"))).alias("weak"),
    )
    return base.withColumns({"weak": F.col("weak").cast(_SPAN), "base": F.col("base").cast(_SPAN)})


def link_parts(scanned: DataFrame, reach: int = REACH) -> DataFrame:
    """(doc_id, text_hash, linked): the weak parts that have their complement in reach within their scope.

    A weak secret needs an identifier, an identifier a secret, an endpoint both. Weak parts that overlap
    a strong one are no parts of their own. Rows of equal doc_id and text are one document here.
    """
    key = ["doc_id", "text_hash"]
    has = lambda c, *nos: F.exists(c, lambda s: reduce(lambda a, b: a | b, (s["no"] == n for n in nos)))
    paired = (has("weak", 3) & (has("weak", 4) | has("base", 0, 2))) | (has("weak", 4) & has("base", 1)) | (has("weak", 5) & has("base", 1) & has("base", 0, 2))
    able = scanned.where(paired).select(*key, F.concat("base", "weak").alias("part")).distinct()
    parts = able.select(*key, F.explode("part").alias("part")).select(*key, "part.*")
    order = Window.partitionBy(*key).orderBy("start", "no", "stop")
    strong = F.col("no").between(0, 2)
    ended = F.max(F.when(strong, F.col("stop"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.min(F.when(strong, F.col("start"))).over(order.rowsBetween(1, Window.unboundedFollowing))
    parts = parts.withColumns({"ended": ended, "begins": begins}).where((F.col("no") < 3) | ~(F.coalesce(F.col("ended") > F.col("start"), F.lit(False)) | F.coalesce(F.col("begins") < F.col("stop"), F.lit(False))))
    parts = parts.drop("ended", "begins")
    scope = F.sum((F.col("no") < 0).cast("long")).over(order)
    role = F.when(F.col("no").isin(1, 3), "id").when(F.col("no").isin(0, 2, 4), "secret").otherwise("endpoint")
    parts = parts.withColumn("scope", scope).where("no >= 0").withColumns({"role": role, "bucket": F.floor(F.col("start") / reach)})
    ends = parts.where("role <> 'endpoint'").groupBy(*key, "scope", F.col("role").alias("partner"), F.col("bucket").alias("near")).agg(F.min("start").alias("low"), F.max("start").alias("high"))
    weak = parts.where("no >= 3").withColumn("near", F.explode(F.array(F.col("bucket") - 1, F.col("bucket"), F.col("bucket") + 1)))
    same = reduce(lambda x, y: x & y, (F.col(f"w.{c}").eqNullSafe(F.col(f"e.{c}")) for c in (*key, "scope", "near")))
    met = weak.alias("w").join(ends.alias("e"), same).select("w.*", "partner", "low", "high").where("role <> partner").where(f"near = bucket or (near < bucket and start - high <= {reach}) or (near > bucket and low - start <= {reach})")
    partners = met.groupBy(*key, "scope", "start", "no", "stop", "role").agg(F.count_distinct("partner").alias("partners"))
    kept = partners.where("partners = 2 or role <> 'endpoint'")
    return kept.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("start", "no", "stop"))).cast(_SPAN).alias("linked"))


def find_secrets(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """One row per row of ``docs``: doc_id, text_hash, base and linked span arrays (start, no, stop) in code points.

    Null texts are empty and have no spans. Repeated rows come back as often as they are there; a null
    doc_id is kept. An empty table gives an empty result. Other columns are not read.
    """
    scanned = checkpoint(scan(docs))
    linked = link_parts(scanned, reach)
    joined = scanned.alias("a").join(linked.alias("b"), F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.text_hash") == F.col("b.text_hash")), "left")
    return joined.select("a.doc_id", "a.text_hash", "base", F.coalesce("linked", F.array().cast(_SPAN)).alias("linked"))


def _said(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["no"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """Counts, the digest of the strong spans and all spans as text, from :func:`find_secrets`."""
    count = lambda no: F.size(F.filter("base", lambda s: s["no"] == no)).cast("long")
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(_said(F.col("base")), 256).alias("base_sha256"),
        _said(F.array_sort(F.concat("base", "linked"))).alias("spans"),
        F.size("linked").cast("long").alias("n_linked"),
    )


def redact(docs: DataFrame, mark: str = "[SECRET]", reach: int = REACH) -> DataFrame:
    """``docs`` with every reported span of ``text`` replaced by ``mark``; overlapping spans become one mark.

    Every row stays, texts without secrets (and nulls) unchanged; ``n_chars``, if there, follows the text.
    """
    own, mine, spans = free_names(docs, "_id", "_hash", "_spans")
    found = find_secrets(docs, reach).where("size(base) + size(linked) > 0").select(F.col("doc_id").alias(own), F.col("text_hash").alias(mine), F.array_sort(F.concat("base", "linked")).alias(spans)).distinct()
    joined = docs.join(found, F.col("doc_id").eqNullSafe(F.col(own)) & (F.xxhash64(text_or_empty()) == F.col(mine)), "left")
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(F.col("text"), (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        out = F.when(s["start"] >= acc["at"], F.concat(acc["out"], gap, F.lit(mark))).otherwise(acc["out"])
        return F.struct(out.alias("out"), F.greatest(acc["at"], s["stop"]).alias("at"))

    cleaned = F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), (acc["at"] + 1).cast("int"), F.length("text"))))
    joined = joined.withColumn("text", F.when(F.col(spans).isNotNull(), cleaned).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        joined = joined.withColumn("n_chars", F.when(F.col(spans).isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return joined.select(*columns_of(docs))
