"""Small tables for the operators: the given ones, and one with every odd case."""

SF = "/root/testdata/sf0.01"
SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, n long, key string, component long"
_LONG = " ".join(f"word{i % 7919}" for i in range(60_000))


def odd_rows():
    """Nulls in every column, empty, blank and very long texts, repeated rows, and columns with names that operators use."""
    base = "the quick brown fox jumps over the lazy dog and runs away from the big bad wolf in the woods at night"
    texts = [None, "", "   \n\t", "one", "two words", base, base, base + " again", base.upper(), "Ünïcödé tëxt für älle ☃ 𝔘𝔫𝔦", _LONG, _LONG + " end", "a\n\n\nb\n\nc", "token = 'abcdef123' AKIA" + "A" * 16, "x" * 5000, " ".join(["same"] * 50)]
    rows = [(i, t, "en" if i % 3 else None, f"src{i % 4}" if i % 5 else None, None if t is None else len(t), 7, "k", 3) for i, t in enumerate(texts)]
    return [*rows, rows[5], rows[5], (None, base, None, None, None, None, None, None)]


def docs(spark, rows=None):
    return spark.createDataFrame(odd_rows() if rows is None else rows, DOCS)


def table(spark, name, sf=SF):
    return spark.read.parquet(f"{sf}/{name}.parquet")
