"""Small tables shared by the tests of the text operators."""

LONG = "lorem ipsum dolor sit amet " * 40_000

#: NULLs, empty and blank texts, ties, repeated rows, a very long text, and columns named like internal ones.
EDGES = [
    (1, "Alpha beta gamma delta"), (2, "alpha BETA gamma delta"), (2, "alpha BETA gamma delta"), (3, None), (4, ""), (5, "  \n\t"),
    (6, "Éa É x"), (7, "éa É x"), (None, "alpha beta gamma delta"), (None, None), (8, "one"), (9, "one two"), (10, LONG), (11, "\0 \u2028 😀"),
]
EXTRA = ("row", "hash", "keep_id", "_gone", "_text_hash", "component", "_exact_digest", "text_hash")


def documents(spark, rows=EDGES):
    """Rows (doc_id, text) as ``documents`` with further columns whose names clash."""
    schema = ", ".join(["doc_id long", "text string", "lang string", "source string", "n_chars long", *[f"`{c}` string" for c in EXTRA]])
    return spark.createDataFrame([(i, t, "en", "src0", len(t or ""), *["x"] * len(EXTRA)) for i, t in rows], schema)


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
