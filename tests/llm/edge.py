"""Documents with every odd case, for all operators."""

from __future__ import annotations

CLASHES = ["fp", "component_id", "n_words", "kept", "quality", "b", "h", "spans", "bucket", "cell", "salt", "length", "piece", "offset", "t", "w", "s", "p", "media", "host", "path"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHES)


def documents(spark, texts):
    """Rows (doc_id, text) with the columns of documents and clashing further ones."""
    rows = [(k, t, "en", "s", None if t is None else len(t), *["x"] * len(CLASHES)) for k, t in texts]
    return spark.createDataFrame(rows, SCHEMA)


PROSE = " ".join(f"word{i} and the{i} of." for i in range(60))
ODD = [
    (0, None), (1, ""), (2, " \n\t "), (3, "short"), (4, PROSE), (5, PROSE), (5, PROSE), (None, PROSE + " other end."), (None, None), (6, "é" * 200), (7, "é" * 200 + "x"),
    (8, "ab " * 4000), (9, "A" * 20_000), (10, "日本語テキスト " * 40), (11, PROSE.upper()), (12, "\x00\x1f  |#*$%&<> !"), (13, "x " * 60), (14, PROSE[:400]), (14, PROSE[100:600]),
]
