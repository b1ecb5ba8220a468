"""Hand-made tables with the cases that every operator must handle."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long, keep_id string, shard string, row string, salt int"


def documents(spark, texts, langs=None, sources=None, ids=None):
    """A documents table with further columns whose names clash with the operators' own."""
    n = len(texts)
    ids = list(range(n)) if ids is None else ids
    rows = [(ids[i], texts[i], (langs or [None] * n)[i], (sources or [None] * n)[i], 0 if texts[i] is None else len(texts[i]), "x", "y", "z", 1) for i in range(n)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


LONG = "wort " * 60_000
ODD = [None, "", " ", "\n\t\x0b", "a", "a", "Größe  straße\r\nñandú", "x y z", "▁ marker ▁▁", "▁", "emoji 🙂🙂 text", "…!?", "12 34", LONG, LONG, "q" * 50_000]
