"""Small tables with the awkward cases: nulls, empty and long texts, ties, repeated rows, clashing extra columns."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, _rank long, component_id long, score double"


def documents(spark, texts, start=0):
    rows = [(start + i, t, ["en", "de", None][i % 3], [None, "b", "a", "a"][i % 4], len(t or ""), -1, -2, -3, -4.0) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


AWKWARD = [None, "", " \t\n", "word", "word", "a b c d e f", "ünï çödé ß   x", "x" * 50_000, "the cat sat on the mat. " * 3000, "\U0001f600 smile\x85\x1c done", "don't we'll  two   spaces", "<|endoftext|>between<|endoftext|>"]


def folder(tmp_path, **tables):
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)
