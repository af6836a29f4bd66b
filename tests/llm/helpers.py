"""Small tables for the training-data operators."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def write_documents(spark, folder, rows, schema=SCHEMA, **more):
    """A folder with ``documents.parquet`` (rows of doc_id, text, source) and other tables (rows, schema)."""
    full = [(i, t, "en", s, len(t or "")) for i, t, s in rows]
    spark.createDataFrame(full, schema).write.parquet(f"{folder}/documents.parquet")
    for name, (data, kind) in more.items():
        spark.createDataFrame(data, kind).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


LONG = " ".join(f"word{i % 977} tail{i % 31}" for i in range(30_000))

#: Nulls in any column, empty and very long texts, ties and repeated rows.
ODD = [
    (1, None, "a"), (2, "", "a"), (3, " \t\n\x0b\x0c\r ", None), (4, "one", "b"), (4, "one", "b"), (5, "one two", "b"),
    (6, "ONE two three", "c"), (7, "one two three", "c"), (None, "one two three four five six", "c"), (8, LONG, "c"), (9, LONG + " end", "c"),
    (10, "naïve café ÉTÉ   straße", "d"), (11, "a\nb\nb\n\nb $#*% a b a b a b", "d"), (12, "x" * 5000, "d"),
]


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], schema)
