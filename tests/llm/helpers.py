"""Rows that every operator must take: nulls, empty and long texts, ties, repeats, extra columns."""

TEXT = "The quick brown fox jumps over the lazy dog and runs far away into the deep green forest tonight"


def awkward(spark, extra=True):
    long = " ".join(f"word{i % 977}x{i % 31}" for i in range(9000))
    rows = [
        (1, TEXT, "en", "a", 10),
        (1, TEXT, "en", "a", 10),
        (2, TEXT, None, None, None),
        (3, None, "en", "a", None),
        (4, "", "de", "b", 0),
        (5, " \n\t ", "de", None, 4),
        (6, long, "en", "b", len(long)),
        (7, long + " end", "en", "b", None),
        (None, TEXT + "!", "en", "a", 5),
        (8, "123 456 !!!", None, "b", 11),
        (9, "\n".join([TEXT, TEXT, "x", TEXT.replace("lazy", "lacy")]), "en", "c", None),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    if extra:
        for name in ("score", "lang_pred", "id", "th", "n", "tokens", "spans", "row"):
            df = df.selectExpr("*", f"'x' as {name}")
    return df
