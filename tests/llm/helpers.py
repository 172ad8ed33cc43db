"""Rows that every operator has to bear."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long, position long, shard string, piece string, keys string, block string"

PROSE = ("the quick brown fox jumps over the lazy dog while seven wizards boil a strange green soup in the old kitchen and nobody "
         "in the village knows why the bells have been silent since the last market day of autumn")


def odd_documents(spark):
    """NULLs in every column, empty and very long texts, ties and repeated rows, and columns with clashing names."""
    extra = (9, "s", "p", "k", "b")
    rows = [
        (1, PROSE, "en", "a", 10), (2, PROSE, "en", "a", 10), (2, PROSE, "en", "a", 10), (3, None, None, None, None),
        (4, "", "en", "b", 0), (5, " \n\t ", "fr", "b", 4), (6, "word " * 60_000, "en", "c", 300_000), (7, "x" * 20_000, "en", "c", 20_000),
        (8, PROSE.replace("wizards", "witches"), "en", "a", 10), (None, PROSE.upper(), None, "d", 5), (9, "漢字 かな 😀 é \\ < > \x00 \r\n", "ja", "e", 9),
        (10, "one two three", "de", None, 3)]
    return spark.createDataFrame([(*r, *extra) for r in rows], DOCS)


def no_documents(spark):
    return spark.createDataFrame([], DOCS)
