"""Small awkward tables that every operator must take."""

from __future__ import annotations

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, rank int, labels string, n_words long, fp long"
LONG = "Long words, and more of them. " * 5000


def awkward():
    """Nulls in every column, empty and very long texts, ties, repeated rows, names that clash."""
    rows = [
        (1, "The quick brown fox jumps over the lazy dog. " * 8, "en", "a", 1, 9.0, 9, "x", 9, 9),
        (2, "The quick brown fox jumps over the lazy dog. " * 8, "en", "a", 1, 9.0, 9, "x", 9, 9),
        (2, "The quick brown fox jumps over the lazy dog. " * 8, "en", "a", 1, 9.0, 9, "x", 9, 9),
        (3, None, "en", "b", None, None, None, None, None, None),
        (4, "", None, "b", 0, None, None, None, None, None),
        (5, " \n\t ", "fr", None, 4, None, None, None, None, None),
        (6, "Ein ganz anderer Satz über die schöne Wiese und den Wald. " * 6, "de", None, 7, None, None, None, None, None),
        (7, "12345 !!! ### 67", None, "b", 7, None, None, None, None, None),
        (8, LONG, "en", "c", len(LONG), None, None, None, None, None),
        (9, "日本語のテキスト 🙂 İstanbul ß", "ja", "c", 5, None, None, None, None, None),
        (None, "A text without an id.", "en", "a", 5, None, None, None, None, None),
    ]
    return rows


def awkward_docs(spark):
    return spark.createDataFrame(awkward(), SCHEMA).repartition(3)


def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)
