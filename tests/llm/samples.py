"""Rows that every operator must cope with."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "alpha beta gamma delta " * 3000 + "end"
#: Nulls in every column, empty, white and very long texts, repeated rows and a repeated doc_id.
ODD = [
    (1, "hello world", "en", "a", 11), (2, "helloworld", None, None, None), (3, None, "en", "a", None), (4, "", "en", "a", 0), (5, " \n\t", "en", "a", 3), (None, "orphan text here", "en", "a", 16),
    (6, LONG, "en", "a", len(LONG)), (7, LONG, "en", "b", len(LONG)), (8, "héllo wörld ☃ 😀", "fr", "a", 15), (9, "hello world", "en", "a", 11), (9, "hello world", "en", "a", 11), (10, "token = abcdefgh12345678", "en", "a", 24),
]


def dicts(df):
    return [r.asDict() for r in df.collect()]
