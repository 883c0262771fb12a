"""Rows that operators must take."""

#: Nulls in any column, empty and blank texts, repeated rows, a long text, clashing extra columns.
LONG = " ".join(f"word{i % 977} next{i % 31}" for i in range(30_000))
DOCS = [
    (1, "The quick brown fox jumps over the lazy dog and runs away", "a"),
    (2, "the quick brown fox jumps over the lazy dog and runs away", "a"),
    (3, None, "a"), (4, "", None), (5, " \n\t ", "b"), (6, "two words", "b"), (7, "two words", "b"),
    (8, LONG, "b"), (8, LONG, "b"), (None, "no id here at all", "c"), (9, "Released under the MIT License.\nplain text", "c"),
    (10, LONG + " one more", None), (11, "x\x1cy\xa0z  two   blanks \n end ", "c"),
]
