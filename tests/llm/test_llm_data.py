"""Rows that every operator must stand."""


def words(n, salt=0):
    return " ".join(f"w{(i * 7919 + salt * 104729) % 100003}" for i in range(n))


#: Null and empty texts, white space only, a very long text, repeated rows, control strings, rare characters.
HARD = [
    (1, None, "en", "a", 0),
    (2, "", "en", "a", 0),
    (3, " \t\n", None, None, 3),
    (4, "x" * 50_000, "en", "b", 50_000),
    (5, words(9_000), "en", "b", 1),
    (6, "Twice the same row.", "en", "a", 19),
    (6, "Twice the same row.", "en", "a", 19),
    (7, "<|endoftext|> İstanbul ſ \x00 中文 Σ", "de", "c", 1),
    (None, "no id here", "en", "a", 10),
]
