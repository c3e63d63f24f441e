"""Regex character classes with the meaning Python's ``re`` gives ``\\w`` and ``\\s``.

Java's bare ``\\w``/``\\s`` are ASCII only, so every pattern in the package is
built from these bodies (to be placed inside ``[...]``).
"""

WORD = r"\p{L}\p{N}_"
SPACE = (
    r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
DIGIT = r"\p{Nd}"
LATIN = r"\x{0}-\x{24f}"

URL_RE = f"http[^{SPACE}]+"
MENTION_RE = f"@[{WORD}]+"
HASHTAG_RE = f"#[{WORD}]+"
WORD_RE = f"[{WORD}]+"
SPACES_RE = f"[{SPACE}]+"

# The characters of SPACE one by one, for functions that take a set of characters.
SPACE_CHARACTERS = "".join(
    map(
        chr,
        [
            *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680,
            *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
        ],
    )
)
