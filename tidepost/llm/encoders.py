"""Token ids of the public vocabularies, by a fast path that gives what the tokenizers library gives.

Both vocabularies are byte-pair encodings whose merges are in the order of their ids, so
tiktoken's merge loop over the same ranks ends in the same tokens at several times the
speed. It is used for characters whose classes and lower case every library agrees on;
any other piece of a text goes to the tokenizers library itself.
"""

from __future__ import annotations

import json
import re

import numpy as np

#: Letters and numbers among the characters that the fast path takes.
LETTERS = "a-zA-ZªµºÀ-ÖØ-öø-ɏ"
NUMBERS = "0-9²³¹¼-¾"
#: No U+0130 (its lower case is two characters), no white space beyond ASCII's.
COMMON = re.compile("[\t-\r\x20-\x7e¡-įı-ɏ‐-‧]*", re.ASCII)
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
WORD_END = "</w>"
#: Bounds of the memo of words: bytes in all, and letters of a word that is held beyond its run.
MEMO_BYTES = 32 << 20
MEMO_KEY = 64


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_of_symbol() -> dict[str, int]:
    """Byte-level vocabularies write byte b as itself if printable, else as U+0100 onwards in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


def _ranks(path: str, end: bytes) -> tuple[dict[bytes, int], list[str]]:
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    special = [t["content"] for t in spec["added_tokens"]]
    symbols, suffix = _byte_of_symbol(), spec["model"].get("end_of_word_suffix") or ""
    ranks = {}
    for token, number in spec["model"]["vocab"].items():
        if token in special:
            continue
        last = bool(suffix) and token.endswith(suffix)
        core = token[: -len(suffix)] if last else token
        ranks[bytes(symbols[c] for c in core) + (end if last else b"")] = number
    return ranks, special


class ByteCounts:
    """Number of tokens under a byte-level vocabulary (no normaliser)."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        ranks, self.special = _ranks(path, b"")
        pattern = CONTRACTIONS + r"| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.fast = tiktoken.Encoding("byte-level", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.exact = Tokenizer.from_file(path)
        self.exact.no_truncation()
        self.exact.no_padding()

    def counts(self, texts: list[str]) -> list[int]:
        """Lengths only; texts of rare characters or special strings go to the exact encoder in one batch."""
        out = [0] * len(texts)
        rest = []
        for i, text in enumerate(texts):
            if COMMON.fullmatch(text) and not any(s in text for s in self.special):
                out[i] = len(self.fast.encode_to_numpy(text, disallowed_special=()))
            else:
                rest.append(i)
        if rest:
            whole = [texts[i].encode("utf-8", "replace").decode("utf-8") for i in rest]
            for i, found in zip(rest, self.exact.encode_batch_fast(whole, add_special_tokens=False)):
                out[i] = len(found)
        return out


class WordIds:
    """Ids under a vocabulary with word ends, lower case and white space dropped."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        ranks, self.special = _ranks(path, b"\0")
        self.fast = tiktoken.Encoding("word-ends", pat_str=r"[^\x00]+\x00", mergeable_ranks=ranks, special_tokens={})
        self.ends = np.zeros(max(ranks.values()) + 1, dtype=bool)
        self.ends[[n for token, n in ranks.items() if token.endswith(b"\0") and token != b"\0"]] = True
        self.pieces = re.compile(rf"{CONTRACTIONS}|[{LETTERS}]+|[{NUMBERS}]|[^\s{LETTERS}{NUMBERS}]+")
        self.exact = Tokenizer.from_file(path)
        self.exact.no_truncation()
        self.exact.no_padding()
        self.memo: dict[str, bytes] = {}
        self.bytes = 0

    def _learn(self, words: list[str]) -> None:
        """All new words in one call; their ids are parted where a piece ends."""
        common, parts, sizes = [], [], []
        for word in words:
            if COMMON.fullmatch(word) and not ("<" in word and any(s in word for s in self.special)):
                own = self.pieces.findall(word.lower())
                common.append(word)
                parts += own
                sizes.append(len(own))
            else:
                clean = word.encode("utf-8", "replace").decode("utf-8")
                ids = self.exact.encode(clean, add_special_tokens=False).ids
                self.memo[word] = np.asarray(ids, dtype="<u4").tobytes()
        if parts:
            ids = self.fast.encode_to_numpy("\0".join(parts) + "\0", disallowed_special=()).astype("<u4")
            stops = np.concatenate([[0], np.flatnonzero(self.ends[ids]) + 1])[np.cumsum([0, *sizes])]
            data, stops = ids.tobytes(), (4 * stops).tolist()
            self.memo.update(zip(common, [data[a:b] for a, b in zip(stops, stops[1:])]))
        else:
            self.memo.update((w, b"") for w in common)
        self.bytes += sum(map(len, words)) + 220 * len(words)

    def ids(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text.

        White space always parts tokens, so words are encoded apart, each new one once.
        """
        words = [t.lower().split() if COMMON.fullmatch(t) else re.split("[\t-\r ]+", t) for t in texts]
        memo = self.memo
        if self.bytes > MEMO_BYTES:
            memo.clear()
            self.bytes = 0
        new = list(set().union(*words).difference(memo))
        if new:
            self._learn(new)
        found = [b"".join([memo[w] for w in own]) for own in words]
        for word in new:
            if len(word) > MEMO_KEY:
                del memo[word]
        return found
