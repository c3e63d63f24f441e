"""Chat formatting with offset-aligned loss masks.

A turn is rendered as ``### role`` + newline + text + ``</turn>`` + newline. Inside roles
and texts a backslash becomes ``\\\\``, ``###`` becomes ``\\h`` and ``</turn>`` becomes
``\\e``, so control strings in a rendered conversation are always the template's own and
rendering can be undone. Role lines also escape line ends (``\\n``).

A conversation is rendered whole, encoded once with offsets, and the sorted spans of its
assistant turns are intersected with the token spans by binary search. Conversations over
``segment_chars`` are encoded in runs of whole turns: every turn ends in a line end that
is followed by ``#``, where the byte-level pattern always parts tokens, so the ids are those
of one encoding and memory stays bounded by the longest turn.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepost.llm.encoders import default_path

OPEN, CLOSE, MID = "### ", "</turn>\n", "\n"
TEXT_ESCAPES = (("\\", "\\\\"), ("###", "\\h"), ("</turn>", "\\e"))
ROLE_ESCAPES = (*TEXT_ESCAPES, ("\n", "\\n"))
PLAIN = {"\\": "\\", "h": "###", "e": "</turn>", "n": "\n"}
ESCAPED = re.compile(r"\\(.)", re.S)
TURN = re.compile(r"### ([^\n]*)\n(.*?)</turn>\n", re.S)
LOSS_ROLE = "assistant"
SEGMENT_CHARS = 1 << 20


def escape(text: str, rules=TEXT_ESCAPES) -> str:
    for plain, coded in rules:
        text = text.replace(plain, coded)
    return text


def unescape(text: str) -> str:
    return ESCAPED.sub(lambda m: PLAIN[m[1]], text) if "\\" in text else text


def render(turns: list[tuple[str, str]], loss_role: str = LOSS_ROLE) -> tuple[str, list[tuple[int, int]]]:
    """The rendered turns and the sorted spans of the texts of ``loss_role``."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = OPEN + escape(role, ROLE_ESCAPES) + MID, escape(text)
        if role == loss_role:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, CLOSE]
        at += len(head) + len(body) + len(CLOSE)
    return "".join(parts), spans


def mask_spans(offsets: np.ndarray, spans: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Token mask, and the characters of the masked tokens that lie in a span, merged.

    Tokens are sorted; each span finds its first and last token by binary search.
    """
    mask = np.zeros(len(offsets), dtype=bool)
    if not len(spans) or not len(offsets):
        return mask, []
    first = np.searchsorted(offsets[:, 1], spans[:, 0], side="right")
    last = np.searchsorted(offsets[:, 0], spans[:, 1], side="left")
    covered = []
    for (start, end), a, b in zip(spans.tolist(), first.tolist(), last.tolist()):
        if a >= b or start >= end:
            continue
        mask[a:b] = True
        lows = np.maximum(offsets[a:b, 0], start)
        highs = np.maximum.accumulate(np.minimum(offsets[a:b, 1], end))
        cuts = np.flatnonzero(lows[1:] > highs[:-1])
        begins = [int(lows[0]), *lows[1:][cuts].tolist()]
        ends = [*highs[:-1][cuts].tolist(), int(highs[-1])]
        covered += list(zip(begins, ends))
    return mask, covered


def parse(rendered: str) -> list[tuple[str, str]]:
    """Undo :func:`render`."""
    return [(unescape(m[1]), unescape(m[2])) for m in TURN.finditer(rendered)]


def format_conversations(
    turns: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    path: str | None = None,
    loss_role: str = LOSS_ROLE,
    segment_chars: int = SEGMENT_CHARS,
) -> DataFrame:
    """Formatted conversations: conv_id, segment, rendered, input_ids, loss_mask, loss_spans.

    One row per conversation (long ones: per run of whole turns, ``segment`` from 0), in
    order within a partition. Turns are ordered by turn (null first), then role and text.
    Null roles and texts are empty. Repeated rows are turns of their own. ``loss_spans``
    are [start, end) pairs of characters of ``rendered`` under the mask.
    """
    path = path or default_path("byte_bpe_50k.json")
    conv_type = turns.schema[conv_col].dataType.simpleString()
    rows = turns.select(
        F.col(f"`{conv_col}`").alias("conv_id"),
        F.col(f"`{turn_col}`").alias("turn"),
        F.coalesce(F.col(f"`{role_col}`").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
    )
    columns = ["conv_id", "segment", "rendered", "input_ids", "loss_mask", "loss_spans"]

    def formatted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = None
        state = {"key": None, "segment": 0, "turns": [], "chars": 0, "open": False}
        out: list[tuple] = []

        def finish() -> None:
            rendered, spans = render(state["turns"], loss_role)
            code = encoder.encode(rendered, add_special_tokens=False)
            offsets = np.asarray(code.offsets, dtype=np.int64).reshape(-1, 2)
            mask, covered = mask_spans(offsets, np.asarray(spans, dtype=np.int64).reshape(-1, 2))
            key = state["key"]
            out.append((key, state["segment"], rendered, code.ids, mask.tolist(), [list(c) for c in covered]))
            state.update(turns=[], chars=0, segment=state["segment"] + 1)

        for batch in batches:
            encoder = encoder or _encoder(path)
            for key, role, text in zip(batch["conv_id"], batch["role"], batch["text"]):
                key = None if pd.isna(key) else key
                if not state["open"] or key != state["key"]:
                    if state["turns"]:
                        finish()
                    state.update(key=key, segment=0, open=True)
                state["turns"].append((role, text))
                state["chars"] += len(text)
                if state["chars"] >= segment_chars:
                    finish()
                if sum(len(r[2]) for r in out) > segment_chars or len(out) >= 512:
                    yield pd.DataFrame(out, columns=columns)
                    out.clear()
        if state["turns"]:
            finish()
        if out:
            yield pd.DataFrame(out, columns=columns)

    return (
        rows.repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "text")
        .select("conv_id", "role", "text")
        .mapInPandas(
            formatted,
            f"conv_id {conv_type}, segment long, rendered string, input_ids array<int>, loss_mask array<boolean>, loss_spans array<array<long>>",
        )
    )


def _encoder(path: str):
    from tokenizers import Tokenizer

    encoder = Tokenizer.from_file(path)
    encoder.encode_special_tokens = True  # texts hold no special tokens, only their strings
    encoder.no_truncation()
    encoder.no_padding()
    return encoder


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests read from formatted conversations: one row per conversation.

    conv_id, n_turns, turns_sha256 (role, line end, text, line end of each turn),
    loss_chars, loss_sha256 (all text under the loss mask, unescaped), formatted_chars.
    Reads the rows of a conversation in the order in which they were formatted.
    """
    conv_type = formatted.schema["conv_id"].dataType.simpleString()
    columns = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = None
        for batch in batches:
            out = []
            for key, segment, rendered, spans in zip(
                batch["conv_id"], batch["segment"], batch["rendered"], batch["loss_spans"]
            ):
                if segment == 0:
                    if state:
                        out.append(_digest(state))
                    state = [None if pd.isna(key) else key, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in parse(rendered):
                    state[1] += 1
                    state[2].update(f"{role}\n{text}\n".encode())
                for start, end in spans:
                    text = unescape(rendered[start:end])
                    state[3] += len(text)
                    state[4].update(text.encode())
                state[5] += len(rendered)
            if out:
                yield pd.DataFrame(out, columns=columns)
        if state:
            yield pd.DataFrame([_digest(state)], columns=columns)

    return formatted.select("conv_id", "segment", "rendered", "loss_spans").mapInPandas(
        digests,
        f"conv_id {conv_type}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long",
    )


def _digest(state) -> tuple:
    return (state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5])
