"""Chat formatting with a loss mask that is aligned by offsets.

Method: a whole conversation is rendered once, remembering where each turn's
text lies; the rendering is encoded once, with offsets; the sorted spans of
assistant texts are intersected with the sorted spans of tokens by binary
search. A token counts for the loss if it shares a character with such a span,
and the characters under the mask are the intersections themselves, so a token
that reaches over a turn's edge adds nothing of the template.

Template: each turn is ``<turn>### <role>:\\n<text></turn>\\n``. A backslash is put
before every backslash and control string (``<turn>``, ``</turn>``, ``###``) in roles
and texts, and taken away when reading back; a newline in a role becomes ``\\n``.

Defined results: null roles and texts count as empty; turns are ordered by turn,
nulls first, then role and text, so ties and repeated rows have one order; rows
without a conv_id form one conversation; an empty table gives an empty table. A
conversation is one unit of work: its digest runs over its turns in order, so a
very large one is read by one task, turn by turn, and held as one string.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.llm.common import tokenizer_path

OPEN, CLOSE, MARK = "<turn>", "</turn>", "###"
_SPECIAL = re.compile(r"\\|<turn>|</turn>|###")
_ESCAPED = re.compile(r"\\(\\|<turn>|</turn>|###)")
_ESCAPED_ROLE = re.compile(r"\\(\\|<turn>|</turn>|###|n)")
DEFAULT_TOKENIZER = "byte_bpe_50k.json"
LOSS_ROLES = ("assistant",)


def escape(text: str) -> str:
    return _SPECIAL.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return _ESCAPED_ROLE.sub(lambda m: "\n" if m.group(1) == "n" else m.group(1), role)


def render(turns: list[tuple[str, str]], loss_roles=LOSS_ROLES) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the spans of the texts that count for the loss."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head = f"{OPEN}{MARK} {escape_role(role)}:\n"
        body = escape(text)
        if role in loss_roles:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += (head, body, f"{CLOSE}\n")
        at += len(head) + len(body) + len(CLOSE) + 1
    return "".join(parts), spans


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    out, at = [], 0
    while at < len(formatted):
        head = end = formatted.index("\n", at)
        while True:  # the first closing tag that no backslash guards
            end = formatted.index(CLOSE, end)
            run = end
            while formatted[run - 1] == "\\":
                run -= 1
            if (end - run) % 2 == 0:
                break
            end += 1
        out.append((unescape_role(formatted[at + len(OPEN) + len(MARK) + 1 : head - 1]), unescape(formatted[head + 1 : end])))
        at = end + len(CLOSE) + 1
    return out


def loss_mask(offsets: np.ndarray, spans: list[tuple[int, int]]) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Tokens that touch a span, and the characters under them inside the spans.

    offsets: (tokens, 2), starts and ends both in order.
    """
    mask = np.zeros(len(offsets), bool)
    covered: list[tuple[int, int]] = []
    if not len(offsets):
        return mask, covered
    starts, ends = offsets[:, 0], offsets[:, 1]
    bounds = np.array(spans, np.int64).reshape(-1, 2)
    first = np.searchsorted(ends, bounds[:, 0], "right")
    last = np.searchsorted(starts, bounds[:, 1], "left")
    for (a, b), i, j in zip(spans, first.tolist(), last.tolist()):
        if i >= j or a == b:
            continue
        mask[i:j] = True
        # neighbouring tokens touch, so their union is one run unless the tokenizer left a gap
        s, e = np.maximum(starts[i:j], a), np.minimum(ends[i:j], b)
        cut = np.flatnonzero(s[1:] > np.maximum.accumulate(e)[:-1])
        covered += zip(s[np.r_[0, cut + 1]].tolist(), np.maximum.accumulate(e)[np.r_[cut, len(e) - 1]].tolist())
    return mask, covered


@lru_cache(maxsize=2)
def tokenizer_of(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path(path) if "/" not in path else path)
    t.encode_special_tokens = True
    return t


FORMATTED = "conv_id bigint, formatted string, n_tokens bigint, ids binary, mask binary, loss_starts array<bigint>, loss_ends array<bigint>"


def format_batches(batches: Iterator[pa.RecordBatch], tokenizer: str, loss_roles, out_rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation and turn -> one row per conversation."""
    t = tokenizer_of(tokenizer)
    schema = pa.schema([("conv_id", pa.int64()), ("formatted", pa.string()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("mask", pa.binary()), ("loss_starts", pa.list_(pa.int64())), ("loss_ends", pa.list_(pa.int64()))])
    rows: list[tuple] = []
    current, turns = None, []

    def close(conv, turns):
        text, spans = render(turns, loss_roles)
        got = t.encode(text, add_special_tokens=False)
        offsets = np.array(got.offsets, np.int64).reshape(-1, 2)
        mask, covered = loss_mask(offsets, spans)
        rows.append((conv, text, len(got.ids), np.array(got.ids, "<u4").tobytes(), np.packbits(mask, bitorder="little").tobytes(), [a for a, _ in covered], [b for _, b in covered]))

    def emit():
        nonlocal rows
        out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
        rows = []
        return out

    for batch in batches:
        for conv, role, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if turns and conv != current:
                close(current, turns)
                turns = []
                if len(rows) >= out_rows:
                    yield emit()
            current = conv
            turns.append((role or "", text or ""))
    if turns:
        close(current, turns)
    if rows:
        yield emit()


def format_chats(df: DataFrame, tokenizer: str = DEFAULT_TOKENIZER, loss_roles: tuple[str, ...] = LOSS_ROLES) -> DataFrame:
    """Conversations (conv_id, turn, role, text) -> one formatted row each, with ids, token mask (bits) and loss spans in characters."""

    def run(batches):
        return format_batches(batches, tokenizer, loss_roles)

    rows = df.select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", "role", "text")
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    return ordered.mapInArrow(run, FORMATTED)


def digest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads formatted conversations back and digests what it finds."""
    import hashlib

    for batch in batches:
        out = []
        for conv, text, starts, ends in zip(*(batch.column(i).to_pylist() for i in range(4))):
            turns = read_back(text)
            h = hashlib.sha256()
            for role, said in turns:
                h.update(f"{role}\n{said}\n".encode())
            loss = unescape("".join(text[a:b] for a, b in zip(starts, ends)))
            out.append((conv, len(turns), h.hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kinds[i]) for i in range(6)], names)


def digests(formatted: DataFrame) -> DataFrame:
    return formatted.select("conv_id", "formatted", "loss_starts", "loss_ends").mapInArrow(
        digest_batches, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    )
