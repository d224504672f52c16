"""Packing documents into sequences of at most ``window`` tokens with little padding.

Method, per chunk of documents inside one task: cut whole windows off long
documents; take the histogram of what is left; enumerate shallow combinations
(two or three lengths, repeats allowed) that fill a window exactly; find how
often to use each by non-negative least squares against the histogram; round
down to what is there; pack the residual documents greedily, cutting one piece
where a window would stay open. The last open window of a chunk is cut at
powers of two, which need no padding.

Nothing is shuffled and a chunk never leaves its task, so a lost executor
costs only its own chunks. Sequence ids are ``partition << 40 | counter``.

Defined results: a null or empty text has only its end id and is packed like
any document; an empty table gives an empty table; repeated rows are packed
each; a document of any length holds at most one window of ids in memory
beside its own text. Ids, pieces and offsets are longs.
"""

from __future__ import annotations

import base64
import os
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.llm.common import claim, tokenizer_path

WINDOW, END_ID, CHUNK_DOCS = 2048, 1, 8192
DEFAULT_TOKENIZER = "byte_bpe_50k.json"


class Encoder:
    """Ids of a tokenizers file as its library makes them, without the tokens it would put around a text.

    Where a rank file of the same vocabulary lies beside it and its added tokens
    are plain strings, the same ids come from that: the rank file's merges, and the
    added tokens wherever a text holds them.
    """

    def __init__(self, path: str):
        import json

        ranks = os.path.splitext(path)[0] + ".tiktoken"
        with open(path, encoding="utf-8") as file:
            added = json.load(file).get("added_tokens") or []
        plain = not any(t.get(flag) for t in added for flag in ("single_word", "lstrip", "rstrip", "normalized"))
        if os.path.exists(ranks) and plain:
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as lines:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            own = {t["content"]: t["id"] for t in added}
            encoding = tiktoken.Encoding(os.path.basename(path), pat_str=public_tokenizers.PATTERN, mergeable_ranks={k: v for k, v in table.items() if v not in own.values()}, special_tokens=own)
            self.ids = lambda text: np.array(encoding.encode(text, allowed_special="all"), "<u4")
        else:
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            self.ids = lambda text: np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4")


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(tokenizer_path(path) if "/" not in path else path)


def combinations_filling(lengths: np.ndarray, counts: np.ndarray, window: int, per_length: int = 4) -> list[tuple[int, ...]]:
    """Pairs and triples of present lengths that sum to ``window``.

    Triples are enumerated for each length with its most frequent partners,
    ``per_length`` of them, so their number grows with the number of distinct
    lengths only.
    """
    have = np.zeros(window + 1, np.int64)
    have[lengths] = counts
    out = {(int(a), int(window - a)) for a in lengths if a * 2 <= window and have[window - a]}
    frequent = lengths[np.argsort(-counts, kind="stable")]
    for a in lengths:
        third = window - a - frequent
        ok = (third > 0) & (have[np.clip(third, 0, window)] > 0)
        for b in frequent[ok][:per_length]:
            out.add(tuple(sorted((int(a), int(b), int(window - a - b)))))
    return sorted(out)


def nonnegative_least_squares(combos: list[tuple[int, ...]], counts: dict[int, int], sweeps: int = 40, tolerance: float = 1e-3) -> np.ndarray:
    """min |A x - h| with x >= 0 by cyclic coordinate descent.

    Column j of A holds how often combination j uses each length; it has three
    entries at most, so one step costs three additions.
    """
    rest = defaultdict(float, counts)
    columns = []
    for c in combos:
        entries: dict[int, int] = {}
        for x in c:
            entries[x] = entries.get(x, 0) + 1
        columns.append((list(entries.items()), float(sum(v * v for v in entries.values()))))
    x = [0.0] * len(combos)
    for _ in range(sweeps):
        moved = 0.0
        for j, (entries, norm) in enumerate(columns):
            step = sum(v * rest[k] for k, v in entries) / norm
            new = max(0.0, x[j] + step)
            step = new - x[j]
            if step:
                x[j] = new
                for k, v in entries:
                    rest[k] -= v * step
                moved = max(moved, abs(step))
        if moved < tolerance:
            break
    return np.array(x)


def plan_windows(lengths: list[int], window: int) -> list[list[tuple[int, int, int]]]:
    """Windows as lists of (document index, start in its remainder, length)."""
    by_length: dict[int, list[int]] = defaultdict(list)
    for i, n in enumerate(lengths):
        if n:
            by_length[n].append(i)
    present = np.array(sorted(by_length), np.int64)
    counts = np.array([len(by_length[n]) for n in present], np.int64)
    windows: list[list[tuple[int, int, int]]] = []
    if len(present):
        combos = combinations_filling(present, counts, window)
        uses = nonnegative_least_squares(combos, {int(n): int(c) for n, c in zip(present, counts)})
        for j in np.argsort(-uses, kind="stable"):
            combo = combos[j]
            need = {n: combo.count(n) for n in combo}
            for _ in range(min(int(uses[j] + 0.5), *(len(by_length[n]) // k for n, k in need.items()))):
                windows.append([(by_length[n].pop(), 0, n) for n in combo])
    # residual documents, longest first; where nothing fits any more, the next one is cut
    left = sorted(n for n in by_length if by_length[n])
    window_now: list[tuple[int, int, int]] = []
    space = window
    from bisect import bisect_right

    while left:
        k = bisect_right(left, space)
        if k:
            n = left[k - 1]
            window_now.append((by_length[n].pop(), 0, n))
            space -= n
        else:
            n = left[0]
            i = by_length[n].pop()
            window_now.append((i, 0, space))
            windows.append(window_now)
            window_now, space = [(i, space, n - space)], window - (n - space)
        if not by_length[n]:
            left.remove(n)
        if not space:
            windows.append(window_now)
            window_now, space = [], window
    return windows + split_at_powers(window_now, window - space)


def split_at_powers(pieces: list[tuple[int, int, int]], total: int) -> list[list[tuple[int, int, int]]]:
    """One open window as sequences whose lengths are powers of two, largest first."""
    out = []
    pieces = list(reversed(pieces))
    for power in (1 << b for b in range(total.bit_length() - 1, -1, -1) if total >> b & 1):
        sequence, space = [], power
        while space:
            i, start, n = pieces.pop()
            take = min(n, space)
            sequence.append((i, start, take))
            space -= take
            if n > take:
                pieces.append((i, start + take, n - take))
        out.append(sequence)
    return out


def pack_batches(batches: Iterator[pa.RecordBatch], tokenizer: str, window: int, end_id: int, chunk_docs: int) -> Iterator[pa.RecordBatch]:
    claim("packing")
    ids_of = encoder(tokenizer).ids
    context = TaskContext.get()
    sequence = (context.partitionId() if context else 0) << 40
    end = np.array([end_id], "<u4")
    rows: list[tuple] = []
    waiting: list[tuple] = []  # key, ids of the remainder, where it starts, tokens of the document

    def emit():
        nonlocal rows
        key, start, length, ids, tokens, seq, offset = zip(*rows)
        rows = []
        return pa.RecordBatch.from_arrays(
            [pa.array(key, key_type), *(pa.array(x, pa.int64()) for x in (start, length)), pa.array(ids, pa.binary()), *(pa.array(x, pa.int64()) for x in (tokens, seq, offset))],
            ["key", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
        )

    def flush():
        nonlocal sequence, waiting
        for pieces in plan_windows([len(w[1]) for w in waiting], window):
            offset = 0
            for i, at, n in pieces:
                key, ids, start, tokens = waiting[i]
                rows.append((key, start + at, n, ids[at : at + n].tobytes(), tokens, sequence, offset))
                offset += n
            sequence += 1
        waiting = []

    key_type = pa.int64()
    for whole in batches:
        key_type = whole.schema.field(0).type
        for at in range(0, whole.num_rows, 256):
            batch = whole.slice(at, 256)
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.concatenate((ids_of(text), end)) if text else end
                full = len(ids) // window * window
                for s in range(0, full, window):
                    rows.append((key, s, window, ids[s : s + window].tobytes(), len(ids), sequence, 0))
                    sequence += 1
                if full < len(ids):
                    waiting.append((key, ids[full:].copy() if full else ids, full, len(ids)))
                if len(waiting) >= chunk_docs:
                    flush()
                if len(rows) >= 2048:
                    yield emit()
    flush()
    if rows:
        yield emit()


def pack(df: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = DEFAULT_TOKENIZER, window: int = WINDOW, end_id: int = END_ID, chunk_docs: int = CHUNK_DOCS) -> DataFrame:
    """One row per piece: key, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset."""

    def run(batches):
        return pack_batches(batches, tokenizer, window, end_id, chunk_docs)

    kind = df.schema[key].dataType.simpleString()
    schema = f"key {kind}, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"
    return df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(run, schema).withColumnRenamed("key", key)


def crc32_of(ids: bytes) -> int:
    return zlib.crc32(ids)
