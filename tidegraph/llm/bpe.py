"""Byte-level BPE encoding and decoding.

Method: every token is mapped byte by byte to Latin-1 so that an Aho-Corasick
automaton (pyahocorasick works on str) finds, for each end position, the
tokens that end there; the longest token that *starts* at a position is read
off a trie walk of the same automaton. A piece is encoded by taking longest
matches from the left and stepping back whenever two neighbours could not
stand side by side after exact merging. That neighbour test only looks at how
the two tokens were merged, and its answers are memoised, so the ids equal
those of rank-ordered merging in time linear in the piece.

Defined results: null and empty texts encode to no ids and decode to no bytes;
null ids decode to no bytes; lone surrogates cannot occur in Spark strings.
Repeated rows are encoded alike; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.llm.common import texts_of, tokenizer_path

DEFAULT_RANKS = "byte_bpe_multi_50k.tiktoken"
#: Pieces and neighbour tests kept by one worker; beyond, the memo starts anew.
MEMO_PIECES, MEMO_PAIRS = 500_000, 1_000_000


def load_ranks(path: str) -> dict[bytes, int]:
    ranks = {}
    with open(path, "rb") as lines:
        for line in lines:
            if line.strip():
                token, rank = line.split()
                ranks[base64.b64decode(token)] = int(rank)
    return ranks


class ByteBPE:
    """Encoder and decoder for one table of merge ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import ahocorasick
        import regex

        self.rank_of = ranks
        self.token_of = {r: t for t, r in ranks.items()}
        self.size_of = {r: len(t) for r, t in self.token_of.items()}
        self.reach = max(map(len, ranks))
        self.prefixes: dict[int, int | None] = {}
        self.findall = regex.compile(pattern).findall
        trie = ahocorasick.Automaton()
        for token, rank in ranks.items():
            trie.add_word(token.decode("latin-1"), rank)
        trie.make_automaton()
        self.trie = trie
        self.pair_ok: dict[tuple[int, int], bool] = {}
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.pieces: dict[str, bytes] = {}
        for token, rank in ranks.items():
            if len(token) == 1:
                self.halves[rank] = None

    def halves_of(self, rank: int) -> tuple[int, int] | None:
        """The two tokens whose merge gives this one; None for bytes and for tokens that merging never makes."""
        if rank not in self.halves:
            ids = self.merge(self.token_of[rank], below=rank)
            self.halves[rank] = (ids[0], ids[1]) if len(ids) == 2 else None
        return self.halves[rank]

    def merge(self, piece: bytes, below: int) -> list[int]:
        """Rank-ordered merging of one token's own bytes, using merges under ``below`` only."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best, at = below, -1
            for i in range(len(parts) - 1):
                r = self.rank_of.get(parts[i] + parts[i + 1], below)
                if r < best:
                    best, at = r, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.rank_of[p] for p in parts]

    def compatible(self, left: int, right: int) -> bool:
        """Whether exact merging can leave ``left`` and ``right`` as neighbours.

        Undo the merges on both sides of the seam from the latest back. If at
        some moment the two tokens at the seam could have merged earlier than
        the younger of them was made, or at all, they would have.
        """
        key = (left, right)
        known = self.pair_ok.get(key)
        if known is not None:
            return known
        ok, until = True, 1 << 62
        a, b = left, right
        while True:
            joined = self.rank_of.get(self.token_of[a] + self.token_of[b])
            if joined is not None and joined < until:
                ok = False
                break
            ha, hb = self.halves_of(a), self.halves_of(b)
            if ha is None and hb is None:
                break
            # the younger merge is undone first; at equal rank the left one was made first
            if hb is None or (ha is not None and a > b):
                until, a = a, ha[1]
            else:
                until, b = b + 1, hb[0]
        if len(self.pair_ok) >= MEMO_PAIRS:
            self.pair_ok.clear()
        self.pair_ok[key] = ok
        return ok

    def longest(self, s: str, start: int) -> int:
        """The longest token at ``start``."""
        s = s[start : start + self.reach]
        n = self.trie.longest_prefix(s)  # counts trie nodes, which need not end a token
        while (found := self.trie.get(s[:n], None)) is None:
            n -= 1
        return found

    def shorter(self, token: int) -> int | None:
        """The longest other token that this one starts with; None for bytes."""
        if token not in self.prefixes:
            s = self.token_of[token]
            self.prefixes[token] = next((self.rank_of[s[:n]] for n in range(len(s) - 1, 0, -1) if s[:n] in self.rank_of), None)
        return self.prefixes[token]

    def encode_bytes(self, piece: bytes) -> list[int]:
        whole = self.rank_of.get(piece)
        if whole is not None:
            return [whole]
        s, n = piece.decode("latin-1"), len(piece)
        size, pair_ok = self.size_of, self.pair_ok
        ids: list[int] = []
        dead = set()  # positions that no exact encoding passes through
        at, token = 0, self.longest(s, 0)
        while True:
            while token is not None:
                end = at + size[token]
                if end not in dead:
                    if not ids:
                        break
                    ok = pair_ok.get((ids[-1], token))
                    if self.compatible(ids[-1], token) if ok is None else ok:
                        break
                token = self.shorter(token)
            if token is not None:
                ids.append(token)
                at = end
                if at == n:
                    return ids
                token = self.longest(s, at)
            else:
                dead.add(at)
                token = ids.pop()
                at -= size[token]
                token = self.shorter(token)

    def packed(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit numbers."""
        pieces = self.pieces
        out = []
        for piece in self.findall(text):
            got = pieces.get(piece)
            if got is None:
                got = np.array(self.encode_bytes(piece.encode("utf-8", "surrogatepass")), "<u4").tobytes()
                if len(piece) <= 64:
                    if len(pieces) >= MEMO_PIECES:
                        pieces.clear()
                    pieces[piece] = got
            out.append(got)
        return b"".join(out)

    def unpacked(self, ids: bytes) -> bytes:
        return b"".join(map(self.token_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def codec(ranks_path: str, pattern: str) -> ByteBPE:
    return ByteBPE(load_ranks(ranks_path), pattern)


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def encode_batches(batches: Iterator[pa.RecordBatch], ranks: str, pattern: str, step: int = 512) -> Iterator[pa.RecordBatch]:
    """(key, text) -> (key, ids, n_tokens)."""
    bpe = codec(tokenizer_path(ranks) if "/" not in ranks else ranks, pattern)
    for whole in batches:
        for i in range(0, whole.num_rows, step):
            batch = whole.slice(i, step)
            ids = [bpe.packed(t) if t else b"" for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())], ["key", "ids", "n_tokens"])


def decode_batches(batches: Iterator[pa.RecordBatch], ranks: str, pattern: str) -> Iterator[pa.RecordBatch]:
    """(key, ids, n_tokens) -> (key, ids, n_tokens, decoded)."""
    bpe = codec(tokenizer_path(ranks) if "/" not in ranks else ranks, pattern)
    for batch in batches:
        out = [bpe.unpacked(x) if x else b"" for x in texts_of(batch, "ids")]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*batch.schema.names, "decoded"])


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", ranks: str = DEFAULT_RANKS, pattern: str | None = None, decode: bool = False) -> DataFrame:
    """Per row: key, ids (little-endian unsigned 32-bit), n_tokens, and with ``decode`` the decoded bytes.

    No shuffle; rows stream through one Python stage. ``ranks`` names a public
    file or a path that every executor can read.
    """
    pattern = pattern or default_pattern()

    def run(batches):
        out = encode_batches(batches, ranks, pattern)
        yield from decode_batches(out, ranks, pattern) if decode else out

    kind = df.schema[key].dataType.simpleString()
    schema = f"key {kind}, ids binary, n_tokens bigint" + ", decoded binary" * decode
    return df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(run, schema).withColumnRenamed("key", key)
