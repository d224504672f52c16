"""Removal of passages that an earlier document already has: relative Lempel-Ziv parsing.

A window is ``WINDOW`` consecutive words of one document. A window is a duplicate
if its words also start in a document with a smaller key; words under a
duplicate window are removed.

Method. Documents are factored against reference blocks. Windows are dealt to
blocks by content: a window's anchor is the run of ``ANCHOR`` words in it with the
smallest hash (the leftmost of equal ones), and equal windows have equal anchors.
Neighbouring windows with the same anchor form a segment, the unit that travels.
Only anchors that two documents share can hold duplicates. Equal segments are one
phrase of the reference: combined before they travel, they belong to their first
document, and in every later one the whole segment is a factor. The phrases of an
anchor then meet: in key order, each is factored greedily against the block of
all earlier ones, indexed by every window. From each position the longest match
among all places is taken; parsing goes on with the first window that reaches
over the factor's boundary, so factors of at least a window's length, checked at
their boundaries, cover exactly the duplicates.

Hot anchors: where more than ``HOT`` phrases share an anchor, they are cut into
single windows, and the block is dealt anew by the whole window: each such
sub-block is one window, whose factor belongs to its smallest key; that is a
minimum, combined before it is shuffled. So no block holds more than ``HOT``
phrases, and nothing is capped or sampled.

Defined results: null, empty and blank texts have no words; texts shorter than a
window keep all words; rows with a null key are neither judged nor a reference
and keep all words; of rows that share a key none is earlier, whether they repeat
a text or not, and each is judged by its own text; very long texts are cut into
segments like others; an empty table gives an empty table. Words are the runs
between ASCII white space, unchanged, and are compared as 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.llm.common import WordHashes, claim, discard, mix64, written

WINDOW, ANCHOR, HOT = 50, 8, 4096
_ODD = np.uint64(0x9E3779B97F4A7C15)


def run_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words, by doubling: a run of n is made of two overlapping shorter ones."""
    size, out = 1, h
    while size < n:
        step = min(size, n - size)
        out = mix64(out[: len(out) - step] * _ODD + out[step:] + np.uint64(step))
        size += step
    return out


def segments(h: np.ndarray, window: int = WINDOW, anchor: int = ANCHOR):
    """First window, number of windows, anchor hash and content hash of each segment."""
    windows = len(h) - window + 1
    if windows < 1:
        return None
    a = run_hashes(h, anchor)
    width = window - anchor + 1
    # position of the leftmost smallest anchor in each window: sliding minima of two block scans
    best = sliding_argmin(a, width)
    cut = np.flatnonzero(np.diff(best)) + 1
    first = np.r_[0, cut]
    count = np.diff(np.r_[first, windows])
    w = run_hashes(h, window)
    total = np.zeros(windows + 1, np.uint64)
    np.cumsum(mix64(w) , out=total[1:])
    # the windows of a segment in order determine it: first, last and sum of their hashes, and how many
    content = mix64(total[first + count] - total[first] + mix64(w[first] + count.astype(np.uint64)) * _ODD + w[first + count - 1])
    return first, count, a[best[first]], content


def sliding_argmin(a: np.ndarray, width: int) -> np.ndarray:
    """Position of the leftmost minimum of each run of ``width`` values, by doubling."""
    at, size = np.arange(len(a)), 1
    while size < width:
        step = min(size, width - size)
        left, right = at[: len(at) - step], at[step:]
        at = np.where(a[right] < a[left], right, left)
        size += step
    return at


def segment_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, row, text) -> one row per segment."""
    claim("substrings")
    memo = WordHashes()
    for whole in batches:
        for at in range(0, whole.num_rows, 512):
            batch = whole.slice(at, 512)
            out: list[list] = [[] for _ in SEGMENT_KINDS]
            for key, row, text in zip(*(batch.column(c).to_pylist() for c in range(3))):
                words = text.encode("utf-8", "surrogatepass").split() if text else ()
                if key is None or len(words) < WINDOW:
                    continue
                first, count, anchor, content = segments(memo.of(words))
                n = len(first)
                for column, x in zip(out, (np.full(n, key), np.full(n, row), first, count, anchor.view(np.int64), content.view(np.int64))):
                    column.append(x)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), k) for c, k in zip(out, SEGMENT_KINDS)], ["id", "row", "first", "n", "anchor", "content"])


SEGMENT = "id bigint, row int, first int, n int, anchor bigint, content bigint"
SEGMENT_KINDS = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64())


def text_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, row, text, segs: list of (first, n, anchor, hot)) -> words of segments, or single windows of hot ones."""
    memo = WordHashes()
    for whole in batches:
        for at in range(0, whole.num_rows, 256):
            batch = whole.slice(at, 256)
            rows = []
            for key, row, text, segs in zip(*(batch.column(c).to_pylist() for c in range(4))):
                words = text.encode("utf-8", "surrogatepass").split()
                h = memo.of(words)
                windows = None
                for s in segs:
                    a, n = s["first"], s["n"]
                    if s["hot"]:
                        if windows is None:
                            windows = run_hashes(h, WINDOW)
                        rows += [(key, row, a + i, s["anchor"], x, None) for i, x in enumerate(windows[a : a + n].view(np.int64).tolist())]
                    else:
                        rows.append((key, row, a, s["anchor"], None, b" ".join(words[a : a + n + WINDOW - 1])))
            if rows:
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["id", "row", "first", "anchor", "window", "words"])


TEXTS = "id bigint, row int, first int, anchor bigint, window bigint, words binary"


class Block:
    """The reference of one anchor: words of earlier phrases, indexed by every window."""

    def __init__(self):
        self.texts: list[np.ndarray] = []
        self.index: dict[int, set[int]] = {}  # places: phrase << 32 | first word
        self.known: set[bytes] = set()
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, h: np.ndarray, windows: np.ndarray) -> None:
        name = h.tobytes()
        if name in self.known:
            return
        self.known.add(name)
        base = len(self.texts) << 32
        self.texts.append(h)
        for i, w in enumerate(windows.tolist()):
            self.index.setdefault(w, set()).add(base + i)

    def factors(self, h: np.ndarray, windows: np.ndarray) -> list[tuple[int, int]]:
        """Greedy factors of at least a window: (start, words), each the longest at its start."""
        out, at, known, index = [], 0, windows.tolist(), self.index
        last = len(known)
        while at < last:
            places, n = index.get(known[at]), 1
            if places is None:
                at += 1  # a literal word
                continue
            while at + n < last and (further := index.get(known[at + n])) is not None:
                going = {p + 1 for p in places} & further
                if not going:
                    break
                places, n = going, n + 1
            if not any(self.same(h, at, n, p) for p in places):  # windows with one hash
                at += 1
                continue
            out.append((at, n + WINDOW - 1))
            at += n  # the first window that reaches over the boundary
        return out

    def same(self, h: np.ndarray, at: int, n: int, place: int) -> bool:
        start = (place & 0xFFFFFFFF) - n + 1
        return np.array_equal(self.texts[place >> 32][start : start + n + WINDOW - 1], h[at : at + n + WINDOW - 1])


def parse_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Phrases sorted by (anchor, id, row, first) -> (id, row, lo, hi): windows lo..hi-1 of the document are duplicates."""
    memo = WordHashes()
    anchor, block, waiting_for, before = None, Block(), None, None
    for batch in batches:
        rows = []
        for here in zip(*(batch.column(c).to_pylist() for c in range(5))):
            if here[:4] == before:  # a repeated row
                continue
            before = here[:4]
            at, key, row, first, words = here
            if at != anchor:
                anchor, block, waiting_for = at, Block(), None
            if key != waiting_for:  # segments of rows with the same key are no reference for each other
                for own in block.waiting:
                    block.add(*own)
                block.waiting.clear()
                waiting_for = key
            h = memo.of(words.split(b" "))
            windows = run_hashes(h, WINDOW)
            rows += [(key, row, first + a, first + a + n - WINDOW + 1) for a, n in block.factors(h, windows)]
            block.waiting.append((h, windows))
        columns = list(zip(*rows)) if rows else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.int32()))], ["id", "row", "lo", "hi"])


SPANS = "id bigint, row int, lo int, hi int"


def duplicate_windows(docs: DataFrame) -> DataFrame:
    """docs (id, row, text) -> (id, row, lo, hi): windows lo..hi-1 of a document that start in a document with a smaller key."""
    docs = docs.where("text is not null and id is not null")
    found = written(docs.mapInArrow(segment_batches, SEGMENT), "segments")
    # phrases first, combined before they are shuffled: the segments themselves meet only these, so a hot one can be split
    every = written(found.groupBy("anchor", "content").agg(F.min("id").alias("original"), F.max("id").alias("last")), "phrases")
    shared = written(every.groupBy("anchor").agg(F.min("original").alias("lo"), F.max("last").alias("hi"), F.count("*").alias("phrases")).where("lo < hi").select("anchor", "phrases"), "anchors-shared")
    # those that a later document repeats, or that other phrases of their anchor may repeat in part
    phrases = written(every.join(shared, "anchor").where("last > original or phrases > 1").select("anchor", "content", "original", "phrases"), "phrases-shared")
    discard(every, shared)
    judged = written(found.join(phrases, ["anchor", "content"]), "segments-shared")
    discard(found, phrases)
    whole = judged.where("id > original").select("id", "row", F.col("first").alias("lo"), (F.col("first") + F.col("n")).alias("hi"))
    # the first documents of each phrase, where an anchor has several phrases
    firsts = judged.where("id = original and phrases > 1").select("id", "row", "first", "n", "anchor", (F.col("phrases") > HOT).alias("hot"))
    asked = firsts.groupBy("id", "row").agg(F.collect_set(F.struct("first", "n", "anchor", "hot")).alias("segs"))
    texts = written(docs.join(asked, ["id", "row"]).select("id", "row", "text", "segs").mapInArrow(text_batches, TEXTS), "phrase-texts")
    cold = texts.where("words is not null").repartition("anchor").sortWithinPartitions("anchor", "id", "row", "first").select("anchor", "id", "row", "first", "words")
    parsed = cold.mapInArrow(parse_batches, SPANS)
    hot = texts.where("window is not null")
    original = written(hot.groupBy("anchor", "window").agg(F.min("id").alias("original")), "hot-windows")
    single = hot.join(original, ["anchor", "window"]).where("id > original").select("id", "row", F.col("first").alias("lo"), (F.col("first") + 1).alias("hi"))
    out = written(whole.unionByName(parsed).unionByName(single), "duplicate-windows")
    discard(judged, texts, original)
    return out


def apply_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text, spans) -> (id, n_words, n_removed, kept)."""
    for whole in batches:
        for at in range(0, whole.num_rows, 512):
            batch = whole.slice(at, 512)
            n_words, n_removed, kept = [], [], []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                words = text.encode("utf-8", "surrogatepass").split() if text else []
                n_words.append(len(words))
                if spans:
                    edge = np.zeros(len(words) + 1, np.int64)
                    lo = np.array([s["lo"] for s in spans])
                    hi = np.array([s["hi"] for s in spans]) + WINDOW - 1
                    np.add.at(edge, lo, 1)
                    np.add.at(edge, hi, -1)
                    stay = np.cumsum(edge[:-1]) == 0
                    left = [w for w, s in zip(words, stay.tolist()) if s]
                    n_removed.append(len(words) - len(left))
                    words = left
                else:
                    n_removed.append(0)
                kept.append(b" ".join(words).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(3, batch.num_columns)), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], [*batch.schema.names[3:], "n_words", "n_removed", "kept"])


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row: key, ``keep`` columns, n_words, n_removed, kept (the words that stay, joined by one space)."""
    columns = list(dict.fromkeys([key, *keep]))
    whole = F.col(text).cast("string")
    # a key may repeat with another text: the text's hash tells them apart
    identity = [F.col(key).cast("bigint").alias("_id"), F.hash(whole).alias("_row"), whole.alias("_text")]
    rows = df.select(*identity, *columns)
    spans = duplicate_windows(df.select(*identity).toDF("id", "row", "text"))
    by_doc = spans.distinct().groupBy(F.col("id").alias("_id"), F.col("row").alias("_row")).agg(F.collect_list(F.struct("lo", "hi")).alias("_spans"))
    joined = rows.join(by_doc, ["_id", "_row"], "left").select("_id", "_text", "_spans", *columns)
    fields = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in columns)
    return joined.mapInArrow(apply_batches, fields + "n_words bigint, n_removed bigint, kept string")
