"""Toxicity scoring behind a noisy channel.

Method: a token that, without its edge punctuation, looks disguised (symbols or
digits among letters, letters drawn out, or single letters spelled apart) is
decoded: its characters span a lattice (look-alike letters, dropped separators, collapsed repeats) and the
Viterbi path under a character model of order three and the channel's costs is
the restored word. Restored text, not the surface, is scored: each distinct
restored word has a weight, the cautious log-odds of label 1 among texts with the
word or with its beginning, and a logistic curve turns the sum of positive weights, each
word or beginning once, into the score. Both curve and weights are learned; no word list is built in.

The character model is fitted on the words of all texts, counted as runs of three
letters on the executors. Learning weights uses a bounded sample of labelled rows,
``SAMPLE_ROWS`` of each label at most, by a hash; near copies in it count once. The
curve is fitted on the other half than the one its weights come from. All texts
are then scored whole and stream through one Python stage.

Defined results: null and empty texts get the score of a text without any
weighted word; if either label is missing from the training rows, every text
gets the share of label 1 (0 without rows); rows with null labels are not
learned from; of repeated label rows of one key the largest label counts, and
rows that share a key share its label; keys may be of any type; very long texts
are read whole; an empty table gives an empty table.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegraph.llm.charlm import BOUNDARY, CharLM
from tidegraph.llm.common import WordHashes, claim, memo_of, mix64, written
from tidegraph.llm.langid import bounded_sample

SAMPLE_ROWS = 5000
#: Which letters a sign may stand for.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "[": "c", "{": "c", "€": "e", "£": "l", "¥": "y", "§": "s", "#": "h", "%": "x", "&": "e",
}
#: Signs that may be put between letters; dropped at a small cost.
SEPARATORS = frozenset(" .-_*~'`^,:;/\\=\"·•​‌‍﻿")
SWAP_COST, DROP_COST, SIGN_DROP_COST, REPEAT_COST = 0.7, 0.3, 3.0, 0.2
#: A look-alike within a word mostly is a letter: dropping it must cost more than the letter that it stands for.
ALIKE_DROP_COST = 9.0
EDGES = ".,;:?!\"'()[]{}<>«»“”„‘’…*_~`-"
#: Single letters, digits or look-alike signs spelled apart; what stands before the first or behind the last one is no letter.
SIGNS = "".join(sorted(c for c in LOOKALIKES if not c.isalnum()))
#: Edge punctuation that is no look-alike: a word between such edges has one reading.
PLAIN_EDGES = "".join(c for c in EDGES if c not in SIGNS)
GAP = f"[{re.escape(''.join(sorted(SEPARATORS)))}]"
UNIT = rf"(?:[^\W_]|[{re.escape(SIGNS)}])(?!['’]?[^\W_])"
SPELLED = re.compile(rf"(?<!\w)(?<![^\W_]['’]){UNIT}(?:{GAP}{{1,5}}{UNIT}){{2,}}")
REPEATED = re.compile(r"(.)\1\1")
#: Beginnings of words that count as features, and how many letters must follow.
PREFIXES, REST = (4, 5), 1


class Decoder:
    """Viterbi decoding of one token under an order-three character model."""

    def __init__(self, lm: CharLM, limit: int = 300_000):
        self.lm, self.limit = lm, limit
        self.memo: dict[str, float] = {}
        self.decoded: dict[str, str] = {}

    def log_p(self, before: str, letter: str) -> float:
        """log P(letter | the last two letters), from the same sorted arrays as whole words."""
        key = before + letter
        got = self.memo.get(key)
        if got is None:
            if len(self.memo) > self.limit:
                self.memo.clear()
            got = self.memo[key] = trigram_log_p(self.lm, before, letter)
        return got

    def decode(self, token: str) -> str:
        """The likeliest word behind ``token`` (lower case); memoised, as the same disguise stands between many edges."""
        got = self.decoded.get(token)
        if got is None:
            if len(self.decoded) > self.limit:
                self.decoded.clear()
            got = self.decoded[token] = self.best_path(token)
        return got

    def best_path(self, token: str) -> str:
        mark = chr(BOUNDARY)
        # letters before the first choice are on every path: what they cost decides nothing
        clear = 0
        while clear < len(token) and (c := token[clear]).isalpha() and c not in LOOKALIKES and c != token[clear - 1 : clear]:
            clear += 1
        # state: the last two restored letters -> (cost, restored word, last raw letter)
        states: dict[tuple[str, str], tuple[float, str]] = {((mark + token[:clear])[-2:], token[clear - 1 : clear]): (0.0, token[:clear])}
        for c in token[clear:]:
            new: dict[tuple[str, str], tuple[float, str]] = {}
            letters = [(c, 0.0)] if c.isalpha() else []
            letters += [(x, SWAP_COST) for x in LOOKALIKES.get(c, "")]
            drop = DROP_COST if c in SEPARATORS else ALIKE_DROP_COST if c in LOOKALIKES else SIGN_DROP_COST if not c.isalpha() else None
            for (context, last), (cost, word) in states.items():
                options = []
                if drop is not None:
                    options.append((context, last, cost + drop, word))
                for x, swap in letters:
                    options.append(((context + x)[-2:], x, cost + swap - self.log_p(context, x), word + x))
                    if x == last:  # drawn out: the same letter goes on
                        options.append((context, last, cost + swap + REPEAT_COST, word))
                for context2, last2, cost2, word2 in options:
                    old = new.get((context2, last2))
                    if old is None or cost2 < old[0]:
                        new[context2, last2] = (cost2, word2)
            if not new:
                return token
            states = new
        best = min(((cost - self.log_p(context, mark), word) for (context, _), (cost, word) in states.items()), default=(0.0, token))
        return best[1]


def mix(x: int) -> int:
    """``mix64`` of one number."""
    for _ in range(2):
        x = (x ^ x >> 32) * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF
    return x ^ x >> 32


def trigram_log_p(lm: CharLM, before: str, letter: str) -> float:
    """The lookups of ``CharLM.score_words`` for one letter, without arrays."""
    p = lm.floor
    h, c = 0, 7
    for k, code in enumerate(map(ord, reversed((before + letter)[-lm.order :]))):
        h = mix(h * 0x9E3779B97F4A7C15 + code + 1 & 0xFFFFFFFFFFFFFFFF)
        if k:
            c = mix(c * 0x9E3779B97F4A7C15 + code + 1 & 0xFFFFFFFFFFFFFFFF)
        p = entry(lm.keys[k], h, lm.share[k], 0.0) + entry(lm.context_keys[k], c, lm.backoff[k], 1.0) * p
    return math.log(max(p, 1e-12))


def entry(keys: np.ndarray, wanted: int, values: np.ndarray, default: float) -> np.float32:
    at = keys.searchsorted(np.uint64(wanted))
    return values[at, 0] if at < len(keys) and keys[at] == wanted else np.float32(default)


def disguised(bare: str) -> bool:
    """Whether a token without its edge punctuation may hide a word: look-alikes count as letters, separators not at all."""
    if bare.isalpha():
        return REPEATED.search(bare) is not None
    letters = sum(map(str.isalpha, bare))
    alike = sum(c in LOOKALIKES for c in bare)
    shown = letters + alike
    if shown < 2 or not (letters or sum(c in SIGNS for c in bare) > 1):  # numbers are no words
        return False
    return shown * 2 >= len(bare) - sum(c in SEPARATORS for c in bare)


def without_gaps(token: str) -> str:
    return "".join(c for c in token if c not in SEPARATORS)


def wider_gap_parts(run: str) -> list[str]:
    """The parts of a spelled run between its gaps that are wider than the narrowest."""
    narrow = min(map(len, re.findall(f"{GAP}+", run)))
    return re.split(f"{GAP}{{{narrow + 1},}}", run)


@dataclass
class Model:
    lm: CharLM | None
    weights: dict[str, float] = field(default_factory=dict)
    slope: float = 0.0
    intercept: float = 0.0
    constant: float | None = None
    token: str = field(default_factory=lambda: uuid.uuid4().hex)

    def score(self, total: float) -> float:
        if self.constant is not None:
            return self.constant
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, self.slope * total + self.intercept))))


class Reader:
    """Texts to restored words and, with weights, to sums; memoised by surface token."""

    def __init__(self, lm: CharLM | None, weights: dict[str, float], limit: int = 200_000):
        self.decoder = Decoder(lm) if lm is not None else None
        self.weights, self.limit = weights, limit
        self.starts = {f[1 : 1 + min(PREFIXES)] for f in weights if f.startswith("^")}
        self.idle: set[str] = set()  # tokens seen that hold no feature with a weight: most of all
        self.telling: dict[str, tuple[str, float]] = {}

    def restore(self, bare: str) -> str:
        return self.decoder.decode(bare) if self.decoder is not None and disguised(bare) else bare

    def readings(self, token: str) -> set[str]:
        """The words a token may stand for: it without its edges, without separators too, and with the look-alikes at its edges."""
        bare = token.strip(EDGES)
        out = {self.restore(bare)}
        if self.decoder is None or not bare:
            return out
        if not bare.isalpha() and (joined := without_gaps(bare)).isalpha():
            out.add(joined)
        if len(bare) < len(token):
            start = token.index(bare)
            left, right = token[:start], token[start + len(bare) :]
            before = left[len(left.rstrip(SIGNS)) :]
            after = right[: len(right) - len(right.lstrip(SIGNS))]
            if bare.isalpha() and after[:1] == "!":
                after = ""
            out.update(self.restore(x + bare + y) for x in {"", before} for y in {"", after} if x or y)
        return out

    def spelled(self, run: str) -> set[str]:
        """The words that letters spelled apart may stand for: all of them, and without one-letter words before or behind."""
        out = set()
        for part in {run, *wider_gap_parts(run)}:
            units = without_gaps(part)
            for first in range(3):
                for last in (len(units), len(units) - 1):
                    if last - first > 2 or (first, last) == (0, len(units)):
                        word = units[first:last]
                        out.update({word, self.decoder.decode(word)} if word.isalpha() else {self.decoder.decode(word)})
        return out

    def weigh(self, word: str) -> tuple[str, float]:
        """The strongest feature of a word: itself or its beginning."""
        w = self.weights
        name, best = word, w.get(word, 0.0)
        if word[: min(PREFIXES)] not in self.starts:
            return name, best
        for n in PREFIXES:
            if len(word) >= n + REST and (own := w.get("^" + word[:n], 0.0)) > best:
                name, best = "^" + word[:n], own
        return name, best

    def tokens(self, text: str) -> set[str]:
        text = text.lower()
        found = set(text.split())
        if self.decoder is not None:
            found.update(" " + m.group() for m in SPELLED.finditer(text) if sum(map(str.isalpha, m.group())) > 1)
        return found

    def words(self, text: str) -> set[str]:
        return set().union(*map(self.look, self.tokens(text))) - {""}

    def look(self, token: str) -> set[str]:
        """All readings of a token; a spelled run begins with a blank."""
        bare = token.strip(PLAIN_EDGES)
        if bare.isalpha() and not REPEATED.search(bare):  # the common case: nothing to restore
            return {bare}
        return self.spelled(token[1:]) if token[0] == " " else self.readings(token)

    def feature(self, token: str) -> tuple[str, float]:
        """The strongest feature among a token's readings, and its weight."""
        got = self.telling.get(token)
        if got is None:
            got = max(map(self.weigh, sorted(self.look(token))), key=lambda x: x[1])
            if len(self.telling if got[1] else self.idle) > self.limit:
                (self.telling if got[1] else self.idle).clear()
            if got[1]:
                self.telling[token] = got
            else:
                self.idle.add(token)
        return got

    def total(self, text: str | None) -> float:
        """Sum of the weights of the distinct features found."""
        if not text:
            return 0.0
        return math.fsum({name: weight for name, weight in map(self.feature, self.tokens(text) - self.idle) if weight}.values())


_readers: dict[str, Reader] = {}
memo_of("toxicity", _readers.clear)


def reader_of(token: str, lm: CharLM | None, weights: dict[str, float]) -> Reader:
    claim("toxicity")
    if token not in _readers:
        if len(_readers) > 3:
            _readers.clear()
        _readers[token] = Reader(lm, weights)
    return _readers[token]


def features_of(words: set[str]) -> set[str]:
    out = set(words)
    for n in PREFIXES:
        out.update("^" + w[:n] for w in words if len(w) >= n + REST)
    return out


def caution(ones: float, zeros: float, z: float = 2.0) -> float:
    """Logit of the lower Wilson bound for the share of label 1 among texts with the feature."""
    n = ones + zeros
    p = ones / n
    low = (p + z * z / (2 * n) - z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)
    return math.log(max(low, 1e-12) / (1 - low))


def min_hash(text: str, words: WordHashes) -> int:
    """The smallest hash of the text's three-word sequences: near copies mostly share it."""
    h = words.of(text.encode("utf-8", "surrogatepass").split())
    if len(h) >= 3:
        h = h[:-2] * np.uint64(3) + h[1:-1] * np.uint64(5) + h[2:] * np.uint64(7)
    return int(mix64(h).min().astype(np.int64)) if len(h) else 0


def learn_weights(counts: dict[str, tuple[int, int]], zeros_weight: float, least: int, floor: float = 0.1) -> dict[str, float]:
    """Weights of the features that, cautiously, more texts of label 1 than of label 0 hold; a text of label 0 counts ``zeros_weight``.

    A beginning must be backed by three words of its own, else the word itself is the feature.
    """
    words = Counter()
    for f, (ones, zeros) in counts.items():
        if not f.startswith("^") and ones > zeros * zeros_weight:
            words.update("^" + f[:n] for n in PREFIXES if len(f) >= n + REST)
    out = {}
    for f, (ones, zeros) in counts.items():
        if ones >= least and (not f.startswith("^") or words[f] >= 3) and (w := caution(ones, zeros * zeros_weight)) > floor:
            out[f] = w
    return out


def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text) -> (run, n): what ends at each letter of the words, the closing mark included; three letters, two at a word's beginning."""

    def emit():
        words: Counter = Counter()
        for token, n in tokens.items():
            if (w := token.strip(EDGES)).isalpha():
                words[w] += n
        tokens.clear()
        # a code point has 21 bits: a run of three fits a number, and one of two leaves the upper bits empty
        codes = np.frombuffer((chr(BOUNDARY) + "".join(w + chr(BOUNDARY) for w in words)).encode("utf-32-le"), "<u4").astype(np.int64)
        ends = np.repeat(np.fromiter(words.values(), np.float64, len(words)), np.fromiter(map(len, words), np.int64, len(words)) + 1)
        older = np.concatenate([codes[:1], codes[:-2]])[: len(codes) - 1]
        runs = np.where(codes[:-1] == BOUNDARY, 0, older << 42) | codes[:-1] << 21 | codes[1:]
        kinds = pa.array(runs).dictionary_encode()
        found = ["".join(map(chr, filter(None, (r >> 42, r >> 21 & 0x1FFFFF, r & 0x1FFFFF)))) for r in kinds.dictionary.to_pylist()]
        n = np.bincount(kinds.indices.to_numpy(), ends, len(found)).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(n)], ["gram", "n"])

    tokens: Counter = Counter()
    for batch in batches:
        for t in batch.column(0).to_pylist():
            tokens.update(t.lower().split())
            if len(tokens) > 200_000:
                yield emit()
    yield emit()


def fit_curve(totals: np.ndarray, labels: np.ndarray, prior_shift: float, ridge: float = 1e-2) -> tuple[float, float]:
    """Slope and intercept by Newton steps; the intercept is moved to the prior of all labelled rows."""
    x = np.stack([totals, np.ones_like(totals)], axis=1)
    y = labels.astype(float)
    beta = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -40, 40)))
        gradient = x.T @ (y - p) - ridge * beta
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return float(max(beta[0], 0.0)), float(beta[1] + prior_shift)


def fit(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learn from the rows of ``df`` that ``labels`` (key, label) covers."""
    spark = df.sparkSession
    marked = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.max((F.col(label) > 0).cast("int")).alias("y"))
    sizes = {r["y"]: r["count"] for r in marked.groupBy("y").count().collect()}
    if not sizes.get(0) or not sizes.get(1):
        return Model(None, constant=float(bool(sizes.get(1))))
    chosen = bounded_sample(marked, "y", "key", sample_rows)
    texts = df.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    # the chosen keys are 2 * sample_rows at most: a bounded broadcast
    rows = texts.join(F.broadcast(chosen), "key").select("y", "text")

    def hashed(batches):
        words = WordHashes()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([min_hash(t, words) for t in batch.column(1).to_pylist()], pa.int64())], ["y", "text", "mh"])

    once = rows.mapInArrow(hashed, "y int, text string, mh bigint").groupBy("mh").agg(F.min(F.struct("y", "text")).alias("r")).select("r.*", "mh")
    few = F.row_number().over(Window.partitionBy("y").orderBy(F.xxhash64("mh")))  # a key may repeat with many texts
    sample = written(once.withColumn("nth", few).where(F.col("nth") <= sample_rows).select("y", "text", F.pmod("mh", F.lit(2)).cast("int").alias("half")), "toxicity-sample")

    cells = {(r["half"], r["y"]): r["count"] for r in sample.groupBy("half", "y").count().collect()}
    a0, a1, b0, b1 = (cells.get(c, 0) for c in ((0, 0), (0, 1), (1, 0), (1, 1)))
    if not a1 + b1 or not a0 + b0:
        return Model(None, constant=float(a0 + b0 == 0))
    ratio = (sizes[0] / sizes[1]) / ((a0 + b0) / (a1 + b1))  # how many rows of label 0 one of the sample stands for

    got = texts.select("text").mapInArrow(count_grams, "gram string, n bigint").groupBy("gram").agg(F.sum("n").alias("n")).orderBy("gram").toArrow()
    lm = CharLM.of_grams("text", got.column(0).to_pylist(), got.column(1).to_numpy().astype(np.float64))
    bare = Model(lm)
    shared = spark.sparkContext.broadcast(bare)

    def features(batches):
        m = shared.value
        reader = reader_of(m.token, m.lm, {})
        counts: dict[str, list[int]] = {}

        def emit():
            names = list(counts)
            columns = [pa.array(names, pa.string()), *(pa.array([counts[f][i] for f in names], pa.int64()) for i in range(4))]
            counts.clear()
            return pa.RecordBatch.from_arrays(columns, ["f", "a0", "a1", "b0", "b1"])

        for batch in batches:
            for y, t, half in zip(*(batch.column(i).to_pylist() for i in range(3))):
                slot = 2 * half + y
                for f in features_of(reader.words(t)):
                    counts.setdefault(f, [0, 0, 0, 0])[slot] += 1
            if len(counts) > 300_000:
                yield emit()
        yield emit()

    # only features that label 1 favours, in a half or on the whole, can have a weight; the others stay on the executors
    favoured = " or ".join(f"({one} >= 3 and {one} > {ratio!r} * ({zero}))" for one, zero in (("a1", "a0"), ("b1", "b0"), ("a1 + b1", "a0 + b0")))
    sums = sample.mapInArrow(features, "f string, a0 bigint, a1 bigint, b0 bigint, b1 bigint").groupBy("f").agg(*(F.sum(c).alias(c) for c in ("a0", "a1", "b0", "b1"))).where(favoured).toArrow()
    table = {f: (v0, v1, w0, w1) for f, v0, v1, w0, w1 in zip(*(sums.column(i).to_pylist() for i in range(5)))}
    halves = [learn_weights({f: (v[3], v[2]) for f, v in table.items()}, ratio, 3), learn_weights({f: (v[1], v[0]) for f, v in table.items()}, ratio, 3)]
    final = learn_weights({f: (v[1] + v[3], v[0] + v[2]) for f, v in table.items()}, ratio, 5 if a1 + b1 >= 100 else 3)
    other = spark.sparkContext.broadcast((bare.token, lm, halves))

    def totals(batches):
        token, lm, halves = other.value
        readers = [reader_of(f"{token}-{i}", lm, halves[i]) for i in (0, 1)]
        for batch in batches:
            out = [readers[half].total(t) for t, half in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], ["y", "total"])

    seen = sample.mapInArrow(totals, "y int, total double").toArrow()
    y, x = seen.column(0).to_numpy(), seen.column(1).to_numpy()
    n1, n0 = float((y == 1).sum()), float((y == 0).sum())
    slope, intercept = fit_curve(x, y, math.log(sizes[1] / sizes[0]) - math.log(n1 / n0))
    return Model(lm, final, slope, intercept)


def score(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row: key, ``keep`` columns, score, predicted."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]):
        m = shared.value
        reader = reader_of(m.token, m.lm, m.weights)
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                scores = [m.score(reader.total(t)) for t in batch.column(at_text).to_pylist()]
                out = [pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], *out], [*columns, "score", "predicted"])

    columns = list(dict.fromkeys([key, *keep]))
    extra = [] if text in columns else [F.col(text).cast("string").alias("_text")]  # a text travels once
    at_text = columns.index(text) if text in columns else len(columns)
    fields = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in columns)
    return df.select(*columns, *extra).mapInArrow(run, fields + "score double, predicted int")
