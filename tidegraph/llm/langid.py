"""Language identification with Kneser-Ney character models.

Method: one interpolated Kneser-Ney character model per language, kept in
sorted hash arrays; a text goes to the language with the lowest cross-entropy
per character; whether the text is accepted at all is decided by a limit on
that cross-entropy, calibrated per language and text length on the training
rows. ``score`` is the posterior of the chosen language for equal priors, with
at most ``POSTERIOR_CHARS`` characters counted, so it stays comparable.

The models are fitted on a bounded sample: different texts of a language, all up
to ``SAMPLE_ROWS``, chosen by a hash of the text, and fitted twice: the second time
without the sentences that the first fit gives to another language. Word counts
are summed on the executors; what reaches the driver is bounded by the sample. Every text is then
scored whole; words are runs of letters, lower-cased.

Defined results: null texts and texts without a letter are ``und`` with score 0
and not accepted; with no training rows every text is ``und``; ties go to the
language that sorts first; rows with a null key are trained on and scored like
others; repeated texts are trained on once; very long texts are read whole; an
empty table gives an empty table.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegraph.llm.charlm import CharLM, WordScores
from tidegraph.llm.common import claim, memo_of, written

SAMPLE_ROWS, ORDER, POSTERIOR_CHARS, UNDETERMINED = 1000, 5, 40, "und"
LETTERS = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"[.!?\n]+")


def remainder(key: str, parts: int) -> Column:
    """crc32 of the key as text, modulo ``parts``; a null key counts as empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % parts


def bounded_sample(rows: DataFrame, group: str, by: str, most: int) -> DataFrame:
    """The rows of each value of ``group`` with the smallest hashes ``by``, one of equal ones, ``most`` at most; all if there are fewer.

    A first cut by the number of different hashes needs no shuffle of the rows.
    These numbers come to the driver, one for each value, as the models made of the
    sample do.
    """
    place = F.pmod(F.xxhash64(by), F.lit(1_000_003))
    sizes = rows.groupBy(group).agg(F.approx_count_distinct(by)).collect()
    if not sizes:
        return rows
    limits = F.create_map(*(F.lit(x) for value, n in sizes for x in (value, min(1_000_003, int(1.3 * most / max(n, 1) * 1_000_003) + 1))))
    near = rows.where(place <= F.element_at(limits, F.col(group)))
    nth = F.row_number().over(Window.partitionBy(group).orderBy(place, by))
    return near.dropDuplicates([group, by]).withColumn("_nth", nth).where(F.col("_nth") <= most).drop("_nth")


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, Counter] = {}

    def emit():
        rows = [(lang, w, n) for lang, c in counts.items() for w, n in c.items()]
        counts.clear()
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.string(), pa.string(), pa.int64()))], ["lang", "word", "n"])

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            counts.setdefault(lang, Counter()).update(LETTERS.findall(text.lower()))
        if sum(map(len, counts.values())) > 200_000:
            yield emit()
    if counts:
        yield emit()


class Calibrated:
    """The models with, per language, the usual cross-entropy and how far a text of some length may lie above it."""

    def __init__(self, lm: CharLM):
        self.lm, self.token = lm, uuid.uuid4().hex  # the token tells a worker's memo which model it belongs to
        n = len(lm.names)
        self.mean, self.spread, self.limit = np.zeros(n), np.ones(n), np.full(n, np.inf)

    def calibrate(self, entropies: np.ndarray, chars: np.ndarray, truth: np.ndarray, margin: float = 3.0) -> None:
        """The limit is ``margin`` times the largest standardised excess of the training rows."""
        for j in range(len(self.lm.names)):
            own = (truth == j) & (chars > 0)
            if own.sum() < 5:
                continue
            h, n = entropies[own, j], chars[own]
            self.mean[j] = np.median(h)
            self.spread[j] = max(1e-3, float(np.sqrt(np.mean((h - self.mean[j]) ** 2 * np.minimum(n, 400)))))
            self.limit[j] = margin * max(4.0, float(np.max(self.excess(h, n, j))))

    def excess(self, h, chars, j):
        return (h - self.mean[j]) * np.sqrt(np.minimum(chars, 400)) / self.spread[j]

    def predict(self, totals: np.ndarray, chars: np.ndarray):
        """Language index (-1: none), score, cross-entropy, accepted."""
        entropies = -totals / np.maximum(chars, 1)[:, None]
        if not len(self.lm.names):
            return np.full(len(chars), -1), np.zeros(len(chars)), np.zeros(len(chars)), np.zeros(len(chars), bool)
        best = entropies.argmin(axis=1)
        h = entropies[np.arange(len(best)), best]
        gap = (entropies - h[:, None]) * np.minimum(chars, POSTERIOR_CHARS)[:, None]
        score = 1 / np.exp(-np.minimum(gap, 700)).sum(axis=1)
        accepted = (self.excess(h, chars, best) <= self.limit[best]) & (chars > 0)
        return np.where(chars > 0, best, -1), np.where(chars > 0, score, 0.0), np.where(chars > 0, h, 0.0), accepted


_scores: dict[str, WordScores] = {}
memo_of("langid", _scores.clear)


def totals_of(lm: CharLM, token: str, texts: list) -> tuple[np.ndarray, np.ndarray]:
    claim("langid")
    if token not in _scores:
        _scores.clear()
        _scores[token] = WordScores(lm)
    return _scores[token].of([words_of(t) for t in texts])


def words_of(text: str | None) -> list[str]:
    """Runs of letters, lower-cased; none if there are only letter-like numerals."""
    words = LETTERS.findall(text.lower()) if text else []
    return words if any(c.isalpha() for w in words for c in w) else []


def collected(words: DataFrame) -> dict[str, dict[str, int]]:
    """Summed word counts by language; bounded by the sample they come from."""
    counts: dict[str, dict[str, int]] = {}
    got = words.groupBy("lang", "word").agg(F.sum("n").alias("n")).orderBy("lang", "word").toArrow()
    for name, word, n in zip(*(got.column(i).to_pylist() for i in range(3))):
        counts.setdefault(name, {})[word] = n
    return counts


def fit(df: DataFrame, text: str = "text", lang: str = "lang", sample_rows: int = SAMPLE_ROWS, order: int = ORDER) -> Calibrated:
    """Models from the rows with text and lang of ``df``."""
    spark = df.sparkSession
    rows = df.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"), F.xxhash64(F.col(text).cast("string")).alias("hash"))
    sample = written(bounded_sample(rows, "lang", "hash", sample_rows), "langid-sample")
    counts = collected(sample.select("lang", "text").mapInArrow(count_words, "lang string, word string, n bigint"))
    if not counts:
        return Calibrated(CharLM([], order))
    # texts hold sentences of other languages: a second fit counts only those that the first gives to the text's own
    first = spark.sparkContext.broadcast(Calibrated(CharLM.fit(counts, order)))

    def own_sentences(batches):
        m = first.value
        for batch in batches:
            langs, parts = [], []
            for lang, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                some = [x for x in SENTENCE.split(t) if x]
                langs += [lang] * len(some)
                parts += some
            totals, chars = totals_of(m.lm, m.token, parts)
            names = [m.lm.names[j] if n else None for j, n in zip(totals.argmax(axis=1), chars)]
            keep = [i for i, (lang, name) in enumerate(zip(langs, names)) if lang == name]
            yield pa.RecordBatch.from_arrays([pa.array([langs[i] for i in keep], pa.string()), pa.array([parts[i] for i in keep], pa.string())], ["lang", "text"])

    refined = collected(sample.select("lang", "text").mapInArrow(lambda batches: count_words(own_sentences(batches)), "lang string, word string, n bigint"))
    model = Calibrated(CharLM.fit({name: refined.get(name) or counts[name] for name in counts}, order))
    shared = spark.sparkContext.broadcast(model)
    names = {name: j for j, name in enumerate(model.lm.names)}

    def entropies(batches):
        m = shared.value
        for batch in batches:
            totals, chars = totals_of(m.lm, m.token, batch.column(1).to_pylist())
            h = -totals / np.maximum(chars, 1)[:, None]
            own = [names.get(x, -1) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(chars, pa.int64()), pa.array(h.tolist(), pa.list_(pa.float64()))], ["own", "chars", "h"])

    seen = sample.select("lang", "text").mapInArrow(entropies, "own int, chars bigint, h array<double>").toArrow()
    model.calibrate(np.array(seen.column(2).to_pylist()).reshape(-1, len(names)), seen.column(1).to_numpy(), seen.column(0).to_numpy())
    return model


def predict(df: DataFrame, model: Calibrated, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row: key, ``keep`` columns, lang_pred, score, cross_entropy, accepted. Rows stream; nothing is shuffled."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        names = [*m.lm.names, UNDETERMINED]
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                totals, chars = totals_of(m.lm, m.token, batch.column(at_text).to_pylist())
                best, score, h, accepted = m.predict(totals, chars)
                out = [pa.array([names[j] for j in best], pa.string()), pa.array(score, pa.float64()), pa.array(h, pa.float64()), pa.array(accepted, pa.bool_())]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], *out], [*columns, "lang_pred", "score", "cross_entropy", "accepted"])

    columns = list(dict.fromkeys([key, *keep]))
    extra = [] if text in columns else [F.col(text).cast("string").alias("_text")]  # a text travels once
    at_text = columns.index(text) if text in columns else len(columns)
    fields = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in columns)
    return df.select(*columns, *extra).mapInArrow(run, fields + "lang_pred string, score double, cross_entropy double, accepted boolean")
