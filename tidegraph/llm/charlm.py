"""Interpolated Kneser-Ney character models of words, several at once.

A model sees a word as its letters between boundary marks. For every order the
seen n-grams of all models lie in one sorted array of 64-bit hashes; beside it
are, per model, the discounted share of the n-gram and the weight that its
context leaves to the next shorter order. Looking up is a binary search over
whole arrays of positions, so a batch of words is scored without a loop over
characters.
"""

from __future__ import annotations

import numpy as np

from tidegraph.llm.common import mix64

BOUNDARY = 2  # a control character that no word holds


def grams(words: list[str], order: int) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Hashes of the 1..order-grams that end at each predicted position, their validity, and each position's word.

    Every letter and the closing boundary are predicted.
    """
    joined = "".join(f"\x02{w}\x02" for w in words)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    sizes = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    starts = np.cumsum(sizes) - sizes
    index = np.arange(len(codes)) - np.repeat(starts, sizes)
    owner = np.repeat(np.arange(len(words)), sizes)
    hashes, valid = [], []
    h = mix64(codes + np.uint64(1))
    hashes.append(h)
    valid.append(index >= 1)
    for k in range(1, order):
        older = np.zeros_like(codes)
        older[k:] = codes[:-k] if k else codes
        h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + older + np.uint64(1))
        hashes.append(h)
        valid.append(index >= max(k, 1))
    keep = index >= 1
    return [x[keep] for x in hashes], [x[keep] for x in valid], owner[keep]


class CharLM:
    """Kneser-Ney models for ``names``; ``fit`` takes word counts per name."""

    def __init__(self, names: list[str], order: int = 5):
        self.names, self.order, self.floor = names, order, 1.0
        self.keys, self.share, self.context_keys, self.backoff = [], [], [], []

    @classmethod
    def fit(cls, counts: dict[str, dict[str, int]], order: int = 5) -> CharLM:
        self = cls(sorted(counts), order)
        per_model = []
        alphabet: set[str] = set()
        for name in self.names:
            words = list(counts[name])
            alphabet.update("".join(words))
            weights = np.fromiter(counts[name].values(), np.float64, len(words))
            per_model.append(self._ngrams(words, weights))
        self.floor = 1.0 / (len(alphabet) + 2)
        n = len(self.names)
        for k in range(order):
            keys = np.unique(np.concatenate([m[k][0] for m in per_model] or [np.zeros(0, np.uint64)]))
            contexts = np.unique(np.concatenate([m[k][1] for m in per_model] or [np.zeros(0, np.uint64)]))
            share = np.zeros((len(keys), n), np.float32)
            backoff = np.ones((len(contexts), n), np.float32)
            for j, m in enumerate(per_model):
                grams_k, ctx_k, value, context_of, gamma = m[k][0], m[k][1], m[k][2], m[k][3], m[k][4]
                share[np.searchsorted(keys, grams_k), j] = value
                backoff[np.searchsorted(contexts, ctx_k), j] = gamma
            self.keys.append(keys)
            self.share.append(share)
            self.context_keys.append(contexts)
            self.backoff.append(backoff)
        return self

    def _ngrams(self, words: list[str], weights: np.ndarray):
        """Per order: sorted n-grams, sorted contexts, shares, contexts of the n-grams, backoff weights."""
        hashes, valid, owner = grams(words, self.order)
        contexts = context_hashes(words, self.order)
        out = []
        for k in range(self.order):
            ok = valid[k]
            g, c, w = hashes[k][ok], contexts[k][ok], weights[owner[ok]]
            keys, first, inverse = np.unique(g, return_index=True, return_inverse=True)
            if k == self.order - 1:
                count = np.bincount(inverse, w, len(keys))
            else:
                # continuation count: how many letters stand before it; what begins a word has nothing before and keeps its own count
                longer_ok = valid[k + 1]
                pairs = np.unique(np.stack([inverse[longer_ok[ok]], np.unique(hashes[k + 1][longer_ok], return_inverse=True)[1]]), axis=1) if longer_ok.any() else np.zeros((2, 0), np.int64)
                count = np.bincount(pairs[0].astype(np.int64), minlength=len(keys)).astype(np.float64)
                at_start = ~longer_ok[ok]
                count += np.bincount(inverse[at_start], w[at_start], len(keys))
            out.append(discounted(keys, c[first], count))
        return out

    @classmethod
    def of_grams(cls, name: str, grams: list[str], weights: np.ndarray) -> CharLM:
        """One model of order three from the counts of what ends at each letter: three letters, or a boundary mark and a word's first one."""
        self = cls([name], 3)
        codes = np.zeros((len(grams), 3), np.uint64)  # the letter, the one before it, the one before that
        for i, g in enumerate(grams):
            codes[i, : len(g)] = [ord(c) for c in reversed(g)]
        whole = np.fromiter((len(g) == 3 for g in grams), bool, len(grams))
        self.floor = 1.0 / (len(np.unique(codes[:, 0])) + 1)  # the mark is among them
        odd, one = np.uint64(0x9E3779B97F4A7C15), np.uint64(1)
        h1 = mix64(codes[:, 0] + one)
        h2 = mix64(h1 * odd + codes[:, 1] + one)
        h3 = mix64(h2 * odd + codes[:, 2] + one)
        c1 = np.full(len(grams), 7, np.uint64)
        c2 = mix64(c1 * odd + codes[:, 1] + one)
        c3 = mix64(c2 * odd + codes[:, 2] + one)
        pairs, pair_at, pair_of = np.unique(h2, return_index=True, return_inverse=True)
        singles, single_at, single_of = np.unique(h1[pair_at], return_index=True, return_inverse=True)
        # how many letters stand before; what begins a word has nothing before and keeps its own count
        before = np.bincount(pair_of, np.where(whole, 1.0, weights), len(pairs))
        triples, triple_at = np.unique(h3[whole], return_index=True)
        parts = (
            discounted(singles, c1[pair_at][single_at], np.bincount(single_of, minlength=len(singles)).astype(np.float64)),
            discounted(pairs, c2[pair_at], before),
            discounted(triples, c3[whole][triple_at], weights[whole][triple_at].astype(np.float64)),
        )
        for keys, contexts, value, _, gamma in parts:
            self.keys.append(keys)
            self.share.append(value.astype(np.float32)[:, None])
            self.context_keys.append(contexts)
            self.backoff.append(gamma.astype(np.float32)[:, None])
        return self

    def score_words(self, words: list[str]) -> np.ndarray:
        """Log-probability (natural) of each word under each model."""
        n = len(self.names)
        if not words or not n:
            return np.zeros((len(words), n))
        hashes, valid, owner = grams(words, self.order)
        contexts = context_hashes(words, self.order)
        p = np.full((len(owner), n), self.floor, np.float32)
        for k in range(self.order):
            ok = valid[k]
            gamma = self._lookup(self.context_keys[k], contexts[k], self.backoff[k], 1.0, ok)
            share = self._lookup(self.keys[k], hashes[k], self.share[k], 0.0, ok)
            p = share + gamma * p
        logs = np.log(np.maximum(p, 1e-12))
        out = np.zeros((len(words), n))
        for j in range(n):
            out[:, j] = np.bincount(owner, logs[:, j], len(words))
        return out

    @staticmethod
    def _lookup(keys, wanted, values, default, ok):
        if not len(keys):
            return np.full((len(wanted), values.shape[1]), default, np.float32)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        found = ok & (keys[at] == wanted)
        out = values[at]
        out[~found] = default
        return out


def discounted(keys: np.ndarray, contexts: np.ndarray, count: np.ndarray):
    """Sorted n-grams with their contexts and counts to: n-grams, sorted contexts, shares, contexts of the n-grams, backoff weights."""
    ones, twos = float((count == 1).sum()), float((count == 2).sum())
    discount = min(0.95, max(0.05, ones / (ones + 2 * twos))) if ones and twos else 0.5
    ctx_keys, ctx_inverse = np.unique(contexts, return_inverse=True)
    total = np.bincount(ctx_inverse, count, len(ctx_keys))
    kinds = np.bincount(ctx_inverse, minlength=len(ctx_keys))
    value = np.maximum(count - discount, 0) / total[ctx_inverse]
    gamma = np.minimum(1.0, discount * kinds / total)
    return keys, ctx_keys, value, contexts, gamma


def context_hashes(words: list[str], order: int) -> list[np.ndarray]:
    """Hashes of the contexts (0..order-1 letters) before each predicted position, told apart by length."""
    joined = "".join(f"\x02{w}\x02" for w in words)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    sizes = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    starts = np.cumsum(sizes) - sizes
    index = np.arange(len(codes)) - np.repeat(starts, sizes)
    keep = index >= 1
    h = np.full(len(codes), 7, np.uint64)
    out = [h[keep]]
    for k in range(1, order):
        older = np.zeros_like(codes)
        older[k:] = codes[:-k]
        h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + older + np.uint64(1))
        out.append(h[keep])
    return out


class WordScores:
    """Memo of word scores; new words of a batch are scored together."""

    def __init__(self, lm: CharLM, limit: int = 200_000):
        self.lm, self.limit = lm, limit
        self.reset()

    def reset(self):
        self.index: dict[str, int] = {}
        self.scores = np.zeros((0, len(self.lm.names)))
        self.sizes = np.zeros(0, np.int64)

    def of(self, words_per_text: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Summed scores per text and model, and how many characters were predicted."""
        if len(self.index) > self.limit:
            self.reset()
        index = self.index
        fresh: list[str] = []
        rows = []
        for words in words_per_text:
            row = list(map(index.get, words))
            if None in row:
                for i, at in enumerate(row):
                    if at is None:
                        w = words[i]
                        at = index.get(w)
                        if at is None:
                            at = index[w] = len(self.scores) + len(fresh)
                            fresh.append(w)
                        row[i] = at
            rows.append(row)
        if fresh:
            parts = [self.lm.score_words(fresh[i : i + 20_000]) for i in range(0, len(fresh), 20_000)]
            self.scores = np.concatenate([self.scores, *parts])
            self.sizes = np.concatenate([self.sizes, np.fromiter((len(w) + 1 for w in fresh), np.int64, len(fresh))])
        total = np.zeros((len(rows), len(self.lm.names)))
        chars = np.zeros(len(rows), np.int64)
        for i, row in enumerate(rows):
            if row:
                at = np.array(row)
                total[i] = self.scores[at].sum(axis=0)
                chars[i] = self.sizes[at].sum()
        return total, chars
