"""Near-duplicate embeddings within a label by randomised-rotation binary codes.

Method: vectors are turned by a random rotation (fixed seed) and keep one sign
bit per coordinate together with a correction factor, the inner product of the
turned vector and its code. For a pair, the inner product of one side's turned
vector with the other side's code, divided by that factor, estimates the cosine
without bias, and the factor also gives a confidence bound on its error. Pairs
whose bound excludes the threshold are dropped; all others are recomputed
exactly in double precision, so a reported link is always exact.

Which pairs meet: sign bits of further rotations form ``tables`` keys of
``bits`` bits; two vectors of a label meet in each table where their keys agree,
and are judged in the first of these only. ``tables`` is chosen so that a pair
exactly at the threshold meets with probability ``RECALL``; pairs above it meet
more surely. Exact copies are one class and never compared with each other. A
group of more than ``GROUP_ROWS`` classes is cut into tiles that many tasks
share. A task emits sums of links and a spanning forest of its links, never the
pairs themselves, so what leaves it grows with the rows it read.

Defined results: vectors that are null, empty, zero, or hold null or non-finite
components, and rows with a null label or key, link with nothing: n_links 0,
component_id the own key, kept. Vectors of different dimensions do not meet.
Repeated rows are copies and link with each other. An empty table gives an
empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.llm.common import written
from tidegraph.llm.components import components

THRESHOLD, RECALL, GROUP_ROWS, TARGET_GROUP, SEED = 0.93, 0.9995, 4096, 64, 20240607
#: Standard deviations of the estimator's error that the bound allows for.
CONFIDENCE = 5.0


def parameters(rows_per_label: float, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """Bits of a key and number of tables for groups of about ``TARGET_GROUP`` unrelated rows."""
    bits = max(4, min(24, round(math.log2(max(rows_per_label, 1) / TARGET_GROUP)) if rows_per_label > TARGET_GROUP else 4))
    agree = 1 - math.acos(threshold) / math.pi
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - agree**bits))


@lru_cache(maxsize=64)
def rotation(dim: int, number: int) -> np.ndarray:
    """A random orthogonal matrix: the Q factor of a Gaussian matrix with a fixed seed."""
    q, r = np.linalg.qr(np.random.default_rng([SEED, dim, number]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def keys_of(unit: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """(rows, tables) keys from the sign bits of as many rotations as are needed."""
    dim = unit.shape[1]
    need = bits * tables
    signs = np.concatenate([unit @ rotation(dim, 1 + i) >= 0 for i in range(-(-need // dim))], axis=1)[:, :need]
    return (signs.reshape(len(unit), tables, bits) << np.arange(bits)).sum(axis=2).astype(np.int32)


def encode(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Turned vectors, sign codes (bool) and correction factors."""
    turned = unit @ rotation(unit.shape[1], 0)
    codes = turned >= 0
    factor = np.abs(turned).sum(axis=1) / math.sqrt(unit.shape[1])
    return turned, codes, factor


def estimate(turned: np.ndarray, codes: np.ndarray, factor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unbiased estimates of all cosines (rows of ``turned`` against coded rows) and each coded row's error bound."""
    dim = turned.shape[1]
    signs = np.where(codes, np.float32(1), np.float32(-1))
    guess = (turned.astype(np.float32) @ signs.T) / math.sqrt(dim) / factor.astype(np.float32)
    bound = CONFIDENCE * np.sqrt(np.maximum(0, 1 - factor**2)) / factor / math.sqrt(max(dim - 1, 1))
    return guess, bound


def links_of(a: dict, b: dict | None, table: int, threshold: float) -> np.ndarray:
    """Boolean matrix of the exact links that are first met in ``table``; b None: within a, upper triangle."""
    other = a if b is None else b
    open_ = np.ones((len(a["id"]), len(other["id"])), bool)
    if b is None:
        open_ = np.triu(open_, 1)
    for t in range(table):
        open_ &= a["keys"][:, t][:, None] != other["keys"][:, t][None, :]
    if not open_.any():
        return open_
    guess, bound = estimate(a["turned"], other["codes"], other["factor"])
    open_ &= guess + bound[None, :].astype(np.float32) >= threshold
    n = int(open_.sum())
    if n * 20 > open_.size:
        open_ &= a["unit"] @ other["unit"].T >= threshold
    elif n:
        i, j = np.nonzero(open_)
        for at in range(0, n, 100_000):
            ii, jj = i[at : at + 100_000], j[at : at + 100_000]
            open_[ii, jj] = np.einsum("ij,ij->i", a["unit"][ii], other["unit"][jj]) >= threshold
    return open_


def forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """Smallest index reachable from each of n nodes over the links."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if (label == before).all():
            break
    return label


def unit_of(v: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision; scaled first, so that no square over- or underflows."""
    v = v.astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def keyed_batches(bits: int, tables: int, payload: bool):
    """(id, mult, label, vector) -> one row per table, with or without the payload: keys, code and vector as it came."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                column = batch.column(3)
                offsets, values = column.offsets.to_numpy(), column.values.to_numpy()
                sizes = np.diff(offsets)
                for dim in np.unique(sizes).tolist():
                    rows = np.flatnonzero(sizes == dim)
                    v = np.stack([values[offsets[r] : offsets[r] + dim] for r in rows])
                    unit = unit_of(v)
                    keys = keys_of(unit, bits, tables)
                    mine = batch.take(pa.array(rows))
                    extra = []
                    if payload:
                        _, codes, factor = encode(unit)
                        packed = np.packbits(codes, axis=1)
                        blobs = [keys[n].astype("<i4").tobytes() + packed[n].tobytes() + v[n].tobytes() for n in range(len(rows))]
                        extra = [mine.column(0), mine.column(1), pa.array(factor, pa.float64()), pa.array(blobs, pa.binary())]
                    for t in range(tables):
                        head = [mine.column(2), pa.array(np.full(len(rows), dim, np.int32)), pa.array(np.full(len(rows), t, np.int32)), pa.array(keys[:, t])]
                        yield pa.RecordBatch.from_arrays([*head, *extra], ["label", "dim", "t", "k", *(["id", "mult", "factor", "payload"] if payload else [])])

    return run


def tile_batches(tables: int, threshold: float, kind: str):
    """Rows sorted by (label, dim, t, k, tile) -> (id, links, root) of each tile."""

    def solve(group, rows):
        _, dim, table, _, low, high = group
        parts = []
        for block in (low, high) if low != high else (low,):
            own = [r for r in rows if r[0] == block]
            if not own:
                return None
            raw = np.frombuffer(b"".join(r[4] for r in own), np.uint8).reshape(len(own), -1)
            keys = raw[:, : 4 * tables].copy().view("<i4")
            n = -(-dim // 8)
            codes = np.unpackbits(raw[:, 4 * tables : 4 * tables + n], axis=1)[:, :dim].astype(bool)
            unit = unit_of(raw[:, 4 * tables + n :].copy().view(kind))
            parts.append({"id": np.array([r[1] for r in own]), "mult": np.array([r[2] for r in own]), "factor": np.array([r[3] for r in own]), "keys": keys, "codes": codes, "unit": unit, "turned": unit @ rotation(dim, 0)})
        a, b = parts[0], parts[1] if len(parts) > 1 else None
        found = links_of(a, b, table, threshold)
        if not found.any():
            return None
        if b is None:
            i, j = np.nonzero(found)
            ids, mult = a["id"], a["mult"]
        else:
            i, j = np.nonzero(found)
            j = j + len(a["id"])
            ids, mult = np.concatenate([a["id"], b["id"]]), np.concatenate([a["mult"], b["mult"]])
        links = np.bincount(i, mult[j], len(ids)) + np.bincount(j, mult[i], len(ids))
        order = np.argsort(ids, kind="stable")  # so that the smallest index is the smallest id
        rank = np.empty_like(order)
        rank[order] = np.arange(len(ids))
        root = ids[order][forest(rank[i], rank[j], len(ids))][rank]
        touched = links > 0
        return ids[touched], links[touched].astype(np.int64), root[touched]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, rows, out = None, [], []

        def flush():
            nonlocal out
            columns = [np.concatenate([o[c] for o in out]) for c in range(3)]
            out = []
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["id", "links", "root"])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in range(batch.num_columns)]
            for *g, block, key, mult, factor, payload in zip(*columns):
                if g != group:
                    if len(rows) > 1 and (got := solve(group, rows)):
                        out.append(got)
                        if sum(len(o[0]) for o in out) > 50_000:
                            yield flush()
                    group, rows = g, []
                rows.append((block, key, mult, factor, payload))
        if len(rows) > 1 and (got := solve(group, rows)):
            out.append(got)
        if out:
            yield flush()

    return run


def near_duplicates(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """Per row: key, n_links, component_id, kept."""
    v = F.col("v")
    fine = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    kind = df.schema[key].dataType.simpleString()
    single = df.schema[vector].dataType.simpleString() == "array<float>"
    vector_column = F.col(vector) if single else F.transform(F.col(vector), lambda x: x.cast("double"))
    rows = df.select(F.col(key).cast("bigint").alias("id"), F.col(label).alias("label"), vector_column.alias("v"))
    rows = rows.withColumn("ok", F.coalesce(fine & F.col("id").isNotNull() & F.col("label").isNotNull(), F.lit(False)))
    # exact copies are one class: two 64-bit hashes name it
    named = rows.where("ok").withColumn("v", F.transform("v", lambda x: (x + F.lit(0.0)).cast("float" if single else "double"))).withColumn("h1", F.xxhash64("label", "v")).withColumn("h2", F.xxhash64(F.reverse("v"), "label"))
    classes = written(named.groupBy("h1", "h2").agg(F.min("id").alias("id"), F.count("*").alias("mult"), F.first("label").alias("label"), F.first("v").alias("v")), "vector-classes")
    spread = classes.groupBy("label").count().agg(F.sum("count").alias("n"), F.count("*").alias("labels"), F.max("count").alias("most")).first()
    bits, tables = parameters(max(spread["n"] / max(spread["labels"], 1), (spread["most"] or 0) / 4) if spread["n"] else 1, threshold)
    head = f"label {classes.schema['label'].dataType.simpleString()}, dim int, t int, k int"
    source = classes.select("id", "mult", "label", "v")
    group = ["label", "dim", "t", "k"]
    # keys are cheap: they are made twice instead of writing the vectors once for each table
    sizes = source.mapInArrow(keyed_batches(bits, tables, False), head).groupBy(*group).count().where("count > 1")
    sizes = written(sizes.withColumn("blocks", F.ceil(F.col("count") / F.lit(GROUP_ROWS)).cast("int")).drop("count"), "vector-groups")
    keyed = source.mapInArrow(keyed_batches(bits, tables, True), f"{head}, id bigint, mult bigint, factor double, payload binary")
    meeting = keyed.join(sizes, group)  # rows that are alone in their group go; a hot group is split by the skew join
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    tiles = meeting.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiles = tiles.select(*group, F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "id", "mult", "factor", "payload")
    work = tiles.repartition(*group, "low", "high").sortWithinPartitions(*group, "low", "high", "block", "id")
    found = written(work.mapInArrow(tile_batches(tables, threshold, "<f4" if single else "<f8"), "id bigint, links bigint, root bigint"), "vector-links")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    roots = components(found.where("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b")))
    of_class = classes.select("h1", "h2", "id", "mult").join(links, "id", "left").join(roots.withColumnRenamed("node", "id"), "id", "left")
    of_class = of_class.select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    linked = named.select("id", "h1", "h2").join(of_class, ["h1", "h2"]).select("id", "n_links", "component_id")
    alone = rows.where("not ok").select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).select(F.col("id").cast(kind).alias(key), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
