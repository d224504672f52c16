"""Exact top-k inner products of integer vectors by norm-bucketed retrieval.

Method: candidates are grouped into buckets by length (Euclidean norm), longest
first. A first pass over one block of the longest bucket gives every query a
lower bound for its k-th score. The bound over the lengths of a query and of a
bucket's longest vector is the local cosine threshold of that query in that
bucket, and decides how the bucket is searched for it. Above 1: not at all. Near
1 (``NARROW``): by coordinates; the threshold leaves a narrow range for each of
the query's strongest coordinates, and only candidates inside all of them stay.
Below: by length; the bucket is sorted by length, and only the prefix that is
long enough is multiplied. What stays is verified by exact products.

Exactness: products are computed in doubles where the lengths bound them below
2**53, so that every partial sum is an exact integer. Beyond, doubles with an
error bound only choose who can be among the best, and their products are made
anew in whole numbers of any size. Scores beyond the range of a long are
reported as the nearest long, and ranked as reported.

Shape: candidates are cut into blocks of one bucket, queries into blocks of like
thresholds, and query blocks into groups. A candidate block meets a group only if
its longest vector can reach the lowest threshold of the group; this is decided
on block descriptions before any vector travels. A unit of work holds one
candidate block and reads the query blocks of one group one by one; its result is
at most k rows a query. No block is broadcast.

Defined results: null and empty vectors, and vectors with null or non-finite
components (also after scaling), take no part, nor do rows with a null key; a
query never finds its own row; rows that share a key are rows of their own, as
candidates and, each with its own list, as queries; equal scores go to the
smaller key; vectors of another dimension than the query's are no candidates; a
vector of zeros scores 0; very long vectors only make blocks larger; an empty
table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegraph.llm.common import written

K, SCALE, BUCKETS, BLOCK_ROWS, FOCUS, NARROW = 20, 64, 8, 8192, 6, 0.9
#: Query blocks of one group, and salts of the join of block descriptions.
GROUP, SALTS = 32, 16
#: Slack of comparisons between lengths and scores, far above the rounding of either.
SLACK = 1e-9
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def usable_batches(scale: float):
    """(row, key, vector of finite doubles) -> the scaled whole numbers as bytes, their length and dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            offsets = lists.offsets.to_numpy()
            if not batch.num_rows:
                continue
            with np.errstate(over="ignore", invalid="ignore"):
                flat = np.floor(lists.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]].astype("<f8") * scale)
                at = (offsets[:-1] - offsets[0]).astype(np.int64)
                size = np.diff(offsets)
                top = np.maximum.reduceat(np.abs(flat), at)
                fine = np.isfinite(top)
                unit = flat / np.repeat(np.where(top > 0, top, 1), size)
                norm = top * np.sqrt(np.add.reduceat(unit * unit, at))
            rows = np.flatnonzero(fine)
            blobs = [flat[at[i] : at[i] + size[i]].tobytes() for i in rows]
            some = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(some), batch.column(1).take(some), pa.array(blobs, pa.binary()), pa.array(np.minimum(norm[rows], 1e308)), pa.array(size[rows], pa.int64())], ["row", "key", "v", "norm", "dim"])

    return run


def usable(df: DataFrame, key: str, vector: str, scale: float) -> DataFrame:
    """row (an identity of its own), key, v (doubles that are whole numbers), norm, dim."""
    v = F.col(vector)
    fine = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    whole = df.where(F.col(key).isNotNull() & F.coalesce(fine, F.lit(False)))
    rows = whole.select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("bigint").alias("key"), v.cast("array<double>").alias("v"))
    return rows.mapInArrow(usable_batches(scale), "row bigint, key bigint, v binary, norm double, dim bigint")


def packed(v: np.ndarray) -> bytes:
    """A matrix of whole numbers in the narrowest type that holds them, its code first."""
    top = np.abs(v).max(initial=0)
    code = "<i2" if top < 1 << 15 else "<i4" if top < 1 << 31 else "<f8"
    return code[1:].encode() + v.astype(code).tobytes()


def unpacked(blob: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(blob, "<" + blob[:2].decode(), offset=2).reshape(-1, dim).astype("<f8")


@dataclass
class Block:
    """Vectors with their rows and keys, sorted by falling length."""

    rows: np.ndarray
    keys: np.ndarray
    v: np.ndarray
    norm: np.ndarray

    @classmethod
    def of(cls, rows, keys, v) -> Block:
        top = np.abs(v).max(axis=1, initial=0)
        norm = np.minimum(top * np.sqrt(((v / np.where(top > 0, top, 1)[:, None]) ** 2).sum(axis=1)), 1e308)
        order = np.argsort(-norm, kind="stable")
        return cls(rows[order], keys[order], v[order], norm[order])


def cosine_ranges(q: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of a unit candidate's coordinates if its cosine with the unit query reaches the threshold."""
    t = min(max(threshold, -1.0), 1.0)
    spread = np.sqrt(max(0.0, 1 - t * t)) * np.sqrt(np.maximum(0, 1 - q * q))
    low = np.where(q <= -t, -1.0, q * t - spread)
    high = np.where(q >= t, 1.0, q * t + spread)
    return low - SLACK, high + SLACK


def thresholds(norm: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """The least length of a candidate that can reach each query's bound; -inf where any can."""
    return np.where(bound > 0, bound * (1 - SLACK) / np.maximum(norm, 1e-300), -np.inf)


def best_of(q: Block, c: Block, bound: np.ndarray, k: int, focus: int = FOCUS):
    """Top k of a query block in a candidate block: (query index, candidate index, score) arrays.

    bound: scores below it cannot be among the query's best.
    """
    found: list[tuple] = []
    reach = thresholds(q.norm, bound)
    longest = c.norm[0] if len(c.norm) else -1.0
    live = np.flatnonzero(reach <= longest)
    prefix = np.searchsorted(-c.norm, -reach[live], "right")  # by length: these are long enough
    local = np.where(longest > 0, reach[live] / max(longest, 1e-300), -np.inf)  # the cosine threshold of the bucket
    for i, n in zip(live[local > NARROW], prefix[local > NARROW]):
        size = max(q.norm[i], 1e-300)
        unit_q = q.v[i] / size
        left = np.arange(n)
        # a candidate of length l needs a cosine of reach / l at least: the bucket's longest gives the widest range
        low, high = cosine_ranges(unit_q, reach[i] / longest)
        for f in np.argsort(-np.abs(unit_q))[:focus]:
            x = c.v[left, f] / np.maximum(c.norm[left], 1e-300)
            left = left[(x >= low[f]) & (x <= high[f])]
        judge(found, q, c, bound, np.array([i]), left, k)
    wide = live[local <= NARROW]
    order = np.argsort(-prefix[local <= NARROW], kind="stable")
    wide, lengths = wide[order], prefix[local <= NARROW][order]
    step = max(1, min(256, (1 << 21) // max(1, len(c.norm))))
    for at in range(0, len(wide), step):
        judge(found, q, c, bound, wide[at : at + step], np.arange(lengths[at]), k)
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found))


def judge(found: list, q: Block, c: Block, bound: np.ndarray, some: np.ndarray, left: np.ndarray, k: int) -> None:
    """Products of the queries ``some`` with the candidates ``left``; the k best of each, by (score down, key up), its own row left out."""
    if not len(left) or not len(some):
        return
    v = c.v if len(left) == len(c.v) else c.v[: len(left)] if left[-1] == len(left) - 1 else c.v[left]
    most = q.norm[some] * c.norm[left[0]]
    small = bool(most.max() < 2.0**53)
    with np.errstate(over="ignore", invalid="ignore"):
        s = q.v[some] @ v.T
    slack = np.zeros(len(some))
    if not small:
        s = np.clip(np.nan_to_num(s, nan=0.0, posinf=2.0**63, neginf=-(2.0**63)), -(2.0**63), 2.0**63)
        slack = np.where(most < 1e290, most * (v.shape[1] + 4) * 2.0**-51, np.inf)
    floor = bound[some].astype(float)
    if s.shape[1] > k + 1:  # the own row may be among them
        floor = np.maximum(floor, np.partition(s, s.shape[1] - k - 1, axis=1)[:, s.shape[1] - k - 1])
    r, j = np.nonzero(s >= (floor - slack)[:, None])
    if small:
        score = s[r, j].astype(np.int64)
    else:
        whole_q, whole_c = {x: [int(y) for y in q.v[some[x]]] for x in set(r.tolist())}, {x: [int(y) for y in v[x]] for x in set(j.tolist())}
        score = np.array([min(max(sum(map(int.__mul__, whole_q[x], whole_c[y])), LEAST), MOST) for x, y in zip(r.tolist(), j.tolist())], np.int64)
    r, j = some[r], left[j]
    ok = (q.rows[r] != c.rows[j]) & (score >= bound[r])
    r, j, score = r[ok], j[ok], score[ok]
    order = np.lexsort((c.rows[j], c.keys[j], ~score, r))  # ~: falling, without overflow
    r, j, score = r[order], j[order], score[order]
    ok = np.arange(len(r)) - np.searchsorted(r, r, "left") < k
    found.append((r[ok], j[ok], score[ok]))


FOUND = "query_row bigint, query_id bigint, vec_id bigint, vec_row bigint, score bigint"


def unit_batches(k: int):
    """Rows (unit, is_query, rows, keys, vectors, bounds, dim), sorted: the candidate block of a unit, then its query blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, held = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                name, is_query, rows, keys, vectors, bounds, dim = (batch.column(c)[i].as_py() for c in range(7))
                rows, keys = np.frombuffer(rows, "<i8"), np.frombuffer(keys, "<i8")
                if not is_query:
                    unit, held = name, Block.of(rows, keys, unpacked(vectors, dim))
                    continue
                if name != unit:
                    continue
                bound = np.frombuffer(bounds, "<i8")
                queries = Block(rows, keys, unpacked(vectors, dim), np.zeros(0))
                sorted_ = Block.of(np.arange(len(rows)), keys, queries.v)
                place = sorted_.rows
                sorted_.rows = rows[place]
                r, j, s = best_of(sorted_, held, bound[place], k)
                columns = (sorted_.rows[r], sorted_.keys[r], held.keys[j], held.rows[j], s)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["query_row", "query_id", "vec_id", "vec_row", "score"])

    return run


BLOCKS = "dim bigint, bucket bigint, block string, rows binary, keys binary, vectors binary, bounds binary, longest double, reach double"


def block_batches(block_rows: int):
    """Rows (dim, bucket, row, key, v, norm, bound), groups together -> one row per block of a group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        group = None

        def close():
            rows, keys, vectors, norms, bounds = zip(*held)
            v = np.frombuffer(b"".join(vectors), "<f8").reshape(len(rows), -1)
            norm, bound = np.array(norms), np.array(bounds, "<i8")
            blobs = (np.array(rows, "<i8").tobytes(), np.array(keys, "<i8").tobytes(), packed(v), bound.tobytes())
            reach = float(thresholds(norm, bound.astype(float)).min())
            name = f"{group[0]}-{group[1]}-{rows[0]}"  # rows are unique: so is the first one of a block
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in (*group, name, *blobs, float(norm.max()), reach)], BLOCK_NAMES)

        for batch in batches:
            for dim, bucket, *row in zip(*(batch.column(i).to_pylist() for i in range(7))):
                if held and ((dim, bucket) != group or len(held) >= block_rows):
                    yield close()
                group = (dim, bucket)
                held.append(tuple(row))
        if held:
            yield close()

    return run


BLOCK_NAMES = [c.split()[0] for c in BLOCKS.split(", ")]
PAYLOAD = ["rows", "keys", "vectors", "bounds", "dim"]


def searched(queries: DataFrame, candidates: DataFrame, k: int, group: int = GROUP) -> DataFrame:
    """The k best rows of every query in each candidate block that can reach it, by the descriptions of blocks."""
    groups = F.pmod(F.xxhash64("block"), F.greatest(F.lit(1), F.ceil(F.count("*").over(Window.partitionBy("dim", "bucket")) / group)))
    placed = queries.select("dim", "block", "reach", "bucket", groups.alias("part"))
    parts = placed.groupBy("dim", "bucket", "part").agg(F.min("reach").alias("reach")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    described = candidates.select("dim", F.col("block").alias("c_block"), "longest", F.pmod(F.xxhash64("block"), F.lit(SALTS)).cast("int").alias("salt"))
    pairs = described.join(parts, ["dim", "salt"]).where("reach <= longest").select("dim", "c_block", "bucket", "part", F.concat_ws("|", "c_block", "bucket", "part").alias("unit"))
    pairs = written(pairs, "topk-units")
    c = pairs.select("unit", F.col("c_block").alias("block")).join(candidates, "block").select("unit", F.lit(False).alias("is_query"), *PAYLOAD)
    q = pairs.select("unit", "dim", "bucket", "part").join(placed.select("dim", "bucket", "part", "block"), ["dim", "bucket", "part"]).select("unit", "block").join(queries, "block").select("unit", F.lit(True).alias("is_query"), *PAYLOAD)
    work = c.unionByName(q).repartition("unit").sortWithinPartitions("unit", "is_query")
    return work.mapInArrow(unit_batches(k), FOUND)


def topk(df: DataFrame, key: str = "vec_id", vector: str = "embedding", every: int = 20, k: int = K, scale: float = SCALE, buckets: int = BUCKETS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score for every row whose key is divisible by ``every``."""
    vectors = written(usable(df, key, vector, scale), "topk-vectors")
    found = vectors.agg(F.count("*").alias("n"), F.percentile_approx("norm", [i / buckets for i in range(1, buckets)], 1000).alias("e")).first()
    bucket = F.lit(0)
    for e in sorted(set(found["e"] or [])):
        bucket = bucket + (F.col("norm") < F.lit(float(e))).cast("int")  # 0: the longest
    spread = F.xxhash64("row")
    per_bucket = max(1, -(-found["n"] // (buckets * block_rows)))
    none = F.lit(LEAST).cast("bigint")
    columns = ["dim", "bucket", "row", "key", "v", "norm", "bound"]
    placed = vectors.select("dim", bucket.cast("bigint").alias("bucket"), "row", "key", "v", "norm", none.alias("bound"))
    candidates = placed.repartition(buckets * per_bucket, "dim", "bucket", F.pmod(spread, F.lit(per_bucket))).sortWithinPartitions("dim", "bucket", F.desc("norm"), "row")
    candidates = written(candidates.select(*columns).mapInArrow(block_batches(block_rows), BLOCKS), "topk-candidates")
    asking = placed.where(F.pmod("key", F.lit(every)) == 0)
    few = max(1, -(-found["n"] // (every * block_rows)))

    def asked(rows: DataFrame, order: list) -> DataFrame:
        """Query blocks of one group of like thresholds each; the column ``bucket`` names the group."""
        ready = rows.repartition(few, "dim", "bucket", F.pmod(spread, F.lit(few))).sortWithinPartitions("dim", "bucket", *order)
        return written(ready.select(*columns).mapInArrow(block_batches(block_rows // 4), BLOCKS), "topk-queries")

    # first pass: one candidate block of the longest vectors gives each query its bound
    lead = candidates.groupBy("dim").agg(F.min_by(F.struct(*(c for c in BLOCK_NAMES if c != "dim")), F.struct("bucket", "block")).alias("c")).select("dim", "c.*")
    first = searched(asked(asking.withColumn("bucket", F.lit(0).cast("bigint")), ["row"]), lead, k)
    bounds = first.groupBy("query_row").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") >= k).select(F.col("query_row").alias("row"), F.col("least").alias("least"))
    again = written(asking.drop("bound").join(bounds, "row", "left").withColumn("bound", F.coalesce("least", none)).withColumn("reach", F.when(F.col("bound") > 0, F.col("bound") / F.col("norm")).otherwise(0.0)), "topk-asking")
    cuts = again.select(F.percentile_approx("reach", [i / buckets for i in range(1, buckets)], 1000).alias("e")).first()["e"] or []
    level = F.lit(0)
    for e in sorted(set(cuts)):
        level = level + (F.col("reach") < F.lit(float(e))).cast("int")
    found = searched(asked(again.withColumn("bucket", level.cast("bigint")), [F.desc("reach"), "row"]), candidates, k)
    by_score = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "vec_row")
    return found.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
