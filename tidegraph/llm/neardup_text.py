"""Near-duplicate documents: an exact Jaccard self-join of word-shingle sets.

Method: PartEnum (see ``partenum``). Documents with the same set are one class,
a node with a number of its own. The signatures of each class are dealt to buckets
by instance and value; a bucket finds the classes that share one and names
each with the first of them, and keeps lists of three or more. Pairs that cannot
be similar by an exact lower bound on their difference (sizes and parity
sketches) are dropped. Of the others, each class is first verified on the full
sets with the nearest few by key, and what is similar is connected. Then every
pair that shares a signature, may be similar and still lies in two components is
verified as well, so no link between different texts is lost, while a group of
thousands of copies costs a few comparisons a member.

Scale: each instance has as many buckets as its signatures fill, counted before
they are dealt, so a bucket's rows are bounded, unless one signature alone is
hotter; nothing but counts by band and the frequent elements (a bounded sample,
see ``SAMPLE_SETS``; they steer the work, never the result) reach the driver. Sets
are compared as 64-bit hashes.

Defined results: a text with fewer than five words is one shingle of all its
words; null, empty and blank texts have no shingle and link with nothing; rows
with a null key link with nothing and have a null component; repeated rows are
one class; rows that share a key but not a text are rows of their own; very long
texts have larger sets; an empty table gives an empty table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.llm.common import WordHashes, claim, discard, mix64, written
from tidegraph.llm.components import components
from tidegraph.llm.partenum import DEN, NUM, PARTS, SMALL, band_of, first_level, fold, shingles, signatures, sketch

SAMPLE_SETS, FREQUENT_SHARE, BUCKET_ROWS, NEAREST = 4096, 0.005, 1_000_000, 3


def digest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    claim("neardup_text")
    memo = WordHashes()
    for whole in batches:
        for at in range(0, whole.num_rows, 1024):
            batch = whole.slice(at, 1024)
            n, h1, h2, parities = [], [], [], []
            for text in batch.column(2).to_pylist():
                s = shingles(text, memo)
                raw = xxhash.xxh3_128_intdigest(s.tobytes())
                n.append(len(s))
                h1.append((raw & (1 << 64) - 1) - (1 << 63))
                h2.append((raw >> 64) - (1 << 63))
                parities.append(sketch(s).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(x, pa.int64()) for x in (n, h1, h2)), pa.array(parities, pa.binary())], ["id", "row", "n", "h1", "h2", "sketch"])


def frequent_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    memo = WordHashes()
    for batch in batches:
        sets = [shingles(t, memo) for t in batch.column(0).to_pylist()]
        if sets:
            elements, counts = np.unique(np.concatenate(sets), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(elements.view(np.int64)), pa.array(counts, pa.int64())], ["e", "n"])


def dealing(sizes: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """From the number of classes of each size: first bucket and number of buckets of each instance; index 0 is that of elements."""
    rows = [0] * (band_of(max(sizes, default=1)) + 3)
    for size, classes in sizes.items():
        band = band_of(size)
        for b in (band, band + 1):
            rows[b + 1] += classes * first_level(b) * PARTS
        if size <= SMALL:
            rows[0] += classes * (size // DEN + 1)
    slices = np.array([max(1, -(-n // BUCKET_ROWS)) for n in rows], np.int64)
    return np.cumsum(slices) - slices, slices


def bucket_of(instances: np.ndarray, signs: np.ndarray, first: np.ndarray, slices: np.ndarray) -> np.ndarray:
    """Every instance has buckets of its own; a signature's value says which."""
    return first[instances + 1] + (signs % slices[instances + 1].astype(np.uint64)).astype(np.int64)


def signature_batches(frequent, first: np.ndarray, slices: np.ndarray):
    """(node, text) -> (bucket, blob); a blob holds the classes of one batch that have signatures in the bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, heavy = WordHashes(), frequent.value
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024).sort_by([("node", "ascending")])
                sets = [(i, s) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if len(s := shingles(t, memo))]
                if not sets:
                    continue
                got = [signatures(s, heavy) for _, s in sets]
                owner = np.repeat(np.arange(len(sets)), [len(g[0]) for g in got])
                signs, instances = (np.concatenate([g[c] for g in got]) for c in (0, 1))
                bucket = bucket_of(instances, signs, first, slices)
                order = np.argsort(bucket, kind="stable")
                bucket, signs, owner = bucket[order], signs[order], owner[order]
                cuts = np.flatnonzero(np.diff(bucket)) + 1
                ids = np.array([i for i, _ in sets], "<i8")
                blobs = [pack(ids, signs[a:b], owner[a:b]) for a, b in zip(np.r_[0, cuts], np.r_[cuts, len(bucket)])]
                yield pa.RecordBatch.from_arrays([pa.array(bucket[np.r_[0, cuts]], pa.int64()), pa.array(blobs, pa.binary())], ["bucket", "blob"])

    return run


def pack_ids(ids: np.ndarray) -> bytes:
    """Sorted keys as compressed steps."""
    return zlib.compress(np.diff(ids, prepend=0).astype("<i8").tobytes(), 1)


def unpack_ids(packed: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(packed), "<i8"))


def pack(ids: np.ndarray, signs: np.ndarray, owner: np.ndarray) -> bytes:
    """Little-endian: numbers of signatures and of bytes of keys, the keys, then signatures and the places of their keys.

    32 bits of a signature do: a bucket holds few enough that chance meetings are rare, and all are verified.
    """
    used, local = np.unique(owner, return_inverse=True)
    keys = pack_ids(ids[used])
    return b"".join([np.array([len(signs), len(keys)], "<u4").tobytes(), keys, (signs >> np.uint64(32)).astype("<u4").tobytes(), local.astype("<u2").tobytes()])


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Signatures and their keys."""
    n, length = np.frombuffer(blob, "<u4", 2).tolist()
    ids = unpack_ids(blob[8 : 8 + length])
    return np.frombuffer(blob, "<u4", n, 8 + length), ids[np.frombuffer(blob, "<u2", n, 8 + length + 4 * n)]


FOUND = "first bigint, other bigint, list bigint, members binary"


def bucket_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket -> for the classes that share a signature: (first, other) once each, and lists of three or more."""

    def solve(blobs):
        signs, ids = (np.concatenate(c) for c in zip(*map(unpack, blobs)))
        order = np.lexsort((ids, signs))
        signs, ids = signs[order], ids[order]
        fresh = np.r_[True, (signs[1:] != signs[:-1]) | (ids[1:] != ids[:-1])]
        signs, ids = signs[fresh], ids[fresh]
        start = np.flatnonzero(np.r_[True, signs[1:] != signs[:-1]])
        size = np.diff(np.r_[start, len(signs)])
        name = np.add.reduceat(mix64(ids.view(np.uint64)), start).view(np.int64)  # of the list, whatever signature it shares
        several = np.flatnonzero(size > 1)
        several = several[np.unique(name[several], return_index=True)[1]]
        if not len(several):
            return
        start, size, name = start[several], size[several], name[several]
        first = np.repeat(ids[start], size - 1)
        other = ids[np.arange(len(first)) + np.repeat(start + 1 - (np.cumsum(size - 1) - (size - 1)), size - 1)]
        order = np.lexsort((other, first))
        first, other = first[order], other[order]
        fresh = np.r_[True, (first[1:] != first[:-1]) | (other[1:] != other[:-1])]
        yield pa.RecordBatch.from_arrays([pa.array(first[fresh]), pa.array(other[fresh]), pa.nulls(int(fresh.sum()), pa.int64()), pa.nulls(int(fresh.sum()), pa.binary())], ["first", "other", "list", "members"])
        longer = np.flatnonzero(size > 2)
        for at in range(0, len(longer), 5000):
            some = longer[at : at + 5000]
            blobs = [pack_ids(ids[start[i] : start[i] + size[i]]) for i in some]
            yield pa.RecordBatch.from_arrays([pa.array(ids[start[some]]), pa.nulls(len(some), pa.int64()), pa.array(name[some]), pa.array(blobs, pa.binary())], ["first", "other", "list", "members"])

    bucket, blobs = None, []
    for batch in batches:
        for at, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if at != bucket:
                if blobs:
                    yield from solve(blobs)
                bucket, blobs = at, []
            blobs.append(blob)
    if blobs:
        yield from solve(blobs)


class Sketches:
    """Sizes and parity sketches of some classes, at every width that a comparison needs."""

    def __init__(self, sizes: list[int], sketches: list[bytes]):
        self.sizes = np.array(sizes, np.int64)
        self.words = np.array([len(s) // 8 for s in sketches], np.int64)
        self.at: dict[int, np.ndarray] = {}
        self.rows: dict[int, np.ndarray] = {}
        own = {w: np.flatnonzero(self.words == w) for w in set(self.words.tolist())}
        native = {w: np.frombuffer(b"".join(sketches[i] for i in rows), "<u8").reshape(len(rows), w) for w, rows in own.items()}
        for w in own:  # similar sets are one width apart at most
            wide = 2 * w
            members = [own[w], *([own[wide]] if wide in own else [])]
            self.rows[w] = np.concatenate([native[w], *([fold(native[wide])] if wide in own else [])])
            place = np.full(len(sketches), -1, np.int64)
            place[np.concatenate(members)] = np.arange(len(self.rows[w]))
            self.at[w] = place

    def possible(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which pairs may be similar: their sizes and parities leave it open."""
        a, b = self.sizes[i], self.sizes[j]
        most = (a + b) * (DEN - NUM) // (DEN + NUM)
        width = np.minimum(self.words[i], self.words[j])
        ok = (np.abs(a - b) <= most) & (np.maximum(self.words[i], self.words[j]) <= 2 * width)
        for w in np.unique(width[ok]).tolist():
            rows = np.flatnonzero(ok & (width == w))
            step = max(1, 2_000_000 // w)
            for s in range(0, len(rows), step):
                r = rows[s : s + step]
                x = self.rows[w][self.at[w][i[r]]] ^ self.rows[w][self.at[w][j[r]]]
                ok[r] = np.bitwise_count(x).sum(axis=1, dtype=np.int64) <= most[r]
        return ok


def possible_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, n_a, n_b, sketch_a, sketch_b) -> pairs (a, b) that may be similar."""
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(c).to_pylist() for c in range(2, 6)]
        pairs = Sketches(columns[0] + columns[1], columns[2] + columns[3])
        n = batch.num_rows
        ok = pa.array(np.flatnonzero(pairs.possible(np.arange(n), np.arange(n) + n)), pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(ok), batch.column(1).take(ok)], ["a", "b"])


def across_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by first: (first, node, component, n, sketch) of its classes, then (first, members) of its lists -> pairs of different components that share a list and may be similar."""

    def solve(nodes, lists):
        ids = np.array([r[0] for r in nodes])
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        component = np.array([nodes[i][1] for i in order])
        sketches = Sketches([nodes[i][2] for i in order], [nodes[i][3] for i in order])
        n = len(ids)
        found = []

        def judge(i, j):
            i, j = np.minimum(i, j), np.maximum(i, j)
            ok = np.flatnonzero(component[i] != component[j])
            ok = ok[sketches.possible(i[ok], j[ok])]
            found.append(np.unique(i[ok] * n + j[ok]))

        for packed in lists:
            members = np.searchsorted(ids, unpack_ids(packed))
            kinds, counts = np.unique(component[members], return_counts=True)
            if len(kinds) < 2:
                continue
            largest = kinds[counts.argmax()]  # members of the largest component meet the others, the others all
            others = members[component[members] != largest]
            step = max(1, 1_000_000 // len(members))
            for at in range(0, len(others), step):
                some = others[at : at + step]
                judge(np.repeat(some, len(members)), np.tile(members, len(some)))
        if found:
            pairs = np.unique(np.concatenate(found))
            yield pa.RecordBatch.from_arrays([pa.array(ids[pairs // n]), pa.array(ids[pairs % n])], ["a", "b"])

    first, nodes, lists = None, [], []
    for batch in batches:
        for at, node, component, size, parities, members in zip(*(batch.column(c).to_pylist() for c in range(6))):
            if at != first:
                if lists:
                    yield from solve(nodes, lists)
                first, nodes, lists = at, [], []
            if members is None:
                nodes.append((node, component, size, parities))
            else:
                lists.append(members)
    if lists:
        yield from solve(nodes, lists)


def verify_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, text_a, text_b) -> the pairs that are similar."""
    memo = WordHashes()
    last: tuple = (None, None)
    for batch in batches:
        keep = []
        for r, (ta, tb) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
            if last[0] != ta:
                last = (ta, shingles(ta, memo))
            sa, sb = last[1], shingles(tb, memo)
            if not len(sa) or not len(sb):
                continue
            both = len(np.intersect1d(sa, sb, assume_unique=True))
            if DEN * both >= NUM * (len(sa) + len(sb) - both):
                keep.append(r)
        yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(keep, pa.int64())) for c in (0, 1)], ["a", "b"])


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """pairs (a, b) whose sets are similar."""
    needed = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    mine = written(texts.join(needed, "node", "left_semi"), "pair-texts")
    both = pairs.join(mine.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").join(mine.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    out = written(both.select("a", "b", "text_a", "text_b").mapInArrow(verify_batches, "a bigint, b bigint"), "links")
    discard(mine)
    return out


def similar_classes(classes: DataFrame, texts: DataFrame, sizes: dict[int, int]) -> DataFrame:
    """classes (node, n, sketch), texts (node, text) -> (node, component) of all classes that are similar to another one."""
    spark = classes.sparkSession
    n_sets = sum(sizes.values())
    share = min(1.0, SAMPLE_SETS / n_sets)
    sample = texts.where(F.pmod(F.xxhash64("node"), F.lit(1_000_003)) < F.lit(int(share * 1_000_003))).select("text")
    often = max(8.0, FREQUENT_SHARE * min(SAMPLE_SETS, n_sets))
    heavy = sample.mapInArrow(frequent_batches, "e bigint, n bigint").groupBy("e").agg(F.sum("n").alias("n")).where(F.col("n") >= often).select("e").toArrow()
    frequent = spark.sparkContext.broadcast(np.sort(heavy.column(0).to_numpy().astype(np.int64).view(np.uint64)))
    first, slices = dealing(sizes)
    blobs = texts.mapInArrow(signature_batches(frequent, first, slices), "bucket bigint, blob binary")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(slices.sum()))
    found = written(blobs.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(bucket_batches, FOUND), "set-meetings")
    meetings = written(found.where("other is not null").select(F.col("first").alias("a"), F.col("other").alias("b")).distinct(), "set-pairs")
    of = {x: classes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}")) for x in "ab"}
    both = meetings.join(of["a"], "a").join(of["b"], "b").select("a", "b", "n_a", "n_b", "s_a", "s_b")
    pairs = written(both.mapInArrow(possible_batches, "a bigint, b bigint"), "set-possible-pairs")
    # first the nearest few of each class: in a group of copies they connect nearly all
    nearest = pairs.groupBy("b").agg(F.slice(F.array_sort(F.collect_set("a")), 1, NEAREST).alias("few")).select(F.explode("few").alias("a"), "b")
    tried = written(nearest, "set-first-pairs")
    links = verified(tried, texts)
    roots = components(links)
    # then all that still lie in different components: single pairs, and pairs within lists
    where = {x: roots.select(F.col("node").alias(x), F.col("component").alias(f"c_{x}")) for x in "ab"}
    placed = written(meetings.join(where["a"], "a", "left").join(where["b"], "b", "left").select("a", "b", F.coalesce("c_a", "a").alias("c_a"), F.coalesce("c_b", "b").alias("c_b")), "set-placed")
    apart = pairs.join(placed.where("c_a <> c_b").select("a", "b"), ["a", "b"])
    lists = found.where("members is not null").groupBy("list").agg(F.first(F.struct("first", "members")).alias("l")).select("l.*")
    # a first class all of whose partners are in its component has no list that spans two
    open_ = written(placed.where("c_a <> c_b").select(F.col("a").alias("first")).distinct(), "set-open")
    wanted = written(lists.join(open_, "first", "left_semi"), "set-lists")
    spanning = wanted.select("first").distinct()
    partners = placed.withColumnRenamed("a", "first").join(spanning, "first", "left_semi")
    nodes = partners.select("first", F.col("b").alias("node"), F.col("c_b").alias("component")).union(partners.select("first", F.col("first").alias("node"), F.col("c_a").alias("component")).distinct())
    rows = nodes.join(classes.select("node", "n", "sketch"), "node").select("first", "node", "component", "n", "sketch", F.lit(None).cast("binary").alias("members"))
    blank = [F.lit(None).cast(t).alias(c) for c, t in (("node", "bigint"), ("component", "bigint"), ("n", "bigint"), ("sketch", "binary"))]
    work = rows.unionByName(wanted.select("first", *blank, "members")).withColumn("later", F.col("members").isNotNull())
    work = work.repartition("first").sortWithinPartitions("first", "later").drop("later")
    across = apart.unionByName(work.mapInArrow(across_batches, "a bigint, b bigint")).distinct().join(tried, ["a", "b"], "left_anti")
    across = written(across, "set-pairs-across")
    discard(found, meetings, pairs, tried, placed, open_, wanted)
    if across.limit(1).count():
        more = verified(across, texts)
        if more.limit(1).count():
            roots = components(links.unionByName(more))
    return roots


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_shingles, component_id, row (a hash of the text), kept.

    kept: the row is the smallest of its component, by key and ``row``; rows that
    repeat it in both are kept as it is. Null where a row can have no link.
    """
    kind = df.schema[key].dataType.simpleString()
    whole = F.col(text).cast("string")
    docs = df.select(F.col(key).cast("bigint").alias("id"), F.hash(whole).alias("row"), whole.alias("text"))
    digests = written(docs.mapInArrow(digest_batches, "id bigint, row int, n bigint, h1 bigint, h2 bigint, sketch binary"), "set-digests")
    usable = digests.where("id is not null and n > 0")
    grouped = usable.groupBy("h1", "h2").agg(F.min(F.struct("id", "row")).alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    # numbered in the order of keys: copies mostly follow what they were made from, so the first of a list is similar to most of it
    ordered = grouped.select("h1", "h2", F.col("rep.id").alias("id"), F.col("rep.row").alias("row"), "n", "sketch").orderBy("id", "row", "h1")
    classes = written(ordered.select(F.monotonically_increasing_id().alias("node"), "*"), "set-classes")
    sizes = {r["n"]: r["count"] for r in by_band(classes).collect()}  # as many rows as bands
    alone = digests.where("id is null or n = 0").select("id", "n", F.col("id").alias("component_id"), "row", F.lit(None).cast("boolean").alias("kept"))
    out = alone
    if sizes:
        # of rows that repeat key and text one is read, before they are shuffled
        once = docs.where("text is not null and id is not null").groupBy("id", "row").agg(F.first("text").alias("text"))
        texts = written(once.join(classes.select("id", "row", "node"), ["id", "row"]).select("node", "text"), "set-texts")
        roots = similar_classes(classes.select("node", "n", "sketch"), texts, sizes)
        placed = classes.join(roots, "node", "left").select("h1", "h2", "id", "row", F.coalesce("component", "node").alias("component"))
        placed = written(placed, "set-placed-classes")
        best = written(placed.groupBy("component").agg(F.min(F.struct("id", "row")).alias("best")), "set-best")
        of_set = written(placed.join(best, "component").select("h1", "h2", "best"), "set-components")
        linked = usable.join(of_set, ["h1", "h2"]).select("id", "n", F.col("best.id").alias("component_id"), "row", (F.struct("id", "row") == F.col("best")).alias("kept"))
        discard(texts, placed, best)
        out = linked.unionByName(alone)
    return out.select(F.col("id").cast(kind).alias(key), F.col("n").alias("n_shingles"), F.col("component_id").cast(kind).alias("component_id"), "row", "kept")


def by_band(classes: DataFrame) -> DataFrame:
    """Number of classes by size, sizes above ``SMALL`` rounded up within their band."""
    size = F.when(F.col("n") <= SMALL, F.col("n")).otherwise(F.ceil(F.pow(F.lit(1.05), F.ceil(F.log("n") / F.log(F.lit(1.05))))))
    return classes.groupBy(size.cast("bigint").alias("n")).count()
