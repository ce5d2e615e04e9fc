"""Near-duplicates by SuperMinHash: signatures, banding, verification on full sets, union-find grouping.

1. One pass gives each text its shingle set's size, a digest of the set, and a SuperMinHash signature cut into bands.
   SuperMinHash walks one random permutation of the slots per shingle; step j of the walk gives values in [j, j+1), so
   a text stops at the first step by which all its slots are filled. The walks of a batch of texts go side by side.
2. Texts of equal sets become one node (its least id), so exact copies never meet in a bucket.
3. Nodes that share a band are candidates. Stars from each bucket's least node join the buckets to candidate groups.
4. Each group's texts are gathered once and every pair that shares a bucket is confirmed on the full sets, by products
   of incidence matrices; linked nodes are merged by union-find. Pairs themselves are never rows.
5. A group beyond ``GROUP_ROWS`` or ``GROUP_SHINGLES`` is taken apart (``_large_groups``): its texts meet a bucket's hub in
   chunks, texts whose own shingles rule out any link are done, and the few others meet their bucket block by block, so
   memory stays bounded and no pair is left out. Links are joined by distributed connected components.

With 27 bands of 7 slots a pair at similarity 0.85 shares no band with a probability of 3e-5, at 0.95 of 1e-13.

Defined cases: null and empty texts, and those of white space only, have no shingles and are linked with nothing; fewer
words than a shingle make one shingle; rows of an equal id are texts of one document, which is linked with all that any of
them is (each row tells the size of its own set); a null id is linked with nothing but keeps its row: it takes no part in
classes, and its component is null or, for a text that others have too, theirs; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, mix, space_words, spread, tune, written
from .components import connected

#: Bands and slots of a band.
BANDS, SLOTS = 27, 7
#: Most texts and shingles that are compared in one piece.
GROUP_ROWS, GROUP_SHINGLES = 4096, 4_000_000

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """The sorted distinct 64-bit shingles of a text's word hashes; a shorter text is one shingle."""
    if not len(words):
        return np.zeros(0, np.uint64)
    n = min(size, len(words))
    h = np.full(len(words) - n + 1, n, np.uint64)
    for k in range(n):
        h = mix(h * _A + words[k : len(words) - n + 1 + k])
    return np.unique(h)


def signatures(elements: np.ndarray, owner: np.ndarray, sets: int, slots: int) -> np.ndarray:
    """SuperMinHash of several sets at once: (sets, slots) of values step * 2**40 + 40 random bits."""
    empty = np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.full(sets * slots, empty, np.uint64)
    swaps: list[np.ndarray] = []
    for j in range(slots):
        rng = mix(elements + np.uint64((j + 1) * int(_B) & 0xFFFFFFFFFFFFFFFF))
        k = (j + ((rng & np.uint64(0xFFFFFF)) * np.uint64(slots - j) >> np.uint64(24)).astype(np.int32)).astype(np.int32)
        slot = k.copy()
        for i in range(j - 1, -1, -1):  # what earlier swaps have put at position k
            slot[swaps[i] == slot] = i
        np.minimum.at(out, owner * slots + slot, (rng >> np.uint64(24)) | np.uint64(j << 40))
        swaps.append(k)
        open_sets = (out.reshape(sets, slots) == empty).any(1)
        keep = open_sets[owner]
        if not keep.any():
            break
        if not keep.all():
            elements, owner, swaps = elements[keep], owner[keep], [s[keep] for s in swaps]
    return out.reshape(sets, slots)


def bands_of(sigs: np.ndarray, bands: int, slots: int) -> np.ndarray:
    """(sets, bands) of 63-bit bucket keys."""
    rows = sigs.reshape(len(sigs), bands, slots)
    h = np.broadcast_to(np.arange(bands, dtype=np.uint64), rows.shape[:2]).copy()
    for k in range(slots):
        h = mix(h * _C + rows[:, :, k])
    return (h >> np.uint64(1)).astype(np.int64)


def linked(sets: list[np.ndarray], least: int) -> np.ndarray:
    """For each set the first set of its class under 100 * intersection >= least * union."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.float32)
    label = np.arange(n)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(n), sizes.astype(np.int64))
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.concatenate(([True], flat[1:] != flat[:-1]))
    column = np.cumsum(new) - 1
    shared = np.bincount(column) > 1  # a shingle of one set is in no intersection
    keep = shared[column]
    owner, column = owner[keep], (np.cumsum(shared) - 1)[column[keep]]
    common = np.zeros((n, n), np.float32)
    width = max(1, (1 << 22) // n)
    edges = np.searchsorted(column, np.arange(0, int(shared.sum()) + width, width))
    for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        if a < b:
            m = np.zeros((n, width), np.float32)
            m[owner[a:b], column[a:b] - i * width] = 1
            common += m @ m.T
    shared_by, whole = common.astype(np.int64), sizes.astype(np.int64)  # single floats tell whole numbers apart up to 2 ** 24, their hundredfolds not
    links = 100 * shared_by >= least * (whole[:, None] + whole[None, :] - shared_by)
    np.fill_diagonal(links, True)
    while True:
        low = np.array([label[row].min() for row in links])
        low = np.minimum(low, low[low])
        if (low == label).all():
            return label
        label = low


class Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def group_links(ids: list[int], sets: list[np.ndarray], keys: list[list[int]], least: int) -> list[tuple[int, int]]:
    """(id, least id of its class) for a group: every pair that shares a key is confirmed."""
    order = sorted(range(len(ids)), key=ids.__getitem__)
    ids, sets, keys = [ids[i] for i in order], [sets[i] for i in order], [keys[i] for i in order]
    u, buckets, done = Union(len(ids)), {}, set()
    for i in range(1, len(ids)):
        if ids[i] == ids[i - 1]:  # several texts of one document
            u.join(i - 1, i)
    for i, ks in enumerate(keys):
        for k in ks:
            buckets.setdefault(k, []).append(i)
    for members in sorted(map(tuple, buckets.values()), key=len, reverse=True):
        if len(members) < 2 or members in done or len({u.find(i) for i in members}) < 2:
            continue
        done.add(members)
        for i, first in zip(members, linked([sets[i] for i in members], least), strict=True):
            u.join(i, members[first])
    return sorted({(ids[i], ids[r]) for i in range(len(ids)) if ids[r := u.find(i)] != ids[i]})


def _blocks(count: Column, weight: Column, rows: int, shingles: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(count / rows), F.ceil(weight / shingles)).cast("int")


def _large_groups(members: DataFrame, texts: DataFrame, links_in: Callable[[DataFrame], DataFrame], size: int, least: int, rows: int, shingles_: int) -> DataFrame:
    """(node, component) of groups too large for one piece. members: (key, node, n, members, small, weight, ...) of their buckets.

    First each bucket's members are compared, in chunks, with its hub, the member that shares most; that takes time in
    proportion to the group and joins most of it. What can still be unlinked wrongly are members outside a bucket's main
    class. Of these, most are ruled out for good by a bound: a text with f shingles that no other text of the large
    groups has shares at most n - f with another. The few that are left are compared with all of the bucket, block by block.
    """
    popular = members.groupBy("node").agg(F.sum("members").alias("popular"))
    hubs = written(members.join(popular, "node").groupBy("key").agg(F.max_by("node", F.struct("popular", -F.col("node"))).alias("hub")))
    around = written(members.join(hubs, "key").select("node", "n", "hub").distinct())
    chunks = around.groupBy("hub").agg(_blocks(F.count("*"), F.sum("n"), rows, shingles_).alias("chunks"))
    spokes = around.join(chunks, "hub").select("node", "hub", F.pmod(F.xxhash64("node", F.lit(3)), F.col("chunks")).alias("chunk"))
    group = F.xxhash64("hub", "chunk").alias("group")
    first = links_in(spokes.select("node", group).union(spokes.select(F.col("hub").alias("node"), group)))
    classes = written(connected(first, "a", "b"))
    told = written(members.join(classes, "node", "left").withColumn("class", F.coalesce("component", "node")).drop("component"))
    main = told.groupBy("key", "class").agg(F.count("*").alias("n_class")).groupBy("key").agg(F.max_by("class", F.struct("n_class", -F.col("class"))).alias("main"), F.count("*").alias("classes"))
    open_keys = written(told.join(written(main.filter("classes > 1")), "key"))

    def shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            sets = [shingles(hashes.of(space_words(t)), size) for t in b.column(1).to_pylist()]
            owner = np.repeat(np.asarray(b.column(0)), [len(x) for x in sets])
            yield pa.RecordBatch.from_arrays([pa.array(owner, pa.int64()), pa.array(np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64))], names=["node", "s"])

    own = texts.join(members.select("node").distinct(), "node", "left_semi").select("node", "text").mapInArrow(shingle_rows, "node long, s long")
    alone = own.groupBy("s").agg(F.min("node").alias("node"), F.max("node").alias("other")).filter("node = other").groupBy("node").agg(F.count("*").alias("f"))
    most = F.col("n") - F.coalesce("f", F.lit(0))
    may_link = 100 * most >= least * (F.col("n") + F.greatest(most, F.col("small")) - most)
    outside = written(open_keys.filter("class <> main").join(alone, "node", "left").filter(may_link).select("key", "node", "n"))
    counts = outside.groupBy("key").agg(_blocks(F.count("*"), F.sum("n"), rows, shingles_).alias("left"))
    left = outside.join(counts, "key").join(open_keys.select("key", "members", "weight").distinct(), "key")
    right = open_keys.join(counts, "key")
    right_blocks = _blocks(F.col("members"), F.col("weight"), rows, shingles_)

    def block(salt: int, blocks: Column) -> Column:
        return F.pmod(F.xxhash64("node", F.lit(salt)), blocks)

    pairs = left.select("node", F.explode(F.transform(F.sequence(F.lit(0), right_blocks - 1), lambda j: F.xxhash64("key", block(5, F.col("left")), j.cast("long")))).alias("group"))
    pairs = pairs.union(right.select("node", F.explode(F.transform(F.sequence(F.lit(0), F.col("left") - 1), lambda i: F.xxhash64("key", i.cast("long"), block(7, right_blocks)))).alias("group")))
    return connected(first.union(links_in(pairs)), "a", "b")


def near_duplicates(docs: DataFrame, size: int = 5, least: int = 80, bands: int = BANDS, slots: int = SLOTS, group_rows: int = GROUP_ROWS, group_shingles: int = GROUP_SHINGLES) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept); texts with 100 * intersection >= least * union of their shingles are linked."""
    tune(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text")

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen = WordHashes(), set()
        for b in batches:
            sets = [shingles(hashes.of(space_words(t)), size) for t in b.column(1).to_pylist()]
            prints = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            # of equal sets of a partition, the first row's bands are enough
            which = [i for i, p in enumerate(prints) if p is not None and p not in seen and (len(seen) < 500_000) and not seen.add(p)]
            rest = [i for i, p in enumerate(prints) if p is not None and len(seen) >= 500_000 and p not in seen]
            which = sorted({*which, *rest})
            found: list = [None] * len(sets)
            if which:
                sizes = np.array([len(sets[i]) for i in which])
                keys = bands_of(signatures(np.concatenate([sets[i] for i in which]), np.repeat(np.arange(len(which)), sizes), len(which), bands * slots), bands, slots)
                for i, k in zip(which, keys, strict=True):
                    found[i] = k
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(prints, pa.binary()), pa.array(found, pa.list_(pa.int64()))], names=["id", "n", "print", "keys"])

    signed = written(spread(texts).mapInArrow(sign, "id long, n long, print binary, keys array<long>"))
    nodes = written(signed.filter("print is not null and id is not null").groupBy("print").agg(F.min("id").alias("node"), F.max("n").alias("n"), F.first("keys", ignorenulls=True).alias("keys")))
    rows = nodes.select("node", "n", F.explode("keys").alias("key"))
    stars = written(rows.groupBy("key").agg(F.countDistinct("node").alias("members"), F.min("node").alias("center"), F.min("n").alias("small"), F.sum("n").alias("weight")).filter("members > 1"))
    members = written(rows.join(stars, "key"))
    groups = written(connected(members.select("node", "center").distinct(), "node", "center"))
    sized = written(groups.join(nodes.select("node", "n"), "node").groupBy("component").agg(F.count("*").alias("members"), F.sum("n").alias("weight")))
    whole = (F.col("members") <= group_rows) & (F.col("weight") <= group_shingles)
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    given = texts.filter("id is not null and text is not null").withColumnRenamed("id", "node")

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        held: dict[tuple[int, bytes], tuple[np.ndarray, set[int]]] = {}
        now = None

        def told() -> pa.RecordBatch:
            found = group_links([n for n, _ in held], [s for s, _ in held.values()], [sorted(k) for _, k in held.values()], least)
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["a", "b"])

        for batch in batches:
            for g, node, text, keys in zip(*(batch.column(i) for i in range(4)), strict=True):
                g = g.as_py()
                if g != now:
                    if held:
                        yield told()
                    now, held = g, {}
                node = node.as_py()
                s = shingles(hashes.of(space_words(text.as_py())), size)
                if len(s):
                    held.setdefault((node, s.tobytes()), (s, set()))[1].update(keys.as_py())
        if held:
            yield told()

    def links_in(asked: DataFrame) -> DataFrame:
        """The links (a, b) inside groups of asked(node, group); a group's texts are in one partition, one group after another."""
        keyed = written(asked.distinct()).join(nodes.select("node", "keys"), "node")
        gathered = keyed.join(given, "node").repartition(parts, "group").sortWithinPartitions("group").select("group", "node", "text", "keys")
        return written(gathered.mapInArrow(confirm, "a long, b long"))

    label = links_in(groups.join(sized.filter(whole), "component").select("node", F.xxhash64("component").alias("group"))).select(F.col("a").alias("node"), F.col("b").alias("component"))
    large = groups.join(sized.filter(~whole).select("component"), "component").select("node")
    if large.limit(1).count():
        label = label.union(_large_groups(written(members.join(large, "node", "left_semi")), given, links_in, size, least, max(1, group_rows // 4), max(1, group_shingles // 4)))
    label = written(label)
    # documents of several texts with different sets join these sets' classes
    several = signed.filter("print is not null and id is not null").groupBy("id").agg(F.min("print").alias("p"), F.max("print").alias("q")).filter("p <> q").select("id")
    if several.limit(1).count():
        ends = written(signed.join(several, "id").join(nodes.select("print", "node"), "print").select("id", "node").distinct())
        label = written(connected(label.select("node", F.col("component").alias("b")).union(ends.join(ends.groupBy("id").agg(F.min("node").alias("b")), "id").select("node", "b")), "node", "b"))
    by_print = written(nodes.select("print", "node").join(label, "node", "left").select("print", F.coalesce("component", "node").alias("component_id")))
    # texts without a print take no part in the join, in which they would all meet in one task
    out = signed.filter("print is not null").select("id", "n", "print").join(by_print, "print", "left").select("id", "n", "component_id").union(signed.filter("print is null").select("id", "n", F.lit(None).cast("long")))
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def representatives(docs: DataFrame, **how) -> DataFrame:
    """The rows, with all their columns, less those of a near-duplicate class's other documents."""
    found = near_duplicates(docs, **how)
    gone = found.filter("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, F.col("doc_id").cast("long") == F.col("_gone"), "left_anti")
