"""N-gram Jaccard join: documents whose word-shingle sets overlap enough, and the groups they form.

Size-aware heavy-light join over distinct sets.  Small (light) sets enumerate their subsets of fixed sizes: two that
share one overlap by at least its size, so they link without another look.  Large (heavy) sets are found by scanning
inverted lists over the rarest shingles of each set, and pairs are then verified on whole sets.  The border between
the two is chosen by cost from the sizes at hand.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb, isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, SideTable, by_block, hot_join, mix, placed, prefix_hashes, scanned, slices, small_batches, span_hashes, word_spans, written
from .components import connected_components

#: Counters of the shingle frequency sketch: 2 MB, whatever the corpus.
SKETCH = 1 << 20
#: In place of a null doc_id, which comes after all others.
LAST_ID = 2**63 - 1
#: About as many sets, and members of sets, lie in one block of a component when its links are counted.
BLOCK_SETS, BLOCK_MEMBERS = 200, 150_000


class Likeness:
    """Jaccard of at least num/den over k-word shingles, in whole numbers."""

    def __init__(self, num: int = 90, den: int = 100, k: int = 3):
        self.num, self.den, self.k = num, den, k

    def least_own(self, n: int) -> int:
        """Shingles of a set of n that any partner shares at least."""
        return -(-self.num * n // self.den)

    def least_even(self, n: int) -> int:
        """Shingles that a set of n shares at least with a partner of n or more."""
        return -(-2 * self.num * n // (self.num + self.den))

    def linked(self, overlap: Column, a: Column, b: Column) -> Column:
        return self.den * overlap >= self.num * (a + b - overlap)

    def subset_sizes(self, n: int) -> range:
        """The sizes of subsets that a light set enumerates."""
        return range(self.least_own(n), n + 1)

    def subset_count(self, n: int) -> int:
        return sum(comb(n, c) for c in self.subset_sizes(n))


def shingle_sets(raw: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, second hashes, n+1 offsets) of each text's distinct shingles, sorted by the first: k consecutive words,
    or the whole of a shorter text.

    The first hash has 61 bits modulo a prime and stands for the shingle; two of up to 1,000 bytes are taken for the
    same with a chance of 1,000 / 2^61.  The second, of another base, goes into the names of sets, so two different
    sets share a name with the square of that chance.
    """
    low = LOWER[raw]
    starts, ends, first = word_spans(low, off)
    texts = len(off) - 1
    words = np.diff(first)
    count = np.where(words >= k, words - k + 1, np.minimum(words, 1))
    bounds = np.concatenate([[0], np.cumsum(count)])
    owner = np.repeat(np.arange(texts), count)
    at = first[owner] + np.arange(bounds[-1]) - bounds[owner]
    length = np.minimum(words[owner], k)
    both = []
    for lane in (0, 1):
        h = span_hashes(prefix_hashes(low, lane), starts, ends, lane)
        value = length.astype(np.uint64)
        for j in range(k):
            more = j < length
            value[more] = mix(value[more] * np.uint64(0x9FB21C651E98DF25) + h[at[more] + j])
        both.append(value)
    order = np.lexsort((both[0], owner))
    value, again, owner = both[0][order], both[1][order], owner[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    value, again, owner = value[new], again[new], owner[new]
    return value, again, np.searchsorted(owner, np.arange(texts + 1))


def set_names(value: np.ndarray, again: np.ndarray, bounds: np.ndarray) -> list[bytes | None]:
    """A 128-bit name for each set from its size and a sum over each hash of its members; None for an empty set."""
    n = np.diff(bounds)
    total = np.zeros((2, len(value) + 1), np.uint64)
    np.cumsum(mix(value ^ np.uint64(0x5851F42D4C957F2D)), out=total[0, 1:])
    np.cumsum(mix(again + np.uint64(0x14057B7EF767814F)), out=total[1, 1:])
    a = mix(total[0, bounds[1:]] - total[0, bounds[:-1]] + n.astype(np.uint64))
    b = mix(total[1, bounds[1:]] - total[1, bounds[:-1]])
    joined = np.stack([a, b], 1).tobytes()
    return [joined[16 * i : 16 * i + 16] if n[i] else None for i in range(len(n))]


_META = "doc_id long, block long, ord int, n long, name binary, signature binary, sketch binary"
_META_TYPES = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]


def _sizes(k: int):
    """Task: each text's set size, name and signature, and the task's frequency sketch in its last row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _META.split(", ")]
        sketch = np.zeros(SKETCH, np.uint32)
        for batch in batches:
            for part, raw, off in slices(batch, "text"):
                value, again, bounds = shingle_sets(raw, off, k)
                np.add.at(sketch, (value & np.uint64(SKETCH - 1)).astype(np.int64), 1)
                cells = [np.diff(bounds), set_names(value, again, bounds), _signature(value, bounds), [None] * part.num_rows]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names[:3]), *(pa.array(c, t) for c, t in zip(cells, _META_TYPES[3:]))], names=names)
        packed = np.minimum(sketch, 255).astype(np.uint8).tobytes()
        yield pa.RecordBatch.from_arrays([*(pa.nulls(1, t) for t in _META_TYPES[:-1]), pa.array([packed], pa.binary())], names=names)

    return run


def _add_sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task: its sketches as one, each counter stopped at 65535 (an order of rarity needs no more)."""
    total = None
    for batch in batches:
        for cell in batch.column("sketch"):
            data = cell.as_py()
            part = np.frombuffer(data, np.uint8 if len(data) == SKETCH else np.uint16)
            total = part.astype(np.uint32) if total is None else np.minimum(total + part, 65535)
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.astype(np.uint16).tobytes()], pa.binary())], names=["sketch"])


def _signature(value: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """Members per hash bucket, 128 counters of a byte: their differences bound the symmetric difference from below."""
    texts = len(bounds) - 1
    owner = np.repeat(np.arange(texts), np.diff(bounds))
    cell = owner * 128 + (value >> np.uint64(57)).astype(np.int64)
    table = np.minimum(np.bincount(cell, minlength=texts * 128), 255).astype(np.uint8).tobytes()
    return [table[128 * i : 128 * i + 128] for i in range(texts)]


class _Wanted:
    """The rows of each block that stand for a class, by their numbers; loaded when a block's first row comes."""

    def __init__(self, side: SideTable):
        self.side, self.block, self.ords, self.cids = side, None, None, None

    def of(self, same: pa.RecordBatch) -> tuple[pa.RecordBatch, np.ndarray]:
        """(the wanted rows, their classes) of rows of one block."""
        block = same.column("block")[0].as_py()
        if block != self.block:
            t = self.side.load(block)
            ords, cids = (np.asarray(t.column(c)) for c in ("ord", "cid")) if t else (np.zeros(0, np.int32), np.zeros(0, np.int64))
            order = np.argsort(ords)
            self.block, self.ords, self.cids = block, ords[order], cids[order]
        mine = np.asarray(same.column("ord"))
        at = np.searchsorted(self.ords, mine)
        found = np.zeros(len(mine), bool)
        inside = at < len(self.ords)
        found[inside] = self.ords[at[inside]] == mine[inside]
        return same.filter(pa.array(found)), self.cids[at[found]]


def _wanted_sets(batches: Iterator[pa.RecordBatch], side: SideTable, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(classes, members, n+1 bounds) of the wanted rows; only their texts are cut into shingles."""
    wanted = _Wanted(side)
    for batch in batches:
        for same in by_block(batch):
            rows, cids = wanted.of(same)
            done = 0
            for part, raw, off in slices(rows, "text") if len(cids) else ():
                value, _, bounds = shingle_sets(raw, off, k)
                yield cids[done : done + part.num_rows], value, bounds
                done += part.num_rows


def _keys(side: SideTable, sketch, like: Likeness, border: int):
    """Task: the keys under which the split's classes are looked for.

    light: (hash of a subset, its size c); heavy: (a shingle of the prefix, c = 0).  pos: rank of the shingle in the
    set from rare to frequent; own: whether it also lies in the shorter prefix that a smaller partner needs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = np.frombuffer(sketch.value, np.uint16)
        heavy_from = like.least_own(border + 1)
        names = ["key", "c", "cid", "n", "pos", "own"]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.bool_()]
        for cid, value, bounds in _wanted_sets(batches, side, like.k):
            n = np.diff(bounds)
            owner = np.repeat(np.arange(len(cid)), n)
            rank = often[(value & np.uint64(SKETCH - 1)).astype(np.int64)]
            value = value[np.lexsort((value, rank, owner))]
            pos = np.arange(len(value)) - bounds[owner]
            long = n + like_neg(like.num, like.den, n) + 1
            short = n + like_neg(2 * like.num, like.num + like.den, n) + 1
            long = np.where(n > border, long, short)
            use = (pos < long[owner]) & (n[owner] >= heavy_from)
            o = owner[use]
            cols = [value[use].view(np.int64), np.zeros(len(o), np.int32), cid[o], n[o], pos[use], pos[use] < short[o]]
            light = [(k, c, cid[i], n[i]) for i in np.flatnonzero(n <= border).tolist() for k, c in subsets(value[bounds[i] : bounds[i + 1]], like)]
            if light:
                k, c, i, m = zip(*light)
                extra = [np.array(k, np.uint64).view(np.int64), np.array(c), np.array(i), np.array(m), np.zeros(len(k), int), np.ones(len(k), bool)]
                cols = [np.concatenate([a, b]) for a, b in zip(cols, extra)]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, kinds)], names=names)

    return run


def like_neg(num: int, den: int, n: np.ndarray) -> np.ndarray:
    """Minus the ceiling of num * n / den."""
    return (-num * n) // den


def subsets(value: np.ndarray, like: Likeness) -> Iterator[tuple[int, int]]:
    """(hash, size) of every subset that a light set enumerates: all that leave out as many members as a link may."""
    members = [int(x) for x in mix(value ^ np.uint64(0x2545F4914F6CDD1D))]
    whole = sum(members)
    for c in like.subset_sizes(len(members)):
        for left in combinations(members, len(members) - c):
            yield (whole - sum(left)) & (2**64 - 1), c


def _sets(side: SideTable, like: Likeness):
    """Task: (cid, n, members) of the wanted classes of the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cid, value, bounds in _wanted_sets(batches, side, like.k):
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(value.view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(cid, pa.int64()), pa.array(np.diff(bounds), pa.int64()), lists], names=["cid", "n", "members"])

    return run


def _near(like: Likeness):
    """Task: pairs whose signatures leave a link possible."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, 128).astype(np.int16) for c in ("sig_a", "sig_b"))
            apart = np.abs(x - y).sum(1)
            both = np.asarray(batch.column("n_a")) + np.asarray(batch.column("n_b"))
            # symmetric difference d and overlap (both - d) / 2: num * (both + d) <= den * (both - d)
            kept = apart * (like.num + like.den) <= both * (like.den - like.num)
            yield batch.select(["a", "b"]).filter(pa.array(kept))

    return run


def _verified(pairs: DataFrame, classes: DataFrame, rows: DataFrame, like: Likeness) -> tuple[DataFrame, DataFrame | None]:
    """The linked ones of distinct candidate pairs (a, b), first by signature, then on whole sets; and those sets.

    Whole sets are large, so only those of pairs that pass the signatures are made, in one more scan.
    """
    sig = classes.select("cid", "n", "signature")
    x = pairs.join(sig.toDF("a", "n_a", "sig_a"), "a").join(sig.toDF("b", "n_b", "sig_b"), "b")
    close = written(x.mapInArrow(_near(like), "a long, b long"), "jaccard")
    if close.isEmpty():
        return close, None
    wanted = close.select(F.explode(F.array("a", "b")).alias("cid")).distinct()
    need = SideTable(classes.join(wanted, "cid").select("block", "ord", "cid"), "jaccard")
    whole = written(rows.mapInArrow(_sets(need, like), "cid long, n long, members array<long>"), "jaccard")
    y = close.join(whole.toDF("a", "n_a", "set_a"), "a").join(whole.toDF("b", "n_b", "set_b"), "b")
    return y.where(like.linked(F.size(F.array_intersect("set_a", "set_b")), F.col("n_a"), F.col("n_b"))).select("a", "b"), whole


def _overlaps(value: np.ndarray, n: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Members that each set of ``a`` shares with each of ``b`` (numbers of sets that lie end to end, of sizes ``n``)."""
    owner = np.repeat(np.arange(len(n)), n)
    _, ids, often = np.unique(value, return_inverse=True, return_counts=True)
    shared = often > 1
    use = shared[ids]
    ids, owner = (np.cumsum(shared) - 1)[ids[use]], owner[use]
    order = np.argsort(ids, kind="stable")
    ids, owner = ids[order], owner[order]
    found = np.zeros((len(a), len(b)), np.int64)
    for low in range(0, int(shared.sum()), 8192):  # so many distinct members at a time
        i, j = np.searchsorted(ids, [low, low + 8192])
        held = np.zeros((len(n), 8192), np.float32)
        held[owner[i:j], ids[i:j] - low] = 1
        found += (held[a] @ held[b].T).astype(np.int64)
    return found


def _count_links(like: Likeness):
    """Group: one pair of blocks of a component; links of each set to those of the other block (or of its own)."""

    def run(table: pa.Table) -> pa.Table:
        members = table.column("members").combine_chunks()
        n, side, cid = (table.column(c).to_numpy() for c in ("n", "side", "cid"))
        own = not side.any()
        a = np.arange(len(n)) if own else np.flatnonzero(side == 0)
        b = a if own else np.flatnonzero(side == 1)
        o = _overlaps(members.flatten().to_numpy(zero_copy_only=False), n, a, b)
        linked = like.den * o >= like.num * (n[a][:, None] + n[b][None, :] - o)
        if own:
            np.fill_diagonal(linked, False)
            return pa.table({"cid": cid, "links": linked.sum(1).astype(np.int64)})
        return pa.table({"cid": np.concatenate([cid[a], cid[b]]), "links": np.concatenate([linked.sum(1), linked.sum(0)]).astype(np.int64)})

    return run


def count_links(groups: DataFrame, sets: DataFrame, like: Likeness) -> DataFrame:
    """(cid, links): the exact number of linked sets of each set in a component of three or more.

    Linked sets lie in one component, so all pairs of a component are compared, each once.  A component that is too
    large for one block is cut by size, where only equal and neighbouring bands can link, and by a hash within a band;
    each pair of blocks is a group of its own, so a large component is spread over many tasks.
    """
    known = written(groups.join(sets.select("cid", "n"), "cid"), "jaccard")
    total = written(known.groupBy("component").agg(F.count("*").alias("many"), F.sum("n").alias("held")), "jaccard")
    known = hot_join(known, total, ["component"], "many").where("many > 2")
    small = (F.col("many") <= BLOCK_SETS) & (F.col("held") <= BLOCK_MEMBERS)
    width = float(np.log(like.den / like.num)) * (1 + 1e-6) + 1e-6  # linked sizes are at most one band apart
    band = F.when(small, F.lit(0).cast("long")).otherwise(F.floor(F.log(F.col("n").cast("double")) / width).cast("long")).alias("band")
    sizes = written(known.select("component", "cid", "n", band), "jaccard")
    slots = F.ceil(F.greatest(F.count("*") / BLOCK_SETS, F.sum("n") / BLOCK_MEMBERS)).cast("int").alias("slots")
    cells = written(sizes.groupBy("component", "band").agg(slots, F.count("*").alias("many")), "jaccard")
    above = cells.select("component", (F.col("band") - 1).alias("band"), F.col("slots").alias("above"))
    below = cells.select("component", (F.col("band") + 1).alias("band"), F.col("slots").alias("below"))
    around = cells.join(above, ["component", "band"], "left").join(below, ["component", "band"], "left").na.fill(0, ["above", "below"])
    held = sets.select("cid", "members").join(hot_join(sizes, written(around, "jaccard"), ["component", "band"], "many"), "cid")
    slot = F.pmod(F.xxhash64("cid"), "slots").cast("int")
    held = held.withColumn("slot", slot)

    def pairs(many: str, pair) -> Column:
        return F.when(F.col(many) > 0, F.transform(F.sequence(F.lit(0), F.col(many) - 1), pair)).otherwise(F.array().cast("array<struct<low:bigint,x:int,y:int,side:int>>"))

    def pair(low: Column, x: Column, y: Column, side: Column) -> Column:
        return F.struct(low.alias("low"), x.cast("int").alias("x"), y.cast("int").alias("y"), side.cast("int").alias("side"))

    # within the band, x <= y; with the band above, x is this one's block and y, counted from slots on, the other's
    within = pairs("slots", lambda k: pair(F.col("band"), F.least("slot", k), F.greatest("slot", k), (F.col("slot") > k).cast("int")))
    up = pairs("above", lambda k: pair(F.col("band"), F.col("slot"), F.col("slots") + k, F.lit(0)))
    down = pairs("below", lambda k: pair(F.col("band") - 1, k, F.col("below") + F.col("slot"), F.lit(1)))
    dealt = held.select("component", "cid", "n", "members", F.explode(F.concat(within, up, down)).alias("p")).select("component", "cid", "n", "members", "p.*")
    return dealt.groupBy("component", "low", "x", "y").applyInArrow(_count_links(like), "cid long, links long").groupBy("cid").agg(F.sum("links").alias("links"))


def choose_border(sizes: dict[int, int], like: Likeness, most: int = 40) -> int:
    """The size up to which enumerating subsets costs less than scanning lists, from counts of sets by size.

    A subset costs one key.  A heavy set costs the keys of its prefix, each with a list to scan and a share of the
    verification, which reads the whole set.
    """

    def cost(border: int) -> int:
        light = sum(c * like.subset_count(n) for n, c in sizes.items() if n <= border)
        heavy = sum(c * ((n - like.least_own(n) + 1) * 4 + n) for n, c in sizes.items() if n >= like.least_own(border + 1) and n <= most)
        return light + heavy

    return min(range(0, most + 1), key=cost)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def group_classes(rows: DataFrame, like: Likeness, links: bool = False) -> tuple[DataFrame, DataFrame]:
    """(meta, classes): each row's set by name, and each distinct set with its component, and n_links where asked for.

    Every key's list is joined to one pivot first, its member with the rarest rank; what the pivots leave apart is then
    compared within each list, so a group of copies costs one pair a member and no link is lost.
    """
    spark = rows.sparkSession
    small_batches(spark)
    meta = written(rows.mapInArrow(_sizes(like.k), _META), "jaccard")
    sketches = meta.where("sketch is not null").select("sketch")
    fan = max(1, isqrt(sketches.count()))  # a tree of two levels: no task reads more than the root of their number
    sketches = sketches.repartition(fan).mapInArrow(_add_sketches, "sketch binary").repartition(1).mapInArrow(_add_sketches, "sketch binary").first()
    sketch = spark.sparkContext.broadcast(sketches.sketch if sketches else bytes(2 * SKETCH))
    meta = meta.where("sketch is null").drop("sketch")
    classes = written(
        meta.where("name is not null").groupBy("name", "n").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(LAST_ID)).alias("low"), "block", "ord", "signature")).alias("first")).select("name", "n", "first.*", F.monotonically_increasing_id().alias("cid")),
        "jaccard",
    )
    border = choose_border({r.n: r["count"] for r in classes.where("n <= 40").groupBy("n").count().collect()}, like)
    side = SideTable(classes.select("block", "ord", "cid"), "jaccard")
    keys = written(rows.mapInArrow(_keys(side, sketch, like, border), "key long, c int, cid long, n int, pos int, own boolean"), "jaccard")
    # every key that two classes share, with its pivot
    pivots = keys.groupBy("key", "c").agg(F.min(F.struct("pos", "n", "cid")).alias("pivot"), F.count("*").alias("many")).where("many > 1")
    pivots = written(pivots.select("key", "c", F.col("pivot.cid").alias("pivot"), F.col("pivot.n").alias("pivot_n"), "many"), "jaccard")
    lists = written(hot_join(keys, pivots, ["key", "c"], "many").drop("many"), "jaccard")

    def sized(a: str, b: str) -> Column:
        return F.least(a, b) * like.den >= F.greatest(a, b) * like.num

    ordered = [F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")]
    stars = lists.where("cid <> pivot").where(sized("n", "pivot_n")).select(F.col("cid").alias("a"), F.col("pivot").alias("b")).select(*ordered).distinct()
    first, sets = _verified(stars, classes, rows, like)
    first = written(first, "jaccard")
    groups = connected_components(first)
    # what the pivots left apart: heavy lists only, since a light key's smallest member links with all that link there
    placed = lists.where("c = 0").join(groups.withColumnsRenamed({"node": "cid", "component": "group"}), "cid", "left").withColumn("group", F.coalesce("group", "cid"))
    home = placed.where("cid = pivot").select("key", F.col("group").alias("home"))
    apart = placed.join(home, "key").where("group <> home").drop("home")
    x, y = (t.select("key", *[F.col(c).alias(f"{c}_{s}") for c in ("cid", "n", "pos", "own", "group")]) for t, s in ((apart, "a"), (placed, "b")))
    need_overlap = F.ceil((F.col("n_a") + F.col("n_b")) * like.num / (like.num + like.den) - 1e-9)
    possible = (
        (F.col("group_a") != F.col("group_b"))
        & sized("n_a", "n_b")
        & F.when(F.col("n_a") < F.col("n_b"), F.col("own_a")).when(F.col("n_a") > F.col("n_b"), F.col("own_b")).otherwise(F.col("own_a") & F.col("own_b"))
        & (F.least(F.col("n_a") - F.col("pos_a"), F.col("n_b") - F.col("pos_b")) >= need_overlap)
    )
    rest = x.join(y, "key").where(possible).select(F.col("cid_a").alias("a"), F.col("cid_b").alias("b")).select(*ordered).distinct()
    second, more = _verified(rest.join(stars, ["a", "b"], "left_anti"), classes, rows, like)
    edges = written(first.unionByName(written(second, "jaccard")), "jaccard")
    final = connected_components(edges).toDF("cid", "component")
    named = classes.select("cid", "name", "n", "low", "block", "ord").join(final, "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    if links:
        # in a component of two the one edge is all; larger ones are counted
        n_links = edges.select(F.explode(F.array("a", "b")).alias("cid")).groupBy("cid").agg(F.count("*").alias("n_links"))
        if sets is not None or more is not None:
            both = more if sets is None else sets if more is None else sets.unionByName(more.join(sets.select("cid"), "cid", "left_anti"))
            n_links = n_links.join(count_links(written(final, "jaccard"), both, like), "cid", "left").select("cid", F.coalesce("links", "n_links").alias("n_links"))
        named = named.join(n_links, "cid", "left")
    lowest = named.groupBy("component").agg(F.min("low").alias("component_id"))
    return meta, named.join(lowest, "component")


def jaccard_components(docs: DataFrame, like: Likeness | None = None) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, n_links.

    component_id is the smallest doc_id reachable over links, the document's own included; n_links counts the
    different sets that the document's set is linked with, all of them (equal sets are one).

    Documents of equal sets are one class, and only classes are compared (``group_classes``).  Null and empty texts have no shingles and are linked with
    nothing; repeated rows are equal sets; a null doc_id takes part but is no component's name unless alone; extra
    columns are ignored; an empty table gives an empty result.
    """
    meta, classes = group_classes(placed(scanned(_texts(docs), "jaccard")), like or Likeness(), links=True)
    answer = classes.select("name", "n", F.nullif("component_id", F.lit(LAST_ID)).alias("component_id"), "n_links")
    return meta.join(answer, ["name", "n"], "left").select(
        "doc_id",
        F.coalesce("n", F.lit(0).cast("long")).alias("n_shingles"),
        F.coalesce("component_id", "doc_id").alias("component_id"),
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
    )


def _keepers(side: SideTable, columns: list[str], block: str, number: str):
    """Task: the rows of each block that the side table names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_block, ords = None, None
        for batch in batches:
            for same in by_block(batch, block):
                if (now := same.column(block)[0].as_py()) != at_block:
                    at_block, t = now, side.load(now)
                    ords = t.column("ord").combine_chunks() if t else pa.array([], pa.int32())
                yield same.select(columns).filter(pc.is_in(same.column(number), ords))

    return run


def keep_one_of_each(docs: DataFrame, like: Likeness) -> DataFrame:
    """The documents with one row of each component left, that of its smallest doc_id; columns as they came.

    Rows without shingles all stay.  Of rows that repeat a doc_id and its set one stays.
    """
    docs = scanned(docs, "jaccard")
    meta, classes = group_classes(placed(_texts(docs)), like)
    first = classes.groupBy("component").agg(F.min(F.struct("low", "name", "block", "ord")).alias("kept")).select("kept.block", "kept.ord")
    side = SideTable(first.unionByName(meta.where("name is null").select("block", "ord")), "jaccard")
    free = "_"
    while any(c.startswith(free) for c in docs.columns):
        free += "_"
    held = placed(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")))
    flat = held.select("row.*", F.col("block").alias(f"{free}block"), F.col("ord").alias(f"{free}ord"))
    return flat.mapInArrow(_keepers(side, docs.columns, f"{free}block", f"{free}ord"), docs.schema)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each group over five-word shingles at a Jaccard of 0.8."""
    return keep_one_of_each(docs, Likeness(80, 100, 5))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's group over three-word shingles at a Jaccard of 0.9."""
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: The same in plain SQL: all pairs that share a shingle, then reachability; n_links counts different sets.
OP3_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(3, len(w)) - 1], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 2) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n, string_agg(g, chr(10) ORDER BY g) AS whole FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b, x.whole = y.whole AS equal, y.whole AS other FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 90 * (x.n + y.n - o)),
k AS (SELECT a AS doc_id, count(DISTINCT other) AS n_links FROM l WHERE NOT equal GROUP BY a),
r AS (SELECT a AS doc_id, b AS seen FROM l UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.seen)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, CAST(least(w.doc_id, coalesce(c.low, w.doc_id)) AS BIGINT) AS component_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(seen) AS low FROM r GROUP BY doc_id) c USING (doc_id) LEFT JOIN k USING (doc_id)
"""
