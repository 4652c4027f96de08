"""Near-duplicate documents by MinHash with tensored banding.

Each document has two small collections of K sketches; a sketch is R minimum hashes taken
together. A table key is a pair (sketch i of the first collection, sketch j of the second), which
makes K * K tables of 2 * R hashes each out of 2 * K * R hashes, about the square root of what
independent tables would need. Documents that share a key are candidates; the full sets decide.

A pair of similarity s is missed with a chance of about 2 * (1 - s**R)**K: 2e-5 at 0.8 with the
production parameters, less for closer pairs and for pairs that are reached by other links.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrand.llm.common import map_batches, materialize, release, texts_of
from lodestrand.llm.components import connected_components


@dataclass(frozen=True)
class Params:
    words: int = 5  #: words in a shingle
    percent: int = 80  #: documents are linked if 100 * |intersection| >= percent * |union|
    sketches: int = 16  #: K, sketches in each of the two collections
    rows: int = 3  #: R, minimum hashes in a sketch
    pivots: int = 128  #: members of a cluster's largest component that the others are tried against first
    block: int = 200  #: sets that a task holds while others stream past
    stream: int = 1000  #: sets that stream past in one task
    salts: int = 32  #: parts into which a group is dealt when its sizes are joined
    seed: int = 7


#: Words whose hash a worker keeps.
WORD_CACHE = 300_000

_SHINGLE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_S29, _S32, _S1 = np.uint64(29), np.uint64(32), np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _S32)) * _MIX
    return x ^ (x >> _S29)


class Shingler:
    """The sorted 64-bit hashes of a text's distinct word shingles. A-Z are lower-cased; words are
    runs of bytes other than blank and \\t to \\r. Fewer words than a shingle make one shingle."""

    def __init__(self, words: int):
        self.words = words
        self.known: dict[bytes, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = text.encode("utf-8", "surrogatepass").lower().split() if text else ()
        if not words:
            return np.empty(0, np.uint64)
        known = self.known
        if len(known) > WORD_CACHE:
            known.clear()
        out = []
        for w in words:
            h = known.get(w)
            if h is None:
                h = known[w] = xxhash.xxh3_64_intdigest(w)
            out.append(h)
        h = np.array(out, np.uint64)
        n = max(1, len(h) - self.words + 1)
        width = min(self.words, len(h))
        x = h[:n].copy()
        for k in range(1, width):
            x = _mix(x * _SHINGLE + h[k : k + n])
        if len(h) < self.words:
            x = _mix(x + np.uint64(len(h)))
        return np.unique(x)


def _multipliers(p: Params) -> np.ndarray:
    n = 2 * p.sketches * p.rows
    return np.random.default_rng(p.seed).integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + _S1


def _signatures(p: Params):
    """Batches of (doc_id, text) to (doc_id, n_shingles, fp, keys)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, a = Shingler(p.words), _multipliers(p)
        tables = 2 * p.sketches
        index = _mix(np.arange(1, tables + 1, dtype=np.uint64) * _SHINGLE)
        side = (np.arange(tables) >= p.sketches).astype(np.uint64)

        def flush(sets: list[np.ndarray]):
            full = [s for s in sets if len(s)]
            if not full:
                return np.empty((0, tables), np.int64)
            x, starts = np.concatenate(full), np.cumsum([0] + [len(s) for s in full[:-1]])
            low = np.empty((len(full), len(a)), np.uint64)
            for k in range(len(a)):
                low[:, k] = np.minimum.reduceat(_mix(x * a[k]), starts)
            key = np.broadcast_to(index, (len(full), tables))
            for r in range(p.rows):
                key = _mix(key * _SHINGLE + low.reshape(len(full), tables, p.rows)[:, :, r])
            key = (key & ~_S1) | side
            return key.view(np.int64)

        for batch in batches:
            ids, n, fp, keys = [], [], [], []
            sets: list[np.ndarray] = []
            size = 0

            def settle():
                k = flush(sets)
                at = 0
                for x in sets:
                    keys.append(k[at] if len(x) else None)
                    at += bool(len(x))
                sets.clear()

            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                s = shingle(text.as_py())
                ids.append(i)
                n.append(len(s))
                fp.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                sets.append(s)
                size += len(s)
                if size > 40_000:
                    settle()
                    size = 0
            settle()
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, batch.schema.field(0).type), pa.array(n, pa.int64()), pa.array(fp, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                names=["doc_id", "n_shingles", "fp", "keys"],
            )

    return run


def _sets(p: Params):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(p.words)
        for batch in batches:
            out = [shingle(x.as_py()).tobytes() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["id", "items"])

    return run


def _confirm(percent: int):
    """Batches of (u, v, a, b) to the (u, v) whose sets are alike enough."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                    keep.append(False)
                    continue
                at = np.minimum(np.searchsorted(x, y), len(x) - 1)
                both = int((x[at] == y).sum())
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


def _block_links(percent: int):
    """Batches of (group, block, salt, side, id, comp, items), sorted, to links (u, v). The rows of side 0 of a
    (group, block, salt) are held, those of side 1 stream past and are compared with all held at once."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, index, joined = None, [], None, set()
        for batch in batches:
            u, v = [], []
            for k, side, name, comp, items in zip(zip(*(batch.column(c).to_pylist() for c in range(3))), *(batch.column(c).to_pylist() for c in range(3, 7))):
                if k != key:
                    key, held, index, joined = k, [], None, set()
                one = np.frombuffer(items, np.uint64)
                if side == 0:
                    held.append((name, comp, one))
                    continue
                if not held:
                    continue
                if index is None:
                    sizes = np.array([len(x) for _, _, x in held])
                    every, owner = np.concatenate([x for _, _, x in held]), np.repeat(np.arange(len(held)), sizes)
                    order = np.argsort(every, kind="stable")
                    index = every[order], owner[order], sizes, np.array([c for _, c, _ in held])
                every, owner, sizes, comps = index
                low, high = np.searchsorted(every, one, "left"), np.searchsorted(every, one, "right")
                n = high - low
                at = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
                both = np.bincount(owner[at], minlength=len(held))
                for h in np.flatnonzero((100 * both >= percent * (sizes + len(one) - both)) & (comps != comp)):
                    if (held[h][1], comp) not in joined:  # one link joins two components
                        joined.add((held[h][1], comp))
                        u.append(held[h][0])
                        v.append(name)
            kind = batch.schema.field(4).type
            yield pa.RecordBatch.from_arrays([pa.array(u, kind), pa.array(v, kind)], names=["u", "v"])

    return run


def _apart(members: DataFrame, comps: DataFrame, p: Params) -> DataFrame:
    """(group, id, comp, main, inside, all) of the members of all groups that have more than one component: the
    largest component and its size, and the size of the group. The join of sizes is dealt by salted groups."""
    now = members.join(comps, "id", "left").select("group", "id", F.coalesce("comp", "id").alias("comp"))
    sizes = now.groupBy("group", "comp").agg(F.count("*").alias("n")).groupBy("group")
    sizes = sizes.agg(F.count("*").alias("comps"), F.max_by("comp", F.struct("n", "comp")).alias("main"), F.max("n").alias("inside"), F.sum("n").alias("all")).filter("comps > 1").drop("comps")
    sizes = sizes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(p.salts - 1))))
    return now.withColumn("salt", F.pmod(F.xxhash64("id", F.lit(3)), F.lit(p.salts)).cast("int")).join(sizes, ["group", "salt"]).drop("salt")


def _blocks(now: DataFrame, sets: DataFrame, last: bool, p: Params) -> DataFrame:
    """The rows that :func:`_block_links` reads, dealt and sorted. First some pivots of each group's largest component
    are held and all others stream past; at last all outside that component are held and the whole group streams past."""
    lone = F.col("comp") != F.col("main")
    chance = F.pmod(F.xxhash64("id", F.lit(p.seed)), F.lit(1 << 20)) / float(1 << 20)
    if last:
        held, seen = lone, F.lit(True)
        blocks, streams = F.col("all") - F.col("inside"), F.col("all")
    else:
        held, seen = ~lone & (chance * F.col("inside") < p.pivots), lone
        blocks, streams = F.least(F.col("inside"), F.lit(p.pivots)), F.col("all") - F.col("inside")
    blocks, streams = F.ceil(blocks / p.block).cast("int"), F.ceil(streams / p.stream).cast("int")
    own = now.join(sets, "id")
    block, salt = (F.pmod(F.xxhash64("id", F.lit(k)), n).cast("int") for k, n in ((1, blocks), (2, streams)))
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    a = own.filter(held).select("group", block.alias("block"), each(streams).alias("salt"), F.lit(0).alias("side"), "id", "comp", "items")
    b = own.filter(seen).select("group", each(blocks).alias("block"), salt.alias("salt"), F.lit(1).alias("side"), "id", "comp", "items")
    return a.union(b).repartition("group", "block", "salt").sortWithinPartitions("group", "block", "salt", "side")


def near_duplicates(docs: DataFrame, p: Params = Params(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``.

    Rows are first put into classes of equal shingle sets, so copies never meet in pairs. Class
    representatives get table keys; sketches that nobody shares are dropped before the pairs of
    sketches are formed. Each document is checked against the smallest centre of its buckets, and that
    against the other centres, so a document makes one row whatever the size of its group. Buckets that
    share members form clusters, and what a cluster then still holds apart is compared exactly: members
    outside its largest component first with some pivots of that component, then those still apart with all
    members. Such comparisons hold a block of sets in a task
    while a bounded number of others stream past; they make rows for links only, not for pairs.

    Null or empty texts, and texts without words, have an empty set: n_shingles 0, linked with
    nothing. Rows with a null id are returned alone, with a null component and kept true. Rows that share an id
    count as one vertex. Other columns of ``docs`` are not read. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    texts = texts_of(docs, id_col, text_col)
    kind = texts.schema["doc_id"].dataType.simpleString()
    sig, _ = materialize(map_batches(texts, _signatures(p), f"doc_id {kind}, n_shingles long, fp binary, keys array<long>"), "signatures")
    classes, _ = materialize(sig.filter("fp is not null and doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")), "classes")
    reps = sig.join(classes.withColumnRenamed("rep", "doc_id"), ["fp", "doc_id"]).select(F.col("doc_id").alias("rep"), "keys")

    each = reps.select("rep", F.explode("keys").alias("key"))
    shared = each.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    own = each.join(shared, "key").groupBy("rep").agg(F.collect_set("key").alias("keys"))
    pairs = own.select("rep", F.explode(F.filter("keys", lambda k: k % 2 == 0)).alias("first"), "keys")
    pairs = pairs.select("rep", "first", F.explode(F.filter("keys", lambda k: k % 2 != 0)).alias("second"))
    tables, tables_at = materialize(pairs.select(F.xxhash64("first", "second").alias("key"), "rep"), "tables")

    centres = tables.groupBy("key").agg(F.min("rep").alias("centre"), F.count("*").alias("n")).filter("n > 1").select("key", "centre")
    # one link to the smallest centre of a document, and one from that to each other centre of it: the buckets hang together as before
    hubs = tables.join(centres, "key").groupBy("rep").agg(F.min("centre").alias("u"), F.collect_set("centre").alias("others"))
    hubs, hubs_at = materialize(hubs, "hubs")
    star = hubs.select("u", F.col("rep").alias("v")).union(hubs.select("u", F.explode("others").alias("v")).distinct())
    star, star_at = materialize(star.filter("u <> v").distinct(), "star")
    release(spark, hubs_at)
    wanted = star.select(F.col("u").alias("id")).union(star.select(F.col("v").alias("id"))).distinct()
    # one plan at every size: the hint keeps a small set of ids from being broadcast
    chosen = texts.filter("doc_id is not null").join(wanted.hint("merge"), F.col("doc_id") == F.col("id"), "left_semi")
    sets, sets_at = materialize(map_batches(chosen, _sets(p), f"id {kind}, items binary"), "sets")

    def confirm(found: DataFrame) -> DataFrame:
        a, b = sets.select(F.col("id").alias("u"), F.col("items").alias("a")), sets.select(F.col("id").alias("v"), F.col("items").alias("b"))
        return map_batches(found.join(b, "v").join(a, "u").select("u", "v", "a", "b"), _confirm(p.percent), f"u {kind}, v {kind}")

    links, links_at = materialize(confirm(star), "links")
    comps, comps_at = connected_components(links)
    clusters, clusters_at = connected_components(star)
    release(spark, links_at, star_at, tables_at)
    members = clusters.select(F.xxhash64(F.lit("cluster"), "comp").alias("group"), "id")

    for last in (False, True):
        now, now_at = materialize(_apart(members, comps, p), "apart")
        if not now.limit(1).count():
            release(spark, now_at)
            break
        more, more_at = materialize(map_batches(_blocks(now, sets, last, p), _block_links(p.percent), f"u {kind}, v {kind}"), "links")
        if more.limit(1).count():
            # links between components join their labels
            across = more.join(comps.select(F.col("id").alias("u"), F.col("comp").alias("cu")), "u", "left").join(comps.select(F.col("id").alias("v"), F.col("comp").alias("cv")), "v", "left")
            joined, joined_at = connected_components(across.select(F.coalesce("cu", "u").alias("u"), F.coalesce("cv", "v").alias("v")))
            ends = comps.select("id", "comp").union(joined.select(F.col("id"), F.col("id").alias("comp"))).distinct()
            ends = ends.join(joined.select(F.col("id").alias("comp"), F.col("comp").alias("to")), "comp", "left").groupBy("id").agg(F.min(F.coalesce("to", "comp")).alias("comp"))
            comps, new_at = materialize(ends, "labels")
            release(spark, comps_at, joined_at)
            comps_at = new_at
        release(spark, now_at, more_at)

    release(spark, clusters_at, sets_at)
    of_class = classes.join(comps.withColumnRenamed("id", "rep"), "rep", "left").select("fp", F.coalesce("comp", "rep").alias("comp"))
    out = sig.select("doc_id", "n_shingles", "fp").join(of_class, "fp", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
