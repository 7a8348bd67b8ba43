"""Near-duplicates by one-permutation MinHash with optimal densification.

A text is the set of its distinct word shingles. Texts with equal sets become one node. A node's signature has one
minimum for each bin of one permutation; an empty bin borrows from the filled bin that comes first in the bin's own
random order, so that borrowed minima too agree with the probability of the similarity. Rows of the signature are banded;
a band's value is a bucket. In each bucket the smallest node is the hub of a star: every other member is compared
with it, on full sets, after a bound by sizes and by parities of shingle hashes, which is exact, or one-bit sketches if both are large.
What is still mixed after that is settled exactly: the texts of buckets whose members belong to more than one component
are joined on full sets by prefix filtering, so that no pair of a bucket that could still join two components stays
uncompared. Shingles of a single component can't be common to two, so they come first in the order of the prefixes, and a family that
shares a template meets on the shingles of its pairs.

With the defaults a pair at the threshold of 0.8 misses all buckets with probability 3e-7, pairs above it less often; the join
doesn't depend on hubs. It is exact but for one bound: a pair of FILLED shingles or more is passed over if more than MISMATCHES of its one-bit sketches'
BITS differ, which a pair at the threshold does with a probability of 2e-9 (36 of 128 bits, where a tenth differs). Full sets are made once, for the texts that share a bucket, in one shuffle of distinct texts.

Defined results: a text with fewer words than a shingle has its whole word sequence as its one shingle; a null or
empty text has none and is linked with nothing; equal rows are linked; a null id can't name a component: its row gets
the smallest id of the others in it, or null if there is none; very long texts are whole sets; of rows that agree in id and
text the kept one is the least by its other columns, so reruns agree; an empty table gives none; other columns of the input are not touched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as Over

from .common import BROADCAST_ROWS, as_table, byte_words, text_slices
from .components import components

#: Rows of a band and bands; their product is the number of bins. Bits of the sketch, and mismatches beyond which a
#: pair is surely below the threshold: at 0.8 a tenth of the bits differ, and 36 are seven standard deviations more. That holds
#: for independent bits, so for sets of FILLED shingles or more, of which few bins borrow; smaller ones are bounded by parities.
ROWS, BANDS, BITS, MISMATCHES, FILLED = 6, 50, 128, 36, 1000
BINS = ROWS * BANDS
#: Bits of the parities: each is that of the number of shingles with its hash, so two sets differ by a shingle for each bit at least.
PARITIES = 256
#: Members of a shingle that are compared with each other in one group, at most about; a group is a pair of such blocks.
BLOCK = 1024
#: Parts into which the members of one component are dealt when they learn its smallest id.
SALTS = 16
SLICE_BYTES = 8 << 20
KEPT_WORDS = 400_000
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words with good avalanche (splitmix64)."""
    x = x + _MIX[0]
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words, kept up to a bound; the same on every machine."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > KEPT_WORDS:
            self.clear()
        h = self[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return h


HASHES = WordHashes()


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """The sorted distinct hashes of the text's shingles."""
    words = byte_words(text)
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(HASHES.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - width + 1)
    out = np.full(n, min(len(h), width), np.uint64)
    for i in range(min(width, len(h))):
        out = mix(out ^ h[i : i + n])
    return np.unique(out)


#: The order in which an empty bin tries the others, by bin; and the factors that make one value of a band's rows.
_SEEDED = np.random.Generator(np.random.PCG64(20240229))
BORROW = np.argsort(_SEEDED.random((BINS, BINS)), axis=1).argsort(axis=1).astype(np.int16)
FACTORS = _SEEDED.integers(1, 1 << 63, (BANDS, ROWS), np.uint64) * np.uint64(2) + np.uint64(1)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The densified minima of a non-empty sorted set, by bin."""
    bins = ((shingles >> np.uint64(32)) * np.uint64(BINS) >> np.uint64(32)).astype(np.int64)
    first = np.flatnonzero(np.diff(bins, prepend=-1))
    filled = bins[first]
    out = np.zeros(BINS, np.uint64)
    out[filled] = shingles[first]
    if len(filled) < BINS:
        empty = np.setdiff1d(np.arange(BINS), filled, assume_unique=True)
        out[empty] = out[filled[BORROW[np.ix_(empty, filled)].argmin(axis=1)]]
    return out


def band_keys(minima: np.ndarray) -> np.ndarray:
    return mix((minima.reshape(BANDS, ROWS) * FACTORS).sum(axis=1, dtype=np.uint64) ^ np.arange(BANDS, dtype=np.uint64))


def sketch(shingles: np.ndarray, minima: np.ndarray) -> np.ndarray:
    """One bit of each of the first minima, then the parities of the set."""
    parities = np.bincount((shingles % np.uint64(PARITIES)).astype(np.int64), minlength=PARITIES) & 1
    return np.packbits(np.append(mix(minima[:BITS]) >> np.uint64(63) == 1, parities == 1)).view(np.int64)


def signed(texts: DataFrame, width: int) -> DataFrame:
    """(doc_id, __text, text_key) to doc_id, text_key, n_shingles, and of non-empty sets digest, keys and sketch."""
    schema = "doc_id long, text_key binary, n_shingles long, digest binary, keys array<long>, sketch array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "__text", SLICE_BYTES):
            n, digest, keys, bits = [], [], [], []
            for text in part.column("__text").to_pylist():
                s = shingle_set(text, width)
                n.append(len(s))
                minima = signature(s) if len(s) else None
                digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                keys.append(band_keys(minima).view(np.int64) if len(s) else None)
                bits.append(sketch(s, minima) if len(s) else None)
            lists = [pa.array(x, pa.list_(pa.int64())) for x in (keys, bits)]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("text_key"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), *lists],
                ["doc_id", "text_key", "n_shingles", "digest", "keys", "sketch"],
            )

    return texts.mapInArrow(run, schema)


def sets_of(texts: DataFrame, width: int) -> DataFrame:
    """(node, __text) to (node, shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "__text", SLICE_BYTES):
            sets = [shingle_set(t, width).view(np.int64) for t in part.column("__text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(sets, pa.list_(pa.int64()))], ["node", "shingles"])

    return texts.mapInArrow(run, "node long, shingles array<long>")


def mismatches(percent: int) -> int:
    """They are set for 0.8; a lower threshold allows as many more as the bits that may differ grow."""
    return MISMATCHES + max(0, 80 - percent) * BITS // 200 * 2


def likely(percent: int) -> Column:
    """Whether the sizes and sketches of a pair leave it possible that it reaches the threshold."""
    differing = lambda words: reduce(add, (F.bit_count(F.get("a_sketch", i).bitwiseXOR(F.get("b_sketch", i))) for i in words))
    by_sketch = differing(range(BITS // 64)) <= mismatches(percent)
    # A pair at the threshold has (1 - t) / (1 + t) of its sizes' sum in one set alone, at most.
    by_parities = differing(range(BITS // 64, (BITS + PARITIES) // 64)) * (100 + percent) <= (F.col("a_n") + F.col("b_n")) * (100 - percent)
    sizes = F.least("a_n", "b_n") * 100 >= F.greatest("a_n", "b_n") * percent
    return sizes & by_parities & ((F.least("a_n", "b_n") < FILLED) | by_sketch)


def side(nodes: DataFrame, p: str) -> DataFrame:
    return nodes.select(F.col("node").alias(p), F.col("n_shingles").alias(f"{p}_n"), F.col("sketch").alias(f"{p}_sketch"))


def compared(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """(a, b, a_n, b_n) of the pairs that sizes and sketches leave possible."""
    return pairs.join(side(nodes, "a"), "a").join(side(nodes, "b"), "b").where(likely(percent)).select("a", "b", "a_n", "b_n")


def sets_at_hand(nodes: DataFrame, at_hand: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """(node, shingles) of the nodes at hand, made anew from one text of each. A text that many rows have is one row of each task
    before it is shuffled; where the keys are few, no other text is."""
    keys = as_table(nodes.join(at_hand, "node", "left_semi").select("node", "text_key"))
    if keys.count() <= BROADCAST_ROWS:
        docs = docs.join(F.broadcast(keys.select("text_key")), "text_key", "left_semi")
    once = docs.groupBy("text_key").agg(F.first("__text").alias("__text"))
    return as_table(sets_of(once.join(keys, "text_key").select("node", "__text"), width))


def confirmed(near: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The (a, b) of near (a, b, a_n, b_n) whose full sets reach the threshold."""
    of = lambda p: sets.select(F.col("node").alias(p), F.col("shingles").alias(f"{p}_set"))
    common = near.join(of("a"), "a").join(of("b"), "b").withColumn("common", F.size(F.array_intersect("a_set", "b_set")))
    return common.where(F.col("common") * 100 >= (F.col("a_n") + F.col("b_n") - F.col("common")) * percent).select("a", "b")


def still_mixed(buckets: DataFrame, edges: DataFrame) -> DataFrame:
    """The distinct (node, root) of the members of buckets (key, node) whose members belong to more than one component."""
    roots = components(edges.select(F.col("a").alias("u"), F.col("b").alias("v")))
    rooted = buckets.select("key", "node").join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    mixed = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key")
    return rooted.join(mixed, "key").select("node", "root").distinct()


def prefix_pairs(sets: DataFrame, percent: int) -> DataFrame:
    """(a, b, a_n, b_n), a < b, of sets (node, root, n, shingles, sketch): every pair of different roots that reaches the threshold, and others.

    In any one order of all shingles, two such sets have their first common shingle in the first n - least + 1 of each, where
    `least` is what they must have in common. Shingles of one root only come first, then the rare ones. The smaller set of
    a pair needs the shorter prefix, as its share of both sizes is the greater.
    """
    each = sets.select("node", "root", "n", F.explode("shingles").alias("shingle"))
    sketches = sets.select("node", "sketch")
    of_shingle = each.groupBy("shingle").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("held"))
    common = as_table(each.join(of_shingle.where("low <> high").select("shingle", "held"), "shingle"))
    of_node = Over.partitionBy("node")
    ranked = common.withColumn("before", F.col("n") - F.count(F.lit(1)).over(of_node)).where(F.col("before") * 100 <= F.col("n") * (100 - percent))
    placed = ranked.withColumn("at", F.col("before") + F.row_number().over(of_node.orderBy("held", "shingle")) - 1).where(F.col("at") * 100 <= F.col("n") * (100 - percent))
    prefixes = as_table(placed.select("shingle", "node", "root", "n", "at").join(sketches, "node"))
    held = prefixes.groupBy("shingle").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("held")).where("low <> high")
    dealt = prefixes.join(held.select("shingle", F.ceil(F.col("held") / BLOCK).cast("int").alias("blocks")), "shingle")
    # The members of a shingle are dealt into blocks of bounded size, and each pair of blocks is a group of its own.
    block = F.pmod(F.xxhash64("node", "shingle"), F.col("blocks")).cast("int")
    paired = dealt.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    keys = [F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi")]
    rows = paired.select("shingle", *keys, "block", "node", "root", "n", "at", "sketch").repartition("shingle", "lo", "hi").sortWithinPartitions("shingle", "lo", "hi")
    return pairs_in_groups(rows, percent).distinct()


def fitting(r: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs (i, j) of rows that share a shingle of their prefixes, those that may be linked and join two components."""
    n, at = r["n"], r["at"]
    keep = (r["root"][i] != r["root"][j]) & ((r["lo"][i] == r["hi"][i]) | (r["block"][i] != r["block"][j]))
    i, j = i[keep], j[keep]
    least, most = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
    left = np.minimum(n[i] - at[i], n[j] - at[j])
    begun = np.where(n[i] <= n[j], at[i], at[j])  # the smaller set needs a shorter prefix
    begun = np.where(n[i] == n[j], np.minimum(at[i], at[j]), begun)
    keep = (least * 100 >= most * percent) & (left * (100 + percent) >= (least + most) * percent) & (begun * (100 + percent) <= least * (100 - percent))
    i, j, least, most = i[keep], j[keep], least[keep], most[keep]
    differing = np.bitwise_count((r["sketch"][i] ^ r["sketch"][j]).view(np.uint64))
    bits, parities = differing[:, : BITS // 64].sum(axis=1, dtype=np.int64), differing[:, BITS // 64 :].sum(axis=1, dtype=np.int64)
    keep = (parities * (100 + percent) <= (least + most) * (100 - percent)) & ((least < FILLED) | (bits <= mismatches(percent)))
    return i[keep], j[keep]


def pairs_in_groups(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b, a_n, b_n) of rows that come sorted by shingle, lo and hi, group after group. Pairs are formed as numbers in memory, of bounded
    groups, and only those that fit become rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] | None = None

        def put(r: dict[str, np.ndarray], bounds: np.ndarray) -> pa.RecordBatch:
            """The pairs of the groups between the bounds."""
            some, found, waiting = [], [], 0
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                i, j = np.triu_indices(b - a, 1)
                some.append((i + a, j + a))
                waiting += len(i)
                if waiting > 1 << 20:
                    found.append(fitting(r, *map(np.concatenate, zip(*some, strict=True)), percent))
                    some, waiting = [], 0
            if some:
                found.append(fitting(r, *map(np.concatenate, zip(*some, strict=True)), percent))
            i, j = map(np.concatenate, zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2
            first = r["node"][i] < r["node"][j]
            a, b = np.where(first, i, j), np.where(first, j, i)
            columns = [r["node"][a], r["node"][b], r["n"][a], r["n"][b]]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["a", "b", "a_n", "b_n"])

        for batch in batches:
            if not batch.num_rows:
                continue
            r = {c: batch.column(c).to_numpy() for c in batch.schema.names if c != "sketch"}
            r["sketch"] = batch.column("sketch").flatten().to_numpy().reshape(batch.num_rows, -1)
            if held is not None:
                r = {c: np.concatenate([held[c], x]) for c, x in r.items()}
            new = np.flatnonzero((np.diff(r["shingle"]) != 0) | (np.diff(r["lo"]) != 0) | (np.diff(r["hi"]) != 0)) + 1
            if len(new):
                yield put(r, np.concatenate([[0], new]))
            held = {c: x[new[-1] if len(new) else 0 :] for c, x in r.items()}
        if held is not None:
            yield put(held, np.array([0, len(held["n"])]))

    return rows.mapInArrow(run, "a long, b long, a_n long, b_n long")


def lowest(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """(digest, lowest) of all nodes: the first row of each one's component. Members of one component are dealt by a salt, so that
    those of a great one don't meet in one task; a node without a link is its own component."""
    own = roots.select(F.col("root").alias("node"), "root").distinct()
    linked = as_table(nodes.select("node", "digest", "first").join(roots.unionByName(own), "node"))
    of_root = linked.groupBy("root").agg(F.min("first").alias("lowest")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = linked.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
    alone = nodes.join(linked.select("node"), "node", "left_anti").select("digest", F.col("first").alias("lowest"))
    return alone.unionByName(salted.join(of_root, ["root", "salt"]).select("digest", "lowest"))


TEXT_KEY = lambda text: F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def classes(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, text_key, n_shingles, component_id (the smallest id of the component), kept
    (whether that is its own), and is_representative, which holds for one (doc_id, text_key) of each component."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("__text")).withColumn("text_key", TEXT_KEY(F.col("__text")))
    rows = as_table(signed(texts, width))
    nodes = rows.where(F.col("n_shingles") > 0).groupBy("digest").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "text_key")).alias("first"), F.min("text_key").alias("text_key"), F.max("n_shingles").alias("n_shingles"),
        F.min("keys").alias("keys"), F.min("sketch").alias("sketch"),
    )
    nodes = as_table(nodes.withColumn("node", F.monotonically_increasing_id()))

    members = nodes.select(F.explode("keys").alias("key"), "node")
    shared = members.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("hub")).where("n > 1").select("key", "hub")
    buckets = as_table(members.join(shared, "key"))
    stars = buckets.where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    sets = sets_at_hand(nodes, buckets.select("node").distinct(), texts.select("text_key", "__text"), width)
    checked = as_table(compared(stars, nodes, percent))
    edges = as_table(confirmed(checked, sets, percent))
    still = as_table(still_mixed(buckets, edges).join(nodes.select("node", F.col("n_shingles").alias("n")), "node"))
    fresh = as_table(prefix_pairs(still.join(sets, "node").join(nodes.select("node", "sketch"), "node"), percent).join(checked.select("a", "b"), ["a", "b"], "left_anti"))
    edges = as_table(edges.unionByName(confirmed(fresh, sets, percent)))
    of_set = lowest(nodes, components(edges.select(F.col("a").alias("u"), F.col("b").alias("v"))))
    found = rows.select("doc_id", "text_key", "n_shingles", "digest").join(of_set, "digest", "left")
    some = F.col("n_shingles") > 0
    component = F.when(some, F.col("lowest.doc_id")).otherwise(F.col("doc_id"))
    same = F.col("doc_id").eqNullSafe(F.col("lowest.doc_id")) & (F.col("text_key") == F.col("lowest.text_key"))
    return found.select(
        "doc_id", "text_key", "n_shingles", component.alias("component_id"),
        F.col("doc_id").eqNullSafe(component).alias("kept"), (~some | same).alias("is_representative"),
    )


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of docs."""
    return classes(docs, width, percent, id_col, text_col).select("doc_id", "n_shingles", "component_id", "kept")


def deduplicated(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with their columns, of which one of each component stays: that of the smallest id. Rows that agree
    in id and text are one document."""
    columns = docs.columns
    # One key for id and text, so that repeated rows meet and the kept ones are joined by a single shuffle of the texts.
    row_key = F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.lit(":"), F.hex("text_key"))))
    keep = classes(docs, width, percent, id_col, text_col).where("is_representative").select(row_key.alias("row_key")).distinct()
    named = docs.select(*(F.col(c).alias(f"c{i}") for i, c in enumerate(columns)), F.col(id_col).cast("long").alias("doc_id"), TEXT_KEY(F.col(text_col)).alias("text_key"))
    once = named.withColumn("row_key", row_key).drop("doc_id", "text_key")
    rest = [F.col(f"c{i}") for i, c in enumerate(columns) if c not in (id_col, text_col)]
    order = F.struct(*(c.cast("string") for c in rest)) if rest else F.lit(0)
    once = once.groupBy("row_key").agg(F.min_by(F.struct(*(f"c{i}" for i in range(len(columns)))), order).alias("row")).select("row_key", "row.*")
    return once.join(as_table(keep), "row_key", "left_semi").select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(columns)))
