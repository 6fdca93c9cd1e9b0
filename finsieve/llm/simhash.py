"""SimHash near-dedup with BK-trees.

Fingerprints that differ in at most r bits agree in at least B - r of B blocks of bits, so rows are
dealt by each choice of B - r blocks; those that share such a key form a bucket. A bucket is cut
into shards of bounded size; a shard's rows are sent to the tasks of the bucket's other shards, where
they are built into the shard's BK-tree, and a search follows only edges within the radius. A task
reports a spanning forest of its links, never all pairs; components are then found over all links.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, groups, located, locator, over_texts, quoted, stored, stored_from_python, without
from .components import components

BITS, SEED = 64, 42
#: Rows of a shard, in which one task works at a time.
SHARD_ROWS = 1024
#: Rows that a bucket should have on average; with more, keys of more blocks are taken.
BUCKET_ROWS = 64
#: Hashes of a text that are counted at a time.
HASHES = 1 << 16


# Fingerprints

def words_of(text: str | None) -> list[bytes]:
    """Words between spaces and the control characters 9 to 13, A-Z in lower case."""
    return (text or "").encode().lower().split()


def shingle_hashes(words: list[bytes], k: int, seed: int = SEED) -> Iterator[np.ndarray]:
    """XXH64 of all runs of k words, repeats included, in blocks; with fewer words, of all of them."""
    digest, join = xxhash.xxh64_intdigest, b" ".join
    if len(words) <= k:
        yield np.array([digest(join(words), seed)] if words else [], "<u8")
        return
    for at in range(0, len(words) - k + 1, HASHES):
        yield np.array([digest(join(words[i : i + k]), seed) for i in range(at, min(at + HASHES, len(words) - k + 1))], "<u8")


def simhash(blocks: Iterator[np.ndarray] | list[np.ndarray]) -> int:
    """Bits set in more than half the hashes; 0 without hashes."""
    n, ones = 0, np.zeros(BITS, np.int64)
    for hashes in blocks:
        n += len(hashes)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def signed(fingerprint: int) -> int:
    return fingerprint - (1 << BITS) if fingerprint >> (BITS - 1) else fingerprint


def fingerprints(docs: DataFrame, k: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return over_texts(docs, [id_col], text_col, "fp long", lambda texts: [(signed(simhash(shingle_hashes(words_of(t), k))),) for t in texts])


# BK-trees

class BkTree:
    """Values under Hamming distance; children are keyed by their distance to the parent."""

    def __init__(self):
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> int:
        at = len(self.values)
        self.values.append(value)
        self.children.append({})
        node = 0
        while at:
            distance = (value ^ self.values[node]).bit_count()
            node = self.children[node].setdefault(distance, at)
            if node == at:
                break
        return at

    def near(self, value: int, radius: int) -> list[tuple[int, int]]:
        """(distance, place) of all values within the radius, nearest first."""
        found, stack, values, children = [], [0] if self.values else [], self.values, self.children
        while stack:
            node = stack.pop()
            distance = (value ^ values[node]).bit_count()
            if distance <= radius:
                found.append((distance, node))
            for edge, child in children[node].items():
                if -radius <= edge - distance <= radius:
                    stack.append(child)
        return sorted(found)


class Forest:
    """Disjoint sets over places; the root is the smallest."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def root(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = sorted((self.root(i), self.root(j)))
        self.parent[j] = i


def shard_links(nodes: list[int], values: list[int], roles: list[int], radius: int, same: Callable[[int, int], bool] | None = None) -> Iterator[tuple[int, int]]:
    """Links (node, node) that span the shard's components; roles are those of link_rows.

    `same` judges pairs of places within the radius that aren't joined yet.
    """
    tree, forest = BkTree(), Forest(len(nodes))
    mask, alone = (1 << BITS) - 1, 2 not in roles
    places: list[int] = []
    settled = None
    for i, (value, role) in enumerate(zip(values, roles, strict=True)):
        value &= mask
        if role == 2 or (role == 1 and alone):
            for _, at in tree.near(value, radius):
                j = places[at]
                if forest.root(i) != forest.root(j) and (same is None or same(i, j)):
                    forest.join(i, j)
        if role == 0:
            settled = i if settled is None else settled
            forest.join(i, settled)
        if role < 2:
            tree.add(value)
            places.append(i)
    for i in range(len(nodes)):
        if (j := forest.root(i)) != i:
            yield nodes[i], nodes[j]


# Shards

def key_masks(radius: int, n: int, bucket_rows: int = BUCKET_ROWS) -> list[int]:
    """Masks of which any two values within the radius agree under one at least, with as few blocks as keep buckets small.

    More blocks mean longer keys and more of them; every number of blocks is exact.
    """
    for blocks in range(radius + 1, BITS + 1):
        bounds = [BITS * i // blocks for i in range(blocks + 1)]
        parts = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(bounds, bounds[1:])]
        masks = [sum(chosen) for chosen in combinations(parts, blocks - radius)]
        if n <= bucket_rows << (min(m.bit_count() for m in masks)) or len(masks) > 100:
            return masks
    raise ValueError("radius")


def sharded(keyed: DataFrame, shard_rows: int) -> DataFrame:
    """keyed (table, key, node, fp) with columns shard and role, for each pair of a bucket's shards.

    A bucket of one row has no links and goes. Of a bucket of m shards, each row goes to m tasks:
    in its own shard it is searched for and added, for later shards it is in the tree, in earlier
    ones' it is searched for.
    """
    counts = keyed.groupBy("table", "key").agg(F.count("*").alias("n")).where("n > 1")
    own = F.pmod(F.xxhash64("node", "fp"), F.col("m")).cast("int")
    placed = keyed.join(counts, ["table", "key"]).withColumn("m", F.ceil(F.col("n") / shard_rows)).withColumn("own", own)
    met = placed.withColumn("other", F.explode(F.expr("sequence(0, cast(m as int) - 1)")))
    return met.select(F.xxhash64("table", "key", F.least("own", "other"), F.greatest("own", "other")).alias("shard"), F.when(F.col("own") <= F.col("other"), 1).otherwise(2).alias("role"), *[c for c in keyed.columns if c not in ("table", "key")])


def link_rows(rows: DataFrame, radius: int, verified: float | None = None) -> DataFrame:
    """Links a, b of rows (shard, role, node, fp and, if verified, grams), one shard at a time.

    Rows of role 1 are in the tree and rows of role 2 are searched for; where there are none of role
    2, each of role 1 is searched for before it is added. Rows of role 0 are in the tree too, and
    known to be linked with each other.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, table in groups(batches):
            nodes, values, roles = (table[c].to_pylist() for c in ("node", "fp", "role"))
            same = None
            if verified is not None:
                grams = table["grams"]
                same = lambda i, j: jaccard(grams[i].as_buffer(), grams[j].as_buffer()) >= verified
            found = list(shard_links(nodes, values, roles, radius, same))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], names=["a", "b"])

    return rows.repartition("shard").sortWithinPartitions("shard", "role", "node").mapInArrow(run, "a long, b long")


def near_fingerprints(distinct: DataFrame, radius: int, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Links a, b between nodes whose fingerprints differ in at most radius bits; distinct: node, fp, each fp once."""
    masks = key_masks(radius, distinct.count())
    signed_masks = F.array(*[F.lit(signed(m)).cast("long") for m in masks])
    keyed = distinct.select("node", "fp", F.posexplode(signed_masks).alias("table", "mask")).select("table", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "node", "fp")
    return link_rows(sharded(keyed, shard_rows), radius)


def simhash_groups(docs: DataFrame, k: int = 4, radius: int = 4, shard_rows: int = SHARD_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, fingerprint (16 hex digits), component_id (the smallest id that links reach).

    Texts of one fingerprint are one node, found by partial aggregation, so copies cost nothing
    further. A null text counts as empty, one of any length is fingerprinted whole; texts without
    words have fingerprint 0 and are linked like any other. Rows without an id link as others do, but
    never name a component, which is null where no row has an id. Repeated rows each give a row; an
    empty table gives none; other columns are ignored.
    """
    slim = docs.select(F.col(quoted(id_col)).cast("long").alias("id"), F.col(quoted(text_col)).alias("text"))
    made = stored_from_python(fingerprints(slim, k, "id", "text"), "fingerprints")
    distinct = stored(made.groupBy("fp").agg(F.min("id").alias("least")).withColumn("node", F.col("fp")), "fingerprint-nodes")
    found = components(near_fingerprints(distinct.select("node", "fp"), radius, shard_rows))
    linked = stored(distinct.join(found, "node").select("fp", "least", "component"), "fingerprint-components")
    named = linked.select("fp", "component").join(linked.groupBy("component").agg(F.min("least").alias("component_id")), "component").select("fp", "component_id")
    alone = distinct.join(linked.select("fp"), "fp", "left_anti").select("fp", F.col("least").alias("component_id"))
    return made.join(named.unionByName(alone), "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# Near duplicates by similarity

#: Hashes of a band's key and number of bands: of pairs at 0.8, 499 in 500 share a band.
BAND_HASHES, BANDS = 2, 6
#: Bits that fingerprints of texts as similar as 0.8 may differ in: 3.6 standard deviations over the mean. With BITS no pair of a bucket is left out.
WIDE_RADIUS = 20
#: Rows and bytes of shingle sets of a shard that is verified in one task.
SET_ROWS, SET_BYTES = 256, 64 << 20
#: Leaders that are broadcast at most, and bytes of their sets.
LEADERS, LEADER_BYTES = 1024, 32 << 20


def jaccard(a: memoryview | bytes, b: memoryview | bytes) -> float:
    """Similarity of two sets of sorted 32-bit hashes; 1 for two empty ones."""
    x, y = np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4")
    if not len(x) or not len(y):
        return float(len(x) == len(y))
    both = np.intersect1d(x, y, assume_unique=True).size
    return both / (len(x) + len(y) - both)


def band_keys(hashes: np.ndarray, bands: int = BANDS, size: int = BAND_HASHES) -> list[int]:
    """A key per band of the smallest of the hashes under `size` mixings of them."""
    if not len(hashes):
        return [0] * bands
    keys = []
    for band in range(bands):
        key = band
        for i in range(size):
            odd = np.uint64(xxhash.xxh64_intdigest(b"%d/%d" % (band, i)) | 1)
            mixed = hashes * odd
            mixed ^= mixed >> np.uint64(29)
            mixed *= odd
            key = xxhash.xxh64_intdigest(int(mixed.min()).to_bytes(8, "little"), key & (2**64 - 1))
        keys.append(signed(key))
    return keys


def sketch(text: str | None, k: int) -> tuple[int, list[int], bytes, bytes]:
    """Fingerprint, band keys, the set of shingles as sorted 32-bit hashes, and that set's digest.

    The fingerprint is of the set too, without repeats: what repeats unevenly doesn't change similarity.
    """
    hashes = np.unique(np.concatenate(list(shingle_hashes(words_of(text), k))))
    grams = np.unique((hashes >> np.uint64(32)).astype("<u4")).tobytes()
    return signed(simhash([hashes])), band_keys(hashes), grams, hashlib.sha256(grams).digest()


def text_digest(text_col: str) -> Column:
    return F.sha2(F.coalesce(F.col(quoted(text_col)).cast("string"), F.lit("")), 256)


def bucket_links(keyed: DataFrame, radius: int, shard_rows: int) -> DataFrame:
    """Links a, b that join rows of keyed (table, key, node, fp) which may be similar: those of one bucket and within the radius.

    Every row goes to one task a key. A bucket of more than shard_rows rows is one group without a
    look at fingerprints, which joins more than it must and costs a link a row.
    """
    counts = keyed.groupBy("table", "key").agg(F.count("*").alias("n"), F.min("node").alias("least")).where("n > 1")
    placed = keyed.join(counts, ["table", "key"])
    small = placed.where(F.col("n") <= shard_rows).select(F.xxhash64("table", "key").alias("shard"), F.lit(1).alias("role"), "node", "fp")
    return link_rows(small, radius).unionByName(placed.where(F.col("n") > shard_rows).select(F.col("node").alias("a"), F.col("least").alias("b")))


def leaders_of(hot: DataFrame, keyed: DataFrame) -> DataFrame:
    """(component, node): of each component of hot (component, node) the row whose keys most others have too, equal ones by node."""
    own = hot.join(keyed.select("table", "key", "node"), "node")
    votes = own.groupBy("component", "table", "key").agg(F.count("*").alias("votes"))
    scored = own.join(votes, ["component", "table", "key"]).groupBy("component", "node").agg(F.sum("votes").alias("score"))
    return scored.groupBy("component").agg(F.max_by("node", F.struct("score", -F.col("node"))).alias("node"))


#: Columns of a row that is compared with its component's leader.
SETTLED = ("component", "m", "node", "first")


def verified_links(candidates: DataFrame, keyed: DataFrame, sets: DataFrame, similarity: float, radius: int, shard_rows: int, shard_bytes: int) -> DataFrame:
    """Links a, b between similar rows of each candidate component (node, component); keyed: table, key, node; sets: node, fp, n_grams, grams.

    Each candidate sends its set once. A component of more rows or bytes than a shard's is compared
    with its most typical row, whose smallest hashes most others share: those that are similar to that
    one are settled, linked and needn't meet each other any more. Only rows that aren't settled are
    searched for in all of the component's shards, in chunks of a shard's rows.
    """
    sized = candidates.join(sets.select("node", "n_grams"), "node")
    shards = sized.groupBy("component").agg(F.greatest(F.ceil(F.count("*") / shard_rows), F.ceil(F.sum(F.col("n_grams") * 4) / shard_bytes), F.lit(1)).cast("int").alias("m"))
    named = stored(candidates.join(shards, "component"), "sketch-candidates")
    few = named.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    members = stored(sets.drop("n_grams").join(F.broadcast(named) if few else named, "node"), "sketch-members")
    cold = members.where("m = 1").select(F.col("component").alias("shard"), F.lit(1).alias("role"), "node", "fp", "grams")
    links = link_rows(cold, radius, similarity)
    hot = members.where("m > 1")
    if hot.isEmpty():
        return links
    leaders = leaders_of(named.where("m > 1").select("component", "node"), keyed)
    leaders = stored(hot.join(leaders, ["component", "node"]).select("component", F.col("node").alias("first"), F.col("grams").alias("leader")), "sketch-leaders")
    n, size = leaders.select(F.count("*"), F.coalesce(F.sum(F.octet_length("leader")), F.lit(0))).first()
    beside = hot.join(F.broadcast(leaders) if n <= LEADERS and size <= LEADER_BYTES else leaders, "component")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams, leader = batch.column("grams"), batch.column("leader")
            alike = [jaccard(grams[i].as_buffer(), leader[i].as_buffer()) >= similarity for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in SETTLED], pa.array(alike, pa.bool_())], names=[*SETTLED, "settled"])

    judged = stored(beside.select(*SETTLED, "grams", "leader").mapInArrow(run, "component long, m int, node long, first long, settled boolean"), "sketch-settled")
    links = links.unionByName(judged.where("settled and node <> first").select(F.col("node").alias("a"), F.col("first").alias("b")))
    loose = judged.where("not settled")
    if loose.isEmpty():
        return links
    chunks = loose.groupBy("component").agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("chunks"))
    own = F.pmod(F.xxhash64("node"), F.col("m")).cast("int")
    here = judged.join(chunks, "component").select("component", "node", own.alias("n"), F.explode(F.expr("sequence(0, chunks - 1)")).alias("c"), F.when(F.col("settled"), 0).otherwise(1).alias("role"))
    chunk = F.pmod(F.xxhash64("node", F.lit(1)), F.col("chunks")).cast("int")
    there = loose.join(chunks, "component").select("component", "node", F.explode(F.expr("sequence(0, m - 1)")).alias("n"), chunk.alias("c"), F.lit(2).alias("role"))
    rows = here.unionByName(there).select(F.xxhash64("component", "n", "c").alias("shard"), "role", "node").join(members.select("node", "fp", "grams"), "node")
    return links.unionByName(link_rows(rows, radius, similarity))


def _judged(source: DataFrame, k: int, similarity: float, radius: int, shard_rows: int, shard_bytes: int, id_col: str, text_col: str) -> DataFrame:
    """(at, id, digest, first, gone) of rows of a located frame that have near duplicates."""
    slim = source.select(locator().alias("at"), F.col(quoted(id_col)).cast("long").alias("id"), text_digest(text_col).alias("digest"), F.col(quoted(text_col)).alias("text"))
    made = over_texts(slim, ["at", "id", "digest"], "text", "fp long, bands array<long>, grams binary, set binary", lambda texts: [sketch(t, k) for t in texts])
    made = stored_from_python(made.withColumn("row", F.monotonically_increasing_id()).withColumn("named", F.col("id").isNotNull()).withColumn("n_grams", (F.octet_length("grams") / 4).cast("long")), "sketches")
    nodes = stored(made.groupBy("named", "set").agg(F.min("row").alias("node"), F.min("fp").alias("fp"), F.min("bands").alias("bands")), "sketch-nodes")
    keys = nodes.select("named", F.posexplode("bands").alias("table", "key"), "node", "fp")
    keyed = keys.select(F.when(F.col("named"), F.col("table")).otherwise(F.col("table") + BANDS).alias("table"), "key", "node", "fp")
    candidates = components(bucket_links(keyed, radius, SHARD_ROWS))
    sets = made.select(F.col("row").alias("node"), "fp", "n_grams", "grams")
    found = components(verified_links(candidates, keyed, sets, similarity, radius, shard_rows, shard_bytes))
    of_set = nodes.select("named", "set", "node").join(found, "node", "left").select("named", "set", F.coalesce("component", "node").alias("component"))
    linked = stored(made.select("named", "set", "at", "id", "digest").join(of_set, ["named", "set"]).select("at", "id", "digest", "component"), "sketch-components")
    firsts = linked.groupBy("component").agg(F.count("*").alias("n"), F.min(F.struct("id", "digest")).alias("first")).where("n > 1")
    return linked.join(firsts, "component").select("at", "id", "digest", "first", (~F.struct("id", "digest").eqNullSafe(F.col("first"))).alias("gone"))


def near_duplicates(docs: DataFrame, k: int = 5, similarity: float = 0.8, radius: int = WIDE_RADIUS, shard_rows: int = SET_ROWS, shard_bytes: int = SET_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(node, digest, component, gone) of documents with near duplicates: Jaccard similarity of k-word shingles of at least `similarity`.

    A null text counts as empty; texts without words are alike; one of any length is compared whole. A
    row is its id and its text's digest, so rows that repeat an id with other texts are compared too:
    `digest` tells them apart, `gone` is false for the first of a component, by id and digest. Rows
    without an id are compared among themselves, with a null node and component. An empty table gives
    no rows; other columns are ignored.

    Rows of one set of shingles are one node. At such a similarity fingerprints differ in too many
    bits for keys of equal bits, so buckets are made of equal smallest shingle hashes instead; in
    them, BK-trees over the fingerprints select the pairs within the radius. What these join are
    candidate components, whose rows alone send their sets, once, to be confirmed pair by pair, again
    by BK-trees. Every shuffle is linear in the rows but for those of a component larger than a shard
    that aren't similar to its most typical one: they meet all of its shards.
    """
    found = _judged(located(docs), k, similarity, radius, shard_rows, shard_bytes, id_col, text_col)
    return found.select(F.col("id").alias("node"), "digest", F.col("first.id").alias("component"), "gone")


def drop_near_duplicates(docs: DataFrame, k: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without those that are near duplicates of one with a smaller id, of each group; all columns kept.

    Of rows that repeat an id each is judged by its own text, and so are rows with a null id, but
    only among themselves; rows of one id and text stay or go together. A null text is empty; an
    empty table gives no rows. What goes is found by its locator, so texts aren't shuffled where the
    locators are few enough to be broadcast.
    """
    source = located(docs)
    gone = stored(_judged(source, k, similarity, WIDE_RADIUS, SET_ROWS, SET_BYTES, id_col, text_col).where("gone").select("at"), "sketch-gone")
    return without(source, gone).toDF(*docs.columns)
