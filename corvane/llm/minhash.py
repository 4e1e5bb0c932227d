"""MinHash near-duplicate groups by an inverted join on signature coordinates.

1. Sets: the distinct word shingles of a text as 64-bit hashes. Equal sets are one node, so copies cost nothing further.
2. Signatures: for each of ``COORDINATES`` random permutations the least image of the set, 32 bits. Two sets agree on a coordinate with
   probability of their Jaccard similarity. The match threshold is the most coordinates for which a pair exactly at the wanted similarity
   falls short with a probability of at most ``MISS``.
3. Inverted join: a node is posted under its (coordinate, value) pairs. Values that one node alone has are counted and never posted.
4. Prefix: in the order of how many nodes share a pair, rarest first, nodes with ``m`` of ``k`` coordinates in common share one of the first
   ``k - m + 1`` of each. Only those are merged; the long lists behind them are skipped, and the collisions there are counted by
   comparing the two signatures.
5. Each list is first merged against its pivot, the node whose pairs are shared most often, which is the middle of a group of copies. Survivors of the
   match threshold are confirmed on the full sets and give groups. A list whose nodes are by then in one group needs nothing more. The others are
   gathered by their pivot, so that the many lists of one group count once; their nodes are dealt to blocks, any two blocks meet in one row, and
   signatures tell which nodes have a partner in another group above the threshold. Only those meet again with their full sets, to be confirmed. So no link that joins two groups is left
   out, and no list's pairs are ever written out. Confirming reads texts again, which a bitmap of fixed size picks, so that no text is shuffled.
6. Connected components; a component is named by its smallest ``doc_id``.

Defined results: null and word-free texts have an empty set, linked with nothing, not even with each other; fewer words than a shingle give the whole
sequence as the only shingle; rows with a null ``doc_id`` are reported, and a component of null ids only has a null ``component_id`` (and is ``kept``);
rows that repeat an id are reported each, by their own text; very long texts are read whole; an empty table gives no rows; columns other than
``doc_id`` and ``text`` are ignored. Sets are told apart by a 64-bit hash; within a pair shingles are compared by 40 bits.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .storage import materialize, read_table
from .workers import fresh

COORDINATES = 64
MISS = 1e-7
BLOCK, BLOCK_SHINGLES = 512, 4_000_000  # nodes compared at once, and the shingles they have
SLICE = 1024  # shingles hashed at once
BITS, WORD = 1 << 24, 1 << 15  # of the bitmap that tells which texts are read again: 2 MB whatever the input; of a row of Spark's bitmaps


def shingle_set(text: str, shingle: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; empty without words."""
    import xxhash

    words = text.encode().lower().split()  # bytes: A-Z only, and white space is exactly [\x20\x09-\x0D]
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh3_64_digest
    grams = zip(*(words[i:] for i in range(shingle))) if len(words) >= shingle else [words]
    return np.unique(np.frombuffer(b"".join([digest(b" ".join(g)) for g in grams]), ">u8").astype(np.uint64))


@functools.cache
def permutations(coordinates: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each permutation x -> (x ^ mask) * factor modulo 2**32 the mask and the odd factor."""
    rng = np.random.default_rng(coordinates)
    return rng.integers(0, 1 << 32, coordinates, np.uint32), rng.integers(0, 1 << 32, coordinates, np.uint32) | np.uint32(1)


def signature(grams: np.ndarray, coordinates: int = COORDINATES) -> np.ndarray:
    masks, factors = permutations(coordinates)
    least = np.full(coordinates, 0xFFFFFFFF, np.uint32)
    high = (grams >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(high), SLICE):
        images = high[i : i + SLICE, None] ^ masks
        np.multiply(images, factors, out=images)
        np.minimum(least, images.min(axis=0), out=least)
    return least


def match_threshold(percent: int, coordinates: int = COORDINATES, miss: float = MISS) -> int:
    """The most matches m with P(fewer than m of the coordinates agree) <= miss for sets at this similarity."""
    p, below, m = percent / 100, 0.0, 0
    while m < coordinates and below + (term := math.comb(coordinates, m) * p**m * (1 - p) ** (coordinates - m)) <= miss:
        below, m = below + term, m + 1
    return max(m, 1)


def _signed(digest: int) -> int:
    return digest - (1 << 64) if digest >> 63 else digest


def sketches(docs: DataFrame, shingle: int, coordinates: int) -> DataFrame:
    """``(doc_id, node, size, signature)``, a row a row of ``docs``; no node for an empty set."""
    import xxhash

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh()
        for batch in batches:
            sets = [shingle_set(t.as_py() or "", shingle) for t in batch.column("text")]
            nodes = [_signed(xxhash.xxh3_64_intdigest(g.tobytes())) if len(g) else None for g in sets]
            flat = np.concatenate([signature(g, coordinates) for g in sets]) if sets else np.zeros(0, np.uint32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * coordinates), pa.array(flat.view(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(nodes, pa.int64()), pa.array([*map(len, sets)], pa.int64()), lists], ["doc_id", "node", "size", "signature"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(scan, "doc_id long, node long, size long, signature array<int>")


def prefix_posts(nodes: DataFrame, coordinates: int, matches: int) -> DataFrame:
    """``(key, node, weight)``: of each node the rarest shared pairs among its first ``coordinates - matches + 1``; its weight is how often all its pairs are shared."""
    key = F.shiftleft(F.col("pos").cast("long"), 32) + F.col("col").cast("long").bitwiseAND(F.lit(0xFFFFFFFF))
    posts = nodes.select("node", F.posexplode("signature")).select("node", key.alias("key"))
    shared = posts.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    own = posts.join(shared, "key").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("n", "key"))).alias("own"))  # at most one entry a coordinate
    room = F.lit(coordinates - matches + 1) - (F.lit(coordinates) - F.size("own"))
    weight = F.aggregate("own", F.lit(0).cast("long"), lambda total, e: total + e["n"])
    posted = own.where(room > 0).select("node", weight.alias("weight"), F.explode(F.slice("own", F.lit(1), room)).alias("e"))
    return posted.select(F.col("e.key").alias("key"), "node", "weight")


def _values(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _matching(pairs: DataFrame, nodes: DataFrame, percent: int, matches: int) -> DataFrame:
    """The ``pairs(a, b)`` whose sizes allow the similarity and whose signatures agree often enough."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                yield batch.select(["a", "b"]).filter(pa.array((_values(batch.column("x")) == _values(batch.column("y"))).sum(axis=1) >= matches))

    a, b = nodes.select("node", "size", "signature").toDF("a", "a_size", "x"), nodes.select("node", "size", "signature").toDF("b", "b_size", "y")
    fit = F.least("a_size", "b_size") * 100 >= F.greatest("a_size", "b_size") * percent
    return pairs.join(a, "a").join(b, "b").where(fit).select("a", "b", "x", "y").mapInArrow(count, "a long, b long")


def _marked(nodes: DataFrame) -> np.ndarray:
    """Bits of the hashed ids of ``nodes(least_id)``; the last one tells of a null id. Many ids only fill it, so that more texts than needed are read."""
    at = F.coalesce(F.pmod(F.xxhash64("least_id"), F.lit(BITS)), F.lit(BITS))
    marks = nodes.where("least_id IS NOT NULL").select(at.alias("at")).union(nodes.where("least_id IS NULL").limit(1).select(F.lit(BITS).cast("long")))
    words = marks.groupBy(F.floor(F.col("at") / WORD).alias("word")).agg(F.bitmap_construct_agg(F.col("at") % WORD).alias("bits"))
    bits = np.zeros(BITS // 8 + WORD // 8, np.uint8)
    for r in words.collect():  # at most BITS / WORD + 1 rows of 4 KB
        bits[r["word"] * (WORD // 8) : (r["word"] + 1) * (WORD // 8)] = np.frombuffer(r["bits"], np.uint8)
    return bits


def packed(grams: np.ndarray) -> bytes:
    """The upper 40 bits of sorted 64-bit hashes: within two sets they are as good as distinct."""
    return (grams >> np.uint64(24)).astype(">u8").view(np.uint8).reshape(-1, 8)[:, 3:].tobytes()


def _unpacked(packed: bytes) -> np.ndarray:
    out = np.zeros((len(packed) // 5, 8), np.uint8)
    out[:, 3:] = np.frombuffer(packed, np.uint8).reshape(-1, 5)
    return out.view(">u8").ravel().astype(np.uint64)


def _similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _full_sets(docs: DataFrame, nodes: DataFrame, shingle: int) -> DataFrame:
    """``(node, grams)`` of at least the ``nodes(node, least_id)``, by reading their texts again; no text is shuffled."""
    import xxhash

    bits = _marked(nodes)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("at").to_numpy(zero_copy_only=False)
            wanted = batch.column("text").filter(pa.array((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1))
            sets = [shingle_set(t.as_py() or "", shingle) for t in wanted]
            yield pa.RecordBatch.from_arrays([pa.array([_signed(xxhash.xxh3_64_intdigest(g.tobytes())) for g in sets], pa.int64()), pa.array([*map(packed, sets)], pa.binary())], ["node", "grams"])

    at = F.when(F.col("doc_id").isNull(), F.lit(BITS)).otherwise(F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(BITS)))
    return docs.select("text", at.cast("long").alias("at")).mapInArrow(scan, "node long, grams binary")


def _confirmed(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The ``pairs(a, b)`` whose full sets are similar."""

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                keep.append(_similar(_unpacked(x.as_py()), _unpacked(y.as_py()), percent))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    pairs = materialize(pairs, "pairs")
    if pairs.isEmpty():
        return pairs
    wanted = pairs.select("a").union(pairs.select("b")).distinct().toDF("node")
    sets = materialize(_full_sets(docs, nodes.select("node", "least_id").join(wanted, "node", "left_semi"), shingle), "sets").groupBy("node").agg(F.first("grams").alias("grams"))
    joined = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
    return materialize(joined.select("a", "b", "x", "y").mapInArrow(confirm, "a long, b long"), "links")




def _pivot() -> Column:
    return F.max(F.struct("weight", "node"))["node"]


def _pivot_pairs(posts: DataFrame) -> DataFrame:
    """``(a, b)``: the nodes of ``posts(key, node, weight)`` with the pivot of their list."""
    met = posts.join(posts.groupBy("key").agg(_pivot().alias("b")), "key").where("node != b")
    return met.select(F.greatest("node", "b").alias("a"), F.least("node", "b").alias("b")).distinct()


def _apart(posts: DataFrame, links: DataFrame) -> DataFrame:
    """``(pivot, node, root)``: the nodes of all lists that share a pivot and hold more than one group besides it, with which all have been compared."""
    named = posts.join(connected_components(links), "node", "left").select("key", "node", "weight", F.coalesce("root", "node").alias("root"))
    named = materialize(named, "named")
    others = named.join(named.groupBy("key").agg(_pivot().alias("pivot")), "key").where("node != pivot")
    several = others.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
    return materialize(others.join(several, "key").select("pivot", "node", "root").distinct(), "apart")


def _near(root: np.ndarray, size: np.ndarray, seen: np.ndarray, own: np.ndarray, crossed: bool, percent: int, matches: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each node outside the largest group, with the nodes of other roots whose signatures agree often enough, the likeliest first. ``root`` may change on the
    way. ``crossed``: only between the two values of ``own``."""
    roots, counts = np.unique(root, return_counts=True)
    rest, places = root != roots[counts.argmax()], np.arange(len(root))  # pairs within the largest group are linked already
    for at in np.flatnonzero(rest):
        others = np.flatnonzero((~rest | (places > at)) & (root != root[at]) & ((own != own[at]) | (not crossed)))
        others = others[100 * np.minimum(size[others], size[at]) >= percent * np.maximum(size[others], size[at])]
        agree = (seen[others] == seen[at]).sum(axis=1)
        if n := int((agree >= matches).sum()):
            yield at, others[np.argsort(-agree, kind="stable")][:n]


def _blocks(groups: DataFrame, held: DataFrame, block: int) -> DataFrame:
    """``(pivot, low, high, members)``: the nodes of each group dealt to blocks of bounded size, a row for any two; ``held`` has what a member carries."""
    sized = groups.join(held.select("node", "size"), "node")
    blocks = sized.groupBy("pivot").agg(F.ceil(F.greatest(F.count(F.lit(1)) / block, F.sum("size") / BLOCK_SHINGLES)).cast("int").alias("n"))
    own = F.pmod(F.xxhash64("node"), F.col("n")).cast("int")
    meets = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda other: F.struct(F.least(own, other).alias("low"), F.greatest(own, other).alias("high"), (own > other).cast("int").alias("own")))
    dealt = groups.join(blocks, "pivot").select("pivot", "node", "root", F.explode(meets).alias("m"))
    member = F.struct("root", F.col("m.own").alias("own"), *held.columns)
    rows = dealt.join(held, "node").groupBy("pivot", F.col("m.low").alias("low"), F.col("m.high").alias("high")).agg(F.collect_list(member).alias("members"))
    return rows.where("size(members) > 1")


def _members(batch: pa.RecordBatch) -> Iterator[tuple]:
    for i in range(len(batch)):
        members = batch.column("members")[i].values
        node, root, size, own = (members.field(c).to_numpy(zero_copy_only=False) for c in ("node", "root", "size", "own"))
        yield i, members, node, (root.copy(), size, _values(members.field("signature")), own, batch.column("low")[i].as_py() != batch.column("high")[i].as_py())


def links_in_blocks(groups: DataFrame, sketches: DataFrame, sets_of: Callable[[DataFrame], DataFrame], percent: int, matches: int, block: int = BLOCK) -> DataFrame:
    """``(a, b)``: links between different roots of ``groups(pivot, node, root)``, by ``sketches(node, size, signature)``. Members that some signature of their
    group suits are found first; only their sets ``sets_of(nodes)``, as ``(node, grams)``, move. A row of blocks gives a spanning forest of its links at most."""

    def suit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, _, node, told in _members(batch):
                found = [x for at, near in _near(*told, percent, matches) for x in (at, *near)]
                nodes = node[np.unique(np.array(found, np.int64))]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(nodes), batch.column("pivot")[i].as_py(), np.int64)), pa.array(nodes, pa.int64())], ["pivot", "node"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links: list[tuple[int, int]] = []
            for _, members, node, told in _members(batch):
                sets, root = members.field("grams").to_pylist(), told[0]
                unpacked = functools.cache(lambda i, sets=sets: _unpacked(sets[i]))
                for at, near in _near(*told, percent, matches):
                    for i in near:
                        if root[i] != root[at] and _similar(unpacked(at), unpacked(i), percent):
                            links.append((max(int(node[i]), int(node[at])), min(int(node[i]), int(node[at]))))
                            root[root == root[i]] = root[at]
            a, b = zip(*links) if links else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    held = sketches.select("node", "size", "signature")
    suited = materialize(_blocks(groups, held, block).select("pivot", "low", "high", "members").mapInArrow(suit, "pivot long, node long").distinct(), "suited")
    wanted = suited.select("node").distinct()
    if wanted.isEmpty():
        return wanted.selectExpr("node a", "node b")
    rows = _blocks(groups.join(suited, ["pivot", "node"]), held.join(sets_of(wanted), "node"), block)
    return materialize(rows.select("low", "high", "members").mapInArrow(compare, "a long, b long").distinct(), "across")


def _across(groups: DataFrame, docs: DataFrame, nodes: DataFrame, shingle: int, percent: int, matches: int, block: int) -> DataFrame:
    def sets_of(wanted: DataFrame) -> DataFrame:
        held = nodes.select("node", "least_id").join(wanted, "node", "left_semi")
        return materialize(_full_sets(docs, held, shingle), "sets").groupBy("node").agg(F.first("grams").alias("grams"))

    return links_in_blocks(groups, nodes, sets_of, percent, matches, block)


def _named_by_id(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``(node, component_id)``: the smallest id of a node's component."""
    roots = connected_components(links)
    linked = roots.union(roots.select("root", "root").distinct()).join(nodes.select("node", "least_id"), "node")
    least = linked.groupBy("root").agg(F.min("least_id").alias("component_id"))
    linked = materialize(linked.join(least, "root").select("node", "component_id"), "components")
    return materialize(nodes.join(linked, "node", "left").select("node", F.coalesce("component_id", "least_id").alias("component_id")), "ids")


def minhash_groups(docs: DataFrame, shingle: int = 2, percent: int = 80, coordinates: int = COORDINATES, miss: float = MISS, block: int = BLOCK) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)``: one row a row of ``docs``. Linked: 100 * intersection >= percent * union."""
    matches = match_threshold(percent, coordinates, miss)
    rows = materialize(sketches(docs, shingle, coordinates), "sketches")
    held = rows.where("node IS NOT NULL")
    nodes = materialize(held.groupBy("node").agg(F.min("doc_id").alias("least_id"), F.first("size").alias("size"), F.first("signature").alias("signature")), "nodes")
    # sets that differ and are this similar share percent / (100 - percent) shingles at least
    linkable = nodes.where(F.col("size") * (100 - percent) >= percent)
    posts = materialize(prefix_posts(linkable, coordinates, matches), "posts")
    links = _confirmed(_matching(_pivot_pairs(posts), nodes, percent, matches), docs, nodes, shingle, percent)
    links = links.union(_across(_apart(posts, links), docs, nodes, shingle, percent, matches, block))
    found = rows.join(_named_by_id(nodes, links), "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return found.select("doc_id", F.col("size").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def query(spark, sf_dir: str) -> DataFrame:
    return minhash_groups(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


#: Every two documents that share a shingle, and the components of the links.
SQL = r"""
WITH RECURSIVE words AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), sets AS (
  SELECT row, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w
    ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s
  FROM words
), grams AS (SELECT row, len(s) AS n, unnest(s) AS g FROM sets),
shared AS (
  SELECT a.row AS a, b.row AS b, any_value(a.n) AS an, any_value(b.n) AS bn, count(*) AS c
  FROM grams a JOIN grams b ON a.g = b.g AND a.row != b.row AND 100 * a.n >= 80 * b.n AND 100 * b.n >= 80 * a.n GROUP BY ALL
), links AS MATERIALIZED (SELECT a, b FROM shared WHERE 100 * c >= 80 * (an + bn - c)),
reach AS (SELECT row, row AS other FROM sets UNION SELECT r.row, l.b FROM reach r JOIN links l ON r.other = l.a)
SELECT s.doc_id, len(s.s) AS n_shingles, m.component_id, s.doc_id = m.component_id AS kept
FROM sets s JOIN (SELECT r.row, min(o.doc_id) AS component_id FROM reach r JOIN sets o ON r.other = o.row GROUP BY 1) m ON m.row = s.row
"""
