"""SimHash near-duplicate groups by a generalised pigeonhole search in Hamming space.

1. Fingerprints: XXH64 (seed 42) of every word shingle; a bit is set where over half the hashes set it.
2. Equal fingerprints are one node from here on, so copies cost nothing further.
3. Partition: bits that correlate over all fingerprints are put in the same part (greedily, parts of equal width), for one to
   six parts.
4. Allocation: fingerprints at most ``max_bits`` apart agree, in at least one part, up to that part's threshold whenever
   the thresholds t_i >= -1 satisfy sum(t_i + 1) = max_bits + 1 (-1: the part is not probed). The cheapest allocation is found by
   dynamic programming over parts; its costs are the keys written and the candidates expected: pairs that share a
   part's value are counted exactly over all fingerprints, and scaled to t_i > 0 by the bits' mismatch rates.
5. Probe and verify: each fingerprint is written under the values within ceil(t/2) bits of its parts' own, so that two
   within t bits meet; a key's fingerprints are compared in full and give a minimum spanning forest of the links, never all pairs.
   A key shared by more than ``GROUP`` fingerprints is not gathered. For one or two bits its members are regrouped by the
   values within one bit of the whole fingerprint, where linked ones meet and at most 65 can; for more bits they are
   dealt to blocks, and each two blocks are compared in a task of their own.
6. Connected components by star contraction; a component is named by its smallest ``doc_id``.

``similar_groups`` links texts by the Jaccard similarity of their word shingles, without fingerprints: a prefix-filtered set join that finds
the pairs whatever the distance of their fingerprints.

Defined results: null and word-free texts have fingerprint zero, linked like any other; rows with a null ``doc_id`` are
reported, and a component of null ids only has a null ``component_id``; very long texts are read whole; a bit set in exactly half the
hashes is 0; repeated rows are reported each; an empty table gives no rows; columns other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .minhash import links_in_blocks, match_threshold, packed, signature
from .storage import materialize, read_table

BITS = 64
GROUP = 256
PARTS = range(1, 7)
KEY_COST = 300  # of writing a key, in pairs compared
MISS = 1e-12  # probability that signatures pass over a similar pair
SAMPLE_ROWS, FREQUENT = 50_000, 500_000  # rows looked at for frequent shingles, and how many shingles are kept


def fingerprint(text: str, shingle: int = 3) -> int:
    import xxhash

    words = text.encode().lower().split()  # bytes: A-Z only, and white space is exactly [\x20\x09-\x0D]
    if not words:
        return 0
    digest = xxhash.xxh64_digest
    if len(words) < shingle:
        hashes = digest(b" ".join(words), 42)
    else:
        hashes = b"".join([digest(b" ".join(s), 42) for s in zip(*(words[i:] for i in range(shingle)))])
    bits = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1)
    return int.from_bytes(np.packbits(bits.sum(axis=0, dtype=np.int64) * 2 > len(bits)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``(doc_id long, fp long)``."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([fingerprint(t.as_py() or "", shingle) for t in batch.column("text")], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), found], ["doc_id", "fp"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(scan, "doc_id long, fp long")


def _as_bits(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(fps.astype(">i8").view(np.uint8).reshape(-1, 8), axis=1)[:, ::-1]  # column b is bit b


def bit_statistics(nodes: DataFrame) -> tuple[int, np.ndarray]:
    """How many fingerprints, and for each two bits how many set both: 4,096 sums over all of them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, n = np.zeros((BITS, BITS), np.int64), 0
        for batch in batches:
            bits = _as_bits(batch.column("fp").to_numpy(zero_copy_only=False)).astype(np.float32)
            both, n = both + np.rint(bits.T @ bits).astype(np.int64), n + len(bits)
        values = np.append(both.ravel(), n)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values)), pa.int32()), pa.array(values, pa.int64())], ["at", "n"])

    sums = {r["at"]: r["n"] for r in nodes.select("fp").mapInArrow(count, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()}
    return sums.get(BITS * BITS, 0), np.array([sums.get(i, 0) for i in range(BITS * BITS)]).reshape(BITS, BITS)


def group_bits(n: int, both: np.ndarray, n_parts: int) -> list[list[int]]:
    """Parts of nearly equal width; each starts from the most correlated free pair and takes the bit closest to it."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    free, parts = list(range(BITS)), []
    for left in range(n_parts, 0, -1):
        width = math.ceil(len(free) / left)
        part = list(max(itertools.combinations(free, 2), key=lambda ab: corr[ab])) if width > 1 else [free[0]]
        while len(part) < width:
            part.append(max((b for b in free if b not in part), key=lambda b: corr[b, part].sum()))
        parts.append(sorted(part))
        free = [b for b in free if b not in part]
    return parts


def part_values(fps: np.ndarray, part: list[int]) -> np.ndarray:
    """The bits of a part, packed."""
    return _as_bits(fps)[:, part].astype(np.int64) @ (1 << np.arange(len(part), dtype=np.uint64)).view(np.int64)


def _dealt(nodes: DataFrame, entries: list[tuple[int, list[int], list[int]]]) -> DataFrame:
    """``(part, key, fp)``: for each entry (part's name, its bits, masks) every fingerprint under its part's value with each mask."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column("fp").to_numpy(zero_copy_only=False)
            for name, part, masks in entries:
                values = part_values(fps, part)
                for mask in masks:
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fps), name, np.int32)), pa.array(values ^ mask), batch.column("fp")], ["part", "key", "fp"])

    return nodes.select("fp").mapInArrow(deal, "part int, key long, fp long")


def _sharing_pairs(nodes: DataFrame, plans: dict[int, list[list[int]]]) -> dict[tuple[int, int], float]:
    """Pairs of fingerprints that agree on a whole part, counted over all of them."""
    entries = [(100 * m + i, part, [0]) for m, parts in plans.items() for i, part in enumerate(parts)]
    shared = _dealt(nodes, entries).groupBy("part", "key").count()
    pairs = shared.groupBy("part").agg(F.sum(F.expr("cast(count as double) * (count - 1) / 2")).alias("pairs"))
    return {divmod(r["part"], 100): r["pairs"] for r in pairs.collect()}


def within(rates: np.ndarray, t: int) -> float:
    """P(at most t mismatches) of independent bits with these mismatch rates."""
    dist = np.zeros(t + 1)
    dist[0] = 1.0
    for q in rates:
        dist[1:] = dist[1:] * (1 - q) + dist[:-1] * q
        dist[0] *= 1 - q
    return float(dist.sum())


def ball(width: int, radius: int) -> int:
    return sum(math.comb(width, r) for r in range(radius + 1))


def allocate(costs: list[list[float]], max_bits: int) -> tuple[float, list[int]]:
    """Thresholds with sum(t + 1) = max_bits + 1 at the least total; ``costs[i][t + 1]`` is part i's cost at t."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for part in costs:
        grown: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, ts) in best.items():
            for step in range(min(len(part), max_bits + 2 - used)):
                option = (cost + part[step], [*ts, step - 1])
                if used + step not in grown or option < grown[used + step]:
                    grown[used + step] = option
        best = grown
    return best[max_bits + 1]


def plan_search(nodes: DataFrame, max_bits: int) -> list[tuple[list[int], int]]:
    """The parts to probe, each with its threshold."""
    n, both = bit_statistics(nodes)
    p = np.diag(both) / max(n, 1)
    rates = np.clip(2 * p * (1 - p), 1e-6, 0.5)
    plans = {m: group_bits(n, both, m) for m in PARTS}
    shared = _sharing_pairs(nodes, plans)
    options = []
    for m, parts in plans.items():
        costs = []
        for i, part in enumerate(parts):
            exact, base, row = shared.get((m, i), 0.0), within(rates[part], 0), [0.0]
            for t in range(max_bits + 1):
                row.append(KEY_COST * max(n, 1) * ball(len(part), (t + 1) // 2) + exact * within(rates[part], t) / base + n * n / 2 * within(rates[part], t) * (t > 0))
            costs.append(row)
        cost, ts = allocate(costs, max_bits)
        options.append((cost, m, [(part, t) for part, t in zip(parts, ts) if t >= 0]))
    return min(options)[2]


def _flips(width: int, radius: int) -> list[int]:
    return [sum(1 << b for b in bits) for r in range(radius + 1) for bits in itertools.combinations(range(width), r)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def _keys(nodes: DataFrame, plan: list[tuple[list[int], int]]) -> DataFrame:
    return _dealt(nodes, [(i, part, [*map(_signed, _flips(len(part), (t + 1) // 2))]) for i, (part, t) in enumerate(plan)])


def forest(fps: list[int], max_bits: int) -> list[tuple[int, int]]:
    """Links of one key's fingerprints as a minimum spanning forest: nearest first, as (larger, smaller)."""
    values = np.unique(np.array(fps, dtype=np.int64))
    bits = values.view(np.uint64)
    pairs = []
    for i in range(len(values) - 1):
        far = np.bitwise_count(bits[i + 1 :] ^ bits[i])
        near = np.flatnonzero(far <= max_bits)
        if len(near):
            pairs.append(np.stack([far[near].astype(np.int64), np.full(len(near), i), near + i + 1]))
    if not pairs:
        return []
    root = list(range(len(values)))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    found, every = [], np.concatenate(pairs, axis=1)
    for _, i, j in every[:, np.argsort(every[0], kind="stable")].T.tolist():
        a, b = top(i), top(j)
        if a != b:
            root[max(a, b)] = min(a, b)
            found.append((int(values[j]), int(values[i])))
    return found


def _links(groups: DataFrame, max_bits: int) -> DataFrame:
    mask = (1 << 64) - 1

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            edges: list[tuple[int, int]] = []
            for fps in batch.column("fps").to_pylist():
                if len(fps) == 2:
                    if fps[0] != fps[1] and ((fps[0] ^ fps[1]) & mask).bit_count() <= max_bits:
                        edges.append((fps[0], fps[1]))
                else:
                    edges += forest(fps, max_bits)
            a, b = zip(*edges) if edges else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return groups.where("size(fps) > 1").select("fps").mapInArrow(verify, "a long, b long")


def _blocks(crowded: DataFrame, group: int) -> DataFrame:
    """Members ``(part, key, count, fp)`` of crowded keys, dealt so that every two blocks of a key meet in one group."""
    n = F.ceil(F.col("count") / group).cast("int")
    own = F.pmod(F.xxhash64("fp"), n).cast("int")
    meets = F.transform(F.sequence(F.lit(0), n - 1), lambda other: F.struct(F.least(own, other).alias("low"), F.greatest(own, other).alias("high")))
    return crowded.select("part", "key", F.explode(meets).alias("block"), "fp").groupBy("part", "key", "block").agg(F.collect_list("fp").alias("fps"))


def near_links(nodes: DataFrame, max_bits: int, group: int = GROUP) -> DataFrame:
    """``(a, b)``: a spanning forest, a key, of the links among the distinct fingerprints ``nodes(fp)``."""
    keys = _keys(nodes, plan_search(nodes, max_bits))
    large = materialize(keys.groupBy("part", "key").count().where(F.col("count") > group), "large")
    usual = keys.join(large, ["part", "key"], "left_anti").groupBy("part", "key").agg(F.collect_list("fp").alias("fps"))
    if max_bits <= 2:
        crowded = keys.join(large, ["part", "key"], "left_semi").select("fp").distinct()
        around = [*map(_signed, _flips(BITS, (max_bits + 1) // 2))]
        again = _dealt(crowded, [(0, [*range(BITS)], around)]).groupBy("key").agg(F.collect_list("fp").alias("fps"))
    else:
        again = _blocks(keys.join(large, ["part", "key"]), group)
    return _links(usual.select("fps"), max_bits).union(_links(again.select("fps"), max_bits))


def near_groups(docs: DataFrame, shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """``(doc_id, fp, component_id)``: one row a row of ``docs``."""
    rows = materialize(fingerprints(docs, shingle), "fingerprints")
    nodes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "nodes")
    roots = connected_components(near_links(nodes, max_bits))
    members = roots.union(roots.select("root", "root").distinct())
    named = materialize(members.join(nodes, F.col("node") == F.col("fp")).groupBy("root").agg(F.min("least_id").alias("component_id")), "named")
    linked = materialize(members.join(named, "root").select(F.col("node").alias("fp"), "component_id"), "linked")
    of_fp = nodes.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "least_id").alias("component_id"))
    return rows.join(materialize(of_fp, "components"), "fp").select("doc_id", "fp", "component_id")


def shingle_set(text: str, shingle: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles."""
    import xxhash

    words = text.encode().lower().split()
    digest = xxhash.xxh64_intdigest
    grams = zip(*(words[i:] for i in range(shingle))) if len(words) >= shingle else [words]
    return np.unique(np.fromiter((digest(b" ".join(g)) for g in grams), np.uint64))


def frequent_shingles(docs: DataFrame, shingle: int, rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that recur in a sample of the rows, sorted, and their numbers. They decide the order in a prefix only, never a result."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py() or "", shingle) for t in batch.column("text")]
            grams, n = np.unique(np.concatenate(sets or [np.zeros(0, np.uint64)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64)), pa.array(n, pa.int64())], ["gram", "n"])

    parts = 1 << 40
    sample = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(parts)) < math.ceil(parts * rows / max(docs.count(), 1)))
    counted = sample.select("text").mapInArrow(scan, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).where("n > 2")
    found = counted.orderBy(F.desc("n"), "gram").limit(FREQUENT).toArrow()
    grams, n = found.column("gram").to_numpy().view(np.uint64), found.column("n").to_numpy()
    order = np.argsort(grams)
    return grams[order], n[order]


def prefix(grams: np.ndarray, frequent: tuple[np.ndarray, np.ndarray], similarity: float) -> np.ndarray:
    """The rarest shingles of a set, so many that sets of this similarity share one: all but a number that another set must share a part of."""
    seen, n = frequent
    weight = np.zeros(len(grams), np.int64)
    if len(seen):
        at = np.minimum(np.searchsorted(seen, grams), len(seen) - 1)
        weight = np.where(seen[at] == grams, n[at], 0)
    return grams[np.lexsort((grams, weight))[: len(grams) - math.ceil(similarity * len(grams) - 1e-6) + 1]]


def _prefixes(docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """``(key, id, at, size)``: each shingle in a document's prefix with its place there, and the size of the document's set."""
    frequent = frequent_shingles(docs, shingle)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py() or "", shingle) for t in batch.column("text")]
            keys = [prefix(grams, frequent, similarity) for grams in sets]
            lengths = np.array([*map(len, keys)], np.int64)
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            at = np.concatenate([np.arange(n, dtype=np.int32) for n in lengths] or [np.zeros(0, np.int32)])
            columns = [np.concatenate(keys or [np.zeros(0, np.uint64)]).view(np.int64), np.repeat(ids, lengths), at, np.repeat(np.array([*map(len, sets)], np.int32), lengths)]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0]), pa.array(columns[1], pa.int64()), *map(pa.array, columns[2:])], ["key", "id", "at", "size"])

    return docs.select("doc_id", "text").mapInArrow(scan, "key long, id long, at int, size int")


def _overlap(similarity: float):
    """How many shingles the sets a and b must share."""
    return F.ceil(similarity / (1 + similarity) * (F.col("a_size") + F.col("b_size")) - 1e-6)


def _can_meet(similarity: float):
    """Whether a shingle at these places can be the first that similar sets share: both must have as many left as they must share."""
    return F.least(F.col("a_size") - F.col("a_at"), F.col("b_size") - F.col("b_at")) >= _overlap(similarity)


def _least_shared(similarity: float):
    """How many shingles of their prefixes similar sets share at least: up to the end of the prefix that ends first all shared ones lie in both, and
    that set has only ``ceil(similarity * size) - 1`` others."""
    return _overlap(similarity) - F.ceil(similarity * F.greatest("a_size", "b_size") - 1e-6) + 1


def _likely_stars(shared: DataFrame, similarity: float) -> DataFrame:
    """``(a, b)``: documents with the smallest id of one of their keys, where the keys of which it is the smallest make similarity likely."""
    first = shared.groupBy("key").agg(F.min(F.struct("id", "at", "size")).alias("f")).select("key", F.col("f.id").alias("b"), F.col("f.at").alias("b_at"), F.col("f.size").alias("b_size"))
    meets = shared.toDF("key", "a", "a_at", "a_size").join(first, "key").where("a != b")
    counted = meets.groupBy("a", "a_size", "b", "b_size").agg(F.count(F.lit(1)).alias("n"), F.max(_can_meet(similarity)).alias("can"))
    return counted.where(F.col("can") & (F.col("n") >= _least_shared(similarity))).select("a", "b").distinct()


def _shingle_sets(docs: DataFrame, shingle: int) -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py() or "", shingle).tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sets, pa.binary())], ["doc_id", "grams"])

    return docs.select("doc_id", "text").mapInArrow(scan, "doc_id long, grams binary")


def _similar(pairs: DataFrame, similarity: float) -> DataFrame:
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= similarity * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("a", "b", "x", "y").mapInArrow(check, "a long, b long")


def _verified(docs: DataFrame, pairs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The ``pairs(a, b)`` of ids whose texts are similar."""
    involved = pairs.select("a").union(pairs.select("b")).distinct().toDF("involved")
    sets = materialize(_shingle_sets(docs.join(involved, docs["doc_id"] == involved["involved"], "left_semi"), shingle), "sets")
    return materialize(_similar(pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b"), similarity).distinct(), "verified")


def _sketched_sets(docs: DataFrame, ids: DataFrame, shingle: int) -> DataFrame:
    """``(node, size, signature, grams)`` of the documents ``ids(node)``."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py() or "", shingle) for t in batch.column("text")]
            signatures = [signature(g).view(np.int32).tolist() for g in sets]
            columns = [batch.column("doc_id"), pa.array([*map(len, sets)], pa.int64()), pa.array(signatures, pa.list_(pa.int32())), pa.array([*map(packed, sets)], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["node", "size", "signature", "grams"])

    wanted = docs.join(ids, docs["doc_id"] == ids["node"], "left_semi").select("doc_id", "text")
    return materialize(wanted.mapInArrow(scan, "node long, size long, signature array<int>, grams binary"), "sketched")


def similar_groups(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """``(node, root)`` of ids: every document linked to a smaller one, with the smallest of its group.

    Links are pairs of documents whose sets of word shingles have at least this Jaccard similarity (in whole per cent). Sets so similar share
    a shingle of their prefixes, and at the first one both have as many left as they must share. A document is first compared to the smallest ids of
    its keys where their shared keys make it likely. The keys that hold more than one group by then are gathered by their pivot, the document that shares most
    keys; what they hold is compared block by block, whole sets against whole sets, but for pairs whose MinHash signatures agree too rarely, which passes
    over a similar pair with a probability below ``MISS``. So no pair that could change a group is left out, and no key's pairs are written out. Rows with a
    null ``doc_id`` are never linked; an id's rows are one document, linked where any of its texts is.
    """
    docs, percent = docs.where("doc_id IS NOT NULL").selectExpr("cast(doc_id as long) doc_id", "text"), round(100 * similarity)
    keys = materialize(_prefixes(docs, shingle, similarity), "keys")
    shared = materialize(keys.join(keys.groupBy("key").count().where("count > 1").select("key"), "key"), "shared")
    links = _verified(docs, materialize(_likely_stars(shared, similarity), "stars"), shingle, similarity)
    weights = shared.groupBy("id").agg(F.count(F.lit(1)).alias("weight"))
    named = shared.join(connected_components(links), F.col("id") == F.col("node"), "left").select("key", "id", F.coalesce("root", "id").alias("root"))
    named = materialize(named.join(weights, "id"), "named")
    pivot = F.max(F.struct("weight", "id"))["id"].alias("pivot")
    several = named.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), pivot).where("low < high")
    groups = materialize(named.join(several.select("key", "pivot"), "key").select("pivot", F.col("id").alias("node"), "root").distinct(), "apart")
    full = _sketched_sets(docs, groups.select("node").distinct(), shingle)
    return connected_components(links.union(links_in_blocks(groups, full, lambda wanted: full.join(wanted, "node", "left_semi").select("node", "grams"), percent, match_threshold(percent, miss=MISS))))


def query(spark, sf_dir: str) -> DataFrame:
    groups = near_groups(read_table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
