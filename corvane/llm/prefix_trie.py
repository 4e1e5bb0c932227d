"""The prefix trie of conversations: nodes, members and subtree sums, by polynomial fingerprints of prefixes.

1. Turns are numbered by a segmented prefix scan: rows are sorted by ranges of (conversation, turn), numpy scans each block, and what
   a conversation brings into a block from earlier ones is added from the blocks' sums. So a conversation of any length is cut anywhere.
2. Rebuilding: conversation c starts with the first h turns of conversation c - c % 100 and goes on with its own from turn h + 1 on;
   h = crc32(decimal c) % 6. Turns are carried as references (conversation, number) with a hash and a length, never as texts.
3. Fingerprints: F(d) = sum of hash(i) * base ** i over the first d turns, modulo two primes below 2**31, by the same scan.
4. Prefixes of equal depth and fingerprint are a group, whose representative is the smallest conversation. Every member is compared with it, turn and text,
   at its depth, and must come from the same group one turn before. Members that fail split off to a group of their own, until none fails: so by
   induction a group is one sequence. Members that refer to the representative's own turn are equal without reading the text.
5. Roll-up without walking levels. A conversation owns the nodes whose smallest member it is; these are the end of its path. So a subtree's sum is, over
   the members of its top, the sum of each one's own nodes at that depth or below (a scan along its path), and its leaves are the members
   that own a childless node. A prefix that one conversation alone has needs no sum.
6. The hash of the members that end at a node runs over their sorted ids in pieces, joined block by block and streamed.

Defined results: rows with a null ``conv_id`` take no part; null role or text is empty; a null turn comes first; equal turns are ordered by role, then text (of
equal rows each counts); ``%`` keeps the sign of ``conv_id``; very long texts are read whole; a conversation without turns after rebuilding is a member of the
root alone; an empty table has no root and gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import fresh_name, materialize, read_table

HEADS = 6  # a conversation takes fewer first turns from the start of its hundred
PRIMES, BASES = (2147483647, 2147483629), (1_103_515_245, 1_664_525_011)
PIECE = 4096  # ids joined to one piece of text
NO_IDS = hashlib.sha256(b"").hexdigest()


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _runs(keys: np.ndarray, values: np.ndarray, last: int | None, carry: np.ndarray, modulus: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Inclusive sums of the rows of ``values`` within runs of equal keys, the first run going on from ``carry`` if its key is ``last``; and the last sums."""
    total = np.cumsum(values, axis=0)
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    before = np.where(starts[:, None] > 0, total[starts - 1], 0)
    if last is not None and keys[0] == last:
        before[0] -= carry
    total -= np.repeat(before, np.diff(np.append(starts, len(keys))), axis=0)
    if modulus is not None:
        total %= modulus
    return total, total[-1]


def segmented_scan(rows: DataFrame, key: str, order: list[Column], values: list[str], modulus: tuple[int, ...] | None = None) -> DataFrame:
    """``rows`` with ``<value>_sum``: the inclusive running sum (modulo ``modulus``, then of values below 2**31) of each long column within ``key``.

    Range partitions cut long segments. What they bring along is known from one sum a block and segment, of segments that lie in several blocks
    only: at most two a block.
    """
    names, kept = [f"{v}_sum" for v in values], rows.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + "".join(f", {n} long" for n in names) + ", block int"
    mod = None if modulus is None else np.array(modulus, np.int64)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, last, carry = TaskContext.get().partitionId(), None, np.zeros(len(values), np.int64)
        for batch in batches:
            if not len(batch):
                continue
            keys = batch.column(key).to_numpy(zero_copy_only=False)
            summed, carry = _runs(keys, np.stack([batch.column(v).to_numpy(zero_copy_only=False) for v in values], axis=1), last, carry, mod)
            last = int(keys[-1])
            columns = [*batch.columns, *(pa.array(np.ascontiguousarray(c)) for c in summed.T), pa.array(np.full(len(keys), block, np.int32))]
            yield pa.RecordBatch.from_arrays(columns, [*kept, *names, "block"])

    sorted_rows = rows.repartitionByRange(_partitions(rows), key, *order).sortWithinPartitions(key, *order)
    local = materialize(sorted_rows.mapInArrow(scan, schema), "scanned")
    segment, at = fresh_name("segment", local.columns), fresh_name("at_block", local.columns)
    cut = local.groupBy(F.col(key).alias(segment)).agg(F.min("block").alias("low"), F.max("block").alias("high")).where("low < high").select(segment)
    sums = local.join(cut, local[key] == cut[segment], "left_semi").groupBy(F.col(key).alias(segment), F.col("block").alias(at)).agg(*[F.sum(v).alias(f"{v}_carry") for v in values])
    later = sums.select(segment, F.col(at).alias("from"), *[f"{v}_carry" for v in values])
    carried = sums.select(segment, at).join(later, segment).where(F.col("from") < F.col(at)).groupBy(segment, at).agg(*[F.sum(f"{v}_carry").alias(f"{v}_carry") for v in values])
    joined = local.join(carried, (local[key] == carried[segment]) & (local["block"] == carried[at]), "left")
    whole = [F.col(n) + F.coalesce(F.col(f"{v}_carry"), F.lit(0)) for n, v in zip(names, values)]
    if modulus is not None:
        whole = [F.pmod(w, F.lit(m)) for w, m in zip(whole, modulus)]
    return joined.select(*[F.col(f"`{c}`") for c in kept], *[w.alias(n) for w, n in zip(whole, names)])


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """``(conv_id, j, role, text, hash, len)``: turns numbered from 1."""
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.lit(1).cast("long").alias("one")
    )
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    numbered = segmented_scan(turns, "conv_id", order, ["one"])
    return numbered.select("conv_id", F.col("one_sum").alias("j"), "role", "text", F.xxhash64("role", "text").alias("hash"), F.length("text").cast("long").alias("len"))


def rebuilt(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """``(conv_id, pos, src_conv, src_j, hash, len)``: each turn of the rebuilt conversations ``(conv_id, base, heads, taken)``."""
    own = turns.select("conv_id", "j", "hash", "len")
    mine = own.join(conversations, "conv_id").where("j > heads").select("conv_id", (F.col("taken") + F.col("j") - F.col("heads")).alias("pos"), F.col("conv_id").alias("src_conv"), F.col("j").alias("src_j"), "hash", "len")
    first = own.where((F.col("j") < HEADS) & (F.col("conv_id") % 100 == 0)).withColumnRenamed("conv_id", "base")
    taken = first.join(conversations.select("conv_id", "base", "heads"), "base").where("j <= heads").select("conv_id", F.col("j").alias("pos"), F.col("base").alias("src_conv"), F.col("j").alias("src_j"), "hash", "len")
    return mine.unionByName(taken)


def rebuilding_plan(turns: DataFrame) -> DataFrame:
    """``(conv_id, base, heads, taken, turns)``: how many first turns a conversation gives up, how many it gets for them, how many it has then."""
    counts = materialize(turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")), "counts")
    heads = F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(HEADS))
    plan = counts.select("conv_id", "n", (F.col("conv_id") - F.col("conv_id") % 100).alias("base"), heads.alias("heads"))
    plan = plan.join(counts.toDF("base", "n_base"), "base", "left")
    taken = F.least("heads", F.coalesce("n_base", F.lit(0)))
    return plan.select("conv_id", "base", "heads", taken.alias("taken"), (taken + F.greatest(F.col("n") - F.col("heads"), F.lit(0))).alias("turns"))


def powers(base: int, exponents: np.ndarray, prime: int) -> np.ndarray:
    """``base ** exponents`` modulo a prime below 2**31, by squaring."""
    out, square, left = np.ones(len(exponents), np.int64), base % prime, exponents.copy()
    while left.any():
        out = np.where(left & 1, out * square % prime, out)
        square, left = square * square % prime, left >> 1
    return out


def fingerprints(rows: DataFrame, primes: tuple[int, int] = PRIMES) -> DataFrame:
    """``rows`` with ``fp`` of the prefix up to each turn and ``prev_fp`` of the one before (0 for the root)."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", g1 long, g2 long"

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, at = batch.column("hash").to_numpy(zero_copy_only=False).view(np.uint64), batch.column("pos").to_numpy(zero_copy_only=False)
            parts = ((hashes >> np.uint64(32)).astype(np.int64), (hashes & np.uint64(0xFFFFFFFF)).astype(np.int64))
            terms = [h % p * powers(b, at, p) % p for h, b, p in zip(parts, BASES, primes)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, terms)], [*batch.schema.names, "g1", "g2"])

    scanned = segmented_scan(rows.mapInArrow(weigh, schema), "conv_id", [F.col("pos")], ["g1", "g2"], primes)
    before = [F.pmod(F.col(f"g{i}_sum") - F.col(f"g{i}"), F.lit(p)) for i, p in zip((1, 2), primes)]
    joined = lambda x, y: x * F.lit(1 << 31) + y
    return scanned.select("conv_id", "pos", "src_conv", "src_j", "len", joined(F.col("g1_sum"), F.col("g2_sum")).alias("fp"), joined(*before).alias("prev_fp"))


def _failing(named: DataFrame, turns: DataFrame) -> DataFrame:
    """``(conv_id, pos)`` of ``named(conv_id, pos, src_conv, src_j, fp, split, prev_fp, prev_split, rep)`` that are not their representative's sequence."""
    held = ["pos", "src_conv", "src_j", "prev_fp", "prev_split"]
    first = named.where("conv_id = rep").select(F.col("rep").alias("r"), *[F.col(c).alias(f"r_{c}") for c in held])
    met = named.where("conv_id != rep").join(first, (F.col("rep") == F.col("r")) & (F.col("pos") == F.col("r_pos")))
    apart = met.where("prev_fp != r_prev_fp OR prev_split != r_prev_split").select("conv_id", "pos")
    other = met.where("prev_fp = r_prev_fp AND prev_split = r_prev_split AND (src_conv != r_src_conv OR src_j != r_src_j)")
    mine = turns.select(F.col("conv_id").alias("src_conv"), F.col("j").alias("src_j"), "role", "text")
    theirs = mine.toDF("r_src_conv", "r_src_j", "r_role", "r_text")
    unlike = other.join(mine, ["src_conv", "src_j"]).join(theirs, ["r_src_conv", "r_src_j"]).where("role != r_role OR text != r_text")
    return apart.union(unlike.select("conv_id", "pos"))


def verified_groups(rows: DataFrame, turns: DataFrame) -> DataFrame:
    """``(conv_id, pos, len, rep, n)``: the node of each prefix, named by its smallest member, and how many share it."""
    rows = rows.withColumns({"split": F.lit(0), "prev_split": F.lit(0)})
    while True:
        groups = rows.groupBy("pos", "fp", "split").agg(F.min("conv_id").alias("rep"), F.count(F.lit(1)).alias("n"))
        named = materialize(rows.join(groups, ["pos", "fp", "split"]), "groups")
        failing = materialize(_failing(named.where("n > 1"), turns), "failing")
        if failing.isEmpty():
            return named.select("conv_id", "pos", "len", "rep", "n")
        apart = failing.withColumn("apart", F.lit(1))
        rows = named.drop("rep", "n", "prev_split").join(apart, ["conv_id", "pos"], "left").withColumn("split", F.col("split") + F.coalesce("apart", F.lit(0))).drop("apart")
        before = rows.select("conv_id", (F.col("pos") + 1).alias("pos"), F.col("split").alias("prev_split"))
        rows = rows.join(before, ["conv_id", "pos"], "left").fillna(0, ["prev_split"])


def ends_hashes(ends: DataFrame) -> DataFrame:
    """``(depth, conv_id, ends_sha256)`` of ``ends(depth, rep, conv_id)``: the ids that end at a node, joined in ascending order and hashed."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            depth, rep, ids = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("depth", "rep", "conv_id"))
            starts = np.flatnonzero(np.append(True, (depth[1:] != depth[:-1]) | (rep[1:] != rep[:-1]))) if len(ids) else np.zeros(0, np.int64)
            cuts = sorted({*starts.tolist(), *range(0, len(ids), PIECE)})
            texts = [",".join(map(str, ids[a:b].tolist())) for a, b in zip(cuts, [*cuts[1:], len(ids)])]
            yield pa.RecordBatch.from_arrays([*(pa.array(x[cuts]) for x in (depth, rep, ids)), pa.array(texts)], ["depth", "rep", "first", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, running = None, None
        for batch in batches:
            out = []
            for row in zip(*(batch.column(c).to_pylist() for c in ("depth", "rep", "ids"))):
                if row[:2] != node:
                    if node:
                        out.append((*node, running.hexdigest()))
                    node, running = row[:2], hashlib.sha256()
                else:
                    running.update(b",")
                running.update(row[2].encode())
            yield _node_rows(out)
        if node:
            yield _node_rows([(*node, running.hexdigest())])

    ordered = ends.repartitionByRange(_partitions(ends), "depth", "rep", "conv_id").sortWithinPartitions("depth", "rep", "conv_id")
    joined = ordered.mapInArrow(pieces, "depth long, rep long, first long, ids string")
    return joined.repartition("depth", "rep").sortWithinPartitions("depth", "rep", "first").mapInArrow(hashed, "depth long, conv_id long, ends_sha256 string")


def _node_rows(rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
    depth, node, digest = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(depth, pa.int64()), pa.array(node, pa.int64()), pa.array(digest, pa.string())], ["depth", "conv_id", "ends_sha256"])


def prefix_trie(conversations: DataFrame, primes: tuple[int, int] = PRIMES) -> DataFrame:
    """One row a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    turns = materialize(numbered_turns(conversations), "turns")
    plan = materialize(rebuilding_plan(turns), "plan")
    rows = materialize(fingerprints(rebuilt(turns, plan), primes), "fingerprints")
    members = materialize(verified_groups(rows, turns), "members")
    # the root stands at depth 0; every conversation is a member
    root = plan.agg(F.min("conv_id").alias("rep"), F.count(F.lit(1)).alias("n")).where("n > 0")
    nodes = members.where("conv_id = rep").select(F.col("pos").alias("depth"), F.col("conv_id").alias("node"), "n", "len")
    nodes = nodes.unionByName(root.select(F.lit(0).cast("long").alias("depth"), F.col("rep").alias("node"), "n", F.lit(0).cast("long").alias("len")))
    above = members.select(F.col("conv_id").alias("node"), (F.col("pos") + 1).alias("depth"), F.col("rep").alias("parent"))
    above = above.unionByName(members.where("pos = 1").select(F.col("conv_id").alias("node"), F.lit(1).cast("long").alias("depth")).crossJoin(F.broadcast(root.select(F.col("rep").alias("parent")))))  # one row
    nodes = materialize(nodes.join(above, ["node", "depth"], "left"), "nodes")
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = materialize(nodes.join(children, ["depth", "node"], "left").fillna(0, ["n_children"]), "parents")
    # what a conversation owns: the leaf at its end, and the saved tokens of its nodes at each depth or below
    last = plan.select("conv_id", F.col("turns").alias("pos"))
    leaves = nodes.where("n_children = 0").select(F.col("node").alias("conv_id"), F.lit(1).cast("long").alias("leaf"))
    shared = members.where("n > 1")
    saved = F.when(F.col("conv_id") == F.col("rep"), (F.col("n") - 1) * F.col("len")).otherwise(0)
    scanned = segmented_scan(shared.select("conv_id", "pos", "rep", saved.cast("long").alias("saved")), "conv_id", [F.col("pos")], ["saved"])
    whole = shared.where("conv_id = rep").groupBy("conv_id").agg(F.sum((F.col("n") - 1) * F.col("len")).alias("whole"))
    paths = scanned.join(whole, "conv_id", "left").join(leaves, "conv_id", "left").fillna(0, ["whole", "leaf"])
    sums = paths.groupBy("pos", "rep").agg(F.sum("leaf").alias("n_leaves"), F.sum(F.col("whole") - F.col("saved_sum") + F.col("saved")).alias("saved_tokens")).withColumnsRenamed({"pos": "depth", "rep": "node"})
    total = whole.agg(F.coalesce(F.sum("whole"), F.lit(0)).alias("saved_tokens"))
    tops = root.select(F.lit(0).cast("long").alias("depth"), F.col("rep").alias("node")).crossJoin(leaves.agg(F.count(F.lit(1)).alias("n_leaves"))).crossJoin(total)  # one row each
    nodes = nodes.join(sums.unionByName(tops), ["depth", "node"], "left").select("depth", "node", "parent", "n", "n_children", F.coalesce("n_leaves", F.lit(1)).alias("n_leaves"), F.coalesce("saved_tokens", F.lit(0)).alias("saved_tokens"))
    ended = last.join(members.select("conv_id", "pos", "rep"), ["conv_id", "pos"]).select(F.col("pos").alias("depth"), "rep", "conv_id")
    silent = last.where("pos = 0").select(F.col("pos").alias("depth"), "conv_id").crossJoin(F.broadcast(root.select("rep"))).select("depth", "rep", "conv_id")
    hashes = ends_hashes(materialize(ended.unionByName(silent), "ends")).withColumnRenamed("conv_id", "node")
    nodes = nodes.join(hashes, ["depth", "node"], "left")
    return nodes.select(
        F.col("node").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NO_IDS)).alias("ends_sha256")
    )


def query(spark, sf_dir: str) -> DataFrame:
    return prefix_trie(read_table(spark, sf_dir, "conversations"))


#: Prefixes as lists; a node's subtree by comparing its sequence with the start of every deeper one. crc32 bit by bit.
SQL = r"""
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS j, {'r': coalesce(role, ''), 't': coalesce(text, '')} AS x
  FROM conversations WHERE conv_id IS NOT NULL
), own AS (SELECT conv_id, list(x ORDER BY j) AS xs FROM t GROUP BY 1),
crc AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base, xs,
    xor(list_reduce(list_transform(string_split(conv_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT),
      lambda acc, byte: list_reduce([0, 1, 2, 3, 4, 5, 6, 7]::BIGINT[], lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, xor(acc, byte)), 4294967295::BIGINT), 4294967295::BIGINT) % 6 AS h
  FROM own
), built AS (
  SELECT c.conv_id, list_concat(list_slice(coalesce(b.xs, []), 1, c.h), list_slice(c.xs, c.h + 1, len(c.xs))) AS xs
  FROM crc c LEFT JOIN own b ON b.conv_id = c.base
), prefixes AS (SELECT conv_id, d, list_slice(xs, 1, d) AS p, len(xs) AS n FROM (SELECT *, unnest(range(0, len(xs) + 1)) AS d FROM built)),
nodes AS (
  SELECT p, any_value(d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE n = d), '')) AS ends_sha256,
    CASE WHEN any_value(d) = 0 THEN 0 ELSE (count(*) - 1) * length(any_value(p)[-1].t) END AS saved
  FROM prefixes GROUP BY p
), family AS (
  SELECT n.depth, n.conv_id, n.n_convs, n.ends_sha256, q.conv_id AS parent_conv_id, n.p, n.saved, count(c.p) AS n_children
  FROM nodes n LEFT JOIN nodes q ON n.depth > 0 AND q.depth = n.depth - 1 AND q.p = list_slice(n.p, 1, n.depth - 1)
  LEFT JOIN nodes c ON c.depth = n.depth + 1 AND list_slice(c.p, 1, c.depth - 1) = n.p
  GROUP BY ALL
), up AS (SELECT list_slice(p, 1, d) AS top, n_children, saved FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM family))
SELECT f.conv_id, f.depth, f.parent_conv_id, f.n_convs, f.n_children, count(*) FILTER (WHERE u.n_children = 0) AS n_leaves, sum(u.saved)::BIGINT AS saved_tokens, f.ends_sha256
FROM family f JOIN up u ON u.top = f.p GROUP BY ALL
"""
