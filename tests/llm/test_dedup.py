import hashlib
import itertools
import random
import re

import numpy as np
import pytest
import xxhash

from corvane.llm import exact_dedup, line_dedup, sharding, simhash
from corvane.llm.components import connected_components
from corvane.llm.cuckoo import CuckooFilter, DigestIndex
from corvane.llm.storage import materialize

from .conftest import ROWS, frame


def digests(n, seed=0):
    return [hashlib.sha256(f"{seed}-{i}".encode()).digest() for i in range(n)]


def test_cuckoo_filter_inserts_deletes_and_overflows():
    f, keys = CuckooFilter(1000), digests(1000)
    assert all(f.insert(k) for k in keys) and all(map(f.contains, keys))
    assert sum(map(f.contains, digests(1000, 1))) < 30
    assert all(f.delete(k) for k in keys[:500]) and all(map(f.contains, keys[500:]))
    small = CuckooFilter(4)
    assert not all(small.insert(k) for k in keys)


def test_index_grows_from_stored_keys_and_forgets_the_dead():
    index, keys = DigestIndex(4), digests(2000)
    assert index.insert(keys, list(range(2000)), [1] * 2000) == 2000 and index.resizes
    assert index.looked_up == index.false_hits  # new digests are looked up only where the filter errs
    before = index.looked_up
    assert index.insert([keys[0], keys[0]], [-5, None], [1, 1]) == 0 and index.looked_up == before + 2
    held = dict(zip(index.rows()[0], zip(*index.rows()[1:])))
    assert held[keys[0]] == (-5, 3) and len(held) == 2000
    assert index.delete([keys[0]], [2]) == 0 and index.delete([keys[0], keys[1]], [1, 1]) == 2
    assert keys[0] not in index and all(k in index for k in keys[2:]) and index.delete([keys[0]], [1]) == 0
    again = DigestIndex.load(index.filter.stored(), *index.rows())
    assert all(k in again for k in keys[2:]) and again.insert([keys[0], keys[5]], [9, 9], [1, 1]) == 1


def test_index_equals_a_dictionary():
    rng, index, held = random.Random(2), DigestIndex(1), {}
    keys = [k[:30] + bytes([k[30] % 2, 0]) for k in digests(300)]  # ends of zeros
    for _ in range(40):
        chosen = [rng.choice(keys) for _ in range(30)]
        ids = [rng.choice([None, *range(50)]) for _ in chosen]
        index.insert(chosen, ids, [1] * 30)
        for k, i in zip(chosen, ids):
            entry = held.setdefault(k, [None, 0])
            entry[0] = min((x for x in (entry[0], i) if x is not None), default=None)
            entry[1] += 1
        gone = rng.sample(keys, 20)
        index.delete(gone, [2] * 20)
        for k in gone:
            if k in held:
                held[k][1] -= 2
                if held[k][1] <= 0:
                    del held[k]
        assert dict(zip(index.rows()[0], map(list, zip(*index.rows()[1:])))) == held
        assert sum(map(bool, index.filter.table)) == len(held)


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def test_exact_groups_by_brute_force(odd, empty):
    got = exact_dedup.exact_groups(odd).collect()
    assert len(got) == len(ROWS)
    for r in got:
        ids = [d for d, t in ROWS if hashlib.sha256(norm(t).encode()).digest() == bytes(r.digest)]
        assert r.group_size == len(ids) and r.keep_id == min((d for d in ids if d is not None), default=None) and r.kept == (r.doc_id == r.keep_id)
    assert exact_dedup.exact_groups(empty).count() == 0
    kept = exact_dedup.exact_dedup(odd)
    assert kept.columns == odd.columns
    assert sorted(norm(r.text) for r in kept.collect()) == sorted({norm(t) for _, t in ROWS})


def test_index_updates(spark):
    docs = spark.createDataFrame([(i, f"t{i % 5}") for i in range(20)], "doc_id long, text string")
    rows = docs.select("doc_id", exact_dedup.digest_of(docs["text"]).alias("digest"))
    index = exact_dedup.build_index(rows, 4)
    live = lambda table: sorted((r.keep_id, r.group_size) for r in table.collect() if r.digest is not None)
    assert live(index) == [(i, 4) for i in range(5)] and index.where("digest IS NULL").count() == index.select("bucket").distinct().count()
    new = materialize(exact_dedup.update_index(index, rows.where("doc_id = 0"), rows.where("doc_id % 5 = 1"), 4), "index")
    assert live(new) == [(0, 5), (2, 4), (3, 4), (4, 4)]
    unseen = rows.select((rows["doc_id"] + 100).alias("doc_id"), exact_dedup.digest_of(rows["doc_id"].cast("string")).alias("digest"))
    assert len(live(exact_dedup.update_index(new, unseen, rows.where("doc_id % 5 = 1"), 4))) == 24


def brute_lines(rows):
    first, cut = {}, {}
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        lines = (t or "").split("\n")
        for i in range(len(lines) - 2):
            if first.setdefault(tuple(lines[i : i + 3]), (d, i)) != (d, i):
                cut.setdefault(d, set()).update((i, i + 1, i + 2))
    return {d: "\n".join(x for i, x in enumerate((t or "").split("\n")) if i not in cut.get(d, ())) for d, t in rows}


def test_lines_by_brute_force(spark):
    random.seed(3)
    rows = [(i, "\n".join(random.choice("abcd") for _ in range(random.randint(0, 12)))) for i in range(60)]
    assert {r.doc_id: r.text for r in line_dedup.dedup_lines(frame(spark, rows)).collect()} == brute_lines(rows)


def test_odd_lines(odd, empty):
    got = line_dedup.dedup_lines(odd).collect()
    assert len(got) == len(ROWS)
    assert [r.text for r in got if r.doc_id == 5] == ["x\ny\nz"]
    assert all(r.text == "same text here" for r in got if r.doc_id == 3)
    assert line_dedup.dedup_lines(empty).count() == 0


def test_table_is_fair_stable_and_weighted():
    shards = {f"s{i}": 1 for i in range(20)}
    table = np.array(sharding.fill_table(shards, 2003))
    counts = [int((table == s).sum()) for s in shards]
    assert max(counts) - min(counts) <= 1
    fewer = np.array(sharding.fill_table({s: 1 for s in shards if s != "s7"}, 2003))
    moved = ((table != fewer) & (table != "s7")).mean()
    assert moved < 0.15 and "s7" not in fewer
    heavy = sharding.fill_table({"a": 3, "b": 1}, 101)
    assert abs(heavy.count("a") - 75.75) < 4
    with pytest.raises(ValueError):
        sharding.fill_table(shards, 2000)
    with pytest.raises(ValueError):
        sharding.fill_table({}, 101)


def brute_table(shards, size):
    """The published procedure, slot lists written out."""
    order = {s: [(o + j * k) % size for j in range(size)] for s in shards for o, k in [sharding._preference(s, size)]}
    slots, at = [None] * size, dict.fromkeys(shards, 0)
    while None in slots:
        for s in sorted(shards):
            while at[s] < size and slots[order[s][at[s]]] is not None:
                at[s] += 1
            if at[s] < size:
                slots[order[s][at[s]]] = s
    return slots


def test_table_by_brute_force_and_placement(spark, odd, empty):
    shards = {f"s{i}": 1 for i in range(7)}
    assert sharding.fill_table(shards, 101) == brute_table(shards, 101)
    got = sharding.place(odd, ["doc_id"], shards, 101).collect()
    assert len(got) == len(ROWS) and all(r.shard == sharding.fill_table(shards, 101)[r.slot] for r in got)
    assert sharding.place(empty, ["doc_id"], shards, 101).count() == 0
    assert sharding.place(odd, ["source"], shards, 101, spread=50).select("shard").distinct().count() > 1


def test_components(spark):
    edges = [(2, 1), (3, 2), (5, 4), (9, 8), (8, 7), (7, 9), (6, 6)] + [(i + 1, i) for i in range(100, 140)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {2: 1, 3: 1, 5: 4, 8: 7, 9: 7} | {i: 100 for i in range(101, 141)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64)) if hashes else 0


def brute_components(fps, bits):
    root = list(range(len(fps)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if ((fps[i] ^ fps[j]) & (2**64 - 1)).bit_count() <= bits:
                root[max(top(i), top(j))] = min(top(i), top(j))
    return [top(i) for i in range(len(fps))]


def test_simhash_groups_by_brute_force(odd, empty):
    got = simhash.near_groups(odd).collect()
    assert len(got) == len(ROWS)
    fps = [brute_fingerprint(t) for _, t in ROWS]
    comp = brute_components(fps, 2)
    want = {(d, f, min((ROWS[j][0] for j in range(len(ROWS)) if comp[j] == c and ROWS[j][0] is not None), default=None)) for (d, _), f, c in zip(ROWS, fps, comp)}
    assert {(r.doc_id, r.fp % 2**64, r.component_id) for r in got} == want
    assert simhash.near_groups(empty).count() == 0


@pytest.mark.parametrize(("bits", "group"), [(2, 256), (2, 3), (5, 256), (5, 4), (11, 8)])
def test_search_finds_every_link(spark, bits, group):
    rng = random.Random(bits * group)
    fps = [rng.getrandbits(64) for _ in range(60)]
    fps += [f ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, bits + 1))) for f in fps for _ in range(3)]
    signed = sorted({f - 2**64 if f >= 2**63 else f for f in fps})
    nodes = spark.createDataFrame([(f,) for f in signed], "fp long")
    got = {r.node: r.root for r in connected_components(simhash.near_links(nodes, bits, group)).collect()}
    comp = brute_components(signed, bits)
    assert {signed[i]: signed[c] for i, c in enumerate(comp) if i != c} == got


def test_allocation_is_the_cheapest():
    costs = [[0.0, 5.0, 50.0, 500.0], [0.0, 4.0, 60.0, 600.0], [0.0, 9.0, 20.0, 900.0]]
    options = [(sum(costs[i][t + 1] for i, t in enumerate(ts)), list(ts)) for ts in np.ndindex(4, 4, 4) for ts in [tuple(t - 1 for t in ts)] if sum(t + 1 for t in ts) == 3]
    assert simhash.allocate(costs, 2)[0] == min(options)[0]


def test_similar_groups_check_the_texts(spark, odd, empty):
    base = " ".join(f"word{i}" for i in range(300))
    near = base.replace("word150", "changed")
    half = " ".join(f"word{i}" for i in range(150)) + " " + " ".join(f"other{i}" for i in range(150))
    got = {r.node: r.root for r in simhash.similar_groups(frame(spark, [(1, base), (2, near), (3, half), (4, base), (5, "unrelated")])).collect()}
    assert got == {2: 1, 4: 1}
    assert simhash.similar_groups(odd).count() >= 1 and simhash.similar_groups(empty).count() == 0


def brute_similar(rows):
    sets = {d: simhash.shingle_set(t, 5).tolist() for d, t in rows}
    ids, root = sorted(sets), {}
    for i in ids:
        root[i] = i
    for a, b in itertools.combinations(ids, 2):
        x, y = set(sets[a]), set(sets[b])
        if len(x & y) >= 0.8 * len(x | y) and root[a] != root[b]:
            low, high = sorted((root[a], root[b]))
            root = {i: low if r == high else r for i, r in root.items()}
    return {i: r for i, r in root.items() if i != r}


def test_similar_pairs_are_found_past_dissimilar_ones(spark):
    """Families in which fingerprints lie close but many texts are dissimilar: a forest of nearest fingerprints drops similar pairs."""
    rng = random.Random(5)
    rows = []
    for family in range(12):
        base = [f"f{family}w{i}" for i in range(120)]
        for _ in range(12):
            words = list(base)
            for at in rng.sample(range(120), rng.randint(1, 3)):
                words[at] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(words)))
    rng.shuffle(rows)
    got = {r.node: r.root for r in simhash.similar_groups(frame(spark, rows)).collect()}
    assert got == brute_similar(rows) and got


def test_block_edits_far_apart_in_bits_are_found(spark):
    """One block added to or exchanged in a long text: similar at 0.8, but fingerprints often differ in more than 11 bits."""
    rng, rows = random.Random(7), []
    for i in range(150):
        words = [f"{rng.randrange(10**6)}" for _ in range(600)]
        at, block = rng.randrange(500), [f"{rng.randrange(10**6)}" for _ in range(62 if i % 2 else 140)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words[:at] + block + words[at + (len(block) if i % 2 else 0) :]))]
    far = [i for i in range(0, 300, 2) if ((brute_fingerprint(rows[i][1]) ^ brute_fingerprint(rows[i + 1][1])).bit_count()) > 11]
    assert far
    assert {r.node: r.root for r in simhash.similar_groups(frame(spark, rows)).collect()} == {i + 1: i for i in range(0, 300, 2)}


def test_similar_groups_by_brute_force(spark):
    """Families of edited texts of many sizes, over a shared passage, against every pair's Jaccard similarity."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(4))
    passage, rows = [word() for _ in range(60)], [(90_000, ""), (90_001, None), (90_002, "one two"), (90_003, "one two")]
    for family in range(40):
        base = [word() for _ in range(rng.choice([8, 30, 80, 200]))] + (passage if family % 2 else [])
        for copy in range(rng.randint(1, 5)):
            words = list(base)
            for _ in range(rng.randint(0, max(1, len(words) // 40))):
                words[rng.randrange(len(words))] = word()
            cut = rng.choice([0, 0, len(words) // 12, len(words) // 6])
            rows.append((family * 10 + copy, " ".join(words[cut:])))
    rng.shuffle(rows)
    sets = {i: set(simhash.shingle_set(t or "", 5).tolist()) for i, t in rows}
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    links = [(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    for a, b in links:
        x, y = sorted((top(a), top(b)))
        root[y] = x
    got = {r.node: r.root for r in simhash.similar_groups(frame(spark, rows)).collect()}
    assert got == {i: top(i) for i in sets if top(i) != i} and len(links) > 60
