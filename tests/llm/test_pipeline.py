import random
import re

import pytest

import corpus_pipeline
from corvane import tables
from corvane.llm import queries

from .conftest import ROWS, frame


def test_registry_covers_all():
    assert sorted({int(re.match(r"op(\d+)_", n).group(1)) for n in queries.QUERIES}) == list(range(1, 14))
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)


def test_oracles_are_sql():
    assert all(isinstance(sql, str) for sql in queries.ORACLE_SQL.values())


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("sf")
    base = " ".join(f"word{i}" for i in range(200))
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("aeioulnrst") for _ in range(5))
    rows = [(i, " ".join(word() for _ in range(80)) + (" gruk" if i % 4 == 0 else "")) for i in range(200)]
    rows += [(500, base), (501, base), (502, base.replace("word100", "altered")), (503, "write to a.b@c.org please"), (504, None), (505, "g r u k is here")]
    frame(spark, rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_stages_take_effect(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    left = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, sf_dir), name)
        left[name] = {r.doc_id: r for r in docs.collect()}
        assert docs.columns == spark.read.parquet(f"{sf_dir}/documents.parquet").columns
    assert not any(i % 4 == 0 for i in left["toxicity"] if i < 200) and 505 not in left["toxicity"]
    assert {i for i in range(200) if i % 4} <= set(left["toxicity"])
    assert 501 not in left["exact_dedup"] and 500 in left["exact_dedup"]
    assert 502 not in left["near_dedup"] and {500, 503, 504} <= set(left["near_dedup"])
    assert left["personal_data"][503].text == "write to [EMAIL] please" and left["personal_data"][503].n_chars == len("write to [EMAIL] please")
    packed = corpus_pipeline.pack(spark, docs, sf_dir).collect()
    assert {r.doc_id for r in packed} == set(left["personal_data"])


def test_odd_and_empty_tables(spark, odd, empty, no_labels, tmp_path):
    no_labels.write.parquet(str(tmp_path / "labels.parquet"))
    for rows in (odd, empty):
        docs = rows
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = corpus_pipeline.materialize(stage(spark, docs, str(tmp_path)), name)
        if rows is odd:
            # word-free texts are near-duplicates of each other
            assert docs.count() == len({re.sub(r"[\x20\x09-\x0D]+", " ", t or "").strip(" ") for _, t in ROWS})
        else:
            assert docs.count() == 0
        packed = corpus_pipeline.pack(spark, docs, str(tmp_path)).collect()
        assert sorted({str(r.doc_id) for r in packed}) == sorted({str(r.doc_id) for r in docs.collect()})
        assert len({(r.sequence_id, r.offset) for r in packed}) == len(packed)


def test_run_leaves_only_the_stages_tables(spark, sf_dir, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "scratch_root", lambda spark: f"file://{tmp_path}")
    packed = corpus_pipeline.run(spark, sf_dir)
    assert packed.count() and sorted(p.name for p in tmp_path.glob("*/*")) == sorted(name for name, _ in corpus_pipeline.STAGES)


def test_toxic_rows_go_by_id_and_text(spark, sf_dir):
    rows = [(1001, "aeiou lnrst eilno"), (1001, "gruk gruk gruk"), (None, "you gruk gruk"), (None, "aeiou eilno lnrst"), (None, None)]
    stored = spark.read.parquet(f"{sf_dir}/documents.parquet")
    left = corpus_pipeline.drop_toxic(spark, stored.unionByName(frame(spark, rows)), sf_dir).where("doc_id = 1001 OR doc_id IS NULL")
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=str) == sorted([rows[0], rows[3], rows[4]], key=str)


def test_scores_do_not_depend_on_the_order_of_rows(spark, sf_dir):
    from corvane.llm import toxicity

    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = lambda d: {(r.doc_id, r.text_hash): r.score for r in toxicity.score(d, labels).collect()}
    assert scored(docs) == scored(docs.orderBy("text").repartition(7))


def test_near_copies_around_a_hot_passage(spark):
    """Texts that are mostly one passage share keys and are not similar; copies among them are still found."""
    from corvane.llm import simhash

    rng = random.Random(6)
    word = lambda: "".join(rng.choice("aeioulnrst") for _ in range(6))
    passage = [word() for _ in range(60)]
    rows = []
    for i in range(60):
        text = passage + [word() for _ in range(rng.randint(14, 40))]
        rows.append((2 * i, " ".join(text)))
        if i % 3 == 0:
            rows.append((2 * i + 1, " ".join([*text[:-1], word()])))
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, t in rows for w in [t.split()]}
    root = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = {k: new if r == old else r for k, r in root.items()}
    assert {r.node: r.root for r in simhash.similar_groups(frame(spark, rows)).collect()} == {i: r for i, r in root.items() if i != r}


def test_near_copies_go_by_the_minhash_operator(spark, sf_dir, monkeypatch):
    """The stage's groups are the operator's own, over five-word shingles; it once had a set join of its own."""
    from corvane.llm import minhash

    rng, seen, whole = random.Random(8), [], minhash.minhash_groups
    monkeypatch.setattr(minhash, "minhash_groups", lambda *a: seen.append(a[1:]) or whole(*a))
    word = lambda: "".join(rng.choice("aeioulnrst") for _ in range(6))
    rows, texts = [], [[word() for _ in range(rng.randint(30, 90))] for _ in range(40)]
    for i, text in enumerate(texts):
        at = rng.randrange(len(text))
        rows += [(2 * i, " ".join(text)), (2 * i + 1, " ".join([*text[:at], word(), *text[at + 1 :]]))]
    rows += [(100, None), (101, " \t"), (102, ""), (None, " ".join(texts[0]))]
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, t in rows[:80] for w in [t.split()]}
    gone = {b for b in sets if b % 2 and 100 * len(sets[b] & sets[b - 1]) >= 80 * len(sets[b] | sets[b - 1])}
    left = corpus_pipeline.drop_near_copies(spark, frame(spark, rows), sf_dir)
    assert sorted((r.doc_id for r in left.collect()), key=str) == sorted((i for i, _ in rows if i not in gone | {101, 102}), key=str)
    assert seen == [(5, 80)] and gone


def test_workers_give_memory_back(spark):
    """What one stage kept in a Python worker once stayed for all stages after it, beside Arrow's pool and batches of any size."""
    from corvane.llm import pii, words

    path = words.default_path("word_bpe_49k.json")

    def look(batches):
        import pyarrow as pa

        from corvane.llm import words

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([words.encoder.cache_info().currsize]), pa.array([len(batch)]), pa.array([pa.default_memory_pool().backend_name])], ["held", "n", "pool"])

    def tokenise(batches):
        words.encoder(path)
        yield from batches

    seen = lambda docs: docs.mapInArrow(look, "held long, n long, pool string").collect()
    small = spark.range(0, 640, 1, 64).selectExpr("id doc_id", "concat('word', id) text")
    small.mapInArrow(tokenise, small.schema).write.format("noop").mode("overwrite").save()
    assert any(r.held for r in seen(small))
    pii.scan(small).write.format("noop").mode("overwrite").save()
    assert not any(r.held for r in seen(small))
    large = seen(spark.range(0, 1000, 1, 1).selectExpr("id doc_id", "repeat('word ', 4000) text"))
    assert sum(r.n for r in large) == 1000 and max(r.n for r in large) < 500 and {r.pool for r in large} == {"system"}
