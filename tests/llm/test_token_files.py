import glob
import os

import numpy as np
import pytest

from corvane.llm import token_files as T

from .conftest import ROWS


@pytest.mark.parametrize("block", [1, 2, 3, 7, 1000])
def test_scan_stitches_blocks_like_brute_force(spark, tmp_path, block):
    docs = [[1, 2, 3], [], [5], [7] * 40, [50255] * 3, []]
    records = spark.createDataFrame([(bytes(np.array(d, "<u2").tobytes()),) for d in docs], "record binary").coalesce(1)
    T.write_token_files(records, str(tmp_path / "t"))
    path = glob.glob(str(tmp_path / "t" / "part*"))[0]
    with open(path, "ab") as f:
        f.write(np.array([9, 9], "<u2").tobytes())  # a document without an end
    for crc in glob.glob(str(tmp_path / "t" / ".*crc")):
        os.remove(crc)
    got = sorted((r.start, r.n_tokens, r.terminated, r.doc_index) for r in T.scan_token_files(spark, str(tmp_path / "t"), block=block).collect())
    assert [g[:3] for g in got] == T.brute_force(np.fromfile(path, "<u2"), T.END_ID)
    assert [g[3] for g in got] == list(range(len(got)))


def test_files_are_closed_by_size(spark, tmp_path):
    docs = [[i] * n for i, n in enumerate([3, 0, 500, 2, 2, 2, 90, 1, 1] * 5)]
    records = spark.createDataFrame([(bytes(np.array(d, "<u2").tobytes()),) for d in docs], "record binary").coalesce(1)
    T.write_token_files(records, str(tmp_path / "t"), file_bytes=200)
    sizes = [os.path.getsize(f) for f in glob.glob(str(tmp_path / "t" / "part*"))]
    assert len(sizes) > 10 and all(s < 200 + 1002 for s in sizes) and sum(sizes) == sum(2 * len(d) + 2 for d in docs)
    got = sorted((r.file, r.doc_index, r.n_tokens, r.terminated) for r in T.scan_token_files(spark, str(tmp_path / "t"), block=7).collect())
    assert [g[2:] for g in got] == [(len(d), True) for d in docs]


def test_groups_of_blocks_carry_over(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(T, "SUPER", 2)
    data = np.random.default_rng(0).integers(0, 4, 300).astype("<u4")
    (tmp_path / "f.bin").write_bytes(data.tobytes())
    got = sorted((r.start, r.n_tokens, r.terminated) for r in T.scan_token_files(spark, str(tmp_path), end_id=0, width=4, block=5).collect())
    assert got == sorted(T.brute_force(data, 0))


def test_broken_and_empty_files(spark, tmp_path):
    (tmp_path / "empty.bin").write_bytes(b"")
    assert T.scan_token_files(spark, str(tmp_path)).count() == 0
    (tmp_path / "odd.bin").write_bytes(b"123")
    with pytest.raises(Exception, match="no whole number"):
        T.scan_token_files(spark, str(tmp_path)).collect()


def test_odd_documents_keep_ids_and_counts(spark, odd, tmp_path):
    odd.select("doc_id", "text").write.parquet(str(tmp_path / "documents.parquet"))
    got = T.query(spark, str(tmp_path)).collect()
    count = lambda t: len(T._encoding(T.default_path("byte_bpe_50k.tiktoken")).encode_ordinary(t or ""))
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(((r.doc_id, r.n_tokens) for r in got), key=key) == sorted(((d, count(t)) for d, t in ROWS), key=key)


def test_empty_table(spark, empty, tmp_path):
    empty.select("doc_id", "text").write.parquet(str(tmp_path / "documents.parquet"))
    assert T.query(spark, str(tmp_path)).count() == 0
