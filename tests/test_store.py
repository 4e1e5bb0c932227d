import sys
import types

import pytest

from corvane.sources import files as S
from corvane.sources import folder as D
from corvane.sources.embeddings import HashingEmbedder, embed_missing
from corvane.sources.store import PARTS, SECTIONS, Store, _safe

FIRST = [(f"s{i}.md", f"d{i}", 0, None, f"text {i}") for i in range(40)]


def sections(spark, rows):
    return spark.createDataFrame(rows, SECTIONS)


def held(store):
    return sorted((r.source, r.text) for r in store.sections("c").collect())


def files_below(root):
    return {str(p.relative_to(root)) for p in root.rglob("*.parquet")}


def test_a_change_writes_only_the_partitions_it_touches(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    every = store.put_sections("c", sections(spark, FIRST))
    assert 1 < len(every) <= PARTS and held(store) == sorted((r[0], r[4]) for r in FIRST)
    before = files_below(tmp_path)
    assert len(store.put_sections("c", sections(spark, [("s7.md", "new", 0, None, "changed")]))) == 1
    added = files_below(tmp_path) - before
    assert len({p.split("/")[-2] for p in added}) == 1  # one partition
    assert dict(held(store)) == {r[0]: r[4] for r in FIRST} | {"s7.md": "changed"}
    active = spark.createDataFrame([(f"s{i}.md",) for i in range(39)], "source string")
    assert len(store.put_sections("c", sections(spark, []), active)) == 1 and len(held(store)) == 39
    assert store.put_sections("c", sections(spark, []), active) == []


def test_readers_see_the_old_or_the_new_state(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path))
    store.put_sections("c", sections(spark, FIRST))
    old = store.sections("c")  # a reader that goes on while others write
    with monkeypatch.context() as broken:
        broken.setattr(Store, "_commit", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            store.put_sections("c", sections(spark, [("s1.md", "x", 0, None, "lost")]))
    assert dict(held(Store(spark, str(tmp_path))))["s1.md"] == "text 1"
    store.put_sections("c", sections(spark, [("s1.md", "x", 0, None, "kept")]))
    assert old.count() == 40 and dict(held(store))["s1.md"] == "kept"
    for i in range(6):
        store.put_sections("c", sections(spark, [("s2.md", str(i), 0, None, f"version {i}")]))
    assert dict(held(store))["s2.md"] == "version 5" and len(store._manifests("sections/c")) == 3
    live = {f.split("/")[0] for n in store._manifests("sections/c") for f in store._state("sections/c", n)["folders"].values()}
    unnamed = {p.name for p in (tmp_path / "sections/c").iterdir()} - live - {"manifest"}
    assert len(unnamed) == 1  # of the change that died
    numbers = store._manifests("sections/c")
    with pytest.raises(RuntimeError, match="another writer"):
        store._put_text(f"sections/c/manifest/{numbers[-1]:012d}.json", "{}")


def test_vectors_are_appended_replaced_and_joined(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    rows = lambda *x: spark.createDataFrame(x, "text_hash string, vector array<double>")
    store.put_vectors("m", rows(("a", [1.0, 2.0]), ("b", [0.0, 1.0])))
    store.put_vectors("m", rows(("c", [3.0, 3.0])))
    assert len(store._state(f"vectors/{_safe('m')}")["folders"]) == 2
    store.put_vectors("m", rows(("a", [9.0, 9.0]), ("d", [1.0, 1.0]), ("d", [1.0, 1.0])))
    assert {r.text_hash: r.vector for r in store.vectors("m").collect()} == {"a": [9.0, 9.0], "b": [0.0, 1.0], "c": [3.0, 3.0], "d": [1.0, 1.0]}
    for bad in ([1.0], [1.0, float("nan")], []):
        with pytest.raises(ValueError):
            store.put_vectors("m", rows(("e", bad)))
    assert store.vectors("m").count() == 4 and store.dimension("m") == 2


def counting(log, bad=()):
    """A provider that writes down what it embeds; made here so that workers need not import the tests."""

    class Counting(HashingEmbedder):
        def embed_documents(self, texts):
            if any(t in bad for t in texts):
                raise RuntimeError("the model is gone")
            with open(log, "a") as f:
                f.writelines(t + "\n" for t in texts)
            return super().embed_documents(texts)

    return Counting


def test_a_text_is_embedded_once_also_after_a_failure(spark, tmp_path):
    store, log = Store(spark, str(tmp_path / "s")), str(tmp_path / "log")
    texts = spark.createDataFrame([(f"text {i}",) for i in range(60)] + [("text 1",)], "text string").repartition(5)
    with pytest.raises(RuntimeError, match="the model is gone"):
        embed_missing(store, "m", texts, counting(log, {"text 33"}), batch=4, round_size=20)
    stored = store.vectors("m").count()
    assert 0 < stored < 60 and stored < 57
    assert embed_missing(store, "m", texts, counting(log), batch=4, round_size=20).count() == 61
    called = open(log).read().splitlines()
    assert sorted(called) == sorted(f"text {i}" for i in range(60))
    assert embed_missing(store, "m", texts, None).count() == 61


def test_files_are_checked_before_they_are_opened(spark, tmp_path, monkeypatch):
    root = tmp_path / "docs"
    (root / ".hidden").mkdir(parents=True)
    (root / ".hidden" / "_a.md").write_text("hidden\r\ntext")
    (root / "b.txt").write_text("plain")
    (root / "c.bin").write_bytes(b"?")
    (root / "empty.md").write_text("")
    (root / "link.txt").symlink_to(root / "b.txt")
    with open(root / "large.txt", "wb") as f:
        f.truncate(60 << 20)
    (root / "latin.txt").write_bytes(b"\xe9")
    got = {r.source: r for r in S.scan_files(spark, str(root)).collect()}
    assert {k: r.problem for k, r in got.items()} == {
        ".hidden/_a.md": None, "b.txt": None, "empty.md": "empty file: empty.md", "link.txt": "not a regular file: link.txt", "large.txt": "file too large: large.txt", "latin.txt": "not UTF-8 text: latin.txt",
    }
    assert bytes(got["b.txt"].content) == b"plain" and got["large.txt"].content is None and got["large.txt"].size == 60 << 20
    opened = []
    monkeypatch.setattr("builtins.open", lambda path, *a, real=open: (opened.append(str(path)), real(path, *a))[1])
    reader = D.FolderReader(str(root), True)
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 6
    assert sorted(p.rsplit("/", 1)[1] for p in opened) == ["_a.md", "b.txt", "latin.txt"]
    monkeypatch.undo()
    listed = S.scan_files(spark, str(root), content=False)
    assert "content" not in listed.columns and listed.where("problem IS NULL").count() == 2
    texts = S.extract_sections(D.with_content(listed, str(root)), strict=False)
    assert {r.source: r.text for r in texts.collect()} == {".hidden/_a.md": "hidden\ntext", "b.txt": "plain"}
    assert {r.source for r in S.refused_files(S.scan_files(spark, str(root))).collect()} == {"empty.md", "link.txt", "large.txt", "latin.txt"}


def test_ranges_are_bounded_by_size_and_number():
    files = [D.Listed(f"{i}", 10 << 20, 0, None) for i in range(9)] + [D.Listed(f"x{i}", 0, 0, "empty") for i in range(2500)]
    got = D.ranges(iter(files))
    assert [f for r in got for f in r.files] == files
    assert all(sum(f.size for f in r.files) <= D.RANGE_BYTES and len(r.files) <= D.RANGE_FILES for r in got) and len(got) == 5


def test_pdf_pages_with_a_reader_and_ocr(spark, monkeypatch):
    texts = ["  A page with plenty of text. ", "few", None]

    class Page:
        def __init__(self, text):
            self.extract_text = lambda: text

    class Reader:
        def __init__(self, stream):
            if b"broken" in stream.read():
                raise KeyError("xref")
            self.pages = [Page(t) for t in texts]

    monkeypatch.setitem(sys.modules, "pypdf", types.SimpleNamespace(PdfReader=Reader))
    asked = []
    ocr = lambda content, page, language: (asked.append((page, language)), f" read {page} ")[1]
    body = b"%PDF-1.7 ..."
    assert S.pdf_pages(body) == [("A page with plenty of text.", 1), ("few", 2), ("", 3)]
    assert S.pdf_pages(body, ocr, "deu") == [("A page with plenty of text.", 1), ("read 1", 2), ("read 2", 3)] and asked == [(1, "deu"), (2, "deu")]
    assert S.extract_text("a.pdf", body, lambda *_: "") == "A page with plenty of text.\n\n\n\n"
    with pytest.raises(ValueError, match="cannot read a PDF"):
        S.pdf_pages(b"%PDF- broken")
    files = spark.createDataFrame([("a.pdf", "h", None, bytearray(body))], "source string, sha256 string, problem string, content binary")
    with pytest.raises(Exception, match="pypdf"):  # workers have no reader here
        S.extract_sections(files).collect()
