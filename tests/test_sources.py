import io
import json
import zipfile

import pytest

from corvane import Engine, cli
from corvane.settings import Settings, load_settings, save_settings
from corvane.sources import files as S
from corvane.sources.embeddings import HashingEmbedder, checked, embed_missing, model_key, optional_provider
from corvane.sources.store import Store, collection_key
from corvane.streaming.ingest import ingest

WORD = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
DRAW = "http://schemas.openxmlformats.org/drawingml/2006/main"


def zipped(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return out.getvalue()


def docx(body: str) -> bytes:
    return zipped({"word/document.xml": f'<w:document xmlns:w="{WORD}"><w:body>{body}</w:body></w:document>'})


def par(text: str) -> str:
    return f"<w:p><w:r><w:t>{text}</w:t></w:r></w:p>"


def pptx(*slides: str) -> bytes:
    parts = {f"ppt/slides/slide{n}.xml": f'<p xmlns:a="{DRAW}"><a:p><a:r><a:t>{t}</a:t></a:r></a:p></p>' for n, t in zip((10, 2), slides)}
    return zipped({"ppt/presentation.xml": "<p/>", **parts})


def test_validation():
    assert S.problem("a.txt", b"ok") is None
    assert "type" in S.problem("a.doc", b"x") and "empty" in S.problem("a.txt", b"") and "UTF-8" in S.problem("a.txt", b"\xff")
    assert "PDF" in S.problem("a.pdf", b"nope") and "Office" in S.problem("a.docx", b"PK nope")
    assert "active" in S.problem("a.docx", zipped({"word/document.xml": "<w/>", "word/vbaProject.bin": "x"}))
    bomb = io.BytesIO()
    with zipfile.ZipFile(bomb, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", "0" * 1_000_000)
    assert "compression" in S.problem("a.docx", bomb.getvalue())


def test_word_tables_and_slides():
    row = lambda *cells: "<w:tr>" + "".join(f"<w:tc>{par(c)}</w:tc>" for c in cells) + "</w:tr>"
    text = S.docx_text(docx(par("Intro") + "<w:tbl>" + row("Name", "Age") + row("Ann", "4", "extra") + "</w:tbl>"))
    assert text == "Intro\n\nTable:\nColumns: Name | Age\nRow 1: Name: Ann | Age: 4 | extra"
    assert S.table_text([["Q"], ["a"], ["b"]]) == "Table:\nEntry 1:\nPrompt: Q\nAnswer: a\nEntry 2:\nPrompt: Q\nAnswer: b"
    assert S.table_text([["x", ""], ["", ""]]) == "Table:\nRow 1: Cell 1: x"
    assert S.pptx_slides(pptx("late", "early")) == [("early", 1), ("late", 2)]


def test_pdf_says_what_it_needs():
    pytest.importorskip  # noqa: B018
    try:
        import pypdf  # noqa: F401
    except ImportError:
        with pytest.raises(RuntimeError, match="pypdf"):
            S.pdf_pages(b"%PDF-1.4")


def test_import_numbers_copies_and_skips_the_rest(tmp_path):
    (tmp_path / "a.txt").write_text("x")
    (tmp_path / "b.exe").write_text("x")
    copied, skipped = S.import_documents([tmp_path / "a.txt", tmp_path / "a.txt", tmp_path / "b.exe"], tmp_path / "out")
    assert [p.name for p in copied] == ["a.txt", "a (2).txt"] and skipped == ["b.exe"]


@pytest.fixture
def folder(tmp_path):
    docs = tmp_path / "docs"
    (docs / "sub").mkdir(parents=True)
    (docs / "ice.TXT").write_text("A glacier is a body of dense ice.\r\nIt moves.")
    (docs / "sub" / "plan é.docx").write_bytes(docx(par("The budget of the project is nine thousand euros.")))
    (docs / "talk.pptx").write_bytes(pptx("Tides are caused by the moon", "Welcome"))
    (docs / "skip.bin").write_text("x")
    return docs


def test_engine_over_a_folder(spark, folder, tmp_path):
    with Engine.from_directory(spark, folder, cache=str(tmp_path / "cache")) as engine:
        told = engine.ask("What is a glacier?")
        assert told.sources == ("ice.TXT",) and "dense ice" in told.text
        assert engine.ask("What is the budget of the project?", flexible=True).sources == ("sub/plan é.docx",)
        assert engine.ask("Who won the opera prize?").sources == ()
        with pytest.raises(ValueError):
            engine.ask("x", k=0)
    with pytest.raises(RuntimeError):
        engine.ask("again?")
    with pytest.raises(RuntimeError, match="cancelled"):
        Engine.from_directory(spark, folder, cache=None, cancelled=lambda: True)
    with pytest.raises(FileNotFoundError):
        Engine.from_directory(spark, tmp_path / "none", cache=None)


def test_sections_are_extracted_once_and_pruned(spark, folder, tmp_path):
    store, key = Store(spark, str(tmp_path / "s")), collection_key(folder)
    files = S.scan_files(spark, str(folder))
    store.put_sections(key, S.extract_sections(store.stale(key, files)), files)
    assert store.stale(key, files).count() == 0 and store.sections(key).count() == 4
    (folder / "ice.TXT").write_text("changed")
    (folder / "talk.pptx").unlink()
    files = S.scan_files(spark, str(folder))
    assert [r.source for r in store.stale(key, files).collect()] == ["ice.TXT"]
    store.put_sections(key, S.extract_sections(store.stale(key, files)), files)
    assert {r.source for r in store.sections(key).collect()} == {"ice.TXT", "sub/plan é.docx"}
    fs, path = store._path("meta.json")
    out = fs.create(path, True)
    out.write(bytearray(b'{"version": 9}'))
    out.close()
    with pytest.raises(ValueError, match="version"):
        Store(spark, str(tmp_path / "s"))


def test_embeddings_are_cached_and_checked(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    texts = spark.createDataFrame([("ice",), ("ice",), ("snow",)], "text string")
    assert embed_missing(store, "m", texts, HashingEmbedder).count() == 3

    def never():
        raise AssertionError("all texts are cached")

    assert embed_missing(store, "m", texts, never).distinct().count() == 2
    with pytest.raises(ValueError, match="dimension"):
        embed_missing(store, "m", spark.createDataFrame([("rain",)], "text string"), lambda: HashingEmbedder(8))
    for bad in ([[1.0, float("nan")]], [[]]):
        with pytest.raises(ValueError):
            checked(bad, 1)
    with pytest.raises(RuntimeError):
        checked([], 1)
    assert model_key("m", {"v": 1}) != model_key("m", {"v": 2})

    def absent():
        raise ImportError("no model")

    with pytest.warns(UserWarning):
        assert optional_provider(absent) is None


def test_hybrid_engine(spark, folder, tmp_path):
    with Engine.from_directory(spark, folder, cache=str(tmp_path / "c"), make_embedder=HashingEmbedder) as engine:
        assert engine.ask("What is a glacier?").results[0].semantic > 0


def test_streaming_ingest(spark, folder, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    ingest(spark, str(folder), store, "c", str(tmp_path / "cp")).awaitTermination()
    assert store.sections("c").count() == 4


def test_settings(tmp_path):
    path = tmp_path / "s.json"
    assert load_settings(path) == Settings()
    save_settings(path, Settings(k=4, theme="dark"))
    assert load_settings(path) == Settings(k=4, theme="dark")
    path.write_text('{"unknown": 1, "k": 2}')
    assert load_settings(path).k == 2
    path.write_text("[1]")
    assert load_settings(path) == Settings()


def test_cli(spark, folder, tmp_path, capsys):
    config = tmp_path / "c.json"
    config.write_text(json.dumps({"docs": str(folder), "cache_dir": str(tmp_path / "cache"), "verbose": True}))
    assert cli.main(["--config", str(config), "What", "is", "a", "glacier?"], spark) == 0
    out = capsys.readouterr().out
    assert "dense ice" in out and "- ice.TXT" in out and "[result 1]" in out
    config.write_text('{"nope": 1}')
    with pytest.raises(SystemExit):
        cli.main(["--config", str(config), "x"], spark)
    assert cli.main(["--list-models"], spark) == 0
    assert cli.main(["--docs", str(tmp_path / "none"), "x"], spark) == 1
    with pytest.raises(SystemExit):
        cli.parse(["--chunk-size", "5", "--overlap", "5"])
    assert cli.self_test(spark)
