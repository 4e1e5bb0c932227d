"""Document files: scan, validation, text extraction and managed import.

Local and mounted folders are read by a data source of their own (``folder``), other file systems and streams by ``binaryFile``; the checks and the
extractors of the zipped formats work on contents, one file a row. PDF needs ``pypdf`` and, for page images, an OCR function; without them a PDF is refused
with a clear message.
"""

from __future__ import annotations

import io
import os
import re
import shutil
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# What is accepted.
SUFFIXES = (".txt", ".md", ".pdf", ".docx", ".pptx")
MAX_FILE, MAX_UNZIPPED, MAX_RATIO = 50 * 1024 * 1024, 200 * 1024 * 1024, 100
REQUIRED_PART = {".docx": "word/document.xml", ".pptx": "ppt/presentation.xml"}
ACTIVE_PARTS = ("vbaproject.bin", "activex/", "embeddings/", "oleobject")
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"

Section = tuple[str, int | None]


def suffix_of(name: str) -> str:
    return os.path.splitext(name)[1].lower()


def problem_of_size(name: str, size: int) -> str | None:
    """Why a file is refused unread, or None."""
    if suffix_of(name) not in SUFFIXES:
        return f"unsupported file type: {name}"
    if not size:
        return f"empty file: {name}"
    return f"file too large: {name}" if size > MAX_FILE else None


def problem(name: str, content: bytes) -> str | None:
    """Why a file is refused, or None."""
    suffix = suffix_of(name)
    if why := problem_of_size(name, len(content)):
        return why
    if suffix in (".txt", ".md"):
        try:
            content.decode("utf-8")
        except UnicodeDecodeError:
            return f"not UTF-8 text: {name}"
    elif suffix == ".pdf":
        return None if b"%PDF-" in content[:1024] else f"not a PDF: {name}"
    else:
        return _zip_problem(name, content, REQUIRED_PART[suffix])
    return None


def _zip_problem(name: str, content: bytes, part: str) -> str | None:
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            infos = archive.infolist()
    except zipfile.BadZipFile:
        return f"not an Office file: {name}"
    names = [i.filename.lower() for i in infos]
    if part not in names:
        return f"not an Office file: {name}"
    total, packed = sum(i.file_size for i in infos), sum(i.compress_size for i in infos)
    if total > MAX_UNZIPPED or total > MAX_RATIO * max(1, packed):
        return f"suspicious compression: {name}"
    if any(a in n for n in names for a in ACTIVE_PARTS):
        return f"active or embedded content: {name}"
    return None


# ---- Word


def _node_text(node: ElementTree.Element) -> str:
    told = {f"{W}tab": "\t", f"{W}br": "\n", f"{W}cr": "\n"}
    return "".join(n.text or "" if n.tag == f"{W}t" else told.get(n.tag, "") for n in node.iter()).strip()


def table_text(rows: list[list[str]]) -> str:
    """Rows of cells as lines; blank cells and rows do not count."""
    rows = [kept for row in rows if (kept := [c for c in row if c])]
    if not rows:
        return ""
    head, *rest = rows
    if rest and all(len(r) == 1 for r in rows):
        return "\n".join(["Table:", *(f"Entry {i}:\nPrompt: {head[0]}\nAnswer: {r[0]}" for i, r in enumerate(rest, 1))])
    if not rest or len(head) < 2:
        return "\n".join(["Table:", *(f"Row {i}: " + " | ".join(f"Cell {j}: {c}" for j, c in enumerate(r, 1)) for i, r in enumerate(rows, 1))])
    body = (" | ".join([f"{h}: {c}" for h, c in zip(head, r)] + r[len(head) :]) for r in rest)
    return "\n".join(["Table:", f"Columns: {' | '.join(head)}", *(f"Row {i}: {b}" for i, b in enumerate(body, 1))])


def _table(node: ElementTree.Element) -> str:
    return table_text([[" ".join(_node_text(c).split()) for c in row.findall(f"{W}tc")] for row in node.findall(f"{W}tr")])


def docx_text(content: bytes) -> str:
    """Body, headers, footers and notes, in the archive's order."""
    wanted = re.compile(r"word/(?:document|(?:header|footer)\d+|footnotes|endnotes)\.xml")
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        roots = [ElementTree.fromstring(archive.read(n)) for n in archive.namelist() if wanted.fullmatch(n)]
    blocks: list[str] = []
    for root in roots:
        body = root.find(f".//{W}body")
        found = [_node_text(n) if n.tag == f"{W}p" else _table(n) for n in (root if body is None else body) if n.tag in (f"{W}p", f"{W}tbl")]
        blocks += [b for b in found if b] or [b for b in map(_node_text, root.iter(f"{W}p")) if b]
    return "\n\n".join(blocks)


def pptx_slides(content: bytes) -> list[Section]:
    """Slides by file number, numbered 1 to n."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        numbered = sorted((int(m.group(1)), m.group()) for n in archive.namelist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n)))
        roots = [ElementTree.fromstring(archive.read(name)) for _, name in numbered]
    lines = [["".join(t.text or "" for t in p.iter(f"{A}t")).strip() for p in root.iter(f"{A}p")] for root in roots]
    return [("\n".join(filter(None, slide)), i) for i, slide in enumerate(lines, 1)]


Ocr = Callable[[bytes, int, str], str]


def pdf_pages(content: bytes, ocr: Ocr | None = None, language: str = "eng") -> list[Section]:
    """Pages from 1; ``ocr(content, page, language)``, pages from 0 there, reads those of fewer than ten word characters."""
    try:
        from pypdf import PdfReader
    except ImportError as e:
        raise RuntimeError("PDF files need the pypdf package") from e
    pages = []
    try:
        for i, page in enumerate(PdfReader(io.BytesIO(content)).pages):
            text = (page.extract_text() or "").strip()
            if ocr and len(re.findall(r"\w", text)) < 10:
                text = ocr(content, i, language).strip()
            pages.append((text, i + 1))
    except (RuntimeError, ValueError):
        raise
    except Exception as e:
        raise ValueError(f"cannot read a PDF: {e}") from e
    return pages


def sections_of(name: str, content: bytes, ocr: Ocr | None = None, language: str = "eng") -> list[Section]:
    suffix = suffix_of(name)
    try:
        if suffix == ".docx":
            return [(docx_text(content), None)]
        if suffix == ".pptx":
            return pptx_slides(content)
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
        raise ValueError(f"cannot read {name}: {e}") from e
    if suffix == ".pdf":
        return pdf_pages(content, ocr, language)
    return [(re.sub(r"\r\n?", "\n", content.decode("utf-8")), None)]


def extract_text(name: str, content: bytes, ocr: Ocr | None = None, language: str = "eng") -> str:
    return "\n\n".join(text for text, _ in sections_of(name, content, ocr, language))


# ---- Spark


def is_mounted(root: str) -> bool:
    """Whether tasks can open paths below it; file systems that only Spark reads have another scheme."""
    return re.match(r"file:|(?![A-Za-z][A-Za-z0-9+.-]*:)", root) is not None


def local_path(root: str) -> str:
    return os.path.abspath(re.sub("^file:/+", "/", root))


def scan_files(spark: SparkSession, root: str, streaming: bool = False, content: bool = True) -> DataFrame:
    """``(source, sha256, size, mtime, problem[, content])`` of files of an accepted type below ``root``; ``source`` is relative to it.

    Streams, and file systems that are not mounted, are read by Spark's own source: there, names that begin with a dot or an underscore are hidden and
    ``problem`` is null until the content is checked.
    """
    if not streaming and is_mounted(root):
        from .folder import scan_folder

        if not os.path.isdir(local_path(root)):
            raise FileNotFoundError(root)
        return scan_folder(spark, local_path(root), content)
    if streaming:
        files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    else:
        fs_path = spark._jvm.org.apache.hadoop.fs.Path(root)
        fs = fs_path.getFileSystem(spark._jsc.hadoopConfiguration())
        if not fs.exists(fs_path) or not fs.getFileStatus(fs_path).isDirectory():
            raise FileNotFoundError(root)
        files = spark.read.format("binaryFile")
    loaded = files.option("recursiveFileLookup", "true").load(root)
    accepted = loaded.where(F.lower("path").rlike("(" + "|".join(map(re.escape, SUFFIXES)) + ")$"))
    base = re.sub(r"^[a-z]+:/+", "/", root.rstrip("/") + "/")
    source = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/+", "/"), "^" + re.escape(base), "")
    return accepted.select(source.alias("source"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), F.lit(None).cast("string").alias("problem"), *(["content"] if content else []))


def extract_sections(files: DataFrame, ocr: Ocr | None = None, language: str = "eng", strict: bool = True) -> DataFrame:
    """``(source, sha256, section, page, text)``. ``strict``: one refused file fails the load, else it is left out."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for f in frame.itertuples(index=False):
                content = bytes(f.content or b"")
                if why := f.problem or problem(f.source, content):
                    if strict:
                        raise ValueError(why)
                    continue
                rows += [(f.source, f.sha256, i, page, text) for i, (text, page) in enumerate(sections_of(f.source, content, ocr, language))]
            found = pd.DataFrame(rows, columns=["source", "sha256", "section", "page", "text"])
            yield found.astype({"page": "Int32"})

    return files.select("source", "sha256", "problem", "content").mapInPandas(work, "source string, sha256 string, section int, page int, text string")


def refused_files(files: DataFrame) -> DataFrame:
    """``(source, problem)``."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            told = [why or problem(s, bytes(c)) for s, why, c in zip(frame["source"], frame["problem"], frame["content"])]
            yield pd.DataFrame({"source": frame["source"], "problem": told}).dropna()

    return files.select("source", "problem", "content").mapInPandas(work, "source string, problem string")


def import_documents(paths: list[str | Path], destination: str | Path) -> tuple[list[Path], list[str]]:
    """Copies of accepted files, and the names left out. A taken name gets a number; a copy appears only once it is whole and checked."""
    target, copied, skipped = Path(destination), [], []
    target.mkdir(parents=True, exist_ok=True)
    for path in map(Path, paths):
        if path.is_symlink() or not path.is_file() or problem_of_size(path.name, path.stat().st_size) or problem(path.name, path.read_bytes()):
            skipped.append(path.name)
            continue
        place, n = target / path.name, 2
        while place.exists():
            place, n = target / f"{path.stem} ({n}){path.suffix}", n + 1
        handle, temporary = tempfile.mkstemp(dir=target, prefix=".import-", suffix=path.suffix)
        os.close(handle)
        try:
            shutil.copyfile(path, temporary)
            if why := problem(path.name, Path(temporary).read_bytes()):
                raise ValueError(why)
            os.chmod(temporary, 0o600)
            os.replace(temporary, place)
        except BaseException:
            Path(temporary).unlink(missing_ok=True)
            raise
        copied.append(place)
    return copied, skipped
