"""The library's front door: an index over a folder of documents, and answers to questions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.terms import flexible_answer
from .operators.answering import answer_questions
from .operators.chunking import chunk_sections
from .operators.evidence import Extractive, Generator
from .operators.index import Index, build_index, load_index, save_index
from .session import prepare
from .sources.embeddings import EmbeddingProvider, embed_missing
from .sources.files import Ocr, extract_sections, scan_files
from .sources.folder import with_content
from .sources.store import Store, collection_key
from .tables import materialize


@dataclass(frozen=True)
class Answer:
    question: str
    text: str
    sources: tuple[str, ...]
    results: tuple
    diagnostics: tuple[str, ...] = ()


class Engine:
    """Answers from an index. Without a vector model retrieval is lexical."""

    def __init__(self, index: Index, generator: Generator | type | Callable[[], Generator] = Extractive, neighbours: int = 0, embedder: EmbeddingProvider | None = None):
        if neighbours < 0:
            raise ValueError("the neighbour window must not be negative")
        if not index.chunks.head(1):
            raise ValueError("there is no document to answer from")
        self.index, self.generator, self.neighbours, self.embedder, self.closed = index, generator, neighbours, embedder, False

    @classmethod
    def from_directory(
        cls,
        spark: SparkSession,
        directory: str | Path,
        generator: Generator | type | Callable[[], Generator] = Extractive,
        chunk_size: int | None = None,
        overlap: int | None = None,
        make_embedder: Callable[[], EmbeddingProvider] | None = None,
        embedding_model: str = "model",
        cache: str | None = ".corvane_cache",
        neighbours: int = 0,
        ocr: Ocr | None = None,
        ocr_language: str = "eng",
        progress: Callable[[str, int, int], None] | None = None,
        cancelled: Callable[[], bool] | None = None,
    ) -> Engine:
        """Files whose digest is stored are not extracted again; ``progress(stage, i, n)`` and ``cancelled()`` are called between stages."""
        stages = ["scan", "extract", "chunk", *(["embed"] if make_embedder else []), "index"]

        def enter(stage: str) -> None:
            if cancelled and cancelled():
                raise RuntimeError("Indexing cancelled")
            if progress:
                progress(stage, stages.index(stage) + 1, len(stages))

        prepare(spark)
        enter("scan")
        files = materialize(scan_files(spark, str(directory), content=False), "listing")
        for refused in files.where("problem IS NOT NULL").orderBy("source").take(1):
            raise ValueError(refused["problem"])
        store = Store(spark, str(cache)) if cache else None
        enter("extract")
        if store:
            key = collection_key(str(directory), bool(ocr), ocr_language)
            store.put_sections(key, extract_sections(with_content(store.stale(key, files), str(directory)), ocr, ocr_language), files)
            sections = store.sections(key)
        else:
            sections = extract_sections(with_content(files, str(directory)), ocr, ocr_language)
        enter("chunk")
        chunks = materialize(chunk_sections(sections, chunk_size, overlap), "chunks")
        if make_embedder:
            if not store:
                raise ValueError("embeddings need a cache folder")
            enter("embed")
            chunks = materialize(chunks.join(embed_missing(store, embedding_model, chunks, make_embedder).distinct(), "text", "left"), "vectors")
        enter("index")
        index = build_index(chunks, exact=True)
        if store:  # questions then plan from files, not from everything that made them
            save_index(index, f"{cache}/index/{key}")
            index = load_index(spark, f"{cache}/index/{key}")
        return cls(index, generator, neighbours, make_embedder() if make_embedder else None)

    def save(self, path: str) -> None:
        save_index(self.index, path)

    @classmethod
    def load(cls, spark: SparkSession, path: str, **options) -> Engine:
        return cls(load_index(prepare(spark), path), **options)

    def ask_all(self, questions: DataFrame, k: int | None = None) -> DataFrame:
        """``questions(question_id, question[, vector])`` to one answer a row."""
        if self.closed:
            raise RuntimeError("the engine is closed")
        return answer_questions(self.index, questions, self.generator, k, self.neighbours)

    def ask(self, question: str, k: int | None = None, flexible: bool = False) -> Answer:
        if self.closed:
            raise RuntimeError("the engine is closed")
        if k is not None and k < 1:
            raise ValueError("k must be positive")
        spark = self.index.chunks.sparkSession
        if self.embedder and question.strip():
            asked = spark.createDataFrame([(0, question, [float(x) for x in self.embedder.embed_query(question)])], "question_id int, question string, vector array<double>")
        else:
            asked = spark.createDataFrame([(0, question)], "question_id int, question string")
        row = self.ask_all(asked, k).withColumn("shown", flexible_answer(F.col("question"), F.col("text"))).first()
        return Answer(question, row["shown"] if flexible else row["text"], tuple(row["sources"]), tuple(row["results"]), tuple(row["diagnostics"]))

    def close(self) -> None:
        if not self.closed:
            self.closed = True
            for part in (self.generator, self.embedder):
                if part is not None and not isinstance(part, type) and hasattr(part, "close"):
                    part.close()

    def __enter__(self) -> Engine:
        return self

    def __exit__(self, *_) -> None:
        self.close()
