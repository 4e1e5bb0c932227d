"""Command line: ask questions about a folder of documents."""

from __future__ import annotations

import argparse
import json
import sys
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

from .engine import Answer, Engine
from .sources.embeddings import HashingEmbedder

EMBEDDERS = {"hashing": HashingEmbedder}
MODELS: dict[str, str] = {"extractive": "built in"}


def _at_least(least: int):
    def parse(text: str) -> int:
        if (value := int(text)) < least:
            raise argparse.ArgumentTypeError(f"must be at least {least}")
        return value

    return parse


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("corvane", description=__doc__)
    p.add_argument("question", nargs="*")
    p.add_argument("--config", help="JSON object of defaults for these options")
    p.add_argument("--verbose", action="store_true")
    p.add_argument("--docs", default="documents")
    p.add_argument("--top-k", type=_at_least(1))
    p.add_argument("--neighbor-window", type=_at_least(0), default=0)
    p.add_argument("--chunk-size", type=_at_least(1))
    p.add_argument("--overlap", type=_at_least(0))
    p.add_argument("--model", default="extractive", help="evidence selector; see --list-models")
    p.add_argument("--embedding-model", choices=sorted(EMBEDDERS), help="vectors for hybrid retrieval")
    p.add_argument("--cache-dir", default=".corvane_cache")
    p.add_argument("--ocr", action="store_true")
    p.add_argument("--ocr-language", default="eng")
    p.add_argument("--no-embeddings", action="store_true")
    p.add_argument("--download", action="store_true", help="no effect: nothing is downloaded")
    p.add_argument("--download-embedding", action="store_true", help="no effect: nothing is downloaded")
    p.add_argument("--flexible", action="store_true", help="put answers in the question's form")
    p.add_argument("--list-models", action="store_true")
    p.add_argument("--self-test", action="store_true")
    return p


def parse(argv: list[str] | None) -> argparse.Namespace:
    p = parser()
    config = p.parse_known_args(argv)[0].config
    if config:
        try:
            told = json.loads(Path(config).read_text("utf-8"))
        except (OSError, ValueError) as e:
            p.error(f"cannot read {config}: {e}")
        known = {a.dest for a in p._actions} - {"help", "config", "question"}
        if not isinstance(told, dict) or set(told) - known:
            p.error(f"{config} must be an object with known options" + (f", not {sorted(set(told) - known)}" if isinstance(told, dict) else ""))
        p.set_defaults(**told)
    args = p.parse_args(argv)
    for name, least in (("top_k", 1), ("neighbor_window", 0), ("chunk_size", 1), ("overlap", 0)):
        value = getattr(args, name)
        if value is not None and (not isinstance(value, int) or isinstance(value, bool) or value < least):
            p.error(f"{name} must be an integer of at least {least}")
    if args.chunk_size and args.overlap is not None and args.overlap >= args.chunk_size:
        p.error("overlap must be smaller than the chunk size")
    if args.model not in MODELS:
        p.error(f"unknown model {args.model}; known: {', '.join(MODELS)}")
    return args


def session() -> SparkSession:
    spark = SparkSession.builder.appName("corvane").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def show(answer: Answer, verbose: bool = False) -> str:
    lines = [answer.text] + (["", "Sources:", *(f"- {s}" for s in answer.sources)] if answer.sources else [])
    if verbose:
        lines += [f"[diagnostic] {d}" for d in answer.diagnostics]
        lines += [f"[result {r['rank']}] {r['source']} score={r['score']:.3f} confidence={r['confidence']:.3f}" for r in answer.results]
    return "\n".join(lines)


def self_test(spark: SparkSession) -> bool:
    """Two questions about a folder made for it: one answered, one declined."""
    with tempfile.TemporaryDirectory() as folder:
        Path(folder, "ice.txt").write_text("A glacier is a persistent body of dense ice. Glaciers move slowly under their own weight.")
        with Engine.from_directory(spark, folder, cache=None) as engine:
            told, declined = engine.ask("What is a glacier?"), engine.ask("Who composed the opera?")
    return "body of dense ice" in told.text and told.sources == ("ice.txt",) and not declined.sources


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parse(argv)
    if args.list_models:
        print("\n".join(f"{name}\t{state}" for name, state in MODELS.items()))
        return 0
    spark = spark or session()
    if args.self_test:
        good = self_test(spark)
        print("self-test passed" if good else "self-test failed")
        return 0 if good else 1
    embedder = EMBEDDERS[args.embedding_model] if args.embedding_model and not args.no_embeddings else None
    try:
        engine = Engine.from_directory(spark, args.docs, chunk_size=args.chunk_size, overlap=args.overlap, make_embedder=embedder, embedding_model=args.embedding_model or "", cache=args.cache_dir, neighbours=args.neighbor_window)
    except Exception as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    with engine:
        if args.question:
            print(show(engine.ask(" ".join(args.question), args.top_k, args.flexible), args.verbose))
            return 0
        while True:
            try:
                question = input("> ").strip()
            except EOFError:
                return 0
            if question.lower() in ("quit", "exit"):
                return 0
            if question:
                print(show(engine.ask(question, args.top_k, args.flexible), args.verbose))


if __name__ == "__main__":
    sys.exit(main())
