"""Corvane: document retrieval and grounded question answering on PySpark."""

from .engine import Answer, Engine

__all__ = ["Answer", "Engine"]
