"""Telemetry-corpus analytics as Spark DataFrame operators."""

from .schema import Corpus, open_corpus

__all__ = ["Corpus", "open_corpus"]
