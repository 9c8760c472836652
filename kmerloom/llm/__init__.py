"""Operators for training-data work; nothing outside this subpackage imports it."""

from importlib import import_module

QUERY_MODULES = ["run_queries", "token_queries", "word_queries", "pair_queries", "similar_queries", "span_queries", "subject_queries", "mix_queries"]


def registries() -> list:
    return [import_module(f"kmerloom.llm.{m}").REG for m in QUERY_MODULES]
