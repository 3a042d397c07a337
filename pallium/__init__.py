"""Spark-native redaction and analysis of document tables and streams.

The main entry points, importable from the package root::

    from pallium import clean_text, tokenize_cascade, detokenize, analyze_texts, ResultStore
"""

from pallium.functions.text import clean_text
from pallium.operators.answers import build_prompt, parse_answer
from pallium.operators.cascade import detect, mapping, token_vault, tokenize_cascade
from pallium.operators.detokenize import detokenize, detokenize_json
from pallium.operators.spans import resolve_overlaps, tokenize_spans, tokenize_with_fallback
from pallium.plans.flows import NativeAnalyzer, analyze_files, analyze_texts, store_outcomes
from pallium.sources.store import ResultStore

__all__ = [
    "NativeAnalyzer",
    "ResultStore",
    "analyze_files",
    "analyze_texts",
    "build_prompt",
    "clean_text",
    "detect",
    "detokenize",
    "detokenize_json",
    "mapping",
    "parse_answer",
    "resolve_overlaps",
    "store_outcomes",
    "token_vault",
    "tokenize_cascade",
    "tokenize_spans",
    "tokenize_with_fallback",
]
