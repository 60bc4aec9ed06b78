"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import audio, chat_format, html_extract, line_dedup, maxscore, mixing, near_dup, sentencepiece_codec, suffix_dedup, toxicity

MODULES = (sentencepiece_codec, near_dup, html_extract, maxscore, toxicity, audio, mixing, suffix_dedup, chat_format, line_dedup)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLE = {name: sql for module in MODULES for name, sql in module.ORACLE.items()}
