"""Settings of a knowledge base engine; passed explicitly, nothing is read at import time."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    default_kb: str = "default"
    chunk_size: int = 2000
    chunk_overlap: int = 20
    min_chunk: int = 20
    min_document: int = 10
    embed_cap: int = 8000
    embed_width: int = 64
    embed_batch: int = 10
    top_k: int = 5
    hops: int = 3
    first_k: int = 5
    refined_k: int = 3
    history_turns: int = 3
    background_cap: int = 1500
    analysis_preview: int = 200
    min_page: int = 15
    min_sentence: int = 20
    top_keywords: int = 5
    top_titles: int = 3
    top_sentences: int = 6
    segment_length: int = 400
