from .text import (
    WHITESPACE_CLASS,
    WHITESPACE_RUN,
    bigrams,
    combine_title_and_chunk,
    explode_tokens,
    pool_doc_id,
    seeded_key,
    strip,
    token_pairs,
    tokenize,
)
from .vectors import dot

__all__ = [
    "WHITESPACE_CLASS", "WHITESPACE_RUN", "bigrams", "combine_title_and_chunk", "explode_tokens", "pool_doc_id",
    "seeded_key", "strip", "token_pairs", "tokenize", "dot",
]
