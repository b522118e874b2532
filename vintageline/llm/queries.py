"""Registered queries of the subpackage and their SQL twins, by name."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from vintageline.llm.alignment import alignment_digest
from vintageline.llm.common import table
from vintageline.llm.embedding_dedup import LINKS_SQL, near_vectors
from vintageline.llm.language import language_digest
from vintageline.llm.lexical_search import SEARCH_SQL, ranked
from vintageline.llm.mixing import MIX_SQL, mix_digest
from vintageline.llm.neighbours import nearest_digest
from vintageline.llm.packing import packing_digest
from vintageline.llm.pii import pii_digest
from vintageline.llm.prefix_counts import token_count_digest
from vintageline.llm.repeats import REPEATS_SQL, repeats_digest
from vintageline.llm.scoring import scored
from vintageline.llm.simhash import simhash_digest
from vintageline.llm.token_files import token_file_digest

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")

PIECES = public_tokenizers.path("piece_bpe_32k.model")

BYTES = public_tokenizers.path("byte_bpe_50k.json")


def _over(name: str, operator: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The operator, applied to one whole table of a folder."""
    return lambda spark, folder: operator(table(spark, folder, name))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_vectors": _over("embeddings", near_vectors),
    "op2_simhash": _over("documents", simhash_digest),
    "op3_nearest": _over("embeddings", nearest_digest),
    "op4_language": _over("documents", lambda documents: language_digest(documents, PIECES)),
    "op5_mix_sources": _over("documents", mix_digest),
    "op6_pack_sequences": _over("documents", lambda documents: packing_digest(documents, TOKENIZER)),
    "op7_lm_scores": _over("documents", scored),
    "op8_repeats": _over("documents", repeats_digest),
    "op9_pii_spans": _over("documents", pii_digest),
    "op10_token_files": _over("documents", lambda documents: token_file_digest(documents, TOKENIZER)),
    "op11_lexical_search": lambda spark, folder: ranked(
        table(spark, folder, "documents"), table(spark, folder, "benchmark")
    ),
    "op12_alignment": _over("documents", lambda documents: alignment_digest(documents, BYTES, PIECES)),
    "op13_token_counts": _over("documents", lambda documents: token_count_digest(documents, TOKENIZER)),
}

TWINS: dict[str, str] = {
    "op1_near_vectors": LINKS_SQL,
    "op5_mix_sources": MIX_SQL,
    "op8_repeats": REPEATS_SQL,
    "op11_lexical_search": SEARCH_SQL,
}
