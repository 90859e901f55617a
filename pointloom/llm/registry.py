"""The queries of this subpackage, and their SQL where there is any."""

from __future__ import annotations

from .chat import OP7_SQL, op7_typed_parts
from .exact_dedup import OP2_SQL, op2_heavy_hitter_split
from .interval_search import OP11_SQL, op11_interval_search
from .line_counts import OP13_SQL, op13_line_counts
from .line_dedup import OP8_SQL, op8_line_hashing
from .merkle_manifest import OP12_SQL, op12_butterfly_manifest
from .packing import op9_power_of_two
from .piece_codec import op6_offset_preserving
from .quality_rules import op1_compression_bands
from .simhash_dedup import op5_ball_hashing
from .subword_classifier import op10_subword_embeddings
from .toxicity import op4_weak_supervision
from .unigram_counts import op3_count_only_viterbi

QUERIES = {
    "op1_compression_bands": op1_compression_bands,
    "op2_heavy_hitter_split": op2_heavy_hitter_split,
    "op3_count_only_viterbi": op3_count_only_viterbi,
    "op4_weak_supervision": op4_weak_supervision,
    "op5_ball_hashing": op5_ball_hashing,
    "op6_offset_preserving": op6_offset_preserving,
    "op7_typed_parts": op7_typed_parts,
    "op8_line_hashing": op8_line_hashing,
    "op9_power_of_two": op9_power_of_two,
    "op10_subword_embeddings": op10_subword_embeddings,
    "op11_interval_search": op11_interval_search,
    "op12_butterfly_manifest": op12_butterfly_manifest,
    "op13_line_counts": op13_line_counts,
}

SQL = {"op2_heavy_hitter_split": OP2_SQL, "op7_typed_parts": OP7_SQL, "op8_line_hashing": OP8_SQL, "op11_interval_search": OP11_SQL, "op12_butterfly_manifest": OP12_SQL, "op13_line_counts": OP13_SQL}
