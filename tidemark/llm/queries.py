"""Queries of this subpackage, by name; SQL where SQL can express them."""

from __future__ import annotations

from tidemark.llm.alignment import op11_cross_tokenizer_alignment
from tidemark.llm.bpe import op7_byte_bpe
from tidemark.llm.collocations import OP12_SQL, op12_phrase_collocations
from tidemark.llm.embedding_dedup import op6_projection_passes
from tidemark.llm.imatch import op9_imatch_fingerprints
from tidemark.llm.line_dedup import op5_line_dedup
from tidemark.llm.mixing import OP13_SQL, op13_source_mixing
from tidemark.llm.packing import op8_best_fit_packing
from tidemark.llm.quality import op1_bradley_terry_quality
from tidemark.llm.simhash import op3_simhash_near_dedup
from tidemark.llm.token_counts import op10_edit_aware_token_counts
from tidemark.llm.toxicity import op4_toxicity_nearest
from tidemark.llm.warc import OP2_SQL, op2_warc_index_merge

QUERIES = {
    "op1_bradley_terry_quality": op1_bradley_terry_quality,
    "op2_warc_index_merge": op2_warc_index_merge,
    "op3_simhash_near_dedup": op3_simhash_near_dedup,
    "op4_toxicity_nearest": op4_toxicity_nearest,
    "op5_line_dedup": op5_line_dedup,
    "op6_projection_passes": op6_projection_passes,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_imatch_fingerprints": op9_imatch_fingerprints,
    "op10_edit_aware_token_counts": op10_edit_aware_token_counts,
    "op11_cross_tokenizer_alignment": op11_cross_tokenizer_alignment,
    "op12_phrase_collocations": op12_phrase_collocations,
    "op13_source_mixing": op13_source_mixing,
}
ORACLE_SQL: dict[str, str] = {"op2_warc_index_merge": OP2_SQL, "op12_phrase_collocations": OP12_SQL, "op13_source_mixing": OP13_SQL}
