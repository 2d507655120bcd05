"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from skuflow.llm import lexical_search
from skuflow.llm.alignment import op11_tokenizer_alignment
from skuflow.llm.byte_pairs import op12_byte_pair_encoding
from skuflow.llm.document_prints import op3_simhash_fingerprints
from skuflow.llm.lexical_search import op13_max_sketch_search
from skuflow.llm.licenses import op9_license_digests
from skuflow.llm.line_quality import op5_line_field_quality
from skuflow.llm.near_dedup import op6_simhash_near_dedup
from skuflow.llm.packing import op8_cutting_stock_packing
from skuflow.llm.pieces import op4_piece_encoding
from skuflow.llm.quality_rules import op2_divergence_rules
from skuflow.llm.sharding import op7_hash_tree_sharding
from skuflow.llm.token_files import op10_token_files
from skuflow.llm.toxicity import op1_compression_toxicity

QUERIES = {
    fn.__name__: fn for fn in (
        op1_compression_toxicity, op2_divergence_rules, op3_simhash_fingerprints,
        op4_piece_encoding, op5_line_field_quality, op6_simhash_near_dedup,
        op7_hash_tree_sharding, op8_cutting_stock_packing, op9_license_digests,
        op10_token_files, op11_tokenizer_alignment, op12_byte_pair_encoding, op13_max_sketch_search,
    )
}
ORACLE_SQL: dict[str, str] = {"op13_max_sketch_search": lexical_search.SQL}
