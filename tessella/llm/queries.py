"""The queries of this subpackage, each an operator applied to its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from tessella.llm.fingerprints import op3_order_minhash
from tessella.llm.line_dedup import op6_fuzzy_line_dedup
from tessella.llm.mixing import op2_mix_to_weights
from tessella.llm.near_join import OP7_SQL, op7_ngram_jaccard_join
from tessella.llm.neighbours import OP9_SQL, op9_nearest_vectors
from tessella.llm.pieces import op1_sentencepiece
from tessella.llm.quality import op5_quality_classifier
from tessella.llm.sharding import op4_feistel_sharding
from tessella.llm.toxicity import op8_toxicity
from tessella.llm.warc import OP10_SQL, op10_warc_round_trip

QUERIES = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_mix_to_weights": op2_mix_to_weights,
    "op3_order_minhash": op3_order_minhash,
    "op4_feistel_sharding": op4_feistel_sharding,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_fuzzy_line_dedup": op6_fuzzy_line_dedup,
    "op7_ngram_jaccard_join": op7_ngram_jaccard_join,
    "op8_toxicity": op8_toxicity,
    "op9_nearest_vectors": op9_nearest_vectors,
    "op10_warc_round_trip": op10_warc_round_trip,
}

ORACLES: dict[str, str] = {
    "op7_ngram_jaccard_join": OP7_SQL,
    "op9_nearest_vectors": OP9_SQL,
    "op10_warc_round_trip": OP10_SQL,
}
