"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from .centroids import op13_centroid_clustering
from .collocations import op12_phrase_collocations
from .fingerprints import op3_document_fingerprints
from .jaccard_join import op6_ngram_jaccard_join
from .language_model import op2_lm_scoring
from .near_vectors import op11_embedding_near_dedup
from .neighbours import op10_nearest_neighbours
from .packing import op8_best_fit_packing
from .personal import op5_pii
from .repeats import op7_suffix_array_dedup
from .sentencepiece import op9_sentencepiece
from .sharding import op1_sharding
from .sharding import oracle_sql as sharding_sql
from .toxicity import op4_toxicity

QUERIES: dict = {
    "op1_sharding": op1_sharding,
    "op2_lm_scoring": op2_lm_scoring,
    "op3_document_fingerprints": op3_document_fingerprints,
    "op6_ngram_jaccard_join": op6_ngram_jaccard_join,
    "op7_suffix_array_dedup": op7_suffix_array_dedup,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op4_toxicity": op4_toxicity,
    "op5_pii": op5_pii,
    "op10_nearest_neighbours": op10_nearest_neighbours,
    "op9_sentencepiece": op9_sentencepiece,
    "op11_embedding_near_dedup": op11_embedding_near_dedup,
    "op12_phrase_collocations": op12_phrase_collocations,
    "op13_centroid_clustering": op13_centroid_clustering,
}
ORACLE_SQL: dict[str, str] = {"op1_sharding": sharding_sql()}
