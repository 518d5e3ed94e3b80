"""The queries of this subpackage by name, with SQL where SQL can express them."""

from __future__ import annotations

from .cross_tokens import op12_cross_tokenizer
from .edit_counts import op6_edit_counts
from .media import op5_media_columns
from .one_permutation import op13_document_fingerprints
from .packing import op3_best_fit_packing
from .pieces import op7_sentencepiece
from .quality_classifier import op9_quality_classifier
from .quality_rules import op8_quality_rules
from .simhash import op4_simhash
from .substrings import op10_substring_dedup
from .toxicity import op2_toxicity_chain
from .url_filter import op1_url_filter
from .vector_codes import OP11_SQL, op11_vector_codes


def pipeline(spark, sf_dir: str):
    import corpus_pipeline  # at the repository's top, over the stages of this subpackage

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "pipeline": pipeline,
    "op1_url_filter": op1_url_filter,
    "op2_toxicity_chain": op2_toxicity_chain,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_simhash": op4_simhash,
    "op5_media_columns": op5_media_columns,
    "op6_edit_counts": op6_edit_counts,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_quality_rules": op8_quality_rules,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_vector_codes": op11_vector_codes,
    "op12_cross_tokenizer": op12_cross_tokenizer,
    "op13_document_fingerprints": op13_document_fingerprints,
}
ORACLE: dict[str, str] = {"op11_vector_codes": OP11_SQL}
