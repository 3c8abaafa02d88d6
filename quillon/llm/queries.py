"""The queries of this package: name -> function(spark, sf_dir) -> DataFrame, and SQL where SQL can say it."""

from __future__ import annotations

from quillon.llm.bestfit_packing import op5_best_fit_packing
from quillon.llm.line_similarity_dedup import OP1_SQL, op1_line_similarity_dedup
from quillon.llm.mil_quality import op7_mil_quality
from quillon.llm.ngram_overlap_join import OP9_SQL, op9_ngram_overlap_join
from quillon.llm.robust_outliers import op10_robust_outliers
from quillon.llm.substring_sketch import OP3_SQL, op3_substring_sketch
from quillon.llm.template_decontamination import op6_template_decontamination
from quillon.llm.template_extraction import OP8_SQL, op8_template_extraction
from quillon.llm.toxicity_lexicon import op4_toxicity_lexicon
from quillon.llm.warc_dictionary import OP2_SQL, op2_dictionary_warc

QUERIES = {f.__name__: f for f in (op1_line_similarity_dedup, op2_dictionary_warc, op3_substring_sketch, op4_toxicity_lexicon, op5_best_fit_packing, op6_template_decontamination, op7_mil_quality, op8_template_extraction, op9_ngram_overlap_join, op10_robust_outliers)}

SQL: dict[str, str] = {"op1_line_similarity_dedup": OP1_SQL, "op2_dictionary_warc": OP2_SQL, "op3_substring_sketch": OP3_SQL, "op8_template_extraction": OP8_SQL, "op9_ngram_overlap_join": OP9_SQL}
