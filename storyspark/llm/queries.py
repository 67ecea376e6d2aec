"""Queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

import corpus_pipeline
from storyspark.llm import licenses, resample, secrets, url_filter
from storyspark.llm.conversation_repair import op13_conversation_repair
from storyspark.llm.decontaminate import op8_benchmark_decontamination
from storyspark.llm.html_extract import op1_html_extraction
from storyspark.llm.language_id import op3_language_id
from storyspark.llm.lattice import op4_embedding_near_dedup
from storyspark.llm.line_dedup import op2_line_dedup
from storyspark.llm.ngram_join import op9_ngram_jaccard_join
from storyspark.llm.packing import op10_best_fit_packing
from storyspark.llm.token_counts import op12_token_counts

QUERIES = {f.__name__: f for f in (op1_html_extraction, op2_line_dedup, op3_language_id, op4_embedding_near_dedup, licenses.op5_license_scan, url_filter.op6_url_filter, secrets.op7_secret_scan, op8_benchmark_decontamination, op9_ngram_jaccard_join, op10_best_fit_packing, resample.op11_importance_resampling, op12_token_counts, op13_conversation_repair)}
QUERIES["pipeline"] = corpus_pipeline.run

ORACLE_SQL = {"op5_license_scan": licenses.SQL, "op6_url_filter": url_filter.SQL, "op11_importance_resampling": resample.SQL}
