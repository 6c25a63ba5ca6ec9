"""The queries of this folder, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from hayrick.llm.centroids import OP13_SQL, op13_centroid_clustering
from hayrick.llm.cotraining import op7_cotraining
from hayrick.llm.decontamination import op8_decontamination
from hayrick.llm.filter_audit import OP11_SQL, op11_filter_audit
from hayrick.llm.impact_search import OP12_SQL, op12_top_k_search
from hayrick.llm.jaccard_join import OP6_SQL, op6_jaccard_join
from hayrick.llm.language_model import op1_language_model
from hayrick.llm.licenses import op4_licenses
from hayrick.llm.media import op9_audio_features
from hayrick.llm.packing import op5_best_fit_packing
from hayrick.llm.secrets import op10_secrets
from hayrick.llm.token_codes import op2_token_codes
from hayrick.llm.toxicity import op3_toxicity

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_language_model, op2_token_codes, op3_toxicity, op4_licenses, op5_best_fit_packing, op6_jaccard_join, op7_cotraining, op8_decontamination, op9_audio_features, op10_secrets, op11_filter_audit, op12_top_k_search, op13_centroid_clustering)}

#: The others read tokenizers, learn, compress or decode, which SQL can't.
ORACLE_SQL: dict[str, str] = {"op6_jaccard_join": OP6_SQL, "op11_filter_audit": OP11_SQL, "op12_top_k_search": OP12_SQL, "op13_centroid_clustering": OP13_SQL}
