"""Operations of a training-data pipeline; nothing else in the library imports this."""

from cohortlens.llm import best_fit_packing, conversation_repair, html_text, importance_resampling, jaccard_join, line_dedup, quality_neighbours, quality_rules, retrieval_packing, simhash, source_mixing, toxicity, warc  # noqa: F401
from cohortlens.llm.registry import ORACLES, QUERIES  # noqa: F401
