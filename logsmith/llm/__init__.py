"""Operators of a training-data pipeline (token counts, line dedup, chat formatting, SimHash,
WARC, quality rules, substring dedup, BPE, toxicity, decontamination). Nothing else in the
library imports this subpackage."""
