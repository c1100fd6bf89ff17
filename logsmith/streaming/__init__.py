"""Structured Streaming jobs: micro-batch ingest (T1), request-log ingest (T2), live tail
(T3), processing-time stamp (T4) and the windowed rate audit (T5)."""
