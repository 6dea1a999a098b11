"""Structured Streaming jobs (A8 file ingestion, J2 load-file alignment, G3 windows with watermark)."""

from tessera.streaming.ingest import consume_once, ingest_new_files, run_available_now
from tessera.streaming.windows import daily_average_stream

__all__ = ["consume_once", "ingest_new_files", "run_available_now", "daily_average_stream"]
