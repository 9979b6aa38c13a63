"""Incremental views over growing transcripts."""
