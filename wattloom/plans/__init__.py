"""Whole jobs: scenarios, source paths, ingest and index builds."""
