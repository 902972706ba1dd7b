"""Operators of a training-data pipeline: language ID, dedup, mixing, extraction, filters, rollups, decontamination."""
