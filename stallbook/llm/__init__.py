"""Operators of a training-data pipeline: deduplication, decontamination, quality, toxicity, language, mixing, secrets."""
