"""Operators of a training-data pipeline: tokens, media, sharding, packing, quality, duplicates, PII, secrets, vectors."""
