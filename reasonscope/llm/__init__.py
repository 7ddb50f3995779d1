"""Operators of a training-data pipeline: scoring, token counts, fingerprints,
packing, chat formatting, dedup, byte-level BPE, HTML extraction, quality rules."""
