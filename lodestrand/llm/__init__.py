"""Training-data operators: near-dedup, token counts, quality, PII, fingerprints,
decontamination, token files, packing, toxicity and page text.

Nothing else in the library imports this subpackage.
"""
