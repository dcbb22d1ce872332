"""Training-data operators: licences, packing, URL filters, near and exact
duplicates, decontamination, token rollups, toxicity, PII and quality.

Nothing outside this subpackage imports it.
"""
