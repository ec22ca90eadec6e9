"""Training-data operators: mixing, language ID, ANN, HTML, fixity, dedup, toxicity, packing.

Self-contained: nothing outside this subpackage imports it.
"""
