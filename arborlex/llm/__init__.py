"""Training-data operators: mixing, tokens, quality, scoring, near-duplicate and repeated-text removal.

Nothing outside this folder imports it; ``queries`` holds the registered queries.
"""
