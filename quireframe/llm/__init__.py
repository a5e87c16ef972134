"""Training-data operators: dedup, tokens, licences, mixing, quality, WARC, embeddings.

Nothing outside this subpackage imports it.
"""
