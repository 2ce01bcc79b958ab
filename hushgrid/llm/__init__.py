"""Training-data operators: near-duplicate joins, packing, filters, language models, search and fingerprints.

Nothing else in the library imports this subpackage. Queries and their SQL are in ``queries``.
"""
