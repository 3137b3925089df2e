"""Training-data operators: quality, language, duplicates, mixing, packing,
search, language-model scores, fingerprints, licences and chat formatting.

Nothing else in the library imports this subpackage.
"""
