"""Training-data operators: token counts, toxicity, deduplication, language, chat, mixing, BPE.

Nothing else in the library imports this subpackage; ``queries`` holds the
registered queries.
"""
