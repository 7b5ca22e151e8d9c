"""Training-data operators: filtering, deduplication, mixing and token output.

Nothing outside this subpackage imports it; ``queries`` registers its queries.
"""
