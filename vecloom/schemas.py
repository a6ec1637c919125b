"""The tables of an index and its elements."""

from __future__ import annotations

VECTORS = "id long, vec array<float>"
VECTORS_INT = "id long, vec array<tinyint>"
DICTIONARY = "word_id int, word string, vec array<float>"
TERMS = "id long, term_ids array<int>"
GRAPH = "shard int, layer int, node long, neighbors array<long>"
RESULT = "query_id long, rank int, id long, dist double"
PERMUTATION = "new_id long, old_id long"

ELEMENT_TYPES = ("angular", "angular_int", "embeddings")


def element_type(name: str) -> str:
    """The element type by name, in any letter case."""
    low = name.lower()
    if low not in ELEMENT_TYPES:
        raise ValueError(f"unknown element type: {name}")
    return low
