"""Column functions on sequences."""

from .alphabet import complement, mismatches, nibbles, reverse_complement

__all__ = ["complement", "mismatches", "nibbles", "reverse_complement"]
