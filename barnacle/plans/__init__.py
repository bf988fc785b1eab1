"""Templates, and reads synthesised from tables."""

from .template import Strand, Template, from_flanks, parse_template

__all__ = ["Strand", "Template", "from_flanks", "parse_template"]
