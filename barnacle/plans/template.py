"""Barcode templates: constant bases with variable regions."""

from __future__ import annotations

import re
from dataclasses import dataclass

from ..functions.alphabet import reverse_complement_text

Strand = str
STRANDS = {"original": (False,), "reverse": (True,), "both": (False, True)}


def strands(strand: Strand, paired: bool = False) -> tuple[bool, ...]:
    """Whether each pass is on the reverse strand, in the order in which a position is tried."""
    if strand not in STRANDS or paired and strand == "both":
        raise ValueError(f"strand must be one of {[s for s in STRANDS if not (paired and s == 'both')]}, not {strand!r}")
    return STRANDS[strand]


@dataclass(frozen=True)
class Template:
    """text: upper-case bases, `-` in variable regions; regions: half-open, 0-based."""

    text: str
    regions: tuple[tuple[int, int], ...]

    @classmethod
    def of(cls, text: str, regions: int | None = None, fold: bool = True) -> Template:
        """N, and n if fold, stand for variable positions, as `-` does. regions: how many there must be."""
        if not text:
            raise ValueError("the template is empty")
        plain = re.sub("[nN]" if fold else "N", "-", text)
        if bad := re.search("[^ACGTacgt-]", plain):
            raise ValueError(f"unknown base '{bad[0]}' in the template")
        out = cls(plain.upper(), tuple(m.span() for m in re.finditer("-+", plain)))
        if not out.regions:
            raise ValueError("no variable region in the template")
        if regions is not None and len(out.regions) != regions:
            raise ValueError(f"expected {regions} variable region(s) in the template, found {len(out.regions)}")
        return out

    def __len__(self) -> int:
        return len(self.text)

    @property
    def lengths(self) -> list[int]:
        return [b - a for a, b in self.regions]

    def reversed(self) -> Template:
        """On the other strand, its regions in the read's order."""
        n = len(self.text)
        flipped = "-".join(reverse_complement_text(p) for p in self.text.split("-")[::-1])
        return Template(flipped, tuple((n - b, n - a) for a, b in reversed(self.regions)))


def from_flanks(flank5: str | None, flank3: str | None, length: int, template: str | None = None) -> str:
    """template if there is one, else the flanks around a variable region."""
    if template is not None:
        return template
    return (flank5 or "") + "-" * length + (flank3 or "")


def parse_template(template: str) -> dict:
    """variable: 1-based pos and len of each run of N; constant: what stands around them."""
    runs = [m.span() for m in re.finditer("N+", template)]
    if not runs:
        raise ValueError("no stretches of Ns detected in 'template'")
    edges = [0, *(e for r in runs for e in r), len(template)]
    return {"variable": [(a + 1, b - a) for a, b in runs], "constant": [template[a:b] for a, b in zip(edges[::2], edges[1::2])]}
