"""Template locations in reads."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.alphabet import mismatches, nibbles, reverse_complement
from ..plans.template import Template


def candidate_pattern(text: str, k: int) -> str:
    """A pattern that finds, at each place where a text with at most k substitutions in its constant bases may be, the rest of the read.

    Of k + 1 parts of the constant bases one is unchanged. It looks ahead, so places may overlap.
    """
    constant = [i for i, c in enumerate(text) if c != "-"]
    parts = [constant[len(constant) * i // (k + 1) : len(constant) * (i + 1) // (k + 1)] for i in range(k + 1)] if k < len(constant) else [[]]
    letters = ["".join(c if i in part else "." for i, c in enumerate(text)) for part in parts]
    each = [re.sub(r"\.{2,}", lambda m: f".{{{len(m[0])}}}", x) for x in letters]
    return f"(?is)(?=((?:{'|'.join(each)}).*))"


def strand_sites(column: str, template: Template, flip: bool, k: int, raw: bool) -> Column:
    """The places on one strand: pos, is_reverse, cm and v, the variable regions."""
    t, c = (template.reversed() if flip else template), F.col(column)
    found = F.regexp_extract_all(c, F.lit(candidate_pattern(t.text, k)), F.lit(1))
    edges = [0, *(e for r in t.regions for e in r), len(t)]
    constant = [(a, b) for a, b in zip(edges[::2], edges[1::2]) if b > a]

    def site(rest: Column) -> Column:
        part = lambda a, b: F.substring(rest, F.lit(a + 1), F.lit(b - a))
        cm = F.lit(0)
        if k and constant:
            same = F.concat(*(part(a, b) for a, b in constant)) == "".join(t.text[a:b] for a, b in constant)
            cm = F.when(same, 0).otherwise(mismatches(nibbles(part(0, len(t))), 0, t.text))
        v = [part(a, b) for a, b in t.regions]
        v = [reverse_complement(x) for x in v][::-1] if flip else v if raw else [F.translate(x, "acgt", "ACGT") for x in v]
        return F.struct((F.length(c) - F.length(rest)).alias("pos"), F.lit(flip).alias("is_reverse"), cm.cast("int").alias("cm"), F.array(*v).alias("v"))

    out = F.transform(found, site)
    return F.filter(out, lambda h: h["cm"] <= k) if k and constant else out


def sites(column: str, template: Template, reverse: tuple[bool, ...], k: int, raw: bool = False) -> Column:
    """All places of a template in a read as an array of structs, in the order in which they are tried: pos, is_reverse, cm and v.

    One search of the read for each strand finds the few candidates, and only these are looked at closely. v: the variable regions in the
    template's order and on its strand; raw leaves the case of a forward one as it is.
    """
    each = [strand_sites(column, template, flip, k, raw) for flip in reverse]
    every = each[0] if len(each) == 1 else F.sort_array(F.concat(*each))
    return F.coalesce(every, F.array().cast("array<struct<pos:int,is_reverse:boolean,cm:int,v:array<string>>>"))


def template_hits(reads: DataFrame, column: str, template: Template, reverse: tuple[bool, ...], substitutions: int, raw: bool = False) -> DataFrame:
    """reads with pos, is_reverse, cm and v0, v1, ... for each place where the constant bases fit."""
    rows = reads.withColumn("site", F.explode(sites(column, template, reverse, substitutions, raw)))
    return rows.select(*reads.columns, "site.pos", "site.is_reverse", "site.cm", *(F.col("site.v")[i].alias(f"v{i}") for i in range(len(template.regions))))
