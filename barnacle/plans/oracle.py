"""DuckDB SQL for what the counters return, written from their definitions: every place against every barcode."""

from __future__ import annotations

from ..functions.alphabet import IUPAC, expansions
from .synth import duck
from .template import Template, strands


def hits(name: str, source: str, column: str, template: str, strand: str, k: int, keep: str = "") -> list[str]:
    parts = []
    for flip in strands(strand):
        t = Template.of(template)
        r = t.reversed() if flip else t
        edges = [0, *(e for x in r.regions for e in x), len(r)]
        cm = " + ".join(f"hamming(substr({column}, p + {a + 1}, {b - a}), '{r.text[a:b]}')" for a, b in zip(edges[::2], edges[1::2]) if b > a) or "0"
        v = [f"substr({column}, p + {a + 1}, {b - a})" for a, b in r.regions]
        v = [f"reverse(translate({x}, 'ACGT', 'TGCA'))" for x in v][::-1] if flip else v
        cols = ", ".join(f"{x} AS v{i}" for i, x in enumerate(v))
        parts.append(f"SELECT {keep or column}, p * 2 + {int(flip)} AS place, p, {str(flip).lower()} AS is_reverse, ({cm})::BIGINT AS cm, {cols} FROM (SELECT DISTINCT {keep or column} FROM {source}) s, unnest(generate_series(0, length({column}) - {len(r)})) t(p)")
    return [f"{name} AS (SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE cm <= {k})"]


def plain_pool(name: str, source: str) -> list[str]:
    return [f"{name} AS ({duck(source)})"]


def iupac_pool(name: str, source: str) -> list[str]:
    """With a row for each expansion of the fourth base."""
    codes = ", ".join(f"('{c}', '{b}')" for c in IUPAC for b in expansions(c))
    return [f"{name}_raw AS ({duck(source)})", f"{name} AS (SELECT idx, substr(barcode, 1, 3) || b || substr(barcode, 5) AS barcode, barcode AS code FROM {name}_raw JOIN (VALUES {codes}) c(c, b) ON substr(barcode, 4, 1) = c)"]


def resolve(name: str, source: str, v: str, pool: str, k: int, first: bool = False) -> list[str]:
    return [
        f"{name}_n AS (SELECT {v} AS v, idx, min(hamming({v}, barcode)) AS d FROM (SELECT DISTINCT {v} FROM {source}), {pool} WHERE hamming({v}, barcode) <= {k} GROUP BY ALL)",
        f"{name} AS (SELECT v, d, min(idx) AS idx FROM (SELECT *, min(d) OVER (PARTITION BY v) AS m FROM {name}_n) WHERE d = m GROUP BY v, d{'' if first else ' HAVING count(*) = 1'})",
    ]


def pick(name: str, source: str, key: str, best: bool, order: str = "place") -> list[str]:
    if best:
        return [f"{name} AS (SELECT {key}, min(idx) AS idx, min(total) AS total FROM (SELECT *, min(total) OVER (PARTITION BY {key}) AS m FROM {source}) WHERE total = m GROUP BY {key} HAVING min(idx) = max(idx))"]
    return [f"{name} AS (SELECT {key}, arg_min(idx, {order}) AS idx, arg_min(total, {order}) AS total FROM {source} GROUP BY {key})"]


def single(name: str, source: str, column: str, template: str, pool: str, k: int, best: bool, strand: str, first: bool = False) -> list[str]:
    """name (column, idx, total)."""
    return [
        *hits(f"{name}_h", source, column, template, strand, k),
        *resolve(f"{name}_r", f"{name}_h", "v0", pool, k, first),
        f"{name}_t AS (SELECT {column}, place, idx, cm + d AS total FROM {name}_h JOIN {name}_r ON v0 = v WHERE cm + d <= {k})",
        *pick(name, f"{name}_t", column, best),
    ]


def combo(name: str, source: str, template: str, k: int, best: bool, strand: str, pools: tuple[str, str], first: bool = False) -> list[str]:
    """name (seq, idx, total), idx being i0 * 1000000 + i1."""
    return [
        *hits(f"{name}_h", source, "seq", template, strand, k),
        *resolve(f"{name}_r0", f"{name}_h", "v0", pools[0], k, first),
        *resolve(f"{name}_r1", f"{name}_h", "v1", pools[1], k, first),
        f"{name}_t AS (SELECT seq, place, a.idx * 1000000 + b.idx AS idx, cm + a.d + b.d AS total FROM {name}_h JOIN {name}_r0 a ON v0 = a.v JOIN {name}_r1 b ON v1 = b.v WHERE cm + a.d + b.d <= {k})",
        *pick(name, f"{name}_t", "seq", best),
    ]


def dual(name: str, source: str, template: str, k: int, best: bool, strand: str, rows: str) -> list[str]:
    return [
        *hits(f"{name}_h0", source, "seq", template, strand, k),
        f"{name}_h AS (SELECT *, v0 || v1 AS v01 FROM {name}_h0)",
        f"{name}_p AS (SELECT idx, x || y AS barcode FROM {rows})",
        *resolve(f"{name}_r", f"{name}_h", "v01", f"{name}_p", k),
        f"{name}_t AS (SELECT seq, place, idx, cm + d AS total FROM {name}_h JOIN {name}_r ON v01 = v WHERE cm + d <= {k})",
        *pick(name, f"{name}_t", "seq", best),
    ]


def dual_paired(name: str, source: str, columns: tuple[str, str], templates: tuple[str, str], ks: tuple[int, int], best: bool, rows: str, ties: bool = False) -> list[str]:
    """name (seq1, seq2, idx, total); ties: with rows of a null idx where best hits differ."""
    h = [hits(f"{name}_h{i}", source, c, t, "original", k) for i, (c, t, k) in enumerate(zip(columns, templates, ks), 1)]
    tied = [f"{name} AS (SELECT seq1, seq2, CASE WHEN min(idx) = max(idx) THEN min(idx) END AS idx, min(total) AS total FROM (SELECT *, min(total) OVER (PARTITION BY seq1, seq2) AS m FROM {name}_t) WHERE total = m GROUP BY seq1, seq2)"]
    return [
        *h[0],
        *h[1],
        f"{name}_b AS (SELECT s.seq1, s.seq2, a.p AS p1, b.p AS p2, a.cm AS c1, b.cm AS c2, a.v0 AS v1, b.v0 AS v2 FROM (SELECT DISTINCT seq1, seq2 FROM {source}) s JOIN {name}_h1 a ON s.{columns[0]} = a.{columns[0]} JOIN {name}_h2 b ON s.{columns[1]} = b.{columns[1]})",
        f"{name}_n AS (SELECT v1, v2, c1, c2, idx, hamming(v1, x) + hamming(v2, y) AS d FROM (SELECT DISTINCT v1, v2, c1, c2 FROM {name}_b), {rows} WHERE c1 + hamming(v1, x) <= {ks[0]} AND c2 + hamming(v2, y) <= {ks[1]})",
        f"{name}_r AS (SELECT v1, v2, c1, c2, d, min(idx) AS idx FROM (SELECT *, min(d) OVER (PARTITION BY v1, v2, c1, c2) AS m FROM {name}_n) WHERE d = m GROUP BY ALL HAVING count(*) = 1)",
        f"{name}_t AS (SELECT seq1, seq2, p1, p2, idx, c1 + c2 + d AS total FROM {name}_b JOIN {name}_r USING (v1, v2, c1, c2))",
        *(tied if ties else pick(name, f"{name}_t", "seq1, seq2", best, "p1 * 1000 + p2")),
    ]


def sql(ctes: list[str], select: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + select


def source(name: str, source_name: str) -> list[str]:
    return [f"{name} AS ({duck(source_name)})"]


def dense(match: str, reads: str, key: str, pool: str, columns: str) -> str:
    """Counts of every barcode or row."""
    return f"SELECT p.idx::BIGINT AS idx, {columns}, coalesce(c.n, 0)::BIGINT AS counts FROM {pool} p LEFT JOIN (SELECT idx, count(*) AS n FROM {reads} JOIN {match} USING ({key}) GROUP BY idx) c ON p.idx = c.idx"
