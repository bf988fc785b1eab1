"""Reads and barcodes made from the driver's tables, by SQL that Spark and DuckDB evaluate alike."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession


def bases(x: str, n: int) -> str:
    """SQL for n bases, the base-4 digits of a non-negative integer expression, lowest first."""
    return "(" + " || ".join(f"substr('ACGT', cast(cast(floor(({x}) / {4**i}) as bigint) % 4 as int) + 1, 1)" for i in range(n)) + ")"


def flipped(x: str) -> str:
    return f"reverse(translate({x}, 'ACGT', 'TGCA'))"


def long_barcode(key: str, change: str = "0") -> str:
    return bases(f"({key} * 1237 + {change}) % 65536", 8)


def short_barcode(key: str, change: str = "0") -> str:
    return bases(f"(({key}) % 25 * 41 + {change}) % 1024", 5)


#: One substitution in the barcode of some rows, several in that of others.
CHANGE = "case when l_quantity < 10 then 16 when l_quantity < 15 then 336 else 0 end"
LEFT = "'ACG' || case when l_linenumber = 3 then 'A' else 'T' end"

_single = f"{bases('l_orderkey', 4)} || {LEFT} || {long_barcode('l_suppkey', CHANGE)} || 'TGCA' || {bases('l_partkey', 3)}"
_two = f"{bases('l_orderkey', 2)} || {LEFT} || {long_barcode('l_suppkey', CHANGE)} || 'AAAA' || {{second}} || 'TGCA' || {bases('l_partkey', 2)}"
_combo = _two.format(second=short_barcode("l_partkey"))
_dual = _two.format(second=f"case when l_linenumber = 5 then {short_barcode('l_partkey')} else {short_barcode('l_suppkey')} end")
_either = lambda x: f"case when l_linenumber % 2 = 0 then {flipped(x)} else {x} end"
_mate1 = f"{bases('o_orderkey', 3)} || 'ACGT' || {long_barcode('(1 + o_custkey % 10)', 'case when o_orderkey % 7 = 0 then 16 else 0 end')} || 'TGCA' || {bases('o_custkey', 2)}"
_mate2 = f"'AGGA' || {short_barcode('case when o_orderkey % 11 = 0 then o_orderkey else 1 + o_custkey % 10 end', 'case when o_orderkey % 6 = 0 then 4 else 0 end')} || 'AGGA' || {bases('o_orderkey', 2)}"
_swap = "case when o_orderkey % 5 = 0 then {b} else {a} end"

#: Tables of reads and pools by name; `{table}` names a table of the driver's.
SQL = {
    "reads": f"SELECT {_single} AS seq, l_returnflag AS sample FROM {{lineitem}}",
    "reads_both": f"SELECT {_either('(' + _single + ')')} AS seq, l_returnflag AS sample FROM {{lineitem}}",
    "reads_combo": f"SELECT {_either('(' + _combo + ')')} AS seq, l_returnflag AS sample FROM {{lineitem}}",
    "reads_dual": f"SELECT {_either('(' + _dual + ')')} AS seq, l_returnflag AS sample FROM {{lineitem}}",
    "reads_random": f"SELECT {bases('event_id', 3)} || 'AAAAACGT' || {bases('user_id % 300', 6)} || case when event_id % 9 = 0 then 'ACGTGGGA' else 'ACGTGGGG' end || {bases('event_id', 2)} AS seq, event_type AS sample FROM {{events}}",
    "pairs": f"SELECT o_orderkey AS read_id, {_mate1} AS seq1, {_mate2} AS seq2, o_orderstatus AS sample FROM {{orders}}",
    "pairs_mixed": f"SELECT o_orderkey AS read_id, {_swap.format(a=_mate1, b=_mate2)} AS seq1, {_swap.format(a=_mate2, b=_mate1)} AS seq2, o_orderstatus AS sample FROM {{orders}}",
    "pool": f"SELECT s_suppkey AS idx, {long_barcode('s_suppkey')} AS barcode FROM {{supplier}}",
    "pool_iupac": f"SELECT idx, substr(barcode, 1, 3) || CASE idx % 3 WHEN 0 THEN 'R' WHEN 1 THEN 'N' ELSE 'Y' END || substr(barcode, 5) AS barcode FROM (SELECT s_suppkey AS idx, {long_barcode('s_suppkey')} AS barcode FROM {{supplier}}) t",
    "pool2": f"SELECT n_nationkey AS idx, {short_barcode('n_nationkey')} AS barcode FROM {{nation}}",
    "rows": f"SELECT s_suppkey AS idx, {long_barcode('s_suppkey')} AS x, {short_barcode('s_suppkey')} AS y FROM {{supplier}}",
    "queries": f"SELECT p_partkey, {long_barcode('p_partkey', 'case when p_size < 10 then 16 else 0 end')} AS seq FROM {{part}}",
    "repeated": f"SELECT c_custkey AS idx, {bases('c_custkey % 97 * 41 % 1024', 5)} AS barcode FROM {{customer}}",
}

SINGLE, COMBO, RANDOM, MATE1, MATE2 = "ACGTNNNNNNNNTGCA", "ACGTNNNNNNNNAAAANNNNNTGCA", "AAAAACGTNNNNNNACGTGGGG", "ACGTNNNNNNNNTGCA", "AGGANNNNNAGGA"


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in set(re.findall(r"\{(\w+)\}", SQL[name]))}
    return spark.sql(SQL[name], **tables)


def duck(name: str) -> str:
    return re.sub(r"\{(\w+)\}", r"\1", SQL[name])
