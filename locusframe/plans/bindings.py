"""Variant-shaped tables derived from the given tables, as SQL that Spark and DuckDB both run.

Each entry of CTES is the body of a common table expression; ``with_tables`` puts together those that a query needs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: name -> (source tables and earlier names, SELECT).
CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "calls": (
        ("lineitem",),
        """SELECT l_orderkey % 50 AS sample_id, cast(l_suppkey % 22 + 1 AS varchar(9)) AS chrom, l_partkey % 400 * 50 + l_linenumber AS pos,
  substr('ACGT', cast(l_partkey % 4 + 1 AS int), 1) AS ref, substr('ACGT', cast((l_partkey + 1 + l_linenumber % 3) % 4 + 1 AS int), 1) AS alt,
  'G' || cast(l_suppkey % 25 AS varchar(9)) AS gene, cast(l_quantity AS int) AS dp, cast(round(l_tax * 1000) AS int) AS gq, cast(round(l_discount * 100) AS int) AS af_milli,
  CASE WHEN l_returnflag IN ('N', 'A') THEN 'PASS' ELSE '.' END AS filter,
  CASE l_linenumber % 5 WHEN 0 THEN '0/1' WHEN 1 THEN '0|1' WHEN 2 THEN '1|0' WHEN 3 THEN '1/1' ELSE '0/0' END AS gt,
  CASE l_orderkey % 6 WHEN 0 THEN 'missense' WHEN 1 THEN 'synonymous' WHEN 2 THEN 'frameshift' WHEN 3 THEN 'splice_donor' WHEN 4 THEN 'splice_region' ELSE 'intron' END AS consequence,
  cast(floor(l_extendedprice) AS bigint) % 100 AS splice_pct,
  ((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey AS ord FROM lineitem""",
    ),
    "kept": (("calls",), "SELECT *, af_milli / 500.0 AS af, splice_pct / 100.0 AS splice FROM calls WHERE filter = 'PASS' AND dp >= 10 AND gq >= 20 AND gt <> '0/0'"),
    "registry": (
        ("orders",),
        """SELECT cast(o_custkey % 22 + 1 AS varchar(9)) AS chrom, o_orderkey % 400 * 50 + o_custkey % 7 + 1 AS pos, substr('ACGT', cast(o_orderkey % 4 + 1 AS int), 1) AS ref,
  substr('ACGT', cast((o_orderkey + 1 + (o_custkey % 7 + 1) % 3) % 4 + 1 AS int), 1) AS alt, cast(substr(o_orderpriority, 1, 1) AS int) - 1 AS stars,
  CASE o_orderstatus WHEN 'F' THEN 'Pathogenic' WHEN 'O' THEN 'Likely benign' ELSE 'Conflicting classifications of pathogenicity' END AS significance, o_orderkey AS ord FROM orders""",
    ),
    "intervals": (("supplier",), "SELECT 'I' || cast(s_suppkey AS varchar(9)) AS gene, cast(s_suppkey % 22 + 1 AS varchar(9)) AS chrom, s_suppkey * 170 AS start, s_suppkey * 170 + 4200 AS stop FROM supplier"),
    "penetrance": (("nation", "region"), "SELECT 'G' || cast(n_nationkey AS varchar(9)) AS gene, r_name AS outcome, cast(n_nationkey + 10 AS double) AS risk_low_pct, cast(n_nationkey + 30 AS double) AS risk_high_pct, 50 + n_nationkey % 4 * 10 AS up_to_age FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "predictions": (("documents", "labels"), "SELECT d.doc_id AS key, source AS grp, lang AS class, quality AS label, ((n_chars * 7919 + d.doc_id * 104729) % 1000) / 1000.0 AS score FROM documents d JOIN labels l ON d.doc_id = l.doc_id"),
    "names": (
        ("lineitem",),
        """SELECT l_orderkey, l_linenumber, CASE l_partkey % 13 WHEN 0 THEN 'NM_007294.4(BRCA1):c.181T>G (p.Cys61Gly)' WHEN 1 THEN 'NM_1.2(AB1):c.5A>G (p.Ter214Leu)' WHEN 2 THEN 'NM_1.2(AB1):c.1A>G (p.Met1Val)'
  WHEN 3 THEN 'x (p.Met1?)' WHEN 4 THEN 'x (p.Arg5Ter)' WHEN 5 THEN 'x (p.Lys5=)' WHEN 6 THEN 'NM_1.2(CD2):c.10+' || cast(l_linenumber AS varchar(9)) || 'T>A' WHEN 7 THEN 'NM_1.2(CD2):c.10-' || cast(l_linenumber * 3 AS varchar(9)) || 'T>A'
  WHEN 8 THEN 'NM_1.2(CD2):c.-5G>A' WHEN 9 THEN 'NM_1.2(CD2):c.*5G>A' WHEN 10 THEN 'n.5A>G' WHEN 11 THEN 'x (p.Gly5fs)' ELSE 'NM_1.2(CD2):c.77G>A' END AS name FROM lineitem""",
    ),
    # calls as sites of a file: INFO names the gene by CSQ (kind 0, 5), by ANN (1), for another allele only (2), or not at all (3, 4)
    "sites": (
        ("calls",),
        """SELECT sample_id, ord AS line, chrom, pos, ref, alt, gene AS told, filter, gt, dp, gq, af_milli, splice_pct, consequence AS told_consequence, cast(splice_pct % 6 AS int) AS kind,
  'DB;AF=' || cast(af_milli / 1000.0 AS varchar(9)) || ';SpliceAI=' || alt || '|X|0.00|' || cast(splice_pct / 100.0 AS varchar(9)) || '|0.00|0.00' || CASE cast(splice_pct % 6 AS int)
   WHEN 0 THEN ';CSQ=' || alt || '|x|x|NONE,' || alt || '|' || consequence || '|x|' || gene || '|||T1||||c.5A>G|p.K5R|||5|K/R'
   WHEN 1 THEN ';CSQ=' || alt || '|x|x|NONE|||||||||||;ANN=' || alt || '|' || consequence || '|x|' || gene || '|||T2|||c.6A>G|.'
   WHEN 2 THEN ';CSQ=' || 'TTT' || '|' || consequence || '|x|' || gene || '|||T1'
   WHEN 5 THEN ';CSQ=|' || consequence || '|x|' || lower(gene) || '|||T3||||||||5|K' ELSE '' END AS info FROM calls""",
    ),
    "known": (("registry",), "SELECT *, 'G' || cast(ord % 23 AS varchar(9)) AS gene, 'missense' AS variant_class FROM registry"),
    "places": (("supplier",), "SELECT 'G' || cast(s_suppkey % 25 AS varchar(9)) AS gene, cast(s_suppkey % 22 + 1 AS varchar(9)) AS chrom, s_suppkey * 170 AS start, s_suppkey * 170 + 4200 AS stop FROM supplier"),
    "variants": (
        ("calls",),
        """SELECT ord, gene, chrom, pos, ref, alt, dp - 1 AS aa_pos, CASE dp % 8 WHEN 0 THEN 'start_lost' WHEN 1 THEN 'stop_lost' WHEN 2 THEN 'nonsense' WHEN 3 THEN 'synonymous' WHEN 4 THEN 'intronic' WHEN 5 THEN 'odd' ELSE 'missense' END AS variant_class,
  CASE dp % 8 WHEN 0 THEN 'M' WHEN 1 THEN '*' WHEN 3 THEN substr('*KR', cast(gq % 3 + 1 AS int), 1) WHEN 4 THEN '.' WHEN 5 THEN '.' ELSE substr('KRDW', cast(gq % 4 + 1 AS int), 1) END AS ref_aa,
  CASE dp % 8 WHEN 0 THEN '?' WHEN 2 THEN '*' WHEN 3 THEN substr('*KR', cast(gq % 3 + 1 AS int), 1) WHEN 4 THEN '.' WHEN 5 THEN '.' ELSE substr('KRDW?', cast(splice_pct % 5 + 1 AS int), 1) END AS alt_aa,
  CASE cast(splice_pct % 4 AS int) WHEN 0 THEN 'NM_1.1(' || gene || '):c.' || cast(dp AS varchar(9)) || ref || '>' || alt WHEN 1 THEN 'NM_1.1(' || gene || '):c.' || cast(dp AS varchar(9)) || translate(ref, 'ACGT', 'TGCA') || '>' || translate(alt, 'ACGT', 'TGCA')
   WHEN 2 THEN 'NM_1.1(ZZ9):c.7A>G' ELSE 'NC_1:g.' || cast(pos + cast(splice_pct % 8 AS int) - 3 AS varchar(9)) || ref || '>' || alt END AS hgvs_name,
  CASE consequence WHEN 'missense' THEN 'Pathogenic' WHEN 'synonymous' THEN 'Likely benign' ELSE 'Uncertain significance' END AS clinical_significance,
  CASE consequence WHEN 'missense' THEN 1 WHEN 'synonymous' THEN CASE WHEN gq > 40 THEN 1 ELSE 0 END ELSE 2 END AS label FROM calls""",
    ),
}


def with_tables(*names: str) -> str:
    """'WITH a AS (...), b AS (...)' with what the names need, each once."""
    order: list[str] = []

    def add(name: str) -> None:
        if name in CTES and name not in order:
            for needed in CTES[name][0]:
                add(needed)
            order.append(name)

    for name in names:
        add(name)
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n][1]})" for n in order)


def bound(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table as a DataFrame."""
    needed: set[str] = set()

    def add(one: str) -> None:
        for x in CTES[one][0]:
            add(x) if x in CTES else needed.add(x)

    add(name)
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in sorted(needed)}
    sql = f"{with_tables(name)} SELECT * FROM {name}"
    for t in frames:
        sql = sql.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t}", f"JOIN {{{t}}}")
    return spark.sql(sql, **frames)
