"""Secret scanning over an incremental ledger of blobs.

A path may have many versions, and many paths share one text. Each distinct text is a blob, addressed by the
SHA-256 of its content. The ledger holds one row for every (blob, rule set version) that was scanned, with
its findings; a run scans only the pairs that the ledger lacks, adds them, and joins findings back to paths.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapeloom.llm.common import folder, table


@dataclass(frozen=True)
class Rule:
    """A match counts if the group is at least `least` characters long; the span is the whole match."""

    kind: str
    pattern: str
    group: int
    least: int
    base: bool


# The three base kinds in their order, then the kinds that this scanner adds.
# [0-9a-f]{24,} and AKIA[A-Z0-9]{16,} find what [0-9a-f]+ of 24 or more and AKIA[A-Z0-9]+ of 20 or more find,
# because a match that is too short is the rest of a maximal run and hides no longer one.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]{16,}", 0, 20, True),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24, True),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1, False),
    # bounded before each dot, so that a run of many beginnings isn't read to its end from each of them
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,300}\.[A-Za-z0-9_-]{10,1000}\.[A-Za-z0-9_-]{10,}", 0, 1, False),
    Rule("forge", r"gh[opsu]_[A-Za-z0-9]{36,}", 0, 1, False),
)
RULE_VERSION = "2024-2"
LEDGER = "blob string, rule_version string, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def scan(blobs: DataFrame, rules: tuple[Rule, ...] = RULES, version: str = RULE_VERSION) -> DataFrame:
    """Findings of (blob, t) rows: one ledger row per blob, also for blobs without a finding.

    Positions come from the pieces between matches: a match starts where the pieces and matches before it end.
    """
    def found(i: int, r: Rule):
        gaps = F.transform(F.split("t", r.pattern, -1), F.length)
        whole = F.transform(F.regexp_extract_all("t", F.lit(r.pattern), F.lit(0)), F.length)
        part = F.transform(F.regexp_extract_all("t", F.lit(r.pattern), F.lit(r.group)), F.length) if r.group else whole
        return F.when(F.col("t").rlike(r.pattern), F.struct(F.lit(i).alias("rule"), F.arrays_zip(gaps.alias("gap"), whole.alias("whole"), part.alias("part")).alias("m")))

    hits = blobs.select("blob", F.explode(F.filter(F.array(*[found(i, r) for i, r in enumerate(rules)]), lambda x: x.isNotNull())).alias("h"))
    each = hits.select("blob", "h.rule", F.posexplode("h.m").alias("at", "m")).select("blob", "rule", "at", F.col("m.gap").alias("gap"), F.col("m.whole").alias("whole"), F.col("m.part").alias("part"))
    so_far = F.sum(F.col("gap") + F.coalesce("whole", F.lit(0))).over(Window.partitionBy("blob", "rule").orderBy("at"))
    least = F.element_at(F.array(*[F.lit(r.least) for r in rules]), F.col("rule") + 1)
    spans = each.withColumn("e", so_far).filter(F.col("whole").isNotNull() & (F.col("part") >= least))
    one = F.struct((F.col("e") - F.col("whole")).alias("s"), F.col("rule"), F.col("e"))
    lists = spans.groupBy("blob").agg(F.sort_array(F.collect_list(one)).alias("all"))  # at most one text's matches
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    base = F.array(*[F.lit(i) for i, r in enumerate(rules) if r.base])
    text = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", F.element_at(kinds, x["rule"] + 1), x["s"], x["e"])), ",")
    number = lambda kind: F.size(F.filter("all", lambda x: F.element_at(kinds, x["rule"] + 1) == kind)).cast("long")
    rows = lists.select("blob", *[number(k).alias(f"n_{k}") for k in ("assign", "access", "hex")], text(F.filter("all", lambda x: F.array_contains(base, x["rule"]))).alias("base"), text(F.col("all")).alias("spans"))
    none = F.lit(0).cast("long")
    return blobs.select("blob").join(rows, "blob", "left").select(
        "blob", F.lit(version).alias("rule_version"), *[F.coalesce(f"n_{k}", none).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"),
    )


def read_ledger(spark, path: str) -> DataFrame:
    try:
        return spark.read.schema(LEDGER).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], LEDGER)


def scan_history(history: DataFrame, ledger: str, path_col: str = "path", version_col: str | None = None, text_col: str = "text", rules: tuple[Rule, ...] = RULES, rule_version: str = RULE_VERSION) -> DataFrame:
    """Scan every version of every path; `ledger` is a folder that all executors share and later runs reuse.

    Returns path, (version,) blob, n_assign, n_access, n_hex, base_sha256, spans: one row per row of `history`,
    repeated rows included. Null text counts as empty and has no finding. Null paths are kept as they are.
    Whole texts are scanned, however long. An empty history gives an empty result; other columns aren't read. Spans
    that start alike come in the order of the rules.
    """
    spark = history.sparkSession
    ids = [F.col(path_col).alias("path"), *([F.col(version_col).alias("version")] if version_col else [])]
    rows = history.select(*ids, F.coalesce(F.col(text_col), F.lit("")).alias("t")).withColumn("blob", F.sha2("t", 256))
    known = read_ledger(spark, ledger).filter(F.col("rule_version") == rule_version).select("blob")
    # one path stands for each unseen blob, so that a text is shuffled and scanned once however many copies it has
    stands = rows.groupBy("blob").agg(F.min(F.xxhash64(*[x for x in rows.columns if x not in ("t", "blob")])).alias("who")).join(known, "blob", "left_anti")
    unseen = rows.withColumn("who", F.xxhash64(*[x for x in rows.columns if x not in ("t", "blob")])).select("blob", "who", "t").join(stands, ["blob", "who"])
    unseen = unseen.dropDuplicates(["blob", "who"])  # rows that repeat path, version and text; dealt by the join already
    scan(unseen.select("blob", "t"), rules, rule_version).write.mode("append").parquet(ledger)
    findings = read_ledger(spark, ledger).filter(F.col("rule_version") == rule_version).drop("rule_version").dropDuplicates(["blob"])
    return rows.drop("t").join(findings, "blob")


def op2(spark, sf_dir):
    """Secrets of all documents: each is a path with one version; the ledger starts empty."""
    found = scan_history(table(spark, sf_dir, "documents"), folder(spark, "ledger"), path_col="doc_id")
    return found.select(F.col("path").alias("doc_id"), "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def _sql_kind(order: int, r: Rule) -> str:
    pattern = r.pattern.replace("(?i:password|passwd|secret|token|api_?key)", "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in "password|passwd|secret|token|api_?key")).replace("'", "''")
    return f"""SELECT doc_id, {order} AS rule, '{r.kind}' AS kind, i, length(x[i]) AS w, length(p[i]) AS g,
  list_sum(list_transform(gaps[1:i], lambda s: length(s))) + coalesce(list_sum(list_transform(x[1:i - 1], lambda s: length(s))), 0) AS s
FROM (SELECT doc_id, unnest(generate_series(1, len(x))) AS i, x, p, gaps FROM (
  SELECT doc_id, regexp_extract_all(t, '{pattern}') AS x, regexp_extract_all(t, '{pattern}', {r.group}) AS p, string_split_regex(t, '{pattern}') AS gaps FROM d)) WHERE length(p[i]) >= {r.least}"""


OP2_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS ({" UNION ALL ".join(_sql_kind(i, r) for i, r in enumerate(RULES))}),
g AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg(kind || ':' || s::BIGINT || ':' || (s + w)::BIGINT, ',' ORDER BY s, rule) FILTER (rule < 3) AS base,
  string_agg(kind || ':' || s::BIGINT || ':' || (s + w)::BIGINT, ',' ORDER BY s, rule) AS spans FROM m GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (doc_id)
"""
