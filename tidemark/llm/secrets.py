"""Secret scans with an incremental ledger of text blobs.

Every version of a text is addressed by the SHA-256 of its content. The ledger, in a shared folder,
records which (blob, rule version) pairs were scanned and what they held. A scan hashes the versions it
is given, reads each blob with an unseen pair once, applies only the unseen rules, appends to the
ledger, and joins the findings of all blobs back to every version that has them. Findings are written
before the pairs that vouch for them; a scan that dies in between is repeated, and repeated findings
count once.

Everything is DataFrame functions. Matches and the text between them come from two regular-expression
functions; a running sum of their lengths gives code-point offsets. Versions of a hot blob are salted,
and only blobs with findings are copied for the salts.

Null texts count as empty and hold nothing. Null ids keep their row, repeated rows give one result
each. An empty table gives an empty result. Only the id and text columns are read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.components import written
from tidemark.session import scratch

SALTS = 32


@dataclass(frozen=True)
class Rule:
    """A pattern; ``group`` must have ``least`` characters, or the match is dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    version: int = 1

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


#: Fixed: the three base kinds, in order. A run shorter than the least length can hold no longer match,
#: so runs of a class carry their length in the pattern.
BASE = [
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]{12,}"),
    Rule("hex", r"[0-9a-f]{32,}"),
]

RULES = [
    *BASE,
    Rule("private_key", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("stripe", r"[sr]k_live_[A-Za-z0-9]{16,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
]


def matches(blobs: DataFrame, rules: list[Rule]) -> DataFrame:
    """blob, rule, start, end of every match in ``blobs`` (blob, text, todo: names of rules to apply)."""
    text = F.col("text")

    def found(number: int, rule: Rule) -> Column:
        pattern = F.lit(rule.pattern)
        held = F.struct(
            F.lit(rule.name).alias("rule"),
            F.lit(rule.least).alias("least"),
            F.arrays_zip(
                F.split(text, rule.pattern, -1).alias("gap"),
                F.regexp_extract_all(text, pattern, F.lit(0)).alias("hit"),
                F.regexp_extract_all(text, pattern, F.lit(rule.group)).alias("value"),
            ).alias("parts"),
        )
        return F.when(F.array_contains("todo", rule.name) & text.rlike(rule.pattern), held)

    rows = blobs.select("blob", F.explode(F.array_compact(F.array(*[found(i, r) for i, r in enumerate(rules)]))).alias("x"))
    rows = rows.select("blob", "x.rule", "x.least", F.posexplode("x.parts").alias("n", "part"))
    rows = rows.select(
        "blob", "rule", "least", "n",
        F.length("part.gap").alias("gap"), F.length("part.hit").alias("hit"), F.length("part.value").alias("value"),
    )
    before = Window.partitionBy("blob", "rule").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap").cast("long") + F.coalesce("hit", F.lit(0))).over(before)
    rows = rows.withColumn("end", end).filter(F.col("value") >= F.col("least"))
    return rows.select("blob", "rule", (F.col("end") - F.col("hit")).alias("start"), "end")


class Ledger:
    """Scanned (blob, rule version) pairs and their findings under ``path``."""

    def __init__(self, spark, path: str):
        self.spark, self.path = spark, path

    def _read(self, name: str, schema: str) -> DataFrame:
        folder = f"{self.path}/{name}"
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        if hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(hadoop):
            return self.spark.read.schema(schema).parquet(folder)
        return self.spark.createDataFrame([], schema)

    def scanned(self) -> DataFrame:
        return self._read("scanned", "blob binary, rules array<string>")

    def findings(self) -> DataFrame:
        return self._read("findings", "blob binary, rule string, start long, end long")

    def add(self, versions: DataFrame, rules: list[Rule]) -> None:
        """Scan the unseen pairs of ``versions`` (blob, text)."""
        names = [r.name for r in rules]
        seen = self.scanned()
        if not seen.isEmpty():
            seen = seen.select("blob", F.explode("rules").alias("rule")).groupBy("blob").agg(F.collect_set("rule").alias("seen"))
            todo = F.array_except(F.lit(names), F.coalesce("seen", F.array().cast("array<string>")))
            versions = versions.join(seen, "blob", "left").withColumn("todo", todo).drop("seen").filter(F.size("todo") > 0)
        else:
            versions = versions.withColumn("todo", F.lit(names))
        new = versions.dropDuplicates(["blob"])
        matches(new, rules).write.mode("append").parquet(f"{self.path}/findings")
        done = versions.groupBy("blob").agg(F.first("todo").alias("rules"))
        done.write.mode("append").parquet(f"{self.path}/scanned")


def blob_of(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def scan(df: DataFrame, keep: list[str], text: str = "text", ledger: str | None = None, rules: list[Rule] | None = None) -> DataFrame:
    """``keep`` and spans: array of (start, kind, end) sorted by start and order of the rules."""
    rules = RULES if rules is None else rules
    path = ledger or scratch(df.sparkSession, "secret_ledger")
    book = Ledger(df.sparkSession, path)
    book.add(df.select(blob_of(F.col(text)).alias("blob"), F.coalesce(F.col(text), F.lit("")).alias("text")), rules)
    names = F.lit([r.name for r in rules])
    held = book.findings().filter(F.col("rule").isin([r.name for r in rules])).distinct()
    span = F.struct("start", F.array_position(names, F.col("rule")).alias("order"), "end")
    found = held.groupBy("blob").agg(F.array_sort(F.collect_list(span)).alias("found"))
    found = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    versions = df.select(*keep, blob_of(F.col(text)).alias("__blob"), F.pmod(F.xxhash64(*keep), F.lit(SALTS)).cast("int").alias("__salt"))
    same = (versions["__blob"] == found["blob"]) & (versions["__salt"] == found["salt"])
    kinds = F.lit([r.kind for r in rules])
    named = F.transform("found", lambda s: F.struct(s["start"].alias("start"), F.element_at(kinds, s["order"].cast("int")).alias("kind"), s["end"].alias("end")))
    empty = F.array().cast("array<struct<start:bigint,kind:string,end:bigint>>")
    return written(versions.join(found, same, "left").select(*keep, F.coalesce(named, empty).alias("spans")), "secret_spans")


def report(df: DataFrame, **scanning) -> DataFrame:
    """Counts and digest of the base kinds and all spans of each document."""
    base = [r.kind for r in BASE]
    spans = scan(df.select("doc_id", "text"), ["doc_id"], **scanning)

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return spans.select(
        "doc_id",
        *map(count, base),
        F.sha2(joined(F.filter("spans", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


def twin() -> str:
    """The report in DuckDB SQL."""

    def part(number: int, rule: Rule) -> str:
        p = rule.pattern.replace("'", "''")
        return (
            f"SELECT doc_id, n, {number} AS k, '{rule.kind}' AS kind, {rule.least} AS least, string_split_regex(t, '{p}') AS g,"
            f" regexp_extract_all(t, '{p}', 0) AS h, regexp_extract_all(t, '{p}', {rule.group}) AS v FROM texts"
        )

    parts = " UNION ALL ".join(part(i, r) for i, r in enumerate(RULES))
    joined = "string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k)"
    return f"""
    WITH texts AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS n FROM documents),
    parts AS ({parts}),
    numbered AS (SELECT n, k, kind, least, g, h, v, unnest(range(1, len(h) + 1)) AS i FROM parts),
    spans AS (
      SELECT n, k, kind, length(v[i]) AS lv, least,
        list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(h[1:i - 1], lambda x: length(x))), 0) AS s,
        list_sum(list_transform(g[1:i], lambda x: length(x))) + list_sum(list_transform(h[1:i], lambda x: length(x))) AS e
      FROM numbered),
    kept AS (SELECT n, k, kind, s::BIGINT AS s, e::BIGINT AS e FROM spans WHERE lv >= least)
    SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
      count(*) FILTER (kind = 'hex') AS n_hex, sha256(coalesce({joined} FILTER (k < 3), '')) AS base_sha256,
      coalesce({joined}, '') AS spans
    FROM texts LEFT JOIN kept USING (n) GROUP BY doc_id, n
    """
