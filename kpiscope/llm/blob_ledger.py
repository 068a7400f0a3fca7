"""Secret scans over an incremental blob ledger.  Built-in functions only.

Every historical version of every path is addressed by its content (SHA-256 of the UTF-8
text). The ledger holds, for each blob, the rule versions it was scanned with and what they
found. A scan takes the distinct blobs of the given versions, scans only the (blob, rule
version) pairs that the ledger lacks, appends them, and joins the findings of the present rule
versions back to all paths. Copies are scanned once, and a changed rule scans itself only.

Spans count code points, end exclusive. Null texts count as empty: an empty blob without
findings. Repeated versions share a blob and each get its findings. An empty table adds
nothing and gives no rows. Columns other than the text and those kept are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kpiscope.llm.common import new_path, require_columns

#: Matches whose places are summed at a time.
RUN = 64
#: The paths of one blob are joined to its findings in so many parts.
SALTS = 8
LEDGER = "blob binary, rules array<string>, found array<struct<kind:string,start:int,end:int>>"


@dataclass(frozen=True)
class Rule:
    """``pattern`` finds leftmost non-overlapping matches (Java syntax); those whose ``group``
    is shorter than ``at_least`` are dropped. ``needs``: a literal each match holds."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    at_least: int = 0
    needs: str = ""

    @property
    def id(self) -> str:
        return f"{self.kind}@{self.version}"


BASE_RULES = (
    Rule("assign", 1, r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 20, "AKIA"),
    # Runs of 24 and more are the maximal runs of [0-9a-f]+ that are long enough.
    Rule("hex", 1, r"[0-9a-f]{24,}", 0, 24),
)
MORE_RULES = (
    Rule("pem", 1, r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----", 0, 0, "PRIVATE KEY-----"),
    Rule("forge", 1, r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 0, "gh"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 0, "eyJ"),
)
RULES = BASE_RULES + MORE_RULES


def rule_spans(text: Column, rule: Rule) -> Column:
    """array<struct<kind,start,end>>: the text is split at the matches; the lengths of the
    pieces between and of the matches add up to the places."""
    pattern = F.lit(rule.pattern)
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    tested = whole if rule.group == 0 else F.regexp_extract_all(text, pattern, F.lit(rule.group))
    lens = F.zip_with(
        F.zip_with(F.slice(F.split(text, rule.pattern, -1), F.lit(1), F.size(whole)), whole, lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("len"))),
        tested,
        lambda p, t: F.struct(p["gap"].alias("gap"), p["len"].alias("len"), (F.length(t) >= rule.at_least).alias("ok")),
    )
    none = F.array().cast("array<struct<start:int,end:int,ok:boolean>>")
    # Growing an array by one copies it, so places are summed in runs of RUN matches: the runs'
    # own starts first, then the places within each.
    runs = F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.size(lens) - 1) / RUN), F.lit(0)).cast("int")), lambda i: F.slice(lens, i * RUN + 1, F.lit(RUN)))
    starts = F.aggregate(
        runs,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")),
        lambda acc, run: F.struct(
            (acc["at"] + F.aggregate(run, F.lit(0), lambda n, x: n + x["gap"] + x["len"])).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")
        ),
        lambda acc: acc["out"],
    )

    def places(run: Column, start: Column) -> Column:
        return F.aggregate(
            run,
            F.struct(start.alias("at"), none.alias("out")),
            lambda acc, x: F.struct(
                (acc["at"] + x["gap"] + x["len"]).alias("at"),
                F.concat(acc["out"], F.array(F.struct((acc["at"] + x["gap"]).alias("start"), (acc["at"] + x["gap"] + x["len"]).alias("end"), x["ok"].alias("ok")))).alias("out"),
            ),
            lambda acc: acc["out"],
        )

    placed = F.flatten(F.zip_with(runs, starts, places))
    spans = F.transform(F.filter(placed, lambda s: s["ok"]), lambda s: F.struct(F.lit(rule.kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    empty = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    may = F.contains(text, F.lit(rule.needs)) if rule.needs else text.rlike(rule.pattern)
    return F.when(may, spans).otherwise(empty)


def scan_unseen(versions: DataFrame, ledger: DataFrame | None, rules: Sequence[Rule] = RULES, text: str = "text") -> DataFrame:
    """New ledger rows: the distinct blobs of ``versions`` with the rule versions that
    ``ledger`` lacks for them, and what these find. Blobs that lack none give no row."""
    require_columns(versions, [text])
    raw = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    # Equal blobs meet within a partition first, so copies are not shuffled a second time.
    blobs = versions.select(F.unhex(F.sha2(raw, 256)).alias("blob"), raw.alias("raw")).dropDuplicates(["blob"])
    ids = F.array(*[F.lit(r.id) for r in rules])
    if ledger is None:
        blobs = blobs.withColumn("todo", ids)
    else:
        seen = ledger.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("seen"))
        blobs = blobs.join(seen, "blob", "left")
        blobs = blobs.withColumn("todo", F.array_except(ids, F.coalesce("seen", F.array().cast("array<string>")))).where(F.size("todo") > 0)
    empty = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    found = F.concat(*[F.when(F.array_contains("todo", r.id), rule_spans(F.col("raw"), r)).otherwise(empty) for r in rules])
    return blobs.select("blob", F.col("todo").alias("rules"), found.alias("found"))


def update_ledger(versions: DataFrame, path: str | None = None, rules: Sequence[Rule] = RULES, text: str = "text") -> str:
    """Scan what the ledger at ``path`` lacks and append it; returns the path.

    A run that dies leaves no half-written rows (the write commits at its end), and scanning
    again finds the same pairs unseen.
    """
    spark = versions.sparkSession
    old = None
    if path is None:
        path = new_path(spark, "ledger")
    else:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            old = read_ledger(spark, path)
    scan_unseen(versions, old, rules, text).write.mode("append").parquet(path)
    return path


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LEDGER).parquet(path)


def findings(versions: DataFrame, ledger: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """All versions with ``spans``, the findings of the present rule versions in their blob.

    Only blobs with findings are joined back. The paths of one blob may be a third of all; they
    are dealt into SALTS parts, each with its own row of the blob's findings.
    """
    require_columns(versions, [text, *keep])
    ids = F.array(*[F.lit(r.id) for r in rules])
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    # Each (blob, rule version) is in the ledger once, except after two runs at a time.
    rows = ledger.where((F.size("found") > 0) & F.arrays_overlap("rules", ids))
    rows = rows.withColumn("found", F.filter("found", lambda s: F.array_contains(kinds, s["kind"]) & F.exists("rules", lambda r: F.array_contains(ids, r) & (F.split_part(r, F.lit("@"), F.lit(1)) == s["kind"]))))
    hits = rows.where(F.size("found") > 0).groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("found"))).alias("found"))
    raw = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    kept = [F.col(f"`{c}`") for c in keep]
    salt = F.pmod(F.xxhash64(*kept) if kept else F.lit(0), F.lit(SALTS)).cast("int")
    slim = versions.select(*[c.alias(f"k{i}") for i, c in enumerate(kept)], F.unhex(F.sha2(raw, 256)).alias("blob"), salt.alias("salt"))
    hits = hits.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    spans = F.coalesce("found", F.array().cast("array<struct<kind:string,start:int,end:int>>"))
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.array_position(kinds, s["kind"]).alias("no"), s["end"].alias("end"), s["kind"].alias("kind")))
    joined = slim.join(hits, ["blob", "salt"], "left")
    return joined.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "blob", F.array_sort(keyed).alias("spans"))


def span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
