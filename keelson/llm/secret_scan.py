"""Secret scans over an incremental blob ledger.

Every version of every text is content-addressed by the SHA-256 of its bytes. A ledger, a Parquet folder that only
grows, says which blob was scanned under which rule version and what was found. A scan looks at the blobs that have no
entry under the current rule version yet, each distinct blob once however many paths hold it, appends an entry for
each, and joins the entries back to all paths. Blobs are told apart, and one row chosen for each, by hash alone; only
the chosen texts are dealt out, and scanned by column expressions, without Python workers.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.llm.common import let, shared_folder, whole_text, written
from keelson.llm.spans import placed_matches

BASE_KINDS = ("assign", "access", "hex")
LEDGER_SCHEMA = "blob string, rule_version string, n_assign bigint, n_access bigint, n_hex bigint, base string, spans string"

#: The base patterns of the contract. Quantifiers are possessive where the next part can't start with what
#: they take, and what may match anywhere in a run starts at the run's first character, so that long runs stay linear.
ASSIGN = r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?+\x20*+[:=]\x20*+["']?+([A-Za-z0-9+/_.=-]++)"""
#: Kind: pattern; what a text must hold to be searched; whether a match passes. The base kinds, then what this version adds.
RULES: dict[str, tuple[str, str, Callable[[Column], Column] | None]] = {}


def _rule(kind: str, pattern: str, mark: str, passes=None) -> None:
    RULES[kind] = (pattern, mark, passes)


_rule("assign", ASSIGN, "(?i)passw|secret|token|api", lambda v: F.length(F.regexp_extract(v, ASSIGN, 2)) >= 8)
_rule("access", r"AKIA[A-Z0-9]++", "AKIA", lambda v: F.length(v) >= 16)
_rule("hex", r"(?<![0-9a-f])[0-9a-f]{32,}+", "")
_rule("pem", r"-----BEGIN (?:[A-Z]++ )??PRIVATE KEY-----[A-Za-z0-9+/=\x20\x09-\x0D]{32,}+-----END (?:[A-Z]++ )??PRIVATE KEY-----", "PRIVATE KEY-----")
_rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{10,}+\.eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+", "eyJ")
_rule("github", r"(?<![A-Za-z0-9_])gh[pousr]_[A-Za-z0-9]{36,}+(?!_)", "gh[pousr]_")
_rule("slack", r"(?<![A-Za-z0-9_])xox[abprs]-[A-Za-z0-9-]{10,}+", "xox[abprs]-")
_rule("url_login", r"(?<![A-Za-z0-9+.-])[a-z][a-z0-9+.-]{1,20}+://[^\x20\x09-\x0D/:@]{1,64}+:[^\x20\x09-\x0D/:@]{4,64}+@[A-Za-z0-9.-]++", "://")

#: Other patterns are another version by themselves; the number stands for the code around them.
RULE_VERSION = "3-" + hashlib.sha256(repr([(k, p, m) for k, (p, m, _) in RULES.items()]).encode()).hexdigest()[:12]

def _matches(whole: Column, kind: str, rank: int) -> Column:
    """The rule's matches m, what lies between them (g, where there are any) and which of them pass."""
    pattern, mark, passes = RULES[kind]
    none = F.array().cast("array<string>")

    def row(m: Column) -> Column:
        between = F.when(F.size(m) > 0, F.split(whole, pattern, -1)).otherwise(none)
        good = F.transform(m, passes or (lambda _: F.lit(True)))
        return F.struct(m.alias("m"), between.alias("g"), good.alias("good"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"))

    every = F.regexp_extract_all(whole, F.lit(pattern), F.lit(0))
    return let(F.when(whole.rlike(mark), every).otherwise(none) if mark else every, row)


def find_spans(whole: Column) -> Column:
    """(start, rank, end, kind) in code points by start, then kind as listed; whole is not null."""

    def spans(r: Column) -> Column:
        span = lambda v, start: F.struct(start.alias("start"), r["rank"].alias("rank"), (start + F.length(v)).alias("end"), r["kind"].alias("kind"))
        placed = let(placed_matches(r["m"], r["g"], span), lambda x: F.filter(x, lambda _, i: F.get(r["good"], i)))
        return F.when(F.size(r["m"]) > 0, placed).otherwise(F.array().cast("array<struct<start:bigint,rank:int,end:bigint,kind:string>>"))

    return F.array_sort(F.flatten(F.transform(F.array(*[_matches(whole, kind, n) for n, kind in enumerate(RULES)]), spans)))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat(x["kind"], F.lit(":"), x["start"].cast("string"), F.lit(":"), x["end"].cast("string"))), ",")


def read_ledger(spark: SparkSession, ledger: str) -> DataFrame:
    """All entries; an absent ledger is an empty one."""
    try:
        return spark.read.schema(LEDGER_SCHEMA).parquet(ledger)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], LEDGER_SCHEMA)


def new_ledger(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/blob-ledger-{uuid.uuid4().hex}"


def ledger_of(spark: SparkSession, table: str) -> str:
    """The ledger of the table at a path; it stays in the shared folder from run to run."""
    return f"{shared_folder(spark)}/blob-ledger/{hashlib.sha256(table.encode()).hexdigest()[:32]}"


def scan_blobs(blobs: DataFrame, rule_version: str = RULE_VERSION) -> DataFrame:
    """(blob, text) to ledger entries."""
    spans = blobs.select("blob", find_spans(F.col("text")).alias("spans"))
    base = F.filter("spans", lambda x: x["rank"] < len(BASE_KINDS))

    def is_of(n: int):
        return lambda x: x["rank"] == n

    counts = [F.size(F.filter("spans", is_of(n))).cast("long").alias(f"n_{kind}") for n, kind in enumerate(BASE_KINDS)]
    return spans.select("blob", F.lit(rule_version).alias("rule_version"), *counts, joined(base).alias("base"), joined(F.col("spans")).alias("spans"))


def scan(docs: DataFrame, ledger: str, key: str = "doc_id", text: str = "text", rule_version: str = RULE_VERSION) -> DataFrame:
    """Brings the ledger up to date with the texts and returns (key, blob, n_assign, n_access, n_hex, base, spans).

    One row for each row of the table: repeated rows, null keys and rows that share a blob all keep theirs. A null text
    is the empty text, which holds nothing. Other columns are not read, whatever they are called. An empty table adds no
    entry. A very long text takes one task a time linear in its length and a few times its size in memory. A run that is
    broken off leaves no partial entry that counts: entries of one blob and rule version are equal, whoever wrote them.
    """
    spark = docs.sparkSession
    place = F.coalesce(F.concat(F.lit("k"), F.col(key).cast("string")), F.lit("")).alias("place")
    whole = whole_text(text)
    addressed = docs.select(F.col(key).alias("key"), place, F.sha2(whole.cast("binary"), 256).alias("blob"), whole.alias("text"))
    paths = written(addressed.drop("text"), "ledger-paths")
    seen = read_ledger(spark, ledger).where(F.col("rule_version") == rule_version).select("blob")
    unseen = written(paths.groupBy("blob").agg(F.min("place").alias("place")).join(seen, "blob", "left_anti"), "ledger-unseen")
    # A row that is there several times is one blob.
    fresh = addressed.drop("key").join(unseen, ["place", "blob"]).dropDuplicates(["place", "blob"])
    scan_blobs(fresh, rule_version).write.mode("append").parquet(ledger)
    entries = read_ledger(spark, ledger).where((F.col("rule_version") == rule_version) & (F.col("spans") != "")).dropDuplicates(["blob"]).drop("rule_version")
    held = paths.select("key", "blob").join(written(entries, "ledger-found", (unseen,)), "blob", "left")
    filled = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_assign", "n_access", "n_hex")] + [F.coalesce(c, F.lit("")).alias(c) for c in ("base", "spans")]
    return held.select(F.col("key").alias(key), "blob", *filled)
