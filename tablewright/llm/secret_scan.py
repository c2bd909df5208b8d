"""Secrets in texts, by an incremental ledger of blobs.

Every version of every path is addressed by its content: the SHA-256 of the text names the blob. A
ledger, a Parquet table, has a row for each pair of a blob and a version of a rule that has been
scanned, with the spans found, also if there are none. A scan hashes all texts where they are, and asks
the ledger with the hashes alone. Only the texts of blobs for which it lacks a current rule are moved
and scanned, each once however many paths hold it, and for the rules it lacks; what is found is
appended. Of the ledger, what belongs to the current blobs is joined back to all paths.

Matching uses built-in expressions. The places of matches follow from the lengths of the matches
and of what is between them, summed in a window over the blob's matches.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpoint_folder, cut, removed, small_join


@dataclass(frozen=True)
class Rule:
    """Leftmost matches of ``pattern`` that don't overlap; those whose ``group`` has fewer than
    ``least`` characters are dropped. A text without any of ``words`` (in lower case) can't match."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    words: tuple[str, ...] = ()

    @property
    def version(self) -> str:
        return hashlib.sha256(repr((self.pattern, self.group, self.least)).encode()).hexdigest()[:16]


# fixed values: the base patterns; where a short match can't hide a longer one, the length is in the pattern
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, ("password", "passwd", "secret", "token", "apikey", "api_key")),
    Rule("access", r"AKIA[A-Z0-9]{14,}", words=("akia",)),
    Rule("hex", r"[0-9a-f]{16,}"),
)
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", words=("-----begin ",)),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", words=("eyj",)),
)
RULES = BASE + MORE

LEDGER = "blob string, kind string, version string, spans array<struct<start:long,end:long>>"


def blob_of(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def _ledger(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(LEDGER).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LEDGER)


def _lengths(rule: Rule, wanted: Column) -> Column:
    """Of each match in order: the characters before it since the last match, its own, its group's."""
    text, pattern = F.col("text"), F.lit(rule.pattern)
    low = F.col("low")
    may = wanted
    if rule.words:
        has = low.contains(rule.words[0])
        for word in rule.words[1:]:
            has = has | low.contains(word)
        may = may & has
    may = may & text.rlike(rule.pattern)
    between = F.transform(F.split(text, rule.pattern, -1), F.char_length)
    whole = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), F.char_length)
    group = F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), F.char_length) if rule.group else whole
    found = F.arrays_zip(F.slice(between, 1, F.size(whole)).alias("gap"), whole.alias("size"), group.alias("held"))
    return F.when(may, found.cast("array<struct<gap:int,size:int,held:int>>"))


def _scan(texts: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Ledger rows for (blob, text, lacks): the rules in ``lacks``, as kind:version."""
    wanted = [(r, F.array_contains("lacks", f"{r.kind}:{r.version}")) for r in rules]
    rows = texts.withColumn("low", F.lower("text"))
    found = F.array(*[F.struct(w.alias("wanted"), F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), F.lit(r.least).alias("least"), _lengths(r, w).alias("found")) for r, w in wanted])
    rows = rows.select("blob", F.explode(found).alias("x")).where("x.wanted").select("blob", "x.kind", "x.version", "x.least", F.posexplode_outer("x.found").alias("n", "m"))
    upto = W.partitionBy("blob", "kind").orderBy("n")
    rows = rows.withColumn("end", F.sum(F.col("m.gap") + F.col("m.size")).over(upto).cast("long"))
    span = F.when(F.col("m.held") >= F.col("least"), F.struct((F.col("end") - F.col("m.size")).alias("start"), "end"))
    return rows.groupBy("blob", "kind", "version").agg(F.array_sort(F.collect_list(span)).alias("spans"))


def scan(versions: DataFrame, ledger: str, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Bring the ledger at path ``ledger`` up to date for ``versions`` (text, ...), and return what it has for
    them: (blob, findings), findings being structs (start, place of the rule in ``rules``, kind, end).
    """
    spark = versions.sparkSession
    names = [f"{r.kind}:{r.version}" for r in rules]
    current = F.concat_ws(":", "kind", "version").isin(names)
    plain = [f"`{f.name}`" for f in versions.schema if f.name != "text" and isinstance(f.dataType, T.NumericType | T.StringType)]
    row = F.xxhash64(*plain) if plain else F.lit(0)
    blobs = versions.select(blob_of(F.col("text")).alias("blob"), F.coalesce("text", F.lit("")).alias("text"), row.alias("row"))
    past = _ledger(spark, ledger).where(current)
    if first := past.isEmpty():
        unseen = blobs.withColumn("lacks", F.array(*[F.lit(n) for n in names]))
    else:
        # hashes only, a row for each blob
        now = cut(blobs.select("blob").distinct())
        known = past.join(now, "blob", "left_semi").groupBy("blob").agg(F.collect_set(F.concat_ws(":", "kind", "version")).alias("has"))
        every = F.array(*[F.lit(n) for n in names])
        lacking = now.join(known, "blob", "left").withColumn("lacks", F.array_except(every, F.coalesce("has", F.array().cast("array<string>"))))
        lacking = cut(lacking.where(F.size("lacks") > 0).select("blob", "lacks"))
        unseen = small_join(blobs, lacking, "blob", ["row"])
    # copies meet before the shuffle
    texts = unseen.groupBy("blob").agg(F.first("text").alias("text"), F.first("lacks").alias("lacks"))
    _scan(texts.select("blob", "text", "lacks"), rules).write.mode("append").parquet(ledger)
    rank = F.array_position(F.array(*[F.lit(r.kind) for r in rules]), F.col("kind")).cast("int")
    spans = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), rank.alias("rank"), F.col("kind").alias("kind"), s["end"].alias("end")))
    rows = _ledger(spark, ledger).where(current)
    if not first:
        rows = rows.join(now, "blob", "left_semi")
    return rows.dropDuplicates(["blob", "kind"]).groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list(spans))).alias("findings"))


def _is(kind: str):
    return lambda f: f["kind"] == kind


def _told(findings: Column) -> Column:
    return F.array_join(F.transform(findings, lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))), ",")


def find_secrets(docs: DataFrame, ledger: str | None = None, rules: Sequence[Rule] = MORE) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text, ...), each a version of the path doc_id.

    Columns: doc_id, n_assign, n_access, n_hex (the base rules' spans), base_sha256 (of those as
    kind:start:end, by start and then kind, joined by commas), spans (all rules' spans, joined
    likewise). Places count code points; ends are exclusive. ``rules`` come after the base rules.
    ``ledger`` is the path of a ledger that is kept; without it, one is made in the checkpoint
    folder for this call. Other columns of ``docs`` are ignored.

    A null text counts as empty. Repeated rows and rows without doc_id stay. An empty table gives
    an empty result.
    """
    spark = docs.sparkSession
    rules = (*BASE, *rules)
    kept = ledger is not None
    ledger = ledger or f"{checkpoint_folder(spark)}/ledger-{uuid.uuid4()}"
    found = scan(docs, ledger, rules)
    base = F.filter("findings", lambda f: f["rank"] <= len(BASE))
    counts = [F.size(F.filter("findings", _is(r.kind))).cast("long").alias(f"n_{r.kind}") for r in BASE]
    digests = cut(found.select("blob", *counts, F.sha2(_told(base), 256).alias("base_sha256"), _told(F.col("findings")).alias("spans")))
    if not kept:
        removed(spark, ledger)
    # both sides are plain tables, so that a blob of very many paths can be split
    paths = docs.select("doc_id", blob_of(F.col("text")).alias("blob"))
    return paths.join(digests, "blob").select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")
