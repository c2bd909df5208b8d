"""Document fingerprints by SimHash, and all pairs of them within a Hamming radius, by block tables.

A document's terms are its lower-cased words, each together with the next one. A term's weight is
how often it occurs. Each term's 64-bit hash votes with its weight on every bit, for it if the bit
is set and against it if not; the fingerprint has the bits that win.

Two fingerprints within ``RADIUS`` bits agree in at least two of ``RADIUS + 2`` blocks. So there is a
table for each pair of blocks, in which fingerprints with the same bits there share a bucket, and
every pair within the radius meets in one. Large buckets are divided into chunks of bounded size;
each chunk is held against its bucket's chunks within an expression, so pairs are counted but never
made into rows.

Everything is built-in column expressions. Votes are counted four bits to a long, 16 bits each, over
at most ``TERMS`` terms of a document at a time, and unpacked when these counts are added up.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, id_columns

#: Terms whose votes share a count; less than 2 ** 15, as a long has a sign.
TERMS = 32_000
#: Bits of difference, at most, that the block tables find.
RADIUS = 3
#: Fingerprints in a chunk of a bucket, about.
CHUNK = 256
SPACE = r"[\x20\x09-\x0D]+"
_LANES = 0x0001000100010001


def likeness(a: Column, b: Column) -> Column:
    """Of two fingerprints, 0 to 1: the cosine of the angle that their differing bits estimate."""
    angle = F.bit_count(a.bitwiseXOR(b)) * F.lit(3.141592653589793 / 64)
    return F.when(a == b, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.cos(angle)))


def _hex(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def simhash(texts: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` and ``fp`` for (keys, text); ``keys`` are unique. A text without words has 0."""
    trimmed = F.expr(r"btrim(lower(text), ' \t\n\r' || chr(11) || chr(12))")
    rows = texts.select(*keys, F.split(trimmed, SPACE).alias("words"))
    pairs = F.arrays_zip(F.col("words").alias("a"), F.slice("words", 2, F.size("words")).alias("b"))
    rows = rows.select(*keys, F.posexplode(pairs).alias("n", "term"))
    vote = F.when(F.col("term.a") != "", F.xxhash64("term.a", "term.b"))
    rows = rows.select(*keys, F.floor(F.col("n") / TERMS).alias("part"), vote.alias("h"))
    packed = [F.sum(F.shiftrightunsigned("h", i).bitwiseAND(F.lit(_LANES))).alias(f"p{i}") for i in range(16)]
    rows = rows.groupBy(*keys, "part").agg(F.count("h").alias("total"), *packed)
    bits = [F.sum(F.shiftrightunsigned(f"p{i % 16}", i // 16 * 16).bitwiseAND(F.lit(0xFFFF))).alias(f"b{i}") for i in range(64)]
    rows = rows.groupBy(*keys).agg(F.sum("total").alias("total"), *bits)
    fp = F.lit(0).cast("long")
    for i in range(64):
        value = (1 << i) - (1 << 64 if i == 63 else 0)
        fp = fp.bitwiseOR(F.when(2 * F.col(f"b{i}") > F.col("total"), F.lit(value).cast("long")).otherwise(F.lit(0).cast("long")))
    return rows.select(*keys, fp.alias("fp"))


def near_counts(fps: DataFrame, radius: int = RADIUS, chunk: int = CHUNK) -> DataFrame:
    """(fp, near): how many other values of the distinct longs ``fp`` lie within ``radius`` bits, if any."""
    blocks = radius + 2
    edges = [64 * k // blocks for k in range(blocks + 1)]
    masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]

    def signed(x: int) -> Column:
        return F.lit(x - (1 << 64) if x >> 63 else x).cast("long")

    tables = list(combinations(range(blocks), 2))
    entry = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(signed(masks[a] | masks[b])).alias("bits")) for t, (a, b) in enumerate(tables)]))
    entries = fps.select("fp", entry.alias("e")).select("fp", "e.t", "e.bits")
    sizes = entries.groupBy("t", "bits").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    sizes = cut(sizes.select("t", "bits", F.ceil(F.col("n") / chunk).alias("chunks")))
    shared = entries.join(sizes, ["t", "bits"])
    held = shared.groupBy("t", "bits", "chunks", F.pmod(F.xxhash64("fp"), "chunks").alias("chunk")).agg(F.collect_list("fp").alias("others"))
    asked = held.select("t", "bits", F.col("others").alias("fps"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"))

    def meets(one: Column, other: Column) -> Column:
        x = one.bitwiseXOR(other)
        # a pair counts in the table of its first two equal blocks only
        first = F.lit(False)
        for t, (a, b) in enumerate(tables):
            here = F.col("t") == t
            for c in range(b):
                if c != a:
                    here = here & (x.bitwiseAND(signed(masks[c])) != 0)
            first = first | here
        return (x != 0) & (F.bit_count(x) <= radius) & first

    def counted(one: Column) -> Column:
        return F.struct(one.alias("fp"), F.size(F.filter("others", lambda other: meets(one, other))).alias("n"))

    met = asked.join(held.drop("chunks"), ["t", "bits", "chunk"])
    near = met.select(F.explode(F.filter(F.transform("fps", counted), lambda x: x["n"] > 0)).alias("x"))
    return near.groupBy("x.fp").agg(F.sum("x.n").alias("near"))


def _neighbours(keys: DataFrame) -> DataFrame:
    """(key, next): each key's follower in the order of documents, the first one's after the last."""
    order = [F.col("no_id"), F.col("id"), F.col("n_chars"), F.col("code")]
    keys = cut(keys.orderBy(*order)).withColumns({"part": F.spark_partition_id(), "place": F.monotonically_increasing_id()})
    key = F.struct("no_id", "id", "n_chars", "code")
    within = W.partitionBy("part").orderBy("place")
    # a row for each partition
    parts = keys.groupBy("part").agg(F.min_by(key, "place").alias("first"))
    start = F.min_by("first", "part").over(W.partitionBy())
    parts = parts.select("part", F.coalesce(F.lead("first").over(W.orderBy("part")), start).alias("after"))
    rows = keys.select("part", key.alias("key"), F.lead(key).over(within).alias("next")).join(F.broadcast(parts), "part")
    return rows.select("key", F.coalesce("next", "after").alias("next"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text, ...), with the fingerprint of its whole text, and
    that of an edited text: its last half (rounded down) replaced by as much of the next document.

    Columns: doc_id, n_chars (code points), edited_sha256, fingerprint, edited_fingerprint (16 hex
    digits), near_edited, near_next (likeness to the edited text and to the next document's text),
    near_links (other fingerprints in the table within ``RADIUS`` bits). Other columns are ignored.

    The order is by doc_id, null last, then by length and a hash of the text; rows that agree in
    all follow each other. After the last comes the first. A null text counts as empty. An empty
    table gives an empty result.
    """
    text = F.coalesce("text", F.lit(""))
    names = ["no_id", "id", "n_chars", "code"]
    no_id, known_id = id_columns(F.col("doc_id"), docs.schema["doc_id"].dataType)
    keys = [no_id.alias("no_id"), known_id.alias("id"), F.char_length(text).cast("long").alias("n_chars"), F.xxhash64(text).alias("code")]
    # rows that agree meet before the shuffle; the same exchange serves both joins below
    grouped = docs.select(*keys, text.alias("text")).groupBy(*names).agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies")).where("copies > 0")
    follow = cut(_neighbours(docs.select(*keys).distinct()))
    half = F.floor(F.col("key.n_chars") / 2)
    heads = grouped.join(follow.select("next.*", F.col("key.no_id").alias("_no_id"), F.col("key.id").alias("_id"), F.col("key.n_chars").alias("_n_chars"), F.col("key.code").alias("_code"), half.cast("int").alias("half")), names)
    heads = heads.select(*[F.col(f"_{c}").alias(c) for c in names], F.substring("text", F.lit(1), F.col("half")).alias("head"))
    mine = (F.col("n_chars") - F.floor(F.col("n_chars") / 2)).cast("int")
    kept = F.substring("text", F.lit(1), mine)
    variants = F.array(
        F.struct(F.lit(0).alias("v"), F.col("text").alias("text")),
        F.struct(F.lit(1).alias("v"), F.concat(kept, "head").alias("text")),
        # of rows that agree, all but the last are followed by their like
        F.struct(F.lit(2).alias("v"), F.when(F.col("copies") > 1, F.concat(kept, F.substring("text", F.lit(1), (F.col("n_chars") - mine).cast("int")))).alias("text")),
    )
    rows = grouped.join(heads, names).select(*names, "copies", F.explode(variants).alias("x")).where("x.text is not null")
    rows = rows.select(*names, "copies", "x.v", "x.text", F.when(F.col("x.v") > 0, F.sha2("x.text", 256)).alias("sha"))
    rows = cut(simhash(rows, [*names, "copies", "v", "sha"]))
    pick = lambda c, v: F.max(F.when(F.col("v") == v, F.col(c)))
    found = rows.groupBy(*names, "copies").agg(pick("fp", 0).alias("fp"), *[pick(c, v).alias(f"{c}{v}") for v in (1, 2) for c in ("fp", "sha")])
    found = cut(found)
    near = near_counts(found.select("fp").distinct())
    beside = follow.select(F.col("key.*"), F.col("next").alias("next"))
    after = found.select(F.struct(*names).alias("next"), F.col("fp").alias("next_fp"))
    found = found.join(beside, names).join(after, "next").join(near, "fp", "left")
    found = found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    like = F.col("copy") < F.col("copies")
    edited, sha = (F.when(like, F.col(f"{c}2")).otherwise(F.col(f"{c}1")) for c in ("fp", "sha"))
    following = F.when(like, F.col("fp")).otherwise(F.col("next_fp"))
    return found.select(
        F.when(~F.col("no_id"), F.col("id")).cast(docs.schema["doc_id"].dataType).alias("doc_id"),
        "n_chars",
        sha.alias("edited_sha256"),
        _hex(F.col("fp")).alias("fingerprint"),
        _hex(edited).alias("edited_fingerprint"),
        likeness(F.col("fp"), edited).alias("near_edited"),
        likeness(F.col("fp"), following).alias("near_next"),
        F.coalesce("near", F.lit(0)).cast("long").alias("near_links"),
    )
