"""WARC archives: writing, and reading them back by boundary-chain verification.

Writing.  Every page becomes one record.  Of pages with equal payloads of at least ``least`` bytes the
one with the largest id is a response and the others are revisits that refer to it (pages that share
that largest id are all responses); shorter payloads are all responses.  Records are complete WARC/1.1
records with an HTTP block, written by Spark's own committers, so lost executors leave no broken file.

Reading.  The archives are scanned in splits, cut at the record magic.  Each magic found is a
candidate: a task emits its offset and the successor offset that its Content-Length declares.  A magic
inside a payload gives a candidate too.  Consecutive candidates that declare each other form runs; runs
are linked by their last member's successor, and pointer jumping over the runs from each file's first
byte doubles its reach every round.  Only candidates on that chain are records; the rest are payload.
A record whose payload holds magics is put together again from its pieces.  Pieces are named by their byte offsets, never by
what a scan's splits happen to be.  A file whose chain does not end at its last byte raises an error, so no record is lost unseen.

Defined results: null html -> empty payload; null ids -> the record refers to null ids alike; null url
-> an empty target; URLs are written percent-encoded where they hold characters that are not printable ASCII, or the magic;
an empty table gives an archive without records; equal pages give a record each; columns besides page_id, url and html
are not read; a page may be as long as a string of Spark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut

MAGIC = "WARC/1."
END = "\r\n\r\n"
#: Digits of base 32 with extension order -> RFC 4648 order.
_BASE32 = ("0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def sha1_base32(data: Column) -> Column:
    hexed = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(hexed, 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*parts), *_BASE32)


def _uri(url: Column) -> Column:
    """``url`` in printable ASCII and without the magic."""
    escaped = F.transform(F.split(url, ""), lambda c: F.when(c.rlike(r"[^\x21-\x7E]"), F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)", "%$1")).otherwise(c))
    plain = F.when(url.rlike(r"[^\x21-\x7E]"), F.array_join(escaped, "")).otherwise(url)
    return F.replace(plain, F.lit(MAGIC), F.lit(MAGIC.replace("W", "%57")))


def records(pages: DataFrame, least: int = 0) -> DataFrame:
    """(page_id, record_type, refers_to, value): ``value`` is the record without its closing line ends."""
    p = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    p = p.withColumn("digest", sha1_base32(F.col("html"))).withColumn("n", F.octet_length("html"))
    keep = p.select("page_id", "digest", "n").filter(F.col("n") >= least).groupBy("digest", "n").agg(F.max("page_id").alias("keeper"))
    keep = keep.withColumnsRenamed({"digest": "k_digest", "n": "k_n"})
    p = p.join(keep, (p.digest == keep.k_digest) & (p.n == keep.k_n), "left")
    p = p.withColumn("revisit", (F.col("n") >= least) & ~F.col("page_id").eqNullSafe(F.col("keeper")))
    name = lambda c: F.concat(F.lit("<urn:seqloom:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit(END))
    p = p.withColumn("block", F.when(F.col("revisit"), http).otherwise(F.concat(http, F.col("html"))))
    head = F.concat(
        F.lit(f"{MAGIC}1\r\nWARC-Type: "), F.when(F.col("revisit"), "revisit").otherwise("response"), F.lit("\r\nWARC-Record-ID: "), name("page_id"),
        F.when(F.col("revisit"), F.concat(F.lit("\r\nWARC-Refers-To: "), name("keeper"), F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))).otherwise(F.lit("")),
        F.lit("\r\nWARC-Target-URI: "), _uri(F.col("url")), F.lit("\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nWARC-Payload-Digest: sha1:"), F.col("digest"),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length("block").cast("string"), F.lit(END))
    return p.select("page_id", F.when(F.col("revisit"), "revisit").otherwise("response").alias("record_type"),
                    F.when(F.col("revisit"), F.col("keeper")).alias("refers_to"), F.concat(head, F.col("block")).alias("value"))


def write_warc(pages: DataFrame, path: str, least: int = 0, compression: str = "gzip", per_file: int = 50_000) -> None:
    """Archives under ``path`` of at most ``per_file`` records each; with compression "none" readers can split the files."""
    records(pages, least).select("value").write.option("lineSep", END).option("maxRecordsPerFile", per_file).option("compression", compression).mode("overwrite").text(path)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, pos, value): the text between magics, in file order within a block."""
    scan = spark.read.option("lineSep", MAGIC).text(path)
    return scan.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("pos"), "value")


def _offsets(pieces: DataFrame) -> DataFrame:
    """Adds off, the byte offset of the magic before the piece (negative for what precedes the first magic)."""
    d = pieces.withColumn("_len", F.col("_bytes") + len(MAGIC))
    own = Window.partitionBy("file", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = d.groupBy("file", "block").agg(F.sum("_len").alias("_all"))
    base = base.select("file", "block", F.coalesce(F.sum("_all").over(before), F.lit(0)).alias("_base"))
    d = d.withColumn("_rel", F.coalesce(F.sum("_len").over(own), F.lit(0)))
    return d.join(base, ["file", "block"]).withColumn("off", F.col("_base") + F.col("_rel") - len(MAGIC)).drop("_len", "_rel", "_base")


def _field(head: Column, name: str) -> Column:
    return F.regexp_extract(head, rf"(?imd)^{name}:[ \t]*([^\r\n]*)", 1)


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """(file, off, succ, whole, ...): every magic that heads a well-formed record, with the fields of its
    record where all of it lies before the next magic (``whole``).  Written once; narrow but for
    the pieces of payloads that hold magics."""
    p = _pieces(spark, path)
    p = p.withColumn("_bytes", F.octet_length("value").cast("long")).withColumn("_head", F.substring_index("value", END, 1))
    p = p.withColumn("_start", (F.octet_length("_head") + len(END)).cast("long"))
    ok = F.col("value").rlike(r"^[01]\r\n") & (F.instr("value", END) > 0)
    length = F.when(ok, F.expr("try_cast(" + "regexp_extract(_head, '(?imd)^Content-Length:[ \\t]*([0-9]+)', 1)" + " AS bigint)"))
    p = p.withColumn("_length", length)
    p = p.withColumn("size", len(MAGIC) + F.col("_start") + F.col("_length") + len(END))
    p = p.withColumn("whole", F.coalesce(F.col("size") <= F.col("_bytes") + len(MAGIC), F.lit(False)))
    block = F.expr("substring(cast(value as binary), cast(_start + 1 as int), cast(_length as int))")
    p = p.withColumn("_block", F.when(F.col("whole"), block))
    fields = _fields(F.col("_head"), F.col("_block"))
    p = cut(p.select("file", "block", "pos", "_bytes", "size", "whole", *[v.alias(k) for k, v in fields.items()]), "warc-scan")  # one scan gives places and sizes
    return cut(_offsets(p).withColumn("succ", F.col("off") + F.col("size")), "warc")


def _fields(head: Column, block: Column) -> dict[str, Column]:
    text = block.cast("string")
    http = F.substring_index(text, END, 1)
    payload = lambda b: F.call_function("substring", b, (F.octet_length(http) + len(END) + 1).cast("int"))
    kind = _field(head, "WARC-Type")
    number = lambda name: F.regexp_extract(_field(head, name), r"<urn:seqloom:page:(-?\d+)>", 1).try_cast("long")
    return {
        "record_type": kind, "page_id": number("WARC-Record-ID"), "refers_to": number("WARC-Refers-To"), "url": _field(head, "WARC-Target-URI"),
        "declared_digest": F.regexp_replace(_field(head, "WARC-Payload-Digest"), "^sha1:", ""),
        "payload_digest": F.when(kind == "revisit", F.regexp_replace(_field(head, "WARC-Payload-Digest"), "^sha1:", "")).otherwise(sha1_base32(payload(block))),
        "payload_bytes": F.when(kind == "revisit", F.regexp_extract(http, r"(?imd)^Content-Length:[ \t]*([0-9]+)", 1).try_cast("long")).otherwise(F.octet_length(payload(block)).cast("long")),
    }


def chain(found: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(file, off) of the candidates that the chain from each file's first byte reaches."""
    nodes = found.filter(F.col("succ").isNotNull() & (F.col("off") >= 0)).select("file", "block", "off", "succ")
    w = Window.partitionBy("file", "block").orderBy("off")
    nodes = nodes.withColumn("_new", F.coalesce(F.lag("succ").over(w) != F.col("off"), F.lit(True)))
    nodes = nodes.withColumn("run", F.last(F.when(F.col("_new"), F.col("off")), ignorenulls=True).over(w)).select("file", "off", "succ", "run")
    ends = nodes.groupBy("file", "run").agg(F.max_by("succ", "off").alias("exit"))
    at = nodes.select("file", F.col("off").alias("exit"), F.col("run").alias("next"))
    jump = cut(ends.join(at, ["file", "exit"]).select("file", "run", "next", F.col("exit").alias("entry")), "warc-runs")
    step = jump.select("file", "run", "next")
    reached = nodes.filter("off = 0").select("file", "run").distinct()
    for _ in range(max_rounds):
        more = reached.join(step, ["file", "run"]).select("file", F.col("next").alias("run"))
        bigger = cut(reached.union(more).distinct(), "warc-reached")
        step = cut(step.alias("a").join(step.alias("b"), (F.col("a.file") == F.col("b.file")) & (F.col("a.next") == F.col("b.run")))
                   .select("a.file", "a.run", F.col("b.next").alias("next")), "warc-jump")
        reached = bigger
        if step.isEmpty():
            break
    entry = (reached.join(jump, ["file", "run"]).select("file", F.col("next").alias("run"), "entry")
             .union(nodes.filter("off = 0").select("file", "run", F.col("off").alias("entry"))))
    entry = entry.groupBy("file", "run").agg(F.min("entry").alias("entry"))
    return nodes.join(entry, ["file", "run"]).filter(F.col("off") >= F.col("entry")).select("file", "off")


def _ends(found: DataFrame) -> DataFrame:
    """(file, end): the bytes of each file."""
    return found.groupBy("file").agg(F.max(F.col("off") + len(MAGIC) + F.col("_bytes")).alias("end"))


def _check_ends(found: DataFrame, kept: DataFrame) -> None:
    """Raise an error if a file's chain ends before or behind the file's end."""
    last = kept.groupBy("file").agg(F.max("succ").alias("last"))
    bad = _ends(found).join(last, "file", "left").filter((F.col("end") > 0) & ~F.col("end").eqNullSafe(F.col("last"))).orderBy("file").first()
    if bad:
        raise ValueError(f"{bad.file}: no record begins at byte {bad['last'] or 0} of {bad.end}")


def read_warc(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """(file, off, record_type, page_id, refers_to, url, payload_bytes, payload_digest, declared_digest) of every record.

    Files that end within a record, or hold something else behind one, raise an error; with ``strict`` false their
    records up to there are returned."""
    columns = ["file", "off", "record_type", "page_id", "refers_to", "url", "payload_bytes", "payload_digest", "declared_digest"]
    found = candidates(spark, path)
    real = chain(found)
    kept = cut(found.join(real, ["file", "off"], "left_semi"), "warc-records")
    if strict:
        _check_ends(found, kept)
    else:
        kept = kept.join(_ends(found), "file").filter("succ <= end").drop("end")
    split = kept.filter(~F.col("whole"))
    if split.isEmpty():
        return kept.select(*columns)
    #: ranges of the records that hold magics, joined to the pieces inside them by (file, block of offsets)
    grain = 1 << 20
    spans = split.select("file", F.col("off").alias("owner"), F.col("succ").alias("end")).withColumn("_g", F.explode(F.sequence(F.floor(F.col("owner") / grain), F.floor(F.col("end") / grain))))
    pieces = found.select("file", "off").withColumn("_g", F.floor(F.col("off") / grain))
    inside = pieces.join(spans, ["file", "_g"]).filter((F.col("off") >= F.col("owner")) & (F.col("off") < F.col("end")))
    again = cut(_pieces(spark, path).join(split.select("file").distinct(), "file", "left_semi").withColumn("_bytes", F.octet_length("value").cast("long")), "warc-pieces")
    parts = _offsets(again).join(inside.select("file", "owner", "off"), ["file", "off"]).withColumnRenamed("off", "at")
    #: a record's pieces are as long together as the record
    whole = parts.groupBy("file", "owner").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda x: x.value), MAGIC).alias("value"))
    whole = whole.withColumn("_head", F.substring_index("value", END, 1)).withColumn("_start", F.octet_length("_head") + len(END))
    whole = whole.withColumn("_length", F.expr("try_cast(regexp_extract(_head, '(?imd)^Content-Length:[ \\t]*([0-9]+)', 1) AS bigint)"))
    whole = whole.withColumn("_block", F.expr("substring(cast(value as binary), cast(_start + 1 as int), cast(_length as int))"))
    fields = _fields(F.col("_head"), F.col("_block"))
    whole = whole.select("file", F.col("owner").alias("off"), *[v.alias(k) for k, v in fields.items()])
    return kept.filter("whole").select(*columns).union(whole.select(*columns))
