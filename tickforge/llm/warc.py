"""WARC archives: written by Spark's text sink, read back by boundary-chain verification.

Reading: every place where the version line stands is a candidate record. Scan tasks cut the files there and give each
candidate the offset of its successor, from its header's length. Neighbours that end where the next begins form runs; by
pointer jumping over the runs, only what can be reached from the file's start is kept, so a version line inside a payload
is no record. A record that holds such lines is put together from its pieces, fetched by their hashes.

Defined cases: a null payload is empty; a null page id is an ordinary id, below all others; rows that repeat the
largest id of equal payloads are all responses; a null url gives no target header, and control characters in urls are left
out; a file that doesn't start with a record, and a record cut short by the file's end, give nothing; an empty table
gives an empty archive. Other columns, whatever their names, aren't carried. Page ids are whole numbers; a page is one value of Spark's, so it has 2 GB at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import named, shared_dir, stored

MAGIC, END = "WARC/1.0\r\n", "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MIN_BYTES = 1000
#: Tables of ids and numbers up to this many rows (at most 40 MB) may be broadcast.
NARROW_ROWS, SALTS = 500_000, 16


def small(table: DataFrame) -> bool:
    return table.count() <= NARROW_ROWS


def revisits(pages: DataFrame, min_bytes: int) -> DataFrame:
    """(__page, __hash, __keeper) for each row (page_id, html) whose payload another row of a larger id holds too."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.where(F.octet_length(payload) >= min_bytes).select(
        F.col("page_id").alias("__page"), F.xxhash64("html").alias("__hash"), F.unhex(F.sha2(payload, 256)).alias("__key")
    )
    keepers = (
        rows.groupBy("__key").agg(F.max("__page").alias("__keeper"), F.count(F.lit(1)).alias("__n")).where("__n > 1")
        .select("__key", "__keeper", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__salt"))
    )
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64("__page"), F.lit(SALTS)).cast("int"))
    found = salted.join(keepers, ["__key", "__salt"]).where(~F.col("__page").eqNullSafe(F.col("__keeper")))
    return found.select("__page", "__hash", "__keeper").distinct()


def write_warc(
    pages: DataFrame, path: str, min_bytes: int = MIN_BYTES, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html"
) -> None:
    pages = pages.select(named(id_col).alias("page_id"), named(url_col).alias("url"), named(payload_col).alias("html"))
    again = stored(revisits(pages, min_bytes), "revisits")
    again = F.broadcast(again) if small(again) else again
    rows = pages.withColumn("__own", F.xxhash64("html"))
    rows = rows.join(again, rows["page_id"].eqNullSafe(again["__page"]) & (rows["__own"] == again["__hash"]), "left")
    payload = F.coalesce(F.col("html"), F.lit(""))
    twin = F.col("__hash").isNotNull()
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">\r\n"))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(payload).cast("string"), F.lit(END)
    )
    block = F.concat(http, F.when(twin, F.lit("")).otherwise(payload))
    url = F.regexp_replace(F.col("url"), r"[\x00-\x1F\x7F]", "")
    record = F.concat(
        F.lit(MAGIC + "WARC-Type: "), F.when(twin, "revisit").otherwise("response"), F.lit("\r\nWARC-Record-ID: "), name(F.col("page_id")),
        F.coalesce(F.concat(F.lit("WARC-Target-URI: "), url, F.lit("\r\n")), F.lit("")),
        F.lit(f"WARC-Date: {DATE}\r\nWARC-Payload-Digest: sha1:"), F.sha1(payload.cast("binary")), F.lit("\r\n"),
        F.when(twin, F.concat(F.lit(f"WARC-Profile: {PROFILE}\r\nWARC-Refers-To: "), name(F.col("__keeper")))).otherwise(""),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit(END), block,
    )
    rows.select(record.alias("value")).write.option("lineSep", END).text(path)


def _field(head: Column, name: str) -> Column:
    found = F.regexp_extract(head, rf"(?im)^{name}:[ \t]*([^\r\n]*?)[ \t]*\r?$", 1)
    return F.when(found != "", found)


def _parsed(value: Column) -> dict[str, Column]:
    """What follows a version line, taken as one whole record."""
    head = F.substring_index(value, END, 1)
    rest = F.substr(value, F.char_length(head) + 5)
    http = F.substring_index(rest, END, 1)
    length = _field(head, "Content-Length").try_cast("bigint")
    size = length - F.octet_length(http) - 4
    payload = F.substr(F.substr(rest, F.char_length(http) + 5).cast("binary"), F.lit(1), F.greatest(size, F.lit(0)).cast("int"))
    kind = F.lower(_field(head, "WARC-Type"))
    page = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1).try_cast("bigint")
    return {
        "reach": F.when(F.instr(value, END) > 0, len(MAGIC) + F.octet_length(head).cast("bigint") + 4 + length + 4),
        "record_type": kind, "page_id": page(_field(head, "WARC-Record-ID")), "refers_to": page(_field(head, "WARC-Refers-To")),
        "told": F.regexp_replace(_field(head, "WARC-Payload-Digest"), "^sha1:", ""),
        "told_bytes": _field(http, "Content-Length").try_cast("bigint"),
        "made": F.when(kind == "response", F.sha1(payload)), "made_bytes": F.when(kind == "response", size),
    }


def pieces(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", MAGIC).text(path)


def hashes(value: Column) -> list[Column]:
    return [F.xxhash64(value).alias("h1"), F.xxhash64(F.lit(7), value).alias("h2")]


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """Every place of the version line: (file, at, next_at, succ) and what its header says. No payload is carried."""
    cut = pieces(spark, path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"), F.octet_length("value").cast("bigint").alias("size"),
        *hashes(F.col("value")), *[c.alias(n) for n, c in _parsed(F.col("value")).items()],
    )
    cut = stored(cut, "warc-candidates")
    w = Window.partitionBy("file").orderBy("block", "row")
    before = F.coalesce(F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = F.when(F.row_number().over(w) > 1, before + len(MAGIC) * (F.row_number().over(w) - 2))
    placed = cut.withColumn("at", at).where("at IS NOT NULL")
    return placed.withColumn("next_at", F.col("at") + len(MAGIC) + F.col("size")).withColumn("succ", F.col("at") + F.col("reach"))


def reachable(found: DataFrame) -> DataFrame:
    """found with `real`, whether the chain of successors from the file's start comes by."""
    w = Window.partitionBy("file").orderBy("at")
    whole = F.coalesce(F.col("succ") == F.col("next_at"), F.lit(False))
    starts = (~F.coalesce(F.lag(whole).over(w), F.lit(False))).cast("int")
    runs = stored(found.withColumn("starts", starts).withColumn("run", F.sum("starts").over(w)).drop("starts"), "warc-runs")
    ends = runs.groupBy("file", "run").agg(F.max_by("succ", "at").alias("at"))
    jump = stored(
        ends.join(runs.select("file", "at", F.col("run").alias("to"), F.col("at").alias("enter")), ["file", "at"]).drop("at"), "warc-jumps"
    )
    seen = stored(runs.where("at = 0").select("file", "run", F.lit(0).cast("bigint").alias("enter")), "warc-seen")
    known = seen.count()
    while True:
        ahead = seen.select("file", "run").join(jump, ["file", "run"]).select("file", F.col("to").alias("run"), "enter")
        seen = stored(seen.unionByName(ahead).distinct(), "warc-seen")
        now = seen.count()
        if now == known:
            break
        known = now
        far = jump.select("file", F.col("run").alias("to"), F.col("to").alias("far"), F.col("enter").alias("far_enter"))
        jump = stored(jump.drop("enter").join(far, ["file", "to"]).select("file", "run", F.col("far").alias("to"), F.col("far_enter").alias("enter")), "warc-jumps")
    return runs.join(seen, ["file", "run"], "left").withColumn("real", F.coalesce(F.col("at") >= F.col("enter"), F.lit(False))).drop("run", "enter")


RESULT = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "digest_holds"]


def _result(records: DataFrame) -> DataFrame:
    """A response's payload is counted and hashed as read; a revisit says what its response's is."""
    return records.select(
        "page_id", F.coalesce("made_bytes", "told_bytes").alias("payload_bytes"), F.coalesce("made", "told").alias("payload_digest"),
        "record_type", "refers_to", F.coalesce(F.col("made") == F.col("told"), F.col("record_type") == "revisit").alias("digest_holds"),
    )


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row a real record."""
    found = stored(reachable(candidates(spark, path)), "warc-chain")
    plain = found.where("real AND succ = next_at")
    w = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    last = lambda c: F.last(F.when(F.col("real"), F.struct(F.col("at").alias("at"), F.col(c).alias("v"))), ignorenulls=True).over(w)
    parts = found.withColumn("rec", last("succ")).where(F.col("at") < F.col("rec.v"))
    ends = F.max("next_at").over(Window.partitionBy("file"))
    parts = parts.withColumn("file_end", ends).where((F.col("rec.v") <= F.col("file_end")))
    w_all = Window.partitionBy("file", "rec.at")
    parts = parts.withColumn("n", F.count(F.lit(1)).over(w_all)).where("n > 1 OR succ <> next_at").select(
        "file", F.col("rec.at").alias("rec"), F.col("rec.v").alias("succ"), "at", "h1", "h2"
    )
    parts = stored(parts, "warc-parts")
    if parts.isEmpty():
        return _result(plain)
    needed = parts.select("h1", "h2").distinct()
    needed = F.broadcast(needed) if small(needed) else needed
    texts = pieces(spark, path).select("value", *hashes(F.col("value"))).join(needed, ["h1", "h2"]).dropDuplicates(["h1", "h2"])
    joined = parts.join(texts, ["h1", "h2"]).groupBy("file", "rec", "succ").agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("p"))
    whole = F.array_join(F.col("p.value"), MAGIC)
    return _result(plain).unionByName(_result(joined.select(*[c.alias(n) for n, c in _parsed(whole).items()])))


def archive_pages(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    path = shared_dir(pages.sparkSession, "warc")
    write_warc(pages, path, min_bytes)
    return read_warc(pages.sparkSession, path)
