"""WARC archives: written with the text writer, read back in splits, records confirmed by their boundary chain.

A split sees every place where the magic line stands, and some of these lie inside payloads. So each place is only a
candidate: its header, if it has one, names the offset at which its successor must stand. Pointer jumping from the
start of each file keeps the candidates that the chain of true records reaches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from periodica.session import materialise

MAGIC = "WARC/1.0\r\n"
END = "\r\n\r\n"
#: A map of repeated payloads is broadcast up to so many rows (about 100 bytes each), and joined by a shuffle beyond.
MAP_ROWS = 200_000


def _digest(payload: Column) -> Column:
    return F.sha1(payload.cast("binary"))


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 1000) -> DataFrame:
    """Rows (value): a WARC record without its closing blank lines.

    Of the records with equal payloads of at least ``least`` bytes those with the largest id hold the payload, the
    others are revisits of it; rows that repeat the largest id are responses each, and so are rows without an id
    when no row of the group has one. A null payload is empty, a null url is left out.
    """
    page = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"),
                        F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("payload"))
    page = page.withColumn("size", F.octet_length("payload")).withColumn("digest", _digest(F.col("payload")))
    repeated = materialise(
        page.filter(F.col("size") >= least).groupBy("digest").agg(F.max("id").alias("keeper"), F.count("*").alias("n"))
        .filter((F.col("n") > 1) & F.col("keeper").isNotNull()).drop("n"), "repeated")
    few = repeated.limit(MAP_ROWS + 1).count() <= MAP_ROWS
    named = page.join(F.broadcast(repeated) if few else repeated, "digest", "left")
    revisit = (F.col("size") >= least) & F.col("keeper").isNotNull() & ~F.col("id").eqNullSafe(F.col("keeper"))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    line = lambda key, value: F.concat(F.lit(f"{key}: "), value, F.lit("\r\n"))
    kind = F.when(revisit, "revisit").otherwise("response")
    url = F.when(F.col("url").isNotNull(), line("WARC-Target-URI", F.regexp_replace("url", r"\s", "%20"))).otherwise("")
    head = F.concat(
        F.lit(MAGIC), line("WARC-Type", kind), line("WARC-Record-ID", name(F.col("id"))), url,
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        F.when(revisit, F.concat(line("WARC-Refers-To", name(F.col("keeper"))), F.lit(
            "WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest\r\n"))).otherwise(""),
        F.lit("Content-Type: text/html\r\n"),
        F.lit("Content-Length: "), F.when(revisit, 0).otherwise(F.col("size")).cast("string"), F.lit(END))
    return named.select(F.concat(head, F.when(revisit, "").otherwise(F.col("payload"))).alias("value"))


def write(pages: DataFrame, folder: str, rows_per_file: int = 20_000, **columns) -> None:
    """The archives of ``pages`` in ``folder``; the writer's line end is the end of a record, so bytes are kept."""
    records(pages, **columns).write.option("lineSep", END).option("maxRecordsPerFile", rows_per_file).text(folder)


def _field(name: str) -> Column:
    return F.regexp_extract("header", rf"(?m)^{name}: ([^\r\n]*)", 1)


def candidates(spark: SparkSession, folder: str) -> DataFrame:
    """One row per place of the magic line: file, start, stop (the next place), header fields, the offset at which
    the successor must stand, and the digest of the payload if it ends before ``stop``.

    Splits are read by Spark's text source, cut at the magic line. The bytes that the splits of a file took give
    each split's first offset, and a running sum within the split gives the others. A row is what follows a magic
    line, but a file's first row is what stands before the first one, and is no place. Other empty rows are places.
    """
    raw = spark.read.option("lineSep", MAGIC).text(folder).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    part = raw.select("*", F.monotonically_increasing_id().alias("n"), F.octet_length("value").cast("long").alias("bytes"),
                      F.substring_index("value", END, 1).alias("header"))
    size = F.when(_field("Content-Length").rlike(r"^\d{1,18}$"), _field("Content-Length").cast("long"))
    head = F.octet_length("header") + len(END)
    body = F.substr(F.col("value").cast("binary"), (head + 1).cast("int"), F.col("size").cast("int"))
    whole = F.col("size").isNotNull() & (F.col("bytes") == head + F.col("size") + len(END))
    parsed = part.withColumn("size", size).select(
        "file", "block", "n", "bytes", "size", head.cast("long").alias("head"), _field("WARC-Type").alias("type"),
        _field("WARC-Record-ID").alias("record"), _field("WARC-Payload-Digest").alias("digest"),
        _field("WARC-Refers-To").alias("refers"), F.when(whole, F.sha1(body)).alias("sha1"))
    held = materialise(parsed, "places")
    took = held.groupBy("file", "block").agg(F.sum(F.col("bytes") + len(MAGIC)).alias("took"))
    blocks = took.select("file", "block", (F.sum("took").over(W.partitionBy("file").orderBy("block")) - F.col("took")).alias("base"))
    run = F.sum(F.col("bytes") + len(MAGIC)).over(W.partitionBy("file", "block").orderBy("n"))
    placed = held.withColumn("run", run).join(blocks, ["file", "block"])
    stop = F.col("base") + F.col("run") - len(MAGIC)
    start = stop - F.col("bytes") - len(MAGIC)
    after = F.when(F.col("size").isNotNull(), start + len(MAGIC) + F.col("head") + F.col("size") + len(END))
    return placed.filter(start >= 0).select("file", start.alias("start"), stop.alias("stop"), after.alias("after"), "size", "head",
                                            "type", "record", "digest", "refers", "sha1", "block", "n")


def reachable(places: DataFrame) -> DataFrame:
    """(file, start) of the records on the chain from each file's start, by pointer jumping.

    After round k the reached set holds every record within 2**k steps of the start and ``jump`` leads 2**k steps on.
    """
    jump = places.select("file", "start", F.col("after").alias("to"))
    jump = materialise(jump.join(places.select("file", F.col("start").alias("to")), ["file", "to"]).select("file", "start", "to"), "jump")
    reached = materialise(places.filter((F.col("start") == 0) & F.col("size").isNotNull()).select("file", "start"), "reached")
    seen, total = -1, reached.count()
    while total > seen:
        on = reached.join(jump, ["file", "start"]).select("file", F.col("to").alias("start"))
        reached = materialise(reached.union(on).distinct(), "reached")
        onward = jump.select("file", F.col("start").alias("to"), F.col("to").alias("further"))
        jump = materialise(jump.join(onward, ["file", "to"]).select("file", "start", F.col("further").alias("to")), "jump")
        seen, total = total, reached.count()
    return reached


def _split_payloads(spark: SparkSession, folder: str, places: DataFrame, broken: DataFrame) -> DataFrame:
    """Digests of the records whose payload holds the magic line: their pieces are read again and joined in order.

    A record and its pieces meet on the file and the 64 KB step that they lie in, so no range join is needed.
    """
    step = 1 << 16
    spans = broken.select("file", F.col("start").alias("owner"), "after", "head", "size", F.explode(F.sequence(
        F.floor(F.col("start") / step), F.floor((F.col("after") - 1) / step))).alias("step"))
    pieces = places.withColumn("step", F.floor(F.col("start") / step)).join(spans.drop("head", "size"), ["file", "step"], "inner")
    pieces = pieces.select("file", "block", "n", "start", "owner", spans["after"].alias("end")).filter(
        (F.col("start") >= F.col("owner")) & (F.col("start") < F.col("end")))
    raw = spark.read.option("lineSep", MAGIC).text(folder).select(
        F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"))
    own = raw.join(pieces.select("file", "block", "n", "start", "owner"), ["file", "block", "n"])
    together = own.groupBy("file", "owner").agg(F.array_sort(F.collect_list(F.struct("start", "value"))).alias("parts"))
    joined = F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, F.lit(MAGIC.encode()), p["value"]))
    return together.withColumnRenamed("owner", "start").join(broken.select("file", "start", "head", "size"), ["file", "start"]).select(
        "file", "start", F.sha1(F.substr(joined, (F.col("head") + len(MAGIC) + 1).cast("int"), F.col("size").cast("int"))).alias("whole"))


def read(spark: SparkSession, folder: str) -> DataFrame:
    """The archives' true records: record, payload_bytes, payload_digest, record_type, refers_to, intact.

    A revisit has the size of the payload that it refers to; ``intact`` says that the stored digest is the payload's
    own. A record without a payload digest header gets the one computed here. Files without records give no rows.
    """
    places = materialise(candidates(spark, folder), "candidates")
    true = materialise(places.join(reachable(places), ["file", "start"]), "records")
    broken = true.filter(F.col("sha1").isNull())
    if broken.limit(1).count():
        again = _split_payloads(spark, folder, places, broken)
        true = materialise(true.join(again, ["file", "start"], "left").withColumn("sha1", F.coalesce("sha1", "whole")).drop("whole"), "records")
    said = F.regexp_replace("digest", "^sha1:", "")
    own = true.select("record", "type", "refers", "size", F.when(said == "", F.col("sha1")).otherwise(said).alias("payload_digest"), "sha1")
    responses = own.filter(F.col("type") != "revisit")
    revisits = own.filter(F.col("type") == "revisit")
    # a revisit's target is looked up by its digest, in a table with one row for each; targets of one row each
    targets = responses.join(revisits.select("payload_digest").distinct(), "payload_digest", "left_semi").groupBy(
        "payload_digest").agg(F.max("size").alias("payload_bytes"))
    looked = revisits.join(targets, "payload_digest", "left")
    return responses.select(
        "record", F.col("size").alias("payload_bytes"), "payload_digest", F.col("type").alias("record_type"),
        F.lit(None).cast("string").alias("refers_to"), (F.col("sha1") == F.col("payload_digest")).alias("intact")
    ).unionByName(looked.select(
        "record", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), F.col("refers").alias("refers_to"),
        F.col("payload_bytes").isNotNull().alias("intact")))
