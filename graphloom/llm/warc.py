"""WARC: writing pages as archives and reading archives back by boundary-chain verification.

Archives are plain WARC/1.1 files. Reading never trusts the magic alone. Spark's text source, split at the magic, gives
every place where a record might begin, from whichever task holds that part of the file. Each candidate states the
offset at which its record would end. Starting from offset 0 of each file, pointer jumping over these
record-to-successor links keeps what can be reached; a magic inside a payload starts a candidate that no chain reaches,
and its bytes go back to the record around it.

Defined cases: a null html is an empty payload; equal payloads of at least MIN_REVISIT bytes keep one response, that
with the smallest page_id (nulls last; rows that repeat it are responses too), and the others are revisits; an empty
table writes no records and reads none; other columns are ignored; the url may be null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"
#: Payloads shorter than this are never made revisits.
MIN_REVISIT = 100
DATE = "2024-01-01T00:00:00Z"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def record_types(pages: DataFrame) -> DataFrame:
    """pages with payload, payload_digest, payload_bytes, record_type and refers_to.

    Only digests and ids are grouped, with partial sums; the digests that occur twice are joined back.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", payload.alias("payload"), F.sha2(payload.cast("binary"), 256).alias("payload_digest"), F.octet_length(payload).cast("long").alias("payload_bytes"))
    first = (
        rows.filter(F.col("payload_bytes") >= MIN_REVISIT)
        .groupBy("payload_digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1 and first_id is not null").select("payload_digest", "first_id")
    )
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return (
        rows.join(common.if_small(common.stored(first, "revisits"), 20_000), "payload_digest", "left")
        .withColumn("record_type", F.when(revisit, "revisit").otherwise("response"))
        .withColumn("refers_to", F.when(revisit, F.col("first_id")))
        .drop("first_id")
    )


def record_text(rows: DataFrame) -> DataFrame:
    """One string column: the record without its two closing line ends."""
    revisit = F.col("record_type") == "revisit"
    body = F.concat(F.lit(HTTP), F.when(revisit, F.lit("")).otherwise(F.col("payload")))
    uri = F.regexp_replace(F.coalesce(F.col("url"), F.lit("urn:none")), r"[\x00-\x20\x7F]", "")
    lines = [
        F.concat(F.lit("WARC-Type: "), F.col("record_type")),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("null")), F.lit(">")),
        F.when(F.col("url").isNotNull(), F.concat(F.lit("WARC-Target-URI: "), uri)),
        F.lit(f"WARC-Date: {DATE}"),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("payload_digest")),
        F.concat(F.lit("X-Payload-Length: "), F.col("payload_bytes")),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: <urn:page:"), F.col("refers_to"), F.lit(">"))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(body)),
    ]
    return rows.select(F.concat(F.lit(MAGIC), F.concat_ws("\r\n", *lines), F.lit(END), body).alias("value"))


def write_archives(pages: DataFrame, path: str) -> None:
    record_text(record_types(pages)).write.option("lineSep", END).text(path)


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """file, block, file_size, value: what follows each magic up to the next one, and the piece before a file's first magic; digest: of value.

    How files are cut into blocks depends on the session and on the executors at hand, so blocks and the order of rows mean
    the same only inside one scan; between scans a piece is known by its digest.
    """
    return (
        spark.read.option("lineSep", MAGIC).text(path)
        .select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_size").alias("file_size"))
        .withColumn("digest", F.unhex(F.md5(F.col("value").cast("binary"))))
    )


def header(name: str, head=None):
    """A named field of a record's header block, or null."""
    return F.nullif(F.regexp_extract(head if head is not None else F.col("head"), rf"(?:^|\r\n){name}: ([^\r]*)", 1), F.lit(""))


def pieces(chunks: DataFrame) -> DataFrame:
    """file, block, file_size, k (order inside the block), bytes, digest, claimed (the bytes that the record would have) of each candidate, stored: all that follows reads this one scan."""
    head = F.substring_index("value", END, 1)
    return common.stored(chunks.select(
        "file", "block", "file_size", F.monotonically_increasing_id().alias("k"), F.octet_length("value").cast("long").alias("bytes"), "digest",
        F.when(F.contains("value", F.lit(END)), F.octet_length(head) + len(END) + F.try_to_number(header("Content-Length", head), F.lit("999999999999")).cast("long") + len(END)).alias("claimed"),
    ), "pieces")


def located(small: DataFrame) -> DataFrame:
    """pieces with the offset of the magic before each, and the offset where the record that it would start ends.

    Offsets are sums of lengths: inside each block in parallel, plus the sums of the file's earlier blocks.
    """
    step = F.col("bytes") + F.lit(len(MAGIC))
    sums = small.groupBy("file", "block").agg(F.sum(step).alias("block_bytes"))
    base = sums.select("file", "block", (F.sum("block_bytes").over(Window.partitionBy("file").orderBy("block")) - F.col("block_bytes")).alias("base"))  # one row for each block
    inside = Window.partitionBy("file", "block").orderBy("k")
    # The first piece of a file is what stands before its first magic (nothing, in a sound file), so a piece starts one magic before its own text.
    return (
        small.join(base, ["file", "block"])
        .withColumn("offset", F.col("base") + F.sum(step).over(inside) - step - F.lit(len(MAGIC)))
        .withColumn("successor", F.col("offset") + len(MAGIC) + F.col("claimed"))
    )


def reachable(links: DataFrame) -> DataFrame:
    """file, offset of the candidates that the chain from offset 0 of their file reaches.

    Runs of neighbours inside a block, each ending where the next begins, are contracted first; pointer jumping then
    doubles the reach over the few runs in each round, so the rounds grow with the logarithm of blocks and breaks.
    """
    order = Window.partitionBy("file", "block").orderBy("offset")
    runs = links.filter("offset >= 0").withColumn("broken", F.coalesce(F.lag("successor").over(order) != F.col("offset"), F.lit(True)).cast("int"))
    # A chain may also enter a run in its middle, after a break; such offsets become heads of runs of their own.
    runs = runs.withColumn("run", F.sum("broken").over(order))
    ends = runs.groupBy("file", "block", "run").agg(F.min("offset").alias("head"), F.max("offset").alias("last"), F.max_by("successor", "offset").alias("next"))
    runs, ends = common.stored(runs.select("file", "block", "run", "offset"), "runs"), common.stored(ends, "ends")
    heads = ends.select("file", F.col("head").alias("next"))
    inner = ends.join(heads, ["file", "next"], "left_anti").join(runs.select("file", F.col("offset").alias("next"), F.col("block").alias("b2"), F.col("run").alias("r2")), ["file", "next"])
    # Entries: (file, block, run, entry offset). A run is entered at its head or, rarely, at an inner offset.
    nodes = ends.select("file", F.col("head").alias("entry"), "block", "run", "next").unionByName(
        inner.select("file", F.col("next").alias("entry"), F.col("b2").alias("block"), F.col("r2").alias("run")).distinct()
        .join(ends.select("file", "block", "run", F.col("next")), ["file", "block", "run"]).select("file", "entry", "block", "run", "next")
    )
    nodes = common.stored(nodes, "nodes")
    jump = nodes.select("file", "entry", "next")
    reached = nodes.filter("entry = 0").select("file", "entry")
    n = reached.count()
    while True:
        ahead = reached.join(jump, ["file", "entry"]).select("file", F.col("next").alias("entry")).join(nodes.select("file", "entry"), ["file", "entry"], "left_semi")
        reached = common.stored(reached.unionByName(ahead).distinct(), "reached")
        now = reached.count()
        if now == n:
            break
        n = now
        jump = common.stored(jump.alias("a").join(jump.alias("b"), (F.col("a.file") == F.col("b.file")) & (F.col("a.next") == F.col("b.entry"))).select("a.file", "a.entry", "b.next"), "jump")
    entered = reached.join(nodes, ["file", "entry"]).groupBy("file", "block", "run").agg(F.min("entry").alias("from"))
    return runs.join(entered, ["file", "block", "run"]).filter("offset >= `from`").select("file", "offset")


def placed(links: DataFrame, good: DataFrame) -> DataFrame:
    """file, offset, digest, start (the record that the piece lies in, null before a file's first) and part (whether the piece is no whole record), stored. Blocks are worked on apart; of each only its last record is carried on."""
    where = common.stored(links.join(good.withColumn("good", F.lit(True)), ["file", "offset"], "left").withColumn("own", F.when(F.col("good") & (F.col("offset") >= 0), F.col("offset"))), "where")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = where.groupBy("file", "block").agg(F.max("own").alias("last")).select("file", "block", F.max("last").over(before).alias("carried"))  # one row for each block
    inside, same = Window.partitionBy("file", "block").orderBy("offset"), Window.partitionBy("file", "start")
    rows = where.join(carried, ["file", "block"]).withColumn("start", F.coalesce(F.max("own").over(inside), "carried"))
    part = F.col("good").isNull() | F.col("start").isNull() | (F.col("offset") + len(MAGIC) + F.col("bytes") != F.max(F.when(F.col("good"), F.col("successor"))).over(same)) | (F.count(F.lit(1)).over(same) > 1)
    return common.stored(rows.select("file", "offset", "digest", "start", F.coalesce(part, F.lit(True)).alias("part")), "placed")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: file, record_id, record_type, target_uri, payload_digest, payload_bytes, refers_to, body (after the record's header block).

    Texts move only for the exceptions, pieces that are no whole record; all others are records as they are scanned. A piece
    is an exception, by its digest, if any piece of the same bytes is one.
    """
    chunks = candidates(spark, path)
    links = common.stored(located(pieces(chunks)).select("file", "block", "offset", "successor", "bytes", "digest"), "links")
    where = placed(links, common.stored(reachable(links), "good"))
    odd = common.stored(where.filter("part").select("digest").distinct(), "exceptions")
    texts = chunks.select("file", "value", "digest")
    few = common.if_small(odd, 50_000)
    records = texts.join(few, "digest", "left_anti").select("file", F.col("value").alias("record"))
    # A broken record is its own piece and those up to the next record; what stands before a file's first record belongs to none.
    bytes_of = texts.join(few, "digest", "left_semi").groupBy("digest").agg(F.first("value").alias("value"))
    its = where.filter("start is not null").join(few, "digest", "left_semi").select("file", "start", "offset", "digest")
    gathered = its.join(bytes_of, "digest").groupBy("file", "start").agg(F.array_sort(F.collect_list(F.struct("offset", "value"))).alias("p"))
    records = records.unionByName(gathered.select("file", F.array_join("p.value", MAGIC).alias("record"))).withColumn("head", F.substring_index("record", END, 1))
    length = header("Content-Length").cast("int")
    raw = F.substring(F.col("record").cast("binary"), F.octet_length("head") + len(END) + 1, length)
    return records.select(
        "file", header("WARC-Record-ID").alias("record_id"), header("WARC-Type").alias("record_type"), header("WARC-Target-URI").alias("target_uri"),
        F.regexp_replace(header("WARC-Payload-Digest"), "^sha256:", "").alias("payload_digest"), header("X-Payload-Length").cast("long").alias("payload_bytes"),
        header("WARC-Refers-To").alias("refers_to"), raw.alias("body"),
    )


def page_of(urn):
    return F.regexp_extract(urn, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")


def warc_round_trip(pages: DataFrame, path: str | None = None) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to: of a response, length and digest are those of the bytes read back."""
    spark = pages.sparkSession
    path = path or common.stored_path(spark, "warc")
    write_archives(pages, path)
    payload = F.substring(F.col("body"), F.lit(len(HTTP) + 1), F.octet_length("body"))
    response = F.col("record_type") == "response"
    digest = F.sha2(payload, 256)
    return read_archives(spark, path).select(
        page_of(F.col("record_id")).alias("page_id"),
        F.when(response, F.octet_length(payload).cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(response, digest).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type", page_of(F.col("refers_to")).alias("refers_to"),
    )


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(common.table(spark, sf_dir, "pages").select("page_id", "url", "html"))


QUERIES = {"op9_warc": op9_warc}
ORACLE_SQL = {
    "op9_warc": f"""
with p as (select page_id, encode(coalesce(html, '')) as b from pages),
q as (select page_id, octet_length(b) as payload_bytes, sha256(b) as payload_digest from p),
r as (select *, min(page_id) over (partition by payload_digest) as first_id, count(*) over (partition by payload_digest) as n from q)
select page_id, cast(payload_bytes as bigint) as payload_bytes, payload_digest,
  case when payload_bytes >= {MIN_REVISIT} and n > 1 and page_id <> first_id then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= {MIN_REVISIT} and n > 1 and page_id <> first_id then first_id end as refers_to
from r""",
}
