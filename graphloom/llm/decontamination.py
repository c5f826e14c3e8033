"""Benchmark decontamination over a distributed positional inverted index, in DataFrame operations only.

Terms of the benchmark are counted over all documents; of each window of an item the RARE rarest terms are its anchors.
The postings (term, document, position) of the anchors are stored. Subtracting an anchor's place in its item from a
posting's position gives the offset at which the item would lie in the document; lists adjusted in this way are
intersected, and an offset on which too few anchors agree is dropped. What remains is compared word by word, so matches
are exact. An item of which some window has a term that no document has cannot match there. Of windows of an item that have
the same words only the first is looked for, so that an item of a few words over and over meets a document of the same words
once for each of its places, not once for each pair of places.

Words: A-Z lower-cased, then runs of ASCII letters, digits and all characters beyond ASCII. A window is WINDOW
consecutive words of an item; an item of fewer words, but not none, is one window.

Defined cases: a null text has no words and no hits; an item without words has no windows; a null item_id is listed as
"null"; repeated items count once per item_id; repeated documents give repeated results; an empty benchmark gives no
hits, an empty documents table no rows; other columns pass through decontaminated() and are ignored by the report.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WINDOW, RARE = 13, 2
#: A document is contaminated if one word in SHARE or more is hit.
SHARE = 20


#: The ASCII characters that are in no word.
BETWEEN = "".join(c for c in map(chr, range(128)) if not c.isalnum())


def words(text: str | Column) -> Column:
    """The words of a text, as WORD has them. One translation and a split at blanks cost a fifth of extracting by a regular expression."""
    text = F.col(text) if isinstance(text, str) else text
    plain = F.trim(F.translate(F.coalesce(text, F.lit("")), UPPER + BETWEEN, LOWER + " " * len(BETWEEN)))
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, " +"))


def keyed(docs: DataFrame) -> DataFrame:
    """docs with a 64-bit key of doc_id and text. Keys only gather candidates, which are then compared with the row's own text."""
    return docs.withColumn("doc_key", F.xxhash64("doc_id", "text"))


def postings(docs: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """term, doc_key, position (from 0) of the given terms (a column term), or of all."""
    rows = keyed(docs.select("doc_id", "text")).select("doc_key", F.posexplode(words("text")).alias("position", "term"))
    return rows if terms is None else rows.join(common.if_small(terms.select("term")), "term", "left_semi")


def item_rows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """item_id (as a string), item_key, item_words and n (words of its windows) of items that have words."""
    rows = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), words("text").alias("item_words"))
    return rows.filter(F.size("item_words") > 0).distinct().withColumn("item_key", F.xxhash64("item_id", "item_words")).withColumn("n", F.least(F.lit(window), F.size("item_words")))


def term_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """term, n_postings over all documents of the given terms; 0 for those that occur nowhere."""
    tokens = docs.select(F.explode(words("text")).alias("term"))
    found = tokens.join(common.if_small(terms), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("n_postings"))
    return terms.join(found, "term", "left").select("term", F.coalesce("n_postings", F.lit(0)).alias("n_postings"))


def windows_of(items: DataFrame) -> DataFrame:
    """item_key, n, start, window (words) of the distinct windows of each item, each at its first place."""
    starts = F.sequence(F.lit(0), F.size("item_words") - F.col("n"))
    rows = items.select("item_key", "n", "item_words", F.explode(starts).alias("start")).select("item_key", "n", "start", F.expr("slice(item_words, start + 1, n)").alias("window"))
    return rows.groupBy("item_key", "n", "window").agg(F.min("start").alias("start"))


def anchors(windows: DataFrame, counts: DataFrame, rare: int = RARE) -> DataFrame:
    """item_key, start, term, place: the rarest terms of each window, less the windows with a term that occurs nowhere."""
    terms = windows.select("item_key", "n", "start", F.posexplode("window").alias("at", "term")).join(counts, "term")
    ordered = terms.groupBy("item_key", "n", "start").agg(F.array_sort(F.collect_list(F.struct("n_postings", (F.col("start") + F.col("at")).alias("place"), "term"))).alias("w"))  # a window has few words
    return ordered.filter(F.element_at("w", 1).n_postings > 0).select("item_key", "start", F.explode(F.slice("w", 1, rare)).alias("a")).select("item_key", "start", "a.term", "a.place")


def phrase_candidates(index: DataFrame, items: DataFrame, anchored: DataFrame, rare: int = RARE) -> DataFrame:
    """doc_key, item_key, offsets (positions of the item's first word, perhaps negative) on which enough anchors agree."""
    places = anchored.select("item_key", "term", "place").distinct()
    hits = index.join(common.if_small(places), "term").select("doc_key", "item_key", (F.col("position") - F.col("place")).alias("offset"), "place")
    agreed = hits.groupBy("doc_key", "item_key", "offset").agg(F.count(F.lit(1)).alias("agreed"))
    enough = agreed.join(common.if_small(items.select("item_key", "n")), "item_key").filter(F.col("agreed") >= F.least(F.lit(rare), F.col("n")))
    return enough.groupBy("doc_key", "item_key").agg(F.collect_list("offset").alias("offsets"))


def proximity_matches(index: DataFrame, queries: DataFrame, width: int) -> DataFrame:
    """query_id, doc_key, position: places where all terms of a query (query_id, terms array) lie within width words, from the one at position. index: postings of at least those terms."""
    wanted = queries.select("query_id", F.array_distinct("terms").alias("terms")).filter(F.size("terms") > 0)
    each = wanted.select("query_id", F.size("terms").alias("n_terms"), F.explode("terms").alias("term"))
    rows = index.join(each, "term").groupBy("query_id", "doc_key", "n_terms").agg(F.array_sort(F.collect_list(F.struct("position", "term"))).alias("at"), F.countDistinct("term").alias("seen"))
    near = rows.filter("seen = n_terms").withColumn("hit", F.explode("at"))
    inside = F.array_distinct(F.transform(F.filter("at", lambda x: (x.position >= F.col("hit.position")) & (x.position < F.col("hit.position") + width)), lambda x: x.term))
    return near.filter(F.size(inside) == F.col("n_terms")).select("query_id", "doc_key", F.col("hit.position").alias("position"))


def matched(docs: DataFrame, items: DataFrame, window: int = WINDOW, rare: int = RARE) -> DataFrame:
    """docs with n_words, n_hit, n_items, item_ids (sorted strings) and contaminated.

    Three passes over the texts: counts of benchmark terms, postings of anchors, and the comparison. Only the last
    shuffles texts, once, by their keys.
    """
    rows = common.stored(item_rows(items, window), "items")
    terms = common.stored(rows.select(F.explode("item_words").alias("term")).distinct(), "terms")
    counts = common.stored(term_counts(docs, terms), "term-counts")
    anchored = common.stored(anchors(windows_of(rows), counts, rare), "anchors")
    index = common.stored(postings(docs, anchored.select("term").distinct()), "postings")
    looked = anchored.groupBy("item_key").agg(F.array_sort(F.collect_set("start")).alias("starts"))
    wanted = common.stored(rows.join(looked, "item_key").select("item_key", "item_id", "item_words", "n", "starts"), "wanted")
    # The words of an item come once to a document, however many offsets it has there.
    found = phrase_candidates(index, rows, anchored, rare).join(common.if_light(wanted, F.array_join("item_words", " "), rows=20_000), "item_key")
    per_doc = found.groupBy("doc_key").agg(F.collect_list(F.struct("item_id", "offsets", "item_words", "n", "starts")).alias("candidates"))
    joined = keyed(docs).hint("merge").join(per_doc, "doc_key", "left").drop("doc_key").withColumn("doc_words", words("text"))

    def hits(c: Column) -> Column:
        """The places, from 0, of the document's words that are in windows of candidate c."""

        def at(offset: Column) -> Column:
            inside = F.filter(c.starts, lambda s: (s + offset >= 0) & (s + offset + c.n <= F.size("doc_words")))
            same = F.filter(inside, lambda s: F.slice("doc_words", s + offset + 1, c.n) == F.slice(c.item_words, s + 1, c.n))
            return F.flatten(F.transform(same, lambda s: F.sequence(s + offset, s + offset + c.n - 1)))

        return F.flatten(F.transform(c.offsets, at))

    compared = joined.withColumn("hits", F.transform("candidates", lambda c: F.struct(c.item_id.alias("item_id"), hits(c).alias("places"))))
    real = compared.withColumn("hits", F.filter(F.coalesce("hits", F.array().cast("array<struct<item_id:string,places:array<int>>>")), lambda h: F.size(h.places) > 0))
    summed = real.select(
        *[F.col(c) for c in docs.columns],
        F.size("doc_words").cast("long").alias("n_words"),
        F.size(F.array_distinct(F.flatten("hits.places"))).cast("long").alias("n_hit"),
        F.array_sort(F.array_distinct("hits.item_id")).alias("item_ids"),
    )
    return summed.withColumn("n_items", F.size("item_ids").cast("long")).withColumn("contaminated", (F.col("n_hit") > 0) & (SHARE * F.col("n_hit") >= F.col("n_words")))


def report(docs: DataFrame, items: DataFrame) -> DataFrame:
    found = matched(docs.select("doc_id", "text"), items)
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


def decontaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs that aren't contaminated, with the columns of docs."""
    names = {c: f"_in_{k}" for k, c in enumerate(docs.columns)}
    # The columns travel under names of our own, so that none can clash with the operator's.
    inner = docs.select(F.col("doc_id"), F.col("text"), F.struct(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]).alias("_row"))
    kept = matched(inner, items).filter(~F.col("contaminated"))
    return kept.select(*[F.col(f"_row.{n}").alias(c) for c, n in names.items()])


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


QUERIES = {"op1_decontamination": op1_decontamination}
_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}')"
ORACLE_SQL = {
    "op1_decontamination": f"""
with i as (select coalesce(cast(item_id as varchar), 'null') as item_id, {_WORDS} as w from benchmark),
s as (select item_id, w, least({WINDOW}, len(w)) as n from i where len(w) > 0),
win as (select distinct item_id, n, array_to_string(list_slice(w, p, p + n - 1), ' ') as g from (select *, unnest(range(1, len(w) - n + 2)) as p from s)),
sizes as (select distinct n from win),
d as (select row_number() over () as r, doc_id, {_WORDS} as w from documents),
g as (select r, n, p, array_to_string(list_slice(w, p, p + n - 1), ' ') as g from (select r, w, n, unnest(range(1, len(w) - n + 2)) as p from d, sizes where len(w) >= n)),
m as (select r, g.n, p, item_id from g join win on g.n = win.n and g.g = win.g),
h as (select r, count(distinct q) as n_hit from (select r, unnest(range(p, p + n)) as q from m) group by r),
it as (select r, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids from (select distinct r, item_id from m) group by r)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 and {SHARE} * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join h using (r) left join it using (r)""",
}
