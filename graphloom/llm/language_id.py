"""Language identification by Bayesian evidence fusion.

The posterior of a language multiplies the text's likelihood (hashed runs of three bytes, learned from a bounded sample
of rows with a declared language: of each language those whose hash of doc_id is below a share that leaves about FIT_ROWS of
them, so that rare languages are all learned), the likelihood of the declared markup language, and a prior from the host, which is smoothed towards the host's domain, that towards its
address suffix, and that towards all rows. The counts behind declaration and priors come from grouped aggregation of what
the text alone says, over all rows.

A row is rejected if no language reaches MIN_POSTERIOR, or if its text has no letter at all.

Defined cases: a null or empty text, or one without letters, is undetermined ("und") and rejected; a null declaration, host or suffix
is no evidence; without any declared language nothing can be learned, and all rows with letters are undetermined but not
rejected; of repeated rows of the sample one is learned, repeated rows give repeated results; an empty table gives no rows;
other columns pass through, but for those named language, posterior or rejected, whose place the results take.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Rows learned of each language, about; buckets of byte runs.
FIT_ROWS, BUCKETS = 1000, 1 << 14
#: Numbers in the priors of hosts that may be broadcast (16 MB), and parts into which a host's rows are dealt beyond that.
BROADCAST_PRIORS, PARTS = 2_000_000, 32
#: Runs beyond this many add no further certainty, since they are not independent.
TRUSTED_RUNS = 120
#: Pseudo-counts with which a host leans on its domain, a domain on its suffix, a suffix on all rows.
LEAN = 10.0
MIN_POSTERIOR = 0.5
UND = "und"
LETTER = re.compile(r"[^\W\d_]")


def primary(tag: Column) -> Column:
    """The first part of a language tag in lower case, or null."""
    return F.nullif(F.lower(F.regexp_extract(F.trim(tag), r"^([A-Za-z]{2,3})(?:[-_].*)?$", 1)), F.lit(""))


def host_of(url: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def domain_of(host: Column) -> Column:
    """The last two labels of a host; a name without dots is its own domain."""
    return F.substring_index(host, ".", -2)


def suffix_of(host: Column) -> Column:
    return F.when(F.contains(host, F.lit(".")), F.substring_index(host, ".", -1))


def runs(text: str) -> np.ndarray:
    """Buckets of the runs of three bytes of the lower-cased text."""
    b = np.frombuffer(f" {text.lower()} ".encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    h = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    return (h * np.uint32(2654435761) >> np.uint32(18)).astype(np.int64)


class TextModel:
    """Log-likelihoods of buckets by language."""

    def __init__(self, counts: dict[str, np.ndarray]):
        self.languages = sorted(counts)
        table = np.array([counts[k] for k in self.languages]).reshape(-1, BUCKETS) + 0.5
        self.log = np.ascontiguousarray(np.log(table / table.sum(1, keepdims=True)).T, np.float32)

    def likelihood(self, text: str) -> np.ndarray:
        """Log-likelihood of the text by language, tempered."""
        h = runs(text)
        return self.log[h].mean(0) * min(len(h), TRUSTED_RUNS)


def fit(rows: DataFrame) -> TextModel:
    """rows: doc_id, text, declared."""
    common.arrow_batches(rows.sparkSession)
    known = rows.filter("declared is not null and doc_id is not null and text is not null")
    share = known.groupBy("declared").agg((F.lit(FIT_ROWS) / F.count(F.lit(1))).alias("share"))  # one row for each language
    hashed = F.shiftrightunsigned(F.xxhash64(F.col("doc_id").cast("string")), 11) * F.lit(2.0**-53)
    sample = known.join(F.broadcast(share), "declared").filter(hashed < F.col("share")).groupBy("doc_id", "declared").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: dict[str, np.ndarray] = {}
            for text, lang in zip(batch.column("text"), batch.column("declared"), strict=True):
                n = sums.setdefault(lang.as_py(), np.zeros(BUCKETS, np.int64))
                n += np.bincount(runs(text.as_py() or ""), minlength=BUCKETS)
            for lang, n in sums.items():
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], ["lang", "bucket", "n"])

    sums = sample.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    got = sums.groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("at")).collect()  # a vector of BUCKETS counts for each language
    counts = {}
    for r in got:
        counts[r.lang] = np.zeros(BUCKETS)
        counts[r.lang][[x.bucket for x in r["at"]]] = [x.n for x in r["at"]]
    return TextModel(counts)


def first_guess(rows: DataFrame, model: TextModel) -> DataFrame:
    """declared, host, guess (by the text alone) of each row with letters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            guess = []
            for text in batch.column("text"):
                t = text.as_py() or ""
                guess.append(int(model.likelihood(t).argmax()) if LETTER.search(t) else None)
            yield pa.RecordBatch.from_arrays([batch.column("declared"), batch.column("host"), pa.array(guess, pa.int32())], ["declared", "host", "guess"])

    return rows.select("declared", "host", "text").mapInArrow(run, "declared string, host string, guess int").filter("guess is not null")


def host_priors(counts: DataFrame, n_languages: int) -> DataFrame:
    """host, prior (by language): hierarchically smoothed shares. counts: host, guess, n."""
    of = counts.filter("host is not null").withColumn("domain", domain_of(F.col("host"))).withColumn("suffix", F.coalesce(suffix_of(F.col("host")), F.lit("")))
    langs = F.sequence(F.lit(0), F.lit(n_languages - 1))

    def vectors(df: DataFrame, *keys: str) -> DataFrame:
        """For each key the counts by language."""
        sums = df.groupBy(*keys, "guess").agg(F.sum("n").alias("n")).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("guess", F.col("n").cast("double")))).alias("m"))
        return sums.select(*keys, F.transform(langs, lambda k: F.coalesce(F.try_element_at("m", k), F.lit(0.0))).alias("v"))

    def leaned(v: Column, on: Column) -> Column:
        total = F.aggregate(v, F.lit(0.0), lambda a, x: a + x)
        return F.zip_with(v, on, lambda x, p: (x + LEAN * p) / (total + LEAN))

    everywhere = [r.n for r in counts.groupBy().agg(F.sum("n").alias("n")).collect()]
    top = counts.groupBy("guess").agg(F.sum("n").alias("n")).collect()  # one row for each language
    share = [0.0] * n_languages
    for r in top:
        share[r.guess] = float(r.n)
    share = [(x + 1) / (float(everywhere[0] or 0) + n_languages) for x in share]
    start = F.array(*[F.lit(x) for x in share])
    suffixes = vectors(of, "suffix").select("suffix", leaned(F.col("v"), start).alias("sp"))
    domains = vectors(of, "suffix", "domain").join(suffixes, "suffix").select("suffix", "domain", leaned(F.col("v"), F.col("sp")).alias("dp"))
    return vectors(of, "suffix", "domain", "host").join(domains, ["suffix", "domain"]).select("host", leaned(F.col("v"), F.col("dp")).alias("prior"))


def with_priors(rows: DataFrame, priors: DataFrame, n_languages: int, name: str) -> DataFrame:
    """rows with the prior of their host as name. Beyond what may be broadcast, rows are dealt by host and a part, so that neither a host of many rows nor rows without one meet in one task."""
    priors = priors.select(F.col("host").alias(f"{name}_host"), F.col("prior").alias(name))
    on = F.col("host") == F.col(f"{name}_host")
    most = BROADCAST_PRIORS // (n_languages + 4)
    if priors.limit(most + 1).count() <= most:
        return rows.join(F.broadcast(priors), on, "left").drop(f"{name}_host")
    part, its = f"{name}_part", f"{name}_its"
    dealt = rows.withColumn(part, F.pmod(F.monotonically_increasing_id(), F.lit(PARTS)).cast("int"))
    spread = priors.withColumn(its, F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    return dealt.join(spread.hint("merge"), on & (F.col(part) == F.col(its)), "left").drop(f"{name}_host", part, its)


def identified(rows: DataFrame) -> DataFrame:
    """rows (doc_id, text, declared, host, and any others) with language, posterior and rejected.

    Two passes over the texts; only priors of hosts are joined to them.
    """
    common.arrow_batches(rows.sparkSession)
    rows = rows.drop("language", "posterior", "rejected")
    name = next(n for k in range(len(rows.columns) + 1) if not any(c.startswith(n := f"_prior{k}") for c in rows.columns))
    model = fit(rows.select("doc_id", "text", "declared"))
    out = T.StructType([*rows.schema.fields, T.StructField("language", T.StringType()), T.StructField("posterior", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    names = model.languages
    if names:
        counts = common.stored(first_guess(rows, model).groupBy("declared", "host", "guess").agg(F.count(F.lit(1)).alias("n")), "evidence")
        said = counts.filter(F.col("declared").isin(names)).groupBy("declared", "guess").agg(F.sum("n").alias("n")).collect()  # languages squared
        table = np.full((len(names), len(names)), 0.5)
        for r in said:
            table[names.index(r.declared), r.guess] += r.n
        declared = dict(zip(names, np.log(table / table.sum(0)), strict=True))
        priors = common.stored(host_priors(counts, len(names)), "priors")
        joined = with_priors(rows, priors, len(names), name)
        total = counts.groupBy("guess").agg(F.sum("n").alias("n")).collect()
        base = np.ones(len(names))
        for r in total:
            base[r.guess] += r.n
        base = np.log(base / base.sum())
    else:
        declared, base, joined = {}, np.empty(0), rows.withColumn(name, F.lit(None).cast("array<double>"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            language, posterior, rejected = [], [], []
            for text, said_, prior in zip(batch.column("text"), batch.column("declared"), batch.column(name), strict=True):
                t = text.as_py() or ""
                if not names or not LETTER.search(t):
                    language.append(UND)
                    posterior.append(0.0)
                    rejected.append(not LETTER.search(t))
                    continue
                score = model.likelihood(t).astype(np.float64) + (base if (p := prior.as_py()) is None else np.log(p))
                if (d := declared.get(said_.as_py())) is not None:
                    score = score + d
                e = np.exp(score - score.max())
                e /= e.sum()
                best = int(e.argmax())
                language.append(names[best] if e[best] >= MIN_POSTERIOR else UND)
                posterior.append(float(e[best]))
                rejected.append(bool(e[best] < MIN_POSTERIOR))
            kept = [batch.column(c) for c in out.names[:-3]]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(language, pa.string()), pa.array(posterior, pa.float64()), pa.array(rejected, pa.bool_())], out.names)

    return joined.select(*[F.col(f"`{c}`") for c in rows.columns], name).mapInArrow(run, out)


def document_rows(docs: DataFrame) -> DataFrame:
    """doc_id, text, declared (lang) and host (the source) of documents."""
    return docs.select("doc_id", "text", primary(F.col("lang")).alias("declared"), F.lower("source").alias("host"))


def page_rows(pages: DataFrame) -> DataFrame:
    """The same of web pages: the language that the markup declares, and the address's host. The text is what stands outside tags, scripts and styles."""
    text = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>", " "), r"<[^>]*>", " ")
    declared = F.regexp_extract("html", r"""(?i)<html\b[^>]*?\blang\s*=\s*["']?([A-Za-z]{2,3}(?:[-_][A-Za-z0-9]+)*)""", 1)
    return pages.select(F.col("page_id").alias("doc_id"), text.alias("text"), primary(declared).alias("declared"), host_of(F.col("url")).alias("host"))


def accepted(docs: DataFrame) -> DataFrame:
    """The rows of docs that are not rejected, with the columns of docs."""
    names = {c: f"_in_{k}" for k, c in enumerate(docs.columns)}
    inner = document_rows(docs.select("doc_id", "text", "lang", "source")).schema  # checks that the columns exist
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    rows = rows.select(F.col(names["doc_id"]).alias(inner.names[0]), F.col(names["text"]).alias("text"), primary(F.col(names["lang"])).alias("declared"), F.lower(names["source"]).alias("host"), *[n for c, n in names.items() if c != "text"])
    kept = identified(rows).filter(~F.col("rejected"))
    return kept.select(*[F.col("text" if c == "text" else n).alias(c) for c, n in names.items()])


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = identified(document_rows(common.table(spark, sf_dir, "documents")))
    return found.select("doc_id", "declared", "language", "posterior", (~F.col("rejected")).alias("kept"))


def language_id_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same operator on web pages, with markup, address suffix and hosts."""
    found = identified(page_rows(common.table(spark, sf_dir, "pages")))
    return found.select(F.col("doc_id").alias("page_id"), "declared", "host", "language", "posterior", (~F.col("rejected")).alias("kept"))


QUERIES = {"op4_language_id": op4_language_id, "language_id_pages": language_id_pages}
ORACLE_SQL: dict[str, str] = {}
