"""Near-duplicate classes by DartMinHash signatures, banded joining and exact checks.

Every distinct text is a weighted set of shingles of SHINGLE words, each weighing as often as it occurs. DartMinHash throws hashed darts, a Poisson process of
unit density, at the plane of each element (weight by rank); those in the set's region (up to the element's weight, and
up to a rank that leaves about COORDINATES * (ln COORDINATES + 2) darts) are dealt to COORDINATES coordinates by their
hash, and each coordinate keeps its dart of the smallest rank. Two sets agree on a coordinate with the probability of
their weighted Jaccard similarity. Texts that agree on all ROWS coordinates of a band meet in a
bucket: at a similarity of 0.8, one of the 20 bands holds both with a probability of 0.99997.

Buckets are never paired out. First each member is compared with the pivot of its bucket, and with those of the smaller
buckets of texts that agree on two bands. In the buckets whose members are then still of several classes, shingles that
no other such text has are counted: they bound the similarity of a pair from above, so most texts that are like none
drop out, and the text with the fewest is the next pivot. Last, members outside a bucket's largest class are held
against those of other classes, inside a join that keeps only pairs whose bound allows a similarity of 0.8. Pairs whose
signatures agree on fewer than AGREED coordinates are dropped in these joins (at a similarity of 0.8, 6 of 100,000
pairs; the last join has longer signatures for the few texts left). Every link is checked exactly on the texts (Jaccard
similarity of the shingle counts, the sum of the lesser by the sum of the greater ones, at least 0.8). Classes are the
components of the links.

Defined cases: equal texts are of one class, whatever their number; a null text counts as empty, and empty texts, like
all texts without words, are only like equal ones; a text of fewer than SHINGLE words is one shingle; the class id is
the smallest doc_id of the class (null if none has one); of a class the row with the smallest doc_id is kept, of
repeated such rows one; an empty table gives no rows; other columns pass through deduplicated().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .hashing import BASE, mixed, shingle_counts, shingle_hashes

SHINGLE, BANDS, ROWS = 5, 20, 4
COORDINATES = BANDS * ROWS
#: Distances of the two bands of a smaller bucket, modulo BANDS; coordinates on which a pair must agree to be checked.
SECOND, AGREED = (1,), 50
#: The same for the longer signatures of the texts that are left after the first comparisons.
FINE, FINE_AGREED = 256, 178


def darts(elements: np.ndarray, weights: np.ndarray, theta: float) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and ranks of the darts up to rank theta in the regions of weighted elements.

    The weight axis is cut into layers [0, 1), [1, 2), [2, 4) ...; in a layer of width s, ranks arrive at rate s.
    """
    ids, ranks = [], []
    layer, base, width = 0, 0.0, 1.0
    while True:
        on = weights > base
        if not on.any():
            break
        h = mixed(elements[on] + np.uint64(layer * int(BASE) % 2**64))
        x, rank, j = weights[on], np.zeros(on.sum()), 1
        while len(h):
            h = mixed(h + np.uint64(j))
            rank = rank - np.log(((h >> np.uint64(11)) + 0.5) * 2.0**-53) / width
            near = rank <= theta
            h, rank, x = h[near], rank[near], x[near]
            if (x < base + width).any():  # else the layer lies in the region as a whole
                inside = base + width * ((mixed(h ^ BASE) >> np.uint64(11)) * 2.0**-53) < x
                ids.append(h[inside])
                ranks.append(rank[inside])
            else:
                ids.append(h)
                ranks.append(rank)
            j += 1
        layer, base, width = layer + 1, base + width, max(1.0, base + width)
    return (np.concatenate(ids), np.concatenate(ranks)) if ids else (np.empty(0, np.uint64), np.empty(0))


def signature(elements: np.ndarray, weights: np.ndarray | None = None, k: int = COORDINATES) -> np.ndarray | None:
    """The k coordinates of a weighted set of hashed elements; None for a set without weight."""
    weights = np.ones(len(elements)) if weights is None else weights
    total = float(weights.sum())
    if total <= 0:
        return None
    theta = k * (np.log(k) + 2) / total
    while True:
        ids, ranks = darts(elements, weights, theta)
        out, order = np.zeros(k, np.uint64), np.argsort(-ranks, kind="stable")
        at = (mixed(ids) % np.uint64(k)).astype(np.int64)
        out[at[order]] = ids[order]  # the smallest rank comes last and stays
        if np.bincount(at, minlength=k).all():
            return out
        theta *= 2


def bands(sig: np.ndarray, n: int = BANDS) -> np.ndarray:
    """One key for each band of a signature."""
    h = np.full(n, 1, np.uint64)
    for column in sig.reshape(n, -1).T:
        h = mixed(h * BASE + column)
    return h.view(np.int64)


def lanes(sig: np.ndarray) -> list[int]:
    """A signature of 8 bits a coordinate, packed in 64-bit numbers."""
    return (mixed(sig) >> np.uint64(56)).astype(np.uint8).view(np.int64).tolist()


def agreement(a, b, k: int = COORDINATES):
    """Coordinates of k on which two packed signatures (array columns) agree: the bytes of their exclusive or that are 0."""

    def unlike(x, y):
        x = x.bitwiseXOR(y)
        for shift, mask in ((4, 0x0F0F0F0F0F0F0F0F), (2, 0x0303030303030303), (1, 0x0101010101010101)):
            x = x.bitwiseOR(F.shiftrightunsigned(x, shift)).bitwiseAND(F.lit(mask))
        return F.bit_count(x)

    return F.lit(k) - F.aggregate(F.zip_with(a, b, unlike), F.lit(0), lambda n, x: n + x)


def letters(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8)


def shingles(text: str) -> np.ndarray:
    """A hash of each occurrence of a shingle."""
    return shingle_hashes(letters(text), SHINGLE)


def signature_of(text: str, k: int = COORDINATES) -> np.ndarray | None:
    """The signature of the text's shingles, weighted by their counts."""
    elements, counts = shingle_counts(letters(text), SHINGLE)
    return signature(elements, counts.astype(np.float64), k)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the Jaccard similarity of two sets of distinct hashes is at least 0.8."""
    if not len(a) or not len(b) or 5 * min(len(a), len(b)) < 4 * max(len(a), len(b)):
        return False
    both = np.concatenate((a, b))
    both.sort()
    common_ = int((both[1:] == both[:-1]).sum())
    return 5 * common_ >= 4 * (len(both) - common_)


def with_digest(docs: DataFrame) -> DataFrame:
    """docs with node, the 128-bit digest of the text."""
    return docs.withColumn("node", F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary"))))


def signatures(docs: DataFrame) -> DataFrame:
    """node, rep (smallest doc_id), keys (of the bands) and lanes (the packed signature; both empty without words): one row for each distinct text. Texts are not shuffled."""
    common.arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, packed = [], []
            for text in batch.column("text"):
                sig = signature_of(text.as_py() or "")
                keys.append([] if sig is None else bands(sig).tolist())
                packed.append([] if sig is None else lanes(sig))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("node"), pa.array(keys, pa.list_(pa.int64())), pa.array(packed, pa.list_(pa.int64()))], ["doc_id", "node", "keys", "lanes"])

    rows = with_digest(docs.select("doc_id", "text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, node binary, keys array<long>, lanes array<long>").groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("keys").alias("keys"), F.first("lanes").alias("lanes"))


def texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, text of wanted (node, rep), stored. The one shuffle of texts; the doc_id is part of its key, so that a text of many copies does not gather them all."""
    asked = wanted.select(F.col("node").alias("n2"), "rep")
    both = with_digest(docs.select("doc_id", "text")).join(asked, (F.col("node") == F.col("n2")) & F.col("doc_id").eqNullSafe(F.col("rep")))
    return common.stored(both.groupBy("node").agg(F.first("text").alias("text")), "texts")  # a row may be repeated


def linked(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts are similar, stored. pairs: distinct, narrow."""
    both = (
        pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")).hint("merge"), "b")
        .join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")).hint("merge"), "a").select("a", "b", "text_a", "text_b")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, of_last = None, None
        for batch in batches:
            keep = []
            for a, text_a, text_b in zip(batch.column("a"), batch.column("text_a"), batch.column("text_b"), strict=True):
                if a.as_py() != last:
                    last, of_last = a.as_py(), shingles(text_a.as_py() or "")
                keep.append(similar(of_last, shingles(text_b.as_py() or "")))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return common.stored(both.mapInArrow(run, "a binary, b binary").distinct(), "links")


def own_shingles(texts: DataFrame) -> DataFrame:
    """node, n (distinct shingles), own (those that no other of the texts has), fine (a longer packed signature)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py() or "" for t in batch.column("text")]
            sets = [shingles(t).view(np.int64) for t in texts]
            fine = [lanes(signature_of(t, FINE)) if len(h) else [0] * (FINE // 8) for t, h in zip(texts, sets, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sets, pa.list_(pa.int64())), pa.array(fine, pa.list_(pa.int64()))], ["node", "hashes", "fine"])

    sets = common.stored(texts.mapInArrow(run, "node binary, hashes array<long>, fine array<long>"), "shingles")
    alone = sets.select("node", F.explode("hashes").alias("h")).groupBy("h").agg(F.min("node").alias("node"), F.count(F.lit(1)).alias("c")).filter("c = 1")
    return sets.select("node", F.size("hashes").alias("n"), "fine").join(alone.groupBy("node").agg(F.count(F.lit(1)).alias("own")), "node", "left").select("node", "n", F.coalesce("own", F.lit(0)).alias("own"), "fine")


def components(links: DataFrame) -> DataFrame:
    """node, class: the smallest node that links (a, b) reach, for nodes of links. Smallest labels travel along links and jump over labels; each round is stored."""
    edges = common.stored(links.select(F.col("a").alias("node"), F.col("b").alias("other")).union(links.select("b", "a")).distinct(), "edges")
    labels = common.stored(edges.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("class")), "labels")
    while True:
        near = edges.join(labels.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("class").alias("m"))
        moved = labels.join(near, "node").select("node", F.least("class", "m").alias("class"), F.col("class").alias("old"))
        jump = labels.select(F.col("node").alias("class"), F.col("class").alias("further"))
        now = common.stored(moved.join(jump, "class", "left").select("node", F.least("class", F.coalesce("further", "class")).alias("class"), "old"), "labels")
        labels = now.select("node", "class")
        if now.filter(F.col("class") != F.col("old")).limit(1).count() == 0:
            return labels


def grown(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels after more links, which join whole classes: components are found again only among the classes that they touch."""
    of = lambda end: labels.select(F.col("node").alias(end), F.col("class").alias(f"{end}_class"))
    ends = links.select("a", "b").join(of("a"), "a", "left").join(of("b"), "b", "left")
    both = ends.select(F.coalesce("a_class", "a").alias("a"), F.coalesce("b_class", "b").alias("b")).filter("a != b")
    moved = components(both).select(F.col("node").alias("class"), F.col("class").alias("into"))
    fresh = links.select(F.col("a").alias("node")).union(links.select("b")).distinct().join(labels, "node", "left_anti").withColumn("class", F.col("node"))
    every = labels.select("node", "class").unionByName(fresh)
    return common.stored(every.join(moved, "class", "left").select("node", F.coalesce("into", "class").alias("class")), "labels")


def starred(rows: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows (band, key, node) of buckets of several nodes, and the pairs of nodes with their bucket's pivot, the smallest node, that agree enough."""
    pivots = rows.groupBy("band", "key").agg(F.min("node").alias("a"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    pivots = common.stored(pivots, "pivots")  # so that the join that follows is one of two plain scans, whose hot buckets AQE splits
    pivots = pivots.join(nodes.select(F.col("node").alias("a"), F.col("lanes").alias("pl")), "a")
    members = common.stored(rows.join(pivots, ["band", "key"]), "members")
    its = nodes.select(F.col("node").alias("b"), "lanes")
    near = members.filter("a != node").join(its, (F.col("node") == F.col("b")) & (agreement(F.col("lanes"), F.col("pl")) >= AGREED))
    return members.select("band", "key", "node"), near.select("a", "b").distinct()


def paired(distance: int):
    """For transform: the bucket of a band's key together with that of the band at a distance."""
    return lambda key, band: F.struct((band + distance * BANDS).alias("band"), F.xxhash64(key, F.element_at("keys", (band + distance) % BANDS + 1)).alias("key"))


def in_several(members: DataFrame, labels: DataFrame) -> DataFrame:
    """band, key, node, class, largest: the members of buckets of several classes, and each bucket's largest class."""
    placed = members.select("band", "key", "node").join(labels, "node", "left").withColumn("class", F.coalesce("class", "node"))
    sizes = placed.groupBy("band", "key", "class").agg(F.count(F.lit(1)).alias("c"))
    several = sizes.groupBy("band", "key").agg(F.max_by("class", F.struct("c", "class")).alias("largest"), F.count(F.lit(1)).alias("classes")).filter("classes > 1").drop("classes")
    return common.stored(placed.join(common.stored(several, "buckets"), ["band", "key"]), "several")


def classes(docs: DataFrame) -> DataFrame:
    """node, rep, class (a node) of each distinct text."""
    common.arrow_batches(docs.sparkSession)
    nodes = common.stored(signatures(docs), "signatures")
    members, pairs = starred(nodes.select("node", F.posexplode("keys").alias("band", "key")), nodes)
    # Only texts that share a bucket at all can share a smaller one.
    close = nodes.join(members.select("node").distinct(), "node", "left_semi")
    two = F.flatten(F.array(*[F.transform("keys", paired(d)) for d in SECOND]))
    _, more = starred(close.select("node", F.explode(two).alias("k")).select("node", "k.band", "k.key"), close)
    texts = texts_of(docs, close.select("node", "rep"))
    compared = common.stored(pairs.union(more).distinct(), "pairs")
    labels = components(linked(compared, texts))
    # What is left: buckets of several classes, of which only texts with few shingles of their own can be like another.
    several = in_several(members, labels)
    own = own_shingles(texts.join(several.select("node").distinct(), "node", "left_semi"))
    able = common.stored(own.filter("5 * own <= n").join(nodes.select("node", "keys"), "node"), "able")
    several = several.join(able, "node")
    pivots = common.stored(several.groupBy("band", "key").agg(F.min_by(F.struct("node", "class", "n", "own"), F.struct("own", "node")).alias("p")), "pivots")
    allowed = lambda n, own, m, its: 9 * F.least(n - own, m - its) >= 4 * (n + m)
    star = several.join(pivots, ["band", "key"]).filter((F.col("class") != F.col("p.class")) & allowed(F.col("n"), F.col("own"), F.col("p.n"), F.col("p.own")))
    star = star.join(able.select(F.col("node").alias("pn"), F.col("fine").alias("pf")), (F.col("p.node") == F.col("pn")) & (agreement(F.col("fine"), F.col("pf"), FINE) >= FINE_AGREED))
    new = star.select(F.least("p.node", "node").alias("a"), F.greatest("p.node", "node").alias("b")).distinct().join(compared, ["a", "b"], "left_anti")
    new = common.stored(new, "pairs")
    compared, labels = compared.union(new), grown(labels, linked(new, texts))
    # Of any two members of different classes one is outside the largest.
    open_ = common.stored(in_several(members, labels).join(able, "node"), "open")
    outside = open_.filter(F.col("class") != F.col("largest")).select("band", "key", F.col("node").alias("p"), F.col("class").alias("pc"), F.col("fine").alias("pf"), F.col("n").alias("pn"), F.col("own").alias("po"), F.col("keys").alias("pk"))
    first = F.array_position(F.zip_with("keys", "pk", lambda x, y: x == y), True) == F.col("m.band") + 1  # a pair counts in the first band that it shares
    alike = (
        (F.col("m.band") == F.col("o.band")) & (F.col("m.key") == F.col("o.key")) & (F.col("class") != F.col("pc")) & allowed(F.col("n"), F.col("own"), F.col("pn"), F.col("po"))
        & first & (agreement(F.col("fine"), F.col("pf"), FINE) >= FINE_AGREED)
    )
    near = open_.alias("m").join(outside.alias("o"), alike).select(F.least("p", "node").alias("a"), F.greatest("p", "node").alias("b")).distinct()
    rest = common.stored(near.join(compared, ["a", "b"], "left_anti"), "pairs")
    if rest.limit(1).count():
        labels = grown(labels, linked(rest, texts))
    return nodes.select("node", "rep").join(labels, "node", "left").withColumn("class", F.coalesce("class", "node"))


def labelled(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """node, class, class_id, n_texts, and the same by class: class, class_id, keeper (the node that stays)."""
    found = common.stored(classes(docs), "classes")
    heads = found.groupBy("class").agg(F.min("rep").alias("class_id"), F.min_by("node", F.struct(F.col("rep").isNull(), F.col("rep"), F.col("node"))).alias("keeper"), F.count(F.lit(1)).alias("n_texts"))
    return found, common.stored(heads, "heads")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, kept, n_texts (distinct texts of the class)."""
    found, heads = labelled(docs)
    rows = with_digest(docs.select("doc_id", "text")).select("doc_id", "node")
    named = found.join(heads, "class").select("node", "class_id", "keeper", "n_texts")
    return rows.join(named, "node").select("doc_id", "class_id", ((F.col("node") == F.col("keeper")) & F.col("doc_id").eqNullSafe(F.col("class_id"))).alias("kept"), "n_texts")


def deduplicated(docs: DataFrame) -> DataFrame:
    """One row of each class, with the columns of docs: that of the smallest doc_id."""
    _, heads = labelled(docs)
    names = {c: f"_in_{k}" for k, c in enumerate(docs.columns)}
    inner = with_digest(docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]).alias("_row"))).drop("text").withColumn("_id", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    keep = heads.select(F.col("keeper").alias("node"), F.coalesce(F.col("class_id").cast("string"), F.lit("null")).alias("_id"))
    kept = inner.hint("merge").join(keep, ["node", "_id"]).dropDuplicates(["node", "_id"])
    return kept.select(*[F.col(f"_row.{n}").alias(c) for c, n in names.items()])


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"))


QUERIES = {"op6_near_dedup": op6_near_dedup}
ORACLE_SQL: dict[str, str] = {}
