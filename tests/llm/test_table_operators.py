import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import common, near_dedup, sharding, warc
from graphloom.llm.hashing import shingle_hashes, word_hashes

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


# --- sharding
def test_sharding_law_and_positions(spark):
    r = random.Random(1)
    rows = [(k, "x" * r.randrange(400)) for k in range(2000)] + [(None, None), (5000, "é" * 3000), (7, "dup"), (7, "dup")]
    df = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, slot int")
    got = sharding.shard(df).collect()
    assert len(got) == len(rows)
    sizes, places = {}, {}
    for x in got:
        sizes[x.shard] = sizes.get(x.shard, 0) + x["size"]
        places.setdefault(x.shard, []).append(x.slot)
    assert set(sizes) == set(range(24)) and all(sorted(p) == list(range(len(p))) for p in places.values())
    assert max(sizes.values()) - min(sizes.values()) <= 6008
    want = sorted((len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for _, t in rows)
    assert sorted((x["size"], x.text_crc32) for x in got) == want
    assert sharding.shard(df.limit(0)).count() == 0


def test_copies_of_a_row_are_spread(spark):
    """A third and more of all rows may be the same row; the shards stay even, for a few large rows as well."""
    rows = [(1, "z" * 100)] * 2000 + [(k, "y" * (k % 300)) for k in range(300)] + [(None, None)] * 50
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()
    sizes = [sum(x["size"] for x in got if x.shard == s) for s in range(4)]
    assert len(got) == len(rows) and max(sizes) - min(sizes) < 0.02 * sum(sizes) / 4
    assert all(sorted(x.slot for x in got if x.shard == s) == list(range(sum(x.shard == s for x in got))) for s in range(4))


def test_the_stored_map_is_used_and_edited(spark, tmp_path):
    r = random.Random(3)
    df = spark.createDataFrame([(k, "x" * r.randrange(500)) for k in range(3000)], "doc_id long, text string")
    path = f"file://{tmp_path}/map"
    first = {x.doc_id: x for x in sharding.shard(df, 6, 256, path).collect()}
    uniform, edited = sharding.SlotMap.load(spark, path, 1), sharding.SlotMap.load(spark, path)
    assert uniform == sharding.SlotMap.uniform(256, 6) and edited.version == 2
    assert all(x.shard == edited.shard_of[x.virtual_slot] and x.map_version == 2 for x in first.values())
    again = {x.doc_id: x for x in sharding.shard(df, 6, 256, path).collect()}  # nothing to edit: the same map
    assert sharding.SlotMap.load(spark, path).version == 2 and all(again[k].shard == x.shard for k, x in first.items())
    grown = {x.doc_id: x for x in sharding.shard(df, 7, 256, path).collect()}
    moved = sum(grown[k].shard != x.shard for k, x in first.items())
    assert sharding.SlotMap.load(spark, path).version == 3 and 0 < moved < 0.3 * len(first)


def test_slot_maps(spark, tmp_path):
    r = random.Random(2)
    weights = [r.randrange(1000) for _ in range(512)]
    first = sharding.SlotMap.balanced(weights, 8)
    grown = first.rebalanced(weights, 9)
    moved = [k for k in range(512) if first.shard_of[k] != grown.shard_of[k]]
    load = [sum(w for w, s in zip(weights, grown.shard_of, strict=True) if s == k) for k in range(9)]
    assert grown.version == 2 and len(moved) < 120 and max(load) < 1.1 * sum(weights) / 9
    assert first.rebalanced(weights).shard_of == first.shard_of
    path = str(tmp_path / "map")
    first.save(spark, path)
    grown.save(spark, path)
    assert sharding.SlotMap.load(spark, path) == grown and sharding.SlotMap.load(spark, path, 1) == first
    slots = spark.range(512).select(F.col("id").cast("int").alias("k")).select(grown.column(F.col("k")).alias("s"), "k").collect()
    assert all(x.s == grown.shard_of[x.k] for x in slots)


# --- WARC
EVIL = "x" * 150 + "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\nWARC/1.1\r\nfoo"


def plain_records(rows):
    out, first = [], {}
    for i, _, h in rows:
        if i is not None and len((h or "").encode()) >= 100:
            first[h] = min(first.get(h, i), i)
    n = [h for _, _, h in rows]
    for i, _, h in rows:
        b = (h or "").encode()
        revisit = len(b) >= 100 and n.count(h) > 1 and h in first and i != first[h]
        out.append((str(i), len(b), hashlib.sha256(b).hexdigest(), "revisit" if revisit else "response", str(first[h] if revisit else None)))
    return sorted(out)


@pytest.mark.parametrize("parts", [1, 3])
def test_warc_round_trip(spark, parts):
    rows = [(1, "u", EVIL), (2, "u", EVIL), (3, None, None), (4, "v", "WARC/1.1\r\n"), (5, "w x\r\ny", "é" * 200), (6, "w", "WARC/1.1\r\nWARC/1.1\r\n\r\n\r\n"), (None, "q", "z" * 120), (7, "q", "z" * 120), (8, "q", "WARC/1.1"), (9, "q", "y" * 300_000), (9, "q", "y" * 300_000), (10, "", "\r\n\r\n"), (11, "e", "")]
    df = spark.createDataFrame([(*x, 0) for x in rows], "page_id long, url string, html string, payload int").repartition(parts)
    got = sorted((str(x.page_id), x.payload_bytes, x.payload_digest, x.record_type, str(x.refers_to)) for x in warc.warc_round_trip(df).collect())
    assert got == plain_records(rows)
    assert warc.warc_round_trip(df.limit(0)).count() == 0


def test_warc_over_small_splits(spark):
    """Files are cut into many splits, so that records and magics lie across their borders."""
    rows = [(k, f"u{k}", ("WARC/1.1\r\nContent-Length: 3\r\n\r\n" * (k % 4) + "p" * (997 * k % 5000))) for k in range(60)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = sorted((str(x.page_id), x.payload_bytes, x.payload_digest, x.record_type, str(x.refers_to)) for x in warc.warc_round_trip(df).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == plain_records(rows)


@pytest.mark.parametrize("parts", ["1", "40"])
def test_warc_when_scans_are_planned_differently(spark, parts, monkeypatch):
    """Executors come and go between the scans of an archive, and files are then cut otherwise: the records stay the same, also those that hold the bytes of others."""
    inner = "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    rows = [(k, f"u{k % 50}", inner * (k % 4) + "p" * (997 * k % 5000) + ("WARC/1.1\r\n" + "q" * (k % 7)) * (k % 3)) for k in range(120)] + [(500, None, EVIL), (501, "u", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    turn, confs = [0], {"spark.sql.files.maxPartitionBytes": "16384", "spark.sql.files.openCostInBytes": "1"}
    for k, v in confs.items():
        spark.conf.set(k, v)

    def stored_apart(of, name):
        """Each stored step sees another cut of the files."""
        turn[0] += 1
        spark.conf.set("spark.sql.files.minPartitionNum", parts if turn[0] % 2 else "7")
        return keep(of, name)

    keep = common.stored
    monkeypatch.setattr(common, "stored", stored_apart)
    try:
        got = warc.warc_round_trip(df)
        spark.conf.set("spark.sql.files.minPartitionNum", "23")
        got = sorted((str(x.page_id), x.payload_bytes, x.payload_digest, x.record_type, str(x.refers_to)) for x in got.collect())
    finally:
        for k in (*confs, "spark.sql.files.minPartitionNum"):
            spark.conf.unset(k)
    assert got == plain_records(rows)


# --- near-duplicates
def test_word_hashes_are_of_words():
    data = lambda s: np.frombuffer(s.encode(), np.uint8)
    a, b = word_hashes(data("one two  one\n")), word_hashes(data("two one"))
    assert a[0] == a[2] == b[1] and a[1] == b[0] and len(a) == 3
    assert len(shingle_hashes(data("a b c"), 5)) == 1 and len(shingle_hashes(data(" "), 5)) == 0


def test_dart_signatures_estimate_weighted_jaccard():
    r = np.random.default_rng(3)
    ids = r.integers(0, 2**63, 40).astype(np.uint64)
    x, y = r.random(40) * 5, r.random(40) * 5
    want = np.minimum(x, y).sum() / np.maximum(x, y).sum()
    got = np.mean([(near_dedup.signature(ids + np.uint64(k), x) == near_dedup.signature(ids + np.uint64(k), y)).mean() for k in range(0, 4000, 100)])
    assert abs(got - want) < 0.05
    assert near_dedup.signature(np.empty(0, np.uint64)) is None


def test_packed_agreement(spark):
    r = np.random.default_rng(4)
    a = r.integers(0, 2**63, 80).astype(np.uint64)
    b = np.where(r.random(80) < 0.5, a, r.integers(0, 2**63, 80).astype(np.uint64))
    df = spark.createDataFrame([(near_dedup.lanes(a), near_dedup.lanes(b))], "a array<long>, b array<long>")
    n = df.select(near_dedup.agreement(F.col("a"), F.col("b")).alias("n")).first().n
    assert abs(n - int((a == b).sum())) <= 3


def family(r, lex, base, edits):
    w = base.split()
    for k in r.sample(range(len(w)), edits):
        w[k] = r.choice(lex) + str(r.randrange(10**6))
    return " ".join(w)


def plain_classes(rows):
    sh = [near_dedup.shingles(t or "") for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] or "") == (rows[j][1] or "") or near_dedup.similar(sh[i], sh[j]):
                up[find(i)] = find(j)
    groups = {}
    for k in range(len(rows)):
        groups.setdefault(find(k), []).append(rows[k][0])
    return sorted(sorted(map(str, g)) for g in groups.values())


def test_classes_against_brute_force(spark):
    r = random.Random(7)
    lex = [f"w{k}" for k in range(300)]
    base = [" ".join(r.choices(lex, k=n)) for n in (60, 120, 200)]
    rows = [(k, " ".join(r.choices(lex, k=r.randrange(1, 80)))) for k in range(60)]
    for b, (text, most) in enumerate(zip(base, (3, 6, 9), strict=True)):
        rows += [(1000 * (b + 1) + k, family(r, lex, text, r.randrange(most))) for k in range(60)]
    rows += [(5000, rows[70][1]), (5001, rows[70][1]), (5002, None), (5003, ""), (5004, " "), (None, "an unnamed row of some words"), (5005, "one two"), (5006, "One  two"), (5007, "three"), (5007, "three")]
    docs = spark.createDataFrame([(*x, "en", "s", 1) for x in rows], DOCS)
    got = near_dedup.near_duplicates(docs).collect()
    groups = {}
    for x in got:
        groups.setdefault((x.class_id, None if x.class_id is not None else x.doc_id), []).append(str(x.doc_id))
    assert sorted(map(sorted, groups.values())) == plain_classes(rows)
    one = near_dedup.deduplicated(docs.withColumn("node", F.lit(1)).withColumn("rep", F.lit(2)))
    assert one.columns == [*docs.columns, "node", "rep"] and one.count() == len(groups)
    assert near_dedup.near_duplicates(docs.limit(0)).count() == 0 and near_dedup.deduplicated(docs.limit(0)).count() == 0


def test_shingles_weigh_by_their_counts():
    line = "one two three four five six seven eight. "
    many, few = line * 20, line * 10
    assert not near_dedup.similar(near_dedup.shingles(many), near_dedup.shingles(few))
    assert near_dedup.similar(near_dedup.shingles(many), near_dedup.shingles(line * 18))
    agree = lambda a, b: (near_dedup.signature_of(a, 4096) == near_dedup.signature_of(b, 4096)).mean()
    x, y = near_dedup.shingles(many), near_dedup.shingles(few + "and then some other words of its own " * 4)
    both = len(np.intersect1d(x, y))
    assert abs(agree(many, few + "and then some other words of its own " * 4) - both / (len(x) + len(y) - both)) < 0.04


def test_many_repeated_rows(spark):
    """Rows that repeat, id and text alike, are compared once."""
    r = random.Random(12)
    lex = [f"w{k}" for k in range(300)]
    base = " ".join(r.choices(lex, k=100))
    rows = [(1, base)] * 700 + [(2, family(r, lex, base, 1))] * 700 + [(3, " ".join(r.choices(lex, k=90)))] * 100
    got = near_dedup.near_duplicates(spark.createDataFrame([(*x, "en", "s", 1) for x in rows], DOCS)).collect()
    assert len(got) == 1500 and {(x.doc_id, x.class_id, x.n_texts) for x in got} == {(1, 1, 2), (2, 1, 2), (3, 3, 1)}


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(bytes([k]), bytes([k + 1])) for k in range(40) if k != 20], "a binary, b binary")
    rows = {bytes(x.node)[0]: bytes(x["class"])[0] for x in near_dedup.components(links).collect()}
    assert all(rows[k] == (0 if k <= 20 else 21) for k in rows)


# --- the pipeline
def test_pipeline_stages(spark):
    import corpus_pipeline

    r = random.Random(8)
    lex = [f"word{k}" for k in range(500)]
    text = lambda n: " ".join(r.choices(lex, k=n))
    base, passage = text(80), text(30)
    rows = [(k, text(60)) for k in range(20)] + [(100, base), (101, family(r, lex, base, 1)), (102, base), (103, None), (104, "123 456"), (105, text(20) + " " + passage), (106, text(40) + " mail me at a.b@c.org or +1 (555) 123-4567 " + text(10))]
    docs = spark.createDataFrame([(*x, "en", "s", len(x[1] or "")) for x in rows], DOCS)
    at = common.stored_path(spark, "sf")
    docs.write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    got = {x.doc_id: x for x in corpus_pipeline.run(spark, at).collect()}
    assert set(got) == {*range(20), 100, 106}
    assert "[EMAIL]" in got[106].text and "[PHONE]" in got[106].text and "a.b@c" not in got[106].text
    assert all(x.n_tokens * 4 == len(x.ids) and x.decoded_sha256 == hashlib.sha256(x.text.encode()).hexdigest() for x in got.values())
    assert got[3].text == dict(rows)[3]


def test_pipeline_on_odd_rows_and_clashing_columns(spark):
    """Null ids and texts, repeated rows and columns with names of the operators' own; and no rows at all."""
    import corpus_pipeline

    r = random.Random(15)
    lex = [f"word{k}" for k in range(500)]
    long = " ".join(r.choices(lex, k=50))
    rows = [(k, " ".join(r.choices(lex, k=60)), "en", "s", 1, "x", 2) for k in range(12)] + [(None, long, "en", None, None, None, None), (None, long, "en", None, None, None, None), (20, None, None, None, None, "x", 1), (21, "", "en", "s", 0, "x", 1), (3, "?!", "en", "s", 1, "x", 1)]
    docs = spark.createDataFrame(rows, DOCS + ", node string, language int")
    at = common.stored_path(spark, "sf")
    docs.write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    got = corpus_pipeline.run(spark, at).collect()
    assert sorted(str(x.doc_id) for x in got) == sorted(map(str, [*range(12), None]))
    empty = common.stored_path(spark, "sf")
    docs.limit(0).write.parquet(f"{empty}/documents.parquet")
    spark.createDataFrame([(1, "a b")], "item_id long, text string").write.parquet(f"{empty}/benchmark.parquet")
    assert corpus_pipeline.run(spark, empty).count() == 0
