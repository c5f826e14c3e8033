import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphloom.llm import byte_bpe, common, decontamination, html_extraction, language_id, pii, quality, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (1, None, None, None, None), (2, "", "en", "s", 0), (3, "  \n\t", "en", "s", 4), (None, "a row without an id and some words", "en", None, 5), (5, "same text", "en", "s", 9), (5, "same text", "en", "s", 9),
    (6, "é日本😀 \x00 ß" * 3, "de", "s", 1), (7, "word " * 40_000, "en", "big", 200_000), (8, "7" * 30_000, None, "s", 30_000), (9, "a" * 30_000, "en", "s", 30_000),
]
PATH, PATTERN = byte_bpe.public_vocabulary()


def sha(b):
    return hashlib.sha256(b).hexdigest()


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS).cache()


# --- byte-level BPE
@pytest.fixture(scope="module")
def tiktoken_encoding():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=byte_bpe.bpe(PATH, PATTERN).ranks, special_tokens={})


@settings(max_examples=200, deadline=None)
@given(st.one_of(st.text(max_size=80), st.text(alphabet="abe '1", max_size=200), st.text(alphabet="aA!é\n", max_size=60)))
def test_bpe_matches_tiktoken(tiktoken_encoding, text):
    m = byte_bpe.bpe(PATH, PATTERN)
    text = text.encode("utf-8", "ignore").decode()
    packed = m.encode(text)
    assert np.frombuffer(packed, "<u4").tolist() == tiktoken_encoding.encode_ordinary(text)
    assert m.decode(packed) == text.encode()


def test_bpe_long_pieces(tiktoken_encoding):
    m, r = byte_bpe.bpe(PATH, PATTERN), random.Random(3)
    for text in ("a" * 5000, "ab" * 3000, "".join(r.choice("etaoin") for _ in range(3000)), "-=" * 2000):
        assert np.frombuffer(m.encode(text), "<u4").tolist() == tiktoken_encoding.encode_ordinary(text)


def test_bpe_query_on_odd_rows(odd, tiktoken_encoding):
    rows = byte_bpe.digests(odd.withColumn("ids", F.lit(1)), PATH, PATTERN).collect()
    want = sorted((str(i), (ids := np.array(tiktoken_encoding.encode_ordinary(t or ""), "<u4").tobytes()) and len(ids) // 4 or 0, sha(ids), sha((t or "").encode())) for i, t, *_ in ODD)
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows) == want
    assert byte_bpe.digests(odd.limit(0), PATH, PATTERN).count() == 0


# --- personal data
BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"), "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def plain_base(text):
    out = []
    for kind, p in BASE.items():
        for m in p.finditer(text):
            d = re.sub(r"[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 14 <= len(d) <= 19 and pii.luhn(d), "phone": 10 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), m.end(), kind))
    return sorted(out, key=lambda s: (s[0], pii.KINDS.index(s[2])))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "b.c", "@", ".", "1", "25", "256", ".0", "4111111111111111", "4111 1111-1111 1111", "+1", " (555) 123-4567", " ", "-", "é", "x@y.z", "@@", "10.0.0.1", "😀", "0000"]), max_size=14).map("".join))
def test_base_spans_match_plain_patterns(text):
    assert pii.base_spans(text) == plain_base(text)


def test_added_spans_and_redaction():
    text = "IBAN DE89 3704 0044 0532 0130 00 und mehr, mail a.b@c.de, card 4111 1111 1111 1111, host 10.1.2.3"
    kinds = [s[2] for s in pii.spans(text)]
    assert kinds.count("iban") == 1 and {"email", "card", "ip"} <= set(kinds)
    out = pii.redacted(text)
    assert "DE89" not in out and "a.b@c.de" not in out and "4111" not in out and "10.1.2.3" not in out and "[IBAN]" in out and "mehr" in out
    assert not any(s[2] == "iban" for s in pii.spans("DE88 3704 0044 0532 0130 00"))
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")


def test_every_iban_of_a_run_is_found():
    both = "DE89 3704 0044 0532 0130 00 GB82 WEST 1234 5698 7654 32"
    assert [s[:3] for s in pii.spans(both)] == [(0, 27, "iban"), (28, 55, "iban")] and pii.redacted(both) == "[IBAN] [IBAN]"
    assert pii.redacted("ID42 IBAN DE89370400440532013000") == "ID42 IBAN [IBAN]"
    assert pii.redacted("AB12 CODE GB82 WEST 1234 5698 7654 32 now") == "AB12 CODE [IBAN] now"


def plain_ibans(text):
    """All IBANs by trying every start and, from the longest, every end."""
    out, at = [], 0
    while at < len(text):
        end = None
        if (at == 0 or not re.match(r"[A-Za-z0-9]", text[at - 1])) and re.match(r"[A-Z]{2}[0-9]{2}", text[at:]):
            for e in range(min(len(text), at + 64), at + 14, -1):
                code = re.sub(r"[\x20-]", "", text[at:e])
                if re.fullmatch(r"[A-Z]{2}[0-9]{2}(?:[\x20-]?[A-Z0-9]){11,30}", text[at:e]) and (e == len(text) or not re.match(r"[A-Za-z0-9]", text[e])) and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1:
                    end = e
                    break
        if end:
            out.append((at, end))
        at = end or at + 1
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["DE89370400440532013000", "GB82 WEST 1234 5698 7654 32", "GB82-WEST-1234-5698-7654-32", "DE88370400440532013000", "AB12", "IBAN", "x", " ", "  ", "-", ".", "12", "A"]), max_size=8).map("".join))
def test_ibans_match_trying_all(text):
    assert list(pii.ibans(text)) == plain_ibans(text)


def test_context_decides_added_spans():
    kinds = lambda t: [s[2] for s in pii.spans(t)]
    key = "04dbebab91ab85687d33eeaaf9c0ffee12345678"
    assert kinds(f'token = "{key}"') == ["secret"] and kinds(f"Password: {key}") == ["secret"]
    assert kinds(f"of {key} the") == [] and kinds(f"commit {key}") == [] and kinds(f"key of commit {key}") == []
    assert kinds("token = aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa") == [] and kinds("token = " + "ab12cd34" * 100) == []
    assert kinds("SSN 123-45-6789") == ["ssn"] and kinds("on 123-45-6789 it") == [] and kinds("ssn 000-12-3456, 666-12-3456, 123-00-4567") == []
    iban = "DE89 3704 0044 0532 0130 00"
    assert kinds(iban) == ["iban"] and kinds(f"serial {iban}") == [] and kinds(f"serial, bank {iban}") == ["iban"]
    assert kinds(f"iban far away {'x ' * 40}{iban} {'y ' * 40} serial") == ["iban"]
    assert kinds("version 10.1.2.3") == ["ip"]  # base spans stay whatever their context
    assert pii.redacted(f'token = "{key}"') == 'token = "[SECRET]"'


def test_pii_on_odd_rows(odd):
    rows = pii.report(odd).collect()
    assert len(rows) == len(ODD) and all(r.base_sha256 == sha(b"") for r in rows)
    again = pii.redact(odd.withColumn("spans", F.lit("x")))
    assert again.columns == [*odd.columns, "spans"] and again.filter("text is null").count() == 1
    assert pii.report(odd.limit(0)).count() == 0


# --- quality
def plain_counts(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    hit = {k + j for k, w in enumerate(windows) if windows.count(w) > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), sum(x in lines[:k] for k, x in enumerate(lines)), len(hit)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab #|\n\t é", max_size=120))
def test_quality_counts(text):
    assert quality.counts(text) == plain_counts(text)


def test_quality_learns_and_keeps(spark):
    r = random.Random(5)
    good = [(k, " ".join(r.choice(["the", "quiet", "river", "moves", "past", "old", "stones"]) + str(r.randrange(50)) for _ in range(80)), 1) for k in range(60)]
    bad = [(100 + k, " ".join(r.choice(["***", "###", "buy", "%%%", "!!!"]) + str(r.randrange(50)) for _ in range(80)), 0) for k in range(60)]
    docs = spark.createDataFrame([x[:2] for x in good + bad], "doc_id long, text string")
    labels = spark.createDataFrame([(x[0], x[2]) for x in good + bad], "doc_id long, quality int")
    model = quality.train(docs, labels)
    rows = {x.doc_id: x for x in quality.verdicts(docs, model).collect()}
    assert all(rows[k].kept for k, *_ in good) and not any(rows[k].kept for k, *_ in bad)


def test_quality_on_odd_rows(odd, spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.train(odd, none) is None
    rows = quality.verdicts(odd, None).collect()
    assert len(rows) == len(ODD) and all(r.base_failed and not r.kept for r in rows if r.n_words < 50)


def test_quality_trains_on_odd_rows_of_any_type(odd, spark):
    labels = spark.createDataFrame([(i, k % 2) for k, (i, *_) in enumerate(ODD)] + [(77, 1), (5, 9)], "doc_id long, quality long").withColumn("text", F.lit("x"))
    named = lambda df: df.withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    clash = odd.withColumn("quality", F.lit(3)).withColumn("score", F.lit("s")).withColumn("x", F.lit(1))
    for docs, known in ((clash, labels), (named(clash), named(labels).withColumn("quality", F.col("quality").cast("string")))):
        rows = quality.verdicts(docs, quality.train(docs, known)).collect()
        assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows) and all(r.base_failed and not r.kept for r in rows if r.n_words < 50)
    assert quality.verdicts(odd.limit(0), None).count() == 0 and quality.train(odd.limit(0), labels) is None


def test_quality_verdicts_against_plain_regression(spark):
    """The verdict is the base rules' and that of the fitted probability, whatever the batch."""
    r = random.Random(11)
    docs = [(k, " ".join(r.choice(["river", "stone", "***", "buy"] if k % 2 else ["quiet", "stone", "moves"]) + str(r.randrange(40)) for _ in range(r.randrange(20, 120)))) for k in range(120)] + [(500, "same old words " * 40), (501, None)]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    model = quality.train(d, spark.createDataFrame([(k, 1 - k % 2) for k in range(120)], "doc_id long, quality int"))
    w, b, a, c = model
    for x in quality.verdicts(d, model).collect():
        text = dict(docs)[x.doc_id] or ""
        n = plain_counts(text)
        p = 1 / (1 + np.exp(-(a * (float(quality.features(text).astype(np.float64) @ w) + b) + c)))
        bad = n[0] < 50 or 100 * n[4] > 50 * n[0]
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == n and x.base_failed == bad
        assert abs(x.score - p) < 1e-3 and (abs(p - quality.KEEP) < 1e-3 or x.kept == (not bad and p >= quality.KEEP))


# --- toxicity
def test_index_is_exact():
    r = random.Random(1)
    idf = {f"t{k}": 1 + r.random() for k in range(30)}
    rows = [(k, {t: r.randrange(1, 4) for t in r.sample(range(30), r.randrange(1, 6))}, r.randrange(2)) for k in range(500)]
    index = toxicity.Index(idf, rows, (10, 1))
    dense = np.zeros((500, 30))
    at = {i: n for n, i in enumerate(index.ids.tolist())}
    for i, c, _ in rows:
        t, w = index.vector(c)
        dense[at[i], t] = w
    for _, c, _ in rows[:40]:
        t, w = index.vector(c)
        scores = dense[:, t] @ w
        want = sorted(((s, n) for n, s in enumerate(scores) if s > 0), key=lambda x: (-round(x[0], 9), x[1]))[: toxicity.K]
        got = index.search(t, w)
        assert [round(s, 9) for s, _ in got] == [round(s, 9) for s, _ in want]


def test_batches_of_queries_are_exact_and_compare_few(monkeypatch):
    """Short and long lists, shared lists, examples left out; portions by bound spare most of the examples that the first ones admit."""
    monkeypatch.setattr(toxicity, "LONG", 40)
    r = random.Random(11)
    idf = {f"t{k}": 0.2 + r.random() for k in range(60)} | {f"u{k}": 3.0 for k in range(30)}
    rows = []
    for k in range(3000):
        counts = {t: r.randrange(1, 4) for t in r.sample(range(60), r.randrange(3, 20))}
        if k % 7 == 0:
            counts |= dict.fromkeys(range(60 + k % 10 * 3, 63 + k % 10 * 3), 1 + k % 2)  # three terms always together
        rows.append((str(k), counts, r.randrange(2)))
    index = toxicity.Index(idf, rows, (3000, 1500))
    assert len(index.names) == 90 and len(index.cut) - 1 == 70 and all(len(set(index.list_of[60 + k : 63 + k].tolist())) == 1 for k in range(0, 30, 3))
    number = {i: n for n, i in enumerate(index.ids)}
    dense = np.zeros((3000, 90))
    for i, c, _ in rows:
        t, w = index.vector(c)
        dense[number[i], t] = w
    asked = rows[:300]
    skips = [number[i] if k % 2 else -1 for k, (i, _, _) in enumerate(asked)]
    compared, products = [], index.products
    monkeypatch.setattr(index, "products", lambda q, examples: compared.append(len(examples)) or products(q, examples))
    got = index.nearest([index.query(*index.vector(c)) for _, c, _ in asked], skips=skips)
    for (i, _, _), near, skip in zip(asked, got, skips, strict=True):
        scores = dense @ dense[number[i]]
        if skip >= 0:
            scores[skip] = 0
        assert [round(s, 9) for s, _ in near] == np.sort(scores)[::-1][: toxicity.K].round(9).tolist()
        assert all(abs(scores[n] - s) < 1e-9 for s, n in near)
    assert sum(compared) < 300 * 3000 / 2 and max(compared) > toxicity.FIRST


def test_words_of_latin_1_are_those_of_the_pattern():
    texts = ["", "a\x85b\xa0c\x1cd", "Ünïcode straße² 1a_b ªº×÷", "".join(f"{chr(c)}x{chr(c)}" for c in range(256)), "İK œuvre", "".join(map(chr, range(0x250)))]
    assert all(toxicity.words_of(t) == toxicity.WORDS.findall(t.lower()) for t in texts)


def test_toxicity_learns_only_from_training_rows(spark):
    r = random.Random(2)
    words = ["river", "stone", "house", "garden", "window", "music", "paper", "bread"]
    docs, labels = [], []
    for k in range(400):
        toxic = int(k % 4 == 0)
        docs.append((k, " ".join(r.choices(words, k=30) + (["vileword"] * 2 if toxic else []))))
        labels.append((k, toxic))
    d, y = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    held = {k for k in range(400) if zlib.crc32(str(k).encode()) % 5 == 0}
    assert not held & {x.doc_id for x in toxicity.sample(y).collect()}
    rows = toxicity.scored(d, toxicity.train(d, y)).collect()
    assert {x.doc_id for x in rows if x.held_out} == held
    assert all(x.predicted == int(x.doc_id % 4 == 0) for x in rows) and all(0 <= x.score <= 1 for x in rows)
    assert any(x.evidence for x in rows)


def test_toxicity_of_few_labels_uses_all_terms_and_examples(spark):
    r = random.Random(3)
    words = ["river", "stone", "house", "garden", "window", "music", "paper", "bread"]
    docs = [(k, " ".join(r.choices(words, k=30) + (["scum", "clown"] if k % 8 == 0 else []))) for k in range(72)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    index = toxicity.train(d, spark.createDataFrame([(k, int(k % 8 == 0)) for k in range(72)], "doc_id long, toxic int"))
    assert len(index.ids) == sum(zlib.crc32(str(k).encode()) % 5 != 0 for k in range(72)) and {"river", "scum", "scum-"} <= set(index.terms)
    assert all(x.predicted == int(x.doc_id % 8 == 0) and x.evidence for x in toxicity.scored(d, index).collect())


def test_toxicity_on_odd_rows(odd, spark):
    index = toxicity.train(odd, spark.createDataFrame([], "doc_id long, toxic int"))
    rows = toxicity.scored(odd, index).collect()
    assert len(rows) == len(ODD) and all(r.score == 0 and r.predicted == 0 for r in rows)


# --- languages
def test_languages(spark):
    r = random.Random(4)
    lex = {"en": ["the", "river", "with", "stone", "through"], "de": ["der", "fluß", "mit", "stein", "durch"], "fr": ["la", "rivière", "avec", "pierre", "à"]}
    rows = [(k, " ".join(r.choices(lex[x], k=25)), x, f"{x}.example.{x}") for k, x in enumerate(list(lex) * 40)]
    df = spark.createDataFrame([*rows, (900, None, "en", None), (901, "123 !!", "en", "h.com"), (902, "the river with stone", None, None)], "doc_id long, text string, declared string, host string")
    got = {x.doc_id: x for x in language_id.identified(df).collect()}
    assert all(got[k].language == x and not got[k].rejected for k, _, x, _ in rows)
    assert got[900].rejected and got[901].rejected and got[901].language == "und" and got[902].language == "en"


def plain_languages(rows):
    """(language, posterior) of each row (text, declared, host) by one process: likelihoods, counts and smoothed shares."""
    def grams(t):
        b = f" {t.lower()} ".encode()
        return [((((b[k] << 16) | (b[k + 1] << 8) | b[k + 2]) * 2654435761) % 2**32) >> 18 for k in range(len(b) - 2)]

    names = sorted({d for t, d, _ in rows if d and t is not None})
    log = {}
    for x in names:
        n = np.bincount([g for t, d, _ in rows if d == x and t is not None for g in grams(t)], minlength=language_id.BUCKETS) + 0.5
        log[x] = np.log(n / n.sum())

    def likelihood(t):
        g = grams(t)
        return np.array([log[x][g].mean() * min(len(g), language_id.TRUSTED_RUNS) for x in names])

    spoken = [bool(re.search(r"[^\W\d_]", t or "")) for t, _, _ in rows]
    guess = [int(likelihood(t).argmax()) if ok else None for (t, _, _), ok in zip(rows, spoken, strict=True)]
    said, total = np.full((len(names), len(names)), 0.5), np.ones(len(names))
    for (_, d, _), g in zip(rows, guess, strict=True):
        if g is not None:
            total[g] += 1
            if d in names:
                said[names.index(d), g] += 1
    said = np.log(said / said.sum(0))
    top = np.array([sum(g == k for g in guess) + 1 for k in range(len(names))], float)
    share = top / (sum(g is not None for g in guess) + len(names))

    def leaned(of, on):
        n = np.array([sum(g == k and h is not None and of(h) for (_, _, h), g in zip(rows, guess, strict=True)) for k in range(len(names))], float)
        return (n + language_id.LEAN * on) / (n.sum() + language_id.LEAN)

    suffix = lambda h: h.rsplit(".", 1)[1] if "." in h else ""
    domain = lambda h: ".".join(h.split(".")[-2:])
    seen = {h for (_, _, h), g in zip(rows, guess, strict=True) if g is not None and h is not None}
    priors = {h: leaned(lambda x, h=h: x == h, leaned(lambda x, h=h: domain(x) == domain(h), leaned(lambda x, h=h: suffix(x) == suffix(h), share))) for h in seen}
    out = []
    for (t, d, h), ok in zip(rows, spoken, strict=True):
        if not ok:
            out.append(("und", 0.0))
            continue
        s = likelihood(t) + (np.log(priors[h]) if h in priors else np.log(total / total.sum())) + (said[names.index(d)] if d in names else 0)
        e = np.exp(s - s.max())
        e /= e.sum()
        out.append((names[int(e.argmax())] if e.max() >= language_id.MIN_POSTERIOR else "und", float(e.max())))
    return out


@pytest.mark.parametrize("most", [2_000_000, 0])
def test_languages_against_brute_force(spark, monkeypatch, most):
    """Seventy languages and all kinds of evidence; most = 0: priors too many to be broadcast."""
    monkeypatch.setattr(language_id, "BROADCAST_PRIORS", most)
    r = random.Random(14)
    tags = ["".join(r.sample("abcdefghijklmnopqrstuvwxyz", 2)) + "x" * (k % 2) for k in range(70)]
    lex = {x: ["".join(r.choices("abcdeghilmnorstuvé", k=r.randrange(2, 7))) for _ in range(12)] for x in tags}
    rows = []
    for k in range(400):
        x = tags[k % 70] if k < 210 else r.choice(tags[:5])
        rows.append((" ".join(r.choices(lex[x], k=r.randrange(2, 30))), r.choice([x, x, x, None, "zz"]), r.choice([f"a{k % 3}.{x}.{x[0]}", f"{x}.{x[0]}", "shared", None])))
    rows += [(None, "en", "h.com"), ("", None, None), ("12 !", "en", "shared"), (" ".join(lex[tags[0]]), None, None)]
    df = spark.createDataFrame([(k, *x, "p", "q", 1) for k, x in enumerate(rows)], "doc_id long, text string, declared string, host string, prior string, language string, _prior0 int")
    got = language_id.identified(df)
    assert got.columns == ["doc_id", "text", "declared", "host", "prior", "_prior0", "language", "posterior", "rejected"]
    got = {x.doc_id: x for x in got.collect()}
    want = plain_languages(rows)
    assert len(got) == len(rows) and all(got[k].prior == "p" and got[k]._prior0 == 1 for k in got)
    assert all(abs(got[k].posterior - p) < 1e-3 and (got[k].language == x or abs(p - language_id.MIN_POSTERIOR) < 1e-3) for k, (x, p) in enumerate(want))


def test_language_parts(spark):
    df = spark.createDataFrame([("HTTPS://u@M.Example.co.UK:8/x", "EN-us")], "u string, t string")
    row = df.select(language_id.host_of(F.col("u")).alias("h"), language_id.primary(F.col("t")).alias("p")).first()
    assert row.h == "m.example.co.uk" and row.p == "en"


def test_language_on_odd_rows(odd):
    kept = language_id.accepted(odd.withColumn("host", F.lit("h")).withColumn("declared", F.lit(7)))
    assert kept.columns == [*odd.columns, "host", "declared"]
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(5) == 2 and 1 not in ids and 8 not in ids and 7 in ids
    assert language_id.accepted(odd.limit(0)).count() == 0


# --- HTML
def test_main_text():
    page = """<html><head><title>T</title><style>p{}</style></head><body><nav><a href=x>menu</a></nav><div class="cookie-notice">We use cookies</div><header>Site</header>
<article><header><h1>Head &amp; line</h1></header><p>First   para<br>goes on with enough words to count.</p><p>Short.</p><aside>side</aside><form><input>ask</form><script>var t="</p>"</script>
<section id="comments"><p>A reader says something long enough to look like text.</p></section></article><footer>foot</footer></body></html>"""
    assert html_extraction.main_text(page) == "Head & line\n\nFirst para goes on with enough words to count.\n\nShort."
    assert html_extraction.main_text(None) == html_extraction.main_text("") == ""
    assert html_extraction.main_text("<p>Just one paragraph here.") == "Just one paragraph here."
    assert html_extraction.main_text("<nav>only menu</nav>") == ""


def test_html_on_odd_rows(spark):
    df = spark.createDataFrame([(1, "u", None, "x"), (2, None, "<p>a</p>" * 3, "y"), (2, None, "<p>a</p>" * 3, "y"), (3, "v", "<" * 2000, "z"), (4, "w", "x" * 300_000, "z")], "page_id long, url string, html string, text string")
    rows = html_extraction.extracted(df).orderBy("page_id").collect()
    assert [r.n_chars for r in rows] == [0, 7, 7, rows[3].n_chars, 300_000] and rows[1].text == "a\n\na\n\na"
    assert html_extraction.extracted(df.limit(0)).count() == 0


def test_main_text_without_an_article():
    page = "<body><h1>Title here</h1><div><ul><li><a href=a>One</a></li><li><a href=b>Two</a></li></ul></div><div><p>A long paragraph of the text which goes on for many words and then some more.</p><p>End.</p></div></body>"
    assert html_extraction.main_text(page) == "Title here\n\nA long paragraph of the text which goes on for many words and then some more.\n\nEnd."


LONG = "A long paragraph of the text which goes on for many words, and then for some more of them"


def filler(n):
    return [f"{LONG}, part {k}." for k in range(n)]


def test_ratio_selects_the_content_of_pages_without_articles():
    """Flat markup, in which no name says what the content is: the smoothed ratio alone finds it, and keeps a short paragraph between long ones."""
    story = [*filler(3), "Yes.", *filler(2)]
    links = "".join(f'<p><a href="{k}">Link {k}</a></p>' for k in range(12))
    odds = "".join(f"<p>{w}</p>" for w in ("Mon", "Tue", "12", "Top", "A", "B"))
    page = f"<body>{odds}{links}{''.join(f'<p>{x}</p>' for x in story)}{links}{odds}</body>"
    want = "\n\n".join(story)
    assert html_extraction.main_text(page) == want
    cards = "".join(f"<div class=c><span>{w}</span><span>{w}</span></div>" for w in "one two three four five six seven eight".split())
    boxed = f"<body><div class=x>{cards}{odds}</div><div class=y><h1>T</h1>{''.join(f'<p>{x}</p>' for x in ['Short.', *story, 'End.', 'So.'])}</div><div class=z>{cards}</div></body>"
    assert html_extraction.main_text(boxed) == "\n\n".join(["T", "Short.", *story, "End.", "So."])


def test_smoothing_decides():
    """A short last line beside the text: smoothing lifts it, without it is cut off."""
    odds = "".join(f"<p>{k}</p>" for k in range(20))
    page = f"<body>{odds}{''.join(f'<p>{x}</p>' for x in filler(4))}<p>The end.</p>{odds}</body>"
    assert html_extraction.main_text(page) == "\n\n".join([*filler(4), "The end."]) != html_extraction.main_text(page, sigma=0.0)


@pytest.mark.parametrize("name", ["widget-free share", "entry hidden-xs", "post search-result", "post"])
def test_misleading_class_names_do_not_drop_text(name):
    page = f"<body><nav>n</nav><article><p>{filler(1)[0]}</p><div class='{name}'><p>{filler(2)[1]}</p><p>{filler(3)[2]}</p></div></article></body>"
    assert html_extraction.main_text(page) == "\n\n".join(filler(3))


def test_doubtful_and_named_blocks():
    body = "".join(f"<p>{x}</p>" for x in filler(4))
    share = "<div class='share'><a href=1>Tell</a> <a href=2>Post</a></div>"
    comments = f"<section class='comments'>{''.join(f'<article class=comment><p>{x}</p></article>' for x in filler(3))}</section>"
    assert html_extraction.main_text(f"<body><article>{body}{share}</article>{comments}</body>") == "\n\n".join(filler(4))
    wrapper = f"<body><div class='page sidebar-left'><div class='banner'>Buy it now, really</div><h1>Head</h1><div class='c'>{body}</div></div></body>"
    assert html_extraction.main_text(wrapper) == "\n\n".join(["Head", *filler(4)])
    teasers = "".join("<article class=card><p>Read it</p></article>" for _ in range(5))
    assert html_extraction.main_text(f"<body><div>{teasers}</div><div class=text>{body}</div></body>") == "\n\n".join(filler(4))
    assert html_extraction.main_text("<article><p>one <span class=ad>buy</span> two</p></article>") == "one two"


def test_odd_markup_does_not_fail():
    f = html_extraction.main_text
    assert f("<p>x</p><![foo[ x ]]>") == "x\n\n]>" or f("<p>x</p><![foo[ x ]]>") == "x"
    assert f("<p>a</p><!-- x --!><p>b</p>") == "a\n\nb" and f("<p>a</p><!--> <p>b</p>") == "a\n\nb" and f("<p>a</p><!-- open <p>b</p>") == "a"
    assert f("<p>a<![CDATA[ x > y ]]>") and f("<!DOCTYPE [<!x]><p>a") and f("<?php x ?><p>a") and f("</p></x><p>a</b></p>") == "a"


@pytest.mark.parametrize("piece", ["<b>", "<span><p>", "<div>", "<div><span>", "<p>x<a href=1>", "<li>x", "</b>", "<article>", "<i></p>", "<td>"])
def test_open_tags_cost_linear_time(piece):
    import time

    began = time.process_time()
    html_extraction.main_text(piece * 50_000 + "text")
    assert time.process_time() - began < 20


# --- decontamination
def plain_hits(docs, items):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = str.maketrans(decontamination.UPPER, decontamination.LOWER)
    words = lambda t: word.findall((t or "").translate(low))
    out = []
    for i, t in docs:
        w, hit, ids = words(t), set(), set()
        for item, text in items:
            v = words(text)
            n = min(13, len(v))
            for s in range(len(v) - n + 1) if n else ():
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == v[s : s + n]:
                        hit |= set(range(p, p + n))
                        ids.add("null" if item is None else str(item))
        out.append((str(i), len(w), len(hit), len(ids), sha(",".join(sorted(ids)).encode()), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out)


def test_decontamination_against_brute_force(spark):
    r = random.Random(6)
    lex = ["the", "a", "of", "river", "stone", "É", "x1", "und"]
    text = lambda n: " ".join(r.choices(lex, k=n))
    items = [(k, text(r.choice([3, 13, 20, 40]))) for k in range(6)] + [(3, "rare words only"), (10, None), (None, "Null item text"), (11, "  "), (2, "rare words only")]
    docs = [(k, text(60)) for k in range(12)]
    docs += [(50, text(10) + " " + items[k][1] + " " + text(10)) for k in range(6)] + [(51, "RARE, words\nonly"), (52, None), (53, ""), (None, "null item text"), (54, items[5][1] * 2), (51, "RARE, words\nonly")]
    d = spark.createDataFrame([(*x, "z") for x in docs], "doc_id long, text string, hits string")
    b = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, n int")
    rows = decontamination.report(d, b).collect()
    assert sorted((str(x.doc_id), x.n_words, x.n_hit, x.n_items, x.items_sha256, x.contaminated) for x in rows) == plain_hits(docs, items)
    kept = decontamination.decontaminated(d, b)
    assert kept.columns == d.columns and kept.count() == sum(not x.contaminated for x in rows)
    assert decontamination.report(d, b.limit(0)).filter("n_hit > 0").count() == 0
    assert decontamination.report(d.limit(0), b).count() == 0


def test_decontamination_of_repeated_words(spark):
    """Items and documents of one word, or of a few words over and over, cost time in proportion to their lengths."""
    import time

    items = [(1, "the " * 2000), (2, "a b " * 500), (3, "x y z " + "the " * 30)]
    docs = [(1, "the " * 20_000), (2, "b " + "a b " * 6000), (3, "x y z " * 10 + "the " * 12), (4, "q " * 100 + "the " * 13)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    began = time.time()
    rows = {r.doc_id: r for r in decontamination.report(d, b).collect()}
    assert time.time() - began < 120
    assert (rows[1].n_hit, rows[1].n_items) == (20_000, 2) and (rows[2].n_hit, rows[2].n_items) == (12_001, 1)
    assert (rows[3].n_hit, rows[3].n_items) == (15, 1) and (rows[4].n_hit, rows[4].n_items) == (13, 2)


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha x x beta"), (2, "alpha x x x x beta"), (3, "beta alpha")], "doc_id long, text string")
    index = decontamination.postings(docs)
    queries = spark.createDataFrame([("q", ["alpha", "beta"])], "query_id string, terms array<string>")
    near = decontamination.proximity_matches(index, queries, 4)
    keys = {r.doc_key: r.doc_id for r in decontamination.keyed(docs).collect()}
    assert {(keys[r.doc_key], r.position) for r in near.collect()} == {(1, 0), (3, 0)}


def test_words_match_the_pattern(spark):
    df = spark.createDataFrame([("A\x00b\x1fc É9--x 日本  y",), ("",), (None,), (" ,; ",)], "text string")
    low = F.translate(F.coalesce("text", F.lit("")), decontamination.UPPER, decontamination.LOWER)
    assert df.filter(~decontamination.words("text").eqNullSafe(F.regexp_extract_all(low, F.lit(decontamination.WORD), F.lit(0)))).count() == 0


def test_batches_are_bounded(spark):
    common.arrow_batches(spark)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) == common.ARROW_ROWS


def plain_scores(texts, labels):
    """Scores of all texts by dense vectors: terms, weights, the K nearest, votes and calibration. texts: by id; labels: of the rows to learn from."""
    words = lambda t: re.findall(r"[^\W\d_]+", (t or "").lower())
    terms = lambda t: [x for w in words(t) for x in {w, *(w[:n] + "-" for n in (4, 5, 6) if len(w) >= n)}]
    n, n1 = len(labels), sum(labels.values())
    df = {}
    for i, y in labels.items():
        for x in set(terms(texts[i])):
            df.setdefault(x, [0, 0])[y] += 1
    weight = {}
    for x, (neg, pos) in df.items():
        if neg + pos >= 2:
            odds = np.log((pos + 0.5) / (n1 + 1)) - np.log((neg + 0.5) / (n - n1 + 1))
            weight[x] = (np.log((1 + n) / (1 + pos + neg)) + 1) * max(abs(odds), toxicity.LEAST)
    names = sorted(weight)

    def vector(t):
        c = np.array([terms(t).count(x) for x in names], float)
        w = np.where(c > 0, 1 + np.log(np.maximum(c, 1)), 0) * np.array([weight[x] for x in names])
        return w / (np.sqrt((w * w).sum()) or 1)

    vectors = {i: vector(t) for i, t in texts.items()}
    examples = [i for i in labels if vectors[i].any()]
    rate = (n1 + 1) / (n + 2)

    def logit(v, without=None):
        near = sorted(((round(float(vectors[i] @ v), 6), labels[i]) for i in examples if i != without), key=lambda x: -x[0])[: toxicity.K]
        near = [(1 / (0.1 + max(0.0, 1 - s)), y) for s, y in near if s > 0]
        p = (sum(w * y for w, y in near) + toxicity.PRIOR * 10 * rate) / (sum(w for w, _ in near) + toxicity.PRIOR * 10)
        return np.log(p / (1 - p))

    a, b = quality.platt(np.array([logit(vectors[i], i) for i in examples]), np.array([labels[i] for i in examples]))
    return {i: rate if not v.any() else 1 / (1 + np.exp(-(a * logit(v) + b))) for i, v in vectors.items()}


def test_toxicity_scores_against_dense_vectors(spark):
    """Neighbours, votes and calibration of all texts, rare and frequent terms alike; texts are distinct, so the K nearest are too."""
    r = random.Random(9)
    lex = ["".join(r.choices("abcdefgh", k=r.randrange(3, 9))) for _ in range(60)]
    texts = {str(k): " ".join(r.choices(lex, weights=range(1, 61), k=r.randrange(5, 40)) + r.choices(["idiot", "idiots", "moron"], k=(k % 5 == 0) * r.randrange(1, 3))) for k in range(150)} | {"900": None, "901": "?? 11", "902": "zzz unknown"}
    d = spark.createDataFrame([(i, t, 1) for i, t in texts.items()], "doc_id string, text string, score int")
    labels = {i: int(int(i) % 5 == 0) for i in texts if int(i) < 150}
    index = toxicity.train(d, spark.createDataFrame([(i, str(y)) for i, y in labels.items()], "doc_id string, toxic string"))
    want = plain_scores(texts, {i: y for i, y in labels.items() if zlib.crc32(i.encode()) % 5})
    rows = toxicity.scored(d, index).collect()
    assert len(rows) == len(texts) and len(index.ids) > 100
    assert max(abs(x.score - want[x.doc_id]) for x in rows) < 1e-4
    assert all(x.evidence for x in rows if x.doc_id not in ("900", "901", "902"))


def test_toxicity_trains_on_odd_rows(odd, spark):
    labels = spark.createDataFrame([(i, k % 2) for k, (i, *_) in enumerate(ODD)] + [(77, 1), (5, 7)], "doc_id long, toxic long").withColumn("text", F.lit("x"))
    rows = toxicity.scored(odd.withColumn("toxic", F.lit(3)).withColumn("score", F.lit("s")), toxicity.train(odd.withColumn("toxic", F.lit(3)), labels)).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.scored(odd.limit(0), toxicity.train(odd.limit(0), labels)).count() == 0


def test_tasks_of_the_pipeline_give_up_remembered_encodings(spark, monkeypatch):
    """Python workers are used again by the operators that follow; digests, which stand alone, keep what they met."""
    import pyarrow as pa

    df = spark.createDataFrame([(1, "some words, some words")], "doc_id long, text string")
    runs, model = [], byte_bpe.bpe(PATH, PATTERN)
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, f, schema: runs.append(f) or self)
    byte_bpe.digests(df, PATH, PATTERN)
    byte_bpe.encoded(df, PATH, PATTERN)
    batch = pa.RecordBatch.from_pydict({"doc_id": [1], "text": ["some words, some words"]})
    for run, kept in zip(runs, (True, False), strict=True):
        assert [b.num_rows for b in run(iter([batch]))] == [1]
        assert bool(model.pieces) == bool(model.spaced) == kept
    assert not model.fits.cache_info().currsize and not model.pieces.old
