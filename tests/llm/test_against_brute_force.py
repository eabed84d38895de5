"""Operators against plain versions of what they compute."""

import collections
import hashlib
import math
import os
import random
import re
import struct
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from folioframe.llm import blocks, catalog, components, cotraining, extraction, language, lines, mixing, pieces, quality_rules, resemblance, simhash, sketch, url_rules
from folioframe.llm.common import tokenizer_path

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def _union(n, pairs):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return [find(x) for x in range(n)]


def _simhash(parts):
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_components(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(k, k + 1) for k in range(60, 90)] + [(5, 5)]
    want = _union(91, pairs)
    got = {r.node: r.root for r in components.components(spark.createDataFrame(pairs, "a long, b long"), "a", "b").collect()}
    assert all(got.get(k, k) == want[k] for k in range(91))


def test_near_duplicates(spark):
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r for r in catalog.queries()["op2_simhash_near_dedup"](spark, SF).collect()}
    fp = []
    for text in docs.text:
        w = [x.decode() for x in text.encode().lower().split()]
        fp.append(_simhash([" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]) if w else 0)
    assert [got[i].fingerprint for i in docs.doc_id] == [f"{x:016x}" for x in fp]
    near = [(a, b) for a in range(len(fp)) for b in range(a) if (fp[a] ^ fp[b]).bit_count() <= 2]
    ids = docs.doc_id.tolist()
    root = _union(len(fp), near)
    least = {r: min(ids[k] for k in range(len(ids)) if root[k] == r) for r in set(root)}
    assert [got[i].component_id for i in ids] == [least[r] for r in root]


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_divided_shards(spark, radius):
    rng = np.random.default_rng(5)
    center = rng.integers(0, 1 << 62, 4)
    fp = sorted({int(c) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False) if b < 63) for c in center for _ in range(120)})
    nodes = spark.createDataFrame(list(enumerate(fp)), "node long, fp long")
    got = _union(len(fp), [(r.a, r.b) for r in simhash.links(nodes, radius, limit=8).collect()])
    want = _union(len(fp), [(a, b) for a in range(len(fp)) for b in range(a) if (fp[a] ^ fp[b]).bit_count() <= radius])
    assert got == want


@pytest.mark.parametrize("large", [64, 1])
def test_near_dedup_stage_by_resemblance(spark, monkeypatch, large):
    monkeypatch.setattr(resemblance, "OPEN", large)  # the smaller bound divides nearly all blocks
    rng = random.Random(11)
    passage = [f"p{k}" for k in range(200)]  # shared by texts that are not alike
    texts = [" ".join([*passage, *(f"y{rng.randrange(10**6)}" for _ in range(90))]) for _ in range(40)]
    for _ in range(25):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice((12, 60, 300)))]
        for edits in (0, 1, 1, len(base) // 60 + 1, len(base) // 20):
            words = list(base)
            for at in rng.sample(range(len(words)), edits):
                words[at] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(words))
    texts += ["", " \n", texts[0].upper()]
    grams = [{tuple(w[i : i + 5]) for w in [t.lower().split()] for i in range(max(1, len(w) - 4))} if t.strip() else {0} for t in texts]
    root = _union(len(texts), [(a, b) for a in range(len(texts)) for b in range(a) if len(grams[a] & grams[b]) >= 0.8 * len(grams[a] | grams[b])])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, SF).collect())
    assert got == sorted(set(root)) and len(got) < len(texts) - 40


def test_sketches(spark):
    docs = pd.read_parquet(f"{SF}/documents.parquet").sort_values("doc_id", ascending=False)
    texts = docs.text.tolist()
    after = [*texts[1:], texts[0]]
    edited = [t[: len(t) - len(t) // 3] + n[: len(t) // 3] for t, n in zip(texts, after, strict=True)]
    got = {r.doc_id: r for r in sketch_rows(spark)}
    assert [got[i].edited_sha256 for i in docs.doc_id] == [hashlib.sha256(x.encode()).hexdigest() for x in edited]
    grams = lambda t: {tuple(w[i : i + 5]) for w in [t.split()] for i in range(max(1, len(w) - 4))}
    errors = [abs(got[i].near_edited - len(grams(a) & grams(b)) / min(len(grams(a)), len(grams(b)))) for i, a, b in zip(docs.doc_id, texts, edited, strict=True) if len(a) > 3000]
    assert errors and np.mean(errors) < 0.08
    assert all(got[i].near_next < 0.3 for i, a, b in zip(docs.doc_id, texts, after, strict=True) if not grams(a) & grams(b))


def sketch_rows(spark):
    return catalog.queries()["op4_document_fingerprints"](spark, SF).collect()


def test_sketches_merge(spark):
    texts = ["a b c d e f g h i j k l m", "u v w x y z a b c d e f", "one two", "", "nine words that are too few for a hash"]
    rows = spark.createDataFrame([(x, y) for x in texts for y in texts], "x string, y string")
    for r in rows.select(sketch.merge(sketch.sketch(F.col("x"))["kept"], sketch.sketch(F.col("y"))["kept"]).alias("m"), *[sketch.sketch(F.col(c)).alias(c) for c in "xy"]).collect():
        assert r.m == sorted({*r.x.kept, *r.y.kept})


def test_sketches_by_hand(spark):
    """Fingerprints and likeness of short and long texts against plain versions; hashes are Spark's own."""
    rng = random.Random(9)
    texts = [" ".join(f"w{rng.randrange(60)}" for _ in range(n)) for n in (0, 1, 3, 5, 6, 9, 30, 200)] + ["w1 w2", "w2 w1", "one two three four five six seven"]
    pairs = [(x, y) for x in texts for y in texts]
    shingled = lambda t: [w[i : i + 5] for w in [t.split()] for i in range(max(1, len(w) - 4))] if t else []
    all_shingles = sorted({tuple(s) for t in texts for s in shingled(t)})
    hashed = spark.createDataFrame([(list(s),) for s in all_shingles], "s array<string>").select("s", F.xxhash64(F.transform("s", lambda w: F.xxhash64(w))).alias("h")).collect()
    of = {tuple(r.s): r.h for r in hashed}
    kept = lambda t: sorted({h for h in (of[tuple(s)] for s in shingled(t)) if h < -(1 << 63) + (1 << 62)})
    rows = spark.createDataFrame(pairs, "x string, y string").select("x", "y", sketch.containment(sketch.sketch(F.col("x")), sketch.sketch(F.col("y"))).alias("c"), sketch.fingerprint(sketch.sketch(F.col("x"))).alias("f")).collect()
    for r in rows:
        a, b = kept(r.x), kept(r.y)
        want = len({*a} & {*b}) / min(len(a), len(b)) if a and b else float(shingled(r.x) == shingled(r.y))
        assert r.c == pytest.approx(want)
        n, rest = r.f.split(":")
        assert int(n) == len(shingled(r.x)) and (rest == ",".join(f"{h & (1 << 64) - 1:x}" for h in a) if a or not int(n) else rest[0] == "=")


def test_short_texts_in_long_ones(spark):
    """A wholly contained text that has a kept hash is found, however unequal the two are."""
    rng = random.Random(4)
    long = [f"v{rng.randrange(10**6)}" for _ in range(20_000)]
    parts = [" ".join(long[k : k + 40]) for k in range(0, 4000, 40)]
    rows = spark.createDataFrame([(p, " ".join(long)) for p in parts], "x string, y string")
    got = [r.c for r in rows.select(sketch.containment(sketch.sketch(F.col("x")), sketch.sketch(F.col("y"))).alias("c")).collect()]
    assert got == [1.0] * len(parts)


def test_next_rows_without_ids(spark):
    rows = [(k if k % 3 else None, f"text {k}") for k in range(60)] + [(5, "text 5"), (None, "text 0")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    out = sketch.with_next(docs, "doc_id", "text", lambda d: d.withColumn("size", F.length("text")), ["text", "size"]).collect()
    assert len(out) == len(rows) and all(r.next_size == len(r.next_text) for r in out)
    assert sorted(r.text for r in out) == sorted(r.next_text for r in out)  # a ring
    named = sorted({(r.doc_id, r.next_text) for r in out if r.doc_id is not None and r.doc_id not in (1, 5, 7)})
    assert named == [(k, f"text {k - 1 if (k - 1) % 3 else k - 2}") for k in range(60) if k % 3 and k not in (1, 5, 7)]


def test_pieces():
    sentencepiece = pytest.importorskip("sentencepiece")
    path = tokenizer_path("piece_bpe_32k.model")
    library, own = sentencepiece.SentencePieceProcessor(model_file=path), pieces.Encoder(path)
    rng = random.Random(1)
    letters = " \n\t▁ab.éthe日😀\x00<s>0x0A,ñ​"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(3000)] + pd.read_parquet(f"{SF}/documents.parquet").text.tolist()[:60] + ["", None, "▁", "\n", "ab" * 5000]
    for text, (ids, decoded, differing) in zip(texts, own.batch(texts), strict=True):
        want = library.encode(text or "")
        assert list(struct.unpack(f"<{len(ids) // 4}i", ids)) == want and decoded == library.decode(want) and differing == 0
    vocabulary = own.vocabulary
    short = sorted({p for t in pd.read_parquet(f"{SF}/documents.parquet").text for p in vocabulary.parts.findall((pieces.MARK + t).replace(" ", pieces.MARK)) if len(p) <= pieces.SHORT})
    assert len(short) > 5000  # the ranked rows and the heap are the same agenda
    for part, found in zip(short, vocabulary.merge_many(short), strict=True):
        want = vocabulary.merge(part)
        assert found == struct.pack(f"<{len(want)}i", *want)
    for part in ("▁the", "▁antidisestablish", "ning", "日本"):
        want = vocabulary.merge(part)
        assert vocabulary.merge_many([part])[0] == struct.pack(f"<{len(want)}i", *want)


def test_pieces_memo_and_differences():
    path = tokenizer_path("piece_bpe_32k.model")
    own = pieces.Encoder(path, memo_bytes=20_000)
    texts = [f"some words {k} and " + "x" * 300_000 * (k == 7) for k in range(2000)]
    list(own.batch(texts))
    assert all(len(p) <= pieces.SHORT for p in (*own.young, *own.old)) and own.size < 200_000
    real = own.vocabulary.merge_many
    own.vocabulary.merge_many = lambda parts: [b"\0\0\0\0" if p.endswith("zebra") else x for p, x in zip(parts, real(parts), strict=True)]
    ids, decoded, differing = next(own.batch(["one zebra and one zebra"]))
    assert decoded == "one zebra and one zebra" and differing == 2 and list(struct.unpack(f"<{len(ids) // 4}i", ids)) == own.library.encode("one zebra and one zebra")


def _phrases(text, source):
    at, phrases = 0, 0
    while at < len(text):
        size = 1
        while at + size < len(text) and text[at : at + size + 1] in source:
            size += 1
        at, phrases = at + size, phrases + 1
    return phrases


def _spelled(text, common):
    """Symbols as characters: common letters, one space for other characters, digits for rare letters."""
    out = ""
    for c in text.lower():
        out += c if c in common else " " if not c.isalpha() else "".join(chr(0xE000 + int(d, 16)) for d in f"{ord(c):0{4 if ord(c) < 0x10000 else 6}x}")
    return re.sub(" +", " ", out)


def test_cross_parsing():
    rng = random.Random(2)
    letters = {"aa": "abcde é", "bb": "cdefgh ", "cc": "".join(chr(0x4E00 + k) for k in range(300)) + "。", "dd": "".join(chr(0x4E00 + k) for k in range(200, 500)) + chr(0x20000)}
    sample = [(lang, "".join(rng.choice(a) for _ in range(n))) for lang, a in letters.items() for n in (150, 700, 90, 60)]
    model = language.Model(sample, chars=1200)
    counts = collections.Counter(c for _, t in sample for c in t.lower() if c.isalpha())
    common = {c for c, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[: language.SYMBOLS - language.FIRST_LETTER]}
    source = {}
    for lang, text in sample:
        text = _spelled(text + " ", common)
        if len(source.get(lang, "")) + len(text) <= 1200:  # whole texts only
            source[lang] = source.get(lang, "") + text
    assert model.langs == sorted(source) and any(len(_spelled(t, common)) > 1200 for _, t in sample)
    texts = ["".join(rng.choice("".join(letters.values()) + "xyz12") for _ in range(n)) for n in (1, 7, 90, 250)] + [t[3:80] for _, t in sample]
    texts = [t for t in texts if len(_spelled(t, common)) <= language.SEGMENT and any(map(str.isalpha, t))]
    got = model.phrases([model.reduce(language._codes(t)) for t in texts])
    want = [[_phrases(_spelled(t, common), source[lang]) for lang in model.langs] for t in texts]
    assert got.tolist() == want
    langs, scores = model.predict([*texts, None, "", "12 。"])
    for row, lang, score in zip(want, langs, scores, strict=False):
        bits = [n * math.log2(len(source[x]) + 2) for n, x in zip(row, model.langs, strict=True)]
        assert lang == model.langs[bits.index(min(bits))] and score == pytest.approx(1 / sum(2 ** max(-60, (min(bits) - b) / 4) for b in bits))
    assert langs[len(texts) :] == ["und"] * 3 and scores[len(texts) :] == [0.0] * 3


def test_language_ties_and_samples():
    same = language.Model([("zz", "alpha beta"), ("yy", "alpha beta")])
    assert same.predict(["alpha"])[0] == ["yy"]
    assert language.Model([]).predict(["alpha"]) == (["und"], [0.0])
    long = language.Model([("aa", "x" * 50), ("aa", "abc"), ("bb", "b")], chars=20)
    assert long.langs == ["aa", "bb"] and long.bits[0] == math.log2(4 + 2)


def test_language_accuracy(spark):
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    got = catalog.queries()["op6_language_id"](spark, SF).toPandas().merge(docs, on="doc_id")
    held = got[got.held_out & (got.n_chars > 100)]
    assert len(held) > 10 and (held.lang_pred == held.lang).mean() >= 0.95


def _plain_targets(sizes):
    """What each source is to give: 5, 2, 1 repeating, three times its size at most, the rest shared again."""
    weight = dict(zip(sizes.index, [5, 2, 1] * len(sizes), strict=False))
    target, total = {}, float(sizes.sum())
    while True:
        free = [s for s in sizes.index if s not in target]
        left = total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return target | share
        target |= {s: 3.0 * sizes[s] for s in over}


def test_mix(spark):
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    got = catalog.queries()["op7_mix_sources"](spark, SF).toPandas().merge(docs, on="doc_id")
    target = _plain_targets(got.groupby("source")["size"].sum().sort_index())
    for s, part in got.groupby("source"):
        assert part.target.iloc[0] == pytest.approx(target[s]) and abs(part.taken.sum() - target[s]) <= part["size"].max()
    assert (got.taken <= 3 * got["size"]).all()


def test_mix_level_with_caps(spark):
    rows = spark.createDataFrame([("sa", 10), ("sb", 1000), ("n", 5), ("sc", 0)], "_key string, size long")
    got = {r._key: r.target for r in mixing.targets(rows).collect()}
    assert got["sa"] == 30 and got["sc"] == 0 and got["n"] == 15 and got["sb"] == pytest.approx(970)


def test_quality_rules_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.execute(quality_rules.ORACLE).df().sort_values("doc_id").reset_index(drop=True)
    got = quality_rules.op8_quality_rules(spark, SF).toPandas().sort_values("doc_id").reset_index(drop=True)
    assert (got == want[got.columns]).all().all()


def test_ablations(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, "x y " * 30), (3, None)], "doc_id long, text string")
    rows = {(r.policy, r.rule): (r.failed, r.only) for r in quality_rules.ablations(quality_rules.ledger(docs)).collect()}
    assert rows["base", "few_words"] == (2, 2) and rows["base", "repeated_words"] == (1, 1)


def test_mined_rules(spark):
    urls = [(f"http://{h}.example.com/{s}/{k}", h == "bad-site" and s == "x") for k in range(40) for h in ("bad-site", "good-site") for s in ("x", "y")]
    labelled = spark.createDataFrame(urls, "url string, bad boolean")
    rules = {frozenset(r["items"]) for r in url_rules.mine(labelled, 0.05, 0.8).collect()}
    assert frozenset({"-bad", "/x"}) in rules and not any(r <= {"/x", ".com", ".example"} or r <= {"-bad", ".bad-site", ".com"} for r in rules)
    pages = spark.createDataFrame([(1, "http://www.bad-site.example.com/x/9?q=1"), (2, "http://bad-site.example.com/z"), (3, "http://good-site.example.com/x"), (4, "http://a.example.com/en/7x")], "page_id long, url string")
    got = {r.page_id: (r.verdict, r.rule) for r in url_rules.judged(pages, labelled, min_support=0.05, min_confidence=0.8).collect()}
    assert got == {1: ("block", None), 2: ("allow", None), 3: ("allow", None), 4: ("allow", "example.com/en/7")}


def _plain_tokens(url):
    host, path, rest = re.match(r"(?s).*?://([^/?#]*)([^?#]*)(.*)", url).groups()
    host = host.lower()
    labels = host.split(".")
    out = ["." + x for x in labels if x] + ["-" + x for label in labels if "-" in label for x in label.split("-") if x]
    out += ["/" + x for x in (re.sub("[0-9]+", "0", y) for y in re.split("[/.]", path)) if x not in ("", "0")]
    return frozenset(out + ["?" + x for x in re.findall(r"[?&]([^=&#]+)", rest)])


def _plain_rules(labelled, least, sure):
    """Every combination of tokens that occurs, counted; the bad ones among them."""
    hits, seen = collections.Counter(), collections.Counter()
    for url, bad in labelled:
        tokens = sorted(_plain_tokens(url))
        for mask in range(1, 1 << len(tokens)):
            items = frozenset(t for k, t in enumerate(tokens) if mask >> k & 1)
            seen[items] += 1
            hits[items] += bad
    n, z, rules = len(labelled), 1.96, {}
    for items, freq in seen.items():
        p = hits[items] / freq
        low = (p + z * z / 2 / freq - z * math.sqrt(p * (1 - p) / freq + z * z / 4 / freq / freq)) / (1 + z * z / freq)
        if hits[items] >= math.ceil(n * least) and low >= sure:
            rules[items] = (p, hits[items] / n)
    return rules


def test_url_verdicts_by_a_plain_miner(spark):
    rng = random.Random(12)

    def url(k):
        host = rng.choice(("cheap-pills", "news", "blog-spot", "shop")) + rng.choice((".example.com", ".example.org", ".Test.NET"))
        return f"http://{host}/{rng.choice(('en', 'de', 'win', 'free'))}/{rng.randrange(30)}{rng.choice(('', '?ref=x', '?page=2&ref=y'))}"

    urls = [url(k) for k in range(900)]
    bad = lambda u: ("pills" in u or "/win/" in u and "?ref" in u) and rng.random() < 0.95 or rng.random() < 0.1
    labelled = [(u, bad(u)) for u in urls[:600]]
    rules = _plain_rules(labelled, 0.01, 0.5)
    assert len(rules) > 10
    want = {}
    for k, u in enumerate(urls[300:]):  # labelled and held-out ones
        fit = [(c, s, " ".join(sorted(r))) for r, (c, s) in rules.items() if r <= _plain_tokens(u)]
        want[k] = ("block", *max(fit)[:2]) if fit else ("allow", None, None)
    pages = spark.createDataFrame(list(enumerate(urls[300:])), "page_id long, url string")
    got = {r.page_id: (r.verdict, r.confidence, r.support) for r in url_rules.judged(pages, spark.createDataFrame(labelled, "url string, bad boolean"), rules=(), min_support=0.01, min_confidence=0.5).collect()}
    for k, (verdict, confidence, support) in want.items():
        assert got[k][0] == verdict and (confidence is None or (got[k][1], got[k][2]) == pytest.approx((confidence, support)))
    held = [(got[k][0] == "block", "pills" in u or "/win/" in u and "?ref" in u) for k, u in enumerate(urls[300:]) if k >= 300]
    assert sum(x == y for x, y in held) >= 0.95 * len(held)  # rules found on labels hold on other URLs


def test_no_rules_by_chance(spark):
    rng = random.Random(13)
    labelled = [(f"http://{rng.choice('abcd')}.example.com/{rng.choice(('en', 'de'))}/{k}", rng.random() < 0.2) for k in range(1500)]
    assert url_rules.mine(spark.createDataFrame(labelled, "url string, bad boolean")).count() == 0


def test_wrapper_without_marks(spark):
    page = "<html><body><div class=top><a href=/>Home</a> <a href=/x>X</a></div><div id=c><h2>T%d</h2><p>Body %d text &lt; more<br>here</p><div>Read our shop</div></div><div class=sidebar>s%d</div><p>Copyright us</p></body></html>"
    rows = [(k, f"http://h.example.com/{k}", page % (k, k * 7, k)) for k in range(12)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    got = {r.page_id: r.text for r in extraction.extracted(pages).collect()}
    assert got == {k: f"T{k}\n\nBody {k * 7} text < more here" for k in range(12)}
    assert spark.createDataFrame(rows, "page_id long, url string, html string").select(F.lit("h").alias("host"), "url", "html").transform(extraction.wrappers).count() == 1


def _tree(rng, depth=4):
    children = [] if not depth else [_tree(rng, depth - 1) for _ in range(rng.randrange(5))]
    return [rng.choice("ab"), 1, 0, "", 0, 0, False, False, children]


def _plain_match(a, b):
    if a[0] != b[0]:
        return 0
    x, y = a[extraction.CHILDREN], b[extraction.CHILDREN]
    rows = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(len(x)):
        for j in range(len(y)):
            rows[i + 1][j + 1] = max(rows[i][j + 1], rows[i + 1][j], rows[i][j] + _plain_match(x[i], y[j]))
    return 1 + rows[-1][-1]


def test_tree_matching():
    tree = lambda h: extraction.as_wrapper(extraction.parse(h))
    a, b = tree("<div><h1>a</h1><p>b</p><ul><li>c</li></ul></div>"), tree("<div><h1>x</h1><ul><li>y</li></ul></div>")
    assert extraction.match(a, a) == 6 and extraction.match(a, b) == 5
    rng = random.Random(6)
    for _ in range(150):
        a, b = _tree(rng), _tree(rng)
        assert extraction.match(a, b) == _plain_match(a, b)
        x, y = a[extraction.CHILDREN], b[extraction.CHILDREN]
        if x and y:  # the alignment is ordered and as heavy as the matching says
            found = extraction._best(extraction._weights(x, y))
            assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(found, found[1:], strict=False))
            assert sum(_plain_match(x[i], y[j]) for i, j in found) == _plain_match(["t", *a[1:]], ["t", *b[1:]]) - 1


def test_wide_trees():
    node = lambda tag, children=(): [tag, 1, 0, "", 0, 0, False, False, list(children)]
    wide = [node("dt" if k % 2 else "dd", [node("b")] * (k % 3)) for k in range(1500)]
    assert extraction.match(node("dl", wide), node("dl", wide)) == 1 + sum(1 + k % 3 for k in range(1500))
    assert extraction._pairs(wide, wide[3:])[-1] == (1499, 1496)


@pytest.mark.parametrize("piece", ["<a '", '<p class="x', "<", "</", "<b>", "<div><p>", "</x>", "<a href='y'>t</a>", "<!-", "<x><article><b>", "<li><b>", "<br", "&#"])
def test_broken_pages_take_linear_time(piece):
    import time

    page = piece * (1_000_000 // len(piece))
    began = time.process_time()
    for html in (page, page + ">", "<p>one</p>" + page):
        extraction.extract(html, None)
    assert time.process_time() - began < 15  # three pages of a megabyte; a square would take hours


def test_deep_pages_lose_no_text():
    html = "".join(f"<div>t{k}" for k in range(1000)) + "".join(f"</div>u{k}" for k in range(1000))
    found = extraction.blocks(extraction.parse(html))
    assert sorted(re.findall("[tu][0-9]+", " ".join(found))) == sorted(f"{c}{k}" for c in "tu" for k in range(1000))
    pages = [extraction.as_wrapper(extraction.parse(html.replace("t7", f"v{k}"))) for k in range(4)]
    assert extraction.fold(pages)[extraction.SEEN] == 4


def _wrapper(pages):
    return extraction.Wrapper(extraction.fold(map(extraction.as_wrapper, map(extraction.parse, pages))))


def test_alignment_decides_where_marks_are_absent_or_wrong():
    rng = random.Random(8)
    voc = [f"w{k}" for k in range(500)]
    say = lambda n: " ".join(rng.choice(voc) for _ in range(n))

    def page(k, outer, inner):
        body = "".join(f"<p>{say(20)}</p>" for _ in range(rng.randrange(2, 6)))
        html = f"<body><div {outer}><a href=/{k}>{say(1)}</a><a href=/x{k}>{say(1)}</a></div><div {outer}>{say(6)}</div><div {inner}><h1>{say(4)}</h1>{body}<div>Read our shop</div></div><div {outer}>{say(5)}</div></body>"
        text = [re.sub("<[^>]*>", "", x) for x in re.findall(r"<(?:h1|p)>.*?(?=</)", html)]
        return html, "\n\n".join(text)

    for outer, inner in (("", ""), ("class=x", "class=sidebar"), ("role=main", ""), ("class=ad", "role=main")):
        made = [page(k, outer, inner) for k in range(12)]
        wrapper = _wrapper([html for html, _ in made])
        assert [extraction.extract(html, wrapper) for html, _ in made] == [text for _, text in made], (outer, inner)
        alone = [extraction.extract(html, None) == text for html, text in made]
        assert not any(alone), (outer, inner)  # the constant block alone makes marks fall short


def test_wrappers_agree_with_marks_on_tables():
    """On the tables' pages, whose marks are right, the wrapper finds the same text from the marks' absence."""
    pages = pd.read_parquet(f"{SF.replace('sf0.001', 'sf0.01')}/pages.parquet")
    host = pages.url.fillna("").str.extract("://([^/?#]*)")[0].str.lower()
    bare = lambda h: re.sub(r"(</?)(?:article|nav|footer)\b", r"\1div", h).replace(' class="ad"', "")
    same = total = without = 0
    for _, part in pages.groupby(host):
        if len(part) < 6:
            continue
        wrapper = _wrapper(map(bare, part.html))
        for html in part.html:
            want = extraction.extract(html, None)
            same += extraction.extract(bare(html), wrapper) == want
            without += extraction.extract(bare(html), None) == want
            total += 1
    assert total > 60 and same >= 0.97 * total and without < same


def test_wrappers_do_not_depend_on_the_layout(spark):
    rng = random.Random(3)
    bits = ["<p>a</p>", "<div><h2>b</h2></div>", "<ul><li>c</li></ul>", "<section><p>d</p><hr></section>", "<table><tr><td>e</td></tr></table>"]
    rows = [("h", f"u{k}", "".join(rng.choices(bits, k=rng.randrange(1, 6)))) for k in range(120)]
    found = {extraction.wrappers(spark.createDataFrame(rows, "host string, url string, html string").repartition(n), fan=8).first().wrapper for n in (1, 5)}
    assert len(found) == 1


def test_article_pages():
    html = '<nav><a>m</a></nav><article><header><h1>H &amp; I</h1></header><p>One<p>Two <b>bold</b>\n end<aside>skip</aside><div class="comments"><p>no</p></div><form>f</form><script>var a="</p>"</script></article><footer>f</footer>'
    assert extraction.extract(html, None) == "H & I\n\nOne\n\nTwo bold end"


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def _alike(a, b):
    n = max(len(a), len(b))
    if (collections.Counter(a) - collections.Counter(b)).total() > 0.2 * n + 1e-9 or (collections.Counter(b) - collections.Counter(a)).total() > 0.2 * n + 1e-9:
        return False  # more words are missing than edits are allowed
    return a == b or (abs(len(a) - len(b)) <= 0.2 * n and _edits(a, b) <= 0.2 * n + 1e-9)


def _deduplicated_lines(texts):
    """What is left of texts, by holding every line against every other."""
    places = [(k, at, tuple(line.lower().split())) for k, text in enumerate(texts) for at, line in enumerate(text.split("\n"))]
    kinds = sorted({w for _, _, w in places if w})
    root = _union(len(kinds), [(a, b) for a in range(len(kinds)) for b in range(a) if _alike(kinds[a], kinds[b])])
    group = {w: root[k] for k, w in enumerate(kinds)}
    seen, out = set(), [[] for _ in texts]
    for k, at, w in places:
        if not w or group[w] not in seen:
            out[k].append(texts[k].split("\n")[at])
        if w:
            seen.add(group[w])
    return ["\n".join(x) for x in out]


def _line_variants(rng, n, edits, voc):
    words = [rng.choice(voc) for _ in range(n)]
    other = list(words)
    for at in rng.sample(range(n), edits):
        other[at] = rng.choice(voc)
    if n > 30 and rng.random() < 0.3:
        del other[rng.randrange(n)]
    return " ".join(words), " ".join(other).capitalize()


@pytest.mark.parametrize("large", [64, 2])
def test_fuzzy_lines(spark, monkeypatch, large):
    monkeypatch.setattr(lines, "OPEN", large)  # the smaller bound divides nearly all blocks
    rng = random.Random(7)
    voc = ["".join(rng.choice(("an", "ber", "ti", "on", "eau", "sch", "the", "o")) for _ in range(rng.choice((1, 1, 2, 3, 4)))) for _ in range(3000)]
    texts = []
    for n, edits in ((8, 0), (8, 1), (20, 1), (20, 3), (60, 1), (60, 6), (12, 3), (60, 20), (3, 0), (5, 1)):
        for _ in range(4):
            a, b = _line_variants(rng, n, edits, voc)
            texts += [f"{a}\n\nshort line", f"{b}\n{a.upper()}"]
    template = [rng.choice(voc) for _ in range(7)]  # lines that share most words and yet are not alike
    texts += [" ".join([*template, *(f"{rng.choice(voc)}{k}" for _ in range(5))]) for k in range(40)]
    texts += ["la la la la la", "la la la la lo", "  The\tSame  words again and again\nthe same words again and AGAIN"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.text for r in lines.deduplicated(docs).collect()}
    want = _deduplicated_lines(texts)
    assert [k for k in range(len(texts)) if got[k] != want[k]] == []


def test_lines_of_much_the_same_words_meet_once(spark, monkeypatch):
    """Lines of a large block that share most words, but in another order: only such as can be alike leave the join, each pair once."""
    rng, made, real = random.Random(11), [], blocks.pairs

    def counted(rows, fits=None, main=False):
        out = real(rows, fits, main)
        made.extend([] if main else [out.count()])
        return out

    monkeypatch.setattr(blocks, "pairs", counted)
    base, voc = [f"w{k % 60}" for k in range(77)], [f"x{k}" for k in range(200)]
    texts = []
    for _ in range(150):
        line = [rng.choice(voc) if rng.random() < 0.2 else w for w in base]
        texts.append(rng.sample(line, len(line)) + [c * 28 for c in "pqr"])
    for k in range(10):
        texts.append(texts[k][:40] + ["other"] * 8 + texts[k][48:])  # as many edits as two lines of 80 words may have are 16
        texts.append(texts[k][:20] + ["else"] * 8 + texts[k][28:])
    texts = [" ".join(t) for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.text for r in lines.deduplicated(docs).collect()}
    assert [got[k] for k in range(len(texts))] == _deduplicated_lines(texts)
    assert made and sum(made) <= 2 * len(texts)


def test_numbered_words(spark):
    rows = spark.createDataFrame([([5, 7, 5, 5],), ([5, 5, 7],), ([7],), ([],), ([3] * 40,)], "w array<int>").select(lines._numbered(F.col("w")).alias("n")).collect()
    a, b, c, d, e = (set(r.n) for r in rows)
    assert len(a) == 4 and b < a and c < b and not d and len(e) == lines.REPEATS


def test_line_recall_on_tables(spark):
    """Of the lines that brute force would remove from a table, over 0.98 go, and no other."""
    docs = pd.read_parquet(f"{SF}/documents.parquet").sort_values("doc_id")
    texts = [" ".join(t.split(" ")) if t else "" for t in docs.text]
    short = [k for k, t in enumerate(texts) if len(t) < 12_000]
    rows = spark.createDataFrame([(k, texts[k]) for k in short], "doc_id long, text string")
    got = {r.doc_id: r for r in lines.deduplicated(rows).collect()}
    want = _deduplicated_lines_by_prefix([texts[k] for k in short])
    missed = sum(got[k].text != w for k, w in zip(short, want, strict=True))
    assert missed <= 0.02 * sum(texts[k] != w for k, w in zip(short, want, strict=True))


def _deduplicated_lines_by_prefix(texts):
    """As _deduplicated_lines; only lines that share a word of their rarest fifth, which all alike ones do, are compared."""
    places = [(k, at, tuple(line.lower().split())) for k, text in enumerate(texts) for at, line in enumerate(text.split("\n"))]
    kinds = sorted({w for _, _, w in places if w})
    many = collections.Counter(x for w in kinds for x in set(w))
    where, pairs = collections.defaultdict(list), set()
    for k, w in enumerate(kinds):
        for x in sorted(set(w), key=lambda x: (many[x], x))[: len(w) // 4 + 1]:
            pairs |= {(k, j) for j in where[x]}
            where[x].append(k)
    root = _union(len(kinds), [(a, b) for a, b in pairs if _alike(kinds[a], kinds[b])])
    group = {w: root[k] for k, w in enumerate(kinds)}
    seen, out = set(), [[] for _ in texts]
    for k, at, w in places:
        if not w or group[w] not in seen:
            out[k].append(texts[k].split("\n")[at])
        if w:
            seen.add(group[w])
    return ["\n".join(x) for x in out]


def test_pipeline_stages_by_plain_versions(spark, tmp_path):
    """Every stage of the pipeline on its own input, held against a plain version of what it does."""
    out, docs = {}, spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        out[name] = pd.read_parquet(f"{tmp_path}/{name}").sort_values("doc_id", kind="stable").reset_index(drop=True)
    raw = pd.read_parquet(f"{SF}/documents.parquet")
    assert sorted(out["language_id"].doc_id) == sorted(i for i, t in zip(raw.doc_id, raw.text, strict=True) if any(map(str.isalpha, t or "")))
    assert out["line_dedup"].text.tolist() == _deduplicated_lines_by_prefix(out["language_id"].text.tolist())
    texts = [" ".join(t.lower().split()) for t in out["line_dedup"].text]
    grams = [{tuple(w[i : i + 5]) for w in [t.split()] for i in range(max(1, len(w) - 4))} if t else {0} for t in texts]
    root = _union(len(texts), [(a, b) for a in range(len(texts)) for b in range(a) if len(grams[a] & grams[b]) >= 0.8 * len(grams[a] | grams[b])])
    assert out["near_dedup"].doc_id.tolist() == [out["line_dedup"].doc_id[k] for k in sorted(set(root))]
    before, after = out["near_dedup"], out["mix_sources"]
    size = before.text.map(lambda t: len(t.split()))
    taken = after.doc_id.value_counts()
    assert set(after.doc_id) <= set(before.doc_id) and taken.max() <= 3
    own = size.groupby(before.source).sum().sort_index()
    want = _plain_targets(own)
    for source, part in after.groupby("source"):
        assert abs(part.text.map(lambda t: len(t.split())).sum() - want[source]) <= size.max()
    library = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    text = dict(zip(after.doc_id, after.text, strict=True))
    assert sorted(out["encode"].doc_id) == sorted(after.doc_id)
    for row in out["encode"].itertuples():
        ids = library.encode(text[row.doc_id])
        assert list(row.ids) == ids and row.n_tokens == len(ids) and row.decoded == library.decode(ids)


def test_part_simhash(spark):
    row = spark.range(1).select(*[lines.part_simhash(*[F.xxhash64(F.lit(w)) for w in ws]).alias(str(k)) for k, ws in enumerate(("a", "ab", "abc"))], *[F.xxhash64(F.lit(w)).alias(w) for w in "abc"]).first()
    h = [row[w] & (1 << 64) - 1 for w in "abc"]
    for n in (1, 2, 3):
        assert row[n - 1] & (1 << 64) - 1 == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h[:n]) > n)


def _plain_text_view(text):
    """Character-class pairs, figures, words and pairs of words, counted one by one."""
    text = text or ""
    out = [0.0] * cotraining.TEXT
    if not text:
        return out
    kind = lambda c: 2 if c == "\n" else 1 if c.isspace() else 4 if c.isupper() else 3 if c.isalpha() else 5 if c.isdigit() else 6 + cotraining.MARKS.index(c) if c in cotraining.MARKS else 0
    size = cotraining.CLASSES**2
    for (a, b), n in collections.Counter(zip(map(kind, text), map(kind, text[1:]), strict=False)).items():
        out[a * cotraining.CLASSES + b] = math.sqrt(n / max(1, len(text) - 1))
    words, lines_ = text.split(), text.split("\n")
    n = len(words)
    out[size : size + 6] = [math.log1p(n) / 5, len(set(words)) / max(1, n), len(set(zip(words, words[1:], words[2:], strict=False))) / max(1, n - 2), len(set(lines_)) / len(lines_), (len(text) - n) / max(1, n) / 10, min(n, 20) / 20]
    code = lambda w: zlib.crc32(w.lower().encode())
    for k, m in collections.Counter(code(w) % cotraining.WORD_BUCKETS for w in words).items():
        out[size + 6 + k] = math.sqrt(m / n)
    pairs = collections.Counter(((code(a) * 2654435761 + code(b)) % 2**32 >> 8) % cotraining.PAIR_BUCKETS for a, b in zip(words, words[1:], strict=False))
    for k, m in pairs.items():
        out[size + 6 + cotraining.WORD_BUCKETS + k] = math.sqrt(m / (n - 1))
    return out


def test_text_view():
    texts = [t for t in pd.read_parquet(f"{SF}/documents.parquet").text if len(t) < 5000][:40] + ["", None, " \n ", "one", "One two", "é#1\n" * 9]
    for text in texts:
        assert np.allclose(cotraining.text_view(text), _plain_text_view(text), atol=1e-6)


def test_quality_scores_by_a_plain_run(spark):
    """Every score of the query, from views and fits on the driver over the whole tables."""
    docs, labels = (pd.read_parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    quality = labels.dropna(subset=["doc_id", "quality"]).drop_duplicates(["doc_id", "quality"]).set_index("doc_id").quality
    docs = docs.assign(quality=docs.doc_id.map(quality), place=docs.doc_id * 2654435761 % 2**32).sort_values("place")
    view = np.array([_plain_text_view(t) for t in docs.text], np.float32)
    meta = np.zeros((len(docs), cotraining.META), np.float32)
    for k, row in enumerate(zip(docs.source, docs.lang, docs.n_chars, strict=True)):
        meta[k, cotraining.meta_view(*row)] = 1
    has = docs.quality.notna().to_numpy()
    label = (docs.quality[has] > 0).astype(int).to_numpy()
    model = cotraining.CoTrained(view[has], meta[has], label, view[~has], meta[~has])
    want = dict(zip(docs.doc_id, model(view, meta)[0], strict=True))
    got = catalog.queries()["op9_quality_classifier"](spark, SF).collect()
    assert len(got) == len(docs) and all(abs(r.score - want[r.doc_id]) < 1e-3 for r in got)


def test_co_training_exchanges_labels_and_survives_ties():
    rng = np.random.default_rng(1)
    label = rng.integers(0, 2, 400)
    text, meta = (np.hstack([label[:, None] + 0.3 * rng.normal(size=(400, 1)), rng.normal(size=(400, 3))]).astype(np.float32) for _ in range(2))
    few = np.arange(400) < 40
    model = cotraining.CoTrained(text[few], meta[few], label[few], text[~few], meta[~few], per_round=60)
    assert min(model.exchanged) > 50
    assert ((model(text[~few], meta[~few])[0] >= 0.5) == label[~few]).mean() > 0.95
    same = cotraining.CoTrained(np.ones((20, 4)), np.ones((20, 4)), np.arange(20) % 2, np.ones((9, 4)), np.ones((9, 4)))
    assert np.allclose(same(np.ones((3, 4)), np.ones((3, 4)))[0], 0.5, atol=0.1)


def test_quality_accuracy(spark):
    folder = SF.replace("sf0.001", "sf0.01")
    got = catalog.queries()["op9_quality_classifier"](spark, folder).toPandas().merge(pd.read_parquet(f"{folder}/labels.parquet"), on="doc_id")
    assert (got.kept == (got.quality == 1)).mean() >= 0.95
