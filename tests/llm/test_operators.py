"""The training-data operators against brute force, round trips and held-out rows."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from echofold.llm import catalog, chat, exact_dedup, importance, langid, mixing, name_join, near_dedup, packing, quality, quality_model, textvec, toxicity, url_filters, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOC = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "lorem ipsum dolor sit amet " * 4000


def lower(t):
    return (t or "").translate({c: c + 32 for c in range(65, 91)})


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, an extra column."""
    rows = [
        (1, "The cat and the dog. " * 5, "en", "a", 5), (2, "the CAT and the dog. " * 5, "en", "a", 5), (2, "the CAT and the dog. " * 5, "en", "a", 5), (3, None, None, None, None),
        (None, "", "de", "b", 0), (4, "", None, "b", 0), (None, "the cat and the dog. " * 5, "fr", None, 1), (5, LONG, "en", "c", 1), (6, "12 34 !!", "xx", "c", 8), (7, "eins zwei", "de", "b", 9), (7, "drei vier fünf sechs sieben", "de", "b", 9),
    ]
    return spark.createDataFrame(rows, DOC).withColumn("kept", F.lit("x")).withColumn("score", F.lit(1))


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOC)


def shingles(text):
    w = WORD.findall(lower(text))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def classes(docs):
    """Brute force over all pairs: (id, set size, smallest id reachable)."""
    sets, parent = [shingles(t) for _, t in docs], list(range(len(docs)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 4 * both >= 3 * (len(sets[i]) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    least = collections.defaultdict(list)
    for i, (d, _) in enumerate(docs):
        least[root(i)].append(d)
    return sorted((d, len(sets[i]), min(least[root(i)])) for i, (d, _) in enumerate(docs))


def family(seed=3):
    """Near copies of a base with many differing edits, so that few reach each other directly."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    docs = [" ".join(base)]
    for k in range(160):
        own = list(base)
        for p in rng.sample(range(120), 1 + k % 7):
            own[p] = f"x{rng.randrange(10**6)}"
        docs.append(" ".join(own))
    docs += [" ".join(f"y{rng.randrange(10**6)}" for _ in range(60)) + " " + " ".join(base[:20]) for _ in range(40)]
    docs += docs[:30]
    rng.shuffle(docs)
    return list(enumerate(docs))


def test_near_dedup_equals_brute_force(spark, sf):
    given = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    found = near_dedup.link(spark.createDataFrame(given, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found) == classes(given)


@pytest.mark.parametrize("small", [0, 48])
def test_near_dedup_of_a_large_family(spark, monkeypatch, small):
    monkeypatch.setattr(near_dedup, "SMALL", small)
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    monkeypatch.setattr(near_dedup, "BROADCAST_TEXTS", 0 if small else 1000)
    given = family()
    found = near_dedup.link(spark.createDataFrame(given, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found) == classes(given)


def test_near_dedup_odd_rows(odd, none):
    got = near_dedup.link(odd).collect()
    assert len(got) == odd.count()
    assert {r.component_id for r in got if r.doc_id in (1, 2)} == {1}
    assert all(r.n_shingles == 0 and r.component_id == r.doc_id for r in got if r.doc_id in (3, 4))
    assert set(near_dedup.deduplicate(odd).columns) == set(odd.columns)
    assert near_dedup.link(none).count() == 0


def test_near_dedup_decides_by_row(spark, odd):
    got = near_dedup.deduplicate(odd).collect()
    cat = [r.doc_id for r in got if lower(r.text).startswith("the cat")]
    assert cat == [1]
    assert sorted((str(r.doc_id), lower(r.text)[:5]) for r in got) == sorted([("1", "the c"), ("3", ""), ("None", ""), ("4", ""), ("5", "lorem"), ("6", "12 34"), ("7", "eins "), ("7", "drei ")])
    base = " ".join(f"w{i}" for i in range(60))
    reused = [(3, base), (5, f"{base} end"), (5, "another text of six whole words"), (None, f"{base} stop"), (None, "alone in its own small group")]
    got = near_dedup.deduplicate(spark.createDataFrame(reused, "doc_id long, text string")).collect()
    assert sorted(r.text for r in got) == sorted(reused[k][1] for k in (0, 2, 4))


def test_estimate_is_close_to_the_true_similarity():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 400, dtype=np.uint64)
    b = np.concatenate((a[:320], rng.integers(0, 2**63, 80, dtype=np.uint64)))
    m = near_dedup._minima(np.concatenate((a, b)), np.array([0, 400]))
    x = (m[:, 0] & 15) == (m[:, 1] & 15)
    assert abs((x.mean() - 1 / 16) / (15 / 16) - 320 / 480) < 0.12


@pytest.mark.parametrize("name", catalog.ORACLES)
def test_query_equals_sql(agree, name):
    agree(catalog.QUERIES[name], catalog.ORACLES[name])


def test_exact_dedup_odd_rows(odd, none):
    rows = exact_dedup.assign(odd, keep="max").collect()
    assert len(rows) == odd.count() and {r.keep_id for r in rows if r.text_sha256 == hashlib.sha256(lower("The cat and the dog. " * 5).encode()).hexdigest()} == {2}
    assert exact_dedup.deduplicate(odd.drop("kept", "score"), keep="max").where("text is null or text = ''").count() == 1
    assert exact_dedup.assign(none).count() == 0


@pytest.mark.parametrize("keep, ids", [("max", [2, 4, 5, 6, 7, 7]), ("min", [1, 3, 5, 6, 7, 7])])
def test_exact_dedup_leaves_one_row_of_a_text(odd, keep, ids):
    rows = exact_dedup.deduplicate(odd, keep=keep)
    assert rows.columns == odd.columns
    assert sorted(r.doc_id for r in rows.collect()) == ids
    nameless = odd.withColumn("doc_id", F.lit(None).cast("long"))
    assert sorted(lower(r.text) for r in exact_dedup.deduplicate(nameless, keep=keep).collect()) == sorted({lower(r.text) for r in odd.collect()})


def by_hand(text):
    w = WORD.findall(text or "")
    runs = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    marked = {i + k for i in range(len(w) - 4) if runs[tuple(w[i : i + 5])] > 1 for k in range(5)}
    lines, seen, dups = (text or "").split("\n"), set(), 0
    for x in lines:
        if WORD.search(x):
            dups += x in seen
            seen.add(x)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dups, len(marked)


def test_quality_measures_by_hand(spark, sf, odd):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(odd.select("doc_id", "text")).unionByName(spark.createDataFrame([(900, "a b a b a b a b a b a b a b"), (901, "x\n\nx\n \nx y ü"), (902, "a b c d e f a b c d e")], "doc_id long, text string"))
    for r in quality.apply(docs).collect():
        want = by_hand(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0]) and not (r.base_failed and r.kept)


def test_quality_keeps_the_good_and_is_native(spark):
    d = "/root/testdata/sf0.01"
    got = quality.apply(spark.read.parquet(f"{d}/documents.parquet")).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id")
    good, bad = got.where("quality = 1 and not base_failed"), got.where("quality = 0 and not base_failed")
    assert good.where("kept").count() >= 0.99 * good.count() and bad.where("kept").count() <= 0.2 * bad.count()
    assert not re.search("Python|Arrow|Pandas", got._jdf.queryExecution().executedPlan().toString())


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = catalog.op1_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.97 * len(got) and all(0 <= r.score <= 1 for r in got)


def test_language_gradients():
    rng = np.random.default_rng(0)
    net = langid.fit([("", "ab cd"), ("", "xy zz")] * 4, ["p", "q"] * 4, steps=1, hidden=3)
    w = {k: v.astype(np.float64) for k, v in net.weights.items()}
    x, y, inside = rng.integers(0, 40, (8, 5)), np.array([0, 1, 1, 0, 1]), np.ones((8, 5))
    inside[:2, 0] = inside[7:, 1] = 0
    g = langid._gradients(w, x, y, inside, 1)

    def loss():
        p = langid._softmax(w["Of"] @ langid._direction(w, "f", x, inside, 1).astype(float) + w["Ob"] @ langid._direction(w, "b", x, inside, 1) + w["o"][:, None])
        return -(np.log(p[:, y, np.arange(5)]) * inside)[1:-1].sum() / inside[1:-1].sum()

    for k in ("Uf", "Vb", "Of", "o", "Ub", "Vf"):
        i = tuple(0 for _ in w[k].shape)
        w[k][i] += 1e-2
        up = loss()
        w[k][i] -= 2e-2
        down = loss()
        w[k][i] += 1e-2
        assert abs((up - down) / 2e-2 - g[k][i]) < 2e-3


def plain_probabilities(net, text):
    """One byte after the other, by the formulas."""
    w, data = {k: v.astype(float) for k, v in net.weights.items()}, text.encode()
    bend = lambda a: a / (1 + np.abs(a))

    def states(codes, d):
        n, h, out = w[f"V{d}"].shape[0], np.zeros(w[f"V{d}"].shape[0]), []
        for k in codes:
            e = w[f"E{d}"][:, langid._CLASS[k]]
            gates = (1 + bend(w[f"U{d}"] @ h + e[: 2 * n])) / 2
            r, z = gates[:n], gates[n:]
            h = (1 - z) * h + z * bend(w[f"V{d}"] @ (r * h) + e[2 * n :])
            out.append(h)
        return out

    total = np.zeros(len(net.languages))
    for lo in range(0, len(data), langid.WINDOW):
        hi = min(lo + langid.WINDOW, len(data))
        early, late = max(0, lo - langid.MARGIN), min(len(data), hi + langid.MARGIN)
        f, b = states(data[early:hi], "f")[lo - early :], states(data[lo:late][::-1], "b")[::-1]
        for t in range(hi - lo):
            a = w["Of"] @ f[t] + w["Ob"] @ b[t] + w["o"]
            total += np.exp(a - a.max()) / np.exp(a - a.max()).sum()
    return total / max(len(data), 1)


def test_language_of_every_byte(odd):
    import pyarrow as pa

    texts = ["Der Hund läuft über die Straße. " * 9, "the cat", "", "x" * langid.WINDOW, "é" * 100, "El perro y el niño. " * 30]
    windows = [x for t in texts for x in langid.cut(t)]
    net = langid.fit(windows, [str(k % 3) for k in range(len(windows))], steps=5)
    data, offsets = textvec.buffer_of(pa.array(texts))
    got = langid.probabilities(net, data, offsets)
    assert np.allclose(got, [plain_probabilities(net, t) for t in texts], atol=1e-4)


def test_language_margins_agree(spark, monkeypatch, sf):
    """A wider margin changes no prediction, so states need not be carried through whole texts."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("lang is not null")
    net = langid.train(docs)
    rows = docs.select("text").where("length(text) > 400").limit(60).collect()
    import pyarrow as pa

    data, offsets = textvec.buffer_of(pa.array([r.text for r in rows]))
    near = langid.probabilities(net, data, offsets)
    monkeypatch.setattr(langid, "MARGIN", 256)
    far = langid.probabilities(net, data, offsets)
    assert (near.argmax(1) == far.argmax(1)).all() and np.abs(near - far).max() < 0.25


def test_language_sample(spark):
    rows = [(f"eins zwei drei {k}", "de") for k in range(3000)] + [("one and the same", "en")] * 4000 + [("ab " * 40_000, "long")] + [(f"word{k}", f"l{k}") for k in range(80)] + [(None, "xx"), ("12", "yy"), ("abc", None)]
    docs = spark.createDataFrame(rows, "text string, lang string")
    windows, labels = langid.training_sample(docs, "text", "lang", F.lit(True), per_language=50)
    count = collections.Counter(labels)
    assert count["de"] == 50 and count["en"] == 1 and count["long"] == langid.SAMPLE_WINDOWS and len(count) == 83
    assert all(len(a) <= langid.MARGIN and len(b) <= langid.TRAIN_WINDOW + langid.MARGIN for a, b in windows)
    assert langid.training_sample(docs.where("lang = 'long'"), "text", "lang", F.lit(True))[0] == langid.cut("ab " * 40_000)
    assert set(langid.fit(windows, labels, steps=2).languages) == set(labels)
    few = langid.training_sample(docs, "text", "lang", F.lit(True), rows=40)[1]
    assert len(set(few)) == 40


def test_language_odd_rows(odd, none):
    net = langid.train(odd)
    got = {(r.doc_id, r.text): r for r in langid.identify(odd, net).collect()}
    assert all(got[k].lang_pred == "und" and got[k].score == 0 for k in got if not re.search(r"[^\W\d_]", k[1] or ""))
    assert langid.identify(none, langid.train(none)).count() == 0
    assert {r.lang_pred for r in langid.identify(odd, langid.train(none)).collect()} == {"und"}


CLASHES = ("_p", "_letter", "_found", "_h", "_sha", "_id", "_keep", "x_in", "_m", "_salt", "_rules", "_top", "_n", "_copy", "_kept_id", "_kept_key", "_text", "_place", "size", "target", "repeats", "lang_pred", "start", "row", "n_words", "kept_in", "keep_id", "group_size")


def test_clashing_names(odd, spark, sf):
    import corpus_pipeline

    wide = odd.withColumns({c: F.lit(f"own {c}") for c in CLASHES})
    net = langid.train(odd)
    for out, own in (
        (langid.identify(wide, net), {"lang_pred", "score"}), (exact_dedup.assign(wide), {"keep_id", "group_size", "kept", "text_sha256"}), (quality.apply(wide), {"n_words", "kept"}),
        (url_filters.judge(wide.withColumn("fetched_at", F.lit(None).cast("timestamp_ntz")), spark.createDataFrame([], "domain string, action string, since string"), url_col="text"), {"kept"}),
        (toxicity.score(wide, toxicity.fit([])), {"score"}),
    ):
        rows = out.collect()
        assert len(rows) == odd.count()
        assert all(r[c] == f"own {c}" for r in rows for c in CLASHES if c not in own)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, wide, sf).collect()
        assert rows and all(tuple(r.__fields__) == tuple(wide.columns) and all(r[c] == f"own {c}" for c in CLASHES) and r["kept"] == "x" for r in rows)
    assert near_dedup.link(wide).count() == mixing.mix(wide).count() == odd.count() and packing.pack(wide).count() > 0


def filled(sizes, weights, budget=1.5, cap=2.0):
    """Clamp and share again until none is above."""
    total, open_, target = budget * sum(sizes.values()), set(sizes), {}
    while open_:
        share = {s: total * weights[s] / sum(weights[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > cap * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = cap * sizes[s]
            total -= target[s]
        open_ -= over
    return target


def test_mixing(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = mixing.mix(docs).collect()
    sizes = collections.Counter()
    for r in docs.collect():
        sizes[r.source] += len(WORD.findall(r.text or ""))
    order = sorted(s for s in sizes if s is not None) + [s for s in sizes if s is None]
    want = filled(sizes, {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)})
    taken, most = collections.Counter(), collections.Counter()
    for r in got:
        taken[r.source] += r.taken
        most[r.source] = max(most[r.source], r.size)
        assert abs(r.target - want[r.source]) < 1e-6 * want[r.source] and r.taken <= 2 * r.size and r.source_size == sizes[r.source]
    assert all(abs(taken[s] - want[s]) <= most[s] for s in sizes)
    assert sorted(got) == sorted(mixing.mix(docs.repartition(3)).collect())


def test_mixing_odd_rows(odd, none):
    got = mixing.mix(odd).collect()
    assert len(got) == odd.count() and all(0 <= r.taken <= 2 * r.size for r in got)
    assert mixing.mix(none).count() == 0


@pytest.fixture(scope="module")
def reference_ids():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, 1]


def test_packing_round_trip(spark, sf, odd, reference_ids):
    tricky = [(500, "a  b    c　\n\n d's  \t x"), (501, "  lead"), (502, "end  "), (503, "\u0085   y <|endoftext|> é\r\n"), (504, "a" * 5000), (505, "<|endoftext|>"), (506, "x<|endoftext|><|endoftext|>  <|endof"), (507, "text|> y <|endoftext|>z")]
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").where("doc_id >= 140").unionByName(odd.select("doc_id", "text").where("doc_id not in (2, 7)")).unionByName(spark.createDataFrame(tricky, "doc_id long, text string"))
    pieces = collections.defaultdict(list)
    rows = packing.pack(docs).collect()
    for r in rows:
        pieces[r.doc_id].append(r)
        assert r.length == len(r.ids) == 2**r.bucket <= 2048 and r.offset == 0 and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4"))
    assert len({r.sequence_id for r in rows}) == len(rows)
    for d in docs.where("doc_id is not null").collect():
        own = sorted(pieces[d.doc_id], key=lambda r: r.start)
        ids = [i for r in own for i in r.ids]
        assert ids == reference_ids(d.text) and {r.doc_tokens for r in own} == {len(ids)}
        assert [r.length for r in own] == packing.binary_lengths(len(ids), 2048)


def test_packing_empty(none):
    assert packing.pack(none).count() == 0


def test_packing_numbers_copies(spark):
    docs = spark.createDataFrame([(1, "a b c d e")] * 3 + [(None, None)], "doc_id long, text string")
    rows = packing.pack(docs).collect()
    assert len({r.row for r in rows}) == 4
    by = collections.defaultdict(list)
    for r in rows:
        by[r.row].append((r.start, r.length))
    assert sorted(map(sorted, by.values())) == sorted([[(0, 4), (4, 2)]] * 3 + [[(0, 1)]])


def test_packing_a_long_text_in_blocks(monkeypatch, reference_ids):
    monkeypatch.setattr(textvec, "CHUNK", 64)
    rng = random.Random(4)
    text = " ".join(rng.choice(["word", "a" * 300, "ü\u00a0x", "<|endoftext|>", "\n\n", "1234567", "don't", "日本語", ""]) for _ in range(400))
    encoder = packing.Encoder(packing.vocabulary())
    assert [*encoder.whole(np.frombuffer(text.encode(), np.uint8)).tolist(), 1] == reference_ids(text)


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.1"
    got = catalog.op9_toxicity(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").collect()
    toxic, clean = [r for r in got if r.toxic == 1], [r for r in got if r.toxic == 0]
    assert sum(r.predicted for r in toxic) >= 0.75 * len(toxic) and sum(r.predicted for r in clean) <= 0.03 * len(clean)


def test_toxicity_equals_plain_ftrl():
    rng = random.Random(2)
    samples = [(rng.randrange(2), np.array(sorted(rng.sample(range(60), 9)))) for _ in range(200)]
    alpha, beta, l1, l2, bias = 0.5, 1.0, 0.8, 1.0, "bias"
    z, n = collections.defaultdict(float), collections.defaultdict(float)
    ones = sum(y for y, _ in samples)
    weigh = {1: 100 / ones, 0: 100 / (200 - ones)}

    def weight(i):
        a, b = (0, 0) if i == bias else (l1, l2)
        return 0.0 if abs(z[i]) <= a else -(z[i] - np.sign(z[i]) * a) / ((beta + n[i] ** 0.5) / alpha + b)

    for _ in range(3):
        for y, at in samples:
            w = {i: weight(i) for i in [*at.tolist(), bias]}
            g = (1 / (1 + np.exp(-sum(w.values()))) - y) * weigh[y]
            for i in w:
                z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / alpha * w[i]
                n[i] += g * g
    model = toxicity.fit(samples, passes=3, alpha=alpha, beta=beta, l1=l1, l2=l2)
    want = {i: weight(i) for i in range(60) if weight(i)}
    assert model.at.tolist() == sorted(want) and len(want) < 60 and np.allclose(model.weight, [want[i] for i in sorted(want)], atol=1e-5)
    assert abs(model.bias - weight(bias)) < 1e-9


def test_toxicity_sample_is_bounded(spark, monkeypatch):
    docs = spark.createDataFrame([(k, " ".join(f"w{j}" for j in range(50))) for k in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda samples: seen.append(samples))
    monkeypatch.setattr(toxicity, "SAMPLE_PLACES", 500)
    toxicity.train(docs, labels)
    assert collections.Counter(y for y, _ in seen[0]) == {0: 3, 1: 3} and all(sum(len(a) for y, a in seen[0] if y == k) <= 500 for k in (0, 1))


def test_toxicity_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (2, 0), (5, 0), (None, 1), (7, None), (6, 9)], "doc_id long, toxic int")
    model = toxicity.train(odd, labels)
    got = toxicity.score(odd, model).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert toxicity.score(none, toxicity.train(none, labels)).count() == 0


def damaged(pages):
    return [(i, u, h[:-1] + "~" if i % 101 == 7 and h else h) for i, u, h in pages if i % 997 != 13]


def record_hash(i, u, h):
    head = f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:{i}>\r\nWARC-Target-URI: {u or ''}\r\nContent-Type: text/html\r\nContent-Length: {len((h or '').encode())}\r\n\r\n"
    return hashlib.sha256(f"{head}{h or ''}\r\n\r\n".encode()).hexdigest()


@pytest.mark.parametrize("base", [warc.BASE, 2000])
def test_fixity_locates_the_damage(spark, monkeypatch, base):
    monkeypatch.setattr(warc, "BASE", base)
    d = "/root/testdata/sf0.01"
    pages = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{d}/pages.parquet").collect()]
    a, b = ({r[0]: record_hash(*r) for r in rows} for rows in (pages, damaged(pages)))
    want = sorted((i, "missing" if i not in b else "altered", a[i], b.get(i)) for i in a if a[i] != b.get(i))
    got = catalog.op2_merkle_fixity(spark, d).collect()
    assert sorted((r.page_id, r.damage, r.left_hash, r.right_hash) for r in got) == want and len(want) == 4 and all(r.copies == 1 for r in got)
    own = warc.records(spark.read.parquet(f"{d}/pages.parquet"))
    assert warc.audit(own, own).count() == 0


def test_fixity_offsets(spark):
    from echofold.runtime import Scratch

    rows = [(k % 7, "u", f"{k % 50}" * (k % 13)) for k in range(400)] + [(None, "n", "x")] * 5 + [(-3, "m", "y"), (600, None, "z")]
    got = warc.leaves(warc.records(spark.createDataFrame(rows, "page_id long, url string, html string")), Scratch(spark, "t")).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r.file_no].append(r)
    assert len(by) == 4 and sum(r.copies for r in got) == len(rows)
    for own in by.values():
        at = 0
        for r in sorted(own, key=lambda r: (r.page_id is not None, r.page_id, r.hash)):
            assert r.offset == at
            at += r.length * r.copies


def test_fixity_odd_rows(spark):
    kind = "page_id long, url string, html string"
    make = lambda rows: warc.records(spark.createDataFrame(rows, kind))
    rows = [(None, None, None), (None, "u", "h"), (None, "u", "h"), (1, "u", None), (1, "u", None), (1, "u", "b"), (5000, "v", "x" * 300_000), (70_000, "w", ""), (-5, "n", "n")]
    assert warc.audit(make(rows), make(rows[::-1])).count() == 0
    show = lambda a, b: sorted(((r.damage, r.page_id, r.copies) for r in warc.audit(make(a), make(b)).collect()), key=str)
    assert show(rows, [r for r in rows if r[0] != 70_000]) == [("missing", 70_000, 1)]
    assert show(rows, [*rows, (2, "s", "s")]) == [("extra", 2, 1)]
    assert show(rows, [*rows[:2], *rows[3:]]) == [("missing", None, 1)]
    changed = [(1, "u", "c") if r == (1, "u", None) else r for r in rows]
    assert show(rows, changed) == [("altered", 1, 2)]
    assert show(rows, [(None, "u", "hh") if r == (None, "u", "h") else r for r in rows]) == [("extra", None, 2), ("missing", None, 2)]
    assert show(rows, []) == sorted((("missing", i, n) for i, n in ((None, 1), (None, 2), (1, 2), (1, 1), (5000, 1), (70_000, 1), (-5, 1))), key=str)
    assert show([], []) == []


def test_url_filters_as_of(spark):
    captures = spark.createDataFrame([(1, "http://a.bad.com/x", "2024-01-05"), (2, "http://A.BAD.com:80/x", "2024-02-05"), (3, "https://ok.bad.com", "2024-01-20"), (4, None, "2024-01-01"), (5, "http://bad.com/", None), (6, "nohost", "2024-01-09"), (7, "http://bad.com", "2024-01-01"), (7, "http://bad.com", "2024-01-01")], "id int, url string, t string").withColumn("fetched_at", F.to_timestamp_ntz("t")).withColumn("kept", F.lit(9))
    entries = spark.createDataFrame([("bad.com", "block", "2024-01-01"), ("bad.com", "allow", "2024-02-01"), ("ok.bad.com", "allow", "2024-01-10"), (None, "block", "2024-01-01"), ("x", "block", None)], "domain string, action string, since string")
    got = sorted((r.id, r.host, r.matched_domain, r.kept) for r in url_filters.judge(captures, entries).collect())
    assert got == sorted([(1, "a.bad.com", "bad.com", False), (2, "a.bad.com", "bad.com", True), (3, "ok.bad.com", "ok.bad.com", True), (4, None, None, True), (5, "bad.com", None, True), (6, None, None, True), (7, "bad.com", "bad.com", False), (7, "bad.com", "bad.com", False)], key=str) or sorted(got, key=str) == sorted([(1, "a.bad.com", "bad.com", False), (2, "a.bad.com", "bad.com", True), (3, "ok.bad.com", "ok.bad.com", True), (4, None, None, True), (5, "bad.com", None, True), (6, None, None, True), (7, "bad.com", "bad.com", False), (7, "bad.com", "bad.com", False)], key=str)
    assert all(r.kept for r in url_filters.judge(captures, entries.limit(0)).collect())
    assert url_filters.judge(captures.limit(0), entries).count() == 0


def chat_rows(n=700, seed=5):
    rng = random.Random(seed)
    say = lambda: "\n".join(" ".join(rng.choice(["Word", "ja", "no?", "yes."]) for _ in range(rng.randrange(1, 30))) for _ in range(rng.randrange(1, 4)))
    return [(c, t, "user" if t % 2 == 0 else "assistant", say()) for c, length in ((1, n), (2, 5), (3, 1)) for t in range(length)]


CHAT = "conv_id long, turn long, role string, text string"


def line_rows(segments):
    return ["\n".join(chat.raw_line(s.conv_id, t.turn, t.role, t.text) for t in s.turns if t.side == 0) for s in segments]


def test_chat_recovers_roles(spark):
    segments = chat.transcripts(spark.read.parquet("/root/testdata/sf0.01/conversations.parquet"))
    model = chat.train(segments.where("conv_id % 2 = 0"))
    right = total = 0
    for s in segments.where("conv_id % 2 = 1").collect():
        want = []
        for t in s.turns:
            want += [t.role] * len(chat.raw_line(s.conv_id, t.turn, t.role, t.text).split("\n"))
        got = [chat.ROLES[k // 2] for k in chat.viterbi(model, chat.features(line_rows([s])[0].split("\n"))[0])]
        right += sum(a == b for a, b in zip(want, got, strict=True))
        total += len(want)
    assert right >= 0.9 * total


def test_chat_viterbi_equals_all_paths():
    import itertools

    rng = np.random.default_rng(3)
    log = lambda *shape: np.log(rng.dirichlet(np.ones(shape[-1]), shape[:-1]))
    for _ in range(5):
        model = chat.Model(log(6), log(6, 6), [log(6, w) for w in chat._WIDTHS])
        seen = np.stack([rng.integers(0, w, 5) for w in chat._WIDTHS], 1)
        weigh = lambda p: model.start[p[0]] + sum(model.move[a, b] for a, b in zip(p, p[1:], strict=False)) + sum(t[s, x[k]] for s, x in zip(p, seen, strict=True) for k, t in enumerate(model.see))  # noqa: E731,B023
        assert tuple(chat.viterbi(model, seen)) == max(itertools.product(range(6), repeat=5), key=weigh)


def test_chat_counts_equal_plain_counts(spark):
    segments = chat.transcripts(spark.createDataFrame(chat_rows(40), CHAT))
    labelled = []
    for s in segments.collect():
        lines, states = [], []
        for t in s.turns:
            own = chat.raw_line(s.conv_id, t.turn, t.role, t.text).split("\n")
            lines += own
            states += [2 * chat.ROLES.index(t.role)] + [2 * chat.ROLES.index(t.role) + 1] * (len(own) - 1)
        labelled.append((lines, states))
    a, b = chat.fit(labelled), chat.train(segments)
    assert np.allclose(a.start, b.start) and np.allclose(a.move, b.move) and all(np.allclose(x, y) for x, y in zip(a.see, b.see, strict=True))


def test_chat_markers_are_cut_where_turns_open(spark):
    model = chat.train(chat.transcripts(spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")))
    assert chat.turns_of(model, "User: please translate\nyes, Answer: yes\nAssistant:  ok \n") == [("user", "please translate\nyes, Answer: yes"), ("assistant", " ok \n")]


def test_chat_text_round_trip(spark, monkeypatch):
    monkeypatch.setattr(chat, "STYLES", chat.STYLES[:1] * 1)
    monkeypatch.setattr(chat, "hash_of", lambda x: 1)
    rows = [(c, t, r, f"  {x} ") for c, t, r, x in chat_rows(60)]
    lines = [(chat.raw_line(c, t, r, x).split("\n"), 2 * chat.ROLES.index(r)) for c, t, r, x in rows]
    model = chat.fit([([x for own, _ in lines for x in own], [s + (k > 0) for own, s in lines for k in range(len(own))])])
    for c in (1, 2, 3):
        own = [(r, x) for k, _, r, x in rows if k == c]
        raw = "\n".join(chat.raw_line(c, t, r, x) for t, (r, x) in enumerate(own))
        assert chat.turns_of(model, raw) == own


def test_chat_segments_equal_whole_transcripts(spark):
    """A conversation dealt out in segments is read like one row, also where turns cross ends."""
    turns = spark.createDataFrame(chat_rows(), CHAT)
    small, whole = chat.transcripts(turns, segment=50, context=20), chat.transcripts(turns, segment=10_000)
    assert small.count() == 16 and whole.count() == 3
    model = chat.train(whole)
    show = lambda s: sorted((r.conv_id, r.position, r.role, r.text, r.rendered) for r in chat.parse(chat.raw(s), model).collect())
    got, want = show(small), show(whole)
    assert got == want and all(r[4] == chat.render(r[2], r[3]) for r in got)
    assert [r[1] for r in got if r[0] == 1] == list(range(sum(r[0] == 1 for r in got)))
    plain = {c: chat.turns_of(model, x) for c, x in zip([s.conv_id for s in whole.collect()], line_rows(whole.collect()), strict=True)}
    assert {c: [(r[2], r[3]) for r in got if r[0] == c] for c in plain} == plain


def test_chat_plain_table_of_transcripts(spark):
    model = chat.fit([(["User: a", "Assistant: c"], [2, 4])] * 50)
    given = spark.createDataFrame([(1, "User: x\nAssistant: y"), (2, None), (3, "")], "conv_id long, transcript string")
    assert sorted((r.conv_id, r.position, r.role, r.text) for r in chat.parse(given, model).collect()) == [(1, 0, "user", "x"), (1, 1, "assistant", "y")]


def test_chat_odd_rows(spark):
    rows = [(1, 0, "user", "hi"), (1, 0, "user", "hi"), (1, 1, None, None), (None, 0, "assistant", "x"), (None, 0, "assistant", "y"), (1, None, "user", "lost"), (2, 600, "user", LONG), (2, 0, "system", ""), (2, -1, "user", "early")]
    segments = chat.transcripts(spark.createDataFrame(rows, CHAT).withColumn("segment", F.lit(1)).withColumn("lone", F.lit(1)))
    assert segments.count() == 7
    out = chat.parse(chat.raw(segments), chat.train(segments)).collect()
    assert all(r.rendered == chat.render(r.role, r.text) for r in out)
    assert sorted(r.text for r in out if r.lone is not None) == ["lost", "x", "y"] and {r.position for r in out if r.conv_id == 2} == {0, 1, 2}
    empty = chat.transcripts(spark.createDataFrame([], CHAT))
    assert chat.parse(chat.raw(empty), chat.train(empty)).count() == 0


def test_words_of_a_buffer(odd):
    texts = ["a  B\tc", "", "x", " \n ", "é ü z"]
    import pyarrow as pa

    data, offsets = textvec.buffer_of(pa.array(texts))
    _, first = textvec.words(data, offsets)
    assert np.diff(first).tolist() == [len(WORD.findall(t)) for t in texts]


def test_words_do_not_depend_on_blocks(monkeypatch):
    import pyarrow as pa

    rng = random.Random(1)
    texts = ["".join(rng.choice("aB \tcé") for _ in range(rng.randrange(60))) for _ in range(80)] + ["", "x" * 100, " "]
    data, offsets = textvec.buffer_of(pa.array(texts))
    want = textvec.words(data, offsets)
    alone = [textvec.words(*textvec.buffer_of(pa.array([w])))[0][0] for t in texts for w in WORD.findall(t)]
    assert want[0].tolist() == alone
    for size in (1, 2, 7, 33):
        monkeypatch.setattr(textvec, "CHUNK", size)
        got = textvec.words(data, offsets)
        assert got[0].tolist() == want[0].tolist() and got[1].tolist() == want[1].tolist()


def test_pipeline_stages(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, sf).cache()
        assert docs.columns == before.columns, name
        if name == "language":
            assert docs.count() == before.where(F.col("text").rlike(r"\p{L}")).count()
        if name == "exact_dedup":
            assert docs.count() == before.select(F.lower("text")).distinct().count()
        if name == "near_dedup":
            assert sorted(r.doc_id for r in docs.select("doc_id").collect()) == sorted({c for _, _, c in classes([(r.doc_id, r.text) for r in before.collect()])})
    assert isinstance(docs.schema["doc_id"].dataType, T.LongType)
    assert corpus_pipeline.run(spark, sf).count() > docs.count()


def test_pipeline_stages_on_odd_rows(spark, odd, none, sf):
    import corpus_pipeline

    stage = dict(corpus_pipeline.STAGES)
    docs = stage["language"](spark, odd, sf)
    assert sorted(str(r.doc_id) for r in docs.collect()) == sorted(["1", "2", "2", "None", "5", "7", "7"]) and docs.where("lang is null").count() == 0
    docs = stage["exact_dedup"](spark, docs, sf)
    assert sorted((str(r.doc_id), lower(r.text)[:4]) for r in docs.collect()) == [("2", "the "), ("5", "lore"), ("7", "drei"), ("7", "eins")]
    docs = stage["near_dedup"](spark, docs, sf)
    assert docs.count() == 4 and docs.columns == odd.columns
    docs = stage["mixing"](spark, docs, sf).cache()
    assert docs.columns == odd.columns and {r.doc_id for r in docs.collect()} <= {2, 5, 7}
    pieces = stage["packing"](spark, docs, sf).collect()
    assert len({r.row for r in pieces}) == docs.count() and sum(r.length for r in pieces if r.start == 0) <= sum(r.length for r in pieces)
    left = none
    for _, run in corpus_pipeline.STAGES:
        left = run(spark, left, sf)
        assert left.count() == 0


def test_pipeline_language_without_a_network(spark, odd):
    import corpus_pipeline

    for docs in (odd.withColumn("lang", F.lit(None).cast("string")), odd.where("lang is null or text is null or text = ''")):
        got = corpus_pipeline.language(spark, docs, "").collect()
        want = [(r.doc_id, r.text, r.lang or "und") for r in docs.collect() if re.search(r"[^\W\d_]", r.text or "")]
        assert sorted(map(str, [(r.doc_id, r.text, r.lang) for r in got])) == sorted(map(str, want))


def chain(docs, encode):
    """The whole pipeline by brute force: id -> repeats, and id -> its pieces (start, length, crc)."""
    best = {}
    for d in docs:
        if re.search(r"[^\W\d_]", d.text or ""):
            key = lower(d.text)
            best[key] = max(best.get(key, d), d, key=lambda r: r.doc_id)
    left = {d.doc_id: d for d in best.values()}
    left = {i: left[i] for i in {c for _, _, c in classes([(i, d.text) for i, d in left.items()])}}
    size, sizes = {i: len(WORD.findall(d.text)) for i, d in left.items()}, collections.Counter()
    for i, d in left.items():
        sizes[d.source] += size[i]
    order = sorted(s for s in sizes if s is not None) + [s for s in sizes if s is None]
    target = filled(sizes, {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)})
    repeats, before = {}, collections.Counter()
    for i in sorted(left, key=lambda i: (hashlib.md5(f"mix-1:{i}".encode()).hexdigest()[:12], i)):
        s = left[i].source
        whole = int(target[s] // sizes[s])
        repeats[i] = min(2, whole + (before[s] + size[i] / 2 <= target[s] - whole * sizes[s]))
        before[s] += size[i]
    pieces = {}
    for i, n in repeats.items():
        ids, at, own = np.array(encode(left[i].text), "<u4"), 0, []
        for k in packing.binary_lengths(len(ids), 2048):
            own.append((at, k, zlib.crc32(ids[at : at + k])))
            at += k
        pieces[i] = own * n
    return repeats, pieces


def test_pipeline_equals_brute_force(spark, sf, reference_ids):
    import corpus_pipeline

    repeats, pieces = chain(spark.read.parquet(f"{sf}/documents.parquet").collect(), reference_ids)
    got = collections.defaultdict(list)
    for r in corpus_pipeline.run(spark, sf).collect():
        got[r.doc_id].append((r.start, r.length, r.ids_crc32))
    assert {i: sum(p[0] == 0 for p in own) for i, own in got.items()} == {i: n for i, n in repeats.items() if n}
    assert {i: sorted(own) for i, own in got.items()} == {i: sorted(own) for i, own in pieces.items() if own}


def patterned(letters, length=1024):
    """Two words of a pattern and its complement, which every sum of powers of a base maps to one value."""
    turn = [bin(i).count("1") % 2 for i in range(length)]
    return "".join(letters[t] for t in turn), "".join(letters[1 - t] for t in turn)


def test_patterned_words_differ(spark, reference_ids):
    for length in (64, 512, 1024, 2048, 4096):
        a, b = patterned("ab", length)
        rows = [(1, a), (2, b), (3, f"{a} {a} x y z"), (4, f"{b} {a} x y z"), (5, a)]
        docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
        assert sorted((r.doc_id, r.component_id) for r in near_dedup.link(docs).collect()) == [(1, 1), (2, 2), (3, 3), (4, 4), (5, 1)]
        pieces = packing.pack(docs).orderBy("row", "start").collect()
        assert {d: [i for r in pieces if r.doc_id == d for i in r.ids] for d, _ in rows} == {d: reference_ids(t) for d, t in rows}


@pytest.mark.parametrize("bits", [0, 3])
def test_parts_that_share_a_hash_keep_their_ids(monkeypatch, reference_ids, bits):
    monkeypatch.setattr(textvec, "finished", lambda sums, length: sums & np.uint64((1 << bits) - 1))
    monkeypatch.setattr(packing, "RECENT", 4)
    encoder, rng = packing.Encoder(packing.vocabulary()), random.Random(2)
    for _ in range(6):
        texts = [" ".join(rng.choice(["a", "bb", "longer", "the", "end", "<|endoftext|>", "ü"]) for _ in range(rng.randrange(12))) for _ in range(20)]
        raw = [t.encode() for t in texts]
        ids, first = encoder.batch(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
        assert [[*ids[a:b].tolist(), 1] for a, b in zip(first[:-1], first[1:], strict=True)] == [reference_ids(t) for t in texts]


def edit_distance(a, b):
    """Unrestricted Damerau-Levenshtein distance over whole strings."""
    last, far = {}, len(a) + len(b)
    d = [[far] * (len(b) + 2) for _ in range(len(a) + 2)]
    for i in range(len(a) + 1):
        d[i + 1][1] = i
    for j in range(len(b) + 1):
        d[1][j + 1] = j
    for i in range(1, len(a) + 1):
        match = 0
        for j in range(1, len(b) + 1):
            k, m = last.get(b[j - 1], 0), match
            if a[i - 1] == b[j - 1]:
                match = j
            d[i + 1][j + 1] = min(d[i][j] + (a[i - 1] != b[j - 1]), d[i + 1][j] + 1, d[i][j + 1] + 1, d[k][m] + i - k - 1 + 1 + j - m - 1)
        last[a[i - 1]] = i
    return d[-1][-1]


def misspellings(seed, count, letters, longest):
    """Names, and others that are some edits away from them."""
    rng = random.Random(seed)
    names = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, longest))) for _ in range(count)]

    def edited(x):
        for _ in range(rng.randrange(4)):
            p, kind = rng.randrange(len(x) + 1), rng.randrange(4)
            x = {0: x[:p] + rng.choice(letters) + x[p:], 1: x[:p] + x[p + 1 :], 2: x[:p] + rng.choice(letters) + x[p + 1 :], 3: x[:p] + x[p + 1 : p + 2] + x[p : p + 1] + x[p + 2 :]}[kind]
        return x

    return names, [edited(rng.choice(names)) for _ in range(count)]


@pytest.mark.parametrize(("edits", "q", "letters", "longest"), [(1, 3, "abcdeé日", 14), (1, 2, "ab", 12), (2, 2, "abc", 16), (3, 1, "abcdefgh", 10), (0, 3, "ab", 6), (2, 3, "xyzüw", 20)])
def test_name_join_equals_brute_force(spark, monkeypatch, edits, q, letters, longest):
    monkeypatch.setattr(name_join, "HOT", 4)
    monkeypatch.setattr(name_join, "BLOCK", 16)
    monkeypatch.setattr(name_join, "CELLS", 256)
    a, b = misspellings(edits * 10 + q, 150, letters, longest)
    frame = lambda names: spark.createDataFrame([(n,) for n in names], "name string")
    got = [tuple(r) for r in name_join.join(frame(a), frame(b), edits, q).collect()]
    want = {(x, y, d) for x in set(a) for y in set(b) if x and y and (d := edit_distance(x, y)) <= edits}
    assert len(got) == len(want) and set(got) == want


def test_distances_equal_whole_tables():
    import pyarrow as pa

    for edits in (0, 1, 2, 3, 4):
        a, b = misspellings(edits, 300, "abc", 9)
        every = np.arange(300)
        got = name_join._close(*name_join.code_points(pa.array(a)), every, *name_join.code_points(pa.array(b)), every, edits, 3)
        assert got.tolist() == [min(edit_distance(x, y), edits + 1) for x, y in zip(a, b, strict=True)]


def test_name_join_odd_rows(spark):
    pairs = lambda rows: spark.createDataFrame(rows, "id long, name string").withColumn("distance", F.lit("x")).withColumn("n", F.lit(None).cast("string"))
    long = "n" * 30_000
    left = pairs([(1, "Ann"), (2, "Ann"), (2, "Ann"), (3, None), (4, ""), (None, "Anne"), (5, long), (6, "\U0001f600x")])
    right = pairs([(10, "Ann"), (10, "Ann"), (11, None), (12, ""), (13, long + "n"), (14, "x\U0001f600"), (None, "Bob")])
    got = {(r.id, r.distance): (r.n, r.first_id, r.ids_crc) for r in name_join.matches(left, right).collect()}
    crc = lambda *ids: sum(zlib.crc32(str(i).encode()) for i in ids)
    assert got == {(10, 0): (6, 1, 2 * crc(1, 2, 2)), (10, 1): (2, None, None), (13, 1): (1, 5, crc(5)), (14, 1): (1, 6, crc(6))}
    empty = left.limit(0)
    assert name_join.matches(empty, right).count() == name_join.matches(left, empty).count() == 0


def test_name_join_of_one_hot_name(spark):
    """A third of all rows has one name, and many names are one edit from it."""
    rows = [(i, "joelma dalmaberber") for i in range(3000)] + [(3000 + i, "joelma dalmaberber"[:p] + c + "joelma dalmaberber"[p:]) for i, (p, c) in enumerate((p, c) for p in range(18) for c in "xyzqwv")]
    frame = spark.createDataFrame(rows, "id long, name string")
    got = {(r.id, r.distance): r.n for r in name_join.matches(frame, spark.createDataFrame([(1, "joelma dalmaberber"), (2, "joelma dalmabrber")], "id long, name string")).collect()}
    assert got == {(1, 0): 3000, (1, 1): 108, (2, 1): 3000}


def plain_features(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    return len(w), [zlib.crc32(f.encode()) % 10_000 for f in [*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))]]


def test_streams_equal_plain_features(monkeypatch):
    import pyarrow as pa

    rng = random.Random(8)
    texts = [" ".join(rng.choice(["Ab", "é", "x1", "--", "w" * 40, "日本", "Q" * 33, "z" * 32, "t"]) for _ in range(rng.randrange(90))) for _ in range(60)] + ["", "one", "!!"]
    for chunk in (1 << 20, 64, 5):
        monkeypatch.setattr(textvec, "CHUNK", chunk)
        batch = pa.RecordBatch.from_arrays([pa.array(range(63)), pa.array(range(63)), pa.array(texts)], ["row", "id", "text"])
        got = collections.defaultdict(list)
        for b in importance._streams(10_000, 2)(iter([batch])):
            own, rows, at = np.frombuffer(b.column(0)[0].as_py(), np.uint16), b.column(1)[0].as_py(), b.column(3)[0].as_py()
            for r, lo, hi in zip(rows, at[:-1], at[1:], strict=True):
                got[r] += own[lo:hi].tolist()
        assert {r: sorted(x) for r, x in got.items()} == {r: sorted(plain_features(t)[1]) for r, t in enumerate(texts)}


@pytest.mark.parametrize("runs", [1, 3])
def test_streams_of_other_runs(monkeypatch, runs):
    rng = random.Random(runs)
    w = [rng.choice(["a", "bb", "ccc", "é"]) for _ in range(200)]
    data = np.frombuffer(" ".join(w).encode(), np.uint8)
    want = sorted(zlib.crc32(" ".join(w[i : i + k]).encode()) % 10_000 for k in range(1, runs + 1) for i in range(len(w) - k + 1))
    assert sorted(importance.stream(data, np.array([0, len(data)]), runs=runs)[0].tolist()) == want
    monkeypatch.setattr(textvec, "CHUNK", 7)
    assert sorted(np.concatenate(list(importance._long_stream(data, 10_000, runs))).tolist()) == want


def test_importance_odd_rows(spark, odd, none):
    target = spark.createDataFrame([("the cat and the dog",), (None,)], "text string")
    got = importance.resample(odd, target, share=50, least_words=3).collect()
    assert len(got) == odd.count()
    assert all(r.n_features == r.weight == 0 and r["rank"] is None for r in got if r.doc_id in (3, 4))
    assert sorted(r["rank"] for r in got if r["rank"] is not None) == [1, 2, 3]  # half of 7 rows with three words
    assert len({(r.weight, r.score) for r in got if r.doc_id == 2}) == 1
    assert importance.resample(none, target).count() == 0
    assert all(r["rank"] is None for r in importance.resample(odd, none, share=0).collect())


def test_quality_model_held_out(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in catalog.op11_quality_model(spark, sf).collect() if r.held_out and r.doc_id in labels]
    assert len(rows) > 60 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert np.mean([r.predicted for r in rows if labels[r.doc_id]]) > 0.97
    assert np.mean([1 - r.predicted for r in rows if not labels[r.doc_id]]) > 0.8


def test_context_sums_equal_plain_windows(spark):
    texts = ["the cat THE the!! dog cat cat", "", "a -- b", "dog"] * 3
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    number = lambda t: quality_model.tokens(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]))[0].tolist()
    of = np.zeros((quality_model.WORDS, quality_model.DIM))
    for k in range(2 * quality_model.ONES):
        of[np.arange(quality_model.WORDS), quality_model._PLACES[:, k]] += quality_model._SIGN[:, k]
    want = np.zeros_like(of)
    for t in texts:
        n = number(t)
        for i, a in enumerate(n):
            for j in range(max(0, i - quality_model.REACH), min(len(n), i + quality_model.REACH + 1)):
                want[a] += of[n[j]]
    want /= np.maximum(np.sqrt((want * want).sum(1, keepdims=True)), 1)
    assert np.allclose(quality_model.word_vectors(docs), want, atol=1e-6)
    n = number("the cat THE the!! dog cat cat")
    assert len(n) == 10 and n[0] == n[3] != n[2] and n[1] == n[7] == n[8] and n[4] == n[9] == quality_model._REPEAT and len(set(n)) == 6


def test_quality_gradients_and_temperature():
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(20, 5)), rng.integers(0, 2, 20).astype(float)
    layers = tuple(rng.normal(size=s) for s in ((5, 4), 4, 4, 1))
    for k, g in enumerate(quality_model.gradients(layers, x, y)):
        for at in np.ndindex(g.shape):
            near = []
            for h in (1e-5, -1e-5):
                moved = [p.copy() for p in layers]
                moved[k][at] += h
                near.append(quality_model.loss(quality_model.output(tuple(moved), x), y))
            assert abs((near[0] - near[1]) / 2e-5 - g[at]) < 1e-6
    z = rng.normal(size=4000) * 2
    y = (rng.random(4000) < 1 / (1 + np.exp(-z))).astype(float)
    assert abs(quality_model.best_temperature(3 * z, y) - 3) < 0.4


def test_quality_model_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (1, 1), (5, 0), (6, None), (7, 3), (None, 1), (2, 0), (2, 1), (3, 0)], "doc_id long, quality int")
    net = quality_model.train(odd, labels)
    got = quality_model.score(odd, net).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in got if not r.text} == {net.share}
    assert "kept" in got[0] and len({r.score for r in got if r.doc_id == 2}) == 1
    assert {r.score for r in quality_model.score(odd, quality_model.train(odd, labels.limit(0))).collect()} == {0.5}
    one = quality_model.train(odd, labels.where("quality = 1"))
    assert {r.score for r in quality_model.score(odd, one).collect()} == {1.0}
    assert quality_model.score(none, quality_model.train(none, labels)).count() == 0


def test_packing_splits_where_the_vocabulary_does(monkeypatch, reference_ids):
    """Random runs of all kinds of characters, in small blocks too."""
    rng = random.Random(12)
    pieces = ["a", "Zq", "don't", "'s", "'", "''re", ",", "--", "<|endoftext|>", "<|endof", "text|>", "|>", "1", "23", " ", "  ", "\n", "\t", "é", "日", "\u00a0", "\u3000", "e\u0301", "_", "x_y", "🎉", "\x1c", "\x7f", "\x00", "ª", "²"]
    encoder = packing.Encoder(packing.vocabulary())
    for chunk in (1 << 20, 16, 40):
        monkeypatch.setattr(textvec, "CHUNK", chunk)
        texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 60))) for _ in range(700)]
        for t in texts[:150]:
            assert [*encoder.whole(np.frombuffer(t.encode(), np.uint8)).tolist(), 1] == reference_ids(t), t
        raw = [t.encode() for t in texts]
        ids, first = encoder.batch(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
        assert [[*ids[a:b].tolist(), 1] for a, b in zip(first[:-1], first[1:], strict=True)] == [reference_ids(t) for t in texts]
