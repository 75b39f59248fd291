"""Each operator against a brute-force version or its contract, on small tables with nulls, empties, ties and repeats."""

import base64
import hashlib
import itertools
import math
import random
import re
import zipfile
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

import public_tokenizers
from factloom.llm import bpe, common, components, kernels, langid, lattice, media, minhash, mixing, quality, sharding, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, shard int, key string"
ODD = [None, "", " \t\n", "one", "Ünï cödé — ß 漢字", "a b c d e", "x " * 3000, "'s 12 ...   end  "]


def frame(spark, rows, schema=DOCS):
    width = len(schema.split(","))
    return spark.createDataFrame([tuple(r) + (None,) * (width - len(r)) for r in rows], schema)


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, None if i % 3 else "en", None if i % 4 else "s") for i, t in enumerate(ODD)]
    return frame(spark, [*rows, (2, " \t\n", "en", "s"), (None, "no id at all here", None, None), (5, "a b c d e", "en", None)])


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, [])


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_word_hashes_tell_words_apart():
    texts = ["a b  a", None, "", "é\tb", "z" * 700_000 + " q", " ".join(str(i) for i in range(90_000))]
    hashes, counts = kernels.words(pa.array(texts))
    want = [words(t) for t in texts]
    assert counts.tolist() == [len(w) for w in want]
    flat = [w for t in want for w in t]
    assert len(set(zip(flat, hashes.tolist()))) == len(set(flat)) == len(set(hashes.tolist()))
    pairs, sizes = kernels.ngrams(hashes, counts, 2)
    assert sizes.tolist() == [max(0, len(w) - 1) for w in want] and len(pairs) == sum(sizes)


# 1 and 10


def labelled(spark, n=240):
    rng = random.Random(1)
    vocab = ["".join(rng.choice("abcdeghklmnoprstu") for _ in range(6)) for _ in range(60)]
    docs, labels = [], []
    for i in range(n):
        bad, toxic = i % 3 == 0, i % 4 == 0
        ws = [rng.choice(vocab) for _ in range(40)]
        ws = [w.upper() + "!!" for w in ws] if bad else ws
        if toxic:
            ws[rng.randrange(40)] = "zyxidiot"
        docs.append((i, " ".join(ws), "en", "s"))
        labels.append((i, 0 if bad else 1, int(toxic)))
    return frame(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("op, label, modulus, out", [(quality, "quality", 4, 2), (toxicity, "toxic", 3, 1)])
def test_classifiers_on_held_out_rows(spark, odd, empty, op, label, modulus, out):
    docs, labels = labelled(spark)
    model = op.train(docs, labels)
    scored = docs.join(labels, "doc_id").withColumn("s", op.score(F.col("text"), model)).where(common.remainder(F.col("doc_id"), modulus) == out).collect()
    assert len(scored) > 40 and sum((r.s >= 0.7) == (r[label] == 1) for r in scored) >= 0.95 * len(scored)
    got = odd.select("doc_id", op.score(F.col("text"), model).alias("s")).collect()
    assert len(got) == odd.count() and all(0 <= r.s <= 1 for r in got)
    none = op.train(empty, labels)
    assert none.scores(pa.array(["a", None])).tolist() == [0.5, 0.5]
    assert empty.select(op.score(F.col("text"), model)).count() == 0


def test_quality_scores_are_sparse_dot_products():
    text = "The cat the CAT !! !! the"
    w = np.random.default_rng(0).normal(size=1 << 18).astype(np.float32)
    number, times, sizes = quality.features(pa.array([text, None]))
    value = quality.weighed(times, sizes)
    assert sizes.tolist() == [len(number), 0] and abs((value**2).sum() - 1) < 1e-9
    model = quality.QualityModel(w, 0.25)
    want = 1 / (1 + math.exp(-(sum(w[n] * v for n, v in zip(number, value)) + 0.25)))
    assert abs(model.scores(pa.array([text]))[0] - want) < 1e-9


def test_ftrl_against_a_plain_one():
    rng = np.random.default_rng(3)
    rows = [(np.unique(rng.integers(0, 16, 5)), None) for _ in range(60)]
    rows = [(a, rng.integers(1, 4, len(a))) for a, _ in rows] + [(np.zeros(0, int), np.zeros(0, int))]
    labels = np.array([int(3 in a) for a, _ in rows])
    weights, bias = quality.ftrl(rows, labels, 4)
    z, n = defaultdict(float), defaultdict(float)
    alpha, beta, l1, l2 = 0.5, 1.0, 0.02, 1e-4

    def weight(i):
        return 0.0 if abs(z[i]) <= l1 else (math.copysign(l1, z[i]) - z[i]) / ((beta + math.sqrt(n[i])) / alpha + l2)

    order = np.random.default_rng(7)
    for _ in range(5):
        for k in order.permutation(len(rows)):
            raw = {int(i): 1 + math.log(c) for i, c in zip(*rows[k])}
            length = math.sqrt(sum(v * v for v in raw.values()))
            x = {i: v / length for i, v in raw.items()} | {16: 1.0}
            w = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in x.items())))
            for i, v in x.items():
                g = (p - labels[k]) * v
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha * w[i]
                n[i] += g * g
    assert np.allclose(weights, [weight(i) for i in range(16)], atol=1e-5) and abs(bias - weight(16)) < 1e-5


def test_toxicity_scores_against_plain_character_ngrams():
    texts = ["Ünï cödé 漢字 is TOXIC", "toxic toxic", None, "", "abc"]
    rng = np.random.default_rng(2)
    table = np.where(rng.random(1 << 20) < 0.5, rng.normal(size=1 << 20), 0.0)
    model = toxicity.ToxicityModel(table, 0.1)
    for t, score in zip(texts, model.scores(pa.array(texts))):
        full = f" {(t or '').lower()} "
        found = {full[i : i + n] for n in (4, 5, 6) for i in range(len(full) - n + 1)}
        numbers = set()
        for g in found:
            points = np.array([ord(c) for c in g], np.uint32)
            numbers.add(int(kernels.grams(points, np.array([0, len(g)]), len(g))[0][0] >> np.uint64(44)))
        assert abs(score - 1 / (1 + math.exp(-(sum(table[k] for k in numbers) + 0.1)))) < 1e-9


def test_toxicity_ratios_are_log_count_ratios():
    r, _ = toxicity.ratios(np.array([3.0, 0.0]), np.array([1.0, 4.0]), 4, 8)
    assert np.allclose(r, [math.log((4 / 6) / (2 / 10)), math.log((1 / 6) / (5 / 10))])


def test_toxicity_of_a_long_text_is_that_of_its_features():
    table = np.random.default_rng(1).normal(size=1 << 20)
    text = "".join(random.Random(2).choice("abcdef ") for _ in range(3 * kernels.BLOCK))
    owner, number = toxicity.occurrences(pa.array([text, "abc"]), table, 20)
    data = f" {text} ".encode()
    one = np.frombuffer(data, np.uint8)
    want = set()
    for n in toxicity.SIZES:
        want |= set((kernels.grams(one, np.array([0, len(one)]), n)[0] >> np.uint64(44)).tolist())
    assert set(number[owner == 0].tolist()) == want


# 2


def brute_links(docs):
    sets = {}
    for i, t in docs:
        w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * len(sets[a] | sets[b]):
            parent[max(root(a), root(b))] = min(root(a), root(b))
    return {i: (len(sets[i]), root(i)) for i in sets}


def near_copies(edits):
    rng = random.Random(5)
    base = [f"w{rng.randrange(5000)}" for _ in range(150)]
    docs = []
    for i in range(120):
        w = list(base)
        for _ in range(rng.choice(edits)):
            w[rng.randrange(150)] = f"e{rng.randrange(10**6)}"
        docs.append((1000 - i, " ".join(w)))
    for i in range(60):
        docs.append((2000 + i, " ".join(base[:40] + [f"u{rng.randrange(10**6)}" for _ in range(60)])))
    return docs + [(3000 + i, t) for i, t in enumerate(["", "a b", "A  b", "x y z", "p q r s t", "P q r\ts t", "  "])] + [(4000, " ".join(base)), (4001, " ".join(base).upper())]


@pytest.mark.parametrize("edits, crowd", [((0, 1, 2, 3), 32), ((2, 3, 4, 5, 6, 8), 32), ((2, 3, 4, 5, 6, 8), 2)])
def test_near_duplicates_against_all_pairs(spark, monkeypatch, edits, crowd):
    monkeypatch.setattr(minhash, "CROWD", crowd)
    docs = near_copies(edits)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(frame(spark, docs)).collect()}
    assert got == {i: (n, c, i == c) for i, (n, c) in brute_links(docs).items()}


def test_words_that_a_polynomial_hash_confuses(spark):
    """Thue-Morse words agree under every polynomial over Z/2^64; as documents they are different."""
    x, y = "a", "b"
    for _ in range(11):
        x, y = x + y, y + x
    assert len(x) == 2048 and len(set(kernels.words(pa.array([x, y]))[0].tolist())) == 2
    docs = [(1, x), (2, y), (3, f"p q r s {x} t u"), (4, f"p q r s {y} t u")]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(frame(spark, docs)).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4}


def test_exact_shingles_against_sets():
    rng = random.Random(9)
    texts = [None, "", " \t", "A b", "a  B", "a b c d", *[" ".join(rng.choices("abÉ", k=rng.randint(1, 30))) + rng.choice(["", " ", "\n"]) for _ in range(200)]]
    found, sizes = minhash.exact_shingles(pa.array(texts))
    ends = np.cumsum(sizes)
    mine = [set(found[e - n : e].tolist()) for e, n in zip(ends, sizes)]
    sets = []
    for t in texts:
        w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    for (a, x), (b, y) in itertools.combinations(zip(mine, sets), 2):
        assert len(a) == len(x) and len(a & b) == len(x & y)


def test_digests_are_of_the_words():
    texts = ["A b", " a\tB \n", "ab", "", None, " ", "a b ", "a b c"]
    data, bounds = kernels.raw(pa.array(texts))
    got = minhash.word_digests(data, bounds)
    for i, j in itertools.combinations(range(len(texts)), 2):
        assert (got[i] == got[j]) == (words((texts[i] or "").lower()) == words((texts[j] or "").lower()))


def test_components_against_union_find(spark):
    rng = random.Random(12)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(200, 201), (201, 202), (202, 200), (300, 300), (5, 4), (5, 4)]
    edges += [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(60)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    got = {r.v: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {v: root(v) for v in parent if root(v) != v}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates_of_odd_rows(odd, empty):
    got = minhash.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)]
    assert all(r.component_id == r.doc_id for r in got if r.doc_id is not None)
    assert minhash.near_duplicates(empty).count() == 0


def test_posterior_bounds():
    steps = dict(minhash.fewest_matches(64, 32, 0.75, 1e-3))
    tail = lambda n, m: sum(math.comb(n + 1, k) * 0.75**k * 0.25 ** (n + 1 - k) for k in range(m + 1))
    assert all(tail(n, m) >= 1e-3 > tail(n, m - 1) for n, m in steps.items())


# 3


def test_language_profiles(spark, odd, empty):
    rng = random.Random(3)
    parts = {"aa": ["lorem", "ipsum", "dolor", "sit"], "bb": ["können", "straße", "über", "schön"], "cc": ["niño", "señor", "corazón", "está"]}
    docs = [(i, " ".join(rng.choice(parts[x]) for _ in range(30)) + " 12.", x) for i, x in enumerate(list(parts) * 30)]
    model = langid.train(frame(spark, docs))
    assert model.languages == ("aa", "bb", "cc")
    got = frame(spark, docs).select("lang", langid.predict(F.col("text"), model).alias("p")).collect()
    assert all(r.p.lang == r.lang and 0 <= r.p.score <= 1 for r in got)
    bad = {r.text: r.p.lang for r in odd.select("text", langid.predict(F.col("text"), model).alias("p")).collect()}
    assert bad[None] == bad[""] == bad[" \t\n"] == "und"
    assert langid.train(empty).predict("abc") == ("und", 0.0)


def test_language_grams_and_distance_by_hand():
    got = Counter({langid.spelled(int(g)): int(n) for g, n in zip(*langid.grams("Ab, ab!"))})
    text, want = "_ab_ab_", Counter()
    for n in (1, 2, 3):
        want.update(text[k : k + n] for k in range(len(text) - n + 1))
    assert got == Counter({g: n for g, n in want.items() if g != "_" and not (len(g) == 3 and g[1] == "_")})
    model = langid.LanguageModel(("x",), *(lambda g: (np.sort(g), np.arange(len(g))[np.argsort(g)][:, None]))(langid.grams("ab")[0]), 10)
    assert model.predict("ab")[0] == "x"


# 4


def test_media_round_trip_and_retry(spark, odd, empty, tmp_path):
    got = {(r.doc_id, bytes(r.payload)): r for r in media.stored_media(odd.select("doc_id", "text", "key")).collect()}
    for r in odd.collect():
        raw = (r.text or "").encode()
        x = got[r.doc_id, media.padded(raw)]
        assert x.n_bytes == len(raw) and len(x.payload) % 64 == 0 and len(x.payload) > 0 and bytes(x.media) == media.to_png(raw)
    assert media.stored_media(empty).count() == 0


def test_media_members_are_read_again_by_offset(tmp_path):
    path = tmp_path / "a.zip"
    w = media.ArchiveWriter(open(path, "wb"))
    bodies = [media.to_png(f"text {i}".encode() * i) for i in range(9)]
    for i, b in enumerate(bodies):
        w.add(f"{i}.png", b)
    w.close()
    assert zipfile.ZipFile(path).testzip() is None
    reads = []

    class Flaky:
        def __init__(self):
            self.f = open(path, "rb")

        __enter__ = lambda s: s
        __exit__ = lambda s, *a: s.f.close()
        seek = lambda s, n: s.f.seek(n)

        def read(self, n):
            at, data = self.f.tell(), self.f.read(n)
            reads.append(at)
            if len(reads) == 3:  # the first run: damage one member
                data = bytearray(data)
                data[len(data) // 2] ^= 255
                return bytes(data)
            return data

    size = path.stat().st_size
    half = size // 2
    got = [m for s, e in ((0, half), (half, size)) for m in media.members(lambda p: (Flaky(), size), str(path), s, e)]
    assert [g[2] for g in got] == bodies


# 5


def test_lattice_points_are_nearest():
    y = np.random.default_rng(4).normal(size=(60, 8)) * 2
    p = lattice.nearest_point(y)
    assert (p % 2 == p[:, :1] % 2).all() and (p.sum(axis=1) % 4 == 0).all()
    v = lattice.minimal_vectors()
    assert v.shape == (240, 8) and ((v**2).sum(axis=1) == 8).all()
    own = ((y - p / 2) ** 2).sum(axis=1)
    near = ((y[:, None] - (p[:, None] + v) / 2) ** 2).sum(axis=2).min(axis=1)
    assert (own <= near + 1e-9).all()


def test_forest_and_least_cell():
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(size=(1, 16)) + rng.normal(size=(12, 16)) * 0.02, rng.normal(size=(5, 16))])
    keys = [np.array([3, 5]) if k % 2 else np.array([5, 9]) for k in range(17)]
    near = lattice._links(5, x, keys, None, 0.95)
    both_odd = np.arange(17) % 2 == 1
    want = np.zeros((17, 17), bool)
    want[:12, :12] = True
    np.fill_diagonal(want, False)
    assert (near == (want & ~(both_odd[:, None] & both_odd))).all()  # odd ones share cell 3, where their pairs count
    a, b = lattice._forest(near)
    assert len(a) == 11 and near[a, b].all()


def test_vectors_of_great_and_small_norm(spark):
    rows = [(1, [1e200, 1e200]), (2, [2e200, 2e200]), (3, [1e-200, 1e-200]), (4, [1.0, -1.0]), (4, [-1.0, 1.0]), (5, [-2.0, 2.0])]
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in lattice.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert got == [(1, 2, 1), (2, 2, 1), (3, 2, 1), (4, 0, 4), (4, 1, 4), (5, 1, 4)]


def test_embeddings_against_all_pairs(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 64))
    for i in range(0, 200, 4):
        u = rng.normal(size=64)
        x[i + 1] = x[i] + u * rng.uniform(0.05, 0.33)
        x[i + 2] = 2 * x[i]
    x[300:340] = x[299] + rng.normal(size=(40, 64)) * 0.12
    x = x.astype(np.float32).astype(float)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 64), (902, [None] + [1.0] * 63), (903, [float("nan")] + [1.0] * 63), (904, []), (None, x[0].tolist()), (905, x[299].tolist()), (906, [1.0, 2.0]), (907, [2.0, 4.0])]
    got = {r.vec_id: r for r in lattice.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    ids = [*range(400), 905]
    y = np.vstack([x, x[299]])
    y = y / np.linalg.norm(y, axis=1)[:, None]
    near = y @ y.T >= 0.95
    want = {ids[k]: int(near[k].sum()) - 1 for k in range(len(ids))}
    found = sum(min(got[i].n_links, n) for i, n in want.items())
    assert found >= 0.99 * sum(want.values()) and all(got[i].n_links <= n for i, n in want.items())
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in (900, 901, 902, 903, 904))
    assert (got[906].n_links, got[907].component_id) == (1, 906) and got[None].kept and got[None].component_id is None
    assert got[905].component_id == got[299].component_id and not got[905].kept
    assert lattice.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


# 6


def test_targets_by_hand():
    assert mixing.targets([100, 100, 100], [3, 1, 2], 1.5, 2) == [200.0, pytest.approx(250 / 3), pytest.approx(500 / 3)]
    assert mixing.targets([0, 10], [3, 1], 1.5, 2) == [0.0, 15.0] and mixing.targets([], [], 1.5, 2) == []


def test_mix_meets_its_targets_and_repeats_itself(spark, odd, empty):
    rng = random.Random(8)
    docs = [(i, "w " * rng.randrange(0, 300), "en", rng.choice(["a", "a", "a", "b", "Ä", None])) for i in range(600)]
    run = lambda: sorted((r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken, str(r.source)) for r in mixing.mixed(frame(spark, docs)).collect())
    rows = run()
    assert rows == run() and len(rows) == 600
    sizes = defaultdict(int)
    for i, t, _, s in docs:
        sizes[s] += len(words(t))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    goals = dict(zip(map(str, order), mixing.targets([sizes[s] for s in order], [3, 1, 2, 3], 1.5, 2)))
    taken = defaultdict(int)
    for _, size, source_size, target, t, s in rows:
        assert 0 <= t <= 2 * size and abs(target - goals[s]) < 1e-3
        taken[s] += t
    assert all(abs(taken[s] - g) <= max(0.01 * g, 5) for s, g in goals.items())
    assert mixing.mixed(odd).count() == odd.count() and mixing.mixed(empty).count() == 0


def test_schedule_has_low_discrepancy(spark):
    goals = [300, 100, 200]
    seen = [r.source_no for r in mixing.ranked(mixing.schedule(spark, goals)).orderBy("k").collect()]
    for n in (50, 200, 600):
        for s, g in enumerate(goals):
            assert abs(seen[:n].count(s) - n * g / 600) <= 4


def test_one_tiny_source_does_not_shrink_all_blocks(spark):
    docs = [(i, "w " * 5000, "en", "big") for i in range(400)] + [(1000 + i, "w " * 10, "en", "tiny") for i in range(10)]
    assert mixing.block_words(3_000_000.0) == 4096 and mixing.block_words(200.0) == 1
    rows = mixing.mixed(frame(spark, docs)).collect()
    taken = {s: sum(r.taken for r in rows if r.source == s) for s in ("big", "tiny")}
    goals = {r.source: r.target for r in rows}
    assert all(abs(taken[s] - goals[s]) <= 0.01 * goals[s] for s in goals)


def test_equal_rows_and_null_ids_fill_a_stream(spark):
    docs = [(None, "a b c", "en", "s")] * 200 + [(1, "d " * 50, "en", "s")] * 30
    rows = mixing.mixed(frame(spark, docs), block=7).collect()
    assert len(rows) == 230 and all(0 <= r.taken <= 2 * r.size for r in rows)
    assert abs(sum(r.taken for r in rows) - rows[0].target) <= 7 * 4


# 7


def test_warc_round_trip_filters_and_revisits(spark, tmp_path):
    rows = [(i, f"http://h/{i}", h) for i, h in enumerate(["<p>é</p>", None, "", "<p>é</p>", "x" * 300_000, "<p>é</p>"])] + [(None, None, "<p>é</p>"), (9, "u\nv", "solo")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in warc.archived(pages).where("record_type <> 'warcinfo'").collect()}
    digest = lambda h: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
    heads = {None: 2, "": 2, "<p>é</p>": 5}
    assert len(got) == len(rows)
    for i, _, h in rows:
        head = heads.get(h, i)
        want = ("response", None) if head == i else ("revisit", head)
        assert (got[i].record_type, got[i].refers_to, got[i].payload_digest, got[i].payload_bytes) == (*want, digest(h), len((h or "").encode()))
    small = warc.archived(pages, least=9).where("record_type = 'revisit'").collect()
    assert {r.page_id for r in small} == {0, 3, None}


@pytest.mark.parametrize("packed", [True, False])
def test_warc_push_down_skips_blocks(spark, tmp_path, packed):
    pages = spark.createDataFrame([(i, f"http://h/{i}", "same" if i < 3 else f"p{i}" * 1000) for i in range(6)], "page_id long, url string, html string")
    warc.write(pages, f"file://{tmp_path}/w", packed=packed).collect()
    found = warc.read(spark, f"file://{tmp_path}/w").where("record_type = 'revisit' AND payload_bytes > 0")
    assert {r.page_id for r in found.collect()} == {0, 1}
    one = warc.read(spark, f"file://{tmp_path}/w").where(F.col("target_uri").isin("http://h/4")).collect()
    assert [bytes(r.payload) for r in one] == [b"p4" * 1000]
    reader = warc.WarcReader({"path": "x"})
    from pyspark.sql.datasource import EqualTo, GreaterThan

    left = list(reader.pushFilters([EqualTo(("record_type",), "response"), GreaterThan(("payload_bytes",), 3)]))
    assert reader.wanted == {"record_type": {"response"}} and left == [GreaterThan(("payload_bytes",), 3)]


def test_warc_of_no_pages(spark):
    assert warc.archived(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_warc_records_without_a_sha1_digest_are_filtered_by_their_payload(spark, tmp_path):
    def record(extra):
        return b"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:x:1>\r\n" + extra + b"Content-Length: 5\r\n\r\nhello\r\n\r\n"

    (tmp_path / "a.warc").write_bytes(record(b"") + record(b"WARC-Payload-Digest: md5:abc\r\n") + record(b"WARC-Payload-Digest: sha1:" + warc.sha1_base32(b"hello").encode() + b"\r\n"))
    found = warc.read(spark, f"file://{tmp_path}")
    assert found.where(F.col("payload_digest") == warc.sha1_base32(b"hello")).count() == 3
    assert found.where(F.col("payload_digest") == "other").count() == 0


def test_skipped_gzip_members_are_not_inflated(tmp_path):
    rng = random.Random(4)
    bodies = [rng.randbytes(300_000) for _ in range(6)]
    members = [warc._gzip(warc._record("response", k, None, warc.sha1_base32(d), d, None, len(d))) for k, d in enumerate(bodies)]
    plain = [zlib.decompress(m, 31) for m in members]
    assert all(warc._skip_lengths(m) == (len(m), len(p)) for m, p in zip(members, plain))
    foreign = zlib.compressobj(4, zlib.DEFLATED, 31)
    foreign = foreign.compress(plain[0]) + foreign.flush()
    path = tmp_path / "x.warc.gz"
    path.write_bytes(b"".join([*members, foreign]))
    made = []

    class Counted(warc._Inflated):
        def _more(self):
            got = super()._more()
            made.append(len(self.held) - self.at)
            return got

    old, warc._Inflated = warc._Inflated, Counted
    try:
        with open(path, "rb", buffering=0) as f:
            rows = list(warc.records(f, True, {"record_id": {"<urn:x-page:3>"}}, True))
    finally:
        warc._Inflated = old
    assert [r[-1] for r in rows] == [bodies[3]] and sum(1 for m in made if m) < 50  # one piece for each skipped member, some 20 for the wanted and the foreign one


# 8


def brute_shard(key, weights):
    def score(s):
        bits = int(hashlib.md5(f"{'null' if key is None else f'={key}'}/{s}".encode()).hexdigest()[:13], 16)
        return -math.log((bits + 0.5) / 2**52) / weights[s]

    return min(range(len(weights)), key=score)


def test_rendezvous_shards_and_slots(spark, odd, empty):
    rows = frame(spark, [(i, "t" if i else "long " * 200_000, "en", "s") for i in range(500)] + [(7, "t", "en", "s")] * 40).unionByName(odd)
    weights = [1.0, 2.0, 0.5, 1.0]
    run = lambda x: sharding.slotted(sharding.sharded(x, "doc_id", weights), "doc_id", ["text"]).collect()
    got = run(rows)
    assert len(got) == rows.count() and "n_chars" in got[0]
    slots = defaultdict(list)
    for r in got:
        assert r.shard == brute_shard(r.doc_id, weights) and r.grown_shard == brute_shard(r.doc_id, [*weights, 1.0])
        assert r.grown_shard in (r.shard, 4)
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    placed = lambda found: sorted((str(r.doc_id), str(r.text)[:20], r.shard, r.slot) for r in found)
    assert placed(run(rows.repartition(7, "n_chars", F.rand(3)))) == placed(got)  # whatever the input's layout
    assert sharding.slotted(sharding.sharded(empty, "doc_id"), "doc_id").count() == 0


def test_shards_keep_other_columns_and_tell_null_from_its_name(spark):
    rows = spark.createDataFrame([("null", 1, 2, 3, 4), (None, 5, 6, 7, 8)], "k string, _best int, _hash int, _one int, _piece int")
    got = sharding.slotted(sharding.sharded(rows, "k", [1.0] * 1000), "k").collect()
    assert {(r.k, r._best, r._hash, r._one, r._piece) for r in got} == {("null", 1, 2, 3, 4), (None, 5, 6, 7, 8)}
    assert len({r.shard for r in got}) == 2


def test_weighted_shares(spark):
    got = Counter(r.s for r in spark.range(6000).select(sharding.shard_of(F.col("id"), [1.0, 3.0]).alias("s")).collect())
    assert abs(got[1] / 6000 - 0.75) < 0.03


# 9


def test_bpe_against_the_library(spark, odd, empty):
    ranks = bpe.ranks_of(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    more = frame(odd.sparkSession, [(100 + i, t) for i, t in enumerate(["I'll say: don't 's it?", "  two  spaces\n\n\tand　wide", "x" * 300, "²³½ 12٣", "emoji 🙂🙂 ok", "naïve café Œuvre", "<|endoftext|>", "\u0085  x"])])
    docs = odd.unionByName(more)
    got = bpe.encoded(docs, ranks, public_tokenizers.PATTERN).withColumn("back", bpe.decoded(F.col("ids"), ranks)).collect()
    found = Counter((r.doc_id, bytes(r.ids), bytes(r.back)) for r in got)
    want = Counter((r.doc_id, np.array(enc.encode_ordinary(r.text or ""), "<u4").tobytes(), (r.text or "").encode()) for r in docs.collect())
    assert found == want
    assert bpe.encoded(empty, ranks, public_tokenizers.PATTERN).count() == 0


def test_bpe_chunks_do_not_change_ids(spark, monkeypatch):
    ranks = bpe.ranks_of(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    docs = frame(spark, [(i, f"word{i} and more{i % 7} tokenisation") for i in range(50)])
    ids = lambda: sorted((r.doc_id, bytes(r.ids)) for r in bpe.encoded(docs, ranks, public_tokenizers.PATTERN).collect())
    whole = ids()
    monkeypatch.setattr(bpe.coded, "__defaults__", (5,))
    assert ids() == whole


def _class_table():
    starts, kinds = bpe.class_runs()
    return np.repeat(kinds, np.diff([*starts, 0x110000]))


def _quick(texts):
    words, counts = bpe.quick_words(pa.array(texts, pa.string()), _class_table())
    words, ends = words.to_pylist(), np.cumsum(counts)
    return [words[e - n : e] for n, e in zip(counts, ends)]


def test_quick_words_and_the_pattern_agree(monkeypatch):
    import regex

    assert public_tokenizers.PATTERN == bpe.QUICK_PATTERN
    find = regex.compile(bpe.QUICK_PATTERN).findall
    rng = random.Random(1)
    texts = ["".join(rng.choices("ab'stmdrevl  \n\t\r\u008519.,!-é漢²Ⅷ\u3000\u00a0😀", k=rng.randint(0, 40))) for _ in range(4000)]
    texts += [None, "", "'", "'l", "'ll", " 's", "\n's", "x\n", "x  ", "  x", "I'll we've 'tis ''s ' 's don't  x's 'rex"]
    want = [[w.encode() for w in find(t or "")] for t in texts]
    assert _quick(texts) == want
    monkeypatch.setattr(bpe, "_BLOCK", 16)  # long texts in parts, and many blocks
    assert _quick(texts) == want
    words, counts = bpe.pattern_words(pa.array(texts, pa.string()), bpe.QUICK_PATTERN)
    assert words.to_pylist() == [w for t in want for w in t] and counts.tolist() == [len(t) for t in want]


def test_class_table_is_the_library_s():
    kinds = _class_table()
    enc = tiktoken.Encoding("own", pat_str=r"[^\s\p{L}\p{N}]", mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    assert bytes(enc.encode_ordinary(every)).decode() == "".join(c for c in every if kinds[ord(c)] == 3)


def test_rank_map_holds_every_pair(spark):
    ranks = bpe.ranks_of(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    keys, found = bpe.pairs_of(ranks)
    shifts, slot, table = bpe.displaced(keys, 50256**2)
    assert len(set(slot.tolist())) == len(keys) and slot.max() < len(table)
    assert ((keys % len(table) + shifts[keys % len(shifts)]) % len(table) == slot).all()


@pytest.mark.parametrize("size", [254, 255, 256, 257])
def test_folded_and_heaped_words_agree(spark, size):
    ranks = bpe.ranks_of(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    enc = tiktoken.Encoding("own", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(size)
    texts = ["a" * size, "".join(rng.choices("etaoin", k=size)), "".join(rng.choices("漢字語", k=size))[: size // 3]]
    docs = frame(spark, list(enumerate(texts)))
    got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in bpe.encoded(docs, ranks, bpe.QUICK_PATTERN).collect()}
    for k, t in enumerate(texts):
        assert got[k] == enc.encode_ordinary(t) == bpe.heaped(t.encode(), ranks)


def test_a_long_unspaced_text_takes_seconds(spark):
    ranks = bpe.ranks_of(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    enc = tiktoken.Encoding("own", pat_str=bpe.QUICK_PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(2)
    text = "".join(chr(rng.randint(0x4E00, 0x9FA5)) for _ in range(20_000))
    (row,) = bpe.encoded(frame(spark, [(1, text)]), ranks, bpe.QUICK_PATTERN).collect()
    assert np.frombuffer(row.ids, "<u4").tolist() == enc.encode_ordinary(text)


def test_a_word_that_is_a_token_is_taken_whole(spark):
    """Even where no chain of merges leads to it."""
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"abcd": 257}
    docs = frame(spark, [(1, "abcd"), (2, "xabcd"), (3, "ab abcdab")])
    enc = tiktoken.Encoding("own", pat_str=bpe.QUICK_PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in bpe.encoded(docs, ranks, bpe.QUICK_PATTERN).join(docs.select("doc_id", "text"), "doc_id").collect():
        assert np.frombuffer(r.ids, "<u4").tolist() == enc.encode_ordinary(r.text)


def test_a_dense_cluster_is_compared_once(spark):
    rng = np.random.default_rng(6)
    centre = rng.normal(size=64)
    x = np.concatenate([centre / np.linalg.norm(centre) + rng.normal(size=(700, 64)) * 0.021, rng.normal(size=(60, 64))]).astype(np.float32)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(4)
    y = x.astype(np.float64)
    y /= np.linalg.norm(y, axis=1)[:, None]
    near = y @ y.T >= 0.95
    np.fill_diagonal(near, False)
    for block in (lattice.BLOCK, 100):
        found = {r.vec_id: r for r in lattice.near_duplicates(rows, block=block).collect()}
        assert [found[i].n_links for i in range(len(x))] == near.sum(axis=1).tolist()
        assert {found[i].component_id for i in range(700)} == {0} and all(found[i].kept == (near[i].sum() == 0 or i == 0) for i in range(len(x)))


def test_groups_of_cells_keep_all_pairs(spark):
    rng = random.Random(12)
    cells = [(v, c) for v in range(120) for c in {rng.randrange(40) if v % 2 else rng.randrange(4) for _ in range(6)}]
    sizes = Counter(c for _, c in cells)
    members = spark.createDataFrame([(v, c, sizes[c]) for v, c in cells if sizes[c] > 1], "v long, key long, n long")
    pairs = lambda rows: {(a, b) for k in {c for _, c in rows} for a, b in itertools.combinations(sorted(v for v, c in rows if c == k), 2)}
    got = [(r.v, r.key) for r in lattice.grouped_cells(members).collect()]
    assert pairs(got) >= pairs([(v, c) for v, c in cells]) and len(got) < len(cells)
    assert all(r.n == sum(k == r.key for _, k in got) for r in lattice.grouped_cells(members).collect())
