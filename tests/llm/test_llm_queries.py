"""The registered queries, column by column, against brute force on a small set of tables with odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import tiktoken

import public_tokenizers
from factloom.llm import bpe, media, mixing, queries

LANGS = {"en": "the quick brown fox jumps over lazy dogs and runs", "de": "über straße und die große mühle läuft schön", "es": "el niño señor corazón está mañana aquí también"}


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    """A folder of documents, labels and pages: nulls, empty and long texts, repeats; doc_ids 0 to 239."""
    rng, at = random.Random(11), tmp_path_factory.mktemp("sf")
    docs = []
    for i in range(220):
        lang = list(LANGS)[i % 3]
        words = [rng.choice(LANGS[lang].split()) + rng.choice(["", "", "s"]) for _ in range(rng.randint(5, 60))]
        if i % 7 == 0:
            words += ["grobfies", "schmutzel"]
        if i % 5 == 0:
            words = [words[0]] * 40
        docs.append((i, " ".join(words), None if i % 11 == 0 else lang, rng.choice(["web", "web", "books", None])))
    docs += [(220, None, "en", "web"), (221, "", "en", None), (222, " \t\n", None, "books"), (223, "12 34 !!", "de", "web"), (224, docs[3][1], "en", "web"), (225, "long word " * 40_000, "en", "web")]
    docs += [(226, "漢字かな交じり文" * 50, None, "books"), (227, "x" * 64, "en", "web")]
    ids, texts, langs, sources = map(list, zip(*docs))
    pq.write_table(pa.table({"doc_id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.string()), "lang": pa.array(langs, pa.string()), "source": pa.array(sources, pa.string()), "n_chars": pa.array([len(t or "") for t in texts], pa.int64())}), at / "documents.parquet")
    some = [i for i in range(220) if i % 9]
    pq.write_table(pa.table({"doc_id": pa.array(some, pa.int64()), "quality": pa.array([int(i % 5 > 0) for i in some], pa.int32()), "toxic": pa.array([int(i % 7 == 0) for i in some], pa.int32())}), at / "labels.parquet")
    return str(at), {i: (t, lang, s) for i, t, lang, s in docs}


def fold(i, modulus):
    return zlib.crc32(str(i).encode()) % modulus


@pytest.mark.parametrize("name, modulus, held_out, wanted", [("op1_quality", 4, 2, lambda i: i % 5 > 0), ("op10_toxicity", 3, 1, lambda i: i % 7 == 0)])
def test_classifier_queries(spark, tables, tmp_path, name, modulus, held_out, wanted):
    path, docs = tables
    run = lambda at: {r.doc_id: r for r in queries.QUERIES[name](spark, at).collect()}
    rows = run(path)
    assert set(rows) == set(docs)
    for i, r in rows.items():
        assert r.held_out == (fold(i, modulus) == held_out) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    unseen = [i for i in range(220) if fold(i, modulus) == held_out]
    right = sum((rows[i].score > 0.5) == wanted(i) for i in unseen)
    assert right >= 0.95 * len(unseen)
    assert rows[220].score == rows[221].score == run(path)[220].score
    # held-out labels, sources and languages change nothing
    labels = pq.read_table(f"{path}/labels.parquet").to_pandas()
    hidden = labels.doc_id.map(lambda i: fold(i, modulus) == held_out)
    for c in ("quality", "toxic"):
        labels.loc[hidden, c] = 1 - labels.loc[hidden, c]
    pq.write_table(pa.Table.from_pandas(labels, preserve_index=False), tmp_path / "labels.parquet")
    table = pq.read_table(f"{path}/documents.parquet")
    pq.write_table(table.set_column(2, "lang", pa.nulls(len(table), pa.string())).set_column(3, "source", pa.array(["other"] * len(table))), tmp_path / "documents.parquet")
    again = run(str(tmp_path))
    assert all(abs(again[i].score - rows[i].score) < 1e-12 for i in rows)


def test_language_query_against_plain_profiles(spark, tables):
    path, docs = tables

    def grams(text):
        padded = re.sub(r"_+", "_", "_" + "".join(c if c.isalpha() else "_" for c in (text or "").lower()) + "_")
        found = Counter(padded[k : k + n] for n in (1, 2, 3) for k in range(len(padded) - n + 1))
        return Counter({g: n for g, n in found.items() if g != "_" and not (len(g) == 3 and g[1] == "_")}) if padded != "_" else Counter()

    order = lambda found: [g for g, _ in sorted(found.items(), key=lambda x: (-x[1], [0 if c == "_" else ord(c) for c in x[0]]))]
    seen = defaultdict(Counter)
    for i, (text, lang, _) in docs.items():
        if lang and text is not None and fold(i, 4) != 2:
            seen[lang].update(grams(text))
    ranks = {lang: {g: k for k, g in enumerate(order(found)[:300])} for lang, found in sorted(seen.items())}
    for r in queries.op3_langid(spark, path).collect():
        assert r.held_out == (fold(r.doc_id, 4) == 2)
        mine = order(grams(docs[r.doc_id][0]))[:300]
        if not mine:
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        away = {lang: sum(abs(known[g] - k) if g in known else 300 for k, g in enumerate(mine)) for lang, known in ranks.items()}
        best = min(away, key=lambda x: (away[x], x))
        assert r.lang_pred == best and abs(r.score - (1 - away[best] / (300 * len(mine)))) < 1e-9


def test_media_query(spark, tables):
    path, docs = tables
    rows = queries.op4_media(spark, path).collect()
    assert Counter(r.doc_id for r in rows) == Counter(docs.keys())
    for r in rows:
        raw = (docs[r.doc_id][0] or "").encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        stored = media.to_png(raw)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        x = np.frombuffer(payload, np.uint8).astype(float)
        p = np.array([c / len(x) for c in Counter(x.tolist()).values()])
        want = {"mean": x.mean(), "deviation": x.std(), "entropy": -(p * np.log2(p)).sum(), "step": np.abs(np.diff(x)).mean()}
        got = {k: float(v) for k, v in (part.split("=") for part in r.feature.split(";"))}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-4 for k in want)
    assert len({r.media_sha256 for r in rows if r.doc_id in (220, 221)}) == 1


def test_mixing_query(spark, tables):
    path, docs = tables
    rows = queries.op6_mixing(spark, path).collect()
    assert sorted(map(str, rows)) == sorted(map(str, queries.op6_mixing(spark, path).collect()))
    sizes = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, (t, _, _) in docs.items()}
    total, taken = Counter(), Counter()
    for i, (_, _, s) in docs.items():
        total[s] += sizes[i]
    order = sorted(total, key=lambda s: (s is None, (s or "").encode()))
    goals = dict(zip(order, mixing.targets([total[s] for s in order], [(3, 1, 2)[k % 3] for k in range(len(order))], 1.5, 2)))
    for r in rows:
        s = docs[r.doc_id][2]
        assert (r.size, r.source_size) == (sizes[r.doc_id], total[s]) and abs(r.target - goals[s]) < 1e-6 and 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
    assert len(rows) == len(docs) and all(abs(taken[s] - goals[s]) <= max(5, 0.01 * goals[s]) for s in goals)


def test_sharding_query(spark, tables):
    path, docs = tables
    rows = queries.op8_sharding(spark, path).collect()
    slots = defaultdict(list)
    for r in rows:
        raw = (docs[r.doc_id][0] or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 8, zlib.crc32(raw), "key") and 0 <= r.shard < 24 and r.grown_shard in (r.shard, 24)
        slots[r.shard].append(r.slot)
    assert len(rows) == len(docs) and all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_bpe_query(spark, tables):
    path, docs = tables
    ranks = bpe.ranks_of(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = queries.op9_bpe(spark, path).collect()
    assert Counter(r.doc_id for r in rows) == Counter(docs.keys())
    for r in rows:
        text = docs[r.doc_id][0] or ""
        ids = np.array(enc.encode_ordinary(text), "<u4")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
