"""Resampling, extraction and the conversation trie against brute-force versions, on small tables with odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from factloom.llm import extraction, resampling, trie

DOCS = "doc_id long, text string, score double, rank int, _range string, n_words int, weight string"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def features(text, n):
    w = words(text)
    return [" ".join(w[i : i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)]


def drawn(docs, target, n, buckets, least, percent, seed):
    """Rows (doc_id, n_features, weight, score, rank) by the definition."""
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(bucket(f) for _, t in docs for f in features(t, n))
    t = Counter(bucket(f) for x in target for f in features(x, n))
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (s_all + buckets) / ((s[b] + 1.0) * (t_all + buckets))))
    rows = []
    for i, text in docs:
        found = features(text, n)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(f)) for f in found)
        rows.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(text))])
    ranked = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    place = Counter()
    for k, r in enumerate(ranked[: percent * len(ranked) // 100]):
        place[tuple(map(str, r[:4])), k + 1] += 1
    return Counter(tuple(map(str, r[:4])) for r in rows), place


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    vocabulary = ["the", "The", "quick", "brown", "Straße", "niño", "漢字", "x1", "2024", "fox", "É", "zz"]
    docs = [(i, rng.choice([" ", ", ", "\n", "--"]).join(rng.choice(vocabulary) for _ in range(rng.randint(1, 60)))) for i in range(90)]
    docs += [(90, None), (91, ""), (92, " ,.;\x00\x7f "), (93, docs[3][1]), (3, docs[3][1]), (94, "word " * 30_000), (95, "y" * 70_000), (None, docs[5][1]), (None, docs[5][1]), (2**63 - 1, docs[7][1]), (-4, docs[7][1])]
    return docs


@pytest.mark.parametrize("n, least, percent", [(1, 20, 10), (3, 5, 50), (2, 0, 100)])
def test_resampling_against_its_definition(spark, texts, n, least, percent):
    target = [None, "", "The quick brown fox", "Straße 漢字 x1 x1", "fox fox"]
    docs = spark.createDataFrame([(i, t, 1.0, 2, "r", 3, "w") for i, t in texts], DOCS)
    found = resampling.resampled(docs, spark.createDataFrame([(7, t) for t in target], "item_id int, text string"), n, 50, least, percent, 11)
    assert dict(found.dtypes) == {c: "bigint" for c in ("doc_id", "n_features", "weight", "score", "rank")}
    rows = [tuple(r) for r in found.collect()]
    want, place = drawn(texts, target, n, 50, least, percent, 11)
    assert Counter(tuple(map(str, r[:4])) for r in rows) == want
    # rows that agree in score and doc_id may come in any order among themselves
    assert Counter((tuple(map(str, r[:4])), r[4]) for r in rows if r[4] is not None) == place


def test_resampling_of_empty_tables(spark, texts):
    docs, none = spark.createDataFrame([(i, t, None, None, None, None, None) for i, t in texts], DOCS), spark.createDataFrame([], "text string")
    assert resampling.resampled(docs.limit(0), none).count() == 0
    rows = resampling.resampled(docs, none).collect()
    assert len(rows) == len(texts) and sum(r.rank is not None for r in rows) == sum(len(words(t)) >= 20 for _, t in texts) // 10


def test_checksums_in_pieces(monkeypatch):
    text = "Ab cd-éé 漢 " * 50 + "k" * 300 + " end"
    whole = Counter(c for n in (1, 4) for _, found in resampling.checksums(text.encode(), n) for c in found)
    assert whole == Counter(zlib.crc32(f.encode()) for n in (1, 4) for f in features(text, n))
    monkeypatch.setattr(resampling, "PIECE", 7)
    assert whole == Counter(c for n in (1, 4) for _, found in resampling.checksums(text.encode(), n) for c in found)
    assert sum(n for n, _ in resampling.checksums(text.encode(), 1)) == len(words(text))


# HTML extraction

CHROME = '<nav><a href="/">Home</a><a>News</a></nav>'


@pytest.mark.parametrize(
    "html, want",
    [
        ("<article>a<p>b</article>", [(0, "a"), (0, "b")]),
        ("<p>a &amp; b&nbsp;c &#233;&lt;i&gt; &am &amp", [(2, "a & b c é<i> &am &")]),
        ("<p>a\n \t<b>b</b>c<br>d<br/>e", [(2, "a bc"), (2, "d"), (2, "e")]),
        ("<article>t<aside>no</aside> yes<div class='share-bar'>no</div></article>z", [(0, "t"), (1, "no"), (0, "yes"), (1, "no"), (2, "z")]),
        ("<section id=comments><article>c</article></section>", [(1, "c")]),
        ("<main class='has-sidebar'><p class=ad>x<p>y<form>f</form></main>", [(1, "x"), (0, "y"), (1, "f")]),
        ("<div role=main>m<ul><li class='menu'>x<li>y</ul></div>", [(0, "m"), (1, "x"), (0, "y")]),
        ("<script>if (a < b) '</p>'</script>a<style>p{}</style><title>t</title>b<!-- c --><!-->d<!-- never closed", [(2, "abd")]),
        ("a</div></b>b<p", [(2, "a"), (2, "b")]),
        ("1 < 2 > 1 <a title='x > y'>k</a><a href=\"q>l", [(2, "1 < 2 > 1 kl")]),
        ("<div hidden>h</div><svg/><p>s<svg><text>t</text></svg>u", [(1, "h"), (2, "s"), (1, "t"), (2, "u")]),
        ("<script>never closed <p>x", []),
        ("", []),
    ],
)
def test_blocks(html, want):
    assert extraction.blocks(html) == want


def plain_extract(rows, run):
    """Texts by definition: windows of streams compared as word lists."""
    parsed = [extraction.blocks(h or "") for _, _, h in rows]
    seen = defaultdict(set)
    host = lambda u: (re.match(r"https?://([^/:]+)", u or "") or ["", ""])[1].lower()
    for (_, url, _), page in zip(rows, parsed):
        w = extraction.stream(page)
        for i in range(len(w) - run + 1):
            seen[host(url), tuple(w[i : i + run])].add(tuple(w))
    out = []
    for (i, url, _), page in zip(rows, parsed):
        w = extraction.stream(page)
        hit = {j for k in range(len(w) - run + 1) if len(seen[host(url), tuple(w[k : k + run])]) > 1 for j in range(k, k + run)}
        main, open_runs, at = [t for z, t in page if z == 0], [], 0
        for zone, text in page:
            if zone == 0:
                continue
            own = text.split()
            marks = [at + k in hit for k in range(len(own))]
            at += len(own)
            if zone == 2:
                pieces = [[]]
                for word, mark in zip(own, marks):
                    if mark:
                        pieces.append([])
                    else:
                        pieces[-1].append(word)
                open_runs += [" ".join(p) for p in pieces if len(p) >= (run if 2 * sum(marks) > len(own) else 1)]
        text = " ".join(main or open_runs)
        out.append((i, url, text, len(text)))
    return Counter(out)


def test_extraction_against_plain_windows(spark):
    rng = random.Random(3)
    some = lambda n: " ".join(rng.choice("ab cd ef gh ij kl mn op qr st".split()) + str(rng.randint(0, 400)) for _ in range(n))
    banner, notice = "This site is brought to you by its many readers", "All rights reserved by the Example Company of Exampletown since 1999"
    rows = []
    for i in range(40):
        host = "https://big.example.com/" if i % 3 else "http://Small.example.org:80/"
        open_page = f"<body>{CHROME}<div><p>{banner}</p></div><div><p>{some(20)}</p><p>{some(3)} {notice} {some(9)}</p></div><div>{notice}</div>"
        rows.append((i, host + str(i), open_page if i % 4 else f"<body><div>{banner}</div><article><h1>T{i}</h1><p>{notice}</p></article><p>{notice}</p>"))
    rows += [(40, rows[1][1], rows[1][2]), (40, rows[1][1], rows[1][2]), (41, "https://alone.example.net", rows[1][2]), (42, None, rows[2][2]), (43, "no url", None), (44, "https://big.example.com", ""), (None, None, "<p>x"), (45, "https://big.example.com", "<p>" + some(30_000))]
    rows.append((46, "https://copies.example.com/1", f"<p>{banner} {some(12)}"))
    rows += [(47, "https://copies.example.com/2", rows[-1][2])]  # equal streams are no repeat
    pages = spark.createDataFrame([(*r, "host", 1, "t") for r in rows], "page_id long, url string, html string, host string, row int, text string")
    found = Counter(tuple(r) for r in extraction.extracted(pages).collect())
    assert found == plain_extract(rows, extraction.RUN)
    by_id = {r[0]: r[2] for r in found}
    assert banner not in by_id[1] and notice not in by_id[1] and "Home" not in by_id[1]
    assert by_id[41].count(notice) == 2 and by_id[0] == f"T0 {notice}" and banner in by_id[46]
    assert (by_id[43], by_id[44], by_id[None]) == ("", "", "x")
    assert extraction.extracted(pages.limit(0)).count() == 0


def test_suffix_array_is_sorted_and_compares_neighbours(spark):
    rng, run = random.Random(5), 3
    words = {i: [rng.choice("abc") for _ in range(rng.randint(0, 40))] for i in range(30)}
    number = dict(zip("abc", (int(x) for x in extraction.numbers(list("abc")))))
    rows = [(i, i % 2, i, None if i % 3 else "article", [number[w] for w in ws]) for i, ws in words.items()]
    pages = spark.createDataFrame(rows, "row long, host long, stream long, text string, words array<long>")
    each = sorted((r.host, list(r.suffix), r.row, r.at, r.stream, r.asks) for r in extraction.suffixes(pages, run).collect())
    assert len(each) == sum(max(0, len(w) - run + 1) for w in words.values())
    hosts, matrix = np.array([e[0] for e in each]), np.array([e[1] for e in each])
    shared = [next((k for k in range(run) if a[1][k] != b[1][k]), run) if a[0] == b[0] else 0 for a, b in zip(each, each[1:])]
    assert extraction.shared_words(hosts, matrix).tolist() == shared
    seen = defaultdict(set)
    for host, suffix, _, _, stream, asks in each:
        seen[host, tuple(suffix)].add((stream, asks))
    want = {k for k, v in seen.items() if len(v) > 1 and any(a for _, a in v)}
    columns = [pa.array(c) for c in zip(*[(e[0], e[1], e[4], e[5]) for e in each])]
    whole = pa.RecordBatch.from_arrays(columns, ["host", "suffix", "stream", "asks"])
    for size in (1, 7, len(each)):  # intervals that end in another batch come in pieces
        pieces = defaultdict(list)
        for b in extraction.intervals(run)(iter([whole.slice(i, size) for i in range(0, len(each), size)])):
            for r in b.to_pylist():
                pieces[r["host"], tuple(r["suffix"])].append((r["lo"], r["hi"], r["asked"]))
        assert {k for k, v in pieces.items() if min(p[0] for p in v) < max(p[1] for p in v) and any(p[2] for p in v)} == want
    held = {r.row: sorted(r.held) for r in extraction.repeated(pages, run).collect()}
    plain = {r[0]: [k for k in range(len(r[4]) - run + 1) if (r[1], tuple(r[4][k : k + run])) in want] for r in rows if r[3] is None}
    assert held == {k: v for k, v in plain.items() if v}


def test_hosts(spark):
    urls = {"https://User:pw@WWW.a.org:81/x": "www.a.org", "http://b.c?x@y": "b.c", "ftp://[::1]:3/": "[::1]", "a.org/x": "", None: "", "": ""}
    rows = spark.createDataFrame([(u,) for u in urls], "u string").select("u", extraction.host_of(F.col("u")).alias("h")).collect()
    assert {r.u: r.h for r in rows} == urls


# conversations


def plain_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, trie_digest(role, text), role or "", text or ""))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    seqs = {}
    for c, mine in own.items():
        h, base = zlib.crc32(str(c).encode()) % 6, c - int(math.fmod(c, 100))
        seqs[c] = own.get(base, [])[:h] + mine[h:]
    members = defaultdict(list)
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    children = Counter(k[:-1] for k in members if k)
    leaves, saved = Counter(), Counter()
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += children[k] == 0
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1]) if k else 0
    sha = lambda k: hashlib.sha256(",".join(str(c) for c in sorted(members[k]) if len(seqs[c]) == len(k)).encode()).hexdigest()
    return Counter((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), children[k], leaves[k], saved[k], sha(k)) for k, m in members.items())


def trie_digest(role, text):
    role, text = role or "", text or ""
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()


CONVERSATIONS = "conv_id long, turn long, role string, text string, node int, n int, pos string"


def test_trie_against_plain_prefixes(spark):
    rng = random.Random(9)
    rows = []
    for c in [*range(0, 60), *range(100, 130), 205, 206, 207, -3, 2**62]:
        first = rng.choice(["hello", "Grüße", ""])
        for t in range(rng.choice([1, 2, 3, 5, 9])):
            rows.append((c, t, rng.choice(["user", "assistant"]) if t > 2 else "user", first if t == 0 else rng.choice(["a", "bb", "漢字", None])))
    for c in range(300, 330):  # copies of one conversation, but for its family's head
        rows += [(c, t, "user", f"same {t}") for t in range(12)]
    rows += [(400, t, None, None) for t in range(3)] + [(401, None, "user", "null turn"), (401, 0, "user", "x"), (401, 0, "user", "y"), (401, 0, "user", "y")]
    rows += [(None, 0, "user", "lost"), (500, 0, "", "r:x"), (502, 0, "r", ":x")]
    rows += [(503, t, "user", "z" * 50_000) for t in range(2)]
    frame = spark.createDataFrame([(*r, 1, 2, "p") for r in rows], CONVERSATIONS).repartition(3)
    found = trie.trie(frame)
    assert found.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert Counter(tuple(r) for r in found.collect()) == plain_trie(rows)


def test_trie_of_few_rows(spark):
    frame = lambda rows: spark.createDataFrame([(*r, None, None, None) for r in rows], CONVERSATIONS)
    assert trie.trie(frame([])).count() == 0 and trie.trie(frame([(None, 1, "a", "b")])).count() == 0
    for rows in ([(7, 0, "a", "b")], [(1, 0, "a", "b")], [(100, t, "a", "b") for t in range(150)]):
        assert Counter(tuple(r) for r in trie.trie(frame(rows)).collect()) == plain_trie(rows)


def test_digests_of_ends_in_pieces(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(trie, "PIECE", 9)
    ids = {b"a": list(range(-5, 40)), b"b": [7], b"c": [10**12, 10**12 + 1]}
    rows = [{"node": k, "conv_id": c} for k, v in ids.items() for c in v]
    cut = [pa.RecordBatch.from_pylist(rows[i : i + 4], pa.schema([("node", pa.binary()), ("conv_id", pa.int64())])) for i in range(0, len(rows), 4)]
    pieces = list(trie._joined(iter(cut)))
    assert len(pieces) > 5
    found = [(r["node"], r["ends_sha256"]) for b in trie._digests(iter(pieces)) for r in b.to_pylist()]
    assert found == [(k, hashlib.sha256(",".join(map(str, v)).encode()).hexdigest()) for k, v in ids.items()]
