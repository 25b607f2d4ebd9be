"""Operators on texts against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing names."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from lodestone.llm import audio, bpe, cuckoo, langid, line_dedup, mixing, paragraphs, pii, prefix_free, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ("ids", "decoded", "copy", "mix_key", "n_lines", "n_dropped", "fingerprint", "component_id", "lang_id", "lang_confidence", "lang_keep", "extra", "th", "doc", "_x")


def sha(b):
    return hashlib.sha256(b if isinstance(b, bytes) else b.encode()).hexdigest()


def words(rng, n, size=400):
    return [f"w{rng.randrange(size)}" for _ in range(n)]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    passage, line = " ".join(words(rng, 80)), "A line that many a document holds, word for word"
    base = " ".join(words(rng, 150))
    near = base.split()
    near[70] = "changed"
    rows = [(i, "\n".join([" ".join(words(rng, rng.randrange(1, 60))), line if i % 3 else line.upper() + "  ", *([passage] if i % 5 == 0 else []), " ".join(words(rng, 30))]), "en", "src0" if i % 2 else "src1", 5) for i in range(40)]
    rows += [(40, base, "en", "src2", 1), (41, " ".join(near), "en", "src2", 1), (42, base, None, None, None), (43, None, None, None, None), (44, "", "xx", "", 0), (45, " \t\n \n", "de", "src3", 4), (46, "é中\U0001f600 " * 50, "fr", "src3", 9), (47, "a" * 3000, "en", "src0", 3000)]
    rows += [(48, " ".join(words(rng, 9000)) + "\n" + passage, "en", "src0", 1), (49, "one two", "en", "src0", 7), (49, "one two", "en", "src0", 7), (None, base, "en", "src0", 3), (50, "thhaen " * 300, "en", "src0", 3), (51, "Mail me: ana.b@x.example.org or +56 9 1234 5678 or 4111 1111 1111 1111, 10.0.0.255\n999.1.1.1", "es", "src1", 3)]
    return rows


@pytest.fixture(scope="module")
def docs(spark, corpus):
    df = spark.createDataFrame(corpus, SCHEMA).repartition(5)
    return df.withColumns({c: F.lit("clash") for c in CLASH}).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def test_bpe(docs, empty, corpus):
    enc = bpe._encoding(bpe._default_path(), bpe._default_pattern())
    for size, lap in ((32768, 1024), (400, 60), (64, 24)):
        out = bpe.decode(bpe.encode(docs, chunk_chars=size, overlap=lap))
        want = sorted(((i, enc.encode_ordinary(t or ""), bytearray((t or "").encode())) for i, t, *_ in corpus), key=repr)
        assert rows_of(out, "doc_id", "ids", "decoded") == want
    assert bpe.decode(bpe.encode(empty)).count() == 0


def test_bpe_boundaries(spark):
    rng = random.Random(1)
    enc = bpe._encoding(bpe._default_path(), bpe._default_pattern())
    texts = ["".join(rng.choice(["a", "b", " ", "  ", "\n", "'re", "'", "ll", "1", "é", "!", "　", "x" * 90]) for _ in range(rng.randrange(50, 400))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: list(r["ids"]) for r in bpe.encode(df, chunk_chars=70, overlap=30).collect()}
    assert got == {i: enc.encode_ordinary(t) for i, t in enumerate(texts)}


def test_line_dedup(docs, empty, corpus):
    def key(line):
        k = re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", line)
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in k)

    held = collections.defaultdict(set)
    for i, t, *_ in corpus:
        for line in (t or "").split("\n"):
            held[key(line)].add(i)
    drop = {k: max((x for x in v if x is not None), default=None) for k, v in held.items() if len(k) >= 20 and len(v) >= 3}
    want = []
    for i, t, *_ in corpus:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in drop or drop[key(x)] == i]
        want.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    assert rows_of(line_dedup.line_dedup(docs), "doc_id", "text", "n_lines", "n_dropped") == sorted(want, key=repr)
    assert line_dedup.line_dedup(empty).count() == 0


def test_line_dedup_is_reversible(spark, docs, corpus):
    state = lambda ix: (rows_of(ix.counts, "h1", "h2", "n_docs", "last_doc"), rows_of(ix.postings, "h1", "h2", "doc"))
    old, new = docs.where("doc_id < 30 or doc_id is null"), docs.where("doc_id >= 30")
    first = line_dedup.build(old)
    both = line_dedup.insert(first, new)
    whole = line_dedup.build(docs)
    assert state(both) == state(whole)
    assert rows_of(line_dedup.clean(docs, both), "doc_id", "text") == rows_of(line_dedup.clean(docs, whole), "doc_id", "text")
    back = line_dedup.delete(both, new.select("doc_id"))
    assert state(back) == state(first)
    assert rows_of(line_dedup.clean(old, back), "doc_id", "text") == rows_of(line_dedup.clean(old, first), "doc_id", "text")
    assert state(line_dedup.insert(first, old.where("doc_id < 3"))) == state(first)


def test_line_index_grows(spark, monkeypatch):
    """Shards that overflow are made anew, and more keys get more shards; filters hold all that is droppable."""
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 60)
    text = lambda a, b: "\n".join(f"line number {i} of all that there are" for i in range(a, b))
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    index = line_dedup.build(frame([(i, text(0, 50)) for i in range(3)]))
    assert index.shards == 1
    grown = line_dedup.insert(index, frame([(10 + i, text(40, 2000)) for i in range(3)]))
    assert grown.shards == 34
    same = line_dedup.insert(grown, frame([(20 + i, text(1990, 3500)) for i in range(3)]))  # the shards stay, some filters overflow
    assert same.shards == 34
    for ix in (grown, same):
        filters = {r["shard"]: cuckoo.CuckooFilter.from_bytes(bytes(r["filter"])) for r in ix.filters.collect()}
        import numpy as np

        for r in ix.counts.where("n_docs >= 3").collect():
            assert filters[r["h1"] % ix.shards].contains(np.array([r["h2"]]))[0]
    docs = frame([(1, text(0, 3500) + "\nown line"), (99, text(0, 3400))])
    out = {r["doc_id"]: (r["text"], r["n_dropped"]) for r in line_dedup.clean(docs, same).collect()}
    assert out[1][0] == "own line" and out[99] == ("", 3400)
    few = {r["doc_id"]: r["text"] for r in line_dedup.clean(docs, line_dedup.delete(same, frame([(i, "") for i in (20, 21, 22)]).select("doc_id"))).collect()}
    assert few[1].split("\n") == [*text(2000, 3500).split("\n"), "own line"]


def test_cuckoo_filter():
    import numpy as np

    rng = np.random.default_rng(0)
    members, strangers = np.unique(rng.integers(-(2**63), 2**63, 5000)), rng.integers(-(2**63), 2**63, 20000)
    f = cuckoo.CuckooFilter.from_bytes(cuckoo.built(members).to_bytes())
    assert f.contains(members).all() and f.contains(strangers).mean() < 0.002
    f.remove(members[:2500])
    assert f.contains(members[2500:]).all() and f.contains(members[:2500]).mean() < 0.01
    assert not cuckoo.CuckooFilter.sized(8).add(members)


def brute_fingerprint(text):
    from xxhash import xxh64_intdigest

    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    hs = [xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


@pytest.mark.parametrize("tree", [4096, 1])
def test_simhash(docs, empty, corpus, monkeypatch, tree):
    monkeypatch.setattr(simhash, "TREE", tree)
    prints = [(i, brute_fingerprint(t)) for i, t, *_ in corpus]
    distinct = sorted({p for _, p in prints})
    top = {p: p for p in distinct}

    def root(p):
        while top[p] != p:
            p = top[p]
        return p

    for a, b in itertools.combinations(distinct, 2):
        if (a ^ b).bit_count() <= 2:
            top[root(a)] = root(b)
    first = collections.defaultdict(list)
    for i, p in prints:
        first[root(p)].append(i)
    want = sorted([(i, f"{p:016x}", min((x for x in first[root(p)] if x is not None), default=None)) for i, p in prints], key=repr)
    assert rows_of(simhash.simhash_groups(docs), "doc_id", "fingerprint", "component_id") == want
    assert simhash.simhash_groups(empty).count() == 0
    kept = [r["doc_id"] for r in simhash.near_dedup(docs).collect()]
    alone = {root(p) for p in distinct if not [x for x in first[root(p)] if x is not None]}
    assert sorted(kept, key=repr) == sorted([*{w[2] for w in want if w[2] is not None}, *[None] * len(alone)], key=repr)


def test_simhash_keeps_one_of_each_group(spark):
    """Null ids, an id that several texts share, and repeated rows."""
    rng = random.Random(7)
    texts = [" ".join(words(rng, 60, 10**6)) for _ in range(5)]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[1]), (5, texts[2]), (5, texts[3]), (6, texts[4]), (6, texts[4]), (None, texts[4]), (8, ""), (9, None)]
    out = sorted(((r["doc_id"], r["text"]) for r in simhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    assert out == sorted([(None, texts[0]), (None, texts[1]), (5, texts[2]), (5, texts[3]), (6, texts[4]), (8, "")], key=repr)


def test_simhash_very_long_text(spark, monkeypatch):
    """Blocks of text and of shingles are seams that no result shows."""
    rng = random.Random(17)
    text = " ".join(words(rng, 3000)) + "\n" + "x" * 900 + "  " + " ".join(words(rng, 10)) + " "
    whole = simhash.fingerprint(text.encode())
    monkeypatch.setattr(simhash, "BLOCK", 64)
    monkeypatch.setattr(simhash, "MANY", 100)
    assert simhash.fingerprint(text.encode()) == whole == brute_fingerprint(text)


def test_simhash_planted(spark):
    rng = random.Random(2)
    seeds = [rng.getrandbits(64) for _ in range(40)]
    prints = {x ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for x in seeds for _ in range(20)} | set(seeds)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(x),) for x in prints], "fp long")
    from lodestone.llm.components import components

    got = collections.defaultdict(set)
    for r in components(simhash.links(df)).collect():
        got[r["root"]].add(r["node"])
    groups = sorted(sorted(v | {k}) for k, v in got.items())
    top = {x: x for x in prints}

    def root(p):
        while top[p] != p:
            p = top[p]
        return p

    for a, b in itertools.combinations(sorted(prints), 2):
        if (a ^ b).bit_count() <= 2:
            top[root(a)] = root(b)
    want = collections.defaultdict(set)
    for x in prints:
        want[root(x)].add(signed(x))
    assert groups == sorted(sorted(v) for v in want.values() if len(v) > 1)


def test_bk_tree():
    rng = random.Random(3)
    tree, all_ = simhash.BKTree(), [rng.getrandbits(12) for _ in range(200)]
    for x in dict.fromkeys(all_):
        tree.add(x)
    for q in range(0, 4096, 97):
        for r in (0, 1, 3):
            assert sorted(tree.prints[i] for i in tree.near(q, r)) == sorted(x for x in set(all_) if (x ^ q).bit_count() <= r)


def test_suffix_ranks():
    import numpy as np

    rng = random.Random(2)
    raw = bytes(rng.randrange(2) for _ in range(300)) * 3 + bytes(rng.randrange(256) for _ in range(400)) + b"\0" * 450 + b"\xff" * 300
    rank = prefix_free.suffix_ranks(np.frombuffer(raw, np.uint8))
    heads = [raw[i : i + 200] for i in range(len(raw) - 199)]
    order = sorted(range(len(heads)), key=lambda i: heads[i])
    assert len(rank) == len(heads)
    assert all((heads[a] == heads[b]) == (rank[a] == rank[b]) and rank[a] <= rank[b] for a, b in itertools.pairwise(order))


@pytest.mark.parametrize("group", [4096, 1])
def test_prefix_free(docs, empty, corpus, monkeypatch, group):
    monkeypatch.setattr(prefix_free, "GROUP", group)
    texts = [(i, (t or "").encode()) for i, t, *_ in corpus]
    n = collections.Counter(b[i : i + 200] for _, b in texts for i in range(len(b) - 199))
    want = []
    for i, b in texts:
        gone = bytearray(len(b))
        for at in range(len(b) - 199):
            if n[b[at : at + 200]] > 1:
                gone[at : at + 200] = b"\1" * 200
        want.append((i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), sha(bytes(x for x, g in zip(b, gone) if not g))))
    got = [(r["doc_id"], r["n_bytes"], r["n_removed"], len(r["spans"]), sha(bytes(r["kept"]))) for r in prefix_free.remove_repeats(docs).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert prefix_free.remove_repeats(empty).count() == 0


def test_prefix_free_long_text(spark, monkeypatch):
    rng = random.Random(9)
    long = bytes(rng.randrange(97, 123) for _ in range(400_000)).decode()
    rows = [(1, long), (2, "x" + long[131_000:131_900] + "y"), (3, long[:150] + "z")]
    out = {r["doc_id"]: (r["n_removed"], [tuple(s) for s in r["spans"]]) for r in prefix_free.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {1: (900, [(131_000, 131_900)]), 2: (900, [(1, 901)]), 3: (0, [])}


def test_units(monkeypatch):
    """Lines, blocks and tiny texts of any texts, with words across the seams of what is hashed together, against a plain reading."""
    import numpy as np

    rng = random.Random(41)
    bits = ["a", "Bb", "ccc ", " ", " ", "\t", "\n", "\n\n", "d e f g h ", "é ", "x" * 30, "one two three four five six seven eight nine ten ", "\u00a0"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(0, 60))).encode() for _ in range(300)] + [b"", b"a b", b" A  B\n", b"same words in all five", b"Same\nwords in all\nFIVE"]
    edges = np.cumsum([0, *map(len, texts)])

    def read(raw):
        runs, lines, run, at, total = [], [], [], 0, raw.lower().split()
        for line in raw.split(b"\n"):
            n = len(line.split())
            lines += [(at, at + len(line), n)] if n >= 5 else []
            if 0 < n < 20:
                run.append((at, at + len(line), n))
            else:
                runs.append(run)
                run = []
            at += len(line) + 1
        blocks = [(r[0][0], r[-1][1], sum(n for *_, n in r)) for r in [*runs, run] if len(r) > 1 and sum(n for *_, n in r) >= 5]
        tiny = [(len(raw) - len(raw.lstrip()), len(raw.rstrip()), len(total))] if 0 < len(total) < 5 else []
        return lines, blocks, tiny

    by_words = {}
    for piece in (7, 1 << 16):
        monkeypatch.setattr(paragraphs, "PIECE", piece)
        w, kinds = paragraphs.units_of(np.frombuffer(b"".join(texts), np.uint8), edges)
        for place, (text, start, end, first, after, stop, _) in enumerate(kinds):
            got = collections.defaultdict(list)
            pids = paragraphs._sequences(w.hash, first, after)
            for t, a, b, i, j, k, pid in zip(text, start, end, first, after, stop, pids, strict=True):
                got[t].append((a - edges[t], b - edges[t], j - i))
                own = tuple(texts[t][a - edges[t] : b - edges[t]].lower().split())
                assert by_words.setdefault(own, (pid, tuple(w.shingle[i:k]))) == (pid, tuple(w.shingle[i:k])) and k - i == max(1, len(own) - 4)
            assert all(got[t] == read(raw)[place] for t, raw in enumerate(texts))
    assert len({pid for pid, _ in by_words.values()}) == len(by_words)
    grams = {}
    for own, (_, hashes) in by_words.items():
        for k, h in enumerate(hashes):
            assert grams.setdefault(own[k : k + 5], h) == h
    assert len(set(grams.values())) == len(grams)


def test_paragraphs(docs, empty, corpus):
    out = {(r["doc_id"], sha(r["kept"])): r for r in paragraphs.paragraph_dedup(docs).collect()}
    units = []
    for i, t, *_ in corpus:
        for line in (t or "").split("\n"):
            w = line.lower().split()
            if len(w) >= paragraphs.MIN_WORDS:
                units.append((i, {tuple(w[k : k + 5]) for k in range(len(w) - 4)}))
    assert sum(r["n_paragraphs"] for r in out.values()) == len(units)
    removed = sum(r["n_removed"] for r in out.values())
    top = list(range(len(units)))

    def root(k):
        while top[k] != k:
            k = top[k]
        return k

    for a, b in itertools.combinations(range(len(units)), 2):
        x, y = units[a][1], units[b][1]
        if len(x & y) >= 0.8 * len(x | y):
            top[root(a)] = root(b)
    assert removed == len(units) - len({root(k) for k in range(len(units))})
    kept_passage = [i for (i, _), r in out.items() if i is not None and i % 5 == 0 and i < 40 and r["n_removed"] == 0]
    assert kept_passage == [0]
    assert paragraphs.paragraph_dedup(empty).count() == 0


def test_passages_inside_lines(spark):
    rng = random.Random(12)
    passage = words(rng, 52, 10**6)
    rows = [(i, " ".join(words(rng, 37 + 5 * i, 10**6) + (passage if i % 2 else []) + words(rng, 90, 10**6))) for i in range(10)]
    rows += [(20, " ".join(words(rng, 60_000, 10**6) + passage + words(rng, 60_000, 10**6))), (21, "same " * 400), (22, " ".join(passage[:29]))]
    out = {r["doc_id"]: r for r in paragraphs.paragraph_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    texts = dict(rows)
    hit = {i for i, r in out.items() if r["n_passages"]}
    assert hit == {3, 5, 7, 9, 20} and all(out[i]["class_ids"] == [1] and out[i]["n_passages"] == 1 for i in hit)
    for i in hit:
        (a, b), = [(s["start"], s["end"]) for s in out[i]["spans"]]
        assert texts[i][a:b] in " ".join(passage) and len(texts[i][a:b].split()) >= 30
        assert out[i]["kept"] == texts[i][:a] + texts[i][b:]
    assert all(out[i]["kept"] == texts[i] for i in out if i not in hit)


def test_short_lines(spark):
    rng = random.Random(21)
    verse = words(rng, 28, 10**6)
    lines = lambda w, n: "\n".join(" ".join(w[i : i + n]) for i in range(0, len(w), n))
    changed = [*verse[:27], "other"]
    rows = [(1, lines(verse, 4)), (2, lines(verse, 4)), (3, lines(changed, 3)), (4, " ".join(verse)), (5, " ".join(words(rng, 60, 10**6)) + "\n\n" + lines(verse, 4) + "\n\n" + " ".join(words(rng, 60, 10**6)))]
    rows += [(6, "One two three"), (7, " one  two\nTHREE"), (8, "one three two"), (10, " ".join(verse[:7])), (11, " ".join(verse[:7]).upper()), (12, " ".join(words(rng, 7, 10**6)))]
    out = {r["doc_id"]: r for r in paragraphs.paragraph_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    texts = dict(rows)
    assert all(out[i]["kept"].strip() == "" and out[i]["class_ids"] == [of] for i, of in ((2, 1), (3, 1), (4, 1), (7, 6), (11, 10)))
    assert out[5]["class_ids"] == [1] and out[5]["kept"] == texts[5].replace(lines(verse, 4) + "\n", "")
    assert all(out[i]["kept"] == texts[i] and out[i]["class_ids"] == [] for i in (1, 6, 8, 10, 12))


@pytest.mark.parametrize("exact", (512, 40))
def test_large_buckets(spark, monkeypatch, exact):
    """Pairs that only one member of a bucket joins, whatever order it is met in; against brute force."""
    monkeypatch.setattr(paragraphs, "EXACT", exact)
    rng, sets = random.Random(31), []
    for g in range(4):
        base = [rng.randrange(2**62) for _ in range(100)]
        sets += [sorted(base[:-1] + [rng.randrange(2**62)]) for _ in range(60 - g * 15)]
        for _ in range(50):  # chains: a like the group, b like a only, c like b only
            own = [[rng.randrange(2**62) for _ in range(10)] for _ in range(3)]
            sets += [sorted(base[:90] + own[0]), sorted(base[:80] + own[0] + own[1]), sorted(base[:70] + own[0] + own[1] + own[2])]
    n = len(sets)
    top = list(range(n))

    def root(k):
        while top[k] != k:
            k = top[k]
        return k

    kinds = [set(x) for x in sets]
    for a, b in itertools.combinations(range(n), 2):
        both = len(kinds[a] & kinds[b])
        if both >= 0.8 * (200 - both):
            top[root(a)] = root(b)
    members = spark.createDataFrame([(7, i, n) for i in range(n)], "band long, pid long, n long")
    edges = paragraphs.band_links(members, spark.createDataFrame(list(enumerate(sets)), "pid long, shingles array<long>")).collect()
    assert all(root(e["a"]) == root(e["b"]) for e in edges)
    want = len({root(k) for k in range(n)})
    top = list(range(n))
    for e in edges:
        top[root(e["a"])] = root(e["b"])
    assert n > 512 and len({root(k) for k in range(n)}) == want


def test_paragraph_recall(spark):
    rng = random.Random(8)
    rows = []
    for g in range(60):
        base = words(rng, 120, 5000)
        for c in range(6):
            w = list(base)
            for _ in range(c and 1 + c % 2):
                w[rng.randrange(len(w))] = f"z{rng.randrange(10**6)}"
            rows.append((g * 10 + c, " ".join(w)))
    out = paragraphs.paragraph_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sum(r["n_removed"] for r in out) >= 0.99 * 60 * 5
    assert all(r["n_removed"] == 0 for r in out if r["doc_id"] % 10 == 0)


def test_audio(docs, empty, corpus):
    got = audio.audio_features(docs).collect()
    assert len(got) == len(corpus)
    by_text = {}
    texts = collections.defaultdict(list)
    for i, t, *_ in corpus:
        texts[i].append((t or "").encode())
    for r in got:
        raw = texts[r["doc_id"]][0]
        padded = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert bytes(r["payload"]) == padded and r["n_bytes"] == len(raw) and audio.samples_of(bytes(r["media"])) == padded
        table = audio.from_arrow(bytes(r["tensors"]))
        assert table.schema.field("tensor").type.shape == [audio.POOL, audio.MELS]
        assert by_text.setdefault(padded, (r["feature"], bytes(r["tensors"]))) == (r["feature"], bytes(r["tensors"]))
    assert audio.audio_features(empty).count() == 0
    assert zlib.crc32(b"\0" * 64) > 0


def test_resampling_blocks(monkeypatch):
    import numpy as np

    x = np.random.default_rng(0).integers(0, 256, 5000).astype(np.uint8)
    whole, frames = audio.resampled(x), audio.log_mel(audio.resampled(x))
    monkeypatch.setattr(audio, "BLOCK", 128)
    monkeypatch.setattr(audio, "FRAMES", 7)
    assert len(whole) == -(-len(x) * audio.UP // audio.DOWN)
    assert np.allclose(audio.resampled(x), whole, atol=1e-5) and np.allclose(audio.log_mel(whole), frames, atol=1e-4)
    assert np.allclose(audio.resampled(np.full(900, 192, np.uint8))[50:-50], 0.5, atol=0.05)


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_spans(text):
    def luhn(d):
        return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10 == 0

    out = []
    for k, (name, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            if (name == "ip" and any(int(p) > 255 for p in m[0].split("."))) or (name == "card" and not (12 <= len(d) <= 19 and luhn(d))) or (name == "phone" and not 9 <= len(d) <= 15):
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans_match_the_patterns():
    rng = random.Random(6)
    bits = ["a", "B.c", "@", "@x.org", ".", "..", "-", "+56 9", "4111 1111 1111 1111", "4111111111111111", "1", "255", "256.1", "10.0.0.1", " ", "\n", "(2)", "é", "%", "x@y", "00000000000000000001.2.3.4"]
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(1, 14)))
        assert pii.base_spans(text) == brute_spans(text), text
    assert pii.base_spans("0" * 5000 + ".1.2.3") == [(0, 1, 5006)]
    assert pii.base_spans("9" * 5000 + ".1.2.3 and 0256.1.1.1 and 00255.0.0.0") == [(5026, 1, 5037)]


def test_pii_field_is_the_same_on_any_partitioning(docs):
    a, b = pii.fit(docs), pii.fit(docs.repartition(7))
    assert all((x == y).all() for x, y in zip(a, b, strict=True))


def test_pii_finds_masked_mentions(spark):
    """Mentions that no pattern matches, in texts that the field was not fitted on, take the label of their likes; other numbers stay out."""
    rng = random.Random(14)
    phone = lambda: f"+{rng.randrange(1, 99)} ({rng.randrange(100, 999)}) {rng.randrange(100, 999)}-{rng.randrange(1000, 9999)}"
    address = lambda: ".".join(str(rng.randrange(1, 255)) for _ in range(4))
    mail = lambda: f"{rng.choice('abcdef')}{rng.randrange(10**5)}.{rng.choice('xyz')}@mail{rng.randrange(9)}.example.com"
    numbers = lambda: rng.choice([f"{rng.randrange(99)} apples", f"A{rng.randrange(999)}", f"{rng.randrange(99)}%", f"{rng.randrange(24)}:30", f"{rng.randrange(2000)}"])

    def text():
        parts = [rng.choice([phone, address, mail, numbers, numbers, numbers])() for _ in range(rng.randrange(1, 6))]
        parts += [p for p in parts if rng.random() < 0.4]
        rng.shuffle(parts)
        return " and then ".join(parts)

    field = pii.fit(spark.createDataFrame([(i, text()) for i in range(300)], "doc_id long, text string"))
    found = wrong = 0
    for _ in range(60):
        m, a = mail(), address()
        masked = [(m, m.split("@")[0] + "@", "email"), (a, a.replace(".", "-"), "ip")]
        for value, hidden, kind in masked:
            x = f"write to {value} soon, or to {hidden} as said, {rng.randrange(99)} times"
            added = [(x[s:e], pii.KINDS[k]) for s, k, e in pii.spans_of(field, [x])[0][1]]
            found += (hidden, kind) in added
            wrong += any(t != hidden for t, _ in added)
    assert found >= 0.9 * 120 and wrong <= 3, (found, wrong)


def test_pii_finds_masked_mentions_of_documents(spark):
    """In the given documents: a mention said again in a form that no pattern matches is found whole, other numbers at the end are not, and no scrap of one comes out."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    field = pii.fit(docs.where("doc_id % 2 = 1"))
    rng, rows, want = random.Random(2), [], {}
    for r in docs.where("doc_id % 2 = 0 and text is not null").orderBy("doc_id").collect():
        base = pii.base_spans(r["text"])
        if base:
            a, k, b = rng.choice(base)
            said = pii.hidden(r["text"][a:b], k, rng.randrange(2))
            text = f"{r['text']} or {said} as said, and {rng.randrange(10 ** rng.randrange(1, 8))}"
            if pii.base_spans(text) == base:
                rows.append((r["doc_id"], text))
                want[r["doc_id"]] = (len(r["text"]) + 4, pii.KINDS[k], said)
    got = pii.find_personal(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), field, keep=("doc_id", "text")).collect()
    added = {r["doc_id"]: [(s["start"], s["kind"], r["text"][s["start"] : s["end"]]) for s in r["added"]] for r in got}
    found = sum(want[i] in a for i, a in added.items())
    others = sum(s != want[i] and s[0] >= want[i][0] for i, a in added.items() for s in a)
    assert len(rows) >= 20 and found >= 0.9 * len(rows) and others <= 0.02 * len(rows), (len(rows), found, others)
    assert all(pii._complete(pii.KINDS.index(k), x) for a in added.values() for _, k, x in a)


def test_pii_spans_are_whole():
    """Neighbouring tokens of one kind are one span; a scrap of a number is none; two whole numbers are two."""
    merged = lambda text, kind: [text[a:b] for a, _, b in pii._merged(text, pii.tokens(text, []), [kind] * len(pii.tokens(text, [])))]
    assert merged("call (017) 555-7713 now", 3) == ["(017) 555-7713"] and merged("room 826 there", 3) == []
    assert merged("7536784127813050 4845168114407329", 2) == ["7536784127813050", "4845168114407329"]
    assert merged("a@b c@d", 0) == ["a@b", "c@d"]


def test_pii(docs, empty, corpus):
    field = pii.fit(docs)
    got = rows_of(pii.find_personal(docs, field), "doc_id", "base")
    want = sorted(((i, [(pii.KINDS[k], a, b) for a, k, b in brute_spans(t or "")]) for i, t, *_ in corpus), key=repr)
    assert [(i, [tuple(s) for s in b]) for i, b in got] == want
    assert pii.find_personal(empty, field).count() == 0


def test_skip_chain_carries_labels(spark):
    rows = [(i, f"call +56 9 {i:04d} 5678 now, card 4111 1111 1111 1111 and ab{i}@x.example.org then id A{i}7 at 10.1.{i % 200}.7 with 77 apples") for i in range(200)]
    field = pii.fit(spark.createDataFrame(rows, "doc_id long, text string"))
    text = "write to joe.doe@mail.example.com first; later joe.doe@mail again, and 42 apples"
    base, added = pii.spans_of(field, [text])[0]
    assert base == brute_spans(text) and all(not (a < f and e > s) for a, _, e in added for s, _, f in base)
    assert ("joe.doe@mail", 0) in [(text[a:b], k) for a, k, b in added] and "42" not in [text[a:b] for a, k, b in added]
    long = " ".join(["joe.doe@mail.example.com"] * 500)
    assert len(pii.spans_of(field, [long])[0][0]) == 500


def test_language(spark, docs, empty):
    rng = random.Random(5)
    vocab = {"de": "und der die nicht schön über zwischen", "en": "the and with from this there would", "es": "que los para niño mañana entre esta", "fr": "les des être où français avec dans"}
    rows = [(i, " ".join(rng.choice(vocab[x].split()) for _ in range(40)), x, f"{x}.example" if i % 4 else "mixed.example") for i, x in enumerate(list(vocab) * 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    train, held = df.where("doc_id % 8 < 4"), df.where("doc_id % 8 >= 4")
    model = langid.fit(train)
    out = langid.identify(held, model, declared=F.lit(None).cast("string"), host=F.col("source")).collect()
    assert all(r["lang_id"] == r["lang"] and r["lang_keep"] for r in out)
    odd = langid.identify(docs, model, declared=F.col("lang"), host=F.col("source"))
    got = {r["doc_id"]: r for r in odd.collect()}
    assert odd.count() == docs.count() and [got[i]["lang_id"] for i in (43, 44, 45)] == ["und"] * 3 and not got[43]["lang_keep"]
    assert langid.identify(empty, model, declared=F.col("lang"), host=F.col("source")).count() == 0
    assert langid.fit(empty).shape == (4, langid.BINS)
    pages = spark.createDataFrame([("https://U@Www.Shop.Example.de:80/x", '<html class="a" LANG="de-CH">')], "url string, html string")
    assert tuple(pages.select(langid.host_of(F.col("url")), langid.suffix_of(langid.host_of(F.col("url"))), langid.declared_in(F.col("html"))).first()) == ("www.shop.example.de", "de", "de")


def test_language_posteriors(spark):
    """Text, declaration, suffix and host fused as the formulas say, computed anew without Spark."""
    import math

    import numpy as np

    rng = random.Random(11)
    vocab = {"de": "und der die nicht schön", "en": "the and with from this"}
    train = [(i, " ".join(rng.choice(vocab[x].split()) for _ in range(30)), x) for i, x in enumerate(["de", "en"] * 20)]
    model = langid.fit(spark.createDataFrame(train, "doc_id long, text string, lang string"), languages=("de", "en"))
    rows = [(i, " ".join(rng.choice((vocab["de"] + " " + vocab["en"]).split()) for _ in range(rng.randrange(1, 5))), rng.choice(["de", "en", "xx", None]), rng.choice(["a.de", "b.de", "c.com", "local", None])) for i in range(60)]
    rows += [(100, None, "de", "a.de"), (101, "", "en", "c.com"), (102, "zz", None, "b.de"), rows[3]]
    out = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), model, declared=F.col("lang"), host=F.col("source"), languages=("de", "en"))
    got = {r["doc_id"]: (r["lang_id"], r["lang_confidence"]) for r in out.collect()}

    def evidence(text):
        raw = (text or "").lower().encode()
        grams = [((a * 0x9E3779B1 & 0xFFFFFFFF) ^ (b * 0x85EBCA77 & 0xFFFFFFFF) ^ (c * 0xC2B2AE3D & 0xFFFFFFFF)) >> 16 for a, b, c in zip(raw, raw[1:], raw[2:], strict=False)]
        return [sum(float(model[j, g]) for g in grams) / math.sqrt(max(1, len(grams))) for j in (0, 1)] + [-math.log(langid.BINS) * len(grams) / math.sqrt(max(1, len(grams)))]

    def soft(v):
        p = np.exp(np.array(v) - max(v))
        return p / p.sum()

    lls = [evidence(t) for _, t, _, _ in rows]
    where = [s or "" for *_, s in rows]
    tail = lambda h: h.rsplit(".", 1)[1] if "." in h else ""
    top = (sum(soft(x) for x in lls) + 1.0) / (len(lls) + 3.0)
    level = lambda test, above: (sum(soft(x) for x, h in zip(lls, where, strict=True) if test(h)) + langid.PARENT * above) / (sum(map(test, where)) + langid.PARENT)
    for (i, text, said, _), x, h in zip(rows, lls, where, strict=True):
        prior = level(lambda o: o == h, level(lambda o: tail(o) == tail(h), top))  # noqa: B023
        declares = [0.0 if said not in ("de", "en") else math.log(langid.DECLARED if said == n else (1 - langid.DECLARED) / 3) for n in ("de", "en", "und")]
        post = soft([a + math.log(b) + c + d for a, b, c, d in zip(x, prior, declares, [0, 0, math.log(langid.NONE)], strict=True)])
        lang = "und" if not (text or "").strip() else ("de", "en", "und")[int(post.argmax())]
        assert got[i][0] == lang and abs(got[i][1] - post.max()) < 1e-3, (i, got[i], post)


def test_language_very_long_text(spark, monkeypatch):
    model = langid.fit(spark.createDataFrame([(1, "und der die " * 50, "de"), (2, "the and with " * 50, "en")], "doc_id long, text string, lang string"), languages=("de", "en"))
    df = spark.createDataFrame([(1, "the and with from " * 3000)], "doc_id long, text string")
    whole = langid.identify(df, model, languages=("de", "en")).first()
    monkeypatch.setattr(langid, "BLOCK", 64)
    parts = langid.identify(df, model, languages=("de", "en")).first()
    assert whole["lang_id"] == parts["lang_id"] == "en" and abs(whole["lang_confidence"] - parts["lang_confidence"]) < 1e-9


def test_pages_use_markup_suffix_and_host(spark, tmp_path):
    from lodestone.llm import queries

    rng = random.Random(15)
    vocab = {"de": "und der die nicht schön über", "en": "the and with from this there"}
    say = lambda x, n: " ".join(rng.choice(vocab[x].split()) for _ in range(n))
    spark.createDataFrame([(i, say(x, 40), x, "s", 1) for i, x in enumerate(["de", "en"] * 40)], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    pages = [(i, f"https://shop.example.{'de' if x == 'de' else 'com'}/{i}", f"<html><body><p>{say(x, 30)}</p></body></html>") for i, x in enumerate(["de", "en"] * 100)]
    pages += [(900, "https://shop.example.de/x", "<html><body><p>zz</p></body></html>"), (901, "https://new.example.de/x", "<html><body>zz</body></html>"), (902, "https://new.example.com/x", '<html lang="de-AT"><body>zz</body></html>'), (903, None, None)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    out = {r["page_id"]: r["lang_id"] for r in queries.language_fusion_pages(spark, str(tmp_path)).collect()}
    assert all(out[i] == x for i, x in enumerate(["de", "en"] * 100))
    assert (out[900], out[901], out[902], out[903]) == ("de", "de", "de", "und")  # by host, by suffix, by declaration, by nothing


def test_host_priors_decide_bare_texts(spark):
    model = langid.fit(spark.createDataFrame([(1, "und der die " * 50, "de"), (2, "the and with " * 50, "en")], "doc_id long, text string, lang string"), languages=("de", "en"))
    rows = [(i, "und der die " * 20, "h.de") for i in range(200)] + [(i, "the and with " * 20, "h.com") for i in range(200, 400)] + [(900, "zz", "h.de"), (901, "zz", "h.com")]
    out = {r["doc_id"]: r["lang_id"] for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, source string"), model, host=F.col("source"), languages=("de", "en")).collect()}
    assert out[900] == "de" and out[901] == "en"


def test_mixing(spark, docs, empty, corpus):
    weights = spark.createDataFrame([("src0", 1.0), ("src2", 3.0), (None, 1.0)], "source string, weight double")
    out = mixing.poisson_mix(docs, weights, total=4000)
    n = {r["source"]: r["n"] for r in out.groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert set(n) == {"src0", "src2", None} and abs(n["src2"] - 2400) < 250 and abs(n["src0"] - 800) < 150
    again = mixing.poisson_mix(docs.repartition(3), weights, total=4000)
    assert rows_of(out, "doc_id", "copy", "mix_key") == rows_of(again, "doc_id", "copy", "mix_key")
    assert mixing.poisson_mix(empty).count() == 0
    many = spark.range(20000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"))
    counts = [r["n"] for r in mixing.poisson_mix(many, total=50000).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).collect()]
    zero = 1 - len(counts) / 20000
    assert abs(sum(counts) / 20000 - 2.5) < 0.05 and abs(zero - 0.0821) < 0.01
    assert "Python" not in out._jdf.queryExecution().toString() and "Arrow" not in out._jdf.queryExecution().toString()
