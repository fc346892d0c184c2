"""Line dedup, SimHash, sharding, token store and decontamination against brute force, with odd rows."""

import hashlib
import json
import re
import time
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from conftest import same
from pyspark.sql import functions as F

from plumery.llm import decontam, line_dedup, registry, sharding, simhash, token_store
from plumery.llm.common import bucketed, shared_dir, written

LONG = "A line that is long enough to be compared with the others "
SCHEMA = "doc_id long, text string, lang string, pos int, h1 string, fp string, n_lines string, spans string, size string"


@pytest.fixture(scope="module")
def odd(spark):
    """Null and empty texts, repeated rows, a null id, a very long text, and columns whose names the operators use."""
    shared = f"{LONG}\nown %d\n  {LONG.upper()}\t\nÄ {LONG}"
    rows = [(n, shared % n) for n in range(7)] + [(7, None), (8, ""), (9, "x"), (9, "x"), (None, shared % 99), (10, "word " * 30000), (11, "\n\n"), (12, "Äß " * 20)]
    return spark.createDataFrame([(i, t, "en", 1, "a", "b", "c", "d", "e") for i, t in rows], SCHEMA)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_sql(spark, duck, small, name):
    same(registry.QUERIES[name](spark, small), duck, registry.ORACLES[name])


def brute_lines(rows, min_chars=40, min_docs=5):
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    docs = {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= min_chars and i is not None:
                docs.setdefault(key(x), set()).add(i)
    shared = {k: max(v) for k, v in docs.items() if len(v) >= min_docs}
    return sorted((repr(i), "\n".join(x for x in (t or "").split("\n") if i is None or shared.get(key(x), i) == i)) for i, t in rows)


@pytest.mark.parametrize("batches", [1, 9])
def test_line_dedup(spark, odd, batches):
    out = line_dedup.dedup_lines(odd, n_batches=batches, fan_in=2)
    assert set(out.columns) == set(odd.columns) | {"n_dropped"}
    got = sorted((repr(r.doc_id), r.text) for r in out.collect())
    assert got == brute_lines([(r.doc_id, r.text) for r in odd.collect()])


def test_line_dedup_empty(spark, odd):
    assert line_dedup.dedup_lines(odd.limit(0)).count() == 0


def test_sharding(spark, odd):
    rows = sharding.shard_by_bytes(odd, n_shards=4, n_parts=3).orderBy("shard", "slot").collect()
    assert len(rows) == odd.count()
    assert [r.slot for r in rows] == [n for s in range(4) for n in range(sum(r.shard == s for r in rows))]
    texts = sorted((zlib.crc32((r.text or "").encode()), len((r.text or "").encode()) + 16) for r in odd.collect())
    assert sorted((r.text_crc32, r["size"]) for r in rows) == texts
    ids = [r.doc_id for r in rows]
    assert ids == sorted(ids, key=lambda x: (x is not None, x))
    assert sharding.shard_by_bytes(odd.limit(0)).count() == 0


def brute_fingerprint(text):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[k : k + 4]) for k in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark, odd):
    base = "one two three four five six seven eight nine ten eleven twelve "
    more = [(100 + n, base * 40 + "tail%d" % n) for n in range(30)]
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    prints = {brute_fingerprint(t) for _, t in rows}
    root = {p: p for p in prints}
    for a in prints:
        for b in prints:
            if bin(a ^ b).count("1") <= 4 and root[a] != root[b]:
                old, new = root[a], root[b]
                root = {k: new if v == old else v for k, v in root.items()}
    least = {}
    for i, t in rows:
        if i is not None:
            k = root[brute_fingerprint(t)]
            least[k] = min(i, least.get(k, i))
    want = sorted((repr(i), brute_fingerprint(t), least[root[brute_fingerprint(t)]]) for i, t in rows)
    got = sorted((repr(r.doc_id), r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert got == want
    assert simhash.near_duplicates(odd.limit(0)).count() == 0


def test_golay_keys_meet():
    r = np.random.default_rng(5)
    a = r.integers(0, 1 << 63, 400).astype(np.uint64)
    b = a.copy()
    for n in range(len(b)):
        for bit in r.choice(64, r.integers(1, 5), replace=False):
            b[n] ^= np.uint64(1 << int(bit))
    keys = [{} for _ in range(2)]
    for side, x in zip(keys, (a, b), strict=True):
        for row, key in zip(*(v.tolist() for v in simhash.golay_keys(x)), strict=True):
            side.setdefault(row, set()).add(key)
    assert all(keys[0][n] & keys[1][n] for n in range(len(a)))


def test_forest_links_a_large_ball():
    centre = np.uint64(0x0123456789ABCDEF)
    ball = np.array([centre ^ np.uint64(1 << i) ^ np.uint64(1 << j) for i in range(64) for j in range(i)], np.uint64)
    far = np.array([~centre], np.uint64)
    a, b = simhash.forest(np.concatenate([ball, far]))
    assert len(a) == len(ball) - 1 and not np.isin(far, b).any()


def brute_similar(rows, width=5, similarity=0.8):
    """The doc_id that leads each (doc_id, text)'s group of similar texts."""
    def shingles(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return frozenset(" ".join(words[k : k + width]) for k in range(max(1, len(words) - width + 1))) if words else frozenset()

    sets = {k: shingles(k[1]) for k in rows}
    root = {k: k for k in sets}

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    keys, by_shingle = sorted(sets, key=lambda k: (k[0], k[1] or "")), {}
    for k in keys:
        near = {}
        for x in sets[k] or {""}:
            for other in by_shingle.setdefault(x, []):
                near[other] = near.get(other, 0) + 1
            by_shingle[x].append(k)
        for other, both in near.items():
            if both >= similarity * (len(sets[k] | sets[other]) or 1):
                a, b = sorted((top(k), top(other)), key=lambda k: (k[0], k[1] or ""))
                root[b] = a
    return {k: top(k) for k in keys}


def test_keep_one(spark, odd):
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    rows = {(r.doc_id, r.text) for r in odd.where("doc_id is not null").collect()}
    lead = brute_similar(rows)
    got = sorted((r.doc_id, r.text or "") for r in kept.where("doc_id is not null").collect())
    assert got == sorted((k[0], k[1] or "") for k in set(lead.values()))  # of the two equal rows of id 9, one
    assert kept.where("doc_id is null").count() == 1
    assert simhash.keep_one(odd.limit(0)).count() == 0


def planted(r, n, changed):
    """A text of n random words, and a copy in which one word in so many is replaced."""
    word = lambda: "".join(r.choice(list("abcdefghijklmnop"), r.integers(2, 9)))
    text = [word() for _ in range(n)]
    copy = [word() if r.random() < changed else w for w in text]
    return " ".join(text), " ".join(copy)


def test_recall_of_similar_texts(spark):
    r = np.random.default_rng(5)
    pairs = [planted(r, n, c) for n in (60, 150, 400) for c in (0.002, 0.005, 0.01, 0.02, 0.03) for _ in range(60)]
    rows = [(2 * n + k, t) for n, pair in enumerate(pairs) for k, t in enumerate(pair)]
    lead = {i: j for (i, _), (j, _) in brute_similar(rows).items()}
    kept = {x.doc_id for x in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    gone = {i for i, j in lead.items() if i != j}
    assert len(gone) > 500 and kept >= {i for i, j in lead.items() if i == j}
    assert len(gone - kept) >= 0.97 * len(gone)


def test_texts_with_a_dominant_shingle_stay(spark):
    """A repeated filler word makes up most of each text; their sets have next to nothing in common, but for one planted pair."""
    r = np.random.default_rng(11)
    word = lambda: "".join(r.choice(list("abcdefghijklmnop"), 6))
    texts = [" ".join([word() for _ in range(90)] + ["spam"] * 200) for _ in range(20)]
    rows = [*enumerate(texts), (20, texts[13] + " more")]
    got = {x.doc_id for x in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == set(range(20))


def test_equal_fingerprints_are_verified(spark, monkeypatch):
    """Even if all fingerprints were equal, only the sets decide."""
    monkeypatch.setattr(simhash, "sketches", lambda docs, width, real=simhash.sketches: real(docs, width).withColumns({"one": F.lit(5).cast("long"), "two": F.lit(6).cast("long")}))
    r = np.random.default_rng(12)
    rows = [(n, planted(r, 40, 0.0)[0]) for n in range(12)]
    rows.append((12, rows[11][1] + " more"))
    assert {x.doc_id for x in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()} >= set(range(12))


def test_groups_of_drifting_copies(spark):
    """Four groups of 100 copies, each made from the one before or from the first: no other text goes, nearly all of them do."""
    r = np.random.default_rng(13)
    word = lambda: "".join(r.choice(list("abcdefghijklmnop"), r.integers(2, 9)))
    texts = []
    for drift in (True, False, True, False):
        text = [word() for _ in range(120)]
        for _ in range(100):
            texts.append(" ".join(text))
            own = [word() if r.random() < 0.012 else w for w in text]
            if drift:
                text = own
            else:
                texts[-1] = " ".join(own)
    rows = list(enumerate(texts))
    lead = {i: j for (i, _), (j, _) in brute_similar(rows).items()}
    kept = {x.doc_id for x in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    gone = {i for i, j in lead.items() if i != j}
    assert len(gone) > 300 and kept >= {i for i, j in lead.items() if i == j}
    assert len(gone - kept) >= 0.95 * len(gone)


def test_no_similar_text_is_left_out(spark, monkeypatch):
    """Copies about as far apart as may be, some in texts that share long passages: the groups are those of brute force."""
    monkeypatch.setattr(simhash, "COUNTED", 1000, raising=False)
    r = np.random.default_rng(15)
    pairs = [planted(r, n, c) for n in (6, 15, 60, 150, 400) for c in (0.01, 0.02, 0.025, 0.03) for _ in range(60)]
    shared = [planted(r, 90, 0)[0] for _ in range(3)]
    pairs += [(f"{shared[k % 3]} {a}", f"{shared[k % 3]} {b}") for k, (a, b) in enumerate(planted(r, 100, 0.04) for _ in range(90))]
    rows = [(2 * n + k, t) for n, pair in enumerate(pairs) for k, t in enumerate(pair)]
    lead = {i for i, _ in brute_similar(rows).values()}
    kept = {x.doc_id for x in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == lead


def test_no_shuffle_files_stay_behind(spark):
    """What a written table's shuffles took of the disk is free again, and a second table from the same rows is whole."""
    dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    files = lambda: {f.name for d in dirs for f in Path(d.getPath()).rglob("shuffle_*.data")}
    rows = spark.range(20_000).selectExpr("id", "id % 997 AS k").repartition(3, "k").groupBy("k").count()
    before = files()
    first, second = written(rows)[0], bucketed(rows, 3, "k")[0]
    assert sorted(first.collect()) == sorted(second.collect()) and len(first.collect()) == 997
    for _ in range(100):
        if not files() - before:
            break
        time.sleep(0.05)
    assert not files() - before


def test_sets_are_dealt_out_once(spark):
    """A round's look-up of sets moves what it asks for, not the sets."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sets, drop = bucketed(spark.range(1000).selectExpr("id AS doc_id", "id * 3 AS text_hash", "cast(id AS string) AS shingles"), n, "doc_id", "text_hash")
    wanted = spark.range(50).selectExpr("id AS node", "id * 2 AS doc_id", "id * 6 AS text_hash")
    found = sets.join(wanted.hint("merge"), ["doc_id", "text_hash"])
    assert found.count() == 50
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(") == 1
    drop()


def test_first_shingles_and_shared_pairs_leave_out_no_pair():
    r = np.random.default_rng(16)
    base = [np.unique(r.integers(0, 400, n).astype(np.uint32)) for n in r.integers(1, 60, 200)]
    every = [x for b in base for x in (b, np.unique(np.where(r.random(len(b)) < 0.1, r.integers(0, 400, len(b)), b)).astype(np.uint32))]
    last = np.arange(100, 300, dtype=np.uint32)
    first = simhash.first_shingles(every, last, r.integers(1, 9, 200).astype(np.int32), 0.8)
    node = np.repeat(np.arange(len(every)), [len(x) for x in first])
    key, place = np.concatenate(first), np.concatenate([np.arange(len(x)) for x in first])
    order = np.argsort(key, kind="stable")
    tree = np.arange(len(every)) % 150
    own = node[order]
    size = np.array([len(x) for x in every])[own]
    got = {(min(a, b), max(a, b)) for x, y in simhash.shared_pairs(key[order], tree[own], size, place[order], 0.8) for a, b in zip(own[x].tolist(), own[y].tolist(), strict=True)}
    sets = [set(x.tolist()) for x in every]
    want = {(a, b) for b in range(len(sets)) for a in range(b) if tree[a] != tree[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert want and got >= want


@pytest.mark.parametrize("copies", [40, 400])
def test_closest_forest(copies):
    r = np.random.default_rng(2)
    base = r.integers(0, 1 << 63, (6, 2)).astype(np.uint64)
    prints = np.repeat(base, copies, axis=0)
    for n in range(len(prints)):
        for bit in r.choice(128, r.integers(0, 12), replace=False):
            prints[n, bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    a, b = simhash.closest_forest(prints)
    assert len(a) == 6 * (copies - 1) and (a // copies == b // copies).all()
    assert (np.bitwise_count(prints[a] ^ prints[b]).sum(1) <= simhash.MAX_APART).all()
    a, b = simhash.closest_forest(prints, np.arange(len(prints)) // copies % 3)
    assert len(a) == 0 or (a // copies % 3 != b // copies % 3).all()
    tied = np.arange(len(prints)) // (copies // 2)
    a, b = simhash.closest_forest(prints, tied)
    assert len(a) == 6 and (tied[a] // 2 == tied[b] // 2).all()


def test_unlinked_rows_are_looked_at_once():
    import time

    prints = np.random.default_rng(3).integers(0, 1 << 63, (4000, 2)).astype(np.uint64)
    start = time.process_time()
    assert len(simhash.closest_forest(prints)[0]) == 0
    assert time.process_time() - start < 1  # 0.2 s on a free core


def test_runs_over_batches():
    keys = np.sort(np.random.default_rng(3).integers(0, 40, 500))
    for size in (1, 3, 64, 500):
        batches = [pa.RecordBatch.from_arrays([pa.array(keys[k : k + size]), pa.array(np.arange(500)[k : k + size])], names=["k", "v"]) for k in range(0, 500, size)]
        runs = list(simhash.whole_runs(batches))
        assert np.concatenate([v for _, v in runs]).tolist() == list(range(500))
        seen = [set(k.tolist()) for k, _ in runs]
        assert sum(map(len, seen)) == len(set(keys.tolist()))


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def test_token_store(spark, odd, tokenizer):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer)
    strange = ["  a b", "a  b ", "a\n", "\nb", "x\n\ny", "<|endoftext|> hi", "don't stop 12 3,4!!", "héé «x» 中文 字", "a\tb", "a　b", "x\x7fy", "it's"]
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame(list(enumerate(strange, 200)), "doc_id long, text string"))
    path = shared_dir(spark)
    token_store.write_token_store(docs, path, tokenizer, shard_bytes=200, n_parts=3)
    rows = sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda r: (r[0] is not None, r[0], r[1] or ""))
    want, start = [], 0
    for i, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        want.append((start, i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in token_store.read_token_store(spark, path).collect())
    assert got == want
    asked = spark.createDataFrame([(9,), (203,), (5000,), (None,), (9,)], "doc_id long")
    found = token_store.lookup(spark, path, asked).collect()
    assert sorted(r.doc_id for r in found) == [9, 9, 203]
    assert {tuple(r.ids) for r in found if r.doc_id == 203} == {(*t.encode("\nb").ids, 0)}
    empty = shared_dir(spark)
    token_store.write_token_store(docs.limit(0), empty, tokenizer)
    assert token_store.read_token_store(spark, empty).count() == 0


def test_token_store_parts_a_frequent_key(spark, tokenizer):
    rows = [(5, f"word {n} of the text") for n in range(300)] + [(6, "the same text")] * 300 + [(None, f"no id {n}") for n in range(300)] + [(n, "x") for n in range(10, 20)]
    docs, path = spark.createDataFrame(rows, "doc_id long, text string"), shared_dir(spark)
    token_store.write_token_store(docs, path, tokenizer, shard_bytes=200, n_parts=6)
    shards = spark.read.parquet(path).collect()
    assert max(s.n_docs for s in shards) < 100 and max(sum(s.n_docs for s in shards if s.part == p) for p in range(6)) < 300
    read = token_store.read_token_store(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in read] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i))
    assert [r.start for r in read] == np.concatenate(([0], np.cumsum([r.n_tokens for r in read])[:-1])).tolist()
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer)
    found = token_store.lookup(spark, path, spark.createDataFrame([(5,), (6,), (12,)], "doc_id long")).collect()
    assert sorted((r.doc_id, tuple(r.ids)) for r in found) == sorted((i, (*t.encode(x, add_special_tokens=False).ids, 0)) for i, x in rows if i in (5, 6, 12))


@pytest.mark.parametrize("change", [None, {"add_prefix_space": True}, {"use_regex": False}])
def test_other_tokenizer_files_encode_whole(tmp_path, tokenizer, change):
    from tokenizers import Tokenizer
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    if change:
        parts = json.loads(open(tokenizer).read())
        parts["pre_tokenizer"] |= change
        path = str(tmp_path / "own.json")
        open(path, "w").write(json.dumps(parts))
    t, own = Tokenizer.from_file(path), token_store.Encoder(path)
    assert not own.by_words and token_store.Encoder(tokenizer).by_words
    for text in ["Some Words, and more words.", " a  b", "x\ny z", "don't 12"]:
        assert np.frombuffer(own(text), np.uint16 if own.width == 2 else np.uint32).tolist() == t.encode(text, add_special_tokens=False).ids


def test_lookup_reads_by_bounds(spark, tokenizer):
    docs, path = spark.createDataFrame([(n * 3, f"text {n}") for n in range(500)], "doc_id long, text string"), shared_dir(spark)
    token_store.write_token_store(docs, path, tokenizer, shard_bytes=100, n_parts=5)
    found = token_store.lookup(spark, path, spark.range(0, 200).selectExpr("id as doc_id", "id as part", "id as seq"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert sorted(r.doc_id for r in found.collect()) == list(range(0, 200, 3))


def test_perfect_hash():
    keys = np.random.default_rng(1).choice(1 << 40, 5000, replace=False).astype(np.int64) - (1 << 39)
    index = token_store.PerfectHash.build(keys)
    assert sorted(index.slots(keys).tolist()) == list(range(len(keys)))


def brute_hits(text, items, window=10):
    low = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    words, hit, found = low(text), set(), set()
    for item, t in items:
        w = low(t)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            p = w[k : k + window]
            for at in range(len(words) - len(p) + 1):
                if words[at : at + len(p)] == p:
                    hit |= set(range(at, at + len(p)))
                    found.add(str(item))
    return len(words), len(hit), sorted(found)


@pytest.mark.parametrize("block", [1 << 20, 60])
def test_decontamination(spark, odd, block, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK_BYTES", block)
    monkeypatch.setattr(decontam.benchmark_blocks, "__defaults__", (block,))
    monkeypatch.setattr(decontam, "SHARD_CHARS", 400)
    items = [(1, "long enough to be compared with the others own 3 a line that"), (2, "Word word word"), (3, None), (4, "..."), (None, "x"), (10, LONG), (11, "äß ÄSS")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    want = sorted((repr(i), *brute_hits(t if len(t or "") < 9999 else "word " * 300, [x for x in items if x[0] is not None])) for i, t in rows)
    docs = odd.withColumn("text", F.when(F.length("text") >= 9999, F.expr("repeat('word ', 300)")).otherwise(F.col("text")))
    found = decontam.find_contamination(docs, bench)
    assert sorted((repr(r.doc_id), r.n_words, r.n_hit, list(r.item_ids)) for r in found.collect()) == want
    cut = {repr(r.doc_id): r.text for r in decontam.remove_contamination(docs, bench).collect()}
    assert cut["7"] is None and cut["9"] == "x" and cut["10"].strip() == ""
    assert decontam.find_contamination(odd.limit(0), bench).count() == 0
    assert decontam.find_contamination(docs, bench.limit(0)).where("n_hit > 0").count() == 0


def test_benchmark_text_is_cut_out_by_one_python_worker_of_a_task(spark, monkeypatch):
    """One block is searched and cut out in one step; several blocks give the same texts. Columns of any name pass through."""
    words = [f"w{n}" for n in range(60)]
    bench = spark.createDataFrame([("a", " ".join(words[:12])), ("b", " ".join(words[20:31])), ("c", "w50")], "item_id string, text string")
    rows = [(1, " ".join(words), 5, "x"), (2, None, None, None), (3, "", 1, "y"), (4, "É " + " ".join(words[18:33]) + ".", 2, "z"), (4, "none here", 3, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans int, item_ids string")
    found = decontam.remove_contamination(docs, bench)
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1 and found.columns == docs.columns
    monkeypatch.setattr(decontam, "benchmark_blocks", lambda b, f=decontam.benchmark_blocks: f(b, 40))
    several = decontam.remove_contamination(docs, bench)
    assert sorted(map(repr, found.collect())) == sorted(map(repr, several.collect()))
    texts = {(r.doc_id, r.spans): r.text for r in found.collect()}
    assert texts[4, 2] == "É w18 w19  w31 w32." and texts[4, 3] == "none here" and texts[2, None] is None and texts[3, 1] == ""


def test_fm_index_finds_and_locates():
    r = np.random.default_rng(3)
    seq = r.integers(0, 4, 3000)
    index = decontam.FMIndex(seq)
    phrases = [seq[k : k + n] for k, n in ((5, 3), (100, 7), (2990, 10), (50, 1))] + [np.array([9, 9])]
    rows = np.zeros((len(phrases), 10), int)
    for n, p in enumerate(phrases):
        rows[n, 10 - len(p) :] = p
    low, high = index.find(rows, np.array([len(p) for p in phrases]))
    for p, a, b in zip(phrases, low, high, strict=True):
        want = [k for k in range(len(seq) - len(p) + 1) if (seq[k : k + len(p)] == p).all()]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_items_digest(spark, small):
    found = registry.QUERIES["op10_decontamination"](spark, small).where("n_hit = 0").first()
    assert found.items_sha256 == hashlib.sha256(b"").hexdigest()
