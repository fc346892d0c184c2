"""Exact dedup, Merkle manifest and lexical search against brute force, with odd rows and many small blocks."""

import hashlib
import random
import re
from collections import Counter
from math import floor, log

import numpy as np
import pytest

from plumery.llm import exact_dedup, lexical, merkle

SCHEMA = "doc_id long, text string, source string, tree string, pos int, cls string, n int, score string, seq int, steps string"


@pytest.fixture(scope="module")
def odd(spark):
    """Null and empty texts, repeated rows, null ids and sources, long texts, texts alike after normalising, clashing names."""
    rows = [(n, f"w{n % 7} same\t\n words  here {'é' * (n % 3)}", f"s{n % 4}") for n in range(60)]
    rows += [(60, None, "s0"), (61, "", None), (62, " ", "ä"), (63, "\n\t", "z"), (64, "x", "s1"), (64, "x", "s1"), (None, "x", None), (None, "x", "s1")]
    rows += [(65, "long word " * 30_000, "s2"), (66, "long\x0bword " * 30_000, "s2"), (67, "w1 same words", "s0"), (68, "w1 same word", "s0")]
    rows = [(*r, "t", 1, "c", 2, "s", 3, "st") for r in rows]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


# --- exact dedup ------------------------------------------------------------------------------------------------------


def brute_dedup(rows):
    key = lambda t: re.sub("[\x20\x09-\x0d]+", " ", t or "")
    groups = {}
    for i, t in rows:
        groups.setdefault(key(t), []).append(i)
    least = {k: min((i for i in v if i is not None), default=None) for k, v in groups.items()}
    return Counter((i, least[key(t)], len(groups[key(t)]), hashlib.sha256(key(t).encode()).hexdigest()) for i, t in rows)


@pytest.mark.parametrize("trie_bytes", [400, 5_000, 64 << 20])
def test_exact_duplicates(spark, odd, trie_bytes):
    """However small the tries, so often do they spill, the result is that of whole strings."""
    rows = exact_dedup.exact_duplicates(odd, trie_bytes).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in rows) == brute_dedup([(r.doc_id, r.text) for r in odd.collect()])
    assert all(r.doc_id == r.keep_id for r in rows if r.kept)
    assert sum(r.kept for r in rows) == len({r.text_sha256 for r in rows})


def test_keep_first(odd):
    kept = exact_dedup.keep_first(odd)
    assert kept.columns == odd.columns
    want = {(keep, sha) for _, keep, _, sha in brute_dedup([(r.doc_id, r.text) for r in odd.collect()])}
    rows = kept.collect()
    assert len(rows) == len(want) and {r.doc_id for r in rows} == {k for k, _ in want}
    assert exact_dedup.keep_first(odd.limit(0)).count() == 0


def test_trie_is_compressed_and_spills_whole_subtrees():
    rng = random.Random(5)
    words = {bytes(rng.choices(b"ab", k=rng.randrange(12))) for _ in range(400)}
    trie = exact_dedup.Trie()
    for w in sorted(words, key=lambda w: rng.random()):
        for k in (2, 1):
            trie.insert(w, (0, k, k), 1)
    assert {k for k, _ in trie.below(trie.root, b"")} == words and trie.terminals == len(words)
    assert all(n.rows == 2 and n.owner == (0, 1, 1) for _, n in trie.below(trie.root, b""))
    todo = list(trie.root.kids.values())
    while todo:
        node = todo.pop()
        assert node.edge and (node.owner is not None or len(node.kids) > 1)  # no chain of single children
        todo.extend(node.kids.values())
    size = trie.size
    prefix, gone = trie.spill()
    left = {k for k, _ in trie.below(trie.root, b"")}
    assert {k for k, _ in gone} == {w for w in words if w.startswith(prefix)} and left == words - {k for k, _ in gone}
    assert trie.terminals == len(left) and 0 <= trie.size < size


# --- Merkle manifest --------------------------------------------------------------------------------------------------


def brute_tree(leaves):
    """Root and each leaf's list of sibling digests, level by level."""
    level, proofs, under = list(leaves), [[] for _ in leaves], [[n] for n in range(len(leaves))]
    while len(level) > 1:
        above, covers = [], []
        for at in range(0, len(level), 3):
            run = level[at : at + 3]
            for k in range(len(run)):
                for n in under[at + k]:
                    proofs[n] += run[:k] + run[k + 1 :]
            above.append(digest(*run))
            covers.append([n for u in under[at : at + 3] for n in u])
        level, under = above, covers
    return level[0], proofs


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 28, 100])
def test_appender(n):
    leaves = [digest(str(k)) for k in range(n)]
    one = merkle.Appender(3, 7)
    for d in leaves:
        one.append(d)
    root, proofs = brute_tree(leaves)
    assert one.close(False) == root
    assert [[d for s in w for part in s for d in re.findall(".{64}", part)] for w in one.witness] == proofs


@pytest.mark.parametrize("height", [1, 2, 7])
def test_manifest(spark, odd, height):
    """Blocks of 3, 9 and 2187 leaves give the same roots and witnesses as whole trees."""
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaves = odd.select("*", merkle.leaf_of(*(odd[c] for c in ("doc_id", "source", "text"))).alias("leaf"))
    found = merkle.manifest(leaves, height=height)
    assert set(found.columns) == {"doc_id", "text", "source", "cls", "n", "score", "seq", "leaf", "subroot", "root", "steps"}
    rows = merkle.verify(found).withColumn("proof", merkle.proof(found["steps"])).collect()
    trees = {}
    for r in odd.collect():
        trees.setdefault(r.source, []).append((r.doc_id is not None, r.doc_id or 0, digest(field(r.doc_id), field(r.source), field(r.text))))
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    built = {s: brute_tree([x[2] for x in sorted(trees[s])]) for s in names}
    root, tops = brute_tree([built[s][0] for s in names])
    want = Counter()
    for s, top in zip(names, tops, strict=True):
        for (has, i, leaf), proof in zip(sorted(trees[s]), built[s][1], strict=True):
            want[(i if has else None, s, leaf, built[s][0], root, "".join(proof + top))] += 1
    assert Counter((r.doc_id, r.source, r.leaf, r.subroot, r.root, r.proof) for r in rows) == want
    assert all(r.verified and r.folded_root == root for r in rows)
    changed = merkle.verify(found.withColumn("other", merkle.leaf_of(found["doc_id"], found["source"], found["source"])), "other")
    assert changed.where("verified").count() == 0


def test_manifest_empty(odd):
    assert merkle.manifest(odd.limit(0).withColumn("leaf", odd["text"])).count() == 0


def test_numbered_over_many_partitions(spark):
    rows = spark.range(2000).selectExpr("if(id % 3 = 0, 'hot', concat('t', id % 50)) AS tree", "(id * 7919) % 2000 AS at")
    got = {(r.tree, r.at): r.pos for r in merkle.numbered(rows, "tree", ["at"]).collect()}
    trees = {}
    for tree, at in sorted(got):
        assert got[tree, at] == trees.setdefault(tree, 0)
        trees[tree] += 1


# --- lexical search ---------------------------------------------------------------------------------------------------


def brute_search(docs, items, k):
    term = re.compile(r"[0-9A-Za-z\x80-\U0010FFFF]+")
    words = lambda t: term.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    texts = [(i, Counter(words(t))) for i, t in docs]
    n_docs, every = sum(bool(c) for _, c in texts), sum(c.total() for _, c in texts)
    df = Counter(t for _, c in texts for t in c)
    out = Counter()
    for item, text in items:
        scored = []
        for i, c in texts:
            m = 75 + 25 * c.total() * n_docs // every if every else 0
            s = sum(n * floor(1000 * log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, n in Counter(words(text)).items() if c[t])
            if s > 0:
                scored.append((-s, i is None, i or 0))
        for rank, (s, none, i) in enumerate(sorted(scored)[:k], 1):
            out[item, rank, None if none else i, -s] += 1
    return out


def made(seed, n):
    rng = random.Random(seed)
    words = [f"{w}{k}" for k in range(40) for w in ("ab", "É", "Zz", "straße")]
    text = lambda size: " ".join(words[min(int(rng.expovariate(0.05)), len(words) - 1)] for _ in range(size))
    docs = [(i, text(rng.choice((1, 5, 30, 200)))) for i in range(n)]
    docs += [(n + i, docs[i % 9][1]) for i in range(40)]  # ties
    return docs, [(i, text(rng.choice((1, 3, 20)))) for i in range(12)]


@pytest.mark.parametrize("block_bytes", [150, 1 << 20])
def test_search(spark, odd, block_bytes):
    docs, items = made(1, 150)
    docs += [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    items += [(3, "Same WORDS here here"), (None, "x same"), (90, None), (91, ""), (92, "never-seen"), (93, "é, x!")]
    frame = spark.createDataFrame([(*d, "e", 1) for d in docs], "doc_id long, text string, item_id string, n int").repartition(3)
    asked = spark.createDataFrame([(*i, 7) for i in items], "item_id long, text string, doc_id int")
    rows = lexical.search(frame, asked, 5, block_bytes).collect()
    assert Counter(tuple(r) for r in rows) == brute_search(docs, items, 5)


def test_search_empty(spark, odd):
    items = spark.createDataFrame([(1, "same")], "item_id long, text string")
    assert lexical.search(odd.limit(0), items).count() == 0
    assert lexical.search(odd, items.limit(0)).count() == 0


def test_ball_tree_bounds_hold_and_prune():
    """No row of a node exceeds its bound, and a query close to one group of rows leaves other leaves alone."""
    rng = np.random.default_rng(3)
    sizes = np.full(600, 12)
    group = np.arange(600) % 6
    terms = np.concatenate([np.sort(rng.choice(40, 12, replace=False)) + 40 * g for g in group])
    rows = lexical.Rows(np.arange(600), np.concatenate(([0], np.cumsum(sizes))), terms, rng.integers(1, 10**10, 600 * 12))
    tree = lexical.BallTree(rows, 240, leaf_docs=10)
    query, counts = np.sort(rng.choice(40, 30, replace=False)) + 80, rng.integers(1, 4, 30)
    dense = np.zeros(240, np.int64)
    dense[query] = counts
    scores = np.add.reduceat(dense[tree.rows.terms] * tree.rows.values, tree.rows.starts[:-1])
    bounds = tree.bounds(query, counts)
    assert all(scores[a:b].max() <= bound for (a, b), bound in zip(tree.ranges, bounds, strict=True))
    best = []
    scored = tree.search(query, counts, dense, best, 5)
    assert sorted(best, reverse=True) == sorted(zip(scores.tolist(), (-tree.rows.ids).tolist(), strict=True), reverse=True)[:5]
    assert scored < sum(k is None for k in tree.kids) / 2
