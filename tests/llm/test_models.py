"""Neighbours, SentencePiece, personal data, languages and quality, with odd rows."""

import math
import re
import tracemalloc
import zlib
from functools import cache

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from plumery.llm import langid, neighbours, pii, quality, sentencepieces


def test_neighbours_are_exact(spark):
    r = np.random.default_rng(0)
    vecs = r.normal(size=(300, 12)).round(3)
    vecs[10:40] = vecs[10]
    rows = [(n, v.tolist()) for n, v in enumerate(vecs)]
    rows += [(1000, None), (1001, [0.0] * 12), (1002, [float("nan")] * 12), (1003, [1.0, None] * 6), (1004, [float("inf")] * 12), (None, [1.0] * 12), (1005, [1.0, 2.0]), (7, vecs[7].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("group", F.lit("x"))
    found = neighbours.nearest(df, df.where("vec_id % 20 = 0 or vec_id > 900"), k=10, n_tasks=3).collect()
    for q in range(0, 300, 20):
        d = [(float(np.sqrt(sum((a - b) * (a - b) for a, b in zip(vecs[q], vecs[n], strict=True)))), n) for n in range(300) if n != q]
        want = [(k, n, s) for k, (s, n) in enumerate(sorted(d)[:10], 1)]
        assert sorted((x["rank"], x.vec_id, x.score) for x in found if x.query_id == q) == want
    assert {x.query_id for x in found if x.query_id > 900} == set()
    assert neighbours.nearest(df.limit(0), df).count() == 0


def test_a_repeated_candidate_counts_once(spark):
    r = np.random.default_rng(4)
    query = r.normal(size=12)
    others = query + 0.5 * r.normal(size=(60, 12))
    rows = [(0, query.tolist())] + [(1, (query + 0.01 * r.normal(size=12)).tolist()) for _ in range(3000)] + [(n, v.tolist()) for n, v in enumerate(others, 2)]
    df = spark.createDataFrame([rows[n] for n in r.permutation(len(rows))], "vec_id long, embedding array<double>").coalesce(1)
    found = neighbours.nearest(df, df.where("vec_id = 0"), k=10, n_tasks=1).orderBy("rank").collect()
    least = {}
    for i, v in rows[1:]:
        least[i] = min(least.get(i, np.inf), float(np.sqrt(sum((a - b) * (a - b) for a, b in zip(query, v, strict=True)))))
    assert [(x.vec_id, x.score) for x in found] == [(i, d) for d, i in sorted((d, i) for i, d in least.items())[:10]]


@pytest.mark.parametrize("parts", [1, 4])
def test_repeated_rows_near_the_query(spark, parts):
    r = np.random.default_rng(8)
    query = r.normal(size=8)
    rows = [(0, query.tolist())] + [(5, (query + 0.001 * r.normal(size=8)).tolist()) for _ in range(30)] + [(n, (query + r.normal(size=8)).tolist()) for n in range(6, 60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(parts)
    found = neighbours.nearest(df, df.where("vec_id = 0"), k=10).collect()
    least = {}
    for i, v in rows[1:]:
        least[i] = min(least.get(i, np.inf), float(np.sqrt(sum((a - b) * (a - b) for a, b in zip(query, v, strict=True)))))
    assert [(x.vec_id, x.score) for x in sorted(found, key=lambda x: x["rank"])] == [(i, d) for d, i in sorted((d, i) for i, d in least.items())[:10]]


@pytest.mark.parametrize("size", [[1e160], [1e-300], [1e-160], [1.0], [1e160, 1.0, 1e-300, 1e-5, 0.9e308]])
def test_huge_and_tiny_vectors(spark, size):
    r = np.random.default_rng(9)
    vecs = r.uniform(-1, 1, size=(400, 6)) * np.resize(size, 400)[:, None]
    df = spark.createDataFrame([(n, v.tolist()) for n, v in enumerate(vecs)], "vec_id long, embedding array<double>")
    found = neighbours.nearest(df, df.where("vec_id % 40 < 5"), k=10).collect()
    for q in (n for n in range(400) if n % 40 < 5):
        d = [(math.dist([x / 4 for x in vecs[q]], [x / 4 for x in vecs[n]]), n) for n in range(400) if n != q]
        got = sorted((x["rank"], x.vec_id, x.score / 4) for x in found if x.query_id == q)
        assert len(got) == 10 and np.allclose([s for _, _, s in got], [s for s, _ in sorted(d)[:10]], rtol=1e-9, atol=0)
        assert all(np.isclose(s, math.dist([x / 4 for x in vecs[q]], [x / 4 for x in vecs[n]]), rtol=1e-9, atol=0) for _, n, s in got)


def test_more_neighbours_asked_than_there_are(spark):
    df = spark.createDataFrame([(n, [float(n), 1.0]) for n in range(4)] + [(9, [1.0, 2.0, 3.0])], "vec_id long, embedding array<double>")
    found = neighbours.nearest(df, df, k=10)
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in found.collect()) == [(q, k, n) for q in range(4) for k, n in enumerate(sorted((n for n in range(4) if n != q), key=lambda n: (abs(n - q), n)), 1)]


def test_the_grid_of_many_cells(spark, monkeypatch):
    for name, value in {"QUERY_BLOCK": 7, "BLOCK": 11, "QUERY_GROUP": 20, "CELL_BLOCKS": 3}.items():
        monkeypatch.setattr(neighbours, name, value)
    r = np.random.default_rng(10)
    vecs = r.normal(size=(300, 5)).round(2)
    df = spark.createDataFrame([(n, v.tolist()) for n, v in enumerate(vecs)], "vec_id long, embedding array<double>").repartition(3)
    found = neighbours.nearest(df, df.where("vec_id < 90"), k=4, n_tasks=2)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    rows = found.collect()
    for q in range(90):
        d = [(float(np.sqrt(sum((a - b) * (a - b) for a, b in zip(vecs[q], vecs[n], strict=True)))), n) for n in range(300) if n != q]
        assert sorted((x["rank"], x.vec_id, x.score) for x in rows if x.query_id == q) == [(k, n, s) for k, (s, n) in enumerate(sorted(d)[:4], 1)]


def test_bounds_hold():
    r = np.random.default_rng(2)
    a, b = r.normal(size=(40, 64)), r.normal(size=(90, 64)) * r.uniform(0.01, 100, (90, 1))
    low, high, unit = neighbours.bounds(neighbours.Quantised(a), neighbours.Quantised(b))
    true = ((a[:, None] - b[None]) ** 2).sum(2) / 4.0**unit
    assert (low <= true).all() and (true <= high).all()


STRANGE = ["", " a", "a ", "  a  b ", "▁x y▁", "\n\na\n b", "中文 字😀", "\x00a b\x00  c", "ﷲ ﷐ z", "İi ſ", "ab" * 2000]


def test_pieces_without_dropout_are_the_models(small):
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=sentencepieces.model_path())
    own = sentencepieces.pieces(sentencepieces.model_path())
    texts = [t for t in STRANGE if "▁" not in t] + ["The rest of it, and on."]
    assert [i.tolist() for i in own.encode(texts, 1, 0.0)] == [model.encode(t) for t in texts]


def test_dropout_is_seeded_varied_and_lossless(spark):
    docs = spark.createDataFrame([(n, t, "x", "y") for n, t in enumerate([*STRANGE, None, "repeated row", "repeated row"])], "doc_id long, text string, ids string, n_pieces string")
    a, b, c = (sentencepieces.encode_pieces(docs, sentencepieces.model_path(), seed, 0.3).orderBy("doc_id").collect() for seed in (1, 1, 2))
    assert [r.ids for r in a] == [r.ids for r in b] != [r.ids for r in c]
    assert all(r.lossless for r in a) and a[-1].ids == a[-2].ids
    frame = sentencepieces.encode_pieces(docs, sentencepieces.model_path(), 3, 0.3)
    back = {r.doc_id: r.text for r in sentencepieces.decode_pieces(frame, sentencepieces.model_path()).collect()}
    assert back == {r.doc_id: r.text or "" for r in docs.collect()}
    assert sentencepieces.encode_pieces(docs.limit(0), sentencepieces.model_path()).count() == 0


FULL = (1 << 64) - 1


def brute_mixed(z):
    z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 & FULL
    z = (z ^ z >> 27) * 0x94D049BB133111EB & FULL
    return z ^ z >> 31


def brute_draws(text, place, seed, rate):
    """Numbers of the skipped candidates of the word at that place, one after another."""
    key, at, draw = brute_mixed((xxhash.xxh64_intdigest(text.encode(), seed) + place * 0xD1B54A32D192ED03) & FULL), -1, 0
    while True:
        u = brute_mixed((key + (draw + 1) * 0x9E3779B97F4A7C15) & FULL) >> 11
        k = 0
        while u < int((1 - rate) ** (k + 1) * (1 << 53)):
            k += 1
        at, draw = at + 1 + k, draw + 1
        yield at


@cache
def brute_usable(model):
    return {model.id_to_piece(i): i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))}


def brute_pieces(model, text, seed, rate):
    """An agenda over a plain list of symbols, word by word; a piece's rank is its score, then its id."""
    usable = brute_usable(model)
    out = []
    for place, word in enumerate(re.findall(" *[^ \\n]+| +|\\n[^ \\n]*", " " + text) if text else []):
        symbols = [(c, n) for n, c in enumerate(word.replace("▁", "\ud801").replace(" ", "▁"))]
        draws, number, open_merges = brute_draws(text, place, seed, rate) if rate else iter([1 << 62]), 0, {}
        skip = next(draws)

        def meet(n, symbols=symbols, open_merges=open_merges, draws=draws):
            nonlocal number, skip
            if 0 <= n < len(symbols) - 1 and (i := usable.get(symbols[n][0] + symbols[n + 1][0])) is not None:
                if number == skip:
                    skip = next(draws)
                else:
                    open_merges[symbols[n][1], symbols[n + 1][1]] = ((-model.get_score(i), i), symbols[n][1])
                number += 1

        for n in range(len(symbols) - 1):
            meet(n)
        while True:
            live = {(a[1], b[1]): (a[0], b[0]) for a, b in zip(symbols, symbols[1:], strict=False)}
            best = min((rank, pair) for pair, rank in open_merges.items() if pair in live) if any(p in live for p in open_merges) else None
            if best is None:
                break
            n = next(k for k, x in enumerate(symbols) if x[1] == best[1][0])
            symbols[n : n + 2] = [(symbols[n][0] + symbols[n + 1][0], symbols[n][1])]
            for pair in [p for p in open_merges if best[1][0] in p or best[1][1] in p]:
                del open_merges[pair]
            meet(n)
            meet(n - 1)
        for x, _ in symbols:
            out += [usable[x]] if x in usable else [model.piece_to_id(f"<0x{b:02X}>") for b in x.replace("\ud801", "▁").encode()]
    return out


def test_dropout_against_a_plain_agenda(monkeypatch):
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=sentencepieces.model_path())
    own = sentencepieces.Pieces(sentencepieces.model_path(), remember=200)
    words = "thereof internationalisation the of thereofingationé中".split()
    texts = [" ".join(words * n) for n in (1, 9, 30)] + ["ab" * 140 + " " + "thereofingation" * 12, "one\ntwo \n\nthree\n", *(t for t in STRANGE if len(t) < 1000)] * 2
    for rate in (0.0, 0.1, 0.3, 1.0):
        want = [brute_pieces(model, t, 5, rate) for t in texts]
        for n in range(2):  # rare at first, then remembered
            assert [i.tolist() for i in own.encode(texts, 5, rate)] == want
            assert [own.encode([t], 5, rate)[0].tolist() for t in texts] == want
        assert [own.decode(np.array(i)) for i in want] == texts
        monkeypatch.setattr(sentencepieces, "LONG_WORD", 8 if n else 256)


def test_ids_do_not_depend_on_the_texts_beside():
    """A word that is as long as any beside it, with its own blanks: what it skips is its own affair."""
    r = np.random.default_rng(21)
    texts = ["\n".join("  ".join("".join(r.choice(list("aeinrst"), r.integers(1, 9))) for _ in range(6)) for _ in range(5)) for _ in range(60)]
    own = sentencepieces.Pieces(sentencepieces.model_path())
    together = [i.tolist() for i in own.encode(texts, 1, 0.9)]
    for text, ids in zip(texts, together, strict=True):
        own.memo = sentencepieces.Runs()
        assert own.encode([text], 1, 0.9)[0].tolist() == ids


def test_rare_words_go_and_frequent_ones_stay():
    """Beside ever new words a frequent one stays remembered, ids are those of a new worker, and few runs are left over."""
    r = np.random.default_rng(22)
    own = sentencepieces.Pieces(sentencepieces.model_path(), remember=500)
    for _ in range(12):
        texts = [" ".join(["station"] * 9 + ["".join(r.choice(list("aeinrst"), 9)) for _ in range(30)]) for _ in range(10)]
        found = [i.tolist() for i in own.encode(texts, 1, 0.1)]
        assert own.memo.uses[own.memo.words["station"]] >= 90 and len(own.memo.words) <= 500 + 301 and own.memo.n <= 1000
        assert found == [i.tolist() for i in sentencepieces.Pieces(sentencepieces.model_path()).encode(texts, 1, 0.1)]
    assert own.memo.uses[own.memo.words["station"]] == 12 * 90
    names = {f"w{n}" for n in range(90)}
    for _ in range(40):  # few words with ever new runs
        own.encode([" ".join(r.choice(sorted(names), 600)) for _ in range(3)], int(r.integers(1 << 30)), 0.5)
        assert own.memo.n <= 500 + 2000


def test_a_worker_holds_little_beside_its_tables():
    """Encoding 4 million characters of new and old words takes less than 40 MB at any time beside the model's tables."""
    r = np.random.default_rng(23)
    syllables = np.array(["an", "er", "to", "li", "os", "mé", "qu", "ta", "ren", "sch"])
    texts = [" ".join(map("".join, r.choice(syllables, (500, 3)).tolist())) + " " + " ".join(map("".join, r.choice(syllables, (40, 7)).tolist())) for _ in range(1000)]
    sentencepieces.pieces(sentencepieces.model_path()).encode(texts[:1], 1, 0.1)
    tracemalloc.start()
    try:
        own = sentencepieces.Pieces(sentencepieces.model_path())
        tables = tracemalloc.get_traced_memory()[0]
        tracemalloc.reset_peak()
        for _, some in sentencepieces.runs_of(texts, sentencepieces.CHUNK_CHARS):
            own.encode(some, 1, 0.1)
        peak = tracemalloc.get_traced_memory()[1] - tables
    finally:
        tracemalloc.stop()
    assert peak < 40e6, (tables, peak)


def test_each_occurrence_is_drawn_by_itself():
    own = sentencepieces.pieces(sentencepieces.model_path())
    same = own.encode([" ".join(["internationalisation"] * 400)], 5, 0.3)[0].tolist()
    starts = [n for n, i in enumerate(same) if own.text[i].startswith("▁")]
    forms = {tuple(same[a:b]) for a, b in zip(starts, [*starts[1:], len(same)], strict=True)}
    assert len(forms) > 20


def test_gaps_between_skips_have_the_rate():
    keys = np.random.default_rng(3).integers(0, 1 << 63, 200_000).astype(np.uint64)
    for rate in (0.1, 0.5):
        gaps = sentencepieces.passed(keys, 0, rate)
        for k in range(4):
            assert abs((gaps == k).mean() - rate * (1 - rate) ** k) < 0.005


def test_a_word_of_a_million_letters():
    own = sentencepieces.pieces(sentencepieces.model_path())
    text = "therein" * 50_000
    assert own.decode(own.encode([text], 1, 0.1)[0]) == text


def brute_pii(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and pii.luhn(d):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_base_spans(seed):
    r = np.random.default_rng(seed)
    parts = ["a@b.c", "@", ".", "x", "1.2.3.4", "255", "300", " ", "-", "+", "4111 1111 1111 1111", "+1 (2) 345-678-90", "..", "é", "%", "@d.e"]
    for _ in range(300):
        t = "".join(r.choice(parts, 12))
        assert pii.base_spans(t) == brute_pii(t), t


@pytest.mark.parametrize(
    ("text", "kind", "found"),
    [
        ("mail jоhn.smith＠example.com now", "email", "jоhn.smith＠example.com"), ("write john dot smith at example dot com please", "email", "john dot smith at example dot com"),
        ("user [at] site (dot) org", "email", "user [at] site (dot) org"), ("call plus four nine one five one two three four five six seven", "phone", "plus four nine one five one two three four five six seven"),
        ("ip one nine two dot one six eight dot one dot two", "ip", "one nine two dot one six eight dot one dot two"), ("a​b@exa​mple.com", "email", "a​b@exa​mple.com"),
    ],
)
def test_disguises(text, kind, found):
    assert [(pii.KINDS[k], text[a:b]) for a, k, b in pii.all_spans(text, pii.base_spans(text))] == [(kind, found)]


@pytest.mark.parametrize(
    ("text", "kind", "found"),
    [
        ("john at example dot xyz now", "email", "john at example dot xyz"), ("john.smith at example.com now", "email", "john.smith at example.com"), ("ip 192[.]168[.]1[.]1 ok", "ip", "192[.]168[.]1[.]1"),
        ("card 4lll 1111 1111 1111 ok", "card", "4lll 1111 1111 1111"), ("call +44 2O 7946 0958", "phone", "+44 2O 7946 0958"), ("mail a.b[@]c[.]museum!", "email", "a.b[@]c[.]museum"),
        ("john underscore smith at my-site dot travel", "email", "john underscore smith at my-site dot travel"), ("x99 at a.b.co", "email", "x99 at a.b.co"),
    ],
)
def test_disguises_of_any_ending(text, kind, found):
    assert [(pii.KINDS[k], text[a:b]) for a, k, b in pii.all_spans(text, pii.base_spans(text))] == [(kind, found)]


def disguised(r):
    """A text with one disguised identifier, its kind and where it stands."""
    word = lambda: "".join(r.choice(list("abcdefghijklmnopqrstuvwxyz"), r.integers(3, 9)))
    dot, at = (x[r.integers(len(x))] for x in ((" dot ", "[.]", " (dot) ", "{dot}", "[dot]"), (" at ", "[at]", " (at) ", "{@}", " <at> ")))
    kind = r.integers(4)
    if kind == 0:
        found = word() + at + word() + dot + word()
    elif kind == 1:
        found = dot.join(str(r.integers(256)) for _ in range(4))
    elif kind == 2:
        digits = "".join(map(str, r.integers(0, 10, 15)))
        digits += next(c for c in "0123456789" if pii.luhn(digits + c))
        n = r.integers(1, 15)
        names = dict(zip("0123456789", pii.DIGIT_WORDS, strict=True))
        found = digits[:n] + " " + names[digits[n]] + " " + digits[n + 1 :] if r.random() < 0.5 else digits.translate(str.maketrans("01", "Ol"))
    else:
        found = "plus " + " ".join(pii.DIGIT_WORDS[d] for d in r.integers(0, 10, 11))
    before = " ".join(word() for _ in range(5)) + ": "
    return before + found + " " + word(), kind, (len(before), len(before) + len(found))


CLEAN = (
    "look at the dot on the map|meet at noon dot and go|version 2 dot 3 is out|we work at example.com today|see note (1) at page 4.5 of it|he stood at home|room 1O1 is free|(at) last|a dot and a dash at night|"
    "the one at the end|plus one more|at one point two of them|IPs l.O.l.O aside|it is at least 3.5 km|they were at the dot. com was there|call me at ten|item 5S costs 12|one two three four five six|look at it. the end"
).split("|")


def test_recall_and_precision_of_disguises():
    r = np.random.default_rng(11)
    caught = 0
    for _ in range(2000):
        text, kind, (a, b) = disguised(r)
        spans = [s for s in pii.all_spans(text, pii.base_spans(text)) if s[1] == kind]
        caught += any(s[0] < b and s[2] > a for s in spans)
    wrong = sum(bool(pii.all_spans(t, pii.base_spans(t))) for t in CLEAN)
    assert caught >= 0.97 * 2000 and wrong == 0, (caught, wrong)


@pytest.mark.parametrize(
    ("text", "kind", "found"),
    [
        ("john @ example . com", "email", "john @ example . com"), ("mail john \uff20 example \uff0e com please", "email", "john \uff20 example \uff0e com"), ("jane.doe @ my-site.co.uk ok", "email", "jane.doe @ my-site.co.uk"),
        ("call plus four four oh two oh seven nine four six one two", "phone", "plus four four oh two oh seven nine four six one two"), ("please write to jane at example dot org", "email", "jane at example dot org"),
        ("my email is bob at site dot net ok", "email", "bob at site dot net"), ("Contact: Jane at example dot org", "email", "Jane at example dot org"), ("so\nJane at example dot org\nor", "email", "Jane at example dot org"),
    ],
)
def test_disguises_by_where_they_stand(text, kind, found):
    assert [(pii.KINDS[k], text[a:b]) for a, k, b in pii.all_spans(text, pii.base_spans(text))] == [(kind, found)]


def sentence(r):
    """A plain sentence that names a site in words."""
    word = lambda: "".join(r.choice(list("abcdefghijklmnopqrstuvwxyz"), r.integers(3, 9)))
    pick = lambda *x: x[r.integers(len(x))]
    site = word() + " dot " + pick("com", "org", "co dot uk", "net", word())
    verb = pick("shop", "look", "read", "work", "meet", "buy books", "watch films", "ask around", "order", word())
    start = pick(
        f"We {verb} at ", f"I read {pick('it', 'that', 'them', word())} at ", f"They like to {verb} at ", f"{verb.capitalize()} at ", f"follow {word()} at ", f"the {word()} is open at ", f"He told us to {verb} at ",
        f"Our {word()} {word()} at ", f"prices {word()} at ", f"{word()} {word()} and {word()} at ",
    )
    return start + site + pick(" every week", ".", " for free", ", so they said", " " + word())


def test_precision_and_recall_of_addresses_in_words():
    """500 clean sentences with a bare "at" and "dot", 2000 disguises of the same form among others."""
    r = np.random.default_rng(21)
    wrong = [t for t in (sentence(r) for _ in range(500)) if pii.all_spans(t, pii.base_spans(t))]
    word = lambda: "".join(r.choice(list("abcdefghijklmnopqrstuvwxyz"), r.integers(3, 9)))
    caught = 0
    for _ in range(2000):
        if r.random() < 0.5:
            text, kind, (a, b) = disguised(r)
        else:
            local = (word() + (word(), "." + word(), "_" + word(), str(r.integers(1, 99)))[r.integers(4)])
            dot, at = (x[r.integers(len(x))] for x in ((" dot ", "[.]", " (dot) "), (" at ", " [at] ", "(at)")))
            before = ("my email is ", "write to ", f"{word()} {word()}: ", "contact ", f"{word()}, ", f"{word()} {word()}\n", "reply to me by mail, ", "(")[r.integers(8)]
            found = local + at + word() + dot + ("com", "org", "net", "xyz", word())[r.integers(5)]
            text, kind, (a, b) = before + found + " " + word(), 0, (len(before), len(before) + len(found))
        caught += any(k == kind and s < b and e > a for s, k, e in pii.all_spans(text, pii.base_spans(text)))
    assert len(wrong) <= 0.05 * 500 and caught >= 0.95 * 2000, (len(wrong), wrong[:5], caught)


@pytest.mark.parametrize(
    ("text", "kind", "found"),
    [
        ("at 192.168.one.7 now", "ip", "192.168.one.7"), ("card 4111 1111 1111 one 111 ok", "card", "4111 1111 1111 one 111"), ("call plus one 202 555 0147", "phone", "plus one 202 555 0147"),
        ("call +1 (two) 02-555-0147", "phone", "+1 (two) 02-555-0147"), ("at 192.168.ſix.7 now", "ip", "192.168.ſix.7"),
    ],
)
def test_lone_spelled_digits(text, kind, found):
    assert [(pii.KINDS[k], text[a:b]) for a, k, b in pii.all_spans(text, pii.base_spans(text))] == [(kind, found)]


def test_trigger_loses_nothing(monkeypatch):
    r = np.random.default_rng(6)
    parts = ["one", "Six", "fİve", "zero", "1", "4111 1111 1111", "192.168", ".", " ", "-", "+", "plus ", "(", ")", " at ", " dot ", "[at]", "{ dot }", "a@b", "com", "x", "\ue000", "１", "[.]", "(@)", "O", "l", "a.b", " dash "]
    texts = ["".join(r.choice(parts, 9)) for _ in range(4000)]
    quick = [pii.all_spans(t, pii.base_spans(t)) for t in texts]
    monkeypatch.setattr(pii, "triggered", lambda t: True)
    assert quick == [pii.all_spans(t, pii.base_spans(t)) for t in texts]
    assert sum(len(q) > len(pii.base_spans(t)) for q, t in zip(quick, texts, strict=True)) > 20


def test_clean_text_has_no_spans(spark, small):
    assert pii.all_spans("look at the dot and one more at home", []) == []
    docs = spark.createDataFrame([(1, None, 1), (2, "", 1), (2, "a@b.c " * 3000, 1), (None, "at one dot", 1)], "doc_id long, text string, spans int")
    rows = pii.find_pii(docs).collect()
    assert sorted(r.n_email for r in rows) == [0, 0, 0, 3000]
    masked = pii.mask_pii(docs)
    assert masked.columns == docs.columns and masked.where("text = ''").count() == 1
    assert pii.find_pii(docs.limit(0)).count() == 0


def test_languages_on_held_out(spark, small):
    docs = {r.doc_id: r.lang for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = [r for r in langid.op8_langid(spark, small).collect() if r.held_out]
    assert rows and all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in rows)
    assert sum(r.lang_pred == docs[r.doc_id] for r in rows) >= 0.95 * len(rows)


def test_language_of_odd_rows(spark):
    train = spark.createDataFrame([("en", "the cat and the dog"), ("fr", "le chat et le chien"), (None, "x"), ("de", None)], "lang string, text string")
    filters = langid.learn(train)
    docs = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "12 !!", 1), (4, "the dog", 1), (4, "the dog", 1), (None, "le chien", 1), (5, "the cat " * 30000, 1)], "doc_id long, text string, score int")
    got = sorted((repr(r.doc_id), r.lang_pred) for r in langid.predict_languages(docs, filters).collect())
    assert got == [("1", "und"), ("2", "und"), ("3", "und"), ("4", "en"), ("4", "en"), ("5", "en"), ("None", "fr")]
    assert langid.predict_languages(docs, langid.learn(train.limit(0))).where("lang_pred <> 'und'").count() == 0


def test_language_does_not_depend_on_the_batch():
    texts = ["a", "the dog", "chat", "x", "12", "é"]
    together = langid.grams(texts)
    for n, t in enumerate(texts):
        assert langid.grams([t])[1].tolist() == together[1][together[0] == n].tolist()
    assert len(langid.grams(["a"])[1]) == 1
    f = langid.LanguageFilters.build(["en", "fr"], [langid.grams(["the dog a"])[1], langid.grams(["le chat"])[1]])
    alone = [f.predict([t]) for t in texts]
    assert f.predict(texts) == ([a[0] for a, _ in alone], [b[0] for _, b in alone])
    assert f.predict(["a"])[0] == ["en"] and langid.grams([])[0].tolist() == []


def brute_language(filters, sets, text):
    """Popcounts with Python's own sets and letters, corrected as the filters say."""
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    found = [f" {w} "[k : k + 3] for w in words for k in range(len(w))]
    if not found:
        return "und", 0.0
    true = [max(0.0, (sum(g in own for g in found) - r * len(found)) / (1 - r)) for own, r in zip(sets, filters.false_rate, strict=True)]
    if not sum(true):
        return filters.langs[filters.common], 0.0
    return filters.langs[true.index(max(true))], max(true) / sum(true)


def test_languages_by_hand():
    r = np.random.default_rng(12)
    parts = ["the", "chat", "hund", "y", "é", "ß", "12", "-", "THE", "le", "qqq", "x", "\u4e2d"]
    training = {"de": "der hund und the katze ß", "en": "the dog and the cat", "fr": "le chat et le chien é"}
    sets = [{f" {w} "[k : k + 3] for w in t.split() for k in range(len(w))} for t in training.values()]
    filters = langid.LanguageFilters.build(list(training), [np.unique(langid.grams([t])[1]) for t in training.values()], common=1)
    texts = [" ".join(r.choice(parts, r.integers(0, 6))) for _ in range(500)] + ["qqq", "", "12"]
    for n, (lang, score) in enumerate(zip(*filters.predict(texts), strict=True)):
        want = brute_language(filters, sets, texts[n])
        assert lang == want[0] and abs(score - want[1]) < 1e-9, texts[n]
    assert filters.predict(["qqq"]) == (["en"], [0.0])


def test_equal_popcounts_go_by_name():
    filters = langid.LanguageFilters.build(["b", "c"], [langid.grams(["the"])[1], langid.grams(["cat"])[1]])
    filters.false_rate[:] = 0
    assert filters.predict(["cat the"])[0] == ["b"]


def test_the_most_common_language_stands_in(spark):
    train = spark.createDataFrame([("en", "aaa"), ("fr", "bbb"), ("fr", "ccc")], "lang string, text string")
    docs = spark.createDataFrame([(1, "zzz"), (2, "a\u0300 \u4e2d\u6587"), (3, "aaa")], "doc_id long, text string")
    assert [(r.lang_pred, r.score) for r in langid.predict_languages(docs, langid.learn(train)).orderBy("doc_id").collect()] == [("fr", 0.0), ("fr", 0.0), ("en", 1.0)]


def test_bitmask_filters_hold_all_they_were_given():
    r = np.random.default_rng(1)
    codes = [r.integers(1, 1 << 60, 500).astype(np.uint64) for _ in range(70)]
    f = langid.LanguageFilters.build([f"l{n:02d}" for n in range(70)], codes)
    for n in (0, 63, 64, 69):
        assert (f.containing(codes[n])[n // 64] >> np.uint64(n % 64) & np.uint64(1)).all()
    assert f.false_rate.max() < 0.02


def test_quality_on_held_out(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in quality.op9_quality(spark, sf).collect() if r.held_out and r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id] for r in rows) >= 0.9 * len(rows)


def test_the_kinds_of_bad_text_that_training_never_had(spark):
    """Learned at sf0.1; no such text is in it. Nothing in the training says that these are bad: most are told by what they share with other bad text."""
    sf = "/root/testdata/sf0.1"
    _, model = quality._fitted(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"), 5)
    unseen = ["BUY NOW CHEAP WATCHES ONLINE CLICK HERE FOR MORE " * 20, "asdf jkl; qwer zxcv hjkl; asd " * 40, '<div class="x"><a href="/p?id=1">home</a></div> ' * 30, "Ã©tÃ© â€œÃ  la â€™ " * 40, "*** --- *** === " * 40]
    assert sum(model.score(np.array([quality.features(t) for t in unseen], np.float64)) < 0.3) >= 4
    assert 0.8 < model.prior < 0.93


def risk_by_hand(x, positive, theta, prior, ridge):
    loss = lambda z: np.log1p(np.exp(-z))
    g = x @ theta
    negative = loss(-g).mean() - prior * loss(-g[positive]).mean()
    return prior * loss(g[positive]).mean() + max(0, negative) + ridge / 2 * (theta[1:] ** 2).sum(), negative


def sampled(seed, n=400, d=5):
    r = np.random.default_rng(seed)
    good = r.random(n) < 0.7
    x = np.column_stack([np.ones(n), r.normal(size=(n, d - 1)) + 1.5 * good[:, None]])
    return x, good & (r.random(n) < 0.4), r.normal(size=d) * 0.3


@pytest.mark.parametrize("seed", range(4))
def test_risk_and_gradient_by_hand(seed):
    x, positive, theta = sampled(seed)
    at = lambda t: (quality.Sums(quality.sums_of(x, t), x.shape[1]), quality.Sums(quality.sums_of(x[positive], t), x.shape[1]))
    own = quality.NonNegative(*at(theta), theta, 0.7, 0.01)
    risk, negative = risk_by_hand(x, positive, theta, 0.7, 0.01)
    assert np.isclose(own.risk, risk) and np.isclose(own.negative, negative)
    for k in range(len(theta)):
        e = np.eye(len(theta))[k] * 1e-6
        (up, n_up), (down, n_down) = (risk_by_hand(x, positive, theta + s * e, 0.7, 0.0) for s in (1, -1))
        assert np.isclose(own.up[k], (n_up - n_down) / 2e-6, atol=1e-6)
        if negative > 0:
            assert np.isclose(own.gradient[k], (up - down) / 2e-6, atol=1e-6)
    found = quality.fit(at, x.shape[1], 0.7, 1e-3)
    last = risk_by_hand(x, positive, found, 0.7, 1e-3)
    assert last[1] > -0.01
    r = np.random.default_rng(seed)
    for _ in range(300):  # no point near by that keeps the floor is better
        near = risk_by_hand(x, positive, found + r.normal(size=len(found)) * 0.05, 0.7, 1e-3)
        assert near[1] < last[1] or near[0] > last[0] - 1e-3


def test_sums_in_spark_are_those_by_hand(spark):
    d, r = len(quality.FEATURES), np.random.default_rng(1)
    x, positive, theta = r.normal(size=(60, d)).astype(np.float32), r.integers(0, 3, 60), r.normal(size=d) * 0.1
    rows = spark.createDataFrame([(v.tolist(), int(p)) for v, p in zip(x, positive, strict=True)], "x array<float>, positive int").repartition(3)
    u, p = quality.summed(rows, np.zeros(d), np.ones(d), (1,))(theta)
    for got, part in ((u, x), (p, x[positive == 1])):
        s = 1 / (1 + np.exp(-(part.astype(float) @ theta)))
        assert np.allclose(got.sx, (s[:, None] * part).mean(0)) and np.allclose(got.curve, (part * (s * (1 - s))[:, None]).T.astype(float) @ part / len(part), atol=1e-6)


@pytest.mark.parametrize("prior", [0.3, 0.6, 0.9])
def test_prior_of_a_mixture(prior):
    r = np.random.default_rng(5)
    good, bad = (np.clip(r.normal(m, 120, 200_000), 0, 999).astype(int) for m in (700, 300))
    n = int(prior * 100_000)
    u = np.bincount(np.concatenate([good[:n], bad[: 100_000 - n]]), minlength=1000)
    assert abs(quality.best_bin_prior(u, np.bincount(good[100_000:], minlength=1000)) - prior) < 0.03


def test_features_of_long_texts_are_counted_by_pieces(monkeypatch):
    texts = ["Ab1 c!\n\n" * 40, "a", "  ", None, "é中 " * 30]
    whole = [quality.features(t) for t in texts]
    monkeypatch.setattr(quality, "CHUNK", 7)
    assert all(np.allclose(a, quality.features(t)) for a, t in zip(whole, texts, strict=True))


def test_quality_of_odd_rows(spark):
    docs = spark.createDataFrame([(n, "Some plain text of words, as written.", 1) for n in range(40)] + [(50, None, 1), (51, "", 1), (52, "## $$ " * 5000, 1), (52, "## $$ " * 5000, 1), (None, "plain", 1)], "doc_id long, text string, x int")
    labels = spark.createDataFrame([(n, 1) for n in range(20)] + [(None, 1), (52, 0), (52, 1)], "doc_id long, quality int")
    rows = quality.learn_and_score(docs, labels).collect()
    assert len(rows) == 45 and all(0 <= r.score <= 1 for r in rows)
    assert quality.keep_good(docs, labels).columns == docs.columns
    assert quality.learn_and_score(docs, labels.limit(0)).count() == 45
    assert quality.learn_and_score(docs.limit(0), labels).count() == 0
