"""Each training-data operator against a brute-force version on small tables with nulls, empty and long texts, ties, repeated
rows, empty tables and extra columns."""

import collections
import hashlib
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pointloom.llm import byte_shards, cgk_decontam, common, conflict_packing, inner_topk, phrase_automata, pieces, ppm_lang, queries, repair_store, setsketch, token_counts, toxic_chain

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
WORDS = [a + b for a in ("ba", "co", "du", "fe", "gi", "lo", "mu") for b in ("n", "r", "st", "l", "x")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    texts = [prose(rng, rng.randrange(1, 120)) for _ in range(60)]
    passage = prose(rng, 45)
    texts += [texts[0], texts[0], texts[1].upper(), prose(rng, 30) + " " + passage, passage + "\n" + prose(rng, 10), "x " + passage[9:] + " y"]
    w = prose(rng, 200).split()
    texts += [" ".join(w), " ".join(w[:60] + ["other"] + w[61:]), " ".join(w[:100] + w[104:]), " ".join(w[:50] + ["a", "b"] + w[52:150] + ["c"] + w[151:])]
    texts += ["", "  \n\t ", None, "one two", "one  TWO", "!!! 123 ???", "ba " * 70, "É à ß ﬁ <|endoftext|> x", prose(rng, 3000)]
    out = [(i, t, "en" if i % 2 else "fr", f"s{i % 3}" if i % 7 else None, 0) for i, t in enumerate(texts)]
    return out + [(None, "null id " + passage, None, "s1", 0)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark, rows):
    # columns whose names the operators use inside
    return spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ("key", "size", "label", "node", "part", "cluster", "marks", "pos", "n_tokens")}).repartition(5).persist()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.filter("false")


def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(TOKENIZER)


# ---------------------------------------------------------------------------------------------- 1 and 5


def test_pieces_give_what_whole_texts_give():
    t = tokenizer()
    texts = ["ÄÖÜ ß ẞ İx ÿŸ µ ª º naïve <|endoftext|>. a.. b,. 1,2 d'e it's ... é́ é ſt ǅ x\xa0y\x1cq a\rb\tc x<|startoftext|>y ²x Ⅷ l’a .'s 's", "", None, "a!! b??? (c) %%%"]
    e = pieces.PieceEncoder(TOKENIZER)
    assert e.by_word
    ids, counts = e.ids(texts)
    want = [t.encode(x or "", add_special_tokens=False).ids for x in texts]
    assert ids.tolist() == [i for w in want for i in w] and counts.tolist() == list(map(len, want)) == e.count(texts)


def test_repair_round_trip_and_random_access():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 30, 500)
    docs = [np.concatenate([base[a : a + 60], rng.integers(0, 30, 5)]) for a in rng.integers(0, 400, 80)] + [np.zeros(0, int), np.full(301, 7)]
    counts = np.array([len(d) for d in docs])
    for first in (30, 70_000):
        data = repair_store.compress(np.concatenate(docs), counts, first, least=2, per_round=50)
        s = repair_store.Shard(data)
        assert s.ids().tolist() == np.concatenate(docs).tolist() and s.counts().tolist() == counts.tolist()
        for k in (0, 3, 79, 80, 81):
            assert s.document(k).tolist() == docs[k].tolist()
            n = len(docs[k])
            assert s.part(k, n // 3, n // 2).tolist() == docs[k][n // 3 : n // 2].tolist()
        assert len(s.left) and len(s.symbols) < counts.sum() / 2
        # nothing is left to replace: no pair within a document occurs twice but where it overlaps itself
        left = collections.Counter(p for k in range(s.docs) for x in [s.symbols[s.starts[k] : s.starts[k + 1]].tolist()] for p in zip(x, x[1:]) if p[0] != p[1])
        assert max(left.values()) == 1
        assert all(s.lengths[r] == len(s._expand(np.array([s.first + r]))) for r in range(len(s.left)))
    empty = repair_store.Shard(repair_store.compress(np.zeros(0, int), np.zeros(0, int), 10))
    assert empty.ids().tolist() == [] and empty.docs == 0


def test_late_rounds_of_repair_look_at_new_pairs_only(monkeypatch):
    rng = np.random.default_rng(2)
    docs = [np.concatenate([np.tile(rng.integers(0, 3000, 1 << k), 8) for k in range(1, 8)] + [rng.integers(0, 3000, 4000)]) for _ in range(6)]
    ids, counts = np.concatenate(docs), np.array(list(map(len, docs)))
    looked, sort = [], np.sort
    monkeypatch.setattr(repair_store.np, "sort", lambda x, *a, **k: looked.append(len(x)) or sort(x, *a, **k))
    s = repair_store.Shard(repair_store.compress(ids, counts, 3000))
    monkeypatch.undo()
    assert s.ids().tolist() == ids.tolist() and s.counts().tolist() == counts.tolist() and len(s.ends) > 5
    late = looked[-2:]  # every round sorts pairs
    assert max(late) < len(s.symbols) / 4
    left = collections.Counter(p for k in range(s.docs) for x in [s.symbols[s.starts[k] : s.starts[k + 1]].tolist()] for p in zip(x, x[1:]))
    assert max(left.values()) < 8


def test_long_and_short_rules_expand_alike(monkeypatch):
    ids = np.concatenate([np.full(5000, 3), np.tile(np.arange(7), 300), np.tile(np.arange(200), 9)])
    data = repair_store.compress(ids, np.array([5000, 2100, 1800]), 200)
    for short in (1, 2, 64, 1 << 20):
        monkeypatch.setattr(repair_store, "SHORT", short)
        s = repair_store.Shard(data)
        assert int(s.lengths.max()) > 64 and s.ids().tolist() == ids.tolist() and s.part(2, 150, 950).tolist() == ids[7250:8050].tolist()


def test_words_stay_known_when_the_memory_of_pieces_is_full(monkeypatch):
    monkeypatch.setattr(pieces, "MEMO", 20)
    e = pieces.PieceEncoder(TOKENIZER)
    want = e.ids(["banst lorx", " ".join(f"banst{m}" for m in "!?.,;:()[]{}<>#$%&*+-=/@^_~|")])[0].tolist()
    asked = []

    class Model:
        def tokenize(self, word, model=e.model):
            asked.append(word)
            return model.tokenize(word)

    e.model = Model()
    assert e.ids(["banst lorx"])[0].tolist() == want[: len(e.ids(["banst lorx"])[0])] and len(e.memo) < 20 and not asked


def test_rows_that_repeat_and_long_texts_in_stores_and_counts(spark):
    rng = random.Random(15)
    long = prose(rng, 400_000) + " É<|endoftext|>"
    rows = [(3, long), (1, "a b"), (1, "a b"), (1, None), (None, "x"), (None, "x"), (2, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    t = tokenizer()
    ids = {x: t.encode(x or "", add_special_tokens=False).ids for _, x in rows}
    got = sorted(map(tuple, repair_store.token_store(df, TOKENIZER).collect()), key=lambda r: r[1])
    at = 0
    for i, start, n, crc in got:
        assert start == at
        at += n
    want = sorted((str(i), len(ids[x]) + 1, zlib.crc32(np.array([*ids[x], 2], "<u4").tobytes())) for i, x in rows)
    assert sorted((str(i), n, c) for i, _, n, c in got) == want and [i for i, *_ in got] == [None, None, 1, 1, 1, 2, 3]
    counts = token_counts.token_counts(df, TOKENIZER).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in counts) == sorted((str(i), len((x or "").encode()), len(ids[x])) for i, x in rows)


def test_token_store(docs, rows, empty):
    got = repair_store.token_store(docs, TOKENIZER, shard_ids=2000).collect()
    t, at, want = tokenizer(), 0, []
    for i, text, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert repair_store.token_store(empty, TOKENIZER).count() == 0


def test_token_counts_with_overlaps_that_must_widen(spark, docs, rows, empty):
    t = tokenizer()
    more = [(1000, "x" * 900 + " tail", None, None, 0), (1001, "y" * 70 + " " + "z" * 300 + " end", None, None, 0), (1002, " " * 400 + "w", None, None, 0)]
    got = token_counts.token_counts(docs.select("doc_id", "text").union(spark.createDataFrame(more, SCHEMA).select("doc_id", "text")), TOKENIZER, chunk_chars=100, overlap_chars=24, token_limit=50).collect()
    want = {(i, len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False).ids)) for i, x, *_ in rows + more}
    assert {(r.doc_id, r.n_bytes, r.n_tokens) for r in got} == want and len(got) == len(rows) + 3
    assert all(r.over_limit == (r.n_tokens > 50) for r in got)
    assert token_counts.token_counts(empty, TOKENIZER).count() == 0


# ---------------------------------------------------------------------------------------------- 2, 3, 4


def test_toxicity_chain(spark, empty):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(400):
        toxic, junk = i % 4 == 0, i % 3 == 0
        w = prose(rng, 40).split()
        if toxic:
            w[rng.randrange(40)] = rng.choice(["wretchx", "vilehe"])
        if junk:
            w[rng.randrange(40)] = "zzgarble"
        rows.append((i, " ".join(w), "clash"))
        labels.append((i, int(toxic), int(not junk)))
    rows += [(None, None, ""), (900, "", ""), (901, "a vilehe thing", "")]
    labels += [(5000, 1, 1), (1, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, f string")
    table = spark.createDataFrame(labels, "doc_id long, toxic int, quality int")
    chain = {"p_toxic": F.col("toxic"), "p_junk": F.col("toxic") * (1 - F.col("quality"))}
    got = {r.doc_id: r for r in toxic_chain.toxicity(docs, table, chain, features=200).collect()}
    assert len(got) == 403
    assert sum(got[i].toxic == (i % 4 == 0) for i in range(400)) >= 396
    assert got[901].toxic and not got[900].toxic and not got[None].toxic
    junk = [got[i].p_junk for i in range(400) if i % 12 == 0]
    assert min(junk) > max(0.3, np.mean([got[i].p_junk for i in range(400) if i % 12]))
    assert toxic_chain.toxicity(empty, table, chain, features=200).count() == 0
    none = toxic_chain.toxicity(docs, table.filter("false"), chain).collect()
    assert len(none) == 403 and not any(r.toxic for r in none)


def newton(x, y, reg):
    """Weights and intercept of the logistic regression with penalty reg / 2 * |w|^2 on the mean loss."""
    x1 = np.c_[x, np.ones(len(x))]
    w = np.zeros(x1.shape[1])
    pen = np.r_[np.full(x.shape[1], reg), 0.0]
    for _ in range(60):
        p = 1 / (1 + np.exp(-x1 @ w))
        w = w - np.linalg.solve((x1 * (p * (1 - p))[:, None]).T @ x1 / len(x) + np.diag(pen + 1e-12), x1.T @ (p - y) / len(x) + pen * w)
    return w


def test_toxicity_chain_against_a_plain_one(spark):
    """Features by plain Python sets, chosen without the fold that is scored; models by Newton's method."""
    rng = random.Random(22)
    rows, labels = [], []
    for i in range(160):
        w = prose(rng, 12).split()
        toxic, junk = i % 4 == 0, i % 3 == 0
        if rng.random() < 0.9 if toxic else rng.random() < 0.1:
            w[3] = "wretchx"
        if rng.random() < 0.9 if junk else rng.random() < 0.1:
            w[7] = "zzgarble"
        rows.append((i, " ".join(w)))
        labels.append((i, float(toxic), float(toxic and junk)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    chain = {"a": F.col("a"), "b": F.col("b")}
    got = {r.doc_id: r for r in toxic_chain.toxicity(docs, spark.createDataFrame(labels * 2, "doc_id long, a double, b double"), chain, features=24, max_iter=400).collect()}
    fold = {r.doc_id: r.f for r in docs.select("doc_id", F.pmod(F.xxhash64("text"), F.lit(4)).alias("f")).collect()}

    def buckets(text):
        return {int(x) for _, b in toxic_chain.grams(pa.array([text])) for x in b}

    held = [buckets(t) for _, t in rows]
    for n, text in enumerate(t for _, t in rows[:20]):  # as many as there are distinct grams
        plain = {(k, (" " + text)[i : i + k]) for k in toxic_chain.SIZES for i in range(len(text) + 2 - k) if " " not in (" " + text)[i + 1 : i + k]}
        assert len(held[n]) == len(plain)

    def choose(train):
        out = set()
        for c in (1, 2):
            yes = sum(labels[i][c] for i in train)
            score = {}
            for b in set().union(*(held[i] for i in train)):
                n, n1 = sum(b in held[i] for i in train), sum(b in held[i] for i in train if labels[i][c])
                p1, p0, p = (n1 + 0.5) / (yes + 1), (n - n1 + 0.5) / (len(train) - yes + 1), (n + 1) / (len(train) + 2)
                score[b] = abs(p1 - p0) / (p * (1 - p) * (1 / yes + 1 / (len(train) - yes))) ** 0.5
            out |= set(sorted(score, key=lambda b: (-score[b], b))[:12])
        return sorted(out)

    matrix = lambda ids, own: np.array([[b in held[i] for b in own] for i in ids], float)
    sets = [choose([i for i in range(160) if fold[i] != j]) for j in range(5)]
    y = np.array([x[1:] for x in labels])
    first = newton(matrix(range(160), sets[4]), y[:, 0], 0.0005)
    oof = np.zeros(160)
    for j in range(4):
        train, test = [i for i in range(160) if fold[i] != j], [i for i in range(160) if fold[i] == j]
        w = newton(matrix(train, sets[j]), y[train, 0], 0.0005)
        oof[test] = 1 / (1 + np.exp(-(matrix(test, sets[j]) @ w[:-1] + w[-1])))
    second = newton(np.c_[matrix(range(160), sets[4]), oof], y[:, 1], 0.0005)
    p0 = 1 / (1 + np.exp(-(matrix(range(160), sets[4]) @ first[:-1] + first[-1])))
    p1 = 1 / (1 + np.exp(-(np.c_[matrix(range(160), sets[4]), p0] @ second[:-1] + second[-1])))
    assert max(abs(got[i].a - p0[i]) for i in range(160)) < 0.01 and max(abs(got[i].b - p1[i]) for i in range(160)) < 0.01


def test_long_texts_are_scored_whole(spark):
    rng = random.Random(23)
    rows = [(i, prose(rng, 30) + (" wretchx" if i % 2 else "")) for i in range(200)] + [(900, prose(rng, 500_000) + " wretchx " + prose(rng, 500_000)), (901, prose(rng, 300_000))]
    assert len(rows[-2][1]) > 3_000_000
    table = spark.createDataFrame([(i, i % 2, 1) for i in range(200)] + [(0, 0, 1)] * 3, "doc_id long, toxic int, quality int")
    df = spark.createDataFrame(rows * 2, "doc_id long, text string")
    got = toxic_chain.toxicity(df, table, {"p": F.col("toxic"), "q": F.col("toxic") * F.col("quality")}, features=100, fit_rows=150).collect()
    assert len(got) == 404 and all(r.toxic == (r.doc_id % 2 == 1 if r.doc_id < 900 else r.doc_id == 900) for r in got)


def brute_fit(items, capacity):
    bins, out = [], []
    for size, source, cluster in items:
        fits = [(capacity - b["used"] - size, k) for k, b in enumerate(bins) if capacity - b["used"] >= size and (source is None or source not in b["s"]) and (cluster is None or cluster not in b["c"])]
        left = min((capacity - bins[k]["used"], k) for _, k in fits)[1] if fits else len(bins)
        if left == len(bins):
            bins.append({"used": 0, "s": set(), "c": set()})
        b = bins[left]
        b["used"] += size
        b["s"] |= {source} - {None}
        b["c"] |= {cluster} - {None}
        out.append(left)
    return out


def test_best_fit_against_brute_force():
    rng = random.Random(4)
    for n in (0, 1, 40, 300):
        items = sorted(((rng.randrange(1, 100), rng.choice(["a", "b", "c", None]), rng.choice([1, 2, 3, 4, None])) for _ in range(n)), key=lambda x: -x[0])
        got = conflict_packing.best_fit(*([x[k] for x in items] for k in range(3)), 100)
        assert got == brute_fit(items, 100)


def test_packing_is_whole_and_free_of_conflicts(docs, rows, empty):
    got = conflict_packing.pack(docs, capacity=600, group_rows=25).collect()
    size = collections.Counter()
    for r in got:
        size[r.doc_id] += r.size
    assert size == {r[0]: len((r[1] or "").encode()) + 1 for r in rows}
    source, text = {r[0]: r[3] for r in rows}, {r[0]: r[1] for r in rows}
    bins = collections.defaultdict(list)
    for r in got:
        bins[r.bin_id].append(r)
    for b in bins.values():
        assert sum(r.size for r in b) == b[0].bin_used <= 600
        at = 0
        for r in sorted(b, key=lambda r: r.bin_offset):
            assert r.bin_offset == at
            at += r.size
        named = [source[r.doc_id] for r in b if source[r.doc_id] is not None]
        assert len(named) == len(set(named))
        known = [text[r.doc_id] for r in b if text[r.doc_id] is not None]
        assert len(known) == len(set(known))
    assert conflict_packing.pack(empty).count() == 0


def test_exact_top_k(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(0, 0.3, (240, 16)) * rng.choice([0.1, 1, 3], (240, 1))
    v[50:60] = v[40]
    table = [(i, x.tolist(), 0) for i, x in enumerate(v)] + [(240, None, 0), (241, [1.0, None] * 8, 0), (242, [float("nan")] * 16, 0), (243, [float("inf")] * 16, 0), (244, [], 0), (None, [1.0] * 16, 0), (260, [1.0, 2.0], 0)]
    df = spark.createDataFrame(table, "vec_id long, embedding array<double>, label int")
    got = inner_topk.top_inner_products(inner_topk.integer_vectors(df), F.col("vec_id") % 20 == 0, k=20, block=32, query_block=5, leaders=40).collect()
    whole = np.floor(64 * v).astype(int)
    want = []
    for q in range(0, 240, 20):
        s = whole @ whole[q]
        best = sorted((i for i in range(240) if i != q), key=lambda i: (-s[i], i))[:20]
        want += [(q, k + 1, i, s[i]) for k, i in enumerate(best)]
    assert sorted(map(tuple, got)) == sorted(want)
    # ids that repeat are rows of their own, and no candidates of each other; columns of any name may come along
    twice = df.union(df.filter("vec_id in (20, 45)")).withColumns({c: F.lit("clash") for c in ("n2", "dims", "rank", "level", "need", "v")})
    got = collections.Counter(map(tuple, inner_topk.top_inner_products(inner_topk.integer_vectors(twice), F.col("vec_id") % 20 == 0, k=20, block=32, query_block=5, leaders=40, salts=3).collect()))
    twice_ids = [*range(240), 20, 45]
    want = collections.Counter()
    for q in [*range(0, 240, 20), 20]:
        s = whole @ whole[q]
        best = sorted((i for i in twice_ids if i != q), key=lambda i: (-s[i], i))[:20]
        want.update((q, k + 1, i, s[i]) for k, i in enumerate(best))
    assert got == want
    few = inner_topk.top_inner_products(inner_topk.integer_vectors(df.filter("vec_id < 5")), F.col("vec_id") % 20 == 0, k=20).collect()
    assert len(few) == 4
    assert inner_topk.top_inner_products(inner_topk.integer_vectors(df.filter("false")), F.col("vec_id") % 20 == 0).count() == 0


# ---------------------------------------------------------------------------------------------- 6, 7, 8


def test_ppm_code_lengths_against_a_plain_tree():
    texts = {"a": [b"abracadabra abra", b"cadabra"], "b": [b"banana bandana"]}
    trees = ppm_lang.ContextTrees(texts)

    def bits(lang, context, symbol):
        data = [b"\n\n\n" + t for t in texts[lang]]
        data = b"".join(data)  # trees count over the joined, padded texts
        for n in (3, 2, 1, 0):
            c = context[len(context) - n :]
            after = collections.Counter(data[i + n] for i in range(len(data) - n) if data[i : i + n] == c)
            total, kinds = sum(after.values()), len(after)
            if total and after[symbol]:
                return esc(lang, context, n) - np.log2(after[symbol] / (total + kinds))
        return esc(lang, context, -1) + 8

    def esc(lang, context, upto):
        data = b"".join(b"\n\n\n" + t for t in texts[lang])
        out = 0.0
        for n in range(3, upto, -1):
            c = context[len(context) - n :]
            after = collections.Counter(data[i + n] for i in range(len(data) - n) if data[i : i + n] == c)
            if after:
                out -= np.log2(len(after) / (sum(after.values()) + len(after)))
        return out

    probe = b"\n\n\nabandon zebra"
    got = trees.code_lengths(np.frombuffer(probe, np.uint8))
    for k in range(3, len(probe)):
        for x, lang in enumerate(trees.langs):
            assert got[k - 3, x] == pytest.approx(bits(lang, probe[k - 3 : k], probe[k]), abs=1e-4)


def test_language_of_held_out_documents(spark, docs, empty):
    rng = random.Random(6)
    en = [f"the {rng.choice(['cat', 'dog', 'bird'])} was {rng.choice(['running', 'sleeping', 'there'])} with that thing" for _ in range(80)]
    de = [f"der {rng.choice(['Hund', 'Vogel', 'Baum'])} ist {rng.choice(['nicht', 'schon', 'auch'])} über die Straße gegangen" for _ in range(80)]
    rows = [(i, t, "en" if i < 80 else "de", "x") for i, t in enumerate(en + de)] + [(500, None, "en", ""), (501, "12 !?", "en", ""), (None, "the thing", None, ""), (502, "die Straße", None, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    got = {r.doc_id: r for r in ppm_lang.identify(df).collect()}
    assert all(got[i].lang_pred == ("en" if i < 80 else "de") for i in range(160))
    assert all(r.held_out == (i is not None and zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    assert got[500].lang_pred == got[501].lang_pred == "und" and got[500].score == 0
    assert got[502].lang_pred == "de" and got[None].lang_pred == "en" and all(0 <= r.score <= 1 for r in got.values())
    assert ppm_lang.identify(empty).count() == 0
    assert {r.lang_pred for r in ppm_lang.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_every_language_is_learned(spark):
    """More than 64 languages, one of long documents alone, one of a single document; priors from all labelled documents."""
    rng = random.Random(41)
    tongue = [["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(8)] for _ in range(72)]
    say = lambda k, n: " ".join(rng.choice(tongue[k]) for _ in range(n))
    rows = [(i, say(i % 70, 30), f"l{i % 70:02}", zlib.crc32(str(i).encode()) % 4 == 2) for i in range(560)]
    rows += [(1000 + i, say(70, 12_000), "long", False) for i in range(6)] + [(1100, say(71, 12_000), "once", False), (1200, say(70, 40), "long", True), (1201, say(71, 40), "once", True)]
    docs = spark.createDataFrame([(i, t, x) for i, t, x, _ in rows], "doc_id long, text string, lang string")
    for how in ({}, {"fit_bytes": 3_000, "fit_doc_bytes": 2_048}):
        got = {r.doc_id: r.lang_pred for r in ppm_lang.identify(docs, **how).collect()}
        assert got == {i: x for i, _, x, _ in rows}
    trees = ppm_lang.fit(docs, F.col("lang"), fit_bytes=3_000)
    n = collections.Counter(x for _, _, x, _ in rows)
    assert trees.langs == sorted(n) and np.allclose(trees.prior, [-np.log2(n[x] / len(rows)) for x in sorted(n)])


def test_edit_distance():
    rng = random.Random(7)

    def plain(a, b):
        p = list(range(len(b) + 1))
        for i, x in enumerate(a):
            q = [i + 1]
            for j, y in enumerate(b):
                q.append(min(p[j] + (x != y), p[j + 1] + 1, q[j] + 1))
            p = q
        return p[-1]

    for _ in range(300):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(0, 9))] for _ in range(2))
        assert cgk_decontam.edit_distance(a, b) == plain(a, b)


def test_contamination_against_brute_force(spark, docs, empty):
    rng = random.Random(8)
    items = [(i, prose(rng, n)) for i, n in enumerate((30, 25, 12, 4, 40))] + [(10, None), (11, " !! "), (None, prose(rng, 20)), (12, "dup one two three four five"), (13, "dup one two three four five")]
    texts = []
    for k in range(60):
        w = items[k % 5][1].split()
        for _ in range(k // 10):
            p, what = rng.randrange(len(w)), rng.random()
            w = w[:p] + ["new"] + w[p + 1 :] if what < 0.5 else w[:p] + w[p + 1 :] if what < 0.75 and len(w) > 2 else w[:p] + ["ins"] + w[p:]
        texts.append((k, f"{prose(rng, 15)} {' '.join(w).upper()}; {prose(rng, 15)}", ""))
    texts += [(100, None, ""), (101, "", ""), (102, items[0][1][:80], ""), (103, "a dup one, two three four five b", ""), (None, items[1][1], "")]
    df = spark.createDataFrame(texts, "doc_id long, text string, item_id string")
    got = {(r.doc_id, r.item_id): r.edits for r in cgk_decontam.contaminated(df, spark.createDataFrame(items, "item_id long, text string"), item_block=4).collect()}
    split = lambda t: [w for w in re.split(r"[^0-9A-Za-z\x80-\U0010ffff]+", (t or "").lower()) if w]
    want = brute_leaks([(d, split(t)) for d, t, _ in texts], [(i, split(t)) for i, t in items])
    assert set(got) <= set(want) and len(got) >= 0.98 * len(want)
    assert all(got[k] >= want[k] for k in got) and all(k in got for k, e in want.items() if e == 0)
    assert cgk_decontam.contaminated(empty, spark.createDataFrame(items, "item_id long, text string")).count() == 0
    assert cgk_decontam.contaminated(df, spark.createDataFrame([], "item_id long, text string")).count() == 0


def brute_leaks(texts, items):
    """Edits of the closest run of words, of whatever length, for each pair within a fifth of the item's words."""
    want = {}
    for d, w in texts:
        for i, x in items:
            e = int(len(x) * 0.2 + 1e-9)
            runs = [cgk_decontam.edit_distance(x, w[s : s + n]) for n in range(max(1, len(x) - e), len(x) + e + 1) for s in range(len(w) - n + 1)] if x else []
            if runs and min(runs) <= e:
                want[d, i] = min(runs)
    return want


def test_contamination_with_inserted_and_deleted_words(spark, tmp_path):
    """op7 against brute force over all windows of m - e to m + e words: all pairs, with their edits."""
    rng = random.Random(31)
    items = [(i, prose(rng, n)) for i, n in enumerate((20, 30, 9, 45, 5))]
    texts = [(200, items[0][1][: items[0][1].index(" ", 60)], None), (201, None, None), (None, f"x {items[1][1]} y", None)]
    for k in range(120):
        w = items[k % 5][1].split()
        for _ in range(k // 5 % 10):
            p = rng.randrange(1, max(2, len(w) - 1))
            w = [w[:p] + ["ins"] + w[p:], w[:p] + w[p + 1 :], w[:p] + ["new"] + w[p + 1 :]][rng.choice((k // 60, 0, 1, 2))]
        texts.append((k, f"{prose(rng, rng.choice((0, 12)))} {' '.join(w)} {prose(rng, rng.choice((0, 12)))}", None))
    spark.createDataFrame(texts, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {(r.doc_id, r.item_id): r for r in queries.QUERIES["op7_cgk_decontamination"](spark, str(tmp_path)).collect()}
    want = brute_leaks([(d, (t or "").split()) for d, t, _ in texts], [(i, t.split()) for i, t in items])
    assert set(got) <= set(want) and len(got) >= 0.98 * len(want)
    assert sum(got[k].edits == want[k] for k in got) >= 0.98 * len(got) and all(got[k].edits >= want[k] for k in got)
    by_id = dict((d, t.split()) for d, t, _ in texts if t)
    for (d, i), r in got.items():
        x = items[i][1].split()
        assert r.edits in {cgk_decontam.edit_distance(x, by_id[d][r.start : r.start + n]) for n in range(1, 2 * len(x))}


@pytest.mark.parametrize("m", (3, 5, 9, 15, 30, 60, 110))
@pytest.mark.parametrize("kind", ("replace", "insert", "delete"))
def test_recall_of_the_tables_at_the_threshold(m, kind):
    """A fifth of an item's words edited; the tables alone say which item a window may be."""
    rng = random.Random(9)
    word = lambda: f"{rng.randrange(16**6):06x}"
    items, texts = [], []
    for _ in range(40):
        x = [word() for _ in range(m)]
        items.append(" ".join(x))
        for _ in range(m // 5):
            p = rng.randrange(len(x))
            x = x[:p] + ([] if kind == "delete" else [word()]) + x[p + (kind != "insert") :]
        texts.append(" ".join([word() for _ in range(rng.randrange(30))] + x + [word() for _ in range(30)]))
    index = cgk_decontam.ItemIndex(cgk_decontam.embedded(list(range(40)), pa.array(items)), 0.8)
    w = common.Words(pa.array(texts), lower=True, separators=common.MARKS)
    found = {(d, i) for d, i, *_ in index.matches(w.hashes[0], w.first)}
    assert sum((k, k) in found for k in range(40)) >= 38 and len(found) <= 41


@pytest.mark.parametrize(("m", "n"), ((500, 12), (2000, 6), (5000, 3)))
@pytest.mark.parametrize("kind", ("replace", "insert", "delete", "mix"))
def test_recall_of_long_items_at_the_threshold(m, n, kind):
    """A fifth of the words edited; most edits in one half, too, so that a piece may hold many."""
    rng = random.Random(m)
    word = lambda: f"{rng.randrange(16**6):06x}"
    items, texts = [], []
    for k in range(n):
        x = [word() for _ in range(m)]
        items.append(" ".join(x))
        for _ in range(m // 5):
            p, what = rng.randrange(len(x) // (1 + k % 2)), rng.choice(("replace", "insert", "delete")) if kind == "mix" else kind
            x = x[:p] + ([] if what == "delete" else [word()]) + x[p + (what != "insert") :]
        texts.append(" ".join([word() for _ in range(rng.randrange(30))] + x + [word() for _ in range(30)]))
    half = " ".join(items[0].split()[: m // 2])  # holds pieces, but not the item
    began = time.time()
    index = cgk_decontam.ItemIndex(cgk_decontam.embedded(list(range(n)), pa.array(items)), 0.8)
    w = common.Words(pa.array([*texts, half, *items]), lower=True, separators=common.MARKS)
    found = {(d, i): e for d, i, _, e in index.matches(w.hashes[0], w.first)}
    assert time.time() - began < 4 * n  # seconds
    assert sum((k, k) in found for k in range(n)) >= 0.9 * n and all(found.get((n + 1 + k, k)) == 0 for k in range(n))
    assert all(e <= m // 5 for e in found.values()) and len(found) <= 2 * n


def test_contamination_of_a_very_long_text(spark):
    rng = random.Random(19)
    items = [(1, prose(rng, 40)), (2, prose(rng, 300))]
    long = [f"{rng.randrange(16**6):06x}" for _ in range(700_000)]
    long[262_130:262_130] = items[0][1].split()  # over the end of a range
    long[500_000:500_000] = items[1][1].split()
    long[690_000:690_000] = items[0][1].split()[:36]
    df = spark.createDataFrame([(5, " ".join(long)), (6, "a b " + items[0][1])] * 2, "doc_id long, text string")
    got = sorted(tuple(r)[:1] + tuple(r)[2:5] for r in cgk_decontam.contaminated(df, spark.createDataFrame(items * 2, "item_id long, text string")).collect())
    assert got == sorted([(5, 1, 262_130, 0), (5, 2, 500_000, 0), (6, 1, 2, 0)] * 2)


def test_byte_shards(docs, rows, empty):
    got = sorted(map(tuple, byte_shards.byte_shards(docs, shards=16).collect()), key=lambda r: (r[0] is not None, r[0]))
    sizes = [(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0]))]
    total, at, seen = sum(s for _, s, _ in sizes), 0, collections.Counter()
    for (i, s, c), r in zip(sizes, got, strict=True):
        shard = min(15, at * 16 // total)
        assert r == (i, s, c, "bytes", shard, seen[shard], None)
        seen[shard] += 1
        at += s
    assert byte_shards.byte_shards(empty).count() == 0


def test_rows_that_repeat_and_long_texts_in_shards_languages_and_bins(spark):
    rng = random.Random(16)
    long = "der Hund " * 400_000 + "ist nicht schön"
    rows = [(i, f"the {rng.choice(['cat', 'dog'])} was there with that thing", "en", "s") for i in range(30)]
    rows += [(i, f"der {rng.choice(['Hund', 'Vogel'])} ist nicht über die Straße gegangen", "de", "s") for i in range(30, 60)]
    rows += [(100, long, None, "s"), (101, "the thing " + "was there " * 300_000, None, "s")] + [(7, "the same", None, None)] * 3 + [(None, None, None, None)] * 3 + [(None, "the", None, None)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    got = ppm_lang.identify(df).collect()
    assert len(got) == len(rows) and {r.lang_pred for r in got if r.doc_id in (100, *range(30, 60))} == {"de"} and {r.lang_pred for r in got if r.doc_id in (101, 7, *range(30))} <= {"en"}
    assert collections.Counter(r.lang_pred for r in got if r.doc_id is None) == {"und": 3, "en": 2}
    shards = byte_shards.byte_shards(df, shards=4).collect()
    assert len(shards) == len(rows) and sorted((r.size, r.text_crc32) for r in shards) == sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t, *_ in rows)
    for k in range(4):
        assert sorted(r.slot for r in shards if r.shard == k) == list(range(sum(r.shard == k for r in shards)))
    bins = conflict_packing.pack(df, capacity=100_000).collect()
    assert sum(r.size for r in bins) == sum(len((t or "").encode()) + 1 for _, t, *_ in rows) and max(r.bin_used for r in bins) <= 100_000
    assert len({r.bin_id for r in bins if r.doc_id == 7}) == 4  # equal texts are one cluster


# ---------------------------------------------------------------------------------------------- 9, 10


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(rows, percent):
    sets = {i: shingles(t) for i, t, *_ in rows if i is not None}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sorted(sets):
        for j in sorted(sets):
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_near_duplicates(spark, docs, rows, empty):
    rng = random.Random(10)
    w = prose(rng, 300).split()
    family = []  # near copies in all grades, many more of them than hubs can settle
    for k in range(60):
        v = list(w)
        for p in rng.sample(range(300), k // 6):
            v[p] = f"e{rng.randrange(1000)}"
        family.append((2000 + k, " ".join(v), None, None, 0))
    df = docs.select("doc_id", "text").union(spark.createDataFrame(family, SCHEMA).select("doc_id", "text"))
    got = {r.doc_id: r for r in setsketch.near_duplicates(df).collect()}
    want = brute_components(rows + family, 85)
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items() if i is not None} == want
    assert all(r.kept == (r.component_id == i) for i, r in got.items() if i is not None)
    assert setsketch.near_duplicates(empty).count() == 0


def test_near_duplicates_of_templates_repeated_rows_and_long_texts(spark):
    """Pages that share seven tenths of their shingles link with nothing; rows that repeat an id or all of a row stay rows."""
    rng = random.Random(17)
    base = prose(rng, 400).split()
    rows = [(i, " ".join(base[:310] + [f"w{i}x{k}" for k in range(80)])) for i in range(700)]
    long = [f"{rng.randrange(16**6):06x}" for _ in range(300_000)]
    rows += [(1000, " ".join(long)), (1001, " ".join(long[:290_000])), (1002, " ".join(long[:150_000]))]
    rows += [(1003, "one and the same row of words"), (1003, "one and the same row of words"), (1003, "another text of this id"), (None, "one and the same row of words"), (None, "a null id alone here now"), (None, "")]
    got = setsketch.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert len(got) == len(rows)
    assert all(r.component_id == r.doc_id and r.kept for r in got if r.doc_id is not None and r.doc_id < 1000)
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got if r.doc_id in (1000, 1001, 1002)} == {(1000, 299_996, 1000), (1001, 289_996, 1000), (1002, 149_996, 1002)}
    assert sorted((str(r.doc_id), str(r.component_id)) for r in got if r.doc_id is None or r.doc_id == 1003) == [("1003", "1003")] * 3 + [("None", "1003"), ("None", "None"), ("None", "None")]


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(11)
    pool = rng.integers(0, 2**63, 3000).astype(np.uint64)
    both = [pool[:2000], pool[500:2500], np.unique(pool[:2500])]
    flat, ends = np.concatenate(both), np.r_[0, np.cumsum([len(b) for b in both])]
    a, b, union = setsketch.registers(flat, ends)
    assert (np.maximum(a, b) == union).all()
    n = np.array([2000.0])
    assert setsketch.possible(a[None], b[None], n, n, 60)[0] and not setsketch.possible(a[None], b[None], n, n, 85)[0]


def brute_repeats(rows):
    """n_words, n_removed and the hash of the kept words of each doc_id."""
    seen, want = set(), {}
    for i, text, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone = np.zeros(len(w), bool)
        for k in range(len(w) - 19):
            window = hash(tuple(w[k : k + 20]))
            if window in seen:
                gone[k : k + 20] = True
            seen.add(window)
        want[i] = (len(w), int(gone.sum()), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest())
    return want


def told_repeats(df, **how):
    return {r.doc_id: (r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in phrase_automata.remove_repeats(df, **how).collect()}


def test_repeated_passages(docs, rows, empty):
    want = brute_repeats(rows)
    for how in ({}, {"block_bytes": (500, 1000)}, {"block_bytes": (500, 1000), "hot_blocks": 1, "automaton_words": 60}):
        assert told_repeats(docs, **how) == want
    assert sum(v[1] for v in want.values()) > 100
    assert phrase_automata.remove_repeats(empty).count() == 0


def test_a_passage_in_a_third_of_all_rows_and_a_phrase_in_ever_other_surroundings(spark):
    rng = random.Random(13)
    passage, phrase = prose(rng, 60), prose(rng, 14)
    rows = [(i, " ".join([prose(rng, rng.randrange(9, 40)), *([passage] if i % 3 == 0 else [phrase] if i % 3 == 1 else []), prose(rng, 30)])) for i in range(600)]
    rows += [(700 + i, passage[k : k + 200]) for i, k in enumerate(range(0, 200, 7))] + [(900, "la " * 90), (901, "la " * 25), (902, "x " + "la " * 40 + "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = brute_repeats(rows)
    for how in ({"block_bytes": (4000, 4000)}, {"block_bytes": (4000, 4000), "hot_blocks": 3, "automaton_words": 200}):
        assert told_repeats(df, **how) == want


def test_repeats_in_a_very_long_text(spark):
    rng = random.Random(14)
    passage = prose(rng, 80)
    long = " ".join(f"{rng.randrange(10**6):x}" for _ in range(700_000))
    long = " ".join([long[:2_000_000], passage, long[2_000_000:], passage, long[1_500_000:1_600_000]])
    rows = [(1, "a " + passage + " b"), (2, long), (3, long[-300_000:]), (4, passage)]
    assert len(long) > 4_000_000
    assert told_repeats(spark.createDataFrame(rows, "doc_id long, text string")) == brute_repeats(rows)


def test_rows_that_repeat_are_one_document_to_phrase_automata(spark):
    text = prose(random.Random(12), 50)
    df = spark.createDataFrame([(7, text), (7, text), (9, text)], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_removed) for r in phrase_automata.remove_repeats(df).collect())
    assert got == [(7, 0), (7, 0), (9, 50)]
