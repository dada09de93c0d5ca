"""Backoff model, phrase mining and prefix trie against brute-force versions on small tables."""

import collections
import hashlib
import math
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pointloom.llm import gram_counts, katz, phrase_mining, prefix_trie

VOCABULARY = "the a of to in it is on we be at or an if so no up by do go".split()


def prose(rng, n):
    return " ".join(VOCABULARY[min(int(rng.expovariate(0.25)), 19)] for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    texts = [prose(rng, rng.randrange(1, 90)) for _ in range(70)]
    texts += [texts[0], texts[0].upper(), texts[1] + ". " + texts[2], "a,b;c:d!e?f\ng\rh", "É x é X", "", None, " \t\n", "rare1 rare2 THE a", prose(rng, 900), "la " * 300]
    out = [(i, t, (None, "en", "fr", "und")[i % 4]) for i, t in enumerate(texts)]
    return out + [(3, texts[3], "en"), (3, texts[3], "en"), (None, texts[5] + " unseen", "fr")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    clash = ("label", "flag", "salt", "row", "block", "level", "context", "gram", "word", "a", "n", "rank")
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({c: F.lit("clash") for c in clash}).repartition(3).persist()


def held(doc):
    return doc is not None and zlib.crc32(str(doc).encode()) % 7 == 2


def training():
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) != 2


# ---------------------------------------------------------------------------------------------- 11


class BruteKatz:
    """The same model from dictionaries, by the definition."""

    def __init__(self, texts, order):
        self.order = order
        self.c = [collections.Counter() for _ in range(order + 1)]
        for w in texts:
            s = ["<s>", *w, "</s>"]
            for n in range(1, order + 1):
                for i in range(max(1, n - 1), len(s)):
                    self.c[n][tuple(s[i - n + 1 : i + 1])] += 1
        self.after = collections.defaultdict(collections.Counter)
        for n in range(1, order + 1):
            for g, c in self.c[n].items():
                self.after[g[:-1]][g[-1]] = c
        self.d = [None] + [self.discounts(collections.Counter(self.c[n].values())) for n in range(1, order + 1)]

    @staticmethod
    def discounts(nr):
        r = [k for k in nr if k <= 64]
        slope = -2.0
        if len(r) > 1:
            x, y = [math.log(k) for k in r], [math.log(nr[k]) for k in r]
            mx, my = sum(x) / len(x), sum(y) / len(y)
            slope = sum((a - mx) * (b - my) for a, b in zip(x, y)) / sum((a - mx) ** 2 for a in x)
        power = min(slope, -1.05) + 1

        def d(c):
            turing = (c + 1) * nr[c + 1] / (c * nr[c]) if c <= 5 else 0
            return turing if 0 < turing < 1 else (1 + 1 / c) ** power

        return d

    def p(self, w, context):
        """Of w after the last words of a context, recursively."""
        seen, n = self.after.get(context), len(context) + 1
        if seen is None:
            return self.p(w, context[1:]) if context else 1.0
        total = sum(seen.values())
        mass = lambda v: self.d[n](seen[v]) * seen[v] / total
        if w in seen:
            return mass(w)
        rest = 1 - sum(map(mass, seen))
        if not context:
            return rest
        return rest / (1 - sum(self.p(v, context[1:]) for v in seen)) * self.p(w, context[1:])

    def score(self, words):
        s = ["<s>", *words, "</s>"]
        return sum(math.log10(self.p(s[i], tuple(s[max(0, i - self.order + 1) : i]))) for i in range(1, len(s)))


def lowered(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


@pytest.mark.parametrize(("order", "block"), ((1, 1 << 20), (2, 1 << 20), (2, 70), (3, 90)))
def test_katz_against_brute_force(docs, rows, order, block):
    scores, _ = katz.train_and_score(docs, training(), order=order, block_tokens=block)
    got = sorted(scores.collect(), key=lambda r: (str(r.doc_id), r.score))
    model = BruteKatz([lowered(t) for d, t, _ in rows if not held(d)], order)
    n, v = sum(model.c[1].values()), len(model.c[1])
    want = []
    for d, t, _ in rows:
        w = [*lowered(t), "</s>"]
        c = [model.c[1].get((x,), 0) for x in w]
        want.append((d, held(d), len(w), sum(x > 0 for x in c), n, sum(math.log10((x + 1) / (n + v + 1)) for x in c), model.score(lowered(t))))
    want.sort(key=lambda r: (str(r[0]), r[-1]))
    assert [tuple(r)[:5] for r in got] == [r[:5] for r in want]
    assert [x for r in got for x in tuple(r)[5:]] == pytest.approx([x for r in want for x in r[5:]], rel=1e-9)


def test_every_context_adds_up_to_one(rows):
    for order in (1, 2, 3):
        model = BruteKatz([lowered(t) for d, t, _ in rows if not held(d)], order)
        words = [g[0] for g in model.c[1]] + ["<unknown>"]
        for context in list(model.after)[:40]:
            assert sum(model.p(w, context) for w in words) == pytest.approx(1, abs=1e-12)


def test_weights_of_the_operator_add_up_too(spark, docs, rows):
    """The weights that the operator stores, with its own discounts, leave each context's rest."""
    _, weights = katz.train_and_score(docs, training(), order=2)
    model = BruteKatz([lowered(t) for d, t, _ in rows if not held(d)], 2)
    got = sorted(r.alpha for r in weights.collect())
    alpha = lambda ctx: (1 - sum(model.p(w, ctx) for w in model.after[ctx])) / (1 - sum(model.p(w, ctx[1:]) for w in model.after[ctx]) if ctx else 1)
    assert got == pytest.approx(sorted(alpha(c) for c in model.after), rel=1e-9)


def test_katz_without_texts_or_training(spark, docs):
    assert katz.score(docs.filter("false"), training()).count() == 0
    got = katz.score(docs, F.lit(False)).collect()
    assert all(r.held_out and r.n_known == r.train_tokens == 0 and r.score == r.base_score == 0 for r in got)


# ---------------------------------------------------------------------------------------------- 12


def brute_phrases(rows, least, best):
    count, n = collections.defaultdict(collections.Counter), collections.Counter()
    for _, t, lang in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for m in range(1, 6):
                for i in range(len(w) - m + 1):
                    count[lang or "und"][tuple(w[i : i + m])] += 1
    out = []
    for lang, f in count.items():
        found = []
        common = {p: a for p, a in f.items() if a >= least}
        for p, a in common.items():
            if len(p) < 2:
                continue
            cuts = [(math.floor(Fraction(1000 * a * n[lang], f[p[:k]] * f[p[k:]])), k) for k in range(1, len(p))]
            inside = any(len(q) > len(p) and 100 * b >= 100 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in common.items())
            if not inside:
                score, k = min(cuts)
                found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, k + 1, x[2].decode(), -x[1], x[3], x[4], n[lang], -x[0]) for k, x in enumerate(sorted(found)[:best])]
    return sorted(out)


@pytest.mark.parametrize(("least", "best", "block"), ((3, 10_000, 1 << 20), (2, 25, 40), (5, 7, 300)))
def test_collocations_against_brute_force(docs, rows, least, best, block):
    got = sorted(map(tuple, phrase_mining.collocations(docs, least=least, best=best, block_tokens=block).collect()))
    want = brute_phrases(rows, least, best)
    assert got == want and {len(r[2].split()) for r in want} == {2, 3, 4, 5}
    assert phrase_mining.collocations(docs.filter("false"), least=least).count() == 0


def test_scores_beyond_64_bits(spark):
    """Parts of a score exceed 64 bits: counts are multiplied before the division."""
    wide = [F.lit(x).cast("decimal(38,0)") for x in (10**13, 10**14, 10**12, 10**12)]
    row = spark.range(1).select(*(c.alias(n) for c, n in zip(wide, "anlr"))).select(F.expr("(cast(1000 as decimal(38,0)) * a * n) div (l * r)").alias("s")).collect()[0]
    assert row.s == 1000 * 10**27 // 10**24


def test_quicksort_counts_equal_parts():
    rng = np.random.default_rng(2)
    words = rng.integers(1, 4, (500, 5)).astype(np.uint64)
    for row, end in zip(words, rng.integers(1, 6, 500)):
        row[end:] = 0
    weight = rng.integers(1, 4, 500)
    want = collections.Counter()
    for row, n in zip(words.tolist(), weight.tolist()):
        for m in range(3, 6):
            if row[m - 1]:
                want[tuple(row[:m])] += n
    got = {tuple(p.tolist()): n for p, n in phrase_mining.quicksort(words, weight, 6, 3)}
    assert got == {p: n for p, n in want.items() if n >= 6}


def test_arrays_come_back_from_their_packs():
    for a in (np.zeros(0, np.uint64), np.arange(9, dtype=np.uint64) << np.uint64(50), np.array([-1, 5, 1 << 40]), np.arange(5, dtype=np.uint32)):
        assert gram_counts.unpack(gram_counts.pack(a), a.dtype.type).tolist() == a.tolist()


# ---------------------------------------------------------------------------------------------- 13


def brute_trie(rows):
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [r[2:] for r in sorted(t, key=lambda r: r[:3])] for c, t in own.items()}
    made = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        made[c] = tuple(own.get(c - int(math.fmod(c, 100)), [])[:h] + own[c][h:])
    members = collections.defaultdict(list)
    for c, t in made.items():
        for d in range(len(t) + 1):
            members[t[:d]].append(c)
    children = collections.defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[q] for q in children[p]) or 1
        saved[p] = sum(saved[q] for q in children[p]) + (len(members[p]) - 1) * (len(p[-1][1]) if p else 0)
    ends = lambda p: hashlib.sha256(",".join(map(str, sorted(c for c in members[p] if made[c] == p))).encode()).hexdigest()
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves[p], saved[p], ends(p)) for p, m in members.items())


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("seed", (1, 2, 3))
def test_prefix_trie_against_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(700), 220) + [0, 300, -100, -17, 900, 901]:
        if c in {r[0] for r in rows}:
            continue
        n = rng.choice((1, 2, 3, 5, 8, 9, 16, 17, 40))
        same = rng.random() < 0.6
        rows += [(c, t, "user" if t % 2 == 0 else "bot", f"{'é𝄞'[: t % 3]}{t if same else rng.randrange(3)}") for t in range(n)]
    rows += [(800, None, "user", "first"), (800, 0, None, None), (800, 0, "b", ""), (800, 0, "a", "x"), (None, 1, "user", "lost"), (905, 1, "user", "only"), (905, 1, "user", "only"), (906, 1, "user", "only")]
    rows += [(990, 3, "user", "again")] * 30
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ("h", "pos", "t1", "part", "n", "row", "depth", "block", "chars", "by", "at")}).repartition(3)
    assert sorted(map(tuple, prefix_trie.prefix_trie(df).collect()), key=lambda r: r[:2]) == brute_trie(rows)


def test_prefix_trie_of_one_very_long_conversation_and_many_copies(spark):
    """Long conversations cross column blocks and ranges; very many members end at one node."""
    long = [(c, t, "user", str(t % 7)) for c in (7, 8) for t in range(3000 + c)]
    copies = [(1000 + c, 0, "user", "hello") for c in range(500) if c % 100]
    df = spark.createDataFrame(long + copies, SCHEMA).repartition(6)
    got = sorted(map(tuple, prefix_trie.prefix_trie(df).collect()), key=lambda r: r[:2])
    want = brute_trie(long + copies)
    assert got == want and max(r[1] for r in want) > 3000
    assert prefix_trie.prefix_trie(df.filter("false")).count() == 0


def test_digests_in_pieces(monkeypatch):
    """Runs that lie within a range, begin or end at its border, or are too long to wait for."""
    monkeypatch.setattr(prefix_trie, "PIECE", 4)
    rng = random.Random(4)
    rows = sorted({(rng.randrange(8), rng.randrange(2), rng.randrange(10**6)) for _ in range(150)} | {(9, 0, i) for i in range(40)})
    want = collections.defaultdict(list)
    for c, d, m in rows:
        want[c, d].append(m)
    for parts in ([rows], [rows[:60], rows[60:61], [], rows[61:100], rows[100:]]):
        out = []
        for part in parts:
            cut = [part[i : i + 7] for i in range(0, len(part), 7)]
            batches = (pa.RecordBatch.from_arrays([pa.array([r[k] for r in x], pa.int64()) for k in range(3)], ["conv_id", "depth", "member"]) for x in cut)
            out += [r for b in prefix_trie._hash_runs(batches) for r in b.to_pylist()]
        pieces = sorted((r for r in out if r["piece"] is not None), key=lambda r: (r["conv_id"], r["depth"], r["first"]))
        out = [r for r in out if r["sha256"]]
        if pieces:
            names = list(pieces[0])
            batch = pa.RecordBatch.from_arrays([pa.array([r[n] for r in pieces], t) for n, t in zip(names, (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary()))], names)
            out += [r for b in prefix_trie._hash_pieces(iter([batch])) for r in b.to_pylist()]
        assert sorted((r["conv_id"], r["depth"], r["sha256"]) for r in out) == sorted((*k, hashlib.sha256(",".join(map(str, m)).encode()).hexdigest()) for k, m in want.items())
