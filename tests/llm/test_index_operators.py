"""The manifest, the language model and the ranked search against brute force, and their defined edge results."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from salesloom.llm import ctw, maxsketch, merkle
from salesloom.llm.queries import QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _at long, node string, piece string, kind string, n string, terms string"


def make(spark, rows):
    """Documents with extra columns whose names clash with those used inside."""
    return spark.createDataFrame([(i, t, lang, src, None if t is None else len(t), 1, "x", "p", "k", "n", "t") for i, t, lang, src in rows], DOCS)


def corpus(n=60):
    rng = np.random.default_rng(5)
    vocabulary = [f"wört{i}" if i % 5 == 0 else f"Word{i}" for i in range(150)]
    rows = [(i, " ".join(rng.choice(vocabulary, rng.integers(1, 60))), ["en", "de", "fr"][i % 3], f"s{i % 4}") for i in range(n)]
    rows += [(n, None, None, None), (n + 1, "", "en", "s"), (n + 2, " \n\t ", "en", "s"), (n + 3, "!!! ...", "es", "s"), (None, "no id here", "en", "s"), (None, "no id here", None, "s")]
    rows += [rows[0], rows[7], (3, "another text with the id of the third", "en", "s2")]
    rows.append((n + 9, "\n".join(rng.choice(vocabulary, 20_000)), "en", "long"))
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return make(spark, corpus()).cache()


@pytest.fixture(scope="module")
def no_docs(spark):
    return make(spark, [])


def key(row):
    return tuple((x is None, str(x)) for x in row)


# ---- Merkle manifest -------------------------------------------------------------------


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    return sha("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (doc_id, source, lang, n_chars, text)))


def tree(nodes):
    """The levels from the leaves to the root."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([sha("".join(last[i : i + 2])) for i in range(0, len(last), 2)])
    return levels


def siblings(levels, at):
    found = []
    for level in levels[:-1]:
        run = level[at // 2 * 2 : at // 2 * 2 + 2]
        found.append((at % 2, run[1 - at % 2] if len(run) == 2 else None))
        at //= 2
    return found


def folded(node, path):
    for side, other in path:
        node = sha(node if other is None else node + other if side == 0 else other + node)
    return node


def brute_manifest(rows):
    by_lang = defaultdict(list)
    for i, text, lang, source in rows:
        n_chars = None if text is None else len(text)
        by_lang[lang].append((i is not None, i or 0, leaf(i, source, lang, n_chars, text), i, leaf(i, source, lang, None if n_chars is None else n_chars + 1, text)))
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        by_lang[lang].sort(key=lambda r: r[:3])
        trees[lang] = tree([r[2] for r in by_lang[lang]])
    top = tree([trees[lang][-1][0] for lang in langs])
    out = []
    for q, lang in enumerate(langs):
        for p, (_, _, own, i, other) in enumerate(by_lang[lang]):
            path = siblings(trees[lang], p) + siblings(top, q)
            given = other if i is not None and zlib.crc32(str(i).encode()) % 7 == 0 else own
            back = folded(given, path)
            root = top[-1][0]
            out.append((i, own, trees[lang][-1][0], root, sha("".join(s for _, s in path if s)), back, back == root))
    return out


def manifest_rows(df):
    rows = merkle.merkle_proofs(df, merkle.seventh(F.col("doc_id")))
    return rows.select("doc_id", "leaf", "subroot", "root", F.sha2("proof", 256), "folded_root", "verified").collect()


@pytest.mark.parametrize("levels", [1, 2, 3, 8])
def test_manifest_at_every_block_size(docs, monkeypatch, levels):
    monkeypatch.setattr(merkle, "LEVELS", levels)
    monkeypatch.setattr(merkle, "BLOCK", 1 << levels)
    assert sorted((tuple(r) for r in manifest_rows(docs)), key=key) == sorted(brute_manifest(corpus()), key=key)


def test_manifest_at_odd_sizes_and_many_langs(spark, monkeypatch):
    monkeypatch.setattr(merkle, "LEVELS", 2)
    monkeypatch.setattr(merkle, "BLOCK", 4)
    rows = [(100 * n + i, f"t{i}", f"l{n}é", "s") for n in (1, 2, 3, 4, 5, 7, 8, 9, 16, 17, 33) for i in range(n)]
    assert sorted((tuple(r) for r in manifest_rows(make(spark, rows))), key=key) == sorted(brute_manifest(rows), key=key)


def test_tampering_shows_unless_there_is_nothing_to_change(docs):
    rows = {r.doc_id: r.verified for r in merkle.merkle_proofs(docs, F.lit(True)).where("doc_id IS NOT NULL").collect()}
    assert rows.pop(60) is True  # n_chars is null there
    assert not any(rows.values())


def test_manifest_lists_each_lang(docs, no_docs):
    rows = merkle.manifest(docs).collect()
    assert {r.lang: r.leaves for r in rows} == Counter(lang for _, _, lang, _ in corpus())
    assert len({r.root for r in rows}) == 1
    assert merkle.manifest(no_docs).count() == 0


# ---- Language model --------------------------------------------------------------------


def coded(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in " ".join(words)).encode() + b"\n"


def kt(counts):
    zeros, ones = counts
    return math.lgamma(zeros + 0.5) + math.lgamma(ones + 0.5) - math.lgamma(zeros + ones + 1) - 2 * math.lgamma(0.5)


class SlowTree:
    """Context-tree weighting by the definition, a dictionary per depth."""

    def __init__(self, order):
        self.order, self.counts, self.children = order, defaultdict(lambda: [0, 0]), defaultdict(set)

    def path(self, context, byte):
        for i in range(8):
            prefix, bit = (1 << i) | (byte >> (8 - i)), (byte >> (7 - i)) & 1
            yield [(context[len(context) - d :] if d else b"", prefix) for d in range(self.order + 1)], bit

    def learn(self, text):
        text = b"\n" * self.order + text
        for at in range(self.order, len(text)):
            for nodes, bit in self.path(text[at - self.order : at], text[at]):
                for d, node in enumerate(nodes):
                    self.counts[node][bit] += 1
                    if d:
                        self.children[nodes[d - 1]].add(node)

    def finish(self):
        self.own = {node: kt(c) for node, c in self.counts.items()}
        self.below, self.whole = {}, {}
        for node in sorted(self.counts, key=lambda n: -len(n[0])):
            if len(node[0]) == self.order:
                self.whole[node] = self.own[node]
            else:
                self.below[node] = sum(self.whole[c] for c in self.children[node])
                self.whole[node] = float(np.logaddexp(self.own[node], self.below[node])) - math.log(2)

    def log10(self, text):
        text, total = b"\n" * self.order + text, 0.0
        for at in range(self.order, len(text)):
            for nodes, bit in self.path(text[at - self.order : at], text[at]):
                p = None
                for node in reversed(nodes):
                    c = self.counts.get(node, [0, 0])
                    own = (c[bit] + 0.5) / (sum(c) + 1)
                    if p is None or node not in self.counts:
                        p = own
                    else:
                        w = 1 / (1 + math.exp(min(700, self.below[node] - self.own[node])))
                        p = w * own + (1 - w) * p
                total += math.log10(p)
        return total


def brute_scores(rows, learned):
    """doc_id, n_tokens, n_known, train_tokens, base_score, score."""
    model, counts = SlowTree(ctw.ORDER), Counter()

    def tokens(text):
        return [*coded(text)[:-1].decode().split(" "), None] if len(coded(text)) > 1 else [None]

    for i, text, *_ in rows:
        if learned(i):
            model.learn(coded(text))
            counts.update(tokens(text))
    model.finish()
    n, v = sum(counts.values()), len(counts)
    out = []
    for i, text, *_ in rows:
        own = tokens(text)
        base = sum(math.log10((counts[t] + 0.1) / (n + 0.1 * (v + 1))) for t in own)
        out.append((i, len(own), sum(counts[t] > 0 for t in own), n, base, model.log10(coded(text))))
    return out


def held_out(i):
    return i is not None and zlib.crc32(str(i).encode()) % 10 == 0


def check_scores(got, want):
    got, want = sorted(got, key=lambda r: key((r.doc_id, r.n_tokens, round(r.score, 4)))), sorted(want, key=lambda r: key((r[0], r[1], round(r[5], 4))))
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert (g.doc_id, g.n_tokens, g.n_known, g.train_tokens) == w[:4]
        assert g.base_score == pytest.approx(w[4], rel=1e-9)
        assert g.score == pytest.approx(w[5], rel=1e-7)
        assert g.held_out == held_out(g.doc_id)
        assert g.bits_per_byte * g.n_bytes == pytest.approx(-g.score / math.log10(2))


def scores(df):
    fold = F.crc32(F.col("doc_id").cast("string")) % 10
    return ctw.lm_scores(df, fold != 0, fold == 0)


@pytest.fixture
def small_pieces(monkeypatch):
    """Many pieces, stretches inside a text, rounds of sums and blocks of answers."""
    monkeypatch.setattr(ctw, "PIECE", 400)
    monkeypatch.setattr(ctw, "STRETCH", 37)
    monkeypatch.setattr(ctw, "FAN", 3)
    monkeypatch.setattr(ctw, "LEAST_SHARDS", 5)


def short_corpus():
    return [(i, t[:250] if t else t, lang, src) for i, t, lang, src in corpus(25)]


def test_scores_by_the_definition(spark, small_pieces):
    rows = short_corpus()
    check_scores(scores(make(spark, rows)).collect(), brute_scores(rows, lambda i: i is not None and not held_out(i)))


@pytest.mark.parametrize("order", [3, 4, 6])
def test_scores_at_other_orders(spark, monkeypatch, order):
    monkeypatch.setattr(ctw, "ORDER", order)
    rows = short_corpus()[:30]
    check_scores(scores(make(spark, rows)).collect(), brute_scores(rows, lambda i: i is not None and not held_out(i)))


def test_decisions_after_a_context_sum_to_one():
    text = np.frombuffer(b"abracadabra and abracadabra again\n", np.uint8)
    keys = ctw.runs(text, np.array([0, len(text)]), 0, len(text))
    every = np.unique(np.concatenate([(keys[:5, None] >> 8 << 8 | np.arange(256)).reshape(-1), keys]))
    counts = np.bincount(np.searchsorted(every, keys), minlength=len(every))
    tree = ctw.ShardTree(every, counts)
    names = tree.top()
    order = np.argsort(names[0])
    p = 10 ** tree.log10(ctw.Top(*(x[order] for x in names)))
    for context in np.unique(keys[:5] >> 8):
        assert p[every >> 8 == context].sum() == pytest.approx(1)


def test_nothing_to_learn_from(spark, no_docs):
    rows = [(0, "abc d", "en", "s"), (1, None, "en", "s")]
    got = {r.doc_id: r for r in ctw.lm_scores(make(spark, rows), F.lit(False), F.lit(True)).collect()}
    assert got[0].score == pytest.approx(6 * 8 * math.log10(0.5)) and got[1].n_bytes == 1
    assert got[0].n_known == got[0].train_tokens == 0 and got[0].base_score == pytest.approx(0)
    assert ctw.lm_scores(no_docs, F.lit(True), F.lit(False)).count() == 0


def test_held_out_texts_cost_less_than_by_word_counts(spark):
    rows = QUERIES["op12_lm_score"](spark, "/root/testdata/sf0.01").where("held_out").agg(F.sum("score").alias("s"), F.sum("n_bytes").alias("b")).first()
    assert -rows.s / math.log10(2) / rows.b < 2.6  # bits a byte; eight without a model


def test_packed_arrays_come_back():
    rng = np.random.default_rng(1)
    for values in (np.empty(0, np.int64), rng.integers(-(2**63), 2**63 - 1, 1000)):
        assert (ctw.opened(ctw.pack(values)) == values).all()
        assert (ctw.opened_sorted(ctw.pack_sorted(np.sort(values))) == np.sort(values)).all()


# ---- Ranked search ---------------------------------------------------------------------

ITEMS = [(0, "Word1 word2 wört5 word1"), (1, "word3"), (2, None), (3, "..."), (4, "nowhere else"), (5, "word1 no id here another text"), (0, "word9"), (None, "word3"), (1, "word3")]


def terms(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def brute_search(rows, items, k):
    held = [(i, Counter(terms(t))) for i, t, *_ in rows if terms(t)]
    n_docs, n_terms = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        hits = []
        for i, c in held:
            m = 100 - 75 + (75 * sum(c.values()) * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms(text) if c[t])
            if score > 0:
                hits.append((-score, i is None, i or 0, i))
        out += [(item, rank, i, -score) for rank, (score, _, _, i) in enumerate(sorted(hits)[:k], 1)]
    return out


@pytest.mark.parametrize("k, width, block, group", [(10, 1024, 4096, 4096), (3, 4, 7, 4096), (1, 1, 2, 2), (100, 16, 50, 3)])
def test_search_at_every_width(spark, docs, monkeypatch, k, width, block, group):
    for name, value in (("WIDTH", width), ("BLOCK", block), ("GROUP", group), ("RESCORED", 2)):
        monkeypatch.setattr(maxsketch, name, value)
    items = spark.createDataFrame([(*r, 0) for r in ITEMS], "item_id long, text string, _row int")
    got = [tuple(r) for r in maxsketch.ranked(docs, items, k).collect()]
    assert sorted(got, key=key) == sorted(brute_search(corpus(), ITEMS, k), key=key)


def test_bounds_hold_and_save_work():
    rng = np.random.default_rng(2)
    n, vocabulary = 2000, 300
    edges = np.arange(0, 20 * n + 1, 20)
    term = np.concatenate([np.sort(rng.choice(vocabulary, 20, replace=False)) for _ in range(n)])
    impact = rng.integers(1, 1000, len(term)) ** 2
    place = rng.integers(0, maxsketch.WIDTH, vocabulary)
    block = maxsketch.Block(np.arange(n), edges, term, impact, place)
    weight = np.zeros(vocabulary, np.int64)
    asked = rng.choice(vocabulary, 8, replace=False)
    weight[asked] = 1
    bounds, exact = block.bounds(place[asked], weight[asked]), block.scores(np.arange(n), weight)
    assert (bounds >= exact).all()
    best = maxsketch.Best(10)
    assert best.search(block, bounds, weight) < n / 4
    assert best.scores.tolist() == sorted(exact.tolist(), reverse=True)[:10]


def test_search_of_empty_tables(spark, docs, no_docs):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert maxsketch.ranked(no_docs, items).count() == 0
    assert maxsketch.ranked(docs, items.limit(0)).count() == 0
