"""The training-data operators against brute force on small cases, and their defined edge results."""

import hashlib
import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest

from salesloom.llm import lines as line_ops
from salesloom.llm.common import ROW

SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_words int, component_id string, cls string, _llm_lines string, _llm_row string"
LINE = "this very same licence line stands in many of the documents here"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def split(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def make(spark, rows):
    """Documents with extra columns whose names clash with those used inside."""
    return spark.createDataFrame([(i, t, lang, src, None if t is None else len(t), 1, "x", "y", "z", "r") for i, t, lang, src in rows], DOCS)


def corpus():
    rng = np.random.default_rng(3)
    vocabulary = [f"wört{i}" if i % 7 == 0 else f"Word{i}" for i in range(400)]
    rows = []
    for i in range(40):
        words = list(rng.choice(vocabulary, rng.integers(1, 120)))
        rows.append((i, " ".join(words), "en", f"s{i % 3}"))
    base = list(rng.choice(vocabulary, 100))
    for i in range(40, 52):  # near copies around the threshold
        words = list(base)
        for at in rng.choice(100, rng.integers(0, 5), replace=False):
            words[at] = "edit%d" % rng.integers(1000)
        rows.append((i, ("\n" if i % 2 else " ").join(words), "en", "hot"))
    for i in range(52, 60):  # passages shared by several documents
        rows.append((i, " ".join([*rng.choice(vocabulary, 20), *base[:50], *rng.choice(vocabulary, 3)]) + "\n" + LINE + " \r\n", "de", None))
    for i, n in enumerate((1, 2, 3, 4, 5, 6, 7, 8, 9, 9, 10, 11, 12, 12)):  # small sets, some alike
        rows.append((60 + i, " ".join(base[:n]), "fr", "small"))
    rows += [(80, None, None, None), (81, "", "en", "s0"), (82, " \n\t ", "en", "s0"), (83, "!!! 123 ...", "en", "s1"), (None, "no id here but some words", "en", "s1")]
    rows += [rows[0], rows[45], (3, "another text with the id of the third", "en", "s2")]
    rows.append((90, " ".join(rng.choice(vocabulary, 30_000)), "en", "long"))
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return make(spark, corpus()).cache()


@pytest.fixture(scope="module")
def no_docs(spark):
    return make(spark, [])


def key(row):
    return tuple((x is None, str(x)) for x in row)


def same(got, want):
    assert sorted((tuple(r) for r in got), key=key) == sorted(want, key=key)


def linked(n, links):
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    return [root(i) for i in range(n)]


def smallest(ids, roots):
    least = {}
    for i, r in zip(ids, roots):
        if i is not None:
            least[r] = min(least.get(r, i), i)
    return [least.get(r) for r in roots]


def test_decontamination_matches_brute_force(spark, docs, no_docs):
    from salesloom.llm.decontaminate import contamination, decontaminate

    rows = corpus()
    items = [(1, " ".join(split(rows[40][1])[20:45])), (2, "Word3 wört7"), (3, None), (4, "  ..."), (10, " ".join(split(rows[40][1])[20:45])), (None, rows[5][1]), (2, "Word3 wört7"), (7, "licence, LINE!")]
    table = spark.createDataFrame(items, "item_id long, text string")
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t or ""))
    windows = defaultdict(set)
    for item, text in items:
        words = cut(text)
        size = min(10, len(words))
        for a in range(len(words) - size + 1 if words else 0):
            windows[tuple(words[a : a + size])].add(item)
    sizes = {len(w) for w in windows}
    want = []
    for doc, text, *_ in rows:
        words, hit, found = cut(text), set(), set()
        for n in sizes:
            for a in range(len(words) - n + 1):
                if tuple(words[a : a + n]) in windows:
                    hit |= set(range(a, a + n))
                    found |= windows[tuple(words[a : a + n])]
        found = sorted(str(x) for x in found if x is not None)
        want.append((doc, len(words), len(hit), len(found), sha(",".join(found)), bool(hit)))
    assert sum(w[5] for w in want) > 5
    same(contamination(docs, table).drop(ROW).collect(), want)
    clean = decontaminate(docs, table)
    assert clean.columns == docs.columns and clean.count() == sum(not w[5] for w in want)
    assert contamination(no_docs, table).count() == 0
    assert not any(r.contaminated for r in contamination(docs, table.limit(0)).collect())


@pytest.mark.parametrize("limit", [12, 1024])
def test_near_vectors_match_brute_force(spark, limit):
    from salesloom.llm.forest import near_vectors

    rng = np.random.default_rng(5)
    centres = rng.standard_normal((12, 16))
    vectors = [(c + rng.normal(0, 0.05, 16)).tolist() for c in centres for _ in range(9)] + rng.standard_normal((60, 16)).tolist()
    vectors += [vectors[0]] * 6 + [[2 * x for x in vectors[0]], None, [], [0.0] * 16, [float("nan")] * 16, [None] + [1.0] * 15, [float("inf")] * 16, [1.0, 2.0], [2.0, 4.0]]
    ids = [*range(len(vectors) - 1), None]
    good = [v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v) for v in vectors]
    links = []
    for i, j in combinations(range(len(vectors)), 2):
        if good[i] and good[j] and len(vectors[i]) == len(vectors[j]):
            a, b = np.array(vectors[i], float), np.array(vectors[j], float)
            if a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.95:
                links.append((i, j))
    degree = Counter(x for pair in links for x in pair)
    component = smallest(ids, linked(len(ids), links))
    table = spark.createDataFrame([(i, v, 1) for i, v in zip(ids, vectors)], "vec_id long, embedding array<double>, size int")
    got = near_vectors(table, limit=limit, trees=8)
    want = [(i, degree[p], c, c == i) for p, (i, c) in enumerate(zip(ids, component))]
    if limit > 1000:
        same(got.collect(), want)
    else:  # a forest of tiny leaves may miss links, and must invent none
        found = {r.vec_id: r for r in got.collect()}
        assert all(found[w[0]].n_links <= w[1] for w in want)
        assert sum(r.n_links for r in found.values()) >= 0.9 * sum(w[1] for w in want)
    assert near_vectors(table.limit(0)).count() == 0


def test_jaccard_matches_brute_force(docs, no_docs):
    from salesloom.llm.jaccard import GROUP, jaccard_components, one_per_group

    rows, sets = corpus(), []
    for _, text, *_ in rows:
        words = split(lower(text or ""))
        sets.append({tuple(words[a : a + 5]) for a in range(max(1, len(words) - 4))} if words else set())
    links = [(i, j) for i, j in combinations(range(len(rows)), 2) if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    assert len(links) > 20
    roots = linked(len(rows), links)
    component = smallest([r[0] for r in rows], roots)
    same(jaccard_components(docs).drop(ROW, GROUP).collect(), [(r[0], len(s), c if s else r[0]) for r, s, c in zip(rows, sets, component)])
    kept = one_per_group(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len({r for r, s in zip(roots, sets) if s}) + sum(not s for s in sets)
    assert jaccard_components(no_docs).count() == 0 and one_per_group(no_docs).count() == 0


def test_small_sets_enumerate_what_partners_share():
    from salesloom.llm.jaccard import choose_boundary, needed, subset_sizes

    for n in range(1, 14):
        assert set(subset_sizes(n)) == {needed(n, m) for m in range(1, 40) if 100 * min(n, m) >= 80 * max(n, m)}
    assert choose_boundary({}) == 0 and choose_boundary({3: 100, 4: 100}) >= 4


def test_mix_targets_and_takes(spark, docs, no_docs):
    from salesloom.llm.mixing import mix_report, schedule, _plan

    got = mix_report(docs, block=8).collect()
    sizes = defaultdict(int)
    for _, text, _, source in corpus():
        sizes[source] += len(split(text))
    names = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, full, total = {}, set(), sum(sizes.values())
    while True:
        rest = total - sum(3 * sizes[s] for s in full)
        open_ = [s for s in names if s not in full]
        target = {s: 3.0 * sizes[s] if s in full else rest * weight[s] / sum(weight[x] for x in open_) for s in names}
        over = {s for s in open_ if target[s] > 3 * sizes[s]}
        if not over:
            break
        full |= over
    taken = defaultdict(int)
    for r in got:
        taken[r.source] += r.taken
        assert r.source_size == sizes[r.source] and r.taken <= 3 * r.size
        assert abs(r.target - target[r.source]) < 1e-6 * max(1, r.target)
    assert len(got) == len(corpus())
    assert all(abs(taken[s] - target[s]) <= 1 for s in names)
    again = mix_report(docs.repartition(7), block=8).collect()
    same([r[:5] for r in again], [tuple(r[:5]) for r in got])
    assert mix_report(no_docs).count() == 0
    # any stretch of the schedule holds the sources in their shares
    plan = _plan(spark.createDataFrame([("a", 6000), ("b", 3000), ("c", 1000)], "source string, source_size long"), 1)
    order = [r.source for r in schedule(plan, 1, 64).orderBy("slot").collect()]
    share = {r.source: r.slots / len(order) for r in plan.collect()}
    for a in range(0, 9000, 1000):
        part = Counter(order[a : a + 1000])
        assert all(abs(part[s] - 1000 * share[s]) < 25 for s in share)


def test_main_text_of_pages(spark):
    from salesloom.llm.html import main_text, page_blocks, repeated

    page = (
        '<html><head><title>t</title><style>p{}</style></head><body><nav><a>Home</a></nav><header>Site</header><div class="cookie-notice">c</div>'
        '<article><h1>A &amp; B</h1><p>one\n two<br>three <b>x</b>y<p>f&uuml;nf<div class="ad">buy</div><aside>s</aside><script>"</p>"</script>'
        '<ul><li>i<li>j</ul><form>f</form><section id="comments"><p>great!</p></section></article><footer>&copy;</footer>'
    )
    assert [t for t, _ in page_blocks(page)] == ["A & B", "one two three xy", "fünf", "i", "j"]
    tokens = np.array([1, 2, 3, 4, 9, 1, 2, 3, 5, 7, 7, 7, 7])
    assert repeated(tokens, np.array([0] * 5 + [1] * 4 + [2] * 4), 3).tolist() == [True] * 3 + [False] * 2 + [True] * 3 + [False] * 5
    menu = "<div><p>read all our other stories in the archive of this site today</p></div>"
    plain = [(i, f"http://h.example/{i}", f"{menu}<p>unique words of page number {i} and then {i * 7} more of them</p>") for i in range(6)]
    plain += [(9, None, None), (10, "::bad::", ""), (11, "http://other.example/", "<p>alone"), (11, "http://other.example/", "<p>alone"), (12, "http://h.example/m", plain[0][2])]
    got = {r.page_id: r for r in main_text(spark.createDataFrame([(*p, "x") for p in plain], "page_id long, url string, html string, host string")).collect()}
    assert got[3].text == "unique words of page number 3 and then 21 more of them" and got[3].n_chars == len(got[3].text)
    assert got[12].text == got[0].text != "" and got[9].text == got[10].text == "" and got[11].text == "alone"
    assert main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_substring_dedup_matches_brute_force(docs, no_docs):
    from salesloom.llm.rlz import substring_dedup

    for width, anchor in ((35, 12), (6, 3)):
        places, words = defaultdict(list), [split(t) for _, t, *_ in corpus()]
        for d, own in enumerate(words):
            for a in range(len(own) - width + 1):
                places[tuple(own[a : a + width])].append((d, a))
        gone = defaultdict(set)
        for found in places.values():
            if len(found) > 1:
                for d, a in found:
                    gone[d] |= set(range(a, a + width))
        want = [(r[0], len(own), len(gone[d]), " ".join(w for p, w in enumerate(own) if p not in gone[d])) for d, (r, own) in enumerate(zip(corpus(), words))]
        assert sum(w[2] for w in want) > 300
        same(substring_dedup(docs, width, anchor, keep_text=True).collect(), want)
    assert substring_dedup(no_docs).count() == 0


def test_language(spark, no_docs):
    from salesloom.llm.language import fit, identify, keep_known
    from pyspark.sql import functions as F

    rng = np.random.default_rng(1)
    tongue = {"en": "the of and that with from have this they would".split(), "de": "der die und nicht ein für über auch schön werden".split(), "fr": "le des est pour qui où très être même une".split()}
    rows = [(i, " ".join(rng.choice(tongue[x], 30)), x, "s") for i, x in enumerate(list(tongue) * 60)]
    rows += [(1000, None, "en", "s"), (1001, "", "de", "s"), (1002, "123 !!", "en", "s"), (1003, "der die und nicht " * 20_000, None, "s"), (None, "the of and that", None, None)]
    table = make(spark, rows)
    model = fit(table, F.lit(True))
    got = {r.doc_id: r for r in identify(table, model).collect()}
    assert sum(got[r[0]].lang_pred == r[2] for r in rows[:180]) == 180 and got[1003].lang_pred == "de" and got[None].lang_pred == "en"
    assert all(got[i].lang_pred == "und" and got[i].score == 0 and got[i].rejected for i in (1000, 1001, 1002))
    assert all(0 <= r.score <= 1 for r in got.values())
    kept = keep_known(table, model)
    assert kept.columns == table.columns and kept.count() == len(rows) - 3
    assert identify(no_docs, fit(no_docs, F.lit(True))).count() == 0
    assert {r.lang_pred for r in identify(table, fit(no_docs, F.lit(True))).collect()} == {"und"}


def lines_wanted(rows, min_chars=40, min_docs=5):
    norm = lambda line: lower(line.strip(SPACES))
    holders = defaultdict(set)
    for i, text, *_ in rows:
        for line in (text or "").split("\n"):
            if len(norm(line)) >= min_chars:
                holders[norm(line)].add(-(1 << 63) if i is None else i)
    drop = {k: max(v) for k, v in holders.items() if len(v) >= min_docs}
    want = []
    for i, text, *_ in rows:
        own = (text or "").split("\n")
        kept = [x for x in own if drop.get(norm(x), i) == i]
        want.append((i, len(own), len(own) - len(kept), "\n".join(kept)))
    return want


@pytest.mark.parametrize("shipped", [1000, 0])
def test_line_dedup_matches_brute_force(spark, docs, no_docs, shipped):
    want = lines_wanted(corpus())
    assert sum(w[2] for w in want) >= 7
    same(line_ops.line_report(docs, shipped_keys=shipped).collect(), [(*w[:3], sha(w[3])) for w in want])
    cleaned = line_ops.dedup_lines(docs, shipped_keys=shipped)
    assert cleaned.columns == docs.columns
    same([(r.doc_id, r.text or "", r.n_chars or 0) for r in cleaned.collect()], [(w[0], w[3], len(w[3])) for w in want])
    assert line_ops.line_report(no_docs, shipped_keys=shipped).count() == 0


def test_line_dedup_can_be_undone(spark, docs):
    late = make(spark, [(200 + i, f"new {i}\n{LINE.upper()}", "en", "s") for i in range(3)])
    refs = line_ops.insert_refs(None, docs)
    more = line_ops.insert_refs(refs, late)
    back = line_ops.delete_refs(more, late)
    same(back.collect(), [tuple(r) for r in refs.collect()])
    assert line_ops.dropped_keys(more).first().keeper == 202 and line_ops.dropped_keys(back).first().keeper == 59
    few = line_ops.delete_refs(refs, docs.where("doc_id >= 55"))
    assert line_ops.dropped_keys(refs).count() == 1 and line_ops.dropped_keys(few).count() == 0
    marks = line_ops.filters(line_ops.dropped_keys(refs))
    emptied = line_ops.change_filters(marks, line_ops.dropped_keys(few), line_ops.dropped_keys(refs))
    assert [(r.n_keys, any(r.cells)) for r in emptied.collect()] == [(0, False)]


def test_cuckoo_filter():
    keys = np.random.default_rng(2).integers(-(1 << 62), 1 << 62, 5000)
    made = line_ops._built(keys)
    assert made.has(keys).all()
    others = np.random.default_rng(3).integers(-(1 << 62), 1 << 62, 20_000)
    assert made.has(others).mean() < 0.01
    made.delete(keys[:2500])
    assert made.has(keys[2500:]).all() and made.has(keys[:2500]).mean() < 0.02
    assert line_ops.Cuckoo.load(made.dump()).has(keys[2500:]).all()


def test_classifiers(spark, no_docs):
    from pyspark.sql import functions as F

    from salesloom.llm.compression import fit, score

    rng = np.random.default_rng(4)
    vocabulary = ["".join(rng.choice(list("abcdefghijklmnopqrst"), rng.integers(2, 9))) for _ in range(900)]
    rows, labels = [], []
    for i in range(500):
        words = list(rng.choice(vocabulary, rng.integers(30, 120)))
        toxic, good = i % 4 == 0, i % 3 != 0
        if toxic:
            for w in ("scoundrel", "numbskull"):
                words[int(rng.integers(len(words)))] = w
        text = " ".join(words) if good else " ".join(w.upper() + "!!" for w in words)
        rows.append((i, text, None, None))
        labels.append((i, int(good), int(toxic)))
    rows += [(1000, None, None, None), (1001, "", None, None), (None, "plain words", None, None), (1002, " ".join(rng.choice(vocabulary, 20_000)), None, None)]
    table = make(spark, rows)
    marks = spark.createDataFrame([*labels, (1000, None, None), (2000, 1, 1)], "doc_id long, quality int, toxic int")
    for name, kind, place, least in (("toxic", "toxic", 2, 0.9), ("quality", "quality", 1, 0.95)):
        got = {r.doc_id: r for r in score(table, fit(table, marks, name, kind, F.lit(True)), 3, 1).collect()}
        right = np.mean([got[x[0]].predicted == x[place] for x in labels])
        assert right >= least, (name, right)
        assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
        assert got[1000].score == got[1001].score
        nothing = score(table, fit(table, marks.limit(0), name, kind, F.lit(True)), 3, 1).collect()
        assert {r.score for r in nothing} == {0.0}
        assert score(no_docs, fit(no_docs, marks, name, kind, F.lit(True)), 3, 1).count() == 0


def test_components_of_chains_and_stars(spark):
    from salesloom.llm.components import components

    chain = [(i, i + 1) for i in range(0, 200)]
    star = [(1000, 1001 + i) for i in range(100)] + [(1500, 1100), (1500, 1500)]
    got = {r.node: r.component for r in components(spark.createDataFrame(chain + star + star[:3] + [(None, 4)], "a long, b long"), "a", "b").collect()}
    assert {got[i] for i in range(201)} == {0} and {got[1000 + i] for i in range(101)} == {1000} and got[1500] == 1000
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_one_group_of_many_different_near_equal_vectors(spark):
    from salesloom.llm.forest import near_vectors

    rng = np.random.default_rng(8)
    n = 12_000
    x = np.vstack([np.eye(16)[0] * 9 + rng.standard_normal((n, 16)) * 0.1, rng.standard_normal((3_000, 16))])
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    got = {r.vec_id: r for r in near_vectors(table).collect()}
    for a in range(0, n, 1000):
        links = (unit[a : a + 1000] @ unit.T >= 0.95).sum(axis=1) - 1
        assert links.min() >= n - 1  # all of the group are linked
        assert [got[i].n_links for i in range(a, a + 1000)] == links.tolist()
        assert {got[i].component_id for i in range(a, a + 1000)} == {0}


def test_a_group_that_is_dense_only_in_parts_of_the_table(spark):
    from salesloom.llm.forest import near_vectors

    rng = np.random.default_rng(9)
    n = 1_500
    x = np.vstack([np.eye(16)[0] * 9 + rng.standard_normal((n, 16)) * 0.05, rng.standard_normal((12_000, 16))])
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = (unit @ unit.T >= 0.95).sum(axis=1) - 1
    got = {r.vec_id: r for r in near_vectors(table, limit=128).collect()}
    assert all(got[i].n_links <= want[i] for i in got)
    assert sum(got[i].n_links for i in range(n)) >= 0.9 * want[:n].sum()
    assert {got[i].component_id for i in range(n)} == {0}


def _pages(spark, pages):
    from salesloom.llm.html import main_text

    table = spark.createDataFrame([(i, f"http://h.example/{i}", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    return {r.page_id: r for r in main_text(table).collect()}


def _body(i, n=40):
    return " ".join(f"w{i}x{j}" for j in range(n))


def test_boilerplate_of_a_host_does_not_depend_on_its_shards(spark):
    notice = "please note that this text stands in the same words on some pages of this site"
    pages = [f"<p>{notice}</p><p>{_body(i)}</p>" if i < 40 else f"<p>{_body(i)}</p>" for i in range(60)]
    pages.append("<p>" + _body("long", 3_000_000 // 8) + "</p>")  # cuts the host into several shards
    few = _pages(spark, pages[:60])
    more = _pages(spark, pages)
    assert all(more[i].text == few[i].text == _body(i) for i in range(60))
    many = _pages(spark, [pages[i] if i < 40 else f"<p>{_body(i)}</p>" for i in range(8_000)])
    assert all(many[i].text == _body(i) for i in range(8_000))


def test_near_copied_pages_without_article_keep_their_paragraphs(spark):
    own = [f"<p>{_body(i)}</p>" for i in range(30)]
    shared = [f"<p>{_body('a')}</p><p>{_body('b')}</p><p>{_body('c')} {end}</p>" for end in ("once", "twice")]
    quote = f"<p>{_body('a')}</p><p>{_body('q')}</p>"
    got = _pages(spark, [*own, *shared, quote])
    assert got[30].text == f"{_body('a')}\n{_body('b')}\n{_body('c')} once" and got[31].text.endswith("twice") and got[30].n_repeated == 0
    assert got[32].text == f"{_body('a')}\n{_body('q')}"


def test_unique_blocks_beside_an_article_stay_and_repeated_ones_go(spark):
    notice = "please note that this text stands in the same words on all pages of this site"
    pages = [f"<div>{notice}</div><div>lead {_body(i)}</div><article><p>teaser {i}</p></article>" for i in range(20)]
    got = _pages(spark, pages)
    assert all(got[i].text == f"lead {_body(i)}\nteaser {i}" and got[i].n_repeated == 1 for i in range(20))


def test_chrome_goes_by_whole_names_and_by_what_it_holds():
    from salesloom.llm.html import page_blocks

    post = "<p>the body of a post</p>"
    for frame in (
        '<div class="page with-sidebar">{}</div>', '<div class="has-cookie-notice"><article>{}</article></div>', '<form id="aspnetForm"><input>{}</form>',
        "<nav><a>home</a></nav><form><article>{}</article></form>", '<article>{}</article><section id="comments"><article class="comment-body"><p>a comment longer than the post</article></section>',
        '<div class="widget">{}</div><footer>a footer that is much longer than the text of the post itself</footer>', '<div class="site-footer">f</div><div class="main-nav">n</div>{}',
        '<div class="sidebar"><article>teaser</article></div><main>{}</main>', '<article>{}<div class="ad-banner">an advert that is longer than the whole post</div></article>',
        "<p hidden>x</p>{}<div style='display: none'>y</div>", "<aside>x{}<!-- a > b",
    ):
        want = [] if frame.startswith("<aside>") else ["the body of a post"]
        assert [t for t, _ in page_blocks(frame.format(post))] == want, frame
    assert [t for t, _ in page_blocks(f'<article>{post}<p class="menu" title="hidden gem">soup</p></article>')] == ["the body of a post", "soup"]
    assert [t for t, _ in page_blocks("1 < 2 <b>and</b> 3 > 2 <a href='x")] == ["1 < 2 and 3 > 2 <a href='x"]


def test_pages_are_scanned_in_linear_time():
    import time

    from salesloom.llm.html import page_blocks

    begin = time.time()
    assert page_blocks("<a " * 3_300_000)[0][0].startswith("<a <a")  # 10 MB
    for page in ('<a "b ' * 200_000, '<a b="x ' * 200_000 + '>"', "<b>" * 100_000 + "</i>" * 100_000, "<b>" * 50_000 + "<p>x</p>" * 50_000, '<div class="menu">x' * 50_000):
        page_blocks(page)
    assert time.time() - begin < 40


def test_boilerplate_goes_on_hosts_of_any_size(spark):
    from salesloom.llm.html import main_text

    menu = " ".join(f"m{j}" for j in range(400))
    rows, want, k = [], {}, 0
    for size, bearing in ((2, 2), (3, 3), (4, 4), (10, 10), (30, 30), (1500, 10)):
        for i in range(size):
            own = _body(f"{size}p{i}", 60)
            rows.append((k, f"http://h{size}.example/{i}", (f"<div>{menu}</div>" if i < bearing else "") + f"<p>{own}</p>"))
            want[k] = own
            k += 1
    got = main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == want


def test_repeats_of_a_host_match_brute_force(spark):
    from salesloom.llm.html import COVERED, FEW, OWN, OWN_SHARE, RUN

    rng = np.random.default_rng(11)
    stock = [[f"s{i}x{j}" for j in range(n)] for i, n in enumerate((5, 9, 14, 20, 40))]
    pages = []
    for i in range(60):
        blocks = []
        for b in range(4):
            own = [f"p{i}b{b}w{j}" for j in range(int(rng.integers(1, 30)))]
            blocks.append([*own, *stock[int(rng.integers(5))], *own[:3]] if rng.random() < 0.6 else own)
        pages.append(blocks)
    pages.append(pages[0])
    streams = [[t for b in blocks for t in ("", *b)] for blocks in pages]
    where = defaultdict(set)
    for s in streams:
        for a in range(len(s) - RUN + 1):
            where[tuple(s[a : a + RUN])].add(tuple(s))

    def cover(s, chosen):
        hit = [False] * len(s)
        for a in range(len(s) - RUN + 1):
            if tuple(s[a : a + RUN]) in chosen:
                hit[a : a + RUN] = [True] * RUN
        return hit

    several = {r for r, found in where.items() if len(found) > 1}
    name = {}
    for s in streams:
        rest = tuple(t for t, h in zip(s, cover(s, several)) if t and not h)
        name[tuple(s)] = rest if len(rest) >= max(OWN[0], min(OWN[1], OWN_SHARE * len(s))) else ()
    least = min(FEW, len(set(name.values())))
    repeats = {r for r in several if len({name[s] for s in where[r]}) >= max(2, least)}
    want = {}
    for i, (blocks, s) in enumerate(zip(pages, streams)):
        hit, at, kept = cover(s, repeats), 0, []
        for b in blocks:
            part, at = hit[at : at + len(b) + 1], at + len(b) + 1
            drop = [False] * len(part)
            for low in range(len(part)):
                high = low
                while high < len(part) and part[high]:
                    high += 1
                if (low == 0 or not part[low - 1]) and high - low >= 2 * RUN:
                    drop[low:high] = [True] * (high - low)
            if sum(part) < COVERED * len(part):
                kept.append(" ".join(w for w, d in zip(b, drop[1:]) if not d))
        want[i] = "\n".join(k for k in kept if k)
    got = _pages(spark, ["".join(f"<p>{' '.join(b)}</p>" for b in blocks) for blocks in pages])
    assert {i: r.text for i, r in got.items()} == want and len(repeats) > 30 and sum(r.n_repeated for r in got.values()) > 40
