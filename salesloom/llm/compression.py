"""Classifiers by compression distance: two zstandard dictionaries, and what each saves on a text.

*Quality*: one dictionary is trained on good text, one on bad. A whole text is compressed in
windows of ``QUALITY_WINDOW`` bytes with each; the difference of the compressed sizes over their
sum, for the text and for its extreme windows, goes through a logistic calibration.

*Toxicity*: both dictionaries begin with ordinary words; the toxic one also holds the words that
toxic text has far more often than ordinary text does. A text is compressed in windows of
``TOXIC_WINDOW`` words that overlap by half, so a single insult in a long text stands out: the windows that the toxic
dictionary makes shorter are compressed once more in halves, and the largest savings, their
numbers and the number of windows are calibrated. A word counts once for each pair of
neighbours, so copies of a text don't make its words look typical.

Both learn from a bounded sample: at most about ``SAMPLE`` documents of either label, chosen by
hash. Three quarters of them give the dictionaries, each by a stretch of at most ``STRETCH`` characters,
in the driver; those of quality by ``DICT_TEXTS`` documents of a label and ``DICT_WINDOWS`` windows of
each, spread evenly over its stretch (bounds chosen by the loss on the calibrating quarter). The other quarter calibrates, weighted back to the labels'
shares: its whole texts become features in the tasks, as in scoring, and only the features are collected.

Defined results: null and empty texts get the calibrated score of an empty text; a label that is
null, or of a document without text, teaches nothing; a document with several labels teaches each;
with one label only, every score is 0 or 1 after it, and without any 0; rows alike give rows alike.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesloom.llm.common import if_small, ship, store, unpack
from salesloom.llm.language import fold, sample_by

SAMPLE = {0: 4000, 1: 4000}
STRETCH = 20_000
QUALITY_WINDOW, QUALITY_DICT = 1024, 32_768
DICT_TEXTS, DICT_WINDOWS = 1500, 8
TOXIC_WINDOW, BASE_DICT, TOXIC_DICT = 10, 8_192, 8_192
#: How sure it must be that a word is typical of toxic text (a log-likelihood ratio).
TYPICAL = 15.0
_LETTERS = re.compile(rb"[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def _compressor(content: zstd.ZstdCompressionDict, **settings):
    bare = {"write_content_size": False, "write_checksum": False, "write_dict_id": False, "format": zstd.FORMAT_ZSTD1_MAGICLESS, "window_log": 17}
    return zstd.ZstdCompressor(dict_data=content, compression_params=zstd.ZstdCompressionParameters.from_level(3, **bare, **settings))


class Logistic:
    """A ridge logistic regression on standardised features."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray):
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-9
        z = self._wide(x)
        w = np.zeros(z.shape[1])
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            curve = (z * (weight * (p * (1 - p) + 1e-6))[:, None]).T @ z + np.eye(len(w)) * 1e-2
            w = w - np.linalg.solve(curve, z.T @ (weight * (p - y)) + 1e-2 * w)
        self.w = w

    def _wide(self, x):
        return np.c_[np.clip((x - self.mean) / self.scale, -20, 20), np.ones(len(x))]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._wide(x) @ self.w, -30, 30)))


class Model:
    """Dictionary contents, their use, and the calibration; ``constant`` where nothing could be learned."""

    def __init__(self, kind: str, content: tuple[bytes, bytes] | None = None, calibrate: Logistic | None = None, constant: float = 0.0):
        self.kind, self.content, self.calibrate, self.constant = kind, content, calibrate, constant

    def features(self):
        """A function from the bytes of a text to its features; compressors are made once."""
        if self.kind == "quality":
            one, two = (_compressor(zstd.ZstdCompressionDict(c)) for c in self.content)
            return lambda text: _quality_features(one.compress, two.compress, text)
        settings = {"chain_log": 16, "hash_log": 16, "search_log": 4, "min_match": 5, "target_length": 64, "strategy": zstd.STRATEGY_LAZY2}
        one, two = (_compressor(zstd.ZstdCompressionDict(c, dict_type=zstd.DICT_TYPE_RAWCONTENT), **settings) for c in self.content)
        return lambda text: _toxic_features(one.compress, two.compress, text)

    def scores(self, texts: list[bytes], features) -> np.ndarray:
        if self.calibrate is None:
            return np.full(len(texts), self.constant)
        return self.calibrate(np.array([features(t) for t in texts])) if texts else np.zeros(0)


def _quality_features(good, bad, text: bytes) -> list[float]:
    parts = [text[i : i + QUALITY_WINDOW] for i in range(0, max(1, len(text)), QUALITY_WINDOW)]
    g, b = (np.array([len(f(x)) for x in parts], float) for f in (good, bad))
    each = (g - b) / (g + b)
    return [(g.sum() - b.sum()) / (g.sum() + b.sum()), each.max(), each.min(), g.sum() / max(1, len(text)), np.log1p(len(text))]


def _toxic_features(ordinary, toxic, text: bytes) -> list[float]:
    words = text.lower().split()
    saved = []
    for i in range(0, max(1, len(words) - TOXIC_WINDOW // 2), TOXIC_WINDOW // 2):
        own = words[i : i + TOXIC_WINDOW]
        line = b" " + b" ".join(own) + b" "
        gain = len(ordinary(line)) - len(toxic(line))
        if gain >= 2:
            half, quarter = len(own) // 2, len(own) // 4
            lines = [b" " + b" ".join(x) + b" " for x in (own[:half], own[half:], own[quarter : quarter + half])]
            gain += max(len(ordinary(x)) - len(toxic(x)) for x in lines)
        saved.append(gain)
    d = np.array(saved)
    top = np.append(np.sort(d)[::-1][:3], [0, 0, 0])[:3]
    return [*top, *((d >= v).sum() for v in (5, 6, 7, 8, 9, 10, 12)), (d >= 6).mean(), np.log1p(len(d))]


def _spread(text: bytes) -> list[bytes]:
    parts = [text[i : i + QUALITY_WINDOW] for i in range(0, len(text), QUALITY_WINDOW)]
    return parts if len(parts) <= DICT_WINDOWS else [parts[i * len(parts) // DICT_WINDOWS] for i in range(DICT_WINDOWS)]


def _quality_dicts(good: list[bytes], bad: list[bytes]) -> tuple[bytes, bytes]:
    def trained(texts):
        samples = [part for t in texts[:DICT_TEXTS] for part in _spread(t)]
        try:
            return zstd.train_dictionary(QUALITY_DICT, samples).as_bytes()
        except zstd.ZstdError:  # too little text to train on: the text itself
            return b" ".join(texts)[-QUALITY_DICT:] or b" "

    return trained(good), trained(bad)


def _typical(toxic: list[bytes], ordinary: list[bytes]) -> list[bytes]:
    """Words far more frequent in toxic text, the surest first; each counted once per pair of neighbours."""

    def counted(texts):
        seen, words = set(), Counter()
        for text in texts:
            found = [b"", *_LETTERS.findall(text.lower()), b""]
            for around in zip(found, found[1:], found[2:]):
                key = hash(around)
                if key not in seen:
                    seen.add(key)
                    words[around[1]] += 1
        return words, max(1, len(seen))

    (mine, n), (other, m) = counted(toxic), counted(ordinary)
    word = list(mine)
    c, o = np.array([mine[w] for w in word], float), np.array([other.get(w, 0) for w in word], float)

    def fit(k, n, share):
        return k * np.log(np.maximum(share, 1e-12)) + (n - k) * np.log(np.maximum(1 - share, 1e-12))

    both = (c + o) / (n + m)
    sure = np.where(c / n > o / m, fit(c, n, c / n) + fit(o, m, o / m) - fit(c, n, both) - fit(o, m, both), 0)
    return [word[i] for i in sorted(range(len(word)), key=lambda i: (-sure[i], word[i])) if sure[i] >= TYPICAL]


def _toxic_dicts(toxic: list[bytes], ordinary: list[bytes]) -> tuple[bytes, bytes]:
    frequent = Counter()
    for text in ordinary:
        frequent.update(_LETTERS.findall(text.lower()))

    def packed(words, size):  # the first words last, where they are cheapest to point to
        out, length = [], 0
        for word in words:
            length += len(word) + 1
            if length > size:
                break
            out.append(word)
        return b" ".join(reversed(out)) + b" "

    base = packed((w for w, _ in sorted(frequent.items(), key=lambda x: (-x[1], x[0]))), BASE_DICT)
    return b" " + base, b" " + packed(_typical(toxic, ordinary), TOXIC_DICT) + base


def fit(docs: DataFrame, labels: DataFrame, label: str, kind: str, learn: Column, sample: dict[int, int] | None = None) -> Model:
    """Learn ``label`` (0 or 1) from the labelled rows where ``learn`` (on doc_id) holds."""
    named = labels.select("doc_id", F.col(label).cast("int").alias("label")).where(learn).where("label IN (0, 1)")
    limit = max((sample or SAMPLE).values())
    drawn = store(sample_by(named, "label", limit), "labelled")
    order = F.xxhash64("doc_id", F.lit("order"))
    rows = docs.where("text IS NOT NULL").join(if_small(drawn), "doc_id").select("label", "text", "doc_id", order.alias("o"))
    rows = store(rows.withColumn("held", F.pmod("o", F.lit(4)) == 3), "sampled")
    have = {(r.label, r.held): r["count"] for r in rows.groupBy("label", "held").count().collect()}
    known = {v for v, _ in have}
    if len(known) < 2:
        return Model(kind, constant=float(max(known, default=0)))
    dictionaries, held = rows.where("NOT held"), rows.where("held")
    if len(have) < 4:  # a handful of rows: all of them for both
        dictionaries = held = rows
    start = F.pmod(F.xxhash64("doc_id", F.lit("stretch")), F.greatest(F.char_length("text") - STRETCH, F.lit(0)).cast("long") + 1) + 1
    learnt = dictionaries.withColumn("text", F.substring("text", start.cast("int"), F.lit(STRETCH))).toArrow()
    learnt = learnt.sort_by([("o", "ascending"), ("doc_id", "ascending"), ("label", "ascending"), ("text", "ascending")])
    one, zero = ([t.encode() for t, y in zip(learnt.column("text").to_pylist(), learnt.column("label").to_pylist()) if y == v] for v in (1, 0))
    model = Model(kind, _quality_dicts(one, zero) if kind == "quality" else _toxic_dicts(one, zero))
    x, y = _whole_features(held, model)
    # the labels' shares among all labelled rows, which the sample evens out
    counts = {r.label: r["count"] for r in named.groupBy("label").count().collect()}
    weights = np.array([counts[v] / (y == v).sum() for v in y.tolist()])
    model.calibrate = Logistic(x, y.astype(float), weights / weights.mean())
    return model


def _whole_features(rows: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """The features of whole texts, computed in the tasks, and their labels, in an order that does not change."""
    sent = ship(rows.sparkSession, model)

    def scan(batches):
        features = unpack(sent).features()
        for batch in batches:
            texts = batch.column(1)
            x = pa.array([features(t.as_buffer().to_pybytes()) for t in texts], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), x], ["label", "x"])

    found = rows.select("label", "text").repartition("text").mapInArrow(scan, "label int, x array<double>").toArrow()
    pairs = sorted(zip(found.column("label").to_pylist(), found.column("x").to_pylist()))
    return np.array([x for _, x in pairs], float), np.array([y for y, _ in pairs])


def score(docs: DataFrame, model: Model, parts: int, held: int) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted."""
    sent = ship(docs.sparkSession, model)

    def scan(batches):
        own = unpack(sent)
        features = own.features() if own.calibrate is not None else None
        for batch in batches:
            column = batch.column(2)
            for i in range(0, batch.num_rows, 256):
                texts = [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in column.slice(i, 256)]
                value = np.clip(own.scores(texts, features), 0, 1)
                columns = [batch.column(0).slice(i, 256), batch.column(1).slice(i, 256), pa.array(value), pa.array((value >= 0.5).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "score", "predicted"])

    ids = F.col("doc_id").cast("long")
    return docs.select(ids.alias("doc_id"), F.coalesce(fold(ids, parts) == held, F.lit(False)).alias("held_out"), "text").mapInArrow(scan, "doc_id long, held_out boolean, score double, predicted int")
