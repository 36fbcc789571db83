"""Language identification: averaged hashed subword embeddings and a linear softmax.

A text's features are its runs of two to four bytes (ASCII letters in lower case, other ASCII
as a space), hashed into ``BUCKETS``. Each bucket has an embedding; their mean over the whole
text goes through a linear layer and a softmax. Both are learned by stochastic gradient
descent in numpy on a bounded sample: about ``SAMPLE`` labelled documents a language, chosen by
hash, a stretch of ``STRETCH`` characters of each. A temperature and the score below which a
document is rejected are set on a fifth of the sample that training doesn't see.

Embedding and layer multiplied out give one row of scores per bucket, so the tasks add up table
rows over whole texts, in pieces.

Defined results: null texts and texts without a letter are ``und`` with score 0 and rejected;
without any labelled document every text is; rows alike give rows alike; labels of null are not
learned; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesloom.llm.common import ship, unpack
from salesloom.llm.textscan import pieces, text_bytes

BUCKETS, DIMS, ORDERS = 1 << 14, 16, (2, 3, 4)
SAMPLE, STRETCH = 1500, 1000
EPOCHS, BATCH, RATE, SEED = 4, 32, 60.0, 7
#: At most this share of clean unseen stretches may fall below the rejection score, and it never exceeds MOST.
REJECTED, MOST = 0.0005, 0.4
UNKNOWN = "und"

_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
_FOLD[0x80:] = np.arange(0x80, 0x100)


def _buckets(data: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """The bucket of the run of ``n`` bytes that begins at each byte; BUCKETS where it would leave its text."""
    size = len(data) - n + 1
    code = np.full(max(size, 0), n, np.uint32)
    for k in range(n):
        code = code * np.uint32(257) + data[k : k + size]
    found = np.full(len(data), BUCKETS, np.int32)
    if size > 0:
        found[:size] = (code * np.uint32(2654435761)) >> np.uint32(32 - BUCKETS.bit_length() + 1)
    for k in range(1, n):  # the last places of each text
        at = ends - k
        found[at[at >= 0]] = BUCKETS
    return found


def _counts(texts: list[str]) -> np.ndarray:
    out = np.zeros((len(texts), BUCKETS), np.float32)
    for i, text in enumerate(texts):
        data = _FOLD[np.frombuffer(text.encode(), np.uint8)]
        for n in ORDERS:
            out[i] += np.bincount(_buckets(data, np.array([len(data)]), n), minlength=BUCKETS + 1)[:BUCKETS]
    return out / np.maximum(out.sum(1, keepdims=True), 1)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


class LanguageModel:
    """Languages, the table of bucket scores, and the calibrated temperature and rejection score."""

    def __init__(self, languages: list[str], scores: np.ndarray, bias: np.ndarray, temperature: float, reject_below: float):
        self.languages, self.scores, self.bias, self.temperature, self.reject_below = languages, scores, bias, temperature, reject_below

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        return _softmax((logits + self.bias) / self.temperature)

    def logits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Mean bucket scores of each text."""
        n, wide = len(offsets) - 1, np.zeros((len(offsets) - 1, len(self.languages)))
        used = np.zeros(n)
        for a in range(0, len(data), 1 << 19):  # a piece and the bytes a run may reach into
            b = min(len(data), a + (1 << 19))
            part = _FOLD[data[a : b + max(ORDERS) - 1]]
            first, last = np.searchsorted(offsets, a, "right") - 1, np.searchsorted(offsets, b, "left")
            starts = np.maximum(offsets[first:last], a) - a
            filled = np.append(starts[1:], b - a) > starts
            rows = np.arange(first, last)[filled]
            ends = offsets[first + 1 : last + 1] - a
            for order in ORDERS:
                bucket = _buckets(part, ends[ends <= len(part)], order)[: b - a]
                for lang in range(wide.shape[1]):
                    wide[rows, lang] += np.add.reduceat(self.scores[lang][bucket], starts[filled], dtype=np.float64)
                used[rows] += np.add.reduceat((bucket < BUCKETS).astype(np.int32), starts[filled])
        return wide / np.maximum(used, 1)[:, None]


def train(texts: list[str], labels: list[str]) -> LanguageModel:
    """Fit on stretches of text; every fifth calibrates."""
    languages = sorted(set(labels))
    wide = len(languages)
    if wide < 2:
        return LanguageModel(languages, np.zeros((wide, BUCKETS + 1), np.float32), np.zeros(wide), 1.0, 0.0)
    rng = np.random.default_rng(SEED)
    order = rng.permutation(len(texts))
    target = np.array([languages.index(x) for x in labels])
    held = order[: len(order) // 5] if len(order) >= 10 else order
    fit = order[len(order) // 5 :]
    embed = rng.uniform(-1 / DIMS, 1 / DIMS, (BUCKETS, DIMS)).astype(np.float32)
    layer, bias = rng.uniform(-0.5, 0.5, (DIMS, wide)).astype(np.float32), np.zeros(wide, np.float32)
    steps, step = EPOCHS * -(-len(fit) // BATCH), 0
    weight = 1.0 / np.maximum(np.bincount(target[fit], minlength=wide), 1)
    weight = (weight * len(fit) / wide).astype(np.float32)
    for _ in range(EPOCHS):
        for rows in np.array_split(rng.permutation(fit), -(-len(fit) // BATCH)):
            x = _counts([texts[r] for r in rows])
            hidden = x @ embed
            error = _softmax(hidden @ layer + bias)
            error[np.arange(len(rows)), target[rows]] -= 1
            error *= weight[target[rows], None] / len(rows)
            rate = np.float32(RATE * (1 - step / steps))
            back = error @ layer.T
            layer -= rate * np.float32(0.02) * (hidden.T @ error)
            bias -= rate * np.float32(0.002) * error.sum(0)
            embed -= rate * (x.T @ back)
            step += 1
    scores = np.zeros((wide, BUCKETS + 1), np.float32)
    scores[:, :BUCKETS] = (embed @ layer).T
    logits = np.concatenate([_counts([texts[r] for r in part]) @ (embed @ layer) for part in np.array_split(held, max(1, len(held) // 64))]) + bias
    losses = {t: -np.log(np.maximum(_softmax(logits / t)[np.arange(len(held)), target[held]], 1e-12)).mean() for t in np.geomspace(0.1, 10, 41)}
    temperature = float(min(losses, key=losses.get))
    top = _softmax(logits / temperature).max(1)
    return LanguageModel(languages, scores, bias.astype(np.float64), temperature, float(min(MOST, np.quantile(top, REJECTED))))


def fold(doc_id: Column, parts: int) -> Column:
    """The documents' fold: crc32 of the id as text."""
    return F.crc32(doc_id.cast("string").cast("binary")) % parts


def sample_by(docs: DataFrame, label: str, per_label: int) -> DataFrame:
    """About ``per_label`` rows of each label (null labels left out), chosen by a hash of the id."""
    counts = {r[label]: r["count"] for r in docs.where(F.col(label).isNotNull()).groupBy(label).count().collect()}
    if not counts:
        return docs.limit(0)
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, per_label / n))])
    draw = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return docs.where(F.col(label).isNotNull()).where(draw < share[F.col(label)])


def fit(docs: DataFrame, learn: Column, per_language: int = SAMPLE) -> LanguageModel:
    """Learn from the rows where ``learn`` holds, by a bounded sample."""
    text = F.col("text")
    start = F.pmod(F.xxhash64("doc_id", F.lit("stretch")), F.greatest(F.char_length(text) - STRETCH, F.lit(0)).cast("long") + 1) + 1
    drawn = sample_by(docs.where(learn).where(text.rlike(r"\p{L}")), "lang", per_language)
    found = drawn.select(F.substring(text, start.cast("int"), F.lit(STRETCH)).alias("text"), "lang", F.xxhash64("doc_id").alias("o")).toArrow().sort_by("o")
    return train(found.column("text").to_pylist(), found.column("lang").to_pylist())


def _has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    letter = _FOLD[data] != 0x20
    plain = letter & (data < 0x80)
    upto = np.concatenate([[0], np.cumsum(plain)])
    found = upto[offsets[1:]] > upto[offsets[:-1]]
    for t in np.flatnonzero(~found & (np.diff(offsets) > 0)):
        found[t] = any(c.isalpha() for c in data[offsets[t] : offsets[t + 1]].tobytes().decode())
    return found


def _judge(model: LanguageModel, column: pa.Array):
    """Language, score and rejection of each text of a batch."""
    data, offsets = text_bytes(column)
    names, score, rejected = np.full(len(column), UNKNOWN, object), np.zeros(len(column)), np.ones(len(column), bool)
    for i, j in pieces(offsets) if model.languages else ():
        part, own = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        p = model.probabilities(model.logits(part, own))
        known, best = _has_letter(part, own), p.argmax(1)
        names[i:j] = np.where(known, np.array(model.languages, object)[best], UNKNOWN)
        score[i:j] = np.where(known, np.clip(p[np.arange(j - i), best], 0, 1), 0)
        rejected[i:j] = ~known | (score[i:j] < model.reject_below)
    return names, score, rejected


def identify(docs: DataFrame, model: LanguageModel, parts: int = 3, held: int = 1) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score, rejected."""
    sent = ship(docs.sparkSession, model)
    schema = "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean"

    def scan(batches):
        own = unpack(sent)
        for batch in batches:
            names, score, rejected = _judge(own, batch.column(2))
            columns = [batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(score), pa.array(rejected)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "lang_pred", "score", "rejected"])

    ids = F.col("doc_id").cast("long")
    return docs.select(ids.alias("doc_id"), F.coalesce(fold(ids, parts) == held, F.lit(False)).alias("held_out"), "text").mapInArrow(scan, schema)


def keep_known(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """The documents that are not rejected, all columns kept."""
    sent = ship(docs.sparkSession, model)

    def scan(batches):
        own = unpack(sent)
        for batch in batches:
            yield batch.filter(pa.array(~_judge(own, batch.column("text"))[2]))

    return docs.mapInArrow(scan, docs.schema)
