"""Language-model scores by context-tree weighting over bytes, learned from a whole corpus.

A text is coded as its words (ASCII letters in lower case) with one space between and an end mark
behind the last. Each byte is eight binary decisions; a decision has a node for every context of
zero to ``ORDER`` bytes before it. A node's Krichevsky-Trofimov estimate comes from the counts of
its zeros and ones in all training texts; bottom up, a node's weighted probability is the mean of
its estimate and the product of those of its children, one byte deeper. The probability of a
decision mixes the estimates of its path, each node's share being how much better its own
estimate told the training texts than its children did. The logarithms add up to a text's score,
and divided by its bytes to a code length.

*Flow.* Texts are cut into pieces of about ``PIECE`` bytes (whole texts; a longer one is its own
piece). A piece sends each distinct run of ``ORDER + 1`` bytes, and the hash of each distinct
word, once, with its count in the piece's training texts, to the shard of its three latest
context bytes (of its hash). Shards add up counts, ``FAN`` pieces at a time in as many rounds as it
takes, work out the tree from depth ``ORDER`` up to three, and answer the pieces in blocks of
``FAN``; a piece then scores its texts with the answers. So what is gathered grows with the
corpus, and no task holds more than ``FAN`` pieces' part of a shard, or a piece. Shards grow in number
with the texts; the runs behind one context of three bytes stay together. Only the nodes of depth zero to
two meet in the driver and are sent to all tasks: at most 65,793 contexts with 255 nodes each,
however large the corpus.

Defined results: a null text is an empty one, which is the end mark alone; a null id belongs to no
fold when ``learn`` is null for it, and is scored; equal texts have equal scores, and repeated rows count
as often as they occur; without training texts every binary decision has probability one half; an
empty table has no rows; other columns are not looked at. Words are known by 64-bit hashes.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard as zstd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesloom.llm.common import ship, store, unpack
from salesloom.llm.textscan import WORD_BYTES, byte_values, mix, pieces, run_hashes, text_bytes

ORDER = 5  # at most 6: a run is a 64-bit number
TOP = 3  # contexts of fewer bytes are known to every task
PIECE, STRETCH = 8 << 20, 1 << 20
FAN = 64
LEAST_SHARDS = 64
SPACE, END = 0x20, 0x0A
GRAM, WORD, TEXT = 0, 1, 2

_CODE = np.arange(256, dtype=np.uint8)
_CODE[0x41:0x5B] += 0x20
_CODE[~WORD_BYTES["space"]] = SPACE


# ---- Coded texts, their runs and words -------------------------------------------------


def coded(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The coded bytes of texts, each closed by the end mark, and their offsets."""
    if column.null_count:
        column = column.fill_null("")
    data, offsets = text_bytes(pc.binary_join_element_wise(column, "", "\n"))
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    word = WORD_BYTES["space"][data]
    keep = word.copy()
    keep[1:] |= word[:-1]  # and the byte behind each word
    size = np.add.reduceat(keep, offsets[:-1], dtype=np.int64)
    keep[offsets[1:][size == 0] - 1] = True
    out = _CODE[data[keep]]
    ends = np.cumsum(np.maximum(size, 1))
    out[ends - 1] = END
    return out, np.concatenate([[0], ends])


def runs(out: np.ndarray, offsets: np.ndarray, low: int, high: int) -> np.ndarray:
    """For each byte from ``low`` to ``high`` its context, the latest byte first, then the byte itself, as one number."""
    key = out[low:high].astype(np.int64)
    starts = offsets[:-1]
    for j in range(1, ORDER + 1):
        before = np.full(high - low, END, np.int64)
        first = max(low, j)
        before[first - low :] = out[first - j : high - j]
        for t in range(j - 1):  # what lies before a text is its end marks
            at = starts + t
            before[at[(at >= low) & (at < high)] - low] = END
        key |= before << (8 * (ORDER + 1 - j))
    return key


def words(out: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text of each word."""
    ends = np.flatnonzero((out == SPACE) | (out == END))
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    real = ends > starts
    starts, ends = starts[real], ends[real]
    hashes = run_hashes(out, starts, ends, table=byte_values(1, False)).view(np.int64)
    return hashes, np.searchsorted(offsets, starts, "right") - 1


def stretches(out: np.ndarray):
    return ((a, min(len(out), a + STRETCH)) for a in range(0, len(out), STRETCH))


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Ascending distinct keys and the sums of their counts."""
    keys, counts = np.concatenate([np.empty(0, np.int64), *keys]), np.concatenate([np.empty(0, np.int64), *counts])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(keys) else counts


def counted(keys: np.ndarray, learn: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Distinct keys with their counts where ``learn``, and those elsewhere with none."""
    known = pc.value_counts(pa.array(keys[learn]))
    other = pc.unique(pa.array(keys[~learn])).to_numpy()
    return [known.field(0).to_numpy(), other], [known.field(1).to_numpy(), np.zeros(len(other), np.int64)]


def shard_of(kind: int, keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each key; runs alike in their ``TOP`` latest context bytes share one."""
    base = keys >> (8 * (ORDER + 1 - TOP)) if kind == GRAM else keys
    return (mix(base.view(np.uint64)) % np.uint64(shards)).astype(np.int32)


# ---- Packed arrays ---------------------------------------------------------------------


def pack(values: np.ndarray) -> bytes:
    """An array of 8-byte values, byte by byte of their order, compressed."""
    return zstd.ZstdCompressor(level=1).compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8).T).tobytes())


def opened(blob: bytes, kind: type = np.int64) -> np.ndarray:
    raw = np.frombuffer(zstd.ZstdDecompressor().decompress(blob), np.uint8)
    return np.ascontiguousarray(raw.reshape(8, -1).T).reshape(-1).view(kind)


def pack_sorted(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=np.int64(0)))


def opened_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(opened(blob))


# ---- The tree --------------------------------------------------------------------------

_SMALL = 64
_LOG_GAMMA = {  # at k + 1/2 and at k + 1, for small k
    0.5: np.array([math.lgamma(k + 0.5) for k in range(_SMALL)]),
    1.0: np.array([math.lgamma(k + 1.0) for k in range(_SMALL)]),
}


def _log_gamma(count: np.ndarray, shift: float) -> np.ndarray:
    x = np.maximum(count, _SMALL) + shift
    large = (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3)
    return np.where(count < _SMALL, _LOG_GAMMA[shift][np.minimum(count, _SMALL - 1)], large)


def kt_log(total: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """The logarithm of the Krichevsky-Trofimov probability of a sequence with so many ones."""
    return _log_gamma(ones, 0.5) + _log_gamma(total - ones, 0.5) - _log_gamma(total, 1.0) - 2 * math.lgamma(0.5)


def weighted(own: np.ndarray, below: np.ndarray) -> np.ndarray:
    """The logarithm of the mean of a node's own probability and the product of its children's."""
    return np.logaddexp(own, below) - math.log(2)


def share(own: np.ndarray, below: np.ndarray) -> np.ndarray:
    """How much of a decision a node's own estimate has, against its children's."""
    return 1 / (1 + np.exp(np.clip(below - own, -700, 700)))


class Decision:
    """One of a byte's eight decisions after contexts of one length: the nodes of ascending ``ids`` (context and byte)."""

    def __init__(self, i: int, ids: np.ndarray, counts: np.ndarray):
        prefix = ids >> (8 - i)
        new = np.concatenate([[True], prefix[1:] != prefix[:-1]]) if len(ids) else np.empty(0, bool)
        self.node, self.first = np.cumsum(new) - 1, np.flatnonzero(new)
        self.bit = (ids >> (7 - i)) & 1
        self.total = np.add.reduceat(counts, self.first) if len(ids) else counts
        self.ones = np.add.reduceat(counts * self.bit, self.first) if len(ids) else counts
        self.own = kt_log(self.total, self.ones)
        self.below = None

    def take(self, deeper: Decision, parent: np.ndarray) -> None:
        """The products of the children, the nodes of the contexts one byte longer."""
        self.below = np.bincount(self.node[parent[deeper.first]], weights=deeper.weighted(), minlength=len(self.first))

    def weighted(self) -> np.ndarray:
        return self.own if self.below is None else weighted(self.own, self.below)

    def estimate(self) -> np.ndarray:
        """The estimate of each id's own bit."""
        total, ones = self.total[self.node], self.ones[self.node]
        return (np.where(self.bit == 1, ones, total - ones) + 0.5) / (total + 1.0)


class ShardTree:
    """Depths ``ORDER`` to ``TOP`` over one shard's runs, a decision at a time."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.keys = keys
        self.levels, self.parent = {ORDER: (keys, counts)}, {}
        for d in range(ORDER - 1, TOP - 1, -1):
            deeper, n = self.levels[d + 1]
            ids, self.parent[d] = np.unique((deeper >> 16 << 8) | (deeper & 255), return_inverse=True)
            self.levels[d] = (ids, np.bincount(self.parent[d], weights=n, minlength=len(ids)).astype(np.int64))

    def decision(self, i: int) -> dict[int, Decision]:
        found = {}
        for d in range(ORDER, TOP - 1, -1):
            found[d] = Decision(i, *self.levels[d])
            if d < ORDER:
                found[d].take(found[d + 1], self.parent[d])
        return found

    def top(self) -> tuple[np.ndarray, ...]:
        """Per node of depth ``TOP - 1`` its name (context, then 1 and the bits so far) and the sums over its children here."""
        parts = []
        for i in range(8):
            last = self.decision(i)[TOP]
            ids = self.levels[TOP][0][last.first]
            names, at = np.unique((ids >> 16 << 8) | (1 << i) | ((ids & 255) >> (8 - i)), return_inverse=True)
            sums = [np.bincount(at, weights=x, minlength=len(names)) for x in (last.weighted(), last.total, last.ones)]
            parts.append((names, sums[0], sums[1].astype(np.int64), sums[2].astype(np.int64)))
        return tuple(np.concatenate(x) for x in zip(*parts))

    def log10(self, top: Top) -> np.ndarray:
        """The logarithm of the probability of each run's last byte after its context."""
        result = np.zeros(len(self.keys))
        for i in range(8):
            path, up = self.decision(i), np.arange(len(self.keys))
            p = path[ORDER].estimate()
            for d in range(ORDER - 1, TOP - 1, -1):
                own, up = path[d], self.parent[d][up]
                p = _mixed(share(own.own, own.below)[own.node][up], own.estimate()[up], p)
            bit = (self.keys >> (7 - i)) & 1
            for d in range(TOP - 1, -1, -1):
                context = self.keys >> (8 * (ORDER + 1 - d))
                weight, one = top.at(d, (context << 8) | (1 << i) | ((self.keys & 255) >> (8 - i)))
                p = _mixed(weight, np.where(bit == 1, one, 1 - one), p)
            result += np.log10(p)
        return result


def _mixed(weight: np.ndarray, own: np.ndarray, deeper: np.ndarray) -> np.ndarray:
    return weight * own + (1 - weight) * deeper


class Top:
    """The nodes of contexts shorter than ``TOP`` bytes: their names, their shares and their estimates of a one."""

    def __init__(self, names: np.ndarray, below: np.ndarray, total: np.ndarray, ones: np.ndarray):
        self.depths = {}
        for d in range(TOP - 1, -1, -1):
            own = kt_log(total, ones)
            self.depths[d] = (names, share(own, below), (ones + 0.5) / (total + 1.0))
            above, at = np.unique((names >> 16 << 8) | (names & 255), return_inverse=True)
            below = np.bincount(at, weights=weighted(own, below), minlength=len(above))
            total, ones = (np.bincount(at, weights=x, minlength=len(above)).astype(np.int64) for x in (total, ones))
            names = above

    def at(self, depth: int, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        known, weight, one = self.depths[depth]
        at = np.searchsorted(known, names)
        return weight[at], one[at]


# ---- Jobs ------------------------------------------------------------------------------

PIECES = "piece long, kind int, shard int, keys binary, counts binary, ids array<long>, held array<boolean>"


def _cut(docs: DataFrame, learn: Column, held: Column, shards: int) -> DataFrame:
    """The pieces: a row of coded texts each, and a row per kind and shard of what they ask for."""
    schema = pa.schema([("piece", pa.int64()), ("kind", pa.int32()), ("shard", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()), ("ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_()))])

    def rows(piece: int, batch: pa.RecordBatch):
        out, offsets = coded(batch.column(3))
        learned = batch.column(1).to_numpy(zero_copy_only=False)
        parts, numbers = [], []
        for a, b in stretches(out):
            which = np.repeat(learned, np.diff(np.clip(offsets, a, b)))
            for known, into in zip(counted(runs(out, offsets, a, b), which), (parts, numbers)):
                into += known
        yield from sent(piece, GRAM, *_summed(parts, numbers))
        hashes, text = words(out, offsets)
        found, numbers = counted(hashes, learned[text])
        yield from sent(piece, WORD, *_summed(found, numbers))
        blob = zstd.ZstdCompressor(level=3).compress(out.tobytes())
        yield {"piece": piece, "kind": TEXT, "shard": -1, "keys": blob, "counts": pack(offsets), "ids": batch.column(0).to_pylist(), "held": batch.column(2).to_pylist()}

    def sent(piece: int, kind: int, keys: np.ndarray, counts: np.ndarray):
        for shard, at in by_shard(kind, keys, shards):
            yield {"piece": piece, "kind": kind, "shard": shard, "keys": pack_sorted(keys[at]), "counts": pack(counts[at]), "ids": None, "held": None}

    def scan(batches):
        piece = TaskContext.get().partitionId() << 32
        for batch in batches:
            _, offsets = text_bytes(batch.column(3))
            for a, b in pieces(offsets, PIECE):
                yield from pa.Table.from_pylist(list(rows(piece, batch.slice(a, b - a))), schema).to_batches()
                piece += 1

    columns = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(learn, F.lit(False)).alias("learn"), F.coalesce(held, F.lit(False)).alias("held"), "text")
    return store(columns.mapInArrow(scan, PIECES), "ctw-pieces")


def by_shard(kind: int, keys: np.ndarray, shards: int):
    """Each shard that some keys fall into, and which keys, in order."""
    shard = shard_of(kind, keys, shards)
    order = np.argsort(shard, kind="stable")
    edges = np.flatnonzero(np.diff(shard[order], prepend=-1)) if len(order) else []
    for a, b in zip(edges, [*edges[1:], len(order)]):
        yield int(shard[order[a]]), order[a:b]


def _added_up(asked: DataFrame, n_pieces: int) -> DataFrame:
    """The sums of the counts per kind and shard: one row each."""

    def add(group: pa.Table) -> pa.Table:
        keys, counts = _summed([opened_sorted(k) for k in group["keys"].to_pylist()], [opened(c) for c in group["counts"].to_pylist()])
        first = {c: group[c][0].as_py() for c in ("kind", "shard", "part")}
        known = counts[counts > 0]
        return pa.Table.from_pylist(
            [first | {"keys": pack_sorted(keys), "counts": pack(counts), "n": int(known.sum()), "distinct": len(known)}],
            pa.schema([("kind", pa.int32()), ("shard", pa.int32()), ("part", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary()), ("n", pa.int64()), ("distinct", pa.int64())]),
        )

    parts = math.ceil(n_pieces / FAN)
    sums = asked.select("kind", "shard", F.pmod(F.xxhash64("piece"), F.lit(max(1, parts))).alias("part"), "keys", "counts")
    while True:
        schema = "kind int, shard int, part long, keys binary, counts binary, n long, distinct long"
        sums = store(sums.groupBy("kind", "shard", "part").applyInArrow(add, schema), "ctw-sums")
        if parts <= 1:
            return sums
        parts = math.ceil(parts / FAN)
        sums = sums.select("kind", "shard", F.pmod(F.col("part"), F.lit(parts)).alias("part"), "keys", "counts")


def _top(sums: DataFrame) -> Top:
    """The short contexts, from all shards."""

    def scan(batches):
        for batch in batches:
            for keys, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = ShardTree(opened_sorted(keys), opened(counts)).top()
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["name", "below", "total", "ones"])

    parts = sums.where(F.col("kind") == GRAM).select("keys", "counts").mapInArrow(scan, "name long, below double, total long, ones long")
    summed = parts.groupBy("name").agg(F.sum("below").alias("below"), F.sum("total").alias("total"), F.sum("ones").alias("ones"))
    nodes = summed.toArrow().sort_by("name")  # at most 65,536 contexts with 255 nodes each
    return Top(*(nodes[c].to_numpy() for c in ("name", "below", "total", "ones")))


def _answers(asked: DataFrame, sums: DataFrame, top: Top, n_pieces: int) -> DataFrame:
    """For each row that a piece sent, the values of its keys: logarithms of runs, counts of words."""
    sent = ship(asked.sparkSession, top)

    def values(batches):
        short = unpack(sent)
        for batch in batches:
            out = []
            for kind, keys, counts in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3))):
                found, n = opened_sorted(keys), opened(counts)
                out.append(pack(ShardTree(found, n).log10(short) if kind == GRAM else n.astype(np.float64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(out, pa.binary())], ["kind", "shard", "keys", "values"])

    def answer(group: pa.Table, model: pa.Table) -> pa.Table:
        out = []
        if model.num_rows:
            known, value = opened_sorted(model["keys"][0].as_py()), opened(model["values"][0].as_py(), np.float64)
            out = [pack(value[np.searchsorted(known, opened_sorted(k))]) for k in group["keys"].to_pylist()]
        return pa.table({"piece": group["piece"], "kind": group["kind"], "shard": group["shard"], "values": pa.array(out, pa.binary())})

    parts = max(1, math.ceil(n_pieces / FAN))
    model = sums.select("kind", "shard", "keys", "counts").mapInArrow(values, "kind int, shard int, keys binary, values binary")
    model = model.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    asked = asked.select("piece", "kind", "shard", "keys", F.pmod(F.xxhash64("piece"), F.lit(parts)).alias("part"))
    by = ["kind", "shard", "part"]
    return asked.groupBy(*by).cogroup(model.groupBy(*by)).applyInArrow(answer, "piece long, kind int, shard int, values binary")


def lm_scores(docs: DataFrame, learn: Column, held: Column) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte.

    Learns from the rows where ``learn`` (on the columns of the documents) holds; ``held`` is shown as held_out.
    """
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b"), F.count_if(F.coalesce(learn, F.lit(False))).alias("n")).first()
    shards = max(LEAST_SHARDS, math.ceil((size.b / PIECE) ** 0.6))  # distinct runs grow more slowly than texts
    cut = _cut(docs, learn, held, shards)
    asked, texts = cut.where(F.col("kind") != TEXT), cut.where(F.col("kind") == TEXT)
    n_pieces = texts.count()
    sums = _added_up(asked, n_pieces)
    known = sums.where(F.col("kind") == WORD).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("distinct"), F.lit(0)).alias("v")).first()
    total, distinct = known.n + size.n, known.v + (size.n > 0)  # each learned text has one end
    answers = _answers(asked, sums, _top(sums), n_pieces)
    unseen, end = total + 0.1 * (distinct + 1), size.n

    def score(text: pa.Table, found: pa.Table) -> pa.Table:
        return pa.concat_tables([_scored(text.slice(i, 1), found) for i in range(text.num_rows)] or [SCORED.empty_table()])

    def _scored(text: pa.Table, found: pa.Table) -> pa.Table:
        out = np.frombuffer(zstd.ZstdDecompressor().decompress(text["keys"][0].as_py()), np.uint8)
        offsets = opened(text["counts"][0].as_py())
        n = len(offsets) - 1
        blobs = {(k, s): v for k, s, v in zip(found["kind"].to_pylist(), found["shard"].to_pylist(), found["values"].to_pylist())}

        def lookup(kind: int, keys: np.ndarray) -> np.ndarray:
            value = np.empty(len(keys))
            for shard, at in by_shard(kind, keys, shards):
                value[at] = opened(blobs[kind, shard], np.float64)
            return value

        codes = [pa.array(runs(out, offsets, a, b)).dictionary_encode() for a, b in stretches(out)]
        keys = np.unique(np.concatenate([c.dictionary.to_numpy() for c in codes]))
        value, total_score = lookup(GRAM, keys), np.zeros(n)
        for (a, b), code in zip(stretches(out), codes):
            each = value[np.searchsorted(keys, code.dictionary.to_numpy())][code.indices.to_numpy()]
            low, high = np.searchsorted(offsets, a, "right") - 1, np.searchsorted(offsets, b)
            total_score[low:high] += np.add.reduceat(each, np.maximum(offsets[low:high], a) - a)

        hashes, of = words(out, offsets)
        code = pa.array(hashes).dictionary_encode()
        keys = np.unique(code.dictionary.to_numpy())
        count = lookup(WORD, keys)[np.searchsorted(keys, code.dictionary.to_numpy())][code.indices.to_numpy()]
        base = np.bincount(of, weights=np.log10((count + 0.1) / unseen), minlength=n) + math.log10((end + 0.1) / unseen)
        tokens = np.bincount(of, minlength=n) + 1
        known = np.bincount(of, weights=count > 0, minlength=n).astype(np.int64) + (end > 0)
        n_bytes = np.diff(offsets)
        columns = [
            text["ids"][0].values, text["held"][0].values, pa.array(tokens), pa.array(known), pa.array(np.full(n, total)),
            pa.array(base), pa.array(total_score), pa.array(n_bytes), pa.array(-total_score / n_bytes / math.log10(2)),
        ]
        return pa.Table.from_arrays(columns, schema=SCORED)

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long, bits_per_byte double"
    SCORED = pa.schema(
        [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64())]
        + [("base_score", pa.float64()), ("score", pa.float64()), ("n_bytes", pa.int64()), ("bits_per_byte", pa.float64())]
    )
    return texts.groupBy("piece").cogroup(answers.groupBy("piece")).applyInArrow(score, schema)
