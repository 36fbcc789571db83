"""N-gram Jaccard join: a size-aware heavy-light join of documents' shingle sets.

Documents with one set form a class; classes are joined. Small sets (at most ``boundary``
shingles) enumerate their subsets of the size that a partner must share: two small sets with a
common subset of that size are similar. Large sets are found by scanning inverted lists: every
set is listed under its prefix, the first shingles in an order from rare to frequent, and a pair
is looked at only where both positions leave room for the overlap that their sizes need.
The boundary is the size at which enumerating stops being the cheaper of the two, from the
counts of small sets. Frequency comes from a count table of fixed size over all shingles.

A list is not expanded into all pairs. Its members first meet the list's hub (the member with
the fewest rarer shingles); links found so far are closed into components; only then do members
outside a list's main component meet the members of other components. No link between two
components is lost, so the components are exact. Candidates are verified on whole sets.

Lists known to be short by their counter are cut down by a window over the shingle; the others
(a passage that a third of the documents hold) by aggregates and joins that Spark can split.

Defined results: null, empty and wordless texts have an empty set and link with nothing; fewer
words than ``k`` make one shingle; rows with equal sets link whatever their ids; a null id never
is the smallest unless all ids are null; rows alike give rows alike; an empty table an empty one.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salesloom.llm import sketch
from salesloom.llm.common import ROW, fresh, if_small, row_key, store
from salesloom.llm.components import components
from salesloom.llm.textscan import Words, distinct_per_text, grams, mix, pieces, run_hashes, signed, text_bytes

K, PERCENT = 5, 80
GROUP = "_llm_group"
#: No set above this size enumerates subsets, whatever the costs say.
LARGEST_SMALL = 16
#: Scanning one list entry costs about as much as writing so many subset rows.
SCAN_COST = 4.0
#: A list whose counter is at most this may be held by one task (24 bytes an entry).
LIGHT_LIST = 200_000


def needed(a, b, percent: int = PERCENT):
    """Shared shingles that two sets of these sizes need for the similarity, rounded up."""
    return -(-(percent * (a + b)) // (100 + percent))


def _needed(a: Column, b: Column, percent: int) -> Column:
    return F.ceil((a + b) * percent / F.lit(100.0 + percent) - F.lit(1e-9)).cast("int")


def _sets(words: Words, k: int):
    """Sorted distinct shingles of each text, the text of each, and the sizes."""
    values, text, _ = grams(words, k)
    short = np.flatnonzero((words.counts > 0) & (words.counts < k))
    if len(short):
        first = words.first[short]
        values = np.concatenate([values, run_hashes(words.hashes, first, first + words.counts[short], 1)])
        text = np.concatenate([text, short])
    return distinct_per_text(values, text, len(words.counts))


def _set_names(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set that does not depend on order; 0 for the empty set."""
    ends = np.cumsum(sizes)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(mix(values), out=total[1:])
    name = mix(total[ends] - total[ends - sizes] + sizes.astype(np.uint64))
    name[(name == 0) & (sizes > 0)] = 1
    name[sizes == 0] = 0
    return signed(name)


def _scan(docs: DataFrame, k: int) -> DataFrame:
    """Rows (doc_id, row, set, n) of documents, and (slice, blob) of the shingle counts of each task."""
    names = ["doc_id", ROW, "cls", "n", "slice", "blob"]

    def scan(batches):
        counts = np.zeros(1 << sketch.BITS, np.int64)
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for i, j in pieces(offsets):
                words = Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], "space", True)
                values, _, sizes = _sets(words, k)
                counts += np.bincount(sketch.counter_of(values), minlength=len(counts))
                nothing = [pa.nulls(j - i, pa.int32()), pa.nulls(j - i, pa.binary())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i), pa.array(_set_names(values, sizes)), pa.array(sizes), *nothing], names)
        number, blobs = sketch.slices(counts)
        nothing = [pa.nulls(len(number), pa.int64())] * 4
        yield pa.RecordBatch.from_arrays([*nothing, pa.array(number), pa.array(blobs, pa.binary())], names)

    schema = f"doc_id long, {ROW} long, cls long, n long, slice int, blob binary"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", row_key()).mapInArrow(scan, schema)


def choose_boundary(small_sizes: dict[int, int], percent: int = PERCENT, scan_cost: float = SCAN_COST) -> int:
    """The set size up to which enumerating subsets is cheaper than scanning lists."""
    best, boundary, enumerated = None, 0, 0.0
    for x in range(LARGEST_SMALL + 1):
        enumerated += small_sizes.get(x, 0) * sum(comb(x, c) for c in subset_sizes(x, percent)) if x else 0
        scanned = sum(n * (size - needed(size, -(-size * percent // 100), percent) + 1) * scan_cost for size, n in small_sizes.items() if size * 100 > x * percent)
        if best is None or enumerated + scanned < best:
            best, boundary = enumerated + scanned, x
    return boundary


def subset_sizes(n: int, percent: int = PERCENT) -> list[int]:
    """The overlaps that a set of ``n`` shingles needs with the partners it can have."""
    return sorted({needed(n, m, percent) for m in range(-(-n * percent // 100), n * 100 // percent + 1)} & set(range(1, n + 1)))


def _subsets(values: np.ndarray, percent: int) -> np.ndarray:
    """Hashes of all subsets of the needed sizes of one small set, tagged with their size."""
    from itertools import combinations

    out = []
    mixed = mix(values)
    for c in subset_sizes(len(values), percent):
        chosen = np.array(list(combinations(range(len(values)), c)))
        out.append(mix(mixed[chosen].sum(1, dtype=np.uint64) + mix(np.array([c], np.uint64))))
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def _entries(docs: DataFrame, counts, boundary: int, k: int, percent: int) -> DataFrame:
    """List entries (h, cls, n, pos, light): prefixes of large sets, subsets of small ones."""
    names = ["h", "cls", "n", "pos", "light"]

    def scan(batches):
        count = counts.value
        for batch in batches:
            data, offsets = text_bytes(batch.column(0))
            for i, j in pieces(offsets):
                words = Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], "space", True)
                values, text, sizes = _sets(words, k)
                name = _set_names(values, sizes)
                often = count[sketch.counter_of(values)]
                order = np.lexsort((values, often, text))
                values, often, text = values[order], often[order], text[order]
                first = np.cumsum(sizes) - sizes
                pos = np.arange(len(values)) - first[text]
                size = sizes[text]
                least = -(-size * percent // 100)  # the smallest partner; it leaves the longest prefix
                keep = (pos <= size - -(-(percent * (size + least)) // (100 + percent))) & (size * 100 > boundary * percent)
                columns = [values[keep], name[text[keep]], size[keep], pos[keep], often[keep] <= LIGHT_LIST]
                yield pa.RecordBatch.from_arrays([pa.array(signed(columns[0])), *map(pa.array, columns[1:])], names)
                small = np.flatnonzero((sizes > 0) & (sizes <= boundary))
                for part in np.array_split(small, max(1, len(small) // 256)):
                    made = [_subsets(values[first[t] : first[t] + sizes[t]], percent) for t in part]
                    if made:
                        each = np.array([len(x) for x in made])
                        columns = [signed(np.concatenate(made)), np.repeat(name[part], each), np.repeat(sizes[part], each), np.zeros(each.sum(), np.int64), np.zeros(each.sum(), bool)]
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names)

    found = docs.select("text").mapInArrow(scan, "h long, cls long, n long, pos long, light boolean")
    return found.select("h", "cls", F.col("n").cast("int").alias("n"), F.col("pos").cast("int").alias("pos"), "light")


def _lists(entries: DataFrame) -> DataFrame:
    """Entries of lists that hold more than one class, each class once."""
    light = entries.where("light").withColumn("m", F.count("*").over(Window.partitionBy("h"))).where("m > 1")
    once = light.drop("m").unionByName(entries.where("NOT light")).dropDuplicates(["h", "cls"]).drop("light")
    once = store(once, "list-entries")
    sizes = store(once.groupBy("h").agg(F.count("*").alias("m")).where("m > 1"), "list-sizes")
    return store(once.join(sizes, "h").drop("m"), "lists")


def _fits(a: str, b: str, percent: int) -> Column:
    """Both positions leave room for the overlap needed, and the sizes are close enough."""
    need = _needed(F.col(f"{a}.n"), F.col(f"{b}.n"), percent)
    rest = [F.col(f"{x}.pos") + need <= F.col(f"{x}.n") for x in (a, b)]
    return rest[0] & rest[1]


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar; ``sets`` holds (cls, n, members)."""
    left = sets.select(F.col("cls").alias("a"), F.col("members").alias("x"))
    right = sets.select(F.col("cls").alias("b"), F.col("members").alias("y"))

    def check(batches):
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for r, (x, y) in enumerate(zip(batch.column("x"), batch.column("y"))):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate([x, y])
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                keep[r] = 100 * shared >= percent * (len(both) - shared)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(check, "a long, b long")


def _members(docs: DataFrame, rows: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(cls, members) of the wanted classes, from one row of each (``rows``: row key, cls)."""
    one = store(rows.join(if_small(wanted), "cls", "left_semi").groupBy("cls").agg(F.min(ROW).alias(ROW)).select(ROW), "set-rows")

    def scan(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column(0))
            for i, j in pieces(offsets):
                words = Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], "space", True)
                values, _, sizes = _sets(words, k)
                ends = np.cumsum(sizes)
                blobs = [values[e - s : e].tobytes() for s, e in zip(sizes.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(_set_names(values, sizes)), pa.array(blobs, pa.binary())], ["cls", "members"])

    texts = docs.select("text", row_key()).join(if_small(one), ROW, "left_semi").select("text")
    return store(texts.mapInArrow(scan, "cls long, members binary").dropDuplicates(["cls"]), "sets")


def jaccard_components(docs: DataFrame, k: int = K, percent: int = PERCENT) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, and the keys of the row and of its group."""
    spark = docs.sparkSession
    scanned = store(_scan(docs, k), "shingle-sets")
    rows = scanned.where("slice IS NULL").select("doc_id", ROW, "cls", "n")
    counts = spark.sparkContext.broadcast(sketch.total(scanned, "slice", "blob").astype(np.int64))
    small = {r.n: r["count"] for r in rows.where(f"n BETWEEN 1 AND {LARGEST_SMALL * 2}").groupBy("n").count().collect()}
    lists = _lists(_entries(docs, counts, choose_boundary(small, percent), k, percent))

    # first every member against its list's hub
    hubs = store(lists.groupBy("h").agg(F.min(F.struct("pos", F.xxhash64("h", "cls").alias("r"), "cls", "n")).alias("hub")), "hubs")
    met = lists.alias("x").join(hubs.select("h", "hub.*").alias("y"), "h").where("x.cls <> y.cls").where(_fits("x", "y", percent))
    pair = [F.least("x.cls", "y.cls").alias("a"), F.greatest("x.cls", "y.cls").alias("b")]
    stars = store(met.select(*pair).distinct(), "star-pairs")
    wanted = store(stars.select(F.col("a").alias("cls")).union(stars.select("b")).distinct(), "star-classes")
    sets = _members(docs, rows, wanted, k)
    links = store(_linked(stars, sets, percent), "star-links")
    named = store(components(links, "a", "b"), "star-components")

    # then members outside a list's main component against the other components
    known = lists.join(if_small(named.withColumnRenamed("node", "cls")), "cls", "left").withColumn("c", F.coalesce("component", "cls")).drop("component")
    known = store(known, "list-components")
    share = known.groupBy("h", "c").agg(F.count("*").alias("m"))
    main = share.groupBy("h").agg(F.max(F.struct("m", "c")).alias("top"), F.count("*").alias("parts")).where("parts > 1").select("h", F.col("top.c").alias("top"))
    main = store(main, "main-components")
    mixed = store(known.join(main, "h"), "mixed-lists")
    odd = store(mixed.where("c <> top"), "odd-entries")
    met = odd.alias("x").join(mixed.alias("y"), "h").where("x.c <> y.c AND (y.c = y.top OR x.cls < y.cls)").where(_fits("x", "y", percent))
    rest = store(met.select(*pair).distinct().join(stars, ["a", "b"], "left_anti"), "rest-pairs")
    both = rest.select(F.col("a").alias("cls")).union(rest.select("b")).distinct()
    missing = store(both.join(sets, "cls", "left_anti"), "rest-classes")
    sets = sets.unionByName(_members(docs, rows, missing, k))
    links = links.unionByName(store(_linked(rest, sets, percent), "rest-links"))
    named = store(components(links, "a", "b"), "set-components")

    # the smallest document of a component: first of each class, then over the classes
    least = rows.where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("least"))
    least = least.join(if_small(named.withColumnRenamed("node", "cls")), "cls", "left")
    least = store(least.select("cls", F.coalesce("component", "cls").alias("c"), "least"), "class-least")
    ids = store(least.groupBy("c").agg(F.min("least").alias("component_id")), "component-ids")
    # only classes of several rows or links have another id than their own
    moved = store(least.join(ids, "c").select("cls", F.col("c").alias(GROUP), "component_id"), "class-components")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return rows.join(if_small(moved), "cls", "left").select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), ROW, GROUP)


def one_per_group(docs: DataFrame, k: int = K, percent: int = PERCENT) -> DataFrame:
    """The documents with one row of each group of similar ones, all columns kept.

    The row kept is the one with the group's smallest id (null last); of rows alike in id and
    text one stays when they have words. Rows with an empty set all stay.
    """
    found = store(jaccard_components(docs, k, percent), "groups")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", ROW))
    chosen = found.where("n_shingles > 0").groupBy(GROUP).agg(first[ROW].alias(ROW)).select(ROW)
    lost = store(found.where("n_shingles > 0").select(ROW).distinct().join(chosen, ROW, "left_anti"), "group-rest")
    key = fresh(docs, ROW)
    kept = docs.withColumn(key, row_key()).join(if_small(lost.withColumnRenamed(ROW, key)), key, "left_anti")
    return once_per_row(kept, found, key).drop(key)


def once_per_row(kept: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Of rows with one key (alike in id and text) that has words, keep a single one."""
    again = store(found.where("n_shingles > 0").groupBy(ROW).agg(F.count("*").alias("m")).where("m > 1").select(F.col(ROW).alias(key)), "repeated-rows")
    if again.isEmpty():
        return kept
    again = if_small(again)
    return kept.join(again, key, "left_anti").unionByName(kept.join(again, key, "left_semi").dropDuplicates([key]))
