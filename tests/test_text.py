import html
import random
import re
import time

from pyspark.sql import functions as F

from salesloom.functions import text as t
from salesloom.functions import values as v
from salesloom.functions.chunks import chunk_document, sliding_windows


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_slugs(spark):
    for name, slug in {"": "unknown", "  ": "unknown", "A / B--C ": "a-b-c", "製造業 (JP)": "製造業-jp", "ก_1": "ก_1", "!!!": "unknown"}.items():
        assert one(spark, t.slugify(F.lit(name))) == slug
    assert one(spark, t.slugify(F.lit(None).cast("string"))) == "unknown"


def test_strip_html_equals_the_rule(spark):
    samples = ["<p>a&amp;lt;b</p>", "x &nbsp; y\n\tz", "no tags", "&eacute;&#233;&#xe9;", "<a\nhref='x'>link</a>&copy;", "1 < 2 & 3 > 2", ""]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(samples)], "i int, s string")
    got = [r[1] for r in df.select("i", t.strip_html(F.col("s"))).orderBy("i").collect()]
    assert got == [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]+>", " ", s))).strip() for s in samples]


def test_references_equal_the_standard_library(spark):
    rng = random.Random(5)
    names = [f"&{n}" for n in html.entities.html5] + ["&amp", "&notit;", "&ampx", "&", "&&&amp", "&amp;lt;", "&bogus;", "&AMP;amp;", "&é;", "&xlt;"]
    numbers = [0, 1, 9, 11, 13, 31, 65, 127, 128, 150, 159, 160, 0x20AC, 0xD800, 0xDFFF, 0xFDD0, 0xFEFF, 0xFFFE, 0x1F600, 0x10FFFF, 0x110000, 99999999999]
    numbers = [f"&#{n}{end}" for n in numbers for end in (";", "", "z")] + [f"&#x{n:x};" for n in numbers] + ["&#00065;", "&#;", "&#x;", "&#X41"]
    samples = names + numbers + ["".join(rng.choices([*names, *numbers, " ", "a", ";", "#", "ก", "😀", "\n"], k=30)) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(samples)), "i int, s string")
    got = df.select("i", t.decode_references(F.col("s")).alias("v"), t.strip_html(F.col("s"), closed_only=True).alias("c")).orderBy("i").collect()
    assert [(s, r["v"]) for s, r in zip(samples, got) if r["v"] != html.unescape(s)] == []
    closed = {s: r["c"] for s, r in zip(samples, got)}
    assert (closed["&&&amp"], closed["&amp;lt;"], closed["&#65"], closed["&#65;"], closed["&notit;"]) == ("&&&amp", "&lt;", "&#65", "A", "&notit;")
    plan = df.select(t.strip_html(F.col("s")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


def test_page_cut_off_inside_an_entity(spark):
    """The queries over pages read an entity without its end as their SQL does; the operator reads it as a browser does."""
    page = F.lit("<title>a &amp;&amp;&amp</title>")
    assert one(spark, t.strip_html(page, closed_only=True)) == "a &&&amp" and one(spark, t.strip_html(page)) == "a &&&"


def test_buddhist_years(spark):
    cases = {"ปี2569": "ปี2026", "ศ2569": "ศ2569", "in 2568 and 2569.": "in 2025 and 2026.", "x2569": "x2569", "2499 2600": "2499 2600", "25690": "25690"}
    for given, expected in cases.items():
        assert one(spark, t.be_to_ce_year(F.lit(given))) == expected


def test_small_values(spark):
    assert one(spark, v.safe_number(F.lit(" 1,234.5 "))) == 1234.5
    assert one(spark, v.safe_number(F.lit("abc"))) is None and one(spark, v.safe_number(F.lit(""), 7)) == 7
    assert one(spark, v.format_value("win", F.lit(0.25), "double")) == "0.25"
    assert one(spark, v.format_value("n", F.lit(1234567), "int")) == "1,234,567"
    assert one(spark, v.format_value("ratio", F.lit(3.0), "double")) == "3"
    assert one(spark, v.format_value("Plan Amount", F.lit(1234), "int")) == "1,234.00"
    assert one(spark, v.strip_suffix(F.lit("a.md.md"))) == "a" and one(spark, v.strip_suffix(F.lit("a.mdx"))) == "a.mdx"
    assert one(spark, v.is_guid(F.lit("0" * 8 + "-1111-2222-3333-" + "4" * 12))) is True
    assert one(spark, v.join_nonempty([F.lit(""), F.lit(None)])) == "—"
    assert one(spark, v.ratio(F.lit(1), F.lit(0), 0)) == 0.0
    assert one(spark, t.extract_json(F.lit('say {"a": {"b": 1}} bye'))) == '{"a": {"b": 1}}'
    assert one(spark, t.extract_json(F.lit("none"))) is None


# ---- Chunking against the rule written as a loop ----------------------------------------


def fold(text, size, overlap):
    """Chunks as token lists, the carry kept as a running tail."""
    sections = [s.strip() for s in re.split(r"(?m)^(?=##\s)", text) if s.strip()] or [text]
    out, carry = [], []
    for section in sections:
        tokens = carry + section.split()
        if len(tokens) <= size:
            out.append(tokens)
            carry = tokens[-overlap:] if overlap else []
            continue
        start = 0
        while start < len(tokens):
            out.append(tokens[start : start + size])
            if start + size >= len(tokens):
                break
            start += size - overlap
        carry = section.split()[-overlap:] if overlap else []
    return out


def test_chunks_equal_the_fold(spark):
    rng = random.Random(5)
    docs = [(0, ""), (1, "one"), (2, "   ")]
    for n in (20, 69, 70, 79, 80, 81, 150, 151):
        docs.append((len(docs), " ".join(f"w{i}" for i in range(n))))
    for _ in range(120):
        parts = []
        for _ in range(rng.randint(1, 6)):
            head = rng.choice(["## h\n", "", "### sub\n", "##no\n"])
            parts.append(head + " ".join(f"t{rng.randint(0, 999)}" for _ in range(rng.choice([0, 1, 3, 9, 10, 11, 70, 71, 80, 81, 200]))))
        docs.append((len(docs), "\n".join(parts)))
    df = spark.createDataFrame(docs, "doc_id int, text string")
    got = {}
    for r in chunk_document(df, "doc_id", "text", size=80, overlap=10).orderBy("doc_id", "chunk_seq").collect():
        got.setdefault(r.doc_id, []).append(r.content.split())
    for doc_id, text in docs:
        assert got[doc_id] == fold(text, 80, 10), (doc_id, text[:80])


def test_chunks_keep_line_breaks_and_hash(spark):
    df = spark.createDataFrame([("d", "# T\n\nintro  line\n## A\nx\n  y\n")], "doc string, text string")
    chunks = chunk_document(df, "doc", "text").orderBy("chunk_seq").collect()
    assert chunks[0].content == "# T\n\nintro  line"
    assert chunks[1].content.endswith("## A\nx\n  y")
    import hashlib

    assert chunks[1].md_hash == hashlib.sha256(chunks[1].content.encode()).hexdigest()


def test_windows_cover_the_text(spark):
    df = spark.createDataFrame([(n, " ".join(map(str, range(n)))) for n in (0, 1, 800, 801, 1500, 1501)], "n int, text string")
    seen = {}
    for r in sliding_windows(df, "n", "text").collect():
        seen.setdefault(r.n, []).append((r.first_token, r.n_tokens, r.content.split()))
    assert 0 not in seen and len(seen[800]) == 1 and len(seen[801]) == 2 and len(seen[1500]) == 2 and len(seen[1501]) == 3
    for n, windows in seen.items():
        assert {tok for _, _, w in windows for tok in w} == {str(i) for i in range(n)}
        assert all(w == [str(i) for i in range(first, first + k)] for first, k, w in windows)


def test_chunking_is_linear_in_sections(spark):
    def seconds(n):
        text = "\n".join(f"## Head {i}\nbody of section {i} with words" for i in range(n))
        df = spark.createDataFrame([(1, text)], "k int, t string")
        started = time.perf_counter()
        assert chunk_document(df, "k", "t", size=20, overlap=5).count() >= n
        return time.perf_counter() - started

    seconds(10)
    assert seconds(20_000) < 30 * max(1.0, seconds(1_000))


def test_whole_floats_of_any_size_have_all_their_digits(spark):
    from salesloom.functions.values import typed_to_text

    whole = [0.0, -0.0, 7.0, -12345678901.0, 2.0**53, 2.0**60, -(2.0**63), 1e18, 1e19, 123456789e15, 1e23, 2.0**125 + 2.0**80, -1e37]
    df = spark.createDataFrame([(i, v) for i, v in enumerate([*whole, 0.5, None, 1e300])], "k int, v double")
    got = [r[0] for r in df.orderBy("k").select(typed_to_text(F.col("v"), "double")).collect()]
    assert got == [*(str(int(v)) for v in whole), "0.5", "", "1.0E300"]
    odd = spark.createDataFrame([(float("inf"),), (float("nan"),)], "v double").select(typed_to_text(F.col("v"), "double")).collect()
    assert {r[0] for r in odd} == {"Infinity", "NaN"}
