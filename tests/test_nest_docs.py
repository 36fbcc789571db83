from pyspark.sql import functions as F

from salesloom.operators import docs
from salesloom.operators.lenses import lens_industry, lens_salesperson, lens_solution
from salesloom.operators.nest import account_nest, enriched_deals, opportunity_enrich
from salesloom.operators.ordered import numbered
from salesloom.operators.upsert import merge_rows, upsert_actions, upsert_outcome, upsert_report

ACCOUNT = "account_id string, account_name string, industry string, customer_type string, account_status string, city string, province string"


def frames(spark):
    accounts = spark.createDataFrame(
        [("A1", "บริษัท หนึ่ง", "Auto", "Customer", "Active", "Rayong", ""), ("A2", "Two", "Auto", "", "Active", "", ""), ("", "No key", "x", "", "", "", "")],
        ACCOUNT,
    )
    contacts = spark.createDataFrame(
        [("A1", "c1", "Ann", "CEO", "a@x.example", ""), ("A1", "c2", "Bob", "CTO", "", ""), ("A2", "c3", "Cid", "", "", "1")],
        "account_id string, contact_id string, contact_name string, job_title string, email string, mobile string",
    )
    deals = spark.createDataFrame(
        [("A1", "o1", "Big <b>deal</b>", "Open", "80", "2026-01-01", "100", "MES", "Alex", "<p>first&nbsp;&amp; best</p>", ""), ("A2", "o2", "Small", "Won", "100", "", "5", " ", "", "", "price")],
        "account_id string, deal_id string, deal_name string, status string, possibility string, est_close string, plan_amount string, solution string, person string, description string, detail_reasons string",
    )
    activities = spark.createDataFrame(
        [("A1", "v1", "o1", "2026-01-02", "Call", "Phone", "Done"), ("A1", "v2", "o1", "2026-01-03", "Visit", "Task", "Open"), ("o2", "v3", "o2", "2026-01-03", "Mail", "Email", "Open")],
        "account_id string, activity_id string, deal_id string, activity_date string, subject string, activity_type string, state string",
    )
    notes = spark.createDataFrame(
        [("A1", "n1", "Note", "2026-01-01", "<i>hello</i> world"), ("A1", "n2", "Blank", "2026-01-01", "  ")],
        "account_id string, note_id string, title string, note_date string, body string",
    )
    return accounts, contacts, deals, activities, docs.clean_notes(notes)


def test_two_accounts(spark):
    records = {r.account_id: r for r in account_nest(*frames(spark)).collect()}
    assert set(records) == {"A1", "A2"}
    one, two = records["A1"], records["A2"]
    assert (one.n_contacts, one.n_deals, one.n_activities, one.n_notes) == (2, 1, 2, 1)
    assert (two.n_contacts, two.n_deals, two.n_activities, two.n_notes) == (1, 1, 0, 0)
    assert [c.contact_name for c in one.contacts] == ["Ann", "Bob"] and two.activities == []


def test_account_document(spark):
    body = {r.path: r.body for r in docs.render_account_doc(account_nest(*frames(spark))).collect()}
    one, two = body["account/A1.md"], body["account/A2.md"]
    assert one.startswith("---\nentity: account\naccount_id: A1\nname: บริษัท หนึ่ง\n")
    assert "**Location:** Rayong\n" in one and "**Website:** —\n" in one
    assert "## Contacts (2)\n- **Ann** — CEO | a@x.example\n- **Bob** — CTO\n\n## Opportunities (1)\n" in one
    assert "  Est. Close: 2026-01-01 | SO Plan: 100 | Solution: MES | Sales: Alex\n" in one
    assert "## Notes (1)\n**Note** (2026-01-01)\nhello world\n\n" in one
    assert "## Recent Activities (0)\n_(none)_\n" in two and "**Location:** —\n" in two and "  Reason: price\n" in two


def test_enriched_deal_lines(spark):
    deals = spark.createDataFrame([("o1", "A1", "Deal", "Lost")], "deal_id string, account_id string, deal_name string, status string")
    roles = spark.createDataFrame([("o1", "s1", "Decision maker"), ("o1", "s2", ""), ("o1", "s3", "User")], "deal_id string, stakeholder_id string, role string")
    reviews = spark.createDataFrame([("o1", "r1")], "deal_id string, review_id string")
    closes = spark.createDataFrame([("o1", "too dear", "2026-02-01")], "deal_id string, reason string, close_date string")
    enriched = opportunity_enrich(deals, roles, reviews, closes)
    assert enriched.select("n_connections", "n_reviews", "n_close").first() == (3, 1, 1)
    nested_deals = enriched_deals(enriched)
    accounts, contacts, _, activities, notes = frames(spark)
    body = docs.render_account_doc(account_nest(accounts, contacts, nested_deals, activities, notes)).where("doc_key = 'A1'").first().body
    assert "  Stakeholders: Decision maker, User\n" in body and "  Closed: too dear | Date: 2026-02-01\n" in body


def hot_frames(spark):
    """One account owns most deals; one deal group has no account at all."""
    accounts = spark.createDataFrame([(i, f"Name {i}", "Ind") for i in range(5)], "account_id bigint, account_name string, industry string")
    deals = spark.range(0, 600).select(
        F.when(F.col("id") < 300, 0).when(F.col("id") < 500, 99).otherwise(F.col("id") % 5).cast("bigint").alias("account_id"),
        F.col("id").alias("deal_id"),
        F.concat(F.lit("Deal "), F.col("id").cast("string")).alias("deal_name"),
    )
    empty = spark.createDataFrame([], "account_id bigint, id bigint")
    return accounts, deals, empty


def test_hot_account_is_one_ordered_record(spark, rows):
    accounts, deals, empty = hot_frames(spark)
    kept = deals.join(accounts, "account_id", "left_semi")
    want = rows(account_nest(accounts, empty, deals, empty, empty))
    for size in (1, 3, 50):
        nested = account_nest(accounts, empty, deals, empty, empty, block_size=size)
        assert rows(nested) == want
        assert rows(nested.select("account_id", F.explode("deals.deal_id"))) == rows(kept.select("account_id", "deal_id"))
    hot = nested.where("account_id = 0").first()
    assert hot.n_deals == 320 and [d.deal_id for d in hot.deals] == sorted(d.deal_id for d in hot.deals)
    lines = [x for x in docs.render_account_doc(nested).where("path = 'account/0.md'").first().body.splitlines() if x.startswith("- **Deal")]
    assert len(lines) == len(set(lines)) == 320


def test_three_levels_at_any_block_size(spark):
    accounts, contacts, deals, activities, notes = frames(spark)
    roles = spark.createDataFrame([("o1", f"s{i}", f"role {i}") for i in range(9)], "deal_id string, stakeholder_id string, role string")
    reviews = spark.createDataFrame([("o1", "r1"), ("o1", "r2")], "deal_id string, review_id string")
    closes = spark.createDataFrame([("o1", "a later reason", "2026-02-01", 2), ("o1", "the first row", "2026-03-01", 1)], "deal_id string, reason string, close_date string, _order int")
    bodies = set()
    for size in (1, 3, 10_000):
        enriched = enriched_deals(opportunity_enrich(deals, roles, reviews, closes, block_size=size))
        body = docs.render_account_doc(account_nest(accounts, contacts, enriched, activities, notes, block_size=size)).where("doc_key = 'A1'").first().body
        bodies.add(body)
    assert len(bodies) == 1
    assert "  Stakeholders: " + ", ".join(f"role {i}" for i in range(9)) + "\n" in body
    assert "  Closed: the first row | Date: 2026-03-01\n" in body
    assert "  Description: first & best\n" in body  # mark-up is removed, entities decoded


def test_number_along_any_order(spark):
    keys = [None, "", "a", "ab", "b", "é", "z"]
    df = spark.createDataFrame([(i % 3, f"{keys[i % 7]}{i}" if keys[i % 7] is not None else None, i) for i in range(500)], "g int, k string, i int").repartition(7)
    got = {r.i: r.row_index for r in numbered(df, ["g"], ["k", "i"]).collect()}
    for g in range(3):
        own = sorted(((r.k is not None, (r.k or "").encode(), r.i) for r in df.where(f"g = {g}").collect()))
        assert [got[i] for *_, i in own] == list(range(len(own)))
    plan = numbered(df, [], ["k", "i"])._jdf.queryExecution().toString()
    assert "Window" not in plan
    assert sorted(r.row_index for r in numbered(df, [], ["k", "i"]).collect()) == list(range(500))


def test_duplicate_account_rows_give_duplicate_records(spark):
    accounts, deals, empty = hot_frames(spark)
    doubled = accounts.unionByName(accounts.where("account_id = 1"))
    nested = account_nest(doubled, empty, deals, empty, empty)
    assert nested.where("account_id = 1").count() == 2


def flat(spark):
    return spark.createDataFrame(
        [("o1", "A", "D1", "Open", 10, "2026-01-01", "MES", "Kim"), ("o2", "", "D2", "Won", 20, "2026-01-01", "MES", "Kim"), ("o3", "B", "D3", "Lost", 30, "2026-01-01", " ", "Lee"), ("o4", "A", "D4", "Open", 40, None, "บัญชี", "")],
        "deal_id string, account_name string, deal_name string, status string, possibility int, est_close string, solution string, person string",
    )


def test_solution_lens(spark, rows):
    for size in (1, 10_000):
        lens = lens_solution(flat(spark), block_size=size)
        assert rows(lens.select("key", "deal_count", "account_count").distinct()) == [("mes", 2, 1), ("บ-ญช", 1, 1)]
        assert rows(lens.select("solution", F.explode("deals.deal_name"))) == [("MES", "D1"), ("MES", "D2"), ("บัญชี", "D4")]


def test_salesperson_lens_counts_blank_account_and_keeps_newest(spark):
    acts = spark.createDataFrame([(i, "o1", "2026-01-01" if i < 30 else "2026-01-02", f"s{i}", "Task", "Open") for i in range(51)], "activity_id int, deal_id string, activity_date string, subject string, activity_type string, state string")
    lens = {r.person: r for r in lens_salesperson(flat(spark), acts, recent=50).collect()}
    assert lens["Kim"].account_count == 2 and lens["Lee"].activities == []
    shown = [a.subject for a in lens["Kim"].activities]
    assert len(shown) == 50 and shown[0] == "s30" and shown[21] == "s0" and "s29" not in shown
    whole = {r.person: r for r in lens_salesperson(flat(spark), acts, block_size=4).collect()}
    assert [a.subject for a in whole["Kim"].activities] == [f"s{i}" for i in (*range(30, 51), *range(30))]
    body = docs.render_salesperson_doc(lens_salesperson(flat(spark), acts)).where("path = 'salesperson/lee.md'").first().body
    assert "_(none)_" in body


def test_industry_lens_one_line_per_account(spark):
    accounts = spark.createDataFrame([(f"a{i}", f"N{i}", "Auto", "", "Active", "", "Rayong") for i in range(3)], ACCOUNT)
    deals = spark.createDataFrame([("a0", "o1", "MES"), ("a0", "o2", "ERP"), ("a0", "o3", "ERP"), ("a1", "o4", " ")], "account_id string, deal_id string, solution string")
    body = docs.render_industry_doc(lens_industry(accounts, deals)).first().body
    assert [line for line in body.splitlines() if line.startswith("- ")] == [
        "- **N0** — Rayong | Opps: 3 | Solutions: ERP, MES", "- **N1** — Rayong | Opps: 1", "- **N2** — Rayong | Opps: 0",
    ]


def test_documents_from_rows_are_those_of_nested_records(spark, rows):
    """Whatever the blocks, also where one group holds most rows, and for rows without a value."""
    n = 300
    deals = spark.range(n).select(
        F.format_string("o%03d", F.lit(n - 1) - F.col("id")).alias("deal_id"),
        F.expr("CASE id % 7 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'N' || id % 11 END").alias("account_name"),
        F.expr("CASE WHEN id % 13 = 0 THEN NULL ELSE 'D' || id END").alias("deal_name"),
        F.lit("Open").alias("status"),
        F.col("id").alias("possibility"),
        F.expr("CASE WHEN id % 3 > 0 THEN '2026-01-01' END").alias("est_close"),
        F.expr("CASE WHEN id % 5 < 3 THEN 'MES' WHEN id % 5 = 3 THEN ' ' ELSE 'S' || id % 4 END").alias("solution"),
        F.expr("CASE WHEN id % 4 > 0 THEN ' Kim ' WHEN id % 8 = 0 THEN 'P' || id ELSE '' END").alias("person"),
        F.expr("'<b>first &amp; ' || id || '</b>'").alias("description"),
        F.format_string("a%d", F.col("id") % 40).alias("account_id"),
    ).repartition(5)
    acts = spark.range(400).select(
        F.col("id").alias("activity_id"), F.format_string("o%03d", F.col("id") % 350).alias("deal_id"), F.lit("Call").alias("subject"), F.lit("Task").alias("activity_type"),
        F.expr("CASE WHEN id % 9 > 0 THEN '2026-01-0' || id % 9 END").alias("activity_date"), F.lit("Open").alias("state"),
    )
    accounts = spark.range(60).select(
        F.format_string("a%d", "id").alias("account_id"), F.format_string("N%d", "id").alias("account_name"), F.expr("CASE WHEN id % 6 < 5 THEN 'Auto' ELSE 'Food' END").alias("industry"),
        F.lit("").alias("customer_type"), F.lit("Active").alias("account_status"), F.lit("Rayong").alias("city"), F.expr("CASE WHEN id % 2 = 0 THEN 'East' END").alias("province"),
    )
    solutions = rows(docs.render_solution_doc(lens_solution(deals)))
    sellers = {k: rows(docs.render_salesperson_doc(lens_salesperson(deals, acts, recent=k))) for k in (None, 5)}
    industries = rows(docs.render_industry_doc(lens_industry(accounts, deals)))
    for size in (1, 7, 10_000):
        assert rows(docs.solution_docs(deals, block_size=size)) == solutions
        for k, want in sellers.items():
            assert rows(docs.salesperson_docs(deals, acts, recent=k, block_size=size)) == want
        assert rows(docs.industry_docs(accounts, deals, block_size=size)) == industries
    assert rows(docs.account_docs(*frames(spark))) == rows(docs.render_account_doc(account_nest(*frames(spark))))
    hot, deals, empty = hot_frames(spark)
    for size in (3, 10_000):
        assert rows(docs.account_docs(hot, empty, deals, empty, empty, block_size=size)) == rows(docs.render_account_doc(account_nest(hot, empty, deals, empty, empty)))


def test_upsert_outcomes_and_second_run(spark, rows):
    stored = spark.createDataFrame([("b", "h2"), ("gone", "h9")], "account_id string, md_hash string")
    new = spark.createDataFrame([("a", "h1"), ("b", "h2"), ("", "h3")], "account_id string, md_hash string")
    assert upsert_report(upsert_outcome(stored, new, ["account_id"])).first() == (1, 1, 1)
    merged = merge_rows(stored, new, ["account_id"])
    assert rows(merged) == [("a", "h1"), ("b", "h2"), ("gone", "h9")]
    assert upsert_report(upsert_outcome(merged, new, ["account_id"])).first() == (0, 2, 1)


def test_rendering_again_changes_nothing(spark):
    first = docs.render_account_doc(account_nest(*frames(spark)))
    second = docs.render_account_doc(account_nest(*frames(spark)))
    assert upsert_report(upsert_outcome(first, second, ["path"])).first() == (0, 2, 0)


def test_stale_chunks(spark, rows):
    stored = spark.createDataFrame([("d", 0, "x"), ("d", 1, "y"), ("e", 0, "z")], "doc string, seq int, md_hash string")
    new = spark.createDataFrame([("d", 0, "x2")], "doc string, seq int, md_hash string")
    keys = ["doc", "seq"]
    assert rows(merge_rows(stored, new, keys)) == [("d", 0, "x2"), ("d", 1, "y"), ("e", 0, "z")]
    assert rows(merge_rows(stored, new, keys, stale_within="doc")) == [("d", 0, "x2"), ("e", 0, "z")]
    actions = upsert_actions(stored, new, keys, stale_within="doc")
    assert rows(actions, "doc", "seq", "action") == [("d", 0, "update"), ("d", 1, "delete"), ("e", 0, "keep")]
