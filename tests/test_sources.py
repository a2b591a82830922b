import datetime

from pyspark.sql import functions as F

from tidewire.operators import listings, migration
from tidewire.sources import cards, filings, landed


def test_cards_of_odd_markup(spark):
    pages = [
        (1, "<a class='company'><span class='pill'><span class='name'>A &lt;b&gt; <i>C</i></span></span></a><a class=company href=/x/y><span>no</span></a><a class='my-company big' href='/c/d'><span class=fullname> D\n</span>"),
        (2, None), (3, ""), (4, "<script><a class=company><span class=name>x</span></a></script><!-- <a class=company> --><p class=company><span class=name>y</span></p>"),
        (5, "<A CLASS=company HREF='https://z.example/zed'><br/><SPAN CLASS=name>Zed</SPAN><span class=name>later</span></A><span class=name>out</span>"),
        (None, "<a class=company><span class=name>x</span></a>"),
    ]
    found = cards.company_cards(spark.createDataFrame(pages, "page_id int, html string")).orderBy("page_id", "place")
    assert [(r.page_id, r.place, r.name, r.slug, r.website) for r in found.collect()] == [(1, 0, "A <b> C", "", ""), (1, 2, "D", "d", "/c/d"), (5, 0, "Zed", "zed", "https://z.example/zed")]
    first = cards.company_cards(spark.createDataFrame(pages[:1], "page_id int, html string"), limit=2)
    assert [r.name for r in first.collect()] == ["A <b> C"]
    told = filings.directory_results(first, "Accelerator", "Acc").first().result
    assert [(e.predicate, e.subject, e.object) for e in told.relationships] == [("FUNDED_BY", "A <b> C", "Accelerator")]


def test_feed_defaults(spark, tmp_path):
    path = tmp_path / "feeds.json"
    path.write_text('{"feeds": [\n {"name": "a", "url": "u"},\n {"name": "b", "url": "v", "priority": 0, "enabled": false, "fetch_interval_minutes": 5}]}')
    found = landed.load_feeds(spark, str(path)).orderBy("ord").select("ord", "name", "priority", "enabled", "fetch_interval_minutes").collect()
    assert [tuple(r) for r in found] == [(0, "a", 1, True, 60), (1, "b", 0, False, 5)]


def test_filings_without_readable_date_stay_last(spark):
    rows = spark.createDataFrame([("1", "2024-01-10", "$1,000"), ("2", "soon", None), ("3", "2023-01-01", "5"), ("4", None, "x"), ("5", "2024-01-11", "7")], "cik string, filing_date string, total_amount string")
    found = landed.recent_filings(rows, "2024-01-12", 10, 4).select("cik", "amount").collect()
    assert [tuple(r) for r in found] == [("5", 7.0), ("1", 1000.0), ("2", None), ("4", None)]


def test_layoff_rows_of_both_header_sets(spark):
    one = spark.createDataFrame([("Acme", "2024-01-05", "1,200 people", "12.5%"), ("", "2024-01-05", "5", ""), ("Bo", "yesterday", "5", ""), ("Cy", "01/02/2024", "", "all")], "`Company` string, `Date` string, `# Laid Off` string, `%` string")
    found = landed.parse_layoffs(one, "2024-01-12").select("company", "date", "employees", "percent").collect()
    assert [tuple(r) for r in found] == [("Acme", datetime.date(2024, 1, 5), 1200, 12.5), ("Cy", datetime.date(2024, 1, 2), None, None)]
    two = spark.createDataFrame([("Dot", "2024-01-05", "9", "3")], "company string, date string, Laid_Off_Count string, Percentage string")
    assert [tuple(r) for r in landed.parse_layoffs(two, "2024-01-12", min_employees=9).select("company", "employees", "percent").collect()] == [("Dot", 9, 3.0)]
    assert landed.parse_layoffs(two, "2024-01-12", min_employees=10).count() == 0


def test_officers_with_and_without_roles(spark):
    schema = "company_name string, cik string, file_number string, filing_date string, total_amount double, total_investors int, officers array<string>"
    rows = spark.createDataFrame([("Acme LLC", "1", "f", "2024-01-01", None, 0, ["Ann Lee", "N/A ", "Bo Li", "Big Fund LP"])], schema)
    kinds = lambda x: [(r.subject, r.subject_type, r.predicate) for r in filings.filing_results(x).first().result.relationships]
    assert kinds(rows) == [("Ann Lee", "person", "OFFICER_OF"), ("Bo Li", "person", "OFFICER_OF"), ("Big Fund LP", "company", "OFFICER_OF")]
    roles = F.array(F.lit("Executive Officer, Director"), F.lit("Director"), F.lit("Executive Officer"))
    assert kinds(rows.withColumn("officer_roles", roles)) == [("Ann Lee", "person", "DIRECTOR_OF"), ("Bo Li", "person", "EXECUTIVE_OF"), ("Big Fund LP", "company", "OFFICER_OF")]


def store(spark):
    articles = spark.createDataFrame([(1, "u", "t", 2, True, None, False), (2, "u", "t2", 1, False, True, True), (3, "v", "t3", 3, None, False, None)], "id int, url string, title string, seq int, processed boolean, is_high_signal boolean, extracted boolean")
    entities = spark.createDataFrame([(1, "A", None), (2, "B", 0), (3, "C", 4)], "id int, name string, mention_count int")
    relationships = spark.createDataFrame([(1, 1, 2, None), (2, 1, 9, 0.5), (3, None, 2, 0.5), (4, 3, 3, 0.0), (5, 3, 3, 0.6)], "id int, subject_id int, object_id int, confidence double")
    enrichment = spark.createDataFrame([(1, "a", "old", 1), (1, "b", None, 2), (3, "a", "x", 1), (9, "a", "x", 1)], "entity_id int, source string, data string, enriched_at int")
    return {"articles": articles, "entities": entities, "relationships": relationships, "enrichment": enrichment}


def test_migration_against_a_replay(spark):
    tables = store(spark)
    copied = migration.migrate(tables, "n")
    ids = {r.name: r.id for r in copied["entities"].collect()}
    assert len(set(ids.values())) == 3 and all(len(x) == 36 and x.count("-") == 4 for x in ids.values())
    assert {r.name: (r.mention_count, r.enrichment_data, r.enrichment_status) for r in copied["entities"].collect()} == {"A": (1, "{}", "enriched"), "B": (1, None, "pending"), "C": (4, "x", "enriched")}
    assert sorted((r.id, r.subject_id, r.object_id, r.confidence) for r in copied["relationships"].collect()) == [(1, ids["A"], ids["B"], 0.8), (4, ids["C"], ids["C"], 0.8), (5, ids["C"], ids["C"], 0.6)]
    assert sorted(r.id for r in copied["skipped"].collect()) == [2, 3]
    assert sorted((r.url, r.title, r.classification_status, r.extraction_status, r.is_high_signal) for r in copied["articles"].collect()) == [("u", "t2", "pending", "extracted", True), ("v", "t3", "pending", "pending", False)]
    assert {r.what: r.n for r in migration.migration_record(copied).collect()} == {"articles": 2, "entities": 3, "relationships": 3, "skipped": 2, "enrichment": 2}
    again = migration.migrate(tables, "n")["entities"]
    assert {r.name: r.id for r in again.collect()} == ids
    empty = migration.migrate({k: v.limit(0) for k, v in tables.items()}, "n")
    assert {r.n for r in migration.migration_record(empty).collect()} == {0}


def test_feeds_keep_their_totals_in_the_copy(spark):
    feed = migration.feeds_to_copy(spark.createDataFrame([("a b", 3, None)], "feed_name string, total_articles int, last_error string"), "https://f.example/").first()
    assert (feed.name, feed.url, feed.feed_type, feed.total_articles) == ("a b", "https://f.example/a b", "rss", 3)


def test_search_listing_meets_longer_names_too(spark):
    entities = spark.createDataFrame([(1, "Ann", "person", 5), (2, "Ann Lee", "person", 9), (3, "Acme", "company", 1), (4, "Dan Berg", "person", 2)], "id int, name string, entity_type string, mention_count int")
    day = datetime.date(2024, 1, 1)
    rows = [(k, 2 if k < 7 else 4, "HIRED_BY", 3, None if k == 6 else day + datetime.timedelta(k), 0.5, "", "") for k in range(1, 8)]
    relationships = spark.createDataFrame(rows, "id int, subject_id int, predicate string, object_id int, event_date date, confidence double, context string, source_url string")
    found = sorted((r.hit, r.place or 0, r.id) for r in listings.search_listing(relationships, entities, "ann").collect())
    assert found == [("Ann", k + 1, 5 - k) for k in range(5)] + [("Ann Lee", k + 1, 5 - k) for k in range(5)]
    alone = listings.search_listing(relationships, entities, "ACME").collect()
    assert [(r.hit, r.id, r.place) for r in alone] == [("Acme", None, None)]
    assert listings.search_listing(relationships, entities, "nobody").count() == 0
