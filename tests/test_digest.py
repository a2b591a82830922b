"""The digest's keys, titles and Markdown lines on a small graph."""

from tidewire.operators import digest


def graph(spark, edges):
    names = sorted({x for s, _, o, *_ in edges for x in (s, o)})
    ids = {x: k for k, x in enumerate(names)}
    entities = spark.createDataFrame([(ids[x], x, "company", 1) for x in names], "id long, name string, entity_type string, mention_count long")
    rows = [(k, ids[s], p, ids[o], day, context) for k, (s, p, o, day, context) in enumerate(edges)]
    r = spark.createDataFrame(rows, "id long, subject_id long, predicate string, object_id long, day string, context string")
    return r.selectExpr("*", "CAST(day AS DATE) AS event_date").drop("day"), entities


EDGES = [
    ("Zed", "FUNDED_BY", "Big Fund", "2024-03-02", "raised $5 million"),
    ("Quartz", "RAISED_FUNDING", "Undisclosed Investors", None, "Form D filing"),
    ("Acme", "LAID_OFF", "employees", "2024-03-01", "laid off 1,200 employees"),
    ("Acme Inc", "LAID_OFF", "employees", "2024-02-01", ""),
    ("Ann Lee", "DEPARTED_FROM", "Acme", "2024-03-01", ""),
    ("ann lee ", "DEPARTED_FROM", "acme", "2024-02-01", ""),
    ("Bo Li", "DEPARTED_FROM", "Zed", "2024-03-02", ""),
    ("Ann Lee", "CTO_OF", "Acme", "2023-01-01", ""),
    ("Bo Li", "EXECUTIVE_OF", "Zed", "2023-01-01", ""),
    ("Bo Li", "HIRED_BY", "Quartz", "2024-03-03", ""),
]


def test_keys_and_titles(spark):
    r, e = graph(spark, EDGES)
    assert [(x.company, x["count"]) for x in digest.layoffs(r, e).collect()] == [("Acme", 1200), ("Acme Inc", None)]
    assert [(x.person, x.action) for x in digest.moves(r, e).collect()] == [("Bo Li", "left"), ("Ann Lee", "left"), ("Bo Li", "joined")]
    assert [(x.person, x.title, x.score) for x in digest.hot_candidates(r, e).collect()] == [("Ann Lee", "Cto", 90), ("Bo Li", "Executive", 70)]


def test_document(spark):
    r, e = graph(spark, EDGES)
    got = [x.text for x in digest.document(r, e, "2024-03-05", "daily").orderBy("line").collect()]
    assert got == [
        "# Event digest Daily - March 05, 2024", "",
        "**This week: 2 rounds, 2 (displaced talent), 3 moves, 2 talent.**", "", "---", "",
        "## Funding Rounds", "", "- **Zed** raised $5 million from Big Fund [News]", "- **Quartz** [SEC]", "",
        "## Layoffs (Displaced Talent)", "", "- **Acme** laid off 1200 employees [Layoff]", "- **Acme Inc** [Layoff]", "",
        "## Executive Moves", "", "- **Bo Li** left Zed", "- **Ann Lee** left Acme", "- **Bo Li** joined Quartz", "",
        "## Available Talent", "", "- **Ann Lee** (Cto) - left Acme [Available]", "- **Bo Li** (Executive) - left Zed [Available]", "",
        "---", "", f"*Entities: {e.count()} | Relationships: {len(EDGES)}*",
    ]


def test_document_of_nothing(spark):
    r, e = graph(spark, EDGES)
    got = [x.text for x in digest.document(r.limit(0), e.limit(0), "2024-03-05").orderBy("line").collect()]
    assert got[2] == "**No significant events this period.**" and got[-1] == "*Entities: 0 | Relationships: 0*" and len(got) == 9
