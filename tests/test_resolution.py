import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from tidewire.functions.names import normalize_name
from tidewire.operators import lookups, resolution
from tidewire.sources import filings


def test_merges_move_what_hangs_on_an_entity(spark):
    e = spark.createDataFrame([(1, "Acme", "unknown", 2), (2, "Acme Inc", "company", 3), (3, "ACME", "person", 1), (4, "Staff", "group", 9)], "id long, name string, entity_type string, mention_count long")
    m = spark.createDataFrame([(1, 2), (1, 3)], "keep long, merge long")
    assert sorted(map(tuple, resolution.merged_entities(e, m).collect())) == [(1, "Acme", "company", 6), (4, "Staff", "group", 9)]
    tags = spark.createDataFrame([(2, "a"), (3, "a"), (1, "b"), (3, "b"), (4, "a")], "entity_id long, tag string")
    assert sorted(map(tuple, resolution.moved(tags, resolution.in_turn(m, e), ["tag"]).collect())) == [(1, "a"), (1, "b"), (4, "a")]
    gone = resolution.removed(e)
    assert [r.id for r in gone.collect()] == [4]
    edges = spark.createDataFrame([(1, 2), (4, 1), (1, 4)], "subject_id long, object_id long")
    assert [tuple(r[c] for c in ("subject_id", "object_id")) for r in resolution.without_removed(edges, gone).collect()] == [(1, 2)]
    assert resolution.moved(tags.limit(0), resolution.in_turn(m, e), ["tag"]).count() == 0


def test_aliases(spark):
    e = spark.createDataFrame([(1, "Acme", "company")], "id long, name string, entity_type string")
    have = spark.createDataFrame([("acme", "company", "ACM", "acm")], "normalized_name string, entity_type string, alias string, normalized_alias string")
    news = spark.createDataFrame([("acme ", "acm", "company"), ("Acme", "Ac Me", "company"), ("Zed", "zd", "company"), ("Zed", "ZD", "company")], "canonical string, alias string, entity_type string")
    made, added = lookups.add_aliases(e, have, news)
    assert [r.name for r in made.collect()] == ["Zed"]
    assert sorted((r.normalized_name, r.normalized_alias) for r in added.collect()) == [("acme", "ac me"), ("zed", "zd")]
    names = spark.createDataFrame([("Facebook", "company"), ("acm", "company"), ("acm", "person"), ("other", "company")], "name string, entity_type string")
    own = spark.createDataFrame([(1, "acm")], "entity_id long, normalized_alias string")
    found = {(r.name, r.entity_type): r.resolved for r in lookups.resolve_aliases(names, own, e).collect()}
    assert found == {("Facebook", "company"): "meta", ("acm", "company"): "Acme", ("acm", "person"): "acm", ("other", "company"): "other"}


def test_filing_to_entities_and_edges(spark):
    rows = spark.sql("""
        SELECT 7L AS cik, 'Filer Co' AS company, 'n-1' AS accession_no, DATE '2024-02-01' AS filing_date,
               named_struct('entity_name', 'Zed Dec 2025 a Series of Big, LLC', 'jurisdiction', 'DE', 'entity_type', 'LLC', 'year_of_incorporation', '2025') AS issuer,
               '$1,250,000' AS total_offering_amount, 'x' AS total_amount_sold, CAST(NULL AS BIGINT) AS total_already_invested,
               array(named_struct('first_name', 'Ann', 'last_name', 'Lee'), named_struct('first_name', CAST(NULL AS STRING), 'last_name', ' ')) AS related_persons
        UNION ALL SELECT 8L, 'Plain Co', 'n-2', NULL, NULL, NULL, NULL, 3L, NULL""")
    flat = {r.cik: r for r in filings.parse_filings(rows).collect()}
    assert (flat["7"].company_name, flat["7"].total_amount, flat["7"].amount_sold, flat["7"].total_investors, flat["7"].officers) == ("Zed Dec 2025 a Series of Big, LLC", 1250000.0, None, 0, ["Ann Lee"])
    assert (flat["8"].company_name, flat["8"].officers, flat["8"].total_investors) == ("Plain Co", [], 3)
    out = {r.cik: r.result for r in filings.filing_results(filings.parse_filings(rows)).collect()}
    assert [(x.name, x.entity_type, x.confidence) for x in out["7"].entities] == [("Zed Dec 2025 a Series of Big, LLC", "company", 0.95), ("Zed", "company", 0.75), ("Ann Lee", "person", 0.95)]
    assert [(x.subject, x.predicate, x.context) for x in out["7"].relationships] == [("Ann Lee", "OFFICER_OF", "SEC Form D filing n-1"), ("Zed", "RAISED_FUNDING", "$1,250,000 raised via SEC Form D (0 investors)")]
    assert [x.name for x in out["8"].entities] == ["Plain Co"] and out["8"].relationships == []


def test_directory_companies(spark):
    hit = '{"name": "A", "slug": "a", "batch": "W24", "one_liner": "", "long_description": "long", "city": "Oslo", "industries": ["ai"], "founders": [{"full_name": "Bo Li", "title": "CEO"}, {"full_name": ""}]}'
    rows = filings.parse_directory(spark.createDataFrame([(hit,), ('{"slug": "nameless"}',), ("bad",)], "hit string"), "https://dir.example/")
    r = rows.first()
    assert rows.count() == 1 and (r.description, r.location, r.website, r.status) == ("long", "Oslo", "https://dir.example/a", "Active")
    assert filings.recent_batches(2026, 3) == ["W26", "S26", "W25"]
    assert filings.chosen(rows, batches=["W24"], industry="ai", limit=5).count() == 1 and filings.chosen(rows, status="Dead").count() == 0
    got = filings.directory_results(rows, "Seed House", "SH").first().result
    assert [x.name for x in got.entities] == ["A", "Bo Li"]
    assert [(x.subject, x.predicate, x.object, x.context) for x in got.relationships] == [("Bo Li", "FOUNDED", "A", "SH W24 batch"), ("A", "FUNDED_BY", "Seed House", "SH W24 batch")]


def replay(entities, edges, tags, enrichment, aliases, keys, deny):
    """The tables after removals, type fixes and one merge after the other, and the counts; a clash leaves the row that was there."""
    gone = {i for i, (name, _, _) in entities.items() if name.lower() in deny}
    entities = {i: list(e) for i, e in entities.items() if i not in gone}
    edges = [list(r) for r in edges if r[1] not in gone and r[3] not in gone]
    fixed = 0
    for i, e in entities.items():
        if e[1] == "unknown":
            own = {("s", p) for _, s, p, _, _ in edges if s == i} | {("o", p) for _, _, p, o, _ in edges if o == i}
            if own & {("s", p) for p in ("CEO_OF", "CTO_OF", "CFO_OF", "FOUNDED", "HIRED_BY")}:
                e[1], fixed = "person", fixed + 1
            elif own & {("s", "FUNDED_BY"), ("o", "HIRED_BY"), ("s", "ACQUIRED")}:
                e[1], fixed = "company", fixed + 1
    rank = sorted(entities, key=lambda i: (-entities[i][2], i))
    fits = lambda a, b: entities[a][1] == entities[b][1] or "unknown" in (entities[a][1], entities[b][1])
    pairs = [(a, b) for k, a in enumerate(rank) for b in rank[k + 1 :] if keys[a] and keys[b] and fits(a, b) and SequenceMatcher(None, keys[a], keys[b]).ratio() >= 0.85]
    merged = 0
    for keep, merge in pairs:
        if keep not in entities or merge not in entities:
            continue
        for end in (1, 3):
            for r in [r for r in edges if r[end] == merge]:
                new = r[:end] + [keep] + r[end + 1 :]
                if r[4] is not None and any(x is not r and x[1:] == new[1:] for x in edges):
                    edges.remove(r)
                else:
                    r[end] = keep
        for table in (tags, enrichment):
            for key in [k for k in table if k[0] == merge]:
                table.setdefault((keep, key[1]), table.pop(key))
        aliases.setdefault((keep, entities[merge][0].strip().lower()), entities[merge][0])
        if entities[keep][1] == "unknown":
            entities[keep][1] = entities[merge][1]
        entities[keep][2] += entities[merge][2]
        del entities[merge]
        merged += 1
    return entities, edges, tags, enrichment, aliases, (len(gone), fixed, len(pairs), merged)


@pytest.mark.parametrize("seed", [1, 2])
def test_resolution_is_the_replay(spark, seed):
    rng = random.Random(seed)
    roots = ["acme robotics", "borealis labs", "corvid energy", "dynamo health", "ember foods", "pat lee morgan", "kim ray jones"]
    entities = {}
    for i in range(1, 201):
        name = rng.choice(roots)
        k = rng.randrange(len(name))
        name = rng.choice([name, name.title(), name + " Inc.", name[:k] + rng.choice("abxy ") + name[k + 1 :], name + rng.choice("0123456789"), name[::-1]])
        entities[i] = (name, rng.choice(["company", "company", "person", "unknown"]), rng.randrange(6))
    entities |= {201: ("Startup", "company", 50), 202: ("the firm", "unknown", 1)}
    predicates = ["FUNDED_BY", "HIRED_BY", "ACQUIRED", "CEO_OF", "LAID_OFF"]
    edges = []
    for _ in range(900):
        r = (rng.randrange(1, 203), rng.choice(predicates), rng.randrange(1, 60), rng.choice(["2024-01-01", "2024-01-02", None]))
        if r[3] is None or r not in [x[1:] for x in edges]:
            edges.append((len(edges) + 1, *r))
    tags = {(rng.randrange(1, 203), rng.choice("abc")): None for _ in range(150)}
    enrichment = {(rng.randrange(1, 203), rng.choice(["web", "graph"])): k for k in range(200)}
    aliases = {(3, "acme"): "ACME", (5, "acme robotics"): "mine"}
    mk = spark.createDataFrame
    tables = resolution.Tables(
        mk([(i, *e) for i, e in entities.items()], "id long, name string, entity_type string, mention_count long"),
        mk(edges, "id long, subject_id long, predicate string, object_id long, event_date string"),
        mk(list(tags), "entity_id long, tag string"),
        mk([(*k, v) for k, v in enrichment.items()], "entity_id long, source string, data long"),
        mk([(*k, v) for k, v in aliases.items()], "entity_id long, normalized_alias string, alias string"),
    )
    keys = {r.id: r.key for r in tables.entities.select("id", normalize_name(F.col("name")).alias("key")).collect()}
    want = replay(entities, edges, dict(tags), dict(enrichment), dict(aliases), keys, resolution.REMOVED_ENTITIES)
    after, counts = resolution.resolve(tables)
    assert {r.id: [r.name, r.entity_type, r.mention_count] for r in after.entities.collect()} == want[0]
    order = lambda rows: sorted(rows, key=str)
    got = [[r.id, r.subject_id, r.predicate, r.object_id, r.event_date] for r in after.relationships.collect()]
    assert order(got) == order(want[1])
    assert {(r.entity_id, r.tag) for r in after.tags.collect()} == set(want[2])
    assert {(r.entity_id, r.source): r.data for r in after.enrichment.collect()} == want[3]
    assert {(r.entity_id, r.normalized_alias): r.alias for r in after.aliases.collect()} == want[4]
    r = counts.first()
    assert (r.invalid_removed, r.types_fixed, r.duplicates_found, r.duplicates_merged) == want[5] and r.duplicates_merged > 60
    nothing, zero = resolution.resolve(resolution.Tables(*(t.limit(0) for t in tables)))
    assert nothing.relationships.count() == 0 and zero.first().duplicates_found == 0
