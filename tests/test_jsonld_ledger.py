"""Structured data on VARIANT against a plain walk, and the data source with commits."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from leadspark.functions import html as page
from leadspark.operators import jsonld
from leadspark.sources import ledger

# --- structured data ---------------------------------------------------------------------------------------------------


def walk(v, depth=0):
    """Objects, outer before inner; values in the order of their names."""
    if depth > 6 or not isinstance(v, (dict, list)):
        return
    if isinstance(v, list):
        for x in v:
            yield from walk(x, depth + 1)
        return
    if isinstance(v.get("@graph"), list):
        yield from walk(v["@graph"], depth + 1)
    yield v
    for k in sorted(v):
        yield from walk(v[k], depth + 1)


def value(rng, depth=0):
    kind = rng.random()
    if depth > 8 or kind < 0.25:
        return rng.choice([None, True, 3, 2.5, "", "x", " padded ", "Ünï"])
    if kind < 0.5:
        return [value(rng, depth + 1) for _ in range(rng.randint(0, 3))]
    return {rng.choice(["@graph", "a", "b", "zz", "name", "@type", "é"]): value(rng, depth + 1) for _ in range(rng.randint(0, 4))}


def scripts(*blocks):
    return "<html><head>" + "".join(f'<script type="application/ld+json">{b}</script>' for b in blocks) + "</head><body>text</body></html>"


def test_objects_are_walked_as_told(spark):
    rng = random.Random(3)
    pages = [[json.dumps(value(rng), ensure_ascii=False) for _ in range(rng.randint(1, 3))] for _ in range(60)]
    df = spark.createDataFrame([(i, scripts(*p)) for i, p in enumerate(pages)] + [(1000, None), (1001, ""), (1002, scripts("{broken", "3", "[]"))], "id long, html string")
    found = jsonld.objects(jsonld.blocks(df, "id"), "id").select("id", "block", "place", F.to_json("v").alias("v")).collect()
    got = {}
    for r in sorted(found, key=lambda r: (r.id, r.block, r.place)):
        got.setdefault(r.id, []).append(json.loads(r.v))
    want = {i: [o for b in p for o in walk(json.loads(b))] for i, p in enumerate(pages)}
    assert got == {i: v for i, v in want.items() if v}


def org(**more):
    return {"@type": "Organization"} | more


CASES = [
    [org(name="  A GmbH ", email="INFO@a.com?x", telephone=["+49 30 1234567"], foundingDate="1999-01-01", address={"streetAddress": "S 1", "postalCode": "1", "addressLocality": "B", "addressCountry": "DE"}, sameAs="https://linkedin.com/company/a")],
    [org(legalName="L", address="One line", sameAs=["https://x.com/a", "https://x.com/b", 5], contactPoint={"email": "sales@a.com", "telephone": "030 1234567"})],
    [{"@graph": [{"@type": "WebSite", "name": "no"}, org(name="in graph"), org(name="second", description="d", foundingDate="2999")]}],
    [org(name=["", "b"]), org(name=[["deep"]], address={"addressLocality": "C"}, email="someone.else@a.com")],
    ["broken", {"@type": ["Thing", "LocalBusiness"], "name": "after a broken one", "contactPoint": [None, "x", {"email": ["office@a.com"]}, {"email": "office@a.com"}]}],
    [{"@type": "Person", "name": "none"}],
    [{"x": {"@type": "MedicalBusiness", "name": "nested", "foundingDate": " 1850 "}}],
]


def test_facts_equal_the_tree_s(spark):
    """The same facts as from the tolerant tree, whose walk over these blocks has the same order."""
    rows = [(i, scripts(*("{" if b == "broken" else json.dumps(b) for b in blocks))) for i, blocks in enumerate(CASES)]
    got = {r.id: r for r in jsonld.facts(spark.createDataFrame(rows, "id long, html string"), "id", 2026).collect()}
    for i, markup in rows:
        f = page.Facts("https://a.com/", "home", 2026, False)
        nodes = page.collect_jsonld(page.parse(markup))
        for node in nodes:
            f.structured(node)
        if i not in got:
            assert not any(f.one.values()) and not f.emails
            continue
        r = got[i]
        assert {k: r[k] for k in f.one} == f.one
        assert (r.emails, r.phones, r.socials) == (list(f.emails), list(f.phones), f.socials)
    assert 5 not in got and got[6].founded_year == 1850
    assert jsonld.facts(spark.createDataFrame([], "id long, html string"), "id", 2026).count() == 0


def test_structured_data_runs_without_python(spark):
    df = spark.createDataFrame([(1, "x")], "id long, html string")
    plan = jsonld.organizations(jsonld.objects(jsonld.blocks(df, "id"), "id"), "id")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and plan.count("Scan") == 1


# --- data source -------------------------------------------------------------------------------------------------------

ROWS = [("r1", "a.com", 10, "page", "x"), ("r1", "b.com", 20, "page", None), ("r2", "c.com", 30, "end", "z"), (None, "d.com", None, "end", "n")]


@pytest.fixture
def store(spark, tmp_path):
    spark.dataSource.register(ledger.Ledger)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return str(tmp_path / "ledger")


def put(spark, store, rows, mode="append", parts=2):
    spark.createDataFrame(rows, ledger.LEDGER).repartition(parts).write.format("lead_ledger").option("path", store).mode(mode).save()


def got(spark, store):
    return spark.read.format("lead_ledger").option("path", store).load()


def told(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_ledger_round_trip_and_overwrite(spark, store):
    assert got(spark, store).count() == 0
    put(spark, store, ROWS)
    put(spark, store, ROWS[:1])
    assert told(got(spark, store)) == sorted(ROWS + ROWS[:1], key=repr)
    assert told(got(spark, store).select("kind").distinct()) == [("end",), ("page",)]
    put(spark, store, ROWS[2:], mode="overwrite")
    assert told(got(spark, store)) == sorted(ROWS[2:], key=repr)
    before = len(os.listdir(f"{store}/data"))
    assert ledger.vacuum(store) > 0 and len(os.listdir(f"{store}/data")) < before and told(got(spark, store)) == sorted(ROWS[2:], key=repr)


def test_ledger_filters_reach_the_reader(spark, store, monkeypatch):
    for r in ("r1", "r2", "r3"):
        put(spark, store, [(r, f"{k}.com", k, "page", "p") for k in range(5)], parts=1)
    one = got(spark, store).filter("run_id = 'r2' and t_ms >= 3 and payload = 'p'")
    assert sorted(r.domain for r in one.collect()) == ["3.com", "4.com"]
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "= p)" in plan and "= r2" not in plan and ">= 3" not in plan  # what the reader has done is not done again
    assert one.rdd.getNumPartitions() == 1
    assert got(spark, store).filter("run_id in ('r1', 'r9')").count() == 5 and got(spark, store).filter("t_ms < 1 or t_ms is null").count() == 3
    reader = ledger._Reader(store, got(spark, store).schema)
    rest = list(reader.pushFilters([ledger.EqualTo(("run_id",), "r3"), ledger.LessThan(("t_ms",), 2), ledger.EqualTo(("payload",), "p")]))
    assert [f.attribute for f in rest] == [("payload",)] and len(reader.partitions()) == 1


def test_a_failed_task_leaves_nothing(spark, store):
    put(spark, store, ROWS[:1], parts=1)
    bad = spark.range(4).repartition(4).select(F.lit("r9").alias("run_id"), F.when(F.col("id") == 3, F.raise_error(F.lit("lost"))).otherwise("x.com").alias("domain"), F.col("id").alias("t_ms"), F.lit("k").alias("kind"), F.lit("p").alias("payload"))
    with pytest.raises(Exception, match="lost"):
        bad.write.format("lead_ledger").option("path", store).mode("append").save()
    assert told(got(spark, store)) == ROWS[:1]
    ledger.vacuum(store)
    assert len(os.listdir(f"{store}/data")) == 1


def test_a_replayed_epoch_adds_nothing(spark, store, tmp_path):
    source, where = tmp_path / "in", str(tmp_path / "c")
    source.mkdir()

    def run(checkpoint):
        q = spark.readStream.schema(ledger.LEDGER).json(str(source)).writeStream.format("lead_ledger").option("path", store).option("query", "q1").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        q.awaitTermination(60)
        assert q.exception() is None

    (source / "1.json").write_text(json.dumps({"run_id": "r1", "domain": "a.com", "t_ms": 1, "kind": "page"}))
    run(where)
    assert got(spark, store).count() == 1
    run(str(tmp_path / "lost"))  # the checkpoint is gone, and the first epoch is played again
    assert got(spark, store).count() == 1 and len(os.listdir(f"{store}/data")) == 1
    (source / "2.json").write_text(json.dumps({"run_id": "r2", "domain": "b.com", "t_ms": 2, "kind": "page"}))
    run(where)
    assert sorted(r.run_id for r in got(spark, store).collect()) == ["r1", "r2"]
    writer = ledger._StreamWriter(store, "q1")
    again = writer.write(iter([spark.createDataFrame(ROWS[:1], ledger.LEDGER).toArrow().to_batches()[0]]))
    writer.commit([again, None], 1)
    assert got(spark, store).count() == 2 and len(os.listdir(f"{store}/data")) == 2
