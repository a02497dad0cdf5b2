import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from leadweave.operators import skew, suppression
from leadweave.operators.suppression import run_counters, suppress_repeats

FLAGS = ["known_stored", "card_has_site", "card_stored", "readable", "place_stored", "site_open", "is_lead", "post_stored"]


def sequential(listings, limit):
    """The rule as a plain loop: the model the parallel rounds must equal."""
    accepted, opened, got, out = set(), set(), {}, {}
    for x in sorted(listings, key=lambda x: x["rank"]):
        if x["position"] > limit or got.get(x["run_id"], 0) >= x["target"]:
            out[x["listing_id"]] = "untouched"
            continue
        hit = lambda prints: bool(accepted & set(prints))
        if x["known_stored"] or opened & set(x["keys"]):
            result = "skipped"
        elif not x["card_has_site"]:
            result = "no_website:card"
        elif x["card_stored"] or hit(x["card"]):
            result = "duplicate:card"
        elif not x["readable"]:
            result = "unreadable"
        else:
            opened |= set(x["keys"])
            if x["place_stored"] or hit(x["place"]):
                result = "duplicate:place"
            elif not x["site_open"]:
                result = "no_website:place"
            elif not x["is_lead"]:
                result = "not_lead"
            elif x["post_stored"] or hit(x["post"]):
                result = "duplicate:post"
            else:
                result = "lead"
                accepted |= set(x["post"])
                got[x["run_id"]] = got.get(x["run_id"], 0) + 1
        out[x["listing_id"]] = result
    return out


def listings_of(seed, hot):
    rng = random.Random(seed)
    rows = []
    for i in range(90):
        pick = lambda n: sorted({f"numero:{0 if rng.random() < hot else rng.randrange(60)}" for _ in range(n)})
        card, extra, late = pick(rng.randrange(2)), pick(rng.randrange(2)), pick(rng.randrange(3))
        rows.append({
            "listing_id": 1000 + i, "rank": i, "run_id": i // 30, "position": i % 30 + 1, "target": 6, "keys": [f"k{rng.randrange(80)}", f"u{rng.randrange(80)}"],
            "card": card, "place": card + extra, "post": sorted(set(card + extra + late)), "known_stored": rng.random() < .05, "card_has_site": rng.random() < .9, "card_stored": rng.random() < .04,
            "readable": rng.random() < .95, "place_stored": rng.random() < .04, "site_open": rng.random() < .9, "is_lead": rng.random() < .9, "post_stored": rng.random() < .04})
    return rows


def frames(spark, rows):
    listings = spark.createDataFrame([[r[c] for c in ("listing_id", "rank", "run_id", "position", "target", *FLAGS)] for r in rows],
                                     "listing_id long, rank long, run_id long, position int, target int, " + ", ".join(f + " boolean" for f in FLAGS))
    checks = spark.createDataFrame([(r["listing_id"], s, *p.split(":"), n) for r in rows for s in ("card", "place", "post") for n, p in enumerate(r[s])] or [(0, "card", "x", "x", 0)],
                                   "listing_id long, stage string, kind string, value string, print_order int")
    keys = spark.createDataFrame([(r["listing_id"], k) for r in rows for k in r["keys"]], "listing_id long, value string")
    return listings, checks, keys


@pytest.mark.parametrize(("seed", "hot"), [(1, 0.0), (2, 0.4)])
def test_rounds_equal_the_sequential_rule(spark, seed, hot):
    rows = listings_of(seed, hot)
    out = suppress_repeats(*frames(spark, rows), max_listings=25).cache()
    got = {r["listing_id"]: r["outcome"] + (f":{r['stage']}" if r["stage"] else "") for r in out.collect()}
    assert got == sequential(rows, 25)
    assert sum(r["leads"] for r in run_counters(out).collect()) == sum(v == "lead" for v in got.values())
    for r in out.filter("repeat_of IS NOT NULL").collect():
        assert got[r["repeat_of"]] == "lead"


def test_rounds_of_a_chain_read_less_and_less(spark, monkeypatch):
    """Each listing shares a print with the one before, so the chain is decided link by link."""
    rows = [{"listing_id": i, "rank": i, "run_id": 0, "position": i + 1, "target": 99, "keys": [f"k{i}"], "card": [], "place": [], "post": [f"numero:{i}", f"numero:{i + 1}"], "known_stored": False,
             "card_has_site": True, "card_stored": False, "readable": True, "place_stored": False, "site_open": True, "is_lead": True, "post_stored": False} for i in range(12)]
    asked = []
    plain = suppression.hot_safe_lookup
    monkeypatch.setattr(suppression, "hot_safe_lookup", lambda r, *a: asked.append(r.count()) or plain(r, *a))
    out = suppress_repeats(*frames(spark, rows), max_listings=25)
    assert {r["listing_id"]: r["outcome"] for r in out.collect()} == {i: "lead" if i % 2 == 0 else "duplicate" for i in range(12)}
    assert len(asked) >= 6 and asked == [*sorted(asked[:-1], reverse=True), asked[-1]] and asked[-2] * 2 <= asked[0]


def test_hot_keys_are_looked_up_where_they_are(spark, monkeypatch):
    monkeypatch.setattr(skew, "MIN_HOT_ROWS", 50)
    rows = spark.range(900).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), "id")
    lookup = spark.range(0, 900, 2).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    plain = sorted(map(tuple, rows.join(lookup, "k", "left").collect()), key=str)
    assert sorted(map(tuple, skew.hot_safe_lookup(rows, lookup, ["k"], "left").select("k", "id", "v").collect()), key=str) == plain


@pytest.fixture(scope="module")
def searched(spark, tmp_path_factory):
    """A hundred businesses and a few search results: a result of position 1 in an earlier, the same and a later run."""
    folder = str(tmp_path_factory.mktemp("searched"))
    spark.range(100).selectExpr("id AS c_custkey", "'N' || id AS c_name", "0 AS c_nationkey", "1.0D AS c_acctbal", "'X' AS c_mktsegment").write.parquet(f"{folder}/customer.parquet")
    spark.sql("SELECT 0 AS n_nationkey, 'CHILE' AS n_name, 0 AS n_regionkey").write.parquet(f"{folder}/nation.parquet")
    lines = [(0, 44, 1), (1, 52, 1), (2, 59, 7), (1, 87, 3), (1, 84, None), (None, 92, 1), (5, 44, 1)]  # search, business, line
    spark.createDataFrame([(s, 0, b, n) for s, b, n in lines], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int").write.parquet(f"{folder}/lineitem.parquet")
    return folder


@pytest.mark.parametrize(("name", "column"), [("J9_backfill_prints", "id"), ("D5_known_places", "listing_id")])
def test_known_by_every_earlier_run(spark, searched, name, column):
    con = duckdb.connect()
    for table in ("customer", "nation", "lineitem"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{searched}/{table}.parquet/*.parquet'")
    sql = con.execute(entry.oracle_sql()[name])
    got = entry.queries()[name](spark, searched).select(*[c[0] for c in sql.description])
    assert sorted(map(tuple, got.collect())) == sorted(sql.fetchall())
    ids = {r[column] for r in got.select(column).collect()}
    assert not ids & {44, 84, 87}  # an earlier run had them, at any position
    assert {52, 59, 92} <= ids
