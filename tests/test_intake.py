"""Generations of tables with a commit pointer, and intake that is killed and replayed."""

import pytest
from pyspark.sql import functions as F

from leadweave.streaming import intake
from leadweave.streaming.snapshots import SnapshotStore


@pytest.fixture
def store(spark, tmp_path):
    return SnapshotStore(spark, str(tmp_path / "store"), {"log": "k long", "state": "k long, v string"}, {"state": ["k"]}, most_folders=3)


def test_newest_row_of_a_key_and_bounded_folders(spark, store):
    assert store.read("state").collect() == [] and store.commits() == []
    for number in range(8):
        store.commit(number, {"log": spark.createDataFrame([(number,)], "k long"), "state": spark.createDataFrame([(number % 2, f"v{number}"), (100 + number, "x")], "k long, v string")})
        assert max(len(f) for f in store.folders().values()) <= 3
    assert sorted(r["k"] for r in store.read("log").collect()) == list(range(8))
    assert {r["k"]: r["v"] for r in store.read("state").filter("k < 2").collect()} == {0: "v6", 1: "v7"}
    assert {r["k"]: r["v"] for r in store.read("state", before=4).filter("k < 2").collect()} == {0: "v2", 1: "v3"}
    store.commit(8, {"log": spark.createDataFrame([], "k long")})  # a commit may leave tables as they are
    assert store.read("state").count() == 10
    store.expire(keep=2)
    assert store.commits() == [7, 8] and store.read("state").count() == 10 and store.read("log", before=8).count() == 8


def test_a_commit_is_all_or_nothing_and_can_be_done_again(spark, store, monkeypatch):
    one, two = (spark.createDataFrame([(k, "a")], "k long, v string") for k in (1, 2))
    store.commit(0, {"state": one})
    with monkeypatch.context() as broken:
        broken.setattr(SnapshotStore, "_publish", lambda *a: (_ for _ in ()).throw(OSError("killed")))
        with pytest.raises(OSError):
            store.commit(1, {"state": two})
    assert [r["k"] for r in store.read("state").collect()] == [1]
    for _ in range(2):
        store.commit(1, {"state": two})
        assert sorted(r["k"] for r in store.read("state").collect()) == [1, 2]


def feed(spark, rows):
    flags = "card_has_site boolean, readable boolean, site_open boolean, is_lead boolean"
    listings = spark.createDataFrame([(i, run, p, i, True, True, True, lead, f"p{place}", f"https://www.google.com/maps/place/p{place}", f"N{i}") for i, run, p, place, lead, _ in rows],
                                     f"listing_id long, run_id long, position int, rank long, {flags}, place_id string, google_maps_url string, business_name string")
    checks = spark.createDataFrame([(i, stage, "numero", number, 0) for i, *_, number in rows for stage in ("card", "place", "post")], "listing_id long, stage string, kind string, value string, print_order int")
    keys = spark.createDataFrame([(r[0], f"p{r[3]}") for r in rows], "listing_id long, value string")
    return listings, lambda batch: tuple(t.join(batch.select("listing_id"), "listing_id", "left_semi") for t in (checks, keys))


ROWS = [(1, 1, 1, 10, True, "111"), (2, 1, 2, 11, False, "222"), (3, 1, 3, 10, True, "333"), (4, 2, 1, 12, True, "111"), (5, 2, 2, 11, True, "444"), (6, 2, 3, 13, True, "555"), (7, 2, 4, 14, True, "666")]
WANTED = {1: "lead", 2: "not_lead", 3: "skipped", 4: "duplicate", 5: "skipped", 6: "lead", 7: "untouched"}


def state(store):
    return {name: sorted(map(tuple, store.read(name).collect()), key=str) for name in intake.TABLES}


def test_replayed_batches_leave_the_same_state(spark, tmp_path, monkeypatch):
    listings, expand = feed(spark, ROWS)
    now = F.to_timestamp(F.lit("2024-02-01 00:00:00"))
    parts = [listings.filter("listing_id <= 4"), listings.filter("listing_id >= 4")]
    plain, tried = intake.intake_store(spark, str(tmp_path / "a")), intake.intake_store(spark, str(tmp_path / "b"))
    for number, part in enumerate(parts):
        intake.decide_batch(plain, part, number, 2 - number, expand, now)
        with monkeypatch.context() as broken:  # killed after its tables are written, before they count
            broken.setattr(SnapshotStore, "_publish", lambda *a: (_ for _ in ()).throw(OSError("killed")))
            with pytest.raises(OSError):
                intake.decide_batch(tried, part, number, 2 - number, expand, now)
        for _ in range(1 + number):
            intake.decide_batch(tried, part, number, 2 - number, expand, now)
    assert state(plain) == state(tried)
    assert {r["listing_id"]: r["outcome"] for r in plain.read("outcomes").collect()} == WANTED
    names = {r["id"]: r["business_name"] for r in plain.read("businesses").collect()}
    assert sorted(names.values()) == ["N1", "N2", "N6"]
    assert {(r["search_id"], names[r["business_id"]], r["position"]) for r in plain.read("links").collect()} == {(1, "N1", 1), (1, "N2", 2), (2, "N6", 3)}
    assert {(names[r["business_id"]], r["value"]) for r in plain.read("prints").collect()} == {("N1", "111"), ("N6", "555")}


def test_batches_read_a_bounded_number_of_folders(spark, tmp_path):
    store = intake.intake_store(spark, str(tmp_path / "c"), most_folders=3)
    listings, expand = feed(spark, ROWS)
    for number in range(4):
        intake.decide_batch(store, listings.filter(F.col("listing_id") == number + 1), number, 5, expand, F.to_timestamp(F.lit("2024-02-01 00:00:00")))
        assert max(len(f) for f in store.folders().values()) <= 3
    assert store.read("outcomes").count() == 4
