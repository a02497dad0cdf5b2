import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from leadweave.operators import contact_import, identity
from leadweave.plans.inputs import TABLES
from leadweave.sources import exports, scans

FOLDER = "/root/testdata/sf0.001"


def test_contact_lines(spark):
    lines = ["﻿ana\t+56 9 5555 1234\tVenta cerrada\t1:20 pm\tlunes", "sin numero\thola", "beto  955551235  9:10", "texto 9 5555 1236 fin", "x\t12345"]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "line_no long, line string")
    rows = [(r["ok"], r["name"], r["phone_e164"], r["status"], r["contacted_on"]) for r in contact_import.parse_contact_lines(frame).orderBy("line_no").collect()]
    assert rows == [(True, "ana", "+56955551234", "venta cerrada", "1:20 pm, lunes"), (False, None, None, None, None), (True, "beto", "+56955551235", None, "9:10"),
                    (True, "texto", "+56955551236", "fin", None), (False, None, None, None, None)]


def test_upsert_keeps_what_was_not_supplied(spark):
    ddl = "id long, place_id string, google_maps_url string, business_name string, city string, field_sources map<string,string>, first_seen_at timestamp, updated_at timestamp"
    stored = spark.createDataFrame([(1, "place_id:ChIaaaaaaaaaaaa", "https://www.google.com/maps/place/a", "A", "Lota", {"city": "maps"}, None, None)], ddl)
    batch = spark.createDataFrame([(1, "https://www.google.com/maps/place/a/@-1.2,3.4,17z?hl=es", None, "A2", None, {"business_name": "web"}),
                                   (2, "https://www.google.com/maps/place/b?cid=77", None, "B", "Arica", {}), (3, "https://www.google.com/maps/place/b?cid=77&hl=x", None, None, "Iquique", {"city": "maps"})],
                                  "arrival int, google_maps_url string, place_id string, business_name string, city string, field_sources map<string,string>")
    out = {r["id"]: r for r in identity.upsert_businesses(stored, batch, F.current_timestamp()).collect()}
    assert (out[1]["business_name"], out[1]["city"], out[1]["field_sources"], out[1]["created"]) == ("A2", "Lota", {"city": "maps", "business_name": "web"}, False)
    assert (out[2]["business_name"], out[2]["city"], out[2]["place_id"], out[2]["created"]) == ("B", "Iquique", "cid:77", True) and len(out) == 2


def test_unknown_columns_are_refused(spark):
    with pytest.raises(ValueError):
        identity.update_columns(spark.range(2), spark.range(2).withColumn("nope", F.lit(1)))


def test_log_files(spark, tmp_path):
    (tmp_path / "app-2026-01-02.log").write_text("2026-01-02 10:00:00 | INFO    | uno\n2026-01-02 10:00:01 | ERROR   | dos | tres\ntraza\n")
    (tmp_path / "app-otro.log").write_text("2026-01-01 10:00:00 | INFO    | viejo\n")
    logs = scans.read_logs(spark, str(tmp_path))
    shown = scans.last_log_lines(logs, F.lit("2026-01-02").cast("date"), 2).select("message").collect()
    assert [r[0] for r in shown] == ["traza", "dos | tres"]
    assert scans.kept_logs(logs, F.lit("2026-03-15").cast("date")).select("message").collect()[0][0] == "viejo"


def test_csv_file_has_mark_and_separator(spark, tmp_path):
    leads = entry.queries()["P19_lead_rows"]  # the export needs the full row, taken from the mart itself
    assert callable(leads)
    from leadweave.plans.inputs import Inputs
    from leadweave.plans.mart_queries import all_leads
    exports.write_leads_csv(all_leads(Inputs(spark, FOLDER)), str(tmp_path / "csv"))
    text = next((tmp_path / "csv").glob("part-*")).read_text(encoding="utf-8")
    assert text.startswith("﻿Negocio;Rubro;Ciudad;WhatsApp;")


@pytest.mark.parametrize("name", ["P19_lead_rows", "F3_link_kind", "J6_find_duplicates", "R2_A8_contact_decision", "X7_W16_link_facts", "R9_R22_W17_review_findings", "U5_upsert_contacted"])
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    frame = entry.queries()[name](spark, FOLDER)
    columns = sorted(frame.columns)
    cursor = con.execute(entry.oracle_sql()[name])
    order = [[c[0] for c in cursor.description].index(c) for c in columns]
    assert sorted(repr([r[c] for c in columns]) for r in frame.collect()) == sorted(repr([r[i] for i in order]) for r in cursor.fetchall())


def test_scans_of_few_splits_are_dealt_out_and_others_left(spark, tmp_path):
    rows = spark.range(1000).selectExpr("id", "id % 7 AS kind", "concat('text ', id) AS text")
    rows.coalesce(1).write.parquet(str(tmp_path / "one"))
    rows.repartition(16).write.parquet(str(tmp_path / "many"))
    one, many = (spark.read.parquet(str(tmp_path / name)) for name in ("one", "many"))
    slots = spark.sparkContext.defaultParallelism
    dealt = scans.spread(one)
    sizes = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
    assert dealt.rdd.getNumPartitions() == slots == len(sizes) and max(sizes) < 2 * 1000 / slots
    assert sorted(dealt.collect()) == sorted(one.collect())
    assert scans.spread(many.repartition(2 * slots)).rdd.getNumPartitions() == 2 * slots
    # Filters and columns still reach the files.
    plan = dealt.filter("kind = 3").select("id")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(kind,3)" in plan and "ReadSchema: struct<id:bigint,kind:bigint>" in plan
    empty = scans.spread(one.filter("id < 0"))
    assert empty.count() == 0 and empty.columns == one.columns
