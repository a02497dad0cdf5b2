"""Captured files as data sources, in batch and as a stream."""

import json

import pytest
from pyspark.sql import functions as F

from leadweave.sources import plugins


@pytest.fixture
def source(spark):
    plugins.register_sources(spark)
    return spark


def put(folder, name, lines):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join(line + "\n" for line in lines), encoding="utf-8")
    return path


def card(position, **more):
    return json.dumps({"position": position, "name": f"Ñ{position}", "url": "u", "card_seen": True} | more, ensure_ascii=False)


@pytest.mark.parametrize("most", [40, 64, 10**6])
def test_every_line_once_at_any_partition_size(source, tmp_path, most):
    for run in range(3):
        put(tmp_path, f"run_id={run}/a.json", [card(k) for k in range(5)] + ["", "no json", "[1]"])
    put(tmp_path, "run_id=0/_hidden.json", [card(99)])
    put(tmp_path, "run_id=0/empty.json", [])
    rows = source.read.format("captured_cards").option("partition_bytes", most).load(str(tmp_path)).collect()
    assert sorted((r["run_id"], r["position"], r["name"]) for r in rows if r["capture_error"] is None) == [(r, k, f"Ñ{k}") for r in range(3) for k in range(5)]
    assert sorted(r["capture_error"] for r in rows if r["capture_error"]) == ["[1]"] * 3 + ["no json"] * 3


def test_filters_on_keys_choose_files(source, tmp_path):
    for run in range(4):
        put(tmp_path, f"run_id={run}/a.json", [card(run)])
    cards = source.read.format("captured_cards").option("partition_bytes", 1 << 20).load(str(tmp_path))
    assert [r["position"] for r in cards.filter("run_id = 2").collect()] == [2]
    assert sorted(r["position"] for r in cards.filter(F.col("run_id").isin(1, 3)).collect()) == [1, 3]
    assert cards.filter("run_id = 9").count() == 0 and cards.filter("run_id = 1 AND run_id = 2").count() == 0
    reader = plugins.LineReader(plugins.CapturedCards({"path": str(tmp_path)}), cards.schema)
    list(reader.pushFilters([plugins.EqualTo(("run_id",), 2)]))
    assert [piece[0].split("/")[-2] for p in reader.partitions() for piece in p.pieces] == ["run_id=2"]


def test_values_that_do_not_fit_are_null(source, tmp_path):
    put(tmp_path, "run_id=1/a.json", [card("7"), card(2**40), card(1.5, card_seen="yes"), json.dumps({"name": {"a": 1}, "other": 1})])
    rows = source.read.format("captured_cards").load(str(tmp_path)).collect()
    assert [(r["position"], r["card_seen"], r["name"]) for r in rows] == [(7, True, "Ñ7"), (None, True, f"Ñ{2**40}"), (None, None, "Ñ1.5"), (None, None, '{"a": 1}')]
    empty = tmp_path / "none"
    empty.mkdir()
    assert source.read.format("captured_cards").load(str(empty)).count() == 0


def test_catalogs_and_judgments(source, tmp_path):
    put(tmp_path, "c/country=CL/a.json", [json.dumps({"regiones": {"R": ["Ñuñoa", "Lo Prado", 3], "S": None}, "ambiguas": ["Lo Prado", None]}), "{}", "x"])
    names = plugins.catalog_names(source.read.format("region_catalogs").load(str(tmp_path / "c")))
    assert sorted(map(tuple, names.collect())) == [("Lo Prado", "Lo Prado", True), ("Ñuñoa", "Nunoa", False)]
    put(tmp_path, "j/provider=m/a.json", [json.dumps({"site_id": 5, "stop_reason": "end_turn", "response": {"parametros": []}})])
    assert [tuple(r)[:4] for r in source.read.format("captured_judgments").load(str(tmp_path / "j")).collect()] == [(5, "m", "end_turn", '{"parametros": []}')]


def test_stream_reads_each_file_once(source, tmp_path):
    folder, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")

    def run():
        cards = source.readStream.format("captured_cards").load(str(folder)).select("run_id", "position")
        cards.writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out).awaitTermination()
        return sorted(map(tuple, source.read.parquet(out).collect()))

    put(folder, "run_id=1/a.json", [card(1), card(2)])
    assert run() == [(1, 1), (1, 2)]
    put(folder, "run_id=0/b.json", [card(3)])  # sorts before the first file, comes after it
    assert run() == [(0, 3), (1, 1), (1, 2)]
    assert run() == [(0, 3), (1, 1), (1, 2)]
