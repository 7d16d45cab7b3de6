import pytest
from py4j.protocol import Py4JError
from pyspark.errors import PySparkException

from ledgerloom.sources import landing
from ledgerloom.sources.contracts import contract


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text.encode())
    return str(path)


def test_text_survives(spark, tmp_path):
    path = write(tmp_path / "TSPA.csv", 'SPART,VTEXT\r\n01,España\r\n"",Zoë\r\n,x\r\n\r\n')
    rows = landing.read_extract(spark, "TSPA", path, lineage=False).collect()
    assert [tuple(r) for r in rows] == [("01", "España"), (None, "Zoë"), (None, "x")]


def test_lineage(spark, tmp_path):
    path = write(tmp_path / "TSPA.csv", "SPART,VTEXT\n01,a\n")
    row = landing.read_extract(spark, "TSPA", path).first()
    assert row["_source_file"].endswith("/TSPA.csv") and row["_ingestion_ts"] is not None
    plain = landing.read_extract(spark, "TSPA", path, lineage=False)
    assert plain.columns == ["SPART", "VTEXT"]
    assert landing.read_extract(spark, "tspa", path).columns[:2] == ["SPART", "VTEXT"]


@pytest.mark.parametrize("body", ["01\n", "01,a,b\n"], ids=["short", "long"])
@pytest.mark.parametrize(
    "action",
    [lambda df: df.count(), lambda df: df.select("SPART").collect(), lambda df: df.collect()],
    ids=["count", "one column", "all columns"],
)
def test_misfit_rows_stop_the_load(spark, tmp_path, body, action):
    path = write(tmp_path / "TSPA.csv", "SPART,VTEXT\n" + body)
    with pytest.raises((PySparkException, Py4JError)):
        action(landing.read_extract(spark, "TSPA", path))


@pytest.mark.parametrize("header", ["VTEXT,SPART", "SPART", "SPART,OTHER"])
def test_misfit_headers_stop_the_load(spark, tmp_path, header):
    path = write(tmp_path / "TSPA.csv", f"{header}\n01,a\n")
    with pytest.raises((PySparkException, Py4JError)):
        landing.read_extract(spark, "TSPA", path).collect()


def test_rescue_keeps_the_text_of_misfit_rows(spark, tmp_path):
    path = write(tmp_path / "TSPA.csv", "SPART,VTEXT\n01,a\n02,b,c\n03\n")
    rows = landing.read_extract(spark, "TSPA", path, landing.Misfits.RESCUE, lineage=False).collect()
    assert [tuple(r) for r in rows] == [("01", "a", None), ("02", "b", "02,b,c"), ("03", None, "03")]


@pytest.mark.parametrize("misfits", landing.Misfits)
def test_a_header_in_another_order_stops_the_load(spark, tmp_path, misfits):
    path = write(tmp_path / "TSPA.csv", "VTEXT,SPART\nname one,01\n")
    with pytest.raises((PySparkException, Py4JError)):
        landing.read_extract(spark, "TSPA", path, misfits).collect()


def test_unregistered_sources_are_read_as_text(spark, tmp_path):
    path = write(tmp_path / "EXTRA.csv", "id,when\n007,2024-01-01\n")
    df = landing.read_extract(spark, "EXTRA", path)
    assert df.dtypes[:2] == [("id", "string"), ("when", "string")]
    assert df.first()["id"] == "007"


@pytest.mark.parametrize("second", ["a,b\n1,2,3\n", "b,a\n9,8\n"], ids=["surplus cell", "swapped header"])
def test_unregistered_sources_lose_nothing(spark, tmp_path, second):
    write(tmp_path / "EXTRA.csv" / "part-0.csv", "a,b\n1,2\n")
    write(tmp_path / "EXTRA.csv" / "part-1.csv", second)
    with pytest.raises((PySparkException, Py4JError)):
        landing.read_extract(spark, "EXTRA", str(tmp_path / "EXTRA.csv")).collect()


@pytest.mark.parametrize("text", ["  Div ' A  ", 'a "quoted" one', "two\nlines", "a,b", "back\\slash", "tab\t"])
def test_landed_text_comes_back_as_it_was(spark, tmp_path, text):
    path = landing.land(spark.createDataFrame([("01", text)], contract("TSPA")), "TSPA", str(tmp_path))
    row = landing.read_extract(spark, "TSPA", path, lineage=False, line_breaks=True).first()
    assert tuple(row) == ("01", text)


def test_land_and_read_back(spark, tmp_path):
    rows = [("01", None), (None, "b")]
    df = spark.createDataFrame(rows, contract("TSPA"))
    path = landing.land(df, "TSPA", str(tmp_path))
    assert {tuple(r) for r in landing.read_extract(spark, "TSPA", path, lineage=False).collect()} == set(rows)


def test_landed_files_are_packed_and_bounded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(landing, "FILE_ROWS", 10)
    rows = spark.range(25).selectExpr("cast(id AS string) AS SPART", "concat(' a, ', id) AS VTEXT").coalesce(1)
    path = landing.land(rows, "TSPA", str(tmp_path))
    assert len(list((tmp_path / "TSPA.csv").glob("part-*.csv.gz"))) == 3
    assert sorted(landing.read_extract(spark, "TSPA", path, lineage=False).collect()) == sorted(rows.collect())
