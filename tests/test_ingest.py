import pytest

from tidemark.functions import convert
from tidemark.sources import facts, raw


@pytest.mark.parametrize("line", ["1,20200131,10,2.5", "1,20200131,10,2.5\r", "1,20200131,10,2.5,extra", "+1,20200131,10,inf", "1,20200131,4294967295,NaN"])
def test_good_lines(spark, tmp_path, line):
    (tmp_path / "f").write_text(line + "\n")
    (r,) = facts.read_facts_csv(spark, str(tmp_path / "f")).collect()
    assert (r.asset_id, r.date) == (1, 20200131)


@pytest.mark.parametrize("line", ["1,20200131,4294967296,1", "-1,20200131,1,1", " 1,20200131,1,1", "x,20200131,1,1", "1,20200131,10", "1,,10,1", "", '"1",20200131,10,1', "1,20200131,10,1f"])
def test_bad_lines(spark, tmp_path, line):
    (tmp_path / "f").write_text("1,20200131,10,2.5\n" + line + "\n")
    with pytest.raises(facts.FactError):
        facts.read_facts_csv(spark, str(tmp_path / "f"))
    assert facts.read_facts_csv(spark, str(tmp_path / "f"), strict=False).count() == 1
    assert facts.rejected_lines(spark, str(tmp_path / "f")).count() == 1


@pytest.mark.parametrize(
    "text, date, epoch",
    [
        ("2020-10-01", 20201001, 1601510400),
        ("2020-10-01T01:00:00+02:00", 20201001, 1601506800),
        ("2020-10-01 16:00:00.5", 20201001, 1601568000),
        ("2020-10-01T16:00:01.5", 20201001, 1601568002),
        ("2020-10-01T16:00:00+02:00", 20201001, 1601560800),
        ("2020-1-5", None, None),
        ("2020", None, None),
        ("2020-02-30", None, None),
        ("", None, None),
        (None, None, None),
    ],
)
def test_iso(spark, text, date, epoch):
    df = spark.createDataFrame([(text,)], "t string")
    r = df.select(convert.date_or_null(df.t).alias("d"), convert.epoch_or_null(df.t).alias("e")).collect()[0]
    assert (r.d, r.e) == (date, epoch)


def test_normalize(spark, tmp_path):
    (tmp_path / "r").write_text("2020-10-02,b,x,2020-10-01T00:00:01,2020-10-01\n2020-10-01,a,y,2020-10-01,2020-10-01\n")
    df = raw.read_raw_csv(spark, str(tmp_path / "r"), 5)
    out = raw.normalize_and_sort(df, [0], [3, 4]).collect()
    assert [(r.c0, r.c1, r.c3) for r in out] == [(20201001, "a", 1601510400), (20201002, "b", 1601510401)]
    with pytest.raises(ValueError):
        raw.normalize_raw(df)
    with pytest.raises(raw.ConversionError):
        raw.normalize_raw(df, [1])
    assert raw.rejected(df, [1]).collect()[0].bad_columns == [2]
