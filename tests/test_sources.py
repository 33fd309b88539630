from pathlib import Path

import pytest
from helpers import plan, rows

from tableprep import run
from tableprep.operators.completeness import MISSING_TOKENS
from tableprep.sources import read_table, stage_table, write_table
from tableprep.sources.tables import shared_folder, staging

TEXTS = [' a "quoted", text ', "two\nlines", "", None, "back\\slash", "plain"]


def test_csv_text_reads_back_the_same(spark, tmp_path):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "k int, s string")
    write_table(df, str(tmp_path / "t"))
    back = read_table(spark, str(tmp_path / "t"), schema=df.schema, multi_line=True)
    expected = [(k, s or None) for k, s in enumerate(TEXTS)]  # empty text is missing
    assert rows(back) == sorted(expected, key=repr)


def test_csv_types_are_inferred(spark, tmp_path):
    (tmp_path / "t.csv").write_text(
        "Customer ID,Amount,Day,City\n1,1.5,2020-01-01,Rome\n2,,2020-01-02,NA\n"
    )
    df = read_table(spark, str(tmp_path / "t.csv"))
    assert [f.dataType.simpleString() for f in df.schema] == ["int", "double", "date", "string"]
    assert df.where("City = 'NA'").count() == 1


def test_missing_tokens_do_not_block_inference(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b,c\n1,NA,null\n2,3.5,True\nN/A,nan,False\n")
    df = read_table(spark, str(tmp_path / "t.csv"), tokens=MISSING_TOKENS)
    assert [f.dataType.simpleString() for f in df.schema] == ["bigint", "double", "boolean"]
    assert rows(df) == [(1, None, None), (2, 3.5, True), (None, None, False)]


def test_formats_and_single_file(spark, tmp_path):
    df = spark.range(100).repartition(4)
    for fmt in ("parquet", "orc", "json"):
        write_table(df, str(tmp_path / fmt), fmt)
        assert rows(read_table(spark, str(tmp_path / fmt), fmt)) == rows(df)
    write_table(df, str(tmp_path / "one"), single_file=True)
    assert len(list((tmp_path / "one").glob("*.csv"))) == 1


def test_staging_keeps_any_header(spark):
    df = spark.createDataFrame([(1, "x")], ["a,b; (c).d", "E"])
    staged = stage_table(df)
    assert staged.columns == df.columns and rows(staged) == [(1, "x")]
    assert any(f"{shared_folder(spark)}/" in f for f in staged.inputFiles())


def test_shared_folder_is_the_one_the_session_names(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")


@pytest.mark.parametrize("out_format", ["csv", "parquet"])
def test_the_whole_job(spark, tmp_path, out_format):
    lines = ["Customer ID,City,Amount ($),Notes"]
    lines += [f"{i % 40},Rome  {i % 2},{i % 7}.5," for i in range(60)]
    lines += ["70,Paris,9999,", "71,,,", ",,,x"]
    (tmp_path / "in.csv").write_text("\n".join(lines) + "\n")
    out = str(tmp_path / "out")
    result = run(
        spark, str(tmp_path / "in.csv"), out, "Customer ID",
        out_format=out_format, order_by=["Amount ($)"],
    )
    cleaned = read_table(spark, f"{out}/cleaned", out_format)
    assert cleaned.columns == ["customer_id", "city", "amount_"]
    assert cleaned.count() == result.cleaned.count() == 40
    assert cleaned.where("city = 'rome 0' and customer_id = 0").count() == 1
    missing = read_table(spark, f"{out}/report/nonconforming_cells", out_format)
    assert rows(missing) == [("Amount ($)", 2), ("City", 2), ("Customer ID", 1), ("Notes", 62)]
    assert read_table(spark, f"{out}/report/correlation_heatmap", out_format).count() == 1
    assert [r["step"] for r in result.timings.collect()][0] == "read"


def test_the_job_without_a_report(spark, tmp_path):
    (tmp_path / "in.csv").write_text("k,v\n1,1\n1,2\n2,3\n")
    run(spark, str(tmp_path / "in.csv"), str(tmp_path / "out"), "k", with_report=False)
    assert read_table(spark, str(tmp_path / "out" / "cleaned")).count() == 2
    assert not (tmp_path / "out" / "report").exists()


def staged_now(spark):
    folder = Path(shared_folder(spark))
    return {p.name for p in folder.iterdir() if p.name.startswith("tableprep-")} if folder.exists() else set()


@pytest.mark.parametrize("out_format", ["csv", "parquet"])
def test_a_job_leaves_nothing_staged(spark, tmp_path, out_format, jobs):
    (tmp_path / "in.csv").write_text("k,v,city\n" + "".join(f"{i % 50},{i % 7}.5,Rome{i % 2}\n" for i in range(200)) + "9,,\n")
    before = staged_now(spark)
    result = run(spark, str(tmp_path / "in.csv"), str(tmp_path / "out"), "k", out_format=out_format, order_by=["v"])
    assert staged_now(spark) == before
    assert result.cleaned.count() == 50
    with jobs() as counted:
        table = result.step_counts
    assert counted.count == 0 and "FileScan" not in plan(table)
    steps = {r["step"]: r["rows"] for r in table.collect()}
    assert steps["initial"] == 201 and steps["drop sparse rows"] == 200 and steps["drop duplicates"] == 50
    assert rows(result.removed) == [(151, 0)]
    assert {r["value"] for r in result.typos.collect()} == {"Rome0", "Rome1"}  # from the input again


def test_a_failing_job_leaves_nothing_staged(spark, tmp_path):
    (tmp_path / "in.csv").write_text("k,v\n1,2\n")
    (tmp_path / "out" / "cleaned").mkdir(parents=True)
    before = staged_now(spark)
    with pytest.raises(Exception, match="already exists"):
        run(spark, str(tmp_path / "in.csv"), str(tmp_path / "out"), "k")
    with pytest.raises(ValueError):
        run(spark, str(tmp_path / "in.csv"), str(tmp_path / "out2"), "missing")
    assert staged_now(spark) == before


def test_scopes_nest_and_delete_their_own(spark):
    before = staged_now(spark)
    with staging(spark) as outer:
        kept = stage_table(spark.range(3))
        with staging(spark) as inner:
            stage_table(spark.range(4))
        assert len(outer) == len(inner) == 1
        assert rows(kept) == [(0,), (1,), (2,)]
    assert staged_now(spark) == before


def test_observed_counts_equal_counted_ones(spark):
    from tableprep import clean

    df = spark.range(500).selectExpr("id % 90 k", "if(id % 7 = 0, null, id) a", "if(id % 7 = 0 or id % 5 = 0, null, sin(id)) b", "if(id % 35 = 0, null, 'x') s")
    result = clean(df, "k", order_by=["a"])
    cleaned, counts = result.observed()
    cleaned.collect()
    assert rows(counts()) == rows(result.step_counts)
    again = result.over(df)
    assert rows(again.cleaned) == rows(cleaned) and rows(again.step_counts) == rows(result.step_counts)
