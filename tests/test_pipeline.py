import pytest
from pyspark.sql import functions as F

from quern.__main__ import main
from quern.contracts import contract
from quern.operators.validate import ViolationError
from quern.operators.verify import outcomes
from quern.plans.pipeline import Pipeline, SelectionError, Stage, clean, expand_selection

SHAPE = contract("t", {"k": "int64", "v": "float64"}, ("k",))


def test_selection():
    families = {"ppl": ["p"], "details": ["c4", "falcon"]}
    assert expand_selection(families, ["falcon"]) == ["c4", "falcon"] and expand_selection(families, ["all", "ppl"]) == ["p", "c4", "falcon"]
    assert expand_selection(families, ["details", "ppl"]) == ["p", "c4", "falcon"] and expand_selection(families, []) == []
    with pytest.raises(SelectionError):
        expand_selection(families, ["nope"])


def test_pipeline_verifies_what_it_wrote(spark, tmp_path):
    def negatives(_, df):
        return outcomes(df.agg(F.count_if(F.col("v") < 0).alias("negative")), ["negative"])

    build = lambda low: lambda s: s.range(5).select(F.col("id").alias("k"), (F.col("id") + low).cast("double").alias("v"))
    pipeline = Pipeline(spark, str(tmp_path), [Stage("good", SHAPE, build(0), [negatives]), Stage("bad", SHAPE, build(-1), [negatives])])
    assert pipeline.run(["good"]) == {"good": 5}
    with pytest.raises(ViolationError, match="negative: 1"):
        pipeline.run()
    assert spark.read.parquet(f"{tmp_path}/good").count() == 5


def test_cleanup_guards(tmp_path):
    (tmp_path / "root" / "a").mkdir(parents=True)
    (tmp_path / "outside").mkdir()
    (tmp_path / "root" / "link").symlink_to(tmp_path / "outside")
    assert [p.name for p in clean(tmp_path / "root", ["a", "gone"])] == ["a"] and (tmp_path / "root" / "a").exists()
    for name in ("../outside", "link", "link/x"):
        with pytest.raises(ValueError):
            clean(tmp_path / "root", [name], dry_run=False)
    clean(tmp_path / "root", ["a"], dry_run=False)
    assert not (tmp_path / "root" / "a").exists() and (tmp_path / "outside").exists()


def test_command_line(tmp_path, capsys):
    assert main(["list"]) == 0 and "p1_found" in capsys.readouterr().out
    assert main(["run", "nope", "--data", "x"]) == 2
    (tmp_path / "x").write_text("")
    assert main(["clean", str(tmp_path), "x"]) == 0 and "would delete" in capsys.readouterr().out
