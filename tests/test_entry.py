"""The driver's contract, the command line, and the repository without its llm folder."""

import json
import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__
from placewright import cli

ROOT = Path(__file__).parent.parent


def test_names_match():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry(spark):
    rows = __spark_entry__.entry(spark).collect()
    assert rows and set(rows[0].asDict()) == {"district", "total", "prospects", "rate"}


def test_without_llm(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "spark-warehouse", ".pytest_cache"))
    shutil.rmtree(copy / "placewright" / "llm", ignore_errors=True)
    shutil.rmtree(copy / "tests" / "llm", ignore_errors=True)
    (copy / "corpus_pipeline.py").unlink(missing_ok=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'leads_rank' in q and 'pipeline' not in q and not [x for x in q if x.startswith('op')]; e.oracle_sql()"
    done = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr


def test_no_import_of_llm_elsewhere():
    for path in (ROOT / "placewright").rglob("*.py"):
        if "llm" not in path.parts:
            assert "placewright.llm" not in path.read_text()


def test_command_line(spark, tmp_path):
    from tests.test_operators import ROWS  # noqa: F401
    from placewright.operators import corpus, rank

    cols = "id string, name_primary string, name_ar string, category string, lon double, lat double, phone string, website string, address_freeform string, confidence double, source_count int, opening_hours string"
    rank.recompute(corpus.conform(spark.createDataFrame(ROWS, cols))).withColumn("district", __import__("pyspark.sql.functions", fromlist=["lit"]).lit("D")).write.parquet(str(tmp_path / "places"))
    out = cli.main(["leads", "olaya", "--db", str(tmp_path), "--csv", str(tmp_path / "x.csv")], spark)
    assert out.count() >= 2 and (tmp_path / "x.csv").exists()
    assert cli.main(["districts", "--db", str(tmp_path), "--rank"], spark).first()["total"] == 7
    pages = {"term_no": 0, "page": 0, "local_results": [{"place_id": "g1", "title": "New", "gps_coordinates": {"latitude": 24.7, "longitude": 46.7}}]}
    (tmp_path / "p.json").write_text(json.dumps(pages))
    assert cli.main(["sweep", "--db", str(tmp_path), "--pages", str(tmp_path / "p.json"), "--district", "D"], spark).first()["places"] == 1
    assert spark.read.parquet(str(tmp_path / "places_next")).count() == 8
