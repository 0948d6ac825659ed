"""Intermediate tables live below the checkpoint folder and can be dropped per application."""

from __future__ import annotations

import os

from ripplegraph.session import checkpoint_root, exists, materialize, scratch_path


def test_materialized_tables_stay_under_the_checkpoint_folder(spark):
    df = materialize(spark.range(10), "demo")
    path = df.inputFiles()[0].removeprefix("file://")
    assert path.startswith(f"{checkpoint_root(spark)}/ripplegraph/{spark.sparkContext.applicationId}/demo-")
    assert exists(spark, os.path.dirname(path)) and df.count() == 10
    assert scratch_path(spark, "x") != scratch_path(spark, "x")


def test_importing_the_catalogue_needs_no_session():
    import subprocess
    import sys
    from pathlib import Path

    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q) and len(q) > 150"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).resolve().parent.parent, timeout=120)
