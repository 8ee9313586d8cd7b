"""The report dataset: a version is there as a whole or not at all."""

import pytest
from pyspark.sql import functions as F

from keepwell.plans.batch import Stages
from keepwell.plans.report import read_report, report_tables, report_versions, write_report

from sf_dirs import SF_SMALL


def test_versions_are_whole_or_absent(spark, tmp_path):
    folder = str(tmp_path / "reports")
    tables = report_tables(Stages(spark, SF_SMALL))
    first = write_report(tables, folder)
    assert {n: t.count() for n, t in read_report(spark, folder).items()} == {n: t.count() for n, t in tables.items()}
    # A table that fails in the middle leaves no report; readers stay with the version before.
    broken = dict(tables) | {"importance": tables["importance"].withColumn("x", F.raise_error(F.lit("lost")).cast("int"))}
    with pytest.raises(Exception, match="lost"):
        write_report(broken, folder, "half")
    assert [r.version for r in report_versions(spark, folder).collect()] == [first]
    with pytest.raises(LookupError):
        read_report(spark, folder, "half")
    second = write_report({"kpis": tables["kpis"]}, folder)
    assert set(read_report(spark, folder)) == {"kpis"} and set(read_report(spark, folder, first)) == set(tables)
    with pytest.raises(Exception, match="already exists"):
        write_report(tables, folder, second)
