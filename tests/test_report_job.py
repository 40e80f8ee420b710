import tempfile

import pytest

from opinio.operators import report, report_job
from opinio.sources import published as pb
from opinio.sources.sinks import write_summary_csv

SCHEMA = "parent_asin string, clean_text string, rating double, credibility_score double, pos long"


@pytest.fixture()
def path():
    return tempfile.mkdtemp(prefix="opinio-report-")


def corpus(spark):
    rows = [(p, f"This is a good thing number {i}. It was bad to use the battery of {p}!", 1.0 + i % 5, 0.5, i * 100 + k)
            for k, p in enumerate(["a", "b", "c", "d", "e", "few", None]) for i in range(2 if p == "few" else 4)]
    return spark.createDataFrame(rows, SCHEMA)


def rows_of(df):
    return sorted((tuple(r) for r in df.select(sorted(df.columns)).collect()), key=repr)


def test_a_stopped_run_resumes_to_the_same_table(spark, path):
    whole = rows_of(report.credibility_report(corpus(spark), min_reviews=3))
    first = report_job.run_credibility_report(corpus(spark), path, batches=4, stop_after=1, min_reviews=3)
    had = rows_of(first)
    assert 0 < len(had) < len(whole) and set(had) < set(whole)
    versions = spark.read.parquet(f"{path}/versions").count()
    assert rows_of(report_job.run_credibility_report(corpus(spark), path, batches=4, min_reviews=3)) == whole
    # nothing is left: no batch runs and nothing is published
    now = spark.read.parquet(f"{path}/versions").count()
    assert now > versions
    assert rows_of(report_job.run_credibility_report(corpus(spark), path, batches=4, min_reviews=3)) == whole
    assert spark.read.parquet(f"{path}/versions").count() == now


def test_a_lost_batch_leaves_whole_batches(spark, path, monkeypatch):
    calls = []
    real = report_job.credibility_report

    def fails_second(*args, **kw):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("lost")
        return real(*args, **kw)

    monkeypatch.setattr(report_job, "credibility_report", fails_second)
    with pytest.raises(RuntimeError):
        report_job.run_credibility_report(corpus(spark), path, batches=4, min_reviews=3)
    whole = rows_of(report.credibility_report(corpus(spark), min_reviews=3))
    assert set(rows_of(pb.published(spark, path))) < set(whole)
    assert rows_of(report_job.run_credibility_report(corpus(spark), path, batches=4, min_reviews=3)) == whole


def test_a_written_csv_counts_as_done(spark, path):
    whole = report.credibility_report(corpus(spark), min_reviews=3)
    csv = whole.where("parent_asin in ('a', 'b')").withColumn("summary", report.F.lit("kept from the file"))
    write_summary_csv(csv, f"{path}/csv")
    out = {r.parent_asin: r.summary for r in report_job.run_credibility_report(
        corpus(spark), f"{path}/t", checkpoint_csv=f"{path}/csv", min_reviews=3).collect()}
    assert out["a"] == out["b"] == "kept from the file" and out["c"].startswith("This is") and len(out) == 6
