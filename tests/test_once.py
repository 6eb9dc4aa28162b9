"""What several steps read is written once, so that the steps don't work it out again."""

from turnmill.plans import queries

SF = "/root/testdata/sf0.001"


def test_scores_are_worked_out_once(spark):
    read = queries.QUERIES["t5_review_sample"](spark, SF).inputFiles()
    assert any("/scored-" in f for f in read)


def test_the_nightly_run_scores_once(spark):
    read = queries.QUERIES["k11_rollup_job"](spark, SF).inputFiles()
    assert any("/scored-" in f for f in read) and any("/turns-" in f for f in read)
