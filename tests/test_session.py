from ledgerlens import session


def test_partitions_grow_with_the_input_only():
    assert session.shuffle_partitions(0, 8) == 8
    assert session.shuffle_partitions(10 * session.BYTES_PER_PARTITION + 1, 8) == 11
    assert session.shuffle_partitions(100 * 1024**4, 200) == 100 * 1024**4 // session.BYTES_PER_PARTITION


def test_input_bytes_counts_files_and_folders(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.parquet").write_bytes(b"12345")
    (tmp_path / "y.parquet").write_bytes(b"678")
    assert session.input_bytes(spark, str(tmp_path / "a"), str(tmp_path / "y.parquet")) == 8
    assert session.fit_shuffles(spark, str(tmp_path)) == 4


def test_a_large_input_raises_the_initial_partitions_only(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "input_bytes", lambda *_: 100 * session.BYTES_PER_PARTITION)
    initial = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    try:
        assert session.fit_shuffles(spark, str(tmp_path)) == 100
        assert spark.conf.get(initial) == "100" and spark.conf.get("spark.sql.shuffle.partitions") == "4"
    finally:
        spark.conf.unset(initial)


def test_a_task_of_a_report_reads_a_bounded_share_however_large_the_input(spark, tmp_path, monkeypatch):
    before = {key: spark.conf.get(key) for key in (session.ADVISORY, session.SCANNED)}
    try:
        for key in before:
            spark.conf.set(key, "64MB")
        monkeypatch.setattr(session, "input_bytes", lambda *_: 10 * 1024**3)
        session.bound_tasks(spark, str(tmp_path))
        assert session._bytes(spark, session.ADVISORY) == session.BYTES_READ
        assert session._bytes(spark, session.SCANNED) == session.BYTES_SCANNED
        spark.conf.set(session.ADVISORY, "1MB")  # smaller ones stay
        session.bound_tasks(spark, str(tmp_path))
        assert session._bytes(spark, session.ADVISORY) == 1024**2
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def test_reports_start_with_partitions_that_a_task_can_hold():
    assert session.report_partitions(10 * 1024**3, 200) == 10 * 1024**3 // session.BYTES_PER_REPORT_PARTITION
    assert session.report_partitions(0, 200) == 200
    assert session.report_partitions(100 * 1024**4, 200) == session.shuffle_partitions(100 * 1024**4, 200)


def test_the_reports_bound_their_tasks(spark):
    from ledgerlens.plans.reports import warehouse

    warehouse(spark, "/root/testdata/sf0.001")
    assert session._bytes(spark, session.ADVISORY) <= session.BYTES_READ and session._bytes(spark, session.SCANNED) <= session.BYTES_SCANNED
