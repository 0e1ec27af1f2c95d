from logweave.streaming import windows as W

SCHEMA = "id long, ts long, source string, level string, event_ref string"


def run(spark, tmp_path, build, name, batches, mode="append"):
    src = tmp_path / name
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(src / f"b{k}"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(src / "*"))
    q = build(stream).writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"{name}-c")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return spark.sql(f"select * from {name}").collect()


def test_windows_sessions_and_runs(spark, tmp_path):
    h = 3_600_000
    one = [(1, 1000, "a", "Erro", "r1"), (2, 1010, "a", "Erro", "r2"), (3, None, "a", None, "r3"), (2, 1010, "a", "Erro", "r2")]
    two = [(4, 5 * h, "a", "Aviso", "r4"), (5, 5 * h + 1, "a", "Erro", "r5"), (6, 9 * h, "b", None, "r6")]
    got = run(spark, tmp_path, lambda s: W.counts(s, "source"), "w_counts", [one, two])
    assert {(r["source"], r["n"], r["errors"]) for r in got} >= {("a", 3, 3)}
    got = run(spark, tmp_path, lambda s: W.sessions(s, "source"), "w_sessions", [one, two])
    assert ("a", 3) in {(r["source"], r["n"]) for r in got}
    assert len(run(spark, tmp_path, W.once, "w_once", [one, two])) == 5
    got = run(spark, tmp_path, lambda s: W.live_runs(s, "source", "level"), "w_runs", [one, two])
    assert ("a", "Erro", 3) in {(r["key"], r["value"], r["n"]) for r in got}
    assert W.undated(spark.createDataFrame(one, SCHEMA)).count() == 1


def test_last_runs_are_given_out_and_state_goes(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    schema = "id long, ts long, source string, level string, code string"
    spark.createDataFrame([(1, 1000, "a", None, "x"), (2, 2000, "a", None, "x"), (3, 3000, "a", None, "y")], schema).coalesce(1).write.mode("append").parquet(str(folder))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    out = W.live_runs(stream, "source", "code", "1 second", 5000).writeStream.format("memory").queryName("last_runs").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").start()
    try:
        out.processAllAvailable()
        for k, ts in ((4, 100_000), (5, 200_000)):
            spark.createDataFrame([(k, ts, "b", None, "z")], schema).coalesce(1).write.mode("append").parquet(str(folder))
            out.processAllAvailable()
        got = {(r["key"], r["value"], r["start"], r["end"], r["n"]) for r in spark.sql("select * from last_runs").collect()}
        assert {("a", "x", 1000, 2000, 2), ("a", "y", 3000, 3000, 1)} <= got
    finally:
        out.stop()


def test_groups_and_late_days(spark, tmp_path):
    schema = "id long, ts long, source string, level string"
    day = 86_400_000
    one = spark.createDataFrame([(1, 5, "a", "Erro"), (2, day + 5, "a", None), (3, 6, "b", None), (9, None, "b", None)], schema)
    two = spark.createDataFrame([(4, 7, "a", "Erro")], schema)  # late: of the first day
    for number, batch in enumerate((one, two, two)):
        W.merge_groups(batch, min(number, 1), str(tmp_path / "g"), ["source"])
        W.recompute_days(batch, min(number, 1), str(tmp_path / "e"), str(tmp_path / "r"), lambda df: df.groupBy("day", "source").count())
    assert {(r["source"], r["n"], r["errors"], r["last"]) for r in W.groups(spark, str(tmp_path / "g"), ["source"]).collect()} == {("a", 3, 2, day + 5), ("b", 2, 0, 6)}
    W.compact_groups(spark, str(tmp_path / "g"), str(tmp_path / "h"), ["source"])
    assert W.groups(spark, str(tmp_path / "h"), ["source"]).count() == 2
    assert {(str(r["day"]), r["source"], r["count"]) for r in spark.read.parquet(str(tmp_path / "r")).collect()} == {("1970-01-01", "a", 2), ("1970-01-01", "b", 1), ("1970-01-02", "a", 1)}
