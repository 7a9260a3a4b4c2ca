from falloff.streaming.ingest import watch_gauge_csv
from test_sources import CSVS


def test_new_files_are_read_once(spark, tmp_path):
    root, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    (tmp_path / "in" / "deep").mkdir(parents=True)
    for name in ("mdy", "reverse"):
        (tmp_path / "in" / "deep" / f"{name}.csv").write_text(CSVS[name][0])
    watch_gauge_csv(spark, root, out, state).awaitTermination(120)
    (tmp_path / "in" / "elapsed.csv").write_text(CSVS["elapsed"][0])
    watch_gauge_csv(spark, root, out, state).awaitTermination(120)
    got = {}
    for r in spark.read.parquet(out).orderBy("idx").collect():
        got.setdefault(r["test_id"].rsplit("/", 1)[-1], []).append(r["t_s"])
    assert got == {f"{n}.csv": CSVS[n][1] for n in ("mdy", "reverse", "elapsed")}
