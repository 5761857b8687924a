"""Structured Streaming forms vs their batch twins / plain loops."""

import os
import random
import time

from pyspark.sql import functions as F

from helpers import end, start
from sheaf.functions.memlog import parse_memlog
from sheaf.operators import leaks
from sheaf.sources.text import read_log_lines
from sheaf.streaming.folds import memory_spikes, monitor_emissions, stream_memlog, stream_orphans


def write_files(d, chunks):
    os.makedirs(d, exist_ok=True)
    for i, lines in enumerate(chunks):
        with open(f"{d}/part{i:03d}.log", "w") as f:
            f.write("\n".join(lines) + "\n")
        os.utime(f"{d}/part{i:03d}.log", (time.time() + i, time.time() + i))


def run(df, name, ckpt):
    q = (df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", ckpt)
         .trigger(availableNow=True).start())
    q.awaitTermination(300)
    return df.sparkSession.sql(f"select * from {name}")


def ts(sec):
    return f"2024-01-01 {sec // 3600:02d}:{sec % 3600 // 60:02d}:{sec % 60:02d}"


def test_stream_parse_equals_batch(spark, tmpdir_path):
    lines = [start(ts(i), f"j{i % 3}") if i % 2 else end(ts(i), f"j{i % 3}") for i in range(50)] + ["noise"]
    write_files(f"{tmpdir_path}/in", [lines[:25], lines[25:]])
    full = run(stream_memlog(spark, f"{tmpdir_path}/in"), "t1", f"{tmpdir_path}/ck")
    # Line numbers are exact file positions (distinct, in file order).
    for log in {r.log_id for r in full.select("log_id").collect()}:
        got = [r.ts for r in full.where(F.col("log_id") == log).orderBy("line_no").collect()]
        nos = [r.line_no for r in full.where(F.col("log_id") == log).collect()]
        assert len(set(nos)) == len(nos) and got == sorted(got)
    s = full.select("job_name", "ts", "log_type", "rss_mb", "rss_after")
    b = parse_memlog(read_log_lines(spark, f"{tmpdir_path}/in")).select("job_name", "ts", "log_type", "rss_mb", "rss_after")
    assert sorted(map(tuple, s.collect())) == sorted(map(tuple, b.collect()))


def test_stream_orphans_vs_batch(spark, tmpdir_path):
    rnd = random.Random(5)
    lines, sec = [], 0
    for i in range(120):
        sec += rnd.randint(1, 20)
        job = f"j{rnd.randint(0, 3)}"
        lines.append(start(ts(sec), job))
        if rnd.random() < 0.7:  # most runs end quickly, well inside max_age
            lines.append(end(ts(sec + rnd.randint(0, 5)), job))
    lines.sort(key=lambda l: l[1:20])
    far = [start(ts(80000), "zz"), start(ts(80001), "zz")]
    write_files(f"{tmpdir_path}/in", [lines, far[:1], far[1:]])
    src = (spark.readStream.option("maxFilesPerTrigger", 1).text(f"{tmpdir_path}/in", wholetext=True)
           .select(F.lit("s").alias("log_id"), F.lit(0).cast("long").alias("block"),
                   F.posexplode(F.split("value", "\n")).alias("line_no", "line")))
    e = parse_memlog(src.select("log_id", "block", F.col("line_no").cast("long"), "line"))
    got = run(stream_orphans(e, max_age_s=60), "t6", f"{tmpdir_path}/ck")
    got = {(r.job_name, str(r.start_time)) for r in got.collect() if r.job_name != "zz"}
    bl = [(i, l) for i, l in enumerate(lines)]
    b = parse_memlog(spark.createDataFrame([("s", 0, i, l) for i, l in bl], "log_id string, block long, line_no long, line string"))
    want = {(r.job_name, str(r.start_time)) for r in leaks.orphaned_jobs(b).collect()}
    # Runs end within 5 s, far below the 60 s max age, so stale == orphaned here.
    assert got == want and len(want) > 10


def samples_df(spark, rows):
    return spark.createDataFrame(rows, "run_id long, seq long, epoch_s long, rss_mb double")


def loop_monitor(rows, interval):
    out, peak, last = [], None, 0.0
    for run, seq, t, rss in rows:
        if peak is None:
            peak = rss
            continue
        newp = rss > peak
        if newp:
            peak = rss
        if newp or t - last >= interval:
            out.append(seq)
            last = t
    return out


def loop_spikes(rows, step):
    out, last = [], 0.0
    for run, seq, t, rss in rows:
        if rss > last + step:
            out.append(seq)
            last = rss
    return out


def test_monitor_and_spikes_vs_loop(spark, tmpdir_path):
    rnd = random.Random(9)
    rows, t = [], 1_700_000_000
    for i in range(300):
        t += rnd.randint(1, 12)
        rows.append((1, i, t, float(rnd.randint(100, 900))))
    sentinel = [(1, 10_000, t + 10_000, 0.0), (1, 10_001, t + 10_001, 0.0)]
    d = f"{tmpdir_path}/s"
    samples_df(spark, rows).coalesce(1).write.parquet(f"{d}/a")
    samples_df(spark, sentinel[:1]).coalesce(1).write.parquet(f"{d}/b")
    samples_df(spark, sentinel[1:]).coalesce(1).write.parquet(f"{d}/c")
    schema = "run_id long, seq long, epoch_s long, rss_mb double"
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(d)
    mon = run(monitor_emissions(src, log_interval_s=30), "t2", f"{tmpdir_path}/ck2")
    got = sorted(r.seq for r in mon.collect() if r.seq < 10_000)
    assert got == loop_monitor(rows, 30)
    src2 = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(d)
    sp = run(memory_spikes(src2), "t3", f"{tmpdir_path}/ck3")
    assert sorted(r.seq for r in sp.collect() if r.seq < 10_000) == loop_spikes(rows, 100.0)


def test_monitor_batch_matches_loop(spark):
    from sheaf.operators.timers import monitor_emissions_batch
    rnd = random.Random(21)
    rows = []
    for run in range(4):
        t = 1_700_000_000 + run * 977
        for i in range(400):
            t += rnd.choice([1, 1, 2, 5, 13, 40])
            rows.append((run, run * 10_000 + i, t, float(rnd.randint(100, 400) + (i if run == 3 else 0))))
    df = samples_df(spark, rows)
    got = {}
    for r in monitor_emissions_batch(df, log_interval_s=30, chunk_seconds=120).collect():
        got.setdefault(r.run_id, []).append(r.seq)
    for run in range(4):
        want = loop_monitor([x for x in rows if x[0] == run], 30)
        assert sorted(got.get(run, [])) == want, run


def test_spikes_batch_matches_loop(spark):
    from sheaf.operators.timers import memory_spikes_batch
    rnd = random.Random(33)
    rows = []
    for run in range(5):
        t = 1_700_000_000
        for i in range(500):
            t += rnd.choice([1, 3, 20, 90])
            base = i * 2.0 if run % 2 else 0.0  # leaking runs climb steadily
            rows.append((run, run * 10_000 + i, t, base + rnd.randint(0, 300)))
    got = {}
    for r in memory_spikes_batch(samples_df(spark, rows), bucket_seconds=300, chunk_mb=200).collect():
        got.setdefault(r.run_id, []).append(r.seq)
    for run in range(5):
        assert sorted(got.get(run, [])) == loop_spikes([x for x in rows if x[0] == run], 100.0), run


def test_split_file_streams_in_order(spark, tmpdir_path):
    """A file larger than a split is read by several tasks; (block, line_no) is still its order."""
    from sheaf.sources.text import stream_log_lines
    want = [f"line {i:06d} {'x' * (i % 23)}" for i in range(6000)]
    write_files(f"{tmpdir_path}/in", [want, want[:10]])
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "32768")
    try:
        run(stream_log_lines(spark, f"{tmpdir_path}/in", block_lines=500), "t1s", f"{tmpdir_path}/ck").createOrReplaceTempView("t1s_rows")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    rows = spark.sql("select * from t1s_rows order by log_id, block, line_no").collect()
    assert [r.line for r in rows] == want + want[:10]
    assert len({(r.log_id, r.block) for r in rows}) > 6


def rows_of_state(query):
    return query.lastProgress["stateOperators"][0]["numRowsTotal"]


def start_query(df, name, ckpt, mode="append"):
    q = (df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", ckpt)
         .trigger(availableNow=True).start())
    q.awaitTermination(300)
    return q


def test_orphan_state_ends_and_late_ends_change_nothing(spark, tmpdir_path):
    """Files are batches: the state falls to 0 once jobs are idle; an END after its START was reported, one after the state
    is gone, and lines behind the watermark neither revive nor retract anything."""
    from helpers import monitor
    d = f"{tmpdir_path}/in"
    write_files(d, [
        [start(ts(0), "a"), start(ts(2), "b"), end(ts(4), "b"), start(ts(5), "c")],
        [monitor(ts(80), "m")], [monitor(ts(81), "m")],               # a and c have been open for 60 s: reported
        [end(ts(90), "a"), end(ts(30), "c"), monitor(ts(110), "m")],  # a's END is too late to matter, c's is behind the watermark
        [monitor(ts(2000), "m")], [end(ts(2001), "a"), monitor(ts(5000), "m")], [monitor(ts(9000), "m")], [monitor(ts(9001), "m")]])
    src = (spark.readStream.option("maxFilesPerTrigger", 1).text(d, wholetext=True).select(
        F.lit("s").alias("log_id"), F.lit(0).cast("long").alias("block"), F.posexplode(F.split("value", "\n")).alias("line_no", "line")))
    e = parse_memlog(src.select("log_id", "block", F.col("line_no").cast("long"), "line"))
    q = start_query(stream_orphans(e, max_age_s=60, grace="10 minutes", late_rows=True), "t6e", f"{tmpdir_path}/ck")
    got = spark.sql("select * from t6e").collect()
    assert sorted((r.job_name, str(r.start_time)[-8:]) for r in got if not r.late) == [("a", "00:00:00"), ("c", "00:00:05")]
    assert [(r.job_name, '"END"' in r.late_row) for r in got if r.late] == [("c", True)]
    assert rows_of_state(q) == 0


def test_sample_folds_end_with_their_runs(spark, tmpdir_path):
    rows = [(run, i, 1_700_000_000 + i, float(100 + 50 * i)) for run in ("x", "y") for i in range(20)]
    schema = "run_id string, seq long, epoch_s long, rss_mb double"
    for i, part in enumerate((rows, [("z", 0, 1_700_010_000, None)], [("z", 1, 1_700_900_000, None)], [("z", 2, 1_700_900_001, None)])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmpdir_path}/s/{i}")
    for name, fold, want in (("t2e", monitor_emissions, 38), ("t3e", memory_spikes, 14)):
        src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmpdir_path}/s")
        q = start_query(fold(src, idle_ms=3_600_000), name, f"{tmpdir_path}/ck-{name}")
        assert spark.sql(f"select * from {name}").count() == want and rows_of_state(q) == 0


def test_task_status_stream_equals_batch_and_forgets(spark, tmpdir_path):
    import datetime as dt

    from sheaf.operators.tasks import latest_status
    from sheaf.streaming.folds import task_status_stream
    rnd = random.Random(4)
    t0 = dt.datetime(2024, 1, 1)
    rows = [(rnd.randrange(40), t0 + dt.timedelta(seconds=rnd.randrange(600)), i, rnd.choice(["started", "pending", "started", "success", "failure"]),
             rnd.random()) for i in range(300)]
    schema = "task_id long, event_ts timestamp_ntz, seq long, task_status string, progress double"
    parts = [rows[k::3] for k in range(3)]
    for i, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmpdir_path}/ev/{i}")
    for i, day in enumerate((10, 20, 30)):
        spark.createDataFrame([(-1, t0 + dt.timedelta(days=day), 0, "success", 1.0)], schema).coalesce(1).write.parquet(f"{tmpdir_path}/ev/x{i}")
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmpdir_path}/ev")
    q = start_query(task_status_stream(src, watermark="20 minutes"), "t8", f"{tmpdir_path}/ck", "update")
    got = {}
    for r in spark.sql("select * from t8").collect():  # a row per change, the last one holds
        got[r.task_id] = (r.task_status, r.progress)
    want = {r.task_id: (r.task_status, r.progress) for r in latest_status(spark.createDataFrame(rows, schema)).collect()}
    assert {k: v for k, v in got.items() if k >= 0} == want
    assert rows_of_state(q) <= 1  # the last marker's own task


def test_many_final_rows_are_folded_in_slices(tmpdir_path, monkeypatch):
    """What one batch makes final reaches a step in bounded slices, in order, equal times together, and as packed columns it
    takes far less than as JSON; pairs across slices are found as in one piece."""
    import json

    import pandas as pd

    from sheaf.streaming import folds, ordered
    rnd = random.Random(3)
    rows = [(rnd.randrange(2000) * 1000, f"file:/logs/{rnd.choice('ab')}", i, rnd.choice(["START", "END"]), rnd.choice([None, 1.5, 2.0]))
            for i in range(6000)]
    pdf = pd.DataFrame(rows, columns=["ts", "log_id", "line_no", "log_type", "rss_mb"]).assign(
        vms_mb=None, memory_percent=2.0, system_available_mb=3.0)
    kinds = {c: ordered._KINDS[t] for c, t in zip(pdf.columns, ["bigint", "string", "bigint", "string", *["double"] * 4])}
    raw = ordered._packed(ordered._joined([ordered._table(pdf[:2500], kinds), ordered._table(pdf[2500:], kinds)]))
    assert len(raw) * 10 < len(json.dumps(pdf.to_dict("records")))
    found = {}
    for size in (10_000, 50):
        monkeypatch.setattr(ordered, "SLICE_ROWS", size)
        step, st, out, seen, longest = folds._orphan_step(0.1), {}, [], [], 0
        for part, more in ordered._slices(ordered.pa.ipc.open_stream(raw).read_all(), "ts", ["log_id", "line_no"]):
            st, got = step(st, part, 1_999_900, more)
            out += got
            seen += [(r.ts, r.log_id, r.line_no) for r in part.itertuples()]
            longest = max(longest, len(part))
        assert seen == sorted(r[:3] for r in rows) and longest <= size + 40
        found[size] = (sorted(out, key=lambda r: r["start_ms"]), json.dumps(st))
    assert found[10_000] == found[50] and len(found[50][0]) > 100
