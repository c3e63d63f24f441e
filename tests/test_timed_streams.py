"""Silent jobs and first copies: the same rows however files come, and as plain loops say."""

import datetime as dt

import pytest

from tidepost.streaming import operators, timed
from tidepost.streaming.intake import landed, run_to_table

START = dt.datetime(2024, 1, 1)
MINUTES = [("a", m) for m in (0, 0, 1, 5, 9)] + [("b", m) for m in range(10)] + [("c", 2)] + [(None, 4)] + [("a", 40), ("b", 60), ("c", 41)]


def write_parts(spark, folder, rows, kind, n):
    for k in range(n):
        part = rows[k * len(rows) // n : (k + 1) * len(rows) // n]
        spark.createDataFrame(part, kind).coalesce(1).write.parquet(f"{folder}/part{k}")


def plain_silences(rows, give_up):
    """(job, loop, new_rows, stalled) by walking over every minute."""
    last = max(m for _, m in rows)
    out = set()
    for job in {j for j, _ in rows}:
        own = [m for j, m in rows if j == job]
        silent = None
        for m in range(min(own), last):  # the minute of the last row is not over
            n = own.count(m)
            if n:
                out.add((job, m, n, silent or 0))
                silent = 0
            else:
                silent += 1
                if silent <= give_up:
                    out.add((job, m, 0, silent))
    return out


@pytest.mark.parametrize("files", [1, 8])
def test_silences(spark, tmp_path, files):
    rows = sorted(MINUTES, key=lambda r: r[1])
    kind = "job string, ts timestamp"
    write_parts(spark, tmp_path / "in", [(j, START + dt.timedelta(minutes=m, seconds=7)) for j, m in rows], kind, files)
    stream = landed(spark, f"{tmp_path}/in/part*", spark.createDataFrame([], kind).schema, files_per_trigger=1)
    with timed.timers(spark):
        found = run_to_table(timed.silences(operators.loop_counts(stream, "job", "ts", 60), 60, give_up=5), f"{tmp_path}/out", f"{tmp_path}/state")
    base = int(START.replace(tzinfo=dt.timezone.utc).timestamp())
    got = [(r.job, (r.loop - base) // 60, r.new_rows, r.stalled) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == plain_silences(rows, 5)


def test_a_silent_job_is_reported_before_its_next_row(spark, tmp_path):
    kind = "job string, ts timestamp"
    schema = spark.createDataFrame([], kind).schema
    seen = []
    for i, part in enumerate([[("a", 0), ("b", 1)], [("b", 6)], [("b", 7)]]):
        write_parts(spark, tmp_path / f"in/run{i}", [(j, START + dt.timedelta(minutes=m)) for j, m in part], kind, 1)
        loops = operators.loop_counts(landed(spark, f"{tmp_path}/in/run*/part*", schema), "job", "ts", 60)
        with timed.timers(spark):
            rows = run_to_table(timed.silences(loops, 60), f"{tmp_path}/out", f"{tmp_path}/state")
        seen.append(rows.where("job = 'a' AND new_rows = 0").count())
    assert seen == [0, 5, 6]


@pytest.mark.parametrize("files", [1, 6])
def test_first_copies_equal_the_batch_form(spark, tmp_path, files):
    rows = [(i, f"text {i % 5}" if i % 7 else None, START + dt.timedelta(minutes=i // 2)) for i in range(120)]
    rows += [(500, "text 0", None), (501, "", START)]
    mixed = [r for k in range(12) for r in sorted(rows[k * 10 : k * 10 + 10], key=lambda r: -r[0])] + rows[120:]
    kind = "id long, text string, ts timestamp"
    write_parts(spark, tmp_path / "in", mixed[-2:] + mixed[:-2], kind, files)
    late = spark.createDataFrame([(999, "end", START + dt.timedelta(days=1))], kind)
    late.write.parquet(f"{tmp_path}/in/partz")
    stream = landed(spark, f"{tmp_path}/in/part*", late.schema, files_per_trigger=1)
    found = run_to_table(operators.first_copies(stream, "ts", "20 minutes", "30 minutes", "id"), f"{tmp_path}/out", f"{tmp_path}/state")
    batch = operators.first_copies(spark.read.schema(late.schema).parquet(f"{tmp_path}/in/part*"), "ts", "20 minutes", "30 minutes", "id")
    wanted = {}
    for i, text, ts in rows:
        if text is not None and ts is not None:
            wanted.setdefault((ts.replace(minute=ts.minute // 30 * 30), text), (i, text, ts))
    assert sorted(tuple(r) for r in found.collect()) == sorted(wanted.values())
    assert sorted(tuple(r) for r in batch.where("id <> 999").collect()) == sorted(wanted.values())
