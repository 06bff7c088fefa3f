"""Tables that are changed by key, and the pushes that rest on them."""

import random

import pytest
from pyspark.sql import functions as F

from groundwell.session import scratch_dir
from groundwell.sources.bucketed import BucketTable, table_at
from groundwell.streaming import ingest
from groundwell.streaming.tables import write_batch


def rows(df):
    return sorted(map(tuple, df.collect()))


def frame(spark, listed):
    return spark.createDataFrame(listed, "k long, v string")


def test_changes_equal_a_plain_table(spark):
    rng = random.Random(5)
    table = BucketTable.create(frame(spark, [(k, f"0-{n}") for k in range(50) for n in range(k % 3)]), scratch_dir(spark, "t"), ["k"], 8)
    plain = {k: [f"0-{n}" for n in range(k % 3)] for k in range(50)}
    for step in range(1, 5):
        new = {rng.randrange(70): [f"{step}-{n}" for n in range(rng.randrange(1, 4))] for _ in range(6)}
        table = table.replace(frame(spark, [(k, v) for k, vs in new.items() for v in vs]))
        plain |= new
        gone = [rng.randrange(70) for _ in range(4)]
        table = table.delete(frame(spark, [(k, "") for k in gone]))
        for k in gone:
            plain.pop(k, None)
        assert rows(table.read()) == sorted((k, v) for k, vs in plain.items() for v in vs)
        table.clean(1)
        assert rows(BucketTable(spark, table.path).read()) == rows(table.read())


def test_untouched_buckets_keep_their_files(spark):
    before = BucketTable.create(frame(spark, [(k, "a") for k in range(100)]), scratch_dir(spark, "t"), ["k"], 16)
    files = set(before.read().inputFiles())
    new = frame(spark, [(3, "b"), (3, "c")])
    touched = before.touched(new)
    after = before.replace(new)
    assert len(touched) == 1 and {b for b in after.folders if after.folders[b] != before.folders.get(b)} == set(touched)
    kept = {f for f in files if f"_bucket={touched[0]}/" not in f}
    assert kept == files & set(after.read().inputFiles()) and len(kept) < len(files)
    # A reader that began before still sees what it saw.
    assert rows(before.read()) == sorted((k, "a") for k in range(100))


def test_a_failed_run_changes_nothing(spark):
    table = BucketTable.create(frame(spark, [(k, "a") for k in range(9)]), scratch_dir(spark, "t"), ["k"], 4)
    broken = lambda old, new: old.unionByName(new).withColumn("v", F.raise_error(F.lit("stop")).cast("string"))
    with pytest.raises(Exception, match="stop"):
        table.update(frame(spark, [(1, "b")]), broken)
    assert BucketTable(spark, table.path).version == table.version
    assert rows(BucketTable(spark, table.path).read()) == [(k, "a") for k in range(9)]


def test_of_two_changes_at_once_one_fails(spark):
    one = BucketTable.create(frame(spark, [(k, "a") for k in range(9)]), scratch_dir(spark, "t"), ["k"], 4)
    two = BucketTable(spark, one.path)
    one.replace(frame(spark, [(1, "b")]))
    with pytest.raises(Exception, match="exist"):
        two.replace(frame(spark, [(2, "c")]))
    assert dict(rows(BucketTable(spark, one.path).read()))[1] == "b"


def test_empty_tables_and_null_keys(spark):
    table = BucketTable.create(frame(spark, []), scratch_dir(spark, "t"), ["k"], 4)
    assert table.read().collect() == [] and table.replace(frame(spark, [])).read().collect() == []
    assert rows(BucketTable(spark, table.path).replace(frame(spark, [(None, "x"), (1, "y")])).read().fillna(0)) == [(0, "x"), (1, "y")]
    assert table_at(spark, scratch_dir(spark, "none")) is None


def test_a_batch_reads_its_own_buckets_only(spark):
    path = scratch_dir(spark, "pushes")
    batch = lambda ks: frame(spark, [(k, "x") for k in ks])
    BucketTable.create(batch(range(200)).select("k").withColumn("batch", F.lit(0)), f"{path}/keys", ["k"], 32)
    table = BucketTable(spark, f"{path}/keys")
    new = batch([5, 5000])
    known = ingest.known_keys(new, f"{path}/keys", ["k"], 1)
    allowed = {f"_bucket={b}/" for b in table.touched(new)}
    assert known.inputFiles() and all(any(a in f for a in allowed) for f in known.inputFiles())
    assert (5,) in rows(known) and known.count() < 60
    # The batch that brought a key does not find it when it is run again.
    assert rows(ingest.known_keys(new, f"{path}/keys", ["k"], 0)) == []


def test_pushes_in_many_batches(spark):
    path = scratch_dir(spark, "pushes")
    for n, ks in enumerate(([1, 2, 2, 3], [3, 4, None], [1, 9, None])):
        write_batch(frame(spark, [(k, f"{n}") for k in ks]), f"{path}/in", n)
        stream = spark.readStream.schema("k long, v string").option("recursiveFileLookup", "true").parquet(f"{path}/in")
        ingest.run_idempotent(stream, f"{path}/out", ["k"], 4)
    got = spark.read.parquet(f"{path}/out/rows/batch=*").select("k").collect()
    assert sorted(r["k"] for r in got if r["k"] is not None) == [1, 2, 3, 4, 9]


def test_versions_that_come_late_or_twice_or_empty(spark):
    """The table holds the chunks of the last version of every source, whatever the order of arrival."""
    path = scratch_dir(spark, "reindex")
    schema = "workspace_id string, source_type string, source_id long, version int, text string"
    chunk = lambda df: df.select(*ingest.SOURCE, "version", F.explode(F.split("text", " ")).alias("content")).where("content <> ''")
    steps = [[(1, 0, "a b"), (2, 5, "x y"), (3, 0, "k")], [(1, 1, "c"), (2, 4, "old"), (3, 1, "")], [(1, 1, "c"), (4, 0, "n n"), (4, 0, "n n")]]
    want = [{(1, "a"), (1, "b"), (2, "x"), (2, "y"), (3, "k")}, {(1, "c"), (2, "x"), (2, "y")}, {(1, "c"), (2, "x"), (2, "y"), (4, "n")}]
    for n, (step, rows_) in enumerate(zip(steps, want)):
        write_batch(spark.createDataFrame([(f"w{i % 2}", "document", i, v, t) for i, v, t in step], schema), f"{path}/in", n)
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{path}/in")
        ingest.run_reindex(stream, f"{path}/out", chunk, buckets=4)
        got = [(r["source_id"], r["content"]) for r in ingest.current_chunks(spark, f"{path}/out").collect()]
        assert set(got) == rows_ and len(got) == len(rows_) + (n == 2)
    assert ingest.feed_end(spark, f"{path}/out") == 2 and ingest.consumed(spark, f"{path}/out", "c") == -1
    ingest.mark_consumed(spark, f"{path}/out", "c", 1)
    assert ingest.consumed(spark, f"{path}/out", "c") == 1
    assert {r[0] for r in ingest.stale_workspaces(spark, f"{path}/out", 1, 2).collect()} == {"w1", "w0"}
