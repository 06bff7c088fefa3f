"""Lines of files that grow while they are read."""

import io
import random

import pyarrow as pa
import pytest

from groundwell.session import scratch_dir
from groundwell.streaming import appended, usage
from groundwell.streaming.tables import run_available, write_batch


def local(path):
    return path.removeprefix("file:").replace("//", "/", 1) if path.startswith("file:") else path


@pytest.mark.parametrize("look", [3, 1 << 16])
def test_ranges_give_every_line_once(monkeypatch, look):
    monkeypatch.setattr(appended, "LOOK", look)
    rng = random.Random(1)
    for _ in range(200):
        data = b"".join(rng.choice([b"", b"a", b"longer line", b"\xff"]) + b"\n" for _ in range(rng.randrange(12))) + rng.choice([b"", b"rest"])
        file = pa.PythonFile(io.BytesIO(data), "r")
        upto = appended.line_end(file, len(data), 0)
        assert upto == data.rfind(b"\n") + 1
        cuts = [0, *sorted(rng.randrange(upto + 1) for _ in range(3)), upto]
        found = []
        for a, b in zip(cuts[:-1], cuts[1:]):
            starts = a == 0 or data[a - 1 : a] == b"\n"
            if b > a:
                if starts:
                    file.seek(a)
                found += list(appended.lines(file, a, b, starts))
        assert [x for _, x in found] == data[:upto].splitlines(keepends=True)
        assert all(data[at : at + len(x)] == x for at, x in found)


def test_appended_lines_come_once(spark):
    root = scratch_dir(spark, "logs")
    folder = local(f"{root}/in")
    import os

    os.makedirs(f"{folder}/sub")
    seen = []
    steps = [
        {"a.jsonl": b"1\n2\n3", "sub/b.jsonl": b""},
        {"a.jsonl": b"1\n2\n33\n", "sub/b.jsonl": b"x\ny", "other.txt": b"no\n"},
        {"a.jsonl": b"1\n2\n33\n", "sub/b.jsonl": b"x\ny\r\nz\n", "c.jsonl": b"\n\xff\n"},
        {},
        {"a.jsonl": b"7\n"},
    ]
    want = [["1", "2"], ["33", "x"], ["", "y", "z", "�"], [], ["7"]]
    for n, (files, lines) in enumerate(zip(steps, want)):
        for name, data in files.items():
            with open(f"{folder}/{name}", "wb") as f:
                f.write(data)
        stream = appended.read_appended(spark, f"{root}/in", size=2)
        got = []
        run_available(stream, f"{root}/checkpoint", lambda df, i: got.extend(r["value"] for r in df.collect()))
        assert sorted(got) == sorted(lines), n
        seen += got
    assert len(seen) == sum(map(len, want))


def test_broken_events_are_skipped(spark):
    root = scratch_dir(spark, "logs")
    import os

    os.makedirs(local(f"{root}/in"))
    with open(local(f"{root}/in/e.jsonl"), "w") as f:
        f.write('{"workspace_id": "w", "embedding_tokens": 2}\nnot json\n\n{"workspace_id": "v", "embedding_tokens": 3}\n')
    stream = usage.read_growing_events(spark, f"{root}/in", "workspace_id string, embedding_tokens double")
    run_available(stream, f"{root}/checkpoint", lambda df, i: write_batch(df, f"{root}/out", i))
    assert sorted(map(tuple, spark.read.parquet(f"{root}/out/batch=*").collect())) == [("v", 3.0), ("w", 2.0)]
