"""Files listed by tasks: nothing of them passes the driver, whatever their number."""

import gzip
import hashlib
import json

from tidemark.sources import captures, files


def spread(root, contents):
    for name, content in contents.items():
        place = root / name
        place.parent.mkdir(parents=True, exist_ok=True)
        place.write_bytes(content)


def test_inventory_lists_in_tasks(spark, tmp_path):
    whole = {f"a {n % 3}/b/{n}.bin": bytes([n]) * n for n in range(40)} | {"top%41.bin": b"top"}
    hidden = {"_skip/x.bin": b"1", ".skip.bin": b"2", "a 0/_skip.bin": b"3"}
    spread(tmp_path / "in", whole | hidden)
    frame = files.file_inventory(spark, f"{tmp_path}/in/", raw_sizes=True)
    assert frame.inputFiles() == []
    got = {r.path: (r.size, r.sha256) for r in frame.collect()}
    assert got == {p: (len(c), hashlib.sha256(c).hexdigest()) for p, c in whole.items()}
    assert {r.path for r in files.file_inventory(spark, f"file://{tmp_path}/in/a%200").collect()} == {p[4:] for p in whole if p.startswith("a 0/")}
    assert "top%41.bin" in {r.path for r in files.file_inventory(spark, f"file://{tmp_path}/in").collect()}


def test_captures_in_folders_list_in_tasks(spark, tmp_path):
    docs = {f"{n % 4}/{n}.json.gz": gzip.compress(json.dumps({"ack_ns": [n, n + 1], "n": n}).encode()) for n in range(200)}
    spread(tmp_path, docs | {"0/empty.json": b""})
    frame = captures.read_capture_rows(spark, str(tmp_path))
    assert frame.inputFiles() == []
    got = {(r.file, r.path, r["index"]): int(r.value) for r in frame.collect()}
    assert got == {(str(n), p, i): v for n in range(200) for p, i, v in (("ack_ns", 0, n), ("ack_ns", 1, n + 1), ("n", None, n))}
