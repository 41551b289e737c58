"""File inventories: long files block by block, gzip members, stores."""

import gzip
import hashlib
import random

import pytest

from tidemark.sources import export, files


@pytest.mark.parametrize("whole", [0, 100, 1 << 30])
def test_inventory_of_any_length(spark, tmp_path, whole):
    rng = random.Random(1)
    parts = [rng.randbytes(n) for n in (0, 1, 99, 100, 101, 300_000)]
    content = {f"a/{n}.bin": p for n, p in enumerate(parts)}
    content |= {"two.gz": gzip.compress(parts[5], mtime=0) + gzip.compress(parts[2], mtime=0), "late.gz": gzip.compress(b"x", mtime=5)}
    content |= {"cut.gz": content["two.gz"][:-3], "tail.gz": content["two.gz"] + b"rest", "none.gz": b""}
    raw = {"two.gz": 300_099, "late.gz": 1, "cut.gz": -1, "tail.gz": -1, "none.gz": 0}
    frame = spark.createDataFrame([(p, bytearray(c)) for p, c in content.items()], "path string, content binary").repartition(3)
    assert export.write_files(frame, str(tmp_path)) == len(content)
    got = {r.path: r for r in files.file_inventory(spark, str(tmp_path), raw_sizes=True, whole_bytes=whole).collect()}
    assert set(got) == set(content)
    for path, c in content.items():
        assert (got[path].size, got[path].sha256, got[path].raw_bytes) == (len(c), hashlib.sha256(c).hexdigest(), raw.get(path, len(c))), path
    assert got["two.gz"].gzip_time_zero and not got["late.gz"].gzip_time_zero


def test_unpacking_holds_one_step(spark):
    data = gzip.compress(bytes(30_000_000), mtime=0)
    for step in (1, 7, len(data)):
        out = files.Unpacked(1 << 16)
        for at in range(0, len(data), step):
            out.add(data[at : at + step])
        assert out.total() == 30_000_000
