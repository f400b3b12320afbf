"""How shard files are listed."""

import gzip
import json

from duelframe.sources import json_arrays, readers


def test_files_are_listed_by_one_reader(spark, tmp_path, monkeypatch):
    (tmp_path / "responses_0_1.json").write_text(json.dumps(["é", 'a "b"\n', "", "\U0001f600"]), encoding="utf-8")
    loads = []
    reader = type(spark.read)
    for name in ("load", "text"):
        monkeypatch.setattr(reader, name, lambda self, *a, f=getattr(reader, name), **b: loads.append(a) or f(self, *a, **b))
    found = readers.scan_response_shards(spark, str(tmp_path))
    assert [tuple(r) for r in found.orderBy("pos").collect()] == [(0, 1, 0, "é"), (0, 1, 1, 'a "b"\n'), (0, 1, 2, ""), (0, 1, 3, "\U0001f600")]
    assert len(loads) == 1


def test_packed_files_are_still_read(spark, tmp_path):
    for sample, name in ((0, "part-0.txt"), (1, "part-0.txt.gz")):
        folder = tmp_path / "shard=2" / f"sample_id={sample}"
        folder.mkdir(parents=True)
        data = json.dumps([f"{sample}{i}" for i in range(3)]).encode()
        (folder / name).write_bytes(gzip.compress(data) if name.endswith("gz") else data)
    found = readers.scan_response_shards(spark, str(tmp_path), partitioned=True)
    assert sorted(map(tuple, found.collect())) == [(2, j, i, f"{j}{i}") for j in range(2) for i in range(3)]


def test_short_ranges_share_tasks(spark, tmp_path):
    responses = [f'{i} "ü" [,] \\ {"x" * (i % 300)}' for i in range(3000)]
    (tmp_path / "responses_0_0.json").write_text(json.dumps(responses), encoding="utf-8")
    found = readers.scan_response_shards(spark, str(tmp_path), range_bytes=1000)
    assert found.rdd.getNumPartitions() < 100  # of some 500 ranges
    assert [tuple(r) for r in found.orderBy("pos").collect()] == [(0, 0, i, text) for i, text in enumerate(responses)]


def test_short_range_reads_little_beyond_itself(tmp_path, monkeypatch):
    path = tmp_path / "file.json"
    path.write_text(json.dumps([f"{i}" * 50 for i in range(20_000)]))
    begin = path.read_bytes().index(b'", "', 500_000) + 1
    read, lexed = [], json_arrays._Lexer.piece
    monkeypatch.setattr(json_arrays._Lexer, "piece", lambda self, raw: read.append(len(raw)) or lexed(self, raw))
    found = [text for raw, _ in json_arrays._elements(str(path), begin, begin + 1000, 0, 1) for text in json.loads(b"[" + raw + b"]")]
    first = int(found[0][: len(found[0]) // 50])
    assert 1 < len(found) < 10 and found == [f"{first + i}" * 50 for i in range(len(found))]
    assert sum(read) < 100_000
