import json

import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from duelframe.session import materialize, shared_folder
from duelframe.sources import json_arrays, readers, writers


def _write_shards(folder, shards):
    for (shard, sample), texts in shards.items():
        (folder / f"responses_{shard}_{sample}.json").write_text(json.dumps(texts))


def test_named_shard_files_combine_in_the_given_order(spark, tmp_path):
    texts = {(s, j): [f"s{s} j{j} é {i}\n" for i in range(n)] for s, n in ((0, 3), (5, 2), (10, 1)) for j in range(2)}
    _write_shards(tmp_path, texts)
    (tmp_path / "responses_0.json").write_text(json.dumps(["combined"]))
    (tmp_path / "probabilities.json").write_text("[]")
    shards = readers.scan_response_shards(spark, str(tmp_path))
    assert shards.count() == 12
    for order in ([0, 5, 10], [10, 0, 5]):
        combined = readers.combine_shards(shards, order).orderBy("sample_id", "prompt_idx").collect()
        expected = [(i, j, text) for j in range(2) for i, text in enumerate(t for s in order for t in texts[s, j])]
        assert [tuple(r) for r in combined] == expected
    with pytest.raises(PySparkException, match="not in the given order"):
        readers.combine_shards(shards, [0, 5]).collect()


def test_a_missing_or_short_shard_is_an_error(spark, tmp_path):
    texts = {(s, j): [f"{s}{j}{i}" for i in range(3)] for s in range(3) for j in range(2)}
    for name, gone in (("missing", None), ("short", ["x"]), ("empty", [])):
        folder = tmp_path / name
        folder.mkdir()
        left = {key: value for key, value in texts.items() if key != (1, 0)} | ({(1, 0): gone} if gone is not None else {})
        _write_shards(folder, left)
        shards = readers.scan_response_shards(spark, str(folder))
        with pytest.raises(ValueError, match="differ between samples: place 1"):
            readers.combine_shards(shards)
    folder = tmp_path / "gap"
    folder.mkdir()
    _write_shards(folder, {key: value for key, value in texts.items() if key[0] != 1})
    with pytest.raises(ValueError, match="3 shards expected"):
        readers.combine_shards(readers.scan_response_shards(spark, str(folder)))


@pytest.mark.parametrize("content", ['["a", "b', '{"a": 1}', '["a", null]'])
def test_a_broken_shard_file_stops_the_job(spark, tmp_path, content):
    (tmp_path / "responses_3_1.json").write_text(content)
    with pytest.raises((PySparkException, Py4JError)):
        readers.scan_response_shards(spark, str(tmp_path)).count()


def test_combined_files(spark, tmp_path):
    for sample in range(2):
        (tmp_path / f"responses_{sample}.json").write_text(json.dumps([f"{sample}{i}" for i in range(3)]))
    (tmp_path / "responses_0_1.json").write_text('["shard"]')
    rows = readers.scan_combined_responses(spark, str(tmp_path)).collect()
    assert sorted(tuple(r) for r in rows) == [(i, j, f"{j}{i}") for i in range(3) for j in range(2)]


def test_strict_scores_splits_and_evaluation_records(spark, tmp_path):
    table = spark.createDataFrame([(0, 10, 0, 0.5)], "shard_pos long, pos long, sample_id int, score double")
    with pytest.raises(PySparkException, match="outside its shard"):
        readers.scan_scores(table, 10, 2).count()
    spark.range(3).write.parquet(str(tmp_path / "plain"))
    with pytest.raises(ValueError, match="no split test"):
        readers.read_split(spark, str(tmp_path / "plain"), "test")
    for name, line in (("broken", '{"instruction": "a"'), ("misnamed", '{"instr": "a"}')):
        (tmp_path / f"{name}.json").write_text(line + "\n")
        with pytest.raises((PySparkException, Py4JError)):
            readers.scan_eval_set(spark, str(tmp_path / f"{name}.json"), "instruction string").count()


def test_shard_id_list():
    assert readers.parse_shard_ids("(0,5,6)") == readers.parse_shard_ids("0,5,6") == [0, 5, 6]


def test_written_shards_round_trip(spark, tmp_path):
    rows = [(i, j, f"text {i} {j} \"q\" \\ \n") for i in range(23) for j in range(2)]
    table = spark.createDataFrame(rows, "prompt_idx long, sample_id int, response string")
    path = str(tmp_path / "shards")
    writers.write_response_shards(table, path, 5)
    shards = readers.scan_response_shards(spark, path, partitioned=True)
    assert shards.groupBy("shard", "sample_id").count().agg(F.max("count")).first()[0] == 5
    assert sorted(tuple(r) for r in readers.combine_shards(shards).collect()) == rows


def test_score_shards_need_a_length(spark):
    table = spark.createDataFrame([(1, 2, 0, 0.5)], "shard_pos long, pos long, sample_id int, score double")
    assert readers.scan_scores(table, 10, 2).first().prompt_idx == 12
    assert readers.scan_scores(table.withColumn("shard_pos", F.lit(0)), 0, 1).first().prompt_idx == 2
    with pytest.raises(ValueError, match="frac_len"):
        readers.scan_scores(table, 0, 2)


def test_read_split_layouts(spark, tmp_path):
    by_file, by_column, plain = (str(tmp_path / n) for n in ("file", "column", "plain"))
    rows = spark.createDataFrame([(1, "train"), (2, "test")], "x long, split string")
    rows.filter("x = 1").select("x").write.parquet(f"{by_file}/train.parquet")
    rows.write.partitionBy("split").parquet(by_column)
    rows.select("x").write.parquet(plain)
    assert [r.x for r in readers.read_split(spark, by_file).collect()] == [1]
    assert [r.x for r in readers.read_split(spark, by_column, "test").collect()] == [2]
    assert sorted(r.x for r in readers.read_split(spark, plain).collect()) == [1, 2]
    with pytest.raises(PySparkException):
        readers.read_split(spark, str(tmp_path / "absent"))


def test_test_split_is_sampled_once(spark, tmp_path):
    folder = str(tmp_path / "pairs")
    pairs = spark.range(40).withColumnRenamed("id", "prompt_idx")
    writers.write_pairs(pairs, folder, 10)
    first = sorted(r.prompt_idx for r in readers.read_split(spark, folder, "test").collect())
    assert len(first) == 10
    assert sorted(r.prompt_idx for r in writers.ensure_test_split(spark, folder, 30).collect()) == first
    with pytest.raises(ValueError, match="smaller table"):
        writers.write_pairs(pairs, str(tmp_path / "small"))


def test_eval_set_forms(spark, tmp_path):
    records = [{"instruction": "a", "output": " x\n", "generator": "g"}, {"instruction": "b", "output": "é", "generator": "g"}]
    (tmp_path / "array.json").write_text(json.dumps(records))
    schema = "instruction string, output string, generator string"
    table = readers.scan_eval_set(spark, str(tmp_path / "array.json"), schema, one_array=True)
    assert [r.asDict() for r in table.collect()] == records
    writers.write_eval_outputs(table, str(tmp_path / "lines"))
    assert sorted(r.instruction for r in readers.scan_eval_set(spark, str(tmp_path / "lines"), schema).collect()) == ["a", "b"]


def test_scan_prompts(spark):
    table = spark.createDataFrame([("b",), ("a",)], "prompt string")
    rows = readers.scan_prompts(table, ["prompt"]).orderBy("prompt_idx").collect()
    assert [tuple(r) for r in rows] == [(0, "a"), (1, "b")]
    with pytest.raises(ValueError):
        readers.scan_prompts(table)
    with pytest.raises(ValueError):
        readers.scan_prompts(spark.range(1))


@pytest.mark.parametrize("name", ["data-x-iter1", "nodash", "a-", "-b", "a-b-c"])
def test_dataset_name(spark, name):
    expected = f"synthetic_data_{name.partition('-')[2]}_score"
    got = spark.createDataFrame([(name,)], "n string").select(writers.dataset_name(F.col("n")).alias("d")).first().d
    # A name without a dash has nothing left.
    assert got == expected


def test_shared_folder_comes_from_the_session(spark, tmp_path, monkeypatch):
    assert shared_folder(spark) == shared_folder(spark)
    stored = materialize(spark.range(5), "check")
    assert stored.count() == 5 and shared_folder(spark) in stored.inputFiles()[0]

    class Conf:
        def get(self, key, default):
            return f"{tmp_path}/" if key == "spark.checkpoint.dir" else default

    class Cluster:
        conf = Conf()

    assert shared_folder(Cluster()) == str(tmp_path)


_STRINGS = st.text(st.sampled_from('a"\\,[]{} é\n😀'), max_size=12)


def _by_ranges(path, range_bytes):
    """Elements of a file as its ranges read them one after the other."""
    size = path.stat().st_size
    rows = [{"path": str(path), "begin": b, "until": min(b + range_bytes, size)} for b in range(0, size, range_bytes)]
    changes = next(json_arrays._changes(iter([pa.RecordBatch.from_pylist(rows)]))).to_pylist()
    found, quotes, depth = [], 0, 0
    for row in changes:
        before = len(found)
        inside = quotes % 2
        for raw, cuts in json_arrays._elements(row["path"], row["begin"], row["until"], inside, depth):
            values = json.loads(b"[" + raw + b"]")
            assert not values or len(values) == len(cuts) + 1
            found += values
        at_top = dict(row[f"commas{inside}"]).get(1 - depth, 0) + (row["begin"] == 0)
        assert len(found) - before in (at_top, 0)
        quotes, depth = quotes + row["quotes"], depth + row[f"deeper{inside}"]
    assert depth == 0 and quotes % 2 == 0
    return found


@settings(max_examples=150, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(_STRINGS, max_size=12), st.booleans(), st.booleans(), st.sampled_from([1, 2, 3, 7, 20, 1000]), st.sampled_from([1, 2, 5, 64]))
def test_ranges_read_every_element_once(tmp_path, monkeypatch, texts, records, ascii_only, range_bytes, piece):
    monkeypatch.setattr(json_arrays, "PIECE_BYTES", piece)
    values = [{"a": t, "b": [t, [1, {"c": t}]]} for t in texts] if records else texts
    (tmp_path / "array").write_text(json.dumps(values, ensure_ascii=ascii_only, indent=1 if len(texts) % 2 else None), encoding="utf-8")
    assert _by_ranges(tmp_path / "array", range_bytes) == values


def test_large_array_files_are_read_by_several_tasks(spark, tmp_path):
    texts = {(s, j): [f's{s} "j{j}" \\ é {i}\n' * (i % 5) for i in range(300)] for s in range(2) for j in range(2)}
    _write_shards(tmp_path, texts | {(2, j): ["short"] for j in range(2)})
    whole = readers.scan_response_shards(spark, str(tmp_path))
    ranged = readers.scan_response_shards(spark, str(tmp_path), range_bytes=1500)
    assert whole.schema.simpleString() == ranged.schema.simpleString()
    assert sorted(map(tuple, ranged.collect())) == sorted(map(tuple, whole.collect()))
    spread = ranged.filter("shard = 0 AND sample_id = 0").select(F.spark_partition_id().alias("p")).distinct().count()
    assert spread > 3
    long = tmp_path / "combined"
    long.mkdir()
    (long / "responses_1.json").write_text(json.dumps(texts[0, 0]))
    rows = readers.scan_combined_responses(spark, str(long), range_bytes=700).orderBy("prompt_idx").collect()
    assert [tuple(r) for r in rows] == [(i, 1, t) for i, t in enumerate(texts[0, 0])]


def test_large_record_arrays(spark, tmp_path):
    records = [{"instruction": f"[{i}], \"x\"", "output": "é" * (i % 40), "generator": "g"} for i in range(200)]
    (tmp_path / "a.json").write_text(json.dumps(records, indent=2))
    (tmp_path / "b.json").write_text(json.dumps(records[:1]))
    schema = "instruction string, output string, generator string"
    found = readers.scan_eval_set(spark, str(tmp_path), schema, one_array=True, range_bytes=1000)
    assert sorted(r.instruction for r in found.collect()) == sorted(r["instruction"] for r in records + records[:1])


@pytest.mark.parametrize("content", ['["%s", "b', '{"%s": 1}', '["%s", null]', '["%s"] "x"', '["%s"]]', '"%s"', '["%s",, "a"]', '["%s" "a"]'])
def test_a_broken_large_file_stops_the_job(spark, tmp_path, content):
    (tmp_path / "responses_3_1.json").write_text(content % ("long " * 200))
    with pytest.raises((PySparkException, Py4JError)):
        readers.scan_response_shards(spark, str(tmp_path), range_bytes=300).collect()


def test_positions_are_found_without_writing_the_prompts(spark, tmp_path):
    rows = [(i % 3 if i else None, i, f"text of {i}") for i in range(40)]
    table = spark.createDataFrame(rows, "lang int, id long, prompt string").repartition(4)
    found = readers.scan_prompts(table, ["lang", "id"])
    expected = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert [tuple(r) for r in found.orderBy("prompt_idx").collect()] == [(i, r[2]) for i, r in enumerate(expected)]
    written = found._jdf.queryExecution().optimizedPlan().toString()
    scans = [line for line in written.splitlines() if "Relation" in line]
    assert scans and not any("prompt#" in line for line in scans)
    with pytest.raises((PySparkException, Py4JError), match="do not identify a row"):
        readers.scan_prompts(table, ["lang"]).collect()
