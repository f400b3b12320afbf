import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from duelframe.indexing import index_rows, running_total_before
from duelframe.operators import slicing


def _rows(spark, n, name="row_idx"):
    return spark.range(n).withColumnRenamed("id", name)


@pytest.mark.parametrize("n,length,sizes", [(7, 3, [3, 3, 1]), (6, 3, [3, 3])])
def test_shards_partition_the_rows(spark, n, length, sizes):
    table = _rows(spark, n, "prompt_idx")
    shards = [slicing.shard_slice(table, length, i) for i in range(len(sizes))]
    assert [s.count() for s in shards] == sizes
    assert slicing.shard_slice(table, 0, 1).count() == n
    by_id = slicing.shard_ids(table, length).groupBy("shard_id").count().orderBy("shard_id").collect()
    assert [r["count"] for r in by_id] == sizes


def test_shard_plan_reports_the_uncovered_tail(spark):
    assert slicing.shard_length(8) == 2600 and slicing.shard_length(4) == 5200
    plan = slicing.shard_plan(_rows(spark, 10, "prompt_idx"), 2, round_rows=8).orderBy("shard_id").collect()
    assert [(r.shard_id, r.n_rows, r.covered) for r in plan] == [(0, 4, True), (1, 4, True), (2, 2, False)]


@settings(max_examples=8, deadline=None)
@given(
    st.lists(
        st.tuples(st.integers(0, 30), st.sampled_from([0.0, 0.1, 0.29, 0.57, 1.0])), min_size=1, max_size=3
    )
)
def test_mix_keeps_leading_shares(spark, sources):
    frames = {f"d{i}": {"train": _rows(spark, n), "test": _rows(spark, n)} for i, (n, _) in enumerate(sources)}
    mixer = {f"d{i}": frac for i, (_, frac) in enumerate(sources)}
    mixed = slicing.mix_datasets(frames, mixer)
    assert mixed["train"].count() == sum(int(frac * n) for n, frac in sources)
    assert mixed["test"].count() == sum(n for n, _ in sources)


def test_fraction_arithmetic_is_in_doubles(spark):
    row = spark.range(1).select(
        slicing.kept_rows(0.29, F.lit(100)).alias("a"), slicing.kept_rows(0.57, F.lit(100)).alias("b")
    ).first()
    assert (row.a, row.b) == (int(0.29 * 100), int(0.57 * 100)) == (28, 56)


def test_mix_order_and_shuffle(spark):
    frames = {"b": {"train": _rows(spark, 4)}, "a": {"train_x": _rows(spark, 4)}}
    plain = slicing.mix_datasets(frames, {"b": 0.5, "a": 1.0}, shuffle_seed=None)["train"].collect()
    assert [(r.source, r.row_idx) for r in plain] == [("b", 0), ("b", 1), ("a", 0), ("a", 1), ("a", 2), ("a", 3)]
    one = slicing.mix_datasets(frames, {"b": 1, "a": 1.0})["train"].collect()
    two = slicing.mix_datasets(frames, {"b": 1, "a": 1.0})["train"].collect()
    assert one == two and sorted(one) != one


def test_mix_errors(spark):
    frames = {"a": {"train": _rows(spark, 4)}}
    for frac in (-0.1, 1.5):
        with pytest.raises(ValueError, match="between 0 and 1"):
            slicing.mix_datasets(frames, {"a": frac})
    with pytest.raises(ValueError, match="neither train nor test"):
        slicing.mix_datasets({"a": {"dev": _rows(spark, 1)}}, {"a": 1.0})
    with pytest.raises(ValueError, match="no dataset"):
        slicing.mix_datasets({}, {})


def test_mix_by_source_with_one_dominating_source(spark):
    table = spark.range(900).select(
        "id", F.when(F.col("id") % 9 == 0, "small").otherwise("big").alias("source")
    )
    mixed = slicing.mix_by_source(table, "source", {"small": 1.0, "big": 0.5}, "id", position="source_row")
    counts = {r.source: (r.n, r.top) for r in mixed.groupBy("source").agg(
        F.count("*").alias("n"), F.max("source_row").alias("top")).collect()}
    assert counts == {"small": (100, 99), "big": (400, 399)}
    plain = slicing.mix_by_source(table, "source", {"small": 1.0, "big": 0.5}, "id")
    assert sorted(r.id for r in plain.collect()) == sorted(r.id for r in mixed.collect())
    assert "Join" not in plain._jdf.queryExecution().executedPlan().toString()
    repeated = table.withColumn("id", F.lit(1))
    with pytest.raises(ValueError, match="repeats a value"):
        slicing.mix_by_source(repeated, "source", {"big": 0.5}, "id")


def test_samples_are_exact_and_repeatable(spark):
    table = _rows(spark, 200)
    picked = {r.row_idx for r in slicing.sample_n(table, 50, ["row_idx"]).collect()}
    again = {r.row_idx for r in slicing.sample_n(table.repartition(7), 50, ["row_idx"]).collect()}
    other = {r.row_idx for r in slicing.sample_n(table, 50, ["row_idx"], seed=1).collect()}
    assert len(picked) == 50 and picked == again != other
    with pytest.raises(ValueError, match="smaller table"):
        slicing.sample_n(table, 201, ["row_idx"])
    assert slicing.random_rows(table, 300, ["row_idx"]).count() == 200


def test_sample_is_exact_with_null_and_repeated_keys(spark):
    rows = [(None if i % 3 == 0 else i // 7, i) for i in range(200)]
    table = spark.createDataFrame(rows, "k long, i long").repartition(5)
    for n in (0, 1, 15, 66, 67, 150, 200):
        assert slicing.sample_n(table, n, ["k"]).count() == n
    same = spark.createDataFrame([(1, i) for i in range(30)], "k long, i long")
    assert slicing.sample_n(same, 7, ["k"]).count() == 7
    picked = slicing.sample_n(table, 15, ["k", "i"])
    assert "Join" not in picked._jdf.queryExecution().executedPlan().toString()


def test_sample_equals_ranking_all_keys(spark):
    import hashlib

    table = spark.range(20_000).withColumnRenamed("id", "k")
    picked = sorted(r.k for r in slicing.sample_n(table, 30, ["k"], seed=9).collect())
    ranked = sorted(range(20_000), key=lambda k: hashlib.md5(f"9:{k}".encode()).hexdigest())
    assert picked == sorted(ranked[:30])
    places = {r.k: r.place for r in slicing.seeded_shuffle(table, ["k"], 9, "place").collect()}
    assert places == {k: place for place, k in enumerate(ranked)}


def test_split_names(spark):
    names = spark.createDataFrame([("train_sft",), ("test_x",), ("pretrain_test",)], "name string")
    got = [r.s for r in names.select(slicing.route_split(F.col("name")).alias("s")).collect()]
    assert got == ["train", "test", "train"]
    with pytest.raises(PySparkException, match="neither train nor test: dev"):
        spark.createDataFrame([("dev",)], "name string").select(slicing.route_split(F.col("name"))).collect()


def test_schedules(spark):
    dirs = [("runs/x-Iter1",), ("runs/x-Iter3",), ("runs/x-Iter4",), ("runs/x-Iter10",)]
    rows = spark.createDataFrame(dirs, "d string").select(
        slicing.reference_set(F.col("d")).alias("r"), slicing.fixed_prompt_schedule(slicing.iteration_of(F.col("d"))).alias("f")
    ).collect()
    assert [r.r for r in rows] == [1, 3, 1, 1] and {r.f for r in rows} == {1}
    last_digit = spark.createDataFrame(dirs, "d string").select(slicing.reference_set(F.col("d"), compat=True).alias("r"))
    assert [r.r for r in last_digit.collect()] == [1, 3, 1, 3]


def test_index_rows_is_dense_and_ordered(spark):
    table = spark.range(1000).select((F.col("id") * 37 % 1000).alias("k"), F.lit("hot").alias("same"))
    rows = index_rows(table.repartition(6), ["same", "k"]).orderBy("row_idx").collect()
    assert [(r.row_idx, r.k) for r in rows] == [(i, i) for i in range(1000)]


def test_running_total_over_many_buckets(spark):
    table = spark.range(0, 60_000, 3).select((F.col("id") * 5).alias("id"), (F.col("id") % 7).alias("v"))
    rows = running_total_before(table, "id", F.col("v"), "before").orderBy("id").collect()
    total = 0
    for row in rows:
        assert row.before == total
        total += row.v


def test_a_sample_of_repeated_keys_is_the_same_under_any_partitioning(spark):
    rows = [(1, i, f"t{i}", {"m": i}, [i]) for i in range(1000)] + [(2, i, None, None, None) for i in range(50)]
    table = spark.createDataFrame(rows, "k long, i long, t string, m map<string,int>, a array<int>")
    picked = [sorted(r.i for r in slicing.sample_n(table.repartition(n), 500, ["k"]).collect()) for n in (1, 3, 11)]
    assert len(picked[0]) == 500 and picked[0] == picked[1] == picked[2]
    # One digit a pass finds the same rows as four.
    slow = sorted(r.i for r in slicing.sample_n(table.repartition(4, "i"), 500, ["k"], range_digits=1).collect())
    assert slow == picked[0]
    copies = spark.createDataFrame([(1, "same")] * 40 + [(1, "other")] * 5, "k long, t string")
    for n in (1, 20, 41, 44, 45):
        found = slicing.sample_n(copies.repartition(3), n, ["k"])
        assert found.count() == n
        assert found.groupBy("t").count().count() == (1 if n <= 5 else found.select("t").distinct().count())


def test_a_sample_is_a_filter_after_few_passes(spark):
    table = _rows(spark, 5000)
    plan = slicing.sample_n(table, 700, ["row_idx"])._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Sort" not in plan and "Limit" not in plan
