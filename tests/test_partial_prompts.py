"""Tables whose last prompt has fewer candidates than the others."""

import os
import shutil

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

import __spark_entry__ as entry
from duelframe.operators import candidates as C
from duelframe.operators import chat
from tests.compare import TABLES, compare, connect

SMALL = "/root/testdata/sf0.001"
DOCUMENTS = 198  # the last prompt has 3 of 5 candidates
SCORES = "prompt_idx long, sample_id int, score double"
RESPONSES = "prompt_idx long, sample_id int, response string"
QUERIES = """add_bos_eos add_reference_response answer_suffix best_worst build_messages build_pairs combine_shards
    dispatch_prompt_schema drop_degenerate_pairs encdec_truncate ensure_test_split format_with_system
    judge_in_shuffled_order judge_with_scores longer_response mask_labels mean_win_rate pad_and_stack
    pairwise_self_join prompt_consistency prune_and_rename read_split regroup_judgements render_chat_gemma
    scan_shard_ranges stack_candidates win_prob_matrix write_prob_matrix""".split()


@pytest.fixture(scope="module")
def partial_dir(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("partial")
    for name in TABLES:
        if name != "documents":
            os.symlink(f"{SMALL}/{name}.parquet", folder / f"{name}.parquet")
    documents = spark.read.parquet(f"{SMALL}/documents.parquet").filter(F.col("doc_id") < DOCUMENTS)
    documents.coalesce(1).write.parquet(str(folder / "written"))
    shutil.copy(next((folder / "written").glob("part-*.parquet")), folder / "documents.parquet")
    return str(folder)


@pytest.mark.parametrize("name", QUERIES)
def test_a_partial_prompt_is_whole_work(spark, partial_dir, name):
    found = entry.REGISTRY[name]
    assert compare(spark, connect(partial_dir), partial_dir, found.run, found.sql) is None


def test_lacking_samples_leave_null_places(spark):
    table = spark.createDataFrame([(0, 0, 1.0), (0, 2, 3.0), (1, 1, 2.0)], SCORES)
    arrays = C.score_arrays(table, 3, partial=True)
    assert dict(map(tuple, arrays.collect())) == {0: [1.0, None, 3.0], 1: [None, 2.0, None]}
    found = {r.prompt_idx: (r.best, r.worst, r.chosen_probs_win) for r in C.pair_statistics(arrays).collect()}
    assert found[1] == (1, 1, pytest.approx(0.5 / 3)) and found[0][:2] == (2, 0)
    assert sorted((r.i, r.j) for r in C.candidate_pairs(arrays).collect()) == [(0, 0), (0, 2), (1, 1), (2, 0), (2, 2)]
    texts = C.stack_candidates(spark.createDataFrame([(0, 1, "b")], RESPONSES), 2, partial=True)
    wide = chat.generated_table(spark.createDataFrame([(0, "p")], "prompt_idx long, prompt string"), texts, 2).first()
    assert wide.generate_0 is None and wide.generate_1[1].content == "b"


@pytest.mark.parametrize("rows", [[(0, 0, 1.0), (0, 0, 2.0)], [(0, 0, None)], [(0, 0, float("nan"))], [(0, 2, 1.0)], [(0, None, 1.0)]])
def test_partial_prompts_still_need_usable_rows(spark, rows):
    with pytest.raises(PySparkException, match="at most 2 scores.*prompt_idx=0"):
        C.score_arrays(spark.createDataFrame(rows, SCORES), 2, partial=True).count()
