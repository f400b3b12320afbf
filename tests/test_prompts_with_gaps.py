"""Tables in which prompts lack candidates anywhere: the first one, all but one, or all."""

import os
import shutil

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tests.compare import TABLES, compare, connect

SMALL = "/root/testdata/sf0.001"
QUERIES = """add_reference_response answer_suffix best_worst build_messages drop_degenerate_pairs encdec_truncate
    ensure_test_split format_with_system judge_in_shuffled_order judge_with_scores longer_response mask_labels
    mean_win_rate pad_and_stack pairwise_self_join prompt_consistency prune_and_rename read_split
    render_chat_gemma""".split()


@pytest.fixture(scope="module")
def gaps_dir(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("gaps")
    for name in TABLES:
        if name != "documents":
            os.symlink(f"{SMALL}/{name}.parquet", folder / f"{name}.parquet")
    documents = spark.read.parquet(f"{SMALL}/documents.parquet")
    prompt, sample = F.floor(documents.doc_id / 5), documents.doc_id % 5
    # Every seventh document is missing, prompt 4 altogether, and prompts 9 and 39 have their last or first candidate alone.
    there = (documents.doc_id % 7 != 3) & (prompt != 4) & ((prompt != 9) | (sample == 4)) & (documents.doc_id < 196)
    documents.filter(there).coalesce(1).write.parquet(str(folder / "written"))
    shutil.copy(next((folder / "written").glob("part-*.parquet")), folder / "documents.parquet")
    return str(folder)


@pytest.mark.parametrize("name", QUERIES)
def test_prompts_may_lack_any_candidates(spark, gaps_dir, name):
    found = entry.REGISTRY[name]
    assert compare(spark, connect(gaps_dir), gaps_dir, found.run, found.sql) is None
