"""Vector codes, whitening and token files against plain versions."""

import math
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyarrow import fs

from duelframe.llm import chunked_tokens, elias_fano, queries, token_files, vector_codes, whitening
from duelframe.llm.metric_trees import Tree
from duelframe.llm.oracles import VECTOR_CODES
from duelframe.llm.spectral import leading_eigenvectors, polar_factor
from tests.compare import compare, connect
from tests.llm import brute
from tests.llm.test_operators import frame, hard_texts, ordered, repeated, rows, table

SF_DIR = "/root/testdata/sf0.001"
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
CLASHING = "vector string, code string, x string, n string, trees string, error string, component string, _label string, part string"


def vector_frame(spark, found):
    width = CLASHING.count(",") + 1
    schema = f"vec_id long, embedding array<double>, label int, {CLASHING}"
    return spark.createDataFrame([(i, v, label, *[None] * width) for i, label, v in found], schema).repartition(3)


def hard_vectors():
    """Equal, short, empty, missing and unusable vectors, ids and labels."""
    rng = random.Random(7)
    found = [(3 * i % 401, i % 3 or None, [rng.gauss(0, 1) for _ in range(21)]) for i in range(160)]
    found += [(1000, 1, found[0][2]), (1001, None, found[0][2]), (7, 2, found[5][2]), (None, 1, found[9][2]), (None, None, [0.0] * 21)]
    found += [(1002, 1, [0.5]), (1003, 1, []), (1004, 1, None), (1005, 1, [None] * 21), (1006, 1, [math.nan] * 21), (1007, 1, [1.0] * 20 + [math.inf])]
    return found + [(2000 + i, 5, found[3][2]) for i in range(300)]


# 11


def test_vector_codes_small_table(spark):
    assert compare(spark, connect(SF_DIR), SF_DIR, queries.op11_vector_codes, VECTOR_CODES) is None
    found = queries.op11_vector_codes(spark, SF_DIR)
    small = [(row["vec_id"], row["label"], row["embedding"]) for row in table("embeddings")]
    assert rows(found, *found.columns) == ordered(brute.vector_codes(small))


@pytest.mark.parametrize("block_rows", [50, 4096])
def test_vector_codes_hard_rows(spark, monkeypatch, block_rows):
    monkeypatch.setattr(vector_codes, "BLOCK_ROWS", block_rows)
    found = vector_codes.compress(vector_frame(spark, hard_vectors()))
    assert rows(found, *found.columns) == ordered(brute.vector_codes(hard_vectors()))


@pytest.mark.parametrize("found", [[], [(1, 1, None)], [(None, None, [0.25, -0.5])], [(1, 1, []), (2, None, [])], [(1, 1, [1e30, -1e30])]])
def test_vector_codes_of_little(spark, found):
    result = vector_codes.compress(vector_frame(spark, found)).collect()
    assert len(result) == sum(v is not None for _, _, v in found)
    assert all(row["error"] == 0 for row in result if row["vec_id"] is not None)


@pytest.mark.parametrize("kind", ["spread", "grid", "same", "clusters"])
def test_tree_finds_what_comparison_finds(kind):
    rng = np.random.default_rng(3)
    points = {
        "spread": lambda: rng.integers(-500, 500, (3000, 4)),
        "grid": lambda: rng.integers(0, 3, (3000, 3)),
        "same": lambda: np.full((700, 2), 9),
        "clusters": lambda: rng.integers(0, 20, (2000, 4)) + 1000 * rng.integers(0, 9, (2000, 1)),
    }[kind]()
    entries = np.concatenate([points[:40], points[:3], points[10:20] + 1])
    tree = Tree(points)
    again = Tree.from_bytes(tree.to_bytes(), points.shape[1])
    distance = ((points[:, None, :] - entries) ** 2).sum(axis=2)
    for one in (tree, again):
        nearest, sums, counts = one.assign(entries)
        assert (nearest == distance.argmin(axis=1)[one.order]).all()
        assert (counts == np.bincount(nearest, minlength=len(entries))).all()
        for entry in range(len(entries)):
            assert (sums[entry] == one.points[nearest == entry].sum(axis=0)).all()


def test_balls_hold_their_points_and_most_are_owned_whole():
    rng = np.random.default_rng(5)
    points = rng.integers(0, 30, (4000, 4)) + 2000 * rng.integers(0, 12, (4000, 1))
    tree = Tree(points)
    for first, last, total, radius in zip(tree.first, tree.last, tree.total, tree.radius):
        own = tree.points[first:last]
        assert (own.sum(axis=0) == total).all()
        assert np.sqrt(((own - total / len(own)) ** 2).sum(axis=1)).max() <= radius * (1 + 1e-12)
    # Points are looked at in leaves only; with entries far apart there are none.
    tree.points = None
    entries = np.repeat(np.arange(12)[:, None] * 2000, 4, axis=1)
    assert tree.assign(entries)[2].sum() == len(points)


# 12


def compared(found, expected):
    ids, whitened, shares, n = expected
    assert sorted(((row["vec_id"], row["deviation"]) for row in found if row["component"] == 1), key=repr) == sorted(ids, key=repr)
    assert {row["n"] for row in found} == {n}
    assert max(row["identity_error"] for row in found) <= 1e-9
    for k, share in enumerate(shares):
        own = [(row["vec_id"], row["deviation"], row["whitened"]) for row in found if row["component"] == k + 1]
        plain = [(i, d, value) for (i, d), value in zip(ids, whitened[:, k])]
        sign = 1 if sum(abs(a[2] - b[2]) for a, b in zip(sorted(own, key=repr), sorted(plain, key=repr))) < 1e-6 * len(own) else -1
        for a, b in zip(sorted(own, key=lambda r: (repr(r[:2]), sign * r[2])), sorted(plain, key=lambda r: (repr(r[:2]), r[2]))):
            assert a[:2] == b[:2] and abs(sign * a[2] - b[2]) < 1e-8
        assert all(abs(row["explained"] / share - 1) < 1e-9 for row in found if row["component"] == k + 1)


def test_whitening_small_table(spark):
    found = queries.op12_whitening(spark, SF_DIR).collect()
    compared(found, brute.whitening([(row["vec_id"], row["label"], row["embedding"]) for row in table("embeddings")]))


def test_whitening_hard_rows(spark):
    found = whitening.whiten(vector_frame(spark, hard_vectors())).collect()
    compared(found, brute.whitening(hard_vectors()))


@pytest.mark.parametrize("found", [[], [(1, 1, None)], [(1, 1, [0.5, 0.5])] * 3, [(1, 1, [])]])
def test_whitening_of_nothing_that_varies(spark, found):
    assert whitening.whiten(vector_frame(spark, found)).count() == 0


def test_whitening_of_two_vectors_and_of_large_components(spark):
    found = whitening.whiten(vector_frame(spark, [(1, 1, [0.0, 0.0, 1.0]), (2, 1, [3.0, 0.0, 1.0]), (3, 1, [3.0, 0.0, 1.0])])).collect()
    assert sorted((row["vec_id"], row["component"], abs(row["whitened"])) for row in found) == [(1, 1, 1.0), (2, 1, 1.0), (3, 1, 1.0)]
    large = whitening.whiten(vector_frame(spark, [(1, 1, [1e30]), (2, 1, [-1e30])])).collect()
    assert [row["deviation"] for row in large] == [None, None] and {round(abs(row["whitened"]), 9) for row in large} == {1.0}


@pytest.mark.parametrize("size", [1, 2, 3, 8, 40])
def test_spectral_division_equals_the_library(size):
    rng = np.random.default_rng(size)
    half = rng.standard_normal((size, size))
    turn, _ = np.linalg.qr(half)
    diagonals = [np.arange(size) + 1.0, np.r_[np.full(size // 2, 5.0), np.full(size - size // 2, 1e-9)], np.ones(size), np.r_[1e6, np.zeros(size - 1)]]
    for matrix in [half @ half.T, half + half.T, np.ones((size, size)), *[np.diag(d) for d in diagonals], *[turn * d @ turn.T for d in diagonals]]:
        values, vectors = leading_eigenvectors(matrix, 16)
        scale = np.linalg.norm(matrix) or 1.0
        assert np.allclose(values, np.linalg.eigvalsh(matrix)[::-1][: len(values)], atol=1e-11 * scale)
        assert len(values) == min(16, size) and np.allclose(vectors.T @ vectors, np.eye(len(values)), atol=1e-12)
        assert np.linalg.norm(matrix @ vectors - vectors * values) < 1e-10 * scale


def test_polar_factor_of_nearly_singular_matrices():
    rng = np.random.default_rng(2)
    turn, _ = np.linalg.qr(rng.standard_normal((12, 12)))
    for least in (1e-2, 1e-8, 1e-13):
        signs = np.where(np.arange(12) < 5, 1.0, -1.0)
        matrix = turn * (signs * np.geomspace(least, 1, 12)) @ turn.T
        factor = polar_factor((matrix + matrix.T) / 2)
        assert np.allclose(factor.T @ factor, np.eye(12), atol=1e-13) and round(np.trace(factor)) == -2
    with pytest.raises(np.linalg.LinAlgError):
        polar_factor(np.diag([1.0, 0.0]))


# 13


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(-(2**63), 2**63 - 1) | st.integers(0, 300), max_size=400))
def test_elias_fano_gives_back_every_number(values):
    values = np.array(sorted(values), dtype=np.int64)
    coded = elias_fano.encode(values)
    found = elias_fano.EliasFano(b"before  " + coded + b"behind", 8)
    assert found.size == len(coded)
    assert (found.select(np.arange(len(values))) == values).all()
    assert (found.select(np.arange(len(values))[::-7]) == values[::-7]).all()


def test_elias_fano_space_is_near_the_least():
    ends = np.cumsum(np.random.default_rng(1).integers(1, 2000, 100_000))
    per_number = 8 * len(elias_fano.encode(ends)) / len(ends)
    assert per_number < 2 + math.log2(ends[-1] / len(ends)) + 1
    jump = np.concatenate([np.arange(5000), 10**9 + np.arange(5000)])  # a long stretch without a number
    assert (elias_fano.EliasFano(elias_fano.encode(jump)).select(np.arange(10_000)) == jump).all()


_PIECES = [" ", "  ", "\n", "\n\n", "\t", "\r\n", " \n ", "\x0b", "\x1c", "\x85", "\xa0", " ", "　", " ", "​", "a", "it's", "don't", "'LL", "x1y2", "42", "!?", "été",
           "Ж", "漢字", "\U0001f600", "é", "<|endoftext|>", "\x00", "\x7f", "﻿", "_", "Word", "٠", "²", "ß "]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(st.sampled_from(_PIECES), max_size=30).map("".join), max_size=5))
def test_chunks_encode_as_their_texts(texts):
    import pyarrow as pa

    with open(TOKENIZER, encoding="utf-8") as file:
        encoder = chunked_tokens.ChunkEncoder(file.read()) if not hasattr(test_chunks_encode_as_their_texts, "encoder") else test_chunks_encode_as_their_texts.encoder
    test_chunks_encode_as_their_texts.encoder = encoder
    found = list(encoder.encode(pa.array(texts, pa.string())))
    ids, counts = (np.concatenate([np.zeros(0, np.int64), *part]) for part in (zip(*found) if found else ([], [])))
    expected = [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert counts.tolist() == [len(e) for e in expected]
    assert ids.tolist() == [i for e in expected for i in e]


def in_order(found):
    """Rows without their starts, once these add up in ascending order of ids, nulls first."""
    found = sorted(found, key=lambda row: row["start"])
    assert [row["start"] for row in found] == np.cumsum([0, *[row["n_tokens"] for row in found]])[:-1].tolist()
    ids = [-math.inf if row["doc_id"] is None else row["doc_id"] for row in found]
    assert ids == sorted(ids)
    return sorted([(row["doc_id"], row["n_tokens"], row["ids_crc32"]) for row in found], key=repr)


def test_token_files_small_table(spark):
    documents = [(row["doc_id"], row["text"]) for row in table("documents")]
    assert in_order(queries.op13_token_files(spark, SF_DIR).collect()) == ordered(brute.token_files(documents, TOKENIZER))


@pytest.mark.parametrize("file_ids,task_bytes,remembered", [(1 << 24, 1 << 25, 1 << 19), (500, 20_000, 3)])
def test_token_files_hard_rows(spark, tmp_path, monkeypatch, file_ids, task_bytes, remembered):
    monkeypatch.setattr(chunked_tokens, "REMEMBERED", remembered)
    pairs = repeated([((7 * i) % 101 - 40, text) for i, text in enumerate(hard_texts())]) + [(5, "same")] * 40
    path = str(tmp_path / "files")
    token_files.write(frame(spark, pairs), path, TOKENIZER, file_ids=file_ids, task_bytes=task_bytes)
    found = token_files.read(spark, path).selectExpr("doc_id", "start", "n_tokens", "crc32(ids) AS ids_crc32").collect()
    assert in_order(found) == ordered(brute.token_files(pairs, TOKENIZER))


def test_token_files_of_nothing_and_files_of_lost_tasks(spark, tmp_path):
    assert token_files.token_file_digest(frame(spark, []), str(tmp_path / "none"), TOKENIZER).count() == 0
    path = tmp_path / "some"
    assert token_files.token_file_digest(frame(spark, [(1, "one two"), (None, None)]), str(path), TOKENIZER).count() == 2
    (path / "part-000000-00000-of-a-lost-task.ids").write_bytes(b"IDS1 and not finished")
    assert token_files.read(spark, str(path)).count() == 2


def test_a_document_is_read_from_the_middle_of_a_file(tmp_path):
    sizes = [3, 0, 70_000, 1, 5]
    ids = np.arange(sum(sizes), dtype=np.uint32) % 50_000
    (tmp_path / "one").write_bytes(token_files.file_head([-5, 2, 2, 9], 1, np.cumsum(sizes), 2) + ids.astype("<u2").tobytes())
    opened = token_files.TokenFile(fs.LocalFileSystem(), str(tmp_path / "one"))
    assert opened.doc_ids(np.arange(5)).to_pylist() == [None, -5, 2, 2, 9]
    starts, ends = opened.bounds(np.array([3, 0, 1]))
    assert (starts.tolist(), ends.tolist()) == ([70_003, 0, 3], [70_004, 3, 3])
    assert opened.token_ids(70_003, 70_004).tolist() == [70_003 % 50_000]
    assert sum(batch.num_rows for batch in opened.batches(0)) == 5
