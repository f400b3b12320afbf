"""Plain forward passes of the trained networks, long texts, and parts of the joins."""

import math
import random
import resource

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from duelframe.llm import jaccard_join, license_scan, pseudo_likelihood, quality, suffix_dedup
from tests.llm import brute
from tests.llm.test_operators import frame, hard_texts, rows, table

SF_DIR = "/root/testdata/sf0.001"


def plain_quality(network, text):
    data = list((text or "").encode())
    places = max(1, len(data))
    padded = data + [0] * (quality.WIDTH + 1)
    response = [sum(network.filters[j][padded[i + j]] for j in range(quality.WIDTH)) for i in range(places)]
    active = []
    for first in range(0, max(1, places - quality.CHUNK + quality.STEP), quality.STEP):
        chunk = response[first : first + quality.CHUNK]
        active.append([max(0.0, max(r[f] for r in chunk) + network.offset[f]) for f in range(quality.FILTERS)])
    features = [sum(column) / len(active) for column in zip(*active)] + [max(column) for column in zip(*active)]
    return 1 / (1 + math.exp(-(sum(f * w for f, w in zip(features, network.weights)) + network.bias)))


def test_quality_scores_equal_a_plain_pass(spark):
    labelled = table("labels")[:40]
    texts = {row["doc_id"]: row["text"] for row in table("documents")}
    network = quality.train([texts[row["doc_id"]].encode() for row in labelled], [row["quality"] for row in labelled], shown=600)
    pairs = [(i, t if t is None else t[:4000]) for i, t in enumerate(hard_texts())] + [(100 + n, "z" * n) for n in (255, 256, 257, 447, 448, 449, 640)]
    for row in quality.score_documents(frame(spark, pairs), network, keep=("doc_id", "text")).collect():
        assert row["score"] == pytest.approx(plain_quality(network, row["text"]), abs=1e-5)


def test_quality_of_long_texts_in_pieces(monkeypatch):
    network = quality.train([b"good words here", b"BAD!! BAD!!"] * 20, [1, 0] * 20, shown=400)
    rng = np.random.default_rng(0)
    for size in (quality.CHUNK, 5_000, 70_001):
        data = rng.integers(32, 127, size).astype(np.uint8)
        whole = network.score(data, np.array([0, size]))[0]
        for chunks in (1, 3, 512):
            monkeypatch.setattr(quality, "PIECE_CHUNKS", chunks)
            assert network.score_long(data) == pytest.approx(whole, abs=1e-9)
    monkeypatch.setattr(quality, "PIECE_CHUNKS", 512)
    data = np.tile(data, 600)  # 42 MB
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    network.score(data, np.array([0, len(data)]))
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 100_000  # KB


def test_quality_trains_alike_in_pieces_and_within_its_bytes(spark, monkeypatch):
    texts, labels = [b"hello world " * 80, b"x!", b"", b"q" * 700], [1, 0, 1, 0]
    whole = quality.train(texts, labels, shown=40)
    monkeypatch.setattr(quality, "PIECE_CHUNKS", 2)
    pieces = quality.train(texts, labels, shown=40)
    assert np.array_equal(whole.filters, pieces.filters) and np.array_equal(whole.weights, pieces.weights)
    taken = []
    monkeypatch.setattr(quality, "train", lambda texts, labels: taken.extend(texts))
    docs = frame(spark, [(i, "t" * (5000 if i == 7 else 60)) for i in range(100)])
    known = spark.createDataFrame([(i, 1) for i in range(100)], "doc_id long, quality int")
    quality.fit(docs, known, sample_bytes=64 * 60)
    assert 0 < sum(map(len, taken)) <= 64 * 60 and max(map(len, taken)) == 60


def plain_pseudo_likelihood(text, vocabulary, parameters, rare, counts):
    words = [w.encode() for w in brute.plain_words(text)]
    if not words:
        return 0, 0.0
    hashes = np.array([license_scan._hash_words([w])[0] for w in words], dtype=np.uint64)
    ids = vocabulary.encode(hashes).tolist()
    softmax = lambda x: x - x.max() - math.log(np.exp(x - x.max()).sum())
    total = 0.0
    for i, (own, word) in enumerate(zip(ids, hashes.tolist())):
        near = [ids[i + o] if 0 <= i + o < len(ids) else 0 for o in pseudo_likelihood.OFFSETS]
        active = np.tanh(sum(parameters.context[k][n].astype(float) for k, n in enumerate(near)) + parameters.hidden)
        cls, place = divmod(own, vocabulary.side)
        total += softmax(active @ parameters.classes + parameters.class_bias)[cls]
        total += softmax(active @ parameters.words[cls] + parameters.word_bias[cls])[place]
        if own >= vocabulary.side**2 - vocabulary.buckets:
            bucket = word % vocabulary.buckets
            aside = max(1, rare.kinds[bucket])
            n = counts.get(word) or aside * vocabulary.buckets / 2.0**64
            total += math.log(n / (rare.words[bucket] + aside))
    return len(words), total


def test_pseudo_likelihood_equals_a_plain_pass(spark):
    documents = frame(spark, [(row["doc_id"], row["text"]) for row in table("documents")])
    counts = pseudo_likelihood.count_words(documents)
    vocabulary = pseudo_likelihood.frequent_words(counts)
    known = {row["word"] % 2**64: row["n"] for row in counts.collect()}
    parameters = pseudo_likelihood.train(documents, vocabulary, sum(known.values()))
    rare = pseudo_likelihood.rare_words(counts, vocabulary)
    pairs = [(i, t if t is None else t[:1500]) for i, t in enumerate(hard_texts())] + [(50, "neverseenword another")]
    found = pseudo_likelihood.score_documents(frame(spark, pairs), vocabulary, parameters, rare)
    for row in found.collect():
        n, total = plain_pseudo_likelihood(dict(pairs)[row["doc_id"]], vocabulary, parameters, rare, known)
        assert row["n_tokens"] == n and row["log_likelihood"] == pytest.approx(total, rel=1e-4, abs=1e-4)


def test_copies_follow_the_words_and_their_mean_is_weighted(spark):
    parts = [(1, [1.0, 2.0]), (3, [5.0, 6.0])]
    rows_ = pa.table({"slice": [4, 4], "part": [np.array(v, "<f4").tobytes() for _, v in parts], "words": [w for w, _ in parts]})
    mean = pseudo_likelihood._mean_slice(rows_)
    assert mean.column("slice").to_pylist() == [4] and np.frombuffer(mean.column("part")[0].as_py(), "<f4").tolist() == [4.0, 5.0]
    documents = frame(spark, [(i, "one two three four five " * 20) for i in range(40)])
    vocabulary = pseudo_likelihood.frequent_words(pseudo_likelihood.count_words(documents))
    whole = pseudo_likelihood.train(documents, vocabulary, 4000)
    assert np.isfinite(whole.flat()).all() and not np.array_equal(whole.flat(), pseudo_likelihood.Parameters.initial(side=vocabulary.side).flat())


def test_license_filters_lose_nothing(monkeypatch):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(30)]
    templates = tuple(
        license_scan.Template(f"t{i}", " ".join(rng.choice(words) for _ in range(rng.randint(2, 24))), rng.choice([0.4, 0.7, 1.0])) for i in range(25)
    )
    frequencies = {w.encode(): rng.randrange(100) for w in words}
    texts = [" ".join(rng.choice(words + ["other"] * 30) for _ in range(rng.randint(0, 120))) for _ in range(80)]
    pruned = 0
    for found in license_scan.length_classes(templates):
        index = license_scan.TemplateIndex(found, frequencies)
        for text in texts:
            own = [w.encode() for w in text.split()]
            hashes = license_scan._hash_words(own) if own else np.zeros(0, np.uint64)
            begins = index.candidates(hashes, np.array([0, len(own)])).get(0, {})
            got = {(label, begin) for label, begin, *_ in index.search(own, begins)}
            plain = set()
            for template, ordered, need in zip(found, index.ordered, index.need):
                for begin in range(0, len(own), index.step):
                    inside = set(own[begin : begin + 2 * index.step])
                    if sum(w in inside for w in ordered) >= need:
                        plain.add((template.label, begin))
            assert got == plain
            pruned += sum(len(keys) for keys in begins.values()) > len(got)
    assert pruned


def test_long_templates_are_found_without_their_opening(spark):
    body = next(t for t in license_scan.LICENSES if t.label == "mit" and "sublicense" in t.text).text
    pairs = [(1, "Some code. " + body.upper() + " end"), (2, "plain words of no license at all " * 20), (3, " ".join(body.split()[::3]))]
    found = {row["doc_id"]: row["labels"] for row in license_scan.license_digest(frame(spark, pairs)).collect()}
    assert found == {1: "mit", 2: "", 3: ""}


@pytest.mark.parametrize("kind", ["chain", "random", "star", "tree", "none"])
def test_components_equal_a_plain_search(spark, kind):
    rng = random.Random(1)
    n = 120
    names = rng.sample(range(-1000, 1000), n)
    edges = {
        "chain": [(i, i + 1) for i in range(n - 1)],
        "random": [(rng.randrange(n), rng.randrange(n)) for _ in range(70)],
        "star": [(0, i) for i in range(1, n)] + [(i, 0) for i in range(1, 5)],
        "tree": [(i, i // 2) for i in range(1, n)],
        "none": [(3, 3)],
    }[kind]
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        parent[root(a)] = root(b)
    groups = {}
    for i in {i for e in edges if e[0] != e[1] for i in e}:
        groups.setdefault(root(i), []).append(names[i])
    expected = sorted((node, min(group)) for group in groups.values() for node in group)
    frame_ = spark.createDataFrame([(names[a], names[b]) for a, b in edges], "a long, b long")
    assert rows(jaccard_join.components(frame_), "node", "label") == sorted(expected, key=repr)


def test_open_entries_and_edges_follow_the_nodes(spark):
    """Families of near copies, five times as many documents: entries and proposed edges grow alike."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(5000)]
    bases = [[rng.choice(words) for _ in range(120)] for _ in range(4)]

    def family(size):
        out = []
        for base in bases:
            for _ in range(size):
                copy = list(base)
                for _ in range(rng.randint(0, 6)):
                    copy[rng.randrange(len(copy))] = rng.choice(words)
                out.append((len(out), " ".join(copy)))
        return out

    sizes = []
    for size in (60, 300):
        sets = jaccard_join.index_sets(frame(spark, family(size))).persist()
        entries = sets.filter("entries IS NOT NULL").selectExpr("node", "explode(entries) AS entry")
        opened = jaccard_join._open_entries(entries, None)
        links = jaccard_join.find_links(sets)
        sizes.append((opened.count(), links.count(), sets.filter("shared IS NOT NULL").count()))
        sets.unpersist()
    (few, few_links, nodes), (many, many_links, more) = sizes
    assert many <= 7 * few and few_links <= 2 * nodes and many_links <= 2 * more


def test_passages_with_edits_are_refined_exactly(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "deal", lambda docs, total, i, t, deal=suffix_dedup.deal: deal(docs, total, i, t, 1 << 14))
    monkeypatch.setattr(suffix_dedup, "shard_count", lambda total: 7)
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9)))
    passages = [" ".join(word() for _ in range(n)) for n in (60, 75, 90, 140, 400)] + ["ab" * 300, "x" * 900]
    pairs = []
    for i in range(120):
        parts = []
        for _ in range(rng.randint(1, 4)):
            passage = list(rng.choice(passages))
            for _ in range(rng.choice([0, 0, 1, 2])):
                passage[rng.randrange(len(passage))] = rng.choice("abcxyz")
            cut = rng.randrange(0, 60)
            parts += ["".join(passage)[cut:], " ".join(word() for _ in range(rng.randint(0, 30)))]
        pairs.append((i, " ".join(parts)))
    found = suffix_dedup.dedup_digest(frame(spark, pairs))
    expected = brute.suffix_dedup(pairs)
    assert rows(found, *found.columns) == sorted(expected, key=repr) and sum(row[2] > 0 for row in expected) > 40


def test_shards_of_suffixes_are_even():
    texts = pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["text"]).column("text").slice(0, 3000)
    batch = pa.table({"_text": texts.cast(pa.binary()), "_id": list(range(len(texts)))})
    for shards in (16, 32):
        found = suffix_dedup._Stretches(batch, shards)
        sizes = np.bincount(found.shard, minlength=shards)
        assert sizes.max() <= 2 * sizes.mean()
        asked = suffix_dedup._Suffixes(found, np.full(len(found.gram), suffix_dedup.DIFFERS, np.uint8), shards)
        sizes = np.bincount(asked.shard, minlength=shards)
        assert sizes.max() <= 2 * sizes.mean()


def test_buckets_are_numbered_in_sorted_order_without_single_ones():
    keys = [np.array([5, 1, 5, 9, 1, 7], np.uint64), np.array([2, 4, 2, 0, 4, 7], np.uint64)]
    assert suffix_dedup._numbered(keys, np.array([1, 1, 1, 1, 1, 2])).tolist() == [2, 1, 2, 0, 1, 3]
    begins = np.array([3, 4, 5, 90, 91, 400])
    rows_ = suffix_dedup._pair_rows(2, np.arange(6, dtype=np.uint64), np.zeros(6, np.uint64), begins, 3, 8)
    kind, batch, *note = rows_[-1]
    assert (kind, batch) == (suffix_dedup._NOTE, 8) and suffix_dedup._read_note(b"".join(note))[0].tolist() == begins.tolist()
