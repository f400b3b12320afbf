"""Each operator against its plain version, on the smallest tables and on hard rows."""

import random
import statistics
import time
import zlib

import public_tokenizers
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from duelframe import session
from duelframe.llm import (
    bpe, decontamination, fingerprints, jaccard_join, license_scan, pii, pseudo_likelihood, quality, queries, substring_dedup, suffix_dedup,
)
from tests.llm import brute

SF_DIR = "/root/testdata/sf0.001"
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
# Columns whose names an operator might use itself.
CLASHING = "n_words string, items string, _text string, _batch string, node string, ids string, score string, _spans string, _words string, _leader string, _copy string"


def table(name):
    return pq.read_table(f"{SF_DIR}/{name}.parquet").to_pylist()


@pytest.fixture(scope="module")
def documents():
    return [(row["doc_id"], row["text"]) for row in table("documents")]


def rows(df, *columns):
    return sorted((tuple(row) for row in df.select(*columns).collect()), key=repr)


def ordered(expected):
    return sorted(expected, key=repr)


def hard_texts():
    """Empty, blank, very long, repeated and near-equal texts, and characters of every width."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    long = " ".join(rng.choice(words) for _ in range(30_000))
    base = [rng.choice(words) for _ in range(160)]
    near = list(base)
    near[80] = "other"
    passage = " ".join(base[:70])
    return [
        None, "", " \n\t ", "one", "One two THREE four", "x" * 400, "y" * 5_000, long, long, " ".join(base), " ".join(near),
        "before " + passage + " after", "é\U0001f600 " * 300, "a\x00b\x1fc d", passage, "St " * 200,
        "card 4539 5787 6362 1486 mail a.b@c.de tel +1 415 555 0101 ip 10.0.0.255 iban GB82 WEST 1234 5698 7654 32",
        "This is under CC BY and the GNU General Public License. All rights reserved.",
    ]


@pytest.fixture(scope="module")
def hard():
    """Texts under ids in no order; the last text has no id, every third row comes twice."""
    texts = hard_texts()
    ids = [(7 * i) % 101 for i in range(len(texts))]
    return [(doc, text) for doc, text in zip(ids, texts)]


def frame(spark, pairs, extra=True):
    schema = "doc_id long, text string, lang string, source string, n_chars long" + (", " + CLASHING if extra else "")
    width = 3 + (CLASHING.count(",") + 1 if extra else 0)
    return spark.createDataFrame([(doc, text, *[None] * width) for doc, text in pairs], schema).repartition(3)


def repeated(pairs):
    """Some rows twice, and some rows without an id."""
    return pairs + pairs[4::3] + [(None, "words without an id"), (None, None)]


# 1


def benchmark_rows():
    return [(row["item_id"], row["text"]) for row in table("benchmark")]


def test_decontamination_small_table(spark, documents):
    found = queries.op1_decontamination(spark, SF_DIR)
    columns = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert rows(found, *columns) == ordered(brute.contamination(documents, benchmark_rows()))


@pytest.mark.parametrize("slice_bytes", [1 << 20, 150])
def test_decontamination_hard_rows(spark, hard, slice_bytes):
    items = [
        (1, "one"), (2, "One two"), (3, " ".join(hard_texts()[9].split()[20:45])), (3, "w1 w1"), (4, ""), (5, None), (None, "x"), (6, "é é"),
        (7, "St st st"), (1, "one"),
    ]
    benchmark = spark.createDataFrame([(i, t, None) for i, t in items], "item_id long, text string, n_words string")
    pairs = repeated(hard)
    found = decontamination.contamination(frame(spark, pairs), benchmark, slice_bytes=slice_bytes)
    assert rows(found, *found.columns) == ordered(brute.contamination(pairs, items))
    kept = decontamination.drop_contaminated(frame(spark, pairs), benchmark)
    assert len(kept.columns) == 5 + CLASHING.count(",") + 1
    assert kept.count() == sum(not row[-1] for row in brute.contamination(pairs, items))


def test_decontamination_of_nothing(spark, hard):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.contamination(frame(spark, hard), none).filter("contaminated").count() == 0
    assert decontamination.contamination(frame(spark, []), none).count() == 0


# 2 and 4


@pytest.mark.parametrize("operator,plain", [(suffix_dedup, brute.suffix_dedup), (substring_dedup, brute.substring_dedup)])
def test_dedup_small_table(spark, documents, operator, plain):
    found = operator.dedup_digest(spark.read.parquet(f"{SF_DIR}/documents.parquet"))
    assert rows(found, *found.columns) == ordered(plain(documents))


@pytest.mark.parametrize("operator,plain", [(suffix_dedup, brute.suffix_dedup), (substring_dedup, brute.substring_dedup)])
def test_dedup_hard_rows(spark, hard, operator, plain, monkeypatch):
    # Several batches and shards, however small the table.
    monkeypatch.setattr(operator, "deal", lambda docs, total, i, t, deal=operator.deal: deal(docs, total, i, t, 1 << 15))
    monkeypatch.setattr(operator, "shard_count", lambda total: 5)
    pairs = [(doc, text) for doc, text in repeated(hard) if text is None or len(text) < 10_000]
    found = operator.dedup_digest(frame(spark, pairs))
    great = 1 << 62  # a null id counts as greater than any other
    expected = [(None if row[0] == great else row[0], *row[1:]) for row in plain([(great if d is None else d, t) for d, t in pairs])]
    assert rows(found, *found.columns) == ordered(expected)
    assert operator.dedup_digest(frame(spark, [])).count() == 0


def test_a_document_of_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 3_000)
    rng = random.Random(9)
    part = "".join(rng.choice("abc ") for _ in range(5_000))
    pairs = [(1, part + "X" + part), (2, "Y" + part[1_000:4_000])]
    table = suffix_dedup.pa.table({"_text": [text.encode() for _, text in pairs], "_id": [1, 2]})
    found = suffix_dedup._Stretches(table, 3)
    assert len(found.blocks) > 3
    digest = suffix_dedup.dedup_digest(frame(spark, pairs))
    assert rows(digest, *digest.columns) == ordered(brute.suffix_dedup(pairs))


# 3


def test_quality_learns_and_holds_out(spark):
    labels = [(row["doc_id"], row["quality"]) for row in table("labels")]
    found = {row["doc_id"]: row for row in queries.op3_quality(spark, SF_DIR).collect()}
    assert all(row["held_out"] == (zlib.crc32(str(doc).encode()) % 4 == 2) for doc, row in found.items())
    assert all(0 <= row["score"] <= 1 and row["predicted"] == (row["score"] >= 0.7) for row in found.values())
    right = [found[doc]["predicted"] == label for doc, label in labels]
    unseen = [found[doc]["predicted"] == label for doc, label in labels if found[doc]["held_out"]]
    assert statistics.mean(right) > 0.93 and statistics.mean(unseen) > 0.8


def test_quality_hard_rows(spark, hard):
    network = quality.train([b"good words here", b"BAD!! BAD!!"] * 20, [1, 0] * 20, shown=400)
    pairs = repeated(hard)
    scored = quality.score_documents(frame(spark, pairs), network, keep=("doc_id", "score"), out="p")
    assert scored.count() == len(pairs) and scored.filter("p >= 0 AND p <= 1").count() == len(pairs)
    by_text = dict(zip([t for _, t in pairs], [None] * len(pairs)))
    texts = {}
    for row in quality.score_documents(frame(spark, pairs), network, keep=("text",)).collect():
        texts.setdefault(row["text"] or "", set()).add(row["score"])
    assert len(texts) == len({t or "" for t in by_text}) and all(len(found) == 1 for found in texts.values())
    nothing = spark.createDataFrame([(None, 1), (5, None)], "doc_id long, quality int")
    assert {row["score"] for row in quality.quality_scores(frame(spark, pairs), nothing).collect()} == {0.5}
    assert quality.keep_good(frame(spark, []), nothing).count() == 0


def test_quality_takes_one_text_of_repeated_ids(spark, monkeypatch):
    ids = [i for i in range(40) if zlib.crc32(str(i).encode()) % 4 != 2][:5]
    taken = []
    monkeypatch.setattr(quality, "train", lambda texts, qualities: taken.extend(texts))
    docs = frame(spark, [(i, f"text {i} {n}") for i in ids for n in range(9)])
    quality.fit(docs, spark.createDataFrame([(i, 1) for i in ids], "doc_id long, quality int"), sample_rows=5)
    assert taken == [f"text {i} 0".encode() for i in ids]


def test_quality_gradients():
    rng = quality.np.random.default_rng(0)
    values = [rng.normal(0, 0.3, (quality.WIDTH, 256, quality.FILTERS)), rng.normal(0, 0.1, quality.FILTERS), rng.normal(0, 0.5, 16), quality.np.zeros(1)]
    texts, target = [b"hello world " * 40, b"x!"], quality.np.array([1.0, 0.0])

    def loss():
        network = quality.Network.__new__(quality.Network)
        network.filters, network.offset, network.weights, network.bias = values[0], values[1], values[2], float(values[3][0])
        network.__post_init__()
        p = network.score(quality.np.frombuffer(b"".join(texts), quality.np.uint8), quality.np.cumsum([0, *map(len, texts)]))
        weight = quality.np.where(target == 1, quality.GOOD_WEIGHT, 1.0)
        return -(weight * (target * quality.np.log(p) + (1 - target) * quality.np.log(1 - p))).mean()

    gradients = quality._gradients(values, texts, target)
    for which, at in ((1, (3,)), (2, (5,)), (2, (12,)), (3, (0,))):
        step = 1e-3
        values[which][at] += step
        up = loss()
        values[which][at] -= 2 * step
        down = loss()
        values[which][at] += step
        assert gradients[which][at] == pytest.approx((up - down) / (2 * step), abs=2e-3)


# 5


def test_fingerprints_small_table(spark, documents):
    expected, texts = brute.edited(documents), dict(documents)
    errors = []
    for row in queries.op5_fingerprints(spark, SF_DIR).collect():
        n_chars, edited, following = expected[row["doc_id"]]
        assert (row["n_chars"], row["edited_sha256"]) == (n_chars, brute.sha(edited))
        own = brute.shingles(texts[row["doc_id"]])
        for text, near in ((edited, row["near_edited"]), (following, row["near_next"])):
            errors.append(abs(brute.jaccard(own, brute.shingles(text)) - near))
    assert statistics.mean(errors) < 0.03 and max(errors) < 0.2


def test_fingerprints_hard_rows(spark, hard):
    pairs = repeated(hard)
    marked = {}
    for row in fingerprints.fingerprint(frame(spark, pairs)).select("text", "fingerprint").collect():
        marked.setdefault(row["text"] or "", set()).add(row["fingerprint"])
    assert all(len(found) == 1 for found in marked.values()) and marked[""] == {""}
    compared = fingerprints.edit_and_compare(frame(spark, pairs))
    assert compared.count() == len(pairs)
    assert compared.filter("near_edited BETWEEN 0 AND 1 AND near_next BETWEEN 0 AND 1").count() == len(pairs)
    assert fingerprints.edit_and_compare(frame(spark, [])).count() == 0
    alone = fingerprints.edit_and_compare(frame(spark, [(3, "a b c d e f g")])).first()
    assert alone["near_next"] == 1.0


def test_fingerprints_stay_on_the_jvm(spark):
    plan = queries.op5_fingerprints(spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


# 6


def test_tokens_equal_the_library(spark, documents, hard):
    ranks = bpe.read_ranks(RANKS)
    for pairs in (documents, repeated(hard)):
        found = bpe.token_digest(frame(spark, pairs), RANKS, public_tokenizers.PATTERN)
        assert rows(found, *found.columns) == ordered(brute.tokens(pairs, ranks, public_tokenizers.PATTERN))
    assert bpe.token_digest(frame(spark, []), RANKS, public_tokenizers.PATTERN).count() == 0


def test_join_is_associative_and_has_a_unit():
    monoid = bpe.BytePairMonoid(bpe.read_ranks(RANKS))
    rng = random.Random(1)
    for _ in range(300):
        a, b, c = (bytes(rng.choice(b"abthe ing\xc3\xa9") for _ in range(rng.randint(0, 9))) for _ in range(3))
        x, y, z = (monoid._node(part) if part else () for part in (a, b, c))
        whole = monoid.merged(a + b + c) if a + b + c else ()
        assert monoid.join(monoid.join(x, y), z) == monoid.join(x, monoid.join(y, z)) == whole
        assert monoid.decode(whole) == a + b + c
        assert monoid.join((), x) == x == monoid.join(x, ())


# 7


def test_personal_data(spark, documents, hard):
    columns = ("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")
    rng = random.Random(3)
    bits = ["1", "23", "4539578763621486", " ", "-", ".", "+", "a@b", "@", "x.com", "_", "é", "\U0001f600", "\n", "255", "256", "1.2.3.4", "+1 415 555 0101"]
    mixed = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 25)))) for i in range(400)]
    for pairs in (documents, repeated(hard), mixed):
        assert rows(pii.pii_digest(frame(spark, pairs)), *columns) == ordered(brute.personal(pairs))


def test_personal_data_is_masked(spark, hard):
    text = "\U0001f600 a@b.co, GB82 WEST 1234 5698 7654 32 or +1 415 555 0101! DE00370400440532013000"
    row = pii.mask_personal_data(frame(spark, [(1, text), (2, None)])).orderBy("doc_id").collect()
    assert row[0]["text"] == "\U0001f600 [EMAIL], [IBAN] or [PHONE]! DE00370400440532013000"
    assert row[0]["n_chars"] == len(row[0]["text"]) and row[1]["text"] is None
    masked = pii.mask_personal_data(frame(spark, repeated(hard)))
    assert masked.columns == frame(spark, []).columns and masked.count() == len(repeated(hard))
    spans = pii.find_spans(frame(spark, [(1, "visa card 4539578763621486")]), out="found").first()["found"]
    assert [(s["kind"], s["score"]) for s in spans] == [("card", pytest.approx(0.9))]


@pytest.mark.parametrize("text, kinds", [("1" * 100_000, []), ("1 " * 100_000, []), ("q@a" + ".b" * 100_000, ["email"])])
def test_personal_data_in_long_runs(spark, text, kinds):
    found = pii.find_spans(frame(spark, [(1, text)]), out="found").first()["found"]
    assert [(s["kind"], s["start"], s["end"]) for s in found] == [(kind, 0, len(text)) for kind in kinds]


def test_account_numbers_before_other_words(spark):
    numbers = ["BE71 0961 2345 6769", "AT611904300234573201", "GB82 WEST 1234 5698 7654 32"]
    text = f"IBAN {numbers[0]} BIC KREDBEBB, {numbers[1]} 2024 {numbers[0]} {numbers[2]} AB"
    found = pii.find_spans(frame(spark, [(1, text)]), out="found").first()["found"]
    assert [text[s["start"] : s["end"]] for s in found if s["kind"] == "iban"] == [*numbers[:2], numbers[0], numbers[2]]


def test_context_on_both_sides(spark):
    number, far = "4539578763621486", "x" * 40
    texts = [f"\U0001f600 {number} is my visa card", f"cards: {number}, {number}", f"card {far} {number} {far} card"]
    found = pii.find_spans(frame(spark, list(enumerate(texts))), out="found").orderBy("doc_id").collect()
    scores = [[s["score"] for s in row["found"] if s["kind"] == "card"] for row in found]
    assert scores == [[pytest.approx(0.9)], [pytest.approx(0.9)] * 2, [pytest.approx(0.7)]]


def test_personal_data_stays_on_the_jvm(spark):
    plan = queries.op7_pii(spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


# 8


def test_licenses(spark, documents, hard):
    templates = license_scan.PHRASES + license_scan.LICENSES
    for pairs in (documents, repeated(hard)):
        found = license_scan.license_digest(frame(spark, pairs))
        assert rows(found, *found.columns) == ordered(brute.licenses(pairs, templates))
    assert license_scan.license_digest(frame(spark, [])).count() == 0


def test_a_phrase_across_blocks(spark):
    longest = max(len(brute.plain_words(t.text)) for t in license_scan.PHRASES + license_scan.LICENSES)
    texts = [(i, "w " * i + "general PUBLIC\nlicense" + " w" * 40) for i in range(2 * longest + 2)]
    found = license_scan.license_digest(frame(spark, texts)).collect()
    assert sorted((row["doc_id"], row["n_base"], row["first_word"]) for row in found) == [(i, 1, i) for i, _ in texts]


# 9


def test_jaccard_small_table(spark, documents):
    found = queries.op9_jaccard_join(spark, SF_DIR)
    assert rows(found, *found.columns) == ordered(brute.jaccard_components(documents))


def test_jaccard_hard_rows(spark, hard, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK_NODES", 4)
    rng = random.Random(2)
    words = [f"w{i}" for i in range(2_000)]
    pairs = [(10_000 + i, text) for i, text in enumerate(hard_texts())]
    for size in (3, 5, 9, 22, 27, 40, 90, 300) * 4:
        base = [rng.choice(words) for _ in range(size)]
        for _ in range(rng.randint(1, 12)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, size // 25))):
                copy[rng.randrange(size)] = rng.choice(words)
            pairs.append((len(pairs), " ".join(copy)))
    found = jaccard_join.link_documents(frame(spark, pairs))
    assert rows(found, *found.columns) == ordered(brute.jaccard_components(pairs))
    kept = jaccard_join.keep_one_of_each(frame(spark, pairs + pairs[:5] + [(None, "x y z")]))
    assert kept.count() == len({row[2] for row in brute.jaccard_components(pairs)}) + 1
    assert jaccard_join.link_documents(frame(spark, [])).count() == 0


def _copies_with_a_common_passage(rng, families, copies):
    """Near copies; four families share a passage, and one family in three has copies below the threshold."""
    words = [f"w{i}" for i in range(20_000)]
    passages = [[rng.choice(words) for _ in range(30)] for _ in range(families)]
    pairs = []
    for family in range(families):
        base = [rng.choice(words) for _ in range(rng.randint(50, 120))] + passages[family // 4]
        for _ in range(copies):
            copy = list(base)
            for at in rng.sample(range(len(base) - 30), 5 if family % 3 == 0 else 1):
                copy[at] = rng.choice(words)
            pairs.append((len(pairs), " ".join(copy)))
    return pairs


def test_jaccard_families_with_a_common_passage_are_connected_first(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK_NODES", 7)
    monkeypatch.setattr(jaccard_join, "_rounds", lambda sent, total: max(1, -(-sent // 200_000)), raising=False)
    apart, write = [], jaccard_join.materialize

    def counted(df, label, **options):
        out = write(df, label, **options)
        if label == "candidates":
            apart.append(out.select("label").distinct().count())
        return out

    monkeypatch.setattr(jaccard_join, "materialize", counted)
    pairs = _copies_with_a_common_passage(random.Random(5), 24, 6)
    found = jaccard_join.link_documents(frame(spark, pairs))
    assert rows(found, *found.columns) == ordered(brute.jaccard_components(pairs))
    assert sum(apart) < len(pairs) // 2


def test_jaccard_blocks_meet_where_sizes_are_near(spark):
    order = spark.createDataFrame([(7, i, size, 8 * size, i // 2) for i, size in enumerate([10, 11, 12, 13, 14, 15, 30, 31, 80, 90])] + [(9, 100, 5, 40, 0)], "`group` long, node long, n_shingles long, _bytes long, block long")
    found = {(r["group"], r["i"], r["j"]): (r["_alone"], r["_bytes"]) for r in jaccard_join._block_pairs(order).collect()}
    assert set(found) == {(7, i, i) for i in range(5)} | {(7, 0, 1), (7, 0, 2), (7, 1, 2), (9, 0, 0)}
    assert found[7, 0, 1] == (False, 8 * 46) and found[9, 0, 0] == (True, 40)


def test_shuffle_files_of_a_released_step_go(spark):
    def stored():
        files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {files.apply(i).getPath() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}

    before, setting = stored(), spark.conf.get(session._CLEANUP)
    wide = spark.range(10_000).repartition(3, "id")
    written = session.materialize(wide, "released", release=True)
    until = time.monotonic() + 20  # files go in the background
    while stored() - before and time.monotonic() < until:
        time.sleep(0.2)
    assert not stored() - before and spark.conf.get(session._CLEANUP) == setting
    assert written.count() == 10_000


# 10


def test_pseudo_likelihood_hard_rows(spark, hard):
    pairs = repeated(hard)
    scored = pseudo_likelihood.pseudo_likelihood(frame(spark, pairs)).collect()
    assert sorted((row["doc_id"] is None, row["doc_id"] or 0, row["n_tokens"]) for row in scored) == sorted(
        (doc is None, doc or 0, len(brute.plain_words(text))) for doc, text in pairs
    )
    for row in scored:
        assert (row["mean_log_likelihood"] is None) == (row["n_tokens"] == 0)
        assert row["log_likelihood"] <= 0 if row["n_tokens"] else row["log_likelihood"] == 0
    assert pseudo_likelihood.pseudo_likelihood(frame(spark, [])).count() == 0


def test_pseudo_likelihood_prefers_what_it_has_seen(spark):
    rng = random.Random(6)
    cycle = "red green blue white black".split()
    pairs = [(i, " ".join(cycle[j % 5] for j in range(s, s + 300))) for i, s in enumerate(range(150))]
    pairs.append((999, " ".join(rng.choice(cycle) for _ in range(300))))
    scored = {row["doc_id"]: row["mean_log_likelihood"] for row in pseudo_likelihood.pseudo_likelihood(frame(spark, pairs)).collect()}
    assert scored[999] < statistics.mean(v for k, v in scored.items() if k != 999) - 0.2


def test_network_gradients():
    np, lm = pseudo_likelihood.np, pseudo_likelihood
    rng = np.random.default_rng(0)
    target, around = rng.integers(1, lm.VOCABULARY, 40), rng.integers(0, lm.VOCABULARY, (4, 40))
    p = lm.Parameters(*[a.astype(np.float64) for a in lm.Parameters.initial().arrays()])
    gradients = lm._Pass(p, target, around).gradients(p)
    word = target[0]
    for name, at in (("context", (1, around[1, 3], 5)), ("hidden", (2,)), ("classes", (3, 7)), ("words", (word // 32, 2, word % 32)), ("word_bias", (word // 32, 5))):
        values, step = getattr(p, name), 1e-5
        values[at] += step
        up = -lm._Pass(p, target, around).log.mean()
        values[at] -= 2 * step
        down = -lm._Pass(p, target, around).log.mean()
        values[at] += step
        assert getattr(gradients, name)[at] == pytest.approx((up - down) / (2 * step), rel=1e-3, abs=1e-7)


def test_probabilities_add_up():
    np, lm = pseudo_likelihood.np, pseudo_likelihood
    p = lm.Parameters.initial()
    around = np.repeat(np.array([[3], [9], [1], [0]]), lm.VOCABULARY, axis=1)
    assert np.exp(lm._Pass(p, np.arange(lm.VOCABULARY), around).log).sum() == pytest.approx(1, abs=1e-3)


def test_word_counts_cover_all_documents(spark, documents):
    counted = pseudo_likelihood.count_words(frame(spark, documents)).agg(F.count("*"), F.sum("n")).first()
    words = [word for _, text in documents for word in brute.plain_words(text)]
    assert tuple(counted) == (len(set(words)), len(words))


def test_unseen_words_score_below_prose(spark, documents):
    lm, rng = pseudo_likelihood, random.Random(12)
    counts = lm.count_words(frame(spark, documents)).cache()
    vocabulary = lm.frequent_words(counts)
    prose = max((text for _, text in documents if text), key=lambda text: len(set(brute.plain_words(text))))
    unseen = " ".join("".join(rng.choice("bcdfghjkqvwxz") for _ in range(8)) for _ in range(200))
    texts = frame(spark, [(1, prose), (2, unseen), (3, prose), (4, None)])
    scored = lm.score_documents(texts, vocabulary, lm.Parameters.initial(), lm.rare_words(counts, vocabulary)).collect()
    mean = {row["doc_id"]: row["log_likelihood"] / max(1, row["n_tokens"]) for row in scored}
    assert mean[1] == pytest.approx(mean[3]) and mean[4] == 0
    assert mean[2] < mean[1] - 20


def test_shares_of_a_bucket(spark, documents):
    np, lm = pseudo_likelihood.np, pseudo_likelihood
    counts = lm.count_words(frame(spark, documents)).cache()
    vocabulary = lm.frequent_words(counts)
    rare = lm.rare_words(counts, vocabulary)
    rows = counts.toPandas().sort_values(["n", "word"], ascending=[False, True])[len(vocabulary.hashes) :]
    hashes = rows["word"].to_numpy().view(np.uint64)
    assert vocabulary.rare(vocabulary.encode(hashes)).all() and rare.words.sum() == rows["n"].sum() and rare.kinds.sum() == len(rows)
    bucket = vocabulary.bucket(hashes)
    shares = np.exp(lm.log_shares(bucket, rows["n"].to_numpy(), rare.words, rare.kinds))
    every = np.arange(vocabulary.buckets)
    unseen = np.exp(lm.log_shares(every, 0 * every, rare.words, rare.kinds)) * (lm.HASHES / vocabulary.buckets)
    assert np.bincount(bucket, weights=shares, minlength=len(every)) + unseen == pytest.approx(np.ones(len(every)))


def test_vocabulary_grows_with_the_corpus(spark):
    counts = spark.range(5_000).selectExpr("id AS word", "CAST(10000 AS long) AS n")
    assert len(pseudo_likelihood.frequent_words(counts).hashes) > 1_000
