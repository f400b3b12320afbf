"""The pipeline against a plain version of its stages, and its stages on hard rows."""

import public_tokenizers

import corpus_pipeline
from duelframe.llm import bpe, quality
from tests.llm import brute
from tests.llm.test_operators import RANKS, SF_DIR, benchmark_rows, documents, frame, hard, repeated  # noqa: F401


def _masked(text):
    out, end, pieces = [], 0, []
    for start, _, kind, stop in brute.base_spans(text):
        if pieces and start < pieces[-1][2]:
            pieces[-1][2] = max(pieces[-1][2], stop)
        else:
            pieces.append([kind, start, stop])
    for kind, start, stop in pieces:
        out += [text[end:start], f"[{kind.upper()}]"]
        end = stop
    return "".join(out) + text[end:]


def test_run_equals_the_plain_stages(spark, documents):  # noqa: F811
    table, labels = (spark.read.parquet(f"{SF_DIR}/{name}.parquet") for name in ("documents", "labels"))
    network = quality.fit(table, labels)
    one = lambda text: network.score(quality.np.frombuffer(text.encode(), quality.np.uint8), quality.np.array([0, len(text.encode())]))[0]
    kept = [(doc, text) for doc, text in documents if one(text) >= quality.THRESHOLD]
    assert 0 < len(kept) < len(documents)
    leaders = {row[0] for row in brute.jaccard_components(kept) if row[0] == row[2]}
    kept = [pair for pair in kept if pair[0] in leaders]
    clean = {row[0] for row in brute.contamination(kept, benchmark_rows()) if not row[-1]}
    kept = [(doc, _masked(text)) for doc, text in kept if doc in clean]
    expected = brute.tokens(kept, bpe.read_ranks(RANKS), public_tokenizers.PATTERN)
    found = corpus_pipeline.run(spark, SF_DIR)
    assert sorted(map(tuple, found.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect())) == sorted(expected)
    assert found.filter("NOT round_trip").count() == 0


def test_stages_keep_the_columns_and_take_hard_rows(spark, hard):  # noqa: F811
    # Ids without a label: the first stage is then not trained on these texts.
    apart = [(doc + 10_000, text) for doc, text in hard]
    for pairs in (repeated(apart), []):
        docs = frame(spark, pairs, extra=False)
        columns = docs.columns
        for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
            result = stage(spark, docs, SF_DIR)
            if number < len(corpus_pipeline.STAGES) - 1:
                assert result.columns == columns
            assert result.count() <= len(pairs)
