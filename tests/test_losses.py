import numpy as np
import pytest
from pyspark.sql import functions as F

from duelframe.functions.columns import clamp_max
from duelframe.operators import joins
from duelframe.plans import losses
from pyspark.errors import PySparkException

NAMES = ("pc", "pr", "rc", "rr", "lc", "lr", "p", "pw", "pl")


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(11)
    values = {name: rng.normal(scale=8, size=300) for name in NAMES[:6]}
    values |= {name: rng.uniform(size=300) for name in NAMES[6:]}
    # A third and more of all rows share batch 0.
    values["batch_id"] = np.where(np.arange(300) < 130, 0, np.arange(300) % 5)
    return values


@pytest.fixture(scope="module")
def table(spark, data):
    rows = list(zip(*[data[name].tolist() for name in (*NAMES, "batch_id")]))
    return spark.createDataFrame(rows, ", ".join(f"{n} double" for n in NAMES) + ", batch_id long")


def _expected_regularizer(name, v):
    dw, dl = v["pc"] - v["rc"], v["pr"] - v["rr"]

    def forward(cap):
        return np.exp(np.minimum(-dw, cap)).mean() + np.exp(np.minimum(-dl, cap)).mean()

    reverse = (dw**2).mean() + (dl**2).mean()
    up = [np.exp(np.minimum(d, 10)) for d in (dw, dl)]
    return {
        "sppo": 0.0,
        "sppo_single": 0.0,
        "sppo_forwardimportance3": forward(3),
        "sppo_reversekl": reverse,
        "sppo_reverseklnoent": -(v["pc"] * v["rc"]).mean() - (v["pr"] * v["rr"]).mean(),
        "sppo_forwardreverse": forward(10) + reverse,
        "sppo_forward1reverse0.5": forward(10) + 0.5 * reverse,
        "sppo_forward1R5reverse20": forward(5) + 20 * reverse,
        "sppo_entropy": (v["pc"] ** 2).mean() + (v["pr"] ** 2).mean(),
        "sppo_chisq10": up[0].mean() + up[1].mean(),
        "sppo_chisqsm1": (up[0] / (1 + up[0])).mean() + (up[1] / (1 + up[1])).mean(),
    }[name]


LOSS_NAMES = [
    "sppo", "sppo_single", "sppo_forwardimportance3", "sppo_reversekl", "sppo_reverseklnoent",
    "sppo_forwardreverse", "sppo_forward1reverse0.5", "sppo_forward1R5reverse20", "sppo_entropy",
    "sppo_chisq10", "sppo_chisqsm1",
]


def _batch(data, batch):
    mask = data["batch_id"] == batch
    return {name: data[name][mask] for name in NAMES}


def _self_play(v, beta):
    return (
        (v["pc"] - v["lc"] - (v["pw"] - 0.5) / beta) ** 2 + (v["pr"] - v["lr"] - (v["pl"] - 0.5) / beta) ** 2
    ).mean() / 2


@pytest.mark.parametrize("name", LOSS_NAMES)
def test_regularizers_match_numpy(table, data, name):
    for row in losses.batch_regularizer(table, name).collect():
        assert row.reg_loss == pytest.approx(_expected_regularizer(name, _batch(data, row.batch_id)), rel=1e-9)


def test_grid_equals_single_runs(table, data):
    grid = [(name, beta, coef) for name in LOSS_NAMES for beta in (0.001, 0.1) for coef in (0.1, 2.0)]
    cells = losses.loss_grid(table, grid, compat=True).collect()
    assert len(cells) == len(grid) * 5
    for row in cells:
        v = _batch(data, row.batch_id)
        expected = _self_play(v, row.beta) + row.reg_coef * _expected_regularizer(row.loss_type, v)
        assert row.total == pytest.approx(expected, rel=1e-9)
    single = losses.total_loss(table, "sppo_entropy", 0.1, 2.0).collect()
    matching = {r.batch_id: r.total for r in cells if (r.loss_type, r.beta, r.reg_coef) == ("sppo_entropy", 0.1, 2.0)}
    assert {r.batch_id: r.total for r in single} == pytest.approx(matching)


def test_single_probability_loss(table, data):
    got = table.agg(F.avg(losses.single_probability_loss(0.5)).alias("x")).first().x
    dw, dl, pull = data["pc"] - data["rc"], data["pr"] - data["rr"], (data["p"] - 0.5) / 0.5
    assert got == pytest.approx((((dw - pull) ** 2 + (dl + pull) ** 2) / 2).mean())


def test_single_probability_name_with_and_without_compat(table, data):
    grid = losses.loss_grid(table, [("sppo_single", 0.5, 0.1), ("sppo", 0.5, 0.1)]).collect()
    got = {(r.batch_id, r.loss_type): r.total for r in grid}
    for batch in range(5):
        v = _batch(data, batch)
        dw, dl, pull = v["pc"] - v["rc"], v["pr"] - v["rr"], (v["p"] - 0.5) / 0.5
        assert got[batch, "sppo_single"] == pytest.approx((((dw - pull) ** 2 + (dl + pull) ** 2) / 2).mean())
        assert got[batch, "sppo"] == pytest.approx(_self_play(v, 0.5))
    alias = losses.total_loss(table, "sppo_single", 0.5, 0.1, compat=True).collect()
    assert {r.batch_id: r.total for r in alias} == pytest.approx({b: got[b, "sppo"] for b in range(5)})


def test_unregularized_names(table, data):
    row = table.agg(F.avg(losses.unregularized_loss("sppo", 0.5)).alias("x")).first()
    v = data | {"lc": data["rc"], "lr": data["rr"]}
    assert row.x == pytest.approx(_self_play(v, 0.5))
    losses.unregularized_loss("sppo_single", 0.5)
    with pytest.raises(ValueError):
        losses.unregularized_loss("sppo_reversekl", 0.5)


@pytest.mark.parametrize(
    "name,expected",
    [
        ("sppo_forwardimportance10", losses.Regularizer("forward_importance", 10)),
        ("sppo_forward1reverse5", losses.Regularizer("forward_reverse", 10, 5.0)),
        ("sppo_forward1R5reverse5", losses.Regularizer("forward_reverse", 5, 5.0)),
        ("sppo_forward", losses.Regularizer("forward")),
    ],
)
def test_loss_names(name, expected):
    assert losses.parse_loss_type(name) == expected


@pytest.mark.parametrize("name", ["sppo_forward_importance", "rpo", "sigmoid", "sppo_forwardimportance", "sppo_forwardimportance1.5", "sppo_forward1reverse", ""])
def test_unknown_loss_names(name):
    with pytest.raises(ValueError):
        losses.parse_loss_type(name)


def test_plain_forward_needs_tokens(table):
    with pytest.raises(ValueError, match="token"):
        losses.batch_regularizer(table, "sppo_forward")


def test_clamp_keeps_nan(spark):
    df = spark.createDataFrame([(float("nan"),), (3.0,), (12.0,)], "x double")
    got = [r.c for r in df.select(clamp_max(F.col("x"), 10).alias("c")).collect()]
    assert np.isnan(got[0]) and got[1:] == [3.0, 10.0]


def test_metrics_and_log(table, data):
    for evaluation, loss_type, extra in ((True, "sppo_reversekl", "reg/reg_loss"), (False, None, "reg/entropy")):
        rows = losses.batch_metrics(
            table.withColumns({"logits_chosen": F.lit(1.0), "logits_rejected": F.lit(2.0)}), 0.1, loss_type, evaluation
        ).collect()
        keys = {r.key for r in rows}
        assert len(keys) == (11 if loss_type else 9) and extra in keys
        assert all(k.startswith("eval_") for k in keys - {extra}) == evaluation
    log = table.sparkSession.createDataFrame(
        [("r", "train", s, "k", float(s)) for s in range(1, 8)], "run string, split string, step long, key string, value double"
    )
    got = {r.log_window: (r.value, r.n_values) for r in losses.metric_log_mean(log, 3).collect()}
    assert got == {1: (2.0, 3), 2: (5.0, 3), 3: (7.0, 1)}


def test_forward_regularizer_counts_padding_as_zero(spark):
    rows = [(0, 0, p, [0.0, 0.0], 1, int(p < 3)) for p in range(4)]
    df = spark.createDataFrame(rows, "batch_id long, seq_id long, pos int, logits array<float>, label int, mask int")
    got = losses.forward_regularizer(df).first().reg_loss
    assert got == pytest.approx(2 * np.log(2) / 3)


def test_attached_columns_must_cover_every_row(spark):
    pairs = spark.createDataFrame([(0,), (1,)], "pair_id long")
    logps = spark.createDataFrame([(0, 1.0, 2.0, 3.0, None)], "pair_id long, " + ", ".join(f"{c} double" for c in joins.REFERENCE_LOGPS))
    row = joins.attach_ref_logps(pairs.filter("pair_id = 0"), logps).first()
    assert row.reference_chosen_logps == 1.0 and row.last_iterate_rejected_logps is None
    with pytest.raises(PySparkException, match="no row to attach"):
        joins.attach_ref_logps(pairs, logps).collect()


def test_reference_response_only_for_plain_forward(spark):
    df = spark.createDataFrame([(0,)], "prompt_idx long")
    reference = spark.createDataFrame([(0, "r")], "prompt_idx long, reference_response string")
    assert joins.add_reference_response(df, reference, "sppo_forward").first().reference_response == "r"
    for name in ("sppo", "sppo_forwardimportance10", "sppo_forwardreverse"):
        assert joins.add_reference_response(df, reference, name).columns == ["prompt_idx"]
