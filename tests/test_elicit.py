import numpy as np
import pytest

from geofit.operators import elicit as el
from geofit.operators import visitors as vis
from geofit.operators.registry import local_frame, registry_frame

NAMES = [f"x{i}" for i in range(8)]
REG = [dict(indicator_id=n, domain="one" if i < 6 else "two", geo_level="county", unit="index", curve="higher_better") for i, n in enumerate(NAMES)]
TASK = "task_id string, repeat_of string, attributes array<struct<indicator:string,a_raw:double,b_raw:double,a_pct:double,b_pct:double>>"


def survey(spark, people, n_tasks, seed=0):
    """people: name -> utility weights (or None for coin flips)."""
    rng = np.random.default_rng(seed)
    a, b = rng.random((2, n_tasks, len(NAMES)))
    tasks = [(f"t{t}", None, [(n, float(a[t, i]), float(b[t, i]), float(a[t, i]), float(b[t, i])) for i, n in enumerate(NAMES)]) for t in range(n_tasks)]
    answers = []
    for who, w in people.items():
        for t in range(n_tasks):
            side = rng.random() < 0.5 if w is None else (a[t] - b[t]) @ w > 0
            answers.append((who, f"t{t}", "A" if side else "B"))
    return spark.createDataFrame(tasks, TASK), spark.createDataFrame(answers, "person string, question_id string, value string"), a - b


def test_fit_reaches_the_penalised_optimum(spark):
    w = np.array([3.0, 1, 0, 0, 0, 0, 0, -2])
    tasks, answers, diff = survey(spark, {"p": w}, 30)
    row = el.fit_choices(el.choice_matrix(tasks, answers, registry_frame(spark, REG))).first()
    beta = np.array([row["coefficients"][n] for n in NAMES])
    x = (diff - diff.mean(0)) / diff.std(0)
    y = (diff @ w > 0).astype(float)
    grad = x.T @ (y - 1 / (1 + np.exp(-(x @ beta)))) / len(y) - 0.3 * beta
    assert np.abs(grad).max() < 1e-9
    assert sum(row["weights"].values()) == pytest.approx(1.0) and row["cv_accuracy"] > 0.68


def test_equal_preferences_give_equal_domains(spark):
    tasks, answers, _ = survey(spark, {"p": np.ones(8)}, 300, seed=5)
    fit = el.fit_choices(el.choice_matrix(tasks, answers, registry_frame(spark, REG)))
    got = [r["weight"] for r in el.domain_weights_from_choices(fit, registry_frame(spark, REG)).collect()]
    assert max(got) / min(got) < 1.6


def test_coin_flippers_are_rarely_believed(spark):
    tasks, answers, _ = survey(spark, {f"r{i}": None for i in range(30)}, 24, seed=9)
    fit = el.fit_choices(el.choice_matrix(tasks, answers, registry_frame(spark, REG)))
    assert fit.where(el.is_informative()).count() <= 7


def test_unmapped_answers_raise(spark):
    labels = spark.createDataFrame([("p", ["Typo"])], "person string, chosen array<string>")
    with pytest.raises(Exception, match="names no indicator"):
        el.sensitive_opt_in(labels, local_frame(spark, [("Politics", "s")], "label string, indicator_id string")).collect()
    answers = spark.createDataFrame([("p", "q", "Under an hour")], "person string, question_id string, value string")
    options = local_frame(spark, [("q", "No limit", None, "miles", "max")], "question_id string, value string, threshold double, indicator_id string, op string")
    with pytest.raises(Exception, match="no numeric equivalent"):
        el.knockouts_from_answers(answers, options).collect()


def test_whole_points_sum_to_100_and_zero_stays_zero(spark):
    rng = np.random.default_rng(1)
    rows = [(f"p{i}", f"s{j}", float(v)) for i in range(20) for j, v in enumerate(np.where(rng.random(7) < 0.3, 0, rng.random(7)))]
    got = vis.largest_remainder(spark.createDataFrame(rows, "person string, slot string, weight double"), "person").toPandas()
    assert (got.groupby("person")["points"].sum() == 100).all()
    zero = {(p, s) for p, s, w in rows if w == 0}
    assert all(r.points == 0 for r in got.itertuples() if (r.person, r.slot) in zero)


def test_search_puts_prefixes_first(spark):
    u = spark.createDataFrame([("1", "Fort Ann town", "NY", 900), ("2", "Annapolis city", "MD", 40000), ("3", "Ann Arbor city", "MI", 120000)], "geo_id string, name string, state_usps string, population long")
    q = spark.createDataFrame([(1, " ANN"), (2, "a"), (3, "ny")], "query_id int, q string")
    got = {}
    for r in vis.place_search(q, u).orderBy("query_id", "n").collect():
        got.setdefault(r["query_id"], []).append(r["geo_id"])
    assert got == {1: ["3", "2", "1"], 3: ["1"]}


def test_stacked_fits_equal_single_refits(spark):
    rng = np.random.default_rng(3)
    rows = []
    for person, (n, k) in {"a": (12, 3), "b": (12, 3), "c": (9, 5), "d": (5, 2), "e": (2, 2), "f": (12, 3)}.items():
        x = rng.normal(size=(n, k)) * [1, 50, 0.01, 3, 7][:k]
        if person == "f":
            x[:, 1] = 4.0  # no spread
        chosen = [bool(c) for c in rng.random(n) < 0.5]
        rows += [(person, f"t{t}", chosen[t], f"i{i}", float(x[t, i])) for t in range(n) for i in range(k)]
    matrix = spark.createDataFrame(rows, "person string, task_id string, chose_a boolean, indicator_id string, diff double")

    def single(x, y):
        mean, spread = x.mean(axis=0), x.std(axis=0)
        spread[spread == 0] = 1
        z, beta = (x - mean) / spread, np.zeros(x.shape[1])
        for _ in range(60):
            p = 1 / (1 + np.exp(-z @ beta))
            beta += np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z / len(y) + 0.3 * np.eye(len(beta)), z.T @ (y - p) / len(y) - 0.3 * beta)
        return beta, mean, spread

    for r in el.fit_choices(matrix).collect():
        own = {}
        for p, t, a, i, d in rows:
            if p == r.person:
                own.setdefault(t, ({}, a))[0][i] = d
        x, y = np.array([[v[0][i] for i in sorted(v[0])] for v in own.values()]), np.array([float(v[1]) for v in own.values()])
        assert r.n_choices == len(y)
        if len(y) < 4:
            assert r.coefficients == {} and r.weights == {} and r.cv_accuracy is None and r.accuracy == 0
            continue
        beta, mean, spread = single(x, y)
        assert np.allclose([r.coefficients[i] for i in sorted(r.coefficients)], beta) and np.isclose(sum(r.weights.values()), 1)
        assert np.isclose(r.accuracy, np.mean(((x - mean) / spread @ beta > 0) == (y > 0)))
        if len(y) < 8:
            assert r.cv_accuracy is None
            continue
        hits = 0
        for i in range(len(y)):
            keep = np.arange(len(y)) != i
            beta, mean, spread = single(x[keep], y[keep])
            hits += ((x[i] - mean) / spread @ beta > 0) == (y[i] > 0)
        assert np.isclose(r.cv_accuracy, hits / len(y))
    slopes = el.fit_gradient(matrix, el.fit_choices(matrix)).collect()
    assert len(slopes) == 3 + 3 + 5 + 2 + 3 and all(abs(r.gradient) < 1e-9 for r in slopes)


def test_fits_hold_a_bounded_number_of_answers(spark, monkeypatch):
    """Small runs and stacks give the fits that one stack gives; a person's folds are cut too."""
    tasks, answers, _ = survey(spark, {f"r{i}": np.eye(8)[i % 8] for i in range(9)}, 20, seed=2)
    matrix = el.choice_matrix(tasks, answers, registry_frame(spark, REG)).repartition(1)
    whole = {r.person: r for r in el.fit_choices(matrix).collect()}
    monkeypatch.setattr(el, "STACK", 500)
    monkeypatch.setattr(el, "ANSWERS", 200)
    cut = {r.person: r for r in el.fit_choices(matrix).collect()}
    assert cut.keys() == whole.keys()
    for p, r in cut.items():
        assert (r.n_choices, r.accuracy, r.cv_accuracy) == (whole[p].n_choices, whole[p].accuracy, whole[p].cv_accuracy)
        assert r.coefficients == pytest.approx(whole[p].coefficients)


def test_worded_tasks_put_the_question_and_its_three_answers(spark):
    entries = [dict(indicator_id="cost", domain="one", geo_level="county", unit="usd", curve="lower_better", label="Rent", question_label="What it costs"),
               dict(indicator_id="sun", domain="one", geo_level="county", unit="index", curve="higher_better", label="Sun", phrases=["dull", "fair", "bright"], phrasing="categorical")]
    tasks = spark.createDataFrame([("t1", None, [("sun", 1.0, 9.0, 0.1, 0.9), ("cost", 500.0, 12000.0, 0.2, 0.8)])], TASK)
    (row,) = el.worded_tasks(tasks, registry_frame(spark, entries)).collect()
    assert (row.task_id, row.repeat_of, row.text, row.options) == ("t1", None, "Which would you rather live in?", ["A", "B", "Genuinely can't choose"])
    assert [tuple(s) for s in row.shown] == [(0, "sun", "Sun", "dull", "bright"), (1, "cost", "What it costs", "$500", "$12k")]
    assert [x.indicator for x in row.attributes] == ["sun", "cost"]
