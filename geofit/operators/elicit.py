"""Answers to weights, for many respondents at once.

Tasks: task_id, repeat_of, attributes array<struct<indicator, a_raw, b_raw, a_pct, b_pct>>.
Answers: person, question_id, value; one per person and question.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geofit.functions.curves import desirability, params
from geofit.functions.stats import binomial_tail
from geofit.functions.units import format_value
from geofit.operators.lineage import cut
from geofit.operators.ordering import ordinal, top_k

ATTRIBUTES_PER_TASK = 5
MIN_PERCENTILE_GAP = 0.25
MIN_PHRASE_STEPS = 2
POOL_POPULATION = 40_000
PAIR_ROUNDS = 8


# ------------------------------------------------------------------------- asking


def phrase_rung(percentile: Column, phrases: Column) -> Column:
    """Which phrase of a ladder a percentile falls on; null without either."""
    n = F.size(phrases)
    return F.when(percentile.isNotNull() & (n > 0), F.greatest(F.lit(0), F.least(n - 1, F.floor(percentile * n).cast("int"))))


def describe(value: Column, percentile: Column, unit: Column, phrases: Column, phrasing: Column | None = None) -> Column:
    """Words where the indicator is `categorical` and has a ladder, else the formatted number."""
    rung = phrase_rung(percentile, phrases)
    worded = rung.isNotNull() if phrasing is None else rung.isNotNull() & (phrasing == "categorical")
    return F.coalesce(F.when(worded, F.get(phrases, rung)), format_value(value, unit))


def separates(x: Column) -> Column:
    """Far enough apart to have an opinion about, in percentile and, of a categorical attribute, in words."""
    gap = F.abs(x["a_pct"] - x["b_pct"]) >= MIN_PERCENTILE_GAP
    rungs = ~x["worded"] | F.coalesce(F.abs(x["a_rung"] - x["b_rung"]) >= MIN_PHRASE_STEPS, F.lit(False))
    return F.coalesce(gap & rungs, F.lit(False))


def dominated(attributes: Column) -> Column:
    """One side is at least as good on every attribute, or an attribute cannot be compared."""
    ahead = lambda hi, lo: F.forall(attributes, lambda x: F.coalesce(
        F.when(x["lower"], x[hi] <= x[lo]).otherwise(x[hi] >= x[lo]), F.lit(True)))
    unknown = F.exists(attributes, lambda x: x["a_raw"].isNull() | x["b_raw"].isNull())
    return unknown | ahead("a_raw", "b_raw") | ahead("b_raw", "a_raw")


def _draw(*parts) -> Column:
    """A hash that any engine can compute, used as the source of randomness."""
    return F.md5(F.concat_ws("|", *parts))


def neighbours(ids: DataFrame, rounds: int, seed: int) -> DataFrame:
    """round, a, b: in each round all ids stand in a random order, and the first and second, third and fourth, ... are a
    pair. Of an odd number the last is paired with the first, so nobody is left out.

    Places in the order are exact (ordering.ordinal), so a pair is two rows of one number wherever buckets end.
    """
    turns = ids.withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(rounds))))
    drawn = turns.withColumn("h", _draw(F.lit(str(seed)), "round", "geo_id"))
    placed = cut(ordinal(drawn, ["round"], [F.col("h"), F.col("geo_id")], "place").select("round", "geo_id", "place"))
    last = placed.groupBy("round").agg(F.max("place").alias("n")).where("n > 1 and n % 2 = 1")
    again = placed.where("place = 1").join(last, "round").select("round", "geo_id", (F.col("n") + 1).alias("place"))
    both = placed.unionByName(again).groupBy("round", F.floor((F.col("place") - 1) / 2).alias("pair")).agg(
        F.min_by("geo_id", "place").alias("a"), F.max_by("geo_id", "place").alias("b"))
    return both.where("a <> b").select("round", "a", "b")


def choice_candidates(features: DataFrame, universe: DataFrame, registry: DataFrame, attributes: list[str], seed: int = 7,
                      min_population: int = POOL_POPULATION, rounds: int = PAIR_ROUNDS) -> DataFrame:
    """Usable A/B pairs: a, b and the attributes shown.

    All eligible places are offered once a round, each with its neighbour in a random order: no place meets every other.
    """
    s = F.lit(str(seed))
    worded = F.coalesce(F.col("phrasing") == "categorical", F.lit(False))
    entries = registry.select("indicator_id", "phrases", worded.alias("worded"), (F.col("curve") == "lower_better").alias("lower"))
    places = cut(
        features.where(F.col("indicator_id").isin(*attributes) & F.col("value").isNotNull())
        .join(universe.where(F.col("population") > min_population).select("geo_id"), "geo_id", "left_semi")
        .join(entries, "indicator_id")
        .groupBy("geo_id")
        .agg(F.array_sort(F.collect_list(F.struct(
            F.col("indicator_id").alias("indicator"), "value", "percentile", "lower", "worded", phrase_rung(F.col("percentile"), F.col("phrases")).alias("rung")))).alias("at"))
        .where(F.size("at") == len(attributes))
    )
    met = neighbours(places.select("geo_id"), rounds, seed).select("a", "b").distinct()
    side = lambda name: places.select(F.col("geo_id").alias(name), F.struct("geo_id", "at").alias({"a": "x", "b": "y"}[name]))
    pairs = met.join(side("a"), "a").join(side("b"), "b")
    both = F.zip_with("x.at", "y.at", lambda a, b: F.struct(
        a["indicator"].alias("indicator"), a["value"].alias("a_raw"), b["value"].alias("b_raw"), a["percentile"].alias("a_pct"), b["percentile"].alias("b_pct"),
        a["lower"].alias("lower"), a["worded"].alias("worded"), a["rung"].alias("a_rung"), b["rung"].alias("b_rung")))
    draw = F.transform(F.filter(both, separates), lambda x: F.struct(_draw(s, "x.geo_id", "y.geo_id", x["indicator"]).alias("h"), x.alias("x")))
    shown = F.transform(F.slice(F.array_sort(draw), 1, ATTRIBUTES_PER_TASK), lambda r: r["x"])
    return (
        pairs.select("a", "b", shown.alias("attributes"))
        .where((F.size("attributes") == ATTRIBUTES_PER_TASK) & ~dominated(F.col("attributes")))
    )


def choice_pairs(candidates: DataFrame, tasks: int = 25, seed: int = 7) -> DataFrame:
    """The first tasks in random order, numbered."""
    picked = candidates.withColumn("h", _draw(F.lit(str(seed)), "a", "b")).orderBy("h").limit(tasks)
    number = F.row_number().over(Window.orderBy("h"))  # at most `tasks` rows
    keep = F.transform("attributes", lambda x: F.struct(*[x[c].alias(c) for c in ("indicator", "a_raw", "b_raw", "a_pct", "b_pct")]))
    return picked.select(F.concat(F.lit("choice_"), number.cast("string")).alias("task_id"), F.lit(None).cast("string").alias("repeat_of"), "a", "b", keep.alias("attributes"))


QUESTION = "Which would you rather live in?"
CHOICES = ("A", "B", "Genuinely can't choose")


def worded_tasks(tasks: DataFrame, registry: DataFrame) -> DataFrame:
    """Tasks as they are put to a person: the question, its answers, and each attribute's plain name with either side in
    words or figures, in the order shown."""
    entries = registry.select(F.col("indicator_id").alias("indicator"), F.coalesce("question_label", "label").alias("name"), "unit", "phrases", "phrasing")
    side = lambda k: describe(F.col(f"x.{k}_raw"), F.col(f"x.{k}_pct"), F.col("unit"), F.col("phrases"), F.col("phrasing"))
    shown = (
        tasks.select("task_id", F.posexplode("attributes").alias("n", "x")).withColumn("indicator", F.col("x.indicator")).join(entries, "indicator")
        .groupBy("task_id").agg(F.array_sort(F.collect_list(F.struct("n", "indicator", F.col("name").alias("label"), side("a").alias("a"), side("b").alias("b")))).alias("shown"))
    )
    put = tasks.join(shown, "task_id").withColumn("text", F.lit(QUESTION)).withColumn("options", F.array(*[F.lit(o) for o in CHOICES]))
    return put.select("task_id", "repeat_of", "text", "options", "shown", "attributes")


def repeat_tasks(tasks: DataFrame, k: int, seed: int = 7) -> DataFrame:
    """k tasks again, to see whether they are answered alike."""
    echo = tasks.orderBy(_draw(F.lit(str(seed)), F.lit("repeat"), "task_id")).limit(k)
    return tasks.unionByName(echo.withColumn("repeat_of", F.col("task_id")).withColumn("task_id", F.concat("task_id", F.lit("_repeat"))))


def baseline_values(features: DataFrame, baseline_ids: list[str]) -> DataFrame:
    """The home's value of every indicator, over both levels."""
    return features.where(F.col("geo_id").isin(*baseline_ids) & F.col("value").isNotNull()).groupBy("indicator_id").agg(
        F.max_by("value", "geo_id").alias("anchor_value"))


def anchored_items(indicators: DataFrame, anchors: DataFrame, registry: DataFrame) -> DataFrame:
    """One item per asked indicator; `anchor_value` is null (and to be warned about) where the home has none."""
    return (
        indicators.select("indicator_id").join(registry.select("indicator_id", "label", "unit"), "indicator_id")
        .join(anchors, "indicator_id", "left")
        .select(F.concat(F.lit("band_"), "indicator_id").alias("question_id"), "indicator_id", "label", format_value("anchor_value", "unit").alias("anchor"), "anchor_value")
    )


def calibration_pool(places: DataFrame, baseline_ids: list[str], near_states: list[str], near_population: int, n: int, biggest: int = 18, nearby: int = 12, seed: int = 11) -> DataFrame:
    """Places a household may know: the biggest, the biggest nearby and its own, shuffled."""
    order = [F.desc_nulls_last("population"), F.asc("geo_id")]
    big = places.orderBy(*order).limit(biggest)
    near = places.where(F.col("state_usps").isin(*near_states) & (F.col("population") > near_population)).orderBy(*order).limit(nearby)
    own = places.where(F.col("geo_id").isin(*baseline_ids))
    return big.unionByName(near).unionByName(own).dropDuplicates(["geo_id"]).orderBy(_draw(F.lit(str(seed)), "geo_id")).limit(n)


# ------------------------------------------------------------------------- choices to weights


def choices(tasks: DataFrame, answers: DataFrame) -> DataFrame:
    """Answered tasks: person, task_id, repeat_of, value A or B, attributes."""
    given = answers.groupBy("person", "question_id").agg(F.max("value").alias("value")).where(F.col("value").isin("A", "B"))
    return given.join(tasks.withColumnRenamed("task_id", "question_id"), "question_id").withColumnRenamed("question_id", "task_id")


def choice_matrix(tasks: DataFrame, answers: DataFrame, registry: DataFrame) -> DataFrame:
    """person, task_id, chose_a, indicator_id, diff: a - b, turned so that more is better.

    Repeats only test consistency and are left out; a missing side is a difference of 0.
    """
    diff = F.when(F.col("curve") == "lower_better", F.col("x.b_raw") - F.col("x.a_raw")).otherwise(F.col("x.a_raw") - F.col("x.b_raw"))
    return (
        choices(tasks, answers).where(F.col("repeat_of").isNull())
        .select("person", "task_id", (F.col("value") == "A").alias("chose_a"), F.explode("attributes").alias("x"))
        .withColumn("indicator_id", F.col("x.indicator"))
        .join(registry.select("indicator_id", "curve"), "indicator_id", "left")
        .select("person", "task_id", "chose_a", "indicator_id", F.coalesce(diff, F.lit(0.0)).alias("diff"))
    )


def contradictions(tasks: DataFrame, answers: DataFrame) -> DataFrame:
    """Repeats answered differently from the task they repeat."""
    c = choices(tasks, answers)
    first = c.where(F.col("repeat_of").isNull()).select("person", F.col("task_id").alias("repeat_of"), F.col("value").alias("first_value"))
    return c.where(F.col("repeat_of").isNotNull()).join(first, ["person", "repeat_of"]).where("value <> first_value").select(
        "person", F.col("repeat_of").alias("task_id"))


L2 = 0.3
MIN_FIT_CHOICES = 4
MIN_LOO_CHOICES = 8


#: Numbers in one stack of fits: people and folds times tasks times attributes. Answers that are Python objects at a time.
STACK, ANSWERS = 250_000, 20_000
FIT_SCHEMA = "person string, n_choices int, accuracy double, cv_accuracy double, weights map<string,double>, coefficients map<string,double>"


def stacked_fits(x, y, keep, l2: float = L2, steps: int = 50):
    """Ridge logistic fits (no intercept) of a stack at once, by Newton's method: coefficients, means and spreads.

    x: fits, tasks, attributes; y and keep: fits, tasks. Each fit is of the tasks that it keeps, scaled by their mean and
    spread (an attribute without spread by 1).
    """
    import numpy as np

    n = keep.sum(axis=1, keepdims=True)
    mean = np.einsum("ft,fta->fa", keep, x) / n
    spread = np.sqrt(np.einsum("ft,fta->fa", keep, (x - mean[:, None]) ** 2) / n)
    spread[spread == 0] = 1.0
    z = (x - mean[:, None]) / spread[:, None]
    beta = np.zeros(mean.shape)
    open_ = np.arange(len(x))
    for _ in range(steps):
        zo, ko, no = z[open_], keep[open_], n[open_]
        p = 1.0 / (1.0 + np.exp(-np.clip(np.einsum("fta,fa->ft", zo, beta[open_]), -30, 30)))
        grad = np.einsum("ft,fta->fa", ko * (y[open_] - p), zo) / no - l2 * beta[open_]
        live = np.abs(grad).max(axis=1, initial=0.0) >= 1e-12
        if not live.any():
            break
        open_, zo, grad = open_[live], zo[live], grad[live]
        curve = (ko * p * (1 - p))[live] / no[live]
        hess = np.einsum("ft,fta,ftb->fab", curve, zo, zo, optimize=True) + l2 * np.eye(x.shape[2])
        beta[open_] += np.linalg.solve(hess, grad[:, :, None])[:, :, 0]
    return beta, mean, spread


def fit_choices(matrix: DataFrame) -> DataFrame:
    """Importance of each attribute from a person's choices, and how well it predicts held-out ones.

    A person is one row of answered tasks, which the questionnaire bounds. A task takes people of an Arrow batch, a bounded
    number of answers at a time, and solves the fits and leave-one-out refits of those who answered as many tasks on as
    many attributes as one stack; a stack is bounded too, by people and by a person's folds.
    """
    people = matrix.groupBy("person").agg(F.array_sort(F.collect_list(F.struct("task_id", "indicator_id", F.col("chose_a").cast("int").alias("a"), "diff"))).alias("said"))
    min_fit, min_loo, limit, answers = MIN_FIT_CHOICES, MIN_LOO_CHOICES, STACK, ANSWERS
    solve = stacked_fits

    def fit(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        kind = pa.schema([("person", pa.string()), ("n_choices", pa.int32()), ("accuracy", pa.float64()), ("cv_accuracy", pa.float64()),
                          ("weights", pa.map_(pa.string(), pa.float64())), ("coefficients", pa.map_(pa.string(), pa.float64()))])

        def stacks(batch):
            """People of one shape: their numbers, names of attributes, x and y."""
            by: dict = {}
            for row, said in enumerate(batch.column(1).to_pylist()):
                tasks = {t: i for i, t in enumerate(dict.fromkeys(s["task_id"] for s in said))}
                names = sorted({s["indicator_id"] for s in said})
                at = {m: i for i, m in enumerate(names)}
                x, y = np.zeros((len(tasks), len(names))), np.zeros(len(tasks))
                for s in reversed(said):  # a task's first row says what was chosen
                    x[tasks[s["task_id"]], at[s["indicator_id"]]] += s["diff"]
                    y[tasks[s["task_id"]]] = s["a"]
                by.setdefault(x.shape, []).append((row, names, x, y))
            for (n, k), own in by.items():
                step = max(1, limit // ((n + 1) * n * k))
                for lo in range(0, len(own), step):
                    yield own[lo: lo + step]

        def parts(batch):
            """The batch in runs of people with so many answers between them, one person at least."""
            sizes, lo, held = pc.list_value_length(batch.column(1)).to_pylist(), 0, 0
            for i, n in enumerate(sizes):
                if held and held + n > answers:
                    yield batch.slice(lo, i - lo)
                    lo, held = i, 0
                held += n
            yield batch.slice(lo)

        for batch in (p for b in batches for p in parts(b)):
            out = [None] * batch.num_rows
            persons = batch.column(0).to_pylist()
            for own in stacks(batch):
                x, y = np.stack([o[2] for o in own]), np.stack([o[3] for o in own])
                people, n, k = x.shape
                beta, accuracy, cv = np.zeros((people, k)), np.zeros(people), [None] * people
                if n >= min_fit:
                    beta, mean, spread = solve(x, y, np.ones_like(y))
                    guess = np.einsum("fta,fa->ft", (x - mean[:, None]) / spread[:, None], beta) > 0
                    accuracy = (guess == (y > 0)).mean(axis=1)
                if n >= min_loo:
                    folds = np.repeat(np.arange(people), n)
                    held = np.tile(np.arange(n), people)
                    hit, step = np.zeros(people * n), max(1, limit // (n * k))
                    for lo in range(0, people * n, step):
                        f, h = folds[lo: lo + step], held[lo: lo + step]
                        keep = np.ones((len(f), n))
                        keep[np.arange(len(f)), h] = 0.0
                        # The held-out choice is scaled by the others' mean and spread.
                        b, m, s = solve(x[f], y[f], keep)
                        hit[lo: lo + step] = (np.einsum("fa,fa->f", (x[f, h] - m) / s, b) > 0) == (y[f, h] > 0)
                    cv = hit.reshape(people, n).mean(axis=1).tolist()
                for i, (row, names, _, _) in enumerate(own):
                    size = float(np.abs(beta[i]).sum())
                    fitted = n >= min_fit
                    out[row] = (persons[row], n, float(accuracy[i]), cv[i], dict(zip(names, (np.abs(beta[i]) / size).tolist())) if size > 0 else {}, dict(zip(names, beta[i].tolist())) if fitted else {})
            columns = list(zip(*out)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array([list(v.items()) for v in c] if k > 3 else c, f.type) for k, (c, f) in enumerate(zip(columns, kind))], schema=kind)

    return people.mapInArrow(fit, FIT_SCHEMA)


def fit_gradient(matrix: DataFrame, fits: DataFrame, l2: float = L2) -> DataFrame:
    """person, indicator_id, n_choices, gradient: of the penalised likelihood at the fitted coefficients. It is zero at the
    only optimum, so it shows that a fit is one."""
    live = fits.where(F.col("n_choices") >= MIN_FIT_CHOICES)
    beta = live.select("person", "n_choices", F.explode("coefficients").alias("indicator_id", "beta"))
    chosen = matrix.groupBy("person", "task_id").agg(F.max("chose_a").cast("int").alias("y"))
    said = matrix.groupBy("person", "task_id", "indicator_id").agg(F.sum("diff").alias("diff"))
    cells = chosen.join(beta, "person").join(said, ["person", "task_id", "indicator_id"], "left").withColumn("diff", F.coalesce("diff", F.lit(0.0)))
    scale = cells.groupBy("person", "indicator_id").agg(F.avg("diff").alias("mean"), F.stddev_pop("diff").alias("spread"))
    z = cells.join(scale, ["person", "indicator_id"]).withColumn("z", (F.col("diff") - F.col("mean")) / F.when(F.col("spread") > 0, F.col("spread")).otherwise(1.0))
    p = z.groupBy("person", "task_id").agg((1 / (1 + F.exp(-F.sum(F.col("z") * F.col("beta"))))).alias("p"))
    slope = F.avg((F.col("y") - F.col("p")) * F.col("z")) - l2 * F.first("beta")
    return z.join(p, ["person", "task_id"]).groupBy("person", "indicator_id", "n_choices").agg(slope.alias("gradient"))


def is_informative(n="n_choices", accuracy="accuracy", cv="cv_accuracy") -> Column:
    n, accuracy, cv = F.col(n), F.col(accuracy), F.col(cv)
    return (n >= 8) & F.when(cv.isNull(), accuracy >= 0.65).otherwise(cv >= 0.68)


def normalise_budget(weights: DataFrame, by: str = "person", total: float = 100.0) -> DataFrame:
    """Weights scaled to 100 and rounded to cents; a person with nothing to spread drops out."""
    sums = weights.groupBy(by).agg(F.sum("weight").alias("__t"))
    return weights.join(sums, by).where(F.col("__t") > 0).withColumn("weight", F.round(F.col("weight") / F.col("__t") * total, 2)).drop("__t")


def domain_weights_from_choices(fits: DataFrame, registry: DataFrame) -> DataFrame:
    """Mean indicator weight per domain, so a domain gains nothing from more attributes."""
    means = (
        fits.select("person", F.explode("weights").alias("indicator_id", "w"))
        .join(registry.select("indicator_id", "domain"), "indicator_id")
        .groupBy("person", "domain").agg(F.avg("w").alias("weight"))
    )
    return normalise_budget(means)


REVEALED_SHARE = 0.65


def blend_weights(stated: DataFrame, revealed: DataFrame, share: float = REVEALED_SHARE) -> DataFrame:
    """Blended where choices covered the domain, stated where they did not; back to 100."""
    key = ["person", "domain"]
    both = stated.select(*key, F.col("weight").alias("s")).join(revealed.select(*key, F.col("weight").alias("r")), key, "full_outer")
    s = F.coalesce("s", F.lit(0.0))
    mixed = both.select(*key, F.when(F.col("r").isNotNull(), share * F.col("r") + (1 - share) * s).otherwise(s).alias("weight"))
    return normalise_budget(mixed)


def uncovered_domains(stated: DataFrame, revealed: DataFrame, data_less: DataFrame) -> DataFrame:
    """Domains weighted from the stated budget alone, and those no data can move."""
    alone = stated.join(revealed.select("person", "domain"), ["person", "domain"], "left_anti").join(data_less.select("domain"), "domain", "left_anti")
    dead = stated.join(data_less.select("domain"), "domain", "left_semi")
    return alone.select("person", "domain", F.lit("stated only").alias("note")).unionByName(dead.select("person", "domain", F.lit("no data").alias("note")))


def stated_vs_revealed(stated: DataFrame, revealed: DataFrame, threshold: float = 10.0) -> DataFrame:
    key = ["person", "domain"]
    s, r = F.coalesce("s", F.lit(0.0)), F.coalesce("r", F.lit(0.0))
    both = stated.select(*key, F.col("weight").alias("s")).join(revealed.select(*key, F.col("weight").alias("r")), key, "full_outer")
    return both.where(F.abs(s - r) >= threshold).select(*key, s.alias("stated"), r.alias("revealed"), F.when(r > s, "more").otherwise("less").alias("direction"))


def task_margins(tasks, answers, domain_weights: DataFrame, registry: DataFrame, overrides: DataFrame) -> DataFrame:
    """What each person's weights say about each of their choices: margin (a - b) and whether it hit.

    A domain's weight is split over the attributes it shows in the task.
    """
    over = overrides.select("person", "indicator_id", "indifferent", F.col("curve").alias("oc"), F.col("params").alias("op"))
    seen = (
        choices(tasks, answers).where(F.col("repeat_of").isNull())
        .select("person", "task_id", "value", F.explode("attributes").alias("x")).withColumn("indicator_id", F.col("x.indicator"))
        .join(registry.select("indicator_id", "domain", "curve", "params"), "indicator_id")
        .join(over, ["person", "indicator_id"], "left").where(~F.coalesce("indifferent", F.lit(False)))
        .withColumn("curve", F.coalesce("oc", "curve")).withColumn("params", F.coalesce("op", "params"))
        .withColumn("gap", desirability(value=F.col("x.a_raw"), percentile=F.col("x.a_pct")) - desirability(value=F.col("x.b_raw"), percentile=F.col("x.b_pct")))
        .where(F.col("gap").isNotNull())
        .groupBy("person", "task_id", "value", "domain").agg(F.avg("gap").alias("gap"))
    )
    return (
        seen.join(domain_weights.where(F.col("weight") > 0), ["person", "domain"])
        .groupBy("person", "task_id", "value").agg(F.sum(F.col("weight") * F.col("gap")).alias("margin"))
        .where(F.abs("margin") > 1e-9)
        .withColumn("hit", F.when(F.col("margin") > 0, "A").otherwise("B") == F.col("value"))
    )


def agreement(margins: DataFrame) -> DataFrame:
    """Share of choices the weights predict, with the chance a coin would do as well."""
    sums = margins.groupBy("person").agg(F.count(F.lit(1)).alias("n_choices"), F.count_if("hit").alias("correct"))
    return sums.withColumn("rate", F.col("correct") / F.col("n_choices")).withColumn("p_value", binomial_tail(F.col("correct"), F.col("n_choices"))).withColumn(
        "significant", (F.col("n_choices") >= 8) & (F.col("p_value") < 0.05))


def agreement_misses(margins: DataFrame, show: int = 5) -> DataFrame:
    """The choices that went against the weights most clearly."""
    missed = margins.where(~F.col("hit"))
    return top_k(missed, ["person"], [F.round(F.abs("margin"), 9).desc(), F.asc("task_id")], show, "n").select("person", "n", "task_id", "margin")


# ------------------------------------------------------------------------- answers to curves and limits

STEP_FRACTION, BAND_HALF_WIDTH = 0.6, 0.5


def band_from_offset(answers: DataFrame, anchors: DataFrame, stats: DataFrame) -> DataFrame:
    """Overrides from "compared to home" answers: person, indicator_id, offset (null: don't care).

    The centre moves 0.6 national deviations per step; the band is one deviation wide and does
    not start below the lowest value there is.
    """
    unit = F.when(F.col("std") != 0, F.col("std")).otherwise(F.abs("mean") * 0.1)
    centre, half = F.col("anchor_value") + F.col("offset") * unit * STEP_FRACTION, unit * BAND_HALF_WIDTH
    lo = F.greatest(centre - half, F.col("floor"))
    curve = params(lo=F.round(lo, 2), hi=F.round(centre + half, 2), shoulder=F.round(half * 2, 2))
    joined = answers.join(stats, "indicator_id").join(anchors, "indicator_id", "left").where(F.col("offset").isNull() | F.col("anchor_value").isNotNull())
    return joined.select("person", "indicator_id", F.col("offset").isNull().alias("indifferent"),
                         F.when(F.col("offset").isNotNull(), "ideal_band").alias("curve"), F.when(F.col("offset").isNotNull(), curve).alias("params"))


def band_from_option(answers: DataFrame, options: DataFrame) -> DataFrame:
    """Overrides from a pictured size: person, question_id, value; options: question_id, value, centre, spread, indicator_id."""
    c, s = F.col("centre"), F.coalesce("spread", F.lit(2.5))
    lo, hi = c / s, c * s
    curve = params(lo=F.round(lo, 2), hi=F.round(hi, 2), shoulder=F.round(hi - lo, 2), shoulder_lo=F.round(lo * 0.75, 2))
    return answers.join(options, ["question_id", "value"]).select(
        "person", "indicator_id", c.isNull().alias("indifferent"), F.when(c.isNotNull(), "ideal_band").alias("curve"), F.when(c.isNotNull(), curve).alias("params"))


def knockouts_from_answers(answers: DataFrame, options: DataFrame) -> DataFrame:
    """Deal-breakers as numbers. An answer no option translates raises; "no limit" is left out.

    options: question_id, value, threshold (null: no limit), indicator_id, op.
    """
    rules = options.select("question_id", "indicator_id", "op").distinct()
    table = options.select("question_id", "value", "threshold", F.lit(True).alias("known"))
    bad = F.raise_error(F.concat_ws(" ", F.lit("no numeric equivalent for"), "question_id", "value")).cast("double")
    return (
        answers.where(F.coalesce("value", F.lit("")) != "").join(rules, "question_id").join(table, ["question_id", "value"], "left")
        .withColumn("threshold", F.when(F.col("known").isNull(), bad).otherwise(F.col("threshold")))
        .where(F.col("threshold").isNotNull())
        .select("person", "question_id", "indicator_id", F.coalesce("op", F.lit("max")).alias("op"), "threshold")
    )


def sensitive_opt_in(labels: DataFrame, mapping: DataFrame) -> DataFrame:
    """Chosen labels to indicators; an unmapped label raises, "none of these" (null) drops out.

    labels: person, chosen array<string>; mapping: label, indicator_id.
    """
    m = mapping.withColumn("known", F.lit(True))
    bad = F.raise_error(F.concat(F.lit("option names no indicator: "), "label")).cast("string")
    return (
        labels.select("person", F.explode("chosen").alias("label")).join(m, "label", "left")
        .withColumn("indicator_id", F.when(F.col("known").isNull(), bad).otherwise(F.col("indicator_id")))
        .where(F.col("indicator_id").isNotNull()).select("person", "label", "indicator_id")
    )


def forfeit_sensitive(weights: DataFrame, opted: DataFrame, domain: str = "sensitive") -> DataFrame:
    """The sensitive domain's points go back to the rest for people who opted into nothing."""
    some = opted.select("person").distinct().withColumn("__o", F.lit(True))
    tagged = weights.join(some, "person", "left").withColumn("__lose", (F.col("domain") == domain) & F.col("__o").isNull() & (F.col("weight") > 0))
    losers = tagged.where("__lose").select("person").distinct()
    spread = normalise_budget(tagged.join(losers, "person", "left_semi").withColumn("weight", F.when(F.col("__lose"), 0.0).otherwise(F.col("weight"))).select("person", "domain", "weight"))
    return weights.join(losers, "person", "left_anti").select("person", "domain", "weight").unionByName(spread)


def domains_without_data(registry: DataFrame, features: DataFrame) -> DataFrame:
    have = features.where(F.col("value").isNotNull()).select("indicator_id").distinct()
    return registry.select("domain").distinct().join(registry.join(have, "indicator_id", "left_semi").select("domain").distinct(), "domain", "left_anti")


def locked_weights(weights: DataFrame, domains: DataFrame) -> DataFrame:
    """Pinned domains take their pinned weight for everyone; the rest is scaled around them to 100."""
    pins = domains.where(F.col("locked") & F.col("scoring")).select("domain", F.col("default_weight").alias("pin"))
    table = pins.agg(F.collect_list(F.struct("domain", F.col("pin").alias("weight"))).alias("p")).withColumn("__k", F.lit(1))
    people = weights.select("person").distinct().withColumn("__k", F.lit(1))
    pinned = people.join(table, "__k").select("person", F.inline("p"))
    return normalise_budget(weights.join(pins, "domain", "left_anti").select("person", "domain", "weight").unionByName(pinned))


STATED_WEIGHT = 0.15


def indicator_weights(fits: DataFrame, overrides: DataFrame) -> DataFrame:
    """Fitted weights where the fit is informative, else a set weight for each stated preference."""
    good = fits.where(is_informative() & (F.size("weights") > 0))
    fitted = good.select("person", F.explode("weights").alias("indicator_id", "weight")).withColumn("weight", F.round("weight", 5))
    stated = overrides.where(~F.col("indifferent")).join(good.select("person"), "person", "left_anti").select("person", "indicator_id", F.lit(STATED_WEIGHT).alias("weight"))
    return fitted.unionByName(stated)


def final_domain_weights(stated: DataFrame, fits: DataFrame, registry: DataFrame, opted: DataFrame, domains: DataFrame | None = None,
                         lock_always: bool = True, sensitive: str = "sensitive") -> DataFrame:
    """person, domain, weight: blended for informative fits, stated otherwise, pins and opt-ins applied."""
    good = fits.where(is_informative())
    revealed = domain_weights_from_choices(good, registry)
    budget = normalise_budget(stated)
    known = revealed.select("person").distinct()
    blended = blend_weights(budget.join(known, "person", "left_semi"), revealed)
    plain = budget.join(known, "person", "left_anti").select("person", "domain", "weight")
    if domains is not None:
        blended = locked_weights(blended, domains)
        plain = locked_weights(plain, domains) if lock_always else plain
    return forfeit_sensitive(blended.select("person", "domain", "weight").unionByName(plain.select("person", "domain", "weight")), opted, sensitive)


def build_profile(weights: DataFrame, iw: DataFrame, overrides: DataFrame, knockouts: DataFrame, opted: DataFrame, quality: DataFrame) -> DataFrame:
    """One nested row per person, as a profile is stored. Every list is bounded by the registry."""
    pack = lambda df, key, value, name: df.groupBy("person").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, value)))).alias(name))
    over = overrides.withColumn("o", F.struct("indifferent", "curve", "params"))
    rules = knockouts.groupBy("person").agg(F.array_sort(F.collect_list(F.struct(F.col("indicator_id").alias("indicator"), "op", F.col("threshold").alias("value")))).alias("knockouts"))
    sens = opted.groupBy("person").agg(F.array_sort(F.collect_set("indicator_id")).alias("sensitive_indicators"))
    overrides_map = over.groupBy("person").agg(F.map_from_entries(F.collect_list(F.struct("indicator_id", "o"))).alias("curve_overrides"))
    out = quality.join(pack(weights, "domain", "weight", "domain_weights"), "person", "left").join(pack(iw, "indicator_id", "weight", "indicator_weights"), "person", "left")
    for part in (overrides_map, rules, sens):
        out = out.join(part, "person", "left")
    return out.withColumnRenamed("person", "profile_id")
