"""Label reliability: votes, Dawid-Skene and one-coin models, evaluation, conformal sets.

Annotations are rows (spec, observer, label); classes are given in their canonical order. Posteriors
are long tables (spec, class, p).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hydrolake.functions import scalars as S
from hydrolake.operators.lineage import cut

FLOOR = 1e-12
#: Ranges that scores are counted in, and groups whose states are broadcast.
RANGES, BROADCAST_GROUPS = 4096, 100_000


def _order(classes: list[str], column: str = "class"):
    return S.lookup(F.col(column), {c: k for k, c in enumerate(classes)})


def majority_vote(ann: DataFrame, classes: list[str]) -> DataFrame:
    """(spec, label): most votes, ties to the first class."""
    votes = ann.groupBy("spec", "label").agg(F.count("*").alias("n"))
    return votes.groupBy("spec").agg(F.min_by("label", F.struct(-F.col("n"), _order(classes, "label"))).alias("label"))


def _check(ann: DataFrame, classes: list[str]) -> None:
    if len(classes) < 2 or len(set(classes)) != len(classes):
        raise ValueError("two distinct classes at least")
    if not ann.filter(~F.col("label").isin(classes) | F.col("label").isNull()).isEmpty():
        raise ValueError("a label is not among the classes")


def _start(ann: DataFrame, classes: list[str]) -> DataFrame:
    """Shares of votes, one row for each specimen and class."""
    own = ann.groupBy("spec").agg(F.count("*").alias("n"), *[F.count_if(F.col("label") == c).alias(f"c{k}") for k, c in enumerate(classes)])
    return own.select("spec", F.explode(F.array(*[F.struct(F.lit(c).alias("class"), (F.col(f"c{k}") / F.col("n")).alias("p")) for k, c in enumerate(classes)])).alias("x")).select("spec", "x.*")


def _posterior(log_w: DataFrame) -> tuple[DataFrame, float]:
    """Normalised posteriors and the log likelihood, from unnormalised logs per (spec, class) of patterns that stand for `w` specimens."""
    w = W.partitionBy("spec")
    peak = log_w.withColumn("m", F.max("lw").over(w))
    out = cut(peak.withColumn("z", F.sum(F.exp(F.col("lw") - F.col("m"))).over(w)).select("spec", "w", "class", (F.exp(F.col("lw") - F.col("m")) / F.col("z")).alias("p"), (F.col("m") + F.ln("z")).alias("ll")))
    total = out.groupBy("spec").agg(F.max(F.col("ll") * F.col("w")).alias("ll")).agg(F.sum("ll")).first()[0]
    return out.drop("ll"), total


def _patterns(ann: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(annotations of one specimen of each pattern with `w`, how many have it; (spec, of): the specimen that stands for each).

    Specimens with the same labels by the same observers have the same posteriors. A pattern is told by its number of
    annotations and two sums of their hashes, so a specimen's annotations are never gathered.
    """
    own = F.xxhash64("observer", "label")
    told = cut(ann.groupBy("spec").agg(F.count("*").alias("n"), F.sum(own.cast("decimal(38,0)")).alias("s"), F.bit_xor(F.xxhash64(F.lit(1), "observer", "label")).alias("x")))
    stands = cut(told.groupBy("n", "s", "x").agg(F.min("spec").alias("of"), F.count("*").alias("w")))
    rows = ann.join(stands.select(F.col("of").alias("spec"), "w"), "spec").select("spec", "observer", "label", "w")
    return rows, told.join(stands.drop("w"), ["n", "s", "x"]).select("spec", "of")


def _fit(ann: DataFrame, classes: list[str], smoothing: float, max_iter: int, tol: float, accuracies) -> tuple[DataFrame, dict[str, float], list[float]]:
    """Rounds over patterns of annotations, each with the number of specimens that have it."""
    _check(ann, classes)
    rows, members = _patterns(cut(ann.select("spec", "observer", "label")))
    ann = cut(rows)
    weights = ann.select("spec", "w").distinct()
    specs, k = weights.agg(F.sum("w")).first()[0] or 0, len(classes)
    post, trace, priors = _start(ann, classes).join(weights, "spec"), [], {}
    for _ in range(max_iter):
        sums = {r["class"]: r["s"] for r in post.groupBy("class").agg(F.sum(F.col("p") * F.col("w")).alias("s")).collect()}  # a row for each class
        priors = {c: (sums.get(c, 0.0) + smoothing) / (specs + k * smoothing) for c in classes}
        logs, log_prior = accuracies(ann, post.drop("w"))
        seen = ann.join(logs, ["observer", "label"]).groupBy("spec", "w", "class").agg(F.sum("l").alias("l"))
        log_w = seen.select("spec", "w", "class", (F.col("l") + S.lookup(F.col("class"), {c: math.log(max(p, FLOOR)) for c, p in priors.items()})).alias("lw"))
        post, likelihood = _posterior(log_w)
        trace.append(likelihood + log_prior + smoothing * sum(math.log(max(p, FLOOR)) for p in priors.values()))
        if len(trace) > 1 and trace[-1] - trace[-2] < tol:
            break
    every = members.join(post.select(F.col("spec").alias("of"), "class", "p"), "of")
    return every.select("spec", "class", "p"), priors, trace


def dawid_skene(ann: DataFrame, classes: list[str], smoothing: float = 1.0, max_iter: int = 100, tol: float = 1e-5) -> tuple[DataFrame, dict[str, float], list[float]]:
    """(posteriors, priors, trace of the objective) of the model with a confusion matrix for each observer.

    Per round the annotations of each pattern meet its posterior by specimen and the matrices by observer and label;
    the driver sees the class sums and two totals.
    """
    k = len(classes)
    every = F.explode(F.array(*[F.lit(c) for c in classes]))
    mass = F.sum(F.col("p") * F.col("w"))

    def accuracies(a: DataFrame, post: DataFrame):
        met = a.join(post, "spec")
        counts = met.groupBy("observer", "class", "label").agg(mass.alias("c"))
        rows = met.groupBy("observer", "class").agg(mass.alias("r")).withColumn("label", every)
        p = (F.coalesce("c", F.lit(0.0)) + smoothing) / (F.col("r") + k * smoothing)
        logs = rows.join(counts, ["observer", "class", "label"], "left").select("observer", "class", "label", F.ln(F.greatest(p, F.lit(FLOOR))).alias("l"))
        logs = cut(logs)
        return logs, smoothing * (logs.agg(F.sum("l")).first()[0] or 0.0)

    return _fit(ann, classes, smoothing, max_iter, tol, accuracies)


def one_coin(ann: DataFrame, classes: list[str], smoothing: float = 1.0, max_iter: int = 200, tol: float = 1e-8) -> tuple[DataFrame, dict[str, float], list[float]]:
    """The same with one accuracy for each observer, (right + 1) / (annotations + 2)."""
    k = len(classes)
    every = F.explode(F.array(*[F.lit(c) for c in classes]))

    def accuracies(a: DataFrame, post: DataFrame):
        hit = F.when(F.col("label") == F.col("class"), F.col("p") * F.col("w")).otherwise(0.0)
        right = a.join(post, "spec").groupBy("observer").agg((F.sum(hit) + 1).alias("r"), (F.sum("w") / k + 2).alias("n"))
        acc = cut(right.select("observer", F.least(F.greatest(F.col("r") / F.col("n"), F.lit(FLOOR)), F.lit(1 - FLOOR)).alias("acc")))
        prior = acc.agg(F.sum(F.ln("acc") + F.ln(1 - F.col("acc")))).first()[0] or 0.0
        grid = acc.withColumn("class", every).withColumn("label", F.explode(F.array(*[F.lit(c) for c in classes])))
        return grid.select("observer", "class", "label", F.when(F.col("class") == F.col("label"), F.ln("acc")).otherwise(F.ln((1 - F.col("acc")) / (k - 1))).alias("l")), prior

    return _fit(ann, classes, smoothing, max_iter, tol, accuracies)


def top_label(post: DataFrame, classes: list[str]) -> DataFrame:
    """(spec, label): the likeliest class, ties to the first."""
    return post.groupBy("spec").agg(F.min_by("class", F.struct(-F.col("p"), _order(classes))).alias("label"))


def recommend(ann: DataFrame) -> DataFrame:
    """dawid-skene from 50 annotations an observer on, else one-coin."""
    g = ann.agg(F.count("*").alias("n"), F.countDistinct("observer").alias("n_observers"))
    mean = F.try_divide(F.col("n").cast("double"), F.col("n_observers").cast("double"))
    return g.withColumn("mean_annotations", F.round(mean, 6)).withColumn("method", F.when(mean >= 50, "dawid-skene").otherwise("one-coin"))


def evaluate(pred: DataFrame, classes: list[str], by: list[str] | None = None) -> DataFrame:
    """One row (or one of each group) from (truth, label, p_true): accuracy, macro F1 over the classes, mean log loss."""
    by = by or []
    cells = pred.groupBy(*by, "truth", "label").agg(F.count("*").alias("n"), F.sum(-F.ln(F.greatest("p_true", F.lit(FLOOR)))).alias("loss"))
    per = [
        F.try_divide(2.0 * F.sum(F.when((F.col("truth") == c) & (F.col("label") == c), F.col("n")).otherwise(0)), F.sum(F.when(F.col("truth") == c, F.col("n")).otherwise(0)) + F.sum(F.when(F.col("label") == c, F.col("n")).otherwise(0)))
        for c in classes
    ]
    macro = sum((F.coalesce(x, F.lit(0.0)) for x in per), F.lit(0.0)) / len(classes)
    return cells.groupBy(*by).agg(F.round(F.sum(F.when(F.col("truth") == F.col("label"), F.col("n")).otherwise(0)) / F.sum("n"), 6).alias("accuracy"), F.round(macro, 6).alias("macro_f1"), F.round(F.sum("loss") / F.sum("n"), 6).alias("log_loss"))


def confusion(ann: DataFrame, truth: DataFrame, smoothing: float = 0.0, classes: list[str] | None = None) -> DataFrame:
    """(observer, class, label, p): of the annotations of a class the share that has each label; every pair of `classes` if they are given."""
    counts = ann.join(truth, "spec").groupBy("observer", "class", "label").agg(F.count("*").alias("n"))
    if classes is not None:
        every = F.explode(F.array(*[F.lit(c) for c in classes]))
        grid = counts.select("observer").distinct().withColumn("class", every).withColumn("label", F.explode(F.array(*[F.lit(c) for c in classes])))
        counts = grid.join(counts, ["observer", "class", "label"], "left").fillna(0, ["n"])
    total = F.sum(F.col("n") + smoothing).over(W.partitionBy("observer", "class"))
    return counts.select("observer", "class", "label", F.coalesce(F.try_divide(F.col("n") + smoothing, total), F.lit(0.0)).alias("p"))


def confusion_distance(estimated: DataFrame, true: DataFrame) -> DataFrame:
    """(observer, distance): the Frobenius distance of two confusion tables (observer, class, label, p); a missing cell is 0."""
    key = ["observer", "class", "label"]
    both = estimated.select(*key, F.col("p").alias("a")).join(true.select(*key, F.col("p").alias("b")), key, "full_outer").fillna(0.0, ["a", "b"])
    return both.groupBy("observer").agg(F.sqrt(F.sum(F.pow(F.col("a") - F.col("b"), 2))).alias("distance"))


def over_runs(metrics: DataFrame, columns: list[str], challenger: str, base: str) -> DataFrame:
    """One row from one of each run: mean and (population) deviation of each metric, and the share of runs in which `challenger` is above `base`."""
    stats = [f(c).alias(f"{c}_{n}") for c in columns for n, f in (("mean", F.avg), ("std", F.stddev_pop))]
    return metrics.agg(*stats, F.avg((F.col(challenger) > F.col(base)).cast("double")).alias("win_fraction"), F.count("*").alias("n_runs"))


def kth_score(scores: DataFrame, alpha: float, by: list[str] | None = None) -> DataFrame:
    """The ceil((n + 1)(1 - alpha))-th smallest score of each group, 1 beyond the last; also 1 below ceil(1 / alpha) scores.

    Scores are from 0 to 1. They are counted in `RANGES` equal ranges of a group, and the sums of these
    counts say which range has the wanted one; that range is counted in as many parts, and only the
    distinct scores of the part that has it are ranked. No task orders more than `RANGES` rows of a group
    before that, and groups may be very large.
    """
    keys = by or ["__all"]
    rows = cut((scores if by else scores.withColumn("__all", F.lit(0))).select(*keys, "score").filter("score IS NOT NULL"))
    total = cut(rows.groupBy(*keys).agg(F.count("*").alias("n")))
    small = total.count() <= BROADCAST_GROUPS
    known = F.broadcast if small else (lambda df: df)
    wanted = F.ceil((F.col("n") + 1) * (1 - alpha) - 1e-9)
    state, left, width = total.select(*keys, wanted.alias("k"), F.lit(0.0).alias("low")), rows, 1.0
    for _ in range(2):
        width /= RANGES
        at = F.least(F.greatest(F.floor((F.col("score") - F.col("low")) / width), F.lit(0)), F.lit(RANGES - 1))
        here = left.join(known(state), keys).withColumn("at", at)
        upto = F.sum("c").over(W.partitionBy(*keys).orderBy("at"))
        per = here.groupBy(*keys, "k", "low", "at").agg(F.count("*").alias("c")).withColumn("upto", upto)
        found = per.filter((F.col("upto") >= F.col("k")) & (F.col("upto") - F.col("c") < F.col("k")))
        state = cut(found.select(*keys, (F.col("k") - F.col("upto") + F.col("c")).alias("k"), (F.col("low") + F.col("at") * width).alias("low"), F.col("at").alias("found")))
        left = here.select(*keys, "score", "at").join(known(state.select(*keys, "found")), keys).filter("at = found").select(*keys, "score")
        state = state.drop("found")
    upto = F.sum("c").over(W.partitionBy(*keys).orderBy("score"))
    last = left.groupBy(*keys, "score").agg(F.count("*").alias("c")).withColumn("upto", upto).join(known(state), keys).filter("upto >= k").groupBy(*keys).agg(F.min("score").alias("s"))
    out = total.join(last, keys, "left")
    return out.select(*(by or []), "n", F.when(F.col("n") < math.ceil(1 / alpha - 1e-9), 1.0).otherwise(F.coalesce("s", F.lit(1.0))).alias("cutoff"))


def prediction_sets(post: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """Classes with 1 - p within their cutoff, likeliest first; `cutoffs` is (class, cutoff), a row for each class."""
    kept = post.join(F.broadcast(cutoffs), "class").withColumn("in", 1 - F.col("p") <= F.col("cutoff") + FLOOR)
    found = F.transform(F.array_sort(F.filter(F.collect_list(F.when(F.col("in"), F.struct((-F.col("p")).alias("k"), "class"))), lambda x: x.isNotNull())), lambda x: x["class"])
    return kept.groupBy("spec").agg(found.alias("classes"))


def coverage(sets: DataFrame) -> DataFrame:
    """Per true class: share of sets that hold it; sizes of sets."""
    size = F.size("classes")
    return sets.groupBy("truth").agg(F.count("*").alias("n"), F.round(F.avg(F.array_contains("classes", F.col("truth")).cast("double")), 6).alias("coverage"), F.count_if(size == 0).alias("n_empty"), F.count_if(size == 1).alias("n_single"), F.count_if(size > 1).alias("n_ambiguous"), F.round(F.avg(size), 6).alias("mean_size"))


def confident(post: DataFrame, truth: DataFrame) -> DataFrame:
    """(spec, conf, right): the likeliest class, ties to the larger name."""
    top = post.groupBy("spec").agg(F.max(F.struct("p", "class")).alias("t")).select("spec", F.col("t.p").alias("conf"), F.col("t.class").alias("label"))
    return top.join(truth, "spec").select("spec", "conf", (F.col("label") == F.col("truth")).alias("right"))


def risk_coverage(conf: DataFrame, steps: int = 21) -> DataFrame:
    """Coverage and risk at `steps` thresholds from 0 to 1.

    A row falls in the highest threshold that it passes, and counts are summed from the top: one
    aggregation to `steps` rows, no cross join.
    """
    bin_ = F.least(F.floor((F.col("conf") + FLOOR) * (steps - 1) + 1e-9), F.lit(steps - 1)).cast("int")
    per = conf.groupBy(bin_.alias("b")).agg(F.count("*").alias("n"), F.count_if("right").alias("r"))
    grid = conf.sparkSession.range(steps).select(F.col("id").cast("int").alias("b"))
    w = W.orderBy(F.desc("b"))  # `steps` rows
    out = grid.join(per, "b", "left").fillna(0).withColumn("kept", F.sum("n").over(w)).withColumn("ok", F.sum("r").over(w)).withColumn("total", F.sum("n").over(W.partitionBy()))
    return out.select(F.round(F.col("b") / (steps - 1), 6).alias("threshold"), F.round(F.try_divide(F.col("kept").cast("double"), F.col("total").cast("double")), 6).alias("coverage"), F.round(F.coalesce(1 - F.try_divide(F.col("ok").cast("double"), F.col("kept").cast("double")), F.lit(0.0)), 6).alias("risk"))


def ece(conf: DataFrame, bins: int = 10) -> DataFrame:
    """Expected calibration error over bins closed above, the first one closed."""
    b = F.greatest(F.ceil(F.col("conf") * bins - 1e-12), F.lit(1))
    per = conf.groupBy(b.alias("b")).agg(F.count("*").alias("n"), F.avg("conf").alias("c"), F.avg(F.col("right").cast("double")).alias("a"))
    return per.agg(F.sum("n").alias("n"), F.round(F.sum(F.col("n") * F.abs(F.col("c") - F.col("a"))) / F.sum("n"), 6).alias("ece"))


def shared_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """The keys that both have, once each."""
    return a.select(key).join(b.select(key), key, "left_semi").distinct()


def assert_disjoint(a: DataFrame, b: DataFrame, key: str) -> None:
    """Raise, with up to five examples, if the two share a key."""
    both = shared_keys(a, b, key).limit(5).collect()
    if both:
        raise ValueError(f"in both: {sorted(r[0] for r in both)}")
