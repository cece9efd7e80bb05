"""Measures of quality and operation, as grouped aggregates."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.functions.text import normalize_amount, normalize_location, normalize_plate, normalize_text
from claimloom.functions.vectors import f1, ratio
from claimloom.operators.rules import approval, rule_names


def counts_by(df: DataFrame, *keys: Column | str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def or_unknown(value: Column) -> Column:
    return F.coalesce(F.nullif(value, F.lit("")), F.lit("unknown"))


def daily_trend(df: DataFrame, at: str, until: Column, days: int = 7) -> DataFrame:
    """Rows a day from `days` before `until` on; days without rows are not listed."""
    recent = df.where(F.col(at) >= until - F.make_interval(days=F.lit(days)))
    return recent.groupBy(F.to_date(at).alias("day")).agg(F.count("*").alias("n")).orderBy("day")


#: Up to so many values one task may put in order.
IN_ONE_TASK = 1_000_000


def value_at(values: DataFrame, column: str, place: int, n: int, most: int = IN_ONE_TASK) -> float:
    """The value at a place, from 0, of n values without nulls in order. While more than `most` values are in question,
    counts under and up to approximate cuts narrow them to those between two cuts, so that no task orders them all."""
    at, inside = F.col(column), values
    while n > most:
        cuts = sorted(set(inside.approxQuantile(column, [k / 40 for k in range(41)], 0.005)))
        row = inside.agg(*[F.count_if(at < c) for c in cuts], *[F.count_if(at <= c) for c in cuts]).first()
        under, up_to = row[: len(cuts)], row[len(cuts) :]
        k = next(k for k, upper in enumerate(up_to) if upper > place)
        if under[k] <= place:
            return float(cuts[k])
        passed = up_to[k - 1] if k else 0
        inside = inside.where((at > cuts[k - 1]) & (at < cuts[k])) if k else inside.where(at < cuts[k])
        place, n = place - passed, under[k] - passed
    return inside.agg(F.expr(f"percentile_disc({(place + 0.5) / n!r}D) within group (order by {column})").cast("double")).first()[0]


def nearest_rank(values: DataFrame, column: str, share: float = 0.95, most: int = IN_ONE_TASK) -> DataFrame:
    """n, p95 as the value at place int(n * share) from 0 but at most n - 1, and the upper median; 0 and nulls without values. Up to `most` values are put in
    order by one aggregate, which gives both places."""
    known = values.select(F.col(column).cast("double").alias("v")).where("v is not null")
    n = known.count()
    places = (min(n - 1, int(n * share)), n // 2 if n > 1 else 0)
    if n > most:
        row = (n, *(value_at(known, "v", k, n, most) for k in places))
    else:
        at = [F.expr(f"percentile_disc({(k + 0.5) / max(n, 1)!r}D) within group (order by v)") for k in places]
        row = (n, *known.agg(*at).first()) if n else (0, None, None)
    return values.sparkSession.createDataFrame([row], "n long, p95 double, median double")


def entity_percentile(df: DataFrame, entity: str, value: str, share: float = 0.95, most: int = IN_ONE_TASK) -> DataFrame:
    """Continuous percentile of each entity's sum, between the two places that it falls in; entities without a value count
    as entities only."""
    sums = df.groupBy(entity).agg(F.sum(value).cast("double").alias("total"))
    shown = sums.agg(F.avg("total").alias("mean"), F.count("*").alias("entities"))
    known = sums.select("total").where("total is not null")
    if (n := known.count()) <= most:
        return sums.agg(F.expr(f"percentile_cont({share}) within group (order by total)").alias("percentile"), F.avg("total").alias("mean"), F.count("*").alias("entities"))
    low = int(share * (n - 1))
    a, b = value_at(known, "total", low, n, most), value_at(known, "total", min(low + 1, n - 1), n, most)
    return shown.select(F.lit(a + (b - a) * (share * (n - 1) - low)).alias("percentile"), "mean", "entities")


def wait_times(decisions: DataFrame, routed: DataFrame, key: str, at: str, last: int = 100) -> DataFrame:
    """Mean seconds from routing to decision over the last decisions, 0 for none; a key's last routing counts."""
    newest = decisions.orderBy(F.desc(at), F.desc(key)).limit(last).select(key, F.col(at).alias("_decided"))
    begun = routed.join(newest.select(key).distinct(), key, "left_semi").groupBy(key).agg(F.max(at).alias("_routed"))
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    seconds = (micros("_decided") - micros("_routed")) / 1e6
    return newest.join(begun, key).agg(F.coalesce(F.avg(seconds), F.lit(0.0)).alias("mean_wait_s"), F.count("*").alias("n"))


def equal_when_normal(field: str, expected: Column, actual: Column) -> Column:
    """Whether two values of a claim's field agree once normalised; silence about injury and counterparty is no."""
    if field in ("injury", "counterparty_exists"):
        return F.coalesce(expected, F.lit(False)) == F.coalesce(actual, F.lit(False))
    how = {"plate": normalize_plate, "estimated_amount": normalize_amount}.get(field, normalize_text)
    if field == "incident_location":
        return normalize_location(expected["city"], expected["district"]).eqNullSafe(normalize_location(actual["city"], actual["district"]))
    if field == "estimated_amount":
        return how(expected.cast("string")).eqNullSafe(how(actual.cast("string")))
    if field == "incident_date":
        return F.trim(expected.cast("string")).eqNullSafe(F.trim(actual.cast("string")))
    return how(expected).eqNullSafe(how(actual))


def field_accuracy(scored: DataFrame) -> DataFrame:
    """Accuracy of rows (channel, field, hit): over all, by channel and by field, in one pass of grouping sets."""
    sums = scored.groupingSets([["channel"], ["field"], []], "channel", "field").agg(F.count_if("hit").alias("hits"), F.count("*").alias("total"), F.grouping_id().alias("_set"))
    scope = F.when(F.col("_set") == 3, "all").when(F.col("_set") == 1, "channel").otherwise("field")
    return sums.select(scope.alias("scope"), F.coalesce("channel", "field", F.lit("all")).alias("name"), "hits", "total", ratio(F.col("hits"), F.col("total")).alias("accuracy"))


def unsupported_rate(df: DataFrame, unverified: Column, filled: Column) -> DataFrame:
    sums = df.agg(F.sum(F.size(unverified)).alias("unsupported"), F.sum(F.size(filled)).alias("filled"))
    return sums.withColumn("rate", ratio(F.col("unsupported"), F.col("filled")))


def missing_fields(df: DataFrame, expected: Column, actual: Column) -> DataFrame:
    """Precision, recall and F1 of the fields named as missing, by sets; null without any."""
    sums = df.agg(
        F.sum(F.size(F.array_intersect(expected, actual))).alias("tp"), F.sum(F.size(F.array_except(actual, expected))).alias("fp"), F.sum(F.size(F.array_except(expected, actual))).alias("fn")
    )
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    known = F.col("tp") + F.col("fp") + F.col("fn") > 0
    return sums.withColumns({"precision": F.when(known, p), "recall": F.when(known, r), "f1": F.when(known, f1(p, r))})


def class_report(df: DataFrame, expected: str, actual: str) -> DataFrame:
    """support, predicted, tp, precision, recall and f1 of every label that either side uses; rows with a null side
    are not scored."""
    known = df.where(F.col(expected).isNotNull() & F.col(actual).isNotNull())
    pairs = known.groupBy(F.col(expected).cast("string").alias("e"), F.col(actual).cast("string").alias("a")).agg(F.count("*").alias("n"))
    side = lambda label, s, p: F.struct(F.col(label).alias("label"), F.lit(s).alias("s"), F.lit(p).alias("p"))
    sides = pairs.select(F.explode(F.array(side("e", 1, 0), side("a", 0, 1))).alias("x"), "n", (F.col("e") == F.col("a")).alias("same"))
    sums = sides.groupBy("x.label").agg(F.sum(F.col("x.s") * F.col("n")).alias("support"), F.sum(F.col("x.p") * F.col("n")).alias("predicted"), F.sum(F.when(F.col("same"), F.col("x.s") * F.col("n")).otherwise(0)).alias("tp"))
    p, r = ratio(F.col("tp"), F.col("predicted")), ratio(F.col("tp"), F.col("support"))
    return sums.withColumns({"precision": p, "recall": r, "f1": f1(p, r)})


def macro_f1(report: DataFrame) -> DataFrame:
    return report.agg(F.avg("f1").alias("macro_f1"), ratio(F.sum("tp"), F.sum("support")).alias("accuracy"), F.sum("support").alias("scored"))


def confusions(df: DataFrame, expected: str, actual: str) -> DataFrame:
    """Mismatches as `expected -> actual` with counts, most first."""
    wrong = df.where(F.col(expected) != F.col(actual))
    pair = F.concat(F.col(expected).cast("string"), F.lit(" -> "), F.col(actual).cast("string"))
    return wrong.groupBy(pair.alias("pair")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "pair")


def rules_per_record(df: DataFrame, flags: Column) -> DataFrame:
    """Records of each rule, counted once a record."""
    return df.select(F.explode(rule_names(flags)).alias("rule")).groupBy("rule").agg(F.count("*").alias("records")).orderBy(F.desc("records"), "rule")


def gate_measure(decided: DataFrame, decision: Column, correct: Column) -> DataFrame:
    """records, approved, correct_approved, coverage and precision (null if nothing is approved)."""
    sums = decided.agg(F.count("*").alias("records"), F.count_if(decision["approved"]).alias("approved"), F.count_if(decision["approved"] & correct).alias("correct_approved"))
    return sums.withColumns({"coverage": ratio(F.col("approved"), F.col("records")), "precision": F.try_divide(F.col("correct_approved").cast("double"), F.col("approved"))})


def gate_reasons(decided: DataFrame, decision: Column) -> DataFrame:
    return decided.select(F.explode(decision["reasons"]).alias("reason")).groupBy("reason").agg(F.count("*").alias("records")).orderBy(F.desc("records"), "reason")


def gate_sweep(records: DataFrame, candidates: dict[str, tuple[str, ...]], **columns: Column) -> DataFrame:
    """gate_measure for each named set of advisory rules, in one pass: records are read once, and every record is
    decided under every set by an array expression."""
    decisions = [F.struct(F.lit(name).alias("candidate"), approval(columns["content_type"], columns["urgency"], columns["flags"], columns["unverified"], columns["sanity"], columns["extracted"], True, rules)["approved"].alias("approved")) for name, rules in candidates.items()]
    each = records.select(columns["correct"].alias("correct"), F.explode(F.array(*decisions)).alias("d"))
    sums = each.groupBy("d.candidate").agg(F.count("*").alias("records"), F.count_if("d.approved").alias("approved"), F.count_if(F.col("d.approved") & F.col("correct")).alias("correct_approved"))
    return sums.withColumns({"coverage": ratio(F.col("approved"), F.col("records")), "precision": F.try_divide(F.col("correct_approved").cast("double"), F.col("approved"))})


def recall_split(df: DataFrame, expected: Column, found: Column, *keys: str) -> DataFrame:
    """Recall and false fires over all and by each prefix of the keys (a rollup); null keys stand for all."""
    sums = df.rollup(*keys).agg(F.count_if(expected).alias("positives"), F.count_if(expected & found).alias("found"), F.count_if(~expected).alias("controls"), F.count_if(~expected & found).alias("false_fires"))
    return sums.withColumn("recall", ratio(F.col("found"), F.col("positives")))


def accuracy_split(df: DataFrame, correct: Column, split: str, kind: str) -> DataFrame:
    """Hits, rows and accuracy by split and kind, by split, by kind and over all (a cube); `all` stands for every split or kind."""
    named = df.select(F.coalesce(F.col(split).cast("string"), F.lit("")).alias("split"), F.coalesce(F.col(kind).cast("string"), F.lit("")).alias("kind"), correct.alias("correct"))
    label = lambda c: F.when(F.grouping(c) == 1, "all").otherwise(F.col(c)).alias(f"_{c}")
    sums = named.cube("split", "kind").agg(label("split"), label("kind"), F.count_if("correct").alias("hits"), F.count("*").alias("n"))
    return sums.select(F.col("_split").alias("split"), F.col("_kind").alias("kind"), "hits", "n", ratio(F.col("hits"), F.col("n")).alias("accuracy"))


def masking_recall(df: DataFrame, raw: str, masked: str, kinds: dict[str, str]) -> DataFrame:
    """Of each kind's known values that the raw text holds: how many the masked text no longer holds, with the
    total as kind all."""
    facts = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("value")) for k, c in kinds.items()])
    rows = df.select(F.col(raw).alias("raw"), F.col(masked).alias("masked"), F.explode(facts).alias("x")).where("x.value != '' and contains(raw, x.value)")
    sums = rows.rollup(F.col("x.kind").alias("kind")).agg(F.count("*").alias("total"), F.count_if(~F.contains("masked", F.col("x.value"))).alias("masked"))
    return sums.select(F.coalesce("kind", F.lit("all")).alias("kind"), "masked", "total", ratio(F.col("masked"), F.col("total")).alias("recall"))


#: Points of Gauss and Legendre's rule, steps of bisection, and standard deviations within which a beta distribution is summed.
POINTS, HALVINGS, DEVIATIONS = 128, 46, 30.0


def lower_bound(hits: Column, total: Column, alpha: float = 0.05) -> Column:
    """One-sided Clopper-Pearson lower confidence bound: the share p at which `hits` or more of `total` have probability alpha, where the regularised
    incomplete beta function I_p(hits, total - hits + 1) is alpha.

    That function is a ratio of two integrals of one density by Gauss and Legendre's rule, so that no large logarithms of gamma cancel; a row takes the same work whatever
    its numbers, in columns only. Null for null, negative or impossible numbers; 0 for no hits."""
    k, n = hits.cast("double"), total.cast("double")
    a, b = k, n - k + 1
    mean = a / (a + b)
    width = DEVIATIONS * F.sqrt(mean * (1 - mean) / (a + b + 1))
    mode = F.least(F.lit(1.0), F.when(a > 1, (a - 1) / F.greatest(a + b - 2, F.lit(1.0))).otherwise(F.lit(0.0)))
    nodes, weights = np.polynomial.legendre.leggauss(POINTS)
    rule = F.lit([float(x) for x in nodes]), F.lit([float(x) for x in weights])

    def log_density(x: Column, s: Column) -> Column:
        return F.when(s["a"] > 1, (s["a"] - 1) * F.ln(x)).otherwise(0.0) + F.when(s["b"] > 1, (s["b"] - 1) * F.ln(1 - x)).otherwise(0.0)

    def integral(low: Column, high: Column, s: Column) -> Column:
        half, middle = (high - low) / 2, (high + low) / 2
        parts = F.zip_with(*rule, lambda x, w: w * F.exp(log_density(middle + half * x, s) - s["top"]))
        return half * F.aggregate(parts, F.lit(0.0), lambda t, x: t + x)

    inside = (k > 0) & (k < n)
    at_mode = F.least(F.greatest(mode, F.lit(1e-300)), F.lit(1 - 1e-16))
    shape = F.struct(a.alias("a"), b.alias("b"), F.greatest(F.lit(0.0), mean - width).alias("low"), F.least(F.lit(1.0), mean + width).alias("high"))
    with_top = F.transform(F.array(shape), lambda s: F.struct(s["a"].alias("a"), s["b"].alias("b"), s["low"].alias("low"), s["high"].alias("high"), log_density(at_mode, s).alias("top")))
    whole = F.transform(with_top, lambda s: F.struct(s["a"].alias("a"), s["b"].alias("b"), s["low"].alias("low"), s["top"].alias("top"), (alpha * integral(s["low"], s["high"], s)).alias("wanted"), mean.alias("mean")))

    def halve(s: Column) -> Column:
        begin = F.struct(s["low"].alias("under"), s["mean"].alias("over"))

        def step(now: Column, _: Column) -> Column:
            middle = (now["under"] + now["over"]) / 2
            above = integral(s["low"], middle, s) > s["wanted"]
            return F.struct(F.when(above, now["under"]).otherwise(middle).alias("under"), F.when(above, middle).otherwise(now["over"]).alias("over"))

        return F.aggregate(F.sequence(F.lit(1), F.lit(HALVINGS)), begin, step, lambda now: (now["under"] + now["over"]) / 2)

    found = F.when(inside, F.element_at(F.transform(whole, halve), 1))
    known = (n > 0) & (k >= 0) & (k <= n)
    return F.when(known, F.when(k == 0, 0.0).when(k == n, F.pow(F.lit(alpha), 1 / n)).otherwise(found))


def metric_status(value: Column, target: Column, direction: Column) -> Column:
    """pass, fail or unmeasured against a target that value must reach (gte) or stay under (lte)."""
    met = F.when(direction == "gte", value >= target).otherwise(value <= target)
    return F.when(value.isNull(), "unmeasured").when(target.isNull() | met, "pass").otherwise("fail")


def noise_floor(total: Column, points: int = 4) -> Column:
    """The share that repeated runs differ by."""
    return ratio(F.lit(points), total)


def sanity_measure(df: DataFrame, leaking: Column, flagged: Column, expected_kind: Column, kinds: Column) -> DataFrame:
    """Detection, false alarms and hits of the kind over labelled records: leaks, detected, clean, false_alarms,
    right_kind."""
    return df.agg(
        F.count_if(leaking).alias("leaks"), F.count_if(leaking & flagged).alias("detected"), F.count_if(~leaking).alias("clean"),
        F.count_if(~leaking & flagged).alias("false_alarms"), F.count_if(leaking & F.array_contains(kinds, expected_kind)).alias("right_kind"),
    )


def kind_counts(df: DataFrame, kinds: Column) -> DataFrame:
    """Records of each kind that was flagged, once a record."""
    return df.select(F.explode(F.array_distinct(kinds)).alias("kind")).groupBy("kind").agg(F.count("*").alias("records"))


def gate_wrong_ids(decided: DataFrame, decision: Column, correct: Column, id_col: str) -> DataFrame:
    """Ids of what the gate approved although it is wrong; a record whose correctness is unknown is not right."""
    return decided.where(decision["approved"] & ~F.coalesce(correct, F.lit(False))).select(id_col).orderBy(id_col)


#: The critical records of the original's corpus and how many of them its phrases caught.
CORPUS_CRITICAL = (38, 38)


def critical_recall(cases: DataFrame, injury: Column, critical: Column, signalled: Column, split: str) -> DataFrame:
    """label, numerator, denominator and value (null over nothing): the headline `all`, one row a split, what the rules
    alone catch, false alarms among controls, and the fixed row of the corpus. Cases are counted once, by a rollup."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    hurt = yes(injury)
    sums = cases.rollup(split).agg(
        F.count_if(hurt).alias("positives"), F.count_if(hurt & yes(critical)).alias("caught"), F.count_if(hurt & yes(signalled)).alias("by_rules"),
        F.count_if(~hurt).alias("controls"), F.count_if(~hurt & yes(critical)).alias("false_alarms"), F.grouping(split).alias("whole"),
    )
    row = lambda label, n, d: F.struct(label.alias("label"), n.cast("long").alias("numerator"), d.cast("long").alias("denominator"))
    whole = F.array(
        row(F.lit("all"), F.col("caught"), F.col("positives")), row(F.lit("rules_alone"), F.col("by_rules"), F.col("positives")),
        row(F.lit("false_alarms"), F.col("false_alarms"), F.col("controls")), row(F.lit("corpus"), *map(F.lit, CORPUS_CRITICAL)),
    )
    part = F.when(F.col("positives") > 0, F.array(row(F.coalesce(F.col(split).cast("string"), F.lit("unknown")), F.col("caught"), F.col("positives"))))
    rows = sums.select(F.inline(F.when(F.col("whole") == 1, whole).otherwise(part)))
    return rows.withColumn("value", F.try_divide(F.col("numerator").cast("double"), F.col("denominator")))
