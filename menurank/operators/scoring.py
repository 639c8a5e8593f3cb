"""Scoring meals for goals, badges, explanations, ranking."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import dims
from ..functions.rules import clamp01, half_up

# Fixed values of the score.
WEIGHTS = {"protein_efficiency": 0.5, "goal_fit": 0.25, "total_protein": 0.125, "balance": 0.125}
EXCELLENT_RATIO, FULL_PROTEIN, CURVE = 0.16, 50.0, 0.65
POOR_RATIO, WEAK_RATIO, HIGH_CALORIES = 0.04, 0.05, 800.0
MOST_FAT_PENALTY = 0.125
BADGES = {"best": "Best Match", "side": "Side dish", "efficient": "Protein Efficient", "protein": "High Protein", "lean": "Lean Pick", "balanced": "Balanced", "bulk": "Better for Bulk", "dense": "Calorie Dense"}
MOST_BADGES = 3


def each_goal(meals: DataFrame, goals: DataFrame | None = None) -> DataFrame:
    """Each meal once per goal, with the goal's preset; the goals are a small fixed table."""
    goals = dims.goals(meals.sparkSession) if goals is None else goals
    rows = goals.agg(F.sort_array(F.collect_list(F.struct(*goals.columns))).alias("g")).first()["g"]
    literal = F.array(*[F.struct(*[F.lit(r[c]).alias(c) for c in goals.columns]) for r in rows])
    return meals.withColumn("__goal", F.explode(literal)).select("*", *[F.col(f"__goal.{c}").alias(c) for c in goals.columns]).drop("__goal")


def for_goal(meals: DataFrame, goal: str, goals: DataFrame | None = None) -> DataFrame:
    """Each meal with one goal; an unknown goal has the preset of maintain under its own name."""
    goals = dims.goals(meals.sparkSession) if goals is None else goals
    names = {r["goal"] for r in goals.select("goal").collect()}
    return each_goal(meals, goals.where(F.col("goal") == (goal if goal in names else "maintain"))).withColumn("goal", F.lit(goal))


def ratios(meals: DataFrame) -> DataFrame:
    """Protein per calorie, fat per protein and the macros' shares of the calories, once per meal."""
    p, c, f = F.col("protein_g") * 4, F.col("carbs_g") * 4, F.col("fat_g") * 9
    total = p + c + f
    out = meals.withColumn("protein_ratio", F.when(F.col("calories") > 0, F.col("protein_g") / F.col("calories")).otherwise(0.0))
    out = out.withColumn("fat_ratio", F.when(F.col("protein_g") > 0, F.col("fat_g") / F.col("protein_g")).otherwise(float("inf")))
    shares = {"protein_share": p, "carb_share": c, "fat_share": f}
    return out.withColumns({k: F.when(total > 0, v / total).otherwise(0.0) for k, v in shares.items()})


def ramp(value: Column, good: float, bad: float) -> Column:
    """From 1 at good to 0 at bad, in either direction."""
    if good == bad:
        return F.when(value <= good, 1.0).otherwise(0.0)
    return clamp01((F.lit(float(bad)) - value) / (bad - good))


def calorie_fit() -> Column:
    off = F.col("calories") - F.col("ideal_calories")
    return clamp01(1 - F.abs(off) * F.when(off >= 0, F.col("over_penalty")).otherwise(F.col("under_penalty")) / (F.col("calorie_tolerance") * 2))


def goal_fit() -> Column:
    fit = F.col("calorie_fit")
    bulk = 0.75 * (fit * clamp01(F.col("protein_g") / F.col("min_protein"))) + 0.25 * clamp01(F.col("carb_share") / 0.3)
    extremes = 0.5 * ramp(F.greatest("carb_share", "fat_share"), 0.4, 0.55) + 0.5 * clamp01(F.col("protein_share") / 0.25)
    return F.when(F.col("goal") == "cut", fit).when(F.col("goal") == "bulk", bulk).otherwise(0.6 * fit + 0.4 * extremes)


def balance() -> Column:
    third = 1 / 3
    off = (F.greatest(F.lit(0.0), third - F.col("protein_share")) + F.greatest(F.lit(0.0), F.col("carb_share") - third) + F.greatest(F.lit(0.0), F.col("fat_share") - third)) / 3
    nothing = (F.col("protein_share") == 0) & (F.col("carb_share") == 0) & (F.col("fat_share") == 0)
    return F.when(nothing, 0.0).otherwise(clamp01(1 - off / third))


def penalties(score: Column) -> tuple[Column, Column]:
    """The score after the multiplicative penalties, and the names of those that apply."""
    heavy = (F.col("calories") >= HIGH_CALORIES) & (F.col("protein_ratio") < WEAK_RATIO)
    poor = F.col("protein_ratio") < POOR_RATIO
    fatty = F.col("fat_ratio") > F.col("fat_extreme")
    fat = F.least(F.lit(MOST_FAT_PENALTY), (F.col("fat_ratio") - F.col("fat_extreme")) * MOST_FAT_PENALTY)
    out = score * F.when(heavy, 0.75).otherwise(1.0) * F.when(poor, 0.8).otherwise(1.0) * F.when(fatty, 1 - fat).otherwise(1.0)
    return out, F.array_compact(F.array(F.when(heavy, "highCalorieWeakProtein"), F.when(poor, "poorProteinRatio"), F.when(fatty, "extremeFatToProtein")))


def caps(score: Column) -> tuple[Column, Column]:
    """The score under its ceilings, and the names of all ceilings that the meal is subject to."""
    p = F.col("protein_g")
    light = (F.col("calories") < 300) & (p < 30)
    top = F.least(F.when(p < 15, 45.0).when(p < 20, 65.0).otherwise(float("inf")), F.when(light, 75.0).otherwise(float("inf")))
    return F.least(score, top), F.array_compact(F.array(F.when(p < 15, "veryLowProtein").when(p < 20, "lowProtein"), F.when(light, "lowCalorieForEntree")))


def badges() -> Column:
    cal, p = F.col("calories"), F.col("protein_g")
    found = F.array_compact(
        F.array(
            F.when(p >= 40, BADGES["protein"]),
            F.when(F.col("protein_ratio") >= 0.085, BADGES["efficient"]),
            F.when((cal <= 500) & (F.col("fat_share") <= 0.3), BADGES["lean"]),
            F.when(F.col("balance") >= 0.85, BADGES["balanced"]),
            F.when((F.col("goal") != "bulk") & (cal >= 700) & (p >= 30), BADGES["bulk"]),
            F.when(cal >= 750, BADGES["dense"]),
        )
    )
    return F.slice(found, 1, MOST_BADGES)


def explanation() -> Column:
    """One sentence per meal and goal, by the first case that holds."""
    cal, p, goal = F.col("calories"), F.col("protein_g"), F.col("goal")
    high = cal > F.col("ideal_calories") + F.col("calorie_tolerance") / 2
    efficient, even = F.col("protein_efficiency") >= 0.85, F.col("balance")
    fatty, starchy = F.col("fat_share") > 0.45, F.col("carb_share") > 0.5
    cut, bulk = goal == "cut", goal == "bulk"
    enough = cal >= F.col("ideal_calories") - F.col("calorie_tolerance") / 2
    # The sentences.
    cases = [
        ((p < 20) & (cal >= HIGH_CALORIES), "Calorie dense, with lower protein than ideal for this goal."),
        (p < 20, "Lower protein than ideal for this goal."),
        (cal < 300, "Light for a full meal — good protein, but you may want more with it."),
        ((F.col("protein_ratio") < POOR_RATIO) & high, "Higher-calorie choice with a weak protein-to-calorie ratio."),
        (F.col("protein_ratio") < POOR_RATIO, "Modest protein for the calories it carries."),
        (cut & efficient, "High protein with a strong protein-to-calorie ratio."),
        (cut & fatty, "Solid protein, though it's fat-forward for a cut."),
        (cut & high, "Good protein, but a higher-calorie choice for a cut."),
        (cut, "Lean pick with calories in a comfortable range for a cut."),
        (bulk & enough & (p >= 35), "Good bulk option with higher calories and strong protein."),
        (bulk & enough, "Good bulk option with plenty of calories and adequate protein."),
        (bulk & efficient, "Lean and protein-dense — pair it with a side to fuel a bulk."),
        (bulk, "Solid protein, but light on calories for a bulk."),
        (efficient, "High protein with a strong protein-to-calorie ratio."),
        (even >= 0.85, "Balanced macros with solid protein for maintaining."),
        (fatty, "Solid protein, though the macros lean toward fat."),
        (starchy, "Solid protein with a carb-forward mix."),
        (F.col("calorie_fit") >= 0.8, "Calories sit near your baseline with solid protein."),
        (even >= 0.6, "Reasonable maintain option with adequate protein."),
    ]
    out = F
    for when, say in cases:
        out = out.when(when, say)
    return out.otherwise("Reasonable maintain option, though the macros lean in one direction.")


def score_meals(meals: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Add score (0..100), components, penalties, caps, badges and explanation.

    `meals` has calories, protein_g, carbs_g, fat_g and the columns of a goal (`each_goal`
    or `for_goal`). Other weights may be given per component; a component that isn't
    known counts as 0. Only column expressions: no shuffle.
    """
    weights = WEIGHTS if weights is None else weights
    inputs = meals.columns
    m = ratios(meals.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in ("calories", "protein_g", "carbs_g", "fat_g")}))
    m = m.withColumns({"calorie_fit": calorie_fit(), "balance": balance(), "protein_efficiency": clamp01(F.col("protein_ratio") / EXCELLENT_RATIO), "total_protein": clamp01(F.col("protein_g") / FULL_PROTEIN)})
    m = m.withColumn("goal_fit", goal_fit())
    base = reduce(lambda a, b: a + b, [F.lit(float(w)) * F.col(k) for k, w in weights.items() if k in WEIGHTS], F.lit(0.0)) * 100
    m = m.withColumn("base_score", base)
    reduced, why = penalties(F.col("base_score"))
    m = m.withColumns({"penalized": reduced, "penalties": why})
    top, under = caps(100 * F.pow(clamp01(F.col("penalized") / 100), F.lit(CURVE)))
    m = m.withColumns({"score": half_up(clamp01(top / 100) * 100).cast("int"), "caps": under, "badges": badges(), "explanation": explanation()})
    parts = F.struct("protein_efficiency", "goal_fit", "total_protein", "balance").alias("components")
    return m.select(*inputs, "score", parts, "penalties", "caps", "badges", "explanation")


#: Groups of more meals are dealt out by range, and ranges are of one score and whole grams there.
MOST_IN_RANGE = 100_000
#: Meals that a task sorts in memory.
MEALS_OF_A_TASK = 1_000_000


def ranked_by_range(meals: DataFrame, groups: list[str], order: list[str | Column], ranges: dict[str, Column], most: int) -> DataFrame:
    """Add rank, the place by `order` among the meals of `groups` and goal, in ranges of it: columns that rise with the order.

    They may ask `__large`: has the group more than `most` meals. Ranges are counted, and where each begins goes to its meals as a row
    before them. So the meals themselves are shuffled once, and nothing is checkpointed; `meals` is computed four times, but once for a few columns
    alone or none. What is not large goes to its task with a meal's other goals, as the shuffle's compression finds the keys again there. Meals are
    counted when this is called, as tasks of too many would spill.
    """
    group = [*groups, "goal"]
    large = meals.groupBy(*group).count().where(F.col("count") > most).select(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(group)], F.lit(True).alias("__large"))
    same = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"__g{i}")) for i, g in enumerate(group)])
    marked = meals.join(F.broadcast(large), same, "left")  # one group in `most` meals at most
    m = marked.withColumns(ranges).drop(*[f"__g{i}" for i in range(len(group))])
    sofar = W.partitionBy(*group).orderBy(*ranges).rowsBetween(W.unboundedPreceding, -1)
    begins = m.groupBy(*group, "__large", *ranges).agg(F.count(F.lit(1)).alias("__n")).withColumn("__begin", F.coalesce(F.sum("__n").over(sofar), F.lit(0))).drop("__n")
    rows = m.unionByName(begins, allowMissingColumns=True).withColumn("__deal", F.when(F.col("__large"), F.hash("goal", *ranges))).drop("__large")
    tasks = meals.count() // MEALS_OF_A_TASK + 1
    usual = int(meals.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(*([tasks] if tasks > usual else []), *groups, "__deal")
    own = W.partitionBy(*group, "__deal", *ranges).orderBy(F.col("__begin").isNull(), *order)  # the row that tells the beginning comes first
    place = F.first("__begin").over(own.rowsBetween(W.unboundedPreceding, 0)) + F.row_number().over(own) - 1
    return rows.withColumn("rank", place.cast("int")).where(F.col("__begin").isNull()).drop("__begin", "__deal", *(r for r in ranges if r not in meals.columns))


def rank_meals(scored: DataFrame, groups: list[str], keys: list[str], by_range: bool = False, most_in_range: int = MOST_IN_RANGE) -> DataFrame:
    """Rank entrees, then sides, within `groups` and goal: score, then protein, then fewer calories, then `keys`.

    Other categories are left out. The first entree gets the badge of the best match, sides
    theirs; at most three badges stay. With `by_range`, for groups too large for a task, a group is ranked in
    ranges (sides and halves of the score; in groups of over `most_in_range` meals sides, scores and whole grams of protein), and a range's ranks go on where those before it end;
    the result is the same, if `keys` leave no ties.
    """
    s = scored.where(F.col("category").isin("entree", "side")).withColumn("__side", F.col("category") == "side")
    group, order = [*groups, "goal"], ["__side", F.desc("score"), F.desc("protein_g"), F.asc("calories"), *keys]
    if by_range:
        protein, step = F.col("protein_g").cast("double"), F.when(F.col("__large"), 1.0).otherwise(50.0)
        grams = F.when(F.isnan(protein), F.lit(float("-inf"))).otherwise(-F.floor(protein).cast("double"))
        # descending columns have nulls last, so they count as the end
        end = F.lit(float("inf"))
        part = F.coalesce(F.floor(-F.col("score") / step).cast("double"), end)
        s = ranked_by_range(s, groups, order, {"__side": F.col("__side"), "__part": part, "__grams": F.when(F.col("__large"), F.coalesce(grams, end))}, most_in_range)
    else:
        s = s.withColumn("rank", F.row_number().over(W.partitionBy(*group).orderBy(*order)))
    label = F.when(F.col("__side"), BADGES["side"]).when(F.col("rank") == 1, BADGES["best"])
    more = F.when(label.isNull(), F.col("badges")).otherwise(F.slice(F.concat(F.array(label), F.col("badges")), 1, MOST_BADGES))
    return s.withColumn("badges", more).drop("__side")


def top_meals(scored: DataFrame, groups: list[str], keys: list[str], k: int = 5) -> DataFrame:
    """The first k of `rank_meals`; Spark cuts each group while it sorts."""
    return rank_meals(scored, groups, keys).where(F.col("rank") <= k)


def displayed(scored: DataFrame) -> DataFrame:
    """Texts for a card: grams, calories and score."""
    whole = lambda c: half_up(F.col(c)).cast("long").cast("string")
    return scored.withColumns({"protein_text": F.concat(whole("protein_g"), F.lit("g")), "calories_text": F.concat(whole("calories"), F.lit(" cal")), "score_text": F.concat(F.col("score").cast("string"), F.lit("/100"))})
