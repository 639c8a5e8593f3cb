"""Ingredients found in a dish's words, and the macros of its portions."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dims
from ..functions.classify import dish_type
from ..functions.confidence import macro_confidence
from ..functions.rules import half_up, java, matches
from .scan import dealt

# Preparation signals.
SIGNALS = {
    "fried": r"\b(fried|crispy|breaded|battered|panko|tempura|katsu|crunchy)\b",
    "creamy": r"\b(creamy|cream sauce|queso|alfredo|ranch|aioli|crema|smothered|au gratin|gratin)\b",
    "sweet": r"\b(glazed?|honey|teriyaki|bbq|barbecue|sweet chili|hoisin)\b",
    "caramel_glaze": r"\b(chili caramel|caramel glaze|gochujang|char ?siu|sticky soy)\b",
    "double_protein": r"\b(double|extra)\s+(protein|chicken|beef|steak|meat|shrimp|prawns?|salmon|tuna|tofu)\b",
    "extra_cheese": r"\b(extra|double) cheese\b",
    "no_bread": r"\b(lettuce wrap(ped)?|no bun|bunless|protein style|no bread|no tortilla)\b",
    "no_carb": r"\b(low[- ]carb|keto|no rice)\b",
}
# Patterns of ounces and half portions.
CUT_OUNCES = r"(\d+(?:\.\d+)?)\s*oz\.?\s+(?:of\s+)?(?:prime\s+|dry[- ]?aged\s+|bone[- ]?in\s+|blackened\s+|grilled\s+|seared\s+|top\s+|cab[®\s]+)*(?:sirloin|rib[- ]?eye|new york|ny\b|strip|filet|tenderloin|steak|porterhouse|t[- ]?bone|wagyu|chicken(?:\s+breast)?|breast|salmon|prawns?|shrimp|tuna|pork|lamb|halibut|cod)"
STEAK_NAME = r"\b(sirloin|rib[- ]?eye|new york|ny strip|strip|filet|tenderloin|porterhouse|t[- ]?bone|tomahawk|wagyu|steak)\b"
BARE_OUNCES = r"(\d+(?:\.\d+)?)\s*oz\b(?!\s*\.?\s*(?:fries|chips|rice|potatoes?|salad|slaw|vegetables?|sauce|dip|butter))"
HALF = r"^\s*(?:1/2|½|half)\s+(.+)$"
HALF_WEIGHT = r"^(?:lb|lbs|pound|oz|ounces?|dozen|kg)\b"
HALF_CUT = r"^(?:(?:rotisserie|roast(?:ed)?|smoked|grilled|fried|bbq|jerk|herb)\s+)*(?:chicken|bird)$|^(?:rack|slab)\b|\bribs?\b"
# What a preparation adds (protein, carbs, fat), unless one of the foods was costed.
DELTAS = {
    "fried": ((0, 12, 10), ["fried_chicken"], "Added breading and frying oil for a fried/crispy item.", "Fried/crispy preparation is already included in the fried chicken values."),
    "creamy": ((0, 2, 9), ["mayo", "crema", "ranch_dressing", "caesar_dressing", "alfredo_sauce", "pesto"], "Added fat for a creamy sauce or dressing.", "Creamy preparation is already included in the sauce values."),
    "caramel_glaze": ((0, 40, 9), ["bbq_sauce", "teriyaki_sauce", "honey", "sweet_glaze"], "Added a caramel/gochujang glaze — reduced sugar plus oil, generously coating the protein.", "Caramel glaze is already included in the sauce values."),
    "sweet": ((0, 15, 0), ["bbq_sauce", "teriyaki_sauce", "honey", "sweet_glaze"], "Added sugar for a glazed, honey, teriyaki, or BBQ item.", "Sweet glaze is already included in the sauce values."),
}
# Foods that are cooked in fat, fats, grams of it, and slots that count without a portion.
COOKED = ["chicken_breast", "steak", "beef", "turkey", "shrimp", "white_fish", "tuna", "pork", "tofu"]
FATS = ["olive_oil", "butter"]
COOKING_FAT = 6
COSTED_WITHOUT_SLOT = ["cheese", "sauce", "fat"]
MACROS = ["calories", "protein_g", "carbs_g", "fat_g"]
PHRASES = java(r",|;|\band\b|\bwith\b|\bover\b|\btopped with\b|&")


def match_text(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "))


def said(name: Column, description: Column) -> Column:
    return F.concat(F.coalesce(name, F.lit("")), F.lit(" "), F.coalesce(description, F.lit("")))


FOOD = ["normalized_name", "category", "slot", "nutrition_key", "label", "serving_amount", "serving_unit", "condiment", *MACROS]


def quoted(x: str) -> str:
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"


@cache
def default_foods() -> tuple[str, str, str]:
    """The default names and foods in Spark's SQL: the names, a map from name to rank, and the foods as lines in the order of ranks.

    Map and lines are made of literals. Functions of texts, which Spark would turn into constants, too, make the driver load the tables of
    all collations when they do: that takes 3.4 GB of passing objects, for which its heap grows to about 500 MB.
    """
    food = {r[0]: r[1:] for r in dims.nutrition_rows()}
    rank, lines = {}, []
    for alias, ord_, name, category, slot, key in dims.alias_rows():
        label, amount, unit, *macros, condiment = food[key]
        lines.append("|".join(map(str, [alias, name, category, slot, key, label, amount, unit, str(condiment).lower(), *macros])))
        if "-" not in alias:  # a hyphen is never in the text that is searched
            rank.setdefault(alias, ord_)
    return ", ".join(map(quoted, rank)), f"map({', '.join(f'{quoted(a)}, {o}' for a, o in rank.items())})", f"array({', '.join(map(quoted, lines))})"


def hits_in_row(items: DataFrame) -> DataFrame:
    """Add h, the hits of the words in w by rank: runs of one to three words are looked up in constants, so no row is copied or shuffled."""
    names, rank, foods = default_foods()
    run = lambda n: f"transform(w, (x, i) -> struct(i AS at, {n} AS n, concat_ws(' ', x{''.join(f', get(w, i + {j})' for j in range(1, n))}) AS alias))"
    found = f"filter(concat({run(1)}, {run(2)}, {run(3)}), g -> g.at + g.n <= size(w) AND g.alias IN ({names}))"
    kinds = {"serving_amount": "double", "condiment": "boolean"} | dict.fromkeys(MACROS, "double")
    fields = ", ".join(f"cast(x.line[{i + 1}] AS {kinds.get(c, 'string')}) AS {c}" for i, c in enumerate(FOOD))
    t = items.withColumn("h", F.expr(f"transform({found}, g -> struct({rank}[g.alias] AS ord, g.at AS at, g.n AS n))"))
    t = t.withColumn("h", F.expr(f"transform(array_sort(h), x -> struct(x.ord AS ord, x.at AS at, x.n AS n, split({foods}[x.ord], '[|]') AS line))"))
    return t.withColumn("h", F.expr(f"transform(h, x -> struct(x.ord AS ord, x.at AS at, x.n AS n, struct(x.ord AS alias_ord, x.line[0] AS alias, {fields}) AS food))"))


def hits_by_join(items: DataFrame, keys: list[str], aliases: DataFrame, nutrition: DataFrame) -> DataFrame:
    """Add h as `hits_in_row` does, from tables of any size: runs of words are joined to them, with the keys alone, and meet again by key."""
    food = aliases.where(~F.col("alias").contains("-")).join(nutrition.withColumnRenamed("key", "nutrition_key"), "nutrition_key").select("alias", F.struct("alias_ord", "alias", *FOOD).alias("food"))
    own = [F.col(k).alias(f"__{k}") for k in keys]
    t = items.select(*own, "w", F.explode(F.sequence(F.lit(0), F.size("w") - 1)).alias("at"))
    t = t.select("*", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("n")).where("at + n <= size(w)").withColumn("alias", F.array_join(F.slice("w", F.col("at") + 1, F.col("n")), " ")).drop("w")
    t = t.join(food, "alias").groupBy(*[f"__{k}" for k in keys]).agg(F.array_sort(F.collect_set(F.struct(F.col("food.alias_ord").alias("ord"), "at", "n", "food"))).alias("h"))
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    out = items.join(t, same, "left").drop(*[f"__{k}" for k in keys])
    return out.withColumn("h", F.coalesce("h", F.slice("h", 1, 0), F.array().cast(t.schema["h"].dataType)))


def detect_ingredients(items: DataFrame, keys: list[str], aliases: DataFrame | None = None, nutrition: DataFrame | None = None, active: Column | None = None) -> DataFrame:
    """Add `matches`, the ingredients that the name and description mention, in order, and phrase counts.

    Of runs of one to three words that are names of ingredients, the longest come first, then the earlier in
    the table; one that overlaps a run that stays is dropped, one that overlaps only dropped ones stays; an ingredient counts
    once. Each match carries its food's nutrition. The default tables are constants of the plan; a caller's
    are joined by the `keys` that identify an item. Items without a match, and those that aren't `active`, have an empty array.
    """
    spark = items.sparkSession
    columns = items.columns
    words = F.split(match_text(said(F.col("dish_name"), F.col("description"))), " ")
    t = items.withColumn("w", words if active is None else F.when(active, words).otherwise(F.array(F.lit(""))))
    if aliases is None and nutrition is None:
        t = hits_in_row(t)
    else:
        t = hits_by_join(t, keys, dims.aliases(spark) if aliases is None else aliases, dims.nutrition(spark) if nutrition is None else nutrition)
    none = F.slice(F.col("h"), 1, 0)
    free = F.aggregate("h", none, lambda acc, x: F.when(F.exists(acc, lambda y: (y["at"] < x["at"] + x["n"]) & (x["at"] < y["at"] + y["n"])), acc).otherwise(F.concat(acc, F.array(x))))
    t = t.withColumn("h", F.when(F.size("h") > 1, free).otherwise(F.col("h")))
    once = F.aggregate("h", none, lambda acc, x: F.when(F.exists(acc, lambda y: y["food"]["normalized_name"] == x["food"]["normalized_name"]), acc).otherwise(F.concat(acc, F.array(x))))
    t = t.withColumn("h", F.when(F.size("h") > 1, once).otherwise(F.col("h")))
    shape = lambda x: F.struct(
        x["at"].alias("at"), x["food"]["alias"].alias("raw_text"), F.when(F.instr(x["food"]["alias"], " ") > 0, 0.9).otherwise(0.75).alias("confidence"), *[x["food"][f].alias(f) for f in FOOD]
    )
    out = t.select(*columns, F.array_sort(F.transform("h", shape)).alias("matches"))
    phrases = F.filter(F.transform(F.split(F.coalesce("description", F.lit("")), PHRASES), match_text), lambda p: F.length(p) >= 3)
    out = out.withColumn("__p", phrases)
    known = F.filter("__p", lambda p: F.exists("matches", lambda m: F.instr(p, m["raw_text"]) > 0))
    return out.withColumns({"phrases": F.size("__p"), "phrases_known": F.size(known)}).drop("__p")


def preparation(name: Column, description: Column) -> dict[str, Column]:
    """Signals by name: eight booleans, the ounces of protein that are stated, and whether it is half a portion."""
    text = said(name, description)
    out = {k: matches(text, p) for k, p in SIGNALS.items()}
    ounces = lambda p: F.regexp_extract(text, java(p), 1).try_cast("double")
    fits = lambda x: F.when(x.between(4, 40), x)
    out["stated_ounces"] = F.coalesce(fits(ounces(CUT_OUNCES)), F.when(matches(name, STEAK_NAME), fits(ounces(BARE_OUNCES))))
    rest = F.trim(F.regexp_extract(name, java(HALF), 1))
    out["half_portion"] = (rest != "") & ~matches(rest, HALF_WEIGHT) & ~matches(rest, HALF_CUT)
    return {k: F.coalesce(v, F.lit(False)) if k != "stated_ounces" else v for k, v in out.items()}


def number_text(x: Column) -> Column:
    """A number without a needless .0."""
    return F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(x.cast("string"))


def portion_text(amount: Column, unit: Column) -> Column:
    plural = unit.isin("serving", "cup") & (amount != 1)
    return F.concat(number_text(amount), F.lit(" "), unit, F.when(plural, "s").otherwise(""))


def article(word: Column) -> Column:
    return F.when(word.rlike("(?i)^[aeiou]"), "an").otherwise("a")


def with_portions(items: DataFrame, templates: DataFrame, nutrition: DataFrame, send: Callable[[DataFrame], DataFrame] = F.broadcast) -> DataFrame:
    """Add `slots`, the portions of the dish type's template after the adjustments that the words ask for, and `removed`."""
    kind = F.when(F.col("dish_type") == "unknown", dims.FALLBACK_DISH_TYPE).otherwise(F.col("dish_type"))
    food = nutrition.select(F.col("key").alias("default_key"), "label", "serving_amount", "serving_unit", "condiment", *MACROS)
    slot = F.struct("slot_ord", "slot", "amount", "unit", "assume_when_absent", "default_key", "label", "serving_amount", "serving_unit", "condiment", *MACROS)
    by_type = templates.join(send(food), "default_key", "left").groupBy(F.col("dish_type").alias("__type")).agg(F.array_sort(F.collect_list(slot)).alias("__slots"))
    t = items.join(send(by_type), kind == F.col("__type"), "left")
    protein, cheese = (lambda s: s["slot"] == "protein"), (lambda s: s["slot"] == "cheese")
    amount = lambda s: F.when(protein(s) & F.col("stated_ounces").isNotNull(), F.col("stated_ounces")).otherwise(s["amount"] * F.when((protein(s) & F.col("double_protein")) | (cheese(s) & F.col("extra_cheese")), 2.0).otherwise(1.0))
    gone = lambda s: ((s["slot"] == "bread") & (F.col("no_bread") | F.col("no_carb"))) | ((s["slot"] == "carb") & F.col("no_carb"))
    change = lambda s: s.withField("amount", amount(s)).withField("assume_when_absent", s["assume_when_absent"] | (cheese(s) & F.col("extra_cheese")))
    kept = F.transform(F.filter("__slots", lambda s: ~gone(s)), change)
    return t.withColumns({"slots": kept, "removed": F.transform(F.filter("__slots", gone), lambda s: s["slot"])}).drop("__slots", "__type")


def with_costs(t: DataFrame) -> DataFrame:
    """Add `costs` of the matches and `assumed` of the slots that stay empty, each with factor, whether it counts and fills, and a note."""
    one = F.concat(article(F.col("__label")), F.lit(" "), F.col("__label"))
    same = lambda m: F.filter("matches", lambda x: x["slot"] == m["slot"])
    placed = F.transform(
        "matches",
        lambda m: m.withField("portion", F.get(F.filter("slots", lambda s: s["slot"] == m["slot"]), F.lit(0)))
        .withField("bulk", F.size(F.filter(same(m), lambda x: ~x["condiment"])))
        .withField("group", F.array_min(F.transform(same(m), lambda x: x["at"]))),
    )
    t = t.withColumn("__placed", placed)

    def cost(m: Column) -> Column:
        slotted, scales = m["portion"].isNotNull(), F.coalesce(m["portion"]["unit"] == m["serving_unit"], F.lit(False))
        counted = m["condiment"] | slotted | m["slot"].isin(COSTED_WITHOUT_SLOT)
        share = m["portion"]["amount"] / m["bulk"]
        note = (
            F.when(m["condiment"], F.concat(F.lit("Assumed 1 standard serving of "), m["label"], F.lit(".")))
            .when(~slotted & ~counted, F.concat(F.lit("Did not count "), m["label"], F.lit(" — likely a side or garnish rather than part of "), one, F.lit(".")))
            .when(~slotted, F.concat(F.lit("Counted 1 standard serving of "), m["label"], F.lit(" ("), one, F.lit(" has no set "), m["slot"], F.lit(" portion).")))
            .when(scales, F.concat(F.lit("Assumed "), portion_text(half_up(share, 1), m["portion"]["unit"]), F.lit(" of "), m["label"], F.lit(".")))
            .otherwise(F.concat(F.lit("Assumed 1 standard serving of "), m["label"], F.lit(" (portion units differ).")))
        )
        factor = F.when(~counted, 0.0).when(~m["condiment"] & slotted & scales, share / m["serving_amount"]).otherwise(1.0)
        return F.struct(
            m["group"].alias("group"), F.when(m["condiment"], 0).otherwise(1).alias("second"), m["at"].alias("at"), counted.alias("counted"), (counted & (m["condiment"] | slotted)).alias("fills"), m["slot"].alias("slot"),
            m["nutrition_key"].alias("key"), m["normalized_name"].alias("name"), note.alias("say"), *[(m[x] * factor).alias(x) for x in MACROS],
        )

    t = t.withColumn("costs", F.array_sort(F.transform("__placed", cost)))
    t = t.withColumn("__by_match", F.transform(F.filter("costs", lambda c: c["fills"]), lambda c: c["slot"]))

    def assumption(s: Column) -> Column:
        factor = F.when(s["condiment"] | (s["unit"] != s["serving_unit"]), 1.0).otherwise(s["amount"] / s["serving_amount"])
        note = F.concat(F.lit("Assumed "), portion_text(s["amount"], s["unit"]), F.lit(" of "), s["label"], F.lit(" — typical for "), one, F.lit("."))
        return F.struct(s["slot"].alias("slot"), s["default_key"].alias("key"), note.alias("say"), *[(s[x] * factor).alias(x) for x in MACROS])

    empty = F.filter("slots", lambda s: s["assume_when_absent"] & s["label"].isNotNull() & ~F.array_contains("__by_match", s["slot"]))
    return t.withColumn("assumed", F.transform(empty, assumption)).drop("__placed")


def estimate_macros(items: DataFrame, keys: list[str], nutrition: DataFrame | None = None, templates: DataFrame | None = None, aliases: DataFrame | None = None, active: Column | None = None, kind: Column | None = None) -> DataFrame:
    """Add dish_type, estimated macros, macro_confidence, detected ingredients and assumptions to dishes.

    `items` has `keys` (which identify it), dish_name, description, section and, where a menu
    states some macros, partial_calories .. partial_fat_g, which take the estimate's place. Items are dealt out by `keys`.
    The default tables of nutrition, templates and aliases are of fixed size and broadcast; given ones may be of any size. Apart from the
    one aggregation that gathers an item's matches, all is per row. Items that aren't
    `active` pass through without being searched. `kind` is what `dish_type` gives, where it is known already.
    """
    spark = items.sparkSession
    t_nutrition, send = nutrition, F.broadcast if nutrition is None and templates is None else lambda t: t
    nutrition = dims.nutrition(spark) if nutrition is None else nutrition
    templates = dims.templates(spark) if templates is None else templates
    given = items.columns
    t = dealt(items, keys).withColumns({c: F.lit(None).cast("double") for c in [f"partial_{m}" for m in MACROS] if c not in given})
    t = detect_ingredients(t, keys, aliases, t_nutrition, active)
    t = t.withColumn("__kind", dish_type(F.col("dish_name"), F.col("description"), F.col("section")) if kind is None else kind)
    t = t.withColumns({"dish_type": F.col("__kind.dish_type"), "__supports": F.col("__kind.section_supports")} | preparation(F.col("dish_name"), F.col("description")))
    t = t.withColumn("__label", F.regexp_replace(F.when(F.col("dish_type") == "unknown", dims.FALLBACK_DISH_TYPE).otherwise(F.col("dish_type")), "_", " "))
    t = with_costs(with_portions(t, templates, nutrition, send))
    total = lambda c, m: F.aggregate(c, F.lit(0.0), lambda acc, x: acc + x[m])
    t = t.withColumns({f"__{m}": total("costs", m) + total("assumed", m) for m in MACROS})
    paid = lambda f: F.transform(F.filter("costs", lambda c: c["counted"]), lambda c: c[f])
    t = t.withColumns({
        "__keys": F.concat(paid("key"), F.transform("assumed", lambda c: c["key"])),
        "__filled": F.concat("__by_match", F.transform("assumed", lambda c: c["slot"])),
        "__counted": paid("name"),
        "__notes": F.concat(F.transform("costs", lambda c: c["say"]), F.transform("assumed", lambda c: c["say"])),
    })
    return finish(t).select(*[c for c in given if c != "dish_type"], "dish_type", *MACROS, "macro_confidence", "detected_ingredients", "assumptions")


def finish(t: DataFrame) -> DataFrame:
    """Preparation, half portions, rounding, stated macros, confidence, and all assumptions in order."""
    has = lambda keys: F.arrays_overlap("__keys", F.array(*map(F.lit, keys)))
    fires = {k: F.col(k) & ~F.col("caramel_glaze") if k == "sweet" else F.col(k) for k in DELTAS}
    adds = {k: fires[k] & ~has(v[1]) for k, v in DELTAS.items()}
    oil = has(COOKED) & ~F.col("fried") & ~has(FATS)
    grams = {m: sum((F.when(adds[k], float(v[0][i])).otherwise(0.0) for k, v in DELTAS.items()), F.when(oil, float(COOKING_FAT) if m == "fat_g" else 0.0).otherwise(0.0)) for i, m in enumerate(MACROS[1:])}
    t = t.withColumns({f"__d_{m}": v for m, v in grams.items()})
    total = {m: F.col(f"__{m}") + F.col(f"__d_{m}") for m in MACROS[1:]}
    total["calories"] = F.col("__calories") + F.col("__d_protein_g") * 4 + F.col("__d_carbs_g") * 4 + F.col("__d_fat_g") * 9
    whole = {}
    for m, v in total.items():
        v = F.when(F.col("half_portion"), v / 2).otherwise(v)
        v = half_up(v, 6)  # sums in another order may differ in the last place
        v = half_up(v / 5) * 5 if m == "calories" else half_up(v)
        whole[m] = F.coalesce(F.col(f"partial_{m}"), F.greatest(F.lit(0.0), v))
    filled = lambda s: F.array_contains("__filled", s)
    core = filled("protein") & (filled("carb") | filled("bread") | filled("vegetable"))
    protein = F.exists("matches", lambda m: m["slot"] == "protein")
    confidence = macro_confidence(F.col("dish_name"), F.col("dish_type"), F.col("description"), protein, F.size("matches"), core, F.col("__supports"), F.col("phrases_known"), F.col("phrases"))
    gone = F.array_join("removed", " and ")
    unit = {"calories": ("calorie count", ""), "protein_g": ("protein", "g"), "carbs_g": ("carb count", "g"), "fat_g": ("fat count", "g")}
    before = [
        F.when(F.col("dish_type") == "unknown", f"Dish type not recognized; used generic {dims.FALLBACK_DISH_TYPE} portions."),
        F.when(F.col("double_protein"), "Doubled the protein portion for a double/extra protein item."),
        F.when(F.col("stated_ounces").isNotNull(), F.concat(F.lit("Used the "), number_text(F.col("stated_ounces")), F.lit(" oz protein portion stated on the menu."))),
        F.when(F.col("extra_cheese"), "Doubled the cheese portion for an extra-cheese item."),
        F.when(F.size("removed") > 0, F.concat(F.lit("Removed the "), gone, F.lit(" portion — the item is described as low-carb or served without it."))),
    ]
    after = [F.when(fires[k], F.when(has(v[1]), v[3]).otherwise(v[2])) for k, v in DELTAS.items()]
    after += [
        F.when(oil, "Added ~1–2 tsp of restaurant cooking oil — grilled and roasted proteins are rarely cooked dry."),
        F.when(F.col("half_portion"), "Halved the estimate — the name marks this as a half portion."),
        *[F.when(F.col(f"partial_{m}").isNotNull(), F.concat(F.lit(f"Used the {unit[m][0]} printed on the menu ("), number_text(F.col(f"partial_{m}")), F.lit(f"{unit[m][1]}) instead of estimating it."))) for m in MACROS],
    ]
    assumptions = F.concat(F.array_compact(F.array(*before)), F.col("__notes"), F.array_compact(F.array(*after)))
    detected = F.transform("matches", lambda m: F.struct(m["raw_text"].alias("raw_text"), m["normalized_name"].alias("normalized_name"), m["category"].alias("category"), m["confidence"].alias("confidence"), F.array_contains("__counted", m["normalized_name"]).alias("counted_in_macros")))
    return t.withColumns(whole | {"macro_confidence": confidence, "assumptions": assumptions, "detected_ingredients": detected})
