"""Macros that a text publishes: numbers and nutrient labels, paired with their neighbours."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rules import half_up

# Fixed values.
MACROS = ["calories", "protein_g", "carbs_g", "fat_g"]
RANGES = {"calories": (20, 3000), "protein_g": (0, 300), "carbs_g": (0, 400), "fat_g": (0, 300)}
LABELS = {
    "calories": "calories|calorie|kcals|kcal|cals|cal",
    "protein_g": "protein",
    "carbs_g": "total carbohydrates|total carbohydrate|carbohydrates|carbohydrate|carbs|carb",
    "fat_g": "total fat|fat",
}
#: A part of all labels of a macro, to tell soon that a text has none.
STEMS = {"calories": "cal", "protein_g": "protein", "carbs_g": "carb", "fat_g": "fat"}
#: What is blanked before reading, in two steps: the second is looked for in what the first leaves.
SUBLINES = [
    r"(?:saturated|sat\.?|trans|mono(?:un)?saturated|poly(?:un)?saturated|unsaturated)\s+fat|fat\s+calories|(?:dietary\s+)?fib(?:er|re)|(?:added\s+|total\s+)?sugars?",
    r"calories\s+from\s+fat",
]
NUMBER = r"(?<![\$\d.])(\d{1,4}(?:\.\d{1,2})?)\s*(?:(g)(?:rams?|r)?)?(?![\w.])"
TOLERANCE = 0.4
ATTEMPTS = [("before", "first"), ("after", "first"), ("before", "last"), ("after", "last")]


def whole_words(pattern: str) -> str:
    """The pattern, which begins and ends with letters, not within a longer word."""
    return f"(?<![A-Za-z0-9_])(?:{pattern})(?![A-Za-z0-9_])"


def with_short_form(items: DataFrame, text: Column) -> DataFrame:
    """Add __short: numbers and labels of a text in their order, `450;;calories30g;;protein2g;!`; null where it has no label.

    Lower case, single spaces, lines of a nutrient's parts blanked; a ! marks what stood in parentheses. Where those aren't
    nested, the next one tells: it closes. Other texts are read token by token. Every step is a column of its own, so that it is
    computed once.
    """
    low = F.lower(text)
    t = items.withColumn("__short", F.when(F.coalesce(reduce(or_, [low.contains(x) for x in STEMS.values()]), F.lit(False)), F.translate(low, "\u0001\u0002", "  ")))
    short = F.col("__short")
    labels, token = whole_words("|".join(LABELS.values())), "[0-9.]+g?;|;[a-z ]+"
    t = t.withColumn("__short", F.when(short.rlike(r"[^\S ]|[ \x{A0}]{2}|\x{A0}"), F.regexp_replace(short, r"[\s\x{A0}]+", " ")).otherwise(short))
    t = t.withColumn("__short", F.regexp_replace(short, whole_words(SUBLINES[0]), " "))
    t = t.withColumn("__short", F.when(short.contains("calories from"), F.regexp_replace(short, whole_words(SUBLINES[1]), " ")).otherwise(short))
    marked = F.regexp_replace(short, f"{NUMBER}|({labels})", "\u0001$1$2;$3\u0002")
    t = t.withColumn("__short", F.translate(F.regexp_replace(marked, "(?<![^\u0002()])[^\u0001\u0002()]+", ""), "\u0001\u0002", ""))
    flat = F.regexp_replace(short, rf"({token})(?=[^()]*\))", "$1!")
    step = lambda acc, x: F.struct(
        (acc["depth"] + F.when(x == "(", 1).when(x == ")", -1).otherwise(0)).alias("depth"), F.concat(acc["out"], x, F.when(~x.isin("(", ")") & (acc["depth"] > 0), "!").otherwise("")).alias("out")
    )
    nested = F.aggregate(F.regexp_extract_all(short, F.lit(rf"[()]|{token}"), F.lit(0)), F.struct(F.lit(0).alias("depth"), F.lit("").alias("out")), step, lambda acc: acc["out"])
    inside = F.when(short.rlike(r"^(?:[^()]*\([^()]*\))*[^()]*$"), flat).otherwise(nested)
    return t.withColumn("__short", F.when(short.contains("(") | short.contains(")"), F.translate(inside, "()", "")).otherwise(short))


def whole_numbers(low: int, high: int) -> str:
    """A pattern of the numbers from low to high, of one length each part, without leading zeros."""
    if len(str(low)) < len(str(high)):
        nines = 10 ** len(str(low)) - 1
        return f"{whole_numbers(low, nines)}|{whole_numbers(nines + 1, high)}"
    a, b = str(low), str(high)
    if a == b or len(a) == 1:
        return a if a == b else f"[{a}-{b}]"
    rest = len(a) - 1
    if set(a[1:]) == {"0"} and set(b[1:]) == {"9"}:
        return f"[{a[0]}-{b[0]}]" + r"\d" * rest
    if a[0] == b[0]:
        return f"{a[0]}(?:{whole_parts(a[1:], b[1:])})"
    cut = (int(a[0]) + 1) * 10**rest
    if set(a[1:]) == {"0"}:
        top = int(b[0]) * 10**rest
        return f"{whole_numbers(low, top - 1)}|{whole_numbers(top, high)}"
    return f"{whole_numbers(low, cut - 1)}|{whole_numbers(cut, high)}"


def whole_parts(a: str, b: str) -> str:
    """`whole_numbers` for digits that may begin with zeros."""
    if len(a) == 1:
        return f"[{a}-{b}]"
    return "|".join(f"{d}(?:{whole_parts(a[1:] if str(d) == a[0] else '0' * (len(a) - 1), b[1:] if str(d) == b[0] else '9' * (len(b) - 1))})" for d in range(int(a[0]), int(b[0]) + 1))


def pick(marked: Column, macro: str, side: str, which: str) -> Column:
    """A macro's value: the first or last fitting number next to its label on one side, in parentheses only if there is no other."""
    low, high = RANGES[macro]
    number = rf"(0*(?:{whole_numbers(low, high - 1)})(?:\.\d+)?|0*{high}(?:\.0+)?)" + ("g?;" if macro == "calories" else "g;")
    label, start = f";(?:{LABELS[macro]})", "" if which == "first" else "^.*"

    def found(plain: bool) -> Column:
        mark = "(?!!)" if plain else "!?"
        pattern = rf"{start}(?<![0-9.]){number}{'' if plain else '!?'}{label}(?![a-z ]){mark}" if side == "before" else f"{start}{label}{'' if plain else '!?'}{number}{mark}"
        return F.nullif(F.regexp_extract(marked, pattern, 1), F.lit(""))

    return F.coalesce(found(True), found(False)).try_cast("double")


def consistent(calories: Column, protein: Column, carbs: Column, fat: Column) -> Column:
    return F.coalesce((calories > 0) & (F.abs(4 * protein + 4 * carbs + 9 * fat - calories) <= TOLERANCE * calories), F.lit(False))


def read_macros(items: DataFrame, text: Column, prefix: str = "published_", partial: str = "partial_") -> DataFrame:
    """Add the full set (all four or none) and the partial set (each for itself, null where the full set is there).

    The full set is the first of four readings, values before or after their labels, first or
    last of several, that is complete and agrees with the calories. No shuffle.
    """
    kept = items.columns
    t = with_short_form(items, text)
    t = t.withColumns({"__labels": F.regexp_count("__short", F.lit(";[a-z]")), "__at": F.lit(None).cast("int")})
    for i, (side, which) in enumerate(ATTEMPTS):  # only where the earlier ones fail; with four labels or fewer, the last of a kind is the first
        open_ = F.col("__at").isNull() & (F.lit(True) if which == "first" else F.col("__labels") > len(MACROS))
        reads = {f"__r{i}_{m}": F.when(open_ & F.col("__short").contains(STEMS[m]), half_up(pick(F.col("__short"), m, side, which))) for m in MACROS}
        t = t.withColumns(reads).withColumn("__at", F.coalesce("__at", F.when(consistent(*map(F.col, reads)), i)))
    full = {prefix + m: F.coalesce(*[F.when(F.col("__at") == i, F.col(f"__r{i}_{m}")) for i in range(len(ATTEMPTS))]) for m in MACROS}
    part = {partial + m: F.when(F.col("__at").isNull(), F.coalesce(F.col(f"__r0_{m}"), F.col(f"__r1_{m}"))) for m in MACROS}
    return t.withColumns(full | part).select(*kept, *full, *part)


def published_calories(items: DataFrame, text: Column, name: str = "calories") -> DataFrame:
    """Add only the calories that a text states, complete set or not."""
    out = read_macros(items, text, "__f_", "__p_")
    return out.select(*items.columns, F.coalesce("__p_calories", "__f_calories").alias(name))
