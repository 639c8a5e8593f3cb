import random
import re

from pyspark.sql import functions as F

from menurank.functions import published as P


def plain(text):
    """Tokens one by one, pairs of neighbours, four readings."""
    t = re.sub(r"[\s\xa0]+", " ", (text or "").lower())
    for p in P.SUBLINES:
        t = re.sub(P.whole_words(p), " ", t)
    label = {x: m for m, all_ in P.LABELS.items() for x in all_.split("|")}
    out, depth = [], 0
    for m in re.finditer(rf"\(|\)|{P.NUMBER}|({P.whole_words('|'.join(label))})", t, re.A):
        if m[0] in "()":
            depth += 1 if m[0] == "(" else -1
        else:
            out.append((float(m[1]) if m[1] else None, label.get(m[3]), bool(m[2]), depth > 0))
    found = {}
    for side, step in (("before", -1), ("after", 1)):
        for i, (_, key, _, inside) in enumerate(out):
            value, _, grams, also = out[i + step] if 0 <= i + step < len(out) else (None,) * 4
            if key and value is not None and P.RANGES[key][0] <= value <= P.RANGES[key][1] and (grams or key == "calories"):
                found.setdefault((side, key), []).append((value, inside or also))
    read = []
    for side, which in P.ATTEMPTS:
        own = {}
        for m in P.MACROS:
            c = found.get((side, m), [])
            c = [x for x in c if not x[1]] or c
            own[m] = int(c[0 if which == "first" else -1][0] + 0.5) if c else None
        read.append(own)
    for own in read:
        k, p, c, f = own.values()
        if None not in (k, p, c, f) and k > 0 and abs(4 * p + 4 * c + 9 * f - k) <= 0.4 * k:
            return [*own.values(), None, None, None, None]
    return [None] * 4 + [a if a is not None else b for a, b in zip(read[0].values(), read[1].values(), strict=True)]


def test_against_plain_reading(spark):
    rng = random.Random(11)
    words = ["Calories", "kcal", "PROTEIN", "carbs", "Total Carbohydrate", "fat", "Total Fat", "(", ")", "(", ")", "Saturated Fat", "calories from fat calories", "sugars", "fiber", "and", "$12.50", "x2", "3.5", "fatty", "9.95."]
    texts = [None, "", "nothing", "450 Calories 30g Protein 40g Carbs 18g Fat", "Calories (450) protein 30 g carbs ((40g)) fat 18g) 12 g protein"]
    for _ in range(1500):
        parts = []
        for _ in range(rng.randint(1, 14)):
            parts.append(rng.choice([f"{rng.choice([0, 7, 30, 300, 301, 400, 401, 3000, 3001, 450, 12.5, 45])}{rng.choice(['', 'g', ' g', ' grams', 'G'])}", rng.choice(words), rng.choice(words)]))
        texts.append(rng.choice([" ", ": ", "  "]).join(parts))
    for _ in range(500):  # whole sets, in both orders, with doubled and bracketed values
        p, c, f = rng.randint(0, 80), rng.randint(0, 90), rng.randint(0, 50)
        k = int((4 * p + 4 * c + 9 * f) * rng.choice([1, 1.3, 1.5]))
        one = [f"{k} cal", f"{p}g protein", f"({c} g carbs)" if rng.random() < 0.3 else f"{c} g carbs", f"{f}g fat"] if rng.random() < 0.5 else [f"cal {k}", f"protein: {p}g", f"carbs {c}g", f"total fat {f} g"]
        rng.shuffle(one)
        texts.append(" ".join(one + rng.choice([[], ["(", "200 cal", "5g fat", ")"], ["120 cal"], ["fat 3g"]])))
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").repartition(4)
    got = {r["i"]: [*r][2:] for r in P.read_macros(df, F.col("text")).collect()}
    wrong = [(t, got[i], plain(t)) for i, t in enumerate(texts) if got[i] != plain(t)]
    assert not wrong, wrong[:3]
    assert sum(got[i][0] is not None for i in got) > 100 and sum(any(got[i][4:]) for i in got) > 300


def test_published_calories(spark):
    df = spark.createDataFrame([("450 Calories 30g Protein 40g Carbs 18g Fat",), ("300 kcal and 20 g protein",), ("plain",)], "text string")
    assert [r["calories"] for r in P.published_calories(df, F.col("text")).collect()] == [450, 300, None]


def test_number_patterns():
    for low, high in ((20, 2999), (0, 299), (0, 399), (7, 8), (37, 4512), (100, 100), (9, 10)):
        r = re.compile(f"(?:{P.whole_numbers(low, high)})$")
        assert [i for i in range(10000) if r.match(str(i))] == list(range(low, high + 1))
    assert all(P.STEMS[m] in x for m, all_ in P.LABELS.items() for x in all_.split("|"))
