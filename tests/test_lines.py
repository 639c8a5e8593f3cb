"""Normalising of texts and lines against plain steps, one pattern after the other."""

import random

from pyspark.sql import functions as F

from menurank.functions import menu_text as M
from menurank.functions.rules import any_match
from menurank.operators.lines import menu_lines

STEPS = [
    (r"\.{2,}", " "), (r"(?:\s*\.\s*){3,}", " "), (r"[–—_]{2,}", " "), (r"^[\s*•·‣▪◦⁃∙\-–—]+", ""), (r"\$\s+(?=\d)", r"\$"), (r"(\d)\s*\.\s*(\d{2})(?![A-Za-z0-9_])", "$1.$2"), (r"\s*[·|]\s*", " "), (r"[\t ]+", " "), (rf"^{M.WHITE}+|{M.WHITE}+$", ""),
]
BOILERPLATE = [
    r"consuming raw or undercooked", r"foodborne illness", r"prices? (are )?(subject to change|may vary)", r"\bgratuity\b", r"please (inform|notify|alert) (your|the) server", r"before placing your order", r"\ballerg(y|en|ies)\b",
    r"substitutions? (may be )?(charged|extra)", r"\bcopyright\b|©\s*\d{4}", r"all rights reserved", r"^(v|vg|gf|df|n)\s*[=:-]", r"add (chicken|steak|shrimp|salmon|tofu|protein|bacon)\b.{0,24}\$?\d",
    r"^(join|sign up|scan|follow us|visit us|please visit|order online|call us|book|reserve|download|subscribe)\b", r"^get \d{1,2}%", r"\b\d{1,2}% off\b", r"\b(rewards club|gift cards?)\b", r"\bqr code\b", r"^@[\w.]+$", r"^www\.[\w.-]+", r"\bhttps?://", r"^est\.?\s*\d{4}$",
    r"^\(?\d{3}\)?[\s.-]?\d{3}[\s.-]?\d{4}$",
]
SAID = [
    "consuming raw or undercooked", "foodborne illness", "price may vary", "prices are subject to change", "gratuity", "please alert your server", "before placing your order", "allergies", "substitution extra", "substitutions may be charged", "copyright", "© 2024", "all rights reserved",
    "GF:", "add tofu for $3", "add bacon", "join", "scan", "get 20%", "20% off", "rewards club", "gift cards", "qr code", "@me.you", "www.a-b", "https://", "est. 1999", "(555) 123-4567",
]
SIGNS = [*" \t\x0b\f\r$.·|–—_-*•‣1234567890aBz", "\n", "\u00a0", "\u2028", "\u2029", "\x85", "\ufeff", "\u200b", "\u2009", "\u3000", "“", "’", "é", "ﬁ", "ı", "İ", "ſ", "\u212a"]


def lines():
    rng = random.Random(5)
    odd = {"i": "ıİ", "s": "ſ", "k": "\u212a"}
    out = ["", "a \n", "x . . . 12 . 50", "$ 5 | 6", "a \x85", " \u2028\x85", "ALL CAPS", "A1", "É", "ÉA"]
    out += ["".join(rng.choices(SIGNS, k=rng.randrange(1, 14))) for _ in range(3000)]
    for said in SAID:
        for _ in range(25):
            text = "".join(rng.choice([c, c.upper(), *odd.get(c.lower(), "")]) if rng.random() < 0.3 else c for c in said)
            out.append(rng.choice(["", "", " ", "x", "the ", "-"]) + (text if rng.random() < 0.9 else text[: rng.randrange(len(text))]) + rng.choice(["", "", " ", "x", " 12", "."]))
    return out


def replaced(x, steps):
    for pattern, by in steps:
        x = F.regexp_replace(x, pattern, by)
    return x


def test_lines_equal_plain_steps(spark):
    line = F.col("line")
    text = replaced(F.col("composed"), [(r"\r\n?", "\n"), (r"[\u00A0\u2000-\u200A\u202F\u205F\u3000]", " "), (r"[\u200B\u200C\u200D\uFEFF]", "")])
    checks = {
        "normal": (M.normalize_line(line), replaced(line, STEPS)),
        "text": (M.normalize_text(line), F.translate(text, "“”‘’", "\"\"''")),
        "boilerplate": (M.is_boilerplate(line), ~line.rlike("[a-zA-Z0-9]") | any_match(line, BOILERPLATE)),
        "capitals": (M.is_all_caps(line), line.rlike("[A-Z]") & (line == F.upper(line))),
    }
    df = spark.createDataFrame([(x,) for x in lines()], "line string").withColumn("composed", M.nfkc(line))
    rows = df.select(line, *[F.struct(a.alias("a"), b.alias("b")).alias(n) for n, (a, b) in checks.items()]).collect()
    for n in checks:
        assert not [(r["line"], r[n]) for r in rows if r[n]["a"] != r[n]["b"]][:5], n
    found = sum(r["boilerplate"]["a"] for r in rows)
    assert 300 < found < len(rows) - 1000


def test_lines_are_made_once(spark):
    pages = spark.createDataFrame([(1, "a . . . 5\n\nB"), (2, None)], "page_id long, text string")
    out = menu_lines(pages)
    assert out._jdf.queryExecution().executedPlan().toString().count(STEPS[1][0]) == 1
    assert sorted(map(tuple, out.collect())) == [(1, 0, "a 5"), (1, 1, ""), (1, 2, "B")]
