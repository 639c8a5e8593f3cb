"""Line deduplication by the number of distinct sites that a line occurs on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .jobs import durable, fresh

NO_SITE = "\x00no site"
SPACE, WORD = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"
#: A character of a script without spaces is a word, as far as a line's length goes.
OWN_WORD = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}]"
#: Most lines that are sent to the scan of the texts; more are joined, with SALTS parts a line.
MOST_SENT, SALTS = 100_000, 16


def exploded(docs: DataFrame, id_col: str, text_col: str, site_col: str, min_words: int, short: bool) -> DataFrame:
    """(id, h, site, pos, k1, k2, is_short): each line that isn't blank by two hashes of its trimmed text.

    is_short: of fewer than min_words words; such lines only if `short`. h tells apart texts that share an id.
    """
    d = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), F.coalesce(F.col(site_col).cast("string"), F.lit(NO_SITE)).alias("site"), F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("pos", "line"))
    long = F.col("line").rlike(rf"^{SPACE}*({WORD}+{SPACE}+){{{min_words - 1}}}{WORD}")
    if short:
        long |= F.col("line").rlike(rf"({OWN_WORD}[^\n]*?){{{min_words}}}")
    d = d.where(F.col("id").isNotNull() & (F.col("line").rlike(WORD) if short else long))
    line = F.regexp_replace("line", rf"^{SPACE}+|{SPACE}+$", "")
    return d.select("id", "h", "site", "pos", F.xxhash64(line).alias("k1"), F.xxhash64(line, F.lit(1)).alias("k2"), (~long).alias("is_short"))


def meet(lines: DataFrame, few: DataFrame) -> DataFrame:
    """`lines` joined with `few`, one row per (k1, k2), so that a line on very many texts isn't met in one task."""
    if few.count() <= MOST_SENT:
        return lines.join(F.broadcast(few), ["k1", "k2"])
    salted = few.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return lines.withColumn("salt", F.pmod(F.xxhash64("id", "pos"), F.lit(SALTS)).cast("int")).join(salted, ["k1", "k2", "salt"]).drop("salt")


def line_spread(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", *, min_sites: int = 3, min_words: int = 4, short_sites: int | None = 6, lg_k: int = 12) -> DataFrame:
    """(k1, k2, first): the lines that occur on at least `min_sites` distinct sites, and their first (id, pos).

    Lines of fewer than `min_words` words need `short_sites`; None leaves them out. One
    HyperLogLog sketch of sites per line, merged by aggregation. A line whose estimate
    is within three standard errors (and at least 1) of its threshold is counted
    exactly; the others are decided by the estimate.
    """
    lines = exploded(docs, id_col, text_col, site_col, min_words, short_sites is not None)
    estimate = F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(lg_k)))
    least = F.when(F.col("is_short"), F.lit(short_sites)).otherwise(F.lit(min_sites)) if short_sites is not None else F.lit(min_sites)
    margin = F.greatest(F.lit(1.0), 3 * 1.04 / 2 ** (lg_k / 2) * least)
    seen = lines.groupBy("k1", "k2").agg(estimate.alias("sites"), F.min(F.struct("id", "pos")).alias("first"), F.count(F.lit(1)).alias("n"), F.first("is_short").alias("is_short"))
    seen = durable(seen.where((F.col("sites") >= least - margin) & (F.col("n") >= least)))
    near = seen.where(F.col("sites") <= least + margin)
    exact = meet(lines, near.select("k1", "k2")).groupBy("k1", "k2").agg(F.count_distinct("site").alias("exact"))
    sure = seen.where(F.col("sites") > least + margin)
    return durable(near.join(exact, ["k1", "k2"]).where(F.col("exact") >= least).select("k1", "k2", "first").unionByName(sure.select("k1", "k2", "first")))


def drop_boilerplate_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", *, min_sites: int = 3, min_words: int = 4, short_sites: int | None = 6, lg_k: int = 12) -> DataFrame:
    """`docs` with cross-site lines removed from the text, and a count lines_removed.

    A line (trimmed) that occurs on `min_sites` or more distinct sites, or on `short_sites`
    if it has fewer than `min_words` words, stays at its first place, by id and position, and goes from all
    others; so copies lose their text but one of them keeps it. All rows stay, an
    emptied text is ''. Null sites are one site of their own. Null and empty texts
    and rows with a null id are returned as they are. Repeated rows are edited alike. A column
    lines_removed is replaced, other columns stay. An empty table gives an empty result.
    """
    spread = line_spread(docs, id_col, text_col, site_col, min_sites=min_sites, min_words=min_words, short_sites=short_sites, lg_k=lg_k)
    hits = meet(exploded(docs, id_col, text_col, site_col, min_words, short_sites is not None), spread).where((F.col("id") != F.col("first.id")) | (F.col("pos") != F.col("first.pos")))
    own_id, own_h, gone, line, mark = fresh(docs.columns, "id", "h", "gone", "line", "mark")
    found = hits.groupBy(F.col("id").alias(own_id), F.col("h").alias(own_h)).agg(F.sort_array(F.collect_set("pos")).alias(gone))
    out = docs.join(found, (F.col(id_col) == F.col(own_id)) & (F.xxhash64(text_col) == F.col(own_h)), "left")
    # a string of 0 and 1 by line, so that the work is in proportion to the lines
    marks = F.array_join(F.transform(gone, lambda p, i: F.concat(F.repeat(F.lit("0"), p - F.coalesce(F.get(gone, i - 1), F.lit(-1)) - 1), F.lit("1"))), "")
    out = out.withColumn(line, F.when(F.col(gone).isNotNull(), F.split(F.col(text_col), "\n", -1)))
    out = out.withColumn(mark, F.split(F.rpad(marks, F.size(line), "0"), ""))
    kept = F.filter(F.arrays_zip(line, mark), lambda x: x[line].isNotNull() & (x[mark] != "1"))
    text = F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(F.array_join(F.transform(kept, lambda x: x[line]), "\n"))
    removed = F.coalesce(F.size(gone), F.lit(0)).alias("lines_removed")
    return out.select(*[text.alias(c) if c == text_col else F.col(c) for c in docs.columns if c != "lines_removed"], removed)
