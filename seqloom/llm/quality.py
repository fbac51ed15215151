"""Quality rules with adaptive thresholds [native].

Each text gets exact base counts.  Four ratios of them are summarised per (lang, source) in a
mergeable quantile sketch: a histogram over log-linear integer bins with a relative error of at most
1/128.  Sketches merge by adding counts, so the per-language and global sketches are sums of the
(lang, source) ones and the result doesn't depend on row order.  A group's threshold for a ratio is an
outlier fence over its own quartiles, upper = q75 + spread * max(q75 - q25, least); thresholds are
joined back and rows beyond a fence are rejected.  ``least`` is the smallest spread that counts; it decides only where
three quarters of a group's texts agree to that much, as they do in a ratio that is 0 for most texts.

Defined results: null or blank text -> all counts 0 and base_failed; null lang or source form their
own groups; groups with fewer than ``min_group`` rows use their language's sketch, and languages with
fewer use the global one; repeated rows are judged alike; an empty table gives an empty result; texts of any length
are counted whole; input columns named as an output column are replaced, but keep_good() gives all columns back as they were.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, cut, let, without, words_of

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]
#: Ratio -> (numerator, denominator, scale, least inter-quartile range, sides fenced).
RATIOS = {
    "word_length": ("word_chars", "n_words", 100, 10, ("low", "high")),
    "symbols": ("n_symbols", "n_words", 1000, 30, ("high",)),
    "dup_lines": ("n_dup_lines", "n_lines", 1000, 100, ("high",)),
    "repeats": ("n_repeat_words", "n_words", 1000, 50, ("high",)),
}
POS_BITS = 24


def _repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that occur at least twice, the first occurrence included.

    Windows are hashed to 64 bits.  A primitive sort of (40 hash bits, position) finds candidate
    positions; only those are sorted again by the full hash.  The covered words follow from the gaps
    between the flagged positions.
    """
    low = F.lit((1 << POS_BITS) - 1).cast("long")
    first = F.array().cast("array<int>")

    def flagged(h: Column) -> Column:
        packed = F.sort_array(F.transform(h, lambda x, i: x.bitwiseAND(F.bitwise_not(low)).bitwiseOR(i.cast("long"))))
        key = lambda x: F.shiftright(x, POS_BITS)
        near = lambda s: F.filter(s, lambda x, k: F.coalesce(key(x) == key(F.get(s, k - 1)), F.lit(False))
                                  | F.coalesce(key(x) == key(F.get(s, k + 1)), F.lit(False)))
        some = F.transform(let(packed, near), lambda x: x.bitwiseAND(low).cast("int"))
        every = F.sequence(F.lit(0), F.size(h) - 1)
        candidates = F.when(F.size(h) < (1 << POS_BITS), some).otherwise(every)
        exact = F.sort_array(F.transform(candidates, lambda p: F.struct(F.get(h, p).alias("h"), p.alias("p"))))
        same = lambda e: F.filter(e, lambda x, k: F.coalesce(x.h == F.get(e, k - 1).h, F.lit(False))
                                  | F.coalesce(x.h == F.get(e, k + 1).h, F.lit(False)))
        return F.sort_array(F.transform(let(exact, same), lambda x: x.p))

    def covered(p: Column) -> Column:
        steps = F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    def of(w: Column) -> Column:
        at = F.when(F.size(w) >= 4, F.sequence(F.lit(0), F.size(w) - 3)).otherwise(first)
        h = F.transform(at, lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        return let(let(h, lambda x: F.when(F.size(x) > 1, flagged(x)).otherwise(first)), covered)

    return of(words)


def counts(text: Column) -> Column:
    """Struct of the base counts (all long) of one text."""
    plain = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(plain, "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    line_counts = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup")))
    word_counts = let(words_of(text), lambda w: F.struct(F.size(w).cast("long").alias("n"), F.length(F.array_join(w, "")).cast("long").alias("chars"), _repeat_words(w).alias("rep")))
    both = let(F.struct(word_counts.alias("w"), line_counts.alias("l"), F.length(F.regexp_replace(plain, r"[^#*$%&|<>]+", "")).cast("long").alias("s")), lambda x: F.struct(
        x.w.n.alias("n_words"), x.w.chars.alias("word_chars"), x.s.alias("n_symbols"), x.l.dup.alias("n_dup_lines"), x.w.rep.alias("n_repeat_words"), x.l.n.alias("n_lines")))
    return both


def ratio(name: str) -> Column:
    """Integer ratio in 1/scale units; 0 where the denominator is 0."""
    num, den, scale, *_ = RATIOS[name]
    return F.when(F.col(den) > 0, F.expr(f"({scale} * {num}) div {den}")).otherwise(F.lit(0).cast("long"))


def bin_of(value: Column) -> Column:
    """Lower bound of the log-linear bin: exact below 256, then 128 bins per power of two."""
    drop = F.greatest(F.length(F.bin(value)) - 8, F.lit(0))
    return F.when(value < 256, value).otherwise(F.call_function("shiftleft", F.call_function("shiftright", value, drop), drop))


def sketches(measured: DataFrame) -> DataFrame:
    """(lang, source, ratio, bin, n): the mergeable histograms of the rows that pass the base rules."""
    bins = F.explode(F.array(*[F.struct(F.lit(r).alias("ratio"), bin_of(ratio(r)).alias("bin")) for r in RATIOS]))
    return (measured.filter(~F.col("base_failed")).select("lang", "source", bins.alias("b"))
            .groupBy("lang", "source", F.col("b.ratio").alias("ratio"), F.col("b.bin").alias("bin")).agg(F.count("*").alias("n")))


def _quartiles(hist: DataFrame, keys: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys, "ratio")
    run = hist.withColumn("total", F.sum("n").over(w)).withColumn("cum", F.sum("n").over(w.orderBy("bin")))
    return run.groupBy(*keys, "ratio").agg(
        F.max("total").alias("total"),
        F.min(F.when(4 * F.col("cum") >= F.col("total"), F.col("bin"))).alias("q25"),
        F.min(F.when(4 * F.col("cum") >= 3 * F.col("total"), F.col("bin"))).alias("q75"))


def thresholds(hist: DataFrame, spread: int = 6, min_group: int = 30) -> DataFrame:
    """(lang, source, t: map ratio -> struct(low, high)); a row per (lang, source) that the sketches hold."""
    by_lang = hist.groupBy("lang", "ratio", "bin").agg(F.sum("n").alias("n"))
    overall = by_lang.groupBy("ratio", "bin").agg(F.sum("n").alias("n"))
    q = lambda p: F.struct("total", "q25", "q75").alias(p)
    a = _quartiles(hist, ["lang", "source"]).select("lang", "source", "ratio", q("a"))
    b = _quartiles(by_lang, ["lang"]).select(F.col("lang").alias("lang_b"), F.col("ratio").alias("ratio_b"), q("b"))
    c = _quartiles(overall, []).select(F.col("ratio").alias("ratio_c"), q("c"))
    used = (a.join(b, F.col("lang").eqNullSafe(F.col("lang_b")) & (F.col("ratio") == F.col("ratio_b")))
            .join(c, F.col("ratio") == F.col("ratio_c"))
            .withColumn("u", F.when(F.col("a.total") >= min_group, F.col("a")).when(F.col("b.total") >= min_group, F.col("b")).otherwise(F.col("c"))))
    least = F.element_at(F.create_map(*[F.lit(x) for r, v in RATIOS.items() for x in (r, v[3])]), F.col("ratio"))
    width = spread * F.greatest(F.col("u.q75") - F.col("u.q25"), least)
    return used.groupBy("lang", "source").agg(*[
        F.max(F.when(F.col("ratio") == r, F.col("u.q25") - width if side == "low" else F.col("u.q75") + width)).alias(f"{r}_{side}")
        for r, v in RATIOS.items() for side in v[4]])


def apply_rules(docs: DataFrame, carry: list[str] | None = None, spread: int = 6, min_group: int = 30) -> DataFrame:
    """``carry`` columns (default: all of ``docs``) with the base counts, base_failed and kept."""
    added = [*COUNTS, "base_failed", "kept"]
    carry = docs.columns if carry is None else carry
    keep = [c for c in carry if c.lower() not in added]
    extra = [c for c in ("lang", "source") if c not in keep]
    m = without(docs, added).withColumn("_base_counts", counts(F.col("text")))
    m = m.select(*[F.col(f"`{c}`") for c in keep + extra], *[F.col(f"_base_counts.{c}").alias(c) for c in COUNTS])
    m = m.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    m = cut(m, "quality")
    t = cut(thresholds(sketches(m), spread, min_group), "thresholds")  # of known size, so that the join need not move the texts
    t = t.withColumnsRenamed({"lang": "lang_t", "source": "source_t"})
    j = m.join(t, m.lang.eqNullSafe(t.lang_t) & m.source.eqNullSafe(t.source_t), "left")
    inside = [ratio(r) >= F.col(f"{r}_low") if side == "low" else ratio(r) <= F.col(f"{r}_high") for r, v in RATIOS.items() for side in v[4]]
    ok = F.lit(True)
    for x in inside:
        ok = ok & F.coalesce(x, F.lit(True))
    return j.select(*[F.col(f"`{c}`") for c in keep], *COUNTS, "base_failed", (~F.col("base_failed") & ok).alias("kept"))


def keep_good(docs: DataFrame, **options) -> DataFrame:
    """Only the rows that are kept, with the columns of ``docs``."""
    aside = {c: f"_own_{c}" for c in docs.columns if c.lower() in {*COUNTS, "base_failed", "kept"}}
    judged = apply_rules(docs.withColumnsRenamed(aside), **options)
    return judged.filter("kept").select(*[F.col(f"`{aside.get(c, c)}`").alias(c) for c in docs.columns])
