"""Personal data: fixed patterns, and bootstrapped contextual extraction [native].

Base entities (email, ip, card, phone) are found by regular expressions, with code-point offsets from the
pieces between matches.  They and tokens that look like keys (kind secret: 20 characters or more with letters and digits
mixed) seed a bipartite graph of lexical patterns (the word before, the word after) and identifier-like tokens.  A
pattern's score is the summed score of the instances it takes over *all* its occurrences in the corpus, so an ordinary word
that happens to precede a number scores near 0; an instance's score is 1 - prod(1 - score) over its accepted patterns.
Scores are iterated, and tokens that no base pattern matched but confident patterns surround are added as ``ctx_<kind>``
spans.  A word is a run of letters, digits and underscores, whatever its length and whatever stands between it and the token.

Defined results: null text counts as empty (no spans); rows with equal id and text are judged alike;
overlapping spans of different kinds are all reported; empty table -> empty result.  A found span never
removes a base one.  Patterns are written so that Java's matcher neither recurses nor backtracks over
long runs of digits or letters, and a text with many spans takes little more than its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, let, without

KINDS = ["email", "ip", "card", "phone"]
SPAN = "array<struct<start: bigint, rank: int, end: bigint, kind: string, value: string>>"
PLACED = SPAN.replace("value: string", "value: string, before: string, after: string")
_LOCAL = "A-Za-z0-9._%+-"
EMAIL = rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Separators between two digits are marked first, so that a number is a run of one character class.
MARK, OTHER = "\ue000", "\ue001"
CARD = rf"(?<![0-9{MARK}])[0-9](?:{MARK}?[0-9]){{13,18}}(?![0-9{MARK}])"
#: What separates tokens.
BREAK = r"\x20\x09-\x0D\"'=<>(){}\[\],;"
#: Identifier-like tokens: at least four digits, or an at sign.
TOKEN = rf"(?<![^{BREAK}])(?=[^{BREAK}]{{5}})(?=[^{BREAK}@]*+@[^{BREAK}]|(?:[^{BREAK}0-9]*+[0-9]){{4}})[^{BREAK}]++"
EDGE = r"^[:!?*#%&$.]+|[:!?*#%&$.]+$"
#: Tokens that look like keys.
SECRET = r"^(?=[^0-9]*+[0-9])(?=[^A-Za-z]*+[A-Za-z])(?!.*[0-9a-z]{8}-[0-9a-z]{4}-[0-9a-z]{4}-)[A-Za-z0-9_/+-]{20,}+$"
LAST_WORD = r"(?<![\p{L}\p{N}_])([\p{L}\p{N}_]++)[^\p{L}\p{N}_]*+$"
FIRST_WORD = r"^[^\p{L}\p{N}_]*+([\p{L}\p{N}_]++)"


def _running(values: Column, op, zero: Column) -> Column:
    """Running totals of an array under ``op``, by blocks of about the square root of its size."""

    def of(blocks: Column) -> Column:
        sums = F.transform(blocks, lambda x: F.aggregate(x, zero, op))
        return let(sums, lambda t: F.flatten(F.transform(blocks, lambda x, j: let(F.aggregate(F.slice(t, 1, j), zero, op), lambda base: F.transform(x, lambda _, i: op(base, F.aggregate(F.slice(x, 1, i + 1), zero, op)))))))

    def blocks_of(v: Column) -> Column:
        wide = F.greatest(F.ceil(F.sqrt(F.size(v))), F.lit(1)).cast("int")
        return let(wide, lambda w: let(F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / w).cast("int")), lambda j: F.slice(v, j * w + 1, w)), of))

    return let(values, lambda v: F.when(F.size(v) == 0, v).otherwise(blocks_of(v)))


def _free(tokens: Column, base: Column) -> Column:
    """The tokens that overlap no base span, found by a sweep over both in order."""
    far = F.lit((1 << 62)).cast("long")
    place = lambda x, k: F.struct(x.start.alias("start"), x.end.alias("end"), k.alias("k"))

    def sweep(every: Column) -> Column:
        ends = F.transform(every, lambda x: F.when(x.k < 0, x.end).otherwise(F.lit(0).cast("long")))
        starts = F.transform(F.reverse(every), lambda x: F.when(x.k < 0, x.start).otherwise(far))
        ends, starts = _running(ends, lambda p, q: F.greatest(p, q), F.lit(0).cast("long")), _running(starts, lambda p, q: F.least(p, q), far)
        return let(ends, lambda e: let(F.reverse(starts), lambda s: F.filter(F.transform(every, lambda x, i: F.when((x.k >= 0) & (F.get(e, i) <= x.start) & (F.get(s, i) >= x.end), x.k)), lambda k: k.isNotNull())))

    def of(t: Column, b: Column) -> Column:
        every = F.sort_array(F.concat(F.transform(b, lambda x: place(x, F.lit(-1))), F.transform(t, lambda x, i: place(x, i))))
        return F.transform(let(every, sweep), lambda k: F.get(t, k))

    return let(tokens, lambda t: let(base, lambda b: F.when((F.size(b) == 0) | (F.size(t) == 0), t).otherwise(of(t, b))))


def _spans(text: Column, pattern: str, kind: str, ok) -> Column:
    """Array of spans of the matches that pass ``ok``, in order, each with the words before and after it."""
    rank = KINDS.index(kind) if kind in KINDS else len(KINDS)
    none = F.array().cast(PLACED)

    def build(found: Column, pieces: Column) -> Column:
        size = F.transform(found, lambda x, i: (F.length(F.get(pieces, i)) + F.length(x)).cast("long"))

        def one(x: Column, i: Column, ends: Column) -> Column:
            end = F.get(ends, i)
            before = F.regexp_extract(F.concat(F.coalesce(F.get(found, i - 1), F.lit("")), F.get(pieces, i)), LAST_WORD, 1)
            after = F.regexp_extract(F.concat(F.get(pieces, i + 1), F.coalesce(F.get(found, i + 1), F.lit(""))), FIRST_WORD, 1)
            return F.struct((end - F.length(x)).alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"), x.alias("value"), F.lower(before).alias("before"), F.lower(after).alias("after"))

        return let(_running(size, lambda p, q: p + q, F.lit(0).cast("long")), lambda ends: F.filter(F.transform(found, lambda x, i: one(x, i, ends)), lambda x: ok(x.value)).cast(PLACED))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(F.size(found) == 0, none).otherwise(let(F.split(text, pattern, -1), lambda pieces: build(found, pieces))))


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(x: Column) -> Column:
    def total(d: Column) -> Column:
        each = F.transform(F.sequence(F.lit(1), F.length(d)), lambda i: let(d.substr(i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1), lambda v: F.when(v > 9, v - 9).otherwise(v)))
        return F.aggregate(each, F.lit(0), lambda a, v: a + v)

    return let(F.reverse(_digits(x)), total) % 10 == 0


def base_spans(text: Column) -> Column:
    """Spans of the four base kinds by start, then kind; ``value`` is the matched text."""
    none = F.array().cast(PLACED)
    guard = lambda test, spans: F.when(test, spans).otherwise(none)
    octets = lambda m: F.forall(F.split(m, r"\."), lambda p: F.length(F.regexp_replace(p, "^0+", "")) <= 3) & F.forall(F.split(m, r"\."), lambda p: F.coalesce(F.substring(F.regexp_replace(p, "^0+", ""), 1, 3).try_cast("int"), F.lit(0)) <= 255)
    marked = F.regexp_replace(F.translate(text, MARK, OTHER), r"(?<=[0-9])[\x20-](?=[0-9])", MARK)
    return F.sort_array(F.concat(
        guard(text.contains("@"), _spans(text, EMAIL, "email", lambda m: F.lit(True))),
        guard(text.rlike(r"[0-9]\.[0-9]"), _spans(text, IP, "ip", octets)),
        guard(text.rlike(r"[0-9](?:[\x20-]?[0-9]){13}"), let(marked, lambda t: _spans(t, CARD, "card", _luhn))),
        guard(text.contains("+"), _spans(text, PHONE, "phone", lambda m: F.length(_digits(m)).between(10, 15)))))


def token_spans(text: Column) -> Column:
    """Spans of identifier-like tokens, without the punctuation around them."""
    raw = F.when(text.rlike(r"[0-9@]"), _spans(text, TOKEN, "token", lambda m: F.lit(True))).otherwise(F.array().cast(PLACED))

    def trim(s: Column) -> Column:
        left = F.length(s.value) - F.length(F.regexp_replace(s.value, r"^[:!?*#%&$.]+", ""))
        core = F.regexp_replace(s.value, EDGE, "")
        return F.struct((s.start + left).alias("start"), s["rank"].alias("rank"), (s.start + left + F.length(core)).alias("end"), s.kind.alias("kind"), core.alias("value"), s.before.alias("before"), s.after.alias("after"))

    return F.filter(F.transform(raw, trim), lambda s: F.length(s.value) >= 4)


def mentions(docs: DataFrame) -> DataFrame:
    """(doc_id, row, base, tokens): spans of each text; ``tokens`` are those that overlap no base span, and both come with
    the words before and after.  ``row`` is a hash of the text and names it together with the id."""
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    d = d.withColumn("base", base_spans(F.col("text"))).withColumn("tokens", token_spans(F.col("text")))
    return d.select("doc_id", F.xxhash64("text").alias("row"), "base", _free(F.col("tokens"), F.col("base")).alias("tokens"))


def discover(docs: DataFrame, found: DataFrame, rounds: int = 3, support: int = 5, confident: float = 0.5, accept: float = 0.6) -> DataFrame:
    """(doc_id, row, start, end, kind): tokens that confident patterns surround.  ``found`` is what mentions() gave."""
    sides = F.filter(F.array(F.struct(F.lit("L").alias("side"), F.col("s.before").alias("word")), F.struct(F.lit("R").alias("side"), F.col("s.after").alias("word"))), lambda p: p.word != "")
    flat = lambda name: found.select("doc_id", "row", F.explode(name).alias("s")).select("doc_id", "row", "s.kind", "s.start", "s.end", "s.value", F.explode(sides).alias("p"))
    tokens = cut(flat("tokens").select("doc_id", "row", "start", "end", "value", "p.side", "p.word"), "tokens")
    keys = tokens.filter(F.col("value").rlike(SECRET)).select(F.lit("secret").alias("kind"), "value", "side", "word")
    seeds = flat("base").select("kind", "value", "p.side", "p.word").union(keys).withColumn("value", F.lower("value"))
    tokens = tokens.withColumn("value", F.lower("value"))
    edges = seeds.groupBy("kind", "value", "side", "word").agg(F.count("*").alias("n"))
    #: words that fewer values than ``support`` have beside them are never accepted
    both = seeds.select("side", "word", "value").union(tokens.select("side", "word", "value"))
    known = cut(both.groupBy("side", "word").agg(F.countDistinct("value").alias("n")).filter(F.col("n") >= support).select("word").distinct(), "pattern-words")
    words = F.explode(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}\p{N}_]+"))
    occurs = cut(docs.select(words.alias("word")).groupBy("word").agg(F.count("*").alias("total")).join(known, "word", "left_semi"), "occurrences")
    token_edges = cut(tokens.groupBy("value", "side", "word").agg(F.count("*").alias("n")), "token-edges")
    edges = cut(edges, "seed-edges")
    instances = None
    for _ in range(rounds):
        held = edges.withColumn("score", F.lit(1.0))
        if instances is not None:
            held = held.select("kind", "value", "side", "word", "n", "score").union(
                token_edges.join(instances, "value").select("kind", "value", "side", "word", "n", "score"))
        patterns = held.groupBy("kind", "side", "word").agg(F.sum(F.col("n") * F.col("score")).alias("mass"), F.countDistinct("value").alias("values"))
        patterns = patterns.filter(F.col("values") >= support).join(occurs, "word").withColumn("score", F.least(F.col("mass") / F.col("total"), F.lit(1.0)))
        patterns = cut(patterns.filter(F.col("score") >= confident).select("kind", "side", "word", "score"), "patterns")
        if patterns.isEmpty():
            return docs.sparkSession.createDataFrame([], "doc_id bigint, row bigint, start bigint, end bigint, kind string")
        hit = token_edges.join(patterns, ["side", "word"]).select("value", "kind", "side", "word", "score").distinct()
        instances = cut(hit.groupBy("kind", "value").agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("score"), F.lit(1e-9)))))).alias("score")), "instances")
    chosen = instances.filter(F.col("score") >= accept)
    spans = tokens.join(patterns.drop("score"), ["side", "word"]).join(chosen.drop("score"), ["kind", "value"])
    return spans.select("doc_id", "row", "start", "end", F.concat(F.lit("ctx_"), "kind").alias("kind")).distinct()


def _bare(spans) -> Column:
    return F.transform(spans, lambda s: s.dropFields("before", "after")).cast(SPAN)


def _said(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")


def _joined(found: DataFrame, extra: DataFrame) -> DataFrame:
    """``found`` with more: array of discovered spans (rank after the base kinds)."""
    one = F.struct("start", F.lit(len(KINDS)).alias("rank"), "end", "kind", F.lit("").alias("value"))
    e = extra.groupBy("doc_id", "row").agg(F.sort_array(F.collect_list(one)).cast(SPAN).alias("more"))  # as many as one text has
    e = e.withColumnsRenamed({"doc_id": "_d", "row": "_r"})
    j = found.join(e, found.doc_id.eqNullSafe(e._d) & (found.row == e._r), "left").drop("_d", "_r")
    return j.withColumn("more", F.coalesce("more", F.array().cast(SPAN)))


def scan(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, row, base, more): base and discovered spans per row of ``docs`` (doc_id, text)."""
    found = cut(mentions(docs), "mentions")
    extra = cut(discover(docs, found, **options), "discovered")
    found = found.withColumn("base", _bare("base"))
    return _joined(found.select("doc_id", "row", "base"), extra)


def digest(spans: DataFrame) -> DataFrame:
    count = lambda k: F.size(F.filter("base", lambda s: s.kind == k)).cast("long").alias(f"n_{k}")
    every = F.sort_array(F.concat(F.col("base").cast(SPAN), "more"))
    return spans.select("doc_id", *[count(k) for k in KINDS], F.sha2(_said(F.col("base")).cast("binary"), 256).alias("base_sha256"), _said(every).alias("spans"), (F.size("base") + F.size("more")).cast("long").alias("n_spans"))


def redact(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets (merged where spans overlap); n_chars, where there is
    one, follows the text.  Texts without a span, null ones too, stay as they are."""
    found = cut(mentions(docs), "mentions")
    extra = cut(discover(docs, found, **options), "discovered")
    d = without(docs, ["_spans"]).withColumn("_spans", _bare(base_spans(F.coalesce("text", F.lit("")))))
    if not extra.isEmpty():
        d = _joined(d.withColumn("row", F.xxhash64(F.coalesce("text", F.lit("")))), extra).withColumn("_spans", F.sort_array(F.concat("_spans", "more")))

    def rebuilt(spans: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

        def step(s: Column, x: Column) -> Column:
            gap = F.col("text").substr((s.at + 1).cast("int"), F.greatest(x.start - s.at, F.lit(0)).cast("int"))
            fresh = F.concat(s.out, gap, F.lit("["), F.upper(x.kind), F.lit("]"))
            return F.struct(F.greatest(s.at, x.end).alias("at"), F.when(x.start < s.at, s.out).otherwise(fresh).alias("out"))

        return F.aggregate(spans, start, step, lambda s: F.concat(s.out, F.col("text").substr((s.at + 1).cast("int"), F.length("text"))))

    text = F.when(F.size("_spans") > 0, rebuilt(F.col("_spans"))).otherwise(F.col("text"))
    out = d.withColumn("_text", text)
    own = {"text": F.col("_text"), "n_chars": F.when(F.size("_spans") > 0, F.length("_text").cast("long")).otherwise(F.col("n_chars")) if "n_chars" in docs.columns else None}
    return out.select(*[own[c].alias(c) if c in own else F.col(f"`{c}`") for c in docs.columns])
