"""Language identification by compression.

Training takes, for every language that labels a row, a bounded number of characters of labelled texts
(``budget``, a documented parameter, less for each where there are more than ``TOTAL / budget`` languages)
chosen by a hash of the document id, and joins them into a zstandard raw-content
dictionary.  A text is compressed in blocks with every dictionary, ``GROUP`` dictionaries at a time, and gets the language whose total is
smallest; texts and dictionaries are reduced to lower-case letters first.  The score is the margin between the best and the second best total, relative to the second,
scaled so that ``narrow`` maps to 0.5 and clipped to [0, 1]; predictions with a margin below ``narrow``
are marked rejected.

Whole texts are compressed, in blocks of ``BLOCK`` bytes so that the dictionary stays in reach.
Defined results: null texts and texts without a letter -> `und`, score 0, rejected; with no labelled
rows, as in an empty table, every text is `und`; a letter is a character of Unicode category L; input columns of the output's names are replaced; ties go to the language with more labelled rows, then to the one that sorts first; repeated rows are alike.
"""

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, without

UNKNOWN = "und"
BLOCK = 65_536
LEVEL = 9
NARROW = 0.01
#: Characters of training text per language, at most.
BUDGET = 131_072
#: Characters of one document that training may use, at most.
PER_TEXT = 512
#: Characters of training text of all languages together; more than TOTAL / BUDGET languages share it evenly.
TOTAL = 1 << 25
#: Characters per language that sharing never goes below.
SHARE = 4_096
#: Languages whose compressors a task holds at once.
GROUP = 64


def train(labelled: DataFrame, budget: int = BUDGET) -> dict[str, bytes]:
    """Language -> dictionary content, the language with most rows first.  ``labelled`` has doc_id, text and lang; null or empty ones are skipped.

    A first pass counts rows per language over all data; the second keeps rows whose id hash is below a
    rate that gives about twice the budget, so what reaches the driver is bounded by the number of languages.
    """
    order = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.substring("text", 1, 64))
    rows = labelled.filter(F.col("lang").isNotNull() & (F.length("text") > 0)).select("lang", F.substring("text", 1, PER_TEXT).alias("text"), order.alias("h"))
    rows = rows.withColumn("at", F.pmod("h", F.lit(1_000_003)))
    each = rows.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("c"), F.min("at").alias("first"))
    each = cut(each, "languages")  # of known size, so that the join need not move the texts
    known = each.select("lang", "n").orderBy(F.col("n").desc(), "lang").collect()
    if not known:
        return {}
    budget = min(budget, max(TOTAL // len(known), SHARE))
    #: the row that comes first is taken at any rate, so that no language goes without
    limits = each.select(F.col("lang").alias("_lang"), F.greatest("first", (2.0 * budget + 8 * PER_TEXT) / F.col("c") * 1_000_003).alias("_to"))
    some = rows.join(limits, F.col("lang") == F.col("_lang")).filter(F.col("at") <= F.col("_to")).select("lang", "text", "h").distinct()  # equal rows count once
    got: dict[str, str] = {}
    for lang, text, _ in sorted(some.collect(), key=lambda r: (r[0], r[2], r[1])):
        if len(got.get(lang, "")) < budget:
            got[lang] = got.get(lang, "") + text + "\n"
    return {r.lang: b for r in known if (b := _letters(got.get(r.lang, ""))[:budget].encode("utf-8", "surrogatepass"))}


_REST = re.compile(r"[\W\d_]+")


def _letters(text: str) -> str:
    """Lower-cased letters with single spaces between words: case and symbols say nothing about the language."""
    return _REST.sub(" ", text.lower())


def plain(text: str) -> bytes:
    return _letters(text).encode("utf-8", "surrogatepass")


def predict(docs: DataFrame, dictionaries: dict[str, bytes], narrow: float = NARROW) -> DataFrame:
    """``docs`` with lang_pred, score and rejected; only the text decides."""
    added = ["lang_pred", "score", "rejected"]
    docs = without(docs, added)
    langs = list(dictionaries)  # the most frequent first: it wins ties
    content = [dictionaries[x] for x in langs]

    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import zstandard as z

        def tools(group: list[bytes]) -> list:
            out = []
            for c in group:
                d = z.ZstdCompressionDict(c, dict_type=z.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(level=LEVEL)
                out.append(z.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_dict_id=False, write_checksum=False))
            return out

        starts = range(0, len(content), GROUP)
        only = tools(content) if len(starts) == 1 else None
        for batch in batches:
            texts = [t if t and any(map(str.isalpha, t)) else None for t in batch]
            best: list = [None] * len(texts)  # smallest total, its language, the second smallest
            for at in starts:
                group = only or tools(content[at:at + GROUP])
                for k, t in enumerate(texts):
                    if t is None:
                        continue
                    data = plain(t)
                    parts = [data[i:i + BLOCK] for i in range(0, len(data), BLOCK)]
                    found = best[k]
                    for i, c in enumerate(group, at):
                        size = sum(len(c.compress(p)) for p in parts)
                        if found is None:
                            found = (size, i, None)
                        elif size < found[0]:
                            found = (size, i, found[0])
                        elif found[2] is None or size < found[2]:
                            found = (*found[:2], size)
                    best[k] = found
            out = []
            for found in best:
                if found is None:
                    out.append((UNKNOWN, 0.0, True))
                    continue
                least, i, second = found
                margin = (second - least) / second if second else 0.0
                out.append((langs[i], min(1.0, margin / (2 * narrow)), margin < narrow))
            yield pd.DataFrame(out, columns=added)

    kind = F.pandas_udf(scores, "lang_pred string, score double, rejected boolean")
    return docs.withColumn("_p", kind(F.col("text"))).select(*[F.col(f"`{c}`") for c in docs.columns], *[F.col(f"_p.{c}").alias(c) for c in added])
