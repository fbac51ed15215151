"""Small fixtures with the hard cases: nulls, blanks, ties, repeated rows, long texts, clashing columns."""

import random

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def prose(r, n):
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(1, 6))) for _ in range(n))


def documents(seed=1):
    """(doc_id, text, lang, source) rows: near copies in chains, exact copies, shared passages, short and odd texts."""
    r, rows = random.Random(seed), []
    passage = prose(r, 60)
    for k in range(12):
        base = prose(r, r.randint(30, 160)).split()
        for _ in range(r.randint(1, 5)):
            w = list(base)
            for _ in range(r.randint(0, 4)):
                w[r.randrange(len(w))] = prose(r, 1)
            rows.append(" ".join(w) + ("\n" + passage if r.random() < 0.5 else ""))
            base = w
    rows += [rows[0]] * 3 + [rows[1].upper()] + ["a b c", "A  b\tc", "x", "", " \n\t ", None, passage, "a b c d e a b c d e a b c d e " * 8, "é ü ß É " * 30, "l1 x y\nl1 x y\nl1 x y\n\nend " + prose(r, 60), prose(r, 6000), "###" * 40 + prose(r, 80)]
    return [(i, t, ["en", "de", None][i % 3], ["s1", "s2", "s3", "é", None][i % 5]) for i, t in enumerate(rows)]


def frame(spark, rows=None):
    return spark.createDataFrame([(*x, len(x[1] or "")) for x in (documents() if rows is None else rows)], DOCS)


def empty(spark):
    return frame(spark, [])
