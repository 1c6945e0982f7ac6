"""Small tables with the awkward cases every operator has a defined result for."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, spans string, block int, doc long, hash long, entity string"


def prose(seed, n, letters="abcdefghij"):
    r = random.Random(seed)
    return " ".join("".join(r.choice(letters) for _ in range(r.randint(2, 7))) for _ in range(n))


def documents(spark, texts, ids=None, langs=None):
    """Documents with extra columns whose names operators use inside."""
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, langs[k] if langs else None, None, None, "x", k, 7, None, "y") for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
    return spark.createDataFrame(rows, DOCS)


def awkward():
    long = prose(1, 4000)
    return [None, "", " \n\t ", "a", prose(2, 60), prose(2, 60), long, long + " tail", "ÀÉ ñ 漢字 👍 ﷐x﷑", "'ll 've  two  blanks\n\n\nthree", "idiot", None]
