import random
import re

SCHEMA = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"


def words_of(text):
    return re.findall(r"[^ \t\n\x0b\f\r]+", text or "")


def documents(spark, rows):
    """(id, text) rows as a table of documents."""
    return spark.createDataFrame([(i, t, "en", "s", len(t) if t is not None else None) for i, t in rows], SCHEMA)


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(n))


def edited(text, seed, every):
    r = random.Random(seed)
    return " ".join("x" + w if r.random() < 1 / every else w for w in text.split(" "))


ODD = [(None, "a text without an id"), (100, None), (101, ""), (102, " \t\n "), (103, "one"), (104, "%%% ### \x00 é 漢字 🙂"), (105, "same row"), (105, "same row"), (106, "w" * 70_000)]
