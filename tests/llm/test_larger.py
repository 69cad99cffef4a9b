"""The near-duplicate stage in the ways that large tables take."""

import glob
import random
import tempfile
import time

from hydrolake.llm import simhash_dedup


def texts(n, seed=5):
    """Prose with groups of near copies."""
    rnd = random.Random(seed)
    words = ["".join(rnd.choices("abcdefghij", k=5)) for _ in range(800)]
    out = []
    while len(out) < n:
        base = rnd.choices(words, k=120)
        for _ in range(rnd.choice([1, 2, 5])):
            own = list(base)
            own[rnd.randrange(120)] = rnd.choice(words)
            out.append(" ".join(own))
    return [(k, t) for k, t in enumerate(out[:n])]


def shuffle_files():
    return set(glob.glob(f"{tempfile.gettempdir()}/blockmgr-*/*/shuffle_*.data"))


def test_lists_in_several_jobs(spark, monkeypatch):
    """However many jobs the lists take, groups are the same."""
    docs = spark.createDataFrame(texts(120), "doc_id long, text string")
    groups = lambda: sorted(map(tuple, simhash_dedup.like_groups(docs).collect()))
    whole = groups()
    assert 1 < len({c for _, c in whole}) < 110
    monkeypatch.setattr(simhash_dedup, "JOB", 120 * 64)
    assert groups() == whole


def test_shuffle_files_go_with_their_jobs(spark):
    """What the stage shuffled is gone when the stage has ended, without the driver collecting its garbage."""
    before = shuffle_files()
    docs = spark.createDataFrame(texts(200), "doc_id long, text string").repartition(4)
    docs = docs.localCheckpoint()
    assert simhash_dedup.keep_one(docs).count() < 200
    for _ in range(50):
        left = shuffle_files() - before
        if len(left) <= 12:
            break
        time.sleep(0.2)
    assert len(left) <= 12  # those of settled tables, a few edges, wait for the garbage
