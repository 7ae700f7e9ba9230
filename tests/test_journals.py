"""Journals in levels against plain Python over the same rows, with restarts, replays and lost commits."""

import random
import tempfile
from pathlib import Path

import pytest

from tessella.streaming import journals

TOLD = "node string, parent string, children long"


class Crawl:
    """Files that come in, and the streams of both levels over them."""

    def __init__(self, spark):
        self.spark, self.path, self.fed = spark, tempfile.mkdtemp(prefix="spark-", dir="/tmp"), {"comments": [], "threads": [], "forums": []}
        for name in self.fed:
            self.feed(name, [])

    def feed(self, name, rows):
        self.fed[name] += rows
        schema = journals.DONE if name == "comments" else TOLD
        self.spark.createDataFrame(rows, schema).write.mode("append").parquet(f"{self.path}/{name}")

    def level(self, name):
        read = lambda what, schema: self.spark.readStream.schema(schema).parquet(f"{self.path}/{what}")
        children = read("comments", journals.DONE) if name == "threads" else journals.journal_stream(self.spark, f"{self.path}/threads_done")
        journals.run_level(children, read(name, TOLD), f"{self.path}/{name}_done", f"{self.path}/{name}_checkpoint").awaitTermination()

    def run(self):
        self.level("threads")
        self.level("forums")

    def done(self, name):
        return sorted((r.node, r.parent) for r in journals.journal_table(self.spark, f"{self.path}/{name}_done").collect())

    def lose_last_commit(self, name):
        commits = sorted((p for p in Path(f"{self.path}/{name}_checkpoint/commits").iterdir() if p.name.isdigit()), key=lambda p: int(p.name))
        commits[-1].unlink()
        (commits[-1].parent / f".{commits[-1].name}.crc").unlink(missing_ok=True)


def plain(children, announced):
    """The nodes that are done, with the parents they announced."""
    held = {}
    for parent, node in children:
        if parent is not None and node is not None:
            held.setdefault(parent, set()).add(node)
    told = {}
    for node, parent, number in announced:
        if node is not None:
            told[node] = max(told.get(node, (-1, "")), (number or 0, parent or ""))
    return sorted((n, p or None) for n, (number, p) in told.items() if len(held.get(n, ())) >= number)


def test_restarts_and_replays_give_what_all_rows_say(spark):
    rng, crawl = random.Random(5), Crawl(spark)
    threads = [(f"t{i}", "hot" if i < 20 else f"f{i % 7}", rng.choice([0, 1, 3, 8])) for i in range(60)]
    sizes = {}
    for _, forum, _ in threads:
        sizes[forum] = sizes.get(forum, 0) + 1
    comments = [(t, f"{t}-c{k}") for t, _, n in threads for k in range(n) if rng.random() < 0.97]
    forums = [(f, None, n) for f, n in sizes.items()]
    rng.shuffle(comments)
    crawl.feed("forums", forums[:3])
    for part in range(3):
        crawl.feed("comments", comments[part::3] + comments[:10])  # the first ten are stored again each time
        crawl.feed("threads", threads[part::3])
        if part == 2:
            crawl.feed("forums", forums[3:])
        crawl.run()
        done = crawl.done("threads")
        assert done == plain(crawl.fed["comments"], crawl.fed["threads"])
        assert crawl.done("forums") == plain([(parent, node) for node, parent in done], crawl.fed["forums"])
    assert 0 < len(crawl.done("forums")) < len(forums)


def test_a_batch_that_runs_again_adds_nothing_twice(spark):
    crawl = Crawl(spark)
    crawl.feed("comments", [("a", "1"), ("a", "2"), ("b", "1")])
    crawl.feed("threads", [("a", "f", 2), ("b", "f", 1)])
    crawl.feed("forums", [("f", None, 2)])
    crawl.run()
    for name in ("threads", "forums"):
        crawl.lose_last_commit(name)
    crawl.run()
    assert crawl.done("threads") == [("a", "f"), ("b", "f")] and crawl.done("forums") == [("f", None)]


def test_a_level_alone_resumes(spark):
    crawl = Crawl(spark)
    crawl.feed("comments", [("a", "1")])
    crawl.feed("threads", [("a", "f", 1), ("b", "f", 1)])
    crawl.feed("forums", [("f", None, 2)])
    crawl.run()
    crawl.feed("comments", [("b", "1")])
    crawl.level("threads")
    assert crawl.done("threads") == [("a", "f"), ("b", "f")] and crawl.done("forums") == []
    crawl.level("forums")
    assert crawl.done("forums") == [("f", None)]


def test_nulls_none_announced_and_later_announcements(spark):
    crawl = Crawl(spark)
    crawl.feed("comments", [(None, "1"), ("a", None), ("never", "1")])
    crawl.feed("threads", [("a", "f", 1), ("none", "f", None), ("zero", None, 0), (None, "f", 0)])
    crawl.run()
    assert crawl.done("threads") == [("none", "f"), ("zero", None)]
    crawl.feed("threads", [("zero", "g", 3)])  # done stays done
    crawl.run()
    assert crawl.done("threads") == [("none", "f"), ("zero", None)] and crawl.done("forums") == []


@pytest.mark.parametrize("done, expected", [
    ([], [("forum", "f"), ("forum", "g"), ("product", "p"), ("product", "q"), ("product", "r"), ("thread", "t"), ("thread", "u")]),
    (["g"], [("forum", "f"), ("product", "p"), ("product", "q"), ("thread", "t")]),
    (["f", "g"], []),
])
def test_open_work_of_each_level(spark, done, expected):
    products = spark.createDataFrame([("p", "f"), ("q", "f"), ("q", "f"), ("r", "g"), ("alone", None), (None, "h")], "node string, forum string")
    threads = spark.createDataFrame([("t", "f"), ("t", "f"), ("s", "f"), ("u", "g"), ("other", "h"), (None, "f")], "node string, parent string")
    forums = spark.createDataFrame([(None, f) for f in done], journals.DONE)
    found = journals.still_open(products, threads, forums, spark.createDataFrame([("f", "s")], journals.DONE))
    assert sorted(map(tuple, found.collect())) == expected


def test_nodes_share_calls(spark):
    calls = spark.sparkContext.accumulator(0)
    plain = journals._closed

    def counted(key, parts, state):
        calls.add(1)
        yield from plain(key, parts, state)

    journals._closed = counted
    try:
        crawl = Crawl(spark)
        crawl.feed("comments", [(f"t{k}", f"c{k}") for k in range(3000)])
        crawl.feed("threads", [(f"t{k}", f"f{k % 9}", 1 + k % 2) for k in range(3000)])
        crawl.level("threads")
    finally:
        journals._closed = plain
    assert crawl.done("threads") == plain_done(crawl) and 0 < calls.value <= 2 * journals.GROUPS


def plain_done(crawl):
    return plain(crawl.fed["comments"], crawl.fed["threads"])
