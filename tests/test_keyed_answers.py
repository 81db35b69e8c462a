"""Tables by content key, and the store of answers."""

import hashlib
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.answers import AnswerStore
from tessera.sources.keyed import KeyedTable, bloom, may_hold

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("text", T.StringType())])


def md5(x):
    return hashlib.md5(x.encode()).hexdigest()


def batch(spark, rows):
    return spark.createDataFrame(rows, "id long, text string").withColumn("content_key", F.md5("text"))


def test_bloom():
    keys, others = [md5(str(i)) for i in range(1000)], [md5(f"x{i}") for i in range(5000)]
    f = bloom(keys)
    assert may_hold(f, keys).all() and may_hold(f, others).mean() < 0.02
    assert not may_hold(bloom([]), keys).any() and len(may_hold(f, [])) == 0


def test_append_reads_only_buckets_that_may_hold(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path / "t"), SCHEMA)
    assert t.rows().count() == 0
    a = t.append(batch(spark, [(i, f"a{i}") for i in range(300)] + [(900, "a5"), (-1, "a6")]), order="id")
    assert (a.n_offered, a.n_added, a.buckets_read) == (302, 300, 0)
    b = t.append(batch(spark, [(i, f"b{i}") for i in range(40)] + [(7, "a7")]))
    # One stored row in the batch: its bucket is read, and few others by a filter's error.
    assert b.n_added == 40 and 1 <= b.buckets_read <= 4 < b.buckets_touched
    assert sorted(r.text for r in b.rows.collect()) == sorted(f"b{i}" for i in range(40))
    again = t.append(batch(spark, [(i, f"b{i}") for i in range(40)]))
    assert again.n_added == 0
    rows = {r.text: r.id for r in t.rows().collect()}
    assert len(rows) == 340 and rows["a5"] == 5 and rows["a6"] == -1
    t.compact()
    assert t.rows().count() == 340 and t.append(batch(spark, [(1, "a1"), (2, "new")])).n_added == 1
    assert sorted(KeyedTable(spark, str(tmp_path / "t"), SCHEMA).rows(["00"]).select("content_key").collect()) \
        == sorted(t.rows().where("content_key like '00%'").select("content_key").collect())


def test_a_commit_counts_once_and_a_broken_one_not_at_all(spark, tmp_path, monkeypatch):
    t = KeyedTable(spark, str(tmp_path / "t"), SCHEMA)
    t.append(batch(spark, [(1, "x")]), commit="c1")
    assert t.append(batch(spark, [(1, "x"), (2, "y")]), commit="c1").n_added == 0
    whole = spark.createDataFrame

    def broken(data, schema, *a, **b):
        if "replaces" in str(schema) and data:
            raise RuntimeError("lost before the marker")
        return whole(data, schema, *a, **b)

    monkeypatch.setattr(spark, "createDataFrame", broken)
    with pytest.raises(RuntimeError):
        t.append(whole([(2, "y")], "id long, text string").withColumn("content_key", F.md5("text")), commit="c2")
    monkeypatch.undo()
    assert t.rows().count() == 1
    assert t.append(batch(spark, [(2, "y"), (3, "z")]), commit="c2").n_added == 2
    assert t.rows().count() == 3


def test_a_second_run_makes_no_call(spark, tmp_path):
    log = str(tmp_path / "calls")

    def factory():
        def fn(system, human, temperature):
            fd = os.open(log, os.O_WRONLY | os.O_APPEND | os.O_CREAT)
            os.write(fd, f"{human}\n".encode())
            os.close(fd)
            seen = open(log).read().split("\n").count(human)
            if human == "never" or human == "second" and seen < 2:
                raise ValueError("busy")
            return None if human == "nothing" else f"```sql\n{human}\n```"
        return fn

    store = AnswerStore(spark, str(tmp_path / "answers"), digits=1)
    req = spark.createDataFrame([(i, "s", h, 0.0) for i, h in enumerate(["a", "b", "a", "second", "never", "nothing"])],
                                "id long, system string, human string, temperature double")
    got = {r.id: (r.text, r.error, r.reused) for r in store.ask(req, factory, attempts=2, pause=0.01).collect()}
    assert got == {0: ("a", None, False), 1: ("b", None, False), 2: ("a", None, False), 3: ("second", None, False),
                   4: (None, "ValueError: busy", False), 5: (None, "response had no text", False)}
    calls = open(log).read().split()
    assert sorted(calls) == ["a", "b", "never", "never", "nothing", "second", "second"]
    ok = req.where("id < 4")
    again = store.ask(ok, factory).collect()
    assert {r.id: r.text for r in again} == {0: "a", 1: "b", 2: "a", 3: "second"} and all(r.reused for r in again)
    assert open(log).read().split() == calls
