"""The store as a data source: formulas, pushed selections, batches that fail, are unclear or run twice."""

import json
import os

import pytest
from pyspark.sql import functions as F

from acreline.queries.tables import new_folder
from acreline.sources import datasource, stores
from acreline.sources.datasource import FolderClient, Transient, Unclear, formula, quoted

KINDS = "url string, stage string, price double"


class Faulty(FolderClient):
    """A store that fails by what a batch holds; marks in its folder tell what it has done before."""

    def once(self, name):
        os.makedirs(f"{self.path}/_marks", exist_ok=True)
        try:
            open(f"{self.path}/_marks/{name}", "x").close()
        except FileExistsError:
            return False
        return True

    def create(self, rows):
        urls = [r["url"] for r in rows]
        assert len(rows) <= 10
        if any(u.startswith("never") for u in urls):
            raise Transient
        if "later" in urls and self.once("later"):
            raise Transient
        if "unclear" in urls and self.once("unclear"):
            super().create(rows[: len(rows) // 2])
            raise Unclear
        super().create(rows)


def read(spark, path):
    return datasource.load(spark, path, KINDS)


def test_formulas_are_escaped():
    assert formula([]) == "" and formula([("stage", "=", "New Lead")]) == "{stage} = 'New Lead'"
    assert formula([("a", "<>", "o'Neil \\ \n"), ("b", ">=", 2.5), ("c", "in", ("x", "y"))]) == "AND({a} != 'o\\'Neil \\\\ \\n', {b} >= 2.5, OR({c} = 'x', {c} = 'y'))"
    assert formula([("r", "starts", "HTTP "), ("s", "unset", None), ("t", "set", None)]) == "AND(LEFT({r}, 5) = 'HTTP ', {s} = BLANK(), NOT({t} = BLANK()))"
    assert quoted(True) == "TRUE()" and quoted(3) == "3"


def test_selections_are_pushed(spark):
    path = new_folder(spark, "store")
    rows = [("a", "New", 1.0), ("b", None, 2.0), ("c", "Not Interested", 3.0), ("d", "o'Neil", None)]
    spark.createDataFrame(rows, KINDS).repartition(2).write.parquet(path)
    plan = lambda x: x._jdf.queryExecution().executedPlan().toString()
    one = stores.of_stage(read(spark, path), "o'Neil")
    assert [r.url for r in one.collect()] == ["d"] and "Filter" not in plan(one).split("BatchScan")[0]
    assert "stage" in plan(one).split("BatchScan")[1]
    keep = stores.active(read(spark, path))
    assert sorted(r.url for r in keep.collect()) == ["a", "b", "d"] and "Filter" not in plan(keep).split("BatchScan")[0]
    # what the store can't answer alone stays with Spark
    part = read(spark, path).where((F.length("stage") > 3) & (F.col("price") > 1))
    assert [r.url for r in part.collect()] == ["c"] and "length" in plan(part).split("BatchScan")[0]
    assert {r.url for r in read(spark, path).where("stage IS NULL OR price IS NULL").collect()} == {"b", "d"}
    assert read(spark, new_folder(spark, "none")).count() == 0


def write(spark, rows, path, parts=1):
    d = spark.createDataFrame(rows, KINDS).coalesce(parts)
    d.write.format("listing_store").mode("append").option("client", "tests.test_datasource:Faulty").option("waits", "0,0").option("failed", f"{path}-failed").save(path)


def failed(path):
    out = []
    for name in sorted(os.listdir(f"{path}-failed")) if os.path.isdir(f"{path}-failed") else []:
        assert not name.startswith("_")
        out += [json.loads(x)["url"] for x in open(f"{path}-failed/{name}")]
    return sorted(out)


def test_failing_and_unclear_batches(spark, tmp_path):
    """A transient failure is tried again, an unclear one looked up first, a batch that never goes is set aside; no url twice."""
    datasource.register(spark)
    path = str(tmp_path / "store")
    rows = [(f"u{i}", "New", float(i)) for i in range(25)]
    rows = rows[:3] + [("later", None, 1.0)] + rows[3:12] + [("unclear", None, 1.0)] + rows[12:] + [(f"never{i}", None, 0.0) for i in range(7)] + [("u0", "again", 9.0)]
    write(spark, rows, path)
    got = [r.url for r in read(spark, path).collect()]
    aside = failed(path)
    assert len(got) == len(set(got)) and set(got) | set(aside) == {r[0] for r in rows} and not set(got) & set(aside)
    assert {"later", "unclear"} <= set(got) and {f"never{i}" for i in range(7)} <= set(aside)
    write(spark, [r for r in rows if not r[0].startswith("never")], path, 3)
    again = [r.url for r in read(spark, path).collect()]
    assert len(again) == len(set(again)) and set(again) == {r[0] for r in rows if not r[0].startswith("never")}


def test_failed_task_runs_again(spark, tmp_path):
    """A job that fails after it has written part of its rows leaves nothing set aside, and its rerun creates no row twice."""
    datasource.register(spark)
    path = str(tmp_path / "store")
    boom = F.udf(lambda u: 1 / 0 if u == "u33" else 1.0, "double")
    d = spark.createDataFrame([(f"u{i}", "s", 1.0) for i in range(40)], KINDS).coalesce(1)
    with pytest.raises(Exception):
        d.withColumn("price", boom("url")).write.format("listing_store").mode("append").option("failed", f"{path}-failed").option("batch", 2).save(path)
    for _ in range(2):
        d.write.format("listing_store").mode("append").option("failed", f"{path}-failed").save(path)
    got = [r.url for r in read(spark, path).collect()]
    assert sorted(got) == sorted(f"u{i}" for i in range(40)) and failed(path) == []


class Counted(FolderClient):
    """A store that tells of its lookups, and fails once in the middle where it is told to."""

    def note(self, name):
        os.makedirs(f"{self.path}-notes", exist_ok=True)
        open(f"{self.path}-notes/{name}-{len(os.listdir(f'{self.path}-notes'))}", "x").close()

    def find(self, urls):
        self.note("find")
        return super().find(urls)


def notes(path):
    return os.listdir(f"{path}-notes") if os.path.isdir(f"{path}-notes") else []


def test_append_reads_what_is_stored_once(spark, tmp_path):
    """New rows are told by one join, not by a pass over the store for every batch; rows that come again are created once."""
    path = str(tmp_path / "store")
    spark.createDataFrame([(f"u{i}", "old", 1.0) for i in range(50)] + [(None, "old", 1.0)], KINDS).write.parquet(path)
    rows = spark.createDataFrame([(f"u{i % 150}", "new", 2.0) for i in range(300)] + [(None, "new", 2.0)], KINDS)
    for _ in range(2):
        datasource.append(rows, path, 2, client="tests.test_datasource:Counted", failed=f"{path}-failed", batch=5)
    got = read(spark, path).collect()
    assert len(got) == 151 and {r.url for r in got if r.stage == "old"} == {f"u{i}" for i in range(50)} | {None}
    assert notes(path) == [] and failed(path) == []
    # 20 small files and the first are no task each
    assert read(spark, path).rdd.getNumPartitions() == 1
    assert read(spark, path).where("price > 1 AND url = 'u60'").count() == 1


def test_a_later_attempt_looks_up(tmp_path):
    """A mark below the folder of failed batches tells an attempt that another has begun, whatever its number."""
    w = datasource.StoreWriter(None, {"new": "true", "failed": str(tmp_path)})
    assert [w.begun(3), w.begun(4), w.begun(3)] == [False, False, True]
    w.clear()
    assert os.listdir(tmp_path) == []


def test_replayed_files_are_archived(spark, tmp_path):
    """A file is replayed once over several runs and moves to the archive; equal names of different days do not clash."""
    from acreline.sources import sinks

    at, got = tmp_path / "failed", []

    def run():
        sinks.replay_failed(spark, str(at), str(tmp_path / "done"), "url string", lambda rows, batch: got.extend(r.url for r in rows.collect()), str(tmp_path / "state"))

    for day, urls in (("d1", ["a", "b"]), ("d2", ["c"])):
        os.makedirs(at / day, exist_ok=True)
        (at / day / "rows.json").write_text("".join(json.dumps({"url": u}) + "\n" for u in urls))
        run()
    (at / "d3.json").write_text("")
    (at / "d4.json").write_text('{"url": "d"}\n')
    run()
    run()
    assert sorted(got) == ["a", "b", "c", "d"]
    left = {str(p.relative_to(at)) for p in at.rglob("*.json")}
    done = sorted(p.name for p in (tmp_path / "done").rglob("*.json"))
    assert "d1/rows.json" not in left and "d2/rows.json" not in left and done.count("rows.json") == 2
