import uuid

import pytest
from pyspark.sql import functions as F

from lodestone.operators import postings, search, writes
from lodestone.session import shared_folder

ROWS = "document_id long, part long, vector array<double>"


@pytest.fixture
def place(spark):
    return f"{shared_folder(spark)}/tests/{uuid.uuid4().hex}"


def stored(spark, path, buckets=4):
    table = writes.Table(spark, path, "document_id", buckets)
    table.create(spark.createDataFrame([(d, p, [1.0, float(d)]) for d in range(6) for p in range(2)] + [(None, 7, None)], ROWS))
    return table


def held(table):
    return sorted((r.document_id if r.document_id is not None else -1, r.part) for r in table.rows().collect())


OLD = sorted([(d, p) for d in range(6) for p in range(2)] + [(-1, 7)])
NEW = sorted([(d, p) for d in (0, 2, 4, 5) for p in range(2)] + [(1, 9), (3, 8), (3, 9), (-1, 7)])


class Stopped(Exception):
    pass


def stop_at(step):
    def hook(name):
        if name.startswith(step):
            raise Stopped(name)

    return hook


@pytest.mark.parametrize(("step", "after"), [("aside", OLD), ("journal", NEW), ("out", NEW), ("in", NEW)])
def test_a_stopped_replacement_is_whole_or_not_at_all(spark, place, step, after):
    table = stored(spark, place)
    rows = spark.createDataFrame([(1, 9, [0.0, 1.0]), (3, 8, [0.0, 1.0]), (3, 9, [0.0, 1.0])], ROWS)
    with pytest.raises(Stopped):
        table.replace(rows, size=2, after=stop_at(step))
    again = writes.Table(spark, place, "document_id", 4)
    assert held(again) == after == held(again)
    again.replace(rows, size=2)
    assert held(again) == NEW
    assert not again.files.names("_journal") and not again.files.names("_aside") and not again.files.names("_old")


@pytest.mark.parametrize("row", [(1, 9, [1.0]), (1, 9, None), (1, 9, [1.0, None]), (None, 9, [1.0, 2.0])])
def test_rows_with_a_fault_leave_the_old_ones(spark, place, row):
    table = stored(spark, place)
    with pytest.raises(ValueError, match="nothing was written"):
        table.replace(spark.createDataFrame([(3, 8, [1.0, 2.0]), row], ROWS), size=2)
    assert held(table) == OLD


def test_no_rows_delete_and_other_documents_are_refused(spark, place):
    table = stored(spark, place)
    none = spark.createDataFrame([], ROWS)
    named = spark.createDataFrame([(1,), (5,), (77,), (None,)], "document_id long")
    with pytest.raises(ValueError, match="other documents"):
        table.replace(spark.createDataFrame([(2, 2, None)], ROWS), named)
    table.replace(none, named)
    table.replace(none)
    assert held(table) == [x for x in OLD if x[0] not in (1, 5)]
    table.flag(named.unionByName(spark.createDataFrame([(0,)], "document_id long")), "part", F.lit(42))
    assert held(table) == sorted([(0, 42), (0, 42)] + [x for x in OLD if x[0] not in (0, 1, 5)])


STEPS = ["started", *[f"{what} {name}" for name in ("index", "assets", "documents") for what in ("deleted", "noted")]]


@pytest.mark.parametrize("step", STEPS)
def test_a_cascade_resumes_after_any_step(spark, place, step):
    tables = {name: stored(spark, f"{place}/{name}", 2) for name in ("index", "assets", "documents")}
    cascade = writes.Cascade(spark, f"{place}/jobs", tables)
    ids = spark.createDataFrame([(1,), (4,), (99,)], "document_id long")
    with pytest.raises(Stopped):
        cascade.delete(ids, stop_at(step))
    left = [x for x in OLD if x[0] not in (1, 4)]
    done = STEPS.index(step)
    assert [held(t) for t in tables.values()] == [left if done > 2 * k else OLD for k in range(3)]
    assert len(cascade.open_jobs()) == 1
    writes.Cascade(spark, f"{place}/jobs", tables).resume()
    assert [held(t) for t in tables.values()] == [left] * 3
    assert not cascade.open_jobs()


def test_increments_equal_a_rebuild(spark, place):
    texts = {i: f"word{i % 3} common {'again ' * (i % 4)}" for i in range(30)}
    frame = lambda rows: spark.createDataFrame(rows, "node_id long, text string, live boolean")
    index = postings.Index(spark, f"{place}/a", "long")
    index.write(frame([(i, t, True) for i, t in texts.items()]), 0)
    second = frame([(3, "word9 common", True), (4, None, True), (5, "x", False), (50, "new common word0", None), (None, "lost", True)])
    for _ in range(2):  # a batch that comes twice
        index.write(second, 1)
    index.write(frame([(5, "back common", True), (6, "", False), (50, "new common", True), (50, "newer common", True)]), 2)
    texts |= {3: "word9 common", 4: "", 5: "back common", 50: "newer common"}
    del texts[6]
    docs = spark.createDataFrame(list(texts.items()), "node_id long, text string")
    asked = spark.createDataFrame([(1, "common word0"), (2, "again"), (3, "newer x lost"), (4, None)], "query_id long, query string")
    want = sorted(map(tuple, search.bm25(asked, docs).collect()))
    assert sorted(map(tuple, index.search(asked).collect())) == want
    assert sorted(map(tuple, index.rebuilt(f"{place}/b").search(asked).collect())) == want
    every = sorted(map(tuple, search.bm25(asked, docs, True).collect()))
    assert sorted(map(tuple, index.search(asked, True).collect())) == every and len(every) < len(want)


def test_an_index_is_kept_current_by_a_stream(spark, place):
    rows = spark.createDataFrame([(i, f"common word{i}", True) for i in range(12)], "node_id long, text string, live boolean")
    rows.repartition(3).write.parquet(f"{place}/in")
    index = postings.Index(spark, f"{place}/index", "long")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{place}/in")
    stream.writeStream.foreachBatch(lambda df, batch: index.write(df, batch)).option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start().awaitTermination()
    asked = spark.createDataFrame([(1, "common word7")], "query_id long, query string")
    assert sorted(map(tuple, index.search(asked).collect())) == sorted(map(tuple, search.bm25(asked, rows).collect()))


