"""Store build: tables on demand, resume after a partial build, publish by
manifest, and new rows when an input is replaced."""

import datetime as dt
import os
import shutil
import tempfile
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from samples import SF_SMALL
from shoplens.plans import REGISTRY
from shoplens.sources import feeds
from shoplens.sources import store as S


def manifests(base):
    return sorted(f.removesuffix(".manifest") for f in os.listdir(base) if f.endswith(".manifest"))


def everything(root):
    return sorted(os.path.join(d, f) for d, _, files in os.walk(root) for f in files)


def test_only_needed_tables_are_built_and_the_build_resumes(spark):
    root = tempfile.mkdtemp(prefix="shoplens-store-")
    base = S.folders_of(spark, SF_SMALL, root)
    REGISTRY["top_pages"](S.load_store(spark, SF_SMALL, root=root)).collect()
    assert manifests(base["web"]) == ["build", "tagged_events", "user_state", "website_pageviews"]
    assert not os.path.exists(base["lines"]) and not os.path.exists(base["orders"])
    S.materialize(spark, SF_SMALL, root)
    assert {t for b in base.values() for t in manifests(b)} == {*S.STORE_TABLES, "tagged_events", "order_lines", "user_state", "build"}
    files = everything(root)
    S._memo.clear()
    S.materialize(spark, SF_SMALL, root)  # all are there: nothing is written
    assert everything(root) == files


def event_files(folder):
    """events.parquet as a folder, with the events up to the first days of the table."""
    for t in ("orders", "lineitem"):
        shutil.copyfile(f"{SF_SMALL}/{t}.parquet", f"{folder}/{t}.parquet")
    os.mkdir(f"{folder}/events.parquet")
    rows = pq.read_table(f"{SF_SMALL}/events.parquet")
    return rows, sorted(rows.column("ts").to_pylist())


def add(folder, rows, name, after, upto):
    ts = rows.column("ts")
    which = pc.and_(pc.greater(ts, pa.scalar(after, ts.type)), pc.less_equal(ts, pa.scalar(upto, ts.type)))
    pq.write_table(rows.filter(which), f"{folder}/events.parquet/{name}.parquet")
    return pc.sum(which).as_py()


def same(spark, store, folder):
    S._memo.clear()
    whole = S.load_store(spark, folder, root=tempfile.mkdtemp(prefix="shoplens-whole-"))
    for t in ("website_sessions", "website_pageviews", "web_orders"):
        a, b = getattr(store, t), getattr(whole, t)
        assert a.count() == b.count() and a.exceptAll(b).isEmpty(), t


def test_appended_events_extend_the_tables(spark):
    """Day after day equals a rebuild; each build reads its own day alone."""
    folder, root = tempfile.mkdtemp(prefix="shoplens-days-"), tempfile.mkdtemp(prefix="shoplens-store-")
    rows, ts = event_files(folder)
    cuts = [ts[0] - dt.timedelta(days=1), ts[400], ts[650], ts[655], ts[-1]]
    for n, (after, upto) in enumerate(zip(cuts, cuts[1:])):
        new = add(folder, rows, f"day-{n}", after, upto)
        store = S.load_store(spark, folder, root=root)
        if n != 1:  # a build of which a table is never asked for is gone on from all the same
            same(spark, store, folder)
        else:
            store.web_orders.count()
        base = S.folders_of(spark, folder, root)["web"]
        tagged = S._published(spark, f"{base}/tagged_events.manifest")
        assert len(tagged) == n + 1 and spark.read.parquet(tagged[-1]).count() == new
        assert store.pageviews.count() == sum(x <= upto for x in ts)


def test_sketches_tell_the_frequent_keys(spark, monkeypatch):
    """Few keys are told apart here, in several sketches and two folders: a key
    with a third of the rows, one with a twentieth in the second folder only."""
    monkeypatch.setattr(S, "SKETCH_ROWS", 5000)
    monkeypatch.setattr(S, "SKETCH_KEYS", 64)
    root, n = tempfile.mkdtemp(prefix="shoplens-keys-"), 20_000
    folders, i = [f"{root}/a", f"{root}/b"], F.col("id")
    for f in folders:
        user = F.when(i % 3 == 0, 77).when((i % 20 == 1) & F.lit(f == folders[1]), 5).when(i % 50 != 2, i + 100)
        spark.range(n).select(user.cast("long").alias("user_id")).write.parquet(f)
        S.write_key_sketches(spark, f, "website_sessions")
    counts = {r[0]: r[1] for r in spark.read.parquet(*folders).groupBy("user_id").count().collect()}
    told = {r["user_id"]: r["rows"] for r in S.frequent_keys(spark, folders, "website_sessions").collect()}
    error = 2 * n * 3.5 / 2 / 64
    assert spark.read.parquet(*[f"{f}-keys" for f in folders]).count() == 8 and None not in told
    assert all(abs(told[k] - counts[k]) <= error for k in told)
    assert all(k in told for k in (5, 77)) and told[77] > 10 * error > told[5]


def test_stored_sketches_replace_the_scan_for_hot_keys(spark):
    root = tempfile.mkdtemp(prefix="shoplens-store-")
    S._memo.clear()
    store = S.load_store(spark, SF_SMALL, root=root)
    given = S.Store(**{t: getattr(store, t) for t in S.STORE_TABLES})
    spark.conf.set("spark.shoplens.hotKeyRows", "2")
    try:
        for name in ("next_page_pathing", "funnel_page_flags", "repeat_session_histogram"):
            by_sketch, by_sample = REGISTRY[name](store), REGISTRY[name](given)
            plans = [df._jdf.queryExecution().optimizedPlan().toString() for df in (by_sketch, by_sample)]
            assert "approx_top_k_estimate" in plans[0] and "1000000" not in plans[0], name
            assert "approx_top_k_estimate" not in plans[1] and "1000000" in plans[1], name
            assert sorted(map(str, by_sketch.collect())) == sorted(map(str, by_sample.collect()))
    finally:
        spark.conf.unset("spark.shoplens.hotKeyRows")


def test_a_window_reads_the_files_that_have_its_rows(spark, monkeypatch):
    root = tempfile.mkdtemp(prefix="shoplens-store-")
    monkeypatch.setattr(S, "FILE_BYTES", 2000)
    S._memo.clear()
    store = S.load_store(spark, SF_SMALL, root=root)
    everything_ = store.sessions
    bounds = {f: (a, b) for f, a, b in everything_.groupBy(F.col("_metadata.file_name")).agg(
        F.min("created_at"), F.max("created_at")).collect()}
    assert len(bounds) > 4
    times = sorted(t for pair in bounds.values() for t in pair)
    conv = REGISTRY["conversion_overall"]
    files = []
    for after, before in [(None, times[0]), (None, times[3]), (times[4], times[5]), (times[-1], None),
                          (None, times[0] - dt.timedelta(days=1)), (times[-1] + dt.timedelta(days=1), None)]:
        part = store.between("website_sessions", after, before)
        want = {f for f, (a, b) in bounds.items() if (after is None or b >= after) and (before is None or a <= before)}
        assert {os.path.basename(f) for f in part.inputFiles()} == want
        keep = F.lit(True)
        if after:
            keep &= F.col("created_at") >= F.lit(after).cast("timestamp_ntz")
        if before:
            keep &= F.col("created_at") <= F.lit(before).cast("timestamp_ntz")
        assert part.where(keep).count() == everything_.where(keep).count()
        files.append(len(want))
    assert files[0] < files[1] < len(bounds) and files[4:] == [0, 0]
    early = conv.run(store, **{**conv.params, "before": times[3]})
    early_files = [f for f in early.inputFiles() if "website_sessions" in f]
    assert len(early_files) == files[1]
    given = S.Store(**{t: getattr(store, t) for t in S.STORE_TABLES})
    assert early.collect() == conv.run(given, **{**conv.params, "before": times[3]}).collect()
    monkeypatch.setattr(S, "NAMED_FILES", 2)  # a wide window reads the folders
    folders = S.files_between(spark, store.make.paths("website_sessions"), None, times[-1])
    assert folders == store.make.paths("website_sessions")


def test_sketches_of_an_empty_table(spark):
    folder, root = tempfile.mkdtemp(prefix="shoplens-none-"), tempfile.mkdtemp(prefix="shoplens-store-")
    for t in S.SOURCE_TABLES:
        pq.write_table(pq.read_table(f"{SF_SMALL}/{t}.parquet").slice(0, 0), f"{folder}/{t}.parquet")
    store = S.load_store(spark, folder, root=root)
    assert all(store.heavy(name).isEmpty() for name in S.HOT_KEYS)
    assert REGISTRY["repeat_session_histogram"](store).collect() == []


def test_late_events_and_changed_files_make_a_new_build(spark):
    folder, root = tempfile.mkdtemp(prefix="shoplens-late-"), tempfile.mkdtemp(prefix="shoplens-store-")
    rows, ts = event_files(folder)
    before = ts[0] - dt.timedelta(days=1)

    def generations():
        store = S.load_store(spark, folder, root=root)
        same(spark, store, folder)
        base = S.folders_of(spark, folder, root)["web"]
        return len(S._published(spark, f"{base}/website_sessions.manifest"))
    add(folder, rows, "b", ts[300], ts[600])
    assert generations() == 1
    add(folder, rows, "a", before, ts[300])  # earlier than what is there
    assert generations() == 1
    add(folder, rows, "c", ts[600], ts[800])
    assert generations() == 2
    add(folder, rows, "c", ts[600], ts[900])  # changed: goes on from a and b
    assert generations() == 2


def test_a_changed_source_leaves_the_other_tables(spark):
    folder, root = tempfile.mkdtemp(prefix="shoplens-part-"), tempfile.mkdtemp(prefix="shoplens-store-")
    for t in S.SOURCE_TABLES:
        shutil.copyfile(f"{SF_SMALL}/{t}.parquet", f"{folder}/{t}.parquet")
    old = S.folders_of(spark, folder, root)
    shutil.copyfile("/root/testdata/sf0.01/lineitem.parquet", f"{folder}/lineitem.parquet")
    new = S.folders_of(spark, folder, root)
    assert old["web"] == new["web"] and old["lines"] != new["lines"] and old["orders"] != new["orders"]


def test_a_key_that_comes_again_in_appended_events_is_reported(spark):
    folder, root = tempfile.mkdtemp(prefix="shoplens-again-"), tempfile.mkdtemp(prefix="shoplens-store-")
    rows, ts = event_files(folder)
    add(folder, rows, "a", ts[0] - dt.timedelta(days=1), ts[500])
    S.load_store(spark, folder, root=root).pageviews.count()
    again = rows.slice(3, 1).set_column(rows.column_names.index("ts"), "ts", pa.array([ts[-1]], rows.schema.field("ts").type))
    pq.write_table(again, f"{folder}/events.parquet/b.parquet")
    with pytest.raises(S.DuplicateKeys, match="came again"):
        S.load_store(spark, folder, root=root).pageviews.count()


def test_publish_keeps_the_first_copy_and_reports_failure(spark, monkeypatch):
    root = tempfile.mkdtemp(prefix="shoplens-publish-")
    assert S._publish(spark, f"{root}/t.manifest", [f"{root}/first"]) == [f"{root}/first"]
    assert S._publish(spark, f"{root}/t.manifest", [f"{root}/second"]) == [f"{root}/first"]
    assert os.listdir(root).count("t.manifest") == 1
    def refused(*_):
        raise PermissionError("no")
    monkeypatch.setattr(S.os, "link", refused)
    with pytest.raises(OSError):
        S._publish(spark, f"{root}/u.manifest", [f"{root}/third"])
    assert os.listdir(root) == ["t.manifest"]


def test_of_many_writers_at_once_one_publishes(spark):
    root = tempfile.mkdtemp(prefix="shoplens-race-")
    for n in range(10):
        with ThreadPoolExecutor(8) as pool:
            got = list(pool.map(lambda i: S._publish(spark, f"{root}/{n}.manifest", [f"{root}/folder-{i}"])[0], range(8)))
        assert len(set(got)) == 1 and S._published(spark, f"{root}/{n}.manifest") == [got[0]]
    assert sorted(f for f in os.listdir(root) if not f.startswith(".")) == sorted(f"{n}.manifest" for n in range(10))


def test_two_builds_at_once_read_the_same_folder(spark):
    root = tempfile.mkdtemp(prefix="shoplens-builds-")
    base = S.folders_of(spark, SF_SMALL, root)["web"]
    with ThreadPoolExecutor(2) as pool:
        first, second = pool.map(lambda _: S._Builder(spark, SF_SMALL, root)._table(
            "tagged_events", "events", lambda: feeds.tag_sessions(S.read_source(spark, SF_SMALL, "events"))).inputFiles(), range(2))
    assert first == second and manifests(base) == ["build", "tagged_events"]


def test_renaming_file_systems_replace_nothing(spark):
    """The way of HDFS, on the file system that is here."""
    root = tempfile.mkdtemp(prefix="shoplens-rename-")
    with open(f"{root}/there", "w") as f:
        f.write("first")
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.shop.link./t", f"file://{root}")
    assert S._create_if_absent(spark, "viewfs://shop/t/there", "second") is False
    assert S._create_if_absent(spark, "viewfs://shop/t/new", "third") is True
    assert open(f"{root}/there").read() == "first" and open(f"{root}/new").read() == "third"


@pytest.mark.parametrize("table, column", [("events", "event_id"), ("orders", "o_orderkey")])
def test_a_doubled_or_missing_key_is_reported(spark, table, column):
    folder, root = tempfile.mkdtemp(prefix="shoplens-doubled-"), tempfile.mkdtemp(prefix="shoplens-store-")
    for t in S.SOURCE_TABLES:
        shutil.copyfile(f"{SF_SMALL}/{t}.parquet", f"{folder}/{t}.parquet")
    rows = pq.read_table(f"{folder}/{table}.parquet")
    at = rows.column_names.index(column)
    for bad in (rows.column(at)[7].as_py(), None):
        again = rows.slice(5, 1).set_column(at, column, pa.array([bad], rows.schema.field(at).type))
        pq.write_table(pa.concat_tables([rows, again.cast(rows.schema)]), f"{folder}/{table}.parquet")
        store = S.load_store(spark, folder, root=root)
        with pytest.raises(S.DuplicateKeys, match=str(bad)):
            (store.pageviews if table == "events" else store.orders).count()
    S.load_store(spark, SF_SMALL, root=root).orders.count()


@pytest.mark.parametrize("scheme", ["", "file://"])
def test_a_replaced_input_shows_its_new_rows(spark, scheme):
    folder = tempfile.mkdtemp(prefix="shoplens-input-")
    root = tempfile.mkdtemp(prefix="shoplens-store-")
    for sf, rows in (("sf0.001", 1000), ("sf0.01", 10_000)):
        for t in S.SOURCE_TABLES:
            shutil.copyfile(f"/root/testdata/{sf}/{t}.parquet", f"{folder}/{t}.parquet")
        store = S.load_store(spark, scheme + folder, root=root)
        assert store.pageviews.count() == rows


def test_write_reports(spark):
    from shoplens.plans.report import write_reports
    out = tempfile.mkdtemp(prefix="shoplens-reports-")
    store = S.load_store(spark, SF_SMALL)
    names = write_reports(store, out, ["conversion_by_device", "monthly_refund_summary"])
    for n in names:
        assert spark.read.parquet(f"{out}/{n}").count() == REGISTRY[n](store).count()


def test_a_range_has_bounded_rows_whatever_the_bytes(spark, monkeypatch):
    root = tempfile.mkdtemp(prefix="shoplens-store-")
    monkeypatch.setattr(S, "RANGE_ROWS", 500)  # the files' bytes ask for one range
    S._memo.clear()
    store = S.load_store(spark, SF_SMALL, root=root)
    for name, source in (("website_pageviews", "events"), ("orders", "orders"), ("order_items", "lineitem")):
        rows = S.read_source(spark, SF_SMALL, source).count()
        sizes = [r[1] for r in getattr(store, name).groupBy(F.col("_metadata.file_name")).agg(F.count("*")).collect()]
        assert sum(sizes) == rows > 500 and len(sizes) >= rows / 500 / 2, name
        assert max(sizes) <= 2 * 500, name
    S._memo.clear()


def test_a_key_check_counts_bounded_keys_a_task(spark, monkeypatch):
    monkeypatch.setattr(S, "CHECKED_KEYS", 100)
    folder = tempfile.mkdtemp(prefix="shoplens-store-") + "/t"
    spark.range(1000).coalesce(1).select(F.col("id").alias("order_id")).write.parquet(folder)
    table = spark.read.parquet(folder)
    counted = S.counted_keys(table, "order_id")
    plan = counted._jdf.queryExecution().executedPlan().toString()
    # dealt out first: nothing below the exchange gathers keys
    assert "hashpartitioning(order_id" in plan and ", 10)" in plan and "HashAggregate" not in plan[plan.index("hashpartitioning("):]
    assert counted.count() == 1000
    S.check_keys(table, "orders")
    with pytest.raises(S.DuplicateKeys, match="7 \\(2 rows\\)"):
        S.check_keys(table.unionByName(spark.range(7, 8).select(F.col("id").alias("order_id"))), "orders")
    with pytest.raises(S.DuplicateKeys, match="None"):
        S.check_keys(table.unionByName(spark.sql("select cast(null as bigint) as order_id")), "orders")
