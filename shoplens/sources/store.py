"""The store: the five logical tables as DataFrames.

``load_store(spark, sf_dir)`` derives a table from the driver's parquet files
when an analysis first asks for it, writes it as a parquet table under the
shared folder named by ``spark.checkpoint.dir`` (cutting the sessionization
lineage, surviving executor loss), and reads it back with an explicit schema
so every analysis gets column pruning and predicate pushdown into the scan.

The written location of a table is keyed by the path, length and modification
time of every file of its sources, as Hadoop's FileSystem lists them (so local
and remote inputs alike), and by the feed code: a changed feed or input never
reads stale tables.  Events that are appended as further files extend the web
tables.  A table's data go to a folder of their own; the table is
published by one small manifest that names the folder, created last and only
if there is none.  A reader sees no table or a whole one, and of two jobs that
build a table at once both read the first one's folder.  Before that the
table's key is checked: a doubled id fails the build.
"""

from __future__ import annotations

import hashlib
import json
import math
import os
import threading
import uuid
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoplens.functions.metrics import ts_lit
from shoplens.operators import ranking
from shoplens.session import checkpoint_root
from shoplens.sources import feeds, schemas

SOURCE_TABLES = ("events", "orders", "lineitem")
STORE_TABLES = ("website_sessions", "website_pageviews", "web_orders",
                "orders", "order_items", "order_item_refunds")

# Written layout: range-partitioned on (time, primary key) and sorted in each
# file, so Parquet row-group statistics skip data outside an analysis' time
# window.  The key makes range boundaries unique, so even one very hot
# instant splits across files.
LAYOUT = {
    "website_sessions": ("created_at", "website_session_id"),
    "website_pageviews": ("created_at", "website_pageview_id"),
    "web_orders": ("created_at", "order_id"),
    "orders": ("created_at", "order_id"),
    "order_items": ("created_at", "order_item_id"),
    "order_item_refunds": ("created_at", "order_item_refund_id"),
}

PRIMARY_KEY = {name: columns[-1] for name, columns in LAYOUT.items()}
#: Whether a table's key is checked when it is built.
CHECK_KEYS_CONF = "spark.shoplens.checkKeys"

#: Join keys whose frequent values are kept in sketches beside a table's folder.
HOT_KEYS = {"website_pageviews": "website_session_id", "website_sessions": "user_id"}
#: Rows for one sketch, and the keys it tells apart: counts are short of the
#: truth by at most 3.5 / 2 / SKETCH_KEYS of a sketch's rows.
SKETCH_ROWS, SKETCH_KEYS = 1 << 26, 4096

#: Source bytes for one file of a written table, and rows it holds at most.
FILE_BYTES, FILE_ROWS = 256 << 20, 20_000_000
#: Source rows for one range of a written table: a task sorts a range, about
#: 110 bytes a row, and source bytes don't tell its rows.
RANGE_ROWS = 2_000_000
#: Keys that one task of a key check counts.
CHECKED_KEYS = 1_000_000
#: Files a window's rows are read from by name; a wider window reads folders.
NAMED_FILES = 10_000

_lock = threading.Lock()
_memo: dict[tuple, "Store"] = {}


@dataclass
class Store:
    """Logical tables.  ``web_orders`` belong to web sessions; ``orders`` are
    the commerce orders that ``order_items`` and refunds hang off.  A table
    that is not given is made by ``make`` when it is first used."""
    website_sessions: DataFrame | None = None
    website_pageviews: DataFrame | None = None
    web_orders: DataFrame | None = None
    orders: DataFrame | None = None
    order_items: DataFrame | None = None
    order_item_refunds: DataFrame | None = None
    make: object = field(default=None, repr=False)
    windows: dict = field(default_factory=dict, repr=False)

    def __getattribute__(self, name):
        value = object.__getattribute__(self, name)
        if value is None and name in STORE_TABLES:
            value = object.__getattribute__(self, "make")(name)
            object.__setattr__(self, name, value)
        return value

    # short aliases used by the registry
    @property
    def sessions(self) -> DataFrame:
        return self.website_sessions

    @property
    def pageviews(self) -> DataFrame:
        return self.website_pageviews

    @property
    def items(self) -> DataFrame:
        return self.order_items

    @property
    def refunds(self) -> DataFrame:
        return self.order_item_refunds

    def heavy(self, name: str) -> DataFrame | None:
        """Frequent join keys of a table with their ``rows``, from the sketches
        written with it; None for tables that were given."""
        make = object.__getattribute__(self, "make")
        seen = object.__getattribute__(self, "windows")
        if make and name not in seen:
            seen[name] = make.heavy(name)
        return seen.get(name)

    def between(self, name: str, after=None, before=None) -> DataFrame:
        """A table's files that may have rows from ``after`` to ``before`` (either
        may be None): all rows of that window, and others, so that a filter on
        ``created_at`` must follow.  Tables that were given come whole."""
        make = object.__getattribute__(self, "make")
        if make is None or (after is None and before is None):
            return getattr(self, name)
        seen = object.__getattribute__(self, "windows")
        window = (name, str(after), str(before))
        if window not in seen:
            seen[window] = make.between(name, after, before)
        return seen[window]

    def register_views(self, prefix: str = "") -> list[str]:
        """Expose the tables as temporary views (``website_sessions``,
        ``website_pageviews``, ``web_orders``, ``orders``, ``order_items``,
        ``order_item_refunds``) for Spark SQL; returns the view names."""
        names = []
        for t in STORE_TABLES:
            getattr(self, t).createOrReplaceTempView(prefix + t)
            names.append(prefix + t)
        return names


def read_source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def derive(spark: SparkSession, sf_dir: str) -> tuple[dict[str, DataFrame], list[DataFrame]]:
    """Lazy DataFrames of all store tables (no writes), plus the shared
    intermediates (sessionized events, numbered line items)."""
    web = feeds.web_feed(read_source(spark, sf_dir, "events"))
    shop = feeds.commerce_feed(read_source(spark, sf_dir, "orders"),
                               read_source(spark, sf_dir, "lineitem"))
    return {
        "website_sessions": web.sessions,
        "website_pageviews": web.pageviews,
        "web_orders": web.orders,
        "orders": shop.orders,
        "order_items": shop.order_items,
        "order_item_refunds": shop.refunds,
    }, [web.tagged, shop.lines]


def _fs(spark: SparkSession, path: str):
    """(FileSystem, Path) of a path, by Hadoop, whatever its scheme."""
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    return hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hpath


def source_files(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """(path, length, modification time) of every file under ``path``."""
    fs, root = _fs(spark, path)
    if not fs.exists(root):
        raise FileNotFoundError(path)
    if fs.getFileStatus(root).isFile():
        st = fs.getFileStatus(root)
        return [(st.getPath().toString(), st.getLen(), st.getModificationTime())]
    out, it = [], fs.listFiles(root, True)
    while it.hasNext():
        st = it.next()
        out.append((st.getPath().toString(), st.getLen(), st.getModificationTime()))
    return sorted(out)


def _code() -> str:
    h = hashlib.sha1()
    for mod in (feeds, schemas, ranking):
        with open(mod.__file__, "rb") as f:
            h.update(f.read())
    h.update(repr((LAYOUT, HOT_KEYS, SKETCH_ROWS, SKETCH_KEYS)).encode())
    return h.hexdigest()


#: What each table is derived from: a changed source leaves the others' tables.
GROUPS = {"web": ("events",), "lines": ("lineitem",), "orders": ("orders", "lineitem")}
GROUP_OF = {"website_sessions": "web", "website_pageviews": "web", "web_orders": "web", "tagged_events": "web", "user_state": "web",
            "order_items": "lines", "order_item_refunds": "lines", "order_lines": "lines", "orders": "orders"}


def _sources(spark: SparkSession, sf_dir: str) -> dict[str, list[tuple[str, int, int]]]:
    return {name: source_files(spark, f"{sf_dir.rstrip('/')}/{name}.parquet") for name in SOURCE_TABLES}


def folders_of(spark: SparkSession, sf_dir: str, root: str, sources=None) -> dict[str, str]:
    """The folder of each group of tables: a key of its source files and the feed code."""
    sources = sources or _sources(spark, sf_dir)
    return {g: f"{root.rstrip('/')}/shoplens-store/{g}-" + hashlib.sha1(
        repr(([(n, sources[n]) for n in names], _code())).encode()).hexdigest()[:16] for g, names in GROUPS.items()}


def _published(spark: SparkSession, manifest: str) -> list[str] | None:
    """The data folders that a manifest names, if there is one."""
    fs, path = _fs(spark, manifest)
    return [r[0] for r in spark.read.text(manifest).collect()] if fs.exists(path) else None


#: File systems whose objects appear at once, whole, when they are closed; a
#: rename there copies.
OBJECT_STORES = ("s3", "s3a", "s3n", "gs", "abfs", "abfss", "wasb", "wasbs", "oss", "cosn")


def _create_if_absent(spark: SparkSession, path: str, content: str) -> bool:
    """Makes a small file with its whole content, unless there is one; returns
    whether it did.  Of several writers at once one does, by what the file
    system does in one step: a link, a rename that replaces nothing, or the
    conditional creation of an object."""
    fs, final = _fs(spark, path)
    scheme = fs.getUri().getScheme()

    def written(target):
        out = fs.createFile(target).overwrite(False).recursive().build()
        out.write(bytearray(content.encode()))
        out.close()
    if scheme in OBJECT_STORES:
        try:
            written(final)
        except Py4JJavaError:
            if fs.exists(final):
                return False
            raise
        return True
    temp = _fs(spark, f"{path}-{uuid.uuid4().hex}")[1]
    written(temp)
    try:
        if scheme == "file":
            os.link(temp.toUri().getPath(), final.toUri().getPath())
        else:
            hadoop, jvm = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._gateway
            replace_nothing = jvm.new_array(getattr(hadoop, "Options$Rename"), 0)
            hadoop.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(
                temp, final, replace_nothing)
    except (FileExistsError, Py4JJavaError):
        if fs.exists(final):
            return False
        raise
    finally:
        if fs.exists(temp):
            fs.delete(temp, False)
    return True


def _publish(spark: SparkSession, manifest: str, folders: list[str]) -> list[str]:
    """Name ``folders`` as a table's data; returns the folders that count (those
    of another job if it published first).  Fails if neither could."""
    if _create_if_absent(spark, manifest, "\n".join(folders)):
        return folders
    return _published(spark, manifest)


class DuplicateKeys(ValueError):
    """A table's primary key is not one."""


def counted_keys(table: DataFrame, key: str) -> DataFrame:
    """The keys of a written table and how many ``rows`` have each.  Keys are
    dealt out before they are counted: counts per file would combine nothing
    and hold all keys of a file."""
    ways = max(1, math.ceil(table.count() / CHECKED_KEYS))
    return table.select(key).repartition(ways, key).groupBy(key).agg(F.count(F.lit(1)).alias("rows"))


def check_keys(table: DataFrame, name: str) -> None:
    """Fails if two rows of the table share the key, or one has none.

    The analyses count ids where the literal queries count distinct ids, which
    is right only for primary keys.  Keys are counted per hash bucket by Spark;
    what reaches the driver is a few offenders."""
    key = PRIMARY_KEY[name]
    bad = counted_keys(table, key).where((F.col("rows") > 1) | F.col(key).isNull()).take(3)
    if bad:
        shown = ", ".join(f"{r[key]} ({r['rows']} rows)" for r in bad)
        raise DuplicateKeys(f"{key} is not a primary key of {name}: {shown}")


def write_key_sketches(spark: SparkSession, folder: str, name: str) -> None:
    """Sketches of the most frequent join keys of a written table, in a folder
    beside it: one for every SKETCH_ROWS rows, by hash of the key, so that a
    sketch's error doesn't grow with the table.  They are partial aggregates:
    what is shuffled is sketches, however hot a key is."""
    key, table = HOT_KEYS[name], spark.read.parquet(folder)
    n = max(1, math.ceil(table.count() / SKETCH_ROWS))
    (table.where(F.col(key).isNotNull()).groupBy(F.pmod(F.xxhash64(key), F.lit(n)).alias("part"))
     .agg(F.expr(f"approx_top_k_accumulate({key}, {SKETCH_KEYS})").alias("sketch"))
     .write.parquet(f"{folder}-keys"))


def frequent_keys(spark: SparkSession, folders: list[str], name: str) -> DataFrame:
    """(key, rows) of the keys that the sketches of a table's folders tell; a
    key that several folders have counts with its sum."""
    found = F.explode(F.expr(f"approx_top_k_estimate(sketch, {SKETCH_KEYS})")).alias("found")
    told = (spark.read.parquet(*[f"{f}-keys" for f in folders]).select(found)
            .select(F.col("found.item").alias(HOT_KEYS[name]), F.col("found.count").alias("rows")))
    if len(folders) == 1:  # a folder has a key in one sketch alone
        return told
    return told.groupBy(HOT_KEYS[name]).agg(F.sum("rows").alias("rows"))


def write_file_ranges(spark: SparkSession, folder: str) -> None:
    """The least and greatest time in each file of a written table, as a table
    in a folder beside it."""
    (spark.read.parquet(folder).groupBy(F.concat(F.lit(f"{folder}/"), "_metadata.file_name").alias("file"))
     .agg(F.min("created_at").alias("first"), F.max("created_at").alias("last"))
     .write.parquet(f"{folder}-files"))


def files_between(spark: SparkSession, folders: list[str], after=None, before=None) -> list[str]:
    """The files with rows in a time window (bounds included), found without a
    look at any of them; the folders themselves if that is over NAMED_FILES
    files, whose footers Spark then prunes by."""
    cond = F.lit(True)
    if after is not None:
        cond &= F.col("last") >= ts_lit(after)
    if before is not None:
        cond &= F.col("first") <= ts_lit(before)
    ranges = spark.read.parquet(*[f"{f}-files" for f in folders])
    found = [r[0] for r in ranges.where(cond).select("file").take(NAMED_FILES + 1)]
    return folders if len(found) > NAMED_FILES else sorted(found)


def _write_once(spark: SparkSession, make, base: str, name: str, source_bytes: int, source_rows, layout=None,
                before: list[str] | None = None) -> list[str]:
    """The folders of the table's data, written (``make()``) unless published;
    ``before`` are folders whose rows it has, too.  A table with a layout is
    sorted in ranges for its source's bytes and rows (``source_rows()``).  A
    logical table whose key is not unique is not published."""
    manifest = f"{base}/{name}.manifest"
    done = _published(spark, manifest)
    if done:
        return done
    df = make()
    if layout:
        ranges = max(1, math.ceil(source_bytes / FILE_BYTES), math.ceil(source_rows() / RANGE_ROWS))
        df = df.repartitionByRange(ranges, *layout).sortWithinPartitions(*layout)
    folder = f"{base}/{name}-{uuid.uuid4().hex}"
    df.write.mode("error").option("maxRecordsPerFile", FILE_ROWS).parquet(folder)
    if name in PRIMARY_KEY and spark.conf.get(CHECK_KEYS_CONF, "true") != "false":
        check_keys(spark.read.parquet(folder), name)
        if before:
            check_keys_beside(spark.read.parquet(*before), spark.read.parquet(folder), name)
    if name in HOT_KEYS:
        write_key_sketches(spark, folder, name)
    if name in LAYOUT:
        write_file_ranges(spark, folder)
    return _publish(spark, manifest, [*(before or []), folder])


def check_keys_beside(old: DataFrame, new: DataFrame, name: str) -> None:
    """Fails if new rows have a key of old ones (each side's own are checked).
    Ids that go on above the old ones, as the file statistics tell, need no join."""
    key = PRIMARY_KEY[name]
    first = new.agg(F.min(key)).first()[0]
    if first is not None:
        again = old.where(F.col(key) >= first).select(key).join(new.select(key), key, "left_semi").take(3)
        if again:
            raise DuplicateKeys(f"{key} is not a primary key of {name}: {', '.join(str(r[key]) for r in again)} came again")


class _Builder:
    """Makes the tables of one state of the sources, each with what it needs:
    the sessionized events for the web tables, the numbered lines for items
    and refunds, both for none.  The intermediates are tables in the same
    folders, so a lost executor costs a re-read, and a failed build resumes
    after the last published table.

    The web tables grow with their source: if all files of an earlier build
    are still there, only the further files are read.  Their events go on from
    the state that build left for each user, and their rows are further folders
    of its tables.  Events that are not later than their user's, and changed or
    missing files, make it a new build."""

    def __init__(self, spark: SparkSession, sf_dir: str, root: str):
        self.spark, self.sf_dir, self.root = spark, sf_dir.rstrip("/"), root
        self.sources = _sources(spark, sf_dir)
        self.base = folders_of(spark, sf_dir, root, self.sources)
        self.size = {name: sum(n for _, n, _ in files) for name, files in self.sources.items()}
        self.rows: dict[str, int] = {}
        self.earlier: _Earlier | None | bool = False  # not looked for yet

    def _event_files(self) -> list[str]:
        return [json.dumps(f) for f in self.sources["events"]]

    def _extends(self) -> "_Earlier | None":
        """The largest earlier build that this one can go on from."""
        if self.earlier is False:
            record = f"{self.base['web']}/build.manifest"
            known = _published(self.spark, record)
            if known is None:
                known = _publish(self.spark, record, [self._find_earlier(), _code(), *self._event_files()])
            self.earlier = _Earlier(self, known[0]) if known[0] != "new" else None
        return self.earlier

    def _find_earlier(self) -> str:
        fs, top = _fs(self.spark, f"{self.root.rstrip('/')}/shoplens-store")
        mine, best = set(self._event_files()), ("new", 0)
        for st in fs.listStatus(top) if fs.exists(top) else []:
            folder = f"{self.root.rstrip('/')}/shoplens-store/{st.getPath().getName()}"
            record = _published(self.spark, f"{folder}/build.manifest") if "/web-" in folder else None
            if (record and record[1] == _code() and set(record[2:]) < mine and len(record) > best[1]
                    and _published(self.spark, f"{folder}/user_state.manifest")):
                best = (folder, len(record))
        if best[0] == "new" or not feeds.goes_on(_Earlier(self, best[0]).new_events(), _Earlier(self, best[0]).table("user_state")):
            return "new"
        return best[0]

    def _table(self, name: str, source: str, make, layout=None) -> DataFrame:
        before = None
        if GROUP_OF[name] == "web" and name != "user_state" and self._extends():
            before = self._extends().folders(name)
        paths = _write_once(self.spark, make, self.base[GROUP_OF[name]], name, self.size[source],
                            lambda: self._rows(source), layout, before)
        own = paths[len(before):] if before and not layout else paths  # an intermediate: only the new rows
        return self.spark.read.parquet(*own)

    def _events(self) -> DataFrame:
        return self._extends().new_events() if self._extends() else read_source(self.spark, self.sf_dir, "events")

    def _rows(self, source: str) -> int:
        """The rows that tables are made from, as the files' footers tell."""
        if source not in self.rows:
            read = self._events() if source == "events" else read_source(self.spark, self.sf_dir, source)
            self.rows[source] = read.count()
        return self.rows[source]

    def _state(self) -> DataFrame | None:
        return self._extends().table("user_state") if self._extends() else None

    def _tagged(self) -> DataFrame:
        tagged = self._table("tagged_events", "events", lambda: feeds.tag_sessions(self._events(), state=self._state()))
        self._table("user_state", "events", lambda: feeds.user_state(tagged, self._state()))
        return tagged

    def _web(self):
        return feeds.web_tables_from_tagged(self._tagged())

    def _shop(self):
        lines = self._table("order_lines", "lineitem",
                            lambda: feeds.number_lines(read_source(self.spark, self.sf_dir, "lineitem")))
        return feeds.commerce_tables(read_source(self.spark, self.sf_dir, "orders"), lines)

    def paths(self, name: str) -> list[str]:
        make, source = {
            "website_sessions": (lambda: self._web().sessions, "events"),
            "website_pageviews": (lambda: self._web().pageviews, "events"),
            "web_orders": (lambda: self._web().orders, "events"),
            "orders": (lambda: self._shop().orders, "orders"),
            "order_items": (lambda: self._shop().order_items, "lineitem"),
            "order_item_refunds": (lambda: self._shop().refunds, "lineitem"),
        }[name]
        with _lock:
            self._table(name, source, make, LAYOUT[name])
        return _published(self.spark, f"{self.base[GROUP_OF[name]]}/{name}.manifest")

    def heavy(self, name: str) -> DataFrame:
        return frequent_keys(self.spark, self.paths(name), name)

    def between(self, name: str, after, before) -> DataFrame:
        files = files_between(self.spark, self.paths(name), after, before)
        read = self.spark.read.schema(schemas.TABLES[name])
        return read.parquet(*files) if files else self.spark.createDataFrame([], schemas.TABLES[name])

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.schema(schemas.TABLES[name]).parquet(*self.paths(name))


class _Earlier:
    """An earlier build of the web tables, whose source files are all there."""

    def __init__(self, later: _Builder, folder: str):
        self.later, self.folder = later, folder
        self.files = _published(later.spark, f"{folder}/build.manifest")[2:]

    def new_events(self) -> DataFrame:
        known = set(self.files)
        new = [f[0] for f, text in zip(self.later.sources["events"], self.later._event_files()) if text not in known]
        return self.later.spark.read.parquet(*new)

    def table(self, name: str) -> DataFrame:
        return self.later.spark.read.parquet(*_published(self.later.spark, f"{self.folder}/{name}.manifest"))

    def folders(self, name: str) -> list[str]:
        """The table's folders, made now from its tagged events if nobody asked for it."""
        manifest = f"{self.folder}/{name}.manifest"
        done = _published(self.later.spark, manifest)
        if done:
            return done
        tagged = self.table("tagged_events")
        made = feeds.web_tables_from_tagged(tagged)
        df = {"website_sessions": made.sessions, "website_pageviews": made.pageviews, "web_orders": made.orders}[name]
        return _write_once(self.later.spark, lambda: df, self.folder, name, self.later.size["events"], tagged.count, LAYOUT[name])


def load_store(spark: SparkSession, sf_dir: str, materialized: bool = True,
               root: str | None = None) -> Store:
    """The store for ``sf_dir``; ``materialized=False`` keeps it lazy.
    ``root`` overrides the folder the tables are written under."""
    if not materialized:
        tables, _ = derive(spark, sf_dir)
        return Store(**tables)
    root = root or checkpoint_root(spark)
    made = _Builder(spark, sf_dir, root)
    key = (spark.sparkContext.applicationId, *made.base.values())
    with _lock:
        if key not in _memo:
            _memo[key] = Store(make=made)
        return _memo[key]


def materialize(spark: SparkSession, sf_dir: str, root: str | None = None) -> Store:
    """The store with all its tables written (for benchmarks and reports)."""
    store = load_store(spark, sf_dir, root=root)
    for t in STORE_TABLES:
        getattr(store, t)
    return store
