"""Event tables on Parquet, partitioned by bucket; reads, merges, import and export."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import payload
from ..functions.patterns import java
from ..operators.folds import PART_ROWS
from ..operators.intervals import heartbeat_merge
from ..schema import EVENT, EVENT_DDL
from ..scratch import written

#: A catalog of buckets.
CATALOG_DDL = "bucket string, type string, client string, hostname string, created timestamp, data string"
#: Buckets that get folders of their own in a write, the largest ones; all others share files.
FOLDERS = 500
#: Rows of the largest bucket whose document may be put together in a row.
SHARED_ROWS = 10_000
#: The folder of shared files, and what they hold.
SHARED, SHARED_DDL = "bucket=__HIVE_DEFAULT_PARTITION__", "name string, id long, start_ns long, end_ns long, data string"
#: Fixed value: the key under which a bucket's data says where it was synced from.
ORIGIN = "$aw.sync.origin"


def read(spark: SparkSession, path: str) -> DataFrame:
    """The events of a table."""
    rows = spark.read.schema(f"bucket string, {SHARED_DDL}").parquet(path)
    shared = rows.where("bucket is null").drop("bucket").withColumnRenamed("name", "bucket")
    return rows.where("bucket is not null").select(*EVENT).unionByName(shared.select(*EVENT))


def write(events: DataFrame, path: str, mode: str = "append") -> None:
    """Write events partitioned by bucket and sorted by start, so that time filters skip row groups.

    The ``FOLDERS`` largest buckets have a folder each, and of these one of over ``PART_ROWS`` rows is spread over several
    tasks by day; the others share files, in which they are sorted by name, so that files grow with rows and not with buckets.
    """
    rows = events.select(*EVENT)
    largest = rows.where("bucket is not null").groupBy(F.col("bucket").alias("_of")).agg(F.count("*").alias("_n")).orderBy(F.col("_n").desc(), "_of").limit(FOLDERS)
    placed = rows.join(F.broadcast(largest), F.col("bucket") == F.col("_of"), "left")
    day = F.when(F.col("_n") > PART_ROWS, F.floor(F.col("start_ns") / F.lit(86_400_000_000_000)))
    placed = placed.select(F.col("_of").alias("bucket"), F.when(F.col("_of").isNull(), F.col("bucket")).alias("name"), day.alias("_day"), *EVENT[1:])
    placed.repartition("bucket", "name", "_day").drop("_day").sortWithinPartitions("bucket", "name", "start_ns").write.mode(mode).partitionBy("bucket").parquet(path)


def scan(events: DataFrame, bucket: str, lo: int | None = None, hi: int | None = None, limit: int | None = None, clip: bool = True) -> DataFrame:
    """The events of a bucket that meet [lo, hi], both ends included, newest first up to ``limit``; then
    ``clip``ped to the range. lo above hi gives none.
    """
    df = events.where(F.col("bucket") == bucket)
    if lo is not None:
        df = df.where(F.col("end_ns") >= lo)
    if hi is not None:
        df = df.where(F.col("start_ns") <= hi)
    if lo is not None and hi is not None and lo > hi:
        df = df.limit(0)
    if limit is not None:
        df = df.orderBy(F.col("start_ns").desc(), "id").limit(max(0, limit))
    if clip and lo is not None:
        df = df.withColumn("start_ns", F.greatest("start_ns", F.lit(lo)))
    if clip and hi is not None:
        df = df.withColumn("end_ns", F.least("end_ns", F.lit(hi)))
    return df


def event(events: DataFrame, bucket: str, id: int, required: bool = False) -> DataFrame:  # noqa: A002
    """The event of an id; if it is ``required``, KeyError where there is none, which runs a job when called."""
    found = events.where((F.col("bucket") == bucket) & (F.col("id") == id))
    if required and not found.limit(1).count():
        raise KeyError(id)
    return found


def count(events: DataFrame, bucket: str, lo: int, hi: int) -> DataFrame:
    """``n``: how many events meet [lo, hi]; 0 unless lo is below hi."""
    return scan(events, bucket, lo, hi, clip=False).where(F.lit(lo < hi)).agg(F.count("*").alias("n"))


def metadata(events: DataFrame, buckets: DataFrame | None = None) -> DataFrame:
    """(bucket, n, start_ns, end_ns) of each bucket; with a table of ``buckets``, those without events too."""
    out = events.groupBy("bucket").agg(F.count("*").alias("n"), F.min("start_ns").alias("start_ns"), F.max("end_ns").alias("end_ns"))
    return out if buckets is None else buckets.join(out, "bucket", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def find_bucket(buckets: DataFrame, prefix: str, hostname: str | None = None) -> DataFrame:
    """The bucket of that name, else the first by name that begins so; of ``hostname`` if given."""
    df = buckets.where(F.col("bucket").startswith(prefix))
    if hostname is not None:
        df = df.where(F.col("hostname") == hostname)
    return df.orderBy(F.col("bucket") != prefix, "bucket").limit(1)


def import_new(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """The incoming events that the table hasn't yet, by bucket, start, end and data; repeats among them stay.

    Data are compared as JSON objects, whatever the order of their keys.
    """
    same = ["bucket", "start_ns", "end_ns", "_data"]
    have = existing.withColumn("_data", payload.canonical()).select(*same).distinct()
    return incoming.withColumn("_data", payload.canonical()).join(have, same, "left_anti").select(*incoming.columns)


#: What says which of several events is the last: the order of a bucket.
LAST = ("start_ns", "end_ns", "data", "bucket")


def last_of_each_id(incoming: DataFrame) -> DataFrame:
    """The events, of those of one id the last by ``LAST``; those without id all stay."""
    own = F.struct(*LAST)
    last = incoming.where("id is not null").groupBy("id").agg(F.max(own).alias("e")).select("e.bucket", "id", "e.start_ns", "e.end_ns", "e.data")
    return incoming.where("id is null").select(*EVENT).unionByName(last)


def upsert(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """The table after an insert: an incoming id replaces the event that has it, in whatever bucket; of incoming events of
    one id the last counts."""
    kept = existing.join(incoming.where("id is not null").select("id").distinct(), "id", "left_anti")
    return kept.select(*EVENT).unionByName(last_of_each_id(incoming))


def insert(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """As ``upsert``, but incoming events without id get one: consecutive numbers above all that the table and they have.

    Runs a job for the highest id, and those of ``with_ids``, when called.
    """
    highest = existing.select("id").unionByName(incoming.select("id")).agg(F.max("id")).first()[0] or 0
    return upsert(existing, incoming.where("id is not null")).unionByName(with_ids(incoming.where("id is null"), highest).select(*EVENT))


def replace(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """The table with the incoming events in the places of those of their ids; KeyError if a bucket has no such event, which
    runs a job when called."""
    missing = incoming.select("bucket", "id").join(existing.select("bucket", "id"), ["bucket", "id"], "left_anti").limit(1).collect()
    if missing:
        raise KeyError(missing[0].id)
    return upsert(existing, incoming)


def delete(events: DataFrame, ids: DataFrame) -> DataFrame:
    """The events without those of ``ids`` (a column id); ids that don't exist are ignored."""
    return events.join(ids.select("id").distinct(), "id", "left_anti").select(*events.columns)


def _has(buckets: DataFrame, name: str) -> bool:
    return bool(buckets.where(F.col("bucket") == name).limit(1).count())


def bucket(buckets: DataFrame, name: str) -> DataFrame:
    """The row of a bucket in the catalog; KeyError if there is none."""
    if not _has(buckets, name):
        raise KeyError(name)
    return buckets.where(F.col("bucket") == name)


def names(buckets: DataFrame) -> DataFrame:
    """The names of all buckets, once each."""
    return buckets.select("bucket").distinct()


def create_bucket(buckets: DataFrame, name: str, kind: str, client: str, hostname: str, created: str | None = None, data: str = "{}") -> DataFrame:
    """The catalog (CATALOG_DDL) with a new bucket, created now unless a time is given; ValueError if its name is taken."""
    if _has(buckets, name):
        raise ValueError(f"bucket {name} exists")
    new = buckets.sparkSession.range(1).select(
        F.lit(name).alias("bucket"), F.lit(kind).alias("type"), F.lit(client).alias("client"), F.lit(hostname).alias("hostname"),
        (F.current_timestamp() if created is None else F.lit(created).cast("timestamp")).alias("created"), F.lit(data).alias("data"),
    )
    return buckets.unionByName(new)


def delete_bucket(buckets: DataFrame, events: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Catalog and events without a bucket; KeyError if there is none."""
    if not _has(buckets, name):
        raise KeyError(name)
    return buckets.where(F.col("bucket") != name), events.where(F.col("bucket") != name)


def rename(buckets: DataFrame, events: DataFrame, old: str, new: str) -> tuple[DataFrame, DataFrame]:
    """Catalog and events with a bucket under another name; KeyError if there is none, ValueError if the name is taken."""
    if not _has(buckets, old):
        raise KeyError(old)
    if _has(buckets, new):
        raise ValueError(f"bucket {new} exists")
    return rename_bucket(buckets, old, new), rename_bucket(events, old, new)


def migrate_prefix(buckets: DataFrame, old: str, new: str) -> DataFrame:
    """The catalog with ``new`` for the prefix ``old`` of names; a bucket whose new name is taken keeps its own."""
    moved = F.concat(F.lit(new), F.substring("bucket", len(old) + 1, 1 << 30))
    taken = buckets.select(F.col("bucket").alias("_taken"), F.lit(True).alias("_is"))
    out = buckets.withColumn("_to", F.when(F.col("bucket").startswith(old), moved))
    out = out.join(taken, F.col("_to") == F.col("_taken"), "left")
    return out.withColumn("bucket", F.when(F.col("_to").isNotNull() & F.col("_is").isNull(), F.col("_to")).otherwise(F.col("bucket"))).select(*buckets.columns)


def rename_bucket(df: DataFrame, old: str, new: str) -> DataFrame:
    """``df`` with another name for a bucket, unchecked; see ``rename``."""
    return df.withColumn("bucket", F.when(F.col("bucket") == old, new).otherwise(F.col("bucket")))


def migrate_hostname(buckets: DataFrame, new: str) -> DataFrame:
    """Buckets of host ``unknown`` get the new host; ``unknown_hosts`` says how many they are."""
    return buckets.withColumn("hostname", F.when(F.col("hostname").isin("unknown", "Unknown"), new).otherwise(F.col("hostname")))


def unknown_hosts(buckets: DataFrame) -> DataFrame:
    """``n``: how many buckets ``migrate_hostname`` changes."""
    return buckets.where(F.col("hostname").isin("unknown", "Unknown")).agg(F.count("*").alias("n"))


def _stored(spark: SparkSession, path: str, bucket: str):
    """The folder of a bucket in a table that ``write`` has written, and its file system."""
    escape = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/bucket={escape(bucket)}")
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def _shared(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a table's shared files."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{SHARED}")
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], SHARED_DDL)
    return spark.read.schema(SHARED_DDL).parquet(f"{path}/{SHARED}")


def _shares(spark: SparkSession, path: str, name: str) -> bool:
    return bool(_shared(spark, path).where(F.col("name") == name).limit(1).count())


def _rewrite(spark: SparkSession, path: str, moved: dict[str, str | None]) -> None:
    """Give buckets in shared files other names, or none: those rows go. The files that have them are written anew, then deleted; if it
    is stopped between, their rows stand twice and none is lost."""
    jvm, names = spark._jvm, F.broadcast(spark.createDataFrame(list(moved.items()), "_old string, _new string"))
    listed = _shared(spark, path).select("name", F.col("_metadata.file_path").alias("file"))
    files = [jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(r.file)) for r in listed.join(names, F.col("name") == F.col("_old"), "left_semi").select("file").distinct().collect()]  # a row a file
    rows = spark.read.schema(SHARED_DDL).parquet(*(f.toString() for f in files)).join(names, F.col("name") == F.col("_old"), "left")
    rows = rows.where("_old is null or _new is not null").withColumn("name", F.coalesce("_new", "name")).drop("_old", "_new")
    rows.repartition(len(files), "name").sortWithinPartitions("name", "start_ns").write.mode("append").parquet(f"{path}/{SHARED}")
    for f in files:
        f.getFileSystem(spark._jsc.hadoopConfiguration()).delete(f, False)


def delete_stored(spark: SparkSession, path: str, name: str) -> None:
    """Delete a bucket of a stored table; KeyError if there is none. Only files that have rows of it are touched."""
    (at, fs), shares = _stored(spark, path, name), _shares(spark, path, name)
    if not fs.exists(at) and not shares:
        raise KeyError(name)
    fs.delete(at, True)
    if shares:
        _rewrite(spark, path, {name: None})


def rename_stored(spark: SparkSession, path: str, old: str, new: str) -> None:
    """Give a bucket of a stored table another name, by its folder or in the files that it shares; KeyError if there is none,
    ValueError if the name is taken."""
    (a, fs), (b, _), shares = _stored(spark, path, old), _stored(spark, path, new), _shares(spark, path, old)
    if not fs.exists(a) and not shares:
        raise KeyError(old)
    if fs.exists(b) or _shares(spark, path, new):
        raise ValueError(f"bucket {new} exists")
    if fs.exists(a):
        fs.rename(a, b)
    if shares:
        _rewrite(spark, path, {old: new})


def migrate_stored(spark: SparkSession, path: str, old: str, new: str) -> int:
    """``new`` for the prefix ``old`` of the names of a stored table's buckets; one whose new name is taken keeps its own. Returns how many moved."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    unescape = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
    folders = [f.getPath().getName() for f in root.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(root)]
    folders = {unescape(f.removeprefix("bucket=")) for f in folders if f.startswith("bucket=") and f != SHARED}
    sharing = {r.name for r in _shared(spark, path).select("name").where(F.col("name").startswith(old) | F.col("name").startswith(new)).distinct().collect()}  # a row a bucket
    taken, moved = folders | sharing, {}
    for name in sorted(n for n in folders | sharing if n.startswith(old)):
        to = new + name[len(old) :]
        if to not in taken:
            taken.remove(name)
            taken.add(to)
            moved[name] = to
    for name in (n for n in moved if n in folders):
        (a, fs), (b, _) = _stored(spark, path, name), _stored(spark, path, moved[name])
        fs.rename(a, b)
    if some := {n: to for n, to in moved.items() if n in sharing}:
        _rewrite(spark, path, some)
    return len(moved)


def stamp(nanoseconds: Column) -> Column:
    """A time in nanoseconds as RFC 3339 text in UTC with nine digits."""
    whole = F.floor(nanoseconds / F.lit(1_000_000_000))
    rest = F.pmod(nanoseconds, F.lit(1_000_000_000))
    return F.concat(F.date_format(F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.timestamp_seconds(whole).cast("timestamp_ntz")), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("."), F.lpad(rest.cast("string"), 9, "0"), F.lit("Z"))


def from_stamp(text: Column) -> Column:
    """Nanoseconds of an RFC 3339 text; null if it is none."""
    fraction = F.rpad(F.substring(F.regexp_extract(text, "[.]([0-9]+)", 1), 1, 9), 9, "0")
    return F.unix_seconds(F.try_to_timestamp(F.regexp_replace(text, "[.][0-9]+", ""))) * 1_000_000_000 + fraction.cast("long")


def _event_json() -> Column:
    length = F.col("end_ns") - F.col("start_ns")
    seconds = F.concat(F.expr("(end_ns - start_ns) div 1000000000").cast("string"), F.lit("."), F.lpad((length % 1_000_000_000).cast("string"), 9, "0"))
    data = F.coalesce(F.to_json(F.try_parse_json("data")), F.lit("{}"))
    return F.concat(F.lit('{"id":'), F.coalesce(F.col("id").cast("string"), F.lit("null")), F.lit(',"timestamp":"'), stamp(F.col("start_ns")), F.lit('","duration":'), seconds, F.lit(',"data":'), data, F.lit("}"))


def export(events: DataFrame, buckets: DataFrame | None = None) -> DataFrame:
    """(bucket, event): each event as a JSON document, to be written as JSON lines a bucket; times to the nanosecond.

    Events of a bucket aren't gathered into one document, since a bucket may not fit in a task. With a
    catalog of ``buckets`` (CATALOG_DDL) a column ``meta`` has the bucket's own JSON document, and a
    bucket without events has one row without event. Data that aren't JSON are exported as {}.
    """
    out = events.select("bucket", _event_json().alias("event"))
    if buckets is None:
        return out
    meta = F.to_json(F.struct(F.col("bucket").alias("id"), "type", "client", "hostname", F.date_format("created", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("created"), F.try_parse_json("data").alias("data")))
    return buckets.select("bucket", meta.alias("meta")).join(out, "bucket", "left").select("bucket", "event", "meta")


def _bucket_json() -> Column:
    """A catalog row as the JSON object of a bucket, without its last brace."""
    meta = F.to_json(F.struct(F.col("bucket").alias("id"), "type", "client", "hostname", F.date_format("created", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("created"), F.try_parse_json("data").alias("data")))
    return F.regexp_replace(meta, "[}]$", "")


def write_documents(events: DataFrame, buckets: DataFrame, folder: str, parts: int | None = None) -> None:
    """Write each bucket's export document ``{"buckets": {name: bucket with events}}`` in parts, which ``join_document`` puts together.

    A head has the catalog row and the first event; the other events, in order of (start_ns, id), are spread over as many parts
    as there are ranges of them (``parts`` over all buckets, or as Spark chooses), each with the comma before it; so no task holds a bucket. A bucket without events has a head alone, and events
    of buckets that aren't in the catalog aren't written. The ``FOLDERS`` largest buckets and those of over ``SHARED_ROWS`` rows have
    folders; the documents of the others are put together here and share files. Documents are one line each.
    """
    rows = written(events.join(buckets.select("bucket"), "bucket", "left_semi").withColumn("_at", F.monotonically_increasing_id()))
    counts = written(rows.groupBy("bucket").agg(F.count("*").alias("n")))
    large = counts.orderBy(F.col("n").desc(), "bucket").limit(FOLDERS).unionByName(counts.where(F.col("n") > SHARED_ROWS)).select("bucket").distinct()
    large = F.broadcast(written(large))
    name = F.to_json(F.struct(F.array("bucket").alias("x")))
    opens = F.concat(F.lit('{"buckets":{'), F.regexp_extract(name, "^.*?\\[(.*)\\][}]$", 1), F.lit(":"), _bucket_json(), F.lit(',"events":['))
    own = rows.join(large, "bucket", "left_anti").groupBy("bucket").agg(F.sort_array(F.collect_list(F.struct("start_ns", "id", "_at", _event_json().alias("event")))).alias("e"))
    events_text = F.coalesce(F.array_join(F.transform("e", lambda x: x["event"]), ","), F.lit(""))
    whole = buckets.join(large, "bucket", "left_anti").join(own, "bucket", "left").select("bucket", F.concat(opens, events_text, F.lit("]}}}")).alias("value"))
    whole.write.parquet(f"{folder}/shared")
    rows = rows.join(large, "bucket", "left_semi")
    first = rows.groupBy("bucket").agg(F.min(F.struct("start_ns", "id", "_at"))["_at"].alias("_first"))
    firsts = rows.join(first.select("_first"), F.col("_at") == F.col("_first"), "left_semi").select("bucket", _event_json().alias("event"))
    heads = buckets.join(large, "bucket", "left_semi").join(firsts, "bucket", "left").select("bucket", F.concat(opens, F.coalesce("event", F.lit(""))).alias("value"))
    heads.write.option("lineSep", " ").partitionBy("bucket").text(f"{folder}/heads")
    rest = rows.join(first.select("_first"), F.col("_at") == F.col("_first"), "left_anti")
    ordered = rest.repartitionByRange(*([parts] if parts else []), "bucket", "start_ns", "id", "_at").sortWithinPartitions("bucket", "start_ns", "id", "_at")
    ordered.select("bucket", F.concat(F.lit(","), _event_json()).alias("value")).write.option("lineSep", " ").partitionBy("bucket").text(f"{folder}/parts")


def join_documents(spark: SparkSession, folder: str, names: DataFrame, target: str) -> None:
    """Put the documents of the buckets of ``names`` (a column bucket) in files under a new folder, one a line: those that share files all at
    once, many a file, and those in parts one after another in a file each. Names that aren't there are ignored."""
    spark.read.schema("bucket string, value string").parquet(f"{folder}/shared").join(names.select("bucket"), "bucket", "left_semi").select("value").write.text(target)
    unescape = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
    heads = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/heads")
    found = [f.getPath().getName() for f in heads.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(heads)]
    large = spark.createDataFrame([(unescape(f.removeprefix("bucket=")),) for f in found if f.startswith("bucket=")], "bucket string")
    for k, r in enumerate(large.join(names.select("bucket"), "bucket", "left_semi").collect()):  # a row a folder
        join_document(spark, folder, r.bucket, f"{target}/{k}.json")


def join_document(spark: SparkSession, folder: str, bucket: str, target: str) -> None:
    """Put the parts of a bucket's document together in one file, as a stream of bytes; KeyError if there is no such bucket."""
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    escape = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(bucket)
    fs = hadoop.Path(folder).getFileSystem(conf)
    files = []
    for kind in ("heads", "parts"):
        at = hadoop.Path(f"{folder}/{kind}/bucket={escape}")
        files += sorted(str(f.getPath()) for f in fs.listStatus(at) if f.getPath().getName().startswith("part-")) if fs.exists(at) else []
    small = [] if files else spark.read.schema("bucket string, value string").parquet(f"{folder}/shared").where(F.col("bucket") == bucket).collect()  # at most SHARED_ROWS events
    if not files and not small:
        raise KeyError(bucket)
    end = hadoop.Path(target)
    out = end.getFileSystem(conf).create(end, True)
    try:
        if small:
            out.write(bytearray(small[0].value.encode()))
        for f in files:
            source = fs.open(hadoop.Path(f))
            spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, 1 << 20, False)
            source.close()
        if files:
            out.write(bytearray(b"]}}}"))
    finally:
        out.close()


def read_export(lines: DataFrame, bucket: str = "bucket", event: str = "event", kept: str | None = None) -> DataFrame:
    """Events of JSON documents.

    Those that don't parse, or lack a time or an object as data, are dropped; with ``kept`` they stay, and the
    column of that name has their text, null for good ones, so that they can be counted. Durations are cut to nanoseconds.
    """
    kind = "id long, timestamp string, duration decimal(28,9), data variant"
    df = lines.select(F.col(bucket).alias("bucket"), F.col(event).alias("raw"), F.from_json(F.col(event), kind).alias("e"))
    at = from_stamp(F.col("e.timestamp"))
    df = df.select("bucket", "e.id", at.alias("start_ns"), (at + (F.coalesce("e.duration", F.lit(0)) * 1_000_000_000).cast("long")).alias("end_ns"), F.to_json("e.data").alias("data"), "raw")
    good = F.col("start_ns").isNotNull() & F.coalesce(F.startswith("data", F.lit("{")), F.lit(False))
    return df.where(good).drop("raw") if kept is None else df.withColumn(kept, F.when(~good, F.col("raw"))).drop("raw")


def read_document(documents: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """Catalog and events of whole export documents ``{"buckets": {name: bucket with events}}``, one a row of ``column``.

    A document is read in one task, so large tables should come as the lines of ``export``. Bad events are dropped
    one by one, as in ``read_export``.
    """
    kind = "buckets map<string, struct<id string, type string, client string, hostname string, created string, data variant, events array<variant>>>"
    each = documents.select(F.explode(F.from_json(F.col(column), kind)["buckets"]).alias("name", "b"))
    catalog = each.select(
        F.coalesce("b.id", "name").alias("bucket"), "b.type", "b.client", "b.hostname", F.try_to_timestamp("b.created").alias("created"), F.coalesce(F.to_json("b.data"), F.lit("{}")).alias("data")
    )
    lines = each.select(F.coalesce("b.id", "name").alias("bucket"), F.explode("b.events").alias("event"))
    return catalog, read_export(lines.select("bucket", F.to_json("event").alias("event")))


def check_rules(rules: list[dict]) -> None:
    """ValueError for a privacy rule without field or pattern, with a bad pattern or action, or an empty replacement."""
    for rule in rules:
        if not rule.get("field") or rule.get("action") not in ("drop", "redact") or rule.get("replacement") == "":
            raise ValueError(f"a rule needs a field, an action (drop or redact) and no empty replacement: {rule}")
        re.compile(rule["pattern"])


def _kept(field: str, pattern: str) -> Column:
    """Whether data are an object in whose field the pattern isn't found."""
    return payload.parsed_once(lambda v: payload.is_object(v) & ~F.coalesce(payload.text_at(v, field).rlike(pattern), F.lit(False)))


def redact(events: DataFrame, rules: list[dict]) -> DataFrame:
    """Privacy rules in turn: each has pattern, action (drop or redact) and field, a dotted path of keys, and may
    have bucket_prefix, replacement and enabled. It holds where the field is a string in which the pattern is found.

    A redacted field is set in the parsed object, and such events come out as canonical JSON; later rules see
    the new value. Data that don't parse as an object can't be searched: an event with such data is dropped
    where an enabled rule covers its bucket.
    """
    check_rules(rules)
    for rule in rules:
        if not rule.get("enabled", True):
            continue
        covered = F.col("bucket").startswith(rule.get("bucket_prefix") or "")
        if rule["action"] == "drop":
            events = events.where(F.coalesce(~covered | _kept(rule["field"], java(rule["pattern"])), F.lit(True)))
        else:
            events = events.where(F.coalesce(~covered | payload.parsed_once(payload.is_object), F.lit(True)))
            hit = covered & F.coalesce(payload.path_text(rule["field"]).rlike(java(rule["pattern"])), F.lit(False))
            new = payload.with_path(F.col("data"), rule["field"], rule.get("replacement") or "REDACTED")
            events = events.withColumn("data", F.when(hit, new).otherwise(F.col("data")))
    return events


def synced_buckets(buckets: DataFrame, device: str, only: list[str] | None = None) -> DataFrame:
    """The catalog rows that a pull adds: buckets of ``only`` (all if none or ``*``), ``source`` being the name they had.

    A bucket of host ``unknown`` is the device's. The new name is ``<name>-synced-from-<origin>``, where origin is
    what its data says it was synced from, or else its host, which the data then says.
    """
    df = buckets if not only or "*" in only else buckets.where(F.col("bucket").isin(list(only)))
    df = df.withColumn("hostname", F.when(F.col("hostname") == "unknown", device).otherwise(F.col("hostname"))).withColumn("source", F.col("bucket"))
    said = F.try_variant_get(F.try_parse_json("data"), f"$['{ORIGIN}']", "string")
    entries = F.map_filter(F.coalesce(F.from_json("data", "map<string,variant>"), F.from_json(F.lit("{}"), "map<string,variant>")), lambda k, v: k != ORIGIN)
    data = payload.canonical(F.to_json(F.map_concat(entries, F.create_map(F.lit(ORIGIN), F.col("hostname").cast("variant")))))
    first = F.split("bucket", "-synced-from-", 2)[0]
    return df.withColumn("bucket", F.concat(first, F.lit("-synced-from-"), F.coalesce(said, "hostname"))).withColumn("data", data)


def remotes(spark: SparkSession, folder: str, own: str) -> list[str]:
    """The tables of other devices under ``folder``, laid out as <folder>/device=<id>/...; ids in order."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(folder).select("path")
    device = F.regexp_extract("path", "/device=([^/]+)/", 1)
    return [r.device for r in listed.select(device.alias("device")).where((F.col("device") != "") & (F.col("device") != own)).distinct().orderBy("device").collect()]  # a row a device


def largest_tables(spark: SparkSession, folder: str) -> DataFrame:
    """(host, table, bytes): of the tables under ``folder``, laid out as <folder>/<host>/<table>/..., the largest of each host, the first by name of equals."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(folder).select("path", "length")
    # The path below the folder, whatever scheme Spark puts before it.
    below = F.split(F.substring_index("path", f"{folder.rstrip('/').split(':')[-1].lstrip('/')}/", -1), "/")
    sized = listed.where(F.size(below) > 2).groupBy(below[0].alias("host"), below[1].alias("table")).agg(F.sum("length").alias("bytes"))
    best = sized.groupBy("host").agg(F.min(F.struct((-F.col("bytes")).alias("order"), "table")).alias("b"))
    return best.select("host", "b.table", (-F.col("b.order")).alias("bytes"))


def sync(source: DataFrame, dest: DataFrame, origin: str, since: int = 0) -> DataFrame:
    """The events to append to ``dest``, named ``<bucket>-synced-from-<origin>``, without ids.

    Each bucket resumes at the end of the event of ``dest`` that starts last (``since`` if it has none): events that end
    there or later are sent, cut at that time. Where the oldest of them is no more than the rest of that
    event (equal data, no length left) it is not sent again; with some length left it continues
    the event, see ``compact_synced``.
    """
    named = source.withColumn("bucket", F.concat("bucket", F.lit(f"-synced-from-{origin}")))
    newest = dest.groupBy(F.col("bucket").alias("_of")).agg(F.max(F.struct("start_ns", "id", "end_ns", "data")).alias("_last"))
    df = named.join(newest, F.col("bucket") == F.col("_of"), "left").withColumn("_resume", F.coalesce("_last.end_ns", F.lit(since)))
    df = df.where(F.col("end_ns") >= F.col("_resume"))
    oldest = df.groupBy(F.col("bucket").alias("_b")).agg(F.min(F.struct("start_ns", "end_ns", "data")).alias("_oldest"))
    df = df.join(oldest, F.col("bucket") == F.col("_b"))
    again = (F.struct("start_ns", "end_ns", "data") == F.col("_oldest")) & (F.col("end_ns") == F.col("_resume")) & (payload.canonical() == payload.canonical(F.col("_last.data")))
    df = df.where(~F.coalesce(again, F.lit(False))).withColumn("start_ns", F.greatest("start_ns", "_resume"))
    return df.select("bucket", F.lit(None).cast("long").alias("id"), "start_ns", "end_ns", "data")


def compact_synced(dest: DataFrame) -> DataFrame:
    """Join events that a sync cut in two: equal data, no gap."""
    return heartbeat_merge(dest, 0)


def with_ids(events: DataFrame, above: int = 0) -> DataFrame:
    """Consecutive ids above a number, in order of bucket, start, end and data, for a table of new events.

    Rows are sorted by ranges and numbered within each, and a range begins after the rows of those before it (a count a
    range); no bucket is gathered. The events are written when this is called.
    """
    order = ("bucket", "start_ns", "end_ns", "data")
    place = F.monotonically_increasing_id()
    rows = written(events.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", place))
    part, nth = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    counts = {r.part: r.n for r in rows.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}  # a row a range
    base, total = [], above + 1
    for k in sorted(counts):
        base.append((k, total))
        total += counts[k]
    bases = rows.sparkSession.createDataFrame(base, "_part long, _base long")
    return rows.join(F.broadcast(bases), part == F.col("_part")).withColumn("id", F.col("_base") + nth).select(*events.columns)
