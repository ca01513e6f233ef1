"""Readers and writers of plant logs: data loggers, power logs of two layouts, clear-sky exports, weather files, tables."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Places (from 1) of the power and state columns of the two layouts of a power log, and the width that tells them.
WIDE, WIDE_POWER, WIDE_STATE = 111, (4, 30, 56, 82), (26, 52, 78, 104)
NARROW_POWER, NARROW_STATE = (2, 12, 22, 32), (5, 15, 25, 35)


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir); where none is set, a temporary one if
    Spark is one local process, else ValueError."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = f"file://{tempfile.mkdtemp(prefix='shared-')}"
        spark.conf.set("spark.checkpoint.dir", shared)
    return f"{shared}/{tag}-{uuid.uuid4().hex}"


def kept(df: DataFrame, tag: str) -> DataFrame:
    """df as a table in the shared folder, so that what follows doesn't make it again."""
    path = scratch(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def config(spark: SparkSession, path: str, row: str) -> DataFrame:
    """The elements named row of XML files, attributes as columns _name and children as columns."""
    return spark.read.format("xml").option("rowTag", row).load(path)


def to_blob(values: Column) -> Column:
    """An array of numbers as binary; null: null."""
    return F.to_binary(F.to_json(F.transform(values, lambda x: x.cast("string"))), F.lit("utf-8"))


def from_blob(blob: Column) -> Column:
    """The array of doubles that to_blob wrote."""
    return F.transform(F.from_json(F.decode(blob, "utf-8"), "array<string>"), lambda x: x.cast("double"))


def bytes_of(blob: Column) -> Column:
    """The bytes of a binary column as numbers 0..255."""
    digits = F.hex(blob)
    return F.when(F.length(blob) == 0, F.array().cast("array<int>")).otherwise(F.transform(F.sequence(F.lit(0), F.length(blob) - 1), lambda i: F.conv(F.substring(digits, 2 * i + 1, F.lit(2)), 16, 10).cast("int")))


def days(df: DataFrame, first: str | None = None, last: str | None = None, skip: tuple[str, ...] = (), day: str = "day") -> DataFrame:
    """Rows of the days from first to last, without the skipped: a filter on the partition column, so folders are pruned."""
    if first:
        df = df.where(F.col(day) >= first)
    if last:
        df = df.where(F.col(day) <= last)
    return df.where(~F.col(day).isin(*skip)) if skip else df


def image_files(spark: SparkSession, path: str, first_hour: int, last_hour: int, lead: int = 0) -> DataFrame:
    """path, ts, length of images named ..yyyy_mm_dd_hh_mm_ss.. within [first_hour, last_hour), and lead minutes before."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    part = lambda i: F.regexp_extract("path", r"(\d{4})_(\d\d)_(\d\d)_(\d\d)_(\d\d)_(\d\d)[^/]*$", i)
    f = f.where(part(1) != "").withColumn("ts", F.to_timestamp_ntz(F.concat_ws(" ", F.concat_ws("-", part(1), part(2), part(3)), F.concat_ws(":", part(4), part(5), part(6)))))
    h, m = F.hour("ts"), F.minute("ts")
    return f.where((h < last_hour) & ((h >= first_hour) | ((h == first_hour - 1) & (m >= 60 - lead))))


def listed(spark: SparkSession, path: str, kept: str, first_hour: int = 0, last_hour: int = 24) -> DataFrame:
    """image_files of a folder as a table kept at a shared path: listed once, then read from there."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{kept}/_SUCCESS")
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        image_files(spark, path, first_hour, last_hour).write.mode("overwrite").parquet(kept)
    return spark.read.parquet(kept)


def pixels(spark: SparkSession, path: str) -> DataFrame:
    """origin, x, y (from 0, downwards), red, green, blue of image files, grey ones with three equal values; files that are no
    images are left out. A read that fails is tried again with its task."""
    i = spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", "true").load(path).select("image.*")
    at = lambda k: F.conv(F.hex(F.substring("data", F.lit(1) + F.col("_i") * F.col("nChannels") + F.least(F.lit(k), F.col("nChannels") - 1), F.lit(1))), 16, 10).cast("int")
    i = i.withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("width") * F.col("height") - 1)))
    return i.select("origin", (F.col("_i") % F.col("width")).alias("x"), F.floor(F.col("_i") / F.col("width")).cast("int").alias("y"), at(2).alias("red"), at(1).alias("green"), at(0).alias("blue"))


def write_pixmaps(field: DataFrame, name: str, path: str) -> None:
    """Images as text pixmaps (P3), one in each folder name=...; field: (name, x, y, red, green, blue), x and y from 0."""
    row = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y", "x", "red", "green", "blue"))), lambda p: F.concat_ws(" ", p["red"], p["green"], p["blue"])), "\n")
    head = F.concat_ws("\n", F.lit("P3"), F.concat_ws(" ", F.max("x") + 1, F.max("y") + 1), F.lit("255"), row)
    field.groupBy(name).agg(head.alias("value")).write.partitionBy(name).text(path)


def write_files(df: DataFrame, path: str) -> None:
    """The rows of df (name, content) as files of a folder that driver and executors share as a file system; each is written
    beside its place and then moved there, so that a task that runs again leaves the same."""
    folder = re.sub("^file:(//)?", "", path)
    if re.match(r"\w+:", folder):
        raise ValueError("binary files are written to a shared file system")

    def run(parts):
        import os

        os.makedirs(folder, exist_ok=True)
        for p in parts:
            for name, content in zip(p["name"], p["content"], strict=True):
                own = f"{folder}/.{uuid.uuid4().hex}"
                with open(own, "wb") as f:
                    f.write(content)
                os.replace(own, f"{folder}/{name}")
            yield p[["name"]]

    df.select("name", "content").mapInPandas(run, "name string").write.format("noop").mode("overwrite").save()


def pixmaps(spark: SparkSession, path: str) -> DataFrame:
    """path, x, y (from 0, downwards), red, green, blue of text pixmaps (P3) of any folder below path; comments are skipped, and
    files that are no such images left out. A read that fails is tried again with its task."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.decode("content", "UTF-8").alias("_t"))
    d = d.where(F.col("_t").rlike("^P3[\\s#]")).select("path", F.split(F.trim(F.regexp_replace("_t", "#[^\n]*", "")), "\\s+").alias("_c"))
    cell = lambda i: F.try_element_at("_c", i).try_cast("int")
    width, height = cell(F.lit(2)), cell(F.lit(3))
    d = d.select("path", "_c", width.alias("_w"), F.explode(F.sequence(F.lit(0), width * height - 1)).alias("_i"))
    at = lambda k: cell(F.col("_i") * 3 + 5 + k)
    return d.select("path", (F.col("_i") % F.col("_w")).cast("long").alias("x"), F.floor(F.col("_i") / F.col("_w")).alias("y"), at(0).alias("red"), at(1).alias("green"), at(2).alias("blue"))


def logger(spark: SparkSession, path: str) -> DataFrame:
    """ts, irr1, irr2, temp1, temp2 of space-separated logger files; lines that don't parse have a null ts and are dropped."""
    schema = "date string, time string, c3 double, c4 double, irr1 double, irr2 double, temp1 double, temp2 double"
    d = spark.read.csv(path, sep=" ", schema=schema, mode="PERMISSIVE")
    return d.select(F.try_to_timestamp(F.concat_ws(" ", "date", "time")).cast("timestamp_ntz").alias("ts"), "irr1", "irr2", "temp1", "temp2").where("ts is not null")


def power(spark: SparkSession, path: str) -> DataFrame:
    """seconds, p_total, p1..p4, all_running of tab-separated power logs; each line's width tells its layout."""
    c = F.split("value", "\t")
    cell = lambda i: F.try_element_at(c, F.lit(i)).try_cast("double")
    pick = lambda w, n: F.when(F.size(c) >= WIDE, cell(w)).otherwise(cell(n))
    p = {f"p{i + 1}": pick(w, n) for i, (w, n) in enumerate(zip(WIDE_POWER, NARROW_POWER, strict=True))}
    running = F.lit(True)
    for w, n in zip(WIDE_STATE, NARROW_STATE, strict=True):
        running = running & F.coalesce(pick(w, n) == 4, F.lit(False))
    d = spark.read.text(path).select(cell(1).alias("seconds"), *[x.alias(k) for k, x in p.items()], running.alias("all_running")).where("seconds is not null")
    return d.select("seconds", sum((F.col(k) for k in p), F.lit(0.0)).alias("p_total"), *p, "all_running")


def clear_sky(spark: SparkSession, path: str, places: tuple[int, int, int] = (6, 7, 8), more: dict[str, int] | None = None) -> DataFrame:
    """start, end, ghi, dni, dhi of a semicolon-separated clear-sky export of one-minute energies (Wh/m2 -> W/m2 by 60).

    places: those of the three energies, from 1; more: further cells by name, as text, such as those of the long layout.
    """
    c = F.split("value", ";")
    cell = lambda i: F.try_element_at(c, F.lit(i)).try_cast("double")
    when = lambda i: F.try_to_timestamp(F.split(F.element_at(c, 1), "/")[i]).cast("timestamp_ntz")
    lines = spark.read.text(path).where(~F.col("value").startswith("#") & (F.col("value") != ""))
    return lines.select(when(0).alias("start"), F.try_element_at(F.split(F.element_at(c, 1), "/"), F.lit(2)).alias("end"), *[(60 * cell(i)).alias(k) for k, i in zip(("ghi", "dni", "dhi"), places, strict=True)], *[F.try_element_at(c, F.lit(i)).alias(k) for k, i in (more or {}).items()])


def weather(spark: SparkSession, path: str, columns: list[str], sentinel: float = -999.0) -> DataFrame:
    """A weather file without header under the given names; cells equal to the sentinel are null."""
    d = spark.read.csv(path, schema=", ".join(f"`{c}` string" for c in columns))
    return d.select(*[F.when(F.coalesce(F.col(c).try_cast("double") == sentinel, F.lit(False)), None).otherwise(F.col(c)).alias(c) for c in columns])


def numbers(spark: SparkSession, path: str, n: int, separators: str = ",;\t", quote: str = '"') -> DataFrame:
    """c1..cn, t1..tn: each cell as a number (null where it isn't one or is missing) and as text; any of the separators parts
    cells. A quoted cell may hold separators, and its quote doubled."""
    cells = F.regexp_extract_all(F.concat(F.lit(separators[0]), "value"), F.lit(f"[{separators}]( *{quote}(?:[^{quote}]|{quote}{quote})*{quote} *|[^{separators}]*)"), F.lit(1))
    text = []
    for i in range(n):
        c = F.trim(F.try_element_at(cells, F.lit(i + 1)))
        quoted = c.startswith(quote) & c.endswith(quote) & (F.length(c) > 1)
        text.append(F.when(quoted, F.replace(F.substring(c, F.lit(2), F.length(c) - 2), F.lit(quote * 2), F.lit(quote))).otherwise(c))
    return spark.read.text(path).select(*[t.try_cast("double").alias(f"c{i + 1}") for i, t in enumerate(text)], *[t.alias(f"t{i + 1}") for i, t in enumerate(text)])


def fixed_width(spark: SparkSession, path: str, fields: dict[str, tuple[int, int]], skip: str | None = None) -> DataFrame:
    """Numbers at (first place from 1, length) of each line, as of typical-year weather files; lines that match skip are left out."""
    d = spark.read.text(path)
    d = d.where(~F.col("value").rlike(skip)) if skip else d
    return d.select(*[F.trim(F.substring("value", a, n)).try_cast("double").alias(k) for k, (a, n) in fields.items()])


def parameters(spark: SparkSession, path: str, header_lines: int = 1) -> DataFrame:
    """A module or inverter parameter library: CSV with a header; numbers where every cell of a column is one."""
    return spark.read.csv(path, header=True, inferSchema=True) if header_lines == 1 else spark.read.csv(path, header=True, inferSchema=True, comment="#")


def jdbc(spark: SparkSession, url: str, query: str, partition: tuple[str, int, int, int] | None = None, **options) -> DataFrame:
    """A database query; partition (column, low, high, n) reads it in n ranges at once."""
    r = spark.read.format("jdbc").options(url=url, **options)
    if partition:
        c, low, high, n = partition
        return r.options(dbtable=f"({query}) q", partitionColumn=c, lowerBound=low, upperBound=high, numPartitions=n).load()
    return r.option("query", query).load()


def sql(spark: SparkSession, query: str, **values) -> DataFrame:
    """A parametrised query: named markers (:name) are bound, never pasted."""
    return spark.sql(query, args=values)


def changed(old: DataFrame, new: DataFrame, key: list[str], gone: DataFrame | None = None) -> DataFrame:
    """old with the rows of new in place of those of equal key, or added, and without the keys of gone: rows inserted,
    updated and deleted as one table, to be written as a new one. Keys are unique in new; a null key equals a null key."""

    def without(df: DataFrame, keys: DataFrame) -> DataFrame:
        same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in key]
        return df.alias("a").join(keys.select(*key).alias("b"), same, "left_anti")

    out = without(old, new).unionByName(new.select(*old.columns))
    return out if gone is None else without(out, gone)


# ---- sinks ----------------------------------------------------------------------------------------


def write_batches(df: DataFrame, path: str, rows: int = 2000) -> None:
    df.write.option("maxRecordsPerFile", rows).mode("overwrite").parquet(path)


def _cell(name: str, kind: str, digits: int | None, nan: Column | None) -> Column:
    c = F.col(name)
    if kind in ("double", "float"):
        c = F.when(~F.isnan(c), c) if nan is None else F.coalesce(F.when(~F.isnan(c), c), nan)
        return F.format_string(f"%.{digits}f", c) if digits is not None and nan is not None else F.when(c.isNotNull(), F.format_string(f"%.{digits}f", c)) if digits is not None else c.cast("string")
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss") if kind.startswith("timestamp") else c.cast("string")


def write_tsv(df: DataFrame, path: str, digits: int | None = 4, nan_as_zero: bool = False) -> None:
    """Tab-separated text: times to the second, numbers with digits decimals; missing numbers are empty, or 0 if asked."""
    cells = [_cell(c, kind, digits, F.lit(0.0) if nan_as_zero else None).alias(c) for c, kind in df.dtypes]
    df.select(*cells).write.mode("overwrite").csv(path, sep="\t", nullValue="", emptyValue="")


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "append", writers: int | None = None, **options) -> None:
    """df into a database's table; at most writers connections at once."""
    (df if writers is None else df.coalesce(writers)).write.format("jdbc").options(url=url, dbtable=table, **options).mode(mode).save()


def restamped(df: DataFrame, column: str) -> DataFrame:
    """df with an ISO interval 'start/end' as two columns of dd-MM-yyyy HH:mm:ss."""
    at = lambda i: F.date_format(F.try_to_timestamp(F.split(column, "/")[i]), "dd-MM-yyyy HH:mm:ss")
    return df.withColumn(f"{column}_start", at(0)).withColumn(f"{column}_end", at(1)).drop(column)


def write_libsvm(df: DataFrame, path: str, label: str, features: list[str]) -> None:
    """label index:value ... lines; nulls are left out."""
    cells = F.array(*[F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{i + 1}:"), F.col(c).cast("string"))) for i, c in enumerate(features)])
    df.select(F.concat_ws(" ", F.col(label).cast("string"), F.array_join(cells, " ")).alias("value")).write.mode("overwrite").text(path)
