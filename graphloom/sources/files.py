"""Readers of record files, dictionaries, dumps and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Line-delimited records with a declared schema; a malformed line fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A file that is one JSON array of records."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def run_records(spark: SparkSession, path: str) -> DataFrame | None:
    """Ragged run records with the union of their fields; None where there is no file yet."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return None
    return spark.read.json(path)


def numbered_lines(spark: SparkSession, path: str, needed: DataFrame | None = None) -> DataFrame:
    """(id, value): the line number of one file is its id. With needed (id), only those lines; a missing id >= 0 is an error.

    Splits of the file are counted, and a line's number is its place within its split plus the lines of the splits before."""
    from pyspark.sql.window import Window

    from graphloom.storage import materialize

    rows = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"))
    rows = materialize(rows, "lines")
    sizes = rows.groupBy("block").agg(F.count(F.lit(1)).alias("n"))
    # a row for each split
    before = sizes.select("block", (F.sum("n").over(Window.orderBy("block")) - F.col("n")).alias("before"))
    within = F.row_number().over(Window.partitionBy("block").orderBy("place")) - 1
    lines = rows.withColumn("within", within).join(F.broadcast(before), "block").select((F.col("before") + F.col("within")).cast("long").alias("id"), "value")
    if needed is None:
        return lines
    wanted = needed.where("id >= 0").select("id").distinct().join(lines, "id", "left")
    missing = F.raise_error(F.concat(F.lit("no line "), F.col("id").cast("string"))).cast("string")
    return wanted.select("id", F.coalesce("value", missing).alias("value"))


def name_dump(spark: SparkSession, path: str, predicate: str = "fb:type.object.name", prefix: str = "fb:") -> DataFrame:
    """(mid, name) of tab-separated statements '<prefix mid> predicate "name"'; compressed files are read by their suffix."""
    pattern = rf'^<{prefix}([^>]+)>\t<{predicate}>\t"([^"]*)"'
    lines = spark.read.text(path).where(F.col("value").rlike(pattern))
    return lines.select(F.regexp_extract("value", pattern, 1).alias("mid"), F.regexp_extract("value", pattern, 2).alias("name"))


def dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) of a JSON file that is one object of strings."""
    whole = spark.read.option("wholetext", True).text(path)
    return whole.select(F.explode(F.from_json("value", "map<string,string>")).alias("key", "value"))


def progress_samples(lines: DataFrame) -> DataFrame:
    """(run, total, step, elapsed) from progress bars 'step/total [h:mm:ss<' in rows (run, value): of each run the most frequent
    total (smallest on ties), and the first sighting of each step."""
    pattern = F.lit(r"(\d+)/(\d+) \[((?:\d+:)?\d+:\d+)<")
    part = lambda i: F.regexp_extract_all("value", pattern, F.lit(i))
    bars = lines.select("run", F.explode(F.arrays_zip(part(1).alias("s"), part(2).alias("t"), part(3).alias("c"))).alias("b"))
    clock = F.split("b.c", ":")
    seconds = F.aggregate(clock, F.lit(0).cast("long"), lambda a, x: a * 60 + x.cast("long"))
    bars = bars.select("run", F.col("b.s").cast("long").alias("step"), F.col("b.t").cast("long").alias("total"), seconds.alias("elapsed"))
    main = bars.groupBy("run", "total").agg(F.count(F.lit(1)).alias("n")).groupBy("run").agg(F.max_by("total", F.struct("n", -F.col("total"))).alias("total"))
    return bars.join(main, ["run", "total"]).groupBy("run", "total", "step").agg(F.min("elapsed").alias("elapsed"))


def tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("sep", "\t").csv(path)


def corpus_tokens(lines: DataFrame, limit: int, banned: str = "access code") -> DataFrame:
    """(line, token) of the first lines (line, value) that together hold at most limit words; blank lines, headings ('= ... =')
    and lines with the banned string do not count. Running sums come from sums of ranges of lines."""
    from graphloom.operators.positions import running_sum

    text = F.trim("value")
    good = lines.where((text != "") & ~text.rlike("^=.*=$") & ~F.contains(F.lower("value"), F.lit(banned)))
    words = running_sum(good.select("line", F.split(text, r"\s+").alias("w")), ["line"], F.size("w"), "upto")
    return words.where(F.col("upto") <= limit).select("line", F.explode("w").alias("token"))
