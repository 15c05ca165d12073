"""Sinks (K*): envelopes, reports, names, partitioned files. Texts are single-column tables, written by Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def envelope(rows: DataFrame, by: str, metadata: dict[str, Column], most: int = 20_000) -> DataFrame:
    """JSON documents of metadata and results, one per key or, of many rows, several: a document holds at most `most`
    results of one stretch of the table, and each says the whole key's total. So no row is as large as a run."""
    fields = [F.col(f"`{c}`") for c in rows.columns]
    packed = rows.select(F.struct(*fields).alias("row_"), F.floor(F.monotonically_increasing_id() / most).alias("part_"))
    packed = packed.groupBy(F.col("row_")[by].alias(by), "part_").agg(F.collect_list("row_").alias("results"))
    total = rows.groupBy(F.col(by).alias("key_")).agg(F.count("*").alias("total"))
    packed = packed.join(total, F.col(by).eqNullSafe(F.col("key_")))
    meta = F.struct(F.col(by), F.col("total"), *(c.alias(k) for k, c in metadata.items())).alias("metadata")
    return packed.select(by, F.to_json(F.struct(meta, "results")).alias("json"))


def write_partitioned(df: DataFrame, path: str, by: Column, name: str = "p") -> None:
    """Rows in folders by prefix, topic or bucket."""
    df.withColumn(name, by).write.mode("append").partitionBy(name).parquet(path)


def bucket(key: Column, buckets: int) -> Column:
    """A repeatable folder from 1 to `buckets`."""
    return (F.pmod(F.xxhash64(key), F.lit(buckets)) + 1).cast("int")


def conflict_names(df: DataFrame, name: str, order: str) -> DataFrame:
    """A name's second and later rows get _1, _2, ..."""
    k = F.row_number().over(Window.partitionBy(name).orderBy(order))
    return df.withColumn("k_", k).withColumn("name", F.when(F.col("k_") > 1, F.concat(F.col(name), F.lit("_"), (F.col("k_") - 1).cast("string"))).otherwise(F.col(name))).drop("k_")


def stream_file(question: Column, number: Column, body: Column) -> tuple[Column, Column]:
    """File name and text of a stream of thought."""
    from scholia.functions.text import slug

    name = F.concat(F.lpad(number.cast("string"), 3, "0"), F.lit("_"), slug(question, F.concat(F.lit("question_"), number.cast("string"))))
    text = F.concat(F.lit("=" * 80 + "\n"), F.lit("QUESTION "), number.cast("string"), F.lit(":\n"), question, F.lit("\n\nSTREAM OF THOUGHT:\n" + "-" * 40 + "\n"), body, F.lit("\n" + "=" * 80 + "\n"))
    return name, text


def sections(df: DataFrame, base: str, kinds: dict[str, Column]) -> DataFrame:
    """One row per section of a result that is there: base, kind, text."""
    parts = F.array(*(F.struct(F.lit(k).alias("kind"), c.alias("text")) for k, c in kinds.items()))
    return df.select(base, F.explode(parts).alias("s")).select(base, "s.kind", "s.text").where("text is not null and text <> ''")


def markdown(title: Column, pairs: dict[str, Column], references: Column | None = None, shown: int = 10) -> Column:
    """Headings and texts; the first references and how many more there are."""
    out = [F.concat(F.lit("# "), title)]
    out += [F.when(c.isNotNull(), F.concat(F.lit(f"## {k}\n\n"), c)) for k, c in pairs.items()]
    if references is not None:
        more = F.size(references) - shown
        out.append(F.concat(F.lit("## References\n\n"), F.array_join(F.transform(F.slice(references, 1, shown), lambda r: F.concat(F.lit("- "), r)), "\n"), F.when(more > 0, F.concat(F.lit("\n- … and "), more.cast("string"), F.lit(" more"))).otherwise("")))
    return F.concat_ws("\n\n", *out)


def html_card(question: Column, answer: Column) -> Column:
    """A card with escaped texts."""

    def esc(c: Column) -> Column:
        for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
            c = F.replace(c, F.lit(a), F.lit(b))
        return c

    return F.concat(F.lit('<div class="card"><h2>'), esc(question), F.lit("</h2><p>"), esc(answer), F.lit("</p></div>"))


def report(title: str, table: DataFrame, order: list[str]) -> DataFrame:
    """A report's lines in order: heading, then one line per row of a small rollup."""
    line = F.concat_ws("  ", *(F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit("-"))) for c in table.columns))
    head = table.sparkSession.range(1).select(F.lit(0).alias("k"), F.lit(title).alias("value"))
    body = table.select((F.row_number().over(Window.orderBy(*order))).alias("k"), line.alias("value"))
    return head.union(body).orderBy("k").select("value")


def abstract_text(title: Column, year: Column, paper: Column, abstract: Column) -> Column:
    """K28."""
    return F.concat_ws("\n", F.concat(F.lit("Title: "), title), F.concat(F.lit("Year: "), year.cast("string")), F.concat(F.lit("Paper ID: "), paper), F.concat(F.lit("\nAbstract: "), abstract))


def header_inserted(text: Column, line: Column) -> Column:
    """A line after the leading lines that begin with #."""
    lines = F.split(text, "\n")
    n = F.aggregate(lines, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda a, x: F.struct(F.when(a["on"] & x.startswith("#"), a["n"] + 1).otherwise(a["n"]).alias("n"), (a["on"] & x.startswith("#")).alias("on")), lambda a: a["n"])
    return F.array_join(F.concat(F.slice(lines, F.lit(1), n), F.array(line), F.slice(lines, n + 1, F.greatest(F.size(lines) - n, F.lit(0)))), "\n")


def append_items(df: DataFrame, path: str) -> None:
    """Finished items are appended as JSON lines; nothing is read back to write them."""
    df.write.mode("append").json(path)


def json_array(spark, path: str, schema: str) -> DataFrame:
    """All items appended so far, from which one export is made at the end."""
    return spark.read.schema(schema).json(path)


def error_lines(errors: DataFrame) -> DataFrame:
    """Lines ``[time] category: message`` of errors (at, category, message), in order."""
    return errors.orderBy("at", "category", "message").select(F.concat(F.lit("["), F.date_format("at", "yyyy-MM-dd HH:mm:ss"), F.lit("] "), "category", F.lit(": "), "message").alias("value"))


def plot_table(df: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """The bars of a plot: bin, its edges and count; the last bin holds the upper edge."""
    width = (high - low) / bins
    k = F.least(F.floor((F.col(value) - low) / width), F.lit(bins - 1)).cast("int")
    got = df.where(F.col(value).between(low, high)).groupBy(k.alias("bin")).agg(F.count("*").alias("n"))
    return got.select("bin", (low + F.col("bin") * width).alias("left"), (low + (F.col("bin") + 1) * width).alias("right"), "n")
