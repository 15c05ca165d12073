"""Text reports as tables of lines (K17-K19, K21): section, i, j, value; in that order they are the text.

Every section is a rollup or a list of the rows themselves, so a report over any number of rows is made by tasks; what is
written last is ordered by ranges (``written_report``). Nothing is assembled on the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholia.operators.positional import numbered

# The rules under titles and headings.
TITLE_RULE, RULE = "=" * 80, "-" * 40
#: Examples shown of a list.
SHOWN = 10


def _number(c: Column) -> Column:
    return c.cast("string")


def _share(n: Column, total: Column, places: int = 1) -> Column:
    """A percentage as text; 0 of nothing."""
    return F.concat(F.format_string(f"%.{places}f", F.when(total == 0, 0.0).otherwise(n * 100.0 / total).cast("double")), F.lit("%"))


def _lines(section: int, row: DataFrame, *values: Column | str) -> DataFrame:
    """Lines made of one row of figures."""
    told = F.array(*(F.lit(v) if isinstance(v, str) else v for v in values))
    return row.select(F.lit(section).alias("section"), F.posexplode(told).alias("j", "value")).select("section", F.col("j").cast("long").alias("i"), F.lit(0).alias("j"), "value")


def _entries(section: int, rows: DataFrame, i: Column, *values: Column) -> DataFrame:
    """Lines of each row, rows in order of i (from 0)."""
    return rows.select(F.lit(section).alias("section"), (i.cast("long") + 1000).alias("i"), F.posexplode(F.array(*values)).alias("j", "value")).where("value is not null")


def _counted(section: int, rows: DataFrame, by: str, total: DataFrame | None, indent: str = "") -> DataFrame:
    """``name: n`` of each value, most frequent first (ties: by name), with the share if a total (one row, n_total) is given."""
    counts = rows.where(F.col(by).isNotNull()).groupBy(F.col(by).alias("name")).agg(F.count("*").alias("n"))
    ranked = numbered(counts.withColumn("place", F.struct((-F.col("n")).alias("n"), "name")), "place")
    told = F.concat(F.lit(indent), "name", F.lit(": "), _number(F.col("n")))
    if total is not None:
        ranked = ranked.join(F.broadcast(total))  # one row
        told = F.concat(told, F.lit(" ("), _share(F.col("n"), F.col("n_total")), F.lit(")"))
    return _entries(section, ranked, F.col("i"), told)


def error_report(errors: DataFrame) -> DataFrame:
    """Errors (base_name, reason, correct, one, two): which of two methods failed, question by question."""
    rows = errors.withColumns({"m1": F.col("reason").contains("method1"), "m2": F.col("reason").contains("method2")})
    n = rows.agg(F.count("*").alias("n"), F.count_if("m1").alias("n1"), F.count_if("m2").alias("n2"), F.count_if(F.col("m1") & F.col("m2")).alias("both"))
    c = {k: F.col(k) for k in ("n", "n1", "n2", "both")}
    line = lambda name, x: F.concat(F.lit(f"{name}: "), _number(x))
    out = [
        _lines(0, n, "INCORRECT ANSWERS ANALYSIS REPORT", TITLE_RULE, "", "SUMMARY STATISTICS:", RULE, line("Total Questions with Errors", c["n"]), line("Method 1 Errors", c["n1"]), line("Method 2 Errors", c["n2"]), line("Both Methods Error", c["both"]), line("Method 1 Only Errors", c["n1"] - c["both"]), line("Method 2 Only Errors", c["n2"] - c["both"]), ""),
        _lines(1, n, "ERROR BREAKDOWN BY QUESTION:", RULE),
        _lines(2, n, "ERROR PATTERNS:", RULE),
    ]
    told = numbered(rows, "base_name")
    own = [F.concat(F.lpad(_number(F.col("i") + 1), F.greatest(F.lit(3), F.length(_number(F.col("i") + 1))), F.lit(" ")), F.lit(". "), "base_name"), F.concat(F.lit("     Error Type: "), "reason"), F.concat(F.lit("     Correct Answer: "), "correct"), F.concat(F.lit("     Method 1 Predicted: "), "one"), F.concat(F.lit("     Method 2 Predicted: "), "two"), F.lit("")]
    out.append(_entries(1, told, F.col("i"), *own))
    lists = (("Method 1 Only Errors", F.col("m1") & ~F.col("m2")), ("Method 2 Only Errors", F.col("m2") & ~F.col("m1")), ("Both Methods Error", F.col("m1") & F.col("m2")))
    for k, (name, which) in enumerate(lists):
        size = rows.agg(F.count_if(which).alias("n"))
        out.append(_lines(3 + 3 * k, size, F.concat(F.lit(f"{name} ("), _number(F.col("n")), F.lit("):"))))
        first = rows.where(which).orderBy("base_name").limit(SHOWN)
        out.append(first.select(F.lit(4 + 3 * k).alias("section"), F.lit(0).cast("long").alias("i"), F.concat(F.lit("  - "), "base_name").alias("value")).withColumn("j", F.lit(0)).select("section", "i", "j", "value"))
        out.append(_lines(5 + 3 * k, size, F.when(F.col("n") > SHOWN, F.concat(F.lit("  ... and "), _number(F.col("n") - SHOWN), F.lit(" more"))), "").where("value is not null"))
    least = F.least("n1", "n2")
    word = F.when(c["n1"] > c["n2"], "• Method 1 appears more error-prone than Method 2").when(c["n2"] > c["n1"], "• Method 2 appears more error-prone than Method 1").otherwise("• Both methods have similar error rates")
    rates = [F.concat(F.lit(f"• {name}: "), _share(x, c["n"])) for name, x in (("Method 1 Error Rate", c["n1"]), ("Method 2 Error Rate", c["n2"]), ("Agreement in Errors", c["both"]))]
    agreed = F.concat(F.lit("• Error Agreement Rate: "), _share(c["both"], least), F.lit(" (when errors occur)"))
    out.append(_lines(12, n, "BASIC INSIGHTS:", RULE, *rates, word, agreed))
    return reduce(DataFrame.unionByName, out)


def fault_report(faults: DataFrame) -> DataFrame:
    """Faults (base_name, kind: mcqa, reasoning, knowledge or other; fault, description, one and two: whether a method
    failed; validity1, validity2, better, external, knowledge, specificity, severity, scope): shares of all kinds."""
    kinds = (("mcqa", "MCQA Creation Issues"), ("reasoning", "Reasoning Issues"), ("knowledge", "Knowledge Issues"), ("other", "Other Issues"))
    figures = [F.count("*").alias("n"), F.count_if(F.col("fault").isNull()).alias("unread"), F.count_if(F.col("one") & ~F.col("two")).alias("n1"), F.count_if(F.col("two") & ~F.col("one")).alias("n2"), F.count_if(F.col("one") & F.col("two")).alias("both"), F.count_if("external").alias("ext"), F.count_if(F.col("validity1") == "sound").alias("s1"), F.count_if(F.col("validity2") == "sound").alias("s2")]
    n = faults.agg(*figures, *(F.count_if(F.col("kind") == k).alias(k) for k, _ in kinds))
    total = n.select(F.col("n").alias("n_total"))
    line = lambda name, x: F.concat(F.lit(f"{name}: "), _number(x))
    part = lambda name, x: F.concat(line(name, x), F.lit(" ("), _share(x, F.col("n")), F.lit(")"))
    head = ["COMPREHENSIVE FAULT PATTERN ANALYSIS", TITLE_RULE, "", "EXECUTIVE SUMMARY:", RULE, line("Total Questions Analyzed", F.col("n")), line("Parse Errors", F.col("unread")), "", "PRIMARY FAULT BREAKDOWN:", RULE, *(part(name, F.col(k)) for k, name in kinds), "", "METHOD PERFORMANCE COMPARISON:", RULE]
    head += [line("Method 1 Only Failures", F.col("n1")), line("Method 2 Only Failures", F.col("n2")), line("Both Methods Fail", F.col("both")), line("Method 1 Total Failures", F.col("n1") + F.col("both")), line("Method 2 Total Failures", F.col("n2") + F.col("both")), ""]
    out = [_lines(0, n, *head)]
    blocks = [(["REASONING VALIDITY PATTERNS:", RULE, "Method 1 Reasoning Validity:"], "validity1", total, "  "), (["", "Method 2 Reasoning Validity:"], "validity2", total, "  "), (["", "Better Reasoning Approach:"], "better", total, "  ")]
    blocks += [(["", "KNOWLEDGE REQUIREMENT ANALYSIS:", RULE, part("Requires External Knowledge", F.col("ext")), "", "Knowledge Types:"], "knowledge", None, "  "), (["", "Knowledge Specificity:"], "specificity", None, "  ")]
    blocks += [(["", "DETAILED FAULT CATEGORIES:", RULE], "fault", total, ""), (["", "PROBLEM SEVERITY:", RULE], "severity", None, ""), (["", "PROBLEM SCOPE:", RULE], "scope", None, "")]
    for k, (told, by, whole, indent) in enumerate(blocks, 1):
        out += [_lines(k, n, *told), _counted(k, faults, by, whole, indent)]
    for k, (kind, name) in enumerate((("mcqa", "MCQA CREATION ISSUES (Examples):"), ("reasoning", "REASONING ISSUES (Examples):")), len(blocks) + 1):
        first = numbered(faults.where(F.col("kind") == kind).orderBy("base_name").limit(5), "base_name")
        out += [_lines(k, n, "", name, RULE), _entries(k, first, F.col("i"), F.concat(_number(F.col("i") + 1), F.lit(". "), "base_name"), F.concat(F.lit("   Fault: "), "fault"), F.concat(F.lit("   Description: "), "description"), F.lit(""))]
    top = faults.where("fault is not null").groupBy("fault").agg(F.count("*").alias("m")).agg(F.min(F.struct((-F.col("m")).alias("m"), "fault")).alias("top"))
    all_ = n.join(F.broadcast(top))  # one row each
    common = F.concat(F.lit("• Most Common Fault Type: "), F.coalesce(F.col("top.fault"), F.lit("Unknown")), F.lit(" ("), _number(F.coalesce(-F.col("top.m"), F.lit(0))), F.lit(" cases)"))
    shares = [F.concat(F.lit(f"• {name}: "), _share(F.col(x), F.col("n")), F.lit(end)) for name, x, end in (("Method 1 Sound Reasoning", "s1", ""), ("Method 2 Sound Reasoning", "s2", ""), ("External Knowledge Required", "ext", " of questions"))]
    source = F.when(F.col("mcqa") > F.col("reasoning"), "• MCQA Creation is the primary source of failures").otherwise("• Reasoning Issues are the primary source of failures")
    worse = F.when(F.col("n1") > F.col("n2"), "• Method 1 (Two-Stage Reasoning) shows more failures than Method 2").otherwise("• Method 2 (Direct) shows more failures than Method 1")
    out.append(_lines(99, all_, "KEY INSIGHTS:", RULE, common, *shares, source, worse))
    return reduce(DataFrame.unionByName, out)


def _titled(c: Column) -> Column:
    return F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))


def _figure(c: Column, places: int = 3) -> Column:
    return F.format_string(f"%.{places}f", c.cast("double"))


def comparison_report(sizes: DataFrame, differences: DataFrame, stats: DataFrame, flow: DataFrame, shown: int = 15, limit: float = 0.05) -> DataFrame:
    """Sizes (group, n), differences (feature, one, two, effect, p, mean1, mean2), stats (feature, group, mean, std, least,
    most) and steps of reasoning (group, step, n): significant differences by effect, figures of each feature, common steps."""
    one = sizes.agg(F.count("*").alias("n"))
    out = [_lines(0, one, "REASONING STRUCTURE COMPARISON REPORT", TITLE_RULE, "", "GROUPS ANALYZED:", RULE)]
    groups = numbered(sizes, "group")
    out.append(_entries(1, groups, F.col("i"), F.concat("group", F.lit(": "), _number(F.col("n")), F.lit(" files"))))
    told = differences.where(F.col("p") < limit)
    none = F.when(F.col("n") == 0, "No statistically significant differences found.")
    out.append(_lines(2, told.agg(F.count("*").alias("n")), "", f"SIGNIFICANT DIFFERENCES (p < {limit:g}):", RULE, none).where("value is not null"))
    top = told.withColumn("place", F.struct((-F.abs("effect")).alias("e"), "feature", "one", "two")).orderBy("place").limit(shown)
    ranked = numbered(top, "place")
    way = F.when(F.col("mean1") > F.col("mean2"), "higher").otherwise("lower")
    own = [F.concat(F.lpad(_number(F.col("i") + 1), 2, " "), F.lit(". "), _titled(F.col("feature"))), F.concat(F.lit("    Groups: "), "one", F.lit("_vs_"), "two"), F.concat(F.lit("    Effect size: "), _figure(F.col("effect"))), F.concat(F.lit("    P-value: "), _figure(F.col("p"), 6))]
    own += [F.concat(F.lit("    "), "one", F.lit(" mean: "), _figure(F.col("mean1"))), F.concat(F.lit("    "), "two", F.lit(" mean: "), _figure(F.col("mean2"))), F.concat(F.lit("    Direction: "), "one", F.lit(" is "), way), F.lit("")]
    out.append(_entries(3, ranked, F.col("i"), *own))
    out.append(_lines(4, one, "", "GROUP STATISTICS SUMMARY:", RULE))
    line = F.concat(F.lit("  "), "group", F.lit(": "), _figure(F.col("mean")), F.lit(" ± "), _figure(F.col("std")), F.lit(" (range: "), _figure(F.col("least")), F.lit("-"), _figure(F.col("most")), F.lit(")"))
    # a feature's lines are one entry: a line for each group
    features = stats.groupBy("feature").agg(F.transform(F.sort_array(F.collect_list(F.struct("group", line.alias("line")))), lambda x: x["line"]).alias("of"))
    features = numbered(features, "feature").withColumn("all", F.concat(F.array(F.lit(""), F.concat(_titled(F.col("feature")), F.lit(":"))), "of"))
    out.append(features.select(F.lit(5).alias("section"), "i", F.posexplode("all").alias("j", "value")))
    out.append(_lines(6, one, "", "ARGUMENTATION FLOW PATTERN ANALYSIS:", RULE))
    steps = flow.groupBy("group").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"), F.slice(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "step"))), 1, 5).alias("top"))
    share = F.transform("top", lambda x: F.concat(F.lit("    "), _titled(x["step"]), F.lit(": "), _number(-x["n"]), F.lit(" ("), _share(-x["n"], F.col("total")), F.lit(")")))
    head = F.array(F.lit(""), F.concat("group", F.lit(":")), F.concat(F.lit("  Total reasoning steps: "), _number(F.col("total"))), F.concat(F.lit("  Unique patterns: "), _number(F.col("kinds"))), F.lit("  Most common patterns:"))
    steps = numbered(steps, "group").withColumn("all", F.concat(head, share))
    out.append(steps.select(F.lit(7).alias("section"), "i", F.posexplode("all").alias("j", "value")))
    return reduce(DataFrame.unionByName, out)


def extraction_text(results: DataFrame) -> DataFrame:
    """Results (path, text) in order of path, each under its file's name; written with a blank line between them."""
    told = F.concat(F.lit("# "), F.element_at(F.split("path", "/"), -1), F.lit("\n\n"), F.trim(F.coalesce("text", F.lit(""))))
    return numbered(results.select("path", told.alias("value")), "path").select(F.lit(0).alias("section"), "i", F.lit(0).alias("j"), "value")


def written_report(lines: DataFrame, path: str, between: str = "\n") -> None:
    """The lines in order, as text files whose names are in that order, too."""
    lines.repartitionByRange("section", "i", "j").sortWithinPartitions("section", "i", "j").select("value").write.option("lineSep", between).text(path)
