"""Reports as texts, line by line, against plain assembly."""

from collections import Counter

from scholia.sources import reports as R

FIELDS = "base_name string, kind string, fault string, description string, one boolean, two boolean, validity1 string, validity2 string, better string, external boolean, knowledge string, specificity string, severity string, scope string"


def plain_faults(rows):
    names = [f.split()[0] for f in FIELDS.split(", ")]
    rows = [dict(zip(names, r, strict=True)) for r in rows]
    n, out = len(rows), []
    count = lambda f: sum(bool(f(r)) for r in rows)
    share = lambda x: f"{x} ({x * 100 / n:.1f}%)"
    rule = "-" * 40

    def counted(by, shares=False, indent="  "):
        found = Counter(r[by] for r in rows if r[by] is not None)
        return [f"{indent}{k}: {share(m) if shares else m}" for k, m in sorted(found.items(), key=lambda x: (-x[1], x[0]))]

    one, two, both = count(lambda r: r["one"] and not r["two"]), count(lambda r: r["two"] and not r["one"]), count(lambda r: r["one"] and r["two"])
    kinds = {k: count(lambda r, k=k: r["kind"] == k) for k in ("mcqa", "reasoning", "knowledge", "other")}
    out += ["COMPREHENSIVE FAULT PATTERN ANALYSIS", "=" * 80, "", "EXECUTIVE SUMMARY:", rule, f"Total Questions Analyzed: {n}", f"Parse Errors: {count(lambda r: r['fault'] is None)}", "", "PRIMARY FAULT BREAKDOWN:", rule]
    out += [f"{name}: {share(kinds[k])}" for k, name in (("mcqa", "MCQA Creation Issues"), ("reasoning", "Reasoning Issues"), ("knowledge", "Knowledge Issues"), ("other", "Other Issues"))]
    out += ["", "METHOD PERFORMANCE COMPARISON:", rule, f"Method 1 Only Failures: {one}", f"Method 2 Only Failures: {two}", f"Both Methods Fail: {both}", f"Method 1 Total Failures: {one + both}", f"Method 2 Total Failures: {two + both}", ""]
    out += ["REASONING VALIDITY PATTERNS:", rule, "Method 1 Reasoning Validity:", *counted("validity1", True), "", "Method 2 Reasoning Validity:", *counted("validity2", True), "", "Better Reasoning Approach:", *counted("better", True)]
    ext = count(lambda r: r["external"])
    out += ["", "KNOWLEDGE REQUIREMENT ANALYSIS:", rule, f"Requires External Knowledge: {share(ext)}", "", "Knowledge Types:", *counted("knowledge"), "", "Knowledge Specificity:", *counted("specificity")]
    out += ["", "DETAILED FAULT CATEGORIES:", rule, *counted("fault", True, ""), "", "PROBLEM SEVERITY:", rule, *counted("severity", indent=""), "", "PROBLEM SCOPE:", rule, *counted("scope", indent="")]
    for k, name in (("mcqa", "MCQA CREATION ISSUES (Examples):"), ("reasoning", "REASONING ISSUES (Examples):")):
        out += ["", name, rule]
        for i, r in enumerate(sorted((r for r in rows if r["kind"] == k), key=lambda r: r["base_name"])[:5], 1):
            out += [f"{i}. {r['base_name']}", f"   Fault: {r['fault']}", f"   Description: {r['description']}", ""]
    top = sorted(Counter(r["fault"] for r in rows if r["fault"]).items(), key=lambda x: (-x[1], x[0]))[0]
    sound = [count(lambda r, k=k: r[k] == "sound") * 100 / n for k in ("validity1", "validity2")]
    out += ["KEY INSIGHTS:", rule, f"• Most Common Fault Type: {top[0]} ({top[1]} cases)", f"• Method 1 Sound Reasoning: {sound[0]:.1f}%", f"• Method 2 Sound Reasoning: {sound[1]:.1f}%", f"• External Knowledge Required: {ext * 100 / n:.1f}% of questions"]
    out.append("• MCQA Creation is the primary source of failures" if kinds["mcqa"] > kinds["reasoning"] else "• Reasoning Issues are the primary source of failures")
    out.append("• Method 1 (Two-Stage Reasoning) shows more failures than Method 2" if one > two else "• Method 2 (Direct) shows more failures than Method 1")
    return out


def test_fault_report(spark, tmp_path):
    rows = []
    for k in range(37):
        kind = ("mcqa", "reasoning", "knowledge", "other")[k * k % 4]
        fault = None if k == 7 else f"fault {k % 5}"
        rows.append((f"q{k:03d}", kind, fault, f"what {k}", k % 3 > 0, k % 4 > 1, ("sound", "flawed", None)[k % 3], ("sound", "partial")[k % 2], f"m{k % 2}", k % 6 == 0, f"type{k % 4}", ("broad", "narrow")[k % 2], f"s{k % 3}", f"c{k % 2}"))
    lines = R.fault_report(spark.createDataFrame(rows, FIELDS).repartition(4))
    got = [r["value"] for r in lines.orderBy("section", "i", "j").collect()]
    want = plain_faults([r for r in rows if r[2] is not None or True])
    drop = lambda xs: [x for x in xs if "None" not in x]
    assert got == drop(want)
    R.written_report(lines, f"{tmp_path}/report")
    files = sorted(p for p in (tmp_path / "report").iterdir() if p.name.startswith("part-"))
    assert "".join(p.read_text() for p in files) == "".join(x + "\n" for x in got)


def test_comparison_report(spark):
    sizes = spark.createDataFrame([("good", 3), ("bad", 2)], "group string, n int")
    diffs = spark.createDataFrame([("flow_length", "good", "bad", -1.5, 0.01, 1.0, 2.0), ("evidence_count", "good", "bad", 2.25, 0.001, 4.0, 1.5), ("mean_position", "good", "bad", 9.0, 0.2, 1.0, 1.0)], "feature string, one string, two string, effect double, p double, mean1 double, mean2 double")
    stats = spark.createDataFrame([("flow_length", "good", 1.0, 0.5, 0.0, 2.0), ("flow_length", "bad", 2.0, 0.25, 1.0, 3.0)], "feature string, group string, mean double, std double, least double, most double")
    flow = spark.createDataFrame([("good", "LOGICAL_INFERENCE", 6), ("good", "CONCLUSION", 2), ("bad", "CONCLUSION", 1)], "group string, step string, n int")
    got = [r["value"] for r in R.comparison_report(sizes, diffs, stats, flow).orderBy("section", "i", "j").collect()]
    rule = "-" * 40
    want = ["REASONING STRUCTURE COMPARISON REPORT", "=" * 80, "", "GROUPS ANALYZED:", rule, "bad: 2 files", "good: 3 files", "", "SIGNIFICANT DIFFERENCES (p < 0.05):", rule]
    want += [" 1. Evidence Count", "    Groups: good_vs_bad", "    Effect size: 2.250", "    P-value: 0.001000", "    good mean: 4.000", "    bad mean: 1.500", "    Direction: good is higher", ""]
    want += [" 2. Flow Length", "    Groups: good_vs_bad", "    Effect size: -1.500", "    P-value: 0.010000", "    good mean: 1.000", "    bad mean: 2.000", "    Direction: good is lower", ""]
    want += ["", "GROUP STATISTICS SUMMARY:", rule, "", "Flow Length:", "  bad: 2.000 ± 0.250 (range: 1.000-3.000)", "  good: 1.000 ± 0.500 (range: 0.000-2.000)", "", "ARGUMENTATION FLOW PATTERN ANALYSIS:", rule]
    want += ["", "bad:", "  Total reasoning steps: 1", "  Unique patterns: 1", "  Most common patterns:", "    Conclusion: 1 (100.0%)", "", "good:", "  Total reasoning steps: 8", "  Unique patterns: 2", "  Most common patterns:", "    Logical Inference: 6 (75.0%)", "    Conclusion: 2 (25.0%)"]
    assert got == want
    none = R.comparison_report(sizes, diffs.where("p > 0.1"), stats, flow).where("section = 2").orderBy("i").collect()
    assert none[-1]["value"] == "No statistically significant differences found."


def test_extraction_text(spark, tmp_path):
    df = spark.createDataFrame([("/a/b.txt", " two "), ("/a/a.pdf", "one"), ("/c/z.md", None)], "path string, text string")
    R.written_report(R.extraction_text(df), f"{tmp_path}/all", "\n\n")
    files = sorted(p for p in (tmp_path / "all").iterdir() if p.name.startswith("part-"))
    assert "".join(p.read_text() for p in files).rstrip("\n") == "# a.pdf\n\none\n\n# b.txt\n\ntwo\n\n# z.md"
