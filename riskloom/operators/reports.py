"""Reports to be read by people: Markdown and HTML as tables of ordered lines, and the files made of them.

A report is a table of (report_id, section, place, part, text): ordered by these it is the document.  So a report of any length is sorted
by Spark and never collected in one row; only its file is written by one task, part after part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as X
from .analytics import RISKS
from .ordered import ranked

#: Labels by language; fixed values of our own.
LABELS = {
    "en": {"title": "Findings", "total": "Total", "reachable": "Reachable", "safe": "Not reachable", "review": "To review", "none": "No findings.", "source": "Source", "score": "Score", "class": "Class", "rule": "Rule", "confidence": "Confidence", "copies": "Copies", "reasoning": "Why", "exploit_scenario": "Attack", "remediation": "Fix", "critical": "Critical", "high": "High", "medium": "Medium", "low": "Low"},
    "zh": {"title": "发现", "total": "总数", "reachable": "可达", "safe": "不可达", "review": "待复核", "none": "没有发现。", "source": "来源", "score": "评分", "class": "类别", "rule": "规则", "confidence": "置信度", "copies": "副本", "reasoning": "理由", "exploit_scenario": "攻击", "remediation": "修复", "critical": "致命", "high": "高", "medium": "中", "low": "低"},
}
ORDER = ["report_id", "section", "place", "part"]


def prose(df: DataFrame, field: str, lang: str, finding: str = "finding") -> Column:
    """A finding's free text in a language, or as it was written where there is no translation."""
    have = {f.name for f in df.schema[finding].dataType.fields}
    text = [F.nullif(F.col(f"{finding}.{c}").cast("string"), F.lit("")) for c in (f"{field}_{lang}", field) if c in have]
    return X.strip(F.coalesce(*text, F.lit("")))


def escaped(x: Column) -> Column:
    """Text as it may stand in HTML, attributes included."""
    for plain, mark in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        x = F.replace(x, F.lit(plain), F.lit(mark))
    return x


def place_of(file: str, line: str) -> Column:
    return F.concat(F.lit("`"), X.slashes(F.col(file)), F.lit(":"), F.col(line), F.lit("`"))


def numbered(scored: DataFrame) -> DataFrame:
    """Scored findings with n, their number within report and risk level by file and line."""
    return ranked(scored, ["report_id", "risk_level"], [F.col("sink_file"), F.col("sink_line"), F.col("dedup_key")], "n")


def _section() -> Column:
    return F.array_position(F.array(*[F.lit(r) for r in RISKS]), F.col("risk_level")).cast("int")


def markdown(scored: DataFrame, lang: str = "en", projects: DataFrame | None = None) -> DataFrame:
    """report_id, section, place, part, text.  scored: findings with report_id, risk_level, vuln_type, places, cvss_vector, cvss_score, cwe,
    messages, verdict, finding; projects (report_id) adds reports without findings."""
    t = LABELS.get(lang, LABELS["en"])
    counts = scored.groupBy("report_id").agg(F.count("*").alias("total"), F.count_if(F.col("verdict") == "yes").alias("reachable"), F.count_if(F.col("verdict") == "no").alias("safe"))
    if projects is not None:
        counts = projects.select("report_id").distinct().join(counts, "report_id", "left").na.fill(0)
    names = ["total", "reachable", "safe", "review"]
    values = F.concat(F.lit("| "), F.concat_ws(" | ", "total", "reachable", "safe", F.col("total") - F.col("reachable") - F.col("safe")), F.lit(" |"))
    top = F.array(
        F.concat(F.lit(f"# {t['title']}: "), "report_id"), F.lit(""), F.lit("| " + " | ".join(t[n] for n in names) + " |"), F.lit("|" + " --- |" * 4), values, F.lit(""), F.when(F.col("total") == 0, t["none"])
    )
    head = counts.select("report_id", top.alias("lines"))
    head = head.select("report_id", F.lit(0).alias("section"), F.lit(0).cast("long").alias("place"), F.posexplode("lines").alias("part", "text")).where("text IS NOT NULL")
    label = F.element_at(F.create_map(*[x for r in RISKS for x in (F.lit(r), F.lit(t[r]))]), F.col("risk_level"))
    groups = scored.groupBy("report_id", "risk_level").agg(F.count("*").alias("n")).select("report_id", _section().alias("section"), F.lit(0).cast("long").alias("place"), F.lit(0).alias("part"), F.concat(F.lit("## "), label, F.lit(" ("), "n", F.lit(")")).alias("text"))
    line = lambda key, x: F.when(F.coalesce(x, F.lit("")) != "", F.concat(F.lit(f"- **{t[key]}** "), x))
    copies = F.array_join(F.transform("duplicate_locations", lambda p: F.concat(F.lit("`"), X.slashes(p), F.lit("`"))), ", ") if "duplicate_locations" in scored.columns else F.lit("")
    fields = {f.name for f in scored.schema["finding"].dataType.fields}
    each = F.array(
        F.concat(F.lit("### "), "n", F.lit(". "), X.one_line(F.col("vuln_type")), F.lit(" - "), place_of("sink_file", "sink_line")),
        F.lit(""),
        line("source", place_of("source_file", "source_line")),
        line("score", F.concat(F.format_string("%.1f", "cvss_score"), F.lit(" (`CVSS:3.1/"), "cvss_vector", F.lit("`)"))),
        line("class", F.get("cwe", F.lit(0))),
        line("rule", X.one_line(F.array_join("messages", " / "))),
        line("confidence", F.col("finding.confidence").cast("string") if "confidence" in fields else F.lit("")),
        line("copies", copies),
        *[line(c, X.one_line(prose(scored, c, lang))) for c in ("reasoning", "exploit_scenario", "remediation")],
        F.lit(""),
    )
    made = numbered(scored).select("report_id", _section().alias("section"), F.col("n").alias("place"), each.alias("lines"))
    rows = made.select("report_id", "section", "place", F.posexplode("lines").alias("part", "text")).where("text IS NOT NULL")
    return head.unionAll(groups).unionAll(rows)


def html_cards(scored: DataFrame) -> DataFrame:
    """report_id, section, place, part (0), text: a card for each finding, texts in both languages, every value escaped."""
    both = lambda c: F.when(prose(scored, c, "") != "", F.concat(F.lit(f'<p class="{c}" data-zh="'), escaped(prose(scored, c, "zh")), F.lit('" data-en="'), escaped(prose(scored, c, "en")), F.lit('">'), escaped(prose(scored, c, "")), F.lit("</p>")))
    card = F.concat_ws(
        "",
        F.concat(F.lit('<details class="'), "risk_level", F.lit('" data-verdict="'), "verdict", F.lit('"><summary title="'), escaped(F.concat("sink_file", F.lit(":"), "sink_line")), F.lit('">')),
        F.concat(escaped(F.col("vuln_type")), F.lit(" <b>"), F.format_string("%.1f", "cvss_score"), F.lit("</b> <code>"), escaped(X.short_location(F.col("sink_file"))), F.lit(":"), "sink_line", F.lit("</code></summary>")),
        F.concat(F.lit("<p>"), escaped(F.array_join("messages", " / ")), F.lit("</p>")),
        *[both(c) for c in ("reasoning", "exploit_scenario", "remediation")],
        F.lit("</details>"),
    )
    return numbered(scored).select("report_id", _section().alias("section"), F.col("n").alias("place"), F.lit(0).alias("part"), card.alias("text"))


#: Values of the file column that are shown before the rest is asked for.
FACET_PAGE = 5


def html_facets(scored: DataFrame, page: int = FACET_PAGE) -> DataFrame:
    """report_id, section (0), place, part, text: tiles with what was decided, and one column of buttons each for weakness type, file and risk.

    A column begins with all findings; values follow by how many findings have them, most first, then by name - risks in their fixed order,
    those that occur.  Files beyond the first page wait behind a button that says how many they are.  Values are counted before they are ranked,
    and ranks come from ranges with a carry, so a report of any number of files is no single task.  Null values count as blank ones."""
    risk = F.array_position(F.array(*[F.lit(r) for r in RISKS]), F.col("value")).cast("long")
    kinds = F.array(*[F.struct(F.lit(i).cast("long").alias("place"), F.lit(name).alias("name"), F.coalesce(F.col(c), F.lit("")).alias("value")) for i, (name, c) in enumerate((("type", "vuln_type"), ("file", "sink_file"), ("severity", "risk_level")), 1)])
    counts = scored.select("report_id", F.inline(kinds)).groupBy("report_id", "place", "name", "value").agg(F.count("*").alias("n"))
    placed = ranked(counts, ["report_id", "place"], [F.when(F.col("name") == "severity", risk).otherwise(-F.col("n")), F.col("value")], "nth")
    label = F.when(F.col("name") == "file", X.basename(F.col("value"))).otherwise(F.col("value"))
    late = (F.col("name") == "file") & (F.col("nth") > page)
    button = F.concat(F.lit('<button class="facet'), F.when(late, " late").otherwise(""), F.lit('" data-facet="'), "name", F.lit('" data-value="'), escaped(F.col("value")), F.lit('">'), escaped(label), F.lit(" ("), "n", F.lit(")</button>"))
    items = placed.select("report_id", F.lit(0).alias("section"), "place", F.col("nth").cast("int").alias("part"), button.alias("text"))
    ends = placed.groupBy("report_id", "place", "name").agg(F.sum("n").alias("n"), F.max("nth").cast("int").alias("last"))
    more = F.when((F.col("name") == "file") & (F.col("last") > page), F.concat(F.lit('<button class="show-late">+'), F.col("last") - page, F.lit("</button>"))).otherwise("")
    open_ = F.concat(F.lit('<div class="facets" data-facet="'), "name", F.lit('"><button class="facet" data-value="">all ('), "n", F.lit(")</button>"))
    edges = ends.select("report_id", F.lit(0).alias("section"), "place", F.inline(F.array(F.struct(F.lit(0).alias("part"), open_.alias("text")), F.struct((F.col("last") + 1).alias("part"), F.concat(more, F.lit("</div>")).alias("text")))))
    decided = scored.groupBy("report_id").agg(F.count("*").alias("total"), F.count_if(F.col("verdict") == "yes").alias("reachable"), F.count_if(F.col("verdict") == "no").alias("safe")).withColumn("review", F.col("total") - F.col("reachable") - F.col("safe"))
    tiles = F.array(*[F.struct(F.lit(i).alias("part"), F.concat(F.lit(f'<div class="stat {c}">'), c, F.lit("</div>")).alias("text")) for i, c in enumerate(("total", "reachable", "safe", "review"), 1)])
    return decided.select("report_id", F.lit(0).alias("section"), F.lit(0).cast("long").alias("place"), F.inline(tiles)).unionByName(edges).unionByName(items)


def html(scored: DataFrame, title: str = "Findings") -> DataFrame:
    """Lines of a whole page for each report: head, tiles and facet columns, the cards by risk, and the end."""
    style = "body{font-family:sans-serif;margin:2em}details{border:1px solid #ccc;margin:.4em;padding:.4em}.critical{border-left:6px solid #900}.high{border-left:6px solid #d33}.medium{border-left:6px solid #d90}.low{border-left:6px solid #888}.facets{display:inline-block;vertical-align:top}.facet{display:block}.late{display:none}"
    reports = scored.select("report_id").distinct()
    start = F.concat(F.lit(f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{title}</title><style>{style}</style></head><body><h1>'), escaped(F.col("report_id")), F.lit("</h1>"))
    edge = lambda section, text: reports.select("report_id", F.lit(section).alias("section"), F.lit(0).cast("long").alias("place"), F.lit(0).alias("part"), text.alias("text"))
    return edge(0, start).unionByName(html_facets(scored)).unionAll(html_cards(scored)).unionAll(edge(len(RISKS) + 1, F.lit("</body></html>")))


def report_json(scored: DataFrame, summary: DataFrame) -> DataFrame:
    """Lines of one JSON document for each report: project, summary (report_id and counts) and findings in their order."""
    counts = F.to_json(F.struct(*[c for c in summary.columns if c != "report_id"]))
    quoted = F.regexp_replace(F.to_json(F.array("report_id")), r"^\[|\]$", "")
    head = summary.select("report_id", F.lit(0).alias("section"), F.lit(0).cast("long").alias("place"), F.lit(0).alias("part"), F.concat(F.lit('{"project":'), quoted, F.lit(',"summary":'), counts, F.lit(',"findings":[')).alias("text"))
    body = ranked(scored, ["report_id"], [_section(), F.col("sink_file"), F.col("sink_line"), F.col("dedup_key")], "n")
    made = F.to_json(F.struct(*[c for c in scored.columns if c != "report_id"]))
    rows = body.select("report_id", F.lit(1).alias("section"), F.col("n").alias("place"), F.lit(0).alias("part"), F.concat(F.when(F.col("n") > 1, ",").otherwise(""), made).alias("text"))
    tail = summary.select("report_id", F.lit(2), F.lit(0).cast("long"), F.lit(0), F.lit("]}"))
    return head.unionAll(rows).unionAll(tail)


def write_documents(lines: DataFrame, path: str) -> None:
    """One text file for each report below path (report_id=.../part-*): a report's lines go to one task in order, reports to many."""
    parts = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lines.repartition(parts, "report_id").sortWithinPartitions(*ORDER).select("report_id", "text").write.mode("overwrite").partitionBy("report_id").text(path)
