"""Scalar functions of the finding dataflow, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK = r"^\s+|\s+$"


def strip(x: Column) -> Column:
    """All white space at both ends (trim() takes spaces only)."""
    return F.regexp_replace(x, BLANK, "")


def slashes(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def basename(path: Column) -> Column:
    return F.element_at(F.split(slashes(path), "/"), -1)


def short_location(path: Column, keep: int = 2) -> Column:
    """The last segments of a path, with a leading ellipsis if any were dropped."""
    parts = F.filter(F.split(slashes(path), "/"), lambda p: p != "")
    tail = F.array_join(F.slice(parts, F.greatest(F.size(parts) - (keep - 1), F.lit(1)), F.lit(keep)), "/")
    return F.when(F.size(parts) <= keep, F.array_join(parts, "/")).otherwise(F.concat(F.lit(".../"), tail))


def cwe_ids(cwe: Column) -> Column:
    """Distinct identifiers (text before the colon, trimmed, upper case) of raw weakness strings."""
    ids = F.transform(F.coalesce(cwe, F.array().cast("array<string>")), lambda c: F.upper(strip(F.split(c, ":")[0])))
    return F.array_distinct(F.filter(ids, lambda c: c != ""))


def in_scope(ids: Column, deny: list[str]) -> Column:
    """False only if there are ids and all of them are out of scope."""
    return (F.size(ids) == 0) | (F.size(F.array_except(ids, F.array(*[F.lit(d) for d in deny]).cast("array<string>"))) > 0)


def rule_ids_of(rule_ids: Column, rule_id: Column) -> Column:
    """The merged list, or the single id where it is missing or empty, without blanks."""
    ids = F.when(F.size(F.coalesce(rule_ids, F.array().cast("array<string>"))) > 0, rule_ids).otherwise(F.array(rule_id))
    return F.filter(ids, lambda r: r.isNotNull() & (r != ""))


def vuln_type(cwe: Column) -> Column:
    """The quoted short name at the end of the first weakness string, else that string, else Uncategorized."""
    first = F.get(cwe, F.lit(0))
    quoted = F.regexp_extract(first, r"\('([^']+)'\)\s*$", 1)
    return F.when(first.isNull() | (first == ""), "Uncategorized").when(quoted != "", quoted).otherwise(first)


def verdict(finding: str = "finding") -> Column:
    """unverified, failed, yes, no or uncertain; a null finding is a verdict of its own."""
    return (
        F.when(F.col(finding).isNull(), "unverified")
        .when(F.col(f"{finding}.reasoning").contains("verifier_failed"), "failed")
        .when(F.col(f"{finding}.reachable").isin("yes", "no"), F.col(f"{finding}.reachable"))
        .otherwise("uncertain")
    )


def risk_level(verdict_: Column, band: Column) -> Column:
    """Safe findings are low; confirmed ones keep their band; the rest drop one."""
    down = F.when(band == "critical", "high").when(band == "high", "medium").otherwise("low")
    return F.when(verdict_ == "no", "low").when(verdict_ == "yes", band).otherwise(down)


def language(text: Column, share: float = 0.15) -> Column:
    """zh if Han characters are at least a share of Han and Latin letters."""
    text = F.coalesce(text, F.lit(""))
    han, latin = F.regexp_count(text, F.lit(r"[\x{4e00}-\x{9fff}]")), F.regexp_count(text, F.lit("[A-Za-z]"))
    return F.when((han + latin > 0) & (han / F.greatest(han + latin, F.lit(1)) >= share), "zh").otherwise("en")


def is_language(text: Column, target: str) -> Column:
    """Lax check of a translation: some Han for zh; for en no more Han than the detection threshold."""
    return F.regexp_like(text, F.lit(r"[\x{4e00}-\x{9fff}]")) if target == "zh" else language(text) == "en"


def one_line(x: Column) -> Column:
    return strip(F.regexp_replace(x, r"\s+", " "))


def masked_key(key: Column) -> Column:
    n = F.length(key)
    return F.when(n <= 8, F.repeat(F.lit("*"), n)).otherwise(F.concat(F.substring(key, 1, 4), F.repeat(F.lit("*"), n - 8), F.substr(key, n - 3, F.lit(4))))


def safe_stem(name: Column) -> Column:
    kept = strip(F.regexp_replace(name, r"[^\p{Alnum}\-_. ]", ""))
    return F.when(kept == "", "report").otherwise(kept)


def static_confidence(level: Column) -> Column:
    return F.when(F.upper(level) == "HIGH", 95).when(F.upper(level) == "LOW", 55).otherwise(75)


def retry_delay(attempt: Column, after: Column | None = None, base: float = 2.0, cap: float = 30.0) -> Column:
    """Seconds before an attempt (the second waits base, then doubling), at most cap; a stated delay wins."""
    ladder = F.when(attempt < 2, 0.0).otherwise(base * F.pow(F.lit(2.0), attempt - 2))
    return F.least(ladder if after is None else F.coalesce(after, ladder), F.lit(cap))


def without_fences(reply: Column) -> Column:
    """A model's reply without code fences and their json tag."""
    inner = F.regexp_replace(strip(reply), r"^```(?:json)?\s*|\s*```$", "")
    return strip(inner)


def numbered(lines: Column, first: Column, last: Column) -> Column:
    """Lines first..last (from 1), each behind its number."""
    first, last = F.greatest(first, F.lit(1)), F.least(last, F.size(lines))
    shown = F.transform(F.sequence(first, last), lambda i: F.concat(F.lpad(i.cast("string"), 5, " "), F.lit(" | "), F.element_at(lines, i)))
    return F.when(first <= last, F.array_join(shown, "\n")).otherwise("")


def short_type(name: Column) -> Column:
    """A C++ type without qualifiers, signs, references and scope."""
    bare = F.regexp_replace(name, r"\b(const|volatile|signed|unsigned|struct|class|enum)\b|[*&\s]+", " ")
    return strip(F.regexp_replace(strip(bare), r"^.*::", ""))


def c_integer(text: Column) -> Column:
    """Value of a C integer literal (decimal, octal or hexadecimal, any suffix); null if it is none."""
    bare = F.regexp_replace(F.lower(strip(text)), r"[ul]+$", "")
    return (
        F.when(bare.rlike("^0x[0-9a-f]+$"), F.conv(F.substring(bare, 3, 64), 16, 10).cast("long"))
        .when(bare.rlike("^0[0-7]+$"), F.conv(bare, 8, 10).cast("long"))
        .when(bare.rlike("^[0-9]+$"), bare.cast("long"))
    )


def camelize(name: Column) -> Column:
    return F.array_join(F.transform(F.split(F.regexp_replace(name, "/", "::_"), "_"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1000))), "")


def line_of(text: Column, offset: Column) -> Column:
    """Line (from 1) of a character offset (from 0)."""
    before = F.substr(text, F.lit(1), offset)
    return F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1
