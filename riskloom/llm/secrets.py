"""Secret scans: fixed patterns, and dictionary-primed zstandard novelty.

Base kinds, leftmost and non-overlapping per kind: ``assign`` (a password-like name, a separator and a
value of 6 or more characters), ``access`` (AKIA..., 20 or more), ``hex`` (24 or more digits a-f).

The method adds kind ``novel``: a run of 16 or more token characters with a letter and a digit, outside
the base spans, that follows a sensitive word within ``NEAR`` characters.  Its novelty is what it adds, in
bits a character, to the zstandard size of its surroundings (``AROUND`` characters on both sides), the
compressor being primed with a dictionary: common identifiers of code, and the words and identifiers that most documents of
the corpus itself have (``dictionary``: runs of letters, so that no key can get in however often it is copied; counted over
all documents, at most ``WORDS`` of them).  Other copies of the run (or of a value of
``LEAST`` characters within it, after a =) are taken out of the surroundings first: a secret is no less of one for
standing there twice.  Words, identifiers and what the surroundings share with it otherwise cost next to nothing;
random strings cost what they weigh.  Every occurrence of a string found novel is reported, sensitive word or not,
unless a base span or a longer novel one holds it.

Edge cases: null is an empty text without spans.  Rows are judged one by one, by the one dictionary, so repeated rows and null
ids are rows like others; words in equally many documents are taken or left together; an empty table gives an empty
result; other columns are ignored unless kept.  Work is linear in a text's length.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkernel as K
from .common import cut, tune
from .spans import FIELDS, TYPE, ordered

KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST = 16
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST},}}")
SENSITIVE = re.compile(r"pass(word|wd|phrase)?|secret|token|api.?key|credential|private.?key|bearer|auth", re.IGNORECASE)
LETTER, DIGIT = re.compile("[A-Za-z]"), re.compile("[0-9]")
NEAR, AROUND = 48, 256
#: Bits a character from which a candidate is incompressible: random hex digits have 4, base64 6; identifiers made of two or
#: three words of the dictionary mostly 1 to 3.7 (of very short words more, as each match has its price).
BITS = 4.0
#: Words of the corpus in the dictionary, and how many of them a worker counts before it hands them on.
WORDS, HELD = 4000, 200_000
WORD = re.compile(r"(?<![A-Za-z])[A-Za-z_]{4,24}(?![A-Za-z])")
#: Identifiers and words that code around secrets is made of.
DICTIONARY = (
    "abstract async await begin boolean bytes callback char class client config connection const context continue credential data database "
    "default delete description environment error example exception export extends false field file filter final float format function handler "
    "header headers host identifier implements import include index instance integer interface internal iterator key length library list local "
    "location manager message method module namespace number object option output override package parameter parent password path placeholder "
    "private process property protected provider public query reference register repository request resource response result return schema "
    "secret server service session setting source static status string struct subscription system table template test throw timestamp token "
    "true type undefined update upload user username value variable version virtual void volatile your_api_key_here change_me 0123456789 "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ https://www.example.com/ 00000000-0000-0000-0000-000000000000 xxxxxxxxxxxxxxxx"
)


def dictionary(docs: DataFrame, words: int = WORDS) -> str:
    """The fixed identifiers and, behind them, the words that stand in most documents (two at least), the commonest last:
    what is near the end of a dictionary is cheapest to refer to.  A histogram of the counts (steps of a sixteenth of a
    doubling) tells from which count on there are no more than so many words: only those reach the driver."""
    tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()

        def counts() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

        for b in batches:
            for chunk in K.chunks(b):
                for text in chunk.column(0).to_pylist():
                    seen.update(set(WORD.findall(text)))
                    if len(seen) >= HELD:
                        yield counts()
                        seen.clear()
        yield counts()

    found = docs.select(F.col("text").cast("string").alias("text")).where(F.col("text").isNotNull()).mapInArrow(K.lean(run), "word string, n long")
    counts = cut(found.groupBy("word").agg(F.sum("n").alias("n")).where("n > 1").withColumn("step", F.floor(F.log2("n") * 16)), "words")
    least, held = 0, 0
    for r in sorted(counts.groupBy("step").agg(F.count("*").alias("n")).collect(), key=lambda r: -r["step"]):
        held += r["n"]
        if held > words:
            least = r["step"] + 1
            break
    top = sorted(counts.where(F.col("step") >= least).collect(), key=lambda r: (r["n"], r["word"]))
    return " ".join([DICTIONARY, *(r["word"] for r in top)])


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = []
    low = text.lower()
    if any(x in low for x in ("passw", "secret", "token", "key")):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return out


class Novelty:
    """Marginal compressed bits of a string in its surroundings."""

    def __init__(self, dictionary: str = DICTIONARY):
        primed = zstandard.ZstdCompressionDict(dictionary.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        params = zstandard.ZstdCompressionParameters.from_level(6, write_content_size=False, write_checksum=False, write_dict_id=False)
        primed.precompute_compress(compression_params=params)
        self.size = zstandard.ZstdCompressor(dict_data=primed, compression_params=params).compress

    def bits(self, text: str, start: int, end: int) -> float:
        what, before, after = text[start:end], text[max(0, start - AROUND) : start], text[end : end + AROUND]
        copies = [x for x in (what, *what.split("=")) if len(x) >= LEAST and (x in before or x in after)]
        # lines that repeat with their secret shrink to so little that an identifier weighs more in them than after its own line
        alone = before[max((before.rfind(x) + len(x) for x in copies if x in before), default=0) :]
        for x in copies:
            before, after = before.replace(x, ""), after.replace(x, "")
        added = [len(self.size((x + what).encode())) - len(self.size(x.encode())) for x in ([before + after, alone] if copies else [before + after])]
        return 8 * min(added) / (end - start)


class Taken:
    """Spans, to ask in logarithmic time whether one overlaps or holds a stretch."""

    def __init__(self, spans: list[tuple[str, int, int]]):
        order = sorted((s, e) for _, s, e in spans)
        self.starts, self.ends = [s for s, _ in order], list(accumulate((e for _, e in order), max))

    def overlaps(self, a: int, e: int) -> bool:
        before = bisect_left(self.starts, e)
        return before > 0 and self.ends[before - 1] > a

    def holds(self, a: int, e: int) -> bool:
        before = bisect_right(self.starts, a)
        return before > 0 and self.ends[before - 1] >= e


def novel_spans(text: str, base: list[tuple[str, int, int]], novelty: Novelty, bits: float = BITS) -> list[tuple[str, int, int]]:
    found, taken = {}, Taken(base)
    for m in CANDIDATE.finditer(text):
        a, e = m.span()
        if not (DIGIT.search(m[0]) and LETTER.search(m[0])) or taken.overlaps(a, e):
            continue
        if m[0] not in found.get(m[0][:LEAST], ()) and SENSITIVE.search(text, max(0, a - NEAR), a) and novelty.bits(text, a, e) >= bits:
            found.setdefault(m[0][:LEAST], set()).add(m[0])
    return occurrences(text, taken, found) if found else []


def occurrences(text: str, taken: Taken, found: dict[str, set[str]]) -> list[tuple[str, int, int]]:
    """Where found strings (by their first LEAST characters) stand, the longest at each place, outside the base spans."""
    out = []
    for m in CANDIDATE.finditer(text):
        at, end = m.span()
        while at <= end - LEAST:
            e = max((at + len(x) for x in found.get(text[at : at + LEAST], ()) if text.startswith(x, at, end)), default=at)
            if e > at and not taken.holds(at, e):
                out.append(("novel", at, e))
            at = max(e, at + 1)
    return out


def redacted(text: str, spans: list[tuple[str, int, int]], mark: str = "[secret]") -> str:
    """The text with each run of covered characters replaced by the mark."""
    out, at = [], 0
    for a, e in sorted((s, t) for _, s, t in spans):
        if e <= at:
            continue
        if a >= at:
            out += [text[at:a], mark]
        at = e
    return "".join([*out, text[at:]])


def secret_scan(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), bits: float = BITS, primer: str | None = None) -> DataFrame:
    """The kept columns and base, spans (arrays of kind, start, end; spans: base and novel), redacted (the text without them) for each row of docs (column text).
    primer: the dictionary, by default that of docs."""
    tune(docs.sparkSession)
    primer = dictionary(docs) if primer is None else primer
    docs = docs.select(*keep, F.col("text").cast("string").alias("_scanned"))
    found = T.ArrayType(T.StructType.fromDDL(FIELDS))
    out = T.StructType([*docs.schema.fields[:-1], T.StructField("base", found), T.StructField("spans", found), T.StructField("redacted", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(primer)
        for b in batches:
            for chunk in K.chunks(b, len(keep)):
                base, spans, clean = [], [], []
                for text in chunk.column(len(keep)).to_pylist():
                    found = base_spans(text) if text else []
                    more = novel_spans(text, found, novelty, bits) if text else []
                    base.append(ordered(found, KINDS))
                    spans.append(ordered(found + more, KINDS))
                    clean.append(redacted(text, found + more) if found or more else text)
                yield pa.RecordBatch.from_arrays([*chunk.columns[: len(keep)], pa.array(base, TYPE), pa.array(spans, TYPE), pa.array(clean, pa.string())], [*keep, "base", "spans", "redacted"])

    return docs.mapInArrow(K.lean(run), out)
