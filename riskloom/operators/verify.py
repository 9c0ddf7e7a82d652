"""Verdicts from a model or from static rules: requests, cache, replies, translation, halting."""

from __future__ import annotations

import json
import re
import threading
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as X
from ..functions.storage import cut

FINDING = "reachable string, sanitized boolean, confidence int, reasoning string, exploit_scenario string, remediation string"
ATTEMPTS = 4


def requests(candidates: DataFrame, model: str, prompt: Column | None = None) -> DataFrame:
    """Candidates that need a model, with prompt and cache key."""
    prompt = F.concat(F.lit("verify "), "dedup_key") if prompt is None else prompt
    return candidates.where("verification_mode <> 'static'").withColumn("prompt", prompt).withColumn("key", F.sha2(F.concat(F.lit(model + ":"), "prompt"), 256))


def misses(asked: DataFrame, cache: DataFrame) -> DataFrame:
    return asked.join(cache.select("key"), "key", "left_anti")


def static_verdicts(candidates: DataFrame) -> DataFrame:
    """Candidates with a finding where the rule alone decides, and null elsewhere."""
    finding = F.struct(F.lit("yes").alias("reachable"), X.static_confidence(F.col("confidence")).alias("confidence"), F.lit("static rule").alias("reasoning"), F.lit("static").alias("verdict_kind"))
    return candidates.withColumn("finding", F.when(F.col("verification_mode") == "static", finding))


def json_object(reply: str | None) -> dict:
    """The JSON object in a model's reply, with or without code fences; ValueError if it holds none."""
    found = json.loads(re.sub(r"^```(?:json)?\s*|\s*```$", "", (reply or "").strip()))
    if not isinstance(found, dict):
        raise ValueError("the reply is no JSON object")
    return found


def parse_replies(df: DataFrame, reply: str = "reply") -> DataFrame:
    """df with the finding in a model's reply; a reply that is no JSON object is an uncertain finding that says so."""
    parsed = F.from_json(X.without_fences(F.col(reply)), FINDING)
    failed = F.from_json(F.lit('{"reachable": "uncertain", "confidence": 0, "reasoning": "verifier_failed: reply is not JSON"}'), FINDING)
    return df.withColumn("finding", F.when(parsed["reachable"].isNotNull(), parsed).otherwise(failed))


# Replies of a provider that may be gone at the next attempt, and the ladder of waits.
TRANSIENT = (429, 500, 502, 503, 504, 529)
BASE_WAIT, MOST_WAIT = 2.0, 30.0


def waits(attempts: int, base: float = BASE_WAIT, most: float = MOST_WAIT) -> list[float]:
    """Seconds before each attempt: none before the first, then base, doubling, at most most."""
    return [0.0, *(min(most, base * 2.0**i) for i in range(attempts - 1))]


EXCHANGE = 1.0  # seconds between two exchanges of tasks
OUTCOMES = ("replied", "refused", "unparsed", "exhausted", "not asked")


def ask_each(
    requests_: DataFrame, provider: Callable[[], Callable[[str], str]], concurrency: int = 5, attempts: int = ATTEMPTS, base_wait: float = BASE_WAIT, wave: int = 200,
    parse: Callable[[str], object] | None = None, hint: str = "Reply with JSON only.",
) -> DataFrame:
    """requests_ (column prompt) with ``reply`` and ``said``, one of OUTCOMES, in one job however many requests there are.

    provider makes a chat function in each task; concurrency calls are in flight at a time, dealt over tasks and threads.  A call that loses
    its connection, or is answered with a status of TRANSIENT (the exception's ``status``), is tried again after a wait (its
    ``retry_after``, if it has one); any other error leaves a null reply at once (refused).  A reply that parse can't take (ValueError) is asked
    for once more, with the hint behind the prompt, and is null if that fails too (unparsed).

    **Halt.**  A call that fails to its last attempt (exhausted) halts everything: its task asks no more, so no more calls fail than are in flight at a
    time, and tasks tell each other at barriers, one about every second, while their calls go on: no request waits for an exchange, however many waves of
    ``wave`` requests there are.  All others stop with the call they are in when they learn of it.  What is left has a null reply (not asked).  A lost
    executor starts the stage anew.  An empty table asks nothing."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in requests_.schema.fields)
    tasks = max(1, min(concurrency, requests_.sparkSession.sparkContext.defaultParallelism))
    threads, step = -(-concurrency // tasks), max(1, wave // tasks)

    def run(batches: Iterator) -> Iterator:
        from pyspark import BarrierTaskContext

        together, chat, halted = BarrierTaskContext.get(), provider(), threading.Event()

        def once(text: str) -> tuple[str | None, str]:
            after = None
            for wait in waits(attempts, base_wait):
                time.sleep(min(MOST_WAIT, wait if after is None else after))
                if halted.is_set():
                    return None, "not asked"
                try:
                    return chat(text), "replied"
                except Exception as e:
                    status, after = getattr(e, "status", None), getattr(e, "retry_after", None)
                    if not isinstance(e, ConnectionError | TimeoutError) and status not in TRANSIENT:
                        return None, "refused"
            halted.set()
            return None, "exhausted"

        def whole(text: str) -> tuple[str | None, str]:
            for sent in (text, f"{text}\n\n{hint}"):
                reply, said = once(sent)
                if said != "replied" or parse is None:
                    return reply, said
                try:
                    parse(reply)
                    return reply, said
                except ValueError:
                    continue
            return None, "unparsed"

        ended = threading.Event()

        def tell() -> None:
            """Exchanges beside the calls, until no task has more or one has halted: all tasks learn of that in one and the same exchange, their last."""
            while True:
                said = together.allGather(f"{'end' if ended.is_set() else 'more'} {halted.is_set()}")
                if any(x.endswith("True") for x in said):
                    return halted.set()
                if all(x.startswith("end") for x in said):
                    return None
                ended.wait(EXCHANGE)

        with ThreadPoolExecutor(1) as beside, ThreadPoolExecutor(threads) as pool:
            told = beside.submit(tell)
            try:
                for pdf in batches:
                    for at in range(0, len(pdf), step):
                        some = pdf.iloc[at : at + step]
                        done = list(pool.map(whole, some["prompt"]))
                        yield some.assign(reply=[r for r, _ in done], said=[x for _, x in done])
            except BaseException:
                halted.set()
                raise
            finally:
                ended.set()
            told.result()

    # written at once: what has been asked is never asked again by a second reading of the result
    return cut(requests_.repartition(tasks).mapInPandas(run, f"{schema}, reply string, said string", barrier=True), "replies")


def ask(requests_: DataFrame, provider: Callable[[], Callable[[str], str]], concurrency: int = 5, attempts: int = ATTEMPTS, base_wait: float = BASE_WAIT, wave: int = 200) -> DataFrame:
    """As ask_each, without saying what became of each request."""
    return ask_each(requests_, provider, concurrency, attempts, base_wait, wave).drop("said")


CACHE = "key string, reply string, part string"


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """key, reply of the cache at path, which is created where it is not there."""
    spark.createDataFrame([], CACHE).write.partitionBy("part").mode("append").parquet(path)
    return spark.read.schema(CACHE).parquet(path)


def merge_cache(spark: SparkSession, path: str, replies: DataFrame) -> int:
    """Adds replies (key, reply) that the cache does not hold yet, and returns how many.

    The cache is a table of files by the first two digits of the key.  What is new is settled in the shared folder first (of several replies to one
    key the smallest), then added by one append, which Spark commits as a whole: a run that dies before leaves the cache as it was, and one
    that is repeated finds nothing new.  Null keys and null replies are not kept.  Keys that are there are never changed."""
    known = read_cache(spark, path).select("key")
    new = replies.where("key IS NOT NULL AND reply IS NOT NULL").groupBy("key").agg(F.min("reply").alias("reply")).join(known, "key", "left_anti")
    new = cut(new.withColumn("part", F.substring("key", 1, 2)), "merge")
    added = new.count()
    if added:
        new.repartition("part").write.partitionBy("part").mode("append").parquet(path)
    return added


def ask_cached(requests_: DataFrame, path: str, provider: Callable[[], Callable[[str], str]], **how) -> tuple[DataFrame, dict]:
    """requests_ (key, prompt) with ``reply``, from the cache at path where it has it; the rest is asked, once for each key, and written through.  Beside
    the rows: how many keys were asked, and how many calls had each outcome.  The key is that of the prompt, never of a hint that was added."""
    spark = requests_.sparkSession
    open_ = misses(requests_.groupBy("key").agg(F.min("prompt").alias("prompt")), read_cache(spark, path))
    asked = ask_each(open_, provider, **how)
    merge_cache(spark, path, asked.select("key", "reply"))
    told = {"asked": 0, **dict.fromkeys(OUTCOMES, 0)} | {r.said: r["n"] for r in asked.groupBy("said").agg(F.count("*").alias("n")).collect()}
    told["asked"] = sum(told[x] for x in OUTCOMES)
    return requests_.join(read_cache(spark, path).select("key", "reply"), "key", "left"), told


PROSE = ["reasoning", "exploit_scenario", "remediation"]


def finding_language(finding: str = "finding") -> Column:
    """One language for a finding's free texts together, so that a word of one can't outvote a paragraph of another."""
    return X.language(F.concat_ws(" ", *[F.coalesce(F.col(f"{finding}.{c}"), F.lit("")) for c in PROSE]))


def needs_translation(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.where(F.exists(F.array(*columns), lambda x: X.strip(F.coalesce(x, F.lit(""))) != ""))


def apply_translation(df: DataFrame, column: str, translated: str, target: str, original: str) -> DataFrame:
    """df with column_target (the translation, or the original where it is blank) and column_original."""
    text = X.strip(F.coalesce(F.col(translated), F.lit("")))
    return df.withColumn(f"{column}_{target}", F.when(text != "", text).otherwise(F.col(column))).withColumn(f"{column}_{original}", F.col(column))


def valid_translation(original: Column, translated: Column, target: str) -> Column:
    """Not blank, in the target language, and not an echo of the original."""
    return (X.strip(F.coalesce(translated, F.lit(""))) != "") & X.is_language(translated, target) & (translated != original)
