"""Candidates: prompts, providers, the offline generator, hygiene, grounding, verification and round trip.

A provider is a function from a batch to a batch; it runs in mapInPandas. The offline one is expressions
alone. Persist what a provider returned before counting it: calls cost, and needn't repeat themselves.
"""

from __future__ import annotations

import hashlib
import json
import random
import re
import time
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx

QTYPES = ["factoid", "reasoning", "comparison", "methodological", "quantitative"]
DIFFICULTIES = ["easy", "medium", "hard"]
ITEM = "struct<question:string,answer:string,evidence_span:string,qtype:string,difficulty:string>"

VERDICT = "struct<answerable:boolean,supported:boolean,self_contained:boolean,reason:string>"

GENERATE = "Write up to {k} questions that the passage below answers without further sources. Reply with JSON: items of question, answer, evidence_span (copied from the passage), qtype, difficulty.\nSection: {section}\n<passage>\n{passage}\n</passage>"
VERIFY = "Say whether the passage answers the question, supports the answer, and whether the question stands by itself. Reply with JSON: answerable, supported, self_contained, reason.\n<passage>\n{passage}\n</passage>\nQuestion: {question}\nAnswer: {answer}"
ANSWER = "Reply to the question from the passage alone, or with UNANSWERABLE.\n<passage>\n{passage}\n</passage>\nQuestion: {question}"


@dataclass(frozen=True)
class Config:
    min_chars: int = 200
    max_chars: int = 1500
    per_unit: int = 3
    grounding: float = 0.85
    verify: bool = True
    round_trip: bool = True
    round_trip_f1: float = 0.4
    jaccard: float = 0.8
    train: float = 0.7
    dev: float = 0.1
    seed: int = 42
    pace: float = 0.0

    def sha256(self) -> str:
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True).encode()).hexdigest()


def fill(template: str, **columns: Column) -> Column:
    """A prompt with columns in its places."""
    out = F.lit(template)
    for name, c in columns.items():
        out = F.replace(out, F.lit("{" + name + "}"), c.cast("string"))
    return out


def reasoning_options(effort: str = "none", extra: str | None = None) -> dict:
    """Checked options of a model service; extra: a JSON object."""
    if effort not in ("none", "low", "medium", "high"):
        raise ValueError(f"unknown reasoning effort: {effort}")
    body = json.loads(extra) if extra else {}
    if not isinstance(body, dict):
        raise ValueError("extra body must be a JSON object")
    return {"reasoning_effort": effort, **body}


def model_settings(env: dict[str, str], prefix: str, fallback: str = "LLM") -> dict:
    """Settings <prefix>_<name>, else <fallback>_<name>; numbers that can't be read are left out."""
    out: dict = {}
    for name, kind in (("MODEL", str), ("BASE_URL", str), ("API_KEY", str), ("TEMPERATURE", float), ("MAX_TOKENS", int), ("TIMEOUT", float)):
        value = env.get(f"{prefix}_{name}") or env.get(f"{fallback}_{name}")
        if value:
            try:
                out[name.lower()] = kind(value)
            except ValueError:
                pass
    return out


def with_retries(call: Callable, transient: tuple[type[BaseException], ...], attempts: int = 6, wait: Callable[[float], None] = time.sleep) -> Callable:
    """call, repeated after transient errors; an error's retry_after (seconds) sets the pause, else it doubles up to 30 s."""

    def run(*args):
        for n in range(attempts):
            try:
                return call(*args)
            except transient as e:
                if n == attempts - 1:
                    raise
                after = getattr(e, "retry_after", None)
                wait(after + 0.5 if after is not None else min(2.0**n, 30.0))

    return run


def ask(requests: DataFrame, provider: Callable[[pd.Series], pd.DataFrame], keys: list[str], pace: float = 0.0) -> DataFrame:
    """keys, reply, input_tokens, output_tokens, error for the `prompt` of each row. provider: prompts to a frame of reply and, if it has them, token counts; if it fails, its rows carry the error. pace: seconds before each prompt, which then goes alone."""

    def paced(prompt: pd.Series) -> pd.DataFrame:
        time.sleep(pace)
        return provider(prompt)

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = frame[keys].copy()
            try:
                if pace:
                    got = pd.concat([paced(frame["prompt"].iloc[[k]]) for k in range(len(frame))], ignore_index=True) if len(frame) else provider(frame["prompt"])
                else:
                    got = provider(frame["prompt"])
                out["reply"] = got["reply"].to_numpy()
                for c in ("input_tokens", "output_tokens"):
                    out[c] = got[c].to_numpy() if c in got else 0
                out["error"] = None
            except Exception as e:  # noqa: BLE001
                out["reply"], out["input_tokens"], out["output_tokens"], out["error"] = None, 0, 0, f"{type(e).__name__}: {e}"
            yield out

    fields = ", ".join(f"{k} {requests.schema[k].dataType.simpleString()}" for k in keys)
    return requests.select(*keys, "prompt").mapInPandas(work, f"{fields}, reply string, input_tokens long, output_tokens long, error string")


def usage(replies: DataFrame) -> DataFrame:
    return replies.agg(F.count("*").alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))


def parse_items(reply: Column) -> Column:
    """Items of a reply: its JSON without code fences, else its outermost list, else its outermost object; null if there is none, or one item isn't whole."""
    bare = tx.strip(F.regexp_replace(reply, r"(?m)^\s*```[a-zA-Z]*\s*$", ""))
    tries = [bare, F.regexp_extract(bare, r"(?s)(\[.*\])", 1), F.regexp_extract(bare, r"(?s)(\{.*\})", 1)]

    def of(c: Column) -> Column:
        there = F.json_object_keys(c).isNotNull() | F.json_array_length(c).isNotNull()
        return F.when(there & c.startswith("["), F.from_json(c, f"array<{ITEM}>")).when(there, F.from_json(c, f"struct<items:array<{ITEM}>>")["items"])

    items = F.coalesce(*[of(t) for t in tries])
    whole = F.forall(items, lambda x: x.question.isNotNull() & x.answer.isNotNull() & x.evidence_span.isNotNull() & x.qtype.isin(QTYPES) & x.difficulty.isin(DIFFICULTIES))
    return F.when(whole, items)


def http_provider(settings: dict, options: dict | None = None, structured: bool = True) -> Callable[[pd.Series], pd.DataFrame]:
    """A provider that posts each prompt to a chat service of the usual kind (base_url, api_key, model; temperature, max_tokens, timeout)."""
    if not settings.get("base_url") or not settings.get("api_key"):
        raise ValueError("a model service needs base_url and api_key")
    body = {"model": settings.get("model", "default"), "temperature": settings.get("temperature", 0.7), "max_tokens": settings.get("max_tokens", 4096), **(options or {})}
    if structured:
        body["response_format"] = {"type": "json_object"}

    def one(prompt: str) -> tuple[str, int, int]:
        import urllib.error
        import urllib.request

        data = json.dumps({**body, "messages": [{"role": "user", "content": prompt}]}).encode()
        request = urllib.request.Request(settings["base_url"].rstrip("/") + "/chat/completions", data, {"Authorization": f"Bearer {settings['api_key']}", "Content-Type": "application/json"})
        try:
            with urllib.request.urlopen(request, timeout=settings.get("timeout", 600)) as answer:
                got = json.load(answer)
        except urllib.error.HTTPError as e:
            if e.code not in (429, 500, 502, 503, 504):
                raise
            again = Transient(f"status {e.code}")
            after = e.headers.get("Retry-After", "")
            if after.isdigit():
                again.retry_after = float(after)
            raise again from e
        except (urllib.error.URLError, TimeoutError) as e:
            raise Transient(str(e)) from e
        used = got.get("usage") or {}
        return got["choices"][0]["message"]["content"], used.get("prompt_tokens", 0), used.get("completion_tokens", 0)

    call = with_retries(one, (Transient,))

    def provider(prompts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([call(p) for p in prompts], columns=["reply", "input_tokens", "output_tokens"])

    return provider


class Transient(Exception):
    """An error after which a call is worth repeating; retry_after: seconds that the service asks for."""

    retry_after: float | None = None


def offline_provider(prompts: pd.Series) -> pd.DataFrame:
    """Replies to the three prompts by the rules of the offline generator, for runs without a service."""
    replies = []
    for p in prompts:
        passage = re.search(r"(?s)<passage>\n(.*)\n</passage>", p)[1].strip()
        long = [s.strip() for s in re.split(r"(?<=[.!?])\s+", passage) if len(s.strip()) > 40]
        if p.startswith("Write"):
            items = [
                {"question": f'According to the passage, what is stated in: "{s[:60]}..."?', "answer": s, "evidence_span": s, "qtype": "reasoning" if n else "factoid", "difficulty": "medium" if n else "easy"}
                for n, s in enumerate(long[:2])
            ]
            replies.append(json.dumps({"items": items}, ensure_ascii=False))
        elif p.startswith("Say"):
            replies.append('{"answerable": true, "supported": true, "self_contained": true, "reason": "offline"}')
        else:
            replies.append(long[0] if long else "UNANSWERABLE")
    return pd.DataFrame({"reply": replies, "input_tokens": [len(p) // 4 for p in prompts], "output_tokens": [len(r) // 4 for r in replies]})


def long_sentences(passage: Column) -> Column:
    return F.filter(F.transform(F.split(passage, r"(?U)(?<=[.!?])\s+"), tx.strip), lambda s: F.length(s) > 40)


def offline_candidates(units: DataFrame) -> DataFrame:
    """Two candidates at most of each unit (unit_id, doc_id, section, text, source_start, source_end): its first long sentences as their own answers. reply: what the offline answerer says, the first of them."""
    picked = units.withColumn("sentences", F.slice(long_sentences(tx.strip(F.col("text"))), 1, 2))
    rows = picked.select("*", F.get("sentences", F.lit(0)).alias("reply"), F.posexplode("sentences").alias("item", "answer")).drop("sentences")
    first = F.col("item") == 0
    question = F.concat(F.lit('According to the passage, what is stated in: "'), F.substring("answer", 1, 60), F.lit('..."?'))
    return rows.select("*", question.alias("question"), F.col("answer").alias("evidence_span"), F.when(first, "factoid").otherwise("reasoning").alias("qtype"), F.when(first, "easy").otherwise("medium").alias("difficulty"))


def offline_answer(passage: Column) -> Column:
    return F.coalesce(F.try_element_at(long_sentences(tx.strip(passage)), F.lit(1)), F.lit("UNANSWERABLE"))


def offline_verdict() -> Column:
    return F.struct(F.lit(True).alias("answerable"), F.lit(True).alias("supported"), F.lit(True).alias("self_contained"), F.lit("offline").alias("reason"))


SELF_REFERENCE = (
    r"(?iU)\b(?:our|the present|this)\s+(?:article|paper|review|study|work)\b|\bthe authors\b|\bwe (?:describe|present|report|show)\b"
    r"|\bfigures?\s+s?\d|\btables?\s+s?\d|\bschemes?\s+\d|\beq\.?\s*\("
)
CJK = r"[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{F900}-\x{FAFF}]"


def hygiene_errors(question: Column, answer: Column) -> Column:
    """What is wrong with a candidate, in order."""
    q, a = tx.word_count(question), tx.word_count(answer)
    return F.array_compact(
        F.array(
            F.when((q < 5) | (q > 40), "question length"), F.when(~tx.strip(question).endswith("?"), "question mark"), F.when(question.rlike(SELF_REFERENCE), "self-reference"),
            F.when((a < 1) | (a > 120), "answer length"), F.when(question.rlike(CJK) | answer.rlike(CJK), "non-English"),
            F.when(F.lower(tx.strip(answer)).isin("yes", "no", "yes.", "no.", "nan", "none", "n/a"), "trivial answer"),
        )
    )


def _matched_share():
    """Characters of a span in matching blocks of a text, over its length; the blocks are difflib's without its junk. Made in here, it goes to workers by value, which needn't have this package."""

    def longest(s: str, t: str, alo: int, ahi: int, blo: int, bhi: int) -> tuple[int, int, int]:
        """Start in s, start in t and length of the longest common run; of equal ones the first in s, then in t. Runs are looked up, so a text costs no step of Python for each of its letters."""
        a = b = best = 0
        i = alo
        while i + best < ahi:
            j = t.find(s[i : i + best + 1], blo, bhi)
            while j >= 0:
                n = best + 1
                while i + n < ahi and j + n < bhi and s[i + n] == t[j + n]:
                    n += 1
                a, b, best = i, j, n
                j = t.find(s[i : i + best + 1], j + 1, bhi) if i + best < ahi else -1
            i += 1
        return a, b, best

    def matched(s: str, t: str) -> int:
        total, ranges = 0, [(0, len(s), 0, len(t))]
        while ranges:
            alo, ahi, blo, bhi = ranges.pop()
            a, b, n = longest(s, t, alo, ahi, blo, bhi)
            if n:
                total += n
                ranges += [(alo, a, blo, b), (a + n, ahi, b + n, bhi)]
        return total

    def share(span: pd.Series, text: pd.Series) -> pd.Series:
        return pd.Series([matched(s, t) / len(s) if s else 0.0 for s, t in zip(span, text)], dtype=float)  # null: not asked

    share.__annotations__ = {"span": pd.Series, "text": pd.Series, "return": pd.Series}
    return F.pandas_udf(share, T.DoubleType())


matched_share = _matched_share()


def grounding_ratio(span: Column, passage: Column) -> Column:
    s, t = tx.norm(span), tx.norm(passage)
    return F.when(s == "", 0.0).when(t.contains(s), 1.0).otherwise(matched_share(s, t))


def check_candidates(candidates: DataFrame, threshold: float = 0.85) -> DataFrame:
    """candidates (question, answer, evidence_span, text, source_start) with errors, drop (null: kept), evidence_start, evidence_end.

    A candidate is kept if it is clean and its span isn't blank and stands in the passage, which makes its
    ratio 1. So blocks are matched only for clean ones without their span, to name the reason, and
    for those whose lower case differs from what is contained; the others go past as nulls.
    """
    rows = candidates.withColumns({"errors": hygiene_errors(F.col("question"), F.col("answer")), "at": F.expr("locate(evidence_span, text)")})
    # A span that stands in the text does so in lower case, unless it ends with a letter whose lower case depends on the next one.
    verbatim = F.coalesce((F.col("at") > 0) & ~F.col("evidence_span").contains("Σ"), F.lit(False))
    clean = F.size("errors") == 0
    rows = rows.withColumns({"__span": F.when(clean, tx.norm(F.col("evidence_span"))), "__text": F.when(clean & ~verbatim, tx.norm(F.col("text")))})
    rows = rows.withColumn("ratio", F.when(~clean, F.lit(None).cast("double")).when(F.col("__span") == "", 0.0).when(verbatim | F.col("__text").contains(F.col("__span")), 1.0).otherwise(-1.0))
    asked = F.col("ratio") == -1
    share = matched_share(F.when(asked, F.col("__span")), F.when(asked, F.col("__text")))
    rows = rows.withColumn("ratio", F.when(asked, share).otherwise(F.col("ratio")))
    found = (F.col("at") > 0) | (F.length("evidence_span") == 0)
    extra = F.array_compact(F.array(F.when(F.col("ratio") < threshold, F.concat(F.lit("grounding "), F.format_string("%.2f", "ratio"))), F.when(~found, "evidence offset")))
    out = rows.withColumn("errors", F.concat("errors", extra))
    out = out.withColumn("drop", F.when(F.size("errors") > 0, F.concat(F.lit("drop_"), F.split(F.get("errors", F.lit(0)), " ")[0])))
    start = F.when(F.col("drop").isNull(), F.col("source_start") + F.col("at") - 1)
    return out.withColumns({"evidence_start": start, "evidence_end": start + F.length("evidence_span")}).drop("at", "ratio", "__span", "__text")


def verified(candidates: DataFrame, verdict: Column) -> DataFrame:
    """With drop set for those whose verdict isn't good throughout."""
    v = F.struct(verdict.alias("v"))["v"]
    return candidates.withColumn("drop", F.coalesce("drop", F.when(~(v["answerable"] & v["supported"] & v["self_contained"]), "drop_verification"))).withColumn("verifier_reason", v["reason"])


def round_trip(candidates: DataFrame, reply: Column, least: float = 0.4) -> DataFrame:
    """With drop set for those whose answer isn't found again, and roundtrip_f1."""
    f1 = tx.token_f1(tx.content_tokens(F.col("answer")), tx.content_tokens(reply))
    bad = reply.contains("UNANSWERABLE") | (f1 < least)
    return candidates.withColumn("drop", F.coalesce("drop", F.when(bad, "drop_roundtrip"))).withColumn("roundtrip_f1", F.round(f1, 3))


def generate(units: DataFrame, generator: Callable, verifier: Callable | None = None, config: Config = Config(), save: Callable[[DataFrame], DataFrame] = lambda df: df.persist()) -> tuple[DataFrame, DataFrame]:
    """Candidates of units (unit_id, doc_id, section, text, source_start, source_end) by model services, checked; and every reply with its use of tokens.

    generator and verifier (by default the same) are providers for `ask`. Candidates that are dropped cost no further call.
    A unit whose call fails or whose reply can't be read has one row without a question and drop_generation; a verdict
    or an answer that fails drops its candidate as drop_verification or drop_roundtrip. save: keeps what was
    paid for, a checkpoint where the run is long; each of the three kinds of calls is saved once it is made.
    """
    verifier = verifier or generator
    columns = ["unit_id", "doc_id", "section", "text", "source_start", "source_end"]
    requests = units.select(*columns, fill(GENERATE, k=F.lit(config.per_unit), section=F.coalesce("section", F.lit("")), passage=F.col("text")).alias("prompt"))
    replies = save(ask(requests, generator, columns, config.pace))
    calls = [replies]
    items = F.filter(F.coalesce(parse_items(F.col("reply")), F.array().cast(f"array<{ITEM}>")), lambda x: x.isNotNull())
    failed_ = F.col("error").isNotNull() | parse_items(F.col("reply")).isNull()
    rows = replies.withColumn("failed", failed_).select(*columns, "failed", F.posexplode_outer(items).alias("item", "x")).where("failed OR x IS NOT NULL")
    rows = rows.select(*columns, "failed", "item", "x.*")
    checked = check_candidates(rows.where("NOT failed").drop("failed"), config.grounding)
    lost = rows.where("failed").drop("failed").withColumns({"errors": F.array(F.lit("generation")), "drop": F.lit("drop_generation"), "evidence_start": F.lit(None).cast("int"), "evidence_end": F.lit(None).cast("int")})
    checked = checked.unionByName(lost)
    key = ["unit_id", "item"]
    for wanted, template, structured in ((config.verify, VERIFY, True), (config.round_trip, ANSWER, False)):
        if not wanted:
            continue
        checked = save(checked)
        fields = {"passage": F.col("text"), "question": F.col("question")} | ({"answer": F.col("answer")} if structured else {})
        got = save(ask(checked.where("drop IS NULL").select(*key, fill(template, **fields).alias("prompt")), verifier, key, config.pace))
        calls.append(got)
        with_reply = checked.join(got.select(*key, F.col("reply").alias("__reply")), key, "left")
        if structured:
            verdict = F.from_json(F.regexp_extract("__reply", r"(?s)(\{.*\})", 1), VERDICT)
            sure = F.struct(*[F.coalesce(verdict[c], F.lit(False)).alias(c) for c in ("answerable", "supported", "self_contained")], verdict["reason"].alias("reason"))
            checked = verified(with_reply, sure).drop("__reply")
        else:
            checked = round_trip(with_reply, F.coalesce("__reply", F.lit("UNANSWERABLE")), config.round_trip_f1).drop("__reply")
    used = calls[0].select("input_tokens", "output_tokens", "error")
    for c in calls[1:]:
        used = used.unionByName(c.select("input_tokens", "output_tokens", "error"))
    return checked, used


def funnel(checked: DataFrame) -> DataFrame:
    """stage, n: generated, after_deterministic_qc, kept, and each reason to drop."""
    late = F.coalesce(F.col("drop").isin("drop_verification", "drop_roundtrip"), F.lit(True))
    # One count by reason; the stages are sums of its few rows.
    by = checked.groupBy("drop").agg(F.count("*").alias("c"))
    of = lambda stage, condition: F.when(condition, F.struct(F.lit(stage).alias("stage"), F.col("c").alias("n")))
    parts = F.array_compact(F.array(of("generated", F.lit(True)), of("after_deterministic_qc", late), of("kept", F.col("drop").isNull()), F.when(F.col("drop").isNotNull(), F.struct(F.col("drop").alias("stage"), F.col("c").alias("n")))))
    none = checked.sparkSession.range(1).select(F.explode(F.array(*[F.struct(F.lit(s).alias("stage"), F.lit(0).cast("long").alias("n")) for s in ("generated", "after_deterministic_qc", "kept")])).alias("x"))
    return by.select(F.explode(parts).alias("x")).unionByName(none).groupBy("x.stage").agg(F.sum("x.n").alias("n"))


def records(checked: DataFrame, sha256: Column, provenance: dict[str, str]) -> DataFrame:
    """Kept candidates as records: 14 fields, provenance, and what verification and round trip left."""
    kept = checked.where("drop IS NULL")
    optional = [c for c in ("verifier_reason", "roundtrip_f1") if c in checked.columns]
    return kept.select(
        tx.strip(F.col("question")).alias("question"), tx.strip(F.col("answer")).alias("answer"), F.col("text").alias("context"), tx.strip(F.col("evidence_span")).alias("evidence_span"),
        F.col("unit_id").alias("evidence_unit_id"), "doc_id", "section", sha256.alias("source_sha256"), F.col("source_start").alias("context_start"), F.col("source_end").alias("context_end"),
        "evidence_start", "evidence_end", "qtype", "difficulty", *[F.lit(v).alias(k) for k, v in provenance.items()], *optional,
    )


def provenance(config: Config, run_id: str, generator: str, verifier: str, options: dict | None = None) -> dict[str, str]:
    def sha(x: str) -> str:
        return hashlib.sha256(x.encode()).hexdigest()

    return {
        "run_id": run_id, "generator_model": generator, "verifier_model": verifier, "config_sha256": config.sha256(), "generation_prompt_sha256": sha(GENERATE),
        "reasoning_effort": (options or {}).get("reasoning_effort", "none"), "extra_body_sha256": sha(json.dumps({k: v for k, v in (options or {}).items() if k != "reasoning_effort"}, sort_keys=True)),
    }


def shuffled(ids: list, seed: int) -> list:
    ids = list(ids)
    random.Random(seed).shuffle(ids)
    return ids
