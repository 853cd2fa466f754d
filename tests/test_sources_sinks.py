from __future__ import annotations

import csv
import json
import threading
import time
import uuid
from functools import partial
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from evisift import cli, sinks, storage
from evisift.plans.answering import traces
from evisift.plans.domains import DOMAINS
from evisift.sources.config import ModelSettings, model_settings, read_env
from evisift.sources.documents import files, html_documents, listing, load_documents, manifest, pdf_documents, read_questions, referenced, referenced_ids
from evisift.sources.ledger import Ledger
from evisift.sources.model import Calling, call_model, http_client
from evisift.streaming.questions import answer_stream, question_stream

QUESTIONS = [{"qid": f"q{i}", "domain": "research", "split": "A" if i < 3 else "B", "question": "x", "options": {"A": "a", "B": "b"}, "answer_format": "mcq", "type": "t"} | ({"doc_ids": ["b", "a"]} if i == 1 else {}) for i in range(4)]


@pytest.fixture
def folder(tmp_path):
    d = tmp_path / "docs"
    d.mkdir()
    (d / "a.txt").write_bytes("﻿甲\t 乙\n\n\n\n丙".encode() + b"\xff")
    (d / "a.html").write_text("<p>h</p>")
    (d / "b.html").write_text("<html><script>no</script><p>B &amp; C</p></html>")
    (d / "c.pdf").write_bytes(b"one\x0c \x0ctwo")
    (tmp_path / "q.json").write_text(json.dumps(QUESTIONS))
    return tmp_path


def pages(content):
    return content.decode().split("\x0c")


def test_manifest_and_load(spark, folder):
    docs = str(folder / "docs")
    found = manifest(listing(spark, docs, "regulatory"), True)
    assert [(r.doc_id, r.source_type, r.doc_seq) for r in found.orderBy("doc_id").collect()] == [("a", "txt", 1), ("b", "html", 2), ("c", "pdf", 3)]
    other = manifest(listing(spark, docs, "x"), False)
    assert {r.doc_id: r.source_type for r in other.collect()}["a"] == "txt"  # the last path
    got = {r.doc_id: (r.text, r.page_count) for r in load_documents(spark, found, docs, pages).collect()}
    assert got == {"a": ("甲 乙\n\n丙", None), "b": ("B & C", None), "c": ("[PAGE 1]\none\n\n[PAGE 3]\ntwo", 3)}
    assert html_documents(files(spark, docs, "b.html"), exact=True).first().text == "B & C"
    with pytest.raises(Exception, match="pypdf"):
        pdf_documents(files(spark, docs, "c.pdf")).collect()


def test_unknown_type_is_an_error(spark, folder):
    (folder / "docs/z.doc").write_text("x")
    docs = str(folder / "docs")
    with pytest.raises(Exception, match="unsupported source type: doc"):
        load_documents(spark, manifest(listing(spark, docs, "x"), False), docs, pages).collect()


def test_questions(spark, folder):
    path = str(folder / "q.json")
    assert [(r.qid, r.doc_ids) for r in read_questions(spark, path, "A", limit=2).orderBy("ord").collect()] == [("q0", []), ("q1", ["b", "a"])]
    refs = referenced_ids(read_questions(spark, path))
    assert [r.doc_id for r in refs.collect()] == ["a", "b"]
    found = manifest(listing(spark, str(folder / "docs"), "x"), False)
    assert referenced(found, refs).count() == 2 and referenced(found, refs.limit(0)).count() == 3


def test_config(tmp_path, monkeypatch):
    (tmp_path / ".env").write_text("# c\nLLM_MODEL='m'\nLLM_API_BASE=http://x\n")
    monkeypatch.delenv("LLM_API_KEY", raising=False)
    assert model_settings(read_env(tmp_path / ".env")) is None
    monkeypatch.setenv("LLM_API_KEY", "secret")
    got = model_settings(read_env(tmp_path / ".env"))
    assert got.model_name == "m" and "secret" not in got.public_json()


def answers(spark):
    return spark.createDataFrame([("q1", "A", "mcq", {"A": True}, "r", [("u",)], 5, 1, 6, (["a"],), 2), ("q0", "B", "tf", {"A": False}, "r", [], 1, 1, 2, ([],), 1)], "qid string, pred_answer string, question_type string, option_labels map<string,boolean>, reasoning_summary string, evidence_items array<struct<unit_id:string>>, prompt_tokens long, completion_tokens long, total_tokens long, debug_meta struct<doc_ids:array<string>>, ord int")


def test_sinks(spark, tmp_path):
    base = Path(sinks.run_layout(spark, str(tmp_path), "research_a_20260101_000000", "research", "a", question_count=2, resumed=False))
    about = json.loads((base / "meta/run_manifest.json").read_text())
    assert about["question_count"] == 2 and about["resumed"] is False and "Run research" in (base / "README.md").read_text()
    cli.export(answers(spark), str(base))
    assert json.loads((base / "outputs/debug/token_usage.json").read_text())["total_tokens"] == 8
    assert [r["qid"] for r in json.loads((base / "outputs/debug/answers.json").read_text())] == ["q0", "q1"]
    assert {q: e["pred_answer"] for q, e in json.loads((base / "outputs/debug/evidence.json").read_text()).items()} == {"q1": "A", "q0": "B"}
    with open(sinks.submission_path(spark, str(base))) as f:
        got = list(csv.reader(f))
    assert got[0] == ["qid", "answer", "prompt_tokens", "completion_tokens", "total_tokens"] and got[1] == ["summary", "", "6", "2", "8"] and [r[0] for r in got[2:]] == ["q0", "q1"]
    assert sorted(p.name for p in (base / "outputs/by_type/qids").glob("type=*")) == ["type=mcq", "type=tf"]
    old = tmp_path / "old"
    old.mkdir()
    with pytest.raises(FileNotFoundError):
        sinks.submission_path(spark, str(old))
    (old / "answer.csv").write_text("x")
    assert sinks.submission_path(spark, str(old)) == f"{old}/answer.csv"
    (old / "logs.jsonl").write_text("{}")
    (old / "answers.json").write_text(json.dumps([{"qid": "a", "question_type": "tf", "x": None}, {"qid": "b", "question_type": "mcq"}, {"qid": "c"}]))
    moved = sinks.migrate_runs(spark, str(tmp_path))
    assert len([m for m in moved if "/old/" in m[0]]) == 6 and sinks.migrate_layout(spark, str(old)) == []
    assert json.loads((old / "outputs/by_type/tf/answers.json").read_text()) == [{"qid": "a", "question_type": "tf", "x": None}] and (old / "outputs/debug/logs.jsonl").exists()
    assert sinks.submission_path(spark, str(old)) == f"{old}/outputs/submission/answer.csv"


def test_a_failed_job_leaves_no_file(spark, tmp_path):
    lines = spark.range(20).repartition(4).select(F.col("id").alias("place"), F.when(F.col("id") == 13, F.raise_error(F.lit("bad"))).otherwise(F.col("id").cast("string")).alias("line"))
    with pytest.raises(Exception, match="bad"):
        storage.one_file(lines, str(tmp_path / "out.json"), "[", ",", "]")
    assert list(tmp_path.iterdir()) == []
    for between, wanted in ((",", list(range(20))), ("", None)):
        storage.one_file(lines.select("place", F.col("place").cast("string").alias("line")), str(tmp_path / "out.json"), "[", between, "]")
        text = (tmp_path / "out.json").read_text()
        assert json.loads(text) == wanted if between else text.strip("[]").split() == [str(i) for i in range(20)]
    assert [p.name for p in tmp_path.iterdir() if p.suffix != ".crc"] == ["out.json"]


def test_stream(spark, folder, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/q.json").write_text(json.dumps(QUESTIONS))
    for _ in range(2):
        q = answer_stream(question_stream(spark, str(tmp_path / "in")), lambda df: df.select("qid"), str(tmp_path / "out"), str(tmp_path / "check"))
        q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4


def parsed(spark, folder):
    (folder / "docs/c.pdf").unlink()
    for name in ("research", "insurance"):
        cli.parse_domain(spark, name, str(folder / "docs"), str(folder / "q.json"), str(folder / f"parsed/{name}"))
    return str(folder / "parsed/research")


def test_cli_parse_and_traces(spark, folder):
    units = parsed(spark, folder)
    assert spark.read.parquet(f"{units}/units").count() == 2
    assert json.loads((folder / "parsed/research/counts.json").read_text())[-1] == {"n_units": 2, "n_docs": 2}
    d, q = DOMAINS["research"], read_questions(spark, str(folder / "q.json")).withColumn("question", F.lit("b c"))
    plain = traces(q, spark.read.parquet(f"{units}/units"), d).orderBy("qid").collect()
    cli.index_domain(spark, "research", units)
    assert traces(q, None or spark.read.parquet(f"{units}/units"), d, cli.kept_index(spark, units)).orderBy("qid").collect() == plain
    assert any(s.hits and s.hits[0].metadata is not None for r in plain for s in r.searches)
    for name in ("research", "insurance"):
        (folder / f"{name}_questions.json").write_text((folder / "q.json").read_text())
    cli.write_all_traces(spark, ["research", "insurance"], str(folder / "parsed"), str(folder), "A", str(folder / "traces"))
    assert spark.read.json(str(folder / "traces")).groupBy("domain").count().orderBy("domain").collect() == [("insurance", 3), ("research", 3)]
    assert json.loads((folder / "traces/_manifest.json").read_text())["domains"] == ["research", "insurance"]


def test_resume_after_a_crash(spark, folder, monkeypatch):
    """The client fails at the question q2: what was answered before is kept and not asked again."""
    units, calls = parsed(spark, folder), folder / "calls"
    calls.mkdir()
    ask = [{**q, "question": q["qid"]} for q in QUESTIONS]
    (folder / "q.json").write_text(json.dumps(ask))

    def client(broken):
        def make():
            def reply(messages):
                qid = messages[1]["content"].split("题目：")[1][:2]
                if broken and qid == "q2":
                    raise RuntimeError("down")
                (calls / uuid.uuid4().hex).write_text(qid)
                return json.dumps({"label": True, "answer": "A"}), {"total_tokens": 1}

            return reply

        return make

    run = f"file://{folder}/runs/research_a_20260101_000000"
    monkeypatch.setattr(cli, "BATCH", 1)
    again = partial(cli.run_answers, spark, "research", units, str(folder / "q.json"), None, run, None, None, str(folder / "none"))
    with monkeypatch.context() as m:
        m.setattr(cli, "answer_batches", partial(cli.answer_batches, batch=1))
        with pytest.raises(Exception, match="down"):
            again(make_client=client(True))
        first = sorted(p.read_text() for p in calls.iterdir())
        assert first.count("q0") == first.count("q1") == 3 and "q2" not in first  # two options and the fallback
        assert len(list((folder / "runs/research_a_20260101_000000/outputs/debug/checkpoint_calls").glob("*/*.json"))) == len(first)
        again(make_client=client(False))
        asked = sorted(p.read_text() for p in calls.iterdir())
        assert {q: asked.count(q) for q in set(asked)} == {f"q{i}": 3 for i in range(4)}
        assert json.loads((folder / "runs/research_a_20260101_000000/meta/run_manifest.json").read_text())["resumed"] is True
        cli.run_answers(spark, "research", units, str(folder / "q.json"), None, run, "q1", None, str(folder / "none"), client(False))
        assert sorted(p.read_text() for p in calls.iterdir()).count("q1") == 6
    broken = f"{run}/outputs/debug/other"
    assert sinks.checkpoint(spark, broken) is None
    (folder / "runs/research_a_20260101_000000/outputs/debug/other/_temporary/0").mkdir(parents=True)
    assert sinks.checkpoint(spark, broken) is None  # a first write that broke off
    done = sinks.checkpoint(spark, f"{run}/outputs/debug/checkpoint")
    assert sorted(r.qid for r in done.collect()) == [f"q{i}" for i in range(4)]
    assert len(list((folder / "runs/research_a_20260101_000000/outputs/debug/checkpoint_log").glob("*.jsonl"))) == 5


@pytest.mark.parametrize("single", [5, 100_000])
def test_running_sums(spark, monkeypatch, single):
    monkeypatch.setattr(storage, "SINGLE", single)
    df = spark.range(60).select("id", (F.col("id") % 7).alias("v"), F.lit("x").alias("part")).repartition(5)
    got = storage.running(df, ["id"], {"before": "v"}).orderBy("id").collect()
    assert [(r.id, r.before, r.part) for r in got] == [(i, sum(k % 7 for k in range(i)), "x") for i in range(60)]


def test_shared_folder_must_be_named_on_a_cluster():
    class Cluster:
        class conf:  # noqa: N801
            get = staticmethod(lambda key, default=None: default)

        class sparkContext:  # noqa: N801
            master = "spark://x:7077"

    with pytest.raises(RuntimeError, match=r"spark.checkpoint.dir"):
        storage.shared_dir(Cluster())


def test_from_answers_to_the_submission_where_only_spark_can_read(spark, folder):
    """A run on a file system that Python can't open: answers, files, locating and resuming."""
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.runs.link./all", f"file://{folder}/all")
    (folder / "all").mkdir()
    units = parsed(spark, folder)
    client = lambda: lambda messages: (json.dumps({"label": True, "answer": "A"}), {"total_tokens": 1})
    for _ in range(2):
        run = cli.run_answers(spark, "research", units, str(folder / "q.json"), None, "viewfs://runs/all/research_a_20260101_000000", None, None, str(folder / "none"), client)
        with open(folder / "all/research_a_20260101_000000/outputs/submission/answer.csv") as f:
            assert [r[0] for r in csv.reader(f)] == ["qid", "summary", "q0", "q1", "q2", "q3"]
        assert sinks.submission_path(spark, run) == f"{run}/outputs/submission/answer.csv"
    assert sinks.migrate_runs(spark, "viewfs://runs/all") and sinks.migrate_runs(spark, "viewfs://runs/all") == []
    evidence = json.loads((folder / "all/research_a_20260101_000000/outputs/debug/evidence.json").read_text())
    assert list(evidence) == [f"q{i}" for i in range(4)]


def prompts(spark, n):
    return spark.range(n).coalesce(1).select(F.col("id").alias("k"), F.lit("s").alias("system"), F.concat(F.lit("p"), "id").alias("user"))


def test_no_call_is_paid_twice(spark, tmp_path):
    """A task dies after 7 of 20 calls; 13 are made afterwards."""
    made = tmp_path / "made"
    made.mkdir()

    def client(most):
        def make():
            def ask(messages):
                if len(list(made.iterdir())) >= most:
                    raise RuntimeError("died")
                (made / uuid.uuid4().hex).write_text(messages[1]["content"])
                return messages[1]["content"].upper(), {"prompt_tokens": 1, "total_tokens": 2}

            return ask

        return make

    ledger = f"file://{tmp_path}/calls"
    with pytest.raises(Exception, match="died"):
        call_model(prompts(spark, 20), Calling(client(7), ledger), ["k"]).collect()
    assert len(list(made.iterdir())) == 7
    for _ in range(2):
        got = call_model(prompts(spark, 20), Calling(client(99), ledger, tasks=3), ["k"]).collect()
        assert sorted((r.k, r.content, r.total_tokens) for r in got) == [(i, f"P{i}", 2) for i in range(20)]
        assert sorted(p.read_text() for p in made.iterdir()) == sorted(f"p{i}" for i in range(20))
    call_model(prompts(spark, 3), Calling(client(99), ledger, salt="again"), ["k"]).collect()
    assert len(list(made.iterdir())) == 23
    # a task that runs again finds what it has written, though the join before it didn't
    log = Ledger(ledger)
    log.keep("ab", "x", {"total_tokens": 1})
    assert log.find("ab") == ("x", {"total_tokens": 1}) and log.find("cd") is None


def test_calls_under_way_are_bounded(spark):
    """A stub server that is busy now and then: no reply lost or doubled, never more calls than threads of all tasks."""
    lock, now, most, served = threading.Lock(), [0], [0], []

    class Stub(BaseHTTPRequestHandler):
        def do_POST(self):  # noqa: N802
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            with lock:
                now[0] += 1
                most[0] = max(most[0], now[0])
                busy = len(served) % 5 == 3
                served.append(None if busy else body["messages"][1]["content"])
            time.sleep(0.02)
            with lock:
                now[0] -= 1
            reply = json.dumps({"choices": [{"message": {"content": body["messages"][1]["content"] + "!"}}], "usage": {"total_tokens": 3}}).encode()
            self.send_response(429 if busy else 200)
            self.send_header("Content-Length", str(len(reply)))
            self.end_headers()
            self.wfile.write(reply)

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Stub)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    settings = ModelSettings("m", f"http://127.0.0.1:{server.server_port}", "k")
    got = call_model(prompts(spark, 60), Calling(partial(http_client, settings, 3, 8, 0.01), tasks=2), ["k"]).collect()
    server.shutdown()
    assert sorted((r.k, r.content, r.total_tokens) for r in got) == [(i, f"p{i}!", 3) for i in range(60)]
    assert sorted(s for s in served if s) == sorted(f"p{i}" for i in range(60)) and None in served
    assert 2 <= most[0] <= 6
