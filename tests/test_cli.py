"""The command line over small files."""

import json
import socket
import sys
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from corpusmill.__main__ import main
from corpusmill.plans.external import ContainerRunner
from corpusmill.plans.serving import Server
from tests.compare import SF


def test_extract_and_filter(spark, tmp_path):
    api, doc, out = (str(tmp_path / n) for n in ("api", "doc.txt", "out"))
    assert main(["extract-api", "--packages", "json", "--out", api, "--max-depth", "2"], spark)["records"] > 5
    with open(doc, "w") as f:
        f.write("Call json.loads or json.dumps, not simplejson.load.")
    got = main(["filter-api", "--records", api, "--library", "json", "--document", doc, "--out", out, "--names-out", str(tmp_path / "n")], spark)
    assert got["kept"] == got["unique_names"] == 2
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "n")).collect()) == ["json.dumps", "json.loads"]


def test_filter_packages(spark, tmp_path):
    row = {"name": "p", "summary": "s", "topics": ["Topic :: X"], "github_repo": "o/r", "github_stars": 5, "github_created_at": "2024-05-01 00:00:00"}
    rows = [row, {**row, "github_stars": 1}, {**row, "github_repo": " "}, {**row, "name": "Agent"}, {**row, "github_created_at": "x"}, {**row, "github_stars": "?"}]
    (tmp_path / "p.jsonl").write_text("\n".join([*map(json.dumps, rows), '{"name": "torn']))
    args = ["filter-packages", "--input", str(tmp_path / "p.jsonl"), "--out", str(tmp_path / "o"), "--min-stars", "5", "--date-after", "2404"]
    assert main(args, spark) == {"kept": 2}


def test_query(spark, tmp_path):
    assert main(["query", "mentions", "--sf-dir", SF, "--out", str(tmp_path / "q")], spark)["rows"] > 0


class _Chat(BaseHTTPRequestHandler):
    """A model that asks about tasks of its own count and answers with a square root."""

    asked = 0

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        system = body["messages"][0]["content"]
        if system == "Complete the function.":
            text = f"{'```'}python\ndef f(x):\n    return x + 1\n{'```'}"
        elif "ANSWER" in body["messages"][1]["content"]:
            text = json.dumps({"answer": "import math as m\ndef f(x):\n    return m.sqrt(x)\n", "test": "assert f(4) == 2"})
        else:
            _Chat.asked += 1
            text = json.dumps({"question": f"Do {_Chat.asked}"})
        out = json.dumps({"choices": [{"message": {"content": text}}]}).encode()
        self.send_response(200)
        self.end_headers()
        self.wfile.write(out)

    def do_GET(self):
        self.send_response(200)
        self.end_headers()

    def log_message(self, *a):
        pass


@pytest.fixture
def chat():
    server = HTTPServer(("127.0.0.1", 0), _Chat)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def _docs(tmp_path):
    (tmp_path / "docs.jsonl").write_text('{"full_name": "math.sqrt", "signature": "(x)", "docstring": "root"}\n{"full_name": "math.sin", "signature": "(x)"}\n')
    return ["--docs", str(tmp_path / "docs.jsonl"), "--model", "m"]


def test_synthesize_and_fuse(spark, tmp_path, chat):
    shot = {"task": "t", "solution": "s", "test": "u"}
    (tmp_path / "shots.jsonl").write_text(json.dumps(shot))
    (tmp_path / "spec.json").write_text(json.dumps({"library_overview": "o", "question_instructions": "q", "answer_instructions": "ANSWER", "module_name": "math", "module_alias": "m", "few_shot_pool_file": "shots.jsonl", "num_few_shots_q": 1, "num_few_shots_a": 1}))
    (tmp_path / "options.json").write_text(json.dumps({"k": [2], "candidates": 1, "round_tasks": 2, "max_rounds": 2}))
    args = [*_docs(tmp_path), "--url", chat, "--spec", str(tmp_path / "spec.json"), "--options", str(tmp_path / "options.json")]
    assert main(["synthesize", *args, "--samples", "2", "--out", str(tmp_path / "D1")], spark) == {"accepted": 2}
    got = main(["fuse", *args, "--samples", "1", "--pool", str(tmp_path / "D1/accepted"), "--max-depth", "2", "--out", str(tmp_path / "deep")], spark)
    assert spark.read.json(f"{got['depths'][0]}/accepted").count() == 1
    (tmp_path / "options.json").write_text('{"other": 1}')
    with pytest.raises(ValueError, match="other"):
        main(["synthesize", *args, "--out", str(tmp_path / "x")], spark)


def test_evaluate(spark, tmp_path, chat):
    items = [{"task": "t", "prompt": "def f(x):\n    pass", "test": f"assert f(1) == {n}"} for n in (2, 3)]
    (tmp_path / "b.jsonl").write_text("\n".join(map(json.dumps, items)))
    (tmp_path / "c.json").write_text('{"k": 2, "titles": {"none": "N:"}}')
    args = ["evaluate", *_docs(tmp_path), "--url", chat, "--benchmark", str(tmp_path / "b.jsonl"), "--config", str(tmp_path / "c.json"), "--out", str(tmp_path / "e")]
    main([*args, "--dump-config", str(tmp_path / "dump.json")], spark)
    dumped = json.loads((tmp_path / "dump.json").read_text())
    assert dumped["titles"] == {"gold": "Relevant API:", "none": "N:"} and dumped["k"] == 2
    got = main([*args, "--mode", "both"], spark)
    assert list(got) == ["none", "gold"]
    for mode in got:
        assert got[mode]["total"] == 2 and got[mode]["pass_at_1"] == 0.5 == json.loads((tmp_path / f"e/{mode}/report.json").read_text())["pass_at_1"]


def test_container_runner(tmp_path):
    program = tmp_path / "box"
    program.write_text("#!/bin/sh\necho \"$@\" $SIM; cat > /dev/null\n")
    program.chmod(0o755)
    ok, said = ContainerRunner("im", program=str(program), env={"SIM": "on"}).run("print(1)")
    assert ok and said == "run --rm -i --network none --memory 2g --cpus 2 im python - on\n"


def test_server(tmp_path):
    with socket.socket() as s:
        s.bind(("127.0.0.1", 0))
        port = s.getsockname()[1]
    (tmp_path / "v1").mkdir()
    (tmp_path / "v1/models").write_text("{}")
    url, command = f"http://127.0.0.1:{port}", f"{sys.executable} -m http.server {port} --bind 127.0.0.1 --directory {tmp_path}"
    with pytest.raises(ValueError, match="weights"):
        Server(command, url, str(tmp_path)).check()
    (tmp_path / "config.json").write_text("{}")
    (tmp_path / "m.safetensors").write_text("")
    with Server(command, url, str(tmp_path), 60, 0.2) as server:
        assert server.ready()
        with pytest.raises(ValueError, match="already"):
            Server(command, url).check()
    assert server.process.returncode is not None and not server.ready()
    with pytest.raises(RuntimeError, match="ended: .*oops"):
        Server(f"{sys.executable} -c 'import sys; sys.exit(\"oops\")'", url, timeout=60, pause=0.2).__enter__()
    with pytest.raises(ValueError, match="program"):
        Server("no-such-program", url).check()
