import http.server
import json
import threading

import pytest

from tesserae import answering
from tesserae.__main__ import main
from tests.test_pipeline import doc
from tests.test_store import put


def test_commands(spark, tmp_path, capsys):
    put(tmp_path / "a.tar", [("hiv.xml", doc("PMC1", "HIV entry requires CD4", "Viral entry through CD4", 3)), ("bad.xml", b"no")])
    (tmp_path / "c.tar.gz").write_bytes(b"damaged")
    (tmp_path / "m.txt").write_text("a.tar\ngone.tar\n")
    store = ["--store", str(tmp_path / "store")]
    assert main(["members", "--archives", str(tmp_path)]) == 0
    got = capsys.readouterr()
    assert "a.tar\t2" in got.out and "c.tar.gz" in got.err
    assert main(["deal", "--archives", str(tmp_path), "--shards", "2"]) == 0 and "a.tar" in capsys.readouterr().out
    assert main([*store, "build", "--manifest", str(tmp_path / "m.txt")]) == 0
    got = capsys.readouterr()
    assert json.loads(got.out.strip().splitlines()[-1])["parsed"] == 1 and "gone.tar" in got.err
    assert main([*store, "ask", "How does CD4 let HIV enter?", "--top-papers", "1"]) == 0
    assert "HIV entry requires CD4" in capsys.readouterr().out
    assert main([*store, "report"]) == 0 and "papers\t1\t1" in capsys.readouterr().out
    assert main([*store, "ask", "why?", "--url", "http://127.0.0.1:9", "--how", "chat"]) == 1
    with pytest.raises(SystemExit):
        main(["dance"])


def test_endpoints():
    class Answers(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            chat = self.path.endswith("chat/completions")
            asked = body["messages"][-1]["content"] if chat else body["input"]
            if chat and body["model"] == "new":
                self.send_response(405)
                self.end_headers()
                return
            if asked == "long":
                self.send_response(413)
                self.end_headers()
                self.wfile.write(b"prompt too long")
                return
            text = f"{asked}!" if self.headers.get("Authorization") == "Bearer k" else "no key"
            got = {"choices": [{"message": {"content": text}}]} if chat else {"output": [{"content": [{"text": text}]}]}
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(got).encode())

        def log_message(self, *a):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Answers)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/v1"
    try:
        assert answering.provider_for(url, "m", "k").generate("hello", "", 5) == "hello!"
        assert answering.provider_for(url, "new", "k").generate("hello", "", 5) == "hello!"
        assert answering.provider_for(url, "o3-x", "k").generate("hello", "", 5) == "hello!"
        with pytest.raises(answering.ModelError):
            answering.provider_for(url, "new", "k", "chat").generate("hello", "", 5)
        with pytest.raises(answering.ModelError) as e:
            answering.HttpProvider(url, "m", "k").generate("long", "", 5)
        assert answering.message_class(str(e.value)) == "overflow"
    finally:
        server.shutdown()
    assert answering.is_public_cloud("https://api.openai.com/v1") and not answering.is_public_cloud("localhost:1234")
    with pytest.raises(answering.ModelError):
        answering.HttpProvider("https://api.openai.com/v1", "m").generate("x", "", 1)
    assert isinstance(answering.provider_for("", "m"), answering.ContextOnly)


def test_embedders():
    assert answering.embedder_for().width == 64
    if answering.importlib.util.find_spec("transformers") is None:
        with pytest.raises(NotImplementedError):
            answering.embedder_for("allenai/specter2_base")
