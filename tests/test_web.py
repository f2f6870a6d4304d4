"""The local server."""

import http.client
import json
import threading

import pytest

from tabaudit import web


@pytest.fixture(scope="module")
def port(spark):
    s = web.server(spark, 0)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield s.server_port
    s.shutdown()


def ask(port, method, path, body=b"", kind="multipart/form-data; boundary=x"):
    c = http.client.HTTPConnection("127.0.0.1", port, timeout=300)
    c.request(method, path, body, {"Content-Type": kind})
    r = c.getresponse()
    return r.status, r.read().decode()


def form(name, content):
    return f'--x\r\nContent-Disposition: form-data; name="file"; filename="{name}"\r\n\r\n{content}\r\n--x\r\nContent-Disposition: form-data; name="expect_flat"\r\n\r\nsize\r\n--x--\r\n'.encode()


def test_server(port):
    assert "<form" in ask(port, "GET", "/")[1] and ask(port, "GET", "/x")[0] == 404
    status, body = ask(port, "POST", "/analyze", form("t.csv", "size,error\n" + "\n".join(f"{i * 2 + 5},{i * 1.5}" for i in range(10))))
    got = json.loads(body)
    assert status == 200 and sum(got["counts"].values()) == len(got["tables"][0]["flags"]) > 0 and "expected not to matter" in got["takeaways"][0]
    assert ask(port, "POST", "/analyze", form("t.pdf", "x"))[0] == 400 and ask(port, "POST", "/analyze", b"x", "text/plain")[0] == 400
    assert ask(port, "POST", "/nowhere")[0] == 404


def test_large_uploads_are_refused(port, monkeypatch):
    monkeypatch.setattr(web, "LARGEST", 10)
    assert ask(port, "POST", "/analyze", form("t.csv", "a,b"))[0] == 413
