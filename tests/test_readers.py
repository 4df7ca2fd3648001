"""Encodings that late lines decide, and dump files of many stretches."""

from __future__ import annotations

import pandas as pd

from tests.conftest import SF
from vigilog.operators import parse
from vigilog.sources import readers


def test_a_late_line_decides_the_encoding(spark, tmp_path):
    """Latin-1 after three hundred plain lines, beside files in the other encodings, all in one folder."""
    plain = "".join(f"{i},ann\n" for i in range(300))
    for name, encoding in (("a", "latin-1"), ("b", "utf-8"), ("c", "utf-16")):
        (tmp_path / f"{name}.csv").write_bytes(f"Event ID,User Name\n{plain}999,jos\u00e9 {name}\n".encode(encoding))
    rows = readers.read_windows_events_csv(spark, str(tmp_path)).filter("EventID = '999'").collect()
    assert sorted(r["User Name"] for r in rows) == ["jos\u00e9 a", "jos\u00e9 b", "jos\u00e9 c"]


def test_requests_over_the_ends_of_stretches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(parse, "STRETCH", 7)
    blocks = [f"{'GET' if i % 2 else 'POST'} /p{i} HTTP/1.1\n" + "".join(f"H{k}: {i}\n" for k in range(i % 12)) for i in range(60)]
    for name in ("x", "y"):
        (tmp_path / f"{name}.txt").write_text("a line before\n" + "".join(blocks))
    found = readers.read_http_dump(spark, str(tmp_path)).collect()
    assert len(found) == 120
    assert sorted((r["block"], r["raw"]) for r in found) == sorted((i + 1, b.rstrip("\n")) for i, b in enumerate(blocks) for _ in range(2))


def test_a_killed_batch_is_never_seen(spark, tmp_path):
    """A batch that fails after its rows are written isn't read; when it runs again, and again, its rows are there once."""
    import pytest

    from vigilog.sources import writers

    path, write = f"file://{tmp_path}/alerts", writers.alert_sink(f"file://{tmp_path}/alerts")
    rows = lambda: sorted(r["n"] for r in writers.read_alerts(spark, path, "n long").collect())
    assert rows() == []
    write(spark.range(3).toDF("n"), 0)
    put, writers._Files.put = writers._Files.put, lambda *a: (_ for _ in ()).throw(OSError("killed"))
    try:
        with pytest.raises(OSError):
            write(spark.range(10, 13).toDF("n"), 1)
    finally:
        writers._Files.put = put
    assert rows() == [0, 1, 2]
    for _ in range(2):
        write(spark.range(10, 13).toDF("n"), 1)
    assert rows() == [0, 1, 2, 10, 11, 12]
    write(spark.range(1).toDF("n"), 0)
    assert rows() == [0, 10, 11, 12]


def test_headers_are_parsed_once(monkeypatch):
    """Equal headers of many messages are parsed once a task, and what is read from them stays the same."""
    import email.headerregistry as registry

    class Files:
        """What a task of parse_mails() does, done here."""

        def select(self, *columns):
            return self

        def mapInPandas(self, run, schema):
            return run(iter([messages]))

    parsed, call = [], registry.HeaderRegistry.__call__
    monkeypatch.setattr(registry.HeaderRegistry, "__call__", lambda self, name, value: (parsed.append(name), call(self, name, value))[1])
    text = 'From: a{}@x.example\nSubject: s\nMIME-Version: 1.0\nContent-Type: multipart/mixed; boundary="b"\n\n--b\nContent-Type: text/plain\n\nhello\n--b\nContent-Type: application/octet-stream\nContent-Disposition: attachment; filename="f"\nContent-Transfer-Encoding: base64\n\neHl6\n--b--\n'
    messages = pd.DataFrame([(str(i), text.format(i).encode()) for i in range(50)], columns=["path", "content"])
    rows = [r for pdf in readers.parse_mails(Files()) for r in pdf.itertuples()]
    assert [(r.path, r.sender, r.subject, r.body, r.attachments) for r in rows] == [(str(i), f"a{i}@x.example", "s", "hello", [{"filename": "f", "content": b"xyz"}]) for i in range(50)]
    assert len(parsed) < 50 + 10


def test_an_export_is_several_files(spark, monkeypatch):
    """No file of the query's exports, which are a task of the reader each, has more rows than set; all rows come back."""
    from vigilog.plans import source_queries

    monkeypatch.setattr(source_queries, "EXPORT_ROWS", 300)
    rows = source_queries.s4_read_windows_events_csv(spark, SF)
    assert len(rows.inputFiles()) >= rows.count() / 300 and rows.count() == 3 * spark.read.parquet(f"{SF}/events.parquet").count()
