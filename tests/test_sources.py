"""Readers, with the shapes that their formats have."""

from __future__ import annotations

import json
import zipfile

import pytest

from agentlake.sources import adapters as A
from agentlake.sources import sessions


def test_verify_import_and_timestamps(spark, tmp_path):
    (tmp_path / "session-a.jsonl").write_text("\n".join(json.dumps({"role": "user", "content": f"say \"{i}\" \\ é", "timestamp": 1000 + i}) for i in range(250)))
    m = sessions.read_sessions(spark, str(tmp_path), 5, use_original_timestamp=True)
    rows = m.orderBy("sequence_num").collect()
    assert [r["sequence_num"] for r in rows] == list(range(250))
    assert (rows[3]["content"], rows[3]["created_at"], rows[3]["conversation_id"]) == ('say "3" \\ é', 1003, "a")
    total = sum(r["tokens"] for r in rows)
    expected = spark.createDataFrame([("a", 250, total)], "conversation_id string, message_count long, total_tokens long")
    assert sessions.verify_import(m, expected).first()["valid"]
    assert len(sessions.verify_import(m.where("sequence_num != 7"), expected).first()["issues"]) == 3
    assert sessions.import_stats(m).first()["messages"] == 250


def _slack(folder):
    files = {
        "users.json": [{"id": "U1", "name": "ann", "real_name": "Ann A"}, {"id": "U2", "name": "bot"}],
        "general/2024-01-01.json": [{"type": "message", "ts": "1700000000.500", "user": "U1", "text": "hi <@U2> and <@U9>!"}, {"type": "message", "ts": "1700000001.0", "bot_id": "B", "text": "beep", "thread_ts": "1700000000.500"}, {"type": "join", "ts": "1", "text": "x"}, {"type": "message", "ts": "2", "text": ""}],
        "random/2024-01-01.json": [{"type": "message", "ts": "1700000002.0", "user": "U2", "text": "yo"}],
    }
    for name, body in files.items():
        (folder / name).parent.mkdir(exist_ok=True, parents=True)
        (folder / name).write_text(json.dumps(body))
    with zipfile.ZipFile(folder / "export.zip", "w") as z:
        for name, body in files.items():
            z.writestr(name, json.dumps(body))


@pytest.mark.parametrize("zipped", [True, False])
def test_slack(spark, tmp_path, zipped):
    _slack(tmp_path)
    files = A.slack_files(spark, str(tmp_path / "export.zip") if zipped else str(tmp_path))
    out = {r["source_id"]: r for r in A.slack(files, exclude=["random"]).collect()}
    assert out["general:1700000000.500"]["content"] == "hi @bot and @U9!"
    assert out["general:1700000000.500"]["created_at"] == 1700000000500
    assert {r["conversation_id"] for r in out.values()} == {"general:1700000000.500"}
    assert {r["role"] for r in out.values()} == {"user", "assistant"}
    assert A.stats(A.slack(files)).first()["items"] == 3
    assert A.fetch(A.slack(files), since=1700000002000).count() == 1


def test_discord(spark, tmp_path):
    (tmp_path / "messages" / "c12").mkdir(parents=True)
    (tmp_path / "messages" / "index.json").write_text(json.dumps({"12": "Direct Message with x"}))
    (tmp_path / "messages" / "c12" / "messages.json").write_text(json.dumps([{"ID": "5", "Timestamp": "2024-01-01T00:00:00+00:00", "Contents": "hello", "Attachments": ""}, {"ID": "6", "Timestamp": "2024-01-01T00:00:00+00:00", "Contents": ""}]))
    out = A.discord(spark, str(tmp_path)).collect()
    assert [(r["source_id"], r["created_at"], r["conversation_id"]) for r in out] == [("5", 1704067200000, "12")]
    assert A.discord(spark, str(tmp_path), include_dms=False).count() == 0


MBOX = """From a@x Mon Jan  1 00:00:00 2024
From: Ann <ann@x.org>
To: b@x.org, c@x.org
Subject: Re: Plans
 for May
Date: Mon, 1 Jan 2024 10:00:00 +0000
Message-ID: <1@x>

Hello
there

From b@x Mon Jan  1 00:00:00 2024
From: noreply@x.org
Subject: Plans for May
Date: Mon, 1 Jan 2024 11:00:00 +0000
Message-ID: <2@x>
Content-Type: multipart/mixed; boundary="q"

--q
Content-Type: text/plain

Plain part
--q--
"""


def test_email(spark):
    raw = spark.createDataFrame([(MBOX,)], "value string")
    mails = A.parse_mbox(raw).orderBy("message_id").collect()
    assert [(r["message_id"], r["subject"], r["body"]) for r in mails] == [("1@x", "Re: Plans for May", "Hello\nthere"), ("2@x", "Plans for May", "Plain part")]
    assert (mails[0]["to"], mails[0]["created_at"]) == (["b@x.org", "c@x.org"], 1704103200000)
    items = {r["source_id"]: r for r in A.email(raw).collect()}
    assert items["1@x"]["conversation_id"] == items["2@x"]["conversation_id"] == "thread_plans for may"
    assert (items["2@x"]["role"], items["1@x"]["content"]) == ("system", "Subject: Re: Plans for May\n\nHello\nthere")


def test_markdown(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.md").write_text("---\ntitle: \"My doc\"\n---\nintro\n# One\nx\n## Two\ny\n")
    out = sorted((r["source_id"].rsplit("/", 1)[1], r["content"]) for r in A.markdown(spark, str(tmp_path)).collect())
    assert out == [("a.md#One", "# One\nx"), ("a.md#Two", "## Two\ny\n"), ("a.md:L0", "intro")]
    from pyspark.sql import functions as F

    meta, _ = A.frontmatter(F.col("t"))
    assert spark.createDataFrame([("---\na: 'b'\nc: d: e\n---\nx",)], "t string").select(meta).first()[0] == {"a": "b", "c": "d: e"}


def test_chunks(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("aaaa\nbbbb\ncccc\n" + "d" * 30 + "\ne",)], "t string")
    assert df.select(A.chunk_by_size(F.col("t"), 10)).first()[0] == ["aaaa\nbbbb", "cccc", "d" * 30, "e"]
    assert A.split_size("x" * 11, 5) == ["xxxxx", "xxxxx", "x"]
    assert A.split_paragraphs("a\n\nb\n\n" + "c" * 20, 10) == ["a\n\nb", "c" * 20]
    assert A.split_pages("p1\n\np2\n\np3", 3) == ["p1", "p2", "p3"]
    assert "".join(A.split_pages("\n\n" * 40 + "z", 40)) == "z"


def test_documents_and_registry(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"one two")
    out = A.documents(spark, str(tmp_path), lambda raw: (raw.decode(), 1), "size", 4).orderBy("source_id").collect()
    assert [r["content"] for r in out] == ["one ", "two"]
    r = A.default_registry()
    assert r.names() == ["discord", "document", "email", "markdown", "slack"]
    assert r.for_format(".MD") == ["markdown"]
    with pytest.raises(ValueError, match="registered"):
        r.register("slack", A.slack, ())
    with pytest.raises(Exception):  # noqa: B017
        r.read("markdown", spark, "/no/such/folder").count() if r.read("markdown", spark, "/no/such/folder") else None
    assert r.healthy()["slack"]
