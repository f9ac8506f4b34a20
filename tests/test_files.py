"""Readers and sinks on small files."""

from __future__ import annotations

import struct

from cuelake.sources import readers, sinks
from cuelake.sources.tables import cues


def test_srt(spark, tmp_path):
    (tmp_path / "a.srt").write_bytes(
        "1\r\n00:00:01,000 --> 00:00:02,500\r\none\r\ntwo\r\n\r\n2\r\nbroken\r\n\r\n7\r\n01:01:01,500 --> 01:01:02,000\r\n中文\r\n".encode("utf-16")
    )
    got = [tuple(r)[1:] for r in readers.read_srt(spark, str(tmp_path)).orderBy("number").collect()]
    assert got == [(1, 1000, 2500, "one\ntwo"), (2, 3661500, 3662000, "中文")]


def test_ass(spark, tmp_path):
    (tmp_path / "a.ass").write_text(
        "[Script Info]\nTitle: x\n\n[Events]\nFormat: Layer, Start, End, Style, Text\n"
        "Dialogue: 0,0:00:01.00,0:00:02.20,Default,{\\b1}hello, you\\Nthere\n"
        "Dialogue: 0,0:00:03.00,0:00:04.00,Staff,nobody\nDialogue: 0,0:00:05.00,0:00:05.00,Default,empty\n"
    )
    got = [tuple(r)[1:] for r in readers.read_ass(spark, str(tmp_path)).collect()]
    assert got == [(1000, 2200, "Default", "hello, you there")]


def test_srt_round_trip(spark, sf_dir, tmp_path):
    some = cues(spark, sf_dir).where("media_id < 3")
    sinks.write_srt(some, str(tmp_path / "out"), "tgt_text")
    expected = [(r["number"], r["block"]) for r in sinks.srt_blocks(some.where("media_id = 1"), "tgt_text").orderBy("number").collect()]
    text = "".join(p.read_text() for p in sorted((tmp_path / "out" / "media_id=1").glob("part-*")))
    assert text == "".join(b + "\n" for _, b in expected)


def test_vtt(spark, sf_dir, tmp_path):
    sinks.write_vtt(cues(spark, sf_dir).where("media_id = 1"), str(tmp_path / "out"), "src_text")
    text = "".join(p.read_text() for p in sorted((tmp_path / "out" / "media_id=1").glob("part-*")))
    assert text.startswith("WEBVTT\n\n1\n")


def test_keyed_cache(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"key": "a", "value": "1"}\nnot json\n{"key": "b", "value": "2"}\n{"key": "a", "value": "3"}\n{"value": "4"}\n')
    assert {tuple(r) for r in readers.read_keyed(spark, str(tmp_path)).collect()} == {("a", "3"), ("b", "2")}


def test_manifest_and_json(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text('{"text": "", "sentence": " hi ", "duration": "1.5"}\n{"transcription": "yo", "duration_s": "bad"}\n')
    got = {tuple(r)[1:] for r in readers.read_manifest(spark, str(tmp_path / "m.jsonl")).collect()}
    assert got == {("hi", 1.5, None), ("yo", None, None)}
    (tmp_path / "b.json").write_text('{"blocks": [{"start": 1, "end": 2.5, "zh": "", "text": "t"}, {"start": "x", "end": 1, "text": "u"}]}')
    assert [tuple(r)[1:] for r in readers.read_bilingual_json(spark, str(tmp_path / "b.json")).collect()] == [(1000, 2500, "t")]


def test_wav(spark, tmp_path):
    fmt = struct.pack("<HHIIHH", 1, 1, 16000, 16000, 1, 8)
    body = b"fmt " + struct.pack("<I", 16) + fmt + b"data" + struct.pack("<I", 16000) + b"\0" * 16000
    (tmp_path / "a.wav").write_bytes(b"RIFF" + struct.pack("<I", 4 + len(body)) + b"WAVE" + body)
    (tmp_path / "b.wav").write_bytes(b"nope")
    got = {r["path"].rsplit("/", 1)[1]: r["duration_ms"] for r in readers.read_wav_durations(spark, str(tmp_path)).collect()}
    assert got == {"a.wav": 1000, "b.wav": None}


def test_upsert(spark):
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert {tuple(r) for r in sinks.upsert(old, new, "k").collect()} == {(1, "a"), (2, "c"), (3, "d")}
