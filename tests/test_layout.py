"""Long cues, wrapped lines, word times and reference matching against plain Python and by hand."""

from __future__ import annotations

import random
from functools import lru_cache

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cuelake import catalog
from cuelake.functions import layout as k
from cuelake.operators import layout, matching, wordtimes
from cuelake.sources import discovery

JA = "こんにちは、今日はとても良い天気ですね。そうですね、散歩に行きましょうか"


def word(start, end, text, aligned=True):
    return {"start_ms": start, "end_ms": end, "word": text, "aligned": aligned}


def slow_plan(text, start, end, words, cuts, rules):
    """All paths over the nodes, by recursion."""
    if end - start <= rules.most_ms or not text.strip() or len(text) < 2:
        return None
    at = k.nodes(text, start, end, k.measured(words), cuts, rules)

    @lru_cache(None)
    def best(j):
        if j == 0:
            return 0.0, ()
        found = None
        for i in range(j):
            before = best(i)
            lasts, piece = at[j].time - at[i].time, text[at[i].position : at[j].position].strip()
            if before is None or lasts <= 0 or lasts > rules.most_ms + 1e-3 or not piece:
                continue
            own = k.end_cost(at[j], text, rules) if j < len(at) - 1 else 0.0
            cost = before[0] + (1 + max(0, rules.least_ms - lasts) / 1000 * 6 + max(0, len(piece) - rules.line_units) / rules.line_units + own)
            if found is None or cost < found[0] - 1e-12:
                found = cost, (*before[1], i)
        return found

    found = best(len(at) - 1)
    return found and (found[0], [at[i] for i in found[1][1:]])


@settings(max_examples=150, deadline=None)
@given(st.text("あ漢a1 。、!?\n", min_size=0, max_size=40), st.integers(1, 30_000), st.integers(0, 10**6))
def test_cut_plan_is_the_cheapest_path(text, lasts, seed):
    rng = random.Random(seed)
    words, at = [], 1000
    for token in text.split():
        end = at + rng.randrange(50, 900)
        words.append(word(at, end, token, rng.random() < 0.9))
        at = end + rng.choice([0, 50, 120, 400, 600, 1500])
    cuts = [{"time_ms": 1000 + rng.random() * lasts, "strong": rng.random() < 0.5, "strength": rng.random()} for _ in range(rng.randrange(4))]
    rules = k.Rules()
    found, slow = k.cut_plan(text, 1000, 1000 + lasts, words, cuts, rules), slow_plan(text, 1000, 1000 + lasts, words, cuts, rules)
    if slow is None or not slow[1]:
        assert found is None
        return
    assert found[1] == pytest.approx(slow[0], abs=1e-9)
    pieces = k.pieces_at(text, [n.position for n in found[0]])
    times = [1000, *(n.time for n in found[0]), 1000 + lasts]
    assert all(p for p in pieces) and all(0 < b - a <= 7000.001 for a, b in zip(times, times[1:], strict=False))
    assert "".join(pieces).replace(" ", "").replace("\n", "") == text.replace(" ", "").replace("\n", "")


def test_cut_plan_by_hand():
    inner, cost = k.cut_plan(JA, 0, 15_000)
    assert k.pieces_at(JA, [n.position for n in inner]) == ["こんにちは、", "今日はとても良い天気ですね。", "そうですね、散歩に行きましょうか"]
    assert [round(n.time) for n in inner] == [2500, 8333] and cost == pytest.approx(3.15)
    # A pause near the sentence's end takes the cut to itself; a silence between words beats a cut inside one.
    inner, _ = k.cut_plan(JA, 0, 12_000, cuts=[{"time_ms": 6700.0, "strong": True, "strength": 1.0}])
    assert [(n.time, n.source) for n in inner] == [(6700.0, k.STRONG)]
    words = [word(0, 3000, "ああああ"), word(3700, 6900, "いいいい"), word(6950, 9000, "うううう")]
    inner, _ = k.cut_plan("ああああいいいいうううう", 0, 9000, words)
    assert [(n.position, n.time, n.of_gap) for n in inner] == [(4, 3350.0, True)]
    assert k.cut_plan("短い", 0, 7000) is None and k.cut_plan("   ", 0, 9000) is None and k.cut_plan("a", 0, 9000) is None
    assert k.cut_plan(None, 0, 9000) is None


def test_places_and_shares():
    assert [k.nearest_place("abcdef", s) for s in (0.0, 0.25, 0.4166, 1.0)] == [1, 2, 2, 5]
    assert k.break_score("あ。い、う え", 2) == 0.0 and k.break_score("あ。い、う え", 4) == 0.15
    assert k.break_score("あ。い、う え", 6) == 0.35 and k.break_score("あ。い、う え", 1) == 0.75 and k.break_score("あ", 1) == 0.0
    assert k.pieces_by_share("one two", [0.5, 0.55]) == ["one", "two", ""] and k.pieces_by_share("", [0.5]) == ["", ""]
    assert k.widths("aあ. ", spaces=True).tolist() == [55, 100, 35, 35] and k.widths("aあ. ").tolist() == [55, 100, 35, 0]


@pytest.mark.parametrize(
    ("text", "lines"),
    [
        ("短い一行", "短い一行"), ("十六文字までならそのまま一行です", "十六文字までならそのまま一行です"), ("", ""), (None, ""),
        ("手を離して…もうここへはこないでね", "手を離して…\nもうここへはこないでね"),
        ("春夏秋冬東西南北上下左右前後天地人和", "春夏秋冬東西南北上\n下左右前後天地人和"),
        ("行を\\nまたぐ\n一つになる", "行を またぐ 一つになる"),
    ],
)
def test_two_lines(text, lines):
    assert k.two_lines(text) == lines


def test_two_lines_keep_words_and_never_three():
    lines = k.two_lines("これは友人の Alexandrina という人の話でした").split("\n")
    assert len(lines) == 2 and any("Alexandrina" in x for x in lines)
    assert k.two_lines("長" * 60).count("\n") == 1


@pytest.mark.parametrize(
    ("text", "most", "lines"),
    [
        ("一二三、四五六七八九", 6, "一二三、\n四五六七八九"), ("一二三四五六、七八", 6, "一二三四五六、\n七八"),
        ("ひらがな漢字ひらがな", 6, "ひらがな\n漢字ひらがな"), ("一二三四五六七八九十", 4, "一二三四\n五六七八\n九十"),
        ("a\\nb\n\nc", 4, "a\nb\nc"), (None, 4, ""), ("一二三", 0, "一二三"),
    ],
)
def test_greedy_lines(text, most, lines):
    assert k.greedy_lines(text, most) == lines


def cue_rows(spark, rows):
    kind = f"media_id long, cue_id long, start_ms long, end_ms long, src_text string, tgt_text string, words {layout.WORDS.replace('struct<', 'struct<')}"
    return spark.createDataFrame([(m, c, a, b, s, t, w) for m, c, a, b, s, t, w in rows], kind)


def odd_cues():
    words = [word(100, 3000, "ああああ"), word(3700, 6900, "いいいい"), word(6950, 9000, "うううう")]
    return [
        (1, 1, 0, 15_000, JA, "one two three", None), (1, 2, 15_010, 15_020, "", "", []), (1, 3, 15_000, 15_500, None, None, None),
        (2, 1, 200, 9_000, "ああああいいいいうううう", "xx yy zz", words), (2, 2, 9_000, 9_000, "x", None, None), (2, 3, 20_000, 60_000, "あ", "b", None),
        (3, 1, 5, 4, "ends before it starts", "", None), (3, 2, 5, 4, "ends before it starts", "", None),
    ]


def test_split_of_odd_cues(spark):
    found = layout.split_long(cue_rows(spark, odd_cues())).orderBy("media_id", "cue_id", "piece").collect()
    by = {}
    for r in found:
        by.setdefault((r["media_id"], r["cue_id"]), []).append(r)
    assert [r["src_text"] for r in by[1, 1]] == ["こんにちは、", "今日はとても良い天気ですね。", "そうですね、散歩に行きましょうか"]
    assert [(r["continues_before"], r["continues_after"]) for r in by[1, 1]] == [(False, True), (True, True), (True, False)]
    assert [(r["start_ms"], r["end_ms"]) for r in by[2, 1]] == [(200, 3350), (3350, 9000)]
    assert [[w["word"] for w in r["words"]] for r in by[2, 1]] == [[], ["いいいい", "うううう"]]
    assert {r["split_source"] for r in by[2, 1]} == {"word_gap_dp"} and by[2, 1][0]["anchor"] == "primary_cut"
    assert len(by[2, 3]) == 1 and by[1, 3][0]["src_text"] is None and len(by) == 8


def test_chain_of_odd_cues(spark):
    """No overlaps, the shortest gap kept where there is room, nothing longer than seven seconds, starts at the first measured word."""
    found = layout.display_cues(cue_rows(spark, odd_cues())).orderBy("media_id", "place").collect()
    for a, b in zip(found, found[1:], strict=False):
        if a["media_id"] == b["media_id"]:
            assert a["start_ms"] <= b["start_ms"]
            assert a["gap_violation"] or b["start_ms"] - a["end_ms"] >= 83
    assert all(r["end_ms"] - r["start_ms"] <= 7000 for r in found)
    assert [r["clamped"] for r in found if (r["media_id"], r["cue_id"]) == (2, 3)] == [True]
    assert [r["start_ms"] for r in found if (r["media_id"], r["cue_id"]) == (2, 1)][0] == 100
    assert layout.display_cues(cue_rows(spark, [])).collect() == []


def heard(spark, rows, spans):
    seg = spark.createDataFrame(rows, "seg_id long, text string, start_ms long, end_ms long, extent_start_ms long, extent_end_ms long")
    sp = spark.createDataFrame(spans, "seg_id long, pos int, start_ms long, end_ms long, score double")
    return sorted(map(tuple, wordtimes.aligned_words(seg, sp).select("seg_id", "k", "word", "start_ms", "end_ms", "kind", "score").collect()))


def test_words_from_characters(spark):
    spans = [(1, i, 1000 + 100 * i, 1090 + 100 * i, 0.1 * i) for i in range(5)]
    # The first character lies 2 s early: it is drawn in to one median gap; sound may widen the end by 400 ms at most.
    spans += [(2, 0, 0, 50, 0.5), (2, 1, 2000, 2050, 0.5), (2, 2, 2100, 2150, 0.5), (2, 3, 2200, 2250, 0.5)]
    spans += [(3, 0, 0, 10, 1.0), (5, 0, 7, 9, 1.0), (9, 0, 1, 2, 0.0)]
    rows = [
        (1, "ab 漢\n字c", 0, 9, None, None), (2, "一二三四", 0, 9, 1950, 9000), (3, "too many", 1000, 2000, None, None),
        (4, None, 0, 9, None, None), (5, "①", 0, 9, None, None), (6, "no spans", 5, 5, None, None),
    ]
    got = heard(spark, rows, spans)
    al, sy = wordtimes.ALIGNED, wordtimes.SYNTHETIC
    assert got == [
        (1, 0, "ab", 1000.0, 1190.0, al, 0.05), (1, 1, "漢", 1200.0, 1290.0, al, 0.2), (1, 2, "字", 1300.0, 1390.0, al, 0.3), (1, 3, "c", 1400.0, 1490.0, al, 0.4),
        (2, 0, "一", 1900.0, 1900.0, al, 0.5), (2, 1, "二", 2000.0, 2050.0, al, 0.5), (2, 2, "三", 2100.0, 2150.0, al, 0.5), (2, 3, "四", 2200.0, 2650.0, al, 0.5),
        (3, 0, "too", 1000.0, pytest.approx(1428.571, abs=0.01), sy, None), (3, 1, "many", pytest.approx(1428.571, abs=0.01), 2000.0, sy, None),
        (5, 0, "①", 7.0, 9.0, al, 1.0),
    ]


def test_words_take_one_join_of_segments(spark):
    """Characters meet their segment as one array: no window and no join by place, so only segments and one array each are dealt out."""
    seg = spark.createDataFrame([(1, "ab c", 0, 9, None, None)], "seg_id long, text string, start_ms long, end_ms long, extent_start_ms long, extent_end_ms long")
    sp = spark.createDataFrame([(1, i, i, i + 1, 0.5) for i in (2, 0, 1)], "seg_id long, pos int, start_ms long, end_ms long, score double")
    found = wordtimes.aligned_words(seg, sp)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("ArrowEvalPython") == 1 and plan.count("Join") == 1
    assert [(r["word"], r["start_ms"], r["end_ms"]) for r in found.collect()] == [("ab", 0.0, 2.0), ("c", 2.0, 3.0)]


def test_words_with_holes_and_nulls(spark):
    """A word without characters goes, a null time or score counts for nothing, characters without a place or a segment are none."""
    spans = [(1, 0, 0, 5, None), (1, 1, None, 20, 0.5), (1, 7, 20, 30, 0.5), (None, 0, 1, 2, 0.1), (2, None, 1, 2, 0.1)]
    got = heard(spark, [(1, "a bc", 0, 9, None, None), (2, "x", 0, 10, None, None), (3, " ", 0, 9, None, None)], spans)
    assert [(g[0], g[2], g[5], g[6]) for g in got] == [(1, "a", wordtimes.ALIGNED, None), (1, "bc", wordtimes.ALIGNED, 0.5), (2, "x", wordtimes.SYNTHETIC, None)]


def test_segment_scores_from_arrays(spark):
    seg = spark.createDataFrame([(1, "ab c", 0, 9, None, None), (2, "no", 0, 9, None, None)], "seg_id long, text string, start_ms long, end_ms long, extent_start_ms long, extent_end_ms long")
    sp = spark.createDataFrame([(1, i, i, i + 1, 0.25 * i) for i in range(3)], "seg_id long, pos int, start_ms long, end_ms long, score double")
    found = wordtimes.segment_scores(wordtimes.aligned_words(seg, sp))
    assert sorted(map(tuple, found.collect())) == [(1, 2, 0.3125), (2, 1, None)]
    assert "Window" not in found._jdf.queryExecution().executedPlan().toString()


def test_characters_stay_in_their_cue(spark, sf_dir):
    """Cues are read once and their characters never grouped: behind an exchange that AQE sizes by cues, the grouping spilled 8.8 GB at 6,000,000 of them."""
    for name in ("aligned_words", "segment_alignment"):
        plan = catalog.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "collect_list" not in plan and "Window" not in plan
        # The only joins are the cue view's own two.
        assert plan.count("Join") == 2


def test_words_from_arrays_equal_those_from_rows(spark):
    texts = {1: "ab 漢\n字c", 2: "一二三四", 3: "too many", 4: None, 5: "①", 6: "a bc", 7: "x", 8: " ", 9: "of no length"}
    chars = {
        1: [(i, 1000.0 + 100 * i, 1090.0 + 100 * i, 0.1 * i) for i in range(5)],
        2: [(0, 0.0, 50.0, 0.5), (1, 2000.0, 2050.0, None), (2, 2100.0, 2150.0, 0.5), (3, None, 9000.0, 0.25)],
        3: [(0, 0.0, 10.0, 1.0)], 4: [(0, 0.0, 1.0, 1.0)], 5: [(0, 7.0, None, 1.0)], 6: [(0, 0.0, 5.0, None), (1, None, 20.0, 0.5), (7, 20.0, 30.0, 0.5)], 7: [], 8: None,
    }
    rows = [(i, t, 1000, 1000 if i == 9 else 2000, 1950 if i % 2 else None, 9000 if i % 4 else None) for i, t in texts.items()]
    kind = "seg_id long, text string, start_ms long, end_ms long, extent_start_ms long, extent_end_ms long"
    seg = spark.createDataFrame([(*r, chars.get(r[0])) for r in rows], f"{kind}, chars {wordtimes.CHARS}")
    sp = spark.createDataFrame([(i, *c) for i, cs in chars.items() for c in reversed(cs or [])], "seg_id long, pos int, start_ms double, end_ms double, score double")
    found, known = wordtimes.words_from_arrays(seg), wordtimes.aligned_words(seg.drop("chars"), sp)
    assert found.schema == known.schema and "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(repr, found.collect())) == sorted(map(repr, known.collect()))
    assert {r["seg_id"] for r in found.collect()} == {1, 2, 3, 5, 6, 7}


def test_spans_of_odd_cues(spark):
    """No character, only one that is left out, a null time, ids below zero: as the SQL's arithmetic has it."""
    from cuelake.plans import matching as plans

    rows = spark.createDataFrame([(1, 0, 900, 0), (9, 0, 900, 1), (20, 10, 110, 3), (-20, 10, 110, 1), (18, 0, 90, 2), (7, None, 90, 1)], "id long, a long, b long, n long")
    got = {r["id"]: [tuple(c) for c in r["x"]] for r in rows.select("id", plans._spans("id", "a", "b", "n").alias("x")).collect()}
    assert got == {
        1: [], 9: [], 20: [(0, -2970.0, 70.0, 0.2), (1, 76.0, 114.0, 0.27), (2, 82.0, 4158.0, 0.34)], -20: [(0, -3010.0, 4070.0, -0.2)],
        18: [(0, 6.0, 60.0, 0.58)], 7: [(0, None, None, 0.17)],
    }


def slow_ratio(a, b):
    """Twice the matched characters over all, by the longest common block and what lies beside it."""

    def matched(a, b):
        best = max(
            ((n, -i, -j) for i in range(len(a)) for j in range(len(b)) for n in range(1, min(len(a) - i, len(b) - j) + 1) if a[i : i + n] == b[j : j + n]),
            default=None,
        )
        if best is None:
            return 0
        n, i, j = best[0], -best[1], -best[2]
        return n + matched(a[:i], b[:j]) + matched(a[i + n :], b[j + n :])

    return 2 * matched(a, b) / (len(a) + len(b)) if a or b else 1.0


def test_block_ratio(spark):
    rng = random.Random(4)
    pairs = [("".join(rng.choice("abc") for _ in range(rng.randrange(14))), "".join(rng.choice("abc") for _ in range(rng.randrange(14)))) for _ in range(200)]
    frame = spark.createDataFrame(pairs, "a string, b string")
    for r in frame.select("a", "b", matching.block_ratio(matching.F.col("a"), matching.F.col("b")).alias("r")).collect():
        assert r["r"] == pytest.approx(slow_ratio(r["a"], r["b"]))


def test_nameless_reference_is_no_match(spark):
    """An empty normal form scores nothing; the SQL's 65 for it is ``least`` skipping a null."""
    media = spark.createDataFrame([("d", "1_Thatth.mkv"), ("e", "2_x.mkv")], "folder string, name string")
    refs = spark.createDataFrame([("d", "_.ass", []), ("d", "2_Thath.ass", []), ("e", "_.ass", []), ("e", "(a).ass", [])], "folder string, name string, refs array<string>")
    found = {r["medium"]: (r["reference"], r["score"]) for r in matching.best_references(media, refs).collect()}
    assert found["1_Thatth.mkv"][0] == "2_Thath.ass"
    assert found["2_x.mkv"] == ("(a).ass", 0.0)


def test_discovery(spark, tmp_path):
    files = {
        "a/Film One.mkv": "", "a/Film One.srt": "", "a/other.ass": "", "b/[grp] Show_01 (x264).MP4": "", "b/show 01.ass": "", "b/zzz.srt": "",
        "c/m1.avi": "", "c/m2.avi": "", "c/x.ass": "[Script Info]\nVideo File: D:/v/m2.avi\nAudio URI: ?video\nAudio File: m2.avi\n", "c/y.srt": "",
        "d/lonely.mkv": "", "e/f/deep.webm": "", "e/f/whatever.srt": "", "g/only.srt": "", "g/notes.txt": "",
    }
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text or "x")
    found = {r["video_path"].split(f"{tmp_path.name}/")[1]: r for r in discovery.discover_cases(spark, str(tmp_path)).collect()}
    short = {v: (r["reference_path"].rsplit("/", 1)[1], r["match_reason"], r["match_score"]) for v, r in found.items()}
    assert len(short) == 5, short
    m1 = short.pop("c/m1.avi")
    assert short == {
        "a/Film One.mkv": ("Film One.srt", "stem_exact", 96.0), "b/[grp] Show_01 (x264).MP4": ("show 01.ass", "normalized_stem_exact", 92.0),
        "c/m2.avi": ("x.ass", "reference_metadata_exact", 100.0), "e/f/deep.webm": ("whatever.srt", "only_reference_in_directory", 70.0),
    }
    assert m1 == ("x.ass", "fuzzy_name", 32.5)
    cases = discovery.discover_cases(spark, str(tmp_path))
    index = str(tmp_path / "index")
    discovery.write_index(cases, index)
    again = discovery.load_or_discover(spark, str(tmp_path), index)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, cases.collect()))
    assert discovery.load_or_discover(spark, str(tmp_path), str(tmp_path / "none")).count() == cases.count()
    (tmp_path / "old.json").write_text('{"cases": [{"video_path": " v.mkv ", "ass_path": "r.ass"}]}')
    (old,) = discovery.load_index(spark, str(tmp_path / "old.json")).collect()
    assert (old["video_path"], old["reference_path"], old["match_reason"], old["match_score"]) == ("v.mkv", "r.ass", "index", 100.0)
    for bad in ('{"cases": [{"video_path": "v.mkv"}]}', '{"other": 1}'):
        (tmp_path / "bad.json").write_text(bad)
        with pytest.raises(Exception, match="lacks one|no list"):
            discovery.load_index(spark, str(tmp_path / "bad.json")).collect()


def test_cut_plan_in_blocks(monkeypatch):
    """The same plan whether all pieces are weighed at once or a few at a time."""
    rng = random.Random(8)
    found = 0
    for _ in range(40):
        text = "".join(rng.choice("ab c，。漢 ") for _ in range(rng.randrange(2, 60)))
        words = [{"start_ms": i * 900, "end_ms": i * 900 + rng.choice((400, 700)), "word": w, "aligned": True} for i, w in enumerate(text.split())]
        plans = []
        for cells in (1 << 16, 50, 1):
            monkeypatch.setattr(k, "_CELLS", cells)
            plans.append(k.cut_plan(text, 0, 16_500, words))
        assert plans[0] == plans[1] == plans[2]
        found += plans[0] is not None
    assert found > 20


def test_structs_by_column():
    rows = [[{"a": 1, "b": "x"}, {"a": None, "b": "y"}], None, [], [{"a": 3, "b": None}]]
    lists = pa.array(rows, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.string())])))
    assert layout._structs(lists) == rows
    assert layout._structs(lists[1:]) == rows[1:]
