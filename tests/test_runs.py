"""Files to tables to results: decoding, measuring, the gate, retries, passes over a folder, the command line."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from quireframe import __main__ as cli
from quireframe.operators import ingest, measure as M
from quireframe.plans import watch
from quireframe.schema import FILE_STATE
from quireframe.sources import decode


def page_dict(text="Ein Absatz auf der Seite", size=11.0):
    line = lambda y: {"bbox": [72.0, y, 300.0, y + size], "spans": [{"text": text, "size": size, "font": "serif", "flags": 0}]}
    return {
        "rect": [0.0, 0.0, 450.0, 650.0],
        "blocks": [{"type": 0, "lines": [line(100.0), line(114.0), {"bbox": [0, 0, 1, 1], "spans": []}]}, {"type": 1, "lines": [line(500.0)]}],
        "images": [{"rects": [[100.0, 300.0, 300.0, 400.0]]}, {"rects": None}],
        "drawings": [{"rect": [50.0, 450.0, 150.0, 520.0], "fill": [0.1, 0.2, 0.3], "color": None}],
        "tables": [{"bbox": [72.0, 540.0, 272.0, 580.0], "row_count": 2, "col_count": 2, "cells": [[[72.0, 540.0, 172.0, 560.0], None], [[72.0, 560.0, 172.0, 580.0], [172.0, 560.0, 272.0, 580.0]]], "texts": [["Jahr", "x"], ["und Preis"]]}],
    }


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text(json.dumps(page_dict()) + "\n\n" + json.dumps(page_dict("Zweite Seite")) + "\n")
    (tmp_path / "in" / "bad.jsonl").write_text("{not json\n")
    (tmp_path / "in" / "empty.jsonl").write_text("")
    return tmp_path


def test_decoding(spark, folder):
    pages = decode.read(spark, str(folder / "in"))
    bad = pages.where("error is not null").collect()
    assert len(bad) == 1 and "bad.jsonl" in bad[0].path and "JSONDecodeError" in bad[0].error
    t = decode.tables(pages.where("error is null").select(F.lit(7).cast("bigint").alias("doc_id"), "page_no", "page"))
    assert {k: d.count() for k, d in t.items()} == {"pages": 2, "lines": 4, "images": 2, "drawings": 2, "tables": 2, "cells": 8}
    assert [(r.line_no, tuple(r.bbox)) for r in t["lines"].where("page_no = 0").orderBy("line_no").collect()] == [(0, (72.0, 100.0, 300.0, 111.0)), (1, (72.0, 114.0, 300.0, 125.0))]
    assert [(r.row_idx, r.col_idx, r.bbox is None, r.text) for r in t["cells"].where("page_no = 1").orderBy("row_idx", "col_idx").collect()] == [(0, 0, False, "Jahr"), (0, 1, True, "x"), (1, 0, False, "und Preis"), (1, 1, False, None)]


def test_command_line(spark, folder):
    words = folder / "words.json"
    words.write_text(json.dumps({"jahr": "year", "ein": "a", "seite": "page", "und": "and"}))
    src, out = str(folder / "in"), str(folder / "out")
    cli.main(["check", src, out], spark)
    r = spark.read.parquet(f"{out}/report").orderBy("page_no").collect()
    assert [(x.page_no, x.paragraphs, x.regions, x.columns, x.obstacles, x.tables) for x in r] == [(0, 1, 2, 1, 2, 1), (1, 1, 2, 1, 2, 1)]
    cli.main(["overlay", src, out, "--pages", "2", "--no-tables"], spark)
    o = spark.read.parquet(f"{out}/overlay").collect()
    assert {x.page_no for x in o} == {1} and sorted(x.kind for x in o) == ["obstacle", "obstacle", "paragraph", "region"]
    cli.main(["translate", src, out, "--glossary", str(words)], spark)
    texts = {(x.page_no, x.kind): x.text for x in spark.read.parquet(f"{out}/placements").orderBy("para").collect()}
    assert texts[0, "text"].startswith("A Absatz auf der Page") and texts[0, "cell"] in ("Year", "and Preis")
    assert [(x.path.rsplit("/", 1)[1], "JSONDecodeError" in x.message) for x in spark.read.parquet(f"{out}/undecoded").collect()] == [("bad.jsonl", True)]
    assert {x.outcome for x in spark.read.parquet(f"{out}/outcomes").collect()} == {"success"}
    cli.main(["translate", src, out, "--reformat-only", "--force", "--table-strategy", "lines"], spark)
    assert {x.kind for x in spark.read.parquet(f"{out}/placements").collect()} == {"text"}
    with pytest.raises(SystemExit):
        cli.main(["unknown", src, out], spark)


def test_watch_command(spark, folder, capsys):
    words, box = folder / "words.json", folder / "in"
    words.write_text(json.dumps({"absatz": "paragraph", "ein": "a"}))
    (box / "scan.jsonl").write_text(json.dumps(page_dict("  ")) + "\n")
    for f in box.iterdir():
        os.utime(f, (1_700_000_000,) * 2)
    run = lambda n: cli.main(["watch", str(box), str(folder / "log"), "--glossary", str(words), "--passes", str(n), "--interval", "0.1"], spark)
    run(2)
    assert capsys.readouterr().out.splitlines() == ["pass 1: 3 file(s)", "pass 2: 1 file(s)"]  # the empty one waits
    state = {r.file_key.rsplit("/", 1)[1].split(":")[0]: (r.status, r.attempts) for r in ingest.load_state(spark, str(folder / "log" / "state")).collect()}
    assert state == {"a.jsonl": ("done", 0), "bad.jsonl": ("pending", 2), "scan.jsonl": ("failed", 0)}
    pages = [json.loads(x) for x in (box / "a_en.jsonl").read_text().splitlines()]
    assert len(pages) == 2 and pages[0]["placements"][0]["text"].startswith("A Paragraph auf der Seite") and pages[1]["redactions"]
    assert sorted(p.name for p in box.iterdir()) == ["a.jsonl", "a_en.jsonl", "bad.jsonl", "empty.jsonl", "scan.jsonl"]
    assert {"page", "translated"} <= {r.kind for r in spark.read.parquet(str(folder / "log" / "events")).collect()}


def test_measuring_asks_once_for_each_distinct_request(spark, tmp_path):
    log = str(tmp_path / "asked")

    def counting():
        inner = M.by_letters()

        def ask(rows):
            with open(log, "a", encoding="utf-8") as f:
                f.writelines("x\n" for _ in rows)
            return inner(rows)

        return ask

    rows = [(100.04, "some text", 11.001, False, 0.0, None), (100.01, "some text", 11.0, False, 0.04, 0.0), (100.0, "some text", 11.0, False, 0.0, 1.3), (50.0, None, 9.0, True, 0.0, None)]
    df = spark.createDataFrame(rows[:3] * 20, "width double, text string, size double, single_line boolean, indent double, leading double")
    got = M.measured(df.repartition(4), counting).collect()
    assert len(got) == 60 and len(open(log, encoding="utf-8").readlines()) == 2
    assert {(r.leading, r.box_h) for r in got} == {(None, 13.2), (0.0, 13.2), (1.3, 14.3)} and all(abs(r.box_h - r.tight_h - 2.2) < 1e-9 for r in got)
    scales = spark.createDataFrame([(1.0,), (0.9991,), (0.8,)], "scale double")
    assert [r.message for r in M.disagreements(scales).collect()] == ["  WARNING: paragraph rendered at 0.80x -- the measure disagreed with the render"]


def brute_gate(seen):
    """seen: (second, length, age) in order."""
    t0, n0, age = seen[0]
    if n0 > 0 and age > 2:
        return "stable", t0
    last, run, zero = n0, 0, t0 if n0 == 0 else None
    for t, n, _ in seen[1:]:
        if t - t0 >= 120:
            return "slow", t
        if n == 0:
            zero = t if zero is None else zero
            if t - zero >= 5:
                return "empty", t
        else:
            zero = None
        run = run + 1 if n == last and n > 0 else 0
        if run >= 2:
            return "stable", t
        last = n
    return "waiting", None


def test_gate_against_brute_force(spark):
    rnd, rows, wanted = random.Random(5), [], {}
    for k in range(300):
        t, seen = 0, []
        for _ in range(rnd.randint(1, 12)):
            seen.append((t, rnd.choice([0, 0, 5, 5, 9]), rnd.choice([0, 0, 1, 3])))
            t += rnd.choice([1, 1, 2, 4, 40])
        wanted[f"f{k}"] = brute_gate(seen)
        rows += [(f"f{k}", s, n, s - a) for s, n, a in seen]
    df = spark.createDataFrame(rows, "path string, s long, length long, m long").select("path", "length", F.timestamp_seconds("s").alias("ts"), F.timestamp_seconds("m").alias("modified"))
    got = {r.path: (r.verdict, r.at) for r in ingest.gate(df).select("path", "verdict", F.unix_seconds("known_at").alias("at")).collect()}
    assert got == wanted and len({v for v, _ in wanted.values()}) == 4


def test_one_retry_at_a_time(spark):
    times = [0, 100, 449, 450, 451, 899, 900, 5000]
    df = spark.createDataFrame([("a", t) for t in reversed(times)] + [("b", 7)], "file_key string, t long").select("file_key", F.timestamp_seconds("t").alias("ts"))
    got = sorted((r.file_key, r.t, r.due) for r in ingest.retry_marks(df).select("file_key", F.unix_seconds("ts").alias("t"), F.unix_seconds("due").alias("due")).collect())
    assert got == [("a", 0, 150), ("a", 450, 600), ("a", 900, 1050), ("a", 5000, 5150), ("b", 7, 157)]


def test_progress_log_is_emptied_beyond_its_size(spark):
    lines = ingest.progress_lines(spark.createDataFrame([(1, "ä start")], "t long, message string").select(F.timestamp_seconds("t").alias("ts"), "message"))
    assert [r.value for r in ingest.rotated(lines).collect()] == ["[00:00:01] ä start"]
    assert ingest.rotated(lines, most=20).count() == 1 and ingest.rotated(lines, most=19).count() == 0 and ingest.rotated(lines.where("false")).count() == 0


def old(path, seconds=3600):
    path.write_bytes(b"x")
    os.utime(path, (1_714_521_600 - seconds,) * 2)


def test_passes_over_a_folder(spark, tmp_path):
    box = tmp_path / "box"
    box.mkdir()
    for name in ("a.pdf", "b.PdF", "c.pdf", "c_en.pdf", "d.pdf"):
        old(box / name)
    worked = []

    def work(files):
        worked.append(sorted(r.path.rsplit("/", 1)[1] for r in files.collect()))
        name = F.element_at(F.split("path", "/"), -1)
        return files.select("file_key", F.when(name == "a.pdf", "success").when(name == "b.PdF", "error").otherwise("unsupported").alias("outcome"), F.lit("why").alias("message"))

    state, logs = str(tmp_path / "state"), str(tmp_path / "logs")
    run = lambda version, now="2024-05-01 00:00:00": watch.folder(spark, str(box), state, logs, work, now, version)
    for version in range(4):
        run(version)
    assert worked == [["a.pdf", "b.PdF", "d.pdf"], ["b.PdF"], ["b.PdF"]]
    got = {r.file_key.rsplit("/", 1)[1].split(":")[0]: (r.status, r.attempts, r.error) for r in ingest.load_state(spark, state).collect()}
    assert got == {"a.pdf": ("done", 0, None), "b.PdF": ("failed", 3, "why"), "c.pdf": ("done", 0, None), "d.pdf": ("failed", 0, "why")}
    log = spark.read.option("header", True).csv(f"{logs}/results")
    assert sorted(r.status for r in log.collect()) == ["error: why"] * 3 + ["ok", "unsupported: why"]
    name = lambda r: r.path.rsplit("/", 1)[1] if "path" in r.asDict() else r.file_key.rsplit("/", 1)[1].split(":")[0]
    old(box / "e.pdf", -5)  # still being written, then grown, then at rest
    waits = run(5, "2024-05-01 00:00:06").retries.collect()
    assert [name(r) for r in waits] == ["e.pdf"] and len(worked) == 3
    (box / "e.pdf").write_bytes(b"xx")
    os.utime(box / "e.pdf", (1_714_521_600 + 7,) * 2)
    for version, second in ((6, 7), (7, 8)):
        run(version, f"2024-05-01 00:00:{second:02}")
        assert len(worked) == 3
    run(8, "2024-05-01 00:00:09")
    assert worked[3:] == [["e.pdf"]]
    for version, second in ((10, 10), (11, 60), (12, 131)):  # grows for two minutes: given up, looked at again when its retry is due
        (box / "f.pdf").write_bytes(b"x" * version)
        os.utime(box / "f.pdf", (1_714_521_600 + second,) * 2)
        run(version, f"2024-05-01 00:{second // 60:02}:{second % 60:02}")
    run(13, "2024-05-01 00:03:00")
    assert not any("f.pdf" in w for w in worked)
    run(14, "2024-05-01 00:04:42")
    assert "f.pdf" in worked[-1]


def test_states_that_cannot_be_read(spark, tmp_path):
    state = str(tmp_path / "state")
    assert ingest.load_state(spark, state).count() == 0
    ingest.save_state(spark, spark.createDataFrame([("a", "done", 0, None)], FILE_STATE), state, 1)
    spark.createDataFrame([("b", "pending")], "file_key string, status string").write.parquet(f"{state}/version=2")
    assert [tuple(r) for r in ingest.load_state(spark, state).collect()] == [("b", "pending", 0, None)]
    (tmp_path / "state" / "version=3").mkdir()
    (tmp_path / "state" / "version=3" / "part-0.parquet").write_bytes(b"PAR1 half writ")
    assert [r.file_key for r in ingest.load_state(spark, state).collect()] == ["b"]
    for v in (1, 2):
        for f in (tmp_path / "state" / f"version={v}").glob("*.parquet"):
            f.write_bytes(b"torn")
    for f in (tmp_path / "state").rglob(".*.crc"):
        f.unlink()
    assert ingest.load_state(spark, state).count() == 0


def test_files_are_listed_however_their_suffix_is_written(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name in ("a.pdf", "b.PDF", "sub/c.Pdf", "d.pDf", "e.pdfx", "f.txt", "pdf"):
        (tmp_path / name).write_bytes(b"x")
    assert sorted(r.path.rsplit("/", 1)[1] for r in ingest.list_files(spark, str(tmp_path)).collect()) == ["a.pdf", "b.PDF", "c.Pdf", "d.pDf"]


def test_page_ranges_of_each_document(spark):
    assert ingest.page_range("1,", 5) == ([0], []) and ingest.page_range(" 1 ,,3-4,9", 5) == ([0, 2, 3], ["no pages in 9"])
    for bad in (",", "0", "3-1", "x", "9"):
        with pytest.raises(ValueError):
            ingest.page_range(bad, 5)
    pages = spark.createDataFrame([(d, p) for d, n in ((1, 2), (2, 4)) for p in range(n)], "doc_id long, page_no int")
    some, said = ingest.chosen_pages(pages, "2-3,,4")
    assert sorted(map(tuple, some.collect())) == [(1, 1), (2, 1), (2, 2), (2, 3)] and [tuple(r) for r in said.collect()] == [(1, "no pages in 4")]


def test_one_pass_at_a_time_and_no_leftovers(spark, tmp_path):
    box, logs = tmp_path / "box", str(tmp_path / "logs")
    (box / "sub").mkdir(parents=True)
    for name in ("a.pdf.part", "sub/b_en.pdf.part", "c.pdf"):
        (box / name).write_bytes(b"x")
    none = lambda files: files.select("file_key", F.lit("error").alias("outcome"), F.lit("m").alias("message"))
    with watch.lock(spark, logs), pytest.raises(watch.Busy):
        watch.folder(spark, str(box), str(tmp_path / "state"), logs, none, "2024-05-01 00:00:00", 1)
    watch.folder(spark, str(box), str(tmp_path / "state"), logs, none, "2024-05-01 00:00:00", 1)
    assert [p.name for p in box.rglob("*") if p.is_file() and not p.name.endswith(".crc")] == ["c.pdf"]


def test_first_pair_of_fonts():
    there = {"b.ttf", "bi.ttf", "a.ttf"}
    assert M.first_pair([("a.ttf", "ai.ttf"), ("b.ttf", "bi.ttf")], there.__contains__) == ("b.ttf", "bi.ttf")
    with pytest.raises(FileNotFoundError):
        M.first_pair([("x", "y")], there.__contains__)
