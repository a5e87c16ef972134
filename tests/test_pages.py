"""Whole pages: regions with tables, the fit, translation and cells, against plain Python and given values."""

import math
import random

import pytest
from pyspark.sql import functions as F

from quireframe.functions import text as X
from quireframe.operators import cells as C, layout as L, measure as M, reflow as R, translate as T, workers
from quireframe.plans import pages as W
from quireframe.schema import CELLS, DRAWINGS, IMAGES, LINES, PAGES, RECT, TABLES

BOX = lambda *r: F.struct(*[F.lit(float(v)).alias(n) for v, n in zip(r, ("x0", "y0", "x1", "y1"), strict=True)])


def lines_of(spark, rows):
    """Rows (x0, y0, x1, size, text), all on page 0 of document 1."""
    return spark.createDataFrame([(1, 0, k, (float(a), float(b), float(c), float(b) + s), [(t, float(s), "f", 0)]) for k, (a, b, c, s, t) in enumerate(rows)], LINES)


def page_of(spark, w, h):
    return spark.createDataFrame([(1, 0, (0.0, 0.0, float(w), float(h)), 0)], PAGES)


def stats(spark, w, h, rows, drawings=(), images=(), tables=()):
    d = spark.createDataFrame([(1, 0, k, r, [0.3, 0.3, 0.3], None) for k, r in enumerate(drawings)], DRAWINGS)
    i = spark.createDataFrame([(1, 0, k, r) for k, r in enumerate(images)], IMAGES)
    t = spark.createDataFrame([(1, 0, k, r, n, m) for k, (r, n, m) in enumerate(tables)], TABLES)
    r = W.report(W.analyze(lines_of(spark, rows), page_of(spark, w, h), d, i, t)).collect()
    assert len(r) == 1
    return tuple(r[0][c] for c in ("paragraphs", "body_size", "modal_margin", "near_empty", "regions", "columns", "obstacles", "tables"))


PROSE = "words of a paragraph that run on"


def body(x0, x1, y, n, size, indent=18, pitch=14):
    return [(x0 + (indent if k == 0 else 0), y + pitch * k, x1, size, PROSE) for k in range(n)]


# Given values: the page statistics of the eight fixture pages.
def test_report_of_given_pages(spark):
    heading = [(72, 60, 200, 14, "A heading of the page")]
    assert stats(spark, 450, 650, heading + body(72, 380, 100, 4, 11) + body(72, 380, 170, 4, 11)) == (3, 14.0, 72.0, 0, 1, 1, 0, 0)
    two = body(50, 290, 60, 8, 10, 0) + body(320, 560, 60, 8, 10, 0)
    assert stats(spark, 600, 500, two) == (2, 10.0, 50.0, 0, 2, 2, 0, 0)
    title = [(50, 40, 560, 16, "A wide title above both columns")]
    assert stats(spark, 600, 500, title + body(50, 290, 80, 6, 10, 0) + body(320, 560, 80, 8, 10, 0)) == (3, 16.0, 320.0, 0, 3, 2, 0, 0)
    assert stats(spark, 450, 650, body(72, 380, 80, 3, 11) + [(140, 312, 310, 9, "Figure 1: a caption")] + body(72, 380, 350, 4, 11), images=[(140.0, 180.0, 310.0, 300.0)]) == (3, 11.0, 72.0, 0, 1, 1, 1, 0)
    bars = [(100.0 + 22 * k, 300.0 - 10 * k, 120.0 + 22 * k, 400.0) for k in range(7)]
    assert stats(spark, 450, 650, body(72, 380, 80, 4, 11) + body(72, 380, 450, 4, 11), drawings=bars) == (2, 11.0, 72.0, 0, 1, 1, 1, 0)
    grid = [(72.0 + 90 * c, 90.0 + 30 * r, 162.0 + 90 * c, 120.0 + 30 * r) for r in range(4) for c in range(3)]
    cells = [(x0 + 5, y0 + 10, x0 + 50, 11, "cell") for x0, y0, _, _ in grid]
    assert stats(spark, 450, 400, cells + body(72, 380, 250, 3, 11), drawings=grid, tables=[((72.0, 90.0, 342.0, 210.0), 4, 3)]) == (1, 11.0, 72.0, 0, 2, 1, 0, 1)
    notes = [x for k in range(3) for x in [(72, 260 + 11 * k, 76, 6.5, str(k + 1)), (79, 260 + 11 * k, 300, 9, PROSE)]]
    assert stats(spark, 450, 650, body(72, 380, 80, 5, 11) + notes)[3:] == (0, 1, 1, 0, 0)
    assert stats(spark, 612, 792, []) == (0, None, None, 0, 0, 1, 0, 0)


def test_region_rectangles_are_bands_and_columns(spark):
    rows = [(50, 20, 560, 16, "title")] + body(50, 290, 60, 8, 10, 0) + body(320, 560, 116, 5, 10, 0) + [(50, 250, 560, 10, "across")] + body(50, 290, 280, 4, 10, 0)
    got = [(r.kind, *r.rect) for r in L.regions(L.assigned(lines_of(spark, rows))).orderBy("region_no").collect()]
    assert got == [
        ("spanning", 50.0, 20.0, 560.0, 36.0), ("text", 50.0, 36.0, 290.0, 250.0), ("text", 320.0, 36.0, 560.0, 250.0), ("spanning", 50.0, 250.0, 560.0, 260.0), ("text", 50.0, 260.0, 290.0, 332.0),
    ]


def test_tables_stand_before_the_first_region_that_starts_lower(spark):
    rows = [(50, 20, 560, 16, "title")] + body(50, 290, 60, 8, 10, 0) + body(320, 560, 60, 8, 10, 0)
    tables = [((50.0, 400.0, 560.0, 460.0), 2, 2), ((60.0, 20.0, 90.0, 39.0), 2, 2), ((50.0, 30.0, 100.0, 55.0), 3, 2), ((50.0, 500.0, 560.0, 560.0), 1, 9), ((330.0, 400.0, 560.0, 460.0), 2, 2)]
    t = spark.createDataFrame([(1, 0, k, r, n, m) for k, (r, n, m) in enumerate(tables)], TABLES)
    got = [(r.kind, r.table_no) for r in W.analyze(lines_of(spark, rows[1:]), page_of(spark, 600, 600), tables=t).regions.orderBy("region_no").collect()]
    assert got == [("table", 1), ("table", 2), ("text", None), ("text", None), ("table", 0), ("table", 4)]


def brute_unions(rects, pad):
    out = [tuple(r) for r in rects]
    while True:
        hit = next(((a, b) for i, a in enumerate(out) for b in out[i + 1 :] if a[0] - pad < b[2] and b[0] < a[2] + pad and a[1] - pad < b[3] and b[1] < a[3] + pad), None)
        if hit is None:
            return sorted(out)
        a, b = hit
        out.remove(a)
        out.remove(b)
        out.append((min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3])))


def test_unions_of_random_rectangles(spark):
    rnd = random.Random(3)
    pages = {}
    for k in range(60):
        spread = rnd.choice([40, 150, 600])
        pages[k] = [(x := rnd.uniform(0, spread), y := rnd.uniform(0, spread), x + rnd.uniform(3.1, 40), y + rnd.uniform(3.1, 40)) for _ in range(rnd.randint(1, 40))]
    pages[60] = [(0.0, 0.0, 10.0, 10.0)] * 5 + [(14.0, 0.0, 20.0, 10.0)]  # equal ones; a gap of just the pad
    rows = [(k, 0, n, r, [0.1], None) for k, rs in pages.items() for n, r in enumerate(rs)]
    got = {}
    for r in L.merged(spark.createDataFrame(rows, DRAWINGS).repartition(5), "drawing").collect():
        got.setdefault(r.doc_id, []).append(tuple(r.rect))
    assert {k: sorted(v) for k, v in got.items()} == {k: brute_unions(rs, 4.0) for k, rs in pages.items()}


def height(width, text, size, leading):
    from math import ceil

    return max(1.0, float(ceil(len(text) * size * 0.5 / max(width, 1.0)))) * size * (1.2 if leading is None else leading)


def brute_fit(rows, limit, obstacles):
    """rows: dicts of one region; by the rules, one after the other."""
    flow, pins = [r for r in rows if not r["pinned"]], [r for r in rows if r["pinned"]]
    if not flow:
        return None
    first = flow[0]["y"]
    limit = min([limit] + [p["y"] - 1.5 for p in pins if p["y"] > first])
    top = max([first] + [p["y"] + p["h"] + 1.5 for p in pins if p["y"] + p["h"] <= first + 1])
    if max(r["y"] + r["h"] for r in flow) <= limit:
        return None
    gaps = [b["y"] - a["y"] - a["h"] for a, b in zip(flow, flow[1:])]
    for scale in (1.0, 0.94, 0.88, 0.82, 0.76, 0.70, 0.65):
        hs = [height(r["x1"] - r["x0"], r["text"], r["size"] * scale, r["leading"]) for r in flow]
        slack = sum(max(0.0, g - 1.5) for g in gaps)
        keep = 1.0 if slack <= 0 else max(0.0, min(1.0, (limit - top - sum(hs) - sum(max(g, 1.5) for g in gaps)) / slack + 1))
        y, tops = top, []
        for i, (r, h) in enumerate(zip(flow, hs, strict=True)):
            if i:
                g = gaps[i - 1]
                y += 1.5 + max(0.0, g - 1.5 - max(0.0, g - 1.5) * (1 - keep) * (i / len(gaps)))
            for _ in range(32):
                before = y
                for x0, y0, x1, y1 in sorted(obstacles, key=lambda o: (o[1], o[0])):
                    if r["x0"] < x1 and x0 < r["x1"] and y < y1 and y + h > y0:
                        y = y1 + 1.5
                if y == before or y + h > limit:
                    break
            tops.append(y)
            y += h
        if y - limit <= 0:
            break
    return scale, max(0.0, y - limit), tops, hs


def test_fit_against_brute_force(spark):
    rnd = random.Random(11)
    rows, wanted, limits, solid = [], {}, [], []
    for doc in range(60):
        y, mine = rnd.uniform(40, 90), []
        for para in range(1, rnd.randint(2, 9)):
            size, text = rnd.choice([9.0, 11.0, 14.0]), "x" * rnd.randint(5, 900)
            leading, x1 = rnd.choice([None, 1.3]), rnd.choice([300.0, 500.0])
            h = height(x1 - 72.0, text, size, leading)
            mine.append({"para": para, "text": text, "size": size, "pinned": False, "leading": leading, "x0": 72.0, "x1": x1, "y": y, "h": h})
            y += h + rnd.uniform(-2, 20)
        for para, at in ((20, rnd.uniform(5, 60)), (21, rnd.uniform(300, 780))):
            if rnd.random() < 0.6:
                mine.append({"para": para, "text": "7", "size": 9.0, "pinned": True, "leading": None, "x0": 72.0, "x1": 90.0, "y": at, "h": 10.8})
        obstacles = [(rnd.uniform(0, 400), t := rnd.uniform(60, 700), rnd.uniform(410, 500), t + rnd.uniform(10, 90)) for _ in range(rnd.choice([0, 0, 2, 40]))]
        limit = rnd.uniform(300, 774)
        wanted[doc] = (brute_fit(mine, limit, obstacles), mine)
        rows += [(doc, 0, m["para"], m["text"], m["size"], False, m["pinned"], 0.0, m["leading"], m["x0"], m["x1"], m["y"], m["h"]) for m in mine]
        limits.append((doc, 0, limit))
        solid += [(doc, 0, o) for o in obstacles]
    placed = spark.createDataFrame(rows, "doc_id long, page_no int, para long, text string, size double, single_line boolean, pinned boolean, indent double, leading double, x0 double, x1 double, y double, h double")
    got = {}
    for r in R.fit(placed, spark.createDataFrame(limits, "doc_id long, page_no int, limit double"), obstacles=spark.createDataFrame(solid, f"doc_id long, page_no int, rect {RECT}")).collect():
        got.setdefault(r.doc_id, {})[r.para] = r
    for doc, (want, mine) in wanted.items():
        assert len(got[doc]) == len(mine)
        for m in mine:
            r = got[doc][m["para"]]
            if want is None or m["pinned"]:
                assert (r.y, r.h, r["size"]) == (m["y"], m["h"], m["size"])
            else:
                k = m["para"] - 1
                assert r.scale == want[0] and r.overflow == pytest.approx(want[1]) and (r.y, r.h) == (pytest.approx(want[2][k]), pytest.approx(want[3][k])) and r["size"] == pytest.approx(m["size"] * want[0])
    assert sum(w is not None for w, _ in wanted.values()) > 20


def counting(path, bad_first):
    """A backend that notes each text it is asked for; its answers are bad at first if so wanted."""

    def start():
        def ask(texts, temperature):
            with open(path, "a", encoding="utf-8") as f:
                f.writelines(f"{temperature}\t{t}\n" for t in texts)
            return [t if bad_first and temperature else t[::-1] for t in texts]

        return ask

    return start


@pytest.mark.parametrize("bad_first", [False, True])
def test_each_row_is_asked_for_once_and_bad_ones_once_more(spark, tmp_path, bad_first):
    texts = [f"a text of number {k} that is long enough to be told from an echo [{k}]" for k in range(100)] + ["12", "- 3 -", "[1] *", "short"]
    para = spark.createDataFrame([(1, 0, k, t) for k, t in enumerate(texts)], "doc_id long, page_no int, para long, text string").repartition(3)
    log = tmp_path / "calls"
    done = T.translated(para, counting(str(log), bad_first)).collect()
    asked = log.read_text(encoding="utf-8").splitlines()
    assert len(asked) == 101 + (100 if bad_first else 0) and len(set(asked)) == len(asked)
    by = {r.para: r for r in done}
    assert len(by) == 104 and [by[k].skipped for k in (100, 101, 102, 103)] == [True, True, True, False]
    assert by[5].reason is None and by[5].output.startswith(texts[5][::-1]) and by[5].output.endswith("[5]") and by[5].calls == 1 + bad_first


def test_a_bad_answer_stays_or_gives_way_to_the_source(spark):
    text = "a sentence of more than forty characters, as it stands here"
    para = spark.createDataFrame([(1, 0, 1, text)], "doc_id long, page_no int, para long, text string")
    refuse = lambda: lambda texts, temperature: ["Please provide the German text."] * len(texts)
    for keep, wanted in ((False, "Please provide the German text."), (True, text)):
        r = T.translated(para, refuse, keep_source_if_bad=keep).first()
        assert (r.output, r.reason, r.calls) == (wanted, "refusal", 2)


def test_reasons_agree_with_the_column_function(spark):
    rnd = random.Random(2)
    cases = [(a, b) for a in ("x" * n for n in (10, 41, 60, 250)) for b in ("", "y", "y" * 12, "y" * 200, "y" * 800, "Please provide the German text", "I can translate", "Sorry, no")] + [("a b " * 20, "a b " * 20)]
    cases += [("t" * rnd.randint(30, 300), "o" * rnd.randint(0, 900)) for _ in range(100)]
    got = spark.createDataFrame(cases, "s string, o string").select("s", "o", X.bad_translation(F.col("s"), F.col("o")).alias("r")).collect()
    assert all(T.reason(r.s, r.o) == r.r for r in got)


def test_a_worker_never_answers_with_another_backend(spark):
    para = spark.createDataFrame([(1, 0, 1, "the cat sat")], "doc_id long, page_no int, para long, text string").coalesce(1)
    said = []
    for k in range(8):  # one after another, so that a freed one's address may be taken by the next
        said.append(T.answered(para, T.glossary({"cat": f"w{k}"})).first().answer)
    assert said == [f"the w{k} sat" for k in range(8)]
    heights = lambda h: lambda: lambda rows: [(h, h)] * len(rows)
    rows = spark.createDataFrame([(100.0, "text", 11.0, False, 0.0, None)], "width double, text string, size double, single_line boolean, indent double, leading double").coalesce(1)
    assert [M.measured(rows, heights(float(k))).first().box_h for k in range(8)] == [float(k) for k in range(8)]


def test_workers_keep_few_and_find_the_same_again():
    made = []
    for k in (1, 2, 1, 3, 1, 2):
        workers.loaded(f"test-{k}", lambda k=k: made.append(k) or k)
    assert made == [1, 2, 3, 2] and workers.name_of(T.glossary({"a": "b"})) == workers.name_of(T.glossary({"a": "b"})) != workers.name_of(T.glossary({"a": "c"}))


def toy():
    class Toy:
        """A model whose tokens are words, which stops at its budget."""

        unknown_id = 0

        def __init__(self, seed, most=None):
            self.seed, self.most = seed, most

        def token_id(self, token):
            return 7 if self.seed else 0

        def stop_at(self, token):
            self.end = token

        def count(self, text):
            return 600 * len(text.split())

        def generate(self, texts, temperature, budgets):
            return [f"seed {self.seed} budget {b} and no end" for b in budgets]

    return Toy


def test_seeded_models_and_answers_cut_off(spark):
    text = "Ein Satz, der lang genug ist, um kein Echo zu sein, und zu Ende geht."
    para = spark.createDataFrame([(1, 0, 1, text)], "doc_id long, page_no int, para long, text string")
    done = T.translated(para, T.seeded(toy(), 3))
    r = done.first()
    assert r.output == "seed 3 budget 4096 and no end" and [(t.tokens, t.budget, t.cut) for t in r.tries] == [(9000, 4096, r.output)]
    said = [x.message for x in T.events(done).orderBy("nth").collect()]
    assert said[1] == f"    TOKEN INFO: source chars={len(text)}, source tokens≈9000, max_tokens=4096"
    assert said[2] == "  WARNING: translation may be truncated at max_tokens=4096 (source ended in punctuation, output did not): ...'seed 3 budget 4096 and no end'"
    with pytest.raises(Exception, match="is no token of the model"):
        T.translated(para, T.seeded(toy(), 0)).collect()
    rnd = random.Random(3)
    cases = [("x" * rnd.randint(0, 30) + rnd.choice(["", ".", "?)", " "]), "y" * rnd.randint(1700, 2000) + rnd.choice(["", ".", "! "]), rnd.choice([512, 600])) for _ in range(200)]
    got = spark.createDataFrame(cases, "s string, o string, m int").select("s", "o", "m", X.truncated(X.strip(F.col("s")), F.col("o"), F.col("m")).alias("t")).collect()
    assert all(T.cut_short(r.s, r.o, r.m) == r.t for r in got) and len({r.t for r in got}) == 2


def test_events_of_each_kind_in_order(spark):
    long = "a sentence of more than forty characters, as it's here"
    texts = ["12", "- 3 -", "[1] *", "short one", long, long + " \uf8ff"]
    para = spark.createDataFrame([(1, 4, k, t) for k, t in enumerate(texts)], "doc_id long, page_no int, para long, text string")
    better = lambda: lambda some, temperature: [t if temperature or t.endswith("X") else "another sentence, of about as many letters" for t in some]
    by = {}
    for r in T.events(T.translated(para, better)).orderBy("para", "nth").collect():
        by.setdefault(r.para, []).append((r.kind, r.message))
    assert set(by) == {2, 3, 4, 5} and by[2] == [("skipped", "  page 5: skipped near-empty paragraph [5 chars] -> skipped (too little content)")]
    assert [k for k, _ in by[3]] == ["asked", "tokens", "translated"] and [k for k, _ in by[4]] == ["asked", "tokens", "retry", "tokens", "translated"]
    assert [k for k, _ in by[5]] == ["asked", "tokens", "retry", "tokens", "warning", "translated"]
    assert by[4][2][1] == "  page 5: output is identical to the source (probable no-op/echo); retrying once at temp=0"
    assert by[5][4][1] == f"  page 5: WARNING: output is identical to the source (probable no-op/echo) (paragraph: {texts[5][:60]!r})"
    odd = ["it's", 'say "x"', "both ' and \"", "back\\slash", "tab\there", "\uf8ff"]
    assert [r.q for r in spark.createDataFrame([(t,) for t in odd], "t string").select(X.quoted(F.col("t")).alias("q")).collect()] == [repr(t) for t in odd]


def uneven():
    """A measurer: narrow and wide letters, lines cut by their sum."""

    def one(width, text, size, single, indent, leading):
        w = sum(0.3 if c in "ijl" else 0.8 if c in "mw" else 0.5 for c in text)
        box = max(1.0, math.ceil(w * size / max(width, 1.0) - 1e-9)) * size * (1.2 if leading is None else leading)
        return box, box - 0.25 * size

    return lambda rows: [one(*r) for r in rows]


def plain_fit(paras, limit, measure):
    """A region of flowing paragraphs by plain Python: (para, text, size, x0, x1, y0, y1) to tops, heights, scale."""
    top, bottom, placed = None, None, []
    for _, text, size, x0, x1, y0, y1 in paras:
        top = y0 if top is None else bottom + (y0 - last)  # noqa: F821
        box, tight = measure(x1 - x0, text, size)
        placed.append((top, box))
        bottom, last = top + tight, y1
    if max(y + h for y, h in placed) <= limit:
        return [y for y, _ in placed], [h for _, h in placed], 1.0
    gaps = [placed[k][0] - placed[k - 1][0] - placed[k - 1][1] for k in range(1, len(placed))]
    for scale in (1.0, 0.94, 0.88, 0.82, 0.76, 0.7, 0.65):
        hs = [measure(x1 - x0, text, size * scale)[0] for _, text, size, x0, x1, _, _ in paras]
        slack = sum(max(0.0, g - 1.5) for g in gaps)
        keep = 1.0 if slack <= 0 else max(0.0, min(1.0, (limit - placed[0][0] - sum(hs) - sum(max(g, 1.5) for g in gaps)) / slack + 1))
        tops, y = [], placed[0][0]
        for k, h in enumerate(hs):
            if k:
                g = gaps[k - 1]
                y += 1.5 + max(0.0, g - 1.5 - max(0.0, g - 1.5) * (1 - keep) * (k / len(gaps)))
            tops.append(y)
            y += h
        if y <= limit:
            break
    return tops, hs, scale


def test_flow_and_fit_by_a_measurer_against_plain_python(spark, tmp_path):
    rnd, log = random.Random(11), str(tmp_path / "asked")

    def logged():
        inner = uneven()

        def ask(rows):
            with open(log, "a", encoding="utf-8") as f:
                f.writelines(f"{r}\n" for r in rows)
            return inner(rows)

        return ask

    rows, wanted = [], {}
    one = uneven()
    measure = lambda w, t, s: one([(round(w, 1), t, round(s, 2), False, 0.0, None)])[0]
    for doc in range(12):
        y, paras = 60.0, []
        for k in range(rnd.randint(1, 9) if doc % 2 else 9):
            text = "".join(rnd.choice("ijlmwabc ") for _ in range(rnd.randint(20, 300 + 100 * (doc % 6))))
            h = rnd.choice([12.0, 24.0, 60.0])
            paras.append((k, text, rnd.choice([9.0, 11.0]), 72.0, 300.0, y, y + h))
            y += h + rnd.choice([2.0, 8.0, 14.0])
        rows += [(doc, 0, k, t, (x0, y0, x1, y1), s, False, 0.0, None, False) for k, t, s, x0, x1, y0, y1 in paras]
        wanted[doc] = plain_fit(paras, 750.0 - 18.0, measure)
    para = spark.createDataFrame(rows, f"doc_id long, page_no int, para long, text string, bbox {RECT}, size double, single_line boolean, indent double, leading double, pinned boolean")
    pages = para.select("doc_id", "page_no").distinct().select("doc_id", "page_no", F.expr("named_struct('x0', 0d, 'y0', 0d, 'x1', 450d, 'y1', 750d)").alias("rect"))
    got = {}
    for r in R.fit_page(R.reflow(para, measurer=logged), pages, logged).orderBy("para").collect():
        got.setdefault(r.doc_id, []).append((r.y, r.h, r.scale))
    for doc, (tops, hs, scale) in wanted.items():
        assert [round(y, 6) for y, _, _ in got[doc]] == [round(y, 6) for y in tops] and [round(h, 6) for _, h, _ in got[doc]] == [round(h, 6) for h in hs] and {s for _, _, s in got[doc]} == {scale}
    assert len({s for _, _, s in wanted.values()}) > 2
    asked = open(log, encoding="utf-8").read().splitlines()
    fits = sum(len(t) for t, _, s in wanted.values() if s == 1.0)
    assert len(asked) <= len(rows) + 7 * (len(rows) - fits)
    said = {r.doc_id: r.kind for r in R.fit_events(R.fit_page(R.reflow(para, measurer=uneven), pages, uneven), ["doc_id", "page_no"]).collect()}
    assert all((said.get(d) is None) == (s == 1.0 and t[-1] + h[-1] <= 732) for d, (t, h, s) in wanted.items())


def test_cells_by_a_measurer(spark):
    box = lambda w, h: (0.0, 0.0, w, h)
    rows = [(k, 0, 0, 0, 0, box(40.0 + 9 * k, 14.0 + 4 * (k % 5)), "wide words mmm www" * (1 + k % 3)) for k in range(20)]
    cells = spark.createDataFrame(rows, CELLS)
    none = spark.createDataFrame([], LINES)
    one = uneven()
    for r in C.translated(cells, none, T.glossary({"wide": "broad"}), measurer=uneven).collect():
        w, h, s, t = r.inner.x1 - r.inner.x0 - 2, r.inner.y1 - r.inner.y0 - 2, 10.0, r.answer
        while s > 6.0 and one([(round(w, 1), t, round(s, 2), True, 0.0, None)])[0][0] > h:
            s -= 0.25
        assert r["size"] == (s if s > 6.0 else 6.0)


def test_a_run_over_documents(spark):
    rows = [(72, 30, 200, 9, "Kapitel 3")] + body(72, 380, 100, 4, 11)
    lines = lines_of(spark, rows)
    pages = page_of(spark, 450, 750)
    more = pages.unionByName(pages.withColumn("doc_id", F.lit(2).cast("long"))).unionByName(pages.withColumn("doc_id", F.lit(3).cast("long")))
    lines = lines.unionByName(lines.withColumn("doc_id", F.lit(3).cast("long"))).unionByName(lines_of(spark, [(72, 100, 200, 9, "wenig")]).withColumn("doc_id", F.lit(5).cast("long")))
    more = more.unionByName(pages.withColumn("doc_id", F.lit(5).cast("long")))
    docs = spark.createDataFrame([(1, "a.pdf", "Das Haus", False), (2, "b.pdf", "x", False), (3, "c.pdf", None, True), (4, "d.pdf", None, None), (5, "e.pdf", " ", False)], "doc_id long, path string, title string, needs_pass boolean")
    done = W.run(docs, {"lines": lines, "pages": more}, T.glossary({"das": "the", "haus": "house"}))
    assert {r.doc_id: (r.outcome, r.message) for r in done.outcomes.collect()} == {
        1: ("success", None), 2: ("unsupported", "b.pdf has no extractable text (image-only scan?) -- run OCR (e.g. ocrmypdf) first"), 3: ("unsupported", "c.pdf is password-protected; decrypt it first"),
        4: ("unsupported", "d.pdf has no pages"), 5: ("success", "WARNING: e.pdf has very little extractable text (5 chars across 1 page(s)); output may be near-empty"),
    }
    assert {r.doc_id for r in done.translation.placements.collect()} == {1, 5} and {r.doc_id: r.title for r in done.titles.collect()} == {1: "The House", 5: " "}
    said = [(r.doc_id, r.kind, r.message) for r in W.in_order(done.translation.events).collect()]
    assert [x for x in said if x[0] == 1][-1] == (1, "title", "  translated document title: 'Das Haus' -> 'The House'") and [x for x in said if x[0] == 5][0][1] == "warning"
    again = W.run(docs, {"lines": lines, "pages": more}, reformat=True)
    assert {r.kind for r in again.translation.events.collect()} == {"page", "warning"} and {r.translated for r in again.titles.collect()} == {False}


def test_glossary_backend():
    ask = T.glossary({"haus": "house", "das": "the"})()
    assert ask(["Das Haus, das hausboot"], 0.0) == ["The House, the hausboot"] and T.glossary({})()(["x"], 0.0) == ["x"]


def test_titles(spark):
    docs = spark.createDataFrame([(1, " Das Haus "), (2, "  "), (3, None), (4, "t" * 60)], "doc_id long, title string")
    got = {r.doc_id: (r.title, r.translated) for r in T.titles(docs, T.glossary({"das": "the", "haus": "house"})).collect()}
    assert got == {1: ("The House", True), 2: ("  ", False), 3: (None, False), 4: ("t" * 60, False)}


def test_cells(spark):
    boxes = [((72.0 + 100 * c, 100.0 + 20 * r, 172.0 + 100 * c, 120.0 + 20 * r), t) for r, row in enumerate((("Jahr", "Preis in Mark", None), ("1938", "", " viele   Worte "))) for c, t in enumerate(row)]
    b = spark.createDataFrame([(1, 0, 0, k // 3, k % 3, None if k == 0 else r, t) for k, (r, t) in enumerate(boxes)], CELLS)
    lines = lines_of(spark, [(180, 104, 260, 9, "Preis in Mark"), (275, 124, 360, 8, "viele"), (275, 130, 360, 8, "Worte")])
    fonts = {(r.row_idx, r.col_idx): (r["size"], r.single_line) for r in C.with_fonts(b, lines).collect()}
    assert fonts[0, 1] == (9.0, True) and fonts[1, 2] == (8.0, False) and fonts[0, 0] == (10.0, True)
    done = {(r.row_idx, r.col_idx): r for r in C.translated(C.matched(b.drop("bbox"), b.drop("text")), lines, T.glossary({"viele": "many", "worte": "words"})).collect()}
    assert set(done) == {(0, 1), (1, 2)} and done[1, 2].answer == "many Words" and done[1, 2]["size"] == 8.0 and tuple(done[0, 1].inner) == (173.0, 101.0, 271.0, 119.0)
    assert C.counts(C.translated(b, lines)).first().cells == 2


def test_translated_page(spark):
    rows = [(72, 30, 200, 9, "Kapitel 3")] + body(72, 380, 100, 4, 11) + [(72, 700, 90, 9, "17")] + [(80, 305, 150, 10, "Jahr und Preis")]
    tables = spark.createDataFrame([(1, 0, 0, (72.0, 300.0, 272.0, 340.0), 2, 2)], TABLES)
    cells = spark.createDataFrame([(1, 0, 0, 0, 0, (72.0, 300.0, 172.0, 320.0), "Jahr und Preis"), (1, 0, 0, 0, 1, (172.0, 300.0, 272.0, 320.0), "12"), (1, 0, 9, 0, 0, (0.0, 0.0, 50.0, 50.0), "no table")], CELLS)
    images = spark.createDataFrame([(1, 0, 0, (60.0, 80.0, 200.0, 105.0))], IMAGES)
    pages = page_of(spark, 450, 750)
    a = W.analyze(lines_of(spark, rows), pages, images=images, tables=tables)
    t = W.translate(a, cells, T.glossary({"jahr": "year", "preis": "price", "und": "and"}))
    put = {(r.kind, r.region_no, r.para, r.col_idx): r for r in t.placements.collect()}
    assert {k[0] for k in put} == {"text", "cell"} and len(put) == 4
    cell = put["cell", 2, 0, 0]
    assert cell.text == "Year and Price" and tuple(cell.rect) == (73.0, 301.0, 171.0, 319.0) and cell.pinned
    assert put["text", 1, 1, None].pinned and put["text", 1, 3, None].text == "17"
    boxes = [tuple(r.rect) for r in t.redactions.collect()]
    assert not any(r[0] < 200 and r[2] > 60 and r[1] < 105 and r[3] > 80 for r in boxes) and (72.0, 300.0, 172.0, 320.0) in boxes
    said = [r.message for r in t.events.collect()]
    assert not any("skipped" in m for m in said) and "  table: 1 cell(s) translated" in said  # nothing is said of a bare number
    assert "--- page 1 (1/1) --- 2 region(s), 1 column(s), 1 obstacle(s), 1 table(s)" in said
    order = [r.kind for r in W.in_order(t.events).collect()]
    assert order[0] == "page" and order.index("asked") < order.index("tokens") < order.index("translated") and t.metrics["paragraphs"] == 3 and t.metrics["placed"] == 3
    again = W.translate(a, cells, reformat=True)
    assert {r.kind for r in again.placements.collect()} == {"text"}
    assert W.ordinals(pages).first()[2:] == (1, 1)


def test_redactions(spark):
    pages = page_of(spark, 100, 100)
    rects = spark.createDataFrame([(1, 0, r) for r in ((0.0, 0.0, 10.0, 10.0), (50.0, 50.0, 60.0, 60.0), (200.0, 0.0, 210.0, 5.0), (95.0, 95.0, 120.0, 99.5))], f"doc_id long, page_no int, rect {RECT}")
    solid = spark.createDataFrame([(1, 0, (61.0, 50.0, 70.0, 60.0)), (1, 0, (60.5, 0.0, 61.0, 55.0))], f"doc_id long, page_no int, rect {RECT}")
    assert sorted(tuple(r.rect) for r in W.redactions(rects, pages, solid).collect()) == [(0.0, 0.0, 11.0, 11.0), (94.0, 94.0, 100.0, 100.0)]
    assert W.redactions(rects, pages).count() == 3


def test_text_lines_and_clip(spark):
    rows = [(1, 0, 0, (0.0, 0.0, 10.0, 10.0), [("a", 9.0, "f", 0)]), (1, 0, 1, (20.0, 0.0, 30.0, 10.0), [("b", 9.0, "f", 0)]), (1, 0, 2, (0.0, 0.0, 10.0, 10.0), [])]
    lines = spark.createDataFrame(rows, LINES)
    assert L.text_lines(lines).count() == 2 and [r.line_no for r in L.text_lines(lines, BOX(15, 0, 25, 5)).collect()] == [1]


def test_a_page_is_asked_for_once_whatever_is_read_of_it(spark, tmp_path):
    log = tmp_path / "calls"
    a = W.analyze(lines_of(spark, [(72, 30, 200, 9, "Kapitel 3")] + body(72, 380, 100, 4, 11) + body(72, 380, 200, 3, 11)), page_of(spark, 450, 750))
    t = W.translate(a, backend=counting(str(log), False))
    assert t.placements.count() == 3 and t.events.where("kind = 'translated'").count() == 3 and t.redactions.count() == 6
    assert len(log.read_text(encoding="utf-8").splitlines()) == 3
