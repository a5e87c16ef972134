"""Sharding, fill-in-the-middle and the audit of sources against plain Python, with nulls, empty and long texts, ties, repeats, other columns."""

import collections
import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from quireframe.llm import audit, bpe, fim, minhash, quality, sharding

DOCS = "doc_id long, text string, lang string, source string, size int, output string, row int"


def texts():
    rnd = random.Random(12)
    words = ["alpha", "Beta", "gamma,", "del-ta", "eps\n", "zeta9", "\u00e9t\u00e9", "\u65e5\u672c", "a", "\U0001f600"]
    out = [None, "", " ", "a", "one <P> two", "x<M>", "<S>", "ab" * 4000, "\u00e9" * 3000, "1 2 3", "A-B", "\U0001f600\U0001f600"]
    return out + [" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 60))) for _ in range(108)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(None if k == 5 else k // 2 if k > 110 else k, t, [None, "en", "de"][k % 3], [None, "s1", "s2", "s3"][k % 4], 7, "o", k) for k, t in enumerate(texts())]
    return spark.createDataFrame(rows + rows[40:44] * 3, DOCS).repartition(5)


def none(spark):
    return spark.createDataFrame([], DOCS)


def plain_ring(weights, shards, nodes):
    """Who takes what of each cell, one unit of weight after another."""
    points = sorted((int.from_bytes(hashlib.sha256(f"{s}:{v}".encode()).digest()[:8], "big"), s) for s in range(shards) for v in range(nodes))
    total = sum(weights.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    got = {}
    for cell in sorted(weights, key=lambda c: int.from_bytes(hashlib.sha256(f"cell {c}".encode()).digest()[:8], "big")):
        k = next((k for k, (h, _) in enumerate(points) if h >> 48 >= cell), 0)
        got[cell] = []
        for _ in range(weights[cell]):
            while not room[points[k][1]]:
                k = (k + 1) % len(points)
            room[points[k][1]] -= 1
            got[cell].append(points[k][1])
    return got


def test_a_ring_filled_one_by_one():
    rnd = random.Random(3)
    for shards, nodes in ((1, 1), (3, 2), (7, 5)):
        weights = {rnd.randrange(1 << 16): rnd.choice([1, 2, 9, 40]) for _ in range(60)}
        wanted = plain_ring(weights, shards, nodes)
        for cell, _, ends, to in sharding.fill(list(weights.items()), shards, nodes):
            flat = [s for a, b, s in zip([0, *ends], ends, to, strict=False) for _ in range(b - a)]
            assert flat == wanted[cell]
    assert sharding.fill([], 4) == [] and sum(sharding.capacities(10, 4)) == 10 and sharding.capacities(100, 4, 0.1) == [28] * 4


@pytest.mark.parametrize("unit_rows", [100_000, 2])
def test_shards(spark, docs, unit_rows):
    got = sharding.assign(docs, 7, nodes=16, unit_rows=unit_rows).collect()
    assert len(got) == docs.count() and got[0].__fields__ == ["doc_id", "text", "lang", "source", "output", "row", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "home"]
    for r in got:
        raw = (r.text or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 16, zlib.crc32(raw), "rows", None)
    by = collections.defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and max(map(len, by.values())) - min(map(len, by.values())) <= 1 and len(by) == 7
    cell = {r.row: r.cell for r in docs.select("row", F.shiftrightunsigned(F.xxhash64("doc_id"), 48).cast("int").alias("cell")).collect()}
    wanted = plain_ring(collections.Counter(cell[r.row] for r in got), 7, 16)
    assert {c: sorted(r.shard for r in got if cell[r.row] == c) for c in wanted} == {c: sorted(s) for c, s in wanted.items()}
    assert sum(r.shard == r.home for r in got) > len(got) / 2
    rows = lambda some: sorted((r.row, r.shard, r.slot) for r in some if r.row < 40 or r.row > 43)  # noqa: E731  repeated rows are alike
    if unit_rows == 100_000:
        assert rows(sharding.assign(docs.repartition(3), 7, nodes=16).collect()) == rows(got)


def test_shards_by_bytes_hot_keys_and_files(spark, docs, tmp_path):
    hot = spark.range(3000).select(F.when(F.col("id") < 1000, 5).otherwise(F.col("id")).alias("doc_id"), F.expr("repeat('x', cast(id % 50 as int))").alias("text"))
    got = sharding.assign(hot, 8, law="bytes", unit_rows=100).groupBy("shard").agg(F.sum("size").alias("s")).collect()
    sizes = [r.s for r in got]
    assert len(sizes) == 8 and max(sizes) - min(sizes) <= 66 * 8 and sum(sizes) == hot.select(F.sum(F.length("text") + 16)).first()[0]
    loose = sharding.assign(hot, 8, slack=0.25).groupBy("shard").count().collect()
    assert max(r["count"] for r in loose) <= 3000 * 1.25 / 8 + 1
    a, b = (sharding.assign(spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text")), n, slack=0.25).select("doc_id", F.col("shard").alias(f"s{n}")) for n in (10, 11))
    assert a.join(b, "doc_id").where("s10 <> s11").count() < 4000 * 0.3
    path = str(tmp_path / "shards")
    sharding.write(docs, path, 5)
    back = sharding.read(spark, path)
    assert back.count() == docs.count() and sorted(r.row for r in back.collect()) == sorted(r.row for r in docs.collect())
    assert [r.slot for r in sharding.read(spark, path, 2).orderBy("slot").collect()] == list(range(sharding.read(spark, path, 2).count()))
    assert sharding.assign(none(spark)).count() == 0
    with pytest.raises(ValueError):
        sharding.assign(docs, law="key")


TOKEN = re.compile("[A-Za-z]+|[^A-Za-z]")


def plain_fim(key, text):
    w = TOKEN.findall(text)
    n, d = len(w), hashlib.sha256(f"1:{key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(d[8 * k : 8 * k + 8], 16) for k in range(4))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    x, y = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b, c = ("".join(p) for p in (w[:x], w[x:y], w[y:]))
    if h4 % 100 < 20:
        return n, "spm", len(a), len(b), f"<S>{c}<P>{a}<M>{b}"
    return n, "psm", len(a), len(b), f"<P>{a}<S>{c}<M>{b}"


def test_fill_in_the_middle(spark, docs):
    done = fim.transform(docs)
    assert done.columns == ["doc_id", "text", "lang", "source", "size", "row", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = done.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    assert len(got) == docs.count() and {r.form for r in got} == {"plain", "psm", "spm"}
    for r in got:
        text = r.text or ""
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plain_fim("" if r.doc_id is None else r.doc_id, text) and r.back == text
    assert fim.transform(none(spark)).count() == 0 and fim.transform(docs, keep=[]).columns == ["n", "form", "prefix_chars", "middle_chars", "output"]
    assert {r.form for r in fim.transform(docs, share=0).collect()} == {"plain"}


def test_ranked_bits():
    rnd = random.Random(1)
    for _ in range(200):
        raw = "".join(rnd.choice(["a", "Z", " ", "9", "\u00e9", "\U0001f600"]) for _ in range(rnd.randint(0, 70))).encode()
        places = [len(raw.decode()[: m.start()].encode()) for m in TOKEN.finditer(raw.decode())]
        mask = fim.boundaries(raw)
        assert mask.bit_count() == len(places) and [fim.ranked(mask, len(raw), k) for k in range(len(places) + 1)] == [*places, len(raw)]


TERM = re.compile("[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain_audit(rows, least=3, top=200):
    df, counts, groups = collections.Counter(), collections.Counter(), set()
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        df.update((lang, t) for t in set(terms))
        counts.update((lang, source, t) for t in terms)
    out = []
    for lang in {x for x, _ in groups}:
        kept = sorted(t for (x, t), n in df.items() if x == lang and n >= least)
        sources = sorted(s for x, s in groups if x == lang)
        prob = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept}  # noqa: B023, E731
        own = {s: collections.Counter({t: counts[lang, s, t] for t in kept}) for s in sources}
        p = {s: prob(own[s]) for s in sources}
        q = prob(sum(own.values(), collections.Counter()))
        f = lambda a, b: (a - b) * (a - b) // b
        for s in sources:
            parts = {"pair": [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s], "term": [(f(p[s][t], q[t]), t) for t in kept if own[s][t] > 0 and p[s][t] > q[t]]}
            for part, items in parts.items():
                ranked = sorted(items, key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(ranked) if part == "pair" or k < top]
    return sorted(out)


def test_audit_of_sources(spark, docs):
    rows = [(r.lang, r.source, r.text) for r in docs.collect()]
    for top in (200, 3):
        assert sorted(map(tuple, audit.audit(docs, top=top).collect())) == plain_audit(rows, top=top)
    rnd = random.Random(5)
    odd = [("xx", f"s{k}", "only here") for k in range(2)] + [("yy", None, "a a a"), ("yy", "b", None), ("zz", "alone", "w w " * 5)] + [("zz", "alone", "w")] * 3
    odd += [(rnd.choice("pq"), rnd.choice("abcdef"), " ".join(rnd.choice("uvwxyzUVW") + rnd.choice(["", "\u00e9", "1b"]) for _ in range(rnd.randint(0, 30)))) for _ in range(150)]
    got = audit.audit(spark.createDataFrame(odd, "lang string, source string, text string"))
    assert sorted(map(tuple, got.collect())) == plain_audit(odd) and {("xx", "s0", "pair", "s1", 0, 1), ("yy", "", "pair", "b", 0, 1)} <= set(map(tuple, got.collect()))
    assert audit.audit(none(spark)).count() == 0


def test_probabilities_are_exact_beyond_64_bits(spark):
    big = [(10**12, 3 * 10**13, 10**6), (9_300_000_000, 10**11, 5), (0, 0, 1), (123_456_789_012_345, 987_654_321_098_765, 77)]
    df = spark.createDataFrame(big, "c long, n long, v long").select("*", audit.probability(F.col("c"), F.col("n"), F.col("v")).alias("p"))
    assert all(r.p == 1 + 10**9 * (r.c + 1) // (r.n + r.v) for r in df.collect())


def test_digests_of_byte_level_files(spark, tmp_path):
    import glob
    import json

    path = next((p for p in sorted(glob.glob("/opt/tokenizers/*.json")) if (json.load(open(p, encoding="utf-8")).get("decoder") or {}).get("type") == "ByteLevel"), None)
    known = None
    if path is not None:
        try:
            known = bpe.Codec(path)
        except (ValueError, KeyError, TypeError):
            known = None
    if known is None:  # the file in use, with a byte-level decoder put in
        from quireframe.llm.queries import tokenizer

        spec = json.load(open(tokenizer(), encoding="utf-8"))
        spec["decoder"] = {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}
        path = str(tmp_path / "bytes.json")
        with open(path, "w", encoding="utf-8") as f:
            json.dump(spec, f)
        known = bpe.Codec(path)
    letters = {b: known.vocab[c] for b, c in known.letters.items() if c in known.vocab}
    some = ["\u00e9", "a\u65e5b", "\U0001f600"]
    rows = [(k, b"".join(letters[b].to_bytes(4, "little") for b in t.encode())) for k, t in enumerate(some)] + [(3, letters["\u00e9".encode()[0]].to_bytes(4, "little")), (4, b"")]
    got = {r.doc_id: (r.n_tokens, r.decoded_sha256) for r in bpe.decoded(spark.createDataFrame(rows, "doc_id long, ids binary"), path).collect()}
    assert got == {k: (len(t.encode()), hashlib.sha256(t.encode()).hexdigest()) for k, t in enumerate(some)} | {3: (1, hashlib.sha256("\ufffd".encode()).hexdigest()), 4: (0, hashlib.sha256(b"").hexdigest())}
    assert all(known.decode(int.from_bytes(r[1][k : k + 4], "little") for k in range(0, len(r[1]), 4)) == t for r, t in zip(rows, [*some, "\ufffd", ""], strict=True))


def test_fits_agree_where_rows_share_ids(spark):
    rnd = random.Random(2)
    rows = [(k % 40, " ".join(rnd.choice(["some", "words", "of", "a", "text"]) + str(rnd.randint(0, 50)) for _ in range(rnd.randint(20, 200)))) for k in range(400)]
    labels = spark.createDataFrame([(k, 1) for k in range(40)], "doc_id long, quality int")
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert len({quality.fit(df.repartition(n), labels, sample=100) for n in (1, 3, 7)}) == 1


def test_planted_links_of_each_size_are_found(spark):
    """Pairs of 128 to 1,500 shingles, just above the threshold, each with words of its own; 0 of 4,500 were missed when it was measured."""
    rnd, rows, linked = random.Random(31), [], []
    sets = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    for k in range(300):
        a = [f"p{k}w{rnd.randint(0, 10**7)}" for _ in range(rnd.randint(132, 516) if k % 3 else rnd.randint(517, 1500))]
        b, own, share = list(a), sets(a), 1.0
        while share > 0.78:
            c = list(b)
            c[rnd.randrange(len(c))] = f"q{k}w{rnd.randint(0, 10**7)}"
            other = sets(c)
            if (share := len(own & other) / len(own | other)) < 0.75:
                break
            b = c
        rows += [(2 * k, " ".join(a)), (2 * k + 1, " ".join(b))]
        linked.append(len(own & sets(b)) / len(own | sets(b)) >= 0.75)
    got = {r.doc_id: r.component_id for r in minhash.groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert all(linked) and got == {d: d - d % 2 for d in range(600)}


CLASHING = "doc_id long, text string, source string, kept_id int, Kept_Nth int, row string, host string, h long, n int, drop array<string>, more map<string,int>, __id int"


def test_pipeline_on_odd_tables(spark, tmp_path):
    """Columns named as the stages' own, repeated rows and ids, null ids and sources, no rows at all."""
    import corpus_pipeline

    rnd = random.Random(3)
    prose = lambda n: " ".join("".join(rnd.choice("etaoinshrdlu") for _ in range(rnd.randint(2, 9))) for _ in range(n))
    own = (1, 2, "row", "host", 3, 4, ["drop"], {"a": 1}, 5)
    rows = [(k, prose(rnd.randint(70, 160)), [None, "a", "b"][k % 3], *own) for k in range(30)]
    rows += [rows[3]] * 3 + [(4, prose(90), "a", *own), (None, prose(80), "b", *own), (None, None, None, *own), (50, rows[7][1], "b", *[None] * 9), (51, "", "a", *own)]
    for some in (rows, []):
        docs = spark.createDataFrame(some, CLASHING)
        seen = [docs]
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, seen[-1], str(tmp_path))
            assert name == "bpe" or out.columns == docs.columns
            seen.append(spark.createDataFrame(out.collect(), out.schema))
        good, lines, near, mixed, ids = ([tuple(r) for r in s.collect()] for s in seen[1:])
        fit = {r[:3] for r in rows if r[1]}
        assert {r[:3] for r in good} == (fit if some else set()) and sorted(map(str, lines)) == sorted(map(str, good)) and len(good) == (36 if some else 0)
        if some:
            assert {r[0] for r in near} == set(range(30)) | {None} and sum(r[0] is None for r in near) == 1 and len(near) == 31
            assert set(map(str, mixed)) <= set(map(str, near)) and max(collections.Counter(map(str, mixed)).values()) <= 3
        assert len(ids) == len(mixed) and sorted(map(str, (r[0] for r in ids))) == sorted(map(str, (r[0] for r in mixed)))


def test_licenses_and_vectors_on_odd_rows(spark):
    from quireframe.llm import embed_dedup, license_scan

    mit = license_scan.TEMPLATES["mit"]
    long = "word " * 80_000 + mit + " tail" * 10
    cases = [(None, mit), (None, mit), (None, None), (7, long), (7, long), (7, "mit license"), (8, "İ MIT LICENSE"), (9, "mit-license")]
    schema = "doc_id long, text string, w string, offset int, label string, row long"
    got = sorted(str((r.doc_id, r.n_words, r.labels)) for r in license_scan.scan(spark.createDataFrame([(d, t, "x", 1, "y", 2) for d, t in cases], schema)).collect())
    n = len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", mit.lower()))
    wanted = [(None, n, "mit")] * 2 + [(None, 0, "")] + [(7, 80_000 + n + 10, "mit")] * 2 + [(7, 2, "mit"), (8, 2, ""), (9, 2, "mit")]
    assert got == sorted(map(str, wanted))
    vectors = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 0.0, 0.0]), (4, [3.0, 0.0, 0.0]), (5, [1.0]), (6, []), (None, [1.0, 0.0]), (7, [float("inf"), 0.0]), (8, [1.0, None])]
    found = {r.vec_id: (r.n_links, r.component_id) for r in embed_dedup.groups(spark.createDataFrame([(k, v, 1, "x") for k, v in vectors], "vec_id long, embedding array<double>, node int, list string")).collect()}
    assert found == {1: (1, 1), 2: (1, 1), 3: (1, 3), 4: (1, 3), 5: (0, 5), 6: (0, 6), None: (0, None), 7: (0, 7), 8: (0, 8)}


def test_repeats_are_removed_without_looking_for_passages(spark, tmp_path, monkeypatch):
    from quireframe.llm import queries, suffix_dedup

    rng = random.Random(7)
    words = lambda n: " ".join(f"w{rng.randrange(1 << 30)}" for _ in range(n))
    long, short = words(80), words(25)  # a repeat, and a passage that is shorter than one
    rows = [(1, f"{words(30)} {long} {words(9)}"), (2, f"{long}{words(40)}"), (3, f"{words(9)} {short}"), (4, f"{short} {words(50)}"), (5, None), (6, "x")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    wanted = queries.op1_suffix_dedup(spark, str(tmp_path)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").orderBy("doc_id").collect()
    monkeypatch.setattr(suffix_dedup, "_sharing", lambda *_: pytest.fail("passages were looked for"))
    got = queries.repeats_removed(spark, str(tmp_path)).orderBy("doc_id").collect()
    assert got == wanted and [r.n_spans for r in got] == [1, 1, 0, 0, 0, 0]
