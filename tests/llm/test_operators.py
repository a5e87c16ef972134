"""Each operator against brute force, round trips, and odd rows: nulls, empty and long texts, repeats, empty tables, extra columns."""

import base64
import collections
import hashlib
import random
import re
import struct
import zlib

import numpy as np
import pytest

from quireframe.llm import bpe, embed_dedup, license_scan, line_dedup, minhash, mixing, quality, suffix_dedup, tokenfile, warc
from quireframe.llm.queries import tokenizer

WORD = re.compile(rb"[^\x20\x09-\x0d]+")
DOCS = "doc_id long, text string, source string, of string, key int"


def texts() -> list:
    rnd = random.Random(4)
    words = ["alpha", "Beta", "gamma,", "delta", "eps", "zeta", "eta.", "theta", "jota", "kappa", "l'ambda", "μ"]
    base = " ".join(rnd.choice(words) for _ in range(120))
    near = base.replace("alpha", "OMEGA", 1)
    out = [None, "", "  \n\t ", "one", "one", "two words", base, base, near, base + " and more", "a" * 3000, "x " * 4000, "line\n" * 300, "😀 é ́ İ", "\x00\x01 <|endoftext|>"]
    return out + [" ".join(rnd.choice(words) + str(rnd.randint(0, 9)) for _ in range(rnd.randint(1, 90))) for _ in range(25)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, None if k % 9 == 0 else f"s{k % 3}", "x", k) for k, t in enumerate(texts())]
    return spark.createDataFrame(rows, DOCS)


def none(spark):
    return spark.createDataFrame([], DOCS)


def test_suffixes_against_brute_force(spark, docs):
    for length, window, gram in ((40, 16, 8), (64, 40, 16)):
        raw = [(t or "").encode() for t in texts()]
        seen = collections.Counter(t[p : p + length] for t in raw for p in range(len(t) - length + 1))
        for r in suffix_dedup.remove_repeats(docs, length, window, gram).collect():
            t = raw[r.doc_id]
            gone = bytearray(len(t))
            for p in range(len(t) - length + 1):
                if seen[t[p : p + length]] > 1:
                    gone[p : p + length] = b"\1" * length
            kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
            runs = len(re.findall(rb"\x01+", bytes(gone)))
            assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(t), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    assert suffix_dedup.remove_repeats(none(spark)).count() == 0


def test_long_text_is_cut_into_blocks():
    raw = np.frombuffer(random.Random(1).randbytes(suffix_dedup.BLOCK * 2 + 99), dtype=np.uint8)
    starts = [p[0] for _, _, _, p in suffix_dedup.blocks(raw, np.array([0, len(raw)]), 400)]
    ends = [p[0] + len(b) for b, _, _, p in suffix_dedup.blocks(raw, np.array([0, len(raw)]), 400)]
    assert starts[0] == 0 and ends[-1] == len(raw) and all(b - a == suffix_dedup.BLOCK - 399 for a, b in zip(starts, starts[1:], strict=False))


def test_token_file_round_trip(spark, docs):
    from tokenizers import Tokenizer

    library, start = Tokenizer.from_file(tokenizer()), 0
    data = tokenfile.write(docs, tokenizer())
    for r, t in zip(tokenfile.read(spark, data).orderBy("doc_id").collect(), texts(), strict=True):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        start += len(ids)
    assert tokenfile.look_up(spark, data, 3) == [[*library.encode("one", add_special_tokens=False).ids, 1]]
    assert tokenfile.unpack(tokenfile.pack(struct.pack("<3I", 1, 70000, 5))) == struct.pack("<3I", 1, 70000, 5)
    assert tokenfile.read(spark, tokenfile.write(none(spark), tokenizer())).count() == 0


def test_dictionary_sample_reaches_late_parts(spark):
    from tokenizers import Tokenizer

    one, two = (Tokenizer.from_file(tokenizer()).encode(x, add_special_tokens=False).ids[0] for x in ("one", "two"))
    df = spark.createDataFrame([(k, "one " * 10_000 + "two " * 10_000) for k in range(30)], "doc_id long, text string")
    seen = [struct.unpack(f"<{len(b) // 4}I", b) for b in map(tokenfile.unpack, tokenfile._sample(df, tokenizer()))]
    assert {i for ids in seen for i in ids} == {one, two} and all(len(ids) == 4096 for ids in seen)


def shingles(text, n=5):
    w = WORD.findall((text or "").encode().translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")))
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def components(n, linked):
    root = list(range(n))
    for a, b in linked:
        a, b = (next(iter([x])) for x in (a, b))
        while root[a] != a:
            a = root[a]
        while root[b] != b:
            b = root[b]
        root[max(a, b)] = min(a, b)
    for k in range(n):
        while root[k] != root[root[k]]:
            root[k] = root[root[k]]
    return root


def test_near_copies_against_brute_force(spark, docs):
    rnd = random.Random(8)
    base = [f"w{rnd.randint(0, 9999)}" for _ in range(150)]
    copies = []
    for k in range(60):  # a large group of near copies, some of them too far away
        w = list(base)
        for _ in range(rnd.randint(0, 9)):
            w[rnd.randrange(len(w))] = f"v{k}{rnd.random()}"
        copies.append(" ".join(w))
    all_texts = texts() + copies
    df = spark.createDataFrame(list(enumerate(all_texts)), "doc_id long, text string")
    sets = [shingles(t) for t in all_texts]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    root = components(len(sets), links)
    for r in minhash.groups(df).collect():
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), root[r.doc_id], root[r.doc_id] == r.doc_id)
    assert minhash.groups(none(spark)).count() == 0
    assert minhash.keep_one(docs).columns == docs.columns


def test_links_of_short_texts_do_not_hang_on_registers(spark):
    """Three of four shingles shared: the registers of the first three pairs agree too seldom, the last two share no band."""
    pairs = [" ".join(f"w{k}x{j}" for j in range(n)) for k in (557, 871, 6762, 1232, 13040, 1) for n in (7, 8)]
    away = " ".join(f"w1x{j}" for j in range(10))  # six shingles: too far from the last pair
    got = {r.doc_id: r for r in minhash.groups(spark.createDataFrame(list(enumerate([*pairs, away])), "doc_id long, text string")).collect()}
    assert [got[k].component_id for k in range(13)] == [*(k - k % 2 for k in range(12)), 12]


def test_keep_one_leaves_one_row_of_each_kept_document(spark):
    a, b = " ".join(f"a{k}" for k in range(40)), " ".join(f"b{k}" for k in range(40))
    rows = [(1, a, "s", "x", 1)] * 3 + [(2, a + " more", "s", "x", 1), (3, b, "s", "x", 1), (3, b, "t", "x", 1), (4, "", "s", "x", 1), (4, "", "s", "x", 1)] + [(None, "own text", "s", "x", 1)] * 2
    got = sorted((tuple(r) for r in minhash.keep_one(spark.createDataFrame(rows, DOCS)).collect()), key=str)
    assert sorted((r[0] or 0, r[1]) for r in got) == [(0, "own text"), (0, "own text"), (1, a), (3, b), (4, "")]
    assert got == sorted((tuple(r) for r in minhash.keep_one(spark.createDataFrame(rows[::-1], DOCS).repartition(3)).collect()), key=str)


def test_registers_agree_as_sets_do():
    rng = np.random.default_rng(3)
    both, own = rng.integers(0, 1 << 63, 800, dtype=np.uint64), rng.integers(0, 1 << 63, 200, dtype=np.uint64)
    a, b = minhash.registers(both, 10), minhash.registers(np.r_[both, own], 10)
    assert abs(minhash.estimate(a, b) - 0.8) < 0.15


def test_line_dedup(spark):
    rows = [(k, f"own {k}\nmenu\n\nrare {k % 7}", "a", "x", 1) for k in range(20)] + [(100, "menu\nother", "b", "x", 1), (101, None, None, "x", 1), (102, "", None, "x", 1)]
    got = {r.doc_id: r for r in line_dedup.drop_boilerplate(spark.createDataFrame(rows, DOCS), counts=True).collect()}
    assert got[3].text == "own 3\n\nrare 3" and got[3]["__n_dropped"] == 1 and got[3].key == 1
    assert got[100].text == "menu\nother" and got[101].text is None and got[102].text == ""
    assert line_dedup.drop_boilerplate(none(spark)).count() == 0


def test_encoder_equals_library(docs):
    from tokenizers import Tokenizer

    library, codec = Tokenizer.from_file(tokenizer()), bpe.Codec(tokenizer())
    rnd = random.Random(2)
    odd = ["".join(rnd.choice("abthein'sßéİΣ ́\t\x85🎉漢0<|>.") for _ in range(rnd.randint(1, 60))) for _ in range(400)] + ["ab" * 2000, "<|endoftext|>x"]
    for t in [x or "" for x in texts()] + odd:
        ids = library.encode(t, add_special_tokens=False).ids
        shown = library.decode(ids, skip_special_tokens=False)
        assert codec.encode(t) == ids and codec.decode(ids) == shown
        assert codec.digest(t.encode()) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(shown.encode()).hexdigest())


def test_encoder_emits_early_and_keeps_little():
    m = bpe.codec(tokenizer()).merges
    fed = []

    def letters():
        for _ in range(5000):
            fed.append(1)
            yield "ab"

    stream = m.stream(letters())
    next(stream)
    assert 2 * len(fed) <= 4 * m.longest < m.lookahead
    assert m.merged(list("therein") [:-1] + ["n</w>"]) == list(m.stream(["there", "in"]))


def test_byte_level_decoder_holds_unfinished_characters(tmp_path):
    import json

    from tokenizers import Tokenizer

    spec = json.load(open(tokenizer(), encoding="utf-8"))
    letters = bpe.byte_letters()
    spec["model"] |= {"vocab": {c: b for b, c in letters.items()} | {letters[0x41] + letters[0xC3]: 256, "\u6f22": 257}, "merges": [], "unk_token": None, "end_of_word_suffix": None}
    spec |= {"added_tokens": [], "post_processor": None, "decoder": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}}
    path = tmp_path / "bytes.json"
    path.write_text(json.dumps(spec))
    codec, library = bpe.Codec(str(path)), Tokenizer.from_file(str(path))
    rnd = random.Random(3)
    cases = [list("a é 漢🎉".encode()), [256, 0xA9, 0x42], [0xE6, 0xBC], [0xC3, 0x41], [0xFF, 257, 9999]] + [[rnd.randrange(258) for _ in range(20)] for _ in range(200)]
    for ids in cases:
        assert codec.decode(ids) == library.decode(ids, skip_special_tokens=False)
    assert list(codec.decode_stream([0xE6, 0xBC, 0xA2, 0x21])) == ["漢".encode(), b"!"]
    with pytest.raises(ValueError):
        codec.encode("a")


def test_encode_decode(spark, docs):
    assert bpe.encode_decode(docs, tokenizer()).count() == len(texts())
    assert bpe.encode_decode(none(spark), tokenizer()).count() == 0


def test_license_scan(spark):
    mit, gpl = license_scan.TEMPLATES["mit"], license_scan.TEMPLATES["gpl"].split()
    cases = [None, "", "The MIT License. See the Apache  license, and MIT license", "some words before " + mit.upper(), " ".join(gpl[:15] + ["extra"] + gpl[15:]), " ".join(mit.split()[:6]), "mit\nlicense " * 500]
    r = {x.doc_id: x for x in license_scan.scan(spark.createDataFrame([(k, t, "s", "x", 1) for k, t in enumerate(cases)], DOCS)).collect()}
    assert (r[0].n_words, r[0].n_base, r[0].first_word, r[0].labels, r[0].score) == (0, 0, None, "", 0.0)
    assert (r[2].n_words, r[2].n_base, r[2].first_word, r[2].last_word, r[2].base_labels) == (10, 3, 1, 8, "apache,mit")
    assert (r[3].base_labels, r[3].labels, r[3].score) == ("", "mit", 1.0)
    assert "gpl" in r[4].labels and r[4].score > 0.8 and r[5].labels == "" and (r[6].n_base, r[6].last_word) == (500, 998)
    assert license_scan.scan(none(spark)).count() == 0


def test_targets():
    t = mixing.targets([("a", 100), ("b", 100), ("c", 10), (None, 90)])
    assert t["c"] == 30 and abs(sum(t.values()) - 300) < 1e-6 and abs(t["b"] / t["a"] - 2) < 1e-9
    assert mixing.targets([("a", 0)]) == {"a": 0.0} and mixing.targets([]) == {}


def test_mix(spark):
    rnd = random.Random(1)
    rows = [(k, "w " * rnd.randint(0, 400), f"s{k % 4}" if k % 5 else None, "x", 1) for k in range(1500)]
    df = spark.createDataFrame(rows, DOCS)
    a, b = sorted(mixing.mix(df, block=128).collect()), sorted(mixing.mix(df.repartition(5), block=128).collect())
    assert a == b and len(a) == 1500
    by = collections.defaultdict(list)
    for r in a:
        assert 0 <= r.taken <= 3 * r["size"] and r["size"] == len(rows[r.doc_id][1].split())
        by[r.source_size].append(r)
    for rs in by.values():
        assert sum(r["size"] for r in rs) == rs[0].source_size and abs(sum(r.taken for r in rs) - rs[0].target) <= 0.01 * rs[0].target + 5
    assert mixing.mix(none(spark)).count() == 0
    assert mixing.apply_mix(df).columns == df.columns


def test_applied_mix_takes_each_row_as_often_as_the_mix_says(spark):
    rows = [(None if k % 7 == 0 else k % 50, None if k % 11 == 0 else "w " * (k % 13), None if k % 5 == 0 else f"s{k % 3}", k, "x", 1) for k in range(300)]
    df = spark.createDataFrame(rows + rows[:40], "doc_id long, text string, source string, copies int, h string, again int")
    said, got = collections.Counter(), collections.Counter()
    for r in mixing.mix(df).collect():
        said[r.doc_id, r.size] += r.copies
    applied = mixing.apply_mix(df)
    assert applied.columns == df.columns
    for r in applied.collect():
        got[r.doc_id, len((r.text or "").split())] += 1
    assert got == +said
    assert mixing.apply_mix(none(spark)).count() == 0


def test_quality_counts(docs, spark):
    for r in quality.measure(docs).collect():
        t = texts()[r.doc_id] or ""
        w = WORD.findall(t.encode())
        tri = collections.Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {j for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in t.split("\n") if WORD.search(x.encode())]
        assert r.n_words == len(w) and r.word_chars == sum(len(x.decode()) for x in w) and r.n_repeat_words == len(covered)
        assert r.n_dup_lines == len(lines) - len(set(lines)) and r.n_symbols == sum(c in "#*$%&|<>" for c in t)
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and not (r.base_failed and r.kept)
    assert quality.keep_good(docs).columns == docs.columns and quality.measure(none(spark)).count() == 0


def test_quality_bands():
    import zstandard

    rnd = random.Random(5)
    squeeze = zstandard.ZstdCompressor(level=3).compress
    prose = " ".join("".join(rnd.choice("etaoinshrdlu") for _ in range(rnd.randint(2, 9))) for _ in range(900)).encode()
    noise = base64.b85encode(random.Random(6).randbytes(4000))
    kept = lambda t: quality.judge(t, quality.Bands(), squeeze)[6]
    assert kept(prose) and not kept(b" ".join(bytes([k]) * 3 for k in noise) * 1 + b" same line" * 3000)


def test_tail_of_a_text_is_judged():
    import zstandard

    squeeze, bands = zstandard.ZstdCompressor(level=3).compress, quality.Bands()
    rnd = random.Random(5)
    prose = " ".join("".join(rnd.choice("etaoinshrdlu") for _ in range(rnd.randint(2, 9))) for _ in range(900)).encode()[: bands.chunk]
    for tail, bad in ((b"", 0), (b"x" * (bands.chunk - 1), 1), (prose[:9], 0)):
        assert quality.judge(prose + tail, bands, squeeze)[8:] == (1 + bool(tail), bad)
    assert quality.judge(prose[:-1], bands, squeeze)[8:] == (0, 0)


def test_warc_round_trip(spark):
    rows = [(1, "http://a/1", "<p>x</p>", 1), (2, "http://a/2", "<p>x</p>", 1), (3, None, None, 1), (4, "u\r\nv", "", 1), (5, "http://b", "WARC/1.0\r\n\r\nContent-Length: 3\r\n\r\nü", 1), (6, "c", "y" * 100_000, 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, response int")
    got = {r.page_id: r for r in warc.captures(spark, warc.write(pages), payloads=True).collect()}
    for page, _, html, _ in rows:
        raw = (html or "").encode()
        r = got[page].response
        assert r.payload_bytes == len(raw) and r.digest == base64.b32encode(hashlib.sha1(raw).digest()).decode()
        assert (r.kind, r.refers_page) == {1: ("revisit", 2), 3: ("revisit", 4)}.get(page, ("response", None))
        assert r.payload is None if r.kind == "revisit" else bytes(r.payload) == raw
        assert got[page].request.head.startswith("GET ") and got[page].metadata.fields == f"payloadBytes: {len(raw)}\r\n"
    assert warc.captures(spark, warc.write(pages.where("false"))).count() == 0


def test_embeddings_against_brute_force(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 16))
    x[100:200] = x[0] + rng.normal(size=(100, 16)) * 0.25
    x[200:210] = x[1] * 3
    vectors = [v.tolist() for v in x] + [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [1.0, 2.0], [1.0, 2.0]]
    got = sorted(embed_dedup.groups(spark.createDataFrame([(k, v, 1) for k, v in enumerate(vectors)], "vec_id long, embedding array<double>, node int")).collect())
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    links = [(i, j) for i, j in zip(*np.nonzero(near), strict=True) if j < i] + [(405, 404)]
    root = components(len(vectors), links)
    for r in got:
        n = near[r.vec_id].sum() - 1 if r.vec_id < 400 else int(r.vec_id > 403)
        assert (r.n_links, r.component_id, r.kept) == (n, root[r.vec_id], root[r.vec_id] == r.vec_id)


def test_pipeline_runs_in_order(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "mixing", "bpe"]
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and 0 < out.count() < 600


def test_pipeline_against_plain_stages_row_by_row(spark, tmp_path):
    import zstandard
    from tokenizers import Tokenizer

    import corpus_pipeline

    rnd, rows = random.Random(7), []
    prose = lambda n: " ".join("".join(rnd.choice("etaoinshrdlu") for _ in range(rnd.randint(2, 9))) for _ in range(n))
    for k in range(48):
        rows.append((k, f"menu of s{k % 3}\n{prose(rnd.randint(70, 200))}\n{prose(9)}", f"s{k % 3}" if k % 8 else None))
    rows += [(100 + k, rows[k][1] + " " + prose(2), rows[k][2]) for k in range(0, 12, 2)] + [(120 + k, rows[k][1], rows[k][2]) for k in range(20, 24)]
    rows += [(200, "too short", "s0"), (201, "same words again " * 60, "s1"), (202, None, "s2"), (203, "", None)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")

    squeeze = zstandard.ZstdCompressor(level=3).compress
    good = [r for r in rows if quality.judge((r[1] or "").encode(), quality.Bands(), squeeze)[6]]
    pages, holders = collections.Counter(r[2] for r in good), collections.Counter((r[2], x) for r in good for x in set(r[1].split("\n")) if x.strip())
    dropped = {(s, x) for (s, x), n in holders.items() if n >= 5 and n > 0.2 * pages[s]}
    lean = [(d, "\n".join(x for x in t.split("\n") if (s, x) not in dropped), s) for d, t, s in good]
    sets = [shingles(t) for _, t, _ in lean]
    root = components(len(sets), [(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])])
    single = [r for i, r in enumerate(lean) if root[i] == i]
    assert len(rows) > len(good) > len(single) > 20 and dropped
    copies = {r.doc_id: r.copies for r in mixing.mix(spark.createDataFrame(single, "doc_id long, text string, source string")).collect()}
    library, wanted = Tokenizer.from_file(tokenizer()), []
    for d, t, _ in single:
        ids = library.encode(t, add_special_tokens=False).ids
        digests = [hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), library.decode(ids, skip_special_tokens=False))]
        wanted += [(d, len(ids), *digests)] * copies[d]
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == sorted(wanted)


def test_shared_passages_are_marked(spark):
    rnd = random.Random(9)
    prose = lambda n: " ".join("".join(rnd.choice("etaoinshrdlu") for _ in range(rnd.randint(2, 9))) for _ in range(n))
    rows = [(k, prose(120)) for k in range(30)]
    for k in range(10, 20):  # the smallest passage that always shows, each in two rows, at any place
        passage = prose(80)[: suffix_dedup.PASSAGE]
        rows[k] = (k, prose(rnd.randint(0, 90)) + passage + prose(40))
        rows.append((100 + k, prose(rnd.randint(0, 90)) + passage))
    short = prose(40)[: suffix_dedup.PASSAGE - suffix_dedup.PASSAGE_WINDOW]
    rows += [(200, prose(90) + short + prose(90)), (201, short + prose(90)), (202, rows[0][1]), (300, None), (301, None), (302, "")]
    got = {r.doc_id: r.shares_passage for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {k for k, v in got.items() if v} == {0, 202, *range(10, 20), *range(110, 120)}


def test_equal_rows_do_not_multiply(spark):
    text = " ".join(f"w{k}" for k in range(300))
    got = suffix_dedup.remove_repeats(spark.createDataFrame([(1, text)] * 50 + [(2, "x")], "doc_id long, text string")).collect()
    assert [(r.n_removed, r.n_spans) for r in got if r.doc_id == 1] == [(len(text), 1)] * 50


def test_rows_of_one_id_with_different_texts_are_one_document(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(60)) for x in "abc")
    rows = [(5, a), (5, b), (3, a + " z"), (9, b + " z"), (9, b + " z"), (1, c), (None, a)]
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(5, 56, 3, False), (3, 57, 3, True), (9, 57, 3, False), (1, 56, 1, True), (None, 56, None, True)}


def test_targets_of_many_sources_equal_those_worked_out_on_the_driver(spark):
    rnd = random.Random(3)
    rows = [(k, "w " * (1 + int(rnd.paretovariate(0.6)) % 900), f"host{k % 97}" if k % 13 else None, "x", 1) for k in range(1200)]
    df = spark.createDataFrame(rows, DOCS)
    a, b = ({r.doc_id: (r.size, r.source_size, round(r.target, 6), r.taken) for r in mixing.mix(df, at_hand=n).collect()} for n in (10, 10_000))
    assert a == b


def test_taken_words_come_within_a_median_document_of_each_target(spark):
    """Documents of 1 to 20,000 words: in one block a source as lopsided as they come, in several with many of middle size."""
    rnd = random.Random(5)
    tail, middle = ([min(20_000, max(1, int(x()))) for _ in range(3000)] for x in (lambda: rnd.paretovariate(0.7), lambda: rnd.lognormvariate(5, 1.3)))
    for sizes, sources, block in ((tail, 12, 4096), (middle, 2, 512)):
        df = spark.createDataFrame([(k, "w " * n, f"s{k % sources}", "x", 1) for k, n in enumerate(sizes)], DOCS)
        by = collections.defaultdict(list)
        for r in mixing.mix(df, block=block).collect():
            assert 0 <= r.copies <= 3
            by[r.source_size, r.target].append(r)
        for (_, target), rs in by.items():
            assert abs(sum(r.taken for r in rs) - target) <= max(1, sorted(r["size"] for r in rs)[len(rs) // 2])


def spans_of(w, tid_words, k, near):
    """Diagonals of one text and one template by brute force: covered template places of each merged lane."""
    lanes = collections.defaultdict(set)
    for d in range(len(w) - k + 1):
        for t in range(len(tid_words) - k + 1):
            if w[d : d + k] == tid_words[t : t + k]:
                lanes[d - t].add(t)
    groups, last = [], None
    for lane in sorted(lanes):
        if last is None or lane - last > near:
            groups.append(set())
        groups[-1] |= lanes[lane]
        last = lane
    return [len({t + j for t in g for j in range(k)}) for g in groups]


def test_licenses_against_brute_force(spark):
    from quireframe.llm.license_scan import ALL, COVER, NEAR, NOTICES, SHORT, K

    rnd = random.Random(6)
    flat = [(label, t) for label, some in ALL.items() for t in some]
    cases = [t for _, t in flat] + ["Licensed under CC BY-NC 4.0. " * 40, "x " * 50_000 + NOTICES["gpl"][0], None, ""]
    for _ in range(60):
        w = rnd.choice(flat)[1].split()
        for _ in range(rnd.randint(0, 6)):
            k = rnd.randrange(len(w))
            w[k : k + rnd.randint(0, 1)] = rnd.choice([[], ["extra"], ["other", "words"]])
        cases.append(" ".join(["some", "start"] * rnd.randint(0, 4) + w + ["and", "end"]))
    base = [({"mit license": "mit", "apache license": "apache", "general public license": "gpl"}, re.compile("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"))][0]
    words = lambda t: base[1].findall("".join(c.lower() if c.isascii() else c for c in t or ""))
    df = spark.createDataFrame([(k, t, "s", "row", 1) for k, t in enumerate(cases)], "doc_id long, text string, row string, w string, label int")
    got = {r.doc_id: r for r in license_scan.scan(df).collect()}
    for k, t in enumerate(cases):
        w = words(t)
        labels, best = {v for p, v in base[0].items() if f" {p} " in f" {' '.join(w)} "}, 0.0
        for label, tpl in flat:
            m = words(tpl)
            need = max(K, len(m) - 1 if len(m) < SHORT else int(np.ceil(len(m) * COVER)))
            for n in spans_of(w, m, K, NEAR):
                if n >= need:
                    labels.add(label)
                    best = max(best, n / len(m))
        assert (got[k].labels, got[k].n_words) == (",".join(sorted(labels)), len(w)) and abs(got[k].score - min(1.0, best)) < 1e-12


def test_each_edge_of_the_bands_decides():
    import dataclasses

    import zstandard

    rnd = random.Random(5)
    prose = " ".join("".join(rnd.choice("etaoinshrdlu") for _ in range(rnd.randint(2, 9))) for _ in range(900)).encode()
    squeeze = zstandard.ZstdCompressor(level=3).compress
    whole, parts = quality.ratios(prose, 2048, squeeze)
    assert len(parts) == -(-len(prose) // 2048) and parts[-1] == 2048 / len(squeeze(prose[-2048:])) and whole == len(prose) / len(squeeze(prose))
    for ends, kept in (((whole, whole), True), ((whole * 1.001, 9), False), ((0, whole * 0.999), False)):
        bands = quality.Bands(by_length=((len(prose), 99, 99), (len(prose) + 1, *ends), (float("inf"), 99, 99)))
        assert quality.judge(prose, bands, squeeze)[6] == kept
    for ends, bad in (((min(parts), max(parts)), 0), ((min(parts) * (1 + 1e-9), 9), parts.count(min(parts))), ((0, max(parts) * (1 - 1e-9)), parts.count(max(parts)))):
        bands = quality.Bands(by_length=((float("inf"), 0, 99),), chunk_band=ends, chunk_share=0.0)
        got = quality.judge(prose, bands, squeeze)
        assert got[9] == bad and got[6] == (bad == 0)
        assert quality.judge(prose, dataclasses.replace(bands, chunk_share=bad / len(parts)), squeeze)[6]


def test_fitted_bands_reject_junk_and_keep_prose(spark):
    rnd = random.Random(12)
    word = lambda: "".join(rnd.choice("etaoinshrdlu") for _ in range(rnd.randint(2, 9)))
    prose = [" ".join(word() for _ in range(rnd.choice((150, 700)))) for _ in range(300)]
    junk = [" ".join(word() + "&&&%%%" for _ in range(300)) for _ in range(20)] + [base64.b85encode(random.Random(k).randbytes(700)).decode() + " x" * 60 for k in range(5)]
    rows = [(k, t, "s", "x", 1) for k, t in enumerate(prose + junk)] + [(None, None, None, None, None), (900, "", "s", "x", 1)]
    df = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(k, 1, 0) for k in range(250)] + [(k, 0, 0) for k in range(300, 310)] + [(None, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    bands = quality.fit(df, labels)
    kept = {r.doc_id for r in quality.measure(df, bands).where("kept").collect()}
    assert len(kept & set(range(300))) >= 298 and not kept & set(range(300, 325)) and {r.doc_id for r in quality.measure(df).where("kept").collect()} & set(range(300, 320))
    assert quality.fit(df, labels.where("false")).by_length[3][1:] == quality.Bands().by_length[1][1:]
    assert {r.doc_id for r in quality.keep_good(df, bands).collect()} == kept and quality.keep_good(none(spark), bands).count() == 0


def test_digests_of_token_tables_equal_those_of_texts(spark, docs):
    a, b = (sorted(tuple(r) for r in d.collect()) for d in (bpe.encode_decode(docs, tokenizer()), bpe.decoded(bpe.encode_ids(docs, tokenizer(), packed=True), tokenizer())))
    assert a == b and bpe.decoded(bpe.encode_ids(none(spark), tokenizer(), packed=True), tokenizer()).count() == 0
    assert [len(r.ids) for r in bpe.encode_ids(docs, tokenizer()).orderBy("doc_id").collect()] == [x[1] for x in a]


def test_lines_of_large_hosts_and_clashing_names(spark, monkeypatch):
    rows = [(k, f"own {k}\nmenu", "big" if k % 3 else None, "x", k) for k in range(90)] * 2 + [(500 + k, "menu", "small", "x", 1) for k in range(4)]
    names = "doc_id long, text string, host string, drop string, salt int"
    df = spark.createDataFrame([(d, t, h, "keep", s) for d, t, h, _, s in rows], names)
    a = sorted(tuple(r) for r in line_dedup.drop_boilerplate(df, host_col="host").collect())
    monkeypatch.setattr(line_dedup, "TASK_PAGES", 7)
    b = line_dedup.drop_boilerplate(df, host_col="host")
    assert b.columns == df.columns and a == sorted(tuple(r) for r in b.collect())
    assert a == sorted((d, t.split("\n")[0], h, "keep", s) for d, t, h, _, s in rows)


def test_revisits_refer_to_records(spark):
    rows = [(k, "http://a", f"<p>{k}</p>" if k is not None and k % 3 == 0 else "<p>same</p>") for k in [*range(40), 38, 38, None]]
    found = warc.captures(spark, warc.write(spark.createDataFrame(rows, "page_id long, url string, html string"))).collect()
    by = {r.response.record_id: r for r in found}
    assert len(found) == len(by) == 43
    for r in found:
        if r.response.kind == "revisit":
            assert by[r.response.refers_to].response.kind == "response" and by[r.response.refers_to].page_id == r.response.refers_page == 38
        assert r.request is not None and r.metadata is not None


def test_revisits_find_their_records_when_rows_are_numbered_anew(spark, monkeypatch):
    """Rows have other numbers each time that they are worked out, as they may after a lost executor."""
    number = warc.F.udf(lambda: random.getrandbits(60), "long").asNondeterministic()
    monkeypatch.setattr(warc.F, "monotonically_increasing_id", lambda: number())
    for more in ([], [38, 38, None, None], [5, 5]):
        rows = [(k, "http://a", f"<p>{k}</p>" if k is not None and k % 3 == 0 else "<p>same</p>", "x", 1) for k in [*range(40), *more]]
        found = warc.captures(spark, warc.write(spark.createDataFrame(rows, "page_id long, url string, html string, sha string, row int"))).collect()
        by = {r.response.record_id: r for r in found}
        assert len(found) == len(by) == len(rows) and {r.response.kind for r in found} == {"response", "revisit"}
        for r in found:
            if r.response.kind == "revisit":
                assert by[r.response.refers_to].response.kind == "response" and by[r.response.refers_to].page_id == r.response.refers_page == 38


def test_archives_hold_bounded_bytes(spark, monkeypatch):
    import glob
    import gzip

    monkeypatch.setattr(warc, "FILE_BYTES", 20_000)
    path = warc.write(spark.createDataFrame([(k, "u", f"{k:05d}" * 400) for k in range(100)], "page_id long, url string, html string").coalesce(1))
    sizes = [len(gzip.open(f).read()) for f in glob.glob(f"{path.removeprefix('file:')}/*.gz")]
    assert len(sizes) >= 10 and max(sizes) < 40_000 and warc.captures(spark, path).count() == 100


def test_equal_and_empty_vectors(spark):
    schema = "vec_id long, embedding array<double>"
    assert embed_dedup.groups(spark.createDataFrame([], schema)).count() == 0
    assert [tuple(r) for r in embed_dedup.groups(spark.createDataFrame([(4, None), (5, [0.0, 0.0])], schema)).orderBy("vec_id").collect()] == [(4, 0, 4, True), (5, 0, 5, True)]
    rows = [(1, [1.0, 0.0])] * 3 + [(2, [2.0, 0.0]), (None, [1.0, 0.0]), (7, [0.0, 1.0])]
    got = sorted((tuple(r) for r in embed_dedup.groups(spark.createDataFrame(rows, schema)).collect()), key=str)
    assert got == sorted([(1, 3, 1, True)] * 3 + [(2, 3, 1, False), (None, 0, None, True), (7, 0, 7, True)], key=str)


def test_lookahead_settles_borders():
    """Of random small merge lists: texts that share a start have the same borders in it, but for its last letters."""
    rnd = random.Random(7)
    for trial in range(600):
        letters = "ab" if trial % 2 else "abc"
        tokens, merges = list(letters), []
        for _ in range(rnd.randint(1, 9)):
            pair = rnd.choice(tokens), rnd.choice(tokens)
            if pair not in merges and len("".join(pair)) <= 6:
                merges.append(pair)
                tokens += [] if "".join(pair) in tokens else ["".join(pair)]
        m = bpe.Merges({t: k for k, t in enumerate(tokens)}, merges, "")
        for _ in range(12):
            n = m.lookahead + rnd.randint(2, 20)
            start = "".join(rnd.choices(letters, k=rnd.randint(1, 3))) * n if rnd.random() < 0.4 else "".join(rnd.choices(letters, k=n))
            both = []
            for _ in range(2):
                text = start[:n] + "".join(rnd.choices(letters, k=rnd.randint(0, 12)))
                parts = m.merged(list(text))
                assert list(m.stream(iter(text))) == parts
                both.append({sum(map(len, parts[:k])) for k in range(len(parts))})
            assert all(b > n - m.lookahead for b in both[0] ^ both[1] if b <= n)


def test_what_waits_is_bounded_by_the_lookahead():
    m, rnd = bpe.codec(tokenizer()).merges, random.Random(1)
    assert m.lookahead < 1000
    tokens = [t for t in m.vocab if not t.endswith("</w>") and "<|" not in t]
    for trial in range(60):
        text = "".join(rnd.choices(tokens, k=80)) if trial % 3 else "".join(rnd.choices("abcdest", k=900)) if trial % 2 else "ab" * 500
        fed = done = most = 0

        def letters():
            nonlocal fed
            for c in text:  # noqa: B023
                fed += 1
                yield c

        for t in m.stream(letters()):
            most = max(most, fed - done)
            done += len(t.removesuffix("</w>"))
        assert done == len(text) and most <= m.lookahead + 4 * m.longest


def test_shared_passages_are_left_out_of_text(spark):
    rnd = random.Random(4)
    prose = lambda n: " ".join("".join(rnd.choice("etaoinshrdlu") for _ in range(rnd.randint(2, 9))) for _ in range(n))
    passage, long = prose(90)[:330], prose(200)
    rows = [(1, prose(80) + passage + prose(80)), (2, passage + prose(70)), (3, prose(300)), (4, long), (5, "x" + long), (6, None), (7, "é" * 200 + passage)]
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, t in rows:
        r = got[k]
        if k in (1, 2, 7):
            assert r.kept == t and r.n_removed == 0 and r.shares_passage and passage not in r.text and len(t) - 330 <= len(r.text) <= len(t) - 128
            cut = [p for p in range(len(t)) if t[:p] + t[p + len(t) - len(r.text) :] == r.text]
            assert cut and all(t[p : p + len(t) - len(r.text)] in passage for p in cut)
        else:
            assert r.text == r.kept and (r.text == (t or "") if k in (3, 6) else len(r.text) <= 1)
