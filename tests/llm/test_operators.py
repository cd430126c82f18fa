"""Each operator against brute force on small fixtures with nulls, ties, repeats and long texts."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from fractions import Fraction

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from seriesloom.llm import anchors, chat, decontaminate, exchange, jaccard_join, language_id, line_dedup, media, mixing, pieces, queries, rans, substring_dedup, suffix_dedup, textvec, token_output

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, start int, block string, tag string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(n, rng):
    return [rng.choice("alpha beta gamma delta épsilon zeta eta theta iota kappa".split()) + str(rng.randint(0, 400)) for _ in range(n)]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    shared, base = words(60, rng), words(200, rng)
    out = [(i, " ".join(words(rng.randint(1, 120), rng))) for i in range(20)]
    out += [(30 + i, " ".join(words(30, rng) + shared + words(30, rng))) for i in range(8)]
    for i in range(8):  # near copies, with one or two words changed
        w = list(base)
        for _ in range(i % 3):
            w[rng.randrange(len(w))] = "changed"
        out.append((50 + i, " ".join(w)))
    out += [(70, None), (71, ""), (72, " \n\t "), (73, "one"), (74, "one"), (75, "\n".join([" ".join(shared)] * 3)), (76, "é" * 3000), (77, " ".join(words(9000, rng)))]
    out += [(78, "two words"), (79, "Two  Words"), (None, " ".join(base)), (None, None)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    full = [(i, t, ("en", "fr", None)[k % 3], f"src{k % 4}" if k % 5 else None, k, 1, "x", None) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full + full[:2], SCHEMA).repartition(3).cache()  # two rows repeat


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def passages(rows, k=50):
    first, toks = {}, {}
    for i, t in rows:
        if i is not None:
            toks[i] = WORD.findall(t or "")
            for j in range(len(toks[i]) - k + 1):
                key = tuple(toks[i][j : j + k])
                first[key] = min(first.get(key, i), i)
    out = {}
    for i, w in toks.items():
        gone = [False] * len(w)
        for j in range(len(w) - k + 1):
            if first[tuple(w[j : j + k])] < i:
                gone[j : j + k] = [True] * k
        out[i] = (len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g)))
    return out


@pytest.mark.parametrize("op", [(suffix_dedup.suffix_dedup, suffix_dedup.digest), (substring_dedup.substring_dedup, substring_dedup.digest)])
@pytest.mark.parametrize(("bound", "hot"), [(exchange.BROADCAST_BYTES, None), (0, None), (0, 1), (exchange.BROADCAST_BYTES, 5)])
def test_repeated_passages(op, bound, hot, rows, docs, empty):
    got = op[1](op[0](docs, broadcast_bytes=bound, hot=hot)).collect()
    assert len(got) == len(rows) + 2
    want = passages(rows)
    assert sum(v[1] for v in want.values()) > 1000
    assert all(tuple(r)[1:] == want[r.doc_id] for r in got if r.doc_id is not None)
    assert all(r.n_removed == 0 for r in got if r.doc_id is None)
    assert op[0](empty).count() == 0


@pytest.mark.parametrize(("window", "first", "bound", "hot"), [(50, 12, exchange.BROADCAST_BYTES, None), (50, 3, 0, 3), (41, 5, 0, None), (200, 12, exchange.BROADCAST_BYTES, None)])
def test_levels(window, first, bound, hot, rows, docs):
    """Many levels, also odd lengths and windows that none survives, give the rows of brute force."""
    assert len(substring_dedup.lengths(window, first)) > 1
    got = substring_dedup.digest(substring_dedup.substring_dedup(docs, window, first, broadcast_bytes=bound, hot=hot)).collect()
    want = passages(rows, window)
    assert len(got) == len(rows) + 2 and all(tuple(r)[1:] == want[r.doc_id] for r in got if r.doc_id is not None)


def test_hot_suffixes_meet():
    """Any two suffixes that match over a window share one of their two finer signatures."""
    rng = np.random.default_rng(3)
    for window in (4, 7, 50):
        half = window // 2
        side = window - half
        for k in range(side + 1):  # k words to the left agree, side - k to the right
            a, b = (rng.integers(1, 2**32, (2, side), dtype=np.uint32) for _ in range(2))
            b[0, : side - k], b[1, :k] = a[0, : side - k], a[1, :k]
            c = {"sig": np.full(2, 5, np.uint64), "after": np.stack([a[0], b[0]]), "before": np.stack([a[1], b[1]])}
            sig = suffix_dedup.halves(c, side)["sig"]
            assert sig[0] == sig[1] or sig[2] == sig[3]


def test_kept_bytes_and_chunks():
    texts = pa.array(["a  b c", None, "", " x\ny ", "z"])
    buf, offs = textvec.flatten(texts)
    w = textvec.words(buf, offs, textvec.SPACED, 2)
    data, at = textvec.kept_bytes(buf, w, np.array([True, False, True, True, True, True]))
    assert [data[at[i] : at[i + 1]].tobytes() for i in range(5)] == [b"a c", b"", b"", b"x y", b"z"]
    assert [(lo, hi) for lo, hi, *_ in textvec.chunks(texts, 3)] == [(0, 3), (3, 4), (4, 5)] or sum(hi - lo for lo, hi, *_ in textvec.chunks(texts, 3)) == 5
    x = np.array([5, 3, 9, 1, 7, 2], np.uint64)
    assert textvec.sliding(x, 3, np.minimum).tolist() == [3, 1, 1, 1]
    assert len(anchors.tags(w)) == 5


def jaccard_classes(rows, n, num, den):
    sets, inv = {}, defaultdict(set)
    for i, t in rows:
        if i is None:
            continue
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[j : j + n]) for j in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
        for g in sets[i]:
            inv[g].add(i)
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, g in sets.items():
        for j in {j for s in g for j in inv[s] if j < i}:
            if den * len(g & sets[j]) >= num * len(g | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize(("n", "num", "den", "bound", "bits"), [(4, 85, 100, exchange.BROADCAST_BYTES, 64), (5, 80, 100, 0, 64), (2, 50, 100, exchange.BROADCAST_BYTES, 5)])
def test_jaccard_join(n, num, den, bound, bits, rows, docs):
    """Also where so few bits name a set that many share a name, and all open buckets are crowds."""
    got = jaccard_join.jaccard_join(docs, n, num, den, bound, crowd=1, name_bits=bits).collect()
    want = jaccard_classes(rows, n, num, den)
    assert len(got) == len(rows) + 2 and len({c for _, c in want.values()}) < len(want) - 5
    assert all(tuple(r)[1:] == want[r.doc_id] for r in got if r.doc_id is not None)
    assert all(r.component_id is None for r in got if r.doc_id is None)


def test_jaccard_crowds(spark):
    """Dissimilar texts that share much of one passage, some of them near copies: crowded buckets are divided and sliced."""
    rng = random.Random(3)
    shared = words(12, rng)
    texts = [shared + words(rng.randint(3, 12), rng) for _ in range(300)]
    texts += [[*t[:-1], "last"] for t in texts[:40]]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    want = jaccard_classes(rows, 1, 70, 100)
    assert len({c for _, c in want.values()}) < 330
    for crowd in (2, 30, 2000):
        got = jaccard_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), 1, 70, 100, crowd=crowd).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def test_divided_buckets_keep_links():
    """Sets that differ in as many members as a link may meet under one group of their sketches' bits."""
    rng = np.random.default_rng(8)
    bands = jaccard_join.Bands(80, 100, 1000)
    for n in (1, 2, 5, 17, 60, 200, 900):
        a = textvec.mix(rng.integers(0, 2**60, n).astype(np.uint64))
        b = a[int((bands.den - bands.num) * 2 * n / (bands.den + bands.num)) // 2 :]
        if not bands.linked(len(a), len(b), len(b)):
            continue
        vals, at = np.concatenate([np.sort(a), np.sort(b)]), np.array([0, len(a), len(a) + len(b)])
        marks, size = jaccard_join.sketches(vals, at), np.diff(at)
        sig, of = jaccard_join.divided(np.full(2, 99, np.uint64), size, marks, bands)
        assert set(sig[of == 0].tolist()) & set(sig[of == 1].tolist())


def test_jaccard_empty(empty):
    assert jaccard_join.jaccard_join(empty).count() == 0


def test_pigeonhole_covers_every_link():
    """Random linked pairs share a signature in the smaller one's band, also where deletions are indexed."""
    rng = np.random.default_rng(1)
    for population in (1000, 10**9, 10**13):
        bands = jaccard_join.Bands(80, 100, population)
        assert population < 10**13 or (bands.double[:20] > 0).any()
        for _ in range(150):
            n = int(rng.integers(1, 60))
            a = textvec.mix(rng.integers(0, 2**60, n).astype(np.uint64))
            most = bands.den and int((bands.den - bands.num) * 2 * n / (bands.den + bands.num))
            drop = int(rng.integers(0, most + 1)) if most else 0
            b = a[drop:]
            if not len(b) or not bands.linked(len(a), len(b), len(b)):
                continue
            vals, at = np.concatenate([np.sort(a), np.sort(b)]), np.array([0, len(a), len(a) + len(b)])
            sig, of = jaccard_join.signatures(vals, at, bands)
            assert set(sig[of == 0].tolist()) & set(sig[of == 1].tolist())


@pytest.mark.parametrize("one_task", [10**6, 0])
def test_components(spark, one_task):
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(0, 60)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(70)] + [(5, 5)]
    ws = exchange.Workspace(spark, "test")
    got = {r.node: r.component for r in exchange.components(ws, "c", spark.createDataFrame(links, "a long, b long"), one_task).collect()}
    label = {x: x for ab in links for x in ab}
    for _ in range(200):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    assert got == {k: v for k, v in label.items() if any(k in ab and ab[0] != ab[1] for ab in links)}
    assert exchange.components(ws, "none", spark.createDataFrame([], "a long, b long"), one_task).count() == 0


def test_media(rows, docs, empty, spark, tmp_path):
    got = [tuple(r) for r in media.digest(media.media_table(docs)).collect()]
    assert len(got) == len(rows) + 2 and all(r[-1] is None for r in got)
    want = defaultdict(set)
    for i, t in rows:
        raw = (t or "").encode()
        p = raw + bytes(-len(raw) % 64 if raw else 64)
        want[i].add((len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])))
    assert all(r[1:5] in want[r[0]] for r in got)
    assert len({r[6:] for r in got if r[0] in (73, 74)}) <= 2 and len({r[3:8] for r in got if r[0] in (73, 74)}) == 1
    assert media.media_table(empty).count() == 0
    # a damaged member costs itself alone
    uri = f"file://{tmp_path}/a"
    assert media.write_archives(docs.filter("doc_id < 10"), uri, 4000).collect()
    file = sorted((tmp_path / "a").glob("*.zip"))[0]
    raw = bytearray(file.read_bytes())
    raw[raw.find(b"IDAT") + 8] ^= 255
    file.write_bytes(bytes(raw))
    spark.dataSource.register(media.MediaArchives)
    back = spark.read.format("media_archives").option("path", uri).option("rangeBytes", 500).load().collect()
    assert sum(r.error is not None for r in back) == 1 and len(back) == 12
    assert all(media.from_png(bytes(r.media)) for r in back if r.error is None)


def plain_png(raw):
    """The samples of an 8-bit grey PNG without filters, by the format's own rules."""
    assert raw[:8] == bytes([137, 80, 78, 71, 13, 10, 26, 10])
    at, data = 8, b""
    while at < len(raw):
        n, kind = int.from_bytes(raw[at : at + 4], "big"), raw[at + 4 : at + 8]
        if kind == b"IHDR":
            w, h, depth, colour = int.from_bytes(raw[at + 8 : at + 12], "big"), int.from_bytes(raw[at + 12 : at + 16], "big"), raw[at + 16], raw[at + 17]
        data += raw[at + 8 : at + 8 + n] if kind == b"IDAT" else b""
        at += 12 + n
    data = zlib.decompress(data)
    assert (w, depth, colour) == (64, 8, 0) and len(data) == h * 65 and not any(data[::65])
    return b"".join(data[k * 65 + 1 : k * 65 + 65] for k in range(h))


def plain_feature(p):
    h, cell = len(p) // 64, []
    for i in range(8):
        lo = min(i * h // 8, h - 1)
        rows = range(lo, max((i + 1) * h // 8, lo + 1))
        cell.append([sum(p[r * 64 + 8 * j + k] for r in rows for k in range(8)) / (8 * len(rows)) for j in range(8)])
    mean = sum(map(sum, cell)) / 64
    bits = "".join("1" if c > mean else "0" for row in cell for c in row)
    return f"{h}x64:{sum(p) / len(p):.4f}:{int(bits, 2):016x}"


def test_media_forms(rows, docs):
    """Stored bytes, digests and features against the format and the definition."""
    stored = {(r.doc_id, r.n_bytes, hashlib.sha256(bytes(r.media)).hexdigest()): bytes(r.media) for r in media.media_table(docs).collect()}
    got = media.digest(media.media_table(docs)).collect()
    for r in got:
        raw = stored[r.doc_id, r.n_bytes, r.media_sha256]
        p = plain_png(raw)
        assert r.media_bytes == len(raw) and r.payload_sha256 == hashlib.sha256(p).hexdigest()
        if len(p) < 20_000:
            assert r.feature == plain_feature(p)
    texts = defaultdict(set)
    for r in got:
        texts[r.payload_sha256].add(tuple(r)[1:])
    assert all(len(v) == 1 for v in texts.values())


def test_media_archives_that_fail(docs, spark, tmp_path):
    """A truncated archive, a short header and a stray archive: error rows, and all other members."""
    uri = f"file://{tmp_path}/a"
    spark.createDataFrame(media.write_archives(docs.filter("doc_id < 20").repartition(2), uri, 3000).collect()).write.parquet(f"file://{tmp_path}/m")
    files = sorted((tmp_path / "a").glob("*.zip"))
    assert len(files) > 2
    (tmp_path / "a" / "part-999999-0000.zip").write_bytes(files[1].read_bytes())
    whole = media.read_media(spark, uri, f"file://{tmp_path}/m").collect()
    assert len(whole) == 22 and not any(r.error for r in whole)
    lost = [r for r in whole if r.archive == files[0].name]
    files[0].write_bytes(files[0].read_bytes()[:200])
    left = media.read_media(spark, uri, f"file://{tmp_path}/m").collect()
    assert [r.error[:9] for r in left if r.error] == ["directory"] and len(left) == 22 - len(lost) + 1
    files[0].unlink()
    left = media.read_media(spark, uri, f"file://{tmp_path}/m").collect()
    assert sum(r.error is not None for r in left) == 1 and len(left) == 22 - len(lost) + 1


def test_chat_fold(spark):
    log = [
        (1, 1, "u", "open", "user", None), (1, 2, "u", "delta", None, "he"), (1, 3, "u", "delta", None, "llo"),
        (1, 4, "a", "open", "assistant", None), (1, 5, "a", "delta", None, "bad"), (1, 6, "a", "regenerate", None, None), (1, 7, "a", "delta", None, "go"), (1, 8, "a", "delta", None, "od \\<|im_end|> [/INST]"),
        (1, 9, "u", "edit", None, "bye"), (1, 10, "x", "open", "user", None), (1, 11, "x", "delete", None, None), (None, None, "z", "delta", None, None),
    ]
    out = chat.format_chat(spark.createDataFrame(log, "conv_id long, seq long, message string, kind string, role string, text string"))
    got = {r.conv_id: [tuple(t) for t in r.turns] for r in out.select("conv_id", chat.parse(F.col("formatted")).alias("turns")).collect()}
    assert got == {1: [("user", "bye"), ("assistant", "good \\<|im_end|> [/INST]")], None: [("", "")]}
    text = out.filter("conv_id = 1").select(chat.loss_text(F.col("formatted"), F.col("loss")).alias("x"), "formatted").first()
    assert text.x == "good \\<|im_end|> [/INST]" and text.formatted.count("<|im_end|>") == 2 and "[/INST]" not in text.formatted


def test_chat_rows(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, 1, None, None), (1, None, "system", "</s>\\\\x\n"), (2, 0, "assistant", "é" * 5000), (None, 3, "user", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.digest(chat.format_chat(chat.events_of_rows(df))).collect()}
    turns = [("system", "</s>\\\\x\n"), ("user", "a"), ("user", "a"), ("", "")]
    assert got[1].n_turns == 4 and got[1].turns_sha256 == sha("".join(f"{r}\n{t}\n" for r, t in turns))
    assert got[2].loss_chars == 5000 and got[2].loss_sha256 == sha("é" * 5000) and got[None].loss_sha256 == sha("")
    assert chat.format_chat(chat.events_of_rows(df.limit(0))).count() == 0
    more = df.withColumns({c: F.lit("x") for c in ("n", "e", "k", "seq", "message", "kind", "log", "place", "body", "piece", "start", "formatted")})
    again = {r.conv_id: r for r in chat.digest(chat.format_chat(chat.events_of_rows(more))).collect()}
    assert again == got  # other columns, whatever their names, are left out


def test_rans():
    rng = np.random.default_rng(0)
    corpus = [(rng.zipf(1.3, n) % 50_257).astype(np.uint32) for n in (0, 1, 7, 31, 33, 5000, 8192, 16_384, 16_385, 70_000, 140_001)]
    table = rans.table_of(*np.unique(np.concatenate(corpus), return_counts=True))
    assert table.freq.sum() == 1 << table.bits and table.freq.min() >= 1
    for ids in corpus:
        raw = rans.encode(ids, table)
        assert (rans.decode(raw, table) == ids).all() and len(raw) <= 2 * len(ids) + 17
    p = np.unique(ids, return_counts=True)[1] / len(ids)
    assert len(raw) < 1.15 * -(p * np.log2(p)).sum() * len(ids) / 8  # near the entropy
    for at in (3, 14, len(raw) // 2, len(raw) - 1):
        bad = bytearray(raw)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            rans.decode(bytes(bad), table)
    big = np.array([2**31, 5, 2**32 - 1], np.uint32)
    assert (rans.decode(rans.encode(big, rans.table_of(*np.unique(big, return_counts=True))), rans.table_of(*np.unique(big, return_counts=True))) == big).all()
    with pytest.raises(ValueError, match="not in the table"):
        rans.encode(np.array([50_258], np.uint32), table)


@pytest.mark.parametrize("run", [1024, 2])
def test_token_output(run, rows, docs, empty, spark, monkeypatch):
    monkeypatch.setattr(token_output, "RUN", run)
    tok = Tokenizer.from_file(queries.default_tokenizer())
    at, want = 0, []
    for r in docs.select("doc_id", "text", F.xxhash64("text").alias("h")).orderBy("doc_id", "h").collect():
        ids = np.array([*tok.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((r.doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    got = [tuple(r) for r in token_output.token_table(docs, queries.default_tokenizer()).collect()]
    assert sorted(got, key=lambda r: r[1]) == want
    assert token_output.token_table(empty, queries.default_tokenizer()).count() == 0
    ws = exchange.Workspace(spark, "tokens")
    token_output.write_ids(docs, ws.path("f"), queries.default_tokenizer(), segment=500)
    back = {r.start: bytes(r.ids) for r in token_output.read_ids(spark, ws.path("f")).collect()}
    assert all(zlib.crc32(back[s]) == c for _, s, _, c in want)
    segments = spark.read.parquet(ws.path("f/segments")).select("n_ids", F.length("ids").alias("n")).collect()
    assert len(segments) >= 4 and all(r.n <= 2 * r.n_ids + 17 for r in segments)
    ws.close()


TEXT_PARTS = ["don't", "'s", "''s", " 'll", "\t've", "I'd've", "'S", "’s", "“q”", "naïve", "日本語", "½²", "٣٤", "\u00a0", "\u2028", "\u0085", "\x0b", "\x1f", "\x00", "e\u0301", "🙂", "👍🏽", "×", "ü", " ", "  ", "\n\n", "\r\n", "a", "12", "3.5", "!?", "жщ", "\u0378", "\U0001fae8", "<|endoftext|>", "'", "ไทย", "\u3000"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_of_any_text_are_the_librarys(name):
    path, rng = str(public_tokenizers.path(name)), random.Random(9)
    tok, enc = Tokenizer.from_file(path), pieces.Encoder(path)
    assert enc.fast == (name == "byte_bpe_50k.json")
    for _ in range(300):
        texts = ["".join(rng.choice(TEXT_PARTS) for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(1, 5))]
        ids, count = enc.encode(*textvec.flatten(pa.array(texts)))
        cut = np.concatenate([[0], np.cumsum(count)])
        assert [ids[cut[i] : cut[i + 1]].tolist() for i in range(len(texts))] == [tok.encode(t, add_special_tokens=False).ids for t in texts]
    for raw in (b"ab\xff c", b"\xc3", b"\xc3(", b"a\x80 b", b"\xe2\x80 d"):
        ids, _ = enc.encode(*textvec.flatten(pa.array([b"it is ", raw, b"so"])))
        assert ids.tolist() == [i for t in (b"it is ", raw, b"so") for i in tok.encode(t.decode("utf-8", "replace"), add_special_tokens=False).ids]


@pytest.mark.parametrize("kept", [1, 4, 6])
def test_pieces_beyond_the_cache(kept, monkeypatch):
    monkeypatch.setattr(pieces, "KEPT", kept)
    tok = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    enc = pieces.Encoder(str(public_tokenizers.path("byte_bpe_50k.json")))
    for text in ("one two three", "one two three four five six seven", "seven eight one nine two", "one two three", "ten"):
        assert enc.encode(*textvec.flatten(pa.array([text])))[0].tolist() == tok.encode(text, add_special_tokens=False).ids


def plain_budgets(leaves, weights, total, epochs):
    """Water filling with fractions, child by child; the largest remainders get the odd tokens."""
    weight = lambda p: Fraction(round(weights.get(p, 1.0) * 10**6))

    def usable(path, own):
        if path in leaves:
            return epochs * leaves[path]
        return sum(usable(c, own) for c in children(path) if weight(c) > 0)

    def children(path):
        return sorted({p[: len(path) + 1] for p in leaves if p[: len(path)] == path})

    out = dict.fromkeys(leaves, 0)

    def give(path, amount):
        if path in leaves:
            out[path] = amount
            return
        open_ = [c for c in children(path) if weight(c) > 0 and usable(c, leaves) > 0]
        part = {}
        while open_:
            mass = sum(map(weight, open_))
            full = [c for c in open_ if amount * weight(c) / mass >= usable(c, leaves)]
            if not full:
                exact = {c: amount * weight(c) / mass for c in open_}
                part |= {c: int(x) for c, x in exact.items()}
                odd = amount - sum(part[c] for c in open_)
                for c in sorted(open_, key=lambda c: (part[c] - exact[c], c))[: int(odd)]:
                    part[c] += 1
                break
            for c in full:
                part[c] = usable(c, leaves)
                amount -= part[c]
                open_.remove(c)
        for c, x in part.items():
            give(c, x)

    give((), min(total, usable((), leaves)))
    return out


def spark_budgets(spark, leaves, weights, total, epochs):
    names = [f"l{k}" for k in range(len(next(iter(leaves))))]
    df = spark.createDataFrame([(*p, t) for p, t in leaves.items()], ", ".join([*(f"{n} string" for n in names), "t long"]))
    return {tuple(r)[:-2]: r.budget for r in mixing.budgets(df, weights, total, epochs).collect()}


def test_budgets(spark):
    leaves = {("a", "x"): 100, ("a", "y"): 100, ("b", "x"): 100}
    assert spark_budgets(spark, leaves, {("a",): 3, ("a", "y"): 0}, 160, 1) == {("a", "x"): 100, ("a", "y"): 0, ("b", "x"): 60}  # a leaf of weight 0 costs nothing
    assert spark_budgets(spark, {("a", "x"): 10, ("a", "y"): 100, ("b", "x"): 100}, {}, 100, 1) == {("a", "x"): 10, ("a", "y"): 40, ("b", "x"): 50}  # the sibling takes the shortage
    rng = random.Random(11)
    for _ in range(6):
        leaves = {(rng.choice("ab"), rng.choice("xyz"), rng.choice("12345")): rng.choice([0, 1, 7, rng.randint(1, 10**6), 10**14]) for _ in range(rng.randint(1, 20))}
        weights = {p[: rng.randint(1, 3)]: rng.choice([0, 0.5, 1e-7, 3, 1 / 3]) for p in leaves if rng.random() < 0.6}
        weights = {p: max(w, 1e-6) if w else 0 for p, w in weights.items()}
        total, epochs = rng.randint(0, 2 * sum(leaves.values()) + 1), rng.randint(1, 3)
        got = spark_budgets(spark, leaves, weights, total, epochs)
        assert got == plain_budgets(leaves, weights, total, epochs)
        usable = sum(epochs * t for p, t in leaves.items() if all(weights.get(p[:k], 1) > 0 for k in (1, 2, 3)))
        assert sum(got.values()) == min(total, usable)


@pytest.mark.parametrize("bound", [exchange.BROADCAST_BYTES, 0])
def test_mixing(bound, spark, rows, docs, empty, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 3)
    levels = mixing.tree()
    got = mixing.mix(docs, levels, mixing.DOMAIN_WEIGHTS, share=2.0, epochs=3, broadcast_bytes=bound).collect()
    assert len(got) == len(rows) + 2 and max(r.copies for r in got) <= 3
    table = docs.select("doc_id", "text", *(F.coalesce(c, F.lit("unknown")).alias(n) for n, c in levels.items())).collect()
    leaves = defaultdict(list)
    for r in table:
        leaves[r.domain, r.lang, r.source].append((r.doc_id, len(WORD.findall(r.text or ""))))
    tokens = {p: sum(n for _, n in x) for p, x in leaves.items()}
    want, each = [], plain_budgets(tokens, mixing.DOMAIN_WEIGHTS, 2 * sum(tokens.values()), 3)
    for p, x in leaves.items():
        whole, rest = divmod(each[p], tokens[p]) if tokens[p] else (0, 0)
        run = 0
        for i, n in sorted(x, key=lambda y: (hashlib.md5(f"7:{whole}:{'' if y[0] is None else y[0]}".encode()).hexdigest(), y[0] is not None, y[0] or 0, y[1])):
            run += n
            want.append((i, *p, n, whole + (rest > 0 and run <= rest)))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert mixing.mix(empty, mixing.tree(), {}).count() == 0
    clash = docs.withColumns({c: F.lit("x") for c in ("t", "w1", "cap1", "budget", "key", "bucket", "whole", "n", "level_0")})
    assert mixing.mix(clash, {"t": F.col("t"), "key": F.col("lang")}, {}).columns == ["doc_id", "t", "key", "n_tokens", "copies"]
    for bad in (-1.0, float("nan")):
        with pytest.raises(ValueError, match="weight"):
            mixing.mix(docs, mixing.tree(), {("web",): bad})


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def mutated(x, rng, times):
    y = list(x)
    for _ in range(times):
        k, p = rng.randint(0, 2), rng.randrange(len(y) + 1)
        if k == 0:
            y.insert(p, rng.choice("abcé"))
        elif p < len(y):
            y[p : p + 1] = [] if k == 1 else [rng.choice("abcé")]
    return "".join(y)


def test_edit_distance():
    rng = random.Random(3)
    xs = ["".join(rng.choice("abcé") for _ in range(rng.randint(0, 24))) for _ in range(800)]
    ys = [mutated(x, rng, rng.randint(0, 5)) for x in xs]
    for e in (1, 2, 3):
        assert line_dedup.within(xs, ys, e).tolist() == [plain_distance(a, b) <= e for a, b in zip(xs, ys)]


def plain_lines(docs):
    seen, want = [], defaultdict(set)
    for i, t in sorted((r for r in docs if r[0] is not None), key=lambda r: r[0]):
        lines, keep = (t or "").split("\n"), []
        for x in lines:
            if x.strip("\t\n\x0b\x0c\r "):
                gone = x in seen or (len(x) >= 20 and any(len(y) >= 20 and plain_distance(x, y) <= 2 for y in seen))
                seen.append(x)
                if gone:
                    continue
            keep.append(x)
        want[i].add((len(lines), len(lines) - len(keep), sha("\n".join(keep))))
    for i, t in docs:
        if i is None:
            want[i].add((len((t or "").split("\n")), 0, sha(t or "")))
    return want


@pytest.mark.parametrize(("bound", "local", "crowd", "work"), [(exchange.BROADCAST_BYTES, 100, 2000, 10**7), (0, 100, 2000, 10**7), (0, 1, 2000, 30), (0, 10**6, 3, 30)])
def test_line_dedup(bound, local, crowd, work, spark):
    rng = random.Random(8)
    seeds = ["".join(rng.choice("abcé ") for _ in range(40)) for _ in range(6)]
    shared = "the same first third "
    docs = [(i, "\n".join(mutated(rng.choice(seeds), rng, rng.randint(0, 3)) for _ in range(rng.randint(1, 5)))) for i in range(60)]
    docs += [(60 + i, shared + mutated("xyz uvw 0123456789 no tail", rng, i % 7) + "\n" + shared + "".join(rng.choice("abcdefgh") for _ in range(30))) for i in range(40)]
    docs += [(200, None), (201, ""), (202, "ab\n\n \nab\nab"), (203, "ab"), (None, docs[0][1]), (204, "é" * 400 + "\nx\n" + "é" * 401)]
    repeated = [docs[3], docs[3], docs[61], (202, "ab\n\n \nab\nab")]
    table = spark.createDataFrame([(i, t, 1, "x", "y", 2) for i, t in docs + repeated], "doc_id long, text string, line int, want string, node string, grp int").repartition(3)
    got = line_dedup.digest(line_dedup.line_dedup(table, broadcast_bytes=bound, local=local, crowd=crowd, work=work)).collect()
    want = plain_lines(docs)
    assert sum(n for v in want.values() for _, n, _ in v) > 50
    assert len(got) == len(docs + repeated) and all(tuple(r)[1:] in want[r.doc_id] for r in got)


def test_lines_of_a_crowd(spark):
    """Distinct lines that share a third go finer, and their comparisons stay far below the square."""
    rng = random.Random(2)
    docs = [(i, "\n".join("shared third of a line " + "".join(rng.choice("abcdefghijklmnop") for _ in range(46)) for _ in range(20))) for i in range(1000)]
    docs.append((5000, docs[7][1].split("\n")[3][:-2] + "zz"))
    got = {r.doc_id: r.n_removed for r in line_dedup.line_dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got.pop(5000) == 1 and not any(got.values())


def test_lines_that_are_not_utf8(spark):
    df = spark.sql("SELECT 1L doc_id, CAST(X'616263FF0A6465' AS STRING) text UNION ALL SELECT 2L, CAST(X'6465' AS STRING)")
    assert {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in line_dedup.line_dedup(df).collect()} == {1: (2, 0, "abc\ufffd\nde"), 2: (1, 1, "")}


def test_line_dedup_empty(empty):
    assert line_dedup.line_dedup(empty).count() == 0


def folded(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


@pytest.mark.parametrize(("phrases", "piece"), [(100_000, 1 << 20), (5, 64)])
def test_decontaminate(phrases, piece, rows, docs, empty, spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "PHRASES", phrases)
    hits = decontaminate.hits

    def small(*args):  # workers get this function by value
        decontaminate.PIECE = piece
        return hits(*args)

    monkeypatch.setattr(decontaminate, "hits", small)
    items = [(1, " ".join(rows[25][1].split()[20:45])), (2, "Two, words"), (3, None), (None, "one"), (4, "..."), (5, rows[3][1]), (5, rows[3][1]), (10, "two words")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    win = defaultdict(set)
    for i, t in items:
        w = folded(t)
        if i is not None and w:
            for k in range(max(1, len(w) - 9)):
                win[tuple(w[k : k + 10])].add(i)
    want = {}
    for i, t in rows:
        w, found = folded(t), set()
        hit = [False] * len(w)
        for n in {len(k) for k in win}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in win:
                    hit[k : k + n] = [True] * n
                    found |= win[tuple(w[k : k + n])]
        want.setdefault(i, set()).add((len(w), sum(hit), len(found), sha(",".join(sorted(map(str, found)))), any(hit)))
    got = decontaminate.digest(decontaminate.decontaminate(docs, bench)).collect()
    assert len(got) == len(rows) + 2 and all(tuple(r)[1:] in want[r.doc_id] for r in got)
    assert sum(r.contaminated for r in got) >= 4
    assert decontaminate.decontaminate(empty, bench).count() == 0
    assert not any(r.contaminated for r in decontaminate.digest(decontaminate.decontaminate(docs, bench.limit(0))).collect())


def test_fm_index():
    rng = np.random.default_rng(2)
    seq = rng.integers(1, 4, 3000)
    seq[500:1500] = seq[1500:2500]
    index = decontaminate.FMIndex(seq)
    for n in (1, 3, 10):
        for _ in range(20):
            k = int(rng.integers(0, 2900))
            lo, hi = index.search(seq[None, k : k + n])
            want = [j for j in range(len(seq) - n + 1) if (seq[j : j + n] == seq[k : k + n]).all()]
            assert sorted(index.locate(np.arange(lo[0], hi[0])).tolist()) == want
    assert index.search(np.array([[9, 1]]))[0] == index.search(np.array([[9, 1]]))[1]


def test_language_id(spark, sf, docs, empty):
    table = spark.read.parquet(f"{sf}/documents.parquet")
    model = language_id.train(table)
    got = language_id.identify(table, model).join(table.select("doc_id", "lang"), "doc_id").filter("held_out")
    right, n = got.agg(F.count_if(F.col("lang") == F.col("lang_pred")), F.count("*")).first()
    assert n > 20 and right >= 0.95 * n
    out = language_id.identify(docs, model).collect()
    assert all((r.lang_pred == "und") == (r.score == 0) for r in out) and {r.lang_pred for r in out if r.doc_id in (70, 71, 72)} == {"und"}
    assert language_id.train(empty).languages == [] and language_id.identify(empty, model).count() == 0
    assert {r.lang_pred for r in language_id.identify(docs, language_id.train(empty)).collect()} == {"und"}
    codes = language_id.codebook(12)
    assert min((codes[i] != codes[j]).sum() for i in range(12) for j in range(i)) > 10
    carried = language_id.identify(docs.select("doc_id", "text", F.struct("*").alias("row")), model, carry=("row",)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.row.text or "", r.lang_pred) for r in carried) == sorted((r.doc_id is None, r.doc_id or 0, r.row.text or "", r.lang_pred) for r in carried if r.row.doc_id == r.doc_id) and len(carried) == len(out)


def test_language_model(monkeypatch):
    """Both forms of the equations give one model, and decoding is the loss-weighted sum over bits."""
    rng = np.random.default_rng(6)
    means = rng.random((9, language_id.DIMS)).astype(np.float32)
    groups = [(f"l{k}", np.abs(means[k] + rng.normal(0, 0.3, (20 + k, language_id.DIMS)).astype(np.float32))) for k in range(9)]
    groups = [(n, x / np.linalg.norm(x, axis=1, keepdims=True)) for n, x in groups]
    dual = language_id.fit(groups)
    monkeypatch.setattr(language_id, "DUAL", 50)
    primal = language_id.fit(groups)
    assert np.allclose(dual.weights, primal.weights, atol=1e-3) and np.allclose(dual.trust, primal.trust, rtol=1e-2)
    x = np.vstack([x[:3] for _, x in groups]).astype(np.float64)
    want = []
    for row in x:
        f = [language_id.STEEP * (row @ dual.weights[:-1, b] + dual.weights[-1, b]) for b in range(dual.codes.shape[1])]
        loss = [sum(dual.trust[b] * np.log1p(np.exp(-dual.codes[k, b] * f[b])) for b in range(len(f))) for k in range(9)]
        want.append(loss)
    assert np.allclose(dual.losses(x), want, rtol=1e-6)
    assert dual.losses(x).argmin(1).tolist() == [k for k in range(9) for _ in range(3)]


def test_language_sample(spark, sf):
    """Ranks cut by a bound are the ranks of all; one doc_id on many rows stays within the bound."""
    table = spark.read.parquet(f"{sf}/documents.parquet")
    few = language_id.train(table, per_language=5)
    assert few.languages == sorted(r[0] for r in table.select("lang").distinct().collect() if r[0])
    many = spark.createDataFrame([(1, f"text {k}", "xx") for k in range(500)], "doc_id long, text string, lang string")
    assert language_id.train(many.unionByName(table.select("doc_id", "text", "lang")), per_language=20).languages[-1] in ("xx", few.languages[-1])


def test_pipeline(spark, sf):
    import corpus_pipeline

    names = spark.read.parquet(f"{sf}/documents.parquet").columns
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs.count(), stage(spark, docs, sf)
        assert docs.columns == names and 0 < docs.count() <= before
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert {r.doc_id for r in out.select("doc_id").collect()} == {r.doc_id for r in docs.select("doc_id").collect()}


def test_pipeline_rows(spark, sf):
    """Every stage's decision made anew in Python: near duplicates, passages and ids by brute force, languages and the mix from their operators' rows."""
    import corpus_pipeline

    table = spark.read.parquet(f"{sf}/documents.parquet")
    docs = {r.doc_id: r for r in table.collect()}
    found = {r.doc_id: r for r in language_id.identify(table, language_id.train(table)).collect()}
    docs = {i: r for i, r in docs.items() if found[i].lang_pred != "und" and found[i].score >= corpus_pipeline.LEAST_SHARE}
    near = jaccard_classes([(i, r.text) for i, r in docs.items()], 5, 80, 100)
    docs = {i: r for i, r in docs.items() if near[i][1] == i}
    windows = set()
    for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        w = folded(r.text)
        windows |= {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9)) if w}
    sizes = {len(w) for w in windows}

    def clean(t):
        w = folded(t)
        return not any(tuple(w[k : k + n]) in windows for n in sizes for k in range(len(w) - n + 1))

    docs = {i: r for i, r in docs.items() if clean(r.text)}
    leaves, tokens = defaultdict(list), defaultdict(int)
    for i, r in docs.items():
        domain = "crawl" if r.source == "src0" else "web" if re.fullmatch("src[1-9]", r.source or "") else "curated"
        leaf = (domain, r.lang or found[i].lang_pred, r.source or "unknown")
        leaves[leaf].append(i)
        tokens[leaf] += len(WORD.findall(r.text or ""))
    each, mix = plain_budgets(dict(tokens), mixing.DOMAIN_WEIGHTS, 8 * sum(tokens.values()) // 10, 1), set()
    for leaf, ids in leaves.items():
        whole, rest, run = *(divmod(each[leaf], tokens[leaf]) if tokens[leaf] else (0, 0)), 0
        for i in sorted(ids, key=lambda i: hashlib.md5(f"7:{whole}:{i}".encode()).hexdigest()):
            run += len(WORD.findall(docs[i].text or ""))
            if whole or (rest and run <= rest):
                mix.add(i)
    tok, at, want = Tokenizer.from_file(queries.default_tokenizer()), 0, []
    for i in sorted(mix):
        ids = np.array([*tok.encode(docs[i].text or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, sf).collect()) == want and len(want) > 20


def test_pipeline_edges(spark, sf):
    """Nulls in every column, repeated rows and doc_ids, empty and long texts, clashing names, an empty table: stage by stage."""
    import corpus_pipeline

    table = spark.read.parquet(f"{sf}/documents.parquet")
    some = table.filter("lang IS NOT NULL").orderBy("doc_id").limit(60).collect()
    clash = ["lang_pred", "score", "row", "component_id", "n_shingles", "starts", "items", "copies", "level_0", "key", "t", "domain", "n_tokens", "held_out"]
    schema = ", ".join(["doc_id long, text string, lang string, source string, n_chars long", *(f"`{c}` string" for c in clash)])
    plain = [tuple(r) for r in some]
    odd = [(None, plain[0][1], "en", None, None), (None, None, None, None, None), (900, "", "en", "src1", 0), (901, None, None, "src0", 0), (901, plain[1][1] + " " + plain[2][1], None, "src0", 0), (902, plain[3][1] * 200, "en", "src2", 0)]
    rows = [(*r, *("x" for _ in clash)) for r in plain * 2 + odd + odd[-1:]]
    docs = spark.createDataFrame(rows, schema).repartition(3)
    names = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    left = stages["language id"](spark, docs, sf)
    assert left.columns == names and left.filter("text IS NULL OR text = ''").isEmpty() and left.filter("lang IS NULL").isEmpty()
    assert left.filter("doc_id = 901").count() == 1 and left.filter("doc_id IS NULL").count() == 1
    near = stages["near duplicates"](spark, docs, sf)
    got = [(r.doc_id, r.text) for r in near.collect()]
    assert near.columns == names and len(got) == len(set(got)) < len(rows) - 60
    texts = [(k, r[1]) for k, r in enumerate(sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)))]
    assert len(got) == len({c for _, c in jaccard_classes(texts, 5, 80, 100).values()})
    items = {w for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect() for f in [folded(r.text)] for k in range(max(1, len(f) - 9)) for w in [tuple(f[k : k + 10])] if f}
    clean = stages["decontamination"](spark, docs, sf)
    holds = lambda t: any(tuple(w[k : k + n]) in items for w in [folded(t)] for n in {len(x) for x in items} for k in range(len(w) - n + 1))
    assert clean.columns == names and clean.count() == sum(not holds(r[1]) for r in rows)
    mixed = stages["mixing"](spark, docs, sf)
    assert mixed.columns == names and 0 < mixed.count() <= len(rows)
    total = lambda d: sum(len(WORD.findall(r.text or "")) for r in d.select(docs.columns[1]).collect())
    assert total(mixed) <= 0.8 * total(docs)
    assert stages["token ids"](spark, docs, sf).count() == len(rows)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0, name
