"""PNG media, WARC archives, chat formatting, packing and BPE: exact round trips and library parity."""

import base64
import hashlib
import random
import struct
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from foliant.llm import bpe, chat, packing, png_media, warc_store
from foliant.llm.chunks import Chunks
from foliant.llm.common import Scratch
from foliant.llm.queries import ADDED_TEXT, QUERIES, SQL

DATA = "/root/testdata/sf0.001"
JSON, RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def odd_texts():
    rng = random.Random(4)
    out = ["", " ", "\n", "a", "\n\n x", "x \n y", " lead", "trail ", "tab\tin", "a  b", "don't can't I'll", "<|endoftext|> in <|endoftext|>"]
    out += ["".join(rng.choice(" \n\t\x0b\x1c\x85 　'.,ab1é!") for _ in range(80)) for _ in range(150)]
    out += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0xA0, 0x250), rng.randrange(0x3040, 0x30FF), 0x1F600])) for _ in range(120)) for _ in range(50)]
    return out


@given(st.binary(min_size=1, max_size=700))
@settings(max_examples=60, deadline=None)
def test_png_round_trip(data):
    payload = data.ljust(-(-len(data) // 64) * 64, b"\0")
    png = png_media.decode_png(png_media.encode_png(payload, len(data)))
    assert png.samples.tobytes() == payload and png.n_bytes == len(data)


def filtered(img, kinds):
    """Rows filtered by the format's definition, sample by sample."""
    out = []
    for y, kind in enumerate(kinds):
        row = [kind]
        for x in range(img.shape[1]):
            a = int(img[y, x - 1]) if x else 0
            b = int(img[y - 1, x]) if y else 0
            c = int(img[y - 1, x - 1]) if x and y else 0
            p = a + b - c
            paeth = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            row.append((int(img[y, x]) - [0, a, b, (a + b) // 2, paeth][kind]) & 255)
        out.append(row)
    return np.array(out, np.uint8)


def test_png_unfilters_all_kinds():
    rng = np.random.default_rng(0)
    img = rng.integers(0, 256, (40, 9), dtype=np.uint8)
    for kinds in ([0] * 40, [1] * 40, [2] * 40, [3] * 40, [4] * 40, rng.integers(0, 5, 40).tolist()):
        assert (png_media.unfilter(filtered(img, kinds)) == img).all()
    with pytest.raises(png_media.PngError):
        png_media.unfilter(np.array([[7, 1, 2]], np.uint8))


def test_png_checks_its_checksums():
    good = png_media.encode_png(bytes(range(64)) * 3, 100)
    for at in range(0, len(good), 3):
        bad = bytearray(good)
        bad[at] ^= 0x10
        with pytest.raises(png_media.PngError):
            png_media.decode_png(bytes(bad))
    with pytest.raises(png_media.PngError):
        png_media.decode_png(good[:-1])
    with pytest.raises(ValueError):
        png_media.encode_png(b"123")


def test_png_checks_the_order_and_kind_of_its_chunks():
    good = png_media.encode_png(bytes(range(64)) * 4, 200)
    head, length, data, end = good[:33], png_media._chunk(b"byTe", b"\0" * 7 + b"\x05"), good[33 + 20 : -12], good[-12:]
    idat = data[8:-4]
    parts = [png_media._chunk(b"IDAT", idat[:5]), png_media._chunk(b"IDAT", idat[5:])]
    assert png_media.decode_png(head + parts[0] + parts[1] + png_media._chunk(b"tEXt", b"x") + end).samples.shape == (4, 64)
    for bad in (head + parts[0] + length + parts[1] + end, head + png_media._chunk(b"PLTE", b"abc") + data + end, head + data + head[8:] + end,
                png_media.SIGNATURE + png_media._chunk(b"IHDR", head[16:28]) + data + end, head + data + end + length):
        with pytest.raises(png_media.PngError):
            png_media.decode_png(bad)


def test_dct_hash_is_the_definition():
    img = np.random.default_rng(2).integers(0, 256, (32, 32)).astype(np.uint8)
    k = np.arange(32)
    c = np.sqrt(2 / 32) * np.cos(np.pi * (2 * k[None, :] + 1) * k[:, None] / 64)
    c[0] /= np.sqrt(2)
    low = (c @ img @ c.T)[:8, :8].ravel()
    assert png_media.dct_hash(img) == np.packbits(low > np.median(low[1:])).tobytes().hex()


def test_media_rows(spark):
    texts = [None, "", "abc", "abc", "x" * 64, "é" * 100, "z" * 200_000, "end\0"]
    df = spark.createDataFrame([(i, t, "m") for i, t in enumerate(texts)], "doc_id long, text string, media string")
    out = {r.doc_id: r for r in png_media.text_media_features(df).collect()}
    for i, t in enumerate(texts):
        data = (t or "").encode()
        payload = data.ljust(max(1, -(-len(data) // 64)) * 64, b"\0")
        r = out[i]
        assert (r.n_bytes, r.payload_bytes) == (len(data), len(payload))
        assert (r.payload_sha256, r.tail_crc32) == (hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    same = lambda a, b: out[a][1:] == out[b][1:]
    assert same(2, 3) and same(0, 1) and not same(2, 4)
    assert png_media.text_media_features(df.where("false")).count() == 0
    assert png_media.media_features(spark.createDataFrame([(None,)], "media binary")).first().feature is None


def warc(spark, rows, **options):
    path = Scratch(spark, "warc-test").path("a")
    warc_store.write_archive(spark.createDataFrame(rows, "page_id long, url string, html string"), path, **options)
    return path, warc_store.read_archive(spark, path)


def test_warc_records(spark):
    rows = [(5, "http://a/5", "same"), (3, "http://a/3", "same"), (9, None, "same"), (4, "http://a/4", None), (7, "http://a\r\n/7", ""),
            (1, "u", "only é"), (8, "r", "twice"), (8, "r", "twice"), (None, "n", "same"), (None, "n", "lone")]
    path, archive = warc(spark, rows)
    out = archive.collect()
    assert len(out) == len(rows)
    kinds = sorted((r.record_id or 0, r.record_type, r.refers_to, r.payload_bytes) for r in out)
    assert kinds == [
        (0, "response", None, 4), (0, "response", None, 4), (1, "response", None, 7), (3, "response", None, 4), (4, "response", None, 0),
        (5, "revisit", 3, 4), (7, "revisit", 4, 0), (8, "response", None, 5), (8, "response", None, 5), (9, "revisit", 3, 4),
    ]
    for r in out:
        text = next(h for i, _, h in rows if i == r.record_id and (r.record_id is not None or len(h) == r.payload_bytes) )
        data = (text or "").encode()
        digest = base64.b32encode(hashlib.sha1(bytes(r.payload)).digest()).decode()
        assert r.payload_digest == digest and (r.record_id is None or bytes(r.payload) == data)
        head, _, rest = bytes(r.record).partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        assert head.startswith(b"WARC/1.1\r\n") and fields["WARC-Payload-Digest"] == "sha1:" + digest
        body = b"" if r.record_type == "revisit" else bytes(r.payload)
        assert rest == body + b"\r\n\r\n" and int(fields["Content-Length"]) == len(body) and fields["WARC-Type"] == r.record_type
    assert spark.read.parquet(f"{path}/payloads").count() == 5


def test_warc_small_payloads_and_empty(spark):
    rows = [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "long enough"), (4, "u", "long enough")]
    _, archive = warc(spark, rows, min_revisit_bytes=5)
    assert sorted((r.record_id, r.record_type, r.refers_to) for r in archive.collect()) == [(1, "response", None), (2, "response", None), (3, "response", None), (4, "revisit", 3)]
    assert warc(spark, [])[1].count() == 0


@pytest.mark.parametrize("column", ["record", "payload", "payload_bytes", "payload_digest", "record_bytes"])
def test_warc_tells_a_changed_or_missing_payload(spark, column):
    path, archive = warc(spark, [(1, "u", "good"), (2, "u", "good"), (3, "u", "lone")])
    assert archive.select(column).count() == 3
    stored = spark.read.parquet(f"{path}/payloads")
    bad = stored.selectExpr("sha256", "encode('evil', 'UTF-8') AS payload").collect()
    good = stored.where("decode(payload, 'UTF-8') = 'good'").collect()
    for rows, why in ((bad, "does not have its digest"), (good, "no payload of digest"), ([], "no payload of digest")):
        spark.createDataFrame(rows, "sha256 string, payload binary").write.mode("overwrite").parquet(f"{path}/payloads")
        with pytest.raises(Exception, match=why):
            warc_store.read_archive(spark, path).select(column).collect()


def test_warc_ids_and_types_are_those_of_the_header(spark):
    path, _ = warc(spark, [(1, "u", "good"), (2, "u", "good"), (None, "u", "good")])
    heads = spark.read.parquet(f"{path}/headers")
    assert heads.columns == ["record_id", "sha256", "header"]
    out = warc_store.read_archive(spark, path).select("record_id", "record_type", "refers_to", "header", "record", "record_bytes").collect()
    assert sorted((r.record_id or 0, r.record_type, r.refers_to) for r in out) == [(0, "response", None), (1, "response", None), (2, "revisit", 1)]
    assert all(len(r.record) == r.record_bytes and bytes(r.record).startswith(bytes(r.header)) for r in out)
    assert {r.record_id for r in warc_store.read_archive(spark, path, "string").collect()} == {None, "1", "2"}


control = st.text(alphabet=st.sampled_from(["<", "|", "\\", ">", "i", "m", "_", "e", "n", "d", "\n", "é"]), max_size=30)


@given(control)
@settings(max_examples=300, deadline=None)
def test_escape_is_reversible_and_hides_control_strings(text):
    assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)


def expected(turns):
    h = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
    loss = "".join(t for r, t in turns if r == "assistant")
    return len(turns), h, len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_chat_round_trip(spark):
    rng = random.Random(2)
    piece = lambda: "".join(rng.choice(["<|im_end|>\n", "<|im_start|>", "assistant\n", "<\\|", "x", "\n", "é"]) for _ in range(rng.randrange(8)))
    convs = {i: [(rng.choice(["system", "user", "assistant", "tool", "odd\n<|role"]), piece()) for _ in range(rng.randrange(1, 9))] for i in range(60)}
    convs[100] = [("user", "q"), ("assistant", "a")] * 3000
    rows = [(c, k, r, t, "x") for c, ts in convs.items() for k, (r, t) in enumerate(ts)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, loss string").repartition(7)
    out = {r.conv_id: r for r in chat.read_formatted(chat.format_conversations(df)).collect()}
    assert set(out) == set(convs)
    for c, ts in convs.items():
        assert tuple(out[c])[1:5] == expected(ts)
    assert out[100].valid


def test_chat_machine_and_segments(spark):
    cases = {
        1: (["user", "assistant"], True), 2: (["system", "user", "assistant"], True), 3: (["assistant", "user"], False), 4: (["user", "user", "assistant"], False),
        5: (["user"], False), 6: (["user", "assistant", "tool", "assistant"], True), 7: (["user", "assistant", "system"], False),
    }
    rows = [(c, k, r, f"t{k}") for c, (rs, _) in cases.items() for k, r in enumerate(rs)] + [(8, 0, None, None), (None, 1, "user", "n"), (None, 2, "assistant", "m")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    segments = chat.format_conversations(df)
    out = {r.conv_id: r for r in chat.read_formatted(segments).collect()}
    assert {c: out[c].valid for c in cases} == {c: v for c, (_, v) in cases.items()}
    assert out[8].n_turns == 1 and not out[8].valid and out[None].n_turns == 2
    one = [tuple(r) for r in segments.where("conv_id = 1").orderBy("segment").collect()]
    assert [(r[2], r[3]) for r in one] == [("<|im_start|>user\n", False), ("t0", False), ("<|im_end|>\n", False), ("<|im_start|>assistant\n", False), ("t1", True), ("<|im_end|>\n", False)]
    assert chat.read_formatted(chat.format_conversations(df.where("false"))).count() == 0
    with pytest.raises(ValueError):
        chat.ChatTemplate(open_turn="[")


def test_chat_query_has_the_added_conversation(spark):
    r = QUERIES["op6_chat"](spark, DATA).where("conv_id = -1").first()
    assert tuple(r)[1:5] == expected([("user", ADDED_TEXT), ("assistant", ADDED_TEXT)])


def test_packed_ids_are_the_library_s():
    t = packing.PieceTokenizer(JSON)
    texts = odd_texts()
    for limit in (10_000, 40):
        t.chunks = Chunks(t._each, limit, encode_words=t._words)
        for _ in range(2):
            got = [np.frombuffer(x, "<u4").tolist() for x in t.encode(texts)]
            assert got == [t.lib.encode(x, add_special_tokens=False).ids for x in texts]


@given(st.integers(0, 100_000))
def test_binary_lengths(n):
    lengths = packing.binary_lengths(n, 2048)
    assert sum(lengths) == n and all(x & (x - 1) == 0 and x <= 2048 for x in lengths)
    small = [x for x in lengths if x < 2048]
    assert len(set(small)) == len(small) and lengths == sorted(lengths, reverse=True)


def test_packing_rows(spark):
    texts = [*odd_texts()[:30], None, "long words here, " * 20_000]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(None, "a b", 1), (0, texts[0], 1)], "doc_id long, text string, length int")
    out = packing.pack(df.repartition(5), JSON, with_ids=True).collect()
    assert len({r.sequence_id for r in out}) == len(out) and all(r.offset == 0 for r in out)
    lib = packing.PieceTokenizer.of(JSON).lib
    for i, t in enumerate(texts):
        if i == 0:
            continue
        ids = lib.encode(t or "", add_special_tokens=False).ids + [1]
        own = sorted((r for r in out if r.doc_id == i), key=lambda r: r.start)
        assert [r.start for r in own] == np.cumsum([0, *(r.length for r in own)])[:-1].tolist()
        assert b"".join(bytes(r.ids) for r in own) == struct.pack(f"<{len(ids)}I", *ids)
        assert all(r.ids_crc32 == zlib.crc32(bytes(r.ids)) and r.doc_tokens == len(ids) and r.length == 1 << r.bucket for r in own)
    assert sum(r.doc_id == 0 for r in out) == 2 and sum(r.doc_id is None for r in out) > 0
    assert packing.pack(df.where("false"), JSON).count() == 0
    with pytest.raises(ValueError):
        packing.pack(df, JSON, context=1000)
    path = Scratch(spark, "buckets").path("b")
    packing.write_buckets(packing.pack(df, JSON), path)
    assert spark.read.parquet(path).groupBy("bucket").agg({"length": "min", "*": "count"}).count() > 3


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("t", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_is_the_library_s(reference):
    b = bpe.Bpe.of(RANKS, PATTERN)
    texts = [*odd_texts(), "a" * 3000, "ab" * 2000 + "c", "".join(random.Random(1).choices("theandinr", k=30_000))]
    for chunked in (True, False):
        b.by_chunk = chunked
        for ids, t in zip(b.encode(texts), texts, strict=True):
            assert ids.tolist() == reference.encode_ordinary(t)
            assert b.decode(ids) == t.encode()
    b.by_chunk = True


@given(st.binary(max_size=60))
@settings(max_examples=200, deadline=None)
def test_bpe_of_any_bytes_decodes(data):
    b = bpe.Bpe.of(RANKS, PATTERN)
    (ids,) = b.encode_pieces([data])
    assert b.decode(np.array(ids, "<u4")) == data and not b.buckets and not any(b.level0) and not any(b.level1)


def test_bpe_with_ranks_that_fall_after_a_merge():
    """A merge may bring up a lower rank than its own, which must go first."""
    ranks = {bytes([i]): i for i in range(256)} | {b"abc": 256, b"bc": 257, b"cd": 258, b"abcd": 259}
    own = bpe.Bpe(ranks, PATTERN)
    lib = tiktoken.Encoding("o", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
    rng, texts = random.Random(0), []
    for _ in range(300):
        t = "".join(rng.choices("abcd", k=rng.randrange(1, 25)))
        texts.append(t)
    assert own.encode_pieces([t.encode() for t in texts]) == [lib.encode_ordinary(t) for t in texts]


def test_bpe_rows(spark, reference):
    texts = [None, "", "Hello there, <|endoftext|>", "x" * 100_000, "twice", "twice"]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    out = bpe.bpe_digests(df, RANKS, PATTERN, with_ids=True)
    for r in out.collect():
        ids = reference.encode_ordinary(texts[r.doc_id] or "")
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()
    back = {r.doc_id: r.decoded for r in bpe.decode_ids(out, RANKS, PATTERN, keep=["doc_id"]).collect()}
    assert all(bytes(v).decode() == (texts[k] or "") for k, v in back.items())
    assert bpe.bpe_digests(df.where("false"), RANKS, PATTERN).count() == 0


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql_gives_the_same_rows(spark, name):
    con = duckdb.connect()
    for t in ("pages", "conversations", "documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    rel = con.sql(SQL[name])
    cols = sorted(rel.columns)
    want = sorted(str([dict(zip(rel.columns, r, strict=True))[c] for c in cols]) for r in rel.fetchall())
    assert want == sorted(str([r[c] for c in cols]) for r in QUERIES[name](spark, DATA).collect())
