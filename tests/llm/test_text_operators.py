from __future__ import annotations

import base64
import gzip
import hashlib
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import decontamination, language_id, packing, pii, quality, sharding, warc

from .conftest import corpus, prose, words


def items():
    rng = random.Random(9)
    return [(k, " ".join(prose(rng, n))) for k, n in enumerate([3, 4, 5, 6, 9, 15, 30, 60, 200])] + [(90, None), (91, ""), (92, "one two three four"), (93, "the same"), (93, "the same")]


def leaky():
    """Texts that hold items whole, cased otherwise, with gaps around the limit, in pieces, or not."""
    rng, rows = random.Random(10), corpus(2, 20)
    ids = iter(range(10_000, 20_000))
    for _, t in items():
        for damage in (0, 1, 2, 4, 10):
            w = (t or "").split()
            for _ in range(damage):
                if w:
                    w[rng.randrange(len(w))] = "zz"
            rows.append((next(ids), " ".join(prose(rng, rng.choice([0, 30, 800]))) + " " + " ".join(w).upper() + " " + " ".join(prose(rng, 20))))
            rows.append((next(ids), " ".join(w)))
    return rows


def runs(text, width):
    w = words(text, lower=True)
    return {tuple(w[k : k + width]) for k in range(len(w) - width + 1)}


def brute_contained(docs, bench):
    """(doc_id, item_id, shingles, common) of all pairs, an item of fewer than five words being one run of its own width."""
    out = []
    for k, u in bench:
        width = min(5, len(words(u)))
        wanted = runs(u, width) if width else set()
        out += [(i, k, len(wanted), len(wanted & own)) for i, t in docs if wanted and 100 * len(wanted & (own := runs(t, width))) >= 75 * len(wanted)]
    return sorted(out, key=repr)


def test_contained_items(spark):
    rows = leaky() + [(30_000, "So the answer is FORTY and\nthe same"), (30_000, "the same twice: the same"), (None, "one two three four five"), (30_001, "one two three  four"), (30_002, "one"), (30_003, "tw one two three")]
    bench = items() + [(94, "answer is forty"), (95, "One"), (None, "one two"), (96, "one two one two")]
    want = brute_contained(rows, bench)
    assert {95, None, 92, 93, 94} <= {w[1] for w in want}
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, item_id string")
    table = spark.createDataFrame(bench, "item_id long, text string")
    for limit, most in ((1_000_000, 20), (60, 20), (1_000_000, None)):
        got = decontamination.contained_items(docs, table, block_shingles=limit, most=most).collect()
        assert sorted(((r["doc_id"], r["item_id"], r["n_shingles"], r["n_common"]) for r in got), key=repr) == want
        clean = decontamination.decontaminate(docs, table, block_shingles=limit, most=most).collect()
        leaks = {(w[0]) for w in want}
        assert sorted((repr(r["doc_id"]), r["text"] or "") for r in clean) == sorted((repr(i), t or "") for i, t in rows if not (i in leaks and brute_contained([(i, t)], bench)))
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.contained_items(docs, none).count() == 0 and decontamination.decontaminate(docs, none).count() == len(rows)
    assert decontamination.contained_items(docs.limit(0), table).count() == 0


def test_decontamination_sql_finds_short_items():
    duck = duckdb.connect()
    docs = [r for r in leaky()[:60] if r[0] is not None] + [(30_000, "So the answer is FORTY and\nthe same"), (30_001, "one two three  four"), (30_002, "one"), (30_004, "")]
    bench = [r for r in items() if r[0] != 93] + [(94, "answer is forty"), (95, "One"), (96, "one two one two")]
    for name, key, rows in (("documents", "doc_id", docs), ("benchmark", "item_id", bench)):
        duck.sql(f"create table {name} ({key} bigint, text varchar)")
        duck.executemany(f"insert into {name} values (?, ?)", rows)
    got = duck.sql(f"select doc_id, item_id, n_shingles, n_common from ({decontamination.SQL})").fetchall()
    assert sorted(got, key=repr) == brute_contained(docs, bench)


def test_contained_spans(spark):
    item = "a1 b2 c3 d4 e5 f6 g7"
    got = decontamination.contained_items(spark.createDataFrame([(1, f"x y {item} z")], "doc_id long, text string"), spark.createDataFrame([(5, item), (6, "g7 z")], "item_id long, text string")).collect()
    assert {(r["item_id"], r["first_word"], r["end_word"]) for r in got} == {(5, 2, 9), (6, 8, 10)}


def rebuilt(rows, length):
    """Texts' ids by document, and sequences, from pieces; checks that neither has a gap."""
    docs, sequences = {}, {}
    for r in rows:
        ids = np.frombuffer(r["ids"], "<u4")
        assert len(ids) == r["length"] and zlib.crc32(r["ids"]) == r["ids_crc32"]
        docs.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], ids))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in sequences.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= length
    assert sorted(sequences) == list(range(len(sequences)))
    assert all(sum(n for _, n in own) == length for k, own in sequences.items() if k < len(sequences) - 1)
    return {k: np.concatenate([x for _, x in sorted(v, key=lambda p: p[0])]) for k, v in docs.items()}


@pytest.fixture(scope="module")
def slow():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.vocabulary("byte_bpe_50k.json"))


def test_packing(spark, odd_docs, no_docs, slow):
    got = rebuilt(packing.pack(odd_docs).collect(), 2048)
    assert len(got) == len(corpus())
    for (doc, n), ids in got.items():
        want = [*slow.encode(dict(corpus())[doc] or "", add_special_tokens=False).ids, 1]
        assert ids.tolist() == want and n == len(want)
    assert packing.pack(no_docs).count() == 0


def test_packing_over_many_ranges(spark, odd_docs, monkeypatch):
    monkeypatch.setattr(packing, "RANGE_TOKENS", 2000)
    assert len(rebuilt(packing.pack(odd_docs, length=100, sample=60).collect(), 100)) == len(corpus())
    same = spark.createDataFrame([(k % 50 or None, "the same text, " * 20) for k in range(400)], "doc_id long, text string")
    rows = packing.pack(same, length=128).collect()
    assert sum(r["length"] for r in rows) == 400 * rows[0]["doc_tokens"]


def test_packing_bad_utf8(spark, slow):
    frame = spark.createDataFrame([(1, bytearray(b"a \xff\xfe b")), (2, bytearray(b"\xe9")), (2, bytearray(b"\xe9")), (None, None)], "doc_id long, b binary").selectExpr("doc_id", "cast(b as string) as text")
    rows = packing.pack(frame).collect()
    assert len(rows) == 4
    got = {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in rows}
    ids = lambda t: [*slow.encode(t, add_special_tokens=False).ids, 1]
    assert got == {1: ids("a \ufffd\ufffd b"), 2: ids("\ufffd"), None: [1]}


def test_packing_ranges_are_even(spark, monkeypatch):
    """Hundreds of ranges: each has enough sampled keys to be about as large as the others."""
    rng, sizes, splitters = random.Random(19), [], packing.splitters
    monkeypatch.setattr(packing, "RANGE_TOKENS", 400)
    monkeypatch.setattr(packing, "splitters", lambda keys, weights, parts: sizes.append((len(keys), parts)) or splitters(keys, weights, parts))
    docs = spark.createDataFrame([(k, " ".join(prose(rng, rng.randrange(2, 12)))) for k in range(4000)], "doc_id long, text string")
    rebuilt(packing.pack(docs, length=64, sample=10).collect(), 64)
    (drawn, parts), = sizes
    assert parts > 200 and drawn >= min(4000, 12 * parts)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_fast_and_slow_tokens_of_the_smallest_table(slow):
    import pyarrow.parquet as pq

    fast = packing.Encoder(packing.vocabulary("byte_bpe_50k.json"), packing.vocabulary("byte_bpe_50k.tiktoken"), __import__("public_tokenizers").PATTERN, "<|endoftext|>")
    for name, column in (("documents", "text"), ("conversations", "text"), ("pages", "html")):
        for t in pq.read_table(f"/root/testdata/sf0.001/{name}.parquet", columns=[column]).column(0).to_pylist():
            assert fast(t or "").tolist() == slow.encode(t or "", add_special_tokens=False).ids


def test_fast_and_slow_tokens_are_equal(slow):
    rng = random.Random(3)
    fast = packing.Encoder(packing.vocabulary("byte_bpe_50k.json"), packing.vocabulary("byte_bpe_50k.tiktoken"), __import__("public_tokenizers").PATTERN, "<|endoftext|>")
    texts = ["", "<|endoftext|>", "a<|endoftext|> b", "\n\n  x \t ", "é🙂日本語", "don't I'LL", "a" * 3000, " " * 3000]
    texts += ["".join(rng.choice("aAé \n\t1'.,!日🙂ع") for _ in range(rng.randrange(200))) for _ in range(200)]
    planes = [chr(k) for k in [*range(1, 0x250), *range(0x2000, 0x2070), *range(0x300, 0x370), *range(0x660, 0x66A), *range(0x4E00, 0x4E20), 0x85, 0x3000, 0x2028, 0xFEFF, 0xFFFD, 0x1F600, 0xE0001, 0xF0000, 0x10FFFF]]
    texts += ["".join(rng.choices(planes, k=rng.randrange(1, 60))) for _ in range(2000)]
    for t in texts:
        assert fast(t).tolist() == slow.encode(t, add_special_tokens=False).ids


def test_hilbert_is_a_path():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        keys = packing.hilbert(grid, bits)
        assert sorted(keys) == list(range(len(grid)))
        assert (np.abs(np.diff(grid[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


def pages():
    rng = random.Random(6)
    big, body = "".join(rng.choice("aé日\r\n\r\n<>") for _ in range(5000)), "x" * 999
    rows = [(1, "u1", big), (2, "u2", big), (9, "u\r\nInjected: 1", big), (3, None, None), (4, "u", ""), (5, "u", body), (6, "u", body), (7, "u", body + "y"), (8, "u", body + "y"), (10, "u", "WARC/1.1\r\n\r\nContent-Length: 5\r\n\r\n"), (11, "u", "z" * 20_000)]
    return rows


def test_warc(spark):
    frame = spark.createDataFrame([(*r, "x") for r in pages()], "page_id long, url string, html string, chunk string")
    for part in (65_536, 700):
        got = {r["page_id"]: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], r["ok"]) for r in warc.archive_and_read(frame, part=part).collect()}
        want = {}
        for i, _, h in pages():
            b = (h or "").encode()
            head = max(j for j, _, g in pages() if g == h)
            again = len(b) >= 1000 and i < head
            want[i] = (len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", head if again else None, True)
        assert got == want
        path = warc.write_warc(frame, part=part)
        data = {}
        for r in warc.read_pages(spark, path).collect():
            data.setdefault(r["page_id"], {})[r["chunk"]] = bytes(r["data"])
        assert {i: b"".join(t for _, t in sorted(c.items())).decode() for i, c in data.items()} == {i: h or "" for i, _, h in pages() if want[i][2] == "response"}
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.archive_and_read(empty).count() == 0


def test_warc_repeated_rows_null_ids_and_bad_bytes(spark):
    """Rows that share a page_id, with equal payloads or others, stay records of their own."""
    a, b, bad = b"a" * 200_000, "bé" * 90_000, b"<p>\xff\xfe" * 400
    rows = [(1, a), (1, a), (2, a), (2, a), (3, b.encode()), (3, b"c" * 150_000), (3, b.encode()), (None, a), (None, a), (4, bad), (5, bad), (6, b"\xff"), (7, b"\xff"), (7, b"\xff")]
    frame = spark.createDataFrame([(i, b"u\xff", bytearray(h)) for i, h in rows], "page_id long, url binary, h binary").selectExpr("page_id", "cast(url as string) as url", "cast(h as string) as html")
    want = []
    for i, h in rows:
        head = max(j for j, g in rows if g == h and j is not None)
        again = len(h) >= 1000 and i is not None and i < head
        want.append((str(i), len(h), hashlib.sha1(h).hexdigest(), "revisit" if again else "response", str(head) if again else "None", True))
    for part in (65_536, 1001):
        got = warc.archive_and_read(frame, part=part).collect()
        assert sorted((str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], str(r["refers_to"]), r["ok"]) for r in got) == sorted(want)
    path = warc.write_warc(frame, part=1001)
    payloads = {}
    for r in warc.read_pages(spark, path).collect():
        payloads.setdefault((r["page_id"], r["record"]), {})[r["chunk"]] = bytes(r["data"])
    assert sorted((str(k[0]), b"".join(c[n] for n in sorted(c))) for k, c in payloads.items()) == sorted((str(i), h) for (i, h), w in zip(rows, want, strict=True) if w[3] == "response")


def test_warc_damage(spark, tmp_path):
    head = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:1>\r\nX-Page-ID: 1\r\nWARC-Payload-Digest: sha1:" + base64.b32encode(hashlib.sha1(b"good").digest()).decode() + "\r\nContent-Length: 4\r\n\r\n"
    (tmp_path / "part-0.txt").write_bytes(head.encode() + b"evil\r\n\r\n")
    assert [r["ok"] for r in warc.read_records(warc.read_chunks(spark, str(tmp_path))).collect()] == [False]
    with pytest.raises(ValueError):
        list(warc.parse_warc(head.encode() + b"ev"))


def test_warc_missing_segments(spark):
    chunk = lambda record, n, total, data, so_far: (record, 1, "u", "response" if n == 1 else "continuation", True, n, total, hashlib.sha1(b"abcd").hexdigest() if n == 1 else None, hashlib.sha1(so_far).hexdigest(), None, data)
    rows = [chunk("whole", 1, -1, b"ab", b"ab"), chunk("whole", 2, 4, b"cd", b"abcd"), chunk("no end", 1, -1, b"ab", b"ab"), chunk("no start", 2, 4, b"cd", b"abcd")]
    frame = spark.createDataFrame(rows, warc._CHUNKS)
    assert sorted(r["ok"] for r in warc.read_records(frame).collect()) == [False, False, True]


def test_warc_of_others(spark, tmp_path):
    """One gzip member a record, header names in lower case, urn:uuid ids, HTTP headers, other record types."""
    body = b"<html>hi</html>"
    head = lambda kind, block, *more: "\r\n".join(["WARC/1.0", f"warc-type: {kind}", "warc-record-id: <urn:uuid:0f2e>", *more, f"content-length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" + body
    digest = "warc-payload-digest: sha1:" + base64.b32encode(hashlib.sha1(body).digest()).decode()
    records = [head("warcinfo", b"software: x"), head("request", b"GET / HTTP/1.1\r\n\r\n"), head("response", http, digest, "content-type: application/http; msgtype=response", "warc-target-uri: http://x.example/"), head("response", b"plain")]
    (tmp_path / "CC.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in records))
    chunks = warc.read_chunks(spark, str(tmp_path), "*.warc.gz")
    assert [r["record_type"] for r in chunks.collect()] == ["warcinfo", "request", "response", "response"]
    got = warc.read_records(chunks).collect()
    assert sorted((r["page_id"], r["payload_bytes"], r["payload_digest"], r["ok"]) for r in got) == sorted([(None, len(body), hashlib.sha1(body).hexdigest(), True), (None, 5, hashlib.sha1(b"plain").hexdigest(), True)])


def check_shards(rows, docs, shards):
    assert sorted((r["doc_id"] or -1, r["size"], r["text_crc32"]) for r in rows) == sorted((i or -1, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in docs)
    for k in range(shards):
        own = sorted(r["slot"] for r in rows if r["shard"] == k)
        assert own == list(range(len(own)))
    sizes = np.bincount([r["shard"] for r in rows], weights=[r["size"] for r in rows], minlength=shards)
    assert len(sizes) == shards
    return sizes


def test_sharding(spark, odd_docs, no_docs):
    check_shards(sharding.assign(odd_docs).collect(), corpus(), 40)
    assert sharding.assign(no_docs).count() == 0
    rng = random.Random(8)
    docs = [(k, " ".join(prose(rng, rng.randrange(1, 30)))) for k in range(3000)] + [(3000 + k, "hot text " * 10) for k in range(1500)] + [(None, "no id")] * 3
    rows = sharding.assign(spark.createDataFrame(docs, "doc_id long, text string"), shards=10).collect()
    sizes = check_shards(rows, docs, 10)
    assert sizes.max() / sizes.mean() < 1.03 and sizes.min() / sizes.mean() > 0.97
    groups = {}
    for r in rows:
        groups.setdefault(r["text_crc32"], set()).add(r["shard"])
    hot = zlib.crc32(("hot text " * 10).encode())
    assert len(groups[hot]) > 1 and all(len(s) == 1 for c, s in groups.items() if c != hot)


def test_write_shards(spark, tmp_path):
    docs = spark.createDataFrame([(k, f"text {k}", "en") for k in range(200)], "doc_id long, text string, lang string")
    sharding.write_shards(docs, str(tmp_path / "s"), 4)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == 200 and back.select("shard").distinct().count() == 4 and len(os.listdir(tmp_path / "s")) >= 4


def test_write_shards_keeps_every_row(spark, odd_docs, no_docs, tmp_path):
    """Null ids and texts, repeated rows, two texts under one id, and columns with the names used inside."""
    rows = [(None, "a", "x"), (None, "a", "x"), (1, "b", "x"), (1, "b", "x"), (1, "c", "y"), (2, None, "x"), (3, "", None)] + [(10 + k % 40, "hot " * 50, "h") for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, place string").withColumns({"range": F.lit(1), "part": F.lit("p"), "h": F.lit(None).cast("string")})
    sharding.write_shards(docs, str(tmp_path / "s"), 5)
    back = spark.read.parquet(str(tmp_path / "s"))
    plain = lambda f: sorted(map(repr, f.select(*docs.columns).collect()))
    assert plain(back) == plain(docs)
    want = {}
    for r in sharding.assign(docs, 5).collect():
        want.setdefault((r["doc_id"], r["text_crc32"]), set()).add(r["shard"])
    assert all(r["shard"] in want[r["doc_id"], zlib.crc32((r["text"] or "").encode())] for r in back.collect())
    sharding.write_shards(no_docs, str(tmp_path / "none"), 5)
    with pytest.raises(ValueError):
        sharding.write_shards(docs.withColumn("Shard", F.lit(1)), str(tmp_path / "x"))


def test_more_ranges_than_aimed_at(spark):
    """Many shards, a small sample and heavy texts: no boundary is given up, so all ranges but those of one text are small."""
    rng = random.Random(18)
    docs = [(k, " ".join(prose(rng, rng.randrange(1, 40)))) for k in range(4000)] + [(5000 + k, f"heavy {k} " * 400) for k in range(20)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    keys = sharding.keyed(frame).cache()
    total = sum(len(t.encode()) + 16 for _, t in docs)
    for shards, aim in ((300, 64), (300, 16_384)):
        _, _, table = sharding.ranges(keys, shards, sample=50, aim=aim)
        limit = total / shards * max(1 / 64, min(0.5, 2 * shards / aim))
        assert sum(t[2] for t in table) == len(docs) and all(size <= limit or n == 1 for _, _, n, size in table)
    check_shards(sharding.assign(frame, shards=300, sample=50).collect(), docs, 300)


PERSONAL = [
    (1, "Write to anna.b@mail.example.com or Anna.B@mail.example.com, call +1 (017) 555-7713."),
    (2, "anna.b@mail.example.com again; phone 017-555-7713, host 10.20.30.40, card 4539 1488 0343 6467."),
    (3, 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" and password: hunter2hunter2'),
    (4, "Mrs. Anna Smith met Mr. John Smith; later Mrs. Smith left. Господин Иван Петров тоже."),
    (5, "Nothing here: 12 apples, 3.14, 2024-01-01, version 1.2.3."),
    (6, None),
    (7, ""),
    (8, "4539148803436467 and 4539-1488-0343-6468; ssn 123-45-6789; 999.1.1.1 is no host"),
    (8, "4539148803436467 and 4539-1488-0343-6468; ssn 123-45-6789; 999.1.1.1 is no host"),
    (10, "IBAN DE89 3704 0044 0532 0130 00 or DE89370400440532013000, not DE00 3704 0044 0532 0130 00."),
    (9, "x" * 50_000 + " a@b.org " + "1 " * 20_000),
]


def luhn(number: str) -> bool:
    digits = [int(c) for c in re.sub(r"\D", "", number)][::-1]
    return sum(d if k % 2 == 0 else (d * 2 - 9 if d > 4 else d * 2) for k, d in enumerate(digits)) % 10 == 0


def test_surrogates(spark, no_docs):
    frame = spark.createDataFrame([(*r, "kept") for r in PERSONAL], "doc_id long, text string, text_hash_0 string")
    got = pii.with_surrogates(frame, "key", count="n")
    assert got.columns == ["doc_id", "text", "text_hash_0", "n"]
    rows = got.collect()
    assert len(rows) == len(PERSONAL) and {r["text_hash_0"] for r in rows} == {"kept"}
    new = {r["doc_id"]: r["text"] for r in rows}
    assert (new[5], new[6], new[7]) == (PERSONAL[4][1], None, "")
    mails = re.findall(r"[\w.]+@[\w.]+\w", new[1])
    assert mails[0].lower() == mails[1].lower() and mails[0] != mails[1] and mails[0] in new[2] and mails[0].endswith(".com") and mails[0] != "anna.b@mail.example.com"
    assert re.search(r"call \+1 \(\d{3}\) \d{3}-\d{4}\.$", new[1]) and "555-7713" not in new[1] + new[2]
    host, card = re.search(r"host ([\d.]+),", new[2])[1], re.search(r"card (\d{4} \d{4} \d{4} \d{4})\.", new[2])[1]
    assert host != "10.20.30.40" and all(1 <= int(o) <= 254 for o in host.split("."))
    assert luhn(card) and card.replace(" ", "") in new[8]
    other = re.search(r"and (\d{4}-\d{4}-\d{4}-\d{4});", new[8])[1]
    assert not luhn(other) and "999.1.1.1" in new[8] and "123-45-6789" not in new[8]
    assert re.search(r'token = "[0-9a-f]{40}" and password: \w{14}$', new[3]) and "24be" not in new[3] and "hunter2" not in new[3]
    (anna, smith), (john, smith2), (smith3, _) = re.findall(r"Mrs?\. (\w+) (\w+)", new[4])
    assert smith == smith2 == smith3 != "Smith" and anna != "Anna" and anna.endswith("a") and not john.endswith("a")
    assert re.search(r"Господин [А-Я][а-я]+ [А-Я][а-я]+ тоже", new[4]) and "Петров" not in new[4]
    ibans = re.findall(r"DE[\d ]+\d", new[10])
    plain = [i.replace(" ", "") for i in ibans]
    proof = lambda i: int("".join(str(int(c, 36)) for c in i[4:] + i[:4])) % 97 == 1
    assert plain[0] == plain[1] != "DE89370400440532013000" and proof(plain[0]) and ibans[0].count(" ") == 5 and not proof(plain[2])
    assert "a@b.org" not in new[9] and len(new[9]) == len(PERSONAL[-1][1])
    assert {r["doc_id"]: r["n"] for r in rows}[5] == 0 and {r["doc_id"]: r["n"] for r in rows}[1] == 3
    again = {r["doc_id"]: r["text"] for r in pii.with_surrogates(frame.select("doc_id", "text"), "key").collect()}
    assert again == new and {r["doc_id"]: r["text"] for r in pii.with_surrogates(frame, "other").collect()}[1] != new[1]
    assert pii.with_surrogates(no_docs, "key").count() == 0
    assert {r["kind"] for r in pii.detect(frame).collect()} == {"email", "phone", "ip", "card", "secret", "ssn", "name", "iban"}


def test_long_secrets(spark):
    rng = random.Random(14)
    runs = {(n, kind): "".join(rng.choices("ABCXYZabcxyz0189" + ("" if kind == "sk" else "+/"), k=n)) for n in (64, 65, 512, 513, 600, 5000, 50_000) for kind in ("sk", "token")}
    texts = {k: f"so sk-{v}, end" if k[1] == "sk" else f'so token = "{v}" end' for k, v in runs.items()}
    frame = spark.createDataFrame(list(enumerate(texts.values())), "doc_id long, text string")
    rows = pii.with_surrogates(frame, "key", count="n").orderBy("doc_id").collect()
    assert [r["n"] for r in rows] == [1] * len(texts)
    for ((n, kind), run), text in zip(runs.items(), [r["text"] for r in rows], strict=True):
        got = re.fullmatch(r"so (?:sk-|[a-z]{2}-)([A-Za-z0-9]+), end" if kind == "sk" else r'so token = "([A-Za-z0-9+/]+)" end', text)[1]
        assert len(got) == n and not any(run[k : k + 16] in got for k in range(0, n - 15, 8))


def test_secrets_in_upper_case(spark):
    low, key, letters = "9233a8ecf7c5b09fe5949719b6b82bc439e9329b", "hunterXYhunter", "sk-" + "abcdefghij" * 3
    mixed = low[:20] + low[20:].upper()
    texts = [f'token = "{low}"', f'TOKEN = "{low.upper()}"', f"Password: {key}", f"API_KEY={key}", low, low.upper(), letters.upper(), letters, mixed, "Secret: " + "abcdef" * 7]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = pii.with_surrogates(frame, "key", count="n").orderBy("doc_id").collect()
    new = [r["text"] for r in rows]
    assert [r["n"] for r in rows] == [1] * len(texts) and not any(a == b for a, b in zip(texts, new, strict=True))
    assert re.fullmatch(r'token = "[0-9a-f]{40}"', new[0]) and new[1] == new[0].upper() and new[4] == new[0][9:-1] and new[5] == new[4].upper()
    assert new[8].lower() == new[4] and new[8] not in (new[4], new[5])
    assert new[2].split(" ")[1] == new[3].split("=")[1] and re.fullmatch("[a-z]{6}[A-Z]{2}[a-z]{6}", new[2].split(" ")[1])
    assert new[2].startswith("Password: ") and new[3].startswith("API_KEY=") and re.fullmatch(r"[A-Z]{2}-[A-Z]{30}", new[6])


def test_surrogates_stay_distinct(spark):
    values = spark.createDataFrame([("ssn", f"{k:03d}") for k in range(0, 1000, 8)] + [("email", f"{c}@b.org") for c in "abcdefghij"] + [("surname", f"n{a}{b}") for a in "abcdefghijklmnop" for b in "aeiouklmnrst"], "kind string, norm string")
    rows = pii.surrogate_table(values, "key").df.collect()
    assert len(rows) == 135 + 16 * 12 and len({(r["kind"], r["surrogate"]) for r in rows}) == len(rows)
    real = {(r["kind"], r["norm"]) for r in rows}
    assert not any((r["kind"], r["surrogate"]) in real for r in rows)


def test_surrogates_of_a_full_format(spark):
    """700 of 1,000 three-digit numbers, and all of 100: still distinct, and none is its own."""
    for n, kept in ((1000, range(0, 700)), (100, range(100))):
        width = len(str(n - 1))
        rows = pii.surrogate_table(spark.createDataFrame([("ssn", f"{k:0{width}d}") for k in kept], "kind string, norm string"), "key").df.collect()
        assert len(rows) == len(kept) == len({r["surrogate"] for r in rows}) and all(r["norm"] != r["surrogate"] and re.fullmatch(rf"\d{{{width}}}", r["surrogate"]) for r in rows)


def brute_turned(numbers, sizes, seed):
    """The permutation by its definition, in Python."""
    free = [k for k, r in enumerate(sizes) if r > 1]
    x, sizes, out = [numbers[k] for k in free], [sizes[k] for k in free], list(numbers)
    for s in (-4, -3, -2, -1, 9, 0, 1, 2, 3):
        if s == 9:
            x = [(v + 1) % sizes[k] if k == 0 else v for k, v in enumerate(x)]
            continue
        k, sign = (-s - 1, -1) if s < 0 else (s, 1)
        other = ",".join(str(v) for i, v in enumerate(x) if i % 2 != k % 2)
        stream = "".join(hashlib.sha256(f"{seed}{k}|{n}|{other}".encode()).hexdigest() for n in range(3))
        x = [(v + sign * int(stream[(i // 2 % 48) * 4 :][:4], 16)) % sizes[i] if i % 2 == k % 2 else v for i, v in enumerate(x)]
    for k, v in zip(free, x, strict=True):
        out[k] = v
    return out


def test_permutation_equals_brute_force(spark):
    rng = random.Random(2)
    values = [("phone", f"+{rng.choice(['1', '49', '380'])} {rng.randrange(10**7, 10**9)}") for _ in range(30)] + [("ssn", f"{rng.randrange(10**9):09d}") for _ in range(30)] + [("ip", ".".join(str(rng.choice([0, 255, 7, 200])) for _ in range(4))) for _ in range(30)]
    values += [("email", f"a{rng.randrange(99)}.bxq@my-host{k}.co.uk") for k in range(30)]
    frame = spark.createDataFrame(values, "kind string, norm string")
    rows = frame.select("kind", "norm", pii._candidate(F.col("kind"), F.col("norm"), F.lit(0), "key").alias("new")).collect()
    for r in rows:
        seed = f"key\n{r['kind']}\n0\n"
        if r["kind"] == "ip":
            octets = [int(o) for o in r["norm"].split(".")]
            size = [1 if o in (0, 255) else 254 for o in octets]
            want = ".".join(str(o) if z == 1 else str(v + 1) for o, z, v in zip(octets, size, brute_turned([0 if z == 1 else o - 1 for o, z in zip(octets, size, strict=True)], size, seed), strict=True))
        else:
            low = r["norm"].index(" ") + 1 if r["kind"] == "phone" else 0
            high = r["norm"].rindex(".") + 1 if r["kind"] == "email" else len(r["norm"])
            of = [next((a for a in pii._CLASSES if c in a), None) if low <= k < high else None for k, c in enumerate(r["norm"])]
            turned = brute_turned([a.index(c) if a else 0 for a, c in zip(of, r["norm"], strict=True)], [len(a) if a else 1 for a in of], seed)
            want = "".join(a[v] if a else c for a, v, c in zip(of, turned, r["norm"], strict=True))
        assert r["new"] == want


NAMED = [
    (1, "Mr. John Smith called. John Smith said so; SMITH's car, Smith’s dog, and a smith. Johnny stayed."),
    (2, "Dr. Anna Lee met Prof. Dr. Erik Lee. Later Anna and Erik Lee left with Frau Dr. Anna Kurz."),
    (3, "Mr. J. Smith wrote: password: hunter2hunter2; again hunter2hunter2."),
    (4, "John Smith never had a title here."),
    (5, "Mrs. O'Brien, O'Brien and Mr. Smith-Jones; Smith-Jones; Smith."),
    (6, "Call +49 170 1234567, +491701234567, +1 (017) 555-7713 or +380 44 123 45 67."),
    (7, "Mr. John Smith called. John Smith said so; SMITH's car, Smith’s dog, and a smith. Johnny stayed."),
    (7, "Mr. John Smith called. John Smith said so; SMITH's car, Smith’s dog, and a smith. Johnny stayed."),
]


def test_every_mention_of_a_name_is_replaced(spark):
    rows = pii.with_surrogates(spark.createDataFrame(NAMED, "doc_id long, text string"), "key").collect()
    new = {r["doc_id"]: r["text"] for r in rows}
    assert len(rows) == len(NAMED) and new[7] == new[1]
    john, smith = re.match(r"Mr\. (\w+) (\w+) called", new[1]).groups()
    assert new[1] == f"Mr. {john} {smith} called. {john} {smith} said so; {smith.upper()}'s car, {smith}’s dog, and a smith. Johnny stayed."
    assert john != "John" and smith != "Smith"
    anna, lee, erik, kurz = re.match(r"Dr\. (\w+) (\w+) met Prof\. Dr\. (\w+) \2\. Later \1 and \3 \2 left with Frau Dr\. \1 (\w+)\.$", new[2]).groups()
    assert anna.endswith("a") and len({anna, lee, erik, kurz, "Anna", "Lee", "Erik", "Kurz"}) == 8
    secret = re.match(rf"Mr\. J\. {smith} wrote: password: (\S+); again (\S+)\.$", new[3]).groups()
    assert secret[0] == secret[1] != "hunter2hunter2"
    assert new[4] == NAMED[3][1]
    assert re.match(r"Mrs\. (\S+), \1 and Mr\. (\S+); \2; Smith\.$", new[5]) and "O'Brien" not in new[5]
    phones = re.match(r"Call (\+49 \d{3} \d{7}), (\+49\d{10}), (\+1 \(\d{3}\) \d{3}-\d{4}) or (\+380 \d\d \d{3} \d\d \d\d)\.$", new[6]).groups()
    assert phones[0].replace(" ", "") == phones[1] != "+491701234567" and phones[3] != "+380 44 123 45 67"


def test_surrogates_need_a_key(spark, no_docs):
    before = spark.conf.get(pii.KEY_SETTING, None)
    spark.conf.unset(pii.KEY_SETTING)
    with pytest.raises(ValueError):
        pii.with_surrogates(no_docs)
    key = pii.session_key(spark)
    assert len(key) == 64 and pii.session_key(spark) == key and pii.with_surrogates(no_docs).count() == 0
    spark.conf.set(pii.KEY_SETTING, before) if before else spark.conf.unset(pii.KEY_SETTING)


def languages(n=60):
    rng = random.Random(12)
    sounds = {"aa": "ba na ka ra la".split(), "bb": "sch rei unt ber gen".split(), "cc": "жа ни ко ро сла".split()}
    return [(k, " ".join("".join(rng.choice(sounds[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(3, 40))), lang) for k in range(n) for lang in [rng.choice(sorted(sounds))]]


def test_language(spark, no_docs):
    rows = languages(120)
    known = language_id.prototypes(spark.createDataFrame([r[1:] for r in rows[:80]] + [(None, "aa"), ("x", None)], "text string, lang string"))
    assert sorted(known) == ["aa", "bb", "cc"]
    extra = [(1000, None), (1001, ""), (1002, "12 ?!"), (1003, "ba" * 50_000), (1004, "k"), (None, "ba na")]
    docs = spark.createDataFrame([(i, t, "zz") for i, t in [r[:2] for r in rows[80:]] + extra], "doc_id long, text string, lang_pred string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.predict(docs, known).collect()}
    assert sum(got[i][0] == lang for i, _, lang in rows[80:]) >= 0.95 * 40
    assert all(got[k] == ("und", 0.0) for k in (1000, 1001, 1002)) and got[1003][0] == "aa" and got[1004][0] in known
    assert all(0 <= s <= 1 for _, s in got.values())
    assert language_id.predict(no_docs, known).count() == 0
    assert {r["lang_pred"] for r in language_id.predict(docs, {}).collect()} == {"und"}


def brute_language(text, known, dims=language_id.DIMENSIONS):
    """(language, score) by the definition, letter by letter."""
    symbols = [ord(c.lower()[0]) if c.isalpha() else 0 for c in text or ""]
    symbols = [s for k, s in enumerate(symbols) if s or k == 0 or symbols[k - 1]]
    if not any(symbols):
        return "und", 0.0
    vector = {s: language_id.letter_vectors(np.array([s]), dims)[0].astype(float) for s in set(symbols)}
    if len(symbols) < 3:
        total = sum(vector[s] for s in symbols)
    else:
        total = sum(np.roll(vector[a], 2) * np.roll(vector[b], 1) * vector[c] for a, b, c in zip(symbols, symbols[1:], symbols[2:], strict=False))
    total = total / (np.linalg.norm(total) or 1)
    names, table = list(known), np.stack(list(known.values()))
    table = table - table.mean(axis=0) if len(table) > 1 else table
    cos = table / np.linalg.norm(table, axis=1, keepdims=True) @ total
    odds = np.exp(language_id.SHARPNESS * (cos - cos.max()))
    return names[int(cos.argmax())], float(1 / odds.sum())


def test_language_equals_brute_force(spark):
    rows = languages(90)
    known = language_id.prototypes(spark.createDataFrame([r[1:] for r in rows[:50]], "text string, lang string"))
    odd = ["\U000e0001\U000e0020", "\U000f0000", "\U00010400\U00010428 x", "\u00df\u0130", "1 2 3", "a1b2", "日本語 text", "\U0001f642", " b", "b ", None, "", "ab"]
    docs = [(k, t) for k, t in enumerate([r[1] for r in rows[50:]] + odd)]
    docs += docs[:3] + docs[-2:]
    got = sorted((r["doc_id"], r["lang_pred"], round(r["score"], 4)) for r in language_id.predict(spark.createDataFrame(docs, "doc_id long, text string"), known).collect())
    assert got == sorted((k, lang, round(score, 4)) for k, t in docs for lang, score in [brute_language(t, known)])
    assert {r[1] for r in got if r[0] in (40, 41)} == {"und"}


def test_every_language_is_learned(spark):
    rows = [(f"{chr(0x4E00 + k)}{chr(0x4E00 + 2 * k)}{chr(0x5000 + k)} " * 3, f"l{k:04d}") for k in range(700)]
    known = language_id.prototypes(spark.createDataFrame(rows * 2, "text string, lang string"), dims=64)
    assert len(known) == 700
    few = language_id.prototypes(spark.createDataFrame([(f"ba na {k}", "aa", k) for k in range(400)], "text string, lang string, id long"), dims=64, per_language=40, key="id")
    assert list(few) == ["aa"]


def test_bundles_are_sums_of_bound_letters():
    text = "abc ab"
    buf, offsets = np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)])
    v = {c: language_id.letter_vectors(np.array([ord(c) if c != " " else 0]), 64)[0].astype(int) for c in set(text)}
    want = sum(np.roll(v[text[k]], 2) * np.roll(v[text[k + 1]], 1) * v[text[k + 2]] for k in range(len(text) - 2))
    assert np.allclose(language_id.bundles(buf, offsets, 64)[0][0], want / np.linalg.norm(want), atol=1e-6)


def graded(n=600):
    rng = random.Random(14)
    rows, labels = [], []
    for k in range(n):
        w, good = prose(rng, rng.randrange(10, 120)), rng.random() < 0.8
        rows.append((k, " ".join(w).capitalize() + "." if good else rng.choice([" | ".join(w), "!! ".join(x.upper() for x in w), "### ".join(w)])))
        if rng.random() < 0.5:
            labels.append((k, int(good)))
    return rows, labels


def test_quality(spark, no_docs):
    rows, labels = graded()
    extra = [(10_000, None), (10_001, ""), (10_002, "x " * 40_000), (None, "No id.")]
    docs = spark.createDataFrame([(*r, "x") for r in rows + extra], "doc_id long, text string, f string")
    model = quality.train(docs, spark.createDataFrame([*labels, (None, 1), (5, None), (6, 7)], "doc_id long, quality int"))
    got = {r["doc_id"]: (r["score"], r["predicted"]) for r in quality.score(docs, model).collect()}
    assert len(got) == len(rows) + len(extra) and all(0 <= s <= 1 and p == (s >= 0.3) for s, p in got.values())
    held = [(k, y) for k, y in labels if zlib.crc32(str(k).encode()) % 5 == 0]
    assert sum(got[k][1] == y for k, y in held) >= 0.95 * len(held)
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {k for k, v in got.items() if v[1]}
    assert quality.score(no_docs, model).count() == 0
    assert quality.train(docs, spark.createDataFrame([], "doc_id long, quality int")) is None
    assert {r["predicted"] for r in quality.score(docs, None).collect()} == {1}
    assert docs.where(F.col("doc_id") < 0).count() == 0


def test_unlabelled_sample_spans_the_table(spark, monkeypatch):
    texts = ["Good words here."] * 100 + ["### | ### |"] * 50
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    drawn, fit = [], quality.fit
    monkeypatch.setattr(quality, "fit", lambda p, u, **more: drawn.append(u) or fit(p, u, **more))
    assert quality.train(docs, spark.createDataFrame([(k, 1) for k in range(10)], "doc_id long, quality int"), unlabelled=80)
    marks = drawn[0].std(axis=0).argmax()
    last = max((drawn[0][:, marks] == v).sum() for v in np.unique(drawn[0][:, marks]))
    assert len(drawn[0]) == 80 and 40 <= last <= 65


def test_prior_counts_all_unlabelled_documents(spark):
    """Labels of bad texts change nothing; the prior is near the share of good texts among the documents without a label."""
    rows, labels = graded(1500)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    make = lambda pairs: quality.train(docs, spark.createDataFrame(pairs, "doc_id long, quality int"))
    one = make(labels)
    named = dict(labels)
    free = [t for k, t in rows if k not in named]
    truth = np.mean([t[0].isupper() and t.endswith(".") and "##" not in t for t in free])
    assert abs(one.prior - truth) < 0.12
    # A label of a bad text only takes its document from the unlabelled ones, whatever it says.
    two = make([(k, q if q else None) for k, q in labels])
    assert two.prior == one.prior and all(np.array_equal(a.w1, b.w1) for a, b in zip(one.members, two.members, strict=True))


def test_best_bin():
    rng = np.random.default_rng(4)
    for prior in (0.3, 0.8):
        positive = rng.normal(2, 1, 4000)
        unlabelled = np.concatenate([rng.normal(2, 1, int(20_000 * prior)), rng.normal(-2, 1, 20_000 - int(20_000 * prior))])
        cuts = quality._cuts(positive)
        share = lambda v: quality._above(v, cuts) / len(v)
        assert abs(quality.best_bin(share(unlabelled), share(positive), len(unlabelled), len(positive)) - prior) < 0.05


def test_counts_equal_brute_force(spark):
    rows, _ = graded(200)
    rows += [(None, "No id."), (3, "Twice."), (500, None)]
    rng = np.random.default_rng(1)
    x = quality.features(*buffers([t for _, t in rows]))
    models = [quality.fit(x[rng.permutation(len(x))[:80]], x, prior=0.5, epochs=2) for _ in range(2)]
    rankers = [(m, quality._cuts(m.raw(x[:50])) + 1e-3, None) for m in models]
    labelled = [1, 2, 3, 10_000]
    got = quality._counts(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(k,) for k in labelled], "doc_id long"), rankers)
    free = np.array([i not in labelled for i, _ in rows])
    for (m, cuts, _), n in zip(rankers, got, strict=True):
        raw = m.raw(x[free])
        assert n.tolist() == [*[(raw >= c).sum() for c in cuts], free.sum()]


def buffers(texts):
    raw = [(t or "").encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])])


def brute_features(text):
    """The features by their definition, character by character and word by word."""
    raw, w = text.encode(), [x.encode() for x in words(text)]
    out = np.zeros(quality.N_FEATURES)
    kind = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\v\f\r", "\n", ".", ",;:", "|", "!?", "#", "$%", "&*", "\"'`", "()[]{}<>", "-_/\\@+=~^"]
    of = lambda b: 0 if b >= 128 else next((k for k, c in enumerate(kind) if chr(b) in c), 15)
    for a, b in zip(raw, raw[1:], strict=False):
        out[of(a) * 16 + of(b)] += 1
    out[:256] = np.sqrt(out[:256] / max(len(raw) - 1, 1))
    lower = [bytes(b + 32 if 65 <= b <= 90 else b for b in x) for x in w]
    lines = [x for x in raw.split(b"\n") if x]
    grams = [tuple(lower[k : k + 5]) for k in range(len(lower) - 4)] if len(lower) >= 5 else [tuple(lower)] * bool(lower)
    n, size = max(len(w), 1), [len(x) for x in w]
    mean = sum(size) / n
    out[256:] = [
        np.log1p(len(w)) / 8, mean / 10, np.sqrt(max(sum(k * k for k in size) / n - mean * mean, 0)) / 10, len(set(lower)) / n, len(set(grams)) / max(len(grams), 1),
        np.log1p(len(lines)) / 5, len(set(lines)) / max(len(lines), 1), np.log1p(len(w) / max(len(lines), 1)) / 5, sum(a == b for a, b in zip(lower, lower[1:], strict=False)) / n,
        sum(65 <= x[0] <= 90 for x in w) / n, not w, len(w) < 5,
    ]
    return out


def test_scores_equal_brute_force(spark):
    texts = [t for _, t in graded(60)[0]] + [t for _, t in corpus(5, 12)] + ["", None, " \n\n ", "one", "a b c d", "é日 | !!\n#x\n#x"]
    rows = [(k, t) for k, t in enumerate(texts)]
    rows += rows[:2]
    x = quality.features(*buffers(texts))
    model = quality.Committee([quality.fit(x[::2], x, prior=0.6, epochs=2, seed=k) for k in range(3)], 0.6)
    want = {}
    for k, t in enumerate(texts):
        f, each = brute_features(t or ""), []
        for m in model.members:
            h = np.maximum(np.clip((f - m.mean) / m.scale, -6, 6) @ m.w1 + m.b1, 0)
            each.append(1 / (1 + np.exp(-(h @ m.w2 + m.b2))))
        want[k] = np.mean(each)
    got = quality.score(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()
    assert len(got) == len(rows) and all(abs(r["score"] - want[r["doc_id"]]) < 2e-3 and r["predicted"] == (r["score"] >= 0.3) for r in got)


def test_non_negative_risk_separates():
    rng = np.random.default_rng(0)
    positive, negative = rng.normal(1, 1, (800, 5)), rng.normal(-1, 1, (800, 5))
    unlabelled = np.concatenate([rng.normal(1, 1, (560, 5)), negative[:240]])
    model = quality.fit(positive.astype(np.float32), unlabelled.astype(np.float32), prior=0.7)
    assert (model.raw(positive) > 0).mean() > 0.9 and (model.raw(negative) < 0).mean() > 0.85
