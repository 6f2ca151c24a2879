"""Packing and BPE against the tokenizers library, chat windows and WARC archives by exact round trips."""

import gzip
import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from graphloom.llm import bpe, chat, packing, warc
from graphloom.session import Workspace

PIECES = [*"abcdefghijkl THE  \n\n\t'sdtllveré中文🎉.,!123", "\xa0", "　", "\x1c", "\x85", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", " the", "ing", "'s", "'ll", "́", "İ", "Σ", ", ", ". ", ".\n", "*** ", "_ ", "'' ", "!!\n"]


def texts(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def test_bpe_equals_the_library():
    t, own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), bpe.encoder(public_tokenizers.path("byte_bpe_50k.json"))
    for s in [*texts(1, 3000), "a" * 5000, "ab" * 3000, " " * 500, "\n \n" * 99]:
        ids = own.encode(s)
        assert ids.tolist() == t.encode(s, add_special_tokens=False).ids, s
        assert own.decode(ids) == s
    for ids in ([0], [255, 3], list(range(100, 200))):
        assert own.decode(np.array(ids)) == t.decode(ids, skip_special_tokens=False)


def test_bpe_cache_forgets_without_harm(monkeypatch):
    own = bpe.BytePairEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    fresh = {s: own.encode(s).tolist() for s in texts(2, 300)}
    own.cache.limit = 5
    assert all(own.encode(s).tolist() == ids for s, ids in fresh.items())


def test_bpe_documents(spark):
    rows = [(i, s) for i, s in enumerate(texts(3, 50))] + [(None, "x"), (1, "x"), (77, None), (78, "")]
    docs = spark.createDataFrame([(s, 1, i) for i, s in rows], "text string, ids int, doc_id long").repartition(2)
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = [(i, len(ids := t.encode(s or "", add_special_tokens=False).ids), sha(",".join(map(str, ids))), sha(s or "")) for i, s in rows]
    assert sorted((tuple(r) for r in bpe.round_trip_digests(docs).collect()), key=str) == sorted(want, key=str)
    back = bpe.decode_documents(bpe.encode_documents(docs))
    assert sorted((tuple(r) for r in back.collect()), key=str) == sorted(((i, s or "") for i, s in rows), key=str)
    assert bpe.round_trip_digests(docs.limit(0)).collect() == []


@pytest.mark.parametrize("n", [0, 1, 7, 2048, 2049, 10_000])
def test_binary_pieces(n):
    pieces = packing.binary_pieces(n, 2048)
    assert sum(size for _, size in pieces) == n and all(size & (size - 1) == 0 and size <= 2048 for _, size in pieces)
    assert [a for a, _ in pieces] == [sum(s for _, s in pieces[:i]) for i in range(len(pieces))]


def test_packing(spark, tmp_path):
    rows = [(i, s * 40) for i, s in enumerate(texts(4, 60))] + [(None, "x"), (1, "x"), (77, None), (78, "")]
    docs = spark.createDataFrame([(s, 1, i) for i, s in rows], "text string, start int, doc_id long").repartition(2)
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for i, s in rows:
        ids = np.array(t.encode(s or "", add_special_tokens=False).ids + [1], "<u4")
        want += [(i, a, n, zlib.crc32(ids[a : a + n].tobytes()), len(ids)) for a, n in packing.binary_pieces(len(ids), 256)]
    pieces = packing.pack_power_of_two(docs, longest=256)
    got = packing.digest(pieces).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
    assert len({r.sequence_id for r in got}) == len(got) and {r.offset for r in got} == {0}
    packing.write_buckets(pieces, f"{tmp_path}/buckets")
    sizes = spark.read.parquet(f"{tmp_path}/buckets").selectExpr("bucket", "octet_length(ids) / 4 as n").distinct().collect()
    assert all(r.n == 1 << r.bucket for r in sizes)
    assert packing.pack_power_of_two(docs.limit(0)).collect() == []


def conversations(seed):
    rng = random.Random(seed)
    rows = [(-1, 0, "user", "<|im_end|><|im_start|>assistant ok"), (-1, 1, "assistant", "<|im_end|><|im_start|>assistant ok"), (None, 0, "assistant", "x"), (None, None, "user", "y")]
    for c in range(40):
        for t in range(rng.choice([1, 2, 3, 30])):
            role = "system" if t == 0 and rng.random() < 0.4 else rng.choice(["user", "assistant", None, "a\nb\\", "<|x"])
            text = rng.choice([None, "", "<\\|", "<|<\\\\|x\\|", "é<|im_end|>\n" * rng.randint(1, 300), "hello " * rng.randint(1, 900)])
            rows.append((c, t if rng.random() < 0.9 else 0, role, text))
    return rows + rows[10:14]


def test_chat_round_trip(spark):
    rows = conversations(5)
    turns = spark.createDataFrame([(t, r, x, c, "k") for c, t, r, x in rows], "turn long, role string, text string, conv_id long, window string").repartition(3)
    samples = chat.format_conversations(turns)
    got = {r.conv_id: r for r in chat.digest(samples).collect()}
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append(((t is not None, t or 0), r or "", x or ""))
    assert set(got) == set(by)
    for c, said in by.items():
        said.sort()
        loss = "".join(x for _, r, x in said if r == "assistant")
        assert got[c].n_turns == len(said) and got[c].turns_sha256 == sha("".join(f"{r}\n{x}\n" for _, r, x in said))
        assert got[c].loss_sha256 == sha(loss) and got[c].loss_chars == len(loss)
    made = samples.collect()
    for c in by:
        assert got[c].formatted_chars == sum(len(s.text) for s in made if s.conv_id == c)
    # windows keep the budget, but for those of the system turn and a single turn
    for s in made:
        cost = piece_costs(s.text)
        system = s.text.startswith(chat.START + "system\n")
        history = sum(cost[: s.n_repeated]) - (cost[0] if system and s.n_repeated else 0)
        assert history <= 256 and (sum(cost) <= 1024 or len(cost) <= 1 + system)
    assert max(s.window for s in made) > 2 and any(s.n_repeated > 1 for s in made)
    assert "PythonUDF" not in chat.digest(samples)._jdf.queryExecution().toString()
    assert chat.digest(chat.format_conversations(turns.limit(0))).collect() == []


def piece_costs(text):
    return [-(-len(p + chat.END + "\n") // chat.CHARS_PER_TOKEN) for p in text.split(chat.END + "\n")[:-1]]


def planned(costs, system, budget, history):
    """(costs of the repeated turns, of the new ones) of each window, turn by turn; system: that of the system turn or 0."""
    spans = [[]]
    for c in costs:
        if spans[-1] and sum(spans[-1]) + c > budget - system - (history if len(spans) > 1 else 0):
            spans.append([])
        spans[-1].append(c)
    out, done = [], 0
    for span in spans:
        back, room = [], min(history, max(0, budget - system - sum(span)))
        for c in reversed(costs[:done]):
            if sum(back) + c > room:
                break
            back.insert(0, c)
        out.append((back, span))
        done += len(span)
    return out


@pytest.mark.parametrize("budget,history,fold", [(1024, 256, 1024), (60, 25, 2), (40, 0, 1)])
def test_chat_windows_as_planned(spark, monkeypatch, budget, history, fold):
    monkeypatch.setattr(chat, "FOLD", fold)
    rng = random.Random(budget)
    rows = [(c, t, "system" if t == 0 and c % 3 == 0 else rng.choice(["user", "assistant"]), "x" * rng.choice([0, 5, 40, 90, 300, 1500, 3600, 20_000])) for c in range(30) for t in range(rng.choice([1, 5, 60]))]
    rows += [(50, 0, "user", "x" * 1500), (50, 1, "assistant", "y" * 3570), (51, 0, "user", "z" * 20_000), (51, 1, "user", "a" * 400), (52, 0, "system", "s" * 9000), (52, 1, "user", "a"), (52, 2, "user", "b"), (53, 0, "system", "only")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    got = defaultdict(dict)
    for s in chat.format_conversations(turns, budget, history).collect():
        got[s.conv_id][s.window] = (piece_costs(s.text), s.n_repeated)
    for c in {r[0] for r in rows}:
        mine = [(r, len(chat.START + r + "\n" + x + chat.END + "\n")) for k, _, r, x in sorted(rows) if k == c]
        costs = [-(-n // chat.CHARS_PER_TOKEN) for _, n in mine]
        system = costs.pop(0) if mine[0][0] == "system" else 0
        want = planned(costs, system, budget, history)
        assert [got[c][w] for w in range(len(got[c]))] == [([system] * (system > 0) + back + span, len(back) + (system > 0 and w > 0)) for w, (back, span) in enumerate(want)], c


def test_a_turn_of_megabytes(spark):
    rows = [(1, 0, "system", "be brief"), (1, 1, "user", "<|im_end|> é\n" * 200_000), (1, 2, "assistant", "ok"), (2, 0, "assistant", "<|" * 600_000), (2, 1, None, None)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.digest(chat.format_conversations(turns)).collect()}
    for c in (1, 2):
        assert got[c].turns_sha256 == sha("".join(f"{r or ''}\n{x or ''}\n" for k, _, r, x in rows if k == c))
        assert got[c].loss_sha256 == sha("".join(x for k, _, r, x in rows if k == c and r == "assistant"))


def test_warc_round_trip(spark, monkeypatch):
    rows = [(1, "http://a/ b\r\nx", "é" * 60), (2, "u", "é" * 60), (3, "u", None), (4, "u", "x\r\n\r\ny" * 30 + "\r"), (5, "u", "x\r\n\r\ny" * 30 + "\r\n"), (6, None, "short"), (7, "u", "short"), (5, "u", "x\r\n\r\ny" * 30 + "\r\n"), (0, "q", "WARC/1.1\r\nContent-Length: 4\r\n\r\n" * 9), (None, "n", "é" * 60), (9, "z", "x\r\n\r\ny" * 30 + "\r\n")]
    pages = spark.createDataFrame([(h, p, u, 1) for p, u, h in rows], "html string, page_id long, url string, digest int").repartition(3)
    for limit in (10**6, -1):
        monkeypatch.setattr(warc, "BROADCAST_GROUPS", limit)
        path = Workspace(spark, "warc-test").path + "/archives"
        warc.write_captures(pages, path)
        captures = warc.assemble(warc.read_records(spark, path))
        first = {}
        for p, _, h in rows:
            if p is not None and len((h or "").encode()) >= 100:
                first[h] = min(p, first.get(h, p))
        want = []
        for p, _, h in rows:
            size, again = len((h or "").encode()), h in first and first[h] != p
            want.append((p, size, hashlib.sha256((h or "").encode()).hexdigest(), "revisit" if again else "response", first[h] if again else None))
        assert sorted((tuple(r) for r in warc.page_digest(captures).collect()), key=str) == sorted(want, key=str)
        for r in captures.collect():
            assert len(r.requests) == len(r.metadata) == 1 and (r.response.type == "revisit" or hashlib.sha256(r.response.payload).hexdigest() == r.response.payload_digest)


def test_warc_parser_skips_what_is_between_records():
    lines = [b"junk", b"WARC/1.0", b"WARC-Type: request", b"WARC-Concurrent-To: <a>", b" <b>", b"Content-Length: 4", b"", b"a", b"b", b"", b"", b"WARC/1.0", b"WARC-Type: response", b"Content-Length: 99", b"", b"cut"]
    first, second = warc.parse_records(iter(lines), True)
    assert first[1:3] == ("request", "<a> <b>") and second[1] == "response" and second[7] == 0


def test_warc_of_one_member_a_record_and_records_without_ids(spark, tmp_path):
    """An archive as crawlers write it: revisits name the response by WARC-Refers-To; some records lack ids."""
    record = lambda kind, headers, block: b"WARC/1.0\r\nWARC-Type: " + kind + b"\r\n" + headers + b"Content-Length: " + str(len(block)).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    http = b"HTTP/1.1 200 OK\r\nContent-Length: 5\r\n\r\n"
    members = [
        record(b"revisit", b"WARC-Record-ID: <b>\r\nWARC-Refers-To: <a>\r\nWARC-Payload-Digest: sha256:x\r\n", http),
        record(b"response", b"WARC-Record-ID: <a>\r\n", http + b"hello"),
        *(record(b"metadata", b"WARC-Concurrent-To: <%s>\r\nContent-Type: application/warc-fields\r\n" % i, b"pageId: %d\r\n" % n) for i, n in ((b"a", 7), (b"b", 8))),
        record(b"revisit", b"WARC-Record-ID: <c>\r\nWARC-Refers-To: <gone>\r\n", http),
        record(b"request", b"", b"GET / HTTP/1.1\r\n\r\n"),
        record(b"request", b"", b"GET / HTTP/1.1\r\n\r\n"),
        record(b"response", b"", http + b"hello"),
    ]
    (tmp_path / "one.warc.gz").write_bytes(b"".join(gzip.compress(m) for m in members))
    captures = warc.assemble(warc.read_records(spark, str(tmp_path)))
    assert sorted((r.capture_id, len(r.requests), r.response is not None) for r in captures.collect() if r.capture_id) == [("<a>", 0, True), ("<b>", 0, True), ("<c>", 0, True)]
    assert sorted((len(r.requests), r.response is not None) for r in captures.collect() if r.capture_id is None) == [(0, True), (1, False), (1, False)]
    got = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to) for r in warc.page_digest(captures).collect() if r.page_id}
    assert got == {7: (5, "response", None), 8: (5, "revisit", 7)}


def test_warc_of_a_page_of_megabytes(spark):
    html = "é\r\n\r\nWARC/1.1 " * 150_000
    pages = spark.createDataFrame([(1, "u", html), (2, "v", html), (3, "w", "")], "page_id long, url string, html string")
    path = Workspace(spark, "warc-test").path + "/archives"
    warc.write_captures(pages, path)
    digest, size = sha(html), len(html.encode())
    assert sorted(tuple(r) for r in warc.page_digest(warc.assemble(warc.read_records(spark, path))).collect()) == [(1, size, digest, "response", None), (2, size, digest, "revisit", 1), (3, 0, sha(""), "response", None)]


def test_warc_of_no_pages(spark):
    path = Workspace(spark, "warc-test").path + "/archives"
    warc.write_captures(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.page_digest(warc.assemble(warc.read_records(spark, path))).collect() == []
