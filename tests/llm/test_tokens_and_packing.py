"""Token files and packing against the tokenizer called on whole texts."""

import json
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from tokenizers import Tokenizer

from answerlens.llm import packing, token_files
from answerlens.llm.encoder import Encoder, public_tokenizer
from tests.llm.conftest import ROWS, SF


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizer())


def whole(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [1]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_encoder_equals_tokenizer(tokenizer):
    tool = Encoder(public_tokenizer(), 1, cache_words=50)
    samples = [t or "" for _, t, *_ in ROWS] + ["END.. ,,a ,b. c!,. <|ENDOFTEXT|>. <|endoftext|>, É.É! 'S 're's ...", "\x1c \x85  x. ​"]
    for _ in range(2):
        assert [x.tolist() for x in tool.encode(samples)] == [whole(tokenizer, t) for t in samples]


def test_encoder_equals_tokenizer_on_every_low_character(tokenizer):
    chars = [chr(c) for c in range(0x300)]
    samples = ["".join(chars), *(f"{c} a{c} {c}b x{c}., {c}?' {c}{c.upper()}'s" for c in chars), "日本é. İ., Ǆa!? 'S' a'll'"]
    assert [x.tolist() for x in Encoder(public_tokenizer(), 1).encode(samples)] == [whole(tokenizer, t) for t in samples]


def test_words_of_letters_skip_the_rules_before_the_merges(tokenizer):
    class Seen:
        words = []

        def encode(self, words, **how):
            self.words += words
            return tokenizer.encode(words, **how)

    tool = Encoder(public_tokenizer(), 1)
    tool.tokenizer = Seen()
    text = "Plain words, Éclair; öfter?' (said) don't x1 PLAIN. plain) éclair..."
    assert [x.tolist() for x in tool.encode([text])] == [whole(tokenizer, text)]
    assert {w for w in Seen.words if w} == {",", ";", "?'", ")", ".", "...", "(said", "don't", "x1"}


def test_encoder_leaves_words_whole_for_a_tokenizer_of_other_rules(tmp_path):
    spec = json.loads(Path(public_tokenizer()).read_text())
    spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] = r"\S+"
    path = tmp_path / "tokenizer.json"
    path.write_text(json.dumps(spec))
    text = "end... of, the) éa! Plain"
    want = whole(Tokenizer.from_file(str(path)), text)
    assert [x.tolist() for x in Encoder(str(path), 1).encode([text, ""])] == [want, [1]]


def test_files_round_trip(spark, tokenizer, tmp_path, odd):
    folder = f"file://{tmp_path}/tokens"
    token_files.write_token_files(odd, folder, public_tokenizer())
    want = sorted(([d, whole(tokenizer, t)] for d, t, *_ in ROWS), key=repr)
    read = token_files.read_token_files(spark, folder, docs_per_split=2).orderBy("start").collect()
    assert sorted(([r["doc_id"], list(r["ids"])] for r in read), key=repr) == want
    ids = [r["doc_id"] for r in read]
    assert ids == [None, None, *sorted(i for i in ids if i is not None)]
    at = 0
    for r in token_files.token_digests(spark, folder).orderBy("start").collect():
        assert r["start"] == at
        at += r["n_tokens"]
    asked = spark.createDataFrame([(5,), (8,), (77,)], "doc_id long")
    found = token_files.fetch_documents(spark, folder, asked).collect()
    assert Counter(r["doc_id"] for r in found) == {5: 1, 8: 2}
    assert next(list(r["ids"]) for r in found if r["doc_id"] == 5) == whole(tokenizer, ROWS[4][1])


def test_frames_are_independent_and_checked(tmp_path):
    writer = token_files.ShardWriter(str(tmp_path), 3, 2)
    long = np.arange(token_files.FRAME_IDS + 5, dtype="<u2").tobytes()
    for doc, raw in ((None, b"\x01\x00"), (7, long), (8, b"")):
        writer.add(doc, raw)
    writer.close()
    reader = token_files.ShardReader(str(tmp_path), 3)
    assert reader.document(1).tobytes() == long and len(reader.document(2)) == 0
    assert np.diff(reader.first_frame).tolist() == [1, 2, 1]
    path = tmp_path / token_files.shard_name(3)
    import zstandard

    assert zstandard.ZstdDecompressor().stream_reader(path.open("rb"), read_across_frames=True).read() == b"\x01\x00" + long
    data = bytearray(path.read_bytes())
    data[12] ^= 1
    path.write_bytes(data)
    with pytest.raises((ValueError, zstandard.ZstdError)):
        broken = token_files.ShardReader(str(tmp_path), 3)
        for k in range(3):
            broken.document(k)


def test_empty_table(spark, none, tmp_path):
    folder = f"{tmp_path}/none"
    token_files.write_token_files(none, folder, public_tokenizer())
    assert token_files.token_digests(spark, folder).count() == 0
    assert packing.pack(none, public_tokenizer()).count() == 0


def test_query_equals_brute_force(spark, tokenizer, texts):
    at = 0
    want = set()
    for doc, text in sorted(texts.items()):
        ids = whole(tokenizer, text)
        want.add((doc, at, len(ids), crc(ids)))
        at += len(ids)
    got = token_files.op1_token_files(spark, SF).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def check_packing(rows, capacity=2048):
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return sequences


def test_packing_equals_brute_force(spark, tokenizer, texts, odd):
    for rows, source in ((packing.op5_packing(spark, SF).collect(), list(texts.items())), (packing.pack(odd, public_tokenizer()).collect(), [r[:2] for r in ROWS])):
        check_packing(rows)
        want = Counter()
        for doc, text in source:
            ids = whole(tokenizer, text)
            for i in range(0, len(ids), 2048):
                want[doc, i, len(ids[i : i + 2048]), crc(ids[i : i + 2048]), len(ids)] += 1
        assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows) == want


def test_patterns_hold_every_piece_and_little_padding():
    rng = np.random.default_rng(5)
    histogram = Counter(rng.integers(1, 2048, 5000).tolist()) + Counter(rng.integers(1, 300, 4000).tolist()) + Counter({1: 3, 2047: 2, 700: 500})
    patterns = packing.shortest_pack_first(histogram)
    placed, padding = Counter(), 0
    for count, items in patterns:
        used = sum(n * k for n, k in items)
        assert 0 < used <= 2048
        padding += count * (2048 - used)
        for length, k in items:
            placed[length] += k * count
    assert placed == histogram
    assert padding < 0.05 * sum(n * k for n, k in histogram.items())
    assert packing.shortest_pack_first({}) == []


def test_shortest_pack_takes_the_next_length():
    # 6 and 5 open packs; 4 goes where there is most room, and so on.
    assert sorted(packing.shortest_pack_first({6: 1, 5: 1, 4: 1, 3: 1}, 10)) == [(1, [(5, 1), (4, 1)]), (1, [(6, 1), (3, 1)])]
