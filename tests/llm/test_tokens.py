import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer, models

from lorekeel.llm import bpe_codec, token_counts, token_store

from .helpers import DOCS, WORD, prose, rows, tokenizer


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokenizer())


@pytest.fixture(scope="module")
def codec():
    return bpe_codec.Codec(tokenizer(), long=24, leaf=8)


ALPHABET = "abzAÉ é.,!12 \n-_=>'stlİΣßﬁ́\x1c\x85１½<|endoftext|>我🙂‍"


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(alphabet=ALPHABET, max_size=80), st.text(max_size=60), st.text(alphabet="thehandion", max_size=300)))
def test_codec_is_exact(codec, library, text):
    want = library.encode(text.encode("utf-8", "ignore").decode(), add_special_tokens=False).ids
    got = codec.encode_all([text.encode("utf-8", "ignore").decode()])[0].tolist()
    assert got == want
    assert codec.decode(np.array(got)) == library.decode(want, skip_special_tokens=False)


def test_tree_concatenation_of_long_unsplit_texts(library):
    """Words of up to a million characters without any white space, of letters, digits, signs and mixtures of them."""
    rng = random.Random(11)
    codec = bpe_codec.Codec(tokenizer(), leaf=512)
    syllables = ("on", "the", "re", "ti", "es", "an", "la", "ción", "é", "ß", "x", "zz")
    letters = "".join(rng.choice(syllables) for _ in range(20_000))
    texts = [letters, "ab" * 9000, "a" * 20_001, "#" * 5000 + letters[:3000] + "=" * 700 + "12" * 900, f"{letters[:9000]}<|endoftext|>{letters[:700]}", "我" * 3000]
    texts += [letters[i : i + rng.randint(257, 4000)] for i in range(0, 8000, 900)]
    texts.append("".join(rng.choice(syllables) for _ in range(500_000)))
    for t in (*texts, " ".join(texts[:3])):
        got = codec.encode_all([t])[0].tolist()
        assert got == library.encode(t, add_special_tokens=False).ids
    assert bpe_codec.Codec(tokenizer()).encode_all(texts)[0].tolist() == codec.encode_all(texts[:1])[0].tolist()


def test_null_and_empty_ids_decode(spark):
    made = spark.createDataFrame([((1,), None), ((2,), [])], "box struct<doc_id:long>, ids array<int>")
    got = {r["box"]["doc_id"]: r["decoded"] for r in bpe_codec.decode_documents(made, tokenizer()).collect()}
    assert got == {1: None, 2: ""}


def test_cache_starts_anew_without_a_trace(library):
    small = bpe_codec.Codec(tokenizer(), cache_words=50)
    rng = random.Random(2)
    texts = [" ".join("".join(rng.choice("abcdeß'.,") for _ in range(rng.randint(1, 9))) for _ in range(60)) for _ in range(30)]
    for t in texts:
        assert small.encode_all([t])[0].tolist() == library.encode(t, add_special_tokens=False).ids


def test_words_without_pre_tokens_do_not_shift_others(library):
    """Words of white space beyond ASCII have no pre-token; ids must stay with their own words, and later ones too."""
    codec = bpe_codec.Codec(tokenizer())
    for t in ("\u00a0 end.", "see \u2028 it's ok", "a \u00a0 \u3000 b. \u0085 c", "cafe\u0301 \u00a0 it's", "\u4e16 end. it's"):
        assert codec.encode_all([t])[0].tolist() == library.encode(t, add_special_tokens=False).ids, t


def test_other_tokenizers_get_whole_texts():
    path = tokenizer("byte_bpe_50k.json")
    text = "Hello  world\n\n it's 2024 <|endoftext|> ok"
    assert bpe_codec.Codec(path).encode_all([text])[0].tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


def test_documents_round_trip(spark, library):
    data = rows()
    docs = spark.createDataFrame(data, DOCS).repartition(4)
    encoded = bpe_codec.encode_documents(docs, tokenizer())
    for r in encoded.collect():
        want = library.encode(r["box"]["text"] or "", add_special_tokens=False).ids
        assert r["ids"] == want and r["n_tokens"] == len(want)
    for r in bpe_codec.decode_documents(encoded, tokenizer()).collect():
        ids = library.encode(r["box"]["text"] or "", add_special_tokens=False).ids
        assert r["decoded"] == library.decode(ids, skip_special_tokens=False)


def test_digests(spark, library):
    data = rows()
    docs = spark.createDataFrame(data, DOCS)
    got = bpe_codec.codec_digests(docs, tokenizer()).collect()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for r in data:
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        want.append((r[0], len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert bpe_codec.codec_digests(spark.createDataFrame([], DOCS), tokenizer()).count() == 0


def test_token_counts_against_the_library(spark):
    path = tokenizer("piece_bpe_32k.model")
    scores = token_counts.vocabulary(path)
    pieces = [("<unk>", 0.0), *scores.items()]
    unigram = Tokenizer(models.Unigram(pieces, 0, False))
    trie = token_counts.PrefixTrie(scores, nodes=3000)
    rng = random.Random(4)
    words = ["the", "internationalisation", "", "ciónque", "x" * 500, "Straße", "aaaaab", "1234", "don't"]
    words += ["".join(rng.choice("thereandoéß") for _ in range(rng.randint(1, 25))) for _ in range(400)]
    for w in words:
        token = token_counts.MARK + w
        assert trie.count(token) == len(unigram.encode(token).ids), w
    assert trie.count(token_counts.MARK + "😀") == trie.count(token_counts.MARK) + len("😀".encode()) or "😀" in scores
    data = rows()
    got = token_counts.token_counts(spark.createDataFrame(data, DOCS), path).collect()
    want = []
    for r in data:
        found = WORD.findall(r[1] or "")
        want.append((r[0], len(found), sum(trie.count(token_counts.MARK + w) for w in found)))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_words_are_counted_together_and_once():
    scores = token_counts.vocabulary(tokenizer("piece_bpe_32k.model"))
    unigram = Tokenizer(models.Unigram([("<unk>", 0.0), *scores.items()], 0, False))
    trie = token_counts.PrefixTrie(scores)
    rng = random.Random(8)
    words = ["".join(rng.choice("thereandoéßü▁|.%") for _ in range(rng.randint(1, 90))) for _ in range(600)]
    words += ["the", "then", "thenthen", "x" * 63, "x" * 64, "x" * 65, "a\0", "a", "\0", "a\x85b\xa0c\x1c\u3000d"]
    tokens = ["", *(token_counts.MARK + w for w in words)]
    assert trie.counts(tokens).tolist() == [len(unigram.encode(t).ids) for t in tokens]
    odd = [token_counts.MARK + w for w in ("😀", "a😀\U0010ffff", "\ue000the", "\u07ff\u0800")]
    assert trie.counts(odd).tolist() == [trie.count(t) for t in odd]
    # ties (the longest piece wins) and a vocabulary without single characters
    for own in ({"ab": -2.0, "a": -1.0, "b": -1.0, "abab": -4.0}, {"ab": -1.0, "bca": -1.5}, {}):
        small, texts = token_counts.PrefixTrie(own), ["".join(rng.choice("abcé") for _ in range(rng.randint(1, 12))) for _ in range(200)]
        assert small.counts(texts).tolist() == [small.count(t) for t in texts]

    asked = []
    counted, trie.counts = trie.counts, lambda found: asked.extend(found) or counted(found)
    keeper = token_counts.WordCounts(trie)
    texts = [" ".join(words[:300]), "", " \t\n\v\f\r", "the\x0bthen\rthe", " ".join(words[200:])] * 3
    want = [[trie.count(token_counts.MARK + w) for w in WORD.findall(t)] for t in texts]
    for _ in range(2):
        assert keeper.of_texts([t.encode() for t in texts]) == (list(map(len, want)), list(map(sum, want)))
    assert sorted(asked) == sorted({token_counts.MARK + w for t in texts for w in WORD.findall(t)})
    few = token_counts.WordCounts(trie, limit=10)  # starts anew, and results stay
    assert [few.of_texts([t.encode()]) for t in texts] == [([len(w)], [sum(w)]) for w in want]


def test_a_text_longer_than_a_piece_is_counted_whole(monkeypatch):
    monkeypatch.setattr(token_counts, "PIECE", 50)
    keeper = token_counts.WordCounts(token_counts.PrefixTrie(token_counts.vocabulary(tokenizer("piece_bpe_32k.model"))))
    text = prose(random.Random(3), 400) + "\x0b" + "é" * 200 + " the"
    found = WORD.findall(text)
    assert b"".join(token_counts._cut(text.encode())) == text.encode()
    assert keeper.of_texts([text.encode()]) == ([len(found)], [sum(keeper.trie.count(token_counts.MARK + w) for w in found)])


def test_store_reads_back_what_was_written(spark, library):
    data = rows()
    docs = spark.createDataFrame(data, DOCS).repartition(4)
    store = token_store.write_store(docs, tokenizer())
    got = sorted(token_store.read_store(spark, store).collect(), key=lambda r: r["start"])
    ids = [r["doc_id"] for r in got]
    assert ids == sorted([i for i in ids if i is not None]) + [None, None]
    at = 0
    texts = {}
    for r in data:
        texts.setdefault(r[0], []).append(np.array(library.encode(r[1] or "", add_special_tokens=False).ids + [1], "<u4"))
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
        assert (r["n_tokens"], r["ids_crc32"]) in [(len(x), zlib.crc32(x.tobytes())) for x in texts[r["doc_id"]]]
    back = token_store.read_ids(spark, store).collect()
    assert len(back) == len(data)
    for r in back:
        assert any(r["ids"] == x.tolist() for x in texts[r["doc_id"]])


def test_store_holds_each_chunk_once(spark):
    docs = spark.createDataFrame([(i, "same words here " * 900) for i in range(20)], "doc_id long, text string").repartition(5)
    store = token_store.write_store(docs, tokenizer())
    chunks = token_store.chunk_table(spark, store)
    assert chunks.where("stored").count() == chunks.select("digest").distinct().count()
    assert chunks.where("stored and ids is null").count() == 0


def test_store_notices_damage(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "gamma")], "doc_id long, text string")
    store = token_store.write_store(docs, tokenizer())
    held = token_store.chunk_table(spark, store)
    chunks = held.toPandas()
    chunks["ids"] = [None if x is None else bytes(len(x)) for x in chunks["ids"]]
    spark.createDataFrame([tuple(r) for r in chunks.astype(object).where(chunks.notna(), None).itertuples(index=False)], held.schema).write.partitionBy("stored").parquet(f"{store}-bad/chunks")
    for part in ("recipes", "manifest"):
        spark.read.parquet(f"{store}/{part}").write.parquet(f"{store}-bad/{part}")
    with pytest.raises(Exception, match="does not hold"):
        token_store.read_store(spark, f"{store}-bad").collect()


@pytest.mark.parametrize("what", ["doc_id", "n_tokens", "local_start", "pos", "part", "root", "at", "lost", "manifest.start", "manifest.root", "manifest.tokens"])
def test_store_notices_damaged_recipes_and_manifest(spark, small_store, what):
    bad = f"{small_store}-bad-{what}"
    for name in ("chunks", "recipes", "manifest"):
        frame = spark.read.parquet(f"{small_store}/{name}")
        rows = [r.asDict(recursive=True) for r in frame.collect()]
        table, _, field = what.rpartition(".")
        if name == (table or "recipes"):
            hit = max(rows, key=lambda r: r.get("pos", r["part"]))
            if what == "lost":
                rows.remove(hit)
            elif field == "at":
                hit["chunks"][0]["at"] += 1
            elif field == "root":
                hit["root"] = bytes(32)
            else:
                hit[field] = (hit[field] or 0) + 1
        out = spark.createDataFrame(rows, frame.schema)
        (out.write.partitionBy("stored") if name == "chunks" else out.write).parquet(f"{bad}/{name}")
    with pytest.raises(Exception, match="Merkle|lost chunks|not hold"):
        token_store.read_store(spark, bad).collect()


@pytest.fixture(scope="module")
def small_store(spark):
    docs = spark.createDataFrame([r for r in rows() if r[0] is None or r[0] < 20], DOCS).repartition(3)
    return token_store.write_store(docs, tokenizer())


def test_empty_store(spark):
    store = token_store.write_store(spark.createDataFrame([], DOCS), tokenizer())
    assert token_store.read_store(spark, store).count() == 0


def test_chunks_follow_content_and_stay_bounded():
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 40_000, 20_000).astype(np.int32)
    moved = np.concatenate([rng.integers(0, 40_000, 137).astype(np.int32), ids])
    cut = lambda x: {x[a:b].tobytes() for a, b in zip([0, *token_store.cut_points(x)], token_store.cut_points(x), strict=False)}
    assert len(cut(ids) & cut(moved)) >= len(cut(ids)) - 2
    ends = token_store.cut_points(np.zeros(50_000, np.int32))
    assert ends[-1] == 50_000 and max(np.diff([0, *ends])) <= token_store.LONGEST


def test_checksums_combine():
    rng = random.Random(3)
    parts = [rng.randbytes(rng.randrange(0, 300)) for _ in range(20)]
    crcs, after, n = [], [], sum(map(len, parts))
    for p in parts:
        n -= len(p)
        crcs.append(zlib.crc32(p))
        after.append(n)
    out = np.bitwise_xor.reduce(token_store.crc_shifted(np.array(crcs), np.array(after)))
    assert int(out) == zlib.crc32(b"".join(parts))


def test_chunks_cut_together_are_those_of_each_stream_alone():
    """Short, empty and periodic streams, and ids beyond 16 bits; the hash is summed up id by id."""
    rng = np.random.default_rng(7)
    sizes = [0, 1, 3, 15, 16, 17, 0, 900, 5000, 2, 40]
    for top in (4, 40_000, 90_000):
        streams = [rng.integers(0, top, n).astype(np.int32) for n in sizes] + [np.full(9000, 3, np.int32)]
        for found, stream in zip(token_store.chunk_streams(streams, 1), streams, strict=True):
            ids = np.append(stream, np.int32(1))
            gears, ends = token_store._gears(ids).tolist(), []
            for i in range(len(ids)):
                rolled = sum(pow(3, j) * gears[i - j] for j in range(min(token_store.SPAN, i + 1))) % (1 << 64)
                if rolled >> (64 - token_store.CUT_BITS) == 0 or i + 1 == len(ids) or i + 1 - (ends[-1] if ends else 0) == token_store.LONGEST:
                    ends.append(i + 1)
            bodies = [token_store.packed(ids[a:b]) for a, b in zip([0, *ends], ends, strict=False)]
            assert found == [(b - n, n, hashlib.sha256(x).digest(), x) for b, n, x in zip(ends, np.diff([0, *ends]).tolist(), bodies, strict=True)]


def test_hashes_and_shifts_are_tables(monkeypatch):
    """What is a function of an id, or of a power of two, is not worked out anew for each id and each checksum."""
    worked = []
    for name in ("_gears", "_crc_multiply"):
        monkeypatch.setattr(token_store, name, lambda a, *rest, old=getattr(token_store, name): worked.append(np.size(a)) or old(a, *rest))
    rng = np.random.default_rng(8)
    for _ in range(10):
        token_store.cut_points(rng.integers(0, 49_000, 20_000).astype(np.int32))
    assert sum(worked) <= 1 << 16
    worked.clear()
    for _ in range(10):
        token_store.crc_shifted(rng.integers(0, 1 << 32, 10_000), rng.integers(0, 1 << 20, 10_000))
    assert sum(worked) <= 1025 * 20
