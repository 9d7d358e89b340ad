import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyarrow import fs
from pyspark.sql import functions as F

from tidespan.llm import token_count, token_store, tokens

from .helpers import EDGES, documents, prose, with_clashes

FILES = ("word_bpe_49k.json", "byte_bpe_50k.json")
HARD = ["", " ", "\n", "  a  b ", "x<|endoftext|> y <|startoftext|>z", "é́ ́a ß İ ΟΔΟΣ", "a\x1cb c\x85 d", "don't I'll  we've", "日本語 テスト a  b 𝔘𝔫", "ﬁ ½ ²", "a​ b", "x1y2 3.", "\t\ttab  ", "a" * 500, "word. word, word.\nword!! 'word' \"word\"", "a.\n\nb \n c", "...", ". a", "a .", "3. 4,", "* İ*", "ABİ. DENİZİ, evet", "q̣̇. ḍ̇ i̇!", "²., ⅷ; ٣: 〇?"]

#: Characters and strings that normalizers, pre-tokenizers and added tokens treat in their own ways.
ANY = st.sampled_from([*"ab .,\n\t'1é<|>日ΣßİıŞ²½*", "\u0301", "\u0307", "\u0323", "\u00a0", "\u0085", "\x1c", "\u3000", "\u200b", "\u1100", "\u1161", "\u11a8", "<|endoftext|>", "<|startoftext|>", "'s", "n't", "  ", "word", "unbelievable"])


def path(name):
    return tokens.vocabulary_path(name)


def library(name, texts):
    return [e.ids for e in tokens.load(path(name)).encode_batch_fast(texts, add_special_tokens=False)]


def plain(raw):
    return [np.frombuffer(x, "<u4").tolist() for x in raw]


@pytest.mark.parametrize("name", FILES)
def test_units_give_what_the_library_gives(name, monkeypatch):
    monkeypatch.setattr(tokens, "GENERATION", 50)  # forget often
    enc, rng = tokens.UnitEncoder(path(name)), random.Random(1)
    for _ in range(5):
        texts = [*HARD, *(prose(rng, 60) for _ in range(20)), *(" ".join(rng.sample(HARD, 5)) for _ in range(20))]
        assert plain(enc.encode_batch(texts)) == library(name, texts)


@pytest.mark.parametrize("name", FILES)
@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(ANY, max_size=30).map("".join), max_size=4))
def test_units_on_any_text(name, texts):
    assert plain(tokens.encoder(path(name)).encode_batch(texts)) == library(name, texts)


@pytest.mark.parametrize("name", FILES)
@settings(max_examples=150, deadline=None)
@given(st.lists(ANY, max_size=160).map("".join), st.integers(5, 60), st.integers(1, 20))
def test_spliced_chunks_on_any_text(name, text, chunk, overlap):
    assert token_count.count_long(text, tokens.load(path(name)), chunk, overlap) == len(library(name, [text])[0])


@pytest.mark.parametrize("name", FILES)
@pytest.mark.parametrize(("chunk", "overlap"), [(40, 4), (64, 16), (500, 30)])
def test_spliced_chunks_count_like_the_whole(name, chunk, overlap):
    rng, tok = random.Random(2), tokens.load(path(name))
    texts = [prose(rng, 300), "x" * 700, "word " * 200, "a\n" * 150 + "b" * 300 + " c" * 90, "  ".join("ab" for _ in range(200)), "ab<|endoftext|>cd " * 40, "".join(rng.choice("ab .\n\t é日") for _ in range(900))]
    assert [token_count.count_long(t, tok, chunk, overlap) for t in texts] == [len(i) for i in library(name, texts)]


def test_no_boundary_widens_the_overlap(monkeypatch):
    tok, made = tokens.load(path(FILES[1])), []
    real = token_count.Chunk

    def chunk(e, text, start, end):
        made.append((start, end))
        return real(e, text, start, end)

    monkeypatch.setattr(token_count, "Chunk", chunk)
    text = "w " * 30 + "x" * 300 + " w" * 30
    assert token_count.count_long(text, tok, 100, 10) == len(library(FILES[1], [text])[0])
    assert len({start for start, end in made if end == made[1][1]}) > 1


@pytest.mark.parametrize("name", FILES)
def test_boundaries_that_only_look_common_are_rejected(name):
    """Tokens inside one long word agree in offsets and ids for a while, and still prove nothing."""
    tok, text = tokens.load(path(name)), "unbelievableinternationalization" * 12
    left, right = token_count.Chunk(tok, text, 0, 300), token_count.Chunk(tok, text, 199, 384)
    same = set(zip(left.at, left.ids)) & set(zip(right.at, right.ids))
    assert len(same) > token_count.STABLE
    assert token_count.splice(left, right) is None
    # a real boundary near by is found, and it is not the first place that looks like one
    text = text + " one two three four" + text
    left, right = token_count.Chunk(tok, text, 0, 420), token_count.Chunk(tok, text, 199, 500)
    i, j = token_count.splice(left, right, margin=token_count._margin(tok))
    assert left.at[i] == right.at[j] and text[left.at[i][0] : left.at[i][1]].strip() == "one"


def test_runs_without_a_boundary_are_encoded_a_few_times(monkeypatch):
    tok, size = tokens.load(path(FILES[0])), []
    real = token_count.Chunk
    monkeypatch.setattr(token_count, "Chunk", lambda t, text, a, b: size.append(b - a) or real(t, text, a, b))
    text = "ab" * 20_000 + " end"
    assert token_count.count_long(text, tok, 500, 20) == len(library(FILES[0], [text])[0])
    assert sum(size) < 12 * len(text)


def test_units_are_used_only_where_the_definition_allows():
    assert not tokens.independent_units(tokens.load(path(FILES[0]))) and tokens.independent_units(tokens.load(path(FILES[1])))


def test_normalized_is_what_the_library_makes():
    """Every character within the ranges, alone and beside any other, and every other one left to the library."""
    tok, rng = tokens.load(path(FILES[0])), random.Random(5)
    within = [c for c in map(chr, range(0x110000)) if not 0xD800 <= ord(c) < 0xE000 and not token_count._OTHER.match(c)]
    mixed = ["".join(rng.choices(within, k=200)) for _ in range(300)] + ["".join(rng.choices(within[:0x300], k=400)) for _ in range(600)] + ["".join(rng.choices("aB \n\t\r\x0b\x0c\x1c\x85\xa0İß", k=90)) for _ in range(300)]
    for t in [*(f"x{c}y" for c in within), *within, *mixed]:
        assert token_count.normalized(t, []) == tok.normalizer.normalize_str(t)
    for c in ["\u0301", "\u0338", "Σ", "\u1100", "\u11a8", "\u3000", "\u3099", "\u2028", "\u2001", "\u212b"]:
        assert token_count.normalized(f"a{c}b", []) is None
    _, added = token_count.unnormalized(path(FILES[0]))
    assert added and all(token_count.normalized(f"a {x} b", added) is None for a in added for x in (a, a.upper()))
    assert token_count.unnormalized(path(FILES[1])) is None


@pytest.mark.parametrize("name", FILES)
@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.one_of(ANY, st.sampled_from(["<|ENDOFTEXT|>", "<|", "\x85", "ЖЙё", "’", "—", "한글", "漢字", "かが"])), max_size=60).map("".join), max_size=5))
def test_counts_of_any_texts(name, texts):
    assert token_count.counts(texts, path(name)) == [len(i) for i in library(name, texts)]


def test_the_normalizer_runs_only_where_it_is_needed(monkeypatch):
    real, seen = tokens.load(path(FILES[0])), []

    class Watched:
        def __getattr__(self, a):
            return getattr(real, a)

        def encode_batch_fast(self, texts, **k):
            seen.extend(texts)
            return real.encode_batch_fast(texts, **k)

        def encode(self, text, **k):
            seen.append(text)
            return real.encode(text, **k)

    monkeypatch.setattr(token_count, "load", lambda _: Watched())
    texts = ["Plain  Words.\nEt café", "Abc " * 9000, "e\u0301", "ΟΔΟΣ", "x<|endoftext|>", ""]
    assert token_count.counts(texts, path(FILES[0])) == [len(i) for i in library(FILES[0], texts)]
    assert seen == texts[2:5]


def test_only_the_overlap_is_read(monkeypatch):
    read, text, tok = [], prose(random.Random(6), 3000), tokens.load(path(FILES[0]))

    class Watched(token_count.Chunk):
        def __init__(self, *a):
            super().__init__(*a)
            at = self.at
            self.at = type("At", (), {"__getitem__": lambda _, k: read.append(k) or at[k], "__iter__": lambda _: read.extend(range(len(at))) or iter(at)})()

    monkeypatch.setattr(token_count, "Chunk", Watched)
    assert token_count.count_long(text, tok, 4000, 100) == len(library(FILES[0], [text])[0])
    assert 0 < len(read) < len(library(FILES[0], [text])[0]) / 2


def test_counts(spark, monkeypatch):
    rows = [*EDGES, (20, prose(random.Random(3), 9000)), (21, "<|endoftext|>")]
    got = token_count.count_tokens(with_clashes(documents(spark, rows)), path(FILES[0])).collect()
    want = sorted((str(i), len((t or "").encode()), n, n > 2048) for (i, t), n in zip(rows, map(len, library(FILES[0], [t or "" for _, t in rows]))))
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in got) == want


def test_store_round_trip(spark, monkeypatch, tmp_path):
    rows = [*EDGES, *((100 + k, prose(random.Random(k), 40)) for k in range(60)), (30, prose(random.Random(4), 70_000))]
    docs = with_clashes(documents(spark, rows).repartition(5))
    manifest = token_store.write_tokens(docs, path(FILES[1]), end_id=0, folder=f"file://{tmp_path}/shards")
    got = token_store.read_tokens(manifest, with_ids=True).orderBy("start").collect()
    ids = [r["doc_id"] for r in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0)) and len(got) == len(rows)
    want = {}
    for (i, _), x in zip(rows, library(FILES[1], [t or "" for _, t in rows])):
        want.setdefault(i, []).append([*x, 0])
    at = 0
    for r in got:
        assert r["start"] == at and r["n_tokens"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        want[r["doc_id"]].remove(r["ids"])
        at += r["n_tokens"]
    assert not any(want.values())
    some = token_store.read_documents(manifest, spark.createDataFrame([(105,), (30,), (7777,)], "doc_id long"))
    assert sorted(r["doc_id"] for r in some.collect()) == [30, 105]
    # null and repeated wanted ids; an id of several documents
    some = token_store.read_documents(manifest, spark.createDataFrame([(None,), (6,), (6,), (159,)], "doc_id long")).collect()
    assert sorted(r["doc_id"] for r in some) == [6, 6, 159]
    assert {tuple(r["ids"]) for r in some} <= {(*x, 0) for x in library(FILES[1], [t or "" for _, t in rows])}
    every = token_store.read_documents(manifest, docs.select("doc_id"))
    assert every.count() == len(rows) - 1  # all but the one without an id
    assert token_store.read_documents(manifest, docs.select("doc_id").where("false")).count() == 0
    empty = token_store.write_tokens(docs.where(F.lit(False)), path(FILES[1]))
    assert empty.count() == 0 and token_store.read_tokens(empty).count() == 0


def test_reader_takes_only_the_frames_it_needs_and_checks_them(tmp_path, monkeypatch):
    monkeypatch.setattr(token_store, "FRAME_BYTES", 400)
    local, name = fs.LocalFileSystem(), str(tmp_path / "s.zst")
    w = token_store.ShardWriter(local.open_output_stream(name, compression=None))
    data = {k: np.full(30 + k, k, "<u4").tobytes() for k in range(40)}
    for k, x in data.items():
        w.add(k, x)
    w.close()
    shard = token_store.ShardReader(local.open_input_file(name))
    read = []
    real = shard.plain
    monkeypatch.setattr(shard, "plain", lambda k: read.append(k) or real(k))
    assert len(shard.frames) > 5 and shard.document(17) == (17, data[17]) and len(set(read)) == 1
    # any zstandard tool can read the whole file: the index and the seek table are skippable
    import io

    import zstandard

    with zstandard.ZstdDecompressor().stream_reader(io.BytesIO(open(name, "rb").read()), read_across_frames=True) as r:
        assert r.read() == b"".join(data.values())
    raw = bytearray(open(name, "rb").read())
    raw[int(shard.starts[3]) + 12] ^= 255
    open(name, "wb").write(raw)
    broken = token_store.ShardReader(local.open_input_file(name))
    at = int(np.flatnonzero(broken.frame == 3)[0])
    with pytest.raises(Exception):  # noqa: B017  the frame's own checksum or the table's
        broken.document(at)
    assert broken.document(0)[1] == data[0]
