"""Encoding, id files, packing, token counts and shards."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyspark.llm import idpack, packing, sharding, wordpiece
from tallyspark.llm.queries import vocabulary
from tallyspark.llm.tokens import Encoder


def plain_ids(path, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


FILES = ["byte_bpe_50k.json", "word_bpe_49k.json"]


@pytest.mark.parametrize("name", FILES)
def test_pieces_give_the_ids_of_whole_texts(docs, odd, name):
    texts = [r["text"] for r in docs.select("text").union(odd.select("text")).collect()]
    got = Encoder(vocabulary(name)).encode(texts, 1)
    assert [g.tolist() for g in got] == [[*ids, 1] for ids in plain_ids(vocabulary(name), texts)]


@pytest.mark.parametrize("name", FILES)
def test_odd_white_space_and_marks(name):
    encoder = Encoder(vocabulary(name), limit=50)
    alphabet = st.sampled_from([" ", "\n", "\t", "\r", " ", " ", "\x1c", ".", ",", "'s", "don't", "a", "Bc", "é", "é", "7", "##", "漢", "<|endoftext|>", "İ", "Σ"])

    @settings(max_examples=150, deadline=None)
    @given(st.lists(st.lists(alphabet, max_size=12).map("".join), max_size=4))
    def same(texts):
        assert [g.tolist() for g in encoder.encode(texts)] == plain_ids(vocabulary(name), texts)

    same()


@pytest.mark.parametrize("name", FILES)
def test_new_pieces_are_encoded_as_few_texts(name):
    encoder, told = Encoder(vocabulary(name)), []

    def counted(inner):
        class Counted:
            def encode_batch_fast(self, texts, **options):
                told.extend(texts)
                return inner.encode_batch_fast(texts, **options)

        return Counted()

    encoder.tokenizer, encoder.plain = counted(encoder.tokenizer), counted(encoder.plain)
    texts = ["Überfluß façade naïve a1 b2% c-3 x", "ÿ ŉa ƀb don't İx ʼn 漢 ǅa ºb d4,e.\nŒuvre d5."]
    got = encoder.encode(texts)
    assert [g.tolist() for g in got] == plain_ids(vocabulary(name), texts)
    assert len(told) <= 4  # words, and pieces with other signs, together; in spaced mode the first pieces once more


@pytest.mark.parametrize("bits", [1, 3, 8, 13, 16, 17, 25, 32])
def test_bits_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1003).astype(np.uint32)
    data = idpack.pack(ids, bits)
    assert len(data) == 126 * bits
    at = np.random.default_rng(1).integers(0, 1003, 500)
    assert (idpack.unpack(data, bits, at) == ids[at]).all()


def test_id_files_give_back_every_document(spark, docs, odd, tmp_path):
    both = docs.select("doc_id", "text").union(odd.select("doc_id", "text"))
    path = vocabulary("word_bpe_49k.json")
    rows = [(r["doc_id"], r["text"]) for r in both.collect()]
    want = sorted((d is not None, d or 0, len(i) + 1, zlib.crc32(np.array([*i, 2], "<u4").tobytes())) for (d, _), i in zip(rows, plain_ids(path, [t for _, t in rows]), strict=True))
    got = [tuple(r)[:4] for r in idpack.token_files(both, path, 2, str(tmp_path / "ids")).orderBy("start").collect()]
    assert sorted((d is not None, d or 0, n, c) for d, _, n, c in got) == want
    assert [d is not None and d for d, *_ in got] == sorted(d is not None and d for d, *_ in got)
    assert [s for _, s, _, _ in got] == np.cumsum([0, *(n for _, _, n, _ in got)])[:-1].tolist()
    assert idpack.token_files(both.where("false"), path, 2, str(tmp_path / "none")).count() == 0


def test_a_block_is_read_by_itself(tmp_path):
    uri = f"file://{tmp_path}/x.ids"
    writer = idpack.Writer(uri, 16)
    ids = np.random.default_rng(1).integers(0, 40_000, 200_000).astype(np.uint32)
    writer.add(5, ids[:150_000])
    writer.add(None, ids[150_000:150_000])
    writer.add(6, ids[150_000:])
    assert writer.close() == (3, 200_000)
    reader = idpack.Reader(uri)
    assert (reader.ids(130_000, 140_000) == ids[130_000:140_000]).all() and reader.ids(7, 7).size == 0
    assert [c for _, c in reader.checksums()] == [zlib.crc32(p.astype("<u4").tobytes()) for p in (ids[:150_000], ids[:0], ids[150_000:])]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 60), st.integers(0, 50)), max_size=60))
def test_packing_keeps_every_limit(rows):
    demand = np.array([(t, 1, min(loss, t)) for t, loss in rows], np.int64).reshape(-1, 3)
    limits = np.array([64, 5, 40])
    at = packing.fill(demand, limits)
    for s in set(at.tolist()):
        own = demand[at == s]
        assert (own.sum(0) <= limits).all() or len(own) == 1
    assert (at >= 0).all() and sorted(set(at.tolist())) == list(range(len(set(at.tolist()))))


def check_packed(rows, texts, tokens=2048):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    ids = plain_ids(vocabulary("byte_bpe_50k.json"), [t for _, t in texts])
    want = sorted(str((d, s, zlib.crc32(np.array([*i, 1][s : s + tokens], "<u4").tobytes()))) for (d, _), i in zip(texts, ids, strict=True) for s in range(0, len(i) + 1, tokens))
    assert sorted(str((r["doc_id"], r["start"], r["ids_crc32"])) for r in rows) == want
    for own in by_sequence.values():
        own.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in own] == np.cumsum([0, *(r["length"] for r in own)])[:-1].tolist()
        assert sum(r["length"] for r in own) <= tokens
    return sum(r["length"] for r in rows) / (tokens * len(by_sequence))


def test_documents_are_packed_whole(docs, odd):
    both = docs.select("doc_id", "text").union(odd.select("doc_id", "text"))
    rows = packing.pack_documents(both, vocabulary("byte_bpe_50k.json"), 1).collect()
    assert check_packed(rows, [(r["doc_id"], r["text"]) for r in both.collect()]) > 0.95
    assert packing.pack_documents(both.where("false"), vocabulary("byte_bpe_50k.json"), 1).count() == 0


def test_instruction_data_keeps_three_limits(spark):
    turns = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    examples = packing.conversation_examples(turns, vocabulary("byte_bpe_50k.json"), 1)
    placed = packing.place(examples, 1024, 6, 512).toPandas()
    sums = placed.groupby("sequence_id").agg(n=("length", "size"), t=("length", "sum"), s=("loss_tokens", "sum"))
    assert len(placed) == examples.count()
    assert ((sums.n == 1) | ((sums.t <= 1024) & (sums.n <= 6) & (sums.s <= 512))).all()


def test_sequences_are_assembled(spark):
    placed = spark.createDataFrame([(1, 0, 3, 10, 0), (2, 0, 2, 10, 3)], "doc_id long, start long, length long, sequence_id long, offset long")
    ids = spark.createDataFrame([(1, 0, [5, 6, 7]), (2, 0, [8, 9])], "doc_id long, start long, ids array<long>")
    row = packing.sequence_tensors(placed, ids, 8, 0).first()
    assert row["input_ids"] == [5, 6, 7, 8, 9, 0, 0, 0] and row["segments"] == [0, 0, 0, 1, 1, -1, -1, -1]


def greedy(word, pieces):
    at, n, text = 0, 0, wordpiece.MARK + word
    while at < len(text):
        end = next((e for e in range(len(text), at, -1) if text[at:e] in pieces), None)
        if end is None:
            return 0
        at, n = end, n + 1
    return n


@settings(max_examples=200, deadline=None)
@given(st.sets(st.text("abc", min_size=1, max_size=4), max_size=12), st.lists(st.text("abcd", max_size=10), max_size=10))
def test_automaton_is_greedy_longest_match(inner, words):
    pieces = {*inner, *(wordpiece.MARK + p for p in list(inner)[:5]), wordpiece.MARK}
    automaton = wordpiece.Automaton(sorted(pieces))
    assert [automaton.count(w) for w in words] == [greedy(w, pieces) for w in words]


def test_token_counts_equal_brute_force(docs, odd):
    both = docs.select("doc_id", "text").union(odd.select("doc_id", "text"))
    path = vocabulary("piece_bpe_32k.model")
    pieces, known, want = set(wordpiece.vocabulary(path)), {}, []
    for r in both.collect():
        found = [w.decode() for w in (r["text"] or "").encode().split()]
        n = [known.setdefault(w, None) or known.__setitem__(w, greedy(w, pieces)) or known[w] for w in found]
        want.append((r["doc_id"], len(n), sum(n) + n.count(0), n.count(0)))
    got = [tuple(r) for r in wordpiece.count_tokens(both, path).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("n", [1, 2, 3, 16, 17, 1000, 4097])
def test_permutation_is_a_bijection_with_an_inverse(n):
    x = np.arange(n)
    y = sharding.permute(x, n, 5)
    assert sorted(y.tolist()) == x.tolist() and (sharding.permute(y, n, 5, inverse=True) == x).all()


def test_shards_are_even_gapless_and_computable(docs, odd, tmp_path):
    both = docs.select("doc_id", "text").union(odd.select("doc_id", "text"))
    rows = sharding.shard_documents(both).collect()
    n = both.count()
    assert sorted(r["row"] for r in rows) == list(range(n)) and len(rows) == n
    slots = {}
    for r in rows:
        slots.setdefault(r["shard"], []).append(r["slot"])
        assert sharding.row_at(r["shard"], r["slot"], n, 24, 20_240_229) == r["row"]
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    order = [r["doc_id"] for r in sorted(rows, key=lambda r: r["row"])]
    assert order[0] is None and order[1:] == sorted(order[1:])
    sizes = {r["doc_id"]: r["size"] for r in rows}
    assert sizes[90_900] == 8 and sizes[90_903] == 11
    sharding.write_shards(odd, str(tmp_path / "shards"), 4)
    back = odd.sparkSession.read.parquet(str(tmp_path / "shards"))
    assert sorted(str((r["doc_id"], r["text"])) for r in back.collect()) == sorted(str((r["doc_id"], r["text"])) for r in odd.collect())
    assert sharding.shard_documents(both.where("false")).count() == 0
