import zlib
from collections import Counter
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
import pytest

from tracewarden.llm import huffman

public_tokenizers = pytest.importorskip("public_tokenizers")
Tokenizer = pytest.importorskip("tokenizers").Tokenizer
PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    "", "a  b", "x\n y", "x \ny", "  lead", "trail  ", "a <|endoftext|> b", "é  x", "　 a", "a\tb c\n\n d", "it's 'll don't",
    " a", " ", "\n", " \n x", "a\x1c b", "日本 語", "x\x85 y", "x​ y", "a 1 2,3 !", "word" * 40, "é ½ Ⅷ 𝒳 🙂 x", "a\n", "ab\ncd",
]


@pytest.mark.parametrize("n", [1, 2, 3, 50, 3000])
def test_codes(n):
    rng = np.random.default_rng(n)
    lengths = huffman.code_lengths((rng.pareto(1, n) * 10).astype(int) + 1, 16)
    assert lengths.max() <= 16
    assert n == 1 or sum(2.0 ** -int(x) for x in lengths) == 1
    ids = rng.integers(0, n, 1000).astype(np.uint32)
    docs = [ids[:300], ids[300:301], ids[301:]]
    coded = huffman.packed(docs, huffman.codes(lengths), lengths, 64)
    data = huffman.frame(7, [(i or None, len(d), *c) for i, (d, c) in enumerate(zip(docs, coded, strict=True))], 64)
    first, names, back = huffman.read_frame(data, huffman.decoding_table(lengths, 16))
    assert (first, names) == (7, [None, 1, 2])
    assert all((x == y).all() for x, y in zip(docs, back, strict=True))


def test_length_limit_is_optimal():
    counts = np.array([1, 1, 2, 3, 5, 8, 13, 21, 34, 55])
    free, held = huffman.code_lengths(counts, 16), huffman.code_lengths(counts, 5)
    assert free.max() == 9 and held.max() == 5
    # The best of all length vectors that a prefix code can have, the longest for the rarest.
    best = min(
        int((np.array(x[::-1]) * counts).sum())
        for x in combinations_with_replacement(range(1, 6), len(counts))
        if sum(2.0**-n for n in x) <= 1
    )
    assert (free * counts).sum() < (held * counts).sum() == best
    with pytest.raises(ValueError):
        huffman.code_lengths(np.ones(5, dtype=int), 2)


def test_encoder_is_the_tokenizer():
    library, own = Tokenizer.from_file(PATH), huffman.Encoder(PATH)
    for texts in (ODD, ODD[::-1], *[[t] for t in ODD], ODD * 2):
        expected = [library.encode(t, add_special_tokens=False).ids + [0] for t in texts]
        assert [x.tolist() for x in own.encode(texts)] == expected


def test_long_texts_are_cut_between_words(monkeypatch):
    library, own = Tokenizer.from_file(PATH), huffman.Encoder(PATH)
    text = " ".join(["some words,", "don't", "a  b", "line\nline", "é 12", "<|endoftext|>", "x \n y", "tail "] * 9)
    for size in (1, 7, 50):
        monkeypatch.setattr(huffman, "CHARS", size)
        assert "".join(huffman.cut_at_words(text, size)) == text
        texts = ["ab", text, "", " ", text[:20], "x" * 100]
        expected = [library.encode(t, add_special_tokens=False).ids + [0] for t in texts]
        assert [x.tolist() for x in own.encode(texts)] == expected


@pytest.mark.parametrize("parts", [1, 5])
def test_edges(edge_documents, parts):
    library = Tokenizer.from_file(PATH)
    rows = [(r.doc_id, r.text or "") for r in edge_documents.collect()]
    got = huffman.round_trip(edge_documents, PATH, parts=parts, step=16, block=500).collect()
    ids = {t: np.array(library.encode(t, add_special_tokens=False).ids + [0], dtype="<u4") for _, t in rows}
    expected = Counter((d, len(ids[t]), zlib.crc32(ids[t].tobytes())) for d, t in rows)
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == expected
    got.sort(key=lambda r: r.start)
    keys = [(r.doc_id is not None, r.doc_id or 0) for r in got]
    assert keys == sorted(keys)
    assert [r.start for r in got] == list(np.cumsum([0] + [r.n_tokens for r in got])[:-1])


def test_empty(no_documents):
    assert huffman.round_trip(no_documents, PATH).collect() == []


def test_latin_words_need_no_pattern():
    """The library's merges alone encode words of Latin letters, numbers and signs."""
    library, own = Tokenizer.from_file(PATH), huffman.Encoder(PATH)
    batches = []

    class Spy:
        def encode_batch_fast(self, words, **options):
            batches.append(words)
            return library.encode_batch_fast(words, **options)

    own.tokenizer = Spy()
    texts = ["some words, Straße ÿ 12 +-;\nline ɏɐ", "日本 ΩΣ x", "same words, x", "xƀy ¶ ½²"]
    expected = [library.encode(t, add_special_tokens=False).ids + [0] for t in texts]
    assert [x.tolist() for x in own.encode(texts)] == expected
    assert sorted(w for b in batches for w in b) == sorted([" ɏɐ", "日本", " ΩΣ"])


def test_merges_take_many_words_in_a_call(monkeypatch):
    """Latin words reach the library's merges in runs, and a known word never again."""
    library, own = Tokenizer.from_file(PATH), huffman.Encoder(PATH)
    calls, merges = [], own.merges
    own.merges = lambda signs: calls.append(signs) or merges(signs)
    rng = np.random.default_rng(3)
    texts = [" ".join(f"{chr(97 + x % 26)}é{x}," for x in rng.integers(0, 500, 300).tolist()) for _ in range(8)]
    expected = [library.encode(t, add_special_tokens=False).ids + [0] for t in texts]
    monkeypatch.setattr(huffman, "CHARS", 700)
    monkeypatch.setattr(huffman, "LEARNT", 64)
    for some in (slice(0, 5), slice(3, 8), slice(0, 8)):
        assert [x.tolist() for x in own.encode(texts[some])] == expected[some]
    known = own.words.to_pylist()
    assert len(known) == len(set(known)) > 500
    assert len(calls) <= len(known) / huffman.MERGED + 4
    monkeypatch.setattr(huffman, "CACHE", 10)
    assert [x.tolist() for x in own.encode(texts[:1])] == expected[:1]
    assert len(own.words) < len(known)


def test_stop_is_in_no_merge():
    signs = huffman.byte_signs()
    assert sorted(map(chr, signs)) == sorted({s for s in Tokenizer.from_file(PATH).get_vocab() if len(s) == 1})
    alone = {chr(s): i for i, s in enumerate(signs.tolist())}
    zero, one = chr(signs[0]), chr(signs[1])
    assert huffman.free_sign(alone, signs) == zero
    assert huffman.free_sign({**alone, "a" + zero: 256}, signs) == one
    controls = "".join(chr(signs[b]) for b in range(32) if b != 10)
    assert huffman.free_sign({**alone, controls: 256}, signs) is None


def test_merges_that_take_up_control_bytes(tmp_path):
    """Texts come out as by the library, whatever bytes its merges take up."""
    from tokenizers import models, pre_tokenizers

    signs = [chr(s) for s in huffman.byte_signs()]
    texts = ["ab ab, é ab\nx", "a\x00b ab", "日本 ab"]
    for taken in (1, 32):
        vocabulary = {s: i for i, s in enumerate(signs)} | {"ab": 256}
        merges = [("a", "b")]
        for i, s in enumerate(signs[:taken]):
            vocabulary["b" + s] = 257 + i
            merges.insert(0, ("b", s))
        library = Tokenizer(models.BPE(vocabulary, merges))
        library.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False)
        library.save(str(tmp_path / "some.json"))
        own = huffman.Encoder(str(tmp_path / "some.json"))
        assert own.stop == (signs[1] if taken == 1 else None)
        expected = [library.encode(t, add_special_tokens=False).ids + [0] for t in texts]
        assert [x.tolist() for x in own.encode(texts)] == expected


@pytest.mark.parametrize("lump", [1, 3000, 1 << 40])
def test_lumps(edge_documents, lump, monkeypatch):
    """Documents are encoded in lumps of whole rows, and none is lost between them."""
    library = Tokenizer.from_file(PATH)
    texts = [r.text or "" for r in edge_documents.collect()]
    monkeypatch.setattr(huffman, "LUMP", lump)
    sizes = [len(t.encode()) for t in texts]
    batch = pa.RecordBatch.from_pydict({"text": texts})
    lumps = list(huffman.lumps(batch))
    assert [t for x in lumps for t in x["text"].to_pylist()] == texts
    for x in lumps:
        assert x.num_rows and sum(len(t.encode()) for t in x["text"].to_pylist()) <= lump + max(sizes)
    assert [x.num_rows for x in huffman.lumps(batch.slice(0, 0))] == []
    docs = {t: library.encode(t, add_special_tokens=False).ids + [0] for t in set(texts)}
    got = [x.tolist() for y in lumps[:5] for x in huffman.Encoder(PATH).encode(y["text"].to_pylist())]
    assert got == [docs[t] for t in texts[: len(got)]]
