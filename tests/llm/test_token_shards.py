"""Added tokens of the tokenizer in other spellings."""

from __future__ import annotations

import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from shelfwise.llm import token_shards


def test_added_tokens_in_other_cases():
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = [
        "<|ENDOFTEXT|>", "A <|EndOfText|>. B", "x<|endoftext|>Y", "<|STARTOFTEXT|>  <|startoftext|> Word, WORD", "PLAIN Text. <|END", None,
        "É <|ENDOFTEXT|> é", "<|endOFtext|>\nThe END.",
    ]
    ids, sizes = token_shards.encode_texts(tokenizer, texts)
    at = 0
    for t, n in zip(texts, sizes.tolist(), strict=True):
        assert ids[at : at + n].tolist() == tokenizer.encode(t or "", add_special_tokens=False).ids
        at += n
    assert at == len(ids)
    assert tokenizer.encode("<|ENDOFTEXT|>", add_special_tokens=False).ids != tokenizer.encode("<|endoftext|>", add_special_tokens=False).ids


def test_lower_casing_is_kept_for_other_texts():
    assert token_shards._pieces(pa.array(["The END", "<|End|> X"]), ["<|end|>"]).to_pylist() == [["the", "end"], ["<|End|>", "X"]]


def test_null_and_repeated_keys(spark, tmp_path):
    """Null keys come first, rows of one key in the order of their texts' hashes; nothing is written for an empty table."""
    rows = [(5, "one two"), (None, "no key"), (5, "three"), (None, None), (5, "one two"), (-3, ""), (2, "x " * 50_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    file = public_tokenizers.path("word_bpe_49k.json")
    token_shards.write_shards(docs, str(tmp_path / "s"), file, shard_tokens=7)
    found = token_shards.read_documents(spark, str(tmp_path / "s")).orderBy("start").collect()
    sizes = [len(Tokenizer.from_file(file).encode(t or "", add_special_tokens=False).ids) + 1 for _, t in rows]
    assert [r.doc_id for r in found] == [None, None, -3, 2, 5, 5, 5] and sorted(r.n_tokens for r in found) == sorted(sizes)
    assert [r.start for r in found] == [sum(r.n_tokens for r in found[:i]) for i in range(len(found))]
    token_shards.write_shards(docs.limit(0), str(tmp_path / "e"), file)
    assert spark.read.schema("part int, seq int, n_tokens long, shard binary").parquet(str(tmp_path / "e")).count() == 0


def test_counts_are_in_the_file():
    import numpy as np

    ids = np.random.default_rng(3).integers(0, 49_000, 3000).astype(np.uint32)
    matrix = token_shards.WaveletMatrix.build(ids)
    shard = token_shards.Shard(np.array([1]), np.array([True]), np.array([3000]), matrix)
    back = token_shards.Shard.from_bytes(shard.to_bytes()).matrix
    assert all(np.array_equal(a, b) for a, b in zip(matrix.ones, back.ones, strict=True)) and len(back.ones) == len(back.planes)
    assert np.array_equal(back.decode(), ids) and [back.access(i) for i in (0, 511, 512, 2999)] == ids[[0, 511, 512, 2999]].tolist()
    assert back.count(int(ids[7])) == int((ids == ids[7]).sum())


def test_known_pieces_are_not_encoded_again(monkeypatch):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = [["one two thrree", None, "two foour, FIVE"], ["two three one", "", "five!! two"], ["six", "two one two"], ["two \x01 x", "six one"]]
    asked = []
    for most in (1, 4, token_shards.KEPT_PIECES):
        monkeypatch.setattr(token_shards, "KEPT_PIECES", most)
        encoder = token_shards.Encoder(tokenizer)
        joined = encoder._joined
        monkeypatch.setattr(encoder, "_joined", lambda pieces, joined=joined: asked.append(list(pieces)) or joined(pieces))
        for batch in texts * 2:
            asked.clear()
            ids, sizes = encoder.encode(pa.array(batch))
            want = [tokenizer.encode(t or "", add_special_tokens=False).ids for t in batch]
            assert ids.tolist() == [i for w in want for i in w] and sizes.tolist() == [len(w) for w in want]
            assert len(encoder.known) == len(encoder.sizes) == len(encoder.starts) and len(encoder.flat) == encoder.sizes.sum()
    assert asked == [[]]  # the second time nothing was new


def test_workers_read_models_once():
    from shelfwise.llm import sampled_segmentation

    file = public_tokenizers.path("piece_bpe_32k.model")
    assert sampled_segmentation.worker_pieces(file) is sampled_segmentation.worker_pieces(file)
    file = public_tokenizers.path("word_bpe_49k.json")
    assert token_shards.worker_encoder(file) is token_shards.worker_encoder(file)


def test_words_of_latin_letters_skip_the_normalizer():
    """Every Latin letter in both cases, and letters that are lower-cased or composed to others, have the ids of the whole tokenizer."""
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    encoder = token_shards.Encoder(tokenizer)
    assert encoder.bare is not None
    asked = []
    whole = encoder._ids
    encoder._ids = lambda texts, bare=False: (None if bare else asked.extend(texts)) or whole(texts, bare)
    words = [x for c in map(chr, range(0x41, 0x250)) if token_shards.LATIN.fullmatch(c) for x in (c, f"Wor{c}d", f"{c}{c}x")]
    encoder.encode(pa.array([" ".join(words)]))
    assert asked == []
    odd = ["İstanbul", "été", "ΣΑΣ", "ﬁn", "ªºµ", "x×y", "Ångström", "a­b", "don't", "IT'S"]
    for text in [" ".join(words), *words, *odd]:
        assert encoder.encode(pa.array([text]))[0].tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_planes_follow_the_ids_that_occur():
    import numpy as np

    ids = np.array([49_000, 3, 49_000, 49_000, 40_000, 3, 49_000] * 300, np.uint32)
    matrix = token_shards.WaveletMatrix.build(ids)
    assert len(matrix.planes) == 2 and matrix.symbols.tolist() == [49_000, 3, 40_000]  # not one for each of the 16 bits of 49,000
    assert matrix.decode().tolist() == ids.tolist() and [matrix.access(i) for i in range(7)] == ids[:7].tolist()
    assert matrix.occurrences(40_000) == np.flatnonzero(ids == 40_000).tolist() and matrix.count(0) == matrix.count(49_001) == 0
    far = np.array([1 << 31, 7, 1 << 31], np.uint32)
    assert token_shards.WaveletMatrix.build(far).decode().tolist() == far.tolist()
    one = token_shards.WaveletMatrix.build(np.array([5, 5], np.uint32))
    assert one.planes == [] and one.decode().tolist() == [5, 5] and one.select(5, 1) == 1 and one.count(4) == 0
