import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from learnmart.llm import packing as P


def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def check(rows, docs):
    """``rows`` hold every id of ``docs`` (id, text) once, in sequences without gaps."""
    t = tokenizer()
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    want = defaultdict(int)
    for doc, text in docs:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        for at in range(0, len(ids), 1024):
            want[doc, at, len(ids[at:at + 1024]), crc(ids[at:at + 1024]), len(ids)] += 1
    got, sequences = defaultdict(int), defaultdict(list)
    for r in rows:
        got[r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens] += 1
        sequences[r.sequence_id].append(r)
    assert got == want
    for pieces in sequences.values():
        pieces.sort(key=lambda r: r.offset)
        assert [r.offset for r in pieces] == np.cumsum([0, *[r.length for r in pieces]])[:-1].tolist()
        used = sum(r.length for r in pieces)
        assert used <= 1024 and {r.padded_length for r in pieces} == {used if used & (used - 1) == 0 else 1024}
    used = sum(r.length for r in rows)
    return sum(p[0].padded_length for p in sequences.values()) / used if rows else 1


def test_query(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert check(P.op3_packing(spark, sf_dir).collect(), docs) < 1.02


def test_odd_rows(odd_docs, odd_rows, no_docs):
    check(P.pack(odd_docs).collect(), [r[:2] for r in odd_rows])
    check(P.pack(odd_docs, group_pieces=2).collect(), [r[:2] for r in odd_rows])
    assert P.pack(no_docs).count() == 0


def test_parts_of_a_long_text_give_the_same_ids():
    t, path = tokenizer(), public_tokenizers.path(P.RANKS)
    text = "Some  words, élan 12 \n\n and <|endoftext|> more's  the pity 🎉 x y. " * 300
    parts = list(P.text_parts(text, 100))
    assert "".join(parts) == text and len(parts) > 50
    whole = t.encode(text, add_special_tokens=False).ids
    added = P.added_tokens(public_tokenizers.path(P.TOKENIZER))
    assert P.token_ids(text, path, added).tolist() == whole and 50256 in whole
    assert [i for p in parts for i in P.token_ids(p, path, added).tolist()] == whole


def test_end_marks_in_texts_are_one_id(spark):
    mark = "<|endoftext|>"
    texts = [mark, f"{mark}a b", f"a {mark} b", f"a b{mark}", f"a{mark}{mark}b's {mark[:-1]}", f"  {mark}  x", f"word {mark} " * 40_000, "<|endoftext |>"]
    check(P.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect(), list(enumerate(texts)))
    t, path, added = tokenizer(), public_tokenizers.path(P.RANKS), P.added_tokens(public_tokenizers.path(P.TOKENIZER))
    rng = np.random.default_rng(1)
    signs = [mark, "<|", "|>", "endoftext", " ", "\n", "a", " the", "é", "7", "'s", "🎉"]
    for _ in range(500):
        text = "".join(signs[i] for i in rng.integers(0, len(signs), 40))
        assert P.token_ids(text, path, added).tolist() == t.encode(text, add_special_tokens=False).ids
        assert [i for p in P.text_parts(text, 20) for i in P.token_ids(p, path, added).tolist()] == P.token_ids(text, path, added).tolist()


def test_best_fit_is_that_of_a_plain_search():
    rng = np.random.default_rng(3)
    lengths = np.concatenate([rng.integers(1, 64, 400), np.full(30, 32)])
    place, offset = P.best_fit(lengths, 64)
    rooms: list[int] = []
    for i in np.argsort(-lengths, kind="stable"):
        fits = [r for r in rooms if r >= lengths[i]]
        assert (64 - offset[i]) == (min(fits) if fits else 64)
        if fits:
            rooms.remove(min(fits))
        rooms.append((min(fits) if fits else 64) - int(lengths[i]))
    assert len(rooms) == place.max() + 1
