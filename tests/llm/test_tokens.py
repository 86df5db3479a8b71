"""Token counts, packing and byte BPE against the libraries."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest

from terravane.llm import byte_bpe, packing, token_counts
from terravane.llm.word_bpe import WordBpe

WORDS, BYTES = P.path("word_bpe_49k.json"), P.path("byte_bpe_multi_50k.tiktoken")
TEXTS = [
    None, "", " ", "Hello, world!", "it's 12 o'clock 'S", "ΑΣ Σ İstanbul ß é é ǅ", "a<|endoftext|>b <|startoftext|> <|STARTOFTEXT|>",
    "x\x1cy \x1d z\x85w\xa0v", "tab\tnew\nline \n  two  spaces   three    ", "\n \n a", " \n\n  b  ", "aaaa" * 300, "ab" * 5000, "日本語のテキスト 🎉🎉 ﬁ",
    "x " * 5000, "!!! ... ###", "don't can't we'll I'm you've he'd they're", "مرحبا बहुत ไทย", "1234567890 ²Ⅷ½", "\u03a9\u0301\u0345 \u038f\u0345", " leading", "trailing ", "a \n", "a  \n b\n \nc",
]


def frame(spark, texts=TEXTS):
    return spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, length string")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORDS)


@pytest.fixture(scope="module")
def ranks():
    import base64

    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(BYTES, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=table, special_tokens={})


def test_counts_equal_the_library(spark, library):
    got = {r.doc_id: r for r in token_counts.token_counts(frame(spark), WORDS, limit=100).collect()}
    for k, t in enumerate(TEXTS):
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert (got[k].n_tokens, got[k].n_bytes, got[k].over_limit) == (n, len((t or "").encode()), n > 100), t


def test_shortcut_is_proven():
    bpe = WordBpe(WORDS)
    whole = token_counts.whole_tokens(bpe)
    assert len(whole) > 30_000
    assert all(len(bpe.tokens(w)) == 1 for w in random.Random(1).sample(sorted(whole), 500))


def test_long_merge_equals_short(library):
    bpe, r = WordBpe(WORDS), random.Random(2)
    for _ in range(30):
        word = "".join(r.choice("abcde") for _ in range(r.randint(65, 300)))
        assert [bpe.vocab[x] for x in bpe.tokens(word)] == library.encode(word, add_special_tokens=False).ids


def test_byte_bpe_equals_the_library(spark, ranks):
    got = {r.doc_id: r for r in byte_bpe.round_trip(frame(spark), BYTES, P.PATTERN).collect()}
    ids = {r.doc_id: r.ids for r in byte_bpe.encode(frame(spark), BYTES, P.PATTERN).collect()}
    for k, t in enumerate(TEXTS):
        want = ranks.encode_ordinary(t or "")
        assert ids[k] == want, t
        sha = hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
        assert (got[k].n_tokens, got[k].ids_sha256, got[k].decoded_sha256) == (len(want), sha, hashlib.sha256((t or "").encode()).hexdigest())


def test_byte_bpe_decodes(spark):
    back = byte_bpe.decode(byte_bpe.encode(frame(spark), BYTES, P.PATTERN), BYTES, P.PATTERN)
    assert {r.doc_id: r.text for r in back.collect()} == {k: t or "" for k, t in enumerate(TEXTS)}


def test_queue_equals_the_library_on_random_words(ranks):
    bpe, r = byte_bpe.byte_bpe(BYTES, P.PATTERN), random.Random(3)
    for _ in range(300):
        word = "".join(r.choice("aabbcdeéthin") for _ in range(r.randint(1, 80)))
        assert bpe.word(word) == ranks.encode_ordinary(word)


def test_queues_equal_the_library_whatever_the_ranks(tmp_path):
    """Merged tokens may rank before what they are made of, as in 'ab' after 'abc'."""
    import base64

    import tiktoken

    r = random.Random(6)
    for _ in range(4):
        longer = sorted({bytes(r.choice(b"abc") for _ in range(r.randint(2, 5))) for _ in range(40)})
        r.shuffle(longer)
        table = {b: k for k, b in enumerate([bytes([x]) for x in range(256)] + longer)}
        path = tmp_path / f"{r.random()}.tiktoken"
        path.write_bytes(b"\n".join(base64.b64encode(b) + b" %d" % k for b, k in table.items()))
        own, library = byte_bpe.ByteBpe(str(path), P.PATTERN), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=table, special_tokens={})
        words = ["".join(r.choice("abc") for _ in range(r.randint(1, 90))) for _ in range(200)]
        want = [library.encode_ordinary(w) for w in words]
        assert [own.word(w) for w in words] == want
        assert [own.encode_words(words)[w] for w in words] == want


def check_packing(rows, pieces, capacity):
    assert sorted((r.doc_id, r.piece) for r in rows) == sorted(pieces)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing(spark, library):
    rows = packing.packed(frame(spark), WORDS, capacity=64).collect()
    want = {}
    for k, t in enumerate(TEXTS):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        for p, at in enumerate(range(0, len(ids), 64)):
            part = ids[at : at + 64]
            want[k, p] = (at, len(part), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part)))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want
    n = check_packing(rows, list(want), 64)
    assert n >= -(-sum(x[1] for x in want.values()) // 64)


def test_packed_sequences_hold_their_ids(spark, library):
    texts = [*TEXTS, TEXTS[0], "a further text"]
    rows = packing.packed(frame(spark, texts), WORDS, capacity=64).collect()
    by = {}
    for r in rows:
        assert len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32
        by.setdefault(r.sequence_id, []).append(r)
    built = {s: np.frombuffer(b"".join(r.ids for r in sorted(parts, key=lambda r: r.offset)), "<u4").tolist() for s, parts in by.items()}
    assert all(0 < len(x) <= 64 for x in built.values())
    docs = {}
    for r in sorted(rows, key=lambda r: r.start):
        docs.setdefault(r.doc_id, []).extend(built[r.sequence_id][r.offset : r.offset + r.length])
    assert docs == {k: [*library.encode(t or "", add_special_tokens=False).ids, 0] for k, t in enumerate(texts)}


def test_packing_of_nothing(spark):
    assert packing.packed(frame(spark, []).limit(0), WORDS).collect() == []


def fewest(lengths, capacity):
    """Brute force: the least number of sequences."""
    best = len(lengths)

    def place(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(lengths):
            best = len(rooms)
            return
        for r in {*rooms}:
            if r >= lengths[k]:
                rest = list(rooms)
                rest[rest.index(r)] -= lengths[k]
                place(k + 1, rest)
        place(k + 1, [*rooms, capacity - lengths[k]])

    place(0, [])
    return best


def test_reduction_keeps_an_optimum():
    r = random.Random(4)
    for _ in range(150):
        lengths = sorted((r.randint(1, 20) for _ in range(r.randint(1, 9))), reverse=True)
        fixed, left = packing.reduced(Counter(lengths), 20)
        rest = sorted((s for s, n in left.items() for _ in range(n)), reverse=True)
        assert sum(p.times for p in fixed) + fewest(rest, 20) == fewest(lengths, 20), lengths


def test_plan_places_every_piece():
    r = random.Random(5)
    for _ in range(50):
        count = Counter(r.randint(1, 100) for _ in range(r.randint(1, 2000)))
        found = Counter()
        for p in packing.plan(count, 100):
            assert sum(p.lengths) <= 100
            for s in p.lengths:
                found[s] += p.times
        assert found == count


def every_character():
    """Texts with every code point in three contexts, some hundred to a text; what the libraries think of each shows."""
    alike = (range(0x3400, 0xA000), range(0xAC00, 0xD7A4), range(0xE000, 0xF900), range(0x17000, 0x18D00), range(0x20000, 0xE0000), range(0xE0200, 0x110000))
    points = (*range(0xD800), *range(0xE000, 0x110000))
    used = [chr(c) for c in points if c % 97 == 0 or not any(c in r for r in alike)]  # of ideographs, Hangul, private and unassigned planes some
    for k in range(0, len(used), 200):
        part = used[k : k + 200]
        yield " ".join(f"ab{c}cd 1{c}2 {c}'s" for c in part)
        yield "".join(f"x {c}'s{c}e\u0301{c} " for c in part)


def test_every_character_counts_as_the_library_has_it(library):
    c = token_counts.counter(WORDS)
    texts = list(every_character())
    for t, e in zip(texts, library.encode_batch_fast(texts, add_special_tokens=False)):
        assert c.count(t) == len(e.ids), t


def test_every_character_packs_as_the_library_has_it(library):
    texts = list(every_character())
    e = packing.encoder(WORDS)
    for k in range(0, len(texts), 256):
        part = texts[k : k + 256]
        for t, b, x in zip(part, e.encode(part), library.encode_batch_fast(part, add_special_tokens=False)):
            assert np.frombuffer(b, "<u4").tolist() == x.ids, t


def test_every_character_splits_as_the_library_has_it(ranks):
    bpe = byte_bpe.byte_bpe(BYTES, P.PATTERN)
    for t in every_character():
        bpe.remember([t])
        want = ranks.encode_ordinary(t)
        assert bpe.digests(t)[:2] == (len(want), hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()), t


@pytest.mark.parametrize("run", [lambda d: token_counts.token_counts(d, WORDS), lambda d: packing.packed(d, WORDS), lambda d: byte_bpe.round_trip(d, BYTES, P.PATTERN)])
def test_odd_tables(spark, run):
    """Nulls in any column, empty and long texts, repeated rows, clashing columns, and no rows at all."""
    from edge import ODD, documents

    rows = run(documents(spark, ODD)).collect()
    assert {r.doc_id for r in rows} == {k for k, _ in ODD}
    per = Counter(r.doc_id for r in rows if getattr(r, "piece", 0) == 0)
    assert per == Counter(k for k, _ in ODD)  # rows that repeat give rows that repeat
    assert run(documents(spark, []).limit(0)).collect() == []
