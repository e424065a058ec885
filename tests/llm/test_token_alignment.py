"""Token alignment against the two libraries and plain loops, and its minimal perfect hash."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from caseloom.llm import token_alignment as ta
from caseloom.llm.common import encode_joined
from tests.llm.cases import awkward_docs, empty_docs

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SPECIAL = ["<|endoftext|>", "a <s> b </s> <unk> <0x41>", "▁", "a▁b", "tab\t tab \t x", "a   b  \n\n  c ", " ", "  ", "\n \n", "x   y  z\u0085 w", "\x1c \x1c᠎ ​ q"]


def by_hand(texts):
    """Rows without ids for whole texts, from the libraries on whole texts."""
    one, two = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    one.encode_special_tokens = True
    alphabet = ta.byte_alphabet()
    docs = []
    for text in texts:
        raw = (" " + (text or "")).encode()
        a = one.encode(raw.decode(), add_special_tokens=False).ids
        b = two.encode(text or "")
        sides = []
        for ids, of in ((a, lambda i: bytes(alphabet[c] for c in one.id_to_token(i))), (b, lambda i: bytes([int(two.id_to_piece(i)[3:5], 16)]) if two.is_byte(i) else two.id_to_piece(i).replace("▁", " ").encode())):
            at, spans = 0, []
            joined = b"".join(map(of, ids))
            for i in ids:
                at += len(of(i))
                spans.append((at, i))
            sides.append((joined, spans))
        if not text or any(joined != raw for joined, _ in sides):
            docs.append(None)
            continue
        ends = sorted({e for e, _ in sides[0][1]} & {e for e, _ in sides[1][1]})
        groups, start = [], 0
        for end in ends:
            groups.append(tuple([i for e, i in spans if start < e <= end] for _, spans in sides))
            start = end
        docs.append(groups)
    held = Counter(pair for groups in docs if groups for pair in {(a, b) for x, y in groups for a in x for b in y})
    best = defaultdict(int)
    for (a, _), n in held.items():
        best[a] = max(best[a], n)
    out = []
    for groups in docs:
        links = [(a, b) for x, y in groups or [] for a in x for b in y]
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups or [])
        out.append(
            (sum(len(x) for x, _ in groups or []), sum(len(y) for _, y in groups or []), len(groups or []), len(links),
             sum(held[p] == best[p[0]] for p in links), sum(held[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if groups else "")
        )
    return out


@pytest.mark.parametrize("shard", [ta.SHARD, 300])
def test_alignment(spark, shard):
    rng = random.Random(shard)
    odd = ["".join(rng.choice("   \n\t ab-'sß é😀the.9▂") for _ in range(rng.randint(0, 60))) for _ in range(150)]
    frame = awkward_docs(spark)
    extra = spark.createDataFrame([(100 + i, t) for i, t in enumerate(SPECIAL + odd + odd[:5])], "doc_id long, text string")
    frame = frame.unionByName(extra, allowMissingColumns=True).repartition(3)
    rows = frame.collect()
    want = [(r.doc_id, *w) for r, w in zip(rows, by_hand([r.text for r in rows]))]
    got = ta.align(frame, A, B, shard).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_empty(spark):
    assert ta.align(empty_docs(spark), A, B).count() == 0
    null = ta.align(spark.createDataFrame([(1, None)], "doc_id long, text string"), A, B).collect()
    assert [tuple(r) for r in null] == [(1, 0, 0, 0, 0, 0, 0, "")]


def test_wide_groups(monkeypatch):
    """Links of groups too wide to list, and of listed slices, are those of plain loops."""
    rng = np.random.default_rng(2)
    a_length, b_length = np.array([1, 2, 3]), np.array([1, 2, 5])
    docs = []
    for _ in range(30):
        a = rng.integers(0, 3, rng.integers(0, 40))
        total, b = int(a_length[a].sum()), []
        while total:
            b.append(int(rng.choice([i for i in range(3) if b_length[i] <= total])))
            total -= b_length[b[-1]]
        docs.append((a, np.array(b, np.int64)))
    one, two = zip(*docs)
    sizes = [np.array([len(x) for x in side]) for side in (one, two)]
    whole = ta.Groups(np.concatenate(one), np.concatenate(two), *sizes, a_length, b_length)
    want = whole.links(9, 3)
    plain = Counter()
    for g in range(len(whole.doc)):
        for a in whole.a[whole.a_start[g] : whole.a_start[g + 1]]:
            for b in whole.b[whole.b_start[g] : whole.b_start[g + 1]]:
                plain[int(whole.doc[g] * 9 + a * 3 + b)] += 1
    assert dict(zip(*map(np.ndarray.tolist, want))) == plain
    monkeypatch.setattr(ta, "CELLS", 4)
    monkeypatch.setattr(ta, "LINKS", 7)
    for x, y in zip(whole.links(9, 3), want):
        assert (x == y).all()


def test_perfect_hash():
    rng = np.random.default_rng(5)
    keys = np.unique(rng.integers(0, 50_000 * 32_000, 60_000))
    bucket = ta.bucket_of(keys // 32_000)
    half = {b: ta.hash_levels(keys[bucket == b]) for b in range(0, ta.BUCKETS, 2)}
    table = ta.PairHash(32_000, half)
    own = keys[bucket % 2 == 0]
    assert sorted(table.of(own).tolist()) == list(range(len(own))) and table.n == len(own)
    stored = np.zeros(table.n, np.int64)
    stored[table.of(own)] = own
    assert (stored[table.verified(own, stored)] == own).all()
    with pytest.raises(ValueError):
        table.verified(np.setdiff1d(np.arange(1000, dtype=np.int64), own), stored)
    bits = sum(64 * len(w) for levels in half.values() for w in levels)
    assert bits < 5 * len(own)


def test_new_runs_share_texts_of_the_library(monkeypatch):
    """Runs are encoded many to a text, and each has the ids that it has by itself."""
    rng = random.Random(8)
    words = list({"".join(rng.choices("abcdeé9'.-", k=rng.randint(1, 9))) for _ in range(3000)}) + ["", "x\n", " y", "\nz", "a  b", "<s>", "\x85", "\xa0q"]
    rng.shuffle(words)
    work, asked = ta.Aligner(A, B), []
    a_ids, b_each = work._a_ids, work.codec._each
    monkeypatch.setattr(work, "_a_ids", lambda runs: asked.extend(runs) or a_ids(runs))
    monkeypatch.setattr(work.codec, "_each", lambda runs: asked.extend(runs) or b_each(runs))
    got = work._new(words)
    assert len(asked) < len(words) / 20
    assert got == [work._new([w])[0] for w in words]


def test_joined_runs_that_do_not_fit_are_encoded_alone():
    """A tokenizer of characters that writes "q" as an id of two bytes: a text that holds it is not cut."""
    ids = lambda text: [9 if c == "q" else ord(c) - 87 if c != " " else 0 for c in text]
    each = lambda runs: [np.array(ids(" " + r), "<u4").tobytes() for r in runs]
    lengths = np.ones(40, np.int64)
    lengths[9] = 2
    for runs in (["a", "bb", "", "c"], ["a", "q", "bb", "cq", "d"], [""], [], ["q"]):
        for at_once in (1, 2, 250):
            assert encode_joined(runs, lambda found: [ids(" " + t) for t in found], each, lengths, at_once) == each(runs)


def test_runs_are_kept_in_two_generations():
    """A table that overflows all the time gives the same ids, and forgets only what was not met again."""
    rng = random.Random(6)
    words = ["".join(rng.choices("abcdé \n", k=rng.randint(1, 6))) for _ in range(200)]
    batches = [[" ".join(rng.choices(words, k=30)) for _ in range(5)] for _ in range(20)]
    small, large = ta.Aligner(A, B, limit=20), ta.Aligner(A, B)
    for batch in batches:
        one, two = small.encode(batch), large.encode(batch)
        assert (one.a == two.a).all() and (one.b == two.b).all() and (one.docs_a == two.docs_a).all()
    assert len(small.known) + len(small.older) < len(large.known)
