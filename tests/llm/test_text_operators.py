"""Operators that work document by document, against libraries and plain Python."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, normalizers

from caseloom.llm import bloom_cascade, byte_cnn, chunk_table, count_viterbi, pii_bootstrap, range_coder
from caseloom.sources.tables import collected
from tests.llm.cases import AWKWARD, awkward_docs, empty_docs, rows_of

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")
RNG = random.Random(1)
ODD = ["".join(RNG.choice(" ▁ab\nßé😀the.") for _ in range(RNG.randint(0, 50))) for _ in range(400)]


def test_chunk_table_is_the_library(spark):
    codec, library = chunk_table.codec(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = [t or "" for t in AWKWARD] + ODD
    found = [np.frombuffer(x, "<u4").tolist() for x in codec.encode(texts)]
    assert found == library.encode(texts, add_bos=True, add_eos=True)
    assert codec.decode(codec.encode(texts)) == library.decode(found)
    docs = awkward_docs(spark)
    got = rows_of(chunk_table.round_trip_digests(docs, PIECES))
    want = []
    for r in docs.collect():
        ids = library.encode(r.text or "", add_bos=True, add_eos=True)
        digests = [hashlib.sha256(x).hexdigest() for x in (np.array(ids, "<u4").tobytes(), library.decode(ids).encode())]
        want.append((r.doc_id, len(ids), *digests))
    assert got == sorted(want, key=lambda r: tuple((x is not None, str(x)) for x in r))
    decoded = chunk_table.decode_ids(chunk_table.encode_texts(docs, PIECES), PIECES)
    assert decoded.count() == docs.count()
    assert chunk_table.round_trip_digests(empty_docs(spark), PIECES).count() == 0


def test_piece_table_stays_within_its_bound():
    table = chunk_table.PieceTable(lambda words: [w.encode() for w in words], limit=3, longest=4)
    assert table.encoded([["a", "bb", "a"], ["ccccc"]]) == [b"abba", b"ccccc"] and "ccccc" not in table.known
    assert table.encoded([["d", "e"]]) == [b"de"] and table.encoded([["f"]]) == [b"f"] and len(table.known) == 1


def test_piece_table_keeps_frequent_strings_in_little_room():
    asked = []
    table = chunk_table.PieceTable(lambda words: asked.extend(words) or [w.encode() for w in words], limit=8)
    for i in range(100):
        assert table.encoded([["often", f"w{i}"]]) == [f"oftenw{i}".encode()]
        assert len(table.known.keys() | table.older.keys()) <= 10
    assert asked.count("often") == 1
    # Two workers of an executor hold their tables beside whatever the heap has grown to.
    assert chunk_table.PieceTable(list).limit <= 200_000


def test_count_viterbi_is_the_unigram_tokenizer(spark):
    library = Tokenizer(models.Unigram(count_viterbi.vocabulary(PIECES), unk_id=0, byte_fallback=True))
    library.normalizer = normalizers.Sequence([normalizers.Prepend("▁"), normalizers.Replace(" ", "▁")])
    length = lambda t: len(library.encode(t or "", add_special_tokens=False).ids)
    assert count_viterbi.counter(PIECES).count(ODD) == [length(t) for t in ODD]
    docs = awkward_docs(spark)
    want = sorted(((r.doc_id, length(r.text)) for r in docs.collect()), key=lambda r: tuple((x is not None, str(x)) for x in r))
    assert rows_of(count_viterbi.count_tokens(docs, PIECES)) == want
    assert count_viterbi.count_tokens(empty_docs(spark), PIECES).count() == 0


def test_viterbi_ties_go_to_the_earlier_start():
    counter = count_viterbi.Counter([("<unk>", 0.0), ("▁", 0.0), ("a", -1.0), ("aa", -2.0), ("b", -1.0), ("ab", -2.0)])
    library = Tokenizer(models.Unigram([("<unk>", 0.0), ("▁", 0.0), ("a", -1.0), ("aa", -2.0), ("b", -1.0), ("ab", -2.0)], unk_id=0))
    for word in ("aa", "aab", "aaab", "abab", "baab"):
        assert counter.count_word("▁" + word) == len(library.encode("▁" + word).ids)


def test_blocks_round_trip_and_notice_damage():
    rng = np.random.default_rng(0)
    top = 1 << range_coder.BITS
    for ids in ([], [0], [5] * 20_000, rng.integers(0, top, 9000), rng.integers(0, 3, range_coder.BLOCK), [top - 1] * 8193):
        ids = np.array(ids, np.uint32)
        assert (range_coder.decode(range_coder.encode(ids)) == ids).all()
    blocks = range_coder.encode(rng.integers(0, 999, 20_000).astype("u4"))
    assert (range_coder.decode(blocks[1:2]) == range_coder.decode(blocks)[range_coder.BLOCK : 2 * range_coder.BLOCK]).all()
    for broken in (blocks[:1] + blocks[2:] + blocks[:1], [blocks[0][:-40] + bytes(40), *blocks[1:]]):
        try:
            range_coder.decode(broken)
            raise AssertionError("damage went unnoticed")
        except ValueError:
            pass


def test_id_files(spark):
    docs, library = awkward_docs(spark), Tokenizer.from_file(WORDS)
    got = rows_of(range_coder.read_ids(range_coder.write_ids(docs, WORDS, end_id=2)), "start", "doc_id", "n_tokens", "ids_crc32")
    at, want = 0, []
    for r in sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or "")):
        ids = np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((at, r.doc_id, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(got) == want
    assert range_coder.read_ids(range_coder.write_ids(empty_docs(spark), WORDS, end_id=2)).count() == 0


def test_blocks_are_not_shuffled(spark):
    """Reading finds each segment's start without sorting or shuffling blocks, whatever Spark would broadcast by itself."""
    written = range_coder.write_ids(awkward_docs(spark), WORDS, end_id=2)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = range_coder.read_ids(written)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def _luhn(digits):
    return sum(v - 9 * (v > 9) for i, c in enumerate(reversed(digits)) for v in [int(c) * (1 + i % 2)]) % 10 == 0


def _base(text):
    spans = []
    for kind, pattern in pii_bootstrap.PLAIN.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(x) > 255 for x in m.group().split(".")):
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and _luhn(digits)) or kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            spans.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(spans)


def test_base_spans_are_the_plain_patterns(spark):
    parts = ["1", "22", "256", ".", "@", "a.b", "-", " ", "+", "4111111111111111", "4111 1111-1111 1111", "(", "é", "😀", "_", "\n"]
    texts = ["".join(RNG.choice(parts) for _ in range(RNG.randint(1, 30))) for _ in range(500)]
    texts += [None, "", "a@" + ".a" * 5000, "1" * 20_000, "a" * 20_000 + "@", "+1" + " " * 9000 + "2"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = pii_bootstrap.digests(pii_bootstrap.find(docs)).collect()
    assert len(found) == len(texts)
    for r in found:
        base = _base(texts[r.doc_id] or "")
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest() and r.spans.startswith(base)


def test_bootstrap_finds_what_seeds_stand_beside(spark):
    rows = [f"filler words account 41111111111111{i:02} end" for i in range(40)]
    docs = spark.createDataFrame(list(enumerate(rows + ["page 4111111111111112 of"])), "doc_id long, text string")
    seeds = sum("card" in _base(r) for r in rows)
    found = {r.doc_id: r.spans for r in pii_bootstrap.digests(pii_bootstrap.find(docs, least_score=0.05)).collect()}
    assert seeds and sum("id:21:37" in s for s in found.values()) == len(rows) - seeds and found[40] == ""


def test_bootstrap_goes_on_from_what_it_found(spark):
    """The numbers found beside "account" recur after "ref", where no base span is."""
    numbers = [f"41111111111111{i:02}" for i in range(100)]
    valid, other = [n for n in numbers if _luhn(n)], [n for n in numbers if not _luhn(n)][:10]
    assert len(valid) == 10
    rows = [f"filler words account {n} end" for n in valid + other] + [f"more of ref {n} here" for n in other] + ["page 12 of", "page 13 of", "page 14 of"]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    found = [r.spans for r in sorted(pii_bootstrap.digests(pii_bootstrap.find(docs)).collect(), key=lambda r: r.doc_id)]
    assert found[10:20] == ["id:21:37"] * 10 and found[20:30] == ["id:12:28"] * 10 and found[30:] == [""] * 3


def test_bootstrap_takes_long_words(spark):
    """Words of more than 64 characters are candidates, and the word before counts whole however far off it is."""
    numbers = [f"41111111111111{i:02}" for i in range(100)]
    valid, other = [n for n in numbers if _luhn(n)], [n for n in numbers if not _luhn(n)][:10]
    rows = [f"filler account {'k' * 3000}-{n}, end" for n in valid + other] + ["page 12 of"]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    found = [r.spans for r in sorted(pii_bootstrap.digests(pii_bootstrap.find(docs)).collect(), key=lambda r: r.doc_id)]
    assert found == ["card:3016:3032"] * 10 + ["id:15:3032"] * 10 + [""]
    texts = [f"{'b' * 80} 12", f"a{'b' * 79} 12", f"account{' ' * 90}12", "no. 1" + "!" * 20_000 + "2" + "!" * 20_000, "ref 1" + "2" * 500, "ref 1" + "3" * 500]
    seen = pii_bootstrap.occurrences(pii_bootstrap.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))).collect()
    assert len(seen) == 6 and {"account 9:2", "ref 9:501"} <= {r.pattern for r in seen}
    assert len({r.pattern for r in seen}) == 5 and len({r.instance for r in seen}) == 4
    assert {r.end for r in seen if r.start == 4} == {505, 20_006} and max(len(r.pattern + r.instance) for r in seen) < 150


def test_every_base_span_is_a_seed(spark):
    texts = ["mail bob@example.com now", "call +1 (212) 555-0000 now", "card 4111 1111 1111 1111", "at @home"]
    seen = pii_bootstrap.occurrences(pii_bootstrap.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))).collect()
    seeds = {(r.pattern, r.instance) for r in seen if r.seed}
    assert seeds >= {("mail a@a.a:15", "bob@example.com"), ("call +9 9 9-9:15", "+1 212 555-0000"), ("card 9 9 9 9:19", "4111 1111 1111 1111")}
    assert all(r.seed for r in seen)


def test_redact_keeps_rows_and_columns(spark):
    docs = awkward_docs(spark)
    clean = pii_bootstrap.redact(docs)
    assert clean.columns == docs.columns and clean.count() == docs.count()
    texts = [r.text for r in clean.collect()]
    assert "Mail <email> or <phone>!" in texts and texts.count(None) == 2
    assert pii_bootstrap.redact(empty_docs(spark)).count() == pii_bootstrap.digests(pii_bootstrap.find(empty_docs(spark))).count() == 0


def test_redact_shuffles_texts_with_identifiers_only(spark):
    """Equal texts are redacted alike; no text is staged."""
    plain = [(i, f"nothing to see in text {chr(97 + i % 26)}") for i in range(300)]
    seeds = [(1000 + i, f"Ask, contact: user{i}@example.com now") for i in range(12)] + [(2000 + i % 2, "Ask, contact: user99@elsewhere now") for i in range(4)]
    docs = spark.createDataFrame(plain + seeds, "doc_id long, text string")
    with collected() as made:
        clean = pii_bootstrap.redact(docs)
    assert made and not any({"r", "text"} & set(spark.read.parquet(path).columns) for path in made)
    got = rows_of(clean)
    assert len(got) == len(plain) + len(seeds) and all((i, t) in got for i, t in plain)
    assert all("@example.com" not in t for _, t in got) and len({t for i, t in got if i in (2000, 2001)}) == 1


def test_redact_runs_no_python(spark):
    docs = spark.createDataFrame([(i, f"Ask, contact: user{i}@example.com now") for i in range(12)], "doc_id long, text string")
    plan = pii_bootstrap.redact(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Join" in plan and not re.search("Python|Pandas|Arrow", plan)


def test_marked_rows_hold_all_keys_and_few_others(spark):
    rows = spark.range(20_000).select("id", F.xxhash64("id").alias("g1"), F.xxhash64(F.lit(1), "id").alias("g2"))
    keys = rows.where("id % 10 = 3").select("g1", "g2")
    wanted = F.col("id") % 10 == 3
    for words, most in ((bloom_cascade.MOST_WORDS, 400), (16, 18_000)):
        marked = bloom_cascade.mark_likely(rows, keys, words)
        assert marked.columns == ["id", "g1", "g2", "likely"] and marked.where(wanted & F.col("likely")).count() == 2000
        assert marked.count() == 20_000 and marked.where(~wanted & F.col("likely")).count() <= most
    assert bloom_cascade.mark_likely(rows, keys.limit(0)).where("likely").count() == 0


def test_network_learns_and_scores_whole_texts(spark):
    rng = random.Random(4)
    good = [" ".join(rng.choices(["river", "stone", "under", "light", "the", "and"], k=rng.randint(5, 300))) for _ in range(150)]
    junk = [" ".join(rng.choices(["#$%!!", "@@@", "&&&***"], k=rng.randint(5, 300))) for _ in range(150)]
    texts, labels = good + junk, np.array([1.0] * 150 + [0.0] * 150, "f4")
    order = np.random.default_rng(0).permutation(300)
    network = byte_cnn.train([texts[i].encode() for i in order[:200]], labels[order[:200]])
    held = network.scores([texts[i].encode() for i in order[200:]])
    assert ((held >= 0.5) == labels[order[200:]]).mean() > 0.95
    # The end of a long text counts as its start does.
    assert network.scores([(good[0] * 50).encode()])[0] != network.scores([(good[0] * 50 + junk[0] * 20).encode()])[0]
    docs = awkward_docs(spark)
    scored = byte_cnn.classify(docs, network).collect()
    assert len(scored) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in scored)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in scored)
    one_kind = spark.createDataFrame([(0, 1), (1, None), (3, 1), (99, 0)], "doc_id long, quality int")
    assert {r.predicted for r in byte_cnn.classify(docs, byte_cnn.fit(docs, one_kind)).collect()} == {1}
    assert byte_cnn.classify(empty_docs(spark), byte_cnn.fit(empty_docs(spark), one_kind)).count() == 0


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(1)
    docs, labels = [rng.bytes(n) for n in (10, 700, 1500)], np.array([1, 0, 1], "f4")
    network = byte_cnn.train(docs, labels, epochs=1, least_steps=2)

    def loss():
        p = network.scores(docs)
        return float(-(labels * np.log(p) + (1 - labels) * np.log(1 - p)).mean())

    network.filters = network.filters.astype("f8")
    grads = byte_cnn.gradients(network, docs, labels)
    for i, j in ((0, 0), (5, 3), (40, 7)):
        before, step = network.filters[i, j], 1e-4
        network.filters[i, j] = before + step
        up = loss()
        network.filters[i, j] = before - step
        down = loss()
        network.filters[i, j] = before
        assert abs((up - down) / (2 * step) - grads[1][i, j]) < 2e-3
