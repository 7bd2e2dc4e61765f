from __future__ import annotations

import gc
import json
import random
import tracemalloc
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillon.llm.common import scratch_path, tidy
from quillon.llm.encoder import Encoder, Memory, byte_letters, encoder
from quillon.llm.token_counts import cached_counts, count_tokens, op1_token_counts

BPE = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "a", " a", "a ", "a  b", "a\n b", "a \nb", "it's we'LL", "x<|endoftext|>y", "über straße Ćć", "日本語 text 日本", "a　 b", "a  b", "12 3四", "a\x1f b", "tab\t\tb", "é é", "😀 😀!", "a b" * 5000, "don 't", "—dash — it", "²³ ½x", "q" * 3000]


def test_ids_are_the_library_s():
    ours, library = Encoder(BPE), Tokenizer.from_file(BPE)
    for _ in range(2):  # from the library, then from memory
        for text in ODD:
            assert ours.ids(text) == ours._pack(library.encode(text, add_special_tokens=False).ids), text


@settings(max_examples=100, deadline=None)
@given(st.text(st.sampled_from("aB1' \n\t.,é  日<|>\x1c\x85"), max_size=30) | st.text(max_size=30))
def test_any_text(text):
    ours, library = encoder(BPE), Tokenizer.from_file(BPE)
    assert ours.ids(text) == ours._pack(library.encode(text, add_special_tokens=False).ids)


def test_other_tokenizers():
    word, piece = (Encoder(public_tokenizers.path(x)) for x in ("word_bpe_49k.json", "piece_bpe_32k.model"))
    assert word.count("Hello  world") == 2
    assert piece.count("Hello world") == len(piece.library.encode("Hello world"))


def stored(spark, cache):
    return spark.read.option("recursiveFileLookup", True).parquet(cache).count()


def test_counts_and_cache(spark):
    library, cache = Tokenizer.from_file(BPE), scratch_path(spark, "test-cache")
    rows = [(i, t) for i, t in enumerate([*ODD, None, "a", "a"])] + [(None, "b b"), (3, "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("digest", F.lit(1)).withColumn("n_tokens", F.lit(1))
    expected = sorted((str(d), len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for d, t in rows)
    for _ in range(2):
        assert sorted((str(r.id), r.n_bytes, r.n_tokens) for r in count_tokens(docs, BPE, cache).collect()) == expected
    distinct = len({t or "" for _, t in rows})
    assert cached_counts(spark, cache, BPE).count() == distinct
    assert stored(spark, cache) == distinct  # the second call encoded nothing
    more = docs.limit(1).withColumn("text", F.lit("a new text"))
    count_tokens(more, BPE, cache).collect()
    assert stored(spark, cache) == distinct + 1


def test_empty(spark):
    assert count_tokens(spark.createDataFrame([], "doc_id long, text string"), BPE, scratch_path(spark, "test-cache")).count() == 0


def test_query_twice(spark, tmp_path):
    library = Tokenizer.from_file(BPE)
    rows = [(i, t) for i, t in enumerate([*ODD, None, "query twice " * 600, "query twice " * 600])]
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_bytes", F.lit(1)).write.parquet(str(tmp_path / "documents.parquet"))
    cache = spark.conf.get("spark.checkpoint.dir") + "/token-counts"
    sizes = []
    for _ in range(2):
        got = sorted((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in op1_token_counts(spark, str(tmp_path)).collect())
        n = [len(library.encode(t or "", add_special_tokens=False).ids) for _, t in rows]
        assert got == [(d, len((t or "").encode()), k, k > 1024) for (d, t), k in zip(rows, n, strict=True)]
        sizes.append(stored(spark, cache))
    assert sizes[0] == sizes[1] >= len({t or "" for _, t in rows})  # the second run encoded nothing


def test_jobs_that_append_at_once(spark):
    cache = scratch_path(spark, "test-cache")
    docs = spark.createDataFrame([(i, f"shared text {i % 50}") for i in range(200)], "doc_id long, text string")
    with ThreadPoolExecutor(3) as pool:
        got = list(pool.map(lambda _: sorted(count_tokens(docs, BPE, cache).collect()), range(3)))
    assert got[0] == got[1] == got[2] and len(got[0]) == 200
    assert cached_counts(spark, cache, BPE).count() == 50


def test_a_worker_s_memory_is_small():
    rng = random.Random(1)
    words = list(dict.fromkeys("".join(rng.choices("abcdefghijklmnop", k=rng.randint(5, 12))) for _ in range(60_000)))
    ours = Encoder(BPE)
    ours.count("begin")
    gc.collect()
    tracemalloc.start()
    try:
        arrow = pa.total_allocated_bytes()
        ours.count(" ".join(words))
        gc.collect()
        held = tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes() - arrow
    finally:
        tracemalloc.stop()
    assert held < 120 * len(words)  # as a piece and as a word; in dictionaries of strings it was 207


def test_a_full_memory_forgets_what_is_not_asked_for():
    memory, learnt = Memory(4, np.dtype("<u2")), []

    def learn(keys):
        learnt.append(keys.to_pylist())
        size = np.array([len(k) for k in keys.to_pylist()])
        return size, np.frombuffer("".join(keys.to_pylist()).encode(), np.uint8).astype("<u2"), np.ones(len(keys), bool)

    def look(*keys):
        size, start, flat = memory.look(pa.array(keys, pa.string()), learn)
        assert ["".join(map(chr, flat[a : a + n])) for a, n in zip(start, size, strict=True)] == list(keys)
        return learnt.pop() if learnt else []

    assert look("a", "bb", "ccc") == ["a", "bb", "ccc"]
    assert look("bb") == []
    assert look("dd", "bb", "e") == ["dd", "e"]  # five: a and ccc go
    assert look("dd", "e", "bb") == []
    assert look("ccc", "f", "g") == ["ccc", "f", "g"]  # only one finds room
    assert look("bb", "ccc") == []
    assert look("x" * 100) == look("x" * 100) == ["x" * 100]


def test_ids_when_memory_is_full(monkeypatch):
    monkeypatch.setattr("quillon.llm.encoder.PIECES", 50)
    monkeypatch.setattr("quillon.llm.encoder.WORDS", 30)
    monkeypatch.setattr("quillon.llm.encoder.LEARNT", 7)
    monkeypatch.setattr("quillon.llm.encoder.PLACED", 5)
    monkeypatch.setattr("quillon.llm.encoder.SPELLED", 3)
    rng, ours, library = random.Random(2), Encoder(BPE), Tokenizer.from_file(BPE)
    for _ in range(20):
        texts = [" ".join(rng.choices([*ODD[:24], "word", "other\nword", "it's", "é\tè", *map(str, range(60))], k=rng.randint(0, 30))) for _ in range(6)]
        lengths, ids = ours.batch(pa.array([*texts, None]))
        expected = [library.encode(t, add_special_tokens=False).ids for t in texts]
        assert lengths.tolist() == [*map(len, expected), 0]
        assert ids.tolist() == [i for e in expected for i in e]


def test_tidy_passes_batches_on():
    batches = [pa.RecordBatch.from_pydict({"a": [i]}) for i in range(3)]
    assert list(tidy(lambda some: (b.slice(0) for b in some))(iter(batches))) == batches


class Counted:
    """A tokenizer that counts what it is asked."""

    def __init__(self, of):
        self.of, self.calls = of, 0

    def encode_batch_fast(self, texts, **how):
        self.calls += 1
        return self.of.encode_batch_fast(texts, **how)


def test_first_words_reach_the_library_together():
    ours, library = Encoder(BPE), Tokenizer.from_file(BPE)
    ours.speller = Counted(ours.speller)
    texts = [f"qv{chr(97 + i % 26)}xz{chr(97 + i // 26)}kw" for i in range(320)]
    assert ours.batch(pa.array(texts))[1].tolist() == [i for t in texts for i in library.encode(t, add_special_tokens=False).ids]
    assert ours.speller.calls <= 20  # 32 words a call, with and without a space before them; 321 calls when each text had its own
    ours.count(" ".join(f"word{i}x" for i in range(40_000)))
    calls = ours.speller.calls
    assert ours.batch(pa.array(texts[:3]))[1].tolist() == [i for t in texts[:3] for i in library.encode(t, add_special_tokens=False).ids]
    assert ours.speller.calls <= calls + 2


def test_words_are_split_only_where_a_merge_could_cross(tmp_path):
    assert Encoder(BPE).speller.pre_tokenizer is None
    letters = byte_letters()
    vocab = {c: i for i, c in enumerate(letters.values())}
    nul, space = letters[0], letters[32]
    for a, b in (("a", "b"), (nul, space), ("b", nul), (space, "a")):
        vocab[a + b] = len(vocab)
    said = {"version": "1.0", "added_tokens": [], "normalizer": None, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}, "post_processor": None, "decoder": None}
    said["model"] = {"type": "BPE", "vocab": vocab, "merges": [f"{nul} {space}", f"b {nul}", "a b", f"{space} a"]}
    path = str(tmp_path / "crossing.json")
    (tmp_path / "crossing.json").write_text(json.dumps(said))
    ours, library = Encoder(path), Tokenizer.from_file(path)
    assert ours.simple
    assert ours.speller.pre_tokenizer is not None
    for text in ["ab b a ab", "b ab", "b b b a b", "ab\0 a b", *ODD]:
        assert ours.ids(text) == ours._pack(library.encode(text, add_special_tokens=False).ids), text
