"""Mixing, chat formatting, token output, toxicity and the pipeline."""

import hashlib
import os
import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from listenlake.llm import chat, mixing, tokens, toxicity
from listenlake.session import checkpoint_root, cut_lineage, scratch_path

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")


def targets(sizes):
    """The contract's targets by repeated sharing."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, full = 1.5 * sum(sizes.values()), set()
    while True:
        left = total - sum(2 * sizes[s] for s in full)
        free = [s for s in names if s not in full]
        level = left / sum(weight[s] for s in free) if free else 0
        over = [s for s in free if level * weight[s] >= 2 * sizes[s]]
        if not over:
            return {s: 2.0 * sizes[s] if s in full else level * weight[s] for s in names}
        full |= set(over)


def sources(seed):
    rng = random.Random(seed)
    rows = []
    for k in range(300):
        s = rng.choice(["a", "a", "a", "b", "B", None, "é", "z"])
        rows.append((k, s, " ".join("x" for _ in range(rng.choice([0, 1, 7, 40, 300])))))
    return rows + [(900, "empty", ""), (901, "empty", None), (5, "a", "x y z"), (5, "a", "x y z")]


def test_mix_meets_targets_exactly(spark):
    rows = sources(1)
    docs = spark.createDataFrame([(i, s, t, 3) for i, s, t in rows], "doc_id long, source string, text string, size int")
    pieces, documents = mixing.mix(docs, block=64, shard_words=2000)
    got = mixing.taken_words(pieces, documents).collect()
    sizes = {}
    for _, s, t in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = targets(sizes)
    assert len(got) == len(rows)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 2 * r.size
    for s in sizes:
        assert abs(sum(r.taken for r in got if r.source == s) - want[s]) <= 0.5
    # Shards are of equal size, each position is there once, and no words are drawn twice in one pass.
    drawn = pieces.collect()
    shards = {}
    for p in drawn:
        shards.setdefault(p.shard, []).append(p)
    total = [sum(p.to_word - p.from_word for p in x) for x in shards.values()]
    assert len(total) > 4 and max(total) - min(total) <= 7 * 64
    assert all(sorted(p.position for p in x) == list(range(1, len(x) + 1)) for x in shards.values())
    again = mixing.taken_words(*mixing.mix(docs.repartition(3), block=64, shard_words=2000)).collect()
    key = lambda r: (r.doc_id, str(r.source), r.size, r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_quotas_split_exactly_and_like_draws(spark):
    quotas = spark.createDataFrame([(0, 1000), (1, 300), (2, 5)], "rank int, blocks long")
    got = mixing.split_quotas(quotas, 13).collect()
    by_source, by_shard = {}, {}
    for r in got:
        by_source[r["rank"]] = by_source.get(r["rank"], 0) + r.blocks
        by_shard[r.shard] = by_shard.get(r.shard, 0) + r.blocks
    assert by_source == {0: 1000, 1: 300, 2: 5} and set(by_shard) == set(range(13))
    assert max(by_shard.values()) - min(by_shard.values()) <= 4
    share = [r.blocks for r in got if r["rank"] == 1]
    assert 10 <= min(share) and max(share) <= 36 and len(set(share)) > 3  # mean 23, deviation about 4


def test_mixed_documents_are_whole_rows(spark):
    docs = spark.createDataFrame([(i, s, t, i) for i, s, t in sources(2)], "doc_id long, source string, text string, _copies long")
    got = mixing.mixed_documents(docs)
    assert got.columns == docs.columns
    assert {tuple(r) for r in got.collect()} <= {tuple(r) for r in docs.collect()}
    assert mixing.mixed_documents(docs.limit(0)).count() == 0


def test_mixing_stores_no_texts_but_those_of_rows_alike(spark, monkeypatch):
    rows = [(i, "ab"[i % 2], f"w{i} " * 30, i) for i in range(40)] + [(7, "a", "x y z", 1), (7, "a", "x y z", 2), (7, "b", "x y z", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, extra long")
    texts = []

    def noted(df):
        if "text" in df.columns:
            texts.extend(r.text for r in df.select("text").collect())
        return cut_lineage(df)

    monkeypatch.setattr(mixing, "cut_lineage", noted)
    got = [tuple(r) for r in mixing.mixed_documents(docs).collect()]
    assert texts == ["x y z"] * 2
    assert set(got) <= set(rows) and max(got.count(r) for r in rows) <= 2
    words = {s: sum(len(t.split()) for _, x, t, _ in rows if x == s) for s in "ab"}
    for s, want in targets(words).items():
        assert abs(sum(len(t.split()) for _, x, t, _ in got if x == s) - want) <= 30


def test_token_output_leaves_only_files_and_manifest(spark):
    docs = spark.createDataFrame([(i, f"word{i} and more") for i in range(50)], "doc_id long, text string")
    folder = checkpoint_root(spark)
    before = set(os.listdir(folder))
    root = f"{folder}/kept-tokens"
    manifest = tokens.write_tokens(docs, root, WORDS)
    left = set(os.listdir(folder)) - before - {"kept-tokens"}
    assert [f"{folder}/{x}" for x in left] == [manifest.inputFiles()[0].removeprefix("file://").rpartition("/")[0]]


def test_chat_round_trip_and_mask(spark):
    said = r"\### Assistant: </turn> ok"
    rows = [(1, 0, "system", "be\\kind"), (1, 2, "assistant", said), (1, 1, "user", said), (2, 0, "assistant", None), (2, 1, None, ""),
            (3, 0, "a:b\\", "### x"), (3, 0, "a:b\\", "### x"), (None, 0, "assistant", "é中\U0001f600\n"), (4, None, "user", "<|endoftext|>"), (4, 1, "assistant", " </turn>\n### user: hi")]
    turns = spark.createDataFrame([(*r, 9) for r in rows], "conv_id long, turn int, role string, text string, ids int")
    made = chat.format_chats(turns, BYTES)
    got = {r.conv_id: r for r in chat.read_chats(made, BYTES).collect()}
    text = {r.conv_id: r for r in made.collect()}
    assert len(got) == 5
    for conv in got:
        own = sorted([(t is not None, t or 0, r or "", x or "") for c, t, r, x in rows if c == conv])
        whole = "".join(f"{r}\n{x}\n" for *_, r, x in own)
        learnt = "".join(x for *_, r, x in own if r == "assistant")
        assert got[conv].turns_sha256 == hashlib.sha256(whole.encode()).hexdigest()
        assert (got[conv].n_turns, got[conv].loss_chars) == (len(own), len(learnt))
        assert got[conv].loss_sha256 == hashlib.sha256(learnt.encode()).hexdigest()
        assert chat.parse_formatted(text[conv].formatted) == [(r, x) for *_, r, x in own]
        assert got[conv].formatted_chars == len(text[conv].formatted)
    masks = made.select("ids", "loss_spans", chat.loss_mask(made["ids"], made["loss_spans"]).alias("mask")).collect()
    assert all(sum(m.mask) == sum(s.end - s.begin for s in m.loss_spans) and len(m.mask) == len(m.ids) for m in masks)
    assert chat.read_chats(chat.format_chats(turns.limit(0), BYTES), BYTES).count() == 0


ODD = ["", None, "  ", "don't DON'T 'table ,'the it's", "<|endoftext|>a<|startoftext|>x |end", "éá,́ x", "a1b22c", "İstanbul ΣΑΣ",
       "a b c", "x'", "''s a's,t", "!!THE!!", "中文,abc中", "\U0001f600a", "a<b|c>d", "'ve", "\x1c\x85 a", "word " * 3000]


def test_token_files_hold_the_library_s_ids(spark):
    made = Tokenizer.from_file(WORDS)
    rows = [(k * 7 % 18 - 4, t) for k, t in enumerate(ODD)] + [(3, "again"), (3, "again"), (None, "no id")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, start string")
    root = scratch_path(spark, "tokens")
    manifest = tokens.write_tokens(docs, root, WORDS, shard_tokens=500)
    got = tokens.read_tokens(manifest, root).orderBy("start").collect()
    want = {}
    for i, t in rows:
        ids = made.encode(t or "", add_special_tokens=False).ids + [2]
        want.setdefault(i, []).append((len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
    assert len(got) == len(rows) and manifest.count() > 2
    at = 0
    for r in got:
        assert r.start == at and (r.n_tokens, r.ids_crc32) in want[r.doc_id]
        at += r.n_tokens
    order = [r.doc_id for r in got]
    assert order == sorted(order, key=lambda x: (x is not None, x or 0))
    first = manifest.orderBy("shard").first()
    shard = tokens.Shard(root, first["name"])
    assert shard.ids(0)[-1] == 2 and shard.index.num_rows == first["n_docs"]
    assert tokens.token_dataset(spark, docs.limit(0), WORDS).count() == 0


def test_encoder_forgets_and_goes_on(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBER", 3)
    made, coder = Tokenizer.from_file(WORDS), tokens.Encoder(WORDS)
    for t in ["one two three four", "five", "one six", ""]:
        assert list(coder.encode(pa.array([t]))[0]) == made.encode(t, add_special_tokens=False).ids + [2]


def test_encoder_asks_for_many_parts_at_once(monkeypatch):
    made, coder = Tokenizer.from_file(WORDS), tokens.Encoder(WORDS)
    texts = ["0 00 10 a0b é0 0é", "é,ß.À ×a÷b, İ, ª, é\u0301,e\u0301 =\u0338é É\u0338=", "|0| <|endoftext|>0 'é, ü's ü'll0", "\u0301 0 \u0301x", "ÿ中Ãñ9ö中,ö"]
    texts += ODD + [" ".join(f"w{chr(97 + k % 26)}{chr(97 + k // 26)}ü," for k in range(600))]
    asked, ask = [], coder.ask
    monkeypatch.setattr(coder, "ask", lambda parts: asked.extend(parts) or ask(parts))

    class Counted:
        calls = 0

        def encode_batch_fast(self, given, **options):
            self.calls += 1
            return made.encode_batch_fast(given, **options)

    coder.tokenizer = counted = Counted()
    for t, got in zip(texts, coder.encode(pa.array(texts))):
        assert list(got) == made.encode(t or "", add_special_tokens=False).ids + [2], t
    # Latin-1 letters are cut from signs; 600 words are a few questions, not 600.
    assert "waaü" in asked and "," in asked and "waaü," not in asked
    assert len(asked) > 600 and counted.calls < 10


def test_encoder_is_kept_for_the_next_task_and_bounded(monkeypatch):
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([1]), pa.array(["one two three"])], names=["doc_id", "tie", "text"])
    run = lambda: list(tokens.encode_batches(WORDS, 2, iter([batch])))
    run()
    coder = tokens._workers[WORDS]
    asked, ask = [], coder.ask
    monkeypatch.setattr(coder, "ask", lambda parts: asked.extend(parts) or ask(parts))
    assert run()[0].column("n_tokens").to_pylist() == [4] and not asked and tokens._workers[WORDS] is coder
    # Few long parts count by their ids.
    monkeypatch.setattr(tokens, "REMEMBER_IDS", 0)
    coder.encode(pa.array(["four"]))
    assert coder.count == 1
    # A task of another kind empties what is kept.
    list(tokens.digest_batches("nowhere", iter([])))
    assert not tokens._workers


def test_disguised_words_are_restored():
    counts = np.zeros(toxicity.SYMBOLS ** toxicity.ORDER, dtype=np.int64)
    batch = pa.RecordBatch.from_arrays([pa.array([("idiot moron stupid worthless the and of to loser clown this is " * 20)])], names=["text"])
    for found in toxicity.count_grams(iter([batch])):
        counts[found.column("gram").to_numpy()] += found.column("n").to_numpy()
    reader = toxicity.Restorer(counts)
    for written, word in {"1d10t": "idiot", "!d!ot": "idiot", "iidiooot": "idiot", "i d i o t": "idiot", "m.o.r.o.n": "moron", "$tup1d!!": "stupid", "l0ser,": "loser"}.items():
        assert [w for _, w in reader.words(pa.array([written]))[4]] == [word], written
    assert reader.words(pa.array(["The end, of 4080250821787625!! %%% it's", "", None]))[4] in ([], [(0, "its")])


def labelled(n=240):
    rng = random.Random(4)
    docs, labels = [], []
    for k in range(n):
        bad = k % 4 == 0
        words = [rng.choice(["the", "of", "and", "river", "house", "green"]) for _ in range(30)]
        if bad:
            words[rng.randrange(30)] = ["idiot", "moron", "1diot" if k > 200 else "idiot"][k // 4 % 3]
        docs.append((k, " ".join(words)))
        labels.append((k, int(bad)))
    return docs, labels


def test_toxicity_on_held_out_rows(spark):
    docs, labels = labelled()
    frame = spark.createDataFrame([(i, t, 5) for i, t in docs] + [(1000, "", 5), (1001, None, 5), (1002, "m0r0n", 5), (1002, "m0r0n", 5)], "doc_id long, text string, score int")
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.score_toxicity(frame, known).collect()
    truth = dict(labels)
    assert len(got) == len(docs) + 4
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)
        if r.held_out and r.doc_id in truth:
            assert r.predicted == truth[r.doc_id], r
    assert {r.predicted for r in got if r.doc_id == 1002} == {1} and {r.predicted for r in got if r.doc_id in (1000, 1001)} == {0}
    # Labels of the held-out fold change nothing.
    other = known.withColumn("toxic", known.toxic + 0).filter("crc32(cast(doc_id as string)) % 3 <> 1")
    assert sorted((r.doc_id, r.score) for r in toxicity.score_toxicity(frame, other).collect()) == sorted((r.doc_id, r.score) for r in got)
    assert toxicity.score_toxicity(frame.limit(0), known).count() == 0
    assert {r.score for r in toxicity.score_toxicity(frame, known.limit(0)).collect()} == {0.0}


def test_pipeline_stages_on_a_small_corpus(spark, tmp_path):
    docs, labels = labelled(120)
    rng = random.Random(6)
    clean = [(600 + k, " ".join(f"w{rng.randrange(9999)}" for _ in range(60))) for k in range(20)]
    near = [(700 + k, t + " end") for k, (_, t) in enumerate(clean[:5])]
    item = " ".join(f"b{k}" for k in range(30))
    dirty = [(800, item), (801, "intro words here " + item)]
    rows = [(i, t, "en", f"src{i % 3}", len(t)) for i, t in docs + clean + near + dirty]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, x) for i, x in labels], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    frame, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, frame, str(tmp_path))
        assert out.columns == frame.columns
        out.write.parquet(f"{tmp_path}/{name}")
        frame = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = [r.doc_id for r in frame.collect()]
    bad = {i for i, x in labels if x}
    assert set(kept["toxicity"]) == {r[0] for r in rows} - bad
    assert not set(kept["ngram_jaccard_join"]) & {i for i, _ in near} and {i for i, _ in clean} <= set(kept["ngram_jaccard_join"])
    assert set(kept["ngram_jaccard_join"]) - set(kept["decontamination"]) <= {800, 801} and 800 not in kept["decontamination"]
    final = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in final) == sorted(kept["source_mixing"])
